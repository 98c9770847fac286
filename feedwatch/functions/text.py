"""String functions over columns.  Everything stays in built-in expressions."""

from __future__ import annotations

from collections.abc import Callable

from pyspark.sql import Column
from pyspark.sql import functions as F

from feedwatch.functions import formats as fmt

StrCol = Column | str


def as_col(value: StrCol) -> Column:
    return F.col(value) if isinstance(value, str) else value


def bind(value: Column, body: Callable[[Column], Column]) -> Column:
    """Evaluate ``value`` once and hand it to ``body`` (a boolean expression using it many times).

    A plain projected column would be inlined by the optimizer and recomputed for every element a
    nested lambda visits; a lambda variable is not.
    """
    return F.exists(F.array(value), body)


def fill_site(template: str, site: StrCol) -> Column:
    """Put the site into one of the ``{site}`` texts."""
    before, _, after = template.partition("{site}")
    return F.concat(F.lit(before), as_col(site), F.lit(after))


# ---------------------------------------------------------------- slices and trims


def py_strip(value: StrCol) -> Column:
    """Strip every Unicode blank at both ends (Spark's ``trim`` removes spaces only)."""
    return F.btrim(as_col(value), F.lit(fmt.PY_WHITESPACE))


def arxiv_title_clean(title: StrCol) -> Column:
    """Title up to the identifier marker; without a marker the last character goes (slice to -1)."""
    title = as_col(title)
    at = F.instr(title, fmt.TITLE_MARKER)
    end = F.when(at == 0, F.length(title)).otherwise(at) - 1
    return py_strip(F.left(title, end))


def newline_to_space(value: StrCol) -> Column:
    return F.replace(as_col(value), F.lit("\n"), F.lit(" "))


def arxiv_id_from_link(link: StrCol) -> Column:
    return F.substring_index(as_col(link), "/", -1)


def abstract_body(summary: StrCol) -> Column:
    """Text after the abstract marker; ``instr`` = 0 gives the reference slice for a missing one."""
    summary = as_col(summary)
    start = F.instr(summary, fmt.ABSTRACT_MARKER) + len(fmt.ABSTRACT_MARKER)
    return F.substr(summary, start)


def strip_anchor(value: StrCol) -> Column:
    """Text between ``">`` and ``</a>``, with negative-index slices when either is missing."""
    value = as_col(value)
    opening = F.instr(value, '">')
    closing = F.instr(value, "</a>")
    end = F.when(closing == 0, F.length(value)).otherwise(closing) - 1
    return F.substr(value, opening + 2, F.greatest(F.lit(0), end - opening - 1))


def split_authors(author: StrCol) -> Column:
    return F.split(as_col(author), fmt.AUTHOR_SEPARATOR)


def join_authors(names: Column) -> Column:
    return F.array_join(names, fmt.AUTHOR_SEPARATOR)


def feed_path(site: StrCol, base: str = fmt.DAILY_FEED_BASE, suffix: str = "") -> Column:
    return F.concat(F.lit(base), as_col(site), F.lit(suffix))


def watchlist_set(site: StrCol) -> Column:
    """Metadata set of a site.  Membership is tested before stripping, as the contract has it."""
    site = as_col(site)
    bare = py_strip(site)
    return F.when(site.isin(fmt.NON_PHYSICS_SETS), bare).otherwise(F.concat(F.lit("physics:"), bare))


def set_to_site(set_name: StrCol) -> Column:
    return F.element_at(F.split(as_col(set_name), ":"), -1)


def sentence_split(text: StrCol) -> Column:
    """Sentences by rule: a run without ``.!?`` plus the ``.!?`` after it, trimmed, empties out."""
    pieces = F.regexp_extract_all(as_col(text), F.lit(r"[^.!?]+[.!?]*"), F.lit(0))
    return F.filter(F.transform(pieces, py_strip), lambda s: s != "")


# ---------------------------------------------------------------- case and highlighting


def py_capitalize(word: StrCol) -> Column:
    """First character in title case (``ß`` → ``Ss``), the rest lowered."""
    word = as_col(word)
    return F.concat(F.initcap(F.left(word, F.lit(1))), F.lower(F.substr(word, F.lit(2))))


def py_title(word: StrCol) -> Column:
    """Capitalise every letter run (``initcap`` only looks at blanks)."""
    runs = F.regexp_extract_all(as_col(word), F.lit(r"\p{L}+|\P{L}+"), F.lit(0))
    return F.array_join(F.transform(runs, py_capitalize), "")


def word_forms(words: Column) -> Column:
    """The three spellings highlighting needs, computed once per watch rule and not per entry."""
    return F.transform(
        words,
        lambda w: F.struct(
            F.lower(w).alias("low"),
            py_capitalize(w).alias("cap"),
            py_title(F.lower(w)).alias("titled"),
        ),
    )


def wrap_words(text: StrCol, forms: Column, tags: tuple[str, str]) -> Column:
    """Fold over the words: low → tagged low, cap → tagged cap, then cap again → tagged title form.

    The third replacement hits what the second put in, and later words can hit earlier tags.  Both
    are part of the contract.
    """
    opened, closed = F.lit(tags[0]), F.lit(tags[1])

    def tagged(word: Column) -> Column:
        return F.concat(opened, word, closed)

    def step(acc: Column, form: Column) -> Column:
        acc = F.replace(acc, form["low"], tagged(form["low"]))
        acc = F.replace(acc, form["cap"], tagged(form["cap"]))
        return F.replace(acc, form["cap"], tagged(form["titled"]))

    return F.aggregate(forms, as_col(text), step)


def bold_words(text: StrCol, forms: Column) -> Column:
    return wrap_words(text, forms, fmt.BOLD_TAGS)


def author_hit(name: Column, authors: Column) -> Column:
    """A single author name contains a watched author anywhere (position 0 included)."""
    return F.exists(authors, lambda a: F.instr(name, a) >= 1)


def bold_authors(author: StrCol, match: StrCol, authors: Column) -> Column:
    """Author line: watched names bold for author matches, the plain list for the others."""
    names = split_authors(author)
    marked = F.transform(
        names,
        lambda n: F.when(
            author_hit(n, authors), F.concat(F.lit("<b>"), n, F.lit("</b>"))
        ).otherwise(n),
    )
    by_author = F.concat(F.array_join(marked, " , "), F.lit(" "))
    return F.when(as_col(match) == "author", by_author).otherwise(join_authors(names))


# ---------------------------------------------------------------- rendering


def html_escape(value: StrCol) -> Column:
    """The five HTML escapes; the ampersand has to come first."""
    value = as_col(value)
    # fixed values: characters and their entities
    for char, entity in [
        ("&", "&amp;"),
        ("<", "&lt;"),
        (">", "&gt;"),
        ('"', "&quot;"),
        ("'", "&#x27;"),
    ]:
        value = F.replace(value, F.lit(char), F.lit(entity))
    return value


def render_entry_html(
    title: StrCol,
    author: StrCol,
    summary: StrCol,
    link: StrCol,
    match: StrCol,
    forms: Column,
    authors: Column,
) -> Column:
    parts = (as_col(link), wrap_words(title, forms, fmt.TITLE_TAGS), bold_authors(author, match, authors), bold_words(abstract_body(summary), forms))
    return _between(fmt.ENTRY_HTML, parts)


def _between(frame: tuple[str, ...], parts: tuple[Column, ...]) -> Column:
    """The parts with the frame's texts before, between and after them."""
    pieces = [x for text, part in zip(frame, parts, strict=False) for x in (F.lit(text), part)]
    return F.concat(*pieces, F.lit(frame[-1]))


def render_entry_text(title: StrCol, author: StrCol, summary: StrCol) -> Column:
    parts = (as_col(title), join_authors(split_authors(author)), abstract_body(summary))
    return F.concat(*(x for part, text in zip(parts, fmt.ENTRY_TEXT, strict=True) for x in (part, F.lit(text))))


def render_pair_html(
    title: StrCol,
    summary: StrCol,
    link: StrCol,
    target_title: StrCol,
    target_summary: StrCol,
    target_link: StrCol,
) -> Column:
    return F.format_string(
        fmt.PAIR_TEMPLATE,
        *(as_col(c) for c in (title, summary, link, target_title, target_summary, target_link)),
    )


def render_pair_text(
    title: StrCol, summary: StrCol, target_title: StrCol, target_summary: StrCol
) -> Column:
    parts = [as_col(c) for c in (title, summary, target_title, target_summary)]
    return F.array_join(F.array(*parts), "\n")


def render_journal_html(title: StrCol, published: StrCol, link: StrCol, summary: StrCol) -> Column:
    """One list item, with the line break that separates it from what comes before."""
    link, summary = as_col(link), as_col(summary)
    before, after = fmt.JOURNAL_SUMMARY
    body = F.when(summary != "", F.concat(F.lit(before), summary, F.lit(after))).otherwise("")
    return _between(fmt.JOURNAL_ITEM, (html_escape(title), html_escape(published), link, link, body))


def render_journal_text(title: StrCol, published: StrCol, link: StrCol, summary: StrCol) -> Column:
    summary = as_col(summary)
    newline = F.lit("\n")
    return F.concat(
        newline,
        F.concat(as_col(title), newline, as_col(published), newline, as_col(link), newline),
        F.when(summary != "", F.concat(newline, summary, newline)).otherwise(""),
        F.lit("\n\n"),
    )


# ---------------------------------------------------------------- labels, dates, subjects


def match_to_text(code: StrCol) -> Column:
    code = as_col(code)
    label = F.lit("")
    for name, number in fmt.MATCH_CODES.items():
        label = F.when(code == number, name).otherwise(label)
    return label


def text_to_match(label: StrCol) -> Column:
    label = as_col(label)
    code = F.lit(fmt.NO_MATCH_CODE)
    for name, number in fmt.MATCH_CODES.items():
        code = F.when(label == name, number).otherwise(code)
    return code


def is_flush_day(day: StrCol) -> Column:
    return F.weekday(as_col(day)) == fmt.SUNDAY


def week_start(day: StrCol) -> Column:
    return F.to_date(F.date_trunc("week", as_col(day)))


def daily_subject(site: StrCol) -> Column:
    return fill_site(fmt.DAILY_SUBJECT, site)


def similarity_subject(site: StrCol) -> Column:
    return fill_site(fmt.SIMILARITY_SUBJECT, site)


def weekly_subject(site: StrCol, kind: StrCol, found: Column) -> Column:
    kind = as_col(kind)
    hit = F.when(kind == "author", fill_site(fmt.WEEKLY_SUBJECTS["author"], site)).otherwise(
        fill_site(fmt.WEEKLY_SUBJECTS["keyword"], site)
    )
    return F.when(found, hit).otherwise(weekly_fallback(site, kind))


def weekly_fallback(site: StrCol, kind: StrCol) -> Column:
    return F.when(
        as_col(kind) == "author", fill_site(fmt.WEEKLY_FALLBACKS["author"], site)
    ).otherwise(fill_site(fmt.WEEKLY_FALLBACKS["keyword"], site))
