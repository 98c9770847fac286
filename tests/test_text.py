from __future__ import annotations

import pytest
from pyspark.sql import functions as F

from feedwatch.functions import formats as fmt
from feedwatch.functions import html as hm
from feedwatch.functions import text as tx


def evaluate(spark, value, column):
    """The column over one text."""
    return spark.createDataFrame([(value,)], "t string").select(column(F.col("t"))).first()[0]


@pytest.mark.parametrize(
    ("column", "value", "expected"),
    [
        (tx.abstract_body, "id: 1 Abstract: Body", " Body"),
        (tx.abstract_body, "0123456789", "89"),
        (tx.arxiv_title_clean, "My title. (arXiv:1.2 [cs])", "My title."),
        (tx.arxiv_title_clean, "My title", "My titl"),
        (tx.arxiv_title_clean, "\n My title\t (arXiv:1", "My title"),
        (tx.arxiv_title_clean, "", ""),
        (tx.arxiv_title_clean, "(arXiv:1", ""),
        (tx.arxiv_id_from_link, "https://arxiv.org/abs/2111.00396", "2111.00396"),
        (tx.arxiv_id_from_link, "https://arxiv.org/abs/hep-th/9901001", "9901001"),
        (tx.arxiv_id_from_link, "https://arxiv.org/abs/2111.00396/", ""),
        (tx.strip_anchor, '<a href="u">Name</a>', "Name"),
        (tx.strip_anchor, "Name", "am"),
        (tx.strip_anchor, "Name</a>", "ame"),
        (tx.strip_anchor, 'x">Name', "Nam"),
        (tx.strip_anchor, "", ""),
        (tx.watchlist_set, "cs", "cs"),
        (tx.watchlist_set, "gr-qc", "physics:gr-qc"),
        (tx.watchlist_set, " cs ", "physics:cs"),
        (tx.set_to_site, "physics:gr-qc", "gr-qc"),
        (tx.set_to_site, "cs", "cs"),
        (tx.html_escape, "<a href=\"x\">&'", "&lt;a href=&quot;x&quot;&gt;&amp;&#x27;"),
        (tx.py_title, "non-copernican", "Non-Copernican"),
        (tx.py_title, "3d they're", "3D They'Re"),
        (tx.py_capitalize, "RTOS", "Rtos"),
        (tx.py_capitalize, "ßa", "Ssa"),
        (tx.newline_to_space, "a\nb\r\n", "a b\r "),
    ],
)
def test_golden(spark, column, value, expected):
    assert evaluate(spark, value, column) == expected


@pytest.mark.parametrize(
    ("text", "words", "expected"),
    [
        ("Compiler compiler", ["compiler"], "<b><b>Compiler</b></b> <b>compiler</b>"),
        ("Quantum computing", ["quantum computing"], "<b><b>Quantum Computing</b></b>"),
        ("Quantum Computing", ["quantum computing"], "Quantum Computing"),
        ("RTOS", ["RTOS"], "RTOS"),
        ("3d x", ["3d"], "<b><b><b>3D</b></b></b> x"),
        ("a compiler", ["compiler", "b"], "a <<b>b</b>>compiler</<b>b</b>>"),
        ("nothing", [], "nothing"),
    ],
)
def test_highlighting(spark, text, words, expected):
    forms = tx.word_forms(F.array(*(F.lit(w) for w in words)).cast("array<string>"))
    assert evaluate(spark, text, lambda t: tx.bold_words(t, forms)) == expected


@pytest.mark.parametrize(
    ("match", "expected"),
    [("author", "<b>Ann Lee</b> , Bob , X Ann Leeds "), ("title", "Ann Lee, Bob, X Ann Leeds")],
)
def test_bold_authors(spark, match, expected):
    watched = F.array(F.lit("Ann Lee"))
    line = evaluate(
        spark, "Ann Lee, Bob, X Ann Leeds", lambda t: tx.bold_authors(t, F.lit(match), watched)
    )
    if match == "author":
        expected = expected.replace("X Ann Leeds", "<b>X Ann Leeds</b>")
    assert line == expected


def test_render_entry(spark):
    row = spark.createDataFrame(
        [("A compiler", "Bo, Ann Lee", "x Abstract: the compiler", "http://l")],
        "title string, author string, summary string, link string",
    )
    words = tx.word_forms(F.array(F.lit("compiler")))
    html, plain = row.select(
        tx.render_entry_html("title", "author", "summary", "link", F.lit("author"), words, F.array(F.lit("Ann Lee"))),
        tx.render_entry_text("title", "author", "summary"),
    ).first()
    assert html == (
        '<div><p style="color:blue;font-size:1.17em;"><b><a href="http://l">A '
        '<span style="color:darkblue">compiler</span></a></b></p>'
        "<p><i>Bo , <b>Ann Lee</b> <i></p><br><p> the <b>compiler</b></p><br><br></div>"
    )
    assert plain == "A compiler\n \tBo, Ann Lee\n \n the compiler\n \n"


def test_render_pair(spark):
    row = spark.range(1).select(
        tx.render_pair_html(*(F.lit(c) for c in ("t1 100%", "s1", "l1", "t2", "s2", "l2"))),
        tx.render_pair_text(*(F.lit(c) for c in ("t1", "s1", "t2", "s2"))),
    )
    html, plain = row.first()
    assert '<h2><a href="l1">t1 100%</a></h2>' in html
    assert '<h2><a href="l2" style="color: #888888;">t2</a></h2>' in html
    assert html.startswith('\n      <table style="width: 100%; border-collapse: collapse;">\n')
    assert html.endswith("      </table>\n    ")
    assert plain == "t1\ns1\nt2\ns2"


def test_render_journal(spark):
    rows = spark.createDataFrame([(1, "A<b", "S"), (2, "C", "")], "n int, title string, summary string")
    found = rows.orderBy("n").select(
        tx.render_journal_html("title", F.lit("d"), F.lit("l"), "summary"),
        tx.render_journal_text("title", F.lit("d"), F.lit("l"), "summary"),
    ).collect()
    assert found[0][0] == (
        "\n<li><strong>A&lt;b</strong><br>\n<em>d</em><br>\n<a href='l'>l</a><br>\n<p>S</p>\n</li><br>"
    )
    assert found[1][0] == "\n<li><strong>C</strong><br>\n<em>d</em><br>\n<a href='l'>l</a><br>\n</li><br>"
    assert fmt.JOURNAL_PLAIN_HEADER + found[0][1] + found[1][1] == "\n".join(
        ["New JMLR Publications:\n", "A<b\nd\nl\n", "S\n", "\n", "C\nd\nl\n", "\n"]
    )


def test_labels(spark):
    rows = spark.createDataFrame([("author",), ("title",), ("summary",), ("",), ("other",)], "t string")
    codes = rows.select(tx.text_to_match("t").alias("c"))
    assert [r[0] for r in codes.collect()] == [1, 2, 3, 4, 4]
    assert [r[0] for r in codes.select(tx.match_to_text("c")).collect()] == ["author", "title", "summary", "", ""]


def test_sentences(spark):
    text = "One two. Three?! \n . four"
    assert evaluate(spark, text, tx.sentence_split) == ["One two.", "Three?!", ".", "four"]
    assert evaluate(spark, "  \n ", tx.sentence_split) == []


PAGES = [
    "<p>a &amp; b</p><p>c</p>",
    "<html><head><style>p{}</style><script>var t='</p>';</script></head><body>x<!-- no -->y\nz</body></html>",
    "plain, 1 < 2 and 3 > 2",
    "<br/>&lt;tag&gt; &quot;q&quot; &#x27;",
    "",
]


@pytest.mark.parametrize("page", PAGES)
def test_html_modes_agree(spark, page):
    exact = evaluate(spark, page, hm.html_to_text)
    assert exact == evaluate(spark, page, hm.html_to_text_sql)
    assert "\n" not in exact


def test_html_exact(spark):
    assert evaluate(spark, "<p>&eacute;t&eacute; <b>open", hm.html_to_text) == "été open"
    assert evaluate(spark, PAGES[1], hm.html_to_text) == "xy z"
    assert evaluate(spark, None, hm.html_to_text) is None
