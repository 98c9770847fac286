"""Quality rules on documents and on their hosts, in DataFrame expressions only.

Each document is measured by itself (words, symbols, repeated lines, repeated eight-word windows) and
fails its base rules or not.  Failures are then summed by host, each host's failure rate is shrunk
towards that of all hosts by a beta prior fitted to the hosts themselves, and the host's verdict is
joined back to its documents: what passes its own rules still goes if its host fails as a rule.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from feedwatch.llm.tables import BLANKS, col, fresh, let, scalar, written
from feedwatch.operators.joins import BROADCAST_BYTES, SALTS

MEASURES = ("n_words", "word_chars", "n_symbols", "n_dup_lines", "n_repeat_words")
MIN_WORDS = 20
MAX_REPEAT_PERCENT = 30
WINDOW = 8
HOST_LIMIT = 0.6  # a host whose shrunk failure rate is above this is rejected
PRIOR_STRENGTH = (1.0, 1000.0)  # bounds of the prior's weight, in documents


def words_of(text: Column) -> Column:
    """The words of a text as an array; null and blank texts have none."""
    trimmed = F.btrim(F.coalesce(text, F.lit("")), F.lit(BLANKS))
    return F.when(trimmed == "", F.array().cast("array<string>")).otherwise(F.split(trimmed, r"[\x20\x09-\x0D]+"))


def _covered(starts: Column) -> Column:
    """Words covered by windows at these sorted places."""
    steps = F.transform(
        starts,
        lambda p, i: F.least(F.lit(WINDOW), F.coalesce(F.get(starts, i + 1) - p, F.lit(WINDOW))),
    )
    return F.aggregate(steps, F.lit(0).cast("bigint"), lambda total, s: total + s)


def _repeated_starts(hashes: Column) -> Column:
    """Places of the windows whose hash occurs twice or more, in order."""
    ordered = F.sort_array(F.transform(hashes, lambda h, i: F.struct(h.alias("h"), i.alias("i"))))

    def pick(rows: Column) -> Column:
        def same(k: Column) -> Column:
            here = F.get(rows, k)["h"]
            return (F.get(rows, k - 1)["h"] == here) | (F.get(rows, k + 1)["h"] == here)

        places = F.transform(rows, lambda r, k: F.when(F.coalesce(same(k), F.lit(False)), r["i"]))
        return F.sort_array(F.filter(places, lambda p: p.isNotNull()))

    return let(ordered, pick)


def _repeat_words(words: Column) -> Column:
    """Words in windows that occur twice or more in the text, the first occurrence included."""
    none = F.lit(0).cast("bigint")
    hashes = F.transform(
        F.sequence(F.lit(1), F.size(words) - (WINDOW - 1)), lambda i: F.xxhash64(F.slice(words, i, WINDOW))
    )
    counted = let(
        hashes,
        lambda h: F.when(F.size(F.array_distinct(h)) == F.size(h), none).otherwise(
            let(_repeated_starts(h), _covered)
        ),
    )
    return F.when(F.size(words) > WINDOW, counted).otherwise(none)


def _dup_lines(text: Column) -> Column:
    """Lines with a word that are equal to an earlier line."""
    lines = F.filter(F.split(text, "\n"), lambda x: F.btrim(x, F.lit(BLANKS)) != "")
    return let(lines, lambda x: F.size(x) - F.size(F.array_distinct(x))).cast("bigint")


def base_measures(text: Column) -> Column:
    """A struct of n_words, word_chars, n_symbols, n_dup_lines and n_repeat_words (all long)."""
    filled = F.coalesce(text.cast("string"), F.lit(""))
    of_words = let(
        words_of(text.cast("string")),
        lambda w: F.struct(
            F.size(w).cast("bigint").alias("n_words"),
            F.length(F.array_join(w, "")).cast("bigint").alias("word_chars"),
            _repeat_words(w).alias("n_repeat_words"),
        ),
    )
    return let(
        of_words,
        lambda m: F.struct(
            m["n_words"].alias("n_words"),
            m["word_chars"].alias("word_chars"),
            F.regexp_count(filled, F.lit(r"[#*$%&|<>]")).cast("bigint").alias("n_symbols"),
            F.when(F.contains(filled, F.lit("\n")), _dup_lines(filled)).otherwise(F.lit(0)).cast("bigint").alias("n_dup_lines"),
            m["n_repeat_words"].alias("n_repeat_words"),
        ),
    )


def base_failed(m: Column) -> Column:
    return (m["n_words"] < MIN_WORDS) | (100 * m["n_repeat_words"] > MAX_REPEAT_PERCENT * m["n_words"])


def beta_prior(hosts: DataFrame) -> tuple[float, float]:
    """Prior (a, b) by moments from rows (host, n, failed), each host weighted by its documents.

    With fewer than two hosts, or hosts that do not differ beyond chance, the prior is as strong as
    allowed; if they differ as much as possible, as weak as allowed.
    """
    row = scalar(
        hosts.agg(
            F.count("*").alias("k"),
            F.sum("n").alias("n"),
            F.sum("failed").alias("f"),
            F.sum(F.col("n") * F.col("n")).alias("nn"),
            F.sum(F.col("failed") * F.col("failed") / F.col("n")).alias("ff"),
        )
    )
    low, high = PRIOR_STRENGTH
    if not row["n"]:
        return 0.5 * low, 0.5 * low
    n, mean = float(row["n"]), row["f"] / row["n"]
    spread = mean * (1 - mean)
    strength = high
    if row["k"] > 1 and spread > 0:
        between = row["ff"] - row["f"] * mean  # sum of n_i (p_i - mean)^2
        scale = n - float(row["nn"]) / n
        excess = (between - (row["k"] - 1) * spread) / scale
        if excess > 0:
            strength = min(max(spread / excess - 1, low), high)
    # Half a failure and half a pass keep the prior off 0 and 1.
    return strength * (row["f"] + 0.5) / (n + 1), strength * (n - row["f"] + 0.5) / (n + 1)


def host_verdicts(measured: DataFrame, host: str, failed: str, limit: float = HOST_LIMIT) -> DataFrame:
    """Rows (host, n, failed, rate, rejected) for each host; a null host is a host of its own."""
    hosts = measured.groupBy(col(host).alias("host")).agg(
        F.count("*").alias("n"), F.sum(col(failed).cast("bigint")).alias("failed")
    )
    hosts = written(hosts, "hosts")
    a, b = beta_prior(hosts)
    rate = (F.col("failed") + F.lit(a)) / (F.col("n") + F.lit(a + b))
    return hosts.withColumn("rate", rate).withColumn("rejected", rate > limit)


def judge(
    docs: DataFrame,
    text: str = "text",
    host: str = "source",
    carry: list[str] | None = None,
    limit: float = HOST_LIMIT,
) -> DataFrame:
    """The columns ``carry`` (all by default) and the struct ``fw_rules``: the measures, base_failed,
    host_rate and kept, for every row of ``docs``.

    (The name is lengthened if a column is called so already; it is the last column.)  A null text
    has no words, and so fails.  Documents are measured once and written with their measures; only
    sums by host are shuffled.  Rejected hosts are joined by broadcast while they are proven small,
    else by host and salt, so that a host with a third of all documents is spread.
    """
    rules = fresh("fw_rules", docs.columns)
    m = fresh("fw_measures", docs.columns)
    bad = fresh("fw_failed", docs.columns)
    carry = docs.columns if carry is None else carry
    at = fresh("fw_at", docs.columns)
    held = docs.select(*map(col, carry), col(host).alias(at), base_measures(col(text)).alias(m))
    held = written(held.withColumn(bad, base_failed(col(m))), "measured")
    verdicts = written(host_verdicts(held, at, bad, limit), "verdicts")
    size = scalar(verdicts.agg(F.sum(F.coalesce(F.octet_length(F.col("host").cast("string")), F.lit(0)) + 40)))[0] or 0
    h, rate, gone, salt = (fresh(x, held.columns) for x in ("fw_host", "fw_rate", "fw_gone", "fw_salt"))
    verdicts = verdicts.select(F.col("host").alias(h), F.col("rate").alias(rate), F.col("rejected").alias(gone))
    same = F.col(at).eqNullSafe(F.col(h))
    if size <= BROADCAST_BYTES:
        joined = held.join(F.broadcast(verdicts), same, "left")
    else:
        spread = held.withColumn(salt, F.pmod(F.xxhash64(m), F.lit(SALTS)).cast("int"))
        other = fresh(salt + "_2", held.columns)
        copies = verdicts.withColumn(other, F.explode(F.sequence(F.lit(0), F.lit(SALTS - 1))))
        joined = spread.join(copies, same & (F.col(salt) == F.col(other)), "left")
    kept = ~col(bad) & ~F.coalesce(F.col(gone), F.lit(False))
    measures = [F.col(m)[x].alias(x) for x in MEASURES]
    verdict = F.struct(*measures, col(bad).alias("base_failed"), F.col(rate).alias("host_rate"), kept.alias("kept"))
    return joined.select(*map(col, carry), verdict.alias(rules))


def keep_good(docs: DataFrame, text: str = "text", host: str = "source") -> DataFrame:
    """The rows of ``docs`` that pass their own rules and their host's verdict."""
    judged = judge(docs, text, host)
    return judged.where(col(judged.columns[-1])["kept"]).select(*map(col, docs.columns))
