"""One registered query for each operator: the operator over its whole table, with digest columns."""

from __future__ import annotations

from collections.abc import Callable

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from feedwatch.llm import align, ann, host_rules, lattice_lm, minhash, mixing, pieces, quality, runs, simhash, substring, token_store, toxicity
from feedwatch.llm.tables import WORD, let

Query = Callable[[SparkSession, str], DataFrame]


def _table(spark: SparkSession, sf_dir: str, name: str) -> DataFrame:
    return spark.read.parquet(f"{sf_dir}/{name}.parquet")


def public_file(name: str) -> str:
    """A vocabulary file of the box; operators take any path."""
    import public_tokenizers

    return public_tokenizers.path(name)


def op1_token_store(spark: SparkSession, sf_dir: str) -> DataFrame:
    store = token_store.write_store(_table(spark, sf_dir, "documents"), public_file("byte_bpe_50k.json"))
    found = token_store.read_ids(store, store.rows.select("doc_id", "copy"), digest=True)
    return found.select("doc_id", "start", "n_tokens", F.col("ids").alias("ids_crc32"), "copy")


def op2_simhash(spark: SparkSession, sf_dir: str) -> DataFrame:
    return simhash.simhash_components(_table(spark, sf_dir, "documents"))


def op3_host_rules(spark: SparkSession, sf_dir: str) -> DataFrame:
    judged = host_rules.judge(_table(spark, sf_dir, "documents"), carry=["doc_id"])
    names = [*host_rules.MEASURES, "base_failed", "kept"]
    return judged.select("doc_id", *[F.col("fw_rules")[x].alias(x) for x in names])


def op4_quality(spark: SparkSession, sf_dir: str) -> DataFrame:
    return quality.quality(_table(spark, sf_dir, "documents"), _table(spark, sf_dir, "labels"))


def op5_lattice_lm(spark: SparkSession, sf_dir: str) -> DataFrame:
    model = pieces.load_model(public_file("piece_bpe_32k.model"))
    return lattice_lm.lattice_scores(_table(spark, sf_dir, "documents"), model)


def op6_toxicity(spark: SparkSession, sf_dir: str) -> DataFrame:
    return toxicity.toxicity(_table(spark, sf_dir, "documents"), _table(spark, sf_dir, "labels"))


def op7_substring(spark: SparkSession, sf_dir: str) -> DataFrame:
    return substring.repeated_words(_table(spark, sf_dir, "documents"))


def op8_mixing(spark: SparkSession, sf_dir: str) -> DataFrame:
    plan = mixing.mix_plan(_table(spark, sf_dir, "documents"))
    return plan.select(
        F.col("id").alias("doc_id"), "size", "source_size", "target", (F.col("repeats") * F.col("size")).alias("taken")
    )


def op9_pieces(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Ids of every whole text as count and CRC-32, and whether decoding them gives the text again."""
    model = pieces.load_model(public_file("piece_bpe_32k.model"))
    return pieces.round_trip(_table(spark, sf_dir, "documents"), model)


def op10_nn_descent(spark: SparkSession, sf_dir: str) -> DataFrame:
    return ann.nearest(_table(spark, sf_dir, "embeddings"))


def op11_minhash(spark: SparkSession, sf_dir: str) -> DataFrame:
    return minhash.minhash_components(_table(spark, sf_dir, "documents"))


def _planted(docs: DataFrame) -> DataFrame:
    """doc_id and text, with the contract's repetitions put into every tenth document or so."""
    h = F.crc32(F.col("doc_id").cast("string").cast("binary"))
    g = F.floor(h / 10).cast("bigint")

    def periodic(words):
        n = F.size(words).cast("bigint")
        a = g % n
        p = 1 + F.floor((n - a) / (3 + g % 8))
        place = lambda i: F.when(i < a, i).otherwise(a + (i - a) % p)
        spread = F.transform(F.sequence(F.lit(0).cast("bigint"), n - 1), lambda i: F.get(words, place(i).cast("int")))
        return F.when(n > 0, F.array_join(spread, " ")).otherwise("")

    words = F.regexp_extract_all(F.coalesce("text", F.lit("")), F.lit(WORD), F.lit(0))
    return docs.select("doc_id", F.when(h % 10 == 0, let(words, periodic)).otherwise(F.col("text")).alias("text"))


def op12_runs(spark: SparkSession, sf_dir: str) -> DataFrame:
    found = runs.find_runs(_planted(_table(spark, sf_dir, "documents")))
    kind = "struct<start: bigint, length: bigint, period: bigint>"
    best = F.reduce(
        "runs",
        F.lit(None).cast(kind),
        lambda old, new: F.when(old.isNull() | (new["length"] * old["period"] > old["length"] * new["period"]), new).otherwise(old),
    )
    lines = F.transform("runs", lambda r: F.concat(F.concat_ws(",", r["start"], r["length"], r["period"]), F.lit("\n")))
    found = found.select("doc_id", "n_words", "collapsed", F.size("runs").cast("bigint").alias("n_runs"), best.alias("best"), lines.alias("lines"))
    return found.select(
        "doc_id",
        "n_words",
        "n_runs",
        F.col("best.start").alias("start"),
        F.col("best.length").alias("length"),
        F.col("best.period").alias("period"),
        F.expr("1000 * best.length div best.period").alias("exponent_milli"),
        F.sha2(F.array_join("lines", ""), 256).alias("runs_sha256"),
        F.sha2("collapsed", 256).alias("collapsed_sha256"),
    )


def op13_alignment(spark: SparkSession, sf_dir: str) -> DataFrame:
    docs = _table(spark, sf_dir, "documents").select("doc_id", "text")
    found = align.align_tokenizers(docs, public_file("byte_bpe_50k.json"), public_file("piece_bpe_32k.model"), digest=True)
    return found.drop("text").withColumnRenamed("groups", "groups_sha256")


QUERIES: dict[str, Query] = {
    f.__name__: f
    for f in (
        op1_token_store,
        op2_simhash,
        op3_host_rules,
        op4_quality,
        op5_lattice_lm,
        op6_toxicity,
        op7_substring,
        op8_mixing,
        op9_pieces,
        op10_nn_descent,
        op11_minhash,
        op12_runs,
        op13_alignment,
    )
}

# Words of every document in DuckDB, numbered from 1; a document without words has no row here.
_WORDS = r"""
listed AS (SELECT doc_id, text, source, regexp_extract_all(coalesce(text, ''), '[^\x20\x09-\x0D]+') AS ws FROM documents),
numbered AS (SELECT doc_id, unnest(ws) AS w, generate_subscripts(ws, 1) AS i FROM listed)"""


def _windows(width: int) -> str:
    """Each word with the window that starts there (null near the end)."""
    ahead = f"OVER (PARTITION BY doc_id ORDER BY i ROWS BETWEEN CURRENT ROW AND {width - 1} FOLLOWING)"
    return f"""
windows AS (SELECT doc_id, i, w, CASE WHEN count(*) {ahead} = {width} THEN string_agg(w, ' ') {ahead} END AS win FROM numbered)"""


def _marked(width: int, starts: str) -> str:
    """Each word and whether a window that ``starts`` covers it."""
    return f"""
started AS (SELECT doc_id, i, w, coalesce(win IS NOT NULL AND {starts}, FALSE) AS s FROM windows),
marked AS (SELECT doc_id, i, w, bool_or(s) OVER (PARTITION BY doc_id ORDER BY i ROWS BETWEEN {width - 1} PRECEDING AND CURRENT ROW) AS c
           FROM started)"""


_OP3 = f"""
WITH {_WORDS}, {_windows(host_rules.WINDOW)}, {_marked(host_rules.WINDOW, "count(*) OVER (PARTITION BY doc_id, win) > 1")},
repeated AS (SELECT doc_id, count(*) FILTER (WHERE c) AS n FROM marked GROUP BY doc_id),
lines AS (SELECT doc_id, unnest(string_split(coalesce(text, ''), chr(10))) AS line FROM documents),
dup AS (SELECT doc_id, count(*) - count(DISTINCT line) AS n FROM lines
        WHERE regexp_matches(line, '[^\\x20\\x09-\\x0D]') GROUP BY doc_id),
base AS (
  SELECT l.doc_id, l.source, len(l.ws)::BIGINT AS n_words, length(array_to_string(l.ws, ''))::BIGINT AS word_chars,
         len(regexp_extract_all(coalesce(l.text, ''), '[#*$%&|<>]'))::BIGINT AS n_symbols,
         coalesce(d.n, 0)::BIGINT AS n_dup_lines, coalesce(r.n, 0)::BIGINT AS n_repeat_words
  FROM listed l LEFT JOIN dup d USING (doc_id) LEFT JOIN repeated r USING (doc_id)),
failing AS (SELECT *, n_words < {host_rules.MIN_WORDS} OR 100 * n_repeat_words > {host_rules.MAX_REPEAT_PERCENT} * n_words AS base_failed
            FROM base),
hosts AS (SELECT source, count(*)::DOUBLE AS n, count(*) FILTER (WHERE base_failed)::DOUBLE AS f FROM failing GROUP BY source),
sums AS (SELECT count(*) AS k, sum(n) AS n, sum(f) AS f, sum(n * n) AS nn, sum(f * f / n) AS ff FROM hosts),
moments AS (
  SELECT *, f / n AS mean, f / n * (1 - f / n) AS spread,
         CASE WHEN k > 1 THEN (ff - f * (f / n) - (k - 1) * (f / n * (1 - f / n))) / (n - nn / n) END AS excess FROM sums),
prior AS (
  SELECT *, CASE WHEN k > 1 AND spread > 0 AND excess > 0
                 THEN least(greatest(spread / excess - 1, {host_rules.PRIOR_STRENGTH[0]}), {host_rules.PRIOR_STRENGTH[1]})
                 ELSE {host_rules.PRIOR_STRENGTH[1]} END AS strength FROM moments),
verdicts AS (
  SELECT h.source, (h.f + strength * (p.f + 0.5) / (p.n + 1))
    / (h.n + strength * (p.f + 0.5) / (p.n + 1) + strength * (p.n - p.f + 0.5) / (p.n + 1)) > {host_rules.HOST_LIMIT} AS rejected
  FROM hosts h, prior p)
SELECT doc_id, n_words, word_chars, n_symbols, n_dup_lines, n_repeat_words, base_failed, NOT base_failed AND NOT rejected AS kept
FROM failing f JOIN verdicts v ON f.source IS NOT DISTINCT FROM v.source"""

_OP7 = f"""
WITH {_WORDS}, {_windows(substring.WIDTH)}, {_marked(substring.WIDTH, "min(doc_id) OVER (PARTITION BY win) < doc_id")},
found AS (SELECT doc_id, count(*) AS n, count(*) FILTER (WHERE c) AS gone, string_agg(w, ' ' ORDER BY i) FILTER (WHERE NOT c) AS kept
          FROM marked GROUP BY doc_id)
SELECT d.doc_id, coalesce(f.n, 0)::BIGINT AS n_words, coalesce(f.gone, 0)::BIGINT AS n_removed, sha256(coalesce(f.kept, '')) AS kept_sha256
FROM documents d LEFT JOIN found f USING (doc_id)"""

# Water-filling in closed form: sources in the order of bound by weight, clamped until the rest's level fits.
_OP8 = f"""
WITH sized AS (
  SELECT doc_id, source, len(regexp_extract_all(coalesce(text, ''), '[^\\x20\\x09-\\x0D]+'))::BIGINT AS size FROM documents),
sources AS (
  SELECT source, sum(size)::BIGINT AS source_size,
         list_extract({list(map(float, mixing.WEIGHTS))}, ((row_number() OVER (ORDER BY source NULLS LAST) - 1) % {len(mixing.WEIGHTS)} + 1)::INT) AS weight
  FROM sized GROUP BY source),
bounds AS (SELECT *, {mixing.MAX_EPOCHS}.0::DOUBLE * source_size AS bound FROM sources),
ranked AS (
  SELECT *, row_number() OVER r AS k, coalesce(sum(bound) OVER (r ROWS BETWEEN UNBOUNDED PRECEDING AND 1 PRECEDING), 0) AS given,
         sum(weight) OVER (r ROWS BETWEEN CURRENT ROW AND UNBOUNDED FOLLOWING) AS open
  FROM bounds WINDOW r AS (ORDER BY bound / weight, source NULLS LAST)),
levels AS (SELECT *, ({mixing.BUDGET}::DOUBLE * (SELECT sum(source_size) FROM sources) - given) / open AS level FROM ranked),
level AS (SELECT level FROM levels WHERE level < bound / weight ORDER BY k LIMIT 1),
targets AS (SELECT source, source_size, least(bound, weight * (SELECT level FROM level)) AS target FROM bounds),
keyed AS (
  SELECT s.doc_id, s.size, t.source_size, t.target, floor(t.target / t.source_size)::BIGINT AS whole,
         t.target - floor(t.target / t.source_size) * t.source_size AS rest,
         sum(s.size) OVER (PARTITION BY s.source ORDER BY md5('{mixing.SEED}:' || s.doc_id)) - s.size / 2.0::DOUBLE AS middle
  FROM sized s JOIN targets t ON s.source IS NOT DISTINCT FROM t.source)
SELECT doc_id, size, source_size, target, ((whole + CASE WHEN middle <= rest AND rest > 0 THEN 1 ELSE 0 END) * size)::BIGINT AS taken FROM keyed"""

ORACLES: dict[str, str] = {"op3_host_rules": _OP3, "op7_substring": _OP7, "op8_mixing": _OP8}
