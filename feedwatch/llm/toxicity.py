"""Toxicity by a weighted lexicon, matched with Aho-Corasick on folded text.

Folding undoes disguises: compatibility forms, letters of other alphabets that look Latin, and digits and
signs put for letters; what then looks alike (i, l, 1) is one letter.  Lexicon entries are whole words
and beginnings of words; a word counts once, by its heaviest entry, unless it lies in an exception
phrase.  The score is a logistic function of the summed weights, as such and by length.

Entries, weights, exceptions and the logistic are learnt from a bounded sample of labelled rows of the
training fold (``labels.SAMPLE_ROWS``).  Null and empty texts score what a text without matches does.
"""

from __future__ import annotations

import re
import unicodedata
from collections import Counter
from collections.abc import Iterator
from dataclasses import dataclass, field

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from feedwatch.llm.labels import SAMPLE_ROWS, is_held_out, labelled_sample
from feedwatch.llm.tables import col, written
from feedwatch.llm.words import slices

# What stands for a Latin letter (each letter, then its look-alikes).
LOOKALIKES = {
    "a": "аαàâäåã@4", "b": "ьβ8", "c": "сϲ", "d": "ԁ", "e": "еεёëêè3€", "g": "ɡ9", "h": "һ", "i": "іιïîìlł1!|ӏ", "j": "ј",
    "k": "кκ", "m": "м", "n": "ո", "o": "оοöôòõø0", "p": "рρ", "q": "ԛ", "s": "ѕ5$", "t": "тτ7+", "u": "υùûüц", "v": "ν", "w": "ԝω",
    "x": "хχ", "y": "уγÿ", "z": "2",
}
SHORTEST, LONGEST = 4, 8  # letters of a word's beginning that may be an entry
MOST_ENTRIES = 5_000
LEAST_DOCS = 5  # toxic documents of the sample that an entry occurs in
LEAST_RATE = 0.75  # share of toxic ones among documents with an entry, classes weighed alike
EVIDENCE = 3.0  # log of how much rarer than chance an entry's share must be
EXCEPTION_DOCS = 3

_TABLE = {ord(x): a for a, others in LOOKALIKES.items() for x in others}
_TABLE |= {ord(x.upper()): a for a, others in LOOKALIKES.items() for x in others if len(x.upper()) == 1}
_WIDE = re.compile("[！-～\U0001d400-\U0001d7ff①-⓿℀-⅏]")
_HIDDEN = re.compile("[­​-‏⁠﻿]")
_SIGN = re.compile(r"[!|@$+€](?![^\W_])")  # a sign stands for a letter only before a letter or digit
_TOKEN = re.compile(r"[^\W_]+")


def fold_text(text: str | None) -> str:
    """Folded words, each with one blank before and after it."""
    if not text:
        return " "
    if not text.isascii():
        if _WIDE.search(text):
            text = unicodedata.normalize("NFKC", text)
        text = _HIDDEN.sub("", text)
    words = _TOKEN.findall(_SIGN.sub(" ", text.lower()).translate(_TABLE))
    return f" {' '.join(words)} " if words else " "


@dataclass
class Lexicon:
    """Entries begin with a blank; whole words end with one too."""

    weights: dict[str, float] = field(default_factory=dict)
    exceptions: list[str] = field(default_factory=list)
    slope: tuple[float, float, float] = (-4.0, 0.0, 0.0)  # intercept, summed weights, weights by length

    def automaton(self):
        import ahocorasick

        found = ahocorasick.Automaton()
        for entry, weight in self.weights.items():
            found.add_word(entry, (len(entry), weight))
        for phrase in self.exceptions:
            found.add_word(phrase, (len(phrase), None))
        if len(found):
            found.make_automaton()
        return found


def matches(automaton, folded: str) -> dict[int, float]:
    """Weight of each matched word by its place, but for words within an exception phrase."""
    hits: dict[int, float] = {}
    spared: list[tuple[int, int]] = []
    if len(automaton):
        for end, (size, weight) in automaton.iter(folded):
            begin = end - size + 1
            if weight is None:
                spared.append((begin, end))
            elif weight > hits.get(begin, -np.inf):
                hits[begin] = weight
    if not spared or not hits:
        return hits
    # The furthest end of a phrase that begins at a place or before it tells whether the place lies within one.
    begins, ends = np.array(sorted(spared)).T
    reach = np.maximum.accumulate(ends)
    places = np.fromiter(hits, np.int64, len(hits))
    last = np.searchsorted(begins, places, "right") - 1
    free = (last < 0) | (reach[last] <= places)
    return {at: hits[at] for at in places[free].tolist()}


def features(automaton, folded: str) -> tuple[float, float]:
    """log(1 + summed weights), and log(1 + weights in a thousand words)."""
    total = sum(matches(automaton, folded).values())
    words = max(1, folded.count(" ") - 1)
    return float(np.log1p(total)), float(np.log1p(1000.0 * total / words))


def _entries(folded: str) -> set[str]:
    """Possible entries of a text: its words, and beginnings of longer ones."""
    out = set()
    for word in set(folded.split()):
        if len(word) > 2:
            out.add(f" {word} ")
        out.update(f" {word[:n]}" for n in range(SHORTEST, min(LONGEST, len(word) - 1) + 1))
    return out


def _phrases(folded: str, begins: list[int]) -> set[str]:
    """The matched words with the word before, and with the word after."""
    out = set()
    for at in begins:
        end = folded.index(" ", at + 1)
        after = folded.find(" ", end + 1)
        if at > 0:
            out.add(folded[folded.rindex(" ", 0, at) : end + 1])
        if after > 0:
            out.add(folded[at : after + 1])
    return out


def _counted(lexicon: Lexicon | None):
    """Batches of (id, text, label) to rows (entry, n, toxic): documents with it, by batch."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        automaton = None if lexicon is None else lexicon.automaton()
        for batch in batches:
            counts: tuple[Counter, Counter] = (Counter(), Counter())
            for text, label in zip(batch.column("text").to_pylist(), batch.column("label").to_pylist(), strict=True):
                folded = fold_text(text)
                counts[label].update(_entries(folded) if automaton is None else _phrases(folded, list(matches(automaton, folded))))
            names = list(counts[0].keys() | counts[1].keys())
            yield pa.RecordBatch.from_pydict(
                {
                    "entry": pa.array(names, pa.string()),
                    "clean": pa.array([counts[0][x] for x in names], pa.int64()),
                    "toxic": pa.array([counts[1][x] for x in names], pa.int64()),
                }
            )

    return run


def _logistic(x: np.ndarray, y: np.ndarray, rounds: int = 50) -> np.ndarray:
    """Coefficients (intercept first) by Newton steps with a small ridge."""
    x = np.column_stack([np.ones(len(x)), x])
    beta = np.zeros(x.shape[1])
    for _ in range(rounds):
        p = 1 / (1 + np.exp(-np.clip(x @ beta, -30, 30)))
        ridge = 0.1 * np.eye(x.shape[1])
        step = np.linalg.solve((x * (p * (1 - p))[:, None]).T @ x + ridge, x.T @ (y - p) - ridge @ beta)
        beta += step
        if np.abs(step).max() < 1e-9:
            break
    return beta


def learn(sample: DataFrame) -> Lexicon:
    """A lexicon from rows (text, label); the sample is bounded, and so is what reaches the driver."""
    sizes = {r["label"]: r["count"] for r in sample.groupBy("label").count().collect()}
    clean, toxic = sizes.get(0, 0), sizes.get(1, 0)
    if not clean or not toxic:
        return Lexicon(slope=(float(np.log((toxic + 0.5) / (clean + 0.5))), 0.0, 0.0))

    def counts(lexicon: Lexicon | None) -> DataFrame:
        rows = sample.mapInArrow(_counted(lexicon), "entry string, clean bigint, toxic bigint")
        return rows.groupBy("entry").agg(F.sum("clean").alias("clean"), F.sum("toxic").alias("toxic"))

    rate_t, rate_c = F.col("toxic") / F.lit(toxic), F.col("clean") / F.lit(clean)
    odds = F.log((F.col("toxic") + 0.5) / (F.lit(toxic) + 1.0)) - F.log((F.col("clean") + 0.5) / (F.lit(clean) + 1.0))
    entries = written(counts(None), "entries")
    found = entries.where((F.col("toxic") >= LEAST_DOCS) & (rate_t / (rate_t + rate_c) >= LEAST_RATE))
    # Chance alone gives some of many rare entries a high rate: the bound on the probability of such a
    # deviation from the classes' shares must be well below one in the number of entries.
    n, base = F.col("toxic") + F.col("clean"), toxic / (toxic + clean)
    surprise = F.col("toxic") * F.log(F.col("toxic") / n / base) + F.when(
        F.col("clean") > 0, F.col("clean") * F.log(F.col("clean") / n / (1 - base))
    ).otherwise(0.0)
    clear = surprise >= float(np.log(max(1, entries.count()))) + EVIDENCE
    best = found.where(clear).withColumn("odds", odds).orderBy(F.col("toxic").desc(), "entry").limit(MOST_ENTRIES)
    weights = {r["entry"]: float(r["odds"]) for r in best.collect()}
    lexicon = Lexicon(weights)
    spared = counts(lexicon).where((F.col("clean") >= EXCEPTION_DOCS) & (rate_t / (rate_t + rate_c) < 0.2))
    lexicon.exceptions = [r["entry"] for r in spared.orderBy(F.col("clean").desc(), "entry").limit(MOST_ENTRIES).collect()]
    rows = _featured(sample.select("label", "text"), lexicon).select("c0", "x", "y").toPandas()
    lexicon.slope = tuple(_logistic(rows[["x", "y"]].to_numpy(), rows["c0"].to_numpy(float)).tolist())
    return lexicon


def _featured(plain: DataFrame, lexicon: Lexicon) -> DataFrame:
    """Columns with the text last to (c0, ..., x, y)."""
    names = [f"c{i}" for i in range(len(plain.columns) - 1)]
    plain = plain.toDF(*names, "t")

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        automaton = lexicon.automaton()
        for whole in batches:
            for batch in slices(whole, "t", 4 << 20):
                found = [features(automaton, fold_text(t)) for t in batch.column(len(names)).to_pylist()]
                x, y = (pa.array([f[i] for f in found], pa.float64()) for i in (0, 1))
                yield pa.RecordBatch.from_arrays([*batch.columns[:-1], x, y], [*names, "x", "y"])

    return plain.mapInArrow(run, ", ".join([*[f"{n} {k}" for n, k in plain.dtypes[:-1]], "x double, y double"]))


def score(docs: DataFrame, lexicon: Lexicon, keep: list[str], text: str = "text") -> DataFrame:
    """The columns ``keep`` and ``score``, the probability that a text is toxic."""
    plain = docs.select(*[col(c) for c in keep], col(text).cast("string"))
    a, b, c = lexicon.slope
    logit = F.lit(a) + F.lit(b) * F.col("x") + F.lit(c) * F.col("y")
    names = [F.col(f"c{i}").alias(n) for i, n in enumerate(keep)]
    return _featured(plain, lexicon).select(*names, (1 / (1 + F.exp(-logit))).alias("score"))


def toxicity(docs: DataFrame, labels: DataFrame, rows: int = SAMPLE_ROWS) -> DataFrame:
    """doc_id, held_out, score and predicted for every row of ``docs``."""
    lexicon = learn(labelled_sample(docs, labels, "toxic", 5, 0, rows))
    found = score(docs, lexicon, ["doc_id"])
    return found.select(
        "doc_id", is_held_out(F.col("doc_id"), 5, 0).alias("held_out"), "score", (F.col("score") >= 0.5).cast("int").alias("predicted")
    )
