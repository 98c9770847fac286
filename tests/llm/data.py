"""Small documents with every awkward case: nulls, blanks, repeats, ties, long texts, clashing names."""

from __future__ import annotations

import random

from pyspark.sql import DataFrame, SparkSession

SCHEMA = (
    "doc_id bigint, text string, lang string, source string, n_chars bigint, fp string, row int, c0 double, "
    "FW_ROW string, `a.b` int"
)


def prose(n: int, seed: int) -> str:
    rng = random.Random(seed)
    return " ".join("".join(rng.choice("aeioubdlnrst") for _ in range(rng.randint(2, 7))) for _ in range(n))


def rows() -> list[tuple]:
    shared = prose(70, 99)
    texts = [
        (0, "The Cat sat on the mat and looked at the Dog.\nYes.\nYes.\n\n # ok", "a"),
        (1, None, "a"),
        (2, "", None),
        (3, " \t\n ", "b"),
        (4, prose(60, 1) + " " + shared + " " + prose(40, 2), "b"),
        (5, shared + "\n" + prose(80, 3), "b"),
        (6, prose(30, 4) + "  " + shared, "é"),
        (7, prose(30, 4) + "  " + shared, "é"),
        (7, prose(30, 4) + "  " + shared, "é"),
        (7, prose(25, 5), None),
        (None, prose(90, 6) + " " + shared, "b"),
        (None, prose(90, 6) + " " + shared, None),
        (8, "same words again and again here now " * 40, "a"),
        (9, prose(4000, 7), "a"),
        (10, "x" * 5000 + " " + "日本語 ⁇ 🙂 \x1f   naïve" * 3, "zz"),
        (11, (prose(200, 8) + "\n") * 3, ""),
        (-5, "THE cat SAT on the mat AND looked at the dog.\nyes.\nYES.\n\n # ok", "a"),
        (12, "one", "a"),
        (13, "one two three", "a"),
    ]
    return [(i, t, "en", s, None if t is None else len(t), "f", 1, 0.5, "w", None) for i, t, s in texts]


def documents(spark: SparkSession, some: list[tuple] | None = None) -> DataFrame:
    return spark.createDataFrame(rows() if some is None else some, SCHEMA).repartition(3)


def plain(own: list[tuple]) -> list[tuple]:
    """What the brute-force versions take."""
    return [(r[0], r[1], r[3]) for r in own]


def ordered(found) -> list[tuple]:
    return sorted((tuple(r) for r in found), key=lambda r: tuple((x is None, x if x is not None else 0) for x in r))
