"""Text of an HTML fragment, in two modes with one contract.

Text nodes are concatenated without separator; comments, declarations, and the contents of script,
style and template elements are dropped; newlines become spaces.
"""

from __future__ import annotations

from html.parser import HTMLParser

import pyarrow as pa
from pyspark.sql import Column
from pyspark.sql import functions as F
from pyspark.sql import types as T

from feedwatch.functions.text import StrCol, as_col, newline_to_space

HIDDEN = ("script", "style", "template")

# Fixed value: markup of the SQL mode, as one expression and so one pass (RE2- and Java-safe).
MARKUP_PATTERN = (
    r"(?is)<!--.*?-->"
    r"|<script\b[^>]*>.*?</script\s*>"
    r"|<style\b[^>]*>.*?</style\s*>"
    r"|<template\b[^>]*>.*?</template\s*>"
    r"|<[!?][^>]*>"
    r"|</?[a-z][^>]*>"
)
# Entities the SQL mode decodes, as patterns (some are valid without the semicolon and
# start no longer name); the ampersand has to come last.
ENTITIES = [
    ("&lt;", "<"),
    ("&gt;", ">"),
    ("&quot;?", '"'),
    ("&#x27;", "'"),
    ("&#39;", "'"),
    ("&apos;", "'"),
    ("&nbsp;?", " "),
    ("&copy;", "©"),
    ("&mdash;", "—"),
    ("&hellip;", "…"),
    ("&middot;?", "·"),
    ("&amp;?", "&"),
]


class _TextNodes(HTMLParser):
    def __init__(self) -> None:
        super().__init__(convert_charrefs=True)
        self.pieces: list[str] = []
        self.hidden = 0

    def handle_starttag(self, tag, attrs):
        self.hidden += tag in HIDDEN

    def handle_endtag(self, tag):
        if tag in HIDDEN and self.hidden:
            self.hidden -= 1

    def handle_data(self, data):
        if not self.hidden:
            self.pieces.append(data)


def text_of(html: str) -> str:
    parser = _TextNodes()
    parser.feed(html)
    parser.close()
    return "".join(parser.pieces).replace("\n", " ")


@F.arrow_udf(T.StringType())
def _parsed_text(html: pa.Array) -> pa.Array:
    return pa.array([None if v is None else text_of(v) for v in html.to_pylist()], pa.string())


def html_to_text(html: StrCol) -> Column:
    """Exact mode: a real HTML parser over Arrow batches, with every entity and unclosed tag."""
    return _parsed_text(as_col(html))


def html_to_text_sql(html: StrCol) -> Column:
    """JVM mode: patterns and the common entities; equal to the exact mode on well-formed pages."""
    bare = F.regexp_replace(as_col(html), MARKUP_PATTERN, "")
    text = bare
    for entity, char in ENTITIES:
        if entity.endswith("?"):
            text = F.regexp_replace(text, entity, char)
        else:
            text = F.replace(text, F.lit(entity), F.lit(char))
    return newline_to_space(F.when(F.contains(bare, F.lit("&")), text).otherwise(bare))
