"""Explicit schemas of every input, state table and output (nothing is inferred)."""

from __future__ import annotations

from pyspark.sql import types as T

TEXT, LONG, INT, DAY = T.StringType(), T.LongType(), T.IntegerType(), T.DateType()
TIME, BYTES = T.TimestampType(), T.BinaryType()
TEXTS = T.ArrayType(TEXT)


def struct(**fields: T.DataType) -> T.StructType:
    return T.StructType([T.StructField(name, kind) for name, kind in fields.items()])


# One feed item as found in a landed file.
FEED_ITEM = struct(id=TEXT, title=TEXT, author=TEXT, summary=TEXT, link=TEXT, published=TEXT)
# ``pos`` is the item's place in its feed.
ENTRY_BODY = struct(
    pos=LONG, id=TEXT, title=TEXT, author=TEXT, summary=TEXT, link=TEXT, published=TEXT
)
ENTRY = T.StructType([T.StructField("site", TEXT), *ENTRY_BODY.fields])
ENTRY_FIELDS = ENTRY_BODY.fieldNames()

WATCH_RULE = struct(arxivSite=TEXT, authors=TEXTS, words=TEXTS)
WATCH = struct(rule_pos=LONG, site=TEXT, authors=TEXTS, words=TEXTS)

SIMILARITY_CONFIG = struct(
    settings=struct(
        num_similar_sentences=INT,
        title_similarity_threshold=T.DoubleType(),
        sentence_similarity_threshold=T.DoubleType(),
        and_conditional=T.BooleanType(),
    ),
    similarity_searches=T.ArrayType(struct(arxivSite=TEXT, papers=TEXTS)),
)
PAPER_FILE = struct(triplet_id=TEXT, title=TEXT, abstract=TEXT)

SEEN_LINK = struct(link=TEXT)
LANDED = struct(snapshot=TEXT)
# ``links`` is the version whose links are current; a snapshot without news keeps the one before.
SEEN_LOG = struct(version=LONG, snapshot=TEXT, links=LONG)
SAVED_MATCH = struct(
    rule_pos=LONG, site=TEXT, match=TEXT, entry=ENTRY_BODY, append_date=DAY, week=DAY
)
# The commit of one append: what the attempt of a run holds, by slice; one row of nulls if nothing.
SLICES = struct(run_id=TEXT, attempt=TEXT, site=TEXT, week=DAY, append_date=DAY, n=LONG, file=TEXT)
# What a flush has sent; the row without a site says that the flush is complete.
FLUSHES = struct(flush_date=DAY, flush_run=TEXT, site=TEXT, run_id=TEXT, append_date=DAY)
DIGEST = struct(
    run_date=DAY,
    config_pos=LONG,
    site=TEXT,
    kind=TEXT,
    part=LONG,
    n_parts=LONG,
    subject=TEXT,
    html=TEXT,
    plain=TEXT,
    n_entries=LONG,
)

# One bulk-metadata record as it stands in the XML, and the page that carries many of them.
_LEAVES = ["id", "submitter", "authors", "title", "comments", "journal-ref", "doi", "abstract",
           "report-no"]
RAW_RECORD = struct(
    **{name: TEXT for name in _LEAVES},
    categories=TEXTS,
    version=T.ArrayType(struct(_version=TEXT, date=TEXTS)),
)
RECORD_PAGE = struct(
    error=struct(_VALUE=TEXT),
    ListRecords=struct(
        record=T.ArrayType(struct(metadata=struct(arXivRaw=RAW_RECORD))),
        resumptionToken=struct(_VALUE=TEXT),
    ),
)
