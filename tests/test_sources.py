from __future__ import annotations

import json

import pytest
from pyspark.sql import functions as F

from feedwatch.operators import records as rc
from feedwatch.plans.metadata import metadata_table
from feedwatch.plans.triplets import encode_papers, incomplete_triplets, triplet_eval
from feedwatch.sources import configs as cf
from feedwatch.sources import feeds as fd
from feedwatch.sources import pages as pg

JSON_RULES = [
    {"arxivSite": "cs", "authors": ["Ann Lee", "Bo"], "words": ["rtos"]},
    {"arxivSite": "gr-qc", "authors": None},
]
YAML_RULES = """
arxiv_sites:
  - arxivSite: "cs"
    authors:
      - "Ann Lee" # a comment
      - Bo
    words:

  - arxivSite: gr-qc
    words: [x, y]
"""


def test_watchlists(spark, tmp_path):
    (tmp_path / "w.json").write_text(json.dumps(JSON_RULES, indent=1))
    found = cf.read_watchlist(spark, str(tmp_path / "w.json")).orderBy("rule_pos").collect()
    assert [tuple(r) for r in found] == [
        (0, "cs", ["Ann Lee", "Bo"], ["rtos"]), (1, "gr-qc", None, None)
    ]
    (tmp_path / "w.yaml").write_text(YAML_RULES)
    found = cf.read_watchlist(spark, str(tmp_path / "w.yaml")).orderBy("rule_pos").collect()
    assert [tuple(r) for r in found] == [
        (0, "cs", ["Ann Lee", "Bo"], None), (1, "gr-qc", None, ["x", "y"])
    ]


def test_similarity_config(spark, tmp_path):
    config = {
        "settings": {"num_similar_sentences": 3, "title_similarity_threshold": 0.8,
                     "sentence_similarity_threshold": 0.7, "and_conditional": False},
        "similarity_searches": [
            {"arxivSite": "cs", "papers": ["http://x/abs/1.10", "http://x/abs/2"]},
            {"arxivSite": "cs", "papers": ["http://x/abs/3"]},
        ],
    }
    (tmp_path / "s.json").write_text(json.dumps(config, indent=1))
    read = cf.read_similarity_config(spark, str(tmp_path / "s.json"))
    settings = cf.similarity_settings(read)
    assert (settings.num_similar_sentences, settings.title_threshold, settings.use_and) == (3, 0.8, False)
    searches = cf.similarity_searches(read)
    found = [tuple(r) for r in searches.orderBy("target_pos").select("site", "search_pos", "target_pos", "paper_id").collect()]
    assert found == [("cs", 0, 0, "1.10"), ("cs", 0, 1, "2"), ("cs", 1, 2, "3")]
    corpus = spark.createDataFrame([("2", "T", "a\nb"), ("9", "U", "c")], "paper_id string, title string, summary string")
    assert [tuple(r) for r in cf.attach_targets(searches, corpus).select("paper_url", "title", "summary").collect()] == [
        ("http://x/abs/2", "T", "a b")
    ]
    assert [r.paper_id for r in cf.papers_by_id(corpus, searches).collect()] == ["2"]


FEED = """<?xml version="1.0"?>
<rss version="2.0"><channel><title>feed</title>
{items}
</channel></rss>"""
ITEM = """<item><id>{n}</id><title> T &amp; {n} </title><author>A, B</author><summary>line
two</summary><link>http://l/{n}</link></item>"""


def test_feed_files_keep_order_and_text(spark, tmp_path):
    for site, n in (("cs", 25), ("gr-qc", 3)):
        items = "\n".join(ITEM.format(n=k) for k in range(n))
        (tmp_path / f"{site}.xml").write_text(FEED.format(items=items))
    entries = fd.read_feed(spark, str(tmp_path))
    assert entries.schema.fieldNames()[0] == "site"
    found = {}
    for r in sorted(entries.collect(), key=lambda r: r.pos):
        found.setdefault(r.site, []).append(r)
    assert {s: [r.id for r in g] for s, g in found.items()} == {
        "cs": [str(k) for k in range(25)], "gr-qc": ["0", "1", "2"]
    }
    first = found["cs"][0]
    assert (first.title, first.summary, first.published) == (" T & 0 ", "line\ntwo", None)
    journal = fd.read_journal_feed(spark, str(tmp_path / "gr-qc.xml"))
    assert {r.site for r in journal.collect()} == {"journal"}


def test_feed_stream(spark, tmp_path):
    rows = [("cs", n, str(n), f"T{n}", None, None, None, None) for n in range(4)]
    from feedwatch.schemas import ENTRY

    fd.land_feed(spark.createDataFrame(rows, ENTRY), str(tmp_path / "landed"))
    stream = fd.stream_feed(spark, str(tmp_path / "landed"))
    query = (
        stream.writeStream.format("parquet").option("checkpointLocation", str(tmp_path / "cp"))
        .trigger(availableNow=True).start(str(tmp_path / "out"))
    )
    query.awaitTermination()
    found = spark.read.parquet(str(tmp_path / "out")).orderBy("pos").collect()
    assert [(r.site, r.pos, r.title) for r in found] == [("cs", n, f"T{n}") for n in range(4)]


RSS = """<?xml version="1.0"?>
<rss version="2.0" xmlns:dc="http://purl.org/dc/elements/1.1/"><channel><title>feed</title><link>http://x</link>
<item><title>One</title><dc:creator>A. B</dc:creator><dc:creator>C</dc:creator><description>d &lt;p&gt;</description>
<link>http://l/1</link><guid isPermaLink="true">http://g/1</guid><pubDate>Mon</pubDate></item>
<item><title>Two</title><guid>http://g/2</guid></item></channel></rss>"""
ATOM = """<feed xmlns="http://www.w3.org/2005/Atom"><title>f</title><entry><title type="text">Three</title>
<author><name>D</name></author><author><name>E</name></author><summary type="html">s</summary>
<link rel="self" href="http://self"/><link rel="alternate" href="http://l/3"/><id>3</id><updated>Tue</updated></entry></feed>"""


def test_delivered_feeds(spark, tmp_path):
    (tmp_path / "cs.xml").write_text(RSS)
    (tmp_path / "gr.xml").write_text(ATOM)
    found = {r.title: r for r in fd.read_feed(spark, str(tmp_path)).collect()}
    one, two, three = found["One"], found["Two"], found["Three"]
    assert tuple(one)[2:] == ("http://g/1", "One", "A. B, C", "d <p>", "http://l/1", "Mon") and one.site == "cs"
    assert tuple(two)[2:] == ("http://g/2", "Two", None, None, "http://g/2", None) and two.pos == one.pos + 1
    assert tuple(three)[2:] == ("3", "Three", "D, E", "s", "http://l/3", "Tue") and three.site == "gr"
    (tmp_path / "aa.xml").write_text(RSS)  # what else has landed changes no position
    again = {(r.site, r.title): r.pos for r in fd.read_feed(spark, str(tmp_path)).collect()}
    assert again["cs", "One"] == one.pos and again["gr", "Three"] == three.pos and len(set(again.values())) == 5


def test_pages_of_a_hot_site(spark, tmp_path):
    """Pages follow each other by number; batch and stream give the same positions, with one read of each file."""
    for page in (0, 1, 2, 10):
        folder = tmp_path / "feeds" / "site=hot" / f"page={page}"
        folder.mkdir(parents=True)
        items = "".join(ITEM.format(n=100 * page + k) for k in range(3))
        (folder / "p.txt").write_text(FEED.format(items=items))
    (tmp_path / "feeds" / "site=a%2Fb").mkdir()
    (tmp_path / "feeds" / "site=a%2Fb" / "x.xml").write_text(ATOM)
    batch = fd.read_feed(spark, str(tmp_path / "feeds"))
    hot = [r.id for r in batch.where("site = 'hot'").orderBy("pos").collect()]
    assert hot == [str(100 * p + k) for p in (0, 1, 2, 10) for k in range(3)]
    assert [r.site for r in batch.where("site <> 'hot'").collect()] == ["a/b"]
    plan = batch._jdf.queryExecution().executedPlan().toString()
    assert plan.count("FileScan") == 1 and "Exchange" not in plan and "Join" not in plan
    stream = fd.stream_feed(spark, str(tmp_path / "feeds"), max_files=2)
    query = (
        stream.writeStream.format("parquet").option("checkpointLocation", str(tmp_path / "cp"))
        .trigger(availableNow=True).start(str(tmp_path / "out"))
    )
    query.awaitTermination()
    streamed = spark.read.parquet(str(tmp_path / "out")).select(*batch.columns).collect()
    assert sorted(map(str, streamed)) == sorted(map(str, batch.collect()))


def test_files_come_in_pieces(spark, tmp_path):
    """Python gets bounded pieces of a file, cut anywhere, and not the file; what follows a broken file is read."""
    texts = [f"{n} " + "äé€😀" * (n * 37 % 5000) for n in range(90)]
    items = "".join(ITEM.format(n=n).replace("</title>", f" {t}</title>") for n, t in enumerate(texts))
    (tmp_path / "a.xml").write_text(FEED.format(items=items))
    (tmp_path / "b.xml").write_text(FEED.format(items=items).replace("</title>", "</titel>", 1))
    (tmp_path / "c.xml").write_text(RSS)
    cut = fd._pieces(fd._reader(spark.read).load(str(tmp_path)))
    most = cut.groupBy("path").agg(F.max(F.length("data")).alias("most"), F.sum(F.length("data")).alias("all"), F.count_if("last").alias("n"))
    found = {r.path.rpartition("/")[2]: (r.most, r["all"], r.n) for r in most.collect()}
    assert found["a.xml"] == (fd.PIECE_BYTES, (tmp_path / "a.xml").stat().st_size, 1) and found["a.xml"][1] > 10 * fd.PIECE_BYTES
    own = fd.read_feed(spark, str(tmp_path / "a.xml")).orderBy("pos").collect()
    assert [r.title for r in own] == [f" T & {n}  {t}" for n, t in enumerate(texts)]
    rest = fd.read_feed(spark, str(tmp_path), strict=False).groupBy("site").count().collect()
    assert {r["site"]: r["count"] for r in rest} == {"a": 90, "c": 2}


def test_spellings_of_feeds(spark, tmp_path):
    (tmp_path / "odd.xml").write_text(
        """<?xml version="1.0" encoding="iso-8859-1"?><a:feed xmlns:a="http://www.w3.org/2005/Atom"><a:entry>
<a:title type="xhtml"><div>caf\u00e9 <b>au</b> lait&nbsp;!</div></a:title><a:author>plain</a:author><a:content><![CDATA[<p>x</p>]]></a:content>
<a:link rel="alternate" href="u&amp;v"/><a:updated/></a:entry><entry><pos>7</pos><summary></summary></entry></a:feed>""",
        encoding="iso-8859-1",
    )
    one, two = fd.read_feed(spark, str(tmp_path)).orderBy(F.desc("pos")).collect()
    assert tuple(one)[2:] == ("u&v", "caf\u00e9 au lait\u00a0!", "plain", "<p>x</p>", "u&v", "")
    assert tuple(two) == ("odd", 7, None, None, None, "", None, None)


def test_broken_feed(spark, tmp_path):
    (tmp_path / "good.xml").write_text(RSS)
    (tmp_path / "bad.xml").write_text(RSS.replace("</description>", "</descr>", 1).replace("<item><title>One", ITEM.format(n=5) + "<item><title>One"))
    (tmp_path / "empty.xml").write_text("\n")
    with pytest.raises(Exception, match="bad.xml|empty.xml"):
        fd.read_feed(spark, str(tmp_path)).collect()
    with pytest.raises(Exception, match="bad.xml|empty.xml"):
        fd.read_feed(spark, str(tmp_path)).count()
    found = fd.read_feed(spark, str(tmp_path), strict=False).select("site", "id").collect()
    assert sorted(tuple(r) for r in found) == [("bad", "5"), ("good", "http://g/1"), ("good", "http://g/2")]
    assert sorted(r.error.rpartition("/")[2].partition(":")[0] for r in fd.feed_rejects(spark, str(tmp_path)).collect()) == ["bad.xml", "empty.xml"]


def test_triplet_files(spark, tmp_path):
    papers = {
        "anchor": {"title": "graph theory", "abstract": "Graphs are nice. Trees too."},
        "positive": {"title": "graph theory again", "abstract": "Graphs are nice."},
        "negative": {"title": "cooking", "abstract": "Salt the soup. Eat it."},
    }
    for role, paper in papers.items():
        (tmp_path / f"paper_{role}.json").write_text(json.dumps(paper, indent=1))
    read = cf.read_triplets(spark, str(tmp_path))
    assert {(r.triplet_id, r.role, r.title) for r in read.collect()} == {("0", k, p["title"]) for k, p in papers.items()}
    assert incomplete_triplets(read).count() == 0
    part = read.where("role <> 'negative'").unionByName(read.limit(1).withColumns({"triplet_id": F.lit("x"), "role": F.lit("other")}))
    assert {(r.triplet_id, *r.roles) for r in incomplete_triplets(part).collect()} == {("0", "anchor", "positive"), ("x",)}
    scores = triplet_eval(encode_papers(read), num_similar=2).first()
    assert scores.title_positive > scores.title_negative
    # one of two anchor sentences is found again; the sum is over the constant 2
    assert 0.5 <= scores.score_positive < 1 and scores.margin > 0


PAGE = """<?xml version="1.0"?>
<OAI-PMH xmlns="http://www.openarchives.org/OAI/2.0/"><ListRecords>
<record><header/><metadata><arXivRaw xmlns="http://arxiv.org/OAI/arXivRaw/"><id>2111.00390</id>
<title> A
 title </title><categories>cs.LG math.OC</categories><journal-ref>J 1</journal-ref>
<version version="v1"><date>Mon</date><size>1</size></version><version version="v2"/></arXivRaw></metadata></record>
<record><header status="deleted"/></record>
<resumptionToken cursor="0">tok|1001</resumptionToken></ListRecords></OAI-PMH>"""
ERROR = '<OAI-PMH xmlns="http://www.openarchives.org/OAI/2.0/"><error code="badVerb">Illegal verb</error></OAI-PMH>'


@pytest.fixture
def page_files(spark, tmp_path):
    (tmp_path / "a.xml").write_text(PAGE)
    (tmp_path / "b.xml").write_text(ERROR)
    return str(tmp_path)


def test_record_pages(spark, page_files):
    parsed = rc.parse_pages(pg.read_pages(spark, page_files))
    assert [(r.page_id, r.error) for r in rc.page_errors(parsed).collect()] == [("b.xml", "Illegal verb")]
    tokens = {r.page_id: r.token for r in rc.page_tokens(parsed).collect()}
    assert tokens == {"a.xml": "tok|1001", "b.xml": ""}
    (record,) = rc.flatten_records(rc.page_records(parsed)).collect()
    assert record.id == "2111.00390" and record.title == " A\n title " and record.doi is None
    assert record["journal-ref"] == "J 1"
    assert (record.categories, record.versions, record.versions_dates) == (["cs.LG math.OC"], ["v1", "v2"], ["Mon"])
    (direct,) = rc.flatten_records(pg.read_records(spark, page_files)).collect()
    assert direct == record


def test_strict_mode_fails(spark, page_files):
    pages = pg.read_pages(spark, page_files)
    assert metadata_table(pages).count() == 1
    with pytest.raises(Exception, match="Illegal verb"):
        metadata_table(pages, strict=True).collect()


def test_version_history(spark):
    rows = spark.createDataFrame([("1", ["v1", "v2"], ["a", "b"])], "id string, versions array<string>, versions_dates array<string>")
    found = [tuple(r) for r in rc.version_history(rows).orderBy("version_pos").collect()]
    assert found == [("1", 0, "v1", "a", False), ("1", 1, "v2", "b", True)]


def test_site_names_survive_paths(spark, tmp_path):
    from feedwatch.schemas import ENTRY

    rows = [("a b/c", 0, "1", "T", None, None, None, None)]
    fd.land_feed(spark.createDataFrame(rows, ENTRY), str(tmp_path / "x"))
    found = fd.read_feed(spark, str(tmp_path / "x"), landed_pos=True).select(F.col("site")).collect()
    assert [r.site for r in found] == ["a b/c"]
    (tmp_path / "c++ x.xml").write_text(FEED.format(items=ITEM.format(n=1)))
    named = fd.read_feed(spark, str(tmp_path / "c++ x.xml"))
    assert [r.site for r in named.collect()] == ["c++ x"]


def test_delivered_pages_do_not_multiply_with_sites(spark, tmp_path):
    """Files are written, listed and opened one by one: their number follows the rows, not the rows times the sites."""
    from feedwatch.registry import sources as reg

    n, sites = 16_000, 20
    docs = spark.range(n).selectExpr(
        "id AS doc_id", "concat('title ', id, '\n', 'text <', id, '>') AS text", "'en' AS lang", f"concat('s', id % {sites}) AS source", "9L AS n_chars"
    )
    docs.coalesce(1).write.parquet(str(tmp_path / "documents.parquet"))
    reg._delivered(spark, str(tmp_path), str(tmp_path / "landed"))
    files = list((tmp_path / "landed").rglob("*.txt"))
    assert n // reg.PAGE_POSITIONS <= len(files) <= 2 * n // reg.PAGE_POSITIONS
    found = fd.read_feed(spark, str(tmp_path / "landed"))
    order = [int(r.id) for r in found.where("site = 's3'").orderBy("pos").collect()]
    assert order == list(range(3, n, sites)) and found.count() == n
