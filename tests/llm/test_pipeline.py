"""The pipeline against the same stages in plain Python."""

from __future__ import annotations

from collections import Counter

import numpy as np

import corpus_pipeline
from __spark_entry__ import queries
from feedwatch.llm import pieces
from feedwatch.llm.queries import public_file
from tests.llm import brute
from tests.llm.data import documents, rows

SF = "/root/testdata/sf0.001"


def expected_before_mix(own):
    kept = [r for r in own if not brute.rules(r[1])[-1]]  # no host of the table is rejected
    roots = brute.components([brute.fingerprint(t) for _, t, _ in kept])
    first = {}
    for r, root in zip(kept, roots, strict=True):
        first[root] = min(first.get(root, r), r)
    kept = sorted(first.values())
    out = []
    for (doc_id, text, source), (_, n, gone, _) in zip(kept, brute.substring(kept), strict=True):
        if gone == 0 or gone < n:
            out.append((doc_id, text, source, n - gone, gone))
    return out


def test_run(spark):
    own = [(r.doc_id, r.text, r.source) for r in spark.read.parquet(f"{SF}/documents.parquet").collect()]
    want = {r[0]: r for r in expected_before_mix(own)}
    found = queries()["pipeline"](spark, SF)
    assert found.columns == ["doc_id", "text", "lang", "source", "n_chars", "piece_ids"]
    found = found.collect()
    taken, sizes = Counter(), Counter()
    model = pieces.load_model(public_file("piece_bpe_32k.model"))
    for r in found:
        _, text, source, n, gone = want[r.doc_id]
        assert len(brute.words(r.text)) == n and r.n_chars == len(r.text) and (gone or r.text == text)
        assert model.decode(np.array(r.piece_ids)) == r.text
        taken[source] += n
    for _, _, source, n, _ in want.values():
        sizes[source] += n
    for source, target in brute.targets(dict(sizes)).items():
        longest = max(r[3] for r in want.values() if r[2] == source)
        assert abs(taken[source] - target) <= longest / 2 + 1e-6


def test_stages_take_anything(spark):
    for own in (rows(), []):
        docs = documents(spark, own)
        for k, (_, stage) in enumerate(corpus_pipeline.STAGES):
            found = stage(spark, docs, SF)
            assert found.columns[: len(docs.columns)] == docs.columns
            if k < 4:
                assert found.columns == docs.columns
                found.count()
            else:
                assert found.where("size(piece_ids) = 0 and length(text) > 0").count() == 0
