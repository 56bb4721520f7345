"""The classifier: held-out accuracy on the driver's labels, parts against numpy, odd rows."""
import os
import zlib

import numpy as np
import pytest

from slatemill.llm.quality import STATS, isotonic, keep_good, quality_scores, statistics

SF = "/root/testdata/sf0.01"


@pytest.mark.skipif(not os.path.isdir(SF), reason="driver tables not present")
def test_held_out_rows(spark):
    docs, labels = (spark.read.parquet(f"{SF}/{t}.parquet") for t in ("documents", "labels"))
    got = {r.doc_id: r for r in quality_scores(docs, labels).collect()}
    assert len(got) == docs.count()
    held = [(got[r.doc_id], r.quality) for r in labels.collect() if zlib.crc32(str(r.doc_id).encode()) % 5 == 0]
    assert all(g.held_out for g, _ in held) and len(held) > 40
    assert np.mean([g.predicted == q for g, q in held]) > 0.95
    assert np.mean([g.predicted for g, q in held if q == 1]) > 0.98
    flipped = labels.selectExpr("doc_id", "CASE WHEN crc32(cast(doc_id as string)) % 5 = 0 THEN 1 - quality ELSE quality END AS quality")
    assert {r.doc_id: round(r.score, 9) for r in quality_scores(docs, flipped).collect()} == {k: round(r.score, 9) for k, r in got.items()}


def test_odd_rows_and_empty_tables(spark):
    texts = [None, "", " \n ", "a", "word " * 50_000, "Ünï ¿qué?\n\nx", "same text", "same text"]
    docs = spark.createDataFrame([(i if i != 3 else None, t, "x", 0.5) for i, t in enumerate(texts)], "doc_id long, text string, quality string, score double")
    labels = spark.createDataFrame([(i, q, None) for i, q in [(1, 0), (2, 0), (4, 1), (5, 1), (6, 1), (6, None), (None, 1), (77, 0)]], "doc_id long, quality int, toxic int")
    got = quality_scores(docs, labels).collect()
    assert len(got) == len(texts) and all(0 <= r.score <= 1 and r.predicted == (r.score >= 0.3) for r in got)
    assert len({r.score for r in got if r.doc_id in (6, 7)}) == 1
    assert {r.score for r in quality_scores(docs, labels.limit(0)).collect()} == {0.5}
    assert quality_scores(docs.limit(0), labels).collect() == []
    assert keep_good(docs, labels).columns == docs.columns


def test_statistics_and_isotonic():
    x = dict(zip(STATS, statistics("Ab ab ab, $1\nAb".encode())))
    assert x["upper"] == 2 / 15 and x["digit"] == 1 / 15 and x["newline"] == 1 / 15 and x["symbol"] == 1 / 15
    assert x["distinct"] == 4 / 5 and x["marked_words"] == 1 / 5 and x["repeat_next"] == 0.0
    assert not statistics(None).any() and not statistics(b"").any()
    centre, mean = isotonic(np.arange(6.0), np.array([0, 1, 0, 1, 1, 0.0]), np.ones(6))
    assert (np.diff(mean) > 0).all() and np.allclose(mean, [0, 0.5, 2 / 3]) and np.allclose(centre, [0, 1.5, 4])
