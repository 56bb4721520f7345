"""Backoff scores against counting with dictionaries."""
import math
import random
import re
from collections import Counter

import pytest

from slatemill.llm.backoff_lm import backoff_scores

rnd = random.Random(8)
TEXTS = [" ".join(rnd.choices(["the", "The", "of", "cat", "sat", "mat", "a,", "Ü", "on"], k=rnd.randrange(1, 30))) for _ in range(60)]
TEXTS += [None, "", " \n", "lonely words nowhere else", TEXTS[0], TEXTS[0], "the " * 5000, "one\x0btwo"]


def brute(rows, order, alpha):
    docs = [(i, re.findall(r"[^\x20\x09-\x0D]+", "".join(c.lower() if "A" <= c <= "Z" else c for c in t or ""))) for i, t in rows]
    grams = [[Counter(tuple(w[i:i + k]) for i in range(len(w) - k + 1)) for k in range(1, order + 1)] for _, w in docs]
    total = [sum((g[k] for g in grams), Counter()) for k in range(order)]
    words, out = sum(len(w) for _, w in docs), []
    for (i, w), own in zip(docs, grams):
        n, s, short = words - len(w), 0.0, 0
        for at in range(len(w)):
            def value(k):
                gram = tuple(w[at - k + 1:at + 1])
                c = total[k - 1][gram] - own[k - 1][gram]
                if k == 1:
                    return c / n if c else alpha / (n + 1)
                return c / (total[k - 2][gram[:-1]] - own[k - 2][gram[:-1]]) if c else alpha * value(k - 1)
            k = min(order, at + 1)
            full = tuple(w[at - order + 1:at + 1]) if at + 1 >= order else None
            short += not (full and total[order - 1][full] - own[order - 1][full])
            s += math.log(value(k))
        out.append((i, len(w), round(s, 6), round(s / max(1, len(w)), 8), short))
    return sorted(out, key=str)


@pytest.mark.parametrize("order,block", [(2, 300), (3, 1 << 20), (1, 300)])
def test_scores(spark, order, block):
    rows = [(i if i != 3 else None, t) for i, t in enumerate(TEXTS)] + [(5, "the cat"), (5, "the cat")]
    docs = spark.createDataFrame([(*r, 1, "x") for r in rows], "doc_id long, text string, n long, block string").repartition(4)
    got = [(r.doc_id, r.n_words, round(r.log_score, 6), round(r.mean_log_score, 8), r.backed_off) for r in backoff_scores(docs, order, block_bytes=block).collect()]
    want = brute(rows, order, 0.4)
    assert [g[:2] + g[4:] for g in sorted(got, key=str)] == [w[:2] + w[4:] for w in want]
    assert all(abs(a[2] - b[2]) < 1e-4 for a, b in zip(sorted(got, key=str), want))


def test_no_rows(spark):
    docs = spark.createDataFrame([(1, None)], "doc_id long, text string")
    assert [tuple(r) for r in backoff_scores(docs).collect()] == [(1, 0, 0.0, 0.0, 0)]
    assert backoff_scores(docs.limit(0)).collect() == []


def test_query_scores_by_trigrams(spark, tmp_path):
    from slatemill.llm.queries import QUERIES
    docs = spark.createDataFrame(list(enumerate(TEXTS[:20])), "doc_id long, text string")
    docs.write.parquet(f"{tmp_path}/documents.parquet")
    got = {r.doc_id: (r.backed_off, round(r.log_score, 4)) for r in QUERIES["op5_backoff_lm"](spark, str(tmp_path)).collect()}
    assert got == {r[0]: (r[4], round(r[2], 4)) for r in brute(list(enumerate(TEXTS[:20])), 3, 0.4)}
