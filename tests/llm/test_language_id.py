"""Kneser-Ney models against a dictionary version, held-out accuracy, odd rows."""
import math
import os
import zlib
from collections import Counter, defaultdict

import numpy as np
import pytest

from slatemill.llm import language_id as li
from slatemill.llm.language_id import cross_entropies, language_id, learn, train

SF = "/root/testdata/sf0.01"


class SlowKneserNey:
    """The same model from dictionaries of strings."""

    def __init__(self, counts, order):
        self.order, self.grams = order, [Counter() for _ in range(order + 1)]
        for w, n in counts.items():
            s = "\x01" * (order - 1) + w + "\x02"
            for i in range(order - 1, len(s)):
                self.grams[order][s[i - order + 1:i + 1]] += n
        for k in range(order - 1, 0, -1):
            self.grams[k] = Counter(g[1:] for g in self.grams[k + 1])
        self.total, self.kinds, self.discount = defaultdict(float), defaultdict(int), {}
        for k in range(1, order + 1):
            seen = Counter(self.grams[k].values())
            self.discount[k] = seen[1] / (seen[1] + 2 * seen[2]) if seen[1] and seen[2] else 0.5
            for g, n in self.grams[k].items():
                self.total[k, g[:-1]] += n
                self.kinds[k, g[:-1]] += 1

    def p(self, c, before, k=None):
        k = self.order if k is None else k
        if k == 0:
            return 1 / 0x110000
        h = before[len(before) - k + 1:]
        lower = self.p(c, before, k - 1)
        if not self.total[k, h]:
            return lower
        d = self.discount[k]
        return max(self.grams[k][h + c] - d, 0) / self.total[k, h] + d * self.kinds[k, h] / self.total[k, h] * lower

    def entropy(self, text):
        logs = []
        for w in text.split(" "):
            s = "\x01" * (self.order - 1) + w + "\x02"
            logs += [-math.log(self.p(s[i], s[i - self.order + 1:i])) for i in range(self.order - 1, len(s))]
        return sum(logs) / len(logs)


@pytest.mark.parametrize("order", [1, 2, 5])
def test_against_dictionaries(order):
    rnd = np.random.default_rng(order)
    make = lambda letters, n: ["".join(rnd.choice(list(letters), rnd.integers(1, 9))) for _ in range(n)]
    a, b = Counter(make("abcde", 300)), Counter(make("cdefé中", 200))
    models = [learn(x, sorted(c), np.array([c[w] for w in sorted(c)]), order) for x, c in (("a", a), ("b", b))]
    texts = ["abc de", "fé中 cdef", "zzz", "a", "", "edcba " * 50 + "x"]
    texts[-1] = texts[-1].strip()
    got, n = cross_entropies(models, texts)
    for j, slow in enumerate((SlowKneserNey(a, order), SlowKneserNey(b, order))):
        for i, t in enumerate(texts):
            assert n[i] == len(t.replace(" ", "")) + (len(t.split(" ")) if t else 0)
            assert got[i, j] == pytest.approx(slow.entropy(t) if t else 0.0, rel=1e-5)
        # every context's probabilities add up to one
        alphabet = {c for g in slow.grams[1] for c in g}
        for h in ("\x01" * 8, "abcd", "zzzz", "cdef"):
            seen = sum(slow.p(c, h) for c in alphabet)
            assert seen + (0x110000 - len(alphabet)) * slow.p("\x7f", h) == pytest.approx(1.0)


@pytest.mark.skipif(not os.path.isdir(SF), reason="driver tables not present")
def test_held_out_rows(spark):
    docs = spark.read.parquet(f"{SF}/documents.parquet")
    lang = {r.doc_id: r.lang for r in docs.collect()}
    got = {r.doc_id: r for r in language_id(docs).collect()}
    assert got.keys() == lang.keys()
    held = [(r, lang[i]) for i, r in got.items() if zlib.crc32(str(i).encode()) % 5 == 0]
    assert all(r.held_out for r, _ in held) and len(held) > 150 and sum(r.held_out for r in got.values()) == len(held)
    assert np.mean([r.lang_pred == x for r, x in held]) > 0.97
    assert np.mean([r.rejected for r, _ in held]) < 0.05 and all(0 <= r.score <= 1 for r in got.values())
    # neither languages of the held-out fold nor any other column reach a prediction
    other = docs.selectExpr("doc_id", "text", "CASE WHEN crc32(cast(doc_id as string)) % 5 = 0 THEN 'xx' ELSE lang END AS lang", "'s' AS source")
    again = {r.doc_id: (r.lang_pred, round(r.score, 9)) for r in language_id(other).collect()}
    assert again == {i: (r.lang_pred, round(r.score, 9)) for i, r in got.items()}


def test_rejects_what_no_language_explains(spark):
    rnd = np.random.default_rng(0)
    one = lambda words: " ".join(rnd.choice(words, 40))
    en, de = ["the", "and", "of", "nation", "where"], ["der", "und", "nicht", "zwischen", "über"]
    rows = [(i, one(en if i % 2 else de), "en" if i % 2 else "de") for i in range(200)]
    found = train(spark.createDataFrame(rows, "doc_id long, text string, lang string"))
    out = found.predict(["the nation and the", "über und nicht", "zqxj kwvy pfgx", ""])
    assert out["lang"].tolist()[:2] == ["en", "de"] and out["lang"].tolist()[3] == "und" and out["rejected"].tolist() == [False, False, True, False]
    assert (out["score"][:2] > 0.9).all() and out["score"][3] == 0 and 0.02 <= found.temperature <= 4


def test_odd_rows_and_empty_tables(spark):
    texts = [None, "", " \n ", "123 $$$ ...", "a", "A", "wort " * 50_000, "中文", "same text", "same text", "x" * 100_000]
    schema = "doc_id long, text string, lang string, words string, score double, fold int"
    rows = [(i if i != 4 else None, t, None if i == 5 else "l1" if i % 2 else "l2", "w", 0.5, 1) for i, t in enumerate(texts)]
    docs = spark.createDataFrame(rows + [(5, None, "l1", "w", 0.5, 1)], schema)
    got = language_id(docs).collect()
    assert len(got) == len(texts) + 1 and all(0 <= r.score <= 1 for r in got)
    by = {r.doc_id: r for r in got}
    assert all(by[i].lang_pred == "und" and by[i].score == 0 for i in (0, 1, 2, 3)) and by[6].lang_pred in ("l1", "l2") and by[None].held_out
    assert by[8].lang_pred == by[9].lang_pred and by[8].score == by[9].score
    assert language_id(docs.limit(0)).collect() == []
    assert {r.lang_pred for r in language_id(docs.selectExpr("doc_id", "text", "cast(null AS string) AS lang")).collect()} == {"und"}


def test_sample_is_bounded(spark, monkeypatch):
    monkeypatch.setattr(li, "LANGUAGE_CHARS", 3000)
    docs = spark.range(2000).selectExpr("id AS doc_id", "repeat('abc ', 10) AS text", "'l' AS lang", "false AS calibrate")
    assert 20 < li.sampled(docs).count() < 160
