"""Quality scores: random Fourier features of document statistics, ridge regression, isotonic calibration.

The statistics are about form (lengths, character classes, repetition, punctuation), never about labels, lang,
source or doc_id. cos(Wx + b) with Gaussian W approximates a Gaussian kernel over them. Every partition of labelled rows sums
its own normal equations; partial sums are added up in two steps, so one matrix of a fixed size reaches the
driver. A fold that the ridge fit has not seen gives the isotonic calibration, from sums per score bin.
"""
from __future__ import annotations

from collections import Counter
from collections.abc import Iterator
from dataclasses import dataclass, field
from operator import eq

import numpy as np
import pandas as pd
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from slatemill.llm.common import cut_lineage

CLASSES = ["lower", "upper", "digit", "space", "newline", "other_ascii", "symbol", "mark", "high"]
STATS = [*CLASSES, "log_chars", "log_words", "word_mean", "word_spread", "word_max", "distinct", "top_share", "repeat_next",
         "pair_distinct", "marked_words", "same_lines"]
FEATURES, RIDGE, CLIP, BINS, SEED = 384, 3.0, 4.0, 2000, 20240
FOLDS, HELD_OUT, CALIBRATE = 5, 0, 1


def _class_of() -> np.ndarray:
    c = np.full(256, CLASSES.index("other_ascii"))
    for i in range(256):
        ch = chr(i)
        name = ("high" if i > 127 else "lower" if ch.islower() else "upper" if ch.isupper() else "digit" if ch.isdigit() else "newline" if ch == "\n"
                else "space" if ch.isspace() else "symbol" if ch in "#$%&*+<=>@[\\]^_`{|}~/" else "mark" if ch in "!\"'(),-.:;?" else None)
        if name:
            c[i] = CLASSES.index(name)
    return c


CLASS_OF = _class_of()


def statistics(raw: bytes | None) -> np.ndarray:
    """The statistics of one whole text (UTF-8); an empty text has zeros."""
    raw = raw or b""
    out = np.zeros(len(STATS))
    if not raw:
        return out
    words = raw.split()
    hist = np.bincount(np.frombuffer(raw, dtype=np.uint8), minlength=256)
    share = np.bincount(CLASS_OF, weights=hist, minlength=len(CLASSES)) / len(raw)
    n = len(words)
    out[:len(CLASSES)] = share
    out[len(CLASSES)] = np.log1p(len(raw))
    if not n:
        return out
    size = np.fromiter(map(len, words), np.int64, n)
    counts = Counter(words)
    lines = raw.split(b"\n")
    marked = sum(1 for w in words if len(w) > 1 and not (w[-2:-1].isalnum() or w[-2] > 127))
    out[len(CLASSES) + 1:] = [np.log1p(n), size.mean(), size.std(), np.log1p(size.max()), len(counts) / n, max(counts.values()) / n,
                              sum(map(eq, words, words[1:])) / n, len(set(zip(words, words[1:]))) / max(1, n - 1), marked / n, 1 - len(set(lines)) / len(lines)]
    return out


def statistics_table(docs: DataFrame) -> DataFrame:
    """(doc_id, x): the statistics of every row of `docs`, written to the shared folder."""
    def run(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        for b in batches:
            yield pd.DataFrame({"doc_id": b["doc_id"].astype("Int64"), "x": [statistics(t) for t in b["text"]]})

    d = docs.select(F.col("doc_id").cast("long").alias("doc_id"), F.col("text").cast("string").cast("binary").alias("text"))
    return cut_lineage(d.mapInPandas(run, "doc_id long, x array<double>"))


@dataclass
class Model:
    """A fitted scorer; without training rows every text scores `base`."""
    mean: np.ndarray = field(default_factory=lambda: np.zeros(len(STATS)))
    scale: np.ndarray = field(default_factory=lambda: np.ones(len(STATS)))
    weights: np.ndarray | None = None
    knots: tuple[np.ndarray, np.ndarray] | None = None
    base: float = 0.5

    def fourier(self, x: np.ndarray) -> np.ndarray:
        """A constant and FEATURES cosines of the standardised statistics."""
        rnd = np.random.default_rng(SEED)
        w = rnd.normal(0, 1 / np.sqrt(x.shape[1]), (x.shape[1], FEATURES))
        shift = rnd.uniform(0, 2 * np.pi, FEATURES)
        z = np.clip((x - self.mean) / self.scale, -CLIP, CLIP)
        return np.hstack([np.ones((len(x), 1)), np.sqrt(2 / FEATURES) * np.cos(z @ w + shift)])

    def raw(self, x: np.ndarray) -> np.ndarray:
        return self.fourier(x) @ self.weights if self.weights is not None else np.full(len(x), self.base)

    def score(self, x: np.ndarray) -> np.ndarray:
        r = self.raw(x)
        return np.clip(np.interp(r, *self.knots) if self.knots is not None else r, 0, 1)


def _added(df: DataFrame, columns: list[str]) -> dict[str, np.ndarray]:
    """Sums of the rows' arrays, in two steps of a fixed number of tasks; one row reaches the driver."""
    def add(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        total: dict[str, np.ndarray] = {}
        for b in batches:
            for c in columns:
                for raw in b[c]:
                    v = np.frombuffer(raw, dtype=np.float64)
                    total[c] = total[c] + v if c in total else v
        if total:
            yield pd.DataFrame({c: [v.tobytes()] for c, v in total.items()})

    schema = ", ".join(f"{c} binary" for c in columns)
    rows = df.repartition(16).mapInPandas(add, schema).repartition(1).mapInPandas(add, schema).collect()
    return {c: np.frombuffer(rows[0][c], dtype=np.float64) for c in columns} if rows else {}


def isotonic(x: np.ndarray, y: np.ndarray, n: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    """Weighted pool-adjacent-violators over increasing x: block centres and their rising means."""
    blocks: list[list[float]] = []
    for a, b, w in zip(x, y, n):
        blocks.append([a * w, b * w, w])
        while len(blocks) > 1 and blocks[-2][1] * blocks[-1][2] >= blocks[-1][1] * blocks[-2][2]:
            last = blocks.pop()
            blocks[-1] = [p + q for p, q in zip(blocks[-1], last)]
    b = np.array(blocks)
    return b[:, 0] / b[:, 2], b[:, 1] / b[:, 2]


def fold(doc_id: Column) -> Column:
    return F.coalesce(F.crc32(doc_id.cast("string")) % FOLDS, F.lit(0))


def fit(stats: DataFrame, labels: DataFrame) -> Model:
    """Ridge and calibration from labelled rows outside the held-out fold. All of them are used; labels that are
    not 0 or 1 are left out, and a document with several labels counts with each."""
    own = labels.where("quality IN (0, 1) AND doc_id IS NOT NULL").select(F.col("doc_id").cast("long").alias("doc_id"), F.col("quality").cast("double").alias("y"))
    rows = cut_lineage(stats.join(own, "doc_id").withColumn("fold", fold(F.col("doc_id"))).where(f"fold <> {HELD_OUT}").select("x", "y", "fold"))
    k, model = len(STATS), Model()

    def moments(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        for b in batches:
            x = np.vstack(b["x"].tolist())
            yield pd.DataFrame({"s": [np.concatenate([[len(x), b["y"].sum()], x.sum(axis=0), (x * x).sum(axis=0)]).tobytes()]})

    got = _added(rows.where(f"fold <> {CALIBRATE}").select("x", "y").mapInPandas(moments, "s binary"), ["s"])
    if not got:
        return model
    n, hits, first, second = got["s"][0], got["s"][1], got["s"][2:k + 2] / got["s"][0], got["s"][k + 2:] / got["s"][0]
    model.base, model.mean = hits / n, first
    model.scale = np.sqrt(np.maximum(second - first ** 2, 1e-12))
    model.scale[model.scale < 1e-5] = 1.0

    def normal(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        a, c = np.zeros((FEATURES + 1, FEATURES + 1)), np.zeros(FEATURES + 1)
        for b in batches:
            z = model.fourier(np.vstack(b["x"].tolist()))
            a, c = a + z.T @ z, c + z.T @ b["y"].to_numpy()
        yield pd.DataFrame({"a": [a.tobytes()], "c": [c.tobytes()]})

    got = _added(rows.where(f"fold <> {CALIBRATE}").select("x", "y").mapInPandas(normal, "a binary, c binary"), ["a", "c"])
    penalty = np.full(FEATURES + 1, RIDGE)
    penalty[0] = 1e-6
    model.weights = np.linalg.solve(got["a"].reshape(FEATURES + 1, -1) + np.diag(penalty), got["c"])

    def raw(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        for b in batches:
            yield pd.DataFrame({"r": model.raw(np.vstack(b["x"].tolist())), "y": b["y"]})

    bins = (rows.where(f"fold = {CALIBRATE}").select("x", "y").mapInPandas(raw, "r double, y double")
            .groupBy(F.floor(F.least(F.greatest("r", F.lit(-0.5)), F.lit(1.5)) * (BINS // 2)).alias("bin"))
            .agg(F.avg("r").alias("r"), F.avg("y").alias("y"), F.count("*").alias("n")).orderBy("bin").toPandas())
    if len(bins):
        model.knots = isotonic(bins["r"].to_numpy(), bins["y"].to_numpy(), bins["n"].to_numpy(float))
    return model


def score_text(model: Model, text: Column) -> Column:
    """Score of a text column; for rows whose statistics are not at hand."""
    @F.pandas_udf("double")
    def run(texts: pd.Series) -> pd.Series:
        return pd.Series(model.score(np.vstack([statistics(t) for t in texts])) if len(texts) else [], dtype=float)

    return run(text.cast("string").cast("binary"))


def quality_scores(docs: DataFrame, labels: DataFrame, threshold: float = 0.3) -> DataFrame:
    """One row per row of `docs` (doc_id, text; other columns are ignored): doc_id, held_out, score, predicted.

    Null and empty texts have all-zero statistics and score like any other. Without training labels every score
    is 0.5. Rows that share a doc_id are scored each by its own text; rows without one count as held out."""
    stats = statistics_table(docs)
    model = fit(stats, labels)

    def run(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        for b in batches:
            yield pd.DataFrame({"doc_id": b["doc_id"].astype("Int64"), "score": model.score(np.vstack(b["x"].tolist()))})

    scored = stats.mapInPandas(run, "doc_id long, score double")
    return scored.select("doc_id", (fold(F.col("doc_id")) == HELD_OUT).alias("held_out"), "score",
                         (F.col("score") >= threshold).cast("int").alias("predicted"))


def keep_good(docs: DataFrame, labels: DataFrame, threshold: float = 0.3) -> DataFrame:
    """The rows of `docs` whose text scores at least `threshold`."""
    model = fit(statistics_table(docs), labels)
    return docs.where(score_text(model, F.col("text")) >= threshold)
