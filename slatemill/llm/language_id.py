"""Language identification by interpolated Kneser-Ney character models, one a language.

Texts are reduced to lower-case runs of letters (with their marks). A model predicts every character of a word and its
end from the characters before it; contexts begin anew at each word, so a text's cross-entropy adds up over its
words and equal words of a batch are scored once. A model is a few sorted arrays of n-gram hashes with log
probabilities, already interpolated, and of context hashes with back-off weights. The language of the lowest
cross-entropy a character wins. Rejection bounds and the temperature of the score come from a calibration fold.
"""
from __future__ import annotations

from collections.abc import Iterator
from dataclasses import dataclass, field

import numpy as np
import pandas as pd
from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from slatemill.llm.common import cut_lineage

ORDER = 5
FOLDS, HELD_OUT, CALIBRATE = 5, 0, 1
#: Bounds of the sample that is learned from, in characters: of all languages and of one, and of all in the calibration.
#: A language with more text than its share is sampled by document at the rate that gives the share.
TOTAL_CHARS, LANGUAGE_CHARS, CALIBRATION_CHARS = 24_000_000, 3_000_000, 8_000_000
REJECT = 0.995              # share of the calibration texts of a language that its bound lets pass
BINS, TOP = 400, 20.0       # histogram of cross-entropies in nats
TEMPERATURES = np.geomspace(0.02, 4.0, 32)
UNKNOWN = "und"
PAD, END = 1, 2             # code points that no letter has
MODEL = "lang string, keys array<binary>, logs array<binary>, contexts array<binary>, weights array<binary>"


def letters(text: Column) -> Column:
    """Lower-case letters, digits and signs left out, words parted by one space."""
    return F.trim(F.regexp_replace(F.lower(text), r"[^\p{L}\p{M}]+", " "))


def fold(doc_id: Column) -> Column:
    """Rows without a doc_id count as held out."""
    return F.coalesce(F.crc32(doc_id.cast("string").cast("binary")) % FOLDS, F.lit(HELD_OUT))


def grams(words: list[str], order: int) -> tuple[list[np.ndarray], list[np.ndarray], np.ndarray]:
    """For every predicted position of the words: hashes of its 1- to `order`-grams, of the contexts before it, and its
    word. Words are padded, so contexts at their start are whole."""
    joined = "".join(chr(PAD) * (order - 1) + w + chr(END) for w in words)
    code = np.frombuffer(joined.encode("utf-32-le", "surrogatepass"), dtype=np.uint32).astype(np.uint64)
    spans = np.array([len(w) + order for w in words], dtype=np.int64)
    word = np.repeat(np.arange(len(words)), spans)
    starts = np.repeat(np.cumsum(spans) - spans, spans)
    at = np.flatnonzero(np.arange(len(code)) - starts >= order - 1)
    mix = (code + np.uint64(1)) * np.uint64(0x9E3779B97F4A7C15)
    mix ^= mix >> np.uint64(29)
    h = np.zeros(len(code), dtype=np.uint64)
    by_length, before = [], [np.zeros(len(at), dtype=np.uint64)]
    for k in range(1, order + 1):
        shifted = np.zeros_like(mix)
        shifted[k - 1:] = mix[:len(mix) - k + 1]
        h = (h + shifted * np.uint64(2 * k + 1)) * np.uint64(0xBF58476D1CE4E5B9)
        h ^= h >> np.uint64(31)
        by_length.append(h[at])
        before.append(h[at - 1])
    return by_length, before[:order], word[at]


@dataclass
class Model:
    """Log probabilities of the n-grams seen, by length, and back-off weights of the contexts seen."""
    lang: str
    keys: list[np.ndarray] = field(default_factory=list)
    logs: list[np.ndarray] = field(default_factory=list)
    contexts: list[np.ndarray] = field(default_factory=list)
    weights: list[np.ndarray] = field(default_factory=list)

    def log_p(self, gram: list[np.ndarray], before: list[np.ndarray], floor: float) -> np.ndarray:
        """Log probability of every position: the longest n-gram seen, else the context's weight and one shorter."""
        out, open_ = np.zeros(len(gram[0])), np.arange(len(gram[0]))
        for k in range(len(self.keys) - 1, -1, -1):
            at, hit = find(self.keys[k], gram[k][open_])
            out[open_[hit]] += self.logs[k][at[hit]]
            open_ = open_[~hit]
            if not len(open_):
                return out
            at, hit = find(self.contexts[k], before[k][open_])
            out[open_[hit]] += self.weights[k][at[hit]]
        out[open_] += floor
        return out


def find(sorted_keys: np.ndarray, wanted: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    at = np.minimum(np.searchsorted(sorted_keys, wanted), max(0, len(sorted_keys) - 1))
    return at, sorted_keys[at] == wanted if len(sorted_keys) else np.zeros(len(wanted), dtype=bool)


def learn(lang: str, words: list[str], counts: np.ndarray, order: int = ORDER) -> Model:
    """Interpolated Kneser-Ney from distinct words and their counts. The longest n-grams are counted as they occur,
    shorter ones by the number of different characters before them; one discount a length. Unseen characters are left
    to `log_p`: the length-1 weight times a uniform floor that all languages share."""
    gram, before, word = grams(words, order)
    model = Model(lang)
    types = []                                      # (distinct hashes, one place of each, count) by length
    times = np.asarray(counts, dtype=np.float64)[word]
    for k in range(order - 1, -1, -1):
        if k == order - 1:
            keys, place, inverse = np.unique(gram[k], return_index=True, return_inverse=True)
            n = np.bincount(inverse, weights=times)
        else:
            longer = types[0][1]                    # one place of each distinct n-gram that is longer by one
            keys, first, n = np.unique(gram[k][longer], return_index=True, return_counts=True)
            place = longer[first]
        types.insert(0, (keys, place, n.astype(np.float64)))
    shorter = None
    for k, (keys, place, n) in enumerate(types):
        ones, twos = (n == 1).sum(), (n == 2).sum()
        discount = ones / (ones + 2 * twos) if ones and twos else 0.5
        contexts, inverse = np.unique(before[k][place], return_inverse=True)
        total, kinds = np.bincount(inverse, weights=n), np.bincount(inverse)
        weight = discount * kinds / total
        p = np.maximum(n - discount, 0) / total[inverse]
        if k == 0:
            p = p + weight[inverse] * np.exp(FLOOR)
        else:
            p = p + weight[inverse] * shorter[np.searchsorted(types[k - 1][0], gram[k - 1][place])]
        shorter = p
        model.keys.append(keys)
        model.logs.append(np.log(p).astype(np.float32))
        model.contexts.append(contexts)
        model.weights.append(np.log(weight).astype(np.float32))
    return model


#: Log probability of a character that nothing is known of: uniform over the code points, so that models with
#: different alphabets stay comparable.
FLOOR = -float(np.log(0x110000))


def cross_entropies(models: list[Model], texts: list[str]) -> tuple[np.ndarray, np.ndarray]:
    """(texts x models) mean negative log probability a predicted character, and the number of those characters.
    Texts are outputs of `letters`; an empty one has zeros."""
    split = [t.split(" ") if t else [] for t in texts]
    sizes = np.array([len(w) for w in split], dtype=np.int64)
    code, words = pd.factorize(np.array([w for s in split for w in s], dtype=object))
    text = np.repeat(np.arange(len(texts)), sizes)
    length = np.zeros(len(texts))
    out = np.zeros((len(texts), len(models)))
    if not len(words):
        return out, length
    length += np.bincount(text, weights=np.array([len(w) + 1 for w in words], dtype=np.float64)[code], minlength=len(texts))
    order = len(models[0].keys) if models else ORDER
    gram, before, word = grams(words.tolist(), order)
    for j, m in enumerate(models):
        per_word = np.bincount(word, weights=-m.log_p(gram, before, FLOOR), minlength=len(words))
        out[:, j] = np.bincount(text, weights=per_word[code], minlength=len(texts)) / np.maximum(length, 1)
    return out, length


@dataclass
class Identifier:
    """Models with their rejection bounds (nats a character) and the temperature of the score."""
    models: list[Model]
    bounds: np.ndarray
    temperature: float = 1.0

    def predict(self, texts: list[str]) -> pd.DataFrame:
        e, n = cross_entropies(self.models, texts)
        if not self.models:
            return pd.DataFrame({"lang": [UNKNOWN] * len(texts), "score": 0.0, "cross_entropy": 0.0, "rejected": n > 0})
        pick = e.argmin(axis=1)                     # models are in name order: ties go to the first name
        low = e[np.arange(len(texts)), pick]
        score = 1 / np.exp(-(e - low[:, None]) / self.temperature).sum(axis=1)
        names = np.array([m.lang for m in self.models], dtype=object)[pick]
        names[n == 0] = UNKNOWN
        return pd.DataFrame({"lang": names, "score": np.where(n > 0, score, 0.0), "cross_entropy": low, "rejected": (n > 0) & (low > self.bounds[pick])})


def sampled(docs: DataFrame) -> DataFrame:
    """Documents (doc_id, text, lang, calibrate) that are learned from, as (lang, calibrate, words). They are chosen by
    the hash of doc_id, each language at the rate that leaves its share of the bounds above; written to the shared folder."""
    sizes = docs.groupBy("lang", "calibrate").agg(F.sum(F.length("text")).alias("chars"))
    parts = Window.partitionBy("calibrate")
    share = F.when(F.col("calibrate"), F.least(F.lit(LANGUAGE_CHARS / 3), CALIBRATION_CHARS / F.count("*").over(parts))).otherwise(F.least(F.lit(float(LANGUAGE_CHARS)), TOTAL_CHARS / F.count("*").over(parts)))
    # one row a language: a written table, so Spark knows its size when it plans the join
    rates = cut_lineage(sizes.where("chars > 0").select("lang", "calibrate", (share / F.col("chars")).alias("rate")))
    place = F.pmod(F.xxhash64(F.lit("sample"), "doc_id"), F.lit(1 << 30)) / float(1 << 30)
    chosen = docs.join(rates, ["lang", "calibrate"]).where(place < F.col("rate"))
    return cut_lineage(chosen.select("lang", "calibrate", letters(F.col("text")).alias("words")).where("words <> ''"))


def train(docs: DataFrame) -> Identifier:
    """Learns from (doc_id, text, lang) rows with a language outside the held-out fold: one of the four folds left is
    kept for the calibration. A language without text in the other three isn't learned."""
    part = fold(F.col("doc_id"))
    sample = sampled(docs.where(F.col("lang").isNotNull() & (part != HELD_OUT)).select("doc_id", "text", "lang", (part == CALIBRATE).alias("calibrate")))
    words = sample.where("NOT calibrate").select("lang", F.explode(F.split("words", " ")).alias("word")).groupBy("lang", "word").agg(F.count("*").alias("n"))

    def build(b: pd.DataFrame) -> pd.DataFrame:
        b = b.sort_values("word")
        m = learn(b["lang"].iloc[0], b["word"].tolist(), b["n"].to_numpy())
        raw_ = lambda arrays: [[a.tobytes() for a in arrays]]
        return pd.DataFrame({"lang": [m.lang], "keys": raw_(m.keys), "logs": raw_(m.logs), "contexts": raw_(m.contexts), "weights": raw_(m.weights)})

    read = lambda arrays, kind: [np.frombuffer(a, dtype=kind) for a in arrays]
    # bounded by the sample, whatever the corpus
    models = [Model(r.lang, read(r["keys"], np.uint64), read(r.logs, np.float32), read(r.contexts, np.uint64), read(r.weights, np.float32))
              for r in words.groupBy("lang").applyInPandas(build, MODEL).orderBy("lang").collect()]
    found = Identifier(models, np.full(len(models), np.inf))
    if models:
        calibrate(found, sample.where("calibrate"))
    return found


def calibrate(found: Identifier, texts: DataFrame) -> None:
    """Sets the temperature of the lowest log loss and, a language, the cross-entropy that REJECT of its texts stay
    below; a language without such texts keeps the largest bound of the others."""
    names = [m.lang for m in found.models]
    models = found.models

    def run(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        for b in batches:
            b = b[b["lang"].isin(names)]
            e, n = cross_entropies(models, b["words"].tolist())
            own = np.array([names.index(x) for x in b["lang"]], dtype=np.int64)
            mine = e[np.arange(len(b)), own]
            for i, name in enumerate(names):
                s = own == i
                if s.any():
                    gap = -(e[s] - mine[s][:, None])
                    loss = [float(np.log(np.exp(np.minimum(gap / t, 500)).sum(axis=1)).sum()) for t in TEMPERATURES]
                    seen = np.bincount(np.minimum(mine[s] / TOP * BINS, BINS - 1).astype(int), minlength=BINS)
                    yield pd.DataFrame({"lang": name, "at": np.arange(BINS + len(TEMPERATURES)), "n": np.concatenate([seen, loss])})

    rows = texts.select("lang", "words").mapInPandas(run, "lang string, at int, n double").groupBy("lang", "at").agg(F.sum("n").alias("n")).collect()
    table = {name: np.zeros(BINS + len(TEMPERATURES)) for name in names}
    for r in rows:
        table[r.lang][r["at"]] = r.n
    losses = sum(t[BINS:] for t in table.values())
    if losses.any():
        found.temperature = float(TEMPERATURES[losses.argmin()])
    bounds = np.full(len(names), np.nan)
    for i, name in enumerate(names):
        seen = table[name][:BINS].cumsum()
        if seen[-1]:
            bounds[i] = (np.searchsorted(seen, REJECT * seen[-1]) + 1) * TOP / BINS
    found.bounds = np.where(np.isnan(bounds), np.nanmax(bounds) if (~np.isnan(bounds)).any() else np.inf, bounds)


def identify(docs: DataFrame, found: Identifier) -> DataFrame:
    """One row per row of `docs` (doc_id, text): doc_id, held_out, lang_pred, score, cross_entropy, rejected, lang.

    lang_pred is the nearest learned language, `und` for a null text or one without a letter (score 0) and where no
    language was learned. `lang` is lang_pred with rejected texts, which no language explains well, as `und`."""
    def run(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        for b in batches:
            out = found.predict(b["words"].tolist())
            yield pd.DataFrame({"doc_id": b["doc_id"].astype("Int64"), "lang_pred": out["lang"], "score": out["score"], "cross_entropy": out["cross_entropy"], "rejected": out["rejected"]})

    rows = docs.select(F.col("doc_id").cast("long").alias("doc_id"), F.coalesce(letters(F.col("text")), F.lit("")).alias("words"))
    rows = rows.withColumn("words", F.when(F.col("words").rlike(r"\p{L}"), F.col("words")).otherwise(""))
    out = rows.mapInPandas(run, "doc_id long, lang_pred string, score double, cross_entropy double, rejected boolean")
    return out.select("doc_id", (fold(F.col("doc_id")) == HELD_OUT).alias("held_out"), "lang_pred", "score", "cross_entropy", "rejected",
                      F.when(F.col("rejected"), F.lit(UNKNOWN)).otherwise(F.col("lang_pred")).alias("lang"))


def language_id(docs: DataFrame) -> DataFrame:
    """Learns languages from `docs` and predicts that of every row; see `train` and `identify`. Only text and lang
    outside the held-out fold are learned from, and only text is predicted from. Rows that share a doc_id are predicted
    each by its own text; rows without one are held out. Other columns, whatever their names, are ignored."""
    docs = docs.select("doc_id", "text", "lang")
    return identify(docs, train(docs))
