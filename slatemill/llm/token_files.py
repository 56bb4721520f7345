"""Token-id files: frequency-ranked ids in a byte-aligned variable-length code with separate control bytes.

Every distinct id gets its rank by corpus frequency, so the commonest 256 ids take one data byte. A file holds
the documents of one stretch of the doc_id order:

    magic (8 bytes), number of documents and of ids (two int64), doc_id (int64 each), null flags of doc_id (one
    byte each), ids per document (int64 each), control bytes (2 bits per id: data bytes less one), data bytes.

Files are decoded without a loop over ids: control bytes index a table of four lengths each, and the lengths
place the data bytes. Texts are tokenized once, into a compact table in the shared folder; counting, ranking,
sorting and writing run on that table. Tasks write files under names of their own and hand back one manifest
row per file; only files in the manifest are read, so a repeated task leaves at most an unread file.
"""
from __future__ import annotations

import os
import re
import struct
import uuid
import zlib
from collections.abc import Iterator

import numpy as np
import pandas as pd
import pyarrow.fs as pafs
from pyspark import TaskContext
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from slatemill.operators.running import running_total
from slatemill.llm.common import cut_lineage, shared_folder

MAGIC = b"TOKVLC01"
LENGTHS = ((np.arange(256)[:, None] >> np.array([0, 2, 4, 6])) & 3) + 1
LETTERS = re.compile(r"([a-zà-öø-ÿ]+)([!-&*-/:;?]*)").fullmatch      # letters, then punctuation without the apostrophe
ODD_SPACE = re.compile(r"[\x1c-\x1f]")                                  # Python splits here, the tokenizer does not
WORDS_KEPT, CORES_KEPT = 400_000, 600_000                               # entries of a worker's word caches


class WordEncoder:
    """Ids of whole texts by way of their words, for tokenizers that never look across white space.

    Words repeat, so each is encoded once per worker: words of plain letters by the tokenizer's own model, all
    others by the whole tokenizer. Caches are emptied when full. `exact` is False for a tokenizer without a
    white-space-free word end; texts are then encoded whole."""

    def __init__(self, path: str):
        os.environ["TOKENIZERS_PARALLELISM"] = "false"
        from tokenizers import Tokenizer, pre_tokenizers
        self.tok = Tokenizer.from_file(path)
        self.wide = "<u2" if self.tok.get_vocab_size() <= 65536 else "<u4"
        self.by_word = getattr(self.tok.model, "end_of_word_suffix", None) == "</w>" and self.tok.post_processor is None
        level = pre_tokenizers.ByteLevel(add_prefix_space=False, use_regex=False)
        self.bytes_of = {c: level.pre_tokenize_str(chr(c))[0][0] for c in range(0xDF, 0x100) if chr(c).isalpha()}
        self.words: dict[str, bytes] = {}
        self.cores: dict[str, bytes] = {}

    def _pack(self, ids: list[int]) -> bytes:
        return np.array(ids, dtype=self.wide).tobytes()

    def _whole(self, text: str) -> bytes:
        return self._pack(self.tok.encode(text, add_special_tokens=False).ids)

    def _core(self, core: str) -> bytes:
        got = self.cores.get(core)
        if got is None:
            if len(self.cores) >= CORES_KEPT:
                self.cores.clear()
            got = self._pack([t.id for t in self.tok.model.tokenize(core.translate(self.bytes_of))])
            self.cores[core] = got
        return got

    def _word(self, word: str) -> bytes:
        m = LETTERS(word)
        if m is None:
            return self._whole(word)
        if not m[2]:
            return self._core(m[1])
        tail = self.words.get(m[2])
        if tail is None:
            tail = self.words[m[2]] = self._whole(m[2])
        return self._core(m[1]) + tail

    def encode(self, text: str | None) -> bytes:
        if not text:
            return b""
        if not self.by_word or ODD_SPACE.search(text):
            return self._whole(text)
        if "<|" not in text:               # special tokens are told by their case
            try:
                text.encode("latin-1")
                text = text.lower()        # within Latin-1 lower-casing and normal forms work letter by letter
            except UnicodeEncodeError:
                pass
        split = text.split()
        words = self.words
        for w in set(split).difference(words):
            words[w] = self._word(w)
        out = b"".join(map(words.__getitem__, split))
        if len(words) >= WORDS_KEPT:
            words.clear()
        return out


_ENCODERS: dict[str, WordEncoder] = {}


def encoder(path: str) -> WordEncoder:
    """One encoder per Python worker; workers are reused, and so are the word caches."""
    if path not in _ENCODERS:
        _ENCODERS[path] = WordEncoder(path)
    return _ENCODERS[path]


def token_table(docs: DataFrame, tokenizer: str, end_id: int) -> DataFrame:
    """(doc_id, wide, ids): little-endian ids of each whole text and the end id, written to the shared folder."""
    def encode(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        enc = encoder(tokenizer)
        end = np.array([end_id], dtype=enc.wide).tobytes()
        for b in batches:
            for at in range(0, len(b), 512):
                part = b.iloc[at:at + 512]
                yield pd.DataFrame({"doc_id": part["doc_id"].astype("Int64"), "ids": [enc.encode(t) + end for t in part["text"]],
                                    "wide": np.full(len(part), int(enc.wide[2]), dtype=np.int32)})

    d = docs.select(F.col("doc_id").cast("long").alias("doc_id"), F.col("text").cast("string").alias("text"))
    return cut_lineage(d.mapInPandas(encode, "doc_id long, ids binary, wide int"), compression="zstd")


def id_counts(tokens: DataFrame) -> DataFrame:
    """(id, n) over all documents; a task sends one row per id of the vocabulary at most."""
    def count(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        total = np.zeros(0, dtype=np.int64)
        for b in batches:
            for raw, wide in zip(b["ids"], b["wide"]):
                c = np.bincount(np.frombuffer(raw, dtype=f"<u{wide}"), minlength=len(total))
                c[:len(total)] += total
                total = c
        at = np.flatnonzero(total)
        yield pd.DataFrame({"id": at, "n": total[at]})

    return tokens.select("ids", "wide").mapInPandas(count, "id long, n long").groupBy("id").agg(F.sum("n").alias("n"))


def put_code(values: np.ndarray) -> tuple[bytes, bytes]:
    """Control and data bytes of unsigned integers below 2^32."""
    v = values.astype("<u4")
    extra = (v > 0xFF).astype(np.uint8) + (v > 0xFFFF) + (v > 0xFFFFFF)
    four = np.zeros(-(-len(v) // 4) * 4, dtype=np.uint8)
    four[:len(v)] = extra
    four = four.reshape(-1, 4)
    control = four[:, 0] | four[:, 1] << 2 | four[:, 2] << 4 | four[:, 3] << 6
    return control.astype(np.uint8).tobytes(), v.view(np.uint8).reshape(-1, 4)[np.arange(4) <= extra[:, None]].tobytes()


def get_code(control: np.ndarray, data: np.ndarray, n: int) -> np.ndarray:
    length = LENGTHS[control].reshape(-1)[:n]
    out = np.zeros((n, 4), dtype=np.uint8)
    out[np.arange(4) < length[:, None]] = data
    return out.reshape(-1).view("<u4")


def file_bytes(doc_ids: list, sizes: list[int], ranks: np.ndarray) -> bytes:
    null = np.array([x is None or x is pd.NA for x in doc_ids], dtype=np.uint8)
    ids = np.array([0 if z else int(x) for x, z in zip(doc_ids, null)], dtype="<i8")
    control, data = put_code(ranks)
    return b"".join([MAGIC, struct.pack("<qq", len(doc_ids), len(ranks)), ids.tobytes(), null.tobytes(),
                     np.array(sizes, dtype="<i8").tobytes(), control, data])


def parse_file(raw: bytes) -> tuple[np.ndarray, np.ndarray, np.ndarray, np.ndarray]:
    """doc_ids, their null flags, ids per document, ranks."""
    if raw[:8] != MAGIC:
        raise ValueError("not a token file")
    docs, n = struct.unpack_from("<qq", raw, 8)
    buf, at = np.frombuffer(raw, dtype=np.uint8), 24
    ids, at = buf[at:at + 8 * docs].view("<i8"), at + 8 * docs
    null, at = buf[at:at + docs], at + docs
    sizes, at = np.frombuffer(raw, dtype="<i8", count=docs, offset=at), at + 8 * docs
    control, at = buf[at:at + -(-n // 4)], at + -(-n // 4)
    return ids, null, sizes, get_code(control, buf[at:], n)


def write_files(tokens: DataFrame, by_rank: np.ndarray, folder: str, shard_ids: int, partitions: int) -> DataFrame:
    """Writes the files in ascending doc_id order (null first, equal doc_ids by content) and returns the manifest
    (part, seq, path, n_ids). `by_rank` has one entry per id of the vocabulary that occurs."""
    rank_of = np.zeros(int(by_rank.max()) + 1 if len(by_rank) else 1, dtype=np.uint32)
    rank_of[by_rank] = np.arange(len(by_rank))

    def write(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        part, seq, held, ids, raws, wide = TaskContext.get().partitionId(), 0, 0, [], [], 2
        fs, base = pafs.FileSystem.from_uri(folder)

        def flush():
            nonlocal seq, held, ids, raws
            sizes = [len(r) // wide for r in raws]
            ranks = rank_of[np.frombuffer(b"".join(raws), dtype=f"<u{wide}")]
            path = f"{base}/{part:06d}-{seq:05d}-{uuid.uuid4().hex}.tok"
            with fs.open_output_stream(path) as out:
                out.write(file_bytes(ids, sizes, ranks))
            row = pd.DataFrame({"part": [part], "seq": [seq], "path": [path], "n_ids": [held]})
            seq, held, ids, raws = seq + 1, 0, [], []
            return row

        for b in batches:
            for i, raw, w in zip(b["doc_id"].astype("Int64"), b["ids"], b["wide"]):
                wide = int(w)
                ids.append(i)
                raws.append(raw)
                held += len(raw) // wide
                if held >= shard_ids:
                    yield flush()
        if ids:
            yield flush()

    fs, base = pafs.FileSystem.from_uri(folder)
    fs.create_dir(base, recursive=True)
    ordered = tokens.repartitionByRange(partitions, "doc_id").sortWithinPartitions("doc_id", "ids")       # the sample holds doc_ids only
    return cut_lineage(ordered.mapInPandas(write, "part long, seq long, path string, n_ids long"))


def read_files(manifest: DataFrame, by_rank: np.ndarray, folder: str, partitions: int) -> DataFrame:
    """(doc_id, start, n_tokens, ids_crc32) of every document in the files of a manifest with `base`."""
    by_rank = by_rank.astype("<u4")

    def read(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        fs, _ = pafs.FileSystem.from_uri(folder)
        for b in batches:
            for path, base in zip(b["path"], b["base"]):
                with fs.open_input_stream(path) as f:
                    ids, null, sizes, ranks = parse_file(f.read())
                values, ends = by_rank[ranks], np.cumsum(sizes)
                yield pd.DataFrame({
                    "doc_id": pd.array(ids, dtype="Int64").copy() if not null.any() else pd.Series(ids).astype("Int64").mask(null.astype(bool)),
                    "start": int(base) + ends - sizes, "n_tokens": sizes,
                    "ids_crc32": [zlib.crc32(values[e - s:e].tobytes()) for s, e in zip(sizes, ends)]})

    return (manifest.repartition(partitions, "part", "seq").select("path", "base")
            .mapInPandas(read, "doc_id long, start long, n_tokens long, ids_crc32 long"))


def token_files(docs: DataFrame, tokenizer: str, end_id: int, shard_ids: int = 2_000_000) -> DataFrame:
    """Encode `docs` (doc_id, text; other columns are ignored) to files of about `shard_ids` ids in the shared
    folder and read them back: one row per document with doc_id, start, n_tokens and ids_crc32.

    Null and empty texts hold the end id alone. Rows that share a doc_id are documents of their own. A document
    is never split over files. No documents: no files and no rows."""
    spark = docs.sparkSession
    tokens = token_table(docs, tokenizer, end_id)
    counts = id_counts(tokens).orderBy(F.desc("n"), "id").toPandas()       # at most one row per id of the vocabulary
    by_rank = counts["id"].to_numpy(dtype=np.int64)
    parts = max(1, min(100_000, int(counts["n"].sum()) // (4 * shard_ids) + 1), int(spark.conf.get("spark.sql.shuffle.partitions")))
    folder = f"{shared_folder(spark)}/tokens-{uuid.uuid4().hex}"
    manifest = write_files(tokens, by_rank, folder, shard_ids, parts)
    based = running_total(manifest.withColumn("key", F.lit(0)), ["key"], F.floor(F.col("part") / 1000), ["part", "seq"], "n_ids", "upto")
    based = based.select("part", "seq", "path", (F.col("upto").cast("long") - F.col("n_ids")).alias("base"))
    return read_files(based, by_rank, folder, parts)


