"""Token files against the tokenizer applied to whole texts."""
import zlib

import numpy as np
import public_tokenizers
import pytest
from tokenizers import Tokenizer

from slatemill.llm.token_files import get_code, put_code, token_files

PATH = public_tokenizers.path("word_bpe_49k.json")
TEXTS = ["The cat's hat, isn't it?", None, "", "   \n\t ", "Ünïcode ÉCOLE ß straße ΣΑΣ İstanbul J̌ \x1c tab", "a b", "a b", "<|endoftext|> x", "<|ENDOFTEXT|> Up", "a<|StartOfText|>b<|startoftext|>",
         "!!! ... *** a,b.c 12,345 x@y.z", "日本語 テキスト ١٢٣", "word\x85next\xa0and more", "ONE! two& three", "don't DON'T 'sup", "long " * 30_000]


def brute(rows):
    tok, out, at = Tokenizer.from_file(PATH), [], 0
    for i, text in sorted(rows, key=lambda r: r[0]):
        ids = tok.encode(text or "", add_special_tokens=False).ids + [2]
        out.append((i, at, len(ids), zlib.crc32(np.array(ids, "<u4").tobytes())))
        at += len(ids)
    return out


@pytest.mark.parametrize("shard", [40, 1_000_000])
def test_files_hold_what_the_tokenizer_says(spark, shard):
    rows = [(1000 - 7 * i, t) for i, t in enumerate(TEXTS)]
    docs = spark.createDataFrame([(i, t, "zz", i) for i, t in rows], "doc_id long, text string, ids string, wide long").repartition(5)
    got = sorted(tuple(r) for r in token_files(docs, PATH, 2, shard_ids=shard).collect())
    assert got == brute(rows)


def test_repeated_and_null_doc_ids_and_no_rows(spark):
    docs = spark.createDataFrame([(None, "b"), (5, "x y"), (5, "x y"), (1, None)], "doc_id long, text string")
    got = sorted((tuple(r) for r in token_files(docs, PATH, 2).collect()), key=lambda r: r[1])
    assert [r[0] for r in got] == [None, 1, 5, 5] and [r[1] for r in got] == [0, 2, 3, 6]
    assert token_files(docs.limit(0), PATH, 2).collect() == []


def test_code_round_trip():
    v = np.array([0, 255, 256, 65535, 65536, 2**24 - 1, 2**24, 2**32 - 1, 7], dtype=np.uint32)
    for n in range(len(v) + 1):
        control, data = put_code(v[:n])
        assert (get_code(np.frombuffer(control, np.uint8), np.frombuffer(data, np.uint8), n) == v[:n]).all()
        assert len(control) == -(-n // 4)
