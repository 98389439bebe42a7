import sys
import unicodedata
import zlib

import numpy as np
import public_tokenizers
import pytest
from stipple.llm import tokens
from stipple.llm.common import filesystem, scratch_dir
from tokenizers import Tokenizer

PATH = public_tokenizers.path("word_bpe_49k.json")
TEXTS = [
    None, "", " \t\n", "The quick, brown fox's 12 jumps!", "Été à l'école — ÇA VA? ΣΊΣΥΦΟΣ İstanbul e\u0301te\u0301", "<|endoftext|> a<|startoftext|>b",
    "a\x1cb c\u00a0d\u2003e\x85f", "日本語 テスト 😀 naïve_snake_case", "x" * 3000 + " " + "é" * 500, "it's we'll 'd word.' (paren) a.b.c end*** it's' x''s don't' y_ z__a éa#' Ab&&& '' s'", "word " * 2000,
]


def expected(rows):
    t = Tokenizer.from_file(PATH)
    start, out = 0, []
    for doc_id, text in rows:
        ids = np.array([*t.encode(text or "", add_special_tokens=False).ids, 1], "<u4")
        out.append((doc_id, start, len(ids), zlib.crc32(ids.tobytes())))
        start += len(ids)
    return out


def test_equals_whole_text_encoding(spark):
    rows = [(7 * i - 20, x) for i, x in enumerate(TEXTS)]
    df = spark.createDataFrame([(x, d, "clash") for d, x in rows], "text string, doc_id long, start string").repartition(3)
    got = tokens.encode_documents(df).select("doc_id", "start", "n_tokens", "ids_crc32").collect()
    assert sorted(map(tuple, got)) == expected(rows)


def test_whole_table(spark, sf_dir):
    docs = spark.read.parquet(f"{sf_dir}/documents.parquet")
    got = tokens.query(spark, sf_dir).select("doc_id", "start", "n_tokens", "ids_crc32").collect()
    assert sorted(map(tuple, got)) == expected(sorted((r.doc_id, r.text) for r in docs.select("doc_id", "text").collect()))


def test_null_ids_repeats_and_empty_table(spark):
    df = spark.createDataFrame([(None, "b"), (3, "x y"), (3, "x y"), (1, None)], "doc_id long, text string")
    got = sorted((r.start, r.doc_id, r.n_tokens) for r in tokens.encode_documents(df).collect())
    assert got == [(0, None, 2), (2, 1, 1), (3, 3, 3), (6, 3, 3)]
    assert tokens.encode_documents(df.limit(0)).collect() == []


def test_index_serves_any_order_and_damage_is_found(spark):
    uri = scratch_dir(spark, "t")
    df = spark.createDataFrame([(i, "w " * i) for i in range(50)], "doc_id long, text string")
    shard = tokens.write_shards(df, uri, PATH, partitions=1).first()["shard"]
    got = list(tokens.read_shuffled(uri, shard, seed=5))
    assert sorted(d for d, _ in got) == list(range(50)) and [d for d, _ in got] != list(range(50))
    assert all(len(ids) == d + 1 for d, ids in got)
    fs, path = filesystem(uri)
    name = f"{path}/{shard}.rec"
    data = bytearray(open(name, "rb").read())
    data[-6] ^= 1
    open(name, "wb").write(data)
    with pytest.raises(ValueError, match="damaged"):
        list(tokens.read_shuffled(uri, shard, seed=5))


def test_cache_generations(spark):
    cache = tokens.PieceCache(Tokenizer.from_file(PATH), "<u2", limit=3)
    text = "one two three four five one two"
    assert cache.text(text) == cache.whole(text) and len(cache) <= 3


def test_every_letter_mark_and_number_beside_marks():
    """Pieces agree with whole-text encoding wherever composing or lower-casing changes what counts as a letter."""
    cache = tokens.PieceCache(Tokenizer.from_file(PATH), "<u4")
    chars = [c for i in range(sys.maxunicode) if unicodedata.category(c := chr(i))[0] in "LMN"]
    for form in ("{}.", "ab{},", "{}'s", "KAD{}i' x"):
        texts = [form.format(c) for c in chars]
        want = cache.tokenizer.encode_batch(texts, add_special_tokens=False)
        assert [t for t, w in zip(texts, want) if np.frombuffer(cache.text(t), "<u4").tolist() != w.ids] == []
