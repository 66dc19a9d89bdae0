import random
import zlib

import numpy as np
import public_tokenizers
import pyarrow as pa
from hypothesis import given, settings
from hypothesis import strategies as st
from tokenizers import Tokenizer

from tessera.llm import tokenfile

PATH = public_tokenizers.path("word_bpe_49k.json")


@settings(max_examples=200, deadline=None)
@given(st.lists(st.one_of(st.integers(0, 3), st.integers(0, 50_000), st.integers(0, 2**32 - 1), st.integers(2**59, 2**63 - 1))))
def test_round_trip(values):
    words, escapes = tokenfile.pack(np.array(values, dtype=np.uint64))
    assert tokenfile.unpack(words, escapes, len(values)).tolist() == values


def test_small_ids_share_words():
    words, _ = tokenfile.pack(np.ones(600, dtype=np.uint64))
    assert len(words) == 80


def test_words_alone_encode_like_whole_texts():
    rng = random.Random(2)
    pieces = ["Hello", "<|endoftext|>", "x<|startoftext|>y", "ΟΔΟΣ", "é", "́", "a\x1cb", " ", "it's", "12,5", "a b", "É", "\x0b", "", "we'LL", "日本", "STRAßE.", "İx", "\u212a", "Àé!?", "a.b", "don't.", "x\\\\"]
    encoder, whole = tokenfile.WordEncoder(PATH, words=5), Tokenizer.from_file(PATH)
    for _ in range(100):
        texts = ["".join(rng.choice(pieces) + rng.choice([" ", "", "\n", "\t", "  ", "\r\n"]) for _ in range(rng.randint(0, 12))) for _ in range(6)]
        ids, counts = encoder.texts(pa.array(texts)[1:], 2)
        want = [whole.encode(t, add_special_tokens=False).ids + [2] for t in texts[1:]]
        assert counts.tolist() == list(map(len, want)) and ids.tolist() == sum(want, []), texts


def plain(rows):
    whole, out, start = Tokenizer.from_file(PATH), [], 0
    for i, t in sorted(((i, t or "") for i, t, *_ in rows), key=lambda r: (r[0] is not None, r[0] or 0, r[1])):
        ids = whole.encode(t, add_special_tokens=False).ids + [2]
        out.append((i, start, len(ids), zlib.crc32(np.array(ids, dtype="<u4").tobytes())))
        start += len(ids)
    return out


def run(spark, tmp_path, rows, schema, **kw):
    path = f"file://{tmp_path}/t"
    tokenfile.write(spark.createDataFrame(rows, schema), path, PATH, **kw)
    return [tuple(r) for r in tokenfile.read(spark, path).collect()]


def test_table(spark, sf, tmp_path):
    rows = [(r.doc_id, r.text) for r in spark.read.parquet(f"{sf}/documents.parquet").collect()]
    assert sorted(run(spark, tmp_path, rows, "doc_id long, text string", block_ids=500, shards=5)) == plain(rows)


def test_edges(spark, tmp_path):
    rows = [(3, None, 1), (3, "b b", 1), (3, "b b", 2), (1, "", None), (None, "lost", 0), (9, "word " * 20000, 0)]
    key = lambda r: r[1]
    got = sorted(run(spark, tmp_path, rows, "doc_id long, text string, shard int"), key=key)
    assert got == plain(rows)
    assert run(spark, tmp_path, [], "doc_id long, text string") == []
