import io
import zlib

import numpy as np
import public_tokenizers
import pyarrow as pa
import pytest
from tokenizers import Tokenizer

from seasonlark.llm import token_shards as S
from seasonlark.scratch import new_path

PATH = public_tokenizers.path("byte_bpe_50k.json")
SCHEMA = "doc_id bigint, text string, path string, shard int, ids string"


@pytest.fixture(scope="module")
def tok():
    return Tokenizer.from_file(PATH)


def test_encoder_equals_the_library(tok):
    rng = np.random.default_rng(2)
    alphabet = list("ab Z9.'s\n\t  \r\x0b\x1c\x85\xa0é日𝔘\0 ,!-") + ["don't", " 's", "<|endoftext|>"]
    texts = ["", " ", "\n", "a", " a b", "a b\nc", "it's\nso 12 ab3", "a ", "a\n", "\na b", "x  y", "a \nb", "z" * 3000 + " " + "q9" * 700]
    texts += ["".join(rng.choice(alphabet, rng.integers(1, 14))) for _ in range(4000)]
    enc = S.Encoder(PATH, 0)
    got = [np.frombuffer(x, enc.type).tolist() for x in enc.encode(texts)]
    assert got == [[*tok.encode(t, add_special_tokens=False).ids, 0] for t in texts]


def test_shard_round_trip_and_lookup():
    rows = [(None, b"\x01\x02"), (-5, b""), (0, b"ab" * 9)] + [(i * 3, bytes([i % 250, 1]) * (i * 3)) for i in range(1, 400)] + [(5000, b"xy"), (5000, b"zz")]
    out = io.BytesIO()
    w = S.ShardWriter(out, 2)
    for k, v in rows:
        w.add(S.key_of(k), v)
    w.close()
    r = S.ShardReader(pa.BufferReader(out.getvalue()))
    assert len(r.blocks) > 3 and [(S.id_of(k), v) for k, _, v in r] == rows
    starts = [b for _, b, _ in r]
    assert starts == [sum(len(v) // 2 for _, v in rows[:i]) for i in range(len(rows))]
    assert all(v in r.get(S.key_of(k)) for k, v in rows) and len(r.get(S.key_of(5000))) == 2
    assert r.get(S.key_of(1)) == r.get(S.key_of(10**12)) == []
    with pytest.raises(ValueError):
        w.add(S.key_of(-9), b"")


def test_odd_rows(spark):
    folder = new_path(spark, "t")
    rows = [(None, "a b", "p", 1, "i"), (2, None, "p", 1, "i"), (2, "x", "p", 1, "i"), (2, "x", None, None, None), (-7, "long " * 30000, "p", 1, "i")]
    m = S.write_shards(spark.createDataFrame(rows, SCHEMA), folder, PATH)
    out = S.read_shards(spark, m, folder).collect()
    assert sorted((r.doc_id is not None, r.doc_id or 0, r.n_tokens) for r in out) == [(False, 0, 3), (True, -7, 30002), (True, 2, 1), (True, 2, 2), (True, 2, 2)]
    assert sum(r.n_tokens for r in out) == max(r.start + r.n_tokens for r in out)
    found = S.lookup(spark, m, folder, spark.createDataFrame([(2,), (None,), (44,)], "doc_id bigint")).collect()
    assert sorted((r.doc_id is None, len(r.ids)) for r in found) == [(False, 1), (False, 2), (False, 2), (True, 3)]
    empty = spark.createDataFrame([], SCHEMA)
    folder = new_path(spark, "t")
    assert S.read_shards(spark, S.write_shards(empty, folder, PATH), folder).count() == 0


def test_query_against_brute_force(spark, tok):
    sf = "/root/testdata/sf0.001"
    docs = sorted((r.doc_id, r.text) for r in spark.read.parquet(f"{sf}/documents.parquet").collect())
    want, start = {}, 0
    for i, t in docs:
        ids = [*tok.encode(t, add_special_tokens=False).ids, 0]
        want[i] = (start, len(ids), zlib.crc32(np.array(ids, "<u4").tobytes()))
        start += len(ids)
    got = S.op9_token_shards(spark, sf).collect()
    assert {r.doc_id: (r.start, r.n_tokens, r.ids_crc32) for r in got} == want and len(got) == len(docs)


def test_added_tokens_are_the_librarys_own():
    """Texts with an added token's string get its id, as the library gives by default."""
    default = Tokenizer.from_file(PATH)
    texts = ["a <|endoftext|> b", "<|endoftext|>", "x<|endoftext|>\ny", "a  <|endoftext|>", "<|endoftext|", "plain words\nand lines"]
    enc = S.Encoder(PATH, 0)
    got = [np.frombuffer(x, enc.type).tolist() for x in enc.encode(texts)]
    assert got == [[*default.encode(t, add_special_tokens=False).ids, 0] for t in texts]
    assert 50256 in got[0]


def test_hash_collisions_change_no_ids(monkeypatch, tok):
    """Hits are compared byte by byte: with one hash for all chunks of a length, the ids stay right."""
    monkeypatch.setattr(S, "hashes", lambda raw, starts, lengths: lengths.astype(np.uint64) << np.uint64(40))
    texts = ["one two", "six ten. ten", "two one six", "abc abd abe"]
    enc = S.Encoder(PATH, 0)
    for _ in range(2):
        assert [np.frombuffer(x, enc.type).tolist() for x in enc.encode(texts)] == [[*tok.encode(t, add_special_tokens=False).ids, 0] for t in texts]
