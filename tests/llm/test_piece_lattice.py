import hashlib
import re
import zlib
from itertools import combinations

import numpy as np
import pytest
import sentencepiece
from pyspark.sql import functions as F

from seasonlark.llm import piece_lattice as P

SCHEMA = "doc_id bigint, text string, chunk string, n int, ids string"


@pytest.fixture(scope="module")
def sp():
    return sentencepiece.SentencePieceProcessor(model_file=P.model_path())


def texts():
    rng = np.random.default_rng(8)
    out = [None, "", " ", "  ", "\n", "a", "hello  world", "é ﬁ ½ x\n y\tz", " lead", "trail ", P.META + "a", "日本語𝔘​", "²., ²,", "it's 12,345.67!!! ====" + "=" * 300, "<0x0A> <s> </s> <unk>", "thththth" * 40, "A_b__c ___ d²e"]
    alphabet = list("abcde  e.st,!-=_0159\n\té日" + P.META + "²") + ["the", "ing", " th", "er"]
    out += ["".join(rng.choice(alphabet, rng.integers(1, 40))) for _ in range(1200)]
    return out


def test_merge_fold_equals_the_library(spark, sp):
    rows = [(i, t, "c", 1, "x") for i, t in enumerate(texts())]
    docs = spark.createDataFrame(rows, SCHEMA).repartition(3)
    coded = P.encode(docs, P.model_path(), frequent=40)
    got = {r.doc_id: (r.ids, r.text) for r in P.decode(coded, P.model_path()).collect()}
    for i, t, *_ in rows:
        assert got[i][0] == sp.encode(t or ""), t
        assert got[i][1] == sp.decode(got[i][0]), t


def test_long_chunks_equal_the_library(spark, sp):
    """The fold over arrays of boundaries, for chunks of more than 61 characters."""
    rng = np.random.default_rng(5)
    letters = list("etaoinshrdlu") + ["the", "ing", "tion", "er"]
    rows = [(n, "".join(rng.choice(letters, n))) for n in [*range(55, 140), 700, 1500]] + [(9000, "=" * 5000), (9001, "漢字" * 400), (9002, "a" * 3000)]
    docs = spark.createDataFrame(rows, "doc_id bigint, text string").repartition(4)
    got = {r.doc_id: r.ids for r in P.encode(docs, P.model_path()).collect()}
    assert got == {i: sp.encode(t) for i, t in rows}


def test_chunks_by_bytes_are_those_of_the_pattern():
    m = P.Model(P.model_path())
    for t in texts():
        want = re.findall(m.chunk, " " + t.replace(P.META, " ")) if t else []
        assert P.chunks_of(t, m.chunk) == want


def test_chunks_of_one_hash_are_told_apart():
    table = P.ChunkTable(np.dtype("<u2"))
    h = np.array([7], np.uint64)
    table.add(h, np.frombuffer(b"abc", np.uint8), np.array([3]), np.array([1, 2], np.uint16), np.array([2]))
    raw = np.frombuffer(b"abcabdab", np.uint8)
    entries = table.find(np.array([7, 7, 7], np.uint64))
    assert entries.tolist() == [0, 0, 0]
    assert table.same(entries, raw, np.array([0, 3, 6]), np.array([3, 3, 2])).tolist() == [True, False, False]


def test_viterbi_fold_is_the_best_path(spark):
    pieces = {"a": (10, -1.0), "b": (11, -2.5), "ab": (12, -3.0), "ba": (13, -1.5), "aba": (14, -3.9), "bab": (15, -4.2)}
    table = P.piece_table(spark, pieces, "viterbi")
    words = ["a", "b", "ab", "aba", "abab", "bbab", "babab", "abxba", "xx", "ab" * 6]
    got = {r.chunk: r.ids for r in P.encode_chunks(spark.createDataFrame([(w,) for w in words], "chunk string"), table, 3, 1000, "viterbi").collect()}
    for w in words:
        best = None
        for k in range(len(w)):
            for cuts in combinations(range(1, len(w)), k):
                parts = [w[a:b] for a, b in zip((0, *cuts), (*cuts, len(w)), strict=True)]
                if all(p in pieces or len(p) == 1 for p in parts):
                    total = sum(pieces[p][1] if p in pieces else -14.2 for p in parts)
                    best = max(best or (-1e9,), (total, [pieces[p][0] if p in pieces else 1000 + ord(p) for p in parts]))
        assert got[w] == best[1], w


@pytest.mark.parametrize("fold", ["merge", "viterbi"])
def test_edges_are_compiled_before_they_are_collected(spark, fold):
    """An aggregate on objects interprets its argument, which took half of the time of all chunks."""
    chunks = spark.createDataFrame([("abab",)], "chunk string").repartition(2, "chunk")
    out = P.encode_chunks(chunks, P.piece_table(spark, {"a": (10, -1.0), "ab": (12, -3.0)}, fold), 2, 1000, fold)
    plan = out._jdf.queryExecution().optimizedPlan().toString()
    assert re.search(r"collect_list\(edge#\d+", plan) and not re.search(r"collect_list\((?!edge#)", plan)


def test_a_worker_keeps_one_copy_of_the_table():
    table = P.ChunkTable(np.dtype("<u2"))
    table.add(np.array([7], np.uint64), np.frombuffer(b"abc", np.uint8), np.array([3]), np.array([1, 2], np.uint16), np.array([2]))
    state = table.state()
    again = P.ChunkTable.of(state)
    assert set(state) == {"table"} and P.ChunkTable.of(state) is again
    assert again.find(np.array([7, 8], np.uint64)).tolist() == [0, -1] and again.gather(np.array([0]))[0].tolist() == [1, 2]


def test_the_piece_table_needs_no_python_workers(spark):
    """Rows of a list are unpickled by workers of their own, which every executor then holds beside the others."""
    table = P.piece_table(spark, {"a": (10, -1.0), "ab": (12, -3.0), "b": (11, -2.0)})
    assert "PythonRDD" not in table._jdf.rdd().toDebugString()
    assert table.schema.simpleString() == "struct<h:bigint,p:string,place:bigint,id:int,score:double,again:boolean>"
    assert {(r.p, r.place, r.id, r.score, r.again) for r in table.collect()} == {("a", 0, 10, -1.0, False), ("ab", 2, 12, -3.0, False), ("b", 1, 11, -2.0, False)}


def test_a_task_folds_a_bounded_share_of_the_frequent_chunks(spark, monkeypatch):
    """A task holds the edges of all its chunks: with 60,000 of them an executor's heap grew to its limit."""

    class Seen(Exception):
        pass

    def dealt(chunks, *_):
        raise Seen([r["n"] for r in chunks.groupBy(F.spark_partition_id()).agg(F.count("*").alias("n")).collect()])

    monkeypatch.setattr(P, "encode_chunks", dealt)
    words = ["".join("abcdefghij"[int(d)] for d in f"{i:05d}") for i in range(45_000)]
    with pytest.raises(Seen) as seen:
        P.encode(spark.createDataFrame([(1, " ".join(words)), (2, " ".join(words))], "doc_id bigint, text string"), P.model_path())
    assert sum(seen.value.args[0]) == 45_000 and max(seen.value.args[0]) < 25_000


def _encoded(spark):
    docs = spark.createDataFrame([(i, t) for i, t in enumerate(texts()[:300])], "doc_id bigint, text string").repartition(3)
    return {r.doc_id: r.ids for r in P.encode(docs, P.model_path(), frequent=200).collect()}


def test_the_chunk_table_does_not_pass_the_driver(spark, sp, monkeypatch):
    def refused(*_):
        raise AssertionError("the driver holds the table of chunks")

    monkeypatch.setattr(type(spark.range(0)), "toArrow", refused)
    monkeypatch.setattr(type(spark.sparkContext), "broadcast", refused)
    got = _encoded(spark)
    assert all(got[i] == sp.encode(t or "") for i, t in enumerate(texts()[:300]))


def test_the_chunk_table_where_arrow_cannot_open_the_folder(spark, sp, monkeypatch):
    class Unknown:
        @staticmethod
        def from_uri(uri):
            raise P.pa.ArrowInvalid(uri)

    monkeypatch.setattr(P.pyarrow.fs, "FileSystem", Unknown)
    got = _encoded(spark)
    assert all(got[i] == sp.encode(t or "") for i, t in enumerate(texts()[:300]))


def test_a_table_read_from_files(tmp_path, monkeypatch):
    monkeypatch.setattr(P, "READ_ROWS", 2)
    files = []
    for k, words in enumerate((["ab", "é", " the"], [], ["x" * 60, "q"])):
        files.append((tmp_path / f"{k} a.parquet").as_uri())
        P.pq.write_table(P.pa.table({"chunk": P.pa.array(words, P.pa.utf8()), "ids": P.pa.array([[len(w), 7][: 1 + len(w) % 2] for w in words], P.pa.list_(P.pa.int32()))}), tmp_path / f"{k} a.parquet")
    room = (5, 2 + 2 + 4 + 60 + 1, 1 + 2 + 1 + 1 + 2)
    table = P._read_table(tuple(files), np.dtype("<u2"), room)
    assert table is P._read_table(tuple(files), np.dtype("<u2"), room)
    assert (len(table.hash), len(table.bytes), len(table.ids)) == (table.size, table.n_bytes, table.all_ids) == room
    for w in ("ab", "é", " the", "x" * 60, "q"):
        raw = np.frombuffer(w.encode(), np.uint8)
        entry = table.find(P.hashes(raw, np.array([0]), np.array([len(raw)])))
        assert entry[0] >= 0 and table.same(entry, raw, np.array([0]), np.array([len(raw)])).all()
        assert table.gather(entry)[0].tolist() == [len(w), 7][: 1 + len(w) % 2]


def test_odd_rows(spark):
    docs = spark.createDataFrame([(None, "a b", "c", 1, "x"), (2, "x", "c", 1, "x"), (2, "x", None, None, None), (2, "other", "c", 1, "x")], SCHEMA)
    out = P.encode(docs, P.model_path(), frequent=1).collect()
    assert len(out) == 4 and sum(r.doc_id is None for r in out) == 1
    assert P.encode(docs.limit(0), P.model_path()).count() == 0
    named = P.encode(docs.withColumn("doc_id", F.concat(F.lit("d"), "doc_id")), P.model_path())
    assert {r.doc_id for r in named.collect()} == {None, "d2"}


def test_query_against_the_library(spark, sp):
    sf = "/root/testdata/sf0.001"
    docs = {r.doc_id: r.text for r in spark.read.parquet(f"{sf}/documents.parquet").collect()}
    out = P.op10_piece_lattice(spark, sf).collect()
    assert len(out) == len(docs)
    for r in out:
        ids = sp.encode(docs[r.doc_id])
        assert (r.n_tokens, r.ids_crc32) == (len(ids), zlib.crc32(" ".join(map(str, ids)).encode()))
        assert r.decoded_sha256 == hashlib.sha256(docs[r.doc_id].encode()).hexdigest()
