import random
import uuid
import zlib
from collections import Counter, defaultdict

import pytest

from seasonlark.llm import virtual_slots as V

SF = "/root/testdata/sf0.001"


def folder():
    return f"file:///tmp/spark-tests/{uuid.uuid4().hex}"


def check(rows, want):
    """Sizes and checksums as in ``want`` [(id, text)], places without gaps, loads returned."""
    got = Counter((r.doc_id, r.size, r.text_crc32) for r in rows)
    assert got == Counter((i, len((t or "").encode()) + 1, zlib.crc32((t or "").encode())) for i, t in want)
    places, loads = defaultdict(list), Counter()
    for r in rows:
        places[r.shard].append(r.slot)
        loads[r.shard] += r.size
    for p in places.values():
        assert sorted(p) == list(range(len(p)))
    assert set(places) <= set(range(V.SHARDS))
    return loads


def test_query(spark):
    rows = V.op11_virtual_slots(spark, SF).collect()
    want = [(r.doc_id, r.text) for r in spark.read.parquet(f"{SF}/documents.parquet").collect()]
    loads = check(rows, want)
    assert max(loads.values()) <= 1.02 * sum(loads.values()) / 8
    assert {r.law for r in rows} == {"bytes"} and {r.grown_shard for r in rows} == {None}


def greedy(slot_map, loads, shards):
    """The edit of the map in plain Python."""
    share = sum(loads.values()) / shards
    out, held, gone = {}, [0] * shards, []
    for s in range(shards):
        run = 0
        for v in sorted((v for v in slot_map if slot_map[v] == s), key=lambda v: (-loads[v], v)):
            run += loads[v]
            if run <= share:
                out[v] = s
                held[s] += loads[v]
            else:
                gone.append(v)
    for v in sorted(gone, key=lambda v: (-loads[v], v)):
        out[v] = held.index(min(held))
        held[out[v]] += loads[v]
    return out


@pytest.mark.parametrize("seed", range(3))
def test_rebalance_equals_plain_loop(spark, seed):
    rnd = random.Random(seed)
    n, shards = 60, 5
    loads = {v: rnd.choice([0, 1, 5, 5, 40, 900 if seed == 2 else 60]) for v in range(n)}
    start = {v: rnd.randrange(shards) for v in range(n)}
    m = spark.createDataFrame(list(start.items()), "virtual_slot int, shard int")
    t = spark.createDataFrame([(v, 1, b) for v, b in loads.items()], "virtual_slot int, n_rows long, n_bytes long")
    assert dict(map(tuple, V.rebalance(m, t, shards).collect())) == greedy(start, loads, shards)
    grown = dict(map(tuple, V.grow(m, t, shards).collect()))
    assert set(grown) == set(start) and all(s in (start[v], shards) for v, s in grown.items())
    kept = Counter()
    for v, s in grown.items():
        kept[s] += loads[v]
    assert all(kept[s] <= sum(loads.values()) / (shards + 1) for s in range(shards))


def test_versions_stay(spark):
    path = folder()
    V.save_map(V.initial_map(spark, 16, 4), path, 1)
    V.save_map(V.initial_map(spark, 16, 2), path, 2)
    with pytest.raises(Exception, match="(?i)exists"):
        V.save_map(V.initial_map(spark, 16, 8), path, 2)
    assert {r.shard for r in V.load_map(spark, path).collect()} == {0, 1}
    assert {r.shard for r in V.load_map(spark, path, 1).collect()} == {0, 1, 2, 3}


def test_odd_rows(spark):
    rows = [(1, "a"), (1, "a"), (1, "b"), (None, None), (None, None), (None, "é" * 9), (2, ""), (3, "x" * 200_000), *[(k, "same") for k in range(10, 400)], *[(None, f"t{k}") for k in range(300)]]
    docs = spark.createDataFrame([(i, t, 7, "s") for i, t in rows], "doc_id long, text string, size int, shard string")
    out = V.sharded(docs, folder()).collect()
    loads = check(out, rows)
    assert loads.most_common(1)[0][1] >= 200_001 and len({r.shard for r in out if r.doc_id is None}) > 4
    assert V.sharded(docs.limit(0), folder()).collect() == []


def test_plan_has_no_python(spark):
    plan = V.op11_virtual_slots(spark, SF)._jdf.queryExecution().toString()
    assert "Python" not in plan and "Arrow" not in plan
