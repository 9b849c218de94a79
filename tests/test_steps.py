"""Stored steps: built once, rebuilt on change, never read half-written."""

import json
import os

import pytest
from pyspark.sql import functions as F

from seasonlark.steps import MARKER, Steps


@pytest.fixture
def place(spark, tmp_path):
    spark.range(10).write.parquet(str(tmp_path / "in"))
    return Steps(spark, f"file://{tmp_path}/steps"), str(tmp_path / "in"), tmp_path


def test_built_once_and_rebuilt_on_change(spark, place):
    steps, src, tmp = place
    calls = []

    def build():
        calls.append(1)
        return spark.read.parquet(src).agg(F.sum("id").alias("s"), F.lit(None).cast("string").alias("x"))

    get = lambda **kw: steps.get("sum", build, [src], **kw).collect()
    assert get()[0].s == 45 and get()[0].s == 45 and len(calls) == 1
    assert get(params={"a": 1, "b": [2]})[0].s == 45 and get(params={"b": [2], "a": 1}) and len(calls) == 2
    assert get(version="2") and len(calls) == 3
    spark.range(10, 11).write.mode("append").parquet(src)
    assert get()[0].s == 55 and get()[0].s == 55 and len(calls) == 4
    assert steps.evict("sum", keep=1) == 3 and get()[0].s == 55 and len(calls) == 4
    assert steps.evict("unknown") == 0
    with pytest.raises(ValueError, match="name"):
        steps.get("../x", build)


def test_half_written_steps_are_not_read(spark, place):
    steps, src, tmp = place

    def broken():
        return spark.read.parquet(src).select(F.when(F.col("id") > 5, F.raise_error(F.lit("lost"))).otherwise(F.col("id")).alias("id"))

    with pytest.raises(Exception, match="lost"):
        steps.get("rows", broken, [src])
    assert steps.get("rows", lambda: spark.read.parquet(src), [src]).count() == 10
    home = next((tmp / "steps/rows").iterdir())
    # an unreadable marker is left alone while it is fresh, then its writer counts as lost
    (home / MARKER).write_text('{"da')
    crc = home / f".{MARKER}.crc"
    if crc.exists():
        os.remove(crc)
    assert steps.get("rows", lambda: spark.read.parquet(src).limit(1), [src]).count() == 1 and (home / MARKER).read_text() == '{"da'
    steps.stale_after = 0
    assert steps.get("rows", lambda: spark.read.parquet(src).limit(0), [src]).count() == 0
    assert steps.get("rows", lambda: spark.read.parquet(src), [src]).count() == 0
    steps.get("other", lambda: spark.range(1), [])
    os.makedirs(tmp / "steps/other/abandoned/rows-1")
    assert steps.evict("other", keep=1) == 0 and steps.evict("other", keep=1, unfinished_after=0) == 1


def test_first_of_two_builders_counts(spark, place):
    steps, src, _ = place
    seen = {}

    def slow():
        seen["fast"] = steps.get("race", lambda: spark.range(3), [src]).count()
        return spark.range(5)

    assert steps.get("race", slow, [src]).count() == 3 == seen["fast"]
    home = f"{steps.folder}/race/{steps.fingerprint('race', [src], {}, '1')}"
    assert len([c for c in steps._children(home) if "rows-" in c]) == 1 and json.dumps(steps._marker(home))


def test_empty_and_odd_columns(spark, place):
    steps, src, _ = place
    for _ in range(2):
        got = steps.get("empty", lambda: spark.createDataFrame([], "`a b` int, c struct<d: array<string>>"), [])
        assert got.columns == ["a b", "c"] and got.count() == 0
