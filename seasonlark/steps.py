"""Named intermediate tables that outlive a run: built once for given inputs and parameters, then read.

A step lies under ``<folder>/<name>/<fingerprint>``.  Its rows are written to a folder of their own first; a
marker file, created only after that write has ended and only if there is none, names that folder, so a
half-written step has no marker and is never read, and of two builders at once the first counts.
"""

from __future__ import annotations

import hashlib
import json
import re
import time
import uuid
from collections.abc import Callable

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql import types as T

from seasonlark.scratch import shared_dir

MARKER = "_built.json"


class Steps:
    """The steps of one folder, by default ``steps`` in the shared folder of the session."""

    def __init__(self, spark: SparkSession, folder: str | None = None, stale_after: float = 60.0):
        """A marker that cannot be read is another builder's at work, and after ``stale_after`` seconds a lost one's."""
        self.spark, self.stale_after = spark, stale_after
        self.folder = (folder or f"{shared_dir(spark)}/steps").rstrip("/")

    def _at(self, path: str):
        """The file system of a path, and the path, as Hadoop knows them."""
        sc = self.spark.sparkContext
        p = sc._jvm.org.apache.hadoop.fs.Path(path)
        return p.getFileSystem(sc._jsc.hadoopConfiguration()), p

    def _children(self, path: str) -> list[str]:
        fs, p = self._at(path)
        return sorted(str(s.getPath().toString()) for s in fs.listStatus(p)) if fs.exists(p) else []

    def inputs(self, paths: list[str]) -> list:
        """Names, sizes and times of all files under ``paths``, reduced to three numbers by Spark; no file is opened."""
        if not paths:
            return []
        files = self.spark.read.format("binaryFile").option("recursiveFileLookup", True).load(paths)
        h = F.xxhash64("path", "length", F.unix_micros("modificationTime"))
        return list(files.agg(F.count("*"), F.coalesce(F.sum("length"), F.lit(0)), F.coalesce(F.bit_xor(h), F.lit(0))).first())

    def fingerprint(self, name: str, inputs: list[str], params: dict, version: str) -> str:
        """What a step depends on, as 32 hexadecimal digits; parameters are JSON values, their order does not matter."""
        if not re.fullmatch(r"[A-Za-z0-9][\w.-]*", name):
            raise ValueError(f"name {name!r}")
        told = json.dumps([name, version, sorted(inputs), self.inputs(inputs), params], sort_keys=True)
        return hashlib.sha256(told.encode()).hexdigest()[:32]

    def _marker(self, home: str) -> dict | None:
        fs, p = self._at(f"{home}/{MARKER}")
        if not fs.exists(p):
            return None
        stream = fs.open(p)
        try:
            told = bytes(self.spark.sparkContext._jvm.org.apache.commons.io.IOUtils.toByteArray(stream)).decode()
        finally:
            stream.close()
        try:
            return json.loads(told)
        except ValueError:
            return None

    def _mark(self, home: str, told: dict) -> bool:
        """Create the marker; False if there is one."""
        fs, p = self._at(f"{home}/{MARKER}")
        if fs.exists(p) and self._marker(home) is None and time.time() - fs.getFileStatus(p).getModificationTime() / 1000 >= self.stale_after:
            fs.delete(p, False)
        try:
            stream = fs.create(p, False)
        except Exception as e:
            if "already exists" in str(e) or "FileAlreadyExists" in str(e):
                return False
            raise
        stream.write(bytearray(json.dumps(told).encode()))
        stream.close()
        return True

    def _delete(self, path: str) -> None:
        fs, p = self._at(path)
        fs.delete(p, True)

    def get(self, name: str, build: Callable[[], DataFrame], inputs: list[str] = (), params: dict | None = None, version: str = "1") -> DataFrame:
        """The step's table: read if it was built for these input files, parameters and version, else built, written and read.

        inputs: paths of files or folders that the step reads; a file that is added, removed, rewritten or touched rebuilds it.
        version: to be changed with the code of ``build``.
        """
        home = f"{self.folder}/{name}/{self.fingerprint(name, list(inputs), params or {}, version)}"
        told = self._marker(home)
        if told is None:
            rows = build()
            data = f"rows-{uuid.uuid4().hex}"
            schema = rows.schema
            rows.write.parquet(f"{home}/{data}")
            told = {"data": data, "schema": schema.json(), "at": time.time()}
            if not self._mark(home, told) and (first := self._marker(home)):
                self._delete(f"{home}/{data}")
                told = first
        return self.spark.read.schema(T.StructType.fromJson(json.loads(told["schema"]))).parquet(f"{home}/{told['data']}")

    def evict(self, name: str, keep: int = 1, unfinished_after: float = 86_400.0) -> int:
        """Delete all but the ``keep`` newest builds of a step, and unmarked folders older than ``unfinished_after`` seconds; how many went.

        Nothing may read what goes.
        """
        built, gone = [], 0
        for home in self._children(f"{self.folder}/{name}"):
            told = self._marker(home)
            if told is not None:
                built.append((told["at"], home))
            else:
                fs, p = self._at(home)
                if time.time() - fs.getFileStatus(p).getModificationTime() / 1000 >= unfinished_after:
                    self._delete(home)
                    gone += 1
        for _, home in sorted(built, reverse=True)[keep:]:
            self._delete(home)
            gone += 1
        return gone
