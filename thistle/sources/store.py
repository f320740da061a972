"""A graph on shared storage, in versions: readers keep what they read while a new version is written."""

from __future__ import annotations

import json
from math import ceil

from pyspark.sql import DataFrame, SparkSession, functions as F

from ..plans.ast import QueryError
from . import writers

STATEMENT = ["s", "p", "o"]


class Store:
    """Folders v0, v1, ... with tables; a version counts once its _DONE marker is there, and the highest such version is current.

    A version is either whole or a change of the one before: the statements added or removed, nothing else is written. compact() makes the
    current one whole. Statements are split into folders by a hash of the predicate (`spread` of them) and sorted by predicate and subject
    within files, so that a predicate's scan reads one folder and skips row groups; a folder for each predicate would not bound their number.
    """

    def __init__(self, spark: SparkSession, path: str, spread: int = 32, rows_per_task: int = 5_000_000):
        self.spark, self.path, self.spread, self.rows_per_task = spark, path.rstrip("/"), spread, rows_per_task

    def _fs(self):
        jvm = self.spark.sparkContext._jvm
        p = jvm.org.apache.hadoop.fs.Path(self.path)
        return p.getFileSystem(self.spark.sparkContext._jsc.hadoopConfiguration()), jvm.org.apache.hadoop.fs.Path

    def _names(self) -> list[int]:
        fs, path = self._fs()
        root = path(self.path)
        names = [s.getPath().getName() for s in fs.listStatus(root)] if fs.exists(root) else []
        return sorted(int(n[1:]) for n in names if n[:1] == "v" and n[1:].isdigit())

    def versions(self) -> list[int]:
        fs, path = self._fs()
        return [v for v in self._names() if fs.exists(path(f"{self.path}/v{v}/_DONE"))]

    def _note(self, version: int) -> dict:
        fs, path = self._fs()
        stream = fs.open(path(f"{self.path}/v{version}/_DONE"))
        try:
            return json.loads(bytes(stream.readAllBytes()).decode())
        finally:
            stream.close()

    def _bucket(self, p) -> object:
        return F.pmod(F.xxhash64(p), F.lit(self.spread)).cast("int")

    def _put(self, version: int, kind: str, rows: DataFrame, n: int, parent: int | None, **tables: DataFrame) -> int:
        to = f"{self.path}/v{version}"
        fs, path = self._fs()
        fs.delete(path(to), True)  # what an earlier attempt left
        # a predicate with a third of all rows is spread over as many tasks as its size asks for
        salts = max(1, ceil(n / self.rows_per_task))
        rows = rows.withColumn("bucket", self._bucket(F.col("p"))).repartition("bucket", F.pmod(F.xxhash64("s"), F.lit(salts))).sortWithinPartitions("p", "s")
        rows.write.mode("overwrite").partitionBy("bucket").option("compression", "zstd").parquet(f"{to}/{kind}")
        for name, df in tables.items():
            df.write.mode("overwrite").parquet(f"{to}/{name}")
        stream = fs.create(path(f"{to}/_DONE"))
        stream.write(bytearray(json.dumps({"kind": kind, "rows": n, "parent": parent, "tables": sorted(tables)}).encode()))
        stream.close()
        return version

    def write(self, triples: DataFrame, **tables: DataFrame) -> int:
        """A new whole version; its number. What an earlier attempt left under that number is replaced."""
        rows = triples.select(*STATEMENT).distinct()
        return self._put(max(self.versions(), default=-1) + 1, "triples", rows, rows.count(), None, **tables)

    def _chain(self, version: int | None) -> list[tuple[int, dict]]:
        """The whole version a version goes back to, and the changes since."""
        have = self.versions()
        v = version if version is not None else max(have, default=None)
        chain = []
        while True:
            if v not in have:
                raise QueryError(f"no version {v} in {self.path}")
            note = self._note(v)
            chain.append((v, note))
            if note["parent"] is None:
                return chain[::-1]
            v = note["parent"]

    def triples(self, version: int | None = None, predicate: str | None = None) -> DataFrame:
        out = None
        for v, note in self._chain(version):
            df = self.spark.read.schema("s string, p string, o string, bucket int").parquet(f"{self.path}/v{v}/{note['kind']}")
            if predicate is not None:
                df = df.where((F.col("bucket") == self._bucket(F.lit(predicate))) & (F.col("p") == predicate))
            df = df.select(*STATEMENT)
            out = df if note["kind"] == "triples" else out.unionByName(df) if note["kind"] == "added" else out.join(df, STATEMENT, "left_anti")
        return out

    def table(self, name: str, version: int | None = None) -> DataFrame:
        """A further table, as the last whole or changed version up to this one has it."""
        for v, note in reversed(self._chain(version)):
            if name in note["tables"]:
                return self.spark.read.parquet(f"{self.path}/v{v}/{name}")
        raise QueryError(f"no table {name} in {self.path}")

    def insert(self, triples: DataFrame) -> tuple[int, int]:
        """(new statements, duplicates); a version with the new ones alone, if there are any."""
        rows = triples.select(*STATEMENT)
        total = rows.count()
        have = self.versions()
        if not have:
            self.write(rows)
            return (n := self._note(0)["rows"]), total - n
        new = rows.distinct().join(self.triples(), STATEMENT, "left_anti")
        n = new.count()
        if n:
            self._put(have[-1] + 1, "added", new, n, have[-1])
        return n, total - n

    def delete(self, triples: DataFrame) -> int:
        """The number of statements that were there; a version with these alone, as tombstones, if there are any."""
        gone = self.triples().join(triples.select(*STATEMENT).distinct(), STATEMENT, "left_semi").distinct()
        n = gone.count()
        if n:
            have = self.versions()
            self._put(have[-1] + 1, "removed", gone, n, have[-1])
        return n

    def clear(self) -> None:
        self.write(self.spark.createDataFrame([], "s string, p string, o string"))

    def replace(self, triples: DataFrame) -> int:
        """The number of statements; whatever was there is no longer current."""
        return self._note(self.write(triples))["rows"]

    def export(self, kind: str = "ntriples", version: int | None = None) -> DataFrame:
        """(value): the statements as lines of N-Triples or blocks of Turtle."""
        return {"ntriples": writers.ntriples, "turtle": writers.turtle}[kind](self.triples(version))

    def verify(self) -> DataFrame:
        """(version, kind, expected, found, ok): each version's folder against what its marker says; without a marker it is not ok."""
        rows = []
        done = set(self.versions())
        for v in self._names():
            if v not in done:
                rows.append((v, None, None, None, False))
                continue
            note = self._note(v)
            try:
                found = self.spark.read.schema("s string, p string, o string, bucket int").parquet(f"{self.path}/v{v}/{note['kind']}").count()
            except Exception:
                found = -1 if note["rows"] else 0
            rows.append((v, note["kind"], note["rows"], found, found == note["rows"] and (note["parent"] is None or note["parent"] in done)))
        return self.spark.createDataFrame(rows, "version int, kind string, expected long, found long, ok boolean")

    def repair(self) -> list[int]:
        """Removes versions that aren't ok and those that go back to one; their numbers. The last good one is current again."""
        fs, path = self._fs()
        bad = {r["version"] for r in self.verify().where("not ok").collect()}
        for v in self.versions():
            if v not in bad and self._note(v)["parent"] in bad:
                bad.add(v)
        for v in bad:
            fs.delete(path(f"{self.path}/v{v}"), True)
        return sorted(bad)

    def compact(self, keep: int = 1) -> list[int]:
        """Makes the current version whole and removes all but the last `keep` and those they go back to; the numbers removed."""
        have = self.versions()
        if keep and have and self._note(have[-1])["parent"] is not None:
            tables = {n: self.table(n) for v, note in self._chain(None) for n in note["tables"]}
            self.write(self.triples(), **tables)
            have = self.versions()
        needed = {v for last in (have[-keep:] if keep else []) for v, _ in self._chain(last)}
        old = [v for v in have if v not in needed]
        fs, path = self._fs()
        for v in old:
            fs.delete(path(f"{self.path}/v{v}"), True)
        return old
