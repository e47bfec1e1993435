"""State of a stream in tables: parts that are read and written on their own, and a manifest for each batch.

A batch writes new files of the parts it touches below its own number, then its manifest, which says of every
part which batches' files it consists of. A batch that runs again starts from the manifest before it and writes
over what it left, so a restart at any point gives the same state. Nothing is kept in memory between batches.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

from grainmill.checkpoints import delete


def part_of(key: Column, parts: int) -> Column:
    return F.pmod(F.xxhash64(key), F.lit(parts)).cast("int")


class Store:
    """Tables below ``folder`` as the batches before ``number`` left them; with no number, as the last batch did."""

    def __init__(self, spark: SparkSession, folder: str, number: int | None = None, most_files: int = 16):
        self.spark, self.folder, self.number, self.most_files = spark, folder.rstrip("/"), number, most_files
        #: (table, part) to the batches that hold its files.
        self.parts: dict[tuple[str, int], list[int]] = {}
        done = [n for n in self._manifests() if number is None or n < number]
        if done:
            for r in self._manifest(max(done)).collect():  # a row for each part of the tables
                self.parts[r.name, r.part] = list(r.batches)

    def _fs(self, path: str):
        p = self.spark.sparkContext._jvm.org.apache.hadoop.fs.Path(path)
        return p.getFileSystem(self.spark.sparkContext._jsc.hadoopConfiguration()), p

    def _manifests(self) -> list[int]:
        fs, p = self._fs(f"{self.folder}/manifest")
        if not fs.exists(p):
            return []
        names = [f.getPath().getName() for f in fs.listStatus(p)]
        whole = lambda n: fs.exists(self._fs(f"{self.folder}/manifest/{n}/_SUCCESS")[1])
        return [int(n.removeprefix("n=")) for n in names if n.startswith("n=") and whole(n)]

    def _manifest(self, number: int) -> DataFrame:
        return self.spark.read.schema("name string, part int, batches array<int>").parquet(f"{self.folder}/manifest/n={number}")

    def read(self, name: str, schema: str, parts: list[int] | None = None) -> DataFrame:
        """The rows of a table, or of some of its parts only; other parts' files aren't opened."""
        files = [f"{self.folder}/{name}/n={n}/part={p}" for (t, p), batches in sorted(self.parts.items()) if t == name and (parts is None or p in parts) for n in batches]
        return self.spark.read.schema(schema).parquet(*files) if files else self.spark.createDataFrame([], schema)

    def put(self, name: str, rows: DataFrame, touched: list[int], append: bool = False) -> None:
        """New contents of the parts ``touched``, or rows added to them; ``rows`` has a column ``part``.

        Parts with very many files are written anew.
        """
        own = {p: self.parts.get((name, p), []) for p in touched}
        if append and (full := [p for p, batches in own.items() if len(batches) >= self.most_files]):
            schema = ", ".join(f"{c} {t}" for c, t in rows.dtypes if c != "part")
            for p in full:
                rows = rows.unionByName(self.read(name, schema, [p]).withColumn("part", F.lit(p)))
            own |= dict.fromkeys(full, [])
        path = f"{self.folder}/{name}/n={self.number}"
        rows.repartition("part").write.mode("overwrite").partitionBy("part").parquet(path)
        fs, _ = self._fs(path)
        for p in touched:
            before = own[p] if append else []
            new = [*before, self.number] if fs.exists(self._fs(f"{path}/part={p}")[1]) else before
            if new:
                self.parts[name, p] = new
            else:
                self.parts.pop((name, p), None)

    def clear(self, *names: str) -> None:
        """R2: the tables are empty from this batch on."""
        self.parts = {k: v for k, v in self.parts.items() if k[0] not in names}

    def commit(self) -> None:
        rows = [(t, p, v) for (t, p), v in sorted(self.parts.items())]
        self.spark.createDataFrame(rows, "name string, part int, batches array<int>").coalesce(1).write.mode("overwrite").parquet(f"{self.folder}/manifest/n={self.number}")

    def forget(self, keep: int = 2) -> None:
        """Deletes manifests but the last ``keep``, and files that none of those names."""
        numbers = sorted(self._manifests())
        used = {(r.name, n) for m in numbers[-keep:] for r in self._manifest(m).collect() for n in r.batches}
        for m in numbers[:-keep]:
            delete(self.spark, f"{self.folder}/manifest/n={m}")
        fs, top = self._fs(self.folder)
        for t in [f.getPath().getName() for f in fs.listStatus(top) if f.getPath().getName() != "manifest"]:
            for n in [f.getPath().getName() for f in fs.listStatus(self._fs(f"{self.folder}/{t}")[1])]:
                if (t, int(n.removeprefix("n="))) not in used and int(n.removeprefix("n=")) < numbers[-1]:
                    delete(self.spark, f"{self.folder}/{t}/{n}")
