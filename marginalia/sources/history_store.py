"""A history of records by key: batches of upserts, merged now and then into few files.

A batch is a Parquet folder under its number, so a batch that is written again is the same
batch. ``compact`` merges the batches so far into ``buckets`` files by key and then names
them in a new manifest; until it is there, readers see the files before. What the newest
manifest does not name is removed afterwards. So a reader opens one file a bucket and
those of fewer than ``every`` batches, however long the history is.

One writer at a time; readers may be any number.
"""

from __future__ import annotations

import json
import uuid

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from ..schema import HISTORY_KEY


class History:
    def __init__(self, spark: SparkSession, path: str, key: tuple[str, ...] = HISTORY_KEY, buckets: int = 8, every: int = 20) -> None:
        self.spark, self.path, self.key, self.buckets, self.every = spark, path.rstrip("/"), key, buckets, every

    def _place(self, name: str = ""):
        place = self.spark.sparkContext._jvm.org.apache.hadoop.fs.Path(f"{self.path}/{name}".rstrip("/"))
        return place.getFileSystem(self.spark.sparkContext._jsc.hadoopConfiguration()), place

    def _names(self, name: str) -> list[str]:
        files, place = self._place(name)
        return sorted(x.getPath().getName() for x in files.listStatus(place)) if files.exists(place) else []

    def manifest(self) -> dict:
        """The merged files and the last batch in them; none before the first merge."""
        versions = self._names("manifest")
        if not versions:
            return {"version": 0, "merged": None, "upto": -1}
        text = self.spark.read.text(f"{self.path}/manifest/{versions[-1]}", wholetext=True).first()[0]
        return json.loads(text)

    def batches(self, after: int) -> list[int]:
        return [n for n in sorted(int(x.partition("=")[2]) for x in self._names("batches")) if n > after]

    def upsert(self, rows: DataFrame, number: int | None = None) -> None:
        """Adds records, in place of those with their key; of several of a key in a batch the largest counts.

        Under a number that was given before the batch takes the place of that one, or, if
        that is merged already, is left out as a repetition.
        """
        known = self.manifest()
        if number is None:
            number = max([known["upto"], *self.batches(known["upto"])]) + 1
        if number <= known["upto"]:
            return
        rest = [c for c in rows.columns if c not in self.key]
        rows = rows.groupBy(*self.key).agg(F.max(F.struct(*rest)).alias("r")).select(*self.key, "r.*", F.lit(number).cast("long").alias("batch"))
        rows.coalesce(self.buckets).write.mode("overwrite").parquet(f"{self.path}/batches/batch={number}")
        if len(self.batches(known["upto"])) >= self.every:
            self.compact()

    def _files(self, known: dict) -> list[str]:
        merged = [f"{self.path}/merged/{known['merged']}"] if known["merged"] else []
        return merged + [f"{self.path}/batches/batch={n}" for n in self.batches(known["upto"])]

    def _latest(self, known: dict) -> DataFrame | None:
        files = self._files(known)
        if not files:
            return None
        # a folder at a time, so that the numbers in their names are not read as a column
        rows = self.spark.read.option("recursiveFileLookup", "true").option("mergeSchema", "true").parquet(*files)
        names = [c for c in rows.columns if c not in (*self.key, "batch")]
        return rows.groupBy(*self.key).agg(F.max(F.struct("batch", *names)).alias("r")).select(*self.key, *[f"r.{c}" for c in names], "r.batch")

    def latest(self) -> DataFrame | None:
        """The record of each key of the latest batch that has one; None if nothing was ever added."""
        rows = self._latest(self.manifest())
        return rows and rows.drop("batch")

    def compact(self) -> None:
        known = self.manifest()
        batches = self.batches(known["upto"])
        if not batches:
            return
        name, version = uuid.uuid4().hex, known["version"] + 1
        self._latest(known).repartition(self.buckets, *self.key).sortWithinPartitions(*self.key).write.parquet(f"{self.path}/merged/{name}")
        files, place = self._place(f"manifest/{version:010d}")
        out = files.create(place, False)
        out.write(bytearray(json.dumps({"version": version, "merged": name, "upto": batches[-1]}).encode()))
        out.close()
        gone = [f"merged/{x}" for x in self._names("merged") if x != name] + [f"batches/batch={n}" for n in batches]
        for old in [*gone, *(f"manifest/{x}" for x in self._names("manifest")[:-1])]:
            files, place = self._place(old)
            files.delete(place, True)
