"""An index that follows a folder of changes, as a stream of micro-batches."""

from __future__ import annotations

import uuid

from py4j.protocol import Py4JJavaError
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from wicker.operators.store import upsert


class Snapshots:
    """Generations of a table in a folder; a pointer names the one that holds.

    A generation is written as a whole before the pointer moves, so a failed build
    leaves the old one in place. All file operations go through Spark's own file
    systems, so the folder may be in any store.
    """

    def __init__(self, spark: SparkSession, folder: str):
        self.spark, self.folder = spark, folder.rstrip("/")
        jvm = spark.sparkContext._jvm
        self._path = lambda p: jvm.org.apache.hadoop.fs.Path(p)
        self._fs = self._path(self.folder).getFileSystem(spark.sparkContext._jsc.hadoopConfiguration())

    def _pointers(self) -> list[int]:
        at = self._path(f"{self.folder}/current")
        return sorted(int(s.getPath().getName()) for s in self._fs.listStatus(at)) if self._fs.exists(at) else []

    def generation(self) -> int:
        """The present generation; 0 before the first."""
        return max(self._pointers(), default=0)

    def read(self) -> DataFrame | None:
        n = self.generation()
        if not n:
            return None
        name = self.spark.read.text(f"{self.folder}/current/{n}").first()[0]
        return self.spark.read.parquet(f"{self.folder}/{name}")

    def publish(self, rows: DataFrame) -> int:
        """Write a new generation, then let the pointer name it; a loser of a race raises and changes nothing."""
        n, name = self.generation() + 1, f"generation-{uuid.uuid4().hex}"
        rows.write.parquet(f"{self.folder}/{name}")
        draft = f"{self.folder}/draft-{name}"
        self.spark.createDataFrame([(name,)], "value string").coalesce(1).write.text(draft)
        self._fs.mkdirs(self._path(f"{self.folder}/current"))
        if self.generation() >= n or not self._moved(draft, f"{self.folder}/current/{n}"):
            raise RuntimeError("another writer published first")
        return n

    def compact(self, files: int, *order: str) -> int:
        """Publish the present generation again in so many files, sorted within each; what many small writes left."""
        rows = self.read()
        return self.publish(rows.repartition(files, *order).sortWithinPartitions(*order) if order else rows.coalesce(files))

    def vacuum(self, keep: int = 1) -> int:
        """Delete all generations but the last ``keep``, and drafts of builds that failed; how many folders went."""
        kept = {self.spark.read.text(f"{self.folder}/current/{n}").first()[0] for n in self._pointers()[-keep:]}
        old = [s.getPath() for s in self._fs.listStatus(self._path(self.folder)) if s.getPath().getName() not in kept | {"current"}]
        for n in self._pointers()[:-keep]:
            self._fs.delete(self._path(f"{self.folder}/current/{n}"), True)
        for path in old:
            self._fs.delete(path, True)
        return len(old)

    def _moved(self, source: str, target: str) -> bool:
        """Rename, unless the target is there: a plain rename would then move into it."""
        context = self.spark.sparkContext
        files = context._jvm.org.apache.hadoop.fs.FileContext.getFileContext(self._fs.getUri(), context._jsc.hadoopConfiguration())
        none = context._gateway.new_array(context._jvm.org.apache.hadoop.fs.Options.Rename, 0)
        try:
            files.rename(self._fs.makeQualified(self._path(source)), self._fs.makeQualified(self._path(target)), none)
        except Py4JJavaError as e:
            if "FileAlreadyExistsException" in str(e.java_exception):
                return False
            raise
        return True


def follow(spark: SparkSession, changes: str, schema: str, snapshots: Snapshots, key: list[str], order: str, checkpoint: str) -> None:
    """Apply all changes that have come into a folder (Parquet) since the last call; the last of a key holds.

    A micro-batch that is repeated after a failure gives the same generation's
    content, as the merge is by key.
    """

    def apply(batch: DataFrame, _: int) -> None:
        batch = batch.withColumn("_order", F.col(order))
        old = snapshots.read()
        old = batch.limit(0).drop("_order") if old is None else old
        snapshots.publish(upsert(old, batch, key, "_order"))

    stream = spark.readStream.schema(schema).parquet(changes)
    stream.writeStream.foreachBatch(apply).option("checkpointLocation", checkpoint).trigger(availableNow=True).start().awaitTermination()


def event_counts(events: DataFrame, late: str = "10 minutes", width: str = "1 hour") -> DataFrame:
    """Counts and sums of events per window and type, bounded state by a watermark."""
    return events.withWatermark("ts", late).groupBy(F.window("ts", width), "event_type").agg(F.count("*").alias("n"), F.sum("value").alias("value"))
