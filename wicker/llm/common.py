"""Helpers that several training-data operators share.

Operators that return the columns of their input carry each row in a struct, so
extra columns pass through, whatever their names.
"""

from __future__ import annotations

import atexit
import contextlib
import json
import math
import uuid

from pyspark.sql import Column, DataFrame, SparkSession, Window
from pyspark.sql import functions as F

from wicker.operators.components import components  # noqa: F401
from wicker.session import checkpoint_folder, dropped

#: What separates words in every contract of this subpackage.
SPACE = r"[\x20\x09-\x0D]+"


def read(spark: SparkSession, sf_dir: str, table: str) -> DataFrame:
    """The table of that name, read by Spark's own reader."""
    return spark.read.parquet(f"{sf_dir}/{table}.parquet")


def materialize(df: DataFrame) -> DataFrame:
    """Cut lineage through a Parquet table, which takes less room than a checkpoint where values repeat.

    It lies in the folder that the cluster names in ``spark.checkpoint.dir``; only
    on a single machine, where none is set, in a temporary one. The tables of an
    application are deleted when its driver ends.
    """
    spark = df.sparkSession
    folder = f"{checkpoint_folder(spark)}/tables-{spark.sparkContext.applicationId}"
    if not getattr(spark.sparkContext, "_wicker_swept", False):
        spark.sparkContext._wicker_swept = True
        atexit.register(_sweep, spark, folder)
    path = f"{folder}/{uuid.uuid4().hex}"
    made(spark).append(path)
    df.write.parquet(path)
    return spark.read.schema(df.schema).parquet(path)


def made(spark: SparkSession) -> list[str]:
    """The tables of this application so far, in order; who has written out a result may delete those made for it."""
    return spark.sparkContext.__dict__.setdefault("_wicker_made", [])


def _sweep(spark: SparkSession, folder: str) -> None:
    with contextlib.suppress(Exception):  # the context may be gone
        dropped(spark, folder)


def small_batches(df: DataFrame, rows: int = 1000) -> DataFrame:
    """The same rows; from now on the session hands Python at most so many at a time.

    Texts are long, and a worker holds a batch several times over. A smaller
    setting of the session stays.
    """
    key = "spark.sql.execution.arrow.maxRecordsPerBatch"
    conf = df.sparkSession.conf
    if not 0 < int(conf.get(key, "10000")) <= rows:
        conf.set(key, str(rows))
    return df


def small(df: DataFrame, most: int = 100_000) -> DataFrame:
    """The rows, written out, and marked for broadcast if there are at most so many of them.

    Beyond that a join with them shuffles both sides, as any other join.
    """
    kept = materialize(df)
    return F.broadcast(kept) if kept.count() <= most else kept


def only(rows: DataFrame, keys: DataFrame, on: list[str], most: int = 2_000_000) -> DataFrame:
    """The rows with one of the keys. Up to ``most`` keys are broadcast, so that wide rows without one are never dealt out."""
    return rows.join(small(keys.select(*on).distinct(), most), on, "left_semi")


def words(text: Column) -> Column:
    """The maximal runs of characters that are not ASCII white space; null has none."""
    return F.filter(F.split(F.coalesce(text, F.lit("")), SPACE), lambda w: w != "")


def digest(text: Column) -> list[Column]:
    """Two independent 64-bit hashes of a text; null counts as empty."""
    whole = F.coalesce(text, F.lit(""))
    return [F.xxhash64(whole).alias("d1"), F.xxhash64(F.lit(1), whole).alias("d2")]


def stretches(df: DataFrame, key: str, pieces: int) -> Column:
    """A number that rises with the numeric ``key`` and splits the rows about evenly into ``pieces``.

    The only values on the driver are the ``pieces - 1`` cut points, so the
    cost there does not depend on the input. A row finds its place by a look at
    the first cut point of each run of cuts, then within that run. Null keys
    come first.
    """
    shares = [i / pieces for i in range(1, pieces)]
    cuts = df.select(F.percentile_approx(key, shares, 10_000)).first()[0] if shares else []
    cuts = sorted(set(cuts or []))
    if not cuts:
        return F.lit(0)
    run = math.isqrt(len(cuts)) + 1
    kind = df.schema[key].dataType.simpleString()
    runs = F.from_json(F.lit(json.dumps([cuts[i : i + run] for i in range(0, len(cuts), run)])), f"array<array<{kind}>>")
    heads = F.from_json(F.lit(json.dumps(cuts[::run])), f"array<{kind}>")
    upto = lambda values: F.size(F.filter(values, lambda c: c <= F.col(key)))
    place = F.when(upto(heads) > 0, (upto(heads) - 1) * run + upto(F.get(runs, upto(heads) - 1)))
    return F.when(F.col(key).isNull(), F.lit(0)).otherwise(F.coalesce(place, F.lit(0)))


def running_totals(df: DataFrame, key: str, tie: list[str], totals: dict[str, str], within: list[str] | None = None, pieces: int | None = None) -> DataFrame:
    """Exclusive prefix sums in the order ``key, *tie``, without one global sort.

    ``totals`` maps a column of sizes to the name of its prefix sum. With
    ``within`` the sums start anew for each combination of those columns; a
    combination that holds most rows is still spread over all pieces. Rows that
    agree in ``within``, ``key`` and ``tie`` may be given their sums in any
    order. Adds the sums and returns the other columns unchanged.
    """
    within = within or []
    pieces = pieces or int(df.sparkSession.conf.get("spark.sql.shuffle.partitions")) * 2
    placed = df.withColumn("_piece", stretches(df, key, pieces))
    order = Window.partitionBy(*within, "_piece").orderBy(F.col(key).asc_nulls_first(), *tie)
    before = order.rowsBetween(Window.unboundedPreceding, -1)
    local = materialize(placed.select("*", *(F.coalesce(F.sum(c).over(before), F.lit(0).cast("long")).alias(f"_in_{n}") for c, n in totals.items())))
    sums = local.groupBy(*within, "_piece").agg(*(F.sum(c).alias(f"_all_{n}") for c, n in totals.items()))
    earlier = (Window.partitionBy(*within) if within else Window.partitionBy(F.lit(0))).orderBy("_piece").rowsBetween(Window.unboundedPreceding, -1)
    starts = sums.select(*(F.col(c).alias(f"_at_{c}") for c in [*within, "_piece"]), *(F.coalesce(F.sum(f"_all_{n}").over(earlier), F.lit(0).cast("long")).alias(f"_from_{n}") for n in totals.values()))
    same = [F.col(c).eqNullSafe(F.col(f"_at_{c}")) for c in [*within, "_piece"]]
    joined = local.join(small(starts), same)
    return joined.select(*df.columns, *((F.col(f"_in_{n}") + F.col(f"_from_{n}")).alias(n) for n in totals.values()))
