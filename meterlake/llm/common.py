"""What the operators share: reading the tables, picking columns, byte-level words, batches."""

from __future__ import annotations

from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark import TaskContext
from pyspark.sql import Column, DataFrame, SparkSession, Window
from pyspark.sql import functions as F

from meterlake.session import configure, durable

BATCH_ROWS = 500  # rows of an Arrow batch; texts may be long


def prepared(spark: SparkSession) -> SparkSession:
    """The session with the settings the operators rely on."""
    configure(spark).conf.set("spark.sql.execution.arrow.maxRecordsPerBatch", str(BATCH_ROWS))
    return spark


def released(df: DataFrame) -> DataFrame:
    """`durable`, after which Spark may delete the shuffle files of the plan that the written table replaces.

    Spark does so when the driver collects its garbage, which may be long after; big steps ask for it.
    """
    out = durable(df)
    df.sparkSession.sparkContext._jvm.System.gc()
    return out


def table(spark: SparkSession, folder: str, name: str) -> DataFrame:
    return prepared(spark).read.parquet(f"{folder}/{name}.parquet")


def picked(df: DataFrame, **columns: str) -> DataFrame:
    """The named columns under the operator's own names; all others, whatever they are called, stay out."""
    return df.select(*[F.col(f"`{old}`").alias(new) for new, old in columns.items()])


def text_or_empty(c: str | Column) -> Column:
    return F.coalesce(F.col(c) if isinstance(c, str) else c, F.lit(""))


def byte_table(kept: bytes) -> bytes:
    """A translation of UTF-8 bytes: A-Z to a-z, bytes in `kept` and those of other alphabets stay, the rest to space."""
    out = bytearray(b" " * 256)
    for b in [*kept, *range(0x80, 0x100)]:
        out[b] = b
    for upper in range(ord("A"), ord("Z") + 1):
        out[upper] = out[upper + 32]
    return bytes(out)


ALPHANUMERIC = byte_table(b"0123456789abcdefghijklmnopqrstuvwxyz")


def alphanumeric_words(text: str | None) -> list[bytes]:
    """Maximal runs of ASCII letters, digits and all characters beyond ASCII, A-Z lower-cased."""
    return (text or "").encode("utf-8", "surrogatepass").translate(ALPHANUMERIC).split()


def numbered(rows: DataFrame, order: list[Column], name: str) -> DataFrame:
    """`rows`, written, with the column `name`: 1 for the first row by `order`, 2 for the next, and so on.

    Rows are sorted by ranges, and the ranges' totals, one row each, are summed up; no task sees all rows. `order` should
    tell rows apart, so that no range is longer than the others. Rows have no column `stretch`.
    """

    def number(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        stretch, place = TaskContext.get().partitionId(), 0
        for batch in batches:
            places = pa.array(np.arange(place + 1, place + 1 + batch.num_rows))
            place += batch.num_rows
            stretches = pa.array([stretch] * batch.num_rows, pa.int32())
            names = [*batch.schema.names, "stretch", name]
            yield pa.RecordBatch.from_arrays([*batch.columns, stretches, places], names=names)

    fields = ", ".join(f"{f.name} {f.dataType.simpleString()}" for f in rows.schema) + f", stretch int, {name} long"
    parts = int(rows.sparkSession.conf.get("spark.sql.shuffle.partitions"))
    in_order = rows.repartitionByRange(parts, *order).sortWithinPartitions(*order)
    found = durable(in_order.mapInArrow(number, fields))
    before = Window.orderBy("stretch").rowsBetween(Window.unboundedPreceding, -1)
    totals = found.groupBy("stretch").agg(F.count(F.lit(1)).alias("n"))
    bases = durable(totals.select("stretch", F.coalesce(F.sum("n").over(before), F.lit(0)).alias("base")))
    return found.join(bases, "stretch").withColumn(name, F.col(name) + F.col("base")).drop("stretch", "base")
