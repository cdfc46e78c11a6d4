"""A journal of events that a stream appends to exactly once, with ids that only grow.

A batch is written in three steps, each of which replaces what an earlier attempt at the same batch left:
its rows in order with their places, its events with their ids, and last its line in the ledger (batch,
first id, number of rows), which makes it visible. A batch that is in the ledger already is passed over, so
a replay adds nothing; one that failed half way is written again over its own remains. Ids go on where
the ledger ends, without gaps, so a reader continues after the last id that it has seen.
"""

from __future__ import annotations

from pyspark.errors import AnalysisException
from pyspark.sql import DataFrame, SparkSession, Window
from pyspark.sql import functions as F

LEDGER = "batch long, first long, n long"


def ledger(spark: SparkSession, path: str) -> DataFrame:
    """(batch, first, n) of the batches that are complete."""
    try:
        return spark.read.schema(LEDGER).parquet(f"{path}/ledger/*")
    except AnalysisException as e:
        if e.getCondition() != "PATH_NOT_FOUND":
            raise
        return spark.createDataFrame([], LEDGER)


def append(rows: DataFrame, number: int, path: str, order: list[str]) -> None:
    """Append ``rows`` as batch ``number`` in the order of the columns ``order``, unless the ledger has it."""
    spark = rows.sparkSession
    done = ledger(spark, path).agg(F.max(F.when(F.col("batch") == number, 1)).alias("seen"), F.max(F.when(F.col("batch") < number, F.col("first") + F.col("n"))).alias("next")).first()
    if done["seen"]:
        return
    following = done["next"] or 1
    # the id below has the partition above 33 bits and the row's place beneath; ranges are in order, and so are their rows
    ranged = rows.repartitionByRange(*order).sortWithinPartitions(*order).withColumn("_at", F.monotonically_increasing_id())
    ranged.write.mode("overwrite").parquet(f"{path}/placed/{number}")
    placed = spark.read.schema(ranged.schema).parquet(f"{path}/placed/{number}").withColumn("_range", F.shiftright("_at", 33))
    sizes = placed.groupBy("_range").agg(F.count(F.lit(1)).alias("_n"))  # one row for each range
    before = sizes.select("_range", (F.sum("_n").over(Window.orderBy("_range")) - F.col("_n")).alias("_before"))
    event = F.col("_before") + F.col("_at").bitwiseAND(F.lit((1 << 33) - 1)) + following
    events = placed.join(before, "_range").select(event.alias("event_id"), F.lit(number).cast("long").alias("batch"), *rows.columns)
    events.write.mode("overwrite").parquet(f"{path}/events/{number}")
    n = spark.read.schema(events.schema).parquet(f"{path}/events/{number}").count()
    spark.range(1).select(F.lit(number).cast("long").alias("batch"), F.lit(following).cast("long").alias("first"), F.lit(n).cast("long").alias("n")).coalesce(1).write.mode("overwrite").parquet(f"{path}/ledger/{number}")


def publish(stream: DataFrame, path: str, checkpoint: str, order: list[str]):
    """A streaming writer that appends every batch of ``stream`` to the journal at ``path`` once."""
    return stream.writeStream.foreachBatch(lambda batch, number: append(batch, number, path, order)).option("checkpointLocation", checkpoint).trigger(availableNow=True)


def events(spark: SparkSession, path: str, after: int = 0) -> DataFrame:
    """(event_id, batch, ...) of complete batches with ids above ``after``."""
    known = ledger(spark, path).where(F.col("first") + F.col("n") - 1 > after)
    held = spark.read.parquet(f"{path}/events/*")
    return held.join(known.select("batch"), "batch", "left_semi").where(F.col("event_id") > after)
