"""Household roll-ups over streamed pairs: each person's best household is state, and where persons come to count is what is written.

A person's state is an aggregation: the last and the first household of the greatest confidence seen.  The person counts for a
household while these are one.  Each micro-batch writes the persons that it touched, with their place or without one, so that a
roll-up is the last place of each person, and no pair is read again.  Pairs that come twice change nothing.
"""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql.streaming import StreamingQuery

from kinloom.operators import household
from kinloom.plans.algorithms import HOUSEHOLD, Algorithm

PLACES = "person long, uuid string, hh_id string, batch long"
#: State is kept on the executors' disks, within a bounded memory.
_STATE = {
    "spark.sql.streaming.stateStore.providerClass": "org.apache.spark.sql.execution.streaming.state.RocksDBStateStoreProvider",
    "spark.sql.streaming.stateStore.rocksdb.boundedMemoryUsage": "true",
}


def pair_stream(spark: SparkSession, out: str, schema, *, files_per_batch: int = 64) -> DataFrame:
    """The pairs that match_stream writes under out, as a stream; schema: of such pairs."""
    return spark.readStream.schema(schema).option("maxFilesPerTrigger", files_per_batch).parquet(f"{out}/batch=*")


def roll_up_stream(pairs: DataFrame, algorithm: Algorithm | int, *, out: str, checkpoint: str, min_confidence: float = 0.95) -> StreamingQuery:
    """Start rolling a stream of A4's pairs, or of best pairs (match_stream, households), up to households, and write each batch's places under out/batch=N."""
    if Algorithm(algorithm) not in HOUSEHOLD:
        raise ValueError("a roll-up is by A5 or A6")
    first, c = Algorithm(algorithm) == Algorithm.HOUSEHOLD_T1, F.col
    if "uuid" in pairs.columns:
        told = pairs.filter(c("confidence") >= F.lit(min_confidence).cast("float"))
        hh, uuid = c("hh_id"), c("uuid")
    else:
        told = pairs.filter(c("a_uuid").isNotNull() & (c("confidence") >= F.lit(min_confidence).cast("float")))
        hh, uuid = household.household_key("b_"), c("a_uuid")
    rows = told.select(c("a_id" if first else "b_id").alias("person"), "confidence", (hh if first else uuid).alias("household"), (uuid if first else hh).alias("other"))
    last = F.max(F.struct("confidence", "household"))
    least = F.min(F.struct((-c("confidence")).alias("confidence"), c("household").isNull().alias("none"), "household", "other"))
    best = rows.groupBy("person").agg(last.alias("last"), least.alias("first"))
    one = c("last.household") == c("first.household")
    place = {"uuid": "first.other", "hh_id": "first.household"} if first else {"uuid": "first.household", "hh_id": "first.other"}
    changed = best.select("person", *[F.when(one, c(x)).alias(n) for n, x in place.items()])

    def write(batch: DataFrame, number: int) -> None:
        batch.write.mode("overwrite").parquet(f"{out}/batch={number}")

    conf = pairs.sparkSession.conf
    before = {k: conf.get(k, None) for k in _STATE}
    for k, v in _STATE.items():
        conf.set(k, v)
    try:
        return changed.writeStream.outputMode("update").foreachBatch(write).option("checkpointLocation", checkpoint).trigger(availableNow=True).start()
    finally:
        for k, v in before.items():
            conf.unset(k) if v is None else conf.set(k, v)


def rolled_up(spark: SparkSession, out: str, table: DataFrame, algorithm: Algorithm | int) -> DataFrame:
    """The household rows of all places written so far; table: the first (A5) or the second (A6), for its households' sizes."""
    last = spark.read.schema(PLACES).parquet(out).groupBy("person").agg(F.max_by(F.struct("uuid", "hh_id"), "batch").alias("place"))
    counts = last.filter("place.hh_id is not null").groupBy("place.uuid", "place.hh_id").agg(F.count(F.lit(1)).alias("found"))
    first = Algorithm(algorithm) == Algorithm.HOUSEHOLD_T1
    return household.rolled(counts, household.sizes_t1(table) if first else household.sizes_t2(table), "uuid" if first else "hh_id")
