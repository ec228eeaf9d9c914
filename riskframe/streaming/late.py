"""Score applications whose customer may arrive after them.

Orders and customers are both streams.  Rows meet under the customer's key in
arbitrary stateful processing.  Keys are dealt into ``BUCKETS`` states, as a call
a key would cost far more than its rows: a state holds, packed, the customers of
its keys that have come, and the orders that wait for theirs.  An order whose customer is known goes on
at once; one that waits goes on with the customer's arrival, exactly once; one
that has waited longer than ``patience`` when a timer fires is an expired order
and lands in the dead-letter table with everything it held.

Arrival is the time of the micro-batch, which Spark logs, so a replayed batch
has the same timers and no row is ever late.  A timer fires with the first
micro-batch after its time that follows newer data.  A bucket is dealt out by the
order's key into ``SALTS`` states, each with its own copy of the customers, so a
customer with a third of all orders is not one task's.  Both sinks are written
by epoch with overwrite: a replay replaces its own rows.

Defined results: an order without a customer key waits and expires; of several
rows of one customer those that arrive later count from then on, within one
micro-batch the greatest row as text; repeated orders are scored each; a customer
without a key meets nobody.  A micro-batch is bounded by bytes, or by files where
the caller says how many.
"""

from __future__ import annotations

import json
import os
import zlib
from collections.abc import Iterator

import pandas as pd
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql.streaming.state import GroupState, GroupStateTimeout

from ..operators import features, models
from ..sources import tables
from .scoring import _paths

SALTS = 8
BUCKETS = 4096
BATCH_BYTES = 1 << 27
STATE = "customers binary, waiting binary"
MET = "order_row string, customer_row string, expired boolean"
#: No digit of a time is lost on the way through the state.
AS_TEXT = {"timestampFormat": "yyyy-MM-dd'T'HH:mm:ss.SSSSSSXXX", "ignoreNullFields": "false"}


def _file_stream(spark: SparkSession, sf_dir: str, name: str, columns: list[str], max_files: int | None) -> DataFrame:
    """A table that is one file or a growing folder of part files, as a stream."""
    schema = spark.read.parquet(os.path.join(sf_dir, f"{name}.parquet")).select(*columns).schema
    bound = ("maxBytesPerTrigger", BATCH_BYTES) if max_files is None else ("maxFilesPerTrigger", max_files)
    return spark.readStream.schema(schema).option(*bound).parquet(os.path.join(sf_dir, f"{name}[.]parquet"))


def _rows(df: DataFrame, key: str, salt, kind: str, buckets: int) -> DataFrame:
    key = F.col(key).cast("long")
    return df.select(F.pmod(F.xxhash64(key), F.lit(buckets)).cast("int").alias("bucket"), salt.alias("salt"), key.cast("string").alias("key"),
                     F.lit(kind).alias("kind"), F.to_json(F.struct(*df.columns), AS_TEXT).alias("row"))


def _packed(value) -> bytes:
    return zlib.compress(json.dumps(value).encode(), 1)


def _meet(patience_ms: int):
    def step(key: tuple, frames: Iterator[pd.DataFrame], state: GroupState) -> Iterator[pd.DataFrame]:
        customers, waiting = (json.loads(zlib.decompress(bytes(v))) for v in state.get) if state.exists else ({}, [])
        before, ready, gone = len(waiting), [], []                # waiting: [arrival, key, order]
        fresh = {}
        if state.hasTimedOut:
            now = state.getCurrentWatermarkMs()
            gone = [(o, None) for at, _, o in waiting if at + patience_ms <= now]
            waiting = [w for w in waiting if w[0] + patience_ms > now]
        else:
            came = []
            for f in frames:
                told = f["kind"].to_numpy() == "customer"
                for k, row in zip(f["key"][told], f["row"][told], strict=True):
                    if k is not None and (k not in fresh or row > fresh[k]):
                        fresh[k] = row
                f = f[~told]
                at = (int(t.timestamp() * 1000) for t in f["arrived"])
                came += [[a, k, o] for a, k, o in zip(at, f["key"], f["row"], strict=True)]
            customers.update(fresh)
            if fresh:
                came, waiting = waiting + came, []
            ready = [(o, customers[k]) for _, k, o in came if k is not None and k in customers]
            waiting = waiting + [w for w in came if w[1] is None or w[1] not in customers]
        if not customers and not waiting:
            if state.exists:
                state.remove()
        elif fresh or waiting or before:
            state.update((_packed(customers), _packed(waiting)))
        if waiting:
            state.setTimeoutTimestamp(max(min(w[0] for w in waiting) + patience_ms, state.getCurrentWatermarkMs() + 1))
        for met, late in ((ready, False), (gone, True)):
            if met:
                yield pd.DataFrame({"order_row": [o for o, _ in met], "customer_row": [c for _, c in met], "expired": late})
    return step


def meetings(orders: DataFrame, customers: DataFrame, patience: float, order_key: str = "o_orderkey", foreign_key: str = "o_custkey",
             customer_key: str = "c_custkey", salts: int = SALTS, buckets: int = BUCKETS) -> DataFrame:
    """order_row, customer_row (JSON), expired: each order once, with its customer or expired after ``patience`` seconds."""
    own = F.pmod(F.xxhash64(order_key), F.lit(salts)).cast("int")
    every = F.explode(F.sequence(F.lit(0), F.lit(salts - 1)))
    rows = _rows(orders, foreign_key, own, "order", buckets).unionByName(_rows(customers, customer_key, every, "customer", buckets))
    rows = rows.withColumn("arrived", F.current_timestamp()).withWatermark("arrived", "0 seconds")
    return rows.groupBy("bucket", "salt").applyInPandasWithState(_meet(int(patience * 1000)), MET, STATE, "append", GroupStateTimeout.EventTimeTimeout)


def late_scores(spark: SparkSession, sf_dir: str, prep: features.PrepModel, patience: float = 86_400.0, max_files_per_trigger: int | None = None,
                folders: tuple[str, str] | None = None) -> tuple[DataFrame, DataFrame]:
    """Run to the end of what has arrived; the scored applications, and the expired orders.

    ``folders`` (output, checkpoint) of an earlier run go on from there."""
    orders = _file_stream(spark, sf_dir, "orders", tables.ORDER_COLS, max_files_per_trigger)
    customers = _file_stream(spark, sf_dir, "customer", tables.CUSTOMER_COLS, max_files_per_trigger)
    out, ck = folders or _paths(spark, "late-scores")
    shape = {"o": orders.schema, "c": customers.schema}

    def handle(batch: DataFrame, epoch: int) -> None:
        batch.persist()
        try:
            pairs = batch.where("not expired").select(F.from_json("order_row", shape["o"], AS_TEXT).alias("o"), F.from_json("customer_row", shape["c"], AS_TEXT).alias("c"))
            scored = models.score_linear(prep.transform(tables.application_columns(pairs.select("o.*", "c.*"))))
            scored.write.mode("overwrite").parquet(f"{out}/scores/epoch={epoch}")
            dead = batch.where("expired").select(F.from_json("order_row", shape["o"], AS_TEXT).alias("o")).select("o.*")
            dead.write.mode("overwrite").parquet(f"{out}/dead/epoch={epoch}")
        finally:
            batch.unpersist()

    q = (meetings(orders, customers, patience).writeStream.foreachBatch(handle).option("checkpointLocation", ck)
         .outputMode("append").trigger(availableNow=True).start())
    q.awaitTermination()
    return spark.read.parquet(f"{out}/scores").drop("epoch"), spark.read.parquet(f"{out}/dead").drop("epoch")
