"""T6 (a) in Structured Streaming: one global model updated per micro-batch.

Each micro-batch is predicted with the model of the previous batch, then
the model is updated from one aggregation over the batch
(:func:`trendframe.operators.learn.minibatch_step`). The model state is a
handful of numbers per feature, written as a small JSON file per batch id
under the shared checkpoint folder. A restarted query resumes from the
latest state. A replayed batch (same id) is predicted with the state that
preceded it and overwrites its own state file, so the model is not updated twice.
"""

from __future__ import annotations

import json
import os

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from ..operators.learn import minibatch_step
from ..session import stream_checkpoint
from ..sources.io import delete_table, has_table


def _load(spark: SparkSession, folder: str, before: int):
    """Latest stored state of a batch before ``before`` (None if there is none)."""
    if not has_table(spark, folder):
        return None
    st = spark.read.text(folder)  # partitioned by ``batch``
    row = (st.filter(F.col("batch") < before).orderBy(F.col("batch").desc()).limit(1).collect())
    return json.loads(row[0]["value"]) if row else None


def global_learner(features, target: str, state_dir: str, sink):
    """``foreachBatch`` body: predict with the previous state, update, hand the
    predicted batch to ``sink(df, batch_id)``, store the new state.

    The state (a few numbers per feature) is written with Spark's own writer
    to ``state_dir/batch=<id>``, so it lives on whatever shared file system
    holds the checkpoint folder.
    """
    features = list(features)

    def run(batch: DataFrame, batch_id: int) -> None:
        spark = batch.sparkSession
        state = _load(spark, state_dir, batch_id)
        batch.persist()  # predicted, summed up twice and written
        try:
            out, new_state = minibatch_step(batch, features, target, state)
            sink(out, batch_id)
        finally:
            batch.unpersist()
        (spark.createDataFrame([(json.dumps(new_state),)], "value string").coalesce(1)
         .write.mode("overwrite").text(f"{state_dir}/batch={batch_id}"))
        # the state before this batch is needed for a replay of it, older ones for nothing
        delete_table(spark, f"{state_dir}/batch={batch_id - 2}")
    return run


def start_global_learner(spark: SparkSession, stream: DataFrame, features, target: str, sink,
                         name: str = "learner", trigger: dict | None = None):
    """Start the learner on a stream of trend rows; returns the ``StreamingQuery``.

    The state folder is ``<spark.checkpoint.dir>/streams/<name>/model``, next
    to the query's own checkpoint.
    """
    ckpt = stream_checkpoint(spark, name)
    body = global_learner(features, target, os.path.join(ckpt, "model"), sink)
    w = (stream.writeStream.queryName(name).option("checkpointLocation", os.path.join(ckpt, "query"))
         .foreachBatch(body).trigger(**(trigger or {"availableNow": True})))
    return w.start()
