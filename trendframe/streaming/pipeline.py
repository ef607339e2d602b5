"""Streaming trend job (C1 in Structured Streaming: S1-S3, S8-S11, S16, T1-T4).

Source: a broker topic (``format("kafka")``) when its connector is on the
class path, otherwise a directory of JSON files (same schema); both are
decoded with the fixed catalogue / discussion schemas.

The plan is :func:`trendframe.plans.trend.trend_scores` on streaming input:
each side gets a 10-minute watermark, a sliding-window aggregate, and the
two aggregates are joined on the ``window`` struct plus the title, so the
join state carries the watermark and is evicted (bounded state); outer
joins are possible for the same reason. Output mode is append: a window is
emitted once, when the watermark closes it; rows later than the watermark
are dropped.

Sinks: one ``foreachBatch`` (S11) that persists the micro-batch once and
writes it to the keyed trend table (S8: per-key last write wins, so a
replayed batch leaves the table unchanged) and to a JSON folder named by
batch id (S9: overwritten on replay). The checkpoint of the query lives
under the shared ``spark.checkpoint.dir`` (S16).
"""

from __future__ import annotations

import os

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql import types as T

from ..functions.sentiment import sentiment
from ..plans.trend import trend_scores
from ..schemas import CATALOGUE, DISCUSSION
from ..session import stream_checkpoint
from ..sources.io import decode_json, encode_json, fan_out, read_events, write_keyed


def read_feed(spark: SparkSession, source: str, schema: T.StructType, fmt: str = "json",
              starting: str = "latest", options: dict | None = None) -> DataFrame:
    """S1 + S2 + S3: a decoded feed with ``event_time`` (timestamp)."""
    if fmt == "kafka":
        raw = read_events(spark, source, fmt="kafka", starting=starting, options=options)
        df = decode_json(raw, "value", schema)
    else:
        df = read_events(spark, source, schema, fmt=fmt, options=options)
    return df.withColumn("event_time", F.try_to_timestamp(F.col("timestamp")))


def trend_stream(catalogue: DataFrame, discussion: DataFrame, size: str = "5 minutes",
                 slide: str = "1 minute", delay: str = "10 minutes", how: str = "inner",
                 weights=(0.4, 0.3, 0.3)) -> DataFrame:
    """C1 on streams (T1-T4). Required fields must be present (P1 rule)."""
    cat = catalogue.filter(F.col("title").isNotNull() & F.col("event_time").isNotNull())
    disc = discussion.filter(F.col("event_time").isNotNull())
    if "sentiment_score" not in disc.columns:  # F1 on the text, as upstream
        disc = disc.withColumn("sentiment_score", sentiment("text"))
    return trend_scores(cat, disc, size=size, slide=slide, delay=delay, how=how, weights=weights)


def keyed_sink(path: str, keys=("movie_title", "window_start"), partition_by: str | None = "day"):
    """``foreachBatch`` writer into a keyed Parquet table (idempotent)."""
    def sink(batch: DataFrame, batch_id: int) -> None:
        b = batch.withColumn("day", F.to_date("window_start")) if partition_by == "day" else batch
        # rows of one batch share processed_time: the larger score wins between two ids of a title
        write_keyed(b, path, list(keys), order=["processed_time", "trend_score"], partition_by=partition_by)
    return sink


def json_sink(path: str):
    """Each micro-batch as JSON lines in ``path/batch=<id>`` (overwritten on replay)."""
    def sink(batch: DataFrame, batch_id: int) -> None:
        encode_json(batch).write.mode("overwrite").text(os.path.join(path, f"batch={batch_id}"))
    return sink


def start_trend_job(spark: SparkSession, catalogue: DataFrame, discussion: DataFrame, out_dir: str,
                    name: str = "trend", trigger: dict | None = None, debug: bool = False, **kw):
    """Start the streaming trend job; returns the ``StreamingQuery``.

    ``trigger`` defaults to ``{"availableNow": True}`` (process what is
    there, then stop); pass ``{"processingTime": "1 minute"}`` to run
    continuously.
    """
    trends = trend_stream(catalogue, discussion, **kw)
    sinks = [keyed_sink(os.path.join(out_dir, "trends")), json_sink(os.path.join(out_dir, "trend_json"))]
    if debug:
        sinks.append(lambda b, i: b.show(truncate=False))  # S10
    w = (trends.writeStream.outputMode("append").queryName(name)
         .option("checkpointLocation", stream_checkpoint(spark, name))
         .foreachBatch(fan_out(sinks)))
    w = w.trigger(**(trigger or {"availableNow": True}))
    return w.start()


__all__ = ["CATALOGUE", "DISCUSSION", "read_feed", "trend_stream", "start_trend_job"]
