"""C8 as one streaming query: feeds to stored predictions, under one checkpoint.

Chained stateful operators: the two windowed aggregates and their join
(:func:`trendframe.streaming.pipeline.trend_stream`), then one learner per
title on ``transformWithState`` with three typed states: the history that its
features look back on (T5), the model (T6), and the sums of its running
metrics (A9). Predictions go to a keyed table (S12).

A title's windows leave the join when the watermark closes them, so they come
in time order from batch to batch; those of one batch, as many as windows have
closed in it, are sorted. The model is updated once per trend row, in the
order of the batch plan (:func:`trendframe.plans.learning.online_learning`),
to whose rows the stored ones are equal.
"""

from __future__ import annotations

import os
from collections.abc import Iterator

import numpy as np
from pyspark.sql import DataFrame, Row, SparkSession
from pyspark.sql import functions as F
from pyspark.sql import types as T
from pyspark.sql.streaming import StatefulProcessor

from ..functions.score import time_parts
from ..operators.learn import L2, LR, learner_step
from ..plans.learning import TREND_FEATURES
from ..session import DEFAULTS, stream_checkpoint
from ..shipping import ship
from ..sources.io import write_keyed
from .ordered import PROVIDER
from .pipeline import trend_stream

#: Rows that trailing means look back on.
BACK = 5
HISTORY = "mentions_count double, avg_sentiment double, popularity double"
MODEL = "n long, mean array<double>, m2 array<double>, w array<double>, b double"
METRICS = "ae double, se double, y_mean double, y_m2 double"
OUT = T.StructType([
    T.StructField("movie_title", T.StringType()), T.StructField("movie_id", T.IntegerType()),
    T.StructField("timestamp", T.TimestampType()),
    *[T.StructField(c, T.DoubleType()) for c in ("actual_trend_score", "predicted_trend_score", "prediction_error")],
    T.StructField("model_version", T.StringType()), T.StructField("features", T.MapType(T.StringType(), T.DoubleType())),
    *[T.StructField(c, T.DoubleType()) for c in ("mae", "rmse", "r2")]])


def looking_back(row, history: list[tuple]) -> dict:
    """The features of a trend row (W9, W10) from the rows of its title before it, oldest first."""
    out = {c: row[c] for c in ("popularity", "mentions_count", "mentions_rate", "avg_sentiment", "vote_average",
                               "avg_reddit_score", "hour", "day_of_week")}
    now = (row["mentions_count"], row["avg_sentiment"], row["popularity"])
    for k, name in enumerate(("mentions", "sentiment", "popularity")):
        out[f"delta_{name}"] = now[k] - history[-1][k] if len(history) >= 2 else 0.0
    for k, name in enumerate(("mentions", "sentiment")):
        out[f"ma_{name}"] = sum(h[k] for h in history) / len(history) if history else now[k]
    return {c: None if out[c] is None else float(out[c]) for c in TREND_FEATURES}


class TitleLearner(StatefulProcessor):
    """One title's predictions: features from its history, then predict, measure, learn."""

    def __init__(self, model_version: str, lr: float, l2: float):
        self.model_version, self.lr, self.l2 = model_version, lr, l2

    def init(self, handle) -> None:
        self.history = handle.getListState("history", HISTORY)
        self.model = handle.getValueState("model", MODEL)
        self.metrics = handle.getValueState("metrics", METRICS)

    def handleInputRows(self, key, rows, timerValues) -> Iterator[Row]:
        history = [tuple(h) for h in self.history.get()] if self.history.exists() else []
        st = None
        if self.model.exists():
            n, mean, m2, w, b = self.model.get()
            st = {"n": n, "mean": np.array(mean), "m2": np.array(m2), "w": np.array(w), "b": b}
            st |= dict(zip(("ae", "se", "y_mean", "y_m2"), self.metrics.get()))
        closed = sorted(rows, key=lambda r: (r["window_start"], r["movie_id"] is not None, r["movie_id"]))
        for r in closed:
            x = looking_back(r, history)
            st, (y, p, err, mae, rmse, r2) = learner_step(st, [x[c] for c in TREND_FEATURES], r["trend_score"], self.lr, self.l2)
            history = [*history, (float(r["mentions_count"]), r["avg_sentiment"], r["popularity"])][-BACK:]
            yield Row(movie_title=key[0], movie_id=r["movie_id"], timestamp=r["window_start"], actual_trend_score=y,
                      predicted_trend_score=p, prediction_error=err, model_version=self.model_version, features=x,
                      mae=mae, rmse=rmse, r2=r2)
        if closed:
            self.history.put(history)
            self.model.update((st["n"], st["mean"].tolist(), st["m2"].tolist(), st["w"].tolist(), float(st["b"])))
            self.metrics.update(tuple(float(st[k]) for k in ("ae", "se", "y_mean", "y_m2")))


def predictions_stream(trends: DataFrame, model_version: str = "v1", lr: float = LR, l2: float = L2) -> DataFrame:
    """Predictions (S12 rows) of a stream of trend rows, one model per title."""
    spark = trends.sparkSession
    ship(spark)
    if "RocksDB" not in spark.conf.get(PROVIDER, ""):
        spark.conf.set(PROVIDER, DEFAULTS[PROVIDER])
    hour, day = time_parts("window_start")
    rows = trends.withColumns({"hour": hour, "day_of_week": day}).drop("processed_time", "window_end")
    return rows.groupBy("movie_title").transformWithState(TitleLearner(model_version, lr, l2), OUT, "append", "none")


def start_online_learning(spark: SparkSession, catalogue: DataFrame, discussion: DataFrame, table: str,
                          name: str = "online-learning", trigger: dict | None = None, model_version: str = "v1", **kw):
    """Start C8 from the two feeds into the keyed table ``table``; returns the ``StreamingQuery``.

    The query's checkpoint, named ``name``, lies under the shared checkpoint
    folder; a restart goes on from it, and a replayed batch leaves the table
    as it was.
    """
    def sink(batch: DataFrame, batch_id: int) -> None:
        write_keyed(batch.withColumn("day", F.to_date("timestamp")), table, ["movie_title", "movie_id", "timestamp"],
                    order="timestamp", partition_by="day")

    out = predictions_stream(trend_stream(catalogue, discussion, **kw), model_version)
    return (out.writeStream.outputMode("append").queryName(name)
            .option("checkpointLocation", os.path.join(stream_checkpoint(spark, name), "query"))
            .foreachBatch(sink).trigger(**(trigger or {"availableNow": True})).start())
