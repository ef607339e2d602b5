"""Streaming queries (S1, S3, S6, S8, S9, S11, S16, T1-T5, T7, T8): feeds staged under the shared
checkpoint folder, run to the end by the streaming job, and its stored results."""

from __future__ import annotations

import uuid

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from ..schemas import CATALOGUE, DISCUSSION_SCORED, RATINGS_TSV
from ..session import checkpoint_dir, stream_checkpoint
from ..sources import testbed as tb
from ..sources.io import read_tsv
from ..streaming.online import start_online_learning
from ..streaming.pipeline import read_feed, start_trend_job
from ..streaming.state import cooldown_stream, first_seen, history_stream
from . import ntz, register, rounded
from ._sql import with_trends


def _folder(spark, name: str) -> str:
    return f"{checkpoint_dir(spark)}/feeds/{name}-{uuid.uuid4().hex}"


def _json_feed(df: DataFrame, name: str, schema) -> DataFrame:
    """The rows as a stream of JSON files, decoded with the feed's schema."""
    path = _folder(df.sparkSession, name)
    df.drop("event_time", "event_id").write.json(path)
    return read_feed(df.sparkSession, path, schema)


def _table_feed(df: DataFrame, name: str) -> DataFrame:
    path = _folder(df.sparkSession, name)
    df.write.parquet(path)
    return df.sparkSession.readStream.schema(df.schema).parquet(path)


def _stored(stream: DataFrame, name: str) -> DataFrame:
    """Run a stream over all its input and read what it has written."""
    spark = stream.sparkSession
    out = _folder(spark, f"{name}-out")
    query = (stream.writeStream.format("parquet").outputMode("append").option("path", out)
             .option("checkpointLocation", stream_checkpoint(spark, f"{name}-{uuid.uuid4().hex}"))
             .trigger(availableNow=True).start())
    query.awaitTermination()
    return spark.read.schema(stream.schema).parquet(out)


@register("trend_stream", with_trends("""
SELECT movie_title, movie_id, window_start, window_end, round(popularity, 6) AS popularity, mentions_count,
       round(avg_sentiment, 6) AS avg_sentiment, round(trend_score, 6) AS trend_score
FROM trends WHERE window_end <= least((SELECT max(event_time) FROM catalogue), (SELECT max(event_time) FROM discussion))
                                - INTERVAL 10 MINUTE"""))
def q_trend_stream(spark, d):
    """C1 as a streaming job (S1 S3 S8 S9 S11 S16 T1-T4): the keyed table it leaves, all closed windows."""
    out = _folder(spark, "trend-out")
    job = start_trend_job(spark, _json_feed(tb.catalogue(spark, d), "catalogue", CATALOGUE),
                          _json_feed(tb.discussion(spark, d), "discussion", DISCUSSION_SCORED), out,
                          name=f"trend-{uuid.uuid4().hex}", size="1 day", slide="6 hours", delay="10 minutes")
    job.awaitTermination()
    t = spark.read.parquet(f"{out}/trends").select(
        "movie_title", "movie_id", "window_start", "window_end", "popularity", "mentions_count", "avg_sentiment", "trend_score")
    return rounded(ntz(t, "window_start", "window_end"))


#: Parts of time in which a feed arrives; each is a run of the stream that goes on from the last one's state.
ARRIVALS = 3
#: Rows whose slot the watermark (an hour behind the newest row) has passed.
_CLOSED = "(epoch_ms(event_time) // 60000 + 1) * 60000 <= epoch_ms((SELECT max(event_time) FROM catalogue)) - 3600000"


def _arriving(df: DataFrame, ts: str, name: str, stream) -> DataFrame:
    """Let ``df`` arrive part by part in time; ``stream`` makes the query of the feed. Returns what it has written."""
    spark = df.sparkSession
    feed, out, checkpoint = _folder(spark, name), _folder(spark, f"{name}-out"), stream_checkpoint(spark, f"{name}-{uuid.uuid4().hex}")
    low, high = df.agg(F.min(F.unix_micros(ts)), F.max(F.unix_micros(ts))).first()
    part = F.least(F.lit(ARRIVALS - 1), F.floor((F.unix_micros(ts) - low) / max(1, (high or 0) - (low or 0)) * ARRIVALS))
    for k in range(ARRIVALS):
        df.filter(part == k).write.mode("append").parquet(feed)
        made = stream(spark.readStream.schema(df.schema).parquet(feed))
        query = (made.writeStream.format("parquet").outputMode("append").option("path", out)
                 .option("checkpointLocation", checkpoint).trigger(availableNow=True).start())
        query.awaitTermination()
    return spark.read.schema(made.schema).parquet(out)


def _learned_sql() -> str:
    from . import REGISTRY
    last = " - INTERVAL 10 MINUTE >= \"timestamp\" + INTERVAL 1 DAY"
    newest = ", ".join(f"(SELECT max(ts) FROM events WHERE event_type = '{kind}')" for kind in ("view", "click"))
    return f"SELECT * FROM ({REGISTRY['online_learning'][1]}) WHERE least({newest}){last}"


@register("online_learning_stream", _learned_sql())
def q_online_learning_stream(spark, d):
    """C8 as one streaming query from both feeds into the keyed table of predictions: all closed windows."""
    from .q_learning import _flat

    table = _folder(spark, "predictions")
    start_online_learning(spark, _json_feed(tb.catalogue(spark, d), "catalogue", CATALOGUE),
                          _json_feed(tb.discussion(spark, d), "discussion", DISCUSSION_SCORED), table,
                          name=f"learn-{uuid.uuid4().hex}", size="1 day", slide="6 hours", delay="10 minutes").awaitTermination()
    return _flat(spark.read.parquet(table))


def _views(spark, d):
    c = tb.catalogue(spark, d)
    return c.select("title", "event_id", F.col("event_time").cast("timestamp").alias("event_time"), "popularity")


@register("history_stream", tb.with_ctes("""
SELECT event_id, len(p) AS n_prior, round(coalesce(list_sum(p), 0.0), 6) AS prior_sum,
       round(coalesce(p[-1], 0.0), 6) AS newest
FROM (SELECT event_id, coalesce(list(popularity) OVER (PARTITION BY title ORDER BY event_time, event_id
             ROWS BETWEEN 5 PRECEDING AND 1 PRECEDING), []) AS p FROM catalogue
      WHERE """ + _CLOSED + ")", "catalogue"))
def q_history_stream(spark, d):
    """T5: the previous five values of a title with each new row, from keyed state, once the watermark has passed it."""
    p = F.col("prior_popularity")
    out = _arriving(_views(spark, d), "event_time", "history", lambda feed: history_stream(
        feed, "title", "event_time", ["popularity"], n=5, tie="event_id"))
    return rounded(out.select("event_id", F.size(p).cast("long").alias("n_prior"),
                              F.aggregate(p, F.lit(0.0), lambda a, x: a + x).alias("prior_sum"),
                              F.coalesce(F.try_element_at(p, F.lit(-1)), F.lit(0.0)).alias("newest")))


@register("first_seen_stream", tb.with_ctes("SELECT DISTINCT title FROM catalogue", "catalogue"))
def q_first_seen_stream(spark, d):
    """Every title once, when it first appears."""
    return _stored(first_seen(_table_feed(_views(spark, d), "first"), "title", "event_time"), "first").select("title")


def _cooldown_sql() -> str:
    from . import REGISTRY
    closed = _CLOSED.replace("FROM catalogue", f"FROM ({tb.SQL['catalogue']})")
    return f"SELECT title, event_id FROM ({REGISTRY['cooldown'][1]}) WHERE {closed}"


@register("cooldown_stream", _cooldown_sql())
def q_cooldown_stream(spark, d):
    """A title passes again only 600 s after its last pass, from keyed state, once the watermark has passed it."""
    return _arriving(_views(spark, d), "event_time", "cooldown", lambda feed: cooldown_stream(
        feed, "title", "event_time", 600, tie="event_id")).select("title", "event_id")


@register("tsv_scan", tb.with_ctes("""
SELECT tconst, CASE WHEN numVotes % 3 = 0 THEN NULL ELSE averageRating END AS "averageRating",
       CASE WHEN numVotes % 5 = 0 THEN NULL ELSE numVotes END AS "numVotes" FROM ratings""", "ratings"))
def q_tsv_scan(spark, d):
    """A tab-separated dump with declared types and the null token."""
    r = tb.ratings(spark, d)
    path = _folder(spark, "ratings-tsv")
    (r.select("tconst", F.when(F.col("numVotes") % 3 != 0, F.col("averageRating")).alias("averageRating"),
              F.when(F.col("numVotes") % 5 != 0, F.col("numVotes")).alias("numVotes"))
     .write.options(sep="\t", header="true", nullValue="\\N").csv(path))
    return read_tsv(spark, path, RATINGS_TSV)
