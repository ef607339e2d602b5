"""Streaming = batch on closed windows; late rows dropped; restart and replay safe."""

import os

from pyspark.sql import functions as F

from trendframe.plans.trend import trend_scores
from trendframe.schemas import CATALOGUE, DISCUSSION_SCORED
from trendframe.sources import testbed as tb
from trendframe.sources.io import write_keyed
from trendframe.streaming.pipeline import read_feed, start_trend_job

SF = "/root/testdata/sf0.001"
ONE = {"maxFilesPerTrigger": "1"}  # several micro-batches


def _write_parts(df, path, n_parts):
    """Write the feed as JSON files, one per slice of days (file order = time order)."""
    d = df.withColumn("__part", F.floor((F.dayofmonth("event_time") - 1) * n_parts / 31))
    for p in range(n_parts):
        (d.filter(F.col("__part") == p).drop("__part", "event_time", "event_id")
         .coalesce(1).write.mode("overwrite").json(os.path.join(path, f"part{p:02d}")))


def _flatten(path):
    # the file source reads files directly under the folder: move parts into one folder level
    files = []
    for sub in sorted(os.listdir(path)):
        for f in sorted(os.listdir(os.path.join(path, sub))):
            if f.endswith(".json"):
                files.append(os.path.join(path, sub, f))
    return files


def _stage(spark, tmp):
    cat_src, disc_src = os.path.join(tmp, "cat_src"), os.path.join(tmp, "disc_src")
    _write_parts(tb.catalogue(spark, SF), cat_src, 3)
    _write_parts(tb.discussion(spark, SF), disc_src, 3)
    cat_in, disc_in = os.path.join(tmp, "cat_in"), os.path.join(tmp, "disc_in")
    os.makedirs(cat_in)
    os.makedirs(disc_in)
    for i, f in enumerate(_flatten(cat_src)):
        os.link(f, os.path.join(cat_in, f"{i:03d}.json"))
    for i, f in enumerate(_flatten(disc_src)):
        os.link(f, os.path.join(disc_in, f"{i:03d}.json"))
    return cat_in, disc_in


def test_stream_equals_batch_and_restart(spark, tmpdir_path):
    cat_in, disc_in = _stage(spark, tmpdir_path)
    out = os.path.join(tmpdir_path, "out")
    name = "trend_test_" + os.path.basename(tmpdir_path).replace("-", "_")
    kw = dict(size="1 day", slide="6 hours", delay="10 minutes")

    def run():
        q = start_trend_job(spark, read_feed(spark, cat_in, CATALOGUE, options=ONE),
                            read_feed(spark, disc_in, DISCUSSION_SCORED, options=ONE),
                            out, name=name, **kw)
        q.awaitTermination(600)
        assert q.exception() is None

    run()
    got = spark.read.parquet(os.path.join(out, "trends")).drop("processed_time", "day")
    assert got.count() > 0

    # batch twin restricted to the windows closed by the final watermark
    cat, disc = tb.catalogue(spark, SF), tb.discussion(spark, SF)
    wm = min(cat.agg(F.max("event_time")).first()[0], disc.agg(F.max("event_time")).first()[0])
    batch = trend_scores(cat, disc, **kw).drop("processed_time")
    closed = batch.filter(F.col("window_end") <= F.lit(wm) - F.expr("INTERVAL 10 MINUTES"))
    g = got.select(*[F.col(c).cast("timestamp_ntz") if c.startswith("window_") else F.col(c)
                     for c in batch.columns])
    cols = batch.columns
    assert sorted(map(tuple, g.select(cols).collect())) == sorted(map(tuple, closed.select(cols).collect()))
    before = sorted(map(tuple, got.collect()))

    # restart from the checkpoint with one late row (older than the watermark): it is dropped
    late = os.path.join(tmpdir_path, "late.json")
    spark.createDataFrame([("99999", ["Title 1"], 1000.0, 0.9, "2024-01-02T00:00:00", "reddit")],
                          "post_id string, movie_mentions array<string>, score double, sentiment_score double, "
                          "timestamp string, source string").coalesce(1).write.json(late)
    late_file = [os.path.join(late, f) for f in os.listdir(late) if f.endswith(".json")][0]
    os.link(late_file, os.path.join(disc_in, "999.json"))
    run()
    after = sorted(map(tuple, spark.read.parquet(os.path.join(out, "trends")).drop("processed_time", "day")
                       .collect()))
    assert after == before


def test_keyed_sink_replay_is_idempotent(spark, tmpdir_path):
    path = os.path.join(tmpdir_path, "keyed")
    b1 = spark.createDataFrame([("a", "2024-01-01", 1.0, 1), ("b", "2024-01-01", 2.0, 1)],
                               "k string, day string, v double, o int")
    write_keyed(b1, path, ["k"], order="o", partition_by="day")
    b2 = spark.createDataFrame([("a", "2024-01-01", 5.0, 2)], "k string, day string, v double, o int")
    write_keyed(b2, path, ["k"], order="o", partition_by="day")
    first = sorted(map(tuple, spark.read.parquet(path).select("k", "v").collect()))
    write_keyed(b2, path, ["k"], order="o", partition_by="day")  # replayed batch
    again = sorted(map(tuple, spark.read.parquet(path).select("k", "v").collect()))
    assert first == again == [("a", 5.0), ("b", 2.0)]


def test_online_learning_stream_equals_batch_and_restart(spark, tmpdir_path):
    from trendframe.plans.learning import online_learning
    from trendframe.streaming.online import start_online_learning

    cat_in, disc_in = _stage(spark, tmpdir_path)
    late = [os.path.join(p, sorted(os.listdir(p))[-1]) for p in (cat_in, disc_in)]
    table, name = os.path.join(tmpdir_path, "predictions"), "learn_test_" + os.path.basename(tmpdir_path).replace("-", "_")

    def run():
        q = start_online_learning(spark, read_feed(spark, cat_in, CATALOGUE, options=ONE),
                                  read_feed(spark, disc_in, DISCUSSION_SCORED, options=ONE), table, name=name,
                                  size="1 day", slide="6 hours", delay="10 minutes")
        q.awaitTermination(600)
        assert q.exception() is None
        return {(r.movie_title, r.movie_id, r.timestamp): r for r in spark.read.parquet(table).collect()}

    for f in late:  # the last files come after a restart
        os.rename(f, f + ".later")
        os.rename(f + ".later", os.path.join(tmpdir_path, os.path.basename(os.path.dirname(f)) + os.path.basename(f)))
    first = run()
    for f in late:
        os.rename(os.path.join(tmpdir_path, os.path.basename(os.path.dirname(f)) + os.path.basename(f)), f)
    both = run()
    assert first.keys() < both.keys() and all(both[k] == r for k, r in first.items())
    trends = trend_scores(tb.catalogue(spark, SF), tb.discussion(spark, SF), size="1 day", slide="6 hours")
    want = {(r.movie_title, r.movie_id, r.timestamp): r for r in online_learning(trends).collect()}
    assert set(both) <= set(want) and len(both) >= 0.9 * len(want)
    for k, r in both.items():
        assert abs(r.predicted_trend_score - want[k].predicted_trend_score) < 1e-6 and abs(r.mae - want[k].mae) < 1e-6
        assert r.features.keys() == want[k].features.keys() and (r.r2 is None) == (want[k].r2 is None)
