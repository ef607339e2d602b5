"""Keyed streaming state (T5, T7, T8) equals its batch twin."""

import datetime as dt
import os
import random


from trendframe.streaming.state import cooldown, cooldown_stream, first_seen, history_stream

SCHEMA = "key string, id int, ts timestamp, x double"


def _rows(t0):
    secs = [0, 599, 600, 1199, 1201, 1800, 30, 700]
    keys = ["a", "a", "a", "a", "a", "a", "b", "b"]
    return [(k, i, t0 + dt.timedelta(seconds=s), float(i)) for i, (k, s) in enumerate(zip(keys, secs))]


def _stream(spark, tmp, rows):
    src = os.path.join(tmp, "src")
    for i in range(0, len(rows), 3):  # three files: several micro-batches
        spark.createDataFrame(rows[i:i + 3], SCHEMA).coalesce(1).write.mode("append").parquet(src)
    return spark.readStream.schema(SCHEMA).option("maxFilesPerTrigger", 1).parquet(src)


def _collect(df, name):
    q = df.writeStream.format("memory").queryName(name).outputMode("append").trigger(availableNow=True).start()
    q.awaitTermination(300)
    return q


END = ("z", 99, dt.datetime(2024, 3, 1), 0.0)  # moves the watermark past all other rows


def _files(spark, tmp, rows, each):
    """One file of ``each`` rows after the other, in the order given."""
    src = os.path.join(tmp, "src")
    for i in range(0, len(rows), each):
        spark.createDataFrame(rows[i:i + each], SCHEMA).coalesce(1).write.mode("append").parquet(src)
    return spark.readStream.schema(SCHEMA).option("maxFilesPerTrigger", 1).parquet(src)


def _hot(n=400, late=25):
    """Rows in near time order: key ``a`` has a third of them, others few; no row is later than ``late`` minutes."""
    rng = random.Random(4)
    t0 = dt.datetime(2024, 1, 1)
    rows = [("a" if rng.random() < 0.34 else f"k{rng.randrange(20)}", i, t0 + dt.timedelta(seconds=150 * i), float(i)) for i in range(n)]
    return sorted(rows, key=lambda r: r[2] + dt.timedelta(minutes=rng.uniform(0, late)))


def test_cooldown_stream_equals_batch(spark, tmpdir_path):
    rows = _rows(dt.datetime(2024, 1, 1))
    q = _collect(cooldown_stream(_stream(spark, tmpdir_path, rows + [END]), "key", "ts", 600), "cool_s")
    got = sorted(r.id for r in spark.sql("SELECT id FROM cool_s").collect())
    want = sorted(r.id for r in cooldown(spark.createDataFrame(rows, SCHEMA), "key", "ts", 600).collect())
    assert got == want == [0, 2, 4, 6, 7]
    q.stop()


def test_cooldown_starts_from_a_table(spark, tmpdir_path):
    t0 = dt.datetime(2024, 1, 1)
    start = spark.createDataFrame([("a", t0 - dt.timedelta(seconds=1)), ("c", t0)], "key string, last timestamp")
    q = _collect(cooldown_stream(_stream(spark, tmpdir_path, _rows(t0) + [END]), "key", "ts", 600, initial=start), "cool_i")
    assert sorted(r.id for r in spark.table("cool_i").collect()) == [1, 3, 5, 6, 7]
    q.stop()


def _prior(rows, n):
    out = {}
    for key in {r[0] for r in rows}:
        own = sorted((r for r in rows if r[0] == key), key=lambda r: r[2:0:-1])
        out |= {r[1]: [x[3] for x in own[max(0, k - n):k]] for k, r in enumerate(own)}
    return out


def test_history_stream(spark, tmpdir_path):
    rows = _rows(dt.datetime(2024, 1, 1))
    q = _collect(history_stream(_stream(spark, tmpdir_path, rows + [END]), "key", "ts", ["x"], n=2), "hist_s")
    assert {r.id: r.prior_x for r in spark.table("hist_s").collect()} == _prior(rows, 2)
    q.stop()


def test_hot_key_out_of_order_and_restart(spark, tmpdir_path, monkeypatch):
    from trendframe.streaming import ordered
    monkeypatch.setattr(ordered, "CHUNK", 3)
    rows = _hot()
    head, tail = rows[:250], rows[250:] + [END]
    want = sorted((r.key, r.id) for r in cooldown(spark.createDataFrame(rows, SCHEMA), "key", "ts", 600, tie="id").collect())
    out = {name: os.path.join(tmpdir_path, name) for name in ("cool", "hist")}
    for part in (head, tail):  # the second run goes on from the first one's state
        feed = _files(spark, tmpdir_path, part, 60)
        for name, df in (("cool", cooldown_stream(feed, "key", "ts", 600, tie="id")),
                         ("hist", history_stream(feed, "key", "ts", ["x"], n=3, tie="id"))):
            q = (df.writeStream.format("parquet").option("path", out[name]).outputMode("append").trigger(availableNow=True)
                 .option("checkpointLocation", out[name] + "-state").start())
            q.awaitTermination(600)
            assert q.exception() is None
    assert sorted((r.key, r.id) for r in spark.read.parquet(out["cool"]).collect()) == want
    assert {r.id: r.prior_x for r in spark.read.parquet(out["hist"]).collect()} == _prior(rows, 3)


def test_state_does_not_depend_on_how_arrow_cuts_a_batch(spark, tmpdir_path):
    t0 = dt.datetime(2024, 1, 1)
    rows = [("a", i, t0 + dt.timedelta(seconds=600 * i), float(i)) for i in (5, 2, 0, 4, 1, 3)]
    rows += [("b", i, t0 + dt.timedelta(seconds=299 * i), float(i)) for i in (9, 6, 8, 7)]
    src = os.path.join(tmpdir_path, "src")
    spark.createDataFrame(rows + [END], SCHEMA).coalesce(1).write.parquet(src)
    before = spark.conf.get("spark.sql.execution.arrow.maxRecordsPerBatch")
    spark.conf.set("spark.sql.execution.arrow.maxRecordsPerBatch", "3")
    try:
        read = spark.readStream.schema(SCHEMA).parquet(src)
        q = _collect(cooldown_stream(read, "key", "ts", 600), "cool_cut")
        want = sorted((r.key, r.id) for r in cooldown(spark.createDataFrame(rows, SCHEMA), "key", "ts", 600).collect())
        assert sorted((r.key, r.id) for r in spark.table("cool_cut").collect()) == want
        assert want == [("a", i) for i in range(6)] + [("b", 6), ("b", 9)]
    finally:
        spark.conf.set("spark.sql.execution.arrow.maxRecordsPerBatch", before)
    q.stop()


def test_first_seen_emits_a_key_once_for_good(spark, tmpdir_path):
    t0 = dt.datetime(2024, 1, 1)
    rows = [("a", 0, t0, 0.0), ("b", 1, t0 + dt.timedelta(hours=9), 0.0), ("c", 2, t0 + dt.timedelta(hours=18), 0.0),
            ("a", 3, t0 + dt.timedelta(days=2), 0.0), ("a", 4, t0 + dt.timedelta(days=3), 0.0), ("b", 5, t0 + dt.timedelta(days=4), 0.0)]
    q = _collect(first_seen(_stream(spark, tmpdir_path, rows), "key", "ts"), "first_once")
    assert sorted(r.id for r in spark.table("first_once").collect()) == [0, 1, 2]
    q.stop()


def test_first_seen_stream(spark, tmpdir_path):
    rows = _rows(dt.datetime(2024, 1, 1))
    q = _collect(first_seen(_stream(spark, tmpdir_path, rows), "key", "ts"), "first_s")
    got = sorted(r.id for r in spark.sql("SELECT id FROM first_s").collect())
    want = sorted(r.id for r in first_seen(spark.createDataFrame(rows, SCHEMA), "key", "ts").collect())
    assert got == want == [0, 6]
    q.stop()


def test_global_learner_stream_equals_batch_steps(spark, tmpdir_path):
    import numpy as np

    from trendframe.operators.learn import minibatch_step
    from trendframe.streaming.learning import start_global_learner

    schema = "k string, t int, a double, b double, y double"
    rng = np.random.default_rng(5)
    rows = [(f"m{i % 3}", i, float(rng.normal()), float(rng.normal()), float(rng.normal() * 5 + 20))
            for i in range(12)]
    src = os.path.join(tmpdir_path, "trend_rows")
    chunks = [rows[0:4], rows[4:8], rows[8:12]]
    for i, c in enumerate(chunks):
        spark.createDataFrame(c, schema).coalesce(1).write.parquet(os.path.join(src, f"p{i}"))
        # flatten: one file per chunk directly under the source folder
    flat = os.path.join(tmpdir_path, "flat")
    os.makedirs(flat)
    for i in range(3):
        d = os.path.join(src, f"p{i}")
        f = [x for x in os.listdir(d) if x.endswith(".parquet")][0]
        os.link(os.path.join(d, f), os.path.join(flat, f"{i:03d}.parquet"))
    out = {}

    def sink(df, batch_id):
        out[batch_id] = sorted((r.t, r.prediction) for r in df.collect())

    stream = spark.readStream.schema(schema).option("maxFilesPerTrigger", 1).parquet(flat)
    q = start_global_learner(spark, stream, ["a", "b"], "y", sink, name="learn_" + os.path.basename(tmpdir_path))
    q.awaitTermination(300)
    state, want = None, []
    for c in chunks:
        o, state = minibatch_step(spark.createDataFrame(c, schema), ["a", "b"], "y", state)
        want.append(sorted((r.t, r.prediction) for r in o.collect()))
    got = [out[k] for k in sorted(out)]
    assert len(got) == 3
    for g, w in zip(got, want):
        assert [t for t, _ in g] == [t for t, _ in w]
        assert np.allclose([p for _, p in g], [p for _, p in w], atol=1e-9)
