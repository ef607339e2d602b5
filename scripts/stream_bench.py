"""Streaming trend job measurements: rows per second, rows in state, batch time.

Writes the catalogue and discussion feeds of ``$BENCH_SF_DIR`` as JSON files
(one per day) into a fresh scratch folder, runs the streaming trend job with
``availableNow`` and one file per trigger, and prints one JSON line with the
medians over the micro-batches from ``StreamingQuery.recentProgress``.
"""

from __future__ import annotations

import json
import os
import statistics
import sys
import tempfile
import time

sys.path.insert(0, os.path.dirname(os.path.dirname(os.path.abspath(__file__))))

from pyspark.sql import functions as F  # noqa: E402

from trendframe.schemas import CATALOGUE, DISCUSSION_SCORED  # noqa: E402
from trendframe.session import get_spark  # noqa: E402
from trendframe.sources import testbed as tb  # noqa: E402
from trendframe.streaming.pipeline import read_feed, trend_stream  # noqa: E402

SF = os.environ.get("BENCH_SF_DIR", "/root/testdata/sf0.1")


def stage(df, path):
    (df.withColumn("__day", F.to_date("event_time")).drop("event_time", "event_id")
     .repartition("__day").write.partitionBy("__day").json(path))
    files = []
    for sub in sorted(os.listdir(path)):
        full = os.path.join(path, sub)
        if os.path.isdir(full):
            files += sorted(os.path.join(full, f) for f in os.listdir(full) if f.endswith(".json"))
    flat = path + "_flat"
    os.makedirs(flat)
    for i, f in enumerate(files):
        os.link(f, os.path.join(flat, f"{i:04d}.json"))
    return flat


def main():
    spark = get_spark(master="local[8]", shuffle_partitions=16)
    tmp = tempfile.mkdtemp(prefix="tf-stream-bench-")
    cat = stage(tb.catalogue(spark, SF), os.path.join(tmp, "cat"))
    disc = stage(tb.discussion(spark, SF), os.path.join(tmp, "disc"))
    opts = {"maxFilesPerTrigger": os.environ.get("FILES_PER_TRIGGER", "5")}
    cat_s, disc_s = read_feed(spark, cat, CATALOGUE, options=opts), read_feed(spark, disc, DISCUSSION_SCORED, options=opts)
    if os.environ.get("PLAN", "join") == "one_pass":
        from trendframe.plans.trend import trend_scores_one_pass
        trends = trend_scores_one_pass(cat_s, disc_s)
    else:
        trends = trend_stream(cat_s, disc_s)
    t0 = time.time()
    q = (trends.writeStream.format("noop").outputMode("append")
         .option("checkpointLocation", os.path.join(tmp, "ckpt")).trigger(availableNow=True).start())
    q.awaitTermination(1800)
    wall = time.time() - t0
    prog = [p for p in q.recentProgress if p["numInputRows"] > 0]
    rows = sum(p["numInputRows"] for p in prog)
    state = [sum(op["numRowsTotal"] for op in p["stateOperators"]) for p in prog]
    print(json.dumps({
        "sf": SF, "plan": os.environ.get("PLAN", "join"), "files_per_trigger": opts["maxFilesPerTrigger"],
        "batches": len(prog), "input_rows": rows, "wall_sec": round(wall, 2),
        "rows_per_sec_overall": round(rows / wall, 1),
        "median_processed_rows_per_sec": statistics.median(p["processedRowsPerSecond"] for p in prog),
        "median_batch_ms": statistics.median(p["durationMs"]["triggerExecution"] for p in prog),
        "max_state_rows": max(state), "final_state_rows": state[-1]}))


if __name__ == "__main__":
    main()
