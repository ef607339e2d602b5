"""Online regression on the trend stream (T6, A9 running form, C8 parts).

The learner is a standard scaler followed by a linear model trained by SGD
(learning rate 0.01, L2 0.001 on the weights), evaluated prequentially:
every row is first predicted with the model as it stands, then used to
learn. The order per row is fixed here (upstream depends on a third-party
library whose internal order is not in the tree):

1. scale ``x`` with the running mean / standard deviation (0 where the
   deviation is ``FLAT`` or less) and predict ``w . x_s + b``;
2. update the running moments with ``x`` (Welford);
3. re-scale ``x`` with the new moments and take one gradient step on the
   half squared error: ``w -= lr * ((p - y) * x_s + l2 * w)``,
   ``b -= lr * (p - y)``.

Two distributions of the work:

* **per key** (:func:`prequential_per_key`): one model per title, run as a
  sorted scan (:func:`scan_sorted`) that holds one title's model at a time;
  no title's rows are ever gathered in memory.
* **global, mini-batch** (:func:`minibatch_step`): one model for all
  titles, updated once per micro-batch from aggregated gradients (one
  ``agg``), predictions made with the weights of the previous batch;
  moments merged with Chan's parallel formula. Suited to ``foreachBatch``.
"""

from __future__ import annotations

from collections.abc import Sequence

import numpy as np
import pandas as pd
from pyspark.sql import DataFrame
from pyspark.sql import functions as F
from pyspark.sql import types as T

from .scan import running_sums

LR = 0.01
L2 = 0.001
#: A standard deviation up to which a feature has not varied (sums in another order differ by less).
FLAT = 1e-9


def sgd_prequential(X: np.ndarray, y: np.ndarray, lr: float = LR, l2: float = L2):
    """Reference implementation on arrays; returns predictions and final state."""
    n, k = X.shape
    mean, m2, cnt = np.zeros(k), np.zeros(k), 0
    w, b = np.zeros(k), 0.0
    preds = np.empty(n)
    for i in range(n):
        x = X[i]
        sd = np.sqrt(m2 / cnt) if cnt > 0 else np.zeros(k)
        xs = np.divide(x - mean, sd, out=np.zeros(k), where=sd > FLAT)
        preds[i] = float(w @ xs + b)
        cnt += 1
        delta = x - mean
        mean = mean + delta / cnt
        m2 = m2 + delta * (x - mean)
        sd = np.sqrt(m2 / cnt)
        xs = np.divide(x - mean, sd, out=np.zeros(k), where=sd > FLAT)
        err = float(w @ xs + b) - y[i]
        w = w - lr * (err * xs + l2 * w)
        b = b - lr * err
    return preds, (mean, m2, cnt, w, b)


def scan_sorted(df: DataFrame, key: str, order: Sequence[str], step, schema: T.StructType,
                partitions: int | None = None) -> DataFrame:
    """Sequential per-key scan with state carried across rows.

    Rows are hash-partitioned by ``key`` and sorted by ``(key, order)``
    inside each partition; ``step(state, row) -> (state, out_row)`` runs in
    a ``mapInPandas`` generator that keeps one key's state at a time. No
    group is ever materialised: memory is bounded by the Arrow batch, even
    for a key that holds a third of all rows.
    """
    n = partitions or int(df.sparkSession.conf.get("spark.sql.shuffle.partitions"))
    srt = df.repartition(n, key).sortWithinPartitions(key, *order)
    names = [f.name for f in schema.fields]

    def run(batches):
        cur, state = object(), None
        for pdf in batches:
            rows = []
            for rec in pdf.itertuples(index=False):
                r = rec._asdict()
                if r[key] != cur:
                    cur, state = r[key], None
                state, out = step(state, r)
                if out is not None:
                    rows.append(out)
            yield pd.DataFrame(rows, columns=names)
    return srt.mapInPandas(run, schema)


def learner_step(st: dict | None, x: Sequence, y, lr: float = LR, l2: float = L2) -> tuple[dict, list]:
    """One row through one model: predict, measure, learn.

    ``st`` is the model with its running sums (None: a new one); a missing
    value counts as 0. Returns the new state and ``[actual, prediction, error,
    mae, rmse, r2]``, the last None while the target has not varied.
    """
    x = np.array([0.0 if v is None or v != v else float(v) for v in x])
    y = 0.0 if y is None or y != y else float(y)
    k = len(x)
    if st is None:
        st = {"n": 0, "mean": np.zeros(k), "m2": np.zeros(k), "w": np.zeros(k), "b": 0.0, "ae": 0.0, "se": 0.0,
              "y_mean": 0.0, "y_m2": 0.0}
    n, mean, m2, w, b = st["n"], st["mean"], st["m2"], st["w"], st["b"]
    sd = np.sqrt(m2 / n) if n > 0 else np.zeros(k)
    xs = np.divide(x - mean, sd, out=np.zeros(k), where=sd > FLAT)
    p = float(w @ xs + b)
    n += 1
    delta = x - mean
    mean = mean + delta / n
    m2 = m2 + delta * (x - mean)
    sd = np.sqrt(m2 / n)
    xs = np.divide(x - mean, sd, out=np.zeros(k), where=sd > FLAT)
    e = float(w @ xs + b) - y
    err = abs(y - p)
    ae, se = st["ae"] + err, st["se"] + err * err
    y_mean = st["y_mean"] + (y - st["y_mean"]) / n
    y_m2 = st["y_m2"] + (y - st["y_mean"]) * (y - y_mean)
    new = {"n": n, "mean": mean, "m2": m2, "w": w - lr * (e * xs + l2 * w), "b": b - lr * e, "ae": ae, "se": se,
           "y_mean": y_mean, "y_m2": y_m2}
    return new, [y, p, err, ae / n, float(np.sqrt(se / n)), 1.0 - se / y_m2 if y_m2 > n * FLAT ** 2 else None]


def prequential_per_key(df: DataFrame, key: str, order: Sequence[str], features: Sequence[str],
                        target: str, lr: float = LR, l2: float = L2, carry: Sequence[str] = ()) -> DataFrame:
    """T6 (b): one prequential model per key; returns the key/order columns
    with ``actual``, ``prediction``, ``error`` and the running ``mae``, ``rmse``, ``r2``.

    ``carry`` lists further columns that go through with their row, so nothing
    has to be joined back. ``order`` should name a row within its key.

    Runs as a sorted scan (:func:`scan_sorted`), the model state of one key
    at a time (``O(features)``)."""
    feats, order = list(features), list(order)
    keep = list(dict.fromkeys([key, *order, *carry]))
    schema = T.StructType([df.schema[c] for c in keep] + [
        T.StructField(c, T.DoubleType()) for c in ("actual", "prediction", "error", "mae", "rmse", "r2")])

    def step(st, r):
        st, out = learner_step(st, [r[c] for c in feats], r[target], lr, l2)
        return st, [*(r[c] for c in keep), *out]

    cols = list(dict.fromkeys([*keep, *feats, target]))
    return scan_sorted(df.select(*cols), key, order, step, schema)


def running_metrics(df: DataFrame, key: str | None, order: Sequence[str], y: str, yhat: str) -> DataFrame:
    """A9 running form: cumulative MAE, RMSE and R2 in ``order`` (per ``key`` if given).

    R2 is NULL while the target has not varied (a variance of 1e-9 or less).
    Over all rows the sums are scanned in parallel
    (:func:`trendframe.operators.scan.running_sums`); ``order`` names a row.
    """
    from pyspark.sql import Window
    e = F.col(y) - F.col(yhat)
    if key:
        w = Window.partitionBy(key).orderBy(*order).rowsBetween(Window.unboundedPreceding, 0)
        mae, mse, spread = F.avg(F.abs(e)).over(w), F.avg(e * e).over(w), F.var_pop(y).over(w)
        rows = df
    else:
        # sums of the target's distance from its mean: squares stay small
        centre = df.agg(F.avg(y)).first()[0] or 0.0
        off = F.col(y) - F.lit(float(centre))
        rows = running_sums(df, [], order, {"__n": F.col(y).isNotNull().cast("long"), "__ae": F.abs(e), "__se": e * e,
                                            "__y": off, "__yy": off * off})
        n = F.col("__n")
        mae, mse = F.try_divide("__ae", n), F.try_divide("__se", n)
        spread = F.try_divide("__yy", n) - F.try_divide("__y", n) * F.try_divide("__y", n)
    return rows.select(*df.columns, mae.alias("running_mae"), F.sqrt(mse).alias("running_rmse"),
                       F.when(spread > 1e-9, 1.0 - mse / spread).alias("running_r2"))


# ------------------------------------------------------------ global model

def minibatch_step(batch: DataFrame, features: Sequence[str], target: str, state: dict | None,
                   lr: float = LR, l2: float = L2) -> tuple[DataFrame, dict]:
    """T6 (a): predict a micro-batch with ``state``, then update it.

    ``state``: ``{"n", "mean", "m2", "w", "b"}`` (lists) or ``None``. The
    batch statistics (count, sums, sums of squares, gradient sums) come
    from one aggregation; the driver only handles ``O(features)`` numbers.
    Returns the batch with ``prediction`` and the new state.
    """
    k = len(features)
    st = state or {"n": 0, "mean": [0.0] * k, "m2": [0.0] * k, "w": [0.0] * k, "b": 0.0}
    mean, m2, n0 = np.array(st["mean"]), np.array(st["m2"]), st["n"]
    sd = np.sqrt(m2 / n0) if n0 > 0 else np.zeros(k)

    def scaled(c, i, mu, s):
        return ((value(c) - float(mu[i])) / float(s[i])) if s[i] > FLAT else F.lit(0.0)

    def value(c):  # a missing feature counts as 0
        return F.coalesce(F.col(c).cast("double"), F.lit(0.0))

    pred = F.lit(float(st["b"]))
    for i, c in enumerate(features):
        pred = pred + F.lit(float(st["w"][i])) * scaled(c, i, mean, sd)
    out = batch.withColumn("prediction", pred)

    # moments of the batch, merged into the running moments (Chan et al.)
    aggs = [F.count(F.lit(1)).alias("n")]
    for i, c in enumerate(features):
        aggs += [F.avg(value(c)).alias(f"m{i}"), F.coalesce(F.var_pop(value(c)), F.lit(0.0)).alias(f"v{i}")]
    # rows without a target are predicted but teach nothing
    batch = batch.filter(F.col(target).isNotNull())
    row = batch.agg(*aggs).first()
    nb = row["n"]
    if nb == 0:
        return out, st
    bm = np.array([row[f"m{i}"] for i in range(k)], dtype=float)
    bm2 = np.array([row[f"v{i}"] for i in range(k)], dtype=float) * nb
    n1 = n0 + nb
    delta = bm - mean
    mean1 = mean + delta * nb / n1
    m21 = m2 + bm2 + delta * delta * n0 * nb / n1
    sd1 = np.sqrt(m21 / n1)

    # mean gradient of the half squared error under the new scaling
    w, b = np.array(st["w"]), float(st["b"])
    p1 = F.lit(b)
    for i, c in enumerate(features):
        p1 = p1 + F.lit(float(w[i])) * scaled(c, i, mean1, sd1)
    err = p1 - F.col(target).cast("double")
    g = batch.agg(F.avg(err).alias("gb"),
                  *[F.avg(err * scaled(c, i, mean1, sd1)).alias(f"g{i}") for i, c in enumerate(features)]).first()
    gw = np.array([g[f"g{i}"] for i in range(k)], dtype=float)
    w1 = w - lr * (gw + l2 * w)
    b1 = b - lr * g["gb"]
    return out, {"n": n1, "mean": mean1.tolist(), "m2": m21.tolist(), "w": w1.tolist(), "b": b1}


def minibatch_history(df: DataFrame, batch: str, features: Sequence[str], target: str,
                      lr: float = LR, l2: float = L2) -> DataFrame:
    """T6 (a) over a whole table: ``prediction`` of each row by the global model
    as it stood before the row's batch, batches in the order of ``batch``.

    Equal to calling :func:`minibatch_step` batch by batch, but every batch
    enters an update only through its means and covariances, so one
    aggregation (combined map-side) gives all that the updates need: one row
    per batch with ``O(features^2)`` numbers. The states, one per batch, are
    joined back to the rows. A missing feature counts as 0; rows without a
    target are predicted but teach nothing.
    """
    spark, k = df.sparkSession, len(features)
    x = [F.coalesce(F.col(c).cast("double"), F.lit(0.0)) for c in features]
    y = F.col(target).cast("double")
    aggs = [F.count(F.lit(1)).alias("n"), F.avg(y).alias("y")]
    aggs += [F.avg(a).alias(f"m{i}") for i, a in enumerate(x)]
    aggs += [F.covar_pop(x[i], x[j]).alias(f"c{i}_{j}") for i in range(k) for j in range(i, k)]
    aggs += [F.covar_pop(x[i], y).alias(f"y{i}") for i in range(k)]
    moments = df.filter(F.col(target).isNotNull()).groupBy(batch).agg(*aggs).orderBy(batch).collect()
    every = df.select(batch).distinct().orderBy(batch).collect()
    known = {r[batch]: r for r in moments}
    n, mean, m2, w, b = 0, np.zeros(k), np.zeros(k), np.zeros(k), 0.0
    states = []
    for r in every:
        sd = np.sqrt(m2 / n) if n else np.zeros(k)
        states.append((r[batch], float(b), w.tolist(), mean.tolist(), sd.tolist()))
        got = known.get(r[batch])
        if got is None:
            continue
        m = np.array([got[f"m{i}"] for i in range(k)])
        cov = np.array([[got[f"c{min(i, j)}_{max(i, j)}"] for j in range(k)] for i in range(k)]).reshape(k, k)
        nb, total = got["n"], n + got["n"]
        m2 = m2 + np.diag(cov) * nb + (m - mean) ** 2 * n * nb / total
        mean = mean + (m - mean) * nb / total
        n = total
        sd = np.sqrt(m2 / n)
        inv = np.divide(1.0, sd, out=np.zeros(k), where=sd > FLAT)
        off = m - mean
        second = (cov + np.outer(off, off)) * np.outer(inv, inv)           # mean of xs_i * xs_j
        with_y = (np.array([got[f"y{i}"] for i in range(k)]) + got["y"] * off) * inv
        grad = b * off * inv + second @ w - with_y
        err = b + float(w @ (off * inv)) - got["y"]
        w, b = w - lr * (grad + l2 * w), b - lr * err
    kind = df.schema[batch].dataType.simpleString()
    state = spark.createDataFrame(states, f"__batch {kind}, __b double, __w array<double>, __mean array<double>, __sd array<double>")
    joined = df.join(state, F.col(batch) == F.col("__batch"))
    pred = F.col("__b")
    for i, a in enumerate(x):
        scale = F.element_at("__sd", i + 1)
        pred = pred + F.when(scale > FLAT, F.element_at("__w", i + 1) * (a - F.element_at("__mean", i + 1)) / scale).otherwise(0.0)
    return joined.withColumn("prediction", pred).select(*df.columns, "prediction")
