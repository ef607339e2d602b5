"""Distribution drift between a reference window and a current window.

Per group: population stability index over equal-width bins of the
reference range, the null rate of the current window, and the count of
current values more than ``z`` reference standard deviations from the
reference mean. Everything is algebraic aggregation joined on the group
keys (one row of reference statistics per group), so it is exact and
scales with the data. For a global comparison pass no keys: a constant key
is used.
"""

from __future__ import annotations

from collections.abc import Sequence

from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

from .scan import running_sums


def drift(ref: DataFrame, cur: DataFrame, col: str, keys: Sequence[str] = (), bins: int = 10,
          z: float = 3.0) -> DataFrame:
    keys = list(keys)
    if not keys:
        ref, cur, keys = ref.withColumn("__all", F.lit(1)), cur.withColumn("__all", F.lit(1)), ["__all"]
    stats = ref.groupBy(*keys).agg(F.min(col).alias("__lo"), F.max(col).alias("__hi"),
                                   F.avg(col).alias("__mu"), F.stddev_pop(col).alias("__sd"))

    def binned(df, tag):
        d = df.filter(F.col(col).isNotNull()).join(stats, keys)
        width = F.col("__hi") - F.col("__lo")
        b = F.when(width > 0, F.least(F.lit(bins - 1), F.greatest(F.lit(0), F.floor(
            (F.col(col) - F.col("__lo")) / width * bins).cast("int")))).otherwise(F.lit(0))
        return d.groupBy(*keys, b.alias("bin")).agg(F.count(F.lit(1)).alias(f"n_{tag}"))

    grid = stats.select(*keys, F.explode(F.sequence(F.lit(0), F.lit(bins - 1))).alias("bin"))
    h = (grid.join(binned(ref, "ref"), [*keys, "bin"], "left")
         .join(binned(cur, "cur"), [*keys, "bin"], "left").fillna(0, ["n_ref", "n_cur"]))
    w = Window.partitionBy(*keys)
    h = h.withColumn("p_ref", (F.col("n_ref") + 0.5) / (F.sum("n_ref").over(w) + 0.5 * bins)) \
         .withColumn("p_cur", (F.col("n_cur") + 0.5) / (F.sum("n_cur").over(w) + 0.5 * bins))
    psi = h.groupBy(*keys).agg(F.sum((F.col("p_cur") - F.col("p_ref")) * F.log(F.col("p_cur") / F.col("p_ref")))
                               .alias("psi"))
    out = cur.join(stats, keys).groupBy(*keys).agg(
        F.count(F.lit(1)).alias("n_current"),
        (F.count_if(F.col(col).isNull()) / F.count(F.lit(1))).alias("null_rate"),
        F.count_if(F.abs(F.col(col) - F.col("__mu")) > F.lit(z) * F.col("__sd")).alias("outliers"))
    res = psi.join(out, keys, "left")
    return res.drop("__all") if keys == ["__all"] else res


def distribution_drift(ref: DataFrame, cur: DataFrame, col: str, keys: Sequence[str] = (), fence: float = 1.5) -> DataFrame:
    """The two-sample Kolmogorov-Smirnov distance and the outliers by quartiles, both exact.

    Per group (of both windows together): ``n_reference`` and ``n_current``
    values, ``ks`` the largest distance of the two distribution functions,
    ``q1`` and ``q3`` of the reference (between two ranks: interpolated), and
    ``iqr_outliers``, the current values more than ``fence`` times ``q3 - q1``
    outside them. Null and NaN values count as missing. A side without values
    gives null for what needs it.

    Equal values are counted first. Their cumulative counts over all groups
    come from one range-partitioned scan (:mod:`trendframe.operators.scan`),
    which holds the distance and, by the ranks each value covers, the
    quartiles; no group is sorted in one task.
    """
    keys = list(keys)
    everyone = keys or ["__all"]

    def counted(df, name, other):
        d = df if keys else df.withColumn("__all", F.lit(1))
        d = d.filter(F.col(col).isNotNull() & ~F.isnan(F.col(col).cast("double")))
        return d.select(*everyone, F.col(col).cast("double").alias("__x"), F.lit(1).alias(name), F.lit(0).alias(other))

    both = counted(ref, "__r", "__c").unionByName(counted(cur, "__c", "__r")).groupBy(*everyone, "__x").agg(
        F.sum("__r").alias("__r"), F.sum("__c").alias("__c"))
    scan = running_sums(both, everyone, ["__x"], {"__cr": F.col("__r"), "__cc": F.col("__c")})
    sizes = both.groupBy(*everyone).agg(F.sum("__r").alias("n_reference"), F.sum("__c").alias("n_current"))
    on = scan["__cr"].isNotNull()
    for k in everyone:
        on = on & scan[k].eqNullSafe(sizes[k])
    ranked = scan.join(sizes, on).drop(*[sizes[k] for k in everyone])

    def rank(q, step):
        """The value at the rank below (0) or above (1) the quantile."""
        place = F.least(F.floor((F.col("n_reference") - 1) * q) + step, F.col("n_reference") - 1)
        return F.max(F.when((place >= F.col("__cr") - F.col("__r")) & (place < F.col("__cr")), F.col("__x")))

    distance = F.abs(F.try_divide("__cr", "n_reference") - F.try_divide("__cc", "n_current"))
    found = ranked.groupBy(*everyone).agg(
        F.max("n_reference").alias("n_reference"), F.max("n_current").alias("n_current"), F.max(distance).alias("ks"),
        *[rank(q, k).alias(f"__q{name}{k}") for name, q in (("1", 0.25), ("3", 0.75)) for k in (0, 1)])

    def quantile(name, q):
        at = (F.col("n_reference") - 1) * q
        return F.col(f"__q{name}0") + (F.col(f"__q{name}1") - F.col(f"__q{name}0")) * (at - F.floor(at))

    found = found.withColumns({"q1": quantile("1", 0.25), "q3": quantile("3", 0.75)})
    reach = fence * (F.col("q3") - F.col("q1"))
    fences = found.select(*[F.col(k).alias(f"__k_{k}") for k in everyone], (F.col("q1") - reach).alias("__lo"), (F.col("q3") + reach).alias("__hi"))
    on = F.lit(True)
    for k in everyone:
        on = on & both[k].eqNullSafe(fences[f"__k_{k}"])
    outside = both.join(fences, on).groupBy(*everyone).agg(F.sum(F.when(
        (F.col("__x") < F.col("__lo")) | (F.col("__x") > F.col("__hi")), F.col("__c")).when(F.col("__lo").isNotNull(), 0)).alias("iqr_outliers"))
    on = F.lit(True)
    for k in everyone:
        on = on & found[k].eqNullSafe(outside[k])
    return found.join(outside, on).select(*[found[k] for k in keys], "n_reference", "n_current", "ks", "q1", "q3", "iqr_outliers")
