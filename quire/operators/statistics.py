"""Statistics of a numeric column by group.

Sums and moments are ordinary aggregates: partial sums in each task, one row a group shuffled. What needs order
(median, quantiles, Gini, k smallest) goes through ``ranked``, which never sorts a group in one task.

Nulls are left out of every statistic; groups without values have no row; a ratio whose divisor is 0 is null (Gini: 0);
NaN is a value like any other. Rows of a null group are left out where order or a group's totals are needed.
"""

from __future__ import annotations

import math
from collections.abc import Iterator
from functools import reduce

import numpy as np
import pyarrow as pa
from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from quire.functions.maths import sigmoid
from quire.plans.session import cut


def _values(df: DataFrame, keys: list[str], value: str) -> DataFrame:
    return df.select(*keys, F.col(value).cast("double").alias("x")).where("x is not null")


def _with(df: DataFrame, keys: list[str], *aggregates: Column) -> DataFrame:
    """df with aggregates of its group. The aggregate table has a row a group; Spark broadcasts it if it is small."""
    totals = df.groupBy(*keys).agg(*aggregates)
    return df.join(totals, keys) if keys else df.crossJoin(totals)


# ---- order


def ranked(df: DataFrame, keys: list[str], value: str) -> DataFrame:
    """keys, x, n (rows of this value), before (rows of smaller ones), total: every distinct value of a group with its rank.

    Values are counted first and range-partitioned by group and value, which cuts large groups into pieces; ranks are
    taken within pieces, and the sizes of a group's pieces before are added. A task sorts one piece. The pieces are
    written out once, as both steps must see the same.
    """
    counts = _values(df, keys, value).groupBy(*keys, "x").agg(F.count("*").alias("n"))
    placed = cut(counts.repartitionByRange(*keys, "x").withColumn("piece", F.spark_partition_id()))
    sizes = placed.groupBy(*keys, "piece").agg(F.sum("n").alias("size"))
    earlier = Window.partitionBy(*keys).orderBy("piece").rowsBetween(Window.unboundedPreceding, -1)
    starts = sizes.select(*keys, "piece", F.coalesce(F.sum("size").over(earlier), F.lit(0)).alias("start"), F.sum("size").over(Window.partitionBy(*keys)).alias("total"))
    within = Window.partitionBy(*keys, "piece").orderBy("x").rowsBetween(Window.unboundedPreceding, -1)
    ranks = placed.withColumn("inside", F.coalesce(F.sum("n").over(within), F.lit(0)))
    return ranks.join(starts, [*keys, "piece"]).select(*keys, "x", "n", (F.col("start") + F.col("inside")).alias("before"), "total")


def _at(rank: Column) -> Column:
    """The value at a 0-based rank, as an aggregate over ranked()."""
    return F.max(F.when((F.col("before") <= rank) & (rank < F.col("before") + F.col("n")), F.col("x")))


def median(df: DataFrame, keys: list[str], value: str) -> DataFrame:
    r = ranked(df, keys, value)
    low, high = F.floor((F.col("total") - 1) / 2), F.floor(F.col("total") / 2)
    return r.groupBy(*keys).agg(((_at(low) + _at(high)) / 2).alias("median"))


def quantile_linear(df: DataFrame, keys: list[str], value: str, p: float) -> DataFrame:
    """Linear interpolation between the neighbouring order statistics."""
    r = ranked(df, keys, value)
    place = (F.col("total") - 1) * F.lit(float(p))
    low = _at(F.floor(place))
    high = _at(F.ceil(place))
    part = F.max(place - F.floor(place))
    return r.groupBy(*keys).agg((low + (high - low) * part).alias("quantile"))


def soft_percentile(df: DataFrame, keys: list[str], value: str, p: float) -> DataFrame:
    """The (int((1-p) n) + 1)-th largest; averaged with the next larger where p n is that integer. Where more values are asked for than there are, null."""
    r = ranked(df, keys, value)
    place = F.floor(F.lit(1 - float(p)) * F.col("total"))
    own = _at(F.col("total") - 1 - place)
    larger = _at(F.col("total") - place)
    even = F.max(F.when(F.lit(float(p)) * F.col("total") == place, 1).otherwise(0)) == 1
    return r.groupBy(*keys).agg(F.when(even, (own + larger) / 2).otherwise(own).alias("percentile"))


def bottom_average(df: DataFrame, keys: list[str], value: str, k: int) -> DataFrame:
    """Mean of the k smallest; null where there are fewer."""
    r = ranked(df, keys, value)
    used = F.greatest(F.lit(0), F.least(F.col("n"), F.lit(k) - F.col("before")))
    return r.groupBy(*keys).agg(F.when(F.max("total") >= k, F.sum(used * F.col("x")) / k).alias("bottom_average"))


def middle(df: DataFrame, keys: list[str], order: str, pct: float) -> DataFrame:
    """Rows in the middle ``pct`` of a group, by their order: int(n pct) rows from int((n - that) / 2) on. ``order`` is unique in a group."""
    r = ranked(df, keys, order)
    take = F.floor(F.col("total") * F.lit(float(pct)))
    start = F.floor((F.col("total") - take) / 2)
    return r.where((F.col("before") >= start) & (F.col("before") < start + take)).select(*keys, F.col("x").alias(order))


def gini(df: DataFrame, keys: list[str], value: str, *, pairs: bool = False) -> DataFrame:
    """Sum (2i - n - 1) x_i / (n sum x) over sorted values; ``pairs``: the same by all pairs, over n (n - 1) mean, halved. Both from ranks, without pairs."""
    r = ranked(df, keys, value)
    n = F.max("total").cast("double")
    weighted = F.sum(F.col("x") * F.col("n") * (2 * F.col("before") + F.col("n") - F.col("total")))
    total = F.sum(F.col("x") * F.col("n"))
    out = weighted / ((n - 1) * total) if pairs else weighted / (n * total)
    return r.groupBy(*keys).agg(F.coalesce(F.when(total != 0, out) if not pairs else F.when((total != 0) & (n > 1), out), F.lit(0.0)).alias("gini"))


def differentiable_quantile(df: DataFrame, keys: list[str], value: str, q: float) -> DataFrame:
    """Mean weighted by sigmoid(100 (x - t)), t the int(q (n - 1))-th smallest."""
    r = ranked(df, keys, value)
    t = r.groupBy(*keys).agg(_at(F.floor(F.lit(float(q)) * (F.col("total") - 1))).alias("t"))
    joined = r.join(t, keys) if keys else r.crossJoin(t)
    w = sigmoid(100 * (F.col("x") - F.col("t"))) * F.col("n")
    return joined.groupBy(*keys).agg(F.try_divide(F.sum(w * F.col("x")), F.sum(w)).alias("quantile"))


def soft_percentile_count(df: DataFrame, keys: list[str], value: str, p: float, steps: int = 20) -> DataFrame:
    """The threshold above which the soft count (slope 10) is the share ``p``, by bisection between minimum and maximum. The direction is the one that converges to it."""
    counts = _values(df, keys, value).groupBy(*keys, "x").agg(F.count("*").alias("n"))
    bounds = counts.groupBy(*keys).agg(F.min("x").alias("low"), F.max("x").alias("high"), F.sum("n").alias("total"))
    for i in range(steps):
        joined = counts.join(bounds, keys) if keys else counts.crossJoin(bounds)
        mid = (F.col("low") + F.col("high")) / 2
        share = F.sum(sigmoid(10 * (F.col("x") - mid)) * F.col("n")) / F.max("total")
        now = joined.groupBy(*keys, "low", "high", "total").agg((share > p).alias("above"))
        bounds = now.select(*keys, F.when(F.col("above"), mid).otherwise(F.col("low")).alias("low"), F.when(F.col("above"), F.col("high")).otherwise(mid).alias("high"), "total")
        if i % 10 == 9:
            bounds = cut(bounds)
    return bounds.select(*keys, ((F.col("low") + F.col("high")) / 2).alias("threshold"))


def top_elements(df: DataFrame, keys: list[str], index: str, value: str, k: int) -> DataFrame:
    """The k greatest with their index, ties by index."""
    w = Window.partitionBy(*keys).orderBy(F.col("x").desc(), F.col(index))
    return df.select(*keys, index, F.col(value).cast("double").alias("x")).where("x is not null").withColumn("rank", F.row_number().over(w)).where(F.col("rank") <= k)


# ---- moments


def moments(df: DataFrame, keys: list[str], value: str) -> DataFrame:
    """Sample-deviation flavour of skewness and excess kurtosis, and its absolute value (normality)."""
    n = F.count("x").cast("double")
    back = (n - 1) / n
    skew = F.skewness("x") * F.pow(back, F.lit(1.5))
    kurt = (F.kurtosis("x") + 3) * back * back - 3
    return _values(df, keys, value).groupBy(*keys).agg(skew.alias("skewness"), kurt.alias("kurtosis"), F.abs(kurt).alias("normality"))


def kurtosis_unbiased(df: DataFrame, keys: list[str], value: str) -> DataFrame:
    """Sample excess kurtosis G2; null below four values."""
    n = F.count("x").cast("double")
    z4 = (F.kurtosis("x") + 3) * (n - 1) * (n - 1) / n  # sum of fourth powers of (x - mean) / sample deviation
    g2 = n * (n + 1) / ((n - 1) * (n - 2) * (n - 3)) * z4 - 3 * (n - 1) * (n - 1) / ((n - 2) * (n - 3))
    return _values(df, keys, value).groupBy(*keys).agg(F.when(n > 3, g2).alias("kurtosis"))


def scaled_variance(df: DataFrame, keys: list[str], value: str) -> DataFrame:
    return _values(df, keys, value).groupBy(*keys).agg(F.try_divide(F.var_pop("x"), F.avg("x") * F.avg("x")).alias("scaled_variance"))


def deviation_over_mean_abs(df: DataFrame, keys: list[str], column: str, value: str) -> DataFrame:
    """Mean over columns of sample deviation by mean absolute value. Long form: one row an element."""
    by = _values(df, [*keys, column], value).groupBy(*keys, column).agg(F.try_divide(F.stddev_samp("x"), F.avg(F.abs("x"))).alias("ratio"))
    return by.groupBy(*keys).agg(F.avg("ratio").alias("sd_over_mean_abs"))


def scaled_to_range(df: DataFrame, keys: list[str], value: str, *keep: str) -> DataFrame:
    """(x - min) / (max - min + 1e-8) within each group."""
    rows = df.select(*keys, *keep, F.col(value).cast("double").alias("x")).where("x is not null")
    return _with(rows, keys, F.min("x").alias("_low"), F.max("x").alias("_high")).select(*keys, *keep, ((F.col("x") - F.col("_low")) / (F.col("_high") - F.col("_low") + 1e-8)).alias("scaled"))


# ---- entropy


def _entropy(p: Column) -> Column:
    """-p ln p; 0 for 0, where the bare formula has no value."""
    return F.when(p > 0, -p * F.ln(p)).otherwise(0.0)


def entropies(df: DataFrame, keys: list[str], value: str, power: float = 2.0) -> DataFrame:
    """entropy of shares x / (sum + 1e-5), its share of the maximum, the penalty max / entropy - 1, and that penalty of the shares of x^power."""
    rows = _with(_values(df, keys, value), keys, F.sum("x").alias("_sum"), F.sum(F.pow("x", F.lit(power))).alias("_powers"), F.count("*").alias("_n"))
    h = F.sum(_entropy(F.try_divide(F.col("x"), F.col("_sum") + 1e-5)))
    hp = F.sum(_entropy(F.try_divide(F.pow("x", F.lit(power)), F.col("_powers"))))
    most = F.ln(F.max("_n").cast("double"))
    return rows.groupBy(*keys).agg(h.alias("entropy"), F.try_divide(h, most).alias("share_of_max"), (F.try_divide(most, h) - 1).alias("penalty"), (F.try_divide(most, hp) - 1).alias("powered_penalty"))


# ---- soft counts


def _by_deviation(x: Column, sd: Column) -> Column:
    """x / sd; where all values are equal, as far beyond as a number goes."""
    return F.when(sd.isNotNull(), F.when(sd != 0, F.try_divide(x, sd)).otherwise(F.signum(x) * 1e300))


def count_above(df: DataFrame, keys: list[str], value: str, level: float, beta: float = 100.0) -> DataFrame:
    return _values(df, keys, value).groupBy(*keys).agg(F.sum(sigmoid((F.col("x") - level) * beta)).alias("count_above"))


def count_below(df: DataFrame, keys: list[str], value: str, threshold: float, scale: float = 100.0) -> DataFrame:
    """Soft count below a threshold, its slope twice ``scale`` by the sample deviation."""
    rows = _with(_values(df, keys, value), keys, F.stddev_samp("x").alias("_sd"))
    return rows.groupBy(*keys).agg(F.sum(1 - sigmoid(_by_deviation((F.col("x") - threshold) * (2 * scale), F.col("_sd")))).alias("count_below"))


def columns_below(df: DataFrame, column: str, value: str, least: float, elements: float, scale: float = 100.0, most_columns: float | None = None) -> DataFrame:
    """Soft number of columns with fewer than 0.9 ``elements`` values of at least ``least``; with ``most_columns`` the soft answer whether they are more than that."""
    rows = _with(_values(df, [column], value), [], F.stddev_samp("x").alias("_sd"))
    by = rows.groupBy(column).agg(F.sum(1 - sigmoid(_by_deviation((least - F.col("x")) * (2 * scale), F.col("_sd")))).alias("filled"))
    out = count_below(by, [], "filled", elements * 0.9, scale).withColumnRenamed("count_below", "columns_below")
    if most_columns is None:
        return out
    return out.select(sigmoid((F.col("columns_below") - most_columns - 0.2) * scale).alias("too_many"))


def soft_extremes(df: DataFrame, keys: list[str], value: str, beta: float = 100.0) -> DataFrame:
    """Means weighted by e^(-beta x) and e^(beta x), taken from the extremes so that nothing overflows."""
    rows = _with(_values(df, keys, value), keys, F.min("x").alias("_low"), F.max("x").alias("_high"))
    down, up = F.exp((F.col("_low") - F.col("x")) * beta), F.exp((F.col("x") - F.col("_high")) * beta)
    return rows.groupBy(*keys).agg((F.sum(down * F.col("x")) / F.sum(down)).alias("soft_min"), (F.sum(up * F.col("x")) / F.sum(up)).alias("soft_max"))


# ---- normality

# Quantiles of the standard normal distribution and of chi-squared with 3 degrees of freedom at 1 - p.
NORMAL_QUANTILES = {0.25: -0.6744897501960817, 0.5: 0.0, 0.75: 0.6744897501960817}
CHI2_3 = {0.25: 4.108344935623135, 0.5: 2.365973884375338, 0.75: 1.2125329030456696}


def quantile_loss(df: DataFrame, keys: list[str], value: str) -> DataFrame:
    """Sum over quantiles q of (mean - q - its normal quantile) squared, to which the smooth form reduces."""
    mean = F.avg("x")
    loss = reduce(lambda a, b: a + b, [(mean - q - z) * (mean - q - z) for q, z in NORMAL_QUANTILES.items()])
    return _values(df, keys, value).groupBy(*keys).agg(loss.alias("quantile_loss"))


def normality(df: DataFrame, keys: list[str], value: str) -> DataFrame:
    """Statistic and probability that a group is not normal: soft counts of z-scores between quartiles against expected ones."""
    rows = _with(_values(df, keys, value), keys, F.avg("x").alias("_mean"), F.stddev_samp("x").alias("_sd"), F.count("*").alias("_n"))
    z = F.try_divide(F.col("x") - F.col("_mean"), F.col("_sd"))
    below = [F.sum(sigmoid((q - z) * 100)).alias(f"b{i}") for i, q in enumerate(NORMAL_QUANTILES.values())]
    by = rows.groupBy(*keys).agg(*below, F.max("_n").cast("double").alias("n"))
    # the last quantile's own bin is left to the remainder
    bins = [F.col("b0"), F.col("b1") - F.col("b0"), F.col("b2") - F.col("b1"), F.col("n") - F.col("b2")]
    expected = F.col("n") / 4
    chi2 = reduce(lambda a, b: a + b, [(c - expected) * (c - expected) / (expected + 1e-7) for c in bins])
    return by.select(*keys, chi2.alias("chi2")).select(*keys, "chi2", chi2_rejection(F.col("chi2")).alias("not_normal"))


def chi2_rejection(chi2: Column) -> Column:
    """1 minus the p-values weighted by closeness of their critical values, plus a hundredth of what exceeds the greatest."""
    nearest = F.least(*[F.abs(chi2 - c) for c in CHI2_3.values()])
    weights = [F.exp(nearest - F.abs(chi2 - c)) for c in CHI2_3.values()]
    total = reduce(lambda a, b: a + b, weights)
    p = reduce(lambda a, b: a + b, [w * q for w, q in zip(weights, CHI2_3, strict=True)]) / total
    return 1 - p + F.greatest(F.lit(0.0), chi2 - max(CHI2_3.values())) / 100


def modes(df: DataFrame, keys: list[str], value: str, points: int = 1000, bandwidth: float | None = None) -> DataFrame:
    """Strict local maxima of a Gaussian kernel density on a grid of ``points`` from minimum to maximum; bandwidth by Scott's rule, or a factor of the sample deviation.

    Values are counted first, so equal ones cost once; the grid has a fixed size.
    """
    counts = _values(df, keys, value).groupBy(*keys, "x").agg(F.count("*").alias("n"))
    stats = _values(df, keys, value).groupBy(*keys).agg(F.min("x").alias("low"), F.max("x").alias("high"), F.stddev_samp("x").alias("sd"), F.count("*").cast("double").alias("total"))
    factor = F.pow(F.col("total"), F.lit(-0.2)) if bandwidth is None else F.lit(float(bandwidth))
    grid = stats.where("sd > 0").select(*keys, "total", (factor * F.col("sd")).alias("h"), F.explode(F.sequence(F.lit(0), F.lit(points - 1))).alias("i"), "low", "high").withColumn("at", F.col("low") + (F.col("high") - F.col("low")) * F.col("i") / (points - 1)).drop("low", "high")
    joined = counts.join(grid, keys) if keys else counts.crossJoin(F.broadcast(grid))
    z = (F.col("at") - F.col("x")) / F.col("h")
    dense = joined.groupBy(*keys, "i", "at").agg((F.sum(F.exp(-z * z / 2) * F.col("n")) / F.max(F.col("total") * F.col("h") * math.sqrt(2 * math.pi))).alias("density"))
    w = Window.partitionBy(*keys).orderBy("i")
    near = dense.withColumn("before", F.lag("density").over(w)).withColumn("after", F.lead("density").over(w))
    return near.where("density > before and density > after").select(*keys, F.col("at").alias("mode"), "density")


# ---- correlation


def row_correlations(left: DataFrame, right: DataFrame, key: str, vector: str, epsilon: float = 1e-8) -> DataFrame:
    """i, j, r: Pearson correlation of every row of one matrix with every row of another, within -1 and 1. Asked for all pairs of two matrices; rows are centred once, before the pairing."""

    def centred(df: DataFrame, name: str, at: str) -> DataFrame:
        v = F.col(vector).cast("array<double>")
        mean = F.aggregate(v, F.lit(0.0), lambda a, x: a + x) / F.size(v)
        moved = df.select(F.col(key).alias(name), v.alias("v"), mean.alias("m")).select(name, F.transform("v", lambda x: x - F.col("m") + epsilon).alias(at))
        return moved.withColumn(f"{at}_norm", F.sqrt(F.aggregate(at, F.lit(0.0), lambda a, x: a + x * x)))

    a, b = centred(left, "i", "a"), centred(right, "j", "b")
    dot = F.aggregate(F.zip_with("a", "b", lambda x, y: x * y), F.lit(0.0), lambda s, x: s + x)
    r = F.try_divide(dot, F.col("a_norm") * F.col("b_norm"))
    return a.join(b, how="cross").select("i", "j", F.when(r.isNotNull(), F.greatest(F.lit(-1.0), F.least(F.lit(1.0), r))).alias("r"))


def matrix_correlations(df: DataFrame, vector: str, length: int) -> DataFrame:
    """i, j, r: Pearson correlation of the rows of a matrix that is stored by columns, one array of ``length`` a table row. Every task sums products of its rows; length x length sums leave it. Arrays of other lengths or with nulls are left out."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        n, total, products = 0, np.zeros(length), np.zeros((length, length))
        for batch in batches:
            x = np.asarray(batch.column(0).flatten().to_numpy(zero_copy_only=False), float).reshape(-1, length)
            n, total, products = n + len(x), total + x.sum(0), products + x.T @ x
        i, j = np.indices(products.shape)
        columns = [i.ravel(), j.ravel(), products.ravel(), total[i.ravel()], total[j.ravel()], np.full(i.size, n)]
        yield pa.RecordBatch.from_arrays([pa.array(c, t) for c, t in zip(columns, (pa.int32(), pa.int32(), pa.float64(), pa.float64(), pa.float64(), pa.int64()), strict=True)], names=["i", "j", "xy", "x", "y", "n"])

    squares = df.select(F.col(vector).cast("array<double>").alias("v")).where((F.size("v") == length) & F.forall("v", lambda x: x.isNotNull()))
    sums = squares.mapInArrow(run, "i int, j int, xy double, x double, y double, n bigint").groupBy("i", "j").agg(*[F.sum(c).alias(c) for c in ("xy", "x", "y", "n")]).where("n > 0")
    cov = F.col("xy") - F.col("x") * F.col("y") / F.col("n")
    own = sums.where("i = j").select(F.col("i").alias("k"), F.sqrt(cov).alias("s"))
    both = sums.join(own.select(F.col("k").alias("i"), F.col("s").alias("si")), "i").join(own.select(F.col("k").alias("j"), F.col("s").alias("sj")), "j")
    return both.where("si > 0 and sj > 0").select("i", "j", F.greatest(F.lit(-1.0), F.least(F.lit(1.0), cov / (F.col("si") * F.col("sj")))).alias("r"))


def absolute_correlation(correlations: DataFrame, mark: float, beta: float = 100.0) -> DataFrame:
    """Of i, j, r: mean absolute correlation of different rows, and the soft share of all entries (the diagonal as 0) above a mark."""
    r = F.when(F.col("i") == F.col("j"), 0.0).otherwise(F.abs("r"))
    return correlations.agg(F.avg(F.when(F.col("i") < F.col("j"), r)).alias("mean_abs"), F.avg(sigmoid((r - mark) * beta)).alias("share_above"))
