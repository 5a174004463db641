"""Queries of statistics.py and maths.py, with SQL that writes the formulas out."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from quire.functions import maths as m
from quire.operators import statistics as st
from quire.plans.session import table

QUERIES: dict = {}
SQL: dict[str, str] = {}


def _rounded(df: DataFrame, digits: int, *columns: str) -> DataFrame:
    for c in columns:
        df = df.withColumn(c, F.round(c, digits))
    return df


def _query(name: str, sql: str | None = None):
    def add(f):
        QUERIES[name] = f
        if sql:
            SQL[name] = sql
        return f

    return add


def _lines(spark: SparkSession, d: str) -> DataFrame:
    return table(spark, d, "lineitem")


FLAG = ["l_returnflag"]


@_query("stat_moments", """
    WITH s AS (SELECT l_returnflag, avg(l_extendedprice) AS mu, stddev_samp(l_extendedprice) AS sd FROM lineitem GROUP BY 1)
    SELECT l_returnflag, round(avg(pow((l_extendedprice - mu) / sd, 3)), 6) AS skewness,
           round(avg(pow((l_extendedprice - mu) / sd, 4)) - 3, 6) AS kurtosis,
           round(abs(avg(pow((l_extendedprice - mu) / sd, 4)) - 3), 6) AS normality
    FROM lineitem JOIN s USING (l_returnflag) GROUP BY 1
""")
def moments(spark, d):
    return _rounded(st.moments(_lines(spark, d), FLAG, "l_extendedprice"), 6, "skewness", "kurtosis", "normality")


@_query("stat_kurtosis_unbiased", """
    WITH s AS (SELECT l_returnflag, avg(l_quantity) AS mu, stddev_samp(l_quantity) AS sd, count(*)::DOUBLE AS n FROM lineitem GROUP BY 1)
    SELECT l_returnflag, round(any_value(n * (n + 1) / ((n - 1) * (n - 2) * (n - 3))) * sum(pow((l_quantity - mu) / sd, 4))
           - any_value(3 * (n - 1) * (n - 1) / ((n - 2) * (n - 3))), 6) AS kurtosis
    FROM lineitem JOIN s USING (l_returnflag) GROUP BY 1
""")
def kurtosis_unbiased(spark, d):
    return _rounded(st.kurtosis_unbiased(_lines(spark, d), FLAG, "l_quantity"), 6, "kurtosis")


@_query("stat_scaled_variance", "SELECT l_returnflag, round(var_pop(l_extendedprice) / pow(avg(l_extendedprice), 2), 8) AS scaled_variance FROM lineitem GROUP BY 1")
def scaled_variance(spark, d):
    return _rounded(st.scaled_variance(_lines(spark, d), FLAG, "l_extendedprice"), 8, "scaled_variance")


@_query("stat_sd_over_mean_abs", """
    WITH c AS (SELECT l_returnflag, l_linestatus, stddev_samp(l_discount) / avg(abs(l_discount)) AS r FROM lineitem GROUP BY 1, 2)
    SELECT l_returnflag, round(avg(r), 8) AS sd_over_mean_abs FROM c GROUP BY 1
""")
def sd_over_mean_abs(spark, d):
    return _rounded(st.deviation_over_mean_abs(_lines(spark, d), FLAG, "l_linestatus", "l_discount"), 8, "sd_over_mean_abs")


@_query("stat_scaled_to_range", """
    SELECT o_orderkey, o_orderstatus, round((o_totalprice - min(o_totalprice) OVER w) / (max(o_totalprice) OVER w - min(o_totalprice) OVER w + 1e-8), 8) AS scaled
    FROM orders WINDOW w AS (PARTITION BY o_orderstatus)
""")
def scaled_to_range(spark, d):
    return _rounded(st.scaled_to_range(table(spark, d, "orders"), ["o_orderstatus"], "o_totalprice", "o_orderkey"), 8, "scaled")


@_query("stat_entropies", """
    WITH s AS (SELECT l_returnflag, sum(l_quantity) AS total, sum(l_quantity * l_quantity) AS squares, count(*)::DOUBLE AS n FROM lineitem GROUP BY 1),
    h AS (SELECT l_returnflag, -sum(l_quantity / (total + 1e-5) * ln(l_quantity / (total + 1e-5))) AS h,
                 -sum(l_quantity * l_quantity / squares * ln(l_quantity * l_quantity / squares)) AS hp, ln(max(n)) AS most
          FROM lineitem JOIN s USING (l_returnflag) WHERE l_quantity > 0 GROUP BY 1)
    SELECT l_returnflag, round(h, 6) AS entropy, round(h / most, 8) AS share_of_max, round(most / h - 1, 8) AS penalty, round(most / hp - 1, 8) AS powered_penalty FROM h
""")
def entropies(spark, d):
    return _rounded(_rounded(st.entropies(_lines(spark, d), FLAG, "l_quantity"), 6, "entropy"), 8, "share_of_max", "penalty", "powered_penalty")


@_query("stat_gini", """
    WITH r AS (SELECT l_returnflag, l_extendedprice AS x, row_number() OVER (PARTITION BY l_returnflag ORDER BY l_extendedprice) AS i, count(*) OVER (PARTITION BY l_returnflag) AS n FROM lineitem)
    SELECT l_returnflag, round(sum((2 * i - n - 1) * x) / (max(n) * sum(x)), 8) AS gini FROM r GROUP BY 1
""")
def gini(spark, d):
    return _rounded(st.gini(_lines(spark, d), FLAG, "l_extendedprice"), 8, "gini")


@_query("stat_gini_pairs", """
    SELECT a.c_mktsegment, round(sum(abs(a.v - b.v)) / (max(a.n) * (max(a.n) - 1) * max(a.mu)) / 2, 8) AS gini
    FROM (SELECT c_mktsegment, c_acctbal + 1000 AS v, count(*) OVER (PARTITION BY c_mktsegment) AS n, avg(c_acctbal + 1000) OVER (PARTITION BY c_mktsegment) AS mu FROM customer) a
    JOIN (SELECT c_mktsegment, c_acctbal + 1000 AS v FROM customer) b USING (c_mktsegment) GROUP BY 1
""")
def gini_pairs(spark, d):
    rows = table(spark, d, "customer").select("c_mktsegment", (F.col("c_acctbal") + 1000).alias("v"))
    return _rounded(st.gini(rows, ["c_mktsegment"], "v", pairs=True), 8, "gini")


@_query("stat_median", "SELECT l_returnflag, median(l_extendedprice) AS median FROM lineitem GROUP BY 1")
def median(spark, d):
    return st.median(_lines(spark, d), FLAG, "l_extendedprice")


@_query("stat_quantile_linear", "SELECT l_returnflag, round(quantile_cont(l_extendedprice, 0.9), 6) AS quantile FROM lineitem GROUP BY 1")
def quantile_linear(spark, d):
    return _rounded(st.quantile_linear(_lines(spark, d), FLAG, "l_extendedprice", 0.9), 6, "quantile")


@_query("stat_soft_percentile", """
    WITH r AS (SELECT l_returnflag, l_extendedprice AS x, row_number() OVER (PARTITION BY l_returnflag ORDER BY l_extendedprice DESC) AS i,
                      count(*) OVER (PARTITION BY l_returnflag) AS n FROM lineitem),
    p AS (SELECT *, floor((1 - 0.75::DOUBLE) * n) AS k FROM r)
    SELECT l_returnflag, CASE WHEN max(0.75::DOUBLE * n) = max(k) THEN (max(x) FILTER (i = k + 1) + max(x) FILTER (i = k)) / 2 ELSE max(x) FILTER (i = k + 1) END AS percentile
    FROM p GROUP BY 1
""")
def soft_percentile(spark, d):
    return st.soft_percentile(_lines(spark, d), FLAG, "l_extendedprice", 0.75)


@_query("stat_bottom_average", """
    WITH r AS (SELECT l_returnflag, l_extendedprice AS x, row_number() OVER (PARTITION BY l_returnflag ORDER BY l_extendedprice) AS i FROM lineitem)
    SELECT l_returnflag, round(avg(x), 6) AS bottom_average FROM r WHERE i <= 25 GROUP BY 1
""")
def bottom_average(spark, d):
    return _rounded(st.bottom_average(_lines(spark, d), FLAG, "l_extendedprice", 25), 6, "bottom_average")


@_query("stat_middle", """
    WITH r AS (SELECT o_orderstatus, o_orderkey, row_number() OVER (PARTITION BY o_orderstatus ORDER BY o_orderkey) - 1 AS i, count(*) OVER (PARTITION BY o_orderstatus) AS n FROM orders)
    SELECT o_orderstatus, o_orderkey FROM r WHERE i >= floor((n - floor(n * 0.25::DOUBLE)) / 2) AND i < floor((n - floor(n * 0.25::DOUBLE)) / 2) + floor(n * 0.25::DOUBLE)
""")
def middle(spark, d):
    return st.middle(table(spark, d, "orders"), ["o_orderstatus"], "o_orderkey", 0.25).select("o_orderstatus", F.col("o_orderkey").cast("bigint").alias("o_orderkey"))


@_query("stat_differentiable_quantile", """
    WITH r AS (SELECT l_returnflag, l_discount AS x, row_number() OVER (PARTITION BY l_returnflag ORDER BY l_discount) - 1 AS i, count(*) OVER (PARTITION BY l_returnflag) AS n FROM lineitem),
    t AS (SELECT l_returnflag, max(x) AS t FROM r WHERE i = floor(0.5::DOUBLE * (n - 1)) GROUP BY 1)
    SELECT l_returnflag, round(sum(x / (1 + exp(-100 * (x - t)))) / sum(1 / (1 + exp(-100 * (x - t)))), 8) AS quantile FROM r JOIN t USING (l_returnflag) GROUP BY 1
""")
def differentiable_quantile(spark, d):
    return _rounded(st.differentiable_quantile(_lines(spark, d), FLAG, "l_discount", 0.5), 8, "quantile")


@_query("stat_soft_percentile_count", """
    WITH RECURSIVE v AS (SELECT l_returnflag, l_quantity AS x, count(*) AS n FROM lineitem GROUP BY 1, 2),
    b AS (
        SELECT l_returnflag, 0 AS i, min(x) AS low, max(x) AS high, sum(n) AS total FROM v GROUP BY 1
        UNION ALL
        SELECT l_returnflag, i + 1, CASE WHEN above THEN (low + high) / 2 ELSE low END, CASE WHEN above THEN high ELSE (low + high) / 2 END, total
        FROM (SELECT *, (SELECT sum(v.n / (1 + exp(-10 * (v.x - (b.low + b.high) / 2)))) FROM v WHERE v.l_returnflag = b.l_returnflag) / total > 0.3 AS above FROM b WHERE i < 20))
    SELECT l_returnflag, round((low + high) / 2, 4) AS threshold FROM b WHERE i = 20
""")
def soft_percentile_count(spark, d):
    return _rounded(st.soft_percentile_count(_lines(spark, d), FLAG, "l_quantity", 0.3), 4, "threshold")


@_query("stat_count_above", "SELECT l_returnflag, round(sum(1 / (1 + exp(-100 * (l_discount - 0.05)))), 4) AS count_above FROM lineitem GROUP BY 1")
def count_above(spark, d):
    return _rounded(st.count_above(_lines(spark, d), FLAG, "l_discount", 0.05), 4, "count_above")


@_query("stat_count_below", """
    WITH s AS (SELECT l_returnflag, stddev_samp(l_tax) AS sd FROM lineitem GROUP BY 1)
    SELECT l_returnflag, round(sum(1 - 1 / (1 + exp(-(l_tax - 0.031) * 200 / sd))), 4) AS count_below FROM lineitem JOIN s USING (l_returnflag) GROUP BY 1
""")
def count_below(spark, d):
    return _rounded(st.count_below(_lines(spark, d), FLAG, "l_tax", 0.031), 4, "count_below")


_COLUMNS_BELOW = """
    WITH s AS (SELECT stddev_samp(p_retailprice) AS sd FROM part),
    f AS (SELECT p_size, sum(1 - 1 / (1 + exp(-(1000.003 - p_retailprice) * 200 / sd))) AS filled FROM part, s GROUP BY 1),
    g AS (SELECT stddev_samp(filled) AS sd FROM f),
    c AS (SELECT sum(1 - 1 / (1 + exp(-least(700, greatest(-700, (filled - 32.4) * 200 / g.sd))))) AS columns_below FROM f, g)
"""


@_query("stat_columns_below", _COLUMNS_BELOW + "SELECT round(columns_below, 4) AS columns_below FROM c")
def columns_below(spark, d):
    return _rounded(st.columns_below(table(spark, d, "part"), "p_size", "p_retailprice", 1000.003, 36), 4, "columns_below")


@_query("stat_columns_below_answer", _COLUMNS_BELOW + "SELECT round(1 / (1 + exp(-(columns_below - 10 - 0.2) * 100)), 6) AS too_many FROM c")
def columns_below_answer(spark, d):
    return _rounded(st.columns_below(table(spark, d, "part"), "p_size", "p_retailprice", 1000.003, 36, most_columns=10), 6, "too_many")


@_query("stat_soft_extremes", """
    WITH s AS (SELECT l_returnflag, min(l_discount) AS lo, max(l_discount) AS hi FROM lineitem GROUP BY 1)
    SELECT l_returnflag, round(sum(l_discount * exp(100 * (lo - l_discount))) / sum(exp(100 * (lo - l_discount))), 8) AS soft_min,
           round(sum(l_discount * exp(100 * (l_discount - hi))) / sum(exp(100 * (l_discount - hi))), 8) AS soft_max
    FROM lineitem JOIN s USING (l_returnflag) GROUP BY 1
""")
def soft_extremes(spark, d):
    return _rounded(st.soft_extremes(_lines(spark, d), FLAG, "l_discount"), 8, "soft_min", "soft_max")


@_query("stat_quantile_loss", """
    SELECT l_returnflag, round(pow(avg(l_discount) - 0.25 + 0.6744897501960817, 2) + pow(avg(l_discount) - 0.5, 2) + pow(avg(l_discount) - 0.75 - 0.6744897501960817, 2), 8) AS quantile_loss
    FROM lineitem GROUP BY 1
""")
def quantile_loss(spark, d):
    return _rounded(st.quantile_loss(_lines(spark, d), FLAG, "l_discount"), 8, "quantile_loss")


@_query("stat_normality", """
    WITH s AS (SELECT l_returnflag, avg(l_extendedprice) AS mu, stddev_samp(l_extendedprice) AS sd, count(*)::DOUBLE AS n FROM lineitem GROUP BY 1),
    b AS (SELECT l_returnflag, max(n) AS n,
                 sum(1 / (1 + exp(-100 * (-0.6744897501960817 - (l_extendedprice - mu) / sd)))) AS b0,
                 sum(1 / (1 + exp(-100 * (0 - (l_extendedprice - mu) / sd)))) AS b1,
                 sum(1 / (1 + exp(-100 * (0.6744897501960817 - (l_extendedprice - mu) / sd)))) AS b2 FROM lineitem JOIN s USING (l_returnflag) GROUP BY 1),
    c AS (SELECT l_returnflag, (pow(b0 - n / 4, 2) + pow(b1 - b0 - n / 4, 2) + pow(b2 - b1 - n / 4, 2) + pow(n - b2 - n / 4, 2)) / (n / 4 + 1e-7) AS x FROM b),
    e AS (SELECT *, least(abs(x - 4.108344935623135), abs(x - 2.365973884375338), abs(x - 1.2125329030456696)) AS o FROM c),
    w AS (SELECT *, exp(o - abs(x - 4.108344935623135)) AS w1, exp(o - abs(x - 2.365973884375338)) AS w2, exp(o - abs(x - 1.2125329030456696)) AS w3 FROM e)
    SELECT l_returnflag, round(x, 4) AS chi2, round(1 - (w1 * 0.25 + w2 * 0.5 + w3 * 0.75) / (w1 + w2 + w3) + greatest(0, x - 4.108344935623135) / 100, 6) AS not_normal FROM w
""")
def normality(spark, d):
    return _rounded(_rounded(st.normality(_lines(spark, d), FLAG, "l_extendedprice"), 4, "chi2"), 6, "not_normal")


@_query("stat_modes", """
    WITH v AS (SELECT p_size::DOUBLE AS x FROM part),
    s AS (SELECT min(x) AS lo, max(x) AS hi, stddev_samp(x) * pow(count(*), -0.2) AS h, count(*) AS n FROM v),
    g AS (SELECT i, lo + (hi - lo) * i / 999 AS pos, h, n FROM s, range(0, 1000) t(i)),
    k AS (SELECT i, pos, sum(c * exp(-pow((pos - x) / h, 2) / 2)) / (max(n) * max(h) * sqrt(2 * pi())) AS density FROM g, (SELECT x, count(*) AS c FROM v GROUP BY 1) GROUP BY 1, 2),
    w AS (SELECT *, lag(density) OVER (ORDER BY i) AS a, lead(density) OVER (ORDER BY i) AS b FROM k)
    SELECT round(pos, 6) AS mode, round(density, 8) AS density FROM w WHERE density > a AND density > b
""")
def modes(spark, d):
    return _rounded(_rounded(st.modes(table(spark, d, "part"), [], "p_size"), 6, "mode"), 8, "density")


_CORR = """
    WITH v AS (SELECT vec_id, unnest(embedding)::DOUBLE AS x, unnest(range(0, 64)) AS i FROM embeddings),
    r AS (SELECT a.i, b.i AS j, corr(a.x, b.x) AS r FROM v a JOIN v b USING (vec_id) GROUP BY 1, 2)
"""


def _correlations(spark, d):
    return st.matrix_correlations(table(spark, d, "embeddings"), "embedding", 64)


@_query("stat_corr_matrix", _CORR + "SELECT i::INT AS i, j::INT AS j, round(r, 6) AS r FROM r")
def corr_matrix(spark, d):
    return _rounded(_correlations(spark, d), 6, "r")


@_query("stat_absolute_correlation", _CORR + "SELECT round(avg(abs(r)) FILTER (i < j), 8) AS mean_abs, round(avg(1 / (1 + exp(-100 * (CASE WHEN i = j THEN 0 ELSE abs(r) END - 0.2)))), 8) AS share_above FROM r")
def absolute_correlation(spark, d):
    return _rounded(st.absolute_correlation(_correlations(spark, d), 0.2), 8, "mean_abs", "share_above")


@_query("stat_soft_percentile_upper", _CORR + ", o AS (SELECT r, row_number() OVER (ORDER BY r DESC) AS k, count(*) OVER () AS n FROM r WHERE i < j) SELECT round(max(r) FILTER (k = floor((1 - 0.9::DOUBLE) * n) + 1), 6) AS percentile FROM o")
def soft_percentile_upper(spark, d):
    """Over the strict upper triangle of a square matrix."""
    return _rounded(st.soft_percentile(_correlations(spark, d).where("i < j"), [], "r", 0.9), 6, "percentile")


@_query("stat_top_elements", """
    SELECT o_orderstatus, o_orderkey, o_totalprice AS x, row_number() OVER (PARTITION BY o_orderstatus ORDER BY o_totalprice DESC, o_orderkey)::INT AS rank
    FROM orders QUALIFY rank <= 10
""")
def top_elements(spark, d):
    return st.top_elements(table(spark, d, "orders"), ["o_orderstatus"], "o_orderkey", "o_totalprice", 10)




@_query("math_softmins", """
    WITH v AS (SELECT l_orderkey, l_linenumber, l_quantity / 10 AS a, l_discount * 20 AS b, l_tax * 30 + 0.1 AS c, greatest(l_quantity / 10, l_discount * 20, l_tax * 30 + 0.1) AS m FROM lineitem)
    SELECT l_orderkey, l_linenumber,
           round(-0.5 * (m + ln(exp((a - m) / 0.5) + exp((b - m) / 0.5) + exp((c - m) / 0.5))), 6) AS by_sum,
           round(-m + 0.5 * ln(exp(-(a - m) / 0.5) + exp(-(b - m) / 0.5) + exp(-(c - m) / 0.5)), 6) AS by_log,
           round(m - 0.5 * ln(exp(-(a - m) / 0.5) + exp(-(b - m) / 0.5) + exp(-(c - m) / 0.5)), 6) AS smooth,
           round(m * (-0.5 * ln(exp(-(a / m) / 0.5) + exp(-(b / m) / 0.5) + exp(-(c / m) / 0.5))), 6) AS relative
    FROM v
""")
def softmins(spark, d):
    v = _lines(spark, d).select("l_orderkey", "l_linenumber", (F.col("l_quantity") / 10).alias("a"), (F.col("l_discount") * 20).alias("b"), (F.col("l_tax") * 30 + 0.1).alias("c"))
    out = v.select("l_orderkey", "l_linenumber", m.softmin_sum("a", "b", "c", 0.5).alias("by_sum"), m.softmin_log("a", "b", "c", 0.5).alias("by_log"), m.softmin_true("a", "b", "c", 0.5).alias("smooth"), m.softmin_relative("a", "b", "c", 0.5).alias("relative"))
    return _rounded(out, 6, "by_sum", "by_log", "smooth", "relative")


@_query("math_bounds", """
    WITH v AS (SELECT l_orderkey, l_linenumber, l_quantity - 25 AS x, greatest(0, l_quantity - 25 - (5 - 1e-5)) AS r, greatest(0, abs(l_quantity - 25) - (5 - 1e-5)) AS ra, l_tax * 10 AS t FROM lineitem)
    SELECT l_orderkey, l_linenumber,
           round((1 / (1 + exp(-x * 0.25)) - 0.5) * 20, 6) + 0.0 AS limited,
           round(1 - 1 / (1 + exp(-(x - 5) * 0.6)), 6) + 0.0 AS asymptotic,
           round(r + 5 * r / (r + 1e-9), 6) + 0.0 AS zero_below,
           round((ra + 5 * ra / (ra + 1e-9)) * x / (abs(x) + 1e-9), 6) + 0.0 AS zero_below_abs,
           round((ra + 5 * ra / (ra + 1e-9) + 0.5 * (1 - ra / (ra + 1e-9))) * x / (abs(x) + 1e-9), 6) + 0.0 AS small_below_abs,
           round(least(x, 12), 6) + 0.0 AS at_most,
           round(3 * pow(greatest(0, x - 5) / 5, 2), 6) + 0.0 AS above_penalty,
           round(3 * pow(greatest(0, -5 - x) / -5, 2), 6) + 0.0 AS below_penalty,
           round(x + 7 * greatest(0, -5 - x) / (-5 - x + 1e-7), 6) + 0.0 AS added,
           round(2 * x - x * x / 30, 6) + 0.0 AS quadratic,
           round(t / (1 + exp(-(t - 0.35) * 100)), 6) + 0.0 AS masked,
           round(100 / (1 + exp(-(0.05 - t) * 200)) + (1 - 1 / (1 + exp(-(0.05 - t) * 200))) * t, 6) + 0.0 AS masked_large,
           round(t * (greatest(0, t - 0.123) / (t - 0.123 + 1e-7) + greatest(0, 0.123 - t) / (0.123 - t + 1e-7)), 6) + 0.0 AS masked_abs,
           round(8 / (1 + exp(-x * 0.2)) - 4, 6) + 0.0 AS sigmoid_limited,
           round(20 / (1 + exp(-(x + 10 - 10) * 0.5)) - 10, 6) + 0.0 AS sigmoid_between
    FROM v
""")
def bounds(spark, d):
    v = _lines(spark, d).select("l_orderkey", "l_linenumber", (F.col("l_quantity") - 25).alias("x"), (F.col("l_tax") * 10).alias("t"))
    out = {
        "limited": m.max_value_sigmoid("x", 10), "asymptotic": m.min_value_asymptotic_penalty("x", 10), "zero_below": m.zero_below_min("x", 5), "zero_below_abs": m.zero_below_abs_min("x", 5),
        "small_below_abs": m.small_below_abs_min("x", 5, 0.5), "at_most": m.max_value_relu("x", 12), "above_penalty": m.max_quadratic_penalty("x", 5, 10, 3), "below_penalty": m.min_quadratic_penalty("x", -5, -10, 3),
        "added": m.min_value_add("x", -5, 7), "quadratic": m.max_value_quadratic("x", 30), "masked": m.mask_small("t", 0.35), "masked_large": m.mask_very_small_as_large("t", 0.05), "masked_abs": m.mask_below_abs("t", 0.123),
        "sigmoid_limited": m.limited_sigmoid("x", 0.2, 4), "sigmoid_between": m.sigmoid_between("x", -10, 10),
    }
    return v.select("l_orderkey", "l_linenumber", *[(F.round(c, 6) + 0.0).alias(k) for k, c in out.items()])


@_query("math_capacity", """
    SELECT p_partkey, round(log2(p_size), 8) AS max_entropy,
           least(greatest(1, greatest(1, (p_partkey * 37) // 400) // 20), 200)::BIGINT AS batch,
           greatest(1, floor(least(4000000.0 / (p_size * 1000), 2000.0 / 6) * 0.85))::BIGINT AS workers,
           least(4500000 // 12288, 1000000 // (p_size * 10))::BIGINT AS embed_batch, ((p_partkey * 100) // 440)::BIGINT AS query_batch
    FROM part
""")
def capacity(spark, d):
    p = table(spark, d, "part")
    return p.select("p_partkey", F.round(m.max_entropy("p_size"), 8).alias("max_entropy"), m.optimal_batch_size(F.col("p_partkey") * 37, F.lit(400)).cast("bigint").alias("batch"), m.worker_count(F.col("p_size") * 1000, 4_000_000, 2000).alias("workers"), m.embed_batch_size(F.col("p_size") * 10).cast("bigint").alias("embed_batch"), m.query_batch_size(F.col("p_partkey") * 100).alias("query_batch"))
