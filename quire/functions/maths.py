"""Element-wise functions on numeric columns. All are plain column expressions; null gives null, and so does a divisor of 0."""

from __future__ import annotations

from pyspark.sql import Column
from pyspark.sql import functions as F

Num = Column | str | float


def _c(x: Num) -> Column:
    return x if isinstance(x, Column) else F.col(x) if isinstance(x, str) else F.lit(float(x))


def sigmoid(x: Num) -> Column:
    """1 / (1 + e^-x), written so that no side overflows."""
    x = _c(x)
    e = F.exp(-F.abs(x))
    return F.when(x >= 0, 1 / (1 + e)).otherwise(e / (1 + e))


def relu(x: Num) -> Column:
    x = _c(x)
    return F.when(x > 0, x).otherwise(x * 0)


def _scaled(a: Num, b: Num, c: Num):
    a, b, c = _c(a), _c(b), _c(c)
    return (a, b, c), F.greatest(a, b, c)


def softmin_sum(a: Num, b: Num, c: Num, gamma: float) -> Column:
    """-g (M + ln sum e^((v-M)/g)), M the greatest."""
    vs, m = _scaled(a, b, c)
    return -gamma * (m + F.log(sum(F.exp((v - m) / gamma) for v in vs)))


def softmin_log(a: Num, b: Num, c: Num, gamma: float) -> Column:
    """-M + g ln sum e^(-(v-M)/g)."""
    vs, m = _scaled(a, b, c)
    return -m + gamma * F.log(sum(F.exp(-(v - m) / gamma) for v in vs))


def softmin_true(a: Num, b: Num, c: Num, gamma: float) -> Column:
    """M - g ln sum e^(-(v-M)/g): the smooth minimum."""
    vs, m = _scaled(a, b, c)
    return m - gamma * F.log(sum(F.exp(-(v - m) / gamma) for v in vs))


def softmin_relative(a: Num, b: Num, c: Num, gamma: float) -> Column:
    """M (-g ln sum e^(-(v/M)/g))."""
    vs, m = _scaled(a, b, c)
    return m * (-gamma * F.log(sum(F.exp(-F.try_divide(v, m) / gamma) for v in vs)))


def max_value_sigmoid(x: Num, limit: float, gain: float = 0.5) -> Column:
    """Odd, with limits +-limit."""
    return (sigmoid(_c(x) * (gain * 10 / (2 * limit))) - 0.5) * (2 * limit)


def min_value_asymptotic_penalty(x: Num, target: float, k: float = 3) -> Column:
    half = target / 2
    return 1 - sigmoid((_c(x) - half) * (k / half))


def zero_below_min(x: Num, least: float) -> Column:
    r = relu(_c(x) - (least - 1e-5))
    return r + least * r / (r + 1e-9)


def zero_below_abs_min(x: Num, least: float) -> Column:
    x = _c(x)
    return zero_below_min(F.abs(x), least) * x / (F.abs(x) + 1e-9)


def small_below_abs_min(x: Num, least: float, small: float) -> Column:
    x = _c(x)
    r = relu(F.abs(x) - (least - 1e-5))
    gate = r / (r + 1e-9)
    return (r + least * gate + small * (1 - gate)) * x / (F.abs(x) + 1e-9)


def max_value_relu(x: Num, limit: float) -> Column:
    return _c(x) - relu(_c(x) - limit)


def max_quadratic_penalty(x: Num, limit: float, target: float, at_target: float) -> Column:
    part = relu(_c(x) - limit) / (target - limit)
    return at_target * part * part


def min_quadratic_penalty(x: Num, limit: float, target: float, at_target: float) -> Column:
    part = relu(limit - _c(x)) / (target - limit)
    return at_target * part * part


def min_value_add(x: Num, limit: float, penalty: float) -> Column:
    gap = limit - _c(x)
    return _c(x) + penalty * relu(gap) / (gap + 1e-7)


def max_value_quadratic(x: Num, limit: float) -> Column:
    x = _c(x)
    return 2 * x - x * x / limit


def mask_small(x: Num, threshold: float, scale: float = 100.0) -> Column:
    return _c(x) * sigmoid((_c(x) - threshold) * scale)


def mask_very_small_as_large(x: Num, threshold: float = 0.001, high: float = 100.0, scale: float = 10.0) -> Column:
    gate = sigmoid((threshold - _c(x)) * (scale / threshold))
    return gate * high + (1 - gate) * _c(x)


def mask_below_abs(x: Num, threshold: float) -> Column:
    """As its formula stands, the weight is about 1 on either side of the threshold: nothing but values at it are masked."""
    d = _c(x) - threshold
    return _c(x) * (relu(d) / (d + 1e-7) + relu(-d) / (-d + 1e-7))


def limited_sigmoid(x: Num, scale: float, limit: float) -> Column:
    return 2 * limit * sigmoid(_c(x) * scale) - limit


def sigmoid_between(x: Num, low: float, high: float, scale: float = 10.0) -> Column:
    width = high - low
    return sigmoid((_c(x) - low - width / 2) * (scale / width)) * width + low


def max_entropy(categories: Num) -> Column:
    return F.log2(_c(categories))


# ---- capacity arithmetic


def optimal_batch_size(tokens: Num, size: Num, most: int = 200) -> Column:
    """A twentieth of the chunks, at least 1 and at most ``most``."""
    chunks = F.greatest(F.lit(1), F.floor(F.try_divide(_c(tokens), _c(size))).cast("bigint"))
    return F.least(F.greatest(F.lit(1), F.floor(chunks / 20).cast("bigint")), F.lit(most))


def worker_count(tokens_per_call: Num, tokens_per_minute: float, requests_per_minute: float, safety: float = 0.85, calls_per_minute: float = 6, fallback: int = 10) -> Column:
    t = _c(tokens_per_call)
    by_tokens = F.when(t > 0, tokens_per_minute / t)
    n = F.greatest(F.lit(1), F.floor(F.least(by_tokens, F.lit(requests_per_minute / calls_per_minute)) * safety).cast("bigint"))
    return F.when(by_tokens.isNull(), F.lit(fallback)).otherwise(n).cast("bigint")


def embed_batch_size(chunk_tokens: Num, payload: int = 4_500_000, vector_bytes: int = 1536 * 8, token_limit: int = 1_000_000) -> Column:
    return F.least(F.lit(payload // vector_bytes), F.floor(F.try_divide(F.lit(token_limit), _c(chunk_tokens))).cast("bigint"))


def query_batch_size(payload: Num, overhead: int = 40, chunk: int = 400) -> Column:
    return F.floor(_c(payload) / (overhead + chunk)).cast("bigint")
