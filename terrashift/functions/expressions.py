"""Scalar column expressions: codes, labels, byte codes, hashes, weights, bins, vectors."""

from __future__ import annotations

from itertools import chain

from pyspark.sql import Column
from pyspark.sql import functions as F

from terrashift import config as C


def in_codes(col: Column, codes) -> Column:
    return col.isin(*codes)


def transition_label(target: Column) -> Column:
    """0 stayed wetland, 1 became developed, 2 anything else, -1 no observation."""
    return (
        F.when(target == C.NODATA_CODE, -1)
        .when(in_codes(target, C.WETLAND_CODES), 0)
        .when(in_codes(target, C.DEVELOPED_CODES), 1)
        .otherwise(2)
        .cast("int")
    )


def code_name(col: Column, names: dict[int, str]) -> Column:
    return F.create_map(*[F.lit(v) for v in chain.from_iterable(names.items())])[col]


def encode_band(x: Column) -> Column:
    """Byte code of a value, halves away from zero; written with floor because round() works on decimals."""
    v = x * C.BAND_SCALE
    return (F.signum(v) * F.floor(F.abs(v) + 0.5) + C.BAND_OFFSET).cast("smallint")


def decode_band(v: Column) -> Column:
    """Float value of a byte; the nodata byte becomes null, also inside an otherwise covered pixel."""
    return F.when(v != C.BAND_NODATA, ((v - C.BAND_OFFSET) / C.BAND_SCALE).cast("float"))


def encode_bands(arr: Column) -> Column:
    return F.transform(arr, encode_band)


def decode_bands(arr: Column) -> Column:
    return F.transform(arr, decode_band)


def has_coverage(arr: Column) -> Column:
    return F.exists(arr, lambda v: v != C.BAND_NODATA)


def uniform(keys: list[Column], seed: int, method: str = "xxhash") -> Column:
    """Uniform number in [0, 1) that depends on the key only, never on row order or partitioning.

    ``xxhash`` is the fast JVM path (type-sensitive: cast integer keys to bigint); ``md5`` gives the same
    numbers in any SQL engine.
    """
    if method == "md5":
        text = F.concat_ws("|", *[k.cast("string") for k in keys], F.lit(str(seed)))
        head = F.conv(F.substring(F.md5(text), 1, 8), 16, 10).cast("bigint")
        return head / F.lit(4294967296.0)
    return F.pmod(F.xxhash64(*keys, F.lit(seed).cast("bigint")), F.lit(1 << 30)) / F.lit(float(1 << 30))


def unboost(score: Column, mult) -> Column:
    """Undo a positive up-weighting of ``mult``: p / (p + m (1 - p))."""
    mult = mult if isinstance(mult, Column) else F.lit(float(mult))
    return F.try_divide(score, score + mult * (F.lit(1.0) - score))


def natural_weight(weight: Column, label: Column, mult: Column) -> Column:
    return F.when(label == 1, weight / mult).otherwise(weight)


def inclusion_probability(label: Column, dist: Column, a: Column, tau: float, floor: float) -> Column:
    return F.when(label.isin(1, 2), F.lit(1.0)).otherwise(
        F.least(F.lit(1.0), F.lit(floor) + a * F.exp(-dist / F.lit(tau)))
    )


def confusion_tag(actual: Column, predicted: Column) -> Column:
    return (
        F.when((actual == 1) & (predicted == 1), "true_positive")
        .when((actual == 0) & (predicted == 1), "false_positive")
        .when((actual == 1) & (predicted == 0), "false_negative")
        .otherwise("true_negative")
    )


def digitize(v: Column, edges: Column, n: int) -> Column:
    """Number of edges not above ``v``; ``edges`` is an array of ``n`` increasing bounds."""
    out = F.lit(0)
    for i in range(n):
        out = out + (F.element_at(edges, i + 1) <= v).cast("int")
    return out


def log_bin(v: Column, width: float = C.LOG_BIN_WIDTH) -> Column:
    return F.floor(F.log10(v) / F.lit(width)).cast("bigint")


def log_bin_edges(idx: Column, width: float = C.LOG_BIN_WIDTH) -> tuple[Column, Column]:
    return (F.pow(F.lit(10.0), idx * F.lit(width)), F.pow(F.lit(10.0), (idx + 1) * F.lit(width)))


def equal_width_bin(v: Column, low: float, high: float, bins: int) -> Column:
    """1-based bin of [low, high]; the last bin is closed, values outside give null."""
    b = F.floor((v - F.lit(low)) / F.lit((high - low) / bins)).cast("int") + 1
    return F.when((v < low) | (v > high), F.lit(None).cast("int")).otherwise(F.least(b, F.lit(bins)))


def array_median(arr: Column) -> Column:
    n = F.size(arr)
    s = F.array_sort(arr)
    mid = F.floor(n / 2).cast("int")
    odd = F.element_at(s, mid + 1)
    even = (F.element_at(s, F.greatest(mid, F.lit(1))) + odd) / F.lit(2.0)
    return F.when(n % 2 == 1, odd).otherwise(even)


def array_minus(arr: Column, scalar: Column) -> Column:
    return F.transform(arr, lambda v: v - scalar)


def array_distance(a: Column, b: Column) -> Column:
    sq = F.zip_with(a, b, lambda p, q: (p - q) * (p - q))
    return F.sqrt(F.aggregate(sq, F.lit(0.0), lambda acc, v: acc + v))


def is_nondecreasing(arr: Column, tol: float = 1e-6) -> Column:
    steps = F.zip_with(F.slice(arr, 2, F.size(arr) - 1), F.slice(arr, 1, F.size(arr) - 1), lambda b, a: b - a)
    return F.forall(steps, lambda d: d >= -tol)


def weighted_logloss(logit: Column, label: Column) -> Column:
    """Log-loss from the logit without forming the probability, so large logits stay finite."""
    return F.greatest(logit, F.lit(0.0)) - logit * label + F.log1p(F.exp(-F.abs(logit)))


def ratio(a: Column, b: Column) -> Column:
    return F.try_divide(a.cast("double"), b.cast("double"))
