"""Vector functions over array columns: sequential double folds that any SQL engine repeats bit by bit, no UDF."""

from __future__ import annotations

from pyspark.sql import Column
from pyspark.sql import functions as F


def let(value: Column, f) -> Column:
    """f(value) with value computed once: an expression that a lambda refers to would be computed again for every element."""
    return F.element_at(F.transform(F.array(value), f), 1)


def doubles(v: Column) -> Column:
    return F.transform(v, lambda x: x.cast("double"))


def total(v: Column) -> Column:
    return F.aggregate(v, F.lit(0.0), lambda a, x: a + x)


def dot(a: Column, b: Column) -> Column:
    return total(F.zip_with(a, b, lambda x, y: x.cast("double") * y.cast("double")))


def norm(v: Column) -> Column:
    return F.sqrt(dot(v, v))


def cosine(a: Column, b: Column, epsilon: float | None = None) -> Column:
    """0 where a norm is 0; with epsilon, the denominator is enlarged by it instead."""
    scale = norm(a) * norm(b)
    if epsilon is not None:
        return dot(a, b) / (scale + F.lit(epsilon))
    return F.when(scale > 0, dot(a, b) / F.nullif(scale, F.lit(0.0))).otherwise(0.0)


def scale_by(v: Column, k: Column) -> Column:
    return F.transform(v, lambda x: x.cast("double") * k)


def l2_normalise(v: Column, floor: float = 1e-12) -> Column:
    return let(v, lambda u: let(F.greatest(norm(u), F.lit(floor)), lambda n: F.transform(u, lambda x: x.cast("double") / n)))


def is_unit(v: Column, tolerance: float = 0.01) -> Column:
    return F.abs(norm(v) - 1) <= tolerance


def prefix(v: Column, dims: int) -> Column:
    """Matryoshka: the leading dims, normalised again."""
    return l2_normalise(F.slice(v, 1, dims))


def prefix_dims(dims: Column, full: int) -> Column:
    """Those of dims in (0, full], with full, distinct and sorted."""
    return F.array_sort(F.array_distinct(F.array_append(F.filter(dims, lambda d: (d > 0) & (d <= full)), F.lit(full))))


def add(a: Column, b: Column) -> Column:
    return F.zip_with(a, b, lambda x, y: x.cast("double") + y.cast("double"))


def mean_pool(rows: Column, mask: Column, dim: int) -> Column:
    """Masked mean over an array of vectors."""
    m = F.transform(mask, lambda x: x.cast("double"))
    size = F.greatest(total(m), F.lit(1e-9))
    zero = F.array_repeat(F.lit(0.0), dim)
    sums = F.aggregate(F.zip_with(rows, m, lambda r, w: F.transform(r, lambda x: x.cast("double") * w)), zero, lambda a, r: F.zip_with(a, r, lambda x, y: x + y))
    return let(F.struct(sums.alias("sums"), size.alias("size")), lambda s: F.transform(s["sums"], lambda x: x / s["size"]))


def first_pool(rows: Column) -> Column:
    return l2_normalise(F.element_at(rows, 1))


def last_pool(rows: Column) -> Column:
    return F.element_at(rows, -1)


def max_abs(v: Column) -> Column:
    return F.array_max(F.transform(v, lambda x: F.abs(x.cast("double"))))


def _scale(v: Column, top: float) -> Column:
    m = max_abs(v)
    return F.when(m > 0, m / F.lit(top)).otherwise(1.0)


def _rounded(v: Column, scale: Column, top: int) -> Column:
    return F.transform(v, lambda x: F.greatest(F.lit(-top), F.least(F.lit(top), F.rint(x.cast("double") / scale).cast("int"))))


def quantise_int8(v: Column) -> Column:
    """struct(scale, q): symmetric per row, half to even."""
    return let(_scale(v, 127.0), lambda s: F.struct(s.alias("scale"), _rounded(v, s, 127).alias("q")))


def quantise_int4(v: Column, dim: int, group: int = 32) -> Column:
    """array of struct(scale, q) per group of 32."""
    groups = F.transform(F.sequence(F.lit(0), F.lit(dim // group - 1)), lambda g: F.slice(v, g * group + 1, F.lit(group)))
    return F.transform(groups, lambda x: let(_scale(x, 7.0), lambda s: F.struct(s.alias("scale"), _rounded(x, s, 7).alias("q"))))


def pack_nibbles(q: Column, size: int) -> Column:
    """Two values of -7..7, stored as q + 8, in one byte number, the first in the low half."""
    return F.transform(F.sequence(F.lit(0), F.lit(size // 2 - 1)), lambda i: (F.get(q, i * 2) + 8).bitwiseOR(F.shiftleft(F.get(q, i * 2 + 1) + 8, 4)))


def dequantise_u8(q: Column, scale: float, zero: int) -> Column:
    return F.transform(q, lambda x: (x.cast("int").bitwiseAND(255) - zero).cast("double") * F.lit(scale))


def softmax(v: Column) -> Column:
    e = let(F.array_max(doubles(v)), lambda top: F.transform(v, lambda x: F.exp(x.cast("double") - top)))
    return let(e, lambda e: let(total(e), lambda s: F.transform(e, lambda x: x / s)))


def layer_norm(v: Column, epsilon: float = 1e-12) -> Column:
    def scaled(c: Column) -> Column:
        return let(F.sqrt(dot(c, c) / F.size(c).cast("double") + F.lit(epsilon)), lambda s: F.transform(c, lambda x: x / s))

    centred = let(doubles(v), lambda u: let(total(u) / F.size(u).cast("double"), lambda m: F.transform(u, lambda x: x - m)))
    return let(centred, scaled)


def rms_norm(v: Column, epsilon: float = 1e-6) -> Column:
    return let(F.sqrt(dot(v, v) / F.size(v).cast("double") + F.lit(epsilon)), lambda s: F.transform(v, lambda x: x.cast("double") / s))


def gelu_tanh(x: Column) -> Column:
    x = x.cast("double")
    return F.lit(0.5) * x * (F.lit(1.0) + F.tanh(F.lit(0.7978845608028654) * (x + F.lit(0.044715) * x * x * x)))


def geglu(gate: Column, up: Column) -> Column:
    return F.zip_with(gate, up, lambda g, u: gelu_tanh(g) * u.cast("double"))


def whiten(v: Column, mean: Column, matrix: Column) -> Column:
    """normalise(W (v - mean)) with W an array of rows; for small dimensions, larger ones go through operators.whiten.apply."""
    centred = F.zip_with(v, mean, lambda x, m: x.cast("double") - m)
    return l2_normalise(let(centred, lambda z: F.transform(matrix, lambda row: dot(row, z))))


def max_abs_difference(a: Column, b: Column) -> Column:
    return F.array_max(F.zip_with(a, b, lambda x, y: F.abs(x.cast("double") - y.cast("double"))))
