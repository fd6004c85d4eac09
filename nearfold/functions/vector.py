"""Vector expressions over array columns, as Columns. All stay in the JVM; arithmetic is in doubles unless stated."""

from __future__ import annotations

from pyspark.sql import Column
from pyspark.sql import functions as F

DOUBLES = "array<double>"


def doubles(v) -> Column:
    """Widens an array of any number type."""
    return (F.col(v) if isinstance(v, str) else v).cast(DOUBLES)


def _sum(v: Column) -> Column:
    return F.aggregate(v, F.lit(0.0), lambda a, x: a + x)


def dot(a: Column, b: Column) -> Column:
    return _sum(F.zip_with(a, b, lambda x, y: x * y))


def sqnorm(a: Column) -> Column:
    return _sum(F.transform(a, lambda x: x * x))


def l2sq(a: Column, b: Column) -> Column:
    return _sum(F.zip_with(a, b, lambda x, y: (x - y) * (x - y)))


def l2sq_int(a: Column, b: Column) -> Column:
    """Of integer arrays, with a 32-bit accumulator."""
    return F.aggregate(F.zip_with(a, b, lambda x, y: (x.cast("int") - y.cast("int")) * (x.cast("int") - y.cast("int"))), F.lit(0), lambda s, x: s + x)


def l2_expanded(q: Column, c: Column, c_norm: Column) -> Column:
    """|c|^2 - 2 q.c: l2sq without the constant |q|^2."""
    return c_norm - 2 * dot(q, c)


def l2_normalize(a: Column) -> Column:
    """Null elements where the norm is 0."""
    norm = F.sqrt(sqnorm(a))
    return F.transform(a, lambda x: x / F.nullif(norm, F.lit(0.0)))


def add(a: Column, b: Column) -> Column:
    return F.zip_with(a, b, lambda x, y: x + y)


def subtract(a: Column, b: Column) -> Column:
    return F.zip_with(a, b, lambda x, y: x - y)


def is_finite(a: Column) -> Column:
    return ~F.exists(a, lambda x: x.isNull() | F.isnan(x) | (F.abs(x) == float("inf")))


def to_int8(a: Column, scale: float = 127.0) -> Column:
    return F.transform(a, lambda x: F.round(x * scale).cast("tinyint"))


def matvec(rows: list[list[float]], a: Column) -> Column:
    """A dense matrix, given by its rows, times the vector."""
    return F.array(*(dot(a, F.array(*map(F.lit, map(float, r)))) for r in rows))


def nearest_level(x: Column, levels: list[float]) -> Column:
    """Index of the nearest of ascending levels; half-way, the upper one."""
    mids = [(a + b) / 2 for a, b in zip(levels, levels[1:])]
    out = F.lit(0)
    for m in mids:
        out = out + F.when(x >= float(m), 1).otherwise(0)
    return out


def quantize(a: Column, levels: list[float]) -> Column:
    return F.transform(a, lambda x: nearest_level(x, levels))


def reconstruct(codes: Column, levels: list[float]) -> Column:
    table = F.array(*map(F.lit, map(float, levels)))
    return F.transform(codes, lambda c: F.element_at(table, (c + 1).cast("int")))


def pack_nibbles(codes: Column) -> Column:
    """Pairs of 4-bit codes as bytes, the first in the low half; an odd last one stands alone."""
    n = F.size(codes)
    pairs = F.sequence(F.lit(0), F.floor((n - 1) / 2).cast("int"))
    low = lambda i: F.element_at(codes, (2 * i + 1).cast("int"))
    high = lambda i: F.when(2 * i + 2 <= n, F.try_element_at(codes, (2 * i + 2).cast("int"))).otherwise(0)
    return F.when(n > 0, F.transform(pairs, lambda i: low(i) + F.shiftleft(high(i), 4))).otherwise(F.array().cast("array<int>"))


def unpack_nibbles(packed: Column, n: int) -> Column:
    both = F.flatten(F.transform(packed, lambda b: F.array(b.bitwiseAND(15), F.shiftright(b, 4).bitwiseAND(15))))
    return F.slice(both, 1, n)


def sign_code(a: Column, dims: list[int]) -> Column:
    """Bit m is 1 where dimension dims[m] is positive."""
    out = F.lit(0)
    for m, d in enumerate(dims):
        out = out + F.when(F.element_at(a, d + 1) > 0, 1 << m).otherwise(0)
    return out


def parse_embedding(v: Column) -> Column:
    """From a string such as "[0.1, 0.2]"."""
    return F.from_json(v, "array<float>")


def cell_id(c1: Column, c2: Column, c3: Column, k2: int, k3: int) -> Column:
    return (c1 * k2 + c2) * k3 + c3


def orderable_bits(batches, column: str, name: str):
    """For mapInArrow: adds the bits of a float column as an int whose order is that of the floats; -0.0 is below 0.0."""
    import numpy as np
    import pyarrow as pa

    for batch in batches:
        bits = np.ascontiguousarray(batch.column(column).to_numpy(zero_copy_only=False), np.float32).view(np.int32)
        key = np.where(bits < 0, ~bits ^ np.int32(-(2**31)), bits)
        yield pa.RecordBatch.from_arrays([*batch.columns, pa.array(key.astype(np.int32))], names=[*batch.schema.names, name])
