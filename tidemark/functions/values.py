"""Column functions on the three value types and their encodings.

Kinds: 0 explicit null, 1 unsigned integer (DECIMAL(20,0) ``u``), 2 one-byte
percentage code (``q``), 3 raw 32-bit float pattern (``f``, 0..2^32-1).
"""

from __future__ import annotations

from decimal import Decimal

from pyspark.sql import Column
from pyspark.sql import functions as F
from pyspark.sql import types as T

NULL, UINT, SQ1, F32 = 0, 1, 2, 3
U64 = T.DecimalType(20, 0)
WIDE = T.DecimalType(38, 0)


def sq1_fp4(code: Column) -> Column:
    """Percent x 10^4 of a code 0..254 (finer steps for low percentages); null for 255."""
    c = code.cast("int")
    return F.when(c <= 50, c * 1000).when(c <= 78, 50_000 + (c - 50) * 2_500).when(c <= 254, 120_000 + (c - 78) * 5_000)


def sq1_quantize(basis_points: Column) -> Column:
    """The code nearest to a share in basis points, halves up, at most 254."""
    b = basis_points.cast("long")
    step = lambda x, n: F.floor((x + n // 2) / F.lit(n))
    return F.least(F.when(b <= 500, step(b, 10)).when(b <= 1200, 50 + step(b - 500, 25)).otherwise(78 + step(b - 1200, 50)), F.lit(254)).cast("smallint")


def f32_bits(value: Column) -> Column:
    """The raw pattern of a float as 0..2^32-1; signed zeros and NaN payloads survive."""
    whole = F.coalesce(value.cast("float"), F.lit(0.0).cast("float"))
    signed = F.java_method(F.lit("java.lang.Float"), F.lit("floatToRawIntBits"), whole).cast("long")
    return F.when(value.isNotNull(), F.when(signed < 0, signed + 4294967296).otherwise(signed))


def f32_value(bits: Column) -> Column:
    """The float of a raw pattern."""
    whole = F.coalesce(bits, F.lit(0).cast("long"))
    signed = F.when(whole >= 2147483648, whole - 4294967296).otherwise(whole).cast("int")
    return F.when(bits.isNotNull(), F.java_method(F.lit("java.lang.Float"), F.lit("intBitsToFloat"), signed).cast("float"))


def f32_order(bits: Column) -> Column:
    """A number that sorts like IEEE total order: -NaN, -inf .. -0, +0 .. +inf, +NaN."""
    return F.when(bits < 2147483648, bits + 2147483648).otherwise(4294967295 - bits)


def order_key(kind: Column) -> Column:
    """What extrema compare; null for explicit nulls."""
    return (
        F.when(kind == UINT, F.col("u").cast(U64)).when(kind == SQ1, F.col("q").cast(U64)).when(kind == F32, f32_order(F.col("f")).cast(U64))
    )


def zigzag(delta: Column) -> Column:
    d = delta.cast(WIDE)
    return F.when(d >= 0, d * 2).otherwise(-d * 2 - 1)


def unzigzag(code: Column) -> Column:
    c = code.cast(WIDE)
    return F.when(c % 2 == 0, c / 2).otherwise(-(c + 1) / 2).cast(WIDE)


def varint_extra(value: Column, first_bits: int) -> Column:
    """Continuation bytes of a number whose first byte carries ``first_bits`` bits and each further one 7."""
    v = value.cast(WIDE)
    out, bound = F.lit(10), 2**first_bits
    for n in range(9, -1, -1):
        out = F.when(v < F.lit(Decimal(bound * 2 ** (7 * n))).cast(WIDE), F.lit(n)).otherwise(out)
    return out


def fixed_width(largest: Column) -> Column:
    """Bytes (1, 2, 4 or 8) that hold every value up to ``largest``."""
    v = largest.cast(WIDE)
    return F.when(v < 256, 1).when(v < 65536, 2).when(v < 4294967296, 4).otherwise(8)


def cell_text(kind: Column, u: Column, q: Column, f: Column) -> Column:
    """A value as command-line text: null, u:N, q:CODE or f: and eight hex digits."""
    return (
        F.when(kind == UINT, F.concat(F.lit("u:"), u.cast("decimal(20,0)").cast("string")))
        .when(kind == SQ1, F.concat(F.lit("q:"), q.cast("string")))
        .when(kind == F32, F.concat(F.lit("f:"), F.lower(F.lpad(F.hex(f), 8, "0"))))
        .otherwise("null")
    )
