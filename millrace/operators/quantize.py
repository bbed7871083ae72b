"""Vector codecs as expressions: 8-bit codes with scale and offset, and half precision."""

from __future__ import annotations

from pyspark.sql import Column
from pyspark.sql import functions as F


def quantize(vector: Column, target: str) -> Column:
    if target == "int8":
        return quantize_int8(vector)
    if target == "float16":
        return quantize_float16(vector)
    raise ValueError(f"unknown target {target!r}; int8 and float16 are known")


def quantize_int8(vector: Column) -> Column:
    """``struct<codes, dimensions, scale, offset>``; a constant vector has scale 0 and codes 0."""
    v = vector.cast("array<double>")
    low, high = F.array_min(v), F.array_max(v)
    scale = (high - low) / 255.0
    code = lambda x: F.greatest(F.lit(-128), F.least(F.lit(127), F.rint((x - low) / F.nullif(scale, F.lit(0.0))).cast("int") - 128))
    codes = F.when(scale > 0, F.transform(v, code)).otherwise(F.transform(v, lambda x: F.lit(0)))
    return F.struct(codes.cast("array<tinyint>").alias("codes"), F.size(v).alias("dimensions"), F.coalesce(scale, F.lit(0.0)).alias("scale"), F.coalesce(low, F.lit(0.0)).alias("offset"))


def dequantize_int8(q: Column) -> Column:
    return F.transform(q["codes"], lambda c: F.when(q["scale"] == 0, q["offset"]).otherwise((c.cast("double") + 128) * q["scale"] + q["offset"]))


def half(x: Column) -> Column:
    """The nearest IEEE half, half to even; beyond its range is an error."""
    x = x.cast("double")
    size = F.abs(x)
    unit = F.pow(F.lit(2.0), F.greatest(F.floor(F.log2(F.nullif(size, F.lit(0.0)))), F.lit(-14)) - 10)
    return (
        F.when(x == 0, x).when(size >= 65520, F.raise_error(F.lit("too large for half precision")).cast("double"))
        .otherwise(F.signum(x) * F.rint(size / unit) * unit)
    )


def quantize_float16(vector: Column) -> Column:
    return F.transform(vector, half)


def estimate_savings(n: Column, dimensions: Column, target: str) -> Column:
    """``struct<original_bytes, quantized_bytes, savings_percent>``: 4 bytes a number against 2, or 1 and 8 a vector."""
    original = F.lit(4).cast("bigint") * n * dimensions
    size = {"float16": F.lit(2).cast("bigint") * n * dimensions, "int8": n * (dimensions + 8)}[target]
    return F.struct(original.alias("original_bytes"), size.cast("bigint").alias("quantized_bytes"), F.when(original > 0, F.round((1 - size / original) * 100, 1)).otherwise(0.0).alias("savings_percent"))
