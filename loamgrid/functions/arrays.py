"""Column functions over the class axis of a probability array; all run inside the JVM."""

from __future__ import annotations

from pyspark.sql import Column
from pyspark.sql import functions as F

LEAST, TOLERANCE, LEVELS = 1e-7, 5e-3, 65535


def total(a: Column) -> Column:
    return F.aggregate(a, F.lit(0.0), lambda s, x: s + x)


def softmax(a: Column) -> Column:
    """Shifted by the maximum, so that large scores don't overflow."""
    raised = F.transform(a, lambda x: F.exp(x - F.array_max(a)))
    return normalized(raised)


def normalized(a: Column) -> Column:
    return F.transform(a, lambda x: x / total(a))


def calibrated_log(a: Column, temperature: Column | float) -> Column:
    """ln(p clipped to [1e-7, 1]) / temperature."""
    return F.transform(a, lambda p: F.ln(F.least(F.greatest(p, F.lit(LEAST)), F.lit(1.0))) / temperature)


def argmax(a: Column) -> Column:
    """Index of the maximum, the lowest one on ties."""
    return (F.array_position(a, F.array_max(a)) - 1).cast("int")


def margin(a: Column) -> Column:
    """Largest less second largest."""
    top = F.sort_array(a, asc=False)
    return F.get(top, 0) - F.get(top, 1)


def quantized(a: Column) -> Column:
    """Round half to even of p * 65535."""
    return F.transform(a, lambda p: F.bround(p * LEVELS).cast("int"))


def dequantized(a: Column) -> Column:
    return F.transform(a, lambda q: q / LEVELS)


def violation(a: Column, classes: int) -> Column:
    """Why an array is no probability vector, or null."""
    return (
        F.when(a.isNull() | (F.size(a) != classes), "size")
        .when(F.exists(a, lambda p: p.isNull() | F.isnan(p) | (F.abs(p) == float("inf"))), "not_finite")
        .when(F.exists(a, lambda p: p < 0), "negative")
        .when(F.abs(total(a) - 1) > TOLERANCE, "sum")
    )


def cosine_weight(at: Column, size: int, overlap: int) -> Column:
    """Blend weight of pixel ``at`` on an axis: sin^2 ramps over the overlap on both sides."""
    if not 0 < overlap < size:
        raise ValueError("overlap must be between 1 and size - 1")
    ramp = lambda i: F.pow(F.sin(0.5 * 3.141592653589793 * (i + 0.5) / overlap), 2)
    from_start, from_end = ramp(at), ramp(size - 1 - at)
    return F.least(F.when(at < overlap, from_start).otherwise(1.0), F.when(size - 1 - at < overlap, from_end).otherwise(1.0))


def pixel_area_m2(family: Column, width: Column, height: Column, center_y: Column) -> Column:
    """Ground area of a pixel: projected metres, EPSG:3857 (shrunk by cos^2 of latitude), or geographic degrees."""
    mercator = F.pow(F.cos(F.atan(F.sinh(center_y / 6378137.0))), 2)
    lat = F.radians(center_y)
    north = 111132.954 - 559.822 * F.cos(2 * lat) + 1.175 * F.cos(4 * lat)
    east = 3.141592653589793 / 180.0 * 6378137.0 * F.cos(lat)
    return F.when(family == "metre", F.abs(width * height)).when(family == "mercator", F.abs(width * height) * mercator).when((family == "degree") & center_y.between(-90, 90), F.abs(width) * east * F.abs(height) * north)
