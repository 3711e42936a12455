"""Scalar expressions behind maps and payloads: normalised values, widths, colours, safe JSON."""

from __future__ import annotations

from collections.abc import Mapping

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F
from pyspark.sql import types as T


def clamp01(x: Column) -> Column:
    return F.least(F.lit(1.0), F.greatest(F.lit(0.0), x))


def normalise(value: Column, lo: Column, hi: Column, *, kind: str = "linear", pivot: float = 0.0, good_low: bool = False) -> Column:
    """A value's place in [0, 1]: linear, log, diverging about a pivot, or a flag; null stays null."""
    if kind == "flag":
        out = value.cast("double")
    elif kind == "diverging":
        reach = F.greatest(F.abs(hi - pivot), F.abs(lo - pivot))
        out = clamp01(0.5 + (value - pivot) / (2 * F.when(reach > 0, reach).otherwise(1.0)))
    elif kind == "log":
        f = lambda x: F.log1p(F.greatest(x, F.lit(0.0)))
        width = f(hi) - f(lo)
        out = clamp01((f(value) - f(lo)) / F.when(width > 0, width).otherwise(1.0))
    else:
        out = clamp01((value - lo) / F.when(hi > lo, hi - lo).otherwise(1.0))
    out = 1 - out if good_low else out
    return F.when(value.isNotNull(), out)


def arc_width(flow: Column, lo: Column, hi: Column) -> Column:
    """1.5 to 8 by the logarithm of a flow, within the logarithms of the least and greatest flow."""
    return 1.5 + 6.5 * clamp01((F.log10(flow + 1) - lo) / F.when(hi > lo, hi - lo).otherwise(1.0))


#: Colours of the scores 0, 25, 50, 75 and 100 (fixed values).
STOPS = ((58, 31, 93), (122, 45, 110), (196, 69, 105), (255, 139, 61), (255, 209, 102))


def score_colour(score: Column) -> Column:
    """array(r, g, b) on the straight line between the two stops that a score lies between."""
    place = clamp01(score / 100) * (len(STOPS) - 1)
    below = F.least(F.floor(place), F.lit(len(STOPS) - 2)).cast("int")
    stops = F.array(*[F.array(*map(F.lit, s)) for s in STOPS])
    blend = F.zip_with(F.get(stops, below), F.get(stops, below + 1), lambda a, b: F.floor(a + (b - a) * (place - below)).cast("int"))
    return F.when(score.isNotNull(), blend)


def finite(c: Column) -> Column:
    """Null in place of NaN and infinities."""
    return F.when(~F.isnan(c) & (F.abs(c) < float("inf")), c)


def safe_json(frame: DataFrame, rounding: Mapping[str, int] | None = None) -> Column:
    """A row as JSON with nulls written out, numbers rounded, and no NaN or infinity."""
    rounding = rounding or {}
    cols = []
    for f in frame.schema.fields:
        c = F.col(f"`{f.name}`")
        if isinstance(f.dataType, T.DoubleType | T.FloatType):
            c = finite(c)
            if f.name in rounding:
                c = F.round(c, rounding[f.name])
                c = c.cast("bigint") if rounding[f.name] == 0 else c
        cols.append(c.alias(f.name))
    return F.to_json(F.struct(*cols), {"ignoreNullFields": "false"})


def pin_integers(frame: DataFrame) -> DataFrame:
    """Double columns that hold only whole numbers become bigint; one pass decides."""
    doubles = [f.name for f in frame.schema.fields if isinstance(f.dataType, T.DoubleType)]
    if not doubles:
        return frame
    whole = frame.agg(*[F.coalesce(F.bool_and(F.col(f"`{c}`") % 1 == 0), F.lit(False)).alias(c) for c in doubles]).first()
    return frame.select(*[F.col(f"`{c}`").cast("bigint").alias(c) if c in doubles and whole[c] else F.col(f"`{c}`") for c in frame.columns])
