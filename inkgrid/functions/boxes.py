"""Column functions over rectangles; a rectangle is a name prefix or struct with x, y, w, h."""

from __future__ import annotations

from pyspark.sql import Column
from pyspark.sql import functions as F


def part(box: str, name: str) -> Column:
    """Column of a rectangle given as "a." (struct or alias) or "a_" (flat columns) or ""."""
    return F.col(f"{box}{name}")


def area(a: str = "") -> Column:
    return part(a, "w") * part(a, "h")


def intersection(a: str, b: str) -> Column:
    """Common area; 0 if the rectangles only touch."""
    span = lambda at, size: F.least(part(a, at) + part(a, size), part(b, at) + part(b, size)) - F.greatest(part(a, at), part(b, at))
    zero = F.lit(0)
    return F.greatest(zero, span("x", "w")) * F.greatest(zero, span("y", "h"))


def iou(a: str, b: str) -> Column:
    common = intersection(a, b)
    return F.coalesce(F.try_divide(common.cast("double"), area(a) + area(b) - common), F.lit(0.0))


def containment(a: str, b: str) -> Column:
    """Share of the smaller rectangle that is covered."""
    return F.coalesce(F.try_divide(intersection(a, b).cast("double"), F.least(area(a), area(b))), F.lit(0.0))


def overlap_class(a: str, b: str) -> Column:
    """contained, duplicate, partial or none; containment is tested first."""
    ratio = F.try_divide(F.least(area(a), area(b)).cast("double"), F.greatest(area(a), area(b)))
    return F.when(containment(a, b) > 0.7, "contained").when((iou(a, b) > 0.5) & (ratio > 0.7), "duplicate").when(iou(a, b) > 0.1, "partial").otherwise("none")


def js_round(x: Column) -> Column:
    """Round half up, negative numbers included."""
    return F.floor(x + 0.5)


#: The same as SQL text over struct-like names, for expressions inside higher-order functions and DuckDB alike.
def iou_sql(a: str, b: str) -> str:
    common = intersection_sql(a, b)
    return f"(cast({common} AS double) / ({a}.w * {a}.h + {b}.w * {b}.h - {common}))"


def intersection_sql(a: str, b: str) -> str:
    span = lambda at, size: f"greatest(0, least({a}.{at} + {a}.{size}, {b}.{at} + {b}.{size}) - greatest({a}.{at}, {b}.{at}))"
    return f"({span('x', 'w')} * {span('y', 'h')})"
