"""Boxes as struct(x0, y0, x1, y1) columns, origin at the top left."""

from __future__ import annotations

from pyspark.sql import Column
from pyspark.sql import functions as F

DOUBLE4 = "struct<x0: double, y0: double, x1: double, y1: double>"


def box(x0, y0, x1, y1) -> Column:
    c = lambda v: (v if isinstance(v, Column) else F.col(v) if isinstance(v, str) else F.lit(v)).cast("double")
    return F.struct(c(x0).alias("x0"), c(y0).alias("y0"), c(x1).alias("x1"), c(y1).alias("y1"))


def from_array(a: Column) -> Column:
    return box(a[0], a[1], a[2], a[3])


def width(b: Column) -> Column:
    return b["x1"] - b["x0"]


def height(b: Column) -> Column:
    return b["y1"] - b["y0"]


def area(b: Column) -> Column:
    return width(b) * height(b)


def centre(b: Column) -> tuple[Column, Column]:
    return (b["x0"] + b["x1"]) / 2, (b["y0"] + b["y1"]) / 2


def overlap_area(a: Column, b: Column) -> Column:
    w = F.greatest(F.lit(0.0), F.least(a["x1"], b["x1"]) - F.greatest(a["x0"], b["x0"]))
    h = F.greatest(F.lit(0.0), F.least(a["y1"], b["y1"]) - F.greatest(a["y0"], b["y0"]))
    return w * h


def iou(a: Column, b: Column) -> Column:
    """Overlap over union; 0 where the union is 0."""
    o = overlap_area(a, b)
    union = area(a) + area(b) - o
    return F.when(union == 0, 0.0).otherwise(o / union)


def iou_clamped(a: Column, b: Column) -> Column:
    """The same with inverted boxes counted as empty."""
    clamp = lambda v: F.greatest(F.lit(0.0), v)
    o = overlap_area(a, b)
    union = clamp(width(a)) * clamp(height(a)) + clamp(width(b)) * clamp(height(b)) - o
    return F.when(union <= 0, 0.0).otherwise(o / union)


def fraction_of_first(a: Column, b: Column) -> Column:
    """Overlap over the area of a; 0 for an empty a."""
    return F.when(area(a) <= 0, 0.0).otherwise(overlap_area(a, b) / area(a))


def fraction_of_smaller(a: Column, b: Column) -> Column:
    least = F.least(area(a), area(b))
    return F.when(least <= 0, 0.0).otherwise(overlap_area(a, b) / least)


def covers_text(word: Column, region: Column, share: float = 0.3) -> Column:
    return fraction_of_first(word, region) > share


def clip(b: Column, page_width: Column, page_height: Column) -> Column:
    """The part of b on the page; null if nothing is left."""
    x0, y0 = F.greatest(F.lit(0.0), b["x0"]), F.greatest(F.lit(0.0), b["y0"])
    x1, y1 = F.least(page_width.cast("double"), b["x1"]), F.least(page_height.cast("double"), b["y1"])
    return F.when((x1 > x0) & (y1 > y0), box(x0, y0, x1, y1))


def flip(b: Column, page_height: Column) -> Column:
    """From an origin at the bottom left."""
    return box(b["x0"], page_height - b["y1"], b["x1"], page_height - b["y0"])


def centre_inside(b: Column, outer: Column, pad: float = 0.0) -> Column:
    x, y = centre(b)
    return (x >= outer["x0"] - pad) & (x <= outer["x1"] + pad) & (y >= outer["y0"] - pad) & (y <= outer["y1"] + pad)


def contains(outer: Column, inner: Column, slack: float = 0.0) -> Column:
    return (outer["x0"] <= inner["x0"] + slack) & (outer["y0"] <= inner["y0"] + slack) & (outer["x1"] >= inner["x1"] - slack) & (outer["y1"] >= inner["y1"] - slack)


def word_in_table(word: Column, table: Column, slack: float = 10.0) -> Column:
    """Any overlap with a table whose lower edge counts `slack` lower."""
    return (word["x0"] < table["x1"]) & (word["x1"] > table["x0"]) & (word["y0"] < table["y1"] + slack) & (word["y1"] > table["y0"])


def coverage(boxes: Column, region: Column) -> Column:
    """Summed overlap of an array of boxes with a region over its area, 1 at most."""
    total = F.aggregate(boxes, F.lit(0.0), lambda acc, b: acc + overlap_area(b, region))
    return F.when(area(region) <= 0, 0.0).otherwise(F.least(F.lit(1.0), total / area(region)))


def valid(b: Column, page_width: Column, page_height: Column, slack: float = 0.01) -> Column:
    """Finite, not empty, on the page but for a little slack."""
    finite = ~(F.isnan(b["x0"]) | F.isnan(b["y0"]) | F.isnan(b["x1"]) | F.isnan(b["y1"]))
    return finite & (b["x0"] >= 0) & (b["y0"] >= 0) & (b["x0"] < b["x1"]) & (b["y0"] < b["y1"]) & (b["x1"] <= page_width + slack) & (b["y1"] <= page_height + slack)


def page_fractions(b: Column, page_width: Column, page_height: Column, pad: float = 1.0) -> Column:
    """x, y, width and height as fractions of the page in four places, padded and clipped; null if nothing is left."""
    c = clip(box(b["x0"] - pad, b["y0"] - pad, b["x1"] + pad, b["y1"] + pad), page_width, page_height)
    r = lambda v, of: F.bround(F.try_divide(v, of), 4)  # noqa: E731  half to even
    return F.when(c.isNotNull(), F.struct(r(c["x0"], page_width).alias("x"), r(c["y0"], page_height).alias("y"), r(width(c), page_width).alias("width"), r(height(c), page_height).alias("height")))


def locatable(b: Column, page_width: Column, page_height: Column) -> Column:
    """Whether a finding can be placed at all."""
    return F.coalesce((page_width > 0) & (page_height > 0) & (b["x1"] > b["x0"]) & (b["y1"] > b["y0"]), F.lit(False))


def span_part(b: Column, length: Column, start: Column, end: Column, margin: int = 1) -> Column:
    """The part of a box of `length` characters that characters start..end take, with a margin of characters."""
    a = F.greatest(F.lit(0), start - margin) / F.greatest(F.lit(1), length)
    z = F.least(length, end + margin) / F.greatest(F.lit(1), length)
    return box(b["x0"] + width(b) * a, b["y0"], b["x0"] + width(b) * z, b["y1"])


def limited_padding(base: Column, padded: Column, neighbours: Column) -> Column:
    """padded, but no further on any side than a neighbour that lies beyond that side of base."""
    beside = lambda n: (n["y0"] < base["y1"]) & (n["y1"] > base["y0"])
    over = lambda n: (n["x0"] < base["x1"]) & (n["x1"] > base["x0"])
    most = lambda start, side, pick, f: F.aggregate(F.filter(neighbours, side), start, lambda acc, n: f(acc, n[pick]))
    return box(
        most(padded["x0"], lambda n: beside(n) & (n["x1"] <= base["x0"]), "x1", F.greatest), most(padded["y0"], lambda n: over(n) & (n["y1"] <= base["y0"]), "y1", F.greatest),
        most(padded["x1"], lambda n: beside(n) & (n["x0"] >= base["x1"]), "x0", F.least), most(padded["y1"], lambda n: over(n) & (n["y0"] >= base["y1"]), "y0", F.least),
    )


def fitting_scales(minimum: Column, step: float = 0.05) -> Column:
    """1.0 downwards in steps, ending with the minimum itself."""
    n = F.floor((1.0 - minimum) / step + 1e-9).cast("int")
    steps = F.transform(F.sequence(F.lit(0), F.greatest(n, F.lit(0))), lambda i: F.round(1.0 - i * step, 4))
    return F.when(F.element_at(steps, -1) > minimum + 1e-9, F.concat(steps, F.array(minimum))).otherwise(steps)


def union_box(boxes: Column) -> Column:
    """The least box around an array of boxes."""
    of = lambda pick, f: f(F.transform(boxes, lambda b: b[pick]))
    return box(of("x0", F.array_min), of("y0", F.array_min), of("x1", F.array_max), of("y1", F.array_max))


def rounded2(b: Column) -> Column:
    return box(*(F.bround(b[k], 2) for k in ("x0", "y0", "x1", "y1")))
