"""Where a block stands on its page: one form for boxes that come as points, as a corner with a size, or as two corners."""

from __future__ import annotations

from pyspark.sql import Column
from pyspark.sql import functions as F

# How far a centred block's middle is from the page's at most, and what part of a page is its top.
CENTRE_TOLERANCE, TOP_SHARE = 0.1, 0.05


def _box(left: Column, top: Column, right: Column, bottom: Column) -> Column:
    return F.struct(left.cast("double").alias("left"), top.cast("double").alias("top"), right.cast("double").alias("right"), bottom.cast("double").alias("bottom"))


def of_points(points: Column) -> Column:
    """The box around an array of structs x, y; null for null or no points."""
    xs, ys = F.transform(points, lambda p: p["x"]), F.transform(points, lambda p: p["y"])
    return F.when(F.size(points) > 0, _box(F.array_min(xs), F.array_min(ys), F.array_max(xs), F.array_max(ys)))


def of_size(x: Column, y: Column, w: Column, h: Column) -> Column:
    return F.when(x.isNotNull() & y.isNotNull() & w.isNotNull() & h.isNotNull(), _box(x, y, x + w, y + h))


def of_corners(x1: Column, y1: Column, x2: Column, y2: Column) -> Column:
    """Of two opposite corners, whichever comes first."""
    return F.when(x1.isNotNull() & y1.isNotNull() & x2.isNotNull() & y2.isNotNull(), _box(F.least(x1, x2), F.least(y1, y2), F.greatest(x1, x2), F.greatest(y1, y2)))


def centred(box: Column, page_width: Column) -> Column:
    """Whether a box's middle is that of the page, by a tenth of its width; false without a box or a width."""
    middle = (box["left"] + box["right"]) / 2
    return F.coalesce(F.abs(middle / F.nullif(page_width.cast("double"), F.lit(0.0)) - 0.5) < CENTRE_TOLERANCE, F.lit(False))


def at_top(box: Column, page_height: Column) -> Column:
    """Whether a box begins in the top twentieth of the page; false without a box or a height."""
    return F.coalesce(box["top"] / F.nullif(page_height.cast("double"), F.lit(0.0)) < TOP_SHARE, F.lit(False))
