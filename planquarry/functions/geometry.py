"""Boxes as array<double> [x1, y1, x2, y2], in column expressions. A bad box is null, and null stays null."""

from __future__ import annotations

from pyspark.sql import Column
from pyspark.sql import functions as F

SCALE = 1000


def _finite(v: Column) -> Column:
    return v.isNotNull() & ~F.isnan(v) & (F.abs(v) < F.lit(float("inf")))


def let(value: Column, body) -> Column:
    """body(value) with the value computed once: nested expressions would repeat it at every use."""
    return F.transform(F.array(value), body)[0]


def box(values: Column) -> Column:
    """Four finite numbers, else null."""
    wide = F.transform(values, lambda v: v.cast("double"))
    return F.when((F.size(wide) == 4) & F.forall(wide, _finite), wide)


def box_of(fields: Column, names: list[str]) -> Column:
    """Box from a struct that spells its corners in one of the usual ways (x_min.., xmin.., x1..)."""
    ways = [("x_min", "y_min", "x_max", "y_max"), ("xmin", "ymin", "xmax", "ymax"), ("x1", "y1", "x2", "y2")]
    found = [F.array(*[fields[k] for k in way]) for way in ways if set(way) <= set(names)]
    return F.coalesce(*[box(b) for b in found]) if found else F.lit(None).cast("array<double>")


def ordered(b: Column) -> Column:
    """Corners swapped into order; zero area is null."""
    x1, x2 = F.least(b[0], b[2]), F.greatest(b[0], b[2])
    y1, y2 = F.least(b[1], b[3]), F.greatest(b[1], b[3])
    return F.when((x1 < x2) & (y1 < y2), F.array(x1, y1, x2, y2))


def valid(b: Column, normalized: bool = True) -> Column:
    fine = (b[0] < b[2]) & (b[1] < b[3])
    if normalized:
        fine = fine & (F.array_min(b) >= 0) & (F.array_max(b) <= SCALE)
    return F.coalesce(F.when(F.size(b) == 4, fine), F.lit(False))


def _clip(v: Column) -> Column:
    return F.greatest(F.lit(0.0), F.least(F.lit(float(SCALE)), v))


def normalize(b: Column, width: Column | None = None, height: Column | None = None, pixels: bool | None = None, integer: bool = True) -> Column:
    """To 0..1000: fractions (all within 1.5) are scaled, pixels too where dimensions are known and either `pixels` is
    true or a coordinate exceeds 1000; then clipped. Degenerate boxes are null. Integers round half to even."""
    width = F.lit(None).cast("double") if width is None else width.cast("double")
    height = F.lit(None).cast("double") if height is None else height.cast("double")
    known = F.coalesce((width != 0) & (height != 0), F.lit(False))

    def scaled(b: Column) -> Column:
        largest = F.array_max(F.transform(b, F.abs))
        use = known & (F.lit(bool(pixels)) | (largest > SCALE))
        sides = F.array(width, height, width, height)
        fraction = largest <= 1.5
        moved = F.zip_with(b, sides, lambda v, side: _clip(F.when(fraction, v * SCALE).when(use, v / side * SCALE).otherwise(v)))
        return F.when(fraction | ~(use & ((width <= 0) | (height <= 0))), moved)

    def checked(out: Column) -> Column:
        fine = F.when((out[0] < out[2]) & (out[1] < out[3]), out)
        return F.transform(fine, F.rint) if integer else fine

    return let(let(b, scaled), checked)


def normalize_repaired(b: Column, width: Column, height: Column, repair: str = "both") -> Column:
    """Pixels to 0..1000 with clamping; a degenerate side is widened by one: up, or down at the far edge.

    repair: "both", "up" (only upwards) or "none" (degenerate boxes stay)."""

    def side(lo: Column, hi: Column) -> tuple[Column, Column]:
        if repair == "none":
            return lo, hi
        grown = F.when(hi <= lo, F.least(lo + 1, F.lit(float(SCALE)))).otherwise(hi)
        if repair == "up":
            return lo, grown
        return F.when((grown <= lo) & (lo > 0), lo - 1).otherwise(lo), grown

    x1, y1, x2, y2 = (F.rint(_clip(b[i] / s.cast("double") * SCALE)) for i, s in enumerate((width, height, width, height)))
    (x1, x2), (y1, y2) = side(x1, x2), side(y1, y2)
    return F.array(x1, y1, x2, y2)


def area(b: Column) -> Column:
    return F.coalesce(F.greatest(F.lit(0.0), b[2] - b[0]) * F.greatest(F.lit(0.0), b[3] - b[1]), F.lit(0.0))


def intersection(a: Column, b: Column) -> Column:
    w = F.least(a[2], b[2]) - F.greatest(a[0], b[0])
    h = F.least(a[3], b[3]) - F.greatest(a[1], b[1])
    return F.coalesce(F.greatest(F.lit(0.0), w) * F.greatest(F.lit(0.0), h), F.lit(0.0))


def iou(a: Column, b: Column) -> Column:
    both = intersection(a, b)
    union = area(a) + area(b) - both
    return F.when(union > 0, both / union).otherwise(0.0)


def center(b: Column) -> Column:
    return F.struct(((b[0] + b[2]) / 2).alias("x"), ((b[1] + b[3]) / 2).alias("y"))


def center_in(inner: Column, outer: Column) -> Column:
    x, y = (inner[0] + inner[2]) / 2, (inner[1] + inner[3]) / 2
    return F.coalesce((outer[0] <= x) & (x <= outer[2]) & (outer[1] <= y) & (y <= outer[3]), F.lit(False))


def contains(outer: Column, inner: Column) -> Column:
    fine = (outer[0] <= inner[0]) & (outer[1] <= inner[1]) & (outer[2] >= inner[2]) & (outer[3] >= inner[3])
    return F.coalesce(fine, F.lit(False))


def containment(inner: Column, outer: Column) -> Column:
    own = area(inner)
    return F.when(own > 0, intersection(inner, outer) / own).otherwise(0.0)


def expand(b: Column, padding: float = 0.1) -> Column:
    dx, dy = (b[2] - b[0]) * padding, (b[3] - b[1]) * padding
    grown = F.array(b[0] - dx, b[1] - dy, b[2] + dx, b[3] + dy)
    return F.when((b[0] < b[2]) & (b[1] < b[3]), normalize(grown))


def expand_pixels(b: Column, width: Column, height: Column, padding: float) -> Column:
    """Padded outwards to whole pixels inside the image."""
    dx, dy = (b[2] - b[0]) * padding, (b[3] - b[1]) * padding
    zero = F.lit(0).cast("bigint")
    return F.array(
        F.greatest(zero, F.floor(b[0] - dx)),
        F.greatest(zero, F.floor(b[1] - dy)),
        F.least(width.cast("bigint"), F.ceil(b[2] + dx)),
        F.least(height.cast("bigint"), F.ceil(b[3] + dy)),
    )


def _pair(first: Column, second: Column, body) -> Column:
    both = F.struct(normalize(first, integer=False).alias("a"), normalize(second, integer=False).alias("c"))
    return normalize(let(both, lambda s: body(s["a"], s["c"])))


def crop_to_global(local: Column, crop: Column) -> Column:
    """A box of a crop, in the drawing the crop comes from; both in 0..1000."""
    return _pair(local, crop, lambda a, c: F.array(*[c[i % 2] + a[i] / SCALE * (c[i % 2 + 2] - c[i % 2]) for i in range(4)]))


def global_to_crop(whole: Column, crop: Column) -> Column:
    """A box of the drawing, in a crop of it."""
    return _pair(whole, crop, lambda a, c: F.array(*[(a[i] - c[i % 2]) / (c[i % 2 + 2] - c[i % 2]) * SCALE for i in range(4)]))


def denormalize(b: Column, width: Column, height: Column, padding: float = 0.0) -> Column:
    """0..1000 to pixels, padded by a share of the image's sides and clamped."""

    def at(i: int) -> Column:
        side = (width if i % 2 == 0 else height).cast("double")
        moved = b[i] / SCALE * side + (side * padding if i > 1 else -side * padding)
        return F.greatest(F.lit(0.0), F.least(side, moved)).cast("int")

    return F.array(*[at(i) for i in range(4)])


def polygon_center(points: Column) -> Column:
    """Mean of array<array<double>> vertices."""
    n = F.size(points)
    mean = lambda i: F.aggregate(points, F.lit(0.0), lambda s, p: s + p[i]) / n
    return F.struct(mean(0).alias("x"), mean(1).alias("y"))


def polygon_right(points: Column) -> Column:
    return F.array_max(F.transform(points, lambda p: p[0]))


def match_score(overlap: Column, same_label: Column) -> Column:
    """Half for the overlap (0.8 counts as full), half for the label."""
    return F.when(overlap >= 0.8, 0.5).otherwise(overlap * 0.5) + F.when(same_label, 0.5).otherwise(0.0)
