"""Layout boxes: ``struct<bbox array<double> [x1, y1, x2, y2], class int, conf double, center_x double, height double>`` in arrays, one array a post."""

from __future__ import annotations

from pyspark.sql import Column
from pyspark.sql import functions as F

from glosswright.functions.text import let

BOX = "struct<bbox:array<double>,class:int,conf:double,center_x:double,height:double>"
# Thresholds.
CONTAINED, COVERED, ON_SIGNATURE, SMALL_SIGNATURE = 0.7, 0.75, 0.6, 0.5
LEAST_ASPECT, DENSITY_DIVISOR, LEAST_CONFIDENCE = 2.6, 150, 0.25


def intersection(a: Column, b: Column) -> Column:
    side = lambda i: F.greatest(F.lit(0.0), F.least(a[i + 2], b[i + 2]) - F.greatest(a[i], b[i]))
    return side(0) * side(1)


def area(a: Column) -> Column:
    return F.greatest(F.lit(0.0), a[2] - a[0]) * F.greatest(F.lit(0.0), a[3] - a[1])


def with_layout(boxes: Column, least: float = LEAST_CONFIDENCE) -> Column:
    """Confident raw detections (``bbox, class, conf``) with ``center_x`` and ``height``, from right to left."""
    full = F.transform(
        F.filter(boxes, lambda b: b["conf"] >= least),
        lambda b: F.struct(b["bbox"].alias("bbox"), b["class"].alias("class"), b["conf"].alias("conf"), ((b["bbox"][0] + b["bbox"][2]) / 2).alias("center_x"), (b["bbox"][3] - b["bbox"][1]).alias("height")),
    )
    return right_to_left(full)


def of_class(boxes: Column, kind: int) -> Column:
    """Class 0 are text columns, class 1 signatures."""
    return F.filter(boxes, lambda b: b["class"] == kind)


def right_to_left(boxes: Column) -> Column:
    """Ordered by falling ``center_x``; equals stay in order."""
    keyed = F.transform(boxes, lambda b, i: F.struct((-b["center_x"]).alias("k"), i.alias("i"), b.alias("b")))
    return F.transform(F.array_sort(keyed), lambda x: x["b"])


def clean_columns(columns: Column, signatures: Column) -> Column:
    """Without boxes that hold two others, near-copies of larger boxes, and columns on a small signature; the input where none would be left."""
    none = F.array().cast(f"array<{BOX}>")
    return let(F.coalesce(columns, none), lambda c: let(F.coalesce(signatures, none), lambda s: _cleaned(c, s)))


def _cleaned(columns: Column, signatures: Column) -> Column:
    # What a lambda uses of the whole array is computed before it: inside, it would be computed again for each box.
    numbered = F.transform(columns, lambda b, i: F.struct((-area(b["bbox"])).alias("k"), i.alias("i"), b.alias("b")))
    holds = lambda x, y: (x["i"] != y["i"]) & (area(y["b"]["bbox"]) > 0) & (intersection(x["b"]["bbox"], y["b"]["bbox"]) >= CONTAINED * area(y["b"]["bbox"]))
    single = let(numbered, lambda n: F.filter(n, lambda x: F.size(F.filter(n, lambda y: holds(x, y))) < 2))
    covered = lambda x, kept: F.exists(kept, lambda k: intersection(x["b"]["bbox"], k["b"]["bbox"]) / -x["k"] >= COVERED)
    none = F.filter(numbered, lambda x: F.lit(False))
    kept = F.aggregate(F.array_sort(single), none, lambda acc, x: F.when((x["k"] < 0) & ~covered(x, acc), F.array_append(acc, x)).otherwise(acc))
    tallest = F.coalesce(F.nullif(F.array_max(F.transform(columns, lambda b: F.coalesce(b["height"], F.lit(0.0)))), F.lit(0.0)), F.lit(1.0))
    small = let(tallest, lambda most: F.filter(signatures, lambda s: s["bbox"][3] - s["bbox"][1] < SMALL_SIGNATURE * most))
    free = let(small, lambda found: F.filter(kept, lambda x: ~F.exists(found, lambda s: intersection(x["b"]["bbox"], s["bbox"]) / -x["k"] >= ON_SIGNATURE)))
    ordered = F.transform(F.array_sort(F.transform(free, lambda x: F.struct(x["i"].alias("i"), x["b"].alias("b")))), lambda x: x["b"])
    return let(ordered, lambda left: F.when(F.size(left) == 0, columns).otherwise(left))


def allocation(heights: Column, n: Column, compat: bool = False) -> Column:
    """How many of ``n`` characters each column gets: in proportion, halves to even, the remainder to the first largest.

    A remainder larger than that count would make it negative; then the excess is taken from the following counts instead, so that the counts always
    add up to ``n``. ``compat`` leaves the negative count.
    """

    def shares(h: Column) -> Column:
        total = F.aggregate(h, F.lit(0.0), lambda a, x: a + x)
        return let(F.when(total == 0, 1.0).otherwise(total), lambda all_: F.transform(h, lambda x: F.bround(x / all_ * n, 0).cast("int")))

    def rounded(counts: Column) -> Column:
        rest = n.cast("int") - F.aggregate(counts, F.lit(0), lambda a, c: a + c)
        at = (F.array_position(counts, F.array_max(counts)) - 1).cast("int")
        return let(F.struct(rest.alias("rest"), at.alias("at")), lambda x: F.transform(counts, lambda c, i: F.when(i == x["at"], c + x["rest"]).otherwise(c)))

    def paid(given: Column) -> Column:
        owed = F.aggregate(given, F.lit(0), lambda a, c: a + F.greatest(-c, F.lit(0)))
        return F.aggregate(
            F.transform(given, lambda c: F.greatest(c, F.lit(0))),
            F.struct(owed.alias("owed"), F.array().cast("array<int>").alias("out")),
            lambda a, c: F.struct((a["owed"] - F.least(a["owed"], c)).alias("owed"), F.array_append(a["out"], c - F.least(a["owed"], c)).alias("out")),
            lambda a: a["out"],
        )

    given = let(let(F.transform(heights, lambda h: F.coalesce(h, F.lit(1.0))), shares), rounded)
    return given if compat else let(given, paid)


def allocated_lines(text: Column, heights: Column, keep_empty: bool = False) -> Column:
    """The text cut into the columns' lines; without columns one line, without text none."""
    return let(text, lambda x: let(heights, lambda h: _cut(x, h, keep_empty)))


def _cut(text: Column, heights: Column, keep_empty: bool) -> Column:
    counts = allocation(heights, F.length(text))
    cut = F.aggregate(
        counts,
        F.struct(F.lit(1).alias("at"), F.array().cast("array<string>").alias("out")),
        lambda a, c: F.struct((a["at"] + c).alias("at"), F.array_append(a["out"], F.substring(text, a["at"], c)).alias("out")),
        lambda a: a["out"],
    )
    cut = cut if keep_empty else F.filter(cut, lambda x: x != "")
    none = F.array().cast("array<string>")
    return F.when(F.coalesce(text, F.lit("")) == "", none).when(F.coalesce(F.size(heights), F.lit(0)) <= 0, none if keep_empty else F.array(text)).otherwise(cut)


def has_orphan(lines: Column) -> Column:
    """A line of one character beside one of three or more."""
    lengths = F.filter(F.transform(lines, F.length), lambda n: n > 0)
    return let(lengths, lambda n: F.coalesce((F.array_min(n) == 1) & (F.array_max(n) >= 3), F.lit(False)))


def mean_aspect(columns: Column) -> Column:
    """Mean height by width, widths at least 1."""
    ratios = F.transform(columns, lambda c: c["height"] / F.greatest(c["bbox"][2] - c["bbox"][0], F.lit(1.0)))
    return F.try_divide(F.aggregate(ratios, F.lit(0.0), lambda a, r: a + r), F.size(ratios).cast("double"))


def char_height(columns: Column, text: Column) -> Column:
    return F.try_divide(F.aggregate(F.transform(columns, lambda c: c["height"]), F.lit(0.0), lambda a, h: a + h), F.length(text).cast("double"))
