"""Segmentation masks as flat arrays of booleans, line by line: their largest rectangles and the cells under an image's rectangles, as folds in built-in expressions.

A cell that is null is not set. A mask that is null, or whose number of columns is null or none, gives null.
"""

from __future__ import annotations

from pyspark.sql import Column
from pyspark.sql import functions as F


def _lines(mask: Column, cols: Column) -> Column:
    """The mask's lines, as structs of their number and cells."""
    rows = F.floor(F.size(mask) / cols).cast("int")
    return F.when(rows > 0, F.transform(F.sequence(F.lit(0), rows - 1), lambda i: F.struct(i.alias("i"), F.slice(mask, i * cols + 1, cols).alias("cells")))).otherwise(F.array().cast("array<struct<i:int,cells:array<boolean>>>"))


def largest_wide_rectangle(mask: Column, cols: Column) -> Column:
    """The largest rectangle of set cells that is wider than high: x, y, w, h; zeros without any.

    Over each line stands a histogram of set cells, folded with a stack of rising bars; a bar that ends bounds a rectangle, of whose lines as many count
    as keep it wider than high. Among equal areas the one that ends first counts, by line, then column, then height.
    """
    zero = lambda: F.lit(0)
    best0 = F.struct(zero().alias("less"), zero().alias("i"), zero().alias("end"), zero().alias("h"), zero().alias("start"))
    bars = "array<struct<start:int,h:int>>"

    def ended(s: Column, bar: Column, i: Column) -> Column:
        """The best of the rectangles that end before a bar."""
        done = F.filter(s["stack"], lambda t: t["h"] > bar["h"])

        def one(t: Column) -> Column:
            wide = bar["j"] - t["start"]
            high = F.least(t["h"], wide - 1)
            return F.struct((-(wide * high)).alias("less"), i.alias("i"), bar["j"].alias("end"), high.alias("h"), t["start"].alias("start"))

        return F.least(s["best"], F.array_min(F.transform(done, one)))

    def line(up: Column, best: Column, i: Column) -> Column:
        steps = F.transform(F.concat(up, F.array(F.lit(0))), lambda h, j: F.struct(j.alias("j"), h.alias("h")))

        def step(s: Column, bar: Column) -> Column:
            last = F.try_element_at(s["stack"], F.lit(-1))["h"]
            start = F.coalesce(F.try_element_at(F.filter(s["stack"], lambda t: t["h"] > bar["h"]), F.lit(1))["start"], bar["j"])
            lower = F.filter(s["stack"], lambda t: t["h"] <= bar["h"])
            held = F.coalesce(F.try_element_at(lower, F.lit(-1))["h"], F.lit(0)) == bar["h"]  # such a bar stands already, or there is none
            new = F.when(held, F.array().cast(bars)).otherwise(F.array(F.struct(start.alias("start"), bar["h"].alias("h"))))
            rising = F.struct(F.concat(s["stack"], F.array(F.struct(bar["j"].alias("start"), bar["h"].alias("h")))).alias("stack"), s["best"].alias("best"))
            falling = F.struct(F.concat(lower, new).alias("stack"), ended(s, bar, i).alias("best"))
            level = F.coalesce(last, F.lit(0))
            return F.when(level == bar["h"], s).when(level < bar["h"], rising).otherwise(falling)

        return F.aggregate(steps, F.struct(F.array().cast(bars).alias("stack"), best.alias("best")), step, lambda s: s["best"])

    def down(s: Column, row: Column) -> Column:
        up = F.zip_with(s["up"], row["cells"], lambda u, c: F.when(c, u + 1).otherwise(0))
        return F.struct(up.alias("up"), line(up, s["best"], row["i"]).alias("best"))

    none = F.array_repeat(F.lit(0), cols)
    found = F.aggregate(_lines(mask, cols), F.struct(none.alias("up"), best0.alias("best")), down, lambda s: s["best"])
    shown = F.transform(F.array(found), lambda b: F.struct(b["start"].alias("x"), F.when(b["less"] < 0, b["i"] - b["h"] + 1).otherwise(0).alias("y"), (b["end"] - b["start"]).alias("w"), b["h"].alias("h")))
    return F.when(mask.isNotNull() & (cols > 0), F.element_at(shown, 1))


def cells(rect: Column, w: Column, h: Column, rows: Column, cols: Column) -> Column:
    """The cells of a mask that a rectangle of its image touches: x0, y0, x1, y1, the last two not included."""
    sx, sy = cols / F.greatest(F.lit(1.0), w.cast("double")), rows / F.greatest(F.lit(1.0), h.cast("double"))
    on = lambda v, most: F.greatest(F.lit(0), F.least(most.cast("long"), v)).cast("int")
    return F.struct(
        on(F.floor(rect["x0"] * sx), cols).alias("x0"), on(F.floor(rect["y0"] * sy), rows).alias("y0"),
        on(F.ceil(rect["x1"] * sx), cols).alias("x1"), on(F.ceil(rect["y1"] * sy), rows).alias("y1"),
    )


def without_rects(mask: Column, cols: Column, rects: Column, w: Column, h: Column) -> Column:
    """A mask with the cells under an image's rectangles cleared."""
    rows = F.floor(F.size(mask) / cols).cast("int")

    def cleared(own: Column) -> Column:
        under = lambda x, y: F.exists(own, lambda r: (r["x0"] <= x) & (x < r["x1"]) & (r["y0"] <= y) & (y < r["y1"]))
        return F.transform(mask, lambda c, i: F.coalesce(c, F.lit(False)) & ~under(i % cols, F.floor(i / cols)))

    held = F.transform(F.coalesce(rects, F.array().cast("array<struct<x0:int,y0:int,x1:int,y1:int>>")), lambda r: cells(r, w, h, rows, cols))
    held = F.filter(held, lambda r: (r["x0"] < r["x1"]) & (r["y0"] < r["y1"]))
    return F.when(mask.isNotNull() & (cols > 0), F.element_at(F.transform(F.array(held), cleared), 1))  # places of rectangles are found once


def mask_meets_rect(mask: Column, cols: Column, rect: Column, w: Column, h: Column) -> Column:
    """Whether a mask has a set cell under a rectangle of its image (G12). Only the lines under it are read."""
    rows = F.floor(F.size(mask) / cols).cast("int")

    def met(r: Column) -> Column:
        line = lambda y: F.exists(F.slice(mask, y * cols + r["x0"] + 1, r["x1"] - r["x0"]), lambda c: F.coalesce(c, F.lit(False)))
        return F.when((r["x0"] < r["x1"]) & (r["y0"] < r["y1"]), F.exists(F.sequence(r["y0"], F.greatest(r["y0"], r["y1"] - 1)), line)).otherwise(F.lit(False))

    return F.when(mask.isNotNull() & (cols > 0), F.element_at(F.transform(F.array(cells(rect, w, h, rows, cols)), met), 1))
