"""Rectangles as structs (x0, y0, x1, y1), as column expressions. ``rint`` rounds halves to even."""

from __future__ import annotations

from collections.abc import Callable

from pyspark.sql import Column
from pyspark.sql import functions as F


def rect(x0: Column, y0: Column, x1: Column, y1: Column) -> Column:
    return F.struct(x0.alias("x0"), y0.alias("y0"), x1.alias("x1"), y1.alias("y1"))


def _whole(x: Column) -> Column:
    return F.rint(x).cast("int")


def pixel_rect(left: Column, top: Column, width: Column, height: Column, w: Column, h: Column, pad: Column | int = 0, ends_rounded: bool = False) -> Column:
    """A box in shares of the image as whole pixels (G01). ``ends_rounded``: round the far corner as one number, not origin and size apart."""
    pad = F.lit(pad) if isinstance(pad, int) else pad
    x, y = _whole(left * w), _whole(top * h)
    x1, y1 = (_whole((left + width) * w), _whole((top + height) * h)) if ends_rounded else (x + _whole(width * w), y + _whole(height * h))
    return rect(x - pad, y - pad, x1 + pad, y1 + pad)


def clipped(r: Column, w: Column, h: Column, origin_inside: bool = False) -> Column:
    """The part inside the image, null if none (G02). ``origin_inside``: the near corner stays on the last pixel at most."""
    most_x, most_y = (w - 1, h - 1) if origin_inside else (w, h)
    x0, y0 = F.greatest(F.lit(0), F.least(most_x, r["x0"])), F.greatest(F.lit(0), F.least(most_y, r["y0"]))
    x1, y1 = F.greatest(F.lit(0), F.least(w, r["x1"])), F.greatest(F.lit(0), F.least(h, r["y1"]))
    return F.when((x1 > x0) & (y1 > y0), rect(x0, y0, x1, y1))


def valid(r: Column) -> Column:
    return F.coalesce((r["x1"] > r["x0"]) & (r["y1"] > r["y0"]), F.lit(False))


def area(r: Column) -> Column:
    return (r["x1"] - r["x0"]) * (r["y1"] - r["y0"])


def intersects(a: Column, b: Column) -> Column:
    """Whether the insides meet; touching does not count."""
    return (a["x0"] < b["x1"]) & (b["x0"] < a["x1"]) & (a["y0"] < b["y1"]) & (b["y0"] < a["y1"])


def fits(r: Column, forbidden: Column, w: Column, h: Column, margin: Column | int) -> Column:
    """Whether a rectangle keeps the margins and meets none of an array of others."""
    m = F.lit(margin) if isinstance(margin, int) else margin
    inside = (r["x0"] >= m) & (r["y0"] >= m) & (r["x1"] <= w - m) & (r["y1"] <= h - m)
    return inside & ~F.exists(forbidden, lambda f: intersects(r, f))


def forbidden_rects(boxes: Column, w: Column, h: Column, pad_rel: float) -> Column:
    """The padded pixel boxes of an image's tokens, without incomplete ones (G04). ``boxes``: structs top_left_x, top_left_y, width, height."""
    pad = _whole(F.lit(pad_rel) * F.greatest(w, h))
    whole = F.filter(boxes, lambda b: b["top_left_x"].isNotNull() & b["top_left_y"].isNotNull() & b["width"].isNotNull() & b["height"].isNotNull())
    rects = F.transform(whole, lambda b: clipped(pixel_rect(b["top_left_x"], b["top_left_y"], b["width"], b["height"], w, h, pad), w, h))
    return F.filter(rects, lambda r: r.isNotNull())


def union_box(rects: Column) -> Column:
    """The box around the valid rectangles of an array, null without any."""
    good = F.filter(rects, valid)
    side = lambda name, f: f(F.transform(good, lambda r: r[name]))
    return F.when(F.size(good) > 0, rect(side("x0", F.array_min), side("y0", F.array_min), side("x1", F.array_max), side("y1", F.array_max)))


def largest_rect(rects: Column) -> Column:
    """The rectangle of the largest area, of equals the first."""
    ranked = F.transform(rects, lambda r, i: F.struct(area(r).alias("a"), (-i).alias("i"), r.alias("r")))
    return F.array_max(F.filter(ranked, lambda x: valid(x["r"])))["r"]


def centre(r: Column) -> tuple[Column, Column]:
    """The middle, rounded down."""
    return F.floor((r["x0"] + r["x1"]) / 2).cast("int"), F.floor((r["y0"] + r["y1"]) / 2).cast("int")


def grid_cells(w: Column, h: Column, edge: Column, n: int) -> Column:
    """The n x n cells inside the outer edge, row by row, as structs code, gx, gy and r."""
    cw = F.greatest(F.lit(1), F.floor((w - 2 * edge) / n)).cast("int")
    ch = F.greatest(F.lit(1), F.floor((h - 2 * edge) / n)).cast("int")

    def cell(k: Column) -> Column:
        gx, gy = k % n, F.floor(k / n).cast("int")
        x, y = edge + gx * cw, edge + gy * ch
        return F.struct(F.concat_ws("-", gx, gy).alias("code"), gx.alias("gx"), gy.alias("gy"), rect(x, y, x + cw, y + ch).alias("r"))

    return F.transform(F.sequence(F.lit(0), F.lit(n * n - 1)), cell)


def anchor(cell: Column, tw: Column, th: Column, nudge: int = 2) -> Column:
    """Where a text of tw by th begins in a cell: two pixels in, as far as it fits."""
    x = F.least(cell["x0"] + nudge, F.greatest(cell["x0"], cell["x1"] - tw))
    y = F.least(cell["y0"] + nudge, F.greatest(cell["y0"], cell["y1"] - th))
    return F.struct(x.alias("x"), y.alias("y"))


def cell_of(cells: Column, r: Column) -> Column:
    """The code of the first cell that holds a rectangle's middle; cells are closed on the near sides alone."""
    x, y = centre(r)
    found = F.filter(cells, lambda c: (c["r"]["x0"] <= x) & (x < c["r"]["x1"]) & (c["r"]["y0"] <= y) & (y < c["r"]["y1"]))
    return F.try_element_at(found, F.lit(1))["code"]


def _corners(r: Column) -> list[tuple[Column, Column]]:
    return [(r[x], r[y]) for x in ("x0", "x1") for y in ("y0", "y1")]


def _strictly_in(x: Column, y: Column, r: Column) -> Column:
    return (r["x0"] < x) & (x < r["x1"]) & (r["y0"] < y) & (y < r["y1"])


def corner_distance(a: Column, b: Column, w: Column, h: Column) -> Column:
    """The least distance between corners over the image's diagonal; 0 if a corner of either lies inside the other."""
    inside = F.lit(False)
    for r, s in ((a, b), (b, a)):
        for x, y in _corners(r):
            inside = inside | _strictly_in(x, y, s)
    least = F.least(*[F.hypot((x - u).cast("double"), (y - v).cast("double")) for x, y in _corners(a) for u, v in _corners(b)])
    return F.when(inside, F.lit(0.0)).otherwise(least / F.greatest(F.lit(1.0), F.hypot(w.cast("double"), h.cast("double"))))


def gap_distance(a: Column, b: Column) -> Column:
    """The distance between edges in pixels, from the gaps along both axes."""
    dx = F.greatest(F.lit(0), b["x0"] - a["x1"], a["x0"] - b["x1"])
    dy = F.greatest(F.lit(0), b["y0"] - a["y1"], a["y0"] - b["y1"])
    return F.hypot(dx.cast("double"), dy.cast("double"))


def any_rect(x: Column, y: Column, u: Column, v: Column, w: Column, h: Column) -> Column:
    """Four numbers of unknown form as pixels (G10): all within 0 to 1 are shares; far corners beyond the near one and in the image are corners; else sizes."""
    shares = (F.least(x, y, u, v) >= 0) & (F.greatest(x, y, u, v) <= 1)
    corners = (u > x) & (v > y) & (u <= w) & (v <= h)
    by_form: Callable = lambda a, b, c: F.when(shares, a).when(corners, b).otherwise(c)
    r = rect(by_form(x * w, x, x), by_form(y * h, y, y), by_form((x + u) * w, u, x + u), by_form((y + v) * h, v, y + v))
    return clipped(r, w.cast("double"), h.cast("double"), origin_inside=True)


def text_region(r: Column, tw: Column, th: Column, tolerance: float = 0.1) -> Column:
    """A rectangle as it is where its height to width is within a tolerance of a text's, else its largest centred part with the text's proportions, cut to whole pixels."""
    w, h, aspect = (r["x1"] - r["x0"]).cast("double"), (r["y1"] - r["y0"]).cast("double"), th / tw
    tall = aspect > h / w
    sw, sh = F.when(tall, h / aspect).otherwise(w), F.when(tall, h).otherwise(w * aspect)
    x, y = r["x0"] + (w - sw) / 2, r["y0"] + (h - sh) / 2
    whole = lambda v: v.cast("int")
    part = rect(whole(x), whole(y), whole(x + sw), whole(y + sh))
    return F.when((tw > 0) & (w > 0), F.when(F.abs(h / w - aspect) > tolerance, part).otherwise(rect(*[whole(r[c]) for c in ("x0", "y0", "x1", "y1")])))


def square_region(r: Column, w: Column, h: Column, scale: float = 2.0) -> Column:
    """A square around a rectangle's middle, ``scale`` times its longer side, cut at the image's edges; the longer side that is left sets the other, which moves inside."""
    half = F.floor(F.greatest(r["x1"] - r["x0"], r["y1"] - r["y0"]) * scale / 2)
    cx, cy = centre(r)
    left, right = F.greatest(cx - half, F.lit(0)), F.least(cx + half, w)
    top, bottom = F.greatest(cy - half, F.lit(0)), F.least(cy + half, h)

    def widened(low: Column, high: Column, side: Column, most: Column) -> tuple[Column, Column]:
        more = (side - (high - low)) / 2
        at = F.when(low - more < 0, F.lit(0.0)).when(high + more > most, most - side).otherwise(low - more)
        return at, at + side

    side = F.greatest(right - left, bottom - top)
    x, u = widened(left, right, side, w)
    y, v = widened(top, bottom, side, h)
    return rect(x.cast("int"), y.cast("int"), u.cast("int"), v.cast("int"))


def tile_ratio(w: Column, h: Column, least: int = 1, most: int = 12, tile: int = 448) -> Column:
    """How many tiles across and down come closest to an image's proportions.

    Ratios are tried by their number of tiles; an equally close later one is taken where the image is larger than half its tiles.
    """
    grid = sorted({(i, j) for n in range(least, most + 1) for i in range(1, n + 1) for j in range(1, n + 1) if least <= i * j <= most}, key=lambda r: r[0] * r[1])
    ratios = F.array(*[F.struct(F.lit(i).alias("across"), F.lit(j).alias("down")) for i, j in grid])
    aspect, pixels = w / h, (w.cast("long") * h).cast("double")
    start = F.struct(F.lit(float("inf")).alias("far"), F.lit(1).alias("across"), F.lit(1).alias("down"))

    def step(best: Column, r: Column) -> Column:
        far = F.abs(aspect - r["across"] / r["down"])
        later = (far < best["far"]) | ((far == best["far"]) & (pixels > 0.5 * tile * tile * r["across"] * r["down"]))
        return F.struct(F.least(far, best["far"]).alias("far"), F.when(later, r["across"]).otherwise(best["across"]).alias("across"), F.when(later, r["down"]).otherwise(best["down"]).alias("down"))

    return F.aggregate(ratios, start, step, lambda b: F.struct(b["across"], b["down"]))


def tile_boxes(ratio: Column, tile: int = 448) -> Column:
    """The boxes of the tiles of a resized image, row by row."""

    def box(k: Column) -> Column:
        x, y = (k % ratio["across"]) * tile, F.floor(k / ratio["across"]).cast("int") * tile
        return rect(x, y, x + tile, y + tile)

    return F.transform(F.sequence(F.lit(0), ratio["across"] * ratio["down"] - 1), box)


def canvas_rect(r: Column, region: Column, side: int = 512, unit: int = 4) -> Column:
    """A rectangle of a region on a square canvas, in layout units."""
    sx, sy = F.lit(float(side)) / (region["x1"] - region["x0"]), F.lit(float(side)) / (region["y1"] - region["y0"])
    on = lambda v, o, s: F.floor(F.floor((v - o) * s) / unit).cast("int")
    return rect(on(r["x0"], region["x0"], sx), on(r["y0"], region["y0"], sy), on(r["x1"], region["x0"], sx), on(r["y1"], region["y0"], sy))


def layout_prompt(r: Column, text: Column, end: str = " <|endoftext|>") -> Column:
    """Layout tokens: left, top, right and bottom, then each character in brackets, and an end mark."""
    letters = F.array_join(F.transform(F.split(text, ""), lambda c: F.concat(F.lit("["), c, F.lit("]"))), " ")
    return F.concat(F.lit(" l"), r["x0"], F.lit(" t"), r["y0"], F.lit(" r"), r["x1"], F.lit(" b"), r["y1"], F.lit(" "), letters, F.lit(end))
