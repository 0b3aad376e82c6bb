"""Where an attack's text goes in an image. Sizes of texts are inputs: they depend on a font rasteriser.

A pattern's candidates are one array an image; hashes take the place of a generator, so rows are independent and reruns agree.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from veritab.functions.geometry import anchor, cell_of, corner_distance, fits, grid_cells, rect, text_region, valid
from veritab.functions.masks import largest_wide_rectangle, mask_meets_rect, without_rects
from veritab.functions.textnorm import hash_unit, seed_of
from veritab.operators.sampling import BUCKET_ORDER, bucket_members, tertile_cuts

#: Cells a side, tries inside a cell, how much a font shrinks when nothing fits, and the least font of a forced text.
GRID, CELL_TRIES, SHRINK, LEAST_PX = 11, 20, 2, 8


def pattern_seed(image_id: Column, subset: Column, pattern: Column, rule: Column) -> Column:
    """The seed of an image's pattern; the rule enters as text."""
    return seed_of(image_id, subset, pattern, rule)


def font_size(rule: Column, low: Column, high: Column, step: Column, seed: Column) -> Column:
    """Fixed, in steps, anywhere between, or the middle."""
    unit = hash_unit(seed, F.lit("font"))
    steps = F.floor((high - low) / F.greatest(step, F.lit(1))) + 1
    return (
        F.when(rule == "fixed", low)
        .when(rule == "uniform_step", low + F.floor(unit * steps) * step)
        .when(rule == "uniform", low + F.floor(unit * (high - low + 1)))
        .otherwise(F.floor((low + high) / 2))
        .cast("int")
    )


def fill_colour(rule: Column, fixed: Column, palette: Column, luminance: Column, seed: Column) -> Column:
    """A fixed colour, one of a palette, or black on light and white on dark ground."""
    white, black = F.array(*[F.lit(255)] * 3), F.array(*[F.lit(0)] * 3)
    return F.when(rule == "fixed", fixed).when(rule == "palette", F.get(palette, F.floor(hash_unit(seed, F.lit("fill")) * F.size(palette)).cast("int"))).otherwise(F.when(luminance < 128, white).otherwise(black))


def random_places(w: Column, h: Column, tw: Column, th: Column, margin: Column, seed: Column, tries: Column) -> Column:
    """Candidate rectangles at hashed places inside the margins."""

    def one(k: Column) -> Column:
        x = margin + F.floor(hash_unit(seed, F.lit("x"), k) * F.greatest(F.lit(1), w - 2 * margin - tw + 1)).cast("int")
        y = margin + F.floor(hash_unit(seed, F.lit("y"), k) * F.greatest(F.lit(1), h - 2 * margin - th + 1)).cast("int")
        return rect(x, y, x + tw, y + th)

    return F.transform(F.when(tries >= 1, F.sequence(F.lit(1), tries)).otherwise(F.array().cast("array<int>")), one)


def placed_anywhere(w: Column, h: Column, tw: Column, th: Column, margin: Column, forbidden: Column, seed: Column, tries: Column) -> Column:
    """The first of so many candidates that fits, else the top left corner; with whether it was forced."""
    free = F.try_element_at(F.filter(random_places(w, h, tw, th, margin, seed, tries), lambda r: fits(r, forbidden, w, h, margin)), F.lit(1))
    corner = rect(margin, margin, margin + tw, margin + th)
    return F.struct(F.coalesce(free, corner).alias("rect"), free.isNull().alias("forced"))


_RECT = "struct<x0:int,y0:int,x1:int,y1:int>"
_FIT = f"struct<px:int,free:array<struct<value:double,code:string,rect:{_RECT},cell:{_RECT}>>>"


def _scaled(side: str, px: Column) -> Column:
    """A text's side, given at the font size ``px`` of its row, at another one."""
    return F.ceil(F.col(side) * px / F.col("px")).cast("int")


def placed_by_distance(df: DataFrame, bucket: str | Column, n: int = GRID, within_cell: bool = True) -> DataFrame:
    """``df`` (w, h, tw, th, px, min_px, margin, forbidden, answer_rect, seed) with ``placement`` (rect, code, distance, reason, used_px).

    tw and th hold at the font size px. Of the grid's cells but the answer's those count whose anchored text fits; where there are none the font
    shrinks, down to min_px. Their distances from the answer fall into three buckets, and a cell of the wanted one, or of the next that has any, is
    taken by hash; the text goes to the first hashed place inside it that fits, else to its anchor. Without any cell the top left corner is forced.
    """
    cells = grid_cells(F.col("w"), F.col("h"), F.col("margin"), n)
    own = df.withColumn("_cells", cells).withColumn("_home", cell_of(F.col("_cells"), F.col("answer_rect")))
    own = own.withColumn("_cells", F.filter("_cells", lambda c: ~F.coalesce(c["code"] == F.col("_home"), F.lit(False))))
    ok = lambda r: fits(r, F.col("forbidden"), F.col("w"), F.col("h"), F.col("margin"))

    def free(px: Column) -> Column:
        tw, th = _scaled("tw", px), _scaled("th", px)

        def at(c: Column) -> Column:
            a = anchor(c["r"], tw, th)
            return F.struct(c["code"].alias("code"), rect(a["x"], a["y"], a["x"] + tw, a["y"] + th).alias("rect"), c["r"].alias("cell"))

        open_ = F.filter(F.transform("_cells", at), lambda c: ok(c["rect"]))
        return F.transform(open_, lambda c: F.struct(corner_distance(c["rect"], F.col("answer_rect"), F.col("w"), F.col("h")).alias("value"), c["code"].alias("code"), c["rect"].alias("rect"), c["cell"].alias("cell")))

    sizes = F.when(F.col("px") >= F.col("min_px"), F.sequence(F.col("px"), F.col("min_px"), F.lit(-SHRINK))).otherwise(F.array().cast("array<int>"))
    smaller = lambda fit, px: F.when(F.size(fit["free"]) > 0, fit).otherwise(F.struct(px.alias("px"), free(px).alias("free")).cast(_FIT))
    own = own.withColumn("_fit", F.aggregate(sizes, F.lit(None).cast(_FIT), smaller))
    own = own.withColumn("_free", F.coalesce(F.col("_fit.free"), F.array().cast(_FIT[_FIT.index("array") : -1])))
    own = own.withColumn("_cuts", tertile_cuts(F.transform("_free", lambda c: c["value"])))
    own = own.withColumns({f"_{b}": bucket_members(F.col("_free"), F.col("_cuts"), b) for b in BUCKET_ORDER})
    wanted = F.lit(bucket) if isinstance(bucket, str) else bucket
    first = lambda order: F.coalesce(*[F.when(F.size(f"_{b}") > 0, F.struct(F.lit(b).alias("name"), F.col(f"_{b}").alias("cells"))) for b in order])
    own = own.withColumn("_chosen", F.coalesce(*[F.when(wanted == b, first(order)) for b, order in BUCKET_ORDER.items()]))
    best = F.array_min(F.transform("_chosen.cells", lambda c: F.struct(F.md5(F.concat_ws("-", F.col("seed").cast("string"), c["code"])).alias("k"), c.alias("c"))))["c"]
    own = own.withColumn("_best", best).withColumn("_reason", F.when(F.col("_best").isNotNull(), F.col("_chosen.name")).otherwise("forced"))
    own = own.withColumn("_px", F.when(F.col("_best").isNotNull(), F.col("_fit.px")).otherwise(F.greatest("min_px", F.lit(LEAST_PX))))
    own = own.withColumn("_tw", _scaled("tw", F.col("_px"))).withColumn("_th", _scaled("th", F.col("_px")))

    def inside(k: Column) -> Column:
        unit = lambda axis: hash_unit(F.col("seed"), F.lit(f"cell {axis}"), F.col("_best.code"), k)
        begin = lambda axis, side: F.col(f"_best.cell.{axis}0") + F.floor(unit(axis) * (F.greatest(F.lit(0), F.col(f"_best.cell.{axis}1") - F.col(side) - F.col(f"_best.cell.{axis}0")) + 1)).cast("int")
        x, y = begin("x", "_tw"), begin("y", "_th")
        return rect(x, y, x + F.col("_tw"), y + F.col("_th"))

    places = F.filter(F.transform(F.sequence(F.lit(1), F.lit(CELL_TRIES)), inside), ok)
    corner = rect(F.col("margin"), F.col("margin"), F.col("margin") + F.col("_tw"), F.col("margin") + F.col("_th"))
    spot = F.coalesce(F.try_element_at(places, F.lit(1)), F.col("_best.rect")) if within_cell else F.col("_best.rect")
    own = own.withColumn("_spot", F.when(F.col("_best").isNotNull(), spot).otherwise(corner))
    placement = F.struct(
        F.col("_spot").alias("rect"), F.coalesce(F.col("_best.code"), F.lit("TL")).alias("code"), corner_distance(F.col("_spot"), F.col("answer_rect"), F.col("w"), F.col("h")).alias("distance"),
        F.col("_reason").alias("reason"), F.col("_px").alias("used_px"),
    )
    return own.withColumn("placement", placement).drop("_cells", "_home", "_fit", "_free", "_cuts", *[f"_{b}" for b in BUCKET_ORDER], "_chosen", "_best", "_px", "_tw", "_th", "_spot", "_reason")


def placed(df: DataFrame, mode: Column) -> DataFrame:
    """``df`` (as above, with max_retry) with ``placement`` by mode: ``random``, with max_retry places and no smaller font, or a distance bucket; an unknown mode is an error."""
    known = F.when(mode.isin(*BUCKET_ORDER, "random"), mode).otherwise(F.raise_error(F.concat(F.lit("unknown placement mode "), F.coalesce(mode, F.lit("")))).cast("string"))
    df = df.withColumn("_mode", known)
    by_distance = placed_by_distance(df.where("_mode <> 'random'"), F.col("_mode"))
    anywhere = placed_anywhere(F.col("w"), F.col("h"), F.col("tw"), F.col("th"), F.col("margin"), F.col("forbidden"), F.col("seed"), F.col("max_retry"))
    loose = df.where("_mode = 'random'").withColumn("_p", anywhere)
    placement = F.struct(
        F.col("_p.rect").alias("rect"), F.lit("random").alias("code"), corner_distance(F.col("_p.rect"), F.col("answer_rect"), F.col("w"), F.col("h")).alias("distance"),
        F.when(F.col("_p.forced"), "forced").otherwise("random").alias("reason"), F.col("px").alias("used_px"),
    )
    return by_distance.unionByName(loose.withColumn("placement", placement).drop("_p")).drop("_mode")


def patterned(df: DataFrame) -> DataFrame:
    """``df`` (font_rule, font_low, font_high, font_step, unit_w, unit_h, fill_rule, fill, palette, luminance, and what ``placed`` takes but tw, th and px) with px, tw, th, colour and ``placement``: the
    whole of a pattern, from its seed to its place (G16, G17, G20). A text's sides are given for one pixel of its font."""
    own = df.withColumn("px", font_size(F.col("font_rule"), F.col("font_low"), F.col("font_high"), F.col("font_step"), F.col("seed")))
    own = own.withColumns({"tw": F.ceil(F.col("unit_w") * F.col("px")).cast("int"), "th": F.ceil(F.col("unit_h") * F.col("px")).cast("int")})
    own = own.withColumn("colour", fill_colour(F.col("fill_rule"), F.col("fill"), F.col("palette"), F.col("luminance"), F.col("seed")))
    return placed(own, F.col("mode"))


#: Colours of the boxes that are shown to check a placement.
DEBUG_COLOURS = {"cell": "0,0,255", "ocr": "255,165,0", "forbidden": "135,206,250", "answer": "0,255,0", "attack": "255,0,0"}


def debug_rects(keys: list[Column], kinds: dict[str, Column]) -> list[Column]:
    """Columns of ``select``: a row for each box of each kind, with its colour, instead of a drawing (K04). ``kinds``: arrays of boxes; those of the attack are enlarged by a tenth and three tenths."""
    whole = lambda v: F.greatest(F.lit(1), F.rint(v).cast("int"))

    def enlarged(r: Column) -> Column:
        x, y = whole((r["x1"] - r["x0"]) * F.lit(0.1)), whole((r["y1"] - r["y0"]) * F.lit(0.3))
        return rect(r["x0"] - x, r["y0"] - y, r["x1"] + x, r["y1"] + y)

    def shown(kind: str, rects: Column) -> Column:
        box = (lambda r: enlarged(r)) if kind == "attack" else (lambda r: rect(*[r[c] for c in ("x0", "y0", "x1", "y1")]))
        return F.transform(F.filter(rects, valid), lambda r: F.struct(F.lit(kind).alias("kind"), F.lit(DEBUG_COLOURS[kind]).alias("colour"), box(r).alias("rect")))

    rows = [shown(kind, rects) for kind, rects in kinds.items()]
    return [*keys, F.inline(F.concat(*rows))]


def _region(p: Column, size: Column) -> Column:
    """A text's region in a rectangle; one without a width is taken as it is."""
    return F.coalesce(text_region(p, size[0], size[1]), rect(*[p[c].cast("int") for c in ("x0", "y0", "x1", "y1")]))


def _wide_places(masks: Column, position: Column, cols: Column, w: Column, h: Column, forbidden: Column, avoid: Column) -> Column:
    """The largest wide rectangle of each mask off the forbidden boxes, in pixels, the mask at ``position`` first; masks that meet what is to be avoided are left out."""
    numbered = F.transform(masks, lambda m, i: F.struct(((i != F.when((position > 0) & (position <= F.size(masks)), position - 1).otherwise(0)).cast("int") * (i + 1)).alias("turn"), m.alias("m")))
    usable = F.filter(F.array_sort(numbered), lambda n: avoid.isNull() | ~mask_meets_rect(n["m"], cols, avoid, w, h))
    best = F.transform(usable, lambda n: F.struct(largest_wide_rectangle(without_rects(n["m"], cols, forbidden, w, h), cols).alias("r"), F.floor(F.size(n["m"]) / cols).alias("rows")))
    pixels = lambda b: F.struct(
        (b["r"]["x"] / cols * w).cast("double").alias("x0"), (b["r"]["y"] / b["rows"] * h).cast("double").alias("y0"), ((b["r"]["x"] + b["r"]["w"]) / cols * w).cast("double").alias("x1"), ((b["r"]["y"] + b["r"]["h"]) / b["rows"] * h).cast("double").alias("y1")
    )
    return F.transform(F.filter(best, lambda b: b["r"]["w"] > 0), pixels)


def staged_places(df: DataFrame) -> DataFrame:
    """``df`` (w, h, cols, masks, position, preferred, forbidden, avoid, distance, sizes) with ``place`` (x0, y0, x1, y1, reason): the staged search.

    Wanted is a text's region in the preferred rectangle, or in the largest wide rectangle of a mask, the one at ``position`` first, that meets no forbidden box and keeps the
    distance from what is to be avoided; masks that meet that are left out. ``sizes`` are arrays of the text's width and height in each font to try. A second stage asks for a third of the image's longer side
    where that is less; at last the top left corner is forced. Images are independent rows.
    """

    w, h, avoid = F.col("w"), F.col("h"), F.col("avoid")
    places = "array<struct<x0:double,y0:double,x1:double,y1:double>>"
    wanted = F.when(F.col("preferred").isNotNull(), F.array(F.struct(*[F.col(f"preferred.{c}").cast("double").alias(c) for c in ("x0", "y0", "x1", "y1")]))).otherwise(F.array().cast(places))
    forbidden = F.coalesce("forbidden", F.array().cast(df.schema["forbidden"].dataType))
    own = df.withColumn("_forbidden", forbidden)
    # An array of a row's own, so that each mask's rectangle is sought once.
    found = F.concat(wanted, F.coalesce(_wide_places(F.col("masks"), F.coalesce("position", F.lit(0)), F.col("cols"), w, h, F.col("_forbidden"), avoid), F.array().cast(places)))
    own = own.withColumn("_regions", F.flatten(F.transform(found, lambda p: F.transform("sizes", lambda s: _region(p, s)))))
    meets = lambda a, b: (a["x0"] < b["x1"]) & (b["x0"] < a["x1"]) & (a["y0"] < b["y1"]) & (b["y0"] < a["y1"])
    free = F.filter("_regions", lambda a: ~F.exists("_forbidden", lambda f: meets(a, f)))
    far = lambda a: F.hypot(F.greatest(F.lit(0), avoid["x0"] - a["x1"], a["x0"] - avoid["x1"]), F.greatest(F.lit(0), avoid["y0"] - a["y1"], a["y0"] - avoid["y1"]))
    own = own.withColumn("_free", F.transform(free, lambda a: F.struct(a.alias("r"), F.when(avoid.isNotNull(), far(a)).alias("far"))))
    asked, third = F.coalesce(F.col("distance").cast("double"), F.lit(0.0)), F.greatest(w, h) / 3
    first = lambda least: F.try_element_at(F.filter("_free", lambda a: a["far"].isNull() | ~(a["far"] < least)), F.lit(1))["r"]
    own = own.withColumns({"_one": first(asked), "_two": F.when(avoid.isNotNull() & (asked > 0) & (third < asked), first(third))})
    side = lambda full, share, least, small: F.when(F.least(full - 8, F.greatest(F.lit(least), (full * share).cast("int"))) > 8, F.least(full - 8, F.greatest(F.lit(least), (full * share).cast("int")))).otherwise(F.least(full, F.lit(small)))
    corner = F.struct(F.lit(8.0).alias("x0"), F.lit(8.0).alias("y0"), side(w, F.lit(0.35), 40, 72).cast("double").alias("x1"), side(h, F.lit(0.18), 28, 40).cast("double").alias("y1"))
    own = own.withColumn("_corner", _region(corner, F.try_element_at("sizes", F.lit(1))))
    x0, y0 = [F.greatest(F.lit(0), F.least(full - 1, F.col(f"_corner.{c}"))) for full, c in ((w, "x0"), (h, "y0"))]
    forced = F.struct(x0.alias("x0"), y0.alias("y0"), F.greatest(x0 + 1, F.least(w, F.col("_corner.x1"))).alias("x1"), F.greatest(y0 + 1, F.least(h, F.col("_corner.y1"))).alias("y1"))
    told = lambda r, reason: F.struct(*[r[c].cast("int").alias(c) for c in ("x0", "y0", "x1", "y1")], F.lit(reason).alias("reason"))
    place = F.when(F.col("_one").isNotNull(), told(F.col("_one"), "stage 1")).when(F.col("_two").isNotNull(), told(F.col("_two"), "stage 2")).otherwise(told(forced, "force_top_left"))
    return own.withColumn("place", place).drop("_forbidden", "_regions", "_free", "_one", "_two", "_corner")
