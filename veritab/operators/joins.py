"""Joins of questions with what belongs to them, and filters by other tables."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from veritab.functions.geometry import intersects


def strict(left: DataFrame, right: DataFrame, key: str) -> DataFrame:
    """Every row of ``left`` with its match; a row without one is an error when it is reached."""
    marked = right.withColumn("_found", F.lit(True))
    joined = left.join(marked, key, "left")
    check = F.when(F.col("_found"), F.lit(True)).otherwise(F.raise_error(F.concat(F.lit(f"no match for {key} "), F.coalesce(F.col(key).cast("string"), F.lit("null")))))
    return joined.where(check).drop("_found")


def split_by_match(left: DataFrame, right: DataFrame, key: str, reason: str) -> tuple[DataFrame, DataFrame]:
    """(matched rows, the others with a reason): what a strict join would stop at goes to quarantine."""
    return left.join(right, key), left.join(right.select(key), key, "left_anti").withColumn("reason", F.lit(reason))


def optional(left: DataFrame, right: DataFrame, key: str) -> DataFrame:
    """Every row of ``left``, nulls where nothing matches."""
    return left.join(right, key, "left")


def with_set(left: DataFrame, right: DataFrame, key: str, array: str) -> DataFrame:
    """A left join whose array is empty where nothing matches."""
    return left.join(right.select(key, array), key, "left").withColumn(array, F.coalesce(array, F.array().cast(right.schema[array].dataType)))


def override(left: DataFrame, mapping: DataFrame, key: str, column: str, replacement: str, flag: str | None = None) -> DataFrame:
    """``column`` from a mapping where it has the key, else as it is; ``flag`` tells which."""
    joined = left.join(mapping.select(key, F.col(replacement).alias("_new")), key, "left")
    out = joined.withColumn(flag, F.col("_new").isNotNull()) if flag else joined
    return out.withColumn(column, F.coalesce("_new", column)).drop("_new")


def by_file(left: DataFrame, files: DataFrame, path: str = "path") -> DataFrame:
    """Rows with the file named {image_id}_{question_id}, then an underscore or a dot; the first by name of several.

    The name is taken apart and joined by equality, so a longer question id never matches a shorter one (Q9).
    """
    name = F.element_at(F.split(F.col(path), "/"), -1)
    parsed = files.select(F.col(path), F.regexp_extract(name, r"^(.+?)_(\d+)(?:[_.].*)?$", 1).alias("image_id"), F.regexp_extract(name, r"^(.+?)_(\d+)(?:[_.].*)?$", 2).try_cast("long").alias("question_id"))
    return left.join(parsed.groupBy("image_id", "question_id").agg(F.min(path).alias(path)), ["image_id", "question_id"])


def ids_of(labels: DataFrame, vocabulary: DataFrame, label: str) -> DataFrame:
    """Labels with their class ids; unknown ones go."""
    return labels.join(vocabulary.select(F.col("name").alias(label), "class_id"), label)


def positions(*tables: DataFrame, key: str = "sample_idx") -> DataFrame:
    """Tables aligned by position; a position that one lacks is an error."""
    out = tables[0]
    for t in tables[1:]:
        out = out.join(t.withColumn("_there", F.lit(True)), key, "full").where(F.when(F.col("_there").isNotNull(), F.lit(True)).otherwise(F.raise_error(F.lit("tables differ in length")))).drop("_there")
    return out


def levels(df: DataFrame, names: list[str], column: str = "level") -> DataFrame:
    """Each row once a level."""
    return df.withColumn(column, F.explode(F.array(*map(F.lit, names))))


#: A side of the finest cells, and how many forbidden rectangles of a key are taken as one array.
CELL, MOST_TOGETHER = 64.0, 1000


def _spread(df: DataFrame, rect: str, levels: list[int]) -> DataFrame:
    """Each rectangle once for every cell that its inside touches, (level, cx, cy), at its own level and those above it of ``levels``: at its own, cells are as large as its longer side, so there are few of each."""
    r = F.col(rect)
    above = F.filter(F.array(*map(F.lit, levels)).cast("array<int>"), lambda n: n > F.col("_own"))
    level = F.explode(F.concat(F.array("_own"), above))
    size = F.lit(CELL) * F.pow(F.lit(2.0), F.col("_level"))
    side = lambda low, high: F.sequence(F.floor(r[low] / size), F.greatest(F.floor(r[low] / size), F.ceil(r[high] / size) - 1))
    cells = df.withColumn("_level", level).withColumn("_cx", F.explode(side("x0", "x1"))).withColumn("_cy", F.explode(side("y0", "y1")))
    return cells


def _levelled(df: DataFrame, rect: str) -> DataFrame:
    """Rectangles with an inside and finite sides, with the level of the cells that are as large as they are."""
    r = F.col(rect)
    side = F.greatest(r["x1"] - r["x0"], r["y1"] - r["y0"]) / CELL
    return df.where(_whole(r)).withColumn("_own", F.greatest(F.lit(0), F.ceil(F.log2(F.greatest(side, F.lit(1.0)))).cast("int")))


def _met(left: DataFrame, right: DataFrame, key: str, rect: str, how: str) -> DataFrame:
    """Rows of ``left``, by cells, joined with what of ``right`` (its key as _key, its rectangle as _other) they meet."""
    a, b = _levelled(left, rect), _levelled(right, "_other").withColumnRenamed("_own", "_own2")
    # A pair meets at the level of the larger of the two, so a rectangle lies at levels above its own only where the other side has larger ones. Sides are under 1e15: some forty levels at most.
    levels_a, levels_b = [sorted(r[0] for r in df.select(c).distinct().collect()) for df, c in ((a, "_own"), (b, "_own2"))]
    a = _spread(a, rect, levels_b)
    b = _spread(b.withColumnRenamed("_own2", "_own"), "_other", levels_a).select(*[F.col(c) for c in right.columns], F.col("_own").alias("_own2"), F.col("_level").alias("_l2"), F.col("_cx").alias("_x2"), F.col("_cy").alias("_y2"))
    same = (F.col(key) == F.col("_key")) & (F.col("_level") == F.col("_l2")) & (F.col("_cx") == F.col("_x2")) & (F.col("_cy") == F.col("_y2"))
    # Spark takes cells for as small as the table that they come from, and would broadcast them.
    return a.join(b.hint("merge"), same & (F.col("_level") == F.greatest("_own", "_own2")) & intersects(F.col(rect), F.col("_other")), how)


def meeting_rects(left: DataFrame, right: DataFrame, key: str, ids: tuple[str, str], rect: str = "rect") -> DataFrame:
    """(key, an id of each side) of all pairs of a key whose insides meet, each once (J13, G03). ``ids``: the id's column of either side, of different names.

    The join is on the key and a cell of a grid, so a crowded key is as many groups as it has cells. Large rectangles lie in cells of their size, and all others of their key
    in these as well; a pair meets at the level of the larger, in the cell that holds the upper left corner of its overlap. Rectangles without an inside, with a side that is null or not finite,
    and such with a null key meet nothing; equal rows meet as often as they are there.
    """
    a = left.select(key, F.col(ids[0]).alias("_a"), F.col(rect).alias("_rect"))
    b = right.select(F.col(key).alias("_key"), F.col(ids[1]).alias("_b"), F.col(rect).alias("_other"))
    met = _met(a, b, key, "_rect", "inner")
    size = F.lit(CELL) * F.pow(F.lit(2.0), F.col("_level"))
    corner = lambda c: F.floor(F.greatest(F.col("_rect")[c], F.col("_other")[c]) / size)
    return met.where((corner("x0") == F.col("_cx")) & (corner("y0") == F.col("_cy"))).select(key, F.col("_a").alias(ids[0]), F.col("_b").alias(ids[1]))


def free_rects(candidates: DataFrame, forbidden: DataFrame, key: str, rect: str = "rect") -> DataFrame:
    """Candidates that meet no forbidden rectangle of their key.

    Where no key has more than ``MOST_TOGETHER`` of them, a key's rectangles come as one array, so no pairs are formed; else they are joined by cells.
    """
    crowd = forbidden.where(F.col(key).isNotNull()).groupBy(key).count().agg(F.max("count")).first()[0] or 0
    if crowd <= MOST_TOGETHER:
        arrays = forbidden.where(F.col(key).isNotNull()).groupBy(key).agg(F.collect_list(rect).alias("_forbidden"))
        joined = candidates.join(arrays, key, "left")
        free = ~F.coalesce(F.exists("_forbidden", lambda f: _meets(F.col(rect), f)), F.lit(False))
        return joined.where(free).select(*candidates.columns)
    others = forbidden.select(F.col(key).alias("_key"), F.col(rect).alias("_other"))
    hit = _met(candidates, others, key, rect, "left_semi").select(*[F.col(c).alias(f"_h{i}") for i, c in enumerate(candidates.columns)]).distinct()
    same = [F.col(c).eqNullSafe(F.col(f"_h{i}")) for i, c in enumerate(candidates.columns)]
    return candidates.join(hit, same, "left_anti")


def _whole(r: Column) -> Column:
    """Whether a rectangle has an inside and finite sides."""
    sides = [F.abs(r[c].cast("double")) < 1e15 for c in ("x0", "y0", "x1", "y1")]
    return sides[0] & sides[1] & sides[2] & sides[3] & (r["x0"] < r["x1"]) & (r["y0"] < r["y1"])


def _meets(a: Column, b: Column) -> Column:
    """Whether two rectangles meet, the same for arrays as for cells."""
    return intersects(a, b) & _whole(a) & _whole(b)


def by_prefix(left: DataFrame, files: DataFrame, wanted: str, path: str = "path") -> DataFrame:
    """Rows with the first file, by name, that begins with what the row wants (J07), for names of any form; a folder doesn't count.

    Lengths of what is wanted are few, so each file is cut to each of them and joined by equality: as many rows a file as there are lengths up to its own. Null and empty wishes match nothing.
    """
    lengths = [r[0] for r in left.where(F.length(wanted) > 0).select(F.length(wanted)).distinct().collect()]  # of names: some hundreds at most
    name = F.element_at(F.split(F.col(path), "/"), -1)
    cuts = F.filter(F.array(*[F.lit(n) for n in sorted(lengths)]).cast("array<int>"), lambda n: n <= F.length(name))
    begun = files.select(F.col(path).alias("_path"), F.explode(F.transform(cuts, lambda n: F.substr(name, F.lit(1), n))).alias("_begin"))
    first = begun.join(left.select(F.col(wanted).alias("_begin")).distinct(), "_begin", "left_semi").groupBy("_begin").agg(F.min("_path").alias("_path"))
    return left.join(first, F.col(wanted) == F.col("_begin")).drop("_begin").withColumnRenamed("_path", path)


def keep_ids(df: DataFrame, ids: DataFrame, key: str) -> DataFrame:
    """Rows whose id is listed."""
    return df.join(ids.select(key).distinct(), key, "left_semi")


def not_done(df: DataFrame, done: DataFrame, key: str) -> DataFrame:
    """Rows whose id is not yet in a log."""
    return df.join(done.select(key).distinct(), key, "left_anti")


def id_range(key: Column, start: int | None, end: int | None) -> Column:
    """Whether an id is a number within a range, ends included."""
    n = key.try_cast("long")
    return F.coalesce((n >= start if start is not None else F.lit(True)) & (n <= end if end is not None else F.lit(True)) & n.isNotNull(), F.lit(False))


def id_modulo(key: Column, shards: int, shard: int) -> Column:
    """Whether an id belongs to one of several shards."""
    return F.coalesce(F.pmod(key.try_cast("long"), F.lit(shards)) == shard, F.lit(False))


def large_enough(width: Column, height: Column, least: int = 28) -> Column:
    """Whether an image has the least size that a model takes."""
    return (width >= least) & (height >= least)


def first_rows(df: DataFrame, order: str, n: int = 10) -> DataFrame:
    """The first n rows of a dataset in its own order."""
    return df.where(F.col(order) < n)
