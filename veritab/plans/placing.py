"""Geometry, grounding and placement over boxes made from numbers of the driver's tables."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

from veritab.functions import geometry as G
from veritab.operators import grounding, joins, placement
from veritab.plans.tables import Registry, read
from veritab.sources.readers import dealt

R = Registry()


def _side(name: str, k: int) -> Column:
    """A share of the image from a part's number."""
    return (F.col(name) * k % 97) / F.lit(120.0)


_BOX = """WITH b AS (SELECT p_partkey, 640 AS w, 480 AS h, (p_partkey * 7 % 97) / 120.0::DOUBLE AS l, (p_partkey * 13 % 97) / 120.0::DOUBLE AS t, (1 + p_size % 30) / 100.0::DOUBLE AS bw, (1 + p_size % 17) / 100.0::DOUBLE AS bh FROM part),
r AS (SELECT *, CAST(round_even(l * w, 0) AS INTEGER) AS x0, CAST(round_even(t * h, 0) AS INTEGER) AS y0 FROM b),
p AS (SELECT p_partkey, w, h, x0, y0, x0 + CAST(round_even(bw * w, 0) AS INTEGER) AS x1, y0 + CAST(round_even(bh * h, 0) AS INTEGER) AS y1 FROM r)
"""


def _boxes(spark: SparkSession, sf: str) -> DataFrame:
    p = read(spark, sf, "part").select("p_partkey", F.lit(640).alias("w"), F.lit(480).alias("h"), _side("p_partkey", 7).alias("l"), _side("p_partkey", 13).alias("t"), ((F.col("p_size") % 30 + 1) / 100.0).alias("bw"), ((F.col("p_size") % 17 + 1) / 100.0).alias("bh"))
    return p.withColumn("r", G.pixel_rect(*[F.col(c) for c in ("l", "t", "bw", "bh", "w", "h")]))


@R.query(_BOX + ", c AS (SELECT p_partkey, greatest(0, x0 - 5) AS x0, greatest(0, y0 - 5) AS y0, least(w, x1 + 5) AS x1, least(h, y1 + 5) AS y1 FROM p) SELECT p_partkey, x0, y0, x1, y1, (x1 - x0) * (y1 - y0) AS area FROM c WHERE x1 > x0 AND y1 > y0")
def rect_pixels(spark: SparkSession, sf: str) -> DataFrame:
    """Padded pixel boxes, cut to the image."""
    b = _boxes(spark, sf).select("p_partkey", G.clipped(G.pixel_rect(*[F.col(c) for c in ("l", "t", "bw", "bh", "w", "h")], 5), F.col("w"), F.col("h")).alias("r"))
    return b.where(G.valid(F.col("r"))).select("p_partkey", "r.*", G.area(F.col("r")).alias("area"))


@R.query(
    _BOX
    + """, a AS (SELECT p_partkey, p_partkey // 10 AS g, x0, y0, x1, y1 FROM p)
SELECT c.p_partkey, c.g FROM a c WHERE NOT EXISTS (SELECT 1 FROM a f WHERE f.g = c.g AND f.p_partkey % 10 < 5 AND c.x0 < f.x1 AND f.x0 < c.x1 AND c.y0 < f.y1 AND f.y0 < c.y1) AND c.p_partkey % 10 >= 5"""
)
def rect_overlap(spark: SparkSession, sf: str) -> DataFrame:
    """Of ten boxes the last five that meet none of the first five."""
    a = _boxes(spark, sf).select("p_partkey", F.floor(F.col("p_partkey") / 10).alias("g"), F.col("r").alias("rect"))
    return joins.free_rects(a.where("p_partkey % 10 >= 5"), a.where("p_partkey % 10 < 5"), "g").select("p_partkey", "g")


# Boxes of parts on a strip that grows with them, one region a size of part modulo 3, so each region is crowded; every fiftieth box is a large one.
_PLANE = """WITH b AS (SELECT p_partkey AS id, p_size % 3 AS region, p_partkey % 2 = 1 AS odd, p_partkey * 7919 % 9973 AS x0, p_partkey * 5 + p_partkey * 104729 % 997 AS y0,
  1 + p_partkey * 31 % 397 + CASE WHEN p_partkey % 50 = 0 THEN 20000 ELSE 0 END AS w, 1 + p_partkey * 17 % 211 + CASE WHEN p_partkey % 50 = 0 THEN 300 ELSE 0 END AS h FROM part),
p AS (SELECT id, region, odd, x0, y0, x0 + w AS x1, y0 + h AS y1 FROM b)
"""


def _plane(spark: SparkSession, sf: str) -> DataFrame:
    k = F.col("p_partkey")
    large = lambda n: F.when(k % 50 == 0, n).otherwise(0)
    x, y = k * 7919 % 9973, k * 5 + k * 104729 % 997
    r = F.struct(x.alias("x0"), y.alias("y0"), (x + 1 + k * 31 % 397 + large(20000)).alias("x1"), (y + 1 + k * 17 % 211 + large(300)).alias("y1"))
    return read(spark, sf, "part").select(k.alias("id"), (F.col("p_size") % 3).alias("region"), (k % 2 == 1).alias("odd"), r.alias("rect"))


@R.query(_PLANE + "SELECT a.region, a.id AS odd_id, b.id AS even_id FROM p a JOIN p b ON a.region = b.region AND a.odd AND NOT b.odd AND a.x0 < b.x1 AND b.x0 < a.x1 AND a.y0 < b.y1 AND b.y0 < a.y1")
def spatial_pairs(spark: SparkSession, sf: str) -> DataFrame:
    """Which odd boxes of a region meet which even ones."""
    b = _plane(spark, sf)
    return joins.meeting_rects(b.where("odd").withColumnRenamed("id", "odd_id"), b.where("not odd").withColumnRenamed("id", "even_id"), "region", ("odd_id", "even_id"))


@R.query(_PLANE + "SELECT a.region, a.id FROM p a WHERE a.odd AND NOT EXISTS (SELECT 1 FROM p b WHERE a.region = b.region AND NOT b.odd AND a.x0 < b.x1 AND b.x0 < a.x1 AND a.y0 < b.y1 AND b.y0 < a.y1)")
def crowded_free_rects(spark: SparkSession, sf: str) -> DataFrame:
    """Odd boxes that meet no even one of their region, regions of any size."""
    b = _plane(spark, sf).select("id", "region", "odd", "rect")
    return joins.free_rects(b.where("odd").select("region", "id", "rect"), b.where("not odd"), "region").select("region", "id")


@R.query(_BOX + "SELECT p_partkey // 10 AS g, min(x0) AS x0, min(y0) AS y0, max(x1) AS x1, max(y1) AS y1, arg_max(p_partkey, CAST((x1 - x0) * (y1 - y0) AS BIGINT) * 100000000 - p_partkey) AS largest FROM p GROUP BY 1")
def union_boxes(spark: SparkSession, sf: str) -> DataFrame:
    """The box around ten boxes, and which is the largest."""
    a = _boxes(spark, sf).groupBy(F.floor(F.col("p_partkey") / 10).alias("g")).agg(F.array_sort(F.collect_list(F.struct("p_partkey", "r"))).alias("s"))
    rects = F.transform("s", lambda x: x["r"])
    best = F.array_max(F.transform("s", lambda x: F.struct(G.area(x["r"]).alias("a"), (-x["p_partkey"]).alias("k"))))["k"]
    return a.select("g", G.union_box(rects).alias("u"), (-best).alias("largest")).select("g", "u.*", "largest")


@R.query(
    """WITH s AS (SELECT DISTINCT p_size FROM part), c AS (SELECT p_size, 200 + p_size AS w, 100 + p_size AS h, greatest(1, (200 + p_size - 20) // 11) AS cw, greatest(1, (100 + p_size - 20) // 11) AS ch FROM s),
g AS (SELECT c.*, k % 11 AS gx, k // 11 AS gy FROM c, unnest(range(0, 121)) t(k))
SELECT p_size, gx || '-' || gy AS code, CAST(10 + gx * cw AS INTEGER) AS x0, CAST(10 + gy * ch AS INTEGER) AS y0, CAST(10 + gx * cw + cw AS INTEGER) AS x1, CAST(10 + gy * ch + ch AS INTEGER) AS y1,
CAST(least(10 + gx * cw + 2, greatest(10 + gx * cw, 10 + gx * cw + cw - 12)) AS INTEGER) AS ax, CAST(least(10 + gy * ch + 2, greatest(10 + gy * ch, 10 + gy * ch + ch - 6)) AS INTEGER) AS ay FROM g"""
)
def grid_cells(spark: SparkSession, sf: str) -> DataFrame:
    """Cells and anchors of images of several sizes."""
    s = read(spark, sf, "part").select("p_size").distinct()
    c = s.select("p_size", F.explode(G.grid_cells(F.col("p_size") + 200, F.col("p_size") + 100, F.lit(10), 11)).alias("c"))
    return c.select("p_size", "c.code", "c.r.*", G.anchor(F.col("c.r"), F.lit(12), F.lit(6)).alias("a")).select("p_size", "code", "x0", "y0", "x1", "y1", F.col("a.x").alias("ax"), F.col("a.y").alias("ay"))


def _corner_sql() -> str:
    corners = {"a": [("a." + x, "a." + y) for x in ("x0", "x1") for y in ("y0", "y1")], "b": [("b." + x, "b." + y) for x in ("x0", "x1") for y in ("y0", "y1")]}
    inside = " OR ".join(f"({o}.x0 < {x} AND {x} < {o}.x1 AND {o}.y0 < {y} AND {y} < {o}.y1)" for s, o in (("a", "b"), ("b", "a")) for x, y in corners[s])
    least = ", ".join(f"sqrt(power({x} - {u}, 2) + power({y} - {v}, 2))" for x, y in corners["a"] for u, v in corners["b"])
    return f"CASE WHEN {inside} THEN 0.0 ELSE least({least}) / 800.0 END"


@R.query(
    _BOX
    + f"""SELECT a.p_partkey, round({_corner_sql()}, 9) AS corner, round(sqrt(power(greatest(0, b.x0 - a.x1, a.x0 - b.x1), 2) + power(greatest(0, b.y0 - a.y1, a.y0 - b.y1), 2)), 9) AS gap FROM p a JOIN p b ON b.p_partkey = a.p_partkey + 1"""
)
def edge_distance(spark: SparkSession, sf: str) -> DataFrame:
    """Distances between each box and the next."""
    a = _boxes(spark, sf).select("p_partkey", "w", "h", "r")
    b = _boxes(spark, sf).select((F.col("p_partkey") - 1).alias("p_partkey"), F.col("r").alias("s"))
    return a.join(b, "p_partkey").select("p_partkey", F.round(G.corner_distance(F.col("r"), F.col("s"), F.col("w"), F.col("h")), 9).alias("corner"), F.round(G.gap_distance(F.col("r"), F.col("s")), 9).alias("gap"))


@R.query(
    """WITH n AS (SELECT p_partkey, CAST(p_partkey % 50 AS DOUBLE) AS x, CAST(p_partkey % 40 AS DOUBLE) AS y, CAST(p_size * 3 AS DOUBLE) AS u, CAST(p_size * 2 AS DOUBLE) AS v FROM part),
m AS (SELECT p_partkey, CASE WHEN p_partkey % 3 = 0 THEN x / 100 ELSE x END AS x, CASE WHEN p_partkey % 3 = 0 THEN y / 100 ELSE y END AS y, CASE WHEN p_partkey % 3 = 0 THEN u / 200 ELSE u END AS u, CASE WHEN p_partkey % 3 = 0 THEN v / 200 ELSE v END AS v FROM n),
f AS (SELECT *, least(x, y, u, v) >= 0 AND greatest(x, y, u, v) <= 1 AS share, u > x AND v > y AND u <= 100 AND v <= 80 AS corner FROM m),
r AS (SELECT p_partkey, CASE WHEN share THEN x * 100 ELSE x END AS x0, CASE WHEN share THEN y * 80 ELSE y END AS y0, CASE WHEN share THEN (x + u) * 100 WHEN corner THEN u ELSE x + u END AS x1, CASE WHEN share THEN (y + v) * 80 WHEN corner THEN v ELSE y + v END AS y1 FROM f),
c AS (SELECT p_partkey, greatest(0, least(99, x0)) AS x0, greatest(0, least(79, y0)) AS y0, greatest(0, least(100, x1)) AS x1, greatest(0, least(80, y1)) AS y1 FROM r)
SELECT p_partkey, round(CAST(x0 AS DOUBLE), 6) AS x0, round(CAST(y0 AS DOUBLE), 6) AS y0, round(CAST(x1 AS DOUBLE), 6) AS x1, round(CAST(y1 AS DOUBLE), 6) AS y1 FROM c WHERE x1 > x0 AND y1 > y0"""
)
def rect_forms(spark: SparkSession, sf: str) -> DataFrame:
    """Four numbers as shares, corners or sizes."""
    share = F.col("p_partkey") % 3 == 0
    raw = [(F.col("p_partkey") % 50).cast("double"), (F.col("p_partkey") % 40).cast("double"), (F.col("p_size") * 3).cast("double"), (F.col("p_size") * 2).cast("double")]
    n = [F.when(share, c / d).otherwise(c) for c, d in zip(raw, (100, 100, 200, 200), strict=True)]
    b = read(spark, sf, "part").select("p_partkey", G.any_rect(*n, F.lit(100), F.lit(80)).alias("r")).where("r IS NOT NULL")
    return b.select("p_partkey", *[F.round(F.col(f"r.{c}").cast("double"), 6).alias(c) for c in ("x0", "y0", "x1", "y1")])


@R.query(
    """WITH g AS (SELECT i, j, row_number() OVER (ORDER BY i * j, i, j) AS k FROM unnest(range(1, 13)) a(i), unnest(range(1, 13)) b(j) WHERE i * j <= 12),
s AS (SELECT DISTINCT p_size, 300 + 37 * (p_size % 20) AS w, 200 + 23 * (p_size % 13) AS h FROM part),
d AS (SELECT p_size, w, h, i, j, k, abs(w / h - i / j) AS far FROM s CROSS JOIN g),
m AS (SELECT p_size, min(far) AS far FROM d GROUP BY p_size),
c AS (SELECT d.*, row_number() OVER (PARTITION BY d.p_size ORDER BY k) AS n FROM d JOIN m ON m.p_size = d.p_size AND m.far = d.far)
SELECT p_size, CAST(arg_max(i, k) AS INTEGER) AS across, CAST(arg_max(j, k) AS INTEGER) AS down FROM c WHERE n = 1 OR w * h > 0.5 * 448 * 448 * i * j GROUP BY p_size"""
)
def tile_ratios(spark: SparkSession, sf: str) -> DataFrame:
    """G15."""
    s = read(spark, sf, "part").select("p_size").distinct()
    return s.select("p_size", G.tile_ratio(300 + 37 * (F.col("p_size") % 20), 200 + 23 * (F.col("p_size") % 13)).alias("t")).select("p_size", "t.across", "t.down")


# Forty words of a document in a row stand for an image's tokens, ten a line; every word is in one image. Of an image with fewer than three words the last stands for those that it lacks. What is sought depends on the image's number.
_LONG = "qqqqqqqqqqqqqqqqqqqqqqqqqqqqqqqq jjjjjjjjjjjjjjjjjjjjjjjjjjjjjjjj "
_TOKENS = rf"""WITH w AS (SELECT doc_id, regexp_extract_all(text, '[^\s]+') AS ws FROM documents),
im AS MATERIALIZED (SELECT doc_id, part, (doc_id * 7 + part) % 10 AS h, ws[40 * part + 1:40 * part + 40] AS ws FROM w, unnest(range(0, (len(ws) + 39) // 40)) u(part)),
a AS MATERIALIZED (SELECT doc_id, part, h, ws, CASE h WHEN 0 THEN w3 WHEN 1 THEN w2 || ' ' || w3 WHEN 2 THEN 'zz 42 qq' WHEN 3 THEN w3 || 'xy' WHEN 4 THEN w2 || ' ' || w3 || 'xy'
  WHEN 5 THEN 'False' WHEN 6 THEN 'zwzwz kyky' WHEN 7 THEN 'w' WHEN 8 THEN '{_LONG}' || w3 ELSE '{_LONG}' || w2 || 'x' END AS answer FROM (SELECT doc_id, part, h, ws, coalesce(ws[2], ws[1]) AS w2, coalesce(ws[3], ws[2], ws[1]) AS w3 FROM im)),
n AS MATERIALIZED (SELECT doc_id, part, i, regexp_replace(lower(word), '[^\p{{L}}\p{{N}}_]+', '', 'g') AS norm, list_transform(regexp_extract_all(word, '[0-9]+(?:[.,][0-9]+)*'), lambda m: replace(m, ',', '')) AS numbers, 10 * ((i - 1) % 10) AS x0, 20 * ((i - 1) // 10) AS y0
  FROM (SELECT doc_id, part, i, CASE WHEN h IN (2, 5) AND i = 2 THEN 'room' WHEN h IN (2, 5) AND i = 3 THEN '42' ELSE ws[i] END AS word FROM a, unnest(range(1, len(ws) + 1)) t(i))),
s AS MATERIALIZED (SELECT doc_id, part, answer, regexp_replace(lower(answer), '[^\p{{L}}\p{{N}}_]+', '', 'g') AS said, list_filter(list_transform(regexp_extract_all(answer, '[0-9]+(?:[.,][0-9]+)*'), lambda m: replace(m, ',', '')), lambda m: length(m) >= 2) AS nums FROM a),
l AS (SELECT *, lead(norm, 1) OVER o AS n1, lead(norm, 2) OVER o AS n2, lead(norm, 3) OVER o AS n3, lead(norm, 4) OVER o AS n4, lead(numbers, 1) OVER o AS m1, lead(numbers, 2) OVER o AS m2, lead(numbers, 3) OVER o AS m3, lead(numbers, 4) OVER o AS m4 FROM n WINDOW o AS (PARTITION BY doc_id, part ORDER BY i)),
g AS MATERIALIZED (SELECT doc_id, part, i, k, CASE k WHEN 2 THEN norm || n1 WHEN 3 THEN norm || n1 || n2 WHEN 4 THEN norm || n1 || n2 || n3 ELSE norm || n1 || n2 || n3 || n4 END AS norm,
  flatten([numbers, m1, CASE WHEN k > 2 THEN m2 ELSE [] END, CASE WHEN k > 3 THEN m3 ELSE [] END, CASE WHEN k > 4 THEN m4 ELSE [] END]) AS numbers,
  CASE WHEN (i - 1) // 10 = (i + k - 2) // 10 THEN x0 ELSE 0 END AS x0, y0, CASE WHEN (i - 1) // 10 = (i + k - 2) // 10 THEN x0 + 10 * k - 2 ELSE 98 END AS x1, 20 * ((i + k - 2) // 10) + 12 AS y1
  FROM l, unnest(range(2, 6)) u(k) WHERE CASE k WHEN 2 THEN n1 WHEN 3 THEN n2 WHEN 4 THEN n3 ELSE n4 END IS NOT NULL),
exact AS (SELECT doc_id, part, min(x0) AS x0, min(y0) AS y0, max(x0 + 8) AS x1, max(y0 + 12) AS y1 FROM n JOIN s USING (doc_id, part) WHERE s.said = n.norm GROUP BY ALL),
phrase AS (SELECT g.* FROM g JOIN s USING (doc_id, part) WHERE s.said = g.norm QUALIFY row_number() OVER (PARTITION BY doc_id, part ORDER BY k DESC, i) = 1),
numeric AS (SELECT g.* FROM g JOIN s USING (doc_id, part) WHERE len(list_intersect(g.numbers, s.nums)) > 0 QUALIFY row_number() OVER (PARTITION BY doc_id, part ORDER BY k, i DESC) = 1),
found AS MATERIALIZED (SELECT s.doc_id, s.part, answer, said, nums, CASE WHEN length(said) < 2 THEN 'reject_short_answer' WHEN exact.x0 IS NOT NULL THEN 'exact_token' WHEN phrase.x0 IS NOT NULL THEN 'exact_phrase' WHEN numeric.x0 IS NOT NULL THEN 'numeric_phrase' END AS why,
""" + ",".join(f"CAST(CASE WHEN length(said) >= 2 THEN coalesce(exact.{c}, phrase.{c}, numeric.{c}) END AS INTEGER) AS {c}" for c in ("x0", "y0", "x1", "y1")) + " FROM s LEFT JOIN exact USING (doc_id, part) LEFT JOIN phrase USING (doc_id, part) LEFT JOIN numeric USING (doc_id, part))"

# DuckDB counts edits of bytes, so letters beyond ASCII become capitals, which normal forms lack.
_LETTERS = "àâäáãåçéèêëíìîïñóòôöõúùûüßœæÿ"
_BYTES = lambda x: f"translate({x}, '{_LETTERS}', 'ABCDEFGHIJKLMNOPQRSTUVWXYZ!#$%')"
_SIMILAR = lambda a, b: f"CASE WHEN length({a}) = 0 OR length({b}) = 0 THEN 0.0::DOUBLE ELSE 1 - levenshtein({_BYTES(a)}, {_BYTES(b)}) / greatest(length({a}), length({b})) END"
_KEYWORDS = lambda x, least: rf"list_filter(list_transform(string_split_regex(lower({x}), '[\s/:\-_,.;!?()\[\]{{}}]+'), lambda w: regexp_replace(w, '[^\p{{L}}\p{{N}}_]+', '', 'g')), lambda w: length(w) >= {least})"
_QUESTION = "is there a room 42 beside the grand hall or tower one"
_BOX4 = ("x0", "y0", "x1", "y1")
_ALL = (
    _TOKENS
    + rf""", open_ AS MATERIALIZED (SELECT doc_id, part, answer, said, nums FROM found WHERE why IS NULL),
parts AS (SELECT doc_id, part, length(said) AS size, list(DISTINCT substring(said, i, m)) AS subs, m FROM open_, unnest(range(1, length(said) + 1)) t(i), unnest(range(1, length(said) - i + 2)) u(m) GROUP BY doc_id, part, said, m),
common AS (SELECT g.doc_id, g.part, g.i, g.k, max(m) AS most FROM g JOIN parts p ON p.doc_id = g.doc_id AND p.part = g.part AND len(list_filter(p.subs, lambda x: contains(g.norm, x))) > 0 GROUP BY ALL),
scored AS (SELECT g.*, least(1.0::DOUBLE, 0.6::DOUBLE * (coalesce(most, 0) / length(said)) + (1 - 0.6::DOUBLE) * ({_SIMILAR("said", "norm")}) + CASE WHEN len(list_intersect(g.numbers, nums)) > 0 THEN 0.15::DOUBLE ELSE 0.0::DOUBLE END) AS score
  FROM g JOIN open_ USING (doc_id, part) LEFT JOIN common USING (doc_id, part, i, k) WHERE length(norm) > 0),
best AS MATERIALIZED (SELECT * FROM scored QUALIFY row_number() OVER (PARTITION BY doc_id, part ORDER BY score DESC, k DESC, i) = 1),
left_ AS MATERIALIZED (SELECT o.* FROM open_ o LEFT JOIN best b USING (doc_id, part) WHERE coalesce(b.score, -1) < 0.40::DOUBLE),
words AS MATERIALIZED (SELECT doc_id, part, 0 AS asked, ws[j] AS w, j FROM (SELECT *, {_KEYWORDS("answer", 2)} AS ws FROM left_), unnest(range(1, len(ws) + 1)) t(j)
  UNION ALL SELECT doc_id, part, 1, ws[j], j FROM (SELECT *, ({_KEYWORDS("'" + _QUESTION + "'", 3)})[1:6] AS ws FROM left_ WHERE said IN ('yes', 'no', 'true', 'false')), unnest(range(1, len(ws) + 1)) t(j)),
alike AS MATERIALIZED (SELECT w.doc_id, w.part, asked, j, w, {_SIMILAR("w", "norm")} AS sim, n.* EXCLUDE (doc_id, part), w = norm OR len(list_intersect(n.numbers, list_filter(list_transform(regexp_extract_all(w, '[0-9]+(?:[.,][0-9]+)*'), lambda m: replace(m, ',', '')), lambda m: length(replace(m, '.', '')) >= 2))) > 0 AS equal FROM words w JOIN n USING (doc_id, part)),
near AS (SELECT *, row_number() OVER (PARTITION BY doc_id, part, asked ORDER BY sim DESC, j) AS r FROM (SELECT * FROM (SELECT *, max(CAST(w = norm AS INTEGER)) OVER (PARTITION BY doc_id, part, asked, j) AS have FROM alike) WHERE have = 0 QUALIFY row_number() OVER (PARTITION BY doc_id, part, asked, j ORDER BY sim DESC, i) = 1)),
hit AS (SELECT doc_id, part, asked, min(x0) AS x0, min(y0) AS y0, max(x0 + 8) AS x1, max(y0 + 12) AS y1 FROM (SELECT doc_id, part, asked, x0, y0 FROM alike WHERE equal UNION ALL SELECT doc_id, part, asked, x0, y0 FROM near WHERE sim >= CASE asked WHEN 0 THEN 0.6::DOUBLE ELSE 0.75::DOUBLE END) GROUP BY ALL),
t AS (SELECT doc_id, part, sim, x0, y0, x0 + 8 AS x1, y0 + 12 AS y1 FROM near WHERE asked = 0 AND r = 1),
big AS (SELECT doc_id, part, min(x0) AS x0, min(y0) AS y0 FROM n WHERE i = 1 GROUP BY ALL)
SELECT f.doc_id, f.part, CASE WHEN f.why IS NOT NULL THEN f.why WHEN b.score >= 0.40::DOUBLE THEN 'fuzzy_phrase' WHEN h.x0 IS NOT NULL THEN 'per_word_collect' WHEN q.x0 IS NOT NULL THEN 'question_fallback' WHEN t.sim IS NOT NULL AND t.sim > coalesce(b.score, -1) THEN 'forced_best_token_fuzzy_best'
  WHEN b.score IS NOT NULL THEN 'forced_best_fuzzy_phrase_best' ELSE 'largest_box_fallback' END AS why,
  round(CASE WHEN f.why = 'reject_short_answer' THEN NULL WHEN f.why IS NOT NULL THEN 1.0 WHEN b.score >= 0.40::DOUBLE THEN b.score WHEN coalesce(h.x0, q.x0) IS NOT NULL THEN 1.0 WHEN t.sim IS NOT NULL AND t.sim > coalesce(b.score, -1) THEN t.sim WHEN b.score IS NOT NULL THEN b.score ELSE 0.0 END, 6) AS score,
"""
    + ",".join(
        f"CAST(CASE WHEN f.why IS NOT NULL THEN f.{c} WHEN b.score >= 0.40::DOUBLE THEN b.{c} WHEN h.x0 IS NOT NULL THEN h.{c} WHEN q.x0 IS NOT NULL THEN q.{c} WHEN t.sim IS NOT NULL AND t.sim > coalesce(b.score, -1) THEN t.{c} WHEN b.score IS NOT NULL THEN b.{c} ELSE {e} END AS INTEGER) AS {c}"
        for c, e in zip(_BOX4, ("big.x0", "big.y0", "big.x0 + 8", "big.y0 + 12"), strict=True)
    )
    + " FROM found f LEFT JOIN best b USING (doc_id, part) LEFT JOIN (SELECT * FROM hit WHERE asked = 0) h USING (doc_id, part) LEFT JOIN (SELECT * FROM hit WHERE asked = 1) q USING (doc_id, part) LEFT JOIN t USING (doc_id, part) LEFT JOIN big USING (doc_id, part)"
)


def _tokens(spark: SparkSession, sf: str) -> DataFrame:
    d = dealt(read(spark, sf, "documents").select("doc_id", "text")).select("doc_id", F.filter(F.split("text", r"\s+"), lambda w: w != "").alias("all")).where(F.size("all") > 0)
    images = F.transform(F.sequence(F.lit(0), F.floor((F.size("all") - 1) / 40).cast("int")), lambda k: F.slice("all", k * 40 + 1, F.lit(40)))
    d = d.select("doc_id", F.posexplode(images).alias("part", "ws")).withColumn("h", (F.col("doc_id") * 7 + F.col("part")) % 10)
    ws, h = F.col("ws"), F.col("h")
    second, third = F.coalesce(F.get(ws, 1), ws[0]), F.coalesce(F.get(ws, 2), F.get(ws, 1), ws[0])
    two = F.concat(second, F.lit(" "), third)
    answers = [third, two, F.lit("zz 42 qq"), F.concat(third, F.lit("xy")), F.concat(two, F.lit("xy")), F.lit("False"), F.lit("zwzwz kyky"), F.lit("w"), F.concat(F.lit(_LONG), third), F.concat(F.lit(_LONG), second, F.lit("x"))]
    d = d.withColumn("answer", F.coalesce(*[F.when(h == i, x) for i, x in enumerate(answers)]))

    places = F.array(*[G.rect(*[F.lit(v) for v in (10 * (i % 10), 20 * (i // 10), 10 * (i % 10) + 8, 20 * (i // 10) + 12)]) for i in range(40)])
    token = lambda word: lambda w, i: F.struct(word(w, i).alias("word"), F.get(places, i).alias("rect"))
    plain, room = token(lambda w, i: w), token(lambda w, i: F.when(i == 1, "room").when(i == 2, "42").otherwise(w))
    return d.select("doc_id", "part", "answer", F.when(h.isin(2, 5), F.transform("ws", room)).otherwise(F.transform("ws", plain)).alias("tokens"))


@R.query(_TOKENS + " SELECT doc_id, part, why, x0, y0, x1, y1 FROM found")
def ground_answer(spark: SparkSession, sf: str) -> DataFrame:
    """M05, tiers 0 to 3: where an answer stands among tokens."""
    g = grounding.exact_and_numeric(_tokens(spark, sf))
    return g.select("doc_id", "part", "match.why", "match.rect.*")


@R.query(_ALL)
def ground_answer_all(spark: SparkSession, sf: str) -> DataFrame:
    """The whole cascade."""
    g = grounding.grounded(_tokens(spark, sf).withColumn("question", F.lit(_QUESTION)), question="question")
    return g.select("doc_id", "part", "match.why", F.round("match.score", 6).alias("score"), "match.rect.*")


_FONTS, _FILLS, _PALETTE = ("fixed", "uniform_step", "uniform", "midpoint"), ("fixed", "palette", "auto"), ((255, 0, 0), (0, 128, 0), (0, 0, 255), (255, 255, 0))


def _images(spark: SparkSession, sf: str) -> DataFrame:
    """Ten boxes of parts are an image's; its number chooses the rules of font, colour and place."""
    b = _boxes(spark, sf).groupBy(F.floor(F.col("p_partkey") / 10).alias("image")).agg(F.array_sort(F.collect_list("r")).alias("forbidden"))
    fixed = {"w": 640, "h": 480, "font_low": 20, "font_high": 29, "font_step": 3, "unit_w": 2.1, "unit_h": 0.7, "min_px": 14, "max_retry": 200, "margin": 8}
    chosen = lambda options, by: F.element_at(F.array(*map(F.lit, options)), (by % len(options) + 1).cast("int"))
    image, colour = F.col("image"), lambda c: F.array(*map(F.lit, c))
    rules = {"mode": chosen(("near", "mid", "far", "random"), image), "font_rule": chosen(_FONTS, F.floor(image / 4)), "fill_rule": chosen(_FILLS, image), "fill": colour((1, 2, 3)), "palette": F.array(*map(colour, _PALETTE)), "luminance": image * 37 % 256}
    seed = placement.pattern_seed(image.cast("string"), F.lit("val"), F.lit("p"), F.lit("r"))
    return b.select("image", *[F.lit(v).alias(k) for k, v in fixed.items()], "forbidden", F.col("forbidden")[0].alias("answer_rect"), seed.alias("seed"), *[c.alias(k) for k, c in rules.items()])


_UNIT = lambda *parts: f"(CAST(('0x' || substring(md5(concat_ws('-', {', '.join(parts)})), 1, 8)) AS BIGINT) / 4294967296.0::DOUBLE)"
_FAR = lambda a: _corner_sql().replace("a.", f"{a}.").replace("b.", "i.")
_FREE = lambda a: f"{a}.x0 >= 8 AND {a}.y0 >= 8 AND {a}.x1 <= 632 AND {a}.y1 <= 472 AND NOT EXISTS (SELECT 1 FROM f WHERE f.image = {a}.image AND {a}.x0 < f.x1 AND f.x0 < {a}.x1 AND {a}.y0 < f.y1 AND f.y0 < {a}.y1)"
_PLACEMENTS = (
    _BOX
    + f""", f AS MATERIALIZED (SELECT p_partkey // 10 AS image, x0, y0, x1, y1 FROM p),
o AS (SELECT *, (x0 + x1) // 2 AS cx, (y0 + y1) // 2 AS cy FROM f QUALIFY row_number() OVER (PARTITION BY image ORDER BY x0, y0, x1, y1) = 1),
d AS (SELECT *, CAST(('0x' || substring(md5(concat_ws('__', CAST(image AS VARCHAR), 'val', 'p', 'r')), 9, 8)) AS BIGINT) & 2147483647 AS seed, list_extract(['near', 'mid', 'far', 'random'], 1 + image % 4) AS mode FROM o),
i AS MATERIALIZED (SELECT *, CASE (image // 4) % 4 WHEN 0 THEN 20 WHEN 1 THEN 20 + CAST(floor({_UNIT("seed", "'font'")} * 4) AS INTEGER) * 3 WHEN 2 THEN 20 + CAST(floor({_UNIT("seed", "'font'")} * 10) AS INTEGER) ELSE 24 END AS px,
  CASE image % 3 WHEN 0 THEN '1,2,3' WHEN 1 THEN list_extract(['255,0,0', '0,128,0', '0,0,255', '255,255,0'], 1 + CAST(floor({_UNIT("seed", "'fill'")} * 4) AS INTEGER)) ELSE CASE WHEN image * 37 % 256 < 128 THEN '255,255,255' ELSE '0,0,0' END END AS colour FROM d),
z AS MATERIALIZED (SELECT image, px AS full_px, u AS px, CAST(ceil(ceil(2.1::DOUBLE * px) * u / px) AS INTEGER) AS tw, CAST(ceil(ceil(0.7::DOUBLE * px) * u / px) AS INTEGER) AS th FROM i, unnest(range(0, 8)) k(k), unnest([px - 2 * k]) v(u) WHERE u >= 14 AND mode <> 'random'),
g AS (SELECT k % 11 AS gx, k // 11 AS gy, 8 + 56 * (k % 11) AS cx0, 8 + 42 * (k // 11) AS cy0 FROM unnest(range(0, 121)) t(k)),
c AS (SELECT z.*, gx || '-' || gy AS code, cx0, cy0, least(cx0 + 2, greatest(cx0, cx0 + 56 - tw)) AS x0, least(cy0 + 2, greatest(cy0, cy0 + 42 - th)) AS y0 FROM z CROSS JOIN g JOIN i ON i.image = z.image WHERE NOT (i.cx >= cx0 AND i.cx < cx0 + 56 AND i.cy >= cy0 AND i.cy < cy0 + 42)),
e AS MATERIALIZED (SELECT *, x0 + tw AS x1, y0 + th AS y1 FROM c),
free AS MATERIALIZED (SELECT e.*, i.mode, i.seed, {_FAR("e")} AS far FROM e JOIN i ON i.image = e.image WHERE {_FREE("e")} QUALIFY e.px = max(e.px) OVER (PARTITION BY e.image)),
cuts AS (SELECT image, count(*) AS n, list(far ORDER BY far) AS v FROM free GROUP BY image),
ends AS (SELECT image, v[1] AS low, v[1 + CAST(round_even((1 / 3.0::DOUBLE) * (n - 1), 0) AS INTEGER)] AS first, v[1 + CAST(round_even((2 / 3.0::DOUBLE) * (n - 1), 0) AS INTEGER)] AS second, v[n] AS high FROM cuts),
m AS (SELECT free.*, b, CASE mode WHEN 'far' THEN list_position(['far', 'mid', 'near'], b) WHEN 'mid' THEN list_position(['mid', 'far', 'near'], b) ELSE list_position(['near', 'mid', 'far'], b) END AS pref FROM free JOIN ends USING (image), unnest(['near', 'mid', 'far']) t(b)
  WHERE (b = 'near' AND far BETWEEN low AND first) OR (b = 'mid' AND far BETWEEN first AND second) OR (b = 'far' AND far BETWEEN second AND high)),
best AS MATERIALIZED (SELECT * FROM (SELECT * FROM m QUALIFY pref = min(pref) OVER (PARTITION BY image)) QUALIFY row_number() OVER (PARTITION BY image ORDER BY md5(concat_ws('-', seed, code))) = 1),
t AS (SELECT best.* EXCLUDE (x0, y0, x1, y1), k, cx0 + CAST(floor({_UNIT("seed", "'cell x'", "code", "k")} * (greatest(0, 56 - tw) + 1)) AS INTEGER) AS x0, cy0 + CAST(floor({_UNIT("seed", "'cell y'", "code", "k")} * (greatest(0, 42 - th) + 1)) AS INTEGER) AS y0 FROM best, unnest(range(1, 21)) s(k)),
t2 AS (SELECT *, x0 + tw AS x1, y0 + th AS y1 FROM t),
spot AS (SELECT * FROM t2 WHERE {_FREE("t2")} QUALIFY row_number() OVER (PARTITION BY image ORDER BY k) = 1),
by_cell AS (SELECT best.image, best.code, best.b AS reason, best.px, coalesce(spot.x0, best.x0) AS x0, coalesce(spot.y0, best.y0) AS y0, coalesce(spot.x1, best.x1) AS x1, coalesce(spot.y1, best.y1) AS y1 FROM best LEFT JOIN spot ON spot.image = best.image),
lost AS (SELECT image, 'TL' AS code, 'forced' AS reason, 14 AS px, 8 AS x0, 8 AS y0, 8 + CAST(ceil(ceil(2.1::DOUBLE * px) * 14 / px) AS INTEGER) AS x1, 8 + CAST(ceil(ceil(0.7::DOUBLE * px) * 14 / px) AS INTEGER) AS y1 FROM i WHERE mode <> 'random' AND image NOT IN (SELECT image FROM best)),
w AS (SELECT image, seed, px, CAST(ceil(2.1::DOUBLE * px) AS INTEGER) AS tw, CAST(ceil(0.7::DOUBLE * px) AS INTEGER) AS th FROM i WHERE mode = 'random'),
rnd AS (SELECT w.*, k, 8 + CAST(floor({_UNIT("seed", "'x'", "k")} * greatest(1, 640 - 16 - tw + 1)) AS INTEGER) AS x0, 8 + CAST(floor({_UNIT("seed", "'y'", "k")} * greatest(1, 480 - 16 - th + 1)) AS INTEGER) AS y0 FROM w, unnest(range(1, 201)) s(k)),
r2 AS (SELECT *, x0 + tw AS x1, y0 + th AS y1 FROM rnd), hit AS (SELECT * FROM r2 WHERE {_FREE("r2")} QUALIFY row_number() OVER (PARTITION BY image ORDER BY k) = 1),
loose AS (SELECT w.image, 'random' AS code, CASE WHEN hit.x0 IS NULL THEN 'forced' ELSE 'random' END AS reason, w.px, coalesce(hit.x0, 8) AS x0, coalesce(hit.y0, 8) AS y0, coalesce(hit.x1, 8 + w.tw) AS x1, coalesce(hit.y1, 8 + w.th) AS y1 FROM w LEFT JOIN hit ON hit.image = w.image),
u AS (SELECT * FROM by_cell UNION ALL SELECT * FROM lost UNION ALL SELECT * FROM loose)
SELECT u.image, i.mode, u.code, u.reason, round({_FAR("u")}, 9) AS distance, CAST(u.px AS INTEGER) AS used_px, i.colour, CAST(u.x0 AS INTEGER) AS x0, CAST(u.y0 AS INTEGER) AS y0, CAST(u.x1 AS INTEGER) AS x1, CAST(u.y1 AS INTEGER) AS y1 FROM u JOIN i ON i.image = u.image"""
)


@R.query(_PLACEMENTS)
def placements(spark: SparkSession, sf: str) -> DataFrame:
    """A text's font, colour and place, by distance from the answer or anywhere."""
    p = placement.patterned(dealt(_images(spark, sf)))
    return p.select("image", "mode", "placement.code", "placement.reason", F.round("placement.distance", 9).alias("distance"), "placement.used_px", F.array_join("colour", ",").alias("colour"), "placement.rect.*")


@R.query(
    _BOX
    + """SELECT p_partkey, CAST(floor(floor((x0 - 0) * (512.0 / 640)) / 4) AS INTEGER) AS l, CAST(floor(floor(y0 * (512.0 / 480)) / 4) AS INTEGER) AS t, CAST(floor(floor(x1 * (512.0 / 640)) / 4) AS INTEGER) AS r, CAST(floor(floor(y1 * (512.0 / 480)) / 4) AS INTEGER) AS b FROM p"""
)
def canvas_rects(spark: SparkSession, sf: str) -> DataFrame:
    """Boxes on a square canvas."""
    region = G.rect(F.lit(0), F.lit(0), F.lit(640), F.lit(480))
    c = _boxes(spark, sf).select("p_partkey", G.canvas_rect(F.col("r"), region).alias("c"))
    return c.select("p_partkey", F.col("c.x0").alias("l"), F.col("c.y0").alias("t"), F.col("c.x1").alias("r"), F.col("c.y1").alias("b"))


QUERIES, ORACLE_SQL = R.queries, R.sql
