"""Hierarchies and labels: the closure of part types, brands and names; labels of orders with hashed scores; distractors."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

from veritab.functions.textnorm import hash_unit
from veritab.operators import hierarchy as H
from veritab.operators import labels as L
from veritab.operators import negatives as N
from veritab.operators import sampling as S
from veritab.plans.tables import Registry, read
from veritab.sources.readers import dealt

R = Registry()


def _edges(spark: SparkSession, sf: str) -> DataFrame:
    """Entity above types, types above brands, brands above names."""
    p = read(spark, sf, "part")
    pairs = [(F.lit("Entity"), "p_type"), ("p_type", "p_brand"), ("p_brand", "p_name")]
    return p.select(F.explode(F.array(*[F.struct((F.col(a) if isinstance(a, str) else a).alias("parent"), F.col(b).alias("child")) for a, b in pairs])).alias("e")).select("e.*").where("parent IS NOT NULL AND child IS NOT NULL").distinct()


_EDGES = """edges AS (SELECT DISTINCT 'Entity' AS parent, p_type AS child FROM part UNION SELECT DISTINCT p_type, p_brand FROM part UNION SELECT DISTINCT p_brand, p_name FROM part)"""
_CLOSURE = (
    f"WITH RECURSIVE {_EDGES},"
    + """
at(label, depth, ancestor) AS (SELECT DISTINCT parent, 1, parent FROM edges WHERE parent NOT IN (SELECT child FROM edges)
  UNION SELECT * FROM (SELECT child, depth, ancestor FROM at JOIN edges ON parent = label UNION ALL SELECT child, depth + 1, child FROM at JOIN edges ON parent = label WHERE label = ancestor)),
closed AS (SELECT label, depth, ancestor FROM at WHERE label <> ancestor)"""
).replace("at(label", "reach(label").replace("FROM at ", "FROM reach ")


@R.query(f"WITH {_EDGES} SELECT parent, child FROM edges")
def hierarchy_edges(spark: SparkSession, sf: str) -> DataFrame:
    """H01, H10."""
    return _edges(spark, sf)


@R.query(_CLOSURE + " SELECT label, depth, ancestor FROM closed")
def hierarchy_closure(spark: SparkSession, sf: str) -> DataFrame:
    """H01, H02, H05."""
    return H.closure_of_edges(_edges(spark, sf))


@R.query(_CLOSURE + ", n AS (SELECT child AS label FROM edges UNION SELECT parent FROM edges) SELECT n.label, CAST(coalesce(1 + max(depth), 1) AS INTEGER) AS node_depth FROM n LEFT JOIN closed ON closed.label = n.label GROUP BY n.label")
def hierarchy_depth(spark: SparkSession, sf: str) -> DataFrame:
    """H04."""
    e = _edges(spark, sf)
    return H.depths(e.select(F.col("child").alias("label")).union(e.select("parent")), H.closure_of_edges(e))


@R.query(f"WITH {_EDGES} SELECT DISTINCT parent AS label FROM edges WHERE parent NOT IN (SELECT child FROM edges)")
def hierarchy_roots(spark: SparkSession, sf: str) -> DataFrame:
    """H08."""
    return H.roots(_edges(spark, sf))


@R.query(f"WITH RECURSIVE {_EDGES}, d(label, descendant) AS (SELECT parent, child FROM edges UNION SELECT label, child FROM d JOIN edges ON parent = descendant) SELECT label, count(*) AS n FROM d GROUP BY label")
def hierarchy_descendants(spark: SparkSession, sf: str) -> DataFrame:
    """H03."""
    return H.descendants(_edges(spark, sf)).groupBy("label").agg(F.count("*").alias("n"))


@R.query(_CLOSURE + " SELECT count(*) AS n, count(DISTINCT label) AS labels FROM (SELECT DISTINCT label FROM closed WHERE depth = 1 AND ancestor = 'Entity')")
def labels_under_root(spark: SparkSession, sf: str) -> DataFrame:
    """F05."""
    e = _edges(spark, sf)
    names = e.select(F.col("child").alias("label")).union(e.select("parent")).distinct()
    return H.under_root(names, H.closure_of_edges(e), "Entity").agg(F.count("*").alias("n"), F.countDistinct("label").alias("labels"))


@R.query(_CLOSURE + " SELECT DISTINCT label, ancestor AS branch FROM closed WHERE depth = 2")
def hierarchy_branches(spark: SparkSession, sf: str) -> DataFrame:
    """H09."""
    e = _edges(spark, sf)
    return H.top_branches(e.select(F.col("child").alias("label")).distinct(), H.closure_of_edges(e))


_TREES = """trees AS (SELECT DISTINCT p_type, p_brand, p_name FROM part WHERE p_type IS NOT NULL)"""


@R.query(
    f"""WITH {_TREES}, c AS (SELECT p_brand AS label, 1 AS depth, p_type AS ancestor FROM trees UNION SELECT p_name, 1, p_type FROM trees UNION SELECT p_name, 2, p_brand FROM trees)
SELECT label, depth, ancestor FROM c"""
)
def nested_tree_closure(spark: SparkSession, sf: str) -> DataFrame:
    """A JSON tree of brands and names below each type of part, as rows of text, and the closure along their paths."""
    p = read(spark, sf, "part").where("p_type IS NOT NULL").select("p_type", "p_brand", "p_name").distinct()
    leaf = F.struct(F.col("p_name").alias("name"))
    brands = p.groupBy("p_type", "p_brand").agg(F.collect_list(leaf).alias("children")).groupBy("p_type").agg(F.collect_list(F.struct(F.col("p_brand").alias("name"), "children")).alias("children"))
    return H.closure(H.nodes_of(spark, brands.select(F.to_json(F.struct(F.col("p_type").alias("name"), "children")).alias("value"))))


# Each order's labels: the name of each part with an even key, else its brand or its type; the score of a label comes from a hash.
_SETS = """,
sets AS (SELECT DISTINCT l_orderkey AS o, CASE WHEN l_partkey % 2 = 0 THEN p_name WHEN l_partkey % 3 = 0 THEN p_type ELSE p_brand END AS label FROM lineitem JOIN part ON p_partkey = l_partkey),
scores AS (SELECT DISTINCT o, label, CAST(('0x' || substring(md5(concat_ws('-', 's', CAST(o AS VARCHAR), label)), 1, 8)) AS BIGINT) / 4294967296.0 AS score FROM
  (SELECT o, label FROM sets UNION SELECT l_orderkey, p_name FROM lineitem JOIN part ON p_partkey = l_partkey))
"""


def _lines(spark: SparkSession, sf: str) -> DataFrame:
    parts = read(spark, sf, "part").select("p_partkey", "p_name", "p_type", "p_brand")
    return dealt(read(spark, sf, "lineitem").select(F.col("l_orderkey").alias("o"), "l_partkey")).join(parts, F.col("l_partkey") == F.col("p_partkey"))


def _label() -> Column:
    return F.when(F.col("l_partkey") % 2 == 0, F.col("p_name")).when(F.col("l_partkey") % 3 == 0, F.col("p_type")).otherwise(F.col("p_brand"))


def _labels(lines: DataFrame) -> DataFrame:
    """Each order's labels, some of them repeated."""
    return lines.select("o", _label().alias("label"))


def _scores(lines: DataFrame, repeated: bool = False) -> DataFrame:
    every = lines.select("o", F.explode(F.array_distinct(F.array(_label(), "p_name"))).alias("label"))
    return (every if repeated else every.distinct()).withColumn("score", hash_unit(F.lit("s"), F.col("o").cast("string"), F.col("label")))


_PRUNED = ", leaf AS (SELECT o, label FROM sets s WHERE NOT EXISTS (SELECT 1 FROM sets t JOIN closed c ON c.label = t.label WHERE t.o = s.o AND c.ancestor = s.label))"


@R.query(_CLOSURE + _SETS + _PRUNED + " SELECT o, label FROM leaf")
def prune_pseudo_leaves(spark: SparkSession, sf: str) -> DataFrame:
    """H06, H07, J12."""
    return H.pseudo_leaves(_labels(_lines(spark, sf)), H.closure_of_edges(_edges(spark, sf)), "o")


_ORDERED = """, ordered AS (SELECT l_orderkey AS o, list(CASE WHEN l_partkey % 2 = 0 THEN p_name WHEN l_partkey % 3 = 0 THEN p_type ELSE p_brand END ORDER BY l_linenumber, l_partkey) AS labels
  FROM lineitem JOIN part ON p_partkey = l_partkey GROUP BY l_orderkey)"""


@R.query(
    _CLOSURE
    + _SETS.rstrip()
    + _ORDERED
    + """, above AS (SELECT DISTINCT sets.o, ancestor FROM sets JOIN closed ON closed.label = sets.label),
up AS (SELECT o, list(ancestor) AS up FROM above GROUP BY o), k AS (SELECT o, labels, list_filter(labels, lambda x: NOT coalesce(list_contains(up, x), false)) AS kept FROM ordered LEFT JOIN up USING (o))
SELECT o, array_to_string(CASE WHEN len(kept) > 0 THEN kept ELSE labels END, '|') AS labels FROM k"""
)
def leaves_in_order(spark: SparkSession, sf: str) -> DataFrame:
    """Each order's labels in the order of its lines, repeats and all, without those above another."""
    parts = read(spark, sf, "part").select("p_partkey", "p_name", "p_type", "p_brand")
    lines = dealt(read(spark, sf, "lineitem").select(F.col("l_orderkey").alias("o"), "l_linenumber", "l_partkey")).join(parts, F.col("l_partkey") == F.col("p_partkey"))
    listed = lines.groupBy("o").agg(F.transform(F.array_sort(F.collect_list(F.struct("l_linenumber", "l_partkey", _label().alias("label")))), lambda x: x["label"]).alias("labels"))
    return H.leaves_of_array(listed, "labels", H.ancestry(H.closure_of_edges(_edges(spark, sf)))).select("o", F.array_join("labels", "|").alias("labels"))


@R.query(_CLOSURE + _SETS + " SELECT o, label, score FROM scores QUALIFY row_number() OVER (PARTITION BY o ORDER BY score DESC, label) = 1")
def best_labels(spark: SparkSession, sf: str) -> DataFrame:
    """A01."""
    return L.best_label(_scores(_lines(spark, sf)), "o")


@R.query(_CLOSURE + _SETS + ", r AS (SELECT *, row_number() OVER (PARTITION BY o ORDER BY score DESC, label) AS k FROM scores) SELECT o, string_agg(label, '|' ORDER BY label) AS labels, count(*) AS n FROM r WHERE k = 1 OR score >= 0.2 GROUP BY o")
def filtered_truth(spark: SparkSession, sf: str) -> DataFrame:
    """labels with a score of 0.2 at least, and the best."""
    f = L.above_and_best(_scores(_lines(spark, sf)), "o")
    return f.select("o", F.array_join("labels", "|").alias("labels"), F.size("labels").cast("long").alias("n"))


@R.query(_CLOSURE + _SETS + ", r AS (SELECT *, row_number() OVER (PARTITION BY o ORDER BY score DESC, label) AS k, max(score) OVER (PARTITION BY o) AS m FROM scores) SELECT o, string_agg(label, '|' ORDER BY score DESC, label) AS labels FROM r WHERE score >= 0.9 OR (m < 0.9 AND k = 1) GROUP BY o")
def threshold_or_best(spark: SparkSession, sf: str) -> DataFrame:
    """Labels with a score of 0.9 at least, or else the best, by score."""
    pairs = F.collect_list(F.struct((-F.col("score")).alias("far"), "label"))
    ordered = _scores(_lines(spark, sf)).groupBy("o").agg(F.transform(F.array_sort(pairs), lambda r: F.struct(r["label"], (-r["far"]).alias("score"))).alias("s"))
    return ordered.select("o", F.array_join(F.transform(L.above_or_best(F.col("s"), 0.9), lambda r: r["label"]), "|").alias("labels"))


_TRUTH = (
    _PRUNED.replace("sets s", "truth s").replace("sets t", "truth t")
    + """, d AS (SELECT label, max(depth) + 1 AS node_depth FROM closed GROUP BY label),
ranked AS (SELECT s.o, s.label, s.score, CASE WHEN leaf.label IS NOT NULL AND node_depth >= 3 THEN 1 WHEN leaf.label IS NOT NULL THEN 2 WHEN s.label IN (SELECT label FROM closed WHERE depth = 1 AND ancestor = 'Entity') THEN 3 ELSE 4 END AS tier
  FROM scores s LEFT JOIN leaf ON leaf.o = s.o AND leaf.label = s.label LEFT JOIN d ON d.label = s.label)
SELECT o, label AS y_true, score, CASE tier WHEN 1 THEN 'picked_depth>=3' WHEN 2 THEN 'picked_depth<=2' ELSE CASE WHEN o IN (SELECT o FROM truth) THEN 'fallback_any' ELSE 'fallback_gt_empty' END END AS reason
FROM ranked QUALIFY row_number() OVER (PARTITION BY o ORDER BY tier, score DESC, label) = 1"""
)


@R.query(_CLOSURE + _SETS.rstrip() + ", truth AS (SELECT o, label FROM sets WHERE o % 5 <> 0)" + _TRUTH)
def select_truth(spark: SparkSession, sf: str) -> DataFrame:
    """Orders whose key 5 divides have no truth."""
    lines = _lines(spark, sf)
    return L.true_label(_scores(lines, repeated=True), _labels(lines).where("o % 5 <> 0"), H.closure_of_edges(_edges(spark, sf)), "o")


@R.query(_CLOSURE + _SETS + _PRUNED + " SELECT o, string_agg(label, '|' ORDER BY score DESC, label) AS labels FROM leaf JOIN scores USING (o, label) WHERE score >= 0.5 GROUP BY o")
def oe_labels(spark: SparkSession, sf: str) -> DataFrame:
    """The pruned truth with a score of a half at least, by score."""
    lines = _lines(spark, sf)
    found, _ = L.open_labels(_scores(lines, repeated=True).where("score >= 0.5"), _labels(lines), H.closure_of_edges(_edges(spark, sf)), "o")
    pairs = F.array_sort(F.collect_list(F.struct((-F.col("score")).alias("far"), "label")))
    return found.groupBy("o").agg(F.array_join(F.transform(pairs, lambda r: r["label"]), "|").alias("labels"))


_POOLS = (
    _CLOSURE
    + """, dd(label, descendant) AS (SELECT parent, child FROM edges UNION SELECT label, child FROM dd JOIN edges ON parent = descendant),
v AS (SELECT DISTINCT p_name AS label FROM part), top AS (SELECT label AS y, max(depth) AS l FROM closed WHERE depth > 1 GROUP BY label),
pair AS (SELECT v.label AS y, w.label AS x, coalesce(l, 2) AS l FROM v JOIN v w ON v.label <> w.label LEFT JOIN top ON top.y = v.label
  WHERE NOT EXISTS (SELECT 1 FROM closed c WHERE c.label = v.label AND c.ancestor = w.label) AND NOT EXISTS (SELECT 1 FROM dd WHERE dd.label = v.label AND dd.descendant = w.label)),
share AS (SELECT DISTINCT a.label AS y, b.label AS x, a.depth FROM closed a JOIN closed b ON a.depth = b.depth AND a.ancestor = b.ancestor WHERE a.label IN (SELECT label FROM v) AND b.label IN (SELECT label FROM v)),
band AS (SELECT pair.y, pair.x, bool_or(coalesce(depth = l, false)) AS hard, bool_or(coalesce(depth = greatest(2, l - 1), false)) AS m, bool_or(coalesce(depth = greatest(2, l - 2), false)) AS e FROM pair LEFT JOIN share USING (y, x) GROUP BY pair.y, pair.x)
"""
)


@R.query(_POOLS + "SELECT y AS y_true, CAST(count(*) FILTER (WHERE hard) AS INTEGER) AS hard, CAST(count(*) FILTER (WHERE m AND NOT hard) AS INTEGER) AS medium, CAST(count(*) FILTER (WHERE e AND NOT m AND NOT hard) AS INTEGER) AS easy, CAST(count(*) AS INTEGER) AS base FROM band GROUP BY y")
def distractor_pool_sizes(spark: SparkSession, sf: str) -> DataFrame:
    """How many distractors of each band a name has."""
    p = _pools(spark, sf)
    return p.select("y_true", *[F.size(n).alias(n) for n in ("hard", "medium", "easy", "base")])


def _pools(spark: SparkSession, sf: str) -> DataFrame:
    e = _edges(spark, sf)
    names = read(spark, sf, "part").select(F.col("p_name").alias("label")).distinct()
    closed = H.closure_of_edges(e)
    # Only names can be distractors, so only their ancestors matter to the bands.
    return S.distractor_pools(names, closed.join(names, "label", "left_semi"), H.descendants(e))


@R.query(
    _POOLS
    + """, q AS (SELECT o_orderkey AS o, (SELECT list(label ORDER BY label) FROM v)[1 + o_orderkey % (SELECT count(*) FROM v)] AS y FROM orders),
r AS (SELECT o, q.y, x, hard, m, e, md5(concat_ws('-', '42', CAST(o AS VARCHAR), x)) AS h FROM q JOIN band ON band.y = q.y),
a AS (SELECT o, y, arg_min(x, (CASE WHEN hard THEN '0' WHEN m THEN '1' ELSE '2' END) || h) AS hard FROM r GROUP BY o, y),
b AS (SELECT r.o, r.y, a.hard, arg_min(x, (CASE WHEN m AND NOT r.hard THEN '0' WHEN e AND NOT m AND NOT r.hard THEN '1' ELSE '2' END) || h) AS medium FROM r JOIN a ON a.o = r.o WHERE x <> a.hard GROUP BY r.o, r.y, a.hard)
SELECT b.o, b.y AS y_true, b.hard, b.medium, arg_min(x, (CASE WHEN e AND NOT m AND NOT r.hard THEN '0' ELSE '2' END) || h) AS easy FROM r JOIN b ON b.o = r.o WHERE x NOT IN (b.hard, b.medium) GROUP BY b.o, b.y, b.hard, b.medium"""
)
def sample_negatives_md5(spark: SparkSession, sf: str) -> DataFrame:
    """A hard, a medium and an easy distractor for every order."""
    vocabulary = read(spark, sf, "part").agg(F.array_sort(F.collect_set("p_name")).alias("v"))
    q = dealt(read(spark, sf, "orders").select(F.col("o_orderkey").alias("o"))).crossJoin(F.broadcast(vocabulary))
    q = q.select("o", F.element_at("v", (F.col("o") % F.size("v") + 1).cast("int")).alias("y_true"))
    return S.distractors(q, _pools(spark, sf), "o").select("o", "y_true", "hard", "medium", "easy")


_PART = """part_ AS (SELECT 'part-' || p_partkey AS x, p_type AS t, p_type || '/' || p_brand AS b, p_type || '/' || p_brand || '/' || p_name AS n FROM part WHERE p_type IS NOT NULL AND p_brand IS NOT NULL AND p_name IS NOT NULL)"""


@R.query(
    f"""WITH {_PART},
posting AS (SELECT 'hard' AS band, '4/' || n AS node, x FROM part_ UNION ALL SELECT 'medium', '3/' || b, x FROM part_ UNION ALL SELECT 'easy', '2/' || t, x FROM part_ UNION ALL SELECT 'base', 'root', x FROM part_),
size AS (SELECT node, (count(*) + 15) // 16 AS chunks FROM posting GROUP BY node),
entry AS (SELECT band, node, x, chunks, CAST('0x' || substring(md5(x), 1, 8) AS BIGINT) % chunks AS chunk FROM posting JOIN size USING (node)),
q AS (SELECT l_orderkey AS o, 'part-' || arg_min(l_partkey, (l_linenumber, l_partkey)) AS y, list(DISTINCT 'part-' || l_partkey) AS ex FROM lineitem GROUP BY l_orderkey),
reads AS (SELECT o, y, ex, ['hard', 'medium', 'easy', 'base'][k] AS band, ['4/' || n, '3/' || b, '2/' || t, 'root'][k] AS node, t, b, n FROM q JOIN part_ ON x = y, unnest(range(1, 5)) u(k)),
first AS (SELECT r.o, r.y, r.band, e.x, CAST(((e.chunk - CAST('0x' || substring(md5(concat_ws('-', '42', CAST(r.o AS VARCHAR), r.node)), 1, 8) AS BIGINT) % e.chunks) % e.chunks + e.chunks) % e.chunks AS BIGINT) AS step,
  md5(concat_ws('-', '42', CAST(r.o AS VARCHAR), e.x)) AS h FROM reads r JOIN entry e ON e.band = r.band AND e.node = r.node JOIN part_ p ON p.x = e.x
  WHERE r.band <> 'base' AND NOT list_contains(r.ex, e.x) AND (r.band = 'hard' OR (p.n <> r.n AND (r.band = 'medium' OR p.b <> r.b)))),
enough AS (SELECT o FROM first GROUP BY o HAVING count(*) FILTER (WHERE band <> 'easy') >= 1 AND count(*) FILTER (WHERE band = 'easy') >= 3),
more AS (SELECT r.o, r.y, r.band, e.x, CAST(((e.chunk - CAST('0x' || substring(md5(concat_ws('-', '42', CAST(r.o AS VARCHAR), r.node)), 1, 8) AS BIGINT) % e.chunks) % e.chunks + e.chunks) % e.chunks AS BIGINT) AS step,
  md5(concat_ws('-', '42', CAST(r.o AS VARCHAR), e.x)) AS h FROM reads r JOIN entry e ON e.band = r.band AND e.node = r.node WHERE r.band = 'base' AND NOT list_contains(r.ex, e.x) AND r.o NOT IN (SELECT o FROM enough)),
"""
    + """c AS MATERIALIZED (SELECT *, lpad(CAST(step AS VARCHAR), 9, '0') || h AS r FROM (SELECT * FROM first UNION ALL SELECT * FROM more)),
h AS (SELECT o, arg_min(x, CASE band WHEN 'hard' THEN '0' WHEN 'medium' THEN '1' ELSE '2' END || r) AS hard FROM c WHERE band <> 'easy' GROUP BY o),
m AS (SELECT c.o, arg_min(x, CASE band WHEN 'medium' THEN '0' WHEN 'easy' THEN '1' ELSE '2' END || r) AS medium FROM c JOIN h USING (o) WHERE band <> 'hard' AND x <> hard GROUP BY c.o),
e AS (SELECT c.o, arg_min(x, CASE band WHEN 'easy' THEN '0' ELSE '2' END || r) AS easy FROM c JOIN h USING (o) JOIN m USING (o) WHERE band IN ('easy', 'base') AND x <> hard AND x <> medium GROUP BY c.o)
SELECT q.o, q.y AS y_true, coalesce(hard, y) AS hard, coalesce(medium, y) AS medium, coalesce(easy, y) AS easy FROM q LEFT JOIN h USING (o) LEFT JOIN m USING (o) LEFT JOIN e USING (o)"""
)
def sample_negatives_indexed(spark: SparkSession, sf: str) -> DataFrame:
    """Three other parts for the first of every order, none of the order's own; parts stand below their names, brands and types, each within the one above."""
    p = read(spark, sf, "part").where("p_type IS NOT NULL AND p_brand IS NOT NULL AND p_name IS NOT NULL")
    path = [F.lit("Entity"), F.col("p_type"), F.concat_ws("/", "p_type", "p_brand"), F.concat_ws("/", "p_type", "p_brand", "p_name"), F.concat(F.lit("part-"), F.col("p_partkey").cast("string"))]
    edges = p.select(F.explode(F.array(*[F.struct(a.alias("parent"), b.alias("child")) for a, b in zip(path, path[1:])])).alias("e")).select("e.*").distinct()
    names = p.select(path[-1].alias("label"))
    index = N.label_index(names, H.closure_of_edges(edges).join(names, "label", "left_semi"))
    part = F.concat(F.lit("part-"), F.col("l_partkey").cast("string"))
    lines = dealt(read(spark, sf, "lineitem").select(F.col("l_orderkey").alias("o"), "l_linenumber", "l_partkey"))
    q = lines.groupBy("o").agg(F.min_by(part, F.struct("l_linenumber", "l_partkey")).alias("y_true"), F.sort_array(F.collect_set(part)).alias("own"))
    return N.indexed_distractors(q, index, "o", excluded="own").select("o", "y_true", *N.BANDS)


QUERIES, ORACLE_SQL = R.queries, R.sql
