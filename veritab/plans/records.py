"""Readers and writers, model stages, masks, regions and small records over the driver's tables."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from veritab.functions import geometry as G
from veritab.functions import masks, parsing, prompts, textnorm, vectors
from veritab.operators import chat as C
from veritab.operators import hierarchy as H
from veritab.operators import models
from veritab.operators import placement as P
from veritab.operators import sampling as S
from veritab.operators.checkpoints import folder
from veritab.plans.hierarchies import _CLOSURE, _EDGES, _edges
from veritab.plans.placing import _BOX, _boxes
from veritab.plans.scoring import _SIMS, _ranked
from veritab.plans.tables import Registry, read
from veritab.sources import images, readers, writers
from veritab.sources.readers import dealt

R = Registry()


@R.query("SELECT r_name AS split, CASE WHEN n_nationkey % 2 = 0 THEN 'even' ELSE 'odd' END AS kind, n_nationkey, n_name FROM nation JOIN region ON r_regionkey = n_regionkey")
def partitioned_tables(spark: SparkSession, sf: str) -> DataFrame:
    """Tables in folders by split and kind, written once, found by name under a data root and read with the folders' names."""
    root, n = folder(spark), read(spark, sf, "nation").join(F.broadcast(read(spark, sf, "region")), F.col("r_regionkey") == F.col("n_regionkey"))
    for split in sorted(r.r_name for r in read(spark, sf, "region").select("r_name").collect()):  # five regions
        for kind, odd in (("even", 0), ("odd", 1)):
            own = n.where((F.col("r_name") == split) & (F.col("n_nationkey") % 2 == odd)).select("n_nationkey", "n_name")
            writers.table(own, f"{root}/sets/{split}/{kind}")
            writers.table(own.limit(0), f"{root}/sets/{split}/{kind}")  # is there already, so nothing changes
    path = readers.resolve(spark, "sets", root)
    return readers.partitioned(spark, f"{path}/*/*").select("split", "kind", "n_nationkey", "n_name")


@R.query("SELECT 'document' AS kind, CAST(c_custkey AS BIGINT) AS id, c_name AS name FROM customer UNION ALL SELECT 'lines', s_suppkey, s_name FROM supplier UNION ALL SELECT 'keys', CAST(n_nationkey AS BIGINT), n_name FROM nation")
def json_documents(spark: SparkSession, sf: str) -> DataFrame:
    """A whole array, JSON lines and an object keyed by ids, told apart by extension."""
    root = folder(spark)
    c = read(spark, sf, "customer").select(F.col("c_custkey").alias("id"), F.col("c_name").alias("name"))
    # One array is one line of text: as in the sets that are read so, it fits a row.
    c.agg(F.to_json(F.sort_array(F.collect_list(F.struct("id", "name")))).alias("value")).write.text(f"{root}/array.json")
    read(spark, sf, "supplier").select(F.col("s_suppkey").alias("id"), F.col("s_name").alias("name")).write.json(f"{root}/rows.jsonl")
    read(spark, sf, "nation").agg(F.to_json(F.map_from_entries(F.collect_list(F.struct(F.col("n_nationkey").cast("string"), F.struct(F.col("n_name").alias("name"))))))).write.text(f"{root}/keys.json")
    row = "id long, name string"
    document, lines = (readers.json_or_lines(spark, f"{root}/{p}", row) for p in ("array.json", "rows.jsonl"))
    keyed = readers.json_by_key(spark, f"{root}/keys.json", "struct<name:string>").select(F.lit("keys").alias("kind"), F.col("key").alias("id"), "value.name")
    return document.select(F.lit("document").alias("kind"), "id", "name").unionByName(lines.select(F.lit("lines").alias("kind"), "id", "name")).unionByName(keyed)


@R.query(
    """WITH r AS (SELECT o_orderkey AS sample_idx, o_orderstatus = 'F' AS is_correct FROM orders)
SELECT 'records' AS part, CAST(sample_idx AS VARCHAR) AS name, CAST(is_correct AS DOUBLE) AS value FROM r UNION ALL SELECT 'metrics', 'accuracy', round(avg(CAST(is_correct AS DOUBLE)), 9) FROM r UNION ALL SELECT 'metrics', 'total_samples', count(*) FROM r
UNION ALL SELECT 'config', 'seed', 42"""
)
def result_sink(spark: SparkSession, sf: str) -> DataFrame:
    """Records with their metrics beside them and the run's settings, written and read again."""
    root = folder(spark)
    r = read(spark, sf, "orders").select(F.col("o_orderkey").alias("sample_idx"), (F.col("o_orderstatus") == "F").alias("is_correct"))
    writers.results(r, r.agg(F.round(F.avg(F.col("is_correct").cast("double")), 9).alias("accuracy")), root)
    writers.run_config(spark, {"seed": 42}, f"{root}/config")
    part = lambda kind, df, name, value: df.select(F.lit(kind).alias("part"), name.alias("name"), value.cast("double").alias("value"))
    records = part("records", spark.read.schema("sample_idx long, is_correct boolean").json(f"{root}/records"), F.col("sample_idx").cast("string"), F.col("is_correct").cast("int"))
    m = spark.read.schema("accuracy double, total_samples long").json(f"{root}/metrics")
    config = spark.read.schema("seed int").json(f"{root}/config")
    return records.unionByName(part("metrics", m, F.lit("accuracy"), F.col("accuracy"))).unionByName(part("metrics", m, F.lit("total_samples"), F.col("total_samples"))).unionByName(part("config", config, F.lit("seed"), F.col("seed")))


@R.query(
    """WITH d AS (SELECT doc_id, text, CASE WHEN doc_id % 11 = 0 THEN 'idx_' || doc_id WHEN doc_id % 3 = 0 THEN 'img/' || (doc_id // 4) || '.PNG' ELSE 'img' || (doc_id // 4) END AS image_id FROM documents WHERE text IS NOT NULL),
r AS (SELECT *, replace(CASE WHEN image_id LIKE '%.PNG' THEN image_id ELSE image_id || '.jpg' END, '/', '%2F') AS name, md5(text) AS h FROM d),
f AS (SELECT name, arg_min(h, doc_id) AS file, count(*) AS n, string_agg(CAST(doc_id AS VARCHAR) || ':' || image_id, ',' ORDER BY doc_id) AS records FROM r GROUP BY name) SELECT name, file, n, records FROM f"""
)
def exported_images(spark: SparkSession, sf: str) -> DataFrame:
    """The bytes of documents stand for images, up to four rows an image; files and records are written and read again."""
    d = dealt(read(spark, sf, "documents").select(F.col("doc_id").alias("row_no"), "text")).withColumn("k", F.floor(F.col("row_no") / 4).cast("string"))
    name = F.when(F.col("row_no") % 11 == 0, F.lit(None)).when(F.col("row_no") % 3 == 0, F.concat(F.lit("img/"), "k", F.lit(".PNG"))).otherwise(F.concat(F.lit("img"), "k"))
    path = folder(spark)
    images.export_images(d.select("row_no", F.encode("text", "utf-8").alias("image"), name.alias("image_id")), path)
    files = spark.read.format("binaryFile").load(f"{path}/images").where("NOT startswith(element_at(split(path, '/'), -1), '_')")
    files = files.select(F.element_at(F.split("path", "/"), -1).alias("_f"), F.md5("content").alias("file"))
    records = spark.read.schema("image string, image_id string, row_no long").json(f"{path}/records")
    listed = records.groupBy("image").agg(F.count("*").alias("n"), F.array_join(F.transform(F.array_sort(F.collect_list(F.struct("row_no", "image_id"))), lambda r: F.concat_ws(":", r["row_no"].cast("string"), r["image_id"])), ",").alias("records"))
    return listed.join(files, F.col("image") == F.col("_f")).select(F.col("image").alias("name"), "file", "n", "records")


@R.query("SELECT event_id % 500 AS sample_idx, max_by(event_type, event_id) AS response, count(*) AS n FROM events GROUP BY 1")
def appended_log(spark: SparkSession, sf: str) -> DataFrame:
    """A log that two appends make; the last record of each sample counts."""
    path = f"{folder(spark)}/log"
    e = read(spark, sf, "events").select((F.col("event_id") % 500).alias("sample_idx"), F.col("event_id").alias("line_no"), F.array("event_type").alias("responses"))
    writers.append_log(e.where("line_no % 2 = 0"), path)
    writers.append_log(e.where("line_no % 2 = 1"), path)
    lines = spark.read.text(path).withColumn("line_no", F.get_json_object("value", "$.line_no").cast("long"))
    parsed = readers.parsed_log(lines)
    n = parsed.groupBy("sample_idx").agg(F.count("*").alias("n"))
    return readers.latest(parsed).join(n, "sample_idx").select("sample_idx", parsing.last_turn(F.col("responses")).alias("response"), "n")


@R.query(_CLOSURE + " SELECT ancestor, count(*) AS n, max(depth) AS deepest FROM closed GROUP BY ancestor")
def closure_saved(spark: SparkSession, sf: str) -> DataFrame:
    """A closure kept as a table and read again."""
    path = f"{folder(spark)}/closure"
    H.save_closure(H.closure_of_edges(_edges(spark, sf)), path)
    return H.saved_closure(spark, path).groupBy("ancestor").agg(F.count("*").alias("n"), F.max("depth").alias("deepest"))


@R.query(
    f"WITH RECURSIVE {_EDGES}, t(label, path, depth) AS (SELECT DISTINCT parent, parent, 0 FROM edges WHERE parent NOT IN (SELECT child FROM edges) UNION ALL SELECT child, path || '/' || child, depth + 1 FROM t JOIN edges ON parent = label) SELECT path, repeat('  ', depth) || label AS line FROM t"
)
def tree_listing(spark: SparkSession, sf: str) -> DataFrame:
    """The forest as indented lines, siblings by name."""
    return H.tree_lines(_edges(spark, sf)).select(F.array_join("path", "/").alias("path"), "line")


@R.query("SELECT line_no, value AS line FROM (SELECT row_number() OVER (ORDER BY path) - 1 AS line_no, line AS value FROM (SELECT ['Entity'] AS path, 'Entity' AS line UNION ALL SELECT DISTINCT ['Entity', p_type], '  ' || p_type FROM part))")
def tree_file(spark: SparkSession, sf: str) -> DataFrame:
    """The upper tree as one text file, read again in its order."""
    path = f"{folder(spark)}/tree"
    writers.tree_text(H.tree_lines(_edges(spark, sf).where("parent = 'Entity'")), path)
    whole = spark.read.text(f"{path}/part-*", wholetext=True).select(F.posexplode(F.split(F.regexp_replace("value", "\n$", ""), "\n")).alias("line_no", "line"))
    return whole.select(F.col("line_no").cast("long").alias("line_no"), "line")


def _reversed():
    """A stand-in for a model: it turns prompts around."""
    return lambda prompts_: ["".join(reversed(p if isinstance(p, str) else "|".join(p))) for p in prompts_]


@R.query("SELECT p_partkey, reverse(p_name) AS response FROM part")
def model_responses(spark: SparkSession, sf: str) -> DataFrame:
    """A model chosen by name answers in batches, with a time limit and retries."""
    models.register("reversed", _reversed)
    asked = read(spark, sf, "part").select("p_partkey", "p_name")
    return models.generated(asked, models.adapter("org/Reversed-7B".lower()), "p_name", retries=1, timeout=60.0).select("p_partkey", "response")


@R.query("SELECT p_partkey, CASE WHEN p_partkey % 3 = 0 THEN NULL ELSE upper(p_name) END AS response, CASE WHEN p_partkey % 3 = 0 THEN 'ValueError' END AS why FROM part")
def model_failures(spark: SparkSession, sf: str) -> DataFrame:
    """Batches that keep failing give nulls and the kind of error."""

    def fussy():
        def answer(asked: list) -> list:
            if any(int(a.partition(":")[0]) % 3 == 0 for a in asked):
                raise ValueError("not this one")
            return [a.partition(":")[2].upper() for a in asked]

        return answer

    asked = read(spark, sf, "part").select("p_partkey", F.concat_ws(":", "p_partkey", "p_name").alias("prompt"))
    return models.generated(asked, fussy, "prompt", batch=1, retries=2, reason="why").select("p_partkey", "response", "why")


@R.query("SELECT p_partkey, CASE WHEN p_partkey % 4 = 3 THEN 2 ELSE p_partkey % 4 END AS retry_count, p_partkey % 4 <> 3 AS valid FROM part")
def model_retries(spark: SparkSession, sf: str) -> DataFrame:
    """Invalid answers are asked again, twice at most. The stand-in answers as well as its prompt's number of tries lets it."""
    asked = read(spark, sf, "part").select("p_partkey", F.concat_ws(":", F.col("p_partkey") % 4, "p_name").alias("prompt"))

    def slow():
        return lambda own: [f"{p[0]}!" for p in own]

    # A prompt that begins with k needs k tries; the third try is the last.
    valid = F.substring("response", 1, 1).cast("int") <= F.col("retry_count")
    return models.with_retries(asked, slow, "prompt", valid, "p_partkey").select("p_partkey", F.col("retry_count").cast("long").alias("retry_count"), valid.alias("valid"))


@R.query("WITH t AS (SELECT conv_id, string_agg(text, '|' ORDER BY turn) AS said, count(*) AS n FROM conversations WHERE role = 'user' GROUP BY conv_id) SELECT conv_id, n, substring(said, 1, 1) AS first_letter FROM t")
def model_turns(spark: SparkSession, sf: str) -> DataFrame:
    """User turns asked in order, each with all before it; the stand-in turns what it is given around, so the last letter of each answer is the first of the conversation."""
    c = read(spark, sf, "conversations").where("role = 'user'").groupBy("conv_id").agg(F.array_sort(F.collect_list(F.struct("turn", "text"))).alias("t"))
    said = models.multi_turn(c.select("conv_id", F.transform("t", lambda x: x["text"]).alias("turns")), _reversed)
    last = F.element_at("responses", -1)
    return said.select("conv_id", F.size("responses").cast("long").alias("n"), F.substring(last, -1, 1).alias("first_letter"))


_ENSEMBLE = ", ".join("'" + t.replace("'", "''") + "'" for t in prompts.ENSEMBLE)


@R.query(
    f"""WITH l AS (SELECT DISTINCT replace(p_name, ' ', '_') AS label FROM part), p AS (SELECT label, replace(t, '{{}}', replace(label, '_', ' ')) AS prompt FROM l, unnest([{_ENSEMBLE}]) u(t)),
v AS (SELECT label, prompt, length(prompt) / sqrt(length(prompt) * length(prompt) + 1.0) AS x FROM p) SELECT label, count(*) AS n, md5(string_agg(prompt, '|' ORDER BY prompt)) AS prompts, round(avg(x), 9) AS mean FROM v GROUP BY label"""
)
def label_ensemble(spark: SparkSession, sf: str) -> DataFrame:
    """Labels in eighty templates, encoded in chunks, and the mean of their unit vectors; the stand-in encodes a text as its length and one."""
    labels = read(spark, sf, "part").select(F.replace("p_name", F.lit(" "), F.lit("_")).alias("label")).distinct()
    asked = labels.withColumn("prompts", prompts.label_prompts(F.col("label"), prompts.ENSEMBLE))

    def lengths():
        return lambda texts: [[float(len(t)), 1.0] for t in texts]

    done = models.encoded(asked, lengths, "prompts")
    mean = F.aggregate("vectors", F.lit(0.0), lambda s, v: s + v[0]) / F.size("vectors")
    return done.select("label", F.size("prompts").cast("long").alias("n"), F.md5(F.array_join(F.array_sort("prompts"), "|")).alias("prompts"), F.round(mean, 9).alias("mean"))


@R.query(_SIMS + " SELECT vec_id, c, round(sim, 6) AS sim, k FROM r")
def class_similarities(spark: SparkSession, sf: str) -> DataFrame:
    """Each vector against every class, a row for each rank."""
    flat = _ranked(spark, sf, (1 << 31) - 1).select("vec_id", F.posexplode("top").alias("k", "r"))
    return flat.select("vec_id", F.col("r.label").alias("c"), F.round(-F.col("r.far"), 6).alias("sim"), (F.col("k") + 1).cast("long").alias("k"))


_JUDGED = """WITH q AS (SELECT event_id, CASE event_id % 3 WHEN 0 THEN 'typo_base_color' WHEN 1 THEN 'vqav2' ELSE 'LingoQA' END AS dataset, event_type,
CASE event_id % 5 WHEN 0 THEN 'a' WHEN 1 THEN 'b)' WHEN 2 THEN 'a ' || event_type || ' it is' WHEN 3 THEN 'View' ELSE 'blue' END AS answer,
CASE WHEN event_id % 3 = 0 THEN CASE WHEN event_id % 2 = 0 THEN 'a' ELSE 'b' END ELSE event_type END AS correct, value / 100 AS score FROM events)
SELECT event_id, CASE dataset WHEN 'vqav2' THEN contains(lower(answer), lower(correct)) WHEN 'LingoQA' THEN score > 0.5
  ELSE CASE correct WHEN 'a' THEN answer = 'a' OR contains(answer, 'a)') OR contains(answer, event_type) ELSE answer = 'b' OR contains(answer, 'b)') OR contains(answer, 'blue') END END AS is_right FROM q"""


@R.query(_JUDGED)
def judged_answers(spark: SparkSession, sf: str) -> DataFrame:
    """Answers judged by the rule of their dataset."""
    k = F.col("event_id")
    pick = lambda by, *xs: F.coalesce(*[F.when(k % by == i, x) for i, x in enumerate(xs)])
    dataset = pick(3, F.lit("typo_base_color"), F.lit("vqav2"), F.lit("LingoQA"))
    answer = pick(5, F.lit("a"), F.lit("b)"), F.concat(F.lit("a "), "event_type", F.lit(" it is")), F.lit("View"), F.lit("blue"))
    correct = F.when(k % 3 == 0, F.when(k % 2 == 0, "a").otherwise("b")).otherwise(F.col("event_type"))
    question = F.concat(F.lit("What is it? (a) "), "event_type", F.lit(" (b) Blue (c)"))
    return read(spark, sf, "events").select("event_id", parsing.judged(answer, correct, question, dataset, F.col("value") / 100).alias("is_right"))


@R.query("WITH f AS (SELECT s_suppkey, replace(s_name, '#', '-') || CASE s_suppkey % 4 WHEN 0 THEN '.jpg' WHEN 1 THEN '.jpeg' WHEN 2 THEN '.png' ELSE '.txt' END AS file FROM supplier) SELECT s_suppkey, regexp_replace(file, '\\.(jpg|jpeg|png)', '', 'g') AS stem FROM f")
def file_stems(spark: SparkSession, sf: str) -> DataFrame:
    """N24."""
    k = F.col("s_suppkey") % 4
    file = F.concat(F.replace("s_name", F.lit("#"), F.lit("-")), F.when(k == 0, ".jpg").when(k == 1, ".jpeg").when(k == 2, ".png").otherwise(".txt"))
    return read(spark, sf, "supplier").select("s_suppkey", textnorm.without_image_extension(file).alias("stem"))


@R.query("SELECT o_orderkey AS sample_idx, CASE WHEN o_orderkey % 2 = 0 THEN o_orderpriority || '|' || o_orderstatus ELSE o_orderstatus END AS answers, CASE WHEN o_orderkey % 2 = 0 THEN 2 ELSE 1 END AS n FROM orders")
def task_rows(spark: SparkSession, sf: str) -> DataFrame:
    """Rows in the columns of their task; one answer stands for a list of one."""
    o = read(spark, sf, "orders").select(F.col("o_orderkey").alias("sample_idx"), F.col("o_orderkey").alias("question_id"), F.col("o_custkey").alias("image_id"), F.lit("which?").alias("question"), "o_orderpriority", F.col("o_orderstatus").alias("answer"))
    many = C.evaluation_rows(o.where("sample_idx % 2 = 0").withColumn("answers", F.array("o_orderpriority", "answer")).drop("answer"), "txt_oe")
    one = C.evaluation_rows(o.where("sample_idx % 2 = 1"), "txt_oe")
    return C.union(many, one).select("sample_idx", F.array_join("answers", "|").alias("answers"), F.size("answers").alias("n"))


@R.query("SELECT p_partkey, 'Say a wrong word.' || chr(10) || 'Q: hue?' || chr(10) || 'A: red' || chr(10) || chr(10) || 'Q: ' || p_name || '?' || chr(10) || 'A: ' || p_type AS prompt FROM part")
def few_shot_prompts(spark: SparkSession, sf: str) -> DataFrame:
    """P21."""
    prompt = prompts.few_shot("Say a wrong word.", [("Q: hue?", "A: red")], F.concat(F.lit("Q: "), "p_name", F.lit("?")), F.concat(F.lit("A: "), "p_type"))
    return read(spark, sf, "part").select("p_partkey", prompt.alias("prompt"))


@R.query(_BOX + "SELECT x0, y0, x1, y1, min(p_partkey) AS p_partkey FROM p GROUP BY x0, y0, x1, y1")
def unique_rects(spark: SparkSession, sf: str) -> DataFrame:
    """The first of boxes that are equal."""
    return S.first_per_key(_boxes(spark, sf).select("p_partkey", "r"), "r", "p_partkey").select("r.*", "p_partkey")


@R.query(
    _BOX
    + """, c AS (SELECT p_partkey, (x0 + x1) // 2 AS cx, (y0 + y1) // 2 AS cy FROM p), g AS (SELECT *, (cx - 8) // 56 AS gx, (cy - 8) // 42 AS gy FROM c)
SELECT p_partkey, CAST(cx AS INTEGER) AS cx, CAST(cy AS INTEGER) AS cy, CASE WHEN cx >= 8 AND cy >= 8 AND gx < 11 AND gy < 11 THEN gx || '-' || gy END AS cell FROM g"""
)
def rect_centres(spark: SparkSession, sf: str) -> DataFrame:
    """Middles, and the grid's cells that hold them."""
    cells = G.grid_cells(F.lit(640), F.lit(480), F.lit(8), 11)
    x, y = G.centre(F.col("r"))
    return _boxes(spark, sf).select("p_partkey", x.alias("cx"), y.alias("cy"), G.cell_of(cells, F.col("r")).alias("cell"))


@R.query(
    _BOX
    + """, a AS (SELECT p_partkey, x0, y0, x1, y1, CAST(x1 - x0 AS DOUBLE) AS rw, CAST(y1 - y0 AS DOUBLE) AS rh, (10 + p_partkey % 7) / CAST(20 + p_partkey % 90 AS DOUBLE) AS aspect FROM p),
s AS (SELECT *, CASE WHEN aspect > rh / rw THEN rh / aspect ELSE rw END AS sw, CASE WHEN aspect > rh / rw THEN rh ELSE rw * aspect END AS sh FROM a WHERE rw > 0)
SELECT p_partkey, CASE WHEN abs(rh / rw - aspect) > 0.1 THEN CAST(trunc(x0 + (rw - sw) / 2) AS INTEGER) ELSE x0 END AS x0, CASE WHEN abs(rh / rw - aspect) > 0.1 THEN CAST(trunc(y0 + (rh - sh) / 2) AS INTEGER) ELSE y0 END AS y0,
CASE WHEN abs(rh / rw - aspect) > 0.1 THEN CAST(trunc(x0 + (rw - sw) / 2 + sw) AS INTEGER) ELSE x1 END AS x1, CASE WHEN abs(rh / rw - aspect) > 0.1 THEN CAST(trunc(y0 + (rh - sh) / 2 + sh) AS INTEGER) ELSE y1 END AS y1 FROM s"""
)
def text_regions(spark: SparkSession, sf: str) -> DataFrame:
    """The part of each box with a text's proportions."""
    r = G.text_region(F.col("r"), (F.col("p_partkey") % 90 + 20).cast("double"), (F.col("p_partkey") % 7 + 10).cast("double"))
    return _boxes(spark, sf).select("p_partkey", r.alias("t")).where("t IS NOT NULL").select("p_partkey", "t.*")


@R.query(
    _BOX
    + """, a AS (SELECT p_partkey, (x0 + x1) // 2 AS cx, (y0 + y1) // 2 AS cy, CAST(floor(greatest(x1 - x0, y1 - y0) * 2.0 / 2) AS BIGINT) AS half FROM p),
cut AS (SELECT p_partkey, greatest(cx - half, 0) AS l, least(cx + half, 640) AS r, greatest(cy - half, 0) AS t, least(cy + half, 480) AS b FROM a),
c AS (SELECT *, greatest(r - l, b - t) AS side, (greatest(r - l, b - t) - (r - l)) / 2.0::DOUBLE AS mx, (greatest(r - l, b - t) - (b - t)) / 2.0::DOUBLE AS my FROM cut),
d AS (SELECT p_partkey, side, CASE WHEN l - mx < 0 THEN 0.0 WHEN r + mx > 640 THEN 640 - side ELSE l - mx END AS x, CASE WHEN t - my < 0 THEN 0.0 WHEN b + my > 480 THEN 480 - side ELSE t - my END AS y FROM c)
SELECT p_partkey, CAST(trunc(x) AS INTEGER) AS x0, CAST(trunc(y) AS INTEGER) AS y0, CAST(trunc(x + side) AS INTEGER) AS x1, CAST(trunc(y + side) AS INTEGER) AS y1 FROM d"""
)
def square_regions(spark: SparkSession, sf: str) -> DataFrame:
    """Squares around boxes, moved inside the image."""
    return _boxes(spark, sf).select("p_partkey", G.square_region(F.col("r"), F.lit(640), F.lit(480)).alias("s")).select("p_partkey", "s.*")


@R.query(
    _BOX
    + """SELECT p_partkey, ' l' || x0 // 5 || ' t' || y0 // 5 || ' r' || x1 // 5 || ' b' || y1 // 5 || ' ' || '[A] [' || p_partkey % 10 || ']' || ' <|endoftext|>' AS prompt FROM p"""
)
def layout_prompts(spark: SparkSession, sf: str) -> DataFrame:
    """Boxes and letters as layout tokens."""
    r = F.col("r")
    small = G.rect(*[F.floor(r[c] / 5).cast("int") for c in ("x0", "y0", "x1", "y1")])
    return _boxes(spark, sf).select("p_partkey", G.layout_prompt(small, F.concat(F.lit("A"), (F.col("p_partkey") % 10).cast("string"))).alias("prompt"))


@R.query(
    _BOX
    + """, d AS (SELECT p_partkey, 'forbidden' AS kind, '135,206,250' AS colour, x0, y0, x1, y1 FROM p WHERE x1 > x0 AND y1 > y0 UNION ALL
SELECT p_partkey, 'attack', '255,0,0', x0 - greatest(1, CAST(round_even((x1 - x0) * 0.1::DOUBLE, 0) AS INTEGER)), y0 - greatest(1, CAST(round_even((y1 - y0) * 0.3::DOUBLE, 0) AS INTEGER)), x1 + greatest(1, CAST(round_even((x1 - x0) * 0.1::DOUBLE, 0) AS INTEGER)), y1 + greatest(1, CAST(round_even((y1 - y0) * 0.3::DOUBLE, 0) AS INTEGER)) FROM p WHERE x1 > x0 AND y1 > y0)
SELECT p_partkey, kind, colour, CAST(x0 AS INTEGER) AS x0, CAST(y0 AS INTEGER) AS y0, CAST(x1 AS INTEGER) AS x1, CAST(y1 AS INTEGER) AS y1 FROM d"""
)
def debug_boxes(spark: SparkSession, sf: str) -> DataFrame:
    """The boxes of a check as rows with their colours."""
    b = _boxes(spark, sf).select(*P.debug_rects([F.col("p_partkey")], {"forbidden": F.array("r"), "attack": F.array("r")}))
    return b.select("p_partkey", "kind", "colour", "rect.*")


# Masks of eight by six cells, one for each size of a part; boxes of 80 by 60 pixels.
_MASKS = """WITH s AS (SELECT DISTINCT p_size AS k FROM part), c AS (SELECT k, i % 8 AS x, i // 8 AS y, (k * 13 + i * 7 + (i // 8) * 5 + (i % 8) * (k % 3)) % 9 < 6 AS on_ FROM s, unnest(range(0, 48)) t(i)),
b AS (SELECT k, k % 30 AS x0, k % 20 AS y0, k % 30 + 17 AS x1, k % 20 + 12 AS y1 FROM s),
cleared AS (SELECT c.k, x, y, on_, on_ AND NOT (x >= floor(x0 * 0.1::DOUBLE) AND x < ceil(x1 * 0.1::DOUBLE) AND y >= floor(y0 * 0.1::DOUBLE) AND y < ceil(y1 * 0.1::DOUBLE)) AS left_ FROM c JOIN b ON b.k = c.k),
wide AS (SELECT k, x, y, w, h FROM s, unnest(range(0, 8)) a(x), unnest(range(0, 6)) d(y), unnest(range(1, 9)) e(w), unnest(range(1, 7)) f(h) WHERE w > h AND x + w <= 8 AND y + h <= 6),
whole AS (SELECT wide.k, wide.x, wide.y, w, h FROM wide JOIN cleared m ON m.k = wide.k AND m.x >= wide.x AND m.x < wide.x + w AND m.y >= wide.y AND m.y < wide.y + h GROUP BY ALL HAVING bool_and(left_)),
best AS (SELECT * FROM whole QUALIFY row_number() OVER (PARTITION BY k ORDER BY w * h DESC, y + h, x + w, h) = 1),
n AS (SELECT k, count(*) FILTER (WHERE left_) AS n, bool_or(on_ AND NOT left_) AS meets FROM cleared GROUP BY k)
"""


def _mask_rows(spark: SparkSession, sf: str) -> DataFrame:
    k = F.col("k")
    one = lambda i: (k * 13 + i * 7 + F.floor(i / 8).cast("int") * 5 + (i % 8) * (k % 3)) % 9 < 6
    s = read(spark, sf, "part").select(F.col("p_size").alias("k")).distinct()
    return s.select("k", F.transform(F.sequence(F.lit(0), F.lit(47)), one).alias("mask"), F.lit(8).alias("cols"), F.lit(80).alias("w"), F.lit(60).alias("h"), G.rect(k % 30, k % 20, k % 30 + 17, k % 20 + 12).alias("box"))


@R.query(_MASKS + "SELECT n.k, CAST(coalesce(x, 0) AS INTEGER) AS x, CAST(coalesce(y, 0) AS INTEGER) AS y, CAST(coalesce(w, 0) AS INTEGER) AS w, CAST(coalesce(h, 0) AS INTEGER) AS h, n, meets FROM n LEFT JOIN best ON best.k = n.k")
def mask_rectangles(spark: SparkSession, sf: str) -> DataFrame:
    """Masks without a box, the largest wide rectangle that is left, and whether the box meets the mask."""
    m = _mask_rows(spark, sf)
    left = masks.without_rects(F.col("mask"), F.col("cols"), F.array("box"), F.col("w"), F.col("h"))
    m = m.withColumn("meets", masks.mask_meets_rect(F.col("mask"), F.col("cols"), F.col("box"), F.col("w"), F.col("h"))).withColumn("left", left)
    m = m.withColumn("best", masks.largest_wide_rectangle(F.col("left"), F.col("cols")))
    return m.select("k", "best.*", F.size(F.filter("left", lambda c: c)).cast("long").alias("n"), "meets")


# Characters of documents as masks of 80 by 50 cells, 4,000 a mask, spaces and two letters unset; a box of each is cleared.
@R.query(
    """WITH i AS (SELECT doc_id, part, substring(text, CAST(4000 * part + 1 AS BIGINT), 4000) AS s, (doc_id * 13 + part * 7) % 200 AS bx, (doc_id * 5 + part) % 150 AS bv FROM documents, unnest(range(0, (length(text) + 3999) // 4000)) u(part)),
c AS MATERIALIZED (SELECT doc_id, part, p % 80 AS x, p // 80 AS y, p < length(s) AND NOT contains(' en', substring(s, CAST(p + 1 AS BIGINT), 1)) AS on_,
  x >= floor(bx * 0.25::DOUBLE) AND x < ceil((bx + 90) * 0.25::DOUBLE) AND y >= floor(bv * 0.25::DOUBLE) AND y < ceil((bv + 30) * 0.25::DOUBLE) AS box FROM i, unnest(range(0, 80 * ((length(s) + 79) // 80))) t(p)),
gaps AS (SELECT *, sum(CAST(NOT (on_ AND NOT box) AS INTEGER)) OVER (PARTITION BY doc_id, part, x ORDER BY y) AS g FROM c),
up AS (SELECT doc_id, part, x, y, row_number() OVER (PARTITION BY doc_id, part, x, g ORDER BY y) - CASE WHEN g = 0 THEN 0 ELSE 1 END AS up FROM gaps),
lev AS (SELECT doc_id, part, x, y, k, x - row_number() OVER (PARTITION BY doc_id, part, y, k ORDER BY x) AS island FROM up, unnest(range(1, up + 1)) t(k)),
run AS (SELECT doc_id, part, y, k, min(x) AS x, count(*) AS w FROM lev GROUP BY doc_id, part, y, k, island HAVING count(*) > k),
best AS (SELECT * FROM run QUALIFY row_number() OVER (PARTITION BY doc_id, part ORDER BY w * k DESC, y, x + w, k) = 1),
n AS (SELECT doc_id, part, count(*) FILTER (WHERE on_ AND NOT box) AS n, bool_or(on_ AND box) AS meets FROM c GROUP BY ALL)
SELECT doc_id, CAST(part AS INTEGER) AS part, CAST(coalesce(x, 0) AS INTEGER) AS x, CAST(coalesce(y - k + 1, 0) AS INTEGER) AS y, CAST(coalesce(w, 0) AS INTEGER) AS w, CAST(coalesce(k, 0) AS INTEGER) AS h, n, meets FROM n LEFT JOIN best USING (doc_id, part)"""
)
def text_masks(spark: SparkSession, sf: str) -> DataFrame:
    """The largest wide rectangle of every document's masks, of up to 4,000 cells, without a box."""
    d = dealt(read(spark, sf, "documents").select("doc_id", "text")).where(F.length("text") > 0)
    d = d.select("doc_id", "text", F.explode(F.sequence(F.lit(0), F.floor((F.length("text") - 1) / 4000).cast("int"))).alias("part"))
    d = d.withColumn("s", F.substring(F.col("text"), F.col("part") * 4000 + 1, F.lit(4000))).withColumn("length", F.length("s"))
    chars = F.split(F.rpad("s", F.ceil(F.col("length") / 80).cast("int") * 80, " "), "")
    m = d.select("doc_id", "part", F.transform(chars, lambda c: ~c.isin(" ", "e", "n")).alias("mask"), F.lit(80).alias("cols"), (F.col("doc_id") * 13 + F.col("part") * 7).alias("bx"), (F.col("doc_id") * 5 + F.col("part")).alias("by"))
    x, y = (F.col("bx") % 200).cast("int"), (F.col("by") % 150).cast("int")
    m = m.withColumns({"box": G.rect(x, y, x + 90, y + 30), "w": F.lit(320), "h": (F.size("mask") / 80 * 4).cast("int")})
    own = [F.col(c) for c in ("mask", "cols", "box", "w", "h")]
    m = m.withColumns({"meets": masks.mask_meets_rect(*own), "left": masks.without_rects(own[0], own[1], F.array("box"), *own[3:])})
    return m.select("doc_id", "part", masks.largest_wide_rectangle(F.col("left"), F.col("cols")).alias("best"), F.size(F.filter("left", lambda c: c)).cast("long").alias("n"), "meets").select("doc_id", "part", "best.*", "n", "meets")


@R.query()
def staged_placements(spark: SparkSession, sf: str) -> DataFrame:
    """Places by the staged search; tests hold them against its rules one by one."""
    m = _mask_rows(spark, sf)
    size = lambda px: F.array(F.lit(2.0) * px, F.lit(0.7) * px)
    other = F.transform("mask", lambda c, i: c & (i % 3 > 0))
    m = m.withColumns({"masks": F.array("mask", other), "position": F.col("k") % 4, "preferred": F.when(F.col("k") % 5 == 0, G.rect(F.lit(4), F.lit(4), F.lit(40), F.lit(16))), "forbidden": F.array("box")})
    m = m.withColumns({"avoid": F.when(F.col("k") % 2 == 0, G.rect(F.lit(30), F.lit(20), F.lit(45), F.lit(35))), "distance": (F.col("k") % 4 * 12).cast("double"), "sizes": F.array(*[size(px) for px in (20, 18, 16, 14, 12)])})
    return P.staged_places(m).select("k", "place.*")


@R.query(
    """SELECT o_orderkey, CASE o_orderkey % 4 WHEN 0 THEN o_orderstatus WHEN 1 THEN o_orderstatus END AS word, CASE o_orderkey % 4 WHEN 0 THEN 3 WHEN 1 THEN 4 END AS place, CASE o_orderkey % 4 WHEN 2 THEN 'missing place' WHEN 3 THEN 'no_json' ELSE 'ok' END AS reason,
CASE o_orderkey % 4 WHEN 0 THEN '{"word":"' || o_orderstatus || '","place":3}' WHEN 1 THEN '{"word":"' || o_orderstatus || '","place":4}' END AS dumped FROM orders"""
)
def plan_records(spark: SparkSession, sf: str) -> DataFrame:
    """Plans parsed by their schema, whole or not, and written as JSON again."""
    k = F.col("o_orderkey") % 4
    said = F.when(k == 3, F.concat(F.lit("I choose "), "o_orderstatus")).otherwise(F.concat(F.lit('{"word": "'), "o_orderstatus", F.when(k == 0, '", "place": 3}').when(k == 1, '", "extra": [1], "place": 4 }').otherwise('"}')))
    p = read(spark, sf, "orders").select("o_orderkey", parsing.structured(said, "word string, place int").alias("p"))
    return p.select("o_orderkey", "p.value.word", "p.value.place", "p.reason", F.when(F.col("p.value").isNotNull(), parsing.json_safe(F.col("p.value"))).alias("dumped"))


@R.query("SELECT event_id, '{\"t\":\"' || event_type || '\",\"m\":{\"v\":' || event_id % 10 || '},\"l\":[' || event_id % 3 || ',null]}' AS json FROM events")
def json_values(spark: SparkSession, sf: str) -> DataFrame:
    """Nested values as JSON text."""
    nested = F.struct(F.col("event_type").alias("t"), F.create_map(F.lit("v"), F.col("event_id") % 10).alias("m"), F.array(F.col("event_id") % 3, F.lit(None)).alias("l"))
    return read(spark, sf, "events").select("event_id", parsing.json_safe(nested).alias("json"))


@R.query("SELECT c_custkey, upper(c_mktsegment) AS segment FROM customer WHERE c_acctbal > 0 AND length(c_mktsegment) > 8")
def mapped_rows(spark: SparkSession, sf: str) -> DataFrame:
    """A row map and a filter, the latter before the former so that it reaches the scan."""
    return read(spark, sf, "customer").where((F.col("c_acctbal") > 0) & (F.length("c_mktsegment") > 8)).select("c_custkey", F.upper("c_mktsegment").alias("segment"))


@R.query("SELECT event_id % 300 AS sample_idx, max_by(event_type, event_id) AS response FROM events GROUP BY 1")
def streamed_log(spark: SparkSession, sf: str) -> DataFrame:
    """A log read as a stream, whose last records are kept in a table micro-batch by micro-batch."""
    from veritab.streaming import responses as stream

    root = folder(spark)
    e = read(spark, sf, "events").select((F.col("event_id") % 300).alias("sample_idx"), F.array("event_type").alias("responses"), F.lpad(F.col("event_id").cast("string"), 12, "0").alias("timestamp"))
    for k in range(3):
        e.where(F.col("timestamp").cast("long") % 3 == k).coalesce(1).write.json(f"{root}/log/{k}")
    log = stream.responses(spark, f"{root}/log/*", "sample_idx string, responses array<string>, timestamp string")
    # Of records of one sample the one with the latest time of its own counts.
    timed = log.withColumn("line_no", F.struct(F.col("timestamp").alias("t"), F.lit("").alias("f")))
    stream.latest_into(timed, f"{root}/table", f"{root}/stream").trigger(availableNow=True).start().awaitTermination()
    return stream.latest_table(spark, f"{root}/table").select("sample_idx", parsing.last_turn(F.col("responses")).alias("response"))


QUERIES, ORACLE_SQL = R.queries, R.sql
