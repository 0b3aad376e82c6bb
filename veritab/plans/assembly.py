"""Joins, samples, filters, replay and chat records over the driver's tables."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from veritab.functions import prompts
from veritab.functions.parsing import last_turn as last_of
from veritab.functions.parsing import response_text, score_map
from veritab.operators import chat as C
from veritab.operators import joins as J
from veritab.operators import labels as L
from veritab.operators import sampling as S
from veritab.plans.tables import Registry, read
from veritab.sources import readers

R = Registry()


@R.query("SELECT user_id, event_id, event_type, value FROM events QUALIFY row_number() OVER (PARTITION BY user_id ORDER BY event_id) = 1")
def unique_first(spark: SparkSession, sf: str) -> DataFrame:
    """The first event of each user."""
    return S.first_per_key(read(spark, sf, "events").select("event_id", "user_id", "event_type", "value"), "user_id", "event_id").select("user_id", "event_id", "event_type", "value")


@R.query("SELECT count(DISTINCT user_id) AS users, count(*) AS n FROM events")
def unique_count(spark: SparkSession, sf: str) -> DataFrame:
    """A15."""
    return read(spark, sf, "events").agg(F.countDistinct("user_id").alias("users"), F.count("*").alias("n"))


@R.query("SELECT p_partkey, p_name FROM part ORDER BY md5(concat_ws('-', '7', CAST(p_partkey AS VARCHAR))), p_partkey LIMIT 100")
def sample_topn_md5(spark: SparkSession, sf: str) -> DataFrame:
    """A hundred parts in the order of their hashes (the sample is the feature)."""
    return S.sampled(read(spark, sf, "part").select("p_partkey", "p_name"), 100, 7, "p_partkey")


@R.query(
    """WITH a AS (SELECT c_custkey AS k FROM customer ORDER BY md5(concat_ws('-', '11', CAST(c_custkey AS VARCHAR))), c_custkey LIMIT 50),
b AS (SELECT s_suppkey AS k FROM supplier WHERE s_suppkey NOT IN (SELECT k FROM a) ORDER BY md5(concat_ws('-', '11', CAST(s_suppkey AS VARCHAR))), s_suppkey LIMIT 50)
SELECT 'customer' AS kind, k FROM a UNION ALL SELECT 'supplier', k FROM b"""
)
def sample_disjoint_md5(spark: SparkSession, sf: str) -> DataFrame:
    """Two samples without a key in common."""
    a, b = S.disjoint_samples([(read(spark, sf, "customer").select(F.col("c_custkey").alias("k")), 50), (read(spark, sf, "supplier").select(F.col("s_suppkey").alias("k")), 50)], 11, "k")
    return C.union(a.select(F.lit("customer").alias("kind"), "k"), b.select(F.lit("supplier").alias("kind"), "k"))


@R.query(
    """WITH a AS (SELECT c_custkey AS k FROM customer ORDER BY md5(concat_ws('-', '11', CAST(c_custkey AS VARCHAR))), c_custkey LIMIT 50),
b AS (SELECT s_suppkey AS k FROM supplier ORDER BY md5(concat_ws('-', '11', CAST(s_suppkey AS VARCHAR))), s_suppkey LIMIT 50)
SELECT 'customer' AS kind, k FROM a UNION ALL SELECT 'supplier', k FROM b"""
)
def sample_overlapping_md5(spark: SparkSession, sf: str) -> DataFrame:
    """T07."""
    a, b = S.overlapping_samples([(read(spark, sf, "customer").select(F.col("c_custkey").alias("k")), 50), (read(spark, sf, "supplier").select(F.col("s_suppkey").alias("k")), 50)], 11, "k")
    return C.union(a.select(F.lit("customer").alias("kind"), "k"), b.select(F.lit("supplier").alias("kind"), "k"))


@R.query(
    """WITH c AS (SELECT o_orderkey, unnest(['right', 'hard', 'medium', 'easy']) AS x FROM orders), r AS (SELECT o_orderkey, x, row_number() OVER (PARTITION BY o_orderkey ORDER BY md5(concat_ws('-', '42', CAST(o_orderkey AS VARCHAR), x)), x) AS k FROM c)
SELECT o_orderkey, string_agg(x, ',' ORDER BY k) AS choices, chr(CAST(64 + max(k) FILTER (WHERE x = 'right') AS INTEGER)) AS letter FROM r GROUP BY o_orderkey"""
)
def shuffle_choices_md5(spark: SparkSession, sf: str) -> DataFrame:
    """Four choices in hashed order, and the letter of the right one."""
    c = S.shuffled(F.array(*map(F.lit, ["right", "hard", "medium", "easy"])), 42, F.col("o_orderkey"))
    return read(spark, sf, "orders").select("o_orderkey", F.array_join(c, ",").alias("choices"), F.chr(F.array_position(c, "right") + 64).alias("letter"))


_CUTS = """WITH a AS (SELECT user_id, list(value ORDER BY value) AS v FROM events GROUP BY user_id),
c AS (SELECT user_id, v, v[CAST(round_even(0.0 * (len(v) - 1), 0) AS INTEGER) + 1] AS low, v[CAST(round_even((1.0::DOUBLE / 3) * (len(v) - 1), 0) AS INTEGER) + 1] AS first, v[CAST(round_even((2.0::DOUBLE / 3) * (len(v) - 1), 0) AS INTEGER) + 1] AS second, v[len(v)] AS high FROM a)
"""


@R.query(_CUTS + "SELECT user_id, low, first, second, high, CAST(len(list_filter(v, lambda x: x >= second AND x <= high)) AS INTEGER) AS far FROM c")
def tertile_buckets(spark: SparkSession, sf: str) -> DataFrame:
    """Each user's values cut in three by rank."""
    a = read(spark, sf, "events").groupBy("user_id").agg(F.collect_list("value").alias("v")).withColumn("c", S.tertile_cuts(F.col("v")))
    far = S.from_bucket(F.transform("v", lambda x: F.struct(x.alias("value"))), F.col("c"), "far")
    return a.select("user_id", "c.low", "c.first", "c.second", "c.high", F.size(far).alias("far"))


@R.query("SELECT o_orderkey, CASE WHEN u < 0.25 THEN 'near' WHEN u < 0.75 THEN 'mid' ELSE 'far' END AS bucket FROM (SELECT o_orderkey, CAST(('0x' || substring(md5(concat_ws('-', CAST(o_orderkey AS VARCHAR), 'w')), 1, 8)) AS BIGINT) / 4294967296.0 AS u FROM orders)")
def weighted_choice_md5(spark: SparkSession, sf: str) -> DataFrame:
    """T12."""
    return read(spark, sf, "orders").select("o_orderkey", S.weighted([("near", 1), ("mid", 2), ("far", 1)], F.col("o_orderkey").cast("string"), F.lit("w")).alias("bucket"))


@R.query("SELECT o_orderkey FROM orders WHERE o_orderkey BETWEEN 100 AND 5000")
def shard_range(spark: SparkSession, sf: str) -> DataFrame:
    """F02."""
    return read(spark, sf, "orders").where(J.id_range(F.col("o_orderkey"), 100, 5000)).select("o_orderkey")


@R.query("SELECT o_orderkey FROM orders WHERE o_orderkey % 7 = 3")
def shard_modulo(spark: SparkSession, sf: str) -> DataFrame:
    """the shard is the feature."""
    return read(spark, sf, "orders").where(J.id_modulo(F.col("o_orderkey"), 7, 3)).select("o_orderkey")


@R.query("SELECT doc_id, lang, source FROM documents WHERE doc_id IN (SELECT doc_id FROM labels)")
def semi_join_ids(spark: SparkSession, sf: str) -> DataFrame:
    """F01, F11."""
    return J.keep_ids(read(spark, sf, "documents").select("doc_id", "lang", "source"), read(spark, sf, "labels"), "doc_id")


@R.query("SELECT doc_id, lang, source FROM documents WHERE doc_id NOT IN (SELECT doc_id FROM labels)")
def resume_anti_join(spark: SparkSession, sf: str) -> DataFrame:
    """J16."""
    return J.not_done(read(spark, sf, "documents").select("doc_id", "lang", "source"), read(spark, sf, "labels"), "doc_id")


@R.query("SELECT user_id, event_id, value FROM events WHERE value >= 28 AND event_id >= 28 AND event_id < 5000")
def size_filter(spark: SparkSession, sf: str) -> DataFrame:
    """F04, F12."""
    e = read(spark, sf, "events").where(J.large_enough(F.col("value"), F.col("event_id")))
    return J.first_rows(e, "event_id", 5000).select("user_id", "event_id", "value")


@R.query("SELECT l.doc_id, toxic, quality, lang, source FROM labels l JOIN documents d ON d.doc_id = l.doc_id")
def strict_join(spark: SparkSession, sf: str) -> DataFrame:
    """Every label has its document."""
    return J.strict(read(spark, sf, "labels"), read(spark, sf, "documents").select("doc_id", "lang", "source"), "doc_id").select("doc_id", "toxic", "quality", "lang", "source")


@R.query("SELECT CASE WHEN l.doc_id IS NULL THEN 'no label' ELSE 'matched' END AS reason, count(*) AS n FROM documents d LEFT JOIN labels l USING (doc_id) GROUP BY 1")
def quarantine(spark: SparkSession, sf: str) -> DataFrame:
    """documents with labels, and the others with the reason."""
    good, bad = J.split_by_match(read(spark, sf, "documents").select("doc_id"), read(spark, sf, "labels"), "doc_id", "no label")
    return C.union(good.select("doc_id", F.lit("matched").alias("reason")), bad).groupBy("reason").agg(F.count("*").alias("n"))


@R.query("SELECT d.doc_id, lang, CAST(toxic AS VARCHAR) AS toxic, CAST(quality AS VARCHAR) AS quality FROM documents d LEFT JOIN labels l ON d.doc_id = l.doc_id")
def left_join_meta(spark: SparkSession, sf: str) -> DataFrame:
    """J02, J03, J08."""
    return J.optional(read(spark, sf, "documents").select("doc_id", "lang"), read(spark, sf, "labels"), "doc_id").select("doc_id", "lang", F.col("toxic").cast("string").alias("toxic"), F.col("quality").cast("string").alias("quality"))


@R.query("SELECT d.doc_id, coalesce(CASE WHEN toxic = 1 THEN 'flagged' WHEN toxic = 0 THEN '' END, lang) AS shown, toxic IS NOT NULL AS replaced FROM documents d LEFT JOIN labels l USING (doc_id)")
def override_column(spark: SparkSession, sf: str) -> DataFrame:
    """J09, P16."""
    m = read(spark, sf, "labels").select("doc_id", F.when(F.col("toxic") == 1, "flagged").when(F.col("toxic") == 0, "").alias("word"))
    return J.override(read(spark, sf, "documents").select("doc_id", F.col("lang").alias("shown")), m, "doc_id", "shown", "word", "replaced").select("doc_id", "shown", "replaced")


@R.query("SELECT d.doc_id, coalesce(nullif(trim(CASE WHEN toxic = 1 THEN ' bad ' WHEN toxic = 0 THEN '  ' END), ''), nullif(trim(source), ''), lang) AS word FROM documents d LEFT JOIN labels l USING (doc_id)")
def coalesce_precedence(spark: SparkSession, sf: str) -> DataFrame:
    """P15, K05."""
    d = read(spark, sf, "documents").select("doc_id", "source", "lang").join(read(spark, sf, "labels"), "doc_id", "left")
    return d.select("doc_id", prompts.first_text(F.when(F.col("toxic") == 1, " bad ").when(F.col("toxic") == 0, "  "), F.col("source"), F.col("lang")).alias("word"))


@R.query("SELECT n_nationkey, r_name, level FROM nation JOIN region ON r_regionkey = n_regionkey, (SELECT unnest(['hard', 'medium', 'easy']) AS level)")
def level_product(spark: SparkSession, sf: str) -> DataFrame:
    """J10, J15."""
    regions = read(spark, sf, "region").select(F.col("r_regionkey").alias("name"), F.col("r_name").alias("class_id"))
    return J.levels(J.ids_of(read(spark, sf, "nation").select("n_nationkey", "n_regionkey"), regions, "n_regionkey"), ["hard", "medium", "easy"]).select("n_nationkey", F.col("class_id").alias("r_name"), "level")


@R.query("SELECT o_orderkey, o_custkey, c_mktsegment FROM (SELECT o_orderkey, o_custkey, min(c_mktsegment) AS c_mktsegment FROM orders JOIN customer ON c_custkey = o_custkey GROUP BY 1, 2)")
def file_join(spark: SparkSession, sf: str) -> DataFrame:
    """Images by the names of their files."""
    o = read(spark, sf, "orders").select(F.col("o_custkey").cast("string").alias("image_id"), F.col("o_orderkey").alias("question_id"))
    files = o.join(read(spark, sf, "customer").select(F.col("c_custkey").cast("string").alias("image_id"), "c_mktsegment"), "image_id")
    files = files.select(F.concat(F.lit("/img/"), "image_id", F.lit("_"), "question_id", F.lit("_"), "c_mktsegment", F.lit(".jpg")).alias("path"))
    return J.by_file(o, files).select(F.col("question_id").alias("o_orderkey"), F.col("image_id").cast("long").alias("o_custkey"), F.regexp_extract("path", r"_([A-Z]+)\.jpg$", 1).alias("c_mktsegment"))


@R.query("""WITH f AS (SELECT o_custkey || '-' || o_orderkey || '.jpg' AS name FROM orders) SELECT c_custkey, '/img/' || min(name) AS path FROM customer JOIN f ON starts_with(name, CAST(c_custkey AS VARCHAR)) GROUP BY c_custkey""")
def prefix_join(spark: SparkSession, sf: str) -> DataFrame:
    """The first file whose name begins with a customer's number, whatever follows."""
    files = read(spark, sf, "orders").select(F.concat(F.lit("/img/"), F.col("o_custkey").cast("string"), F.lit("-"), F.col("o_orderkey").cast("string"), F.lit(".jpg")).alias("path"))
    return J.by_prefix(read(spark, sf, "customer").select("c_custkey", F.col("c_custkey").cast("string").alias("wanted")), files, "wanted").select("c_custkey", "path")


@R.query("SELECT conv_id, count(*) AS n_messages, md5(string_agg(role || ':' || text, chr(10) ORDER BY turn)) AS md5 FROM conversations GROUP BY conv_id")
def chat_messages(spark: SparkSession, sf: str) -> DataFrame:
    """P10, P14."""
    m = C.conversations(read(spark, sf, "conversations"), "conv_id", "turn", "role", "text")
    flat = F.array_join(F.transform("messages", lambda x: F.concat(x["role"], F.lit(":"), x["content"][0]["text"])), "\n")
    return m.select("conv_id", F.size("messages").cast("long").alias("n_messages"), F.md5(flat).alias("md5"))


@R.query("SELECT conv_id, arg_max(text, turn) AS text FROM conversations GROUP BY conv_id")
def last_turn(spark: SparkSession, sf: str) -> DataFrame:
    """P19."""
    return C.last_turns(read(spark, sf, "conversations"), "conv_id", "turn", "text")


_Q = {"obj_mc": prompts.OPTION_LETTER, "obj_oe": prompts.OBJECT_NAMES, "txt_oe": prompts.SHORT_ANSWER}


@R.query(
    f"""WITH q AS (SELECT conv_id, turn, CASE turn % 3 WHEN 0 THEN 'obj_mc' WHEN 1 THEN 'obj_oe' ELSE 'txt_oe' END AS task, CASE turn % 3 WHEN 0 THEN '{_Q["obj_mc"]}' WHEN 1 THEN '{_Q["obj_oe"]}' ELSE '{_Q["txt_oe"]}' END AS suffix,
  CASE conv_id % 3 WHEN 0 THEN '1phase-basic' WHEN 1 THEN '1phase-focus' ELSE '2phase-focus' END AS strategy, text FROM conversations),
t AS (SELECT *, text || ' ' || suffix AS question FROM q),
r AS (SELECT *, CASE strategy WHEN '1phase-basic' THEN [question] WHEN '1phase-focus' THEN ['{prompts.FOCUS}' || question] ELSE ['{prompts.FOCUS}' || regexp_replace(replace(question, suffix, ''), '^\\s+|\\s+$', '', 'g'), '{prompts.SOLVE}' || question] END AS turns FROM t)
SELECT conv_id, turn, CAST(len(turns) AS INTEGER) AS n, md5(array_to_string(turns, '|')) AS md5 FROM r"""
)
def prompt_strategy(spark: SparkSession, sf: str) -> DataFrame:
    """P03, P06."""
    k = F.col("turn") % 3
    task = F.when(k == 0, "obj_mc").when(k == 1, "obj_oe").otherwise("txt_oe")
    suffix = F.when(k == 0, _Q["obj_mc"]).when(k == 1, _Q["obj_oe"]).otherwise(_Q["txt_oe"])
    strategy = F.when(F.col("conv_id") % 3 == 0, "1phase-basic").when(F.col("conv_id") % 3 == 1, "1phase-focus").otherwise("2phase-focus")
    t = prompts.turns(task, F.concat("text", F.lit(" "), suffix), strategy)
    return read(spark, sf, "conversations").select("conv_id", "turn", F.size(t).alias("n"), F.md5(F.array_join(t, "|")).alias("md5"))


_NAMES = ["org/obj_attack/mc_hard", "org/obj_attack/oe_easy", "org/txt_attack/oe_far", "obj_attack__mcq_hard", "x/y/train__oe_set", "org/obj_clean/open_ended_a", "local/obj_x/other-oe-b"]


@R.query(
    """WITH n AS (SELECT event_id, ['org/obj_attack/mc_hard', 'org/obj_attack/oe_easy', 'org/txt_attack/oe_far', 'obj_attack__mcq_hard', 'x/y/train__oe_set', 'org/obj_clean/open_ended_a', 'local/obj_x/other-oe-b'][1 + event_id % 7] AS name FROM events),
s AS (SELECT event_id, name, string_split(name, '/')[-1] AS last, string_split(name, '/') AS p FROM n),
t AS (SELECT *, CASE WHEN contains(last, '__') THEN split_part(last, '__', 1) ELSE p[-2] END AS split, CASE WHEN contains(last, '__') THEN split_part(last, '__', 2) ELSE last END AS subset FROM s)
SELECT event_id, CASE WHEN starts_with(coalesce(p[2], ''), 'txt_') THEN 'txt_oe' WHEN starts_with(coalesce(p[2], ''), 'obj_') AND (starts_with(last, 'mc_') OR contains(last, 'mcq')) THEN 'obj_mc'
 WHEN starts_with(coalesce(p[2], ''), 'obj_') AND (starts_with(last, 'oe_') OR contains(last, 'open_ended')) THEN 'obj_oe' WHEN contains('/' || name, '/txt_') OR contains(name, 'open_ended') THEN 'txt_oe'
 WHEN contains('/' || name, '/obj_') AND regexp_matches(last, 'mc_|mcq') THEN 'obj_mc' WHEN contains('/' || name, '/obj_') AND regexp_matches(last, 'oe_|open_ended') THEN 'obj_oe' END AS task,
 split, subset, CASE WHEN starts_with(split, 'obj') AND regexp_matches(subset, '^(mcq|mc_)|^mc$') THEN 'obj_mcq' WHEN starts_with(split, 'obj') AND (contains(subset, 'open') OR regexp_matches(subset, '(?:^|[_-])oe(?:$|[_-])')) THEN 'obj_open'
 WHEN regexp_matches(split, '^(txt|text)') AND (contains(subset, 'open') OR regexp_matches(subset, '(?:^|[_-])oe(?:$|[_-])')) THEN 'txt_open' ELSE 'obj_open' END AS kind FROM t"""
)
def task_dispatch(spark: SparkSession, sf: str) -> DataFrame:
    """P08, P09, P11."""
    name = F.element_at(F.array(*map(F.lit, _NAMES)), (F.col("event_id") % len(_NAMES) + 1).cast("int"))
    e = read(spark, sf, "events").select("event_id", name.alias("name")).withColumn("s", prompts.split_subset(F.col("name")))
    return e.select("event_id", prompts.task_of_name(F.col("name")).alias("task"), "s.split", "s.subset", prompts.record_kind(F.col("s.split"), F.col("s.subset")).alias("kind"))


@R.query("SELECT conv_id, turn, md5(CASE role WHEN 'assistant' THEN 'assistant' ELSE 'user' END || '|' || regexp_replace(replace('<image>' || text, '<image>', ''), '^\\s+|\\s+$', '', 'g') || CASE WHEN role = 'assistant' THEN '</s>' ELSE '' END) AS md5 FROM conversations")
def instruct_messages(spark: SparkSession, sf: str) -> DataFrame:
    """P12."""
    t = F.array(F.struct(F.when(F.col("role") == "assistant", "gpt").otherwise("human").alias("from"), F.concat(F.lit("<image>"), "text").alias("value")))
    m = prompts.instruct_messages(t, F.lit(None).cast("string"), "</s>")
    return read(spark, sf, "conversations").select("conv_id", "turn", m[0].alias("m")).select("conv_id", "turn", F.md5(F.concat("m.role", F.lit("|"), F.col("m.content")[0]["text"])).alias("md5"))


@R.query(
    """SELECT o_orderkey, CASE o_orderkey % 4 WHEN 0 THEN 'Context: ' || CASE WHEN o_orderstatus = 'O' THEN 'N/A' ELSE o_orderstatus END || chr(10) || 'Question: what is it' || chr(10) || 'Options: A. x' || chr(10) || 'B. ' || o_orderpriority || chr(10) || 'Answer:'
 WHEN 1 THEN 'what is it' || chr(10) || 'When the provided information is insufficient, respond with ''Unanswerable''.' || chr(10) || 'Answer the question using a single word or phrase.'
 WHEN 2 THEN 'What is it' || chr(10) || 'When the provided information is insufficient, respond with ''Unanswerable''.' || chr(10) || 'Answer the question using a single word or phrase.'
 ELSE 'what is it' || chr(10) || 'Answer the question with a single word.' END AS query FROM orders"""
)
def vqa_prompts(spark: SparkSession, sf: str) -> DataFrame:
    """P13."""
    k = F.col("o_orderkey") % 4
    dataset = F.when(k == 0, "ScienceQA").when(k == 1, "ok-vqa").when(k == 2, "VizWiz").otherwise("textvqa")
    q = prompts.vqa_query(dataset, F.when(k == 0, "qwen2").otherwise("llava"), F.when(F.col("o_orderstatus") != "O", F.col("o_orderstatus")), F.lit("what is it"), F.array(F.lit("x"), F.col("o_orderpriority")))
    return read(spark, sf, "orders").select("o_orderkey", q.alias("query"))


@R.query(
    """SELECT p_partkey, 'Which object is present in the image? (A) ' || p_name || ' (B) ' || p_brand || ' (C) ' || p_type || ' (D) none. Answer with only the option letter (A, B, C, or D).' AS question,
CASE p_size % 4 WHEN 0 THEN '' WHEN 1 THEN p_name WHEN 2 THEN p_brand ELSE p_type END AS word, 'an image of a ' || p_name || '.' AS prompt FROM part"""
)
def choice_questions(spark: SparkSession, sf: str) -> DataFrame:
    """P01, P04, P05, N23."""
    k = F.col("p_size") % 4
    level = F.when(k == 0, "clean").when(k == 1, "correct").when(k == 2, "hard").otherwise("easy")
    word = prompts.attack_word(level, F.col("p_name"), {"hard": F.col("p_brand"), "easy": F.col("p_type")})
    return read(spark, sf, "part").select("p_partkey", prompts.choice_question(F.col("p_name"), F.col("p_brand"), F.col("p_type"), F.lit("none")).alias("question"), word.alias("word"), prompts.label_prompts(F.col("p_name"))[1].alias("prompt"))


@R.query("SELECT p_partkey, p_name, p_size FROM part")
def struct_without_fields(spark: SparkSession, sf: str) -> DataFrame:
    """Metadata loses the fields that its row has."""
    meta = F.struct("p_name", "p_size", F.lit("x").alias("answer"), F.lit("y").alias("attack_word"), F.lit(1).alias("question_id"))
    return read(spark, sf, "part").select("p_partkey", meta.dropFields("answer", "attack_word", "question_id").alias("m")).select("p_partkey", "m.*")


@R.query("SELECT DISTINCT regexp_extract(p, '([^/]+)/*$', 1) AS last, CASE WHEN starts_with(regexp_extract(p, '([^/]+)/*$', 1), 'checkpoint-') THEN split_part(p, '/', 2) || '_' || regexp_extract(p, '([^/]+)/*$', 1) ELSE regexp_extract(p, '([^/]+)/*$', 1) END AS name FROM (SELECT CASE WHEN p_size % 2 = 0 THEN 'runs/' || p_type || '/checkpoint-' || p_size ELSE 'models/' || p_brand || '/' END AS p FROM part)")
def model_names(spark: SparkSession, sf: str) -> DataFrame:
    """P22."""
    p = F.when(F.col("p_size") % 2 == 0, F.concat(F.lit("runs/"), "p_type", F.lit("/checkpoint-"), "p_size")).otherwise(F.concat(F.lit("models/"), "p_brand", F.lit("/")))
    return read(spark, sf, "part").select(p.alias("p")).select(F.substring_index(F.regexp_replace("p", "/+$", ""), "/", -1).alias("last"), prompts.model_name(F.col("p")).alias("name")).distinct()


@R.query(
    """WITH r AS (SELECT event_id, CASE event_id % 3 WHEN 0 THEN event_type END AS whole, event_type AS a, CASE WHEN event_id % 2 = 0 THEN props END AS b FROM events)
SELECT event_id, trim(coalesce(nullif(whole, ''), concat_ws(chr(10), a, b))) AS text, coalesce(b, a) AS last FROM r"""
)
def provider_text(spark: SparkSession, sf: str) -> DataFrame:
    """A response's text, whole or in parts, and its last part."""
    b = F.when(F.col("event_id") % 2 == 0, F.col("props"))
    parts = F.array(F.array(F.col("event_type"), F.lit("")), F.array(b))
    whole = F.when(F.col("event_id") % 3 == 0, F.col("event_type"))
    said = F.filter(F.array(F.col("event_type"), b), lambda x: x.isNotNull())
    return read(spark, sf, "events").select("event_id", response_text(whole, parts).alias("text"), last_of(said).alias("last"))


@R.query(
    """WITH l AS (SELECT event_id AS line_no, user_id, event_type, CASE WHEN event_id % 11 = 0 THEN '' WHEN event_id % 13 = 0 THEN '{bad' WHEN event_id % 17 = 0 THEN '"x"' ELSE 'ok' END AS kind FROM events)
SELECT user_id AS sample_idx, arg_max(event_type, line_no) AS response FROM l WHERE kind = 'ok' GROUP BY user_id"""
)
def replay_log_latest(spark: SparkSession, sf: str) -> DataFrame:
    """The last response of each sample in a log with blank, broken and misnumbered lines."""
    i = F.col("event_id")
    key = F.when(i % 17 == 0, F.concat(F.lit('"'), F.col("user_id"), F.lit('"'))).otherwise(F.col("user_id").cast("string"))
    line = F.when(i % 11 == 0, "  ").when(i % 13 == 0, '{"sample_idx": 1, bad').otherwise(F.concat(F.lit('{"sample_idx": '), key, F.lit(', "responses": ["a", "'), F.col("event_type"), F.lit('"]}')))
    log = readers.latest(readers.parsed_log(read(spark, sf, "events").select(i.alias("line_no"), line.alias("value"))))
    return log.select("sample_idx", last_of(F.col("responses")).alias("response"))


@R.query("SELECT label, CAST(row_number() OVER (ORDER BY label) - 1 AS INTEGER) AS ord FROM (SELECT DISTINCT p_name AS label FROM part)")
def vocabulary_snapshot(spark: SparkSession, sf: str) -> DataFrame:
    """S14, S15, A17."""
    return readers.vocabulary(read(spark, sf, "part").select(F.array("p_name").alias("classes")), "classes").select("label", F.col("ord").cast("int").alias("ord"))


@R.query("SELECT o_custkey, o_orderkey, CAST(row_number() OVER (ORDER BY o_custkey, o_orderkey) - 1 AS BIGINT) AS row_no FROM orders")
def numbered_rows(spark: SparkSession, sf: str) -> DataFrame:
    """Row numbers in a given order, which first-wins operators need."""
    return readers.numbered(read(spark, sf, "orders").select("o_custkey", "o_orderkey"), ["o_custkey", "o_orderkey"])


@R.query("SELECT r_regionkey, string_agg(n_name, '|' ORDER BY n_name) AS names, CAST(count(*) AS INTEGER) AS n FROM nation JOIN region ON n_regionkey = r_regionkey GROUP BY r_regionkey")
def label_sets(spark: SparkSession, sf: str) -> DataFrame:
    """A region's names as a set, by union and difference."""
    sets = read(spark, sf, "nation").groupBy(F.col("n_regionkey").alias("r_regionkey")).agg(F.collect_set("n_name").alias("s"))
    both = F.array_union(F.array_except("s", F.array(F.lit("nowhere"))), F.array_intersect("s", "s"))
    return sets.select("r_regionkey", F.array_join(F.array_sort(both), "|").alias("names"), F.size(both).alias("n"))


@R.query(
    """WITH p AS (SELECT user_id, event_type, max(value) AS v FROM events GROUP BY user_id, event_type)
SELECT user_id, arg_max(event_type, v) AS answer, CAST(count(*) AS INTEGER) AS n FROM p GROUP BY user_id"""
)
def highest_answer(spark: SparkSession, sf: str) -> DataFrame:
    """The answer with the highest score of a list."""
    best = read(spark, sf, "events").groupBy("user_id", "event_type").agg(F.max("value").alias("v"))
    pairs = best.groupBy("user_id").agg(F.array_sort(F.collect_list(F.struct(F.col("event_type").alias("answer"), F.col("v").alias("score")))).alias("s"))
    # A type that is null is never the answer but is counted; the map has none.
    named = F.filter("s", lambda p: p["answer"].isNotNull())
    return pairs.select("user_id", L.highest(named).alias("answer"), (F.size(F.map_keys(score_map(named))) + F.size("s") - F.size(named)).alias("n"))


@R.query("SELECT sample_idx, a, b FROM (SELECT o_orderkey AS sample_idx, o_orderstatus AS a FROM orders) JOIN (SELECT o_orderkey AS sample_idx, o_orderpriority AS b FROM orders) USING (sample_idx)")
def positional_zip(spark: SparkSession, sf: str) -> DataFrame:
    """J11."""
    o = read(spark, sf, "orders")
    return J.positions(o.select(F.col("o_orderkey").alias("sample_idx"), F.col("o_orderstatus").alias("a")), o.select(F.col("o_orderkey").alias("sample_idx"), F.col("o_orderpriority").alias("b")))


QUERIES, ORACLE_SQL = R.queries, R.sql
