"""Scoring: embedding match, multiple choice, consensus metrics, text normalisation and generated text."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, SparkSession, Window
from pyspark.sql import functions as F

from veritab.functions import choice, metrics, parsing, textnorm, vectors
from veritab.functions.textnorm import ARTICLES, CONTRACTIONS, NUMBER_WORDS, PUNCTUATION, STOP_ANSWERS
from veritab.operators import labels as L
from veritab.operators import matching
from veritab.plans.tables import Registry, read
from veritab.sources.readers import dealt

R = Registry()
EVENT_TYPES = ["click", "error", "purchase", "signup", "view"]


def _ranked(spark: SparkSession, sf: str, k: int = 5) -> DataFrame:
    """Each vector's k nearest labels: ``top`` with their similarities, ``t`` without."""
    e = read(spark, sf, "embeddings")
    classes = vectors.mean_vectors(e.where("label IS NOT NULL"), ["label"], "embedding")
    return matching.nearest_classes(e, classes, "embedding", k, class_vector="mean").select("vec_id", "label", "top", F.transform("top", lambda t: t["label"]).alias("t"))


_SIMS = """
WITH comp AS (SELECT label, vec_id, i, CAST(embedding[i] AS DOUBLE) AS x FROM embeddings, unnest(range(1, len(embedding) + 1)) t(i) WHERE label IS NOT NULL),
m AS (SELECT label, list(x ORDER BY i) AS v FROM (SELECT label, i, avg(x) AS x FROM comp GROUP BY label, i) GROUP BY label),
s AS (SELECT e.vec_id, e.label, m.label AS c, list_inner_product(CAST(e.embedding AS DOUBLE[]), m.v) AS sim FROM embeddings e CROSS JOIN m),
r AS (SELECT *, row_number() OVER (PARTITION BY vec_id ORDER BY sim DESC, c) AS k FROM s),
top AS (SELECT vec_id, label, list(c ORDER BY k) FILTER (WHERE k <= 5) AS t FROM r GROUP BY vec_id, label)
"""


@R.query(
    _SIMS
    + """SELECT avg(CAST(t[1] = label AS DOUBLE)) AS acc_at_1, avg(CAST(list_contains(t, label) AS DOUBLE)) AS acc_at_5,
avg(CASE WHEN label <> 9 THEN CAST(t[1] = (label + 1) % 10 AS DOUBLE) END) AS asr_at_1, avg(CASE WHEN label <> 9 THEN CAST(list_contains(t, (label + 1) % 10) AS DOUBLE) END) AS asr_at_5,
count(*) AS n, count(*) FILTER (WHERE label <> 9) AS n_attacked FROM top"""
)
def embedding_match_metrics(spark: SparkSession, sf: str) -> DataFrame:
    """Each vector against the mean of every label; the next label stands for an attack word, which label 9 lacks."""
    top = _ranked(spark, sf)
    attacked, word = F.col("label") != 9, (F.col("label") + 1) % 10
    first, among = F.col("t")[0], lambda c: F.array_contains("t", c)
    return top.agg(
        metrics.rate(first == F.col("label")).alias("acc_at_1"),
        metrics.rate(among(F.col("label"))).alias("acc_at_5"),
        metrics.rate(first == word, attacked).alias("asr_at_1"),
        metrics.rate(among(word), attacked).alias("asr_at_5"),
        F.count("*").alias("n"),
        F.count_if(attacked).alias("n_attacked"),
    )


@R.query(_SIMS + "SELECT vec_id, label, array_to_string(t, ',') AS top5, t[1] = label AS hit_at_1, list_contains(t, label) AS hit_at_5 FROM top")
def embedding_topk_records(spark: SparkSession, sf: str) -> DataFrame:
    """The five nearest labels of each vector."""
    t = F.col("t")
    return _ranked(spark, sf).select("vec_id", "label", F.array_join(t, ",").alias("top5"), (t[0] == F.col("label")).alias("hit_at_1"), F.array_contains(t, F.col("label")).alias("hit_at_5"))


# Fifty means a label are the classes of a larger vocabulary.
_NEAR = """
WITH comp AS (SELECT label * 50 + vec_id % 50 AS class, vec_id, i, CAST(embedding[i] AS DOUBLE) AS x FROM embeddings, unnest(range(1, len(embedding) + 1)) t(i) WHERE label IS NOT NULL),
m AS (SELECT class, list(x ORDER BY i) AS v FROM (SELECT class, i, avg(x) AS x FROM comp GROUP BY class, i) GROUP BY class),
s AS (SELECT e.vec_id, e.label, m.class AS c, list_inner_product(CAST(e.embedding AS DOUBLE[]), m.v) AS sim FROM embeddings e CROSS JOIN m),
r AS (SELECT *, row_number() OVER (PARTITION BY vec_id ORDER BY sim DESC, c) AS k FROM s)
"""


@R.query(_NEAR + "SELECT vec_id, array_to_string(list(c ORDER BY k), ',') AS classes, round(min(sim), 6) AS fifth FROM r WHERE k <= 5 GROUP BY vec_id")
def nearest_classes_blocked(spark: SparkSession, sf: str) -> DataFrame:
    """The five nearest of all vectors' means by label and residue, met in blocks of 128 classes."""
    e = read(spark, sf, "embeddings")
    own = e.where("label IS NOT NULL").withColumn("class", F.col("label") * 50 + F.col("vec_id") % 50)
    near = matching.nearest_classes(e, vectors.mean_vectors(own, ["class"], "embedding"), "embedding", 5, label="class", class_vector="mean", block=128)
    far = F.try_element_at("top", F.lit(-1))["far"]
    return near.select("vec_id", F.array_join(F.transform("top", lambda t: t["label"].cast("string")), ",").alias("classes"), F.round(-far, 6).alias("fifth"))


@R.query(
    _SIMS.replace("FROM embeddings e CROSS JOIN m)", "FROM embeddings e CROSS JOIN (SELECT * FROM m WHERE label < 6) m)")
    + """, w AS (SELECT e.vec_id, e.label, (e.label + 1) % 10 AS word, list_inner_product(CAST(e.embedding AS DOUBLE[]), m.v) AS sim FROM embeddings e JOIN m ON m.label = (e.label + 1) % 10 WHERE e.label <> 9),
b AS (SELECT vec_id, max(sim) AS one, min(sim) FILTER (WHERE k <= 3) AS three, list(c ORDER BY k) FILTER (WHERE k <= 3) AS t FROM r GROUP BY vec_id),
a AS (SELECT e.vec_id, coalesce(t[1] = e.label, false) AS h1, coalesce(list_contains(t, e.label), false) AS hk, CASE WHEN word < 6 THEN t[1] = word ELSE sim >= one END AS a1, CASE WHEN word < 6 THEN list_contains(t, word) ELSE sim >= three END AS ak FROM embeddings e JOIN b USING (vec_id) LEFT JOIN w USING (vec_id))
SELECT avg(CAST(h1 AS DOUBLE)) AS acc_at_1, avg(CAST(hk AS DOUBLE)) AS acc_at_k, avg(CAST(a1 AS DOUBLE)) AS asr_at_1, avg(CAST(ak AS DOUBLE)) AS asr_at_k, count(*) AS n, count(a1) AS n_attacked FROM a"""
)
def unknown_word_attacks(spark: SparkSession, sf: str) -> DataFrame:
    """Only labels below 6 are classes; the next label is the attack's word, which for most rows lies outside the vocabulary and has a vector of its own."""
    e = read(spark, sf, "embeddings").select("vec_id", "label", F.col("embedding").cast("array<double>").alias("vector"))
    means = vectors.mean_vectors(e.where("label IS NOT NULL"), ["label"], "vector")
    classes = means.where("label < 6")
    near = matching.nearest_classes(e, classes, "vector", 3, class_vector="mean").withColumns({"truth": F.array("label"), "word": F.when(F.col("label") != 9, (F.col("label") + 1) % 10)})
    words = means.select(F.col("label").alias("_w"), F.col("mean").alias("word_vector"))
    return matching.match_metrics(matching.match_records(near.join(words, F.col("word") == F.col("_w"), "left"), classes, 3))


@R.query(
    """SELECT vec_id, round(sqrt(list_inner_product(CAST(embedding AS DOUBLE[]), CAST(embedding AS DOUBLE[]))), 6) AS length, round(list_max(CAST(embedding AS DOUBLE[])) - list_min(CAST(embedding AS DOUBLE[])), 6) AS spread FROM embeddings"""
)
def embedding_norms(spark: SparkSession, sf: str) -> DataFrame:
    """The length of each vector, and the width of its components."""
    v = F.col("embedding").cast("array<double>")
    return read(spark, sf, "embeddings").select("vec_id", F.round(F.sqrt(vectors.dot(v, v)), 6).alias("length"), F.round(F.array_max(v) - F.array_min(v), 6).alias("spread"))


# Responses to multiple-choice questions, one in each form, made from events: the letter is right but every seventh time.
_RESPONSE_SQL = """
WITH q AS (SELECT event_id, list_position(['click', 'error', 'purchase', 'signup', 'view'], event_type) - 1 AS truth, event_type FROM events),
l AS (SELECT *, chr(CAST(65 + (truth + CASE WHEN event_id % 7 = 0 THEN 1 ELSE 0 END) % 5 AS INTEGER)) AS letter FROM q),
a AS (SELECT *, CASE event_id % 6 WHEN 0 THEN 'Answer: (' || letter || ')' WHEN 1 THEN 'the answer is ' || letter WHEN 2 THEN letter || '.' WHEN 3 THEN 'It must be [' || lower(letter) || ']'
      WHEN 4 THEN 'This shows: ' || upper(event_type) || '!' ELSE 'no idea, really' END AS s FROM l),
"""
_PATTERNS_SQL = ",".join(f"nullif(regexp_extract(s, '(?i){p}', 1), '')" for p in choice.LETTER_PATTERNS)
_LETTER_SQL = (
    _RESPONSE_SQL
    + f"""i AS (SELECT *, list_filter([{_PATTERNS_SQL}], lambda x: x IS NOT NULL AND ascii(upper(x)) - 65 < 5) AS hits,
      list_filter(['A', 'B', 'C', 'D', 'E'], lambda x: regexp_matches(s, '(?i)\\b' || x || '\\b')) AS bare,
      list_filter(['click', 'error', 'purchase', 'signup', 'view'], lambda c: contains(regexp_replace(lower(s), '[^a-z0-9 ]+', '', 'g'), c)) AS named FROM a),
p AS (SELECT event_id, truth, s, CASE WHEN len(hits) > 0 THEN ascii(upper(hits[1])) - 65 WHEN len(bare) > 0 THEN ascii(bare[1]) - 65
      WHEN len(named) > 0 THEN list_position(['click', 'error', 'purchase', 'signup', 'view'], named[1]) - 1 END AS pred FROM i)
"""
)


def _responses(spark: SparkSession, sf: str) -> DataFrame:
    choices = F.array(*map(F.lit, EVENT_TYPES))
    e = read(spark, sf, "events").select("event_id", "event_type", (F.array_position(choices, F.col("event_type")) - 1).cast("int").alias("truth"))
    e = e.withColumn("letter", choice.letter_of((F.col("truth") + F.when(F.col("event_id") % 7 == 0, 1).otherwise(0)) % 5))
    form = F.col("event_id") % 6
    s = (
        F.when(form == 0, F.concat(F.lit("Answer: ("), "letter", F.lit(")")))
        .when(form == 1, F.concat(F.lit("the answer is "), "letter"))
        .when(form == 2, F.concat("letter", F.lit(".")))
        .when(form == 3, F.concat(F.lit("It must be ["), F.lower("letter"), F.lit("]")))
        .when(form == 4, F.concat(F.lit("This shows: "), F.upper("event_type"), F.lit("!")))
        .otherwise("no idea, really")
    )
    return e.withColumn("s", s).withColumn("pred", choice.predicted_choice(F.col("s"), choices, 5))


@R.query(_LETTER_SQL + "SELECT event_id, truth, CAST(coalesce(pred, -1) AS INTEGER) AS pred_idx, chr(CAST(65 + pred AS INTEGER)) AS pred_letter, CAST(coalesce(pred = truth, false) AS INTEGER) AS is_correct FROM p")
def mc_letter_records(spark: SparkSession, sf: str) -> DataFrame:
    """Which choice each response names."""
    right = F.coalesce(F.col("pred") == F.col("truth"), F.lit(False)).cast("int")
    return _responses(spark, sf).select("event_id", "truth", F.coalesce("pred", F.lit(-1)).cast("int").alias("pred_idx"), choice.letter_of(F.col("pred")).alias("pred_letter"), right.alias("is_correct"))


@R.query(_LETTER_SQL + "SELECT coalesce(avg(CAST(coalesce(pred = truth, false) AS INTEGER)), 0) AS accuracy, count(*) AS n, count(pred) AS n_answered FROM p")
def mc_accuracy(spark: SparkSession, sf: str) -> DataFrame:
    """The share of right choices."""
    return _responses(spark, sf).agg(metrics.rate(F.coalesce(F.col("pred") == F.col("truth"), F.lit(False))).alias("accuracy"), F.count("*").alias("n"), F.count("pred").alias("n_answered"))


def _consensus_sql(x: str) -> str:
    """The consensus normalisation of a text column in DuckDB, which has no look-ahead."""
    words = rf"regexp_replace(translate(regexp_replace(replace(replace(replace(lower({x}), ',', ''), '?', ''), '''s', ' ''s'), '^\s+|\s+$', '', 'g'), chr(10) || chr(9), '  '), '^\s+|\s+$', '', 'g')"
    out = "w"
    for p in PUNCTUATION:
        q = p.replace("'", "''")
        out = f"replace({out}, '{q}', CASE WHEN contains(w, '{q} ') OR contains(w, ' {q}') OR regexp_matches(w, '[0-9],+[0-9]') THEN '' ELSE ' ' END)"
    out = rf"regexp_replace(regexp_replace({out}, '\.+(\.[0-9])', '\1', 'g'), '\.+([^0-9.]|$)', '\1', 'g')"
    table = lambda d: "MAP {" + ", ".join(f"'{k.replace(chr(39), chr(39) * 2)}': '{v.replace(chr(39), chr(39) * 2)}'" for k, v in d.items()) + "}"
    split = rf"list_filter(string_split_regex(lower(p), '\s+'), lambda t: t <> '')"
    number = f"list_transform({split}, lambda t: coalesce({table(NUMBER_WORDS)}[t], t))"
    kept = f"list_filter({number}, lambda t: t NOT IN ({', '.join(repr(a) for a in ARTICLES)}))"
    done = f"array_to_string(list_transform({kept}, lambda t: coalesce({table(CONTRACTIONS)}[t], t)), ' ')"
    return f"(SELECT {done} FROM (SELECT {out} AS p FROM (SELECT {words} AS w)))"


_ANSWERS_SQL = """
WITH a AS (SELECT user_id, event_id, CASE WHEN event_id % 2 = 0 THEN 'The ' ELSE '' END || event_type || CASE event_id % 3 WHEN 0 THEN '.' WHEN 1 THEN '!' ELSE '' END AS answer,
           row_number() OVER (PARTITION BY user_id ORDER BY event_id) AS k FROM events),
"""


#: Events whose numbers share all but their lowest bits are counted in one task.
BLOCK = 65_536


def _said() -> Column:
    return F.concat(F.when(F.col("event_id") % 2 == 0, "The ").otherwise(""), "event_type", F.when(F.col("event_id") % 3 == 0, ".").when(F.col("event_id") % 3 == 1, "!").otherwise(""))


def _answers(spark: SparkSession, sf: str) -> DataFrame:
    """(user_id, answers, n_answers, prediction): all answers of each user as structs (a, n) of distinct ones and their counts; the first one's plain word is the prediction.

    Answers are counted before they meet in a row, so a frequent user stays small.
    """
    kinds = read(spark, sf, "events").groupBy("user_id", _said().alias("a")).agg(F.count("*").alias("n"), F.min(F.struct("event_id", "event_type")).alias("first"))
    return kinds.groupBy("user_id").agg(F.array_sort(F.collect_list(F.struct("a", "n"))).alias("answers"), F.sum("n").cast("int").alias("n_answers"), F.min("first")["event_type"].alias("prediction"))


def _short(answers: str) -> Column:
    return F.transform(answers, lambda k: F.struct(textnorm.short_norm(k["a"]).alias("a"), k["n"].alias("n")))


_SOFT_SQL = (
    _ANSWERS_SQL
    + f"""n AS (SELECT user_id, k, {_consensus_sql("answer")} AS norm FROM a),
f AS (SELECT user_id, event_type AS said FROM events QUALIFY row_number() OVER (PARTITION BY user_id ORDER BY event_id) = 1),
c AS (SELECT user_id, CAST(count(*) AS DOUBLE) AS n, CAST(count(*) FILTER (WHERE norm = said) AS DOUBLE) AS m FROM n JOIN f USING (user_id) GROUP BY user_id),
r AS (SELECT user_id, CAST(n AS INTEGER) AS n_answers, CAST(m AS INTEGER) AS n_same, round((m * least(1.0, (m - 1) / 3) + (n - m) * least(1.0, m / 3)) / n, 9) AS soft, CAST(m > 0 AS DOUBLE) AS exact FROM c)
"""
)


@R.query(_SOFT_SQL + "SELECT user_id, n_answers, n_same, soft, exact FROM r")
def soft_accuracy(spark: SparkSession, sf: str) -> DataFrame:
    """Consensus score and exact match of a prediction for each user."""
    a = _answers(spark, sf).withColumn("m", metrics.counted_matches(F.col("answers"), F.col("prediction")))
    return a.select("user_id", "n_answers", F.col("m").cast("int").alias("n_same"), F.round(metrics.soft_score(F.col("n_answers"), F.col("m")), 9).alias("soft"), (F.col("m") > 0).cast("double").alias("exact"))


@R.query(
    _SOFT_SQL
    + "SELECT round(100 * sum(CASE WHEN user_id % 2 = 0 THEN exact ELSE soft END) / count(*), 6) AS accuracy, count(*) AS total, round(sum(CASE WHEN user_id % 2 = 0 THEN exact ELSE soft END), 6) AS score_sum FROM r"
)
def textual_accuracy(spark: SparkSession, sf: str) -> DataFrame:
    """Users with even ids are scored by exact match, as their set's name asks."""
    name = F.when(F.col("user_id") % 2 == 0, "val/obj_attack_read").otherwise("val/txt_clean")
    m = metrics.counted_matches(F.col("answers"), F.col("prediction"))
    score = F.when(textnorm.uses_exact_match(F.lit(""), name), (F.col("m") > 0).cast("double")).otherwise(metrics.soft_score(F.col("n_answers"), F.col("m")))
    s = _answers(spark, sf).withColumn("m", m).select(F.round(score, 9).alias("score"))
    return s.agg(F.round(metrics.percent(F.col("score")), 6).alias("accuracy"), F.count("*").alias("total"), F.round(F.sum("score"), 6).alias("score_sum"))


_TEXTS_SQL = "WITH t AS (SELECT doc_id AS id, 'documents' AS kind, text AS x FROM documents UNION ALL SELECT item_id, 'benchmark', text FROM benchmark), "


def _texts(spark: SparkSession, sf: str) -> DataFrame:
    d = read(spark, sf, "documents").select(F.col("doc_id").alias("id"), F.lit("documents").alias("kind"), F.col("text").alias("x"))
    return dealt(d).unionByName(read(spark, sf, "benchmark").select(F.col("item_id").alias("id"), F.lit("benchmark").alias("kind"), F.col("text").alias("x")))


def _digest(spark: SparkSession, sf: str, f) -> DataFrame:
    return _texts(spark, sf).select("id", "kind", f(F.col("x")).alias("y")).select("id", "kind", F.char_length("y").alias("length"), F.md5("y").alias("md5"))


_DIGEST_SQL = "SELECT id, kind, CAST(length(y) AS INTEGER) AS length, md5(y) AS md5 FROM n"


@R.query(_TEXTS_SQL + f"n AS (SELECT id, kind, {_consensus_sql('x')} AS y FROM t) " + _DIGEST_SQL)
def text_normalize_eval(spark: SparkSession, sf: str) -> DataFrame:
    """N08 over whole documents."""
    return _digest(spark, sf, textnorm.consensus_norm)


@R.query(_TEXTS_SQL + r"n AS (SELECT id, kind, regexp_replace(regexp_replace(regexp_replace(lower(x), '^\s+|\s+$', '', 'g'), '[^\p{L}\p{N}_\s:./-]', '', 'g'), '\s+', ' ', 'g') AS y FROM t) " + _DIGEST_SQL)
def text_normalize_short(spark: SparkSession, sf: str) -> DataFrame:
    """N03 over whole documents."""
    return _digest(spark, sf, textnorm.short_norm)


@R.query(_TEXTS_SQL + r"n AS (SELECT id, kind, regexp_replace(regexp_replace(regexp_replace(lower(x), '^\s+|\s+$', '', 'g'), '\s+', ' ', 'g'), '[^a-z0-9 ]+', '', 'g') AS y FROM t) " + _DIGEST_SQL)
def text_normalize_choice(spark: SparkSession, sf: str) -> DataFrame:
    """N01 over whole documents."""
    return _digest(spark, sf, textnorm.choice_norm)


@R.query(_TEXTS_SQL + r"n AS (SELECT id, kind, regexp_replace(lower(x), '[^\p{L}\p{N}_]+', '', 'g') AS y FROM t) " + _DIGEST_SQL)
def text_normalize_robust(spark: SparkSession, sf: str) -> DataFrame:
    """N02 over whole documents."""
    return _digest(spark, sf, textnorm.robust_norm)


# Texts with wide letters and digits, a ligature and letters apart from their accents: their normal forms are those of the plain texts.
@R.query(_TEXTS_SQL + r"n AS (SELECT id, kind, regexp_replace(lower(replace(x, 'e', 'é')), '[^\p{L}\p{N}_]+', '', 'g') AS y FROM t) " + _DIGEST_SQL)
def text_normalize_compatible(spark: SparkSession, sf: str) -> DataFrame:
    """Texts written in compatibility characters, whole documents; those with an odd number are translated alone, the others hold letters that combine."""
    wide = F.translate(F.regexp_replace("x", "fi", "ﬁ"), "abcdfgh0123456789", "ａｂｃｄｆｇｈ０１２３４５６７８９")
    apart = F.when(F.col("id") % 2 == 0, "e\u0301").otherwise("é")
    odd = _texts(spark, sf).select("id", "kind", F.replace(wide, F.lit("e"), apart).alias("x"))
    return odd.select("id", "kind", textnorm.robust_norm(F.col("x")).alias("y")).select("id", "kind", F.char_length("y").alias("length"), F.md5("y").alias("md5"))


@R.query(_TEXTS_SQL + r"n AS (SELECT id, kind, list_transform(regexp_extract_all(x, '[0-9]+(?:[.,][0-9]+)*'), lambda m: replace(m, ',', '')) AS y FROM t) SELECT id, kind, CAST(len(y) AS INTEGER) AS n, array_to_string(y, ' ') AS numbers FROM n")
def number_extract(spark: SparkSession, sf: str) -> DataFrame:
    """N12."""
    return _texts(spark, sf).select("id", "kind", textnorm.numbers_in(F.col("x")).alias("y")).select("id", "kind", F.size("y").alias("n"), F.array_join("y", " ").alias("numbers"))


@R.query(
    _TEXTS_SQL
    + r"n AS (SELECT id, kind, list_filter(list_transform(string_split_regex(lower(x), '[\s/:\-_,.;!?()\[\]{}]+'), lambda w: regexp_replace(w, '[^\p{L}\p{N}_]+', '', 'g')), lambda w: length(w) >= 3) AS y FROM t) SELECT id, kind, CAST(len(y) AS INTEGER) AS n, md5(array_to_string(y, ' ')) AS md5 FROM n"
)
def keyword_split(spark: SparkSession, sf: str) -> DataFrame:
    """N13."""
    return _texts(spark, sf).select("id", "kind", textnorm.keywords(F.col("x")).alias("y")).select("id", "kind", F.size("y").alias("n"), F.md5(F.array_join("y", " ")).alias("md5"))


@R.query(
    """WITH n AS (SELECT DISTINCT regexp_replace(lower(p_name), '[^a-z0-9_]+', '', 'g') AS x FROM part), t AS (SELECT DISTINCT regexp_replace(lower(p_type), '[^a-z0-9_]+', '', 'g') AS y FROM part)
SELECT x, y, CAST(levenshtein(x, y) AS INTEGER) AS distance, round(1 - levenshtein(x, y) / greatest(length(x), length(y)), 9) AS similarity FROM n CROSS JOIN t"""
)
def token_similarity(spark: SparkSession, sf: str) -> DataFrame:
    """Names against types, two small vocabularies."""
    p = read(spark, sf, "part")
    a, b = p.select(textnorm.robust_norm(F.col("p_name"), False).alias("x")).distinct(), p.select(textnorm.robust_norm(F.col("p_type"), False).alias("y")).distinct()
    return a.crossJoin(b).select("x", "y", F.levenshtein("x", "y").alias("distance"), F.round(textnorm.token_similarity(F.col("x"), F.col("y")), 9).alias("similarity"))


@R.query(
    """WITH n AS (SELECT DISTINCT p_name AS x FROM part), t AS (SELECT DISTINCT lower(p_type) AS y FROM part), s AS (SELECT x, i, m, substring(x, i, m) AS part FROM n, unnest(range(1, length(x) + 1)) a(i), unnest(range(1, length(x) - i + 2)) b(m))
SELECT n.x, y, CAST(coalesce(max(m), 0) AS INTEGER) AS length FROM n CROSS JOIN t LEFT JOIN s ON s.x = n.x AND contains(y, part) GROUP BY n.x, y"""
)
def longest_common_substring(spark: SparkSession, sf: str) -> DataFrame:
    """Names against types."""
    p = read(spark, sf, "part")
    a, b = p.select(F.col("p_name").alias("x")).distinct(), p.select(F.lower("p_type").alias("y")).distinct()
    return a.crossJoin(b).select("x", "y", textnorm.longest_common(F.col("x"), F.col("y")).alias("length"))


@R.query("SELECT o_orderkey, CAST(('0x' || substring(md5(concat_ws('__', CAST(o_orderkey AS VARCHAR), 'val', o_orderstatus, 'hash(image_id + pattern_id)')), 9, 8)) AS BIGINT) & 2147483647 AS seed FROM orders")
def seed_md5(spark: SparkSession, sf: str) -> DataFrame:
    """N22."""
    return read(spark, sf, "orders").select("o_orderkey", textnorm.seed_of(F.col("o_orderkey").cast("string"), F.lit("val"), F.col("o_orderstatus"), F.lit("hash(image_id + pattern_id)")).alias("seed"))


_SHORT = r"regexp_replace(regexp_replace(regexp_replace(lower(answer), '^\s+|\s+$', '', 'g'), '[^\p{L}\p{N}_\s:./-]', '', 'g'), '\s+', ' ', 'g')"
_KINDS_SQL = (
    _ANSWERS_SQL
    + f"""n AS (SELECT user_id, {_SHORT} AS norm FROM a), c AS (SELECT user_id, norm, count(*) AS n FROM n GROUP BY user_id, norm)
"""
)


@R.query(_KINDS_SQL + "SELECT user_id, norm AS answer FROM c QUALIFY row_number() OVER (PARTITION BY user_id ORDER BY n DESC, norm) = 1")
def majority_answer(spark: SparkSession, sf: str) -> DataFrame:
    """The most frequent normalised answer."""
    return _answers(spark, sf).select("user_id", L.majority_counted(_short("answers")).alias("answer"))


@R.query(_KINDS_SQL + "SELECT user_id, string_agg(norm, ', ' ORDER BY norm) AS answers FROM c GROUP BY user_id")
def combined_answers(spark: SparkSession, sf: str) -> DataFrame:
    """A10."""
    return _answers(spark, sf).select("user_id", L.combined(F.transform("answers", lambda k: textnorm.short_norm(k["a"]))).alias("answers"))


@R.query(
    _ANSWERS_SQL
    + "n AS (SELECT user_id, CASE WHEN k % 4 = 0 THEN 'unknown' ELSE lower(answer) END AS norm FROM a), c AS (SELECT user_id, norm, count(*) AS n FROM n WHERE norm <> 'unknown' GROUP BY user_id, norm) SELECT user_id, norm AS answer FROM c QUALIFY row_number() OVER (PARTITION BY user_id ORDER BY n DESC, norm) = 1"
)
def prompt_top_answer(spark: SparkSession, sf: str) -> DataFrame:
    """Every fourth answer is a stop answer."""
    place = F.row_number().over(Window.partitionBy("user_id", "block").orderBy("event_id"))
    e = read(spark, sf, "events").withColumn("block", F.floor(F.col("event_id") / BLOCK)).withColumn("place", place % 4)
    kinds = e.groupBy("user_id", "block", "place", _said().alias("a")).agg(F.count("*").alias("n"))
    before = F.coalesce(F.sum("n").over(Window.partitionBy("user_id").orderBy("block").rangeBetween(Window.unboundedPreceding, -1)), F.lit(0))
    word = F.when((F.col("place") + before) % 4 == 0, "unknown").otherwise(textnorm.plain_norm(F.col("a")))
    words = kinds.select("user_id", word.alias("a"), "n").groupBy("user_id", "a").agg(F.sum("n").alias("n")).groupBy("user_id").agg(F.collect_list(F.struct("a", "n")).alias("answers"))
    return words.select("user_id", L.top_counted(F.col("answers"), STOP_ANSWERS).alias("answer")).where("answer IS NOT NULL")


_GENERATED_SQL = """
WITH g AS (SELECT event_id, event_type, CASE event_id % 5 WHEN 0 THEN '{"Misleading": "' || upper(event_type) || '  word"}' WHEN 1 THEN 'Sure! {''misleading'' : ''' || event_type || ''',} done'
  WHEN 2 THEN '{"other": "x"} {"misleading":"late ' || event_type || '"}' WHEN 3 THEN 'misleading: ' || event_type ELSE 'nothing here' END AS s FROM events),
b AS (SELECT *, regexp_extract_all(s, '\\{[^{}]*\\}') AS blocks FROM g),
v AS (SELECT *, list_transform(blocks, lambda x: nullif(regexp_extract(regexp_replace(replace(x, '''', '"'), ',\\s*([}\\]])', '\\1', 'g'), '(?i)"misleading"\\s*:\\s*"([^"]*)"', 1), '')) AS vs FROM b),
c AS (SELECT event_id, event_type, regexp_replace(trim(lower(coalesce(list_filter(vs, lambda x: x IS NOT NULL)[1], CASE WHEN starts_with(lower(s), 'misleading:') THEN nullif(regexp_extract(s, '(?i)misleading\\s*[:=]\\s*[''"]?([\\w\\s]{1,30})[''"]?', 1), '') END))), '\\s+', ' ', 'g') AS word FROM v)
"""


@R.query(_GENERATED_SQL + "SELECT event_id, word, CASE WHEN word IS NULL THEN 'json_parse_failed' WHEN word = event_type THEN 'answer_overlap' ELSE 'ok' END AS reason FROM c")
def json_extract_repair(spark: SparkSession, sf: str) -> DataFrame:
    """The word that generated texts give, whole, broken, late, plain or not at all."""
    k = F.col("event_id") % 5
    s = (
        F.when(k == 0, F.concat(F.lit('{"Misleading": "'), F.upper("event_type"), F.lit('  word"}')))
        .when(k == 1, F.concat(F.lit("Sure! {'misleading' : '"), "event_type", F.lit("',} done")))
        .when(k == 2, F.concat(F.lit('{"other": "x"} {"misleading":"late '), "event_type", F.lit('"}')))
        .when(k == 3, F.concat(F.lit("misleading: "), "event_type"))
        .otherwise("nothing here")
    )
    g = read(spark, sf, "events").select("event_id", "event_type", parsing.json_field(s, "misleading").alias("word"))
    return g.select("event_id", "word", parsing.word_validity(F.col("word"), F.array("event_type")).alias("reason"))


@R.query(
    """WITH r AS (SELECT event_type, value > 30 AS judged, event_id % 10 = 0 AS skipped FROM events)
SELECT event_type, round((count(*) - sum(CAST(judged AS INTEGER))) / count(*), 9) AS failure_rate, coalesce(bool_and(CASE WHEN NOT skipped THEN judged END), true) AS all_correct FROM r GROUP BY event_type"""
)
def judged_rates(spark: SparkSession, sf: str) -> DataFrame:
    """Failure rates, and whether all that was judged is right."""
    e = read(spark, sf, "events").select("event_type", (F.col("value") > 30).alias("judged"), (F.col("event_id") % 10 == 0).alias("skipped"))
    return e.groupBy("event_type").agg(F.round(metrics.failure_rate(F.col("judged")), 9).alias("failure_rate"), metrics.all_correct(F.when(~F.col("skipped"), F.col("judged"))).alias("all_correct"))


QUERIES, ORACLE_SQL = R.queries, R.sql
