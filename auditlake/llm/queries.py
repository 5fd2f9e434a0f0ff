"""Registered queries of the numbered operators, with DuckDB statements where SQL can say the same."""

from __future__ import annotations

from collections.abc import Callable

from pyspark.sql import DataFrame, SparkSession, functions as F

from . import anchors as AN, classifier as CL, decontaminate as DC, jaccard as JC, language as LI, maxent as ME, mixing as MX, novelty as NO, pii as PI, quality as QU, spelling as SP, suffixes as SX, toxicity as TX
from .common import documents, only

Query = Callable[[SparkSession, str], DataFrame]
QUERIES: dict[str, Query] = {}
ORACLES: dict[str, str] = {}


def query(key: str, sql: str | None = None):
    def add(build: Query) -> Query:
        QUERIES[key] = build
        if sql is not None:
            ORACLES[key] = sql
        return build
    return add


@query("op1_decontaminate", r"""
WITH words AS (
  SELECT doc_id, regexp_extract_all(regexp_replace(coalesce(lower_az, ''), '[\x00-\x2F\x3A-\x60\x7B-\x7F]+', ' ', 'g'), '[^ ]+') AS w
  FROM (SELECT doc_id, translate(text, 'ABCDEFGHIJKLMNOPQRSTUVWXYZ', 'abcdefghijklmnopqrstuvwxyz') AS lower_az FROM documents)),
items AS (
  SELECT item_id, regexp_extract_all(regexp_replace(coalesce(translate(text, 'ABCDEFGHIJKLMNOPQRSTUVWXYZ', 'abcdefghijklmnopqrstuvwxyz'), ''), '[\x00-\x2F\x3A-\x60\x7B-\x7F]+', ' ', 'g'), '[^ ]+') AS w
  FROM benchmark),
item_windows AS (
  SELECT DISTINCT item_id, len(w) AS n, array_to_string(w, ' ') AS g FROM items WHERE len(w) BETWEEN 1 AND 12
  UNION
  SELECT DISTINCT item_id, 13, array_to_string(w[i:i + 12], ' ') FROM (SELECT item_id, w, unnest(range(1, len(w) - 11)) AS i FROM items WHERE len(w) >= 13)),
sizes AS (SELECT DISTINCT n FROM item_windows),
doc_windows AS (
  SELECT doc_id, n, i, array_to_string(w[i:i + n - 1], ' ') AS g
  FROM (SELECT doc_id, w, n, unnest(range(1, len(w) - n + 2)) AS i FROM words, sizes WHERE len(w) >= n)),
hits AS (SELECT d.doc_id, d.i, d.n, t.item_id FROM doc_windows d JOIN item_windows t ON d.n = t.n AND d.g = t.g),
n_hits AS (SELECT doc_id, count(DISTINCT p) AS n_hit FROM (SELECT doc_id, unnest(range(i, i + n)) AS p FROM hits) GROUP BY doc_id),
listed AS (
  SELECT doc_id, count(*) AS n_items, string_agg(item, ',' ORDER BY item) AS items
  FROM (SELECT DISTINCT doc_id, CAST(item_id AS VARCHAR) AS item FROM hits) GROUP BY doc_id)
SELECT doc_id, CAST(len(w) AS BIGINT) AS n_words, CAST(coalesce(n_hit, 0) AS BIGINT) AS n_hit, CAST(coalesce(n_items, 0) AS BIGINT) AS n_items,
  sha256(coalesce(items, '')) AS items_sha256, coalesce(n_hit, 0) > 0 AND 20 * coalesce(n_hit, 0) >= len(w) AS contaminated
FROM words LEFT JOIN n_hits USING (doc_id) LEFT JOIN listed USING (doc_id)
""")
def op1(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Contamination of every document by the whole benchmark."""
    found = DC.contamination(documents(spark, sf_dir), spark.read.parquet(f"{sf_dir}/benchmark.parquet"))
    return found.select(
        F.col("id").alias("doc_id"), "n_words", "n_hit", F.size("items").cast("long").alias("n_items"),
        F.sha2(F.array_join("items", ",").cast("binary"), 256).alias("items_sha256"), "contaminated")


def fold_of(modulus: int):
    return F.crc32(F.col("doc_id").cast("string")) % modulus


def in_fold(modulus: int, fold: int):
    """Whether the id is in a fold; a null id is in none."""
    return F.coalesce(fold_of(modulus) == fold, F.lit(False)).alias("held_out")


@query("op8_toxicity")
def op8(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Toxicity of every document."""
    docs = documents(spark, sf_dir)
    model = TX.fit(docs, spark.read.parquet(f"{sf_dir}/labels.parquet"))
    return TX.score_documents(only(docs, doc_id="doc_id", text="text"), model).select(
        "doc_id", in_fold(TX.FOLDS, TX.HELD_OUT), F.col("tox_score").alias("score"),
        F.expr("int(tox_score >= 0.5)").alias("predicted"))


@query("op9_mixing")
def op9(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Words that the mix takes from every document."""
    return MX.mixed_documents(documents(spark, sf_dir)).withColumnRenamed("id", "doc_id")


@query("op10_pii")
def op10(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Personal data in every document."""
    found = PI.find(documents(spark, sf_dir))
    of_kind = lambda k: F.size(F.filter("pii_base", lambda s: s["kind"] == PI.BASE.index(k))).cast("long").alias(f"n_{k}")
    return found.select(
        F.col("id").alias("doc_id"), *(of_kind(k) for k in PI.BASE),
        F.sha2(PI.written(F.array_sort("pii_base")).cast("binary"), 256).alias("base_sha256"), PI.written(F.col("pii_spans")).alias("spans"))


@query("op3_ngram_jaccard", r"""
WITH RECURSIVE words AS (
  SELECT doc_id, regexp_extract_all(coalesce(translate(text, 'ABCDEFGHIJKLMNOPQRSTUVWXYZ', 'abcdefghijklmnopqrstuvwxyz'), ''), '[^\x20\x09-\x0D]+') AS w FROM documents),
tokens AS (
  SELECT DISTINCT doc_id, array_to_string(w[i:i + 2], ' ') AS g FROM (SELECT doc_id, w, unnest(range(1, len(w) - 1)) AS i FROM words WHERE len(w) >= 3)
  UNION ALL
  SELECT doc_id, array_to_string(w, ' ') FROM words WHERE len(w) IN (1, 2)),
sizes AS (SELECT doc_id, count(*) AS n FROM tokens GROUP BY doc_id),
shared AS (SELECT a.doc_id AS a, b.doc_id AS b, count(*) AS k FROM tokens a JOIN tokens b ON a.g = b.g AND a.doc_id <> b.doc_id GROUP BY ALL),
links AS (SELECT a, b FROM shared JOIN sizes x ON x.doc_id = a JOIN sizes y ON y.doc_id = b WHERE 100 * k >= 90 * (x.n + y.n - k)),
reach(a, b) AS (SELECT a, b FROM links UNION SELECT reach.a, links.b FROM reach JOIN links ON reach.b = links.a)
SELECT doc_id, CAST(coalesce(n, 0) AS BIGINT) AS n_shingles, least(doc_id, coalesce(m, doc_id)) AS component_id
FROM words LEFT JOIN sizes USING (doc_id) LEFT JOIN (SELECT a AS doc_id, min(b) AS m FROM reach GROUP BY a) USING (doc_id)
""")
def op3(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Components of documents whose sets of three-word shingles have a Jaccard similarity of 0.9 or more."""
    found = JC.near_duplicates(documents(spark, sf_dir), n=3, threshold="0.9")
    return found.select(F.col("id").alias("doc_id"), F.col("size").alias("n_shingles"), F.col("component").alias("component_id"))


@query("op4_quality")
def op4(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Plain quality counts and the verdict on every document."""
    docs = documents(spark, sf_dir)
    model = QU.fit(docs, spark.read.parquet(f"{sf_dir}/labels.parquet"))
    return QU.score_documents(only(docs, doc_id="doc_id", text="text"), model).drop("text")


@query("op7_language")
def op7(spark: SparkSession, sf_dir: str) -> DataFrame:
    """The language of every document."""
    docs = documents(spark, sf_dir)
    model = LI.fit(docs.where(fold_of(LI.FOLDS) != LI.HELD_OUT))
    return LI.identify(only(docs, doc_id="doc_id", text="text"), model).select(
        "doc_id", in_fold(LI.FOLDS, LI.HELD_OUT), "lang_pred", F.col("lang_score").alias("score"))


@query("op2_suffix_dedup", r"""
WITH bytes AS (SELECT doc_id, hex(encode(coalesce(text, ''))) AS x FROM documents),
parts AS (  -- 200 starts each
  SELECT doc_id, j, n, substr(x, 400 * j + 1, 598) AS y
  FROM (SELECT doc_id, x, len(x) // 2 - 99 AS n, unnest(range(0, greatest((len(x) // 2 + 100) // 200, 0))) AS j FROM bytes)),
starts AS (SELECT doc_id, y, 200 * j AS s, unnest(range(0, least(200, n - 200 * j))) AS o FROM parts),
strings AS (SELECT doc_id, s + o AS i, row_number() OVER (PARTITION BY md5_number(substr(y, 2 * o + 1, 200)) ORDER BY doc_id, s + o) AS k FROM starts),
later AS (SELECT doc_id, i, max(i) OVER (PARTITION BY doc_id ORDER BY i ROWS BETWEEN UNBOUNDED PRECEDING AND 1 PRECEDING) AS j FROM strings WHERE k > 1),
spans AS (
  SELECT doc_id, sum(CASE WHEN j IS NULL OR i > j + 100 THEN 1 ELSE 0 END) OVER (PARTITION BY doc_id ORDER BY i) AS span, i FROM later),
cuts AS (SELECT doc_id, span, min(i) AS lo, max(i) + 100 AS hi FROM spans GROUP BY doc_id, span),
pieces AS (
  SELECT doc_id, lo, hi, lead(lo) OVER (PARTITION BY doc_id ORDER BY lo) AS nxt, row_number() OVER (PARTITION BY doc_id ORDER BY lo) AS r FROM cuts),
kept AS (
  SELECT doc_id, count(*) AS n_spans, sum(hi - lo) AS n_removed, string_agg(CASE WHEN r = 1 THEN substr(x, 1, 2 * lo) ELSE '' END || substr(x, 2 * hi + 1, 2 * coalesce(nxt - hi, len(x))), '' ORDER BY lo) AS rest
  FROM pieces JOIN bytes USING (doc_id) GROUP BY doc_id)
SELECT doc_id, CAST(len(x) // 2 AS BIGINT) AS n_bytes, CAST(coalesce(n_removed, 0) AS BIGINT) AS n_removed,
  CAST(coalesce(n_spans, 0) AS BIGINT) AS n_spans, sha256(unhex(coalesce(rest, x))) AS kept_sha256
FROM bytes LEFT JOIN kept USING (doc_id)
""")
def op2(spark: SparkSession, sf_dir: str) -> DataFrame:
    """What stays of every document once repeated strings of 100 bytes are gone."""
    return SX.digests(documents(spark, sf_dir)).withColumnRenamed("id", "doc_id")


@query("op5_lm_scoring")
def op5(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Log probability of every document."""
    held_out = F.crc32(F.col("id").cast("string")) % ME.FOLDS == ME.HELD_OUT
    found = ME.score_documents(documents(spark, sf_dir), held_out)
    return found.select(F.col("id").alias("doc_id"), F.coalesce(held_out, F.lit(False)).alias("held_out"), "n_tokens", "n_known", "train_tokens", "base_score", "score")


@query("op6_quality_classifier")
def op6(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Weak label, score and verdict on every document."""
    docs = only(documents(spark, sf_dir), doc_id="doc_id", text="text")
    return CL.score_documents(docs, CL.fit(docs)).drop("text").withColumnRenamed("quality_score", "score")


@query("op11_spelling", r"""
WITH RECURSIVE bits(i, k, c) AS (  -- checksum table of one byte
  SELECT i, 0, i FROM (SELECT unnest(range(0, 256)) AS i)
  UNION ALL SELECT i, k + 1, CASE WHEN c % 2 = 1 THEN xor(c // 2, 3988292384) ELSE c // 2 END FROM bits WHERE k < 8),
sums AS (SELECT list(c ORDER BY i) AS t FROM bits WHERE k = 8),
runs AS (
  SELECT coalesce(CAST(doc_id AS VARCHAR), '') AS d, unnest(regexp_extract_all(coalesce(translate(text, 'ABCDEFGHIJKLMNOPQRSTUVWXYZ', 'abcdefghijklmnopqrstuvwxyz'), ''), '[A-Za-zÀ-ÿ]+')) AS w
  FROM documents),
marked AS (SELECT DISTINCT d, w FROM runs WHERE length(w) >= 6),
checked AS (
  SELECT d, w, xor(4294967295, list_reduce(list_prepend(4294967295, flatten(list_transform(string_split(d || ':' || w, ''), lambda x: CASE WHEN unicode(x) < 128 THEN [CAST(unicode(x) AS BIGINT)] ELSE [195, CAST(unicode(x) AS BIGINT) - 64] END))),
    lambda c, b: xor(c // 256, t[xor(c, b) % 256 + 1]))) AS h
  FROM marked, sums),
changed AS (SELECT w, d, CASE WHEN h % 199 = 0 THEN substr(w, 1, CAST(h % length(w) AS INT)) || substr(w, CAST(h % length(w) AS INT) + 2) ELSE w END AS word FROM checked),
words AS (SELECT word, count(*) AS n FROM runs JOIN changed USING (d, w) WHERE length(word) >= 6 GROUP BY word HAVING count(*) >= 5),
cuts AS (SELECT word, n, i, substr(word, 1, i - 1) || substr(word, i + 1) AS cut FROM (SELECT word, n, unnest(range(1, length(word) + 1)) AS i FROM words)),
near AS (
  SELECT DISTINCT a.word AS word, b.word AS other, b.n AS m FROM cuts a JOIN cuts b ON a.cut = b.cut AND a.i = b.i AND a.word <> b.word
  UNION
  SELECT a.word, b.word, b.n FROM cuts a JOIN words b ON a.cut = b.word
  UNION
  SELECT b.word, a.word, a.n FROM cuts a JOIN words b ON a.cut = b.word),
best AS (SELECT word, count(*) AS n_near, max(m) AS m FROM near GROUP BY word),
forms AS (
  SELECT w.word, n, coalesce(n_near, 0) AS n_near, CASE WHEN m >= 5 * n THEN m END AS form_n,
    CASE WHEN m >= 5 * n THEN (SELECT min(other) FROM near x WHERE x.word = w.word AND x.m = b.m) END AS form
  FROM words w LEFT JOIN best b USING (word)),
walk(word, root, k) AS (
  SELECT word, word, 0 FROM forms UNION ALL SELECT walk.word, forms.form, k + 1 FROM walk JOIN forms ON forms.word = walk.root WHERE form IS NOT NULL)
SELECT f.word, form, root, CAST(n AS BIGINT) AS n, CAST(n_near AS BIGINT) AS n_near, CAST(form_n AS BIGINT) AS form_n
FROM forms f JOIN (SELECT word, arg_max(root, k) AS root FROM walk GROUP BY word) USING (word)
""")
def op11(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Forms and roots of all words of all documents."""
    return SP.spelling_variants(documents(spark, sf_dir))


@query("op13_vector_codes", r"""
WITH kept AS (SELECT vec_id, label, embedding AS e FROM embeddings WHERE embedding IS NOT NULL AND list_bool_and(list_transform(embedding, lambda y: y IS NOT NULL AND isfinite(y)))),
flat AS (SELECT vec_id, label, len(e) // 16 AS width, unnest(range(0, len(e))) AS i, unnest(list_transform(e, lambda y: CAST(floor(256 * CAST(y AS DOUBLE)) AS BIGINT))) AS v FROM kept),
x AS (SELECT vec_id, label, i // width AS part, i % width AS dim, v FROM flat),
b0 AS (SELECT part, entry, dim, v AS c FROM x JOIN (SELECT vec_id, row_number() OVER (ORDER BY vec_id) - 1 AS entry FROM kept ORDER BY vec_id LIMIT 64) USING (vec_id)),
d0 AS (SELECT vec_id, label, part, entry, sum((v - c) * (v - c)) AS d FROM x JOIN b0 USING (part, dim) GROUP BY ALL),
a0 AS (SELECT vec_id, label, part, arg_min(entry, d * 64 + entry) AS entry, min(d) AS d FROM d0 GROUP BY ALL),
b1 AS (
  SELECT part, entry, dim, coalesce(CAST((s - ((s % n) + n) % n) // n AS BIGINT), c) AS c
  FROM b0 LEFT JOIN (SELECT part, entry, dim, CAST(sum(v) AS BIGINT) AS s, count(*) AS n FROM a0 JOIN x USING (vec_id, part) GROUP BY ALL) USING (part, entry, dim)),
d1 AS (SELECT vec_id, label, part, entry, sum((v - c) * (v - c)) AS d FROM x JOIN b1 USING (part, dim) GROUP BY ALL),
a1 AS (SELECT vec_id, label, part, arg_min(entry, d * 64 + entry) AS entry, min(d) AS d FROM d1 GROUP BY ALL),
b2 AS (
  SELECT part, entry, dim, coalesce(CAST((s - ((s % n) + n) % n) // n AS BIGINT), c) AS c
  FROM b1 LEFT JOIN (SELECT part, entry, dim, CAST(sum(v) AS BIGINT) AS s, count(*) AS n FROM a1 JOIN x USING (vec_id, part) GROUP BY ALL) USING (part, entry, dim)),
d2 AS (SELECT vec_id, label, part, entry, sum((v - c) * (v - c)) AS d FROM x JOIN b2 USING (part, dim) GROUP BY ALL),
a2 AS (SELECT vec_id, label, part, arg_min(entry, d * 64 + entry) AS entry, min(d) AS d FROM d2 GROUP BY ALL),
coded AS (
  SELECT vec_id, label, string_agg(lower(printf('%02x', CAST(entry AS INT))), '' ORDER BY part) AS code, CAST(sum(d) AS BIGINT) AS error FROM a2 GROUP BY vec_id, label)
SELECT vec_id, code, error, CAST(sum(error) OVER (PARTITION BY label) AS BIGINT) AS label_error,
  (SELECT sha256(string_agg(CAST(c AS VARCHAR), ',' ORDER BY part, entry, dim)) FROM b2) AS codebooks_sha256
FROM coded
""")
def op13(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Codes and errors of all vectors."""
    return AN.compressed(spark.read.parquet(f"{sf_dir}/embeddings.parquet"))


@query("op12_secrets")
def op12(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Secrets in every document."""
    found = NO.find(documents(spark, sf_dir))
    of_kind = lambda k: F.size(F.filter("secrets", lambda s: s["kind"] == NO.KINDS.index(k))).cast("long").alias(f"n_{k}")
    base = F.filter("secrets", lambda s: s["kind"] < len(NO.BASE))
    return found.select(
        F.col("id").alias("doc_id"), *(of_kind(k) for k in NO.BASE),
        F.sha2(NO.written(base).cast("binary"), 256).alias("base_sha256"), NO.written(F.col("secrets")).alias("spans"))
