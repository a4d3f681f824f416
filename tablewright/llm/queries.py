"""The queries opN_<name> and the pipeline, as __spark_entry__.py registers them."""

from __future__ import annotations

from collections.abc import Callable

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from . import byte_bpe, decontaminate, embedding_dedup, hard_negatives, licenses, line_dedup, lm_score, packing, pii, simhash, toxicity, url_rules, vector_codes
from .common import table


def op1_best_fit_packing(spark: SparkSession, sf_dir: str) -> DataFrame:
    pieces = packing.pieces(table(spark, sf_dir, "documents"))
    return packing.pack(pieces.select("doc_id", "piece", "start", "length", F.crc32("ids").alias("ids_crc32")))


def op2_lm_scoring(spark: SparkSession, sf_dir: str) -> DataFrame:
    docs = lm_score.with_target(table(spark, sf_dir, "documents"), table(spark, sf_dir, "labels"))
    return lm_score.score(docs, lm_score.count(docs))


def op3_simhash_near_dedup(spark: SparkSession, sf_dir: str) -> DataFrame:
    return simhash.near_duplicates(table(spark, sf_dir, "documents"))


# Host, path and verdict of the rules.
RULES = [("net", "/", "block"), ("example.net", "/en/", "allow"), ("example.com", "/de/", "block"), ("org", "/fr/", "allow")]


OP4_SQL = """
WITH parts AS (
  SELECT page_id,
         coalesce(translate(regexp_extract(url, '(?s)^.*?://([^/?#]*)', 1), 'ABCDEFGHIJKLMNOPQRSTUVWXYZ', 'abcdefghijklmnopqrstuvwxyz'), '') AS host,
         coalesce(regexp_extract(url, '(?s)^.*?://[^/?#]*([^?#]*)', 1), '') AS path
  FROM pages
), rules(rule_host, rule_path, verdict) AS (
  VALUES ('net', '/', 'block'), ('example.net', '/en/', 'allow'), ('example.com', '/de/', 'block'), ('org', '/fr/', 'allow')
), fits AS (
  SELECT p.page_id, p.host, p.path, r.rule_host || r.rule_path AS rule, r.verdict,
         row_number() OVER (PARTITION BY p.page_id ORDER BY length(r.rule_host || r.rule_path) DESC NULLS LAST, length(r.rule_host) DESC) AS n
  FROM parts p LEFT JOIN rules r
    ON (p.host = r.rule_host OR ends_with(p.host, '.' || r.rule_host)) AND starts_with(p.path, r.rule_path)
)
SELECT page_id, host, path, rule, coalesce(verdict, 'allow') AS verdict FROM fits WHERE n = 1
"""


def op4_url_filters(spark: SparkSession, sf_dir: str) -> DataFrame:
    rules = spark.createDataFrame(RULES, "host string, path string, verdict string")
    return url_rules.judge(table(spark, sf_dir, "pages"), rules)


def op5_benchmark_decontamination(spark: SparkSession, sf_dir: str) -> DataFrame:
    return decontaminate.matches(table(spark, sf_dir, "documents"), table(spark, sf_dir, "benchmark"))


def op6_pii(spark: SparkSession, sf_dir: str) -> DataFrame:
    docs = table(spark, sf_dir, "documents")
    found = pii.find(docs, pii.train(pii.sample(docs)))
    order = F.array(*[F.lit(k) for k in pii.TAGGED])
    ranked = lambda spans: F.array_sort(F.transform(spans, lambda s: F.struct(s["start"].alias("start"), F.array_position(order, s["kind"]).alias("rank"), s["finish"].alias("finish"), s["kind"].alias("kind"))))
    text = lambda spans: F.array_join(F.transform(ranked(spans), lambda s: F.concat_ws(":", s["kind"], s["start"], s["finish"])), ",")
    counts = [F.size(F.filter("base", _is(kind))).cast("long").alias(f"n_{kind}") for kind in pii.KINDS]
    return found.select("doc_id", *counts, F.sha2(text(F.col("base")), 256).alias("base_sha256"), text(F.concat("base", "added")).alias("spans"), F.size("added").cast("long").alias("n_added"), F.size(F.filter("added", _is("secret"))).cast("long").alias("n_secret"))


def _is(kind: str):
    return lambda s: s["kind"] == kind


OP7_SQL = """
WITH RECURSIVE vectors AS (
  SELECT vec_id, label, embedding::DOUBLE[] AS v FROM embeddings
  WHERE label IS NOT NULL AND len(embedding) > 0 AND len(list_filter(embedding, lambda x: x IS NULL OR NOT isfinite(x))) = 0 AND len(list_filter(embedding, lambda x: x <> 0)) > 0
), links AS (
  SELECT a.vec_id AS a, b.vec_id AS b FROM vectors a JOIN vectors b
    ON a.label = b.label AND a.vec_id <> b.vec_id AND len(a.v) = len(b.v)
  WHERE list_cosine_similarity(a.v, b.v) >= 0.93
), reach(v, r) AS (
  SELECT vec_id, vec_id FROM embeddings UNION SELECT l.b, reach.r FROM reach JOIN links l ON l.a = reach.v
), least AS (SELECT v, min(r) AS component_id FROM reach GROUP BY v),
counts AS (SELECT a, count(*) AS n FROM links GROUP BY a)
SELECT e.vec_id, coalesce(c.n, 0) AS n_links, least.component_id, e.vec_id = least.component_id AS kept
FROM embeddings e JOIN least ON least.v = e.vec_id LEFT JOIN counts c ON c.a = e.vec_id
"""


def op7_embedding_near_dedup(spark: SparkSession, sf_dir: str) -> DataFrame:
    return embedding_dedup.near_duplicates(table(spark, sf_dir, "embeddings"))


def op8_license_scans(spark: SparkSession, sf_dir: str) -> DataFrame:
    return licenses.scan(table(spark, sf_dir, "documents")).withColumn("expressions", F.array_join("expressions", "; "))


# The shortest runs with 50 words from each line onward and up to each line; of equal runs all but the first are cut.
OP9_SQL = r"""
WITH docs AS (SELECT doc_id, text, string_split(coalesce(text, ''), chr(10)) AS lines FROM documents),
each AS (SELECT doc_id, unnest(lines) AS line, generate_subscripts(lines, 1) AS i FROM docs),
counted AS (SELECT doc_id, i, len(regexp_extract_all(line, '\S+')) AS words FROM each),
summed AS (SELECT *, sum(words) OVER (PARTITION BY doc_id ORDER BY i) AS upto FROM counted),
runs AS (
  SELECT a.doc_id, a.i AS first, b.i AS last FROM summed a JOIN summed b ON a.doc_id = b.doc_id AND b.i >= a.i
    AND b.upto - (a.upto - a.words) >= 50 AND b.upto - b.words - (a.upto - a.words) < 50
  UNION
  SELECT a.doc_id, a.i, b.i FROM summed a JOIN summed b ON a.doc_id = b.doc_id AND b.i >= a.i
    AND b.upto - (a.upto - a.words) >= 50 AND b.upto - a.upto < 50
), placed AS (
  SELECT r.doc_id, r.first, r.last, row_number() OVER (PARTITION BY array_to_string(d.lines[r.first:r.last], chr(10)) ORDER BY r.doc_id, r.first) AS copy
  FROM runs r JOIN docs d ON d.doc_id = r.doc_id
), cut AS (SELECT DISTINCT doc_id, unnest(range(first, last + 1)) AS i FROM placed WHERE copy > 1),
per AS (
  SELECT e.doc_id, count(c.i) AS deleted_lines, coalesce(string_agg(e.line, chr(10) ORDER BY e.i) FILTER (c.i IS NULL), '') AS kept
  FROM each e LEFT JOIN cut c ON c.doc_id = e.doc_id AND c.i = e.i GROUP BY e.doc_id
)
SELECT d.doc_id, per.deleted_lines, CASE WHEN d.text IS NOT NULL THEN length(per.kept) END AS left_chars, md5(per.kept) AS text_md5
FROM docs d JOIN per ON per.doc_id = d.doc_id
"""


def op9_line_dedup(spark: SparkSession, sf_dir: str) -> DataFrame:
    done = line_dedup.dedup_lines(table(spark, sf_dir, "documents"))
    return done.select("doc_id", "deleted_lines", F.length("text").cast("long").alias("left_chars"), F.md5(F.coalesce("text", F.lit(""))).alias("text_md5"))


def op10_toxicity(spark: SparkSession, sf_dir: str) -> DataFrame:
    docs = table(spark, sf_dir, "documents")
    held_out = F.crc32(F.col("doc_id").cast("string")) % 3 == 1
    machine = toxicity.train(docs, table(spark, sf_dir, "labels"), ~held_out)
    scores = toxicity.score(docs, machine)
    return scores.select("doc_id", F.coalesce(held_out, F.lit(False)).alias("held_out"), "score", (F.col("score") >= toxicity.THRESHOLD).cast("int").alias("predicted"))


OP11_SQL = """
WITH r AS MATERIALIZED (
  SELECT vec_id, CASE WHEN vec_id % 7 = 0 THEN (label + 1) % 10 ELSE label END AS label, list_transform(embedding, lambda x: floor(256 * x::DOUBLE)) AS q
  FROM embeddings WHERE vec_id IS NOT NULL AND label IS NOT NULL AND embedding IS NOT NULL AND len(list_filter(embedding, lambda x: x IS NULL OR NOT isfinite(x))) = 0
), scored AS MATERIALIZED (
  SELECT a.vec_id AS anchor_id, b.vec_id, a.label = b.label AS same, list_inner_product(a.q, b.q)::BIGINT AS score
  FROM r a JOIN r b ON len(a.q) = len(b.q) WHERE a.vec_id % 50 = 0
), positives AS (
  SELECT anchor_id, vec_id AS positive_id, score AS positive_score FROM scored WHERE same AND vec_id <> anchor_id
  QUALIFY row_number() OVER (PARTITION BY anchor_id ORDER BY score DESC, vec_id) <= 5
)
SELECT p.anchor_id, p.positive_id, (row_number() OVER (PARTITION BY p.anchor_id, p.positive_id ORDER BY n.score DESC, n.vec_id))::INTEGER AS rank,
       n.vec_id AS negative_id, p.positive_score, n.score AS negative_score
FROM positives p JOIN scored n ON n.anchor_id = p.anchor_id AND NOT n.same AND 50 * p.positive_score <= 100 * n.score AND 100 * n.score <= 95 * p.positive_score
QUALIFY rank <= 3
"""


def op11_hard_negatives(spark: SparkSession, sf_dir: str) -> DataFrame:
    return hard_negatives.mine(table(spark, sf_dir, "embeddings"))


def _op12_sql() -> str:
    """The rounds one after the other; a vector's parts have an equal number of components."""
    out = [
        """v AS MATERIALIZED (
  SELECT vec_id, label, row_number() OVER (ORDER BY vec_id) - 1 AS n, list_transform(embedding, lambda x: floor(1024 * x::DOUBLE)) AS q
  FROM embeddings WHERE embedding IS NOT NULL AND len(list_filter(embedding, lambda x: x IS NULL OR NOT isfinite(x))) = 0
)""",
        "x AS MATERIALIZED (SELECT v.n, r.p, v.q[r.p * (len(v.q) // 4) + 1 : (r.p + 1) * (len(v.q) // 4)] AS x FROM v, range(4) r(p))",
        "c0 AS MATERIALIZED (SELECT p, n AS entry, x AS c FROM x WHERE n < 256)",
    ]
    for k in range(vector_codes.ROUNDS + 1):
        # Distances are integers: the least of distance * 256 + entry has the first of the nearest entries.
        out.append(f"a{k} AS MATERIALIZED (SELECT x.n, x.p, min((list_inner_product(x.x, x.x) - 2 * list_inner_product(x.x, c.c) + list_inner_product(c.c, c.c))::BIGINT * 256 + c.entry) AS best FROM x JOIN c{k} c ON c.p = x.p GROUP BY x.n, x.p)")
        if k < vector_codes.ROUNDS:
            out.append(f"m{k} AS (SELECT a.p, a.best % 256 AS entry, i.i, floor(sum(x.x[i.i]) / count(*)) AS mean FROM a{k} a JOIN x ON x.n = a.n AND x.p = a.p, (SELECT unnest(range(1, 1 + (SELECT max(len(x)) FROM x))) AS i) i GROUP BY ALL)")
            out.append(f"c{k + 1} AS MATERIALIZED (SELECT c.p, c.entry, coalesce(m.c, c.c) AS c FROM c{k} c LEFT JOIN (SELECT p, entry, list(mean ORDER BY i) AS c FROM m{k} GROUP BY p, entry) m ON m.p = c.p AND m.entry = c.entry)")
    last = vector_codes.ROUNDS
    return f"""WITH {", ".join(out)},
coded AS (SELECT n, string_agg(printf('%02x', best % 256), '' ORDER BY p) AS code, sum(best // 256)::BIGINT AS error FROM a{last} GROUP BY n),
books AS (SELECT sha256(string_agg(array_to_string(list_transform(c, lambda v: v::BIGINT), ','), ',' ORDER BY p, entry)) AS codebooks_sha256 FROM c{last})
SELECT v.vec_id, coded.code, coded.error, (sum(coded.error) OVER (PARTITION BY v.label))::BIGINT AS label_error, books.codebooks_sha256
FROM v JOIN coded ON coded.n = v.n, books"""


def op12_vector_codes(spark: SparkSession, sf_dir: str) -> DataFrame:
    codes, books = vector_codes.compress(table(spark, sf_dir, "embeddings"))
    told = vector_codes.label_errors(codes)
    code = F.array_join(F.transform("code", lambda c: F.lower(F.lpad(F.hex(c), 2, "0"))), "")
    return told.select("vec_id", code.alias("code"), "error", "label_error", F.lit(vector_codes.fingerprint(books)).alias("codebooks_sha256"))


def op13_byte_bpe(spark: SparkSession, sf_dir: str) -> DataFrame:
    return byte_bpe.digest(byte_bpe.encode(table(spark, sf_dir, "documents").select("doc_id", "text")))


def queries() -> dict[str, Callable[[SparkSession, str], DataFrame]]:
    import corpus_pipeline

    own = {name: f for name, f in globals().items() if name.startswith("op") and name[2].isdigit()}
    return {**own, "pipeline": corpus_pipeline.run}


def oracles() -> dict[str, str]:
    import corpus_pipeline

    return {"op4_url_filters": OP4_SQL, "op7_embedding_near_dedup": OP7_SQL, "op9_line_dedup": OP9_SQL, "op11_hard_negatives": OP11_SQL, "op12_vector_codes": _op12_sql(), **({"pipeline": corpus_pipeline.ORACLE_SQL} if corpus_pipeline.ORACLE_SQL else {})}
