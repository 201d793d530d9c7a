"""Aggregates: health counts, histograms, percentiles, duplicates, merges."""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import Window as W
from pyspark.sql import functions as F

from corvane.functions import text as T
from corvane.plans.registry import query
from corvane.sources.tables import SQL, edges, read, wiki


@query("agg_01_content_health", SQL + "SELECT type, grade, count(*) AS n, count(*) FILTER (WHERE length(body) < 200) AS thin, count(*) FILTER (WHERE NOT EXISTS (SELECT 1 FROM edges e WHERE e.target_id = wiki.id)) AS orphans FROM wiki GROUP BY type, grade")
def content_health(spark, sf_dir) -> DataFrame:
    """Pages, thin pages and pages that nothing points to, by type and grade."""
    known = edges(spark, sf_dir).select(F.col("target_id").alias("id")).distinct().withColumn("linked", F.lit(True))
    pages = wiki(spark, sf_dir).select("id", "type", "grade", F.length("body").alias("n_body")).join(known, "id", "left")
    return pages.groupBy("type", "grade").agg(F.count("*").alias("n"), F.count_if(F.col("n_body") < 200).alias("thin"), F.count_if(F.col("linked").isNull()).alias("orphans"))


@query("agg_02_tag_index", "SELECT prefix, name, count(*) AS n FROM (SELECT 'lang' AS prefix, lang AS name FROM documents UNION ALL SELECT 'source', source FROM documents) GROUP BY ALL")
def tag_index(spark, sf_dir) -> DataFrame:
    """Counts of tags by prefix and value."""
    tags = read(spark, sf_dir, "documents").select(F.explode(F.array(F.concat(F.lit("lang/"), "lang"), F.concat(F.lit("source/"), "source"))).alias("tag"))
    return tags.groupBy(F.split_part("tag", F.lit("/"), F.lit(1)).alias("prefix"), F.split_part("tag", F.lit("/"), F.lit(2)).alias("name")).agg(F.count("*").alias("n"))


@query("agg_04_broken_links", SQL + "SELECT count(*) AS links, count(DISTINCT CASE WHEN target_id NOT IN (SELECT id FROM wiki) THEN target_id END) AS broken FROM edges")
def broken_links(spark, sf_dir) -> DataFrame:
    """All link occurrences, but distinct broken targets."""
    known = wiki(spark, sf_dir).select(F.col("id").alias("target_id"), F.lit(True).alias("known"))
    return edges(spark, sf_dir).join(known, "target_id", "left").agg(F.count("*").alias("links"), F.count_distinct(F.when(F.col("known").isNull(), F.col("target_id"))).alias("broken"))


@query("agg_06_synthesis_count", SQL + "SELECT count(*) AS n FROM wiki WHERE type = 'synthesis'")
def synthesis_count(spark, sf_dir) -> DataFrame:
    return wiki(spark, sf_dir).where("type = 'synthesis'").agg(F.count("*").alias("n"))


@query("agg_09_weighted_total", "SELECT doc_id, round(0.6 * quality + 0.4 * (1 - toxic), 4)::DOUBLE AS total FROM labels")
def weighted_total(spark, sf_dir) -> DataFrame:
    return read(spark, sf_dir, "labels").select("doc_id", F.round(0.6 * F.col("quality") + 0.4 * (1 - F.col("toxic")), 4).alias("total"))


@query("agg_10_judgment", "SELECT conv_id, CASE WHEN min(length(text) % 100) < 2 THEN 'reject' WHEN avg(length(text) % 100) / 100 >= 0.4 THEN 'pass' ELSE 'quarantine' END AS verdict, round(avg(length(text) % 100) / 100, 6) AS mean FROM conversations GROUP BY conv_id")
def judgment(spark, sf_dir) -> DataFrame:
    """Votes by turn: one very low vote is a veto, else their mean decides."""
    votes = read(spark, sf_dir, "conversations").select("conv_id", (F.length("text") % 100).alias("v"))
    per = votes.groupBy("conv_id").agg(F.min("v").alias("least"), (F.avg("v") / 100).alias("mean"))
    return per.select("conv_id", F.when(F.col("least") < 2, "reject").when(F.col("mean") >= 0.4, "pass").otherwise("quarantine").alias("verdict"), F.round("mean", 6).alias("mean"))


@query("agg_12_verdicts", "SELECT CASE WHEN 0.6 * quality + 0.4 * (1 - toxic) >= 0.7 THEN 'pass' ELSE 'reject' END AS verdict, count(*) AS n FROM labels GROUP BY 1")
def verdicts(spark, sf_dir) -> DataFrame:
    total = 0.6 * F.col("quality") + 0.4 * (1 - F.col("toxic"))
    return read(spark, sf_dir, "labels").groupBy(F.when(total >= 0.7, "pass").otherwise("reject").alias("verdict")).agg(F.count("*").alias("n"))


@query("agg_14_dedup_evidence", "SELECT lower(substr(text, 1, 200)) AS key, min(conv_id * 1000 + turn) AS first, max(turn) AS turn FROM conversations WHERE text <> '' GROUP BY 1")
def dedup_evidence(spark, sf_dir) -> DataFrame:
    """Quotes with the same first 200 characters are one: the first, with the largest turn."""
    return read(spark, sf_dir, "conversations").where("text <> ''").groupBy(F.lower(F.substring("text", 1, 200)).alias("key")).agg(F.min(F.col("conv_id") * 1000 + F.col("turn")).alias("first"), F.max("turn").alias("turn"))


@query("agg_16_merge_analysis", "SELECT source AS slug, max(n_chars) AS confidence, min(doc_id) FILTER (WHERE n_chars = m) AS best, count(DISTINCT lang) AS n_langs FROM (SELECT *, max(n_chars) OVER (PARTITION BY source) AS m FROM documents) GROUP BY source")
def merge_analysis(spark, sf_dir) -> DataFrame:
    """By slug the most confident entry (the first of equals) and the number of languages."""
    best = F.max(F.struct("n_chars", (-F.col("doc_id")).alias("d")))
    return read(spark, sf_dir, "documents").groupBy(F.col("source").alias("slug")).agg(F.max("n_chars").alias("confidence"), (-best["d"]).alias("best"), F.count_distinct("lang").alias("n_langs"))


@query("agg_17_relation_stats", SQL + ", i AS (SELECT e.*, target_id IN (SELECT id FROM wiki) AS known FROM edges e) SELECT count(*) AS total, count(*) FILTER (WHERE NOT known) AS unresolved, round(count(*) FILTER (WHERE known) / count(*), 6) AS ratio FROM i")
def relation_stats(spark, sf_dir) -> DataFrame:
    known = wiki(spark, sf_dir).select(F.col("id").alias("target_id"), F.lit(True).alias("known"))
    return edges(spark, sf_dir).join(known, "target_id", "left").agg(F.count("*").alias("total"), F.count_if(F.col("known").isNull()).alias("unresolved"), F.round(F.count("known") / F.count("*"), 6).alias("ratio"))


@query("agg_18_duplicate_rate", "WITH h AS (SELECT md5(text) AS h, count(*) AS n FROM documents GROUP BY 1) SELECT sum(n - 1)::BIGINT AS duplicates, round(sum(n - 1) / sum(n), 6) AS rate FROM h")
def duplicate_rate(spark, sf_dir) -> DataFrame:
    h = read(spark, sf_dir, "documents").groupBy(F.md5("text").alias("h")).agg(F.count("*").alias("n"))
    return h.agg(F.sum(F.col("n") - 1).alias("duplicates"), F.round(F.sum(F.col("n") - 1) / F.sum("n"), 6).alias("rate"))


@query("agg_20_knowledge_units", "SELECT source, lang, count(*) AS n_claims, min(doc_id) AS first, max(doc_id) AS last, round(avg(n_chars), 6) AS confidence, max(n_chars) AS latest FROM documents GROUP BY source, lang")
def knowledge_units(spark, sf_dir) -> DataFrame:
    """By source and language its claims' number, first and last, their mean and their largest value."""
    g = read(spark, sf_dir, "documents").groupBy("source", "lang")
    return g.agg(F.count("*").alias("n_claims"), F.min("doc_id").alias("first"), F.max("doc_id").alias("last"), F.round(F.avg("n_chars"), 6).alias("confidence"), F.max("n_chars").alias("latest"))


BUCKETS = (10, 50, 100, 500)


@query("agg_24_histogram", "SELECT event_type, b AS le, count(*) FILTER (WHERE value <= b) AS n FROM events, (VALUES (10), (50), (100), (500)) t(b) GROUP BY event_type, b")
def histogram(spark, sf_dir) -> DataFrame:
    """Cumulative bucket counts by label."""
    per = read(spark, sf_dir, "events").groupBy("event_type").agg(*(F.count_if(F.col("value") <= b).alias(str(b)) for b in BUCKETS))
    return per.unpivot("event_type", [str(b) for b in BUCKETS], "le", "n").withColumn("le", F.col("le").cast("int"))


@query("agg_25_counter", "SELECT event_type, count(*) AS n, round(sum(value), 2) AS total FROM events GROUP BY event_type")
def counter(spark, sf_dir) -> DataFrame:
    return read(spark, sf_dir, "events").groupBy("event_type").agg(F.count("*").alias("n"), F.round(F.sum("value"), 2).alias("total"))


@query("agg_26_gauge", "SELECT user_id, arg_max(value, (ts, event_id)) AS value FROM events GROUP BY user_id")
def gauge(spark, sf_dir) -> DataFrame:
    """The last value of each label."""
    return read(spark, sf_dir, "events").groupBy("user_id").agg(F.max_by("value", F.struct("ts", "event_id")).alias("value"))


@query("agg_29_percentiles", "SELECT lang, round(quantile_cont(n_chars, 0.5), 6) AS p50, round(quantile_cont(n_chars, 0.9), 6) AS p90, round(quantile_cont(n_chars, 0.99), 6) AS p99 FROM documents GROUP BY lang")
def percentiles(spark, sf_dir) -> DataFrame:
    """Linearly interpolated."""
    return read(spark, sf_dir, "documents").groupBy("lang").agg(*(F.round(F.percentile("n_chars", p / 100), 6).alias(f"p{p}") for p in (50, 90, 99)))


@query("agg_30_bins", "SELECT n_chars // 200 * 200 AS bin, count(*) AS n FROM documents GROUP BY 1")
def bins(spark, sf_dir) -> DataFrame:
    return read(spark, sf_dir, "documents").groupBy((F.floor(F.col("n_chars") / 200) * 200).alias("bin")).agg(F.count("*").alias("n"))


@query("agg_32_synthesis_candidates", SQL + "SELECT category, count(*) AS n, count(DISTINCT source) AS n_sources FROM wiki WHERE type = 'concept' AND trim(category) <> '' GROUP BY category HAVING count(DISTINCT source) >= 2")
def synthesis_candidates(spark, sf_dir) -> DataFrame:
    """Categories of concepts from two sources or more."""
    c = wiki(spark, sf_dir).where("type = 'concept' and trim(category) <> ''")
    return c.groupBy("category").agg(F.count("*").alias("n"), F.count_distinct("source").alias("n_sources")).where("n_sources >= 2")


@query("agg_34_duplicate_titles", SQL + "SELECT title, count(*) AS n, min(doc_id) AS first FROM wiki GROUP BY title HAVING count(*) > 1")
def duplicate_titles(spark, sf_dir) -> DataFrame:
    return wiki(spark, sf_dir).groupBy("title").agg(F.count("*").alias("n"), F.min("doc_id").alias("first")).where("n > 1")


@query("win_03_retention", "WITH r AS (SELECT event_id, user_id, event_type, row_number() OVER (PARTITION BY user_id ORDER BY ts DESC, event_id DESC) AS k FROM events) SELECT event_id, user_id FROM r WHERE k <= 5 OR event_type = 'purchase'")
def retention(spark, sf_dir) -> DataFrame:
    """The newest five of each object, and all of its key states."""
    return newest(read(spark, sf_dir, "events"), 5).where("k <= 5 or event_type = 'purchase'").select("event_id", "user_id")


def newest(versions: DataFrame, n: int) -> DataFrame:
    """versions with k, their rank within the object from the newest on."""
    return versions.withColumn("k", F.row_number().over(W.partitionBy("user_id").orderBy(F.desc("ts"), F.desc("event_id"))))


@query("win_04_newest", "SELECT event_id, user_id FROM (SELECT *, row_number() OVER (PARTITION BY user_id ORDER BY ts DESC, event_id DESC) AS k FROM events) WHERE k <= 10")
def newest_ten(spark, sf_dir) -> DataFrame:
    return newest(read(spark, sf_dir, "events"), 10).where("k <= 10").select("event_id", "user_id")


@query("win_05_batch_reconcile", SQL + "SELECT source, type, arg_min(id, (grade, doc_id)) AS winner, count(*) AS n, array_to_string(list_sort(list(DISTINCT category)), ',') AS categories FROM wiki GROUP BY source, type")
def batch_reconcile(spark, sf_dir) -> DataFrame:
    """By source and type the best-graded page wins (the first of equals); categories are united."""
    return wiki(spark, sf_dir).groupBy("source", "type").agg(F.min_by("id", F.struct("grade", "doc_id")).alias("winner"), F.count("*").alias("n"), F.array_join(F.sort_array(F.collect_set("category")), ",").alias("categories"))


@query("win_08_latest", "SELECT user_id, max(ts) AS ts, arg_max(event_id, (ts, event_id)) AS event_id FROM events GROUP BY user_id")
def latest(spark, sf_dir) -> DataFrame:
    return read(spark, sf_dir, "events").groupBy("user_id").agg(F.max("ts").alias("ts"), F.max_by("event_id", F.struct("ts", "event_id")).alias("event_id"))


@query("win_09_changed_versions", "SELECT event_id, user_id FROM (SELECT *, lag(event_type) OVER (PARTITION BY user_id ORDER BY ts, event_id) AS before FROM events) WHERE before IS DISTINCT FROM event_type")
def changed_versions(spark, sf_dir) -> DataFrame:
    """A version equal to the one before it isn't kept."""
    before = F.lag("event_type").over(W.partitionBy("user_id").orderBy("ts", "event_id"))
    return read(spark, sf_dir, "events").withColumn("before", before).where(~F.col("before").eqNullSafe(F.col("event_type"))).select("event_id", "user_id")


@query("jn_03_broken_references", SQL + "SELECT source_id, target_id FROM edges WHERE target_id NOT IN (SELECT id FROM wiki)")
def broken_references(spark, sf_dir) -> DataFrame:
    return edges(spark, sf_dir).join(wiki(spark, sf_dir).select(F.col("id").alias("target_id")), "target_id", "left_anti").select("source_id", "target_id")


@query("jn_04_missing_slugs", SQL + "SELECT target_id, arg_min(source_id, substr(source_id, 5)::BIGINT) AS first_page FROM edges WHERE target_id NOT IN (SELECT id FROM wiki) GROUP BY target_id")
def missing_slugs(spark, sf_dir) -> DataFrame:
    """The first page that references each missing target."""
    order = F.substring("source_id", 5, 20).cast("long")
    return broken_references(spark, sf_dir).groupBy("target_id").agg(F.min_by("source_id", order).alias("first_page"))


@query("jn_06_link_exists", SQL + "SELECT source_id, target_id FROM edges WHERE target_id IN (SELECT id FROM wiki)")
def existing_links(spark, sf_dir) -> DataFrame:
    return edges(spark, sf_dir).join(wiki(spark, sf_dir).select(F.col("id").alias("target_id")), "target_id", "left_semi").select("source_id", "target_id")


@query("jn_01_artifacts_for_source", "SELECT l_partkey AS artifact_id, count(*) AS n FROM lineitem JOIN supplier ON l_suppkey = s_suppkey WHERE s_suppkey = 1 GROUP BY 1")
def artifacts_for_source(spark, sf_dir) -> DataFrame:
    source = read(spark, sf_dir, "supplier").where("s_suppkey = 1").select("s_suppkey")
    return read(spark, sf_dir, "lineitem").join(source, F.col("l_suppkey") == F.col("s_suppkey")).groupBy(F.col("l_partkey").alias("artifact_id")).agg(F.count("*").alias("n"))


@query("jn_02_lineage_health", "SELECT count(*) AS lines, count(*) FILTER (WHERE o_orderkey IS NULL) AS without_order, count(*) FILTER (WHERE p_partkey IS NULL) AS without_part FROM lineitem LEFT JOIN (SELECT * FROM orders WHERE o_orderkey % 10 <> 0) ON l_orderkey = o_orderkey LEFT JOIN part ON l_partkey = p_partkey")
def lineage_health(spark, sf_dir) -> DataFrame:
    o = read(spark, sf_dir, "orders").where("o_orderkey % 10 <> 0").select("o_orderkey")
    p = read(spark, sf_dir, "part").select("p_partkey")
    both = read(spark, sf_dir, "lineitem").select("l_orderkey", "l_partkey").join(o, F.col("l_orderkey") == F.col("o_orderkey"), "left").join(p, F.col("l_partkey") == F.col("p_partkey"), "left")
    return both.agg(F.count("*").alias("lines"), F.count_if(F.col("o_orderkey").isNull()).alias("without_order"), F.count_if(F.col("p_partkey").isNull()).alias("without_part"))


VERSIONS_SQL = "WITH a AS (SELECT doc_id, md5(text) AS h FROM documents WHERE doc_id % 5 <> 0), b AS (SELECT doc_id, CASE WHEN doc_id % 7 = 0 THEN 'x' ELSE md5(text) END AS h FROM documents WHERE doc_id % 6 <> 0) "


def two_versions(spark, sf_dir) -> tuple[DataFrame, DataFrame]:
    d = read(spark, sf_dir, "documents").select("doc_id", F.md5("text").alias("h"))
    return d.where("doc_id % 5 <> 0"), d.where("doc_id % 6 <> 0").withColumn("h", F.when(F.col("doc_id") % 7 == 0, "x").otherwise(F.col("h")))


@query("jn_11_book_diff", VERSIONS_SQL + "SELECT coalesce(a.doc_id, b.doc_id) AS doc_id, CASE WHEN a.doc_id IS NULL THEN 'added' WHEN b.doc_id IS NULL THEN 'removed' ELSE 'changed' END AS change FROM a FULL JOIN b ON a.doc_id = b.doc_id WHERE a.h IS DISTINCT FROM b.h")
def book_diff(spark, sf_dir) -> DataFrame:
    """Chapters added, removed and changed between two versions."""
    a, b = two_versions(spark, sf_dir)
    both = a.withColumnRenamed("h", "old").join(b.withColumnRenamed("h", "new"), "doc_id", "full_outer").where(~F.col("old").eqNullSafe(F.col("new")))
    return both.select("doc_id", F.when(F.col("old").isNull(), "added").when(F.col("new").isNull(), "removed").otherwise("changed").alias("change"))


@query("jn_16_vector_diff", "SELECT doc_id FROM documents WHERE doc_id NOT IN (SELECT vec_id FROM embeddings)")
def vector_diff(spark, sf_dir) -> DataFrame:
    """Pages that the vector table lacks."""
    return read(spark, sf_dir, "documents").select("doc_id").join(read(spark, sf_dir, "embeddings").select(F.col("vec_id").alias("doc_id")), "doc_id", "left_anti")


@query("jn_18_snapshot_matches", VERSIONS_SQL + "SELECT (SELECT count(*) FROM (SELECT * FROM a EXCEPT SELECT * FROM b)) = 0 AND (SELECT count(*) FROM (SELECT * FROM b EXCEPT SELECT * FROM a)) = 0 AS matches")
def snapshot_matches(spark, sf_dir) -> DataFrame:
    """Whether two sets of (id, hash) are equal: one grouping instead of two differences."""
    a, b = two_versions(spark, sf_dir)
    every = a.distinct().withColumn("side", F.lit(1)).union(b.distinct().withColumn("side", F.lit(2)))
    return every.groupBy("doc_id", "h").agg(F.count("*").alias("n")).agg((F.count_if(F.col("n") < 2) == 0).alias("matches"))


@query("set_01_resolvable", SQL + "SELECT id FROM wiki UNION SELECT target_id FROM edges")
def resolvable(spark, sf_dir) -> DataFrame:
    return wiki(spark, sf_dir).select("id").union(edges(spark, sf_dir).select("target_id")).distinct()


@query("set_02_unresolved", SQL + "SELECT target_id AS id FROM edges EXCEPT SELECT id FROM wiki")
def unresolved(spark, sf_dir) -> DataFrame:
    return edges(spark, sf_dir).select(F.col("target_id").alias("id")).join(wiki(spark, sf_dir).select("id"), "id", "left_anti").distinct()


@query("set_03_symmetric_difference", VERSIONS_SQL + "SELECT coalesce(a.doc_id, b.doc_id) AS doc_id FROM a FULL JOIN b ON a.doc_id = b.doc_id WHERE a.doc_id IS NULL OR b.doc_id IS NULL")
def symmetric_difference(spark, sf_dir) -> DataFrame:
    a, b = two_versions(spark, sf_dir)
    every = a.select("doc_id").distinct().union(b.select("doc_id").distinct())
    return every.groupBy("doc_id").agg(F.count("*").alias("n")).where("n = 1").select("doc_id")


@query("set_06_field_diff", "WITH o AS (SELECT o_orderkey AS id, o_orderstatus AS status, o_orderpriority AS priority FROM orders), n AS (SELECT id, CASE WHEN id % 9 = 0 THEN 'Z' ELSE status END AS status, CASE WHEN id % 11 = 0 THEN NULL ELSE priority END AS priority FROM o) SELECT o.id, 'status' AS field, o.status AS old, n.status AS new FROM o JOIN n ON o.id = n.id WHERE o.status IS DISTINCT FROM n.status UNION ALL SELECT o.id, 'priority', o.priority, n.priority FROM o JOIN n ON o.id = n.id WHERE o.priority IS DISTINCT FROM n.priority")
def field_diff(spark, sf_dir) -> DataFrame:
    """Old and new value of each field that differs between two versions of a row."""
    o = read(spark, sf_dir, "orders").select(F.col("o_orderkey").alias("id"), F.col("o_orderstatus").alias("status"), F.col("o_orderpriority").alias("priority"))
    n = o.select("id", F.when(F.col("id") % 9 == 0, "Z").otherwise(F.col("status")).alias("status"), F.when(F.col("id") % 11 != 0, F.col("priority")).alias("priority"))
    return diff_fields(o, n, "id", ["status", "priority"])


def diff_fields(old: DataFrame, new: DataFrame, key: str, fields: list[str]) -> DataFrame:
    both = old.select(key, *(F.col(f).alias(f"old_{f}") for f in fields)).join(new.select(key, *(F.col(f).alias(f"new_{f}") for f in fields)), key)
    pairs = F.explode(F.array(*(F.struct(F.lit(f).alias("field"), F.col(f"old_{f}").cast("string").alias("old"), F.col(f"new_{f}").cast("string").alias("new")) for f in fields)))
    return both.select(key, pairs.alias("x")).select(key, "x.*").where(~F.col("old").eqNullSafe(F.col("new")))


@query("set_08_cross_links", SQL + "SELECT CASE WHEN source_id = target_id THEN 'self_loop' WHEN target_id IN (SELECT id FROM wiki) THEN 'kept' ELSE 'dangling' END AS kind, count(*) AS n FROM edges GROUP BY 1")
def cross_links(spark, sf_dir) -> DataFrame:
    known = wiki(spark, sf_dir).select(F.col("id").alias("target_id"), F.lit(True).alias("known"))
    kind = F.when(F.col("source_id") == F.col("target_id"), "self_loop").when(F.col("known"), "kept").otherwise("dangling")
    return edges(spark, sf_dir).join(known, "target_id", "left").groupBy(kind.alias("kind")).agg(F.count("*").alias("n"))


@query("str_01_slug", SQL + "SELECT id, regexp_replace(regexp_replace(lower(title), '[^a-z0-9]+', '-', 'g'), '^-+|-+$', '', 'g') AS slug FROM wiki")
def slugs(spark, sf_dir) -> DataFrame:
    return wiki(spark, sf_dir).select("id", T.ascii_slug("title").alias("slug"))


@query("str_02_unique_slug", SQL + ", s AS (SELECT id, doc_id, regexp_replace(regexp_replace(lower(title), '[^a-z0-9]+', '-', 'g'), '^-+|-+$', '', 'g') AS slug FROM wiki), r AS (SELECT *, row_number() OVER (PARTITION BY slug ORDER BY doc_id) AS k FROM s) SELECT id, CASE WHEN k > 1 THEN slug || '-' || k ELSE slug END AS slug FROM r")
def unique_slugs(spark, sf_dir) -> DataFrame:
    """Repeated slugs get -2, -3 and so on."""
    k = F.row_number().over(W.partitionBy("slug").orderBy("doc_id"))
    s = wiki(spark, sf_dir).select("id", "doc_id", T.ascii_slug("title").alias("slug")).withColumn("k", k)
    return s.select("id", F.when(F.col("k") > 1, F.concat_ws("-", "slug", "k")).otherwise(F.col("slug")).alias("slug"))


@query("str_23_normalized_term", SQL + "SELECT id, lower(trim(regexp_replace(title, '[ \\t\\n\\r\\f]+', ' ', 'g'))) AS term FROM wiki")
def normalized_terms(spark, sf_dir) -> DataFrame:
    return wiki(spark, sf_dir).select("id", T.normalized_term("title").alias("term"))


@query("fn_08_body_hash", SQL + "SELECT id, substr(sha256(body), 1, 16) AS hash FROM wiki")
def body_hash(spark, sf_dir) -> DataFrame:
    return wiki(spark, sf_dir).select("id", F.substring(F.sha2("body", 256), 1, 16).alias("hash"))


@query("fn_09_idempotency_hash", "SELECT doc_id, md5('file:' || source || ':' || substr(text, 1, 1024) || ':p:') AS hash FROM documents")
def idempotency_hash(spark, sf_dir) -> DataFrame:
    return read(spark, sf_dir, "documents").select("doc_id", F.md5(F.concat_ws(":", F.lit("file"), "source", F.substring("text", 1, 1024), F.lit("p"), F.lit(""))).alias("hash"))


@query("flt_07_domain_filter", "SELECT page_id, url FROM pages WHERE regexp_matches(regexp_extract(url, '^[a-z]+://([^/?#]+)', 1), '(^|\\.)example\\.org$')")
def domain_filter(spark, sf_dir) -> DataFrame:
    """Pages of allowed domains and their subdomains."""
    host = F.parse_url("url", F.lit("HOST"))
    allowed = F.array(F.lit("example.org"))
    return read(spark, sf_dir, "pages").where(F.exists(allowed, lambda d: (host == d) | host.endswith(F.concat(F.lit("."), d)))).select("page_id", "url")


@query("flt_06_entity_filter", SQL + "SELECT id FROM claims WHERE contains(lower(statement), 'the')")
def entity_filter(spark, sf_dir) -> DataFrame:
    from corvane.sources.tables import claims

    return claims(spark, sf_dir).where(F.lower("statement").contains("the")).select("id")


@query("flt_01_page_type", SQL + "SELECT id FROM wiki WHERE type = 'entity'")
def page_type(spark, sf_dir) -> DataFrame:
    return wiki(spark, sf_dir).where("type = 'entity'").select("id")
