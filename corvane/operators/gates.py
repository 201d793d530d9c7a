"""Integrity gates, conflict classes, evidence binding, lineage and publication."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import Window as W
from pyspark.sql import functions as F

from corvane.operators.lifecycle import temporally_disjoint
from corvane.plans.registry import query
from corvane.sources.tables import DAY, NOW, SQL, claims, edges, read, wiki


def shared_keys(a, b) -> Column:
    return F.array_intersect(F.map_keys(a), F.map_keys(b))


def context_disjoint(a, b) -> Column:
    """Every shared key differs; without shared keys nothing can be said."""
    keys = shared_keys(a, b)
    return F.coalesce((F.size(keys) > 0) & F.forall(keys, lambda k: ~F.element_at(a, k).eqNullSafe(F.element_at(b, k))), F.lit(False))


def unknown_dimension(a, b) -> Column:
    blank = lambda v: v.isNull() | v.isin("", "unknown")
    return F.coalesce(F.exists(shared_keys(a, b), lambda k: blank(F.element_at(a, k)) | blank(F.element_at(b, k))), F.lit(False))


def partial_overlap(a, b) -> Column:
    keys = shared_keys(a, b)
    same = F.size(F.filter(keys, lambda k: F.element_at(a, k).eqNullSafe(F.element_at(b, k))))
    return F.coalesce((same > 0) & (same < F.size(keys)), F.lit(False))


def only_perspective_differs(a, b) -> Column:
    keys = shared_keys(a, b)
    differ = F.filter(keys, lambda k: ~F.element_at(a, k).eqNullSafe(F.element_at(b, k)))
    return F.coalesce((F.size(differ) == 1) & F.array_contains(differ, "perspective"), F.lit(False))


def conflict_class(context_a, context_b, bounds: tuple, contradicts) -> tuple[Column, Column]:
    """(type, confidence): none, temporal, unresolved, conditional, actual or perspective, the first that holds."""
    rules = [
        (context_disjoint(context_a, context_b), "none", 0.9),
        (temporally_disjoint(*bounds), "temporal", 0.95),
        (unknown_dimension(context_a, context_b), "unresolved", 0.7),
        (partial_overlap(context_a, context_b) & ~only_perspective_differs(context_a, context_b), "conditional", 0.8),
        (contradicts, "actual", 0.85),
    ]
    kind = sure = None
    for cond, name, confidence in rules:
        kind = F.when(cond, name) if kind is None else kind.when(cond, name)
        sure = F.when(cond, confidence) if sure is None else sure.when(cond, confidence)
    return kind.otherwise("perspective"), sure.otherwise(0.7)


def order_pairs(spark, sf_dir) -> DataFrame:
    """Neighbouring lines of an order as two statements with contexts and validity."""
    o = read(spark, sf_dir, "orders").select(F.col("o_orderkey").alias("k"), "o_orderdate")
    line = read(spark, sf_dir, "lineitem").join(o, F.col("l_orderkey") == F.col("k"))
    context = F.create_map(F.lit("flag"), F.when(F.col("l_suppkey") % 10 != 0, F.col("l_returnflag")).otherwise("unknown"), F.lit("status"), F.col("l_linestatus"), F.lit("perspective"), (F.col("l_partkey") % 2).cast("string"))
    s = line.select("k", F.col("l_linenumber").alias("n"), context.alias("c"), F.col("o_orderdate").alias("f"), F.col("l_shipdate").alias("t"), (F.col("l_quantity") > 25).alias("much"))
    side = lambda x: s.select("k", *(F.col(c).alias(f"{c}_{x}") for c in ("n", "c", "f", "t", "much")))
    return side("a").join(side("b"), "k").where("n_b = n_a + 1")


CONFLICT_SQL = """WITH s AS (SELECT o_orderkey AS k, l_linenumber AS n, CASE WHEN l_suppkey % 10 <> 0 THEN l_returnflag ELSE 'unknown' END AS flag, l_linestatus AS status, l_partkey % 2 AS p, o_orderdate AS f, l_shipdate AS t, l_quantity > 25 AS much FROM lineitem JOIN orders ON l_orderkey = o_orderkey),
j AS (SELECT a.k, a.n AS n_a, b.n AS n_b, (a.flag = b.flag)::INT + (a.status = b.status)::INT + (a.p = b.p)::INT AS same, a.flag = b.flag AND a.status = b.status AND a.p <> b.p AS only_p, a.flag = 'unknown' OR b.flag = 'unknown' AS unknown, coalesce(a.t <= b.f, false) OR coalesce(b.t <= a.f, false) AS apart, a.much AND NOT b.much AS against FROM s a JOIN s b ON a.k = b.k AND b.n = a.n + 1)
SELECT k, n_a, CASE WHEN same = 0 THEN 'none' WHEN apart THEN 'temporal' WHEN unknown THEN 'unresolved' WHEN same < 3 AND NOT only_p THEN 'conditional' WHEN against THEN 'actual' ELSE 'perspective' END AS conflict_type, CASE WHEN same = 0 THEN 0.9 WHEN apart THEN 0.95 WHEN unknown THEN 0.7 WHEN same < 3 AND NOT only_p THEN 0.8 WHEN against THEN 0.85 ELSE 0.7 END::DOUBLE AS confidence FROM j"""


@query("cnf_02_conflict_class", CONFLICT_SQL)
def conflict_classes(spark, sf_dir) -> DataFrame:
    p = order_pairs(spark, sf_dir)
    kind, sure = conflict_class(F.col("c_a"), F.col("c_b"), tuple(F.col(c) for c in ("f_a", "t_a", "f_b", "t_b")), F.col("much_a") & ~F.col("much_b"))
    return p.select("k", "n_a", kind.alias("conflict_type"), sure.alias("confidence"))


@query("fn_17_context_disjoint", CONFLICT_SQL.split("SELECT k, n_a")[0] + "SELECT k, n_a, same = 0 AS disjoint, same > 0 AND same < 3 AS partial, unknown FROM j")
def contexts(spark, sf_dir) -> DataFrame:
    """Context rules on pairs: disjoint, partly equal, unknown."""
    a, b = F.col("c_a"), F.col("c_b")
    return order_pairs(spark, sf_dir).select("k", "n_a", context_disjoint(a, b).alias("disjoint"), partial_overlap(a, b).alias("partial"), unknown_dimension(a, b).alias("unknown"))


def grams(words, n) -> Column:
    """Runs of n of a column of words, joined by single spaces."""
    return F.when(F.size(words) >= n, F.transform(F.sequence(F.lit(1), F.size(words) - n + 1), lambda k: F.array_join(F.slice(words, k, n), " ")))


def containing(docs: DataFrame, quotes: DataFrame, width: int = 5) -> DataFrame:
    """(item_id, doc_id): documents (doc_id, text) that contain a quote (item_id, quote).

    A quote that occurs has its inner words as words of the text, so both meet in an equi-join on a run of up to
    width of them, and the text is searched only then. Quotes of one or two words have none and are searched
    in every text; they are the only ones for which all texts are looked through.
    """
    inner = F.size(F.split("quote", "\\s+")) - 2
    q = quotes.where("quote <> ''").withColumn("n", F.least(inner, F.lit(width)))
    keyed = q.where("n > 0").withColumn("key", F.array_join(F.slice(F.split("quote", "\\s+"), F.lit(2), F.col("n")), " ")).select("item_id", "quote", "n", "key")
    widths = sorted(r[0] for r in keyed.select("n").distinct().collect())  # width numbers at most
    short = q.where("n <= 0").select("item_id", "quote")
    found = docs.join(short, F.col("text").contains(F.col("quote"))).select("item_id", "doc_id")
    words = docs.select("doc_id", F.split("text", "\\s+").alias("words"))
    for n in widths:
        runs = words.select("doc_id", F.explode(F.array_distinct(grams(F.col("words"), F.lit(n)))).alias("key"))
        near = runs.join(keyed.where(F.col("n") == n), "key").select("doc_id", "item_id", "quote")
        found = found.union(near.join(docs, "doc_id").where(F.col("text").contains(F.col("quote"))).select("item_id", "doc_id"))
    return found.distinct()


@query("jn_19_validate_evidence", "SELECT item_id, count(doc_id) AS n_documents, count(doc_id) = 1 AS valid FROM benchmark LEFT JOIN documents ON contains(documents.text, benchmark.text) GROUP BY item_id")
def validate_evidence(spark, sf_dir) -> DataFrame:
    """Quotes and the number of documents that contain them; exactly one makes a quote valid."""
    quotes = read(spark, sf_dir, "benchmark").select("item_id", F.col("text").alias("quote"))
    hits = containing(read(spark, sf_dir, "documents").select("doc_id", "text"), quotes).groupBy("item_id").agg(F.count("*").alias("n"))
    return quotes.join(hits, "item_id", "left").select("item_id", F.coalesce("n", F.lit(0)).alias("n_documents"), (F.coalesce("n", F.lit(0)) == 1).alias("valid"))


@query("cnf_06_compile_claims", SQL + "SELECT entity, max(length(statement) % 100) AS confidence, count(*) AS n FROM claims GROUP BY entity")
def compile_claims(spark, sf_dir) -> DataFrame:
    """An object of each entity's claims, as sure as the surest."""
    return claims(spark, sf_dir).groupBy("entity").agg(F.max(F.length("statement") % 100).cast("long").alias("confidence"), F.count("*").alias("n"))


@query("cnf_09_replay_evidence", SQL + "SELECT id, CASE WHEN doc_id % 13 = 0 THEN 'source_missing' WHEN doc_id % 7 = 0 THEN 'hash_mismatch' WHEN NOT contains(body, substr(title, 1, 10)) THEN 'quote_missing' END AS failure FROM wiki")
def replay_evidence(spark, sf_dir) -> DataFrame:
    """Ordered checks; the first failure is the code."""
    w = wiki(spark, sf_dir)
    stored = F.when(F.col("doc_id") % 7 == 0, F.lit("old")).otherwise(F.md5("body"))
    fail = F.when(F.col("doc_id") % 13 == 0, "source_missing").when(stored != F.md5("body"), "hash_mismatch").when(~F.col("body").contains(F.substring("title", 1, 10)), "quote_missing")
    return w.select("id", fail.alias("failure"))


def verdicts(pages: DataFrame, gates: list[tuple[str, int, Column]]) -> DataFrame:
    """(id, gate, gate_order, passed): all gates on every object, from one scan."""
    every = F.explode(F.array(*(F.struct(F.lit(g).alias("gate"), F.lit(n).alias("gate_order"), F.coalesce(ok, F.lit(False)).alias("passed")) for g, n, ok in gates)))
    return pages.select("id", every.alias("x")).select("id", "x.*")


def wiki_gates() -> list[tuple[str, int, Column]]:
    c = F.col
    return [
        ("schema", 1, c("title").isNotNull() & (F.trim("title") != "")),
        ("provenance", 2, c("source").isNotNull()),
        ("evidence", 3, F.length("body") >= 100),
        ("mode", 4, c("type").isin("source", "entity", "concept", "synthesis")),
        ("temporal", 8, c("created_at") <= NOW),
        ("retrieval", 11, (c("grade") != "C") | (c("heat") >= 10)),
    ]


GATES_SQL = SQL + f", g AS (SELECT id, unnest([{{'gate': 'schema', 'gate_order': 1, 'passed': title IS NOT NULL AND trim(title) <> ''}}, {{'gate': 'provenance', 'gate_order': 2, 'passed': source IS NOT NULL}}, {{'gate': 'evidence', 'gate_order': 3, 'passed': length(body) >= 100}}, {{'gate': 'mode', 'gate_order': 4, 'passed': type IN ('source', 'entity', 'concept', 'synthesis')}}, {{'gate': 'temporal', 'gate_order': 8, 'passed': created_at <= {NOW}}}, {{'gate': 'retrieval', 'gate_order': 11, 'passed': grade <> 'C' OR heat >= 10}}]) AS x FROM wiki) "


@query("rul_17_integrity", GATES_SQL + "SELECT id, count(*) FILTER (WHERE NOT x.passed) AS failed, count(*) FILTER (WHERE NOT x.passed) > 0 AS blocked FROM g GROUP BY id")
def integrity(spark, sf_dir) -> DataFrame:
    """All gates run; an object is blocked if any fails."""
    bad = F.count_if(~F.col("passed"))
    return verdicts(wiki(spark, sf_dir), wiki_gates()).groupBy("id").agg(bad.alias("failed"), (bad > 0).alias("blocked"))


@query("agg_08_health_report", GATES_SQL + "SELECT x.gate AS gate, x.gate_order AS gate_order, count(*) FILTER (WHERE NOT x.passed) AS failures, round(1 - count(*) FILTER (WHERE NOT x.passed) / count(*), 6) AS score FROM g GROUP BY ALL")
def health_report(spark, sf_dir) -> DataFrame:
    bad = F.count_if(~F.col("passed"))
    return verdicts(wiki(spark, sf_dir), wiki_gates()).groupBy("gate", "gate_order").agg(bad.alias("failures"), F.round(1 - bad / F.count("*"), 6).alias("score"))


@query("rul_18_closure", GATES_SQL + "SELECT id FROM g GROUP BY id HAVING bool_and(x.passed)")
def closure(spark, sf_dir) -> DataFrame:
    return integrity(spark, sf_dir).where("not blocked").select("id")


@query("rul_02_page_gate", SQL + "SELECT id, CASE WHEN length(body) < 100 THEN 'P1' WHEN type <> 'source' AND length(body) > 3000 THEN 'P2' WHEN source IS NULL THEN 'P3' END AS code FROM wiki WHERE length(body) < 100 OR type <> 'source' AND length(body) > 3000 OR source IS NULL")
def page_gate(spark, sf_dir) -> DataFrame:
    code = F.when(F.length("body") < 100, "P1").when((F.col("type") != "source") & (F.length("body") > 3000), "P2").when(F.col("source").isNull(), "P3")
    return wiki(spark, sf_dir).select("id", code.alias("code")).where("code is not null")


@query("rul_15_relation_gate", SQL + "SELECT source_id, target_id, type FROM edges WHERE type NOT IN ('references', 'is_part_of')")
def relation_gate(spark, sf_dir) -> DataFrame:
    return edges(spark, sf_dir).where(~F.col("type").isin("references", "is_part_of")).select("source_id", "target_id", "type")


@query("rul_16_retrieval_gate", SQL + f"SELECT id FROM wiki WHERE grade <> 'C' AND heat > 0 AND created_at <= {NOW} AND source IS NOT NULL AND length(body) > 0")
def retrieval_gate(spark, sf_dir) -> DataFrame:
    return wiki(spark, sf_dir).where((F.col("grade") != "C") & (F.col("heat") > 0) & (F.col("created_at") <= NOW) & F.col("source").isNotNull() & (F.length("body") > 0)).select("id")


@query("flt_02_visible", SQL + f"SELECT id FROM wiki WHERE grade <> 'C' AND source IS NOT NULL AND last_used_at > 0 AND last_used_at <= {NOW - DAY}")
def visible(spark, sf_dir) -> DataFrame:
    """Verified, with evidence and in force: a conjunction that reaches the scan as far as it can."""
    return wiki(spark, sf_dir).where((F.col("grade") != "C") & F.col("source").isNotNull() & (F.col("last_used_at") > 0) & (F.col("last_used_at") <= NOW - DAY)).select("id")


@query("rul_19_file_existence", "SELECT o_orderkey FROM orders WHERE o_custkey NOT IN (SELECT c_custkey FROM customer WHERE c_acctbal >= 0)")
def file_existence(spark, sf_dir) -> DataFrame:
    there = read(spark, sf_dir, "customer").where("c_acctbal >= 0").select(F.col("c_custkey").alias("o_custkey"))
    return read(spark, sf_dir, "orders").join(there, "o_custkey", "left_anti").select("o_orderkey")


@query("rul_21_cache_health", "SELECT source AS cache, count(*) AS n, sum(n_chars)::BIGINT AS size, min(doc_id) AS oldest, count(*) > 60 AS too_many, sum(n_chars) > 200000 AS too_large FROM documents GROUP BY source")
def cache_health(spark, sf_dir) -> DataFrame:
    d = read(spark, sf_dir, "documents").groupBy(F.col("source").alias("cache")).agg(F.count("*").alias("n"), F.sum("n_chars").alias("size"), F.min("doc_id").alias("oldest"))
    return d.withColumns({"too_many": F.col("n") > 60, "too_large": F.col("size") > 200_000})


@query("rul_22_consistency", "SELECT o_orderkey FROM (SELECT o_orderkey, o_orderstatus AS a, CASE WHEN o_orderkey % 17 = 0 THEN 'X' WHEN o_orderkey % 19 = 0 THEN NULL ELSE o_orderstatus END AS b FROM orders) WHERE a IS DISTINCT FROM b")
def consistency(spark, sf_dir) -> DataFrame:
    """Two records of one object that disagree in a field, null being a value."""
    b = F.when(F.col("o_orderkey") % 17 == 0, "X").when(F.col("o_orderkey") % 19 != 0, F.col("o_orderstatus"))
    return read(spark, sf_dir, "orders").where(~F.col("o_orderstatus").eqNullSafe(b)).select("o_orderkey")


@query("rul_24_outline", "WITH o AS (SELECT vec_id AS page_id FROM embeddings UNION ALL SELECT vec_id + 20 FROM embeddings WHERE vec_id % 50 = 0), c AS (SELECT page_id, count(*) AS n FROM o GROUP BY page_id) SELECT coalesce(d.doc_id, c.page_id) AS page_id, CASE WHEN c.page_id IS NULL THEN 'missing' WHEN d.doc_id IS NULL THEN 'unknown' ELSE 'duplicate' END AS issue FROM documents d FULL JOIN c ON d.doc_id = c.page_id WHERE c.page_id IS NULL OR d.doc_id IS NULL OR c.n > 1")
def outline(spark, sf_dir) -> DataFrame:
    """Pages that an outline lacks, doesn't know or has twice."""
    e = read(spark, sf_dir, "embeddings").select(F.col("vec_id").alias("page_id"))
    c = e.union(e.where("page_id % 50 = 0").select(F.col("page_id") + 20)).groupBy("page_id").agg(F.count("*").alias("n"))
    both = read(spark, sf_dir, "documents").select("doc_id").join(c, F.col("doc_id") == F.col("page_id"), "full_outer")
    issue = F.when(F.col("page_id").isNull(), "missing").when(F.col("doc_id").isNull(), "unknown").when(F.col("n") > 1, "duplicate")
    return both.select(F.coalesce("doc_id", "page_id").alias("page_id"), issue.alias("issue")).where("issue is not null")


@query("rul_28_completeness", "SELECT c_custkey, round(((c_name IS NOT NULL)::INT + (c_nationkey IS NOT NULL)::INT + (c_acctbal > 0)::INT) / 3, 6) AS completeness FROM customer")
def completeness(spark, sf_dir) -> DataFrame:
    have = F.col("c_name").isNotNull().cast("int") + F.col("c_nationkey").isNotNull().cast("int") + (F.col("c_acctbal") > 0).cast("int")
    return read(spark, sf_dir, "customer").select("c_custkey", F.round(have / 3, 6).alias("completeness"))


@query("ver_08_snapshot", "SELECT count(*) AS n, md5(string_agg(h, '' ORDER BY h)) AS digest FROM (SELECT md5(n_nationkey || ':' || n_name) AS h FROM nation)")
def snapshot(spark, sf_dir) -> DataFrame:
    """A manifest of a set: its size and the digest of its sorted hashes; nations are few."""
    h = read(spark, sf_dir, "nation").select(F.md5(F.concat_ws(":", "n_nationkey", "n_name")).alias("h"))
    return h.agg(F.count("*").alias("n"), F.md5(F.array_join(F.sort_array(F.collect_list("h")), "")).alias("digest"))


@query("ver_10_drill", "SELECT doc_id FROM documents WHERE doc_id % 3 = 0 AND doc_id NOT IN (SELECT doc_id FROM documents WHERE doc_id % 9 <> 0)")
def drill(spark, sf_dir) -> DataFrame:
    """Ids of a snapshot that the live table lacks."""
    d = read(spark, sf_dir, "documents").select("doc_id")
    return d.where("doc_id % 3 = 0").join(d.where("doc_id % 9 <> 0"), "doc_id", "left_anti")


@query("lin_02_transition", "SELECT o_orderkey, CASE WHEN o_orderstatus = 'O' THEN 'P' ELSE o_orderstatus END AS status, o_orderstatus = 'O' AS moved FROM orders")
def transition(spark, sf_dir) -> DataFrame:
    """Sources in the expected status move on; others stay."""
    return read(spark, sf_dir, "orders").select("o_orderkey", F.when(F.col("o_orderstatus") == "O", "P").otherwise(F.col("o_orderstatus")).alias("status"), (F.col("o_orderstatus") == "O").alias("moved"))


@query("lin_04_artifact_sources", "SELECT l_suppkey FROM (SELECT DISTINCT l_suppkey FROM lineitem WHERE l_partkey = 5) ORDER BY l_suppkey")
def artifact_sources(spark, sf_dir) -> DataFrame:
    return read(spark, sf_dir, "lineitem").where("l_partkey = 5").select("l_suppkey").distinct().orderBy("l_suppkey")


@query("lin_05_sources_by_status", "SELECT o_orderkey FROM orders WHERE o_orderstatus = 'F'")
def sources_by_status(spark, sf_dir) -> DataFrame:
    return read(spark, sf_dir, "orders").where("o_orderstatus = 'F'").select("o_orderkey")


@query("lin_10_fail_run", "SELECT l_orderkey, l_linenumber, CASE WHEN o_orderstatus = 'F' THEN 'failed' ELSE l_linestatus END AS status FROM lineitem JOIN orders ON l_orderkey = o_orderkey")
def fail_run(spark, sf_dir) -> DataFrame:
    """The members of a failed run fail with it."""
    o = read(spark, sf_dir, "orders").select(F.col("o_orderkey").alias("l_orderkey"), "o_orderstatus")
    return read(spark, sf_dir, "lineitem").join(o, "l_orderkey").select("l_orderkey", "l_linenumber", F.when(F.col("o_orderstatus") == "F", "failed").otherwise(F.col("l_linestatus")).alias("status"))


@query("lin_12_derivations", "SELECT DISTINCT l_suppkey, l_partkey FROM lineitem")
def derivations(spark, sf_dir) -> DataFrame:
    return read(spark, sf_dir, "lineitem").select("l_suppkey", "l_partkey").distinct()


@query("pub_01_watermark", "SELECT event_type, max(event_id) AS version FROM events WHERE value > 10 GROUP BY event_type")
def watermark(spark, sf_dir) -> DataFrame:
    """The newest published version of each view."""
    return read(spark, sf_dir, "events").where("value > 10").groupBy("event_type").agg(F.max("event_id").alias("version"))


@query("pub_02_current", "SELECT event_id, event_type FROM events WHERE (event_type, event_id) IN (SELECT event_type, max(event_id) FROM events WHERE value > 10 GROUP BY event_type)")
def current_version(spark, sf_dir) -> DataFrame:
    last = watermark(spark, sf_dir).withColumnRenamed("version", "event_id")
    return read(spark, sf_dir, "events").select("event_id", "event_type").join(last, ["event_type", "event_id"], "left_semi").select("event_id", "event_type")


@query("pub_06_reconcile_pending", "SELECT CASE WHEN e.vec_id IS NULL AND d.doc_id IS NOT NULL THEN 'failed' WHEN d.doc_id IS NULL THEN 'orphan' ELSE 'ok' END AS state, count(*) AS n FROM (SELECT doc_id FROM documents WHERE doc_id % 2 = 0) d FULL JOIN embeddings e ON d.doc_id = e.vec_id GROUP BY 1")
def reconcile_pending(spark, sf_dir) -> DataFrame:
    """A ledger of pages against the vectors that are there."""
    d = read(spark, sf_dir, "documents").where("doc_id % 2 = 0").select("doc_id")
    both = d.join(read(spark, sf_dir, "embeddings").select("vec_id"), F.col("doc_id") == F.col("vec_id"), "full_outer")
    state = F.when(F.col("vec_id").isNull() & F.col("doc_id").isNotNull(), "failed").when(F.col("doc_id").isNull(), "orphan").otherwise("ok")
    return both.groupBy(state.alias("state")).agg(F.count("*").alias("n"))


@query("pub_15_gap_ledger", SQL + ", g AS (SELECT target_id AS slug, count(DISTINCT source_id) AS n FROM edges WHERE target_id NOT IN (SELECT id FROM wiki) GROUP BY 1) SELECT slug, n FROM g ORDER BY n DESC, slug LIMIT 3")
def gap_ledger(spark, sf_dir) -> DataFrame:
    """The missing pages that most pages refer to, three at a time."""
    missing = edges(spark, sf_dir).join(wiki(spark, sf_dir).select(F.col("id").alias("target_id")), "target_id", "left_anti")
    return missing.groupBy(F.col("target_id").alias("slug")).agg(F.count_distinct("source_id").alias("n")).orderBy(F.desc("n"), "slug").limit(3)


@query("pub_17_reviews", SQL + "SELECT type, lower(trim(title)) AS title, min(doc_id) AS first FROM wiki GROUP BY 1, 2")
def reviews(spark, sf_dir) -> DataFrame:
    """One review for each type and normalised title."""
    return wiki(spark, sf_dir).groupBy("type", F.lower(F.trim("title")).alias("title")).agg(F.min("doc_id").alias("first"))


@query("jn_10_map_unit", "SELECT o_orderkey, CASE WHEN o_orderkey % 5 = 0 THEN c_custkey WHEN n_nationkey IS NOT NULL THEN n_nationkey END AS chapter, CASE WHEN o_orderkey % 5 = 0 THEN 1.0 WHEN n_nationkey IS NOT NULL THEN 0.85 ELSE 0.0 END::DOUBLE AS confidence FROM orders JOIN customer ON o_custkey = c_custkey LEFT JOIN (SELECT * FROM nation WHERE n_nationkey % 3 <> 0) ON c_nationkey = n_nationkey")
def map_unit(spark, sf_dir) -> DataFrame:
    """Membership first, then the derived key, else none."""
    c = read(spark, sf_dir, "customer").select(F.col("c_custkey").alias("o_custkey"), "c_nationkey")
    n = read(spark, sf_dir, "nation").where("n_nationkey % 3 <> 0").select(F.col("n_nationkey").alias("c_nationkey"), F.col("n_nationkey").alias("key"))
    o = read(spark, sf_dir, "orders").select("o_orderkey", "o_custkey").join(c, "o_custkey").join(n, "c_nationkey", "left")
    own = F.col("o_orderkey") % 5 == 0
    return o.select("o_orderkey", F.when(own, F.col("o_custkey").cast("long")).otherwise(F.col("key").cast("long")).alias("chapter"), F.when(own, 1.0).when(F.col("key").isNotNull(), 0.85).otherwise(0.0).alias("confidence"))


@query("jn_12_affected_chapters", "SELECT DISTINCT l_orderkey FROM lineitem WHERE l_partkey IN (SELECT p_partkey FROM part WHERE p_partkey % 100 = 1)")
def affected_chapters(spark, sf_dir) -> DataFrame:
    changed = read(spark, sf_dir, "part").where("p_partkey % 100 = 1").select(F.col("p_partkey").alias("l_partkey"))
    return read(spark, sf_dir, "lineitem").join(changed, "l_partkey", "left_semi").select("l_orderkey").distinct()


@query("jn_15_claim_evidence", "SELECT conv_id, turn, CASE WHEN turn + 1 < n THEN turn + 1 END AS evidence_turn FROM (SELECT *, count(*) OVER (PARTITION BY conv_id) AS n FROM conversations)")
def claim_evidence(spark, sf_dir) -> DataFrame:
    """A reference into the evidence of its group; out of range it is dropped."""
    n = F.count("*").over(W.partitionBy("conv_id"))
    return read(spark, sf_dir, "conversations").select("conv_id", "turn", F.when(F.col("turn") + 1 < n, F.col("turn") + 1).alias("evidence_turn"))


@query("top_06_chapter_order", SQL + "SELECT id, row_number() OVER (PARTITION BY category ORDER BY CASE type WHEN 'concept' THEN 0 WHEN 'entity' THEN 1 ELSE 2 END, grade, doc_id) AS place FROM wiki")
def chapter_order(spark, sf_dir) -> DataFrame:
    kind = F.when(F.col("type") == "concept", 0).when(F.col("type") == "entity", 1).otherwise(2)
    return wiki(spark, sf_dir).select("id", F.row_number().over(W.partitionBy("category").orderBy(kind, "grade", "doc_id")).cast("long").alias("place"))


@query("top_09_changes_by_agent", "SELECT event_id FROM events WHERE event_type = 'purchase' AND ts >= TIMESTAMP '2024-01-01' ORDER BY ts DESC, event_id DESC")
def changes_by_agent(spark, sf_dir) -> DataFrame:
    return read(spark, sf_dir, "events").where((F.col("event_type") == "purchase") & (F.col("ts") >= F.lit("2024-01-01").cast("timestamp_ntz"))).orderBy(F.desc("ts"), F.desc("event_id")).select("event_id")


@query("win_07_stub_ranking", SQL + "SELECT target_id AS slug, count(*) AS refs FROM edges WHERE target_id NOT IN (SELECT id FROM wiki) GROUP BY 1 ORDER BY refs DESC, slug LIMIT 10")
def stub_ranking(spark, sf_dir) -> DataFrame:
    missing = edges(spark, sf_dir).join(wiki(spark, sf_dir).select(F.col("id").alias("target_id")), "target_id", "left_anti")
    return missing.groupBy(F.col("target_id").alias("slug")).agg(F.count("*").alias("refs")).orderBy(F.desc("refs"), "slug").limit(10)


@query("agg_13_merge_candidates", "SELECT source, arg_max(lang, (c, lang)) AS kind, round(sum(w) / sum(c), 6) AS confidence FROM (SELECT source, lang, count(*) AS c, sum(n_chars) AS w FROM documents GROUP BY source, lang) GROUP BY source")
def merge_candidates(spark, sf_dir) -> DataFrame:
    """The most frequent kind and the weighted mean of the parts' confidence."""
    per = read(spark, sf_dir, "documents").groupBy("source", "lang").agg(F.count("*").alias("c"), F.sum("n_chars").alias("w"))
    return per.groupBy("source").agg(F.max_by("lang", F.struct("c", "lang")).alias("kind"), F.round(F.sum("w") / F.sum("c"), 6).alias("confidence"))


@query("agg_15_offsets", "SELECT conv_id, turn, coalesce(sum(length(text)) OVER (PARTITION BY conv_id ORDER BY turn ROWS BETWEEN UNBOUNDED PRECEDING AND 1 PRECEDING), 0)::BIGINT AS evidence_offset FROM conversations")
def offsets(spark, sf_dir) -> DataFrame:
    """Where each part's evidence begins once the parts are concatenated."""
    before = W.partitionBy("conv_id").orderBy("turn").rowsBetween(W.unboundedPreceding, -1)
    return read(spark, sf_dir, "conversations").select("conv_id", "turn", F.coalesce(F.sum(F.length("text")).over(before), F.lit(0)).alias("evidence_offset"))


@query("agg_19_series_gate", SQL + "SELECT category, count(*) AS n, CASE WHEN count(*) >= 40 THEN 'proceed' WHEN count(*) >= 30 THEN 'merge' WHEN count(*) >= 10 THEN 'reference' ELSE 'cancel' END AS decision FROM wiki GROUP BY category")
def series_gate(spark, sf_dir) -> DataFrame:
    n = F.count("*")
    return wiki(spark, sf_dir).groupBy("category").agg(n.alias("n"), F.when(n >= 40, "proceed").when(n >= 30, "merge").when(n >= 10, "reference").otherwise("cancel").alias("decision"))


@query("agg_22_pass_rate", "SELECT role, round(avg((length(text) >= 100)::INT), 6) AS rate FROM conversations GROUP BY role")
def pass_rate(spark, sf_dir) -> DataFrame:
    return read(spark, sf_dir, "conversations").groupBy("role").agg(F.round(F.avg((F.length("text") >= 100).cast("int")), 6).alias("rate"))


@query("agg_23_glossary", SQL + "SELECT term, count(*) AS n, array_to_string(list_sort(list(doc_id) FILTER (WHERE k <= 20)), ',') AS ids FROM (SELECT term, doc_id, row_number() OVER (PARTITION BY term ORDER BY doc_id) AS k FROM (SELECT DISTINCT lower(string_split(title, ' ')[1]) AS term, doc_id FROM wiki)) GROUP BY term")
def glossary(spark, sf_dir) -> DataFrame:
    """Term, its number of pages and the first twenty of them (a top list); no more than those are gathered."""
    t = wiki(spark, sf_dir).select(F.lower(F.split("title", " ")[0]).alias("term"), "doc_id").distinct()
    counts = t.groupBy("term").agg(F.count("*").alias("n"))
    first = t.withColumn("k", F.row_number().over(W.partitionBy("term").orderBy("doc_id"))).where("k <= 20").groupBy("term").agg(F.array_join(F.sort_array(F.collect_list("doc_id")).cast("array<string>"), ",").alias("ids"))
    return counts.join(first, counts["term"].eqNullSafe(first["term"])).select(counts["term"], "n", "ids")
