"""Event logs: idempotent appends, versions, replay, upserts, lineage; rule engines that emit issues."""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import Window as W
from pyspark.sql import functions as F

from corvane.plans.registry import query
from corvane.sources.tables import NOW, SQL, edges, read, wiki


def upsert(table: DataFrame, changes: DataFrame, key: str) -> DataFrame:
    """Rows of changes replace those with the same key and are added otherwise: one anti-join, no rewrite of matches."""
    return table.join(changes.select(key), key, "left_anti").unionByName(changes)


@query("snk_01_upsert", "WITH c AS (SELECT c_custkey + 100 AS k, 'new' AS v FROM customer WHERE c_custkey % 10 = 0) SELECT k, v FROM c UNION ALL SELECT c_custkey, c_name FROM customer WHERE c_custkey NOT IN (SELECT k FROM c)")
def upsert_query(spark, sf_dir) -> DataFrame:
    c = read(spark, sf_dir, "customer")
    changes = c.where("c_custkey % 10 = 0").select((F.col("c_custkey") + 100).alias("k"), F.lit("new").alias("v"))
    return upsert(c.select(F.col("c_custkey").alias("k"), F.col("c_name").alias("v")), changes, "k")


@query("snk_02_delete_by_key", SQL + "SELECT id FROM wiki WHERE source <> 'src0'")
def delete_by_key(spark, sf_dir) -> DataFrame:
    return wiki(spark, sf_dir).where("source <> 'src0'").select("id")


@query("snk_03_delete_count", SQL + "SELECT count(*) AS deleted FROM wiki WHERE source = 'src0'")
def delete_count(spark, sf_dir) -> DataFrame:
    return wiki(spark, sf_dir).where("source = 'src0'").agg(F.count("*").alias("deleted"))


@query("snk_07_append_new", SQL + "SELECT category, min(doc_id) AS first FROM wiki WHERE category NOT IN ('en') GROUP BY category")
def append_new(spark, sf_dir) -> DataFrame:
    """Index entries whose slug isn't there yet; the first of each is taken."""
    there = wiki(spark, sf_dir).where("category = 'en'").select("category").distinct()
    return wiki(spark, sf_dir).join(there, "category", "left_anti").groupBy("category").agg(F.min("doc_id").alias("first"))


@query("snk_08_append_event", "SELECT event_id, CASE WHEN k = 1 THEN 'ok' WHEN value IS NOT DISTINCT FROM first THEN 'duplicate' ELSE 'version_conflict' END AS outcome FROM (SELECT event_id, value, row_number() OVER (PARTITION BY user_id, event_type ORDER BY event_id) AS k, first_value(value) OVER (PARTITION BY user_id, event_type ORDER BY event_id) AS first FROM events)")
def append_event(spark, sf_dir) -> DataFrame:
    """By operation: the first append is kept, the same payload again is a duplicate, another one a conflict."""
    e = read(spark, sf_dir, "events").select("event_id", "user_id", "event_type", "value")
    first = e.groupBy("user_id", "event_type").agg(F.min(F.struct("event_id", "value")).alias("f"))
    same = F.col("value").eqNullSafe(F.col("f.value"))
    return e.join(first, ["user_id", "event_type"]).select("event_id", F.when(F.col("event_id") == F.col("f.event_id"), "ok").when(same, "duplicate").otherwise("version_conflict").alias("outcome"))


@query("snk_09_stream_versions", "SELECT event_id, user_id, row_number() OVER (PARTITION BY user_id ORDER BY ts, event_id) AS version FROM events")
def stream_versions(spark, sf_dir) -> DataFrame:
    return read(spark, sf_dir, "events").select("event_id", "user_id", F.row_number().over(W.partitionBy("user_id").orderBy("ts", "event_id")).cast("long").alias("version"))


@query("snk_19_relation_index", SQL + "SELECT id, sum(o)::BIGINT AS n_out, sum(i)::BIGINT AS n_in FROM (SELECT source_id AS id, 1 AS o, 0 AS i FROM edges UNION ALL SELECT target_id, 0, 1 FROM edges) GROUP BY id")
def relation_index(spark, sf_dir) -> DataFrame:
    """Outgoing and incoming relations of every page, in one grouping."""
    ends = F.explode(F.array(F.struct(F.col("source_id").alias("id"), F.lit(1).alias("o"), F.lit(0).alias("i")), F.struct(F.col("target_id").alias("id"), F.lit(0).alias("o"), F.lit(1).alias("i"))))
    return edges(spark, sf_dir).select(ends.alias("x")).groupBy("x.id").agg(F.sum("x.o").alias("n_out"), F.sum("x.i").alias("n_in"))


@query("src_34_read_stream", "SELECT event_id, version FROM (SELECT event_id, user_id, row_number() OVER (PARTITION BY user_id ORDER BY ts, event_id) AS version FROM events) WHERE user_id = 1 AND version > 2")
def read_stream(spark, sf_dir) -> DataFrame:
    """One stream from a version on; the filter on the stream reaches the scan."""
    own = read(spark, sf_dir, "events").where("user_id = 1")
    return own.select("event_id", F.row_number().over(W.orderBy("ts", "event_id")).cast("long").alias("version")).where("version > 2")


@query("src_33_read_since", "SELECT event_id FROM events WHERE ts >= TIMESTAMP '2024-01-01 12:00:00'")
def read_since(spark, sf_dir) -> DataFrame:
    return read(spark, sf_dir, "events").where(F.col("ts") >= F.lit("2024-01-01 12:00:00").cast("timestamp_ntz")).select("event_id")


def replay(log: DataFrame, version: int) -> DataFrame:
    """State of each object at a version: the last value of each field among its first events.

    log: object, version, field, value. A field's last value is an aggregate, so long logs are combined
    before they are shuffled.
    """
    return log.where(F.col("version") <= version).groupBy("object", "field").agg(F.max_by("value", "version").alias("value"))


@query("ver_01_replay", "WITH v AS (SELECT user_id AS object, event_type AS field, value, row_number() OVER (PARTITION BY user_id ORDER BY ts, event_id) AS version FROM events) SELECT object, field, arg_max(value, version) AS value FROM v WHERE version <= 10 GROUP BY object, field")
def replay_query(spark, sf_dir) -> DataFrame:
    version = F.row_number().over(W.partitionBy("user_id").orderBy("ts", "event_id"))
    log = read(spark, sf_dir, "events").select(F.col("user_id").alias("object"), version.alias("version"), F.col("event_type").alias("field"), "value")
    return replay(log, 10)


@query("ver_03_nth_version", "SELECT user_id, event_id FROM (SELECT *, row_number() OVER (PARTITION BY user_id ORDER BY ts, event_id) AS k FROM events) WHERE k = 3")
def nth_version(spark, sf_dir) -> DataFrame:
    return stream_versions(spark, sf_dir).where("version = 3").select("user_id", "event_id")


@query("ver_05_count", "SELECT user_id, count(*) AS n FROM events GROUP BY user_id")
def stream_counts(spark, sf_dir) -> DataFrame:
    return read(spark, sf_dir, "events").groupBy("user_id").agg(F.count("*").alias("n"))


@query("lin_06_outbox", "SELECT user_id, event_type, min(event_id) AS event_id FROM events GROUP BY ALL")
def outbox(spark, sf_dir) -> DataFrame:
    """Insert or ignore: the first event of each key."""
    return read(spark, sf_dir, "events").groupBy("user_id", "event_type").agg(F.min("event_id").alias("event_id"))


@query("lin_09_build_member", "SELECT o_orderkey AS id, coalesce(nullif(CASE WHEN o_orderkey % 4 = 0 THEN '' ELSE 'new' END, ''), o_orderstatus) AS hash FROM orders")
def build_member(spark, sf_dir) -> DataFrame:
    """A blank new hash keeps the old one."""
    new = F.when(F.col("o_orderkey") % 4 == 0, "").otherwise("new")
    return read(spark, sf_dir, "orders").select(F.col("o_orderkey").alias("id"), F.coalesce(F.nullif(new, F.lit("")), "o_orderstatus").alias("hash"))


@query("stm_01_ttl_dedup", None)
def ttl_dedup(spark, sf_dir) -> DataFrame:
    """Marks of a key within seven days of its first mark are dropped: a fold over each key's marks."""
    e = read(spark, sf_dir, "events").select("event_id", F.concat_ws(":", "user_id", "event_type").alias("key"), F.unix_millis(F.col("ts").cast("timestamp")).alias("at"))
    return first_marks(e, 7 * 86_400_000)


def first_marks(marks: DataFrame, ttl: int) -> DataFrame:
    """(event_id, key, at) of the marks that count: sequential per key, so it is a fold over a sorted array."""
    per = marks.groupBy("key").agg(F.sort_array(F.collect_list(F.struct("at", "event_id"))).alias("m"))
    start = F.array().cast("array<struct<at:bigint,event_id:bigint>>")
    kept = F.aggregate("m", start, lambda acc, x: F.when((F.size(acc) == 0) | (x["at"] - F.get(acc, F.size(acc) - 1)["at"] >= ttl), F.concat(acc, F.array(x))).otherwise(acc))
    return per.select("key", F.explode(kept).alias("x")).select("x.event_id", "key", "x.at")


@query("stm_08_debounce", "WITH g AS (SELECT event_id, user_id, ts, CASE WHEN ts - lag(ts) OVER (PARTITION BY user_id ORDER BY ts, event_id) < INTERVAL 1 HOUR THEN 0 ELSE 1 END AS new FROM events), s AS (SELECT *, sum(new) OVER (PARTITION BY user_id ORDER BY ts, event_id) AS k FROM g) SELECT user_id, min(ts) AS started, count(*) AS n FROM s GROUP BY user_id, k")
def debounce(spark, sf_dir) -> DataFrame:
    """Updates of one book flush together until none comes for an hour."""
    e = read(spark, sf_dir, "events").select("user_id", F.col("ts").cast("timestamp").alias("at"))
    return e.groupBy("user_id", F.session_window("at", "1 hour")).agg(F.min("at").cast("timestamp_ntz").alias("started"), F.count("*").alias("n")).select("user_id", "started", "n")


@query("stm_10_retention", "SELECT event_id FROM events WHERE ts >= (SELECT max(ts) FROM events) - INTERVAL 24 HOUR")
def keep_a_day(spark, sf_dir) -> DataFrame:
    e = read(spark, sf_dir, "events")
    last = e.agg(F.max("ts").alias("last"))
    return e.join(F.broadcast(last), F.col("ts") >= F.col("last") - F.expr("interval 24 hours")).select("event_id")


# Rules on pages: code, severity and condition.
def page_rules() -> list[tuple[str, str, object]]:
    c = F.col
    return [
        ("MISSING-TITLE", "error", c("title").isNull() | (F.trim("title") == "")),
        ("EMPTY-BODY", "error", c("body").isNull() | (F.trim("body") == "")),
        ("THIN-BODY", "warning", F.length("body") < 200),
        ("MISSING-SOURCES", "error", c("source").isNull()),
        ("RAW-PASTE", "warning", (c("type") != "source") & (F.length("body") > 5000)),
    ]


def issues(pages: DataFrame, rules) -> DataFrame:
    """(id, code, severity): one projection evaluates every rule on a row, so all of them share a single scan."""
    found = F.filter(F.array(*(F.when(cond, F.struct(F.lit(code).alias("code"), F.lit(severity).alias("severity"))) for code, severity, cond in rules)), lambda x: x.isNotNull())
    return pages.select("id", F.explode(found).alias("x")).select("id", "x.*")


LINT_SQL = SQL + "SELECT id, 'MISSING-TITLE' AS code, 'error' AS severity FROM wiki WHERE title IS NULL OR trim(title) = '' UNION ALL SELECT id, 'EMPTY-BODY', 'error' FROM wiki WHERE body IS NULL OR trim(body) = '' UNION ALL SELECT id, 'THIN-BODY', 'warning' FROM wiki WHERE length(body) < 200 UNION ALL SELECT id, 'MISSING-SOURCES', 'error' FROM wiki WHERE source IS NULL UNION ALL SELECT id, 'RAW-PASTE', 'warning' FROM wiki WHERE type <> 'source' AND length(body) > 5000"


@query("rul_01_lint", LINT_SQL)
def lint(spark, sf_dir) -> DataFrame:
    return issues(wiki(spark, sf_dir), page_rules())


@query("agg_37_gate_report", f"SELECT count(*) FILTER (WHERE severity = 'error') AS blockers, count(*) AS issues, count(*) FILTER (WHERE severity = 'error') = 0 AS passed FROM ({LINT_SQL})")
def gate_report(spark, sf_dir) -> DataFrame:
    bad = F.count_if(F.col("severity") == "error")
    return lint(spark, sf_dir).agg(bad.alias("blockers"), F.count("*").alias("issues"), (bad == 0).alias("passed"))


@query("rul_03_batch_gate", SQL + "SELECT 'P5' AS code, source AS object_id, count(*) AS n FROM wiki WHERE type = 'source' GROUP BY source HAVING count(*) > 1 UNION ALL SELECT 'P6', title, count(DISTINCT type) FROM wiki GROUP BY title HAVING count(DISTINCT type) > 1")
def batch_gate(spark, sf_dir) -> DataFrame:
    """Several source pages of one raw source, and titles with several types."""
    w = wiki(spark, sf_dir)
    p5 = w.where("type = 'source'").groupBy(F.col("source").alias("object_id")).agg(F.count("*").alias("n")).where("n > 1")
    p6 = w.groupBy(F.col("title").alias("object_id")).agg(F.count_distinct("type").alias("n")).where("n > 1")
    return p5.select(F.lit("P5").alias("code"), "object_id", "n").union(p6.select(F.lit("P6"), "object_id", "n"))


@query("rul_06_schema_gate", "SELECT c_custkey AS id, CASE WHEN c_name IS NULL OR c_name = '' THEN 'name' WHEN c_acctbal < 0 THEN 'balance' END AS field FROM customer WHERE c_name IS NULL OR c_name = '' OR c_acctbal < 0")
def schema_gate(spark, sf_dir) -> DataFrame:
    field = F.when(F.col("c_name").isNull() | (F.col("c_name") == ""), "name").when(F.col("c_acctbal") < 0, "balance")
    return read(spark, sf_dir, "customer").select(F.col("c_custkey").alias("id"), field.alias("field")).where("field is not null")


@query("rul_13_temporal_gate", "SELECT l_orderkey AS order_id, l_linenumber AS line FROM lineitem JOIN orders ON l_orderkey = o_orderkey WHERE o_orderdate > l_shipdate")
def temporal_gate(spark, sf_dir) -> DataFrame:
    """Intervals that end before they begin."""
    o = read(spark, sf_dir, "orders").select("o_orderkey", "o_orderdate")
    return read(spark, sf_dir, "lineitem").select("l_orderkey", "l_linenumber", "l_shipdate").join(o, F.col("l_orderkey") == F.col("o_orderkey")).where("o_orderdate > l_shipdate").select(F.col("l_orderkey").alias("order_id"), F.col("l_linenumber").alias("line"))


@query("rul_20_id_format", "SELECT doc_id FROM documents WHERE NOT regexp_matches(source, '^src[0-9]$')")
def id_format(spark, sf_dir) -> DataFrame:
    return read(spark, sf_dir, "documents").where(~F.col("source").rlike("^src[0-9]$")).select("doc_id")


@query("pub_11_partition_pages", SQL + "SELECT type || '-' || category AS volume, count(*) AS n, min(doc_id) AS first FROM wiki GROUP BY 1")
def partition_pages(spark, sf_dir) -> DataFrame:
    """Volumes by type and taxonomy, which cover every page once."""
    return wiki(spark, sf_dir).groupBy(F.concat_ws("-", "type", "category").alias("volume")).agg(F.count("*").alias("n"), F.min("doc_id").alias("first"))


@query("top_07_next_task", "SELECT event_id FROM events WHERE event_type = 'signup' ORDER BY ts, event_id LIMIT 1")
def next_task(spark, sf_dir) -> DataFrame:
    return read(spark, sf_dir, "events").where("event_type = 'signup'").orderBy("ts", "event_id").limit(1).select("event_id")


@query("src_40_recent_changes", "SELECT event_id, ts FROM events ORDER BY ts DESC, event_id DESC LIMIT 50")
def recent_changes(spark, sf_dir) -> DataFrame:
    return read(spark, sf_dir, "events").orderBy(F.desc("ts"), F.desc("event_id")).limit(50).select("event_id", "ts")


@query("sup_51_cache_lookup", SQL + f"SELECT id FROM wiki WHERE {NOW} - created_at < 7 * 86400000")
def fresh(spark, sf_dir) -> DataFrame:
    return wiki(spark, sf_dir).where(F.lit(NOW) - F.col("created_at") < 7 * 86_400_000).select("id")
