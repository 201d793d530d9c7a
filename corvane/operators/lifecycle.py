"""Heat, validity, status machines, and the rules on knowledge objects."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import Window as W
from pyspark.sql import functions as F

from corvane.plans.registry import query
from corvane.sources.tables import DAY, NOW, SQL, edges, read, tasks, wiki

# How pages cool down.
DECAY_DAYS, DECAY_AMOUNT, HEAT_STEP = 30, 10, 5


def decayed(pages: DataFrame, now: int = NOW) -> DataFrame:
    """Pages idle for over 30 days lose 10 degrees, immutable ones none; at 0 they become zombies."""
    active = F.greatest("created_at", "last_used_at")
    cools = ~F.col("is_immutable") & (active > 0) & (active < now - DECAY_DAYS * DAY) & (F.col("heat") > 0)
    heat = F.when(cools, F.greatest(F.lit(0), F.col("heat") - DECAY_AMOUNT)).otherwise(F.col("heat")).cast("long")
    return pages.withColumn("new_heat", heat).withColumn("zombie_since", F.when(cools & (F.col("new_heat") == 0), F.lit(now)))


@query("fn_12_heat_decay", SQL + f", c AS (SELECT *, NOT is_immutable AND greatest(created_at, last_used_at) > 0 AND greatest(created_at, last_used_at) < {NOW - DECAY_DAYS * DAY} AND heat > 0 AS cools FROM wiki) SELECT id, CASE WHEN cools THEN greatest(0, heat - 10) ELSE heat END AS new_heat, CASE WHEN cools AND heat <= 10 THEN {NOW} END AS zombie_since FROM c")
def heat_decay(spark, sf_dir) -> DataFrame:
    return decayed(wiki(spark, sf_dir)).select("id", "new_heat", "zombie_since")


@query("fn_13_heat_increment", SQL + "SELECT id, least(100, greatest(0, heat + 5)) AS new_heat FROM wiki")
def heat_increment(spark, sf_dir) -> DataFrame:
    return wiki(spark, sf_dir).select("id", F.least(F.lit(100), F.greatest(F.lit(0), F.col("heat") + HEAT_STEP)).alias("new_heat"))


@query("fn_14_decay_events", SQL + f"SELECT id, greatest(0, heat - 10) - heat AS delta, 'decay' AS reason, {NOW} AS at FROM wiki WHERE last_used_at > 0 AND last_used_at < {NOW - DECAY_DAYS * DAY} AND heat > 0")
def decay_events(spark, sf_dir) -> DataFrame:
    """The batch rule looks at the last use alone."""
    idle = wiki(spark, sf_dir).where((F.col("last_used_at") > 0) & (F.col("last_used_at") < NOW - DECAY_DAYS * DAY) & (F.col("heat") > 0))
    return idle.select("id", (F.greatest(F.lit(0), F.col("heat") - DECAY_AMOUNT) - F.col("heat")).alias("delta"), F.lit("decay").alias("reason"), F.lit(NOW).alias("at"))


@query("top_04_decay_candidates", SQL + f"SELECT id, round((100 - heat) + CASE WHEN last_used_at > 0 THEN 0.5 * least(({NOW} - last_used_at) / {DAY}, 365) ELSE 0 END + CASE grade WHEN 'C' THEN 50 WHEN 'B' THEN 10 ELSE 0 END, 6)::DOUBLE AS score FROM wiki")
def decay_candidates(spark, sf_dir) -> DataFrame:
    """Priority: cold, long unused and badly graded pages first."""
    age = F.when(F.col("last_used_at") > 0, 0.5 * F.least((F.lit(NOW) - F.col("last_used_at")) / DAY, F.lit(365))).otherwise(0.0)
    grade = F.when(F.col("grade") == "C", 50).when(F.col("grade") == "B", 10).otherwise(0)
    return wiki(spark, sf_dir).select("id", F.round(100 - F.col("heat") + age + grade, 6).alias("score"))


@query("agg_03_heat_pools", SQL + "SELECT count(*) FILTER (WHERE heat >= 80) AS hot, count(*) FILTER (WHERE heat >= 40 AND heat < 80) AS warm, count(*) FILTER (WHERE heat < 40 AND heat > 0) AS cold, count(*) FILTER (WHERE heat = 0) AS zombie FROM wiki")
def heat_pools(spark, sf_dir) -> DataFrame:
    h = F.col("heat")
    return wiki(spark, sf_dir).agg(F.count_if(h >= 80).alias("hot"), F.count_if((h >= 40) & (h < 80)).alias("warm"), F.count_if((h < 40) & (h > 0)).alias("cold"), F.count_if(h == 0).alias("zombie"))


def temporal_status(since, until, at) -> Column:
    """unknown without bounds; scheduled before, historical from its end on, else current."""
    return F.when(since.isNull() & until.isNull(), "unknown").when(since > at, "scheduled").when(until <= at, "historical").otherwise("current")


ORDERS_SQL = "WITH v AS (SELECT l.l_orderkey AS order_id, l.l_linenumber AS line, CASE WHEN l.l_linenumber % 4 = 0 THEN NULL ELSE o.o_orderdate END AS since, CASE WHEN l.l_linenumber % 3 = 0 OR l.l_linenumber % 4 = 0 AND l.l_orderkey % 2 = 0 THEN NULL ELSE l.l_shipdate END AS until FROM lineitem l JOIN orders o ON l.l_orderkey = o.o_orderkey) "


def validity(spark, sf_dir) -> DataFrame:
    """Intervals from order to shipment, some of them open."""
    o, line = read(spark, sf_dir, "orders").select("o_orderkey", "o_orderdate"), read(spark, sf_dir, "lineitem").select("l_orderkey", "l_linenumber", "l_shipdate")
    n = F.col("l_linenumber")
    open_end = (n % 3 == 0) | ((n % 4 == 0) & (F.col("l_orderkey") % 2 == 0))
    return line.join(o, line["l_orderkey"] == o["o_orderkey"]).select(F.col("l_orderkey").alias("order_id"), n.alias("line"), F.when(n % 4 != 0, F.col("o_orderdate")).alias("since"), F.when(~open_end, F.col("l_shipdate")).alias("until"))


@query("flt_04_temporal_status", ORDERS_SQL + "SELECT CASE WHEN since IS NULL AND until IS NULL THEN 'unknown' WHEN since > TIMESTAMP '1995-06-17' THEN 'scheduled' WHEN until <= TIMESTAMP '1995-06-17' THEN 'historical' ELSE 'current' END AS status, count(*) AS n FROM v GROUP BY 1")
def temporal_statuses(spark, sf_dir) -> DataFrame:
    at = F.lit("1995-06-17").cast("timestamp_ntz")
    return validity(spark, sf_dir).groupBy(temporal_status(F.col("since"), F.col("until"), at).alias("status")).agg(F.count("*").alias("n"))


@query("flt_05_temporal_filter", ORDERS_SQL + "SELECT order_id, line FROM v WHERE NOT (since IS NULL AND until IS NULL) AND NOT coalesce(since > TIMESTAMP '1995-06-17', false) AND NOT coalesce(until <= TIMESTAMP '1995-06-17', false)")
def current_only(spark, sf_dir) -> DataFrame:
    at = F.lit("1995-06-17").cast("timestamp_ntz")
    return validity(spark, sf_dir).where(temporal_status(F.col("since"), F.col("until"), at) == "current").select("order_id", "line")


def temporally_disjoint(a_from, a_to, b_from, b_to) -> Column:
    """Half-open intervals, null bounds open."""
    known = F.coalesce(a_from, a_to, b_from, b_to).isNotNull()
    return known & (F.coalesce(a_to <= b_from, F.lit(False)) | F.coalesce(b_to <= a_from, F.lit(False)))


@query("fn_16_temporal_disjoint", ORDERS_SQL + "SELECT a.order_id, a.line AS line_a, b.line AS line_b, coalesce(a.since, a.until, b.since, b.until) IS NOT NULL AND (coalesce(a.until <= b.since, false) OR coalesce(b.until <= a.since, false)) AS disjoint FROM v a JOIN v b ON a.order_id = b.order_id AND a.line < b.line")
def disjoint_validity(spark, sf_dir) -> DataFrame:
    v = validity(spark, sf_dir)
    a, b = (v.select("order_id", F.col("line").alias(f"line_{x}"), F.col("since").alias(f"since_{x}"), F.col("until").alias(f"until_{x}")) for x in "ab")
    both = a.join(b, "order_id").where("line_a < line_b")
    return both.select("order_id", "line_a", "line_b", temporally_disjoint(*(F.col(c) for c in ("since_a", "until_a", "since_b", "until_b"))).alias("disjoint"))


# Which status may follow which, for tasks, candidates and manifests.
TASK_MOVES = [
    ("pending", "running"),
    ("pending", "failed"),
    ("running", "waiting_review"),
    ("running", "approved"),
    ("running", "failed"),
    ("waiting_review", "approved"),
    ("waiting_review", "rejected"),
    ("rejected", "archived"),
    ("rejected", "pending"),
    ("approved", "archived"),
    ("failed", "pending"),
    ("failed", "archived"),
    ("failed", "dead_letter"),
    ("timeout", "pending"),
    ("timeout", "archived"),
    ("timeout", "dead_letter"),
]
CANDIDATE_MOVES = [("pending", "validated"), ("pending", "rejected"), ("validated", "promoted"), ("rejected", "pending")]
MOVES_SQL = f"(VALUES {', '.join(map(str, TASK_MOVES))}) m(a, b)"
# What a task's status makes of its object.
TASK_LIFECYCLE = {"running": "processing", "waiting_review": "reviewing", "approved": "active", "rejected": "rejected", "failed": "failed", "archived": "archived", "timeout": "archived", "dead_letter": "failed"}


def transitions(changes: DataFrame, moves: list[tuple[str, str]]) -> DataFrame:
    """changes with the status before and whether the step is allowed; the moves are a handful of literals."""
    before = F.lag("status").over(W.partitionBy("task_id").orderBy("ts", "event_id"))
    allowed = F.array(*(F.lit(f"{a}>{b}") for a, b in moves))
    steps = changes.withColumn("before", before).where("before is not null")
    return steps.withColumn("allowed", F.array_contains(allowed, F.concat("before", F.lit(">"), "status")))


@query("fn_27_task_transitions", SQL + f", s AS (SELECT task_id, status, lag(status) OVER (PARTITION BY task_id ORDER BY ts, event_id) AS before FROM tasks) SELECT before, status, EXISTS (SELECT 1 FROM {MOVES_SQL} WHERE m.a = before AND m.b = status) AS allowed, count(*) AS n FROM s WHERE before IS NOT NULL GROUP BY ALL")
def task_transitions(spark, sf_dir) -> DataFrame:
    return transitions(tasks(spark, sf_dir), TASK_MOVES).groupBy("before", "status", "allowed").agg(F.count("*").alias("n"))


@query("stm_05_retry", SQL + ", f AS (SELECT event_id, task_id, count(*) OVER (PARTITION BY task_id ORDER BY ts, event_id) AS failures FROM tasks WHERE status = 'failed') SELECT event_id, task_id, failures, CASE WHEN failures < 3 THEN 'pending' ELSE 'dead_letter' END AS decision FROM f")
def retry(spark, sf_dir) -> DataFrame:
    """A failed task is tried again until its third failure."""
    n = F.count("*").over(W.partitionBy("task_id").orderBy("ts", "event_id"))
    failed = tasks(spark, sf_dir).where("status = 'failed'").select("event_id", "task_id", n.alias("failures"))
    return failed.withColumn("decision", F.when(F.col("failures") < 3, "pending").otherwise("dead_letter"))


@query("sup_54_fail_streak", SQL + ", g AS (SELECT *, sum(CASE WHEN status <> 'failed' THEN 1 ELSE 0 END) OVER (PARTITION BY task_id ORDER BY ts, event_id) AS run FROM tasks), s AS (SELECT event_id, task_id, status, sum(CASE WHEN status = 'failed' THEN 1 ELSE 0 END) OVER (PARTITION BY task_id, run ORDER BY ts, event_id)::BIGINT AS streak FROM g) SELECT event_id, task_id, streak, streak >= 3 AS blocked FROM s WHERE status = 'failed'")
def fail_streak(spark, sf_dir) -> DataFrame:
    """Failures in a row; from the third on the task is blocked."""
    order = W.partitionBy("task_id").orderBy("ts", "event_id")
    runs = tasks(spark, sf_dir).withColumn("run", F.sum(F.when(F.col("status") != "failed", 1).otherwise(0)).over(order))
    streak = F.sum(F.when(F.col("status") == "failed", 1).otherwise(0)).over(W.partitionBy("task_id", "run").orderBy("ts", "event_id"))
    return runs.withColumn("streak", streak).where("status = 'failed'").select("event_id", "task_id", "streak", (F.col("streak") >= 3).alias("blocked"))


@query("fn_32_low_quality", SQL + "SELECT id FROM wiki WHERE grade = 'C' AND heat < 10")
def low_quality(spark, sf_dir) -> DataFrame:
    return wiki(spark, sf_dir).where("grade = 'C' and heat < 10").select("id")


# Inverse relation types; contradicts, analogous_to and opposite_of are their own inverses.
INVERSES = {
    "is_part_of": "contains",
    "contains": "is_part_of",
    "references": "referenced_by",
    "referenced_by": "references",
    "causes": "caused_by",
    "caused_by": "causes",
    "supports": "supported_by",
    "supported_by": "supports",
    "supersedes": "superseded_by",
    "superseded_by": "supersedes",
    "depends_on": "required_by",
    "required_by": "depends_on",
    "derived_from": "derives",
    "derives": "derived_from",
}
SYMMETRIC = ("contradicts", "analogous_to", "opposite_of")


def inverse_edges(found: DataFrame) -> DataFrame:
    """The inverse of each edge with a direction, if it is not there yet."""
    names = F.create_map(*[F.lit(x) for kv in INVERSES.items() for x in kv])
    inverse = found.where(F.col("type").isin(*INVERSES)).select(F.col("target_id").alias("source_id"), F.col("source_id").alias("target_id"), F.element_at(names, F.col("type")).alias("type"))
    return inverse.join(found, ["source_id", "target_id", "type"], "left_anti").distinct()


@query("gr_04_inverse_edges", SQL + "SELECT DISTINCT target_id AS source_id, source_id AS target_id, CASE type WHEN 'references' THEN 'referenced_by' ELSE 'contains' END AS type FROM edges WHERE type IN ('references', 'is_part_of')")
def inverse_edges_query(spark, sf_dir) -> DataFrame:
    return inverse_edges(edges(spark, sf_dir))


@query("fn_23_inverse_type", SQL + "SELECT type, CASE type WHEN 'references' THEN 'referenced_by' WHEN 'is_part_of' THEN 'contains' ELSE type END AS inverse, count(*) AS n FROM edges GROUP BY ALL")
def inverse_type(spark, sf_dir) -> DataFrame:
    names = F.create_map(*[F.lit(x) for kv in (INVERSES | {s: s for s in SYMMETRIC}).items() for x in kv])
    return edges(spark, sf_dir).groupBy("type", F.element_at(names, F.col("type")).alias("inverse")).agg(F.count("*").alias("n"))


@query("gr_05_batch_inverse", SQL + "SELECT DISTINCT target_id AS source_id, source_id AS target_id, CASE type WHEN 'references' THEN 'referenced_by' ELSE 'contains' END AS type FROM edges WHERE type IN ('references', 'is_part_of') AND target_id IN (SELECT id FROM wiki)")
def batch_inverse(spark, sf_dir) -> DataFrame:
    """Inverse edges, for pages that exist."""
    there = wiki(spark, sf_dir).select(F.col("id").alias("source_id"))
    return inverse_edges(edges(spark, sf_dir)).join(there, "source_id", "left_semi").select("source_id", "target_id", "type")


@query("gr_07_inverse_closure", SQL + ", i AS (SELECT target_id AS source_id, source_id AS target_id, CASE type WHEN 'references' THEN 'referenced_by' ELSE 'contains' END AS type FROM edges WHERE type IN ('references', 'is_part_of')) SELECT source_id, target_id, type FROM edges UNION SELECT * FROM i")
def inverse_closure(spark, sf_dir) -> DataFrame:
    e = edges(spark, sf_dir)
    return e.select("source_id", "target_id", "type").union(inverse_edges(e).select("source_id", "target_id", "type")).distinct()


@query("fn_26_task_lifecycle", SQL + "SELECT status, CASE status WHEN 'running' THEN 'processing' WHEN 'waiting_review' THEN 'reviewing' WHEN 'approved' THEN 'active' WHEN 'failed' THEN 'failed' END AS lifecycle, count(*) AS n FROM tasks GROUP BY ALL")
def task_lifecycle(spark, sf_dir) -> DataFrame:
    """Pending tasks have no object yet."""
    names = F.create_map(*[F.lit(x) for kv in TASK_LIFECYCLE.items() for x in kv])
    return tasks(spark, sf_dir).groupBy("status", F.element_at(names, F.col("status")).alias("lifecycle")).agg(F.count("*").alias("n"))


@query("fn_24_candidate_moves", "WITH m(a, b) AS (VALUES ('pending', 'validated'), ('pending', 'rejected'), ('validated', 'promoted'), ('rejected', 'pending')), s(x) AS (VALUES ('pending'), ('validated'), ('rejected'), ('promoted')) SELECT p.x AS before, q.x AS status, EXISTS (SELECT 1 FROM m WHERE a = p.x AND b = q.x) AS allowed FROM s p, s q")
def candidate_moves(spark, sf_dir) -> DataFrame:
    """The whole table of a small state machine: sixteen rows."""
    states = spark.createDataFrame([(x,) for x in ("pending", "validated", "rejected", "promoted")], "s string")
    pairs = states.select(F.col("s").alias("before"), F.explode(F.array(*map(F.lit, ("pending", "validated", "rejected", "promoted")))).alias("status"))
    return pairs.withColumn("allowed", F.array_contains(F.array(*(F.lit(f"{a}>{b}") for a, b in CANDIDATE_MOVES)), F.concat_ws(">", "before", "status")))


@query("fn_22_merge_unit", "SELECT a.conv_id, b.conv_id AS other, count(*) AS n_shared FROM (SELECT DISTINCT conv_id, role, length(text) AS k FROM conversations) a JOIN (SELECT DISTINCT conv_id, role, length(text) AS k FROM conversations) b ON a.role = b.role AND a.k = b.k AND a.conv_id < b.conv_id GROUP BY ALL HAVING count(*) >= 2")
def merge_unit(spark, sf_dir) -> DataFrame:
    """Units that agree in two questions or more may be merged."""
    c = read(spark, sf_dir, "conversations").select("conv_id", "role", F.length("text").alias("k")).distinct()
    both = c.join(c.withColumnRenamed("conv_id", "other"), ["role", "k"]).where("conv_id < other")
    return both.groupBy("conv_id", "other").agg(F.count("*").alias("n_shared")).where("n_shared >= 2")


@query("sup_31_error_class", "SELECT event_id, CASE WHEN event_id % 600 = 429 THEN 'rate_limit' WHEN event_id % 600 = 422 THEN 'content_moderation' WHEN event_id % 600 >= 500 THEN 'transient' ELSE 'permanent' END AS class FROM events WHERE event_type = 'error'")
def error_class(spark, sf_dir) -> DataFrame:
    """A retry policy from the status code."""
    status = F.col("event_id") % 600
    kind = F.when(status == 429, "rate_limit").when(status == 422, "content_moderation").when(status >= 500, "transient").otherwise("permanent")
    return read(spark, sf_dir, "events").where("event_type = 'error'").select("event_id", kind.alias("class"))


@query("sup_36_restore_zombies", SQL + "SELECT id, CASE WHEN heat = 0 THEN 100 ELSE heat END AS heat, is_immutable OR heat = 0 AS is_immutable FROM wiki")
def restore_zombies(spark, sf_dir) -> DataFrame:
    zombie = F.col("heat") == 0
    return wiki(spark, sf_dir).select("id", F.when(zombie, 100).otherwise(F.col("heat")).alias("heat"), (F.col("is_immutable") | zombie).alias("is_immutable"))


@query("top_05_curate", SQL + "SELECT * FROM (SELECT 'low_quality' AS proposal, id FROM wiki WHERE grade = 'C' AND heat < 10 ORDER BY doc_id LIMIT 5) UNION ALL SELECT * FROM (SELECT 'obsolete', id FROM wiki WHERE heat = 0 ORDER BY doc_id LIMIT 5)")
def curate(spark, sf_dir) -> DataFrame:
    """At most five proposals from each pass."""
    w = wiki(spark, sf_dir)
    one = w.where("grade = 'C' and heat < 10").orderBy("doc_id").limit(5).select(F.lit("low_quality").alias("proposal"), "id")
    return one.union(w.where("heat = 0").orderBy("doc_id").limit(5).select(F.lit("obsolete"), "id"))
