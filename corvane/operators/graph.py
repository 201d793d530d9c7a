"""Relations between pages: neighbours, paths, backlinks, lint, alias chains."""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from corvane.plans.folders import new_folder
from corvane.plans.registry import query
from corvane.sources.tables import SQL, edges, read, wiki


def neighbours(found: DataFrame, start: str, depth: int) -> DataFrame:
    """(id, hops, weight) of what can be reached in at most depth steps; the first visit counts, with the largest product of weights.

    One join for each step, of the frontier with the edges; depth is a small parameter.
    """
    seen = found.sparkSession.createDataFrame([(start, 0, 1.0)], "id string, hops int, weight double")
    frontier = seen
    for step in range(1, depth + 1):
        reached = frontier.select(F.col("id").alias("source_id"), F.col("weight").alias("w")).join(found, "source_id")
        frontier = reached.groupBy(F.col("target_id").alias("id")).agg(F.max(F.col("w") * F.col("weight")).alias("weight")).join(seen, "id", "left_anti").select("id", F.lit(step).alias("hops"), "weight")
        seen = seen.union(frontier)
    return seen.where("hops > 0")


NEIGHBOURS_SQL = ", h1 AS (SELECT target_id AS id, max(weight) AS weight FROM edges WHERE source_id = 'doc-0' AND target_id <> 'doc-0' GROUP BY 1), h2 AS (SELECT e.target_id AS id, max(h.weight * e.weight) AS weight FROM h1 h JOIN edges e ON e.source_id = h.id WHERE e.target_id <> 'doc-0' AND e.target_id NOT IN (SELECT id FROM h1) GROUP BY 1), h3 AS (SELECT e.target_id AS id, max(h.weight * e.weight) AS weight FROM h2 h JOIN edges e ON e.source_id = h.id WHERE e.target_id <> 'doc-0' AND e.target_id NOT IN (SELECT id FROM h1) AND e.target_id NOT IN (SELECT id FROM h2) GROUP BY 1) SELECT id, 1 AS hops, round(weight, 6)::DOUBLE AS weight FROM h1 UNION ALL SELECT id, 2, round(weight, 6)::DOUBLE FROM h2 UNION ALL SELECT id, 3, round(weight, 6)::DOUBLE FROM h3"


@query("gr_01_neighbours", SQL + NEIGHBOURS_SQL)
def neighbours_query(spark, sf_dir) -> DataFrame:
    return neighbours(edges(spark, sf_dir), "doc-0", 3).select("id", "hops", F.round("weight", 6).alias("weight"))


def shortest_path(found: DataFrame, start: str, end: str, most: int | None = None) -> DataFrame:
    """(hops, path) of the shortest path, the alphabetically first of several; no row if there is none (in at most most steps).

    Each step is written to the shared folder and read again, until it reaches the end or nothing new.
    """
    spark, place, step = found.sparkSession, new_folder(found.sparkSession, "path"), 0
    found.select("source_id", "target_id").distinct().write.parquet(f"{place}/links")
    links, schema = spark.read.schema("source_id string, target_id string").parquet(f"{place}/links"), "id string, path array<string>"
    spark.createDataFrame([(start, [start])], schema).write.parquet(f"{place}/0")
    while True:
        frontier = spark.read.schema(schema).parquet(f"{place}/{step}")
        there = frontier.where(F.col("id") == end)
        if step == most or not there.isEmpty() or frontier.isEmpty():
            return there.select((F.size("path") - 1).cast("long").alias("hops"), F.array_join("path", ">").alias("path"))
        seen = spark.read.schema("id string").parquet(*(f"{place}/{k}" for k in range(step + 1)))
        after = frontier.withColumnRenamed("id", "source_id").join(links, "source_id")
        after = after.groupBy(F.col("target_id").alias("id")).agg(F.min(F.concat("path", F.array("target_id"))).alias("path"))
        step += 1
        after.join(seen, "id", "left_anti").select("id", "path").write.parquet(f"{place}/{step}")


@query(
    "gr_02_shortest_path",
    "WITH RECURSIVE " + SQL.strip().removeprefix("WITH") + ", walk AS (SELECT 'doc-0' AS id, ['doc-0'] AS path, 0 AS hops UNION ALL SELECT e.target_id, list_append(w.path, e.target_id), w.hops + 1 FROM walk w JOIN edges e ON e.source_id = w.id WHERE w.hops < 6 AND NOT list_contains(w.path, e.target_id)) SELECT hops::BIGINT AS hops, array_to_string(path, '>') AS path FROM walk WHERE id = 'doc-23' ORDER BY hops, path LIMIT 1",
)
def shortest_path_query(spark, sf_dir) -> DataFrame:
    return shortest_path(edges(spark, sf_dir), "doc-0", "doc-23")


@query("gr_03_backlinks", SQL + "SELECT source_id, type, weight FROM edges WHERE target_id = 'doc-1'")
def backlinks(spark, sf_dir) -> DataFrame:
    return edges(spark, sf_dir).where("target_id = 'doc-1'").select("source_id", "type", "weight")


@query("gr_06_fold_relations", SQL + "SELECT source_id, target_id, max(weight) AS weight, count(*) AS n FROM edges GROUP BY ALL")
def fold_relations(spark, sf_dir) -> DataFrame:
    """Parallel edges become one with the largest weight."""
    return edges(spark, sf_dir).groupBy("source_id", "target_id").agg(F.max("weight").alias("weight"), F.count("*").alias("n"))


@query("gr_11_both_ways", SQL + "SELECT target_id AS id, type, 'out' AS direction FROM edges WHERE source_id = 'doc-5' UNION ALL SELECT source_id, type, 'in' FROM edges WHERE target_id = 'doc-5'")
def both_ways(spark, sf_dir) -> DataFrame:
    e = edges(spark, sf_dir)
    return e.where("source_id = 'doc-5'").select(F.col("target_id").alias("id"), "type", F.lit("out").alias("direction")).union(e.where("target_id = 'doc-5'").select("source_id", "type", F.lit("in")))


@query("gr_12_remove_node", SQL + "SELECT source_id, target_id, type FROM edges WHERE source_id <> 'doc-5' AND target_id <> 'doc-5'")
def remove_node(spark, sf_dir) -> DataFrame:
    """The edges that are left without a node."""
    return edges(spark, sf_dir).where("source_id <> 'doc-5' and target_id <> 'doc-5'").select("source_id", "target_id", "type")


@query("gr_16_graph_lint", SQL + "SELECT 'orphan' AS issue, id FROM wiki WHERE type <> 'source' AND id NOT IN (SELECT target_id FROM edges) UNION ALL SELECT 'dangling', source_id || '>' || target_id FROM edges WHERE target_id NOT IN (SELECT id FROM wiki)")
def graph_lint(spark, sf_dir) -> DataFrame:
    """Pages that nothing points to, and edges to pages that don't exist."""
    pages, e = wiki(spark, sf_dir).select("id", "type"), edges(spark, sf_dir)
    orphans = pages.where("type <> 'source'").join(e.select(F.col("target_id").alias("id")), "id", "left_anti").select(F.lit("orphan").alias("issue"), "id")
    dangling = e.join(pages.select(F.col("id").alias("target_id")), "target_id", "left_anti").select(F.lit("dangling"), F.concat_ws(">", "source_id", "target_id"))
    return orphans.union(dangling)


def canonical(aliases: DataFrame, hops: int = 7) -> DataFrame:
    """(alias, canonical): the end of each alias chain of at most hops steps; null for longer ones and cycles."""
    step = aliases.select(F.col("alias").alias("at"), F.col("canonical").alias("next"))
    out = aliases.select("alias", F.col("canonical").alias("at"))
    for _ in range(hops):
        out = out.join(step, "at", "left").select("alias", F.coalesce("next", "at").alias("at"))
    return out.join(step, "at", "left").select("alias", F.when(F.col("next").isNull(), F.col("at")).alias("canonical"))


ALIASES_SQL = "WITH RECURSIVE aliases AS (SELECT c_custkey AS alias, CASE WHEN c_custkey % 10 = 3 THEN c_custkey - 2 ELSE c_custkey - 1 END AS canonical FROM customer WHERE c_custkey % 10 NOT IN (0, 1) UNION ALL SELECT c_custkey, c_custkey FROM customer WHERE c_custkey % 50 = 1), walk AS (SELECT alias, canonical AS at, 1 AS hops FROM aliases UNION ALL SELECT w.alias, a.canonical, hops + 1 FROM walk w JOIN aliases a ON a.alias = w.at WHERE hops < 9) SELECT a.alias, max(CASE WHEN hops <= 8 AND w.at NOT IN (SELECT alias FROM aliases) THEN w.at END) AS canonical FROM aliases a JOIN walk w ON w.alias = a.alias GROUP BY a.alias"


@query("gr_17_alias_chain", ALIASES_SQL)
def alias_chain(spark, sf_dir) -> DataFrame:
    c = read(spark, sf_dir, "customer").select(F.col("c_custkey").alias("alias"))
    k = F.col("alias")
    chains = c.where(~(k % 10).isin(0, 1)).select("alias", F.when(k % 10 == 3, k - 2).otherwise(k - 1).alias("canonical"))
    return canonical(chains.union(c.where(k % 50 == 1).select("alias", k)))


@query("gr_20_provenance", SQL + "SELECT 'doc-0' AS id, w.source, count(*) AS n_siblings FROM wiki w WHERE w.source = (SELECT source FROM wiki WHERE id = 'doc-0') AND w.id <> 'doc-0' GROUP BY w.source")
def provenance(spark, sf_dir) -> DataFrame:
    """An object's source and how many others come from it."""
    w = wiki(spark, sf_dir).select("id", "source")
    own = w.where("id = 'doc-0'").select(F.col("id").alias("own"), "source")
    return own.join(w, "source").where("id <> own").groupBy(F.col("own").alias("id"), "source").agg(F.count("*").alias("n_siblings"))


@query("gr_13_nodes_by_type", SQL + "SELECT id, title FROM wiki WHERE type = 'concept'")
def nodes_by_type(spark, sf_dir) -> DataFrame:
    return wiki(spark, sf_dir).where("type = 'concept'").select("id", "title")
