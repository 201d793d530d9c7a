"""Pages as knowledge objects and back, migrations between versions, and the editorial state of a book."""

from __future__ import annotations

from functools import reduce

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from corvane.operators.graph import shortest_path
from corvane.plans.registry import query
from corvane.sources.tables import SQL, read, wiki

# Kinds of objects by type of page and back, states of an object, fates of a page in a book.
KIND_OF = {"source": "document", "entity": "entity", "concept": "concept", "synthesis": "synthesis"}
TYPE_OF = {"document": "source", "entity": "entity", "concept": "concept", "claim": "concept", "decision": "concept", "procedure": "concept", "event": "concept", "synthesis": "synthesis"}
STATES = ("created", "processing", "reviewing", "active", "deprecated", "archived", "failed", "rejected")
DISPOSITIONS, USED = ("include", "duplicate", "conflict", "exclude", "unresolved"), ("include", "conflict")


def looked_up(table: dict[str, str], c: str) -> Column:
    return F.element_at(F.create_map(*(F.lit(x) for pair in table.items() for x in pair)), F.col(c))


def as_objects(pages: DataFrame) -> DataFrame:
    """Objects of pages (id, type, title, body, grade, heat, created_at, sources, is_immutable, last_used_at, category, extra).

    extra: struct of lifecycle, confidence and source_paths, null for a page that never was an object. What only
    pages have goes into the object's own extra, so that the way back restores it.
    """
    state = F.col("extra.lifecycle")
    own = ("sources", "is_immutable", "last_used_at", "category")
    return pages.select(
        "id",
        looked_up(KIND_OF, "type").alias("kind"),
        "title",
        F.col("body").alias("content"),
        F.when(state.isin(*STATES), state).otherwise("created").alias("lifecycle"),
        F.coalesce("extra.confidence", F.lit(0.0)).alias("confidence"),
        F.coalesce("extra.source_paths", F.array().cast("array<string>")).alias("source_paths"),
        "grade",
        "heat",
        "created_at",
        F.struct(*own).alias("extra"),
    )


def as_pages(objects: DataFrame) -> DataFrame:
    """Pages of objects: sources that only the provenance knows are added, what pages alone have is restored or has its default."""
    known = F.coalesce("extra.sources", F.array().cast("array<string>"))
    paths = F.filter("source_paths", lambda s: s != "")
    return objects.select(
        "id",
        looked_up(TYPE_OF, "kind").alias("type"),
        "title",
        F.col("content").alias("body"),
        "grade",
        "heat",
        "created_at",
        F.concat(known, F.array_except(paths, known)).alias("sources"),
        F.coalesce("extra.is_immutable", F.lit(False)).alias("is_immutable"),
        F.coalesce("extra.last_used_at", F.lit(0).cast("long")).alias("last_used_at"),
        F.coalesce("extra.category", F.lit("")).alias("category"),
        F.struct("lifecycle", "confidence", "source_paths").alias("extra"),
    )


def pages_with_extra(spark, sf_dir) -> DataFrame:
    """Pages: every fourth never was an object, and every seventh has a state that doesn't exist."""
    state = F.expr("CASE WHEN doc_id % 7 = 0 THEN 'gone' WHEN doc_id % 2 = 0 THEN 'active' ELSE 'archived' END").alias("lifecycle")
    extra = F.struct(state, F.lit(0.5).alias("confidence"), F.array(F.col("source"), F.lit(""), F.col("category")).alias("source_paths"))
    return wiki(spark, sf_dir).withColumn("sources", F.array("source")).withColumn("extra", F.when(F.col("doc_id") % 4 != 0, extra))


@query(
    "sup_33_page_to_object",
    SQL + "SELECT id, CASE type WHEN 'source' THEN 'document' ELSE type END AS kind, CASE WHEN doc_id % 4 = 0 OR doc_id % 7 = 0 THEN 'created' WHEN doc_id % 2 = 0 THEN 'active' ELSE 'archived' END AS lifecycle, CASE WHEN doc_id % 4 = 0 THEN 0.0 ELSE 0.5 END::DOUBLE AS confidence, CASE WHEN doc_id % 4 = 0 THEN 0 ELSE 3 END::BIGINT AS n_paths, heat, md5(body) AS hash FROM wiki",
)
def page_to_object(spark, sf_dir) -> DataFrame:
    return as_objects(pages_with_extra(spark, sf_dir)).select("id", "kind", "lifecycle", "confidence", F.size("source_paths").cast("long").alias("n_paths"), "heat", F.md5("content").alias("hash"))


@query(
    "sup_34_object_to_page",
    SQL + "SELECT id, type, md5(body) AS hash, is_immutable, last_used_at, category, CASE WHEN doc_id % 4 = 0 OR category = source THEN source ELSE source || ',' || category END AS sources FROM wiki",
)
def object_to_page(spark, sf_dir) -> DataFrame:
    """Pages that became objects and pages again."""
    p = as_pages(as_objects(pages_with_extra(spark, sf_dir)))
    return p.select("id", "type", F.md5("body").alias("hash"), "is_immutable", "last_used_at", "category", F.array_join("sources", ",").alias("sources"))


def migration_path(migrations: DataFrame, start: str, end: str) -> DataFrame:
    """(step, source_id, target_id) of the fewest migrations (source_id, target_id) from a version to another; no row if they are one, or none leads there."""
    path = shortest_path(migrations, start, end).select(F.split("path", ">").alias("path"))
    return path.select(F.posexplode(F.arrays_zip(F.slice("path", 1, F.size("path") - 1).alias("a"), F.slice("path", 2, F.size("path") - 1).alias("b"))).alias("step", "x")).select(F.col("step").cast("long").alias("step"), F.col("x.a").alias("source_id"), F.col("x.b").alias("target_id"))


@query(
    "gr_19_migration_path",
    "WITH RECURSIVE m AS (SELECT n_nationkey AS f, n_nationkey + 1 AS t FROM nation UNION SELECT n_nationkey, n_nationkey + 3 FROM nation), walk AS (SELECT 0::BIGINT AS v, [0::BIGINT] AS path UNION ALL SELECT m.t::BIGINT, list_append(path, m.t::BIGINT) FROM walk JOIN m ON m.f = v WHERE len(path) < 9), best AS (SELECT path FROM walk WHERE v = 24 ORDER BY len(path) LIMIT 1) SELECT i::BIGINT AS step, 'v' || path[i + 1] AS source_id, 'v' || path[i + 2] AS target_id FROM best, range(0, 8) r(i)",
)
def migrations(spark, sf_dir) -> DataFrame:
    """From version 0 to version 24, where each nation's key has a migration to the next version and one to the third after it."""
    v = read(spark, sf_dir, "nation").select(F.col("n_nationkey").cast("long").alias("k"))
    to = lambda n: v.select(F.concat(F.lit("v"), "k").alias("source_id"), F.concat(F.lit("v"), F.col("k") + n).alias("target_id"))
    return migration_path(to(1).union(to(3)), "v0", "v24")


def editorial_errors(curation: DataFrame, outline: DataFrame, chapters: DataFrame, pages: DataFrame) -> DataFrame:
    """The distinct errors (rule, id) of a book's editorial state; all rules are counts by key or joins by key.

    curation: page_id, disposition, primary, hash, place (of a page's several rows the last one holds);
    outline: page_id, chapter_id; chapters: chapter_id; pages: page_id.
    """
    name = lambda df, rule, c="page_id": df.select(F.lit(rule).alias("rule"), F.col(c).alias("id"))
    several = lambda df, c: df.groupBy(c).agg(F.count("*").alias("n")).where("n > 1")
    rows = curation.where("page_id <> ''")
    used = rows.where(F.col("disposition").isin(*USED))
    last = rows.groupBy("page_id").agg(F.max_by(F.coalesce("disposition", F.lit("")), "place").alias("disposition"))
    owned = outline.join(last, "page_id", "left")
    found = [
        name(several(chapters, "chapter_id"), "duplicate-chapter", "chapter_id"),
        name(several(rows, "page_id"), "duplicate-disposition"),
        name(rows.join(pages, "page_id", "left_anti"), "unknown-page"),
        name(rows.where(~F.coalesce(F.col("disposition").isin(*DISPOSITIONS), F.lit(False))), "disposition"),
        name(used.join(chapters.select(F.col("chapter_id").alias("primary")), "primary", "left_anti"), "primary-chapter"),
        name(used.where("hash is null"), "content-hash"),
        name(outline.distinct().transform(lambda d: several(d, "page_id")), "multiple-outline-owners"),
        name(owned.where("disposition is null"), "missing-disposition"),
        name(owned.where(~F.col("disposition").isin(*USED)), "outline-disposition"),
    ]
    return reduce(DataFrame.union, found).distinct()


@query(
    "rul_26_editorial_state",
    """
    WITH d AS (SELECT *, ['include', 'exclude', 'conflict', 'lost'][doc_id % 4 + 1] AS disposition FROM documents),
    cur AS (SELECT 'doc-' || doc_id AS page_id, disposition, lang AS prim, CASE WHEN doc_id % 10 <> 0 THEN md5(text) END AS hash FROM d
      UNION ALL SELECT 'doc-' || (doc_id * 2), 'include', source, 'x' FROM d),
    last AS (SELECT 'doc-' || doc_id AS page_id, CASE WHEN doc_id IN (SELECT doc_id * 2 FROM d) THEN 'include' ELSE disposition END AS disposition FROM d UNION SELECT 'doc-' || (doc_id * 2), 'include' FROM d),
    o AS (SELECT 'doc-' || (doc_id * 3) AS page_id, lang AS chapter_id FROM d UNION SELECT 'doc-' || (doc_id * 3), source FROM d),
    used AS (SELECT * FROM cur WHERE disposition IN ('include', 'conflict'))
    SELECT 'duplicate-chapter' AS rule, lang AS id FROM d GROUP BY lang HAVING count(*) > 1
    UNION SELECT 'duplicate-disposition', page_id FROM cur GROUP BY page_id HAVING count(*) > 1
    UNION SELECT 'unknown-page', page_id FROM cur WHERE page_id NOT IN (SELECT 'doc-' || doc_id FROM d)
    UNION SELECT 'disposition', page_id FROM cur WHERE disposition = 'lost'
    UNION SELECT 'primary-chapter', page_id FROM used WHERE prim NOT IN (SELECT lang FROM d WHERE lang IS NOT NULL)
    UNION SELECT 'content-hash', page_id FROM used WHERE hash IS NULL
    UNION SELECT 'multiple-outline-owners', page_id FROM o GROUP BY page_id HAVING count(*) > 1
    UNION SELECT 'missing-disposition', page_id FROM o WHERE page_id NOT IN (SELECT page_id FROM last)
    UNION SELECT 'outline-disposition', page_id FROM o JOIN last USING (page_id) WHERE last.disposition NOT IN ('include', 'conflict')
    """,
)
def editorial_state(spark, sf_dir) -> DataFrame:
    """A book of documents: its chapters are languages, a source is none; pages of twice the number are listed again, the outline has those of three times."""
    d = read(spark, sf_dir, "documents")
    page = lambda n: F.concat(F.lit("doc-"), F.col("doc_id") * n).alias("page_id")
    fate = F.element_at(F.array(*map(F.lit, ("include", "exclude", "conflict", "lost"))), (F.col("doc_id") % 4 + 1).cast("int")).alias("disposition")
    digest = F.when(F.col("doc_id") % 10 != 0, F.md5("text")).alias("hash")
    first = d.select(page(1), fate, F.col("lang").alias("primary"), digest, F.lit(0).alias("place"))
    again = d.select(page(2), F.lit("include").alias("disposition"), F.col("source").alias("primary"), F.lit("x").alias("hash"), F.lit(1).alias("place"))
    outline = d.select(page(3), F.explode(F.array("lang", "source")).alias("chapter_id"))
    return editorial_errors(first.union(again), outline, d.select(F.col("lang").alias("chapter_id")), d.select(page(1)))
