"""Files of a wiki: census, snapshot, blocks, index and log lines, front matter, and writes that replace or delete."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from corvane.operators.series import as_markdown, markdown_expression
from corvane.plans.folders import new_folder
from corvane.plans.registry import query
from corvane.sources.tables import SQL, TYPES, read, wiki

# The line formats of an index and of a log, a stamp in front matter, what counts as unknown.
INDEX_LINE = r"^- \*\*([^*\n]+)\*\* \(([a-z]+)\) — ([^\n]*)$"
LOG_LINE = r"^- \*\*([^\n]*?)\*\*: `([^\n]*?)` — ([^\n]*)$"
STAMP = r"(?m)^(created_at|updated_at):[ \t]*['\"]([^'\"\n]+)['\"][ \t]*$"
UNKNOWN = ("", "unknown")


@query("src_27_census", SQL + f"SELECT type, count(*) AS n, count(DISTINCT source) AS n_sources FROM wiki WHERE type IN {TYPES} GROUP BY type")
def census(spark, sf_dir) -> DataFrame:
    """Pages of the four types, with their sources."""
    return wiki(spark, sf_dir).where(F.col("type").isin(*TYPES)).groupBy("type").agg(F.count("*").alias("n"), F.count_distinct("source").alias("n_sources"))


def snapshot(pages: DataFrame, required: tuple[str, ...] = ("id", "title", "type")) -> DataFrame:
    """(id, hash, missing, again) of pages: the body's hash, whether a required field is empty, whether another page has the id or the title.

    Counts by id and by title are joined to the pages, so no group of equal titles is gathered.
    """
    empty = F.array_compact(F.array(*(F.when(F.coalesce(F.col(c), F.lit("")) == "", F.lit(c)) for c in required)))
    out = pages.select(*{*required, "id", "title"}, F.sha2("body", 256).alias("hash"), (F.size(empty) > 0).alias("missing"))
    for c in ("id", "title"):
        more = pages.groupBy(c).agg(F.count("*").alias("n")).where("n > 1").select(c, F.lit(True).alias(f"{c}_again"))
        out = out.join(more, c, "left")
    return out.select("id", "hash", "missing", F.coalesce("id_again", "title_again", F.lit(False)).alias("again"))


@query(
    "src_29_snapshot",
    SQL + "SELECT id, sha256(body) AS hash, coalesce(title, '') = '' OR coalesce(id, '') = '' OR coalesce(type, '') = '' AS missing, (id IS NOT NULL AND count(*) OVER (PARTITION BY id) > 1) OR (title IS NOT NULL AND count(*) OVER (PARTITION BY title) > 1) AS again FROM wiki",
)
def strict_snapshot(spark, sf_dir) -> DataFrame:
    return snapshot(wiki(spark, sf_dir))


@query("src_30_content_blocks", f"SELECT page_id, pos - 1 AS ordinal, md5(block) AS hash FROM (SELECT page_id, unnest(string_split(m, chr(10) || '## ')) AS block, generate_subscripts(string_split(m, chr(10) || '## '), 1) AS pos FROM (SELECT page_id, {markdown_expression()} AS m FROM pages))")
def content_blocks(spark, sf_dir) -> DataFrame:
    """A page's blocks in order: what stands before its first heading, then each heading with its text."""
    b = read(spark, sf_dir, "pages").select("page_id", F.posexplode(F.split(as_markdown(F.col("html")), "\n## ")).alias("ordinal", "block"))
    return b.select("page_id", F.col("ordinal").cast("long").alias("ordinal"), F.md5("block").alias("hash"))


@query("src_31_index", SQL + "SELECT id AS slug, type, title FROM wiki WHERE doc_id % 7 <> 0 AND title IS NOT NULL")
def index_lines(spark, sf_dir) -> DataFrame:
    """Slug, type and title of index lines; every seventh line lacks its type, and is passed over."""
    kind = F.when(F.col("doc_id") % 7 == 0, "").otherwise(F.concat(F.lit(" ("), "type", F.lit(")")))
    lines = wiki(spark, sf_dir).select(F.concat(F.lit("- **"), "id", F.lit("**"), kind, F.lit(" — "), "title").alias("line"))
    part = lambda n: F.regexp_extract("line", INDEX_LINE, n)
    return lines.where(F.col("line").rlike(INDEX_LINE)).select(part(1).alias("slug"), part(2).alias("type"), part(3).alias("title"))


def log_entries(logs: DataFrame, text: str) -> DataFrame:
    """(.., timestamp, event, task_id, detail): a log's entries with the heading above them, null before the first; other lines are passed over."""
    keys = [c for c in logs.columns if c != text]
    parts = logs.select(*keys, F.posexplode(F.split(F.concat(F.lit("\n"), F.col(text)), "\n## ")).alias("place", "part"))
    lines = parts.select(*keys, F.when(F.col("place") > 0, F.trim(F.split("part", "\n")[0])).alias("timestamp"), F.explode(F.split("part", "\n")).alias("line"))
    field = lambda n: F.trim(F.regexp_extract("line", LOG_LINE, n))
    return lines.where(F.col("line").rlike(LOG_LINE)).select(*keys, "timestamp", field(1).alias("event"), field(2).alias("task_id"), field(3).alias("detail"))


@query(
    "src_32_read_log",
    "SELECT event_id, NULL AS timestamp, 'early' AS event, 't0' AS task_id, 'none' AS detail FROM events UNION ALL SELECT event_id, 'day ' || event_id % 7, event_type, user_id::VARCHAR, 'v' || event_id FROM events UNION ALL SELECT event_id, 'day ' || event_id % 7, 'second', event_id::VARCHAR, event_type FROM events",
)
def read_log(spark, sf_dir) -> DataFrame:
    """Logs made of events: an entry before any heading, two below one, and lines that are no entries."""
    text = F.expr("concat('- **early**: `t0` — none\\n## day ', event_id % 7, '\\n- **', event_type, '**: `', user_id, '` — v', event_id, '\\n- **broken**: `x`\\nprose\\n- **second**: ` ', event_id, ' ` — ', event_type)")
    return log_entries(read(spark, sf_dir, "events").select("event_id", text.alias("text")), "text")


@query("src_35_read_stream", "SELECT event_id, event_type, value FROM events WHERE user_id = 7 AND event_id > 100")
def read_stream(spark, sf_dir) -> DataFrame:
    """A stream's events after a version, in order; both conditions reach the scan."""
    return read(spark, sf_dir, "events").where("user_id = 7 and event_id > 100").select("event_id", "event_type", "value").orderBy("event_id")


@query("src_36_point_lookup", SQL + "SELECT id, title, type FROM wiki WHERE id = 'doc-7'")
def point_lookup(spark, sf_dir) -> DataFrame:
    return wiki(spark, sf_dir).where("id = 'doc-7'").select("id", "title", "type")


@query("src_38_raw_files", "SELECT doc_id, EXISTS (SELECT 1 FROM embeddings WHERE vec_id = doc_id) AND EXISTS (SELECT 1 FROM labels l WHERE l.doc_id = d.doc_id) AS ingested FROM documents d")
def raw_files(spark, sf_dir) -> DataFrame:
    """Ingested if both the pages and the batch know the file."""
    e = read(spark, sf_dir, "embeddings").select(F.col("vec_id").alias("doc_id"), F.lit(True).alias("paged")).distinct()
    b = read(spark, sf_dir, "labels").select("doc_id", F.lit(True).alias("batched")).distinct()
    known = F.col("paged").isNotNull() & F.col("batched").isNotNull()
    return read(spark, sf_dir, "documents").select("doc_id").join(e, "doc_id", "left").join(b, "doc_id", "left").select("doc_id", known.alias("ingested"))


def cascade(pages: DataFrame, sources: str, key: str) -> DataFrame:
    """Pages with a source that contains key: deleted if no other source is left, else kept with those that are."""
    left = F.filter(sources, lambda s: ~s.contains(key))
    return pages.where(F.exists(sources, lambda s: s.contains(key))).withColumn(sources, left).withColumn("outcome", F.when(F.size(sources) == 0, "deleted").otherwise("shortened"))


SOURCES = "CASE WHEN doc_id % 3 = 0 THEN {0}lang || '.md'{1} ELSE {0}lang || '.md', source{1} END"


@query("snk_13_cascade_delete", f"SELECT doc_id, CASE WHEN len(l) = 0 THEN 'deleted' ELSE 'shortened' END AS outcome, coalesce(array_to_string(l, ','), '') AS sources FROM (SELECT doc_id, s, list_filter(s, lambda x: NOT contains(x, 'en')) AS l FROM (SELECT doc_id, {SOURCES.format('[', ']')} AS s FROM documents)) WHERE len(s) > len(l)")
def cascade_delete(spark, sf_dir) -> DataFrame:
    """The sources of a language go; pages that have no other go with them."""
    d = read(spark, sf_dir, "documents").select("doc_id", F.expr(SOURCES.format("array(", ")")).alias("sources"))
    return cascade(d, "sources", "en").select("doc_id", "outcome", F.array_join("sources", ",").alias("sources"))


def upserted(base: DataFrame, changes: DataFrame, key: str, order: str) -> DataFrame:
    """base with each key's last change (by order) in place of its row, and rows of new keys; one shuffle, maxima before it."""
    rest = [c for c in base.columns if c != key]
    whole = base.withColumn(order, F.lit(None).cast(changes.schema[order].dataType)).unionByName(changes)
    last = whole.groupBy(key).agg(F.max_by(F.struct(*rest), F.struct(F.col(order).isNotNull(), order)).alias("last"))
    return last.select(key, "last.*")


@query("snk_10_metadata_upsert", "SELECT doc_id, lang, source FROM documents WHERE doc_id NOT IN (SELECT doc_id * 2 FROM documents) UNION ALL SELECT doc_id * 2, 'second', source FROM documents")
def metadata_upsert(spark, sf_dir) -> DataFrame:
    """Two changes for every second identifier, half of them new: the later one holds."""
    d = read(spark, sf_dir, "documents").select("doc_id", "lang", "source")
    change = lambda n, lang: d.select((F.col("doc_id") * 2).alias("doc_id"), F.lit(lang).alias("lang"), "source", F.lit(n).alias("seq"))
    return upserted(d, change(2, "second").union(change(1, "first")), "doc_id", "seq")


@query("snk_18_counters", "SELECT 'events_total' AS name, '{\"type\":\"' || event_type || '\"}' AS labels, count(*)::DOUBLE AS value FROM events GROUP BY event_type UNION ALL SELECT 'value_total', '{\"type\":\"' || event_type || '\"}', round(sum(value), 2) FROM events GROUP BY event_type")
def counters(spark, sf_dir) -> DataFrame:
    """Counters with their labels as JSON, appended to a file in two batches and read back."""
    folder, e = new_folder(spark, "counters"), read(spark, sf_dir, "events")
    for name, value in (("events_total", F.count("*").cast("double")), ("value_total", F.round(F.sum("value"), 2))):
        rows = e.groupBy("event_type").agg(value.alias("value"))
        labels = F.to_json(F.create_map(F.lit("type"), F.col("event_type"))).alias("labels")
        rows.select(F.lit(name).alias("name"), labels, "value").write.mode("append").parquet(folder)
    return spark.read.parquet(folder)


def stamps(text: Column) -> Column:
    """Texts in front matter's time fields as (field, current_value, suggested_unix_ms, convertible); numbers are in order already."""
    head = F.regexp_extract(text, r"(?s)^\x{FEFF}?---\n(.*?)\n---", 1)
    found = F.arrays_zip(F.regexp_extract_all(head, F.lit(STAMP), 1).alias("field"), F.regexp_extract_all(head, F.lit(STAMP), 2).alias("value"))
    ms = lambda x: F.unix_millis(F.try_to_timestamp(x["value"]))
    return F.transform(found, lambda x: F.struct(x["field"].alias("field"), x["value"].alias("current_value"), ms(x).alias("suggested_unix_ms"), ms(x).isNotNull().alias("convertible")))


@query(
    "sup_21_iso_timestamps",
    "SELECT doc_id, 'created_at' AS field, '2024-01-0' || (doc_id % 9 + 1) || 'T10:00:00Z' AS current_value, epoch_ms(TIMESTAMP '2024-01-01 10:00:00') + doc_id % 9 * 86400000 AS suggested_unix_ms, true AS convertible FROM documents UNION ALL SELECT doc_id, 'updated_at', 'last week', NULL, false FROM documents WHERE doc_id % 2 = 0",
)
def iso_timestamps(spark, sf_dir) -> DataFrame:
    """Documents with front matter: a stamp as text, and one that is no date or a number already; the body's own lines don't count."""
    text = F.expr("concat('---\\ntitle: x\\ncreated_at: \"2024-01-0', doc_id % 9 + 1, 'T10:00:00Z\"\\nupdated_at: ', CASE WHEN doc_id % 2 = 0 THEN '\\'last week\\'' ELSE '1700000000000' END, '\\n---\\ncreated_at: \"2020-01-01\"\\n', coalesce(text, ''))")
    return read(spark, sf_dir, "documents").select("doc_id", F.inline(stamps(text)))


def unknown_dimension(a: Column, b: Column) -> Column:
    """Whether a key of both maps is null, empty or unknown in one of them; a null map has no keys."""
    unknown = lambda v: v.isNull() | v.isin(*UNKNOWN)
    both = F.array_intersect(F.map_keys(a), F.map_keys(b))
    return F.coalesce(F.exists(both, lambda k: unknown(F.element_at(a, k)) | unknown(F.element_at(b, k))), F.lit(False))


@query("fn_19_unknown_dimension", "SELECT doc_id, doc_id % 7 <> 0 AND (doc_id % 4 = 0 OR lang IS NULL OR lang IN ('', 'unknown')) AS unknown FROM documents")
def shared_unknown(spark, sf_dir) -> DataFrame:
    """Scopes of two claims: the domain is in both, the empty kind in one only; every seventh has no scope."""
    a = F.expr("CASE WHEN doc_id % 7 <> 0 THEN map('domain', CASE WHEN doc_id % 4 = 0 THEN 'unknown' ELSE lang END, 'place', source) END")
    b = F.expr("map('domain', lang, 'kind', '')")
    return read(spark, sf_dir, "documents").select("doc_id", unknown_dimension(a, b).alias("unknown"))
