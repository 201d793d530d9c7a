"""Sources, documents and their blocks: scans, readiness, filters before analysis."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import Window as W
from pyspark.sql import functions as F

from corvane.functions import text as T
from corvane.plans.registry import query
from corvane.sources.tables import SQL, read, wiki

SIZE_CAP = 4096


@query("src_04_cjk_density", "SELECT doc_id, round(CASE WHEN length(text) > 0 THEN len(regexp_extract_all(text, '[\\x{4e00}-\\x{9fff}]')) / length(text) ELSE 0 END, 6) AS density FROM documents")
def cjk_density(spark, sf_dir) -> DataFrame:
    return read(spark, sf_dir, "documents").select("doc_id", F.round(T.cjk_share("text"), 6).alias("density"))


@query("src_05_size_cap", f"SELECT doc_id, octet_length(encode(text)) AS size_bytes FROM documents WHERE octet_length(encode(text)) <= {SIZE_CAP}")
def within_size_cap(spark, sf_dir) -> DataFrame:
    """Sources above the byte cap are rejected."""
    return read(spark, sf_dir, "documents").select("doc_id", F.octet_length("text").cast("long").alias("size_bytes")).where(F.col("size_bytes") <= SIZE_CAP)


@query("src_07_artifact", "SELECT doc_id, sha256(text) AS source_sha256, len(list_filter(string_split(text, chr(10)), lambda x: regexp_matches(x, '\\S'))) AS n_ranges, CASE WHEN len(list_filter(string_split(text, chr(10)), lambda x: regexp_matches(x, '\\S'))) = 0 AND text <> '' THEN 'missing provenance' END AS error FROM documents")
def artifact(spark, sf_dir) -> DataFrame:
    """Source hash and the number of line ranges; text without ranges is an error."""
    n = F.size(T.filled_lines("text")).cast("long")
    return read(spark, sf_dir, "documents").select("doc_id", F.sha2("text", 256).alias("source_sha256"), n.alias("n_ranges"), F.when((n == 0) & (F.col("text") != ""), "missing provenance").alias("error"))


@query("src_08_line_ranges", "SELECT doc_id, 'line' AS unit, pos - 1 AS unit_index, 0 AS range_start, length(line) AS range_end FROM (SELECT doc_id, unnest(string_split(text, chr(10))) AS line, generate_subscripts(string_split(text, chr(10)), 1) AS pos FROM documents) WHERE regexp_matches(line, '\\S')")
def line_ranges(spark, sf_dir) -> DataFrame:
    """A range for each filled line, numbered among all lines."""
    rows = read(spark, sf_dir, "documents").select("doc_id", F.posexplode(T.lines("text")).alias("pos", "line")).where(F.col("line").rlike("\\S"))
    return rows.select("doc_id", F.lit("line").alias("unit"), F.col("pos").cast("long").alias("unit_index"), F.lit(0).cast("long").alias("range_start"), F.length("line").cast("long").alias("range_end"))


@query("src_14_html_to_text", "SELECT page_id, trim(regexp_replace(replace(replace(replace(replace(regexp_replace(regexp_replace(regexp_replace(html, '(?is)<script[^>]*>.*?</script>', '', 'g'), '(?is)<style[^>]*>.*?</style>', '', 'g'), '<[^>]+>', ' ', 'g'), '&nbsp;', ' '), '&amp;', '&'), '&lt;', '<'), '&gt;', '>'), '[ \\t\\n\\r\\f]+', ' ', 'g')) AS text FROM pages")
def page_text(spark, sf_dir) -> DataFrame:
    return read(spark, sf_dir, "pages").select("page_id", T.html_to_text("html").alias("text"))


@query("src_18_html_title", "SELECT page_id, coalesce(nullif(trim(regexp_replace(regexp_extract(html, '(?is)<title[^>]*>(.*?)</title>', 1), '<[^>]+>', '', 'g')), ''), nullif(trim(regexp_replace(regexp_extract(html, '(?is)<h1[^>]*>(.*?)</h1>', 1), '<[^>]+>', '', 'g')), '')) AS title FROM pages")
def page_title(spark, sf_dir) -> DataFrame:
    return read(spark, sf_dir, "pages").select("page_id", T.html_title("html").alias("title"))


@query("src_37_discover_sources", SQL + ", registry AS (SELECT doc_id, CASE WHEN doc_id % 7 = 0 THEN md5(body || 'old') ELSE md5(body) END AS hash FROM wiki WHERE doc_id % 3 <> 0) SELECT w.id, CASE WHEN r.doc_id IS NULL THEN 'discovered' ELSE 'stale' END AS change FROM wiki w LEFT JOIN registry r ON w.doc_id = r.doc_id WHERE r.doc_id IS NULL OR r.hash <> md5(w.body)")
def discover_sources(spark, sf_dir) -> DataFrame:
    """Files that the registry lacks, and those whose content has changed since."""
    pages = wiki(spark, sf_dir).select("id", "doc_id", "body")
    registry = pages.where("doc_id % 3 <> 0").select("doc_id", F.md5(F.when(F.col("doc_id") % 7 == 0, F.concat("body", F.lit("old"))).otherwise(F.col("body"))).alias("hash"))
    return source_changes(pages.select("id", "doc_id", F.md5("body").alias("now")), registry)


def source_changes(files: DataFrame, registry: DataFrame) -> DataFrame:
    both = files.join(registry, "doc_id", "left")
    return both.where(F.col("hash").isNull() | (F.col("hash") != F.col("now"))).select("id", F.when(F.col("hash").isNull(), "discovered").otherwise("stale").alias("change"))


V1 = "regexp_replace(regexp_replace(regexp_replace(text, '\\r\\n?', chr(10), 'g'), '[ \\t\\f]+(\\n)', '\\1', 'g'), '^[ \\t\\n\\f]+|[ \\t\\n\\f]+$', '', 'g')"


@query("doc_02_normalize_v1", f"SELECT doc_id, sha256({V1}) AS content_sha256, len(list_filter(string_split({V1}, chr(10) || chr(10)), lambda x: x <> '')) AS n_blocks FROM documents")
def normalize_v1(spark, sf_dir) -> DataFrame:
    """Canonical text of the first version: its hash and its number of blocks."""
    x = T.canonical_v1("text")
    return read(spark, sf_dir, "documents").select("doc_id", F.sha2(x, 256).alias("content_sha256"), F.size(F.filter(F.split(x, "\n\n"), lambda b: b != "")).cast("long").alias("n_blocks"))


@query("doc_03_title", "SELECT doc_id, CASE WHEN first IS NULL THEN source WHEN starts_with(first, '# ') THEN trim(substr(first, 3)) ELSE substr(first, 1, 120) END AS title FROM (SELECT doc_id, source, trim(list_filter(string_split(text, chr(10)), lambda x: regexp_matches(x, '\\S'))[1]) AS first FROM documents)")
def title(spark, sf_dir) -> DataFrame:
    return read(spark, sf_dir, "documents").select("doc_id", T.first_title("text", "source").alias("title"))


@query("doc_04_document_id", f"SELECT doc_id, 'doc_' || substr(sha256({V1} || chr(31) || 'v1' || chr(31) || 'p1'), 1, 24) AS document_id FROM documents")
def document_id(spark, sf_dir) -> DataFrame:
    return read(spark, sf_dir, "documents").select("doc_id", T.stable_id("doc_", T.canonical_v1("text"), F.lit("v1"), F.lit("p1")).alias("document_id"))


@query("doc_10_estimate_tokens", "SELECT doc_id, length(text) // 2 AS tokens FROM documents")
def estimate_tokens(spark, sf_dir) -> DataFrame:
    return read(spark, sf_dir, "documents").select("doc_id", T.estimated_tokens("text").alias("tokens"))


@query("doc_13_clean_text", "SELECT doc_id, sha256(CASE WHEN text IS NULL OR NOT regexp_matches(text, '\\S') THEN '' ELSE regexp_replace(regexp_replace(regexp_replace(text, '[\\x{200b}\\x{200c}\\x{200d}\\x{feff}]', '', 'g'), '\\n[ \\t]*\\n[ \\t]*\\n+', chr(10) || chr(10), 'g'), '^[ \\t\\n\\r\\f]+|[ \\t\\n\\r\\f]+$', '', 'g') || chr(10) END) AS clean_sha256 FROM documents")
def clean_text(spark, sf_dir) -> DataFrame:
    """Zero-width characters dropped, three or more blank lines made two, trimmed, one final line feed."""
    x = F.regexp_replace("text", "[\\u200b\\u200c\\u200d\\ufeff]", "")
    x = F.regexp_replace(F.regexp_replace(x, "\n[ \\t]*\n[ \\t]*\n+", "\n\n"), "^[ \\t\\n\\r\\f]+|[ \\t\\n\\r\\f]+$", "")
    return read(spark, sf_dir, "documents").select("doc_id", F.sha2(F.when(F.col("text").isNull() | ~F.col("text").rlike("\\S"), "").otherwise(F.concat(x, F.lit("\n"))), 256).alias("clean_sha256"))


def quality(lines: DataFrame) -> DataFrame:
    """Score of (doc_id, text, line): lines that occur more than five times count as repeated."""
    counts = lines.groupBy("doc_id", "line").agg(F.count("*").alias("n"))
    per = counts.groupBy("doc_id").agg(F.sum("n").alias("n_lines"), F.sum(F.when(~F.col("line").rlike("\\S"), F.col("n")).otherwise(0)).alias("blank"), F.sum(F.when(F.col("n") > 5, F.col("n")).otherwise(0)).alias("again"))
    blank, again = F.col("blank") / F.col("n_lines"), F.col("again") / F.col("n_lines")

    def off(cond: Column, by: float) -> Column:
        return F.when(cond, F.lit(by)).otherwise(F.lit(0.0))

    score = F.greatest(F.lit(0.0), F.lit(1.0) - off(blank > 0.6, 0.3) - off(blank > 0.85, 0.3) - off(again > 0.3, 0.3) - off(again > 0.6, 0.3))
    return per.select("doc_id", F.round(blank, 6).alias("blank_ratio"), F.round(again, 6).alias("repeat_ratio"), F.round(score, 6).alias("score"))


@query("doc_16_text_quality", "WITH c AS (SELECT doc_id, line, count(*) AS n FROM (SELECT doc_id, unnest(string_split(text, chr(10))) AS line FROM documents) GROUP BY ALL), p AS (SELECT doc_id, sum(CASE WHEN NOT regexp_matches(line, '\\S') THEN n ELSE 0 END) / sum(n) AS b, sum(CASE WHEN n > 5 THEN n ELSE 0 END) / sum(n) AS r FROM c GROUP BY doc_id) SELECT doc_id, round(b, 6) AS blank_ratio, round(r, 6) AS repeat_ratio, round(greatest(0.0, 1.0 - CASE WHEN b > 0.6 THEN 0.3 ELSE 0 END - CASE WHEN b > 0.85 THEN 0.3 ELSE 0 END - CASE WHEN r > 0.3 THEN 0.3 ELSE 0 END - CASE WHEN r > 0.6 THEN 0.3 ELSE 0 END), 6)::DOUBLE AS score FROM p")
def text_quality(spark, sf_dir) -> DataFrame:
    return quality(read(spark, sf_dir, "documents").select("doc_id", F.explode(T.lines("text")).alias("line")))


@query("doc_27_list_density", "WITH f AS (SELECT doc_id, list_filter(string_split(text, chr(10)), lambda x: regexp_matches(x, '\\S')) AS l FROM documents) SELECT doc_id, round(CASE WHEN len(l) = 0 THEN 0 ELSE len(list_filter(l, lambda x: regexp_matches(x, '^[ \\t]*([-*]|[0-9]+[.)])[ \\t]+'))) / len(l) END, 6) AS density FROM f")
def list_density(spark, sf_dir) -> DataFrame:
    return read(spark, sf_dir, "documents").select("doc_id", F.round(T.list_density("text"), 6).alias("density"))


def prefilter_action(text, size, language_rule: bool = False) -> Column:
    """skip, reference_list or process; the rule on Chinese text is off unless asked for."""
    out = F.when(size < 100, "skip").when(T.list_density(text) > 0.8, "reference_list")
    if language_rule:
        out = out.when(F.col(text).rlike("\\S") & ~F.col(text).rlike("[\\u4e00-\\u9fff\\u3400-\\u4dbf]"), "skip")
    return out.otherwise("process")


@query("doc_25_prefilter", "WITH f AS (SELECT doc_id, octet_length(encode(text)) AS size, list_filter(string_split(text, chr(10)), lambda x: regexp_matches(x, '\\S')) AS l FROM documents) SELECT doc_id, CASE WHEN size < 100 THEN 'skip' WHEN len(l) > 0 AND len(list_filter(l, lambda x: regexp_matches(x, '^[ \\t]*([-*]|[0-9]+[.)])[ \\t]+'))) / len(l) > 0.8 THEN 'reference_list' ELSE 'process' END AS action FROM f")
def prefilter(spark, sf_dir) -> DataFrame:
    return read(spark, sf_dir, "documents").select("doc_id", prefilter_action("text", F.octet_length("text")).alias("action"))


@query("doc_26_triage", "SELECT doc_id, CASE WHEN octet_length(encode(text)) < 100 THEN 'C' ELSE 'B' END AS grade FROM documents")
def triage(spark, sf_dir) -> DataFrame:
    """Skipped and source-only documents are graded C, others B."""
    action = prefilter_action("text", F.octet_length("text"))
    return read(spark, sf_dir, "documents").select("doc_id", F.when(action.isin("skip", "source_only"), "C").otherwise("B").alias("grade"))


@query("doc_29_c_grade_cause", SQL + "SELECT id, CASE WHEN title IS NULL OR trim(title) = '' THEN 'structural' WHEN length(trim(regexp_replace(coalesce(body, ''), '\\[\\[[^\\]]*\\]\\]', '', 'g'))) < 200 THEN 'content_thin' ELSE 'unknown' END AS cause FROM wiki WHERE grade = 'C'")
def c_grade_cause(spark, sf_dir) -> DataFrame:
    body = F.length(F.trim(F.regexp_replace(F.coalesce("body", F.lit("")), "\\[\\[[^\\]]*\\]\\]", "")))
    cause = F.when(F.col("title").isNull() | (F.trim("title") == ""), "structural").when(body < 200, "content_thin").otherwise("unknown")
    return wiki(spark, sf_dir).where("grade = 'C'").select("id", cause.alias("cause"))


@query("doc_30_quality_gate", SQL + "SELECT id, CASE WHEN row_number() OVER (PARTITION BY md5(body) ORDER BY doc_id) > 1 THEN 'drop' WHEN length(regexp_replace(body, '[ \\t\\n\\r]+', '', 'g')) < 20 THEN 'downgrade' ELSE 'keep' END AS verdict FROM wiki")
def quality_gate(spark, sf_dir) -> DataFrame:
    """Later pages with the same body are dropped, nearly empty ones downgraded."""
    return gate_pages(wiki(spark, sf_dir).select("id", "doc_id", F.md5("body").alias("hash"), F.length(F.regexp_replace("body", "[ \\t\\n\\r]+", "")).alias("n")))


def gate_pages(pages: DataFrame) -> DataFrame:
    """The first of each hash comes from an aggregate, so a frequent body isn't gathered in one task."""
    first = pages.groupBy("hash").agg(F.min("doc_id").alias("first"))
    return pages.join(first, "hash").select("id", F.when(F.col("doc_id") != F.col("first"), "drop").when(F.col("n") < 20, "downgrade").otherwise("keep").alias("verdict"))


@query("sup_06_fingerprint", "SELECT doc_id, md5(regexp_replace(text, '[ \\t\\n\\r]+', '', 'g')) AS fingerprint FROM documents")
def fingerprint(spark, sf_dir) -> DataFrame:
    return read(spark, sf_dir, "documents").select("doc_id", T.fingerprint("text").alias("fingerprint"))


@query("sup_08_backlog", "WITH f AS (SELECT doc_id, length(text) AS n, row_number() OVER (PARTITION BY md5(regexp_replace(text, '[ \\t\\n\\r]+', '', 'g')) ORDER BY doc_id) AS k FROM documents) SELECT CASE WHEN k > 1 THEN 'duplicate' WHEN n < 500 THEN 'tiny' WHEN n > 16000 THEN 'long' ELSE 'normal' END AS class, count(*) AS n FROM f GROUP BY 1")
def backlog(spark, sf_dir) -> DataFrame:
    """Counts of duplicates (but the first), tiny, long and other documents."""
    d = read(spark, sf_dir, "documents").select("doc_id", T.fingerprint("text").alias("f"), F.length("text").alias("n"))
    first = d.groupBy("f").agg(F.min("doc_id").alias("first"))
    kind = F.when(F.col("doc_id") != F.col("first"), "duplicate").when(F.col("n") < 500, "tiny").when(F.col("n") > 16000, "long").otherwise("normal")
    return d.join(first, "f").groupBy(kind.alias("class")).agg(F.count("*").alias("n"))


@query("sup_12_reingest_plan", "WITH r AS (SELECT doc_id, source, row_number() OVER (ORDER BY source, doc_id) - 1 AS k FROM documents) SELECT k // 20 AS batch, count(*) AS n, CASE WHEN count(DISTINCT source) = 1 THEN min(source) ELSE 'mixed' END AS theme FROM r GROUP BY 1")
def reingest_plan(spark, sf_dir) -> DataFrame:
    """Batches of 20 in the order of source and id; a batch's theme is its source, or mixed."""
    return batches(read(spark, sf_dir, "documents").select("doc_id", "source"), 20)


def batches(rows: DataFrame, size: int) -> DataFrame:
    """Numbers rows within their source and adds the sources before, so no task sorts the whole table."""
    sizes = rows.groupBy("source").agg(F.count("*").alias("c"))
    before = sizes.withColumn("before", F.coalesce(F.sum("c").over(W.orderBy("source").rowsBetween(W.unboundedPreceding, -1)), F.lit(0))).select("source", "before")
    k = F.row_number().over(W.partitionBy("source").orderBy("doc_id")) - 1 + F.col("before")
    return rows.join(before, "source").withColumn("batch", F.floor(k / size)).groupBy("batch").agg(F.count("*").alias("n"), F.when(F.min("source") == F.max("source"), F.min("source")).otherwise("mixed").alias("theme"))


@query("sup_01_stratified_sample", "WITH r AS (SELECT doc_id, lang, row_number() OVER (PARTITION BY lang ORDER BY md5(doc_id || ':7'), doc_id) AS k FROM documents) SELECT doc_id, lang, k FROM r ORDER BY k, lang LIMIT 40")
def stratified_sample(spark, sf_dir) -> DataFrame:
    """Round robin over the languages in a seeded order, 40 in all."""
    k = F.row_number().over(W.partitionBy("lang").orderBy(F.md5(F.concat("doc_id", F.lit(":7"))), "doc_id"))
    return read(spark, sf_dir, "documents").select("doc_id", "lang", k.cast("long").alias("k")).orderBy("k", "lang").limit(40)


@query("sup_04_page_summary", SQL + "SELECT type, count(*) AS n, min(length(body)) AS least, max(length(body)) AS most, round(avg(length(body)), 1) AS mean, floor(quantile_cont(length(body), 0.5))::BIGINT AS median FROM wiki GROUP BY type")
def page_summary(spark, sf_dir) -> DataFrame:
    n = F.length("body")
    return wiki(spark, sf_dir).groupBy("type").agg(F.count("*").alias("n"), F.min(n).cast("long").alias("least"), F.max(n).cast("long").alias("most"), F.round(F.avg(n), 1).alias("mean"), F.floor(F.percentile(n, 0.5)).alias("median"))
