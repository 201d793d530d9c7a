"""Readiness of texts: kinds, policy profiles, blocks, and the decision whether a text can bear evidence."""

from __future__ import annotations

import pandas as pd
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F
from pyspark.sql.types import StringType

from corvane.functions import text as T
from corvane.operators.facts import CHROME
from corvane.plans.registry import query
from corvane.sources.tables import read

#: The policy (fixed values): by kind, least units, least characters, least characters of a short text, whether that needs structure.
LIMITS = {"prose": (1, 20, 2, True), "title_definition": (2, 8, 2, True), "list": (2, 2, 1, True), "code": (1, 1, 1, False), "table": (1, 1, 1, False), "image_ocr": (1, 20, 2, True)}
#: Formats and methods of extraction that have a profile, with their kinds (fixed values).
PROFILES = {
    ("md", "native_text"): ("prose", "title_definition", "list", "code"),
    ("txt", "native_text"): ("prose", "title_definition", "list", "code"),
    ("html", "html_text"): ("title_definition", "list", "code"),
    ("pdf", "pdf_text"): ("prose", "table"),
    ("docx", "docx_text"): ("prose",),
    ("xlsx", "xlsx_cells"): ("table",),
    ("image", "ocr"): ("image_ocr",),
    ("pdf", "ocr"): ("image_ocr",),
}
#: Shares of metadata, of repetition and of broken characters from which a text is judged by them (fixed values).
DOMINANT, REPETITIVE, BROKEN = 0.65, 0.3, 0.3
MARKS = "[。！？!?；;：:，,、.=()（）\\[\\]{}]"
LISTED = "^([-*+][ \\t]+|[0-9]+[.)][ \\t]+)"
ORDER = ("quarantine_degraded", "unsupported", "route_specialist", "ready", "ready_with_warning", "skip_no_content")
RANK = {"quarantine_degraded": 0, "unsupported": 1, "route_specialist": 2, "ready": 3, "ready_with_warning": 3, "skip_no_content": 4}


@F.pandas_udf(StringType())
def composed(s: pd.Series) -> pd.Series:
    """Unicode normal form C."""
    return s.str.normalize("NFC")


def profiles(spark) -> DataFrame:
    """The policy as a table, one row for each profile."""
    rows = [(f, m, k, f"{f}:{m}:{k}", *LIMITS[k]) for (f, m), kinds in PROFILES.items() for k in kinds]
    return spark.createDataFrame(rows, "format string, method string, kind string, profile_id string, min_units int, min_chars int, short_chars int, structured boolean")


PROFILES_SQL = "profiles AS (SELECT * FROM (VALUES " + ", ".join(f"('{f}', '{m}', '{k}', '{f}:{m}:{k}', {LIMITS[k][0]}, {LIMITS[k][1]}, {LIMITS[k][2]}, {LIMITS[k][3]})" for (f, m), kinds in PROFILES.items() for k in kinds) + ") p(format, method, kind, profile_id, min_units, min_chars, short_chars, structured))"


def kind_of(text, format, method) -> Column:
    """table, image_ocr, code, list, title_definition or prose, the first that holds."""
    filled = T.filled_lines(text)
    trimmed = F.transform(filled, lambda x: F.trim(x))
    n = F.size(filled)
    fenced = F.exists(trimmed, lambda x: x.startswith("```")) | ((n > 0) & F.forall(filled, lambda x: x.startswith("    ")))
    listed = (n > 0) & F.forall(trimmed, lambda x: x.rlike(LISTED))
    return (
        F.when((format == "xlsx") | F.exists(filled, lambda x: x.contains("\t")), "table")
        .when((format == "image") | (method == "ocr"), "image_ocr")
        .when(fenced, "code")
        .when(listed, "list")
        .when((n <= 2) & F.col(text).rlike("[:：=]"), "title_definition")
        .otherwise("prose")
    )


def metadata_line(line, source) -> Column:
    """Page chrome, or the source's own name."""
    compact = lambda c: F.regexp_replace(F.lower(c), "[^a-z0-9]+", "")
    stem = F.regexp_replace(source, "\\.[^.]*$", "")
    return F.rtrim(line).rlike(CHROME) | ((compact(stem) != "") & (compact(line) == compact(stem)))


def assessed(parts: DataFrame, forced: str | None = None) -> DataFrame:
    """parts (text, source, format, method, ..) with kind, decision, reasons, capacity and ratios.

    Each row is judged alone: units are its filled lines, those that are metadata bear no evidence in prose and
    title definitions, and the profile of format, method and kind says how much is enough.
    """
    kind = F.lit(forced) if forced else kind_of("text", F.col("format"), F.col("method"))
    p = parts.withColumn("kind", kind).join(F.broadcast(profiles(parts.sparkSession)), ["format", "method", "kind"], "left")
    p = p.withColumn("units", T.filled_lines("text"))
    p = p.withColumns({"meta": F.filter("units", lambda x: metadata_line(x, F.col("source"))), "own": F.filter("units", lambda x: ~metadata_line(x, F.col("source")))})
    chars = lambda c: F.aggregate(c, F.lit(0).cast("long"), lambda a, x: a + F.length(x))
    p = p.withColumn("sorted", F.array_sort(F.transform("own", lambda x: F.trim(x))))
    again = F.size(F.filter("sorted", lambda x, i: F.coalesce(F.get("sorted", i - 1) == x, F.lit(False)) | F.coalesce(F.get("sorted", i + 1) == x, F.lit(False))))
    p = p.withColumns(
        {
            "metadata_ratio": chars("meta") / F.greatest(chars("units"), F.lit(1)),
            "repetition_ratio": again / F.greatest(F.size("own"), F.lit(1)),
            "replacement_ratio": (F.length("text") - F.length(F.replace("text", F.lit("�"), F.lit("")))) / F.greatest(F.length("text"), F.lit(1)),
            "evidence": F.when(F.col("kind").isin("prose", "title_definition"), F.col("own")).otherwise(F.col("units")),
        }
    )
    spans = F.col("evidence")
    enough = (F.size(spans) >= F.col("min_units")) & (chars(spans) >= F.col("min_chars"))
    short = (chars(spans) >= F.col("short_chars")) & (~F.col("structured") | F.col("text").rlike(MARKS) | (F.size("meta") == 0))
    bare = (F.size(spans) == 0) | ((F.col("metadata_ratio") >= DOMINANT) & ((F.col("repetition_ratio") > 0) | ((F.size("meta") >= 2) & (chars("own") < F.col("min_chars")))))
    repeats = (F.col("repetition_ratio") >= REPETITIVE) & F.col("kind").isin("prose", "title_definition")
    stage = (
        F.when((F.col("method") == "unsupported") | F.col("profile_id").isNull(), "unsupported")
        .when(F.col("replacement_ratio") > BROKEN, "quarantine_degraded")
        .when(F.size("units") == 0, "empty")
        .when(bare, "bare")
        .when(enough, "enough")
        .when(short, "short")
        .otherwise("little")
    )
    p = p.withColumns({"stage": stage, "repeats": repeats})
    st = F.col("stage")
    decision = F.when(st.isin("unsupported", "quarantine_degraded"), st).when(st.isin("empty", "bare", "little"), "skip_no_content").when((st == "short") | F.col("repeats"), "ready_with_warning").otherwise("ready")
    first = F.when(st == "unsupported", "unsupported_format").when(st == "quarantine_degraded", "encoding_degraded").when(st == "empty", "empty_input,no_evidence_capacity").when(st == "bare", "metadata_only,no_evidence_capacity").when(st == "short", "legitimate_short").when(st == "little", "no_evidence_capacity")
    tail = F.when(st.isin("enough", "short", "little") & F.col("repeats"), "high_repetition")
    counted = F.when(decision.isin("ready", "ready_with_warning"), spans).otherwise(F.array().cast("array<string>"))
    p = p.withColumns({"decision": decision, "reasons": F.concat_ws(",", first, tail), "counted": counted})
    own = ["kind", F.coalesce("profile_id", F.lit("unknown")).alias("profile_id"), "decision", "reasons", F.size("counted").cast("long").alias("units"), chars("counted").alias("chars")]
    sizes = F.transform("counted", lambda x: F.length(x))
    own += [F.coalesce(F.array_min(sizes), F.lit(0)).cast("long").alias("min_span"), F.coalesce(F.array_max(sizes), F.lit(0)).cast("long").alias("max_span"), F.size("units").cast("long").alias("lines"), *(F.round(c, 4).alias(c) for c in ("metadata_ratio", "repetition_ratio", "replacement_ratio"))]
    return p.select(*(F.col(f"`{c}`") for c in parts.columns), *own)


def assessed_sql(parts: str, keys: str, forced: str | None = None) -> str:
    """The same for DuckDB, as common table expressions that end in `judged`, of a table expression with the keys."""
    filled = "list_filter(string_split(text, chr(10)), lambda x: regexp_matches(x, '\\S'))"
    meta = f"(regexp_matches(rtrim(x), '{CHROME}') OR (regexp_replace(lower(regexp_replace(source, '\\.[^.]*$', '')), '[^a-z0-9]+', '', 'g') <> '' AND regexp_replace(lower(x), '[^a-z0-9]+', '', 'g') = regexp_replace(lower(regexp_replace(source, '\\.[^.]*$', '')), '[^a-z0-9]+', '', 'g')))"
    kind = f"'{forced}'" if forced else (
        "CASE WHEN format = 'xlsx' OR len(list_filter(units, lambda x: contains(x, chr(9)))) > 0 THEN 'table' WHEN format = 'image' OR method = 'ocr' THEN 'image_ocr' "
        "WHEN len(list_filter(units, lambda x: starts_with(trim(x), '```'))) > 0 OR (len(units) > 0 AND len(list_filter(units, lambda x: starts_with(x, '    '))) = len(units)) THEN 'code' "
        f"WHEN len(units) > 0 AND len(list_filter(units, lambda x: regexp_matches(trim(x), '{LISTED}'))) = len(units) THEN 'list' WHEN len(units) <= 2 AND regexp_matches(text, '[:：=]') THEN 'title_definition' ELSE 'prose' END"
    )
    total = lambda c: f"coalesce(list_sum(list_transform({c}, lambda x: length(x))), 0)"
    return f"""
parts AS ({parts}), cut AS (SELECT *, {filled} AS units FROM parts), named AS (SELECT *, {kind} AS kind FROM cut),
looked AS (SELECT n.*, p.profile_id, p.min_units, p.min_chars, p.short_chars, p.structured,
  list_filter(units, lambda x: {meta}) AS meta, list_filter(units, lambda x: NOT {meta}) AS own FROM named n LEFT JOIN profiles p USING (format, method, kind)),
measured AS (SELECT *, list_sort(list_transform(own, lambda x: trim(x))) AS s, CASE WHEN kind IN ('prose', 'title_definition') THEN own ELSE units END AS evidence,
  {total("meta")} / greatest({total("units")}, 1) AS metadata_ratio, (length(text) - length(replace(text, chr(65533), ''))) / greatest(length(text), 1) AS replacement_ratio FROM looked),
again AS (SELECT *, len(list_filter(s, lambda x, i: coalesce(s[i - 1] = x, false) OR coalesce(s[i + 1] = x, false))) / greatest(len(own), 1) AS repetition_ratio FROM measured),
staged AS (SELECT *, repetition_ratio >= {REPETITIVE} AND kind IN ('prose', 'title_definition') AS repeats, CASE WHEN method = 'unsupported' OR profile_id IS NULL THEN 'unsupported'
  WHEN replacement_ratio > {BROKEN} THEN 'quarantine_degraded' WHEN len(units) = 0 THEN 'empty'
  WHEN len(evidence) = 0 OR (metadata_ratio >= {DOMINANT} AND (repetition_ratio > 0 OR (len(meta) >= 2 AND {total("own")} < min_chars))) THEN 'bare'
  WHEN len(evidence) >= min_units AND {total("evidence")} >= min_chars THEN 'enough'
  WHEN {total("evidence")} >= short_chars AND (NOT structured OR regexp_matches(text, '{MARKS}') OR len(meta) = 0) THEN 'short' ELSE 'little' END AS stage FROM again),
decided AS (SELECT *, CASE WHEN stage IN ('unsupported', 'quarantine_degraded') THEN stage WHEN stage IN ('empty', 'bare', 'little') THEN 'skip_no_content' WHEN stage = 'short' OR repeats THEN 'ready_with_warning' ELSE 'ready' END AS decision,
  concat_ws(',', CASE stage WHEN 'unsupported' THEN 'unsupported_format' WHEN 'quarantine_degraded' THEN 'encoding_degraded' WHEN 'empty' THEN 'empty_input,no_evidence_capacity' WHEN 'bare' THEN 'metadata_only,no_evidence_capacity' WHEN 'short' THEN 'legitimate_short' WHEN 'little' THEN 'no_evidence_capacity' END,
    CASE WHEN stage IN ('enough', 'short', 'little') AND repeats THEN 'high_repetition' END) AS reasons FROM staged),
judged AS (SELECT {keys}, kind, coalesce(profile_id, 'unknown') AS profile_id, decision, reasons, len(counted) AS units, {total("counted")}::BIGINT AS chars,
  coalesce(list_min(list_transform(counted, lambda x: length(x))), 0) AS min_span, coalesce(list_max(list_transform(counted, lambda x: length(x))), 0) AS max_span, len(units) AS lines,
  round(metadata_ratio, 4) AS metadata_ratio, round(repetition_ratio, 4) AS repetition_ratio, round(replacement_ratio, 4) AS replacement_ratio
  FROM (SELECT *, CASE WHEN decision LIKE 'ready%' THEN evidence ELSE [] END AS counted FROM decided))"""


def sources(spark, sf_dir) -> DataFrame:
    """Documents as artifacts: English ones Markdown, others plain text, and pages as text of their html."""
    docs = read(spark, sf_dir, "documents").select(F.concat(F.lit("d"), "doc_id").alias("id"), F.coalesce("text", F.lit("")).alias("text"), "source", F.when(F.col("lang") == "en", "md").otherwise("txt").alias("format"), F.lit("native_text").alias("method"))
    pages = read(spark, sf_dir, "pages").select(F.concat(F.lit("p"), "page_id").alias("id"), F.regexp_replace("html", "<[^>]*>", "\n").alias("text"), F.col("url").alias("source"), F.lit("html").alias("format"), F.lit("html_text").alias("method"))
    return docs.union(pages)


SOURCES_SQL = """SELECT 'd' || doc_id AS id, coalesce(text, '') AS text, source, CASE WHEN lang = 'en' THEN 'md' ELSE 'txt' END AS format, 'native_text' AS method FROM documents
  UNION ALL SELECT 'p' || page_id, regexp_replace(html, '<[^>]*>', chr(10), 'g'), url, 'html', 'html_text' FROM pages"""
ALL = "id, format, method"
WHAT = ["id", "format", "kind", "profile_id", "decision", "reasons", "units", "chars", "min_span", "max_span", "lines", "metadata_ratio", "repetition_ratio", "replacement_ratio"]
COLS = ", ".join(WHAT)


@query("doc_19_assessment", f"WITH {PROFILES_SQL}, {assessed_sql(SOURCES_SQL, ALL)} SELECT {COLS} FROM judged")
def assessment(spark, sf_dir) -> DataFrame:
    return assessed(sources(spark, sf_dir)).select(*WHAT)


@query("doc_18_assess_content", f"WITH {PROFILES_SQL}, {assessed_sql("SELECT doc_id AS id, coalesce(text, '') AS text, source, 'md' AS format, 'native_text' AS method FROM documents", ALL, 'prose')} SELECT {COLS} FROM judged")
def assess_content(spark, sf_dir) -> DataFrame:
    """A text alone, as prose."""
    docs = read(spark, sf_dir, "documents").select(F.col("doc_id").alias("id"), F.coalesce("text", F.lit("")).alias("text"), "source", F.lit("md").alias("format"), F.lit("native_text").alias("method"))
    return assessed(docs, "prose").select(*WHAT)


def blocks(artifacts: DataFrame) -> DataFrame:
    """One row for each filled part between blank lines; a text without any is a single block."""
    parts = F.filter(F.split("text", "\n[ \t]*\n"), lambda x: x.rlike("\\S"))
    parts = F.when(F.size(parts) == 0, F.array(F.col("text"))).otherwise(parts)
    rest = [c for c in artifacts.columns if c != "text"]
    return artifacts.select(*rest, F.posexplode(parts).alias("block", "text"))


#: Lines of documents stand alone, so that a text has as many blocks as lines; pages have blank lines of their own.
SPACED = "SELECT 'd' || doc_id AS id, replace(coalesce(text, ''), chr(10), chr(10) || chr(10)) AS text, source, CASE WHEN lang = 'en' THEN 'md' ELSE 'txt' END AS format, 'native_text' AS method FROM documents"
BLOCKS_SQL = f"SELECT id, unnest(b) AS text, generate_subscripts(b, 1) - 1 AS block, source, format, method FROM (SELECT *, CASE WHEN len(p) = 0 THEN [text] ELSE p END AS b FROM (SELECT *, list_filter(string_split(text, chr(10) || chr(10)), lambda x: regexp_matches(x, '\\S')) AS p FROM ({SPACED})))"


def spaced(spark, sf_dir) -> DataFrame:
    docs = sources(spark, sf_dir).where("format <> 'html'")
    return blocks(docs.withColumn("text", F.replace("text", F.lit("\n"), F.lit("\n\n"))))


@query("doc_20_assess_blocks", f"WITH {PROFILES_SQL}, {assessed_sql(BLOCKS_SQL, 'id, block, format, method')} SELECT block, {COLS} FROM judged")
def assess_blocks(spark, sf_dir) -> DataFrame:
    return assessed(spaced(spark, sf_dir)).select(F.col("block").cast("long").alias("block"), *WHAT)


def folded(blocks: DataFrame) -> DataFrame:
    """One judgement for each artifact: the gravest decision of its blocks, all reasons, summed capacity."""
    rank = F.element_at(F.create_map(*(F.lit(x) for p in RANK.items() for x in p)), F.col("decision"))
    b = blocks.withColumn("rank", rank)
    g = b.groupBy("id").agg(
        F.min(F.struct("rank", "block", "decision")).alias("worst"),
        F.min(F.struct("block", "kind", "profile_id")).alias("first"),
        F.count_distinct("kind").alias("kinds"),
        F.max(F.col("decision") == "skip_no_content").alias("skips"),
        F.max(F.col("chars") > 0).alias("bears"),
        F.array_sort(F.array_distinct(F.flatten(F.collect_list(F.filter(F.split("reasons", ","), lambda x: x != ""))))).alias("reasons"),
        F.count("*").alias("n"),
        F.sum((F.col("chars") > 0).cast("long")).alias("blocks"),
        *(F.sum(c).alias(c) for c in ("chars", "units", "lines")),
        F.round(F.sum("metadata_ratio") / F.count("*"), 4).alias("metadata_ratio"),
        *(F.max(c).alias(c) for c in ("repetition_ratio", "replacement_ratio")),
        F.max("max_span").alias("max_span"),
        F.coalesce(F.min(F.when(F.col("chars") > 0, F.col("min_span"))), F.lit(0)).alias("min_span"),
    )
    mixed = (F.col("kinds") > 1) | (F.col("skips") & F.col("bears"))
    gap = F.col("skips") & F.col("bears") & (F.col("n") > 1)
    decision = F.when(gap & (F.col("worst.decision") == "ready"), "ready_with_warning").otherwise(F.col("worst.decision"))
    reasons = F.when(gap, F.array_union("reasons", F.array(F.lit("empty_subblock")))).otherwise(F.col("reasons"))
    return g.select("id", F.when(mixed, "mixed").otherwise(F.col("first.kind")).alias("kind"), F.when(mixed, "mixed").otherwise(F.col("first.profile_id")).alias("profile_id"), decision.alias("decision"), F.array_join(F.array_sort(reasons), ",").alias("reasons"), "blocks", "chars", "units", "lines", "min_span", "max_span", "metadata_ratio", "repetition_ratio", "replacement_ratio")


FOLDED_SQL = "folded AS (SELECT id, CASE WHEN mixed THEN 'mixed' ELSE kind END AS kind, CASE WHEN mixed THEN 'mixed' ELSE profile_id END AS profile_id, CASE WHEN gap AND worst = 'ready' THEN 'ready_with_warning' ELSE worst END AS decision, array_to_string(list_sort(CASE WHEN gap THEN list_append(r, 'empty_subblock') ELSE r END), ',') AS reasons, blocks, chars, units, lines, min_span, max_span, metadata_ratio, repetition_ratio, replacement_ratio FROM (SELECT id, arg_min(kind, block) AS kind, arg_min(profile_id, block) AS profile_id, arg_min(decision, (CASE decision " + " ".join(f"WHEN '{k}' THEN {v}" for k, v in RANK.items()) + " END)::BIGINT * 1000000000 + block) AS worst, count(DISTINCT kind) > 1 OR (bool_or(decision = 'skip_no_content') AND bool_or(chars > 0)) AS mixed, bool_or(decision = 'skip_no_content') AND bool_or(chars > 0) AND count(*) > 1 AS gap, list_distinct(list_filter(flatten(list(string_split(reasons, ','))), lambda x: x <> '')) AS r, count(*) FILTER (WHERE chars > 0) AS blocks, sum(chars)::BIGINT AS chars, sum(units)::BIGINT AS units, sum(lines)::BIGINT AS lines, coalesce(min(min_span) FILTER (WHERE chars > 0), 0) AS min_span, max(max_span) AS max_span, round(sum(metadata_ratio) / count(*), 4) AS metadata_ratio, max(repetition_ratio) AS repetition_ratio, max(replacement_ratio) AS replacement_ratio FROM judged GROUP BY id))"


@query("doc_21_assess_artifact", f"WITH {PROFILES_SQL}, {assessed_sql(BLOCKS_SQL, 'id, block, format, method')}, {FOLDED_SQL} SELECT * FROM folded")
def assess_artifact(spark, sf_dir) -> DataFrame:
    return folded(assessed(spaced(spark, sf_dir)))


@query("doc_17_preprocess", f"WITH {PROFILES_SQL}, {assessed_sql(BLOCKS_SQL, 'id, block, format, method')}, {FOLDED_SQL}, kept AS (SELECT 'd' || doc_id AS id, list_filter(string_split(coalesce(text, ''), chr(10)), lambda x: NOT regexp_matches(rtrim(x), '{CHROME}')) AS k, string_split(coalesce(text, ''), chr(10)) AS l FROM documents) SELECT id, decision, decision IN ('ready', 'ready_with_warning') AS use_model, md5(array_to_string(k, chr(10))) AS prompt_hash, len(l) - len(k) AS removed_lines FROM folded JOIN kept USING (id)")
def preprocess(spark, sf_dir) -> DataFrame:
    """A source's prompt view, what it lost, and whether it is fit for a model."""
    raw = sources(spark, sf_dir).where("format <> 'html'")
    lines = T.lines("text")
    kept = F.filter(lines, lambda x: ~F.rtrim(x).rlike(CHROME))
    view = raw.select("id", F.md5(F.array_join(kept, "\n")).alias("prompt_hash"), (F.size(lines) - F.size(kept)).cast("long").alias("removed_lines"))
    return folded(assessed(spaced(spark, sf_dir))).join(view, "id").select("id", "decision", F.col("decision").isin("ready", "ready_with_warning").alias("use_model"), "prompt_hash", "removed_lines")


@query("sup_02_inventory", f"WITH {PROFILES_SQL}, {assessed_sql(SOURCES_SQL, ALL)} SELECT format, decision, count(*) AS n, sum(chars)::BIGINT AS chars FROM judged GROUP BY format, decision")
def inventory(spark, sf_dir) -> DataFrame:
    return assessed(sources(spark, sf_dir)).groupBy("format", "decision").agg(F.count("*").alias("n"), F.sum("chars").alias("chars"))


@query("doc_23_metadata_lines", f"SELECT doc_id, count(*) AS n FROM (SELECT doc_id, source, unnest(string_split(text, chr(10))) AS x FROM documents) WHERE regexp_matches(rtrim(x), '{CHROME}') OR (regexp_replace(lower(regexp_replace(source, '\\.[^.]*$', '')), '[^a-z0-9]+', '', 'g') <> '' AND regexp_replace(lower(x), '[^a-z0-9]+', '', 'g') = regexp_replace(lower(regexp_replace(source, '\\.[^.]*$', '')), '[^a-z0-9]+', '', 'g')) GROUP BY doc_id")
def metadata_lines(spark, sf_dir) -> DataFrame:
    x = read(spark, sf_dir, "documents").select("doc_id", "source", F.explode(T.lines("text")).alias("x"))
    return x.where(metadata_line(F.col("x"), F.col("source"))).groupBy("doc_id").agg(F.count("*").alias("n"))


@query("doc_24_select_profile", f"WITH {PROFILES_SQL}, asked AS (SELECT DISTINCT format, method, k.kind FROM ({SOURCES_SQL}), (SELECT DISTINCT kind FROM profiles) k) SELECT a.*, p.profile_id, p.min_units, p.min_chars FROM asked a LEFT JOIN profiles p USING (format, method, kind)")
def select_profile(spark, sf_dir) -> DataFrame:
    """Which profile each format, method and kind has, if any."""
    p = profiles(spark)
    asked = sources(spark, sf_dir).select("format", "method").distinct().withColumn("kind", F.explode(F.array(*map(F.lit, LIMITS))))
    return asked.join(F.broadcast(p), ["format", "method", "kind"], "left").select("format", "method", "kind", "profile_id", "min_units", "min_chars")


#: Rules of the prompt view (a parameter of the engine): name and pattern of the lines that go, in order.
RULES = (("chrome", "(?i)^(share|edit|subscribe|advertisement)$"), ("source_line", "(?i)^source: https?://"), ("license", "(?i)^(licensed|released) under"))


def matching(lines, pattern: str) -> Column:
    return F.filter(lines, lambda x: F.rtrim(x).rlike(pattern))


@query(
    "doc_15_prompt_view",
    "SELECT doc_id, " + ", ".join(f"len(list_filter(l, lambda x: regexp_matches(rtrim(x), '{p}')))::BIGINT AS {n}_lines, coalesce(list_sum(list_transform(list_filter(l, lambda x: regexp_matches(rtrim(x), '{p}')), lambda x: length(x))), 0)::BIGINT AS {n}_chars" for n, p in RULES) + " FROM (SELECT doc_id, string_split(text, chr(10)) AS l FROM documents) WHERE l IS NOT NULL",
)
def prompt_view(spark, sf_dir) -> DataFrame:
    """What each rule takes out of a text: lines and characters."""
    out = []
    for name, pattern in RULES:
        gone = matching(T.lines("text"), pattern)
        out += [F.size(gone).cast("long").alias(f"{name}_lines"), F.aggregate(gone, F.lit(0).cast("long"), lambda a, x: a + F.length(x)).alias(f"{name}_chars")]
    return read(spark, sf_dir, "documents").where("text is not null").select("doc_id", *out)


@query("doc_01_normalize", r"SELECT doc_id, pos - 1 AS ordinal, 'block_' || substr(sha256(doc_id || chr(31) || (pos - 1) || chr(31) || b || chr(31) || 'v1'), 1, 24) AS block_id, length(b) AS n_chars FROM (SELECT doc_id, unnest(p) AS b, generate_subscripts(p, 1) AS pos FROM (SELECT doc_id, list_filter(string_split(regexp_replace(regexp_replace(nfc_normalize(replace(replace(text, chr(10), chr(13) || chr(10) || chr(10)), chr(13) || chr(10), chr(10))), '[ \t\f]+\n', chr(10), 'g'), '^\s+|\s+$', '', 'g'), chr(10) || chr(10)), lambda x: regexp_matches(x, '\S')) AS p FROM documents))")
def normalize(spark, sf_dir) -> DataFrame:
    """Composed characters, line feeds, no trailing blanks; parts between blank lines with stable ids. Lines get a blank line after them here."""
    text = F.regexp_replace(F.regexp_replace(F.replace("text", F.lit("\n"), F.lit("\r\n\n")), "\r\n?", "\n"), "^﻿", "")
    text = F.regexp_replace(F.regexp_replace(composed(text), "[ \\t\\f]+\n", "\n"), "^\\s+|\\s+$", "")
    b = read(spark, sf_dir, "documents").select("doc_id", F.posexplode(F.filter(F.split(text, "\n\n"), lambda x: x.rlike("\\S"))).alias("ordinal", "block"))
    return b.select("doc_id", F.col("ordinal").cast("long").alias("ordinal"), T.stable_id("block_", F.col("doc_id").cast("string"), F.col("ordinal").cast("string"), F.col("block"), F.lit("v1")).alias("block_id"), F.length("block").cast("long").alias("n_chars"))
