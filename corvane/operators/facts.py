"""Scalar rules on identifiers, text, evidence, relations and dates."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from corvane.functions import text as T
from corvane.plans.registry import query
from corvane.sources.tables import DAY, NOW, SQL, claims, edges, read, wiki


@query("doc_05_block_ids", "SELECT doc_id, pos - 1 AS ordinal, 'block_' || substr(sha256(doc_id || chr(31) || (pos - 1) || chr(31) || block || chr(31) || 'v1'), 1, 24) AS block_id FROM (SELECT doc_id, unnest(string_split(text, chr(10))) AS block, generate_subscripts(string_split(text, chr(10)), 1) AS pos FROM documents) WHERE block <> ''")
def block_ids(spark, sf_dir) -> DataFrame:
    """A stable id for each filled block, of its document, place, text and version."""
    b = read(spark, sf_dir, "documents").select("doc_id", F.posexplode(T.lines("text")).alias("ordinal", "block")).where("block <> ''")
    return b.select("doc_id", F.col("ordinal").cast("long").alias("ordinal"), T.stable_id("block_", F.col("doc_id").cast("string"), F.col("ordinal").cast("string"), F.col("block"), F.lit("v1")).alias("block_id"))


@query("doc_06_evidence_ids", SQL + "SELECT id, 'evidence_' || substr(sha256('d' || entity || chr(31) || ordinal || chr(31) || sha256(statement) || chr(31) || id), 1, 24) AS evidence_id FROM claims")
def evidence_ids(spark, sf_dir) -> DataFrame:
    return claims(spark, sf_dir).select("id", T.stable_id("evidence_", F.concat(F.lit("d"), "entity"), F.col("ordinal").cast("string"), F.sha2("statement", 256), F.col("id")).alias("evidence_id"))


CHROME = "(?i)^(share|edit|subscribe|advertisement)$|^source: https?://|^licensed under|^released under"


@query("doc_14_denoise", f"SELECT doc_id, md5(array_to_string(list_filter(string_split(text, chr(10)), lambda x: NOT regexp_matches(rtrim(x), '{CHROME}')), chr(10))) AS hash FROM documents")
def denoise(spark, sf_dir) -> DataFrame:
    """Lines that are page chrome or metadata are dropped; the patterns are a parameter of the engine."""
    kept = F.filter(T.lines("text"), lambda x: ~F.rtrim(x).rlike(CHROME))
    return read(spark, sf_dir, "documents").select("doc_id", F.md5(F.array_join(kept, "\n")).alias("hash"))


@query("doc_22_content_kind", "WITH f AS (SELECT doc_id, text, list_filter(string_split(text, chr(10)), lambda x: regexp_matches(x, '\\S')) AS l FROM documents) SELECT doc_id, CASE WHEN len(l) > 0 AND len(list_filter(l, lambda x: contains(x, '|'))) * 2 >= len(l) THEN 'table' WHEN contains(text, '```') THEN 'code' WHEN len(l) > 0 AND len(list_filter(l, lambda x: regexp_matches(x, '^[ \\t]*([-*]|[0-9]+[.)])[ \\t]+'))) = len(l) THEN 'list' WHEN len(l) = 1 AND length(text) < 80 THEN 'title_definition' ELSE 'prose' END AS kind FROM f")
def content_kind(spark, sf_dir) -> DataFrame:
    """table, code, list, title_definition or prose, in this order."""
    filled = T.filled_lines("text")
    bars = F.size(F.filter(filled, lambda x: x.contains("|")))
    items = F.size(F.filter(filled, lambda x: x.rlike("^[ \\t]*([-*]|[0-9]+[.)])[ \\t]+")))
    n = F.size(filled)
    kind = F.when((n > 0) & (bars * 2 >= n), "table").when(F.col("text").contains("```"), "code").when((n > 0) & (items == n), "list").when((n == 1) & (F.length("text") < 80), "title_definition").otherwise("prose")
    return read(spark, sf_dir, "documents").select("doc_id", kind.alias("kind"))


@query("doc_28_short_form", "SELECT doc_id, length(text) AS char_count, len(regexp_extract_all(text, '\\n[ \\t]*([0-9]+[.)]|[-*])[ \\t]')) AS step_count, length(text) < 200 OR len(regexp_extract_all(text, '\\n[ \\t]*([0-9]+[.)]|[-*])[ \\t]')) < 3 AS is_short FROM documents")
def short_form(spark, sf_dir) -> DataFrame:
    """Short if it has few characters or few steps."""
    steps = F.regexp_count("text", F.lit("\\n[ \\t]*([0-9]+[.)]|[-*])[ \\t]")).cast("long")
    return read(spark, sf_dir, "documents").select("doc_id", F.length("text").cast("long").alias("char_count"), steps.alias("step_count"), ((F.length("text") < 200) | (steps < 3)).alias("is_short"))


@query("str_03_reconcile_slug", SQL + "SELECT id, trim(regexp_replace(lower(regexp_replace(regexp_replace('[[wiki/' || title || '|label]]', '^\\[\\[|\\]\\]$', '', 'g'), '(^.*/)|(\\|.*$)|(#.*$)', '', 'g')), '[^a-z0-9]+', '-', 'g'), '-') AS slug FROM wiki")
def reconcile_slug(spark, sf_dir) -> DataFrame:
    """Link marks, label, anchor and path prefix are stripped, then the slug is made."""
    inner = F.regexp_replace(F.concat(F.lit("[[wiki/"), "title", F.lit("|label]]")), "^\\[\\[|\\]\\]$", "")
    return wiki(spark, sf_dir).select("id", T.ascii_slug(F.regexp_replace(inner, "(^.*/)|(\\|.*$)|(#.*$)", "")).alias("slug"))


@query("str_04_id_chars", "SELECT doc_id, trim(regexp_replace(regexp_replace(lower(source || '__' || lang || '.' || doc_id), '[^a-z0-9-]', '-', 'g'), '-+', '-', 'g'), '-') AS id FROM documents")
def id_chars(spark, sf_dir) -> DataFrame:
    raw = F.lower(F.concat("source", F.lit("__"), "lang", F.lit("."), "doc_id"))
    return read(spark, sf_dir, "documents").select("doc_id", F.regexp_replace(F.regexp_replace(F.regexp_replace(raw, "[^a-z0-9-]", "-"), "-+", "-"), "^-|-$", "").alias("id"))


@query("str_05_wikilinks", "SELECT page_id, len(regexp_extract_all(html, 'href=\"([^\"]+)\"', 1)) AS n_links, array_to_string(regexp_extract_all(html, 'href=\"([^\"]+)\"', 1), ' ') AS links FROM pages")
def links(spark, sf_dir) -> DataFrame:
    """Link targets in the order of the page."""
    found = F.regexp_extract_all("html", F.lit('href="([^"]+)"'), 1)
    return read(spark, sf_dir, "pages").select("page_id", F.size(found).cast("long").alias("n_links"), F.array_join(found, " ").alias("links"))


@query("str_08_jaccard", SQL + ", t AS (SELECT id, entity, ordinal, list_distinct(regexp_extract_all(lower(statement), '[\\p{L}\\p{N}_]+')) AS t FROM claims) SELECT a.id AS a, b.id AS b, round(CASE WHEN len(a.t) = 0 OR len(b.t) = 0 THEN 0 ELSE len(list_intersect(a.t, b.t)) / len(list_distinct(list_concat(a.t, b.t))) END, 6) AS similarity FROM t a JOIN t b ON a.entity = b.entity AND b.ordinal = a.ordinal + 1")
def jaccard(spark, sf_dir) -> DataFrame:
    """Of each turn and the next."""
    t = claims(spark, sf_dir).select("id", "entity", "ordinal", T.tokens("statement").alias("t"))
    a, b = t.select("entity", (F.col("ordinal") + 1).alias("ordinal"), F.col("id").alias("a"), F.col("t").alias("x")), t.select("entity", "ordinal", F.col("id").alias("b"), F.col("t").alias("y"))
    return a.join(b, ["entity", "ordinal"]).select("a", "b", F.round(T.jaccard(F.col("x"), F.col("y")), 6).alias("similarity"))


@query("str_14_intent", SQL + "SELECT id, CASE WHEN regexp_matches(lower(statement), 'recall|find the|show me') THEN 'recall' WHEN regexp_matches(lower(statement), 'verify|is it true|correct') THEN 'verify' WHEN regexp_matches(lower(statement), 'why|explain|because') THEN 'explain' ELSE 'search' END AS intent FROM claims")
def intent(spark, sf_dir) -> DataFrame:
    low = F.lower("statement")
    return claims(spark, sf_dir).select("id", F.when(low.rlike("recall|find the|show me"), "recall").when(low.rlike("verify|is it true|correct"), "verify").when(low.rlike("why|explain|because"), "explain").otherwise("search").alias("intent"))


@query("str_15_entities", SQL + "SELECT id, array_to_string(list_distinct_ordered, '|') AS entities FROM (SELECT id, list_transform(list_filter(range(1, len(l) + 1), lambda i: list_position(l, l[i]) = i), lambda i: l[i]) AS list_distinct_ordered FROM (SELECT id, list_filter(regexp_extract_all(statement, '[\\p{L}]+'), lambda w: regexp_matches(w, '^[A-Z][a-z]+$')) AS l FROM claims))")
def entities(spark, sf_dir) -> DataFrame:
    """Capitalised words, once each, in order."""
    return claims(spark, sf_dir).select("id", F.array_join(F.array_distinct(F.filter(F.regexp_extract_all("statement", F.lit("([\\p{L}]+)"), 1), lambda w: w.rlike("^[A-Z][a-z]+$"))), "|").alias("entities"))


@query("str_18_longest_prose", "SELECT doc_id, max(n)::BIGINT AS longest FROM (SELECT doc_id, run, sum(n) AS n FROM (SELECT doc_id, CASE WHEN blank THEN 0 ELSE n END AS n, sum(blank::INT) OVER (PARTITION BY doc_id ORDER BY pos) AS run FROM (SELECT doc_id, pos, length(trim(line)) AS n, NOT regexp_matches(line, '\\S') OR regexp_matches(line, '^[ \\t]*[-*>|]') AS blank FROM (SELECT doc_id, unnest(string_split(text, chr(10))) AS line, generate_subscripts(string_split(text, chr(10)), 1) AS pos FROM documents))) GROUP BY doc_id, run) GROUP BY doc_id")
def longest_prose(spark, sf_dir) -> DataFrame:
    """The longest run of prose characters; blank lines, lists, quotes and tables break it. A fold over the lines, without a shuffle."""
    start = F.struct(F.lit(0).cast("long").alias("run"), F.lit(0).cast("long").alias("most"))

    def step(acc, line):
        breaks = ~line.rlike("\\S") | line.rlike("^[ \\t]*[-*>|]")
        run = F.when(breaks, F.lit(0).cast("long")).otherwise(acc["run"] + F.length(F.trim(line)))
        return F.struct(run.alias("run"), F.greatest(acc["most"], run).alias("most"))

    return read(spark, sf_dir, "documents").select("doc_id", F.aggregate(T.lines("text"), start, step)["most"].alias("longest"))


@query("str_21_version", "SELECT p_partkey, major, minor, major * 1000 + minor AS key FROM (SELECT p_partkey, p_partkey % 7 AS major, p_partkey % 13 AS minor FROM part)")
def version(spark, sf_dir) -> DataFrame:
    """Version strings parsed to numbers."""
    parts = F.split(F.concat(F.col("p_partkey") % 7, F.lit("."), F.col("p_partkey") % 13), "\\.")
    p = read(spark, sf_dir, "part").select("p_partkey", parts[0].cast("long").alias("major"), parts[1].cast("long").alias("minor"))
    return p.withColumn("key", F.col("major") * 1000 + F.col("minor"))


@query("str_29_canonical_quote", SQL + "SELECT id, sha256(trim(regexp_replace(regexp_replace(statement, '\\r\\n?', chr(10), 'g'), '[ \\t]+(\\n)', '\\1', 'g'))) AS quote_hash FROM claims")
def canonical_quote(spark, sf_dir) -> DataFrame:
    return claims(spark, sf_dir).select("id", F.sha2(F.trim(F.regexp_replace(F.regexp_replace("statement", "\r\n?", "\n"), "[ \\t]+(?=\n)", "")), 256).alias("quote_hash"))


@query("str_28_truncation", "SELECT event_id, CASE WHEN NOT json_valid(j) THEN 'json_truncated' WHEN json_type(j) <> 'OBJECT' THEN 'not_object' WHEN json_extract(j, '$.k') IS NULL THEN 'field_missing' END AS failure FROM (SELECT event_id, CASE event_id % 5 WHEN 0 THEN substr(props, 1, 4) WHEN 1 THEN '[1]' WHEN 2 THEN '{\"z\":1}' ELSE props END AS j FROM events)")
def truncation(spark, sf_dir) -> DataFrame:
    """What is wrong with a JSON answer, in order: not whole, no object, field missing."""
    m = F.col("event_id") % 5
    j = F.when(m == 0, F.substring("props", 1, 4)).when(m == 1, "[1]").when(m == 2, '{"z":1}').otherwise(F.col("props"))
    v = F.try_parse_json(j)
    keys = F.schema_of_variant(v)
    fail = F.when(v.isNull(), "json_truncated").when(~keys.startswith("OBJECT"), "not_object").when(F.try_variant_get(v, "$.k", "string").isNull(), "field_missing")
    return read(spark, sf_dir, "events").select("event_id", fail.alias("failure"))


@query("fn_02_identity_key", "SELECT c_custkey, 'id-v1:' || sha256('{\"name\":\"' || lower(trim(c_name)) || '\",\"nation\":\"' || c_nationkey || '\"}') AS identity_key FROM customer")
def identity_key(spark, sf_dir) -> DataFrame:
    """sha256 of the sorted, normalised fields as compact JSON."""
    j = F.concat(F.lit('{"name":"'), F.lower(F.trim("c_name")), F.lit('","nation":"'), F.col("c_nationkey").cast("string"), F.lit('"}'))
    return read(spark, sf_dir, "customer").select("c_custkey", F.concat(F.lit("id-v1:"), F.sha2(j, 256)).alias("identity_key"))


@query("fn_10_to_millis", "SELECT o_orderkey, epoch_ms(o_orderdate) AS ms FROM orders")
def to_millis(spark, sf_dir) -> DataFrame:
    return read(spark, sf_dir, "orders").select("o_orderkey", F.unix_millis(F.col("o_orderdate").cast("timestamp")).alias("ms"))


@query("fn_11_from_millis", SQL + "SELECT id, make_timestamp(created_at * 1000) AS created FROM wiki")
def from_millis(spark, sf_dir) -> DataFrame:
    return wiki(spark, sf_dir).select("id", F.timestamp_millis("created_at").cast("timestamp_ntz").alias("created"))


# Strength of evidence by its type.
STRENGTH = {"direct_quote": "strong", "structured_source": "strong", "code": "strong", "computed": "medium", "multi_source": "medium", "inferred": "weak"}


def strength(kind, keys) -> Column:
    """Strong, medium or weak; structured sources need three provenance keys, computations four."""
    need = lambda names: F.size(F.array_except(F.array(*map(F.lit, names)), keys)) == 0
    base = F.coalesce(F.element_at(F.create_map(*[F.lit(x) for kv in STRENGTH.items() for x in kv]), kind), F.lit("medium"))
    structured, computed = need(("schema_id", "record_key", "field_path")), need(("input_ids", "algorithm", "algorithm_version", "result_hash"))
    return F.when((kind == "structured_source") & ~structured, "weak").when((kind == "computed") & ~computed, "weak").otherwise(base)


@query("fn_20_strength", "WITH e AS (SELECT p_partkey, ['direct_quote', 'structured_source', 'code', 'computed', 'multi_source', 'inferred', 'other'][p_partkey % 7 + 1] AS kind, CASE WHEN p_partkey % 2 = 0 THEN ['schema_id', 'record_key', 'field_path', 'input_ids', 'algorithm', 'algorithm_version', 'result_hash'] ELSE ['schema_id'] END AS keys FROM part) SELECT p_partkey, CASE WHEN kind IN ('structured_source', 'computed') AND len(keys) = 1 THEN 'weak' WHEN kind IN ('direct_quote', 'structured_source', 'code') THEN 'strong' WHEN kind = 'inferred' THEN 'weak' ELSE 'medium' END AS strength FROM e")
def strengths(spark, sf_dir) -> DataFrame:
    kinds = F.array(*(F.lit(k) for k in (*STRENGTH, "other")))
    full = F.array(*map(F.lit, ("schema_id", "record_key", "field_path", "input_ids", "algorithm", "algorithm_version", "result_hash")))
    p = read(spark, sf_dir, "part").select("p_partkey", F.element_at(kinds, (F.col("p_partkey") % 7 + 1).cast("int")).alias("kind"), F.when(F.col("p_partkey") % 2 == 0, full).otherwise(F.array(F.lit("schema_id"))).alias("keys"))
    return p.select("p_partkey", strength(F.col("kind"), F.col("keys")).alias("strength"))


@query("fn_21_split_unit", "SELECT conv_id, count(*) FILTER (WHERE contains(text, '?')) > 1 OR count(DISTINCT role) > 2 OR avg(length(text)) < 20 AS split FROM conversations GROUP BY conv_id")
def split_unit(spark, sf_dir) -> DataFrame:
    """A unit is split if it answers several questions, mixes audiences, or its parts change apart."""
    return read(spark, sf_dir, "conversations").groupBy("conv_id").agg(((F.count_if(F.col("text").contains("?")) > 1) | (F.count_distinct("role") > 2) | (F.avg(F.length("text")) < 20)).alias("split"))


@query("fn_28_relation_allowed", SQL + "SELECT type, CASE WHEN type IN ('references', 'is_part_of', 'contradicts') THEN 'allowed' WHEN starts_with(type, 'x-') THEN 'custom_unregistered' ELSE 'unknown' END AS verdict, count(*) AS n FROM (SELECT CASE WHEN source_id = 'doc-2' THEN 'x-own' WHEN source_id = 'doc-3' THEN 'odd' ELSE type END AS type FROM edges) GROUP BY ALL")
def relation_allowed(spark, sf_dir) -> DataFrame:
    e = edges(spark, sf_dir).select(F.when(F.col("source_id") == "doc-2", "x-own").when(F.col("source_id") == "doc-3", "odd").otherwise(F.col("type")).alias("type"))
    from corvane.operators.lifecycle import INVERSES, SYMMETRIC

    verdict = F.when(F.col("type").isin(*INVERSES, *SYMMETRIC), "allowed").when(F.col("type").startswith("x-"), "custom_unregistered").otherwise("unknown")
    return e.groupBy("type", verdict.alias("verdict")).agg(F.count("*").alias("n"))


@query("fn_29_structured_facts", "SELECT c_custkey AS subject, 'balance' AS field, CAST(c_acctbal AS VARCHAR) AS value, 'number' AS value_type FROM customer WHERE c_custkey % 100 = 0 UNION ALL SELECT c_custkey, 'name', c_name, 'string' FROM customer WHERE c_custkey % 100 = 0")
def structured_facts(spark, sf_dir) -> DataFrame:
    """Table rows as typed facts: one row for each field."""
    c = read(spark, sf_dir, "customer").where("c_custkey % 100 = 0")
    facts = F.array(F.struct(F.lit("balance").alias("field"), F.col("c_acctbal").cast("string").alias("value"), F.lit("number").alias("value_type")), F.struct(F.lit("name").alias("field"), F.col("c_name").alias("value"), F.lit("string").alias("value_type")))
    return c.select(F.col("c_custkey").alias("subject"), F.explode(facts).alias("x")).select("subject", "x.*")


@query("fn_30_round_up", "SELECT doc_id, (n_chars + 49) // 50 * 50 AS rounded FROM documents")
def round_up(spark, sf_dir) -> DataFrame:
    return read(spark, sf_dir, "documents").select("doc_id", (F.ceil(F.col("n_chars") / 50) * 50).alias("rounded"))


@query("fn_31_stable_key", SQL + "SELECT id, category || '::' || type AS stable_key FROM wiki")
def stable_key(spark, sf_dir) -> DataFrame:
    return wiki(spark, sf_dir).select("id", F.concat_ws("::", "category", "type").alias("stable_key"))


@query("fn_33_obsolete", SQL + f"SELECT id FROM wiki WHERE NOT is_immutable AND greatest(created_at, last_used_at) < {NOW - 30 * DAY} AND heat > 0 AND heat <= 10")
def obsolete(spark, sf_dir) -> DataFrame:
    """Pages that become zombies."""
    from corvane.operators.lifecycle import decayed

    return decayed(wiki(spark, sf_dir)).where("zombie_since is not null").select("id")


@query("flt_12_normalize_tags", "SELECT doc_id, array_to_string(list_concat(t, CASE WHEN len(t) > 0 THEN ['origin/import'] ELSE [] END), ',') AS tags FROM (SELECT doc_id, list_filter(['language/' || lang, 'src/' || source, 'junk'], lambda x: regexp_matches(x, '^(language|src)/')) AS t FROM documents)")
def normalize_tags(spark, sf_dir) -> DataFrame:
    """Old prefixes are mapped, tags without a known one dropped, mandatory tags added if any is left."""
    tags = F.array(F.concat(F.lit("lang/"), "lang"), F.concat(F.lit("src/"), "source"), F.lit("junk"))
    kept = F.array_distinct(F.filter(F.transform(tags, lambda t: F.regexp_replace(t, "^lang/", "language/")), lambda t: t.rlike("^(language|src)/")))
    return read(spark, sf_dir, "documents").select("doc_id", F.array_join(F.when(F.size(kept) > 0, F.array_union(kept, F.array(F.lit("origin/import")))).otherwise(kept), ",").alias("tags"))


@query("flt_10_invalid_tags", "SELECT doc_id, tag FROM (SELECT doc_id, unnest(['lang/' || lang, 'src/' || source]) AS tag FROM documents) WHERE tag NOT IN ('lang/en', 'lang/de') AND NOT starts_with(tag, 'src/')")
def invalid_tags(spark, sf_dir) -> DataFrame:
    tags = read(spark, sf_dir, "documents").select("doc_id", F.explode(F.array(F.concat(F.lit("lang/"), "lang"), F.concat(F.lit("src/"), "source"))).alias("tag"))
    return tags.where(~F.col("tag").isin("lang/en", "lang/de") & ~F.col("tag").startswith("src/"))


@query("flt_11_missing_tags", "SELECT doc_id, CASE WHEN lang <> 'en' THEN 'lang/en' END AS missing FROM documents WHERE lang <> 'en'")
def missing_tags(spark, sf_dir) -> DataFrame:
    lacking = F.array_except(F.array(F.lit("lang/en")), F.array(F.concat(F.lit("lang/"), "lang")))
    return read(spark, sf_dir, "documents").select("doc_id", F.explode(lacking).alias("missing"))


@query("flt_14_carrier", "SELECT doc_id FROM documents WHERE regexp_matches(regexp_replace(substr(text, 1, 200), '[ \\t\\n\\r]+', '', 'g'), '(?i)^the')")
def carrier(spark, sf_dir) -> DataFrame:
    """Sources whose header, without white space, matches."""
    return read(spark, sf_dir, "documents").where(F.regexp_replace(F.substring("text", 1, 200), "[ \\t\\n\\r]+", "").rlike("(?i)^the")).select("doc_id")


@query("flt_15_blocklist", "SELECT page_id FROM pages WHERE regexp_matches(url, '#top$|-[0-9a-f]{8}$')")
def blocklisted(spark, sf_dir) -> DataFrame:
    return read(spark, sf_dir, "pages").where(F.col("url").rlike("#top$|-[0-9a-f]{8}$")).select("page_id")


@query("flt_16_valid_id", SQL + "SELECT id, regexp_matches(id, '^[a-z]+-[0-9]{1,3}$') AS valid FROM wiki")
def valid_id(spark, sf_dir) -> DataFrame:
    return wiki(spark, sf_dir).select("id", F.col("id").rlike("^[a-z]+-[0-9]{1,3}$").alias("valid"))


@query("flt_19_should_judge", SQL + "SELECT id FROM wiki WHERE grade = 'A' OR heat < 20 OR ('0x' || substr(md5(id), 1, 4))::INT % 10 = 0")
def should_judge(spark, sf_dir) -> DataFrame:
    """Good or cold pages, and a tenth of the others by a hash."""
    sampled = F.conv(F.substring(F.md5("id"), 1, 4), 16, 10).cast("int") % 10 == 0
    return wiki(spark, sf_dir).where((F.col("grade") == "A") | (F.col("heat") < 20) | sampled).select("id")


@query("sup_18_id_bucket", "SELECT page_id, CASE WHEN contains(url, '?') OR contains(url, '#') THEN 'raw_or_path' WHEN contains(url, '/fr/') THEN 'tag_like' WHEN starts_with(url, 'http:') THEN 'type_prefix' WHEN regexp_matches(url, '[0-9]{3}$') THEN 'source_like' ELSE 'clean' END AS bucket FROM pages")
def id_bucket(spark, sf_dir) -> DataFrame:
    u = F.col("url")
    bucket = F.when(u.contains("?") | u.contains("#"), "raw_or_path").when(u.contains("/fr/"), "tag_like").when(u.startswith("http:"), "type_prefix").when(u.rlike("[0-9]{3}$"), "source_like").otherwise("clean")
    return read(spark, sf_dir, "pages").select("page_id", bucket.alias("bucket"))


@query("sup_45_block_id", "SELECT o_orderkey, 'kb_' || substr(sha256(o_custkey || ':' || o_orderkey), 1, 8) || '_block' AS block_id FROM orders")
def knowledge_block_id(spark, sf_dir) -> DataFrame:
    return read(spark, sf_dir, "orders").select("o_orderkey", F.concat(F.lit("kb_"), F.substring(F.sha2(F.concat_ws(":", "o_custkey", "o_orderkey"), 256), 1, 8), F.lit("_block")).alias("block_id"))


@query("sup_40_route", SQL + "SELECT id, CASE WHEN regexp_matches(lower(statement), '^(https?://|ingest|add )') THEN 'ingest' ELSE 'search' END AS route FROM claims")
def route(spark, sf_dir) -> DataFrame:
    return claims(spark, sf_dir).select("id", F.when(F.lower("statement").rlike("^(https?://|ingest|add )"), "ingest").otherwise("search").alias("route"))


@query("sup_03_token_count", "SELECT doc_id, len(regexp_extract_all(text, '[\\x{4e00}-\\x{9fff}]')) + len(regexp_extract_all(regexp_replace(text, '[#*_`>|]', ' ', 'g'), '[A-Za-z0-9]+')) AS tokens FROM documents")
def approximate_tokens(spark, sf_dir) -> DataFrame:
    """CJK characters, and ASCII words without marks."""
    n = F.regexp_count("text", F.lit("[\\u4e00-\\u9fff]")) + F.regexp_count(F.regexp_replace("text", "[#*_`>|]", " "), F.lit("[A-Za-z0-9]+"))
    return read(spark, sf_dir, "documents").select("doc_id", n.cast("long").alias("tokens"))


@query("udf_11_answer_fallback", SQL + "SELECT entity, string_agg(substr(statement, 1, 200), ' ' ORDER BY ordinal) AS answer FROM claims GROUP BY entity")
def answer_fallback(spark, sf_dir) -> DataFrame:
    """Without a model, an answer is the beginnings of its passages, in order; a conversation has few."""
    parts = F.sort_array(F.collect_list(F.struct("ordinal", F.substring("statement", 1, 200).alias("s"))))
    return claims(spark, sf_dir).groupBy("entity").agg(F.array_join(F.transform(parts, lambda x: x["s"]), " ").alias("answer"))
