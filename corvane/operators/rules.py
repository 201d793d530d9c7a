"""Rules on text, tags, paths, citations and evidence as columns."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from corvane.functions import text as T
from corvane.plans.registry import query
from corvane.sources.tables import SQL, claims, edges, read, wiki

# Keywords of each memory type, memory types of each kind of question, pairs of opposites.
KEYWORDS = {"semantic": ("concept", "entity", "semantic", "knowledge"), "episodic": ("event", "episodic", "experience", "incident"), "decision": ("decision", "choice", "verdict", "resolution"), "procedural": ("procedure", "how-to", "steps", "process", "method")}
MEMORIES = {"factoid": "semantic", "explanatory": "semantic,episodic", "procedural": "procedural", "decision_context": "decision"}
OPPOSITES = (("always", "never"), ("all", "none"), ("increase", "decrease"), ("true", "false"), ("with", "without"))
#: Tag prefixes with their vocabulary; free form if there is none (parameters).
TAGS = {"language": ("en", "de", "fr", "es"), "src": (), "status": ("O", "F", "P")}


def fenced_out(lines) -> Column:
    """Lines outside fenced blocks, and without the fences."""
    start = F.struct(F.lit(False).alias("inside"), F.array().cast("array<string>").alias("kept"))

    def step(a, x):
        fence = F.trim(x).startswith("```")
        return F.struct((a["inside"] != fence).alias("inside"), F.when(fence | a["inside"], a["kept"]).otherwise(F.concat(a["kept"], F.array(x))).alias("kept"))

    return F.aggregate(lines, start, step, lambda a: a["kept"])


#: Documents with a fenced block, a transcript heading and viewpoint links, so that there is something to find.
MARKED = "concat('# ', source, chr(10), '```', chr(10), '## Transcript', chr(10), '```', chr(10), CASE WHEN doc_id % 3 = 0 THEN concat('## Transcript', chr(10)) ELSE '' END, '## Viewpoints', chr(10), '[[a]] and [[', lang, ']]', chr(10), '```', chr(10), '[[no]]', chr(10), '```', chr(10), CASE WHEN doc_id % 2 = 0 THEN concat('[[d', doc_id, ']]', chr(10)) ELSE '' END, '## Next', chr(10), '[[b]]')"


def marked(spark, sf_dir) -> DataFrame:
    return read(spark, sf_dir, "documents").select("doc_id", "source", "lang", F.expr(MARKED).alias("body"))


@query("str_19_fulltext_section", "SELECT doc_id, doc_id % 3 = 0 AS has_fulltext FROM documents")
def fulltext_section(spark, sf_dir) -> DataFrame:
    """Whether a transcript heading stands outside fenced code."""
    own = F.exists(fenced_out(F.split("body", "\n")), lambda x: F.trim(x).rlike("(?i)^##? (transcript|full text)$"))
    return marked(spark, sf_dir).select("doc_id", F.coalesce(own, F.lit(False)).alias("has_fulltext"))


@query("str_20_viewpoint_links", "SELECT doc_id, CASE WHEN source IS NULL OR lang IS NULL THEN NULL ELSE 2 + CASE WHEN doc_id % 2 = 0 THEN 1 ELSE 0 END END::BIGINT AS n FROM documents")
def viewpoint_links(spark, sf_dir) -> DataFrame:
    """Links of the section on viewpoints, up to the next heading, outside fenced code."""
    text = F.array_join(fenced_out(F.split("body", "\n")), "\n")
    section = F.regexp_extract(text, "(?s)(?:^|\n)## Viewpoints\n(.*?)(?:\n## |$)", 1)
    return marked(spark, sf_dir).select("doc_id", F.regexp_count(section, F.lit("\\[\\[[^\\]]+\\]\\]")).cast("long").alias("n"))


@query("str_24_rewrite_links", "SELECT doc_id, md5('see [[wiki/d' || doc_id || '|x]] and [[unknown]] and [[wiki/' || lang || ']]') AS hash FROM documents")
def rewrite_links(spark, sf_dir) -> DataFrame:
    """Known targets are qualified, aliases kept, unknown ones left: the known targets are the page's own and its language."""
    body = F.concat(F.lit("see [[d"), "doc_id", F.lit("|x]] and [[unknown]] and [["), "lang", F.lit("]]"))
    known = F.array(F.concat(F.lit("d"), "doc_id"), F.col("lang"))
    out = F.aggregate(known, body, lambda b, t: F.replace(F.replace(b, F.concat(F.lit("[["), t, F.lit("]]")), F.concat(F.lit("[[wiki/"), t, F.lit("]]"))), F.concat(F.lit("[["), t, F.lit("|")), F.concat(F.lit("[[wiki/"), t, F.lit("|"))))
    return read(spark, sf_dir, "documents").select("doc_id", F.md5(out).alias("hash"))


@query("str_25_materialize_relations", SQL + ", e AS (SELECT source_id, string_agg('- ' || type || ': [[' || target_id || ']]', chr(10) ORDER BY type, target_id) AS l FROM edges GROUP BY source_id) SELECT id, md5(regexp_replace(title, '\\s+$', '') || chr(10) || chr(10) || '## Related pages' || chr(10) || chr(10) || l || chr(10)) AS hash FROM wiki JOIN e ON source_id = id")
def materialize_relations(spark, sf_dir) -> DataFrame:
    """A section of relations at a page's end; an older one is replaced, so that doing it twice changes nothing."""
    e = edges(spark, sf_dir).groupBy("source_id").agg(F.array_sort(F.collect_list(F.struct("type", "target_id"))).alias("r"))
    lines = F.array_join(F.transform("r", lambda x: F.concat(F.lit("- "), x["type"], F.lit(": [["), x["target_id"], F.lit("]]"))), "\n")
    section = lambda body: F.concat(F.regexp_replace(F.split(body, "\n## Related pages\n")[0], "\\s+$", ""), F.lit("\n\n## Related pages\n\n"), lines, F.lit("\n"))
    p = wiki(spark, sf_dir).join(e, F.col("id") == F.col("source_id"))
    once = p.withColumn("body", section(F.col("title")))
    return once.select("id", F.md5(section(F.col("body"))).alias("hash"))


@query("str_11_valid_citations", "SELECT conv_id, turn, array_to_string(CASE WHEN turn <= 5 THEN [1, turn] ELSE [1] END, ',') AS valid FROM conversations WHERE turn > 1")
def valid_citations(spark, sf_dir) -> DataFrame:
    """Cited numbers within the context of five passages."""
    text = F.concat(F.lit("a [1] b ["), "turn", F.lit("] c [0] d [99]"))
    valid = F.filter(T.citations(text), lambda n: n.between(1, 5))
    return read(spark, sf_dir, "conversations").where("turn > 1").select("conv_id", "turn", F.array_join(valid.cast("array<string>"), ",").alias("valid"))


QUESTIONS = "CASE event_type WHEN 'click' THEN 'factoid' WHEN 'view' THEN 'explanatory' WHEN 'error' THEN 'procedural' WHEN 'purchase' THEN 'decision_context' ELSE 'other' END"


@query("str_16_memory_types", f"SELECT event_id, CASE {QUESTIONS} " + " ".join(f"WHEN '{k}' THEN '{v}'" for k, v in MEMORIES.items()) + " ELSE 'semantic' END AS memories FROM events")
def memory_types(spark, sf_dir) -> DataFrame:
    """Where to look for each kind of question."""
    lookup = F.create_map(*(F.lit(x) for p in MEMORIES.items() for x in p))
    return read(spark, sf_dir, "events").select("event_id", F.coalesce(F.element_at(lookup, F.expr(QUESTIONS)), F.lit("semantic")).alias("memories"))


@query("flt_18_matches_type", "SELECT doc_id, " + ", ".join(f"regexp_matches(lower(concat(source, ' ', text)), '{'|'.join(v)}') AS {k}" for k, v in KEYWORDS.items()) + " FROM documents")
def matches_type(spark, sf_dir) -> DataFrame:
    """Which memory types a result's words speak of."""
    text = F.lower(F.concat_ws(" ", "source", "text"))
    return read(spark, sf_dir, "documents").select("doc_id", *(F.exists(F.array(*map(F.lit, v)), lambda w: text.contains(w)).alias(k) for k, v in KEYWORDS.items()))


def tag_prefix(tag) -> Column:
    return F.split(tag, "/")[0]


@query("flt_08_known_prefix", "SELECT o_orderkey, tag, split_part(tag, '/', 1) IN ('language', 'src', 'status') AND contains(tag, '/') AS valid FROM (SELECT o_orderkey, unnest(['status/' || o_orderstatus, 'priority/' || o_orderpriority, o_orderstatus]) AS tag FROM orders)")
def known_prefix(spark, sf_dir) -> DataFrame:
    """Whether a tag begins with a known prefix and a slash."""
    t = order_tags(spark, sf_dir)
    return t.select("o_orderkey", "tag", (tag_prefix("tag").isin(*TAGS) & F.col("tag").contains("/")).alias("valid"))


def order_tags(spark, sf_dir) -> DataFrame:
    tags = F.array(F.concat(F.lit("status/"), "o_orderstatus"), F.concat(F.lit("priority/"), "o_orderpriority"), F.col("o_orderstatus"))
    return read(spark, sf_dir, "orders").select("o_orderkey", F.explode(tags).alias("tag"))


@query("flt_09_known_value", "SELECT doc_id, tag, CASE split_part(tag, '/', 1) WHEN 'src' THEN true WHEN 'language' THEN split_part(tag, '/', 2) IN ('en', 'de', 'fr', 'es') ELSE false END AS valid FROM (SELECT doc_id, unnest(['language/' || lang, 'src/' || source, 'mood/' || lang]) AS tag FROM documents) WHERE tag IS NOT NULL")
def known_value(spark, sf_dir) -> DataFrame:
    """A known prefix, and a value of its vocabulary if it has one."""
    d = read(spark, sf_dir, "documents").select("doc_id", F.explode(F.array(F.concat(F.lit("language/"), "lang"), F.concat(F.lit("src/"), "source"), F.concat(F.lit("mood/"), "lang"))).alias("tag")).where("tag is not null")
    value, ok = F.split("tag", "/")[1], F.lit(False)
    for prefix, words in TAGS.items():
        ok = F.when(tag_prefix("tag") == prefix, value.isin(*words) if words else F.lit(True)).otherwise(ok)
    return d.select("doc_id", "tag", ok.alias("valid"))


@query("flt_13_auto_tag", "WITH c AS (SELECT DISTINCT source FROM documents WHERE regexp_matches(text, '(?i)^the')) SELECT doc_id, CASE WHEN c.source IS NOT NULL THEN lang || ',ugc' ELSE lang END AS tags FROM documents d LEFT JOIN c ON c.source = d.source || ''")
def auto_tag(spark, sf_dir) -> DataFrame:
    """Pages of carrier sources get a tag, once."""
    d = read(spark, sf_dir, "documents")
    carriers = d.where(F.col("text").rlike("(?i)^the")).select(F.col("source").alias("s")).distinct()
    tags = F.when(F.col("lang").isNotNull(), F.array_join(F.array_union(F.array("lang"), F.when(F.col("s").isNotNull(), F.array(F.lit("ugc"))).otherwise(F.array().cast("array<string>"))), ","))
    return d.join(carriers, d["source"] == F.col("s"), "left").select("doc_id", tags.alias("tags"))


@query("flt_17_permission", "SELECT page_id, role, CASE role WHEN 'orchestrator' THEN true WHEN 'collector' THEN starts_with(url, 'http') ELSE regexp_matches(url, '^https?://[^/]+/(en|fr)/') END AS allowed FROM (SELECT page_id, url, unnest(['orchestrator', 'collector', 'writer']) AS role FROM pages)")
def permission(spark, sf_dir) -> DataFrame:
    """The orchestrator may read all, the collector addresses, others the folders allowed to them."""
    p = read(spark, sf_dir, "pages").select("page_id", "url", F.explode(F.array(*map(F.lit, ("orchestrator", "collector", "writer")))).alias("role"))
    path = F.regexp_replace("url", "^https?://[^/]+", "")
    ok = F.when(F.col("role") == "orchestrator", True).when(F.col("role") == "collector", F.col("url").startswith("http")).otherwise(F.exists(F.array(F.lit("/en/"), F.lit("/fr/")), lambda a: path.startswith(a)))
    return p.select("page_id", "role", ok.alias("allowed"))


@query("str_32_source_path", "SELECT page_id, regexp_replace(regexp_replace(replace(regexp_replace(url, '^https?://', '/srv/project/'), '/', chr(92)), '\\\\', '/', 'g'), '^/srv/project/', '') AS path FROM pages")
def source_path(spark, sf_dir) -> DataFrame:
    """Paths within the project, with forward slashes."""
    raw = F.replace(F.regexp_replace("url", "^https?://", "/srv/project/"), F.lit("/"), F.lit("\\"))
    return read(spark, sf_dir, "pages").select("page_id", F.regexp_replace(F.replace(raw, F.lit("\\"), F.lit("/")), "^/srv/project/", "").alias("path"))


@query("str_31_slug_importance", SQL + ", t AS (SELECT target_id AS slug, count(*) AS links FROM edges WHERE target_id NOT IN (SELECT id FROM wiki) GROUP BY target_id) SELECT slug, 3 * links AS score, CASE WHEN 3 * links >= 3 THEN 'HIGH' WHEN 3 * links >= 1 THEN 'MEDIUM' ELSE 'LOW' END AS importance FROM t")
def slug_importance(spark, sf_dir) -> DataFrame:
    """Missing pages by the links to them: three a link."""
    e, p = edges(spark, sf_dir), wiki(spark, sf_dir)
    t = e.join(p, e["target_id"] == p["id"], "left_anti").groupBy(F.col("target_id").alias("slug")).agg((3 * F.count("*")).alias("score"))
    return t.select("slug", "score", F.when(F.col("score") >= 3, "HIGH").when(F.col("score") >= 1, "MEDIUM").otherwise("LOW").alias("importance"))


HEADINGS = {"overview": "intro", "summary": "intro", "example": "examples", "examples": "examples", "references": "sources"}


@query("str_30_heading_bucket", "SELECT doc_id, CASE WHEN lang IS NULL OR trim(lang) = '' THEN 'preface' WHEN lang = 'en' THEN 'intro' WHEN lang = 'de' THEN 'examples' ELSE 'other' END AS bucket FROM documents")
def heading_bucket(spark, sf_dir) -> DataFrame:
    """Headings by bucket; none is the preface, unknown ones are others."""
    heading = F.when(F.col("lang") == "en", " Overview").when(F.col("lang") == "de", "EXAMPLES ").otherwise(F.col("lang"))
    lookup = F.create_map(*(F.lit(x) for p in HEADINGS.items() for x in p))
    bucket = F.when(heading.isNull() | (F.trim(heading) == ""), "preface").otherwise(F.coalesce(F.element_at(lookup, F.lower(F.trim(heading))), F.lit("other")))
    return read(spark, sf_dir, "documents").select("doc_id", bucket.alias("bucket"))


def contradict(a, b) -> Column:
    """One says the one, the other its opposite (in this direction)."""
    return F.exists(F.array(*(F.struct(F.lit(x).alias("x"), F.lit(y).alias("y")) for x, y in OPPOSITES)), lambda p: F.lower(a).contains(p["x"]) & F.lower(b).contains(p["y"]))


FOLLOWING = SQL + ", f AS (SELECT entity, ordinal, statement AS a, lead(statement) OVER (PARTITION BY entity ORDER BY ordinal) AS b FROM claims)"
CONTRADICT_SQL = "(" + " OR ".join(f"(contains(lower(a), '{x}') AND contains(lower(b), '{y}'))" for x, y in OPPOSITES) + ")"


def following(spark, sf_dir) -> DataFrame:
    from pyspark.sql import Window as W

    w = W.partitionBy("entity").orderBy("ordinal")
    return claims(spark, sf_dir).select("entity", "ordinal", F.col("statement").alias("a"), F.lead("statement").over(w).alias("b"))


@query("cnf_03_contradict", FOLLOWING + f" SELECT entity, ordinal, {CONTRADICT_SQL} AS contradicts FROM f WHERE b IS NOT NULL")
def contradicting(spark, sf_dir) -> DataFrame:
    return following(spark, sf_dir).where("b is not null").select("entity", "ordinal", contradict(F.col("a"), F.col("b")).alias("contradicts"))


TOK = "list_distinct(regexp_extract_all(lower({}), '[a-z0-9]+'))"


@query("cnf_04_support", FOLLOWING + f", g AS (SELECT *, len(list_intersect({TOK.format('a')}, {TOK.format('b')})) AS common, len({TOK.format('b')}) AS n FROM f WHERE b IS NOT NULL) SELECT entity, ordinal, CASE WHEN common = 0 THEN 'insufficient' WHEN {CONTRADICT_SQL} THEN 'contradicts' WHEN common < 0.1 * n THEN 'irrelevant' ELSE 'supports' END AS support, CASE WHEN common = 0 THEN 1.0 WHEN {CONTRADICT_SQL} THEN 0.85 WHEN common < 0.1 * n THEN 0.7 ELSE 0.8 END::DOUBLE AS confidence FROM g")
def support(spark, sf_dir) -> DataFrame:
    """Whether a quote (a statement) supports a claim (the next one): words in common, then opposites, then relevance."""
    words = lambda c: F.array_distinct(F.regexp_extract_all(F.lower(c), F.lit("([a-z0-9]+)")))
    f = following(spark, sf_dir).where("b is not null").withColumns({"common": F.size(F.array_intersect(words(F.col("a")), words(F.col("b")))), "n": F.size(words(F.col("b")))})
    kind = F.when(F.col("common") == 0, "insufficient").when(contradict(F.col("a"), F.col("b")), "contradicts").when(F.col("common") < 0.1 * F.col("n"), "irrelevant").otherwise("supports")
    sure = F.when(kind == "insufficient", 1.0).when(kind == "contradicts", 0.85).when(kind == "irrelevant", 0.7).otherwise(0.8)
    return f.select("entity", "ordinal", kind.alias("support"), sure.alias("confidence"))


@query("cnf_05_verify_claim", "SELECT c.conv_id, c.turn, CASE WHEN c.text IS NULL OR c.text = '' THEN 'no_text' WHEN d.doc_id IS NULL THEN 'no_document' WHEN NOT contains(d.text, substr(d.text, 1, 20)) THEN 'unverified' ELSE 'verified' END AS state FROM conversations c LEFT JOIN documents d ON d.doc_id = c.turn * 7")
def verify_claim(spark, sf_dir) -> DataFrame:
    """A claim needs a text, its document, and evidence that stands in it."""
    c = read(spark, sf_dir, "conversations").select("conv_id", "turn", F.col("text").alias("claim"), (F.col("turn") * 7).cast("long").alias("of"))
    d = read(spark, sf_dir, "documents").select("doc_id", "text")
    state = F.when(F.col("claim").isNull() | (F.col("claim") == ""), "no_text").when(F.col("doc_id").isNull(), "no_document").when(~F.col("text").contains(F.substring("text", 1, 20)), "unverified").otherwise("verified")
    return c.join(d, F.col("of") == F.col("doc_id"), "left").select("conv_id", "turn", state.alias("state"))


@query("cnf_07_bind_candidates", "WITH b AS (SELECT doc_id, unnest(string_split(text, chr(10))) AS block, generate_subscripts(string_split(text, chr(10)), 1) - 1 AS k FROM documents), q AS (SELECT doc_id, k, CASE WHEN k % 3 = 2 THEN 'zz ' || substr(block, 1, 30) ELSE substr(block, 1, 30) END AS quote, CASE WHEN k % 5 = 4 THEN k + 100000 ELSE k END AS at FROM b WHERE block <> '') SELECT q.doc_id, q.k, substr(sha256(q.doc_id || ':' || q.k || ':' || q.quote), 1, 16) AS claim_id, CASE WHEN b.k IS NULL THEN 'missing_block' WHEN NOT contains(b.block, q.quote) THEN 'quote_not_in_block' ELSE 'bound' END AS state FROM q LEFT JOIN b ON b.doc_id = q.doc_id AND b.k = q.at")
def bind_candidates(spark, sf_dir) -> DataFrame:
    """Evidence of candidates bound to declared blocks: the block is there and holds the quote."""
    b = read(spark, sf_dir, "documents").select("doc_id", F.posexplode(T.lines("text")).alias("k", "block"))
    head = F.substring("block", 1, 30)
    q = b.where("block <> ''").select("doc_id", "k", F.when(F.col("k") % 3 == 2, F.concat(F.lit("zz "), head)).otherwise(head).alias("quote"), F.when(F.col("k") % 5 == 4, F.col("k") + 100000).otherwise(F.col("k")).alias("at"))
    there = b.select(F.col("doc_id").alias("d"), F.col("k").alias("j"), "block")
    out = q.join(there, (F.col("d") == F.col("doc_id")) & (F.col("j") == F.col("at")), "left")
    state = F.when(F.col("j").isNull(), "missing_block").when(~F.col("block").contains(F.col("quote")), "quote_not_in_block").otherwise("bound")
    return out.select("doc_id", F.col("k").cast("long").alias("k"), F.substring(F.sha2(F.concat("doc_id", F.lit(":"), "k", F.lit(":"), "quote"), 256), 1, 16).alias("claim_id"), state.alias("state"))


@query("sup_15_surface_variants", "SELECT a.raw, b.raw AS canonical FROM (SELECT DISTINCT o_orderpriority AS raw FROM orders) a JOIN (SELECT DISTINCT replace(lower(o_orderpriority), '-', ' ') AS raw FROM orders UNION SELECT DISTINCT p_type FROM part) b ON regexp_replace(lower(a.raw), '[^a-z0-9]', '', 'g') = regexp_replace(lower(b.raw), '[^a-z0-9]', '', 'g') AND a.raw <> b.raw")
def surface_variants(spark, sf_dir) -> DataFrame:
    """Names that are equal but for marks and case, and yet written otherwise; each name once on either side."""
    key = lambda c: F.regexp_replace(F.lower(c), "[^a-z0-9]", "")
    names = read(spark, sf_dir, "orders").select(F.col("o_orderpriority").alias("raw")).distinct()
    others = names.select(F.replace(F.lower("raw"), F.lit("-"), F.lit(" ")).alias("canonical")).union(read(spark, sf_dir, "part").select("p_type")).distinct()
    return names.join(others, (key("raw") == key("canonical")) & (F.col("raw") != F.col("canonical"))).select("raw", "canonical")


@query("sup_22_iso_to_ms", "SELECT event_id, epoch_us(ts) // 1000 AS ms FROM events")
def iso_to_ms(spark, sf_dir) -> DataFrame:
    """ISO text to unix milliseconds."""
    iso = F.date_format("ts", "yyyy-MM-dd'T'HH:mm:ss.SSSSSS'Z'")
    return read(spark, sf_dir, "events").select("event_id", F.unix_millis(F.try_to_timestamp(iso)).alias("ms"))


@query("sup_23_suspicious", "SELECT doc_id FROM documents WHERE length(text) >= 200 AND len(regexp_extract_all(text, '[一-鿿]')) < 0.25 * length(text)")
def suspicious(spark, sf_dir) -> DataFrame:
    """Long texts with little Chinese in a collection that should be Chinese."""
    return read(spark, sf_dir, "documents").where((F.length("text") >= 200) & (F.regexp_count("text", F.lit("[\\u4e00-\\u9fff]")) < 0.25 * F.length("text"))).select("doc_id")


#: Pages as files with front matter; some have none, lack a field, or have it twice.
FILES = "concat(CASE WHEN doc_id % 7 = 0 THEN '' ELSE concat('---', chr(10), 'id: ', CASE WHEN doc_id % 5 = 0 THEN 'x' ELSE concat('doc-', doc_id) END, chr(10), CASE WHEN doc_id % 4 = 0 THEN '' ELSE concat('title: t', chr(10)) END, 'type: ', CASE WHEN doc_id % 6 = 0 THEN 'odd' ELSE 'concept' END, chr(10), '---', chr(10)) END, CASE WHEN doc_id % 3 = 0 THEN concat('# note', chr(10), '---', chr(10)) ELSE concat('body', chr(10), '---', chr(10)) END)"


@query("sup_19_duplicate_frontmatter", "SELECT doc_id, doc_id % 7 <> 0 AND doc_id % 3 = 0 AS twice FROM documents")
def duplicate_frontmatter(spark, sf_dir) -> DataFrame:
    """A second fence within five lines of the first front matter, after blank lines or comments only."""
    return read(spark, sf_dir, "documents").select("doc_id", F.expr(FILES).rlike("^---\\n(?:(?!---\\n).*\\n)*?---\\n(?:(?:[ \\t]*|#.*)\\n){0,4}---[ \\t]*(?:\\n|$)").alias("twice"))


@query("sup_20_validate_page", "SELECT doc_id, unnest(list_filter([CASE WHEN doc_id % 7 = 0 THEN 'V4001' END, CASE WHEN doc_id % 7 <> 0 AND doc_id % 4 = 0 THEN 'V4010' END, CASE WHEN doc_id % 7 <> 0 AND doc_id % 5 = 0 THEN 'V4011' END, CASE WHEN doc_id % 7 <> 0 AND doc_id % 6 = 0 THEN 'V4012' END], lambda x: x IS NOT NULL)) AS code FROM documents")
def validate_page(spark, sf_dir) -> DataFrame:
    """Codes of what a page's front matter lacks: itself, a required field, its file's name, a known type."""
    f = read(spark, sf_dir, "documents").select("doc_id", F.regexp_extract(F.expr(FILES), "(?s)^---\n(.*?)\n---", 1).alias("fm"), F.concat(F.lit("doc-"), "doc_id").alias("name"))
    field = lambda k: F.regexp_extract("fm", f"(?m)^{k}: (.*)$", 1)
    has = F.col("fm") != ""
    codes = F.array(F.when(~has, "V4001"), F.when(has & ((field("title") == "") | (field("id") == "")), "V4010"), F.when(has & (field("id") != F.col("name")), "V4011"), F.when(has & ~field("type").isin("source", "entity", "concept", "synthesis"), "V4012"))
    return f.select("doc_id", F.explode(F.array_compact(codes)).alias("code"))


@query("sup_47_aggregate_chapter", "SELECT doc_id, bucket, count(*) AS n, min(k) AS first FROM (SELECT doc_id, generate_subscripts(string_split(text, chr(10)), 1) - 1 AS k, CASE WHEN regexp_matches(unnest(string_split(text, chr(10))), '^#') THEN 'heading' ELSE 'body' END AS bucket FROM documents) GROUP BY doc_id, bucket")
def aggregate_chapter(spark, sf_dir) -> DataFrame:
    """The blocks of a chapter by bucket, with each bucket's first."""
    b = read(spark, sf_dir, "documents").select("doc_id", F.posexplode(T.lines("text")).alias("k", "line"))
    return b.groupBy("doc_id", F.when(F.col("line").startswith("#"), "heading").otherwise("body").alias("bucket")).agg(F.count("*").alias("n"), F.min("k").cast("long").alias("first"))


@query("sup_11_stub_edges", SQL + "SELECT source_id, target_id, type FROM edges WHERE target_id IN (SELECT id FROM wiki WHERE length(body) < 200)")
def stub_edges(spark, sf_dir) -> DataFrame:
    """Edges that lead to short pages."""
    stubs = wiki(spark, sf_dir).where(F.length("body") < 200).select(F.col("id").alias("target_id"))
    return edges(spark, sf_dir).join(stubs, "target_id", "left_semi").select("source_id", "target_id", "type")


@query("sup_16_broken_references", SQL + "SELECT target_id AS target, count(*) AS n, min(source_id) AS first FROM edges WHERE target_id NOT IN (SELECT id FROM wiki) GROUP BY target_id")
def broken_references(spark, sf_dir) -> DataFrame:
    e, p = edges(spark, sf_dir), wiki(spark, sf_dir)
    return e.join(p, e["target_id"] == p["id"], "left_anti").groupBy(F.col("target_id").alias("target")).agg(F.count("*").alias("n"), F.min("source_id").alias("first"))


@query("sup_05_estimate_costs", SQL + "SELECT type, count(*) AS pages, round(count(*) * 0.002, 6) AS low, round(count(*) * 0.01, 6) AS high FROM wiki GROUP BY type")
def estimate_costs(spark, sf_dir) -> DataFrame:
    """Cost scenarios from the number of pages of each type."""
    return wiki(spark, sf_dir).groupBy("type").agg(F.count("*").alias("pages"), F.round(F.count("*") * 0.002, 6).alias("low"), F.round(F.count("*") * 0.01, 6).alias("high"))


@query("sup_07_reingest_backlog", "SELECT doc_id, (row_number() OVER (PARTITION BY source ORDER BY doc_id) - 1) // 10 AS batch FROM (SELECT d.doc_id, d.source FROM (SELECT min(doc_id) AS doc_id FROM documents WHERE n_chars BETWEEN 50 AND 8000 GROUP BY md5(regexp_replace(text, '[ \\t\\n\\r]+', '', 'g'))) f JOIN documents d USING (doc_id) WHERE d.doc_id NOT IN (SELECT doc_id FROM labels))")
def reingest_backlog(spark, sf_dir) -> DataFrame:
    """Sources that nothing refers to, one of each fingerprint, neither tiny nor long, in batches of ten by source."""
    from pyspark.sql import Window as W

    d = read(spark, sf_dir, "documents")
    first = d.where(F.col("n_chars").between(50, 8000)).groupBy(T.fingerprint("text").alias("f")).agg(F.min_by(F.struct("doc_id", "source"), "doc_id").alias("d")).select("d.*")
    left = first.join(read(spark, sf_dir, "labels").select("doc_id"), "doc_id", "left_anti")
    return left.select("doc_id", F.floor((F.row_number().over(W.partitionBy("source").orderBy("doc_id")) - 1) / 10).cast("long").alias("batch"))


