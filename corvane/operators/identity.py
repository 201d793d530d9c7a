"""Identity keys, hashes, JSON repair, slug importance and other rules on identifiers and text."""

from __future__ import annotations

import json
import re

import pandas as pd
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F
from pyspark.sql.types import StringType

from corvane.plans.registry import query
from corvane.sources.tables import read


@F.pandas_udf(StringType())
def compatible(s: pd.Series) -> pd.Series:
    """Unicode normal form KC."""
    return s.str.normalize("NFKC")


def plain(value) -> Column:
    """A field as identity keys take it: compatible characters, single spaces, trimmed, lower case; null is empty."""
    return F.lower(F.trim(F.regexp_replace(compatible(F.coalesce(value.cast("string"), F.lit(""))), "\\s+", " ")))


def canonical_json(fields: dict[str, Column]) -> Column:
    """JSON with sorted keys and without spaces; null is null."""
    quoted = lambda c: F.concat(F.lit('"'), F.replace(F.replace(c, F.lit("\\"), F.lit("\\\\")), F.lit('"'), F.lit('\\"')), F.lit('"'))
    parts = [F.concat(F.lit(f'"{k}":'), F.coalesce(quoted(v.cast("string")), F.lit("null"))) for k, v in sorted(fields.items())]
    return F.concat(F.lit("{"), F.concat_ws(",", *parts), F.lit("}"))


def id_v1(fields: dict[str, Column]) -> Column:
    return F.concat(F.lit("id-v1:"), F.sha2(canonical_json({k: plain(v) for k, v in fields.items()}), 256))


#: The fields that make each kind of object what it is (fixed values).
IDENTITY = {
    "source": ("source_type", "canonical_locator"),
    "raw_source": ("raw_bytes_hash",),
    "canonical_document": ("raw_source_id", "parser_name", "parser_version", "correction_of"),
    "concept": ("concept_type", "canonical_name", "identity_scope_id"),
    "knowledge_unit": ("concept_id", "question", "unit_type", "knowledge_mode", "context_id", "validity_id"),
    "claim": ("subject", "predicate", "object", "text", "knowledge_mode", "context_id", "validity_id"),
    "evidence": ("document_id", "block_id", "source_span", "source_hash"),
    "context": ("domain", "platform", "audience", "geography", "language", "goal", "conditions", "perspective", "policy_version"),
    "validity": ("valid_from", "valid_to", "derivation_policy_version"),
    "synthesis": ("output_claim_id", "derived_from", "method", "model", "model_version", "prompt_version"),
    "relation": ("relation_type", "from_ref", "to_ref", "context_id", "validity_id"),
    "conflict": ("statement_a_ref", "statement_b_ref", "context_a_id", "context_b_id"),
}


def identity_key(kind, fields) -> Column:
    """The key of an object: kind names its type, fields is a map of its values. References of a conflict are sorted."""
    get = lambda name: F.element_at(fields, F.lit(name))
    out = F.concat(F.lit("unsupported:"), F.coalesce(kind, F.lit("")))
    for name, names in IDENTITY.items():
        values = {n: get(n) for n in names}
        if name == "conflict":
            both = F.array_sort(F.array(*(F.coalesce(get(n), F.lit("")) for n in names[:2])))
            values |= {names[0]: F.get(both, F.lit(0)), names[1]: F.get(both, F.lit(1))}
        out = F.when(kind == name, id_v1(values)).otherwise(out)
    return out


def _plain_sql(x: str) -> str:
    return f"lower(trim(regexp_replace(coalesce({x}::VARCHAR, ''), '\\s+', ' ', 'g')))"


def _key_sql(fields: dict[str, str], clean=_plain_sql) -> str:
    return "'id-v1:' || sha256('{' || " + " || ',' || ".join(f"'\"{k}\":\"' || {clean(v)} || '\"'" for k, v in sorted(fields.items())) + " || '}')"


SOURCE_KEY = _key_sql({"source_type": "c_mktsegment", "canonical_locator": "c_name"})
CONFLICT_KEY = _key_sql({"statement_a_ref": "least(o_orderpriority, o_orderstatus)", "statement_b_ref": "greatest(o_orderpriority, o_orderstatus)", "context_a_id": "o_custkey", "context_b_id": "NULL"})
RELATION_KEY = _key_sql({"relation_type": "'in'", "from_ref": "n_name", "to_ref": "n_regionkey", "context_id": "NULL", "validity_id": "NULL"})


@query("fn_03_identity_key", f"SELECT 'c' || c_custkey AS id, {SOURCE_KEY} AS identity_key FROM customer UNION ALL SELECT 'o' || o_orderkey, {CONFLICT_KEY} FROM orders UNION ALL SELECT 'n' || n_nationkey, {RELATION_KEY} FROM nation UNION ALL SELECT 's' || s_suppkey, 'unsupported:supplier' FROM supplier")
def identity_keys(spark, sf_dir) -> DataFrame:
    text = lambda c: F.col(c).cast("string")
    sources = read(spark, sf_dir, "customer").select(F.concat(F.lit("c"), "c_custkey").alias("id"), F.lit("source").alias("kind"), F.create_map(F.lit("source_type"), text("c_mktsegment"), F.lit("canonical_locator"), text("c_name")).alias("fields"))
    conflicts = read(spark, sf_dir, "orders").select(F.concat(F.lit("o"), "o_orderkey"), F.lit("conflict"), F.create_map(F.lit("statement_b_ref"), text("o_orderpriority"), F.lit("statement_a_ref"), text("o_orderstatus"), F.lit("context_a_id"), text("o_custkey")))
    relations = read(spark, sf_dir, "nation").select(F.concat(F.lit("n"), "n_nationkey"), F.lit("relation"), F.create_map(F.lit("relation_type"), F.lit("in"), F.lit("from_ref"), text("n_name"), F.lit("to_ref"), text("n_regionkey")))
    others = read(spark, sf_dir, "supplier").select(F.concat(F.lit("s"), "s_suppkey"), F.lit("supplier"), F.create_map(F.lit("name"), text("s_name")))
    every = sources.union(conflicts).union(relations).union(others)
    return every.select("id", identity_key(F.col("kind"), F.col("fields")).alias("identity_key"))


@query("fn_04_operation_id", "SELECT event_id, " + _key_sql({"operation": "event_type", "object_type": "'user'", "identity_key": "user_id", "input_hash": "sha256(props)"}) + " AS operation_id FROM events")
def operation_ids(spark, sf_dir) -> DataFrame:
    """The same operation on the same input has the same identifier in every run."""
    return read(spark, sf_dir, "events").select("event_id", id_v1({"operation": F.col("event_type"), "object_type": F.lit("user"), "identity_key": F.col("user_id"), "input_hash": F.sha2("props", 256)}).alias("operation_id"))


@query("fn_05_validate_identity", f"SELECT c_custkey, CASE WHEN c_acctbal < 0 THEN 'identity_key_field_missing' WHEN c_nationkey < 5 THEN 'identity_key_mismatch' END AS reason, c_acctbal >= 0 AND c_nationkey >= 5 AS passed, {SOURCE_KEY} AS expected FROM customer")
def validate_identity(spark, sf_dir) -> DataFrame:
    """Stored keys against expected ones; keys of some customers are missing, of some made from other fields."""
    c = read(spark, sf_dir, "customer")
    expected = id_v1({"source_type": F.col("c_mktsegment"), "canonical_locator": F.col("c_name")})
    stored = F.when(F.col("c_acctbal") >= 0, F.when(F.col("c_nationkey") < 5, id_v1({"source_type": F.col("c_name")})).otherwise(expected))
    c = c.select("c_custkey", expected.alias("expected"), stored.alias("stored"))
    reason = F.when(F.col("stored").isNull(), "identity_key_field_missing").when(F.col("stored") != F.col("expected"), "identity_key_mismatch")
    return c.select("c_custkey", reason.alias("reason"), F.col("stored").eqNullSafe(F.col("expected")).alias("passed"), "expected")


@query("fn_06_unit_identity", "SELECT conv_id, turn, " + _key_sql({"concept_id": "conv_id", "question": "role || ' ?  ' || turn", "unit_type": "role", "knowledge_mode": "'Observed'", "context_id": "NULL", "validity_id": "turn"}) + " AS identity_key FROM conversations")
def unit_identity(spark, sf_dir) -> DataFrame:
    fields = {"concept_id": F.col("conv_id"), "question": F.concat("role", F.lit(" ?  "), "turn"), "unit_type": F.col("role"), "knowledge_mode": F.lit("Observed"), "context_id": F.lit(None), "validity_id": F.col("turn")}
    return read(spark, sf_dir, "conversations").select("conv_id", "turn", id_v1(fields).alias("identity_key"))


@query("fn_07_fact_identity", "SELECT p_partkey, 'id-v1:' || sha256('{\"context_id\":null,\"field\":\"size\",\"subject\":\"' || p_name || '\",\"validity_id\":null,\"value\":\"' || p_size || '\",\"value_type\":\"int\"}') AS identity_key FROM part")
def fact_identity(spark, sf_dir) -> DataFrame:
    """Raw typed fields, not cleaned."""
    fields = {"subject": F.col("p_name"), "field": F.lit("size"), "value": F.col("p_size"), "value_type": F.lit("int"), "context_id": F.lit(None), "validity_id": F.lit(None)}
    return read(spark, sf_dir, "part").select("p_partkey", F.concat(F.lit("id-v1:"), F.sha2(canonical_json(fields), 256)).alias("identity_key"))


@query("fn_01_payload_hash", "SELECT event_id, sha256('{\"props\":\"' || replace(props, '\"', '\\\"') || '\",\"type\":\"' || event_type || '\",\"user\":\"' || user_id || '\"}') AS payload_hash FROM events")
def payload_hash(spark, sf_dir) -> DataFrame:
    fields = {"user": F.col("user_id"), "type": F.col("event_type"), "props": F.col("props")}
    return read(spark, sf_dir, "events").select("event_id", F.sha2(canonical_json(fields), 256).alias("payload_hash"))


@query("sup_43_canonical_digest", "SELECT s_suppkey, sha256('{\"nation\":\"' || s_nationkey || '\",\"title\":\"' || s_name || '\"}') AS digest FROM supplier")
def canonical_digest(spark, sf_dir) -> DataFrame:
    """The digest of a manifest without its own digest fields."""
    row = {"title": F.col("s_name"), "nation": F.col("s_nationkey"), "digest": F.lit("old"), "snapshot_digest": F.lit("old")}
    return read(spark, sf_dir, "supplier").select("s_suppkey", F.sha2(canonical_json({k: v for k, v in row.items() if not k.endswith("digest")}), 256).alias("digest"))


@query("str_22_normalize_value", "SELECT conv_id, turn, " + _plain_sql("' ' || role || chr(9) || ' ' || turn") + " AS value FROM conversations")
def normalize_value(spark, sf_dir) -> DataFrame:
    return read(spark, sf_dir, "conversations").select("conv_id", "turn", plain(F.concat(F.lit(" "), "role", F.lit("\t "), "turn")).alias("value"))


def mended(text: str) -> tuple[str, bool, str | None]:
    """(status, truncated, JSON): what a model's answer holds once fences, comments, trailing commas and open ends are mended.

    One scan keeps a stack of what is open; strings are copied, and what is still open at the end is closed.
    """
    body = re.sub(r"^\s*```[a-z]*\s*|\s*```\s*$", "", text or "")
    start = min((k for k in (body.find("{"), body.find("[")) if k >= 0), default=-1)
    if start < 0:
        return "no_json", False, None
    body = body[start:]
    try:
        value, end = json.JSONDecoder().raw_decode(body)
        return "valid", False, json.dumps(value, sort_keys=True, ensure_ascii=False, separators=(",", ":"))
    except ValueError:
        pass
    out, stack, at, quoted = [], [], 0, False
    while at < len(body):
        c = body[at]
        if quoted:
            out.append({"\n": "\\n", "\t": "\\t", "\r": "\\r"}.get(c, c))
            if c == "\\" and at + 1 < len(body):
                at += 1
                out.append(body[at])
            elif c == '"':
                quoted = False
        elif c == '"':
            quoted = True
            out.append(c)
        elif c in "{[":
            stack.append("}" if c == "{" else "]")
            out.append(c)
        elif c in "}]":
            if stack:
                out.append(stack.pop())
            if not stack:
                break
        else:
            out.append(c)
        at += 1
    cut = bool(stack) or quoted
    whole = "".join(out) + ('"' if quoted else "")
    for _ in range(4):
        tidy = re.sub(r",\s*(?=[}\]])", "", whole + "".join(reversed(stack)))
        try:
            return "repaired", cut, json.dumps(json.loads(tidy), sort_keys=True, ensure_ascii=False, separators=(",", ":"))
        except ValueError:  # an entry that was cut off goes
            shorter = re.sub(r'(,\s*)?("(?:[^"\\]|\\.)*"\s*)?:?\s*[^,\[\]{}:"]*$', "", whole.rstrip())
            if shorter == whole:
                break
            whole = shorter
    return "broken", cut, None


def read_answers(batches):
    """mended() over Arrow batches of (event_id, answer)."""
    for b in batches:
        found = [mended(x) for x in b["answer"]]
        yield pd.DataFrame({"event_id": b["event_id"], "status": [f[0] for f in found], "truncated": [f[1] for f in found], "json": [f[2] for f in found]})


@query(
    "str_26_parse_answer",
    "SELECT event_id, CASE event_id % 5 WHEN 0 THEN 'valid' WHEN 4 THEN 'no_json' ELSE 'repaired' END AS status, event_id % 5 = 3 AS truncated, CASE event_id % 5 WHEN 4 THEN NULL WHEN 3 THEN '{\"a\":[1,2],\"p\":' || replace(props, ' ', '') || '}' ELSE '{\"p\":' || replace(props, ' ', '') || '}' END AS json FROM events",
)
def parse_answer(spark, sf_dir) -> DataFrame:
    """Answers of a model: whole and fenced, with a trailing comma, with text around, cut off, or without JSON."""
    e, props = read(spark, sf_dir, "events"), F.col("props")
    whole = F.concat(F.lit('{"p": '), props, F.lit("}"))
    k = F.col("event_id") % 5
    text = F.when(k == 0, F.concat(F.lit("```json\n"), whole, F.lit("\n```"))).when(k == 1, F.concat(F.lit('{"p": '), props, F.lit(",}"))).when(k == 2, F.concat(F.lit('Sure: {"p": '), props, F.lit(", } done"))).when(k == 3, F.concat(F.lit('{"p": '), props, F.lit(', "a": [1, 2, '))).otherwise(F.lit("no answer"))
    return e.select("event_id", text.alias("answer")).mapInPandas(read_answers, "event_id long, status string, truncated boolean, json string")


@query("str_27_repair_json", "SELECT event_id, '{\"k\":' || regexp_extract(props, '[0-9]+') || ',\"list\":[1,{\"x\":\"y\"}]}' AS json FROM events")
def repair_json(spark, sf_dir) -> DataFrame:
    """Open strings, objects and lists are closed; trailing commas go."""
    cut = F.concat(F.regexp_replace("props", "\\}$", ""), F.lit(', "list": [1, {"x": "y'))
    return read(spark, sf_dir, "events").select("event_id", cut.alias("answer")).mapInPandas(read_answers, "event_id long, status string, truncated boolean, json string").select("event_id", "json")


# Rules as data ------------------------------------------------------------------------------------


def verdicts(rows: DataFrame, rules: list[tuple[str, str, str]], keep: list[str]) -> DataFrame:
    """verdict (block, warn, pass) and reasons by rules (condition, reason as SQL, weight: final, block or warn).

    A final rule stops at itself; otherwise every rule that holds gives its reason.
    """
    final = [(c, r) for c, r, w in rules if w == "final"]
    reason = lambda c, r: F.when(F.coalesce(F.expr(c), F.lit(False)), F.expr(r))
    stop = F.coalesce(*(reason(c, r) for c, r in final)) if final else F.lit(None).cast("string")
    given = lambda kinds: F.array_compact(F.array(F.lit(None).cast("string"), *(reason(c, r) for c, r, w in rules if w in kinds)))
    out = rows.withColumns({"_stop": stop, "_all": given(("block", "warn")), "_hard": given(("block",))})
    verdict = F.when(F.col("_stop").isNotNull() | (F.size("_hard") > 0), "block").when(F.size("_all") > 0, "warn").otherwise("pass")
    return out.select(*keep, verdict.alias("verdict"), F.coalesce("_stop", F.array_join("_all", ",")).alias("reasons"))


def verdicts_sql(rows: str, rules: list[tuple[str, str, str]], keep: str) -> str:
    """The same for DuckDB, of a table expression."""
    when = lambda c, r: f"CASE WHEN coalesce({c}, false) THEN {r} END"
    final = [when(c, r) for c, r, w in rules if w == "final"] or ["NULL"]
    soft = [when(c, r) for c, r, w in rules if w != "final"] or ["NULL"]
    hard = [f"coalesce({c}, false)" for c, _, w in rules if w == "block"] or ["false"]
    return f"SELECT {keep}, CASE WHEN stop IS NOT NULL OR hard THEN 'block' WHEN soft <> '' THEN 'warn' ELSE 'pass' END AS verdict, coalesce(stop, soft) AS reasons FROM (SELECT *, coalesce({', '.join(final)}, NULL) AS stop, {' OR '.join(hard)} AS hard, concat_ws(',', {', '.join(soft)}) AS soft FROM ({rows}))"


#: Knowledge units made of orders: modes, provenance, review, versions, questions, keys and states, some lacking.
UNITS = """SELECT o_orderkey AS id, o_custkey,
  CASE o_orderstatus WHEN 'F' THEN 'observed' WHEN 'O' THEN 'synthesized' ELSE CASE WHEN o_orderpriority = '5-LOW' THEN NULL WHEN o_orderpriority = '2-HIGH' THEN 'guessed' ELSE 'unknown' END END AS knowledge_mode,
  CASE WHEN o_totalprice > 50000 THEN o_custkey END AS derived_from, CASE WHEN o_orderpriority <> '1-URGENT' THEN o_orderpriority END AS synthesis_provenance,
  CASE WHEN year(o_orderdate) < 1998 THEN 'approved' ELSE 'pending' END AS review_status, year(o_orderdate) - 1993 AS version,
  CASE WHEN o_orderpriority = '3-MEDIUM' THEN ' ' WHEN o_totalprice > 10000 THEN o_orderpriority END AS question,
  CASE WHEN o_totalprice > 20000 THEN 'id-v1:' WHEN o_totalprice > 15000 THEN 'old:' END AS key_prefix,
  CASE o_orderpriority WHEN '1-URGENT' THEN 'verified' WHEN '2-HIGH' THEN 'deprecated' WHEN '5-LOW' THEN 'disputed' ELSE 'candidate' END AS status,
  CASE WHEN o_totalprice > 200000 THEN o_orderkey END AS resolution_event_id, year(o_orderdate) AS y FROM orders"""


def units(spark, sf_dir) -> DataFrame:
    o = read(spark, sf_dir, "orders")
    o.createOrReplaceTempView("units_of_orders")
    return spark.sql(UNITS.replace("FROM orders", "FROM units_of_orders"))


MODE = [
    ("knowledge_mode IS NULL", "'knowledge_mode_is_none'", "final"),
    ("knowledge_mode NOT IN ('observed', 'synthesized', 'unknown')", "concat('invalid_knowledge_mode:', knowledge_mode)", "final"),
    ("knowledge_mode = 'synthesized' AND derived_from IS NULL", "'missing_derived_from:synthesized'", "block"),
    ("knowledge_mode = 'synthesized' AND synthesis_provenance IS NULL", "'missing_synthesis_provenance:synthesized'", "block"),
    ("knowledge_mode = 'synthesized' AND review_status <> 'approved'", "concat('unapproved_synthesized:review_status=', review_status)", "block"),
    ("knowledge_mode = 'synthesized' AND version < 1", "concat('invalid_synthesized_version:', version)", "warn"),
]


@query("rul_09_mode_gate", verdicts_sql(UNITS, MODE, "id"))
def mode_gate(spark, sf_dir) -> DataFrame:
    """A known mode; what is synthesized says from what, how, and that it was approved."""
    return verdicts(units(spark, sf_dir), MODE, ["id"])


#: With the next unit of the same customer and question as the candidate for a merge, and approvals of customers in debt.
PAIRED = f"SELECT u.*, lead(key_prefix) OVER w AS other_prefix, lead(question) OVER w AS other_question, count(*) OVER w2 > 0 AS several, c.c_acctbal < 0 AS approved FROM ({UNITS}) u JOIN customer c ON c_custkey = o_custkey WINDOW w AS (PARTITION BY o_custkey ORDER BY id), w2 AS (PARTITION BY o_custkey)"
IDENTITY_RULES = [
    ("key_prefix IS NULL OR key_prefix <> 'id-v1:'", "'invalid_identity_key_format'", "final"),
    ("status IN ('verified', 'disputed', 'stale', 'deprecated') AND NOT approved", "'missing_approval:high_risk_operation'", "warn"),
    ("other_prefix = key_prefix AND (question IS NULL OR other_question IS NULL)", "'merge_questions_missing'", "warn"),
]


def paired(spark, sf_dir) -> DataFrame:
    units(spark, sf_dir)
    read(spark, sf_dir, "customer").createOrReplaceTempView("customers_of_units")
    return spark.sql(PAIRED.replace("FROM orders", "FROM units_of_orders").replace("JOIN customer ", "JOIN customers_of_units "))


@query("rul_10_identity_gate", verdicts_sql(PAIRED, IDENTITY_RULES, "id"))
def identity_gate(spark, sf_dir) -> DataFrame:
    """A key of the present format; risky states need an approval; a merge needs both questions."""
    return verdicts(paired(spark, sf_dir), IDENTITY_RULES, ["id"])


GRANULARITY = [
    ("question IS NULL OR trim(question) = ''", "'missing_question:ku_cannot_be_described'", "final"),
    ("version > 4 AND resolution_event_id IS NULL", "'split_triggered_no_resolution_event'", "block"),
    ("other_question = question AND resolution_event_id IS NULL", "'merge_triggered_no_resolution_event'", "block"),
    ("status = 'deprecated' AND resolution_event_id IS NULL", "'deprecated_without_resolution_event'", "warn"),
]


@query("rul_11_granularity_gate", verdicts_sql(PAIRED, GRANULARITY, "id"))
def granularity_gate(spark, sf_dir) -> DataFrame:
    """One question; what has to be split or merged needs an event that settles it (units of late years split, equal questions of a customer merge)."""
    return verdicts(paired(spark, sf_dir), GRANULARITY, ["id"])


#: Claims with their evidence: lines of an order, strong, medium or weak by discount, with the trust of their supplier's nation.
EVIDENCE = f"""SELECT u.*, coalesce(e.n, 0) AS n, coalesce(e.strong, 0) AS strong, coalesce(e.medium, 0) AS medium, coalesce(e.weak, 0) AS weak, coalesce(e.rejected, 0) AS rejected, coalesce(e.restricted, 0) AS restricted
  FROM ({UNITS}) u LEFT JOIN (SELECT l_orderkey, count(*) AS n, sum(CASE WHEN l_discount >= 0.09 THEN 1 ELSE 0 END) AS strong, sum(CASE WHEN l_discount < 0.09 AND l_discount >= 0.05 THEN 1 ELSE 0 END) AS medium,
    sum(CASE WHEN l_discount < 0.05 THEN 1 ELSE 0 END) AS weak, sum(CASE WHEN s_nationkey = 1 THEN 1 ELSE 0 END) AS rejected, sum(CASE WHEN s_nationkey = 2 THEN 1 ELSE 0 END) AS restricted
    FROM lineitem JOIN supplier ON l_suppkey = s_suppkey GROUP BY l_orderkey) e ON e.l_orderkey = u.id"""
EVIDENCE_RULES = [
    ("n = 0", "'no_evidence'", "final"),
    ("knowledge_mode = 'observed' AND strong < 1 AND medium < 2", "'insufficient_evidence_strength:observed_fact'", "final"),
    ("knowledge_mode = 'synthesized' AND derived_from IS NULL", "'missing_derived_from:synthesized'", "final"),
    ("rejected > 0", "'rejected_source_trust'", "final"),
    ("knowledge_mode = 'synthesized' AND weak > 0", "concat('weak_evidence_in_synthesized:', weak)", "warn"),
    ("restricted > 0", "'restricted_source_trust'", "warn"),
]


@query("rul_08_evidence_gate", verdicts_sql(EVIDENCE, EVIDENCE_RULES, "id"))
def evidence_gate(spark, sf_dir) -> DataFrame:
    """A claim needs evidence; an observed fact one strong or two medium pieces; sources must be trusted."""
    line = read(spark, sf_dir, "lineitem").join(read(spark, sf_dir, "supplier"), F.col("l_suppkey") == F.col("s_suppkey"))
    n = lambda cond: F.sum(F.when(cond, 1).otherwise(0))
    d = F.col("l_discount")
    e = line.groupBy("l_orderkey").agg(F.count("*").alias("n"), n(d >= 0.09).alias("strong"), n((d < 0.09) & (d >= 0.05)).alias("medium"), n(d < 0.05).alias("weak"), n(F.col("s_nationkey") == 1).alias("rejected"), n(F.col("s_nationkey") == 2).alias("restricted"))
    rows = units(spark, sf_dir).join(e, F.col("id") == F.col("l_orderkey"), "left").na.fill(0, ["n", "strong", "medium", "weak", "rejected", "restricted"])
    return verdicts(rows, EVIDENCE_RULES, ["id"])


PROVENANCE = [
    ("n_refs = 0", "'no_evidence_refs'", "block"),
    ("mode = 'synthesized' AND derived_from IS NULL", "'missing_derived_from:synthesized'", "block"),
    ("raw_hash = ''", "'no_raw_source_hash'", "block"),
    ("length(block) > 0 AND NOT contains(block, quote)", "'quote_not_in_block'", "block"),
]
QUOTED = "SELECT doc_id AS id, CASE WHEN lang = 'en' THEN 'observed' ELSE 'synthesized' END AS mode, CASE WHEN n_chars > 300 THEN source END AS derived_from, CASE WHEN n_chars > 50 THEN 1 ELSE 0 END AS n_refs, CASE WHEN source IS NULL OR n_chars < 20 THEN '' ELSE source END AS raw_hash, coalesce(text, '') AS block, CASE WHEN lang = 'de' THEN upper(substr(coalesce(text, ''), 5, 20)) ELSE substr(coalesce(text, ''), 5, 20) END AS quote FROM documents"


@query("rul_07_provenance_gate", verdicts_sql(QUOTED, PROVENANCE, "id"))
def provenance_gate(spark, sf_dir) -> DataFrame:
    """Evidence, derivation and source hash are given, and the quote stands in its block."""
    read(spark, sf_dir, "documents").createOrReplaceTempView("quoted_documents")
    return verdicts(spark.sql(QUOTED.replace("FROM documents", "FROM quoted_documents")), PROVENANCE, ["id"])


#: Contexts of an order and of the customer's next one: domain, platform and audience, some unknown.
CONTEXTS = "SELECT o_orderkey AS id, nullif(c_mktsegment, 'MACHINERY') AS domain, CASE WHEN o_orderpriority = '4-NOT SPECIFIED' THEN 'unknown' ELSE o_orderpriority END AS platform, o_orderstatus AS audience, lead(o_orderpriority) OVER w AS platform_b, lead(o_orderstatus) OVER w AS audience_b, lead(o_orderkey) OVER w AS other FROM orders JOIN customer ON c_custkey = o_custkey WINDOW w AS (PARTITION BY o_custkey ORDER BY o_orderkey)"
CONTEXT = [
    ("domain IS NULL", "'unknown_decisive_dimension:domain'", "warn"),
    ("platform = 'unknown'", "'unknown_decisive_dimension:platform'", "block"),
    ("other IS NULL", "'missing_candidate_b_context'", "final"),
    ("platform <> platform_b AND audience <> audience_b", "'no_common_dimension'", "warn"),
    ("platform <> platform_b", "'disjoint_dimension:platform'", "warn"),
    ("audience <> audience_b", "'disjoint_dimension:audience'", "warn"),
    ("platform_b = '4-NOT SPECIFIED'", "'unresolved_dimension:platform'", "block"),
]


@query("rul_12_context_gate", verdicts_sql(CONTEXTS, CONTEXT, "id"))
def context_gate(spark, sf_dir) -> DataFrame:
    """Decisive dimensions are known, and those of a pair to compare are neither disjoint nor open."""
    for t in ("orders", "customer"):
        read(spark, sf_dir, t).createOrReplaceTempView(f"context_{t}")
    return verdicts(spark.sql(CONTEXTS.replace("FROM orders", "FROM context_orders").replace("JOIN customer ", "JOIN context_customer ")), CONTEXT, ["id"])


#: Pairs of lines of an order as claims on the same part size: contexts, validity and supersession decide the class.
PAIRS = "SELECT l_orderkey AS id, l_linenumber AS line, l_quantity <> lead(l_quantity) OVER w AS differ, l_returnflag = lead(l_returnflag) OVER w AS same_flag, l_linestatus = lead(l_linestatus) OVER w AS same_status, l_shipdate >= lead(l_shipdate) OVER w AS earlier, l_discount > 0.08 AS superseded, lead(l_linenumber) OVER w AS other FROM lineitem WINDOW w AS (PARTITION BY l_orderkey ORDER BY l_linenumber, l_partkey, l_suppkey, l_extendedprice, l_quantity)"
ABLE = "other IS NOT NULL AND (same_flag OR same_status) AND differ"
CONFLICT = [
    (f"{ABLE} AND earlier AND NOT superseded", "'temporal_conflict_no_supersede'", "final"),
    (f"{ABLE} AND same_flag AND same_status AND NOT earlier", "'actual_conflict:actual'", "final"),
    (f"{ABLE} AND earlier", "'temporal_conflict_superseded'", "warn"),
    (f"{ABLE} AND same_flag AND NOT same_status AND NOT earlier", "'conditional_conflict'", "warn"),
    (f"{ABLE} AND same_status AND NOT same_flag AND NOT earlier", "'perspective_conflict'", "warn"),
]


@query("rul_14_conflict_gate", verdicts_sql(PAIRS, CONFLICT, "id, line"))
def conflict_gate(spark, sf_dir) -> DataFrame:
    """Actual conflicts and temporal ones without supersession block; conditional and perspective ones warn."""
    read(spark, sf_dir, "lineitem").createOrReplaceTempView("paired_lines")
    return verdicts(spark.sql(PAIRS.replace("FROM lineitem", "FROM paired_lines")), CONFLICT, ["id", "line"])


AUDIT = [
    ("coalesce(length(text), 0) = 0", "'empty'", "block"),
    ("NOT fm", "'no_frontmatter'", "block"),
    ("fm AND title IS NULL", "'no_title'", "block"),
    ("fm AND source IS NULL", "'no_source'", "block"),
    ("score < 0.6", "'low_score'", "block"),
]
NOTES = "SELECT d.doc_id AS id, d.text, d.n_chars > 120 AS fm, CASE WHEN d.lang <> 'fr' THEN d.lang END AS title, d.source, CASE l.quality WHEN 0 THEN 0.5 WHEN 1 THEN 0.9 END AS score FROM documents d LEFT JOIN labels l ON l.doc_id = d.doc_id"


@query("rul_23_hard_audit", f"SELECT id, verdict = 'pass' AS passed, reasons FROM ({verdicts_sql(NOTES, AUDIT, 'id')})")
def hard_audit(spark, sf_dir) -> DataFrame:
    """Notes must be filled, with front matter that has title and source, and score 0.6 if they are scored."""
    for t in ("documents", "labels"):
        read(spark, sf_dir, t).createOrReplaceTempView(f"audited_{t}")
    rows = spark.sql(NOTES.replace("FROM documents", "FROM audited_documents").replace("JOIN labels", "JOIN audited_labels"))
    return verdicts(rows, AUDIT, ["id"]).select("id", (F.col("verdict") == "pass").alias("passed"), "reasons")
