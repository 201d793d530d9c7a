"""Gates, keys and quotes on small tables, with rows that fail and rows that pass."""

import hashlib
import json

from pyspark.sql import functions as F

from corvane.operators import gates, identity, readiness


def test_identity_keys_are_those_of_canonical_json(spark):
    rows = [("source", {"source_type": "  Web\u00a0Page ", "canonical_locator": "HTTP://X"}), ("conflict", {"statement_a_ref": "z", "statement_b_ref": "a"}), ("odd", {})]
    got = [r[0] for r in spark.createDataFrame(rows, "kind string, fields map<string,string>").select(identity.identity_key(F.col("kind"), F.col("fields"))).collect()]

    def key(**fields):
        return "id-v1:" + hashlib.sha256(json.dumps(fields, sort_keys=True, ensure_ascii=False, separators=(",", ":")).encode()).hexdigest()

    assert got[0] == key(source_type="web page", canonical_locator="http://x")
    assert got[1] == key(statement_a_ref="a", statement_b_ref="z", context_a_id="", context_b_id="")
    assert got[2] == "unsupported:odd"


def test_verdicts(spark):
    rows = spark.createDataFrame([(1, None, 1), (2, "x", 5), (3, "x", 1), (4, "y", 1)], "id int, a string, n int")
    rules = [("a IS NULL", "'no_a'", "final"), ("n > 3", "concat('large:', n)", "block"), ("a = 'x'", "'is_x'", "warn")]
    got = [tuple(r) for r in identity.verdicts(rows, rules, ["id"]).orderBy("id").collect()]
    assert got == [(1, "block", "no_a"), (2, "block", "large:5,is_x"), (3, "warn", "is_x"), (4, "pass", "")]


def test_every_gate_blocks_and_passes(spark):
    import __spark_entry__

    for name in ("rul_07_provenance_gate", "rul_08_evidence_gate", "rul_09_mode_gate", "rul_10_identity_gate", "rul_11_granularity_gate", "rul_12_context_gate", "rul_14_conflict_gate"):
        found = {r[0] for r in __spark_entry__.queries()[name](spark, "/root/testdata/sf0.01").select("verdict").distinct().collect()}
        assert {"block", "pass"} <= found, name


def test_quotes_are_found_wherever_they_stand(spark):
    docs = [(1, "one two three four five six seven eight"), (2, "bone two three four five sixty"), (3, "x y"), (4, None), (5, "")]
    quotes = [(1, "ne two three four five six"), (2, "two three"), (3, "y"), (4, "seven eight nine ten"), (5, "x y"), (6, "")]
    d, q = spark.createDataFrame(docs, "doc_id int, text string"), spark.createDataFrame(quotes, "item_id int, quote string")
    want = {(i, k) for i, x in quotes for k, t in docs if x and t and x in t}
    assert {tuple(r) for r in gates.containing(d, q).collect()} == want and len(want) >= 6


def test_readiness(spark):
    rows = [("a", "# T\n\nplain words that are long enough", "n", "md", "native_text"), ("b", "", "n", "md", "native_text"), ("c", "Share\nEdit", "n", "md", "native_text"), ("d", "ok.\nyes\nno", "n", "md", "native_text"), ("e", "some text here, longer than that", "n", "bin", "native_text"), ("f", "\ufffd" * 9, "n", "md", "native_text"), ("g", "same line\n" * 4, "n", "md", "native_text")]
    df = spark.createDataFrame(rows, "id string, text string, source string, format string, method string")
    got = {r["id"]: (r["decision"], r["reasons"]) for r in readiness.assessed(df).collect()}
    assert got["a"] == ("ready", "") and got["b"][0] == got["c"][0] == "skip_no_content"
    assert got["d"] == ("ready_with_warning", "legitimate_short") and got["e"] == ("unsupported", "unsupported_format")
    assert got["f"] == ("quarantine_degraded", "encoding_degraded") and got["g"] == ("ready_with_warning", "high_repetition")
    blocks = readiness.assessed(readiness.blocks(df.withColumn("text", F.concat("text", F.lit("\n \n\nShare")))))
    folded = {r["id"]: r["decision"] for r in readiness.folded(blocks).collect()}
    assert folded["a"] == "ready_with_warning" and folded["c"] == "skip_no_content" and folded["e"] == "unsupported"
