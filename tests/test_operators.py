"""Small cases whose results follow from the rules."""

from pyspark.sql import functions as F

from corvane.functions import text as T
from corvane.operators import documents, events, graph, lifecycle, metrics, search


def rows(df):
    return sorted(map(tuple, df.collect()), key=str)


def test_fusion_of_two_lists(spark):
    a = spark.createDataFrame([(1, 9.0), (2, 8.0), (3, 7.0)], "doc_id long, score double")
    b = spark.createDataFrame([(4, 9.0), (1, 8.0), (5, 7.0)], "doc_id long, score double")
    got = dict(search.fuse([a, b]).collect())
    assert got[1] == round(1 / 61 + 1 / 62, 6) and got[4] == round(1 / 61, 6) and got[2] == round(1 / 62, 6)


def test_cosine_of_odd_vectors(spark):
    df = spark.createDataFrame([([], []), ([1.0], [1.0, 2.0]), ([0.0, 0.0], [1.0, 1.0]), ([1.0, 0.0], [1.0, 0.0])], "a array<float>, b array<float>")
    assert [r[0] for r in df.select(search.cosine(F.col("a"), F.col("b"))).collect()] == [0.0, 0.0, 0.0, 1.0]


def test_conflicts_between_similar_statements(spark):
    s = spark.createDataFrame(
        [("a", 1, "the queue is ordered"), ("b", 1, "the queue is not ordered"), ("c", 1, "the queue is never ordered"), ("d", 2, "the queue is ordered"), ("e", 1, "the queue is ordered")],
        "id string, entity long, statement string",
    )
    got = {(r["a"], r["b"]): (r["conflict_type"], r["confidence"]) for r in search.conflicts(s).collect()}
    assert got[("a", "b")] == ("contradiction", 0.9)
    assert got[("b", "c")] == ("inconsistency", 0.5)
    assert ("a", "e") not in got and not any("d" in k for k in got)


def test_similar_statements_equal_brute_force(spark):
    import itertools
    import random

    rnd = random.Random(3)
    texts = [(f"s{i}", i % 2, " ".join(rnd.choice("abcdefgh") * 2 for _ in range(rnd.randint(1, 7)))) for i in range(40)]
    s = spark.createDataFrame(texts, "id string, entity int, statement string")
    got = {(r["a"], r["b"]) for r in search.similar_statements(s, 0.25).collect()}
    sets = {i: set(t.split()) for i, _, t in texts}
    want = {tuple(sorted((a[0], b[0]))) for a, b in itertools.combinations(texts, 2) if a[1] == b[1] and len(sets[a[0]] & sets[b[0]]) / len(sets[a[0]] | sets[b[0]]) >= 0.25}
    assert got == want


def test_heat(spark):
    now = 100 * lifecycle.DAY
    df = spark.createDataFrame([("a", False, 5, now - 31 * lifecycle.DAY, 0), ("b", True, 5, now - 31 * lifecycle.DAY, 0), ("c", False, 50, 1, now)], "id string, is_immutable boolean, heat long, created_at long, last_used_at long")
    got = {r["id"]: (r["new_heat"], r["zombie_since"]) for r in lifecycle.decayed(df, now).collect()}
    assert got == {"a": (0, now), "b": (5, None), "c": (50, None)}


def test_temporal_status(spark):
    df = spark.createDataFrame([(None, None), (5, None), (1, 3), (1, 9), (None, 9)], "since int, until int")
    assert [r[0] for r in df.select(lifecycle.temporal_status(F.col("since"), F.col("until"), F.lit(3))).collect()] == ["unknown", "scheduled", "historical", "current", "current"]


def test_alias_chains(spark):
    chain = [(f"a{i}", f"a{i + 1}") for i in range(9)] + [("x", "y"), ("y", "x"), ("s", "s"), ("p", "q"), ("q", "r")]
    got = dict(graph.canonical(spark.createDataFrame(chain, "alias string, canonical string")).collect())
    assert got["p"] == "r" and got["x"] is None and got["s"] is None and got["a0"] is None and got["a2"] == "a9"


def test_neighbours_take_the_first_visit(spark):
    e = spark.createDataFrame([("a", "b", 0.5), ("a", "c", 1.0), ("c", "b", 1.0), ("b", "d", 0.5)], "source_id string, target_id string, weight double")
    assert rows(graph.neighbours(e, "a", 2)) == [("b", 1, 0.5), ("c", 1, 1.0), ("d", 2, 0.25)]


def test_shortest_path(spark):
    e = spark.createDataFrame([("a", "b"), ("b", "d"), ("a", "c"), ("c", "d"), ("d", "e")], "source_id string, target_id string")
    assert rows(graph.shortest_path(e, "a", "e")) == [(3, "a>b>d>e")]
    assert rows(graph.shortest_path(e, "e", "a")) == []


def test_marks_within_the_ttl_of_the_first(spark):
    m = spark.createDataFrame([(1, "k", 0), (2, "k", 5), (3, "k", 10), (4, "k", 12), (5, "k", 20), (6, "z", 3)], "event_id long, key string, at long")
    assert sorted(r[0] for r in events.first_marks(m, 10).collect()) == [1, 3, 5, 6]


def test_upsert(spark):
    t = spark.createDataFrame([(1, "a"), (2, "b")], "k int, v string")
    c = spark.createDataFrame([(2, "x"), (3, "y")], "k int, v string")
    assert rows(events.upsert(t, c, "k")) == [(1, "a"), (2, "x"), (3, "y")]


def test_field_diff_treats_null_as_a_value(spark):
    o = spark.createDataFrame([(1, "a", None), (2, "b", "c")], "id int, x string, y string")
    n = spark.createDataFrame([(1, "a", "z"), (2, "b", "c")], "id int, x string, y string")
    assert rows(metrics.diff_fields(o, n, "id", ["x", "y"])) == [(1, "y", None, "z")]


def test_text_functions(spark):
    df = spark.createDataFrame([("- a\n* b\n1. c\n\nd",), ("",), ("# Title\nbody [1] [2] [1] [[x|y]] [[z]]",)], "t string")
    got = df.select(T.list_density("t"), T.first_title(F.col("t"), F.lit("a/b.c.md")), T.citations("t"), T.wikilinks("t"), T.estimated_tokens("t")).collect()
    assert got[0][0] == 0.75 and got[1][0] == 0.0 and got[1][1] == "b.c"
    assert got[2][1] == "Title" and got[2][2] == [1, 2] and got[2][3] == ["x", "z"]


def test_prefilter_language_rule(spark):
    df = spark.createDataFrame([("x" * 50,), ("word " * 40,), ("- item\n" * 30,), ("中" * 60,)], "t string")
    got = [tuple(r) for r in df.select(documents.prefilter_action("t", F.octet_length("t")), documents.prefilter_action("t", F.octet_length("t"), True)).collect()]
    assert got == [("skip", "skip"), ("process", "skip"), ("reference_list", "reference_list"), ("process", "process")]


def test_issues_share_one_projection(spark):
    p = spark.createDataFrame([("a", "", "b", "s", "entity"), ("b", "t", "x" * 6000, None, "entity")], "id string, title string, body string, source string, type string")
    assert rows(events.issues(p, events.page_rules()).select("id", "code")) == [("a", "MISSING-TITLE"), ("a", "THIN-BODY"), ("b", "MISSING-SOURCES"), ("b", "RAW-PASTE")]


def test_validity_is_half_open(spark):
    df = spark.createDataFrame([(1, 3, 3, 5), (1, 4, 3, 5), (None, None, None, None), (None, 2, 2, None)], "a int, b int, c int, d int")
    assert [r[0] for r in df.select(lifecycle.temporally_disjoint(*map(F.col, "abcd"))).collect()] == [True, False, False, True]
