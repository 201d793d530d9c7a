"""The registered rollup runs over a ledger: inserts, revisions and deletes that end in the tables' totals."""

from pyspark.sql import functions as F

from corvane.llm import token_rollup


def test_query_takes_the_ledger_path(spark, monkeypatch, tmp_path):
    sf, made = "/root/testdata/sf0.001", []

    class Kept(token_rollup.Rollup):
        def __init__(self, *args):
            super().__init__(*args)
            made.append(self)

    monkeypatch.setattr(token_rollup, "Rollup", Kept)
    got = {tuple(r) for r in token_rollup.op4_token_rollup(spark, sf).collect()}
    rollup = made[0]
    plain = Kept(spark, f"file://{tmp_path}/plain", rollup.tokenizers)
    plain.commit("load", spark.read.parquet(f"{sf}/documents.parquet"))
    assert got == {tuple(r) for r in plain.totals().collect()}
    assert len(rollup._commits()) == 3 and rollup._read("ledger", token_rollup.DELTA).where("docs < 0").count() > 0


def test_writers_at_a_time_and_ties(spark, tmp_path):
    folder = f"file://{tmp_path}/rollup"
    one, two = (token_rollup.Rollup(spark, folder, {"words": token_rollup.word_counter}) for _ in range(2))
    docs = spark.createDataFrame([(1, "a b c", "en", "s"), (2, "a", "en", "s"), (None, "a a", None, None)], "doc_id long, text string, lang string, source string").withColumn("tokens", F.lit("clash"))
    assert one.commit("empty", docs.where("false")) and one.commit("first", docs)
    # both have seen version 2 as the next; the slower one must not lose the other's batch
    new = docs.where("doc_id = 1").withColumn("text", F.lit("a b"))
    publish, late = two._publish, []

    def delayed(version, batch, data):
        if not late:
            late.append(one.commit("between", docs.where("doc_id = 1").withColumn("text", F.lit("x"))))
        return publish(version, batch, data)

    two._publish = delayed
    assert two.commit("second", new) and late == [True]
    assert not one.commit("second", new) and not two.commit("between", new)
    assert {tuple(r) for r in one.totals().collect()} == {("s", "en", "words", 2, 3), (None, None, "words", 1, 2)}
    ties = docs.where("doc_id = 2").withColumn("deleted", F.lit(False))
    assert one.commit("ties", ties.union(ties.withColumn("deleted", F.lit(True))))
    assert {tuple(r) for r in one.totals().collect()} == {("s", "en", "words", 1, 2), (None, None, "words", 1, 2)}
