"""The pipeline on a corpus of odd rows, stage by stage against brute force."""

import random
import re

import pytest
from pyspark.sql import functions as F
from tests.llm.test_llm import brute3, brute6, brute10, words10

import corpus_pipeline
from corvane.llm import quality_crf


@pytest.fixture(scope="module")
def folder(spark, docs, rows, tmp_path_factory):
    place = str(tmp_path_factory.mktemp("sf"))
    rnd = random.Random(3)
    docs.withColumn("row", F.lit("clash")).withColumn("quality_score", F.lit(7)).withColumn("a.b", F.lit(1)).write.parquet(f"{place}/documents.parquet")
    docs.select("doc_id", F.when(F.col("text").contains("reprehenderit"), 1).otherwise(0).alias("quality"), F.lit(0).alias("toxic")).write.parquet(f"{place}/labels.parquet")
    full = [r[1] for r in rows if r[1] and len(r[1].split()) > 20]
    items = [(n, " ".join(rnd.choice(full).split()[4:18])) for n in range(5)] + [(9, None)]
    spark.createDataFrame(items, "item_id long, text string").write.parquet(f"{place}/benchmark.parquet")
    return place, items


def cut10(text, items):
    windows = {tuple(w[k : k + 10]) for _, t in items for w in [words10(t)] for k in range(max(0, len(w) - 9))}
    spots = [m.span() for m in re.finditer(r"[^\x00-\x2F\x3A-\x60\x7B-\x7F]+", text)]
    w = words10(text)
    hit = {k + j for k in range(len(w) - 9) if tuple(w[k : k + 10]) in windows for j in range(10)}
    out, at = [], 0
    for k in sorted(hit):
        if k - 1 not in hit:
            out.append(text[at : spots[k][0]])
        at = spots[k][1]
    return "".join(out) + text[at:]


def test_stages(spark, folder):
    place, items = folder
    docs = spark.read.parquet(f"{place}/documents.parquet")
    before = [tuple(r) for r in docs.select("doc_id", "text").collect()]
    for n, (_, stage) in enumerate(corpus_pipeline.STAGES):
        out = stage(spark, docs, place)
        if n < 4:
            assert out.columns == docs.columns
        out.write.parquet(f"{place}/stage{n}")
        now = spark.read.parquet(f"{place}/stage{n}")
        after = [tuple(r) for r in now.select("doc_id", "text").collect()]
        got = dict(after)
        assert len(got) == len(after)
        if n == 0:
            field = quality_crf.fit(docs, spark.read.parquet(f"{place}/labels.parquet"))
            scores = dict(quality_crf.score(docs, field).select("doc_id", "quality_score").collect())
            want = {i: t for i, t in before if scores[i] >= quality_crf.THRESHOLD}
        elif n == 1:
            want = {i: t for i, (t, k) in brute3(before).items() if not (k and not t.strip())}
        elif n == 2:
            groups = brute6(before)
            want = {i: t for i, t in before if groups[i][2]}
        elif n == 3:
            hits = brute10(before, items)
            want = {i: cut10(t, items) if hits[i][4] else t for i, t in before}
            want = {i: t for i, t in want.items() if not (hits[i][4] and not t.strip())}
        else:
            want = dict(before)
            assert now.where("octet_length(ids) <> 4 * n_tokens").count() == 0
        assert got == want, n
        before, docs = after, now


def test_run_and_empty_tables(spark, folder, tmp_path):
    place, _ = folder
    assert corpus_pipeline.run(spark, place).count() == spark.read.parquet(f"{place}/stage4").count()
    for t in ("documents", "labels", "benchmark"):
        spark.read.parquet(f"{place}/{t}.parquet").where("false").write.parquet(f"{tmp_path}/{t}.parquet")
    assert corpus_pipeline.run(spark, str(tmp_path)).count() == 0


def test_repeated_identifiers_leave_one_row_of_a_group(spark):
    say = lambda w: " ".join(f"{w}{i}" for i in range(30))
    rows = [(1, say("a"), 1), (1, say("a"), 1), (2, say("a") + " x", 2), (3, "", 3), (3, "", 3), (4, say("b"), 4), (4, say("c"), 5), (None, say("a"), 6)]
    docs = spark.createDataFrame(rows, "doc_id long, text string, extra int")
    out = corpus_pipeline.near_duplicates(spark, docs, "")
    assert out.columns == docs.columns
    got = sorted((r.doc_id or 0, r.text) for r in out.collect())
    assert [i for i, _ in got] == [0, 1, 3, 3, 4]
    assert got[1] == (1, say("a"))
