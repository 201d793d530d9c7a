"""Pairs over the edges of range partitions count as those within."""

import numpy as np

from corvane.llm import embed_dedup


def test_windows_reach_over_partition_edges(spark):
    rnd = np.random.default_rng(3)
    v = rnd.standard_normal((600, 16))
    v = np.concatenate([v, v + rnd.standard_normal(v.shape) * 0.02])
    df = spark.createDataFrame([(i, x.tolist(), 1) for i, x in enumerate(v)], "id long, v array<double>, label int")
    order = embed_dedup.projected(df, 1, 48, 7)
    keys = ["pass", "label", "dim", "key"]

    def pairs(n, window):
        got = embed_dedup.linked(order.repartitionByRange(n, *keys).sortWithinPartitions(*keys, "id"), window, 0.98).collect()
        return {(min(p), max(p)) for p in got}

    whole = pairs(1, 8)
    assert len(whole) > 100 and whole <= pairs(40, 8)
    parted = order.repartitionByRange(40, *keys).sortWithinPartitions(*keys, "id")
    within = parted.mapInArrow(lambda b: embed_dedup.linked_in_order(b, 8, 0.98), "a long, b long").collect()
    assert not whole <= {(min(p), max(p)) for p in within}
    # partitions that are shorter than the window
    assert pairs(1, 60) <= pairs(40, 60)


def brute(rows, cosine=0.98):
    links = {k: 0 for k in range(len(rows))}
    up = {r[0]: r[0] for r in rows}

    def root(x):
        while up[x] != x:
            x = up[x]
        return x

    for label in {r[2] for r in rows}:
        own = [k for k, r in enumerate(rows) if r[2] == label]
        x = np.array([rows[k][1] for k in own])
        x = x / np.abs(x).max(axis=1, keepdims=True)
        x /= np.linalg.norm(x, axis=1, keepdims=True)
        for i, j in zip(*np.nonzero(np.triu(x @ x.T >= cosine, 1)), strict=True):
            links[own[i]] += 1
            links[own[j]] += 1
            a, b = root(rows[own[i]][0]), root(rows[own[j]][0])
            up[max(a, b)] = min(a, b)
    return sorted((r[0], links[k], root(r[0])) for k, r in enumerate(rows))


def answers(spark, rows, **more):
    df = spark.createDataFrame([(i, [float(y) for y in x], label) for i, x, label in rows], "vec_id long, embedding array<double>, label int")
    return sorted((r.vec_id, r.n_links, r.component_id) for r in embed_dedup.near_duplicates(df, **more).collect())


def test_large_and_repeated(spark):
    rows = [(1, [1e200, 1e200], 1), (2, [1e200, 1.0001e200], 1), (3, [1e-200, 1e-200], 2), (4, [3e-200, 3e-200], 2), (5, [1.0, 0.0], 3), (5, [0.0, 1.0], 3), (6, [0.001, 1.0], 3), (7, [1.0, 0.001], 3), (8, [1.0, 0.0], 4)]
    assert answers(spark, rows) == answers(spark, rows[::-1]) == brute(rows)


def test_recall_in_a_dense_label(spark):
    """Vectors of one label, in loose and in tight groups and alone: every link of a brute-force search."""
    rnd = np.random.default_rng(8)
    centres = rnd.standard_normal((400, 32))
    rows = [(n, centres[n % 400] + rnd.standard_normal(32) * (0.02 if n % 400 < 200 else 0.13), 1) for n in range(2400)]
    got, want = answers(spark, rows, block=300), brute(rows)
    assert sum(x[1] for x in got) >= 0.999 * sum(x[1] for x in want) > 3000
