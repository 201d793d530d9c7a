"""Near-duplicate embeddings by sorted projection passes.

In each pass every vector gets the signs of BITS random projections, concatenated; vectors of one label are
put in the lexicographic order of these strings, and each is compared with its WINDOW successors by cosine
in double precision, also over the edges of range partitions. Verified pairs are united across passes. Since a dense group may be larger than any
window, the links within each component are then counted exactly, block against block of about BLOCK
vectors, so no partner is capped; a component of n vectors sends each to n / BLOCK tasks.

Equal vectors of a label are one weighted vector from the start. A null label, and a vector that is null,
empty, zero or holds null or non-finite components, links with nothing; so do rows without identifier.
Vectors are scaled by their largest component before their norm is taken, so none overflows. Vectors of
different length are never compared. Rows with one identifier are one vertex of the components, whatever their
vectors; links are counted by row. Extra columns are ignored. An empty table gives an empty table.
"""

from __future__ import annotations

from collections.abc import Iterator

import numpy as np
import pandas as pd
import pyarrow as pa
import pyarrow.compute as pc
from pyspark import TaskContext
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from corvane.llm.common import components, staged

PASSES, BITS, WINDOW, BLOCK, COSINE = 14, 48, 64, 2048, 0.98


def unit(x: np.ndarray) -> np.ndarray:
    """Rows scaled to length 1, by their largest component first."""
    x = x / np.abs(x).max(axis=1, keepdims=True)
    return x / np.linalg.norm(x, axis=1, keepdims=True)


def matrix(column: pa.Array) -> np.ndarray:
    """Rows of equal length, scaled to length 1, in double precision."""
    n = len(column)
    return unit(column.flatten().to_numpy(zero_copy_only=False).astype(np.float64).reshape(n, -1))


def projected(vectors: DataFrame, passes: int, bits: int, seed: int) -> DataFrame:
    """Each vector once for each pass, with its sign string as a number."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        planes: dict[int, np.ndarray] = {}
        for b in batches:
            size = pc.list_value_length(b.column("v")).to_numpy(zero_copy_only=False)
            for dim in np.unique(size).tolist():
                c = b.filter(pa.array(size == dim))
                if dim not in planes:
                    planes[dim] = np.random.default_rng((seed, dim)).standard_normal((dim, passes * bits))
                sign = (matrix(c.column("v")) @ planes[dim] > 0).reshape(-1, passes, bits)
                key = sign @ (1 << np.arange(bits - 1, -1, -1, dtype=np.int64))
                for p in range(passes):
                    yield pa.RecordBatch.from_arrays([pa.array(np.full(c.num_rows, p, np.int32)), c.column("label"), pa.array(np.full(c.num_rows, dim, np.int32)), pa.array(key[:, p]), c.column("id"), c.column("v")], names=["pass", "label", "dim", "key", "id", "v"])

    return vectors.mapInArrow(run, f"pass int, label {dict(vectors.dtypes)['label']}, dim int, key long, id long, v array<double>")


def linked_in_order(batches: Iterator[pa.RecordBatch], window: int, cosine: float) -> Iterator[pa.RecordBatch]:
    """(a, b): a spanning set of the pairs within the window that are close enough."""
    held = None
    for b in batches:
        t = pa.Table.from_batches([b] if held is None else [held, b]).combine_chunks()
        part = np.stack([t.column(c).to_numpy() for c in ("pass", "label", "dim")])
        ids = t.column("id").to_numpy()
        root = np.arange(len(ids))
        edges = np.flatnonzero(np.concatenate([[True], (part[:, 1:] != part[:, :-1]).any(axis=0), [True]]))
        for s, e in zip(edges[:-1].tolist(), edges[1:].tolist(), strict=True):
            if e - s < 2:
                continue
            x = matrix(t.column("v").slice(s, e - s).combine_chunks())
            near = []
            for d in range(1, min(window, e - s - 1) + 1):
                i = np.flatnonzero(np.einsum("ij,ij->i", x[:-d], x[d:]) >= cosine)
                near.append(np.stack([i, i + d]))
            i, j = np.concatenate(near, axis=1) + s
            while len(i):  # the least position that each can reach
                low = root.copy()
                np.minimum.at(low, j, root[i])
                np.minimum.at(low, i, root[j])
                low = low[low]
                if (low == root).all():
                    break
                root = low
        a = np.flatnonzero(root != np.arange(len(ids)))
        yield pa.RecordBatch.from_arrays([pa.array(ids[root[a]]), pa.array(ids[a])], names=["a", "b"])
        held = t.slice(max(0, len(ids) - window)).to_batches()[0] if len(ids) else None


def linked(order: DataFrame, window: int, cosine: float) -> DataFrame:
    """(a, b) of range partitions in order: linked_in_order() within each, then over their edges.

    Each partition passes on its first and last rows; the last ones are compared with as many of the following
    partitions' first rows as the window reaches.
    """
    kinds = dict(order.dtypes)
    columns = ["pass", "label", "dim", "key", "id", "v"]

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        part = TaskContext.get().partitionId()
        head = tail = None

        def passed() -> Iterator[pa.RecordBatch]:
            nonlocal head, tail
            for b in batches:
                t = pa.Table.from_batches([b])
                head = t.slice(0, window) if head is None else head if head.num_rows >= window else pa.concat_tables([head, t]).slice(0, window)
                tail = t if tail is None else pa.concat_tables([tail, t])
                tail = tail.slice(max(0, tail.num_rows - window)).combine_chunks()
                yield b

        types = None
        for pairs in linked_in_order(passed(), window, cosine):
            types = types or [head.schema.field(c).type for c in columns]
            n = pairs.num_rows
            yield pa.RecordBatch.from_arrays([*pairs.columns, pa.nulls(n, pa.int32()), pa.nulls(n, pa.bool_()), *(pa.nulls(n, x) for x in types)], names=["a", "b", "part", "tail", *columns])
        for t, last in ((head, False), (tail, True)):
            if t is not None and t.num_rows:
                n, t = t.num_rows, t.combine_chunks()
                rest = [t.column(c).combine_chunks() for c in columns]
                rest = [x.chunk(0) if isinstance(x, pa.ChunkedArray) else x for x in rest]
                yield pa.RecordBatch.from_arrays([pa.nulls(n, pa.int64()), pa.nulls(n, pa.int64()), pa.array([part] * n, pa.int32()), pa.array([last] * n), *rest], names=["a", "b", "part", "tail", *columns])

    schema = f"a long, b long, part int, tail boolean, pass int, label {kinds['label']}, dim int, key long, id long, v array<double>"
    found = staged(order.mapInArrow(run, schema), "windows")
    within = found.where("part is null").select("a", "b")
    # one row for each partition, so that the edges that a short partition lies between are known
    sizes = sorted((r["part"], r["n"]) for r in found.where("not tail").groupBy("part").agg(F.count("*").alias("n")).collect())
    reach = []
    for k, (part, _) in enumerate(sizes):
        left = window
        for other, n in sizes[k + 1 :]:
            reach.append((part, other))
            left -= n
            if left <= 0:
                break
    if not reach:
        return within
    after = found.sparkSession.createDataFrame(reach, "edge int, part int")
    befores = found.where("tail").join(after.select("edge").distinct(), F.col("part") == F.col("edge")).select("edge", *columns)
    afters = found.where("not tail").join(after, "part").select("edge", *columns)
    rows = befores.union(afters).repartition("edge").sortWithinPartitions("edge", *columns[:-1])
    return within.union(rows.select(*columns).mapInArrow(lambda batches: linked_in_order(batches, window, cosine), "a long, b long"))


def exact_links(members: DataFrame, cosine: float, block: int) -> DataFrame:
    """(id, links): the weight of all vectors of the same component (and label) that each links with."""
    size = members.groupBy("component").agg(F.ceil(F.count("*") / block).cast("int").alias("n"))
    at = F.pmod(F.xxhash64("id"), F.col("n")).cast("int")
    dealt = members.join(size, "component").withColumn("k", at)
    dealt = dealt.withColumn("other", F.explode(F.sequence(F.lit(0), F.col("n") - 1))).withColumns({"i": F.least("k", "other"), "j": F.greatest("k", "other")})

    def count(g: pd.DataFrame) -> pd.DataFrame:
        x = unit(np.stack(g["v"].to_numpy()).astype(np.float64))
        i, j = g["i"].iloc[0], g["j"].iloc[0]
        weight, left = g["weight"].to_numpy(), (g["k"] == i).to_numpy()
        if i == j:
            near = x @ x.T >= cosine
            np.fill_diagonal(near, False)
            links = near @ weight
        else:
            near = x[left] @ x[~left].T >= cosine
            links = np.empty(len(g), np.int64)
            links[left], links[~left] = near @ weight[~left], weight[left] @ near
        return pd.DataFrame({"id": g["id"], "links": links.astype(np.int64)})

    # dealt by all three: the join alone would leave every block pair of a component in one task
    dealt = dealt.select("component", "i", "j", "k", "id", "weight", "v").repartition("component", "i", "j")
    return dealt.groupBy("component", "i", "j").applyInPandas(count, "id long, links long").groupBy("id").agg(F.sum("links").alias("links"))


def near_duplicates(
    table: DataFrame, *, id_col: str = "vec_id", vector_col: str = "embedding", label_col: str = "label", cosine: float = COSINE, passes: int = PASSES, bits: int = BITS, window: int = WINDOW, block: int = BLOCK, seed: int = 7
) -> DataFrame:
    """(id, n_links, component_id, kept) for every row."""
    rows = table.select(F.col(id_col).cast("long").alias("id"), F.col(label_col).alias("label"), F.transform(vector_col, lambda x: x.cast("double")).alias("v"))
    usable = F.col("id").isNotNull() & F.col("label").isNotNull() & F.forall("v", lambda x: x.isNotNull() & ~F.isnan(x) & (F.abs(x) < float("inf"))) & F.exists("v", lambda x: x != 0)
    usable = F.coalesce(usable, F.lit(False))
    rows = staged(rows.withColumns({"usable": usable, "k1": F.when(usable, F.xxhash64("label", "v")), "k2": F.when(usable, F.xxhash64(F.lit("2"), "v", "label"))}), "vectors")
    classes = rows.where("usable").groupBy("k1", "k2").agg(F.min("id").alias("a"), F.count("*").alias("weight"), F.first("label").alias("label"), F.first("v").alias("v"))
    classes = staged(classes.withColumn("id", F.monotonically_increasing_id()), "classes")  # a number of its own, kept in the file
    keys = ["pass", "label", "dim", "key", "id"]
    order = projected(classes.select("id", "label", "v"), passes, bits, seed).repartitionByRange(*keys).sortWithinPartitions(*keys)
    vertex = classes.select("id", F.col("a").alias("of"))
    pairs = staged(linked(order, window, cosine), "links")
    edges = pairs.join(vertex, F.col("a") == F.col("id")).select("b", F.col("of").alias("x")).join(vertex, F.col("b") == F.col("id")).select("x", F.col("of").alias("y"))
    named = rows.where("usable").select("k1", "k2", "id").distinct().join(classes.select("k1", "k2", "a"), ["k1", "k2"])
    twins = named.groupBy("id").agg(F.min("a").alias("low"), F.max("a").alias("high")).where("low <> high").select("id")
    united = staged(components(edges.toDF("a", "b").union(named.join(twins, "id", "left_semi").select(F.col("id").alias("a"), F.col("a").alias("b")))), "components")
    placed = classes.join(united.select(F.col("id").alias("a"), "component"), "a")
    links = exact_links(placed.select("component", "id", "weight", "v"), cosine, block)
    ends = classes.select("k1", "k2", "id", "a", "weight").join(united.select(F.col("id").alias("a"), "component"), "a", "left").join(links, "id", "left")
    ends = ends.select("k1", "k2", (F.col("weight") - 1 + F.coalesce("links", F.lit(0))).alias("n_links"), F.coalesce("component", "a").alias("component_id"))
    out = rows.join(ends, ["k1", "k2"], "left")
    return out.select(F.col("id").alias(id_col), F.coalesce("n_links", F.lit(0)).alias("n_links"), F.coalesce("component_id", "id").alias("component_id")).withColumn("kept", F.coalesce(F.col(id_col) == F.col("component_id"), F.lit(True)))


def op2_embedding(spark: SparkSession, sf_dir: str) -> DataFrame:
    return near_duplicates(spark.read.parquet(f"{sf_dir}/embeddings.parquet"))
