"""What the operators of this subpackage share: staging, hashing, connected components, text pieces."""

from __future__ import annotations

import tempfile
import uuid
from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F


def shared_dir(spark: SparkSession) -> str:
    """The folder that driver and executors share: spark.checkpoint.dir, or, where all is one process as in tests, a local one."""
    base = spark.conf.get("spark.checkpoint.dir", None)
    if not base:
        master = spark.sparkContext.master
        if not master.startswith("local") or master.startswith("local-cluster"):
            raise ValueError("set spark.checkpoint.dir to a folder that driver and executors share")
        base = "file://" + tempfile.mkdtemp(prefix="corvane-")
        spark.conf.set("spark.checkpoint.dir", base) if spark.conf.isModifiable("spark.checkpoint.dir") else None
    return base.rstrip("/")


def new_folder(spark: SparkSession, tag: str) -> str:
    """A fresh folder name below the shared folder."""
    return f"{shared_dir(spark)}/corvane/{tag}-{uuid.uuid4().hex}"


def staged(df: DataFrame, tag: str) -> DataFrame:
    """Write df as Parquet into the shared folder and read it back: cuts lineage, survives lost executors."""
    path = new_folder(df.sparkSession, tag)
    df.write.parquet(path)
    return df.sparkSession.read.schema(df.schema).parquet(path)


#: Up to so many identifiers (some tens of MB as a hash table) are sent to where the rows lie; more are joined by shuffling.
IDS_TO_SEND = 1_000_000


def sent_if_few(ids: DataFrame, tag: str) -> DataFrame:
    """One column of identifiers, staged; marked for broadcast if their number, which is counted, is small."""
    ids = staged(ids, tag)
    return F.broadcast(ids) if ids.count() <= IDS_TO_SEND else ids


#: Bytes of a batch that goes to a Python worker, where the session doesn't say: 10,000 whole texts may be any size.
BATCH_BYTES = "8m"


def in_batches(docs: DataFrame) -> DataFrame:
    """docs, whose rows go to Python workers in batches of about BATCH_BYTES, in this session, unless it has a bound of its own."""
    conf, key = docs.sparkSession.conf, "spark.sql.execution.arrow.maxBytesPerBatch"
    if conf.get(key, None) is None:
        conf.set(key, BATCH_BYTES)
    return docs


def packed(docs: DataFrame, text_col: str) -> DataFrame:
    """row: every column but the text in one, so that no name can clash or trouble a function over Arrow; and the text."""
    docs = in_batches(docs)
    rest = [F.col(f"`{c}`") for c in docs.columns if c != text_col]
    return docs.select(F.struct(*(rest or [F.lit(True).alias("none")])).alias("row"), F.col(f"`{text_col}`").alias("text"))


def unpacked(df: DataFrame, names: list[str], text_col: str, own: tuple[str, ...] = ()) -> DataFrame:
    """The columns of row and the text again, and the operator's own, which replace others of their names."""
    kept = [F.col("text").alias(c) if c == text_col else F.col("row").getField(c).alias(c) for c in names if c not in own]
    return df.select(*kept, *own)


#: Up to so many edges (a few MB) one task unites them; beyond that they are regrouped across tasks.
EDGES_IN_A_TASK = 400_000


class Unions:
    """Disjoint sets of numbers, by a union-find with path halving."""

    def __init__(self) -> None:
        self.up: dict[int, int] = {}

    def root(self, x: int) -> int:
        while (y := self.up.setdefault(x, x)) != x:
            self.up[x] = x = self.up[y]
        return x


def united(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    """(id, component) of all edges (a, b) that come."""
    sets = Unions()
    for batch in batches:
        for a, b in zip(batch.column("a").to_pylist(), batch.column("b").to_pylist(), strict=True):
            a, b = sets.root(a), sets.root(b)
            if a != b:
                sets.up[max(a, b)] = min(a, b)
    ids = sorted(sets.up)
    yield pa.RecordBatch.from_arrays([pa.array(ids, pa.int64()), pa.array([sets.root(x) for x in ids], pa.int64())], names=["id", "component"])


def components(edges: DataFrame) -> DataFrame:
    """Connected components of edges (a, b: long) as (id, component = smallest id).

    Few edges (their number is checked) are united in one task. More are by alternating stars: large-star
    links every larger neighbour of a node to the node's smallest neighbour, small-star does so for the
    smaller ones; both only regroup edges, so no component is ever gathered in one task. Self-edges, repeats
    and null ends are ignored; nodes without an edge don't appear.
    """
    e = edges.select(F.least("a", "b").alias("a"), F.greatest("a", "b").alias("b")).where("a < b").distinct()
    e = staged(e, "edges")
    if e.count() <= EDGES_IN_A_TASK:
        return e.coalesce(1).mapInArrow(united, "id long, component long")
    before = None
    while True:
        both = e.union(e.select(F.col("b").alias("a"), F.col("a").alias("b")))
        low = both.groupBy("a").agg(F.least(F.min("b"), F.first("a")).alias("m"))
        large = both.join(low, "a").where("b > a").select(F.col("b").alias("u"), F.col("m").alias("v"))
        large = large.where("u <> v").distinct()
        low = large.groupBy("u").agg(F.min("v").alias("m"))
        small = large.join(low, "u")
        small = small.select(F.col("v").alias("b"), F.col("m").alias("a")).union(small.select(F.col("u").alias("b"), F.col("m").alias("a")))
        e = staged(small.where("a < b").select("a", "b").distinct(), "edges")
        now = e.agg(F.count("*"), F.sum(F.xxhash64("a", "b").cast("decimal(38,0)"))).first()
        if now == before:
            break
        before = now
    stars = e.groupBy(F.col("b").alias("id")).agg(F.min("a").alias("component"))
    return stars.union(e.select(F.col("a").alias("id"), F.col("a").alias("component")).distinct())


#: Odd multipliers of the 64-bit mixers (fixed values).
MIX_A, MIX_B = np.uint64(0x9E3779B97F4A7C15), np.uint64(0xC2B2AE3D27D4EB4F)


def mix64(x: np.ndarray) -> np.ndarray:
    """A bijection on 64-bit numbers that scatters them."""
    x = x ^ (x >> np.uint64(32))
    x = x * MIX_A
    x = x ^ (x >> np.uint64(29))
    x = x * MIX_B
    return x ^ (x >> np.uint64(32))


#: Every byte with A-Z lower-cased.
lowered = np.arange(256, dtype=np.uint8)
lowered[65:91] += 32


def word_bytes(ranges: list[tuple[int, int]]) -> np.ndarray:
    """By raw byte: whether it, lower-cased, lies in one of the half-open ranges."""
    inside = np.zeros(256, bool)
    for a, b in ranges:
        inside[a:b] = True
    return inside[lowered]


#: Words that are hashed at a time.
WORDS_AT_ONCE = 1 << 16


class Words:
    """The words of a string column, as maximal runs of the given bytes within a row.

    begin and end are bytes of the column's data (raw), hash is of the lower-cased bytes; row n has the
    words first[n] to first[n + 1] and the bytes offsets[n] to offsets[n + 1]. Null rows have none.
    """

    def __init__(self, column: pa.Array, letters: np.ndarray):
        n = len(column)
        column = column.cast(pa.large_string()).fill_null("")
        offsets = np.frombuffer(column.buffers()[1], np.int64)[column.offset : column.offset + n + 1]
        data = column.buffers()[2]
        raw = np.frombuffer(data, np.uint8)[offsets[0] : offsets[-1]] if data is not None and n else np.zeros(0, np.uint8)
        self.raw, self.offsets = raw, offsets - offsets[0]
        inside = np.append(letters[raw], False)
        begins, ends = inside.copy(), inside.copy()
        begins[1:] &= ~inside[:-1]
        ends[:-1] &= ~inside[1:]
        cut = self.offsets[1:-1]
        cut = cut[(cut > 0) & (cut < len(raw))]
        begins[cut] |= inside[cut]
        ends[cut - 1] |= inside[cut - 1]
        self.begin, self.end = np.flatnonzero(begins), np.flatnonzero(ends) + 1
        length = self.end - self.begin
        self.hash = np.zeros(len(length), np.uint64)
        if len(length):
            power = np.cumprod(np.full(int(length.max()), 0x5851F42D4C957F2D, np.uint64))
            for i in range(0, len(length), WORDS_AT_ONCE):  # numbers by byte are eight times the text
                n = length[i : i + WORDS_AT_ONCE]
                a, z = self.begin[i], self.end[i + len(n) - 1]
                letters_of = lowered[raw[a:z][inside[a:z]]].astype(np.uint64) + np.uint64(1)
                at = np.cumsum(n) - n
                letters_of *= power[np.arange(len(letters_of)) - np.repeat(at, n)]
                self.hash[i : i + len(n)] = mix64(np.add.reduceat(letters_of, at) + n.astype(np.uint64))
        self.first = np.searchsorted(self.begin, self.offsets)
