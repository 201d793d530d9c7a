"""Near-duplicate documents by circulant MinHash.

Two permutations of the 32-bit numbers make every signature coordinate: sigma scatters a shingle once, and
coordinate k is the least value of pi over the scattered shingles, circularly shifted by k. Bands of ROWS
coordinates deal documents into buckets; candidates are confirmed on the full shingle sets.

1. Documents with equal sets are one class; its vertex is its smallest identifier.
2. A bucket is dealt into parts of at most about PART classes, each with the bucket's centre. A part's candidates
   are its pairs that agree in AGREE coordinates or more (on the low bytes of the coordinates, which agree
   wherever the coordinates do). A part passes on their heaviest spanning forest, fewer links than rows, and
   parts of up to SMALL classes all their pairs. These are confirmed on the full sets and united.
3. Where a link of a forest was not confirmed, or a bucket had several parts, candidates may be left that are
   still apart. Classes outside the bucket's main component meet all others of the bucket, block against block.
   Only those with a candidate partner in another component bring their sets; the pairs are verified there
   and then, each in the first bucket that it shares, and a block passes on the links that unite something.
4. Links are united by union-find or alternating stars.

So every candidate pair is either confirmed, refuted on full sets, or united by other links; no bucket is capped,
and no step lists the pairs of a bucket. With BANDS = 32 and ROWS = 5, a pair at similarity 0.75 shares no bucket once in 5,800 times
(at 0.8 once in 330,000), and agrees in less than AGREE = 90 coordinates of 160 less than once in a million times.

Null or empty texts, and texts without words, have an empty set and link with nothing; rows with a null
identifier link with nothing and keep a null component. Texts are taken whole. Rows with one identifier are one
vertex, whatever their texts: what one of them links with, all do that have words. Extra columns are ignored. An empty table
gives an empty table.
"""

from __future__ import annotations

from collections.abc import Iterator

import numpy as np
import pyarrow as pa
import pyarrow.compute as pc
import xxhash
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from corvane.llm.bpe_replay import blocks, give_back
from corvane.llm.common import Unions, Words, components, in_batches, mix64, sent_if_few, staged, word_bytes

WIDTH, BANDS, ROWS, AGREE = 5, 32, 5, 90
#: Classes of a bucket's part, of a part whose pairs are all listed, of a block.
PART, SMALL, BLOCK = 128, 4, 512
#: Rows that are looked at at a time.
SLICE = 2048
SHARE, OF = 75, 100
#: All but white space, that is but 0x20 and 0x09-0x0D.
LETTERS = word_bytes([(0, 9), (14, 32), (33, 256)])


def permute32(x: np.ndarray, a: int, b: int) -> np.ndarray:
    """A bijection on 32-bit numbers for odd a and b."""
    x = x ^ (x >> np.uint32(16))
    x *= np.uint32(a)
    x ^= x >> np.uint32(13)
    x *= np.uint32(b)
    x ^= x >> np.uint32(16)
    return x


def shingle_sets(column: pa.Array, width: int = WIDTH) -> list[np.ndarray]:
    """Each row's distinct shingles, as sorted 64-bit hashes."""
    w, out = Words(column, LETTERS), []
    weight = mix64(np.arange(1, width + 1, dtype=np.uint64)) | np.uint64(1)
    n = len(w.hash)
    rolled = np.zeros(max(0, n - width + 1), np.uint64)
    for k in range(width if len(rolled) else 0):
        rolled += w.hash[k : n - width + 1 + k] * weight[k]
    rolled = mix64(rolled)
    for a, b in zip(w.first[:-1].tolist(), w.first[1:].tolist(), strict=True):
        if b - a >= width:
            out.append(np.unique(rolled[a : b - width + 1]))
        elif b > a:
            out.append(mix64(np.array([np.sum(w.hash[a:b] * weight[: b - a]) + np.uint64(b - a)], np.uint64)))
        else:
            out.append(np.zeros(0, np.uint64))
    return out


def signature(shingles: np.ndarray, size: int) -> np.ndarray:
    """Circulant MinHash: coordinate k is min(pi(sigma(shingle) + k))."""
    x = permute32((shingles ^ (shingles >> np.uint64(32))).astype(np.uint32), 0x85EBCA6B, 0xC2B2AE35)
    shift, out = np.arange(size, dtype=np.uint32), np.full(size, 0xFFFFFFFF, np.uint32)
    for i in range(0, len(x), 1024):
        out = np.minimum(out, permute32(x[i : i + 1024, None] + shift, 0x9E3779B1, 0x27D4EB2F).min(axis=0))
    return out


def band_keys(sig: np.ndarray, bands: int, rows: int) -> np.ndarray:
    """A 64-bit key for each signature (row) and band."""
    cut = sig.reshape(len(sig), bands, rows).astype(np.uint64)
    key = np.broadcast_to(mix64(np.arange(1, bands + 1, dtype=np.uint64)), (len(sig), bands))
    for r in range(rows):
        key = mix64(key ^ (cut[:, :, r] + (np.uint64(r + 1) << np.uint64(32))))
    return key.astype(np.int64)


def numbers(column: pa.ChunkedArray | pa.Array, kind: str) -> np.ndarray:
    """Binary values of one length as rows of numbers."""
    values = column.to_pylist()
    return np.frombuffer(b"".join(values), kind).reshape(len(values), -1)


def sketches(docs: DataFrame, width: int, size: int) -> DataFrame:
    """(id, n_shingles, class: digest of the set, sig) of docs (id, text)."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for b in blocks(batches):
            sets = shingle_sets(b.column("text"), width)
            yield pa.RecordBatch.from_arrays(
                [
                    b.column("id"),
                    pa.array([len(s) for s in sets], pa.int64()),
                    pa.array([xxhash.xxh3_128_digest(s.tobytes()) for s in sets], pa.binary()),
                    pa.array([signature(s, size).tobytes() if len(s) else b"" for s in sets], pa.binary()),
                ],
                names=["id", "n_shingles", "class", "sig"],
            )

    return in_batches(docs).mapInArrow(run, "id long, n_shingles long, class binary, sig binary")


def in_buckets(classes: DataFrame, bands: int, rows: int) -> DataFrame:
    """(c, bucket): each class once for each band."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for b in batches:
            if b.num_rows:
                keys = band_keys(numbers(b.column("sig"), "<u4"), bands, rows).reshape(-1)
                yield pa.RecordBatch.from_arrays([pa.array(np.repeat(b.column("c").to_numpy(), bands)), pa.array(keys)], names=["c", "bucket"])

    return classes.select("c", "sig").mapInArrow(run, "c long, bucket long")


def low_bytes(classes: DataFrame) -> DataFrame:
    """(c, n_shingles, sig) with the low byte of each coordinate only."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for b in batches:
            if b.num_rows:
                low = [x.tobytes() for x in numbers(b.column("sig"), "<u4").astype(np.uint8)]
                yield pa.RecordBatch.from_arrays([b.column("c"), b.column("n_shingles"), pa.array(low, pa.binary())], names=["c", "n_shingles", "sig"])

    return classes.select("c", "n_shingles", "sig").mapInArrow(run, "c long, n_shingles long, sig binary")


def full_sets(docs: DataFrame, width: int) -> DataFrame:
    """(id, class, shingles) of docs (id, text)."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for b in blocks(batches):
            sets = shingle_sets(b.column("text"), width)
            digests = pa.array([xxhash.xxh3_128_digest(s.tobytes()) for s in sets], pa.binary())
            yield pa.RecordBatch.from_arrays([b.column("id"), digests, pa.array([s.astype(np.int64) for s in sets], pa.list_(pa.int64()))], names=["id", "class", "shingles"])

    return docs.mapInArrow(run, "id long, class binary, shingles array<long>")


def confirm(pairs: DataFrame, sets: DataFrame, share: int, of: int) -> DataFrame:
    """Those pairs (x, y) whose sets are similar enough."""
    both = pairs.join(sets.select(F.col("c").alias("x"), F.col("shingles").alias("xs")), "x").join(sets.select(F.col("c").alias("y"), F.col("shingles").alias("ys")), "y")
    common = F.size(F.array_intersect("xs", "ys"))
    return both.where(of * common >= share * (F.size("xs") + F.size("ys") - common)).select("x", "y")


def whole_groups(batches: Iterator[pa.RecordBatch], keys: list[str]) -> Iterator[tuple[pa.Table, np.ndarray]]:
    """Tables of whole groups of the sorted rows, with the groups' first rows and the end."""
    held: list[pa.RecordBatch] = []

    def cut(t: pa.Table) -> np.ndarray:
        k = np.stack([t.column(c).to_numpy() for c in keys])
        return np.concatenate([[0], np.flatnonzero((k[:, 1:] != k[:, :-1]).any(axis=0)) + 1, [t.num_rows]])

    for whole in batches:
        # small slices, so that a copy of one is small as well, however long the rows are
        for k in range(0, whole.num_rows, SLICE):
            t = pa.Table.from_batches([*held, whole.slice(k, SLICE)])
            at = cut(t)
            if len(at) > 2:
                yield t.slice(0, at[-2]).combine_chunks(), at[:-1]
            held = t.slice(at[-2]).combine_chunks().to_batches()
    if held:
        t = pa.Table.from_batches(held)
        yield t, cut(t)
    del held
    give_back()


def agreements(sig: np.ndarray, one: np.ndarray) -> np.ndarray:
    """In how many coordinates each row of sig agrees with one."""
    return np.count_nonzero(sig == one, axis=1)


def spanning(sig: np.ndarray, c: np.ndarray, n: np.ndarray, agree: int, share: int, of: int) -> list[tuple[int, int]]:
    """The heaviest spanning forest of the candidates, as positions; equal weights by a hash of the pair."""
    best, link, left = np.full(len(c), -1, np.int64), np.zeros(len(c), np.int64), np.ones(len(c), bool)
    names, out = mix64(c.astype(np.uint64)), []
    while left.any():
        x = int(np.argmax(np.where(left, best, -2)))
        if best[x] >= 0:
            out.append((int(link[x]), x))
        left[x] = False
        same = agreements(sig, sig[x])
        able = left & (same >= agree) & (of * np.minimum(n, n[x]) >= share * np.maximum(n, n[x]))
        weight = (same.astype(np.int64) << 40) | (mix64(names ^ names[x]) >> np.uint64(24)).astype(np.int64)
        better = able & (weight > best)
        best[better], link[better] = weight[better], x
    return out


def forests(parts: DataFrame, agree: int, small: int, share: int, of: int) -> DataFrame:
    """(bucket, part, x, y, listed): for each part of a bucket, pairs that span its candidates; listed: all of them."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for t, at in whole_groups(batches, ["bucket", "part"]):
            c, n, sig = t.column("c").to_numpy(), t.column("n_shingles").to_numpy(), numbers(t.column("sig"), "u1")
            size = np.diff(at)
            group = np.repeat(np.arange(len(size)), size)
            few = size[group] <= small
            found = [np.zeros((2, 0), np.int64)]
            for d in range(1, min(small, len(c))):
                i = np.flatnonzero((group[:-d] == group[d:]) & few[:-d])
                i = i[of * np.minimum(n[i], n[i + d]) >= share * np.maximum(n[i], n[i + d])]
                i = i[np.count_nonzero(sig[i] == sig[i + d], axis=1) >= agree]
                found.append(np.stack([i, i + d]))
            for g in np.flatnonzero(size > small).tolist():
                s, e = at[g], at[g + 1]
                if pairs := spanning(sig[s:e], c[s:e], n[s:e], agree, share, of):
                    found.append(np.array(pairs, np.int64).T + s)
            i, j = np.concatenate(found, axis=1)
            columns = [t.column("bucket").to_numpy()[i], t.column("part").to_numpy()[i], np.minimum(c[i], c[j]), np.maximum(c[i], c[j]), few[i]]
            yield pa.RecordBatch.from_arrays([pa.array(v) for v in columns], names=["bucket", "part", "x", "y", "listed"])

    return parts.repartition("bucket", "part").sortWithinPartitions("bucket", "part", "c").mapInArrow(run, "bucket long, part int, x long, y long, listed boolean")


def partners(t: pa.Table, s: int, e: int, agree: int, bands: int, share: int, of: int) -> Iterator[tuple[int, np.ndarray]]:
    """For rows s to e of a block pair: positions x, and those after it that are candidates in another component.

    Stray rows meet the others, or each other where all are stray. A pair counts in the first bucket it shares.
    """
    own = t.slice(s, e - s)
    now, n, stray, bucket = (own.column(k).to_numpy() for k in ("now", "n_shingles", "stray", "bucket"))
    sig, side = numbers(own.column("sig"), "<u4"), own.column("side").to_numpy()
    kind = own.column("kind")[0].as_py()
    sides = own.column("p")[0].as_py() != own.column("q")[0].as_py()
    rows = sig.shape[1] // bands
    keys = band_keys(sig, bands, rows)
    band = int(np.flatnonzero((keys == bucket[:, None]).all(axis=0))[0])
    cut = sig.reshape(len(sig), bands, rows)[:, :band]
    for x in np.flatnonzero(stray).tolist():
        able = (now != now[x]) & (of * np.minimum(n, n[x]) >= share * np.maximum(n, n[x]))
        if kind:  # among strays
            able &= side != side[x] if sides else True
            able[: x + 1] = False
        else:
            able &= ~stray
        y = np.flatnonzero(able)
        y = y[agreements(sig[y], sig[x]) >= agree]
        y = y[~(cut[y] == cut[x]).all(axis=2).any(axis=1)]
        if len(y):
            yield x, y


BLOCK_KEYS = ["bucket", "kind", "p", "q"]


def restless(dealt: DataFrame, agree: int, bands: int, share: int, of: int) -> DataFrame:
    """The rows of block pairs that have a candidate in another component."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for t, at in whole_groups(batches, BLOCK_KEYS):
            has = np.zeros(t.num_rows, bool)
            for s, e in zip(at[:-1].tolist(), at[1:].tolist(), strict=True):
                for x, y in partners(t, s, e, agree, bands, share, of):
                    has[s + x] = True
                    has[s + y] = True
            yield from t.filter(pa.array(has)).to_batches()

    return dealt.repartition(*BLOCK_KEYS).sortWithinPartitions(*BLOCK_KEYS, "c").mapInArrow(run, dealt.schema)


def uniting(dealt: DataFrame, agree: int, bands: int, share: int, of: int) -> DataFrame:
    """(x, y): verified links between classes of block pairs that are still apart; no more than rows."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for t, at in whole_groups(batches, BLOCK_KEYS):
            links, c, now = [], t.column("c").to_numpy(), t.column("now").to_numpy()
            for s, e in zip(at[:-1].tolist(), at[1:].tolist(), strict=True):
                sets = t.column("shingles").slice(s, e - s)
                size = pc.list_value_length(sets).to_numpy()
                ends = np.concatenate([[0], np.cumsum(size)])
                names, every = np.unique(pc.list_flatten(sets).to_numpy(), return_inverse=True)
                group = Unions()
                for x, ys in partners(t, s, e, agree, bands, share, of):
                    inside = np.zeros(len(names), bool)
                    inside[every[ends[x] : ends[x + 1]]] = True
                    for y in ys.tolist():
                        if (a := group.root(int(now[s + x]))) != (b := group.root(int(now[s + y]))):
                            common = np.count_nonzero(inside[every[ends[y] : ends[y + 1]]])
                            if of * common >= share * (size[x] + size[y] - common):
                                group.up[a] = b
                                links.append((int(c[s + x]), int(c[s + y])))
            x, y = np.array(links, np.int64).reshape(-1, 2).T
            yield pa.RecordBatch.from_arrays([pa.array(x), pa.array(y)], names=["x", "y"])

    return dealt.repartition(*BLOCK_KEYS).sortWithinPartitions(*BLOCK_KEYS, "c").mapInArrow(run, "x long, y long")


def block_pairs(members: DataFrame, block: int) -> DataFrame:
    """members (bucket, c, now, ..) dealt into pairs of blocks: strays (kind 1), and strays with the main component (kind 0)."""
    parts = members.groupBy("bucket", "now").agg(F.count("*").alias("k"))
    parts = parts.groupBy("bucket").agg(F.max(F.struct("k", "now")).alias("most"), F.sum("k").alias("n")).where("n > most.k")
    rows = members.join(parts.select("bucket", F.col("most.now").alias("main"), (F.col("n") - F.col("most.k")).alias("strays"), F.col("most.k").alias("mains")), "bucket")
    rows = rows.withColumn("stray", F.col("now") != F.col("main"))
    sb, mb = F.ceil(F.col("strays") / block).cast("int"), F.ceil(F.col("mains") / block).cast("int")
    k = F.pmod(F.xxhash64("c"), F.when(F.col("stray"), sb).otherwise(mb)).cast("int")
    rows = rows.withColumns({"side": k, "sb": sb, "mb": mb})
    others = lambda n: F.sequence(F.lit(0), F.col(n) - 1)
    place = lambda kind, p, q: F.struct(F.lit(kind).alias("kind"), p.alias("p"), q.alias("q"))
    among = F.transform(others("sb"), lambda o: place(1, F.least("side", o), F.greatest("side", o)))
    across = F.when(F.col("stray"), F.transform(others("mb"), lambda o: place(0, F.col("side"), o))).otherwise(F.transform(others("sb"), lambda o: place(0, o, F.col("side"))))
    places = F.when(F.col("stray"), F.concat(among, across)).otherwise(across)
    return rows.select("bucket", "c", "now", "n_shingles", "sig", "stray", "side", F.explode(places).alias("at")).select("bucket", "at.*", "c", "now", "n_shingles", "sig", "stray", "side")


def near_duplicates(
    docs: DataFrame, *, id_col: str = "doc_id", text_col: str = "text", width: int = WIDTH, share: int = SHARE, of: int = OF, bands: int = BANDS, rows: int = ROWS, agree: int = AGREE, part: int = PART, small: int = SMALL, block: int = BLOCK, digest: bool = False
) -> DataFrame:
    """(id, n_shingles, component_id, kept) for every row; digest: also the set's digest, as class."""
    texts = docs.select(F.col(f"`{id_col}`").cast("long").alias("id"), F.col(f"`{text_col}`").alias("text"))
    sketch = staged(sketches(texts, width, bands * rows), "sketch")
    linked = sketch.where("n_shingles > 0 and id is not null")
    classes = linked.groupBy("class").agg(F.min("id").alias("a"), F.first("n_shingles").alias("n_shingles"), F.first("sig").alias("sig"))
    classes = staged(classes.withColumn("c", F.monotonically_increasing_id()), "classes")  # a number of its own, kept in the file
    buckets = in_buckets(classes, bands, rows)
    sizes = staged(buckets.groupBy("bucket").agg(F.count("*").alias("n"), F.min_by("c", F.xxhash64("c", "bucket")).alias("centre")).where("n > 1"), "sizes")
    shared = staged(buckets.join(sizes, "bucket").select("c", "bucket", "n", "centre"), "shared")
    parts_of = F.ceil(F.col("n") / part).cast("int")
    own = F.when((F.col("c") == F.col("centre")) & (parts_of > 1), F.sequence(F.lit(0), parts_of - 1)).otherwise(F.array(F.pmod(F.xxhash64("c"), parts_of).cast("int")))
    dealt = shared.join(low_bytes(classes), "c").select("bucket", F.explode(own).alias("part"), "c", "n_shingles", "sig")
    spans = staged(forests(dealt, agree, small, share, of), "forests")
    tested = staged(spans.select("x", "y").distinct(), "pairs")
    reps = tested.select(F.explode(F.array("x", "y")).alias("c")).distinct().join(classes.select("c", "a", "class"), "c")
    reps = staged(reps, "classes")

    def sets_of(some: DataFrame) -> DataFrame:
        """(c, shingles) of classes (c, a, class): of one text each, though its identifier be repeated with other texts."""
        ids = sent_if_few(some.select(F.col("a").alias("id")).distinct(), "ids")
        own = texts.join(ids, "id", "left_semi").withColumn("h", F.xxhash64("text")).dropDuplicates(["id", "h"]).select("id", "text")
        return full_sets(own, width).join(some.withColumnRenamed("a", "id"), ["id", "class"]).select("c", "shingles")

    sets = staged(sets_of(reps), "sets")
    links = staged(confirm(tested, sets, share, of), "links")
    vertices = classes.select("c", "a")

    def by_vertex(pairs: DataFrame) -> DataFrame:
        return pairs.join(vertices.select(F.col("c").alias("x"), "a"), "x").join(vertices.select(F.col("c").alias("y"), F.col("a").alias("b")), "y").select("a", "b")

    named = linked.select("id", "class").distinct().join(classes.select("class", "a"), "class")
    twins = named.groupBy("id").agg(F.min("a").alias("low"), F.max("a").alias("high")).where("low <> high").select("id")
    edges = by_vertex(links).union(named.join(twins, "id", "left_semi").select("id", "a"))
    edges = staged(edges.toDF("a", "b"), "edges")
    joined = staged(components(edges), "components")
    # what may still be apart: parts with a refuted link of a forest, and buckets of several parts
    refuted = spans.where("not listed").join(links, ["x", "y"], "left_anti").select("bucket").distinct()
    open_buckets = refuted.union(sizes.where(F.col("n") > part).select("bucket")).distinct()
    members = shared.join(open_buckets, "bucket", "left_semi").select("bucket", "c")
    members = members.join(classes.select("c", "a", "n_shingles", "sig"), "c").join(joined.withColumnRenamed("id", "a"), "a", "left")
    members = staged(members.select("bucket", "c", F.coalesce("component", "a").alias("now"), "n_shingles", "sig"), "members")
    moved = staged(restless(block_pairs(members, block), agree, bands, share, of), "restless")
    if not moved.isEmpty():
        # a class that no forest had brings its set from its text
        late = moved.select("c").distinct().join(reps, "c", "left_anti").join(classes.select("c", "a", "class"), "c")
        more = staged(uniting(moved.join(sets.union(sets_of(late)), "c"), agree, bands, share, of), "links")
        joined = staged(components(edges.union(by_vertex(more))), "components")
    ends = classes.select("class", "a").join(joined.withColumnRenamed("id", "a"), "a", "left").select("class", F.coalesce("component", "a").alias("component"))
    out = sketch.drop("sig").join(ends, "class", "left")
    own_name = F.when(F.col("id").isNotNull(), F.when(F.col("n_shingles") > 0, F.col("component")).otherwise(F.col("id")))
    out = out.select(F.col("id").alias(id_col), "n_shingles", own_name.alias("component_id"), F.coalesce(F.col("id") == own_name, F.lit(True)).alias("kept"), *(["class"] if digest else []))
    return out


def op6_minhash(spark: SparkSession, sf_dir: str) -> DataFrame:
    return near_duplicates(spark.read.parquet(f"{sf_dir}/documents.parquet"))
