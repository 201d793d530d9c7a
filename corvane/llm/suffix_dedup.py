"""Exact substring deduplication with column-wise multi-document suffix sorting.

Every byte goes that is covered by a string of LENGTH bytes which also starts earlier (smaller identifier,
or further left in the same document). Matches never cross documents.

1. Each window of LENGTH bytes selects the least hash of its GRAM-byte strings, leftmost first; neighbouring
   windows with the same selection are a segment. Equal windows select alike, so they lie in segments of the
   same selected hash. About one row for 35 bytes is shuffled, whatever the text.
2. Segments are dealt and sorted by selected hash, content hash and place, and streamed: all but the first of
   equal segments go. Where a selected hash has different segments, the first of each kind may still share
   windows with the others. A selected hash that makes up a thousandth of all segments (there are a thousand
   such at most) is salted by document; the firsts of its salts are then settled among themselves.
3. Those segments are cut from their texts and dealt by a longer context of the selected string, which every
   window on that side of it contains. Blocks of them are suffix-sorted column by column: each round inserts
   one symbol of every segment, from the last to the first, at the place that the collection's
   Burrows-Wheeler transform gives, and updates transform and common prefixes in one sequential rewrite.
   Suffixes with a common prefix of LENGTH or more are equal windows; all but the earliest go.
4. The ranges are brought to their documents, checked there by content hash, united and cut out.

Transform and common prefixes are rewritten in memory, block by block, not in files on local disks, which
other executors would not see. Null text is empty. Null identifiers come first; rows that share an
identifier count as one place each, ranges of one being checked against the other's bytes. Extra columns are
ignored. Texts are taken whole. An empty table gives an empty table. Of the parts of one context a task holds
the different ones only.
"""

from __future__ import annotations

import hashlib
from collections.abc import Iterator

import numpy as np
import pyarrow as pa
import pyarrow.compute as pc
import xxhash
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from corvane.llm.bpe_replay import blocks
from corvane.llm.common import mix64, staged

LENGTH, GRAM = 100, 32
SPAN = LENGTH - GRAM  # windows select among SPAN + 1 strings
HALF = SPAN // 2
SORT_BYTES, TEXT_BYTES = 3 << 20, 4 << 20
HOT_SHARE, SALTS, SEEN_IN_BLOCK = 1000, 64, 4
_byte = mix64(np.arange(1, 257, dtype=np.uint64))
_mul = mix64(np.arange(1000, 1020, dtype=np.uint64)) | np.uint64(1)


def bytes_of(column: pa.Array) -> tuple[np.ndarray, np.ndarray]:
    """All bytes of a string column, and where each row begins and the last one ends."""
    n = len(column)
    column = column.cast(pa.large_string()).fill_null("")
    offsets = np.frombuffer(column.buffers()[1], np.int64)[column.offset : column.offset + n + 1]
    data = column.buffers()[2]
    raw = np.frombuffer(data, np.uint8)[offsets[0] : offsets[-1]] if data is not None and n else np.zeros(0, np.uint8)
    return raw, offsets - offsets[0]


def doubled(raw: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    """Hashes of the 32 and 64 bytes that begin at each place."""
    h, step, at_32 = _byte[raw], 1, None
    while step < 64 and len(h) > step:
        right = h[step:]
        h = h[:-step] * _mul[2 * step.bit_length()] + (right ^ (right >> np.uint64(29))) * _mul[2 * step.bit_length() + 1]
        step *= 2
        if step == 32:
            at_32 = h
    return (at_32 if at_32 is not None else h[:0]), (h if step == 64 else h[:0])


def content(h64: np.ndarray, start: np.ndarray, size: np.ndarray) -> np.ndarray:
    """A hash of each range of 64 to 192 bytes."""
    last = start + size - 64
    x = mix64(h64[start] + size.astype(np.uint64))
    x = mix64(x + h64[np.minimum(start + 64, last)])
    return mix64(x + h64[last])


def segments(column: pa.Array) -> tuple[np.ndarray, ...]:
    """(row, start, size, anchor: where in the segment the selected string begins, mark: its hash, content)."""
    raw, offsets = bytes_of(column)
    empty = np.zeros(0, np.int64)
    if len(raw) < LENGTH:
        return empty, empty, empty, empty, empty.astype(np.uint64), empty.astype(np.uint64)
    h32, h64 = doubled(raw)
    low = mix64(h32)
    mark, at = low, np.arange(len(low), dtype=np.int32)
    step = 1
    while step < SPAN + 1:
        shift = min(step, SPAN + 1 - step)
        left = low[:-shift] <= low[shift:]
        low, at = np.where(left, low[:-shift], low[shift:]), np.where(left, at[:-shift], at[shift:])
        step += shift
    size = np.diff(offsets)
    whole = np.maximum(size - LENGTH + 1, 0)
    row = np.repeat(np.arange(len(size)), whole)
    p = np.arange(len(row)) - np.repeat(np.cumsum(whole) - whole, whole) + offsets[row]
    chosen = at[p]
    begin = np.flatnonzero(np.concatenate([[True], chosen[1:] != chosen[:-1]])) if len(p) else empty
    end = np.append(begin[1:], len(p)) - 1 if len(p) else empty
    first, last = p[begin], p[end]
    return row[begin], first - offsets[row[begin]], last + LENGTH - first, chosen[begin] - first, mark[chosen[begin]], content(h64, first, last + LENGTH - first)


def frequent_marks(docs: DataFrame) -> list[int]:
    """The selected hashes of at least a HOT_SHARE-th of all segments, so HOT_SHARE of them at most.

    Blocks report what they have several times; a hash so frequent has many in each block that it is in.
    """

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for b in blocks(batches, limit=TEXT_BYTES):
            mark, n = np.unique(segments(b.column("text"))[4].view(np.int64), return_counts=True)
            often = n >= SEEN_IN_BLOCK
            yield pa.RecordBatch.from_arrays([pa.array([None, *mark[often].tolist()], pa.int64()), pa.array([int(n.sum()), *n[often].tolist()], pa.int64())], names=["mark", "n"])

    counts = staged(docs.select("text").mapInArrow(run, "mark long, n long").groupBy("mark").agg(F.sum("n").alias("n")), "marks")
    total = counts.where("mark is null").agg(F.sum("n")).first()[0] or 0
    return [r["mark"] for r in counts.where((F.col("mark").isNotNull()) & (F.col("n") * HOT_SHARE >= total)).collect()]


def marked(docs: DataFrame, hot: list[int]) -> DataFrame:
    """All segments; salt is 0, or from 1 for those of hot hashes."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for b in blocks(batches, limit=TEXT_BYTES):
            row, start, size, anchor, mark, h = segments(b.column("text"))
            mark, place = mark.view(np.int64), pc.fill_null(b.column("id"), 0).to_numpy().astype(np.uint64)[row]
            salt = np.where(np.isin(mark, hot), 1 + mix64(place) % np.uint64(SALTS), 0)
            yield pa.RecordBatch.from_arrays(
                [b.column("id").take(pa.array(row)), pa.array(start.astype(np.int32)), pa.array(size.astype(np.int16)), pa.array(anchor.astype(np.int16)), pa.array(mark), pa.array(salt.astype(np.int16)), pa.array(h.view(np.int64))],
                names=["id", "start", "size", "anchor", "mark", "salt", "h"],
            )

    return docs.mapInArrow(run, "id long, start int, size short, anchor short, mark long, salt short, h long")


KIND = ["id", "start", "size", "anchor", "mark", "salt", "h"]


def split_kinds(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    """Of rows sorted by mark, salt, h and place: repeats (whole), and the first of each kind where a mark has several kinds or is salted."""
    last_mark = last_h = held = None
    several = False
    for b in batches:
        if not b.num_rows:
            continue
        mark, salt, h = (b.column(c).to_numpy() for c in ("mark", "salt", "h"))
        new_mark = np.concatenate([[(mark[0], salt[0]) != last_mark], (mark[1:] != mark[:-1]) | (salt[1:] != salt[:-1])])
        new_kind = new_mark | np.concatenate([[h[0] != last_h], h[1:] != h[:-1]])
        group = np.cumsum(new_mark)  # 0: goes on from the batch before
        kinds = np.bincount(group[new_kind], minlength=group[-1] + 1)
        if not new_mark[0]:
            kinds[0] += 2 if several else 1
            if held is not None and kinds[0] > 1:
                yield held
        if new_mark[0] or kinds[0] > 1:
            held = None
        rows = np.flatnonzero(~new_kind | (kinds[group] > 1) | (salt > 0))
        if len(rows):
            yield _kind(b.take(pa.array(rows)), ~new_kind[rows])
        several = kinds[group[-1]] > 1 or salt[-1] > 0
        if new_mark.any():
            held = None if several else _kind(b.slice(int(np.flatnonzero(new_mark)[-1]), 1), np.array([False]))
        last_mark, last_h = (mark[-1], salt[-1]), h[-1]


def _kind(b: pa.RecordBatch, whole: np.ndarray) -> pa.RecordBatch:
    return pa.RecordBatch.from_arrays([*(b.column(c) for c in KIND), pa.array(whole)], names=[*KIND, "whole"])


def settled(kinds: DataFrame) -> DataFrame:
    """kinds with the firsts of salts settled: the first of all stays a first, if its mark has several kinds; others are repeats."""
    firsts = kinds.where("salt > 0 and not whole")
    best = firsts.groupBy("mark", "h").agg(F.min(F.struct("id", "start")).alias("best"))
    several = best.groupBy("mark").agg(F.count("*").alias("n")).where("n > 1").select("mark", F.lit(True).alias("several"))
    both = firsts.join(best, ["mark", "h"]).join(F.broadcast(several), "mark", "left")
    later = ~F.struct("id", "start").eqNullSafe(F.col("best"))
    kept = both.where(later | F.col("several")).select(*KIND, later.alias("whole"))
    return kinds.where("salt = 0 or whole").unionByName(kept)


def cut_out(docs: DataFrame, kinds: DataFrame) -> DataFrame:
    """The bytes of those segments, once for the windows that reach far to the left of the selected string and once for the others."""
    wanted = kinds.groupBy("id").agg(F.collect_list(F.struct("start", "size", "anchor", "h")).alias("cuts"))
    near = docs.join(wanted, docs["id"].eqNullSafe(wanted["id"])).select(docs["id"], "text", "cuts")

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for b in blocks(batches, limit=TEXT_BYTES):
            out: dict[str, list] = {c: [] for c in ("id", "start", "size", "h", "skip", "key", "part")}
            for i, text, cuts in zip(b.column("id").to_pylist(), b.column("text").to_pylist(), b.column("cuts").to_pylist(), strict=True):
                raw = (text or "").encode()
                for c in cuts:
                    s, n, a = c["start"], c["size"], c["anchor"]
                    piece, windows = raw[s : s + n], n - LENGTH + 1
                    if len(piece) < n:
                        continue  # another row's, with the same identifier
                    left = min(windows, a - HALF + 1)
                    for lo, hi, seed, context in ((0, left, 1, piece[a - HALF : a + GRAM] if left > 0 else b""), (max(0, left), windows, 2, piece[a : a + GRAM + SPAN - HALF])):
                        if hi > lo:
                            for column, x in zip(out.values(), (i, s, n, c["h"], lo, xxhash.xxh64_intdigest(context, seed) - (1 << 63), piece[lo : hi - 1 + LENGTH]), strict=True):
                                column.append(x)
            types = (pa.int64(), pa.int32(), pa.int16(), pa.int64(), pa.int16(), pa.int64(), pa.binary())
            yield pa.RecordBatch.from_arrays([pa.array(x, t) for x, t in zip(out.values(), types, strict=True)], names=list(out))

    return near.mapInArrow(run, "id long, start int, size short, h long, skip short, key long, part binary")


def column_sort(parts: list[bytes]) -> tuple[np.ndarray, np.ndarray]:
    """The Burrows-Wheeler transform (0: end) and common prefixes of all suffixes of parts, ends in order of parts.

    UTF-8 has no byte 255, so symbols are bytes plus 1. Round j inserts the suffixes of j symbols: that of a
    part stands among those with its first symbol as often as the symbol stands in the transform before the
    part's last suffix. Its common prefix with the neighbour before it is one more than the least one between
    the two places of that symbol.
    """
    m, size = len(parts), np.array([len(x) for x in parts])
    flat = np.frombuffer(b"".join(parts), np.uint8) + np.uint8(1)
    end = np.cumsum(size)
    bwt = np.where(size > 0, flat[end - 1], 0).astype(np.uint8)
    lcp = np.zeros(m, np.uint8)
    live = np.flatnonzero(size > 0)
    place = live.copy()
    for j in range(1, int(size.max()) + 1):
        order = np.argsort(bwt, kind="stable")  # radix
        zeros = len(bwt) - int(np.count_nonzero(bwt))
        to = np.empty(len(bwt), np.int64)
        to[order] = np.arange(len(bwt)) - zeros + m
        new = to[place]
        # the places of the same symbol before and after
        rank = new - m + zeros
        symbol = bwt[place]
        before = order[np.maximum(rank - 1, 0)]
        same = (rank > 0) & (bwt[before] == symbol)
        follow = order[np.minimum(rank + 1, len(bwt) - 1)]
        same_after = (rank + 1 < len(bwt)) & (bwt[follow] == symbol)
        own = _least(lcp, before, place, same)
        nxt = _least(lcp, place, follow, same_after)
        ordered = np.argsort(new, kind="stable")
        at = new[ordered]
        follows = np.where(size[live] > j, flat[end[live] - np.minimum(j + 1, size[live])], 0).astype(np.uint8)
        grown, grown_lcp = np.empty(len(bwt) + len(at), np.uint8), np.empty(len(bwt) + len(at), np.uint8)
        old = np.ones(len(grown), bool)
        old[at] = False
        grown[old], grown_lcp[old] = bwt, lcp
        grown[at], grown_lcp[at] = follows[ordered], own[ordered]
        after = at + 1
        inside = after < len(grown)
        grown_lcp[after[inside]] = np.where(old[after[inside]], nxt[ordered][inside], grown_lcp[after[inside]])
        bwt, lcp = grown, grown_lcp
        stay = size[live] > j
        live, place = live[stay], new[stay]
    return bwt, lcp


def _least(lcp: np.ndarray, a: np.ndarray, b: np.ndarray, valid: np.ndarray) -> np.ndarray:
    """1 + min(lcp[a + 1 .. b]) where valid, else 0."""
    out = np.zeros(len(a), np.uint8)
    k = np.flatnonzero(valid)
    if len(k):
        k = k[np.argsort(a[k], kind="stable")]
        pairs = np.stack([a[k] + 1, b[k] + 1], axis=1).ravel()
        out[k] = np.minimum.reduceat(np.append(lcp, np.uint8(255)), pairs)[::2] + np.uint8(1)
    return out


def suffix_places(bwt: np.ndarray, size: np.ndarray) -> Iterator[tuple[np.ndarray, int, np.ndarray]]:
    """(parts, j, places of their suffixes of j symbols), walking from the ends."""
    m = len(size)
    order = np.argsort(bwt, kind="stable")
    to = np.empty(len(bwt), np.int64)
    to[order] = np.arange(len(bwt))  # the m ends come first, as every part has one 0
    live, place = np.arange(m), np.arange(m)
    for j in range(1, int(size.max()) + 1):
        stay = size[live] >= j
        live, place = live[stay], to[place[stay]]
        yield live, j, place


def repeated_windows(parts: list[bytes], order: np.ndarray, length: int = LENGTH) -> list[list[tuple[int, int]]]:
    """For each part, the ranges covered by windows that also occur at a place of lower order.

    order: for each part, where its first byte stands in the order of all places; windows follow in step.
    """
    size = np.array([len(x) for x in parts])
    bwt, lcp = column_sort(parts)
    group = np.cumsum(lcp < length)
    many = np.bincount(group) > 1
    part, offset, of = [], [], []
    for live, j, place in suffix_places(bwt, size):
        if j >= length:
            some = many[group[place]]
            part.append(live[some])
            offset.append(size[live[some]] - j)
            of.append(group[place[some]])
    out: list[list[tuple[int, int]]] = [[] for _ in parts]
    if not part:
        return out
    part, offset, of = np.concatenate(part), np.concatenate(offset), np.concatenate(of)
    by = np.lexsort((offset, order[part], of))
    later = np.concatenate([[False], of[by][1:] == of[by][:-1]])
    part, offset = part[by][later], offset[by][later]
    by = np.lexsort((offset, part))
    for i, o in zip(part[by].tolist(), offset[by].tolist(), strict=True):
        if out[i] and out[i][-1][1] >= o:
            out[i][-1] = (out[i][-1][0], o + length)
        else:
            out[i].append((o, o + length))
    return out


def sort_blocks(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    """Rows come sorted by key, part and place: all but the first of equal parts go at once, others are gathered by whole keys until a block is full."""
    rows: list[tuple] = []
    out: list[tuple] = []
    size, last = 0, (None, None)

    def done() -> None:
        counts: dict[int, int] = {}
        for r in rows:
            counts[r[5]] = counts.get(r[5], 0) + 1
        kept = [r for r in rows if counts[r[5]] > 1]
        # places in order: null identifiers first
        if kept:
            place = sorted(range(len(kept)), key=lambda n: (kept[n][0] is not None, kept[n][0] or 0, kept[n][1] + kept[n][4]))
            order = np.empty(len(kept), np.int64)
            order[place] = np.arange(len(kept))
            # two parts of the same document may overlap, and then the earlier start comes first as well
            for r, ranges in zip(kept, repeated_windows([r[6] for r in kept], order), strict=True):
                out.extend((*r[:4], r[4] + a, r[4] + b) for a, b in ranges)

    def made() -> pa.RecordBatch:
        types = (pa.int64(), pa.int32(), pa.int16(), pa.int64(), pa.int16(), pa.int16())
        return pa.RecordBatch.from_arrays([pa.array(x, t) for x, t in zip(zip(*out, strict=True), types, strict=True)], names=["id", "start", "size", "h", "lo", "hi"])

    for b in batches:
        for r in zip(*(b.column(c).to_pylist() for c in ("id", "start", "size", "h", "skip", "key", "part")), strict=True):
            if (r[5], r[6]) == last:
                out.append((*r[:4], r[4], r[4] + len(r[6])))
                continue
            if size >= SORT_BYTES and r[5] != last[0]:
                done()
                rows, size = [], 0
            last = (r[5], r[6])
            rows.append(r)
            size += len(r[6])
        if out:
            yield made()
            out = []
    done()
    if out:
        yield made()


def ranges(docs: DataFrame) -> DataFrame:
    """(id, cuts: start, size, h, lo, hi) of docs (id, text): the byte ranges that go, by segment."""
    hot = frequent_marks(docs)
    dealt = marked(docs, hot).repartition(F.col("mark"), F.col("salt")).sortWithinPartitions("mark", "salt", "h", "id", "start")
    kinds = staged(dealt.mapInArrow(split_kinds, "id long, start int, size short, anchor short, mark long, salt short, h long, whole boolean"), "kinds")
    kinds = staged(settled(kinds), "kinds") if hot else kinds
    parts = cut_out(docs, kinds.where("not whole")).repartition(F.col("key")).sortWithinPartitions("key", "part", "id", "start")
    shared = parts.mapInArrow(sort_blocks, "id long, start int, size short, h long, lo short, hi short")
    whole = kinds.where("whole").select("id", "start", "size", "h", F.lit(0).cast("short").alias("lo"), F.col("size").alias("hi"))
    cuts = staged(whole.union(shared), "cuts")
    return cuts.groupBy("id").agg(F.collect_list(F.struct("start", "size", "h", "lo", "hi")).alias("cuts"))


def spans_of(raw: bytes, cuts: list[dict]) -> list[tuple[int, int]]:
    """The maximal ranges that go, of cuts whose segment this text has."""
    if not cuts:
        return []
    start, size, h, lo, hi = (np.array([c[k] for c in cuts], np.int64) for k in ("start", "size", "h", "lo", "hi"))
    h64 = doubled(np.frombuffer(raw, np.uint8))[1]
    ok = start + size <= len(raw)
    start, size, h, lo, hi = (x[ok] for x in (start, size, h, lo, hi))
    ok = content(h64, start, size).view(np.int64) == h if len(start) else ok[:0]
    delta = np.zeros(len(raw) + 1, np.int64)
    np.add.at(delta, (start + lo)[ok], 1)
    np.add.at(delta, (start + hi)[ok], -1)
    gone = np.cumsum(delta) > 0
    edge = np.flatnonzero(np.diff(np.concatenate([[False], gone])))
    return [(int(a), int(b)) for a, b in edge.reshape(-1, 2)]


def digests(docs: DataFrame) -> DataFrame:
    """Per document: n_bytes, n_removed, n_spans, kept_sha256."""
    texts = docs.select(F.col("doc_id").cast("long").alias("id"), "text")
    cuts = ranges(texts).withColumnRenamed("id", "_id")
    both = texts.join(cuts, F.col("id").eqNullSafe(F.col("_id")), "left").select("id", "text", "cuts")

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for b in blocks(batches, limit=TEXT_BYTES):
            out = []
            for text, cut in zip(b.column("text").to_pylist(), b.column("cuts").to_pylist(), strict=True):
                raw = (text or "").encode()
                spans = spans_of(raw, cut)
                edges = [0, *(x for s in spans for x in s), len(raw)]
                kept = b"".join(raw[a:z] for a, z in zip(edges[::2], edges[1::2], strict=True))
                out.append((len(raw), len(raw) - len(kept), len(spans), hashlib.sha256(kept).hexdigest()))
            columns = list(zip(*out, strict=True)) or [(), (), (), ()]
            yield pa.RecordBatch.from_arrays([b.column("id"), *(pa.array(x, t) for x, t in zip(columns, (pa.int64(), pa.int64(), pa.int64(), pa.string()), strict=True))], names=["doc_id", "n_bytes", "n_removed", "n_spans", "kept_sha256"])

    return both.mapInArrow(run, "doc_id long, n_bytes long, n_removed long, n_spans long, kept_sha256 string")


def op5_suffix_dedup(spark: SparkSession, sf_dir: str) -> DataFrame:
    return digests(spark.read.parquet(f"{sf_dir}/documents.parquet"))
