"""Benchmark decontamination by an FM-index for each training shard.

A shard is a block of documents. Its words are numbered by the benchmark's vocabulary; runs of such words
that are long enough for the shortest window form the shard's sequence. Over it stand a suffix array, its
Burrows-Wheeler transform in a wavelet matrix with rank directories, and every SAMPLE-th suffix position.
The benchmark's windows are searched backward, all at once; occurrences are located by walking to the next
sampled position; the words of all occurrences in a document are merged into removal spans.

Documents are never shuffled. The benchmark is sent out in blocks of at most BENCH_BYTES bytes of text (or a
single item), one pass over the documents for each block; between passes they are staged and the last block is
taken back, so neither driver nor workers hold more.

Words are compared by a 64-bit hash and their length. Null text has no words; an item without words has no
window; an item of fewer than `width` words is a single window. Repeated items or documents each count.
Extra columns of either table are ignored or kept as they are. Empty tables give no hits or no rows.
"""

from __future__ import annotations

import hashlib
import uuid
from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql.types import ArrayType, IntegerType, LongType, StructField, StructType

from corvane.llm.bpe_replay import blocks
from corvane.llm.common import Words as AnyWords
from corvane.llm.common import in_batches, packed, staged, unpacked, word_bytes

SHARD_BYTES, BENCH_BYTES, SAMPLE = 8 << 20, 8 << 20, 8

#: Word bytes after lower-casing: digits, a-z and all from 0x80 (fixed values).
LETTERS = word_bytes([(48, 58), (97, 123), (128, 256)])


def Words(column: pa.Array) -> AnyWords:  # noqa: N802
    return AnyWords(column, LETTERS)


class Wavelet:
    """A wavelet matrix: rank of symbols in a sequence, a level for each bit, with counts before every 64th place."""

    def __init__(self, seq: np.ndarray, bits: int):
        self.bits, self.levels = bits, []
        for b in range(bits - 1, -1, -1):
            bit = (seq >> b & 1).astype(bool)
            packed = np.zeros((len(seq) // 64 + 1) * 8, np.uint8)
            x = np.packbits(bit, bitorder="little")
            packed[: len(x)] = x
            packed = packed.view("<u8")
            before = np.concatenate([[0], np.cumsum(np.bitwise_count(packed).astype(np.int64))[:-1]])
            self.levels.append((packed, before, int((~bit).sum())))
            seq = np.concatenate([seq[~bit], seq[bit]])

    @staticmethod
    def ones(packed: np.ndarray, before: np.ndarray, i: np.ndarray) -> np.ndarray:
        return before[i >> 6] + np.bitwise_count(packed[i >> 6] & ((np.uint64(1) << (i & 63).astype(np.uint64)) - np.uint64(1)))

    def rank(self, symbol: np.ndarray, i: np.ndarray) -> np.ndarray:
        """How often symbol stands before i."""
        start = np.zeros_like(i)
        for level, (packed, before, zeros) in enumerate(self.levels):
            bit = symbol >> (self.bits - 1 - level) & 1
            one_i, one_s = self.ones(packed, before, i).astype(np.int64), self.ones(packed, before, start).astype(np.int64)
            i, start = np.where(bit, zeros + one_i, i - one_i), np.where(bit, zeros + one_s, start - one_s)
        return i - start


def suffix_array(seq: np.ndarray) -> np.ndarray:
    """By prefix doubling: each round sorts by twice as many symbols."""
    n, step = len(seq), 1
    rank = np.unique(seq, return_inverse=True)[1].astype(np.int64)
    while True:
        after = np.zeros(n, np.int64)
        after[: max(0, n - step)] = rank[step:] + 1
        key = rank * (n + 1) + after
        order = np.argsort(key, kind="stable")
        sorted_key = key[order]
        rank[order] = np.concatenate([[0], np.cumsum(sorted_key[1:] != sorted_key[:-1])])
        if rank[order[-1]] == n - 1:
            return order
        step *= 2


class FMIndex:
    """seq: symbols from 1; 0 is appended as its end."""

    def __init__(self, seq: np.ndarray, alphabet: int):
        seq = np.append(seq, 0)
        sa = suffix_array(seq)
        self.bwt = seq[sa - 1]
        self.before = np.searchsorted(seq[sa], np.arange(alphabet + 1))  # rows that begin with a smaller symbol
        self.wavelet = Wavelet(self.bwt, max(1, int(alphabet).bit_length()))
        held = sa % SAMPLE == 0
        self.held, self.number, self.sampled = held, np.cumsum(held) - 1, sa[held]

    def step(self, symbol: np.ndarray, row: np.ndarray) -> np.ndarray:
        return self.before[symbol] + self.wavelet.rank(symbol, row)

    def search(self, patterns: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
        """For patterns of one length, the rows [lo, hi) of suffixes that begin with each."""
        lo, hi = np.zeros(len(patterns), np.int64), np.full(len(patterns), len(self.bwt))
        live = np.arange(len(patterns))
        for k in range(patterns.shape[1] - 1, -1, -1):
            symbol = patterns[live, k]
            lo[live], hi[live] = self.step(symbol, lo[live]), self.step(symbol, hi[live])
            live = live[lo[live] < hi[live]]
            if not len(live):
                break
        return lo, np.maximum(lo, hi)

    def locate(self, rows: np.ndarray) -> np.ndarray:
        found, walked, live = np.zeros(len(rows), np.int64), 0, np.arange(len(rows))
        rows = rows.copy()
        while len(live):
            here = self.held[rows[live]]
            done = live[here]
            found[done] = self.sampled[self.number[rows[done]]] + walked
            live = live[~here]
            rows[live] = self.step(self.bwt[rows[live]], rows[live])
            walked += 1
        return found


class Windows:
    """The benchmark's windows over its own vocabulary: by length, the patterns and the items that have them."""

    def __init__(self, items: list[tuple[int, str]], width: int):
        w = Words(pa.array([t for _, t in items], pa.string()))
        self.vocabulary = np.unique(w.hash)
        symbol = np.searchsorted(self.vocabulary, w.hash) + 2
        by_length: dict[int, dict[bytes, set]] = {}
        for n, (item, _) in enumerate(items):
            a, b = int(w.first[n]), int(w.first[n + 1])
            size = min(width, b - a)
            for i in range(a, b - size + 1) if size else ():
                by_length.setdefault(size, {}).setdefault(symbol[i : i + size].tobytes(), set()).add(item)
        self.groups = [(m, np.array([np.frombuffer(x, np.int64) for x in found]), list(found.values())) for m, found in sorted(by_length.items())]
        self.likely = np.zeros(1 << 16, bool)
        self.likely[(self.vocabulary >> np.uint64(48)).astype(np.int64)] = True

    def symbols(self, hashes: np.ndarray) -> np.ndarray:
        """2 and up for words of the vocabulary, else 0."""
        out = np.zeros(len(hashes), np.int64)
        if len(self.vocabulary):
            maybe = np.flatnonzero(self.likely[(hashes >> np.uint64(48)).astype(np.int64)])
            at = np.minimum(np.searchsorted(self.vocabulary, hashes[maybe]), len(self.vocabulary) - 1)
            hit = self.vocabulary[at] == hashes[maybe]
            out[maybe[hit]] = at[hit] + 2
        return out

    def find(self, words: Words) -> Iterator[tuple[np.ndarray, int, list]]:
        """(first words, length, items) of each window that occurs."""
        symbol = self.symbols(words.hash)
        if not self.groups or not len(symbol):
            return
        known = symbol > 0
        edge = np.zeros(len(symbol) + 1, bool)
        edge[words.first] = True
        begin = known & (edge[:-1] | ~np.concatenate([[False], known[:-1]]))
        run = np.cumsum(begin)[known] - 1
        size = np.bincount(run) if len(run) else np.zeros(0, np.int64)
        keep = size[run] >= self.groups[0][0] if len(run) else np.zeros(0, bool)
        place, run = np.flatnonzero(known)[keep], run[keep]
        if not len(place):
            return
        # a 1 stands between runs
        gap = np.concatenate([[0], np.cumsum(run[1:] != run[:-1])])
        seq, origin = np.ones(len(place) + gap[-1], np.int64), np.full(len(place) + gap[-1], -1)
        seq[np.arange(len(place)) + gap], origin[np.arange(len(place)) + gap] = symbol[place], place
        index = FMIndex(seq, len(self.vocabulary) + 2)
        for m, patterns, items in self.groups:
            lo, hi = index.search(patterns)
            hit = np.flatnonzero(hi > lo)
            if len(hit):
                count = hi[hit] - lo[hit]
                rows = np.repeat(lo[hit] - (np.cumsum(count) - count), count) + np.arange(count.sum())
                at = origin[index.locate(rows)]
                for k, x in zip(hit.tolist(), np.split(at, np.cumsum(count)[:-1]), strict=True):
                    yield x, m, items[k]


def bench_blocks(benchmark: DataFrame, limit: int = BENCH_BYTES) -> Iterator[list[tuple[int, str]]]:
    """The items in blocks of about limit bytes, fetched one partition at a time."""
    block, size = [], 0
    for row in benchmark.select(F.col("item_id").cast("long"), "text").where("text is not null").toLocalIterator():
        block.append((row[0], row[1]))
        size += len(row[1].encode())
        if size >= limit:
            yield block
            block, size = [], 0
    if block:
        yield block


FOUND = [StructField("n_words", LongType()), StructField("hits", ArrayType(IntegerType())), StructField("items", ArrayType(LongType()))]


def find(docs: DataFrame, benchmark: DataFrame, *, width: int = 10, text_col: str = "text", then=None, schema: StructType | str | None = None) -> DataFrame:
    """docs with n_words, hits (begin and end byte of each maximal run of hit words, alternating) and items, which replace columns of those names.

    then: a function over those batches, which gives rows of schema instead; it runs in the worker that finds the last block.
    """
    docs = in_batches(docs.drop(*(f.name for f in FOUND)))
    names, found = docs.columns, StructType([*docs.schema.fields, *FOUND])
    out = docs.withColumns({f.name: F.lit(None).cast(f.dataType) for f in FOUND})
    sent, step = None, _step(None, width, names, text_col)
    for block in bench_blocks(benchmark):
        if sent is not None:
            out = staged(out.mapInArrow(step, found), "found")
            sent.destroy()
        sent = docs.sparkSession.sparkContext.broadcast(block)
        step = _step(sent, width, names, text_col)
    return out.mapInArrow(step, found) if then is None else out.mapInArrow(lambda batches: then(step(batches)), schema)


_windows: dict = {}


def _step(sent, width: int, names: list[str], text_col: str):
    tag = uuid.uuid4().hex

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        if tag not in _windows:
            _windows.clear()
            _windows[tag] = Windows(sent.value if sent is not None else [], width)
        windows = _windows[tag]
        for b in blocks(batches, text_col, SHARD_BYTES):
            words = Words(b.column(text_col))
            total = len(words.begin)
            delta, seen = np.zeros(total + 1, np.int64), {}
            for at, m, items in windows.find(words):
                np.add.at(delta, at, 1)
                np.add.at(delta, at + m, -1)
                for n in np.unique(np.searchsorted(words.first, at, side="right") - 1).tolist():
                    seen.setdefault(n, set()).update(items)
            hit = np.cumsum(delta[:-1]) > 0
            hits, old_items = b.column("hits").to_pylist(), b.column("items").to_pylist()
            for n in seen:
                a, z = words.first[n], words.first[n + 1]
                mask, base = hit[a:z].copy(), words.offsets[n]
                begin, end = words.begin[a:z] - base, words.end[a:z] - base
                for s, e in zip(*[iter(hits[n] or [])] * 2, strict=True):
                    mask |= (begin >= s) & (end <= e)
                edge = np.flatnonzero(np.diff(np.concatenate([[False], mask, [False]])))
                hits[n] = [int(x) for s, e in edge.reshape(-1, 2) for x in (begin[s], end[e - 1])]
                seen[n].update(old_items[n] or [])
            found = [sorted(seen[n], key=str) if n in seen else old_items[n] or [] for n in range(b.num_rows)]
            yield pa.RecordBatch.from_arrays(
                [*(b.column(c) for c in names), pa.array(np.diff(words.first), pa.int64()), pa.array([h or [] for h in hits], pa.list_(pa.int32())), pa.array(found, pa.list_(pa.int64()))],
                names=[*names, "n_words", "hits", "items"],
            )

    return run


def remove(docs: DataFrame, benchmark: DataFrame, *, width: int = 10, text_col: str = "text") -> DataFrame:
    """docs with every hit span cut out of the text; rows without a hit are as they were."""
    rows = packed(docs, text_col)

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for b in batches:
            texts = b.column("text").to_pylist()
            for n, h in enumerate(b.column("hits").to_pylist()):
                if h:
                    raw = texts[n].encode()
                    cuts = [0, *h, len(raw)]
                    texts[n] = b"".join(raw[s:e] for s, e in zip(cuts[::2], cuts[1::2], strict=True)).decode()
            yield pa.RecordBatch.from_arrays([b.column("row"), pa.array(texts, pa.string())], names=["row", "text"])

    return unpacked(find(rows, benchmark, width=width, then=run, schema=rows.schema), docs.columns, text_col)


def digests(docs: DataFrame, benchmark: DataFrame, *, width: int = 10) -> DataFrame:
    """Per document: n_words, n_hit, n_items, items_sha256, contaminated."""
    kept = docs.select(F.col("doc_id").cast("long").alias("doc_id"), "text")

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for b in batches:
            items = [sorted(map(str, x)) for x in b.column("items").to_pylist()]
            hits = b.column("hits").to_pylist()
            some = [n for n, h in enumerate(hits) if h]
            n_hit = np.zeros(b.num_rows, np.int64)
            if some:
                w = Words(pa.array([b.column("text")[n].as_py() for n in some], pa.string()))
                for k, n in enumerate(some):
                    begin = w.begin[w.first[k] : w.first[k + 1]] - w.offsets[k]
                    n_hit[n] = sum(int(np.searchsorted(begin, e) - np.searchsorted(begin, s)) for s, e in zip(hits[n][::2], hits[n][1::2], strict=True))
            yield pa.RecordBatch.from_arrays(
                [b.column("doc_id"), b.column("n_words"), pa.array(n_hit), pa.array([len(x) for x in items], pa.int64()), pa.array([hashlib.sha256(",".join(x).encode()).hexdigest() for x in items]), pa.array(n_hit > 0)],
                names=["doc_id", "n_words", "n_hit", "n_items", "items_sha256", "contaminated"],
            )

    return find(kept, benchmark, width=width, then=run, schema="doc_id long, n_words long, n_hit long, n_items long, items_sha256 string, contaminated boolean")


def op10_decontaminate(spark: SparkSession, sf_dir: str) -> DataFrame:
    return digests(spark.read.parquet(f"{sf_dir}/documents.parquet"), spark.read.parquet(f"{sf_dir}/benchmark.parquet"))
