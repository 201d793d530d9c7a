"""Byte-level BPE by corpus-level merge replay.

The distinct words of a block of documents form the corpus. An inverted index maps every pair of
adjacent tokens to the word positions where it stands; merges are applied in rank order, each at all of
its positions at once, and only the neighbours that a merge touches are indexed anew. Documents are then
written as the concatenation of their words' ids. Words already replayed by the same worker are kept in a
bounded table, so a block only replays words that are new to it.

Rows: any. Null or empty text has no ids. Very long texts are one row of their block; nothing is cut.
Repeated rows give repeated results; other columns of the input are ignored. An empty table gives an
empty table.
"""

from __future__ import annotations

import base64
import ctypes
import gc
import hashlib
from collections.abc import Iterator
from heapq import heappop, heappush
from itertools import pairwise

import numpy as np
import pyarrow as pa
import pyarrow.compute as pc
import regex
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql.types import BinaryType, LongType, StructField, StructType

from corvane.llm.common import in_batches, packed, unpacked

#: Text bytes that one block gathers before its merges are replayed; words kept by a worker at most.
BLOCK_BYTES, WORDS_KEPT = 3 << 20, 300_000


def keys(text: str) -> list[str]:
    """A text cut before each space: what stood after a space, and " " + what stood before the first."""
    p = text.split(" ")
    if p[0]:
        p[0] = " " + p[0]
        return p
    return p[1:]


def odd(key: str) -> bool:
    """Whether the space before it may belong to another match than what follows."""
    return not key or key[0] != " " and key[0].isspace()


class MergeReplay:
    def __init__(self, vocabulary: str, pattern: str):
        with open(vocabulary, "rb") as f:
            self.ranks = {base64.b64decode(a): int(b) for a, b in map(bytes.split, f)}
        self.bytes_of = {r: t for t, r in self.ranks.items()}
        self.by_byte = np.array([self.ranks[bytes([i])] for i in range(256)], dtype=np.int64)
        self.span = max(self.bytes_of) + 1
        self.findall = regex.compile(pattern).findall
        pairs = [(self.ranks[t[:i]] * self.span + self.ranks[t[i:]], r) for t, r in self.ranks.items() for i in range(1, len(t)) if t[:i] in self.ranks and t[i:] in self.ranks]
        self.pairs, self.makes = (x[np.argsort(k)] for k in [np.array([p for p, _ in pairs])] for x in (k, np.array([r for _, r in pairs])))
        self.words: dict[str, bytes] = {}

    def rank(self, left: np.ndarray, right: np.ndarray) -> np.ndarray:
        """The rank of the token that each pair makes, -1 if none or if a side is no token."""
        key = left * self.span + right
        at = self.pairs.searchsorted(key)
        at[at == len(self.pairs)] = 0
        return np.where((self.pairs[at] == key) & (left >= 0) & (right >= 0), self.makes[at], -1)

    def replay(self, words: list[bytes]) -> list[bytes]:
        """The ids of each word: every merge, in rank order, at all of its positions in all words."""
        if not words:
            return []
        tok = self.by_byte[np.frombuffer(b"\0" + b"\0".join(words) + b"\0", np.uint8)]
        ends = np.concatenate([[0], np.cumsum(np.fromiter(map(len, words), np.int64, len(words)) + 1)])
        tok[ends] = -1  # between words
        nxt, prv = np.arange(1, len(tok) + 1), np.arange(-1, len(tok) - 1)
        made = np.append(self.rank(tok[:-1], tok[1:]), -1)  # by the position of a pair's left token
        left = np.flatnonzero(made >= 0)
        order = left[np.argsort(made[left], kind="stable")]
        kinds, starts = np.unique(made[order], return_index=True)
        #: The inverted index: what a pair makes -> positions of the pair, at the start and those found since.
        first = dict(zip(kinds.tolist(), zip(starts.tolist(), [*starts[1:].tolist(), len(order)], strict=True), strict=True))
        later: dict[int, list[int]] = {}
        heap = kinds.tolist()
        while heap:
            r = heappop(heap)
            s, t = first.pop(r, (0, 0))
            i = order[s:t]
            if more := later.pop(r, None):
                i = np.unique(np.concatenate([i, np.array(more)]))
            i = i[made[i] == r]
            j = nxt[i]
            if len(i) > 1 and (i[1:] == j[:-1]).any():  # pairs that overlap: the leftmost goes first
                keep, last = [], -1
                for x, y in zip(i.tolist(), j.tolist(), strict=True):
                    if x != last:
                        keep.append(x)
                        last = y
                i = np.array(keep)
                j = nxt[i]
            if not len(i):
                continue
            k = nxt[j]
            tok[i], tok[j], made[j], nxt[i] = r, -2, -1, k
            prv[k] = i
            h = prv[i]
            ends_at, pos = tok[k], np.concatenate([h, i])
            fresh = self.rank(np.concatenate([tok[h], tok[i]]), np.concatenate([tok[i], ends_at]))
            made[pos] = fresh
            found = fresh >= 0
            for q, x in zip(fresh[found].tolist(), pos[found].tolist(), strict=True):
                if q in later:
                    later[q].append(x)
                else:
                    later[q] = [x]
                    if q not in first:
                        heappush(heap, q)
        alive = tok >= 0
        count = np.concatenate([[0], np.cumsum(alive)])
        flat, cut = tok[alive].astype("<u4").tobytes(), (4 * count[ends]).tolist()
        return [flat[a:b] for a, b in pairwise(cut)]

    def encode(self, texts: list[str]) -> list[bytes]:
        """The ids of each text, as little-endian 32-bit numbers."""
        gc.disable()  # the tables hold no cycles, and scanning them again and again costs a third of the time
        try:
            return self._encode(texts)
        finally:
            gc.enable()

    def _encode(self, texts: list[str]) -> list[bytes]:
        if len(self.words) > WORDS_KEPT:
            self.words.clear()
        words = self.words
        cut = [keys(t) for t in texts]
        new: set[str] = set()
        for p in cut:
            new.update(p)
        # A space belongs to the match that follows it unless white space or nothing follows: such texts are split whole.
        fresh = [x for x in new.difference(words) if x and not x[0].isspace() or x[:1] == " "]
        parts = [[" " + x] if x.isalpha() else self.findall(x[1:] if x[0] == " " else " " + x) for x in fresh]
        whole = {n: self.findall(t) for n, (t, p) in enumerate(zip(texts, cut, strict=True)) if any(map(odd, p))} if any(map(odd, new)) else {}
        single = list({m for p in (*parts, *whole.values()) for m in p})
        ids = dict(zip(single, self.replay([m.encode() for m in single]), strict=True))
        for x, p in zip(fresh, parts, strict=True):
            words[x] = b"".join([ids[m] for m in p]) if len(p) > 1 else ids[p[0]]
        return [b"".join([ids[m] for m in whole[n]]) if n in whole else b"".join(map(words.__getitem__, p)) for n, p in enumerate(cut)]

    def decode(self, ids: bytes) -> bytes:
        of = self.bytes_of
        return b"".join([of[i] for i in np.frombuffer(ids, "<u4").tolist()])


_made: dict[tuple[str, str], MergeReplay] = {}


def replayer(vocabulary: str, pattern: str) -> MergeReplay:
    """One for each worker process and vocabulary."""
    if (vocabulary, pattern) not in _made:
        _made[vocabulary, pattern] = MergeReplay(vocabulary, pattern)
    return _made[vocabulary, pattern]


def give_back() -> None:
    """A worker serves other tasks later: what one has freed goes back to the system."""
    pa.default_memory_pool().release_unused()
    if trim := getattr(ctypes.CDLL(None), "malloc_trim", None):
        trim(0)


def blocks(batches: Iterator[pa.RecordBatch], column: str = "text", limit: int = BLOCK_BYTES, replaying: bool = False) -> Iterator[pa.RecordBatch]:
    """Slices of the batches whose texts hold about limit bytes, one row at least.

    A worker that turns from replaying to other work first forgets the words that it has replayed.
    """
    if _made and not replaying:
        _made.clear()
        give_back()
    for batch in batches:
        size = np.cumsum(pc.fill_null(pc.binary_length(batch.column(column)), 0).to_numpy(zero_copy_only=False).astype(np.int64))
        i = 0
        while i < batch.num_rows:
            j = max(i + 1, int(np.searchsorted(size, (size[i - 1] if i else 0) + limit, side="right")))
            yield batch.slice(i, j - i)
            i = j
    give_back()


def encode_documents(docs: DataFrame, vocabulary: str, pattern: str, *, id_col: str = "doc_id", text_col: str = "text") -> DataFrame:
    """(id, ids binary: little-endian unsigned 32-bit) for every row; no shuffle."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        bpe = replayer(vocabulary, pattern)
        for b in blocks(batches, replaying=True):
            got = bpe.encode([t or "" for t in b.column("text").to_pylist()])
            yield pa.RecordBatch.from_arrays([b.column("id"), pa.array(got, pa.binary())], names=["id", "ids"])

    kept = in_batches(docs).select(F.col(id_col).alias("id"), F.col(text_col).alias("text"))
    return kept.mapInArrow(run, f"id {dict(kept.dtypes)['id']}, ids binary").withColumnRenamed("id", id_col)


def decode_documents(encoded: DataFrame, vocabulary: str, pattern: str, *, id_col: str = "doc_id", ids_col: str = "ids") -> DataFrame:
    """(id, text) for rows of encode_documents; bytes that are no UTF-8 are replaced."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        bpe = replayer(vocabulary, pattern)
        for b in batches:
            got = [bpe.decode(x or b"").decode("utf-8", "replace") for x in b.column("ids").to_pylist()]
            yield pa.RecordBatch.from_arrays([b.column("id"), pa.array(got, pa.string())], names=["id", "text"])

    kept = encoded.select(F.col(id_col).alias("id"), F.col(ids_col).alias("ids"))
    return kept.mapInArrow(run, f"id {dict(kept.dtypes)['id']}, text string").withColumnRenamed("id", id_col)


def encode_and_decode(docs: DataFrame, vocabulary: str, pattern: str, *, text_col: str = "text") -> DataFrame:
    """docs with n_tokens and ids, which replace columns of those names, and the text decoded from them; null text stays null and has no ids."""
    rows = packed(docs, text_col)

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        bpe = replayer(vocabulary, pattern)
        for b in blocks(batches, replaying=True):
            texts = b.column("text").to_pylist()
            ids = bpe.encode([t or "" for t in texts])
            back = [None if t is None else bpe.decode(x).decode() for t, x in zip(texts, ids, strict=True)]
            yield pa.RecordBatch.from_arrays([b.column("row"), pa.array(back, pa.string()), pa.array([len(x) // 4 for x in ids], pa.int64()), pa.array(ids, pa.binary())], names=["row", "text", "n_tokens", "ids"])

    coded = rows.mapInArrow(run, StructType([*rows.schema.fields, StructField("n_tokens", LongType()), StructField("ids", BinaryType())]))
    return unpacked(coded, docs.columns, text_col, own=("n_tokens", "ids"))


DIGEST = "doc_id long, n_tokens long, ids_sha256 string, decoded_sha256 string"


def digests(docs: DataFrame, vocabulary: str, pattern: str) -> DataFrame:
    """Per document: n_tokens, sha256 of the ids and of the decoded bytes; encoding and decoding in one pass."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        bpe = replayer(vocabulary, pattern)
        for b in blocks(batches, replaying=True):
            got = bpe.encode([t or "" for t in b.column("text").to_pylist()])
            yield pa.RecordBatch.from_arrays(
                [
                    b.column("doc_id"),
                    pa.array([len(x) // 4 for x in got], pa.int64()),
                    pa.array([hashlib.sha256(x).hexdigest() for x in got]),
                    pa.array([hashlib.sha256(bpe.decode(x)).hexdigest() for x in got]),
                ],
                names=["doc_id", "n_tokens", "ids_sha256", "decoded_sha256"],
            )

    return in_batches(docs).select(F.col("doc_id").cast("long").alias("doc_id"), "text").mapInArrow(run, DIGEST)


def op9_bpe(spark: SparkSession, sf_dir: str) -> DataFrame:
    import public_tokenizers as P

    return digests(spark.read.parquet(f"{sf_dir}/documents.parquet"), P.path("byte_bpe_multi_50k.tiktoken"), P.PATTERN)
