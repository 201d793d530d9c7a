"""Token ids as sorted-string-table shards.

Documents are dealt by ranges of their identifier, sorted, encoded with a public tokenizer and written as
one immutable shard file for each range, into the folder that the cluster shares:

    data blocks | Bloom filter | block index | footer

A data block holds entries in key order. A key is 1 byte (0: null identifier, 1: else), the identifier as 8
big-endian bytes with the sign bit flipped, and 4 bytes that number rows with the same identifier; an entry
stores how many leading bytes it shares with the key before it, the rest, and its ids. Blocks are
compressed. The index holds each block's last key, offset and length, so a lookup asks the Bloom filter,
then bisects the index, then reads a single block. The footer holds where filter and index are, the number
of entries and of ids, and a magic number.

A shard is written under the attempt's own name and listed in a table once its task has succeeded, so
lost executors and repeated attempts leave no half shard that anyone reads.

Null or empty text gives only the end id. Repeated identifiers are kept as separate entries, in the order of
their texts. Very long texts make one long entry. Extra columns are ignored. No rows give no shards.
"""

from __future__ import annotations

import struct
import uuid
import zlib
from array import array
from bisect import bisect_left
from collections.abc import Iterator

import numpy as np
import pyarrow as pa
import zstandard
from pyarrow import fs
from pyspark.sql import DataFrame, SparkSession, Window
from pyspark.sql import functions as F

from corvane.llm.bpe_replay import blocks, keys, odd
from corvane.llm.common import new_folder, staged

MAGIC = b"CVSST001"
FOOTER = struct.Struct("<QQQQQQ8s")  # filter at, filter bytes, index at, index bytes, entries, ids, magic
BLOCK_BYTES, BITS_PER_KEY, PROBES, WORDS_KEPT, AT_ONCE = 64 << 10, 10, 7, 1_000_000, 8192
SIGN = 1 << 63


def key_of(doc_id: int | None, n: int = 0) -> bytes:
    return struct.pack(">BQI", doc_id is not None, 0 if doc_id is None else (doc_id + SIGN) % (1 << 64), n)


def id_of(key: bytes) -> int | None:
    return int.from_bytes(key[1:9], "big") - SIGN if key[0] else None


def probes(prefix: bytes, bits: int) -> list[int]:
    """Where the filter has an identifier's bits: double hashing."""
    a, b = zlib.crc32(prefix), zlib.crc32(prefix, 0x9E3779B9) | 1
    return [(a + i * b) % bits for i in range(PROBES)]


def varint(n: int) -> bytes:
    out = bytearray()
    while n > 127:
        out.append(n & 127 | 128)
        n >>= 7
    out.append(n)
    return bytes(out)


def read_varint(b: bytes, i: int) -> tuple[int, int]:
    n = shift = 0
    while True:
        c = b[i]
        n |= (c & 127) << shift
        i += 1
        if c < 128:
            return n, i
        shift += 7


class Writer:
    """Writes one shard; add() takes keys in ascending order."""

    def __init__(self, out):
        self.out, self.at, self.block, self.last, self.index, self.ids = out, 0, [], b"", [], 0
        self.size, self.entries, self.filtered, self.compress = 0, 0, [], zstandard.ZstdCompressor(level=1).compress

    def add(self, key: bytes, ids: bytes) -> None:
        shared = 0
        while shared < len(self.last) and self.last[shared] == key[shared]:
            shared += 1
        values = np.frombuffer(ids, "<u4")
        narrow = not len(values) or int(values.max()) < 65536
        value = values.astype("<u2").tobytes() if narrow else ids
        self.block += [varint(shared), varint(len(key) - shared), varint(2 * len(values) + narrow), key[shared:], value]
        self.size += len(value) + 16
        self.last, self.entries, self.ids = key, self.entries + 1, self.ids + len(values)
        self.filtered.append(key[:9])
        if self.size >= BLOCK_BYTES:
            self.flush()

    def put(self, data: bytes) -> tuple[int, int]:
        self.out.write(data)
        self.at += len(data)
        return self.at - len(data), len(data)

    def flush(self) -> None:
        if self.block:
            at, n = self.put(self.compress(b"".join(self.block)))
            self.index.append(self.last + struct.pack("<QQ", at, n))
            self.block, self.last, self.size = [], b"", 0

    def close(self) -> None:
        self.flush()
        bits = max(64, BITS_PER_KEY * len(self.filtered))
        bloom = np.zeros((bits + 7) // 8, np.uint8)
        for k in self.filtered:
            for p in probes(k, bits):
                bloom[p >> 3] |= 1 << (p & 7)
        where = self.put(struct.pack("<Q", bits) + bloom.tobytes()) + self.put(b"".join(self.index))
        self.put(FOOTER.pack(*where, self.entries, self.ids, MAGIC))


class Table:
    """Reads one shard through random access."""

    def __init__(self, source):
        self.source = source
        size = source.size()
        bloom_at, bloom_n, at, n, self.entries, self.ids, magic = FOOTER.unpack(source.read_at(FOOTER.size, size - FOOTER.size))
        if magic != MAGIC:
            raise ValueError("not a shard")
        bloom, index = source.read_at(bloom_n, bloom_at), source.read_at(n, at)
        self.bits, self.bloom = struct.unpack("<Q", bloom[:8])[0], bloom[8:]
        self.last = [index[i : i + 13] for i in range(0, n, 29)]
        self.where = [struct.unpack("<QQ", index[i + 13 : i + 29]) for i in range(0, n, 29)]

    def read(self, k: int) -> Iterator[tuple[bytes, bytes]]:
        at, n = self.where[k]
        b = zstandard.ZstdDecompressor().decompress(self.source.read_at(n, at))
        i, key = 0, b""
        while i < len(b):
            shared, i = read_varint(b, i)
            rest, i = read_varint(b, i)
            n, i = read_varint(b, i)
            key = key[:shared] + b[i : i + rest]
            i += rest
            width = 2 if n & 1 else 4
            value = b[i : i + width * (n >> 1)]
            i += len(value)
            yield key, np.frombuffer(value, "<u2").astype("<u4").tobytes() if width == 2 else value

    def scan(self) -> Iterator[tuple[bytes, bytes]]:
        for k in range(len(self.where)):
            yield from self.read(k)

    def get(self, doc_id: int | None) -> list[bytes]:
        """The ids of every row with this identifier."""
        prefix = key_of(doc_id)[:9]
        if not all(self.bloom[p >> 3] >> (p & 7) & 1 for p in probes(prefix, self.bits)):
            return []
        found = []
        for k in range(bisect_left(self.last, prefix), len(self.last)):
            for key, ids in self.read(k):
                if key[:9] == prefix:
                    found.append(ids)
                elif key[:9] > prefix:
                    return found
        return found


class LibraryEncoder:
    """The tokenizers library over the distinct words of a block; words seen before are looked up."""

    def __init__(self, vocabulary: str):
        import os

        from tokenizers import Tokenizer

        os.environ["TOKENIZERS_PARALLELISM"] = "false"
        self.model = Tokenizer.from_file(vocabulary)
        self.words: dict[str, bytes] = {}

    def ids(self, texts: list[str]) -> list[bytes]:
        out: list[bytes] = []
        for k in range(0, len(texts), AT_ONCE):  # the library's own results are large
            out += [array("I", x.ids).tobytes() for x in self.model.encode_batch_fast(texts[k : k + AT_ONCE], add_special_tokens=False)]
        return out

    def encode(self, texts: list[str]) -> list[bytes]:
        if len(self.words) > WORDS_KEPT:
            self.words.clear()
        words, cut, new = self.words, [keys(t) for t in texts], set()
        for p in cut:
            new.update(p)
        new.difference_update(words)
        loose = {x for x in new if odd(x)}
        fresh = [x for x in new if x not in loose]
        words.update(zip(fresh, self.ids([x[1:] if x[0] == " " else " " + x for x in fresh]), strict=True))
        whole = [n for n, p in enumerate(cut) if not loose.isdisjoint(p)] if loose else []
        out = dict(zip(whole, self.ids([texts[n] for n in whole]), strict=True))
        return [out[n] if n in out else b"".join(map(words.__getitem__, p)) for n, p in enumerate(cut)]


_made: dict[str, LibraryEncoder] = {}


def encoder(vocabulary: str) -> LibraryEncoder:
    if vocabulary not in _made:
        _made[vocabulary] = LibraryEncoder(vocabulary)
    return _made[vocabulary]


SHARDS = "shard string, first_id long, last_id long, n_docs long, n_ids long"


def write_shards(docs: DataFrame, vocabulary: str, end_id: int, folder: str, *, id_col: str = "doc_id", text_col: str = "text") -> DataFrame:
    """Write the shards below folder; the staged table of shards (SHARDS)."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        end, first, last, n, writer = struct.pack("<I", end_id), None, None, 0, None
        place, root = fs.FileSystem.from_uri(folder)
        for b in blocks(batches, limit=4 << 20):
            if writer is None:
                place.create_dir(root, recursive=True)
                name, model, first = f"{uuid.uuid4().hex}.sst", encoder(vocabulary), b.column("id")[0].as_py()
                writer = Writer(out := place.open_output_stream(f"{root}/{name}"))
            for i, ids in zip(b.column("id").to_pylist(), model.encode([t or "" for t in b.column("text").to_pylist()]), strict=True):
                n = n + 1 if writer.entries and i == last else 0
                last = i
                writer.add(key_of(i, n), ids + end)
        if writer is not None:
            writer.close()
            out.close()
            yield pa.RecordBatch.from_pylist([{"shard": f"{folder}/{name}", "first_id": first, "last_id": last, "n_docs": writer.entries, "n_ids": writer.ids}], schema=pa.schema([("shard", pa.string()), *((c, pa.int64()) for c in ("first_id", "last_id", "n_docs", "n_ids"))]))

    kept = docs.select(F.col(id_col).cast("long").alias("id"), F.col(text_col).alias("text"))
    dealt = kept.repartitionByRange(F.col("id")).sortWithinPartitions("id", "text")
    return staged(dealt.mapInArrow(run, SHARDS), "shards")


def read_shards(shards: DataFrame) -> DataFrame:
    """Per document, read back from the files: doc_id, start, n_tokens, ids_crc32, and the shard that holds it."""
    before = Window.orderBy(F.col("first_id").asc_nulls_first()).rowsBetween(Window.unboundedPreceding, -1)
    offsets = shards.withColumn("start", F.coalesce(F.sum("n_ids").over(before), F.lit(0)))

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for b in batches:
            for row in b.to_pylist():
                place, path = fs.FileSystem.from_uri(row["shard"])
                start, out = row["start"], ([], [], [], [])
                with place.open_input_file(path) as f:
                    for key, ids in Table(f).scan():
                        for column, x in zip(out, (id_of(key), start, len(ids) // 4, zlib.crc32(ids)), strict=True):
                            column.append(x)
                        start += len(ids) // 4
                yield pa.RecordBatch.from_arrays([*(pa.array(x, pa.int64()) for x in out), pa.array([row["shard"].rpartition("/")[2]] * len(out[0]))], names=["doc_id", "start", "n_tokens", "ids_crc32", "shard"])

    # the list is small, but each row of it is a file to read: a count of its own keeps Spark from gathering them
    tasks = max(1, min(shards.count(), 20_000))
    return offsets.repartition(tasks, F.col("shard")).mapInArrow(run, "doc_id long, start long, n_tokens long, ids_crc32 long, shard string")


def op7_sst_output(spark: SparkSession, sf_dir: str) -> DataFrame:
    import public_tokenizers as P

    docs = spark.read.parquet(f"{sf_dir}/documents.parquet")
    shards = write_shards(docs, P.path("byte_bpe_50k.json"), 2, new_folder(spark, "sst"))
    return read_shards(shards).drop("shard")
