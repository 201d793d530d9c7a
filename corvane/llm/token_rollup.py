"""Token counts as delta-maintained rollups.

A rollup keeps additive totals (documents and tokens) by source, language and tokenizer version. A batch of
changes becomes signed rows: an insert adds a document's counts, a delete takes them back, a revision does
both. The ledger keeps the signed rows by document, so that old counts are known without the old texts; the
rolled-up deltas of each batch are kept beside it, so totals only ever read those.

A batch is written under a name of its own and takes effect by one file that names it, the next version of the
rollup, which is moved to its place only if none is there (so the folder's store must rename atomically). A
writer that finds its version taken reads the ledger anew and takes the next. A batch identifier that is
committed already changes nothing, whether it comes again after a lost driver, twice at a time, or with other
rows; what an unfinished attempt wrote is never read.

Null text counts as a document of no tokens. Null source or language is a group of its own. A row with a
null identifier is an insert that can't be revised or deleted. Of several rows with one identifier in a
batch, the last counts (the largest seq if given, then a delete, then the largest counts), so repeated rows
count once.
Deleting what isn't there changes nothing. Extra columns are ignored. An empty batch commits no rows.
"""

from __future__ import annotations

import base64
from collections.abc import Callable, Iterator

import pyarrow as pa
from py4j.protocol import Py4JJavaError
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from corvane.llm.bpe_replay import blocks
from corvane.llm.common import new_folder

KEYS = ["source", "lang", "tokenizer"]
DELTA = "doc_id long, source string, lang string, tokenizer string, docs long, tokens long"
ROLLED = "source string, lang string, tokenizer string, docs long, tokens long"


def rank_counter(path: str, pattern: str) -> Callable[[str], int]:
    """Counts tokens with a rank file; made in the worker that uses it."""
    made = []

    def count(text: str) -> int:
        if not made:
            import tiktoken

            with open(path, "rb") as f:
                ranks = {base64.b64decode(a): int(b) for a, b in map(bytes.split, f)}
            made.append(tiktoken.Encoding("own", pat_str=pattern, mergeable_ranks=ranks, special_tokens={}))
        return len(made[0].encode_ordinary(text))

    return count


def word_counter(text: str) -> int:
    """White-space separated words."""
    return len(text.split())


class Rollup:
    def __init__(self, spark: SparkSession, folder: str, tokenizers: dict[str, Callable[[str], int]]):
        self.spark, self.folder, self.tokenizers = spark, folder.rstrip("/"), tokenizers

    def _path(self, name: str):
        path = self.spark._jvm.org.apache.hadoop.fs.Path(f"{self.folder}/{name}")
        return path.getFileSystem(self.spark._jsc.hadoopConfiguration()), path

    def _commits(self) -> list[tuple[str, str]]:
        """(batch, data folder) of each version, in order."""
        fs, path = self._path("commits")
        found = []
        for status in fs.listStatus(path) if fs.exists(path) else []:
            stream = fs.open(status.getPath())
            found.append((status.getPath().getName(), *stream.readUTF().split(" ")))
            stream.close()
        return [(bytes.fromhex(batch).decode(), data) for _, batch, data in sorted(found)]

    def committed(self, batch: str) -> bool:
        return any(b == batch for b, _ in self._commits())

    def _read(self, kind: str, schema: str) -> DataFrame:
        found = [f"{self.folder}/data/{x}/{kind}" for _, x in self._commits()]
        return self.spark.read.schema(schema).parquet(*found) if found else self.spark.createDataFrame([], schema)

    def counted(self, rows: DataFrame) -> DataFrame:
        """(doc_id, deleted, seq, source, lang, counts by tokenizer): texts are read once and not shuffled."""
        names, counters = list(self.tokenizers), list(self.tokenizers.values())

        def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
            for b in blocks(batches):
                texts = [t or "" for t in b.column("text").to_pylist()]
                counts = pa.array([[count(t) for count in counters] for t in texts], pa.list_(pa.int64()))
                yield pa.RecordBatch.from_arrays([*(b.column(c) for c in ("doc_id", "deleted", "seq", "source", "lang")), counts], names=["doc_id", "deleted", "seq", "source", "lang", "counts"])

        out = rows.mapInArrow(run, "doc_id long, deleted boolean, seq long, source string, lang string, counts array<long>")
        last = out.where("doc_id is not null").groupBy("doc_id").agg(F.max(F.struct("seq", "deleted", "counts", "source", "lang")).alias("x")).select("doc_id", "x.*")
        every = last.unionByName(out.where("doc_id is null and not deleted"))
        which = F.explode(F.arrays_zip(F.array(*map(F.lit, names)).alias("tokenizer"), F.col("counts").alias("tokens")))
        return every.select("doc_id", "deleted", "source", "lang", which.alias("c")).select("doc_id", "deleted", "source", "lang", "c.*")

    def commit(self, batch: str, changes: DataFrame) -> bool:
        """Apply changes (doc_id, text, source, lang; deleted boolean and seq long if need be); False if the batch was committed before."""
        if self.committed(batch):
            return False
        rows = changes.select(
            F.col("doc_id").cast("long").alias("doc_id"),
            "text",
            "source",
            "lang",
            (F.coalesce("deleted", F.lit(False)) if "deleted" in changes.columns else F.lit(False)).alias("deleted"),
            (F.col("seq").cast("long") if "seq" in changes.columns else F.lit(0).cast("long")).alias("seq"),
        )
        data = f"{batch.encode().hex()}-{new_folder(self.spark, 'b').rpartition('-')[2]}"
        place = f"{self.folder}/data/{data}"
        new = self.counted(rows)
        if self._commits():
            new.write.parquet(f"{place}/new")
            new = self.spark.read.parquet(f"{place}/new")
        while True:
            before = self._commits()
            if any(b == batch for b, _ in before):
                return False
            attempt = f"{data}/{len(before)}"
            self._signed(new, bool(before)).write.parquet(f"{self.folder}/data/{attempt}/ledger")
            ledger = self.spark.read.schema(DELTA).parquet(f"{self.folder}/data/{attempt}/ledger")
            ledger.groupBy(*KEYS).agg(F.sum("docs").alias("docs"), F.sum("tokens").alias("tokens")).coalesce(1).write.parquet(f"{self.folder}/data/{attempt}/rolled")
            if self._publish(len(before), batch, attempt):
                return True

    def _signed(self, new: DataFrame, state: bool) -> DataFrame:
        """The batch's signed rows: what it adds, and with a state what it takes back."""
        added = new.where("not deleted").select("doc_id", *KEYS, F.lit(1).cast("long").alias("docs"), "tokens")
        if not state:
            return added
        old = self._read("ledger", DELTA).where("doc_id is not null").join(new.select("doc_id").distinct(), "doc_id", "left_semi")
        old = old.groupBy("doc_id", *KEYS).agg(F.sum("docs").alias("docs"), F.sum("tokens").alias("tokens")).where("docs <> 0")
        return added.unionByName(old.select("doc_id", *KEYS, (-F.col("docs")).alias("docs"), (-F.col("tokens")).alias("tokens")))

    def _publish(self, version: int, batch: str, data: str) -> bool:
        """Write the commit file aside and move it to its place; False if another writer's is there."""
        fs, final = self._path(f"commits/{version:012d}")
        _, aside = self._path(f"data/{data}/commit")
        stream = fs.create(aside, True)
        stream.writeUTF(f"{batch.encode().hex()} {data}")
        stream.close()
        fs.mkdirs(final.getParent())
        hadoop = self.spark._jvm.org.apache.hadoop.fs
        context = hadoop.FileContext.getFileContext(final.toUri(), self.spark._jsc.hadoopConfiguration())
        try:
            context.rename(fs.makeQualified(aside), fs.makeQualified(final), self.spark.sparkContext._gateway.new_array(getattr(hadoop, "Options$Rename"), 0))
        except Py4JJavaError as e:
            if "FileAlreadyExists" in str(e.java_exception):
                return False
            raise
        return True

    def totals(self) -> DataFrame:
        """(source, lang, tokenizer, n_docs, n_tokens) over all committed batches."""
        return self._read("rolled", ROLLED).groupBy(*KEYS).agg(F.sum("docs").alias("n_docs"), F.sum("tokens").alias("n_tokens")).where("n_docs <> 0 or n_tokens <> 0")


def op4_token_rollup(spark: SparkSession, sf_dir: str) -> DataFrame:
    import public_tokenizers as P

    docs = spark.read.parquet(f"{sf_dir}/documents.parquet")
    rollup = Rollup(spark, new_folder(spark, "rollup"), {"byte_bpe_50k": rank_counter(P.path("byte_bpe_50k.tiktoken"), P.PATTERN), "words": word_counter})
    # three batches with drafts, revisions and deletes that end in docs; rows without identifier can't be revised
    part = F.when(F.col("doc_id").isNull(), 0).otherwise(F.pmod(F.xxhash64("doc_id"), F.lit(4)))
    rollup.commit("drafts", docs.where(part < 3).withColumn("text", F.when(part == 2, F.substring("text", 1, 100)).otherwise(F.col("text"))))
    rollup.commit("revised", docs.where(part > 0).withColumns({"deleted": part == 1, "text": F.when(part > 1, F.col("text"))}))
    rollup.commit("again", docs.where(part == 1))
    rollup.commit("again", docs.where(part == 1))  # a repeated batch changes nothing
    return rollup.totals()
