"""Line deduplication by winnowing, with DataFrame functions only.

A text is its lines; blank ones don't count. A window starts at a line and takes in lines until it has
MIN_WORDS words, or ends at a line and reaches back as far. Each window selects its least line hash, leftmost
first: the selected lines are the fingerprints, and equal windows select the same line of theirs.

1. Around each selected line lies its segment: the lines of all windows that select it, as far as they reach
   either way. Only these are shuffled, one row for each fingerprint.
2. Positions of a fingerprint that occurs more than once are joined: where whole segments are equal, the first
   (by identifier, then line) stays and the others are later repeats over their whole length.
3. Where a fingerprint has different segments, the first of each kind may still share a part with the others.
   These matches are extended window by window: a window whose content begins earlier is a later repeat.
4. Later repeats overlap into maximal runs, which are deleted, with blank lines inside them.

So exactly those lines go that lie in a window whose content also begins earlier: any run of whole lines with
MIN_WORDS words in common is found. What two places share of a line they don't share as a whole is no part of
one; a long line is a window of its own. Lines are compared trimmed, by 64-bit hashes. Firsts are minima with partial aggregation, and
joined back to staged rows, so that a passage that a third of all rows share reaches no task as a whole.

Null texts have no lines and stay null; empty texts have a single blank line. Very long texts are one row,
their lines' hashes one window partition. Rows with the same identifier and text are one document and lose
the same lines; null identifiers come first. Extra columns are kept. An empty table gives an empty table.
"""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession, Window
from pyspark.sql import functions as F

from corvane.llm.common import packed, staged, unpacked

MIN_WORDS = 50


def segments(docs: DataFrame, id_col: str, text_col: str, min_words: int) -> DataFrame:
    """(id, th, pos, mark, a, b, content, windows): each selected line with its hash and segment.

    windows: the first and last line, by their distance from pos, and the content of those that select the line.
    """
    lines = docs.select(F.col(f"`{id_col}`").alias("id"), F.xxhash64(f"`{text_col}`").alias("th"), F.posexplode(F.split(f"`{text_col}`", "\n")).alias("pos", "line")).where(F.col("line").rlike("[^ \t\r]"))
    lines = lines.select("id", "th", "pos", F.xxhash64(F.regexp_replace("line", "^[ \t\r]+|[ \t\r]+$", "")).alias("h"), F.regexp_count("line", F.lit("[^ \t\r]+")).cast("long").alias("n"))
    lines = lines.dropDuplicates(["id", "th", "pos"])
    doc = Window.partitionBy("id", "th")
    lines = lines.withColumn("e", F.sum("n").over(doc.orderBy("pos"))).withColumn("s", F.col("e") - F.col("n"))
    ahead, back = doc.orderBy("s").rangeBetween(0, min_words - 1), doc.orderBy("e").rangeBetween(1 - min_words, 0)

    def taken(frame, a, b):
        return F.struct(a.alias("a"), b.alias("b"), F.min(F.struct("h", "pos")).over(frame).alias("mark"), F.xxhash64(F.collect_list("h").over(frame)).alias("content"), F.sum("n").over(frame).alias("words"))

    both = lines.select("id", "th", taken(ahead, F.col("pos"), F.max("pos").over(ahead)).alias("x"), taken(back, F.min("pos").over(back), F.col("pos")).alias("y"))
    every = both.select("id", "th", F.explode(F.array("x", "y")).alias("w")).select("id", "th", "w.*").where(F.col("words") >= min_words)
    at = F.col("mark.pos")
    every = every.select("id", "th", at.alias("pos"), F.col("mark.h").alias("mark"), "a", "b", F.struct((F.col("a") - at).alias("a"), (F.col("b") - at).alias("b"), "content").alias("w"))
    # a window that is met both ways counts once
    every = every.groupBy("id", "th", "pos", "mark").agg(F.min("a").alias("a"), F.max("b").alias("b"), F.sort_array(F.collect_set("w")).alias("windows"))
    return every.withColumn("content", F.xxhash64("windows"))


def later_ones(found: DataFrame, keys: list[str]) -> tuple[DataFrame, DataFrame]:
    """Of staged rows (id, th, a, keys): those that equal an earlier one in all keys; and each kind's first place and number."""
    firsts = staged(found.groupBy(*keys).agg(F.min(F.struct("id", "th", "a")).alias("first"), F.count("*").alias("k")), "firsts")
    again = firsts.where("k > 1").select(*(F.col(c).alias(f"first {c}") for c in keys), "first")
    same = [F.col(c) == F.col(f"first {c}") for c in keys]
    return found.join(again, same).where(~F.struct("id", "th", "a").eqNullSafe(F.col("first"))), firsts


def repeats(docs: DataFrame, *, id_col: str = "doc_id", text_col: str = "text", min_words: int = MIN_WORDS) -> DataFrame:
    """(id, th, runs): by document, the maximal runs of lines (a, b) that occur earlier, in order."""
    found = staged(segments(docs, id_col, text_col, min_words), "fingerprints")
    later, firsts = later_ones(found.drop("windows"), ["mark", "content"])
    several = staged(firsts.groupBy("mark").agg(F.count("*").alias("kinds")).where("kinds > 1").select(F.col("mark").alias("m")), "several")
    kinds = staged(firsts.join(several, F.col("mark") == F.col("m")).select("mark", "content", "first.*"), "kinds")
    here = [F.col("found.id").eqNullSafe(F.col("kinds.id")), *(F.col(f"found.{c}") == F.col(f"kinds.{c}") for c in ("th", "a", "mark", "content"))]
    apart = found.alias("found").join(kinds.alias("kinds"), here, "left_semi")
    apart = apart.select("id", "th", "mark", "pos", F.explode("windows").alias("w"))
    apart = staged(apart.select("id", "th", "mark", (F.col("pos") + F.col("w.a")).alias("a"), (F.col("pos") + F.col("w.b")).alias("b"), F.col("w.content").alias("content")), "windows")
    extended, _ = later_ones(apart, ["mark", "content"])
    spans = later.select("id", "th", "a", "b").union(extended.select("id", "th", "a", "b")).groupBy("id", "th", "a").agg(F.max("b").alias("b"))
    doc = Window.partitionBy("id", "th").orderBy("a")
    reach = F.max("b").over(doc.rowsBetween(Window.unboundedPreceding, -1))
    runs = spans.withColumn("new", F.coalesce((F.col("a") > reach + 1).cast("int"), F.lit(1))).withColumn("run", F.sum("new").over(doc))
    runs = runs.groupBy("id", "th", "run").agg(F.min("a").alias("a"), F.max("b").alias("b"))
    return runs.groupBy("id", "th").agg(F.sort_array(F.collect_list(F.struct("a", "b"))).alias("runs"))


def dedup_lines(docs: DataFrame, *, id_col: str = "doc_id", text_col: str = "text", min_words: int = MIN_WORDS) -> DataFrame:
    """docs without the later repeats, and removed_lines long, which replaces a column of that name."""
    found = repeats(docs, id_col=id_col, text_col=text_col, min_words=min_words)
    whole = packed(docs, text_col).withColumns({"key": F.col("row").getField(id_col), "hash": F.xxhash64("text")})
    hit = whole.join(found, F.col("key").eqNullSafe(F.col("id")) & (F.col("hash") == F.col("th")), "left")
    lines = F.split("text", "\n")
    begins = F.concat(F.array(F.lit(0)), F.transform("runs", lambda r: r["b"] + 1))
    ends = F.concat(F.transform("runs", lambda r: r["a"]), F.array(F.size(lines)))
    kept = F.flatten(F.transform(F.arrays_zip(begins.alias("s"), ends.alias("e")), lambda p: F.slice(F.col("lines"), p["s"] + 1, p["e"] - p["s"])))
    out = hit.withColumn("lines", F.when(F.col("runs").isNotNull(), lines))
    removed = F.coalesce(F.aggregate("runs", F.lit(0).cast("long"), lambda n, r: n + r["b"] - r["a"] + 1), F.lit(0).cast("long"))
    text = F.when(F.col("runs").isNull(), F.col("text")).otherwise(F.array_join(kept, "\n"))
    return unpacked(out.withColumns({"text": text, "removed_lines": removed}), docs.columns, text_col, own=("removed_lines",))


def op3_line_dedup(spark: SparkSession, sf_dir: str) -> DataFrame:
    docs = spark.read.parquet(f"{sf_dir}/documents.parquet").select("doc_id", "text", F.coalesce(F.size(F.split("text", "\n")), F.lit(0)).cast("long").alias("n_lines"))
    out = dedup_lines(docs)
    text = F.coalesce("text", F.lit(""))
    return out.select("doc_id", F.greatest("n_lines", F.lit(0)).alias("n_lines"), F.col("removed_lines").alias("n_removed"), F.length(text).cast("long").alias("n_chars"), F.sha2(text, 256).alias("kept_sha256"))


#: The definition itself, without fingerprints: a line goes if a window over it has content that begins earlier.
OP3_SQL = r"""
WITH lines AS (
  SELECT doc_id AS id, pos - 1 AS pos, trim(line, E' \t\r') AS line, len(regexp_extract_all(line, '[^ \t\r]+')) AS n
  FROM (SELECT doc_id, unnest(string_split(text, chr(10))) AS line, generate_subscripts(string_split(text, chr(10)), 1) AS pos FROM documents)
  WHERE regexp_matches(line, '[^ \t\r]')
), placed AS (
  SELECT *, sum(n) OVER (PARTITION BY id ORDER BY pos) AS e, sum(n) OVER (PARTITION BY id ORDER BY pos) - n AS s FROM lines
), taken AS (
  SELECT id, pos AS a, max(pos) OVER f AS b, list(line) OVER f AS content, sum(n) OVER f AS words FROM placed
  WINDOW f AS (PARTITION BY id ORDER BY s RANGE BETWEEN CURRENT ROW AND 49 FOLLOWING)
  UNION
  SELECT id, min(pos) OVER f, pos, list(line) OVER f, sum(n) OVER f FROM placed
  WINDOW f AS (PARTITION BY id ORDER BY e RANGE BETWEEN 49 PRECEDING AND CURRENT ROW)
), later AS (
  SELECT id, a, b FROM (SELECT *, row_number() OVER (PARTITION BY content ORDER BY id, a) AS k FROM taken WHERE words >= 50) WHERE k > 1
), gone AS (
  SELECT DISTINCT id, unnest(range(a, b + 1)) AS pos FROM later
), kept AS (
  SELECT d.id, d.n_lines, count(g.pos) AS n_removed, coalesce(string_agg(d.line, chr(10) ORDER BY d.pos) FILTER (WHERE g.pos IS NULL), '') AS text
  FROM (SELECT doc_id AS id, len(string_split(text, chr(10))) AS n_lines, unnest(string_split(text, chr(10))) AS line, generate_subscripts(string_split(text, chr(10)), 1) - 1 AS pos FROM documents) d
  LEFT JOIN gone g ON d.id = g.id AND d.pos = g.pos GROUP BY d.id, d.n_lines
)
SELECT d.doc_id, coalesce(k.n_lines, 0) AS n_lines, coalesce(k.n_removed, 0) AS n_removed, length(coalesce(k.text, '')) AS n_chars, sha256(coalesce(k.text, '')) AS kept_sha256
FROM documents d LEFT JOIN kept k ON k.id = d.doc_id
"""
