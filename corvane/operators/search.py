"""Retrieval: keyword and vector ranking, rank fusion, reranking, similarity joins."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import Window as W
from pyspark.sql import functions as F

from corvane.functions import text as T
from corvane.plans.registry import query
from corvane.sources.tables import SQL, claims, read, wiki

#: Rank fusion's constant, source weights, and bonuses (fixed values).
RRF_K = 60
SOURCE_WEIGHTS = {"vector": 0.5, "keyword": 0.3, "graph": 0.2}
DIVERSITY_BONUS = OVERLAP_BOOST = 0.1


def keyword_search(pages: DataFrame, needle: str, top_k: int) -> DataFrame:
    """(doc_id, score): occurrences of the needle in the body, and 2 if the title has it; the best top_k."""
    title = F.when(F.lower("title").contains(needle.lower()), F.lit(2)).otherwise(0)
    hits = pages.where(F.lower("body").contains(needle.lower()))
    return hits.select("doc_id", (T.occurrences("body", needle) + title).cast("double").alias("score")).orderBy(F.desc("score"), "doc_id").limit(top_k)


def squared_distance(a, b) -> Column:
    return F.aggregate(F.zip_with(a, b, lambda x, y: (x.cast("double") - y.cast("double")) * (x.cast("double") - y.cast("double"))), F.lit(0.0), lambda s, x: s + x)


def cosine(a, b) -> Column:
    """0 for vectors of different length and for zero vectors."""

    def dot(x, y):
        return F.aggregate(F.zip_with(x, y, lambda p, q: p.cast("double") * q.cast("double")), F.lit(0.0), lambda s, v: s + v)

    norm = F.sqrt(dot(a, a)) * F.sqrt(dot(b, b))
    return F.when((F.size(a) != F.size(b)) | (norm == 0) | norm.isNull(), F.lit(0.0)).otherwise(dot(a, b) / norm)


def vector_search(vectors: DataFrame, target: list[float], top_k: int) -> DataFrame:
    """(doc_id, score = 1 - Euclidean distance): the nearest top_k."""
    t = F.array(*(F.lit(float(x)) for x in target))
    return vectors.select(F.col("vec_id").alias("doc_id"), (1 - F.sqrt(squared_distance("embedding", t))).alias("score")).orderBy(F.desc("score"), "doc_id").limit(top_k)


def fuse(lists: list[DataFrame], k: int = RRF_K) -> DataFrame:
    """(doc_id, score): sum over the ranked lists of 1 / (k + rank). The lists are top-k results."""
    order = W.orderBy(F.desc("score"), "doc_id")
    ranked = [x.select("doc_id", (1 / (k + F.row_number().over(order))).alias("part")) for x in lists]
    every = ranked[0]
    for x in ranked[1:]:
        every = every.union(x)
    return every.groupBy("doc_id").agg(F.round(F.sum("part"), 6).alias("score"))


def first_vector(spark, sf_dir) -> list[float]:
    """The query vector: the one with the smallest id (a single row)."""
    return read(spark, sf_dir, "embeddings").orderBy("vec_id").select("embedding").first()[0]


def hybrid_search(pages: DataFrame, vectors: DataFrame, needle: str, target: list[float], top_k: int = 10) -> DataFrame:
    """Keyword and vector results fused; if one side is empty, the other side's raw scores."""
    if not needle.strip() or not 1 <= top_k <= 100:
        raise ValueError("a query and 1 to 100 results are needed")
    return fuse([vector_search(vectors, target, top_k), keyword_search(pages, needle, top_k)]).orderBy(F.desc("score"), "doc_id").limit(top_k)


KEYWORD_SQL = "SELECT doc_id, ((length(lower(body)) - length(replace(lower(body), 'the', ''))) // 3 + CASE WHEN contains(lower(title), 'the') THEN 2 ELSE 0 END)::DOUBLE AS score FROM wiki WHERE contains(lower(body), 'the') ORDER BY score DESC, doc_id LIMIT 10"
VECTOR_SQL = "SELECT vec_id AS doc_id, 1 - sqrt(d) AS score FROM (SELECT e.vec_id, list_sum(list_transform(range(1, len(e.embedding) + 1), lambda i: (e.embedding[i]::DOUBLE - q.embedding[i]::DOUBLE) ** 2)) AS d FROM embeddings e, (SELECT embedding FROM embeddings ORDER BY vec_id LIMIT 1) q) ORDER BY score DESC, doc_id LIMIT 10"


@query("top_01_vector_search", f"SELECT doc_id, round(score, 6) AS score FROM ({VECTOR_SQL})")
def top_vector(spark, sf_dir) -> DataFrame:
    return vector_search(read(spark, sf_dir, "embeddings"), first_vector(spark, sf_dir), 10).select("doc_id", F.round("score", 6).alias("score"))


@query("top_02_keyword_search", SQL + KEYWORD_SQL)
def top_keyword(spark, sf_dir) -> DataFrame:
    return keyword_search(wiki(spark, sf_dir), "the", 10)


@query(
    "win_01_rrf",
    SQL + f", k AS (SELECT doc_id, row_number() OVER (ORDER BY score DESC, doc_id) AS r FROM ({KEYWORD_SQL})), v AS (SELECT doc_id, row_number() OVER (ORDER BY score DESC, doc_id) AS r FROM ({VECTOR_SQL})) SELECT doc_id, round(sum(1.0 / (60 + r)), 6)::DOUBLE AS score FROM (SELECT * FROM v UNION ALL SELECT * FROM k) GROUP BY doc_id",
)
def rrf(spark, sf_dir) -> DataFrame:
    return fuse([vector_search(read(spark, sf_dir, "embeddings"), first_vector(spark, sf_dir), 10), keyword_search(wiki(spark, sf_dir), "the", 10)])


@query(
    "top_03_hybrid_search",
    SQL + f", k AS (SELECT doc_id, row_number() OVER (ORDER BY score DESC, doc_id) AS r FROM ({KEYWORD_SQL})), v AS (SELECT doc_id, row_number() OVER (ORDER BY score DESC, doc_id) AS r FROM ({VECTOR_SQL})) SELECT doc_id, round(sum(1.0 / (60 + r)), 6)::DOUBLE AS score FROM (SELECT * FROM v UNION ALL SELECT * FROM k) GROUP BY doc_id ORDER BY score DESC, doc_id LIMIT 10",
)
def hybrid(spark, sf_dir) -> DataFrame:
    return hybrid_search(wiki(spark, sf_dir), read(spark, sf_dir, "embeddings"), "the", first_vector(spark, sf_dir))


def rerank(results: DataFrame, question: str) -> DataFrame:
    """Weighted fusion of (id, source, score, text): the best score of an id times the weights of its sources, a bonus for each further source, and one for the share of the question's words that the text has."""
    words = F.array(*(F.lit(w) for w in question.lower().split()))
    best = results.groupBy("id", "source").agg(F.max(F.struct("score", "text")).alias("x"))
    weight = F.element_at(F.create_map(*[F.lit(y) for kv in SOURCE_WEIGHTS.items() for y in kv]), F.col("source"))
    per = best.groupBy("id").agg(F.max("x").alias("x"), F.sum(F.coalesce(weight, F.lit(0.0))).alias("w"), F.count("*").alias("n"), F.array_join(F.sort_array(F.collect_set("source")), ",").alias("sources"))
    score = F.least(F.lit(1.0), F.greatest(F.lit(0.0), F.col("x.score") * F.col("w") + DIVERSITY_BONUS * (F.col("n") - 1)))
    share = F.size(F.filter(words, lambda t: F.lower("x.text").contains(t))) / F.size(words)
    return per.select("id", "sources", F.round(F.least(F.lit(1.0), score + OVERLAP_BOOST * share), 6).alias("score"))


@query(
    "win_02_rerank",
    """WITH r AS (SELECT doc_id AS id, 'keyword' AS source, (doc_id * 31 % 100) / 100.0::DOUBLE AS score, text FROM documents UNION ALL SELECT doc_id, 'vector', (doc_id * 17 % 100) / 100.0::DOUBLE, text FROM documents WHERE doc_id % 2 = 0),
    p AS (SELECT id, max(score) AS s, any_value(text) AS text, sum(CASE source WHEN 'vector' THEN 0.5 ELSE 0.3 END)::DOUBLE AS w, count(*) AS n, string_agg(source, ',' ORDER BY source) AS sources FROM r GROUP BY id)
    SELECT id, sources, round(least(1.0, least(1.0, greatest(0.0, s * w + 0.1 * (n - 1))) + 0.1 * (contains(lower(text), 'the')::INT + contains(lower(text), 'with')::INT) / 2.0), 6)::DOUBLE AS score FROM p""",
)
def rerank_query(spark, sf_dir) -> DataFrame:
    d = read(spark, sf_dir, "documents")
    part = lambda df, m, s: df.select(F.col("doc_id").alias("id"), F.lit(s).alias("source"), (F.col("doc_id") * m % 100 / 100.0).alias("score"), "text")
    return rerank(part(d, 31, "keyword").union(part(d.where("doc_id % 2 = 0"), 17, "vector")), "the with")


@query("fn_15_cosine", "WITH e AS (SELECT vec_id, embedding::DOUBLE[] AS v FROM embeddings), q AS (SELECT v FROM e ORDER BY vec_id LIMIT 1) SELECT e.vec_id, round(list_cosine_similarity(e.v, q.v), 6) AS cosine FROM e, q")
def cosine_query(spark, sf_dir) -> DataFrame:
    t = F.array(*(F.lit(float(x)) for x in first_vector(spark, sf_dir)))
    return read(spark, sf_dir, "embeddings").select("vec_id", F.round(cosine("embedding", t), 6).alias("cosine"))


def similar_statements(statements: DataFrame, threshold: float, group: str = "entity") -> DataFrame:
    """Pairs (a, b, similarity) of one group's statements with a word Jaccard of at least threshold.

    Words meet in an equi-join of (group, word) under a prefix filter: sorted by corpus frequency, two sets
    that similar share one of their rarer words, so frequent words join nothing.
    """
    sets = statements.select(group, "id", T.tokens("statement").alias("t")).where(F.size("t") > 0)
    words = sets.select(group, "id", F.size("t").alias("n"), F.explode("t").alias("w"))
    often = words.groupBy("w").agg(F.count("*").alias("often"))
    rank = F.row_number().over(W.partitionBy(group, "id").orderBy("often", "w"))
    prefix = words.join(often, "w").withColumn("r", rank).where(F.col("r") <= F.col("n") - F.ceil(F.col("n") * threshold) + 1).select(group, "id", "w")
    pairs = prefix.withColumnRenamed("id", "a").join(prefix.withColumnRenamed("id", "b"), [group, "w"]).where("a < b").select(group, "a", "b").distinct()
    both = pairs.join(sets.select(group, F.col("id").alias("a"), F.col("t").alias("x")), [group, "a"]).join(sets.select(group, F.col("id").alias("b"), F.col("t").alias("y")), [group, "b"])
    return both.select(group, "a", "b", T.jaccard(F.col("x"), F.col("y")).alias("similarity")).where(F.col("similarity") >= threshold)


TOKENS_SQL = "list_distinct(regexp_extract_all(lower(statement), '[\\p{L}\\p{N}_]+'))"
PAIRS_SQL = f", t AS (SELECT id, entity, statement, {TOKENS_SQL} AS t FROM (SELECT id, entity, statement FROM claims UNION ALL SELECT id || 'n', entity, 'not ' || substr(statement, 1, length(statement) // 2) FROM claims)), p AS (SELECT x.entity, x.id AS a, y.id AS b, x.statement AS sa, y.statement AS sb, len(list_intersect(x.t, y.t)) / len(list_distinct(list_concat(x.t, y.t))) AS similarity FROM t x JOIN t y ON x.entity = y.entity AND x.id < y.id WHERE len(x.t) > 0 AND len(y.t) > 0)"


def disputed(spark, sf_dir) -> DataFrame:
    """Claims, and each one's first half denied, so that there is something to find."""
    c = claims(spark, sf_dir).select("id", "entity", "statement")
    half = F.substring("statement", F.lit(1), F.floor(F.length("statement") / 2).cast("int"))
    return c.union(c.select(F.concat("id", F.lit("n")), "entity", F.concat(F.lit("not "), half)))


@query("jn_09_similar_claims", SQL + PAIRS_SQL + " SELECT entity, a, b, round(similarity, 6) AS similarity FROM p WHERE similarity >= 0.25")
def similar_claims(spark, sf_dir) -> DataFrame:
    """Claim pairs of one conversation with a word Jaccard of 0.25 or more."""
    return similar_statements(disputed(spark, sf_dir), 0.25).select("entity", "a", "b", F.round("similarity", 6).alias("similarity"))


@query("str_07_tokens", SQL + f"SELECT id, len({TOKENS_SQL}) AS n_tokens FROM claims")
def token_counts(spark, sf_dir) -> DataFrame:
    return claims(spark, sf_dir).select("id", F.size(T.tokens("statement")).cast("long").alias("n_tokens"))


# What makes a statement negative.
NEGATIONS = ("not", "no", "never", "none", "neither", "nor", "nothing", "nowhere", "cannot", "without")


def negated(text) -> Column:
    return F.arrays_overlap(T.tokens(text), F.array(*map(F.lit, NEGATIONS)))


NEGATED_SQL = "list_has_any(regexp_extract_all(lower({0}), '[\\p{{L}}\\p{{N}}_]+'), ['not', 'no', 'never', 'none', 'neither', 'nor', 'nothing', 'nowhere', 'cannot', 'without'])"


@query("str_09_negation", SQL + f"SELECT id, {NEGATED_SQL.format('statement')} AS negated FROM claims")
def negation(spark, sf_dir) -> DataFrame:
    return claims(spark, sf_dir).select("id", negated("statement").alias("negated"))


def conflicts(statements: DataFrame, threshold: float = 0.25) -> DataFrame:
    """(entity, a, b, conflict_type, confidence): similar statements of which one or both are negated, or that are very alike."""
    pairs = similar_statements(statements, threshold)
    side = lambda c: statements.select("entity", F.col("id").alias(c), F.lower(F.trim("statement")).alias(f"s{c}"), negated("statement").alias(f"n{c}"))
    both = pairs.join(side("a"), ["entity", "a"]).join(side("b"), ["entity", "b"]).where("sa <> sb and similarity <= 0.9")
    kind = F.when(F.col("na") != F.col("nb"), "contradiction").when(F.col("na") & F.col("nb"), "inconsistency").when(F.col("similarity") > 0.5, "disagreement")
    sure = F.when(kind == "contradiction", 0.9).when(kind == "inconsistency", 0.5).otherwise(0.6)
    return both.where(kind.isNotNull()).select("entity", "a", "b", kind.alias("conflict_type"), sure.alias("confidence"))


@query(
    "cnf_01_conflicts",
    SQL + PAIRS_SQL + f", c AS (SELECT *, {NEGATED_SQL.format('sa')} AS na, {NEGATED_SQL.format('sb')} AS nb FROM p WHERE similarity >= 0.25 AND similarity <= 0.9 AND lower(trim(sa)) <> lower(trim(sb))), k AS (SELECT *, CASE WHEN na <> nb THEN 'contradiction' WHEN na AND nb THEN 'inconsistency' WHEN similarity > 0.5 THEN 'disagreement' END AS conflict_type FROM c) SELECT entity, a, b, conflict_type, CASE conflict_type WHEN 'contradiction' THEN 0.9 WHEN 'inconsistency' THEN 0.5 ELSE 0.6 END::DOUBLE AS confidence FROM k WHERE conflict_type IS NOT NULL",
)
def conflicts_query(spark, sf_dir) -> DataFrame:
    return conflicts(disputed(spark, sf_dir))


@query("str_17_overlap_boost", SQL + "SELECT id, round(0.1 * (contains(lower(title || ' ' || body), 'the')::INT + contains(lower(title || ' ' || body), 'this')::INT + contains(lower(title || ' ' || body), 'zzz')::INT) / 3, 6)::DOUBLE AS boost FROM wiki")
def overlap_boost(spark, sf_dir) -> DataFrame:
    words = F.array(F.lit("the"), F.lit("this"), F.lit("zzz"))
    whole = F.lower(F.concat_ws(" ", "title", "body"))
    return wiki(spark, sf_dir).select("id", F.round(OVERLAP_BOOST * F.size(F.filter(words, lambda t: whole.contains(t))) / F.size(words), 6).alias("boost"))


# The words that tell the kinds of questions.
PROCEDURAL, DECISION = ("how to", "how do i", "steps to"), ("decision", "decide", "why did we")
EXPLAINING, FACT = ("how does", "why", "explain", "how "), ("what is", "who", "when", "where", "which", "what")


def question_type(text) -> Column:
    low = F.lower(F.trim(text))
    starts = lambda ws: F.exists(F.array(*map(F.lit, ws)), lambda w: low.startswith(w))
    has = lambda ws: F.exists(F.array(*map(F.lit, ws)), lambda w: low.contains(w))
    return F.when(starts(PROCEDURAL), "procedural").when(has(DECISION), "decision_context").when(starts(EXPLAINING), "explanatory").otherwise("factoid")


@query(
    "str_13_question_type",
    SQL + "SELECT id, CASE WHEN regexp_matches(s, '^(how to|how do i|steps to)') THEN 'procedural' WHEN regexp_matches(s, 'decision|decide|why did we') THEN 'decision_context' WHEN regexp_matches(s, '^(how does|why|explain|how )') THEN 'explanatory' ELSE 'factoid' END AS question_type FROM (SELECT id, lower(trim(statement)) AS s FROM claims)",
)
def question_types(spark, sf_dir) -> DataFrame:
    return claims(spark, sf_dir).select("id", question_type("statement").alias("question_type"))


@query("str_10_citations", SQL + "SELECT id, array_to_string(list_transform(range(1, len(l) + 1), lambda i: l[i]), ',') AS cited FROM (SELECT id, list_filter(list_distinct(regexp_extract_all(statement, '\\[([1-9][0-9]*)\\]', 1)), lambda x: x::BIGINT BETWEEN 1 AND 5) AS l FROM claims)")
def citations(spark, sf_dir) -> DataFrame:
    """Citation numbers from 1 to 5, once each."""
    return claims(spark, sf_dir).select("id", F.array_join(F.filter(T.citations("statement"), lambda x: x.between(1, 5)).cast("array<string>"), ",").alias("cited"))
