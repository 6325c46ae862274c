"""Retrieval over documents, benchmark items and embeddings."""

from __future__ import annotations

import numpy as np
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from loomspark.operators import retrieval as R
from loomspark.queries.base import Query
from loomspark.sources.tables import spread, table

ABSTAIN = 0.18


def _texts(spark: SparkSession, sf_dir: str) -> tuple[DataFrame, DataFrame]:
    docs = spread(table(spark, sf_dir, "documents").select(F.col("doc_id").alias("id"), "text"))
    return docs, table(spark, sf_dir, "benchmark").select(F.col("item_id").alias("id"), "text")


def bm25_topk(spark: SparkSession, sf_dir: str) -> DataFrame:
    best = R.top_k(R.bm25_first(*_texts(spark, sf_dir), 3), "query", "millionths", "id", 3)
    return best.select("query", "id", (F.col("millionths") / 1e6).alias("bm25"), F.col("rank").cast("long").alias("rank"))


def _tokens_sql(text: str) -> str:
    """The tokens of a text as a DuckDB list."""
    stop = ", ".join(f"'{w}'" for w in R.STOP_WORDS)
    parts = f"[x for x in regexp_extract_all(lower(regexp_replace({text}, '([a-z0-9])([A-Z])', '\\1 \\2', 'g')), '[a-z0-9]+|[\\x{{4e00}}-\\x{{9fff}}]+') if x NOT IN ({stop})]"
    return f"flatten([CASE WHEN regexp_full_match(p, '[\\x{{4e00}}-\\x{{9fff}}]{{3,}}') THEN [p] || [substring(p, i, 2) for i in range(1, length(p))] ELSE [p] END for p in {parts}])"


def _similarity_sql(left: str, right: str) -> str:
    """name_similarity in DuckDB."""
    plain = lambda x: f"regexp_replace(lower({x}), '[^a-z0-9]', '', 'g')"
    generic = ", ".join(f"'{w}'" for w in R.GENERIC)
    words = lambda x: f"list_distinct([lower(w) for w in regexp_extract_all(regexp_replace({x}, '([a-z0-9])([A-Z])', '\\1 \\2', 'g'), '[A-Za-z0-9]+') if lower(w) NOT IN ({generic})])"
    both, one, two = f"len(list_intersect({words(left)}, {words(right)}))", f"len({words(left)})", f"len({words(right)})"
    return f"CASE WHEN {plain(left)} = {plain(right)} THEN 1.0e0 WHEN {one} + {two} = 0 THEN 0.0e0 ELSE {both} / CAST({one} + {two} - {both} AS DOUBLE) END"


BM25_CTE = f"""
tok AS (SELECT doc_id AS id, {_tokens_sql('text')} AS tokens FROM documents),
stats AS (SELECT count(*) AS n, avg(coalesce(len(tokens), 0)) AS mean FROM tok),
post AS (SELECT id, term, count(*) AS tf FROM (SELECT id, unnest(tokens) AS term FROM tok) GROUP BY ALL),
len AS (SELECT id, len(tokens) AS length FROM tok),
df AS (SELECT term, count(*) AS df FROM post GROUP BY term),
qtok AS (SELECT item_id AS query, unnest({_tokens_sql('text')}) AS term FROM benchmark),
q AS (SELECT query, term, least(count(*), 2) AS qtf FROM qtok GROUP BY ALL),
raw AS (
  SELECT query, post.id, sum(qtf * ln(1 + (n - df + 0.5e0) / (df + 0.5e0)) * tf * 2.2e0 / (tf + 1.2e0 * (0.25e0 + 0.75e0 * length / mean))) AS raw
  FROM q JOIN df USING (term) JOIN post USING (term) JOIN len ON post.id = len.id, stats GROUP BY query, post.id),
bm AS (SELECT query, id, CASE WHEN max(raw) OVER (PARTITION BY query) = 0 THEN 0 ELSE raw / max(raw) OVER (PARTITION BY query) END AS bm25 FROM raw)"""

BM25 = f"""
WITH {BM25_CTE}
SELECT query, id, bm25, rank FROM (SELECT query, id, round(bm25, 6) AS bm25, row_number() OVER (PARTITION BY query ORDER BY round(bm25, 6) DESC, id) AS rank FROM bm) WHERE rank <= 3
"""


#: Names against aliases, some equal but for case and signs, some only after a generic word goes, some not in Latin letters.
NAMES = (("DataGrid", ("data-grid", "TableView")), ("CustomButton", ("Button", "IconButton")), ("ViewControl", ("Widget", "Panel")), ("ToggleSwitchEx", ("Switch", "ToggleSwitch")), ("控件", ("按钮", "Button")), ("", ("Button",)))


def name_jaccard(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Brands, and names with aliases, each against part types: the best alias's similarity, blocked by the words."""
    part = table(spark, sf_dir, "part")
    named = part.select(F.col("p_brand").alias("name"), F.array("p_name", "p_brand").alias("aliases")).distinct()
    fixed = spark.createDataFrame([(n, list(a)) for n, a in NAMES], "name string, aliases array<string>")
    rows = named.unionByName(fixed).select("name", F.explode("aliases").alias("alias"))
    scored = rows.unionByName(fixed.select("name", F.col("name").alias("alias"))).select("name", R.name_similarity(F.col("name"), F.col("alias")).alias("s"), R.name_words(F.col("alias")).alias("words"))
    return scored.groupBy("name").agg(F.round(F.max("s"), 6).alias("similarity"), F.max(F.size("words")).cast("long").alias("most_words"))


_NAME_ROWS = ", ".join("('" + n + "', [" + ", ".join(f"'{x}'" for x in a) + "])" for n, a in NAMES)
JACCARD = f"""
WITH f AS (SELECT * FROM (VALUES {_NAME_ROWS}) v(name, aliases)),
r AS (SELECT name, unnest(aliases) AS alias FROM (SELECT DISTINCT p_brand AS name, [p_name, p_brand] AS aliases FROM part UNION ALL SELECT * FROM f) UNION ALL SELECT name, name FROM f)
SELECT name, round(max({_similarity_sql('name', 'alias')}), 6) AS similarity,
       max(len(list_distinct([lower(w) for w in regexp_extract_all(regexp_replace(alias, '([a-z0-9])([A-Z])', '\\1 \\2', 'g'), '[A-Za-z0-9]+') if lower(w) NOT IN ({", ".join(f"'{w}'" for w in R.GENERIC)})]))) AS most_words FROM r GROUP BY name
"""


def similar_names(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Component names made of parts' types and names, and of names with a generic word, against the names of all parts: the
    three most similar of those that are similar at all. Names meet by a shared word, or by their letters and digits."""
    part = table(spark, sf_dir, "part")
    symbol = F.replace(F.initcap("p_name"), F.lit(" "), F.lit(""))
    made = part.select(F.explode(F.array(F.concat(F.initcap("p_type"), symbol), F.concat(symbol, F.lit("View")), symbol)).alias("name")).distinct()
    known = part.select(F.col("p_name").alias("other")).distinct()
    plain = lambda c: F.concat(F.lit("="), F.regexp_replace(F.lower(c), "[^a-z0-9]", ""))
    keyed = lambda rows, c: rows.select(c, F.explode(F.array_union(R.name_words(F.col(c)), F.array(plain(c)))).alias("key"))
    pairs = keyed(made, "name").join(keyed(known, "other"), "key").select("name", "other").distinct()
    scored = pairs.select("name", "other", F.round(R.name_similarity(F.col("name"), F.col("other")), 6).alias("similarity"))
    return R.top_k(scored, "name", "similarity", "other", 3).withColumn("rank", F.col("rank").cast("long"))


SIMILAR = f"""
WITH w AS (SELECT p_type, p_name, array_to_string(list_transform(string_split(p_name, ' '), lambda w: upper(w[1]) || w[2:]), '') AS symbol FROM part),
m AS (SELECT upper(p_type[1]) || lower(p_type[2:]) || symbol AS name FROM w UNION SELECT symbol || 'View' FROM w UNION SELECT symbol FROM w),
k AS (SELECT DISTINCT p_name AS other FROM part),
s AS (SELECT name, other, {_similarity_sql('name', 'other')} AS exact, round(exact, 6) AS similarity FROM m, k)
SELECT name, other, similarity, rank FROM (SELECT *, row_number() OVER (PARTITION BY name ORDER BY similarity DESC, other) AS rank FROM s WHERE exact > 0) WHERE rank <= 3
"""


def _queries_and_all(spark: SparkSession, sf_dir: str) -> tuple[DataFrame, DataFrame]:
    """Every row whose id is divisible by 100 is a query against all rows: a stated query set."""
    rows = table(spark, sf_dir, "embeddings").where("vec_id is not null").select(F.col("vec_id").alias("id"), "label", F.col("embedding").alias("v"))
    return spread(rows), rows.where("id % 100 = 0")


def cosine_topk(spark: SparkSession, sf_dir: str) -> DataFrame:
    near = R.nearest(*_queries_and_all(spark, sf_dir), 5)
    best = R.top_k(near, "query", "millionths", "id", 5)
    return best.select("query", F.col("id").alias("vec_id"), (F.col("millionths") / 1e6).alias("cosine"), F.col("rank").cast("long").alias("rank"))


COSINE_CTE = """
c AS (
  SELECT a.vec_id AS query, b.vec_id, a.label AS query_label, b.label, round(greatest(0, list_sum([x[1] * x[2] for x in list_zip(a.embedding::DOUBLE[], b.embedding::DOUBLE[])]) /
         (sqrt(list_sum([x * x for x in a.embedding::DOUBLE[]])) * sqrt(list_sum([x * x for x in b.embedding::DOUBLE[]])))), 6) AS cosine
  FROM embeddings a JOIN embeddings b ON a.vec_id <> b.vec_id WHERE a.vec_id % 100 = 0)"""

COSINE = f"""
WITH {COSINE_CTE}
SELECT query, vec_id, cosine, rank FROM (SELECT *, row_number() OVER (PARTITION BY query ORDER BY cosine DESC, vec_id) AS rank FROM c) WHERE rank <= 5
"""


#: Numbers of a query's name, and the sources up to which their names' scores are broadcast.
NUMBERS, BROADCAST_SOURCES = 20, 10_000


def _fused(d, q, raw):
    """A block's three best by the weighted sum, for each query of another."""
    names = np.array(d.column("name").to_pylist(), "float64").reshape(-1, NUMBERS)
    name = names[:, np.mod(q.column("query").to_numpy(zero_copy_only=False), NUMBERS)].T
    lexical, (alike, again) = R.share(q, raw), R.cosines(q.column("e"), d.column("e"))
    bare = q.column("bare").to_numpy(zero_copy_only=False)[:, None] | d.column("bare").to_numpy(zero_copy_only=False)[None, :]
    fuse = lambda name, lexical, alike, bare: np.where(bare, 0.55 * name + 0.45 * lexical, 0.45 * name + 0.35 * lexical + 0.20 * alike)
    score = R.rounded(fuse(name, lexical, alike, bare), lambda i, j: fuse(name[i, j], lexical[i, j], again(i, j), bare[i, j]))
    return R.first_in_block(d, q, raw, score, 3)


def fused_retrieval_abstain(spark: SparkSession, sf_dir: str) -> DataFrame:
    """A known mapping first; else 0.45 name + 0.35 lexical + 0.20 vector; abstain below a threshold."""
    vectors = table(spark, sf_dir, "embeddings").select(F.col("vec_id").alias("id"), F.col("embedding").cast("array<double>").alias("e"), F.lit(False).alias("bare"))
    docs = table(spark, sf_dir, "documents").select(F.col("doc_id").alias("id"), "source")
    # A name's score depends on the source and the query's number alone: computed once for each of both.
    alike = lambda n: R.alias_similarity(F.coalesce("source", F.lit("")), F.array(F.lit(f"Source{n}"), F.lit(f"Src{n}View")))
    names = docs.select("source").distinct()
    few = names.limit(BROADCAST_SOURCES + 1).count() <= BROADCAST_SOURCES
    names = names.select(F.col("source").alias("of"), F.array(*map(alike, range(NUMBERS))).alias("name"))
    with_vector = lambda rows: rows.join(vectors, "id", "left").withColumn("bare", F.coalesce("bare", F.lit(True)))
    named = docs.join(F.broadcast(names) if few else names, F.col("source").eqNullSafe(F.col("of"))).select("id", "name")
    texts, asked = _texts(spark, sf_dir)
    index = R.lexical(texts, asked, with_vector(named), with_vector(asked.select("id")))
    best = R.top_k(R.lexical_pairs(index, _fused, "query long, id long, millionths long").withColumn("score", F.col("millionths") / 1e6), "query", "millionths", "id", 3)
    known = F.col("query") % 10 == 0
    return best.select("query", "id", F.when(known & (F.col("rank") == 1), 1.0).otherwise(F.col("score")).alias("score"), F.col("rank").cast("long").alias("rank"), F.when(known, "mapping").when(F.max("score").over(R.W.partitionBy("query")) < ABSTAIN, "abstain").otherwise("retrieval").alias("strategy"))


FUSED = f"""
WITH {BM25_CTE},
s AS (
  SELECT bm.query, bm.id, bm25, greatest({_similarity_sql("coalesce(source, '')", "('Source' || CAST(bm.query % 20 AS VARCHAR))")}, {_similarity_sql("coalesce(source, '')", "('Src' || CAST(bm.query % 20 AS VARCHAR) || 'View')")}) AS name,
    greatest(0, list_sum([x[1] * x[2] for x in list_zip(a.embedding::DOUBLE[], b.embedding::DOUBLE[])]) / (sqrt(list_sum([x * x for x in a.embedding::DOUBLE[]])) * sqrt(list_sum([x * x for x in b.embedding::DOUBLE[]])))) AS cosine,
    a.vec_id IS NULL OR b.vec_id IS NULL AS bare
  FROM bm JOIN documents d ON bm.id = d.doc_id LEFT JOIN embeddings b ON b.vec_id = bm.id LEFT JOIN embeddings a ON a.vec_id = bm.query),
f AS (SELECT query, id, round(CASE WHEN bare THEN 0.55e0 * name + 0.45e0 * bm25 ELSE 0.45e0 * name + 0.35e0 * bm25 + 0.20e0 * cosine END, 6) AS score FROM s),
r AS (SELECT *, row_number() OVER (PARTITION BY query ORDER BY score DESC, id) AS rank, max(score) OVER (PARTITION BY query) AS top FROM f)
SELECT query, id, CASE WHEN query % 10 = 0 AND rank = 1 THEN 1.0e0 ELSE score END AS score, rank, CASE WHEN query % 10 = 0 THEN 'mapping' WHEN top < {ABSTAIN} THEN 'abstain' ELSE 'retrieval' END AS strategy FROM r WHERE rank <= 3
"""


def recall_mrr(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Recall at 3 and mean reciprocal rank; relevant is a row of the query's label."""
    first = R.first_relevant(*_queries_and_all(spark, sf_dir))
    return first.groupBy("label").agg(F.count("*").alias("queries"), F.round(F.avg(F.when(F.col("first") <= 3, 1.0).otherwise(0.0)), 6).alias("recall_at_3"), F.round(F.avg(F.coalesce(1 / F.col("first"), F.lit(0.0))), 6).alias("mrr"))


RECALL = f"""
WITH {COSINE_CTE},
r AS (SELECT *, row_number() OVER (PARTITION BY query ORDER BY cosine DESC, vec_id) AS rank FROM c),
f AS (SELECT query, query_label, min(CASE WHEN label = query_label THEN rank END) AS first FROM r GROUP BY ALL)
SELECT query_label AS label, count(*) AS queries, round(avg(CASE WHEN first <= 3 THEN 1.0e0 ELSE 0.0e0 END), 6) AS recall_at_3, round(avg(coalesce(1.0e0 / first, 0)), 6) AS mrr FROM f GROUP BY 1
"""


def document_frequency(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Documents and occurrences of each term by language: one aggregate, of sums that each task makes first."""
    docs = spread(table(spark, sf_dir, "documents").select("lang", "text")).select("lang", R.tokens(F.col("text")).alias("tokens"))
    row = lambda d, c: lambda x: F.struct(x.alias("term"), F.lit(d).alias("df"), F.lit(c).alias("cf"))
    rows = docs.select("lang", F.explode(F.concat(F.transform(F.array_distinct("tokens"), row(1, 0)), F.transform("tokens", row(0, 1)))).alias("r"))
    return rows.groupBy("lang", "r.term").agg(F.sum("r.df").alias("df"), F.sum("r.cf").alias("cf"))


FREQUENCY = f"""
WITH t AS (SELECT doc_id, lang, unnest({_tokens_sql('text')}) AS term FROM documents)
SELECT lang, term, count(DISTINCT doc_id) AS df, count(*) AS cf FROM t GROUP BY ALL
"""


def token_goldens(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Tokens and rendered texts of rows with CJK runs, stop words and nothing at all."""
    rows = spark.createDataFrame(list(TOKEN_ROWS), "id int, name string, note string")
    text = R.search_text(F.col("name"), F.col("note"))
    return rows.select("id", F.array_join(R.tokens(text), "|").alias("tokens"), R.render(name=F.col("name"), note=F.col("note")).alias("rendered"))


TOKEN_ROWS = ((1, "DataGridRow", "表格控件行 x"), (2, "wpf Widget", "控件"), (3, "数据", ""), (4, "", ""), (5, "MUIButton2Go", "按钮组件按钮 custom"), (6, "组件", "切换开关"))
TOKENS = f"""
WITH r AS (SELECT * FROM (VALUES {", ".join(f"({i}, '{n}', '{t}')" for i, n, t in TOKEN_ROWS)}) v(id, name, note)),
s AS (SELECT *, array_to_string([x for x in [name, note] if x <> ''], ' ') AS text FROM r)
SELECT id, array_to_string({_tokens_sql('text')}, '|') AS tokens, array_to_string([x for x in [CASE WHEN name <> '' THEN 'name: ' || name END, CASE WHEN note <> '' THEN 'note: ' || note END] if x IS NOT NULL], chr(10) || chr(10)) AS rendered FROM s
"""

QUERIES = {
    "bm25_topk": Query(bm25_topk, BM25),
    "name_jaccard": Query(name_jaccard, JACCARD),
    "similar_names": Query(similar_names, SIMILAR),
    "cosine_topk": Query(cosine_topk, COSINE),
    "fused_retrieval_abstain": Query(fused_retrieval_abstain, FUSED),
    "recall_mrr": Query(recall_mrr, RECALL),
    "document_frequency": Query(document_frequency, FREQUENCY),
    "token_goldens": Query(token_goldens, TOKENS),
}
