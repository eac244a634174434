"""Queries of the retrieval family."""

from __future__ import annotations

from pyspark.sql import functions as F

from tallyloom.functions.scalars import tags_of_map
from tallyloom.operators import retrieval as rt
from tallyloom.operators import text_space as ts
from tallyloom.operators import vector_index as vi
from tallyloom.plans.registry import query, with_sql
from tallyloom.session import written
from tallyloom.sources import bindings as b
from tallyloom.sources.bindings import RETRIEVAL_SQL

URL = "https://store.example/app/"
LANGUAGE = "en"

RERANK_SQL = """
picks AS (
  SELECT qid, max(id) FILTER (rank = 1) AS a, max(id) FILTER (rank = 2) AS b, max(id) FILTER (rank = 3) AS c
  FROM cand GROUP BY 1),
responses AS (
  SELECT qid, CASE qid % 4
    WHEN 0 THEN 'My choice: ["' || c || '", "' || a || '", "' || a || '", "999999999"] and more [1]'
    WHEN 1 THEN 'I cannot rank these.'
    WHEN 2 THEN '[' || b || ',' || chr(10) || ' ' || CAST((qid * 7 + 3) % 2000 AS VARCHAR) || ']'
    ELSE '[' || a || ', oops' END AS text FROM picks),
arrays AS (SELECT qid, regexp_extract(text, '(?s)\\[.*?\\]') AS x FROM responses),
parsed AS (SELECT qid, from_json(x, '["VARCHAR"]') AS ids FROM arrays WHERE x <> '' AND json_valid(x)),
positions AS (
  SELECT qid, id, min(pos) AS pos FROM (
    SELECT qid, unnest(ids) AS id, generate_subscripts(ids, 1) - 1 AS pos FROM parsed) GROUP BY 1, 2),
looked AS (
  SELECT p.qid, p.id, CAST(pos AS INT) AS pos, coalesce(similarity, 0.0) AS score
  FROM positions p JOIN games ON app_id = p.id LEFT JOIN cand c ON c.qid = p.qid AND c.id = p.id),
matches AS (
  SELECT qid, id, score, CAST(row_number() OVER (PARTITION BY qid ORDER BY pos NULLS LAST, score DESC, id) AS INT) AS rank, origin
  FROM (SELECT qid, id, score, pos, 'reranked' AS origin FROM looked
        UNION ALL SELECT qid, id, similarity, NULL,
          CASE WHEN qid IN (SELECT qid FROM parsed) THEN 'padded' ELSE 'fallback' END
        FROM cand WHERE (qid, id) NOT IN (SELECT (qid, id) FROM looked))
  QUALIFY rank <= 5),
card AS (
  SELECT qid, rank, app_id, coalesce(name, 'Unknown title') AS name, round(score, 4) AS score,
         coalesce(short_description, '') AS short_description, coalesce(genre_text, '') AS genres,
         coalesce(tag_text, '') AS tags, price, p_size
  FROM matches JOIN games ON id = app_id)
"""


def _sql(select: str, *extra: str) -> str:
    return with_sql(RETRIEVAL_SQL, *extra, select=select)


def records(spark, sf):
    """Catalogue records with the tag map as a list."""
    return b.games(spark, sf).withColumn("tags", tags_of_map(F.col("tags")))


def candidates(spark, sf, keep: bool = False):
    """Twenty nearest other vectors of every vector; written once where a plan reads it often."""
    out = rt.cosine_topk(b.query_vectors(spark, sf), b.vectors(spark, sf), 20, exclude_self=True)
    return written(out, "candidates") if keep else out


def responses(spark, sf, found):
    """Ranker answers built from the candidates: a list in prose with a repeated and an unknown
    id, no list at all, a list over two lines with an id outside the candidates, a broken list."""
    at = lambda n: F.max(F.when(F.col("rank") == n, F.col("id")))
    picks = found.groupBy("qid").agg(at(1).alias("a"), at(2).alias("b"), at(3).alias("c"))
    q = lambda c: F.concat(F.lit('"'), F.col(c), F.lit('"'))
    other = ((F.col("qid") * 7 + 3) % 2000).cast("string")
    kind = F.col("qid") % 4
    text = (
        F.when(kind == 0, F.concat(F.lit("My choice: ["), q("c"), F.lit(", "), q("a"), F.lit(", "), q("a"),
                                   F.lit(', "999999999"] and more [1]')))
        .when(kind == 1, F.lit("I cannot rank these."))
        .when(kind == 2, F.concat(F.lit("["), F.col("b"), F.lit(",\n "), other, F.lit("]")))
        .otherwise(F.concat(F.lit("["), F.col("a"), F.lit(", oops")))
    )
    return picks.select("qid", text.alias("text"))


def ids(spark, sf):
    return b.games(spark, sf).select(F.col("app_id").alias("id"))


def matches(spark, sf):
    found = candidates(spark, sf, keep=True)
    return rt.rerank(found, ids(spark, sf), responses(spark, sf, found), 5)


@query("cosine_topk", _sql("SELECT qid, id, similarity, rank FROM cand"))
def _(spark, sf):
    return candidates(spark, sf)


@query("approx_cosine_topk")
def _(spark, sf):
    return vi.approximate_topk(b.query_vectors(spark, sf), b.vectors(spark, sf), 20, exclude_self=True)


@query("approx_recall", _sql("""
SELECT count(DISTINCT qid) AS queries, count(*) AS neighbours, true AS recall_reached FROM cand"""))
def _(spark, sf):
    """The approximate search against the exact one: all neighbours of all vectors."""
    exact = candidates(spark, sf, keep=True)
    near = vi.approximate_topk(b.query_vectors(spark, sf), b.vectors(spark, sf), 20, exclude_self=True)
    return rt.recall(near, exact).select("queries", "neighbours", (F.col("recall") >= 0.9).alias("recall_reached"))


@query("text_vectorize_corpus")
def _(spark, sf):
    docs = b.table(spark, sf, "documents").select("doc_id", "text")
    return ts.dense_text_vectors(docs, "text")[0].select("doc_id", "vec")


@query("text_vector_norms", """
SELECT doc_id, length(trim(text)) > 0 AS has_words, CASE WHEN length(trim(text)) > 0 THEN 1.0::DOUBLE ELSE 0.0::DOUBLE END AS norm
FROM documents""")
def _(spark, sf):
    docs = b.table(spark, sf, "documents").select("doc_id", "text")
    squares = F.aggregate("vec", F.lit(0.0), lambda acc, x: acc + x * x)
    words = (F.length(F.trim("text")) > 0).alias("has_words")
    return ts.dense_text_vectors(docs, "text")[0].select("doc_id", words, F.round(F.sqrt(squares), 6).alias("norm"))


@query("rank_fallback_topk", _sql("SELECT qid, id, similarity AS score, rank FROM cand WHERE rank <= 5"))
def _(spark, sf):
    return rt.top_by_score(candidates(spark, sf), 5)


@query("ranked_id_lookup", _sql("SELECT qid, id, pos, score FROM looked", RERANK_SQL))
def _(spark, sf):
    found = candidates(spark, sf, keep=True)
    return rt.ranked_lookup(responses(spark, sf, found), ids(spark, sf), found)


@query("rerank_dedupe_pad", _sql("SELECT qid, id, score, rank, origin FROM matches", RERANK_SQL))
def _(spark, sf):
    return matches(spark, sf)


@query("filter_reviews_valid", _sql(f"""
SELECT appid, review_id, review, votes_up FROM reviews
WHERE language = '{LANGUAGE}' AND review IS NOT NULL AND trim(review) <> ''"""))
def _(spark, sf):
    return rt.valid_reviews(b.reviews(spark, sf), LANGUAGE).select("appid", "review_id", "review", "votes_up")


@query("top_n_reviews_per_game", _sql("SELECT * FROM top_reviews"))
def _(spark, sf):
    return rt.top_reviews(b.reviews(spark, sf), LANGUAGE, 3)


@query("result_card", _sql(f"""
SELECT qid, rank, app_id, name, score, short_description, genres, tags, price,
       NULL::VARCHAR AS release_date, 'img/' || app_id || '.jpg' AS header_image,
       '{URL}' || app_id AS store_page, p_size > 3 AS windows, p_size > 30 AS mac, false AS linux FROM card""", RERANK_SQL))
def _(spark, sf):
    cards = rt.result_cards(matches(spark, sf), records(spark, sf), URL)
    return cards.select(
        *[c for c in cards.columns if c not in ("genres", "tags", "platforms")],
        rt.joined("genres").alias("genres"), rt.joined("tags").alias("tags"), "platforms.*",
    )


@query("build_document_text", _sql("""
SELECT app_id, concat_ws('. ', name, short_description, 'Genres: ' || genre_text, 'Tags: ' || tag_text) AS document
FROM games"""))
def _(spark, sf):
    return rt.record_defaults(records(spark, sf)).select("app_id", rt.document_text().alias("document"))


@query("candidate_lines", _sql("""
SELECT qid, string_agg('app_id=' || app_id || ' | ' || name || ' | '
         || replace(substr(coalesce(short_description, ''), 1, 150), chr(10), ' ')
         || ' | tags: ' || coalesce(tag_text, ''), chr(10) ORDER BY rank) AS block
FROM cand JOIN games ON id = app_id GROUP BY 1"""))
def _(spark, sf):
    return rt.candidate_lines(candidates(spark, sf), records(spark, sf))


@query("rag_context", _sql("""
SELECT qid, string_agg('Game: ' || name || chr(10) || 'Description: ' || substr(short_description, 1, 300)
         || chr(10) || 'Genres: ' || genres || ' | Tags: ' || tags || chr(10) || 'Player reviews: '
         || coalesce(quotes, 'No reviews available.'), chr(10) || chr(10) ORDER BY rank) AS context
FROM card LEFT JOIN (
  SELECT appid, string_agg('"' || substr(review, 1, 200) || '"', ' | ' ORDER BY rank) AS quotes
  FROM top_reviews GROUP BY 1) r ON appid = app_id GROUP BY 1""", RERANK_SQL))
def _(spark, sf):
    best = rt.top_reviews(b.reviews(spark, sf), LANGUAGE, 3)
    return rt.answer_context(written(matches(spark, sf), "matches"), records(spark, sf), best)


@query("plain_answer", _sql("""
SELECT vec_id AS qid, coalesce('Based on your search for "vector ' || CAST(vec_id AS VARCHAR)
       || '", the closest matches are: ' || names || '.', 'No games were found matching your query.') AS answer
FROM vecs LEFT JOIN (
  SELECT qid, string_agg(name, ', ' ORDER BY rank) AS names FROM card WHERE rank <= 3 GROUP BY 1) n ON qid = vec_id""", RERANK_SQL))
def _(spark, sf):
    asked = b.query_vectors(spark, sf).select(
        "qid", F.concat(F.lit("vector "), F.col("qid").cast("string")).alias("query")
    )
    return rt.plain_answer(asked, matches(spark, sf), records(spark, sf))
