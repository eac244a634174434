"""A batch of searches end to end: candidates, ranking, result records, answer context."""

from __future__ import annotations

from dataclasses import dataclass

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from tallyloom.operators import retrieval as rt
from tallyloom.session import written


@dataclass(frozen=True)
class SearchResults:
    """Matches (qid, id, score, rank), their result records, context and plain answer per query."""

    matches: DataFrame
    cards: DataFrame
    context: DataFrame
    answers: DataFrame


def search(
    queries: DataFrame,
    vectors: DataFrame,
    records: DataFrame,
    reviews: DataFrame,
    responses: DataFrame | None = None,
    url_base: str = "",
    language: str = "english",
    candidates: int = 20,
    k: int = 5,
    exclude_self: bool = False,
) -> SearchResults:
    """``queries``: qid, query text, vec. ``responses`` are a ranker's texts per query (qid, text);
    without them the best candidates by similarity are the matches."""
    found = written(rt.cosine_topk(queries, vectors, candidates, exclude_self), "candidates")
    if responses is None:
        matches = rt.top_by_score(found, k)
    else:
        matches = rt.rerank(found, records.select(F.col("app_id").alias("id")), responses, k)
    matches = written(matches, "matches")
    return SearchResults(
        matches,
        rt.result_cards(matches, records, url_base),
        rt.answer_context(matches, records, rt.top_reviews(reviews, language)),
        rt.plain_answer(queries.select("qid", "query"), matches, records),
    )
