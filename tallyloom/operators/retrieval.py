"""Batch retrieval over vector tables: top-k search, reranking, reviews, context text.

All operators take a batch of queries as a table; ids are text.
"""

from __future__ import annotations

from collections.abc import Sequence

import numpy as np
import pandas as pd
from pyspark.ml import Pipeline
from pyspark.ml.feature import IDF, HashingTF, Normalizer, RegexTokenizer
from pyspark.ml.functions import vector_to_array
from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from tallyloom.functions.scalars import text_or_null

SCORES = "qid bigint, id string, cosine double"

# Texts of the assembled answers (fixed formats).
UNKNOWN_TITLE = "Unknown title"
NO_REVIEWS = "No reviews available."
NO_MATCHES = "No games were found matching your query."
LINE = ("app_id={}", " | {}", " | {}", " | tags: {}")
BLOCK = ("Game: {}", "\nDescription: {}", "\nGenres: {}", " | Tags: {}", "\nPlayer reviews: {}")
SENTENCE = ('Based on your search for "{}"', ", the closest matches are: {}.")


def _filled(template: Sequence[str], *values: Column) -> Column:
    """The parts of a fixed format with a column in each gap."""
    parts = []
    for text, value in zip(template, values, strict=True):
        before, after = text.split("{}")
        parts += [F.lit(before), value, F.lit(after)]
    return F.concat(*parts)


# --- vector search ----------------------------------------------------------------------------


def unit_rows(rows: Sequence) -> np.ndarray:
    """Vectors as rows of a matrix, scaled to length one; zero vectors stay."""
    matrix = np.array([np.asarray(r, dtype=np.float64) for r in rows])
    norms = np.linalg.norm(matrix, axis=1, keepdims=True)
    return matrix / np.where(norms == 0, 1.0, norms)


def _keep_best(frame: pd.DataFrame, k: int) -> pd.DataFrame:
    """First k rows per query by cosine, then id."""
    frame = frame.sort_values(["qid", "cosine", "id"], ascending=[True, False, True], kind="stable")
    return frame[frame.groupby("qid", sort=False).cumcount() < k]


#: Of so many columns one is looked at to find a bound that the best of all columns reach.
STRIDE = 16


def shortlist(scores: np.ndarray, k: int, slack: float = 0.0) -> tuple[np.ndarray, np.ndarray]:
    """Rows and columns, by row, of all scores that may be among the best ``k`` of their row, ties included.

    The k-th best of a part of the columns is not above the k-th best of all, so nothing below it (less ``slack``) counts.
    """
    part = scores[:, ::STRIDE] if scores.shape[1] >= 4 * STRIDE * k else scores
    width = part.shape[1]
    cut = np.partition(part, width - k, axis=1)[:, width - k] if width > k else part.min(axis=1)
    cut = np.maximum(cut - slack, np.finfo(scores.dtype).min)  # minus infinity marks what is left out
    return np.divmod(np.flatnonzero(scores >= cut[:, None].astype(scores.dtype)), scores.shape[1])


def places(row: np.ndarray, values: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    """An order by row, then larger values first, and the place (from 0) that each has in its row in that order."""
    order = np.lexsort((-values, row))
    row = row[order]
    return order, np.arange(len(row)) - np.searchsorted(row, row)


def _own_places(qids: np.ndarray, ids: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    """Positions of every query and item that have the same id, by query."""
    order, asked = np.argsort(ids, kind="stable"), qids.astype(str)
    first, last = (np.searchsorted(ids, asked, side, order) for side in ("left", "right"))
    many = last - first
    return np.repeat(np.arange(len(qids)), many), order[np.repeat(last - np.cumsum(many), many) + np.arange(many.sum())]


def _block_best(qids: np.ndarray, queries: np.ndarray, ids: np.ndarray, items: np.ndarray, k: int,
                exclude_self: bool, own: tuple[np.ndarray, np.ndarray] | None = None) -> pd.DataFrame:
    """Best k items of one block for each query of another; ties at the cut are all looked at.

    Cosines are rounded to nine digits so that equal vectors tie whatever block they are in. ``own`` may give the positions
    that ``exclude_self`` leaves out.
    """
    scores = queries @ items.T
    if exclude_self:
        scores[_own_places(qids, ids) if own is None else own] = -np.inf
    row, column = shortlist(scores, k, 2e-9)  # rounding moves two cosines towards each other by 1e-9 at most
    cosine = np.round(scores[row, column], 9)
    order, place = places(row, cosine)
    row, column, cosine = row[order], column[order], cosine[order]
    cut = np.full(len(qids), -np.inf)
    cut[row[place == k - 1]] = cosine[place == k - 1]
    kept = cosine >= cut[row]
    found = pd.DataFrame({"qid": qids[row[kept]], "id": ids[column[kept]].astype(object), "cosine": cosine[kept]})
    return _keep_best(found, k)


#: Blocks that a side is cut into for the sake of parallel work, before they have their full size: at most SPREAD where the
#: other side is one block, and about EACH where both sides have several, since every block of one meets every block of the other.
SPREAD, EACH = 32, 8
#: Cosines that a task holds at once, in a few copies of 16 MB.
TOGETHER = 1 << 21


def block_count(df: DataFrame, size: int, spread: Column | int = SPREAD) -> Column:
    """Blocks of at most about ``size`` rows, as a scalar the plan computes itself: eight times as many of a side that
    is small, up to ``spread``, since every block of one side is copied once per block of the other."""
    n = df.agg(F.count(F.lit(1))).scalar()
    most, few = F.ceil(n / F.lit(float(size))), F.ceil(n / F.lit(max(1.0, size / 8.0)))
    return F.greatest(F.lit(1), most, F.least(few, F.lit(spread) if isinstance(spread, int) else spread)).cast("int")


def _products(asked: DataFrame, held: DataFrame, keys: Sequence[str], k: int, exclude_self: bool) -> DataFrame:
    """The best k items per query within every cell of ``keys``: one matrix product per cell."""

    def product(q: pd.DataFrame, i: pd.DataFrame) -> pd.DataFrame:
        if not len(q) or not len(i):
            return pd.DataFrame({"qid": np.zeros(0, np.int64), "id": np.zeros(0, object), "cosine": np.zeros(0)})
        qids, asking = q["_qid"].to_numpy(np.int64), unit_rows(q["_qvec"])
        ids, held = i["id"].to_numpy(str), unit_rows(i["vec"])
        step = max(1, TOGETHER // len(i))
        row, column = _own_places(qids, ids) if exclude_self else (np.zeros(0, np.int64),) * 2
        out = []
        for a in range(0, len(q), step):
            own = slice(*np.searchsorted(row, (a, a + step)))
            out.append(_block_best(qids[a : a + step], asking[a : a + step], ids, held, k, exclude_self, (row[own] - a, column[own])))
        return pd.concat(out)

    return asked.groupBy(*[f"_q{c}" for c in keys]).cogroup(held.groupBy(*keys)).applyInPandas(product, SCORES)


def _ranked(found: DataFrame, k: int) -> DataFrame:
    best = Window.partitionBy("qid").orderBy(F.desc("cosine"), "id")
    return (
        found.withColumn("rank", F.row_number().over(best))
        .where(F.col("rank") <= k)
        .select("qid", "id", F.greatest("cosine", F.lit(0.0)).alias("similarity"), "rank")
    )


def cosine_topk(
    queries: DataFrame,
    items: DataFrame,
    k: int = 20,
    exclude_self: bool = False,
    block: int = 65_536,
    query_block: int = 32_768,
) -> DataFrame:
    """Exact k nearest items per query: qid, id, similarity = max(0, cosine), rank.

    Items and queries are cut into blocks of bounded size by hash; every pair of blocks is one
    task's matrix product, and only the best k per query leave it. Ties are settled by id. What travels grows with the
    number of blocks: every vector once per block of the other side, and k rows per query and block of items.
    """
    nq = block_count(queries, query_block, EACH)
    ni = block_count(items, block, F.greatest(F.lit(EACH), F.ceil(F.lit(float(SPREAD)) / nq)))
    held = items.select(
        "id", "vec", F.pmod(F.xxhash64("id"), ni).cast("int").alias("ib"), F.explode(F.sequence(F.lit(0), nq - 1)).alias("qb")
    )
    asked = queries.select(
        F.col("qid").alias("_qid"), F.col("vec").alias("_qvec"), F.explode(F.sequence(F.lit(0), ni - 1)).alias("_qib"),
        F.pmod(F.xxhash64("qid"), nq).cast("int").alias("_qqb"),
    )
    return _ranked(_products(asked, held, ["ib", "qb"], k, exclude_self), k)


def recall(found: DataFrame, exact: DataFrame) -> DataFrame:
    """One row: queries, exact neighbours, and the share of them that ``found`` has too."""
    pairs = exact.select("qid", "id").join(found.select("qid", "id", F.lit(1).alias("_hit")), ["qid", "id"], "left")
    return pairs.agg(
        F.countDistinct("qid").alias("queries"), F.count(F.lit(1)).alias("neighbours"),
        F.try_divide(F.sum(F.coalesce("_hit", F.lit(0))), F.count(F.lit(1))).alias("recall"),
    )


def word_weights(df: DataFrame, text: str, features: int = 1024) -> DataFrame:
    """Adds ``weights``: TF-IDF over hashed words as a sparse vector of unit length, without entries for texts without words;
    whole texts. ``df`` has rows."""
    steps = Pipeline(stages=[
        RegexTokenizer(inputCol=text, outputCol="_words", pattern=r"\s+"),
        HashingTF(inputCol="_words", outputCol="_tf", numFeatures=features),
        IDF(inputCol="_tf", outputCol="_idf"),
        Normalizer(inputCol="_idf", outputCol="weights"),
    ])
    return steps.fit(df).transform(df).drop("_words", "_tf", "_idf")


def text_vectors(df: DataFrame, text: str, features: int = 1024) -> DataFrame:
    """Adds ``vec``: TF-IDF over hashed words, unit length, all zero for texts without words; whole texts."""
    if df.isEmpty():
        return df.withColumn("vec", F.array().cast("array<double>"))
    return word_weights(df, text, features).withColumn("vec", vector_to_array("weights")).drop("weights")


# --- ranking ----------------------------------------------------------------------------------


def top_by_score(candidates: DataFrame, k: int = 5) -> DataFrame:
    """The k best candidates per query by similarity, for when no reranking exists."""
    best = Window.partitionBy("qid").orderBy(F.desc("similarity"), "id")
    return (
        candidates.select("qid", "id", F.col("similarity").alias("score"), F.row_number().over(best).alias("rank"))
        .where(F.col("rank") <= k)
    )


def parsed_ids(text: Column) -> Column:
    """The first JSON array in a text as a list of ids; null when there is none or it is broken."""
    found = F.regexp_extract(text, r"(?s)\[.*?\]", 0)
    return F.from_json(text_or_null(found), "array<string>")


def ranker_positions(responses: DataFrame) -> DataFrame:
    """First position of every id in each parsable response: qid, id, pos."""
    ids = responses.select("qid", parsed_ids(F.col("text")).alias("ids")).where(F.col("ids").isNotNull())
    return (
        ids.select("qid", F.posexplode("ids").alias("pos", "id"))
        .where(F.col("id").isNotNull())
        .groupBy("qid", "id")
        .agg(F.min("pos").alias("pos"))
    )


def ranked_lookup(responses: DataFrame, records: DataFrame, candidates: DataFrame) -> DataFrame:
    """Known ids of each response with position and score; 0.0 when not a candidate.

    Ids are checked against all records, not just the candidates.
    """
    scores = candidates.select("qid", "id", F.col("similarity").alias("score"))
    return (
        ranker_positions(responses)
        .join(records.select("id"), "id", "left_semi")
        .join(scores, ["qid", "id"], "left")
        .select("qid", "id", "pos", F.coalesce("score", F.lit(0.0)).alias("score"))
    )


def rerank(candidates: DataFrame, records: DataFrame, responses: DataFrame, k: int = 5) -> DataFrame:
    """Reranked matches per query: qid, id, score, rank, origin.

    The ranker's ids come first in its order, candidates it left out fill up to k by
    similarity; without a parsable response all k come from similarity.
    """
    asked = candidates.select("qid").distinct()
    chosen = ranked_lookup(responses, records, candidates).join(asked, "qid", "left_semi")
    parsable = (
        responses.where(parsed_ids(F.col("text")).isNotNull())
        .select("qid", F.lit(True).alias("_parsed"))
        .dropDuplicates(["qid"])
    )
    padding = (
        candidates.join(chosen.select("qid", "id"), ["qid", "id"], "left_anti")
        .join(parsable, "qid", "left")
        .select(
            "qid", "id", F.col("similarity").alias("score"), F.lit(None).cast("int").alias("pos"),
            F.when(F.col("_parsed"), "padded").otherwise("fallback").alias("origin"),
        )
    )
    rows = chosen.withColumn("origin", F.lit("reranked")).unionByName(padding)
    order = Window.partitionBy("qid").orderBy(F.asc_nulls_last("pos"), F.desc("score"), "id")
    return (
        rows.withColumn("rank", F.row_number().over(order))
        .where(F.col("rank") <= k)
        .select("qid", "id", "score", "rank", "origin")
    )


# --- reviews ----------------------------------------------------------------------------------


def valid_reviews(reviews: DataFrame, language: str) -> DataFrame:
    return reviews.where(
        (F.col("language") == language) & F.col("review").isNotNull() & (F.trim("review") != "")
    )


def top_reviews(reviews: DataFrame, language: str, n: int = 3) -> DataFrame:
    """The n most helpful reviews per game, whole texts without surrounding white space."""
    best = Window.partitionBy("appid").orderBy(F.desc("votes_up"), "review_id")
    return (
        valid_reviews(reviews, language)
        .withColumn("rank", F.row_number().over(best))
        .where(F.col("rank") <= n)
        .select("appid", "review_id", F.regexp_replace("review", r"^\s+|\s+$", "").alias("review"), "votes_up", "rank")
    )


# --- records and text -------------------------------------------------------------------------


def joined(values: str) -> Column:
    """List as comma-separated text; empty when missing."""
    return F.coalesce(F.array_join(values, ", "), F.lit(""))


def record_defaults(records: DataFrame) -> DataFrame:
    """Missing name, description, genres and tags replaced by their defaults."""
    none = F.array().cast("array<string>")
    return records.withColumns(
        {
            "name": F.coalesce("name", F.lit(UNKNOWN_TITLE)),
            "short_description": F.coalesce("short_description", F.lit("")),
            "genres": F.coalesce("genres", none),
        }
    )


def document_text() -> Column:
    """Searchable text of a record (after :func:`record_defaults`): empty parts are left out."""
    labelled = lambda label, text: F.when(text != "", F.concat(F.lit(label), text))
    return F.concat_ws(
        ". ",
        "name",
        text_or_null(F.col("short_description")),
        labelled("Genres: ", joined("genres")),
        labelled("Tags: ", joined("tags")),
    )


def result_cards(matches: DataFrame, records: DataFrame, url_base: str) -> DataFrame:
    """Result records of the matches: fields with defaults, rounded score, page link, platforms."""
    known = record_defaults(records)
    on = lambda c: F.coalesce(F.col(c), F.lit(False)).alias(c)
    return matches.join(known, matches["id"] == known["app_id"]).select(
        "qid", "rank", "app_id", "name", F.round("score", 4).alias("score"), "short_description", "genres",
        "tags", "price", "release_date", "header_image",
        F.concat(F.lit(url_base), F.col("app_id")).alias("store_page"),
        F.struct(on("windows"), on("mac"), on("linux")).alias("platforms"),
    )


def _in_order(text: Column, order: str, separator: str) -> Column:
    """Texts of one query, in rank order, joined. A query has at most k matches."""
    rows = F.sort_array(F.collect_list(F.struct(F.col(order).alias("o"), text.alias("t"))))
    return F.array_join(F.transform(rows, lambda r: r["t"]), separator)


def candidate_lines(candidates: DataFrame, records: DataFrame, excerpt: int = 150) -> DataFrame:
    """One text block per query listing its candidates, for a ranker to read."""
    known = record_defaults(records)
    short = F.regexp_replace(F.substring("short_description", 1, excerpt), "\n", " ")
    line = _filled(LINE, F.col("app_id"), F.col("name"), short, joined("tags"))
    rows = candidates.join(known, candidates["id"] == known["app_id"])
    return rows.groupBy("qid").agg(_in_order(line, "rank", "\n").alias("block"))


def answer_context(matches: DataFrame, records: DataFrame, best_reviews: DataFrame, excerpt: int = 300,
                   quote: int = 200) -> DataFrame:
    """One context text per query: its matches with their quoted best reviews.

    Descriptions and quotes are excerpts of the given lengths; filters and ranks before them
    work on whole texts.
    """
    known = record_defaults(records)
    quoted = F.concat(F.lit('"'), F.substring("review", 1, quote), F.lit('"'))
    wanted = best_reviews.join(matches.select(F.col("id").alias("appid")).distinct(), "appid", "left_semi")
    quotes = wanted.groupBy(F.col("appid").alias("app_id")).agg(_in_order(quoted, "rank", " | ").alias("quotes"))
    block = _filled(
        BLOCK, F.col("name"), F.substring("short_description", 1, excerpt), joined("genres"), joined("tags"),
        F.coalesce("quotes", F.lit(NO_REVIEWS)),
    )
    rows = matches.join(known, matches["id"] == known["app_id"]).join(quotes, "app_id", "left")
    return rows.groupBy("qid").agg(_in_order(block, "rank", "\n\n").alias("context"))


def plain_answer(queries: DataFrame, matches: DataFrame, records: DataFrame) -> DataFrame:
    """A sentence naming the first three matches of each query, or saying there are none."""
    names = record_defaults(records).select(F.col("app_id").alias("id"), "name")
    first = (
        matches.where(F.col("rank") <= 3).join(names, "id").groupBy("qid").agg(
            _in_order(F.col("name"), "rank", ", ").alias("names")
        )
    )
    found = _filled(SENTENCE, F.col("query"), F.col("names"))
    return queries.join(first, "qid", "left").select("qid", F.coalesce(found, F.lit(NO_MATCHES)).alias("answer"))
