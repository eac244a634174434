"""Vector search against brute force, and the rules of reranking and text assembly."""

import tracemalloc

import numpy as np
import pytest
from pyspark.sql import functions as F

from tallyloom.operators import retrieval as rt
from tallyloom.operators import text_space as ts
from tallyloom.operators import vector_index as vi


def brute(queries, items, k, exclude_self):
    q = queries / np.linalg.norm(queries, axis=1, keepdims=True)
    i = items / np.linalg.norm(items, axis=1, keepdims=True)
    out = {}
    for a, row in enumerate(np.round(q @ i.T, 9)):
        ranked = sorted((-s, str(b)) for b, s in enumerate(row) if not (exclude_self and a == b))
        out[a] = [(b, max(0.0, -s)) for s, b in ranked[:k]]
    return out


def tables(spark, vectors):
    rows = [(int(i), str(i), [float(x) for x in v]) for i, v in enumerate(vectors)]
    df = spark.createDataFrame(rows, "qid bigint, id string, vec array<double>")
    return df.select("qid", "vec"), df.select("id", "vec")


def collected(df):
    out = {}
    for r in df.orderBy("qid", "rank").collect():
        out.setdefault(r.qid, []).append((r.id, r.similarity))
    return out


@pytest.fixture(scope="module")
def vectors():
    rng = np.random.default_rng(11)
    base = rng.normal(size=(150, 8))
    base[50:100] = base[0]  # a third of all items are equal
    return base


@pytest.mark.parametrize("block, query_block, together", [(65_536, 8192, 1 << 23), (65_536, 8192, 300), (13, 7, 1 << 23)])
@pytest.mark.parametrize("exclude_self", [True, False])
def test_search_paths_equal_brute_force(spark, monkeypatch, vectors, block, query_block, together, exclude_self):
    monkeypatch.setattr(rt, "TOGETHER", together)
    queries, items = tables(spark, vectors)
    got = collected(rt.cosine_topk(queries, items, 5, exclude_self, block, query_block))
    want = brute(vectors, vectors, 5, exclude_self)
    assert set(got) == set(want)
    for q in want:
        assert [i for i, _ in got[q]] == [i for i, _ in want[q]]
        assert [s for _, s in got[q]] == pytest.approx([s for _, s in want[q]])


def test_vectors_travel_once_per_block_of_the_other_side(spark, monkeypatch, vectors):
    """Two sides of several blocks are cut no further than the work needs; one small block of queries meets many blocks of items."""
    sent = {}
    products = rt._products
    monkeypatch.setattr(rt, "_products", lambda asked, held, *more: sent.update(asked=asked, held=held) or products(asked, held, *more))
    queries, items = tables(spark, vectors)
    found = rt.cosine_topk(queries, items, 5, False, 64, 32)
    assert sent["held"].count() == sent["asked"].count() == 8 * 150 and found.count() == 5 * 150
    rt.cosine_topk(queries.where("qid = 1"), items, 5, False, 64, 32)
    assert sent["held"].count() == 150 and sent["asked"].count() == 19
    rt.cosine_topk(queries, items, 5, False, 10, 10)
    assert sent["held"].count() == sent["asked"].count() == 15 * 150


def test_fewer_items_than_k(spark):
    queries, items = tables(spark, np.eye(3))
    got = collected(rt.cosine_topk(queries, items, 20))
    assert all(len(v) == 3 for v in got.values()) and got[0][0] == ("0", 1.0)


@pytest.fixture(scope="module")
def clustered():
    rng = np.random.default_rng(4)
    centres = rng.normal(size=(20, 16))
    return np.repeat(centres, 60, axis=0) + 0.15 * rng.normal(size=(1200, 16))


def hits(exact, near):
    return sum(len({i for i, _ in exact[q]} & {i for i, _ in near.get(q, [])}) for q in exact) / sum(map(len, exact.values()))


@pytest.mark.parametrize("block, query_block", [(65_536, 1024), (70, 100)])
def test_index_finds_most_neighbours_and_reads_few_items(spark, clustered, block, query_block):
    queries, items = tables(spark, clustered)
    index = vi.build_index(items, 10, cells=32)
    near = collected(vi.indexed_topk(queries, index, 10, True, block, query_block))
    exact = collected(rt.cosine_topk(queries, items, 10, True))
    assert hits(exact, near) > 0.9 and all(len(rows) == 10 for rows in near.values())
    codes, vectors = vi.visited_share(index, clustered, 10)
    assert codes < 0.25 and vectors < 0.25 and index.items.count() == len(clustered) == index.sizes.sum()
    for q, rows in near.items():
        assert len({i for i, _ in rows}) == len(rows) and str(q) not in dict(rows)


def test_index_moves_floats_as_floats_and_queries_as_bytes(spark, clustered):
    queries, items = tables(spark, clustered.astype(np.float32))
    short = [df.withColumn("vec", F.col("vec").cast("array<float>")) for df in (queries, items)]
    index = vi.build_index(short[1], 10, cells=20)
    assert index.items.schema["vec"].dataType.elementType.typeName() == "float"
    found = vi.indexed_topk(short[0], index, 10, True, 300, 300)
    plan = found._jdf.queryExecution().optimizedPlan().toString()
    assert "_unit#" in plan and "_vec#" not in plan and "array<double>" not in plan
    assert collected(found) == collected(vi.indexed_topk(queries, vi.build_index(items, 10, cells=20), 10, True, 300, 300))


def test_index_without_clusters_reads_few_whole_vectors(spark):
    data = np.random.default_rng(9).normal(size=(1500, 32))
    queries, items = tables(spark, data)
    index = vi.build_index(items, 20)
    near = collected(vi.indexed_topk(queries.where("qid % 10 = 0"), index, 20, True))
    exact = collected(rt.cosine_topk(queries.where("qid % 10 = 0"), items, 20, True))
    assert hits(exact, near) > 0.9 and vi.visited_share(index, data, 20)[1] < 0.25


def test_index_of_few_equal_and_no_items(spark):
    queries, items = tables(spark, np.array([[1.0, 0, 0], [0, 0, 0], [1.0, 0, 0], [0, 1, 0]]))
    near = collected(vi.approximate_topk(queries, items, 3))
    assert near[0][:2] == [("0", 1.0), ("2", 1.0)] and all(len(rows) == 3 for rows in near.values())
    assert vi.approximate_topk(queries, items.limit(0), 3).count() == 0


def test_blocks_hold_cells_of_any_size():
    sizes = np.array([3, 0, 30, 5, 4, 9])
    first, parts = vi._blocks(sizes, 10)
    assert parts.tolist() == [1, 1, 3, 1, 1, 1]
    held = np.zeros(first.max() + 1)
    for f, p, n in zip(first, parts, sizes):
        held[f : f + p] += n / p
    assert held.max() <= 10 and held.sum() == sizes.sum()


@pytest.fixture(scope="module")
def ranked(spark):
    candidates = spark.createDataFrame(
        [(q, f"c{i}", 1.0 - i / 10, i + 1) for q in range(5) for i in range(6)],
        "qid bigint, id string, similarity double, rank int",
    )
    records = spark.createDataFrame([(f"c{i}",) for i in range(6)] + [("77",)], "id string")
    responses = spark.createDataFrame(
        [
            (0, 'Sure!\n["c3", "c1",\n "c3", "nope"] and also ["c5"]'),  # repeated and unknown ids, two arrays
            (1, "no list here"),
            (2, '["c2", broken'),
            (3, "[77, \"c0\"]"),                                         # number id outside the candidates
            (4, "[]"),
            (9, '["c1"]'),                                               # query without candidates
        ],
        "qid bigint, text string",
    )
    out = {}
    for r in rt.rerank(candidates, records, responses, 5).orderBy("qid", "rank").collect():
        out.setdefault(r.qid, []).append((r.id, round(r.score, 3), r.origin))
    return out


def test_ranker_order_then_padding(ranked):
    assert ranked[0] == [
        ("c3", 0.7, "reranked"), ("c1", 0.9, "reranked"),
        ("c0", 1.0, "padded"), ("c2", 0.8, "padded"), ("c4", 0.6, "padded"),
    ]


def test_unparsable_responses_fall_back(ranked):
    for q in (1, 2):
        assert [i for i, _, _ in ranked[q]] == ["c0", "c1", "c2", "c3", "c4"]
        assert {o for _, _, o in ranked[q]} == {"fallback"}


def test_known_id_outside_the_candidates_scores_zero(ranked):
    assert ranked[3][:2] == [("77", 0.0, "reranked"), ("c0", 1.0, "reranked")] and len(ranked[3]) == 5


def test_empty_list_and_query_without_candidates(ranked):
    assert [o for _, _, o in ranked[4]] == ["padded"] * 5
    assert 9 not in ranked


REC = (
    "app_id string, name string, short_description string, genres array<string>, tags array<string>, price double,"
    " release_date string, header_image string, windows boolean, mac boolean, linux boolean"
)


@pytest.fixture(scope="module")
def records(spark):
    return spark.createDataFrame(
        [
            ("1", "Alpha", "First\nline", ["A", "B"], ["x", "y"], 9.5, None, None, True, None, False),
            ("2", None, None, None, None, None, None, None, None, None, None),
        ],
        REC,
    )


def test_document_skips_empty_parts(records):
    out = {r.app_id: r.d for r in rt.record_defaults(records).select("app_id", rt.document_text().alias("d")).collect()}
    assert out["1"] == "Alpha. First\nline. Genres: A, B. Tags: x, y"
    assert out["2"] == "Unknown title"


def test_cards_context_and_answers(spark, records):
    matches = spark.createDataFrame([(7, "2", 0.123456, 2), (7, "1", 0.9, 1)], "qid bigint, id string, score double, rank int")
    cards = {r.app_id: r for r in rt.result_cards(matches, records, "u/").collect()}
    assert cards["2"].score == 0.1235 and cards["2"].genres == [] and cards["2"].store_page == "u/2"
    assert cards["1"].platforms.asDict() == {"windows": True, "mac": False, "linux": False}
    reviews = spark.createDataFrame(
        [("1", 1, " good \n", "en", 5), ("1", 2, "best", "en", 9), ("1", 3, "gut", "de", 99), ("1", 4, "  ", "en", 50),
         ("1", 5, None, "en", 60), ("1", 6, "bad", "en", 5), ("1", 7, "meh", "en", 1)],
        "appid string, review_id int, review string, language string, votes_up int",
    )
    best = rt.top_reviews(reviews, "en", 3)
    assert [r.review for r in best.orderBy("rank").collect()] == ["best", "good", "bad"]
    context = rt.answer_context(matches, records, best).first().context
    assert context == (
        'Game: Alpha\nDescription: First\nline\nGenres: A, B | Tags: x, y\nPlayer reviews: "best" | "good" | "bad"'
        "\n\nGame: Unknown title\nDescription: \nGenres:  | Tags: \nPlayer reviews: No reviews available."
    )
    line = rt.candidate_lines(matches, records).first().block
    assert line == "app_id=1 | Alpha | First line | tags: x, y\napp_id=2 | Unknown title |  | tags: "
    asked = spark.createDataFrame([(7, "fun"), (8, "none")], "qid bigint, query string")
    answers = {r.qid: r.answer for r in rt.plain_answer(asked, matches, records).collect()}
    assert answers[7] == 'Based on your search for "fun", the closest matches are: Alpha, Unknown title.'
    assert answers[8] == "No games were found matching your query."


def test_tags_from_map_list_or_nothing(spark):
    from pyspark.sql import functions as F

    from tallyloom.functions.scalars import tags_of_list, tags_of_map

    df = spark.createDataFrame(
        [({f"t{i}": i for i in range(9)}, [str(i) for i in range(9)]), (None, None)],
        "m map<string,int>, l array<string>",
    )
    rows = df.select(F.size(tags_of_map(F.col("m"))).alias("m"), tags_of_list(F.col("l")).alias("l")).collect()
    assert [r.m for r in rows] == [8, 0] and rows[0].l == [str(i) for i in range(8)] and rows[1].l == []


def test_text_vectors_have_unit_length(spark):
    df = spark.createDataFrame([(1, "a b c"), (2, "a a d"), (3, "e")], "id int, text string")
    for r in rt.text_vectors(df, "text", 64).collect():
        assert np.linalg.norm(r.vec) == pytest.approx(1.0)


def test_search_batch(spark, records):
    from tallyloom.plans.search import search

    vectors = spark.createDataFrame([("1", [1.0, 0.0]), ("2", [0.6, 0.8])], "id string, vec array<double>")
    queries = spark.createDataFrame([(1, "up", [0.0, 1.0]), (2, "right", [1.0, 0.1])], "qid bigint, query string, vec array<double>")
    reviews = spark.createDataFrame(
        [("1", 1, "fine", "english", 1)], "appid string, review_id int, review string, language string, votes_up int"
    )
    plain = search(queries, vectors, records, reviews)
    first = {r.qid: r.id for r in plain.matches.where("rank = 1").collect()}
    assert first == {1: "2", 2: "1"} and plain.cards.count() == 4
    assert '"fine"' in plain.context.where("qid = 2").first().context
    assert plain.answers.where("qid = 2").first().answer.endswith("Alpha, Unknown title.")
    responses = spark.createDataFrame([(1, '["1"]'), (2, "none")], "qid bigint, text string")
    ranked = search(queries, vectors, records, reviews, responses)
    assert {r.qid: r.id for r in ranked.matches.where("rank = 1").collect()} == {1: "1", 2: "1"}


def test_text_space_equals_the_exact_decomposition(spark):
    rng = np.random.default_rng(3)
    data = rng.normal(size=(300, 6)) @ rng.normal(size=(6, 40)) + 0.05 * rng.normal(size=(300, 40))
    df = spark.createDataFrame([(i, [float(x) for x in row]) for i, row in enumerate(data)], "id int, vec array<double>").repartition(7)
    space = ts.fit_space(df, "vec", 40, size=6)
    values, right = np.linalg.svd(data, full_matrices=False)[1:]
    assert space.shares == pytest.approx(values[:6] ** 2 / (values**2).sum(), rel=1e-6)
    assert np.abs((space.directions * right[:6].T).sum(axis=0)) == pytest.approx(np.ones(6), abs=1e-5)
    got = {r.id: np.array(r.vec) for r in ts.folded(df, "vec", space).collect()}
    want = data @ space.directions
    assert all(np.allclose(got[i], want[i] / np.linalg.norm(want[i])) for i in range(300))


def test_dense_text_vectors(spark):
    texts = ["red fox runs", "a red fox ran", "stock prices fell", "prices of stock fell today", "", None, "  "]
    df = spark.createDataFrame(list(enumerate(texts)), "doc_id int, text string")
    made, space = ts.dense_text_vectors(df, "text", size=4)
    vec = {r.doc_id: np.array(r.vec) for r in made.collect()}
    assert len(vec) == 7 and all(len(v) == 4 for v in vec.values()) and space.shares.sum() > 0.6
    assert [round(float(np.linalg.norm(vec[i])), 6) for i in range(7)] == [1, 1, 1, 1, 0, 0, 0]
    assert vec[0] @ vec[1] > vec[0] @ vec[2] and vec[2] @ vec[3] > vec[1] @ vec[3]
    assert ts.dense_text_vectors(df.limit(0), "text")[0].count() == 0


def test_products_of_a_full_block_hold_little_memory():
    rng = np.random.default_rng(2)
    items, step = rng.normal(size=(65_536, 8)), rt.TOGETHER // 65_536
    tracemalloc.start()
    found = rt._block_best(np.arange(step), items[:step], np.arange(65_536).astype(str), items, 5, True)
    peak = tracemalloc.get_traced_memory()[1]
    tracemalloc.stop()
    assert len(found) == 5 * step and peak < 100 << 20


def test_shortlist_holds_all_of_the_best_and_few_others():
    rng = np.random.default_rng(6)
    scores = rng.normal(size=(7, 5000))
    scores[2, 10:400] = 9.0  # more ties than places
    scores[3, 5:] = -np.inf
    scores[4] = -np.inf
    row, column = rt.shortlist(scores, 5)
    for r in range(7):
        own = set(column[row == r].tolist())
        cut = np.sort(scores[r])[-5]
        assert own >= set(np.nonzero((scores[r] >= cut) & (scores[r] > -np.inf))[0].tolist())
        assert len(own) < 1000
    order, place = rt.places(row, scores[row, column])
    assert [int((row[order] == r).sum()) for r in range(7)] == [int((row == r).sum()) for r in range(7)]
    assert (place[1:] == np.where(np.diff(row[order]) == 0, place[:-1] + 1, 0)).all()


def test_every_item_with_the_id_of_the_query_is_left_out():
    ids, items = np.array(["7", "3", "7", "12"]), np.eye(4)
    found = rt._block_best(np.array([7, 5, 12]), np.ones((3, 4)), ids, items, 4, True)
    assert [found[found["qid"] == q]["id"].tolist() for q in (7, 5, 12)] == [["12", "3"], ["12", "3", "7", "7"], ["3", "7", "7"]]
    assert [x.tolist() for x in rt._own_places(np.array([7, 5, 12]), ids)] == [[0, 0, 2], [0, 2, 3]]


@pytest.mark.parametrize("dimensions", [8, 9])
def test_estimates_are_products_with_the_decoded_vectors(dimensions):
    rng = np.random.default_rng(8)
    rows, queries = rng.normal(size=(400, dimensions)), rng.normal(size=(5, dimensions))
    quantiser = vi.Quantiser.fit(rows, 4)
    cells, codes = quantiser.encode(rows)
    decoded = quantiser.decode(cells, codes)
    assert decoded.shape == rows.shape and np.linalg.norm(rows - decoded) < 0.5 * np.linalg.norm(rows)
    tables = np.einsum("qsd,swd->sqw", vi.Quantiser._slices(queries), quantiser.words)
    looked_up = (queries @ quantiser.centres.T)[:, cells] + sum(t[:, c] for t, c in zip(tables, codes.T))
    assert quantiser.scores(queries, cells, codes) == pytest.approx(looked_up, abs=1e-4)


def test_full_matrices_hold_few_rows_of_a_batch():
    import pyarrow as pa

    n, features = 10_000, 1024
    indices = pa.array([[i % features, (i * 7 + 1) % features] for i in range(n)], pa.list_(pa.int32()))
    values = pa.array([[1.0, 2.0]] * n, pa.list_(pa.float64()))
    column = pa.StructArray.from_arrays([indices, values], ["indices", "values"])
    tracemalloc.start()
    made = [(len(own), own.sum(), own[0].nonzero()[0].tolist()) for own in ts._matrices(column, features)]
    peak = tracemalloc.get_traced_memory()[1]
    tracemalloc.stop()
    assert sum(m[0] for m in made) == n and sum(m[1] for m in made) == 3.0 * n and peak < 16 << 20
    assert made[1][2] == sorted([ts.TOGETHER % features, (ts.TOGETHER * 7 + 1) % features])
