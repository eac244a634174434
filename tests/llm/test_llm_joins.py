"""Operators that compare rows, against brute force on small tables with large groups and messy rows."""

import os
import random
import re

import numpy as np
import pyarrow as pa
import pytest

import corpus_pipeline
from tallyloom.llm import buckets, ngram_join, passages, topk
from tallyloom.llm.components import components
from tallyloom.llm.textbatch import Texts

WORD = re.compile(r"[^\x20\x09-\x0D]+")
FOLD = {c: c + 32 for c in range(65, 91)}
SCHEMA = "doc_id long, text string, n_shingles string, component_id string, id string"


def words_of(text):
    return WORD.findall((text or "").translate(FOLD))


def set_of(text):
    w = words_of(text)
    return {tuple(w[i : i + 5]) for i in range(len(w) - 4)} if len(w) >= 5 else ({tuple(w)} if w else set())


def brute_groups(rows):
    """doc_id -> (set size, smallest reachable id); rows that share an id are one node."""
    known = [(i, set_of(t)) for i, t in rows if i is not None]
    parent = {i: i for i, _ in known}

    def root(x):
        while parent[x] != x:
            x = parent[x]
        return x

    for x, (i, a) in enumerate(known):
        for j, b in known[:x]:
            if a and b and 100 * len(a & b) >= 80 * len(a | b):
                p, q = root(i), root(j)
                parent[max(p, q)] = min(p, q)
    return sorted((i, len(s), root(i)) for i, s in known)


def near_texts(seed, groups, copies, sizes=(1, 120)):
    """Groups of copies with a few changes each, among them texts that stand at the limit of similarity."""
    rng = random.Random(seed)
    out = []
    for _ in range(groups):
        base = [f"w{rng.randint(0, 400)}" for _ in range(rng.randint(*sizes))]
        out.append(" ".join(base))
        for _ in range(rng.randint(0, copies)):
            own = list(base)
            for _ in range(rng.randint(0, 1 + len(own) // 20)):
                k = rng.randrange(len(own) + 1)
                own[k : k + rng.randint(0, 2)] = [f"x{rng.randint(0, 9)}"] * rng.randint(0, 2)
            out.append(" ".join(own))
    rng.shuffle(out)
    return out


def linked(spark, rows):
    df = spark.createDataFrame([(i, t, "a", "b", "c") for i, t in rows], SCHEMA).repartition(5)
    return ngram_join.link_groups(df)


def test_links_match_brute_force(spark):
    texts = near_texts(1, 60, 6) + near_texts(2, 3, 40, (30, 60)) + [None, "", " \n", "one", "ONE", "one two", "a b c d e", "A b\nc d e"]
    rows = list(enumerate(texts)) + [(5, texts[5]), (None, texts[0]), (10**12, "w " * 50_000)]
    made = linked(spark, rows)
    assert made.columns == ["doc_id", "n_shingles", "component_id"]
    got = made.collect()
    assert len(got) == len(rows) and [r.component_id for r in got if r.doc_id is None] == [None]
    assert sorted((r.doc_id, r.n_shingles, r.component_id) for r in got if r.doc_id is not None) == brute_groups(rows)


@pytest.mark.parametrize("block", [1024, 9])
def test_large_group_at_the_limit_of_similarity(spark, monkeypatch, block):
    """Copies that differ about as much as links allow: few are linked with any one of them."""
    monkeypatch.setattr(ngram_join, "BLOCK", block)
    rng = random.Random(21)
    base = [f"b{i}" for i in range(150)]
    texts = []
    for _ in range(160):
        own = list(base)
        for _ in range(rng.randint(1, 5)):
            own[rng.randrange(150)] = f"e{rng.randint(0, 10**6)}"
        texts.append(" ".join(own))
    rows = list(enumerate(texts))
    want = brute_groups(rows)
    assert 2 < len({c for _, _, c in want}) < 100
    assert sorted((r.doc_id, r.n_shingles, r.component_id) for r in linked(spark, rows).collect()) == want


@pytest.mark.parametrize("seed", range(2))
def test_large_group_in_one_partition_and_a_few_copies_in_another(spark, seed):
    """Groups at the limit of similarity whose copies are mostly in one map task: each few must meet all others."""
    rng = random.Random(seed)
    many, few = [], []
    for g in range(5):
        base = [f"g{g}b{i}" for i in range(150)]
        for n in range(43):
            own = list(base)
            for _ in range(rng.randint(1, 5)):
                own[rng.randrange(150)] = f"e{rng.randint(0, 10**6)}"
            (few if n >= 40 else many).append(" ".join(own))
    rows = list(enumerate(many + few))
    df = spark.createDataFrame(rows[: len(many)], "doc_id long, text string").coalesce(1)
    df = df.union(spark.createDataFrame(rows[len(many) :], "doc_id long, text string").coalesce(1))
    assert sorted((r.doc_id, r.n_shingles, r.component_id) for r in ngram_join.link_groups(df).collect()) == brute_groups(rows)


def test_members_of_a_key_that_one_task_cut_all_come_out():
    hot, other = buckets.Packer(1), buckets.Packer(1)
    list(hot.add(np.full(40, 7, np.uint64), np.arange(40, dtype=np.uint64)))
    list(other.add(np.array([7, 7, 7, 5, 5], np.uint64), np.arange(90, 95, dtype=np.uint64)))
    rows = pa.Table.from_batches([*hot.flush(), *other.flush()])

    class Packed:
        def groupBy(self, _):
            return self

        def applyInArrow(self, one, _):
            return one(rows).to_pylist()

    made = buckets.match(Packed())
    assert {r["b"] for r in made if r["kind"] == 1 and r["a"] == 7} == {*range(40), 90, 91, 92}
    assert {(r["a"], r["b"]) for r in made if r["kind"] == 0} >= {(93, 94), (0, 90), (0, 39)}


def test_components_of_equal_size_are_joined_wherever_their_link_stands():
    rng = np.random.default_rng(9)
    fresh = lambda: rng.integers(0, 2**63, 60, dtype=np.uint64)
    for labels in ([1, 2, 1, 2, 1, 2], [1, 1, 1, 2, 2, 2], [2, 1, 3, 1, 2, 3], [5, 1, 2, 1, 2]):
        for i in range(len(labels)):
            for j in range(i):
                words = [fresh() for _ in labels]
                words[i] = np.concatenate((words[j][:-1], words[i][:1]))
                links = ngram_join._joined_members([w.tobytes() for w in words], np.array(labels), None, 5, 80)
                assert [{*x} for x in links] == ([{i, j}] if labels[i] != labels[j] else []), (labels, i, j)


def test_links_do_not_depend_on_the_known_shingles(spark, monkeypatch):
    rng = random.Random(4)
    shared = " ".join(f"s{i}" for i in range(60))
    texts = [f"{shared} " + " ".join(f"v{rng.randint(0, 10**6)}" for _ in range(rng.randint(0, 40))) for _ in range(150)]
    texts += [shared + f" end{i % 7} tail" for i in range(60)] + near_texts(6, 20, 3)
    rows = list(enumerate(texts))
    want = brute_groups(rows)
    for sample, frequent in ((1, 3), (1, 10**9)):
        monkeypatch.setattr(ngram_join, "SAMPLE", sample)
        monkeypatch.setattr(ngram_join, "FREQUENT", frequent)
        assert sorted((r.doc_id, r.n_shingles, r.component_id) for r in linked(spark, rows).collect()) == want


def test_no_rows_no_links(spark):
    assert linked(spark, []).count() == 0
    assert sorted(tuple(r) for r in linked(spark, [(1, None), (2, "")]).collect()) == [(1, 0, 1), (2, 0, 2)]


def test_every_linked_pair_shares_a_signature():
    rng = np.random.default_rng(5)
    for size in [1, 2, 3, 4, 5, 6, 7, 9, 10, 14, 15, 16, 23, 24, 60, 61, 150, 1000]:
        for _ in range(6):
            base = rng.integers(1, 2**63, size, dtype=np.uint64)
            gone = rng.integers(0, size // 5 + 1)
            extra = max(0, (len(base) - gone) * 100 // 80 - size)
            other = np.concatenate((base[gone:], rng.integers(1, 2**63, rng.integers(0, extra + 1), dtype=np.uint64)))
            if not len(other) or 100 * (size - gone) < 80 * (size + len(other) - size + gone):
                continue
            for frequent in (np.zeros(0, np.uint64), np.sort(base[: size // 2]), np.sort(base)):
                sets = np.concatenate((np.unique(base), np.unique(other)))
                keys, holders = ngram_join.signatures(sets, np.array([len(base), len(other)]), frequent)
                assert set(keys[holders == 0].tolist()) & set(keys[holders == 1].tolist()), (size, gone)


def test_unrelated_short_sets_share_no_signature():
    rng = np.random.default_rng(7)
    for size in (1, 2, 3, 6, 10, 14, 20, 24):
        sets = np.sort(rng.integers(1, 2**63, (20_000, size), dtype=np.uint64), axis=1).ravel()
        keys, _ = ngram_join.signatures(sets, np.full(20_000, size), np.zeros(0, np.uint64))
        assert len(np.unique(keys)) == len(keys)


def test_large_keys_leave_a_task_as_one_entry():
    packer = buckets.Packer(4)
    keys = np.array([7] * 100 + [9, 9, 5], np.uint64)
    members = np.arange(103, dtype=np.uint64)
    list(packer.add(keys, members))
    rows = [r for b in packer.flush() for r in b.to_pylist()]
    sent = {kind: sum(len(r["x"]) // 8 for r in rows if r["kind"] == kind) for kind in (0, 1, 2)}
    assert sent == {0: 4, 1: 100, 2: 99}


def test_components_of_stars_chains_and_rings(spark):
    edges = [(0, i) for i in range(1, 40)] + [(100 + i, 101 + i) for i in range(30)] + [(200 + i, 200 + (i + 1) % 9) for i in range(9)] + [(5, 5), (130, 131), (131, 130)]
    edges += [(400 - i, 399 - i) for i in range(60)] + [(500 + i * 37 % 101, 500 + (i + 1) * 37 % 101) for i in range(100)]
    groups = {}
    for r in components(spark.createDataFrame(edges, "a long, b long")).collect():
        groups.setdefault(r.component, set()).add(r.node)
    want = [range(40), range(100, 132), range(200, 209), range(340, 401), range(500, 601)]
    assert sorted(map(sorted, groups.values())) == [list(x) for x in want] and all(k in v for k, v in groups.items())
    assert components(spark.createDataFrame([], "a long, b long")).count() == 0


def test_compact_windows_are_all_of_them():
    rng = np.random.default_rng(3)
    for least in (1, 2, 5, 8):
        sizes = rng.integers(0, 25, 12)
        values = rng.integers(0, 2**63, sizes.sum(), dtype=np.uint64)
        got = set(zip(*(x.tolist() for x in passages.compact_windows(values, sizes, least))))
        want, at = set(), 0
        for n in sizes.tolist():
            for c in range(at, at + n):
                lo = hi = c
                while lo > at and values[lo - 1] > values[c]:
                    lo -= 1
                while hi < at + n - 1 and values[hi + 1] > values[c]:
                    hi += 1
                if hi - lo + 1 >= least:
                    want.add((c, lo, hi))
            at += n
        assert got == want


def test_joined_seeds_give_the_same_regions():
    rng = np.random.default_rng(21)
    for turn in range(200):
        n = int(rng.integers(1, 60))
        out = np.zeros(n, passages.SEED)
        out["b"], out["a"], out["hash"] = rng.integers(0, 2, n) + 5, rng.integers(0, 2, n), rng.integers(0, 2, n)
        cb = rng.integers(200_000, 200_000 + (400 if turn % 2 else 120_000), n).astype(np.uint64)
        ca = cb - rng.choice([3, 5, 90], n).astype(np.uint64)
        most = 60 if turn % 2 else 65_536
        for name, c in (("pos_b", cb), ("pos_a", ca)):
            out[name] = c << np.uint64(32) | rng.integers(0, most, n).astype(np.uint64) << np.uint64(16) | rng.integers(0, most, n).astype(np.uint64)
        made = passages._merged(passages._distinct(out))
        assert len(made) <= n and {x.item()[:2] for x in made} == {x.item()[:2] for x in out}
        for b in (5, 6):
            for a in (0, 1):
                both = [rows[(rows["b"] == b) & (rows["a"] == a)] for rows in (out, made)]
                if len(both[0]):
                    got = [sorted(passages._regions(x["pos_b"].view(np.int64), x["pos_a"].view(np.int64), x["hash"])) for x in both]
                    assert got[0] == got[1]


def corpus_with_passages(seed, n=60):
    rng = random.Random(seed)
    fresh = lambda k: [f"u{rng.randint(0, 10**9)}" for _ in range(k)]
    shared = [fresh(rng.randint(51, 90)) for _ in range(4)] + [fresh(40)]
    out = []
    for i in range(n):
        body = fresh(rng.randint(0, 150))
        if rng.random() < 0.6:
            body += shared[rng.randrange(5)] + fresh(rng.randint(0, 80))
        out.append(" ".join(body))
    return out + [out[0], out[1] + " x", None, "", "short one"]


def run_cover(rows, width=51):
    """Words of every document that lie in a run of ``width`` words which a document with a smaller id has too."""
    first, cover = {}, {}
    for i, text in sorted((i, t) for i, t in rows if i is not None):
        w, own = words_of(text), {}
        for k in range(len(w) - width + 1):
            run = tuple(w[k : k + width])
            if first.get(run, i) != i:
                cover.setdefault(i, set()).update(range(k, k + width))
            own.setdefault(run, i)
        for run, j in own.items():
            first.setdefault(run, j)
    return cover


@pytest.mark.parametrize("seed", [1, 2])
def test_repeated_passages_are_found_and_real(spark, seed, monkeypatch):
    monkeypatch.setattr(passages, "WINDOW", 500)
    rows = list(enumerate(corpus_with_passages(seed))) + [(None, "w " * 60)]
    df = spark.createDataFrame([(i, t, "a", "b", "c") for i, t in rows], SCHEMA).repartition(4)
    made = passages.repeats(df).collect()
    texts = {i: words_of(t) for i, t in rows}
    covered = {}
    for r in made:
        copy, source = texts[r.doc_id][r.start_word : r.end_word], texts[r.source_id][r.source_start : r.source_end]
        assert r.source_id < r.doc_id and len(copy) >= 50 and len(source) >= 50
        a, b = set_of(" ".join(copy)), set_of(" ".join(source))
        assert 100 * len(a & b) >= 80 * len(a | b)
        covered.setdefault(r.doc_id, set()).update(range(r.start_word, r.end_word))
    for i, places in run_cover(rows).items():
        assert places <= covered.get(i, set()), i


@pytest.mark.parametrize("window", [300_000, 2000])
def test_passages_that_continue_a_frequent_line(spark, monkeypatch, window):
    """A line under 50 words stands in many documents; words beside it are shared by two or three documents each."""
    monkeypatch.setattr(passages, "WINDOW", window)
    rng = random.Random(8)
    fresh = lambda k: [f"u{rng.randint(0, 10**9)}" for _ in range(k)]
    line = fresh(45)
    bodies = [fresh(60) + line + fresh(60) for _ in range(40)]
    for n in range(40):
        before, behind = fresh(n % 9), fresh(8 - n % 9)
        for _ in range(2 + n % 2):
            bodies.append(fresh(20) + before + line + behind + fresh(30) + (before + line + behind + fresh(9) if n % 5 == 0 else []))
    late = bodies[40:]
    rng.shuffle(late)
    rows = list(enumerate(" ".join(b) for b in bodies[:40] + late))
    df = spark.createDataFrame(rows, "doc_id long, text string").repartition(5)
    covered = {}
    for r in passages.repeats(df).collect():
        covered.setdefault(r.doc_id, set()).update(range(r.start_word, r.end_word))
    want = run_cover(rows, 50)
    assert len(want) > 50
    for i, places in want.items():
        assert places <= covered.get(i, set()), i


def test_near_copies_of_passages_are_found(spark):
    rng = random.Random(5)
    passage = [f"p{i}" for i in range(100)]
    rows = [(0, " ".join(passage))]
    for i in range(1, 30):
        own = list(passage)
        own[rng.randint(20, 80)] = "changed"
        rows.append((i, " ".join([f"f{i}x{k}" for k in range(40)] + own + [f"g{i}x{k}" for k in range(40)])))
    df = spark.createDataFrame([(i, t, "a", "b", "c") for i, t in rows], SCHEMA)
    found = {r.doc_id for r in passages.repeats(df).collect() if r.end_word - r.start_word > 90}
    assert found == set(range(1, 30))


def test_seeds_of_a_large_group_are_regions_before_they_are_rows(spark):
    """Near copies make several seeds for each two documents that meet; a row is one stretch of two documents, not a seed."""
    rng = random.Random(6)
    passage = [f"p{i}" for i in range(300)]
    rows = []
    for i in range(80):
        own = list(passage)
        for _ in range(4):
            own[rng.randrange(300)] = f"c{i}x{rng.randrange(10**6)}"
        rows.append((i, " ".join(own)))
    found = [r.asDict() for r in passages.regions(spark.createDataFrame(rows, "doc_id long, text string").repartition(4), "doc_id", "text").collect()]
    assert {r["b"] for r in found} == set(range(1, 80)) and all(r["a"] < r["b"] for r in found)
    pairs = {(r["a"], r["b"]) for r in found}
    assert len({tuple(r.values()) for r in found}) == len(found) <= 2 * len(pairs)


@pytest.mark.parametrize("block", [4096, 7])
def test_near_copies_around_a_frequent_line_are_found(spark, monkeypatch, block):
    """Two documents each share a line that stands in all and some words beside it; one has a word of the line changed, so that
    no 50 words of it are the same."""
    monkeypatch.setattr(passages, "BLOCK", block, raising=False)
    rng = random.Random(18)
    fresh = lambda k: [f"u{rng.randint(0, 10**9)}" for _ in range(k)]
    line = fresh(40)
    rows, want = [], {}
    for n in range(60):
        before, behind = fresh(4 + n % 9), fresh(16 - n % 9)
        changed = line[:20] + fresh(1) + line[21:]
        rows += [(n, " ".join(fresh(60) + before + line + behind + fresh(60))), (100 + n, " ".join(fresh(60) + before + changed + behind + fresh(60)))]
        want[100 + n] = n
    df = spark.createDataFrame(rows, "doc_id long, text string").repartition(5)
    found = {(r.doc_id, r.source_id) for r in passages.repeats(df).collect()}
    assert len(found & set(want.items())) >= 58


def test_cut_passages_leave_the_first_copy(spark):
    body = " ".join(f"p{i}" for i in range(60))
    rows = [(1, f"head {body} tail", 0, "x"), (2, f"Ünique start\n{body}\nend here", 0, None), (3, body, 0, "y"), (4, None, None, "z"), (None, body, 7, "n"), (5, "", 0, "e")]
    df = spark.createDataFrame(rows, "doc_id long, text string, n_chars long, lang string")
    made = passages.without_repeats(df)
    assert made.columns == df.columns
    got = {r.doc_id: (r.text, r.n_chars) for r in made.collect()}
    assert got[2] == ("Ünique start\nend here", 21) and got[3] == ("", 0) and got[4] == (None, None) and got[None] == (body, 7)
    assert got[1][0] == rows[0][1] and got[5] == ("", 0)
    assert passages.without_repeats(df.limit(0)).count() == 0


def repeated_id_rows():
    """Id 2 stands for three different texts, two of which near-copy other rows; one of them is short, one long."""
    body = " ".join(f"p{i}" for i in range(60))
    other = " ".join(f"q{i}" for i in range(60))
    long = " ".join(f"u{i}" for i in range(150))
    return [(1, body), (2, "front " + body), (2, "short text"), (2, long), (2, other), (3, other + " x"), (4, long.replace("u9 ", "v ")), (5, "")]


def test_texts_of_one_id_are_one_node(spark):
    rows = repeated_id_rows()
    made = linked(spark, rows).collect()
    assert sorted((r.doc_id, r.n_shingles, r.component_id) for r in made) == brute_groups(rows)
    assert {r.component_id for r in made} == {1, 5}


def test_rows_of_one_id_lose_passages_of_their_own_text_only(spark):
    rows = repeated_id_rows()
    df = spark.createDataFrame([(i, t, len(t)) for i, t in rows], "doc_id long, text string, n_chars long")
    got = sorted((r.doc_id, r.text) for r in passages.without_repeats(df).collect())
    texts = {i: t for i, t in rows if i != 2}
    assert [t for i, t in got if i == 2] == sorted(["front ", "short text", rows[3][1], rows[4][1]])
    assert [t for i, t in got if i == 1] == [texts[1]] and [t for i, t in got if i == 3] == ["x"]


def test_pipeline_stages_on_repeated_ids(spark, tmp_path):
    rows = repeated_id_rows() + [(1, repeated_id_rows()[0][1]), (6, None), (6, "")]
    df = spark.createDataFrame([(i, t, "en", None, len(t or "")) for i, t in rows], "doc_id long, text string, lang string, source string, n_chars long")
    stages = dict(corpus_pipeline.STAGES)
    single = stages["n-gram Jaccard join"](spark, df, str(tmp_path))
    assert single.columns == df.columns
    assert sorted((r.doc_id, r.text) for r in single.collect() if r.text) == [(1, rows[0][1])] and single.where("doc_id >= 5").count() == 3
    assert stages["substring dedup"](spark, df, str(tmp_path)).count() == len(rows)


def brute_top(rows, k):
    known = [(i, [int(np.floor(1024.0 * float(np.float32(x)))) for x in v]) for i, v in rows if i is not None and v is not None and all(x is not None and np.isfinite(x) for x in v)]
    out = []
    for i, q in known:
        if i % 10 == 0:
            scored = sorted((-sum(a * b for a, b in zip(q, v)), j) for j, v in known if j != i)[:k]
            out += [(i, n + 1, j, -s) for n, (s, j) in enumerate(scored)]
    return sorted(out)


@pytest.mark.parametrize("segment,pilot", [(64, 20), (8192, 1024), (50, 3)])
def test_top_k_matches_brute_force(spark, monkeypatch, segment, pilot):
    monkeypatch.setattr(topk, "SEGMENT", segment)
    monkeypatch.setattr(topk, "PILOT", pilot)
    monkeypatch.setattr(topk, "QUERY_BLOCK", 7)
    rng = np.random.default_rng(6)
    rows = [(i, rng.normal(size=8).round(2).astype(np.float32).tolist()) for i in range(300)]
    rows += [(300 + i, [0.5] * 8) for i in range(90)]  # one common vector: ties
    rows += [(1000, None), (None, [1.0] * 8), (1001, [1.0, None] + [0.0] * 6), (1010, [float("nan")] * 8), (1020, [float("inf")] * 8), (1030, [1.0] * 3)]
    df = spark.createDataFrame([(i, v, 1, 2) for i, v in rows], "vec_id long, embedding array<float>, score int, rank int")
    vectors = topk.quantized(df)
    made = topk.top_k(vectors.where("vec_id % 10 = 0"), vectors, 10)
    assert sorted(tuple(r) for r in made.collect()) == brute_top(rows, 10)
    few = vectors.where("vec_id < 4")
    assert topk.top_k(few.where("vec_id = 0"), few, 10).count() == 3
    assert topk.top_k(few.limit(0), vectors, 10).count() == 0 and topk.top_k(few, vectors.limit(0), 10).count() == 0


@pytest.fixture(scope="module")
def small_corpus(spark, tmp_path_factory):
    """A folder with documents and labels: junk, near copies, shared passages, secrets and messy rows."""
    rng = random.Random(12)
    word = lambda: rng.choice(["alpha", "beta", "gamma", "delta", "river", "stone", "cloud", "of", "the"]) + str(rng.randint(0, 999))
    passage = " ".join(word() for _ in range(70))
    rows = []
    for i in range(240):
        body = [word() for _ in range(rng.randint(30, 200))]
        if i % 3 == 0:
            body = [w.upper() + "!!" for w in body]
        text = " ".join(body)
        if i % 10 == 1:
            text = text[: len(text) // 2].rsplit(" ", 1)[0] + "\n" + passage + "\n" + text[len(text) // 2 :].split(" ", 1)[1]
        if i % 12 == 5:
            text += ' token = "9fQ2xLm84TzRw7Kp" end'
        rows.append([i, text, "en", "s", len(text)])
    for k in (2, 4, 7):
        rows.append([300 + k, rows[k][1] + " tail", "en", "s", len(rows[k][1]) + 5])
    rows += [[400, None, None, None, None], [401, "", "en", "s", 0], [None, rows[8][1], "en", "s", 3], [8, rows[8][1], "en", "s", rows[8][4]]]
    labels = [(i, int(i % 3 != 0), 0) for i in range(240)]
    folder = str(tmp_path_factory.mktemp("corpus"))
    spark.createDataFrame(rows, "doc_id long, text string, lang string, source string, n_chars long").repartition(4).write.parquet(f"{folder}/documents.parquet")
    spark.createDataFrame(labels, "doc_id long, quality int, toxic int").write.parquet(f"{folder}/labels.parquet")
    return folder, rows


def test_pipeline_stages_on_their_own_input(spark, small_corpus):
    from tallyloom.session import written

    folder, rows = small_corpus
    docs = spark.read.parquet(f"{folder}/documents.parquet")
    columns, stages = docs.columns, dict(corpus_pipeline.STAGES)
    assert [n for n, _ in corpus_pipeline.STAGES] == ["quality classifier", "n-gram Jaccard join", "substring dedup", "secret scans", "best-fit packing"]
    good = written(stages["quality classifier"](spark, docs, folder), "t1")
    kept = {r.doc_id for r in good.collect()}
    assert good.columns == columns and {i for i in range(240) if i % 3} <= kept and not any(i % 3 == 0 for i in kept if i is not None and i < 240)

    single = written(stages["n-gram Jaccard join"](spark, good, folder), "t2")
    groups = brute_groups([(r.doc_id, r.text) for r in good.collect()])
    want = {i for i, _, root in groups if i == root} | {None} & kept
    assert single.columns == columns and {r.doc_id for r in single.collect()} == want

    cut = written(stages["substring dedup"](spark, single, folder), "t3")
    left = {r.doc_id: r.text for r in cut.collect() if r.doc_id is not None}
    assert cut.columns == columns and cut.count() == single.count()
    assert run_cover(list(left.items())) == {}
    before = {r.doc_id: r.text for r in single.collect() if r.doc_id is not None}
    repeated = run_cover(list(before.items()))
    assert all(left[i] == before[i] for i in before if i not in repeated) and repeated

    clean = written(stages["secret scans"](spark, cut, folder), "t4")
    assert clean.columns == columns and clean.count() == cut.count() and clean.where("text like '%9fQ2xLm84TzRw7Kp%'").count() == 0
    assert clean.where("n_chars <> length(text) and doc_id is not null").count() == 0

    packed = stages["best-fit packing"](spark, clean, folder)
    assert packed.where("piece = 0").count() == clean.count()
    assert sorted(r.ids_crc32 for r in corpus_pipeline.run(spark, folder).collect()) == sorted(r.ids_crc32 for r in packed.collect())


def test_pipeline_stages_on_empty_tables(spark, small_corpus, tmp_path):
    folder, _ = small_corpus
    for name in ("documents", "labels"):
        spark.read.parquet(f"{folder}/{name}.parquet").limit(0).write.parquet(f"{tmp_path}/{name}.parquet")
    assert corpus_pipeline.run(spark, str(tmp_path)).count() == 0


SF = "/root/testdata/sf0.001"


@pytest.mark.skipif(not os.path.isdir(SF), reason="bundled tables not present")
def test_registered_queries_match_sql(spark):
    from parity import compare, duck

    from tallyloom.llm import plans

    con = duck(SF)
    for name, sql in plans.ORACLES.items():
        df = plans.PLANS[name](spark, SF)
        assert compare(df.collect(), df.schema, con, sql) == "", name


@pytest.mark.skipif(not os.path.isdir(SF), reason="bundled tables not present")
def test_quality_on_held_out_rows(spark):
    from tallyloom.llm import plans

    sf = "/root/testdata/sf0.01"
    made = plans.PLANS["op3_quality_svm"](spark, sf)
    labels = spark.read.parquet(f"{sf}/labels.parquet")
    rows = made.join(labels, "doc_id").where("held_out").collect()
    assert len(rows) > 100 and sum(r.predicted == r.quality for r in rows) >= 0.95 * len(rows)


def test_texts_of_views_share_bytes():
    texts = Texts.of(["ab", None, "cd ef"])
    assert [texts.text(i) for i in range(3)] == ["ab", "", "cd ef"] and len(list(texts.slices(1))) == 3
