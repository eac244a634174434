"""Merkle manifest, cost-balanced packing and periodic runs, against plain Python and on messy rows."""

import hashlib
import random
import re
import zlib

import numpy as np
import pytest
from pyspark.sql import functions as F

from tallyloom.llm import balanced, chunkids, grammar, merkle, periods, plans, tokens
from tallyloom.llm.plans import tokenizer_path
from tallyloom.llm.textbatch import Texts

WORD = re.compile(r"[^\x20\x09-\x0D]+")
SCHEMA = "doc_id long, text string, lang string, source string, n_chars long, leaf string, start int, runs int, root string"


@pytest.fixture(scope="module")
def messy():
    rng = random.Random(5)
    texts = [None, "", " \n\t ", "one", "a " * 40, "a b " * 30 + "end", "x y z " * 4, "w " * 11, "w " * 12, "é 漢 " * 20]
    texts += [" ".join(rng.choice("abc") for _ in range(rng.randrange(60))) for _ in range(30)]
    texts += [" ".join(f"w{i % 997}" for i in range(30_000)), "long " + "ab cd ef " * 9_000]
    langs = ["en", None, "de", "", "é", "fr"]
    rows = [(i, t, langs[i % 6] if i % 4 else "en", None if i % 5 else "s", len(t) if t else None, "x", 1, 2, "y") for i, t in enumerate(texts)]
    return rows + [rows[4], rows[4], (4, "another text", "en", None, 3, "x", 1, 2, "y"), (None, "no id a b a b a b a b a b a b", "en", None, None, None, None, None, None)]


@pytest.fixture(scope="module")
def docs(spark, messy):
    return spark.createDataFrame(messy, SCHEMA).repartition(3)


@pytest.fixture(scope="module")
def none(spark):
    return spark.createDataFrame([], SCHEMA)


# --- Merkle manifest --------------------------------------------------------------------------


def h(*parts):
    return hashlib.sha256("".join(parts).encode()).hexdigest()


def plain_leaf(row, n_chars):
    fields = [row[0], row[3], row[2], n_chars, row[1]]
    return h(*("-" if f is None else f"{len(str(f).encode())}:{f}" for f in fields))


def plain_tree(leaves):
    """Levels of a tree and, per leaf, its siblings as (digest, side)."""
    levels = [leaves]
    while len(levels[-1]) > 1:
        levels.append([h(*levels[-1][i : i + 2]) for i in range(0, len(levels[-1]), 2)])
    paths = []
    for place in range(len(leaves)):
        path = []
        for level in levels[:-1]:
            other = place ^ 1
            path.append((level[other] if other < len(level) else "", other > place))
            place //= 2
        paths.append(path)
    return levels[-1][0], paths


def plain_manifest(rows):
    crc = lambda r: zlib.crc32(str(r[0]).encode()) if r[0] is not None else 1
    shown = lambda r: r[4] + 1 if crc(r) % 7 == 0 and r[4] is not None else r[4]
    trees = {}
    for r in rows:
        trees.setdefault(r[2], []).append((r[0] is not None, r[0] or 0, plain_leaf(r, r[4]), plain_leaf(r, shown(r)), r[0]))
    order = sorted(trees, key=lambda x: (x is not None, (x or "").encode()))
    parts = [sorted(trees[name], key=lambda x: x[:3]) for name in order]
    made = [plain_tree([x[2] for x in part]) for part in parts]
    root, tops = plain_tree([m[0] for m in made])
    out = []
    for part, (subroot, paths), top in zip(parts, made, tops):
        for x, path in zip(part, paths):
            folded = x[3]
            for other, right in path + top:
                folded = h(folded, other) if right else h(other, folded)
            out.append((x[4], x[2], subroot, root, h(*(o for o, _ in path + top)), folded, folded == root))
    return out


def tampered():
    return F.when(F.crc32(F.col("doc_id").cast("string")) % 7 == 0, F.col("n_chars") + 1).otherwise(F.col("n_chars"))


def key(row):
    return tuple((x is not None, x) for x in row)


def test_stretches_give_the_tree_and_ask_for_the_fewest_nodes():
    rng = random.Random(1)
    for _ in range(200):
        n = rng.randrange(1, 70)
        leaves = [h(str(i)) for i in range(n)]
        root, paths = plain_tree(leaves)
        cuts = sorted({0, n, *(rng.randrange(n + 1) for _ in range(rng.randrange(6)))})
        stretches = list(zip(cuts[:-1], cuts[1:]))
        low = {(lv, p): d for a, b in stretches for lv, p, d in merkle.frontier(a, leaves[a:b], n)}
        nodes = merkle.above(low, n)
        for a, b in stretches:
            known, wanted = set(range(a, b)), set()
            for level, width in enumerate(merkle.widths(n)[:-1]):
                wanted |= {(level, p ^ 1) for p in known if p ^ 1 < width and p ^ 1 not in known}
                known = {p // 2 for p in known}
            asked = list(merkle.missing(a, b - a, n))
            assert set(asked) == wanted and len(asked) == len(wanted)
            levels = merkle.filled(a, leaves[a:b], n, {c: nodes[c] for c in asked})
            assert levels[-1] == (0, [root])
            for i in range(a, b):
                path = merkle.path(i, levels, n)
                assert [(x, bool(s)) for x, s in path] == [(x, bool(s)) for x, s in paths[i]]
                assert merkle.fold(leaves[i], path) == root


def test_manifest_equals_plain_trees(docs, messy):
    fields = ["doc_id", "source", "lang", "n_chars", "text"]
    found = merkle.manifest(docs, fields, {"n_chars": tampered()}, with_siblings=True)
    names = ["doc_id", "leaf", "subroot", "root", "proof_sha256", "folded_root"]
    rows = found.collect()
    got = [tuple(r[n] for n in names) + (r["folded_root"] == r["root"],) for r in rows]
    assert sorted(got, key=key) == sorted(plain_manifest(messy), key=key)
    assert all(r["proof_sha256"] == h(*r["siblings"]) for r in rows)
    assert not all(g[-1] for g in got) and any(g[-1] for g in got)


def test_manifest_of_one_and_of_no_row(docs, none):
    one = merkle.manifest(docs.where("doc_id = 3"), ["doc_id", "text"]).first()
    assert one["leaf"] == one["subroot"] == one["root"] == one["folded_root"] and one["proof_sha256"] == h()
    assert merkle.manifest(none, ["doc_id", "text"]).count() == 0


# --- cost-balanced packing --------------------------------------------------------------------


def plain_assign(lengths, capacity, cost):
    total = sum(lengths)
    full = [capacity] * (total // capacity) + [1 << b for b in range(20, -1, -1) if total % capacity >> b & 1]
    room, spent, out = list(full), [0.0] * len(full), []
    waiting = [(-n, i, 0) for i, n in enumerate(lengths) if n]
    while waiting:
        waiting.sort()
        n, piece, start = waiting.pop(0)
        n = -n
        can = [k for k in range(len(full)) if room[k] >= n] or [k for k in range(len(full)) if room[k]]
        k = min(can, key=lambda k: (spent[k], k))
        taken = min(n, room[k])
        out.append((piece, start, taken, k, full[k] - room[k]))
        room[k] -= taken
        spent[k] += cost(taken)
        if taken < n:
            waiting.append((taken - n, piece, start + taken))
    return out


def test_assign_equals_a_plain_search():
    rng = random.Random(2)
    for _ in range(60):
        lengths = [rng.randrange(1, 64) for _ in range(rng.randrange(60))]
        got = balanced.assign(np.array(lengths, np.int64), 64)
        assert [tuple(r) for r in got.tolist()] == plain_assign(lengths, 64, balanced.Cost())


def test_costs_are_more_even_than_by_first_fit():
    rng = np.random.default_rng(4)
    lengths = rng.integers(1, 400, 4000)
    cost = balanced.Cost()
    full = int(lengths.sum()) // 1024

    def spread(where):
        return np.bincount(where[:, 3], cost(where[:, 2]), full + 16)[:full].std()

    where = balanced.assign(lengths, 1024, cost)
    assert spread(where) < 0.6 * spread(balanced.assign(lengths, 1024, balanced.Cost(0.0, 0.0)))
    assert len(where) - len(lengths) <= full + 10


def check_packed(rows, wanted, capacity):
    """``wanted``: the ids of every document; rows of documents with equal ids and texts can't be told apart."""
    pieces = {}
    sequences = {}
    for r in rows:
        ids = np.frombuffer(r["ids"], "<u4").tolist()
        assert len(ids) == r["length"] and r["ids_crc32"] == zlib.crc32(bytes(r["ids"]))
        pieces.setdefault((r["doc_id"], r["doc_tokens"]), []).append((r["start"], ids))
        sequences.setdefault(r["sequence_id"], []).append((r["offset"], r["length"]))
    for parts in sequences.values():
        at = 0
        for offset, length in sorted(parts):
            assert offset == at
            at += length
        assert at == capacity or at & (at - 1) == 0 and at < capacity
    have = sorted(((k, s, i) for k, v in pieces.items() for s, ids in v for i in [x for x in ids]), key=repr)
    assert len(have) == sum(map(len, wanted))
    flat = sorted((k, s + j, x) for k, v in pieces.items() if k[0] is not None for s, ids in v for j, x in enumerate(ids))
    return flat


def test_packing_holds_every_token_once(docs, none, messy):
    from tokenizers import Tokenizer

    path = tokenizer_path("byte_bpe_50k.json")
    plain = Tokenizer.from_file(path)
    wanted = [plain.encode(r[1] or "", add_special_tokens=False).ids + [0] for r in messy]
    packed = balanced.pack(docs, path, "space", 0, 1024, group=40).collect()
    flat = check_packed(packed, wanted, 1024)
    assert flat == sorted(((r[0], len(w)), j, x) for r, w in zip(messy, wanted) if r[0] is not None for j, x in enumerate(w))
    assert balanced.pack(none, path, "space", 0).count() == 0


# --- periodic runs ----------------------------------------------------------------------------


def plain_runs(words, least=12):
    n, seen = len(words), {}
    for p in range(1, n // 2 + 1):
        i = 0
        while i < n - p:
            j = i
            while j < n - p and words[j] == words[j + p]:
                j += 1
            if j - i + p >= max(least, 2 * p):
                seen.setdefault((i, j - i + p), p)
            i = max(j, i + 1)
    return sorted(((s, length, p) for (s, length), p in seen.items()), key=lambda r: (r[0], r[2]))


def plain_collapsed(words, runs):
    gone = {i for s, n, p in runs for i in range(s + p, s + n)}
    return " ".join(w for i, w in enumerate(words) if i not in gone)


def plain_planted(doc_id, words):
    crc = zlib.crc32(str(doc_id).encode()) if doc_id is not None else 1
    g, n = crc // 10, len(words)
    if crc % 10 or not n:
        return words
    a = g % n
    p = 1 + (n - a) // (3 + g % 8)
    return [words[i] if i < a else words[a + (i - a) % p] for i in range(n)]


def test_extensions_equal_plain_comparison():
    rng = np.random.default_rng(6)
    for _ in range(60):
        parts = [rng.integers(0, rng.choice([1, 2, 3, 30]), rng.integers(1, 60)) for _ in range(5)]
        if rng.random() < 0.5:
            parts[0] = np.tile(parts[0], 5)
        sequence = [0]
        for i, part in enumerate(parts):
            sequence += [*(part + 6).tolist(), i + 1]
        made = grammar.Grammar(np.array(sequence), 6)
        places = np.flatnonzero(np.array(sequence) >= 6)
        x, y = rng.choice(places, 200), rng.choice(places, 200)
        x, y = x[x != y], y[x != y]

        def plain(a, b, step):
            n = 0
            while sequence[a] == sequence[b]:
                n, a, b = n + 1, a + step, b + step
            return n

        assert made.extend(x, y, False).tolist() == [plain(a, b, 1) for a, b in zip(x.tolist(), y.tolist())]
        assert made.extend(x, y, True).tolist() == [plain(a - 1, b - 1, -1) for a, b in zip(x.tolist(), y.tolist())]


def test_runs_equal_plain_search():
    rng = random.Random(7)
    for _ in range(80):
        texts = []
        for _ in range(rng.randrange(6)):
            words = [rng.randrange(rng.choice([1, 2, 3, 50])) for _ in range(rng.choice([0, 1, 11, 12, 13, 24, 60, 150]))]
            texts.append(plain_planted(rng.choice([3, 8, 30]), words))
        flat = np.array([w for t in texts for w in t], np.int64)
        found = [[] for _ in texts]
        for text, *run in zip(*(x.tolist() for x in periods.find_runs(flat, np.array([len(t) for t in texts], np.int64)))):
            found[text].append(tuple(run))
        assert found == [plain_runs(t) for t in texts]


def test_periodic_runs_on_messy_rows(docs, none, messy, monkeypatch):
    found = periods.periodic_runs(plans.planted(docs)).collect()
    wanted = []
    for r in messy:
        words = plain_planted(r[0], WORD.findall(r[1] or ""))
        if len(words) < 20_000:
            runs = plain_runs(words)
            wanted.append((r[0], runs, plain_collapsed(words, runs)))
    long = [r for r in found if any(x["length"] > 20_000 for x in r["runs"])]
    got = [(r["doc_id"], [tuple(x) for x in r["runs"]], r["collapsed"]) for r in found]
    assert all(sorted(wanted, key=repr).count(w) <= got.count(w) for w in wanted) and len(got) == len(messy)
    assert {r["doc_id"] for r in long} >= {len(messy) - 5}
    assert periods.periodic_runs(plans.planted(none)).count() == 0


def test_texts_without_words_are_not_planted(spark):
    ids = [i for i in range(200) if zlib.crc32(str(i).encode()) % 10 == 0][:4]
    texts = [None, "", " \n ", "one"]
    df = spark.createDataFrame(list(zip(ids, texts)), "doc_id long, text string")
    made = {r.doc_id: (list(r.runs), r.collapsed) for r in periods.periodic_runs(plans.planted(df)).collect()}
    assert made == {ids[0]: ([], ""), ids[1]: ([], ""), ids[2]: ([], ""), ids[3]: ([], "one")}


# --- joined pieces ----------------------------------------------------------------------------


@pytest.mark.parametrize("name, cut", [("byte_bpe_50k.json", "space"), ("word_bpe_49k.json", "words")])
def test_joined_pieces_encode_like_whole_texts(name, cut):
    from tokenizers import Tokenizer

    plain = Tokenizer.from_file(tokenizer_path(name))
    rng = random.Random(8)
    pool = ["word", "Çe", "é", "́x", "<|endoftext|>", "a<|endoftext|>b", "<|", "İ", "ΣΑΣ", "ﬁ", " ", " y", "\x1c", "\x85", "don't", "x" * 70, "12ab", "漢字", "🙂"]
    texts = ["".join(rng.choice(pool) + rng.choice([" ", "  ", "\n", "\t\n ", ""]) for _ in range(rng.randrange(200))) for _ in range(300)]
    make = tokens.encoder.__wrapped__(tokenizer_path(name), cut)
    make.memo = 500  # forgets often
    for at in range(0, len(texts), 20):
        ids, sizes = make(Texts.of(texts[at : at + 20]))
        wanted = [x.ids for x in plain.encode_batch(texts[at : at + 20], add_special_tokens=False)]
        assert sizes.tolist() == list(map(len, wanted)) and ids.tolist() == [i for w in wanted for i in w]
    assert isinstance(make.encode, chunkids.JoinedEncode)
