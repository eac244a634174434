"""The registered queries of this subpackage: each applies one operator to its whole table."""

from __future__ import annotations

import os

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from tallyloom.llm import (
    balanced, extraction, merkle, ngram_join, packing, passages, periods, pieces, quality, rules, secrets, tokens, topk,
)
from tallyloom.llm.frames import table
from tallyloom.plans.registry import Plan

PLANS: dict[str, Plan] = {}
ORACLES: dict[str, str] = {}


def query(name: str, sql: str | None = None):
    def add(plan: Plan) -> Plan:
        PLANS[name] = plan
        if sql is not None:
            ORACLES[name] = sql
        return plan

    return add


def tokenizer_path(name: str) -> str:
    """Where a public vocabulary file lies; TALLYLOOM_TOKENIZERS names another folder."""
    folder = os.environ.get("TALLYLOOM_TOKENIZERS")
    if folder:
        return os.path.join(folder, name)
    import public_tokenizers

    return public_tokenizers.path(name)


def held_out(id_column: str = "doc_id"):
    """Rows whose crc32 of the id as text leaves remainder 1 by 3; a null id is not held out."""
    return F.coalesce(F.crc32(F.col(id_column).cast("string")) % 3 == 1, F.lit(False))


@query("op3_quality_svm")
def op3_quality_svm(spark: SparkSession, sf_dir: str) -> DataFrame:
    docs = table(spark, sf_dir, "documents")
    model = quality.fit(docs, table(spark, sf_dir, "labels").where(~held_out()))
    scored = quality.score(docs, model)
    return scored.select("doc_id", held_out().alias("held_out"), "score", (F.col("score") >= 0.5).cast("int").alias("predicted"))


WORDS_SQL = r"""
w AS (
  SELECT row_number() OVER () AS row, doc_id, coalesce(text, '') AS t,
    regexp_extract_all(coalesce(text, ''), '[^\x20\x09-\x0D]+') AS ws FROM documents)"""

#: The rules of policy v1 in SQL, in the order of their bits.
RULES_SQL = [
    "n_words < 20", "100 * n_repeat_words > 30 * n_words", "100 * n_symbols > 20 * n_words", "100 * n_dup_lines > 30 * n_lines",
    "100 * word_chars > 1500 * n_words", "100 * n_upper > 30 * word_chars", "100 * n_bangs > 30 * n_words",
    "100 * n_same_next > 20 * n_words",
]
BITS_SQL = " + ".join(f"CASE WHEN {rule} THEN {1 << i} ELSE 0 END" for i, rule in enumerate(RULES_SQL))


@query(
    "op4_rule_ledger",
    rf"""
    WITH {WORDS_SQL}, windows AS (
      SELECT row, i, array_to_string(ws[i : i + 7], ' ') AS g FROM w, unnest(range(1, len(ws) - 6)) r(i) WHERE len(ws) >= 8
    ), twice AS (SELECT row, g FROM windows GROUP BY 1, 2 HAVING count(*) > 1),
    covered AS (
      SELECT row, count(DISTINCT i + k) AS n FROM windows JOIN twice USING (row, g), unnest(range(0, 8)) o(k) GROUP BY 1
    ), lines AS (SELECT row, list_filter(string_split(t, chr(10)), lambda x: regexp_matches(x, '[^ 	-
]')) AS ls FROM w),
    m AS (
      SELECT doc_id, len(ws) AS n_words, CAST(coalesce(list_sum(list_transform(ws, lambda x: length(x))), 0) AS BIGINT) AS word_chars,
        len(regexp_extract_all(t, '[#*$%&|<>]')) AS n_symbols, len(ls) - len(list_distinct(ls)) AS n_dup_lines,
        coalesce(covered.n, 0) AS n_repeat_words, len(ls) AS n_lines, len(regexp_extract_all(t, '[A-Z]')) AS n_upper,
        len(regexp_extract_all(t, '!')) AS n_bangs,
        len(list_filter(range(1, len(ws)), lambda i: ws[i] = ws[i + 1])) AS n_same_next
      FROM w JOIN lines USING (row) LEFT JOIN covered USING (row)
    ), b AS (SELECT *, CAST({BITS_SQL} AS BIGINT) AS failed_bits FROM m)
    SELECT doc_id, n_words, word_chars, n_symbols, n_dup_lines, n_repeat_words, failed_bits & 3 <> 0 AS base_failed,
      failed_bits = 0 AS kept, failed_bits FROM b
    """,
)
def op4_rule_ledger(spark: SparkSession, sf_dir: str) -> DataFrame:
    rows = rules.ledger(table(spark, sf_dir, "documents"))
    rows = rules.apply_policy(rules.apply_policy(rows, "base", "base_kept"), "v1")
    return rows.select(
        "doc_id", "n_words", "word_chars", "n_symbols", "n_dup_lines", "n_repeat_words",
        (~F.col("base_kept")).alias("base_failed"), "kept", "failed_bits",
    )


@query("op9_secret_scan")
def op9_secret_scan(spark: SparkSession, sf_dir: str) -> DataFrame:
    found = secrets.scan(table(spark, sf_dir, "documents"))
    base = secrets.KINDS[:3]
    counts = [secrets.counted(k).alias(f"n_{k}") for k in base]
    return found.select(
        "doc_id", *counts, F.sha2(secrets.joined(base), 256).alias("base_sha256"), secrets.joined(secrets.KINDS).alias("spans")
    )


@query("op2_token_files")
def op2_token_files(spark: SparkSession, sf_dir: str) -> DataFrame:
    docs = table(spark, sf_dir, "documents")
    manifest = tokens.write_shards(docs, tokenizer_path("byte_bpe_50k.json"), "space", end_id=2)
    return tokens.read_documents(manifest, "doc_id", tokens.crc, "ids_crc32", "long")


@query("op7_piece_codes")
def op7_piece_codes(spark: SparkSession, sf_dir: str) -> DataFrame:
    return pieces.encode(table(spark, sf_dir, "documents"), tokenizer_path("piece_bpe_32k.model"), with_ids=False)


@query("op8_vector_packing")
def op8_vector_packing(spark: SparkSession, sf_dir: str) -> DataFrame:
    limits = packing.Limits()
    docs = table(spark, sf_dir, "documents")
    cut = packing.pieces(docs, tokenizer_path("word_bpe_49k.json"), "words", 1, limits.tokens, with_ids=False)
    return packing.pack(cut, limits)


@query(
    "op5_block_topk",
    """
    WITH v AS (
      SELECT vec_id, list_transform(embedding, lambda x: floor(1024 * CAST(x AS DOUBLE))) AS e FROM embeddings
      WHERE vec_id IS NOT NULL AND embedding IS NOT NULL
        AND len(list_filter(embedding, lambda x: x IS NULL OR NOT isfinite(x))) = 0
    ), scored AS (
      SELECT q.vec_id AS query_id, c.vec_id AS vec_id, CAST(list_inner_product(q.e, c.e) AS BIGINT) AS score
      FROM v q JOIN v c ON q.vec_id <> c.vec_id WHERE q.vec_id % 100 = 0
    ), ranked AS (
      SELECT query_id, CAST(row_number() OVER (PARTITION BY query_id ORDER BY score DESC, vec_id) AS INTEGER) AS rank,
        vec_id, score FROM scored
    )
    SELECT query_id, rank, vec_id, score FROM ranked WHERE rank <= 10
    """,
)
def op5_block_topk(spark: SparkSession, sf_dir: str) -> DataFrame:
    vectors = topk.quantized(table(spark, sf_dir, "embeddings"))
    return topk.top_k(vectors.where(F.col("vec_id") % 100 == 0), vectors, 10)


@query("op6_main_text")
def op6_main_text(spark: SparkSession, sf_dir: str) -> DataFrame:
    pages = table(spark, sf_dir, "pages")
    text = extraction.extract(pages, extraction.fit_weights(pages))
    return text.select("page_id", "url", "text", F.length("text").cast("long").alias("n_chars"))


@query(
    "op1_ngram_join",
    r"""
    WITH RECURSIVE w AS (
      SELECT doc_id, regexp_extract_all(
        translate(coalesce(text, ''), 'ABCDEFGHIJKLMNOPQRSTUVWXYZ', 'abcdefghijklmnopqrstuvwxyz'), '[^\x20\x09-\x0D]+') AS ws
      FROM documents WHERE doc_id IS NOT NULL
    ), s AS (
      SELECT doc_id, CASE WHEN len(ws) >= 5
          THEN list_distinct(list_transform(range(1, len(ws) - 3), lambda i: array_to_string(ws[i : i + 4], ' ')))
        WHEN len(ws) > 0 THEN [array_to_string(ws, ' ')] ELSE [] END AS sh FROM w
    ), e AS MATERIALIZED (SELECT doc_id, len(sh) AS n, unnest(sh) AS g FROM s),
    links AS MATERIALIZED (
      SELECT a.doc_id AS x, b.doc_id AS y FROM e a JOIN e b USING (g) WHERE a.doc_id < b.doc_id
      GROUP BY a.doc_id, b.doc_id, a.n, b.n HAVING 100 * count(*) >= 80 * (a.n + b.n - count(*))
    ), ends AS MATERIALIZED (SELECT x, y FROM links UNION SELECT y, x FROM links),
    reach(x, c) AS (SELECT doc_id, doc_id FROM s UNION SELECT ends.y, reach.c FROM reach JOIN ends ON ends.x = reach.x)
    SELECT s.doc_id, len(sh) AS n_shingles, min(c) AS component_id FROM s JOIN reach ON reach.x = s.doc_id GROUP BY s.doc_id, sh
    """,
)
def op1_ngram_join(spark: SparkSession, sf_dir: str) -> DataFrame:
    return ngram_join.link_groups(table(spark, sf_dir, "documents"))


@query("op10_repeated_passages")
def op10_repeated_passages(spark: SparkSession, sf_dir: str) -> DataFrame:
    return passages.repeats(table(spark, sf_dir, "documents"))


#: crc32 of the decimal id in SQL: one step per bit over the characters; 0xEDB88320 is the fixed polynomial.
CRC_SQL = """
xor(4294967295, list_reduce(
  list_prepend(CAST(4294967295 AS BIGINT), list_transform(string_split(CAST(doc_id AS VARCHAR), ''), lambda x: CAST(ascii(x) AS BIGINT))),
  lambda c, b: list_reduce(
    list_prepend(xor(c, b), CAST([0, 0, 0, 0, 0, 0, 0, 0] AS BIGINT[])), lambda x, k: xor(x >> 1, (x & 1) * 3988292384))))"""


def leaf_sql(n_chars: str) -> str:
    """The text that a leaf digest is taken of."""
    columns = ["doc_id", "source", "lang", n_chars, "text"]
    return " || ".join(f"coalesce(strlen(CAST({c} AS VARCHAR)) || ':' || CAST({c} AS VARCHAR), '-')" for c in columns)


@query(
    "op11_merkle_manifest",
    rf"""
    WITH RECURSIVE d AS (
      SELECT row_number() OVER () AS row, doc_id, lang, sha256({leaf_sql("n_chars")}) AS leaf,
        sha256({leaf_sql("CASE WHEN crc % 7 = 0 THEN n_chars + 1 ELSE n_chars END")}) AS shown
      FROM (SELECT *, {CRC_SQL} AS crc FROM documents)
    ), leaves AS MATERIALIZED (
      SELECT *, dense_rank() OVER (ORDER BY lang NULLS FIRST) - 1 AS tree,
        row_number() OVER (PARTITION BY lang ORDER BY doc_id NULLS FIRST, leaf, row) - 1 AS place,
        count(*) OVER (PARTITION BY lang) AS n FROM d
    ), low(tree, level, place, n, h) AS (
      SELECT tree, 0, place, n, leaf FROM leaves
      UNION ALL
      SELECT tree, level + 1, place // 2, max((n + 1) // 2), sha256(string_agg(h, '' ORDER BY place)) FROM low WHERE n > 1
      GROUP BY tree, level, place // 2
    ), subs AS MATERIALIZED (SELECT tree, h FROM low WHERE n = 1),
    top(tree, level, place, n, h) AS (
      SELECT -1, 0, tree, (SELECT count(*) FROM subs), h FROM subs
      UNION ALL
      SELECT tree, level + 1, place // 2, max((n + 1) // 2), sha256(string_agg(h, '' ORDER BY place)) FROM top WHERE n > 1
      GROUP BY tree, level, place // 2
    ), nodes AS MATERIALIZED (SELECT * FROM low UNION ALL SELECT * FROM top),
    climb(row, own, tree, level, place, n, proof, folded) AS (
      SELECT row, tree, tree, 0, place, n, '', shown FROM leaves
      UNION ALL
      SELECT row, own, CASE WHEN c.n = 1 THEN -1 ELSE c.tree END, CASE WHEN c.n = 1 THEN 0 ELSE c.level + 1 END,
        CASE WHEN c.n = 1 THEN own ELSE c.place // 2 END,
        CASE WHEN c.n = 1 THEN (SELECT count(*) FROM subs) ELSE (c.n + 1) // 2 END,
        CASE WHEN c.n = 1 THEN proof ELSE proof || coalesce(s.h, '') END,
        CASE WHEN c.n = 1 THEN folded WHEN c.place % 2 = 0 THEN sha256(folded || coalesce(s.h, '')) ELSE sha256(s.h || folded) END
      FROM climb c LEFT JOIN nodes s ON s.tree = c.tree AND s.level = c.level AND s.place = xor(c.place, 1)
      WHERE c.n > 1 OR c.tree >= 0
    ), ends AS (SELECT * FROM climb WHERE tree = -1 AND n = 1)
    SELECT doc_id, leaf, subs.h AS subroot, root.h AS root, sha256(proof) AS proof_sha256, folded AS folded_root,
      folded = root.h AS verified
    FROM leaves JOIN ends USING (row) JOIN subs ON subs.tree = leaves.tree, (SELECT h FROM top WHERE n = 1) root
    """,
)
def op11_merkle_manifest(spark: SparkSession, sf_dir: str) -> DataFrame:
    docs = table(spark, sf_dir, "documents")
    tampered = F.when(F.crc32(F.col("doc_id").cast("string")) % 7 == 0, F.col("n_chars") + 1).otherwise(F.col("n_chars"))
    rows = merkle.manifest(docs, ["doc_id", "source", "lang", "n_chars", "text"], {"n_chars": tampered})
    return rows.withColumn("verified", F.col("folded_root") == F.col("root"))


@query("op12_cost_balanced_packing")
def op12_cost_balanced_packing(spark: SparkSession, sf_dir: str) -> DataFrame:
    return balanced.pack(table(spark, sf_dir, "documents"), tokenizer_path("byte_bpe_50k.json"), "space", end_id=0, with_ids=False)


def planted(docs: DataFrame) -> DataFrame:
    """Texts whose id has a crc32 divisible by ten go on with one period from some word on; the others stay."""
    h = F.crc32(F.col("doc_id").cast("string"))
    g = F.floor(h / 10)

    def periodic(words):
        n = F.size(words)
        a = F.pmod(g, n)
        p = 1 + F.floor((n - a) / (3 + F.pmod(g, F.lit(8))))
        word = lambda i: F.get(words, F.when(i < a, i).otherwise(a + F.pmod(i - a, p)).cast("int"))
        return F.when(n > 0, F.array_join(F.transform(F.sequence(F.lit(0), n - 1), word), " "))

    words = F.regexp_extract_all("text", F.lit(r"[^\x20\x09-\x0D]+"), F.lit(0))
    changed = F.transform(F.array(words), periodic)[0]
    return docs.select("doc_id", F.when(h % 10 == 0, changed).otherwise(F.col("text")).alias("text"))


@query(
    "op13_periodic_runs",
    rf"""
    WITH w AS (
      SELECT row_number() OVER () AS row, doc_id, regexp_extract_all(coalesce(text, ''), '[^\x20\x09-\x0D]+') AS ws, {CRC_SQL} AS h
      FROM documents
    ), plan AS (SELECT *, (h // 10) % len(ws) AS a FROM w),
    m AS MATERIALIZED (
      SELECT row, doc_id, CASE WHEN h % 10 = 0 AND len(ws) > 0 THEN list_transform(
          range(0, len(ws)), lambda i: ws[1 + CASE WHEN i < a THEN i ELSE a + (i - a) % (1 + (len(ws) - a) // (3 + (h // 10) % 8)) END])
        ELSE ws END AS ws FROM plan
    ), e AS MATERIALIZED (SELECT row, generate_subscripts(ws, 1) - 1 AS i, unnest(ws) AS g FROM m),
    pairs AS (SELECT x.row, x.i, y.i - x.i AS p FROM e x JOIN e y ON x.row = y.row AND x.g = y.g AND x.i < y.i),
    islands AS (SELECT *, i - row_number() OVER (PARTITION BY row, p ORDER BY i) AS k FROM pairs),
    stretches AS (
      SELECT row, p, min(i) AS s, count(*) + p AS n FROM islands GROUP BY row, p, k HAVING count(*) + p >= greatest(12, 2 * p)
    ), runs AS MATERIALIZED (SELECT row, s AS start, n AS length, min(p) AS period FROM stretches GROUP BY 1, 2, 3),
    gone AS (SELECT DISTINCT row, unnest(range(start + period, start + length)) AS i FROM runs),
    kept AS (SELECT row, string_agg(g, ' ' ORDER BY i) AS text FROM e ANTI JOIN gone USING (row, i) GROUP BY row),
    best AS (
      SELECT row, start, length, period FROM runs
      QUALIFY row_number() OVER (PARTITION BY row ORDER BY length DESC, start, period) = 1
    ), lines AS (
      SELECT row, count(*) AS n, string_agg(start || ',' || length || ',' || period || chr(10), '' ORDER BY start, period) AS t
      FROM runs GROUP BY row
    )
    SELECT doc_id, coalesce(lines.n, 0) AS n_runs, start, length, period, 1000 * length // period AS exponent_milli,
      sha256(coalesce(t, '')) AS runs_sha256, sha256(coalesce(kept.text, '')) AS collapsed_sha256
    FROM m LEFT JOIN lines USING (row) LEFT JOIN best USING (row) LEFT JOIN kept USING (row)
    """,
)
def op13_periodic_runs(spark: SparkSession, sf_dir: str) -> DataFrame:
    found = periods.periodic_runs(planted(table(spark, sf_dir, "documents")))
    line = lambda r: F.concat_ws(",", r["start"], r["length"], r["period"])
    ranked = F.transform("runs", lambda r: F.struct(r["length"], (-r["start"]).alias("start"), (-r["period"]).alias("period")))
    best = F.array_max(ranked)
    return found.withColumn("best", best).select(
        "doc_id", F.size("runs").cast("long").alias("n_runs"), (-F.col("best.start")).alias("start"), F.col("best.length").alias("length"),
        (-F.col("best.period")).alias("period"), F.expr("1000 * best.length div -best.period").alias("exponent_milli"),
        F.sha2(F.array_join(F.transform("runs", lambda r: F.concat(line(r), F.lit("\n"))), ""), 256).alias("runs_sha256"),
        F.sha2("collapsed", 256).alias("collapsed_sha256"),
    )
