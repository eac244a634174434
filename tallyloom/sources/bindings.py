"""Logical inputs of the operators over the bundled tables, each with its SQL twin.

``CLV_SQL`` / ``GRAPH_SQL`` / ... are lists of common table expressions; a query's oracle is
``WITH`` + the lists it needs + its own select.
"""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql import types as T

from tallyloom.session import bucket_count

MONEY = T.DecimalType(18, 4)

# Observation ends where the label period starts; the last two observed years get split columns.
CUTOFF = "2001-01-01"
YEAR1, YEAR2 = 1999, 2000

# Vocabularies of the pivoted share columns (fixed values).
CATEGORIES = ["ECONOMY", "LARGE", "MEDIUM", "PROMO", "SMALL", "STANDARD"]
SEASONS = ["S1", "S2", "S3", "S4"]

EGO = "S#0"
VARIANT = "s#1"
SOCIAL = ["promo", "standard"]
LEGAL = ["economy"]


def table(spark: SparkSession, sf_dir: str, name: str) -> DataFrame:
    return spark.read.parquet(f"{sf_dir}/{name}.parquet")


# --- customer value ---------------------------------------------------------------------------


def order_lines(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Item rows with customer, sale, dates and money; no product attributes."""
    orders = (
        table(spark, sf_dir, "orders")
        .where(F.col("o_orderdate") < F.to_timestamp(F.lit(CUTOFF)))
        .select("o_orderkey", "o_custkey", F.col("o_orderdate").cast("date").alias("order_date"))
    )
    price, discount = F.col("l_extendedprice"), F.col("l_discount")
    lines = table(spark, sf_dir, "lineitem").select(
        "l_orderkey",
        F.col("l_partkey").alias("prod_id"),
        F.col("l_shipdate").cast("date").alias("pack_date"),
        (price * (1 - discount)).cast(MONEY).alias("sale_revenue"),
        (-(price * discount)).cast(MONEY).alias("sale_discount"),
        F.when(F.col("l_returnflag") == "R", F.col("l_suppkey")).alias("returned_to"),
        (F.col("l_linestatus") == "O").cast("int").alias("web_only"),
    )
    return lines.join(orders, F.col("l_orderkey") == F.col("o_orderkey")).select(
        F.col("o_custkey").alias("cust_id"),
        F.col("o_orderkey").alias("sale_id"),
        "prod_id",
        "order_date",
        "pack_date",
        "sale_revenue",
        "sale_discount",
        "returned_to",
        "web_only",
    )


def transactions(spark: SparkSession, sf_dir: str, every: bool = False) -> DataFrame:
    """Item rows with product attributes: the flat transaction table. With ``every`` also those of unknown products, where
    the flag ``listed`` is null."""
    words = F.split("p_name", " ")
    parts = table(spark, sf_dir, "part").select(
        F.col("p_partkey").alias("prod_id"),
        F.col("p_brand").alias("brand"),
        F.col("p_type").alias("category"),
        F.col("p_size").cast("string").alias("size"),
        F.get(words, F.lit(0)).alias("color"),
        F.get(words, F.lit(1)).alias("fine_category"),
        (F.col("p_type") == "PROMO").cast("int").alias("outlet"),
    )
    season = F.concat(F.lit("S"), F.quarter("pack_date").cast("string"))
    lines = order_lines(spark, sf_dir).withColumn("season", season)
    return lines.join(parts.withColumn("listed", F.lit(True)), "prod_id", "left") if every else lines.join(parts, "prod_id")


def revenue_labels(spark: SparkSession, sf_dir: str) -> DataFrame:
    """All customers with the revenue of the label period (0 when none) and their part."""
    later = (
        table(spark, sf_dir, "orders")
        .where(F.col("o_orderdate") >= F.to_timestamp(F.lit(CUTOFF)))
        .groupBy(F.col("o_custkey").alias("cust_id"))
        .agg(F.sum(F.col("o_totalprice").cast(MONEY)).alias("revenue"))
    )
    everyone = table(spark, sf_dir, "customer").select(F.col("c_custkey").alias("cust_id"))
    return everyone.join(later, "cust_id", "left").select(
        "cust_id",
        F.coalesce(F.col("revenue").cast("double"), F.lit(0.0)).alias("revenue_label"),
        F.when(F.col("cust_id") % 5 == 0, "test").otherwise("train").alias("part"),
    )


TX_SQL = f"""
lines AS (
  SELECT o_custkey AS cust_id, o_orderkey AS sale_id, l_partkey AS prod_id,
         CAST(o_orderdate AS DATE) AS order_date, CAST(l_shipdate AS DATE) AS pack_date,
         CAST(l_extendedprice * (1 - l_discount) AS DECIMAL(18,4)) AS sale_revenue,
         CAST(-(l_extendedprice * l_discount) AS DECIMAL(18,4)) AS sale_discount,
         CASE WHEN l_returnflag = 'R' THEN l_suppkey END AS returned_to,
         CAST(l_linestatus = 'O' AS INT) AS web_only
  FROM lineitem JOIN orders ON l_orderkey = o_orderkey
  WHERE o_orderdate < TIMESTAMP '{CUTOFF} 00:00:00'),
tx AS (
  SELECT lines.*, 'S' || CAST(quarter(pack_date) AS VARCHAR) AS season,
         p_brand AS brand, p_type AS category, CAST(p_size AS VARCHAR) AS size,
         string_split(p_name, ' ')[1] AS color, string_split(p_name, ' ')[2] AS fine_category,
         CAST(p_type = 'PROMO' AS INT) AS outlet
  FROM lines JOIN part ON prod_id = p_partkey),
labels_clv AS (
  SELECT c_custkey AS cust_id,
         coalesce(CAST(r.revenue AS DOUBLE), 0.0) AS revenue_label,
         CASE WHEN c_custkey % 5 = 0 THEN 'test' ELSE 'train' END AS part
  FROM customer LEFT JOIN (
    SELECT o_custkey, sum(CAST(o_totalprice AS DECIMAL(18,4))) AS revenue FROM orders
    WHERE o_orderdate >= TIMESTAMP '{CUTOFF} 00:00:00' GROUP BY 1) r ON c_custkey = o_custkey)
"""

# --- property graph ---------------------------------------------------------------------------


def _name(prefix: str, key: str):
    return F.concat(F.lit(prefix + "#"), F.col(key).cast("string"))


def entities(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Nodes (name, entity_type)."""
    kinds = [("supplier", "S", "s_suppkey"), ("customer", "C", "c_custkey"), ("part", "P", "p_partkey")]
    nodes = None
    for kind, prefix, key in kinds:
        part = table(spark, sf_dir, kind).select(
            _name(prefix, key).alias("name"), F.lit(kind).alias("entity_type")
        )
        nodes = part if nodes is None else nodes.unionByName(part)
    return nodes


def related_to(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Edges supplier -> customer, one per item (src, dst, action, doc_id).

    Items are dealt by order over all of the session's partitions, which bounds what a task of the join sorts.
    """
    orders = table(spark, sf_dir, "orders").select("o_orderkey", "o_custkey")
    parts = table(spark, sf_dir, "part").select("p_partkey", "p_type")
    items = table(spark, sf_dir, "lineitem").select("l_orderkey", "l_suppkey", "l_partkey")
    return (
        items.repartition(bucket_count(items), "l_orderkey")
        .join(orders, F.col("l_orderkey") == F.col("o_orderkey"))
        .join(parts, F.col("l_partkey") == F.col("p_partkey"))
        .select(
            _name("S", "l_suppkey").alias("src"),
            _name("C", "o_custkey").alias("dst"),
            F.lower("p_type").alias("action"),
            F.col("l_orderkey").alias("doc_id"),
        )
    )


def in_category(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Document -> category name."""
    return table(spark, sf_dir, "orders").select(
        F.col("o_orderkey").alias("doc_id"), F.col("o_orderpriority").alias("category")
    )


def claims(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Claims (claim_id, doc_id, actor, target, topic): one per item row."""
    orders = table(spark, sf_dir, "orders").select("o_orderkey", "o_custkey")
    parts = table(spark, sf_dir, "part").select("p_partkey", "p_type")
    return (
        table(spark, sf_dir, "lineitem")
        .select("l_orderkey", "l_linenumber", "l_partkey", "l_suppkey", "l_linestatus")
        .join(orders, F.col("l_orderkey") == F.col("o_orderkey"))
        .join(parts, F.col("l_partkey") == F.col("p_partkey"))
        .select(
            F.concat_ws("|", "l_orderkey", "l_linenumber", "l_partkey", "l_suppkey").alias("claim_id"),
            F.col("l_orderkey").alias("doc_id"),
            _name("S", "l_suppkey").alias("actor"),
            _name("C", "o_custkey").alias("target"),
            F.concat_ws("/", "p_type", "l_linestatus").alias("topic"),
        )
    )


def mentions(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Distinct document -> entity mentions (doc_id, name).

    Nearly all are distinct, so nothing is combined before the shuffle: rows are dealt by document over all of the session's
    partitions, which bounds a task's memory, and joins and distinct counts by document need no further shuffle.
    """
    lines = table(spark, sf_dir, "lineitem")
    by_supplier = lines.select(F.col("l_orderkey").alias("doc_id"), _name("S", "l_suppkey").alias("name"))
    by_part = lines.select(F.col("l_orderkey").alias("doc_id"), _name("P", "l_partkey").alias("name"))
    by_customer = table(spark, sf_dir, "orders").select(
        F.col("o_orderkey").alias("doc_id"), _name("C", "o_custkey").alias("name")
    )
    every = by_supplier.unionByName(by_part).unionByName(by_customer)
    return every.repartition(bucket_count(lines), "doc_id").distinct()


GRAPH_SQL = """
entity AS (
  SELECT 'S#' || CAST(s_suppkey AS VARCHAR) AS name, 'supplier' AS entity_type FROM supplier
  UNION ALL SELECT 'C#' || CAST(c_custkey AS VARCHAR), 'customer' FROM customer
  UNION ALL SELECT 'P#' || CAST(p_partkey AS VARCHAR), 'part' FROM part),
related_to AS (
  SELECT 'S#' || CAST(l_suppkey AS VARCHAR) AS src, 'C#' || CAST(o_custkey AS VARCHAR) AS dst,
         lower(p_type) AS action, l_orderkey AS doc_id
  FROM lineitem JOIN orders ON l_orderkey = o_orderkey JOIN part ON l_partkey = p_partkey),
in_category AS (SELECT o_orderkey AS doc_id, o_orderpriority AS category FROM orders),
claim AS (
  SELECT concat_ws('|', l_orderkey, l_linenumber, l_partkey, l_suppkey) AS claim_id,
         l_orderkey AS doc_id, 'S#' || CAST(l_suppkey AS VARCHAR) AS actor,
         'C#' || CAST(o_custkey AS VARCHAR) AS target, p_type || '/' || l_linestatus AS topic
  FROM lineitem JOIN orders ON l_orderkey = o_orderkey JOIN part ON l_partkey = p_partkey),
links AS MATERIALIZED (
  SELECT claim_id, doc_id, actor AS name, 'ACTOR' AS role FROM claim
  UNION ALL SELECT claim_id, doc_id, target, 'TARGET' FROM claim),
mention AS MATERIALIZED (
  SELECT l_orderkey AS doc_id, 'S#' || CAST(l_suppkey AS VARCHAR) AS name FROM lineitem
  UNION SELECT l_orderkey, 'P#' || CAST(l_partkey AS VARCHAR) FROM lineitem
  UNION SELECT o_orderkey, 'C#' || CAST(o_custkey AS VARCHAR) FROM orders)
"""

# --- retrieval --------------------------------------------------------------------------------


def vectors(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Items (id text, vec array<float>)."""
    return table(spark, sf_dir, "embeddings").select(
        F.col("vec_id").cast("string").alias("id"), F.col("embedding").alias("vec")
    )


def query_vectors(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Every vector also serves as a query (qid bigint, vec)."""
    return table(spark, sf_dir, "embeddings").select(
        F.col("vec_id").alias("qid"), F.col("embedding").alias("vec")
    )


def games(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Catalogue records with nested fields, some of them missing."""
    key = F.col("p_partkey")
    votes = F.create_map(F.col("p_brand"), F.col("p_size"), F.lower("p_type"), F.lit(1))
    return table(spark, sf_dir, "part").select(
        key.cast("string").alias("app_id"),
        F.col("p_name").alias("name"),
        F.when(F.col("p_size") > 5, F.concat_ws(" ", F.lit("A"), F.lower("p_type"), F.lit("item")))
        .alias("short_description"),
        F.when(F.col("p_type") != "SMALL", F.array("p_type")).alias("genres"),
        F.when(F.col("p_size") > 10, votes).alias("tags"),
        F.col("p_retailprice").alias("price"),
        F.lit(None).cast("string").alias("release_date"),
        F.concat(F.lit("img/"), key.cast("string"), F.lit(".jpg")).alias("header_image"),
        F.when(F.col("p_size") > 3, F.lit(True)).alias("windows"),
        F.when(F.col("p_size") > 30, F.lit(True)).alias("mac"),
        F.lit(None).cast("boolean").alias("linux"),
    )


def reviews(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Reviews (appid text, review_id, review, language, votes_up)."""
    return table(spark, sf_dir, "documents").select(
        (F.col("doc_id") % 200).cast("string").alias("appid"),
        F.col("doc_id").alias("review_id"),
        F.col("text").alias("review"),
        F.col("lang").alias("language"),
        F.col("n_chars").alias("votes_up"),
    )


RETRIEVAL_SQL = """
vecs AS (SELECT vec_id, CAST(embedding AS DOUBLE[]) AS vec FROM embeddings),
pairs AS (
  SELECT q.vec_id AS qid, CAST(i.vec_id AS VARCHAR) AS id,
         round(list_dot_product(q.vec, i.vec)
               / (sqrt(list_dot_product(q.vec, q.vec)) * sqrt(list_dot_product(i.vec, i.vec))), 9) AS cosine
  FROM vecs q, vecs i WHERE q.vec_id <> i.vec_id),
cand AS (
  SELECT qid, id, greatest(0.0, cosine) AS similarity,
         CAST(row_number() OVER (PARTITION BY qid ORDER BY cosine DESC, id) AS INT) AS rank
  FROM pairs QUALIFY rank <= 20),
games AS (
  SELECT CAST(p_partkey AS VARCHAR) AS app_id, p_name AS name,
         CASE WHEN p_size > 5 THEN concat_ws(' ', 'A', lower(p_type), 'item') END AS short_description,
         CASE WHEN p_type <> 'SMALL' THEN p_type END AS genre_text,
         CASE WHEN p_size > 10 THEN p_brand || ', ' || lower(p_type) END AS tag_text,
         p_retailprice AS price, p_size
  FROM part),
reviews AS (
  SELECT CAST(doc_id % 200 AS VARCHAR) AS appid, doc_id AS review_id, text AS review,
         lang AS language, n_chars AS votes_up FROM documents),
top_reviews AS (
  SELECT appid, review_id, regexp_replace(review, '^\\s+|\\s+$', '', 'g') AS review, votes_up,
         CAST(row_number() OVER (PARTITION BY appid ORDER BY votes_up DESC, review_id) AS INT) AS rank
  FROM reviews WHERE language = 'en' AND review IS NOT NULL AND trim(review) <> ''
  QUALIFY rank <= 3)
"""

# --- images and predictions -------------------------------------------------------------------


def images(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Image rows in the schema of the built-in image source, drawn from the vectors.

    Each vector is 64 pixel bytes: gray images of several shapes, or four-channel ones for the
    last classes; class 9 has unreadable files (sizes of -1, no data).
    """
    pixel = F.transform(
        "embedding",
        lambda x: F.least(F.greatest(F.floor((x.cast("double") + 1) * 127.5), F.lit(0)), F.lit(255)),
    )
    data = F.unhex(F.array_join(F.transform(pixel, lambda p: F.lpad(F.hex(p), 2, "0")), ""))
    label = F.col("label")
    bad = (label == 9)
    channels = F.when(label >= 7, 4).otherwise(1)
    width = F.when(label >= 7, 4).otherwise(F.when(label % 2 == 0, 8).otherwise(16))
    return table(spark, sf_dir, "embeddings").select(
        F.col("vec_id"),
        label.cast("string").alias("category"),
        F.struct(
            F.concat(F.lit("img-"), F.col("vec_id").cast("string")).alias("origin"),
            F.when(bad, -1).otherwise(F.lit(64) / channels / width).cast("int").alias("height"),
            F.when(bad, -1).otherwise(width).cast("int").alias("width"),
            F.when(bad, -1).otherwise(channels).cast("int").alias("nChannels"),
            F.when(bad, -1).otherwise(F.when(label >= 7, 24).otherwise(0)).cast("int").alias("mode"),
            F.when(~bad, data).alias("data"),
        ).alias("image"),
    )


IMAGE_SQL = """
img AS (
  SELECT vec_id, CAST(label AS VARCHAR) AS category,
         CASE WHEN label = 9 THEN -1 WHEN label >= 7 THEN 4
              WHEN label % 2 = 0 THEN 8 ELSE 16 END AS width,
         CASE WHEN label = 9 THEN -1 WHEN label >= 7 THEN 4
              WHEN label % 2 = 0 THEN 8 ELSE 4 END AS height,
         CASE WHEN label = 9 THEN -1 WHEN label >= 7 THEN 24 ELSE 0 END AS mode,
         list_transform(embedding, lambda x:
           CAST(least(greatest(floor((CAST(x AS DOUBLE) + 1) * 127.5), 0), 255) AS INT)) AS px
  FROM embeddings)
"""


def minifigs(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Image metadata records (item_id, category, path, year text, themes), with gaps."""
    words = F.split(F.col("source"), "[^A-Za-z0-9]+")
    return table(spark, sf_dir, "documents").select(
        F.col("doc_id").alias("item_id"),
        F.col("lang").alias("category"),
        F.when(F.col("n_chars") % 10 != 0, F.concat(F.lit("img/"), F.col("doc_id").cast("string")))
        .alias("img_path"),
        F.when(F.col("n_chars") % 7 == 0, "unknown")
        .otherwise((F.lit(1980) + F.col("n_chars") % 45).cast("string"))
        .alias("year_released"),
        F.when(F.col("n_chars") % 11 != 0, F.array_distinct(F.concat(words, F.array("lang")))).alias("themes"),
    )


def image_paths(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Listing of the files that exist (path)."""
    return table(spark, sf_dir, "labels").select(
        F.concat(F.lit("img/"), F.col("doc_id").cast("string")).alias("path")
    )


PROFILE_SQL = """
minifig AS (
  SELECT doc_id AS item_id, lang AS category,
         CASE WHEN n_chars % 10 <> 0 THEN 'img/' || CAST(doc_id AS VARCHAR) END AS img_path,
         CASE WHEN n_chars % 7 = 0 THEN 'unknown'
              ELSE CAST(1980 + n_chars % 45 AS VARCHAR) END AS year_released,
         CASE WHEN n_chars % 11 <> 0 THEN
           list_distinct(list_append(string_split_regex(source, '[^A-Za-z0-9]+'), lang)) END AS themes
  FROM documents),
paths AS (SELECT 'img/' || CAST(doc_id AS VARCHAR) AS path FROM labels)
"""


def predictions(spark: SparkSession, sf_dir: str) -> DataFrame:
    """A prediction set over the items (row_id, split, label, pred, probs), with logits kept.

    Eight classes; the logits are fixed-point arithmetic on the measures of the row, so any
    engine computes the same numbers.
    """
    lines = table(spark, sf_dir, "orders").select(
        F.col("o_orderkey").alias("row_id"),
        (F.floor(F.col("o_totalprice")) % 8).cast("int").alias("label"),
        F.floor(F.col("o_totalprice")).cast("bigint").alias("t"),
        F.col("o_custkey").alias("c"),
    )
    logit = lambda k: (
        ((F.col("t") * (k + 3) + F.col("c") * (2 * k + 1)) % 17) / F.lit(4.0)
        + F.when((F.col("label") == k) & (F.col("t") % 3 > 0), 3.0).otherwise(0.0)
    )
    split = (
        F.when(F.col("c") % 20 < 14, "train").when(F.col("c") % 20 < 17, "val").otherwise("test")
    )
    return lines.select(
        "row_id", split.alias("split"), "label", F.array(*[logit(k) for k in range(8)]).alias("logits")
    )


def _logit_sql(k: int) -> str:
    return (
        f"((t * {k + 3} + c * {2 * k + 1}) % 17) / 4.0"
        f" + CASE WHEN label = {k} AND t % 3 > 0 THEN 3.0 ELSE 0.0 END"
    )


PRED_SQL = f"""
scored AS (
  SELECT row_id, split, label, logits,
         CAST(list_position(logits, list_max(logits)) - 1 AS INT) AS pred
  FROM (SELECT row_id, label,
          CASE WHEN c % 20 < 14 THEN 'train' WHEN c % 20 < 17 THEN 'val' ELSE 'test' END AS split,
          [{", ".join(f"CAST({_logit_sql(k)} AS DOUBLE)" for k in range(8))}] AS logits
        FROM (SELECT o_orderkey AS row_id, o_custkey AS c,
                CAST(floor(o_totalprice) AS BIGINT) AS t,
                CAST(floor(o_totalprice) % 8 AS INT) AS label FROM orders)))
"""


def second_model(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Another model's predictions on the same items (row_id, split, label, pred)."""
    t = F.floor(F.col("o_totalprice"))
    c = F.col("o_custkey") % 20
    return table(spark, sf_dir, "orders").select(
        F.col("o_orderkey").alias("row_id"),
        F.when(c < 14, "train").when(c < 17, "val").otherwise("test").alias("split"),
        (t % 8).cast("int").alias("label"),
        F.when(t % 5 > 1, t % 8).otherwise((t + F.col("o_custkey")) % 7).cast("int").alias("pred"),
    )


PRED2_SQL = """
scored2 AS (
  SELECT o_orderkey AS row_id, CAST(floor(o_totalprice) % 8 AS INT) AS label,
         CASE WHEN o_custkey % 20 < 14 THEN 'train' WHEN o_custkey % 20 < 17 THEN 'val' ELSE 'test' END AS split,
         CAST(CASE WHEN floor(o_totalprice) % 5 > 1 THEN floor(o_totalprice) % 8
              ELSE (floor(o_totalprice) + o_custkey) % 7 END AS INT) AS pred FROM orders)
"""


def history(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Training-history rows: one curve per priority ("model"), one epoch per order month.

    The first twelve epochs are phase 1. Losses are monthly means of order prices, in millions.
    """
    month = F.months_between(F.trunc("d", "MM"), F.lit("1995-01-01").cast("date")).cast("int")
    price = F.col("o_totalprice").cast(MONEY)
    mean = lambda c: F.try_divide(F.sum(c).cast("double"), F.count(c)) / 1e6
    return (
        table(spark, sf_dir, "orders")
        .withColumn("d", F.col("o_orderdate").cast("date"))
        .groupBy(F.col("o_orderpriority").alias("model"), (month + 1).alias("epoch"))
        .agg(
            mean(F.when(F.col("o_orderstatus") == "O", price)).alias("train_loss"),
            mean(price).alias("val_loss"),
        )
        .where(F.col("train_loss").isNotNull())
        .withColumn("phase", F.when(F.col("epoch") <= 12, 1).otherwise(2))
    )


HISTORY_SQL = """
hist AS (
  SELECT *, CASE WHEN epoch <= 12 THEN 1 ELSE 2 END AS phase FROM (
    SELECT o_orderpriority AS model,
           CAST((year(o_orderdate) - 1995) * 12 + month(o_orderdate) AS INT) AS epoch,
           (CAST(sum(CASE WHEN o_orderstatus = 'O' THEN CAST(o_totalprice AS DECIMAL(18,4)) END) AS DOUBLE)
             / nullif(count(CASE WHEN o_orderstatus = 'O' THEN 1 END), 0)) / 1e6 AS train_loss,
           (CAST(sum(CAST(o_totalprice AS DECIMAL(18,4))) AS DOUBLE) / count(*)) / 1e6 AS val_loss
    FROM orders GROUP BY 1, 2) WHERE train_loss IS NOT NULL)
"""


def revenue_predictions(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Validation rows of three models (id, y, a, b, c): next-period revenue per customer."""
    past = (
        table(spark, sf_dir, "orders")
        .where(F.col("o_orderdate") < F.to_timestamp(F.lit(CUTOFF)))
        .groupBy(F.col("o_custkey").alias("cust_id"))
        .agg(
            F.sum(F.col("o_totalprice").cast(MONEY)).cast("double").alias("spent"),
            F.count(F.lit(1)).cast("double").alias("orders"),
            F.max(F.col("o_totalprice").cast(MONEY)).cast("double").alias("largest"),
        )
    )
    return revenue_labels(spark, sf_dir).join(past, "cust_id", "left").select(
        F.col("cust_id").alias("id"),
        F.col("revenue_label").alias("y"),
        F.coalesce(F.col("spent") / 8, F.lit(0.0)).alias("a"),
        F.coalesce(F.col("orders") * 25000, F.lit(0.0)).alias("b"),
        F.coalesce(F.col("largest") / 2, F.lit(0.0)).alias("c"),
        "part",
    )


REVPRED_SQL = f"""
revpred AS (
  SELECT l.cust_id AS id, revenue_label AS y, coalesce(spent / 8, 0.0) AS a,
         coalesce(n * 25000, 0.0) AS b, coalesce(largest / 2, 0.0) AS c, part
  FROM labels_clv l LEFT JOIN (
    SELECT o_custkey AS cust_id, CAST(sum(CAST(o_totalprice AS DECIMAL(18,4))) AS DOUBLE) AS spent,
           CAST(count(*) AS DOUBLE) AS n,
           CAST(max(CAST(o_totalprice AS DECIMAL(18,4))) AS DOUBLE) AS largest
    FROM orders WHERE o_orderdate < TIMESTAMP '{CUTOFF} 00:00:00' GROUP BY 1) p USING (cust_id))
"""
