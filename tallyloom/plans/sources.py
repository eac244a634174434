"""Queries of the source and sink family: data goes out to the shared folder and comes back."""

from __future__ import annotations

from pyspark.sql import functions as F

from tallyloom.operators.graph import top
from tallyloom.plans.evaluation import classification_report
from tallyloom.plans.graph import PROFILE, profile
from tallyloom.plans.registry import query, with_sql
from tallyloom.session import new_path
from tallyloom.sources import bindings as b
from tallyloom.sources import keyed_table, readers, writers
from tallyloom.sources.bindings import GRAPH_SQL, IMAGE_SQL, PROFILE_SQL, REVPRED_SQL, RETRIEVAL_SQL, TX_SQL
from tallyloom.sources.headed_file import write_headed_csv
from tallyloom.sources.image_files import write_images
from tallyloom.sources.sqlite_files import read_sqlite, write_sqlite
from tallyloom.plans.registry import ORACLES


@query("scan_transactions_csv", with_sql(TX_SQL, select="""
SELECT cust_id, sale_id, prod_id, order_date, pack_date, CAST(sale_revenue AS DOUBLE) AS sale_revenue,
       CAST(sale_discount AS DOUBLE) AS sale_discount, returned_to, web_only FROM lines"""))
def _(spark, sf):
    path = writers.write_csv(b.order_lines(spark, sf), new_path(spark, "transactions"))
    rows = readers.read_csv(spark, path, readers.TRANSACTION_SCHEMA)
    return rows.withColumns({c: F.col(c).cast("double") for c in ("sale_revenue", "sale_discount")})


@query("scan_labels_csv", with_sql(TX_SQL, select="""
SELECT cust_id, CASE WHEN part = 'train' THEN revenue_label END AS revenue_label, part FROM labels_clv"""))
def _(spark, sf):
    """Two files: training rows with the label, test rows with the id only."""
    labels = b.revenue_labels(spark, sf)
    train, test = new_path(spark, "train"), new_path(spark, "test")
    writers.write_csv(labels.where(F.col("part") == "train").select("cust_id", "revenue_label"), train)
    writers.write_csv(labels.where(F.col("part") == "test").select("cust_id"), test)
    read_train = readers.read_csv(spark, train, readers.LABEL_SCHEMA).withColumn("part", F.lit("train"))
    read_test = readers.read_csv(spark, test, readers.TEST_SCHEMA).withColumn("part", F.lit("test"))
    return read_train.unionByName(read_test, allowMissingColumns=True)


@query("scan_json_records", with_sql(PROFILE_SQL, select="""
SELECT item_id, category, img_path, year_released, len(themes) AS n_themes, list_sort(themes)[1] AS first_theme FROM minifig"""))
def _(spark, sf):
    path = writers.write_report(b.minifigs(spark, sf), new_path(spark, "records"))
    rows = readers.read_records(spark, path)
    return rows.select(
        "item_id", "category", "img_path", "year_released",
        F.when(F.col("themes").isNotNull(), F.size("themes").cast("bigint")).alias("n_themes"),
        F.get(F.sort_array("themes"), F.lit(0)).alias("first_theme"),
    )


@query("scan_image_files", with_sql(IMAGE_SQL, select="""
SELECT vec_id, CAST(width AS INT) AS width, CAST(height AS INT) AS height, CAST(mode AS INT) AS mode,
       CASE WHEN width > 0 THEN list_reduce(list_transform(px, lambda x: printf('%02X', x)), lambda a, x: a || x) END AS pixels FROM img"""))
def _(spark, sf):
    folder = write_images(b.images(spark, sf), "vec_id", new_path(spark, "images"))
    i = F.col("image")
    return readers.read_images(spark, folder).select(
        F.regexp_extract(i["origin"], r"(\d+)\.png$", 1).cast("bigint").alias("vec_id"),
        i["width"].alias("width"), i["height"].alias("height"), i["mode"].alias("mode"),
        F.when(i["width"] > 0, F.hex(i["data"])).alias("pixels"),
    )


@query("scan_games_limited", with_sql(RETRIEVAL_SQL, select="""
SELECT app_id, name, short_description, price FROM games ORDER BY CAST(app_id AS BIGINT) LIMIT 5000"""))
def _(spark, sf):
    """The catalogue as embedded database files, one per task, and the first records of it read back."""
    rows = b.games(spark, sf).select(F.col("app_id").cast("bigint").alias("key"), "app_id", "name", "short_description", "price")
    folder = write_sqlite(rows, new_path(spark, "catalogue"), "games")
    schema = ", ".join(f"{f.name} {f.dataType.simpleString()}" for f in rows.schema)
    games = read_sqlite(spark, folder, "games", schema).where("key is not null")
    return readers.read_capped(games, "key", 5000).select("app_id", "name", "short_description", "price")


@query("sink_csv_with_header", with_sql(GRAPH_SQL, select=PROFILE + " LIMIT 100"))
def _(spark, sf):
    table = top(profile(spark, sf), "total_interactions", ["alter"], 100)
    path = write_headed_csv(table, new_path(spark, "interactions") + ".csv")
    return readers.read_csv(spark, path, ", ".join(f"{f.name} {f.dataType.simpleString()}" for f in table.schema))


@query("interaction_profile_export", with_sql(GRAPH_SQL, select=PROFILE + " LIMIT 500"))
def _(spark, sf):
    table = top(profile(spark, sf), "total_interactions", ["alter"], 500)
    path = write_headed_csv(table, new_path(spark, "interactions") + ".csv")
    return readers.read_csv(spark, path, ", ".join(f"{f.name} {f.dataType.simpleString()}" for f in table.schema))


@query("sink_submission_csv", with_sql(TX_SQL, REVPRED_SQL, select="""
SELECT id, round(c, 4) AS c FROM revpred WHERE part = 'test'"""))
def _(spark, sf):
    test = b.revenue_predictions(spark, sf).where(F.col("part") == "test")
    path = writers.write_submission(test, "id", "c", new_path(spark, "submission"))
    return readers.read_csv(spark, path, "id bigint, c double")


@query("sink_report_json", ORACLES["classification_report"])
def _(spark, sf):
    report = classification_report(spark, sf)
    path = writers.write_report(report, new_path(spark, "report"))
    return readers.read_records(spark, path, "class string, precision double, recall double, f1 double, support bigint")


@query("upsert_by_id", """
WITH base AS (SELECT CAST(vec_id AS VARCHAR) AS id, CAST(1 AS BIGINT) AS version, label, embedding[1] AS head FROM embeddings),
newer AS (SELECT CAST(vec_id * 2 AS VARCHAR) AS id, vec_id + 2 AS version, label + 100 AS label, embedding[2] AS head FROM embeddings)
SELECT id, max(version) AS version, arg_max(label, version) AS label, arg_max(head, version) AS head
FROM (SELECT * FROM base UNION ALL SELECT * FROM newer) GROUP BY id""")
def _(spark, sf):
    """Every second id is replaced by a newer row; ids past the end are inserted."""
    rows = b.table(spark, sf, "embeddings")
    base = rows.select(
        F.col("vec_id").cast("string").alias("id"), F.lit(1).cast("bigint").alias("version"), "label",
        F.get("embedding", F.lit(0)).alias("head"),
    )
    newer = rows.select(
        (F.col("vec_id") * 2).cast("string").alias("id"), (F.col("vec_id") + 2).alias("version"),
        (F.col("label") + 100).alias("label"), F.get("embedding", F.lit(1)).alias("head"),
    )
    root = keyed_table.create(base, new_path(spark, "keyed"), "id", "version", buckets=16)
    keyed_table.merge(root, newer)
    return keyed_table.read(spark, root, base.schema)
