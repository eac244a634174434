"""Queries of the dataset-profiling family."""

from __future__ import annotations

from pyspark.sql import functions as F

from tallyloom.operators import profiling as pr
from tallyloom.operators import sampling as sa
from tallyloom.plans.registry import ORACLES, query, with_sql
from tallyloom.session import new_path
from tallyloom.sources import bindings as b
from tallyloom.sources.bindings import IMAGE_SQL, PROFILE_SQL

MIN_SAMPLES = 110
CATEGORY = "category"


def _sql(select: str, *extra: str) -> str:
    return with_sql(PROFILE_SQL, *extra, select=select)


def key_sql(row_id: str, seed: int) -> str:
    """SQL of the arithmetic shuffle key."""
    return f"((({row_id} % {sa.PRIME} + {seed}) * {sa.STEP} + {seed} * {sa.SHIFT}) % {sa.PRIME})"


COUNTS_SQL = """
counts AS (SELECT category, count(*) AS n FROM minifig WHERE category IS NOT NULL GROUP BY 1)
"""


@query("filter_not_null", _sql("SELECT item_id, category, img_path FROM minifig WHERE img_path IS NOT NULL"))
def _(spark, sf):
    return pr.present(b.minifigs(spark, sf).select("item_id", "category", "img_path"), "img_path")


@query("file_exists_semi", _sql("""
SELECT item_id, img_path, img_path IS NOT NULL AND img_path IN (SELECT path FROM paths) AS found FROM minifig"""))
def _(spark, sf):
    """Kept and missing items, told apart by ``found``."""
    items, listing = b.minifigs(spark, sf).select("item_id", "img_path"), b.image_paths(spark, sf)
    kept = pr.file_exists(items, "img_path", listing).withColumn("found", F.lit(True))
    return kept.unionByName(pr.file_missing(items, "img_path", listing).withColumn("found", F.lit(False)))


@query("category_semi", _sql(f"""
SELECT item_id, category FROM minifig WHERE category IN (SELECT category FROM counts WHERE n >= {MIN_SAMPLES})""", COUNTS_SQL))
def _(spark, sf):
    return pr.frequent_only(b.minifigs(spark, sf).select("item_id", CATEGORY), CATEGORY, MIN_SAMPLES)


@query("category_distribution", _sql("""
SELECT category, n, (SELECT max(n) / min(n) FROM counts) AS imbalance FROM counts""", COUNTS_SQL))
def _(spark, sf):
    return pr.category_distribution(b.minifigs(spark, sf), CATEGORY).orderBy(F.desc("n"), CATEGORY)


@query("kept_dropped_summary", _sql(f"""
SELECT count(*) FILTER (n >= {MIN_SAMPLES}) AS categories_kept, count(*) FILTER (n < {MIN_SAMPLES}) AS categories_dropped,
       CAST(coalesce(sum(n) FILTER (n >= {MIN_SAMPLES}), 0) AS BIGINT) AS rows_kept,
       CAST(coalesce(sum(n) FILTER (n < {MIN_SAMPLES}), 0) AS BIGINT) AS rows_dropped,
       max(n) FILTER (n >= {MIN_SAMPLES}) / min(n) FILTER (n >= {MIN_SAMPLES}) AS kept_imbalance,
       arg_min(category, (-n, category)) AS largest, arg_min(category, (n, category)) AS smallest FROM counts""", COUNTS_SQL))
def _(spark, sf):
    items = b.minifigs(spark, sf)
    balance = pr.balance_summary(items, CATEGORY)
    return pr.kept_dropped(items, CATEGORY, MIN_SAMPLES).withColumns(
        {c: balance.select(c).scalar() for c in ("largest", "smallest")}
    )


@query("missing_value_profile", _sql("""
SELECT * FROM (
  SELECT 'img_path' AS "column", count(*) - count(img_path) AS missing,
         round((count(*) - count(img_path)) * 100.0::DOUBLE / count(*), 1) AS pct FROM minifig
  UNION ALL SELECT 'themes', count(*) - count(themes), round((count(*) - count(themes)) * 100.0::DOUBLE / count(*), 1) FROM minifig
  UNION ALL SELECT 'category', count(*) - count(category), round((count(*) - count(category)) * 100.0::DOUBLE / count(*), 1) FROM minifig)
WHERE missing > 0"""))
def _(spark, sf):
    return pr.missing_profile(b.minifigs(spark, sf))


@query("written_value_profile", ORACLES["missing_value_profile"])
def _(spark, sf):
    """The same of a table that is written anyway: the scan that writes it is the only one."""
    profile, _ = pr.written_profile(b.minifigs(spark, sf), new_path(spark, "records"))
    return profile


@query("year_histogram", _sql("""
SELECT CAST(TRY_CAST(year_released AS DOUBLE) AS INT) AS year, count(*) AS n FROM minifig
WHERE TRY_CAST(year_released AS DOUBLE) IS NOT NULL GROUP BY 1"""))
def _(spark, sf):
    return pr.year_histogram(b.minifigs(spark, sf), "year_released").orderBy("year")


@query("mean_year_by_category", _sql(f"""
SELECT category, avg(CAST(TRY_CAST(year_released AS DOUBLE) AS INT)) AS mean_year FROM minifig
WHERE category IN (SELECT category FROM counts WHERE n >= {MIN_SAMPLES}) GROUP BY 1""", COUNTS_SQL))
def _(spark, sf):
    out = pr.mean_year(b.minifigs(spark, sf), CATEGORY, "year_released", MIN_SAMPLES)
    return out.orderBy("mean_year", CATEGORY)


@query("themes_per_item_histogram", _sql("""
SELECT CAST(coalesce(len(themes), 0) AS INT) AS length, count(*) AS n FROM minifig GROUP BY 1"""))
def _(spark, sf):
    return pr.list_length_histogram(b.minifigs(spark, sf), "themes")


@query("top_themes", _sql("""
SELECT element, count(*) AS n FROM (SELECT unnest(themes) AS element FROM minifig) GROUP BY 1
ORDER BY n DESC, element LIMIT 15"""))
def _(spark, sf):
    return pr.top_elements(b.minifigs(spark, sf), "themes", 15)


@query("size_histogram", with_sql("""
span AS (SELECT CAST(min(n_chars) AS DOUBLE) AS a, CAST(max(n_chars) AS DOUBLE) AS z FROM documents),
binned AS (
  SELECT CAST(least(floor((n_chars - a) * 30 / (z - a)) + 1, 30) AS INT) AS bin, count(*) AS n
  FROM documents, span GROUP BY 1)
""", select="""
SELECT CAST(i AS INT) AS bin, a + (i - 1) * ((z - a) / 30) AS lo, a + i * ((z - a) / 30) AS hi, coalesce(n, 0) AS n
FROM range(1, 31) r(i), span LEFT JOIN binned ON bin = i"""))
def _(spark, sf):
    return pr.histogram(b.table(spark, sf, "documents").select("n_chars"), "n_chars", 30)


@query("label_encode", _sql("""
SELECT category, CAST(row_number() OVER (ORDER BY category) - 1 AS INT) AS label FROM counts""", COUNTS_SQL))
def _(spark, sf):
    return pr.label_encode(b.minifigs(spark, sf), CATEGORY)


# --- images -----------------------------------------------------------------------------------


@query("image_profile", with_sql(IMAGE_SQL, select="""
SELECT count(*) AS files, count(*) FILTER (width < 0) AS corrupt,
       CAST(min(width) FILTER (width > 0) AS INT) AS min_width, CAST(max(width) FILTER (width > 0) AS INT) AS max_width,
       avg(width) FILTER (width > 0) AS mean_width,
       CAST(min(height) FILTER (width > 0) AS INT) AS min_height, CAST(max(height) FILTER (width > 0) AS INT) AS max_height,
       avg(height) FILTER (width > 0) AS mean_height,
       count(*) FILTER (mode = 0) AS mode_l, count(*) FILTER (mode = 16) AS mode_rgb, count(*) FILTER (mode = 24) AS mode_rgba
FROM img"""))
def _(spark, sf):
    return pr.image_profile(b.images(spark, sf))


MEANS_SQL = f"""
rgb AS (
  SELECT vec_id, category, {key_sql('vec_id', 42)} AS k,
         CASE WHEN mode = 0 THEN list_avg(px) ELSE list_avg(px[3:-:4]) END AS red,
         CASE WHEN mode = 0 THEN list_avg(px) ELSE list_avg(px[2:-:4]) END AS green,
         CASE WHEN mode = 0 THEN list_avg(px) ELSE list_avg(px[1:-:4]) END AS blue, mode
  FROM img WHERE width > 0),
gray AS (
  SELECT *, CASE WHEN mode = 0 THEN red ELSE 0.299 * red + 0.587 * green + 0.114 * blue END AS gray FROM rgb)
"""


@query("brightness_by_category", with_sql(IMAGE_SQL, MEANS_SQL, select="""
SELECT category, count(*) AS images, round(avg(gray), 6) AS brightness FROM (
  SELECT * FROM gray QUALIFY row_number() OVER (PARTITION BY category ORDER BY k, vec_id) <= 20) GROUP BY 1"""))
def _(spark, sf):
    readable = b.images(spark, sf).where(F.col("image.width") > 0)
    sampled = sa.sample_per_group(readable, CATEGORY, "vec_id", 20, sa.arithmetic("vec_id", 42))
    return pr.brightness_by_category(sampled).withColumn("brightness", F.round("brightness", 6))


@query("channel_mean_std", with_sql(IMAGE_SQL, MEANS_SQL, """
s AS (SELECT * FROM gray ORDER BY k, vec_id LIMIT 200)""", select="""
SELECT 'red' AS channel, round(avg(red / 255), 6) AS mean, round(stddev_pop(red / 255), 6) AS std FROM s
UNION ALL SELECT 'green', round(avg(green / 255), 6), round(stddev_pop(green / 255), 6) FROM s
UNION ALL SELECT 'blue', round(avg(blue / 255), 6), round(stddev_pop(blue / 255), 6) FROM s"""))
def _(spark, sf):
    readable = b.images(spark, sf).where(F.col("image.width") > 0)
    sampled = sa.sample_total(readable, "vec_id", 200, sa.arithmetic("vec_id", 42))
    return pr.channel_mean_std(sampled).withColumns({c: F.round(c, 6) for c in ("mean", "std")})
