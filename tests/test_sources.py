"""Readers and writers on files."""

import json
import os
from types import SimpleNamespace

import pytest
from pyspark.sql import datasource as ds
from pyspark.sql import functions as F

from tallyloom.session import new_path, shared_dir, written
from tallyloom.sources import keyed_table, readers, writers
from tallyloom.sources.headed_file import write_headed_csv
from tallyloom.sources.image_files import write_images
from tallyloom.sources.sqlite_files import condition, read_sqlite, write_sqlite


def test_json_array_and_lines(spark, tmp_path):
    records = [{"item_id": 1, "themes": ["a"], "extra": 1}, {"item_id": 2, "themes": None}]
    array, lines = tmp_path / "array.json", tmp_path / "lines.json"
    array.write_text(json.dumps(records, indent=1))
    lines.write_text("\n".join(json.dumps(r) for r in records))
    a = readers.read_records(spark, str(array), array_file=True).collect()
    b = readers.read_records(spark, str(lines)).collect()
    assert a == b and len(a) == 2 and a[0].category is None


def test_csv_round_trip_keeps_quotes_and_nulls(spark):
    df = spark.createDataFrame([(1, 'say "hi", now', 1.5), (2, None, None)], "id int, name string, v double")
    path = writers.write_csv(df, new_path(spark, "csv"), single_file=True)
    back = readers.read_csv(spark, path, "id int, name string, v double")
    assert sorted(back.collect()) == sorted(df.collect())


def test_bad_cells_become_null(spark, tmp_path):
    file = tmp_path / "x.csv"
    file.write_text("cust_id,day\n1,2000-01-01\nx,not a day\n")
    rows = readers.read_csv(spark, str(file), "cust_id bigint, day date").collect()
    assert rows[1].cust_id is None and rows[1].day is None


def test_submission_is_rounded(spark):
    df = spark.createDataFrame([(1, 0.123456)], "id int, p double")
    path = writers.write_submission(df, "id", "p", new_path(spark, "sub"))
    assert spark.read.text(path).orderBy(F.desc("value")).first().value == "id,p"
    assert readers.read_csv(spark, path, "id int, p double").first().p == 0.1235


def test_one_headed_file_whatever_the_partitions(spark):
    rows = [(i, f'n{i % 7}, "q"' if i % 3 else None, i / 4, "" if i % 2 else "é") for i in range(500)]
    df = spark.createDataFrame(rows, "id int, `a name` string, v double, t string").coalesce(1)
    made = set()
    for n in (1, 50):
        path = write_headed_csv(df.repartitionByRange(n, "id").sortWithinPartitions("id"), new_path(spark, "one") + ".csv")
        made.add(open(path, "rb").read())
        back = readers.read_csv(spark, path, "id int, `a name` string, v double, t string")
        assert sorted(back.select("id", "v").collect()) == sorted(df.select("id", "v").collect())
        assert back.where("id = 1").first()["a name"] == 'n1, "q"' and back.where("id = 0").first()["a name"] is None
    body = made.pop().decode()
    assert not made and body.startswith("id,a name,v,t\n0,") and body.count("\n") == 501
    empty = write_headed_csv(df.limit(0), new_path(spark, "none") + ".csv")
    assert open(empty).read() == "id,a name,v,t\n"


def test_a_failed_export_leaves_no_file(spark):
    path = new_path(spark, "failed") + ".csv"
    broken = spark.range(100, numPartitions=4).select(F.when(F.col("id") == 99, F.raise_error(F.lit("cut off"))).otherwise(F.col("id")).alias("id"))
    with pytest.raises(Exception):
        write_headed_csv(broken, path)
    assert not os.path.exists(path)


def test_database_files_are_read_in_ranges_with_filters(spark):
    rows = [(i, f"name {i}" if i % 5 else None, i / 2) for i in range(1000)]
    df = spark.createDataFrame(rows, "key bigint, name string, price double").repartition(3)
    folder = write_sqlite(df, new_path(spark, "db"), "games")
    got = read_sqlite(spark, folder, "games", "key bigint, name string, price double", rows_per_partition=100)
    assert got.rdd.getNumPartitions() >= 10 and sorted(got.collect()) == sorted(df.collect())
    assert got.where("name is null").count() == 200 and got.where("key in (3, 4, 2000)").count() == 2
    assert sorted(r.key for r in got.where("price >= 499 and name = 'name 998'").collect()) == [998]
    assert read_sqlite(spark, folder, "games", "price double").where("price < 1").count() == 2
    empty = write_sqlite(df.limit(0), new_path(spark, "db"), "games")
    assert read_sqlite(spark, empty, "games", "key bigint").count() == 0


def test_filters_that_a_statement_can_take():
    terms, values, rest = condition([ds.GreaterThan(("a",), 3), ds.In(("b",), ("x", "y")), ds.IsNotNull(("c",)), ds.StringContains(("d",), "e"), ds.EqualTo(("f", "g"), 1)])
    assert terms == ['"a" > ?', '"b" IN (?, ?)', '"c" IS NOT NULL'] and values == [3, "x", "y"] and len(rest) == 2


KEYED = "id string, version bigint, doc string"


def keyed(spark, root):
    return {r.id: (r.version, r.doc) for r in keyed_table.read(spark, root, KEYED).collect()}


def test_merge_rewrites_only_the_buckets_of_its_keys(spark):
    base = spark.range(2000).select(F.col("id").cast("string"), F.lit(1).cast("bigint").alias("version"), F.lit("old").alias("doc"))
    root = keyed_table.create(base, new_path(spark, "table"), "id", "version", buckets=40)
    before = {r.bucket: r.path for r in keyed_table.manifest(spark, root).where("path is not null").collect()}
    hit = base.where(F.pmod(F.xxhash64("id"), F.lit(40)) == 7).limit(20).withColumns({"version": F.lit(2).cast("bigint"), "doc": F.lit("new")})
    made = keyed_table.merge(root, hit).collect()
    after = {r.bucket: r.path for r in keyed_table.manifest(spark, root).where("path is not null").collect()}
    assert [r.bucket for r in made] == [7] and {b for b in before if before[b] != after[b]} == {7} and len(before) == 40
    rows = keyed(spark, root)
    assert len(rows) == 2000 and sum(v == (2, "new") for v in rows.values()) == 20
    assert keyed_table.merge(root, hit.limit(0)).count() == 0 and keyed(spark, root) == rows


def test_merges_keep_the_latest_of_every_key(spark):
    want, root = {}, None
    for turn in range(7):
        batch = [(f"k{(i * 7 + turn * 13) % 90}", (i * 5 + turn) % 11, f"{turn}-{i}") for i in range(25)]
        best = {}
        for k, v, d in batch:
            if k not in best or v > best[k][0]:
                best[k] = (v, d)
        df = spark.createDataFrame([(k, v, d) for k, (v, d) in best.items()] + [(None, 1, "no key")], KEYED)
        if root is None:
            root = keyed_table.create(df, new_path(spark, "table"), "id", "version", buckets=3)
        else:
            keyed_table.merge(root, df)
        for k, row in best.items():
            if k not in want or row[0] >= want[k][0]:
                want[k] = row
        assert keyed(spark, root) == want
    paths = keyed_table.manifest(spark, root).where("path is not null").groupBy("bucket").count().agg(F.max("count")).first()[0]
    assert paths <= keyed_table.SEGMENTS + 1


def test_two_batches_cannot_take_one_number(spark):
    df = spark.createDataFrame([("a", 1, "x")], KEYED)
    root = keyed_table.create(df, new_path(spark, "table"), "id", "version", buckets=2)
    keyed_table.merge(root, df)
    with pytest.raises(Exception):
        keyed_table._swap(keyed_table.manifest(spark, root).limit(0), root, 1, 2, "id", "version")
    empty = keyed_table.create(df.limit(0), new_path(spark, "table"), "id", "version")
    assert keyed(spark, empty) == {}
    keyed_table.merge(empty, df)
    assert keyed(spark, empty) == {"a": (1, "x")}
    with pytest.raises(ValueError):
        keyed_table.read(spark, new_path(spark, "nothing"), KEYED)


def test_upsert_latest_wins(spark):
    schema = "id string, version bigint, doc string"
    base = spark.createDataFrame([("a", 1, "old"), ("b", 1, "keep"), ("c", 5, "newer")], schema)
    new = spark.createDataFrame([("a", 2, "new"), ("d", 1, "add"), ("c", 3, "stale"), ("b", 1, "same version")], schema)
    out = {r.id: r.doc for r in writers.upsert(base, new, "id", "version").collect()}
    assert out == {"a": "new", "b": "same version", "c": "newer", "d": "add"}


def test_image_files(spark):
    rows = [(1, (2, 3, 1, 0, bytes(range(6)))), (2, (1, 2, 4, 24, bytes([1, 2, 3, 255, 4, 5, 6, 255]))), (3, (-1, -1, -1, -1, None))]
    df = spark.createDataFrame(rows, "k int, image struct<height:int,width:int,nChannels:int,mode:int,data:binary>")
    folder = write_images(df, "k", new_path(spark, "img"))
    out = {r.o.rsplit("/", 1)[1]: r for r in readers.read_images(spark, folder).select(
        F.col("image.origin").alias("o"), "image.width", "image.height", "image.mode", "image.data").collect()}
    assert (out["1.png"].width, out["1.png"].height, bytes(out["1.png"].data)) == (3, 2, bytes(range(6)))
    assert bytes(out["2.png"].data) == bytes([1, 2, 3, 255, 4, 5, 6, 255])
    assert out["3.png"].width == -1
    assert readers.file_listing(spark, folder).count() == 3


def test_written_table_keeps_schema(spark):
    df = spark.createDataFrame([(1, "a")], "id int, s string")
    assert written(df, "t").schema.simpleString() == df.schema.simpleString()


def test_shared_folder_comes_from_the_session():
    cluster = SimpleNamespace(conf={"spark.checkpoint.dir": "hdfs://shared/work/"})
    assert shared_dir(cluster) == "hdfs://shared/work"


def test_cluster_without_shared_folder_is_refused():
    for master in ("yarn", "local-cluster[2,1,1024]"):
        with pytest.raises(RuntimeError):
            shared_dir(SimpleNamespace(conf={}, sparkContext=SimpleNamespace(master=master)))


def test_capped_read(spark):
    assert [r.id for r in readers.read_capped(spark.range(10).repartition(4), "id", 3).collect()] == [0, 1, 2]


@pytest.mark.parametrize("seed", [1])
def test_new_paths_never_repeat(spark, seed):
    assert new_path(spark, "x") != new_path(spark, "x")
