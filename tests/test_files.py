"""Regression cases of file sources."""

import os

import pytest

from sievekit.sources import files


def test_positional_zip_follows_rolled_files(spark, tmp_path):
    df = spark.range(0, 1000, numPartitions=3)
    df.write.option("maxRecordsPerFile", 100).parquet(str(tmp_path / "a"))
    df.selectExpr("id * 10 as x").write.option("maxRecordsPerFile", 70).parquet(str(tmp_path / "b"))
    a, b = spark.read.parquet(str(tmp_path / "a")), spark.read.parquet(str(tmp_path / "b"))
    rows = files.zip_by_position(a, b).collect()
    assert len(rows) == 1000 and all(r["x"] == 10 * r["id"] for r in rows)
    spark.range(0, 999, numPartitions=3).write.parquet(str(tmp_path / "c"))
    with pytest.raises(ValueError):
        files.zip_by_position(a, spark.read.parquet(str(tmp_path / "c")))


def test_file_number_is_not_read_from_the_uuid(spark, tmp_path):
    spark.range(0, 300, numPartitions=1).write.option("maxRecordsPerFile", 100).parquet(str(tmp_path / "a"))
    os.makedirs(tmp_path / "b")
    for k, f in enumerate(sorted(x for x in os.listdir(tmp_path / "a") if x.startswith("part"))):
        name = f"part-00000-1e64ad0c-c123-4aaa-8aaa-0123456789ab-c{k:03d}.snappy.parquet"
        (tmp_path / "b" / name).write_bytes((tmp_path / "a" / f).read_bytes())
    rows = files.with_input_ordinal(spark.read.parquet(str(tmp_path / "b"))).collect()
    assert len(rows) == 300 and all(r["ordinal"]["row"] == r["id"] for r in rows)


def test_records_keep_latin_1_and_values_that_end_in_slashes(spark, tmp_path):
    os.makedirs(tmp_path / "r")
    (tmp_path / "r" / "x.dat").write_bytes("NAME - café\nURL - http://\nSIZE - 3\n//\nNAME - b\n//\n".encode("latin-1"))
    got = sorted((r["attrs"] for r in files.read_records(spark, str(tmp_path / "r")).collect()), key=len)
    assert got == [{"NAME": ["b"]}, {"NAME": ["café"], "URL": ["http://"], "SIZE": ["3"]}]


def test_html_items_with_attributes_and_line_breaks(spark):
    df = spark.createDataFrame([("<ul><li>a</li><li class='x'>b</li><LI>c\nd</LI></ul>",)], "html string")
    assert df.select(files.html_list_items(df["html"]).alias("i")).first()["i"] == ["a", "b", "c\nd"]
