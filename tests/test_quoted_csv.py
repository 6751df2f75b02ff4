"""Quoted multi-line CSV read by byte ranges, against a reader of whole files."""

import csv
import io
import random

import pytest
from pyspark.sql import functions as F

from newspulse.sources import files, quoted_csv

SIZE = "spark.sql.files.maxPartitionBytes"


@pytest.fixture
def ranges(spark):
    """Sets the size of byte ranges for a test."""
    before, cost = spark.conf.get(SIZE), spark.conf.get("spark.sql.files.openCostInBytes")

    def use(size):
        spark.conf.set(SIZE, size)
        spark.conf.set("spark.sql.files.openCostInBytes", "0")

    yield use
    spark.conf.set(SIZE, before)
    spark.conf.set("spark.sql.files.openCostInBytes", cost)


def written(path, rows, header=("title", "content", "url"), ends="\n", start=""):
    text = io.StringIO(newline="")
    out = csv.writer(text, lineterminator=ends)
    out.writerow(header)
    out.writerows(rows)
    path.parent.mkdir(parents=True, exist_ok=True)
    path.write_bytes((start + text.getvalue()).encode())


def read(spark, path):
    got = files.read_csv_table(spark, str(path), "title string, content string, url string")
    return sorted(tuple("" if v is None else v for v in r) for r in got.collect())


def field(rng):
    return "".join(rng.choice(['"', '""', ",", "\n", "\n\n", "a", "bc", "가", "😀", " ", "é"]) for _ in range(rng.randint(0, 12)))


@pytest.mark.parametrize("size", [2, 3, 7, 64, 1 << 20])
def test_any_cut_gives_the_same_records(spark, ranges, tmp_path, size):
    rng = random.Random(size)
    rows = [(field(rng), field(rng), f"u{k}") for k in range(2 if size < 7 else 8 if size == 7 else 60)]
    written(tmp_path / "a" / "one.csv", rows)
    ranges(size)
    assert read(spark, tmp_path / "a") == sorted(rows)


def test_many_files_bom_and_crlf(spark, ranges, tmp_path):
    parts = {k: [(f"t{k}", f'say "{k}",\n{k}', f"u{k}{j}") for j in range(40)] for k in range(4)}
    written(tmp_path / "b" / "0.csv", parts[0], start="﻿")
    written(tmp_path / "b" / "1.csv", parts[1], ends="\r\n")
    written(tmp_path / "b" / "2.csv", parts[2], start="\n\n")
    written(tmp_path / "b" / "3.csv", [])
    ranges(50)
    assert read(spark, tmp_path / "b") == sorted(parts[0] + parts[1] + parts[2])


def test_header_over_several_ranges_and_a_field_over_many(spark, ranges, tmp_path):
    path = tmp_path / "c" / "x.csv"
    written(path, [("t", "line\n" * 60, "u"), ("last", "", "v")], header=("title", "content", "url", "a\nheader\nof lines"))
    ranges(16)
    lines = quoted_csv._lines(spark, str(path.parent))
    assert lines.rdd.getNumPartitions() > 15
    assert read(spark, path.parent) == sorted([("t", "line\n" * 60, "u"), ("last", "", "v")])


def test_stray_quotes_and_an_open_end(spark, ranges, tmp_path):
    path = tmp_path / "d" / "x.csv"
    path.parent.mkdir()
    path.write_text('title,content,url\nfive 5" screen,b,u1\n"a""b",c"d"e,u2\n"open\nto the end,\n')
    ranges(9)
    got = quoted_csv.read_records(spark, str(path.parent))
    assert sorted((r.record, r.header) for r in got.collect()) == sorted(
        [("title,content,url", True), ('five 5" screen,b,u1', False), ('"a""b",c"d"e,u2', False), ('"open\nto the end,', False)])


@pytest.mark.parametrize("line,inside,after", [
    ("", False, False), ("", True, True), ('a,"b', False, True), ('b",c', True, False), ('""', True, True), ('"",""', False, False),
    ('a"b', False, False), ('"a""', False, True), ('x"', True, False), ('x"","y', True, False), ('","', False, False), ('","', True, True),
    ('x" tail " ,"', True, True), (',,"', False, True)])
def test_state_at_the_end_of_a_line(line, inside, after):
    assert quoted_csv.ends_inside(line, inside) is after


def test_one_large_file_is_read_by_several_tasks(spark, ranges, tmp_path):
    path = tmp_path / "e" / "large.csv"
    rng = random.Random(1)
    words = ["alpha", "beta\n", '"gamma"', "델타,", "epsilon"]
    rows = [(f"t{k}", " ".join(rng.choices(words, k=600)), f"u{k}") for k in range(18_000)]
    written(path, rows)
    assert path.stat().st_size > 64 << 20
    ranges(8 << 20)
    got = files.read_csv_table(spark, str(path.parent), "title string, content string, url string").cache()
    sizes = got.select(F.spark_partition_id().alias("p")).groupBy("p").count().collect()
    assert len([r for r in sizes if r["count"] > 1_000]) >= 8
    want = spark.createDataFrame(rows[::100], "title string, content string, url string")
    assert got.count() == len(rows) and want.exceptAll(got).isEmpty()
    got.unpersist()
