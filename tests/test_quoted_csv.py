"""The splittable reader equals Spark's multi-line reader, with records that
span lines and splits."""

import csv
import os
import random

import pytest
from pyspark.sql import functions as F

from modspark.sources import quoted_csv as qc

COLS = ["id", "comment_text", "toxic", "note"]


def texts():
    rng = random.Random(8)
    bits = ["plain", 'say ""hi""'.replace('""', '"'), "two\nlines", "a,b", "", None, "\n\n", "quote at end\"", "tabs\t", "é中文", "x" * 300, "line\n" * 40, "\"", "\"\"", " lead", "\r\nwin\r\n"]
    return [(str(k), rng.choice(bits), str(k % 2), rng.choice(bits)) for k in range(400)]


def write(path, rows, end="\n", header=True, bom=False):
    def field(v):
        if v is None:
            return ""
        return '"' + v.replace('"', '""') + '"' if v == "" or any(c in v for c in ',"\n\r') or v != v.strip() else v

    with open(path, "w", encoding="utf-8", newline="") as f:
        f.write("\ufeff" if bom else "")
        for r in ([COLS] if header else []) + rows:
            f.write(",".join(map(field, r)) + end)


@pytest.fixture()
def small_splits(spark):
    before = {k: spark.conf.get(k) for k in ("spark.sql.files.maxPartitionBytes", "spark.sql.files.openCostInBytes")}
    spark.conf.set("spark.sql.files.maxPartitionBytes", "700")
    spark.conf.set("spark.sql.files.openCostInBytes", "1")
    yield
    for k, v in before.items():
        spark.conf.set(k, v)


def multiline(spark, path):
    return spark.read.option("header", True).option("multiLine", True).option("escape", '"').schema(", ".join(f"{c} string" for c in COLS)).csv(path)


def test_equals_the_multi_line_reader(spark, tmpdir_fresh, small_splits):
    path = os.path.join(tmpdir_fresh, "a.csv")
    rows = texts()
    write(path, rows)
    got = qc.read_quoted_csv(spark, path, COLS)
    assert got.rdd.getNumPartitions() > 20
    rows_got = sorted(map(tuple, got.collect()), key=lambda r: int(r[0]))
    rows = [tuple(v or None for v in r) for r in rows]
    assert rows_got == rows
    # Spark's parser rewrites line breaks within fields to \n; otherwise the same
    same = [tuple(v.replace("\r\n", "\n") if v else v for v in r) for r in rows_got]
    assert same == sorted((tuple(v.replace("\r\n", "\n") if v else v for v in r) for r in multiline(spark, path).collect()), key=lambda r: int(r[0]))
    # most splits begin within a record
    assert len(qc._odd_splits(qc._lines(spark, path))) > 10


def test_several_files_windows_ends_and_ragged_records(spark, tmpdir_fresh, small_splits):
    rows = texts()
    write(os.path.join(tmpdir_fresh, "a.csv"), rows[:150], "\r\n", bom=True)
    write(os.path.join(tmpdir_fresh, "b.csv"), rows[150:] + [("400",), ("401", "x", "1", "y", "more"), ()])
    got = {tuple(r) for r in qc.read_quoted_csv(spark, tmpdir_fresh, COLS).collect()}
    assert got == {tuple(v or None for v in r) for r in rows} | {("400", None, None, None), ("401", "x", "1", "y")}


def test_one_record_over_many_splits_and_empty(spark, tmpdir_fresh, small_splits):
    long = "line of a long text\n" * 500
    write(os.path.join(tmpdir_fresh, "a.csv"), [("1", long, "0", "x"), ("2", "y", "1", None)])
    got = sorted(tuple(r) for r in qc.read_quoted_csv(spark, tmpdir_fresh, COLS).collect())
    assert got == [("1", long, "0", "x"), ("2", "y", "1", None)]
    empty = os.path.join(tmpdir_fresh, "sub")
    os.makedirs(empty)
    write(os.path.join(empty, "e.csv"), [])
    assert qc.read_quoted_csv(spark, empty, COLS).count() == 0


def test_labelled_corpus_in_splits(spark, tmpdir_fresh, small_splits):
    from modspark.sources.readers import read_labelled_csv

    labels = ["toxic", "severe_toxic", "obscene", "threat", "insult", "identity_hate"]
    with open(os.path.join(tmpdir_fresh, "t.csv"), "w", newline="") as f:
        w = csv.writer(f)
        w.writerow(["id", "comment_text", *labels])
        for k in range(120):
            w.writerow([k, None if k % 9 == 0 else f"text {k}\nsecond, line", *(int(k % (j + 2) == 0) for j in range(6))])
    df = read_labelled_csv(spark, tmpdir_fresh)
    assert df.count() == 120 and df.filter("comment_text = ''").count() == 14
    assert df.agg(F.sum("toxic")).first()[0] == 60 and dict(df.dtypes)["toxic"] == "int"
    assert df.filter("label = 1").count() == sum(any(k % (j + 2) == 0 for j in range(6)) for k in range(120))
