"""CSV read by ranges against the reader that takes whole files."""

import random
from collections import Counter

import pytest

from noticegrade.sources.split_csv import csv_records, read_split_csv

FIELDS = ["", "plain", '"quoted"', '"two\nlines"', '"a ""word"" and, a comma"', '"\n\n"', 'stray " quote', '"ends in ""\n"""', "5\"", '"1"x', " \"3\"", '""', '"line ""\n"" break,\n,"']


def whole_files(spark, path):
    return spark.read.option("header", "true").option("multiLine", "true").option("escape", '"').csv(path)


def rows(df):
    return Counter(tuple(r) for r in df.collect())


@pytest.fixture
def small_ranges(spark):
    keys = {"spark.sql.files.maxPartitionBytes": "64", "spark.sql.files.openCostInBytes": "1"}
    for k, v in keys.items():
        spark.conf.set(k, v)
    yield spark
    for k in keys:
        spark.conf.unset(k)


@pytest.mark.parametrize("seed", range(4))
def test_equals_the_reader_of_whole_files(small_ranges, tmp_path, seed):
    spark, draw = small_ranges, random.Random(seed)
    for name in ("one.csv", "two.csv"):
        lines = ['id,"first\nname",third'] + [f"{k},{draw.choice(FIELDS)},{draw.choice(FIELDS)}" for k in range(120)]
        (tmp_path / name).write_text("\n".join(lines) + "\n" * draw.randint(0, 2))
    path = str(tmp_path)
    assert spark.read.text(path).rdd.getNumPartitions() > 20
    ours, theirs = read_split_csv(spark, path), whole_files(spark, path)
    assert ours.columns == theirs.columns == ["id", "first\nname", "third"]
    assert rows(ours) == rows(theirs) and ours.count() == 240


def test_records_cross_many_ranges(small_ranges, tmp_path):
    spark = small_ranges
    long = '"' + "\n".join(f'part {k}, ""{k}""' for k in range(200)) + '"'
    text = f"a,b\n1,{long}\n2,x\n\n3,{long}\n"
    (tmp_path / "t.csv").write_text(text)
    assert rows(read_split_csv(spark, str(tmp_path))) == rows(whole_files(spark, str(tmp_path)))
    assert [r.record for r in csv_records(spark, str(tmp_path)).orderBy("record").collect()] == [1, 2, 3, 5]


def test_carriage_returns_missing_fields_and_empty_files(spark, tmp_path):
    (tmp_path / "a.csv").write_bytes(b'a,b,c\r\n1,"x, y",2\r\n3\r\n')
    (tmp_path / "b.csv").write_bytes(b"a,b,c\r\n")
    got = rows(read_split_csv(spark, [str(tmp_path / "a.csv"), str(tmp_path / "b.csv")]))
    assert got == Counter([("1", "x, y", "2"), ("3", None, None)])
    assert rows(read_split_csv(spark, str(tmp_path / "a.csv"), ["p", "q", "r"])) == got
    assert rows(read_split_csv(spark, str(tmp_path / "b.csv"))) == Counter()


def test_gzip_is_one_range(spark, tmp_path):
    import gzip

    with gzip.open(tmp_path / "a.csv.gz", "wt") as file:
        file.write('a,b\n1,"two\nlines"\n')
    assert rows(read_split_csv(spark, str(tmp_path))) == Counter([("1", "two\nlines")])


def test_whole_lines_are_not_moved(small_ranges, tmp_path):
    spark = small_ranges
    (tmp_path / "t.csv").write_text('a,b\n' + "".join(f'{k},"x"\n' for k in range(200)) + '9,"two\nlines"\n')
    found = csv_records(spark, str(tmp_path))
    plan = found._jdf.queryExecution().optimizedPlan().toString()
    assert "Window" not in plan and plan.count("Aggregate") == 1  # only records of several lines meet
    assert found.count() == 202
