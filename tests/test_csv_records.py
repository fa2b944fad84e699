"""CSV records of several lines, over byte ranges."""

import csv
import io
import random

import pytest

from landsight.sources import indicators
from landsight.sources import log as L
from landsight.sources.csv_records import line_steps, read_csv_records, torn_ranges


def whole(spark, path, names, size=None):
    """Records as the reader gives them, in ranges of ``size`` bytes."""
    before = {k: spark.conf.get(k) for k in ("spark.sql.files.maxPartitionBytes", "spark.sql.files.openCostInBytes")}
    if size:
        spark.conf.set("spark.sql.files.maxPartitionBytes", str(size))
        spark.conf.set("spark.sql.files.openCostInBytes", "0")
    try:
        torn = torn_ranges(spark, [path])
        df = read_csv_records(spark, torn, names)
        return df.rdd.getNumPartitions(), [tuple(r)[:-1] for r in df.collect()], torn
    finally:
        for k, v in before.items():
            spark.conf.set(k, v)


def cell(rng):
    kind = rng.random()
    if kind < 0.1:
        return rng.choice(["", "NA", " pad "])
    text = "".join(rng.choice(["a", "bé", '"', ",", "\n", "\r\n", "x y", '""', "\n\n"]) for _ in range(rng.randint(1, 8)))
    return text if kind < 0.6 else text.replace("\n", "").replace("\r", "")


@pytest.mark.parametrize("seed, size, end", [(1, 37, "\n"), (2, 64, "\r\n"), (3, 200, "\n"), (4, 5000, "\n"), (5, None, "\r")])
def test_records_are_those_of_a_sequential_reader(spark, tmp_path, seed, size, end):
    rng = random.Random(seed)
    names = ["Entity", "Code", "Year", "Value, x"]
    rows = [[cell(rng) for _ in names] for _ in range(150)]
    out = io.StringIO()
    writer = csv.writer(out, lineterminator=end)
    writer.writerows([names, *rows])
    path = tmp_path / "x.csv"
    path.write_bytes(out.getvalue().encode())
    tasks, got, torn = whole(spark, str(path), names, size)
    want = [tuple(r) for r in csv.reader(io.StringIO(out.getvalue(), newline=""), quoting=csv.QUOTE_NOTNULL) if r][1:]
    assert sorted(got, key=str) == sorted(want, key=str)
    if size and size < 1000:
        assert tasks > 10 and any(torn.values())


def test_the_steps_of_a_line():
    step = line_steps(",")
    for line, outside, inside in [
        ("a,b", False, True), ('"a', True, False), ('"a""b', True, False), ('"a"x"y,b', False, False), ('a"b,c', False, False),
        ('"a","b', True, True), ('x,"', True, False), ('"""', True, False), ('""""', False, True), ("", False, True),
    ]:
        assert (step(line, False), step(line, True)) == (outside, inside), line


def test_one_record_over_many_ranges_and_stray_quotes(spark, tmp_path):
    path = tmp_path / "x.csv"
    long = "line\n" * 400 + 'said ""so""\n' * 50
    path.write_text(f'Entity,Note\na,1" pipe\nb,"{long}"\nc,d"\n\n   \ne,"f"g\n')
    tasks, got, torn = whole(spark, str(path), ["Entity", "Note"], 100)
    assert tasks > 10
    assert sorted(got) == sorted([("a", '1" pipe'), ("b", long.replace('""', '"')), ("c", 'd"'), ("e", "fg")])


def test_an_open_quote_is_an_error_and_plain_files_are_left_to_spark(spark, tmp_path):
    (tmp_path / "ok.csv").write_text('Entity,Code\n"a,b",c\n')
    (tmp_path / "bad.csv").write_text('Entity,Code\na,"b\nc,d\n')
    assert torn_ranges(spark, [str(tmp_path / "ok.csv")]) == {}
    with pytest.raises(ValueError, match="bad.csv ends inside a quoted field"):
        torn_ranges(spark, [str(tmp_path / "*.csv")])


def test_another_header_is_an_error(spark, tmp_path):
    folder = tmp_path / "dataset=a"
    folder.mkdir()
    (folder / "1.csv").write_text('Entity,Code,Year,V\n"a\nb",AAA,2000,1\n')
    (folder / "2.csv").write_text('Entity,Code,Year,W\n"a\nb",AAA,2000,1\n')
    with pytest.raises(Exception, match="has the columns"):
        indicators.read_indicator_csvs(spark, [str(tmp_path)], metric="V").collect()


def test_indicators_with_line_feeds_beside_plain_files(spark, tmp_path):
    """Missing tokens, the choice of the metric, and the dataset's name are those
    of the plain scan."""
    (tmp_path / "torn.csv").write_text('﻿Entity,Code,Year,Note,V\n"B\nBee",BBB,2001,"two\nlines",2.5\nA,AAA,2000,NA,\n"C ""c""",CCC,2002,"x,y",nan\n', encoding="utf-8")
    (tmp_path / "plain.csv").write_text("Entity,Code,Year,Note,V\nD,DDD,2003,n,4\n")
    rows = indicators.read_indicator_csvs(spark, [str(tmp_path / "torn.csv"), str(tmp_path / "plain.csv")])
    got = sorted((r.dataset, r.entity, r.code, r.year, r.metric, r.value) for r in rows.collect())
    assert got == [
        ("plain", "D", "DDD", 2003, "V", 4.0), ("torn", "A", "AAA", 2000, "V", None), ("torn", "B\nBee", "BBB", 2001, "V", 2.5), ("torn", 'C "c"', "CCC", 2002, "V", None),
    ]


def test_a_large_log_with_long_texts_is_read_by_many_tasks(spark, tmp_path):
    rows = [(f"2024-01-0{1 + i % 9}T00:00:00+00:00", float(i), 1.0, 3, f'one "{i}"\n\ntwo, {"" if i % 3 else "x" * 50}', "", None, "t\n", "p", "m", "Y") for i in range(300)]
    types = ["timestamp string", "latitude double", "longitude double", "zoom int", *(f"{c} string" for c in L.LOG_FIELDS[4:])]
    src = spark.createDataFrame(rows, ", ".join(types))
    src = src.withColumn("timestamp", src["timestamp"].cast("timestamp"))
    L.export_log_csv(src.coalesce(1), str(tmp_path / "csv"))
    before = spark.conf.get("spark.sql.files.maxPartitionBytes")
    spark.conf.set("spark.sql.files.maxPartitionBytes", "4000")
    try:
        back = L.read_log_csv(spark, str(tmp_path / "csv"))
        assert back.rdd.getNumPartitions() > 3
        assert sorted(map(tuple, back.collect())) == sorted(map(tuple, src.collect()))
    finally:
        spark.conf.set("spark.sql.files.maxPartitionBytes", before)


def test_files_of_a_scan_are_split_by_all_of_them(spark, tmp_path):
    """A record over a border in one file only: the ranges of a scan of that file
    are not those of the scan of all."""
    rows = [[f"a{i}", f'say "{i}" ' + "x" * 200 + "\nend"] for i in range(120)]
    for name, records in (("one", rows), ("two", [["b", "x\ny"]] + [["c", "z" * 60]] * 900)):
        with open(tmp_path / f"{name}.csv", "w", newline="") as f:
            csv.writer(f).writerows([["Entity", "Note"], *records])
    before = spark.conf.get("spark.sql.files.openCostInBytes")
    spark.conf.set("spark.sql.files.openCostInBytes", "0")
    try:
        files = [str(tmp_path / f"{n}.csv") for n in ("one", "two")]
        torn = torn_ranges(spark, files)
        assert sorted(map(bool, torn.values())) == [False, True]
        got = [tuple(r)[:-1] for r in read_csv_records(spark, torn, ["Entity", "Note"]).collect()]
    finally:
        spark.conf.set("spark.sql.files.openCostInBytes", before)
    assert sorted(got) == sorted(map(tuple, rows + [["b", "x\ny"]] + [["c", "z" * 60]] * 900))


def test_a_header_over_two_chunks(spark, tmp_path):
    names = ["Entity", "Note\nof a\nrow"]
    with open(tmp_path / "x.csv", "w", newline="") as f:
        csv.writer(f).writerows([names, ["a", "b\nc"], ["d", "e"]])
    _, got, _ = whole(spark, str(tmp_path / "x.csv"), names, 12)
    assert sorted(got) == [("a", "b\nc"), ("d", "e")]
