"""Counts of malformed lines: by hand, against the totals of the same scan, and through the stream."""

import os

import pytest
from pyspark.sql import functions as F

from sessionloom import fixtures as X
from sessionloom import schemas as S
from sessionloom.sources import checked_load as C
from sessionloom.sources import conn_log as L
from sessionloom.streaming.ingest import stream_lines

GOOD = ["1.5", "C1", "1.2.3.4", "80", "5.6.7.8", "443.0", "tcp", "-", "0.5", "10", "(empty)", "SF", "T", "F", "0", "Sh", "1", "2", "3", "4", "-", "Benign", "-"]
GLUED = [*GOOD[:20], "-   Benign   -"]


def line(fields=GOOD, **cells):
    return "\t".join(cells.get(n.replace(".", "_").replace("-", "_"), v) for n, v in zip(S.LOG_FIELDS, fields))


LINES = [
    ("a", line()), ("a", "\t".join(GLUED)), ("a", "#fields\tts"), ("a", ""),
    ("a", line(GOOD[:9])), ("a", line() + "\tx"), ("a", line() + "\t"), ("b", line(ts="noon", orig_pkts="1e99")),
    ("b", line(local_orig="yes", duration="")), ("b", "\t".join(GOOD[:3]).replace("1.5", "x")), ("b", "one field"), (None, line(resp_bytes="0x1")),
]
REPORT = {
    ("a", "all", None): 5, ("a", "short", None): 1, ("a", "long", None): 2, ("b", "all", None): 4, ("b", "short", None): 2,
    ("b", "misfit", "ts"): 3, ("b", "misfit", "orig_pkts"): 1, ("b", "misfit", "local_orig"): 1,
    (None, "all", None): 1, (None, "misfit", "resp_bytes"): 1,
}


def test_by_hand(spark, tmp_path):
    lines = spark.createDataFrame(LINES, "source_file string, value string").repartition(3)
    totals = C.load_checked(lines, str(tmp_path / "out"))
    got = {tuple(r)[:3]: r.n for r in C.parse_report(spark, str(tmp_path / "out")).collect()}
    assert got == REPORT
    bad = C.rejected_lines(spark, str(tmp_path / "out"))
    assert sorted(r.line for r in bad.collect()) == sorted(v for _, v in LINES[4:])
    assert {r.line: (r.n_fields, r.misfits) for r in bad.collect()}["one field"] == (1, ["ts"])
    rows = C.loaded_rows(spark, str(tmp_path / "out"))
    plain = L.raw_from_lines(lines)
    order = [f"`{c}`" for c in plain.columns]
    assert sorted(map(str, rows.select(order).collect())) == sorted(map(str, plain.select(order).collect()))
    assert totals["all"] == 10 and totals["misfit_ts"] == 3 and totals["misfit_id_orig_p"] == 0


def test_totals_come_from_the_one_scan_of_the_text(spark, tmp_path, sf_dir):
    read = spark.sparkContext.accumulator(0)

    def counted(batches):
        for batch in batches:
            read.add(batch.num_rows)
            yield batch

    lines = X.broken_lines(X.read_table(spark, sf_dir, "events")).repartition(4)
    n = lines.count()
    totals = C.load_checked(lines.mapInArrow(counted, lines.schema), str(tmp_path / "out"))
    sums = {}
    for r in C.parse_report(spark, str(tmp_path / "out")).collect():
        name = f"{r.problem}_{r.column_name}" if r.column_name else r.problem
        sums[name] = sums.get(name, 0) + r.n
    assert read.value == n == totals["all"]
    assert sums == {k: v for k, v in totals.items() if v}
    bad = C.rejected_lines(spark, str(tmp_path / "out"))
    plan = bad._jdf.queryExecution().executedPlan().toString()
    assert "PartitionFilters: [isnotnull(clean" in plan and "id_orig_h" not in plan.split("ReadSchema")[1]


def test_a_stream_counts_each_file_once(spark, tmp_path, sf_dir):
    lines = X.broken_lines(X.read_table(spark, sf_dir, "events"))
    out, done = str(tmp_path / "out"), str(tmp_path / "checkpoint")
    batch = lambda: {tuple(r) for r in C.parse_report(spark, out).collect()}
    first = X.one_file_per_capture(lines.filter("source_file = 'capture_1.csv'").repartition(2), str(tmp_path / "in1"), "text")
    C.stream_checked(stream_lines(spark, f"{tmp_path}/in*/files/*", 1), out, done)
    some = batch()
    assert {r[0] for r in some} == {"capture_1.csv"} and os.path.isdir(first[:-2])
    X.one_file_per_capture(lines.filter("source_file <> 'capture_1.csv'"), str(tmp_path / "in2"), "text")
    for _ in range(2):
        C.stream_checked(stream_lines(spark, f"{tmp_path}/in*/files/*", 1), out, done)
    C.load_checked(lines, str(tmp_path / "whole"))
    whole = {tuple(r) for r in C.parse_report(spark, str(tmp_path / "whole")).collect()}
    assert some < batch() == whole


def test_no_lines(spark, tmp_path):
    empty = spark.createDataFrame([], "value string, source_file string")
    totals = C.load_checked(empty, str(tmp_path / "out"))
    assert totals["all"] == 0 == totals["long"]
    assert C.parse_report(spark, str(tmp_path / "out")).collect() == []
    with pytest.raises(Exception, match="[Pp]ath"):
        C.load_checked(empty, str(tmp_path / "out"))
    assert C.checked_lines(empty).filter(F.col("problem").isNotNull()).count() == 0


def test_captures_named_by_their_folders(spark, tmp_path):
    for name in ("one", "a b+c"):
        spark.createDataFrame([(line(),)], "value string").coalesce(1).write.text(str(tmp_path / "logs" / name))
    got = L.read_conn_logs(spark, str(tmp_path / "logs" / "*"), capture="folder")
    assert {r.source_file for r in got.collect()} == {"one", "a b+c"}
    with pytest.raises(ValueError):
        L.read_lines(spark, str(tmp_path), capture="host")
