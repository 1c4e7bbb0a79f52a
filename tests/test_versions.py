"""Stored tables through failures, refreshes of one capture, and readers that opened them before."""

import os

import pytest
from pyspark.sql import functions as F

from sessionloom.plans import versions as V
from sessionloom.plans import warehouse as W
from sessionloom.sources.tables import dealt

ROWS = [(i, f"v{i}", f"capture_{i % 3}.csv") for i in range(30)]


def table(spark, rows=ROWS):
    return spark.createDataFrame(rows, "id long, v string, source_file string")


def rows(df):
    return sorted(map(tuple, df.collect()), key=str)


def files(path):
    return {os.path.join(d, f): os.stat(os.path.join(d, f)).st_mtime_ns for d, _, fs in os.walk(path) for f in fs if f.endswith(".parquet")}


def failing(df):
    """The same rows from a plan of which a late task fails, after others have written theirs."""
    return df.repartition(6, "id").withColumn(
        "v", F.when(F.col("id") == 17, F.raise_error(F.lit("lost")).cast("string")).otherwise(F.col("v"))
    )


def test_a_failed_refresh_leaves_the_old_rows(spark, tmp_path):
    path = str(tmp_path / "view")
    W.materialize(table(spark), path)
    with pytest.raises(Exception, match="lost"):
        W.materialize(failing(table(spark).withColumn("v", F.upper("v"))), path)
    assert rows(W.open_view(spark, path)) == sorted(ROWS, key=str)
    with pytest.raises(Exception, match="lost"):
        W.refresh_captures(failing(table(spark)), path, ["capture_2.csv"])
    assert rows(W.open_view(spark, path)) == sorted(ROWS, key=str)
    W.materialize(table(spark, ROWS[:4]), path)
    assert rows(W.open_view(spark, path)) == sorted(ROWS[:4], key=str)


def test_a_refresh_of_one_capture_touches_one_folder(spark, tmp_path):
    path = str(tmp_path / "view")
    W.materialize(table(spark), path)
    before = files(path)
    new = table(spark).withColumn("v", F.lit("new"))
    got = W.refresh_captures(new, path, ["capture_1.csv"])
    want = [(i, "new" if c == "capture_1.csv" else v, c) for i, v, c in ROWS]
    assert rows(got) == rows(W.open_view(spark, path)) == sorted(want, key=str)
    after = files(path)
    assert before.items() <= after.items()
    assert all("source_file=capture_1.csv" in f for f in after.keys() - before.keys())


def test_a_capture_without_rows_and_one_of_null(spark, tmp_path):
    path = str(tmp_path / "view")
    odd = [(1, "a", None), (2, "b", "x/y=z %41"), (3, "c", "12")]
    assert rows(W.materialize(table(spark, odd), path)) == sorted(odd, key=str)
    W.refresh_captures(table(spark, []), path, ["x/y=z %41"])
    assert rows(W.open_view(spark, path)) == sorted([odd[0], odd[2]], key=str)
    W.refresh_captures(table(spark, [(9, "d", None), (8, "e", "12")]), path, [None])
    assert rows(W.open_view(spark, path)) == sorted([(9, "d", None), odd[2]], key=str)
    assert W.open_view(spark, path).dtypes == table(spark).dtypes


def test_readers_keep_their_version_until_the_refresh_after_next(spark, tmp_path):
    path = str(tmp_path / "view")
    first = W.materialize(table(spark), path)
    W.materialize(table(spark, ROWS[:5]), path)
    assert rows(first) == sorted(ROWS, key=str)
    old = {f for f in files(path) if "table_version=00000001" in f}
    W.materialize(table(spark, ROWS[:6]), path)
    assert old and not old & files(path).keys()
    assert {f.split("table_version=")[1][:8] for f in files(path)} == {"00000002", "00000003"}


def test_a_view_may_be_derived_from_what_it_replaces(spark, tmp_path):
    path = str(tmp_path / "view")
    W.materialize(table(spark), path)
    for n in (20, 10, 0):
        assert W.materialize(W.open_view(spark, path).filter(F.col("id") < n), path).count() == n
    assert W.open_view(spark, path).dtypes == table(spark).dtypes
    plain = table(spark).drop("source_file")
    assert rows(V.replace_table(plain, str(tmp_path / "plain"))) == rows(plain)


def test_unknown_tables_and_other_columns(spark, tmp_path):
    path = str(tmp_path / "view")
    with pytest.raises(FileNotFoundError):
        W.open_view(spark, path)
    with pytest.raises(ValueError):
        W.refresh_captures(table(spark), path, ["capture_1.csv"])
    W.materialize(table(spark), path)
    with pytest.raises(ValueError):
        W.refresh_captures(table(spark).drop("v"), path, ["capture_1.csv"])


def test_a_failed_rebuild_leaves_every_table(spark, raw, tmp_path, monkeypatch):
    counts = {n: t.count() for n, t in W.rebuild(raw, str(tmp_path)).items()}
    build = W.build_tables

    def broken(*args):
        tables = build(*args)
        last = list(tables)[-1]
        return tables | {last: tables[last].withColumn("uid", F.raise_error(F.lit("lost")).cast("string"))}

    monkeypatch.setattr(W, "build_tables", broken)
    with pytest.raises(Exception, match="lost"):
        W.rebuild(raw.limit(5), str(tmp_path))
    assert {n: t.count() for n, t in W.open_tables(spark, str(tmp_path)).items()} == counts


def test_writes_do_not_sort_and_leave_the_setting(spark, tmp_path, monkeypatch):
    """Rows of more captures than a task keeps files open for, too."""
    setting, taken = "spark.sql.maxConcurrentOutputFileWriters", []
    before, lit = spark.conf.get(setting), F.lit
    monkeypatch.setattr(V.F, "lit", lambda value: taken.append(spark.conf.get(setting)) or lit(value))
    many = [(i, f"v{i}", f"capture_{i % 20}.csv") for i in range(200)]
    got = W.materialize(table(spark, many).coalesce(1), str(tmp_path / "view"))
    monkeypatch.undo()
    assert int(taken[0]) > 0 and spark.conf.get(setting) == before
    assert rows(got) == sorted(many, key=str)


def test_a_view_is_made_by_all_cores_from_a_file_of_one_row_group(spark, raw, tmp_path):
    raw.coalesce(1).write.parquet(str(tmp_path / "in"))
    view = dealt(spark.read.parquet(str(tmp_path / "in")), "uid")
    sizes = [n for n in view.rdd.glom().map(len).collect() if n]
    assert len(sizes) > spark.sparkContext.defaultParallelism and sum(sizes) == raw.count()
    assert max(sizes) < raw.count() / spark.sparkContext.defaultParallelism
