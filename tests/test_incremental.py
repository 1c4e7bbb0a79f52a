"""Tables grown batch by batch against one rebuild, repeated deliveries, and keys that stay."""

import pytest
from pyspark.sql import functions as F

from sessionloom import fixtures as X
from sessionloom import schemas as S
from sessionloom.checks.log_and_tables import _named_sessions
from sessionloom.plans import incremental as I
from sessionloom.plans import warehouse as W
from sessionloom.sources import conn_log as L
from sessionloom.streaming.ingest import stream_lines

SESSION_TABLES = ["session", *S.SATELLITES, "tunnel_parent", "session_history"]


def rows(df):
    return sorted(map(str, df.select(sorted(df.columns)).collect()))


@pytest.fixture(scope="module")
def lines(spark, sf_dir):
    return X.conn_lines(X.read_table(spark, sf_dir, "events")).persist()


def test_three_batches_equal_one_rebuild(spark, lines, tmp_path):
    raw = L.raw_from_lines(lines)
    out = str(tmp_path / "tables")
    for k in (3, 1, 2):
        X.one_file_per_capture(lines.filter(f"source_file = 'capture_{k}.csv'"), f"{tmp_path}/in{k}", "text")
        stream = L.raw_from_lines(stream_lines(spark, f"{tmp_path}/in*/files/*", 1))
        I.stream_tables(stream, out, str(tmp_path / "checkpoint"))
    grown = I.open_grown(spark, out)
    built = {n: t.drop("source_file") if n not in ("session", *W.SHARED_TABLES) else t for n, t in W.rebuild(raw, str(tmp_path / "built")).items()}
    assert set(grown) == set(built)
    assert all(rows(grown[n]) == rows(built[n]) for n in [*SESSION_TABLES, "history_legend"])
    assert rows(_named_sessions(grown)) == rows(_named_sessions(built))
    before = {n: rows(t) for n, t in grown.items()}
    # The same lines in other files, and the same files once more.
    X.one_file_per_capture(lines.repartition(3), f"{tmp_path}/in4", "text")
    for _ in range(2):
        stream = L.raw_from_lines(stream_lines(spark, f"{tmp_path}/in*/files/*", 2))
        I.stream_tables(stream, out, str(tmp_path / "checkpoint"))
    assert {n: rows(t) for n, t in I.open_grown(spark, out).items()} == before


def test_keys_stay_when_new_names_come(spark, lines, tmp_path):
    raw, out = L.raw_from_lines(lines), str(tmp_path / "tables")
    late = F.col("service").isin("dns", "ssl")
    I.add_batch(raw.filter(~late | F.col("service").isNull()), 0, out)
    first = {r.svc_name: r.svc_id for r in I.open_grown(spark, out)["service"].collect()}
    I.add_batch(raw, 1, out)
    later = {r.svc_name: r.svc_id for r in I.open_grown(spark, out)["service"].collect()}
    assert first == {"http": 1, "irc": 2} and later == {**first, "dns": 3, "ssl": 4}
    few = I.extended_dimension(raw.select(F.col("service").alias("svc_name")).filter("svc_name is not null").distinct(), None, "k", "svc_name")
    assert {r.svc_name: r.k for r in few.collect()} == {"dns": 1, "http": 2, "irc": 3, "ssl": 4}


def test_a_batch_that_fails_and_runs_again_counts_once(spark, lines, tmp_path, monkeypatch):
    raw, out = L.raw_from_lines(lines), str(tmp_path / "tables")
    one, two = raw.filter("source_file = 'capture_1.csv'"), raw.filter("source_file <> 'capture_1.csv'")
    I.add_batch(one, 0, out)
    n = I.open_grown(spark, out)["session"].count()
    build = I.N.build_session_history
    broken = lambda *a: build(*a).withColumn("uid", F.raise_error(F.lit("lost")).cast("string"))
    monkeypatch.setattr(I.N, "build_session_history", broken)
    with pytest.raises(Exception, match="lost"):
        I.add_batch(two, 1, out)
    assert I.open_grown(spark, out)["session"].count() == n == one.count()
    monkeypatch.setattr(I.N, "build_session_history", build)
    for _ in range(2):
        I.add_batch(two, 1, out)
        assert I.open_grown(spark, out)["session"].count() == raw.count()
    assert I.open_grown(spark, out)["session_history"].count() == build(raw, I.N.history_legend(spark)).count()


def test_null_and_repeated_keys_in_one_batch(spark, lines, tmp_path):
    raw = L.raw_from_lines(lines).limit(20)
    odd = raw.withColumn("uid", F.lit(None).cast("string")).unionByName(raw).unionByName(raw.withColumn("source_file", F.lit("z")))
    I.add_batch(odd, 0, str(tmp_path / "t"))
    got = I.open_grown(spark, str(tmp_path / "t"))["session"]
    assert rows(got.select("uid", "source_file")) == rows(raw.select("uid", "source_file"))
    I.add_batch(raw.limit(0), 1, str(tmp_path / "t"))
    assert I.open_grown(spark, str(tmp_path / "t"))["session"].count() == 20


def test_a_large_batch_is_read_once(spark, lines, tmp_path, monkeypatch):
    files = X.one_file_per_capture(lines, f"{tmp_path}/in", "text")
    raw = L.read_conn_logs(spark, files)
    stored = raw.filter("source_file = 'capture_1.csv'").select("uid").localCheckpoint()
    want = rows(raw.filter("source_file <> 'capture_1.csv'"))
    assert rows(I.new_sessions(raw, stored)) == want
    monkeypatch.setattr(I, "local_copy", lambda df: None)
    large = I.new_sessions(raw, stored)
    assert rows(large) == want
    assert large._jdf.queryExecution().executedPlan().toString().count("FileScan text") == 1
