"""Hand-written edge rows."""

import pytest
from pyspark.sql import functions as F

from sessionloom import schemas as S
from sessionloom.functions import encoding as E
from sessionloom.operators import evaluate as V
from sessionloom.operators import features as Fe
from sessionloom.operators import normalize as N
from sessionloom.operators import prepare as P
from sessionloom.operators import quality as Q
from sessionloom.operators.scaling import RobustScale, StandardScale, minmax_score
from sessionloom.sources import conn_log as L
from sessionloom.sources import tables as T


def column(spark, values, kind, name="x"):
    return spark.createDataFrame([(v,) for v in values], f"{name} {kind}")


def line(n=20, tail="-   Malicious   C&C"):
    return "\t".join([f"f{i}" for i in range(n)] + [tail])


def parse(spark, *lines):
    return L.parse_conn_log(column(spark, lines, "string", "value")).collect()


def test_comment_lines_and_hash_inside_a_line(spark):
    rows = parse(spark, "#fields\tts", line().replace("f15", "Sh#A"), "#close")
    assert len(rows) == 1 and rows[0]["history"] == "Sh#A"


def test_glued_labels(spark):
    row = parse(spark, line())[0]
    assert (row["tunnel_parents"], row["label"], row["detailed-label"]) == ("-", "Malicious", "C&C")
    clean = L.null_tokens(L.parse_conn_log(column(spark, [line()], "string", "value"))).first()
    assert clean["tunnel_parents"] is None


def test_two_words_stay_glued(spark):
    row = parse(spark, line(tail="-   benign"))[0]
    assert row["tunnel_parents"] == "-   benign" and row["label"] is None


def test_other_field_counts_pass_through(spark):
    short, long = parse(spark, line(10), line(25))
    assert short["duration"] == "f8" and short["label"] is None
    assert long["detailed-label"] == "f22"


def test_null_tokens(spark):
    df = column(spark, ["-", "(empty)", "", "NA", "nan", "x", None], "string")
    assert [r.x for r in L.null_tokens(df).collect()] == [None] * 5 + ["x", None]


def test_types(spark):
    row = "\t".join([
        "1.5", "C1", "1.2.3.4", "443.0", "h", "bad", "tcp", "-", "0.1", "5", "6", "SF", "T", "F",
        "0", "ShA", "1", "2", "3", "4", "-   benign   -",
    ])
    out = L.to_raw(L.null_tokens(L.parse_conn_log(column(spark, [row], "string", "value")))).first()
    assert (out.id_orig_p, out.id_resp_p, out.local_orig, out.local_resp) == (443, None, True, False)
    assert out.label == "benign" and out.detailed_label is None and out.service is None


def test_benign_spellings(spark):
    df = column(spark, ["BENIGN", "benign", "malicious", None, "Malicious"], "string")
    rows = df.select(E.simple_label(F.col("x")).alias("s"))
    rows = rows.select("s", E.malicious_flag(F.col("s")).alias("y")).collect()
    assert [r.s for r in rows] == ["Benign", "Benign", "malicious", None, "Malicious"]
    assert [r.y for r in rows] == [0, 0, 0, 0, 1]


def test_time_of_day_rounds(spark):
    df = column(spark, [10.5, 10.4, 86399.6, 86400.0, None], "double")
    assert [r[0] for r in df.select(E.time_of_day(F.col("x"))).collect()] == [11, 10, 86400, 0, None]


def test_origin_port_edges(spark):
    df = column(spark, [0, 1023, 1024, 49151, 49152, None], "int")
    rows = [tuple(r) for r in df.select(E.orig_port_flags(F.col("x"))).collect()]
    assert rows == [(1, 0, 0), (1, 0, 0), (0, 1, 0), (0, 1, 0), (0, 0, 1), (0, 0, 0)]


def test_responder_port_null_is_other(spark):
    df = column(spark, [None, 22, 4], "int")
    for ports in (S.TRAINING_PORTS, S.IOT_PORTS):
        rows = df.select(E.resp_port_flags("x", ports)).collect()
        assert [r.resp_port_other for r in rows] == [1, 0, 1]
        assert sum(rows[0]) == 1 and rows[1].resp_port_22 == 1


@pytest.mark.parametrize(
    "history, legend, expected",
    [
        (None, "literal", []),
        ("", "literal", []),
        ("S", "literal", ["history_1_ss"]),
        ("ShAhAhAhAhAhAh", "literal", ["history_1_ss"] + [
            f"history_{i}_{'h' if i % 2 == 0 else 'aa'}" for i in range(2, 13)]),
        ("sS", "literal", ["history_2_ss"]),
        ("wS", "literal", ["history_1_ss"]),
        ("wS", "full", ["history_1_w", "history_2_ss"]),
        ("<^", "literal", ["history_2_caret"]),
        ("zS", "literal", ["history_1_ss"]),
    ],
)
def test_history_flags(spark, history, legend, expected):
    df = column(spark, [history], "string").select(
        E.history_codes(F.col("x"), legend).alias("history_codes")
    )
    row = df.select(E.history_flags()).first().asDict()
    assert [n for n, v in row.items() if v] == expected
    assert df.select(E.history_terms()).first()[0] == expected


def test_several_families(spark):
    df = column(spark, ["C&C-HeartBeat-Attack", None], "string")
    rows = df.select(E.attack_flags(F.col("x"))).collect()
    assert [n for n, v in rows[0].asDict().items() if v] == [
        "label_c2c", "label_heartbeat", "label_attack"
    ]
    assert sum(rows[1]) == 0


def test_label_attack_alone_is_not_binary(spark):
    df = spark.createDataFrame([(0, 1), (1, 0)], "label_ddos int, label_attack int")
    assert [r.binary_label for r in P.build_binary_label(df).collect()] == [0, 1]
    with pytest.raises(ValueError):
        P.build_binary_label(df.select(F.lit(1).alias("a")))


def test_addresses(spark):
    values = ["192.168.0.1", "fe80::1", "300.1.1.1", "1.2.3", "1.2.3.4.5", "255.255.255.255", None]
    df = column(spark, values, "string")
    got = [r[0] for r in df.select(E.ipv4_to_int(F.col("x"))).collect()]
    assert got == [3232235521, None, None, None, None, 4294967295, None]


def test_constant_column(spark):
    model = StandardScale.fit(column(spark, [5.0] * 3, "double"), ["x"])
    assert model.transform(column(spark, [5.0, 7.0], "double")).collect() == [(0.0,), (2.0,)]


def test_no_spread_and_quartiles(spark):
    flat = column(spark, [1.0] * 4, "double")
    assert {r.x for r in RobustScale.fit(flat, ["x"]).transform(flat).collect()} == {0.0}
    model = RobustScale.fit(column(spark, [1.0, 2.0, 4.0, 9.0, None], "double"), ["x"])
    assert (model.centers, model.scales) == ((3.0,), (3.5,))


def scores(spark, rows):
    return spark.createDataFrame(
        [(str(i), "m", y, s) for i, (y, s) in enumerate(rows)],
        "key string, model string, label int, score double",
    )


def test_single_class(spark):
    s = scores(spark, [(0, 0.2), (0, 0.9)])
    assert V.roc_auc(s).first()["roc_auc"] is None
    at = V.metrics_at(s, 0.5).first()
    assert (at.precision, at.recall, at.f1) == (0.0, 0.0, 0.0)
    assert P.upsample_minority(s, "key", "label").count() == 2


def test_lowest_of_equal_thresholds(spark):
    s = scores(spark, [(0, 0.1), (1, 0.5), (1, 0.6)])
    best = V.choose_threshold(V.threshold_scan(s), "f1").first()
    assert best.threshold == 11 * 0.01 and best.f1 == 1.0


def test_unreachable_floor_uses_all(spark):
    s = scores(spark, [(0, 0.1), (1, 0.5)])
    row = V.model_summary(s, "f1", min_precision=1.1).first()
    assert row.strategy == "f1" and row.f1 == 1.0
    assert V.model_summary(s, "f1", min_precision=0.5).first().strategy == "f1 +floors"
    with pytest.raises(ValueError):
        V.choose_threshold(V.threshold_scan(s), "best")


def test_constant_decision_score(spark):
    df = column(spark, [2.0, 2.0], "double")
    assert {r.score for r in minmax_score(df, "x").collect()} == {0.5}


def test_duplicate_key_and_orphan(spark):
    sessions = spark.createDataFrame([("C1",), ("C1",), ("C2",)], "uid string")
    assert [tuple(r) for r in Q.pk_violations(sessions, ["uid"]).collect()] == [("C1", 2)]
    edges = spark.createDataFrame([("C2", "C1"), ("C1", "CX")], "child_uid string, parent_uid string")
    assert [tuple(r) for r in Q.fk_violations(edges, sessions, "parent_uid", "uid").collect()] == [("CX", 1)]


def test_null_key_is_a_violation(spark):
    df = spark.createDataFrame([("a", 1), (None, 1)], "k string, j int")
    assert [tuple(r) for r in Q.pk_violations(df, ["k", "j"]).collect()] == [(None, 1, 1)]


def test_two_parents_two_rows(spark):
    child = spark.createDataFrame([("C3",)], "uid string")
    edges = spark.createDataFrame([("C3", "C1"), ("C3", "C2")], "child_uid string, parent_uid string")
    assert Fe.with_tunnel_parent(child, edges).count() == 2


def test_duplicates_refused_or_first_kept(spark, raw):
    twice = raw.unionByName(raw.withColumn("ts", F.col("ts") + 1))
    with pytest.raises(ValueError):
        N.unique_sessions(twice)
    kept = N.unique_sessions(twice, "keep_first")
    assert kept.exceptAll(raw).count() == 0 and kept.count() == raw.count()


def test_provenance_is_the_file_name(spark, tmp_path):
    (tmp_path / "conn.log").write_text("#fields\n" + line() + "\n")
    (tmp_path / "other.log").write_text(line(tail="-\tBenign\t-") + "\n")
    rows = L.read_conn_logs(spark, str(tmp_path)).collect()
    assert {(r.source_file, r.label) for r in rows} == {("conn.log", "Malicious"), ("other.log", "Benign")}


def test_directory_load_reads_csv_only(spark, tmp_path):
    header = ",".join(S.LOG_FIELDS)
    cells = ["1.0", "C1", "1.1.1.1", "1", "2.2.2.2", "2", "tcp", "", "", "", "", "SF", "T", "", "0",
             "S", "1", "1", "1", "1", "", "Benign", ""]
    (tmp_path / "a.csv").write_text(header + "\n" + ",".join(cells) + "\n")
    (tmp_path / "b.csv").write_text(header + "\n" + ",".join(cells).replace("C1", "C2") + "\n")
    (tmp_path / "c.txt").write_text("no")
    (tmp_path / "sub").mkdir()
    (tmp_path / "sub" / "d.csv").write_text(header + "\n" + ",".join(cells) + "\n")
    rows = T.load_dir(spark, str(tmp_path)).collect()
    assert {(r.uid, r.source_file) for r in rows} == {("C1", "a.csv"), ("C2", "b.csv")}
    assert rows[0].service is None and rows[0].local_resp is None and rows[0].local_orig is True


def test_database_read_must_be_split(spark):
    with pytest.raises(ValueError):
        T.read_relation(spark, "session", jdbc={"url": "jdbc:none"})


def test_dotted_names_are_dropped_by_exact_name(spark):
    df = spark.createDataFrame([(1, 2, 3)], "`id.orig_h` int, uid int, x int")
    assert Q.drop_if_present(df, S.ID_COLUMNS).columns == ["x"]
