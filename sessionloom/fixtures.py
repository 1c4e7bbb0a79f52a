"""Connection relations derived from the `events` test table by integer arithmetic."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

from sessionloom import schemas as S

PORTS = [
    20, 21, 22, 23, 25, 53, 80, 81, 110, 143, 443, 992, 993, 2323, 3389, 8080, 8081, 37215,
    52869, 9999,
]
FIXTURE_STATES = S.CONN_STATES
FIXTURE_PROTOCOLS = ["tcp", "udp", "icmp"]
FIXTURE_SERVICES = {"click": "http", "view": "dns", "purchase": "ssl", "signup": "irc"}
FIXTURE_ATTACKS = [
    "C&C-HeartBeat", "DDoS", "Okiru", "C&C-Torii", "PartOfAHorizontalPortScan", "Attack",
    "C&C-FileDownload",
]
FIXTURE_HISTORY = "ShADadtTcCfFrRg^sHwWGI"
LOCAL_TOKENS = ["T", "F", "-"]


def read_table(spark: SparkSession, sf_dir: str, name: str) -> DataFrame:
    return spark.read.parquet(f"{sf_dir}/{name}.parquet")


def _pick(values: list, index: Column) -> Column:
    return F.get(F.array(*[F.lit(v) for v in values]), index.cast("int"))


def conn_from_events(events: DataFrame) -> DataFrame:
    """One connection per event: the raw columns plus `event_id` and `source_file`."""
    n = F.col("event_id")
    text = lambda c: c.cast("string")
    ip = lambda *parts: F.concat_ws(".", *[text(p) for p in parts])
    malicious = F.col("event_type").isin("error", "signup")
    local = F.when(n % 3 == 0, True).when(n % 3 == 1, False)
    services = F.create_map(*[F.lit(v) for kv in FIXTURE_SERVICES.items() for v in kv])
    micros = F.unix_micros(F.col("ts").cast("timestamp"))
    return events.select(
        n,
        (micros / F.lit(1e6)).alias("ts"),
        F.concat(F.lit("C"), text(n)).alias("uid"),
        ip(F.lit("192.168"), F.floor(F.col("user_id") / 256), F.col("user_id") % 256).alias("id_orig_h"),
        ((n * 7919) % 65536).cast("int").alias("id_orig_p"),
        ip(F.lit("10"), n % 7, F.col("user_id") % 256, n % 251).alias("id_resp_h"),
        _pick(PORTS, n % 20).alias("id_resp_p"),
        _pick(FIXTURE_PROTOCOLS, n % 3).alias("proto"),
        services[F.col("event_type")].alias("service"),
        F.when(n % 5 != 0, F.col("value")).alias("duration"),
        F.when(n % 7 != 0, (n % 1500).cast("double")).alias("orig_bytes"),
        F.when(n % 11 != 0, (n % 900).cast("double")).alias("resp_bytes"),
        _pick(FIXTURE_STATES, n % 13).alias("conn_state"),
        local.alias("local_orig"),
        local.alias("local_resp"),
        ((n % 4) * 10).cast("double").alias("missed_bytes"),
        F.when(
            n % 17 != 0,
            F.lit(FIXTURE_HISTORY).substr((n % 10 + 1).cast("int"), (n % 14 + 1).cast("int")),
        ).alias("history"),
        (n % 97).cast("int").alias("orig_pkts"),
        ((n * 31) % 5000).cast("double").alias("orig_ip_bytes"),
        (n % 53).cast("int").alias("resp_pkts"),
        ((n * 17) % 7000).cast("double").alias("resp_ip_bytes"),
        F.when(n % 50 == 1, F.concat(F.lit("C"), text(n - 1))).alias("tunnel_parents"),
        F.when(malicious, S.MALICIOUS)
        .when(n % 2 == 0, S.BENIGN.lower())
        .otherwise(S.BENIGN)
        .alias("label"),
        F.when(malicious, _pick(FIXTURE_ATTACKS, n % 7)).alias("detailed_label"),
        F.concat(F.lit("capture_"), text(n % 3 + 1), F.lit(".csv")).alias("source_file"),
    )


def conn(spark: SparkSession, sf_dir: str) -> DataFrame:
    """The raw relation of a test-data folder, without the event number."""
    return conn_from_events(read_table(spark, sf_dir, "events")).drop("event_id")


def _fields(raw: DataFrame) -> list[Column]:
    whole = lambda c: F.col(c).cast("bigint").cast("string")
    text = {
        "ts": F.format_string("%.6f", "ts"),
        "duration": F.when(F.col("duration").isNotNull(), F.format_string("%.2f", "duration")),
        "local_orig": F.when(F.col("local_orig"), "T").when(~F.col("local_orig"), "F"),
        "local_resp": F.when(F.col("local_resp"), "T").when(~F.col("local_resp"), "F"),
    }
    for c in ["orig_bytes", "resp_bytes", "missed_bytes", "orig_ip_bytes", "resp_ip_bytes"]:
        text[c] = whole(c)
    return [F.coalesce(text.get(c, F.col(c).cast("string")), F.lit("-")) for c in S.RAW_COLUMNS]


def conn_lines(events: DataFrame) -> DataFrame:
    """The connections written out as log lines, with a comment line before every capture's first.

    Every tenth line has all 23 fields; the others have the last three glued by blanks.
    """
    raw = conn_from_events(events)
    fields = _fields(raw)
    glued = F.concat_ws("\t", *fields[:20], F.concat_ws("   ", *fields[20:]))
    whole = F.concat_ws("\t", *fields)
    lines = raw.select(
        F.when(F.col("event_id") % 10 == 0, whole).otherwise(glued).alias("value"),
        "source_file",
        "event_id",
    )
    comment = F.concat(F.lit("#fields\t"), F.lit("\t".join(S.LOG_FIELDS)))
    return lines.select(
        F.explode(
            F.when(F.col("event_id") % 100 < 3, F.array(comment, F.col("value"))).otherwise(
                F.array(F.col("value"))
            )
        ).alias("value"),
        "source_file",
    )


#: Faults of `broken_lines`: a column, the divisor and remainder of the event numbers that have it, the cell.
BROKEN_CELLS = [
    ("id_orig_p", 53, 8, "port"), ("orig_bytes", 47, 7, "12x"), ("local_orig", 59, 9, "maybe"), ("resp_pkts", 61, 3, "1,5"),
]
#: Lines cut after so many fields, and lines with two more, as divisor and remainder.
CUT_FIELDS, CUT, SURPLUS = 12, (41, 5), (43, 6)


def broken_lines(events: DataFrame) -> DataFrame:
    """The connections as log lines of 23 fields, some of them cut, too long or with cells of the wrong type."""
    raw = conn_from_events(events)
    n = F.col("event_id")
    hit = lambda fault: n % fault[0] == fault[1]
    cells = dict(zip(S.RAW_COLUMNS, _fields(raw)))
    for c, divisor, rest, cell in BROKEN_CELLS:
        cells[c] = F.when(hit((divisor, rest)), F.lit(cell)).otherwise(cells[c])
    fields = list(cells.values())
    line = (
        F.when(hit(CUT), F.concat_ws("\t", *fields[:CUT_FIELDS]))
        .when(hit(SURPLUS), F.concat_ws("\t", *fields, F.lit("one more"), F.lit("")))
        .otherwise(F.concat_ws("\t", *fields))
    )
    # Exploded, as in `conn_lines`: a filter on the line is not moved below it, where every line would be built again.
    return raw.select(F.explode(F.array(line)).alias("value"), "source_file")


def one_file_per_capture(df: DataFrame, path: str, kind: str, **options) -> str:
    """Write `df` below `path` in files that are named as its captures; a glob that matches them.

    Each task writes a part of every capture it holds, and parts go to folders of their own under the
    capture's name.
    """
    spark = df.sparkSession
    df.write.partitionBy("source_file").options(**options).format(kind).save(f"{path}/written")
    hadoop = spark._jvm.org.apache.hadoop.fs
    fs = hadoop.Path(path).getFileSystem(spark._jsc.hadoopConfiguration())
    for status in fs.globStatus(hadoop.Path(f"{path}/written/source_file=*/part-*")):
        part = status.getPath()
        capture = part.getParent().getName().removeprefix("source_file=")
        folder = hadoop.Path(f"{path}/files/{part.getName().split('.')[0]}")
        fs.mkdirs(folder)
        fs.rename(part, hadoop.Path(folder, capture))
    return f"{path}/files/*"


def scores(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Two score columns over the connections, stacked as (key, model, label, score)."""
    value = F.coalesce(F.col("value"), F.lit(0.0))
    base = read_table(spark, sf_dir, "events").select(
        F.concat(F.lit("C"), F.col("event_id").cast("string")).alias("key"),
        F.when(F.col("event_type").isin("error", "signup"), 1).otherwise(0).alias("label"),
        F.array(
            F.struct(
                F.lit("score_a").alias("model"),
                ((F.col("event_id") * 37 % 101) * F.lit(0.01)).alias("score"),
            ),
            F.struct(
                F.lit("score_b").alias("model"),
                (F.least(value, F.lit(100.0)) / 100).alias("score"),
            ),
        ).alias("s"),
    )
    return base.select("key", "label", F.explode("s").alias("s")).select(
        "key", F.col("s.model").alias("model"), "label", F.col("s.score").alias("score")
    )


def vectors(spark: SparkSession, sf_dir: str) -> DataFrame:
    """The embeddings as 64 double columns with a binary label."""
    table = read_table(spark, sf_dir, "embeddings")
    return table.select(
        F.col("vec_id").cast("string").alias("key"),
        *[F.get("embedding", i).cast("double").alias(f"v{i}") for i in range(64)],
        F.when(F.col("label") < 5, 1).otherwise(0).alias("label"),
    )
