"""The normalised tables: sessions, satellites, dimensions, bridges and tunnel edges."""

from __future__ import annotations

from collections.abc import Sequence

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from sessionloom import schemas as S
from sessionloom.functions.encoding import legend_rows, simple_label
from sessionloom.operators.joins import lookup_join, small_rows
from sessionloom.operators.quality import keep_first, require_unique
from sessionloom.sources.tables import with_row_id


def unique_sessions(raw: DataFrame, on_duplicate: str = "fail") -> DataFrame:
    """The raw relation with `uid` as a key: refuse duplicates, or keep the earliest row."""
    if on_duplicate == "fail":
        require_unique(raw, ["uid"])
        return raw
    if on_duplicate == "keep_first":
        return keep_first(raw, ["uid"], ["source_file", "ts"])
    raise ValueError("on_duplicate must be 'fail' or 'keep_first'")


def _dimension(raw: DataFrame, source: str, key: str, name: str) -> DataFrame:
    """Distinct names numbered in name order: as literal rows if few, else distributed."""
    names = raw.filter(F.col(source).isNotNull()).select(F.col(source).alias(name)).distinct()
    few = small_rows(names)
    if few is None:
        return with_row_id(names, [name], key).select(key, name)
    numbered = enumerate(sorted(r[name] for r in few), start=1)
    return raw.sparkSession.createDataFrame(list(numbered), f"{key} long, {name} string")


def build_service(raw: DataFrame) -> DataFrame:
    """Distinct services, numbered by name."""
    return _dimension(raw, "service", "svc_id", "svc_name")


def build_label(raw: DataFrame) -> DataFrame:
    """Distinct detailed labels, numbered by name."""
    return _dimension(raw, "detailed_label", "label_id", "label_name")


def history_legend(spark: SparkSession, legend: str = "literal") -> DataFrame:
    rows = [(i, c, d) for i, (c, d) in enumerate(legend_rows(legend), start=1)]
    return spark.createDataFrame(rows, "id long, code string, description string")


def build_session(raw: DataFrame) -> DataFrame:
    return raw.select(
        *S.SESSION_PASS_THROUGH,
        simple_label(F.col("label")).alias("simple_label"),
        "source_file",
    )


def build_satellite(raw: DataFrame, col: str, keep: Sequence[str] = ()) -> DataFrame:
    """`(uid, value)` for the sessions that have the value."""
    return raw.filter(F.col(col).isNotNull()).select("uid", col, *keep)


def build_session_service(raw: DataFrame, service: DataFrame, keep: Sequence[str] = ()) -> DataFrame:
    named = F.col("service").alias("svc_name")
    sessions = raw.filter(F.col("service").isNotNull()).select("uid", named, *keep)
    return lookup_join(sessions, service, "svc_name").select("uid", "svc_id", *keep)


def build_session_label(
    raw: DataFrame, label: DataFrame, on: str = "detailed_label", keep: Sequence[str] = ()
) -> DataFrame:
    """Sessions to label names. `on="label"` joins the simple label instead, which rarely
    equals a name in the dimension of detailed labels."""
    sessions = raw.filter(F.col(on).isNotNull()).select("uid", F.col(on).alias("label_name"), *keep)
    return lookup_join(sessions, label, "label_name").select("uid", "label_id", *keep)


def build_tunnel_parent(raw: DataFrame, keep: Sequence[str] = ()) -> DataFrame:
    return raw.filter(F.col("tunnel_parents").isNotNull()).select(
        F.col("uid").alias("child_uid"), F.col("tunnel_parents").alias("parent_uid"), *keep
    )


def build_session_history(raw: DataFrame, legend: DataFrame, keep: Sequence[str] = ()) -> DataFrame:
    """One row per history character that is in the legend; `index` is 0-based."""
    codes = raw.filter(F.col("history").isNotNull()).select(
        "uid", *keep, F.posexplode(F.split("history", "")).alias("index", "code")
    )
    keys = lookup_join(codes.filter(F.col("code") != ""), legend.select("id", "code"), "code")
    return keys.select("uid", "index", F.col("id").alias("history_id"), *keep)


def build_tables(
    raw: DataFrame, legend: str = "literal", label_on: str = "detailed_label", keep: Sequence[str] = ()
) -> dict[str, DataFrame]:
    """Every normalised table of a raw relation, by name.

    The tables with a row per session also get the columns `keep` of the raw relation.
    """
    codes = history_legend(raw.sparkSession, legend)
    service, label = build_service(raw), build_label(raw)
    tables = {"session": build_session(raw)}
    tables |= {name: build_satellite(raw, col, keep) for name, col in S.SATELLITES.items()}
    tables |= {
        "service": service,
        "session_service": build_session_service(raw, service, keep),
        "label": label,
        "session_label": build_session_label(raw, label, label_on, keep),
        "tunnel_parent": build_tunnel_parent(raw, keep),
        "history_legend": codes,
        "session_history": build_session_history(raw, codes, keep),
    }
    return tables


def table_counts(tables: dict[str, DataFrame]) -> DataFrame:
    counts: list[DataFrame] = [
        t.agg(F.count(F.lit(1)).alias("n")).select(F.lit(name).alias("table_name"), "n")
        for name, t in tables.items()
    ]
    stacked = counts[0]
    for c in counts[1:]:
        stacked = stacked.unionByName(c)
    return stacked
