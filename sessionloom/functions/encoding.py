"""Feature expressions: every one is a plain column expression, no Python per row."""

from __future__ import annotations

from collections.abc import Iterable

from pyspark.sql import Column
from pyspark.sql import functions as F

from sessionloom import schemas as S


def flag(condition: Column) -> Column:
    """1 where the condition holds, 0 where it does not or is null."""
    return F.when(condition, 1).otherwise(0)


def _flag_of(condition: str, name: str) -> Column:
    """`flag` from SQL text: one call per column, which matters for hundreds of them."""
    return F.expr(f"CASE WHEN {condition} THEN 1 ELSE 0 END AS {name}")


def one_hot(col: str, values: Iterable, prefix: str) -> list[Column]:
    """One flag per value of a column."""
    values = list(values)
    quoted = [f"'{v}'" if isinstance(v, str) else str(v) for v in values]
    return [_flag_of(f"{col} = {q}", n) for q, n in zip(quoted, S.flag_names(prefix, values))]


def time_of_day(ts: Column) -> Column:
    """Seconds since UTC midnight, rounded to the nearest second (86400 can be reached)."""
    seconds = ts.cast("decimal(20,6)") % S.SECONDS_PER_DAY
    return F.round(seconds).cast("int").alias("time_of_day_seconds")


def orig_port_flags(port: Column) -> list[Column]:
    ranges = [
        port <= S.WELL_KNOWN_MAX,
        port.between(S.WELL_KNOWN_MAX + 1, S.REGISTERED_MAX),
        port > S.REGISTERED_MAX,
    ]
    return [flag(r).alias(n) for r, n in zip(ranges, S.ORIG_PORT_COLUMNS)]


def resp_port_flags(port: str, ports: Iterable[int]) -> list[Column]:
    """One flag per listed port, and `other` for everything else including no port."""
    ports = list(ports)
    other = F.when(F.col(port).isin(ports), 0).otherwise(1).alias("resp_port_other")
    return one_hot(port, ports, "resp_port") + [other]


def impute_with_flag(name: str, col: Column | None = None) -> list[Column]:
    """The value with null as 0, and an indicator that it was missing."""
    col = F.col(name) if col is None else col
    value = F.coalesce(col.cast("double"), F.lit(0.0))
    return [value.alias(name), flag(col.isNull()).alias(f"{name}_missing")]


def ipv4_to_int(address: Column) -> Column:
    """Dotted-quad address as an unsigned 32-bit number; anything else is null."""
    parts = F.split(address, r"\.", -1)
    octets = [F.get(parts, i).try_cast("bigint") for i in range(4)]
    dotted_quad = address.rlike(r"^[0-9]{1,3}(\.[0-9]{1,3}){3}$")
    in_range = F.greatest(*octets) <= 255
    return F.when(dotted_quad & in_range, ((octets[0] * 256 + octets[1]) * 256 + octets[2]) * 256 + octets[3])


def simple_label(label: Column) -> Column:
    """The label with every casing of `benign` spelled one way."""
    return F.when(F.lower(label) == S.BENIGN.lower(), S.BENIGN).otherwise(label)


def malicious_flag(label: Column) -> Column:
    return flag(label == S.MALICIOUS)


def attack_flags(detailed_label: Column) -> list[Column]:
    return [
        flag(detailed_label.contains(text)).alias(name)
        for name, (_, text) in zip(S.LABEL_FLAG_COLUMNS, S.ATTACK_FAMILIES)
    ]


def history_codes(history: Column, legend: str = "literal") -> Column:
    """A history string as its array of legend codes; null if no code is left.

    Codes without a legend row are left out and later codes move up, as they do when the
    codes are joined to the legend and gathered again.
    """
    codes = F.filter(
        F.split(history, ""), lambda c: c.isin([code for code, _ in legend_rows(legend)])
    )
    return F.when(F.size(codes) > 0, codes)


def legend_rows(legend: str = "literal") -> list[tuple[str, str]]:
    if legend == "literal":
        return S.HISTORY_LEGEND
    if legend == "full":
        return S.HISTORY_LEGEND + S.LEGEND_EXTRA
    raise ValueError("legend must be 'literal' or 'full'")


def history_flags(codes: str = "history_codes") -> list[Column]:
    """12 positions x 21 codes; a position past the end of the history has no flag set."""
    return [
        _flag_of(f"get({codes}, {i}) = '{code}'", f"history_{i + 1}_{suffix}")
        for i in range(S.HISTORY_POSITIONS)
        for code, suffix in S.HISTORY_CODES
    ]


def history_terms(codes: str = "history_codes") -> Column:
    """The set flags of `history_flags` as the array of their column names."""
    order = F.lit("".join(code for code, _ in S.HISTORY_CODES))
    names = F.array(*[F.lit(n) for n in S.HISTORY_FEATURES])
    first = F.slice(F.col(codes), 1, S.HISTORY_POSITIONS)

    def name(code: Column, position: Column) -> Column:
        # A code without a flag is at place 0; it must not fall into the position before.
        place = F.instr(order, code)
        return F.when(place > 0, F.get(names, position * len(S.HISTORY_CODES) + place - 1))

    terms = F.filter(F.transform(first, name), lambda t: t.isNotNull())
    return F.coalesce(terms, F.array().cast("array<string>"))
