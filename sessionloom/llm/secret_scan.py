"""Secret scans through a trigram inverted index.

Each rule's regular expression gives a Boolean query: alternatives of trigrams that every match must
hold. The index maps a trigram to the documents whose folded text has it; it is built over all
documents for the trigrams that the rules' queries name. Intersecting the postings leaves a rule's
candidates, and only those are matched. A rule without mandatory trigrams is matched everywhere.

All of it is DataFrame expressions. Places are code points, ends exclusive, and follow from cutting the
text at its matches: the lengths of what lies between and of the matches, summed up.

Defined cases: a null text is empty and has no spans. Postings of rows with equal (or null) ids are
shared, which may add candidates but no spans; each row is matched for itself. An empty table gives no
rows. Input columns other than the two named are not read.
"""

from __future__ import annotations

import re
from dataclasses import dataclass
from functools import reduce
from itertools import product

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F


@dataclass(frozen=True)
class Rule:
    """`group` is the part of a match that must have `least` characters; shorter matches are dropped."""

    kind: str
    pattern: str
    group: int = 0
    least: int = 0


# The kinds of secrets, in the order in which equal starts are listed.
RULES = [
    Rule(
        "assign",
        r"""(?i:(password|passwd|secret|token|api_?key))["']?\x20*[:=]\x20*["']?([A-Za-z0-9+/_.=-]+)""",
        group=2, least=6,
    ),
    # Runs of these characters are maximal in either form, so the length may stand in the pattern.
    Rule("access", r"AKIA[A-Z0-9]{16,}"),
    Rule("hex", r"[0-9a-f]{24,}"),
]

#: A node with more exact strings than this is not followed further.
MOST_STRINGS = 64


def _exact(node) -> set[str] | None:
    """All strings a part of a pattern can match, case folded, if they are few."""
    op, value = str(node[0]), node[1]
    if op == "LITERAL":
        return {chr(value).lower()}
    if op == "IN" and all(str(o) == "LITERAL" for o, _ in value):
        return {chr(c).lower() for _, c in value}
    if op == "SUBPATTERN":
        return _sequence(value[-1])
    if op == "BRANCH":
        parts = [_sequence(p) for p in value[1]]
        return None if None in parts else set().union(*parts)
    if op in ("MAX_REPEAT", "MIN_REPEAT") and value[1] <= 4:
        once = _sequence(value[2])
        if once is None or len(once) ** value[1] > MOST_STRINGS:
            return None
        return {"".join(p) for n in range(value[0], value[1] + 1) for p in product(once, repeat=n)}
    return None


def _sequence(nodes) -> set[str] | None:
    out = {""}
    for node in nodes:
        some = _exact(node)
        if some is None or len(out) * len(some) > MOST_STRINGS:
            return None
        out = {a + b for a in out for b in some}
    return out


def _trigrams(text: str) -> frozenset[str]:
    return frozenset(text[i : i + 3] for i in range(len(text) - 2))


def trigram_query(pattern: str) -> set[frozenset[str]]:
    """Alternatives of trigrams, case folded, one of which every match holds whole; empty if there is none.

    Runs of parts that match only a few strings are multiplied out; a run of which every string
    has trigrams makes a query, and the one with the most trigrams in its weakest alternative is taken.
    """
    runs, now = [], {""}
    for node in re._parser.parse(pattern):
        some = _exact(node)
        if some is not None and len(now) * len(some) <= MOST_STRINGS:
            now = {a + b for a in now for b in some}
        else:
            runs.append(now)
            least = node[1][0] if "REPEAT" in str(node[0]) else 0
            once = _sequence(node[1][2]) if least else None
            # What must come first of a longer repetition still goes with what stood before it.
            if once is not None and least <= 4 and len(now) * len(once) ** least <= MOST_STRINGS:
                runs[-1] = {a + "".join(p) for a in now for p in product(once, repeat=least)}
            now = {""}
    runs.append(now)
    queries = [{_trigrams(s) for s in run} for run in runs]
    queries = [q for q in queries if all(q)]
    if not queries:
        return set()
    best = max(queries, key=lambda q: min(map(len, q)))
    return {a for a in best if not any(b < a for b in best)}


def trigram_index(docs: DataFrame, id_col: str, text_col: str, trigrams: list[str]) -> DataFrame:
    """Postings (trigram, id): the documents whose folded text has each of `trigrams`."""
    folded = docs.select(F.col(id_col).alias("id"), F.lower(F.col(text_col)).alias("folded"))
    held = F.filter(
        F.array(*[F.when(F.contains("folded", F.lit(t)), F.lit(t)) for t in trigrams]), lambda t: t.isNotNull()
    )
    return folded.select(F.explode(held).alias("trigram"), "id")


def candidates(index: DataFrame, queries: dict[str, set[frozenset[str]]]) -> DataFrame:
    """(id, kinds): the kinds whose query the postings of a document satisfy.

    Postings are intersected as bit sets per document, which are combined before the shuffle. A set is
    as many words of 63 bits as the rules' trigrams need.
    """
    names = sorted({t for q in queries.values() for a in q for t in a})
    place = {t: divmod(i, 63) for i, t in enumerate(names)}

    def bits(word: int) -> Column:
        own = [x for t in names if place[t][0] == word for x in (F.lit(t), F.lit(1 << place[t][1]))]
        return F.coalesce(F.create_map(*own)[F.col("trigram")], F.lit(0))

    words = range(-(-len(names) // 63))
    held = index.groupBy("id").agg(*[F.bit_or(bits(w)).alias(f"held_{w}") for w in words])

    def holds(alternative: frozenset[str]) -> Column:
        wanted = {}
        for word, bit in (place[t] for t in alternative):
            wanted[word] = wanted.get(word, 0) | 1 << bit
        return reduce(lambda a, b: a & b, [F.col(f"held_{w}").bitwiseAND(v) == v for w, v in wanted.items()])

    kinds = [
        F.when(reduce(lambda a, b: a | b, map(holds, query)), F.lit(kind)) for kind, query in queries.items()
    ]
    return held.select("id", F.filter(F.array(*kinds), lambda k: k.isNotNull()).alias("kinds")).filter(
        F.size("kinds") > 0
    )


def _total(lengths: Column) -> Column:
    return F.aggregate(lengths, F.lit(0), lambda a, x: a + x)


def spans(text: Column, rule: Rule, order: int) -> Column:
    """Array of (start, order, end) of the rule's matches, leftmost and without overlaps."""
    pattern = F.lit(rule.pattern)
    between = F.transform(F.split(text, rule.pattern, -1), F.length)
    found = F.transform(F.regexp_extract_all(text, pattern, F.lit(0)), F.length)
    checked = (
        F.transform(F.regexp_extract_all(text, pattern, F.lit(rule.group)), F.length) if rule.group else found
    )
    return F.filter(
        F.transform(
            found,
            lambda n, i: F.struct(
                (_total(F.slice(between, 1, i + 1)) + _total(F.slice(found, 1, i))).alias("start"),
                F.lit(order).alias("order"),
                (_total(F.slice(between, 1, i + 1)) + _total(F.slice(found, 1, i)) + n).alias("end"),
                F.get(checked, i).alias("size"),
            ),
        ),
        lambda s: s["size"] >= rule.least,
    )


def scan_secrets(
    docs: DataFrame, id_col: str = "doc_id", text_col: str = "text", rules: list[Rule] = RULES
) -> DataFrame:
    """(id, found) of every row; `found` is an array of (start, order, end, size) in order.

    `order` is the rule's place in `rules`.
    """
    queries = {r.kind: trigram_query(r.pattern) for r in rules}
    guarded = {k: q for k, q in queries.items() if q}
    rows = docs.select(
        F.col(id_col).alias("id"), F.coalesce(F.col(text_col).cast("string"), F.lit("")).alias("text")
    )
    none = F.array().cast("array<struct<start:int,order:int,end:int,size:int>>")
    if guarded:
        names = sorted({t for q in guarded.values() for a in q for t in a})
        hits = candidates(trigram_index(rows, "id", "text", names), guarded)
        rows = rows.join(hits.withColumnRenamed("id", "_hit"), F.col("id").eqNullSafe(F.col("_hit")), "left")
    parts = []
    for order, rule in enumerate(rules):
        own = spans(F.col("text"), rule, order)
        if rule.kind in guarded:
            own = F.when(F.array_contains(F.coalesce("kinds", F.array().cast("array<string>")), rule.kind), own).otherwise(none)
        parts.append(own)
    return rows.select("id", F.array_sort(F.concat(*parts)).alias("found"))


def rendered(found: Column, rules: list[Rule] = RULES) -> Column:
    """kind:start:end of every span, comma-joined."""
    kinds = F.array(*[F.lit(r.kind) for r in rules])
    return F.array_join(
        F.transform(found, lambda s: F.concat_ws(":", F.get(kinds, s["order"]), s["start"].cast("string"), s["end"].cast("string"))), ","
    )
