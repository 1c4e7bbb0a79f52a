"""Train and test sets: labels, feature lists, reproducible splits, class balance."""

from __future__ import annotations

import math
from collections.abc import Iterable

from pyspark.ml.feature import VectorAssembler
from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from sessionloom import schemas as S
from sessionloom.operators.joins import lookup_join
from sessionloom.operators.quality import drop_if_present
from sessionloom.session import stable
from sessionloom.sources.tables import with_row_id

# Leading hash digits of a first-level bucket: about a million buckets per class, so that the
# bucket holding a cut has about a millionth of the class.
BUCKET_DIGITS = 5
#: Copies of a row that one task makes at a time.
COPIES = 1000
#: Partitions of a bounded sample that is fitted on.
FIT_PARTITIONS = 8


def label_columns(df: DataFrame) -> list[str]:
    return [c for c in df.columns if c.startswith("label_")]


def build_binary_label(df: DataFrame) -> DataFrame:
    """`binary_label`: 1 if any attack-family flag except `label_attack` is set."""
    found = label_columns(df)
    if not found:
        raise ValueError("no columns starting with 'label_'")
    families = [F.coalesce(F.col(c), F.lit(0)) != 0 for c in found if c != "label_attack"]
    any_set = F.lit(False)
    for f in families:
        any_set = any_set | f
    return df.withColumn("binary_label", F.when(any_set, 1).otherwise(0))


def drop_leaky(df: DataFrame) -> DataFrame:
    """Without the label columns and the features that give the label away."""
    unwanted = label_columns(df) + S.LEAKY_FEATURES + ["binary_label", "simple_label_encoded"]
    return drop_if_present(df, unwanted)


GROUPS = {
    "all": S.ALL_FEATURES,
    "history": S.HISTORY_FEATURES,
    "tabular": S.TABULAR_FEATURES,
}


def feature_group(df: DataFrame, group: str, keep: Iterable[str] = ()) -> DataFrame:
    """All features, the 252 history flags, or the 51 others."""
    if group not in GROUPS:
        raise ValueError(f"group must be one of {', '.join(GROUPS)}")
    return df.select(*keep, *GROUPS[group])


def align_features(df: DataFrame, expected: Iterable[str], keep: Iterable[str] = ()) -> DataFrame:
    """Exactly the expected columns in their order; an absent one is 0."""
    present = set(df.columns)
    return df.select(
        *keep, *[F.col(c) if c in present else F.lit(0).alias(c) for c in expected]
    )


def align_inputs(df: DataFrame, expected: Iterable[str], keep: Iterable[str] = ()) -> DataFrame:
    """`align_features` for what a model's stages read.

    Rows may hold the history flags as columns or as `history_terms`, whichever the model was
    fitted on: the one is derived from the other.
    """
    present = set(df.columns)
    flags = [c for c in S.HISTORY_FEATURES if c in present]
    expected = list(expected)
    derived: dict[str, Column] = {}
    if "history_terms" in expected and "history_terms" not in present:
        names = F.array(*[F.when(F.col(c) != 0, F.lit(c)) for c in flags]).cast("array<string>")
        derived["history_terms"] = F.filter(names, lambda n: n.isNotNull())
    if "history_terms" in present:
        held = F.coalesce("history_terms", F.array().cast("array<string>"))
        derived |= {
            c: F.array_contains(held, c).cast("int") for c in S.HISTORY_FEATURES if c not in present
        }
    cells = [
        F.col(c) if c in present else derived.get(c, F.lit(0)).alias(c) for c in dict.fromkeys(expected)
    ]
    return df.select(*keep, *cells)


def assemble(df: DataFrame, cols: Iterable[str], output: str = "features") -> DataFrame:
    """Columns (numbers or vectors) side by side in one vector column."""
    stage = VectorAssembler(inputCols=list(cols), outputCol=output, handleInvalid="error")
    return stage.transform(df)


def history_matrix(df: DataFrame, name: str = "history_matrix") -> DataFrame:
    """The 252 history flags as one 12 x 21 array."""
    width = len(S.HISTORY_CODES)
    rows = [
        F.array(*S.HISTORY_FEATURES[i * width : (i + 1) * width])
        for i in range(S.HISTORY_POSITIONS)
    ]
    return df.withColumn(name, F.array(*rows)).drop(*S.HISTORY_FEATURES)


# --- splits ----------------------------------------------------------------


def split_hash(key: str, seed: int) -> Column:
    return F.md5(F.concat(F.lit(f"{seed}:"), F.col(key).cast("string")))


def _class_name(label: str) -> Column:
    """The class as text; rows without a class form one of their own, apart from the empty text."""
    return F.coalesce(F.concat(F.lit("="), F.col(label).cast("string")), F.lit(""))


def _test_size(n: int, frac: float) -> int:
    return math.ceil(round(frac * n, 6))


def _bucket_counts(df: DataFrame, key: str, seed: int, label: Column) -> DataFrame:
    """Rows per class and hash bucket, written once: class sizes and cuts both follow from it."""
    hashed = df.select(label.alias("c"), F.substring(split_hash(key, seed), 1, BUCKET_DIGITS).alias("b"))
    return stable(hashed.groupBy("c", "b").agg(F.count(F.lit(1)).alias("n")))


def _largest_remainder(sizes: DataFrame, total: int, draws: int) -> DataFrame:
    """(c, n, drawn): `draws` shared out in proportion to the class sizes `n`, in whole rows."""
    wide = (F.col("n") * F.lit(draws).cast("decimal(19,0)")).cast("decimal(38,0)")
    # Whole-number arithmetic keeps the remainders exact at any size.
    whole = F.expr("cast(_product div _total as bigint)")
    shares = sizes.withColumns({"_product": wide, "_total": F.lit(total).cast("decimal(38,0)")}).select(
        "c", "n", whole.alias("whole"), (F.col("_product") % F.col("_total")).alias("rest")
    )
    given = shares.agg(F.coalesce(F.sum("whole"), F.lit(0)).alias("g")).first()["g"]
    lucky = shares.orderBy(F.desc("rest"), "c").limit(draws - given).select("c", F.lit(1).alias("one"))
    joined = shares.join(lucky, "c", "left")
    return joined.select("c", "n", (F.col("whole") + F.coalesce("one", F.lit(0))).alias("drawn"))


def _cutoffs(df: DataFrame, counted: DataFrame, quotas: DataFrame, key: str, seed: int, label: Column) -> DataFrame:
    """(c, cutoff): per class, the hash up to which (inclusive) its rows make up the quota.

    The counted buckets give the bucket per class in which the quota is reached; a second pass counts
    the hashes of those buckets alone. `quotas` is (c, quota).
    """

    def reached(rows: DataFrame, order: str) -> DataFrame:
        """Per class, the first `order` value whose running count reaches the quota."""
        upto = Window.partitionBy("c").orderBy(order).rowsBetween(Window.unboundedPreceding, 0)
        running = rows.withColumn("upto", F.sum("n").over(upto) + F.col("done"))
        hit = running.filter(F.col("upto") >= F.col("quota"))
        return hit.groupBy("c").agg(
            F.min_by(
                F.struct(F.col(order).alias("at"), (F.col("upto") - F.col("n")).alias("done"), "quota"), order
            ).alias("r")
        ).select("c", "r.*")

    wanted = quotas.filter("quota > 0")
    first = stable(reached(counted.join(wanted, "c").withColumn("done", F.lit(0)), "b"))
    hashed = df.select(label.alias("c"), split_hash(key, seed).alias("h"))
    inside = (
        lookup_join(hashed, first, "c").filter(F.substring("h", 1, BUCKET_DIGITS) == F.col("at"))
        .groupBy("c", "h").agg(F.count(F.lit(1)).alias("n"), F.first("done").alias("done"), F.first("quota").alias("quota"))
    )
    return stable(reached(inside, "h").select("c", F.col("at").alias("cutoff")))


def _marked(df: DataFrame, key: str, seed: int, label: Column, cutoffs: DataFrame) -> DataFrame:
    """One class per row at most meets `cutoffs`, so no row is lost or repeated.

    Rows stay where they are unless the classes are many: dealt by class, a frequent one would be one task's.
    """
    chosen = split_hash(key, seed) <= F.coalesce("_cutoff", F.lit(""))
    joined = lookup_join(df.withColumn("_class", label), cutoffs.toDF("_class", "_cutoff"), "_class", "left")
    return joined.select(*[F.col(f"`{c}`") for c in df.columns], F.when(chosen, 1).otherwise(0).alias("is_test"))


def random_split(df: DataFrame, key: str, frac: float = 0.2, seed: int = 42) -> DataFrame:
    """Add `is_test`: 1 for exactly `ceil(frac * n)` rows, chosen by a hash of the key.

    The choice depends on seed and key only, not on row order or partitioning. Two passes find the
    cutoff hash. `key` should identify rows; rows that share a key stay on the same side.
    """
    everything = F.lit("all")
    counted = _bucket_counts(df, key, seed, everything)
    n = counted.agg(F.coalesce(F.sum("n"), F.lit(0)).alias("n")).first()["n"]
    quotas = df.sparkSession.createDataFrame([("all", _test_size(n, frac))], "c string, quota long")
    return _marked(df, key, seed, everything, _cutoffs(df, counted, quotas, key, seed, everything))


def stratified_split(
    df: DataFrame, key: str, label: str, frac: float = 0.2, seed: int = 42
) -> DataFrame:
    """`random_split` with every class represented in proportion, within one row.

    Classes are rows of a small table joined to the data, so their number is not limited.
    """
    name = _class_name(label)
    counted = _bucket_counts(df, key, seed, name)
    sizes = counted.groupBy("c").agg(F.sum("n").alias("n"))
    total = sizes.agg(F.coalesce(F.sum("n"), F.lit(0)).alias("n")).first()["n"]
    train = _largest_remainder(sizes, max(total, 1), total - _test_size(total, frac))
    quotas = train.select("c", (F.col("n") - F.col("drawn")).alias("quota"))
    return _marked(df, key, seed, name, _cutoffs(df, counted, quotas, key, seed, name))


def stratified_folds(
    df: DataFrame, key: str, label: str, folds: int, name: str = "_fold", seed: int = 42
) -> DataFrame:
    """Add a fold number from 0 on; every fold has its share of every class, within one row.

    A class with fewer rows than folds is an error: it would be missing from some fold.
    """
    classes = _class_name(label)
    counted = _bucket_counts(df, key, seed, classes)
    sizes = stable(counted.groupBy("c").agg(F.sum("n").alias("n")))
    few = sizes.filter(F.col("n") < folds).first()
    if few is not None:
        raise ValueError(f"class {few['c'][1:]!r} of {label!r} has {few['n']} rows, fewer than {folds} folds")
    marked, fold = df, F.lit(0)
    for k in range(1, folds):
        quotas = sizes.select("c", F.ceil(F.col("n") * (folds - k) / folds).cast("long").alias("quota"))
        cuts = _cutoffs(df, counted, quotas, key, seed, classes)
        marked = _marked(marked, key, seed, classes, cuts).withColumnRenamed("is_test", f"_upto_{k}")
        fold = fold + F.col(f"_upto_{k}")
    return marked.withColumn(name, fold.cast("int")).drop(*[f"_upto_{k}" for k in range(1, folds)])


def fit_sample(df: DataFrame, key: str, label: str, max_fit_rows: int, seed: int = 42) -> DataFrame:
    """At most `max_fit_rows` rows, each class in proportion, chosen by a hash of the key.

    For fits that visit every row hundreds of times. The rows are dealt to a fixed number of partitions,
    so that a fit does not depend on how the input was split, and written once: no pass over them reads `df` again.
    """
    n = df.count()
    if n > max_fit_rows:
        df = train_test(stratified_split(df, key, label, (n - max_fit_rows) / n, seed))[0]
    return stable(df.repartition(FIT_PARTITIONS, key))


def train_test(df: DataFrame) -> tuple[DataFrame, DataFrame]:
    """The two sides of a marked relation."""
    return (
        df.filter("is_test = 0").drop("is_test"),
        df.filter("is_test = 1").drop("is_test"),
    )


def capture_split(df: DataFrame, train: str, test: str) -> tuple[DataFrame, DataFrame]:
    """Fit on one capture, evaluate on another."""
    return (
        df.filter(F.col("source_file") == train),
        df.filter(F.col("source_file") == test),
    )


# --- class balance -----------------------------------------------------------


def class_weights(df: DataFrame, label: str) -> DataFrame:
    """Per class `n / (classes * n_class)`."""
    sizes = stable(df.groupBy(label).agg(F.count(F.lit(1)).alias("_n")))
    all_ = sizes.agg(F.sum("_n").alias("rows"), F.count(F.lit(1)).alias("classes")).first()
    return sizes.select(label, (F.lit(all_["rows"]) / (F.lit(all_["classes"]) * F.col("_n"))).alias("weight"))


def with_class_weight(df: DataFrame, label: str, name: str = "weight") -> DataFrame:
    """Each row with the weight of its class."""
    weights = class_weights(df, label).select(F.col(label).alias("_class"), F.col("weight").alias(name))
    joined = lookup_join(df.drop(name), weights, F.col(label).eqNullSafe(F.col("_class")), "left")
    return joined.drop("_class")


def upsample_minority(df: DataFrame, key: str, label: str, seed: int = 42) -> DataFrame:
    """Draw the smaller of the classes 0 and 1 with replacement up to the size of the larger.

    A draw is a pseudo-random place in the minority ordered by key. Draws are counted per place
    first, so the join carries each minority row once, and only keys are numbered; `key` must
    identify rows. A row's copies are made in blocks of `COPIES` that are dealt to all tasks, so
    that a handful of rows can be drawn any number of times. With one class only, the rows are
    returned as they are; a label other than 0, 1, false or true (or without a value) is an error.
    """
    kind = df.schema[label].dataType.simpleString()
    y = F.col(label).cast("int") if kind == "boolean" else F.col(label).cast("double")
    sizes = df.agg(
        F.count_if(y == 1).alias("pos"), F.count_if(y == 0).alias("neg"), F.count(F.lit(1)).alias("n")
    ).first()
    n_pos, n_neg = sizes["pos"], sizes["neg"]
    if n_pos + n_neg != sizes["n"]:
        raise ValueError(f"{label!r} has values other than 0 and 1")
    if not n_pos or not n_neg:
        return df
    smaller, n_small, n_large = (1, n_pos, n_neg) if n_pos < n_neg else (0, n_neg, n_pos)
    minority, majority = df.filter(y == smaller), df.filter(y != smaller)
    digits = F.substring(F.md5(F.concat(F.lit(f"{seed}:"), F.col("id").cast("string"))), 1, 15)
    place = F.conv(digits, 16, 10).cast("bigint") % n_small
    copies = (
        df.sparkSession.range(n_large)
        .groupBy(place.alias("_place"))
        .agg(F.count(F.lit(1)).alias("_copies"))
    )
    places = with_row_id(minority.select(key), [key], "_id").withColumn("_place", F.col("_id") - 1)
    blocks = F.sequence(F.lit(0).cast("bigint"), F.floor((F.col("_copies") - 1) / COPIES))
    per_key = places.join(copies, "_place").select(key, "_copies")
    blocked = minority.join(per_key, key).select("*", F.explode(blocks).alias("_block"))
    dealt = blocked.repartition(key, "_block")
    left = F.least(F.lit(COPIES), F.col("_copies") - F.col("_block") * COPIES).cast("int")
    drawn = dealt.withColumn("_copy", F.explode(F.sequence(F.lit(1), left))).select(df.columns)
    return majority.unionByName(drawn)
