"""Each stage on its own input, and the pipeline end to end."""

import corpus_pipeline as P
from test_decontaminate import brute as contamination
from test_simhash import naive_print, roots

from sessionloom.llm.queries import table


def test_stages(spark, sf_dir, tmp_path):
    docs, seen = table(spark, sf_dir, "documents"), {}
    for k, (name, stage) in enumerate(P.STAGES):
        out = stage(spark, docs, sf_dir)
        out.write.parquet(str(tmp_path / name))
        before, docs = docs, spark.read.parquet(str(tmp_path / name))
        seen[name] = before, docs
        if k < 4:
            assert docs.dtypes == before.dtypes
    ids = lambda df: {r.doc_id for r in df.select("doc_id").collect()}

    before, after = seen["line_dedup"]
    assert ids(before) == ids(after)
    assert all(r.n_chars == len(r.text) for r in after.collect())

    before, after = seen["near_dedup"]
    prints = {r.doc_id: naive_print(r.text) for r in before.collect()}
    root, least = roots(prints.values()), {}
    for i in sorted(prints):
        least.setdefault(root[prints[i]], i)
    assert ids(after) == set(least.values())

    before, after = seen["decontaminate"]
    items = [(r.item_id, r.text) for r in table(spark, sf_dir, "benchmark").collect()]
    judged = contamination([(r.doc_id, r.text) for r in before.collect()], items)
    assert ids(after) == {i for i, (n, hit, _) in judged.items() if not (hit > 0 and 20 * hit >= n)}

    before, after = seen["packing"]
    assert ids(before) == ids(after)


def test_run(spark, sf_dir):
    assert P.run(spark, sf_dir).count() > 0


def test_one_row_stays_of_repeated_and_null_ids(spark, sf_dir):
    a, b = "one two three four five six seven", "eight nine ten eleven twelve thirteen"
    df = spark.createDataFrame([(1, a), (1, a), (None, a), (2, a), (None, b), (None, b)], "doc_id long, text string")
    got = sorted(((x.doc_id, x.text) for x in P.near_dedup(spark, df, sf_dir).collect()), key=str)
    assert got == [(1, a), (None, b)]
