"""Queries cover whole tables: long documents, short quotes, rows with large ids."""

import os

import pytest
from pyspark.sql import functions as F

from tidemill import plans
from tidemill.functions import text

DATA = "/root/testdata/sf0.001"
needs_tables = pytest.mark.skipif(not os.path.isdir(DATA), reason="needs the test tables")


def test_quotes_are_found_in_long_documents_and_across_white_space(spark, tmp_path):
    passage = "Seven gray herons stood by the weir at dawn and no one spoke."
    items = [(0, passage), (1, "An unrelated item, whose words occur nowhere else."), (2, passage + " Then they left again."), (3, "short"), (4, None)]
    documents = [
        (0, "x y " * 2000 + passage + " z w" * 2000),
        (1, "gray herons stood by the"),
        (2, "SEVEN gray\n\n herons ​stood  by the weir"),
        (3, "nothing of it"),
        (4, None),
        (5, passage + passage),
        (6, "herons stood by"),
    ]
    spark.createDataFrame(items, "item_id long, text string").write.parquet(f"{tmp_path}/benchmark.parquet")
    spark.createDataFrame(documents, "doc_id long, text string").write.parquet(f"{tmp_path}/documents.parquet")
    flat = lambda t: "".join((t or "").lower().replace("​", "").split())
    runs = lambda t: {flat(t)[i : i + 20] for i in range(len(flat(t)) - 19)}
    first, expected = {}, {}
    for k, t in items:
        for piece in runs(t):
            first.setdefault(piece, k)
    for k, t in documents:
        for piece in runs(t) & first.keys():
            expected[k, first[piece]] = expected.get((k, first[piece]), 0) + 1
    found = {(r.doc_id, r.item_id): r.shingles for r in plans.queries()["section_quotes"](spark, str(tmp_path)).collect()}
    assert found == expected and {k for k, _ in found} == {0, 1, 2, 5}


FAR = 1_000_000


def shifted(spark, tmp_path, name, key):
    """A folder whose table ``name`` has the smallest test rows under ids that are FAR higher."""
    t = spark.read.parquet(f"{DATA}/{name}.parquet")
    t.withColumn(key, (F.col(key) + FAR).cast(t.schema[key].dataType)).write.parquet(f"{tmp_path}/{name}.parquet")
    return str(tmp_path)


def same_far_away(spark, tmp_path, name, query, key, found):
    """A query gives the same rows for high ids as for low ones."""
    near, far = (plans.queries()[query](spark, d) for d in (DATA, shifted(spark, tmp_path, name, key)))
    back = lambda df, by: sorted(repr([v - by if c == found else v for c, v in zip(df.columns, r)]) for r in df.collect())
    rows = back(near, 0)
    assert rows and back(far, FAR) == rows


@needs_tables
@pytest.mark.parametrize("query", ["entity_survival", "verbalized", "spoken_back", "respelled"])
def test_sentences_of_orders_with_large_ids(spark, tmp_path, query):
    same_far_away(spark, tmp_path, "orders", query, "o_orderkey", "o_orderkey")


def test_many_sources_meet_by_a_shuffle(spark):
    docs = spark.createDataFrame([(k, f"{k} the quick brown fox jumps over {k}") for k in range(9)], "d long, t string")
    items = spark.createDataFrame([(k, f"the quick brown fox jumps {k}") for k in range(5)], "i long, t string")
    few, many = (sorted(map(tuple, text.quotes(docs, "d", "t", items, "i", "t", 12, most).collect())) for most in (1000, 3))
    assert few == many and len({d for d, _, _ in few}) == 9


@needs_tables
@pytest.mark.parametrize(
    ("name", "query", "key", "found"),
    [
        ("orders", "combined_amounts", "o_orderkey", "o_orderkey"),
        ("lineitem", "result_amounts", "l_orderkey", "l_orderkey"),
        ("events", "leaked_calls", "event_id", "event_id"),
        ("events", "redacted_replies", "event_id", "event_id"),
    ],
)
def test_rows_with_large_ids(spark, tmp_path, name, query, key, found):
    same_far_away(spark, tmp_path, name, query, key, found)


@needs_tables
@pytest.mark.parametrize("query", ["verbalized", "spoken_back", "respelled"])
def test_sentences_of_one_file_are_dealt_over_all_cores(spark, query):
    """Sentences are rewritten behind an exchange into so many parts, which adaptive execution doesn't join again."""
    plan = plans.queries()[query](spark, DATA)._jdf.queryExecution().executedPlan().toString()
    assert f"RoundRobinPartitioning({4 * spark.sparkContext.defaultParallelism})" in plan and "REPARTITION_BY_NUM" in plan


@needs_tables
@pytest.mark.parametrize("query", ["verbalized", "spoken_back", "respelled"])
def test_sentences_are_said_in_batches(spark, query):
    """A sentence goes once through a function over Arrow batches, not through some 150 replacements, about 60 of them patterns."""
    plan = plans.queries()[query](spark, DATA)._jdf.queryExecution().executedPlan().toString()
    assert plan.count("_verbalized(") == 1 and plan.count("regexp_replace(") < 20


@needs_tables
def test_texts_are_compared_before_utterances_are_placed(spark):
    """What is sent to find an utterance's place is its key and whether it changed."""
    plan = plans.queries()["respelled"](spark, DATA)._jdf.queryExecution().executedPlan().toString()
    assert 0 <= plan.find("Window [") < plan.find("concat(now")


@needs_tables
def test_sentences_are_said_and_written_in_one_batch(spark):
    """Both ways are functions of one batch; what is left in the JVM is finding the two numbers."""
    plan = plans.queries()["spoken_back"](spark, DATA)._jdf.queryExecution().executedPlan().toString()
    assert plan.count("_written(_verbalized(") == 1 and "regexp_replace(" not in plan
