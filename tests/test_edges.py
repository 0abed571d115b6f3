"""Empty tables, nulls everywhere, and plans that have to stay as they are."""

import os

import duckdb
import pyspark.sql.functions as F
import pytest

from rankspark.operators import select as R
from rankspark.plans import catalogue, readers
from rankspark.schema import RELATIONS
from rankspark.sources import table

#: Queries that need both classes or rows to draw from, and say so.
RAISE = {"holdout_stratified", "lr_fit_relevance", "lr_fit_urgency", "freshness_heads"}


@pytest.fixture(scope="module")
def empty(spark, data, tmp_path_factory):
    root = tmp_path_factory.mktemp("empty")
    for name in os.listdir(data):
        duckdb.sql(f"copy (select * from '{data}/{name}' limit 0) to '{root}/{name}' (format parquet)")
    return str(root)


@pytest.fixture(scope="module")
def nulls(spark, data, tmp_path_factory):
    """The tables with a row of nulls added."""
    root = tmp_path_factory.mktemp("nulls")
    for name in os.listdir(data):
        columns = ", ".join(f"null as {c[0]}" for c in duckdb.sql(f"describe select * from '{data}/{name}'").fetchall())
        duckdb.sql(f"copy (select * from '{data}/{name}' union all by name select {columns}) to '{root}/{name}' (format parquet)")
    return str(root)


@pytest.mark.parametrize("name", sorted(set(catalogue.queries()) - RAISE))
def test_empty_tables(spark, empty, name):
    rows = catalogue.queries()[name](spark, empty).count()
    assert rows == 0 or name in {"tag_ensure", "class_counts", "cache_state_counts", "binary_metrics", "dataset_fingerprint", "model_eval_row"}


@pytest.mark.parametrize("name", sorted(RAISE))
def test_nothing_to_learn_from(spark, empty, name):
    with pytest.raises((RuntimeError, ZeroDivisionError)):
        catalogue.queries()[name](spark, empty).count()


@pytest.mark.parametrize("name", sorted(catalogue.queries()))
def test_rows_of_nulls(spark, nulls, name):
    catalogue.queries()[name](spark, nulls).collect()


def plan(df):
    return df._jdf.queryExecution().toString()


def test_skip_k_never_moves_all_rows_to_one_task(spark, data):
    rows = readers.article_rows(spark, data, "feed_id", "vote", "published_at")
    text = plan(R.skip_k(R.good(rows, readers.AS_OF), 20))
    assert "Window" not in text and "TakeOrderedAndProject" in text


def test_skip_k_runs_its_reader_once(spark, data):
    text = plan(readers.QUERIES["good_train"][0](spark, data)).split("== Physical Plan ==")[1]
    assert not any("FileScan" in line and "entries" in line and "status" in line for line in text.splitlines())


def test_columns_and_filters_reach_the_scan(spark, data):
    text = plan(readers.QUERIES["recent_unread"][0](spark, data))
    assert all("content" not in line for line in text.splitlines() if "ReadSchema" in line)
    for name in ("good_sample", "recent_unread", "missing_urgency", "old_unread_sample", "unlabelled_pool"):
        scans = [line for line in plan(readers.QUERIES[name][0](spark, data)).split("== Physical Plan ==")[1].splitlines() if "FileScan" in line and "published_at" in line]
        assert scans and all("GreaterThanOrEqual(published_at" in line or "DataFilters: [isnotnull(published_at" in line for line in scans), name
        # what is shuffled for the latest state is narrow
        assert all("title" not in line and "url" not in line for line in scans), name
    text = plan(R.urgency_of(table(spark, data, "entries").select(F.col("id").alias("article_id")), table(spark, data, "urgency_inference"), "brisk-linear"))
    assert "EqualTo(model_key,brisk-linear)" in text


def test_random_sample_is_a_top_k(spark, data):
    text = plan(R.old_unread(readers.article_rows(spark, data, "feed_id", "vote", "starred", "published_at"), readers.AS_OF, limit=30))
    assert "TakeOrderedAndProject" in text


def test_schemas_match_the_tables(spark, data):
    for name, relation in RELATIONS.items():
        if os.path.exists(f"{data}/{name}.parquet"):
            wanted = [tuple(c.split()) for c in relation.columns.split(", ")]
            assert [(n, k.replace("bigint", "long")) for n, k in table(spark, data, name).dtypes] == wanted
