"""Plans: no nested-loop or Cartesian join anywhere, pruned columns, pushed filters, one sort for all features of a panel."""

import io
import re
from contextlib import redirect_stdout

import pytest

import __spark_entry__ as entry

CORE = {n: f for m in entry._modules() if ".llm" not in m.__name__ for n, f in m.QUERIES.items()}


def plan(df):
    out = io.StringIO()
    with redirect_stdout(out):
        df.explain("formatted")
    return out.getvalue()


@pytest.mark.parametrize("name", sorted(CORE))
def test_no_pair_of_all_rows(spark, small, name):
    text = plan(CORE[name](spark, small))
    assert "CartesianProduct" not in text and "BroadcastNestedLoopJoin" not in text


def schemas(text, table):
    return [re.findall(r"(\w+):", s) for loc, s in re.findall(r"Location: InMemoryFileIndex \[([^\]]*)\].*?ReadSchema: struct<(.*?)>\n", text, re.S) if f"/{table}.parquet" in loc]


def test_only_needed_columns_are_read(spark, small):
    assert [set(c) for c in schemas(plan(CORE["p2_found"](spark, small)), "harness_results")] == [{"case_id", "msg_id"}]
    for cols in schemas(plan(CORE["p5_found"](spark, small)), "feature_panel"):
        assert set(cols) == {"symbol", "ts", "news_count", "updated_at"}
    for cols in schemas(plan(CORE["calibration"](spark, small)), "orders"):
        assert set(cols) <= {"o_orderkey", "o_custkey", "o_orderstatus"}


def test_filters_reach_the_scan(spark, small):
    text = plan(CORE["keep_first"](spark, small))
    assert re.search(r"PushedFilters: \[[^\]]*IsNotNull\(article_id\)", text)


def test_features_share_a_sort(spark, small):
    text = plan(CORE["price_features"](spark, small))
    assert len(re.findall(r"\(\d+\) Exchange", text)) <= 4


def test_top_k_is_pruned_before_the_shuffle(spark, small):
    assert "WindowGroupLimit" in plan(CORE["top_per_day"](spark, small))
