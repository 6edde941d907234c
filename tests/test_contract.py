"""The registered queries: reference SQL on the small tables, and the shape of their plans."""

import sys
from pathlib import Path

import pytest

sys.path.insert(0, str(Path(__file__).resolve().parents[1] / "tools"))
import check_oracle  # noqa: E402

import __spark_entry__ as contract  # noqa: E402

SAMPLE = ["similar_items", "recommend_item_based", "similar_content", "similar_genre", "categorized", "hybrid_cascade", "explain_content",
          "evaluate_user", "impute_median", "extract_credits", "enrichment_report", "session_funnel", "user_features", "autocomplete", "feature_cosine"]


@pytest.fixture(scope="module")
def duck(folder):
    return check_oracle.reference(folder)


@pytest.mark.parametrize("name", SAMPLE)
def test_query_equals_its_sql(spark, duck, folder, name):
    good, note = check_oracle.compare(spark, duck, folder, name, contract.oracle_sql()[name])
    assert good, note


def test_every_reference_sql_has_a_query():
    assert set(contract.oracle_sql()) <= set(contract.queries())


@pytest.mark.parametrize("name", ["similar_items", "recommend_user_based", "similar_genre", "popular_that_year", "user_features", "explain_user_cf"])
def test_plans_have_no_cross_join_and_no_python_rows(spark, folder, name):
    plan = contract.queries()[name](spark, folder)._jdf.queryExecution().executedPlan().toString()
    assert "CartesianProduct" not in plan and "BatchEvalPython" not in plan and "NestedLoop" not in plan


def test_entry_reads_only_what_it_needs(spark):
    plan = contract.entry(spark)._jdf.queryExecution().executedPlan().toString()
    assert "l_comment" not in plan and "o_totalprice" not in plan
