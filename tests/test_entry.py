"""Driver contract: entry smoke, registry/oracle coverage, oracle agreement at sf0.001."""

import pytest

import __spark_entry__ as E
from tests.oracle_compare import compare, duck

SF = "/root/testdata/sf0.001"


def test_entry_smoke(spark):
    df = E.entry(spark)
    rows = df.collect()
    assert len(rows) == 5
    assert df.columns == ["funnel_stage", "stage_order", "users", "pct_of_top", "pct_of_prev"]


def test_every_query_has_oracle_or_is_listed():
    from listenflow.plans.registry import NO_ORACLE
    q, o = E.queries(), E.oracle_sql()
    assert set(o) <= set(q)
    assert set(q) - set(o) - set(E.LLM_QUERIES) == NO_ORACLE


@pytest.mark.parametrize("name", ["funnel_overall", "cohort_retention", "user_day7_features",
                                  "free_user_tiers", "premium_churn_users", "genre_by_plan",
                                  "upgrade_click_conversion", "features_describe", "experiment_readout"])
def test_oracle_agreement_small(spark, name):
    con = duck(SF)
    r = compare(spark, name, E.queries()[name], E.oracle_sql()[name], SF, con)
    assert r["ok"], r


def test_model_auc_and_importance(spark):
    auc = E.queries()["conversion_model_auc"](spark, "/root/testdata/sf0.01").collect()
    assert len(auc) == 1 and (auc[0].auc is None or 0.0 <= auc[0].auc <= 1.0)
    imp = E.queries()["conversion_model_importance"](spark, "/root/testdata/sf0.01").collect()
    assert len(imp) == 10 and abs(sum(r.importance for r in imp) - 1.0) < 1e-6


def test_conversion_model_invariants(spark):
    df = E.queries()["conversion_model"](spark, "/root/testdata/sf0.01")
    rows = df.collect()
    assert rows and all(0.0 <= r.probability <= 1.0 for r in rows)
    from listenflow.operators.model import score_auc
    auc = score_auc(df.where("held_out"), "probability", "converted").collect()[0]
    assert auc.auc is None or 0.0 <= auc.auc <= 1.0
