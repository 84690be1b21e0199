"""Registered grids have the reference's size, infeasible policies are recorded, and one scan gives what single runs give."""

import pytest

import __spark_entry__ as entry
from tidemark.operators import decisions as D
from tidemark.operators import labels as L
from tidemark.sources import views as V


def test_sizes(spark, small):
    q = entry.queries()
    sweep = q["flat_sweep"](spark, small).collect()
    assert sorted(r["tau"] for r in sweep) == [0.1, 0.15, 0.2, 0.25, 0.3, 0.35, 0.4, 0.45, 0.5, 0.55, 0.6] and sum(r["picked"] for r in sweep) == 1
    policies = q["policy_search"](spark, small).collect()
    assert len(policies) == 245 and all(r["feasible"] == (r["infeasible_reason"] is None) for r in policies)


def test_cells_in_one_scan_equal_single_runs(spark, small):
    bars = V.bars(spark, small).cache()
    cells = {(r["horizon"], r["multiplier"]): r for r in L.label_grid(bars, [1, 5, 20], [0.5, 1.5]).collect()}
    assert set(cells) == {(h, m) for h in (1, 5, 20) for m in (0.5, 1.5)}
    for (h, m), r in cells.items():
        single = L.triple_barrier(bars, h, m, m).toPandas()
        assert len(single) == r["n"] and (single["label"] == single["label_raw"] + 1).all()
        for v, c in ((-1, "down"), (0, "flat"), (1, "up")):
            of = single[single["label_raw"] == v]["realized_return"]
            assert len(of) / len(single) == pytest.approx(r[f"share_{c}"])
            if len(of):
                assert of.median() == pytest.approx(r[f"median_{c}"]) and of.std(ddof=0) == pytest.approx(r[f"std_{c}"])


def test_recall_floor_records_infeasible_policies(spark):
    schema = "actual int, p_down double, p_flat double, p_up double"
    r = D.policy_search(spark.createDataFrame([(a, 0.60, 0.35, 0.05) for a in (0, 2) * 10], schema), [0.0, 0.7], [0.5], [0.0]).collect()
    assert len(r) == 2 and not any(x["feasible"] for x in r) and all("UP recall" in x["infeasible_reason"] for x in r)
    # FLAT has too few rows to count.
    rows = [(0, 0.6, 0.3, 0.1)] * 10 + [(2, 0.1, 0.3, 0.6)] * 10 + [(1, 0.6, 0.3, 0.1)]
    assert D.policy_search(spark.createDataFrame(rows, schema), [0.0], [0.5], [0.0]).first()["feasible"]
