"""The registered model queries fit the operators' own models; small models are fitted whole."""

import inspect
import random

import pytest

from barograph.operators import models as md
from barograph.plans import models as plans
from barograph.schemas import FEATURE_COLUMNS


class Rows:
    def where(self, condition):
        return condition


def test_registered_models_have_the_default_sizes(monkeypatch):
    asked = {}
    for name in ("fit_upside", "fit_risk"):
        shape = inspect.signature(getattr(md, name))

        def fit(*args, _name=name, _shape=shape, **kw):
            bound = _shape.bind(*args, **kw)
            bound.apply_defaults()
            asked[_name] = bound.arguments["trees"], bound.arguments["depth"]

        monkeypatch.setattr(md, name, fit)
    monkeypatch.setattr(plans, "_split_set", lambda spark, sf: Rows())
    monkeypatch.setattr(plans, "materialized", lambda rows: rows)
    plans._fitted(None, "")
    assert asked == {"fit_upside": (200, 6), "fit_risk": (150, 5)}


def _sample(spark, rows: int = 240):
    """Feature vectors in which the first column drives the return and the second one the risk."""
    picked = random.Random(5)
    data = []
    for _ in range(rows):
        x = [picked.uniform(-1, 1) for _ in FEATURE_COLUMNS]
        data.append((*x, 0.3 * x[0] + picked.gauss(0, 0.01), int(x[1] > 0.6)))
    schema = ", ".join(f"{c} double" for c in FEATURE_COLUMNS) + ", label_upside double, label_risk int"
    return spark.createDataFrame(data, schema)


def test_fitted_models_keep_the_contract_and_find_what_drives_the_labels(spark):
    rows = _sample(spark).cache()
    upside, risk = md.fit_upside(rows, trees=4, depth=3, rate=0.3), md.fit_risk(rows, trees=4, depth=3, rate=0.3)
    scored = md.check_output(md.score(rows, upside, risk)).select("pred_a", "risk_prob", "final_score", "label_upside", "label_risk").collect()
    assert len(scored) == 240
    assert all(r.final_score == pytest.approx(r.pred_a * (1 - r.risk_prob)) for r in scored)
    mean = lambda values: sum(values) / len(values)
    assert mean([r.risk_prob for r in scored if r.label_risk]) > mean([r.risk_prob for r in scored if not r.label_risk]) + 0.2
    assert mean([r.pred_a for r in scored if r.label_upside > 0.15]) > mean([r.pred_a for r in scored if r.label_upside < -0.15]) + 0.1
    for model, first in ((upside, FEATURE_COLUMNS[0]), (risk, FEATURE_COLUMNS[1])):
        listed = md.importances(spark, model, "m").collect()
        assert {r.feature for r in listed} == set(FEATURE_COLUMNS) and listed[0].feature == first
        assert all(r.importance >= 0 for r in listed) and sum(r.importance for r in listed) == pytest.approx(1)
    rows.unpersist()


def test_without_a_risk_model_the_score_is_the_upside(spark):
    rows = _sample(spark, 60)
    scored = md.score(rows, md.fit_upside(rows, trees=2, depth=2)).select("pred_a", "risk_prob", "final_score").collect()
    assert all(r.risk_prob is None and r.final_score == r.pred_a for r in scored)


def test_scores_outside_the_contract_are_counted_and_refused(spark):
    rows = spark.createDataFrame([(0.1, 0.5), (float("nan"), 0.5), (None, None), (0.2, 1.5), (float("inf"), float("nan"))],
                                 "pred_a double, risk_prob double")
    assert md.output_faults(rows).first().asDict() == {"rows": 5, "bad_upside": 3, "bad_risk": 2}
    with pytest.raises(ValueError, match="contract"):
        md.check_output(rows)


def test_positives_weigh_as_much_as_negatives(spark):
    rows = spark.createDataFrame([(1,), (0,), (0,), (0,)], "label_risk int")
    assert sorted((r.label_risk, r.weight) for r in md.class_weights(rows).collect()) == [(0, 1.0)] * 3 + [(1, 3.0)]
    alone = spark.createDataFrame([(0,), (0,)], "label_risk int")
    assert [r.weight for r in md.class_weights(alone).collect()] == [1.0, 1.0]
