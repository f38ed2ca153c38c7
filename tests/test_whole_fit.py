"""The evaluation query fits the models that the operator fits by default."""

from types import SimpleNamespace

from catalog import decision_queries
from cropgrid.plans import modelling


def test_evaluation_fits_default_models(spark, monkeypatch):
    seen = {}

    def evaluate(rows, cfg, makers=None):
        seen.update(makers or modelling.default_candidates())
        return SimpleNamespace(metrics=spark.range(1), selected="", promoted=False, intervals={"radius": 0.0})

    monkeypatch.setattr(modelling, "evaluate_candidates", evaluate)
    monkeypatch.setattr(decision_queries, "_training", lambda *_: None)
    decision_queries.yield_model_evaluation(spark, "")
    whole = modelling.default_candidates()
    assert set(seen) == set(whole)
    for name, make in whole.items():
        values = lambda model: {p.name: v for p, v in model.extractParamMap().items()}
        assert values(seen[name](1)) == values(make(1))
