"""The registered detectors and classifiers run with the reference's parameters."""
import inspect

import pytest

from tidewire import config
from tidewire.operators import classify as cl, iforest as fo
from tidewire.plans import model_queries as mq


class Stop(Exception):
    pass


def _arguments(monkeypatch, owner, name, call):
    real, seen = getattr(owner, name), {}

    def stub(*args, **kwargs):
        bound = inspect.signature(real).bind(*args, **kwargs)
        bound.apply_defaults()
        seen.update(bound.arguments)
        raise Stop

    monkeypatch.setattr(owner, name, stub)
    with pytest.raises(Stop):
        call()
    return seen


@pytest.mark.parametrize("query", ["forest_scores", "forest_summary", "embedding_forest", "ensemble_results"])
def test_forests_have_all_trees(spark, monkeypatch, query):
    seen = _arguments(monkeypatch, fo, "fit_iforest", lambda: getattr(mq, query)(spark, "/root/testdata/sf0.001"))
    used = {**config.FOREST_PARAMS, **(seen["params"] or {})}
    assert (used["trees"], used["members"]) == (300, 3)


@pytest.mark.parametrize("query", ["classifier_report", "classifier_predictions"])
def test_classifiers_search_the_whole_grid(spark, monkeypatch, query):
    seen = _arguments(monkeypatch, cl, "train", lambda: getattr(mq, query)(spark, "/root/testdata/sf0.001"))
    grid = cl.GRIDS if seen["grids"] is None else seen["grids"]
    assert grid == {"logistic_regression": {"C": [0.01, 0.1, 1.0, 10.0], "vocabulary": [1000, 3000]},
                    "svm": {"C": [0.1, 1.0, 10.0], "loss": ["hinge", "squared_hinge"]}}
    assert (seen["folds"], seen["max_iter"], seen["size"], seen["least"]) == (5, 1000, 2000, 10)
