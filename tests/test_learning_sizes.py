"""The registered learning queries run the whole job of the reference."""

import pytest

from cadenza.operators import model
from cadenza.plans import catalog


class _Seen(Exception):
    pass


def _record(monkeypatch, name, calls, stop):
    def fake(*args, **kw):
        calls[name] = kw
        if stop:
            raise _Seen
        return None, None, None
    monkeypatch.setattr(model, name, fake)


def test_sizes_grid_and_candidates(spark, monkeypatch):
    monkeypatch.setattr(catalog, "_prepared", lambda s, d: (model, [], None, None, [], {}))
    calls = {}
    for name in ("tune_forest", "train_classifiers", "train_regressors"):
        _record(monkeypatch, name, calls, True)
    with pytest.raises(_Seen):
        catalog._build_tuned(spark, "")
    assert set(calls) == {"tune_forest"}            # the tuned forest waits for no classifier
    for run in (lambda: catalog._build_confusion(spark, ""), lambda: catalog.QUERIES["reg_forest"](spark, ""),
                lambda: catalog.QUERIES["clf_gbt_ovr"](spark, "")):
        calls.pop("train_classifiers", None)
        with pytest.raises(_Seen):
            run()
        for kw in calls.values():
            assert kw.get("sizes") in (None, model.Sizes()) and "grid" not in kw
        if not calls.get("train_regressors") and "names" in calls["train_classifiers"]:
            raise AssertionError("the best classifier must be picked out of all")
    assert (model.Sizes().trees, model.Sizes().forest_depth, model.Sizes().boost_rounds) == (100, 15, 100)
