"""The registered model queries train the whole job of their operators."""

import pytest

from rekindle.operators import factors, gradient, hybrid, implicit
from rekindle.plans import registered, tables

MODELS = {
    "temporal_svd_topk": (factors, "temporal_svd"), "nmf_topk": (factors, "nmf"), "bm25_als_topk": (implicit, "bm25_als"),
    "svdpp_topk": (gradient, "svdpp"), "bpr_topk": (gradient, "bpr"), "autoencoder_topk": (gradient, "autoencoder"),
    "fm_topk": (hybrid, "factorization_machine_model"), "hybrid_topk": (hybrid, "lightfm_style"),
}


@pytest.mark.parametrize("name", MODELS)
def test_registered_models_use_the_defaults(monkeypatch, name):
    class Parts:
        train = test = "rows"

    asked = []
    for name_of in ("order_split", "with_part_features", "with_segment"):
        monkeypatch.setattr(tables, name_of, lambda *a, _n=name_of: Parts if _n == "order_split" else "rows")
    monkeypatch.setattr(registered, "model_lists", lambda model, parts: model)
    monkeypatch.setattr(*MODELS[name], lambda *a, **b: asked.append((a, b)))
    registered.QUERIES[name](None, "")
    assert asked == [(("rows",), {})]
