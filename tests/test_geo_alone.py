"""Queries that use the geo clusters alone fit no forest."""
from roadpulse.operators import ml
from roadpulse.plans import catalog


def test_geo_queries_fit_no_forest(spark, sf_dir, monkeypatch):
    def fails(*args, **kw):
        raise AssertionError("a forest was asked for")

    monkeypatch.setattr(ml, "fit_all", fails)
    monkeypatch.setattr(catalog, "_MODEL_CACHE", {})
    n = catalog.requests_df(spark, sf_dir).count()
    told = catalog.QUERIES["geo_cluster_assignment"](spark, sf_dir).collect()[0]
    assert (told.n_requests, told.not_at_nearest, told.n_centres) == (n, 0, 50)
    placed = catalog.QUERIES["geo_clusters"](spark, sf_dir)
    assert placed.where("geo_cluster is not null").count() == n
    assert catalog.QUERIES["assemble_features"](spark, sf_dir).count() == n


def test_forests_take_the_fitted_clusters(history, monkeypatch):
    km = ml.fit_geo_clusters(history, n_init=1)
    monkeypatch.setattr(ml, "fit_geo_clusters", None)
    weak = {name: dict(p, numTrees=1, maxDepth=1) for name, p in ml.DEFAULT_PARAMS.items()}
    models, data = ml.fit_all(history, weak, km=km)
    data.unpersist()
    assert models["geo_kmeans"] is km
