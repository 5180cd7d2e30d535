"""A route table above the bound is an error; its rules don't vanish."""

import pytest

from trafficloom.operators import joins


def test_too_many_routes(spark, monkeypatch):
    monkeypatch.setattr(joins, "SMALL", 2)
    requests = spark.createDataFrame([("/a",)], "path string")
    routes = spark.createDataFrame([(i, f"r{i}", None) for i in range(3)], "ordinal int, route_id string, rule string")
    assert joins.assign_route(requests, routes.limit(2)).count() == 1
    with pytest.raises(ValueError, match="match_prefixes"):
        joins.assign_route(requests, routes)
