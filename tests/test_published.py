"""Published pipelines: immutable versions, pins, exposed parameters."""

from __future__ import annotations

import pytest

from millrace.plans.pipeline import build
from millrace.plans.published import Published, digest


def _inner(predicate: str) -> dict:
    return {
        "datasets": [{"id": "src", "uri": "x"}],
        "nodes": [{"id": "n", "op": "filter_rows", "inputs": {"df": "src"}, "params": {"predicate": predicate}, "ui": {"exposedParams": {"predicate": {"alias": "keep"}}}}],
        "outputs": [{"name": "o", "source": "n"}],
    }


def _outer(**params) -> dict:
    return {"datasets": [{"id": "a", "uri": "x"}], "nodes": [{"id": "s", "op": "subpipeline", "inputs": {"src": "a"}, "params": {"pipeline_id": "inner", **params}}], "outputs": [{"name": "o", "source": "s"}]}


def test_a_republish_leaves_pinned_runs_unchanged(spark, tmp_path):
    store = Published(spark, str(tmp_path / "published"))
    run = lambda spec: sorted(r.id for r in build(spark, spec, store, inputs={"a": spark.range(5)})["o"].collect())
    with pytest.raises(ValueError, match="no one version"):
        run(_outer())
    first = store.publish("inner", _inner("id < 2"))
    pinned = store.pin(_outer())
    middle = store.publish("middle", {**_outer(), "datasets": [{"id": "a", "uri": "x"}]})
    assert run(_outer()) == run(pinned) == [0, 1]
    second = store.publish("inner", _inner("id >= 3"))
    assert store.publish("inner", _inner("id < 2")) == first != second
    assert [(r.version, r.digest) for r in store.versions("inner").orderBy("version").collect()] == [(1, first), (2, second)]
    assert run(pinned) == run(_outer(version=1)) == run(_outer(version=first[:12])) == [0, 1]
    assert run(_outer()) == run(_outer(version=2)) == [3, 4]
    assert run(_outer(pipeline_id="inner@1")) == [0, 1]
    through = {**_outer(), "nodes": [{"id": "s", "op": "subpipeline", "inputs": {"a": "a"}, "params": {"pipeline_id": "middle", "version": middle}}]}
    assert run(through) == [0, 1]  # what was published inside a version is pinned too
    assert run(_outer(version=1, params={"keep": "id = 4"})) == [4]
    for wrong in (3, "abc", "0" * 64):
        with pytest.raises(ValueError):
            run(_outer(version=wrong))
    with pytest.raises(ValueError):
        build(spark, _outer(version=1), {"inner": _inner("id < 2")}, inputs={"a": spark.range(5)})


def test_digests_do_not_depend_on_the_order_of_keys():
    assert digest({"a": 1, "b": [{"c": "é", "d": 2}]}) == digest({"b": [{"d": 2, "c": "é"}], "a": 1}) != digest({"a": 1, "b": [{"c": "é", "d": 3}]})
