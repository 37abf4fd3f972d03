"""Pipelines as documents: datasets, nodes and outputs, folded into lazy DataFrames.

{"datasets": [{"id", "format", "uri", "options"}],
 "nodes": [{"id", "op", "inputs": {port: source}, "params": {}}],
 "outputs": [{"name", "source", "sink": {"format", "uri", "mode", "options"}}]}
"""

from __future__ import annotations

from collections import Counter
from collections.abc import Callable
from dataclasses import dataclass
from datetime import UTC, datetime
from functools import partial
from graphlib import CycleError, TopologicalSorter

from pyspark.sql import DataFrame, SparkSession

import millrace.operators  # noqa: F401  registers the operators
from millrace.plans.lineage import origins
from millrace.plans.published import Published, expose, lookup
from millrace.plans.registry import OPERATORS
from millrace.plans.templates import render_all
from millrace.sources import files


def _sources(node: dict) -> list[str]:
    return list((node.get("inputs") or {}).values())


def validate(spec: dict) -> list[str]:
    """Problems that can be found without data: ids, operators, ports, parameters, cycles."""
    ids = [d["id"] for d in spec.get("datasets", [])] + [n["id"] for n in spec.get("nodes", [])]
    found = [f"id {k} is used {n} times" for k, n in Counter(ids).items() if n > 1]
    for n in spec.get("nodes", []):
        op = OPERATORS.get(n["op"])
        if op is None and n["op"] != "subpipeline":
            found.append(f"{n['id']}: unknown operator {n['op']}")
            continue
        found += [f"{n['id']}: no source {s}" for s in _sources(n) if s not in ids]
        if op:
            found += [f"{n['id']}: port {p} is not connected" for p in op.ports if p not in (n.get("inputs") or {})]
            found += [f"{n['id']}: {x}" for x in op.check(n.get("params", {}))]
    found += [f"output {o['name']}: no source {o['source']}" for o in spec.get("outputs", []) if o["source"] not in ids]
    try:
        list(TopologicalSorter({n["id"]: _sources(n) for n in spec.get("nodes", [])}).static_order())
    except CycleError as e:
        found.append(f"cycle: {' -> '.join(map(str, e.args[1]))}")
    return found


@dataclass
class Step:
    """A node as it was built: its operator's name, inputs by port, parameters, result, and for a subpipeline its inside."""

    op: str
    inputs: dict[str, DataFrame]
    params: dict
    frame: DataFrame
    inside: tuple[dict, dict[str, Step], str] | None = None


def _fold(spark: SparkSession, spec: dict, pipelines: dict[str, dict] | Published | None, variables: dict | None, inputs: dict[str, DataFrame] | None, now: datetime, wanted: list[str] | None = None, _open: tuple[str, ...] = ()) -> tuple[dict, dict[str, DataFrame], dict[str, Step]]:
    """(document with templates rendered, DataFrame of each source, built nodes): those that ``wanted`` or else the outputs need."""
    spec = render_all(spec, now, variables)
    if problems := validate(spec):
        raise ValueError("; ".join(problems))
    nodes, datasets = {n["id"]: n for n in spec.get("nodes", [])}, {d["id"]: d for d in spec.get("datasets", [])}
    made: dict[str, DataFrame] = dict(inputs or {})
    steps: dict[str, Step] = {}
    needed, todo = set(), wanted or [o["source"] for o in spec["outputs"]]
    while todo:
        if (s := todo.pop()) not in needed:
            needed.add(s)
            todo += _sources(nodes[s]) if s in nodes else []
    for s in TopologicalSorter({n: _sources(nodes[n]) if n in nodes else [] for n in needed}).static_order():
        if s in made:
            continue
        if s in datasets:
            d = datasets[s]
            made[s] = files.read(spark, d["uri"], d.get("format"), **d.get("options", {}))
            continue
        n = nodes[s]
        params = dict(n.get("params", {}))
        if n["op"] == "subpipeline":
            name, inner = lookup(pipelines, params)
            if name in _open:
                raise ValueError(f"pipeline {name} contains itself")
            bound = {port: made[src] for port, src in (n.get("inputs") or {}).items()}
            inner, values = expose(inner, params.get("params", {}))
            inner, frames, inside = _fold(spark, inner, pipelines, {**(variables or {}), **values}, bound, now, None, (*_open, name))
            by_name = {o["name"]: o["source"] for o in inner["outputs"]}
            source = by_name[params["output_id"]] if "output_id" in params else next(iter(by_name.values()))
            made[s] = frames[source].limit(params["sample_rows"]) if params.get("sample_rows") else frames[source]
            steps[s] = Step(n["op"], bound, params, made[s], (inner, inside, source))
            continue
        op = OPERATORS[n["op"]]
        args = {port: made[n["inputs"][port]] for port in op.ports}
        if problems := op.check(params, args):
            raise ValueError("; ".join(f"{s}: {p}" for p in problems))
        made[s] = op.fn(*args.values(), **params)
        steps[s] = Step(n["op"], args, params, made[s])
    return spec, made, steps


def build(spark: SparkSession, spec: dict, pipelines: dict[str, dict] | Published | None = None, variables: dict | None = None, inputs: dict[str, DataFrame] | None = None, now: datetime | None = None) -> dict[str, DataFrame]:
    """Output name -> DataFrame. Only ancestors of outputs are built; nothing runs. ``inputs`` replaces datasets by id."""
    spec, made, _ = _fold(spark, spec, pipelines, variables, inputs, now or datetime.now(UTC))
    return {o["name"]: made[o["source"]] for o in spec["outputs"]}


def run_pipeline(spark: SparkSession, spec: dict, run_log: str | None = None, now: datetime | None = None, **kw) -> dict[str, DataFrame]:
    """Build the outputs and write those that name a sink; nodes that feed several sinks are cached while they are written."""
    now = now or datetime.now(UTC)
    outputs = build(spark, spec, now=now, **kw)
    spec = render_all(spec, now, kw.get("variables"))
    sinks = [o for o in spec["outputs"] if o.get("sink")]
    shared = [s for s, n in Counter(o["source"] for o in sinks).items() if n > 1]
    for o in sinks:
        if o["source"] in shared:
            outputs[o["name"]].persist()
    rows = []
    for o in sinks:
        sink = o["sink"]
        files.write(outputs[o["name"]], sink["uri"], sink.get("format"), sink.get("mode", "overwrite"), **sink.get("options", {}))
        rows.append((o["name"], now.isoformat(), files.read(spark, sink["uri"], sink.get("format")).count() if sink.get("format", "parquet") == "parquet" else None, ",".join(f"{c}:{t}" for c, t in outputs[o["name"]].dtypes)))
    for o in sinks:
        if o["source"] in shared:
            outputs[o["name"]].unpersist()
    if run_log and rows:
        spark.createDataFrame(rows, "output string, run_at string, rows long, schema string").write.mode("append").parquet(run_log)
    return outputs


def column_lineage(spec: dict, source: str, column: str, spark: SparkSession | None = None, pipelines: dict[str, dict] | Published | None = None, variables: dict | None = None, inputs: dict[str, DataFrame] | None = None, now: datetime | None = None) -> list[dict]:
    """Steps from a column of a node back to the datasets: {node, column, transform, expression, declared, sources: [(node, column)]}.

    Nodes are built as for a run, so names are those that joins, pivots and suffixes really give; operators that run jobs when
    they are called run them. Nodes inside a subpipeline are written ``node/inner``; its datasets that are not bound to an
    input are roots. Columns of datasets are listed with the transform ``source``.
    """
    spark = spark or SparkSession.active()
    spec, _, steps = _fold(spark, spec, pipelines, variables, inputs, now or datetime.now(UTC), [source])
    found: dict[tuple[str, str], dict] = {}

    def walk(spec: dict, steps: dict[str, Step], prefix: str, bound: dict[str, Callable[[str], tuple[str, str]]], source: str, column: str) -> tuple[str, str]:
        """Note the column and what it comes from; the name under which it was noted. ``bound`` maps datasets of a subpipeline to the caller's notes."""
        key = (prefix + source, column)
        if source not in steps:
            if source in bound:
                return bound[source](column)
            found.setdefault(key, {"node": key[0], "column": column, "transform": "source", "expression": None, "declared": True, "sources": []})
            return key
        if key in found:
            return key
        step = steps[source]
        if column not in step.frame.columns:
            raise ValueError(f"{key[0]}: no column {column}")
        wired = next(n for n in spec["nodes"] if n["id"] == source).get("inputs") or {}
        entry = found[key] = {"node": key[0], "column": column, "transform": "subpipeline", "expression": None, "declared": True, "sources": []}
        if step.inside:
            inner, inside, at = step.inside
            outer = {port: partial(walk, spec, steps, prefix, bound, src) for port, src in wired.items()}
            entry["sources"] = [walk(inner, inside, f"{key[0]}/", outer, at, column)]
            return key
        op = OPERATORS[step.op]
        defaults = {k: p.default for k, p in op.params.items() if p.default is not p.empty}
        made = origins(step.inputs, step.params, step.frame.columns, op.lineage, defaults)[column]
        entry |= {"transform": made.transform, "expression": made.expression, "declared": made.declared}
        entry["sources"] = [walk(spec, steps, prefix, bound, wired[port], c) for port, c in sorted(made.sources)]
        return key

    walk(spec, steps, "", {}, source, column)
    return list(found.values())


def trace_column(spec: dict, source: str, column: str, spark: SparkSession | None = None, **kw) -> set[tuple[str, str]]:
    """(dataset, column) pairs that a column of a node comes from; see ``column_lineage``."""
    return {(x["node"], x["column"]) for x in column_lineage(spec, source, column, spark, **kw) if x["transform"] == "source"}
