"""Where columns come from: operators declare the origins of what they make, and declarations are composed over a pipeline.

A declaration is called with the operator's inputs by port, all its parameters (defaults included) and the names of its
output columns; it returns the origins of the outputs that it makes. Outputs it leaves out come from the column of that
name in the first port that has one; any other is counted to all columns that the parameters name, or else to all inputs.
An origin lists the columns whose values a value is made of: filters, keys and orders choose rows and are not listed,
except where the value is a rank.
"""

from __future__ import annotations

from collections.abc import Callable, Iterable
from dataclasses import dataclass
from typing import Any

from pyspark.errors import AnalysisException
from pyspark.sql import Column, DataFrame

Inputs = dict[str, DataFrame]


@dataclass(frozen=True)
class Origin:
    """(port, column) pairs that a value is made of, and how; ``declared`` is False where nothing better than a guess is known."""

    sources: frozenset[tuple[str, str]]
    transform: str
    expression: str | None = None
    declared: bool = True


Declaration = Callable[[Inputs, dict[str, Any], list[str]], dict[str, Origin]]


def origin(port: str, columns: str | Iterable[str], transform: str, expression: str | None = None) -> Origin:
    return Origin(frozenset((port, c) for c in ([columns] if isinstance(columns, str) else columns)), transform, expression)


def names_in(value: Any) -> set[str]:
    """All strings of a parameter, those in lists and in the values of dicts included."""
    if isinstance(value, str):
        return {value}
    if isinstance(value, dict):
        return {s for v in value.values() for s in names_in(v)}
    return {s for v in value for s in names_in(v)} if isinstance(value, list | tuple) else set()


def columns_read(df: DataFrame, value: Column, text: str) -> set[str]:
    """Columns that an expression reads: those without which it no longer resolves. Spark analyses it; no job runs."""
    bare = df.sparkSession.createDataFrame([], df.schema)

    def resolves(frame: DataFrame) -> bool:
        try:
            return bool(frame.select(value).columns)
        except AnalysisException:
            return False

    return {c for c in df.columns if c.lower() in text.lower() and not resolves(bare.drop(c))}


def by_expression(out: str, text: str, parse: Callable[[str], Column]) -> Declaration:
    """The column that parameter ``out`` names is made by the expression in parameter ``text``."""

    def declare(inputs: Inputs, p: dict, outputs: list[str]) -> dict[str, Origin]:
        port, df = next(iter(inputs.items()))
        return {p[out]: origin(port, columns_read(df, parse(p[text]), p[text]), "expression", p[text])}

    return declare


def computed(out: str, *reads: str, transform: str = "computed") -> Declaration:
    """The column that parameter ``out`` names is made of the columns that the parameters ``reads`` name."""

    def declare(inputs: Inputs, p: dict, outputs: list[str]) -> dict[str, Origin]:
        port, df = next(iter(inputs.items()))
        return {p[out]: origin(port, names_in([p[r] for r in reads]) & set(df.columns), transform)}

    return declare


def constant(out: str, value: str) -> Declaration:
    return lambda inputs, p, outputs: {p[out]: Origin(frozenset(), "constant", None if p[value] is None else str(p[value]))}


def per_column(param: str, transform: str) -> Declaration:
    """Each output whose name starts with a column of parameter ``param`` is made of it alone; the longest such column counts."""

    def declare(inputs: Inputs, p: dict, outputs: list[str]) -> dict[str, Origin]:
        port, df = next(iter(inputs.items()))
        own, made = sorted(names_in(p[param]) & set(df.columns), key=len, reverse=True), {}
        for o in outputs:
            if o in own:
                made[o] = origin(port, o, transform)
            elif o not in df.columns and (c := next((c for c in own if o.startswith(c)), None)):
                made[o] = origin(port, c, transform)
        return made

    return declare


def both_ports(inputs: Inputs, p: dict, outputs: list[str]) -> dict[str, Origin]:
    """Rows of all ports under one another, columns by name."""
    return {o: Origin(frozenset((port, o) for port, df in inputs.items() if o in df.columns), "union") for o in outputs}


def origins(inputs: Inputs, params: dict, outputs: list[str], declare: Declaration | None, defaults: dict | None = None) -> dict[str, Origin]:
    """Origin of every output column of one step."""
    full = {**(defaults or {}), **params}
    made = declare(inputs, full, outputs) if declare else {}
    named = names_in(list(params.values()))
    guess = frozenset((port, c) for port, df in inputs.items() for c in df.columns if c in named)
    guess = guess or frozenset((port, c) for port, df in inputs.items() for c in df.columns)
    found = {}
    for o in outputs:
        port = next((port for port, df in inputs.items() if o in df.columns), None)
        found[o] = made.get(o) or (origin(port, o, "passthrough") if port else Origin(guess, "computed", declared=False))
    return found
