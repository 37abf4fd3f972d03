"""Names of operators, so that pipelines can be written as documents and users can add operators of their own."""

from __future__ import annotations

import inspect
from collections.abc import Callable
from dataclasses import dataclass, field

from pyspark.sql import DataFrame

from millrace.plans.lineage import Declaration


@dataclass
class Operator:
    name: str
    fn: Callable[..., DataFrame]
    ports: tuple[str, ...]
    params: dict[str, inspect.Parameter]
    lineage: Declaration | None = None
    columns: tuple[str, ...] = field(default=())

    def check(self, params: dict, inputs: dict[str, DataFrame] | None = None) -> list[str]:
        """Problems with the parameters; column parameters are looked up in the first input."""
        found = [f"{self.name}: unknown parameter {k}" for k in params if k not in self.params and not self._open()]
        found += [f"{self.name}: {k} is required" for k, p in self.params.items() if p.default is p.empty and p.kind is not p.VAR_KEYWORD and k not in params]
        if inputs and self.ports:
            have = set(inputs[self.ports[0]].columns)
            for k in self.columns:
                given = params.get(k)
                for c in [given] if isinstance(given, str) else given or []:
                    if isinstance(c, str) and c not in have:
                        found.append(f"{self.name}: no column {c}")
        return found

    def _open(self) -> bool:
        return any(p.kind is p.VAR_KEYWORD for p in self.params.values())


OPERATORS: dict[str, Operator] = {}


def operator(name: str | None = None, ports: tuple[str, ...] = ("df",), columns: tuple[str, ...] = (), lineage: Declaration | None = None):
    """Register a function whose first parameters are the input ports."""

    def add(fn: Callable[..., DataFrame]) -> Callable[..., DataFrame]:
        params = dict(list(inspect.signature(fn).parameters.items())[len(ports) :])
        OPERATORS[name or fn.__name__] = Operator(name or fn.__name__, fn, ports, params, lineage, columns)
        return fn

    return add


def register_op(name: str, fn: Callable[..., DataFrame], ports: tuple[str, ...] = ("df",), lineage: Declaration | None = None) -> None:
    """Add a user's operator; the body may use pandas_udf, applyInPandas or mapInPandas."""
    operator(name, ports, lineage=lineage)(fn)
