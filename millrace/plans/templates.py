"""{{ name | filter: arg }} templates, rendered once for each run on the driver."""

from __future__ import annotations

import re
from datetime import datetime, timedelta

_SLOT = re.compile(r"\{\{\s*(.*?)\s*\}\}")


def _value(name: str, now: datetime, variables: dict):
    if name.startswith("vars."):
        return variables.get(name[5:])
    known = {"now": now, "today": now.date(), "yesterday": now.date() - timedelta(days=1), "year": now.year, "month": f"{now.month:02d}", "day": f"{now.day:02d}", "run_id": variables.get("run_id")}
    if name not in known:
        raise ValueError(f"unknown template name {name}")
    return known[name]


def _filter(value, name: str, args: list[str]):
    if name == "default":
        return args[0] if value is None or value == "" else value
    if name == "strftime":
        return value.strftime(args[0])
    text = "" if value is None else str(value)
    if name == "replace":
        return text.replace(args[0], args[1])
    return {"upper": text.upper, "lower": text.lower, "slug": lambda: re.sub(r"[^a-z0-9]+", "-", text.lower()).strip("-"), "safe": lambda: re.sub(r"[^\w.\-]", "_", text)}[name]()


def render(template: str, now: datetime, variables: dict | None = None) -> str:
    def one(m: re.Match) -> str:
        head, *rest = (x.strip() for x in m.group(1).split("|"))
        value = _value(head, now, variables or {})
        for f in rest:
            name, _, args = f.partition(":")
            if "(" in name:
                name, _, args = f.partition("(")
                args = args.rstrip(")")
            value = _filter(value, name.strip(), [a.strip().strip("'\"") for a in args.split(",")] if args else [])
        return "" if value is None else str(value)

    return _SLOT.sub(one, template)


def render_all(value, now: datetime, variables: dict | None = None):
    """Templates in all strings of a document."""
    if isinstance(value, str):
        return render(value, now, variables)
    if isinstance(value, dict):
        return {k: render_all(v, now, variables) for k, v in value.items()}
    return [render_all(v, now, variables) for v in value] if isinstance(value, list) else value
