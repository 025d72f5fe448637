"""Filter trees of report visuals as predicates by table: what a report's JSON says becomes a model's filter context.

A filter names tables (`From`) and conditions on their columns (`Where`); those of one table are joined by AND. A
condition stays on one table, as a context is kept by table; one over two tables raises.
"""

from __future__ import annotations

import json
import re

#: The comparison kinds by number.
COMPARISONS = {0: "=", 1: ">", 2: ">=", 3: "<", 4: "<="}
Context = dict[str, str]


def quoted(text: str) -> str:
    return "'" + text.replace("\\", "\\\\").replace("'", "\\'") + "'"


def literal(value: str) -> str:
    """A literal as SQL: 'text', 12L, 1.5D, 2.5M, true, null or datetime'2024-01-31T00:00:00'."""
    if value in ("true", "false", "null"):
        return value
    if m := re.fullmatch(r"(-?\d+)L?", value):
        return m[1]
    if m := re.fullmatch(r"(-?\d+(?:\.\d*)?(?:[eE][-+]?\d+)?)D", value):
        return f"{m[1]}D" if "e" not in m[1].lower() else f"cast('{m[1]}' as double)"
    if m := re.fullmatch(r"(-?\d+(?:\.\d+)?)M", value):
        return m[1]
    if m := re.fullmatch(r"datetime'([0-9T:. -]+)'", value):
        return f"timestamp_ntz'{m[1]}'"
    if len(value) >= 2 and value[0] == value[-1] == "'":
        return quoted(value[1:-1].replace("''", "'"))
    raise ValueError(f"no literal: {value}")


class _Tree:
    def __init__(self, tables: dict[str, str]):
        self.tables = tables

    def operand(self, node: dict, used: set[str]) -> str:
        if "Literal" in node:
            return literal(node["Literal"]["Value"])
        if "Column" in node or "Measure" in node:
            inner = node.get("Column") or node["Measure"]
            if "Measure" in node:
                raise ValueError(f"{inner['Property']} is a measure: filter on it after it is evaluated")
            source = inner["Expression"]["SourceRef"]
            used.add(self.tables[source["Source"]] if "Source" in source else source["Entity"])
            return "`" + inner["Property"].replace("`", "``") + "`"
        raise ValueError(f"no operand: {sorted(node)}")

    def condition(self, node: dict, used: set[str]) -> str:
        [(kind, body)] = node.items()
        if kind in ("And", "Or"):
            return f"({self.condition(body['Left'], used)} {kind.upper()} {self.condition(body['Right'], used)})"
        if kind == "Not":
            # null is not among the values, so it stays when they are taken out
            return f"(NOT coalesce({self.condition(body['Expression'], used)}, false))"
        if kind == "Comparison":
            left, right = self.operand(body["Left"], used), self.operand(body["Right"], used)
            sign = COMPARISONS[body["ComparisonKind"]]
            return f"({left} <=> {right})" if right == "null" and sign == "=" else f"({left} {sign} {right})"
        if kind == "Between":
            return f"({self.operand(body['Expression'], used)} BETWEEN {self.operand(body['LowerBound'], used)} AND {self.operand(body['UpperBound'], used)})"
        if kind in ("Contains", "StartsWith", "EndsWith"):
            # the reports' texts are compared without case
            return f"{kind.lower()}(lower({self.operand(body['Left'], used)}), lower({self.operand(body['Right'], used)}))"
        if kind == "In":
            columns = [self.operand(e, used) for e in body["Expressions"]]
            rows = [[self.operand(v, used) for v in row] for row in body["Values"]]
            same = [" AND ".join(f"{c} <=> {v}" for c, v in zip(columns, row, strict=True)) for row in rows]
            return "(" + (" OR ".join(f"({s})" for s in same) or "false") + ")"
        raise ValueError(f"no condition: {kind}")


def context_of(filters: list[dict] | str) -> Context:
    """The predicates of a visual's filters by table. Filters without conditions, as reports keep for fields that nobody filtered, say nothing."""
    filters = json.loads(filters) if isinstance(filters, str) else filters
    out: dict[str, list[str]] = {}
    for f in filters:
        body = f.get("filter")
        if not body:
            continue
        tree = _Tree({t["Name"]: t["Entity"] for t in body.get("From", [])})
        for w in body.get("Where", []):
            used: set[str] = set()
            text = tree.condition(w["Condition"], used)
            if len(used) != 1:
                raise ValueError(f"a condition over {sorted(used) or 'no table'}")
            out.setdefault(used.pop(), []).append(text)
    return {t: " AND ".join(ps) for t, ps in out.items()}
