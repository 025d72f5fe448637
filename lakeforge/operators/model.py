"""A star as a graph of relationships, and measures that are evaluated in a filter context.

Relationships go in one direction, from many rows to one, so a filter on a table reaches every table from which a path
of relationships leads to it, and no other. Of several relationships between two tables one is active at most; a
measure may use an inactive one in its place (`using`), take filters off tables (`without`) and add its own (`where`).
One definition of a measure thus serves every date role and every report.

A measure compiles to joins of its own table with the dimensions that its context and its groups name, each once, with
their filters applied before the join, and one aggregation. Measures of several tables meet on their groups only.
"""

from __future__ import annotations

from collections.abc import Iterable
from dataclasses import dataclass, field, replace
from functools import reduce

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F


@dataclass(frozen=True)
class Relation:
    """From `many`[`key`] to `one`[`to`], whose values are distinct."""

    many: str
    one: str
    key: str
    to: str
    active: bool = True


class AmbiguousPath(ValueError):
    """Two paths of relationships lead from one table to another."""


@dataclass(frozen=True)
class Measure:
    """An aggregate over the rows of `table` in a filter context.

    using: keys of inactive relationships that stand in for the active one between the same tables; without: tables
    whose filters don't count; where: more filters, by table, in SQL over its columns.
    """

    table: str
    value: Column
    using: tuple[str, ...] = ()
    without: tuple[str, ...] = ()
    where: dict[str, str] = field(default_factory=dict)

    def by(self, key: str) -> Measure:
        """The same measure through another relationship."""
        return replace(self, using=(*self.using, key))


@dataclass(frozen=True)
class Kept:
    """Of the distinct values that `base` takes in its context, how many `later` takes too: (retained, base, rate).

    `base` and `later` are measures whose value is a column.
    """

    base: Measure
    later: Measure


class Model:
    """Tables by name and the relationships between them."""

    def __init__(self, tables: dict[str, DataFrame], relations: Iterable[Relation]):
        self.tables, self.relations = tables, list(relations)
        for r in self.relations:
            for name, column in ((r.many, r.key), (r.one, r.to)):
                if name in tables and column not in tables[name].columns:
                    raise ValueError(f"{name} has no column {column}")
        pairs = [(r.many, r.one) for r in self.relations if r.active]
        if twice := {p for p in pairs if pairs.count(p) > 1}:
            raise ValueError(f"more than one active relationship between {sorted(twice)}")

    def _out_of(self, table: str, using: tuple[str, ...]) -> list[Relation]:
        mine = [r for r in self.relations if r.many == table]
        swapped = {r.one for r in mine if not r.active and r.key in using}
        return [r for r in mine if (not r.active and r.key in using) or (r.active and r.one not in swapped)]

    def path(self, start: str, end: str, using: tuple[str, ...] = ()) -> list[Relation] | None:
        """The relationships from one table to another; None if there are none. Two different paths raise."""
        found: list[list[Relation]] = []

        def walk(at: str, so_far: list[Relation]) -> None:
            if at == end:
                found.append(so_far)
                return
            for r in self._out_of(at, using):
                if r.one != start and r.one not in {s.one for s in so_far}:
                    walk(r.one, [*so_far, r])

        walk(start, [])
        if len(found) > 1:
            raise AmbiguousPath(f"{start} reaches {end} by " + " and by ".join(" > ".join(f"{r.one}[{r.key}]" for r in p) for p in found))
        return found[0] if found else None

    def rows(self, measure: Measure, groups: list[str], context: dict[str, str]) -> tuple[DataFrame, list[str]]:
        """The rows of the measure's table in its context, with the groups ("Table.column") that reach it, by their names."""
        filters = [(t, p) for t, p in context.items() if t not in measure.without] + list(measure.where.items())
        needed: dict[tuple, Relation] = {}
        where: dict[str, list[str]] = {}
        for t, p in filters:
            way = self.path(measure.table, t, measure.using)
            if way is not None:
                where.setdefault(t, []).append(p)
                needed |= {(r.many, r.one, r.key): r for r in way}
        reached = []
        for g in groups:
            way = self.path(measure.table, g.rsplit(".", 1)[0], measure.using)
            if way is not None:
                reached.append(g)
                needed |= {(r.many, r.one, r.key): r for r in way}
        only = lambda t: reduce(lambda df, p: df.where(p), where.get(t, []), self.tables[t])
        shown = {t: [g.rsplit(".", 1)[1] for g in reached if g.rsplit(".", 1)[0] == t] for t in {r.one for r in needed.values()} | {measure.table}}
        out = only(measure.table)
        out = out.select("*", *(F.col(c).alias(f"{measure.table}.{c}") for c in shown[measure.table]))
        # in the order of the way: a table's key is there before the next table is joined
        left = list(needed.values())
        present = {measure.table}
        while left:
            r = next(r for r in left if r.many in present)
            left.remove(r)
            onward = [n.key for n in needed.values() if n.many == r.one]
            dim = only(r.one).select(F.col(r.to).alias(f"_{r.one}"), *(F.col(c).alias(f"{r.one}.{c}") for c in shown[r.one]), *(F.col(c).alias(f"_{r.one}[{c}]") for c in onward))
            key = F.col(r.key) if r.many == measure.table else F.col(f"`_{r.many}[{r.key}]`")
            out = out.join(dim, key == F.col(f"`_{r.one}`"), "inner" if r.one in where or any(n.many == r.one and n.one in where for n in needed.values()) else "left").drop(f"_{r.one}")
            present.add(r.one)
        return out, reached

    def secured(self, table: str, allowed: DataFrame) -> Model:
        """The model as someone sees it who may see the rows of `table` that `allowed` has, by its column of the same name.

        Every table from which a path leads there keeps the rows that lead to allowed ones; others stay whole, as
        nothing in them belongs to a row of `table`. Two paths raise: it isn't clear then whose a row is.
        """
        [key] = allowed.columns
        seen: dict[str, DataFrame] = {table: self.tables[table].join(allowed, key, "left_semi")}

        def cut(name: str) -> DataFrame:
            if name not in seen:
                way = self.path(name, table)
                if way is None:
                    seen[name] = self.tables[name]
                else:
                    r = way[0]
                    seen[name] = self.tables[name].join(cut(r.one).select(F.col(r.to).alias("_to")), F.col(r.key) == F.col("_to"), "left_semi")
            return seen[name]

        return Model({n: cut(n) for n in self.tables}, self.relations)

    def evaluate(self, measures: dict[str, Measure | Kept], groups: list[str], context: dict[str, str] | None = None) -> DataFrame:
        """One row a combination of groups in which some measure has rows; a measure without rows there is null.

        A measure that a group's table doesn't filter has one value for all of that group's values. Columns are named
        after the groups' columns; context: SQL over a table's columns, by table.
        """
        context = context or {}
        parts, names = [], [g.rsplit(".", 1)[1] for g in groups]
        for name, m in measures.items():
            if isinstance(m, Kept):
                parts.append(self._kept(name, m, groups, context))
                continue
            rows, reached = self.rows(m, groups, context)
            made = rows.groupBy(*(F.col(f"`{g}`").alias(g.rsplit(".", 1)[1]) for g in reached)).agg(m.value.alias(name))
            parts.append((made, [g.rsplit(".", 1)[1] for g in reached]))
        return self._met(parts, names, list(measures))

    def _kept(self, name: str, m: Kept, groups: list[str], context: dict[str, str]) -> tuple[DataFrame, list[str]]:
        sets = []
        for part in (m.base, m.later):
            rows, reached = self.rows(part, groups, context)
            sets.append((rows.select(*(F.col(f"`{g}`").alias(g.rsplit(".", 1)[1]) for g in reached), part.value.alias("_v")).where("_v is not null").distinct(), [g.rsplit(".", 1)[1] for g in reached]))
        (base, by), (later, also) = sets
        shared = [c for c in by if c in also]
        hit = base.join(later.select(*shared, "_v").distinct().withColumn("_hit", F.lit(1)), [*shared, "_v"], "left")
        count = F.struct(F.count("_hit").alias("retained"), F.count("*").alias("base"), F.try_divide(F.count("_hit"), F.count("*")).alias("rate"))
        return hit.groupBy(*by).agg(count.alias(name)), by

    @staticmethod
    def _met(parts: list[tuple[DataFrame, list[str]]], names: list[str], measures: list[str]) -> DataFrame:
        """Measures with the same groups are joined on them; those with fewer are joined to each row of the others."""
        parts = sorted(parts, key=lambda p: -len(p[1]))
        out, have = parts[0]
        for df, by in parts[1:]:
            if not by:
                out = out.crossJoin(F.broadcast(df))  # one row
                continue
            if not set(by) <= set(have):
                raise ValueError(f"measures by {have} and by {by} share no rows")
            same = len(by) == len(have)
            right = df.select(*(F.col(c).alias(f"_{c}") for c in by), *(c for c in df.columns if c not in by))
            on = reduce(lambda a, b: a & b, (F.col(c).eqNullSafe(F.col(f"_{c}")) for c in by))
            out = out.join(right, on, "full_outer" if same else "left")
            if same:  # a row of one side alone has its groups from that side
                out = out.withColumns({c: F.coalesce(F.col(c), F.col(f"_{c}")) for c in by})
            out = out.drop(*(f"_{c}" for c in by))
        return out.select(*(n for n in names if n in out.columns), *measures)


#: The relationships of the semantic model, many to one; the keys are those of this library's star.
STAR = [
    Relation("Vehicle Sale", "Date", "contract_date_key", "date_key"),
    Relation("Vehicle Sale", "Vehicle", "vehicle_sk", "vehicle_sk"),
    Relation("Vehicle Sale", "Customer", "customer_sk", "customer_sk"),
    Relation("Vehicle Sale", "Dealer", "dealer_sk", "dealer_sk"),
    Relation("Vehicle Sale", "Employee", "salesperson_sk", "employee_sk"),
    Relation("Vehicle Sale", "Model", "model_sk", "model_sk"),
    Relation("Vehicle Sale", "Transaction Flag", "flag_sk", "flag_sk"),
    Relation("Repair Order", "Date", "checkin_date_key", "date_key"),
    Relation("Repair Order", "Vehicle", "vehicle_sk", "vehicle_sk"),
    Relation("Repair Order", "Customer", "customer_sk", "customer_sk"),
    Relation("Repair Order", "Dealer", "dealer_sk", "dealer_sk"),
    Relation("Repair Order", "Employee", "service_advisor_sk", "employee_sk"),
    Relation("Repair Order", "Service Type", "service_type_sk", "service_type_sk"),
    Relation("Repair Order Line", "Date", "checkin_date_key", "date_key"),
    Relation("Repair Order Line", "Part", "part_sk", "part_sk"),
    Relation("Repair Order Line", "Vehicle", "vehicle_sk", "vehicle_sk"),
    Relation("Repair Order Line", "Dealer", "dealer_sk", "dealer_sk"),
    Relation("Part Purchase", "Date", "order_date_key", "date_key"),
    Relation("Part Purchase", "Supplier", "supplier_sk", "supplier_sk"),
    Relation("Part Purchase", "Part", "part_sk", "part_sk"),
    Relation("Vehicle Inventory", "Date", "snapshot_date_key", "date_key"),
    Relation("Vehicle Inventory", "Vehicle", "vehicle_sk", "vehicle_sk"),
    Relation("Vehicle Inventory", "Dealer", "dealer_sk", "dealer_sk"),
    Relation("Vehicle Inventory", "Model", "model_sk", "model_sk"),
    Relation("Recall Coverage", "Date", "notified_date_key", "date_key"),
    Relation("Recall Coverage", "Vehicle", "vehicle_sk", "vehicle_sk"),
    Relation("Recall Coverage", "Model", "model_sk", "model_sk"),
    Relation("Data Quality", "Date", "executed_date_key", "date_key"),
    Relation("Dealer Target", "Dealer", "dealer_sk", "dealer_sk"),
    Relation("Service Summary", "Dealer", "dealer_sk", "dealer_sk"),
    Relation("Service Summary", "Service Type", "service_type_sk", "service_type_sk"),
    Relation("Customer", "Province", "city_code", "province_code"),
    Relation("Dealer", "Province", "province_code", "province_code"),
    Relation("Vehicle Sale", "Date", "delivery_date_key", "date_key", active=False),
    Relation("Vehicle Sale", "Date", "invoice_date_key", "date_key", active=False),
    Relation("Vehicle Sale", "Date", "registration_date_key", "date_key", active=False),
    Relation("Repair Order", "Date", "delivery_date_key", "date_key", active=False),
    Relation("Repair Order", "Date", "repair_start_date_key", "date_key", active=False),
    Relation("Recall Coverage", "Date", "completed_date_key", "date_key", active=False),
    Relation("Part Purchase", "Date", "promised_date_key", "date_key", active=False),
    Relation("Part Purchase", "Date", "delivery_date_key", "date_key", active=False),
]


def star(tables: dict[str, DataFrame]) -> Model:
    """The semantic model over the tables that are given: relationships of others are left out.

    A customer and a dealer lie in a province each, so from a sale both ways lead to it: a filter on provinces is
    ambiguous there and raises, unless one of the two tables is not in the model.
    """
    return Model(tables, [r for r in STAR if r.many in tables and r.one in tables])
