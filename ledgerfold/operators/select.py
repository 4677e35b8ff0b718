"""SELECT: binding, filtering and projecting one table; joins, groups and order in the extended profile."""

from __future__ import annotations

from collections.abc import Callable
from dataclasses import dataclass

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from ledgerfold.errors import InvalidQuery, Unsupported
from ledgerfold.functions.cells import Typed, compare, is_null, order_columns
from ledgerfold.functions.values import ValueType
from ledgerfold.operators.scan import KEY, ROW_ID, Scan
from ledgerfold.plans import ir
from ledgerfold.plans.exprs import Compiler, UnknownColumn, conjuncts


@dataclass
class Selected:
    """A result frame: output columns named by place, their names and types, and what orders it."""

    df: DataFrame
    columns: list[ir.ResultColumn]
    typed: list[Typed]
    order: list[Column]

    def named(self) -> DataFrame:
        """The frame with the result's own column names, in no particular order."""
        return self.df.select(*[t.col.alias(c.name) for t, c in zip(self.typed, self.columns, strict=True)])


def select_strict(query: ir.Select, scan: Scan) -> Selected:
    """Scan, filter, project; rows come in the order of their ids."""
    table = query.source.table
    if query.source.joins or query.aggregates or query.group_by or query.order_by or query.having is not None or query.limit is not None or query.offset is not None:
        raise Unsupported("complex SELECT")
    projection = project(query.projection, {table: scan}, lambda c: table)

    def lookup(c: ir.QueryColumn) -> Typed:
        if c.table and c.table != table:
            raise UnknownColumn("Unknown column table")
        if c.column not in scan.columns:
            raise UnknownColumn("Unknown predicate column")
        return scan.columns[c.column]

    df = scan.df
    if query.predicate is not None:
        df = df.where(Compiler(lookup).root(query.predicate))
    return Selected(df, [p[0] for p in projection], [p[1] for p in projection], [F.col(ROW_ID)] if scan.keyed else [])


def project(items, scans: dict[str, Scan], owner: Callable[[ir.QueryColumn], str]) -> list[tuple[ir.ResultColumn, Typed]]:
    out = []
    for c in items:
        if c.column == "*":
            wanted = [c.table] if c.table in scans and len(scans) == 1 else list(scans)
            if c.table and c.table not in scans:
                raise InvalidQuery("Unknown projection table")
            for t in wanted:
                out += [(ir.ResultColumn(n, t, n), scans[t].columns[n]) for n in scans[t].names]
            continue
        if c.table and c.table not in scans:
            raise InvalidQuery("Unknown projection table")
        table = owner(c)
        if table is None or c.column not in scans[table].columns:
            raise InvalidQuery("Unknown projection column")
        out.append((ir.ResultColumn(c.alias or c.column, table, c.column), scans[table].columns[c.column]))
    return out


def select_extended(query: ir.Select, scan_of: Callable[[str], Scan]) -> Selected:
    """The whole of the query representation, lowered to one DataFrame plan."""
    first = query.source.alias or query.source.table
    tables: dict[str, Scan] = {}
    df = None
    for alias, table, join in [(first, query.source.table, None), *[(j.alias or j.table, j.table, j) for j in query.source.joins]]:
        if alias in tables:
            raise InvalidQuery("Repeated table name")
        scan = scan_of(table)
        n = len(tables)
        renamed = scan.df.select(*[F.col(c).alias(f"_t{n}{c}") for c in scan.df.columns])
        columns = {
            name: Typed(F.col(f"_t{n}_c{i}"), t.rank, opaque=t.opaque, key=F.col(f"_t{n}{KEY}") if t.key is not None else None, mixed=t.mixed)
            for i, (name, t) in enumerate((name, scan.columns[name]) for name in scan.names)
        }
        tables[alias] = Scan(renamed, scan.schema, columns, scan.keyed)
        if df is None:
            df = renamed
        else:
            on = Compiler(lambda c: _lookup(tables, c), True)
            df = df.join(renamed, on.root(join.on), {"inner": "inner", "left": "left", "right": "right", "full": "full_outer"}[join.kind])
    compiler = Compiler(lambda c: _lookup(tables, c), True)
    for part in conjuncts(query.predicate):
        negated = isinstance(part, ir.Not) and isinstance(part.expr, (ir.InSubquery, ir.Exists))
        inner = part.expr if negated else part
        if isinstance(inner, ir.InSubquery) or (isinstance(inner, ir.Exists) and isinstance(inner.expr, ir.Select)):
            df = _semi_join(df, inner, negated, compiler, scan_of)
        else:
            df = df.where(compiler.root(part))
    items = query.items or (*query.projection, *query.aggregates)
    grouped = bool(query.aggregates or query.group_by or query.having is not None)
    if not grouped:
        outputs: list[tuple[ir.ResultColumn, Typed]] = []
        for item in items:
            outputs += project([item], tables, lambda c: _owner(tables, c))
        by_name = {c.name: t for c, t in outputs}
        order = []
        for o in query.order_by:
            typed = by_name[o.by.column] if not o.by.table and o.by.column in by_name else _lookup_or_fail(tables, o.by)
            order += [c.desc_nulls_last() if o.descending else c.asc_nulls_first() for c in order_columns(typed)]
        if query.distinct:
            kept = df.select(*[t.col.alias(f"_o{i}") for i, (_, t) in enumerate(outputs)])
            typed = [Typed(F.col(f"_o{i}"), t.rank, opaque=t.opaque) for i, (_, t) in enumerate(outputs)]
            kept = kept.distinct()
            order = []
            for o in query.order_by:
                at = next((i for i, (c, _) in enumerate(outputs) if o.by.column in (c.name, c.source_column)), None)
                if at is None:
                    raise InvalidQuery("Unknown ORDER BY column")
                order += [c.desc_nulls_last() if o.descending else c.asc_nulls_first() for c in order_columns(typed[at])]
            return _limited(query, Selected(kept, [c for c, _ in outputs], typed, order))
        if not order and len(tables) == 1 and tables[first].keyed:
            order = [F.col(f"_t0{ROW_ID}")]
        return _limited(query, Selected(df, [c for c, _ in outputs], [t for _, t in outputs], order))
    return _limited(query, _aggregated(query, df, tables, items))


def _aggregated(query: ir.Select, df: DataFrame, tables: dict[str, Scan], items) -> Selected:
    keys = [(c, _lookup_or_fail(tables, c)) for c in query.group_by]
    wanted = list(query.aggregates)

    def walk(e):
        if isinstance(e, ir.Aggregate):
            wanted.append(e)
        for part in ("left", "right", "expr"):
            if (x := getattr(e, part, None)) is not None and not isinstance(e, ir.Aggregate):
                walk(x)

    if query.having is not None:
        walk(query.having)
    calls = {(a.function, a.columns, a.distinct): a for a in wanted}
    numbered = {call: i for i, call in enumerate(calls)}
    columns, ranks = [], []
    for a in calls.values():
        col, rank = _aggregate(a, [_lookup_or_fail(tables, c) for c in a.columns])
        columns.append(col.alias(f"_a{len(columns)}"))
        ranks.append(rank)
    grouped = df.groupBy(*[t.col.alias(f"_g{i}") for i, (_, t) in enumerate(keys)])
    out = grouped.agg(*(columns or [F.count(F.lit(1)).alias("_n")]))
    key_typed = {(c.table, c.column): Typed(F.col(f"_g{i}"), t.rank, opaque=t.opaque) for i, (c, t) in enumerate(keys)}

    def of_aggregate(a: ir.Aggregate) -> Typed:
        i = numbered[(a.function, a.columns, a.distinct)]
        return Typed(F.col(f"_a{i}"), ranks[i])

    def of_key(c: ir.QueryColumn) -> Typed:
        for (table, column), typed in key_typed.items():
            if column == c.column and (not c.table or not table or c.table == table):
                return typed
        raise InvalidQuery("Column must be grouped or aggregated")

    outputs = []
    for item in items:
        if isinstance(item, ir.Aggregate):
            outputs.append((ir.ResultColumn(item.name), of_aggregate(item)))
        elif item.column == "*":
            raise InvalidQuery("Column must be grouped or aggregated")
        else:
            outputs.append((ir.ResultColumn(item.alias or item.column, item.table or None, item.column), of_key(item)))
    if query.having is not None:
        compiler = _HavingCompiler(of_key, of_aggregate)
        out = out.where(compiler.root(query.having))
    order = []
    by_name = {c.name: t for c, t in outputs}
    for o in query.order_by:
        typed = by_name.get(o.by.column) if not o.by.table or o.by.column in by_name else None
        typed = typed or of_key(o.by)
        order += [c.desc_nulls_last() if o.descending else c.asc_nulls_first() for c in order_columns(typed)]
    result = Selected(out, [c for c, _ in outputs], [t for _, t in outputs], order)
    if query.distinct:
        result.df = result.df.distinct()
    return result


class _HavingCompiler(Compiler):
    def __init__(self, lookup, of_aggregate):
        super().__init__(lookup, True)
        self.of_aggregate = of_aggregate

    def typed(self, e) -> Typed:
        return self.of_aggregate(e) if isinstance(e, ir.Aggregate) else super().typed(e)

    def unknown(self, e) -> bool:
        return False


def _aggregate(a: ir.Aggregate, columns: list[Typed]) -> tuple[Column, ValueType | None]:
    if a.function == "count":
        if not columns:
            return F.count(F.lit(1)), ValueType.INTEGER
        live = [F.when(~is_null(c), c.col) for c in columns]
        if a.distinct:
            return F.count_distinct(*live), ValueType.INTEGER
        return F.count(live[0]), ValueType.INTEGER
    x = columns[0]
    if a.function in ("sum", "avg"):
        if x.rank not in (ValueType.INTEGER, ValueType.FLOAT):
            raise InvalidQuery("Aggregate needs a number")
        if a.function == "avg":
            return F.avg(x.col), ValueType.FLOAT
        return (F.sum_distinct(x.col) if a.distinct else F.sum(x.col)), x.rank
    if x.rank is None:
        key = F.struct(*order_columns(x))
        pick = F.min_by if a.function == "min" else F.max_by
        return pick(x.col, F.when(~is_null(x), key)), None
    if x.rank == ValueType.FLOAT:  # in the order of their bits
        pick = F.min_by if a.function == "min" else F.max_by
        return pick(x.col, order_columns(x)[0]), x.rank
    return (F.min if a.function == "min" else F.max)(x.col), x.rank


def _limited(query: ir.Select, out: Selected) -> Selected:
    """With LIMIT or OFFSET the order decides which rows stay, so it is part of the plan."""
    if query.limit is None and query.offset is None:
        return out
    df = out.df.orderBy(*out.order) if out.order else out.df
    if query.offset:
        df = df.offset(query.offset)
    if query.limit is not None:
        df = df.limit(query.limit)
    out.df = df
    return out


def _owner(tables: dict[str, Scan], c: ir.QueryColumn) -> str | None:
    if c.table:
        return c.table
    owners = [t for t, s in tables.items() if c.column in s.columns]
    if len(owners) > 1:
        raise InvalidQuery("Ambiguous column")
    return owners[0] if owners else None


def _lookup(tables: dict[str, Scan], c: ir.QueryColumn) -> Typed:
    if c.table and c.table not in tables:
        raise UnknownColumn("Unknown column table")
    owner = _owner(tables, c)
    if owner is None or c.column not in tables[owner].columns:
        raise UnknownColumn("Unknown predicate column")
    return tables[owner].columns[c.column]


def _lookup_or_fail(tables: dict[str, Scan], c: ir.QueryColumn) -> Typed:
    try:
        return _lookup(tables, c)
    except UnknownColumn:
        raise InvalidQuery("Unknown projection column") from None


def _semi_join(df: DataFrame, e, negated: bool, compiler: Compiler, scan_of) -> DataFrame:
    if isinstance(e, ir.Exists):
        some = select_extended(e.expr, scan_of).df.limit(1).select(F.lit(1).alias("_some"))
        return df.join(F.broadcast(some), F.lit(True), "left_anti" if negated else "left_semi")  # one row at most
    inner = select_extended(e.subquery, scan_of)
    if len(inner.columns) != 1:
        raise InvalidQuery("IN needs a subquery of one column")
    values = inner.df.select(inner.typed[0].col.alias("_in")).distinct()
    x = compiler.operand(e.expr)
    if negated:
        df = df.where(~is_null(x))
    return df.join(values, compare("=", x, Typed(F.col("_in"), inner.typed[0].rank)), "left_anti" if negated else "left_semi")

