"""Expressions to Spark columns: two-valued logic over typed columns."""

from __future__ import annotations

from collections.abc import Callable

from pyspark.sql import Column
from pyspark.sql import functions as F

from ledgerfold.errors import InvalidQuery, Unsupported
from ledgerfold.functions.cells import Typed, compare, is_null, literal
from ledgerfold.functions.values import ValueType
from ledgerfold.plans import ir


class UnknownColumn(Exception):
    """A predicate names a column that isn't there; it only matters to rows that reach it."""


class Compiler:
    """Compiles expressions against ``lookup``, which gives the typed column of a reference.

    Subqueries in IN and EXISTS aren't columns; the caller runs them as semi joins.
    """

    def __init__(self, lookup: Callable[[ir.QueryColumn], Typed], extended: bool = False):
        self.lookup, self.extended, self.missing = lookup, extended, ""

    def typed(self, e) -> Typed:
        if isinstance(e, ir.Literal):
            return literal(e.value)
        if isinstance(e, ir.ColumnRef):
            return self.lookup(e.column)
        return Typed(self.truth(e), ValueType.BOOL)

    def operand(self, e) -> Typed:
        x = self.typed(e)
        if x.opaque:
            raise InvalidQuery("column type can't be compared")
        return x

    def comparison(self, e: ir.Comparison) -> Column:
        return compare(e.op, self.operand(e.left), self.operand(e.right))

    def truth(self, e) -> Column:
        """True exactly where ``e`` is true; false, never null, elsewhere."""
        if not isinstance(e, (ir.And, ir.Or, ir.Not)) and self.unknown(e):
            return F.coalesce(F.raise_error(F.lit(f"[[{self.missing}]]")).cast("boolean"), F.lit(False))
        if isinstance(e, ir.Comparison):
            return F.coalesce(self.comparison(e), F.lit(False))
        if isinstance(e, ir.IsNull):
            return is_null(self.typed(e.expr))
        if isinstance(e, ir.IsNotNull):
            return ~is_null(self.typed(e.expr))
        if isinstance(e, (ir.And, ir.Or)):
            left, right = self.truth(e.left), self.truth(e.right)
            if self.unknown(e.right):  # only rows that get there may fail
                return F.when(left, right).otherwise(False) if isinstance(e, ir.And) else F.when(left, True).otherwise(right)
            return left & right if isinstance(e, ir.And) else left | right
        if isinstance(e, (ir.Not, ir.InList, ir.Like, ir.InSubquery, ir.Exists)) and not self.extended:
            raise Unsupported("SELECT predicate")
        if isinstance(e, ir.Not):
            return ~self.truth(e.expr)
        if isinstance(e, ir.InList):
            x = self.operand(e.expr)
            found = F.lit(False)
            values = [self.operand(i) for i in e.items]
            simple = [v.literal is not None and v.rank == x.rank and x.rank not in (ValueType.FLOAT, None) for v in values]
            if any(simple):
                found = F.coalesce(x.col.isin([v.col for v, plain in zip(values, simple, strict=True) if plain]), F.lit(False))
            for v, plain in zip(values, simple, strict=True):
                if not plain:
                    found = found | F.coalesce(compare("=", x, v), F.lit(False))
            return ~is_null(x) & ~found if e.negated else found
        if isinstance(e, ir.Like):
            x, pattern = self.operand(e.expr), self.operand(e.pattern)
            if x.rank != ValueType.TEXT or pattern.rank != ValueType.TEXT:
                return F.lit(False)
            shape = x.col.like(pattern.literal) if pattern.literal is not None else F.like(x.col, pattern.col)
            return F.coalesce(shape, F.lit(False))
        if isinstance(e, ir.Exists) and not isinstance(e.expr, ir.Select):
            return self.truth(e.expr)
        if isinstance(e, (ir.InSubquery, ir.Exists)):
            raise Unsupported("a subquery below OR")
        x = self.typed(e)
        if x.rank is None:
            return F.coalesce((x.col["t"] == int(ValueType.BOOL)) & x.col["b"], F.lit(False))
        if x.rank != ValueType.BOOL:
            return F.lit(False)
        return F.coalesce(x.col, F.lit(False))

    def unknown(self, e) -> bool:
        if isinstance(e, ir.ColumnRef):
            try:
                self.lookup(e.column)
            except UnknownColumn as e:
                self.missing = str(e)
                return True
            return False
        parts = [getattr(e, k, None) for k in ("left", "right", "expr")]
        return any(self.unknown(p) for p in parts if p is not None and not isinstance(p, ir.Select))

    def root(self, e) -> Column:
        """A filter that keeps what truth() keeps, with comparisons left bare so that scans can use them.

        Null and false both drop a row, also below AND and OR.
        """
        if isinstance(e, ir.Comparison) and not self.unknown(e):
            return self.comparison(e)
        if isinstance(e, (ir.And, ir.Or)) and not self.unknown(e):
            left, right = self.root(e.left), self.root(e.right)
            return left & right if isinstance(e, ir.And) else left | right
        return self.truth(e)


def conjuncts(e) -> list:
    """The parts of a chain of ANDs."""
    if isinstance(e, ir.And):
        return [*conjuncts(e.left), *conjuncts(e.right)]
    return [] if e is None else [e]
