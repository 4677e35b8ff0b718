"""SQL text to statements: a tokenizer and a recursive-descent parser.

The strict profile accepts the small dialect and rejects everything else by name;
the extended profile also lowers joins (``JOIN`` and ``LEFT OUTER JOIN`` too),
aggregates, grouping, ordering, limits, DISTINCT, NOT, IN, LIKE and EXISTS, runs
all tuples of VALUES and binds parameters.
"""

from __future__ import annotations

import re
import uuid
import warnings
from typing import Any

from ledgerfold.errors import MissingNamedParameter, MixedPlaceholderStyles, TranslateError
from ledgerfold.functions.values import ValueType
from ledgerfold.plans import ir

STRICT, EXTENDED = "strict", "extended"

_TOKEN = re.compile(
    r"""\s+|--[^\n]*|/\*.*?\*/
    |(?P<number>\d+(?:\.\d*)?(?:[eE][+-]?\d+)?|\.\d+(?:[eE][+-]?\d+)?)
    |(?P<string>'(?:[^']|'')*')
    |(?P<quoted>"(?:[^"]|"")*")
    |(?P<holder>\$\d+|\?|[:@][A-Za-z_]\w*)
    |(?P<word>[A-Za-z_\u0080-￿][\w$\u0080-￿]*)
    |(?P<op><>|!=|<=|>=|\|\||::|->>|->|[-+*/%=<>(),.;\[\]^&|~#])""",
    re.VERBOSE | re.DOTALL,
)
_RESERVED = frozenset(
    "select from where group having order limit offset fetch union intersect except join inner left right full cross natural on using "
    "as and or not in like is between values set returning when then else end case window qualify for".split()
)
_TYPES = {
    "uuid": ValueType.UUID, "boolean": ValueType.BOOL, "int": ValueType.INTEGER, "integer": ValueType.INTEGER,
    "bigint": ValueType.INTEGER, "float": ValueType.FLOAT, "double": ValueType.FLOAT, "char": ValueType.TEXT,
    "varchar": ValueType.TEXT, "text": ValueType.TEXT, "json": ValueType.JSON, "jsonb": ValueType.JSON, "blob": ValueType.BLOB,
}
_AGGREGATES = frozenset(("count", "sum", "avg", "min", "max"))


class Token:
    __slots__ = ("kind", "text")

    def __init__(self, kind: str, text: str):
        self.kind, self.text = kind, text

    @property
    def name(self) -> str:
        return self.text[1:-1].replace('""', '"') if self.kind == "quoted" else self.text


def tokenize(sql: str) -> list[Token]:
    out, at = [], 0
    while at < len(sql):
        m = _TOKEN.match(sql, at)
        if not m:
            raise TranslateError(f"sql parser error: Unexpected character {sql[at]!r}")
        if m.lastgroup:
            out.append(Token(m.lastgroup, m[0]))
        at = m.end()
    out.append(Token("end", ""))
    return out


class Raw:
    """An expression that no profile runs; ``message`` says how the strict one rejects it."""

    def __init__(self, text: str, message: str):
        self.text, self.message = text, message


class Call:
    def __init__(self, name: str, args: list, distinct: bool, star: bool):
        self.name, self.args, self.distinct, self.star = name, args, distinct, star


class Parser:
    def __init__(self, sql: str, profile: str = STRICT, params: Any = None):
        self.tokens, self.at, self.profile = tokenize(sql), 0, profile
        self.params, self.used = params, set()
        self.positions = 0

    # -- tokens

    @property
    def now(self) -> Token:
        return self.tokens[self.at]

    def peek(self, ahead: int = 1) -> Token:
        return self.tokens[min(self.at + ahead, len(self.tokens) - 1)]

    def is_word(self, *words: str, ahead: int = 0) -> bool:
        t = self.peek(ahead) if ahead else self.now
        return t.kind == "word" and t.text.lower() in words

    def take_word(self, *words: str) -> bool:
        if self.is_word(*words):
            self.at += 1
            return True
        return False

    def take_words(self, *sequence: str) -> bool:
        if all(self.is_word(w, ahead=i) for i, w in enumerate(sequence)):
            self.at += len(sequence)
            return True
        return False

    def take(self, op: str) -> bool:
        if self.now.kind == "op" and self.now.text == op:
            self.at += 1
            return True
        return False

    def fail(self, wanted: str):
        raise TranslateError(f"sql parser error: Expected: {wanted}, found: {self.now.text or 'EOF'}")

    def need(self, op: str) -> None:
        if not self.take(op):
            self.fail(op)

    def need_word(self, *words: str) -> None:
        if not self.take_word(*words):
            self.fail(" or ".join(words).upper())

    def identifier(self) -> str:
        t = self.now
        if t.kind == "quoted" or (t.kind == "word" and t.text.lower() not in _RESERVED):
            self.at += 1
            return t.name
        self.fail("identifier")

    def object_name(self, what: str = "table name") -> str:
        parts = [self.identifier()]
        while self.take("."):
            parts.append(self.identifier())
        if len(parts) > 1:
            raise TranslateError(f"Unsupported {what} with {len(parts)} parts: {parts}")
        return parts[0]

    @property
    def extended(self) -> bool:
        return self.profile == EXTENDED

    # -- statements

    def statements(self) -> list:
        out = []
        while True:
            while self.take(";"):
                pass
            if self.now.kind == "end":
                return [lower() for lower in out]
            out.append(self.statement())
            if self.now.kind != "end" and not self.take(";"):
                self.fail("end of statement")

    def statement(self):
        """A function that lowers the parsed statement; the whole text parses before any is lowered."""
        if self.is_word("select", "with", "values") or (self.now.kind == "op" and self.now.text == "("):
            query = self.query()
            return lambda: self.lower_query(query)
        for words, parse in (
            (("insert", "into"), self.insert), (("update",), self.update), (("delete", "from"), self.delete),
            (("create", "table"), self.create_table), (("create", "unique", "index"), lambda: self.create_index(True)),
            (("create", "index"), lambda: self.create_index(False)), (("drop",), self.drop),
            (("alter", "table"), self.alter_table), (("alter", "index"), self.alter_index),
        ):
            if self.take_words(*words):
                return parse()
        if self.is_word("explain", "truncate", "grant", "revoke", "begin", "commit", "rollback", "show", "use", "merge", "analyze", "vacuum"):
            name = self.now.text.upper()
            while self.now.kind != "end" and self.now.text != ";":
                self.at += 1
            return lambda: self.reject(f"Unsupported SQL statement: {name}")
        self.fail("an SQL statement")

    def reject(self, message: str):
        raise TranslateError(message)

    # -- SELECT

    def query(self) -> dict:
        q: dict[str, Any] = {"with": False, "set": False, "order_by": [], "limit": None, "offset": None, "ends": False}
        if self.take_word("with"):
            q["with"] = True
            self.take_word("recursive")
            while True:
                self.identifier()
                self.need_word("as")
                self.need("(")
                self.query()
                self.need(")")
                if not self.take(","):
                    break
        if self.take_word("values"):
            q["set"] = True
            self.tuples()
        elif self.take("("):
            self.query()
            self.need(")")
            q["set"] = True
        else:
            self.need_word("select")
            q |= self.select_body()
        while self.take_word("union", "intersect", "except"):
            self.take_word("all", "distinct")
            self.query()
            q["set"] = True
        if self.take_words("order", "by"):
            q["ends"] = True
            while True:
                by = self.expression()
                down = bool(self.take_word("desc")) or (self.take_word("asc") and False)
                if self.take_word("nulls"):
                    self.need_word("first", "last")
                q["order_by"].append((by, down))
                if not self.take(","):
                    break
        while self.is_word("limit", "offset", "fetch"):
            q["ends"] = True
            if self.take_word("limit"):
                q["limit"] = self.count()
            elif self.take_word("offset"):
                q["offset"] = self.count()
                self.take_word("row", "rows")
            else:
                self.at += 1
                self.take_word("first", "next")
                q["limit"] = self.count()
                self.take_word("row", "rows")
                self.need_word("only")
        return q

    def count(self) -> int:
        if self.now.kind == "number" and self.now.text.isdigit():
            self.at += 1
            return int(self.tokens[self.at - 1].text)
        if self.is_word("all"):
            self.at += 1
            return None
        self.fail("a number of rows")

    def select_body(self) -> dict:
        q: dict[str, Any] = {"distinct": False, "items": [], "from": [], "where": None, "group_by": [], "having": None}
        if self.take_word("distinct"):
            q["distinct"] = True
            if self.take_word("on"):
                self.need("(")
                self.expressions()
                self.need(")")
        else:
            self.take_word("all")
        while True:
            q["items"].append(self.select_item())
            if not self.take(","):
                break
        if self.take_word("from"):
            while True:
                q["from"].append(self.table_with_joins())
                if not self.take(","):
                    break
        if self.take_word("where"):
            q["where"] = self.expression()
        if self.take_words("group", "by"):
            q["group_by"] = self.expressions()
        if self.take_word("having"):
            q["having"] = self.expression()
        return q

    def select_item(self):
        if self.take("*"):
            return ("*", None)
        if self.now.kind in ("word", "quoted") and self.peek().text == "." and self.peek(2).text == "*":
            self.identifier()
            self.at += 2
            return ("t.*", None)
        expr = self.expression()
        alias = None
        if self.take_word("as"):
            alias = self.identifier()
        elif self.now.kind == "quoted" or (self.now.kind == "word" and self.now.text.lower() not in _RESERVED):
            alias = self.identifier()
        return (expr, alias)

    def table_with_joins(self) -> dict:
        source = {"base": self.table_factor(), "joins": []}
        while True:
            natural = self.take_word("natural")
            if self.take_word("cross"):
                kind = "cross"
            elif self.take_word("inner"):
                kind = "inner"
            elif self.is_word("left", "right", "full"):
                kind = self.now.text.lower()
                self.at += 1
                if self.take_word("outer"):
                    kind += " outer"
                elif self.take_word("semi", "anti"):
                    kind += " semi"
            elif self.is_word("join"):
                kind = "join"
            elif natural:
                self.fail("JOIN")
            else:
                return source
            self.need_word("join")
            table = self.table_factor()
            on, how = None, "none"
            if self.take_word("on"):
                on, how = self.expression(), "on"
            elif self.take_word("using"):
                self.need("(")
                self.expressions()
                self.need(")")
                how = "using"
            source["joins"].append((kind, table, on, "natural" if natural else how))

    def table_factor(self):
        if self.take("("):
            if self.is_word("select", "with", "values"):
                self.query()
            else:
                self.table_with_joins()
            self.need(")")
            self.alias()
            return None
        parts = [self.identifier()]
        while self.take("."):
            parts.append(self.identifier())
        return parts, self.alias()

    def alias(self) -> str | None:
        if self.take_word("as"):
            return self.identifier()
        if self.now.kind == "quoted" or (self.now.kind == "word" and self.now.text.lower() not in _RESERVED):
            return self.identifier()
        return None

    def lower_table(self, factor) -> tuple[str, str | None]:
        if factor is None:
            raise TranslateError("Unsupported table object: derived table")
        parts, alias = factor
        if len(parts) > 1:
            raise TranslateError(f"Unsupported table name with {len(parts)} parts: {parts}")
        return parts[0], alias

    def lower_query(self, q: dict) -> ir.Select:
        if q["with"]:
            raise TranslateError("CTEs not yet supported")
        if q["set"]:
            raise TranslateError("Only plain SELECT queries supported")
        if not self.extended:
            for broken, message in (
                (q["ends"], "ORDER BY, LIMIT, and OFFSET are not supported"), (q["distinct"], "DISTINCT is not supported"),
                (q["group_by"], "GROUP BY is not supported"), (q["having"] is not None, "HAVING is not supported"),
            ):
                if broken:
                    raise TranslateError(message)
        if len(q["from"]) > 1:
            raise TranslateError("Only one table in FROM is supported")
        if not q["from"]:
            raise TranslateError("Missing FROM clause")
        source = q["from"][0]
        base, alias = self.lower_table(source["base"])
        names = {base: base} if not self.extended else {}
        names[alias or base] = (alias or base) if self.extended else base
        joins = []
        kinds = {"inner": "inner", "left": "left", "right": "right", "full": "full", "full outer": "full"}
        if self.extended:
            kinds |= {"join": "inner", "left outer": "left", "right outer": "right"}
        for kind, factor, on, how in source["joins"]:
            table, other = self.lower_table(factor)
            if kind not in kinds:
                raise TranslateError("Unsupported JOIN type")
            if how != "on":
                raise TranslateError({"using": "USING joins not yet supported", "natural": "NATURAL joins not yet supported"}.get(how, "JOIN without ON condition"))
            names[other or table] = (other or table) if self.extended else table
            if not self.extended:
                names.setdefault(table, table)
            joins.append((kinds[kind], table, on, other))
        scope = Scope(self, names, (alias or base) if self.extended else base)
        lowered = tuple(ir.Join(kind, table, scope.expr(on), other) for kind, table, on, other in joins)
        projection, aggregates, items = [], [], []
        for expr, name in q["items"]:
            if expr == "*":
                item = ir.QueryColumn(scope.default, "*")
            elif expr == "t.*":
                raise TranslateError("Unsupported projection item")
            elif self.extended and isinstance(expr, Call) and expr.name in _AGGREGATES:
                item = scope.aggregate(expr, name)
                aggregates.append(item)
                items.append(item)
                continue
            elif isinstance(expr, ir.ColumnRef):
                column = scope.column(expr.column)
                item = ir.QueryColumn(column.table, column.column, name if self.extended else None)
            else:
                item = ir.QueryColumn(scope.default, f"expr:{_shown(expr)}")
            projection.append(item)
            items.append(item)
        where = scope.expr(q["where"]) if q["where"] is not None else None
        if not self.extended:
            return ir.Select(ir.From(base, lowered), tuple(projection), where)
        having = scope.expr(q["having"], aggregates) if q["having"] is not None else None
        order = tuple(ir.OrderBy(scope.sort_column(by, items), down) for by, down in q["order_by"])
        return ir.Select(
            ir.From(base, lowered, alias), tuple(projection), where, tuple(aggregates), tuple(scope.plain(g) for g in q["group_by"]),
            order, q["limit"], q["offset"], having, q["distinct"], tuple(items),
        )

    # -- expressions: raw nodes, resolved by Scope

    def expressions(self) -> list:
        out = [self.expression()]
        while self.take(","):
            out.append(self.expression())
        return out

    def expression(self):
        left = self.conjunction()
        while self.take_word("or"):
            left = ir.Or(left, self.conjunction())
        return left

    def conjunction(self):
        left = self.negation()
        while self.take_word("and"):
            left = ir.And(left, self.negation())
        return left

    def negation(self):
        if self.is_word("not") and not self.is_word("exists", ahead=1):
            self.at += 1
            return ir.Not(self.negation())
        if self.take_words("not", "exists"):
            return ir.Not(self.exists())
        return self.predicate()

    def exists(self):
        self.need("(")
        query = self.query() if self.is_word("select", "with", "values") else None
        inner = None if query else self.expression()
        self.need(")")
        return ir.Exists(("query", query) if query else inner)

    def predicate(self):
        left = self.sum()
        while True:
            if self.take_word("is"):
                negated = self.take_word("not")
                if self.take_word("null"):
                    left = ir.IsNotNull(left) if negated else ir.IsNull(left)
                elif self.take_words("distinct", "from"):
                    right = self.sum()
                    text = f"{_shown(left)} IS DISTINCT FROM {_shown(right)}"
                    left = Raw(text, f"Unsupported expression: {text}")
                else:
                    self.need_word("true", "false", "unknown")
                    text = f"{_shown(left)} IS {self.tokens[self.at - 1].text.upper()}"
                    left = Raw(text, f"Unsupported expression: {text}")
            elif self.is_word("in", "like", "ilike", "between", "similar") or (
                self.is_word("not") and self.is_word("in", "like", "ilike", "between", "similar", ahead=1)
            ):
                left = self.special(left, self.take_word("not"))
            elif self.now.kind == "op" and self.now.text in ("=", "<>", "!=", "<", "<=", ">", ">="):
                op = {"!=": "<>"}.get(self.now.text, self.now.text)
                self.at += 1
                left = ir.Comparison(op, left, self.sum())
            else:
                return left

    def special(self, left, negated: bool):
        word = self.now.text.lower()
        self.at += 1
        if word == "in":
            self.need("(")
            if self.is_word("select", "with"):
                query = self.query()
                self.need(")")
                out = ir.InSubquery(left, ("query", query))
                return ir.Not(out) if negated else out
            items = self.expressions()
            self.need(")")
            return ir.InList(left, tuple(items), negated)
        if word == "like":
            out = ir.Like(left, self.sum())
            return ir.Not(out) if negated else out
        if word == "between":
            low = self.sum()
            self.need_word("and")
            text = f"{_shown(left)} BETWEEN {_shown(low)} AND {_shown(self.sum())}"
        else:
            self.take_word("to")
            text = f"{_shown(left)} {word.upper()} {_shown(self.sum())}"
        return Raw(text, f"Unsupported expression: {text}")

    def sum(self):
        left = self.unary()
        while self.now.kind == "op" and self.now.text in ("+", "-", "*", "/", "%", "||", "->", "->>", "^", "&", "|", "#"):
            op = self.now.text
            self.at += 1
            left = Raw(f"{_shown(left)} {op} {_shown(self.unary())}", f"Unsupported binary operator: {op}")
        while self.take("::"):
            self.type_name()
            left = Raw(f"{_shown(left)}::", "Unsupported cast")
        return left

    def unary(self):
        if self.now.kind == "op" and self.now.text in ("-", "+", "~"):
            op = self.now.text
            self.at += 1
            text = f"{op}{_shown(self.unary())}"
            return Raw(text, f"Unsupported expression: {text}")
        return self.primary()

    def primary(self):
        t = self.now
        if self.take("("):
            if self.is_word("select", "with"):
                self.query()
                self.need(")")
                return Raw("(subquery)", "Unsupported expression: (subquery)")
            inner = self.expression()
            if self.now.text == ",":
                while self.take(","):
                    self.expression()
                inner = Raw("(tuple)", "Unsupported expression: (tuple)")
            self.need(")")
            return inner
        if t.kind == "number":
            self.at += 1
            return ir.Literal(("number", t.text))
        if t.kind == "string":
            self.at += 1
            return ir.Literal(t.text[1:-1].replace("''", "'"))
        if t.kind == "holder":
            self.at += 1
            if t.text == "?":
                self.positions += 1
                return ir.Placeholder(f"${self.positions}" if self.extended else "?")
            return ir.Placeholder(t.text)
        if self.take_word("null"):
            return ir.Literal(None)
        if self.is_word("true", "false"):
            self.at += 1
            return ir.Literal(t.text.lower() == "true")
        if self.take_word("exists"):
            return self.exists()
        if self.is_word("cast", "try_cast") and self.peek().text == "(":
            tried = t.text.lower() == "try_cast"
            self.at += 2
            inner = self.expression()
            self.need_word("as")
            kind = self.type_name()
            self.need(")")
            return ("cast", inner, None if tried else kind)
        if self.take_word("case"):
            while not self.take_word("end"):
                if self.now.kind == "end":
                    self.fail("END")
                self.at += 1
            return Raw("CASE", "Unsupported expression: CASE")
        name = self.identifier()
        if self.take("("):
            return self.call(name)
        if self.take("."):
            column = self.identifier()
            if self.take("."):
                self.identifier()
                return Raw(f"{name}.{column}.", f"Unsupported expression: {name}.{column}.")
            return ir.ColumnRef(ir.QueryColumn(name, column))
        return ir.ColumnRef(ir.QueryColumn("", name))

    def call(self, name: str) -> Call:
        distinct = self.take_word("distinct")
        star, args = False, []
        if self.take("*"):
            star = True
        elif not (self.now.kind == "op" and self.now.text == ")"):
            args = self.expressions()
            if len(args) == 1 and isinstance(args[0], Raw) and args[0].text == "(tuple)":
                args = []
        self.need(")")
        if self.take_word("over"):
            self.need("(")
            depth = 1
            while depth and self.now.kind != "end":
                depth += {"(": 1, ")": -1}.get(self.now.text, 0)
                self.at += 1
            return Call(f"{name} over", args, distinct, star)
        return Call(name.lower(), args, distinct, star)

    def type_name(self) -> str:
        if self.now.kind not in ("word", "quoted"):
            self.fail("a data type")
        words = [self.now.text.lower()]
        self.at += 1
        while self.is_word("precision", "varying", "with", "without", "time", "zone"):
            words.append(self.now.text.lower())
            self.at += 1
        if self.take("("):
            while not self.take(")"):
                if self.now.kind == "end":
                    self.fail(")")
                self.at += 1
        if self.take("["):
            self.need("]")
            words.append("[]")
        return " ".join(words)

    # -- literals

    def literal(self, node) -> Any:
        """The value of a literal node."""
        value = node.value
        if isinstance(value, tuple):
            text = value[1]
            if "." in text:
                try:
                    return float(text)
                except ValueError:
                    raise TranslateError(f"Invalid float literal: {text}") from None
            try:
                number = int(text)
            except ValueError:
                raise TranslateError(f"Invalid integer literal: {text}") from None
            if number >= 1 << 63:
                raise TranslateError(f"Invalid integer literal: {text}")
            return number
        return value

    def cast(self, node) -> uuid.UUID:
        _, inner, kind = node
        if kind != "uuid":
            raise TranslateError("Unsupported cast")
        if isinstance(inner, ir.Placeholder) and self.extended:
            inner = ir.Literal(self.parameter(inner))
            if isinstance(inner.value, uuid.UUID):
                return inner.value
        if not isinstance(inner, ir.Literal) or not isinstance(inner.value, str):
            raise TranslateError("UUID casts require text values")
        try:
            return uuid.UUID(inner.value)
        except ValueError:
            raise TranslateError("Invalid UUID literal") from None

    def parameter(self, node: ir.Placeholder) -> Any:
        """The bound value; the strict profile, which takes no parameters, reads a placeholder as text."""
        if not self.extended:
            return f'Placeholder("{node.name}")'
        named = not node.name.startswith("$")
        self.used.add(named)
        if len(self.used) > 1 or (named and isinstance(self.params, (list, tuple))) or (not named and isinstance(self.params, dict)):
            raise MixedPlaceholderStyles
        if named:
            if not isinstance(self.params, dict) or node.name[1:] not in self.params:
                raise MissingNamedParameter(node.name[1:])
            return self.params[node.name[1:]]
        at = int(node.name[1:]) - 1
        if not isinstance(self.params, (list, tuple)) or not 0 <= at < len(self.params):
            raise MissingNamedParameter(node.name)
        return self.params[at]

    def constant(self, node, message: str) -> Any:
        if isinstance(node, ir.Literal):
            return self.literal(node)
        if isinstance(node, ir.Placeholder):
            return self.parameter(node)
        if isinstance(node, tuple) and node and node[0] == "cast":
            return self.cast(node)
        if isinstance(node, Raw) and node.message.startswith("Unsupported binary"):
            raise TranslateError(node.message)
        raise TranslateError(message)

    # -- INSERT, UPDATE, DELETE

    def tuples(self) -> list[list]:
        out = []
        while True:
            self.need("(")
            out.append([] if self.now.text == ")" else self.expressions())
            self.need(")")
            if not self.take(","):
                return out

    def insert(self):
        table = self.object_name()
        columns: list[str] = []
        if self.now.text == "(" and not self.is_word("select", ahead=1):
            self.need("(")
            while True:
                columns.append(self.identifier())
                if not self.take(","):
                    break
            self.need(")")
        rows: list[list] | None = None
        if self.take_words("default", "values"):
            pass
        elif self.take_word("values"):
            rows = self.tuples()
        else:
            self.query()
        if self.take_words("on", "conflict"):
            while self.now.kind != "end" and self.now.text != ";" and not self.is_word("returning"):
                self.at += 1
        returning = self.returning()

        def value(node):
            if isinstance(node, ir.ColumnRef) and node.column.column == "DEFAULT" and not node.column.table:
                return ir.DEFAULT
            return self.constant(node, "Unsupported expression in VALUES")

        def lower():
            if rows is not None and not rows:
                raise TranslateError("INSERT with no VALUES")
            lowered = [tuple(value(v) for v in row) for row in rows[: None if self.extended else 1]] if rows else [()]
            if rows and len(rows) > 1 and not self.extended:
                warnings.warn("INSERT takes the first tuple of VALUES only; the extended profile takes all", stacklevel=2)
            names = None
            if returning is not None:
                names = []
                for item, _ in returning:
                    if item == "*":
                        names.append("*")
                    elif isinstance(item, ir.ColumnRef):
                        if item.column.table:
                            raise TranslateError(f"Unsupported RETURNING identifier: {item.column}")
                        names.append(item.column.column)
                    elif item == "t.*":
                        raise TranslateError("Unsupported RETURNING item")
                    else:
                        raise TranslateError(f"Unsupported RETURNING expression: {_shown(item)}")
                names = tuple(names)
            return ir.InsertValues(table, tuple(columns), lowered[0], names, tuple(lowered[1:]))

        return lower

    def returning(self) -> list | None:
        if not self.take_word("returning"):
            return None
        out = [self.select_item()]
        while self.take(","):
            out.append(self.select_item())
        return out

    def update(self):
        source = self.table_with_joins()
        self.need_word("set")
        assignments = []
        while True:
            if self.take("("):
                self.expressions()
                self.need(")")
                target = None
            else:
                target = [self.identifier()]
                while self.take("."):
                    target.append(self.identifier())
            self.need("=")
            assignments.append((target, self.expression()))
            if not self.take(","):
                break
        if self.take_word("from"):
            self.table_with_joins()
        where = self.expression() if self.take_word("where") else None
        self.returning()

        def lower():
            if source["base"] is None:
                raise TranslateError("Only simple table references supported in UPDATE")
            table, _ = self.lower_table(source["base"])
            scope = Scope(self, {table: table}, table)
            out = []
            for target, expr in assignments:
                if target is None or len(target) > 1:
                    raise TranslateError("UPDATE assignments require one column")
                out.append(ir.Assignment(ir.QueryColumn(table, target[0]), scope.assigned(expr)))
            return ir.Update(ir.From(table), tuple(out), scope.expr(where) if where is not None else None)

        return lower

    def delete(self):
        sources = [self.table_with_joins()]
        while self.take(","):
            sources.append(self.table_with_joins())
        if self.take_word("using"):
            self.table_with_joins()
        where = self.expression() if self.take_word("where") else None
        self.returning()
        if self.take_word("limit"):
            self.count()

        def lower():
            if len(sources) > 1:
                raise TranslateError("Only one table in DELETE is supported")
            if sources[0]["base"] is None:
                raise TranslateError("Only simple table references supported in DELETE")
            if sources[0]["joins"]:
                raise TranslateError("Joins in DELETE are not supported")
            table, _ = self.lower_table(sources[0]["base"])
            scope = Scope(self, {table: table}, table)
            return ir.Delete(ir.From(table), scope.expr(where) if where is not None else None)

        return lower

    # -- DDL

    def if_exists(self, *words: str) -> bool:
        return self.take_words("if", *words)

    def column_definition(self):
        name = self.identifier()
        kind = self.type_name()
        default, key, unique = None, False, False
        while True:
            if self.take_word("constraint"):
                self.identifier()
            elif self.take_words("primary", "key"):
                key = True
            elif self.take_word("unique"):
                unique = True
            elif self.take_words("not", "null") or self.take_word("null"):
                pass
            elif self.take_word("default"):
                default = self.sum()
            elif self.take_word("check"):
                self.need("(")
                self.expression()
                self.need(")")
            elif self.take_word("references"):
                self.identifier()
                if self.take("("):
                    self.expressions()
                    self.need(")")
            elif self.take_word("collate"):
                self.identifier()
            else:
                break

        def lower() -> tuple[ir.ColumnSchema, bool]:
            if kind not in _TYPES:
                raise TranslateError(f"Unsupported column data type: {kind}")
            value = self.constant(default, "Column default must be a literal value") if default is not None else None
            return ir.ColumnSchema(name, _TYPES[kind], value, key), unique

        return lower

    def create_table(self):
        if_not_exists = self.if_exists("not", "exists")
        name = self.object_name()
        self.need("(")
        columns, constraints = [], []
        while True:
            named = self.take_word("constraint") and self.identifier()
            if self.is_word("unique") and self.peek().text == "(":
                self.at += 2
                constraints.append(self.expressions())
                self.need(")")
            elif self.take_words("primary", "key") or self.take_words("foreign", "key") or (named and self.is_word("check")) or self.is_word("check"):
                self.take_word("check")
                self.need("(")
                self.expressions()
                self.need(")")
                if self.take_word("references"):
                    self.identifier()
                    if self.take("("):
                        self.expressions()
                        self.need(")")
            else:
                columns.append(self.column_definition())
            if not self.take(","):
                break
        self.need(")")

        def lower():
            made = [c() for c in columns]
            names = [c.name for c, _ in made]
            groups = [(c.name,) for c, unique in made if unique]
            for group in constraints:
                if not all(isinstance(g, ir.ColumnRef) and not g.column.table for g in group):
                    raise TranslateError("UNIQUE constraints only support bare identifier columns")
                keys = tuple(g.column.column for g in group)
                if any(k not in names for k in keys):
                    raise TranslateError("UNIQUE column not found")
                groups.append(keys)
            indexes = tuple(ir.IndexSchema(f"{name}_unique_{i}_{'_'.join(g)}", name, g, True) for i, g in enumerate(groups))
            return ir.CreateTable(ir.TableSchema(name, tuple(c for c, _ in made)), if_not_exists, indexes)

        return lower

    def create_index(self, unique: bool):
        if_not_exists = self.if_exists("not", "exists")
        name = None if self.is_word("on") else self.object_name("object name")
        self.need_word("on")
        table = self.object_name()
        self.need("(")
        keys = []
        while True:
            expr = self.expression()
            plain = isinstance(expr, ir.ColumnRef) and not expr.column.table
            if self.take_word("asc", "desc"):
                plain = False
            if self.take_word("nulls"):
                self.need_word("first", "last")
                plain = False
            if self.now.kind == "word":
                self.at += 1
                plain = False
            keys.append(expr.column.column if plain else None)
            if not self.take(","):
                break
        self.need(")")

        def lower():
            if name is None:
                raise TranslateError("CREATE INDEX requires an index name")
            if None in keys:
                raise TranslateError("CREATE INDEX only supports bare identifier columns")
            return ir.CreateIndex(ir.IndexSchema(name, table, tuple(keys), unique), if_not_exists, True)

        return lower

    def drop(self):
        kind = self.identifier().lower()
        if_exists = self.if_exists("exists")
        parts = [self.object_name("object name")]
        while self.take(","):
            parts.append(self.object_name("object name"))
        self.take_word("cascade", "restrict")

        def lower():
            if kind == "table":
                if self.extended:
                    return ir.DropTable(parts[0], if_exists)
                raise TranslateError("DROP TABLE is not supported")
            if kind != "index":
                raise TranslateError(f"DROP {kind.upper()} not supported")
            return ir.DropIndex(parts[0], if_exists)

        return lower

    def alter_table(self):
        if_exists = self.if_exists("exists")
        table = self.object_name()
        operations: list = []
        while True:
            if self.is_word("add") and not self.is_word("constraint", "primary", "unique", "index", ahead=1):
                self.at += 1
                self.take_word("column")
                self.if_exists("not", "exists")
                operations.append(("add", self.column_definition()))
            elif self.take_words("drop", "column") or (self.is_word("drop") and self.peek().kind in ("word", "quoted") and self.take_word("drop")):
                self.if_exists("exists")
                operations.append(("drop", self.identifier()))
            elif self.take_words("rename", "to"):
                operations.append(("rename table", self.identifier()))
            elif self.take_word("rename"):
                self.take_word("column")
                old = self.identifier()
                self.need_word("to")
                operations.append(("rename", old, self.identifier()))
            else:
                while self.now.kind != "end" and self.now.text not in (";", ","):
                    self.at += 1
                operations.append(("other",))
            if not self.take(","):
                break

        def lower():
            out = []
            for op, *args in operations:
                if op == "add":
                    out.append(ir.AddColumn(args[0]()[0]))
                elif not self.extended or op == "other":
                    raise TranslateError("Only ALTER TABLE ADD COLUMN is supported")
                else:
                    out.append({"drop": ir.DropColumn, "rename": ir.RenameColumn, "rename table": ir.RenameTable}[op](*args))
            return ir.AlterTable(table, tuple(out), if_exists)

        return lower

    def alter_index(self):
        name = self.object_name("object name")
        self.need_word("rename")
        self.need_word("to")
        new = self.identifier()
        return lambda: ir.RenameIndex(name, new)


class Scope:
    """Resolves raw expressions against the tables in sight."""

    def __init__(self, parser: Parser, names: dict[str, str], default: str):
        self.parser, self.names, self.default = parser, names, default

    def column(self, raw: ir.QueryColumn) -> ir.QueryColumn:
        if not raw.table:
            return ir.QueryColumn(self.default if not self.parser.extended or len(self.names) == 1 else "", raw.column)
        return ir.QueryColumn(self.names.get(raw.table, raw.table), raw.column)

    def plain(self, expr) -> ir.QueryColumn:
        if not isinstance(expr, ir.ColumnRef):
            raise TranslateError(f"Unsupported expression: {_shown(expr)}")
        return self.column(expr.column)

    def sort_column(self, expr, items: list) -> ir.QueryColumn:
        """What ORDER BY names: an output by its alias or place, an aggregate, or a column."""
        if isinstance(expr, Call) and expr.name in _AGGREGATES:
            wanted = self.aggregate(expr, None)
            for item in items:
                if isinstance(item, ir.Aggregate) and (item.function, item.columns, item.distinct) == (wanted.function, wanted.columns, wanted.distinct):
                    return ir.QueryColumn("", item.name)
        if isinstance(expr, ir.Literal) and isinstance(expr.value, tuple) and expr.value[1].isdigit() and 0 < int(expr.value[1]) <= len(items):
            item = items[int(expr.value[1]) - 1]
            return ir.QueryColumn("", item.name) if isinstance(item, ir.Aggregate) else item
        if isinstance(expr, ir.ColumnRef) and not expr.column.table and any(getattr(i, "alias", None) == expr.column.column for i in items):
            return ir.QueryColumn("", expr.column.column)
        return self.plain(expr)

    def aggregate(self, call: Call, alias: str | None) -> ir.Aggregate:
        if call.star or (call.name == "count" and not call.args):
            return ir.Aggregate("count", alias=alias)
        return ir.Aggregate(call.name, tuple(self.plain(a) for a in call.args), call.distinct, alias)

    def assigned(self, expr):
        if isinstance(expr, ir.ColumnRef):
            return ir.ColumnRef(self.column(expr.column))
        if isinstance(expr, (ir.Literal, ir.Placeholder, tuple)):
            return ir.Literal(self.parser.constant(expr, ""))
        raise TranslateError("UPDATE assignments require a value")

    def expr(self, e, aggregates: list | None = None):
        p = self.parser
        if isinstance(e, Raw):
            raise TranslateError(e.message)
        if isinstance(e, Call):
            if aggregates is not None and e.name in _AGGREGATES:
                return self.aggregate(e, None)
            raise TranslateError(f"Unsupported expression: {_shown(e)}")
        if isinstance(e, (ir.Literal, ir.Placeholder, tuple)):
            return ir.Literal(p.constant(e, f"Unsupported expression: {_shown(e)}"))
        if isinstance(e, ir.ColumnRef):
            return ir.ColumnRef(self.column(e.column))
        sub = lambda x: self.expr(x, aggregates)
        if isinstance(e, (ir.And, ir.Or)):
            return type(e)(sub(e.left), sub(e.right))
        if isinstance(e, ir.Comparison):
            return ir.Comparison(e.op, sub(e.left), sub(e.right))
        if isinstance(e, (ir.IsNull, ir.IsNotNull)):
            return type(e)(sub(e.expr))
        if not p.extended:
            raise TranslateError(f"Unsupported expression: {_shown(e)}")
        if isinstance(e, ir.Not):
            return ir.Not(sub(e.expr))
        if isinstance(e, ir.InList):
            return ir.InList(sub(e.expr), tuple(map(sub, e.items)), e.negated)
        if isinstance(e, ir.Like):
            return ir.Like(sub(e.expr), sub(e.pattern))
        if isinstance(e, ir.InSubquery):
            return ir.InSubquery(sub(e.expr), p.lower_query(e.subquery[1]))
        return ir.Exists(p.lower_query(e.expr[1]) if isinstance(e.expr, tuple) and e.expr[:1] == ("query",) else sub(e.expr))


def _shown(e) -> str:
    if isinstance(e, Raw):
        return e.text
    if isinstance(e, Call):
        inner = "*" if e.star else ", ".join(map(_shown, e.args))
        return f"{e.name.upper()}({'DISTINCT ' if e.distinct else ''}{inner})"
    if isinstance(e, ir.Literal):
        return e.value[1] if isinstance(e.value, tuple) else "NULL" if e.value is None else repr(e.value)
    if isinstance(e, ir.ColumnRef):
        return f"{e.column.table}.{e.column.column}".lstrip(".")
    if isinstance(e, ir.Not):
        return f"NOT {_shown(e.expr)}"
    if isinstance(e, ir.Placeholder):
        return e.name
    return type(e).__name__ if not isinstance(e, tuple) else "CAST"


def translate(sql: str, profile: str = STRICT, params: Any = None) -> list:
    """All statements of ``sql``; an error in any means none."""
    return Parser(sql, profile, params).statements()
