"""From the engine's SQL dialect to Spark SQL text: literals, null order, division, LIKE, and the function library.

Text is cut into tokens, tokens are nested by parentheses, and what differs from Spark is replaced; Catalyst does all
planning. Types of operands come from the columns of the tables in reach (``types``: lower-case name to Spark type).
"""

from __future__ import annotations

import re
from collections.abc import Callable
from dataclasses import dataclass, field

from millrace.errors import SYNTAX, UNSUPPORTED, SqlError

_TOKEN = re.compile(r"""(?P<space>\s+|--[^\n]*|/\*.*?\*/)|(?P<string>'(?:[^']|'')*')|(?P<quoted>"(?:[^"]|"")*"|`[^`]*`)|(?P<number>\d+\.\d*(?:[eE][+-]?\d+)?|\.\d+(?:[eE][+-]?\d+)?|\d+(?:[eE][+-]?\d+)?)|(?P<word>[^\W\d]\w*)|(?P<op><=|>=|<>|!=|\|\||::|[-+*/%(),.;=<>?\[\]:])""", re.S)

#: Words that end an ORDER BY item or an operand.
_CLAUSES = {"limit", "offset", "fetch", "union", "intersect", "except", "from", "where", "group", "having", "order", "on", "join", "inner", "left", "right", "full", "cross", "rows", "range", "and", "or", "then", "when", "else", "end", "as", "asc", "desc", "nulls", "between", "in", "like", "is", "not", "select", "distinct", "set", "values", "by", "using", "case", "all"}
_JOINS = {"join", "inner", "left", "right", "full", "outer", "cross", "natural", "on", "using", "semi", "anti"}
_INTEGER = {"bigint", "int", "smallint", "tinyint", "integer", "long"}
_FLOAT = {"double", "float"}
#: Result families of functions.
_RESULTS = {"length": "int", "year": "int", "month": "int", "day": "int", "hour": "int", "minute": "int", "second": "int", "datediff": "int", "count": "int", "round": "float", "floor": "float", "ceil": "float", "avg": "float", "upper": "string", "lower": "string", "substr": "string", "substring": "string", "replace": "string", "trim": "string", "group_concat": "string", "date": "date", "now": "timestamp"}


@dataclass
class Token:
    kind: str
    text: str
    family: str | None = None

    @property
    def low(self) -> str:
        return self.text.lower() if self.kind == "word" else self.text


@dataclass
class Group:
    items: list = field(default_factory=list)
    kind: str = "group"
    low: str = "("
    done: str | None = None  # its text, if written already


def tokens(sql: str) -> list[Token]:
    out, at = [], 0
    while at < len(sql):
        m = _TOKEN.match(sql, at)
        if not m:
            raise SqlError(f"unexpected character {sql[at]!r} at {at}", SYNTAX)
        if m.lastgroup != "space":
            out.append(Token(m.lastgroup, m.group()))
        at = m.end()
    return out


def statements(script: str) -> list[str]:
    """The statements of a script, parted by semicolons outside of literals."""
    out, begin = [], 0
    for m in _TOKEN.finditer(script):
        if m.lastgroup == "op" and m.group() == ";":
            out.append(script[begin : m.start()])
            begin = m.end()
    return [s.strip() for s in [*out, script[begin:]] if tokens(s)]


def nested(flat: list[Token]) -> list:
    stack: list[list] = [[]]
    for t in flat:
        if t.kind == "op" and t.text == "(":
            stack.append([])
        elif t.kind == "op" and t.text == ")":
            if len(stack) == 1:
                raise SqlError("unbalanced )", SYNTAX)
            inner = stack.pop()
            stack[-1].append(Group(inner))
        else:
            stack[-1].append(t)
    if len(stack) > 1:
        raise SqlError("unbalanced (", SYNTAX)
    return stack[0]


def split_commas(items: list) -> list[list]:
    out: list[list] = [[]]
    for t in items:
        if t.low == "," and t.kind == "op":
            out.append([])
        else:
            out[-1].append(t)
    return out if out != [[]] else []


def _plain(name: str) -> str:
    return name.strip('"`').lower()


def string_value(text: str) -> str:
    return text[1:-1].replace("''", "'")


def literal(value: str) -> str:
    """A Spark string literal."""
    return "'" + value.replace("\\", "\\\\").replace("'", "\\'") + "'"


class _Scope:
    """What one SELECT can name: tables by alias, their column types looked up when asked for, and its own aliases."""

    def __init__(self):
        self.tables: dict[str, Callable[[], dict[str, str]]] = {}
        self.items: dict[str, list] = {}
        self._known: dict[str, dict[str, str]] = {}

    def columns(self, alias: str) -> dict[str, str]:
        if alias not in self._known:
            self._known[alias] = self.tables[alias]()
        return self._known[alias]


class Rewriter:
    """types: column types that hold everywhere (lower-case name to Spark type). tables: column types of a table by name,
    None if there is none. describe: column types of a query in Spark's SQL."""

    def __init__(self, types: dict[str, str] | None = None, tables: Callable[[str], dict[str, str] | None] | None = None, describe: Callable[[str], dict[str, str]] | None = None):
        self.types, self.tables, self.describe = types or {}, tables or (lambda _: None), describe or (lambda _: {})
        self.scopes: list[_Scope] = []
        self.ctes: dict[str, str] = {}

    def __call__(self, sql: str) -> str:
        return self.text(nested(tokens(sql)))

    # -- types ---------------------------------------------------------------------------------------------------------
    def family(self, items: list) -> str | None:
        """int, float, decimal, string, date, timestamp, bool or None (unknown) of an operand."""
        while len(items) > 1 and items[0].kind == "op" and items[0].low in ("+", "-"):
            items = items[1:]
        if not items:
            return None
        for marks in (("+", "-"), ("*", "/", "%")):
            parts: list[list] = [[]]
            for t in items:
                if t.kind == "op" and t.low in marks and parts[-1] and not (parts[-1][-1].kind == "op"):
                    parts.append([])
                else:
                    parts[-1].append(t)
            if len(parts) > 1:
                kinds = [self.family(p) for p in parts if p]
                if kinds[0] in ("date", "timestamp"):
                    return kinds[0]
                return "float" if "float" in kinds else "int" if set(kinds) == {"int"} else None
        if len(items) == 1:
            t = items[0]
            if t.kind == "raw":
                return t.family
            if isinstance(t, Group):
                if t.items and t.items[0].low == "select":
                    return self._first_family(t.items)
                return self.family(t.items)
            if t.kind == "number":
                return "float" if re.search(r"[.eE]", t.text) else "int"
            if t.kind == "string":
                return "string"
            if t.low in ("true", "false"):
                return "bool"
            return self._column(t.text)
        if items[0].low in ("date", "timestamp", "timestamp_ntz") and items[1].kind == "string":
            return "date" if items[0].low == "date" else "timestamp"
        if len(items) == 3 and items[1].low == "." and items[2].kind in ("word", "quoted"):
            return self._column(items[2].text, items[0].text)
        if len(items) == 2 and items[0].kind == "word" and isinstance(items[1], Group):
            name, args = items[0].low, items[1].items
            if name == "cast":
                k = max(i for i, t in enumerate(args) if t.low == "as")
                return self._family_of_type(args[k + 1].low)
            if name in _RESULTS:
                return _RESULTS[name]
            if name in ("sum", "min", "max", "abs", "coalesce"):
                return self.family([t for t in (split_commas(args) or [[]])[0] if t.low != "distinct"])
            return None
        if items[0].low == "case" and items[0].kind == "word":
            results = [self.family([items[i + 1]]) for i, t in enumerate(items[:-1]) if t.low in ("then", "else")]
            return "float" if "float" in results else "int" if results and set(results) == {"int"} else None
        return None

    def _column(self, name: str, alias: str | None = None) -> str | None:
        name, alias = _plain(name), _plain(alias) if alias else None
        for scope in reversed(self.scopes):
            if alias:
                if alias in scope.tables:
                    return self._family_of_type(scope.columns(alias).get(name, ""))
                continue
            kinds = {c[name] for c in map(scope.columns, scope.tables) if name in c}
            if kinds:
                return self._family_of_type(kinds.pop()) if len(kinds) == 1 else None
            if name in scope.items:
                return self.family(scope.items[name])
        return self._family_of_type(self.types.get(name, ""))

    def _first_family(self, select: list) -> str | None:
        """The family of a scalar subquery's value."""
        self.scopes.append(self._scope(select))
        try:
            stop = next((i for i, t in enumerate(select) if t.kind == "word" and t.low == "from"), len(select))
            first = [t for t in split_commas(select[1:stop])[0] if not (t.kind == "word" and t.low == "distinct")]
            cut = next((i for i, t in enumerate(first) if t.kind == "word" and t.low == "as"), len(first))
            return self.family(first[:cut])
        finally:
            self.scopes.pop()

    # -- scopes --------------------------------------------------------------------------------------------------------
    def _derived(self, inner: Group) -> dict[str, str]:
        if inner.done is None:
            inner.done = self.text(inner.items)
        head = "with " + ", ".join(self.ctes.values()) + " " if self.ctes else ""
        return self.describe(head + inner.done)

    def _scope(self, select: list) -> _Scope:
        """The tables of the FROM clause of one SELECT."""
        scope = _Scope()
        begin = next((i for i, t in enumerate(select) if t.kind == "word" and t.low == "from"), len(select))
        for item in split_commas(select[1:begin]):
            if len(item) > 2 and item[-2].kind == "word" and item[-2].low == "as":
                scope.items[_plain(item[-1].text)] = item[:-2]
        end = next((i for i in range(begin, len(select)) if select[i].kind == "word" and select[i].low in ("where", "group", "having", "order", "limit", "offset", "fetch")), len(select))
        self._tables(select[begin + 1 : end], scope)
        return scope

    def _tables(self, items: list, scope: _Scope) -> None:
        k, wanted = 0, True
        while k < len(items):
            t = items[k]
            if t.low == "," or t.kind == "word" and t.low == "join":
                wanted = True
            elif wanted and not (t.kind == "word" and t.low in _JOINS):
                wanted = False
                name = _plain(t.text) if not isinstance(t, Group) else None
                source = t
                k += 1
                if k + 1 < len(items) and items[k].low == "." and items[k].kind == "op":
                    k += 2
                if k < len(items) and items[k].kind == "word" and items[k].low == "as":
                    k += 1
                alias, names = name, None
                if k < len(items) and items[k].kind in ("word", "quoted") and (items[k].kind == "quoted" or items[k].low not in _JOINS and items[k].low not in _CLAUSES):
                    alias = _plain(items[k].text)
                    if k + 1 < len(items) and isinstance(items[k + 1], Group):
                        names, k = [_plain(c[0].text) for c in split_commas(items[k + 1].items)], k + 1
                    k += 1
                if isinstance(source, Group) and source.items and source.items[0].low not in ("select", "with", "values") and not isinstance(source.items[0], Group):
                    self._tables(source.items, scope)  # joins in parentheses
                else:
                    scope.tables[alias or f"({len(scope.tables)}"] = self._source(source, names)
                continue
            k += 1

    def _source(self, source: Token | Group, names: list[str] | None) -> Callable[[], dict[str, str]]:
        def found() -> dict[str, str]:
            if isinstance(source, Group):
                types = self._derived(source)
            elif _plain(source.text) in self.ctes:
                types = self.describe(f"with {', '.join(self.ctes.values())} select * from {_plain(source.text)}")
            else:
                types = self.tables(_plain(source.text)) or {}
            return dict(zip(names, types.values(), strict=False)) if names else types

        return found

    def _selects(self, items: list) -> str:
        """A query: its CTEs, then the SELECTs between set operations, each with its own scope."""
        outer, out, k = dict(self.ctes), [], 0
        if items[0].low == "with":
            k = 1
            while k < len(items):
                recursive = items[k].kind == "word" and items[k].low == "recursive"
                k += recursive
                name, names = items[k], None
                if isinstance(items[k + 1], Group):
                    names, k = items[k + 1], k + 1
                body = items[k + 2]
                if items[k + 1].low != "as" or not isinstance(body, Group):
                    raise SqlError("WITH needs name AS (SELECT ...)", SYNTAX)
                head = self._clauses([name, *([names] if names else [])])
                made = f"{head} as ({self.text(body.items)})"
                self.ctes[_plain(name.text)] = made
                out.append(("with recursive " if recursive else "with ") + made if len(out) == 0 else ", " + made)
                k += 3
                if k < len(items) and items[k].low == ",":
                    k += 1
                    continue
                break
            out = ["".join(out)]
        core: list = []

        def flush() -> None:
            if core:
                self.scopes.append(self._scope(core) if core[0].low == "select" else _Scope())
                out.append(self._clauses(core))
                self.scopes.pop()
                core.clear()

        for t in items[k:]:
            if t.kind == "word" and t.low in ("union", "intersect", "except"):
                flush()
                out.append(t.low)
            elif not core and t.kind == "word" and t.low in ("all", "distinct"):
                out.append(t.low)
            else:
                core.append(t)
        flush()
        self.ctes = outer
        return " ".join(out)

    @staticmethod
    def _family_of_type(kind: str) -> str | None:
        kind = kind.lower()
        return "int" if kind in _INTEGER else "float" if kind in _FLOAT | {"real"} else "string" if kind in ("string", "text", "varchar", "char") else "decimal" if kind.startswith("decimal") else "bool" if kind in ("boolean", "bool") else "date" if kind == "date" else "timestamp" if kind.startswith("timestamp") else None

    # -- rewriting -----------------------------------------------------------------------------------------------------
    def text(self, items: list) -> str:
        return self._selects(items) if items and any(t.kind == "word" and t.low in ("select", "with") for t in items) else self._clauses(items)

    def _clauses(self, items: list) -> str:
        items = self._divisions(items)
        self._check(items)
        out: list[str] = []
        k = 0
        while k < len(items):
            t = items[k]
            before = items[k - 1] if k else None
            after = items[k + 1] if k + 1 < len(items) else None
            if isinstance(t, Group):
                out.append(f"({t.done or self.text(t.items)})")
            elif t.kind == "raw":
                out.append(t.text)
            elif t.kind == "string":
                value = string_value(t.text)
                if before is not None and before.low == "like":
                    value = value.replace("\\", "\\\\")
                out.append(literal(value))
            elif t.kind == "quoted":
                out.append("`" + t.text[1:-1].replace('""', '"').lower() + "`")
            elif t.kind == "number":
                out.append(self._number(t, items, k))
            elif t.kind == "word" and isinstance(after, Group) and (call := self._call(t.low, after.items)) is not None:
                over = items[k + 2] if k + 2 < len(items) else None
                if over is not None and over.low == "over":
                    raise SqlError("window functions are not supported", UNSUPPORTED)
                out.append(call)
                k += 1
            elif t.low == "timestamp" and after is not None and after.kind == "string":
                out.append("timestamp_ntz")
            elif t.low == "order" and after is not None and after.low == "by":
                done, used = self._order(items[k + 2 :])
                out.append("order by " + done)
                k += 1 + used
            elif t.low == "over" and isinstance(after, Group):
                raise SqlError("window functions are not supported", UNSUPPORTED)
            elif t.low == "escape":
                raise SqlError("LIKE ... ESCAPE is not supported", UNSUPPORTED)
            else:
                out.append(t.low if t.kind == "word" else t.text)
            k += 1
        return re.sub(r" ?\. ?(?=[`\w*])", ".", " ".join(out))

    @staticmethod
    def _number(t: Token, items: list, k: int) -> str:
        before = items[k - 1].low if k else ""
        if re.search(r"[.eE]", t.text):
            return t.text + "D"
        if before in ("limit", "offset", "interval", "fetch", "first") or (before in ("by", ",") and _alone(items, k)):
            return t.text
        if int(t.text) >= 1 << 63:
            return t.text + "D"
        return t.text + "L"

    def _order(self, items: list) -> tuple[str, int]:
        """The items of an ORDER BY with null placement written out: ascending last, descending first."""
        parts, now, used = [], [], 0
        for t in items:
            if t.kind == "word" and t.low in ("limit", "offset", "fetch", "union", "intersect", "except", "rows", "range"):
                break
            used += 1
            if t.kind == "op" and t.low == ",":
                parts.append(now)
                now = []
            else:
                now.append(t)
        parts.append(now)
        out = []
        for p in parts:
            words = [t.low for t in p if t.kind == "word"]
            key = [t for t in p if t.low not in ("asc", "desc") or t.kind != "word"]
            down = "desc" in words
            if "nulls" in words:
                at = next(i for i, t in enumerate(p) if t.low == "nulls")
                nulls = p[at + 1].low
                key = [t for t in p[:at] if t.low not in ("asc", "desc") or t.kind != "word"]
            else:
                nulls = "first" if down else "last"
            alone = key[0].text if len(key) == 1 and key[0].kind == "number" else self.text(key)
            out.append(f"{alone} {'desc' if down else 'asc'} nulls {nulls}")
        return ", ".join(out), used

    def _divisions(self, items: list) -> list:
        """a / b as a call, by the types of the operands."""
        out: list = []
        k = 0
        while k < len(items):
            t = items[k]
            if t.kind == "op" and t.low == "/":
                begin = _operand_begin(out)
                end = _operand_end(items, k + 1)
                a, b = out[begin:], items[k + 1 : end]
                whole = self.family(a) == "int" and self.family(b) == "int"
                left, right = self.text(a), self.text(b)
                made = f"(({left}) div nullif(({right}), 0L))" if whole else f"try_divide(({left}), ({right}))"
                out[begin:] = [Token("raw", made, "int" if whole else "float")]
                k = end
            elif t.kind == "op" and t.low in ("+", "-") and out and k + 2 < len(items) and items[k + 1].low == "interval" and items[k + 1].kind == "word":
                end = k + 3
                if end < len(items) and items[end].kind == "word" and items[end].low.rstrip("s") in ("year", "month", "day", "hour", "minute", "second", "week"):
                    end += 1
                begin = _operand_begin(out)
                if self.family(out[begin:]) == "date":
                    # A DATE stays a DATE: what the interval has of hours and less floors to the day.
                    moved = f"cast(cast({self.text(out[begin:])} as timestamp_ntz) {t.low} interval {' '.join(x.text for x in items[k + 2 : end])} as date)"
                    out[begin:] = [Token("raw", moved, "date")]
                    k = end
                else:
                    out.append(t)
                    k += 1
            else:
                out.append(t)
                k += 1
        return out

    def _check(self, items: list) -> None:
        """Comparisons of two plain operands must be of one family, numbers counting as one."""
        same = {"int": "number", "float": "number"}
        for k, t in enumerate(items):
            if t.kind == "op" and t.low in ("=", "<", ">", "<=", ">=", "<>", "!=") and 0 < k < len(items) - 1:
                begin, end = _operand_begin(items[:k]), _operand_end(items, k + 1)
                if begin and items[begin - 1].low in ("+", "-", "*", "/", "||") or end < len(items) and items[end].low in ("+", "-", "*", "/", "||"):
                    continue
                a, b = self.family(items[begin:k]), self.family(items[k + 1 : end])
                a, b = same.get(a, a), same.get(b, b)
                if a and b and a != b and not {a, b} == {"number", "decimal"}:
                    raise SqlError(f"type mismatch: cannot compare {a} with {b}", "42804")

    def _call(self, name: str, args: list) -> str | None:
        each = split_commas(args)
        one = lambda i: self.text(each[i])
        need = {"upper": (1, 1), "lower": (1, 1), "length": (1, 1), "substr": (2, 3), "replace": (3, 3), "abs": (1, 1), "round": (1, 2), "floor": (1, 1), "ceil": (1, 1), "now": (0, 0), "year": (1, 1), "month": (1, 1), "day": (1, 1), "hour": (1, 1), "minute": (1, 1), "second": (1, 1), "date_trunc": (2, 2), "datediff": (3, 3), "group_concat": (1, 2)}.get(name)
        if need is None and name not in ("cast", "date", "trim", "substring"):
            return None
        if need and not need[0] <= len(each) <= need[1]:
            raise SqlError(f"{name.upper()} takes {need[0]} to {need[1]} arguments, not {len(each)}", SYNTAX)
        if name in ("upper", "lower"):
            a, b = "abcdefghijklmnopqrstuvwxyz", "ABCDEFGHIJKLMNOPQRSTUVWXYZ"
            return f"translate({one(0)}, '{a if name == 'upper' else b}', '{b if name == 'upper' else a}')"
        if name == "length":
            return f"cast(char_length({one(0)}) as bigint)"
        if name == "substr":
            return _substr(*[one(i) for i in range(len(each))])
        if name == "trim" and len(each) == 1:
            return f"trim({one(0)})"
        if name == "round":
            x, d = one(0), one(1) if len(each) == 2 else "0L"
            scale = f"pow(10.0D, cast({d} as bigint))"
            return f"(case when {d} > 308 then cast({x} as double) when {d} < -308 then 0.0D else round(cast({x} as double) * {scale}) / {scale} end)"
        if name in ("floor", "ceil"):
            return f"cast({name}({one(0)}) as double)"
        if name == "now":
            return "convert_timezone(current_timezone(), 'UTC', cast(current_timestamp() as timestamp_ntz))"
        if name == "date" and len(each) == 1:
            return f"cast({one(0)} as date)"
        if name in ("year", "month", "day", "hour", "minute", "second"):
            return f"cast({name}({one(0)}) as bigint)"
        if name == "date_trunc":
            kind = self.family(each[1])
            return f"cast(date_trunc({one(0)}, {one(1)}) as {'date' if kind == 'date' else 'timestamp_ntz'})"
        if name == "datediff":
            unit = string_value(each[0][0].text) if each[0][0].kind == "string" else each[0][0].low
            return _datediff(unit.lower(), f"cast({one(1)} as timestamp_ntz)", f"cast({one(2)} as timestamp_ntz)")
        if name == "group_concat":
            if any(t.low == "distinct" for t in args):
                raise SqlError("GROUP_CONCAT(DISTINCT ...) is not supported", UNSUPPORTED)
            x, sep, by = each[0], literal(string_value(each[1][0].text)) if len(each) == 2 else "','", None
            for i, t in enumerate(x):
                if t.low == "order":
                    x, by = x[:i], self._order(x[i + 2 :])[0]
                    break
            return f"listagg({self.text(x)}, {sep}) within group (order by {by or self.text(x)})"
        if name == "cast":
            k = max((i for i, t in enumerate(args) if t.low == "as"), default=None)
            if k is None:
                raise SqlError("CAST needs AS", SYNTAX)
            return f"cast({self.text(args[:k])} as {spark_type(args[k + 1 :])})"
        return None


def _substr(s: str, start: str, n: str | None = None) -> str:
    place = f"(case when {start} < 0 then char_length({s}) + {start} + 1 else {start} end)"
    if n is None:
        return f"substring({s}, cast(greatest({place}, 1) as int))"
    end = f"least(greatest({place} - 1, 0), char_length({s}))"
    begin = f"greatest({end} + ({n}), 0)"
    return f"(case when {n} >= 0 then substring({s}, cast(greatest({place}, 1) as int), cast(greatest({n} - greatest(1 - {place}, 0), 0) as int)) when {n} < 0 then substring({s}, cast({begin} + 1 as int), cast({end} - {begin} as int)) end)"


def _datediff(unit: str, a: str, b: str) -> str:
    if unit not in ("year", "month", "day", "hour", "minute", "second"):
        raise SqlError(f"DATEDIFF: unit {unit} is not supported", UNSUPPORTED)
    if unit not in ("month", "year"):
        return f"timestampdiff({unit.upper()}, {a}, {b})"
    months = f"cast((year({b}) - year({a})) * 12 + month({b}) - month({a}) as bigint)"
    tail = lambda x: f"timestampdiff(MICROSECOND, cast(date_trunc('month', {x}) as timestamp_ntz), {x})"
    full = f"(case when {months} > 0 and {tail(b)} < {tail(a)} then {months} - 1L when {months} < 0 and {tail(b)} > {tail(a)} then {months} + 1L else {months} end)"
    return full if unit == "month" else f"({full} div 12L)"


def _alone(items: list, k: int) -> bool:
    """Whether a number is a whole item of GROUP BY (a position)."""
    after = items[k + 1] if k + 1 < len(items) else None
    if after is not None and not (after.low == "," or after.kind == "word" and after.low in _CLAUSES):
        return False
    for t in reversed(items[:k]):
        if t.kind == "word" and t.low in ("by",):
            return True
        if t.kind == "word" and t.low in _CLAUSES:
            return False
    return False


def _operand_begin(items: list) -> int:
    """Where the factor that ends items begins."""
    k = len(items) - 1
    if k < 0:
        raise SqlError("an operand is missing", SYNTAX)
    while True:
        t = items[k]
        if isinstance(t, Group) and k and items[k - 1].kind == "word" and items[k - 1].low not in _CLAUSES:
            k -= 1
        elif t.kind == "word" and t.low == "end":
            depth = 0
            while True:
                depth += (items[k].low == "end") - (items[k].low == "case")
                if not depth:
                    break
                k -= 1
        elif t.kind == "string" and k and items[k - 1].low in ("date", "timestamp"):
            k -= 1
        if k > 1 and items[k - 1].kind == "op" and items[k - 1].low == ".":
            k -= 2
            continue
        if k > 1 and items[k - 1].kind == "op" and items[k - 1].low == "*" and items[k - 2].kind != "op":
            k -= 2
            continue
        if k and items[k - 1].kind == "op" and items[k - 1].low == "-" and (k == 1 or items[k - 2].kind == "op" or items[k - 2].kind == "word" and items[k - 2].low in _CLAUSES):
            k -= 1
        return k


def _operand_end(items: list, k: int) -> int:
    """Where the factor that begins at k ends."""
    while k < len(items) and items[k].kind == "op" and items[k].low in ("-", "+"):
        k += 1
    if k >= len(items):
        raise SqlError("an operand is missing", SYNTAX)
    if items[k].low == "case" and items[k].kind == "word":
        depth = 0
        while k < len(items):
            depth += (items[k].low == "case") - (items[k].low == "end")
            k += 1
            if not depth:
                return k
        raise SqlError("CASE without END", SYNTAX)
    if items[k].low in ("date", "timestamp") and k + 1 < len(items) and items[k + 1].kind == "string":
        return k + 2
    k += 1
    while k + 1 < len(items) and items[k].kind == "op" and items[k].low == ".":
        k += 2
    if k < len(items) and isinstance(items[k], Group) and items[k - 1].kind == "word":
        k += 1
    return k


#: Spellings of the column types.
_TYPES = {
    **dict.fromkeys(("int", "integer", "bigint", "smallint", "tinyint", "mediumint", "int2", "int4", "int8"), "bigint"),
    **dict.fromkeys(("float", "real", "double", "float4", "float8"), "double"),
    **dict.fromkeys(("bool", "boolean"), "boolean"),
    **dict.fromkeys(("blob", "bytea", "binary", "varbinary"), "binary"),
    **dict.fromkeys(("datetime", "timestamp"), "timestamp_ntz"),
    "date": "date",
}


def spark_type(items: list) -> str:
    """The Spark type of a declared one; an unknown name is a string."""
    if not items:
        raise SqlError("a type is missing", SYNTAX)
    name = items[0].low
    size = items[1].items if len(items) > 1 and isinstance(items[1], Group) else None
    if name in ("decimal", "numeric"):
        numbers = [int(p[0].text) for p in split_commas(size or [])]
        if not numbers or not 1 <= numbers[0] <= 38 or (numbers[1:] or [0])[0] > numbers[0]:
            raise SqlError("DECIMAL needs a precision of 1 to 38 and a scale of at most that", SYNTAX)
        return f"decimal({numbers[0]},{(numbers[1:] or [0])[0]})"
    if name in ("interval", "time") or any(t.low == "zone" for t in items[1:4]) and "without" not in [t.low for t in items]:
        raise SqlError(f"type {name} is not supported", UNSUPPORTED)
    if name in ("blob", "bytea") and size:
        raise SqlError("BLOB takes no length", SYNTAX)
    return _TYPES.get(name, "string")
