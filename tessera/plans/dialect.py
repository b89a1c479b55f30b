"""A parser of the host dialect's SQL that writes Spark SQL with the same meaning.

Text is parsed by recursive descent and written again. What differs is mapped where it stands: names and defaults of
functions, rounding casts, division, NULLS LAST, literals, types. Clauses that Spark's grammar lacks (QUALIFY, DISTINCT ON,
percentages, ASOF and POSITIONAL joins, file functions with options) become subqueries, or a DataFrame of the library's
operators behind a temporary view; the caller hands in a Views object for those.
"""

from __future__ import annotations

import re

from .dialect_functions import AGGREGATES, FUNCTIONS, PARTS, cast_text, divide_text, quoted, sorted_list, spark_string


class DialectError(ValueError):
    """Text that isn't of the dialect, or has no meaning in Spark."""


_TOKEN = re.compile(
    r"""(?P<skip>\s+|--[^\n]*|/\*.*?\*/)|(?P<str>'(?:[^']|'')*')|(?P<quoted>"(?:[^"]|"")*"|`[^`]*`)|(?P<num>(?:\d[\d_]*\.?\d*|\.\d+)(?:[eE][+-]?\d+)?)"""
    r"""|(?P<word>[^\W\d]\w*)|(?P<param>\$\w+|\?)|(?P<op>::|:=|->>|->|//|\*\*|!~~\*|!~~|~~\*|~~|!~|<=|>=|<>|!=|==|\|\||[-+*/%^<>=(),.;\[\]{}:~@&|])""",
    re.DOTALL,
)
#: Words that end an item: never an alias without AS.
RESERVED = set("SELECT FROM WHERE GROUP HAVING ORDER LIMIT OFFSET UNION EXCEPT INTERSECT QUALIFY WINDOW USING ON JOIN INNER LEFT RIGHT FULL CROSS SEMI ANTI ASOF POSITIONAL NATURAL AS AND OR NOT IN IS LIKE ILIKE SIMILAR BETWEEN CASE WHEN THEN ELSE END ASC DESC NULLS WITH TABLESAMPLE PIVOT UNPIVOT LATERAL FILTER OVER EXCLUDE REPLACE VALUES SET RETURNING FETCH FOR ESCAPE COLLATE BY".split())


class Expr:
    """Spark text of an expression, and what the writer needs to know of it."""

    def __init__(self, sql: str, kind: str = "", value: object = None):
        self.sql, self.kind, self.value = sql, kind, value

    def __str__(self) -> str:
        return self.sql


def tokens(text: str) -> list[tuple[str, str, int, int]]:
    """(kind, text, start, end) without space and comments."""
    out, at = [], 0
    while at < len(text):
        m = _TOKEN.match(text, at)
        if not m:
            raise DialectError(f"unexpected {text[at : at + 20]!r}")
        if m.lastgroup != "skip":
            out.append((m.lastgroup, m[0], m.start(), m.end()))
        at = m.end()
    return out


class Views:
    """What stands for constructs that are DataFrames: the engine overrides these; without one they are errors."""

    def files(self, function: str, paths: list[str], options: dict[str, object]) -> str:
        raise DialectError(f"{function} with a list or options needs an engine")

    def ordered_percent(self, query: str, keys: list[tuple[str, str]], percent: float) -> str:
        raise DialectError("LIMIT n % needs an engine")

    def asof(self, left: tuple[str, list[str]], right: tuple[str, list[str]], conditions: list[tuple[str, str, str]], how: str, using: list[str], ctes: str) -> str:
        raise DialectError("ASOF JOIN needs an engine")

    def pairs(self, left: tuple[str, list[str]], right: tuple[str, list[str]], conditions: list[tuple[str, str, str]], how: str, ctes: str) -> str | None:
        return None  # the join stays as it is written

    def by_name(self, left: str, right: str, every: bool, ctes: str) -> str:
        raise DialectError("UNION BY NAME needs an engine")

    def positional(self, left: tuple[str, list[str]], right: tuple[str, list[str]], ctes: str) -> str:
        raise DialectError("POSITIONAL JOIN needs an engine")


class Parser:
    """One statement. Methods named after a construct consume its tokens and return Spark text (or an Expr)."""

    def __init__(self, text: str, views: Views | None = None, macros: dict[str, tuple[list[str], str]] | None = None):
        self.macros, self.meant = macros or {}, {}  # macros: (parameters, body) by name; meant: what parameters stand for
        self.text, self.toks, self.at = text, tokens(text), 0
        self.views = views or Views()
        self.ctes: list[str] = []
        self.recursive = False
        self.in_try = 0
        self.unnests: list[list[str]] = []
        self.hidden: list[list[str]] = []
        self.valued = False  # within a SELECT list, where IN (query) gives true, false or null
        self.n = 0

    # Tokens.

    def peek(self, k: int = 0) -> str:
        """Upper-case text of a word, the text of an operator, or '' at the end and for other kinds."""
        i = self.at + k
        if i >= len(self.toks):
            return ""
        kind, text = self.toks[i][:2]
        return text.upper() if kind == "word" else text if kind in ("op", "param") else ""

    def kind(self, k: int = 0) -> str:
        return self.toks[self.at + k][0] if self.at + k < len(self.toks) else ""

    def take(self, *wanted: str) -> bool:
        """Consumes the words or operators if they all stand here."""
        if all(self.peek(k) == w for k, w in enumerate(wanted)):
            self.at += len(wanted)
            return True
        return False

    def need(self, *wanted: str) -> None:
        for w in wanted:
            if not self.take(w):
                found = self.toks[self.at][1] if self.at < len(self.toks) else "the end"
                raise DialectError(f"expected {w}, found {found}")

    def raw(self) -> str:
        if self.at >= len(self.toks):
            raise DialectError("unexpected end")
        self.at += 1
        return self.toks[self.at - 1][1]

    def fresh(self, name: str) -> str:
        self.n += 1
        return f"__{name}{self.n}"

    def name(self) -> str:
        """An identifier, quoted where the dialect quotes it."""
        kind = self.kind()
        if kind not in ("word", "quoted"):
            raise DialectError(f"expected a name, found {self.toks[self.at][1] if kind else 'the end'}")
        text = self.raw()
        return quoted(text[1:-1].replace('""', '"')) if kind == "quoted" else text

    def dotted(self) -> str:
        parts = [self.name()]
        while self.peek() == "." and self.kind(1) in ("word", "quoted"):
            self.at += 1
            parts.append(self.name())
        return ".".join(parts)

    def comma_list(self, item, close: str = ")") -> list:
        """Items up to close, which is consumed."""
        out = []
        while not self.take(close):
            out.append(item())
            if not self.take(","):
                self.need(close)
                break
            if close == "" and not self.peek():
                break
        return out

    def items(self, item) -> list:
        out = [item()]
        while self.take(","):
            out.append(item())
        return out

    # Queries.

    def starts_query(self, k: int = 0) -> bool:
        while self.peek(k) == "(":
            k += 1
        return self.peek(k) in ("SELECT", "WITH", "VALUES") or (self.peek(k) == "FROM" and self.kind(k + 1) != "")

    def query(self) -> str:
        was, self.valued = self.valued, False
        out = self.whole_query()
        self.valued = was
        return out

    def whole_query(self) -> str:
        depth, was_recursive = len(self.ctes), self.recursive
        own = []
        if self.take("WITH"):
            self.recursive = self.take("RECURSIVE") or self.recursive
            for cte in iter(lambda: self.cte(), None):
                own.append(cte)
                self.ctes.append(cte)
                if not self.take(","):
                    break
        head = f"WITH {'RECURSIVE ' if self.recursive and own else ''}{', '.join(own)} " if own else ""
        body = self.body()
        del self.ctes[depth:]
        self.recursive = was_recursive
        return head + body

    def with_text(self) -> str:
        return f"WITH {'RECURSIVE ' if self.recursive else ''}{', '.join(self.ctes)} " if self.ctes else ""

    def cte(self) -> str:
        name = self.name()
        cols = f"({', '.join(self.comma_list(self.name))})" if self.take("(") else ""
        self.need("AS")
        self.take("NOT")
        self.take("MATERIALIZED")
        self.need("(")
        inner = self.query()
        self.need(")")
        return f"{name}{cols} AS ({inner})"

    def body(self) -> str:
        """Set operations over SELECTs, then ORDER BY and LIMIT."""
        text, core = self.terms()
        order = self.order_by() if self.take("ORDER", "BY") else []
        limit = offset = None
        percent = None
        while self.peek() in ("LIMIT", "OFFSET", "FETCH"):
            word = self.raw().upper()
            if word == "OFFSET":
                offset = self.expr().sql
                self.take("ROWS") or self.take("ROW")
                continue
            if word == "FETCH":
                self.take("FIRST") or self.need("NEXT")
            at = self.at
            if self.kind() == "num" and (self.peek(1) == "%" or self.peek(1) == "PERCENT"):
                percent = float(self.raw())
                self.raw()
            elif self.take("ALL"):
                pass
            else:
                self.at = at
                limit = self.expr().sql
            if word == "FETCH":
                (self.take("ROWS") or self.take("ROW")) and self.need("ONLY")
        if core is not None and core["hides"]:
            return self.outer(core, order, limit, offset, percent)
        if percent is not None:
            if core is None:
                core = {"items": "*", "rest": f" FROM ({text}) AS {self.fresh('q')}", "hides": []}
            return self.outer(core, order, limit, offset, percent)
        tail = f" ORDER BY {', '.join(e if d is None else f'{e} {d}' for e, d in order)}" if order else ""
        return text + tail + (f" LIMIT {limit}" if limit else "") + (f" OFFSET {offset}" if offset else "")

    def outer(self, core: dict, order: list, limit, offset, percent) -> str:
        """A SELECT whose rows are chosen by hidden columns: those of QUALIFY and DISTINCT ON, and the sort keys."""
        hides, keys, where = list(core["hides"]), [], []
        for name, _, test in core["hides"]:
            where.append(test.format(name))
        for text, direction in order:
            k = self.fresh("key")
            place = int(text) - 1 if text.isdigit() else -1
            meant = core["each"][place] if 0 <= place < len(core.get("each", [])) else core.get("alias", {}).get(text, text)
            hides.append((k, meant, ""))
            keys.append((k, direction or ""))
        inner = f"SELECT {core['items']}, {', '.join(f'{e} AS {k}' for k, e, _ in hides)}{core['rest']}" if hides else f"SELECT {core['items']}{core['rest']}"
        out = f"SELECT * FROM ({inner}) AS {self.fresh('q')}" + (f" WHERE {' AND '.join(where)}" if where else "")
        except_ = f" EXCEPT ({', '.join(k for k, _, _ in hides)})" if hides else ""
        if percent is not None:
            view = self.views.ordered_percent(self.with_text() + out, keys, percent)
            return f"SELECT *{except_} FROM {view}"
        out = f"SELECT *{except_}" + out[len("SELECT *") :]
        if keys:
            out += f" ORDER BY {', '.join(f'{k} {d}' for k, d in keys)}"
        return out + (f" LIMIT {limit}" if limit else "") + (f" OFFSET {offset}" if offset else "")

    def terms(self) -> tuple[str, dict | None]:
        text, core = self.term()
        while self.peek() in ("UNION", "EXCEPT", "INTERSECT"):
            if core is not None and core["hides"]:
                text = self.outer(core, [], None, None, None)
            word = self.raw().upper()
            how = " ALL" if self.take("ALL") else ""
            self.take("DISTINCT")
            by_name = self.take("BY", "NAME")
            other, its = self.term()
            if its is not None and its["hides"]:
                other = self.outer(its, [], None, None, None)
            if by_name:
                text, core = f"SELECT * FROM {self.views.by_name(text, other, bool(how), self.with_text())}", None
                continue
            # INTERSECT binds closer in both dialects, so the chain is written as it stands.
            text, core = f"{text} {word}{how} {other}", None
        return text, core

    def term(self) -> tuple[str, dict | None]:
        if self.peek() == "(":
            self.at += 1
            inner = self.query()
            self.need(")")
            return f"({inner})", None
        if self.take("VALUES"):
            return f"VALUES {', '.join(self.items(self.value_row))}", None
        return self.select()

    def value_row(self) -> str:
        self.need("(")
        return f"({', '.join(e.sql for e in self.comma_list(self.expr))})"

    def select(self) -> tuple[str, dict]:
        from_first = None
        self.unnests.append([])
        self.hidden.append([])
        at_items = None
        if self.take("FROM"):
            from_first = self.from_items()
            if self.peek() != "SELECT":
                at_items = [("*", None)]
        distinct, on = "", []
        # The FROM clause is read before the items: they need to know its hidden columns.
        start = self.at
        if at_items is None:
            self.need("SELECT")
            start = self.at
            if from_first is None:
                self.skip_to_from()
                end_items = self.at
                from_first = self.from_items() if self.take("FROM") else ""
                end_from, self.at = self.at, start
            else:
                end_from = None
            if self.take("DISTINCT"):
                distinct = "DISTINCT "
                if self.take("ON"):
                    self.need("(")
                    on, distinct = [e.sql for e in self.comma_list(self.expr)], ""
            else:
                self.take("ALL")
            was, self.valued = self.valued, True
            at_items = self.items(self.select_item)
            self.valued = was
            if end_from is not None:
                if self.at != end_items:
                    raise DialectError(f"unexpected {self.raw()} in the SELECT list")
                self.at = end_from
        alias = {a: e for e, a in at_items if a}
        text = ", ".join(f"{e} AS {a}" if a else e for e, a in at_items)
        rest = f" FROM {from_first}" if from_first else ""
        if self.take("USING", "SAMPLE"):
            rest += self.sample()
        if self.take("WHERE"):
            rest += self.laterals(not rest) + f" WHERE {self.expr()}"
        else:
            rest += self.laterals(not rest)
        if self.take("GROUP", "BY"):
            rest += f" GROUP BY {self.group_by()}"
        if self.take("HAVING"):
            rest += f" HAVING {self.expr()}"
        if self.take("WINDOW"):
            rest += f" WINDOW {', '.join(self.items(self.named_window))}"
        hides = []
        if self.take("QUALIFY"):
            test = self.expr().sql
            hides.append((self.fresh("qualify"), self.with_aliases(test, alias), "{}"))
        if self.take("USING", "SAMPLE"):
            rest += self.sample()
        self.unnests.pop()
        self.hidden.pop()
        core = {"items": distinct + text, "rest": rest, "hides": hides, "alias": alias, "each": [e for e, _ in at_items]}
        if on:
            order = self.peek_order()
            window = f"row_number() OVER (PARTITION BY {', '.join(self.with_aliases(k, alias) for k in on)} ORDER BY {', '.join(f'{self.with_aliases(e, alias)} {d or str()}'.strip() for e, d in order) or ', '.join(on)})"
            hides.append((self.fresh("first"), window, "{} = 1"))
        return f"SELECT {distinct}{text}{rest}", core

    def peek_order(self) -> list:
        at = self.at
        order = self.order_by() if self.take("ORDER", "BY") else []
        self.at = at
        return order

    def skip_to_from(self) -> None:
        """To the FROM of this SELECT, or to its end."""
        depth = 0
        while self.at < len(self.toks):
            t = self.peek()
            if depth == 0 and t == "FROM" and not (self.peek(-1) == "DISTINCT" or self.is_distinct_from()):
                return
            if depth == 0 and t in ("WHERE", "GROUP", "HAVING", "WINDOW", "QUALIFY", "ORDER", "LIMIT", "OFFSET", "UNION", "INTERSECT", ";") or (t == "EXCEPT" and depth == 0 and self.peek(1) != "("):
                return
            if t in ("(", "[", "{"):
                depth += 1
            elif t in (")", "]", "}"):
                if depth == 0:
                    return
                depth -= 1
            self.at += 1

    def is_distinct_from(self) -> bool:
        return self.at >= 2 and self.toks[self.at - 1][1].upper() == "DISTINCT"

    @staticmethod
    def with_aliases(text: str, alias: dict[str, str]) -> str:
        """Names of the SELECT list within an expression's text, replaced by what they stand for."""
        return re.sub(r"'(?:[^'\\]|\\.)*'|(?<![\w.`])[^\W\d]\w*(?![\w(.`])", lambda m: f"({alias[m[0]]})" if m[0] in alias else m[0], text)

    def select_item(self) -> tuple[str, str | None]:
        if self.peek() == "*" or (self.kind() in ("word", "quoted") and self.peek(1) == "." and self.peek(2) == "*"):
            return self.star(), None
        if self.at >= len(self.toks):
            raise DialectError("unexpected end")
        start = self.toks[self.at][2]
        e = self.expr()
        end = self.toks[self.at - 1][3]
        if self.take("AS"):
            return e.sql, self.name()
        if self.kind() == "quoted" or (self.kind() == "word" and self.peek() not in RESERVED):
            return e.sql, self.name()
        if e.kind == "column":
            return e.sql, None
        return e.sql, quoted(" ".join(self.text[start:end].split()))

    def star(self) -> str:
        prefix = "" if self.peek() == "*" else self.name() + "."
        if prefix:
            self.need(".")
        self.need("*")
        gone = list(self.hidden[-1]) if self.hidden and not prefix else []
        if self.take("EXCLUDE") or (self.peek() == "EXCEPT" and self.peek(1) == "(" and self.take("EXCEPT")):
            gone += self.comma_list(self.name) if self.take("(") else [self.name()]
        if self.peek() == "REPLACE":
            raise DialectError("* REPLACE: name the columns")
        return f"{prefix}*" + (f" EXCEPT ({', '.join(gone)})" if gone else "")

    def laterals(self, alone: bool) -> str:
        """LATERAL VIEWs of the unnest() calls of the SELECT list."""
        made = self.unnests[-1]
        text = "".join(f" LATERAL VIEW posexplode({e}) {e_alias} AS {i}, {x}" for e, e_alias, i, x in made)
        return (" FROM VALUES (1) AS __one(__c)" if alone and made else "") + text

    def unnested(self, e: str, field: int) -> str:
        """The place (0-based) or the element of a list that the SELECT unnests."""
        if not self.unnests:
            raise DialectError("unnest() outside a SELECT")
        made = self.unnests[-1]
        for row in made:
            if row[0] == e:
                return f"{row[1]}.{row[2 + field]}"
        if made:
            raise DialectError("lists of several columns unnested together")
        made.append((e, self.fresh("u"), self.fresh("i"), self.fresh("x")))
        return self.unnested(e, field)

    def group_by(self) -> str:
        if self.take("ALL"):
            return "ALL"
        return ", ".join(self.items(self.group_item))

    def group_item(self) -> str:
        if self.take("GROUPING", "SETS"):
            self.need("(")
            return f"GROUPING SETS ({', '.join(self.comma_list(self.group_item))})"
        if self.peek() in ("ROLLUP", "CUBE") and self.peek(1) == "(":
            word = self.raw().upper()
            self.need("(")
            return f"{word} ({', '.join(self.comma_list(self.group_item))})"
        if self.peek() == "(" and self.peek(1) == ")":
            self.at += 2
            return "()"
        if self.peek() == "(":
            at = self.at
            self.at += 1
            inside = [e.sql for e in self.comma_list(self.expr)]
            if self.peek() in (",", ")", "") or self.peek() in RESERVED:
                return f"({', '.join(inside)})"
            self.at = at
        return self.expr().sql

    def order_by(self) -> list[tuple[str, str | None]]:
        """(key, direction with its place of nulls); nulls are last either way unless the text says otherwise."""
        if self.take("ALL"):
            return [("ALL", "NULLS LAST")]

        def item() -> tuple[str, str]:
            e = self.expr().sql
            way = "DESC" if self.take("DESC") else "ASC"
            if way == "ASC":
                self.take("ASC")
            place = "LAST"
            if self.take("NULLS"):
                place = self.raw().upper()
            return e, f"{way} NULLS {place}"

        return self.items(item)

    def sample(self) -> str:
        amount = self.raw() if self.kind() == "num" else None
        if amount is None:  # reservoir(20), bernoulli(5%)
            self.name()
            self.need("(")
            amount = self.raw()
            unit = "PERCENT" if self.take("%") or self.take("PERCENT") else "ROWS"
            self.take("ROWS")
            self.need(")")
        else:
            unit = "PERCENT" if self.take("%") or self.take("PERCENT") else "ROWS"
            self.take("ROWS")
            if self.take("("):
                self.comma_list(self.raw_item)
        seed = f" REPEATABLE ({self.paren_number()})" if self.take("REPEATABLE") else ""
        return f" TABLESAMPLE ({amount} {unit}){seed}"

    def raw_item(self) -> str:
        return self.raw()

    def paren_number(self) -> str:
        self.need("(")
        n = self.raw()
        self.need(")")
        return n

    # FROM.

    def from_items(self) -> str:
        return ", ".join(self.items(lambda: self.joined()[0]))

    def joined(self) -> tuple[str, list[str]]:
        """(text, aliases) of a table and what is joined to it."""
        text, names = self.factor()
        while True:
            natural = self.take("NATURAL")
            kind = self.join_kind()
            if kind is None:
                return text, names
            if kind in ("ASOF", "ASOF LEFT", "POSITIONAL"):
                text, names = self.special_join(kind, text, names)
                continue
            other, more = self.factor()
            view = None if natural else self.pairs(kind, (text, names), (other, more))
            if view:
                self.hidden[-1] += names + more
                return view, names + ([] if kind in ("LEFT SEMI", "LEFT ANTI") else more)
            text = f"{text} {'NATURAL ' if natural else ''}{kind} JOIN {other}"
            if self.take("ON"):
                text += f" ON {self.expr()}"
            elif self.take("USING"):
                self.need("(")
                text += f" USING ({', '.join(self.comma_list(self.name))})"
            if kind not in ("LEFT SEMI", "LEFT ANTI"):
                names = names + more

    def pairs(self, kind: str, left: tuple[str, list[str]], right: tuple[str, list[str]]) -> str | None:
        """The view of a join of two tables whose rows, in plain columns, are all the statement gives; else nothing is read."""
        words = [t[1].upper() for t in self.toks]
        chosen = words[: words.index("FROM")] if "FROM" in words else []
        if chosen[:1] != ["SELECT"] or {"(", "*", "DISTINCT"} & {*chosen} or len(self.hidden) != 1 or len(left[1]) != 1 or len(right[1]) != 1 or "LATERAL" in words:
            return None
        at, tests = self.at, []
        try:
            self.need("ON")
            while True:
                a = self.binary(3).sql
                op = "IS NOT DISTINCT FROM" if self.take("IS", "NOT", "DISTINCT", "FROM") else self.raw()
                tests.append((a, op, self.binary(3).sql))
                if not self.take("AND"):
                    break
            self.take(";")
            view = self.views.pairs(left, right, tests, kind.lower().replace(" ", "_"), self.with_text()) if self.at == len(self.toks) else None
        except DialectError:
            view = None
        if view is None:
            self.at = at
        return view

    def join_kind(self) -> str | None:
        for words, kind in (
            (("JOIN",), "INNER"), (("INNER", "JOIN"), "INNER"), (("LEFT", "OUTER", "JOIN"), "LEFT"), (("LEFT", "SEMI", "JOIN"), "LEFT SEMI"), (("LEFT", "ANTI", "JOIN"), "LEFT ANTI"), (("LEFT", "JOIN"), "LEFT"), (("RIGHT", "OUTER", "JOIN"), "RIGHT"), (("RIGHT", "JOIN"), "RIGHT"),
            (("FULL", "OUTER", "JOIN"), "FULL"), (("FULL", "JOIN"), "FULL"), (("CROSS", "JOIN"), "CROSS"), (("SEMI", "JOIN"), "LEFT SEMI"), (("ANTI", "JOIN"), "LEFT ANTI"),
            (("ASOF", "LEFT", "OUTER", "JOIN"), "ASOF LEFT"), (("ASOF", "LEFT", "JOIN"), "ASOF LEFT"), (("ASOF", "INNER", "JOIN"), "ASOF"), (("ASOF", "JOIN"), "ASOF"), (("POSITIONAL", "JOIN"), "POSITIONAL"),
        ):
            if self.take(*words):
                return kind
        return None

    def special_join(self, kind: str, left: str, names: list[str]) -> tuple[str, list[str]]:
        other, more = self.factor()
        if kind == "POSITIONAL":
            view = self.views.positional((left, names), (other, more), self.with_text())
        else:
            tests, using = [], []
            if self.take("ON"):
                wrapped = self.take("(")
                while True:
                    a = self.binary(3).sql
                    op = self.raw()
                    tests.append((a, op, self.binary(3).sql))
                    if not self.take("AND"):
                        break
                if wrapped:
                    self.need(")")
            elif self.take("USING"):
                self.need("(")
                using = self.comma_list(self.name)
            view = self.views.asof((left, names), (other, more), tests, "left" if kind == "ASOF LEFT" else "inner", using, self.with_text())
        self.hidden[-1] += names + more  # the view holds a struct for each table beside its columns
        return view, names + more

    def factor(self) -> tuple[str, list[str]]:
        lateral = "LATERAL " if self.take("LATERAL") else ""
        if self.kind() == "str":
            path = self.raw()[1:-1].replace("''", "'")
            kind = "read_csv" if path.rsplit(".", 1)[-1] in ("csv", "tsv") else "read_json" if path.endswith((".json", ".ndjson", ".jsonl")) else "read_parquet"
            text, base = self.views.files(kind, [path], {}), path.rsplit("/", 1)[-1].split(".")[0]
        elif self.peek() == "(" and self.starts_query():
            self.at += 1
            text, base = f"{lateral}({self.query()})", None
            self.need(")")
        elif self.peek() == "(":
            self.at += 1
            text, names = self.joined()
            self.need(")")
            return f"({text})", names
        elif self.take("VALUES"):
            text, base = f"VALUES {', '.join(self.items(self.value_row))}", None
        else:
            name = self.dotted()
            base = name.rsplit(".", 1)[-1]
            if self.peek() == "(":
                self.at += 1
                text, base = self.table_function(name.lower()), name
                lateral = ""
            else:
                text = name
        if self.take("TABLESAMPLE"):
            wrapped = self.take("(") if self.kind(1) == "num" else False
            text += self.sample()
            if wrapped:
                self.need(")")
        if self.peek() in ("UNPIVOT", "PIVOT") and self.peek(1) == "(":
            text += self.pivot()
        names = [base] if base else []
        if self.take("AS") or self.kind() == "quoted" or (self.kind() == "word" and self.peek() not in RESERVED):
            alias = self.name()
            names = [alias]
            text += f" AS {alias}"
            if self.take("("):
                text += f"({', '.join(self.comma_list(self.name))})"
        if self.take("TABLESAMPLE"):
            self.need("(") if self.peek() == "(" else None
            text += self.sample()
            self.take(")")
        if self.peek() in ("UNPIVOT", "PIVOT") and self.peek(1) == "(":
            text += self.pivot()
            if self.take("AS"):
                text += f" AS {self.name()}"
        return text, names

    def pivot(self) -> str:
        """Standard PIVOT and UNPIVOT are Spark's; aggregates and keys within are translated."""
        word = self.raw().upper()
        self.need("(")
        if word == "UNPIVOT":
            value = self.name()
            self.need("FOR")
            name = self.name()
            self.need("IN", "(")
            return f" UNPIVOT ({value} FOR {name} IN ({', '.join(self.comma_list(self.name))}){self.closing()})"
        made = self.items(lambda: " AS ".join(x for x in self.select_item() if x))
        self.need("FOR")
        name = self.name()
        self.need("IN", "(")
        values = self.comma_list(lambda: " AS ".join([self.expr().sql, *([self.name()] if self.take("AS") else [])]))
        return f" PIVOT ({', '.join(made)} FOR {name} IN ({', '.join(values)}){self.closing()})"

    def closing(self) -> str:
        self.need(")")
        return ""

    def table_function(self, name: str) -> str:
        if name in ("read_parquet", "parquet_scan", "read_csv", "read_csv_auto", "read_json", "read_json_auto", "read_ndjson"):
            paths, options = [], {}

            def arg() -> None:
                if self.kind() == "word" and self.peek(1) in ("=", ":="):
                    key = self.raw().lower()
                    self.raw()
                    options[key] = self.literal_value()
                else:
                    value = self.literal_value()
                    paths.extend(value if isinstance(value, list) else [value])

            self.comma_list(arg)
            return self.views.files(name, [str(p) for p in paths], options)
        args = [e.sql for e in self.comma_list(self.expr)]
        if name in ("range", "generate_series"):
            if name == "generate_series":
                args = [*(["0"] if len(args) == 1 else args[:1]), f"{args[0] if len(args) == 1 else args[1]} + 1", *args[2:]]
            return f"(SELECT id AS {name} FROM range({', '.join(args)}))"
        if name == "unnest":
            return f"LATERAL explode({args[0]})"
        return f"{name}({', '.join(args)})"

    def literal_value(self) -> object:
        if self.take("["):
            return self.comma_list(self.literal_value, "]")
        if self.take("{"):
            out = {}

            def pair() -> None:
                key = self.literal_value()
                self.need(":")
                out[key] = self.literal_value()

            self.comma_list(pair, "}")
            return out
        kind, text = self.kind(), self.raw()
        if kind == "str":
            return text[1:-1].replace("''", "'")
        if kind == "num":
            return float(text) if "." in text else int(text)
        return {"TRUE": True, "FALSE": False, "NULL": None}.get(text.upper(), text)

    # Expressions, loosest first.

    def expr(self) -> Expr:
        left = self.conjunction()
        while self.take("OR"):
            left = Expr(f"{left} OR {self.conjunction()}")
        return left

    def conjunction(self) -> Expr:
        left = self.negation()
        while self.take("AND"):
            left = Expr(f"{left} AND {self.negation()}")
        return left

    def negation(self) -> Expr:
        if self.peek() == "NOT":
            self.at += 1
            return Expr(f"NOT {self.negation()}")
        return self.comparison()

    def comparison(self) -> Expr:
        left = self.binary(3)
        while True:
            t = self.peek()
            if t in ("=", "==", "<>", "!=", "<", "<=", ">", ">="):
                op = {"==": "=", "!=": "<>"}.get(self.raw(), t)
                if self.peek() in ("ANY", "ALL", "SOME") and self.peek(1) == "(":
                    every = self.raw().upper() == "ALL"
                    left = Expr(self.quantified(left.sql, op, every, self.in_list()))
                    continue
                left = Expr(f"{left} {op} {self.binary(3)}")
            elif t == "IS":
                self.at += 1
                negated = "NOT " if self.take("NOT") else ""
                if self.take("DISTINCT", "FROM"):
                    left = Expr(f"{left} IS {negated}DISTINCT FROM {self.binary(3)}")
                else:
                    left = Expr(f"{left} IS {negated}{self.raw().upper()}")
            elif t == "ISNULL":
                self.at += 1
                left = Expr(f"{left} IS NULL")
            elif t == "NOTNULL":
                self.at += 1
                left = Expr(f"{left} IS NOT NULL")
            elif t in ("~~", "!~~", "~~*", "!~~*"):
                self.at += 1
                left = self.like(left, "NOT " if t[0] == "!" else "", "ILIKE" if t[-1] == "*" else "LIKE")
            elif t in ("~", "!~"):
                self.at += 1
                left = Expr(f"{'NOT ' if t == '!~' else ''}regexp_like({left}, concat('^(?:', {self.binary(3)}, ')$'))")
            elif t in ("IN", "LIKE", "ILIKE", "BETWEEN", "SIMILAR") or (t == "NOT" and self.peek(1) in ("IN", "LIKE", "ILIKE", "BETWEEN", "SIMILAR")):
                negated = "NOT " if self.take("NOT") else ""
                word = self.raw().upper()
                if word == "BETWEEN":
                    low = self.binary(3)
                    self.need("AND")
                    left = Expr(f"{left} {negated}BETWEEN {low} AND {self.binary(3)}")
                elif word == "IN":
                    if self.peek() == "(" and self.starts_query(1) and self.valued:
                        left = Expr(negated + self.mark(left.sql, self.in_list()))
                        continue
                    left = Expr(f"{left} {negated}IN {self.in_list()}") if self.peek() == "(" else Expr(f"{negated}array_contains({self.binary(3)}, {left})")
                elif word == "SIMILAR":
                    self.need("TO")
                    left = Expr(f"{negated}regexp_like({left}, concat('^(?:', {self.binary(3)}, ')$'))")
                else:
                    left = self.like(left, negated, word)
            else:
                return left

    @staticmethod
    def quantified(x: str, op: str, every: bool, query: str) -> str:
        """x op ANY or ALL (query): the greatest or least value decides, by three-valued logic."""
        if op == ("<>" if every else "="):
            return f"{x} {'NOT ' if every else ''}IN {query}"
        opposite = {"<": ">=", "<=": ">", ">": "<=", ">=": "<"}
        if op not in opposite:
            raise DialectError(f"{op} {'ALL' if every else 'ANY'}")
        if every:
            return f"NOT {Parser.quantified(x, opposite[op], False, query)}"
        of = lambda what: f"(SELECT {what} FROM {query} AS __q(v))"
        best = of("max(v)" if op[0] == "<" else "min(v)")
        return f"(CASE WHEN {of('count(*)')} = 0 THEN false WHEN {x} {op} {best} THEN true WHEN {x} IS NULL OR {of('count(*) - count(v)')} > 0 THEN NULL ELSE false END)"

    @staticmethod
    def mark(x: str, query: str) -> str:
        """x IN (query) as a value: Spark's own has no null outside a filter."""
        of = lambda what: f"(SELECT {what} FROM {query} AS __q(v))"
        return f"(CASE WHEN {of('count(*)')} = 0 THEN false WHEN {x} IN {query} THEN true WHEN {x} IS NULL OR {of('count(*) - count(v)')} > 0 THEN NULL ELSE false END)"

    def in_list(self) -> str:
        self.need("(")
        if self.starts_query():
            inner = self.query()
            self.need(")")
            return f"({inner})"
        return f"({', '.join(e.sql for e in self.comma_list(self.expr))})"

    def like(self, left: Expr, negated: str, word: str) -> Expr:
        """Without ESCAPE a backslash is an ordinary sign; Spark's escape is the backslash."""
        pattern = self.binary(3)
        if self.take("ESCAPE"):
            sign = self.raw()[1:-1]
            return Expr(f"{left} {negated}{word} {pattern} ESCAPE {spark_string(sign)}") if sign else Expr(f"{left} {negated}{word} {self.unescaped(pattern)}")
        return Expr(f"{left} {negated}{word} {self.unescaped(pattern)}")

    @staticmethod
    def unescaped(pattern: Expr) -> str:
        if pattern.kind == "string":
            return spark_string(str(pattern.value).replace("\\", "\\\\"))
        return f"replace({pattern}, '\\\\', '\\\\\\\\')"

    #: Binary operators by how close they bind, from ||.
    LEVELS = {3: ("||", "->", "->>", "&", "|"), 4: ("+", "-"), 5: ("*", "/", "//", "%"), 6: ("^", "**")}

    def binary(self, level: int) -> Expr:
        if level > 6:
            return self.unary()
        left = self.binary(level + 1)
        while self.peek() in self.LEVELS[level]:
            op = self.raw()
            left = self.operator(left, op, self.binary(level + 1))
        return left

    def operator(self, a: Expr, op: str, b: Expr) -> Expr:
        if op == "/":
            return Expr(divide_text(a.sql, b.sql, b.value if b.kind == "number" else None))
        if op == "//":
            return Expr(f"(CASE WHEN {b} = 0 THEN NULL ELSE {a} DIV nullif({b}, 0) END)" if self.in_try else f"({a} DIV {b})")
        if op == "%":
            return Expr(f"try_mod({a}, {b})" if self.in_try else f"({a} % {b})")
        if op in ("^", "**"):
            return Expr(f"power({a}, {b})")
        if op in ("->", "->>"):
            path = b.value if b.kind == "string" else b.sql
            step = path if str(path).startswith("$") else f"$[{path}]" if b.kind == "number" else f"$.{path}"
            return Expr(f"get_json_object({a}, {spark_string(str(step))})")
        if self.in_try and op in "+-*":
            return Expr(f"{ {'+': 'try_add', '-': 'try_subtract', '*': 'try_multiply'}[op]}({a}, {b})")
        if op == "-" and a.kind == "date" and b.kind == "date":
            return Expr(f"datediff({a}, {b})")
        return Expr(f"{a} {op} {b}" if op in ("||",) else f"({a} {op} {b})")

    def unary(self) -> Expr:
        if self.take("-"):
            e = self.unary()
            return Expr(f"-{e}", "number", -e.value) if e.kind == "number" and e.sql[0] != "-" else Expr(f"(-({e}))" if e.sql[0] == "-" else f"(-{e})")
        if self.take("+"):
            return self.unary()
        return self.postfix(self.primary())

    def postfix(self, e: Expr) -> Expr:
        while True:
            if self.take("::"):
                e = Expr(cast_text(e.sql, self.type_name(), bool(self.in_try), e.kind))
            elif self.take("["):
                if self.peek() == ":":
                    first = None
                else:
                    first = self.expr()
                if self.take(":"):
                    last = None if self.peek() == "]" else self.expr()
                    self.need("]")
                    low = first.sql if first else "1"
                    e = Expr(f"slice({e}, {low}, {f'greatest({last} - {low} + 1, 0)' if last else f'greatest(size({e}) - {low} + 1, 0)'})")
                else:
                    self.need("]")
                    e = Expr(f"try_element_at({e}, {first})")
            elif self.peek() == "." and self.kind(1) in ("word", "quoted") and e.kind != "number":
                self.at += 1
                method = self.peek(1) == "(" and self.kind() == "word"
                name = self.name()
                if method:  # x.f(y) is f(x, y)
                    self.need("(")
                    e = self.call(name, [e])
                else:
                    e = Expr(f"{e}.{name}", e.kind if e.kind == "column" else "")
            elif self.take("COLLATE"):
                self.name()
            else:
                return e

    def primary(self) -> Expr:
        kind, t = self.kind(), self.peek()
        if kind == "str":
            value = self.raw()[1:-1].replace("''", "'")
            return Expr(spark_string(value), "string", value)
        if kind == "num":
            text = self.raw().replace("_", "")
            value = float(text) if re.search("[.eE]", text) else int(text)
            if isinstance(value, int) and value > 2**63 - 1:
                text += "BD"
            return Expr(text + ("D" if re.search("[eE]", text) and not text.endswith("D") else ""), "number", value)
        if kind == "param":
            text = self.raw()
            return Expr("?" if text == "?" else f":p{text[1:]}" if text[1:].isdigit() else f":{text[1:]}")
        if t == ":" and self.kind(1) == "word":
            self.at += 1
            return Expr(f":{self.raw()}")
        if t == "(":
            return self.parenthesis()
        if t == "[":
            self.at += 1
            return Expr(f"array({', '.join(e.sql for e in self.comma_list(self.expr, ']'))})", "list")
        if t == "{":
            return self.struct()
        if kind == "quoted":
            return Expr(self.dotted_column(), "column")
        if kind != "word":
            raise DialectError(f"unexpected {self.toks[self.at][1] if self.at < len(self.toks) else 'end'}")
        if t == "CASE":
            return self.case()
        if t in ("CAST", "TRY_CAST") and self.peek(1) == "(":
            self.at += 2
            e = self.expr()
            self.need("AS")
            kind_ = self.type_name()
            self.need(")")
            return Expr(cast_text(e.sql, kind_, t == "TRY_CAST" or bool(self.in_try), e.kind), "date" if kind_ == "DATE" else "")
        if t == "TRY" and self.peek(1) == "(":
            self.at += 2
            self.in_try += 1
            e = self.expr()
            self.in_try -= 1
            self.need(")")
            return e
        if t == "EXTRACT" and self.peek(1) == "(":
            self.at += 2
            part = self.raw().strip("'").lower()
            self.need("FROM")
            e = self.expr()
            self.need(")")
            return Expr(self.part(part, e.sql))
        if t == "EXISTS" and self.peek(1) == "(":
            self.at += 1
            return Expr(f"EXISTS {self.in_list()}")
        if t == "INTERVAL":
            return self.interval()
        if t in ("DATE", "TIMESTAMP", "TIMESTAMPTZ", "TIME") and self.kind(1) == "str":
            self.at += 1
            value = self.raw()
            return Expr(f"{ {'TIMESTAMP': 'TIMESTAMP_NTZ', 'TIMESTAMPTZ': 'TIMESTAMP_LTZ'}.get(t, t)} {value}", "date" if t == "DATE" else "")
        if t == "MAP" and self.peek(1) == "{":
            self.at += 2
            made = []

            def pair() -> None:
                made.append(self.expr().sql)
                self.need(":")
                made.append(self.expr().sql)

            self.comma_list(pair, "}")
            return Expr(f"map({', '.join(made)})")
        if t == "LAMBDA":
            self.at += 1
            names = self.items(self.name)
            self.need(":")
            return Expr(f"{', '.join(names) if len(names) == 1 else '(' + ', '.join(names) + ')'} -> {self.expr()}", "lambda")
        if t in ("NULL", "TRUE", "FALSE", "CURRENT_DATE", "CURRENT_TIMESTAMP"):
            self.at += 1
            return Expr(t if t[0] != "C" else t.lower() + "()", "null" if t == "NULL" else "bool")
        if self.peek(1) == "->" and self.kind(2) != "str" and self.kind(2) != "num":
            name = self.name()
            self.need("->")
            return Expr(f"{name} -> {self.expr()}", "lambda")
        if t in RESERVED and t not in ("LEFT", "RIGHT", "REPLACE", "FILTER"):
            raise DialectError(f"unexpected {t}")
        if self.peek(1) == "(":
            name = self.raw()
            self.need("(")
            return self.call(name, [])
        if t.lower() in self.meant and self.peek(1) != ".":
            return self.meant[self.raw().lower()]
        return Expr(self.dotted_column(), "column")

    def dotted_column(self) -> str:
        parts = [self.name()]
        while self.peek() == "." and self.kind(1) in ("word", "quoted") and self.peek(2) != "(":
            self.at += 1
            parts.append(self.name())
        return ".".join(parts)

    def parenthesis(self) -> Expr:
        if self.starts_query():
            return Expr(self.in_list())
        self.need("(")
        at = self.at
        names = []
        while self.kind() == "word" and self.peek(1) in (",", ")"):  # (x, y) -> ...
            names.append(self.raw())
            if self.take(")"):
                if self.take("->"):
                    return Expr(f"{names[0] if len(names) == 1 else '(' + ', '.join(names) + ')'} -> {self.expr()}", "lambda")
                break
            self.need(",")
        self.at = at
        inside = self.comma_list(self.expr)
        if len(inside) == 1:
            return Expr(f"({inside[0]})", inside[0].kind if inside[0].kind in ("number", "date") else "", inside[0].value)
        return Expr(f"struct({', '.join(e.sql for e in inside)})", "row")

    def struct(self) -> Expr:
        self.need("{")
        made = []

        def pair() -> None:
            key = self.raw()
            self.need(":")
            made.append(f"{self.expr()} AS {quoted(key.strip(chr(39)).strip(chr(34)))}")

        self.comma_list(pair, "}")
        return Expr(f"struct({', '.join(made)})")

    def case(self) -> Expr:
        self.need("CASE")
        out = ["CASE"]
        if self.peek() != "WHEN":
            out.append(self.expr().sql)
        while self.take("WHEN"):
            test = self.expr()
            self.need("THEN")
            out.append(f"WHEN {test} THEN {self.expr()}")
        if self.take("ELSE"):
            out.append(f"ELSE {self.expr()}")
        self.need("END")
        return Expr(f"{' '.join(out)} END")

    def interval(self) -> Expr:
        self.need("INTERVAL")
        if self.kind() == "str":
            value = self.raw()[1:-1]
            if self.kind() == "word" and self.peek().rstrip("S") in PARTS:
                return Expr(f"INTERVAL '{value}' {self.raw().upper().rstrip('S')}")
            return Expr(f"INTERVAL '{value}'")
        e = self.primary() if self.peek() == "(" else Expr(self.raw())
        unit = self.raw().upper().rstrip("S")
        return Expr(f"INTERVAL {e} {unit}" if re.fullmatch(r"[\d.]+", e.sql) else f"({e} * INTERVAL 1 {unit})")

    def type_name(self) -> str:
        """A type in Spark's words."""
        word = self.raw().upper()
        if word in ("STRUCT", "ROW") and self.take("("):
            out = f"STRUCT<{', '.join(self.comma_list(lambda: f'{self.name()}: {self.type_name()}'))}>"
        elif word == "MAP" and self.take("("):
            out = f"MAP<{', '.join(self.comma_list(self.type_name))}>"
        else:
            args = f"({', '.join(self.comma_list(self.raw_item))})" if self.take("(") else ""
            if word == "DOUBLE":
                self.take("PRECISION")
            if word in ("TIMESTAMP", "TIME") and self.take("WITH", "TIME", "ZONE"):
                word = "TIMESTAMPTZ"
            self.take("WITHOUT", "TIME", "ZONE")
            # Type names of the dialect that Spark calls otherwise.
            renamed = {"VARCHAR": "STRING", "TEXT": "STRING", "CHAR": "STRING", "BPCHAR": "STRING", "INTEGER": "INT", "INT4": "INT", "SIGNED": "INT", "INT8": "BIGINT", "LONG": "BIGINT", "INT2": "SMALLINT", "SHORT": "SMALLINT", "INT1": "TINYINT", "UTINYINT": "SMALLINT", "USMALLINT": "INT", "UINTEGER": "BIGINT", "UBIGINT": "DECIMAL(20,0)", "HUGEINT": "DECIMAL(38,0)", "FLOAT8": "DOUBLE", "FLOAT4": "FLOAT", "REAL": "FLOAT", "BLOB": "BINARY", "BYTEA": "BINARY", "BOOL": "BOOLEAN", "LOGICAL": "BOOLEAN", "TIMESTAMP": "TIMESTAMP_NTZ", "DATETIME": "TIMESTAMP_NTZ", "TIMESTAMPTZ": "TIMESTAMP", "TIMESTAMP_S": "TIMESTAMP_NTZ", "TIMESTAMP_MS": "TIMESTAMP_NTZ"}
            out = renamed.get(word, word)
            if out in ("DECIMAL", "NUMERIC"):
                out = "DECIMAL" + (args or "(18,3)")
        while self.take("["):
            if self.kind() == "num":
                self.raw()
            self.need("]")
            out = f"ARRAY<{out}>"
        return out

    def part(self, part: str, e: str) -> str:
        made = PARTS.get(part.upper().rstrip("S")) or PARTS.get(part.upper())
        if made is None:
            raise DialectError(f"date part {part}")
        return made.format(e)

    # Calls.

    def call(self, name: str, given: list[Expr]) -> Expr:
        """A function call whose opening parenthesis is consumed; given: arguments that stand before it."""
        low = name.lower()
        distinct = self.take("DISTINCT")
        args, named, order = list(given), [], []
        if self.take("*"):
            args.append(Expr("*", "star"))
        elif low == "position" and not given:
            needle = self.binary(3)
            self.need("IN")
            args = [self.binary(3), needle]
        elif low == "struct_pack" or (self.kind() == "word" and self.peek(1) == ":="):
            while self.peek() != ")":
                key = self.name()
                self.need(":=")
                named.append((key, self.expr().sql))
                if not self.take(","):
                    break
        elif self.peek() != ")":
            args += self.items(self.expr)
            if low in ("substring", "substr") and self.take("FROM"):
                args.append(self.expr())
                if self.take("FOR"):
                    args.append(self.expr())
        if self.take("ORDER", "BY"):
            order = self.order_by()
        nulls = ""
        if self.take("IGNORE", "NULLS"):
            nulls = " IGNORE NULLS"
        elif self.take("RESPECT", "NULLS"):
            nulls = " RESPECT NULLS"
        self.need(")")
        if self.take("IGNORE", "NULLS"):
            nulls = " IGNORE NULLS"
        after = nulls
        if self.peek() == "FILTER" and self.peek(1) == "(":
            self.at += 2
            self.take("WHERE")
            after += f" FILTER (WHERE {self.expr()})"
            self.need(")")
        if self.take("OVER"):
            after += f" OVER {self.window()}"
        if low == "struct_pack" or named:
            return Expr(f"struct({', '.join(f'{v} AS {k}' for k, v in named)})")
        if low == "unnest":
            return Expr(self.unnested(args[0].sql, 1))
        if low == "generate_subscripts":
            return Expr(f"(CAST({self.unnested(args[0].sql, 0)} AS BIGINT) + 1)")
        if low in ("date_part", "datepart"):
            return Expr(self.part(str(args[0].value), args[1].sql))
        if low == "error" and self.in_try:
            return Expr("NULL", "null")
        if order and low in ("list", "array_agg", "first", "last", "any_value", "string_agg", "group_concat", "listagg"):
            return Expr(sorted_list(low, [a.sql for a in args], order, after, distinct))
        if low in self.macros and not named:
            return self.expanded(low, args)
        made = AGGREGATES.get(low)
        if made is not None:
            return Expr(made([a.sql for a in args], "DISTINCT " if distinct else "", after, args))
        made = FUNCTIONS.get(low)
        if made is not None and not distinct:
            out = made(args) if callable(made) else f"{made}({', '.join(a.sql for a in args)})"
            return Expr(out + after, "list" if low.startswith(("list_", "array_", "range")) else "")
        return Expr(f"{name}({'DISTINCT ' if distinct else ''}{', '.join(a.sql for a in args)}){after}")

    def expanded(self, name: str, args: list[Expr]) -> Expr:
        params, body = self.macros[name]
        if len(args) != len(params):
            raise DialectError(f"{name} takes {len(params)} arguments")
        inner = Parser(body, self.views, {k: v for k, v in self.macros.items() if k != name})
        inner.meant = {p.lower(): Expr(f"({a})", a.kind if a.kind in ("string", "number", "date") else "", a.value) for p, a in zip(params, args, strict=True)}
        out = inner.expr()
        if inner.at < len(inner.toks):
            raise DialectError(f"macro {name}: unexpected {inner.raw()}")
        return Expr(f"({out})", out.kind if out.kind == "date" else "")

    def named_window(self) -> str:
        name = self.name()
        self.need("AS")
        return f"{name} AS {self.window()}"

    def window(self) -> str:
        if not self.take("("):
            return self.name()
        out = []
        if self.kind() == "word" and self.peek() not in ("PARTITION", "ORDER", "ROWS", "RANGE", "GROUPS") and self.peek() != ")":
            out.append(self.name())
        if self.take("PARTITION", "BY"):
            out.append(f"PARTITION BY {', '.join(e.sql for e in self.items(self.expr))}")
        if self.take("ORDER", "BY"):
            out.append(f"ORDER BY {', '.join(f'{e} {d}' for e, d in self.order_by())}")
        if self.peek() == "GROUPS":
            raise DialectError("GROUPS frames: use operators.relational.groups_frame")
        if self.peek() in ("ROWS", "RANGE"):
            unit = self.raw().upper()
            if self.take("BETWEEN"):
                low = self.bound()
                self.need("AND")
                out.append(f"{unit} BETWEEN {low} AND {self.bound()}")
            else:
                out.append(f"{unit} {self.bound()}")
            if self.peek() == "EXCLUDE":
                self.at += 1
                if not self.take("NO", "OTHERS"):
                    raise DialectError("EXCLUDE: use operators.relational.exclude_frame")
        self.need(")")
        return f"({' '.join(out)})"

    def bound(self) -> str:
        if self.take("CURRENT", "ROW"):
            return "CURRENT ROW"
        e = "UNBOUNDED" if self.take("UNBOUNDED") else self.binary(3).sql
        return f"{e} {self.raw().upper()}"


def translate(text: str, views: Views | None = None, macros: dict[str, tuple[list[str], str]] | None = None) -> str:
    """Spark SQL of one query of the dialect."""
    p = Parser(text, views, macros)
    out = p.query()
    p.take(";")
    if p.at < len(p.toks):
        raise DialectError(f"unexpected {p.toks[p.at][1]} after the query")
    return out
