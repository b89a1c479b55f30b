"""The session surface: statements in the host dialect, run by Spark SQL after dialect.translate()."""

from __future__ import annotations

import re
import uuid

from pyspark.errors import AnalysisException
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from ..operators.relational import asof_join, limit_percent, pair_join, positional_join
from ..session import reset_option, set_option
from ..sources.pins import Pins
from ..sources.scratch import delete, shared_dir
from ..sources.tables import Tables, read_parquet, write_csv, write_json, write_parquet
from . import dialect


#: Pairs of equal keys for each row, beyond which a join whose pairs are the result is a pair_join.
FEW_PAIRS = 2


class SparkViews(dialect.Views):
    """Constructs that Spark's grammar lacks, as DataFrames behind temporary views of one statement."""

    def __init__(self, spark: SparkSession, prefix: str, args: dict | None = None, pins: Pins | None = None):
        self.spark, self.prefix, self.args, self.pins, self.n = spark, prefix, args, pins, 0

    def _view(self, df: DataFrame) -> str:
        self.n += 1
        name = f"{self.prefix}_{self.n}"
        df.createOrReplaceTempView(name)
        return name

    def _run(self, text: str) -> DataFrame:
        wanted = {k: v for k, v in (self.args or {}).items() if re.search(rf":{k}\b", text)}
        return self.spark.sql(text, args=wanted or None)

    def files(self, function: str, paths: list[str], options: dict[str, object]) -> str:
        if function in ("read_parquet", "parquet_scan"):
            hive = bool(options.pop("hive_partitioning", True))
            union = bool(options.pop("union_by_name", False))
            file_name = bool(options.pop("filename", False))
            if options:
                raise dialect.DialectError(f"read_parquet options {sorted(options)}")
            df = self.pins.of_files(paths) if self.pins and not file_name else None
            if df is None:
                df = read_parquet(self.spark, *paths, hive_partitioning=hive, merge_schema=union)
            return self._view(df.withColumn("filename", F.input_file_name()) if file_name else df)
        if "json" in function:
            return self._view(self.spark.read.json(paths))
        header, sep = options.pop("header", True), options.pop("delim", options.pop("sep", ","))
        columns = options.pop("columns", None)
        reader = self.spark.read.options(header=str(header).lower(), sep=sep)
        if columns:
            types = [f"`{k}` {dialect.Parser(str(v)).type_name()}" for k, v in columns.items()]
            return self._view(reader.schema(", ".join(types)).csv(paths))
        return self._view(reader.option("inferSchema", "true").csv(paths))

    def ordered_percent(self, query: str, keys: list[tuple[str, str]], percent: float) -> str:
        return self._view(limit_percent(self._run(query), percent, [F.expr(k).asc_nulls_first() if "ASC NULLS FIRST" in d else F.expr(k).desc_nulls_first() if "DESC NULLS FIRST" in d else F.expr(k).desc_nulls_last() if "DESC" in d else F.expr(k).asc_nulls_last() for k, d in keys]))

    def _side(self, text: str, names: list[str], ctes: str, more: dict[str, str] | None = None) -> DataFrame:
        """The side's columns, and each table of it as a struct, so that both x and t.x name a column."""
        structs = [f"struct({n}.*) AS {n}" for n in names]
        rest = [f"{e} AS {k}" for k, e in (more or {}).items()]
        return self._run(f"{ctes}SELECT {', '.join([*structs, *rest, '*'])} FROM {text}")

    def _belongs(self, e: str, text: str, ctes: str) -> bool:
        try:
            self._run(f"{ctes}SELECT {e} FROM {text} LIMIT 0")
        except AnalysisException:
            return False
        return True

    @staticmethod
    def _own(df: DataFrame, keep: set[str]) -> DataFrame:
        """Without columns whose name stands twice."""
        low = [c.lower() for c in df.columns]
        twice = {c for c in low if low.count(c) > 1} - keep
        return df.drop(*{c for c in df.columns if c.lower() in twice}) if twice else df

    def asof(self, left, right, conditions, how, using, ctes) -> str:
        keys, times, op = [], None, ">="
        tests = [*((f"{left[1][0]}.{c}", "=", f"{right[1][0]}.{c}") for c in using[:-1]), *((f"{left[1][0]}.{c}", ">=", f"{right[1][0]}.{c}") for c in using[-1:]), *conditions]
        turned = {">=": "<=", "<=": ">=", ">": "<", "<": ">", "=": "="}
        for a, sign, b in tests:
            if not self._belongs(a, left[0], ctes):
                a, b, sign = b, a, turned.get(sign, sign)
            if sign == "=":
                keys.append((a, b))
            elif times is None and sign in turned:
                times, op = (a, b), sign
            else:
                raise dialect.DialectError("ASOF JOIN: equalities and one of >=, >, <=, <")
        if times is None:
            raise dialect.DialectError("ASOF JOIN needs an inequality")
        names = [f"__k{i}" for i in range(len(keys))]
        le = self._own(self._side(*left, ctes, {**{k: a for k, (a, _) in zip(names, keys, strict=True)}, "__t": times[0]}), set())
        r = self._own(self._side(*right, ctes, {**{k: b for k, (_, b) in zip(names, keys, strict=True)}, "__t": times[1]}), set())
        taken = {c.lower() for c in le.columns}
        columns = [c for c in r.columns if c.lower() not in taken]
        return self._view(asof_join(le, r, names, "__t", "__t", columns, how, op).drop(*names, "__t"))

    def pairs(self, left, right, conditions, how, ctes) -> str | None:
        turned = {">=": "<=", "<=": ">=", ">": "<", "<": ">"}
        on, less = [], None
        for a, sign, b in conditions:
            if not self._belongs(a, left[0], ctes):
                a, b, sign = b, a, turned.get(sign, sign)
            if not self._belongs(a, left[0], ctes) or not self._belongs(b, right[0], ctes) or self._belongs(a, right[0], ctes) or self._belongs(b, left[0], ctes):
                return None
            if sign in ("=", "==", "IS NOT DISTINCT FROM"):
                on.append((a, b, sign[0] == "I"))
            elif less is None and sign in turned:
                less = (a, b, sign)
            else:
                return None
        one_sided = how in ("left_semi", "left_anti")
        if how not in ("inner", "left", "right", "full") and not (one_sided and less):
            return None
        names = [f"__on{i}" for i in range(len(on) + bool(less))]
        tests = [*on, less] if less else on
        le = self._side(*left, ctes, {k: t[0] for k, t in zip(names, tests, strict=True)})
        r = self._side(*right, ctes, {k: t[1] for k, t in zip(names, tests, strict=True)})
        if any("map<" in d.schema.simpleString() or "variant" in d.schema.simpleString() for d in (le, r)):
            return None  # has no hash
        le, r = (self._own(d.select(*(f"`{c}`" for c in d.columns if d.columns.count(c) == 1)), set()) for d in (le, r))
        both = {c.lower() for c in le.columns} & {c.lower() for c in r.columns} - {*names}
        le, r = le.drop(*(c for c in le.columns if c.lower() in both)), r.drop(*(c for c in r.columns if c.lower() in both))
        if left[1][0] not in le.columns or right[1][0] not in r.columns:
            return None  # a table has the name of a column
        le = le.withColumnsRenamed({k: f"{k}_l" for k in names})
        equal = [(f"{k}_l", k, o[2]) for k, o in zip(names, on, strict=False)]
        try:
            df = pair_join(le, r, equal, how, (f"{names[-1]}_l", names[-1], less[2]) if less else None, FEW_PAIRS)
        except TypeError:
            return None
        return None if df is None else self._view(df.drop(*names, *(f"{k}_l" for k in names)))

    def by_name(self, left: str, right: str, every: bool, ctes: str) -> str:
        both = self._run(ctes + left).unionByName(self._run(ctes + right), allowMissingColumns=True)
        return self._view(both if every else both.distinct())

    def positional(self, left, right, ctes) -> str:
        """Rows as they lie in the sides' partitions: a side that is sorted by its own ORDER BY keeps that order."""
        sides = [self._own(self._side(*s, ctes), set()) for s in (left, right)]
        taken = {c.lower() for c in sides[0].columns}
        again = [c for c in sides[1].columns if c.lower() in taken]
        return self._view(positional_join(sides[0], sides[1].drop(*again), [], []))


class Engine:
    """SQL by text, labels for the job log, pinned tables, prepared statements, options."""

    _count = 0
    _tables: dict[str, str] = {}  # folders of tables made by CREATE TABLE, of all engines

    def __init__(self, spark: SparkSession, folder: str | None = None):
        self.spark, self.pins = spark, Pins(spark)
        self._prepared: dict[str, str] = {}
        self._macros: dict[str, tuple[list[str], str]] = {}
        self._profiled: set[int] | None = None
        if folder:
            Tables(spark, folder).register()

    def translate(self, text: str, args: dict | None = None) -> str:
        Engine._count += 1
        return dialect.translate(text, SparkViews(self.spark, f"__tessera_{Engine._count}", args, self.pins), self._macros)

    def sql(self, text: str, label: str | None = None, **args: object) -> DataFrame:
        """The result of a statement; :name or $name in the text is a parameter, $1 the parameter p1. label names its jobs.

        Queries, EXPLAIN, CREATE [OR REPLACE] [TEMP] VIEW | TABLE name AS query, CREATE MACRO name(a, b) AS expression, INSERT INTO name query, COPY name | (query) TO
        'path' (options), DROP, PREPARE name AS query, EXECUTE name(values), SET and RESET of options.
        """
        if label:
            self.set_label(label)
        words = [t[1].upper() for t in dialect.tokens(text)[:2]]
        statement = getattr(self, f"_{words[0].lower()}", None) if words else None
        if words and words[0] in ("EXPLAIN", "CREATE", "INSERT", "COPY", "DROP", "PREPARE", "EXECUTE", "SET", "RESET"):
            return statement(text, args)
        return self._query(text, args)

    def _query(self, text: str, args: dict) -> DataFrame:
        out = self.translate(text, args)
        return self.spark.sql(out, args=args or None)

    def _done(self, text: str) -> DataFrame:
        return self.spark.createDataFrame([(text,)], "status string")

    def _explain(self, text: str, args: dict) -> DataFrame:
        rest = re.sub(r"^\s*EXPLAIN(\s+ANALYZE)?\s", "", text, flags=re.IGNORECASE)
        return self.spark.sql(f"EXPLAIN FORMATTED {self.translate(rest, args)}", args=args or None)

    def _create(self, text: str, args: dict) -> DataFrame:
        m = re.match(r"\s*CREATE\s+(?:OR\s+REPLACE\s+)?(?:TEMP(?:ORARY)?\s+)?(?:MACRO|FUNCTION)\s+(\w+)\s*\(([\w\s,]*)\)\s+AS\s+(?!TABLE\b)(.*?);?\s*$", text, re.IGNORECASE | re.DOTALL)
        if m:
            self._macros[m[1].lower()] = ([p.strip() for p in m[2].split(",") if p.strip()], m[3])
            return self._done(f"macro {m[1]}")
        m = re.match(r"\s*CREATE\s+(OR\s+REPLACE\s+)?(?:TEMP(?:ORARY)?\s+)?(VIEW|TABLE)\s+(IF\s+NOT\s+EXISTS\s+)?([\w.]+|\"[^\"]+\")\s+AS\s+(.*)$", text, re.IGNORECASE | re.DOTALL)
        if not m:
            raise dialect.DialectError("CREATE: a VIEW or a TABLE ... AS a query")
        replace, kind, unless, name, query = bool(m[1]), m[2].upper(), bool(m[3]), m[4].strip('"'), m[5]
        if unless and self.spark.catalog.tableExists(name):
            return self._done(f"{name} exists")
        df = self._query(query, args)
        if kind == "VIEW":
            (df.createOrReplaceTempView if replace else df.createTempView)(name)
        else:
            if self.spark.catalog.tableExists(name):
                if not replace:
                    raise dialect.DialectError(f"table {name} exists")
                self._forget(name)
            # A folder of its own: what an earlier session left in the warehouse under this name is no hindrance.
            path = self._tables[name] = f"{shared_dir(self.spark)}/tessera/table-{name}-{uuid.uuid4().hex[:12]}"
            df.write.format("parquet").option("path", path).saveAsTable(name)
        return self._done(f"{kind.lower()} {name}")

    def _forget(self, name: str) -> None:
        self.spark.sql(f"DROP TABLE IF EXISTS {name}")
        if name in self._tables:
            delete(self.spark, self._tables.pop(name))

    def _insert(self, text: str, args: dict) -> DataFrame:
        m = re.match(r"\s*INSERT\s+INTO\s+([\w.]+|\"[^\"]+\")\s*(\([^()]*\))?\s*(.*)$", text, re.IGNORECASE | re.DOTALL)
        if not m:
            raise dialect.DialectError("INSERT INTO a table, a query or VALUES")
        name = m[1].strip('"')
        rows = self._query(m[3], args)
        target = self.spark.table(name)
        given = [c.strip().strip('"') for c in m[2].strip("()").split(",")] if m[2] else target.columns
        if len(given) != len(rows.columns):
            raise dialect.DialectError(f"{len(rows.columns)} columns for {len(given)}")
        place = {c.lower(): rows.columns[i] for i, c in enumerate(given)}
        rows = rows.select(*(F.col(place[f.name.lower()]).cast(f.dataType).alias(f.name) if f.name.lower() in place else F.lit(None).cast(f.dataType).alias(f.name) for f in target.schema))
        rows.write.mode("append").format("parquet").saveAsTable(name)
        return self._done(f"into {name}")

    def _copy(self, text: str, args: dict) -> DataFrame:
        m = re.match(r"\s*COPY\s+(\(.*\)|[\w.]+)\s+TO\s+'([^']+)'\s*(?:\((.*)\))?\s*;?\s*$", text, re.IGNORECASE | re.DOTALL)
        if not m:
            raise dialect.DialectError("COPY a table or (query) TO 'path' (options)")
        df = self._query(m[1][1:-1] if m[1][0] == "(" else f"SELECT * FROM {m[1]}", args)
        options = (m[3] or "").upper()
        by = re.search(r"PARTITION_BY\s*\(?\s*([\w\s,]+?)\s*\)?\s*(?:,\s*\w+\s|$)", m[3] or "", re.IGNORECASE)
        keys = tuple(c.strip() for c in by[1].split(",")) if by else ()
        mode = "overwrite" if "OVERWRITE" in options else "append" if "APPEND" in options else "error"
        kind = re.search(r"FORMAT\s+'?(\w+)", options)
        kind = kind[1] if kind else m[2].rsplit(".", 1)[-1].upper()
        if kind == "CSV":
            write_csv(df, m[2], mode)
        elif kind == "JSON":
            write_json(df, m[2], mode)
        else:
            write_parquet(df, m[2], keys, mode)
        return self._done(m[2])

    def _drop(self, text: str, args: dict) -> DataFrame:
        m = re.match(r"\s*DROP\s+(TABLE|VIEW)\s+(?:IF\s+EXISTS\s+)?([\w.]+)", text, re.IGNORECASE)
        if not m:
            raise dialect.DialectError("DROP a TABLE or a VIEW")
        if m[1].upper() == "TABLE":
            self._forget(m[2])
        elif not self.spark.catalog.dropTempView(m[2]):
            self.spark.sql(f"DROP VIEW IF EXISTS {m[2]}")
        return self._done(m[2])

    def _prepare(self, text: str, args: dict) -> DataFrame:
        m = re.match(r"\s*PREPARE\s+(\w+)\s+AS\s+(.*)$", text, re.IGNORECASE | re.DOTALL)
        if not m:
            raise dialect.DialectError("PREPARE name AS a query")
        self._prepared[m[1].lower()] = m[2]
        return self._done(m[1])

    def _execute(self, text: str, args: dict) -> DataFrame:
        p = dialect.Parser(text)
        p.need("EXECUTE")
        name, given = p.name().lower(), {}

        def value() -> None:
            key = p.raw() if p.kind() == "word" and p.peek(1) in (":=", "=") else None
            if key:
                p.raw()
            sign = -1 if p.take("-") else 1
            v = p.literal_value()
            given[key or f"p{len(given) + 1}"] = -v if sign < 0 else v

        if p.take("("):
            p.comma_list(value)
        if name not in self._prepared:
            raise dialect.DialectError(f"no prepared statement {name}")
        query = self._prepared[name]
        if "?" in query:
            n = iter(range(1, 1000))
            query = "".join(t if k != "param" or t != "?" else f"$p{next(n)}" for k, t in _with_space(query))
        return self._query(query, given)

    def _set(self, text: str, args: dict) -> DataFrame:
        m = re.match(r"\s*SET\s+(?:SESSION\s+|GLOBAL\s+)?([\w.]+)\s*(?:=|TO)\s*(.+?)\s*;?\s*$", text, re.IGNORECASE | re.DOTALL)
        if not m:
            raise dialect.DialectError("SET name = value")
        set_option(self.spark, m[1], m[2].strip("'"))
        return self._done(m[1])

    def _reset(self, text: str, args: dict) -> DataFrame:
        name = text.split()[1].rstrip(";")
        reset_option(self.spark, name)
        return self._done(name)

    def profiler_start(self) -> None:
        """From now on the session's stages count for profiler_stop()."""
        self._profiled = {s.stageId() for s in self._stages()}

    def profiler_stop(self) -> DataFrame:
        """A row for each stage run since profiler_start(): its label, tasks, seconds of tasks, bytes and rows read and shuffled."""
        if self._profiled is None:
            raise RuntimeError("profiler_start() first")
        rows = [(s.stageId(), s.description().getOrElse(None) if s.description().isDefined() else None, s.numTasks(), s.executorRunTime() / 1000, s.inputBytes(), s.inputRecords(), s.shuffleWriteBytes(), s.shuffleReadBytes()) for s in self._stages() if s.stageId() not in self._profiled]
        self._profiled = None
        return self.spark.createDataFrame(rows, "stage int, label string, tasks int, seconds double, read_bytes long, read_rows long, shuffle_written long, shuffle_read long")

    def _stages(self) -> list:
        sc = self.spark.sparkContext
        sc._jsc.sc().listenerBus().waitUntilEmpty(10_000)
        made = sc._jsc.sc().statusStore().stageList(None, False, False, sc._gateway.new_array(sc._jvm.double, 0), None)
        return [made.apply(i) for i in range(made.size())]

    def set_label(self, label: str) -> None:
        self.spark.sparkContext.setJobDescription(label)

    def explain(self, text: str) -> str:
        return self.sql(text)._jdf.queryExecution().toString()


def _with_space(text: str) -> list[tuple[str, str]]:
    """The tokens of a text with what stands between them."""
    out, at = [], 0
    for kind, t, start, end in dialect.tokens(text):
        out += [("space", text[at:start]), (kind, t)]
        at = end
    return [*out, ("space", text[at:])]
