"""What the host dialect's functions, casts and literals are in Spark SQL."""

from __future__ import annotations

import re

from ..functions.regexps import every_match, first_match


def quoted(name: str) -> str:
    return "`" + name.replace("`", "``") + "`"


def spark_string(value: str) -> str:
    """A literal: the dialect's has no escapes, Spark's has the backslash."""
    return "'" + value.replace("\\", "\\\\").replace("'", "\\'") + "'"


# Casts and division.

_WHOLE = ("TINYINT", "SMALLINT", "INT", "BIGINT", "DECIMAL(20,0)", "DECIMAL(38,0)")
#: Calls whose result is whole already: a cast of it needs no rounding.
_COUNTS = re.compile(r"(?:count|char_length|octet_length|size|year|month|day|hour|minute|second|row_number|rank|dense_rank|ntile|datediff|floor|ceil)\([^()]*\)(?: OVER \([^()]*\))?$")


def cast_text(e: str, kind: str, attempt: bool, of: str = "") -> str:
    """CAST; to a whole number it rounds: doubles half to even, decimals and text half away from zero."""
    word = "TRY_CAST" if attempt else "CAST"
    if kind not in _WHOLE or of in ("null", "bool") or _COUNTS.match(e) or re.fullmatch(r"-?\d+", e):
        return f"{word}({e} AS {kind})"
    # typeof() is known when the query is analysed, so one branch is left of the three.
    doubles = f"{word}(rint({word}({e} AS DOUBLE)) AS {kind})"
    decimals = f"{word}(round({word}({e} AS DECIMAL(38,10))) AS {kind})"
    return f"(CASE WHEN typeof({e}) IN ('double', 'float') THEN {doubles} WHEN typeof({e}) = 'string' OR typeof({e}) LIKE 'decimal%' THEN {decimals} ELSE {word}({e} AS {kind}) END)"


def divide_text(a: str, b: str, literal: float | None) -> str:
    """/ of doubles as IEEE has it: x / 0 is an infinity, 0 / 0 not a number."""
    x, y = f"CAST({a} AS DOUBLE)", f"CAST({b} AS DOUBLE)"
    if literal:
        return f"({x} / {y})"
    zero = f"CASE WHEN {x} = 0D OR isnan({x}) THEN double('NaN') WHEN {x} > 0D THEN double('Infinity') WHEN {x} < 0D THEN double('-Infinity') END"
    return f"(CASE WHEN {y} = 0D THEN {zero} ELSE {x} / {y} END)"


# Parts of dates: by name, for EXTRACT, date_part and functions of that name.

PARTS = {
    "YEAR": "year({0})", "QUARTER": "quarter({0})", "MONTH": "month({0})", "WEEK": "weekofyear({0})", "DAY": "day({0})", "HOUR": "hour({0})", "MINUTE": "minute({0})", "SECOND": "second({0})",
    "MILLISECOND": "CAST(floor(date_part('SECOND', {0}) * 1000) AS BIGINT)", "MICROSECOND": "CAST(floor(date_part('SECOND', {0}) * 1000000) AS BIGINT)",
    "DOW": "(dayofweek({0}) - 1)", "DAYOFWEEK": "(dayofweek({0}) - 1)", "ISODOW": "(weekday({0}) + 1)", "DOY": "dayofyear({0})", "DAYOFYEAR": "dayofyear({0})", "EPOCH": "(unix_micros(CAST({0} AS TIMESTAMP)) / 1000000D)",
}

# Functions: a name, or what makes the text of the arguments (Exprs).


def _template(text: str):
    return lambda args: text.format(*(a.sql for a in args))


def _substring(args) -> str:
    """Start 0 is the place before the first character, so one character less is taken."""
    s, start = args[0].sql, args[1]
    size = args[2].sql if len(args) > 2 else None
    if start.kind == "number" and start.value != 0:
        return f"substring({s}, {start}{f', {size}' if size else ''})"
    short = f"greatest({size} - 1, 0)" if size else "2147483647"
    if start.kind == "number":
        return f"substring({s}, 1, {short})"
    return f"(CASE WHEN {start} = 0 THEN substring({s}, 1, {short}) ELSE substring({s}, {start}{f', {size}' if size else ''}) END)"


def _regexp_replace(args) -> str:
    s, p, r = args[:3]
    options = str(args[3].value) if len(args) > 3 else ""
    flags = "".join(sorted(set(options) & set("ims")))
    if p.kind != "string" or r.kind != "string":
        raise ValueError("regexp_replace: pattern and replacement are literals")
    pattern = f"(?{flags}:{p.value})" if flags else str(p.value)
    if "g" in options:
        return f"regexp_replace({s}, {spark_string(pattern)}, {spark_string(every_match(str(r.value)))})"
    pattern, put = first_match(pattern, str(r.value))
    return f"regexp_replace({s}, {spark_string(pattern)}, {spark_string(put)})"


def _concat(args) -> str:
    if any(a.kind == "list" for a in args):
        return f"concat({', '.join(a.sql for a in args)})"
    return f"concat_ws('', {', '.join(a.sql if a.kind == 'string' else f'CAST({a} AS STRING)' for a in args)})"


def _date_trunc(args) -> str:
    return f"CAST(date_trunc({args[0]}, {args[1]}) AS TIMESTAMP_NTZ)"


def _date_diff(args) -> str:
    unit = str(args[0].value).upper().rstrip("S")
    cut = [f"date_trunc('{unit}', {a})" for a in args[1:3]]
    return f"timestampdiff({unit}, {cut[0]}, {cut[1]})"


#: Codes of strftime and what date_format calls them.
_FORMATS = {"%Y": "yyyy", "%m": "MM", "%d": "dd", "%H": "HH", "%M": "mm", "%S": "ss", "%y": "yy", "%j": "DDD", "%B": "MMMM", "%b": "MMM", "%A": "EEEE", "%a": "EEE", "%p": "a", "%I": "hh", "%f": "SSSSSS", "%%": "%"}


def _pattern(text: str) -> str:
    return re.sub(r"%.|[A-Za-z]+", lambda m: _FORMATS[m[0]] if m[0] in _FORMATS else f"'{m[0]}'", text)


def _strftime(args) -> str:
    return f"date_format({args[0]}, {spark_string(_pattern(str(args[1].value)))})"


def _strptime(args) -> str:
    return f"to_timestamp_ntz({args[0]}, {spark_string(_pattern(str(args[1].value)))})"


def _range(args) -> str:
    low, high = ("0", args[0].sql) if len(args) == 1 else (args[0].sql, args[1].sql)
    step = args[2].sql if len(args) > 2 else "1"
    return f"(CASE WHEN {high} > {low} THEN sequence(CAST({low} AS BIGINT), CAST({high} - 1 AS BIGINT), CAST({step} AS BIGINT)) ELSE CAST(array() AS ARRAY<BIGINT>) END)"


def _json(args) -> str:
    path = args[1]
    if path.kind == "number":
        return f"get_json_object({args[0]}, '$[{path}]')"
    if path.kind == "string":
        value = str(path.value)
        return f"get_json_object({args[0]}, {spark_string(value if value.startswith('$') else '$.' + value)})"
    return f"get_json_object({args[0]}, {path})"


FUNCTIONS = {
    # Strings.
    "strlen": "octet_length", "length": "char_length", "len": _template("CAST(size({0}) AS BIGINT)"), "substring": _substring, "substr": _substring, "prefix": "startswith", "starts_with": "startswith", "suffix": "endswith", "ends_with": "endswith",
    "regexp_replace": _regexp_replace, "regexp_matches": "regexp_like", "regexp_full_match": _template("regexp_like({0}, concat('^(?:', {1}, ')$'))"), "concat": _concat, "strpos": "instr", "position": "instr", "error": "raise_error",
    "regexp_extract": lambda a: f"regexp_extract({', '.join(x.sql for x in a[:3])}{'' if len(a) > 2 else ', 0'})", "string_split": _template("split({0}, concat('\\\\Q', {1}, '\\\\E'))"), "str_split": _template("split({0}, concat('\\\\Q', {1}, '\\\\E'))"), "split": _template("split({0}, concat('\\\\Q', {1}, '\\\\E'))"),
    "string_split_regex": "split", "regexp_split_to_array": "split", "trim": lambda a: f"trim({a[0]})" if len(a) == 1 else f"trim(BOTH {a[1]} FROM {a[0]})", "ltrim": lambda a: f"ltrim({a[0]})" if len(a) == 1 else f"trim(LEADING {a[1]} FROM {a[0]})", "rtrim": lambda a: f"rtrim({a[0]})" if len(a) == 1 else f"trim(TRAILING {a[1]} FROM {a[0]})",
    "sha256": _template("sha2({0}, 256)"), "unicode": "ascii", "ord": "ascii", "encode": _template("encode({0}, 'UTF-8')"), "decode": _template("decode({0}, 'UTF-8')"), "editdist3": "levenshtein",
    # Numbers.
    "log": "log10", "pow": "power", "mod": _template("({0} % {1})"), "fmod": _template("({0} % {1})"), "random": "rand", "ifnull": "coalesce", "xor": _template("({0} ^ {1})"), "trunc": _template("(CASE WHEN {0} < 0 THEN ceil({0}) ELSE floor({0}) END)"), "isinf": _template("(abs({0}) = double('Infinity'))"), "isfinite": _template("(abs({0}) < double('Infinity'))"),
    # Dates.
    "millisecond": _template(PARTS["MILLISECOND"]), "microsecond": _template(PARTS["MICROSECOND"]), "epoch": _template(PARTS["EPOCH"]), "dayofweek": _template(PARTS["DOW"]), "isodow": _template(PARTS["ISODOW"]), "week": "weekofyear", "dayname": _template("date_format({0}, 'EEEE')"), "monthname": _template("date_format({0}, 'MMMM')"),
    "date_trunc": _date_trunc, "datetrunc": _date_trunc, "date_diff": _date_diff, "datediff": _date_diff, "strftime": _strftime, "strptime": _strptime, "today": _template("current_date()"), "to_timestamp": "timestamp_seconds", "make_timestamp": "make_timestamp_ntz", "epoch_ms": "timestamp_millis",
    "to_years": _template("make_ym_interval({0}, 0)"), "to_months": _template("make_ym_interval(0, {0})"), "to_weeks": _template("make_dt_interval(7 * {0})"), "to_days": _template("make_dt_interval({0})"), "to_hours": _template("make_dt_interval(0, CAST({0} AS INT))"), "to_minutes": _template("make_dt_interval(0, 0, CAST({0} AS INT))"),
    "to_seconds": _template("make_dt_interval(0, 0, 0, {0})"), "to_milliseconds": _template("make_dt_interval(0, 0, 0, CAST({0} AS DECIMAL(18,0)) * 0.001BD)"), "to_microseconds": _template("make_dt_interval(0, 0, 0, CAST({0} AS DECIMAL(18,0)) * 0.000001BD)"),
    # Lists, structs, maps, JSON.
    "list_value": "array", "list_pack": "array", "row": "struct", "list_transform": "transform", "list_apply": "transform", "array_transform": "transform", "apply": "transform", "list_filter": "filter", "array_filter": "filter", "list_sum": _template("aggregate({0}, 0D, (s, x) -> s + x)"), "list_avg": _template("(aggregate({0}, 0D, (s, x) -> s + x) / size({0}))"),
    "list_min": "array_min", "list_max": "array_max", "list_contains": "array_contains", "list_has": "array_contains", "array_has": "array_contains", "list_position": "array_position", "list_indexof": "array_position", "list_concat": "concat", "list_cat": "concat", "array_concat": "concat", "list_distinct": "array_distinct", "list_unique": _template("size(array_distinct({0}))"),
    "list_sort": "sort_array", "list_reverse_sort": _template("sort_array({0}, false)"), "list_reverse": "reverse", "array_reverse": "reverse", "list_slice": _template("slice({0}, {1}, greatest({2} - {1} + 1, 0))"), "array_slice": _template("slice({0}, {1}, greatest({2} - {1} + 1, 0))"), "list_extract": "try_element_at", "list_element": "try_element_at", "array_extract": "try_element_at",
    "array_length": _template("CAST(size({0}) AS BIGINT)"), "list_zip": "arrays_zip", "list_intersect": "array_intersect", "list_has_any": "arrays_overlap", "array_to_string": "array_join", "range": _range, "generate_series": lambda a: f"sequence({', '.join(x.sql for x in a)})", "struct_extract": lambda a: f"{a[0]}.{quoted(str(a[1].value))}",
    "map": lambda a: f"map_from_arrays({a[0]}, {a[1]})" if a else "map()", "cardinality": "size", "map_extract": _template("filter(array(try_element_at({0}, {1})), x -> x IS NOT NULL)"), "json_extract_string": _json, "json_extract": _json, "json_array_length": "json_array_length",
}


# Aggregates: (arguments, DISTINCT or '', what follows the call, Exprs) to text.


def _named(name: str):
    return lambda args, distinct, after, exprs: f"{name}({distinct}{', '.join(args)}){after}"


def _avg(args, distinct, after, exprs) -> str:
    """Of decimals too a double, from an exact sum."""
    return f"try_divide(CAST(sum({distinct}{args[0]}){after} AS DOUBLE), CAST(count({distinct}{args[0]}){after} AS DOUBLE))"


def _list(args, distinct, after, exprs) -> str:
    """Nulls are members; Spark's list would leave them out."""
    return f"transform(collect_list({distinct}struct({args[0]} AS v)){after}, s -> s.v)"


def _count(args, distinct, after, exprs) -> str:
    return f"count({distinct}{', '.join(args) or '*'}){after}"


AGGREGATES = {
    "avg": _avg, "mean": _avg, "count": _count, "list": _list, "array_agg": _list, "any_value": lambda a, d, after, e: f"any_value({a[0]}, true){after}", "arg_max": _named("max_by"), "argmax": _named("max_by"), "arg_min": _named("min_by"), "argmin": _named("min_by"), "median": _named("median"),
    "string_agg": lambda a, d, after, e: f"listagg({d}{a[0]}, {a[1] if len(a) > 1 else chr(39) + ',' + chr(39)}){after}", "group_concat": lambda a, d, after, e: f"listagg({d}{a[0]}, {a[1] if len(a) > 1 else chr(39) + ',' + chr(39)}){after}",
    "quantile_cont": _named("percentile"), "approx_quantile": _named("approx_percentile"), "countif": _named("count_if"), "stddev": _named("stddev_samp"), "variance": _named("var_samp"),
}


def sorted_list(name: str, args: list[str], order: list[tuple[str, str]], after: str, distinct: bool) -> str:
    """An aggregate with an ORDER BY of its own: the members with their keys as a list, sorted by a comparison."""
    d = "DISTINCT " if distinct else ""
    if name in ("string_agg", "group_concat", "listagg"):
        sep = args[1] if len(args) > 1 else "','"
        filter_ = after
        return f"listagg({d}{args[0]}, {sep}) WITHIN GROUP (ORDER BY {', '.join(f'{e} {way}' for e, way in order)}){filter_}"
    keys = ", ".join(f"{e} AS k{i}" for i, (e, _) in enumerate(order))
    tests = []
    for i, (_, way) in enumerate(order):
        null, less = (1 if way.endswith("LAST") else -1), (1 if way.startswith("DESC") else -1)
        tests += [f"WHEN l.k{i} IS NULL AND r.k{i} IS NOT NULL THEN {null}", f"WHEN l.k{i} IS NOT NULL AND r.k{i} IS NULL THEN {-null}", f"WHEN l.k{i} < r.k{i} THEN {less}", f"WHEN l.k{i} > r.k{i} THEN {-less}"]
    made = f"transform(array_sort(collect_list({d}struct({keys}, {args[0]} AS v)){after}, (l, r) -> CASE {' '.join(tests)} ELSE 0 END), s -> s.v)"
    if name in ("list", "array_agg"):
        return made
    return f"try_element_at({f'filter({made}, x -> x IS NOT NULL)' if name == 'any_value' else made}, {-1 if name == 'last' else 1})"
