"""Relational operators that Spark has no verb for, as compositions of those it has."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F
from pyspark.sql.types import IntegralType, NumericType

from ..sources.scratch import written

SPLITS = 64
CELLS = 16
PIECE = 2048  # rows of one side that meet in a piece of a pair_join
TASK_PAIRS = 50_000_000  # pairs of rows that one task of a pair_join builds


def asof_join(left: DataFrame, right: DataFrame, by: list[str], left_time: str, right_time: str, columns: list[str], how: str = "left", op: str = ">=", splits: int = SPLITS) -> DataFrame:
    """Each left row with the nearest right row of its keys whose time meets left_time op right_time: columns of it, else null.

    op is >= or > (the latest right row), <= or < (the earliest). Null keys or times match nothing. Of right rows with one
    time any one counts. Both sides are sorted by key and time within ranges of time, cut at the quantiles of all times, so
    that one hot key, or no key at all, is the work of as many tasks as there are ranges; the last right row of each key and
    range is carried into the ranges after it. No pair of rows is ever built but the result's.
    """
    if op not in (">=", ">", "<=", "<"):
        raise ValueError(f"as-of joins compare by >=, >, <= or <, not {op}")
    tag, held, at, cell, row = "__right", "__held", "__at", "__cell", "__left"
    up = op[0] == ">"
    keys = [f"__by{i}" for i in range(len(by))]
    named = [F.col(c).alias(k) for c, k in zip(by, keys, strict=True)]
    strict = len(op) == 1
    r = right.where(F.col(right_time).isNotNull()).dropna(subset=by) if by else right.where(F.col(right_time).isNotNull())
    r = r.select(*named, F.col(right_time).alias(at), F.lit(int(strict)).alias(tag), F.struct(*columns).alias(held), F.lit(None).cast(left.select(F.struct("*")).schema[0].dataType).alias(row))
    le = left.select(*named, F.col(left_time).alias(at), F.lit(int(not strict)).alias(tag), F.lit(None).cast(r.schema[held].dataType).alias(held), F.struct("*").alias(row))
    both = le.unionByName(r)
    cuts = _cuts(both.select(at), at, splits)
    n_before = F.lit(0)
    for c in cuts:
        n_before = n_before + F.when(F.col(at) >= F.lit(c), 1).otherwise(0)
    both = both.withColumn(cell, n_before if up else -n_before)
    towards = F.col(at).asc_nulls_first() if up else F.col(at).desc_nulls_first()
    within = Window.partitionBy(*keys, cell).orderBy(towards, tag).rowsBetween(Window.unboundedPreceding, Window.currentRow)
    found = both.withColumn(held, F.last(held, ignorenulls=True).over(within)).where(F.col(row).isNotNull())
    ends = both.where(F.col(held).isNotNull()).groupBy(*keys, cell).agg((F.max_by if up else F.min_by)(held, at).alias("__end"))
    cells = both.select(*keys, cell).distinct().join(ends, [*keys, cell], "left") if by else both.select(cell).distinct().join(ends, cell, "left")
    # A row per key and range: what comes into the range from those before it.
    earlier = Window.partitionBy(*keys).orderBy(cell).rowsBetween(Window.unboundedPreceding, -1)
    carried = cells.withColumn("__in", F.last("__end", ignorenulls=True).over(earlier)).where(F.col("__in").isNotNull()).select(*keys, cell, "__in")
    found = found.join(carried, [*keys, cell], "left").withColumn(held, F.when(F.col(at).isNotNull(), F.coalesce(held, "__in")))
    if how == "inner":
        found = found.where(F.col(held).isNotNull())
    return found.select(f"{row}.*", *(F.col(f"{held}.{c}").alias(c) for c in columns))


def _cuts(times: DataFrame, at: str, splits: int) -> list:
    """Approximate quantiles of a column of times or numbers, at most splits - 1; none for other types."""
    kind = times.schema[0].dataType.typeName()
    if splits < 2 or kind not in ("date", "timestamp", "timestamp_ntz", "byte", "short", "integer", "long", "float", "double", "decimal"):
        return []
    found = times.agg(F.percentile_approx(at, [k / splits for k in range(1, splits)], 1000).alias("q")).first()["q"]
    return sorted(set(found or []))


def range_join(left: DataFrame, right: DataFrame, point: str, low: str, high: str, width: float, by: list[str] | None = None) -> DataFrame:
    """Left rows whose point lies in [low, high) of right rows: equi-joins on cells, then the test.

    Cells come in levels, each CELLS times as wide as the one before, from width on. A range goes to the level where it covers
    at most CELLS + 1 cells, so it is copied that often however long it is; a point is looked up once on each level in use.
    """
    cell, level = "__cell", "__level"
    keys = by or []
    r = right.where(F.col(low) < F.col(high))
    span = (F.col(high) - F.col(low)).cast("double")
    r = r.withColumn(level, F.greatest(F.lit(0), F.ceil(F.log(span / width) / F.log(F.lit(float(CELLS))) - 1e-9) - 1).cast("int"))
    wide = F.lit(float(width)) * F.pow(F.lit(float(CELLS)), F.col(level))
    r = r.withColumn(cell, F.explode(F.sequence(F.floor(F.col(low) / wide), F.floor(F.col(high) / wide))))
    levels = sorted(x[0] for x in right.where(F.col(low) < F.col(high)).select(F.greatest(F.lit(0), F.ceil(F.log(span / width) / F.log(F.lit(float(CELLS))) - 1e-9) - 1).cast("int").alias(level)).distinct().collect())  # one row per power of CELLS
    places = F.array(*(F.struct(F.lit(k).alias(level), F.floor(F.col(point) / (width * float(CELLS) ** k)).alias(cell)) for k in levels)) if levels else F.array().cast(f"array<struct<{level}:int,{cell}:bigint>>")
    le = left.select("*", F.inline(places))
    return le.join(r, [level, cell, *keys]).where((F.col(point) >= F.col(low)) & (F.col(point) < F.col(high))).drop(cell, level)


def pair_join(left: DataFrame, right: DataFrame, on: list[tuple[Column | str, Column | str, bool]], how: str = "inner", less: tuple[Column | str, Column | str, str] | None = None, few: float = 0, piece: int = PIECE) -> DataFrame | None:
    """A join of few keys, or none, with very many pairs: left's columns and right's, which must have different names.

    on are pairs of equal keys (left's, right's, whether null equals null), less an inequality (left's, right's, one of <, <=, >,
    >=) that must hold too. Each key's rows are dealt by their hash into pieces of some 2048 on either side, and each piece of
    left meets each of right's in a place of its own. So the pairs of one key, or of no key at all, are the work of many even
    tasks, whose number grows with the pairs, and a task holds one piece in memory. A row without a partner is told by its
    key's least and greatest values and isn't dealt. Equal rows have equal hashes: they stay in one piece. None if there are at
    most few times as many pairs of equal keys as rows with such keys: Spark's own join does as well then.
    """
    if how not in ("inner", "left", "right", "full", "left_semi", "left_anti"):
        raise ValueError(f"pair_join: {how}")
    op = less[2] if less else None
    if op not in (None, "<", "<=", ">", ">="):
        raise ValueError(f"pair_join compares by <, <=, > or >=, not {op}")
    col = lambda c: F.expr(c) if isinstance(c, str) else c
    test = {"<": lambda x, y: x < y, "<=": lambda x, y: x <= y, ">": lambda x, y: x > y, ">=": lambda x, y: x >= y}.get(op)
    names = [f"__k{n}" for n in range(len(on))]
    keyed = lambda df, at: df.select(*(col(o[at]) for o in on), *([col(less[at])] if less else []))
    for n, (a, b) in enumerate(zip(keyed(left, 0).schema, keyed(right, 1).schema, strict=True)):
        numbers = isinstance(a.dataType, NumericType) and isinstance(b.dataType, NumericType)
        whole = isinstance(a.dataType, IntegralType) and isinstance(b.dataType, IntegralType)
        if a.dataType != b.dataType and not (whole or (numbers and n == len(on))):
            raise TypeError(f"pair_join: {a.dataType.simpleString()} and {b.dataType.simpleString()}")

    def side(df: DataFrame, at: int) -> tuple[DataFrame, DataFrame]:
        """Rows with their keys and compared value apart, and the keys' numbers and best values of the rows that can match."""
        rows = df.select(F.struct("*").alias(f"__row{at}"), *(col(o[at]).alias(k) for o, k in zip(on, names, strict=True)), *([col(less[at]).alias("__v")] if less else []))
        must = [k for o, k in zip(on, names, strict=True) if not o[2]] + (["__v"] if less else [])
        able = rows
        for k in must:  # not dropna(), which takes NaN for null
            able = able.where(F.col(k).isNotNull())
        best = [] if not less else [(F.max if (op[0] == ">") == (at == 0) else F.min)("__v").alias(f"__best{at}")]
        return rows, able.groupBy(*names).agg(F.count(F.lit(1)).alias(f"__n{at}"), *best)

    (le, one), (r, other) = side(left, 0), side(right, 1)
    same = lambda a, b: [a[k].eqNullSafe(b[k]) for k in names]
    both = one.join(other, same(one, other)) if on else one.crossJoin(other)
    both = both.where("__n0 > 0 AND __n1 > 0").select(*([F.struct(*(one[k] for k in names)).alias("__k")] if on else []), "__n0", "__n1", *(["__best0", "__best1"] if less else []))
    both = both.withColumns({f"__p{n}": F.ceil(F.col(f"__n{n}") / piece).cast("int") for n in (0, 1)})

    def placed(rows: DataFrame, at: int) -> DataFrame:
        """Rows with what is known of their key on both sides, and whether they have a partner."""
        if on:
            known = rows.join(both, [rows[k].eqNullSafe(both["__k"][k]) for k in names], "left")
        else:
            known = rows.join(F.broadcast(both), F.lit(True), "left")  # one row or none
        hit = F.col("__n0").isNotNull()
        if less:
            hit = hit & (test(F.col("__v"), F.col("__best1")) if at == 0 else test(F.col("__best0"), F.col("__v")))
        return known.withColumn("__hit", F.coalesce(hit, F.lit(False)))

    if few or how not in ("left_semi", "left_anti"):
        size = both.agg(F.sum(F.col("__n0").cast("double") * F.col("__n1")).alias("pairs"), F.sum(F.col("__p0").cast("double") * F.col("__p1")).alias("pieces"), F.sum(F.col("__n0") + F.col("__n1")).alias("rows")).first()
        if few and (size["pairs"] or 0) <= few * (size["rows"] or 0):
            return None
    le = placed(le, 0)
    if how in ("left_semi", "left_anti"):
        return le.where(F.col("__hit") if how == "left_semi" else ~F.col("__hit")).select("__row0.*")
    r = placed(r, 1)
    tasks = int(min(size["pieces"] or 1, max((size["pairs"] or 0) / TASK_PAIRS, int(left.sparkSession.conf.get("spark.sql.shuffle.partitions")))))

    def dealt(rows: DataFrame, at: int) -> DataFrame:
        """Rows with the number of their piece and, once for each, those of the other side's."""
        mine, theirs = f"__i{at}", f"__i{1 - at}"
        own = rows.where("__hit").select(f"__row{at}", *place[:-2], *([F.col("__v").alias(f"__v{at}")] if less else []), F.pmod(F.xxhash64(f"__row{at}"), F.col(f"__p{at}")).cast("int").alias(mine), F.explode(F.sequence(F.lit(0), F.col(f"__p{1 - at}") - 1)).alias(theirs))
        return own.repartition(tasks, *place)

    # The columns of the join are those of the repartition, all of them, or Spark would shuffle again and choose how many tasks.
    place = [*(["__k"] if on else []), "__i0", "__i1"]
    out = dealt(le, 0).join(dealt(r, 1).hint("merge"), place)
    if less:
        out = out.where(test(F.col("__v0"), F.col("__v1")))
    out = out.select("__row0.*", "__row1.*")
    nothing = lambda df: [F.lit(None).cast(f.dataType).alias(f.name) for f in df.schema]
    if how in ("left", "full"):
        out = out.unionAll(le.where("NOT __hit").select("__row0.*", *nothing(right)))
    if how in ("right", "full"):
        out = out.unionAll(r.where("NOT __hit").select(*nothing(left), "__row1.*"))
    return out


def positional_join(left: DataFrame, right: DataFrame, left_order: list[Column | str], right_order: list[Column | str]) -> DataFrame:
    """Row i of left beside row i of right; the shorter side is filled with nulls. Rows have no order of their own: name one."""
    a, b = with_row_number(left, left_order, "__i"), with_row_number(right, right_order, "__j")
    return a.join(b, F.col("__i") == F.col("__j"), "full").drop("__i", "__j")


def with_row_number(df: DataFrame, order: list[Column | str], name: str) -> DataFrame:
    """Numbers rows from 1 in a global order, without bringing them to one task.

    A range-partitioned sort keeps its order in partition ids; rows are numbered within partitions, whose sizes (one row
    each) are summed up. The numbered rows are written to the shared folder first: a task that runs again could cut or order
    ties otherwise. Without an order rows are numbered as they lie in df's partitions.
    """
    spark = df.sparkSession
    tasks = int(spark.conf.get("spark.sql.shuffle.partitions"))
    ranged = df.repartitionByRange(tasks, *order).sortWithinPartitions(*order) if order else df
    ranged, _ = written(ranged.withColumn("__id", F.monotonically_increasing_id()).withColumn("__p", F.shiftright("__id", 33)), "ordered")
    sizes = ranged.groupBy("__p").agg(F.count(F.lit(1)).alias("__n"))
    before = Window.orderBy("__p").rowsBetween(Window.unboundedPreceding, -1)
    sizes = sizes.select("__p", F.coalesce(F.sum("__n").over(before), F.lit(0)).alias("__before"))
    numbered = ranged.join(sizes, "__p").withColumn(name, F.col("__before") + F.col("__id").bitwiseAND((1 << 33) - 1) + 1)
    return numbered.drop("__id", "__p", "__before")


def limit_percent(df: DataFrame, percent: float, order: list[Column | str]) -> DataFrame:
    """The first percent % of rows in an order, rounded down. Rows are numbered, not merged in one place."""
    numbered = with_row_number(df, order, "__rn")
    total = numbered.agg(F.count(F.lit(1))).first()[0]
    return numbered.where(F.col("__rn") <= int(total * percent / 100)).orderBy("__rn").drop("__rn")


def groups_frame(df: DataFrame, value: Column, name: str, by: list[str], order: list[Column | str], start: int, end: int) -> DataFrame:
    """value (an aggregate) OVER (PARTITION BY by ORDER BY order GROUPS BETWEEN start AND end), negative for PRECEDING.

    Peers share a dense rank, and a RANGE frame over ranks counts groups of peers.
    """
    ranked = df.withColumn("__group", F.dense_rank().over(Window.partitionBy(*by).orderBy(*order)))
    frame = Window.partitionBy(*by).orderBy("__group").rangeBetween(start, end)
    return ranked.withColumn(name, value.over(frame)).drop("__group")


def exclude_frame(df: DataFrame, column: str, name: str, window, what: str = "current", order: list[Column | str] | None = None) -> DataFrame:
    """sum(column) over a window that contains the current row, with EXCLUDE CURRENT ROW, GROUP or TIES.

    The excluded rows' sum is subtracted: the row itself, or its peers within whole partitions (window must then be an
    unbounded one over the same keys). Null where nothing is left.
    """
    if what not in ("current", "group", "ties"):
        raise ValueError(f"EXCLUDE {what}")
    peers = order if what != "current" else None
    total, n = F.sum(column).over(window), F.count(column).over(window)
    own, one = F.coalesce(F.col(column), F.lit(0)), F.col(column).isNotNull().cast("int")
    if peers is not None:
        own, one = F.coalesce(F.sum(column).over(Window.partitionBy(*peers)), F.lit(0)), F.count(column).over(Window.partitionBy(*peers))
    left, many = total - own, n - one
    if what == "ties":
        left, many = left + F.coalesce(F.col(column), F.lit(0)), many + F.col(column).isNotNull().cast("int")
    return df.withColumn(name, F.when(many > 0, left))


def distinct_on(df: DataFrame, keys: list[str], order: list[Column | str]) -> DataFrame:
    """The first row of each key in an order."""
    w = Window.partitionBy(*keys).orderBy(*order)
    return df.withColumn("__rn", F.row_number().over(w)).where("__rn = 1").drop("__rn")


def top_n_per_group(df: DataFrame, keys: list[str], order: list[Column | str], n: int) -> DataFrame:
    """The first n rows of each key. Spark keeps n rows a key and task before the shuffle (a window group limit)."""
    w = Window.partitionBy(*keys).orderBy(*order)
    return df.withColumn("__rn", F.row_number().over(w)).where(F.col("__rn") <= n).drop("__rn")


def mark_join(left: DataFrame, right: DataFrame, on: tuple[str, str], name: str = "mark") -> DataFrame:
    """left with a column: whether its key is IN the right keys, by three-valued logic."""
    key, other = on
    facts = right.agg(F.count(F.lit(1)).alias("__n"), F.max(F.col(other).isNull()).alias("__null"))
    keys = right.select(F.col(other).alias("__k")).where("__k IS NOT NULL").distinct().withColumn("__hit", F.lit(True))
    joined = left.join(keys, F.col(key) == F.col("__k"), "left").crossJoin(F.broadcast(facts))  # one row of facts
    mark = F.when(F.col("__n") == 0, False).when(F.col("__hit"), True).when(F.col(key).isNull() | F.coalesce("__null", F.lit(False)), None).otherwise(False)
    return joined.withColumn(name, mark.cast("boolean")).drop("__k", "__hit", "__n", "__null")


def mark_join_less(left: DataFrame, right: DataFrame, on: tuple[str, str], op: str = "<", name: str = "mark") -> DataFrame:
    """left with a column: whether key op ANY (right keys), for <, <=, >, >=, by three-valued logic.

    Any right key that is greater is as good as the greatest, so one row of facts decides: no pair of rows is compared.
    """
    key, other = on
    best = F.max(other) if op[0] == "<" else F.min(other)
    facts = right.agg(F.count(F.lit(1)).alias("__n"), F.max(F.col(other).isNull()).alias("__null"), best.alias("__best"))
    k = F.col(key)
    hit = {"<": k < F.col("__best"), "<=": k <= F.col("__best"), ">": k > F.col("__best"), ">=": k >= F.col("__best")}[op]
    joined = left.crossJoin(F.broadcast(facts))  # one row of facts
    mark = F.when(F.col("__n") == 0, False).when(hit, True).when(k.isNull() | F.coalesce("__null", F.lit(False)), None).otherwise(False)
    return joined.withColumn(name, mark.cast("boolean")).drop("__n", "__null", "__best")


def salted_join(big: DataFrame, small: DataFrame, on: list[str], salts: int, how: str = "inner") -> DataFrame:
    """An equi-join for a key with very many rows in big: dealt over salts tasks, each with a copy of small's rows."""
    if how not in ("inner", "left", "left_semi", "left_anti"):
        raise ValueError("copies of the right side would repeat its unmatched rows")
    spread = big.withColumn("__salt", F.pmod(F.xxhash64(*big.columns), F.lit(salts)))
    copies = small.withColumn("__salt", F.explode(F.sequence(F.lit(0), F.lit(salts - 1)).cast("array<bigint>")))
    return spread.join(copies, [*on, "__salt"], how).drop("__salt")
