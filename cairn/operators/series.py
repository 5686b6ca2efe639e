"""Ordered series: a DataFrame with an ordinal column, and the same operators over arrays.

A ``Series`` is a finite ordered multiset held as a DataFrame whose position column ``_pos`` gives the
order (any sortable key; not necessarily dense). Operators that look at neighbours or prefixes
work without gathering the series in one task: rows are dealt to ranges of positions, each range
has a window of its own, and the summaries of ranges (one row each, 512 at most) are combined and
joined back. ``partition_by`` gives independent series per key instead.
"""

from __future__ import annotations

import itertools
from collections.abc import Callable

from pyspark.sql import Column, DataFrame, SparkSession, Window
from pyspark.sql import functions as F
from pyspark.sql import types as T

POS = "_pos"
PART = "_part"
Fn = Callable[[Column], Column]


def _unfolded(state, step: Callable, done: Callable):
    while not done(state):
        state, item = step(state)
        yield item


def _literal(value, kind: T.DataType) -> Column:
    if isinstance(kind, T.StructType):
        if value is None:
            return F.lit(None).cast(kind)
        return F.struct(*[_literal(value[f.name], f.dataType).alias(f.name) for f in kind])
    return F.lit(value).cast(kind)


class Series:
    """Rows of ``df`` in the order of ``pos``; ``item`` names the column that operators apply to."""

    def __init__(self, df: DataFrame, item: str, pos: str = POS):
        self.df, self.item, self.pos = df, item, pos

    # -- construction ------------------------------------------------------
    @staticmethod
    def of(df: DataFrame, item: str, pos: str) -> Series:
        """A table's column in the order of a unique key."""
        return Series(df.select(F.col(pos).alias(POS), F.col(item).alias("item")), "item")

    @staticmethod
    def of_list(spark: SparkSession, values: list, type_: str) -> Series:
        return Series(spark.createDataFrame(list(enumerate(values)), f"{POS} long, item {type_}"), "item")

    @staticmethod
    def empty(spark: SparkSession, type_: str) -> Series:
        return Series.of_list(spark, [], type_)

    @staticmethod
    def singleton(spark: SparkSession, value, type_: str) -> Series:
        return Series.of_list(spark, [value], type_)

    @staticmethod
    def of_option(spark: SparkSession, value, type_: str) -> Series:
        return Series.of_list(spark, [] if value is None else [value], type_)

    @staticmethod
    def of_hashtbl(spark: SparkSession, table: dict, key_type: str, value_type: str) -> Series:
        """A table's (key, value) pairs, in the order in which they were put in."""
        rows = [(k, tuple(kv)) for k, kv in enumerate(table.items())]
        return Series(spark.createDataFrame(rows, f"{POS} long, item struct<_1: {key_type}, _2: {value_type}>"), "item")

    @staticmethod
    def range(spark: SparkSession, low: int, high: int) -> Series:
        """low..high, both included; empty when low > high."""
        return Series(spark.range(low, high + 1).select(F.col("id").alias(POS), F.col("id").alias("item")), "item")

    @staticmethod
    def repeat(spark: SparkSession, n: int, value: Column) -> Series:
        return Series(spark.range(max(0, n)).select(F.col("id").alias(POS), value.alias("item")), "item")

    @staticmethod
    def iterate(spark: SparkSession, n: int, step: Fn, start: Column) -> Series:
        """start, step(start), ... n items; each item depends on the last, so one array fold makes them."""
        from cairn.functions.arrays import iterate

        one = spark.range(1).select(F.posexplode(iterate(n, step, start)).alias(POS, "item"))
        return Series(one.withColumn(POS, F.col(POS).cast("long")), "item")

    @staticmethod
    def of_generator(spark: SparkSession, seed, step: Callable, done: Callable, type_: str, most: int | None = None) -> Series:
        """Unfolds (next state, item) = step(state) until done(state), in one task as each item needs the last.

        At most ``most`` items are made; a table is finite, so an endless series needs it.
        """
        return Series.of_source(spark, lambda: itertools.islice(_unfolded(seed, step, done), most), type_)

    @staticmethod
    def of_source(spark: SparkSession, read: Callable, type_: str) -> Series:
        """The items of the iterable that read() gives, in its order; read() is called by a task."""

        def run(batches):
            import pandas as pd

            for _ in batches:
                for k, some in enumerate(itertools.batched(read(), 1024)):
                    yield pd.DataFrame({POS: range(1024 * k, 1024 * k + len(some)), "item": list(some)})

        return Series(spark.range(0, 1, 1, 1).mapInPandas(run, f"{POS} long, item {type_}"), "item")

    # -- plumbing ----------------------------------------------------------
    def _with(self, df: DataFrame) -> Series:
        return Series(df, self.item, self.pos)

    @property
    def x(self) -> Column:
        return F.col(self.item)

    def _ranged(self) -> DataFrame:
        """df with the number of each row's range of positions.

        Bounds come from a small hash sample of positions and are literals, so a row's number is the
        same wherever the plan computes it.
        """
        spark = self.df.sparkSession
        n = min(512, int(spark.conf.get("spark.sql.shuffle.partitions")))
        key = self.df.select(self.pos)
        some = [r[0] for r in key.orderBy(F.xxhash64(self.pos), self.pos).limit(20 * n).orderBy(self.pos).collect()]
        bounds = some[20::20]
        if not bounds:
            return self.df.withColumn(PART, F.lit(0))
        kind = self.df.schema[self.pos].dataType
        listed = F.array(*[_literal(b, kind) for b in bounds])
        return self.df.withColumn(PART, F.size(F.filter(listed, lambda b: b <= F.col(self.pos))))

    def _prefix(self, value: Column, name: str, start=0, inclusive: bool = True) -> DataFrame:
        """df with the running sum of value in the order of pos, in parallel.

        Sums of partitions (one row each) are brought to a running total that is broadcast back: the
        table has as many rows as there are partitions, however many items.
        """
        rows = self._ranged().withColumn("_v", value)
        own = Window.partitionBy(PART).orderBy(self.pos).rowsBetween(Window.unboundedPreceding, 0)
        sums = rows.groupBy(PART).agg(F.sum("_v").alias("_s"))
        before = Window.orderBy(PART).rowsBetween(Window.unboundedPreceding, -1)
        base = sums.select(PART, F.coalesce(F.sum("_s").over(before), F.lit(0)).alias("_base"))
        total = F.sum("_v").over(own) + F.col("_base") + F.lit(start)
        joined = rows.join(F.broadcast(base), PART)
        return joined.withColumn(name, total if inclusive else total - F.col("_v")).drop("_v", "_base", PART)

    def numbered(self, name: str = "_n") -> DataFrame:
        """df with a dense position from 1."""
        return self._prefix(F.lit(1), name)

    # -- projection, restriction, flattening ----------------------------------
    def map(self, f: Fn) -> Series:
        return self._with(self.df.withColumn(self.item, f(self.x)))

    def filter(self, p: Fn) -> Series:
        return self._with(self.df.where(p(self.x)))

    def remove(self, p: Fn) -> Series:
        return self._with(self.df.where(~F.coalesce(p(self.x), F.lit(False))))

    def filter_map(self, f: Fn) -> Series:
        """Keeps what f makes, where it is not null."""
        return self._with(self.df.withColumn(self.item, f(self.x)).where(F.col(self.item).isNotNull()))

    def _exploded(self, f: Fn, keep_parent: bool) -> Series:
        rest = [c for c in self.df.columns if c not in (self.item, self.pos)]
        parent = [self.x.alias("parent")] if keep_parent else []
        # the new position orders by parent, then by place within it
        flat = self.df.select(F.col(self.pos).alias("_outer"), *parent, *rest, F.posexplode(f(self.x)).alias("_inner", self.item))
        return Series(flat.withColumn(self.pos, F.struct("_outer", "_inner")).drop("_outer", "_inner"), self.item, self.pos)

    def flat_map(self, f: Fn) -> Series:
        return self._exploded(f, False)

    def unnest(self, f: Fn) -> Series:
        """(item, parent) for each item that f makes of a parent."""
        return self._exploded(f, True)

    def concat(self) -> Series:
        return self.flat_map(lambda x: x)

    def with_(self, **columns: Fn) -> Series:
        """Record extension: later fields replace earlier ones of the same name."""
        return self._with(self.df.withColumns({k: f(self.x) for k, f in columns.items()}))

    # -- prefixes and suffixes ------------------------------------------------
    def take(self, n: int) -> Series:
        return self._with(self.df.orderBy(self.pos).limit(max(0, n)))

    def drop(self, n: int) -> Series:
        return self._with(self.numbered().where(F.col("_n") > n).drop("_n"))

    def _first_failure(self, p: Fn) -> DataFrame:
        """One row: the position of the first item that fails p (null if none)."""
        failed = self.df.where(~F.coalesce(p(self.x), F.lit(False)))
        return failed.agg(F.min(self.pos).alias("_stop"))

    def take_while(self, p: Fn) -> Series:
        stop = F.broadcast(self._first_failure(p))  # one row
        return self._with(self.df.join(stop, F.col("_stop").isNull() | (F.col(self.pos) < F.col("_stop"))).drop("_stop"))

    def drop_while(self, p: Fn) -> Series:
        stop = F.broadcast(self._first_failure(p))  # one row
        return self._with(self.df.join(stop, F.col(self.pos) >= F.col("_stop")).drop("_stop"))

    def take_first(self) -> Series:
        return self.take(1)

    def take_last(self) -> Series:
        return self._with(self.df.orderBy(F.col(self.pos).desc()).limit(1))

    def take_no_more_than(self, n: int, dots: Column) -> Series:
        """The first n items, then dots if there were more."""
        first = Series(self.df.select(self.pos, self.item), self.item, self.pos).take(n + 1).numbered()
        return self._with(first.withColumn(self.item, F.when(F.col("_n") > n, dots).otherwise(self.x)).drop("_n"))

    # -- neighbours -----------------------------------------------------------
    def dedupe(self) -> Series:
        """Drops an item that equals the one before it."""
        rows = self._ranged()
        own = Window.partitionBy(PART).orderBy(self.pos)
        edge = rows.groupBy(PART).agg(F.max_by(F.struct(self.x.alias("v")), self.pos).alias("_last"))
        before = edge.select(PART, F.lag("_last").over(Window.orderBy(PART)).alias("_before"))  # a row a partition
        prev = F.coalesce(F.lag(F.struct(self.x.alias("v"))).over(own), F.col("_before"))
        out = rows.join(F.broadcast(before), PART).withColumn("_prev", prev)
        return self._with(out.where(F.col("_prev").isNull() | ~F.col("_prev")["v"].eqNullSafe(self.x)).drop("_prev", "_before", PART))

    def unique(self) -> Series:
        """The first of equal items; a hash aggregate, so a frequent item is combined before the shuffle."""
        rest = [c for c in self.df.columns if c != self.item]
        first = self.df.groupBy(self.item).agg(F.min_by(F.struct(*rest), self.pos).alias("_r"))
        return self._with(first.select(*[F.col("_r")[c].alias(c) if c != self.item else F.col(c) for c in self.df.columns]))

    def _around(self, make: Callable[[Column], Column]) -> Series:
        base = Series(self.df.select(self.pos, self.item), self.item, self.pos)
        return base.flat_map(make)

    def before_each(self, sep: Column) -> Series:
        return self._around(lambda x: F.array(sep, x))

    def after_each(self, sep: Column) -> Series:
        return self._around(lambda x: F.array(x, sep))

    def interpose(self, sep: Column) -> Series:
        """sep between neighbours: before each item but the first."""
        out = self.before_each(sep)
        least = F.broadcast(self.df.agg(F.min(self.pos).alias("_least")))  # one row
        return self._with(out.df.join(least, (F.col(out.pos)["_inner"] > 0) | (F.col(out.pos)["_outer"] > F.col("_least"))).drop("_least"))

    def cons(self, value: Column) -> Series:
        return self._joined([(0, self._one(value)), (1, self)])

    def sonc(self, value: Column) -> Series:
        return self._joined([(0, self), (1, self._one(value))])

    def decorate(self, first: Column, last: Column) -> Series:
        return self._joined([(0, self._one(first)), (1, self), (2, self._one(last))])

    def append(self, other: Series) -> Series:
        return self._joined([(0, self), (1, other)])

    def union(self, other: Series) -> Series:
        return self.append(other).unique()

    def _one(self, value: Column) -> Series:
        kind = self.df.schema[self.pos].dataType
        row = self.df.sparkSession.range(1).select(F.lit(None).cast(kind).alias(self.pos), value.cast(self.df.schema[self.item].dataType).alias(self.item))
        return self._with(row)

    def _joined(self, parts: list[tuple[int, Series]]) -> Series:
        out = None
        kinds = [s.df.schema[s.pos].dataType for _, s in parts]
        alike = all(k == kinds[0] for k in kinds)
        for n, (k, s) in enumerate(parts):
            # positions of different types have a place each; only a part's own is compared
            own = [F.col(s.pos).alias("_p")] if alike else [(F.col(s.pos) if n == m else F.lit(None).cast(kind)).alias(f"_p{m}") for m, kind in enumerate(kinds)]
            df = s.df.select(F.struct(F.lit(k).alias("_k"), *own).alias(self.pos), F.col(s.item).alias(self.item))
            out = df if out is None else out.unionByName(df)
        return self._with(out)

    def rolling(self, aggregate: Callable[[Column], Column], out: str = "rolled", partition_by: list[str] | None = None, plus: Callable[[Column, Column], Column] | None = None) -> Series:
        """A running aggregate, an output per input. By key it is a plain window.

        A whole series needs ``plus``, which joins the aggregates of consecutive parts: each range of positions has a
        window of its own, and what the ranges before come to (one row each) is joined on.
        """
        if partition_by:
            w = Window.partitionBy(*partition_by).orderBy(self.pos).rowsBetween(Window.unboundedPreceding, 0)
            return Series(self.df.withColumn(out, aggregate(self.x).over(w)), out, self.pos)
        if plus is None:
            raise ValueError("rolling over a whole series needs plus")
        rows = self._ranged()
        own = Window.partitionBy(PART).orderBy(self.pos).rowsBetween(Window.unboundedPreceding, 0)
        parts = rows.groupBy(PART).agg(F.struct(aggregate(self.x).alias("v")).alias("_s"))
        listed = F.collect_list("_s").over(Window.orderBy(PART).rowsBetween(Window.unboundedPreceding, -1))  # a row a range
        before = parts.select(PART, F.when(F.size(listed) > 0, F.aggregate(F.slice(listed, 2, 1 << 20), F.get(listed, F.lit(0)), lambda a, b: F.struct(plus(a["v"], b["v"]).alias("v")))).alias("_before"))
        got = aggregate(self.x).over(own)
        joined = rows.withColumn("_own", got).join(F.broadcast(before), PART)
        return Series(joined.withColumn(out, F.when(F.col("_before").isNull(), F.col("_own")).otherwise(plus(F.col("_before")["v"], F.col("_own")))).drop("_own", "_before", PART), out, self.pos)

    def rolling_sum(self, f: Fn = lambda x: x, out: str = "rolled") -> Series:
        return Series(self._prefix(f(self.x), out), out, self.pos)

    def windows_of(self, n: int, out: str = "window") -> Series:
        """All windows of n consecutive items; none for shorter series.

        Rows are dealt to blocks of positions; each block also gets the n - 1 rows before it.
        """
        size = max(4096, 8 * n)
        rows = self.numbered().select("_n", self.pos, self.item)
        block = F.floor((F.col("_n") - 1) / size)
        ahead = F.floor((F.col("_n") - 1 + (n - 1)) / size)
        dealt = rows.withColumn("_b", F.explode(F.array_distinct(F.array(block, ahead))))
        w = Window.partitionBy("_b").orderBy("_n")
        got = dealt.withColumn(out, F.collect_list(F.struct(self.x.alias("v"))).over(w.rowsBetween(-(n - 1), 0)))
        full = got.where((F.col("_b") == block) & (F.size(out) == n))
        return Series(full.select(self.pos, F.transform(out, lambda s: s["v"]).alias(out)), out, self.pos)

    def transduce(self, seed, step, finish, schema: str, key: str | None = None) -> DataFrame:
        """A general stateful flat map: step(state, row) -> (state, rows), then finish(state) -> rows.

        Each key's series is folded in order by one task, batch by batch; without a key the fold is
        sequential by nature, so the whole series passes through one task (but never rests in memory).
        """

        def run(batches):
            import pandas as pd

            state, last, names, some = seed, None, [c.strip().split()[0] for c in schema.split(",")], False
            for pdf in batches:
                out = []
                for row in pdf.itertuples(index=False):
                    k = getattr(row, key) if key else None
                    if some and k != last:
                        out += finish(state)
                        state = seed
                    last, some = k, True
                    state, made = step(state, row)
                    out += made
                yield pd.DataFrame(out, columns=names)
            if some or key is None:
                yield pd.DataFrame(finish(state), columns=names)

        ordered = self.df.repartition(key).sortWithinPartitions(key, self.pos) if key else self.df.orderBy(self.pos).coalesce(1)
        return ordered.mapInPandas(run, schema)

    # -- results --------------------------------------------------------------
    def reduce(self, reducer, *names: str) -> DataFrame:
        """One row with the reducer's result."""
        return self._aggregated([], self.x, reducer, names[0] if names else "result")

    def _aggregated(self, keys: list[Column], value: Column, reducer, out: str) -> DataFrame:
        """The reducer's result for each combination of keys (aliased)."""
        rows = self.df.select(*keys, value.alias("_v"), F.col(self.pos).alias(POS))
        names = rows.columns[: len(keys)]
        if reducer.nested is not None:
            key, of, inner = reducer.nested
            x = reducer.before(F.col("_v"))
            parts = Series(rows.select(*names, key(x).alias("_k"), of(x).alias("_v"), POS), "_v")
            held = parts._aggregated([F.col(c) for c in (*names, "_k")], F.col("_v"), inner, "_r")
            entries = F.array_sort(F.collect_list(F.struct(F.col("_k").alias("key"), F.col("_r").alias("value"))))
            return held.groupBy(*names).agg(reducer.finish(F.map_from_entries(entries)).alias(out))
        if reducer.chunked:
            return _in_chunks(rows, names, reducer, out)
        return rows.groupBy(*names).agg(reducer.over_rows(F.col("_v"), F.col(POS)).alias(out))

    def length(self) -> DataFrame:
        return self.df.agg(F.count("*").alias("length"))

    def forall(self, p: Fn) -> DataFrame:
        return self.df.agg(F.coalesce(F.bool_and(p(self.x)), F.lit(True)).alias("forall"))

    def exists(self, p: Fn) -> DataFrame:
        return self.df.agg(F.coalesce(F.bool_or(p(self.x)), F.lit(False)).alias("exists"))

    def is_empty(self) -> DataFrame:
        """Reads one row at most."""
        return self.df.limit(1).agg((F.count("*") == 0).alias("is_empty"))

    def at_least(self, n: int) -> DataFrame:
        """Whether there are n items; stops after n."""
        return self.df.limit(n).agg((F.count("*") >= n).alias("at_least"))

    def at_most(self, n: int) -> DataFrame:
        return self.df.limit(n + 1).agg((F.count("*") <= n).alias("at_most"))

    def count_at_most(self, n: int) -> DataFrame:
        return self.df.limit(n).agg(F.count("*").alias("count_at_most"))

    def group(self, key: Fn, value: Fn, reducer, names: tuple[str, str] = ("key", "value")):
        from cairn.operators.mapping import Mapping

        k, v = names
        return Mapping(self._aggregated([key(self.x).alias(k)], value(self.x), reducer, v), k, v)

    def partition(self, p: Fn):
        from cairn.functions.reducer import bag

        return self.group(p, lambda x: x, bag())

    def top(self, key: Fn, value: Fn, n: int) -> DataFrame:
        """The n largest items by value, one for each key; of equal values the earlier ranks first.

        A key's best row is found by a partial aggregate, the cut by a bounded take-ordered.
        """
        rest = F.struct(value(self.x).alias("_value"), F.col(self.pos).alias("_p"), self.x.alias("_item"))
        # the smallest position of each (key, value) is found before the shuffle by key, as few rows tie
        rows = self.df.select(key(self.x).alias("_key"), rest.alias("_row"))
        firsts = rows.groupBy("_key", F.col("_row")["_value"].alias("_value")).agg(F.min_by("_row", F.col("_row")["_p"]).alias("_row"))
        best = firsts.groupBy("_key").agg(F.max_by("_row", "_value").alias("_row"))
        return best.select("_row.*").orderBy(F.col("_value").desc(), F.col("_p")).limit(n).select(F.col("_item").alias(self.item), F.col("_value").alias("value"))

    def equal(self, other: Series) -> DataFrame:
        """Whether both series have equal items in the same order."""
        a = self.numbered().select(F.col("_n").alias("_a"), F.struct(self.x.alias("v")).alias("_x"))
        b = other.numbered().select(F.col("_n").alias("_b"), F.struct(other.x.alias("v")).alias("_y"))
        both = a.join(b, F.col("_a") == F.col("_b"), "full_outer")
        return both.agg(F.coalesce(F.bool_and(F.col("_x").eqNullSafe(F.col("_y"))), F.lit(True)).alias("equal"))

    def show(self, opening: str = "[", separator: str = "; ", closing: str = "]", most: int = 100) -> str:
        """The items as text, ``...`` after ``most``."""
        rows = self.take(most + 1).df.orderBy(self.pos).select(self.x.cast("string")).collect()
        shown = [str(r[0]) for r in rows[:most]] + (["..."] if len(rows) > most else [])
        return opening + separator.join(shown) + closing

    def cross_product(self, other: Series, left: str = "left", right: str = "right") -> DataFrame:
        return self.df.select(self.x.alias(left)).crossJoin(other.df.select(other.x.alias(right)))

    # -- sets and bags --------------------------------------------------------
    def bag_difference(self, other: Series) -> DataFrame:
        """Items of this series, each as often as it is here more than in other (column item)."""
        return self.df.select(self.x.alias("item")).exceptAll(other.df.select(other.x.alias("item")))

    def set_difference(self, other: Series) -> DataFrame:
        """The distinct items of this series that aren't in other (column item)."""
        return self.df.select(self.x.alias("item")).subtract(other.df.select(other.x.alias("item")))

    def weights(self, retracted: Series | None = None) -> DataFrame:
        """(item, weight): how often each item is here, less how often it was retracted; items of weight 0 vanish."""
        signed = self.df.select(self.x.alias("item"), F.lit(1).alias("_sign"))
        if retracted is not None:
            signed = signed.unionAll(retracted.df.select(retracted.x.alias("item"), F.lit(-1).alias("_sign")))
        return signed.groupBy("item").agg(F.sum("_sign").alias("weight")).where("weight <> 0")


def _in_chunks(rows: DataFrame, names: list[str], reducer, out: str) -> DataFrame:
    """Folds (keys, _v, _pos) in chunks of consecutive rows, then the chunks' results, level by level.

    Rows are sorted by key and position over ranges; a chunk is at most 4096 of them, so no task
    collects a whole group. A group's results are joined in the order of its chunks.
    """
    order = [*names, POS]
    placed = rows.repartitionByRange(*order).sortWithinPartitions(*order).withColumn("_at", F.monotonically_increasing_id())
    items = lambda x, by: F.transform(F.array_sort(F.collect_list(F.struct(F.col(by).alias("p"), x.alias("x")))), lambda s: s["x"])
    level = placed.groupBy(*names, F.shiftright("_at", 12).alias("_at")).agg(reducer.array(items(reducer.before(F.col("_v")), POS)).alias("_v"))
    for bits in (12, 9):
        level = level.groupBy(*names, F.shiftright("_at", bits).alias("_up")).agg(F.aggregate(items(F.col("_v"), "_at"), reducer.seed, reducer.plus).alias("_v")).withColumnRenamed("_up", "_at")
    done = level.groupBy(*names).agg(F.aggregate(items(F.col("_v"), "_at"), reducer.seed, reducer.plus).alias("_v"))
    return done.select(*names, reducer.finish(F.col("_v")).alias(out))
