"""Joins, deduplication, ordered prefixes and reason counts as DataFrame operators."""

from __future__ import annotations

from functools import reduce

from pyspark.sql import Column, DataFrame
from pyspark.sql import Window as W
from pyspark.sql import functions as F

from sievewright.functions.vectors import let
from sievewright.session import materialize

#: A side may be broadcast when the optimizer estimates at most so many bytes for it; beyond that a shuffle join is used.
BROADCAST_BYTES = 64 << 20


def estimated_bytes(df: DataFrame) -> int:
    """The optimizer's estimate of a frame's size."""
    return int(str(df._jdf.queryExecution().optimizedPlan().stats().sizeInBytes()))


def maybe_broadcast(df: DataFrame, most: int = BROADCAST_BYTES) -> DataFrame:
    """The frame, hinted for broadcast if its estimated size allows; the plan is the same join otherwise."""
    return F.broadcast(df) if estimated_bytes(df) <= most else df


def union_ordered(*frames: DataFrame) -> DataFrame:
    """All rows of frames with the same columns, each with `src_ord`, the number of its frame."""
    return reduce(DataFrame.unionByName, [f.withColumn("src_ord", F.lit(i)) for i, f in enumerate(frames)])


def first_wins(df: DataFrame, keys: list[str], order: list[str | Column], last: bool = False) -> DataFrame:
    """One row for each key: the first, or the last, in order. Null keys are keys; ties go by the given order alone.

    The rank is limited to 1 before the shuffle (window group limit), so a key with many rows sends one row from each task.
    """
    by = [F.col(o) if isinstance(o, str) else o for o in order]
    w = W.partitionBy(*keys).orderBy(*[o.desc() if last else o.asc() for o in by])
    return df.withColumn("__rank", F.row_number().over(w)).filter("__rank = 1").drop("__rank")


def last_wins(df: DataFrame, keys: list[str], order: list[str | Column]) -> DataFrame:
    return first_wins(df, keys, order, last=True)


def without(df: DataFrame, other: DataFrame, keys: list[str], fold_case: bool = False) -> DataFrame:
    """Rows whose key isn't among the other's keys; null keys never match. The other side is reduced to distinct keys first."""
    norm = (lambda c: F.lower(F.trim(c))) if fold_case else (lambda c: c)
    right = other.select(*[norm(F.col(k)).alias(f"__k{i}") for i, k in enumerate(keys)]).distinct()
    on = reduce(lambda a, b: a & b, [norm(df[k]) == right[f"__k{i}"] for i, k in enumerate(keys)])
    return df.join(maybe_broadcast(right), on, "left_anti")


def overlay(new: DataFrame, old: DataFrame, key: str, columns: list[str]) -> DataFrame:
    """The new rows, in which a whole old row takes the place of a new one with the same key; old rows must be unique by key."""
    o = old.select(F.col(key).alias("__key"), F.struct(*columns).alias("__old"))
    j = new.join(o, F.col(key) == F.col("__key"), "left")
    rest = [c for c in new.columns if c not in columns]
    return j.select(*rest, *[F.when(F.col("__old").isNotNull(), F.col("__old")[c]).otherwise(F.col(c)).alias(c) for c in columns], F.col("__old").isNotNull().alias("replaced"))


def with_reason(df: DataFrame, reasons: list[tuple[str, Column]], name: str = "reason", kept: str = "kept") -> DataFrame:
    """A column with the first reason, in order, that holds for a row; `kept` where none does. Null conditions don't hold."""
    out = reduce(lambda acc, r: acc.when(F.coalesce(r[1], F.lit(False)), r[0]), reasons[1:], F.when(F.coalesce(reasons[0][1], F.lit(False)), reasons[0][0]))
    return df.withColumn(name, out.otherwise(kept))


def reason_counts(df: DataFrame, name: str = "reason") -> DataFrame:
    return df.groupBy(name).agg(F.count(F.lit(1)).alias("n"))


def valid_prefix(df: DataFrame, valid: Column, order: str, start: int = 1) -> DataFrame:
    """Rows before the first invalid one by `order`, each with `next_start`, the position after them.

    The first invalid position is one aggregate, so nothing is sorted into one task.
    """
    stop = df.filter(~F.coalesce(valid, F.lit(False))).agg(F.min(order)).scalar()
    kept = df.filter(stop.isNull() | (F.col(order) < stop))
    return kept.withColumn("next_start", F.lit(start) + kept.agg(F.count(F.lit(1))).scalar())


def row_numbers(df: DataFrame, order: list[str], name: str = "idx") -> DataFrame:
    """1-based numbers by a total order, without sorting into one task: ranges are sorted apart and counted up.

    The ranged rows are written once, each with its place within its range. The bounds of a range shuffle are sampled anew
    whenever a plan runs, so the counts and the rows must come from the same run. Rows that tie in `order` are numbered in any
    order; an empty frame stays empty.
    """
    spread = df.repartitionByRange(*[F.col(o) for o in order]).sortWithinPartitions(*order)
    ranged = materialize(spread.withColumn("__range_row", F.monotonically_increasing_id()), "ranged")
    part = F.shiftright("__range_row", 33)  # the upper bits of such an id are the range's number, the lower ones the row's within it
    sizes = ranged.groupBy(part.alias("__range")).agg(F.count(F.lit(1)).alias("__size"))
    before = sizes.select("__range", F.coalesce(F.sum("__size").over(W.orderBy("__range").rowsBetween(W.unboundedPreceding, -1)), F.lit(0)).alias("__before"))
    place = F.col("__range_row").bitwiseAND(F.lit((1 << 33) - 1))
    numbered = ranged.withColumn("__range", part).join(F.broadcast(before), "__range")  # one row for each range
    return numbered.withColumn(name, place + F.col("__before") + 1).drop("__range", "__range_row", "__before")


def row_slice(df: DataFrame, start: int | None = None, count: int | None = None, order: str = "idx") -> DataFrame:
    """Rows from a 1-based position on, at most `count`; positions out of range give what there is."""
    lo = max(1, start or 1)
    out = df.filter(F.col(order) >= lo)
    return out if count is None else out.filter(F.col(order) < lo + max(0, count))


def missing_ids(wanted: DataFrame, df: DataFrame, key: str) -> DataFrame:
    """The wanted keys that the frame lacks."""
    return wanted.select(key).distinct().join(df.select(key).distinct(), key, "left_anti")


def keyword_combinations(sections: list[Column], most: int = 15) -> Column:
    """Search keyword sets from four lists (behaviours p, errors e, code c, domain d), strategies in order, without repeats.

    Strategies, each with the first so many of its lists: 3 p with 4 e and 3 c; 3 p with 4 d and 3 e; 3 p with 4 c and 3 d; 4 p with
    one of the first 8 of e, c and d laid end to end; 5 p alone. A set that is the same as an earlier one, whatever its order and
    case, is dropped; the first `most` are kept. Null lists are empty ones. array<array<string>>.
    """
    from sievewright.functions.text import keyword_signature

    p, e, c, d = (F.coalesce(s, F.array().cast("array<string>")) for s in sections)
    first = lambda xs, n: F.slice(xs, 1, n)

    def extended(sets: Column, other: Column) -> Column:
        return F.flatten(F.transform(sets, lambda have: F.transform(other, lambda x: F.concat(have, F.array(x)))))

    def crossed(*lists: Column) -> Column:
        return reduce(extended, lists[1:], F.transform(lists[0], lambda x: F.array(x)))

    every = F.concat(
        crossed(first(p, 3), first(e, 4), first(c, 3)), crossed(first(p, 3), first(d, 4), first(e, 3)), crossed(first(p, 3), first(c, 4), first(d, 3)), crossed(first(p, 4), first(F.concat(e, c, d), 8)), crossed(first(p, 5))
    )
    start = F.struct(F.array().cast("array<string>").alias("seen"), F.array().cast("array<array<string>>").alias("got"))

    def step(acc: Column, x: Column) -> Column:
        new = ~F.array_contains(acc["seen"], keyword_signature(x)) & (F.size(acc["got"]) < most)
        return F.struct(F.when(new, F.array_append(acc["seen"], keyword_signature(x))).otherwise(acc["seen"]).alias("seen"), F.when(new, F.concat(acc["got"], F.array(x))).otherwise(acc["got"]).alias("got"))

    return F.aggregate(every, start, step, lambda acc: acc["got"])


def first_by_key(items: Column, key: str) -> Column:
    """An array of structs without those whose key came before, in order; null keys are left out. Sorted, so not quadratic."""
    places = F.filter(F.transform(items, lambda x, i: F.struct(x[key].alias("k"), i.alias("i"))), lambda y: y["k"].isNotNull())
    firsts = let(F.sort_array(places), lambda s: F.filter(s, lambda y, j: (j == 0) | (y["k"] != F.get(s, j - 1)["k"])))
    return F.transform(F.sort_array(F.transform(firsts, lambda y: y["i"])), lambda i: F.get(items, i))


def memoized(df: DataFrame, keys: list[str], fetched: DataFrame) -> DataFrame:
    """Rows with what was fetched for their distinct keys; rows without an answer keep nulls."""
    return df.join(fetched, keys, "left")


def requests_for(df: DataFrame, keys: list[str]) -> DataFrame:
    """The distinct keys to fetch; null keys are left out."""
    return df.select(*keys).dropna().distinct()


def restricted(df: DataFrame, ids: DataFrame, key: str) -> tuple[DataFrame, DataFrame]:
    """The rows with one of the given keys, and the given keys that no row has."""
    return df.join(ids.select(key).distinct(), key, "left_semi"), missing_ids(ids, df, key)


def first_n(df: DataFrame, n: int, order: list[str]) -> DataFrame:
    """The first n rows in order; all rows for 0."""
    return df.orderBy(*order).limit(n) if n else df


def top_n(df: DataFrame, groups: list[str], by: str, n: int, ties: list[str]) -> DataFrame:
    """The n rows of each group with the largest `by`, nulls last, with `place`; ties go by the columns of `ties` upwards.

    The rank is limited before the shuffle, so a hot group sends n rows from each task.
    """
    w = W.partitionBy(*groups).orderBy(F.desc_nulls_last(by), *ties)
    return df.withColumn("place", F.row_number().over(w)).filter(F.col("place") <= n)


def castable(df: DataFrame, columns: list[str], kind: str = "double") -> DataFrame:
    """Rows whose columns can all be cast, cast."""
    out = df.withColumns({c: F.col(c).cast("string").try_cast(kind) for c in columns})
    return out.dropna(subset=columns)


def run_summary(df: DataFrame, ok: Column, amount: str, key: str) -> tuple[DataFrame, DataFrame]:
    """One row of rows, good rows and the sum of an amount; and the keys of all failed rows, a table of their own however many."""
    good = F.coalesce(ok, F.lit(False))
    counts = df.agg(F.count(F.lit(1)).alias("n"), F.count_if(good).alias("n_ok"), F.coalesce(F.sum(amount), F.lit(0)).alias("total"))
    return counts, df.filter(~good).select(key)


def positional_slices(items: Column, lengths: list[Column]) -> list[Column]:
    """Consecutive slices of an array by their lengths: answers that came in one list, back to what was asked."""
    out, start = [], F.lit(1)
    for n in lengths:
        out.append(F.slice(items, start, n))
        start = start + n
    return out
