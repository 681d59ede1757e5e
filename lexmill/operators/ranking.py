"""Row numbers, running sums and allocations over whole tables without a single task that sees all rows."""

from __future__ import annotations

import numpy as np
import pandas as pd
from pyspark.sql import Column, DataFrame
from pyspark.sql import Window as W
from pyspark.sql import functions as F

from lexmill.sources.shared import keep


def global_running(df: DataFrame, order: list[str | Column], value: Column, name: str) -> DataFrame:
    """Running sum of value over the whole table in the given order.

    The table is cut into ranges of the order; sums run within a range, and the totals of the ranges before, one row
    per range, are added. Ties must be broken by the order itself.
    """
    n = int(df.sparkSession.conf.get("spark.sql.shuffle.partitions"))
    keys = [F.col(c) if isinstance(c, str) else c for c in order]
    ranged = df.withColumn("__v", value).repartitionByRange(n, *keys).withColumn("__p", F.spark_partition_id())
    kept = keep(ranged)
    within = W.partitionBy("__p").orderBy(*keys).rowsBetween(W.unboundedPreceding, 0)
    totals = kept.groupBy("__p").agg(F.sum("__v").alias("t"))
    before = W.orderBy("__p").rowsBetween(W.unboundedPreceding, -1)
    base = totals.select("__p", F.coalesce(F.sum("t").over(before), F.lit(0)).alias("__b"))  # one row per range
    return (
        kept.withColumn(name, F.sum("__v").over(within))
        .join(F.broadcast(base), "__p")
        .withColumn(name, F.col(name) + F.col("__b"))
        .drop("__p", "__b", "__v")
    )


def global_row_number(df: DataFrame, order: list[str | Column], name: str, start: int = 0) -> DataFrame:
    out = global_running(df, order, F.lit(1).cast("long"), name)
    return out.withColumn(name, F.col(name) - 1 + start)


def in_ranges(df: DataFrame, keys: list[str], order: list[str]) -> DataFrame:
    """The rows, written, with the number __p of their range of keys and order, dealt by both: what goes over ranges needs
    no other shuffle, and a task holds no more than its share however few groups there are."""
    n = int(df.sparkSession.conf.get("spark.sql.shuffle.partitions"))
    return keep(df.repartitionByRange(n, *keys, *order).withColumn("__p", F.spark_partition_id())).repartition(n, *keys, "__p")


def over_ranges(ranged: DataFrame, keys: list[str], order: list[str], sums: dict[str, Column] | None = None, lasts: dict[str, Column] | None = None) -> DataFrame:
    """Adds running sums, and last values that aren't null, up to each row of its group of keys in the given order, which
    has no ties. ranged: rows with the number __p of their range of keys and order, so a group may stand in many tasks.

    A range's own sums and values are those of its rows; what lies before them is one row for each range whose group
    began in an earlier one.
    """
    sums, lasts = sums or {}, lasts or {}
    within = W.partitionBy(*keys, "__p").orderBy(*order)
    upto = within.rowsBetween(W.unboundedPreceding, 0)
    running = {n: F.sum(c).over(upto) for n, c in sums.items()} | {n: F.last(c, ignorenulls=True).over(upto) for n, c in lasts.items()}
    own = ranged.withColumns(running | {"__next": F.lead(F.lit(True)).over(within)})
    ends = own.filter("__next IS NULL").select(*keys, "__p", *running)
    ranges = W.partitionBy(*keys).orderBy("__p")
    earlier = ranges.rowsBetween(W.unboundedPreceding, -1)
    carried = [F.sum(n).over(earlier).alias(f"__b{n}") for n in sums] + [F.last(n, ignorenulls=True).over(earlier).alias(f"__b{n}") for n in lasts]
    before = ends.select(*keys, "__p", *carried, F.row_number().over(ranges).alias("__k")).filter("__k > 1").drop("__k")
    joined = own.join(F.broadcast(before), [*keys, "__p"], "left")  # as many rows as ranges at most
    whole = {n: F.col(n) + F.coalesce(f"__b{n}", F.lit(0)) for n in sums} | {n: F.coalesce(n, f"__b{n}") for n in lasts}
    return joined.withColumns(whole).drop("__next", *[f"__b{n}" for n in running])


def largest_remainder(df: DataFrame, keys: list[str], weight: Column, total: Column, order: list[str]) -> DataFrame:
    """Column share: total dealt in proportion to integer weights within keys, exactly; what is left over goes to the
    largest remainders, ties in the given order. Without keys the sums are scalars and places go by ranges."""
    weighted = df.withColumn("__w", weight.cast("long")).withColumn("__t", total.cast("long"))
    if not keys:
        return _largest_remainder_of_all(keep(weighted), order)
    w = W.partitionBy(*keys)
    weighted = weighted.withColumn("__s", F.sum("__w").over(w))
    dealt = weighted.withColumn("__floor", F.expr("CASE WHEN __s = 0 THEN 0 ELSE (__w * __t) DIV __s END")).withColumn(
        "__rem", F.expr("CASE WHEN __s = 0 THEN 0 ELSE (__w * __t) % __s END")
    )
    left = F.col("__t") - F.sum("__floor").over(w)
    place = F.row_number().over(w.orderBy(F.col("__rem").desc(), *order))
    return (
        dealt.withColumn("__left", left)
        .withColumn("share", F.col("__floor") + F.when(place <= F.col("__left"), 1).otherwise(0))
        .drop("__w", "__t", "__s", "__floor", "__rem", "__left")
    )


def _largest_remainder_of_all(weighted: DataFrame, order: list[str]) -> DataFrame:
    n = weighted.agg(F.sum("__w").alias("s")).scalar()
    dealt = weighted.withColumn("__s", n).withColumn("__floor", F.expr("CASE WHEN __s = 0 THEN 0 ELSE (__w * __t) DIV __s END")).withColumn(
        "__rem", F.expr("CASE WHEN __s = 0 THEN 0 ELSE (__w * __t) % __s END")
    )
    left = F.col("__t") - dealt.agg(F.sum("__floor").alias("f")).scalar()
    placed = global_row_number(dealt, [F.col("__rem").desc(), *order], "__place", 1)
    return placed.withColumn("share", F.col("__floor") + F.when(F.col("__place") <= left, 1).otherwise(0)).drop("__w", "__t", "__s", "__floor", "__rem", "__place")


def packed_groups(sizes: Column, budget: Column | int) -> Column:
    """Group number, from 0, of each size of an array when sizes are packed greedily in order: a group takes the next
    one while its sum stays within the budget, and one that is too large stands alone."""
    limit = F.lit(budget) if isinstance(budget, int) else budget
    state = F.struct(
        F.array().cast("array<int>").alias("out"), F.lit(0).cast("int").alias("group"), F.lit(0).cast("long").alias("sum"), F.lit(0).cast("int").alias("n")
    )

    def step(s: Column, x: Column) -> Column:
        fits = (s["n"] == 0) | (s["sum"] + x <= limit)
        group = F.when(fits, s["group"]).otherwise(s["group"] + 1).cast("int")
        return F.struct(
            F.concat(s["out"], F.array(group)).alias("out"),
            group.alias("group"),
            F.when(fits, s["sum"] + x).otherwise(x).cast("long").alias("sum"),
            F.lit(1).cast("int").alias("n"),
        )

    return F.aggregate(sizes, state, step, lambda s: s["out"])


def _follow(ends: np.ndarray, budget: int) -> list[int]:
    """For each size, where the next group starts if one starts there; ends: the sums before each size and after the last."""
    return np.maximum(np.searchsorted(ends, ends[:-1] + budget, "right") - 1, np.arange(1, len(ends))).tolist()


def _passages(sizes: np.ndarray, budget: int) -> tuple[list[int], list[int], list[int]]:
    """What a range of sizes does to the group that is open before it, by that group's sum: from least on, how many groups
    start in the range, and the sum of the last of them, or of the range where none starts. Sums over the budget, at which
    nothing fits, are budget + 1. There are no more entries than sizes fit into one group."""
    n, ends = len(sizes), np.concatenate(([0], np.cumsum(sizes)))
    follow, fitting = _follow(ends, budget), int(np.searchsorted(ends, budget, "right")) - 1
    least, groups, left = ([0], [0], [int(ends[n])]) if fitting == n else ([], [], [])
    known = {}  # groups from a start on, and the last of them: chains from different starts meet soon
    for first in range(min(fitting, n - 1), -1, -1):
        if first and not sizes[first]:
            continue  # it fits wherever the size before it does
        path, at = [], first
        while at < n and at not in known:
            path.append(at)
            at = follow[at]
        behind, last = known[at] if at < n else (0, path[-1])
        known |= {start: (behind + k, last) for k, start in enumerate(reversed(path), 1)}
        least.append(max(0, budget - int(ends[first + 1]) + 1))
        groups.append(known[first][0])
        left.append(min(int(ends[n] - ends[last]), budget + 1))
    return least, groups, left


def packed_over_ranges(ranged: DataFrame, keys: list[str], order: list[str], size: Column, budget: int) -> DataFrame:
    """(*keys, *order, size, group): packed_groups of the rows of each group of keys in the given order, which has no ties.
    ranged: rows with the number __p of their range of keys and order, so a group of keys may stand in many tasks.

    A range says what it does to any group that may be open before it; these are gone through in order, some rows of
    numbers for each range, and each range then numbers its own groups. A size that is missing stands alone.
    """
    fits = F.least(F.coalesce("size", F.lit(budget + 1)), F.lit(budget + 1)).alias("__n")
    kept = keep(ranged.select(*keys, "__p", *order, size.cast("long").alias("size"))).select("*", fits)
    kind = dict(kept.dtypes)
    named = ", ".join(f"{c} {kind[c]}" for c in [*keys, "__p"])

    def passed(pdf: pd.DataFrame) -> pd.DataFrame:
        found = _passages(pdf.sort_values(order)["__n"].to_numpy(), budget)
        return pdf[[*keys, "__p"]].head(1).assign(least=[found[0]], groups=[found[1]], left=[found[2]])

    def numbered(pdf: pd.DataFrame) -> pd.DataFrame:
        pdf = pdf.sort_values(order)
        sizes = pdf["__n"].to_numpy()
        ends = np.concatenate(([0], np.cumsum(sizes)))
        follow, starts = _follow(ends, budget), []
        at = int(np.searchsorted(ends, budget - pdf["__open"].iloc[0], "right")) - 1 if pdf["__open"].iloc[0] <= budget else 0
        while at < len(sizes):
            starts.append(at)
            at = follow[at]
        return pdf.assign(group=pdf["__at"] + np.searchsorted(starts, np.arange(len(sizes)), "right"))[[*keys, *order, "size", "group"]]

    passages = kept.groupBy(*keys, "__p").applyInPandas(passed, f"{named}, least array<long>, groups array<long>, left array<long>")
    listed = passages.groupBy(*keys).agg(F.array_sort(F.collect_list(F.struct("__p", "least", "groups", "left"))).alias("r"))
    # Before the first range nothing fits, and the group that then starts is number 0.
    state = lambda out, open_, at: F.struct(out.alias("out"), open_.cast("long").alias("open"), at.cast("long").alias("at"))

    def step(s: Column, x: Column) -> Column:
        entry = F.size(F.filter(x["least"], lambda t: t <= s["open"])) - 1
        more, left = F.get(x["groups"], entry), F.get(x["left"], entry)
        here = F.struct(x["__p"].alias("__p"), s["open"].alias("__open"), s["at"].alias("__at"))
        return state(F.concat(s["out"], F.array(here)), F.when(more > 0, left).otherwise(s["open"] + left), s["at"] + more)

    none = F.array().cast(f"array<struct<__p:{kind['__p']},__open:long,__at:long>>")
    before = listed.select(*keys, F.inline(F.aggregate("r", state(none, F.lit(budget + 1), F.lit(-1)), step, lambda s: s["out"])))
    joined = kept.join(F.broadcast(before), [*keys, "__p"])  # as many rows as ranges
    rows = ", ".join(f"{c} {kind[c]}" for c in [*keys, *order, "size"])
    return joined.groupBy(*keys, "__p").applyInPandas(numbered, f"{rows}, group long")


#: Score of a pair that doesn't count.
NO_SCORE = np.iinfo(np.int64).min


def best_of(best: np.ndarray, best_id: np.ndarray, scores: np.ndarray, ids: np.ndarray, k: int) -> tuple[np.ndarray, np.ndarray]:
    """The k best scores and ids of each row, of those known (rows of k, NO_SCORE where fewer are) and of new ones, whose
    ids ascend. Ties go to the smallest id. Only rows with a new score that reaches their k-th are sorted."""
    hot = np.flatnonzero((scores >= best[:, -1:]).any(1))
    if not len(hot):
        return best, best_id
    new, found = scores[hot], np.broadcast_to(ids, (len(hot), len(ids)))
    if len(ids) > k:
        # The k-th score; of those equal to it the first, which have the smallest ids.
        least = np.partition(new, len(ids) - k, axis=1)[:, len(ids) - k, None]
        above, equal = new > least, new == least
        equal &= np.cumsum(equal, axis=1, dtype=np.int32) <= k - above.sum(1, keepdims=True)
        at = np.nonzero(above | equal)[1].reshape(-1, k)
        new, found = np.take_along_axis(new, at, 1), ids[at]
    new, found = np.concatenate((best[hot], new), 1), np.concatenate((best_id[hot], found), 1)
    at = np.lexsort((found, -new.astype(np.float64)), axis=1)[:, :k]
    best[hot], best_id[hot] = np.take_along_axis(new, at, 1), np.take_along_axis(found, at, 1)
    return best, best_id
