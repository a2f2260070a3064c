"""Filling fixed-capacity containers with items (problem 6).

The items' sizes are counted; everything up to the plan works on this histogram, which the capacity
bounds whatever the number of items. The plan is a solution of the configuration linear program: how often
to use each multiset of sizes that fits one container. Multiplicative weights hold a price for each size; a
knapsack by dynamic programming finds the configurations worth most at these prices (one for each size to
start from, out of one table), they are used in part, and the prices of sizes that stay behind rise. The
fractional solution is rounded down, and the remainder, again as a histogram, gets configurations from knapsacks
at the prices with the best bound, each around the largest size left. A configuration worth one container at such
prices is one that an optimal solution may use; how many containers are, and the gap to the bound, is
reported. At last each item gets its container by its rank among the items of its size, which groups of items
count on their own.
"""

from __future__ import annotations

from collections.abc import Iterator
from dataclasses import dataclass, field

import numpy as np
import pandas as pd
import pyarrow as pa
from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

from cairnfold.session import cut

#: Rounds of prices at most (they end where a round adds next to nothing), and configurations taken from each round's table.
ROUNDS, STARTS = 64, 128
#: A configuration is near enough to the best one at the program's prices; and what one for the remainder is worth
#: when no more sizes are priced for it, of which it begins with so many.
TOLERANCE, ENOUGH, PRICED = 0.01, 0.0005, 48
#: Bytes of the knapsack's decisions that are kept at once.
SEGMENT = 64 << 20
#: ``pack_limits`` may hold so many; they pass through the driver.
MOST_LIMITS = 1000
#: Items that one group ranks at most, about.
GROUP = 1 << 20


@dataclass
class Plan:
    """Configurations ``(how many containers, {size: copies})``; ``bound``: no packing has fewer containers; ``priced``:
    containers whose configuration is worth, at the program's prices, all but ``TOLERANCE`` of the best one."""

    capacity: int
    configurations: list[tuple[int, dict[int, int]]] = field(default_factory=list)
    bound: int = 0
    priced: int = 0

    @property
    def containers(self) -> int:
        return sum(n for n, _ in self.configurations)


class _Knapsack:
    """Most worth for each capacity, with any number of copies up to a limit of each size.

    One bit for each step and capacity says whether the step is taken. Only a segment of the steps holds its bits;
    those of the others are made again from the worths at its beginning, so that memory stays below ``SEGMENT`` and
    one row of worths for each segment.
    """

    def __init__(self, sizes: np.ndarray, most: np.ndarray, worth: np.ndarray, capacity: int):
        self.steps: list[tuple[int, int, float]] = []
        for s, m, v in zip(sizes.tolist(), most.tolist(), worth.tolist(), strict=True):
            k = 1
            while m > 0:
                k = min(k, m)
                if s * k > capacity:
                    break
                self.steps.append((s, k, v))
                m -= k
                k *= 2
        self.length = max(1, SEGMENT * 8 // (capacity + 1))
        self.best, self.starts, self.bits = np.zeros(capacity + 1), [], []
        for a in range(0, len(self.steps), self.length):
            self.starts.append(self.best.copy() if len(self.steps) > self.length else self.best)
            self.bits = self._run(self.best, a)

    def _run(self, best: np.ndarray, a: int) -> list[np.ndarray]:
        bits = []
        for s, k, v in self.steps[a : a + self.length]:
            w = s * k
            new = best[: len(best) - w] + v * k
            better = new > best[w:] + 1e-15
            np.copyto(best[w:], new, where=better)
            bits.append(np.packbits(better))
        return bits

    def contents(self, capacities: np.ndarray) -> list[dict[int, int]]:
        """The copies of each size in the best content of each capacity."""
        out: list[dict[int, int]] = [{} for _ in capacities]
        c = np.array(capacities, np.int64)
        for i in range(len(self.starts) - 1, -1, -1):
            bits = self.bits if i == len(self.starts) - 1 else self._run(self.starts[i].copy(), i * self.length)
            for (s, k, _), taken in zip(reversed(self.steps[i * self.length : (i + 1) * self.length]), reversed(bits), strict=True):
                if len(c) == 1:
                    at = int(c[0]) - s * k
                    if at >= 0 and taken[at >> 3] >> (7 - (at & 7)) & 1:
                        out[0][s] = out[0].get(s, 0) + k
                        c[0] = at
                    continue
                at = np.maximum(c - s * k, 0)
                for j in np.flatnonzero((c >= s * k) & (taken[at >> 3] >> (7 - (at & 7)) & 1).astype(bool)).tolist():
                    out[j][s] = out[j].get(s, 0) + k
                    c[j] -= s * k
        return out


def plan(counts: dict[int, int], capacity: int, rounds: int = ROUNDS, starts: int = STARTS) -> Plan:
    """A packing of ``counts[size]`` items of each size from 1 to ``capacity``. Deterministic."""
    out = Plan(capacity)
    sizes = np.array(sorted((s for s, n in counts.items() if n > 0), reverse=True), np.int64)
    if not len(sizes):
        return out
    if sizes[0] > capacity or sizes[-1] < 1:
        raise ValueError("sizes must lie between 1 and the capacity")
    demand = np.array([counts[s] for s in sizes.tolist()], np.float64)
    place = {s: i for i, s in enumerate(sizes.tolist())}
    price = sizes / capacity
    bound, best_price = (demand * price).sum(), price
    cover = np.zeros(len(sizes))
    used: dict[tuple, float] = {}
    eta = 0.15
    for _ in range(rounds):
        left = demand - cover
        if left.max() < 1:
            break
        most = np.minimum(np.ceil(np.maximum(left, 0)), capacity // sizes).astype(np.int64)
        sack = _Knapsack(sizes, most, price, capacity)
        if (most >= np.minimum(demand, capacity // sizes)).all():
            # prices at which no configuration is worth more than one container bound any packing
            value = (price * demand).sum() / max(sack.best[capacity], 1e-12)
            if value > bound:
                bound, best_price = value, price / sack.best[capacity]
        open_ = np.flatnonzero(left >= 1)
        first = open_[np.argsort(-(left * price)[open_], kind="stable")[:starts]]
        moved = 0.0
        for i, config in zip(first.tolist(), sack.contents(capacity - sizes[first]), strict=True):
            s = int(sizes[i])
            config[s] = config.get(s, 0) + 1
            at = np.array([place[x] for x in config])
            copies = np.array(list(config.values()), np.float64)
            step = ((demand[at] - cover[at]) / copies).min()
            if step < 1:  # it could only be rounded away
                continue
            step = max(1.0, step * 0.7)
            moved += step
            cover[at] += step * copies
            key = tuple(sorted(config.items()))
            used[key] = used.get(key, 0.0) + step
        if moved < TOLERANCE / 10 * bound:
            break
        behind = 1 - cover / demand
        price = price * np.exp(eta * (behind - (behind * demand * sizes).sum() / (demand * sizes).sum()))
        price = np.maximum(price, 1e-12)
    out.bound = int(np.ceil(bound - 1e-6))
    rest = {s: int(n) for s, n in zip(sizes.tolist(), demand.tolist(), strict=True)}
    for key, x in used.items():
        n = int(x + 1e-9)
        if n:
            out.configurations.append((n, dict(key)))
            for s, k in key:
                rest[s] -= n * k
    worth = dict(zip(sizes.tolist(), best_price.tolist(), strict=True))
    _round_off(out, rest, worth)
    out.priced = sum(n for n, c in out.configurations if sum(worth[s] * k for s, k in c.items()) >= 1 - TOLERANCE)
    return out


def _round_off(out: Plan, rest: dict[int, int], worth: dict[int, float]) -> None:
    """Configurations for what rounding down has left: the largest size and, for its gap, the knapsack at the program's
    prices. It is priced over a part of the sizes, as any part makes a configuration, and over more of them until
    the configuration is worth enough or all sizes were priced. Each step uses up at least one size."""
    sizes = np.array(sorted((s for s, n in rest.items() if n > 0), reverse=True), np.int64)
    n = np.array([rest[s] for s in sizes.tolist()], np.int64)
    value = np.array([worth[s] for s in sizes.tolist()])
    nth = 0
    while len(sizes):
        gap = out.capacity - int(sizes[0])
        fits = np.flatnonzero((sizes <= gap) & (n - (np.arange(len(n)) == 0) > 0))
        config, part = {int(sizes[0]): 1}, PRICED
        while len(fits):
            if len(fits) > part:
                own = np.unique(np.r_[fits[: part // 2], fits[np.linspace(nth % 7, len(fits) - 1, part - part // 2).astype(int)]])
            else:
                own = fits
            most = np.minimum(n[own] - (own == 0), gap // sizes[own])
            sack = _Knapsack(sizes[own], most, value[own], gap)
            if len(own) == len(fits) or value[0] + sack.best[gap] >= 1 - ENOUGH:
                for s, k in sack.contents(np.array([gap]))[0].items():
                    config[s] = config.get(s, 0) + k
                break
            part *= 4
        at = np.searchsorted(-sizes, -np.array(list(config)))
        copies = np.array(list(config.values()))
        times = int((n[at] // copies).min())
        out.configurations.append((times, config))
        n[at] -= times * copies
        keep, nth = n > 0, nth + 1
        sizes, n, value = sizes[keep], n[keep], value[keep]


@dataclass(frozen=True)
class _Intervals:
    """For each (limit, size) the intervals of ranks and the containers they fill, as sorted arrays: rank
    ``first[i] + r`` of its pair lies in container ``container[i] + r // copies[i]``."""

    pairs: np.ndarray  # sorted, limit number times (largest capacity + 1) plus size
    first: np.ndarray  # sorted, pair number times 2**40 plus rank
    container: np.ndarray
    copies: np.ndarray
    limits: dict[int, int]
    width: int

    def containers(self, limit: np.ndarray, size: np.ndarray, rank: np.ndarray) -> np.ndarray:
        number = np.array([self.limits[x] for x in limit.tolist()], np.int64)
        pair = np.searchsorted(self.pairs, number * self.width + size)
        at = pair * (1 << 40) + rank
        i = np.searchsorted(self.first, at, "right") - 1
        return self.container[i] + (at - self.first[i]) // self.copies[i]


def _intervals(plans: dict[int, Plan]) -> _Intervals:
    limits = {limit: i for i, limit in enumerate(sorted(plans))}
    width = max((p.capacity for p in plans.values()), default=0) + 1
    rows = []
    for limit, p in plans.items():
        at: dict[int, int] = {}
        container = 1
        for n, config in p.configurations:
            for s, k in config.items():
                rows.append((limits[limit] * width + s, at.get(s, 0), container, k))
                at[s] = at.get(s, 0) + n * k
            container += n
    table = np.array(sorted(rows), np.int64).reshape(-1, 4)
    pairs, number = np.unique(table[:, 0], return_inverse=True)
    return _Intervals(pairs, number * (1 << 40) + table[:, 1], table[:, 2], table[:, 3], limits, width)


def _limits(limits: DataFrame) -> list[tuple[int, int]]:
    """(limit_id, capacity) of the limits with a positive capacity, of which there may be ``MOST_LIMITS``."""
    own = limits.where("capacity_tokens > 0 and limit_id is not null").select("limit_id", "capacity_tokens").distinct()
    rows = own.orderBy("limit_id").limit(MOST_LIMITS + 1).collect()
    if len(rows) > MOST_LIMITS:
        raise ValueError(f"more than {MOST_LIMITS} limits")
    return [(r[0], r[1]) for r in rows]


def pieces(sizes: DataFrame, limits: DataFrame, item: str = "doc_id", size: str = "n_tokens") -> DataFrame:
    """``limit_id, capacity, <item>, piece, size``: an item as one piece, or as many full ones as its size demands
    and what is left. Limits without a positive capacity have none."""
    each = _for_each(sizes.where(F.col(size) > 0), limits).select("l.limit_id", "l.capacity", item, F.col(size).cast("bigint").alias("_n"))
    each = each.withColumn("piece", F.explode(F.sequence(F.lit(0).cast("bigint"), F.expr("(_n - 1) div capacity"))))
    return each.select("limit_id", "capacity", item, "piece", F.least("capacity", F.col("_n") - F.col("piece") * F.col("capacity")).alias("size"))


def _for_each(sizes: DataFrame, limits: DataFrame) -> DataFrame:
    kind = limits.schema["limit_id"].dataType
    own = [F.struct(F.lit(i).cast(kind).alias("limit_id"), F.lit(c).cast("bigint").alias("capacity")) for i, c in _limits(limits)]
    none = F.array().cast(f"array<struct<limit_id:{kind.simpleString()},capacity:bigint>>")
    return sizes.withColumn("l", F.explode(F.array(*own) if own else none))


_PLAN = "limit_id bigint, capacity bigint, bound bigint, priced bigint, nth int, times bigint, sizes array<bigint>, copies array<bigint>"


def _solve(table: pa.Table) -> pa.Table:
    limit, capacity = table["limit_id"][0].as_py(), table["capacity"][0].as_py()
    p = plan(dict(zip(table["size"].to_pylist(), table["n"].to_pylist(), strict=True)), capacity)
    n = len(p.configurations)
    columns = [
        [limit] * n, [capacity] * n, [p.bound] * n, [p.priced] * n, range(n), [x for x, _ in p.configurations],
        [list(c) for _, c in p.configurations], [list(c.values()) for _, c in p.configurations],
    ]
    kinds = [pa.int64()] * 4 + [pa.int32(), pa.int64()] + [pa.list_(pa.int64())] * 2
    return pa.table([pa.array(list(c), k) for c, k in zip(columns, kinds, strict=True)], names=[x.split()[0] for x in _PLAN.split(", ")])


def solve(items: DataFrame) -> dict[int, Plan]:
    """Plans for each limit from the histogram of ``limit_id, capacity, size``, each in a task of its own."""
    counts = cut(items.groupBy(F.col("limit_id").cast("bigint").alias("limit_id"), "capacity", "size").agg(F.count(F.lit(1)).alias("n")))
    # a number of partitions that is given is kept, so that no task gets all limits
    tasks = 4 * max(1, counts.select("limit_id").distinct().count())
    counts = counts.repartition(tasks, "limit_id")
    plans: dict[int, Plan] = {}
    for r in sorted(counts.groupBy("limit_id", "capacity").applyInArrow(_solve, _PLAN).collect(), key=lambda r: (r["limit_id"], r["nth"])):
        own = plans.setdefault(r["limit_id"], Plan(r["capacity"], [], r["bound"], r["priced"]))
        own.configurations.append((r["times"], dict(zip(r["sizes"], r["copies"], strict=True))))
    return plans


def pack(sizes: DataFrame, limits: DataFrame, item: str = "doc_id", size: str = "n_tokens", group: int = GROUP) -> tuple[DataFrame, dict[int, Plan]]:
    """Which piece lies in which container: ``limit_id, <item>, piece, size, container_id`` (from 1), and the plans.

    Repeated rows of an item are one; items of size 0 or null lie in no container (null) as they need none.
    Only an item larger than the capacity is split. No container holds more than its capacity. Ranks are
    taken in the order of items within groups of a hash, so that any executor finds them again.
    """
    sizes = sizes.select(item, size).distinct()
    items = cut(pieces(sizes, limits, item, size))
    plans = solve(items)
    intervals = _intervals(plans)
    groups = max(1, -(-items.count() // group))
    dealt = items.withColumn("_g", F.pmod(F.xxhash64(item, "piece"), F.lit(groups)).cast("int"))
    part = ["limit_id", "size", "_g"]
    before = Window.partitionBy("limit_id", "size").orderBy("_g").rowsBetween(Window.unboundedPreceding, -1)
    offset = dealt.groupBy(*part).agg(F.count(F.lit(1)).alias("_c")).withColumn("_before", F.coalesce(F.sum("_c").over(before), F.lit(0)))
    ranked = (
        dealt.withColumn("_nth", F.row_number().over(Window.partitionBy(*part).orderBy(item, "piece")))
        .join(offset.drop("_c"), part)
        .withColumn("_rank", F.col("_before") + F.col("_nth") - 1)
    )

    @F.pandas_udf("bigint")
    def container(batches: Iterator[tuple[pd.Series, pd.Series, pd.Series]]) -> Iterator[pd.Series]:
        for limit, width, rank in batches:
            yield pd.Series(intervals.containers(limit.to_numpy(), width.to_numpy(), rank.to_numpy()))

    placed = ranked.select("limit_id", item, "piece", "size", container("limit_id", "size", "_rank").alias("container_id"))
    none = _for_each(sizes.where(F.coalesce(F.col(size), F.lit(0)) <= 0), limits)
    zero = F.lit(0).cast("bigint")
    none = none.select("l.limit_id", item, zero.alias("piece"), zero.alias("size"), F.lit(None).cast("bigint").alias("container_id"))
    return placed.unionByName(none), plans


def fill_report(placed: DataFrame, limits: DataFrame, plans: dict[int, Plan]) -> DataFrame:
    """For each limit: ``limit_id, capacity_tokens, containers, tokens, unused_tokens, unused_part, fullest,
    least_containers, gap, priced_containers``. Measured from the placement, not from the plan; ``least_containers`` is the
    bound of the linear program, below which no packing gets, ``gap`` by how much more were used, and
    ``priced_containers`` those whose configuration is within ``TOLERANCE`` of the best at the program's prices."""
    spark = placed.sparkSession
    fill = placed.where("container_id is not null").groupBy("limit_id", "container_id").agg(F.sum("size").alias("fill"))
    sums = fill.groupBy("limit_id").agg(F.count(F.lit(1)).alias("containers"), F.sum("fill").alias("tokens"), F.max("fill").alias("fullest"))
    bounds = spark.createDataFrame([(int(k), int(p.bound), int(p.priced)) for k, p in plans.items()], "limit_id int, least_containers bigint, priced_containers bigint")
    room = F.col("containers") * F.col("capacity_tokens")
    return (
        limits.select("limit_id", "capacity_tokens").distinct().join(sums, "limit_id").join(bounds, "limit_id")
        .withColumn("gap", F.col("containers") / F.col("least_containers") - 1)
        .withColumn("unused_tokens", room - F.col("tokens"))
        .withColumn("unused_part", F.col("unused_tokens") / room)
    )
