"""Filling fixed-capacity containers by bin completion.

Sizes are whole tokens up to the capacity, so a collection of any length is a histogram of at most ``capacity`` rows.
Bin completion works on the histogram: the largest size left is completed by the filling with the least waste, found by
branch and bound over fillings with larger items first (a filling is skipped when one with larger items at the same
places was tried, which dominates it), with the best-fit filling as incumbent. The filling is used as often as the
counts allow. Since perfect fillings use up small items that later containers need, the whole packing is searched too:
passes that accept the incumbent filling from some waste on, and passes that take another filling at the costliest
places of the best packing so far. A pass is left as soon as its waste rules out a packing with fewer containers, and
all end when the lower bound is met. Items are then handed out by their rank within their size.
"""

from __future__ import annotations

from bisect import bisect_right

import numpy as np
import pandas as pd
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from corpusmill.llm.tokens import rank_within

#: Nodes of one filling's search, and passes over the whole histogram that take another filling somewhere.
NODES = 600
PASSES = 32
#: Tokens of waste from which on a pass takes the incumbent filling without a search.
ACCEPTED = (0, 1, 2, 3, 5, 8, 13, 21)

Run = tuple[int, dict[int, int]]


def dominated(use: dict[int, int], left: int, counts: dict[int, int], open_sizes: int) -> bool:
    """Whether an item that is left over can take the place of smaller items of a filling with ``left`` tokens to spare.

    ``open_sizes`` has a bit for every size in ``counts``. The sums of all subsets of the filling are the bits of a
    number, so one shift adds an item. An item dominates a subset whose sum it exceeds by at most the spare room, or
    equals if the subset has two items or more.
    """
    one = several = 0
    for size, n in use.items():
        for _ in range(n):
            several |= (one | several) << size
            one |= 1 << size
        if n >= counts[size]:
            open_sizes &= ~(1 << size)
    reach, span, more = 1 | one | several, 1, 0
    if left:
        while span < left:  # bits of reach moved by 0 to left - 1
            step = min(span, left - span)
            reach |= reach << step
            span += step
        more = reach << 1
    return bool((several | more) & open_sizes)


def fillings(sizes: list[int], counts: dict[int, int], room: int, nodes: int = NODES, accepted: int = 0) -> list[tuple[int, dict[int, int]]]:
    """The best undominated fillings of ``room``, least waste first: (waste, size to number); at most four.

    A branch is left when all items it may still use would leave more waste than the best filling has. The best-fit
    filling is returned alone if it wastes at most ``accepted``.
    """
    greedy: dict[int, int] = {}
    left, at = room, bisect_right(sizes, room) - 1
    while at >= 0 and left > 0:
        use = min(counts[sizes[at]], left // sizes[at])
        if use:
            greedy[sizes[at]] = use
            left -= use * sizes[at]
        at = min(at - 1, bisect_right(sizes, left) - 1)
    found = [(left, greedy)]
    best, spent = left, 0
    if best <= accepted or not sizes:
        return found
    upto, total = [], 0  # tokens of all items up to each size, as far as they matter
    for size in sizes:
        total = min(room, total + size * counts[size])
        upto.append(total)
    open_sizes = sum(1 << size for size in sizes if size <= room)

    def keep(rest: int, chosen: dict[int, int]) -> None:
        nonlocal best
        if (rest < best or (rest == best and len(found) < 4)) and chosen != greedy and not dominated(chosen, rest, counts, open_sizes):
            found.append((rest, dict(chosen)))
            best = min(best, rest)

    def walk(at: int, left: int, chosen: dict[int, int]) -> None:
        nonlocal spent
        at = min(at, bisect_right(sizes, left) - 1)
        if at < 0:
            keep(left, chosen)
            return
        while at >= 0 and best > 0 and spent < nodes:
            if left - upto[at] > best:
                return
            spent += 1
            size = sizes[at]
            for use in range(min(counts[size], left // size), 0, -1):
                rest = left - use * size
                chosen[size] = use
                if rest < sizes[0] or at == 0:
                    keep(rest, chosen)
                elif rest - upto[at - 1] <= best:
                    walk(at - 1, rest, chosen)
                del chosen[size]
                if best == 0 or spent >= nodes:
                    return
            at -= 1

    walk(len(sizes) - 1, room, {})
    found.sort(key=lambda x: x[0])
    return found[:4]


def complete_bins(histogram: dict[int, int], capacity: int, deviate_at: int = -1, allowed: int | None = None, accepted: int = 0) -> list[Run] | None:
    """Runs (times, filling) that use up the histogram; at the run ``deviate_at`` another filling than the first is taken.

    None once more than ``allowed`` tokens of room are wasted.
    """
    wasted = 0
    counts = dict(histogram)
    sizes = sorted(counts)
    runs: list[Run] = []
    while sizes:
        top = sizes[-1]
        counts[top] -= 1
        if not counts[top]:
            sizes.pop()
        if len(runs) == deviate_at:
            options = fillings(sizes, counts, capacity - top)
            _, chosen = options[1 if len(options) > 1 else 0]
        else:
            _, chosen = fillings(sizes, counts, capacity - top, NODES, accepted)[0]
        counts[top] += 1
        if counts[top] == 1:
            sizes.append(top)
        use = dict(chosen)
        use[top] = use.get(top, 0) + 1
        times = min(counts[s] // n for s, n in use.items())
        for s, n in use.items():
            counts[s] -= times * n
        sizes = [s for s in sizes if counts[s]]
        runs.append((times, use))
        wasted += times * (capacity - sum(s * n for s, n in use.items()))
        if allowed is not None and wasted > allowed:
            return None
    return runs


def best_fit_decreasing(histogram: dict[int, int], capacity: int) -> list[Run]:
    """The incumbent: every container takes the largest items that fit, one size after the other."""
    counts = {s: n for s, n in histogram.items() if n}
    sizes = sorted(counts)
    runs: list[Run] = []
    while sizes:
        left, use = capacity, {}
        at = len(sizes) - 1
        while at >= 0:
            n = min(counts[sizes[at]], left // sizes[at])
            if n:
                use[sizes[at]] = n
                left -= n * sizes[at]
            at = min(at - 1, bisect_right(sizes, left) - 1)
        times = min(counts[s] // n for s, n in use.items())
        for s, n in use.items():
            counts[s] -= times * n
        sizes = [s for s in sizes if counts[s]]
        runs.append((times, use))
    return runs


def containers(runs: list[Run]) -> int:
    return sum(times for times, _ in runs)


def plan_packing(histogram: dict[int, int], capacity: int) -> list[Run]:
    """The packing with the fewest containers that the passes found."""
    histogram = {int(s): int(n) for s, n in histogram.items() if n > 0 and s > 0}
    if not histogram:
        return []
    tokens = sum(s * n for s, n in histogram.items())
    bound = -(-tokens // capacity)
    best, accepted = best_fit_decreasing(histogram, capacity), ACCEPTED[0]

    def fewer(deviate_at: int, accept: int) -> list[Run] | None:
        return complete_bins(histogram, capacity, deviate_at, (containers(best) - 1) * capacity - tokens, accept)  # within the waste of one container less

    for accept in ACCEPTED:
        while containers(best) > bound and (again := fewer(-1, accept)) is not None:
            best, accepted = again, accept
    tried = 0
    while containers(best) > bound and tried < PASSES:
        waste = np.array([times * (capacity - sum(s * n for s, n in use.items())) for times, use in best[:-1]])
        for at in np.argsort(-waste, kind="stable")[: PASSES - tried]:
            tried += 1
            again = fewer(int(at), accepted)
            if again is not None:
                best = again
                break
        else:
            break
    return best


def _places(runs: list[Run]) -> dict[int, tuple[np.ndarray, np.ndarray, np.ndarray]]:
    """Per size: first rank of each run, items per container, first container."""
    out: dict[int, tuple[list[int], list[int], list[int]]] = {}
    at, used = 0, {}
    for times, use in runs:
        for s, n in use.items():
            first, each, where = out.setdefault(s, ([], [], []))
            first.append(used.get(s, 0))
            each.append(n)
            where.append(at)
            used[s] = used.get(s, 0) + times * n
        at += times
    return {s: tuple(np.array(x, dtype=np.int64) for x in v) for s, v in out.items()}


def pack_items(items: DataFrame, item: str, size: str, capacity: int) -> DataFrame:
    """(item, piece, size_from, size_to, container): the container, from 0, of every item or piece.

    ``items`` must give the same rows when it is read twice, and ``item`` must tell rows apart. An item above the
    capacity is cut into full containers and a remainder, ``size_from`` and ``size_to`` say which tokens; no other item
    is cut. Items of null, zero or negative size need no room and have a null container. Other columns are ignored,
    whatever their names. An empty table gives an empty result. The driver holds one number per size up to the
    capacity and the plan made from them.
    """
    rows = items.select(F.col(item).alias("item"), F.greatest(F.coalesce(F.col(size), F.lit(0)), F.lit(0)).cast("long").alias("size"))
    count = F.greatest(F.lit(1), F.ceil(F.col("size") / capacity)).cast("int")
    pieces = rows.withColumn("piece", F.explode(F.sequence(F.lit(0), count - 1)))
    pieces = pieces.select("item", "piece", (F.col("piece").cast("long") * capacity).alias("size_from"), F.least("size", (F.col("piece").cast("long") + 1) * capacity).alias("size_to"))
    pieces = pieces.withColumn("own", F.col("size_to") - F.col("size_from"))
    found = pieces.groupBy("own").count().collect()  # at most capacity + 1 rows
    runs = plan_packing({r["own"]: r["count"] for r in found}, capacity)
    places = items.sparkSession.sparkContext.broadcast(_places(runs))

    @F.pandas_udf("long")
    def place(own: pd.Series, rank: pd.Series) -> pd.Series:
        out = np.full(len(own), -1, dtype=np.int64)
        sizes, ranks = own.to_numpy(), rank.to_numpy()
        for s in np.unique(sizes):
            if s in places.value:
                first, each, where = places.value[s]
                at = np.flatnonzero(sizes == s)
                k = np.searchsorted(first, ranks[at], side="right") - 1
                out[at] = where[k] + (ranks[at] - first[k]) // each[k]
        return pd.Series(out)

    ranked = rank_within(pieces, ["own"], [F.col("item"), F.col("piece")])
    container = place("own", "rank")
    return ranked.select(F.col("item").alias(item), "piece", "size_from", "size_to", F.when(F.col("own") > 0, container).alias("container"))
