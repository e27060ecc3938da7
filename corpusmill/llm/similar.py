"""Most similar vectors for every vector: balanced posting lists searched through a centroid graph.

A bounded sample is split into balanced lists, each with a centroid. The centroids and a neighbourhood graph over
them are the only data every task holds. A vector is *posted* to its nearest list and, where it lies near a boundary,
to further lists; the same search, with a wider distance ratio, names the lists it *visits* as a query. Similarities
are computed list by list with matrix products, and the best of all visited lists are merged. Lists that lie near each
other are one group: a vector is sent once to each group that it needs, however many of its lists it needs.

The sample only places the lists: every row is posted and every row is a query.
"""

from __future__ import annotations

import math
import zlib
from dataclasses import dataclass

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

from corpusmill.operators.vectors import nearest
from corpusmill.session import cut_lineage


@dataclass(frozen=True)
class ListIndexConfig:
    """Parameters of the index. ``sample_rows`` and ``max_lists`` bound what the driver and each task hold.

    How many lists a query visits, and up to which ratio of distances, is set by the index itself: the cheapest pair
    with which ``recall`` of the neighbours of ``probes`` sample rows, found by brute force within the sample, are met.
    With a least similarity these are the neighbours above it of ``pair_probes`` rows, found by brute force among all rows,
    that visits to ``visit_lists`` lists would meet: neighbours within a sample are farther off the larger the table. The
    first share of ``pair_recall`` is met for which ``cheap_visits`` a row suffice, else the last; no row visits less than
    its own ``post_lists``, which costs no further copy.
    """

    list_rows: int = 1_280
    least_lists: int = 8
    sample_rows: int = 12_000
    sample_a_list: int = 16
    max_lists: int = 3_000
    post_lists: int = 2
    post_ratio: float = 1.05
    visit_lists: int = 64
    visit_ratios: tuple[float, ...] = (1.05, 1.1, 1.15, 1.2, 1.3, 1.45, 1.7, 2.5, 10.0)
    recall: float = 0.99
    probes: int = 500
    pair_probes: int = 400
    pair_recall: tuple[float, ...] = (0.998, 0.99, 0.98)
    cheap_visits: float = 4.0
    graph_degree: int = 16
    beam: int = 10
    block_rows: int = 20_000
    cells_a_task: int = 4
    group_lists: int = 16
    group_rows: int = 160_000
    seed: int = 7


# ---------------------------------------------------------------- encoding


def _matrix(column: pa.Array) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
    """Flat values, offsets and a mask of the usable rows of a list<float> column."""
    if isinstance(column, pa.ChunkedArray):
        column = column.combine_chunks()
    lengths = np.asarray(column.value_lengths().fill_null(0), dtype=np.int64)
    flat = column.flatten()
    values = np.asarray(flat.fill_null(float("nan")) if flat.null_count else flat, dtype=np.float32)
    offsets = np.concatenate([[0], np.cumsum(lengths)])
    usable = lengths > 0
    if len(values):
        bad = ~np.isfinite(values)
        spoiled = np.concatenate([[0], np.cumsum(bad)])
        filled = np.concatenate([[0], np.cumsum(values != 0)])
        usable &= (spoiled[offsets[1:]] == spoiled[offsets[:-1]]) & (filled[offsets[1:]] > filled[offsets[:-1]])
    return values, offsets, usable


#: Powers of two by which numbers are multiplied to be whole.
SCALES = (8, 9, 7, 10, 5, 0)


def encode_rows(block: np.ndarray) -> list[bytes]:
    """Each row as bytes, two per number where half precision holds it exactly, else four."""
    with np.errstate(over="ignore"):
        half = block.astype(np.float16)
    exact = (half.astype(np.float32) == block).all(axis=1)
    return [half[i].tobytes() if exact[i] else block[i].tobytes() for i in range(len(block))]


def encode_short(block: np.ndarray) -> list[bytes]:
    """``encode_rows``, but with one byte per number and one for the scale where all are small multiples of a power of two."""
    out = encode_rows(block)
    if block.shape[1] < 2:  # a byte and the scale would be two bytes
        return out
    at = np.flatnonzero([len(c) == 2 * block.shape[1] for c in out])
    at = at[~(np.signbit(block[at]) & (block[at] == 0)).any(axis=1)]  # a negative zero keeps its sign
    for power in SCALES:
        grown = block[at] * np.float32(2.0**power)
        short = (np.abs(grown).max(axis=1, initial=0) <= 127) & (grown == np.round(grown)).all(axis=1)
        for i, row in zip(at[short], grown[short].astype(np.int8), strict=True):
            out[i] = bytes([power]) + row.tobytes()
        at = at[~short]
    return out


def decode_rows(codes: pa.Array | list[bytes], dim: int) -> np.ndarray:
    """The inverse of ``encode_rows`` and ``encode_short``; float32."""
    raw = codes.to_pylist() if hasattr(codes, "to_pylist") else codes
    out = np.empty((len(raw), dim), dtype=np.float32)
    short = [i for i, c in enumerate(raw) if len(c) == 2 * dim]
    if short:
        out[short] = np.frombuffer(b"".join(raw[i] for i in short), dtype=np.float16).reshape(-1, dim)
    tiny = [i for i, c in enumerate(raw) if len(c) == dim + 1 != 2 * dim]
    if tiny:
        rows = np.frombuffer(b"".join(raw[i] for i in tiny), dtype=np.int8).reshape(-1, dim + 1)
        out[tiny] = rows[:, 1:] * np.exp2(-rows[:, :1].astype(np.float32))
    wide = [i for i, c in enumerate(raw) if len(c) == 4 * dim]
    if wide:
        out[wide] = np.frombuffer(b"".join(raw[i] for i in wide), dtype=np.float32).reshape(-1, dim)
    return out


def unit_rows(block: np.ndarray) -> np.ndarray:
    """Rows scaled to length one; norms in double precision so that very large or small numbers are safe."""
    return unit_rows_wide(block).astype(np.float32)


def unit_rows_wide(block: np.ndarray) -> np.ndarray:
    """``unit_rows`` in double precision."""
    wide = block.astype(np.float64)
    scale = np.abs(wide).max(axis=1, keepdims=True)
    wide /= scale
    return wide / np.sqrt(np.einsum("ij,ij->i", wide, wide))[:, None]


# ---------------------------------------------------------------- building the lists


def _halves(rows: np.ndarray, rng: np.random.Generator) -> np.ndarray:
    """Whether each row lies in the upper half: two means, cut at the widest gap between the 30 % and 70 % ranks."""
    pick = rng.choice(len(rows), 2, replace=False)
    a, b = rows[pick[0]], rows[pick[1]]
    for _ in range(5):
        side = rows @ (a - b) >= 0
        if side.all() or not side.any():
            break
        a, b = rows[side].mean(axis=0), rows[~side].mean(axis=0)
    along = rows @ (a - b)
    order = np.argsort(along, kind="stable")
    low, high = max(1, int(0.3 * len(order))), max(2, int(math.ceil(0.7 * len(order))))
    gaps = np.diff(along[order])[low - 1 : high]
    cut = low + int(gaps.argmax()) if len(gaps) else len(order) // 2
    upper = np.zeros(len(rows), dtype=bool)
    upper[order[cut:]] = True
    return upper


def balanced_centroids(sample: np.ndarray, lists: int, seed: int = 7) -> np.ndarray:
    """Centroids of ``lists`` balanced groups of unit vectors.

    The largest group is halved until there are enough. Then rows go to their nearest centroid, and while that leaves
    a group of more than twice the mean it is halved again and the smallest group, of less than half the mean, given
    up: balance is judged by where rows really go.
    """
    if lists <= 1 or len(sample) <= 1:
        return unit_rows(sample.mean(axis=0, keepdims=True) + 1e-12)
    rng = np.random.default_rng(seed)
    groups = [np.arange(len(sample))]
    lists = min(lists, len(sample))
    while len(groups) < lists:
        groups.sort(key=len)
        members = groups.pop()
        if len(members) < 2:
            groups.append(members)
            break
        upper = _halves(sample[members], rng)
        groups += [members[~upper], members[upper]]

    def centre(rows: np.ndarray) -> np.ndarray:
        mean = sample[rows].mean(axis=0)
        return mean / max(float(np.sqrt(mean @ mean)), 1e-9)  # a mixed list's mean is short, and would be nearest to every isolated vector

    centroids = np.stack([centre(g) for g in groups]).astype(np.float32)
    fair = len(sample) / len(groups)
    for _ in range(6):
        nearest = _nearest(sample, centroids)
        count = np.bincount(nearest, minlength=len(centroids))
        wide, thin = np.argsort(-count, kind="stable"), np.argsort(count, kind="stable")
        moves = min(int((count[wide] > 2 * fair).sum()), int((count[thin] < fair / 2).sum()))
        order = np.argsort(nearest, kind="stable")
        ends = np.cumsum(count)
        rows_of = [order[end - n : end] for end, n in zip(ends, count, strict=True)]
        fresh = [centre(rows) if len(rows) else c for rows, c in zip(rows_of, centroids, strict=True)]
        for big, small in zip(wide[:moves], thin[:moves], strict=True):
            upper = _halves(sample[rows_of[big]], rng)
            fresh[big], fresh[small] = centre(rows_of[big][~upper]), centre(rows_of[big][upper])
        centroids = np.stack(fresh).astype(np.float32)
        if not moves:
            break
    return centroids


def _nearest(rows: np.ndarray, centroids: np.ndarray, step: int = 4096) -> np.ndarray:
    half = 0.5 * np.einsum("ij,ij->i", centroids, centroids)
    return np.concatenate([(rows[i : i + step] @ centroids.T - half).argmax(axis=1) for i in range(0, len(rows), step)])


class CentroidGraph:
    """Centroids with a pruned neighbourhood graph, searched best first from the nearest entry points."""

    def __init__(self, centroids: np.ndarray, degree: int, seed: int = 7):
        self.centroids = np.ascontiguousarray(centroids, dtype=np.float32)
        self.half = 0.5 * np.einsum("ij,ij->i", self.centroids, self.centroids)
        count = len(centroids)
        rng = np.random.default_rng(seed)
        self.entries = np.sort(rng.choice(count, min(count, max(1, int(2 * math.sqrt(count)))), replace=False))
        degree = min(degree, count - 1)
        self.links = np.zeros((count, max(degree, 0)), dtype=np.int32)
        for start in range(0, count if degree > 0 else 0, 1024):
            near = self.half[None, :] - self.centroids[start : start + 1024] @ self.centroids.T
            near[np.arange(len(near)), np.arange(start, start + len(near))] = np.inf
            wide = min(3 * degree, count - 1)
            pool = np.argpartition(near, wide - 1, axis=1)[:, :wide]
            pool = np.take_along_axis(pool, np.argsort(np.take_along_axis(near, pool, 1), axis=1), 1)
            for i, candidates in enumerate(pool):
                self.links[start + i] = self._pruned(start + i, candidates, degree)

    def _pruned(self, node: int, candidates: np.ndarray, degree: int) -> np.ndarray:
        """Neighbours that are nearer to the node than to a neighbour already kept, filled up with the nearest."""
        points = self.centroids[candidates]
        squares = 2 * self.half[candidates]
        own = squares - 2 * points @ self.centroids[node]
        between = squares[:, None] + squares[None, :] - 2 * points @ points.T
        own = own + 2 * self.half[node]
        kept: list[int] = []
        for i in range(len(candidates)):
            if len(kept) < degree and all(between[i, j] > own[i] for j in kept):
                kept.append(i)
        rest = [i for i in range(len(candidates)) if i not in set(kept)]
        return candidates[np.array((kept + rest)[:degree], dtype=int)]

    def search(self, rows: np.ndarray, beam: int, width: int | None = None) -> tuple[np.ndarray, np.ndarray]:
        """Squared distances and list numbers of the nearest lists found, ascending, ``width`` per row.

        Rows that share their nearest entry walk the graph together: a node is opened once any of them has it among its
        ``beam`` nearest, and a round multiplies the group's rows with the newly met centroids alone. A group ends when
        all its beams are open. Rows for which fewer than ``width`` lists were met get infinite distances for the rest.
        """
        width = min(width or beam, len(self.centroids))
        square = np.full((len(rows), width), np.inf, dtype=np.float32)
        lists = np.zeros((len(rows), width), dtype=np.int64)
        start = self.entries[(rows @ self.centroids[self.entries].T - self.half[self.entries]).argmax(axis=1)]
        order = np.argsort(start, kind="stable")
        for who in np.split(order, np.flatnonzero(np.diff(start[order])) + 1):
            if len(who):
                score, met = self._walk(rows[who], int(start[who[0]]), beam, width)
                near = min(width, len(met))
                top = np.argpartition(-score, near - 1, axis=1)[:, :near]
                value = np.take_along_axis(score, top, 1)
                by = np.argsort(-value, axis=1, kind="stable")
                own = np.einsum("ij,ij->i", rows[who], rows[who])
                square[who, :near] = np.maximum(own[:, None] - 2 * np.take_along_axis(value, by, 1), 0)
                lists[who, :near] = met[np.take_along_axis(top, by, 1)]
        return square, lists

    def _walk(self, rows: np.ndarray, start: int, beam: int, width: int) -> tuple[np.ndarray, np.ndarray]:
        """Scores of a group of rows for the lists that were met, and their numbers."""
        seen, opened = np.zeros(len(self.centroids), dtype=bool), np.zeros(len(self.centroids), dtype=bool)
        met = np.array([start])
        seen[start] = True
        score = rows @ self.centroids[met].T - self.half[met]
        while True:
            reach = beam if len(met) >= width else width  # goes on until every row has met enough lists
            top = np.argpartition(-score, reach - 1, axis=1)[:, :reach] if len(met) > reach else np.arange(len(met))
            front = np.unique(met[top])
            front = front[~opened[front]]
            if not len(front):
                return score, met
            opened[front] = True
            fresh = np.unique(self.links[front])
            fresh = fresh[~seen[fresh]]
            if len(fresh):
                seen[fresh] = True
                met = np.concatenate([met, fresh])
                score = np.hstack([score, rows @ self.centroids[fresh].T - self.half[fresh]])


@dataclass
class ListIndex:
    """The lists of one vector length: graph, blocks of postings and parts of visitors per list, and how to visit."""

    graph: CentroidGraph
    visits: int = 1
    ratio: float = 1.0
    blocks: np.ndarray | None = None
    parts: np.ndarray | None = None
    groups: np.ndarray | None = None

    def chosen(self, block: np.ndarray, config: ListIndexConfig) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
        """The nearest lists of unit rows, and which of them hold the row's posting and are visited by it."""
        return chosen_lists(self.graph, block, self.visits, self.ratio, config)


def chosen_lists(graph: CentroidGraph, block: np.ndarray, visits: int, ratio: float, config: ListIndexConfig) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
    square, lists = graph.search(block, config.beam, max(config.post_lists, visits))
    far = np.sqrt(square) / np.maximum(np.sqrt(square[:, :1]), 1e-6)
    far[:, 0] = 1
    rank = np.arange(lists.shape[1])[None, :]
    return lists, (far <= config.post_ratio) & (rank < config.post_lists), (far <= ratio) & (rank < visits)


def calibrated_visits(graph: CentroidGraph, block: np.ndarray, config: ListIndexConfig, k: int = 5) -> tuple[int, float]:
    """The lists to visit at most and the ratio of distances up to which, with the fewest visits that reach the recall.

    Recall is that of the sample's own neighbours, which are farther off than those in the whole collection. Where no
    pair reaches it, all of ``visit_lists`` are visited.
    """
    if len(graph.centroids) == 1 or len(block) <= k:
        return 1, 1.0
    probes = np.unique(np.linspace(0, len(block) - 1, min(config.probes, len(block))).astype(int))
    near = block[probes] @ block.T
    near[np.arange(len(probes)), probes] = -np.inf
    near = np.argpartition(-near, k - 1, axis=1)[:, :k]
    most = min(config.visit_lists, len(graph.centroids))
    homes, post, _ = chosen_lists(graph, block[near.ravel()], 1, 1.0, config)
    homes = np.where(post, homes, -1).reshape(*near.shape, -1)
    best, least = (most, config.visit_ratios[-1]), math.inf
    for ratio in config.visit_ratios:
        lists, _, visit = chosen_lists(graph, block[probes], most, ratio, config)
        met = np.zeros(near.shape, dtype=bool)
        for count in range(1, most + 1):
            met |= (homes == lists[:, count - 1][:, None, None]).any(axis=2) & visit[:, count - 1][:, None]
            cost = visit[:, :count].sum(axis=1).mean()
            if met.mean() >= config.recall and cost < least:
                best, least = (count, ratio), cost
    return best


def paired_visits(graph: CentroidGraph, block: np.ndarray, left: np.ndarray, right: np.ndarray, config: ListIndexConfig) -> tuple[int, float]:
    """``calibrated_visits`` for given pairs of rows: the fewest visits of sample rows with which enough of the pairs are
    met that visits to all of ``visit_lists`` meet."""
    most = min(config.visit_lists, len(graph.centroids))
    homes, post, _ = chosen_lists(graph, right, 1, 1.0, config)
    homes = np.where(post, homes, -1)
    rows = block[np.unique(np.linspace(0, len(block) - 1, min(config.probes, len(block))).astype(int))]
    tried = []
    for ratio in config.visit_ratios:
        lists, _, visit = chosen_lists(graph, left, most, ratio, config)
        cost = chosen_lists(graph, rows, most, ratio, config)[2]
        met = np.zeros(len(left), dtype=bool)
        for count in range(1, most + 1):
            met |= (homes == lists[:, count - 1][:, None]).any(axis=1) & visit[:, count - 1]
            tried.append((cost[:, :count].sum(axis=1).mean(), count, ratio, met.mean()))
    best = max(t[3] for t in tried)
    tried = [t for t in tried if t[1] >= min(config.post_lists, most)]
    least = [min(t for t in tried if t[3] >= share * best) for share in config.pair_recall]
    return next((t for t in least if t[0] <= config.cheap_visits), least[-1])[1:3]


def _codes(batches):
    """(id, dim, code) of the usable rows."""
    for batch in batches:
        values, offsets, usable = _matrix(batch.column("embedding"))
        at = np.flatnonzero(usable)
        dims = (offsets[at + 1] - offsets[at]).astype(np.int32)
        out = [encode_short(values[offsets[i] : offsets[i + 1]][None, :])[0] for i in at]
        yield pa.RecordBatch.from_arrays([batch.column("id").take(pa.array(at)), pa.array(dims), pa.array(out, pa.binary())], ["id", "dim", "code"])


def true_pairs(rows: DataFrame, total: int, least: float, k: int, config: ListIndexConfig) -> dict[int, tuple[np.ndarray, np.ndarray]]:
    """Per vector length unit rows (left, right): about ``pair_probes`` rows and those of their ``k`` nearest above ``least``,
    by brute force over all rows."""
    share = min(1.0, config.pair_probes / total)
    probes = rows.filter(F.pmod(F.xxhash64("id", F.lit("probe")), F.lit(1_000_003)) < int(math.ceil(share * 1_000_003)))
    near = nearest(probes.select(F.col("id").alias("query_id"), F.col("embedding").alias("query_vector")), rows.select(F.col("id").alias("doc_id"), F.col("embedding").alias("doc_vector")), k + 1)
    pairs = near.filter((F.col("score") >= least) & (F.col("query_id") != F.col("doc_id"))).select("query_id", "doc_id").distinct().toArrow()
    a, b = (pairs.column(c).to_pylist() for c in ("query_id", "doc_id"))  # at most k for each probe
    ids = sorted({*a, *b})
    if not ids:
        return {}
    named = rows.sparkSession.createDataFrame(pa.table({"id": pa.array(ids)}))
    found = rows.join(F.broadcast(named), "id", "left_semi").mapInArrow(_codes, "id string, dim int, code binary").toArrow()
    code_of = {(i, d): c for i, d, c in zip(*(found.column(c).to_pylist() for c in ("id", "dim", "code")), strict=True)}
    out = {}
    for dim in {d for _, d in code_of}:
        both = [(code_of[x, dim], code_of[y, dim]) for x, y in zip(a, b, strict=True) if (x, dim) in code_of and (y, dim) in code_of]
        if both:
            out[dim] = tuple(unit_rows(decode_rows([p[side] for p in both], dim)) for side in (0, 1))
    return out


def grouped_lists(centroids: np.ndarray, most: int, seed: int = 7) -> np.ndarray:
    """A group number for each centroid: halves of halves until none holds more than ``most``."""
    rng = np.random.default_rng(seed)
    out = np.zeros(len(centroids), dtype=np.int64)
    todo, number = [np.arange(len(centroids))], 0
    while todo:
        members = todo.pop()
        if len(members) <= max(1, most):
            out[members] = number
            number += 1
            continue
        upper = _halves(centroids[members], rng)
        todo += [members[~upper], members[upper]]
    return out


def build_index(rows: DataFrame, config: ListIndexConfig, least: float | None = None, k: int = 5) -> dict[int, ListIndex]:
    """The lists per vector length. ``rows`` has (id, embedding).

    Reads a hash sample of about ``sample_rows`` rows, or ``sample_a_list`` for every list. The postings and the visitors of each list are estimated from
    it: a list that would hold more than ``block_rows`` of either is spread over blocks of postings and parts of
    visitors, and each block meets each part in a task of its own.
    """
    total = rows.count()
    if not total:
        return {}
    share = min(1.0, max(config.sample_rows, config.sample_a_list * min(config.max_lists, total // config.list_rows)) / total)
    picked = rows.filter(F.pmod(F.xxhash64("id"), F.lit(1_000_003)) < int(math.ceil(share * 1_000_003)))

    sample = picked.select("id", "embedding").mapInArrow(_codes, "id string, dim int, code binary").select("dim", "code").toArrow()
    pairs = true_pairs(rows, total, least, k, config) if least is not None else {}
    tasks = 4 * rows.sparkSession.sparkContext.defaultParallelism
    dims = np.asarray(sample.column("dim"))
    out = {}
    for dim in np.unique(dims):
        at = np.flatnonzero(dims == dim)
        block = unit_rows(decode_rows(sample.column("code").take(pa.array(at)), int(dim)))
        every, block = block, block[np.unique(np.round(block, 4), axis=0, return_index=True)[1]]  # one direction, one row
        rows_here = len(at) / share
        lists = int(max(1, min(config.max_lists, max(config.least_lists, rows_here / config.list_rows), len(block) / 4)))
        graph = CentroidGraph(balanced_centroids(block, lists, config.seed), config.graph_degree, config.seed)
        own = ListIndex(graph, *(paired_visits(graph, block, *pairs[int(dim)], config) if int(dim) in pairs and len(pairs[int(dim)][0]) >= LEAST_PAIRS else calibrated_visits(graph, block, config, k)))
        counts = np.zeros((2, lists))
        for i in range(0, len(every), 4096):
            near, *kinds = own.chosen(every[i : i + 4096], config)
            for kind, chosen in enumerate(kinds):
                counts[kind] += np.bincount(near[chosen], minlength=lists)
        own.blocks, own.parts = (np.maximum(1, np.ceil(c / share / config.block_rows)).astype(np.int64) for c in counts)
        rows_a_list = max(1.0, counts.sum() / share / lists)
        own.groups = grouped_lists(graph.centroids, min(config.group_lists, int(config.group_rows / rows_a_list), -(-lists // tasks)), config.seed)
        out[int(dim)] = own
    return out


#: Pairs from which visits are calibrated.
LEAST_PAIRS = 30

# ---------------------------------------------------------------- searching


def _postings(index_value, config: ListIndexConfig, copies: int):
    """A mapper from (id, embedding) to rows (dim, cell, block, part, id, code, posted, visits).

    A cell is a group of lists of one block and one part each, or, below 0, a larger list. ``posted`` and
    ``visits`` hold the numbers of the cell's lists where the row is posted and that it visits.
    """

    def run(batches):
        index = index_value()
        for batch in batches:
            values, offsets, usable = _matrix(batch.column("embedding"))
            ids = batch.column("id")
            lengths = offsets[1:] - offsets[:-1]
            for dim in np.unique(lengths[usable]):
                at = np.flatnonzero(usable & (lengths == dim))
                at = at[np.argsort(np.asarray(ids.take(pa.array(at)).to_pylist(), dtype=object), kind="stable")]
                block = np.stack([values[offsets[i] : offsets[i] + dim] for i in at])
                codes = encode_short(block)
                seen: dict[bytes, int] = {}
                kept = []
                for i, code in enumerate(codes):  # copies beyond those that can be among anyone's neighbours stay out
                    seen[code] = seen.get(code, 0) + 1
                    if seen[code] <= copies:
                        kept.append(i)
                names = ids.take(pa.array(at[kept]))
                codes = pa.array([codes[i] for i in kept], pa.binary())
                hashed = np.array([zlib.crc32(n.encode()) for n in names.to_pylist()], dtype=np.int64)
                block = unit_rows(block[kept])
                own = index.get(int(dim))
                for i in range(0, len(block), 4096):
                    part = block[i : i + 4096]
                    if own is None:  # a length that the sample lacks: one list
                        lists, post, visit = np.zeros((len(part), 1), int), np.ones((len(part), 1), bool), np.ones((len(part), 1), bool)
                    else:
                        lists, post, visit = own.chosen(part, config)
                    r, k = np.nonzero(post | visit)
                    number, row = lists[r, k], i + r
                    blocks, parts = (np.ones(len(r), np.int64), np.ones(len(r), np.int64)) if own is None else (own.blocks[number], own.parts[number])
                    # every posting lies in one block and meets all parts, every visitor in one part and meets all blocks
                    cells = blocks * parts
                    pair = np.repeat(np.arange(len(r)), cells)
                    cell = np.arange(len(pair)) - np.repeat(np.cumsum(cells) - cells, cells)
                    at_block, at_part = cell % blocks[pair], cell // blocks[pair]
                    posted = post[r, k][pair] & (at_block == hashed[row[pair]] % blocks[pair])
                    guest = visit[r, k][pair] & (at_part == hashed[row[pair]] // 65_521 % parts[pair])
                    use = np.flatnonzero(posted | guest)
                    group = np.where(cells > 1, -1 - number, 0 if own is None or own.groups is None else own.groups[number])[pair[use]]
                    by = np.lexsort((at_part[use], at_block[use], group, row[pair[use]]))
                    keys = np.stack([row[pair[use]], group, at_block[use], at_part[use]])[:, by]
                    begins = np.flatnonzero(np.concatenate([[True], (keys[:, 1:] != keys[:, :-1]).any(axis=0)])) if len(by) else np.zeros(0, int)
                    ends = np.concatenate([begins, [len(by)]])
                    lists_of = []
                    for kind in (posted[use][by], guest[use][by]):
                        lists_of.append((number[pair[use]][by][kind].astype(np.int32), np.concatenate([[0], np.cumsum(kind)])[ends].astype(np.int32)))
                    for j in range(0, len(begins), 8192):
                        u = keys[:, begins[j : j + 8192]]
                        edges = [(of, to[j : j + len(u[0]) + 1]) for of, to in lists_of]
                        both = [pa.ListArray.from_arrays(pa.array(to - to[0]), pa.array(of[to[0] : to[-1]])) for of, to in edges]
                        which = pa.array(u[0])
                        yield pa.RecordBatch.from_arrays(
                            [pa.array(np.full(len(u[0]), dim, dtype=np.int32)), *(pa.array(x.astype(np.int32)) for x in u[1:]), names.take(which), codes.take(which), *both],
                            ["dim", "cell", "block", "part", "id", "code", "posted", "visits"],
                        )

    return run


#: Above so many candidates of one visitor their exact cosines come from one product.
DENSE = 256


def _flat(lists: pa.ListArray) -> tuple[np.ndarray, np.ndarray]:
    """The values of all lists, and the row of each."""
    return np.asarray(lists.flatten()), np.repeat(np.arange(len(lists)), np.asarray(lists.value_lengths()))


def _neighbours(k: int, least: float | None):
    """Per (dim, cell, block, part), the k best postings for each visitor."""

    def run(key, group):
        dim = key[0].as_py()
        names = np.array(group.column("id").to_pylist(), dtype=object)
        place = np.unique(names.astype(str), return_inverse=True)[1]  # ids by their binary order
        codes = group.column("code").combine_chunks()
        (posted, owner), (visits, guest) = (_flat(group.column(c).combine_chunks()) for c in ("posted", "visits"))
        left, right, value = [], [], []
        for number in np.unique(visits):
            found = of_list(dim, codes, place, owner[posted == number], guest[visits == number])
            for old, new in zip((left, right, value), found, strict=True):
                old += new
        if not left:
            return pa.table({"id": pa.array([], pa.string()), "found": pa.array([], FOUND)})
        left_, right_, value_ = np.concatenate(left), np.concatenate(right), np.concatenate(value)
        once = np.unique(left_ * len(names) + place[right_], return_index=True)[1]  # two rows may share several lists
        left_, right_, value_ = left_[once], right_[once], value_[once]
        order = np.lexsort((place[right_], -value_, left_))
        left_, right_, value_ = left_[order], right_[order], value_[order]
        starts = np.flatnonzero(np.concatenate([[True], left_[1:] != left_[:-1]]))
        first = np.arange(len(left_)) - np.repeat(starts, np.diff(np.concatenate([starts, [len(left_)]]))) < k
        left_, right_, value_ = left_[first], right_[first], value_[first]
        starts = np.flatnonzero(np.concatenate([[True], left_[1:] != left_[:-1]]))
        items = pa.StructArray.from_arrays([pa.array(-value_), pa.array(names[right_].tolist(), pa.string())], ["far", "other"])
        ends = pa.ListArray.from_arrays(pa.array(np.concatenate([starts, [len(left_)]]), pa.int32()), items)
        return pa.table({"id": pa.array(names[left_[starts]].tolist(), pa.string()), "found": ends})

    def of_list(dim, codes, place, own, guests):
        """Visitors, postings and cosines of one list."""
        own = own[np.argsort(place[own], kind="stable")]
        given = decode_rows(codes.take(pa.array(own)), dim)  # about block_rows at most, and as many visitors
        rows, wide = unit_rows(given), None
        margin = 2 * (dim + 2) * 2.0**-24  # float32 products of equal cosines differ by less
        left, right, value = [], [], []
        for i in range(0, len(guests), 1024):
            who = guests[i : i + 1024]
            plain = decode_rows(codes.take(pa.array(who)), dim)
            near = unit_rows(plain) @ rows.T
            width = min(k + 4, near.shape[1])
            if not width:
                continue
            near[place[who][:, None] == place[own][None, :]] = -np.inf
            if least is not None:
                worth = (near >= least - 1e-4).any(axis=1)
                who, near, plain = who[worth], near[worth], plain[worth]
                if not len(who):
                    continue
            edge = -np.partition(-near, width - 1, axis=1)[:, width - 1] - margin
            floor = np.maximum(edge, (least - 1e-4) if least is not None else -3.0)
            hit = near >= floor[:, None]
            hit &= near > -np.inf
            many = hit.sum(axis=1) > DENSE
            if many.any() and wide is None:
                wide = unit_rows_wide(given)
            dense = np.flatnonzero(many)
            for j in range(0, len(dense), 64):  # many equal products: whole rows at a time, the k best stay
                part = dense[j : j + 64]
                exact = np.round(unit_rows_wide(plain[part]) @ wide.T, 9)
                exact[~hit[part]] = -np.inf
                top = np.argsort(-exact, axis=1, kind="stable")[:, :k]
                left.append(np.repeat(who[part], top.shape[1]))
                right.append(own[top.ravel()])
                value.append(np.take_along_axis(exact, top, 1).ravel())
            hit[many] = False
            r, c = np.nonzero(hit)
            for j in range(0, len(r), 8192):
                a, b = plain[r[j : j + 8192]].astype(np.float64), given[c[j : j + 8192]].astype(np.float64)
                exact = np.einsum("ij,ij->i", a, b) / np.sqrt(np.einsum("ij,ij->i", a, a) * np.einsum("ij,ij->i", b, b))
                left.append(who[r[j : j + 8192]])
                right.append(own[c[j : j + 8192]])
                value.append(np.round(exact, 9))
        return left, right, value

    return run


FOUND = pa.list_(pa.struct([("far", pa.float64()), ("other", pa.string())]))


def _best_lists(rows: DataFrame, k: int, least: float | None, config: ListIndexConfig) -> DataFrame:
    """(id, best): the ``k`` nearest of each row as array<struct<far, other>>, nearest first."""
    own = rows.select(F.col("id").cast("string").alias("id"), "embedding").filter(F.col("id").isNotNull())
    spark = own.sparkSession
    made = build_index(own, config, least, k)
    index = spark.sparkContext.broadcast(made)
    cells = sum(int((i.blocks * i.parts).sum()) for i in made.values())
    tasks = max(int(spark.conf.get("spark.sql.shuffle.partitions")), -(-cells // config.cells_a_task))
    spread = own.mapInArrow(_postings(lambda: index.value, config, k + 1), "dim int, cell int, block int, part int, id string, code binary, posted array<int>, visits array<int>")
    spread = spread.repartition(tasks, "dim", "cell", "block", "part")
    found = spread.groupBy("dim", "cell", "block", "part").applyInArrow(_neighbours(k, least), "id string, found array<struct<far:double,other:string>>")
    return found.groupBy("id").agg(F.slice(F.array_sort(F.array_distinct(F.flatten(F.collect_list("found")))), 1, k).alias("best"))


def similar_vectors(rows: DataFrame, k: int = 5, least: float | None = None, config: ListIndexConfig | None = None) -> DataFrame:
    """For every usable vector its ``k`` most similar: (id, other, cosine, place), place from 1.

    ``rows`` has at least (id STRING, embedding ARRAY<FLOAT>); other columns are ignored whatever their names.
    Vectors that are null, empty, all zero or hold a null, NaN or infinity take part in nothing. Vectors of different
    lengths are never compared. Equal cosines (nine digits) are ordered by id in binary order. A repeated id counts
    once if its vector repeats. An empty table gives an empty result. ``least`` drops similarities below it, before
    any exchange. Of exact copies the ``k + 1`` with the smallest ids are searched, since no other copy can be among
    anyone's ``k``: further copies may get no rows here; ``similar_to_all`` gives them theirs.
    """
    best = _best_lists(rows, k, least, config or ListIndexConfig())
    out = best.select("id", F.posexplode("best").alias("at", "hit"))
    out = out.select("id", F.col("hit.other").alias("other"), (-F.col("hit.far")).alias("cosine"), (F.col("at") + 1).alias("place"))
    return out if least is None else out.filter(F.col("cosine") >= least)


def _marks(rows: DataFrame) -> DataFrame:
    """(id, mark): a digest of every usable vector, equal for exact copies."""

    def digest(batches):
        import hashlib

        for batch in batches:
            values, offsets, usable = _matrix(batch.column("embedding"))
            at = np.flatnonzero(usable)
            marks = [hashlib.blake2b((values[offsets[i] : offsets[i + 1]] + 0.0).tobytes(), digest_size=16).digest() for i in at]
            yield pa.RecordBatch.from_arrays([batch.column("id").take(pa.array(at)), pa.array(marks, pa.binary())], ["id", "mark"])

    return rows.select(F.col("id").cast("string").alias("id"), "embedding").filter(F.col("id").isNotNull()).mapInArrow(digest, "id string, mark binary").distinct()


def copy_classes(rows: DataFrame) -> DataFrame:
    """(id, class_id, copies): the smallest id with the same vector, number for number, and how many rows share it."""
    marked = _marks(rows)
    heads = marked.groupBy("mark").agg(F.min("id").alias("class_id"), F.count("*").alias("copies"))
    return marked.join(heads, "mark").select("id", "class_id", "copies")


def similar_to_all(rows: DataFrame, k: int = 5, config: ListIndexConfig | None = None) -> DataFrame:
    """``similar_vectors`` with rows for every usable vector, however many copies it has.

    The ``k`` first copies of a class stand before every later one, so all copies from the ``k + 1``-th on have the
    same neighbours: those of the ``k + 1``-th, which is always searched. Classes are found over the whole table.
    """
    best = cut_lineage(_best_lists(rows, k, None, config or ListIndexConfig()))
    marked = cut_lineage(_marks(rows))
    by = Window.partitionBy("mark").orderBy("id")
    last = marked.withColumn("at", F.row_number().over(by)).filter(F.col("at") <= k + 1).filter(F.col("at") == k + 1).select("mark", F.col("id").alias("model"))
    shared = last.join(best.withColumnRenamed("id", "model"), "model").select("mark", "model", "best")
    further = cut_lineage(marked.join(shared, "mark").filter("id > model").select("id", "best"))  # empty but for large classes
    ids = further.select("id")
    both = best.join(ids, "id", "left_semi").unionByName(further).groupBy("id").agg(F.array_sort(F.array_distinct(F.flatten(F.collect_list("best")))).alias("best"))
    every = best.join(ids, "id", "left_anti").unionByName(both)
    every = every.withColumn("best", F.slice(F.filter("best", lambda x: x["other"] != F.col("id")), 1, k))
    out = every.select("id", F.posexplode("best").alias("at", "hit"))
    return out.select("id", F.col("hit.other").alias("other"), (-F.col("hit.far")).alias("cosine"), (F.col("at") + 1).alias("place"))


def mutual_pairs(neighbours: DataFrame) -> DataFrame:
    """(id_a, id_b) with id_a < id_b where each names the other."""
    pairs = neighbours.select(F.least("id", "other").alias("id_a"), F.greatest("id", "other").alias("id_b"))
    return pairs.groupBy("id_a", "id_b").agg(F.count("*").alias("n")).filter("n >= 2").select("id_a", "id_b")


def neighbour_report(rows: DataFrame, k: int = 5, config: ListIndexConfig | None = None) -> DataFrame:
    """``similar_vectors`` kept on disk for several readers."""
    return cut_lineage(similar_vectors(rows, k, None, config))
