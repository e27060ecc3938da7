"""Near-duplicate records: groups and pairs of texts that share most of their words.

A text is the set of its distinct words. The number of words that two sets don't share is a Hamming distance between
their indicator vectors, so similarity ``t`` (shared words over all words) means a distance of at most
``(1 - t) / (1 + t)`` times the sum of both sizes. Folding the indicator vector into 256 bits by parity can only shorten
that distance, so the fold is a fingerprint whose Hamming distance never misses a pair.

Rows are sharded, and every shard holds a forest of vantage-point trees. A node splits its rows at the median distance
to a vantage row; a row visits a side only if the triangle inequality allows a partner there, so rows near a boundary
visit both. Trees over all rows would hardly prune, since distances between unrelated texts are nearly equal (see the
README). Shards are therefore made of rows that share a rare word: words are ordered by their exact number of texts,
and a pair above the threshold always shares one of the rarest ``n - ceil(t n) + 1`` words of either. A word of many
texts makes no shard by itself: since a pair shares at least two words, its rows are sharded by that word together with
a later one. A shard of more rows than a bound is cut into blocks that meet pairwise. The distance to the empty set is
the size, the first vantage of all: sizes too far apart never meet. Every candidate is checked on its word sets.
"""

from __future__ import annotations

import itertools

import numpy as np
import pyarrow as pa
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from corpusmill.session import cut_lineage, spread

#: A word of more texts than this makes shards only together with a second word.
COMMON_TEXTS = 128
#: Words of the fingerprint, 64 bits each.
FOLD = 4
_FOLDS = ", ".join(f"f{k} long" for k in range(FOLD))
#: Words whose counts every task holds, 16 bytes each.
WORDS_HELD = 1 << 20
#: Rows of a shard's block. A larger shard is split into blocks that meet pairwise.
BLOCK_ROWS = 4_096
#: Rows of a tree's leaf, compared directly.
LEAF_ROWS = 16
#: Comparisons that are held at once.
HELD_PAIRS = 1_000_000


def word_sets(df: DataFrame, item: str, text: str) -> DataFrame:
    """(item, words, mark, size_mark): the sorted 64-bit hashes of the distinct words and two digests of them.

    Rows without a word are left out. Equal digests, 128 bits together, stand for equal word sets.

    A word is a longest run of letters in the text, lower-cased.
    """
    words = F.array_distinct(F.transform(F.regexp_extract_all(F.col(text), F.lit(r"(\p{L}+)"), F.lit(1)), F.lower))
    rows = df.select(F.col(item).alias("item"), F.array_sort(F.transform(words, lambda w: F.xxhash64(w))).alias("words"))
    rows = rows.filter((F.size("words") > 0) & F.col("item").isNotNull())
    return rows.withColumn("mark", F.xxhash64("words")).withColumn("size_mark", F.xxhash64(F.lit("second"), "words", F.size("words")))


def text_classes(sets: DataFrame) -> DataFrame:
    """(mark, size_mark, class_id, words, copies): one row per distinct word set, named by its smallest item."""
    return sets.groupBy("mark", "size_mark").agg(F.min("item").alias("class_id"), F.first("words").alias("words"), F.count("*").alias("copies"))


def _least_shared(size: Column, threshold: float) -> Column:
    """The words that a set of this size shares at least with any partner."""
    return F.ceil(size * threshold - 1e-9).cast("int")


def word_counts(classes: DataFrame) -> DataFrame:
    """(w, n): the exact number of classes that have each word, words of one class alone left out."""
    return classes.select(F.explode("words").alias("w")).groupBy("w").agg(F.count("*").alias("n")).filter("n > 1")


def ordered_words(classes: DataFrame, threshold: float) -> DataFrame:
    """(class_id, size, start, rare, f0...): the rarest words of each set, array<struct<n, w>> by the number of texts n,
    and its fingerprint.

    Words of one text alone join nothing and are left out; ``start`` says how many they are, since they hold the first
    places. One word more is kept than a shard by single words needs. A vocabulary of at most ``WORDS_HELD`` words is
    sent to all tasks, which order their sets as they are; a larger one is joined. Both give the same rows.
    """
    counts = cut_lineage(word_counts(classes))
    if counts.limit(WORDS_HELD + 1).count() <= WORDS_HELD:
        held = counts.orderBy("w").toArrow()
        sent = classes.sparkSession.sparkContext.broadcast((np.asarray(held.column("w")), np.asarray(held.column("n"))))
        return classes.select("class_id", "words").mapInArrow(_ordered(lambda: sent.value, threshold), f"class_id long, size int, start int, rare array<struct<n:long,w:long>>, {_FOLDS}").filter(F.size("rare") > 0)
    return joined_order(classes, counts, threshold)


def joined_order(classes: DataFrame, counts: DataFrame, threshold: float) -> DataFrame:
    """``ordered_words`` by a join of every word with its count."""
    each = classes.select("class_id", F.size("words").alias("size"), F.explode("words").alias("w"))
    kept = each.join(counts, "w").groupBy("class_id", "size").agg(F.array_sort(F.collect_list(F.struct("n", "w"))).alias("rare"))
    start = F.col("size") - F.size("rare")
    reach = F.col("size") - _least_shared(F.col("size"), threshold) + 2 - start
    rows = kept.select("class_id", "size", start.alias("start"), F.slice("rare", F.lit(1), F.greatest(F.lit(0), reach)).alias("rare")).filter(F.size("rare") > 0)
    return rows.join(classes.select("class_id", "words").mapInArrow(_prints, f"class_id long, {_FOLDS}"), "class_id")


def _ordered(counts_value, threshold: float):
    """A mapper from (class_id, words) to the rows of ``ordered_words``; ``counts_value`` gives words, sorted, and counts."""

    def run(batches):
        known, often = counts_value()
        for batch in batches:
            if not batch.num_rows:
                continue
            column = batch.column("words")
            size = np.asarray(column.value_lengths(), dtype=np.int64)
            offsets = np.concatenate([[0], np.cumsum(size)])
            flat = np.asarray(column.flatten(), dtype=np.int64)
            at = np.searchsorted(known, flat) if len(known) else np.zeros(len(flat), dtype=np.int64)
            n = np.where(known[np.minimum(at, len(known) - 1)] == flat, often[np.minimum(at, len(known) - 1)], 1) if len(known) else np.ones(len(flat), dtype=np.int64)
            row = np.repeat(np.arange(batch.num_rows), size)
            order = np.lexsort((flat, n, row))
            alone = np.bincount(row[n == 1], minlength=batch.num_rows)
            place = np.arange(len(flat)) - np.repeat(offsets[:-1], size)
            reach = size - np.ceil(threshold * size - 1e-9).astype(np.int64) + 2
            kept = order[(place >= alone[row]) & (place < reach[row])]
            ends = np.concatenate([[0], np.cumsum(np.bincount(row[kept], minlength=batch.num_rows))]).astype(np.int32)
            items = pa.StructArray.from_arrays([pa.array(n[kept]), pa.array(flat[kept])], ["n", "w"])
            prints = fingerprints(flat, offsets).view(np.int64)
            yield pa.RecordBatch.from_arrays([batch.column("class_id"), pa.array(size.astype(np.int32)), pa.array(alone.astype(np.int32)), pa.ListArray.from_arrays(pa.array(ends), items), *(pa.array(prints[:, k]) for k in range(FOLD))], ["class_id", "size", "start", "rare", *(f"f{k}" for k in range(FOLD))])

    return run


def shard_keys(ordered: DataFrame, threshold: float, *further: str) -> DataFrame:
    """(class_id, size, further..., shard, place, counted): the shards of every set; place is that of the shard's first word.

    ``counted`` marks shards that may have more than ``COMMON_TEXTS`` rows. A set so small that one shared word can be
    enough is in the shard of each common word too.
    """
    least = _least_shared(F.col("size"), threshold)
    kind = "array<struct<shard:bigint,place:int,counted:boolean>>"

    def keys(x: Column, i: Column) -> Column:
        place = (F.col("start") + i).cast("int")

        def shard(counted: Column, *words: Column) -> Column:
            return F.struct(F.xxhash64(*words).alias("shard"), place.alias("place"), counted.alias("counted"))

        rest = F.slice("rare", i + 2, F.greatest(F.lit(0), F.size("rare") - i - 1))
        single = F.when((x["n"] <= COMMON_TEXTS) | (least < 2), F.array(shard(x["n"] > COMMON_TEXTS, x["w"]))).otherwise(F.array().cast(kind))
        double = F.when(x["n"] > COMMON_TEXTS, F.transform(rest, lambda y: shard(F.lit(True), x["w"], y["w"]))).otherwise(F.array().cast(kind))
        return F.when(place > F.col("size") - least, F.array().cast(kind)).otherwise(F.concat(single, double))

    made = ordered.select("class_id", "size", *further, F.explode(F.flatten(F.transform("rare", keys))).alias("k"))
    return made.select("class_id", "size", *further, "k.shard", "k.place", "k.counted")


def fingerprints(flat: np.ndarray, offsets: np.ndarray) -> np.ndarray:
    """Parity folds of the word sets ``flat[offsets[i]:offsets[i + 1]]``; uint64, ``FOLD`` columns."""
    mixed = flat.astype(np.uint64) * np.uint64(0x9E3779B97F4A7C15)
    slot, bit = (mixed >> np.uint64(62)) % np.uint64(FOLD), (mixed >> np.uint64(50)) & np.uint64(63)
    out = np.zeros((len(offsets) - 1, FOLD), dtype=np.uint64)
    value = np.uint64(1) << bit
    for k in range(FOLD):
        part = np.where(slot == k, value, np.uint64(0))
        if len(part):
            out[:, k] = np.bitwise_xor.reduceat(part, offsets[:-1])
    return out


def _prints(batches):
    """(class_id, f0..) of (class_id, words)."""
    for batch in batches:
        if batch.num_rows:
            column = batch.column("words")
            offsets = np.concatenate([[0], np.cumsum(np.asarray(column.value_lengths(), dtype=np.int64))])
            found = fingerprints(np.asarray(column.flatten(), dtype=np.int64), offsets).view(np.int64)
            yield pa.RecordBatch.from_arrays([batch.column("class_id"), *(pa.array(found[:, k]) for k in range(FOLD))], ["class_id", *(f"f{k}" for k in range(FOLD))])


def distances(prints: np.ndarray, a: np.ndarray, b: np.ndarray) -> np.ndarray:
    """Hamming distances of the rows ``a`` to the rows ``b``, one by one."""
    out = np.bitwise_count(prints[a, 0] ^ prints[b, 0]).astype(np.int16)
    for k in range(1, prints.shape[1]):
        out += np.bitwise_count(prints[a, k] ^ prints[b, k])
    return out


def _ranges(starts: np.ndarray, counts: np.ndarray) -> np.ndarray:
    """starts[0], starts[0] + 1, ... counts[0] of them, then those of the next."""
    return np.repeat(starts - (np.cumsum(counts) - counts), counts) + np.arange(counts.sum())


def forest_pairs(prints: np.ndarray, sizes: np.ndarray, node: np.ndarray, threshold: float, places: np.ndarray | None = None, sides: np.ndarray | None = None, leaf_rows: int = LEAF_ROWS):
    """Yields index pairs (i, j, distances computed) of rows of one node whose fingerprints allow the threshold.

    ``node`` numbers the tree of every row, rising. All trees are walked together, level by level. With ``sides``, a
    truth value per row, only pairs of a true and a false row are sought. ``places``, where the shard's word stands in
    each row's order, rules out pairs that share too few words from there on.

    Of a pair the row of the larger size, of equals the later one, visits the tree as a guest, so a guest of size n
    finds its partners within floor(2 c n), c = (1 - t) / (1 + t); between sides every false row is a guest, and its
    partner may be larger, up to n / t.
    """
    share = (1 - threshold) / (1 + threshold)
    most = sizes if sides is None else np.floor(sizes / threshold + 1e-9)
    radius = np.floor(share * (sizes + most) + 1e-9).astype(np.int64)
    every = np.arange(len(node))
    rows, guests = (every, every) if sides is None else (every[sides], every[~sides])
    at, seat = node[rows].astype(np.int64), node[guests].astype(np.int64)
    work = 0
    while len(rows) and len(guests):
        names, first, at, count = np.unique(at, return_index=True, return_inverse=True, return_counts=True)
        own = np.searchsorted(names, seat)
        there = (own < len(names)) & (names[np.minimum(own, len(names) - 1)] == seat)
        guests, seat = guests[there], own[there]
        small = count <= leaf_rows
        home = np.flatnonzero(small[seat])
        for part in np.array_split(home, max(1, -(-int(count[seat[home]].sum()) // HELD_PAIRS))):
            if not len(part):
                continue
            g = np.repeat(guests[part], count[seat[part]])
            r = rows[_ranges(first[seat[part]], count[seat[part]])]
            if sides is None:
                due = (sizes[r] < sizes[g]) | ((sizes[r] == sizes[g]) & (r < g))
                g, r = g[due], r[due]
            due = np.minimum(sizes[g], sizes[r]) >= threshold * np.maximum(sizes[g], sizes[r]) - 1e-9
            if places is not None:
                due &= np.minimum(sizes[g] - places[g], sizes[r] - places[r]) >= threshold / (1 + threshold) * (sizes[g] + sizes[r]) - 1e-9
            g, r = g[due], r[due]
            near = distances(prints, g, r) <= np.floor(share * (sizes[g] + sizes[r]) + 1e-9)
            work += len(g)
            yield g[near], r[near], work
            work = 0
        stay, go = ~small[at], ~small[seat]
        rows, at, guests, seat = rows[stay], at[stay], guests[go], seat[go]
        if not len(rows):
            return
        vantage = np.full(len(names), -1)
        starts = np.flatnonzero(np.concatenate([[True], at[1:] != at[:-1]]))
        vantage[at[starts]] = rows[starts]
        to_rows, to_guests = distances(prints, rows, vantage[at]), distances(prints, guests, vantage[seat])
        work += len(rows) + len(guests)
        order = np.lexsort((to_rows, at))
        rows, at, to_rows = rows[order], at[order], to_rows[order]
        length = np.diff(np.concatenate([starts, [len(at)]]))
        middle, low, high = to_rows[starts + (length - 1) // 2], to_rows[starts], to_rows[starts + length - 1]
        middle = np.where(middle == high, middle - 1, middle)  # else no row would lie outside
        flat = low == high  # all at one distance: halve by place, every guest visits both
        segment = np.repeat(np.arange(len(starts)), length)
        outer = np.where(flat[segment], np.arange(len(at)) - starts[segment] >= length[segment] // 2, to_rows > middle[segment])
        place = np.zeros(len(names), dtype=np.int64)
        place[at[starts]] = np.arange(len(starts))
        sits = place[seat]
        inside = flat[sits] | (to_guests - radius[guests] <= middle[sits])
        outside = flat[sits] | (to_guests + radius[guests] > middle[sits])
        at = 2 * segment + outer
        order = np.argsort(at, kind="stable")
        rows, at = rows[order], at[order]
        seat = np.concatenate([2 * sits[inside], 2 * sits[outside] + 1])
        guests = np.concatenate([guests[inside], guests[outside]])


def _candidates(threshold: float):
    """Candidate pairs (a, b) of a stream of postings sorted by (shard, block); holds one stretch of shards at a time."""

    def pairs(rows: dict[str, np.ndarray], edges: np.ndarray):
        length = np.diff(edges)
        block = rows["block"][edges[:-1]]
        high = np.floor((np.sqrt(8.0 * block + 1) - 1) / 2).astype(np.int64)
        alone = high * (high + 1) // 2 + high == block  # rows of one part, or of a shard that isn't split
        for sided in (False, True):
            use = np.flatnonzero((length > 1) & (alone != sided))
            for part in np.array_split(use, max(1, -(-int(length[use].sum()) // (8 * BLOCK_ROWS)))):
                if not len(part):
                    continue
                run = _ranges(edges[:-1][part], length[part])
                own = np.repeat(np.arange(len(part)), length[part])
                prints, sizes, ids = rows["prints"][run], rows["size"][run].astype(np.int64), rows["class_id"][run]
                sides = rows["part"][run] == high[part][own] if sided else None
                for i, j, _ in forest_pairs(prints, sizes, own, threshold, rows["place"][run].astype(np.int64), sides):
                    if len(i):
                        yield np.minimum(ids[i], ids[j]), np.maximum(ids[i], ids[j])

    def run(batches):
        held: dict[str, np.ndarray] | None = None
        for batch in itertools.chain(batches, (None,)):
            if batch is not None:
                new = {c: np.asarray(batch.column(c)) for c in ("shard", "block", "part", "class_id", "size", "place")}
                new["prints"] = np.stack([np.asarray(batch.column(f"f{k}")).view(np.uint64) for k in range(FOLD)], axis=1)
                held = new if held is None else {c: np.concatenate([held[c], v]) for c, v in new.items()}
            if held is None or not len(held["shard"]):
                continue
            fresh = (held["shard"][1:] != held["shard"][:-1]) | (held["block"][1:] != held["block"][:-1])
            edges = np.concatenate([[0], np.flatnonzero(fresh) + 1, [len(held["shard"])]])
            edges = edges if batch is None else edges[:-1]  # the last run may go on in the next batch
            if len(edges) > 1:
                for a, b in pairs(held, edges):
                    both = np.unique(np.stack([a, b]), axis=1)
                    yield pa.RecordBatch.from_arrays([pa.array(both[0]), pa.array(both[1])], ["a", "b"])
                held = {c: v[edges[-1] :] for c, v in held.items()}

    return run


def class_links(classes: DataFrame, threshold: float) -> DataFrame:
    """(a, b, similarity): all pairs of classes, a < b, whose word sets reach the threshold."""
    folds = [f"f{k}" for k in range(FOLD)]
    ordered = cut_lineage(ordered_words(classes, threshold))
    large = shard_keys(ordered, threshold).filter("counted").groupBy("shard").agg(F.count("*").alias("rows")).filter(F.col("rows") > BLOCK_ROWS)
    parts = F.coalesce(F.ceil(F.col("rows") / BLOCK_ROWS), F.lit(1)).cast("int")
    rows = shard_keys(ordered, threshold, *folds).join(large, "shard", "left").withColumn("parts", parts).drop("rows", "counted")
    rows = rows.withColumn("part", F.pmod(F.xxhash64("class_id"), F.col("parts")).cast("int"))
    # a row of part p meets the rows of every other part once, in the block of the two parts
    low, high = F.least("part", "other"), F.greatest("part", "other")
    rows = rows.withColumn("other", F.explode(F.sequence(F.lit(0), F.col("parts") - 1)))
    rows = rows.withColumn("block", (high.cast("long") * (high + 1) / 2).cast("long") + low).drop("parts", "other")
    near = rows.repartition("shard", "block").sortWithinPartitions("shard", "block").mapInArrow(_candidates(threshold), "a long, b long").distinct()
    words = classes.select("class_id", "words")
    both = near.join(words.toDF("a", "words_a"), "a").join(words.toDF("b", "words_b"), "b")
    shared = F.size(F.array_intersect("words_a", "words_b"))
    similar = (shared / (F.size("words_a") + F.size("words_b") - shared)).alias("similarity")
    return both.select("a", "b", similar).filter(F.col("similarity") >= threshold)


def near_duplicate_groups(df: DataFrame, item: str, text: str, threshold: float) -> tuple[DataFrame, DataFrame, DataFrame]:
    """Members (item, class_id), classes (class_id, words, copies) and links (a, b, similarity) between classes.

    ``item`` is an integer column. Null and empty texts and texts without a letter are in no class; texts with equal
    word sets share the class named by their smallest item; a repeated item with the same text counts once. Ties at
    exactly the threshold are links. Other columns are ignored, whatever their names. An empty table gives empty
    results. The classes are written once to the checkpoint folder, since three later steps read them.
    """
    sets = word_sets(spread(df).select(F.col(item).cast("long").alias("item_"), F.col(text).alias("text_")), "item_", "text_")
    classes = cut_lineage(text_classes(sets))
    members = sets.select("item", "mark", "size_mark").distinct().join(classes.select("mark", "size_mark", "class_id"), ["mark", "size_mark"]).select("item", "class_id")
    sizes = members.groupBy("class_id").agg(F.count("*").alias("copies"))
    return members, classes.select("class_id", "words").join(sizes, "class_id"), class_links(classes.select("class_id", "words"), threshold)


def near_duplicate_pairs(df: DataFrame, item: str, text: str, threshold: float) -> DataFrame:
    """(item_a, item_b), item_a < item_b: every pair of rows whose similarity reaches the threshold, copies included.

    The result itself is quadratic in the copies of one text; ``near_duplicate_groups`` gives the same links without
    that expansion.
    """
    members, _, links = near_duplicate_groups(df, item, text, threshold)
    members = cut_lineage(members)
    ties = links.select("a", "b").unionByName(members.groupBy("class_id").count().filter("count > 1").select(F.col("class_id").alias("a"), F.col("class_id").alias("b")))
    left = members.select(F.col("item").alias("x"), F.col("class_id").alias("a"))
    right = members.select(F.col("item").alias("y"), F.col("class_id").alias("b"))
    both = ties.join(left, "a").join(right, "b").filter((F.col("a") != F.col("b")) | (F.col("x") < F.col("y")))
    return both.select(F.least("x", "y").alias("item_a"), F.greatest("x", "y").alias("item_b"))
