"""Similarity join of documents on their word shingles by prefix trees.

Two sets of at most n shingles whose Jaccard similarity reaches the threshold differ
in at most h shingles, a small part of n. Shingles are dealt by their hash to k
buckets, k > h, so that at least k - h buckets hold the same shingles in both sets:
sets meet where a bucket is the same, under the least class that holds it. A bucket has
several shingles, so that unlike sets do not meet by chance, however many there are
(single shingles of a growing corpus are shared by ever more of them). Buckets of
fewer than WEAK shingles are no meeting places; a set that has at most h others
is dealt again in another way, after SALTS ways by single shingles. If one of two
similar sets has more than h, a bucket that both share is among them; if neither has,
both are dealt again: no link is lost. A set of more than h goes to its first h + 1
alone: before the first bucket that both share each set has only buckets that differ,
of which there are h at most.

Where sets meet, they are put in one global order, frequent shingles last, and stored
in a trie, which each probes: a path is walked once for all sets that share it, and a
subtree is left as soon as the lengths that remain cannot make up for the misses.
Equal sets are one class throughout. The links give connected components.

A meeting place of more than ``CELL`` classes is split into blocks, and each pair
of blocks is a place of its own: no link is lost and no task holds more than two
blocks.

Defined results: a null text is empty; a text without words has no shingles, is
linked with nothing and is its own component; a text of fewer words than a shingle
has one shingle of all its words; rows of equal id and text are one document in
several rows; an empty table gives an empty table; other columns are ignored.
Shingles and sets are known by 64-bit hashes.
"""

from __future__ import annotations

from bisect import bisect_left, bisect_right
from math import exp, sqrt

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import Window as W
from pyspark.sql import functions as F

from .common import HOT, binary, if_small, join_hot, lean, saved, shuffle_partitions, slices, tidy
from .components import connected_components

#: Classes of a block of sets of up to LENGTH shingles; a place of more, or of longer sets, is split.
CELL, LENGTH = 192, 1000
#: Buckets of fewer shingles are no meeting places; ways to deal out shingles before they stand alone.
WEAK, SALTS = 2, 4
#: Rows of places that one task sorts.
SORTED = 4_000_000
#: Lengths of a band of sets, which share a number of buckets, differ by less than this factor.
WIDE = 1.3
#: Keys of near copies (8 bytes each) that are broadcast to take their rows out, or to find their texts; beyond that the rows are shuffled.
SMALL = 1_000_000
#: Bound of the list of frequent shingles (16 bytes each); any list gives the same links.
FREQUENT = 1 << 18
MIX = np.uint64(0x9E3779B97F4A7C15)


def word_hashes(texts: list[bytes]) -> tuple[np.ndarray, np.ndarray]:
    """64-bit hashes of all words (A-Z lower-cased) and how many each text has."""
    from xxhash import xxh3_64_intdigest

    words = [t.lower().split() for t in texts]
    counts = np.fromiter(map(len, words), np.int64, len(words))
    flat = [w for some in words for w in some]
    return np.fromiter(map(xxh3_64_intdigest, flat), np.uint64, len(flat)), counts


def shingle_sets(texts: list[bytes], size: int) -> list[np.ndarray]:
    """The distinct shingles of each text as ascending 64-bit hashes, some texts at a time."""
    out, begin, total = [], 0, 0
    for k, t in enumerate(texts):
        total += len(t)
        if total >= 1 << 20 or k == len(texts) - 1:
            out += _shingle_sets(texts[begin : k + 1], size)
            begin, total = k + 1, 0
    return out


def _shingle_sets(texts: list[bytes], size: int) -> list[np.ndarray]:
    hashes, counts = word_hashes(texts)
    rolled = hashes.copy()
    for k in range(1, size):
        if len(hashes) > k:
            rolled[:-k] = (rolled[:-k] * MIX + hashes[k:]) ^ (rolled[:-k] >> np.uint64(31))
    out, begin = [], 0
    for n in counts.tolist():
        if n >= size:
            out.append(np.unique(rolled[begin : begin + n - size + 1]))
        elif n:
            own = hashes[begin : begin + n]
            whole = np.uint64(n)
            for h in own:
                whole = (whole * MIX + h) ^ (whole >> np.uint64(31))
            out.append(np.asarray([whole], np.uint64))
        else:
            out.append(np.zeros(0, np.uint64))
        begin += n
    return out


def class_of(shingles: np.ndarray) -> int:
    """A signed 64-bit name of a set."""
    from xxhash import xxh3_64_intdigest

    value = xxh3_64_intdigest(shingles.tobytes())
    return value - (1 << 64) if value >= 1 << 63 else value


class Order:
    """The global order of shingles: those of the frequent list by its ranks after all others, which go by hash."""

    def __init__(self, frequent: list[int]):
        """``frequent``: signed hashes, the rarest first."""
        hashes = np.asarray(frequent, np.int64).view(np.uint64)
        by_hash = np.argsort(hashes)
        self.hashes, self.ranks = hashes[by_hash], by_hash.astype(np.int64)

    def split(self, shingles: np.ndarray) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
        """The shingles that are not frequent, the frequent ones in order, and their ranks."""
        if not len(self.hashes):
            return shingles, shingles[:0], np.zeros(0, np.int64)
        at = np.minimum(np.searchsorted(self.hashes, shingles), len(self.hashes) - 1)
        known = self.hashes[at] == shingles
        ranks = self.ranks[at[known]]
        order = np.argsort(ranks)
        return shingles[~known], shingles[known][order], ranks[order]

    def keys(self, shingles: np.ndarray) -> list[int]:
        """Numbers that ascend in the global order, one for each shingle."""
        rare, _, ranks = self.split(shingles)
        return rare.tolist() + [(1 << 64) + r for r in ranks.tolist()]


def mixed(h: np.ndarray) -> np.ndarray:
    h = (h ^ (h >> np.uint64(32))) * np.uint64(0xD6E8FEB86659FD93)
    return h ^ (h >> np.uint64(29))


def times_mix(n: int) -> np.uint64:
    return np.uint64(n * int(MIX) & (1 << 64) - 1)


class Buckets:
    """Where sets meet whose Jaccard similarity is at least num / den: in the band of the longer, by equal buckets."""

    def __init__(self, num: int, den: int):
        self.num, self.den, self.bounds, self.known = num, den, [1], {}
        while self.bounds[-1] < 1 << 40:
            self.bounds.append(max(self.bounds[-1] + 1, int(self.bounds[-1] * WIDE)))
        #: where sets may differ in a large part, buckets are small
        self.weak = WEAK if 8 * (den - num) <= den else 1

    def bands(self, n: int) -> range:
        """The bands in which a set of ``n`` shingles may meet others, its own first."""
        return range(bisect_right(self.bounds, n) - 1, bisect_right(self.bounds, n * self.den // self.num))

    def sizes(self, band: int) -> tuple[int, int]:
        """In how many shingles similar sets of a band differ at most, and the number of buckets (0: each shingle by itself)."""
        if band not in self.known:
            least, most = self.bounds[band], self.bounds[band + 1] - 1
            h = (self.den - self.num) * 2 * most // (self.den + self.num)
            k = h + 1
            while k <= least:
                mean = least / k
                weak = exp(-mean) * (1 + mean * (self.weak > 1))
                # most sets have more than h buckets that are not weak
                if k * (1 - weak) - 0.85 * sqrt(k * weak * (1 - weak)) >= h + 0.5:
                    break
                k += 1 + k // 100
            self.known[band] = h, k if k <= least else 0
        return self.known[band]

    def apart(self, n: int, band: int) -> int:
        """In how many shingles a set of ``n`` differs at most from a similar one that it meets in a band."""
        most = min(self.bounds[band + 1] - 1, n * self.den // self.num)
        return (self.den - self.num) * (n + most) // (self.den + self.num)

    def names(self, shingles: np.ndarray, band: int) -> np.ndarray:
        """64-bit names of the places of a band to which a set (ascending hashes) goes."""
        k, h = self.sizes(band)[1], self.apart(len(shingles), band)
        if not h:  # equal sets are one class
            return shingles[:0]
        out = []
        for salt in range(SALTS if k else 0):
            own = times_mix(band * (SALTS + 1) + salt + 1)
            dealt = np.sort(mixed(shingles ^ times_mix(salt))) if salt else shingles
            bucket = ((dealt >> np.uint64(32)) * np.uint64(k)) >> np.uint64(32)
            begin = np.concatenate([[0], np.flatnonzero(bucket[1:] != bucket[:-1]) + 1])
            strong = np.diff(begin, append=len(dealt)) >= self.weak
            names = mixed((np.add.reduceat(mixed(dealt), begin) ^ own) + bucket[begin] * MIX)
            out.append(names[strong][: h + 1])
            if len(out[-1]) > h:
                return np.concatenate(out)
        return np.concatenate([*out, mixed(mixed(shingles) ^ times_mix(band * (SALTS + 1)))])


class Node:
    __slots__ = ("run", "children", "least", "most", "sets")

    def __init__(self, run: tuple, least: int, most: int):
        self.run, self.children, self.least, self.most, self.sets = run, {}, least, most, []


class PrefixTree:
    """A compressed trie of ascending number sequences, joined by Jaccard similarity of at least num / den."""

    def __init__(self, num: int, den: int):
        self.root, self.num, self.den = Node((), 1 << 60, 0), num, den

    def insert(self, keys: tuple, name) -> None:
        n, at, node = len(keys), 0, self.root
        while True:
            node.least, node.most = min(node.least, n), max(node.most, n)
            if at == n:
                node.sets.append(name)
                return
            child = node.children.get(keys[at])
            if child is None:
                leaf = Node(keys[at:], n, n)
                leaf.sets.append(name)
                node.children[keys[at]] = leaf
                return
            run, k = child.run, 1
            while k < len(run) and at + k < n and run[k] == keys[at + k]:
                k += 1
            if k < len(run):
                middle = Node(run[:k], child.least, child.most)
                child.run = run[k:]
                middle.children[run[k]] = child
                node.children[keys[at]] = middle
                child = middle
            at, node = at + k, child

    def probe(self, keys: tuple, skip) -> list:
        """Names of the stored sets that are similar to ``keys``; ``skip(names)`` says that none of them is of interest."""
        nx, members = len(keys), frozenset(keys)
        close, far = self.den - self.num, self.den + self.num
        found, stack = [], [(self.root, 0, 0, 0)]
        while stack:
            node, j, shared, depth = stack.pop()
            run = node.run
            if not node.children:
                # a single sequence: its overlap at once
                if not skip(node.sets):
                    shared += sum(map(members.__contains__, run))
                    ny = depth + len(run)
                    if far * (nx + ny - 2 * shared) <= close * (nx + ny):
                        found += node.sets
                continue
            alive = True
            for t in run:
                j = bisect_left(keys, t, j)
                depth += 1
                if j < nx and keys[j] == t:
                    shared += 1
                    j += 1
                    continue
                # misses so far, and those that the lengths that remain make certain
                x_left = nx - j
                certain = max(0, x_left - (node.most - depth), (node.least - depth) - x_left)
                if far * (depth + j - 2 * shared + certain) > close * (nx + node.most):
                    alive = False
                    break
            if not alive:
                continue
            if node.sets and not skip(node.sets) and far * (nx + depth - 2 * shared) <= close * (nx + depth):
                found += node.sets
            stack += [(child, j, shared, depth) for child in node.children.values()]
        return found


def forest(left: list[tuple], right: list[tuple] | None, num: int, den: int) -> list[tuple]:
    """Links that connect what is similar among (name, keys) of ``left``, or between ``left`` and ``right``.

    A pair already connected by others is passed over; each group is given as links
    from its least name to the others.
    """
    up: dict = {}

    def find(x):
        while (y := up.setdefault(x, x)) != x:
            up[x] = up[y]
            x = up[x]
        return x

    tree = PrefixTree(num, den)

    def probe(name, keys):
        for other in tree.probe(keys, lambda names: all(find(o) == find(name) for o in names)):
            a, b = find(other), find(name)
            up[max(a, b)] = min(a, b)

    for name, keys in left:
        if right is None:
            probe(name, keys)
        tree.insert(keys, name)
    for name, keys in right or ():
        probe(name, keys)
    return [(root, name) for name in list(up) if (root := find(name)) != name]


def _describe(size: int):
    """kind 0: (row_key, doc_id, class, number of shingles) of each row; kind 1: (shingle, count) where many texts of a slice share it."""

    @lean
    def run(batches):
        for batch in batches:
            for i, j in slices(batch.column(2), 8 << 20):
                sets = shingle_sets(binary(batch.column(2).slice(i, j - i)), size)
                n = j - i
                names = ["kind", "row_key", "doc_id", "class", "n"]
                counts = pa.array([len(s) for s in sets], pa.int64())
                own = [batch.column(0).slice(i, n), batch.column(1).slice(i, n)]
                yield pa.RecordBatch.from_arrays([pa.array([0] * n, pa.int8()), *own, pa.array([class_of(s) if len(s) else 0 for s in sets], pa.int64()), counts], names)
                values, count = np.unique(np.concatenate([*sets, np.zeros(0, np.uint64)]), return_counts=True)
                often = np.flatnonzero(count >= 4)
                if len(often):
                    m = len(often)
                    yield pa.RecordBatch.from_arrays([pa.array([1] * m, pa.int8()), pa.array([0] * m, pa.int64()), pa.nulls(m, batch.column(1).type), pa.array(values[often].view(np.int64)), pa.array(count[often].astype(np.int64))], names)

    return run


def _places(size: int, num: int, den: int):
    """(place, class, band, own) of each set, each class once a task; ``own``: the set's length is of the band."""

    @lean
    def run(batches):
        buckets, seen = Buckets(num, den), set()
        for batch in batches:
            for i, j in slices(batch.column(0), 4 << 20):
                parts, facts = [], []
                for s in shingle_sets(binary(batch.column(0).slice(i, j - i)), size):
                    if len(s) and (name := class_of(s)) not in seen:
                        seen.add(name)
                        bands = buckets.bands(len(s))
                        for band in bands:
                            parts.append(buckets.names(s, band))
                            facts.append((name, band, band == bands[0]))
                if parts:
                    count = np.fromiter(map(len, parts), np.int64, len(parts))
                    names, bands, own = (np.repeat(np.asarray(x, t), count) for x, t in zip(zip(*facts, strict=True), (np.int64, np.int16, bool), strict=True))
                    yield pa.RecordBatch.from_arrays([pa.array(np.concatenate(parts).view(np.int64)), pa.array(names), pa.array(bands), pa.array(own)], ["place", "class", "band", "own"])

    return run


def _meet(size: int, num: int, den: int, frequent):
    """(a, b): links found at each place; the rows of a place follow each other."""

    @lean
    def run(batches):
        order = Order(frequent.value)
        place, left, right, links = None, {}, {}, []

        def close():
            if left and (right or place[3] == place[4]):
                links.extend(forest(sorted(left.items()), None if place[3] == place[4] else sorted(right.items()), num, den))

        def out():
            a, b = zip(*links, strict=True) if links else ((), ())
            return pa.RecordBatch.from_arrays([pa.array(a, pa.int64()), pa.array(b, pa.int64())], ["a", "b"])

        for batch in (b.slice(k, 512) for b in batches for k in range(0, b.num_rows, 512)):
            places = list(zip(*(batch.column(c).to_pylist() for c in ("pivot", "band", "cells", "i", "j")), strict=True))
            blocks, names = batch.column("block").to_pylist(), batch.column("class").to_pylist()
            texts = binary(batch.column("text"))
            for k, at in enumerate(places):
                if at != place:
                    close()
                    place, left, right = at, {}, {}
                side = left if blocks[k] == at[3] else right
                if names[k] not in side:
                    side[names[k]] = tuple(order.keys(shingle_sets([texts[k]], size)[0]))
            if len(links) > 10_000:
                yield out()
                links.clear()
        if place:
            close()
        yield out()

    return run


def _linked(docs: DataFrame, size: int, num: int, den: int, id_col: str, text_col: str) -> DataFrame:
    """(row_key, doc_id, n, root) of every row: its number of shingles and the name of its component (of no meaning where n is 0)."""
    spark = docs.sparkSession
    text = F.coalesce(F.col(f"`{text_col}`"), F.lit(""))
    key = F.xxhash64(F.col(f"`{id_col}`"), text).alias("row_key")
    texts = docs.select(key, F.col(f"`{id_col}`").alias("doc_id"), text.alias("text"))
    kind = docs.schema[id_col].dataType.simpleString()
    described = saved(texts.mapInArrow(_describe(size), f"kind tinyint, row_key bigint, doc_id {kind}, class bigint, n bigint"), "shingles")
    often = described.where("kind = 1").groupBy("class").agg(F.sum("n").alias("n")).orderBy(F.desc("n"), "class").limit(FREQUENT)
    frequent = spark.sparkContext.broadcast([r["class"] for r in often.select("class").collect()][::-1])
    rows = described.where("kind = 0")
    classes = rows.where("n > 0").groupBy("class").agg(F.min(F.struct("doc_id", "row_key")).alias("o"), F.first("n").alias("n")).select("class", "n", "o.row_key")

    placed = texts.select("text").mapInArrow(_places(size, num, den), "place bigint, class bigint, band smallint, own boolean")
    # few sets but those of a component share a place, so that one task can hold it
    alike = W.partitionBy("place")
    # a set has places for about half of its shingles; a task's share is sorted in memory
    total = rows.agg(F.sum("n")).first()[0] or 0
    placed = placed.repartition(max(shuffle_partitions(spark), total // (2 * SORTED) + 1), "place")
    shared = placed.select("class", "band", "own", F.min("class").over(alike).alias("pivot"), F.max("class").over(alike).alias("last"), F.max("own").over(alike).alias("longer"))
    met = shared.where("pivot <> last and longer").groupBy("class", "pivot", "band").agg(F.max("own").cast("int").alias("own")).join(classes, "class")
    met = saved(met.select("class", "pivot", "row_key", "n", "band", "own"), "meetings")
    tidy(spark)
    places = met.groupBy("pivot", "band").agg(F.count("*").alias("m"), F.sum("own").alias("own"), F.avg("n").alias("n")).where("m > 1 and own > 0")
    places = saved(places.select("pivot", "band", "m", F.ceil(F.col("m") * F.greatest(F.lit(1.0), F.col("n") / LENGTH) / CELL).cast("int").alias("cells")), "meeting-places")
    met = join_hot(met, places.drop("m"), ["pivot", "band"], "inner", places.where(F.col("m") > HOT).select("pivot", "band")).withColumn("block", F.pmod(F.xxhash64("class"), F.col("cells")).cast("int"))
    wanted = met.groupBy("row_key", "class").agg(F.collect_list(F.struct("pivot", "band", "cells", "block")).alias("places"))
    keys = saved(met.select("row_key").distinct(), "near-rows")
    near = texts.select("row_key", "text").join(if_small(keys, keys.count(), SMALL), "row_key", "left_semi")
    sent = near.join(wanted, "row_key").select("class", "text", F.inline("places"))
    other = F.explode(F.sequence(F.lit(0), F.col("cells") - 1))
    sent = sent.select("*", other.alias("o")).select("class", "text", "pivot", "band", "cells", "block", F.least("block", "o").alias("i"), F.greatest("block", "o").alias("j"))
    where = ["pivot", "band", "cells", "i", "j"]
    links = sent.repartition(*where).sortWithinPartitions(*where).mapInArrow(_meet(size, num, den, frequent), "a bigint, b bigint")
    roots = connected_components(saved(links, "near-links"))

    named = join_hot(rows, roots.select(F.col("node").alias("class"), "root"), "class", "left")
    named = saved(named.withColumn("root", F.coalesce("root", "class")).select("row_key", "doc_id", "n", "root"), "near-classes")
    tidy(spark)
    return named


def near_duplicates(docs: DataFrame, size: int = 5, num: int = 8, den: int = 10, id_col: str = "doc_id", text_col: str = "text") -> DataFrame:
    """(row_key, doc_id, n_shingles, component_id) of every row; texts are linked at a Jaccard similarity of at least num / den.

    ``component_id`` is the least id that links reach, the document's own included.
    """
    named = _linked(docs, size, num, den, id_col, text_col)
    least = named.where("n > 0").groupBy("root").agg(F.min("doc_id").alias("least"))
    return join_hot(named, least, "root", "left").select("row_key", "doc_id", F.col("n").alias("n_shingles"), F.when(F.col("n") > 0, F.col("least")).otherwise(F.col("doc_id")).alias("component_id"))


def keep_one(docs: DataFrame, size: int = 5, num: int = 8, den: int = 10, id_col: str = "doc_id", text_col: str = "text") -> DataFrame:
    """``docs`` with one row of each component, all columns as they are: that of the least id (null ids last), then of the least row_key.

    Rows of equal id and text are told apart by nothing: any one of them stays. Texts
    without words are linked with nothing and all stay.
    """
    named = _linked(docs, size, num, den, id_col, text_col).where("n > 0")
    order = F.struct(F.col("doc_id").isNull().alias("none"), "doc_id", "row_key")
    least = named.groupBy("root").agg(F.min(order).alias("o")).select("root", F.col("o.row_key").alias("least"))
    judged = join_hot(named, least, "root", "inner").groupBy("row_key").agg(F.max(F.col("row_key") == F.col("least")).alias("stays"), F.count("*").alias("copies"))
    # what goes, and the survivors that stand in several rows
    changed = saved(judged.where("not stays or copies > 1").select("row_key", "stays"), "near-copies")
    text = F.coalesce(F.col(f"`{text_col}`"), F.lit(""))
    rows = docs.select(F.xxhash64(F.col(f"`{id_col}`"), text).alias("row_key"), F.struct(*(F.col(f"`{c}`") for c in docs.columns)).alias("row"))
    kept = rows.join(if_small(changed.select("row_key"), changed.count(), SMALL), "row_key", "left_anti").select("row")
    again = changed.where("stays").select("row_key")
    if n := again.count():
        once = rows.join(if_small(again, n, SMALL), "row_key", "left_semi").groupBy("row_key").agg(F.first("row").alias("row"))
        kept = kept.unionByName(once.select("row"))
    return kept.select("row.*")
