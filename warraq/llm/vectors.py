"""Near duplicates among embeddings by iterative quantisation and multi-index Hamming tables.

Codes: a bounded sample of distinct vectors (SAMPLE, by the order of their hashes) is
centred and projected on its principal axes; a rotation is learned that brings the
projections near the corners of a cube, by turns of rounding to signs and of solving for
the rotation, and each bit is cut at the sample's median, so that codes are balanced.
Every vector gets a code of 64 bits.

Tables: a code is split into substrings of ``width`` bits. A vector resides in one bucket
of each table and visits those that differ in one bit, from 0 to 1: two vectors whose
substrings differ in at most one bit meet exactly once in that table. A pair counts in
the first table that it meets in, and if its codes differ in at most a quarter of their
bits; both follow from the two codes, so that no list of pairs is made or compared. At a
cosine of 0.98 a bit differs with a chance of 0.064 and two vectors meet, in four tables
of 16 bits, with a chance of 0.99.

Reranking: first only codes are dealt to the buckets, and what has no partner there is
left out; the others' original vectors follow and decide in double precision. Tasks
return a number of links for each vector and the links of a forest, never all pairs. A
bucket of more than CELL vectors is split into blocks, and each pair of blocks is a place
of its own. Equal vectors of a label are one class throughout.

What meets in a bucket grows with the square of its members: labels of over some
millions of vectors want a greater ``width`` (22: three tables, a chance of 0.93).

Defined results: a vector that is null, empty, zero or holds a null or non-finite component,
and one without a label, is linked with nothing and is its own component; so are
vectors of different lengths to each other; null ids count as greater than others, and a
row is kept if its id is that of its component, rows of equal ids alike; an empty table
gives an empty table; other columns are ignored. Classes are known by 64-bit hashes.
``near_vectors`` runs jobs when it is called.
"""

from __future__ import annotations

from dataclasses import dataclass

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from .common import join_hot, lean, let_go, saved
from .components import connected_components

#: Vectors that the rotation is learned from, bits of a code, turns of learning.
SAMPLE, BITS, TURNS = 8192, 64, 50
#: Vectors of a block of a bucket; a larger bucket is split.
CELL = 4096
#: Rows of a place up to which many places are looked at together; it changes no result.
FEW = 32


@dataclass(frozen=True)
class Quantiser:
    """Bits are signs of ``(x - mean) @ axes - cuts`` for vectors x of length 1."""

    mean: np.ndarray
    axes: np.ndarray
    cuts: np.ndarray

    @property
    def bits(self) -> int:
        return len(self.cuts)

    def codes(self, x: np.ndarray) -> np.ndarray:
        """64-bit codes of rows of any length but 0; what is missing counts as 0, what is beyond the model's length not at all."""
        own = np.zeros((len(x), len(self.mean)))
        n = min(x.shape[1], len(self.mean))
        own[:, :n] = x[:, :n]
        signs = (own - self.mean) @ self.axes > self.cuts
        packed = np.packbits(signs, axis=1, bitorder="little")
        return np.pad(packed, ((0, 0), (0, 8 - packed.shape[1]))).view(np.uint64)[:, 0]


def unit(x: np.ndarray) -> np.ndarray:
    """Rows of length 1; large and small components neither overflow nor vanish."""
    x = x / np.abs(x).max(axis=1, keepdims=True)
    return x / np.linalg.norm(x, axis=1, keepdims=True)


def learn(x: np.ndarray, seed: int = 12) -> Quantiser:
    """The rotation of a sample of vectors of length 1; several, from different beginnings, where vectors have fewer than BITS components."""
    mean = x.mean(axis=0)
    centred = x - mean
    _, axes = np.linalg.eigh(centred.T @ centred)
    axes = axes[:, ::-1][:, :BITS]
    flat, found = centred @ axes, []
    for k in range(-(-BITS // axes.shape[1])):
        turn, _ = np.linalg.qr(np.random.default_rng(seed + k).standard_normal((axes.shape[1],) * 2))
        for _ in range(TURNS):
            left, _, right = np.linalg.svd(np.where(flat @ turn > 0, 1.0, -1.0).T @ flat)
            turn = (left @ right).T
        found.append(axes @ turn)
    axes = np.concatenate(found, axis=1)[:, :BITS]
    return Quantiser(mean, axes, np.median(centred @ axes, axis=0))


def _matrix(column: pa.Array) -> list[tuple[np.ndarray, np.ndarray]]:
    """(rows, vectors) of each length that a column of lists has."""
    sizes, flat = np.diff(column.offsets.to_numpy()), column.flatten().to_numpy(zero_copy_only=False)
    begin = np.concatenate([[0], np.cumsum(sizes)[:-1]])
    return [(rows, flat[begin[rows][:, None] + np.arange(n)]) for n in np.unique(sizes) for rows in [np.flatnonzero(sizes == n)]]


def _coded(model: Quantiser):
    @lean
    def run(batches):
        for batch in batches:
            codes = np.zeros(batch.num_rows, np.uint64)
            for rows, x in _matrix(batch.column(3)):
                codes[rows] = model.codes(unit(x))
            yield pa.RecordBatch.from_arrays([*(batch.column(k) for k in range(3)), pa.array(codes.view(np.int64))], ["vec_id", "class", "home", "code"])

    return run


def _groups(batches, columns: list[str]):
    """(place, codes, visitors, sides, columns) of each place; its rows follow each other."""
    place, parts = None, []
    for batch in batches:
        at = np.stack([batch.column(c).to_numpy() for c in ("home", "slot", "i", "j")], axis=1)
        edges = np.concatenate([[0], np.flatnonzero((at[1:] != at[:-1]).any(axis=1)) + 1, [len(at)]])
        for a, b in zip(edges[:-1].tolist(), edges[1:].tolist(), strict=True):
            if b > a:
                if tuple(at[a]) != place:
                    if parts:
                        yield place, parts
                    place, parts = tuple(at[a].tolist()), []
                parts.append([batch.column(c).slice(a, b - a) for c in columns])
    if parts:
        yield place, parts


def _strips(place, codes, visitors, left, width: int, most: int):
    """Rows of the left block, some at a time, and which of the right one each meets here for the first time."""
    rows, others = (np.flatnonzero(left), np.flatnonzero(~left)) if place[2] != place[3] else (np.arange(len(codes)),) * 2
    table, mask = place[1] >> width, np.uint64((1 << width) - 1)
    step = max(1, (1 << 20) // max(1, len(others)))
    for k in range(0, len(rows), step):
        some = rows[k : k + step]
        differ = codes[some][:, None] ^ codes[others][None, :]
        meet = ~(visitors[some][:, None] & visitors[others][None, :]) & (np.bitwise_count(differ) <= most)
        if place[2] == place[3]:
            meet &= some[:, None] < others[None, :]
        for t in range(table):
            meet &= np.bitwise_count((differ >> np.uint64(t * width)) & mask) > 1
        yield some, others, meet


def _whole(batches):
    """Batches that end where a place ends, and for each row the number of its place."""
    rest = None
    for batch in batches:
        if rest is not None:
            batch = pa.RecordBatch.from_arrays([pa.concat_arrays([x, y]) for x, y in zip(rest.columns, batch.columns, strict=True)], batch.schema.names)
        rest = None
        at = np.stack([batch.column(c).to_numpy() for c in ("home", "slot", "i", "j")], axis=1)
        number = np.cumsum(np.concatenate([[False], (at[1:] != at[:-1]).any(axis=1)])[: len(at)])
        cut = int(np.searchsorted(number, number[-1])) if len(at) else 0
        rest = batch.slice(cut)
        if cut:
            yield batch.slice(0, cut), at[:cut], number[:cut]
    if rest is not None and rest.num_rows:
        yield rest, np.stack([rest.column(c).to_numpy() for c in ("home", "slot", "i", "j")], axis=1), np.zeros(rest.num_rows, np.int64)


def _partners(width: int, most: int):
    """The rows that have a partner at their place by codes alone."""

    @lean
    def run(batches):
        mask = np.uint64((1 << width) - 1)
        for batch, at, number in _whole(batches):
            codes, visitors = batch.column("code").to_numpy().view(np.uint64), batch.column("visitor").to_numpy(zero_copy_only=False)
            blocks, tables = batch.column("block").to_numpy(), at[:, 1] >> width
            sizes = np.bincount(number)
            few, found = sizes[number] <= FEW, np.zeros(len(codes), bool)
            # of all places of few rows at once: each row with those that follow it at some distance
            for d in range(1, int(min(sizes.max(), FEW))):
                a = np.flatnonzero(few[:-d] & (number[:-d] == number[d:]) & ~(visitors[:-d] & visitors[d:]) & ((blocks[:-d] != blocks[d:]) | (at[:-d, 2] == at[:-d, 3])))
                differ = codes[a] ^ codes[a + d]
                near = np.bitwise_count(differ) <= most
                a, differ = a[near], differ[near]
                first = np.ones(len(a), bool)
                for t in range(int(tables[a].max(initial=0))):
                    first &= (t >= tables[a]) | (np.bitwise_count((differ >> np.uint64(t * width)) & mask) > 1)
                found[a[first]] = found[a[first] + d] = True
            begin = np.cumsum(sizes) - sizes
            for g in np.flatnonzero(sizes > FEW).tolist():
                k = slice(int(begin[g]), int(begin[g] + sizes[g]))
                place = tuple(at[k.start].tolist())
                here = np.zeros(sizes[g], bool)
                for some, others, meet in _strips(place, codes[k], visitors[k], blocks[k] == place[2], width, most):
                    here[some] |= meet.any(axis=1)
                    here[others] |= meet.any(axis=0)
                found[k] = here
            if found.any():
                yield pa.RecordBatch.from_arrays(batch.filter(pa.array(found)).columns, batch.schema.names)

    return run


def _links(threshold: float, width: int, most: int):
    """(a, b, n): for each class the rows of classes that it links to at a place (b null), and links that connect what is linked there (n null)."""

    @lean
    def run(batches):
        for place, parts in _groups(batches, ["class", "code", "visitor", "block", "copies", "vector"]):
            rows = [pa.concat_arrays(c) for c in zip(*parts, strict=True)]
            names, codes, copies = rows[0].to_numpy(), rows[1].to_numpy().view(np.uint64), rows[4].to_numpy()
            (_, x), = _matrix(rows[5])  # a home has one length
            x = unit(x)
            counts, roots = np.zeros(len(names), np.int64), np.arange(len(names))
            for some, others, meet in _strips(place, codes, rows[2].to_numpy(zero_copy_only=False), rows[3].to_numpy() == place[2], width, most):
                near = meet & (x[some] @ x[others].T >= threshold)
                counts[some] += near @ copies[others]
                counts[others] += copies[some] @ near
                for r in np.flatnonzero(near.any(axis=1)).tolist():
                    known = np.unique(np.append(roots[others[near[r]]], roots[some[r]]))
                    if len(known) > 1:
                        roots[np.isin(roots, known)] = known[0]
            linked, child = np.flatnonzero(counts), np.flatnonzero(roots != np.arange(len(names)))
            a = np.concatenate([names[linked], names[child]])
            b = pa.concat_arrays([pa.nulls(len(linked), pa.int64()), pa.array(names[roots[child]])])
            n = pa.concat_arrays([pa.array(counts[linked]), pa.nulls(len(child), pa.int64())])
            yield pa.RecordBatch.from_arrays([pa.array(a), b, n], ["a", "b", "n"])

    return run


def near_vectors(vectors: DataFrame, threshold: float = 0.98, width: int = 16, id_col: str = "vec_id", vector_col: str = "embedding", label_col: str = "label") -> DataFrame:
    """(vec_id, n_links, component_id, kept) of every row: vectors of a label are linked where their cosine reaches ``threshold``.

    ``n_links`` counts the other rows linked directly, ``component_id`` is the least id
    that links reach, and ``kept`` says whether it is the row's own.
    """
    spark = vectors.sparkSession
    source = vectors.select(F.col(f"`{id_col}`").alias("vec_id"), F.col(f"`{label_col}`").alias("label"), F.col(f"`{vector_col}`").cast("array<double>").alias("vector"))
    sound = F.forall("vector", lambda v: v.isNotNull() & ~F.isnan(v) & (F.abs(v) < float("inf"))) & F.exists("vector", lambda v: v != 0)
    valid = F.coalesce(F.col("label").isNotNull() & sound, F.lit(False))
    named = source.select("vec_id", F.when(valid, F.xxhash64("label", "vector")).alias("class"), F.xxhash64("label", F.size("vector")).alias("home"), "vector")
    usable = named.where(F.col("class").isNotNull())

    chosen = saved(usable.select("class").distinct().orderBy("class").limit(SAMPLE), "sample-keys")
    sample = usable.join(F.broadcast(chosen), "class", "left_semi").dropDuplicates(["class"]).select("vector").toArrow()["vector"].combine_chunks()  # at most SAMPLE vectors
    if not len(sample):
        return source.select("vec_id", F.lit(0).cast("bigint").alias("n_links"), F.col("vec_id").alias("component_id"), F.lit(True).alias("kept"))
    model = learn(unit(max(_matrix(sample.chunk(0) if isinstance(sample, pa.ChunkedArray) else sample), key=lambda g: len(g[0]))[1]))

    kind = source.schema["vec_id"].dataType.simpleString()
    coded = saved(usable.select("vec_id", "class", "home", "vector").mapInArrow(_coded(model), f"vec_id {kind}, class bigint, home bigint, code bigint"), "codes")
    classes = saved(coded.groupBy("class").agg(F.first("home").alias("home"), F.first("code").alias("code"), F.count("*").alias("copies")), "vector-classes")

    slots = []
    for t in range(-(-model.bits // width)):
        low = t * width
        part = F.shiftrightunsigned("code", low).bitwiseAND((1 << min(width, model.bits - low)) - 1)
        visited = [F.when(part.bitwiseAND(1 << k) == 0, F.struct((part + (1 << k) + (t << width)).cast("int").alias("slot"), F.lit(True).alias("visitor"))) for k in range(min(width, model.bits - low))]
        slots += [F.struct((part + (t << width)).cast("int").alias("slot"), F.lit(False).alias("visitor")), *visited]
    keyed = classes.select("class", "code", "home", F.inline(F.filter(F.array(*slots), lambda s: s.isNotNull())))
    full = keyed.groupBy("home", "slot").agg(F.count("*").alias("m")).where(F.col("m") > CELL).select("home", "slot", F.ceil(F.col("m") / CELL).cast("int").alias("cells"))
    keyed = keyed.join(saved(full, "full-buckets"), ["home", "slot"], "left").withColumn("cells", F.coalesce("cells", F.lit(1)))
    keyed = keyed.withColumn("block", F.pmod(F.xxhash64("class", F.lit(1)), F.col("cells")).cast("int")).withColumn("o", F.explode(F.sequence(F.lit(0), F.col("cells") - 1)))
    keyed = keyed.select("home", F.col("slot").cast("int").alias("slot"), F.least("block", "o").alias("i"), F.greatest("block", "o").alias("j"), "class", "code", "visitor", "block")
    where, most = ["home", "slot", "i", "j"], model.bits // 4
    met = saved(keyed.repartition(*where).sortWithinPartitions(*where).mapInArrow(_partners(width, most), "home bigint, slot int, i int, j int, class bigint, code bigint, visitor boolean, block int"), "partners")

    wanted = saved(met.select("class").distinct(), "near-classes")
    originals = usable.join(wanted, "class", "left_semi").groupBy("class").agg(F.first("vector").alias("vector"))
    # a class is sent to all its places, so that its vector is joined from the side of few rows
    sent = met.join(classes.select("class", "copies"), "class").join(originals, "class")
    links = saved(sent.repartition(*where).sortWithinPartitions(*where).mapInArrow(_links(threshold, width, most), "a bigint, b bigint, n bigint"), "vector-links")
    roots = connected_components(links.where("b is not null").select("a", "b"))
    degree = links.where("b is null").groupBy("a").agg(F.sum("n").alias("n")).withColumnRenamed("a", "class")

    facts = classes.select("class", "copies").join(degree, "class", "left").join(roots.withColumnRenamed("node", "class"), "class", "left")
    facts = facts.select("class", (F.coalesce("n", F.lit(0)) + F.col("copies") - 1).alias("n_links"), F.coalesce("root", "class").alias("root"))
    linked = saved(join_hot(coded.select("vec_id", "class"), saved(facts, "vector-facts"), "class", "inner").select("vec_id", "n_links", "root"), "linked")
    least = linked.groupBy("root").agg(F.min("vec_id").alias("component_id"))
    judged = join_hot(linked, least, "root", "inner").select("vec_id", "n_links", "component_id", F.col("vec_id").eqNullSafe(F.col("component_id")).alias("kept"))
    alone = named.where(F.col("class").isNull()).select("vec_id", F.lit(0).cast("bigint").alias("n_links"), F.col("vec_id").alias("component_id"), F.lit(True).alias("kept"))
    let_go(met, links)
    return judged.unionByName(alone)
