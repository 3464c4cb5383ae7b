"""Near-duplicate vectors by an epsilon grid order join.

Equal vectors are one class and enter the join once, with their number. Classes are sorted by the cells of a grid on their
leading principal directions; the sorted sequence is cut into blocks, and intervals of it are joined recursively: from a tree
over the sequence, only pairs of intervals whose boxes are within reach go on to their parts. The recursion is level by level,
as joins of tables, down to pairs of blocks. Pairs of blocks are dealt in squares, so that a block travels once for each square and
not for each pair. Squares grow with the table, SIDES on each side of it, until their blocks fill a task's memory: until then a block
travels SIDES times at most, however many there are. Squares run in waves, of which only one's shuffle files are on disk. In a task
the recursion goes on to strips of a block, and strips that are within reach are compared as a product of two matrices. Of the links
in a square it returns a count for each class and a spanning forest, never the pairs.

Boxes have the leading directions and, as one coordinate more, the length of what these leave out: the distance over those
is never more than the real one, so no link is skipped.
"""

from __future__ import annotations

import functools
import hashlib
from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark import TaskContext
from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

from ._scratch import Scratch, connected_components

#: Classes in a block and in a strip of it, leading directions of the grid, rows of which the directions are fitted, parts of an
#: interval.
BLOCK, STRIP, DIRECTIONS, FIT_ROWS, FAN = 512, 64, 16, 20_000, 8
#: Squares on a side of the table while it is small; bytes of vectors on a side of a square, and of a batch of blocks on their way to
#: a task; bytes that a wave of squares may shuffle, or so many times all vectors if that is more.
SIDES, SIDE_BYTES, BATCH_BYTES, WAVE_BYTES, WAVE_COPIES = 12, 32 << 20, 8 << 20, 1 << 30, 4
#: Links of a square that wait until they are folded into its forest.
WAITING = 1 << 20


def _unit(batch: pa.RecordBatch, at: int) -> tuple[np.ndarray, np.ndarray]:
    """Rows with a usable vector, and these vectors at length one in double precision (ragged ones are padded by zeros)."""
    col = batch.column(at)
    flat = np.asarray(col.flatten().cast(pa.float64()).fill_null(np.nan))
    n = np.asarray(col.value_lengths().fill_null(0)).astype(np.int64)
    width = int(n.max()) if len(n) else 0
    m = np.zeros((len(n), max(1, width)))
    inside = np.arange(max(1, width))[None, :] < n[:, None]
    m[inside] = flat
    with np.errstate(over="ignore", invalid="ignore"):
        top = np.abs(m).max(axis=1, keepdims=True)
        m = m / np.where(top > 0, top, 1)
        norm = np.sqrt((m * m).sum(axis=1))
    good = np.flatnonzero(np.isfinite(norm) & (norm > 0) & np.isfinite(top[:, 0]))
    return good, m[good] / norm[good, None]


def directions(vectors: DataFrame, vector: str, rows: int = FIT_ROWS, k: int = DIRECTIONS) -> np.ndarray:
    """Leading principal directions, fitted on the driver on a bounded number of rows: they order the search and decide nothing."""
    some = vectors.select(vector).where(F.col(vector).isNotNull()).limit(rows).toArrow().combine_chunks()
    units = [_unit(b, 0)[1] for b in some.to_batches()]
    width = max([u.shape[1] for u in units], default=1)
    x = np.vstack([np.pad(u, ((0, 0), (0, width - u.shape[1]))) for u in units]) if units else np.zeros((0, 1))
    if not len(x):
        return np.zeros((1, 1))
    _, basis = np.linalg.eigh(x.T @ x)
    return basis[:, ::-1][:, :k]


def _project(u: np.ndarray, basis: np.ndarray) -> np.ndarray:
    """Coordinates in the leading directions, and the length of the rest."""
    n = min(u.shape[1], basis.shape[0])
    p = u[:, :n] @ basis[:n]
    return np.column_stack([p, np.sqrt(np.maximum(0, (u * u).sum(axis=1) - (p * p).sum(axis=1)))])


def _placer(basis: np.ndarray, side: float):
    """Every row's id, with the name of its vector, the vector at length one and the cells of the grid that it lies in; nulls where
    a vector links with nothing. Trailing zeros don't count: a vector that ends in them is that without them."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            for lo in range(0, batch.num_rows, 2048):
                part = batch.slice(lo, 2048)
                good, u = _unit(part, 1)
                cells = np.clip(np.floor(_project(u, basis)[:, :-1] / side).astype(np.int64) + 128, 0, 255).astype(np.uint8)
                name, cell, unit = ([None] * part.num_rows for _ in range(3))
                for i, c, x in zip(good.tolist(), cells, u, strict=True):
                    unit[i] = np.trim_zeros(x, "b").tobytes()
                    name[i], cell[i] = hashlib.blake2b(unit[i], digest_size=16).digest(), c.tobytes()
                yield pa.RecordBatch.from_arrays([part.column(0), pa.array(name, pa.binary()), pa.array(cell, pa.binary()), pa.array(unit, pa.binary())], ["vec_id", "name", "cell", "unit"])

    return run


def _matrix(units: list[bytes]) -> np.ndarray:
    m = np.zeros((len(units), max(len(x) for x in units) // 8))
    for i, x in enumerate(units):
        m[i, : len(x) // 8] = np.frombuffer(x)
    return m


def _blocks(basis: np.ndarray, rows: int):
    """Intervals of the sorted sequence, numbered within their partition: names, numbers of copies, unit vectors as one matrix, box."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        part, at, held = TaskContext.get().partitionId(), 0, []

        def cut(k: int) -> pa.RecordBatch:
            nonlocal at
            m = _matrix([x for _, _, x in held[:k]])
            p = _project(m, basis)
            cols = [pa.array([part], pa.int32()), pa.array([at], pa.int64()), pa.array([[x for x, _, _ in held[:k]]], pa.list_(pa.binary())), pa.array([[x for _, x, _ in held[:k]]], pa.list_(pa.int64())), pa.array([m.tobytes()], pa.binary())]
            cols += [pa.array([f(axis=0).tolist()], pa.list_(pa.float64())) for f in (p.min, p.max)]
            at += 1
            del held[:k]
            return pa.RecordBatch.from_arrays(cols, ["part", "i", "names", "copies", "units", "lo", "hi"])

        for batch in batches:
            held += zip(*(c.to_pylist() for c in batch.columns), strict=True)
            while len(held) >= rows:
                yield cut(rows)
        if held:
            yield cut(len(held))

    return run


def _roots(n: int, a: np.ndarray, b: np.ndarray) -> np.ndarray:
    """The least node of each node's component, for links a-b among n nodes."""
    root = np.arange(n)
    while len(a):
        low = np.minimum(root[a], root[b])
        new = root.copy()
        np.minimum.at(new, root[a], low)
        np.minimum.at(new, root[b], low)
        new = new[new]
        while (new != new[new]).any():
            new = new[new]
        if (new == root).all():
            break
        root = new[root]
        open_ = root[a] != root[b]
        a, b = a[open_], b[open_]
    while (root != root[root]).any():
        root = root[root]
    return root


def _within(p: np.ndarray, q: np.ndarray, reach: float) -> np.ndarray:
    """Whether the boxes of strips p and q, each (lo, hi) by strip and coordinate, come within reach."""
    gap = np.maximum(0, np.maximum(p[0][:, None] - q[1][None], q[0][None] - p[1][:, None]))
    return (gap * gap).sum(axis=2) <= reach * reach * (1 + 1e-9) + 1e-12


def _boxes(u: np.ndarray, basis: np.ndarray, strip: int) -> np.ndarray:
    p, at = _project(u, basis), np.arange(0, len(u), strip)
    return np.stack([np.minimum.reduceat(p, at), np.maximum.reduceat(p, at)])


def _links(ua: np.ndarray, ub: np.ndarray | None, box_a: np.ndarray, box_b: np.ndarray, least: float, reach: float, strip: int) -> tuple[np.ndarray, np.ndarray]:
    """Rows of two blocks, or twice of one, whose cosine is at least so much: strip by strip, those within reach."""
    same = ub is None
    ub = ua if same else ub
    dim = min(ua.shape[1], ub.shape[1])
    out_a, out_b = [np.zeros(0, np.int64)], [np.zeros(0, np.int64)]
    near = _within(box_a, box_b, reach)
    for i in np.flatnonzero(near.any(axis=1)).tolist():
        cols = np.flatnonzero(np.repeat(near[i], strip)[: len(ub)])
        if same:
            cols = cols[cols >= i * strip]
        rows = ua[i * strip : (i + 1) * strip, :dim]
        a, b = np.nonzero(rows @ (ub[:, :dim] if len(cols) == len(ub) else ub[cols, :dim]).T >= least)
        out_a.append(a + i * strip)
        out_b.append(cols[b])
    a, b = np.concatenate(out_a), np.concatenate(out_b)
    return (a[a < b], b[a < b]) if same else (a, b)


def _comparer(basis: np.ndarray, least: float, reach: float, strip: int = STRIP):
    """A square's blocks, each with the blocks it is compared with, to: place of a class, its links in the square, weighted by copies,
    and a place of its component there. Blocks come as matrices with the places of their classes."""

    def run(t: pa.Table) -> pa.Table:
        blocks = {}
        for block, others, first, copies, units in zip(*(t[c] for c in ("block", "others", "first", "copies", "units")), strict=True):
            n = np.asarray(copies.values)
            u = np.frombuffer(units.as_buffer()).reshape(len(n), -1)
            blocks[block.as_py()] = (first.as_py() + np.arange(len(n)), n, u, _boxes(u, basis, strip), sorted(others.as_py()))
        start = dict(zip(sorted(blocks), np.cumsum([0, *(len(blocks[p][0]) for p in sorted(blocks))]).tolist(), strict=False))
        ids = np.concatenate([blocks[p][0] for p in sorted(blocks)])
        links, root, waiting = np.zeros(len(ids)), np.arange(len(ids)), []

        def fold() -> np.ndarray:
            moved = np.flatnonzero(root != np.arange(len(root)))
            return _roots(len(ids), np.concatenate([moved, *(a for a, _ in waiting)]), np.concatenate([root[moved], *(b for _, b in waiting)]))

        for p in sorted(blocks):
            _, ca, ua, xa, others = blocks[p]
            for q in others:
                _, cb, ub, xb, _ = blocks[q]
                a, b = _links(ua, None if p == q else ub, xa, xb, least, reach, strip)
                if not len(a):
                    continue
                links[start[p] : start[p] + len(ca)] += np.bincount(a, cb[b], len(ca))
                links[start[q] : start[q] + len(cb)] += np.bincount(b, ca[a], len(cb))
                waiting.append((a + start[p], b + start[q]))
                if sum(len(x) for x, _ in waiting) >= WAITING:
                    root, waiting = fold(), []
        root = fold()
        hit = np.flatnonzero(links)
        return pa.table([pa.array(ids[hit]), pa.array(links[hit].astype(np.int64)), pa.array(ids[root[hit]])], names=["place", "n", "root"])

    return run


def _near(reach: float):
    """Whether the boxes of two intervals come within reach, as an expression over lo_a, hi_a, lo_b, hi_b."""
    gap = F.zip_with(F.arrays_zip(F.col("lo_a").alias("lo"), F.col("hi_a").alias("hi")), F.arrays_zip(F.col("lo_b").alias("lo"), F.col("hi_b").alias("hi")), lambda x, y: F.greatest(x["lo"] - y["hi"], y["lo"] - x["hi"], F.lit(0.0)))
    return F.aggregate(gap, F.lit(0.0), lambda s, g: s + g * g) <= reach * reach * (1 + 1e-9) + 1e-12


def interval_pairs(blocks: DataFrame, levels: int, reach: float, coordinates: int, fan: int = FAN) -> DataFrame:
    """Pairs (a, b), a <= b, of blocks that may hold a link: the recursive join of intervals, one level after the other."""
    boxes = blocks.select("block", "lo", "hi")
    corner = lambda c, f: F.array(*[f(F.col(c)[i]) for i in range(coordinates)])
    pairs = None
    for level in range(levels, -1, -1):
        node = F.floor(F.col("block") / fan**level).cast("long")
        nodes = boxes.groupBy(node.alias("node")).agg(corner("lo", F.min).alias("lo"), corner("hi", F.max).alias("hi"))
        side = lambda x, nodes=nodes: nodes.select(F.col("node").alias(x), F.col("lo").alias(f"lo_{x}"), F.col("hi").alias(f"hi_{x}"))
        if pairs is None:
            pairs = nodes.select(F.col("node").alias("a"), F.col("node").alias("b"))
        else:
            parts = F.sequence(F.lit(0), F.lit(fan - 1)).cast("array<long>")
            pairs = pairs.select(F.explode(F.transform(parts, lambda i: F.col("a") * fan + i)).alias("a"), "b").join(side("a"), "a")
            pairs = pairs.select("a", "lo_a", "hi_a", F.explode(F.transform(parts, lambda i: F.col("b") * fan + i)).alias("b")).where("a <= b").join(side("b"), "b")
            pairs = pairs.where(_near(reach)).select("a", "b")
    return pairs


def _side(blocks: int, widest: int) -> int:
    """Blocks on a side of a square, for so many blocks of at most so many bytes."""
    return max(1, min(-(-blocks // SIDES), SIDE_BYTES // max(1, widest)))


def near_duplicates(vectors: DataFrame, vec_id: str = "vec_id", vector: str = "embedding", least: float = 0.95, block: int = BLOCK) -> DataFrame:
    """A row for each vector: vec_id, n_links (other vectors with cosine >= least), component_id (the smallest id that
    links reach, itself included), kept (vec_id = component_id).

    Cosines are in double precision. Vectors that are null, empty, zero or hold a null or a non-finite component link with
    nothing. Vectors of unlike lengths are compared as if the shorter ended in zeros. Equal vectors link like any others.
    Rows that repeat an id are vectors of their own, linked as such; each keeps its row with its own links. Rows with a null id
    link with nothing and keep their row, with a null component. Ids are whole numbers, also as texts; any other text is an error. An empty
    table gives an empty one; other columns are not read.
    """
    spark = vectors.sparkSession
    scratch = Scratch(spark, "ego")
    v = vectors.select(F.col(vec_id).cast("long").alias("vec_id"), F.col(vector).alias("vector"))
    basis = directions(v, "vector")
    reach = float(np.sqrt(max(0.0, 2 - 2 * least)))
    seen = F.when(F.col("vec_id").isNotNull(), F.col("vector")).alias("vector")
    placed = v.select("vec_id", seen).mapInArrow(_placer(basis, max(reach / 2, 1e-3)), "vec_id bigint, name binary, cell binary, unit binary")
    placed = scratch.save(placed, "placed")
    classes = placed.where("name is not null").groupBy("name").agg(F.min("vec_id").alias("id"), F.count("*").alias("copies"), F.first("cell").alias("cell"), F.first("unit").alias("unit"))
    classes = scratch.save(classes, "classes")
    parts = max(1, -(-classes.count() // (4 * block)))
    ordered = classes.repartitionByRange(parts, "cell", "name").sortWithinPartitions("cell", "name").select("name", "copies", "unit")
    cut = ordered.mapInArrow(_blocks(basis, max(block, 1)), "part int, i bigint, names array<binary>, copies array<bigint>, units binary, lo array<double>, hi array<double>")
    cut = scratch.save(cut, "cut")
    # numbers of blocks and places of classes go on from partition to partition; a partition has one row here
    sizes = cut.groupBy("part").agg(F.count("*").alias("blocks"), F.sum(F.size("copies")).alias("rows"))
    before = Window.orderBy("part").rowsBetween(Window.unboundedPreceding, -1)
    sizes = sizes.select("part", *[F.coalesce(F.sum(c).over(before), F.lit(0)).alias(f"{c}_before") for c in ("blocks", "rows")])
    blocks = cut.join(F.broadcast(sizes), "part").select((F.col("blocks_before") + F.col("i")).alias("block"), (F.col("rows_before") + F.col("i") * block).alias("first"), "names", "copies", "units", "lo", "hi")
    blocks = scratch.save(blocks, "blocks")
    scratch.drop(cut)
    total = blocks.agg(F.max("block"), F.max(F.length("units")), F.sum(F.length("units"))).first()
    last, widest, size = (x or 0 for x in total)
    levels = 0
    while FAN**levels <= last:
        levels += 1
    side = _side(last + 1, widest)
    pairs = scratch.save(interval_pairs(blocks, levels, reach, basis.shape[1] + 1).select("a", "b", *[F.floor(F.col(c) / side).alias(f"s{c}") for c in "ab"]), "pairs")
    # a block goes to each of its squares once, with the blocks that it is compared with there
    asked = pairs.select("sa", "sb", F.col("a").alias("block"), "b").unionByName(pairs.select("sa", "sb", F.col("b").alias("block"), F.lit(None).cast("bigint").alias("b")))
    asked = asked.groupBy("sa", "sb", "block").agg(F.collect_list("b").alias("others"))
    waves = max(1, -(-(last // side + 1) * size // max(WAVE_BYTES, WAVE_COPIES * size)))
    parts = []
    for wave in range(waves):
        sent = asked.where((F.col("sa") + F.col("sb")) % waves == wave).join(blocks, "block").select("sa", "sb", "block", "others", "first", "copies", "units")
        found = sent.groupBy("sa", "sb").applyInArrow(_comparer(basis, least, reach), "place bigint, n bigint, root bigint")
        parts.append(scratch.save(found, "found", max(1, BATCH_BYTES // max(1, widest))))
    found = functools.reduce(DataFrame.unionByName, parts)
    links = found.groupBy("place").agg(F.sum("n").alias("n_links"))
    comp = connected_components(found.select(F.col("place").alias("u"), F.col("root").alias("v")), scratch)
    linked = links.join(comp, links.place == comp.id).select("place", "n_links", "component_id")
    named = blocks.select("first", F.posexplode("names").alias("i", "name")).select((F.col("first") + F.col("i")).alias("place"), "name")
    own = classes.select("name", "id", "copies").join(named.join(linked, "place"), "name", "left")
    low = own.where("component_id is not null").groupBy("component_id").agg(F.min("id").alias("low"))
    own = own.join(low, "component_id", "left").select("name", (F.coalesce("n_links", F.lit(0)) + F.col("copies") - 1).alias("n_links"), F.coalesce("low", "id").alias("comp"))
    out = placed.select("vec_id", "name").join(own, "name", "left")
    comp_id = F.coalesce("comp", "vec_id")
    return out.select("vec_id", F.coalesce("n_links", F.lit(0)).cast("long").alias("n_links"), comp_id.alias("component_id"), F.coalesce(F.col("vec_id") == comp_id, F.lit(True)).alias("kept"))
