"""Near-duplicate vectors through an inverted multi-index (Babenko and Lempitsky, 2012).

Vectors are cut into halves; each half has its own codebook of k-means centres,
and the pairs of centres form a grid of cells.  A vector is stored in the cell of
its two nearest centres.  As a query it visits cells by the multi-sequence
traversal, nearest first, until the cells left could hold a neighbour at the
greatest linked distance with no more than the chance that the target recall
allows: such a neighbour's step towards another centre is about normal with
deviation distance / sqrt(dimensions), so a cell is near enough while the
distances to its two borders, as a length, stay within z times that.  Of two
cells only one need be visited by the other's vectors, so a vector visits the
cells behind its own.  All candidates are verified by their cosine in double precision.

Equal vectors of a label are one class, so copies never meet as pairs.  Cells are
worked in blocks of at most ``BLOCK`` members by ``BLOCK`` queries; a block returns
sums of links and one edge per linked vector, never its pairs.

Null labels, null or zero vectors, and vectors with null or non-finite
components link with nothing.  Vectors of different lengths never link.
"""

from __future__ import annotations

import heapq
import math
from collections.abc import Iterator
from statistics import NormalDist

import numpy as np
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from docweave.llm.common import connected_components, materialize

#: Most classes that the codebooks are fitted on, chosen by hash; all are indexed.
SAMPLE = 20_000
TARGET_RECALL = 0.99
BLOCK = 2048
#: Vectors that a cell should hold, and the range of codebook sizes.
CELL_SIZE, MIN_CENTRES, MAX_CENTRES = 50, 4, 1024
BUCKET_ROWS = 8192


def kmeans(points: np.ndarray, k: int, rounds: int = 12) -> np.ndarray:
    """Centres of Lloyd's algorithm from evenly spaced points; deterministic."""
    points = np.unique(points, axis=0)
    k = min(k, len(points))
    mixed = points[np.argsort((np.arange(len(points)) * 2654435761) % 4294967296, kind="stable")]
    centres = mixed[:k].copy()
    for _ in range(rounds):
        near = _squares(points, centres).argmin(axis=1)
        sums = np.zeros_like(centres)
        np.add.at(sums, near, points)
        n = np.bincount(near, minlength=k)
        centres[n > 0] = sums[n > 0] / n[n > 0, None]
    return centres


def _squares(a: np.ndarray, b: np.ndarray) -> np.ndarray:
    return np.maximum((a * a).sum(axis=1)[:, None] - 2 * a @ b.T + (b * b).sum(axis=1), 0)


class Grid:
    """The two codebooks; vectors are unit length, padded with zeros to the same length."""

    def __init__(self, sample: np.ndarray, k: int):
        self.half = max(sample.shape[1] // 2, 1)
        self.books = [kmeans(part, k) for part in (sample[:, : self.half], sample[:, self.half :])]

    def borders(self, x: np.ndarray) -> list[tuple[np.ndarray, np.ndarray]]:
        """Per half: the nearest centre, and the distance to the border of every other one's region."""
        out = []
        for part, book in zip((x[:, : self.half], x[:, self.half :]), self.books, strict=True):
            squares = _squares(part, book)
            near = squares.argmin(axis=1)
            apart = np.sqrt(_squares(book[near], book))
            apart[np.arange(len(x)), near] = 1.0
            out.append((near, (squares - squares[np.arange(len(x)), near][:, None]) / (2 * np.maximum(apart, 1e-12))))
        return out

    def visits(self, x: np.ndarray, reach: float) -> tuple[np.ndarray, list[list[int]]]:
        """(own cell of each vector, cells behind it that it visits)."""
        (n1, d1), (n2, d2) = self.borders(x)
        k2 = len(self.books[1])
        own = n1.astype(np.int64) * k2 + n2
        rows = []
        for i in range(len(x)):
            cells = traverse(d1[i], d2[i], reach)
            rows.append([c for c in (a * k2 + b for a, b in cells) if c > own[i]])
        return own, rows


def traverse(d1: np.ndarray, d2: np.ndarray, reach: float) -> list[tuple[int, int]]:
    """Multi-sequence traversal: pairs of centres by growing d1 squared + d2 squared, up to reach squared."""
    o1, o2 = np.argsort(d1, kind="stable"), np.argsort(d2, kind="stable")
    s1, s2 = (np.maximum(d1[o1], 0) ** 2).tolist(), (np.maximum(d2[o2], 0) ** 2).tolist()
    heap, seen, out = [(s1[0] + s2[0], 0, 0)], {(0, 0)}, []
    while heap:
        far, i, j = heapq.heappop(heap)
        if far > reach * reach:
            break
        out.append((int(o1[i]), int(o2[j])))
        for a, b in ((i + 1, j), (i, j + 1)):
            if a < len(s1) and b < len(s2) and (a, b) not in seen:
                seen.add((a, b))
                heapq.heappush(heap, (s1[a] + s2[b], a, b))
    return out


def _unit(raw: list[bytes], width: int | None = None) -> np.ndarray:
    width = width or max((len(x) for x in raw), default=8) // 8
    x = np.zeros((len(raw), width))
    for i, r in enumerate(raw):
        v = np.frombuffer(r, "<f8")
        x[i, : len(v)] = v
    return x / np.linalg.norm(x, axis=1, keepdims=True)


def _block(member: tuple, query: tuple, visitor: np.ndarray, cosine: float) -> Iterator[tuple[np.ndarray, np.ndarray, np.ndarray]]:
    """(class, linked vectors, root of its component within the block) of the linked ones.

    A cell's own vectors are members and queries; each counts its links as a
    query.  Links with visitors are counted for both.
    """
    (mc, mn, mx), (qc, qn, qx) = member, query
    linked = qx @ mx.T >= cosine
    linked &= qc[:, None] != mc[None, :]
    if not linked.any():
        return
    by_query = linked @ mn
    by_member = (linked & visitor[:, None]).T @ qn
    ids = np.concatenate([qc, mc])
    root_q, root_m = qc.copy(), mc.copy()
    rows, cols = np.nonzero(linked)
    while True:  # least class id spreads over the block's links
        before = root_q.sum() + root_m.sum()
        np.minimum.at(root_m, cols, root_q[rows])
        np.minimum.at(root_q, rows, root_m[cols])
        if root_q.sum() + root_m.sum() == before:
            break
    touched = np.concatenate([linked.any(axis=1), linked.any(axis=0)])
    yield ids[touched], np.concatenate([by_query, by_member])[touched], np.concatenate([root_q, root_m])[touched]


def near_duplicates(vectors: DataFrame, vec_id: str = "vec_id", embedding: str = "embedding", label: str = "label", cosine: float = 0.98, recall: float = TARGET_RECALL) -> DataFrame:
    """vec_id, n_links, component_id, kept of every row."""
    rows = vectors.select(F.col(vec_id).alias("vec_id"), F.col(label).alias("label"), F.col(embedding).cast("array<double>").alias("v"))
    finite = F.forall("v", lambda x: x.isNotNull() & ~F.isnan(x) & (F.abs(x) < F.lit(math.inf)))
    valid = F.coalesce(F.col("label").isNotNull() & F.col("v").isNotNull() & finite & F.exists("v", lambda x: x != 0), F.lit(False))
    rows = rows.withColumn("v", F.when(valid, F.transform("v", lambda x: x + F.lit(0.0))))
    classes = rows.where("v is not null").groupBy("label", "v").agg(F.min("vec_id").alias("least"), F.count(F.lit(1)).alias("n"))
    classes = materialize(classes.withColumn("cls", F.monotonically_increasing_id()), "vector-classes")
    total = classes.count()
    found = None
    if total > 1:
        found = materialize(_links(classes, total, cosine, recall), "vector-links")
        parts = connected_components(found.where("cls != root").select("cls", "root"), "cls", "root")
        counts = found.groupBy("cls").agg(F.sum("links").alias("links"))
        named = classes.join(parts.withColumnRenamed("node", "cls"), "cls", "left").join(counts, "cls", "left").withColumn("component", F.coalesce("component", "cls"))
        least = named.groupBy("component").agg(F.min("least").alias("component_id"))
        named = named.join(least, "component").select(F.col("label").alias("l2"), F.col("v").alias("v2"), (F.col("n") - 1 + F.coalesce("links", F.lit(0))).alias("links"), "component_id")
    else:
        named = classes.select(F.col("label").alias("l2"), F.col("v").alias("v2"), (F.col("n") - 1).alias("links"), F.col("least").alias("component_id"))
    out = rows.join(named, (F.col("label") == F.col("l2")) & (F.col("v") == F.col("v2")), "left")
    component = F.coalesce("component_id", "vec_id")
    return out.select("vec_id", F.coalesce("links", F.lit(0)).cast("long").alias("n_links"), component.alias("component_id"), F.col("vec_id").eqNullSafe(component).alias("kept"))


def _links(classes: DataFrame, total: int, cosine: float, recall: float) -> DataFrame:
    """(cls, links, root) partial sums and edges of the linked classes."""
    sample = [np.array(r.v, "<f8").tobytes() for r in classes.orderBy(F.xxhash64("v"), "cls").limit(SAMPLE).select("v").collect()]
    width = classes.agg(F.max(F.size("v"))).first()[0]
    k = 1 << round(math.log2(min(MAX_CENTRES, max(MIN_CENTRES, math.sqrt(total / CELL_SIZE)))))
    grid = Grid(_unit(sample, width), k)
    reach = NormalDist().inv_cdf(recall) * math.sqrt(2 - 2 * cosine) / math.sqrt(width)

    def place(batches: Iterator) -> Iterator:
        import pyarrow as pa

        for batch in batches:
            values, sizes = batch.column("v").flatten().to_numpy(zero_copy_only=False), batch.column("v").value_lengths().to_numpy()
            ends = np.cumsum(sizes)
            raw = [values[e - s : e].astype("<f8").tobytes() for s, e in zip(sizes, ends, strict=True)]
            own, visits = grid.visits(_unit(raw, width), reach)
            yield pa.RecordBatch.from_arrays([batch.column("cls"), batch.column("label"), batch.column("n"), pa.array(sizes.astype(np.int32)), pa.array(raw, pa.binary()), pa.array(own), pa.array(visits, pa.list_(pa.int64()))], names=["cls", "label", "n", "size", "raw", "own", "visits"])

    label_type = classes.schema["label"].dataType.simpleString()
    placed = materialize(classes.select("cls", "label", "n", "v").mapInArrow(place, f"cls long, label {label_type}, n long, size int, raw binary, own long, visits array<long>"), "vector-cells")
    # how many blocks of members and of queries each cell has
    cell = ["label", "size", "cell"]
    seen = placed.select("label", "size", F.col("own").alias("cell"), F.lit(1).alias("m")).unionByName(placed.select("label", "size", F.explode("visits").alias("cell"), F.lit(0).alias("m")))
    counts = seen.groupBy(*cell).agg(F.ceil(F.sum("m") / BLOCK).cast("int").alias("mb"), F.ceil(F.count(F.lit(1)) / BLOCK).cast("int").alias("qb"), F.sum("m").alias("m")).where("m > 0 and mb > 0")
    counts = materialize(counts, "cell-blocks")
    own = placed.withColumn("cell", F.col("own")).join(counts.drop("m"), cell)
    there = placed.withColumn("cell", F.explode("visits")).join(counts.drop("m"), cell)
    block = lambda n: F.pmod(F.xxhash64("cls"), F.col(n))
    upto = lambda n: F.explode(F.sequence(F.lit(0), F.col(n) - 1))
    base = [*cell, "cls", "n", "raw"]
    members = own.withColumn("bm", block("mb")).withColumn("bq", upto("qb")).select(*base, F.lit(0).alias("role"), "bm", "bq")
    queries = own.withColumn("bq", block("qb")).withColumn("bm", upto("mb")).select(*base, F.lit(1).alias("role"), "bm", "bq")
    visitors = there.withColumn("bq", block("qb")).withColumn("bm", upto("mb")).select(*base, F.lit(2).alias("role"), "bm", "bq")
    rows = members.unionByName(queries).unionByName(visitors)
    buckets = max(1, math.ceil(placed.count() * 4 / BUCKET_ROWS))
    rows = rows.withColumn("bucket", F.pmod(F.xxhash64(*cell, "bm", "bq"), F.lit(buckets)))

    def work(table):
        import pyarrow as pa

        role, cls, n, raw = (table.column(c).to_pylist() for c in ("role", "cls", "n", "raw"))
        groups: dict[tuple, list[int]] = {}
        for i, key in enumerate(zip(*(table.column(c).to_pylist() for c in (*cell, "bm", "bq")), strict=True)):
            groups.setdefault(key, []).append(i)
        found: list[tuple] = []
        for at in groups.values():
            sides = []
            for own_side in (True, False):
                some = [i for i in at if (role[i] == 0) == own_side]
                if not some:
                    break
                sides.append((np.array([cls[i] for i in some]), np.array([n[i] for i in some]), _unit([raw[i] for i in some])))
            if len(sides) == 2:
                found += _block(sides[0], sides[1], np.array([role[i] == 2 for i in at if role[i]]), cosine)
        parts = [np.concatenate([f[i] for f in found]) if found else np.zeros(0, np.int64) for i in range(3)]
        return pa.table({"cls": pa.array(parts[0], pa.int64()), "links": pa.array(parts[1].astype(np.int64)), "root": pa.array(parts[2], pa.int64())})

    return rows.groupBy("bucket").applyInArrow(work, "cls long, links long, root long")
