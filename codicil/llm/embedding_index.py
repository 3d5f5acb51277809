"""Near-duplicate vectors by an inverted multi-index.

The halves of the unit vectors have codebooks of their own; pairs of codes form a grid
of cells.  A vector lives in the cell of its nearest codes and visits further cells in
the order of the sum of both distances (the multi-sequence order), until the target
recall is reached: how many cells that takes is measured on a bounded sample, each
vector of which gets an artificial neighbour at the least similarity that counts.
Residents and visitors of a cell are compared exactly, in double precision.

Of two cells only the vectors of the lower-numbered one visit the other, so each pair
meets once.  Equal vectors are one class throughout.  A crowded cell is cut into blocks
that are compared block against block; a comparison returns, per vector, the number
of its links and one link of a spanning forest, never all pairs.
"""

from __future__ import annotations

import math
from collections.abc import Iterator

import numpy as np
import pyarrow as pa
import pyarrow.compute as pc
import xxhash
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from codicil.llm.graph import components
from codicil.llm.shared import stage

SAMPLE = 4_096  # classes that the codebooks and the number of visits are fitted on
CELL_ROWS = 64  # classes a cell holds on average
MAX_CODES = 512
TARGET_RECALL = 0.995
BLOCK = 512
LLOYD_STEPS = 12


def clean(values: list | None) -> np.ndarray | None:
    """A vector as doubles; None if it is null, empty, zero or holds null or non-finite components."""
    if not values or None in values:
        return None
    x = np.array(values, np.float64)
    return x if np.isfinite(x).all() and x.any() else None


def _unit(x: np.ndarray) -> np.ndarray:
    x = x / np.abs(x).max()  # first, so that the squares stay in range
    return x / math.sqrt(float(x @ x))


def unit_vectors(vectors: DataFrame, id_column: str, vector_column: str) -> DataFrame:
    """``id, node, unit``: the digest of the vector and the vector at length 1, null where it takes no part."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            found = [clean(v) for v in batch.column(1).to_pylist()]
            nodes = [None if x is None else xxhash.xxh3_128_digest((x + 0.0).tobytes()) for x in found]
            units = [None if x is None else _unit(x) for x in found]
            yield pa.RecordBatch.from_arrays([batch.column(0), pa.array(nodes, pa.binary()), pa.array(units, pa.list_(pa.float64()))], names=["id", "node", "unit"])

    narrow = vectors.select(F.col(id_column).cast("long").alias("id"), F.col(vector_column).cast("array<double>").alias("v"))
    return narrow.mapInArrow(run, "id long, node binary, unit array<double>")


def _matrix(column: pa.Array | pa.ChunkedArray, width: int) -> np.ndarray:
    """Rows of an array column; shorter vectors are filled with zeros."""
    rows = column.to_pylist() if any(len(v) != width for v in column) else None
    if rows is None:
        flat = column.combine_chunks() if isinstance(column, pa.ChunkedArray) else column
        return flat.flatten().to_numpy(zero_copy_only=False).reshape(-1, width)
    out = np.zeros((len(rows), width))
    for i, row in enumerate(rows):
        out[i, : len(row)] = row
    return out


def _nearest(x: np.ndarray, codes: np.ndarray) -> np.ndarray:
    return (x * x).sum(1)[:, None] - 2 * x @ codes.T + (codes * codes).sum(1)


def _codebook(x: np.ndarray, size: int, rng: np.random.Generator) -> np.ndarray:
    codes = x[rng.choice(len(x), min(size, len(x)), replace=False)].copy()
    for _ in range(LLOYD_STEPS):
        own = _nearest(x, codes).argmin(1)
        for k in np.unique(own):
            codes[k] = x[own == k].mean(0)
    return codes


class Grid:
    """Two codebooks and the number of cells a vector visits."""

    def __init__(self, sample: np.ndarray, total: int, similarity: float, target: float) -> None:
        rng = np.random.default_rng(7)
        self.width = sample.shape[1]
        self.middle = max(1, self.width // 2)
        size = int(min(MAX_CODES, max(2, round(math.sqrt(total / CELL_ROWS)))))
        self.codes = [_codebook(h, size, rng) for h in self._halves(sample)]
        self.visits = self._measured(sample, similarity, target, rng)

    def _halves(self, x: np.ndarray) -> list[np.ndarray]:
        return [x[:, : self.middle], x[:, self.middle :] if self.width > 1 else np.zeros((len(x), 1))]

    def traversal(self, x: np.ndarray, cells: int) -> np.ndarray:
        """The first ``cells`` cells of each vector in multi-sequence order.

        With both code lists sorted by distance, the cell at places (i, j) has at least
        (i + 1) * (j + 1) - 1 cells before it, which bounds the places to look at.
        """
        near = [_nearest(h, c) for h, c in zip(self._halves(x), self.codes, strict=True)]
        order = [np.argsort(d, axis=1, kind="stable") for d in near]
        first, second = (np.take_along_axis(d, o, 1) for d, o in zip(near, order, strict=True))
        places = np.array([(i, j) for i in range(first.shape[1]) for j in range(min(second.shape[1], cells // (i + 1)))])
        sums = first[:, places[:, 0]] + second[:, places[:, 1]]
        best = np.argsort(sums, axis=1, kind="stable")[:, :cells]
        a = np.take_along_axis(order[0], places[best, 0], 1)
        b = np.take_along_axis(order[1], places[best, 1], 1)
        return a * len(self.codes[1]) + b

    def _measured(self, sample: np.ndarray, similarity: float, target: float, rng: np.random.Generator) -> int:
        """Cells to visit so that the share ``target`` of the sample reaches its artificial neighbour's cell."""
        x = sample[:1024]
        away = rng.normal(size=x.shape)
        away -= (away * x).sum(1, keepdims=True) * x
        away /= np.maximum(np.linalg.norm(away, axis=1, keepdims=True), 1e-12)
        homes = self.traversal(similarity * x + math.sqrt(1 - similarity**2) * away, 1)[:, 0]
        total, cells = len(self.codes[0]) * len(self.codes[1]), 8
        while True:
            cells = min(cells, total)
            hit = self.traversal(x, cells) == homes[:, None]
            reached = np.where(hit.any(1), hit.argmax(1), total)
            need = int(np.quantile(reached, target, method="higher")) + 1
            if need <= cells or cells == total:
                return min(need, total)
            cells *= 2


def _forest(linked: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    """Component label of each row and column of a bipartite link matrix (rows are numbered first)."""
    rows, columns = linked.shape
    none = rows + columns
    a, b = np.arange(rows), rows + np.arange(columns)
    while True:
        new_a = np.minimum(a, np.where(linked, b, none).min(1, initial=none))
        new_b = np.minimum(b, np.where(linked, new_a[:, None], none).min(0, initial=none))
        if (new_a == a).all() and (new_b == b).all():
            return a, b
        a, b = new_a, new_b


def _compare(unit: pa.Table, width: int, similarity: float) -> pa.Table:
    """Links of one unit: left rows with right rows, and right rows among themselves if ``within``."""
    sides = []
    for side in (0, 1):
        own = unit.filter(pc.equal(unit["side"], side))
        sides.append((own["node"].to_pylist(), own["copies"].to_numpy(), _matrix(own["unit"], width)))
    (left, left_n, x), (right, right_n, y) = sides
    parts = [(left, left_n, x, False)] if left and right else []
    if right and unit["within"][0].as_py():
        parts.append((right, right_n, y, True))
    node, links, parent = [], [], []
    for names, copies, z, same in parts:
        linked = z @ y.T >= similarity
        if same:
            linked |= linked.T  # one answer for both orders of a pair
            np.fill_diagonal(linked, False)
        sides = [(names, linked @ right_n, linked.any(1))] + ([] if same else [(right, copies @ linked, linked.any(0))])
        if same:
            np.fill_diagonal(linked, True)
        labels, every = _forest(linked), [*names, *right]
        for (own, count, some), label in zip(sides, labels, strict=False):
            for i in np.flatnonzero(some):
                node.append(own[i]), links.append(int(count[i])), parent.append(every[label[i]])
    return pa.table({"node": pa.array(node, pa.binary()), "links": pa.array(links, pa.int64()), "parent": pa.array(parent, pa.binary())})


def near_duplicate_vectors(
    vectors: DataFrame, similarity: float = 0.95, target_recall: float = TARGET_RECALL, id_column: str = "vec_id", vector_column: str = "embedding"
) -> DataFrame:
    """Per row ``id, n_links, component_id, kept``.

    Vectors that are null, empty, zero or hold null or non-finite components link with
    nothing.  A shorter vector counts as filled up with zeros.  Rows with equal vectors
    are linked; rows that repeat an id are rows of their own.  A component is named by its
    smallest id; a row is kept if that is its own.  Other columns are not read; an empty
    table gives no rows.
    """
    spark = vectors.sparkSession
    rows = stage(unit_vectors(vectors, id_column, vector_column), "units")
    classes = stage(
        rows.where("node is not null").groupBy("node").agg(F.min("id").alias("id"), F.count("*").alias("copies"), F.first("unit").alias("unit")), "classes"
    )
    total, width = classes.agg(F.count("*"), F.coalesce(F.max(F.size("unit")), F.lit(0))).first()
    if total:
        partial = _partial_links(classes, total, width, similarity, target_recall)
    else:
        partial = spark.createDataFrame([], "node binary, links long, parent binary")
    counted = partial.groupBy("node").agg(F.sum("links").alias("links"))
    joined = components(partial, "node", "parent")
    named = classes.select("node", "id", "copies").join(counted, "node", "left").join(joined, "node", "left")
    named = named.select("node", "id", (F.coalesce("links", F.lit(0)) + F.col("copies") - 1).alias("n_links"), F.coalesce("component", "node").alias("component"))
    least = named.groupBy("component").agg(F.min("id").alias("component_id"))
    named = named.join(least, "component").select("node", "n_links", "component_id")
    out = rows.select("id", "node").join(named, "node", "left")
    component = F.when(F.col("node").isNull(), F.col("id")).otherwise(F.col("component_id"))
    out = out.select("id", F.coalesce("n_links", F.lit(0).cast("long")).alias("n_links"), component.alias("component_id"))
    return out.withColumn("kept", F.col("id").eqNullSafe(F.col("component_id")))


def _partial_links(classes: DataFrame, total: int, width: int, similarity: float, target: float) -> DataFrame:
    sample = classes.orderBy("node").select("unit").limit(SAMPLE).toArrow()  # digests: a random sample, of documented size
    grid = Grid(_matrix(sample["unit"], width), total, similarity, target)

    def visit(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            for at in range(0, batch.num_rows, 1024):
                part = batch.slice(at, 1024)
                x = _matrix(part.column(2), width)
                order = grid.traversal(x, grid.visits)
                wanted = order >= order[:, :1]  # the home cell, and of the others those above it
                row, _ = np.nonzero(wanted)
                cell = order[wanted]
                taken = part.take(pa.array(row))
                yield pa.RecordBatch.from_arrays(
                    [pa.array(cell, pa.int64()), pa.array(cell == order[row, 0]), *taken.columns], names=["cell", "home", "node", "copies", "unit"]
                )

    visits = stage(classes.select("node", "copies", "unit").mapInArrow(visit, "cell long, home boolean, node binary, copies long, unit array<double>"), "visits")
    crowd = visits.groupBy("cell").agg(F.sum(F.col("home").cast("long")).alias("residents"), F.count("*").alias("all"))
    crowd = crowd.where(F.col("all") > BLOCK).collect()  # at most MAX_CODES squared rows of three numbers
    blocks = {r["cell"]: (-(-r["residents"] // BLOCK) or 1, -(-(r["all"] - r["residents"]) // BLOCK) or 1) for r in crowd}

    def deal(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        """Work units: a whole cell, or of a crowded one each resident block, pair of them, and visitor block with each."""
        for batch in batches:
            for at in range(0, batch.num_rows, 512):
                part, out = batch.slice(at, 512), []
                for i, (cell, home, node) in enumerate(zip(*(part.column(c).to_pylist() for c in range(3)), strict=True)):
                    if cell not in blocks:
                        out.append((i, f"{cell}", int(home), True))
                        continue
                    (residents, visitors), mark = blocks[cell], int.from_bytes(node[:8], "little")
                    own = mark % (residents if home else visitors)
                    if not home:
                        out += [(i, f"{cell}:v{own}:{other}", 0, False) for other in range(residents)]
                        continue
                    out.append((i, f"{cell}:{own}", 1, True))
                    out += [(i, f"{cell}:{min(own, other)}:{max(own, other)}", int(own > other), False) for other in range(residents) if other != own]
                    out += [(i, f"{cell}:v{v}:{own}", 1, False) for v in range(visitors)]
                row, unit, side, within = zip(*out, strict=True)
                taken = part.take(pa.array(row, pa.int64()))
                yield pa.RecordBatch.from_arrays(
                    [pa.array(unit), pa.array(side, pa.int32()), pa.array(within), *taken.columns[2:]], names=["unit_key", "side", "within", "node", "copies", "unit"]
                )

    work = visits.mapInArrow(deal, "unit_key string, side int, within boolean, node binary, copies long, unit array<double>")

    def compare(unit: pa.Table) -> pa.Table:
        return _compare(unit, width, similarity)

    return stage(work.groupBy("unit_key").applyInArrow(compare, "node binary, links long, parent binary"), "partial-links")
