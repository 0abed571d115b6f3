"""The most similar vectors of every vector, by cosine.

Method: stable projections, a kd-tree on them, and a chi-square stopping test.
Unit vectors are projected onto ``DIMENSIONS`` Gaussian directions; the squared
projected distance of two vectors over their squared distance then follows a
chi-square distribution with as many degrees of freedom.  The projections are
indexed by a kd-tree.  A block of queries takes cells, and in them leaves, in the
order of their projected distance, and verifies their vectors exactly; once a leaf
lies so far away from a query that a vector as near as its k-th best would have
been met before with probability ``confidence``, the query skips it, and a cell that
all queries skip isn't read.  With ``min_cosine`` only neighbours of at
least that cosine count, so the k-th best is never farther than that: the search
ends early and the loss is at most ``1 - confidence`` a neighbour at exactly that
cosine, and far less above it.

Layout: the upper levels of the tree are fitted on a sample of at most
``SAMPLE`` vectors and cut the collection into cells of about ``CELL`` vectors;
every vector is indexed.  Cells are written once to the shared folder.  A task
takes a block of queries of one cell and streams the cells it needs, nearest
first, through memory: no pair is shuffled.  All tasks know the boxes of the cells
(48 bytes for ``CELL`` vectors), which is all that the driver gets of them.

Copies: vectors of the same values are searched once, under their smallest id,
and get their neighbours by a join; the copies of one vector are each other's
nearest, smallest ids first.  Ties in cosine go to the smaller id.  A vector is
unusable if it is null, of another length, not finite or all zero; such rows
are left out, and of several usable rows of an id the latest counts (ties: the
vector that sorts last).  A null id is left out.  An empty table gives an empty
result, extra columns are ignored.
"""

from __future__ import annotations

import math
from collections.abc import Iterator

import numpy as np
import pandas as pd
import pyarrow as pa
import pyarrow.fs as pafs
import pyarrow.parquet as pq
import pyspark.sql.functions as F
from pyspark.sql import DataFrame, Window

from rankspark.sources.shared import stored

DIMENSIONS = 6
CONFIDENCE = 0.9
SAMPLE = 20_000
CELL = 32_768
LEAF = 128
SEED = 7


def chi_square_quantile(p: float, m: int) -> float:
    """The value that a chi-square variable with an even number ``m`` of degrees of freedom exceeds with probability 1 - p."""
    assert m % 2 == 0 and 0 < p < 1
    low, high = 0.0, 100.0 + 10 * m
    for _ in range(80):
        x = (low + high) / 2
        above = math.exp(-x / 2) * sum((x / 2) ** k / math.factorial(k) for k in range(m // 2))
        low, high = (x, high) if 1 - above < p else (low, x)
    return high


def directions(length: int, dimensions: int = DIMENSIONS, seed: int = SEED) -> np.ndarray:
    return np.random.default_rng(seed).standard_normal((length, dimensions)).astype(np.float32)


def split(points: np.ndarray, leaf: int) -> list[np.ndarray]:
    """Leaves (row numbers) of a kd-tree: halves along the widest dimension until ``leaf`` rows or fewer are left."""
    done, open_ = [], [np.arange(len(points))]
    while open_:
        rows = open_.pop()
        if len(rows) <= leaf:
            done.append(rows)
            continue
        p = points[rows]
        d = int(np.argmax(p.var(axis=0)))
        order = np.argpartition(p[:, d], len(rows) // 2)
        open_ += [rows[order[len(rows) // 2 :]], rows[order[: len(rows) // 2]]]
    return done


def cell_tree(points: np.ndarray, cells: int) -> list:
    """Nested [dimension, threshold, left, right] down to cell numbers; ``cells`` is a power of two."""
    number = iter(range(cells))

    def grow(p: np.ndarray, size: int):
        if size == 1:
            return next(number)
        d = int(np.argmax(p.var(axis=0))) if len(p) > 1 else 0
        at = float(np.median(p[:, d])) if len(p) else 0.0
        left = p[:, d] < at
        return [d, at, grow(p[left], size // 2), grow(p[~left], size // 2)]

    return grow(points, cells)


def cell_of(tree, points: np.ndarray) -> np.ndarray:
    cell = np.empty(len(points), np.int32)

    def go(node, rows: np.ndarray) -> None:
        if isinstance(node, int):
            cell[rows] = node
        else:
            left = points[rows, node[0]] < node[1]
            go(node[2], rows[left])
            go(node[3], rows[~left])

    go(tree, np.arange(len(points)))
    return cell


class Cell:
    """The vectors of one cell in leaf order, with the leaves' boxes in the projection."""

    def __init__(self, ids: np.ndarray, vectors: np.ndarray, sizes: np.ndarray, projector: np.ndarray, asks: np.ndarray | None = None):
        self.ids, self.vectors, self.projected, self.asks = ids, vectors, vectors @ projector, asks
        self.edge = np.concatenate([[0], np.cumsum(sizes)])
        self.low = np.minimum.reduceat(self.projected, self.edge[:-1], axis=0)
        self.high = np.maximum.reduceat(self.projected, self.edge[:-1], axis=0)

    @classmethod
    def build(cls, ids: np.ndarray, vectors: np.ndarray, projector: np.ndarray, leaf: int = LEAF, asks: np.ndarray | None = None) -> Cell:
        leaves = split(vectors @ projector, leaf)
        order = np.concatenate(leaves)
        return cls(ids[order], vectors[order], np.array([len(x) for x in leaves], np.int64), projector, None if asks is None else asks[order])

    def distances(self, queries: np.ndarray) -> np.ndarray:
        """Squared projected distance of each query to each leaf's box."""
        total = np.zeros((len(self.low), len(queries)), np.float32)
        for d in range(queries.shape[1]):
            q = queries[:, d]
            gap = np.maximum(self.low[:, d, None] - q, q - self.high[:, d, None])
            np.maximum(gap, 0, out=gap)
            gap *= gap
            total += gap
        return total


class Search:
    """The best ``k`` of a block of queries so far, and what is still worth a look."""

    def __init__(self, ids: np.ndarray, vectors: np.ndarray, projected: np.ndarray, k: int, min_cosine: float, confidence: float):
        self.ids, self.vectors, self.projected, self.k = ids, vectors, projected, k
        self.stop = chi_square_quantile(confidence, projected.shape[1])
        self.floor = np.float32(min_cosine)
        self.worst = np.full(len(ids), min_cosine, np.float32)  # cosine that a newcomer has to reach
        self.best_cosine = np.full((len(ids), k), -2, np.float32)
        self.best_id = np.full((len(ids), k), -1, np.int64)
        self.verified = 0

    def _merge(self, query: np.ndarray, cosine: np.ndarray, other: np.ndarray) -> None:
        """Put newcomers (any number a query) among the best."""
        touched, at = np.unique(query, return_inverse=True)
        q = np.concatenate([at, np.repeat(np.arange(len(touched)), self.k)])
        c = np.concatenate([cosine, self.best_cosine[touched].ravel()])
        o = np.concatenate([other, self.best_id[touched].ravel()])
        order = np.lexsort((o, -c, q))
        q, c, o = q[order], c[order], o[order]
        start = np.flatnonzero(np.r_[True, q[1:] != q[:-1]])
        pick = start[:, None] + np.arange(self.k)
        self.best_cosine[touched], self.best_id[touched] = c[pick], o[pick]
        self.worst[touched] = np.maximum(self.floor, c[pick[:, -1]])

    def _leaf(self, cell: Cell, leaf: int, query: np.ndarray) -> None:
        a, b = cell.edge[leaf], cell.edge[leaf + 1]
        cosine = self.vectors[query] @ cell.vectors[a:b].T
        self.verified += cosine.size
        hit = np.flatnonzero((cosine >= self.worst[query, None]).ravel())
        if len(hit):
            row, column = np.divmod(hit, b - a)
            other, query = cell.ids[a:b][column], query[row]
            good = other != self.ids[query]
            if good.any():
                self._merge(query[good], cosine.ravel()[hit][good], other[good])

    def reach(self) -> np.ndarray:
        """Squared projected distance up to which each query looks; that of unit vectors is 2 - 2 cos."""
        return self.stop * 2 * (1 - self.worst)

    def wants(self, low: np.ndarray, high: np.ndarray) -> bool:
        """Whether any query may find something in a box of the projection."""
        gap = np.maximum(np.maximum(low - self.projected, self.projected - high), 0)
        return bool(((gap * gap).sum(axis=1) <= self.reach()).any())

    def add(self, cell: Cell, nearest_first: bool) -> None:
        far = cell.distances(self.projected)
        reach = self.reach
        if nearest_first:  # the nearest leaf of each query sets its bound before the rest is judged
            first = far.argmin(axis=0)
            for leaf in np.unique(first):
                query = np.flatnonzero(first == leaf)
                query = query[far[leaf, query] <= reach()[query]]
                if len(query):
                    self._leaf(cell, leaf, query)
            far[first, np.arange(far.shape[1])] = np.inf
        for leaf in far.min(axis=1).argsort(kind="stable"):
            query = np.flatnonzero(far[leaf] <= reach())
            if len(query):
                self._leaf(cell, leaf, query)


def usable(rows: DataFrame, length: int, key: str = "article_id", vector: str = "embedding", order: str = "last_updated") -> DataFrame:
    """(id, vector): of each id the latest of its usable vectors."""
    v = F.col(vector)
    finite = F.forall(v, lambda x: x.isNotNull() & ~F.isnan(x) & (F.abs(x) < F.lit(float("inf"))))
    good = rows.where(F.col(key).isNotNull() & (F.size(v) == length) & finite & F.exists(v, lambda x: x != 0))
    latest = good.groupBy(F.col(key).alias("id")).agg(F.max(F.struct(F.col(order).alias("o"), v.alias("v"))).alias("m"))
    return latest.select("id", F.col("m.v").alias("vector"))


def _unit(column: pa.ChunkedArray | pa.Array, length: int) -> np.ndarray:
    x = np.asarray(column.flatten(), np.float64).reshape(-1, length)
    x = x / np.abs(x).max(axis=1, keepdims=True)  # lengths may differ by any factor
    return (x / np.sqrt((x * x).sum(axis=1, keepdims=True))).astype(np.float32)


def _to_cells(length: int, projector: np.ndarray, tree):
    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            if not batch.num_rows:
                continue
            ids, x, asks = np.asarray(batch.column(0)), _unit(batch.column(1), length), np.asarray(batch.column(2).to_pylist(), np.uint8)
            cell = cell_of(tree, x @ projector)
            rows: dict[str, list] = {"cell": [], "ids": [], "vectors": [], "asks": []}
            for c in np.unique(cell):
                here = cell == c
                rows["cell"].append(int(c))
                rows["ids"].append(ids[here].tobytes())
                rows["vectors"].append(x[here].tobytes())
                rows["asks"].append(asks[here].tobytes())
            yield pa.RecordBatch.from_pydict(rows, schema=pa.schema([("cell", pa.int32())] + [(c, pa.binary()) for c in ("ids", "vectors", "asks")]))

    return run


def _built(length: int, projector: np.ndarray):
    def run(frame: pd.DataFrame) -> pd.DataFrame:
        ids = np.frombuffer(b"".join(frame["ids"]), np.int64)
        order = np.argsort(ids)  # the same tree whatever order the pieces come in
        x = np.frombuffer(b"".join(frame["vectors"]), np.float32).reshape(-1, length)[order]
        cell = Cell.build(ids[order], x, projector, asks=np.frombuffer(b"".join(frame["asks"]), np.uint8)[order])
        return pd.DataFrame({"cell": frame["cell"].iloc[:1], "ids": [cell.ids.tobytes()], "vectors": [cell.vectors.tobytes()], "sizes": [np.diff(cell.edge).tobytes()], "asks": [cell.asks.tobytes()], "box": [np.stack([cell.low.min(axis=0), cell.high.max(axis=0)]).astype(np.float32).tobytes()]})

    return run


def read_cell(path: str, cell: int, length: int, projector: np.ndarray) -> Cell | None:
    """One cell of the stored table, read by an executor from the shared folder; none if it has no vectors."""
    files, at = pafs.FileSystem.from_uri(path)
    if files.get_file_info(f"{at}/cell={cell}").type == pafs.FileType.NotFound:
        return None
    names = [i.path for i in files.get_file_info(pafs.FileSelector(f"{at}/cell={cell}")) if i.base_name.endswith(".parquet")]
    row = pq.ParquetFile(files.open_input_file(names[0])).read(columns=["ids", "vectors", "sizes", "asks"]).to_pylist()[0]
    return Cell(np.frombuffer(row["ids"], np.int64), np.frombuffer(row["vectors"], np.float32).reshape(-1, length), np.frombuffer(row["sizes"], np.int64), projector, np.frombuffer(row["asks"], np.uint8))


def _searcher(path: str, boxes: dict[int, np.ndarray], length: int, projector: np.ndarray, k: int, min_cosine: float, confidence: float, blocks: int):
    def run(frames: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        for frame in frames:
            for home, block in zip(frame["cell"], frame["block"]):
                own = read_cell(path, home, length, projector)
                if own is None:
                    continue
                # leaf order keeps neighbours in one block
                mine = np.flatnonzero(own.asks)
                mine = mine[len(mine) * block // blocks : len(mine) * (block + 1) // blocks]
                if not len(mine):
                    continue
                search = Search(own.ids[mine], own.vectors[mine], own.projected[mine], k, min_cosine, confidence)
                for c in outwards(boxes, home, search.projected):
                    if c == home or search.wants(*boxes[c]):
                        search.add(own if c == home else read_cell(path, c, length, projector), nearest_first=min_cosine <= -1)
                q, r = np.nonzero(search.best_id >= 0)
                yield pd.DataFrame({"id": search.ids[q], "neighbour": search.best_id[q, r], "cosine": search.best_cosine[q, r].astype(float)})

    return run


def outwards(boxes: dict[int, np.ndarray], home: int, projected: np.ndarray) -> list[int]:
    """Cells in the order of their boxes' projected distance from the box of the queries, home first."""
    low, high = projected.min(axis=0), projected.max(axis=0)

    def distance(c: int) -> tuple[bool, float, int]:
        gap = np.maximum(np.maximum(boxes[c][0] - high, low - boxes[c][1]), 0)
        return c != home, float((gap * gap).sum()), c

    return sorted(boxes, key=distance)


def neighbours(vectors: DataFrame, length: int, k: int = 5, min_cosine: float = -2.0, confidence: float = CONFIDENCE, every: int = 1, cell: int = CELL, sample: int = SAMPLE) -> DataFrame:
    """(id, neighbour, cosine): up to ``k`` most similar others of each id divisible by ``every``, from (id, vector)."""
    spark = vectors.sparkSession
    keyed, _ = stored(vectors.select("id", "vector", F.xxhash64("vector").alias("copy")), "vectors")
    copies = keyed.groupBy("copy").agg(F.min("id").alias("leader"), F.count("*").alias("members"))
    several, _ = stored(keyed.select("id", "copy").join(copies.where("members > 1"), "copy"), "copies")
    # a leader answers for its copies: it is a query if its id or one of theirs is asked for; the others are left out
    asked = F.pmod("id", F.lit(every)) == 0
    roles = several.groupBy("leader").agg(F.max(asked).alias("ask")).select(F.col("leader").alias("id"), "ask", F.lit(False).alias("out"))
    roles = roles.unionByName(several.where("id <> leader").select("id", F.lit(False).alias("ask"), F.lit(True).alias("out")))
    leaders = keyed.join(roles, "id", "left").where(~F.coalesce("out", F.lit(False))).select("id", "vector", (asked | F.coalesce("ask", F.lit(False))).alias("ask"))
    rows = keyed.count()
    projector = directions(length)
    cells = 1 << max(0, math.ceil(math.log2(max(rows, 1) / cell)))
    chosen = leaders if rows <= sample else leaders.where(F.pmod(F.xxhash64("id"), F.lit(rows)) < sample)
    tree = 0
    if cells > 1:
        x = np.array([r[0] for r in chosen.select("vector").collect()], np.float64)
        x /= np.linalg.norm(x, axis=1, keepdims=True)
        tree = cell_tree((x @ projector).astype(np.float32), cells)
    packed = leaders.mapInArrow(_to_cells(length, projector, tree), "cell int, ids binary, vectors binary, asks binary")
    packed = packed.groupBy("cell").applyInPandas(_built(length, projector), "cell int, ids binary, vectors binary, sizes binary, asks binary, box binary")
    held, path = stored(packed, "cells", "cell")
    boxes = {r["cell"]: np.frombuffer(r["box"], np.float32).reshape(2, -1) for r in held.select("cell", "box").collect()}
    blocks = 1 if every >= 20 else 2
    tasks = spark.range(0, cells * blocks, 1, cells * blocks).select((F.col("id") / blocks).cast("int").alias("cell"), F.pmod("id", F.lit(blocks)).cast("int").alias("block"))
    found = tasks.mapInPandas(_searcher(path, boxes, length, projector, k, min_cosine, confidence, blocks), "id long, neighbour long, cosine double")
    return _with_copies(found, several, k, every) if several.head(1) else found


def _with_copies(found: DataFrame, several: DataFrame, k: int, every: int) -> DataFrame:
    """Neighbours of all copies: the other copies (cosine 1), and the copies of the leader's neighbours.

    Of a vector's copies only the ``k + 1`` smallest ids can be among anybody's
    nearest (ties go to the smaller id), so a hot vector costs its members a few
    rows each, never a pair with each other.
    """
    by_id = Window.partitionBy("leader").orderBy("id")
    heads = several.select("leader", "id").withColumn("n", F.row_number().over(by_id)).where(F.col("n") <= k + 1).select("leader", F.col("id").alias("head"))
    member = several.select(F.col("leader"), "id")
    # each neighbour stands for its copies
    wide = found.join(heads.withColumnRenamed("leader", "neighbour"), "neighbour", "left").select("id", F.coalesce("head", "neighbour").alias("neighbour"), "cosine")
    # and each leader's list holds for its copies
    wide = wide.join(member.select(F.col("leader").alias("id"), F.col("id").alias("copy")), "id", "left").select(F.coalesce("copy", "id").alias("id"), "neighbour", "cosine")
    own = member.join(heads, "leader").where("id <> head").select("id", F.col("head").alias("neighbour"), F.lit(1.0).alias("cosine"))
    every_row = wide.union(own).where(F.pmod("id", F.lit(every)) == 0)
    best = Window.partitionBy("id").orderBy(F.desc("cosine"), "neighbour")
    return every_row.withColumn("n", F.row_number().over(best)).where(F.col("n") <= k).select("id", "neighbour", "cosine")


def neighbour_pairs(found: DataFrame, min_cosine: float) -> DataFrame:
    """Unordered pairs of at least ``min_cosine`` where one is a neighbour of the other."""
    return found.where(F.col("cosine") >= min_cosine).select(F.least("id", "neighbour").alias("article_id_a"), F.greatest("id", "neighbour").alias("article_id_b")).distinct()
