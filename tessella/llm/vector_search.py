"""Exact top-k inner products with vector-approximation files.

Components become integers ``floor(256 * x)``. One pass writes the approximation
file: blocks of vectors with one byte a component (the cell that holds it, 256
cells for each dimension of a block), the cells' bounds, and the exact integers
in a column of their own. A search scans cells for bounds of every inner product,
reads vectors exactly in the order of their upper bounds, and stops when the next
bound is below the k-th exact score seen so far: from there the result is certain.

Scale. All queries are answered by one job on a grid: query blocks are dealt into
columns and vector blocks into rows of it, each block is sent once to each cell
that it meets in, and a task holds one cell's queries and streams its vectors, in
whatever number. Cells hand on k rows for each query. The grid grows with the
tables, so that neither a task's queries nor its work do. Vectors that are equal
are kept with their k + 1 smallest ids only: no other can be among k results, as
ties go to the smaller id. So copies of one vector, however many, stay cheap.
Nothing is collected; an executor lost costs its tasks.

Edge cases: vectors that are null, empty or hold null or non-finite components
take no part, neither do null ids; pairs of different length have no score.
Rows that share the query's id are the query's own and no candidates; repeated
query rows are answered once; repeated candidates of another id are each listed,
equal ones up to k + 1 times. Ties go to the smaller id. Every finite component is
exact: pairs whose sums may leave 53 bits are scored in unbounded integers,
without bounds. A score beyond 64 bits is ranked by its true value and reported
as the nearest 64-bit integer. Very long vectors are rows like any other. Extra
columns are ignored; an empty table gives an empty result.
"""

from __future__ import annotations

import math
from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

from tessella.llm import bytehash
from tessella.llm.common import materialise, portable

K = 5
CELLS = 256
#: Components in a block of the approximation file or of queries, about.
BLOCK = 1 << 18
#: Queries that a task holds at most, about.
COLUMN = 16384
#: Pairs that a cell of the grid compares at most, about.
WORK = 1 << 38
STEP = 256
#: Integers from here on are kept as text.
FAR = 1 << 62

_RAW = "d int, vec_id long, vector binary"
_FILE = "block long, d int, n int, far boolean, ids binary, cells binary, low binary, width binary, exact binary"


def integers(column: pa.Array) -> dict[int, tuple[np.ndarray, np.ndarray]]:
    """Usable vectors by length: (row numbers, integer matrix of 64 bits or, beyond, of objects)."""
    if isinstance(column, pa.ChunkedArray):
        column = column.combine_chunks()
    sizes = np.diff(column.offsets.to_numpy()).astype(np.int64)
    values = column.flatten()
    whole = ~np.asarray(column.is_null())
    sizes = np.where(whole, sizes, 0)
    flat = values.cast(pa.float64()).to_numpy(zero_copy_only=False)  # null becomes nan
    place = np.cumsum(sizes) - sizes
    out = {}
    for d in np.unique(sizes[sizes > 0]).tolist():
        rows = np.flatnonzero(sizes == d)
        x = flat[place[rows][:, None] + np.arange(d)]
        good = np.isfinite(x).all(axis=1)
        rows, x = rows[good], x[good]
        if len(x) and np.abs(x).max() * 256 >= FAR:
            # floats this large are whole numbers
            out[d] = rows, np.array([[math.floor(v * 256) if abs(v) < 1 << 52 else int(v) * 256 for v in r] for r in x.tolist()], object)
        elif len(x):
            out[d] = rows, np.floor(x * 256).astype(np.int64)
    return out


def _packed(row: np.ndarray) -> bytes:
    """A vector as bytes, equal for equal vectors: 64-bit integers, or text where they do not hold it."""
    if max(abs(int(v)) for v in row) < FAR:
        return b"i" + row.astype("<i8").tobytes()
    return b"t" + ",".join(str(int(v)) for v in row).encode()


def _matrix(vectors: list[bytes]) -> np.ndarray:
    if all(v[:1] == b"i" for v in vectors):
        return np.frombuffer(b"".join(v[1:] for v in vectors), "<i8").reshape(len(vectors), -1)
    return np.array([np.frombuffer(v[1:], "<i8").tolist() if v[:1] == b"i" else [int(x) for x in v[1:].decode().split(",")] for v in vectors], object)


def _raw(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    """Usable rows as (length, id, vector)."""
    for batch in batches:
        ids = batch.column("vec_id").to_numpy(zero_copy_only=False)
        for d, (rows, x) in integers(batch.column("embedding")).items():
            if x.dtype == object:
                vectors = pa.array([_packed(r) for r in x], pa.binary())
            else:
                # all rows at once: one mark byte before each row's integers
                wide = np.empty((len(x), 1 + 8 * d), np.uint8)
                wide[:, 0] = ord("i")
                wide[:, 1:] = np.ascontiguousarray(x.astype("<i8")).view(np.uint8).reshape(len(x), -1)
                at = np.arange(len(x) + 1, dtype=np.int64) * (1 + 8 * d)
                vectors = pa.LargeBinaryArray.from_buffers(pa.large_binary(), len(x), [None, pa.py_buffer(at), pa.py_buffer(wide)]).cast(pa.binary())
            yield pa.RecordBatch.from_arrays([pa.array(np.full(len(x), d, np.int32)), pa.array(ids[rows]), vectors], names=["d", "vec_id", "vector"])


def _blocks(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    """The approximation file, from rows sorted by length, vector and id."""
    ids: list[int] = []
    vectors: list[bytes] = []
    last: tuple[int, bytes] | None = None

    def flush() -> pa.RecordBatch:
        x = _matrix(vectors)
        far = x.dtype == object
        own = np.array(ids, "<i8")
        if far:
            parts = [b"", b"", b"", b"\n".join(vectors)]
        else:
            c, low, width = cells(x)
            parts = [c.tobytes(), low.astype("<i8").tobytes(), width.astype("<i8").tobytes(), x.tobytes()]
        block = int(bytehash.mix(np.bitwise_xor.reduce(bytehash.mix(own.astype(np.uint64), 31), keepdims=True), 32).view(np.int64)[0])
        columns = [[block], [last[0]], [len(ids)], [far], [own.tobytes()], *[[p] for p in parts]]
        kinds = [pa.int64(), pa.int32(), pa.int32(), pa.bool_(), *[pa.binary()] * 5]
        out = pa.RecordBatch.from_arrays([pa.array(c, k) for c, k in zip(columns, kinds, strict=True)], names=["block", "d", "n", "far", "ids", "cells", "low", "width", "exact"])
        ids.clear()
        vectors.clear()
        return out

    for batch in batches:
        for d, i, v in zip(*(batch.column(c).to_pylist() for c in ("d", "vec_id", "vector")), strict=True):
            # blocks hold one length, and vectors in 64 bits or beyond
            if vectors and (d != last[0] or v[:1] != last[1][:1] or len(vectors) == max(16, BLOCK // d)):
                yield flush()
            last = (d, v)
            ids.append(i)
            vectors.append(v)
    if vectors:
        yield flush()


def cells(x: np.ndarray, n: int = CELLS) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
    """Approximation of a block: cell numbers, lowest values and cell widths of each dimension."""
    low = x.min(axis=0)
    span = (x.max(axis=0).astype(np.uint64) - low.astype(np.uint64)).astype(np.uint64)  # may exceed 63 bits
    width = span // np.uint64(n) + np.uint64(1)
    return ((x.astype(np.uint64) - low.astype(np.uint64)) // width).astype(np.uint8), low, width.astype(np.int64)


class Cell:
    """Queries of one cell of the grid and their best hits so far."""

    def __init__(self, ids: np.ndarray, q: np.ndarray, k: int):
        self.ids, self.q, self.k = ids, q, k
        self.far = q.dtype == object
        self.size = np.array([float(max(map(abs, r.tolist()))) for r in q]) if self.far else np.abs(q.astype(np.float64)).max(axis=1)
        self.f = None if self.far else q.astype(np.float64)
        self.kth = np.full(len(ids), -np.inf)
        self.hits: list[list[tuple[int, int]]] = [[] for _ in ids]  # (score, vector id)
        self.read = 0

    def _add(self, i: int, ids: list[int], scores: list[int]) -> None:
        best = sorted([*self.hits[i], *zip(scores, ids, strict=True)], key=lambda h: (-h[0], h[1]))[: self.k]
        self.hits[i] = best
        if len(best) == self.k and abs(best[-1][0]) <= 1 << 53:
            self.kth[i] = best[-1][0]

    def scan(self, ids: np.ndarray, far: bool, parts: tuple[bytes, bytes, bytes, bytes]) -> None:
        """Meet a block of the approximation file."""
        n = len(ids)
        if far or self.far:
            x = _matrix(parts[3].split(b"\n")) if far else np.frombuffer(parts[3], "<i8").reshape(n, -1)
            self._all(range(len(self.ids)), ids, x)
            return
        c, low, width = (np.frombuffer(p, t) for p, t in zip(parts[:3], (np.uint8, "<i8", "<i8"), strict=True))
        d = len(low)
        c, low, width = c.reshape(n, d), low.astype(np.float64), width.astype(np.float64)
        exact = np.frombuffer(parts[3], "<i8").reshape(n, d)  # a view; rows are read when a bound asks for them
        most = np.maximum(np.abs(low), np.abs(low + width * CELLS)).max()
        wide = self.size * most * d > float(1 << 53)
        if wide.any():
            self._all(np.flatnonzero(wide).tolist(), ids, exact)
        some = np.flatnonzero(~wide)
        if not len(some):
            return
        q = self.f[some]
        # in single precision, with a margin for what it loses; whole blocks drop out by their corners
        scaled = (q * width).astype(np.float32)
        base = q @ low + np.maximum(q, 0) @ (width - 1)
        top = base + np.maximum(q * width, 0) @ c.max(axis=0).astype(np.float64) + np.minimum(q * width, 0) @ c.min(axis=0).astype(np.float64)
        live = np.flatnonzero(top >= self.kth[some])
        if not len(live):
            return
        margin = (np.abs(q[live] * width) @ np.full(d, 256.0)) * (d + 2) * 2.0**-23
        upper = scaled[live] @ c.T.astype(np.float32)
        for row, i in enumerate(some[live].tolist()):
            bound = upper[row] + (base[live[row]] + margin[row])
            near = np.flatnonzero((bound >= self.kth[i]) & (ids != self.ids[i]))
            near = near[np.argsort(-bound[near], kind="stable")]
            for at in range(0, len(near), STEP):
                rows = near[at : at + STEP]
                rows = rows[bound[rows] >= self.kth[i]]
                if not len(rows):
                    break  # certain: no later bound reaches the k-th score
                self.read += len(rows)
                scores = exact[rows].astype(np.float64) @ self.f[i]
                good = scores >= self.kth[i]
                if good.any():
                    self._add(i, ids[rows[good]].tolist(), scores[good].astype(np.int64).tolist())

    def _all(self, rows, ids: np.ndarray, x: np.ndarray) -> None:
        """Unbounded integers, for pairs whose scores doubles may not hold."""
        x = x.astype(object)
        self.read += len(rows) * len(x)
        for i in rows:
            other = ids != self.ids[i]
            self._add(i, ids[other].tolist(), [int(s) for s in x[other] @ self.q[i].astype(object)])


def _beyond(score: int) -> bytes | None:
    """Bytes in the order of scores that 64 bits do not hold; null for the others."""
    if -(1 << 63) < score < (1 << 63) - 1:
        return None
    size = abs(score).bit_length() // 8 + 1
    digits = (abs(score) if score > 0 else (1 << 8 * size) - 1 + score).to_bytes(size, "big")
    return ((1 << 15) + (size if score > 0 else -size)).to_bytes(2, "big") + digits


def _grid_rows(batches: Iterator[pa.RecordBatch], k: int) -> Iterator[pa.RecordBatch]:
    """Hits of each cell of the grid, from rows sorted by cell, queries first."""
    import itertools

    late = ("ids", "cells", "low", "width", "exact")
    names = ("row", "col", "asks", "d", "n", "far", *late)
    rows = (r for b in batches for r in zip(*(b.column(c) if c in late else b.column(c).to_pylist() for c in names), strict=True))
    for _, group in itertools.groupby(rows, key=lambda r: r[:2]):
        held: dict[int, list[Cell]] = {}
        for _, _, asks, d, n, far, *parts in group:
            ids = np.frombuffer(parts[0].as_buffer(), "<i8")
            raw = tuple(p.as_py() if i == 3 and far else p.as_buffer() for i, p in enumerate(parts[1:]))
            if asks:
                q = _matrix(raw[3].split(b"\n")) if far else np.frombuffer(raw[3], "<i8").reshape(n, d)
                held.setdefault(d, []).append(Cell(ids, q, k))
            else:
                for cell in held.get(d, []):
                    cell.scan(ids, far, raw)
        for cell in itertools.chain.from_iterable(held.values()):
            out = [(i, key, v, max(min(s, (1 << 63) - 1), -(1 << 63)), _beyond(s)) for i, key, hits in zip(cell.ids.tolist(), _row_hash(cell.q).tolist(), cell.hits, strict=True) for s, v in hits]
            if out:
                kinds = [pa.int64(), pa.int64(), pa.int64(), pa.int64(), pa.binary()]
                yield pa.RecordBatch.from_arrays([pa.array(c, t) for c, t in zip(zip(*out, strict=True), kinds, strict=True)], names=["query_id", "query_key", "vec_id", "score", "beyond"])


def _row_hash(q: np.ndarray) -> np.ndarray:
    """A hash of each query vector, which tells queries of one id apart."""
    low = np.array([[int(v) & ((1 << 64) - 1) for v in r] for r in q], np.uint64) if q.dtype == object else q.astype(np.uint64)
    h = np.zeros(len(low), np.uint64)
    for column in low.T:
        h = bytehash.mix(h ^ column, 33)
    return h.view(np.int64)


def approximate(vectors: DataFrame, *, vec_id: str = "vec_id", embedding: str = "embedding", most: int | None = K + 1) -> DataFrame:
    """The approximation file of ``vectors``: one row a block. ``most`` rows are kept of equal vectors, or all."""
    rows = vectors.select(F.col(vec_id).cast("long").alias("vec_id"), F.col(embedding).alias("embedding")).where("vec_id is not null and embedding is not null").mapInArrow(_raw, _RAW)
    if most is not None:
        # equal vectors meet after each task has kept its smallest ids of them
        few = Window.partitionBy("d", "vector").orderBy("vec_id")
        rows = rows.withColumn("nth", F.row_number().over(few)).where(F.col("nth") <= most).drop("nth")
    return materialise(rows.sortWithinPartitions("d", "vector", "vec_id").mapInArrow(_blocks, _FILE), "vectors", "none")


def top_k(vectors: DataFrame, queries: DataFrame, *, vec_id: str = "vec_id", embedding: str = "embedding", k: int = K, column: int = COLUMN, work: int = WORK) -> DataFrame:
    """``query_id, rank, vec_id, score`` of each query row's k best among ``vectors``.

    A task sees a few blocks at a time if the session bounds Arrow batches
    (``common.bounded_batches``).
    """
    spark = vectors.sparkSession
    file = approximate(vectors, vec_id=vec_id, embedding=embedding, most=k + 1)
    asked = queries.select(F.col(vec_id).alias("vec_id"), F.col(embedding).alias("embedding")).distinct()
    asked = approximate(asked, most=None).drop("cells", "low", "width")
    n_vectors, n_blocks = file.agg(F.coalesce(F.sum("n"), F.lit(0)), F.count(F.lit(1))).first()
    n_asked = asked.agg(F.coalesce(F.sum("n"), F.lit(0))).first()[0]
    columns = max(1, math.ceil(n_asked / column))
    tasks = max(int(spark.conf.get("spark.sql.shuffle.partitions")), math.ceil(n_vectors * n_asked / work))
    rows = max(1, min(n_blocks, math.ceil(tasks / columns)))

    def every(n: int):
        return F.explode(F.sequence(F.lit(0), F.lit(n - 1)))

    none = F.lit(None).cast("binary")
    left = asked.select(every(rows).alias("row"), F.pmod("block", F.lit(columns)).cast("int").alias("col"), F.lit(True).alias("asks"), "block", "d", "n", "far", "ids", none.alias("cells"), none.alias("low"), none.alias("width"), "exact")
    right = file.select(F.pmod("block", F.lit(rows)).cast("int").alias("row"), every(columns).alias("col"), F.lit(False).alias("asks"), "block", "d", "n", "far", "ids", "cells", "low", "width", "exact")
    grid = left.unionByName(right).repartition("row", "col").sortWithinPartitions("row", "col", F.desc("asks"), "block")
    hits = grid.drop("block").mapInArrow(lambda it: _grid_rows(it, k), "query_id long, query_key long, vec_id long, score long, beyond binary")
    # scores that 64 bits do not hold come first among the largest and last among the smallest
    order = Window.partitionBy("query_id", "query_key").orderBy(F.desc("score"), F.desc_nulls_last("beyond"), F.asc("vec_id"))
    return hits.withColumn("rank", F.row_number().over(order)).where(F.col("rank") <= k).select("query_id", "rank", "vec_id", "score")


portable(__name__)
