"""Exact centroid clustering over Hilbert-ordered zone maps.

1. A vector is kept if it has exactly DIMS components, none null or not
   finite; component x becomes the integer floor(SCALE * x).
2. Kept vectors are sorted along a Hilbert curve through the grid of BITS bits
   a component (cells follow each component's mean and spread, two numbers per
   component from one aggregate). The range sort deals equal vectors out by a
   second, row-wise key, so one very common vector fills many tasks.
3. Runs of BLOCK vectors become blocks. The first row of a block carries its
   zone map: the smallest and largest value and the sum of each component.
4. Each round reads the blocks once. The squared distance from a centroid to a
   block's box is a lower bound for all its vectors, and the distance to the
   box's farthest corner an upper bound; centroids whose lower bound exceeds
   the least upper bound cannot be nearest for any vector of the block. Only
   the others are compared, by exact integer arithmetic. A block with a single
   candidate adds its stored sum without a look at its vectors.
5. Every task sends one partial sum per centroid and component; Spark adds
   them and k * (DIMS + 2) numbers reach the driver, which moves the centroids.

Results do not depend on the order of the vectors, the blocks or the partitions:
the bounds only leave out centroids that cannot win.

Defined cases: ids may repeat or be null (each row is a vector of its own; a
row without an id cannot be a starting centroid); starting centroids with the
same hash are taken by their components; with fewer vectors than centroids
there are fewer centroids; no vectors, no rows. Components beyond +-LIMIT after
scaling raise an error, because squared distances would not fit a long.
"""

from __future__ import annotations

import hashlib
from collections.abc import Iterator
from dataclasses import dataclass

import numpy as np
import pyarrow as pa
import pyarrow.compute as pc
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from feira.llm._ship import map_arrow
from feira.llm._store import cut

DIMS = 64
SCALE = 64
BITS = 2
BLOCK = 256
LIMIT = 1 << 27
#: up to this size of a component, squared distances are whole numbers below 2^53 and floats hold them exactly
FLOAT_LIMIT = 1 << 21


def _quantised(lists: pa.Array) -> tuple[np.ndarray, np.ndarray]:
    """(rows that are kept, their integer components)."""
    whole = pc.fill_null(pc.equal(pc.list_value_length(lists), DIMS), False).to_numpy(zero_copy_only=False)
    at = np.flatnonzero(whole)
    if not len(at):
        return at, np.zeros((0, DIMS), np.int64)
    flat = lists.take(pa.array(at)).flatten().cast(pa.float64())
    values = pc.fill_null(flat, float("nan")).to_numpy(zero_copy_only=False).reshape(-1, DIMS)
    finite = np.isfinite(values).all(1)
    scaled = np.floor(values[finite] * SCALE)
    if scaled.size and np.abs(scaled).max() > LIMIT:
        raise ValueError(f"a vector component beyond +-{LIMIT // SCALE}: squared distances would not fit a long")
    return at[finite], scaled.astype(np.int64)


def _binary(matrix: np.ndarray) -> pa.Array:
    """Rows of a matrix as values of one fixed length."""
    width = matrix.shape[1] * matrix.itemsize
    offsets = np.arange(0, (len(matrix) + 1) * width, width, dtype=np.int32)
    return pa.BinaryArray.from_buffers(pa.binary(), len(matrix),
                                       [None, pa.py_buffer(offsets.tobytes()), pa.py_buffer(np.ascontiguousarray(matrix).tobytes())])


def _matrix(values: pa.Array) -> np.ndarray:
    return np.frombuffer(b"".join(values.to_pylist()), np.int32).reshape(-1, DIMS)


def integer_vectors(vectors: DataFrame, id_col: str = "vec_id", vec_col: str = "embedding") -> DataFrame:
    """(vec_id, vec): the kept vectors, ``vec`` as DIMS little-endian 32-bit integers."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            at, q = _quantised(batch.column("vec"))
            yield pa.RecordBatch.from_arrays([batch.column("vec_id").take(pa.array(at)), _binary(q.astype("<i4"))],
                                             ["vec_id", "vec"])

    rows = vectors.select(F.col(f"`{id_col}`").alias("vec_id"), F.col(f"`{vec_col}`").alias("vec"))
    return map_arrow(rows, run, f"vec_id {rows.schema['vec_id'].dataType.simpleString()}, vec binary")


def _spread(ints: DataFrame) -> tuple[np.ndarray, np.ndarray]:
    """Mean and standard deviation of each component (DIMS rows reach the driver)."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        n, total, square = 0, np.zeros(DIMS), np.zeros(DIMS)
        for batch in batches:
            q = _matrix(batch.column("vec")).astype(np.float64)
            n, total, square = n + len(q), total + q.sum(0), square + (q * q).sum(0)
        yield pa.RecordBatch.from_arrays([pa.array(np.arange(DIMS), pa.int64()), pa.array(np.full(DIMS, float(n))),
                                          pa.array(total), pa.array(square)], ["dim", "n", "s", "ss"])

    sums = (map_arrow(ints.select("vec"), run, "dim long, n double, s double, ss double")
            .groupBy("dim").agg(F.sum("n").alias("n"), F.sum("s").alias("s"), F.sum("ss").alias("ss")).toPandas())
    sums = sums.sort_values("dim")
    n = max(float(sums["n"].max() if len(sums) else 0), 1.0)
    if not len(sums):
        return np.zeros(DIMS), np.ones(DIMS)
    mean = sums["s"].to_numpy() / n
    return mean, np.sqrt(np.maximum(sums["ss"].to_numpy() / n - mean * mean, 1e-9))


def hilbert_keys(cells: np.ndarray, bits: int = BITS) -> np.ndarray:
    """Bytes of the Hilbert index of grid cells [n, dims] of ``bits`` bits each; bytewise order is curve order."""
    x = cells.astype(np.uint32).T.copy()
    dims = len(x)
    q = 1 << (bits - 1)
    while q > 1:  # undo the rotations from the coarsest cell down
        low = np.uint32(q - 1)
        for i in range(dims):
            high = (x[i] & np.uint32(q)) != 0
            swap = np.where(high, np.uint32(0), (x[0] ^ x[i]) & low)
            x[0] ^= np.where(high, low, swap)
            if i:
                x[i] ^= swap
        q >>= 1
    for i in range(1, dims):
        x[i] ^= x[i - 1]
    fix, q = np.zeros(x.shape[1], np.uint32), 1 << (bits - 1)
    while q > 1:
        fix ^= np.where((x[-1] & np.uint32(q)) != 0, np.uint32(q - 1), np.uint32(0))
        q >>= 1
    x ^= fix
    planes = [(x >> np.uint32(b)) & np.uint32(1) for b in range(bits - 1, -1, -1)]
    return np.packbits(np.concatenate(planes).T.astype(np.uint8), axis=1)


def in_blocks(ints: DataFrame, block: int = BLOCK) -> DataFrame:
    """(vec_id, vec, size, zone) in curve order; the first row of a block has
    its number of vectors and its zone map, other rows have nulls there.
    Checkpointed, so every round reads the same blocks."""
    mean, std = _spread(ints)

    def keys(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        half = 1 << (BITS - 1)
        for batch in batches:
            q = _matrix(batch.column("vec"))
            cells = np.clip(np.floor((q - mean) / (std * (1.35 / half))) + half, 0, 2 * half - 1)
            curve = hilbert_keys(cells) if len(q) else np.zeros((0, DIMS * BITS // 8), np.uint8)
            yield pa.RecordBatch.from_arrays([*batch.columns, _binary(curve)], [*batch.schema.names, "curve"])

    def zones(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        waiting: list[pa.RecordBatch] = []

        def out(part: pa.Table) -> pa.RecordBatch:
            q = _matrix(part["vec"])
            zone = (np.concatenate([q.min(0), q.max(0)]).astype("<i4").tobytes()
                    + q.sum(0, dtype=np.int64).astype("<i8").tobytes())
            rest = [None] * (len(q) - 1)
            return pa.RecordBatch.from_arrays(
                [part["vec_id"].combine_chunks(), part["vec"].combine_chunks(), pa.array([len(q), *rest], pa.int32()),
                 pa.array([zone, *rest], pa.binary())], ["vec_id", "vec", "size", "zone"])

        for batch in batches:
            waiting.append(batch.select(["vec_id", "vec"]))
            if sum(b.num_rows for b in waiting) >= block:
                table = pa.Table.from_batches(waiting)
                whole = len(table) // block * block
                for start in range(0, whole, block):
                    yield out(table.slice(start, block))
                waiting = table.slice(whole).to_batches()
        table = pa.Table.from_batches(waiting) if waiting else None
        if table is not None and len(table):
            yield out(table)

    id_type = ints.schema["vec_id"].dataType.simpleString()
    dealt = (map_arrow(ints, keys, f"vec_id {id_type}, vec binary, curve binary")
             .withColumn("row", F.xxhash64("vec_id", F.monotonically_increasing_id())))
    ordered = dealt.repartitionByRange("curve", "row").sortWithinPartitions("curve", "row").select("vec_id", "vec")
    return cut(map_arrow(ordered, zones, f"vec_id {id_type}, vec binary, size int, zone binary"))


@dataclass
class Zone:
    low: np.ndarray
    high: np.ndarray
    total: np.ndarray


def _read_blocks(batches: Iterator[pa.RecordBatch]) -> Iterator[tuple[Zone, pa.Table]]:
    """The blocks of a partition; a block may lie in several batches."""
    waiting: pa.Table | None = None
    for batch in batches:
        table = pa.Table.from_batches([batch])
        waiting = table if waiting is None else pa.concat_tables([waiting, table])
        while len(waiting):
            size = waiting["size"][0].as_py()
            if size > len(waiting):
                break
            zone = waiting["zone"][0].as_py()
            box = np.frombuffer(zone[:8 * DIMS], "<i4").astype(np.int64)
            yield (Zone(box[:DIMS], box[DIMS:], np.frombuffer(zone[8 * DIMS:], "<i8").astype(np.int64)),
                   waiting.slice(0, size))
            waiting = waiting.slice(size)


def candidates(zone: Zone, centroids: np.ndarray) -> np.ndarray:
    """The centroids that can be nearest to a vector inside the box, ascending."""
    below, above = zone.low - centroids, centroids - zone.high
    near = np.maximum(np.maximum(below, above), 0)
    far = np.maximum(np.abs(below), np.abs(above))
    return np.flatnonzero((near * near).sum(1) <= (far * far).sum(1).min())


def nearest(q: np.ndarray, zone: Zone, centroids: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    """(cluster, squared distance) of the vectors of one block, exactly; ties go to the smaller number."""
    some = candidates(zone, centroids)
    c = centroids[some]
    if max(np.abs(zone.low).max(), np.abs(zone.high).max(), np.abs(c).max()) <= FLOAT_LIMIT:
        x, y = q.astype(np.float64), c.astype(np.float64)
        d = ((x * x).sum(1)[:, None] - 2 * (x @ y.T) + (y * y).sum(1)).astype(np.int64)
    else:
        x = q.astype(np.int64)
        d = np.stack([((x - one) ** 2).sum(1) for one in c], 1)
    best = d.argmin(1)
    return some[best], d[np.arange(len(d)), best]


@dataclass
class Totals:
    count: np.ndarray
    total: np.ndarray
    inertia: list[int]


def totals(blocks: DataFrame, centroids: np.ndarray, inertia: bool = False) -> Totals:
    """Count, component sums and (if asked for) inertia of each cluster."""
    k = len(centroids)

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        count, total, spent = np.zeros(k, np.int64), np.zeros((k, DIMS), np.int64), [0] * k
        for zone, rows in _read_blocks(batches):
            some = candidates(zone, centroids)
            if len(some) == 1 and not inertia:
                count[some[0]] += len(rows)
                total[some[0]] += zone.total
                continue
            q = _matrix(rows["vec"])
            cluster, d = nearest(q, zone, centroids)
            for j in np.unique(cluster):
                own = cluster == j
                count[j] += own.sum()
                total[j] += q[own].sum(0, dtype=np.int64)
                spent[j] += int(d[own].astype(object).sum()) if d.max() > 1 << 50 else int(d[own].sum())
        cluster = np.repeat(np.arange(k), DIMS + 2)
        values = [v for j in range(k) for v in (*total[j].tolist(), int(count[j]), spent[j])]
        yield pa.RecordBatch.from_arrays(
            [pa.array(cluster, pa.int32()), pa.array(np.tile(np.arange(DIMS + 2), k), pa.int32()),
             pa.array([str(v) for v in values])], ["cluster", "part", "value"])

    sums = (map_arrow(blocks, run, "cluster int, part int, value string")
            .groupBy("cluster", "part").agg(F.sum(F.col("value").cast("decimal(38,0)")).alias("value")).collect())
    out = Totals(np.zeros(k, object), np.zeros((k, DIMS), object), [0] * k)
    for row in sums:
        if row.part < DIMS:
            out.total[row.cluster, row.part] = int(row.value)
        elif row.part == DIMS:
            out.count[row.cluster] = int(row.value)
        else:
            out.inertia[row.cluster] = int(row.value)
    return out


def starts(ints: DataFrame, k: int, salt: str) -> np.ndarray:
    """The k vectors whose ids have the smallest sha256 of ``salt:id``, in that order."""
    hashed = ints.filter("vec_id IS NOT NULL").withColumn(
        "h", F.sha2(F.concat(F.lit(salt + ":"), F.col("vec_id").cast("string")), 256))
    rows = hashed.orderBy("h", "vec").limit(k).select("vec").collect()
    return np.array([np.frombuffer(bytes(r.vec), "<i4") for r in rows], np.int64).reshape(-1, DIMS)


def moved(centroids: np.ndarray, sums: Totals) -> np.ndarray:
    """Every centroid that has vectors goes to the floor of their mean."""
    out = centroids.copy()
    for j in range(len(centroids)):
        if sums.count[j]:
            out[j] = [int(v) // int(sums.count[j]) for v in sums.total[j]]
    return out


def clusters(vectors: DataFrame, k: int = 16, rounds: int = 3, salt: str = "1",
             id_col: str = "vec_id", vec_col: str = "embedding") -> DataFrame:
    """(vec_id, cluster, distance, cluster_inertia, inertia, centroid_sha256), one row per kept vector."""
    ints = integer_vectors(vectors, id_col, vec_col)
    blocks = in_blocks(ints)
    centroids = starts(blocks, k, salt)
    for _ in range(rounds if len(centroids) else 0):
        centroids = moved(centroids, totals(blocks, centroids))
    spent = totals(blocks, centroids, inertia=True).inertia if len(centroids) else []
    digest = [hashlib.sha256(",".join(map(str, c)).encode()).hexdigest() for c in centroids.tolist()]
    every = sum(spent)

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for zone, rows in _read_blocks(batches):
            if not len(centroids):
                continue
            cluster, d = nearest(_matrix(rows["vec"]), zone, centroids)
            at = pa.array(cluster)
            yield pa.RecordBatch.from_arrays(
                [rows["vec_id"].combine_chunks(), pa.array(cluster, pa.int32()), pa.array(d, pa.int64()),
                 pa.array(spent, pa.int64()).take(at), pa.array(np.full(len(d), every, np.int64)),
                 pa.array(digest, pa.string()).take(at)],
                ["vec_id", "cluster", "distance", "cluster_inertia", "inertia", "centroid_sha256"])

    id_type = blocks.schema["vec_id"].dataType.simpleString()
    return map_arrow(blocks, run, f"vec_id {id_type}, cluster int, distance long, cluster_inertia long, "
                                  "inertia long, centroid_sha256 string")
