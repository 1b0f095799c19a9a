"""k-means over integer vectors, with a pivot table that spares exact distances.

A vector's distances to a few fixed pivots are computed once and stored with it (LAESA). In
every round the difference between a vector's and a centroid's distance to the same pivot
bounds their own distance from below; only centroids that the bounds cannot rule out get an
exact integer distance.
"""

from __future__ import annotations

import hashlib
import uuid
from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F
from pyspark.sql.types import DecimalType

from roomtable.llm.shared import cut_lineage, ensure_checkpoint_dir

DIMENSIONS = 64
CENTROIDS = 40
ROUNDS = 5
PIVOTS = 8
SEED = 2
SCALE = 256
#: Largest finite 32-bit float.
LARGEST = float(np.finfo(np.float32).max)
#: Up to this size of a component 64-bit integers hold every squared distance; beyond it Python's do.
_NARROW = 1 << 27
#: Share by which float bounds are loosened, far above their rounding.
_SLACK = 1e-9
_AT_ONCE = 4096
#: Sums travel as two numbers, as large floats pass 38 digits.
_LIMB = 10**30
_STORED = "vec_id long, components binary, wide array<string>, pivots binary"


def whole_components(embedding: np.ndarray) -> np.ndarray:
    """floor(SCALE * x) of each component: int64 if all fit, else Python integers."""
    scaled = np.floor(embedding.astype(np.float64) * SCALE)
    return _integers([[int(x) for x in row] for row in scaled.tolist()]) if np.abs(scaled).max(initial=0) > _NARROW else scaled.astype(np.int64)


def _integers(rows: list[list[int]]) -> np.ndarray:
    out = np.array(rows, object)
    return out.astype(np.int64) if max(map(abs, out.ravel().tolist()), default=0) <= _NARROW else out


def squared(a: np.ndarray, b: np.ndarray) -> np.ndarray:
    """Exact squared distances of the rows of `a` from those of `b` at the same places."""
    step = a - b
    return (step * step).sum(axis=1)


def _roots(exact: np.ndarray) -> np.ndarray:
    return np.sqrt(exact.astype(np.float64))


def pivot_distances(vectors: np.ndarray, pivots: np.ndarray) -> np.ndarray:
    """Distances of all rows of `vectors` from all pivots, one column each."""
    return np.stack([_roots(squared(vectors, p[None])) for p in pivots], axis=1).reshape(len(vectors), len(pivots))


def nearest(vectors: np.ndarray, stored: np.ndarray, centroids: np.ndarray, pivots: np.ndarray) -> tuple[np.ndarray, np.ndarray, int]:
    """(cluster, exact squared distance) of each row, ties to the smaller number; exact distances made.

    `stored` has the rows' pivot distances. The centroid of the smallest bound is measured
    first; every other one whose bound is not above that distance follows.
    """
    own = pivot_distances(centroids, pivots)
    bound = np.zeros((len(vectors), len(centroids)))
    for p in range(len(pivots)):
        np.maximum(bound, np.abs(stored[:, p, None] - own[None, :, p]), out=bound)
    # both distances are rounded: the bound is lowered by a share of the larger one
    bound -= _SLACK * (stored.max(axis=1, initial=0.0)[:, None] + own.max(axis=1, initial=0.0)[None])
    first = bound.argmin(axis=1)
    best, distance = first.copy(), squared(vectors, centroids[first])
    near = bound <= _roots(distance)[:, None] * (1 + _SLACK)
    near[np.arange(len(vectors)), first] = False
    row, number = np.nonzero(near)
    made = len(vectors) + len(row)
    exact = np.concatenate([squared(vectors[row[k : k + _AT_ONCE]], centroids[number[k : k + _AT_ONCE]]) for k in range(0, len(row), _AT_ONCE)]) if len(row) else distance[:0]
    for c in range(len(centroids)):
        at, d = row[number == c], exact[number == c]
        better = (d < distance[at]) | ((d == distance[at]) & (c < best[at]))
        best[at[better]], distance[at[better]] = c, d[better]
    return best, distance, made


def _written(ids: pa.Array, vectors: np.ndarray, stored: np.ndarray) -> pa.RecordBatch:
    narrow = vectors.dtype != object
    packed = [r.tobytes() for r in vectors.astype(np.int32)] if narrow else [None] * len(vectors)
    wide = [None] * len(vectors) if narrow else [[str(x) for x in r] for r in vectors.tolist()]
    columns = [ids, pa.array(packed, pa.binary()), pa.array(wide, pa.list_(pa.string())), pa.array([r.tobytes() for r in stored], pa.binary())]
    return pa.RecordBatch.from_arrays(columns, ["vec_id", "components", "wide", "pivots"])


def _read(batch: pa.RecordBatch, n_pivots: int) -> tuple[np.ndarray, np.ndarray]:
    """Components and pivot distances of stored rows."""
    packed, wide = batch.column("components").to_pylist(), batch.column("wide")
    stored = np.frombuffer(b"".join(batch.column("pivots").to_pylist()), np.float64).reshape(batch.num_rows, n_pivots)
    if wide.null_count == batch.num_rows:
        return np.frombuffer(b"".join(packed), np.int32).astype(np.int64).reshape(batch.num_rows, DIMENSIONS), stored
    rows = [np.frombuffer(c, np.int32).tolist() if w is None else [int(x) for x in w] for c, w in zip(packed, wide.to_pylist(), strict=True)]
    return np.array(rows, object), stored


def kept_vectors(embeddings: DataFrame) -> DataFrame:
    """(vec_id, embedding) of the rows with exactly DIMENSIONS components, none null or beyond a finite float."""
    finite = F.forall("embedding", lambda x: x.isNotNull() & (F.abs(x.cast("double")) <= LARGEST))
    good = F.when(F.size("embedding") == DIMENSIONS, finite)
    return embeddings.select(F.col("vec_id").cast("long").alias("vec_id"), F.col("embedding").cast("array<double>").alias("embedding")).where(good)


def seeds(kept: DataFrame, count: int, salt: int) -> list[list[float]]:
    """Vectors of the `count` smallest sha256 of `salt:vec_id`; repeated ids by components. Rows without id seed nothing."""
    order = F.sha2(F.concat(F.lit(f"{salt}:"), F.col("vec_id").cast("string")), 256)
    first = kept.where("vec_id is not null").orderBy(order, "embedding").limit(count)
    return [list(r["embedding"]) for r in first.collect()]


def _store(pivots: np.ndarray):
    def rows(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            for k in range(0, batch.num_rows, _AT_ONCE):
                part = batch.slice(k, _AT_ONCE)
                vectors = whole_components(part.column("embedding").flatten().to_numpy().reshape(part.num_rows, DIMENSIONS))
                yield _written(part.column("vec_id"), vectors, pivot_distances(vectors, pivots))

    return rows


def _assign(centroids: np.ndarray, pivots: np.ndarray):
    def rows(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            for k in range(0, batch.num_rows, _AT_ONCE):
                part = batch.slice(k, _AT_ONCE)
                vectors, stored = _read(part, len(pivots))
                best, distance, _ = nearest(vectors, stored, centroids, pivots)
                yield pa.RecordBatch.from_arrays(
                    [part.column("vec_id"), pa.array(best.astype(np.int32)), pa.array([str(d) for d in distance.tolist()])], ["vec_id", "cluster", "distance"]
                )

    return rows


def _sums(centroids: np.ndarray, pivots: np.ndarray):
    """One row (cluster, n, sums as high * _LIMB + low) for each cluster that a task's vectors are nearest to."""

    def rows(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        count = [0] * len(centroids)
        total = [[0] * DIMENSIONS for _ in centroids]
        for batch in batches:
            for k in range(0, batch.num_rows, _AT_ONCE):
                vectors, stored = _read(batch.slice(k, _AT_ONCE), len(pivots))
                best, _, _ = nearest(vectors, stored, centroids, pivots)
                for c in np.unique(best).tolist():
                    own = vectors[best == c]
                    count[c] += len(own)
                    total[c] = [a + b for a, b in zip(total[c], own.sum(axis=0).tolist(), strict=True)]
        met = [c for c in range(len(centroids)) if count[c]]
        text = pa.list_(pa.string())
        columns = [pa.array(met, pa.int32()), pa.array([count[c] for c in met], pa.int64())]
        columns += [pa.array([[str(divmod(x, _LIMB)[k]) for x in total[c]] for c in met], text) for k in (0, 1)]
        yield pa.RecordBatch.from_arrays(columns, ["cluster", "n", "high", "low"])

    return rows


def _moved(stored: DataFrame, centroids: np.ndarray, pivots: np.ndarray) -> np.ndarray:
    """Centroids after one round: componentwise exact floor of the mean, empty ones as they were."""
    parts = stored.mapInArrow(_sums(centroids, pivots), "cluster int, n long, high array<string>, low array<string>")
    at = parts.select("cluster", "n", F.posexplode(F.arrays_zip("high", "low")).alias("pos", "x"))
    number = [F.sum(F.col(f"x.{k}").cast(DecimalType(38, 0))).alias(k) for k in ("high", "low")]
    out = centroids.tolist()
    for r in at.groupBy("cluster", "pos").agg(F.sum("n").alias("n"), *number).collect():  # at most centroids * DIMENSIONS rows
        out[r["cluster"]][r["pos"]] = (int(r["high"]) * _LIMB + int(r["low"])) // r["n"]
    return _integers(out)


def clustered(embeddings: DataFrame, count: int = CENTROIDS, rounds: int = ROUNDS, n_pivots: int = PIVOTS, salt: int = SEED) -> DataFrame:
    """vec_id, cluster, distance, cluster_inertia, inertia and centroid_sha256 of every kept vector.

    Kept are vectors of exactly DIMENSIONS components, none null or beyond a finite 32-bit
    float; each component becomes floor(SCALE * x). Centroids start as the vectors of the smallest
    sha256 of `salt:vec_id` and move `rounds` times to the floor of their vectors' mean;
    empty ones stay. The pivots are the first `n_pivots` of the starting centroids. Fewer
    vectors than centroids give fewer centroids; rows without vec_id are clustered but
    seed nothing (no row with an id: no rows); repeated rows stay repeated. Sums and
    distances are exact at any size; one that passes 63 bits comes as null.

    Vectors and pivot distances are written once to the shared folder; a round reads them
    and sends one row a cluster and task. Only centroids reach the driver.
    """
    spark = embeddings.sparkSession
    ensure_checkpoint_dir(spark)
    kept = kept_vectors(embeddings)
    start = seeds(kept, count, salt)
    if not start:
        none = kept.where("false")
        return none.select("vec_id", *(F.lit(None).cast(kind).alias(name) for name, kind in (("cluster", "int"), ("distance", "long"), ("cluster_inertia", "long"), ("inertia", "long"), ("centroid_sha256", "string"))))
    centroids = whole_components(np.array(start))
    pivots = centroids[:n_pivots]
    folder = f"{spark.sparkContext.getCheckpointDir()}/pivots-{uuid.uuid4().hex}"
    kept.mapInArrow(_store(pivots), _STORED).write.parquet(folder)
    stored = spark.read.parquet(folder)
    for _ in range(rounds):
        centroids = _moved(stored, centroids, pivots)
    last = stored.mapInArrow(_assign(centroids, pivots), "vec_id long, cluster int, distance string")
    last = cut_lineage(last.withColumn("distance", F.col("distance").try_cast(DecimalType(38, 0))))
    whole = F.when(F.count("distance") == F.count("*"), F.try_sum("distance"))
    found = {r["cluster"]: None if r["d"] is None else int(r["d"]) for r in last.groupBy("cluster").agg(whole.alias("d")).collect()}
    total = None if None in found.values() else sum(found.values())
    facts = [(c, _long(d), _long(total), hashlib.sha256(",".join(map(str, centroids[c].tolist())).encode()).hexdigest()) for c, d in found.items()]
    facts = spark.createDataFrame(facts, "cluster int, cluster_inertia long, inertia long, centroid_sha256 string")
    return last.join(F.broadcast(facts), "cluster").select(
        "vec_id", "cluster", F.col("distance").try_cast("long").alias("distance"), "cluster_inertia", "inertia", "centroid_sha256"
    )


def _long(x: int | None) -> int | None:
    return x if x is not None and x < 2**63 else None
