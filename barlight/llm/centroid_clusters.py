"""k-means over integer vectors; the nearest centroid is found by the threshold algorithm.

For each dimension the centroids' values are a sorted list. A vector enters every list at its own value and walks outward, one centroid a
step and list; what it meets for the first time gets its exact distance. The squared gaps at which the lists stand sum to a bound
below the distance of everything not met yet: a vector stops when that sum strictly exceeds its best exact distance, or when nothing is left
to meet. So ties are seen, and go to the smaller number. All vectors of an Arrow batch walk together.

A round is one pass over the table of vectors, written once. Each batch leaves sums and counts by centroid; only their totals, one row a
component of a centroid, reach the driver, where the means are floored in exact integers. Centroids (k of them, as many components as `dims`) travel with the task.

Defined cases: vectors that are null, of another length or with a null or non-finite component are left out; integers beyond 2^48
are held at 2^48 and distances and inertia at 2^63 - 1; a null id is hashed as an empty one; repeated rows are each a vector (at the
start ordered by their components); with fewer than k vectors there are as many centroids; an empty table gives an empty result; other columns are ignored.
"""

from __future__ import annotations

from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from barlight.llm.shared import written
from barlight.sources.scratch import cleared

SCALE, MOST, PLAIN, LARGEST = 1024, 1 << 48, 1 << 27, (1 << 63) - 1  # up to PLAIN, distances of few thousand components fit 64 bits
PAIRS = 1 << 14  # exact distances computed at once


def integers(vector: Column) -> Column:
    """floor(1024 * x) of each component, x as double."""
    return F.transform(vector, lambda x: F.floor(F.greatest(F.least(x.cast("double") * SCALE, F.lit(float(MOST))), F.lit(float(-MOST)))).cast("long"))


def kept(vectors: DataFrame, dims: int, vec_id: str, vector: str) -> DataFrame:
    """vec_id and v, the integers, of vectors with exactly dims finite components."""
    x = F.col(vector)
    bad = F.exists(x, lambda c: F.coalesce(F.isnan(c) | (F.abs(c) == float("inf")), F.lit(True)))
    return vectors.where((F.size(x) == dims) & ~bad).select(F.col(vec_id).cast("long").alias("vec_id"), integers(x).alias("v"))


class Lists:
    """Centroids as one sorted list for each dimension."""

    def __init__(self, centroids: np.ndarray) -> None:
        self.centroids = centroids
        self.order = np.argsort(centroids, axis=0, kind="stable").T  # [dim, place]: number of a centroid
        self.values = np.take_along_axis(centroids.T, self.order, 1)

    def nearest(self, v: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
        """Number and squared distance of the nearest centroid of each row of v; exact in Python's integers (dtype object) or 64 bits."""
        (n, dims), k = v.shape, len(self.centroids)
        right = np.stack([np.searchsorted(self.values[d], v[:, d]) for d in range(dims)], 1)  # the next place upward in each list
        left = right - 1
        best, number, met = np.full(n, -1, v.dtype), np.zeros(n, np.int64), np.zeros((n, k), bool)
        rows, every = np.arange(n), np.arange(dims)
        while len(rows):
            lo, hi, x = left[rows], right[rows], v[rows]
            down = x - self.values[every, np.maximum(lo, 0)]
            up = self.values[every, np.minimum(hi, k - 1)] - x
            go_down = (hi == k) | (lo >= 0) & (down <= up)
            gap = np.where(go_down, down, up)
            new = np.zeros((len(rows), k), bool)
            new[np.arange(len(rows))[:, None], self.order[every, np.where(go_down, lo, hi)]] = True
            new &= ~met[rows]
            met[rows] |= new
            at, c = np.nonzero(new)
            for i in range(0, len(at), PAIRS):
                self.meet(v, rows[at[i : i + PAIRS]], c[i : i + PAIRS], best, number)
            left[rows], right[rows] = lo - go_down, hi + ~go_down
            rows = rows[~met[rows].all(1) & ((gap * gap).sum(1) <= best[rows])]
        return number, best

    def meet(self, v: np.ndarray, row: np.ndarray, c: np.ndarray, best: np.ndarray, number: np.ndarray) -> None:
        """Exact distances of some pairs; the best of each row is kept, of equal ones the smaller number."""
        away = v[row] - self.centroids[c]
        distance = (away * away).sum(1)
        order = np.lexsort((c, distance, row))
        first = order[np.concatenate([[True], row[order][1:] != row[order][:-1]])]
        r, d, n = row[first], distance[first], c[first]
        better = (best[r] < 0) | (d < best[r]) | (d == best[r]) & (n < number[r])
        best[r[better]], number[r[better]] = d[better], n[better]


def assigned(batch: pa.RecordBatch, plain: Lists, exact: Lists) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
    """Vectors of a batch, their centroids and distances. Vectors with large components go by Python's integers."""
    v = batch.column("v").flatten().to_numpy().reshape(batch.num_rows, -1)
    large = (np.abs(v) > PLAIN).any(1) | bool((np.abs(plain.centroids) > PLAIN).any())
    number, distance = np.zeros(len(v), np.int64), np.zeros(len(v), np.int64)
    number[~large], distance[~large] = plain.nearest(v[~large])
    if large.any():
        number[large], far = exact.nearest(v[large].astype(object))
        distance[large] = np.minimum(far, LARGEST).astype(np.int64)
    return v, number, distance


def both(centroids: list[list[int]]) -> tuple[Lists, Lists]:
    return Lists(np.array(centroids, np.int64)), Lists(np.array(centroids, object))


def moved(table: DataFrame, centroids: list[list[int]]) -> list[list[int]]:
    """Centroids after a round: the floored means of their vectors, those without any as before."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        lists = both(centroids)
        for batch in batches:
            if batch.num_rows:
                v, number, _ = assigned(batch, *lists)
                used = np.unique(number)
                sums = np.array([v[number == c].sum(0) for c in used])  # 2^14 rows of 2^48 fit
                count = np.bincount(number)[used]
                yield pa.RecordBatch.from_arrays([pa.array(used), pa.array(count), pa.array(list(sums), pa.list_(pa.int64()))], ["c", "n", "s"])

    parts = table.select("v").mapInArrow(run, "c long, n long, s array<long>")
    totals = parts.select("c", "n", F.posexplode("s").alias("d", "x")).groupBy("c", "d").agg(F.sum("n").alias("n"), F.sum(F.col("x").cast("decimal(28,0)")).alias("s"))
    out = [list(c) for c in centroids]
    for r in totals.collect():  # a row a component of a centroid
        out[r.c][r.d] = int(r.s) // r.n
    return out


def cluster(vectors: DataFrame, k: int = 8, rounds: int = 10, dims: int = 64, seed: int = 3, vec_id: str = "vec_id", vector: str = "embedding") -> DataFrame:
    """vec_id, cluster, distance, cluster_inertia, inertia and centroid (its components) of every vector that is kept."""
    with cleared(vectors.sparkSession) as keep:
        table = written(kept(vectors, dims, vec_id, vector), "vectors")
        hashed = F.sha2(F.concat(F.lit(f"{seed}:"), F.coalesce(F.col("vec_id").cast("string"), F.lit(""))), 256)
        start = table.select(hashed.alias("h"), "v").orderBy("h", "v").limit(k).collect()
        centroids = [list(r.v) for r in start]
        for _ in range(rounds if start else 0):
            centroids = moved(table, centroids)

        def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
            lists = both(centroids) if centroids else None
            for batch in batches:
                if batch.num_rows:
                    _, number, distance = assigned(batch, *lists)
                    yield pa.RecordBatch.from_arrays([batch.column("vec_id"), pa.array(number.astype(np.int32)), pa.array(distance)], ["vec_id", "cluster", "distance"])

        found = keep(written(table.mapInArrow(run, "vec_id long, cluster int, distance long"), "clusters"))
        sums = {r.cluster: int(r.s) for r in found.groupBy("cluster").agg(F.sum(F.col("distance").cast("decimal(28,0)")).alias("s")).collect()}  # a row a centroid
    total = min(sum(sums.values()), LARGEST)
    rows = [(c, min(s, LARGEST), total, centroids[c]) for c, s in sorted(sums.items())]
    of = vectors.sparkSession.createDataFrame(rows, "cluster int, cluster_inertia long, inertia long, centroid array<long>")
    return found.join(F.broadcast(of), "cluster").select("vec_id", "cluster", "distance", "cluster_inertia", "inertia", "centroid")


def digest(clusters: DataFrame) -> DataFrame:
    """With the centroid's sha256 in its place."""
    return clusters.select("vec_id", "cluster", "distance", "cluster_inertia", "inertia", F.sha2(F.array_join(F.col("centroid").cast("array<string>"), ","), 256).alias("centroid_sha256"))


def oracle(k: int = 8, rounds: int = 10, dims: int = 64, seed: int = 3) -> str:
    """The same question in SQL: every distance of every round."""
    steps = []
    for i in range(rounds + 1):
        steps.append(f"""
d{i} AS MATERIALIZED (SELECT p.r, c.c, CAST(sum((p.x - c.x) * (p.x - c.x)) AS BIGINT) AS distance FROM parts p JOIN c{i} c ON p.d = c.d GROUP BY p.r, c.c),
a{i} AS MATERIALIZED (SELECT r, min_by(c, distance * {k} + c) AS c, min(distance) AS distance FROM d{i} GROUP BY r)""")
        if i < rounds:
            steps.append(f"""
m{i} AS (SELECT a.c, p.d, sum(p.x) AS s, count(*) AS n FROM a{i} a JOIN parts p USING (r) GROUP BY a.c, p.d),
c{i + 1} AS MATERIALIZED (SELECT c.c, c.d, coalesce(CAST((s - ((s % n) + n) % n) // n AS BIGINT), c.x) AS x FROM c{i} c LEFT JOIN m{i} m ON c.c = m.c AND c.d = m.d)""")
    return f"""
WITH given AS (SELECT vec_id, list_transform(embedding, lambda x: CAST(floor({SCALE} * CAST(x AS DOUBLE)) AS BIGINT)) AS v FROM embeddings
  WHERE len(embedding) = {dims} AND len(list_filter(embedding, lambda x: x IS NOT NULL AND isfinite(x))) = {dims}),
numbered AS MATERIALIZED (SELECT row_number() OVER (ORDER BY sha256('{seed}:' || coalesce(CAST(vec_id AS VARCHAR), '')), v) - 1 AS r, vec_id, v FROM given),
parts AS MATERIALIZED (SELECT r, unnest(v) AS x, unnest(range({dims})) AS d FROM numbered),
c0 AS MATERIALIZED (SELECT r AS c, d, x FROM parts WHERE r < {k}),{",".join(steps)},
named AS (SELECT c, sha256(string_agg(CAST(x AS VARCHAR), ',' ORDER BY d)) AS centroid_sha256 FROM c{rounds} GROUP BY c)
SELECT n.vec_id, CAST(a.c AS INT) AS cluster, a.distance, CAST(sum(a.distance) OVER (PARTITION BY a.c) AS BIGINT) AS cluster_inertia,
       CAST(sum(a.distance) OVER () AS BIGINT) AS inertia, centroid_sha256
FROM a{rounds} a JOIN numbered n USING (r) JOIN named USING (c)
"""
