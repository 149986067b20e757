"""Exact k-means over whole vectors, with Yinyang's group bounds.

Components become integers, floor(scale * x). The first centroids are the vectors with the smallest
SHA-256 of ``salt`` and their id. Centroids are clustered into groups of about ten once. Each row
carries an upper bound of the distance to its centroid and one lower bound for each group; both move
by how far centroids have moved. Rows whose upper bound is below all lower bounds keep their centroid
(global filter); of the others only groups that may hold a nearer centroid are scanned, exactly.

Rows never leave their partition: a round is one pass that writes rows with their bounds to the
shared folder, and sums of ``k`` clusters that tasks form before the only, small shuffle. The driver
holds ``k`` centroids, a parameter, and nothing that grows with the rows.

All distances and means are exact. Integers below 2^22 are computed as doubles without rounding; sums
are carried in digits to the base 2^22. A vector with a larger component, and every vector while a
centroid has one, is compared with all centroids in Python's integers; that is slow, and right.

Edge cases: vectors that are null, of another length than ``dims``, or that hold null or non-finite
components take no part. A null id takes part and is chosen as a first centroid after all others;
repeated ids are rows of their own, ties in the hash go to the smaller vector. With fewer vectors
than ``k`` there are fewer centroids; an empty table gives no rows. A squared distance or a sum beyond
64 bits is null. Extra columns are ignored.
"""

from __future__ import annotations

import hashlib
import math
from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from .common import Written

BITS = 22
#: Bounds are doubles: what is nearer than this to a bound is scanned.
SLACK = 1e-9
LONG = 1 << 63
#: Sums of so many components make one row.
STRIP = 64
STATE = "vec_id long, v array<int>, wide array<double>, cluster int, upper double, lower array<double>"


def whole_number(x: float, scale: int) -> int:
    """floor(scale * x), exact for any finite x."""
    top, bottom = x.as_integer_ratio()
    return top * scale // bottom


def groups_of(centres: np.ndarray, n: int, rounds: int = 5) -> np.ndarray:
    """The group of each centroid, by a few rounds of plain k-means over the centroids."""
    heads = centres[np.linspace(0, len(centres) - 1, n).astype(int)].copy()
    group = np.zeros(len(centres), dtype=int)
    for _ in range(rounds):
        group = ((centres[:, None] - heads[None]) ** 2).sum(axis=2).argmin(axis=1)
        for g in range(n):
            if (group == g).any():
                heads[g] = centres[group == g].mean(axis=0)
    return group


def squared(x: np.ndarray, centres: np.ndarray) -> np.ndarray:
    """Exact squared distances between whole numbers below 2^22, as doubles."""
    return (x * x).sum(axis=1)[:, None] - 2 * (x @ centres.T) + (centres * centres).sum(axis=1)


def bounded(x: np.ndarray, cluster: np.ndarray, upper: np.ndarray, lower: np.ndarray, centres: np.ndarray, drift: np.ndarray, group: np.ndarray) -> None:
    """One round over the rows ``x``: ``cluster``, ``upper`` and ``lower`` are brought up to date in place."""
    n_groups = lower.shape[1]
    upper += drift[cluster]
    lower -= np.array([drift[group == g].max(initial=0.0) for g in range(n_groups)])
    nearer = lambda bound, at: bound >= at * (1 - SLACK) - SLACK
    todo = np.flatnonzero(nearer(upper, lower.min(axis=1)))
    best = ((x[todo] - centres[cluster[todo]]) ** 2).sum(axis=1)
    upper[todo] = np.sqrt(best)
    still = nearer(upper[todo], lower[todo].min(axis=1))
    todo, best = todo[still], best[still]
    if not len(todo):
        return
    was, was_at = cluster[todo].copy(), upper[todo].copy()
    now = was.copy()
    scanned = []
    for g in range(n_groups):
        members = np.flatnonzero(group == g)
        rows = np.flatnonzero(nearer(np.sqrt(best), lower[todo, g])) if len(members) else np.zeros(0, int)
        if not len(rows):
            continue
        far = squared(x[todo[rows]], centres[members])
        first = far.argmin(axis=1)
        least = far[np.arange(len(rows)), first]
        far[np.arange(len(rows)), first] = np.inf
        scanned.append((g, rows, members[first], least, far.min(axis=1)))
        better = (least < best[rows]) | ((least == best[rows]) & (members[first] < now[rows]))
        now[rows[better]], best[rows[better]] = members[first][better], least[better]
    left = np.flatnonzero(now != was)  # the centroid that is left is one of its group's others now
    lower[todo[left], group[was[left]]] = np.minimum(lower[todo[left], group[was[left]]], was_at[left])
    for g, rows, first, least, second in scanned:
        lower[todo[rows], g] = np.sqrt(np.where(now[rows] == first, second, least))
    cluster[todo], upper[todo] = now, np.sqrt(best)


def nearest_of(v: list[int], centres: list[list[int]]) -> tuple[int, int]:
    """(squared distance, centroid) in Python's integers."""
    return min((sum((a - b) ** 2 for a, b in zip(v, c)), n) for n, c in enumerate(centres))


def narrow(centres: list[list[int]]) -> bool:
    return all(-(1 << BITS) < x < 1 << BITS for c in centres for x in c)


def numbers(column: pa.Array, dims: int, kind) -> np.ndarray:
    return column.flatten().to_numpy(zero_copy_only=False).astype(kind, copy=False).reshape(-1, dims)


def arrays(rows: np.ndarray) -> pa.Array:
    return pa.ListArray.from_arrays(np.arange(len(rows) + 1, dtype=np.int32) * rows.shape[1], rows.ravel())


def assigned(rows: DataFrame, centres: list[list[int]], before: list[list[int]] | None, group: np.ndarray, scale: int, last: bool) -> DataFrame:
    """Rows of ``STATE`` after one assignment; ``last``: vec_id, cluster, distance instead."""
    dims, plain = len(centres[0]), not narrow(centres)
    if plain or before is None or not narrow(before):
        drift = np.full(len(centres), np.inf)
    else:
        drift = np.sqrt(((np.array(centres, dtype=float) - np.array(before, dtype=float)) ** 2).sum(axis=1)) * (1 + SLACK)
    fixed = None if plain else np.array(centres, dtype=float)

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            ids, v, wide, old, up, low = batch.columns
            is_wide = v.is_null().to_numpy(zero_copy_only=False)
            cluster, upper = old.to_numpy(zero_copy_only=False).astype(np.int32), up.to_numpy(zero_copy_only=False).copy()
            lower = numbers(low, int(group.max()) + 1, float).copy()
            distance: list[int | None] = [None] * len(cluster)
            small = np.flatnonzero(~is_wide)
            if len(small) and not plain:
                x = numbers(v, dims, float)
                if not np.isfinite(drift).all():
                    upper[small], lower[small] = np.inf, 0.0
                c, u, b = cluster[small], upper[small], lower[small]
                bounded(x, c, u, b, fixed, np.where(np.isfinite(drift), drift, 0.0), group)
                cluster[small], upper[small], lower[small] = c, u, b
                if last:
                    for at, d in zip(small, ((x - fixed[c]) ** 2).sum(axis=1)):
                        distance[at] = int(d)
            for at in np.arange(len(cluster)) if plain else np.flatnonzero(is_wide):
                whole = [whole_number(x, scale) for x in wide[int(at)].as_py()] if is_wide[at] else v[int(at)].as_py()
                d, cluster[at] = nearest_of(whole, centres)
                upper[at], lower[at] = np.inf, 0.0
                distance[at] = d if d < LONG else None
            if last:
                yield pa.RecordBatch.from_arrays([ids, pa.array(cluster), pa.array(distance, pa.int64())], ["vec_id", "cluster", "distance"])
            else:
                yield pa.RecordBatch.from_arrays([ids, v, wide, pa.array(cluster), pa.array(upper), arrays(lower)], ["vec_id", "v", "wide", "cluster", "upper", "lower"])

    return rows.mapInArrow(run, "vec_id long, cluster int, distance long" if last else STATE)


def digits(x: int) -> list[int]:
    """Digits of x to the base 2^22, the lowest first, each with the sign of x."""
    sign, x, out = (-1 if x < 0 else 1), abs(x), []
    while x or not out:
        out.append(sign * (x & (1 << BITS) - 1))
        x >>= BITS
    return out


def means(state: DataFrame, centres: list[list[int]], scale: int) -> list[list[int]]:
    """The floor of each component's mean; a centroid without rows stays as it is."""
    dims, k = len(centres[0]), len(centres)
    strips = -(-dims // STRIP)
    names = [f"s{i}" for i in range(STRIP)]

    def partial(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        sums: dict[int, np.ndarray] = {0: np.zeros((k, strips * STRIP), dtype=np.int64)}
        n = np.zeros(k, dtype=np.int64)
        for batch in batches:
            cluster, v, wide = batch.column("cluster").to_numpy(), batch.column("v"), batch.column("wide")
            is_wide = v.is_null().to_numpy(zero_copy_only=False)
            n += np.bincount(cluster, minlength=k)
            x, of = numbers(v, dims, np.int64), cluster[~is_wide]
            order = np.argsort(of, kind="stable")
            starts = np.flatnonzero(np.diff(of[order], prepend=-1))
            if len(of):
                sums[0][of[order][starts], :dims] += np.add.reduceat(x[order], starts, axis=0)
            for at in np.flatnonzero(is_wide):
                for i, value in enumerate(wide[int(at)].as_py()):
                    for place, digit in enumerate(digits(whole_number(value, scale))):
                        sums.setdefault(place, np.zeros_like(sums[0]))[cluster[at], i] += digit
        for place, s in sums.items():
            for strip in range(strips):
                there = np.flatnonzero((n > 0) if place == 0 else s.any(axis=1))
                part = s[there, strip * STRIP : (strip + 1) * STRIP]
                counted = n[there] if place == strip == 0 else np.zeros(len(there), np.int64)
                fixed = [pa.array(there.astype(np.int32)), pa.array(np.full(len(there), place, np.int32)), pa.array(np.full(len(there), strip, np.int32)), pa.array(counted)]
                yield pa.RecordBatch.from_arrays(fixed + [pa.array(part[:, i].copy()) for i in range(STRIP)], ["cluster", "place", "strip", "n", *names])

    parts = state.select("cluster", "v", "wide").mapInArrow(partial, "cluster int, place int, strip int, n long, " + ", ".join(f"{c} long" for c in names))
    summed = parts.groupBy("cluster", "place", "strip").agg(F.sum("n").alias("n"), *(F.sum(c).alias(c) for c in names)).collect()  # k rows for each strip and digit
    total, count = {}, {}
    for r in summed:
        count[r["cluster"]] = count.get(r["cluster"], 0) + r["n"]
        row = total.setdefault(r["cluster"], [0] * (strips * STRIP))
        for i, c in enumerate(names):
            row[r["strip"] * STRIP + i] += r[c] << BITS * r["place"]
    return [[t // count[j] for t in total[j][:dims]] if count.get(j) else list(c) for j, c in enumerate(centres)]


def yinyang_clusters(embeddings: DataFrame, k: int = 40, rounds: int = 5, dims: int = 64, scale: int = 256, salt: str = "2:") -> DataFrame:
    """Returns vec_id, cluster, distance, cluster_inertia, inertia, centroid_sha256: a row for each vector that takes part.

    ``rounds`` times all vectors are assigned to the nearest centroid (ties: the smaller number) and
    the centroids replaced by their floored means; then vectors are assigned once more.
    """
    spark, schema = embeddings.sparkSession, "vec_id long, cluster int, distance long, cluster_inertia long, inertia long, centroid_sha256 string"
    vector = F.col("embedding").cast("array<double>")
    finite = F.forall(vector, lambda x: x.isNotNull() & ~F.isnan(x) & (F.abs(x) < float("inf")))
    small = F.forall(vector, lambda x: F.abs(x) < (1 << BITS) / scale / 2)
    sound = embeddings.where((F.size("embedding") == dims) & finite)
    rows = sound.select(
        F.col("vec_id").cast("long").alias("vec_id"),
        F.when(small, F.transform(vector, lambda x: F.floor(x * F.lit(float(scale))).cast("int"))).alias("v"),
        F.when(~small, vector).alias("wide"),
    )
    hashed = rows.withColumn("hash", F.sha2(F.concat(F.lit(salt), F.col("vec_id").cast("string")).cast("binary"), 256))
    first = hashed.orderBy(F.asc_nulls_last("hash"), "v", "wide").limit(k).select("v", "wide").collect()
    if not first:
        return spark.createDataFrame([], schema)
    centres = [list(r["v"]) if r["v"] is not None else [whole_number(x, scale) for x in r["wide"]] for r in first]
    group = groups_of(np.array([[float(max(-1e150, min(1e150, x))) for x in c] for c in centres]), max(1, len(centres) // 10))
    n_groups = int(group.max()) + 1
    state = rows.select("*", F.lit(0).alias("cluster"), F.lit(math.inf).alias("upper"), F.array(*[F.lit(0.0)] * n_groups).alias("lower"))
    before, stored = None, None
    for _ in range(rounds):
        after = Written(assigned(state, centres, before, group, scale, last=False))
        if stored:
            stored.drop()
        stored, state = after, after.read()
        before, centres = centres, means(state, centres, scale)
    done = Written(assigned(state, centres, before, group, scale, last=True))
    if stored:
        stored.drop()
    # a sum with a part beyond 64 bits is unknown
    whole = lambda of: F.when(F.count(of) == F.count(F.lit(1)), F.sum(F.col(of).cast("decimal(38,0)")))
    named = spark.createDataFrame([(j, hashlib.sha256(",".join(map(str, c)).encode()).hexdigest()) for j, c in enumerate(centres)], "cluster int, centroid_sha256 string")
    sums = done.read().groupBy("cluster").agg(whole("distance").alias("s"))
    every = sums.agg(whole("s").alias("all"))
    labelled = sums.join(F.broadcast(named), "cluster").crossJoin(F.broadcast(every))  # k rows and one row
    labelled = labelled.select("cluster", F.col("s").try_cast("long").alias("cluster_inertia"), F.col("all").try_cast("long").alias("inertia"), "centroid_sha256")
    return done.read().join(F.broadcast(labelled), "cluster").select("vec_id", "cluster", "distance", "cluster_inertia", "inertia", "centroid_sha256")
