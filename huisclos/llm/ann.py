"""Approximate nearest neighbours by an inverted multi-index.

Vectors are scaled to length one and cut into halves; each half is quantised by its own k-means
codebook, so that two codebooks of K centroids give K x K cells. A query walks the cells in order of
the summed distances of its halves to the centroid pairs with a heap, until the cells it has met
hold enough entries, and those entries are reranked by the exact cosine in double precision on the
original vectors.

Codebooks are fitted on a sample of ``sample`` rows at most; every row is indexed. How many entries a
query must meet is calibrated on up to 64 sampled vectors against a brute-force search of the sample,
for a recall of ``aim``.

Equal vectors are one entry that carries its ``keep`` smallest ids, which is all that a top-k list
can use, so a vector that a third of the rows share costs one row. Queries with equal vectors are
searched once. Cells are dealt to tasks in blocks of ``block`` entries, and a query goes only to
blocks of cells that it walks.

Edge cases: vectors that are null, zero, of another length than the most common one, or that hold
null or non-finite components take no part, as queries or candidates. Null ids take no part. Ties go to the
smaller id. With fewer candidates than k all of them are returned; an empty table gives no rows.
Repeated ids are rows of their own: of the rows that share a query's id only the query's own is no candidate. Extra columns are ignored.
"""

from __future__ import annotations

import heapq
from collections.abc import Iterator

import numpy as np
import pandas as pd
from pyspark.sql import DataFrame
from pyspark.sql import Window as W
from pyspark.sql import functions as F

from .common import Written, partitions


def kmeans(x: np.ndarray, k: int, rounds: int = 12, seed: int = 3) -> np.ndarray:
    rng = np.random.default_rng(seed)
    centres = x[rng.choice(len(x), size=min(k, len(x)), replace=False)].copy()
    for _ in range(rounds):
        label = nearest(x, centres)
        n = np.bincount(label, minlength=len(centres))
        sums = np.stack([np.bincount(label, weights=x[:, c], minlength=len(centres)) for c in range(x.shape[1])], axis=1)
        centres[n > 0] = sums[n > 0] / n[n > 0, None]
    return centres


def nearest(x: np.ndarray, centres: np.ndarray) -> np.ndarray:
    half = (centres * centres).sum(axis=1) / 2
    return np.concatenate([np.argmax(x[i : i + 8192] @ centres.T - half, axis=1) for i in range(0, len(x), 8192)]) if len(x) else np.zeros(0, np.int64)


def scaled(x: np.ndarray) -> np.ndarray:
    """Rows times powers of two, which change no cosine, so that squares of components neither vanish nor overflow."""
    _, exponent = np.frexp(np.abs(x).max(axis=1))
    return np.ldexp(x, -exponent[:, None])


def unit(vectors) -> np.ndarray:
    x = scaled(np.stack([np.asarray(v, dtype=np.float64) for v in vectors]))
    return x / np.sqrt((x * x).sum(axis=1, keepdims=True))


def walk(first: np.ndarray, second: np.ndarray, counts: np.ndarray, enough: int) -> list[int]:
    """Cells (i x K + j) by summed distance until they hold ``enough`` entries; empty cells are left out."""
    a, b = np.argsort(first, kind="stable"), np.argsort(second, kind="stable")
    k, met, out = len(b), 0, []
    heap = [(float(first[a[0]] + second[b[0]]), 0, 0)]
    while heap and met < enough:
        _, i, j = heapq.heappop(heap)
        cell = int(a[i]) * k + int(b[j])
        if counts[cell]:
            out.append(cell)
            met += int(counts[cell])
        if j + 1 < k:
            heapq.heappush(heap, (float(first[a[i]] + second[b[j + 1]]), i, j + 1))
        if j == 0 and i + 1 < len(a):
            heapq.heappush(heap, (float(first[a[i + 1]] + second[b[0]]), i + 1, 0))
    return out


def distances(x: np.ndarray, centres: np.ndarray) -> np.ndarray:
    return (x * x).sum(axis=1)[:, None] + (centres * centres).sum(axis=1)[None] - 2 * x @ centres.T


def calibrate(x: np.ndarray, books: list[np.ndarray], k: int, aim: float, queries: int = 64) -> float:
    """The share of entries that a walk must meet for an average recall of ``aim`` on the sample."""
    half = books[0].shape[1]
    cells = nearest(x[:, :half], books[0]) * len(books[1]) + nearest(x[:, half:], books[1])
    counts = np.bincount(cells, minlength=len(books[0]) * len(books[1]))
    picked = np.linspace(0, len(x) - 1, min(queries, len(x))).astype(int)
    d1, d2 = distances(x[picked, :half], books[0]), distances(x[picked, half:], books[1])
    needed = []
    for n, q in enumerate(picked):
        sim = x @ x[q]
        sim[q] = -2
        best = np.argsort(-sim)[:k]
        rank, met = {}, 0
        for cell in walk(d1[n], d2[n], counts, len(x)):
            met += int(counts[cell])
            rank[cell] = met
        needed += [rank[int(c)] for c in cells[best]]
    return float(np.quantile(needed, aim)) / len(x) if needed else 1.0


def top_neighbours(embeddings: DataFrame, query: str, k: int = 5, sample: int = 16384, books: int = 64, aim: float = 0.97, block: int = 1024) -> DataFrame:
    """``query``: SQL condition on vec_id that names the queries. Returns query_id, rank, vec_id, score."""
    spark, schema = embeddings.sparkSession, "query_id long, rank int, vec_id long, score double"
    keep = k + 1
    vector = F.col("embedding").cast("array<double>")
    sound = F.col("embedding").isNotNull() & F.forall(vector, lambda v: v.isNotNull() & ~F.isnan(v) & (F.abs(v) < float("inf"))) & F.exists(vector, lambda v: v != 0)
    rows = embeddings.where(sound & F.col("vec_id").isNotNull()).select("vec_id", F.transform(vector, lambda v: v + F.lit(0.0)).alias("v"))
    common = rows.groupBy(F.size("v").alias("n")).count().orderBy(F.desc("count"), F.desc("n")).first()
    if common is None:
        return spark.createDataFrame([], schema)
    width = common["n"]
    sized = rows.where(F.size("v") == width).withColumn("entry", F.xxhash64("v"))
    # equal vectors: their smallest ids; Spark applies the rank limit before the shuffle too
    order = W.partitionBy("entry", "v").orderBy("vec_id")
    first = sized.withColumn("n", F.row_number().over(order)).where(F.col("n") <= keep)
    entries = Written(first.groupBy("entry", "v").agg(F.array_sort(F.collect_list("vec_id")).alias("ids")).select("v", "ids", "entry"))
    taken = entries.read().orderBy("entry").limit(sample).select("v").collect()  # at most ``sample`` rows
    x = unit([r["v"] for r in taken])
    half = max(1, width // 2)
    size = max(1, min(books, len(x) // 8))
    halves = [(x[:, :half], 3), (x[:, half:], 4)]
    codebooks = [kmeans(h, size, seed=s) if h.shape[1] else np.zeros((1, 0)) for h, s in halves]
    share = calibrate(x, codebooks, k, aim)
    second = len(codebooks[1])

    def assign(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        for pdf in batches:
            if len(pdf):
                u = unit(pdf["v"])
                yield pdf.assign(cell=nearest(u[:, :half], codebooks[0]) * second + nearest(u[:, half:], codebooks[1]))

    indexed = Written(entries.read().mapInPandas(assign, "v array<double>, ids array<long>, entry long, cell long"))
    counts = np.zeros(len(codebooks[0]) * second, dtype=np.int64)
    for r in indexed.read().groupBy("cell").count().collect():  # at most books^2 rows
        counts[r["cell"]] = r["count"]
    enough = int(np.ceil(share * counts.sum())) + keep
    parts = np.maximum(1, -(-counts // block))

    def walks(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        for pdf in batches:
            if not len(pdf):
                continue
            u = unit(pdf["v"])
            d1, d2 = distances(u[:, :half], codebooks[0]), distances(u[:, half:], codebooks[1])
            for n in range(len(pdf)):
                blocks: dict[int, list[int]] = {}
                for cell in walk(d1[n], d2[n], counts, enough):
                    for part in range(int(parts[cell])):
                        blocks.setdefault((cell * 31 + part * 7) % groups, []).append(cell << 20 | part)
                yield pd.DataFrame({"slot": list(blocks), "query": pdf["entry"].iloc[n], "v": [pdf["v"].iloc[n]] * len(blocks), "cells": list(blocks.values())})

    def place(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        for pdf in batches:
            cell = pdf["cell"].to_numpy()
            part = (pdf["entry"].to_numpy().view(np.uint64) >> np.uint64(7)) % parts[cell].astype(np.uint64)
            part = part.astype(np.int64)
            yield pd.DataFrame({"slot": (cell * 31 + part * 7) % groups, "cell": cell << 20 | part, "v": pdf["v"], "ids": pdf["ids"], "entry": pdf["entry"]})

    # a slot holds about ``block`` entries of whole cell blocks
    groups = int(max(1, -(-counts.sum() // block)))
    asked = sized.where(query)
    # a walk is long for so short a row: no merging of partitions by size here
    queries = asked.select("v", "entry").distinct().repartition(partitions(spark), "entry")
    sent = queries.mapInPandas(walks, "slot long, query long, v array<double>, cells array<long>")
    placed = indexed.read().mapInPandas(place, "slot long, cell long, v array<double>, ids array<long>, entry long")

    def rerank(ask: pd.DataFrame, have: pd.DataFrame) -> pd.DataFrame:
        columns = ["query", "vec_id", "score", "entry"]
        if not len(ask) or not len(have):
            return pd.DataFrame({"query": np.zeros(0, np.int64), "vec_id": np.zeros(0, np.int64), "score": np.zeros(0), "entry": np.zeros(0, np.int64)})
        have = have.sort_values("cell", kind="stable", ignore_index=True)
        cells = have["cell"].to_numpy()
        x = scaled(np.stack(have["v"].to_numpy()))
        asked_of = scaled(np.stack(ask["v"].to_numpy()))
        lengths = np.sqrt((x * x).sum(axis=1))
        out = []
        for query_id, v, wanted in zip(ask["query"], asked_of, ask["cells"]):
            w = np.sort(np.asarray(wanted))
            low, high = np.searchsorted(cells, w), np.searchsorted(cells, w, side="right")
            at = np.concatenate([np.arange(a, b) for a, b in zip(low, high)])
            if not len(at):
                continue
            score = x[at] @ v / (lengths[at] * np.sqrt(v @ v))
            if len(at) > keep:  # ties with the last place stay
                edge = np.partition(score, len(at) - keep)[len(at) - keep]
                at, score = at[score >= edge - 1e-12], score[score >= edge - 1e-12]
            found = [(float(s), int(i), int(have["entry"].iat[p])) for p, s in zip(at, score) for i in have["ids"].iat[p]]
            out += [(query_id, i, s, e) for s, i, e in sorted(found, key=lambda f: (-f[0], f[1]))[:keep]]
        return pd.DataFrame(out, columns=columns)

    near = sent.groupBy("slot").cogroup(placed.groupBy("slot")).applyInPandas(rerank, "query long, vec_id long, score double, entry long")
    best = F.array_sort(F.collect_list(F.struct((-F.col("score")).alias("far"), "vec_id", "entry")))
    lists = near.groupBy("query").agg(F.slice(best, 1, keep).alias("near"))  # ``keep`` from each of the query's slots
    named = asked.select(F.col("vec_id").alias("query_id"), F.col("entry").alias("query"))
    # the query's own row is one row of its entry; other rows with its id are candidates
    itself = F.array_position(F.transform("near", lambda n: (n["vec_id"] == F.col("query_id")) & (n["entry"] == F.col("query"))), True)
    own = F.slice(F.filter("near", lambda n, i: i + 1 != itself), 1, k)
    joined = named.join(lists, "query").select("query_id", F.posexplode(own))
    return joined.select("query_id", (F.col("pos") + 1).alias("rank"), F.col("col.vec_id").alias("vec_id"), (-F.col("col.far")).alias("score"))
