"""Near copies: components of the links between texts whose sets of five-word shingles have a Jaccard similarity of 0.8 or more.

Words are split at ASCII blanks and lower-cased in A-Z, as for SimHash. A text of fewer words is one shingle.
Texts with the same set are one row from the start. Each set has a SimHash fingerprint; fingerprints at two or
fewer differing bits are linked through ``simhash``'s Golay keys. Most pairs at 0.8 to 0.95 differ in more bits
than that, so MinHash bands add what two bits can't reach (24 of 4 minima: a pair at 0.8 is missed
with a chance of 3 in a million, one at 0.9 with 1 in 10^11). A link of either kind needs the exact Jaccard
similarity of both whole sets.

A band key with up to ``SMALL`` sets gives all its pairs. A larger one gives each set's pair with the
smallest set first; if its sets aren't one component by then, all sets of different components are
compared in blocks of ``BLOCK`` hashed sets, each pair of blocks in a group of its own, which gives a spanning forest.
So the sets of a large group of copies are compared about once each, and no group grows with the data.

Edge cases: null and empty texts have the empty set and are one component. Empty tables give no rows.
"""

from __future__ import annotations

from collections.abc import Iterator

import numpy as np
import pandas as pd
import pyarrow as pa
import xxhash
from pyspark.sql import DataFrame
from pyspark.sql import Window as W
from pyspark.sql import functions as F
from pyspark.sql import types as T

from .arrowtext import gram_hashes, mix, text_slices, word_hashes
from .common import Written, partitions
from .components import connected_components
from .simhash import bit_counts, fingerprint_links, majority

BANDS, ROWS = 24, 4
SMALL, BLOCK = 32, 512
#: Bytes of words: all but ASCII blanks.
INK = np.array([b not in b" \t\n\r\x0b\x0c" for b in range(256)])
FACTORS = np.random.default_rng(42).integers(0, 1 << 64, BANDS * ROWS, dtype=np.uint64) | np.uint64(1)


def shingle_sets(data: bytes, offsets: np.ndarray, size: int) -> list[np.ndarray]:
    """The sorted set of shingle hashes of each row."""
    words, at = word_hashes(data, offsets, INK)
    grams = gram_hashes(words, size)
    out = []
    for a, b in zip(at[:-1].tolist(), at[1:].tolist()):
        own = grams[a : b - size + 1] if b - a >= size else gram_hashes(words[a:b], b - a) if b > a else words[:0]
        out.append(np.unique(own))
    return out


def band_keys(shingles: np.ndarray) -> np.ndarray:
    if not len(shingles):
        return np.zeros(0, np.int64)
    least = np.full(BANDS * ROWS, np.iinfo(np.uint64).max, dtype=np.uint64)
    for i in range(0, len(shingles), 2048):
        np.minimum(least, (FACTORS[:, None] * shingles[None, i : i + 2048]).min(axis=1), out=least)
    key = np.arange(1, BANDS + 1, dtype=np.uint64)
    for column in least.reshape(BANDS, ROWS).T:
        key = mix(key * np.uint64(0xD6E8FEB86659FD93) + column)
    return key.view(np.int64)


def set_fingerprint(shingles: np.ndarray) -> int:
    """The SimHash of a set of shingle hashes; zero for the empty set."""
    counts = np.zeros(64, dtype=np.int64)
    for i in range(0, len(shingles), 1 << 15):
        counts += bit_counts(shingles[i : i + (1 << 15)])
    return majority(counts, len(shingles))


def _sketches(size: int, carry: tuple[str, ...]):
    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for rows, data, offsets in text_slices(batches, most=1 << 20):
            sets = shingle_sets(data, offsets, size)
            keys = np.array([xxhash.xxh64_intdigest(s.tobytes()) for s in sets], dtype=np.uint64).view(np.int64)
            columns = [rows.column(c) for c in carry]
            fps = np.array([set_fingerprint(s) for s in sets], dtype=np.uint64).view(np.int64)
            columns += [pa.array(keys), pa.array([len(s) for s in sets], pa.int64()), pa.array(fps), pa.array([band_keys(s) for s in sets], pa.list_(pa.int64()))]
            yield pa.RecordBatch.from_arrays(columns, names=[*carry, "set_key", "n", "fp", "bands"])

    return run


def _sets(size: int):
    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for rows, data, offsets in text_slices(batches, most=1 << 20):
            sets = [s.view(np.int64) for s in shingle_sets(data, offsets, size)]
            yield pa.RecordBatch.from_arrays([rows.column(0), pa.array(sets, pa.list_(pa.int64()))], names=["set_key", "shingles"])

    return run


def _pairs_of(threshold: float):
    """Batches come sorted by band, size and set; a band's rows may cross batches. A row with ``crowd`` names a crowded band in ``a``."""

    def run(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        band, held = None, []  # the sets of the open band, its first one alone once it is crowded
        crowd = False
        for pdf in batches:
            out = []
            for b, key, n in zip(pdf["band"].tolist(), pdf["set_key"].tolist(), pdf["n"].tolist()):
                if b != band:
                    band, held, crowd = b, [], False
                if crowd:
                    out.append((held[0][0], key, False))
                    continue
                out += [(k, key, False) for k, m in held if m >= threshold * n or k == held[0][0]]
                held.append((key, n))
                if len(held) > SMALL:
                    crowd = True
                    out.append((band, 0, True))
            a, b, c = zip(*out) if out else ((), (), ())
            yield pd.DataFrame({"a": np.array(a, np.int64), "b": np.array(b, np.int64), "crowd": np.array(c, bool)})

    return run


def links_in_crowd(keys: np.ndarray, labels: np.ndarray, sets: list[np.ndarray], threshold: float) -> list[tuple[int, int]]:
    """A spanning forest of the links between sets of different labels; sets of one label count as linked."""
    _, codes = np.unique(np.concatenate(sets), return_inverse=True)
    sizes = np.array([len(s) for s in sets])
    ends = np.cumsum(sizes)
    starts = ends - sizes
    left, edges = np.ones(len(keys), dtype=bool), []
    while left.any():
        queue = np.nonzero(labels == labels[np.argmax(left)])[0].tolist()
        left[queue] = False
        while queue and left.any():
            x = queue.pop()
            mark = np.zeros(int(codes.max()) + 1, dtype=bool)
            mark[codes[starts[x] : ends[x]]] = True
            both = np.add.reduceat(mark[codes].astype(np.int64), starts)
            for y in np.nonzero(left & (both / (sizes + sizes[x] - both) >= threshold))[0].tolist():
                if left[y]:
                    edges.append((int(keys[x]), int(keys[y])))
                    same = np.nonzero(labels == labels[y])[0]
                    left[same] = False
                    queue += same.tolist()
    return edges


def _crowd_edges(threshold: float):
    def run(pdf: pd.DataFrame) -> pd.DataFrame:
        edges = links_in_crowd(pdf["set_key"].to_numpy(), pdf["label"].to_numpy(), list(pdf["shingles"]), threshold)
        return pd.DataFrame(edges, columns=["a", "b"], dtype=np.int64)

    return run


def simhash_pairs(sets: DataFrame) -> DataFrame:
    """``sets``: (set_key, fp). Returns (a, b): each set with the first one of its fingerprint, and the first ones of linked fingerprints."""
    heads = Written(sets.groupBy("fp").agg(F.min("set_key").alias("head")))
    same = sets.join(heads.read(), "fp").where("set_key <> head").select(F.col("head").alias("a"), F.col("set_key").alias("b"))
    a, b = (heads.read().select(F.col("fp").alias(c), F.col("head").alias(f"head_{c}")) for c in "ab")
    return same.unionAll(fingerprint_links(heads.read()).join(a, "a").join(b, "b").select("head_a", "head_b"))


def near_copy_components(docs: DataFrame, key: str, carry: tuple[str, ...], order: list, size: int = 5, threshold: float = 0.8) -> DataFrame:
    """Returns the columns ``carry`` and component: for each distinct shingle set the first row by ``order``.

    Rows with the same ``key``, a column of ``carry``, have the same text.
    """
    spark = docs.sparkSession
    kept = [docs.schema[c] for c in carry]
    schema = T.StructType([*kept, T.StructField("set_key", T.LongType()), T.StructField("n", T.LongType()), T.StructField("fp", T.LongType()), T.StructField("bands", T.ArrayType(T.LongType()))])
    sketches = docs.select(*carry, "text").mapInArrow(_sketches(size, carry), schema)
    first = Written(sketches.withColumn("r", F.row_number().over(W.partitionBy("set_key").orderBy(*order))).where("r = 1").drop("r"))
    entries = first.read().select(F.explode("bands").alias("band"), "set_key", "n")
    dealt = entries.repartition(partitions(spark), "band").sortWithinPartitions("band", "n", "set_key")
    found = Written(dealt.mapInPandas(_pairs_of(threshold), "a long, b long, crowd boolean"))
    met = found.read().where("not crowd").select("a", "b").unionAll(simhash_pairs(first.read().select("set_key", "fp")))
    pairs = Written(met.select(F.least("a", "b").alias("a"), F.greatest("a", "b").alias("b")).distinct())

    def sets_of(keys: DataFrame) -> Written:
        rows = first.read().select("set_key", key).join(keys.distinct(), "set_key", "left_semi")
        texts = docs.select(key, "text").join(rows, key)
        return Written(texts.select("set_key", "text").dropDuplicates(["set_key"]).mapInArrow(_sets(size), "set_key long, shingles array<long>"))

    sets = sets_of(pairs.read().select(F.explode(F.array("a", "b")).alias("set_key")))
    a, b = (sets.read().select(F.col("set_key").alias(c), F.col("shingles").alias(f"set_{c}")) for c in "ab")
    both = F.size(F.array_intersect("set_a", "set_b"))
    linked = pairs.read().join(a, "a").join(b, "b").where(both / (F.size("set_a") + F.size("set_b") - both) >= threshold)
    edges = Written(linked.select("a", "b"))
    labels = connected_components(edges.read())
    crowds = Written(found.read().where("crowd").select(F.col("a").alias("band")).distinct())
    if crowds.read().limit(1).count():
        members = entries.join(crowds.read(), "band").join(labels.withColumnRenamed("node", "set_key"), "set_key", "left")
        members = Written(members.select("band", "set_key", F.coalesce("label", "set_key").alias("label")))
        apart = members.read().groupBy("band").agg(F.count("*").alias("m"), F.min("label").alias("low"), F.max("label").alias("high")).where("low < high")
        blocks = F.ceil(F.col("m") / BLOCK).cast("long")
        own = members.read().join(apart, "band").withColumn("blocks", blocks).withColumn("own", F.pmod(F.xxhash64("set_key"), "blocks"))
        spread = own.withColumn("other", F.explode(F.sequence(F.lit(0).cast("long"), F.col("blocks") - 1)))
        spread = spread.select("band", F.least("own", "other").alias("i"), F.greatest("own", "other").alias("j"), "set_key", "label")
        more = spread.join(sets.read(), "set_key").groupBy("band", "i", "j").applyInPandas(_crowd_edges(threshold), "a long, b long")
        more = Written(more.distinct())
        if more.read().limit(1).count():
            labels = connected_components(edges.read().unionAll(more.read()))
    named = first.read().join(labels.withColumnRenamed("node", "set_key"), "set_key", "left")
    return named.select(*carry, F.coalesce("label", "set_key").alias("component"))
