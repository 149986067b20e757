"""SimHash near-duplicates through Golay-code fuzzy hashing.

A 64-bit fingerprint is cut into three segments. Fingerprints at two or fewer differing bits agree
exactly on at least one segment (pigeonhole) and differ by at most two bits on each other one. A
segment, padded to 23 bits, is decoded by the perfect [23, 12, 7] Golay code to the index of its
nearest codeword; it also gets the indices that its one-bit neighbours decode to, six at most. Two
words at distance two have a common one-bit neighbour, so their index sets meet, and a key of (exact
segment, index of the next segment) finds every link. Members of a key are verified by XOR and bit
count; a key gives a spanning forest of its links, not all pairs, and the forests of all keys are
joined to components.

Exact copies share one fingerprint, so keys hold each fingerprint once however many documents have
it. Keys are counted first; one with more than ``CROWDED`` fingerprints is split by the indices of the
third segment, which linked fingerprints share as well. A split key leaves two segments near fixed
codewords, so its fingerprints have a bound that does not depend on the data. Where many still meet,
they are searched by probing the words at up to two flips, which is linear in their number.

Edge cases: null and empty texts have fingerprint zero and link like any other. Null doc_ids get a
fingerprint but never name a component. An empty table gives no rows. Extra columns are ignored.
"""

from __future__ import annotations

from collections.abc import Iterator

import numpy as np
import pandas as pd
import xxhash
from pyspark.sql import DataFrame
from pyspark.sql import functions as F
from pyspark.sql import types as T

from .common import Written, partitions
from .components import connected_components

WIDTHS = (22, 21, 21)
#: Fixed value: the generator polynomial of the [23, 12, 7] Golay code, x^11 + x^9 + x^7 + x^6 + x^5 + x + 1.
GENERATOR = 0b101011100011
LENGTH = 23
#: Keys with more different fingerprints are split by their third segment.
CROWDED = 2048
#: Marks split keys: plain ones use bits 0 to 33, 60 and 61.
SPLIT = 1 << 58


def fingerprint(text: str | None, size: int = 3) -> int:
    words = (text or "").encode("utf-8", "surrogatepass").lower().split()
    if not words:
        return 0
    joined = b" ".join(words)
    ends = np.cumsum([len(w) + 1 for w in words]) - 1
    starts = np.concatenate(([0], ends[:-1] + 1))
    k = min(size, len(words))
    first, last = starts[: len(words) - k + 1].tolist(), ends[k - 1 :].tolist()
    digest = xxhash.xxh64_intdigest
    counts, step = np.zeros(64, dtype=np.int64), 1 << 15
    for i in range(0, len(first), step):
        counts += bit_counts(np.array([digest(joined[a:b], 42) for a, b in zip(first[i : i + step], last[i : i + step])], dtype="<u8"))
    return majority(counts, len(first))


def bit_counts(hashes: np.ndarray) -> np.ndarray:
    """How many of the hashes have each of the 64 bits."""
    return np.unpackbits(hashes.view(np.uint8), bitorder="little").reshape(-1, 64).sum(axis=0, dtype=np.int64)


def majority(counts: np.ndarray, n: int) -> int:
    """The fingerprint of ``n`` hashes: a bit is 1 if over half of them have it."""
    bits = (counts * 2 > n).astype(np.uint8)
    return int(np.packbits(bits, bitorder="little").view("<u8")[0])


def remainders() -> np.ndarray:
    """x^i modulo the generator, for each bit of a word."""
    out, r = [], 1
    for _ in range(LENGTH):
        out.append(r)
        r <<= 1
        if r & (1 << 11):
            r ^= GENERATOR
    return np.array(out, dtype=np.int64)


def error_patterns() -> np.ndarray:
    """The pattern of three or fewer errors for each syndrome."""
    rem, table = remainders(), np.zeros(2048, dtype=np.int64)
    for i in range(LENGTH):
        for j in range(i, LENGTH):
            for k in range(j, LENGTH):
                bits = {i, j, k}
                table[int(np.bitwise_xor.reduce(rem[list(bits)]))] = sum(1 << b for b in bits)
    table[0] = 0
    return table


def decode(words: np.ndarray, rem: np.ndarray, table: np.ndarray) -> np.ndarray:
    """The 12-bit index of the codeword nearest to each 23-bit word."""
    syndrome = np.zeros(words.shape, dtype=np.int64)
    for i in range(LENGTH):
        syndrome ^= np.where((words >> i) & 1, rem[i], 0)
    return (words ^ table[syndrome]) >> 11


def segments_of(fps: np.ndarray) -> list[np.ndarray]:
    segments, at = [], 0
    for width in WIDTHS:
        segments.append(((fps >> np.uint64(at)) & np.uint64((1 << width) - 1)).astype(np.int64))
        at += width
    return segments


def index_sets(words: np.ndarray, width: int, rem: np.ndarray, table: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    """Rows (position in ``words``, codeword index): what a word and its one-bit neighbours decode to."""
    flips = np.concatenate(([0], np.left_shift(1, np.arange(width))))
    index = np.sort(decode(words[:, None] ^ flips[None, :], rem, table), axis=1)
    new = np.ones(index.shape, dtype=bool)
    new[:, 1:] = index[:, 1:] != index[:, :-1]
    row, col = np.nonzero(new)
    return row, index[row, col]


def golay_keys(fps: np.ndarray, rem: np.ndarray, table: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    """Rows (position in ``fps``, key): every key of every fingerprint."""
    segments = segments_of(fps)
    rows, keys = [], []
    for s, exact in enumerate(segments):
        row, index = index_sets(segments[(s + 1) % 3], WIDTHS[(s + 1) % 3], rem, table)
        rows.append(row)
        keys.append((np.int64(s) << 60) | (exact[row] << 12) | index)
    return np.concatenate(rows), np.concatenate(keys)


def split_keys(keys: np.ndarray, fps: np.ndarray, rem: np.ndarray, table: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    """Rows (position in ``keys``, finer key): each key joined with every index of its fingerprint's third segment."""
    segments, of = segments_of(fps), keys >> 60
    rows, finer = [], []
    for s in range(3):
        own = np.nonzero(of == s)[0]
        row, index = index_sets(segments[(s + 2) % 3][own], WIDTHS[(s + 2) % 3], rem, table)
        rest = keys[own][row] & ((1 << 60) - 1)
        rows.append(own[row])
        finer.append((np.int64(s) << 60) | SPLIT | (rest << 12) | index)
    return np.concatenate(rows), np.concatenate(finer)


def links_within(fps: np.ndarray, bits: int = 2, direct: int = 2048) -> list[tuple[int, int]]:
    """A spanning forest (member, root) of the links among sorted distinct fingerprints."""
    n = len(fps)
    pairs_a, pairs_b = [], []
    if n <= direct:
        a, b = np.triu_indices(n, 1) if n <= 64 else (None, None)
        if a is None:
            for i in range(n - 1):
                near = np.nonzero(np.bitwise_count(fps[i + 1 :] ^ fps[i]) <= bits)[0]
                pairs_a.append(np.full(len(near), i))
                pairs_b.append(near + i + 1)
        else:
            near = np.bitwise_count(fps[a] ^ fps[b]) <= bits
            pairs_a, pairs_b = [a[near]], [b[near]]
    else:
        one = np.left_shift(np.uint64(1), np.arange(64, dtype=np.uint64))
        i, j = np.triu_indices(64, 1)
        for mask in np.concatenate((one, one[i] | one[j])):
            probe = fps ^ mask
            at = np.minimum(np.searchsorted(fps, probe), n - 1)
            hit = np.nonzero((fps[at] == probe) & (fps < probe))[0]
            pairs_a.append(hit)
            pairs_b.append(at[hit])
    a, b = np.concatenate(pairs_a), np.concatenate(pairs_b)
    if not len(a):
        return []
    root = np.arange(n)
    while True:
        low = np.minimum(root[a], root[b])
        before = root.copy()
        np.minimum.at(root, root[a], low)
        np.minimum.at(root, root[b], low)
        root = root[root]
        if (root == before).all() and (root[a] == root[b]).all():
            break
    member = np.nonzero(root != np.arange(n))[0]
    return list(zip(fps[member].view(np.int64).tolist(), fps[root[member]].view(np.int64).tolist()))


def _keys_of(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
    rem, table = remainders(), error_patterns()
    for pdf in batches:
        fps = pdf["fp"].to_numpy(dtype=np.int64).view(np.uint64)
        for i in range(0, len(fps), 8192):
            part = fps[i : i + 8192]
            rows, keys = golay_keys(part, rem, table)
            yield pd.DataFrame({"key": keys, "fp": part[rows].view(np.int64)})


def _split_crowded(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
    rem, table = remainders(), error_patterns()
    for pdf in batches:
        crowded = pdf["crowded"].notna().to_numpy()
        yield pdf.loc[~crowded, ["key", "fp"]]
        keys, fps = pdf["key"].to_numpy()[crowded], pdf["fp"].to_numpy(dtype=np.int64)[crowded].view(np.uint64)
        for i in range(0, len(keys), 8192):
            rows, finer = split_keys(keys[i : i + 8192], fps[i : i + 8192], rem, table)
            yield pd.DataFrame({"key": finer, "fp": fps[i : i + 8192][rows].view(np.int64)})


def _edges_of(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
    """Batches come sorted by key; a key's rows may cross batches."""
    open_key: int | None = None
    open_fps: list[np.ndarray] = []

    def linked(fps: np.ndarray) -> list[tuple[int, int]]:
        return links_within(np.unique(fps)) if len(fps) > 1 else []

    for pdf in batches:
        keys, fps = pdf["key"].to_numpy(), pdf["fp"].to_numpy(dtype=np.int64).view(np.uint64)
        found: list[tuple[int, int]] = []
        cuts = np.concatenate(([0], np.nonzero(keys[1:] != keys[:-1])[0] + 1, [len(keys)]))
        for a, b in zip(cuts[:-1].tolist(), cuts[1:].tolist()):
            if a and b < len(keys):  # a whole group inside the batch
                if b - a > 1:
                    found += linked(fps[a:b])
                continue
            if len(keys) and keys[a] != open_key:
                if open_fps:
                    found += linked(np.concatenate(open_fps))
                open_key, open_fps = int(keys[a]), []
            open_fps.append(fps[a:b])
        yield pd.DataFrame(found, columns=["a", "b"], dtype=np.int64)
    if open_fps:
        yield pd.DataFrame(linked(np.concatenate(open_fps)), columns=["a", "b"], dtype=np.int64)


def fingerprint_documents(docs: DataFrame, size: int = 3, carry: tuple[str, ...] = ("doc_id",)) -> DataFrame:
    """The columns ``carry`` plus fp, over whole texts."""

    def run(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        for pdf in batches:
            fps = np.array([fingerprint(t, size) for t in pdf["text"]], dtype=np.uint64)
            yield pdf[list(carry)].assign(fp=fps.view(np.int64))

    kept = [docs.schema[c] for c in carry]
    return docs.select(*carry, "text").mapInPandas(run, T.StructType([*kept, T.StructField("fp", T.LongType())]))


def fingerprint_links(fps: DataFrame, crowded_from: int = CROWDED) -> DataFrame:
    """``fps``: (fp), each once. Returns (a, b): spanning forests of the links of all keys.

    Crowded keys are joined back by Spark, which broadcasts their list only below its own size limit.
    """
    spark = fps.sparkSession
    keys = fps.select("fp").mapInPandas(_keys_of, "key long, fp long")
    counts = keys.groupBy("key").agg(F.count("*").alias("crowded"))
    crowded = Written(counts.where(F.col("crowded") > crowded_from))
    if crowded.read().limit(1).count():
        keys = keys.join(crowded.read(), "key", "left").select("key", "fp", "crowded").mapInPandas(_split_crowded, "key long, fp long")
    dealt = keys.repartition(partitions(spark), "key").sortWithinPartitions("key")
    return dealt.mapInPandas(_edges_of, "a long, b long").distinct()


def fingerprint_components(fps: DataFrame, crowded_from: int = CROWDED) -> DataFrame:
    """``fps``: (doc_id, fp). Returns (fp, component_id): the smallest doc_id reachable from it."""
    first = Written(fps.groupBy("fp").agg(F.min("doc_id").alias("first")))
    labels = connected_components(fingerprint_links(first.read(), crowded_from))
    named = first.read().join(labels.withColumnRenamed("node", "fp"), "fp", "left").withColumn("label", F.coalesce("label", "fp"))
    smallest = named.groupBy("label").agg(F.min("first").alias("component_id"))
    return named.join(smallest, "label").select("fp", "component_id")


def simhash_duplicates(docs: DataFrame, size: int = 3) -> DataFrame:
    """Returns doc_id, fingerprint (16 hex digits), component_id for every document."""
    fps = Written(fingerprint_documents(docs, size))
    components = fingerprint_components(fps.read())
    joined = fps.read().join(components, "fp")
    return joined.select("doc_id", F.lower(F.lpad(F.hex("fp"), 16, "0")).alias("fingerprint"), "component_id")
