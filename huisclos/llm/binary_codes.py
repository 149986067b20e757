"""Near copies of embeddings by randomly rotated binary codes.

A unit vector o is rotated and kept as the signs of its coordinates with a correction factor, the
inner product of the rotated vector with the code's own unit vector. For another unit vector q the
inner product of the code with the rotated q, divided by the factor, is an unbiased estimate of the
cosine; its error is below ``sure`` standard deviations but for a chance of a few in a million. Pairs
whose estimate plus that bound reaches the threshold are computed again from the original vectors in
double precision, and only that decides.

Vectors meet within their label. Equal vectors of a label are one entry with a count of copies, so
copies are never compared. A label with at most ``whole`` entries is compared completely, in blocks of
``block``, a pair of blocks a unit of work. Beyond that, pairs must share a key of ``bits`` signs under
one of several further rotations; bits grow with the label's entries, and the number of keys grows with
the bits so that a pair at the threshold is missed with a chance of ``miss`` at most. A key with more
than ``block`` entries is cut into blocks again, so no bucket is one task. A pair that shares several
keys counts under the first. What leaves a unit is a count and one edge of a spanning forest for each
entry, never its pairs.

Edge cases: vectors that are null, zero, or hold null or non-finite components, and rows without a
label, link with nothing. Vectors of different lengths don't link. Components of any size are scaled by
a power of two first. Repeated ids are rows of their own. A null id counts as a link of others; a
component's id is its smallest id that is not null. An empty table gives no rows. Extra columns are ignored.
"""

from __future__ import annotations

import math
from collections.abc import Iterator
from functools import lru_cache

import numpy as np
import pandas as pd
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from .ann import scaled, unit
from .common import Written
from .components import connected_components

RESULT = ["vec_id", "n_links", "component_id", "kept"]
#: Rows of a block that are compared with the other block at a time.
TILE = 256
#: What single precision may lose.
ROUNDING = 1e-4


@lru_cache(maxsize=64)
def rotation(dims: int, seed: int) -> np.ndarray:
    """A random orthogonal matrix, the same in every task."""
    q, r = np.linalg.qr(np.random.default_rng([dims, seed]).normal(size=(dims, dims)))
    return q * np.sign(np.diag(r))


def encode(u: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    """Packed signs and correction factors of unit vectors."""
    turned = u @ rotation(u.shape[1], 0)
    return np.packbits(turned > 0, axis=1), np.abs(turned).sum(axis=1) / math.sqrt(u.shape[1])


def error_bound(factor: np.ndarray, dims: int, sure: float) -> np.ndarray:
    return np.sqrt(np.maximum(0.0, 1 - factor**2)) / factor * sure / math.sqrt(max(1, dims - 1))


def estimates(codes: np.ndarray, factor: np.ndarray, turned: np.ndarray) -> np.ndarray:
    """Estimated cosines of coded vectors with vectors that are rotated already, a row for each code."""
    dims = turned.shape[1]
    signs = np.unpackbits(codes, axis=1, count=dims).astype(np.float32) * 2 - 1
    return signs @ turned.T.astype(np.float32) / (math.sqrt(dims) * factor)[:, None].astype(np.float32)


def banding(entries: int, whole: int, block: int, threshold: float, miss: float) -> tuple[int, int]:
    """(bits, tables) for a label of so many entries; (0, 1): everything meets."""
    if entries <= whole:
        return 0, 1
    bits = min(60, max(6, math.ceil(math.log2(entries / block)) + 2))
    alike = (1 - math.acos(threshold) / math.pi) ** bits
    return bits, math.ceil(math.log(miss) / math.log1p(-alike))


def table_keys(u: np.ndarray, bits: int, tables: int) -> np.ndarray:
    """The key of each unit vector in each table: ``bits`` signs of rotations after the first."""
    dims = u.shape[1]
    turns = -(-bits * tables // dims)
    signs = np.concatenate([u @ rotation(dims, 1 + t) > 0 for t in range(turns)], axis=1)[:, : bits * tables]
    return signs.reshape(len(u), tables, bits) @ (1 << np.arange(bits, dtype=np.int64))


def join_roots(parent: np.ndarray, a: np.ndarray, b: np.ndarray) -> np.ndarray:
    """``parent``, where each node names its component's smallest node, after the links (a, b)."""
    while True:
        one, two = parent[a], parent[b]
        apart = one != two
        if not apart.any():
            return parent
        a, b, one, two = a[apart], b[apart], one[apart], two[apart]
        np.minimum.at(parent, np.maximum(one, two), np.minimum(one, two))
        while (parent != (up := parent[parent])).any():
            parent = up


def link_block(x: np.ndarray, codes: np.ndarray, factor: np.ndarray, copies: np.ndarray, left: np.ndarray, right: np.ndarray, threshold: float, sure: float, first_in: tuple[np.ndarray, int] | None) -> tuple[np.ndarray, np.ndarray]:
    """(links, root) of each of the rows ``x``: links between ``left`` and ``right``, which are the same rows or disjoint.

    ``first_in``: keys in all tables and the table at hand; pairs that share an earlier key are left out.
    """
    x = scaled(x)
    length = np.sqrt((x * x).sum(axis=1))
    dims = x.shape[1]
    turned = (x[right] / length[right, None]) @ rotation(dims, 0)
    bound = error_bound(factor, dims, sure)
    links, parent = np.zeros(len(x), dtype=np.int64), np.arange(len(x))
    same = len(left) == len(right) and (left == right).all()
    for at in range(0, len(left), TILE):
        rows = left[at : at + TILE]
        near = estimates(codes[rows], factor[rows], turned) >= (threshold - ROUNDING - bound[rows])[:, None]
        if same:
            near &= np.arange(len(right))[None] > np.arange(at, at + len(rows))[:, None]
        a, b = np.nonzero(near)
        if len(a) > near.size // 8:
            cosine = (x[rows] @ x[right].T / (length[rows, None] * length[right][None]))[a, b]
        else:
            steps = range(0, len(a), 1 << 16)
            cosine = np.concatenate([np.einsum("ij,ij->i", x[rows[a[s : s + (1 << 16)]]], x[right[b[s : s + (1 << 16)]]]) for s in steps] or [np.zeros(0)]) / (length[rows[a]] * length[right[b]])
        sure_pairs = cosine >= threshold
        a, b = rows[a[sure_pairs]], right[b[sure_pairs]]
        if first_in is not None and len(a):
            keys, table = first_in
            fresh = ~(keys[a, :table] == keys[b, :table]).any(axis=1)
            a, b = a[fresh], b[fresh]
        if len(a):
            # whole numbers below 2^53
            links += np.bincount(a, copies[b], len(x)).astype(np.int64) + np.bincount(b, copies[a], len(x)).astype(np.int64)
            parent = join_roots(parent, a, b)
    return links, parent


def near_vectors(embeddings: DataFrame, threshold: float = 0.93, sure: float = 4.5, block: int = 4096, whole: int = 65536, miss: float = 1e-5) -> DataFrame:
    """Returns vec_id, n_links, component_id, kept: a row for each row of ``embeddings`` (vec_id, embedding, label)."""
    spark = embeddings.sparkSession
    kind = embeddings.schema["label"].dataType.simpleString()
    vector = F.col("embedding").cast("array<double>")
    sound = F.col("label").isNotNull() & F.forall(vector, lambda x: x.isNotNull() & ~F.isnan(x) & (F.abs(x) < float("inf"))) & F.exists(vector, lambda x: x != 0)
    sound = F.coalesce(sound, F.lit(False))
    rows = embeddings.where(sound).select(F.col("vec_id").cast("long").alias("vec_id"), "label", F.transform(vector, lambda x: x + F.lit(0.0)).alias("v"))
    alone = embeddings.where(~sound).select(F.col("vec_id").cast("long").alias("vec_id"), F.lit(0).cast("long").alias("n_links"), F.col("vec_id").cast("long").alias("component_id"), F.col("vec_id").isNotNull().alias("kept"))

    def coded(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        for pdf in batches:
            out = pdf.assign(code=b"", factor=0.0).astype({"code": object})
            for dims, part in pdf.groupby(pdf["v"].str.len()):
                code, factor = encode(unit(np.stack(part["v"])))
                out.loc[part.index, "code"] = [c.tobytes() for c in code]
                out.loc[part.index, "factor"] = factor
            yield out

    # equal vectors of a label are one entry
    distinct = rows.groupBy("label", "v").agg(F.count("*").alias("copies"), F.min("vec_id").alias("rep")).withColumn("entry", F.monotonically_increasing_id())
    entries = Written(distinct.mapInPandas(coded, f"label {kind}, v array<double>, copies long, rep long, entry long, code binary, factor double"))
    sized = entries.read().withColumn("dims", F.size("v"))
    labels = sized.groupBy("label", "dims").agg(F.count("*").alias("in_label"))
    big = labels.where(F.col("in_label") > whole)  # at most one row for ``whole`` entries
    ways = sized.join(big, ["label", "dims"], "left").withColumn("in_label", F.coalesce("in_label", F.lit(0)))

    def spread(pdf: pd.DataFrame) -> Iterator[tuple[np.ndarray, np.ndarray, int, int]]:
        """(rows, keys by table, bits, dims) for rows that are banded alike."""
        for (n, dims), part in pdf.groupby(["in_label", "dims"]):
            bits, tables = banding(n, whole, block, threshold, miss)
            at = part.index.to_numpy()
            keys = table_keys(unit(np.stack(part["v"])), bits, tables) if bits else np.zeros((len(part), 1), np.int64)
            yield at, keys, bits, dims

    def keyed(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        for pdf in batches:
            for at, keys, _, dims in spread(pdf):
                tables = keys.shape[1]
                yield pd.DataFrame({"label": np.repeat(pdf["label"].to_numpy()[at], tables), "dims": dims, "tab": np.tile(np.arange(tables), len(at)), "key": keys.ravel(), "entry": np.repeat(pdf["entry"].to_numpy()[at], tables)})

    bucket = ["label", "dims", "tab", "key"]
    light = ways.select("label", "dims", "v", "entry", "in_label").mapInPandas(keyed, f"label {kind}, dims int, tab int, key long, entry long")
    keys_of = Written(light) if big.limit(1).count() else None
    addressed = keys_of.read() if keys_of else sized.select("label", "dims", F.lit(0).alias("tab"), F.lit(0).cast("long").alias("key"), "entry")
    crowded = addressed.groupBy(*bucket).agg(F.count("*").alias("n")).where(F.col("n") > block).withColumn("parts", F.ceil(F.col("n") / block).cast("int")).drop("n")
    crowded = Written(crowded)  # at most one row for ``block`` addresses
    extra = crowded.read().agg(F.sum(F.col("parts") * F.col("parts"))).first()[0] or 0
    slots = max(1, -(-16 * addressed.count() // block) + 16 * extra)
    parted = addressed.join(crowded.read(), bucket, "left").withColumn("parts", F.coalesce("parts", F.lit(1)))
    own = F.pmod(F.xxhash64("entry"), F.col("parts")).cast("int")
    met = parted.withColumn("own", own).withColumn("other", F.explode(F.sequence(F.lit(0), F.col("parts") - 1)))
    units = met.select(*bucket, "entry", "own", F.least("own", "other").alias("i"), F.greatest("own", "other").alias("j"))
    units = units.withColumn("slot", F.pmod(F.xxhash64(*bucket, "i", "j"), F.lit(slots)))
    payload = ways.select("entry", "v", "copies", "code", "factor", "in_label")

    def compare(pdf: pd.DataFrame) -> pd.DataFrame:
        out = []
        for (_, dims, table, _, i, j), part in pdf.groupby([*bucket, "i", "j"], sort=False):
            if len(part) < 2:
                continue
            x, side = np.stack(part["v"]), part["own"].to_numpy()
            codes = np.stack([np.frombuffer(c, dtype=np.uint8) for c in part["code"]])
            bits, tables = banding(int(part["in_label"].iloc[0]), whole, block, threshold, miss)
            first_in = (table_keys(unit(x), bits, tables), int(table)) if bits else None
            entry, copies = part["entry"].to_numpy(), part["copies"].to_numpy()
            links, root = link_block(x, codes, part["factor"].to_numpy(), copies, np.flatnonzero(side == i), np.flatnonzero(side == j), threshold, sure, first_in)
            there = np.flatnonzero(links)
            out.append(pd.DataFrame({"entry": entry[there], "links": links[there], "root": entry[root[there]]}))
        return pd.concat(out) if out else pd.DataFrame({"entry": np.zeros(0, np.int64), "links": np.zeros(0, np.int64), "root": np.zeros(0, np.int64)})

    found = Written(units.join(payload, "entry").groupBy("slot").applyInPandas(compare, "entry long, links long, root long"))
    links = found.read().groupBy("entry").agg(F.sum("links").alias("links"))
    components = connected_components(found.read().select(F.col("entry").alias("a"), F.col("root").alias("b")))
    linked = Written(components.select(F.col("node").alias("entry"), F.col("label").alias("component")).join(sized.select("entry", "rep"), "entry"))
    smallest = linked.read().groupBy("component").agg(F.min("rep").alias("component_id"))
    named = linked.read().join(smallest, "component").join(links, "entry").select("entry", "component_id", "links")
    told = sized.select("label", "v", "copies", "rep", "entry").join(named, "entry", "left").select("label", "v", (F.col("copies") - 1 + F.coalesce("links", F.lit(0))).alias("n_links"), F.coalesce("component_id", "rep").alias("component_id"))
    joined = rows.join(told, ["label", "v"]).withColumn("kept", F.coalesce(F.col("vec_id") == F.col("component_id"), F.lit(False)))
    done = Written(joined.select(*RESULT).unionByName(alone.select(*RESULT)))
    for table in (entries, keys_of, crowded, found, linked):
        if table:
            table.drop()
    return done.read()
