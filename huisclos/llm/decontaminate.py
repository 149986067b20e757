"""Benchmark decontamination by greedy string tiling.

Seeds are shared runs of ``least`` words (five). A fixed-size bit table over the benchmark's seed
hashes (2 MB, whatever the benchmark's size) lets a document's seeds through or not while it is read
once; what passes is joined with the benchmark's seeds. For each (document, item) pair the item words
under shared seeds bound the coverage from above, and pairs whose bound is below ``threshold`` go.
Greedy string tiling then decides: it repeatedly marks the longest matches of unmarked words, found
by running Karp-Rabin hashes and confirmed word by word, so that passages in another order still
cover the item. A pair is contaminated if tiles of at least ``least`` words cover ``threshold`` of
the item's words.

Words are runs of letters, digits and characters beyond ASCII, lower-cased in A-Z. Words are compared
by 64-bit hashes.

Edge cases: null and empty texts, and items of fewer than ``least`` words, match nothing. Each text is
judged by itself, also where documents share an id or have none; rows equal in id and text give a pair
once. So is each item: an item without an id gives pairs with a null item_id, and different texts under one
item_id give a pair each; items equal in id and text count once. Empty tables give no rows. Extra columns are ignored. Whole texts are read, however long.
"""

from __future__ import annotations

from collections import defaultdict
from collections.abc import Iterator

import numpy as np
import pandas as pd
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from .arrowtext import gram_hashes, text_slices, word_hashes
from .common import Written

TABLE_BITS = 24
KR_BASE, KR_MOD = 1_000_003, (1 << 61) - 1
GAP = 0


def _rolling(words: list[int], marked: list[bool], size: int) -> Iterator[tuple[int, int]]:
    """(start, Karp-Rabin hash) of every window of ``size`` unmarked words."""
    top, h, run = pow(KR_BASE, size - 1, KR_MOD), 0, 0
    for i, w in enumerate(words):
        if marked[i] or w == GAP:
            h = run = 0
            continue
        if run >= size:
            h = (h - words[i - size] * top) % KR_MOD
        h, run = (h * KR_BASE + w) % KR_MOD, run + 1
        if run >= size:
            yield i - size + 1, h


def greedy_tiles(item: list[int], doc: list[int], least: int) -> list[tuple[int, int, int]]:
    """Tiles (item start, doc start, length), the longest first; no word is in two tiles.

    ``GAP`` in ``doc`` matches nothing. The search length starts at half the item's and halves. Matches
    found at a length are taken whole, so those longer than it come first too.
    """
    mine, theirs = [False] * len(item), [False] * len(doc)
    tiles: list[tuple[int, int, int]] = []
    size = max(least, len(item) // 2)
    while size >= least:
        seeds = defaultdict(list)
        for start, h in _rolling(item, mine, size):
            seeds[h].append(start)
        found = []
        for at, h in _rolling(doc, theirs, size) if seeds else ():
            for start in seeds.get(h, ()):
                if start and at and not mine[start - 1] and not theirs[at - 1] and item[start - 1] == doc[at - 1]:
                    continue  # inside the match that begins one word earlier
                n = 0
                while start + n < len(item) and at + n < len(doc) and item[start + n] == doc[at + n] and not mine[start + n] and not theirs[at + n]:
                    n += 1
                if n >= size:
                    found.append((n, start, at))
        again = False
        for n, start, at in sorted(found, key=lambda x: (-x[0], x[1], x[2])):
            if any(mine[start : start + n]) or any(theirs[at : at + n]):
                again = True  # part of it may still be free
                continue
            mine[start : start + n] = theirs[at : at + n] = [True] * n
            tiles.append((start, at, n))
        if not again or not found:
            if size == least:
                break
            size = max(least, size // 2)
    return tiles


def _words_of(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    for rows, data, offsets in text_slices(batches, most=1 << 20):
        words, at = word_hashes(data, offsets)
        words = np.where(words == GAP, np.uint64(1), words).view(np.int64)
        yield pa.RecordBatch.from_arrays([rows.column(0), rows.column(1), pa.array([words[a:b] for a, b in zip(at[:-1], at[1:])], pa.list_(pa.int64()))], names=["item_key", "item_id", "words"])


def seed_table(seeds: DataFrame) -> np.ndarray:
    """A bit for each seed hash's low bits: words of 64 bits, of fixed total size."""
    slot = F.col("seed").bitwiseAND((1 << TABLE_BITS) - 1)
    bit = F.expr("shiftleft(1L, cast(seed & 63 as int))")
    rows = seeds.groupBy(F.shiftright(slot, 6).alias("word")).agg(F.bit_or(bit).alias("bits")).collect()  # at most 2^18 rows
    table = np.zeros(1 << (TABLE_BITS - 6), dtype=np.uint64)
    for r in rows:
        table[r["word"]] = np.int64(r["bits"]).view(np.uint64)
    return table


def _seeds_in_documents(table: np.ndarray, least: int):
    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for rows, data, offsets in text_slices(batches, most=1 << 20):
            words, at = word_hashes(data, offsets)
            words = np.where(words == GAP, np.uint64(1), words)
            grams = gram_hashes(words, least)
            low = grams & np.uint64((1 << TABLE_BITS) - 1)
            hit = np.nonzero((table[low >> np.uint64(6)] >> (low & np.uint64(63))) & np.uint64(1))[0]
            row = np.searchsorted(at, hit, side="right") - 1
            inside = hit + least <= at[row + 1]
            hit, row = hit[inside], row[inside]
            if len(hit):
                ids, text_keys = (rows.column(c).take(pa.array(row)) for c in (0, 1))
                own = pa.array([words[i : i + least].view(np.int64) for i in hit], pa.list_(pa.int64()))
                yield pa.RecordBatch.from_arrays([ids, text_keys, pa.array(hit - at[row]), pa.array(grams[hit].view(np.int64)), own], names=["doc_id", "text_key", "at", "seed", "words"])

    return run


def _tile_pairs(least: int, threshold: float):
    def run(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        for pdf in batches:
            out = []
            for doc_id, item_id, item, hits in zip(pdf["doc_id"], pdf["item_id"], pdf["words"], pdf["hits"]):
                zone: list[int] = []
                place: list[int] = []
                for at, words in sorted({(h["at"], tuple(h["words"])) for h in hits}):
                    if place and at > place[-1] + 1:
                        zone.append(GAP)
                        place.append(-1)
                    skip = max(0, place[-1] + 1 - at) if place and place[-1] >= 0 else 0
                    zone += words[skip:]
                    place += range(at + skip, at + len(words))
                tiles = greedy_tiles([int(w) for w in item], [int(w) for w in zone], least)
                covered = sum(n for _, _, n in tiles)
                if covered >= threshold * len(item):
                    spans = ",".join(f"{place[d]}:{i}:{n}" for i, d, n in sorted(tiles, key=lambda t: t[1]))
                    out.append((doc_id, item_id, len(item), covered, covered / len(item), len(tiles), spans))
            yield pd.DataFrame(out, columns=["doc_id", "item_id", "n_words", "n_covered", "coverage", "n_tiles", "tiles"])

    return run


PAIRS = "doc_id string, item_id string, n_words long, n_covered long, coverage double, n_tiles long, tiles string"


def contaminated_pairs(docs: DataFrame, benchmark: DataFrame, least: int = 5, threshold: float = 0.8, key: str = "doc_id") -> DataFrame:
    """One row for each (document, item) pair whose tiles cover at least ``threshold`` of the item.

    ``key`` names the column that identifies documents, of any simple type; the result keeps its name and type.
    ``tiles``: document word : item word : length, comma-joined.
    """
    kind = docs.schema[key].dataType.simpleString()
    keyed_items = benchmark.select(F.col("item_id").cast("long").alias("item_id"), "text").select(F.xxhash64("item_id", "text").alias("item_key"), "item_id", "text")
    items = Written(keyed_items.dropDuplicates(["item_key"]).mapInArrow(_words_of, "item_key long, item_id long, words array<long>"))

    def grams(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        for pdf in batches:
            for item_key, words in zip(pdf["item_key"], pdf["words"]):
                h = gram_hashes(np.asarray(words, dtype=np.int64).view(np.uint64), least).view(np.int64)
                yield pd.DataFrame({"item_key": item_key, "item_at": np.arange(len(h)), "seed": h})

    seeds = Written(items.read().select("item_key", "words").mapInPandas(grams, "item_key long, item_at long, seed long"))
    table = seed_table(seeds.read())
    keyed = docs.select(F.col(key).cast("string").alias("doc_id"), F.xxhash64("text").alias("text_key"), "text")
    found = keyed.mapInArrow(_seeds_in_documents(table, least), "doc_id string, text_key long, at long, seed long, words array<long>")
    # one row for a seed and item, however often the item repeats it
    by_item = seeds.read().groupBy("seed", "item_key").agg(F.collect_set("item_at").alias("item_ats"))
    hits = found.join(by_item, "seed")
    pairs = hits.groupBy("doc_id", "text_key", "item_key").agg(F.collect_set(F.struct("at", "words")).alias("hits"), F.flatten(F.collect_set("item_ats")).alias("item_ats"))
    under = F.size(F.array_distinct(F.flatten(F.transform("item_ats", lambda p: F.sequence(p, p + least - 1)))))
    likely = pairs.join(items.read(), "item_key").where(under >= threshold * F.size("words"))
    # ids go through pandas as text: beside nulls, numbers would turn into floats
    ids = [F.col(c).cast("string").alias(c) for c in ("doc_id", "item_id")]
    tiled = likely.select(*ids, "words", "hits").mapInPandas(_tile_pairs(least, threshold), PAIRS)
    rest = [c for c in tiled.columns if c not in ("doc_id", "item_id")]
    return tiled.select(F.col("doc_id").cast(kind).alias(key), F.col("item_id").cast("long").alias("item_id"), *rest)
