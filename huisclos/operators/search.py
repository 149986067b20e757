"""Which of many values stand in which texts, without comparing each text with each value.

Every value has an anchor: one run of 8, 4, 2 or 1 bytes of its UTF-8 form (the longest of these that
fits), namely the run that the fewest values of its key share. Texts give off only runs that can be
anchors, found in one pass over their bytes with a bit map of all anchors; the map has a fixed size and
only saves work, as what passes it meets its values by a join on key and run. Each pair that has met is
then compared with the whole text. Rows shuffled grow with texts and values, not with their product.
"""

from __future__ import annotations

from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from ..plans.materialize import written

#: Bytes of an anchor, the longest first.
RUNS = (8, 4, 2, 1)
#: Anchors are chosen from so many of a value's runs, spread over it; any one would find the value.
CHOICES = 64
#: Bits of the map: 2 MB, whatever the number of values.
MAP_BITS = 24
#: Values of a text that are compared with it at a time.
PARTS = 64


def _place(run: Column) -> Column:
    """A run's bit in the map."""
    return F.shiftrightunsigned(run, MAP_BITS * 2).bitwiseXOR(F.shiftrightunsigned(run, MAP_BITS)).bitwiseXOR(run).bitwiseAND(F.lit((1 << MAP_BITS) - 1))


def anchors(values: DataFrame, keys: list[str]) -> DataFrame:
    """(``keys``, value, size, run): the anchor of each distinct non-empty value."""
    some = values.where(F.col("value") != "").select(*keys, "value").distinct()
    raw = some.withColumn("__raw", F.col("value").cast("binary"))
    long = F.octet_length("__raw")
    size = F.coalesce(*(F.when(long >= n, F.lit(n)) for n in RUNS))
    sized = raw.withColumn("size", size).withColumn("__step", F.greatest(F.lit(1), F.ceil((long - size + 1) / CHOICES).cast("int")))
    starts = F.sequence(F.lit(1), long - F.col("size") + 1, F.col("__step"))
    # up to eight bytes are one whole number
    runs = F.transform(starts, lambda i: F.conv(F.hex(F.substring("__raw", i, F.col("size"))), 16, -10).cast("long"))
    each = sized.select(*keys, "value", "size", F.explode(F.array_distinct(runs)).alias("run"))
    shared = each.groupBy(*keys, "size", "run").agg(F.count("*").alias("n"))
    weighed = each.join(shared, [*keys, "size", "run"])
    return weighed.groupBy(*keys, "value", "size").agg(F.min_by("run", F.struct("n", "run")).alias("run"))


def anchor_map(found: DataFrame) -> dict[int, np.ndarray]:
    """By size of run, a map with the bits of all anchors set."""
    at = found.select("size", _place(F.col("run")).alias("at"))
    blocks = at.groupBy("size", F.bitmap_bucket_number("at").alias("block")).agg(F.bitmap_construct_agg(F.bitmap_bit_position("at")).alias("bits"))
    maps: dict[int, np.ndarray] = {}
    for r in blocks.collect():  # at most 2 MB for each of the four sizes
        # numbers 1 to 32,768 are block 1; bit positions count from the lowest bit of the first byte
        whole = maps.setdefault(r["size"], np.zeros((1 << MAP_BITS) // 8 + 4096, dtype=np.uint8))
        begin = (r["block"] - 1) * 4096 if r["block"] > 0 else len(whole) - 4096
        whole[begin : begin + 4096] |= np.frombuffer(r["bits"], dtype=np.uint8)
    return maps


def _passes(maps: np.ndarray, runs: np.ndarray) -> np.ndarray:
    u = runs.view(np.uint64)
    at = ((u ^ (u >> np.uint64(MAP_BITS)) ^ (u >> np.uint64(2 * MAP_BITS))) & np.uint64((1 << MAP_BITS) - 1)).astype(np.int64)
    # bit 0 of the map's numbers has the last block, see ``anchor_map``
    bit = np.where(at == 0, (len(maps) - 4096) * 8, at - 1)
    return (maps[bit >> 3] >> (bit & 7)) & 1 == 1


def runs_in(data: bytes, offsets: np.ndarray, size: int, bits: np.ndarray, most: int = 1 << 22) -> tuple[np.ndarray, np.ndarray]:
    """(text, run): the distinct runs of ``size`` bytes in each text that the map lets pass. ``offsets``: where texts begin, and the end."""
    raw = np.frombuffer(data, dtype=np.uint8)
    texts, runs = [], []
    for begin in range(0, max(0, len(raw) - size + 1), most):
        part = raw[begin : begin + most + size - 1]
        n = len(part) - size + 1
        run = np.zeros(n, dtype=np.uint64)
        for i in range(size):
            run = run << np.uint64(8) | part[i : i + n]
        run = run.view(np.int64)
        at = np.flatnonzero(_passes(bits, run))
        text = np.searchsorted(offsets, begin + at, side="right") - 1
        inside = begin + at + size <= offsets[text + 1]
        texts.append(text[inside])
        runs.append(run[at][inside])
    if not texts:
        return np.zeros(0, np.int64), np.zeros(0, np.int64)
    text, run = np.concatenate(texts), np.concatenate(runs)
    order = np.lexsort((run, text))
    text, run = text[order], run[order]
    first = np.ones(len(text), dtype=bool)
    first[1:] = (text[1:] != text[:-1]) | (run[1:] != run[:-1])
    return text[first], run[first]


def values_in_texts(texts: DataFrame, values: DataFrame, keys: list[str], text: str = "text") -> DataFrame:
    """(columns of ``texts``, value): a row for each text and each distinct value of its ``keys`` that stands in it.

    Null and empty values and texts, and null keys, meet nothing. Equal texts are rows of their own.
    """
    spark = texts.sparkSession
    held = written(texts.withColumn("__text", F.monotonically_increasing_id()))
    found = written(anchors(values, keys))
    maps = spark.sparkContext.broadcast(anchor_map(found))  # four times 2 MB at most
    kinds = {f.name: f.dataType.simpleString() for f in texts.schema.fields if f.name in keys}

    def emit(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            column = batch.column("__chars").cast(pa.large_string())
            offsets = np.frombuffer(column.buffers()[1], dtype=np.int64)[column.offset : column.offset + len(column) + 1]
            data = column.buffers()[2].slice(int(offsets[0]), int(offsets[-1] - offsets[0])) if len(column) and column.buffers()[2] is not None else b""
            for size, bits in maps.value.items():
                at, run = runs_in(data, offsets - offsets[0], size, bits) if len(column) else (np.zeros(0, np.int64),) * 2
                if len(at):
                    taken = pa.array(at)
                    yield pa.RecordBatch.from_arrays([*(batch.column(k).take(taken) for k in keys), batch.column("__text").take(taken), pa.array(np.full(len(at), size, np.int32)), pa.array(run)], [*keys, "__text", "size", "run"])

    seen = held.where(F.col(text) != "").select(*keys, "__text", F.col(text).alias("__chars")).mapInArrow(emit, ", ".join([*(f"`{k}` {kinds[k]}" for k in keys), "__text long, size int, run long"]))
    met = seen.join(found, [*keys, "size", "run"]).groupBy("__text", F.pmod(F.xxhash64("value"), F.lit(PARTS)).alias("__part")).agg(F.collect_list("value").alias("__values"))
    both = met.join(held, "__text")
    there = F.filter("__values", lambda v: F.contains(F.col(text), v))
    return both.select(*(F.col(f"`{c}`") for c in texts.columns), F.explode(there).alias("value"))
