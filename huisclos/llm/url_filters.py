"""URL filters by a Bloom filter cascade.

A blocklist or allowlist is a set of keys (host plus path prefix). The cascade's first Bloom filter
holds the listed keys, the second holds those unlisted keys of the corpus's complete key universe
that pass the first by mistake, the third the listed keys that pass the second, and so on until a
level lets nothing through by mistake. For every key of the universe membership is then exact, and a
url is judged by a few bit tests instead of a join with the list.

Edge cases: a null url, or one without ``://``, has an empty host and path and matches no rule; such
rows get the default verdict. Extra columns of the input are ignored. Repeated rows are judged alike.
"""

from __future__ import annotations

import math
from collections.abc import Iterable, Iterator
from dataclasses import dataclass, field

import numpy as np
import pandas as pd
import xxhash
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from .common import Written

UPPER, LOWER = "ABCDEFGHIJKLMNOPQRSTUVWXYZ", "abcdefghijklmnopqrstuvwxyz"


def url_host(url: Column) -> Column:
    after = F.substring(url, F.instr(url, "://") + 3, F.length(url))
    return F.coalesce(F.when(F.instr(url, "://") > 0, F.translate(F.regexp_extract(after, r"^[^/?#]*", 0), UPPER, LOWER)), F.lit(""))


def url_path(url: Column) -> Column:
    after = F.substring(url, F.instr(url, "://") + 3, F.length(url))
    return F.coalesce(F.when(F.instr(url, "://") > 0, F.regexp_extract(after, r"^[^/?#]*([^?#]*)", 1)), F.lit(""))


@dataclass
class Cascade:
    """Bloom filters by level; ``holds`` is exact for keys of the universe it was built over."""

    levels: list[tuple[int, int, np.ndarray]] = field(default_factory=list)

    def holds(self, key: str) -> bool:
        for depth, (bits, hashes, words) in enumerate(self.levels):
            if not _passes(key, depth, bits, hashes, words):
                return depth % 2 == 1
        return len(self.levels) % 2 == 1

    @property
    def size_bytes(self) -> int:
        return sum(words.nbytes for _, _, words in self.levels)


def _positions(key: str, depth: int, bits: int, hashes: int) -> list[int]:
    digest = xxhash.xxh3_128_intdigest(key.encode("utf-8", "surrogatepass"), seed=depth)
    first, step = digest >> 64, (digest & (2**64 - 1)) | 1
    return [(first + i * step) % bits for i in range(hashes)]


def _passes(key: str, depth: int, bits: int, hashes: int, words: np.ndarray) -> bool:
    return all((int(words[p >> 6]) >> (p & 63)) & 1 for p in _positions(key, depth, bits, hashes))


def _filter_of(keys: DataFrame, n: int, depth: int, fpr: float, max_bytes: int) -> tuple[int, int, np.ndarray]:
    """A Bloom filter over ``keys``; each executor sets bits, Spark ORs the words."""
    bits = max(64, math.ceil(-n * math.log(fpr) / math.log(2) ** 2 / 64) * 64)
    if bits // 8 > max_bytes:
        raise ValueError(f"a filter for {n} keys takes {bits // 8} bytes, more than max_bytes; split the list by host")
    hashes = max(1, round(bits / n * math.log(2)))

    def set_bits(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        for pdf in batches:
            at = np.array([p for k in pdf["key"] for p in _positions(k, depth, bits, hashes)], dtype=np.int64)
            yield pd.DataFrame({"word": at >> 6, "bit": np.left_shift(np.int64(1), at & 63)})

    rows = keys.mapInPandas(set_bits, "word long, bit long").groupBy("word").agg(F.bit_or("bit").alias("bits")).collect()
    words = np.zeros(bits // 64, dtype=np.uint64)
    for row in rows:  # at most bits / 64 rows, checked above
        words[row["word"]] = np.int64(row["bits"]).view(np.uint64)
    return bits, hashes, words


def build_cascade(universe: DataFrame, fpr: float = 0.02, max_bytes: int = 1 << 26, max_levels: int = 40) -> Cascade:
    """``universe``: every key once, columns (key string, listed boolean).

    ``max_bytes`` bounds each filter, which is what goes to the executors. An empty list makes a
    cascade without levels, which holds nothing.
    """
    cascade, left = Cascade(), universe
    for depth in range(max_levels):
        side = F.col("listed") if depth % 2 == 0 else ~F.col("listed")
        mine = left.where(side)
        n = mine.count()
        if not n:
            return cascade
        bits, hashes, words = _filter_of(mine, n, depth, fpr, max_bytes)
        cascade.levels.append((bits, hashes, words))

        def still(batches: Iterator[pd.DataFrame], depth=depth, bits=bits, hashes=hashes, words=words) -> Iterator[pd.DataFrame]:
            """The side just encoded stays for the next level but one; the other side stays where it passes."""
            for pdf in batches:
                passes = [_passes(k, depth, bits, hashes, words) for k in pdf["key"]]
                yield pdf[np.array(passes, dtype=bool)]

        left = left.mapInPandas(still, left.schema)
    raise ValueError("the cascade did not end; lower fpr")


def _tails(host: str) -> list[str]:
    parts = host.split(".")
    return [".".join(parts[i:]) for i in range(len(parts))] if host else []


def candidate_keys(host: str, path: str, lengths: Iterable[int]) -> list[str]:
    """Every rule string that could fit, the longest first."""
    return sorted((t + path[:n] for t in _tails(host) for n in lengths if len(path) >= n), key=lambda k: (-len(k), k))


def judge_urls(pages: DataFrame, rules: list[tuple[str, str]], default: str = "allow", fpr: float = 0.02) -> DataFrame:
    """``rules``: (host/path, ``allow`` or ``block``). Returns page_id, host, path, rule, verdict.

    The longest fitting rule decides; ``default`` holds for urls that no listed key fits.
    """
    actions = dict(rules)
    if any("/" not in key or v not in ("allow", "block") for key, v in rules):
        raise ValueError("a rule is (host/path, allow or block)")
    lengths = sorted({len(k) - k.index("/") for k in actions})
    longest = lengths[-1] if lengths else 0
    urls = pages.select("page_id", url_host(F.col("url")).alias("host"), url_path(F.col("url")).alias("path"))

    def keys(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        for pdf in batches:
            found = {k for h, p in set(zip(pdf["host"], pdf["start"])) for k in candidate_keys(h, p, lengths)}
            yield pd.DataFrame({"key": sorted(found)}, dtype=object)

    starts = urls.select("host", F.substring("path", 1, longest).alias("start")).distinct()
    universe = Written(starts.mapInPandas(keys, "key string").distinct()).read()
    cascades = {}
    for action in ("block", "allow"):
        listed = [k for k, v in actions.items() if v == action]
        cascades[action] = build_cascade(universe.select("key", F.col("key").isin(listed).alias("listed")), fpr)

    def judge(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        known: dict[tuple[str, str], tuple[str | None, str]] = {}
        for pdf in batches:
            out = []
            for host, path in zip(pdf["host"], pdf["path"]):
                at = (host, path[:longest])
                if at not in known:
                    if len(known) > 200_000:
                        known.clear()
                    known[at] = next(((k, a) for k in candidate_keys(*at, lengths) for a in cascades if cascades[a].holds(k)), (None, default))
                out.append(known[at])
            yield pdf.assign(rule=[r for r, _ in out], verdict=[v for _, v in out])

    return urls.mapInPandas(judge, "page_id long, host string, path string, rule string, verdict string")
