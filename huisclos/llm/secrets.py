"""Secret scans: base patterns plus a randomness test battery.

Base kinds are assignments of passwords and keys, access key ids and long lower-case hex runs.
The battery looks at what these leave free of each run of token characters, and at its pieces between
separators (each set of ``/``, ``+``, ``-`` and ``_``), where they are 20 characters or longer:
a key in a url path or behind a word and a dash is a piece of its run. A piece inside a longer random span isn't reported again.

The null hypothesis is "ordinary text". Its model is fitted on the whole corpus (of runs of 20 token characters or more each different part once a slice of it): how often each kind of
character (small, capital, digit, separator) follows another, and each letter another whatever their case, smoothed.
A piece's evidence is the e-value: its probability as independent uniform symbols of an encoding (a mixture over the
alphabets that hold all its characters) over its probability as ordinary text. Under the null its mean is 1 at
most, so evidence for a secret only ever comes from the text itself, and a piece on which nothing can be said is not
a secret. The battery is the other factor: the encoding is inferred (the smallest alphabet that holds all
characters), characters become symbol numbers, and "symbols are independent and uniform" is tested three ways:
chi-squared over equal alphabet cells, Wald-Wolfowitz runs about the median, and lag-one serial
correlation. Each p-value falls into one of four classes; how probable the three classes are for uniform symbols of this encoding and
length (from drawn tokens) over how often the corpus's pieces of this encoding and length show them multiplies the e-value.

The e-value Benjamini-Hochberg procedure at level ``q`` within each stratum of length decides over the whole corpus which
pieces are secrets (kind ``random``): false ones are at most a share ``q`` of them in the mean, however pieces
depend on each other (those of one run do). Strata by length keep the many short pieces, on which the
evidence is weak, from setting the threshold of long ones.

Evidence goes to the driver as counts in fixed bins for each stratum, and the corpus's character pairs as one
table of 67 x 67 counts, never as rows.

Edge cases: null texts count as empty and get zero counts and the hash of the empty string. Repeated
rows are scanned alike. An empty table gives no rows. Extra columns are ignored. Texts of any length
are scanned whole; offsets are code points.
"""

from __future__ import annotations

import hashlib
import math
import re
from bisect import bisect_right
from collections.abc import Iterator
from functools import lru_cache

import numpy as np
import pandas as pd
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from ..functions.regex import Growing
from .arrowtext import runs, text_slices
from .common import Written

ASSIGN = re.compile(rb"""(password|passwd|secret|token|api_?key)["']?\x20*[:=]\x20*["']?([A-Za-z0-9+/_.=-]+)""", re.IGNORECASE)
ACCESS = re.compile(rb"AKIA[A-Z0-9]+")
#: One of these, lower-cased, stands in every assignment.
ASSIGN_WORDS = (b"password", b"passwd", b"secret", b"token", b"apikey", b"api_key")
KINDS = ("assign", "access", "hex", "random")
#: Alphabets of encodings, the smallest first.
ALPHABETS = (
    ("hex", "0123456789abcdef"),
    ("HEX", "0123456789ABCDEF"),
    ("base32", "ABCDEFGHIJKLMNOPQRSTUVWXYZ234567"),
    ("base36", "0123456789abcdefghijklmnopqrstuvwxyz"),
    ("BASE36", "0123456789ABCDEFGHIJKLMNOPQRSTUVWXYZ"),
    ("base62", "ABCDEFGHIJKLMNOPQRSTUVWXYZabcdefghijklmnopqrstuvwxyz0123456789"),
    ("base64", "ABCDEFGHIJKLMNOPQRSTUVWXYZabcdefghijklmnopqrstuvwxyz0123456789+/"),
    ("base64url", "ABCDEFGHIJKLMNOPQRSTUVWXYZabcdefghijklmnopqrstuvwxyz0123456789-_"),
    ("token", "ABCDEFGHIJKLMNOPQRSTUVWXYZabcdefghijklmnopqrstuvwxyz0123456789+/-_"),
)
BINS, BIN_WIDTH = 400, 0.1
STRATA = (20, 24, 32, 40, 64, 128, 256)
SEPARATORS = b"/+-_"


def _normal_tail(z: float) -> float:
    return math.erfc(abs(z) / math.sqrt(2))


def _chi_tail(x: float, df: int) -> float:
    """Upper tail by the Wilson-Hilferty cube-root approximation."""
    if x <= 0:
        return 1.0
    z = ((x / df) ** (1 / 3) - (1 - 2 / (9 * df))) / math.sqrt(2 / (9 * df))
    return 0.5 * math.erfc(z / math.sqrt(2))


#: Symbols of pairs: small letters 0-25, capitals 26-51, digits 52-61, separators 62-65, anything else 66.
SYMBOLS = 67
_SYMBOL = np.full(256, SYMBOLS - 1, dtype=np.int64)
for _i, _c in enumerate("abcdefghijklmnopqrstuvwxyzABCDEFGHIJKLMNOPQRSTUVWXYZ0123456789+/-_"):
    _SYMBOL[ord(_c)] = _i
#: The kind of each symbol (small, capital, digit, separator, other) and its letter or digit whatever the case (26 letters, 10 digits, 4 separators, other).
_KIND = np.repeat(np.arange(5), (26, 26, 10, 4, 1))
_FOLD = np.concatenate((np.arange(26), np.arange(26), np.arange(26, 41)))


def pair_counts(raw: np.ndarray, starts: np.ndarray = (), ends: np.ndarray = ()) -> np.ndarray:
    """How often each symbol follows each other one in these bytes.

    The runs from ``starts`` to ``ends`` count once for each different part between separators, so a key that many texts hold doesn't look ordinary.
    """
    code, other, parts = _SYMBOL[raw], SYMBOLS - 1, set()
    for a, b in zip(starts, ends):
        code[a:b] = other
        parts.update(raw[a:b].tobytes().replace(b"+", b"/").replace(b"-", b"/").replace(b"_", b"/").split(b"/"))
    extra = _SYMBOL[np.frombuffer(b" ".join(sorted(parts)), dtype=np.uint8)]
    code = np.concatenate(([other], code, [other], extra))
    return np.bincount(code[:-1] * SYMBOLS + code[1:], minlength=SYMBOLS * SYMBOLS)


def ordinary_model(pairs: np.ndarray) -> np.ndarray:
    """log10 P(symbol | symbol before) of ordinary text, over token symbols.

    The kind given the kind before (a fifth of the mass spread evenly, so that identifiers' capitals and digits cost little)
    times the letter or digit given the one before, of the same kind, whatever the case of both (a tenth spread evenly).
    """
    pairs = pairs.reshape(SYMBOLS, SYMBOLS).astype(float)[:, :-1]
    kinds, folds = np.zeros((5, 4)), np.zeros((41, 41))
    np.add.at(kinds, (_KIND[:, None], _KIND[None, :-1]), pairs)
    np.add.at(folds, (_FOLD[:, None], _FOLD[None, :-1]), pairs)
    kind = 0.8 * (kinds + 0.5) / (kinds.sum(axis=1, keepdims=True) + 2) + 0.05
    group = np.repeat(np.arange(3), (26, 10, 4))  # letters, digits, separators
    letter = np.zeros((41, 40))
    for g, size in enumerate((26, 10, 4)):
        own = folds[:, :-1][:, group == g]
        letter[:, group == g] = 0.9 * (own + 0.5) / (own.sum(axis=1, keepdims=True) + 0.5 * size) + 0.1 / size
    return np.log10(kind[_KIND][:, _KIND[:-1]] * letter[_FOLD][:, _FOLD[:-1]])


def evidence(token: str, model: np.ndarray) -> float:
    """log10 of the e-value against ordinary text."""
    code = _SYMBOL[np.frombuffer(token.encode(), dtype=np.uint8)]
    ordinary = float(model[np.concatenate(([SYMBOLS - 1], code[:-1])), code].sum())
    held = set(token)
    fits = [-len(token) * math.log10(len(letters)) for _, letters in ALPHABETS if held <= set(letters)]
    top = max(fits)
    return top + math.log10(sum(10 ** max(f - top, -300) for f in fits) / len(ALPHABETS)) - ordinary


def infer_alphabet(token: str) -> str | None:
    return next((letters for _, letters in ALPHABETS if set(token) <= set(letters)), None)


def battery(token: str) -> tuple[float, float, float]:
    """p-values of the three tests of "independent uniform symbols" of the inferred encoding: chi-squared, runs, serial correlation; zeros where no encoding fits."""
    letters = infer_alphabet(token)
    if letters is None:
        return 0.0, 0.0, 0.0
    size, n = len(letters), len(token)
    x = np.array([letters.index(c) for c in token], dtype=float)
    cells = min(8, max(2, n // 5))
    observed = np.bincount((x * cells // size).astype(int), minlength=cells)
    share = np.bincount(np.arange(size) * cells // size, minlength=cells) / size
    p_chi = _chi_tail(float(((observed - n * share) ** 2 / (n * share)).sum()), cells - 1)
    high = x >= size / 2
    a, b = int(high.sum()), n - int(high.sum())
    if a and b:
        mean = 2 * a * b / n + 1
        var = (mean - 1) * (mean - 2) / (n - 1)
        p_runs = _normal_tail((1 + int((high[1:] != high[:-1]).sum()) - mean) / math.sqrt(var)) if var > 0 else 0.0
    else:
        p_runs = 0.0
    d = x - x.mean()
    p_serial = _normal_tail(float((d[1:] * d[:-1]).sum() / (d * d).sum()) * math.sqrt(n)) if d.any() else 0.0
    return p_chi, p_runs, p_serial


def randomness(token: str) -> float:
    """The battery's combined p-value (Bonferroni)."""
    return min(1.0, 3 * min(battery(token)))


#: Edges between the classes of a p-value; three classes make a cell.
EDGES = (0.001, 0.05, 0.3)
CLASSES = len(EDGES) + 1
CELLS = CLASSES**3


def cell_of(token: str) -> int:
    """Encoding and the classes of the three p-values, as one number; -1 where no encoding fits."""
    letters = infer_alphabet(token)
    if letters is None:
        return -1
    encoding = next(i for i, (_, held) in enumerate(ALPHABETS) if held == letters)
    cell = 0
    for p in battery(token):
        cell = cell * CLASSES + int(np.searchsorted(EDGES, p, side="right"))
    return encoding * CELLS + cell


@lru_cache(maxsize=1)
def uniform_cells(draws: int = 400, seed: int = 5) -> np.ndarray:
    """P(cell | uniform symbols) by stratum and encoding, from drawn tokens; the tests count as independent of each other there."""
    rng = np.random.default_rng(seed)
    out = np.zeros((len(STRATA), len(ALPHABETS), CELLS))
    for s, length in enumerate(STRATA):
        for e, (_, letters) in enumerate(ALPHABETS):
            symbols = np.array(list(letters))
            classes = np.full((3, CLASSES), 0.5)
            for _ in range(draws):
                cell = cell_of("".join(symbols[rng.integers(0, len(symbols), length)])) % CELLS
                for test in range(3):
                    classes[test, cell // CLASSES ** (2 - test) % CLASSES] += 1
            a, b, c = classes / classes.sum(axis=1, keepdims=True)
            out[s, e] = (a[:, None, None] * b[None, :, None] * c[None, None, :]).ravel()
    return out


def battery_evidence(counts: dict[tuple[int, int], int], prior: float = 64.0) -> np.ndarray:
    """log10 of P(cell | uniform symbols) over P(cell | ordinary piece), by stratum and encoding.

    ``counts``: the corpus's pieces by (stratum, cell); ``prior`` pieces are spread like uniform ones, so that where little is known
    the battery says nothing. Secrets among the pieces make the ordinary ones look more random, never less.
    """
    uniform = uniform_cells()
    held = np.zeros_like(uniform)
    for (s, cell), n in counts.items():
        if cell >= 0:
            held[s, cell // CELLS, cell % CELLS] += n
    ordinary = (held + prior * uniform) / (held.sum(axis=2, keepdims=True) + prior)
    return np.log10(uniform / ordinary)


def stratum(length: int) -> int:
    return max(i for i, least in enumerate(STRATA) if length >= least)


def pieces(run: bytes) -> list[tuple[int, int]]:
    """The run and its parts between the bytes of each set of the separators that it holds: (start, end) of those long enough, each once."""
    held = [c for c in SEPARATORS if c in run]
    found = {(0, len(run))}
    for picked in range(1, 1 << len(held)):
        cut = np.isin(np.frombuffer(run, dtype=np.uint8), [c for i, c in enumerate(held) if picked >> i & 1])
        at = np.concatenate(([-1], np.nonzero(cut)[0], [len(run)]))
        found.update((a + 1, b) for a, b in zip(at[:-1].tolist(), at[1:].tolist()) if b - a > STRATA[0])
    return sorted(found)


def merged(spans: list[tuple[int, int]]) -> tuple[list[int], list[int]]:
    """Starts and ends of what ``spans`` cover, in order and apart from each other."""
    starts, ends = [], []
    for s, e in sorted(spans):
        if ends and s <= ends[-1]:
            ends[-1] = max(ends[-1], e)
        else:
            starts.append(s)
            ends.append(e)
    return starts, ends


def free_parts(start: int, end: int, taken: tuple[list[int], list[int]]) -> list[tuple[int, int]]:
    """What the ``merged`` spans leave of a run, where long enough. Only those that touch the run are looked at."""
    starts, ends = taken
    out, at = [], bisect_right(ends, start)
    while start < end:
        free = starts[at] if at < len(starts) and starts[at] < end else end
        if free - start >= STRATA[0]:
            out.append((start, free))
        start = ends[at] if free < end else end
        at += 1
    return out


def _byte_classes() -> tuple[np.ndarray, np.ndarray]:
    hexes = np.array([chr(b) in "0123456789abcdef" for b in range(256)])
    tokens = np.array([b < 128 and (chr(b).isalnum() or chr(b) in "+/_-") for b in range(256)])
    return hexes, tokens


def _holders(data: bytes, word: bytes, offsets: np.ndarray) -> set[int]:
    """Rows in which ``word`` occurs (or only straddles their border, which the pattern then settles)."""
    found, at = set(), data.find(word)
    while at >= 0:
        row = int(np.searchsorted(offsets, at, side="right")) - 1
        found.add(row)
        at = data.find(word, max(at + 1, int(offsets[row + 1]) - len(word) + 1))
    return found


def scan_batch(data: bytes, offsets: np.ndarray) -> dict[int, list[tuple[int, int, int]]]:
    """Row to (start, kind, end) with byte offsets within the row: base spans, and kind 3 for every piece to test."""
    hexes, tokens = _byte_classes()
    raw = np.frombuffer(data, dtype=np.uint8)
    spans: dict[int, list[tuple[int, int, int]]] = {}

    def add(row: int, start: int, kind: int, end: int) -> None:
        spans.setdefault(row, []).append((start, kind, end))

    folded = data.lower()
    for row in sorted(set().union(*(_holders(folded, w, offsets) for w in ASSIGN_WORDS))):
        for m in ASSIGN.finditer(data[offsets[row] : offsets[row + 1]]):
            if len(m[2]) >= 12:
                add(row, m.start(), 0, m.end())
    for row in sorted(_holders(data, b"AKIA", offsets)):
        for m in ACCESS.finditer(data[offsets[row] : offsets[row + 1]]):
            if m.end() - m.start() >= 18:
                add(row, m.start(), 1, m.end())
    starts, ends = runs(hexes[raw], offsets, 16)
    for row, a, b in zip(np.searchsorted(offsets, starts, side="right") - 1, starts, ends):
        add(int(row), int(a - offsets[row]), 2, int(b - offsets[row]))
    starts, ends = runs(tokens[raw], offsets, STRATA[0])
    base = {row: merged([(s, e) for s, _, e in own]) for row, own in spans.items()}
    for row, a, b in zip((np.searchsorted(offsets, starts, side="right") - 1).tolist(), starts.tolist(), ends.tolist()):
        row_at = int(offsets[row])
        for start, end in free_parts(a - row_at, b - row_at, base.get(row, ([], []))):
            for i, j in pieces(data[row_at + start : row_at + end]):
                add(row, start + i, 3, start + j)
    return spans


def _joined(spans: list[tuple[int, int, int]]) -> str:
    return ",".join(f"{KINDS[k]}:{a}:{b}" for a, k, b in sorted(spans))


SCANNED = "doc_id long, n_assign long, n_access long, n_hex long, base_sha256 string, found array<struct<start:int,kind:int,end:int,token:string>>, pairs array<long>"


def _scan(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    """A row for each text; the first one of a slice also carries the slice's character pairs."""
    span = pa.struct([("start", pa.int32()), ("kind", pa.int32()), ("end", pa.int32()), ("token", pa.string())])
    empty = hashlib.sha256(b"").hexdigest()
    for rows, data, offsets in text_slices(batches):
        spans = scan_batch(data, offsets)
        n = rows.num_rows
        counts, shas, found = np.zeros((3, n), dtype=np.int64), [empty] * n, [[]] * n
        raw = np.frombuffer(data, dtype=np.uint8)
        for row, own in spans.items():
            at = int(offsets[row])
            before = np.concatenate(([0], np.cumsum((raw[at : offsets[row + 1]] & 0xC0) != 0x80)))
            placed = sorted((int(before[a]), k, int(before[b]), data[at + a : at + b].decode() if k == 3 else None) for a, k, b in own)
            base = [s[:3] for s in placed if s[1] < 3]
            for s in base:
                counts[s[1], row] += 1
            shas[row] = hashlib.sha256(_joined(base).encode()).hexdigest()
            found[row] = [dict(zip(("start", "kind", "end", "token"), s)) for s in placed]
        pairs = [pair_counts(raw, *runs(_byte_classes()[1][raw], offsets, STRATA[0])), *[None] * (n - 1)] if n else []
        columns = [rows.column(0), *(pa.array(c) for c in counts), pa.array(shas, pa.string()), pa.array(found, pa.list_(span)), pa.array(pairs, pa.list_(pa.int64()))]
        yield pa.RecordBatch.from_arrays(columns, names=["doc_id", "n_assign", "n_access", "n_hex", "base_sha256", "found", "pairs"])


def rejection_bins(counts: dict[tuple[int, int], int], q: float) -> dict[int, int]:
    """For each stratum the first bin (of log10 e) that the e-value Benjamini-Hochberg procedure rejects; BINS if none.

    A bin's smallest e-value stands for all in it, so the level holds.
    """
    out = {}
    for s in {s for s, _ in counts}:
        total = sum(n for (k, _), n in counts.items() if k == s)
        rank, cut = 0, BINS
        for b in range(BINS - 1, 0, -1):
            rank += counts.get((s, b), 0)
            if rank and 10 ** (b * BIN_WIDTH) >= total / (q * rank):
                cut = b
        out[s] = cut
    return out


def _read(model: np.ndarray):
    """For each piece the evidence of its letters and its cell; base spans have neither."""

    def run(tokens: pd.Series) -> pd.DataFrame:
        letters = tokens.map(lambda own: [0.0 if t is None else evidence(t, model) for t in own])
        cells = tokens.map(lambda own: [-1 if t is None else cell_of(t) for t in own])
        return pd.DataFrame({"letters": letters, "cells": cells})

    return run


def _binned(tests: np.ndarray):
    """The bin of each piece's whole evidence: letters and battery; 0 where no encoding fits."""

    def run(letters: pd.Series, cells: pd.Series, lengths: pd.Series) -> pd.Series:
        def one(e: float, cell: int, length: int) -> int:
            if cell < 0 or length < STRATA[0]:
                return 0
            return min(BINS - 1, max(0, int((e + tests[stratum(length), cell // CELLS, cell % CELLS]) / BIN_WIDTH)))

        return pd.Series([[one(*p) for p in zip(*row)] for row in zip(letters, cells, lengths)])

    return run


def scan_secrets(docs: DataFrame, q: float = 0.05) -> DataFrame:
    """Returns doc_id, n_assign, n_access, n_hex, base_sha256, spans (kind:start:end, comma-joined), n_random."""
    scanned = Written(docs.select("doc_id", "text").mapInArrow(_scan, SCANNED))
    sums = scanned.read().where("pairs IS NOT NULL").select(F.posexplode("pairs").alias("at", "n")).groupBy("at").agg(F.sum("n").alias("n")).collect()  # SYMBOLS^2 rows
    pairs = np.zeros(SYMBOLS * SYMBOLS)
    for r in sums:
        pairs[r["at"]] = r["n"]
    # only rows with a piece to test go through Python
    tested = F.exists("found", lambda t: t["kind"] == 3)
    rows = scanned.read().drop("pairs")
    strata = F.array(*map(F.lit, STRATA))
    columns = ["doc_id", "n_assign", "n_access", "n_hex", "base_sha256"]
    read = F.pandas_udf(_read(ordinary_model(pairs)), "letters array<double>, cells array<int>")
    spans_only = F.transform("found", lambda t: F.struct(t["start"], t["kind"], t["end"]))
    pieces_read = Written(rows.where(tested).withColumn("read", read(F.transform("found", lambda t: t["token"]))).select(*columns, spans_only.alias("found"), "read.letters", "read.cells"))
    stratum_at = lambda length: F.size(F.filter(strata, lambda least: least <= length)) - 1
    each = pieces_read.read().select(F.explode(F.arrays_zip("found", "cells")).alias("t")).where("t.found.kind = 3")
    in_cells = each.groupBy(stratum_at(F.col("t.found.end") - F.col("t.found.start")).alias("stratum"), F.col("t.cells").alias("cell")).agg(F.count("*").alias("n")).collect()  # strata x encodings x cells
    tests = battery_evidence({(r["stratum"], r["cell"]): r["n"] for r in in_cells})
    bins = F.pandas_udf(_binned(tests), "array<int>")("letters", "cells", F.transform("found", lambda t: t["end"] - t["start"]))
    binned = F.zip_with("found", "bins", lambda t, b: F.struct(t["start"], t["kind"], t["end"], b.alias("bin")))
    judged = Written(pieces_read.read().withColumn("bins", bins).select(*columns, binned.alias("found")))
    tokens = judged.read().select(F.explode("found").alias("t")).where("t.kind = 3")
    counts = tokens.groupBy(stratum_at(F.col("t.end") - F.col("t.start")).alias("stratum"), "t.bin").agg(F.count("*").alias("n")).collect()  # at most strata x bins rows
    cuts = rejection_bins({(r["stratum"], r["bin"]): r["n"] for r in counts}, q)
    first_rejected = F.array(*(F.lit(cuts.get(s, BINS)) for s in range(len(STRATA))))

    def kept(t):
        return (t["kind"] < 3) | (t["bin"] >= F.element_at(first_rejected, F.size(F.filter(strata, lambda least: least <= t["end"] - t["start"]))))

    names = F.array(*map(F.lit, KINDS))

    def outermost(accepted):
        """Base spans, and of the others those inside no longer one: by start, the longest first, what reaches beyond all before it."""
        held = "array<struct<start:int,kind:int,end:int,bin:int>>"
        others = F.array_sort(F.transform(F.filter(accepted, lambda t: t["kind"] == 3), lambda t: F.struct(t["start"].alias("start"), (-t["end"]).alias("back"), t.alias("span"))))

        def step(acc, t):
            beyond = t["span"]["end"] > acc["reach"]
            grown = F.struct(t["span"]["end"].alias("reach"), *Growing.plus(acc, F.array(t["span"]).cast(held)))
            return F.when(beyond, grown).otherwise(F.struct(acc["reach"].alias("reach"), *Growing.same(acc)))

        kept_ones = F.aggregate(others, F.struct(F.lit(-1).alias("reach"), *Growing.empty(held)), step, Growing.whole)
        return F.array_sort(F.concat(F.filter(accepted, lambda t: t["kind"] < 3), kept_ones))

    plain = rows.where(~tested).select(*columns, F.transform("found", lambda t: F.struct(t["start"], t["kind"], t["end"], F.lit(0).alias("bin"))).alias("found"))
    spans = F.when(F.exists("accepted", lambda t: t["kind"] == 3), outermost(F.col("accepted"))).otherwise(F.col("accepted"))
    text = F.transform(spans, lambda t: F.concat_ws(":", F.element_at(names, t["kind"] + 1), t["start"].cast("string"), t["end"].cast("string")))
    return judged.read().unionAll(plain).withColumn("accepted", F.filter("found", kept)).select(*columns, F.concat_ws(",", text).alias("spans"), F.size(F.filter(spans, lambda t: t["kind"] == 3)).cast("long").alias("n_random"))
