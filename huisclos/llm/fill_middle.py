"""Fill-in-the-middle: texts are cut at unit ends into prefix, middle and suffix, which change places.

A table-driven automaton reads the UTF-8 bytes once. Its state knows how much of a sentinel has been
seen, whether a unit begins here and how many continuation bytes are due; each transition may count a
character, a unit or a sentinel. A second pass turns counts into cuts. As a state depends on a few
bytes back only, a batch of texts is read in columns: all columns take one step at a time through the
table, each after a short run-up.

Units are lines with their newline. The form is ``plain`` (the text as it is), ``psm`` (prefix,
suffix, middle) or ``spm`` (suffix, prefix, middle), each part of the last two after its sentinel.

Edge cases: a null text is empty, an empty text or one that holds a sentinel is plain. A null id is
hashed as the text ``null``; equal ids are cut at equal draws. Texts of any length are read whole.
In bytes that are not UTF-8 every byte other than a continuation byte counts as a character. An empty
table gives no rows; other columns come back as they are, the made ones of the same name get a ``_``.
"""

from __future__ import annotations

from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from .arrowtext import text_slices

CHARACTER, UNIT, SENTINEL = 1, 2, 4
#: The symbol between two texts.
END = 256
#: Bytes read in one column.
COLUMN = 512
SENTINELS = ("<P>", "<S>", "<M>")
MADE = ("n", "form", "prefix_chars", "middle_chars", "output")


class Automaton:
    """``step``: the next state and ``counts``: what a transition counts, by state x 257 + symbol; state 0 begins a text."""

    def __init__(self, sentinels: tuple[str, ...]):
        words = [s.encode() for s in sentinels]
        heads = {w[:1] for w in words}
        if len(set(words)) < len(words) or any(not w or b"\n" in w or any(h in w[1:] for h in heads) for w in words):
            raise ValueError("sentinels differ, are not empty, and no first byte of one stands further on in another")
        self.run_up = max(map(len, words)) + 4
        states: dict[tuple[bytes, bool, int], int] = {(b"", True, 0): 0}
        step, counts = [], []
        for state in states_of(states):
            seen, begins, due = state
            row, emitted = np.zeros(END + 1, np.int32), np.zeros(END + 1, np.uint8)
            for byte in range(END):
                longer = seen + bytes([byte])
                while longer and not any(w.startswith(longer) for w in words):
                    longer = longer[1:]
                whole = longer in words
                follows = byte & 0xC0 == 0x80
                if follows:
                    after = max(0, due - 1)
                else:
                    after = 3 if byte >= 0xF0 else 2 if byte >= 0xE0 else 1 if byte >= 0xC0 else 0
                target = (b"" if whole else longer, byte == 10, after)
                row[byte] = states.setdefault(target, len(states))
                emitted[byte] = CHARACTER * (not follows) | UNIT * begins | SENTINEL * whole
            step.append(row)
            counts.append(emitted)
        self.step, self.counts = np.concatenate(step), np.concatenate(counts)

    def read(self, symbols: np.ndarray) -> np.ndarray:
        """What the transition over each symbol counts."""
        columns = max(1, -(-len(symbols) // COLUMN))
        padded = np.full(self.run_up + columns * COLUMN, END, dtype=np.int32)
        padded[self.run_up : self.run_up + len(symbols)] = symbols
        starts = np.arange(columns) * COLUMN
        state = np.zeros(columns, dtype=np.int32)
        out = np.empty((COLUMN, columns), dtype=np.uint8)
        for i in range(self.run_up + COLUMN):
            at = state * (END + 1) + padded[starts + i]
            state = self.step[at]
            if i >= self.run_up:
                out[i - self.run_up] = self.counts[at]
        return out.T.ravel()[: len(symbols)]


def states_of(states: dict) -> Iterator:
    """The states in order of their numbers, with those that are added meanwhile."""
    done = 0
    while done < len(states):
        yield list(states)[done]
        done += 1


def cut_texts(data: bytes, offsets: np.ndarray, low: np.ndarray, high: np.ndarray, machine: Automaton) -> tuple[np.ndarray, ...]:
    """Units, whether a sentinel stands in it, first and second cut (bytes in ``data``), and characters of prefix and middle, of each text.

    ``low`` and ``high`` are draws; a text of n units is cut after the smaller and the larger of their remainders by n + 1.
    """
    n_texts = len(offsets) - 1
    sizes = np.diff(offsets)
    # texts with an END symbol after each
    symbols = np.full(len(data) + n_texts, END, dtype=np.int32)
    shift = np.repeat(np.arange(n_texts), sizes)
    symbols[np.arange(len(data)) + shift] = np.frombuffer(data, dtype=np.uint8)
    begin = offsets[:-1] + np.arange(n_texts)
    end = begin + sizes
    counted = machine.read(symbols)
    units = np.flatnonzero(counted & UNIT)
    first = np.searchsorted(units, begin)
    n = np.searchsorted(units, end) - first
    held = np.flatnonzero(counted & SENTINEL)
    marked = np.searchsorted(held, end) > np.searchsorted(held, begin)
    characters = np.zeros(len(symbols) + 1, dtype=np.int64)
    np.cumsum(counted & CHARACTER, out=characters[1:])
    draws = np.sort(np.stack([low % (n + 1), high % (n + 1)]), axis=0)
    # a cut after u units is where the next unit begins, or the end
    cuts = [np.where(u < n, units[np.minimum(first + u, len(units) - 1)] if len(units) else end, end) for u in draws]
    return n, marked, cuts[0] - np.arange(n_texts), cuts[1] - np.arange(n_texts), characters[cuts[0]] - characters[begin], characters[cuts[1]] - characters[cuts[0]]


def draws_of(doc_id: Column, seed: str) -> list[Column]:
    """Four numbers from 0 to 2^32 - 1: the first groups of eight digits of the hash of seed and id."""
    hashed = F.sha2(F.concat(F.lit(f"{seed}:"), F.coalesce(doc_id.cast("string"), F.lit("null"))).cast("binary"), 256)
    return [F.conv(F.substring(hashed, 8 * i + 1, 8), 16, 10).cast("long") for i in range(4)]


def made_names(docs: DataFrame) -> dict[str, str]:
    taken, names = {c.lower() for c in docs.columns}, {}
    for name in MADE:
        names[name] = name
        while names[name].lower() in taken:
            names[name] += "_"
    return names


def fill_in_middle(docs: DataFrame, rate: int = 100, spm_rate: int = 50, seed: str = "7", sentinels: tuple[str, str, str] = SENTINELS) -> DataFrame:
    """The columns of ``docs`` plus n (units), form, prefix_chars, middle_chars (null if plain) and output.

    ``rate`` of a hundred texts are cut at all, ``spm_rate`` of a hundred of those are in the form spm.
    """
    names = made_names(docs)
    p, s, m = (x.encode() for x in sentinels)
    drawn = draws_of(F.col("doc_id"), seed)
    given = docs.select(*(F.col(f"`{c}`").alias(f"c{i}") for i, c in enumerate(docs.columns)), F.coalesce(F.col("text").cast("string"), F.lit("")).alias("text"), *(d.alias(f"h{i}") for i, d in enumerate(drawn)))
    kept = [f"c{i}" for i in range(len(docs.columns))]
    fields = [f"{c} {given.schema[c].dataType.simpleString()}" for c in kept]

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        machine = Automaton(sentinels)
        for batch, data, offsets in text_slices(batches):
            h = [batch.column(f"h{i}").to_numpy() for i in range(4)]
            n, marked, one, two, prefix, middle = cut_texts(data, offsets, h[0], h[1], machine)
            plain = (np.diff(offsets) == 0) | marked | (h[2] % 100 >= rate)
            spm = h[3] % 100 < spm_rate
            output = []
            for i in range(len(n)):
                a, b = data[offsets[i] : one[i]], data[one[i] : two[i]]
                c = data[two[i] : offsets[i + 1]]
                output.append(data[offsets[i] : offsets[i + 1]] if plain[i] else b"".join((s, c, p, a, m, b) if spm[i] else (p, a, s, c, m, b)))
            form = pa.array(np.where(plain, "plain", np.where(spm, "spm", "psm")).tolist(), pa.string())
            size = np.fromiter(map(len, output), dtype=np.int64, count=len(output))
            at = np.concatenate([[0], np.cumsum(size)])
            text = pa.LargeStringArray.from_buffers(len(output), pa.py_buffer(at.astype(np.int64)), pa.py_buffer(b"".join(output)))
            text = text.cast(pa.string()) if at[-1] < 1 << 31 else text
            yield pa.RecordBatch.from_arrays([*(batch.column(c) for c in kept), pa.array(n.astype(np.int64)), form, pa.array(prefix, mask=plain), pa.array(middle, mask=plain), text], [*kept, *MADE])

    made = given.mapInArrow(run, ", ".join([*fields, "n long", "form string", "prefix_chars long", "middle_chars long", "output string"]))
    return made.select(*(F.col(c).alias(o) for c, o in zip(kept, docs.columns)), *(F.col(c).alias(names[c]) for c in MADE))


def restored(output: Column, form: Column, sentinels: tuple[str, str, str] = SENTINELS) -> Column:
    """The text that ``output`` was made of, from output and form alone; in a form but plain each sentinel stands once."""
    p, s, m = sentinels

    def between(left: str, right: str) -> Column:
        return F.substring_index(F.substring_index(output, left, -1), right, 1)

    middle = F.substring_index(output, m, -1)
    psm = F.concat(between(p, s), middle, between(s, m))
    spm = F.concat(between(p, m), middle, between(s, p))
    return F.when(form == "psm", psm).when(form == "spm", spm).otherwise(output)
