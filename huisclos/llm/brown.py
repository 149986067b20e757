"""Language-model scores from Brown class-based n-grams.

The unigram table of all training tokens is counted by Spark. Every word seen ``least`` times or more gets
its class by exchange, on bigram counts of all training texts, in three steps. The ``core`` most frequent
words are exchanged one by one on the driver until none moves, for the highest mutual information of
adjacent classes. The other ``known`` words then join, and may change, the class that raises it most, by
their counts to and from each class, ``sweeps`` times; last come all words beyond, whose number has no bound:
their counts are grouped by word and their classes are a table that Spark joins. Words seen less often, and
words not seen at all, belong to open classes by their shape (letters beyond ASCII, closing punctuation,
symbols); the end of a text is a class of its own and also the context of the first word.

A token's probability is the smoothed transition from its context to its class times the word's
emission from the class; unseen words take the add-half share that each open class keeps free. The context is
the class of the word before, or that word's shape where it is beyond the known ones.

The ``known`` most frequent words (of 64 bytes at most, so a bounded table) are looked up where texts
are read; other words are joined by Spark, aggregated by text first.

Edge cases: null and empty texts are one end token. With no training texts every count is zero and
both scores follow from the smoothing alone. Equal rows are scored alike; null doc_ids count as
training rows. Extra columns are ignored. Texts of any length are read whole.
"""

from __future__ import annotations

from collections import Counter
from collections.abc import Iterator
from itertools import repeat

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from .arrowtext import text_slices
from .common import Written, held_out

OPEN = 8
LONGEST = 64
ADD = 0.5
END, OTHER = -2, -3


def shape(word: bytes) -> int:
    """The open class of a word."""
    symbols = len(word.translate(None, b"%&$*#@{}<>|")) < len(word)
    return (not word.isascii()) + 2 * (word[-1:] in (b".", b",", b";", b":", b"!", b"?")) + 4 * symbols


def _texts(batches: Iterator[pa.RecordBatch]) -> Iterator[tuple[pa.RecordBatch, list[list[bytes]]]]:
    for rows, data, offsets in text_slices(batches, most=1 << 20):
        folded, at = data.lower(), offsets.tolist()
        yield rows, [folded[a:b].split() for a, b in zip(at[:-1], at[1:])]


def _count_words(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    """Counts of a task's words, let out whenever many are held; an empty word counts texts."""
    held: Counter[bytes] = Counter()

    def out() -> pa.RecordBatch:
        return pa.RecordBatch.from_arrays([pa.array(list(held), pa.binary()), pa.array(list(held.values()), pa.int64())], names=["word", "n"])

    for _, texts in _texts(batches):
        for words in texts:
            held.update(words)
        held[b""] += len(texts)
        if len(held) > 200_000:
            yield out()
            held.clear()
    if held:
        yield out()


class Vocabulary:
    """The most frequent words: number, count and symbol of each. Symbols: words or classes, from ``open`` on the open classes, the end."""

    def __init__(self, words: list[bytes], counts: list[int], core: int):
        self.counts = np.array(counts, dtype=np.float64)
        self.core = min(core, len(words))
        self.shapes = np.array([shape(w) for w in words], dtype=np.int64)
        self.relabel(np.where(np.arange(len(words)) < self.core, np.arange(len(words)), self.core + self.shapes), self.core)

    def relabel(self, symbol: np.ndarray, open_from: int) -> Vocabulary:
        self.symbol, self.open, self.end = symbol, open_from, open_from + OPEN
        return self

    def symbols(self, ids: np.ndarray) -> np.ndarray:
        """The symbol of each token; see ``_number`` for the ids."""
        known = self.symbol[np.maximum(ids, 0)] if len(self.symbol) else 0
        return np.where(ids >= 0, known, np.where(ids == END, self.end, self.open + OTHER - ids))


def _number(vocabulary):
    """Texts as word numbers of four bytes, so that later passes needn't read words: ``END`` for ends, ``OTHER`` less the shape for other words, which follow as a list."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        index = vocabulary.value
        for rows, texts in _texts(batches):
            starts, others, kept = [0], [], [0]
            ids = np.empty(sum(map(len, texts)) + len(texts), dtype=np.int32)
            for words in texts:
                at, end = starts[-1], starts[-1] + len(words)
                ids[at:end] = own = np.fromiter(map(index.get, words, repeat(OTHER)), dtype=np.int32, count=len(words))
                rest = np.nonzero(own == OTHER)[0]
                if len(rest):
                    unknown = [words[i] for i in rest.tolist()]
                    others += unknown
                    ids[at + rest] = [OTHER - shape(w) for w in unknown]
                ids[end] = END
                starts.append(end + 1)
                kept.append(len(others))
            data = [None, pa.py_buffer(np.array(starts, dtype=np.int32) * 4), pa.py_buffer(ids)]
            numbers = pa.Array.from_buffers(pa.binary(), len(texts), data)
            words = pa.ListArray.from_arrays(pa.array(kept, pa.int32()), pa.array(others, pa.binary()))
            yield pa.RecordBatch.from_arrays([rows.column(0), rows.column(1), numbers, words], names=["doc_id", "held_out", "ids", "others"])

    return run


def _numbered(batches: Iterator[pa.RecordBatch], most: int = 1 << 22) -> Iterator[tuple[pa.RecordBatch, np.ndarray, np.ndarray]]:
    """(rows, their tokens' ids, the first token of each row) in runs of about ``most`` bytes."""
    for batch in batches:
        column = batch.column(batch.schema.get_field_index("ids")).cast(pa.large_binary())
        if not len(column):
            continue
        at = np.frombuffer(column.buffers()[1], dtype=np.int64)[column.offset : column.offset + len(column) + 1]
        data = column.buffers()[2]
        row = 0
        while row < len(column):
            end = min(len(column), max(row + 1, int(np.searchsorted(at, at[row] + most, side="right")) - 1))
            ids = np.frombuffer(data.slice(int(at[row]), int(at[end] - at[row])), dtype=np.int32).astype(np.int64)
            yield batch.slice(row, end - row), ids, (at[row:end] - at[row]) // 4
            row = end


def _previous(symbols: np.ndarray, end: int) -> np.ndarray:
    """Texts follow each other with an end between, so the symbol before the first word is an end too."""
    return np.concatenate(([end], symbols[:-1]))


def _count_bigrams(vocabulary):
    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        v = vocabulary.value
        size, codes, counts = v.end + 1, [], []
        held = 0

        def merged() -> tuple[np.ndarray, np.ndarray]:
            code, where = np.unique(np.concatenate(codes), return_inverse=True)
            return code, np.bincount(where, weights=np.concatenate(counts)).astype(np.int64)

        for _, ids, _ in _numbered(batches):
            symbols = v.symbols(ids)
            code, n = np.unique(_previous(symbols, v.end) * size + symbols, return_counts=True)
            codes.append(code)
            counts.append(n)
            held += len(code)
            if held > 1_500_000:
                code, n = merged()
                codes, counts, held = [code], [n], len(code)
        if codes:
            code, n = merged()
            yield pa.RecordBatch.from_arrays([pa.array(code), pa.array(n)], names=["code", "n"])

    return run


def _xlogx(x: np.ndarray) -> np.ndarray:
    return x * np.log(np.maximum(x, 1))


def exchange_classes(bigrams: np.ndarray, words: int, classes: int, sweeps: int = 12) -> np.ndarray:
    """Class of every symbol: the first ``words`` are clustered, each later symbol keeps a class of its own.

    The objective is sum n(c, d) log n(c, d) - sum n(c) log n(c) over left and right margins.
    """
    symbols = len(bigrams)
    used = min(classes, words)
    label = np.concatenate((np.arange(words) % max(1, used), used + np.arange(symbols - words)))
    k = used + symbols - words
    member = np.zeros((symbols, k))
    member[np.arange(symbols), label] = 1
    table = member.T @ bigrams @ member
    out_of, into = bigrams @ member, bigrams.T @ member  # by word: counts to and from each class
    loops = np.diag(bigrams)
    for _ in range(sweeps):
        moved = 0
        for w in range(words):
            c, r, q, s = label[w], out_of[w], into[w], loops[w]
            if not r.any() and not q.any():
                continue
            base = table.copy()  # without w
            base[c] -= r
            base[:, c] -= q
            base[c, c] += s
            left, right = table.sum(axis=1), table.sum(axis=0)
            left[c] -= r.sum()
            right[c] -= q.sum()
            targets = np.arange(used)
            own = np.diag(base)[targets]
            r_rest, q_rest = np.broadcast_to(r, (used, k)).copy(), np.broadcast_to(q, (used, k)).copy()
            r_self, q_self = r_rest[targets, targets].copy(), q_rest[targets, targets].copy()
            # w's bigrams with itself were counted in r[c] and q[c]; they follow it to the target
            r_c, q_c = r[c] - s, q[c] - s
            r_rest[:, c], q_rest[:, c] = r_c, q_c
            r_self = np.where(targets == c, r_c, r_self)
            q_self = np.where(targets == c, q_c, q_self)
            rows, cols = base[targets], base[:, targets].T
            gain = (_xlogx(rows + r_rest) - _xlogx(rows)).sum(axis=1) + (_xlogx(cols + q_rest) - _xlogx(cols)).sum(axis=1)
            gain -= _xlogx(own + r_self) - _xlogx(own) + _xlogx(own + q_self) - _xlogx(own)
            gain += _xlogx(own + r_self + q_self + s) - _xlogx(own)
            gain -= _xlogx(left[targets] + r.sum()) - _xlogx(left[targets]) + _xlogx(right[targets] + q.sum()) - _xlogx(right[targets])
            best = int(np.argmax(gain))
            if best != c and gain[best] > gain[c] + 1e-6:
                moved += 1
                label[w] = best
                member[w, c], member[w, best] = 0, 1
                out_of[:, c] -= bigrams[:, w]
                out_of[:, best] += bigrams[:, w]
                into[:, c] -= bigrams[w]
                into[:, best] += bigrams[w]
                table = base
                row, col = out_of[w].copy(), into[w].copy()
                table[best] += row
                table[:, best] += col
                table[best, best] -= s
        if not moved:
            break
    return label


def _following(symbols: np.ndarray, end: int) -> np.ndarray:
    """The symbol after each one; after the last one none is counted."""
    return np.concatenate((symbols[1:], [end]))


def _known_contexts(vocabulary):
    """For known words beyond the core: id and count by code, the class before it or, from the number of classes on, the class after it. Id -1: class pairs."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        v = vocabulary.value
        size = v.end + 1
        pairs = np.zeros(size * size, dtype=np.int64)
        codes, counts, held = [], [], 0

        def merged() -> tuple[np.ndarray, np.ndarray]:
            code, where = np.unique(np.concatenate(codes), return_inverse=True)
            return code, np.bincount(where, weights=np.concatenate(counts)).astype(np.int64)

        for _, ids, _ in _numbered(batches):
            symbols = v.symbols(ids)
            before, after = _previous(symbols, v.end), _following(symbols, v.end)
            pairs += np.bincount(before * size + symbols, minlength=size * size)
            at = np.nonzero(ids >= v.core)[0]
            first = ids[at] * 2 * size
            code, n = np.unique(np.concatenate((first + before[at], first + size + after[at])), return_counts=True)
            codes.append(code)
            counts.append(n)
            held += len(code)
            if held > 1_500_000:
                code, n = merged()
                codes, counts, held = [code], [n], len(code)
        if codes:
            code, n = merged()
            yield pa.RecordBatch.from_arrays([pa.array(code // (2 * size)), pa.array(code % (2 * size)), pa.array(n)], names=["word", "code", "n"])
            used = np.nonzero(pairs)[0]
            yield pa.RecordBatch.from_arrays([pa.array(np.full(len(used), -1)), pa.array(used), pa.array(pairs[used])], names=["word", "code", "n"])

    return run


def _other_contexts(vocabulary):
    """The same for words beyond the known ones; a null word: pairs of a class and a known word's class."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        v = vocabulary.value
        size = v.end + 1
        pairs = np.zeros(size * size, dtype=np.int64)
        held: Counter[tuple[bytes, int]] = Counter()

        def out() -> pa.RecordBatch:
            words, codes = zip(*held) if held else ((), ())
            return pa.RecordBatch.from_arrays([pa.array(words, pa.binary()), pa.array(codes, pa.int64()), pa.array(list(held.values()), pa.int64())], names=["word", "code", "n"])

        for rows, ids, _ in _numbered(batches):
            symbols = v.symbols(ids)
            before, after = _previous(symbols, v.end), _following(symbols, v.end)
            mine = ids > OTHER
            pairs += np.bincount(before[mine] * size + symbols[mine], minlength=size * size)
            words = rows.column(rows.schema.get_field_index("others")).flatten().to_pylist()
            held.update(zip(words, before[~mine].tolist()))
            held.update(zip(words, (after[~mine] + size).tolist()))
            if len(held) > 200_000:
                yield out()
                held.clear()
        yield out()
        used = np.nonzero(pairs)[0]
        yield pa.RecordBatch.from_arrays([pa.nulls(len(used), pa.binary()), pa.array(used), pa.array(pairs[used])], names=["word", "code", "n"])

    return run


def join_classes(word: np.ndarray, code: np.ndarray, n: np.ndarray, now: np.ndarray, table: np.ndarray, used: int) -> np.ndarray:
    """The class, of the first ``used``, that each word raises the mutual information most by joining.

    ``word``, ascending, numbers the words of ``now``: their present classes, whose counts in ``table``
    don't hold against them. Bigrams of a word with itself count as bigrams with its present class.
    Ties go to the present class, else to the first.
    """
    size = len(table)
    gains = np.zeros((len(now), used))
    totals = np.zeros((2, len(now)))
    moving = now < used
    for at in range(0, len(word), 1 << 15):
        w, c, x = word[at : at + (1 << 15)], code[at : at + (1 << 15)], n[at : at + (1 << 15)].astype(np.float64)
        after = (c >= size)[:, None]
        cells = np.where(after, table[:used, c % size].T, table[c % size, :used])
        own = np.nonzero(moving[w])[0]
        cells[own, now[w[own]]] -= x[own]
        cells = np.maximum(cells, 0)
        gain = _xlogx(cells + x[:, None]) - _xlogx(cells)
        first = np.nonzero(np.diff(w, prepend=-1))[0]
        gains[w[first]] += np.add.reduceat(gain, first, axis=0)
        np.add.at(totals, ((c >= size).astype(int), w), x)
    for margin, total in ((table[:, :used].sum(axis=0), totals[0]), (table[:used].sum(axis=1), totals[1])):
        rest = np.repeat(margin[None, :], len(now), axis=0)
        rest[moving, now[moving]] -= total[moving]
        rest = np.maximum(rest, 0)
        gains -= _xlogx(rest + total[:, None]) - _xlogx(rest)
    gains[moving, now[moving]] += 1e-6
    return np.round(gains, 9).argmax(axis=1)


def _grouped(contexts: DataFrame) -> DataFrame:
    """One row for each word with its contexts, at most twice the number of classes."""
    summed = contexts.groupBy("word", "code").agg(F.sum("n").alias("n"))
    return summed.groupBy("word").agg(F.array_sort(F.collect_list(F.struct("code", "n"))).alias("contexts"))


def _assign(table: np.ndarray, used: int, least: int, present: np.ndarray | None):
    """Classes of rows of words with their contexts; ``present`` classes of known words by id, else all are new."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            lists = batch.column(1)
            flat, lengths = lists.flatten(), np.diff(np.asarray(lists.offsets))
            code, n = flat.field("code").to_numpy(zero_copy_only=False), flat.field("n").to_numpy(zero_copy_only=False)
            word = np.repeat(np.arange(len(lengths)), lengths)
            keys = batch.column(0)
            if present is None:
                now = used + np.array([shape(w) for w in keys.to_pylist()], dtype=np.int64)
            else:
                now = present[keys.to_numpy(zero_copy_only=False)]
            seen = np.bincount(word, weights=np.where(code < len(table), n, 0), minlength=len(lengths)).astype(np.int64)
            label = np.where(seen >= least, join_classes(word, code, n, now, table, used), now) if used and len(now) else now
            yield pa.RecordBatch.from_arrays([keys, pa.array(seen), pa.array(label, pa.int64()), lists], names=["word", "c", "class", "contexts"])

    return run


ASSIGNED = "c long, class long, contexts array<struct<code: long, n: long>>"


def _class_pairs(found, size: int) -> np.ndarray:
    pairs = np.zeros(size * size)
    np.add.at(pairs, found["code"].to_numpy(dtype=np.int64), found["n"].to_numpy(dtype=np.float64))
    return pairs.reshape(size, size)


def _score(vocabulary, model):
    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        v, m = vocabulary.value, model.value
        for rows, ids, starts in _numbered(batches):
            symbols = v.symbols(ids)
            before = _previous(symbols, v.end)
            logs = np.where(ids >= 0, m["log_count"][np.maximum(ids, 0)], np.where(ids == END, m["log_end"], 0.0))
            known = (ids >= 0) | ((ids == END) & m["end_known"])
            class_logs = np.where(ids <= OTHER, 0.0, m["chance"][before, symbols] + np.where(ids >= 0, m["emission"][np.maximum(ids, 0)], 0.0))
            sums = [np.add.reduceat(x, starts) for x in (np.ones(len(ids), np.int64), known.astype(np.int64), logs, class_logs)]
            at, contexts, counted = 0, before[ids <= OTHER].tolist(), []
            for rest in rows.column(rows.schema.get_field_index("others")).to_pylist():
                counted.append(Counter(zip(rest, contexts[at : at + len(rest)])))
                at += len(rest)
            ends = np.concatenate(([0], np.cumsum([len(c) for c in counted]))).astype(np.int32)
            keys = [k for c in counted for k in c]
            fields = [pa.array([w for w, _ in keys], pa.binary()), pa.array([c for _, c in keys], pa.int64()), pa.array([v.open + shape(w) for w, _ in keys], pa.int64()), pa.array([n for c in counted for n in c.values()], pa.int64())]
            tail = pa.ListArray.from_arrays(pa.array(ends, pa.int32()), pa.StructArray.from_arrays(fields, names=["word", "before", "open", "n"]))
            yield pa.RecordBatch.from_arrays([rows.column(0), rows.column(1), *map(pa.array, sums), tail], names=["doc_id", "held_out", "n_tokens", "n_known", "logs", "class_logs", "tail"])

    return run


SCORED = "doc_id long, held_out boolean, n_tokens long, n_known long, logs double, class_logs double, tail array<struct<word: binary, before: long, open: long, n: long>>"


def brown_scores(
    docs: DataFrame, left_out: int = 1, known: int = 1 << 17, core: int = 1024, classes: int = 48, prior: float = 8.0, least: int = 2, sweeps: int = 2
) -> DataFrame:
    """Returns doc_id, held_out, n_tokens, n_known, train_tokens, base_score, score for every document.

    Training rows are those whose crc32(doc_id as text) mod 5 is not ``left_out``. ``known`` and
    ``core`` bound what the driver and the executors hold, not which words get a class; ``prior`` weighs the
    class unigram against transitions.
    """
    spark = docs.sparkSession
    docs = docs.select("doc_id", held_out(left_out).alias("held_out"), "text")
    counts = Written(docs.where(~F.col("held_out")).select("text").mapInArrow(_count_words, "word binary, n long").groupBy("word").agg(F.sum("n").alias("c")))
    words = counts.read().where(F.octet_length("word") > 0)
    ends = counts.read().where(F.octet_length("word") == 0).agg(F.sum("c")).first()[0] or 0
    total, distinct = words.agg(F.coalesce(F.sum("c"), F.lit(0)), F.count("*")).first()
    total, distinct = total + ends, distinct + (ends > 0)
    top = sorted(_most_frequent(words.where(F.octet_length("word") <= LONGEST), known), key=lambda r: (-r["c"], bytes(r["word"])))
    counts.drop()
    v = Vocabulary([bytes(r["word"]) for r in top], [r["c"] for r in top], core)
    index = spark.sparkContext.broadcast({bytes(r["word"]): i for i, r in enumerate(top)})
    numbered = Written(docs.mapInArrow(_number(index), "doc_id long, held_out boolean, ids binary, others array<binary>"))
    training = numbered.read().where(~F.col("held_out"))
    size = v.end + 1
    found = training.select("ids").mapInArrow(_count_bigrams(spark.sparkContext.broadcast(v)), "code long, n long").groupBy("code").agg(F.sum("n").alias("n")).toPandas()  # at most size^2 rows
    label = exchange_classes(_class_pairs(found, size), v.core, classes)
    used = min(classes, v.core)
    size = used + OPEN + 1
    # the core keeps its classes, the other known words join by counts
    symbol = np.concatenate((label[: v.core], used + v.shapes[v.core :])).astype(np.int64)
    for _ in range(sweeps if len(symbol) > v.core else 0):
        v = v.relabel(symbol, used)
        contexts = Written(training.select("ids").mapInArrow(_known_contexts(spark.sparkContext.broadcast(v)), "word long, code long, n long"))
        pairs = _class_pairs(contexts.read().where("word < 0").groupBy("code").agg(F.sum("n").alias("n")).toPandas(), size)
        chosen = _grouped(contexts.read().where("word >= 0")).mapInArrow(_assign(pairs, used, least, symbol), f"word long, {ASSIGNED}").select("word", "class").toPandas()  # at most ``known`` rows
        symbol = symbol.copy()
        symbol[chosen["word"].to_numpy(dtype=np.int64)] = chosen["class"].to_numpy(dtype=np.int64)
        contexts.drop()
    vocabulary = spark.sparkContext.broadcast(v.relabel(symbol, used))
    contexts = Written(training.select("ids", "others").mapInArrow(_other_contexts(vocabulary), "word binary, code long, n long"))
    pairs = _class_pairs(contexts.read().where("word IS NULL").groupBy("code").agg(F.sum("n").alias("n")).toPandas(), size)
    others = Written(_grouped(contexts.read().where("word IS NOT NULL")).mapInArrow(_assign(pairs, used, least, None), f"word binary, {ASSIGNED}"))
    contexts.drop()
    entering = others.read().select("class", F.explode("contexts").alias("x")).where(F.col("x.code") < size)
    pairs += _class_pairs(entering.groupBy((F.col("x.code") * size + F.col("class")).alias("code")).agg(F.sum("x.n").alias("n")).toPandas(), size)
    types = np.bincount(symbol, minlength=size)
    for r in others.read().groupBy("class").agg(F.count("*").alias("n")).collect():
        types[r["class"]] += r["n"]
    unigram = (pairs.sum(axis=0) + ADD) / (pairs.sum() + ADD * size)
    transition = np.log10((pairs + prior * unigram) / (pairs.sum(axis=1, keepdims=True) + prior))
    is_open = (np.arange(size) >= used) & (np.arange(size) < used + OPEN)
    mass = np.where(is_open, pairs.sum(axis=0) + ADD * (types + 1), np.maximum(pairs.sum(axis=0), 1))
    mass[-1] = 1  # the end is one word
    chance = transition - np.log10(mass)
    emission = np.log10(v.counts + ADD * is_open[symbol]) if len(v.counts) else np.zeros(1)
    model = spark.sparkContext.broadcast(
        {
            "log_count": np.log10(v.counts + ADD) if len(v.counts) else np.zeros(1),
            "log_end": float(np.log10(ends + ADD)),
            "end_known": bool(ends),
            "chance": chance,
            "emission": emission,
        }
    )
    scored = Written(numbered.read().mapInArrow(_score(vocabulary, model), SCORED).withColumn("row", F.monotonically_increasing_id()))
    numbered.drop()
    rare = scored.read().select("row", F.explode("tail").alias("t")).select("row", "t.*")
    joined = rare.join(others.read().select("word", "c", "class"), "word", "left").select("row", "n", F.coalesce("c", F.lit(0)).alias("c"), (F.col("before") * size + F.coalesce("class", "open")).alias("cell"))
    cells = spark.createDataFrame([(i, float(x), bool(is_open[i % size])) for i, x in enumerate(chance.ravel())], "cell long, chance double, is_open boolean")
    class_log = F.col("chance") + F.log10(F.col("c") + F.when(F.col("is_open"), ADD).otherwise(0.0))
    sums = joined.join(F.broadcast(cells), "cell").groupBy("row").agg(
        F.sum(F.col("n") * F.log10(F.col("c") + F.lit(ADD))).alias("rare_logs"),
        F.sum(F.col("n") * class_log).alias("rare_class_logs"),
        F.sum(F.when(F.col("c") > 0, F.col("n")).otherwise(0)).alias("rare_known"),
    )
    whole = scored.read().drop("tail").join(sums, "row", "left")
    rare_logs, rare_class_logs, rare_known = F.coalesce("rare_logs", F.lit(0.0)), F.coalesce("rare_class_logs", F.lit(0.0)), F.coalesce("rare_known", F.lit(0))
    return whole.select(
        "doc_id",
        "held_out",
        "n_tokens",
        (F.col("n_known") + rare_known).alias("n_known"),
        F.lit(int(total)).cast("long").alias("train_tokens"),
        (F.col("logs") + rare_logs - F.col("n_tokens") * F.lit(float(np.log10(total + ADD * (distinct + 1))))).alias("base_score"),
        (F.col("class_logs") + rare_class_logs).alias("score"),
    )


def _most_frequent(words: DataFrame, known: int) -> list:
    """Rows of the ``known`` most frequent words at most: all words from some count on, found by counting words in fixed bands of log count.

    A sorted limit would send that many words of every partition to the driver.
    """
    banded = words.withColumn("band", F.floor(F.log2("c") * 32).cast("int"))
    sizes = {r["band"]: r["n"] for r in banded.groupBy("band").agg(F.count("*").alias("n")).collect()}  # at most 32 x 64 rows
    lowest, held = 0, 0
    for band in sorted(sizes, reverse=True):
        held += sizes[band]
        if held > known:
            lowest = band + 1
            break
    return banded.where(F.col("band") >= lowest).select("word", "c").collect()
