"""Toxicity scores from a bidirectional gated recurrent network with attention pooling, trained in numpy.

Each word enters as a word embedding (hashed word) beside a character embedding (the mean over its
hashed character 4-grams, with word borders). Capitals of ASCII and Latin-1 count as small letters.
Two gated recurrent layers read a window of words in both directions; attention weighs the positions,
and a logistic unit scores the pooled state. All windows of ``WINDOW`` words at a stride of half a window are scored, to the last word of every text;
a document's score is that of its worst window. In training a document's windows are joined by
noisy-or, so that only document labels are needed.

The network is fitted in one task on a sample of labelled rows that is bounded by
``max_toxic``, ``max_clean`` and ``max_chars`` characters a text (whole texts, shorter ones only; if
fewer than ``few`` toxic ones are that short, the limit is ten times as high). Weights (about 3 MB, whatever
the input) go to the executors, where texts are scored in blocks of a few MB.

Edge cases: null and empty texts, and texts without a word, get ``EMPTY_SCORE``. Without a toxic and a
clean label to learn from, every score is ``EMPTY_SCORE``. Repeated labels of a document count as
toxic if one is; null labels are ignored. Equal rows get equal scores. Null doc_ids aren't held out.
Extra columns are kept by ``score_texts``, but for one named like its result.
"""

from __future__ import annotations

import pickle
from collections.abc import Iterator

import numpy as np
import pandas as pd
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F
from pyspark.sql import types as T

from .arrowtext import FOLD, WORD_BYTE, runs, text_slices, word_hashes
from .common import held_out

WINDOW, STRIDE = 32, 16
WORD_BITS, CHAR_BITS = 15, 15
WIDTH, HIDDEN, ATTENTION = 6, 8, 8
EMPTY_SCORE = 0.05
#: Share of words whose embedding is left out in a training step, so that characters must serve too.
WORD_DROPOUT = 0.25


def lower_latin(raw: np.ndarray) -> np.ndarray:
    """UTF-8 bytes with capitals from U+00C0 to U+00DE in lower case; lengths stay."""
    capital = (raw >= 0x80) & (raw <= 0x9E) & (raw != 0x97)
    capital[:1] = False
    capital[1:] &= raw[:-1] == 0xC3
    return raw + (capital.view(np.uint8) << 5)


def features(data: bytes, offsets: np.ndarray) -> tuple[np.ndarray, np.ndarray, np.ndarray, np.ndarray]:
    """(word bucket of each word, 4-gram bucket of each word byte, first byte of each word among them, rows' offsets among words)."""
    raw = lower_latin(np.frombuffer(data, dtype=np.uint8))
    hashes, rows = word_hashes(raw, offsets)
    inside = WORD_BYTE[raw]
    starts, ends = runs(inside, offsets, 1)
    folded = np.where(inside, FOLD[raw], 0).astype(np.uint32)
    first, last = np.zeros(len(raw) + 1, dtype=bool), np.zeros(len(raw) + 1, dtype=bool)
    first[starts], last[ends - 1] = True, True
    before = np.concatenate(([0], folded[:-1])).astype(np.uint32)
    before[first[:-1]] = 0
    after = np.concatenate((folded[1:], [0])).astype(np.uint32)
    after[last[:-1]] = 0
    after2 = np.concatenate((after[1:], [0])).astype(np.uint32)
    after2[last[:-1]] = 0
    grams = (before | (folded << np.uint32(8)) | (after << np.uint32(16)) | (after2 << np.uint32(24))) * np.uint32(0x9E3779B1)
    grams = (grams >> np.uint32(32 - CHAR_BITS))[inside]
    lengths = ends - starts
    return (hashes & np.uint64((1 << WORD_BITS) - 1)).astype(np.int64), grams.astype(np.int64), np.cumsum(lengths) - lengths, rows


def windows(rows: np.ndarray) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
    """Every window: (document, first word, words in it)."""
    n = np.diff(rows)
    count = np.where(n == 0, 0, 1 + np.maximum(0, -(-(n - WINDOW) // STRIDE)))
    doc = np.repeat(np.arange(len(n)), count)
    k = np.arange(len(doc)) - np.repeat(np.cumsum(count) - count, count)
    start = k * STRIDE
    return doc, rows[:-1][doc] + start, np.minimum(WINDOW, n[doc] - start)


def _sigmoid(x: np.ndarray) -> np.ndarray:
    np.negative(x, out=x)
    np.exp(np.minimum(x, 60, out=x), out=x)
    x += 1
    return np.reciprocal(x, out=x)


class Network:
    """Weights by name, all float32. Each direction has W (2 x WIDTH by 3 x HIDDEN), b and U (HIDDEN by 3 x HIDDEN)."""

    def __init__(self, seed: int = 7):
        rng = np.random.default_rng(seed)
        normal = lambda scale, *shape: (rng.standard_normal(shape) * scale).astype(np.float32)
        self.w = {"word": normal(0.1, 1 << WORD_BITS, WIDTH), "char": normal(0.1, 1 << CHAR_BITS, WIDTH)}
        for d in "fb":
            self.w |= {f"W{d}": normal(0.4, 2 * WIDTH, 3 * HIDDEN), f"b{d}": np.zeros(3 * HIDDEN, np.float32), f"U{d}": normal(0.3, HIDDEN, 3 * HIDDEN)}
            self.w[f"b{d}"][:HIDDEN] = -1.0
        self.w |= {"A": normal(0.4, 2 * HIDDEN, ATTENTION), "v": normal(0.4, ATTENTION), "o": normal(0.4, 2 * HIDDEN), "c": np.full(1, -2.0, np.float32)}

    def words(self, ids: np.ndarray, grams: np.ndarray, firsts: np.ndarray) -> np.ndarray:
        """Input vectors of words."""
        if not len(ids):
            return np.zeros((0, 2 * WIDTH), np.float32)
        lengths = np.diff(np.concatenate((firsts, [len(grams)])))
        chars = np.add.reduceat(self.w["char"][grams], firsts, axis=0) / lengths[:, None].astype(np.float32)
        return np.concatenate((self.w["word"][ids], chars), axis=1)

    def forward(self, gates: dict[str, np.ndarray], at: np.ndarray, mask: np.ndarray, keep: bool = False) -> tuple[np.ndarray, dict]:
        """Logits of windows. ``gates``: input gates of all words by direction; ``at``, ``mask``: (WINDOW, n)."""
        w, n, memory = self.w, at.shape[1], {}
        states = np.empty((WINDOW, n, 2 * HIDDEN), np.float32)
        full = bool(mask.all())
        for k, d in enumerate("fb"):
            h, U = np.zeros((n, HIDDEN), np.float32), w[f"U{d}"]
            steps = []
            for t in range(WINDOW) if d == "f" else range(WINDOW - 1, -1, -1):
                x = gates[d][at[t]]
                hu = h @ U
                zr = _sigmoid(x[:, : 2 * HIDDEN] + hu[:, : 2 * HIDDEN])
                z, r = zr[:, :HIDDEN], zr[:, HIDDEN:]
                new = np.tanh(x[:, 2 * HIDDEN :] + r * hu[:, 2 * HIDDEN :])
                after = new + z * (h - new)
                if not full:
                    after *= mask[t][:, None]
                if keep:
                    steps.append((t, h, z, r, new, hu[:, 2 * HIDDEN :]))
                h = after
                states[t, :, k * HIDDEN : (k + 1) * HIDDEN] = h
            memory[d] = steps
        inner = np.tanh(states.reshape(-1, 2 * HIDDEN) @ w["A"])
        weight = (inner @ w["v"]).reshape(WINDOW, n)
        weight = np.exp(weight - weight.max(axis=0)) * mask
        weight /= weight.sum(axis=0)
        pooled = np.einsum("tn,tnh->nh", weight, states)
        logits = pooled @ w["o"] + w["c"][0]
        if keep:
            memory |= {"states": states, "inner": inner, "weight": weight, "pooled": pooled}
        return logits, memory

    def backward(self, memory: dict, mask: np.ndarray, dlogit: np.ndarray) -> tuple[dict, dict[str, np.ndarray]]:
        """Gradients of weights after the input gates, and of each window position's input gates by direction."""
        w, states, inner, weight, pooled = self.w, *(memory[k] for k in ("states", "inner", "weight", "pooled"))
        n = len(dlogit)
        grad = {"o": pooled.T @ dlogit, "c": np.array([dlogit.sum()], np.float32)}
        dpooled = dlogit[:, None] * w["o"]
        dweight = np.einsum("nh,tnh->tn", dpooled, states)
        dscore = (weight * (dweight - (weight * dweight).sum(axis=0))).reshape(-1)
        grad["v"] = inner.T @ dscore
        dinner = dscore[:, None] * w["v"] * (1 - inner * inner)
        grad["A"] = states.reshape(-1, 2 * HIDDEN).T @ dinner
        dstates = weight[:, :, None] * dpooled[None] + (dinner @ w["A"].T).reshape(WINDOW, n, 2 * HIDDEN)
        dgates = {}
        for k, d in enumerate("fb"):
            U, dU = w[f"U{d}"], np.zeros_like(w[f"U{d}"])
            dx = np.empty((WINDOW, n, 3 * HIDDEN), np.float32)
            dh = np.zeros((n, HIDDEN), np.float32)
            for t, h, z, r, new, hun in reversed(memory[d]):
                dh = (dh + dstates[t, :, k * HIDDEN : (k + 1) * HIDDEN]) * mask[t][:, None]
                dn = dh * (1 - z) * (1 - new * new)
                dz = dh * (h - new) * z * (1 - z)
                dr = dn * hun * r * (1 - r)
                dx[t] = np.concatenate((dz, dr, dn), axis=1)
                dhu = np.concatenate((dz, dr, dn * r), axis=1)
                dU += h.T @ dhu
                dh = dh * z + dhu @ U.T
            grad[f"U{d}"], dgates[d] = dU, dx
        return grad, dgates

    def gates(self, vectors: np.ndarray) -> dict[str, np.ndarray]:
        return {d: vectors @ self.w[f"W{d}"] + self.w[f"b{d}"] for d in "fb"}

    def score_block(self, data: bytes, offsets: np.ndarray, block: int = 4096) -> np.ndarray:
        """The worst window's probability for each text."""
        ids, grams, firsts, rows = features(data, offsets)
        worst = np.full(len(offsets) - 1, -np.inf, dtype=np.float32)
        doc, start, size = windows(rows)
        for i in range(0, len(doc), block):
            d, s, m = doc[i : i + block], start[i : i + block], size[i : i + block]
            low, high = int(s[0]), int((s + m).max())
            a, b = int(firsts[low]), int(firsts[high]) if high < len(firsts) else len(grams)
            gates = self.gates(self.words(ids[low:high], grams[a:b], firsts[low:high] - a))
            step = np.arange(WINDOW)[:, None]
            mask = (step < m).astype(np.float32)
            logits, _ = self.forward(gates, np.minimum(s - low + step, high - low - 1), mask)
            np.maximum.at(worst, d, logits)
        return np.where(np.isfinite(worst), 1 / (1 + np.exp(-worst.astype(float))), EMPTY_SCORE)


def _warm_start(net: Network, ids, grams, firsts, rows, toxic: np.ndarray) -> None:
    """The first coordinate of each embedding starts as the smoothed log-odds of its bucket among toxic texts."""
    doc_of_word = np.repeat(np.arange(len(toxic)), np.diff(rows))
    doc_of_gram = np.repeat(doc_of_word, np.diff(np.concatenate((firsts, [len(grams)]))))
    for name, bucket, doc in (("word", ids, doc_of_word), ("char", grams, doc_of_gram)):
        size = len(net.w[name])
        pairs = np.unique(doc.astype(np.int64) * size + bucket)
        t = np.bincount(pairs % size, weights=toxic[pairs // size], minlength=size)
        n = np.bincount(pairs % size, minlength=size)
        odds = np.log((t + 0.5) / (toxic.sum() + 1)) - np.log((n - t + 0.5) / (len(toxic) - toxic.sum() + 1))
        net.w[name][:, 0] = np.where(n > 0, odds / 2, 0).astype(np.float32)
        net.w[name][n == 0] = 0  # unseen words are read by their characters


def train(texts: list[str], labels: list[int], steps: int = 260, docs_a_step: int = 48, rate: float = 0.01, seed: int = 7) -> Network:
    """Fit by Adam; documents' windows are joined by noisy-or."""
    net, rng = Network(seed), np.random.default_rng(seed)
    encoded = [t.encode("utf-8", "surrogatepass") for t in texts]
    offsets = np.concatenate(([0], np.cumsum([len(b) for b in encoded]))).astype(np.int64)
    ids, grams, firsts, rows = features(b"".join(encoded), offsets)
    toxic = np.array(labels, dtype=np.float64)
    _warm_start(net, ids, grams, firsts, rows, toxic)
    ends = np.concatenate((firsts, [len(grams)]))
    doc, start, size = windows(rows)
    of_doc = np.searchsorted(doc, np.arange(len(texts) + 1))
    usable = np.nonzero(np.diff(rows) > 0)[0]
    epochs = max(3, round(steps * docs_a_step / max(1, len(usable))))
    first, second, step = {k: np.zeros_like(v) for k, v in net.w.items()}, {k: np.zeros_like(v) for k, v in net.w.items()}, 0
    for epoch in range(epochs):
        order = rng.permutation(usable)
        for i in range(0, len(order), docs_a_step):
            batch = np.sort(order[i : i + docs_a_step])
            picked = np.concatenate([np.arange(of_doc[j], of_doc[j + 1]) for j in batch])
            own = np.searchsorted(batch, doc[picked])
            words = np.concatenate([np.arange(rows[j], rows[j + 1]) for j in batch])
            local = np.concatenate(([0], np.cumsum(rows[batch + 1] - rows[batch])))
            lengths = ends[words + 1] - ends[words]
            bytes_at = np.repeat(ends[words] - (np.cumsum(lengths) - lengths), lengths) + np.arange(lengths.sum())
            own_grams, own_firsts = grams[bytes_at], np.cumsum(lengths) - lengths
            vectors = net.words(ids[words], own_grams, own_firsts)
            hidden = rng.random(len(words)) < WORD_DROPOUT
            vectors[hidden, :WIDTH] = 0
            gates = net.gates(vectors)
            t = np.arange(WINDOW)[:, None]
            mask = (t < size[picked]).astype(np.float32)
            at = np.minimum(start[picked] - rows[batch][own] + local[own] + t, len(words) - 1)
            logits, memory = net.forward(gates, at, mask, keep=True)
            p = 1 / (1 + np.exp(-np.clip(logits.astype(float), -30, 30)))
            clean = np.exp(np.bincount(own, weights=np.log1p(-np.minimum(p, 1 - 1e-9)), minlength=len(batch)))
            y = toxic[batch]
            # d loss / d logit: p for a clean document's window; -(1 - P) p / P for a toxic one's, P by noisy-or
            slope = np.where(y[own] > 0, -p * (clean / np.maximum(1 - clean, 1e-9))[own], p)
            grad, dgates = net.backward(memory, mask, (slope / len(batch)).astype(np.float32))
            dvec = np.zeros_like(vectors)
            for d in "fb":
                flat, g = at.reshape(-1), (dgates[d] * mask[:, :, None]).reshape(-1, 3 * HIDDEN)
                summed = np.stack([np.bincount(flat, weights=g[:, c], minlength=len(words)) for c in range(3 * HIDDEN)], axis=1).astype(np.float32)
                grad[f"W{d}"], grad[f"b{d}"] = vectors.T @ summed, summed.sum(axis=0)
                dvec += summed @ net.w[f"W{d}"].T
            scatter = lambda bucket, g, n: np.stack([np.bincount(bucket, weights=g[:, c], minlength=n) for c in range(WIDTH)], axis=1).astype(np.float32)
            dvec[hidden, :WIDTH] = 0
            grad["word"] = scatter(ids[words], dvec[:, :WIDTH], 1 << WORD_BITS)
            grad["char"] = scatter(own_grams, np.repeat(dvec[:, WIDTH:] / lengths[:, None], lengths, axis=0), 1 << CHAR_BITS)
            step += 1
            lr = rate * (1 - 0.8 * epoch / max(1, epochs - 1))
            for k, g in grad.items():
                first[k] += 0.1 * (g - first[k])
                second[k] += 0.01 * (g * g - second[k])
                net.w[k] -= (lr * (first[k] / (1 - 0.9**step)) / (np.sqrt(second[k] / (1 - 0.99**step)) + 1e-6)).astype(np.float32)
    return net


def labelled_sample(docs: DataFrame, labels: DataFrame, max_toxic: int, max_clean: int, max_chars: int, few: int) -> list[tuple[str, int]]:
    """Whole texts of a bounded sample of labelled training rows, in a fixed order."""
    one = labels.where("toxic IS NOT NULL AND doc_id IS NOT NULL").groupBy("doc_id").agg(F.max("toxic").alias("toxic"))
    one = one.where(~held_out(0)).withColumn("order", F.xxhash64("doc_id"))
    pick = lambda value, n: one.where(F.col("toxic") == value).orderBy("order", "doc_id").limit(n)
    ids = pick(1, max_toxic).unionAll(pick(0, max_clean))  # at most max_toxic + max_clean rows
    found = docs.select("doc_id", "text").join(F.broadcast(ids), "doc_id").where("text IS NOT NULL AND text <> ''")
    limit = max_chars if found.where((F.col("toxic") == 1) & (F.length("text") <= max_chars)).limit(few).count() >= few else 10 * max_chars
    # a doc_id that many rows share gives its smallest text, so no more rows than ids are collected
    one_text = found.where(F.length("text") <= limit).groupBy("order", "doc_id", "toxic").agg(F.min("text").alias("text"))
    rows = sorted(one_text.collect(), key=lambda r: (-r["toxic"], r["order"], r["doc_id"]))
    return [(r["text"], int(r["toxic"])) for r in rows]


def fit_toxicity(docs: DataFrame, labels: DataFrame, max_toxic: int = 1200, max_clean: int = 1800, max_chars: int = 4000, few: int = 200) -> Network | None:
    """Training runs in one task over the bounded sample, with one thread; lost executors only repeat it."""
    sample = labelled_sample(docs, labels, max_toxic, max_clean, max_chars, few)
    if {y for _, y in sample} != {0, 1}:
        return None

    def fit(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        rows = pd.concat(list(batches)).sort_values("n")
        yield pd.DataFrame({"network": [pickle.dumps(train(list(rows["text"]), [int(y) for y in rows["toxic"]]).w)]})

    rows = docs.sparkSession.createDataFrame([(n, t, y) for n, (t, y) in enumerate(sample)], "n int, text string, toxic int")
    net = Network()
    net.w = pickle.loads(rows.coalesce(1).mapInPandas(fit, "network binary").first()["network"])
    return net


def score_texts(docs: DataFrame, net: Network | None, column: str = "toxicity") -> DataFrame:
    """``docs`` plus ``column``, the score of each whole text."""
    docs = docs.drop(column)

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for rows, data, offsets in text_slices(batches, most=1 << 20):
            scores = np.full(rows.num_rows, EMPTY_SCORE) if net is None else net.score_block(data, offsets)
            yield pa.RecordBatch.from_arrays([*rows.columns, pa.array(scores, pa.float64())], names=[*rows.schema.names, column])

    return docs.mapInArrow(run, T.StructType([*docs.schema.fields, T.StructField(column, T.DoubleType())]))


def toxicity_scores(docs: DataFrame, labels: DataFrame) -> DataFrame:
    """Returns doc_id, held_out, score, predicted for every document."""
    net = fit_toxicity(docs, labels)
    scored = score_texts(docs.select("doc_id", "text"), net, "score")
    return scored.select("doc_id", held_out(0).alias("held_out"), "score", F.when(F.col("score") >= 0.5, 1).otherwise(0).alias("predicted"))
