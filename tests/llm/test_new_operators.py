"""Clustering, embedding near copies and fill-in-the-middle, against plain versions, with odd rows."""

import hashlib
import random
import re

import numpy as np
import pytest
from pyspark.sql import functions as F

from huisclos.llm.ann import top_neighbours, unit
from huisclos.llm.binary_codes import encode, error_bound, estimates, near_vectors, rotation
from huisclos.llm.fill_middle import Automaton, cut_texts, fill_in_middle, restored
from huisclos.llm.yinyang import digits, whole_number, yinyang_clusters

WORDS = ["".join(p) for p in zip(*([iter("maisonjardinvoiturelumierepassagecheminmontagnefenetrehistoirecouleurriviere")] * 5))]
VECTORS = "vec_id long, embedding array<double>, label int, cluster string, v string"


def plain_clusters(rows, k=40, rounds=5, dims=64):
    kept = [(i, [int(np.floor(np.float64(x) * 256)) if abs(x) < 1e9 else whole_number(x, 256) for x in v]) for i, v in rows if v is not None and len(v) == dims and all(x is not None and np.isfinite(x) for x in v)]
    order = sorted(kept, key=lambda r: (r[0] is None, hashlib.sha256(f"2:{r[0]}".encode()).hexdigest(), r[1]))
    centres = [v for _, v in order[:k]]

    def assign():
        return [min((sum((a - b) ** 2 for a, b in zip(v, c)), j) for j, c in enumerate(centres)) for _, v in kept]

    for _ in range(rounds):
        got = assign()
        for j in range(len(centres)):
            own = [v for (_, v), (_, c) in zip(kept, got) if c == j]
            if own:
                centres[j] = [sum(x) // len(own) for x in zip(*own)]
    got = assign()
    fit = lambda s: s if s is not None and s < 1 << 63 else None
    sums = {}
    for d, j in got:
        sums[j] = None if fit(d) is None or sums.get(j, 0) is None else sums.get(j, 0) + d
    every = None if None in sums.values() else sum(sums.values())
    return [(i, j, fit(d), fit(sums[j]), fit(every), hashlib.sha256(",".join(map(str, centres[j])).encode()).hexdigest()) for (i, _), (d, j) in zip(kept, got)]


def same(got, want):
    assert sorted(map(str, map(tuple, got))) == sorted(map(str, want))


def test_digits_and_floors():
    for x in (0, 1, -1, (1 << 22) - 1, 1 << 22, -(1 << 70) - 5, 10**300):
        assert sum(d << 22 * i for i, d in enumerate(digits(x))) == x
    assert whole_number(-0.001, 256) == -1 and whole_number(1e308, 256) == int(1e308) * 256


@pytest.mark.parametrize("far", [False, True])
def test_clusters_by_plain_means(spark, far):
    rng = np.random.default_rng(4)
    heads = rng.normal(size=(12, 64))
    rows = [(i, (heads[i % 12] + rng.normal(size=64) * 0.3).tolist()) for i in range(400)]
    rows += [(i, [float(i % 3)] * 64) for i in range(400, 450)]  # ties
    rows += [(7, rows[7][1]), (7, rows[8][1]), (None, rows[9][1]), (451, None), (452, [1.0] * 63), (453, [None] + [1.0] * 63), (454, [float("nan")] * 64), (455, [float("inf")] * 64), (456, [])]
    if far:
        rows += [(500, [1e30] * 64), (501, [-1e30] * 64), (502, [1e308] * 64), (503, [2.0**20] * 64)]
    df = spark.createDataFrame([(i, v, 1, "x", "y") for i, v in rows], VECTORS)
    same(yinyang_clusters(df.repartition(5)).collect(), plain_clusters(rows))
    few = [r for r in rows if r[0] is not None and r[0] < 6]
    same(yinyang_clusters(spark.createDataFrame([(i, v, 1, "x", "y") for i, v in few], VECTORS)).collect(), plain_clusters(few))
    assert yinyang_clusters(df.limit(0)).count() == 0


def test_clusters_of_other_sizes(spark):
    rng = np.random.default_rng(5)
    rows = [(i, rng.normal(size=70).tolist()) for i in range(120)]
    got = yinyang_clusters(spark.createDataFrame([(i, v, 1, "x", "y") for i, v in rows], VECTORS), k=7, rounds=3, dims=70).collect()
    same(got, plain_clusters(rows, 7, 3, 70))


TEXTS = [
    None, "", "\n", "\n\n", "a", "a\nb", "é😀\nœ\n\nfin", "un <P> deux\n", "<S", "x<\n", "<<M>", "<P", "a<M>", "\n<", "P>\nS>\n", "ligne\r\nautre ici\x0bla\n", "<\nP>", "a" * 511 + "<P>", "b" * 510 + "<M", "c" * 1023 + "\n" + "d" * 3,
    "é" * 3000 + "\n" + "😀" * 700 + "\nfin", *["\n".join("mot " * (i % 7) + "é😀<"[: i % 4] for i in range(j)) for j in range(2, 60)], "long\n" * 200_000,
]


def plain_fim(doc_id, text, rate=100, spm_rate=50, seed="7"):
    text = text or ""
    units = re.findall(r"[^\n]*\n|[^\n]+", text)
    h = hashlib.sha256(f"{seed}:{'null' if doc_id is None else doc_id}".encode()).hexdigest()
    h = [int(h[8 * i : 8 * i + 8], 16) for i in range(4)]
    n = len(units)
    a, b = sorted((h[0] % (n + 1), h[1] % (n + 1)))
    p, m, s = "".join(units[:a]), "".join(units[a:b]), "".join(units[b:])
    if not text or any(x in text for x in ("<P>", "<S>", "<M>")) or h[2] % 100 >= rate:
        return n, "plain", None, None, text
    return (n, "spm", len(p), len(m), f"<S>{s}<P>{p}<M>{m}") if h[3] % 100 < spm_rate else (n, "psm", len(p), len(m), f"<P>{p}<S>{s}<M>{m}")


def test_middles_by_plain_cuts(spark):
    rows = [(i, t, "f", None) for i, t in enumerate(TEXTS)] + [(None, "a\nb\nc", "g", 1), (3, "a\nb\nc", "g", 1), (3, "a\nb\nc", "g", 1)]
    df = spark.createDataFrame(rows, "doc_id long, text string, form string, N int").repartition(3)
    out = fill_in_middle(df)
    assert out.columns == ["doc_id", "text", "form", "N", "n_", "form_", "prefix_chars", "middle_chars", "output"]
    got = out.withColumn("back", restored(F.col("output"), F.col("form_"))).collect()
    assert len(got) == len(rows)
    for r in got:
        assert (r["n_"], r["form_"], r["prefix_chars"], r["middle_chars"], r["output"]) == plain_fim(r["doc_id"], r["text"]), r["text"]
        assert r["back"] == (r["text"] or "") and r["form"] in "fg"
    assert {r["form_"] for r in got} == {"plain", "psm", "spm"}
    some = fill_in_middle(df, rate=30, spm_rate=100, seed="x").collect()
    assert all((r["n_"], r["form_"], r["prefix_chars"], r["middle_chars"], r["output"]) == plain_fim(r["doc_id"], r["text"], 30, 100, "x") for r in some)
    assert fill_in_middle(df.limit(0)).count() == 0


def test_automaton_on_random_bytes():
    rng = random.Random(8)
    machine = Automaton(("<P>", "<S>", "<M>"))
    texts = ["".join(rng.choice("<PSM>\né😀a") for _ in range(rng.choice((0, 1, 5, 40, 2000)))) for _ in range(300)]
    data = [t.encode() for t in texts]
    offsets = np.cumsum([0, *map(len, data)])
    n, marked, *_ = cut_texts(b"".join(data), offsets, np.zeros(300, np.int64), np.zeros(300, np.int64), machine)
    assert n.tolist() == [len(re.findall(r"[^\n]*\n|[^\n]+", t)) for t in texts]
    assert marked.tolist() == [any(s in t for s in ("<P>", "<S>", "<M>")) for t in texts]
    with pytest.raises(ValueError):
        Automaton(("<P>", "P>"))
    other = Automaton(("<fim-prefix>", "<fim-suffix>", "<fim-middle>"))
    assert cut_texts(b"x<fim-suffix>y<fim-suffi>", np.array([0, 13, 25]), np.zeros(2, np.int64), np.zeros(2, np.int64), other)[1].tolist() == [True, False]


def plain_links(rows, threshold=0.93):
    unit_of = {}
    for n, (_, v, label) in enumerate(rows):
        if label is not None and v is not None and all(x is not None and np.isfinite(x) for x in v) and any(v):
            x = np.array(v, dtype=float)
            x = np.ldexp(x, -int(np.frexp(np.abs(x).max())[1]))
            unit_of[n] = x / np.sqrt(x @ x)
    near = {n: [m for m in unit_of if n != m and rows[n][2] == rows[m][2] and len(unit_of[n]) == len(unit_of[m]) and unit_of[n] @ unit_of[m] >= threshold] for n in unit_of}
    out = []
    for n in range(len(rows)):
        seen, todo = {n}, [n]
        while todo:
            for m in near.get(todo.pop(), []):
                if m not in seen:
                    seen.add(m)
                    todo.append(m)
        ids = [rows[m][0] for m in seen if rows[m][0] is not None]
        least = min(ids) if ids else None
        out.append((rows[n][0], len(near.get(n, [])), least, least is not None and rows[n][0] == least))
    return out


@pytest.fixture(scope="module")
def vectors():
    rng = np.random.default_rng(9)
    rows = []
    for c in range(40):  # groups around the threshold
        centre = rng.normal(size=64)
        rows += [(len(rows) + i, (centre + rng.normal(size=64) * s).tolist(), c % 3) for i, s in enumerate((0.0, 0.05, 0.1, 0.2, 0.25, 0.27, 0.3))]
    crowd = rng.normal(size=64)
    rows += [(1000 + i, (crowd + rng.normal(size=64) * 0.2).tolist(), 1) for i in range(150)]
    rows += [(2000 + i, crowd.tolist(), 1) for i in range(30)]  # equal ones
    rows += [(2100, crowd.tolist(), 2), (2101, crowd.tolist(), None), (2102, None, 1), (2103, [0.0] * 64, 1), (2104, [None] + [1.0] * 63, 1), (2105, [float("nan")] * 64, 1), (2106, [], 1), (None, crowd.tolist(), 1), (None, None, None), (5, crowd.tolist(), 0), (5, (-crowd).tolist(), 0)]
    rows += [(2200, [1e-200, 0.0], 1), (2201, [1e-200, 1e-201], 1), (2202, [1e200, 1e199], 1), (2203, [0.0, 1.0], 1), (2204, [-0.0, 1e-300], 1), (2205, [3.0], 1), (2206, [-4.0], 1), (2207, [5.0], 1)]
    return rows


@pytest.mark.parametrize("block, whole", [(4096, 65536), (32, 65536), (64, 100)])
def test_near_vectors_by_all_pairs(spark, vectors, block, whole):
    df = spark.createDataFrame([(i, v, label, "x", "y") for i, v, label in vectors], "vec_id long, embedding array<double>, label int, entry string, n_links string").repartition(3)
    got = near_vectors(df, block=block, whole=whole)
    same([(r["vec_id"], r["n_links"], r["component_id"], r["kept"]) for r in got.collect()], plain_links(vectors))
    assert near_vectors(df.limit(0)).count() == 0


def test_estimates_are_unbiased_and_bounded():
    rng = np.random.default_rng(3)
    x = unit(rng.normal(size=(800, 64)))
    y = unit(x + rng.normal(size=(800, 64)) * rng.uniform(0.02, 0.3, size=(800, 1)))
    codes, factor = encode(x)
    error = estimates(codes, factor, y @ rotation(64, 0)).astype(float) - x @ y.T
    assert abs(error.mean()) < 1e-3
    bound = error_bound(factor, 64, 1.0)[:, None]
    assert (np.abs(error) < 4.5 * bound).all() and 0.8 < np.sqrt(np.mean((error / bound) ** 2)) < 1.1


def test_neighbours_of_tiny_and_huge_vectors(spark):
    rows = [(0, [1e-200, 0.0]), (1, [1e-200, 1e-200]), (2, [1e200, 0.0]), (3, [-1e300, 1e300]), (4, [5e-324, 5e-324])]
    df = spark.createDataFrame(rows, "vec_id long, embedding array<double>")
    got = {(r["query_id"], r["vec_id"]): round(r["score"], 6) for r in top_neighbours(df, "true").collect()}
    half = 0.707107
    assert len(got) == 20 and got[0, 2] == 1.0 and got[0, 1] == half and got[4, 1] == 1.0 and got[3, 0] == -half and got[3, 1] == 0.0


def test_a_long_text_of_tokens_is_scanned_once(spark):
    """Some megabytes of hashes and of random tokens in one text each."""
    import time

    from huisclos.llm.secrets import free_parts, merged, scan_batch, scan_secrets

    rng = random.Random(3)
    hashes = " ".join("%032x" % rng.getrandbits(128) for _ in range(100_000)).encode()
    start = time.time()
    spans = scan_batch(hashes, np.array([0, len(hashes)]))
    assert len(spans[0]) == 100_000 and time.time() - start < 20
    for _ in range(300):
        taken = [(a, a + rng.randint(1, 40)) for a in (rng.randrange(400) for _ in range(rng.randint(0, 12)))]
        a = rng.randrange(300)
        b = a + rng.randint(20, 200)
        free = [all(not s <= i < e for s, e in taken) for i in range(500)]
        want, at = [], a
        while at < b:
            end = at
            while end < b and free[end]:
                end += 1
            if end - at >= 20:
                want.append((at, end))
            at = max(end, at + 1)
        assert free_parts(a, b, merged(taken)) == want
    letters = "ABCDEFGHIJKLMNOPQRSTUVWXYZabcdefghijklmnopqrstuvwxyz0123456789"
    tokens = " ".join("".join(rng.choice(letters) for _ in range(40)) for _ in range(2000))
    words = " ".join("_".join(rng.choice(WORDS) for _ in range(5)) for _ in range(20_000))
    prose = " ".join(rng.choice(WORDS) for _ in range(40_000))
    got = scan_secrets(spark.createDataFrame([(1, tokens), (2, words), (3, prose)], "doc_id long, text string")).collect()
    found = {r["doc_id"]: r["n_random"] for r in got}
    assert found[1] > 1900 and found[2] < 0.05 * found[1] and all(len(r["spans"].split(",")) == r["n_random"] for r in got if r["n_random"])


def test_contamination_by_all_pairs(spark):
    """Every document against every item by plain tiling of whole texts: passages whole, cut short, in another order, and mixed."""
    from huisclos.llm.decontaminate import contaminated_pairs, greedy_tiles

    rng = random.Random(31)
    words = [f"mot{i}" for i in range(120)]
    items = [[rng.choice(words) for _ in range(rng.randint(5, 50))] for _ in range(14)] + [["seul"] * 12]
    docs = []
    for _ in range(90):
        text = [rng.choice(words) for _ in range(rng.randint(0, 30))]
        for _ in range(rng.randint(0, 3)):
            item = rng.choice(items)
            cuts = sorted({0, len(item), *(rng.randrange(len(item)) for _ in range(rng.randint(0, 3)))})
            parts = [item[a:b] for a, b in zip(cuts, cuts[1:])]
            rng.shuffle(parts)
            text += [w for p in parts[: rng.randint(1, len(parts))] for w in p + [rng.choice(words)] * rng.randint(0, 2)]
        docs.append(text)
    number = {w: n + 1 for n, w in enumerate([*words, "seul"])}
    want = {}
    for d, text in enumerate(docs):
        for i, item in enumerate(items):
            covered = sum(t[2] for t in greedy_tiles([number[w] for w in item], [number[w] for w in text], 5))
            if covered >= 0.8 * len(item):
                want[d, i] = covered
    left = spark.createDataFrame([(d, " ".join(t)) for d, t in enumerate(docs)], "doc_id long, text string")
    right = spark.createDataFrame([(i, " ".join(t)) for i, t in enumerate(items)], "item_id long, text string")
    got = {(r["doc_id"], r["item_id"]): r["n_covered"] for r in contaminated_pairs(left, right).collect()}
    assert set(got) == set(want) and 30 < len(want) < 400 and sum(got[k] == want[k] for k in want) >= 0.95 * len(want)
