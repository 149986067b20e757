"""Numpy parts against plain versions of themselves."""

import math
import random
import tracemalloc
import zlib

import numpy as np
import pyarrow as pa
import pytest

from huisclos.llm import arrowtext, decontaminate, near_copies
from huisclos.llm.arrowtext import gram_hashes, runs, word_hashes
from huisclos.llm.brown import _xlogx, exchange_classes
from huisclos.llm.decontaminate import greedy_tiles
from huisclos.llm.mixing import inclusion, rake, tempered
from huisclos.llm.secrets import SYMBOLS, evidence, infer_alphabet, ordinary_model, pair_counts, randomness, rejection_bins, scan_batch
from huisclos.llm.sharding import schedule
from huisclos.llm.simhash import decode, error_patterns, fingerprint, golay_keys, links_within, remainders
from huisclos.llm.suffix_dedup import common_prefixes, merge_shards, repeats_in_shard, suffix_array
from huisclos.llm.toxicity import EMPTY_SCORE, WINDOW, Network, features, lower_latin, train, windows


def test_golay_corrects_three_errors():
    rem, table = remainders(), error_patterns()
    assert len(set(table.tolist())) == 2048 and max(bin(t).count("1") for t in table.tolist()) == 3
    rng = random.Random(1)
    for _ in range(200):
        word = rng.getrandbits(23)
        near = word ^ sum(1 << b for b in rng.sample(range(23), 0))
        code = word ^ int(table[_syndrome(word, rem)])
        flipped = code ^ sum(1 << b for b in rng.sample(range(23), 3))
        got = decode(np.array([near, flipped]), rem, table)
        assert got[1] == code >> 11


def _syndrome(word, rem):
    s = 0
    for i in range(23):
        if word >> i & 1:
            s ^= int(rem[i])
    return s


def test_keys_meet_within_two_bits_and_forests_agree():
    rng = np.random.default_rng(2)
    base = rng.integers(0, 2**64, 200, dtype=np.uint64)
    one = np.left_shift(np.uint64(1), rng.integers(0, 64, (2, 200)).astype(np.uint64))
    fps = np.unique(np.concatenate((base, base ^ one[0], base ^ one[0] ^ one[1])))
    rows, keys = golay_keys(fps, remainders(), error_patterns())
    sets = [set() for _ in fps]
    for r, k in zip(rows, keys):
        sets[r].add(int(k))
    linked = [(i, j) for i in range(len(fps)) for j in range(i) if np.bitwise_count(fps[i] ^ fps[j]) <= 2]
    assert linked and all(sets[i] & sets[j] for i, j in linked)

    def parts(edges):
        root = {int(f): int(f) for f in fps.view(np.int64)}
        for a, b in edges:
            root[a] = b
        groups = {}
        for f in root:
            groups.setdefault(root[f], set()).add(f)
        return {frozenset(g) for g in groups.values()}

    assert parts(links_within(fps)) == parts(links_within(fps, direct=0))


def test_fingerprint_edges():
    assert fingerprint(None) == fingerprint(" \t\n") == 0
    assert fingerprint("Un") == fingerprint("un ") != 0
    assert fingerprint("a b c d " * 30000) == fingerprint("A B C D " * 30000)


def test_suffix_array_and_kasai():
    rng = np.random.default_rng(3)
    for alphabet in (1, 2, 30):
        x = rng.integers(60, 60 + alphabet, 400).astype(np.uint8)
        b = x.tobytes()
        sa, rank = suffix_array(x)
        assert sa.tolist() == sorted(range(len(b)), key=lambda i: b[i:]) and (rank[sa] == np.arange(len(b))).all()
        lcp = common_prefixes(x, sa, rank, np.array([0, 150]), np.array([150, 250]), 40)
        for r in range(1, len(b)):
            i, j, n = sa[r - 1], sa[r], 0
            while n < 40 and i + n < len(b) and j + n < len(b) and b[i + n] == b[j + n]:
                n += 1
            assert lcp[r] == n


def test_shards_find_and_merge_repeats():
    rng = random.Random(4)
    common = bytes(rng.randrange(97, 123) for _ in range(160))
    texts = [bytes(rng.randrange(97, 123) for _ in range(8)) + common[i : i + 110] for i in (0, 20, 40)]
    own, keys, los = np.array([19, 19, 19]), np.array([5, 3, 9]), np.array([0, 7, 0])
    at, later = repeats_in_shard(texts, own, keys, los)
    for n, (lane, inner) in enumerate(at):
        s = texts[lane][inner : inner + 100]
        earlier = [(keys[k], los[k] + i) for k in range(3) for i in range(own[k]) if texts[k][i : i + 100] == s]
        assert later[n] == (min(earlier) != (keys[lane], los[lane] + inner))
    shard = lambda rows: tuple(np.array(c) for c in zip(*sorted(rows)))
    a, b = [(b"a", 4, 0), (b"c", 1, 5)], [(b"a", 2, 9), (b"b", 7, 7), (b"c", 1, 6)]
    assert sorted(merge_shards([shard(a), shard(b), shard([(b"b", 8, 0)])])) == [(1, 6), (4, 0), (8, 0)]


def test_greedy_tiles_reordered_and_repeated():
    assert sorted(greedy_tiles(list(range(1, 11)), [6, 7, 8, 9, 10, 0, 99, 1, 2, 3, 4, 5], 5)) == [(0, 7, 5), (5, 0, 5)]
    assert greedy_tiles([1, 2, 3, 4], [1, 2, 3, 4], 5) == [] and greedy_tiles([], [1], 5) == []
    rng = random.Random(6)
    for _ in range(100):
        item, doc = [rng.randint(1, 3) for _ in range(20)], [rng.randint(1, 3) for _ in range(30)]
        tiles = greedy_tiles(item, doc, 3)
        assert all(item[i : i + n] == doc[d : d + n] and n >= 3 for i, d, n in tiles)
        used = [p for i, _, n in tiles for p in range(i, i + n)]
        assert len(used) == len(set(used))
        longest = max((n for i in range(20) for d in range(30) for n in range(1, 21) if i + n <= 20 and d + n <= 30 and item[i : i + n] == doc[d : d + n]), default=0)
        assert not tiles or max(n for *_, n in tiles) <= longest
        free_i, free_d = set(range(20)) - set(used), set(range(30)) - {p for _, d, n in tiles for p in range(d, d + n)}
        assert not any({i, i + 1, i + 2} <= free_i and {d, d + 1, d + 2} <= free_d and item[i : i + 3] == doc[d : d + 3] for i in range(18) for d in range(28))


def test_exchange_reaches_a_local_optimum():
    rng = np.random.default_rng(0)
    b = rng.integers(0, 30, (24, 24)).astype(float)
    b[:8, 8:16] += 80

    def value(label):
        m = np.zeros((24, label.max() + 1))
        m[np.arange(24), label] = 1
        t = m.T @ b @ m
        return _xlogx(t).sum() - _xlogx(t.sum(0)).sum() - _xlogx(t.sum(1)).sum()

    got = exchange_classes(b, 20, 4)
    assert value(got) >= value(np.concatenate((np.arange(20) % 4, 4 + np.arange(4))))
    for w in range(20):
        for c in range(4):
            moved = got.copy()
            moved[w] = c
            if set(moved[:20]) == {0, 1, 2, 3}:
                assert value(moved) <= value(got) + 1e-5
    assert exchange_classes(np.zeros((9, 9)), 0, 4).tolist() == list(range(9))


def test_raking_meets_margins_and_budget():
    rng = np.random.default_rng(1)
    codes = np.array([(a, b, c) for a in range(3) for b in range(2) for c in range(2)])
    cells = rng.integers(1, 100, len(codes)).astype(float)
    targets = [np.array([0.2, 0.3, 0.5]), np.array([0.4, 0.6]), np.array([0.9, 0.1])]
    x = rake(cells, codes, targets)
    for m, t in enumerate(targets):
        assert np.allclose(np.bincount(codes[:, m], weights=x), t, atol=1e-6)
    p = inclusion(cells, x, 0.5 * cells.sum())
    assert math.isclose((p * cells).sum(), 0.5 * cells.sum(), rel_tol=1e-9) and (p <= 1).all() and (p >= 0).all()
    assert np.allclose(inclusion(cells, x, 9 * cells.sum()), 1)
    assert math.isclose(sum(tempered({1: 5, 2: 9}, 0.5).values()), 1)


def test_schedule_is_longest_first():
    placed = schedule([(i, s) for i, s in enumerate([9, 8, 7, 6, 5, 4, 3, 2, 1])], 3)
    loads = [sum(9 - i for i in placed if placed[i] == s) for s in range(3)]
    assert max(loads) - min(loads) <= 2 and schedule([], 3) == {}


def test_randomness_battery():
    rng = random.Random(8)
    letters = "ABCDEFGHIJKLMNOPQRSTUVWXYZabcdefghijklmnopqrstuvwxyz0123456789+/"
    p = [randomness("".join(rng.choice(letters) for _ in range(60))) for _ in range(300)]
    assert sum(x < 0.05 for x in p) < 45
    for plain in ("aaaaaaaaaaaaaaaaaaaaaaaa1", "abababababababababab1212", "version2version2version2version2", "0123456789abcdef0123456789abcdef"):
        assert randomness(plain) < 0.05, plain
    assert infer_alphabet("a-b_c+").endswith("+/-_") and infer_alphabet("abc!") is None and randomness("abc!") == 0.0
    # ten pieces with e = 10^20 of a hundred: a secret needs 100 / (0.05 x 10) = 200; five without evidence are none
    cuts = rejection_bins({(0, 0): 90, (0, 200): 10, (1, 0): 5, (2, 10): 1, (2, 0): 9}, 0.05)
    assert 0 < cuts[0] <= 200 and cuts[1] == cuts[2] == 400


def test_scan_adds_random_spans():
    token = "x9Qf3LmZ7pR2tV8wK1sB6nY4cD0hJ5gA"
    texts = [f"cle {token} fin", "password: abc", 'API_KEY="abcdefghijkl"', "AKIA" + "B" * 14, "0123456789abcdef", "x" * 40]
    data, at = "".join(texts).encode(), np.cumsum([0, *map(len, texts)])
    found = scan_batch(data, at)
    assert found[0] == [(4, 3, 36)] and 1 not in found and found[2] == [(0, 0, 21)]
    assert found[3] == [(0, 1, 18)] and found[4] == [(0, 2, 16)] and found[5] == [(0, 3, 40)]


def test_evidence_is_a_fair_bet_against_ordinary_text():
    """The null model is a distribution at each step, so an e-value's mean under it is 1 at most."""
    model = ordinary_model(pair_counts(np.frombuffer(b"Some ordinary words, and getUserFile37 of /usr/lib-2" * 20, dtype=np.uint8)))
    assert np.allclose((10.0**model).sum(axis=1), 1, atol=1e-9) or ((10.0**model).sum(axis=1) <= 1 + 1e-9).all()
    rng = np.random.default_rng(3)
    letters = "abcdefghijklmnopqrstuvwxyzABCDEFGHIJKLMNOPQRSTUVWXYZ0123456789+/-_"
    es = []
    for _ in range(400):
        at, token = SYMBOLS - 1, ""
        for _ in range(24):
            p = 10.0 ** model[at]
            at = int(rng.choice(SYMBOLS - 1, p=p / p.sum()))
            token += letters[at]
        es.append(10.0 ** evidence(token, model))
    assert np.mean(es) < 3


def test_words_and_grams_do_not_depend_on_neighbours():
    a, b = "Un deux, TROIS quatre".encode(), "été".encode()
    data, at = a + b, np.array([0, len(a), len(a) + len(b)])
    words, rows = word_hashes(data, at)
    alone, _ = word_hashes(b"un deux trois quatre", np.array([0, 20]))
    assert rows.tolist() == [0, 4, 5] and words[:4].tolist() == alone.tolist()
    assert gram_hashes(words[:4], 3)[0] == gram_hashes(alone, 3)[0] and len(gram_hashes(words, 9)) == 0
    assert runs(np.array([True, True, True, True]), np.array([0, 2, 4]), 1)[0].tolist() == [0, 2]


@pytest.mark.parametrize("block", [1, 7, 64])
def test_word_hashes_do_not_depend_on_blocks(monkeypatch, block):
    data = b"un  deux " + b"x" * 100 + b" TROIS\nquatre" + b"y" * 7 + b" cinq"
    at = np.array([0, 3, 3, 60, len(data)])
    whole, rows = word_hashes(data, at)
    monkeypatch.setattr(arrowtext, "BLOCK", block)
    words, same = word_hashes(data, at)
    assert words.tolist() == whole.tolist() and same.tolist() == rows.tolist() and len(words) == 7
    long, _ = word_hashes(b"x" * 51, np.array([0, 51]))
    assert long[0] == words[2]  # the part of the long word before the cut between rows
    assert [len(x) for x in word_hashes(b"", np.array([0, 0]))] == [0, 2]


def peak_of(run) -> int:
    tracemalloc.start()
    run()
    peak = tracemalloc.get_traced_memory()[1]
    tracemalloc.stop()
    return peak


def test_words_are_hashed_in_bounded_memory():
    """A task's memory doesn't follow the hashes of all its bytes: of one long text, or of a batch of texts."""
    text = b"some words of ordinary lengths, one after the other " * 80_000
    assert peak_of(lambda: word_hashes(text, np.array([0, len(text)]))) < 20 * len(text)
    texts = [text[i : i + 4000].decode() for i in range(0, 8_000_000, 4000)]
    batch = pa.RecordBatch.from_arrays([pa.array(range(len(texts))), pa.array(texts)], names=["key", "text"])
    for step in (near_copies._sketches(5, ("key",)), near_copies._sets(5)):
        assert peak_of(lambda: sum(x.num_rows for x in step(iter([batch])))) < 40_000_000  # noqa: B023
    own = pa.RecordBatch.from_arrays([batch.column(0), batch.column(0), batch.column(1)], names=["doc_id", "text_key", "text"])
    seeds = decontaminate._seeds_in_documents(np.zeros(1 << (decontaminate.TABLE_BITS - 6), np.uint64), 5)
    assert peak_of(lambda: list(seeds(iter([own])))) < 40_000_000


def test_network_gradients():
    net = Network(3)
    for k in net.w:
        net.w[k] = net.w[k].astype(np.float64)
    text = b"one two three four five six seven eight nine ten"
    ids, grams, firsts, rows = features(text, np.array([0, len(text)]))
    _, start, size = windows(rows)
    at = np.minimum(start + np.arange(WINDOW)[:, None], len(ids) - 1)
    mask = (np.arange(WINDOW)[:, None] < size).astype(np.float64)
    vectors = net.words(ids, grams, firsts)

    def logit():
        return float(net.forward(net.gates(vectors), at, mask)[0][0])

    _, memory = net.forward(net.gates(vectors), at, mask, keep=True)
    grad, _ = net.backward(memory, mask, np.ones(1))
    for name in ("Uf", "Ub", "A", "v", "o"):
        w = net.w[name].reshape(-1)
        held, eps = w[1], 1e-2
        w[1] = held + eps
        up = logit()
        w[1] = held - eps
        down = logit()
        w[1] = held
        assert math.isclose((up - down) / (2 * eps), grad[name].reshape(-1)[1], rel_tol=0.05, abs_tol=2e-4), name


def test_training_learns_words_and_parts_of_words():
    rng = random.Random(9)
    plain = ["maison", "jardin", "soleil", "porte", "table", "livre", "route", "fleur"]
    clean = [" ".join(rng.choice(plain) for _ in range(60)) for _ in range(120)]
    bad = [" ".join([*(rng.choice(plain) for _ in range(40)), "grrzut" + rng.choice("aeiou") + rng.choice("lmn"), *(rng.choice(plain) for _ in range(20))]) for _ in range(60)]
    net = train(clean + bad, [0] * 120 + [1] * 60, steps=200)
    texts = ["maison jardin " * 50, "maison " * 300 + "grrzutyk " + "table " * 200, "", "..."]
    data = "".join(texts).encode()
    scores = net.score_block(data, np.cumsum([0, *map(len, texts)]))
    assert scores[0] < 0.5 < scores[1] and scores[2] == scores[3] == EMPTY_SCORE


def test_capitals_give_the_same_features():
    text = "ÀÉÈÊ ÎÏ×÷ ÑÓÞ ß abcÇ Āé ÿ日本😀"
    small = "".join(c.lower() if "A" <= c <= "Z" or "À" <= c <= "Þ" and c != "×" else c for c in text)
    assert lower_latin(np.frombuffer(text.encode(), np.uint8)).tobytes() == small.encode()
    assert len(lower_latin(np.zeros(0, np.uint8))) == 0
    a, b = (features(t.encode(), np.array([0, len(t.encode())])) for t in ("RÉEUXON ÑAN", "réeuxon ñan"))
    assert all((x == y).all() for x, y in zip(a, b))


def test_windows_cover_every_word():
    rows = np.array([0, 0, 1, 33, 65, 200])
    doc, start, size = windows(rows)
    for d in range(len(rows) - 1):
        covered = {w for k in np.nonzero(doc == d)[0] for w in range(start[k], start[k] + size[k])}
        assert covered == set(range(rows[d], rows[d + 1]))


def test_fold_rule_matches_crc32(spark):
    from huisclos.llm.common import held_out

    rows = spark.range(50).withColumnRenamed("id", "doc_id").select("doc_id", held_out(1).alias("held_out")).collect()
    assert all(r["held_out"] == (zlib.crc32(str(r["doc_id"]).encode()) % 5 == 1) for r in rows)


@pytest.mark.parametrize("bad", [[("net", "block")], [("net/", "maybe")]])
def test_rules_are_checked(spark, bad):
    from huisclos.llm.url_filters import judge_urls

    with pytest.raises(ValueError):
        judge_urls(spark.createDataFrame([(1, "http://a.net/")], "page_id long, url string"), bad)
