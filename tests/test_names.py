"""The trained name engine: its sums against all paths, its held-out quality, and its place in a job."""

import itertools

import numpy as np
import pytest

from huisclos.operators.detect import detect
from huisclos.operators.names import FIRST_NAMES, FORBIDDEN, FORBIDDEN_FIRST, HEADS, KINDS, LABELS, OTHER_TEMPLATES, TAILS, Chain, chain_engine, made_sentences, measured, tokens_of, train, trained
from huisclos.plans.pseudonymize import pseudonymize


def test_sums_and_best_path_by_all_paths():
    rng = np.random.default_rng(1)
    k = len(LABELS)
    chain = Chain(np.zeros((2, k)), rng.normal(size=(k, k)), rng.normal(size=k))
    scores = rng.normal(size=(2, 4, k))
    lengths = np.array([4, 3])
    marginals, best = chain.marginals(scores, lengths), chain.best(scores, lengths)
    for i, n in enumerate(lengths):
        total, by_label, top = 0.0, np.zeros((n, k)), (-np.inf, None)
        for path in itertools.product(range(k), repeat=int(n)):
            value = chain.begin[path[0]] + sum(scores[i, t, y] for t, y in enumerate(path)) + sum(chain.move[a, b] for a, b in zip(path, path[1:]))
            total += np.exp(value)
            for t, y in enumerate(path):
                by_label[t, y] += np.exp(value)
            ruled = value + FORBIDDEN_FIRST[path[0]] + sum(FORBIDDEN[a, b] for a, b in zip(path, path[1:]))
            top = max(top, (ruled, path))
        assert np.allclose(marginals[i, :n], by_label / total) and tuple(best[i, :n]) == top[1]


@pytest.fixture(scope="module")
def chain():
    return trained()


def test_held_out_names(chain):
    """Other templates, other syllables and other first names than in training."""
    others = made_sentences(1500, 77, OTHER_TEMPLATES, HEADS[20:], TAILS[18:], FIRST_NAMES[20:])
    got = measured(chain, others)
    print({k: (round(r / t, 3), round(r / f, 3)) for k, (t, f, r) in got.items()})
    for kind in KINDS:
        true, found, right = got[kind]
        assert true > 200 and right / true > 0.85 and right / found > 0.85, (kind, got[kind])


def test_gradient_climbs():
    few = made_sentences(200, 3)
    one, more = train(few, rounds=1, hide=0), train(few, rounds=4, hide=0)
    right = lambda c: sum(r for _, _, r in measured(c, few).values())
    assert right(more) >= right(one) > 0


def test_engine_in_a_job(spark, chain):
    docs = spark.createDataFrame([("A", 1, "😀 Entretien avec Luc Gaudin à Châteaubertin.\nVu par Mme Gaudin, a@b.fr"), ("A", 2, None), ("A", 3, ""), ("A", 4, "rien ici")], "dossier_id string, seq long, text string")
    spans = {r["seq"]: [(s["type"], s["start"], s["end"], s["value"]) for s in r["spans"]] for r in detect(docs, engines=[chain_engine(chain)], engine_threshold=0.5).collect()}
    assert spans[1] == [("PERSONNE", 17, 27, "Luc Gaudin"), ("LIEU", 30, 43, "Châteaubertin"), ("PERSONNE", 56, 62, "Gaudin"), ("EMAIL", 64, 70, "a@b.fr")]
    assert spans[2] == spans[3] == spans[4] == []
    done = pseudonymize(docs, engines=[chain_engine(chain)], coreference=True)
    assert done.texts.where("seq = 1").first()["protected"] == "😀 Entretien avec [PERSONNE_001] à [LIEU_001].\nVu par Mme [PERSONNE_001], [EMAIL_001]"


def test_runs_of_tokens():
    assert [len(r) for r in tokens_of("M. Roux est là. Il part !\nFin")] == [6, 3, 1]
    assert [len(r) for r in tokens_of("a " * 200)] == [80, 80, 40] and tokens_of("") == []


def test_features_are_kept_for_surroundings_met_before():
    """A second text with the same words around hashes only what is new; results are those of a cold start."""
    from huisclos.operators import names

    words = "Entretien avec Jean Bernard au sujet du contrat .".split()
    hidden = frozenset({2, 3})
    names._around.cache_clear()
    names._inside.cache_clear()
    cold = [names.features(words), names.features(words, hidden)]
    missed = names._around.cache_info().misses
    assert [names.features(words), names.features(words, hidden)] == cold and names._around.cache_info().misses == missed
    other = names.features([*words[:3], "Martin", *words[4:]])
    assert names._around.cache_info().misses == missed + 5 and other[7:] == cold[0][7:] and other[3] != cold[0][3]
    assert [len(f) for f in cold[1]] == [14, 14, 11, 11, 14, 14, 14, 14, 14]
