"""The state of people: what a batch asks the store for, and that people don't depend on how they are kept."""

import json
import random

import pandas as pd

from huisclos.streaming.people import SMALL, People


class Store:
    """Maps like those of a state store's one group; counts what is asked."""

    def __init__(self):
        self.maps, self.asked = {}, 0

    def getMapState(self, name, *_):
        store, held = self, self.maps.setdefault(name, {})

        class Map:
            def exists(self):
                store.asked += 1
                return bool(held)

            def containsKey(self, key):
                store.asked += 1
                return key in held

            def getValue(self, key):
                store.asked += 1
                return held[key]

            def updateValue(self, key, value):
                store.asked += 1
                held[key] = value

        return Map()


def mention(name, start=0):
    words = name.split()
    title = {"M.": "m", "Mme": "f"}.get(words[0])
    kept = words[1:] if title else words
    caps = lambda ws: sum(w[0] != w[0].lower() for w in ws)
    form = {"bare": " ".join(kept), "key": [w.lower() for w in kept], "full": sum(len(w.rstrip(".")) != 1 for w in kept), "capitals": caps(kept), "all_capitals": caps(words)}
    return {"start": start, "surface": name, "form": form | ({"gender": title} if title else {})}


def met(store, rows):
    """People of each row (dossier, seq, names) after one batch."""
    people = People()
    people.init(store)
    frame = pd.DataFrame([(d, s, "", json.dumps([mention(n, i) for i, n in enumerate(names)])) for d, s, names in rows], columns=["dossier_id", "seq", "body", "mentions"])
    (out,) = people.handleInputRows((1,), iter([frame]), None)
    return {(r.dossier_id, r.seq): [(p["surface"], p["number"]) for p in json.loads(r.people)] for r in out.itertuples()}


def test_a_small_dossier_costs_one_call(spark):
    store = Store()
    met(store, [(str(d), i, ["Jean Dupont", "M. Dupont"]) for d in range(100) for i in range(5)])
    assert store.asked == 1 + 100
    store.asked = 0
    again = met(store, [(str(d), 9, ["M. Dupont", "Mme Dupont"]) for d in range(100)])
    assert again["7", 9] == [("M. Dupont", 1), ("Mme Dupont", 2)] and store.asked == 1 + 100 * 3


def test_people_do_not_depend_on_how_they_are_kept(spark):
    rng = random.Random(5)
    first, last = ["Jean", "Marie", "J.", "M.", "Mme", "Paul"], [f"Nom{chr(97 + i)}" for i in range(20)]
    rows = [(rng.choice([None, "A", "B"]), i, [f"{rng.choice(first)} {rng.choice(last)}" for _ in range(3)]) for i in range(300)]
    whole, cut = met(Store(), rows), {}
    store = Store()
    for i in range(0, 300, 20):
        cut |= met(store, rows[i : i + 20])
    assert cut == whole and len(store.maps["people"]) > SMALL / 4 and all(tables is None for _, tables in store.maps["dossiers"].values())
    store.asked = 0
    met(store, [("A", 999, ["Jean Noma"])])
    assert 0 < store.asked < SMALL / 2
