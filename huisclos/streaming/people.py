"""Coreference as a stream: a dossier's people live in the state store.

Dossiers share ``BUCKETS`` groups, as each group and each call of the state store has a price of its own. A dossier
has four tables, by surface, whole key, last name and number. Small ones are one entry; those of a dossier with over
``SMALL`` entries are maps, of which only entries that a batch's mentions ask for are read and written, so a dossier
with very many people costs a batch no more than one with few. Mentions of a batch are met in (seq, start) order after
all earlier batches; cut into batches at any place, a stream whose documents come in order gives the people of
``resolve_people`` over all of them.
"""

from __future__ import annotations

import json
from collections.abc import Callable, Iterable, Iterator
from typing import Any

import pandas as pd
from pyspark.sql import DataFrame
from pyspark.sql import functions as F
from pyspark.sql.streaming import StatefulProcessor, StatefulProcessorHandle

from ..operators.coreference import Dossier, Form, Person, form_of
from ..operators.detect import Engine, detect
from ..operators.policy import KEEP, MASK, action_for, as_maps

ROCKS = "org.apache.spark.sql.execution.streaming.state.RocksDBStateStoreProvider"
PERSON = "surface string, gender string, bare string, key string, full int, capitals int, all_capitals int, canonical string, casing int, genders string, unclear boolean"
MENTION = "surface string, number long, placeholder string, canonical string, ambiguous boolean"
#: Groups of dossiers. State is kept by them, so a checkpoint goes with their number.
BUCKETS = 4096
#: Entries of all tables that a dossier keeps in one.
SMALL = 64


class Kept:
    """A dict over a map of the state store: an entry is read when it is asked for, and written back once if it has changed. With ``whole`` the map is not asked, as all entries are given."""

    def __init__(self, state, dossier: str, key_of: Callable[[Any], Any], pack: Callable[[Any], tuple], unpack: Callable[[Any, tuple], Any], whole: bool = False):
        self.state, self.dossier, self.key_of, self.pack, self.unpack, self.whole = state, dossier, key_of, pack, unpack, whole
        self.held: dict = {}
        self.packed: dict = {}

    def get(self, key, default=None):
        if not self.whole and key not in self.held and self.state.containsKey((self.dossier, self.key_of(key))):
            self.packed[key] = tuple(self.state.getValue((self.dossier, self.key_of(key))))
            self.held[key] = self.unpack(key, self.packed[key])
        return self.held.get(key, default)

    def __getitem__(self, key):
        found = self.get(key)
        if found is None:
            raise KeyError(key)
        return found

    def __setitem__(self, key, value) -> None:
        self.held[key] = value

    def setdefault(self, key, value):
        found = self.get(key)
        if found is None:
            found = self.held[key] = value
        return found

    def entries(self) -> list[tuple]:
        return [(self.key_of(key), self.pack(value)) for key, value in self.held.items()]

    def write(self) -> None:
        for key, value in self.held.items():
            if (now := self.pack(value)) != self.packed.get(key):
                self.state.updateValue((self.dossier, self.key_of(key)), now)


def _person_row(p: Person) -> tuple:
    f = p.name
    return f.surface, f.gender, f.bare, " ".join(f.key), f.full, f.capitals, f.all_capitals, p.canonical, p.casing, "".join(sorted(p.genders)), p.unclear


def _person_of(number: int, row: tuple) -> Person:
    surface, gender, bare, key, full, capitals, all_capitals, canonical, casing, genders, unclear = row
    return Person(number, Form(surface, gender, bare, tuple(key.split()), full, capitals, all_capitals), canonical, casing, set(genders), unclear)


def _numbers(text: str) -> set[int]:
    return {int(n) for n in text.split(",")}


def _listed(numbers: set[int]) -> tuple:
    return (",".join(map(str, sorted(numbers))),)


class People(StatefulProcessor):
    """Rows (bucket, dossier_id, seq, ``body``, mentions) in, (dossier_id, seq, ``body``, people) out; mentions and people are JSON."""

    def init(self, handle: StatefulProcessorHandle) -> None:
        self.dossiers = handle.getMapState("dossiers", "dossier string", "n long, tables string")
        self.surfaces = handle.getMapState("surfaces", "dossier string, surface string", "number long")
        self.keys = handle.getMapState("keys", "dossier string, key string", "numbers string")
        self.namesakes = handle.getMapState("namesakes", "dossier string, last string", "numbers string")
        self.people = handle.getMapState("people", "dossier string, number long", PERSON)

    def _tables(self, name: str, stored: str | None, whole: bool) -> list[Kept]:
        same, one = (lambda k: k), (lambda x: (x,))
        tables = [
            Kept(self.people, name, same, _person_row, _person_of, whole),
            Kept(self.surfaces, name, same, one, lambda _, row: row[0], whole),
            Kept(self.keys, name, " ".join, _listed, lambda _, row: _numbers(row[0]), whole),
            Kept(self.namesakes, name, same, _listed, lambda _, row: _numbers(row[0]), whole),
        ]
        for at, (table, entries) in enumerate(zip(tables, json.loads(stored) if stored else ())):
            for text, row in entries:
                key = tuple(text.split()) if at == 2 else text
                table.held[key] = table.unpack(key, tuple(row))
        return tables

    def _write(self, name: str, dossier: Dossier, tables: list[Kept], before: tuple | None) -> None:
        stored = None
        if tables[0].whole and sum(len(t.held) for t in tables) <= SMALL:
            stored = json.dumps([t.entries() for t in tables], ensure_ascii=False)
        else:
            for table in tables:
                table.write()
        if (dossier.count, stored) != before:
            self.dossiers.updateValue((name,), (dossier.count, stored))

    def handleInputRows(self, key, rows: Iterator[pd.DataFrame], timerValues) -> Iterator[pd.DataFrame]:
        batch = pd.concat(list(rows)).sort_values("seq", kind="stable", ignore_index=True)  # the documents of a group of dossiers in one batch
        new = not self.dossiers.exists()
        held: dict[str, tuple] = {}
        met = []
        for dossier_id, mentions in zip(batch["dossier_id"].tolist(), batch["mentions"].tolist()):
            name = "" if dossier_id is None else f"={dossier_id}"
            if name not in held:
                before = tuple(self.dossiers.getValue((name,))) if not new and self.dossiers.containsKey((name,)) else None
                tables = self._tables(name, before and before[1], before is None or before[1] is not None)
                held[name] = Dossier(*tables, count=before[0] if before else 0), tables, before
            dossier = held[name][0]
            forms = [(m["surface"], m["form"]) for m in sorted(json.loads(mentions), key=lambda m: m["start"])]
            met.append((dossier, [(s, dossier.meet(Form(s, f.get("gender"), f["bare"], tuple(f["key"]), f["full"], f["capitals"], f["all_capitals"]))) for s, f in forms]))
        for name, (dossier, tables, before) in held.items():
            self._write(name, dossier, tables, before)
        # every person as the batch leaves them
        told = lambda d, s, n: {"surface": s, "number": n, "placeholder": f"[PERSONNE_{n:03d}]", "canonical": d.people[n].canonical, "ambiguous": d.people[n].unclear}
        batch["people"] = [json.dumps([told(d, s, n) for s, n in row], ensure_ascii=False) for d, row in met]
        yield batch[["dossier_id", "seq", "body", "people"]]

    def close(self) -> None:
        pass


def people_stream(docs: DataFrame, engines: Iterable[Engine], policies: DataFrame | None = None, engine_threshold: float = 0.0) -> DataFrame:
    """``docs``: a stream of (dossier_id, seq, text). Returns (dossier_id, seq, text, spans, people): detected spans and each name's person.

    Names that the dossier's policy keeps or masks are no mentions. Sets the state store that keyed state needs.
    """
    docs.sparkSession.conf.set("spark.sql.streaming.stateStore.providerClass", ROCKS)
    found = detect(docs.select("dossier_id", "seq", "text"), engines=engines, engine_threshold=engine_threshold)
    if policies is None:
        found = found.withColumn("policy", F.create_map().cast("map<string,string>"))
    else:
        found = found.join(as_maps(policies), "dossier_id", "left")
    numbered = ~action_for(F.lit("PERSONNE"), F.col("policy")).isin(KEEP, MASK)
    names = F.filter("spans", lambda s: (s["type"] == "PERSONNE") & numbered)
    mentions = F.transform(names, lambda s: F.struct(s["start"].alias("start"), s["value"].alias("surface"), form_of(s["value"]).alias("form")))
    # the body passes through as one text
    bucket = F.pmod(F.xxhash64("dossier_id"), F.lit(BUCKETS)).alias("bucket")
    rows = found.select(bucket, "dossier_id", F.col("seq").cast("long").alias("seq"), F.to_json(F.struct("text", "spans")).alias("body"), F.to_json(mentions).alias("mentions"))
    resolved = rows.groupBy("bucket").transformWithStateInPandas(People(), "dossier_id string, seq long, body string, people string", "Append", "None")
    body = F.from_json("body", "text string, spans array<struct<type:string,start:int,end:int,score:double,value:string>>")
    people = F.from_json("people", f"array<struct<{MENTION.replace(' ', ':').replace(',:', ',')}>>")
    return resolved.withColumn("b", body).select("dossier_id", "seq", "b.text", "b.spans", people.alias("people"))


def people_of(batch: DataFrame) -> DataFrame:
    """(dossier_id, surface, number, placeholder, canonical, ambiguous) of one batch of ``people_stream``."""
    rows = batch.select("dossier_id", F.explode("people").alias("p"))
    return rows.groupBy("dossier_id", F.col("p.surface").alias("surface")).agg(F.max("p").alias("p")).select("dossier_id", "surface", "p.number", "p.placeholder", "p.canonical", "p.ambiguous")
