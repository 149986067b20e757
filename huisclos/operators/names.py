"""A name engine that is trained here: a linear-chain conditional random field over tokens.

Labels are begin and inside of PERSONNE, ORGANISATION and LIEU, and outside. Features are hashed: the
word, its shape, ends and neighbours. Training maximizes the likelihood by forward-backward sums on a
bounded set of labelled sentences, which ``made_sentences`` writes from templates; texts are decoded by
Viterbi in batches inside Spark's tasks. It knows what its templates teach and is no equal of a model
that was trained on real texts; README has its held-out figures.
"""

from __future__ import annotations

import random
import re
import zlib
from dataclasses import dataclass
from functools import lru_cache

import numpy as np
import pandas as pd
from pyspark.sql import functions as F

from .detect import SPAN, Engine

KINDS = ("PERSONNE", "ORGANISATION", "LIEU")
LABELS = ("O", *(f"{p}-{k}" for k in KINDS for p in "BI"))
#: Hashed features; 0 stands for none.
WIDTH = 1 << 16
#: Tokens that are decoded at one go; longer texts are cut at line ends, sentence ends, or here.
LONGEST = 80
TOKEN = re.compile(r"\w+(?:['’]\w+)?|[^\w\s]")
#: Words that announce a person.
TITLES = frozenset("m mr mme mlle monsieur madame mademoiselle dr docteur me maître maitre pr professeur".split())

Sentence = list[tuple[str, str]]


@lru_cache(maxsize=1 << 16)
def shape(word: str) -> str:
    kinds = "".join("X" if c.isupper() else "x" if c.islower() else "9" if c.isdigit() else c for c in word)
    return re.sub(r"(.)\1+", r"\1+", kinds)


def features(words: list[str], hidden: frozenset[int] = frozenset()) -> list[list[int]]:
    """Hashed features of each word; words at ``hidden`` places show their shape only, as unknown ones do."""
    low = [w.lower() for w in words]
    shapes = [shape(w) for w in words]
    shown = ["?" if i in hidden else w for i, w in enumerate(low)] if hidden else low
    # two places more on either side
    read, seen, forms = (["^", "^", *x, "$", "$"] for x in (low, shown, shapes))
    out = []
    for i, (word, own) in enumerate(zip(low, shapes)):
        told = _around(i == 0, seen[i + 2], own, read[i + 1], read[i], seen[i + 1], seen[i], seen[i + 3], seen[i + 4], forms[i + 1], forms[i + 3])
        out.append([*told, *_inside(word, own)] if i not in hidden else [*told])
    return out


def _hashed(told: tuple[str, ...]) -> tuple[int, ...]:
    return tuple(1 + zlib.crc32(t.encode()) % (WIDTH - 1) for t in told)


@lru_cache(maxsize=1 << 15)
def _around(first: bool, word: str, own: str, last: str, last_but_one: str, p: str, pp: str, n: str, nn: str, shape_before: str, shape_after: str) -> tuple[int, ...]:
    """Features of a word among its neighbours, kept for the surroundings met last."""
    titled = last.rstrip(".") in TITLES or last_but_one.rstrip(".") in TITLES
    return _hashed((f"w={word}", f"s={own}", f"p={p}", f"n={n}", f"pp={pp}|{p}", f"ps={shape_before}|{own}", f"ns={own}|{shape_after}", f"nn={n}|{nn}", f"t={titled}|{own}", f"b={first}|{own}", f"pw={p}|{own}"))


@lru_cache(maxsize=1 << 16)
def _inside(word: str, own: str) -> tuple[int, ...]:
    """Features of a word's own letters."""
    return _hashed((f"e={word[-3:]}", f"h={word[:3]}", f"e2={word[-2:]}|{own}"))


def padded(rows: list[list[list[int]]]) -> tuple[np.ndarray, np.ndarray]:
    """(sentence x token x feature numbers, lengths)."""
    lengths = np.array([len(r) for r in rows])
    most = max((len(f) for r in rows for f in r), default=1)
    out = np.zeros((len(rows), max(1, lengths.max(initial=1)), most), dtype=np.int32)
    for i, r in enumerate(rows):
        for j, f in enumerate(r):
            out[i, j, : len(f)] = f
    return out, lengths


def _lse(x: np.ndarray, axis: int) -> np.ndarray:
    top = x.max(axis=axis, keepdims=True)
    return np.log(np.exp(x - top).sum(axis=axis)) + top.squeeze(axis)


@dataclass
class Chain:
    """``emit``: a weight for each feature and label, ``move``: for each pair of neighbouring labels, ``begin``: for the first one."""

    emit: np.ndarray
    move: np.ndarray
    begin: np.ndarray

    def scores(self, feats: np.ndarray) -> np.ndarray:
        return self.emit[feats].sum(axis=2)

    def sums(self, scores: np.ndarray, lengths: np.ndarray) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
        """Forward sums, backward sums and the logarithm of the total."""
        n, most, k = scores.shape
        ahead, back = np.zeros_like(scores), np.zeros_like(scores)
        ahead[:, 0] = scores[:, 0] + self.begin
        for t in range(1, most):
            ahead[:, t] = _lse(ahead[:, t - 1, :, None] + self.move, 1) + scores[:, t]
        for t in range(most - 2, -1, -1):
            step = _lse(self.move + (scores[:, t + 1] + back[:, t + 1])[:, None, :], 2)
            back[:, t] = np.where((t + 1 < lengths)[:, None], step, 0.0)
        return ahead, back, _lse(ahead[np.arange(n), lengths - 1], 1)

    def marginals(self, scores: np.ndarray, lengths: np.ndarray) -> np.ndarray:
        ahead, back, total = self.sums(scores, lengths)
        return np.exp(ahead + back - total[:, None, None])

    def best(self, scores: np.ndarray, lengths: np.ndarray) -> np.ndarray:
        """Viterbi: the likeliest labels; an inside label follows its own kind only."""
        n, most, k = scores.shape
        ruled = self.move + FORBIDDEN
        value, back = scores[:, 0] + self.begin + FORBIDDEN_FIRST, np.zeros((n, most, k), dtype=np.int8)
        for t in range(1, most):
            through = value[:, :, None] + ruled
            back[:, t] = through.argmax(axis=1)
            value = np.where((t < lengths)[:, None], through.max(axis=1) + scores[:, t], value)
        out = np.zeros((n, most), dtype=np.int8)
        last = value.argmax(axis=1)
        for t in range(most - 1, -1, -1):
            out[:, t] = last
            last = np.where(t < lengths, back[np.arange(n), t, last], last)
        return out


def _forbidden() -> tuple[np.ndarray, np.ndarray]:
    moves, first = np.zeros((len(LABELS), len(LABELS))), np.zeros(len(LABELS))
    for j, to in enumerate(LABELS):
        if to.startswith("I-"):
            first[j] = -1e9
            moves[[i for i, a in enumerate(LABELS) if a[2:] != to[2:]], j] = -1e9
    return moves, first


FORBIDDEN, FORBIDDEN_FIRST = _forbidden()


def train(sentences: list[Sentence], rounds: int = 8, batch: int = 64, rate: float = 0.25, weight: float = 1e-5, hide: float = 0.35, seed: int = 1) -> Chain:
    """Adaptive gradient ascent of the likelihood. ``hide``: the share of capitalized words whose spelling a round doesn't see."""
    rng = random.Random(seed)
    k = len(LABELS)
    chain = Chain(np.zeros((WIDTH, k)), np.zeros((k, k)), np.zeros(k))
    seen = [np.full_like(w, 1e-6) for w in (chain.emit, chain.move, chain.begin)]
    order = list(range(len(sentences)))
    for _ in range(rounds):
        rng.shuffle(order)
        for s in range(0, len(order), batch):
            part = [sentences[i] for i in order[s : s + batch]]
            hidden = [frozenset(i for i, (w, _) in enumerate(p) if w[:1].isupper() and rng.random() < hide) for p in part]
            feats, lengths = padded([features([w for w, _ in p], h) for p, h in zip(part, hidden)])
            n, most = feats.shape[:2]
            inside = np.arange(most) < lengths[:, None]
            truth = np.zeros((n, most), dtype=int)
            for i, p in enumerate(part):
                truth[i, : len(p)] = [LABELS.index(label) for _, label in p]
            scores = chain.scores(feats)
            ahead, back, total = chain.sums(scores, lengths)
            expected = np.exp(ahead + back - total[:, None, None]) * inside[..., None]
            right = np.eye(k)[truth] * inside[..., None]
            gap = right - expected
            slope = np.zeros_like(chain.emit)
            np.add.at(slope, feats.reshape(n * most, -1), gap.reshape(n * most, 1, k))
            slope[0] = 0.0
            moves = np.zeros((k, k))
            for t in range(1, most):
                on = inside[:, t]
                pair = np.exp(ahead[on, t - 1, :, None] + chain.move + (scores[on, t] + back[on, t])[:, None, :] - total[on, None, None])
                moves += np.einsum("na,nb->ab", right[on, t - 1], right[on, t]) - pair.sum(axis=0)
            for held, grown, g in zip((chain.emit, chain.move, chain.begin), seen, (slope, moves, gap[:, 0].sum(axis=0))):
                touched = g != 0
                g = g / n - weight * held
                grown[touched] += g[touched] ** 2
                held[touched] += rate * g[touched] / np.sqrt(grown[touched])
    return chain


def tokens_of(text: str) -> list[list[tuple[int, int]]]:
    """Places of tokens, in runs that end with a line, a sentence or ``LONGEST`` tokens."""
    runs: list[list[tuple[int, int]]] = [[]]
    at = 0
    for m in TOKEN.finditer(text):
        last = text[runs[-1][-1][0] : runs[-1][-1][1]] if runs[-1] else ""
        ended = last in "!?…" or (last == "." and len(runs[-1]) > 1 and text[runs[-1][-2][0] : runs[-1][-2][1]].lower() not in TITLES and runs[-1][-2][1] - runs[-1][-2][0] > 1)
        if runs[-1] and (ended or len(runs[-1]) == LONGEST or "\n" in text[at : m.start()]):
            runs.append([])
        runs[-1].append(m.span())
        at = m.end()
    return [r for r in runs if r]


def spans_of(chain: Chain, texts: list[str | None], batch: int = 256) -> list[list[dict]]:
    """Names in each text: type, start, end, score (the least probability of its tokens' kind) and value."""
    runs = [(n, run) for n, text in enumerate(texts) if text for run in tokens_of(text)]
    out: list[list[dict]] = [[] for _ in texts]
    # runs without a capital hold no name
    runs = [(n, run) for n, run in runs if any(texts[n][a].isupper() for a, _ in run)]
    runs.sort(key=lambda r: len(r[1]))
    for s in range(0, len(runs), batch):
        part = runs[s : s + batch]
        feats, lengths = padded([features([texts[n][a:b] for a, b in run]) for n, run in part])
        scores = chain.scores(feats)
        labels, sure = chain.best(scores, lengths), chain.marginals(scores, lengths)
        for i, (n, run) in enumerate(part):
            t = 0
            while t < len(run):
                label = LABELS[labels[i, t]]
                if label == "O":
                    t += 1
                    continue
                end, own = t + 1, [LABELS.index(f"{p}-{label[2:]}") for p in "BI"]
                while end < len(run) and LABELS[labels[i, end]] == f"I-{label[2:]}":
                    end += 1
                a, b = run[t][0], run[end - 1][1]
                out[n].append({"type": label[2:], "start": a, "end": b, "score": float(min(1.0, sure[i, t:end][:, own].sum(axis=1).min())), "value": texts[n][a:b]})
                t = end
    return [sorted(found, key=lambda f: f["start"]) for found in out]


#: What made names are put together from. Syllables of family names and places, first names, kinds of organisations.
HEADS = "Ber Mar Du Le Gar Mon Cha Bon Rous Per La Del Fa Gi Lam Mo Pou Sa Ta Vi Bau Cou Dan Fer Gau Hu Jo Ker Lan Mel".split()
TAILS = "nard tin pont mont rin chet vier neau sel let roux court bert ville gnon mard quin teau lier zac rand douin chon din vel reau".split()
FIRST_NAMES = "Jean Marie Paul Claire Luc Anne Pierre Sophie Louis Julie Michel Hélène André Élise Henri Camille Jacques Lucie René Martine Denis Nadia Karim Inès Léa Hugo Yves Odette Gérard Simone".split()
PLACES = "Saint- Mont Ville Château Pont Val Roque Bel Neuf Haut".split()
ORGANISATIONS = ("SARL {f}", "Société {f}", "Association {f}", "Cabinet {f}", "Groupe {f}", "Clinique {l}", "Mairie de {l}", "Lycée {f}", "Banque {f}", "Fondation {f}", "{f} SA", "{f} et Fils", "CHU de {l}", "Hôpital de {l}")
TEMPLATES = (
    "{P} habite à {L} depuis 2019.", "Entretien avec {P} à {L}.", "{T} {F} travaille pour {O}.", "Le dossier de {P} est complet.", "Madame la juge a entendu {P} et {P}.", "{O} a son siège à {L}.", "Vu par {T} {F}, médecin à {L}.",
    "Je soussigné {P}, demeurant à {L}, déclare ce qui suit.", "Selon {P}, la réunion aura lieu le 3 mars.", "Convention entre {O} et {T} {F}.", "Né à {L}, {P} a grandi chez sa tante.", "La commune de {L} soutient {O}.", "Présents : {P}, {P}, {T} {F}.",
    "Objet : demande de {T} {F}", "Il est rappelé que le délai court à compter du jugement.", "Le Conseil a rendu son avis. La séance est levée.", "Merci de transmettre la pièce à {P}.", "Depuis {L}, le trajet dure deux heures.", "Lettre adressée à {O}, {L}.",
    "Ce matin, {T} {F} était absent.", "L'agent a signé. Bonjour, Cordialement.", "Contact : {P} ({O})", "{P} et {T} {F} sont convoqués à {L}.", "Aucune observation n'a été faite par le Président.", "Facture de {O} du 12 mai.", "Rendez-vous chez {T} {F} lundi.",
)
#: Sentences of other forms, for measuring.
OTHER_TEMPLATES = (
    "Après avoir vu {P}, nous partons pour {L}.", "Le courrier de {T} {F} vient de {L}.", "{O} emploie {P} depuis dix ans.", "Les parents de {P} vivent près de {L}.", "Avis favorable de {T} {F} concernant {P}.", "La directrice de {O} a reçu {T} {F}.",
    "Aucune suite ne sera donnée à la demande du Comité.", "À {L}, la pluie tombe.", "Un contrat lie {P} à {O}.",
)


def made_sentences(n: int, seed: int, templates: tuple[str, ...] = TEMPLATES, heads: list[str] = HEADS[:20], tails: list[str] = TAILS[:18], first_names: list[str] = FIRST_NAMES[:20]) -> list[Sentence]:
    """Labelled sentences from templates and put-together names; other heads, tails and first names make other names."""
    rng = random.Random(seed)
    family = lambda: rng.choice(heads) + rng.choice(tails)

    def place() -> str:
        head = rng.choice(PLACES)
        name = head + (family() if head.endswith("-") else family().lower())
        return name + rng.choice(("", "", "", "-sur-Loire", " le Bas"))

    def name(slot: str) -> str:
        if slot == "F":
            return rng.choice((family(), family(), family().upper()))
        if slot == "P":
            first = rng.choice(first_names)
            return rng.choice((f"{first} {family()}", f"{first} {family()}", f"{first} {family().upper()}", f"{first[0]}. {family()}", f"{first}-{rng.choice(first_names)} {family()}"))
        if slot == "L":
            return place()
        if slot == "O":
            return rng.choice(ORGANISATIONS).format(f=family(), l=place())
        return rng.choice(("M.", "Mme", "Monsieur", "Madame", "Dr", "Me", "Mlle", "docteur"))

    kinds = {"P": "PERSONNE", "F": "PERSONNE", "L": "LIEU", "O": "ORGANISATION"}
    out = []
    for _ in range(n):
        sentence: Sentence = []
        for part in re.split(r"(\{[A-Z]\})", rng.choice(templates)):
            slot = part[1:-1] if part.startswith("{") else ""
            words = TOKEN.findall(name(slot) if slot else part)
            kind = kinds.get(slot)
            sentence += [(w, "O" if kind is None else f"{'B' if i == 0 else 'I'}-{kind}") for i, w in enumerate(words)]
        out.append(sentence)
    return out


def measured(chain: Chain, sentences: list[Sentence]) -> dict[str, tuple[int, int, int]]:
    """By kind: true names, found names, names found exactly."""

    def names(words: list[str], labels: list[str]) -> set[tuple[str, int, int]]:
        found, begin = set(), None
        for i, label in enumerate([*labels, "O"]):
            if begin is not None and not (label.startswith("I-") and label[2:] == labels[begin][2:]):
                found.add((labels[begin][2:], begin, i))
                begin = None
            if label.startswith("B-"):
                begin = i
        return found

    counts = {k: [0, 0, 0] for k in KINDS}
    for s in range(0, len(sentences), 256):
        part = sentences[s : s + 256]
        feats, lengths = padded([features([w for w, _ in p]) for p in part])
        best = chain.best(chain.scores(feats), lengths)
        for p, row in zip(part, best):
            words = [w for w, _ in p]
            true, found = names(words, [label for _, label in p]), names(words, [LABELS[x] for x in row[: len(p)]])
            for kind, *_ in true:
                counts[kind][0] += 1
            for span in found:
                counts[span[0]][1] += 1
                counts[span[0]][2] += span in true
    return {k: tuple(c) for k, c in counts.items()}


@lru_cache(maxsize=4)
def trained(n: int = 4000, seed: int = 1) -> Chain:
    """The chain of ``n`` made sentences, trained once in a process."""
    chain = train(made_sentences(n, seed), seed=seed)
    return Chain(chain.emit.astype(np.float32), chain.move, chain.begin)


def chain_engine(chain: Chain | None = None) -> Engine:
    """A name engine behind the protocol of ``detect``; its weights go to tasks with the function, 2 MB."""
    model = chain or trained()

    @F.pandas_udf(SPAN)
    def run(texts: pd.Series) -> pd.Series:
        return pd.Series(spans_of(model, [t if isinstance(t, str) else None for t in texts]), dtype=object)

    return run
