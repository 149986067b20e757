"""Mixing sources to target weights by iterative proportional fitting.

Documents fall into cells of (source, language, topic). Raking multiplies each cell's tokens by
factors, one marginal after the other, until the weighted tokens meet the target shares of sources,
languages and topics. A cell's calibrated inclusion probability is its raked share of the token
budget over its own tokens, 1 at most; what a full cell can't give goes to the others in proportion.
A document is kept if a hash of its id and text, uniform in [0, 1), is below its cell's probability,
so the sample is the same in every run and on every cluster.

Topics come from a rule on the text: legal, contact, symbols, lines or prose. Any other expression
can be given.

There are (sources x languages x topics) cells at most; up to ``max_cells`` (checked) they are raked
with numpy on the driver, beyond it the marginals are raked by Spark joins over the cell table. Both
paths stop by one rule: when no share was off by ``TOLERANCE`` in a round, or after ``ROUNDS`` rounds with
a warning that names the worst share's error.

Edge cases: null source or lang is a value of its own. Null and empty texts have zero words and one
token (an end), so each cell with rows has tokens. Equal rows share their fate. An empty table gives
no rows. Extra columns are kept under their names, whatever these are.
"""

from __future__ import annotations

import warnings

import numpy as np
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from .common import Written

MARGINS = ("source", "lang", "topic")
ROUNDS, TOLERANCE = 200, 1e-9


def rule_topic(text: Column) -> Column:
    text = F.coalesce(text, F.lit(""))
    marks = F.length(text) - F.length(F.translate(text, "%$&*#@!{}<>|", ""))
    return (
        F.when(text.rlike(r"(?i)licen[sc]e|copyright|all rights reserved"), "legal")
        .when(text.contains("@") & text.rlike(r"[A-Za-z0-9]@[A-Za-z0-9-]+\.[A-Za-z]"), "contact")
        .when(marks * 20 > F.length(text), "symbols")
        .when((F.length(text) - F.length(F.translate(text, "\n", ""))) * 80 > F.length(text), "lines")
        .otherwise("prose")
    )


def token_count(text: Column) -> Column:
    """Words between blanks, plus an end."""
    return F.regexp_count(F.coalesce(text, F.lit("")), F.lit(r"[^ \t\n\x0B\f\r]+")).cast("long") + 1


def tempered(sizes: dict, power: float) -> dict:
    """Target shares: sizes to a power below 1, which lifts small values; power 1 keeps the shares."""
    lifted = {k: v**power for k, v in sizes.items()}
    total = sum(lifted.values())
    return {k: v / total for k, v in lifted.items()}


def rake(cells: np.ndarray, codes: np.ndarray, targets: list[np.ndarray], rounds: int = ROUNDS, tolerance: float = TOLERANCE) -> np.ndarray:
    """Weighted cell sizes (summing to 1) whose marginals meet ``targets``; ``codes``: a column of value numbers for each margin."""
    x = cells / cells.sum()
    for _ in range(rounds):
        worst = 0.0
        for m, target in enumerate(targets):
            have = np.bincount(codes[:, m], weights=x, minlength=len(target))
            factor = np.divide(target, have, out=np.ones_like(target), where=have > 0)
            worst = max(worst, float(np.abs(have - target).max()))
            x = x * factor[codes[:, m]]
        if worst < tolerance:
            break
    else:
        _not_met(rounds, worst)
    return x / x.sum()


def _not_met(rounds: int, worst: float) -> None:
    warnings.warn(f"raking stopped after {rounds} rounds with a share off its target by {worst:.2g}", stacklevel=2)


def inclusion(cells: np.ndarray, raked: np.ndarray, budget: float) -> np.ndarray:
    """Probabilities with sum(p x cells) = budget where possible, p in proportion to raked / cells below 1."""
    p, full = np.zeros(len(cells)), np.zeros(len(cells), dtype=bool)
    budget = min(budget, float(cells.sum()))
    while True:
        rest = budget - cells[full].sum()
        open_share = raked[~full].sum()
        if open_share <= 0:
            break
        p[~full] = rest * raked[~full] / open_share / cells[~full]
        over = ~full & (p >= 1)
        if not over.any():
            break
        p[over], full = 1.0, full | over
    return np.minimum(p, 1.0)


def _on_driver(cells: DataFrame, power: float, fraction: float, rounds: int) -> DataFrame:
    rows = cells.collect()  # at most max_cells rows, checked by the caller
    schema = "source string, lang string, topic string, weight double, probability double"
    if not rows:
        return cells.sparkSession.createDataFrame([], schema)
    sizes = np.array([r["tokens"] for r in rows], dtype=float)
    codes, targets = [], []
    for m in MARGINS:
        values = sorted({r[m] for r in rows}, key=lambda v: (v is not None, v or ""))
        number = {v: i for i, v in enumerate(values)}
        codes.append([number[r[m]] for r in rows])
        have = np.bincount(codes[-1], weights=sizes)
        shares = tempered(dict(enumerate(have)), power)
        targets.append(np.array([shares[i] for i in range(len(values))]))
    raked = rake(sizes, np.array(codes).T, targets, rounds)
    p = inclusion(sizes, raked, fraction * sizes.sum())
    weight = raked / (sizes / sizes.sum())
    out = [(r["source"], r["lang"], r["topic"], float(w), float(q)) for r, w, q in zip(rows, weight, p)]
    return cells.sparkSession.createDataFrame(out, schema)


def _on_executors(cells: DataFrame, power: float, fraction: float, rounds: int) -> DataFrame:
    """The same raking as joins of the cell table with its marginals, written between rounds."""
    total = cells.agg(F.sum("tokens")).first()[0]
    x = cells.withColumn("x", F.col("tokens") / F.lit(float(total)))
    targets = {}
    for m in MARGINS:
        lifted = cells.groupBy(m).agg(F.sum("tokens").alias("t")).withColumn("lifted", F.pow("t", F.lit(power)))
        norm = lifted.agg(F.sum("lifted")).first()[0]
        targets[m] = Written(lifted.select(F.col(m).alias("value"), (F.col("lifted") / norm).alias("target")))
    table = Written(x)
    for _ in range(rounds):
        x = table.read().withColumn("off", F.lit(0.0))
        for m in MARGINS:
            have = x.groupBy(F.col(m).alias("value")).agg(F.sum("x").alias("have"))
            goal = targets[m].read()
            factor = have.alias("h").join(goal.alias("g"), F.col("h.value").eqNullSafe(F.col("g.value"))).select("h.value", (F.col("target") / F.col("have")).alias("factor"), F.abs(F.col("have") - F.col("target")).alias("gap"))
            x = x.join(factor, x[m].eqNullSafe(factor["value"])).withColumn("x", F.col("x") * F.col("factor"))
            x = x.withColumn("off", F.greatest("off", "gap")).drop("value", "factor", "gap")
        after = Written(x)
        table.drop()
        table = after
        worst = table.read().agg(F.max("off")).first()[0]
        if worst < TOLERANCE:
            break
    else:
        _not_met(rounds, worst)
    x = table.read().withColumn("weight", F.col("x") / (F.col("tokens") / F.lit(float(total))))
    low, high = 0.0, 1.0
    budget = fraction * total
    while x.select(F.sum(F.least(F.lit(1.0), F.col("weight") * high) * F.col("tokens"))).first()[0] < budget * (1 - 1e-9) and high < 1e12:
        high *= 2
    for _ in range(40):
        mid = (low + high) / 2
        given = x.select(F.sum(F.least(F.lit(1.0), F.col("weight") * mid) * F.col("tokens"))).first()[0]
        low, high = (mid, high) if given < budget else (low, mid)
    return x.select(*MARGINS, "weight", F.least(F.lit(1.0), F.col("weight") * high).alias("probability"))


MADE = ("topic", "n_tokens", "weight", "probability", "keep")


def made_names(docs: DataFrame) -> dict[str, str]:
    """What ``mix_documents`` calls its columns: a name that ``docs`` has already gets underscores until it is free."""
    taken, names = {c.lower() for c in docs.columns}, {}
    for m in MADE:
        names[m] = m
        while names[m].lower() in taken:
            names[m] += "_"
    return names


def mix_documents(docs: DataFrame, fraction: float = 0.8, power: float = 0.8, topic: Column | None = None, max_cells: int = 100_000, rounds: int = ROUNDS) -> DataFrame:
    """``docs`` plus topic, n_tokens, weight, probability, keep, under ``made_names``. ``fraction`` of all tokens is the budget; ``power`` tempers the targets.

    Columns of ``docs`` keep their names and values.
    """
    topic = rule_topic(F.col("text")) if topic is None else topic
    names = made_names(docs)
    named = docs.select(F.struct(*(F.col(f"`{c}`") for c in docs.columns)).alias("row"), "doc_id", "text", "source", "lang")
    full = named.withColumn("topic", topic).withColumn("n_tokens", token_count(F.col("text")))
    cells = Written(full.groupBy(*MARGINS).agg(F.sum("n_tokens").alias("tokens")))
    if cells.read().count() <= max_cells:
        fitted = F.broadcast(_on_driver(cells.read(), power, fraction, rounds))
    else:
        fitted = _on_executors(cells.read(), power, fraction, rounds)
    fitted = fitted.select(*(F.col(m).alias(f"__{m}") for m in MARGINS), "weight", "probability")
    joined = full.join(fitted, [full[m].eqNullSafe(fitted[f"__{m}"]) for m in MARGINS])
    uniform = F.shiftrightunsigned(F.xxhash64(F.lit(17), F.col("doc_id"), F.col("text")), 11) / F.lit(float(1 << 53))
    made = joined.withColumn("keep", uniform < F.col("probability"))
    return made.select(*(F.col(f"row.`{c}`").alias(c) for c in docs.columns), *(F.col(m).alias(names[m]) for m in MADE))
