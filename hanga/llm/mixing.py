"""Mixing sources to target weights by iterative proportional fitting.

Token counts are summed over cells (source, language, topic); categories that
have no target fall into ``other``, so the number of cells is bounded by the
targets and not by the data. Raking scales the cells to each marginal in turn
until every marginal's shares are met within ``TOLERANCE``; targets that no
weights can meet (cells that are empty) end after ``MAX_ROUNDS`` with the gap
that is left per marginal in ``Mix.gaps`` and a warning. A document's weight is the ratio of its cell's
fitted to its actual tokens. Inclusion probabilities are proportional to the
weights, calibrated to the token budget (a probability is at most 1; what the
full cells cannot take is spread over the others), and a document is drawn
when a keyed hash of its id and text lies below its probability.

Cells that occur are counted first; as long as they fit the broadcast limit
they are raked on the driver. More of them stay a table: raking then holds one
factor per category (as many as there are targets), sums every marginal by a
job over the cells, and a document's weight is the product of its three
factors, so documents are not shuffled.

Defined results: a null or unknown source, language or topic is ``other``; a
null or empty text has no token, takes no part in the sums, and its cell's
probability (its own cell may be empty: then it is never drawn); categories
with a target but no tokens are left out and the rest of that marginal is
scaled up to 1; a marginal given without ``other`` gives it no tokens; fully
equal rows are drawn together; repeated ids with different texts are drawn
apart; extra columns are kept; an empty table gives an empty result.
"""

from __future__ import annotations

import warnings
from collections.abc import Mapping
from dataclasses import dataclass, field

import numpy as np
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from hanga.session import broadcast_limit

from .common import shared_table, shielded, small_side

OTHER = "other"
TOLERANCE = 1e-10        # of a share
MAX_ROUNDS = 1000
SEED = "mix-1"
MARGINS = ("source", "lang", "topic")
CELL = ("_source", "_lang", "_topic")    # a document's cell
CELL_BYTES = 200         # of a cell or category, held on the driver or broadcast
SALTS = 16

# Topic by the first pattern that a text contains (a text of none is "prose").
TOPIC_PATTERNS = [("license", "Licensed under the"), ("table", " | "), ("contact", "@"), ("code", " = \"")]


def topic_of(text: str | Column = "text", patterns=TOPIC_PATTERNS) -> Column:
    c = F.col(text) if isinstance(text, str) else text
    topic = F.lit("prose")
    for name, part in reversed(patterns):
        topic = F.when(c.contains(part), name).otherwise(topic)
    return topic


def token_count(text: str | Column = "text") -> Column:
    """Words between ASCII white space (0 for a null text)."""
    c = F.col(text) if isinstance(text, str) else text
    return F.coalesce(F.regexp_count(c, F.lit(r"[^\x20\x09-\x0D]+")), F.lit(0)).cast("long")


def uniform(*columns: str, seed: str = SEED) -> Column:
    """Keyed uniform number in [0, 1) from the columns (13 hex digits of md5)."""
    parts = [F.coalesce(F.col(c).cast("string"), F.lit("\u0000")) for c in columns]
    digest = F.md5(F.concat_ws("\u001f", F.lit(seed), *parts))
    return F.conv(F.substring(digest, 1, 13), 16, 10).cast("double") / float(1 << 52)


@dataclass
class Mix:
    cells: list[tuple]                      # (source, lang, topic)
    tokens: np.ndarray
    weight: np.ndarray = field(default=None)       # fitted / actual
    probability: np.ndarray = field(default=None)
    gaps: dict[str, float] = field(default_factory=dict)   # marginal -> largest gap of a share


def rake(cells: list[tuple], tokens: np.ndarray, targets: list[Mapping[str, float]],
         max_rounds: int = MAX_ROUNDS, tolerance: float = TOLERANCE) -> tuple[np.ndarray, list[float]]:
    """Fitted tokens of every cell, and per marginal the largest difference
    between a category's share and its target."""
    total = float(tokens.sum())
    fitted = tokens.astype(float).copy()
    axes = []
    for axis, target in enumerate(targets):
        names = sorted({c[axis] for c in cells})
        place = {n: i for i, n in enumerate(names)}
        axes.append((np.array([place[c[axis]] for c in cells], int), np.array([target.get(n, 0.0) for n in names])))

    def wanted(at, share):
        have = np.bincount(at, fitted, len(share))
        reached = share[have > 0].sum()
        return have, np.where(have > 0, total * share / reached, 0.0) if reached > 0 else np.zeros(len(share))

    gaps = [0.0] * len(axes)
    for _ in range(max_rounds):
        for at, share in axes:
            have, want = wanted(at, share)
            fitted *= (want / np.where(have > 0, have, 1.0))[at]
        gaps = [float(np.abs(np.subtract(*wanted(*axis))).max(initial=0.0)) / max(total, 1.0) for axis in axes]
        if max(gaps) <= tolerance:
            break
    return fitted, gaps


def calibrate(tokens: np.ndarray, weight: np.ndarray, budget: float) -> np.ndarray:
    """Probabilities min(1, c * weight) whose expected tokens are ``budget``
    (all 1 where the weight is positive, if the budget exceeds that): the
    heaviest cells are full, and c is the first that fills no further cell."""
    order = np.argsort(-weight, kind="stable")
    t, w = tokens[order], weight[order]
    full_tokens = np.concatenate([[0.0], np.cumsum(t)[:-1]])       # of the heavier cells
    rest = np.cumsum((t * w)[::-1])[::-1]                          # of this and the lighter ones
    c = np.maximum(budget - full_tokens, 0.0) / np.where(rest > 0, rest, 1.0)
    open_cells = np.flatnonzero((c * w < 1.0) | (w <= 0))
    p = np.ones(len(tokens))
    if len(open_cells):
        k = open_cells[0]
        p[order[k:]] = c[k] * w[k:]
    return p


def cell_columns(targets: Mapping[str, Mapping[str, float]]) -> list[Column]:
    """The three category columns with everything untargeted as ``other``."""
    out = []
    for name in MARGINS:
        known = [k for k in targets[name] if k != OTHER]
        c = F.col(name)
        out.append(F.when(c.isin(known), c).otherwise(OTHER).alias(name))
    return out


def cell_table(docs: DataFrame, targets: Mapping[str, Mapping[str, float]]) -> DataFrame:
    """(source, lang, topic, tokens) of the cells of ``docs`` that hold tokens."""
    return (docs.where(F.col("tokens") > 0).select(*cell_columns(targets), "tokens")
            .groupBy(*MARGINS).agg(F.sum("tokens").alias("tokens")))


def _warn(gaps: Mapping[str, float], max_rounds: int) -> None:
    if max(gaps.values()) > TOLERANCE:
        warnings.warn(f"targets not met after {max_rounds} rounds, gaps of shares: {gaps}", stacklevel=3)


def fit_mix(docs: DataFrame, targets: Mapping[str, Mapping[str, float]], share: float,
            max_rounds: int = MAX_ROUNDS) -> Mix:
    """Cells, weights, probabilities and gaps of ``docs`` (columns source, lang,
    topic, tokens), raked on the driver: for cells that fit it (``sample_mix``
    counts them first)."""
    rows = cell_table(docs, targets).collect()
    rows.sort(key=lambda r: tuple(r[m] for m in MARGINS))
    cells = [tuple(r[m] for m in MARGINS) for r in rows]
    tokens = np.array([r["tokens"] for r in rows], float)
    fitted, gaps = rake(cells, tokens, [targets[m] for m in MARGINS], max_rounds)
    left = dict(zip(MARGINS, gaps, strict=True))
    _warn(left, max_rounds)
    weight = fitted / np.maximum(tokens, 1.0)
    return Mix(cells, tokens, weight, calibrate(tokens, weight, share * tokens.sum()), left)


@dataclass
class FactorMix:
    """A fit as factors: a cell's weight is the product of its categories'."""

    factors: dict[str, dict[str, float]]    # marginal -> category -> factor
    slope: float                            # probability of an open cell / its weight
    full: float                             # from this weight on the probability is 1
    gaps: dict[str, float]

    def joined(self, df: DataFrame, columns: tuple[str, ...] = MARGINS) -> DataFrame:
        """``df`` (its categories in ``columns``) and ``mix_weight``, ``mix_probability``."""
        weight = F.lit(1.0)
        for name, column in zip(MARGINS, columns, strict=True):
            table = df.sparkSession.createDataFrame(list(self.factors[name].items()),
                                                    f"{column} string, _f_{name} double")
            df = df.join(small_side(table, len(self.factors[name]), CELL_BYTES), column, "left")
            weight = weight * F.coalesce(f"_f_{name}", F.lit(0.0))
        probability = F.when(weight <= 0, 0.0).when(weight >= self.full, 1.0).otherwise(weight * self.slope)
        return (df.withColumn("mix_weight", weight).withColumn("mix_probability", probability)
                .drop(*[f"_f_{name}" for name in MARGINS]))


def fit_factors(cells: DataFrame, targets: Mapping[str, Mapping[str, float]], share: float,
                max_rounds: int = MAX_ROUNDS) -> FactorMix:
    """The same fit over a table of cells of any size, a job per marginal and
    round; only sums per category reach the driver."""
    mix = FactorMix({m: {k: 1.0 for k in {*targets[m], OTHER}} for m in MARGINS}, 0.0, float("inf"), {})

    def sums(*names):
        """Fitted tokens per category of the named marginals, in one job."""
        fitted = mix.joined(cells).withColumn("_fitted", F.col("tokens") * F.col("mix_weight"))
        pairs = F.explode(F.array(*[F.struct(F.lit(n).alias("m"), F.col(n).alias("k")) for n in names])).alias("p")
        got = fitted.select(pairs, "_fitted").groupBy("p").agg(F.sum("_fitted").alias("v")).collect()
        out = {n: {} for n in names}
        for r in got:
            out[r["p"]["m"]][r["p"]["k"]] = r["v"]
        return out

    total = float(cells.agg(F.coalesce(F.sum("tokens"), F.lit(0))).first()[0])

    def wanted(name, have):
        reached = sum(targets[name].get(k, 0.0) for k, v in have.items() if v > 0)
        return {k: total * targets[name].get(k, 0.0) / reached if v > 0 and reached > 0 else 0.0
                for k, v in have.items()}

    have = sums(*MARGINS)
    for _ in range(max_rounds):
        for i, name in enumerate(MARGINS):
            now = have[name] if i == 0 else sums(name)[name]
            want = wanted(name, now)
            for k, v in now.items():
                mix.factors[name][k] *= want[k] / v if v > 0 else 0.0
        have = sums(*MARGINS)
        mix.gaps = {n: max((abs(w - have[n][k]) for k, w in wanted(n, have[n]).items()), default=0.0) / max(total, 1.0)
                    for n in MARGINS}
        if max(mix.gaps.values()) <= TOLERANCE:
            break
    _warn(mix.gaps, max_rounds)
    # the heaviest cells fill up until the slope that spends the budget on the
    # others fills no further one; the slope only grows, so this ends
    weighed = mix.joined(cells)
    w, t = F.col("mix_weight"), F.col("tokens")
    filled = None
    while True:
        spent, rest, n = weighed.agg(
            F.coalesce(F.sum(F.when((w > 0) & (w >= mix.full), t)), F.lit(0)),
            F.coalesce(F.sum(F.when(w < mix.full, t * w)), F.lit(0.0)),
            F.count(F.when((w > 0) & (w >= mix.full), 1))).first()
        mix.slope = max(share * total - spent, 0.0) / rest if rest > 0 else 0.0
        if n == filled:
            return mix
        filled = n
        if mix.slope > 0:
            mix.full = min(mix.full, 1 / mix.slope)


def sample_mix(docs: DataFrame, targets: Mapping[str, Mapping[str, float]], share: float,
               max_rounds: int = MAX_ROUNDS, seed: str = SEED, doc_id: str = "doc_id", text: str = "text",
               source: str = "source", lang: str = "lang", topic: Column | None = None,
               keep_all: bool = False) -> DataFrame:
    """Documents drawn towards ``targets`` (marginal -> category -> share of
    tokens), about ``share`` of all tokens, with added columns ``mix_topic``,
    ``mix_tokens``, ``mix_weight`` (fitted to actual tokens of the cell),
    ``mix_probability`` and ``mix_drawn``; ``keep_all`` keeps the undrawn."""
    added = ("mix_topic", "mix_tokens", "mix_weight", "mix_probability", "mix_drawn")
    return shielded(docs, [doc_id, text, source, lang], lambda d: _sample(
        d, targets, share, max_rounds, seed, doc_id, text, source, lang, topic, keep_all), added)


def _sample(docs, targets, share, max_rounds, seed, doc_id, text, source, lang, topic, keep_all) -> DataFrame:
    marked = docs.withColumn("mix_topic", topic_of(text) if topic is None else topic) \
                 .withColumn("mix_tokens", token_count(text))
    plain = marked.select(F.col(source).cast("string").alias("source"), F.col(lang).cast("string").alias("lang"),
                          F.col("mix_topic").alias("topic"), F.col("mix_tokens").alias("tokens"))
    cells = shared_table(cell_table(plain, targets), "cells")
    for own, name, column in zip(CELL, MARGINS, (source, lang, "mix_topic"), strict=True):
        known = [k for k in targets[name] if k != OTHER]
        c = F.col(column).cast("string")
        marked = marked.withColumn(own, F.when(c.isin(known), c).otherwise(OTHER))
    if cells.count() * CELL_BYTES <= broadcast_limit(docs.sparkSession):
        mix = fit_mix(cells, targets, share, max_rounds)
        rows = [(*c, float(w), float(p)) for c, w, p in zip(mix.cells, mix.weight, mix.probability, strict=True)]
        table = docs.sparkSession.createDataFrame(rows, ", ".join(f"{c} string" for c in CELL)
                                                  + ", mix_weight double, mix_probability double")
        out = marked.join(F.broadcast(table), list(CELL), "left")      # counted above
    else:
        out = _by_factors(marked, cells, fit_factors(cells, targets, share, max_rounds), doc_id)
    out = (out.withColumn("mix_weight", F.coalesce("mix_weight", F.lit(0.0)))
           .withColumn("mix_probability", F.coalesce("mix_probability", F.lit(0.0)))
           .withColumn("mix_drawn", uniform(doc_id, text, seed=seed) < F.col("mix_probability")))
    out = out.select(*docs.columns, "mix_topic", "mix_tokens", "mix_weight", "mix_probability", "mix_drawn")
    return out if keep_all else out.where("mix_drawn").drop("mix_drawn")


def _by_factors(marked: DataFrame, cells: DataFrame, mix: FactorMix, doc_id: str) -> DataFrame:
    """Weights and probabilities from the factors. Documents without tokens
    take their cell's only if it occurs: they alone meet the cells, salted."""
    out = mix.joined(marked, CELL)
    real = (cells.select(*[F.col(m).alias(c) for m, c in zip(MARGINS, CELL, strict=True)], F.lit(True).alias("_real"))
            .withColumn("_salt", F.explode(F.sequence(F.lit(0), F.lit(SALTS - 1)))))
    bare = (out.where("mix_tokens = 0").withColumn("_salt", F.pmod(F.xxhash64(doc_id), F.lit(SALTS)).cast("int"))
            .join(real, [*CELL, "_salt"], "left"))
    for name in ("mix_weight", "mix_probability"):
        bare = bare.withColumn(name, F.when(F.col("_real"), F.col(name)).otherwise(0.0))
    return out.where("mix_tokens > 0").unionByName(bare.drop("_real", "_salt"))
