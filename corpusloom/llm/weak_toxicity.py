"""Toxicity by weak supervision.

Voters are words (the lexicon) and word stems (patterns) that labelled texts name far more often when
they are marked toxic. A generative label model treats the given label and every vote as noisy
witnesses of a hidden class: it estimates how often each speaks in either class, how strongly votes
are correlated beyond the class, and from these the posterior class of every labelled text. A linear
classifier is trained on these posteriors and scores all texts.

The models are fitted on at most ``sample_rows`` labelled texts, chosen by a hash of their ids.
Candidate voters are counted by Spark over that sample; at most ``voters`` of them and the votes of
the sample, numbers only, reach the driver. Scoring is one pass over all texts without a shuffle.

Defined results: a null text is an empty text; an empty text gets the score of a text without votes;
labels that are null are ignored, and several labels of an id count by their mean, one half as
toxic; without labelled toxic texts every score is 0; null ids are not held out; an empty table
gives an empty result.
"""

from __future__ import annotations

import re
from collections import Counter
from collections.abc import Iterator
from dataclasses import dataclass

import numpy as np
import pandas as pd
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from corpusloom.llm.memory import lean
from corpusloom.session import materialize

LETTERS = re.compile(r"[^\W\d_]+")
STEM = "<"  # marks a voter that is the start of a word
REMEMBERED = 250_000


@dataclass(frozen=True)
class Settings:
    """``stems``: lengths of word starts; ``support``: least toxic texts of a voter; ``lift``: least odds ratio."""

    sample_rows: int = 20_000
    voters: int = 600
    stems: tuple[int, ...] = (4, 5, 6, 7)
    support: int = 5
    lift: float = 8.0
    rounds: int = 20
    ridge: float = 0.02
    threshold: float = 0.7


@dataclass(frozen=True)
class Model:
    names: tuple[str, ...]
    weights: tuple[float, ...]
    bias: float
    stems: tuple[int, ...]

    def table(self) -> dict[str, int]:
        return {name: i for i, name in enumerate(self.names)}


def held_out(id_col: Column) -> Column:
    return F.coalesce(F.pmod(F.crc32(id_col.cast("string").cast("binary")), F.lit(3)) == 1, F.lit(False))


def voters_of(word: str, stems: tuple[int, ...]) -> list[str]:
    return [word, *[STEM + word[:n] for n in stems if len(word) >= n]]


def labelled_sample(docs: DataFrame, labels: DataFrame, s: Settings) -> DataFrame:
    """(text, label) of at most ``sample_rows`` labelled ids that are not held out: one row per id.

    The ids are broadcast: their number is bounded by ``sample_rows``. Of the documents of a repeated id the
    smallest text counts, chosen within each task before it moves.
    """
    chosen = (
        labels.filter(F.col("toxic").isNotNull() & F.col("doc_id").isNotNull() & ~held_out(F.col("doc_id")))
        .groupBy("doc_id")
        .agg((F.avg("toxic") >= 0.5).cast("int").alias("label"))
        .orderBy(F.xxhash64("doc_id"), "doc_id")
        .limit(s.sample_rows)
    )
    texts = docs.select("doc_id", F.coalesce("text", F.lit("")).alias("text"))
    found = texts.join(F.broadcast(chosen), "doc_id").groupBy("doc_id", "label").agg(F.min("text").alias("text"))
    return materialize(found.select("text", "label"))


def candidate_voters(sample: DataFrame, s: Settings) -> list[str]:
    """Names of the strongest voters, by how many more toxic texts name them than chance explains."""

    def count(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        toxic, clean = Counter(), Counter()
        for pdf in batches:
            for text, label in zip(pdf["text"], pdf["label"]):
                words = set(LETTERS.findall(text.lower()))
                (toxic if label else clean).update({v for w in words for v in voters_of(w, s.stems)})
        names = list(toxic)  # a voter that no toxic text of this task names adds clean counts only
        both = names + [v for v in clean if v not in toxic]
        for low in range(0, len(both), 50_000):
            some = both[low : low + 50_000]
            voters = pd.Series(some, dtype=object)
            yield pd.DataFrame({"voter": voters, "toxic": [toxic[v] for v in some], "clean": [clean[v] for v in some]})

    sizes = {r["label"]: r["count"] for r in sample.groupBy("label").count().collect()}
    n1, n0 = sizes.get(1, 0), sizes.get(0, 0)
    if not n1:
        return []
    odds = ((F.col("toxic") + 0.5) / (n1 + 1)) / ((F.col("clean") + 0.5) / (n0 + 1))
    counted = (
        sample.mapInPandas(lean(count), "voter string, toxic long, clean long")
        .groupBy("voter")
        .agg(F.sum("toxic").alias("toxic"), F.sum("clean").alias("clean"))
        .filter((F.col("toxic") >= s.support) & (odds >= s.lift))
        .orderBy((F.log(odds) * F.sqrt("toxic")).desc(), "voter")
        .limit(s.voters)
    )
    return [r["voter"] for r in counted.select("voter").collect()]


class Ballot:
    """Votes of texts; remembers which voters a word stands for."""

    def __init__(self, names: tuple[str, ...], stems: tuple[int, ...]) -> None:
        self.index = {name: i for i, name in enumerate(names)}
        self.stems = stems
        self.known: dict[str, tuple[int, ...]] = {}

    def _look_up(self, word: str) -> tuple[int, ...]:
        found = tuple(self.index[v] for v in voters_of(word, self.stems) if v in self.index)
        if len(self.known) < REMEMBERED:
            self.known[word] = found
        return found

    def votes(self, text: str) -> dict[int, int]:
        """How often each voter that speaks does so."""
        out: dict[int, int] = {}
        known, look_up = self.known, self._look_up
        for word in LETTERS.findall(text.lower()):
            found = known.get(word)
            if found is None:
                found = look_up(word)
            for v in found:
                out[v] = out.get(v, 0) + 1
        return out


def label_model(votes: np.ndarray, given: np.ndarray, rounds: int) -> np.ndarray:
    """Posterior of the toxic class per text, from 0/1 votes and the given 0/1 labels.

    A vote counts as much as it is not repeated by others: its weight is one over the sum of its
    correlations with all votes, taken within the classes.
    """
    votes, given = votes.astype(np.float64), given.astype(np.float64)
    q = 0.05 + 0.9 * given
    weight = np.ones(votes.shape[1])
    for step in range(rounds):
        one, zero = q.sum(), (1 - q).sum()
        prior = np.clip(one / len(q), 1e-4, 1 - 1e-4)
        speak1, speak0 = (votes.T @ q + 0.5) / (one + 1), (votes.T @ (1 - q) + 0.5) / (zero + 1)
        mark1, mark0 = (given @ q + 0.5) / (one + 1), (given @ (1 - q) + 0.5) / (zero + 1)
        if step == 0:
            rest = votes - np.outer(q, speak1) - np.outer(1 - q, speak0)
            size = np.sqrt((rest * rest).sum(0)) + 1e-9
            weight = 1 / np.maximum(1, np.clip(rest.T @ rest / np.outer(size, size), 0, 1).sum(0))
        yes, no = np.log(speak1 / speak0), np.log((1 - speak1) / (1 - speak0))
        logit = np.log(prior / (1 - prior)) + votes @ (weight * (yes - no)) + (weight * no).sum()
        logit += np.where(given > 0, np.log(mark1 / mark0), np.log((1 - mark1) / (1 - mark0)))
        q = 1 / (1 + np.exp(-np.clip(logit, -12, 12)))
    return q


def linear_classifier(x: np.ndarray, q: np.ndarray, ridge: float, steps: int = 12) -> tuple[np.ndarray, float]:
    """Weights and bias of a logistic regression on soft labels, by Newton steps."""
    x = np.hstack([x, np.ones((len(x), 1))])
    penalty = np.full(x.shape[1], ridge * len(x) / 100)
    penalty[-1] = 1e-6
    w = np.zeros(x.shape[1])
    for _ in range(steps):
        p = 1 / (1 + np.exp(-np.clip(x @ w, -30, 30)))
        slope = x.T @ (q - p) - penalty * w
        curve = (x * (p * (1 - p))[:, None]).T @ x + np.diag(penalty + 1e-6)
        move = np.linalg.solve(curve, slope)
        w += np.clip(move, -2, 2)
        if np.abs(move).max() < 1e-6:
            break
    return w[:-1], float(w[-1])


def fit(docs: DataFrame, labels: DataFrame, s: Settings = Settings()) -> Model:
    sample = labelled_sample(docs, labels, s)
    names = tuple(candidate_voters(sample, s))
    if not names:
        return Model((), (), -30.0, s.stems)

    def vote(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        ballot = Ballot(names, s.stems)
        for pdf in batches:
            found = [ballot.votes(t) for t in pdf["text"]]
            yield pd.DataFrame(
                {"label": pdf["label"], "voter": [list(f) for f in found], "times": [list(f.values()) for f in found]}
            )

    rows = sample.mapInPandas(lean(vote), "label int, voter array<int>, times array<int>").collect()
    rows.sort(key=lambda r: (r["label"], r["voter"], r["times"]))
    times = np.zeros((len(rows), len(names)), np.float32)
    for i, r in enumerate(rows):
        times[i, r["voter"]] = r["times"]
    given = np.array([r["label"] for r in rows])
    q = label_model((times > 0).astype(np.float32), given, s.rounds)
    weights, bias = linear_classifier(np.log1p(times).astype(np.float64), q, s.ridge)
    return Model(names, tuple(map(float, weights)), bias, s.stems)


def score(
    docs: DataFrame, model: Model, keep: tuple[str, ...] = ("doc_id",), text_col: str = "text", name: str = "score"
) -> DataFrame:
    """``keep`` columns and ``name``: the probability of the toxic class, from the text alone."""

    def run(batches: Iterator[pd.Series]) -> Iterator[pd.Series]:
        ballot, weights = Ballot(model.names, model.stems), model.weights
        for texts in batches:
            logits = np.array(
                [model.bias + sum(weights[v] * np.log1p(n) for v, n in ballot.votes(t).items()) for t in texts]
            )
            yield pd.Series(1 / (1 + np.exp(-np.clip(logits, -30, 30))), dtype="float64")

    scored = F.pandas_udf(lean(run), "double")
    return docs.select(*keep, scored(F.coalesce(F.col(text_col), F.lit(""))).alias(name))
