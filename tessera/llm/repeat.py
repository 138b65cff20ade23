"""Repetition inside a single document: gradient-boosted trees over document statistics choose what is counted exactly.

Every text gives five statistics that cost no sorting of its five-word runs, each of which grows with repetition: bounds from above on the
repeated word pairs and repeated words for each five-word position (read off a bitmap, so that collisions only raise them), the shares of
repeated sentences and paragraphs, and the length. Trees are fitted with logistic loss on a bounded sample whose exact shares are
known, constrained to never fall as a statistic grows, and flattened to node arrays that numpy walks for a whole batch at once.

Only documents whose score reaches the cut-off have their five-word runs counted. The constraints make the cut-off safe: a position whose five
words have occurred before starts with a word, and with a pair of words, that have occurred before. So of n words a document with
the least share has at least share * (n - 4) repeated ones and as many repeated pairs, and its score is at least that of the
corner case with the least length, these two shares and nothing else. The corner is a part of the sample, as a document that
may be repetitive, so that the trees learn to tell it from what lies below.
"""

from __future__ import annotations

import re
from collections.abc import Iterator
from dataclasses import dataclass

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from tessera.llm.words import Ids, flat_ids, grams
from tessera.session import spread

GRAM, LEAST_WORDS, LEAST_SHARE = 5, 50, 0.3
#: Rows at most that the trees are fitted on, chosen by a random number.
FIT_ROWS = 4_000
FEATURES = ("pair_share", "word_share", "sentence_share", "paragraph_share", "log_words")
#: Texts whose words are held at once.
BATCH = 1000

_SENTENCE, _PARAGRAPH = re.compile(r"[.!?。\n]+"), re.compile(r"\n\s*\n")


def _repeated(parts: list[str]) -> float:
    parts = [x for x in (p.strip() for p in parts) if x]
    return 1 - len(set(parts)) / len(parts) if parts else 0.0


def _owners(bounds: np.ndarray) -> np.ndarray:
    return np.repeat(np.arange(len(bounds) - 1, dtype=np.uint64), np.diff(bounds))


def _distinct(hashes: np.ndarray, bounds: np.ndarray) -> np.ndarray:
    """How many different hashes each text has."""
    owner = _owners(bounds)
    _, first = np.unique(hashes ^ (owner * np.uint64(0xD1B54A32D192ED03)), return_index=True)
    return np.bincount(owner[first].astype(np.int64), minlength=len(bounds) - 1)


def _distinct_at_least(hashes: np.ndarray, bounds: np.ndarray) -> np.ndarray:
    """A bound from below on how many different hashes each text has, without sorting: of those that share a slot one counts."""
    bits = max(10, int(len(hashes) * 8).bit_length())
    owner = _owners(bounds)
    slot = ((hashes ^ (owner * np.uint64(0xD1B54A32D192ED03))) * np.uint64(0x9E3779B97F4A7C15)) >> np.uint64(64 - bits)
    last = np.zeros(1 << bits, np.int32)
    place = np.arange(len(slot), dtype=np.int32)
    last[slot] = place
    return np.bincount(owner[last[slot] == place].astype(np.int64), minlength=len(bounds) - 1)


@dataclass(frozen=True)
class Counted:
    """The words of some texts as ids, with the cheap statistics of each text."""

    flat: np.ndarray
    offsets: np.ndarray
    features: np.ndarray

    @property
    def words(self) -> np.ndarray:
        return np.diff(self.offsets)

    def shares(self, rows: np.ndarray | None = None) -> np.ndarray:
        """The exact share of repeated five-word positions of all texts, or of some."""
        flat, offsets = self.flat, self.offsets
        if rows is not None:
            own = np.zeros(len(self.words), bool)
            own[rows] = True
            flat = flat[np.repeat(own, self.words)]
            offsets = np.concatenate([[0], np.cumsum(self.words[rows])])
        five, bounds = grams(flat, offsets, GRAM)
        positions = np.diff(bounds)
        return (positions - _distinct(five, bounds)) / np.maximum(positions, 1)


def counted(texts: list[str | None], ids: Ids) -> Counted:
    """Null texts count as empty."""
    flat, offsets = flat_ids(texts, ids)
    pairs, bounds = grams(flat, offsets, 2)
    n, pair_n = np.diff(offsets), np.diff(bounds)
    positions = np.maximum(n - GRAM + 1, 1)
    features = np.column_stack(
        [
            (pair_n - _distinct_at_least(pairs, bounds)) / positions,
            (n - _distinct_at_least(flat, offsets)) / positions,
            [_repeated(_SENTENCE.split(t)) if t else 0.0 for t in texts],
            [_repeated(_PARAGRAPH.split(t)) if t else 0.0 for t in texts],
            np.log1p(n),
        ]
    ).astype(np.float64)
    return Counted(flat, offsets, features)


def corner(least_share: float, least_words: int) -> np.ndarray:
    """What a document with that share and length has at least of each statistic."""
    return np.array([[least_share, least_share, 0.0, 0.0, np.log1p(least_words)]]) - 1e-9


@dataclass(frozen=True)
class Trees:
    """All nodes of all trees in flat arrays. feature -1 marks a leaf; roots has the first node of each tree."""

    feature: np.ndarray
    threshold: np.ndarray
    left: np.ndarray
    right: np.ndarray
    value: np.ndarray
    roots: np.ndarray
    base: float

    def score(self, x: np.ndarray) -> np.ndarray:
        """Log-odds of every row."""
        total = np.full(len(x), self.base)
        rows = np.arange(len(x))
        for root in self.roots:
            at = np.full(len(x), root)
            while (inner := self.feature[at] >= 0).any():
                own = at[inner]
                down = x[rows[inner], self.feature[own]] >= self.threshold[own]
                at[inner] = np.where(down, self.right[own], self.left[own])
            total += self.value[at]
        return total


def fit(x: np.ndarray, y: np.ndarray, trees: int = 30, depth: int = 3, rate: float = 0.3, bins: int = 64, ridge: float = 1.0, rising: tuple[int, ...] = tuple(range(len(FEATURES))), also: np.ndarray | None = None) -> Trees:
    """Boosting with logistic loss over histograms. ``rising``: the features in which the score must never fall. ``also``: rows at whose values trees may split."""
    share = np.clip(y.mean() if len(y) else 0.5, 1e-3, 1 - 1e-3)
    base = float(np.log(share / (1 - share)))
    nodes: list[list] = []
    roots: list[int] = []
    edges = [np.unique(np.quantile(x[:, f], np.linspace(0, 1, bins + 1)[1:-1])) if len(x) else np.zeros(0) for f in range(x.shape[1])]
    if also is not None:
        edges = [np.union1d(e, also[:, f]) for f, e in enumerate(edges)]
    binned = np.column_stack([np.searchsorted(e, x[:, f], side="right") for f, e in enumerate(edges)]) if len(x) else np.zeros(x.shape, int)

    def grow(rows: np.ndarray, level: int, low: float, high: float) -> int:
        me = len(nodes)
        g, h = grad[rows].sum(), hess[rows].sum()
        nodes.append([-1, 0.0, -1, -1, float(np.clip(-rate * g / (h + ridge), low, high))])
        best = (1e-6, None)
        if level < depth and len(rows) >= 8:
            for f, e in enumerate(edges):
                if not len(e):
                    continue
                gl = np.cumsum(np.bincount(binned[rows, f], grad[rows], len(e) + 1))[:-1]
                hl = np.cumsum(np.bincount(binned[rows, f], hess[rows], len(e) + 1))[:-1]
                gain = gl**2 / (hl + ridge) + (g - gl) ** 2 / (h - hl + ridge) - g**2 / (h + ridge)
                if f in rising:
                    gain[-gl / (hl + ridge) > -(g - gl) / (h - hl + ridge)] = 0
                k = int(np.argmax(gain))
                if gain[k] > best[0]:
                    best = (gain[k], (f, k, -rate * gl[k] / (hl[k] + ridge), -rate * (g - gl[k]) / (h - hl[k] + ridge)))
        if best[1]:
            f, k, vl, vr = best[1]
            middle = float(np.clip((vl + vr) / 2, low, high))
            down = binned[rows, f] > k
            bound = (low, middle, middle, high) if f in rising else (low, high, low, high)
            nodes[me][:2] = [f, float(edges[f][k])]
            nodes[me][2] = grow(rows[~down], level + 1, *bound[:2])
            nodes[me][3] = grow(rows[down], level + 1, *bound[2:])
        return me

    score = np.full(len(x), base)
    flat = None
    for _ in range(trees if len(x) else 0):
        p = 1 / (1 + np.exp(-score))
        grad, hess = p - y, p * (1 - p)
        first = len(nodes)
        roots.append(grow(np.arange(len(x)), 0, -np.inf, np.inf))
        flat = Trees(*(np.array([n[i] for n in nodes]) for i in range(5)), np.array([first]), 0.0)
        score = score + flat.score(x)
    if flat is None:
        return Trees(np.array([-1]), np.zeros(1), np.array([-1]), np.array([-1]), np.zeros(1), np.array([0]), base)
    return Trees(flat.feature, flat.threshold, flat.left, flat.right, flat.value, np.array(roots), base)


def fitted(df: DataFrame, key: str, text: str, least_share: float, least_words: int, fit_rows: int) -> tuple[Trees, float]:
    """(trees, cut-off), fitted on at most ``fit_rows`` rows. A row is taken by a random number of its own, so no task sends more than its part."""
    rows = df.select(F.col(text).alias("__text"))
    n = rows.count()
    share = min(1.0, 0.8 * fit_rows / max(n, 1))

    def exact(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        ids = Ids()
        for b in batches:
            c = counted(b.column(0).to_pylist(), ids)
            columns = [pa.array(c.features[:, f]) for f in range(len(FEATURES))]
            yield pa.RecordBatch.from_arrays([*columns, pa.array(c.shares()), pa.array(c.words)], names=[*FEATURES, "share", "words"])

    chosen = rows.filter(F.rand(20240901) < share) if share < 1 else rows
    schema = ", ".join(f"{f} double" for f in FEATURES) + ", share double, words bigint"
    sample = spread(chosen).mapInArrow(exact, schema).limit(fit_rows).toPandas()
    x = sample[list(FEATURES)].to_numpy(np.float64).reshape(-1, len(FEATURES))
    y = ((sample["share"] >= least_share) & (sample["words"] >= least_words)).to_numpy(np.float64)
    case = corner(least_share, least_words)
    cases = np.repeat(case, max(8, len(x) // 10), axis=0)
    trees = fit(np.concatenate([x, cases]), np.concatenate([y, np.ones(len(cases))]), also=case)
    return trees, float(trees.score(case)[0]) - 1e-9


def repetition(
    df: DataFrame, key: str, text: str = "text", least_share: float = LEAST_SHARE, least_words: int = LEAST_WORDS, fit_rows: int = FIT_ROWS
) -> DataFrame:
    """(key, words, score, candidate, share): one row for each row of ``df``.

    score: log-odds by the trees that the document has at least ``least_words`` words and ``least_share`` of repeated five-word positions.
    candidate: the score reaches the cut-off, which no such document can miss. share: of all positions at which five consecutive words
    start, the part whose five words have occurred before in the document; only counted for candidates, else null. Null
    and empty texts have no words. Statistics cover whole texts, which are read once; the sample is taken and the trees are fitted while
    the query is built.
    """
    trees, cutoff = fitted(df, key, text, least_share, least_words, fit_rows)
    rows = df.select(F.col(key), F.col(text).alias("__text"))

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        ids = Ids()
        for b in batches:
            for lo in range(0, b.num_rows, BATCH):
                part = b.slice(lo, BATCH)
                c = counted(part.column(1).to_pylist(), ids)
                score = trees.score(c.features)
                candidate = (score >= cutoff) & (c.words >= least_words)
                at = np.flatnonzero(candidate)
                share = np.full(part.num_rows, np.nan)
                share[at] = c.shares(at)
                yield pa.RecordBatch.from_arrays(
                    [part.column(0), pa.array(c.words), pa.array(score), pa.array(candidate), pa.array(share, from_pandas=True)], names=[key, "words", "score", "candidate", "share"]
                )

    return spread(rows).mapInArrow(run, f"`{key}` {rows.schema[0].dataType.simpleString()}, words bigint, score double, candidate boolean, share double")


def shares(df: DataFrame, key: str, text: str = "text") -> DataFrame:
    """(key, words, share): the exact share of every row, without trees; 0 for texts without five words, also null and empty ones."""
    rows = df.select(F.col(key), F.col(text).alias("__text"))

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        ids = Ids()
        for b in batches:
            for lo in range(0, b.num_rows, BATCH):
                part = b.slice(lo, BATCH)
                flat, offsets = flat_ids(part.column(1).to_pylist(), ids)
                own = Counted(flat, offsets, np.zeros((part.num_rows, 0)))
                yield pa.RecordBatch.from_arrays([part.column(0), pa.array(own.words), pa.array(own.shares())], names=[key, "words", "share"])

    return spread(rows).mapInArrow(run, f"`{key}` {rows.schema[0].dataType.simpleString()}, words bigint, share double")
