"""Evaluation items that leak into a corpus: BM25 inverted index of the items, block-max WAND, exact verification.

The items are the indexed documents, the corpus supplies the queries: passages that begin every SPAN words and hold all runs of ``run``
consecutive words that begin in these. A term's postings are the items that have it, in ascending order, cut into blocks of BLOCK postings; each block
keeps the greatest BM25 weight in it. The threshold of an item is the least BM25 score that any run of ``run`` of its own words has,
so no passage that holds such a run scores below it.

Passages go through WAND together, a cursor for each of their words: cursors are ordered by their current item, the first place at which the
terms' greatest weights add up to the threshold of its item is the pivot, and cursors before it skip forward; items are numbered by
rising threshold, so none that is skipped could have reached its own. Where all cursors up to the pivot stand on its item, the
blocks' greatest weights must still reach the threshold, and only then the item's score is summed up and held against it. What
remains is compared word by word.

The index is as large as the items, so it travels with the task, in parts of INDEX_BYTES at most, and nothing of the corpus is shuffled.
"""

from __future__ import annotations

from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F
from pyspark.sql.pandas.types import to_arrow_type

from tessera.llm.words import words
from tessera.session import spread

RUN, BLOCK, K1, B = 13, 64, 1.2, 0.75
#: Bytes of one index at most, by an estimate of INDEX_WORD bytes a word; items beyond are searched for in another pass.
INDEX_BYTES, INDEX_WORD = 64 << 20, 160
#: Positions at which a run may begin that are one passage.
SPAN = 4
#: Passages that go through WAND together.
TOGETHER = 4_000
_END = 1 << 40


class Index:
    """Postings with BM25 weights and block maxima, thresholds, and the words of the items."""

    def __init__(self, items: list[tuple[object, str | None]], run: int = RUN, block: int = BLOCK):
        own = [(i, w) for i, t in items if len(w := words(t)) >= run]
        self.run, self.block = run, block
        self.vocabulary: dict[str, int] = {}
        for _, w in own:
            for x in w:
                self.vocabulary.setdefault(x, len(self.vocabulary))
        at = [np.array([self.vocabulary[x] for x in w], np.int64) for _, w in own]
        # items are numbered by rising threshold, so what a cursor has still to come asks for at least as much as where it stands
        order = np.argsort(self._thresholds(at), kind="stable")
        self.ids, at = [own[j][0] for j in order], [at[j] for j in order]
        self._post(at)
        self.threshold = np.append(self._thresholds(at), np.inf)
        self.least = float(self.threshold[0])
        starts = np.concatenate([np.arange(a, b - run + 1) for a, b in zip(self.starts[:-1], self.starts[1:])] or [np.zeros(0, np.int64)])
        owner = np.searchsorted(self.starts, starts, side="right") - 1
        keys = self._hashed(self.flat, starts) ^ owner.astype(np.uint64) * np.uint64(0xD1B54A32D192ED03)
        order = np.argsort(keys, kind="stable")
        #: the items' runs of words by hash and item, and where each begins
        self.run_key, self.run_at = keys[order], starts[order]
        self.evaluated = self.passages = self.rounds = 0

    def _post(self, at: list[np.ndarray]) -> None:
        """The postings of items given as arrays of term numbers."""
        n, terms = len(at), len(self.vocabulary)
        self.starts = np.concatenate([[0], np.cumsum([len(a) for a in at])]).astype(np.int64)
        self.flat = np.concatenate(at) if at else np.zeros(0, np.int64)
        owner = np.repeat(np.arange(n), np.diff(self.starts))
        keys, tf = np.unique(self.flat * max(n, 1) + owner, return_counts=True)  # by term, then item
        term, self.item = keys // max(n, 1), keys % max(n, 1)
        df = np.bincount(term, minlength=terms)
        size = np.diff(self.starts)
        idf = np.log(1 + (n - df + 0.5) / (df + 0.5))
        self.weight = idf[term] * tf * (K1 + 1) / (tf + K1 * (1 - B + B * size[self.item] / max(size.mean() if n else 1, 1)))
        #: a posting's place by term and item; a term without postings closes the list for unknown words
        self.first = np.concatenate([[0], np.cumsum(df), [len(keys)]])
        self.key = term * _END + self.item
        self.most = np.array([self.weight[a:b].max() for a, b in zip(self.first[:-2], self.first[1:-1])] + [0.0])
        # blocks never span two terms
        place = np.arange(len(keys)) - self.first[term]
        opens = place % self.block == 0
        self.block_of = np.cumsum(opens) - 1
        self.block_most = np.maximum.reduceat(self.weight, np.flatnonzero(opens)) if len(keys) else np.zeros(0)
        ends = np.append(np.flatnonzero(opens)[1:], len(keys)) - 1
        self.block_last = self.item[ends] if len(keys) else np.zeros(0, np.int64)

    def _thresholds(self, at: list[np.ndarray]) -> np.ndarray:
        self._post(at)
        out = np.full(len(at), np.inf)
        for j, a in enumerate(at):
            own = dict(zip(a.tolist(), self.weight[np.searchsorted(self.key, a * _END + j)].tolist()))
            for k in range(len(a) - self.run + 1):
                out[j] = min(out[j], sum(own[x] for x in set(a[k : k + self.run].tolist())))
        return out - 1e-6  # sums in another order

    def nbytes(self) -> int:
        return sum(v.nbytes for v in vars(self).values() if isinstance(v, np.ndarray)) + 100 * len(self.vocabulary)

    def wand(self, terms: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
        """(passage, item): every item whose score for the passage's different terms reaches its threshold. A row of ``terms`` is a passage."""
        unknown = len(self.vocabulary)
        terms = np.sort(terms, axis=1)
        terms[:, 1:][terms[:, 1:] == terms[:, :-1]] = unknown  # a repeated word counts once
        alive = np.arange(len(terms))
        cursor, end = self.first[terms], self.first[terms + 1]
        bound = self.most[terms]
        pad = np.append(self.item, _END)
        column = np.arange(terms.shape[1])
        out_p, out_i = [], []
        self.passages += len(terms)
        while len(alive):
            now = np.where(cursor < end, pad[np.minimum(cursor, len(self.item))], _END)
            packed = np.sort(now << 16 | column, axis=1)  # by item, with the cursor's column
            order, sorted_now = packed & 0xFFFF, packed >> 16
            upper = np.cumsum(np.where(sorted_now < _END, np.take_along_axis(bound, order, 1), 0.0), axis=1)
            reach = upper >= self.threshold[np.minimum(sorted_now, len(self.ids))]
            go = reach.any(axis=1)
            self.rounds += len(alive)
            if not go.all():  # no pivot: the passage is done
                alive, cursor, end, bound, terms = alive[go], cursor[go], end[go], bound[go], terms[go]
                now, sorted_now, reach = now[go], sorted_now[go], reach[go]
                if not len(alive):
                    break
            rows = np.arange(len(alive))
            pivot = sorted_now[rows, reach.argmax(axis=1)]
            behind = now < pivot[:, None]  # cursors that skip to the pivot's item
            on = now == pivot[:, None]
            met = ~behind.any(axis=1)
            # everything up to the pivot stands on its item: the blocks decide whether it is scored
            held = on & met[:, None]
            block = np.where(held, self.block_of[np.minimum(cursor, len(self.item) - 1)], 0)
            block_sum = np.where(held, self.block_most[block], 0.0).sum(axis=1)
            score_it = met & (block_sum >= self.threshold[pivot])
            if score_it.any():
                i = np.flatnonzero(score_it)
                self.evaluated += len(i)
                score = np.where(on[i], self.weight[np.minimum(cursor[i], len(self.item) - 1)], 0.0).sum(axis=1)
                good = score >= self.threshold[pivot[i]]
                out_p.append(alive[i[good]])
                out_i.append(pivot[i[good]])
            # a refused passage goes behind the nearest end of its blocks, or to the next cursor's item if that comes first
            last = np.where(held, self.block_last[block], _END).min(axis=1)
            following = np.where(now > pivot[:, None], now, _END).min(axis=1)
            target = np.where(score_it, pivot + 1, np.where(met, np.minimum(last + 1, following), pivot))
            move = now < target[:, None]
            r, c = np.nonzero(move)
            cursor[r, c] = np.minimum(np.searchsorted(self.key, terms[r, c] * _END + target[r]), end[r, c])
        return (np.concatenate(out_p), np.concatenate(out_i)) if out_p else (np.zeros(0, np.int64), np.zeros(0, np.int64))

    def _hashed(self, v: np.ndarray, at: np.ndarray) -> np.ndarray:
        h = np.zeros(len(at), np.uint64)
        for k in range(self.run):
            h = (h ^ v[at + k].astype(np.uint64)) * np.uint64(0x9E3779B97F4A7C15)
            h ^= h >> np.uint64(29)
        return h

    def holds(self, v: np.ndarray, at: np.ndarray, item: np.ndarray) -> np.ndarray:
        """Whether the item has the words v[at : at + run] one after another, by hash and then word by word."""
        key = self._hashed(v, at) ^ item.astype(np.uint64) * np.uint64(0xD1B54A32D192ED03)
        place = np.minimum(np.searchsorted(self.run_key, key), len(self.run_key) - 1)
        found = self.run_key[place] == key
        for k in range(self.run):
            found &= v[at + k] == self.flat[np.minimum(self.run_at[place] + k, len(self.flat) - 1)]
        return found

    def leaks(self, texts: list) -> list[tuple[int, object]]:
        """(position of the text, item id), each once."""
        get, unknown, run = self.vocabulary.get, len(self.vocabulary), self.run
        flat: list[int] = []
        owner: list[int] = []
        ends: list[int] = []
        for i, t in enumerate(texts):
            w = words(t)
            if len(w) >= run:
                flat.extend([get(x, unknown) for x in w])
                flat.append(unknown)  # keeps texts apart
                ends.append(len(flat))
                owner.append(i)
        if not flat or not self.ids:
            return []
        v = np.array(flat + [unknown] * (run + SPAN), np.int64)
        known = np.concatenate([[0], np.cumsum(v != unknown)])
        sums = np.concatenate([[0.0], np.cumsum(self.most[v])])
        # an unknown word ends every run; where all weights at their greatest stay below the least threshold there is no pivot
        at = np.flatnonzero((known[run:] - known[:-run] == run) & (sums[run:] - sums[:-run] >= self.least - 1e-6))
        cells, first = np.unique(at // SPAN, return_index=True)
        last = np.append(first[1:], len(at))
        found: set[tuple[int, object]] = set()
        for lo in range(0, len(cells), TOGETHER):
            own = cells[lo : lo + TOGETHER]
            passage, item = self.wand(v[own[:, None] * SPAN + np.arange(run + SPAN - 1)])
            n = (last - first)[lo + passage]
            where = at[np.repeat(first[lo + passage] - np.cumsum(n) + n, n) + np.arange(n.sum())]
            item = np.repeat(item, n)
            ok = self.holds(v, where, item)
            text = np.searchsorted(ends, where[ok], side="right")
            found.update((owner[t], self.ids[j]) for t, j in set(zip(text.tolist(), item[ok].tolist())))
        return sorted(found, key=lambda x: (x[0], str(x[1])))


def leaked_items(docs: DataFrame, items: DataFrame, doc_key: str = "doc_id", item_key: str = "item_id", text: str = "text", run: int = RUN) -> DataFrame:
    """(doc_key, item_key), each pair once: the document holds at least ``run`` consecutive words of the item.

    Null and empty texts, and items of fewer than ``run`` words, are in no pair. Items with equal texts all appear. Repeated rows
    count once. Columns other than the named ones are never read, so clashing names don't matter. The driver reads the items one by one
    while the query is built and holds those of one index at a time; an index is INDEX_BYTES at most, and the corpus is passed over once
    for each, so once for items of some 400,000 words.
    """
    spark = docs.sparkSession
    rows = spread(docs.select(F.col(doc_key), F.col(text).alias("__text")))
    source = items.select(item_key, text).filter(F.col(text).isNotNull() & F.col(item_key).isNotNull()).distinct()
    key_type = items.schema[item_key].dataType
    schema = f"`{doc_key}` {rows.schema[0].dataType.simpleString()}, `{item_key}` {key_type.simpleString()}"
    empty = spark.createDataFrame([], schema)
    parts: list[DataFrame] = []

    def search(held: list) -> None:
        index = spark.sparkContext.broadcast(Index(held, run))

        def find(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
            for b in batches:
                for lo in range(0, b.num_rows, 1000):
                    part = b.slice(lo, 1000)
                    found = index.value.leaks(part.column(1).to_pylist())
                    taken = part.column(0).take(pa.array([i for i, _ in found], pa.int64()))
                    yield pa.RecordBatch.from_arrays([taken, pa.array([x for _, x in found], kind)], names=[doc_key, item_key])

        parts.append(rows.mapInArrow(find, schema))

    kind = to_arrow_type(key_type)
    held: list = []
    size = 0
    for r in source.toLocalIterator():
        cost = INDEX_WORD * (1 + r[1].count(" "))
        if held and size + cost > INDEX_BYTES:
            search(held)
            held, size = [], 0
        held.append((r[0], r[1]))
        size += cost
    if held:
        search(held)
    out = parts[0] if parts else empty
    for p in parts[1:]:
        out = out.unionByName(p)
    return out.distinct()
