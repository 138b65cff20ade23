"""Splitting oversized texts at natural boundaries by dynamic programming over boundary positions.

State: the start of a piece. Choice: its end among the boundaries in [start + limit/2, start + limit], or the hard
end start + limit if the window has no boundary. Cost of a piece: the penalty of its boundary's kind, plus its
imbalance (the share of the limit left unused). The value of a start is the least cost of a piece from there plus
``lookahead`` times the value of the next start, which lies ``overlap`` before the chosen end:

    value(s) = min over e of  penalty(kind(e)) + (limit - (e - s)) / limit + lookahead * value(e - overlap)

``lookahead`` = 0 makes the order of the cuts lexicographic: the best kind, then the largest end, decides each cut.
``lookahead`` = 1 minimises the sum over the text. The minimum over each window is kept in a monotone queue, so the work is linear
in the boundaries.
"""

from __future__ import annotations

from bisect import bisect_left, bisect_right
from collections import deque
from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from tessera.session import spread

LIMIT, OVERLAP = 1400, 200
#: Penalty of each kind of boundary: paragraph, sentence, blank, none. A step is larger than any imbalance.
PENALTY = (0.0, 1.0, 2.0, 3.0)

_NL, _BLANKS, _STOPS, _CJK_STOP = 10, (32, 9, 10), tuple(map(ord, ".;:!?")), 0x3002
_CHUNK = 1 << 22


def boundaries(text: str) -> tuple[np.ndarray, np.ndarray]:
    """Positions at which a piece may end, ascending, and the kind (0, 1, 2) of each."""
    c = np.frombuffer(text.encode("utf-32-le", "surrogatepass"), np.uint32)
    before = np.concatenate([[0], c[:-1]]).astype(np.uint32)
    newline, blank = c == _NL, np.isin(c, _BLANKS)
    kind = np.full(len(c), 3, np.int8)
    kind[blank] = 2
    kind[(blank & np.isin(before, _STOPS)) | (c == _CJK_STOP)] = 1
    kind[newline & (before == _NL)] = 0
    at = np.flatnonzero(kind < 3)
    return at + 1, kind[at]


def cut(text: str, limit: int = LIMIT, overlap: int = OVERLAP, lookahead: float = 0.0) -> list[tuple[int, int]]:
    """Spans of the pieces of one text; [] for a text within the limit."""
    n, least = len(text), limit // 2
    if n <= limit:
        return []
    ends, kinds = boundaries(text)
    return _least_total(n, ends.tolist(), kinds.tolist(), limit, overlap, least, lookahead)


def _least_total(n: int, ends: list[int], kinds: list[int], limit: int, overlap: int, least: int, lookahead: float) -> list[tuple[int, int]]:
    # starts that can be reached: 0, overlap before each boundary, and the hard cuts where a window has none
    starts, pending = set(), [0] + [e - overlap for e in ends if e > overlap]
    while pending:
        s = pending.pop()
        if s in starts:
            continue
        starts.add(s)
        if n - s > limit and bisect_left(ends, s + least) == bisect_right(ends, s + limit):
            pending.append(s + limit - overlap)
    value: dict[int, tuple[float, int]] = {}
    queue: deque[tuple[float, int]] = deque()  # (cost of ending here, end), costs rising from right to left
    i = len(ends) - 1
    for s in sorted(starts, reverse=True):
        if n - s <= limit:
            value[s] = ((limit - (n - s)) / limit, n)
            continue
        while i >= 0 and ends[i] >= s + least:
            e = ends[i]
            i -= 1
            if e - overlap not in value:
                continue
            cost = PENALTY[kinds[i + 1]] - e / limit + lookahead * value[e - overlap][0]
            while queue and queue[-1][0] > cost:
                queue.pop()
            queue.append((cost, e))
        while queue and queue[0][1] > s + limit:
            queue.popleft()
        if queue:
            cost, e = queue[0]
        else:
            e = s + limit
            cost = PENALTY[3] - e / limit + lookahead * value[e - overlap][0]
        value[s] = (cost + (limit + s) / limit, e)
    spans, s = [], 0
    while True:
        e = value[s][1]
        spans.append((s, e))
        if e == n:
            return spans
        s = e - overlap


def split_oversized(
    df: DataFrame, key: str, text: str | Column = "text", keep: tuple[str, ...] = (), limit: int = LIMIT, overlap: int = OVERLAP, lookahead: float = 0.0
) -> DataFrame:
    """(key, *keep, char_start, char_end): the pieces of every text longer than ``limit`` code points.

    Texts that are null, empty or within the limit give no row. Offsets are code points, ends exclusive. Repeated
    rows give their pieces once each. One row is cut in one task; no shuffle. ``overlap`` must be under half the limit.
    """
    if not 0 <= overlap < limit // 2:
        raise ValueError("overlap must lie between 0 and half the limit")
    long = df.select(F.col(key), *keep, F.col(text).alias("__text") if isinstance(text, str) else text.alias("__text")).filter(F.length("__text") > limit)
    schema = ", ".join(f"`{f.name}` {f.dataType.simpleString()}" for f in long.schema.fields[:-1]) + ", char_start bigint, char_end bigint"

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for b in batches:
            rows, spans = [], []
            for i, t in enumerate(b.column(b.num_columns - 1)):
                own = cut(t.as_py(), limit, overlap, lookahead)
                rows += [i] * len(own)
                spans += own
            taken = b.drop_columns(["__text"]).take(pa.array(rows, pa.int64()))
            at = np.array(spans, np.int64).reshape(-1, 2)
            yield pa.RecordBatch.from_arrays([*taken.columns, pa.array(at[:, 0]), pa.array(at[:, 1])], names=[*taken.schema.names, "char_start", "char_end"])

    return spread(long).mapInArrow(run, schema)
