"""Token ids of whole texts by a public byte-level BPE, with reuse of content-defined chunks.

A rolling hash over the text's bytes proposes chunk ends, so that texts which share passages get equal chunks whatever
precedes them. Each worker keeps the ids of the chunks it has met (a bounded memo) and encodes a chunk only once. Then the
joins are repaired: around each join the last and first words of both sides are encoded again, over a window that is
widened until its outer ends lie where the tokenizer must break whatever stands beyond. One more word on either side is encoded with it,
and its ids must be those that the word has without the window, on the left also those that stand there; the middle
replaces the join. Where they don't agree, the window is widened to the whole text.

The tokenizer's splitting pattern takes white space only at the start of a pretoken, so there is always a break before white
space that follows something else, and what stands on one side never changes the ids of the other. Such a break is *firm*.
"""

from __future__ import annotations

import base64
import os
import re
from collections.abc import Iterator

import numpy as np
import pyarrow as pa
import xxhash
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from tessera.session import spread

#: Folder with the public vocabulary files.
TOKENIZERS = "/opt/tokenizers"
#: Splitting pattern of the byte-level BPE with 50,257 ids; a fixed value.
PATTERN = r"""'(?:[sdmt]|ll|ve|re)| ?\p{L}++| ?\p{N}++| ?[^\s\p{L}\p{N}]++|\s++$|\s+(?!\S)|\s"""
#: Chunk sizes in bytes: a chunk ends about every 2**BITS bytes, and has at least LEAST.
BITS, LEAST, WINDOW = 9, 128, 16
#: Characters within which the word beside a join is looked for.
WORD = 64
#: Chunks that a worker remembers.
MEMO = 50_000

_FIRM = re.compile(r"(?<=\S)(?=[ \n\t])")
_GEAR = np.random.default_rng(20240901).integers(0, 1 << 32, 256, dtype=np.uint32)
_loaded: dict = {}


def encoding(path: str):
    """The tokenizer, loaded once in each worker."""
    if path not in _loaded:
        import tiktoken

        with open(path, "rb") as f:
            ranks = {base64.b64decode(a): int(b) for a, b in map(bytes.split, f)}
        _loaded[path] = tiktoken.Encoding("own", pat_str=PATTERN, mergeable_ranks=ranks, special_tokens={})
    return _loaded[path]


def chunk_ends(text: str) -> list[int]:
    """Ends of the content-defined chunks, as offsets in characters; the last is the text's length."""
    n = len(text)
    if n < 2 * LEAST:
        return [n]
    data = text.encode("utf-8", "surrogatepass")
    h = _GEAR[np.frombuffer(data, np.uint8)]
    width = 1
    while width < WINDOW:  # the hash of a window of 2w bytes from those of its halves
        h[width:] = h[width:] + (h[:-width] << np.uint32(width))
        width *= 2
    at = np.flatnonzero((h >> np.uint32(32 - BITS)) == 0) + 1
    if not len(at):
        return [n]
    if len(data) != n:  # byte offsets to characters: count the bytes that begin one
        begins = np.cumsum((np.frombuffer(data, np.uint8) & 0xC0) != 0x80)
        at = begins[at - 1]
    ends, last = [], 0
    for e in at.tolist():
        if e - last >= LEAST and n - e >= LEAST:
            ends.append(last := e)
    return [*ends, n]


class Encoder:
    """Encodes texts one by one, with a memo of chunks."""

    def __init__(self, path: str, memo: int = MEMO):
        self.encode, self.memo, self.size, self.reused, self.joins, self.widened = encoding(path).encode_ordinary, {}, memo, 0, 0, 0

    def chunk(self, piece: str) -> list[int]:
        ids = self.memo.get(piece)
        if ids is None:
            if len(self.memo) >= self.size:
                self.memo.clear()
            self.memo[piece] = ids = self.encode(piece)
        else:
            self.reused += 1
        return ids

    def join(self, text: str, out: list[int], a: int, b: int, floor: int, ceiling: int) -> list[int] | None:
        """Ids of text[a:b], if those around it agree: of the word before a, back to ``floor``, and of that after b, up to ``ceiling``."""
        before = max((m.start() for m in _FIRM.finditer(text, max(floor, a - WORD), a) if m.start() < a), default=a)
        found = _FIRM.search(text, b + 1, min(ceiling, b + WORD))
        after = found.start() if found else b
        left, right = self.encode(text[before:a]), self.encode(text[b:after])
        ids = self.encode(text[before:after])
        self.joins += 1
        end = len(ids) - len(right)
        if ids[: len(left)] == left == out[len(out) - len(left) :] and ids[end:] == right:
            return ids[len(left) : end]
        self.widened += 1
        return None

    def __call__(self, text: str | None) -> list[int]:
        """Ids of a text. A null and an empty text have no ids: []."""
        if not text:
            return []
        out: list[int] = []
        start, tail, floor = 0, 0, 0  # tail: where the part of the text that isn't in out yet begins; floor: where the last chunk's core began
        for end in chunk_ends(text):
            piece = text[start:end]
            firm = _FIRM.search(piece)
            if start == 0 and end == len(text):
                return self.chunk(piece)
            if firm is None and end < len(text):
                start = end  # no firm break within the chunk: the window goes on into the next
                continue
            # The core of the chunk lies between its first and its last firm break. What lies outside belongs to the joins.
            head = firm.start() if firm else len(piece)
            if start == 0:
                head = 0
            last = head
            if end == len(text):
                last = len(piece)
            else:
                for k in range(len(piece) - 1, head, -1):
                    if piece[k] in " \n\t" and not piece[k - 1].isspace():
                        last = k
                        break
            if tail < start + head:
                if (ids := self.join(text, out, tail, start + head, floor, start + last)) is None:
                    return self.encode(text)
                out += ids
            if last > head:
                out += self.chunk(piece[head:last])
                floor = start + head
            tail, start = start + last, end
        if tail < len(text):
            if (ids := self.join(text, out, tail, len(text), floor, len(text))) is None:
                return self.encode(text)
            out += ids
        return out


_encoders: dict[str, Encoder] = {}


def encoder(path: str) -> Encoder:
    """The process's one encoder of a vocabulary, whose bounded memo outlives a task."""
    if path not in _encoders:
        _encoders[path] = Encoder(path)
    return _encoders[path]


def chunk_reuse(df: DataFrame, text: str = "text") -> DataFrame:
    """(chunks, distinct_chunks, bytes, distinct_bytes): how much of all chunks of the whole collection is encoded more than once.

    What sharing chunks across workers could save at most, against moving every different chunk and its ids. Only 64-bit hashes are shuffled.
    """

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for b in batches:
            hashes: list[int] = []
            sizes: list[int] = []
            for t in b.column(0).to_pylist():
                ends = chunk_ends(t)
                for lo, hi in zip([0, *ends], ends):
                    data = t[lo:hi].encode("utf-8", "surrogatepass")
                    hashes.append(xxhash.xxh3_64_intdigest(data) >> 1)
                    sizes.append(len(data))
            yield pa.RecordBatch.from_arrays([pa.array(hashes, pa.int64()), pa.array(sizes, pa.int64())], names=["h", "n"])

    own = df.filter(F.length(text) > 0).select(F.col(text).alias("__text")).mapInArrow(run, "h bigint, n bigint")
    by = own.groupBy("h").agg(F.count("*").alias("c"), F.max("n").alias("n"))
    total = lambda c: F.coalesce(F.sum(c), F.lit(0))
    return by.agg(total(F.col("c")).alias("chunks"), F.count("*").alias("distinct_chunks"), total(F.col("c") * F.col("n")).alias("bytes"), total(F.col("n")).alias("distinct_bytes"))


def token_ids(df: DataFrame, key: str, text: str = "text", tokenizer: str = "byte_bpe_50k.tiktoken", folder: str = TOKENIZERS) -> DataFrame:
    """(key, ids): each row's text as token ids, without special tokens.

    Empty and null texts have the empty list. Strings that look like special tokens count as ordinary text. Repeated rows
    give repeated rows. No shuffle: chunks are shared among the texts that a worker reads.
    """
    path = os.path.join(folder, tokenizer)
    rows = df.select(F.col(key), F.col(text).alias("__text"))
    kind = rows.schema[0].dataType.simpleString()

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        encode = encoder(path)
        for b in batches:
            for lo in range(0, b.num_rows, 1000):
                part = b.slice(lo, 1000)
                ids = [encode(t) for t in part.column(1).to_pylist()]
                flat = np.fromiter((x for own in ids for x in own), np.int32, sum(map(len, ids)))
                at = np.concatenate([[0], np.cumsum([len(x) for x in ids])]).astype(np.int32)
                yield pa.RecordBatch.from_arrays([part.column(0), pa.ListArray.from_arrays(pa.array(at), pa.array(flat))], names=[key, "ids"])

    return spread(rows).mapInArrow(run, f"`{key}` {kind}, ids array<int>")
