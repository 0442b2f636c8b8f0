"""Packing documents into sequences of at most ``window`` tokens, order kept.

The documents of a Spark partition, in their order, form one stream of tokens,
worked on in blocks of about ``block_tokens`` that end with a document.  Cuts
may fall at a document's end for nothing, at a sentence's end for
``SENTENCE_COST``, or within a long sentence, at every ``GRID`` tokens, for
``CUT_COST``.  With the cuts x_0 < x_1 < ... the least cost up to a cut is

    f(k) = cost(k) + min { f(i) + window - (x_k - x_i) :  x_k - x_i <= window }

The bracket is window - x_k plus the least of f(i) + x_i over a sliding window,
which a monotone queue gives in constant time.  A block's last stretch may
instead be split into lengths that are powers of two, which need no padding.

No shuffle: a document stays in the task that read it, and a lost task gives
the same sequences again.  A sequence's id is the partition's number and a
count within it.

Defined results: a null or empty text is the closing id alone.  Repeated rows
are packed each time.  Documents longer than a window span several.
"""

from __future__ import annotations

import zlib
from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark import TaskContext
from pyspark.sql import DataFrame
from pyspark.sql import functions as F
from pyspark.sql import types as T

from canopy.llm.tokens import TOKENIZER, encoder, tokenizer_path
from canopy.session import ship_code

WINDOW = 2048
CLOSING_ID = 1
BLOCK_TOKENS = 1 << 20
SENTENCE_COST, CUT_COST, GRID = 1, 12, 32
SENTENCE_ENDS = (".</w>", "!</w>", "?</w>")

SCHEMA = T.StructType([
    T.StructField("doc_id", T.LongType()), T.StructField("start", T.LongType()), T.StructField("length", T.LongType()), T.StructField("ids_crc32", T.LongType()),
    T.StructField("doc_tokens", T.LongType()), T.StructField("sequence_id", T.LongType()), T.StructField("offset", T.LongType()),
])


def cut_points(ids: np.ndarray, ends: np.ndarray, stops: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    """Positions where a window may end, ascending, and what each costs.  ``ends``: the documents' ends; ``stops``: the ids that end a sentence."""
    n = len(ids)
    cost = np.full(n + 1, -1, dtype=np.int64)
    cost[np.flatnonzero(np.isin(ids, stops)) + 1] = SENTENCE_COST
    cost[ends] = 0
    cost[0] = 0
    at = np.flatnonzero(cost >= 0)
    gaps = np.diff(at)
    wide = np.flatnonzero(gaps > GRID)
    if len(wide):
        more = (gaps[wide] - 1) // GRID  # points to put into each gap
        step = np.arange(more.sum()) - np.repeat(np.cumsum(more) - more, more) + 1
        inner = np.repeat(at[wide], more) + GRID * step
        cost[inner] = CUT_COST
        at = np.flatnonzero(cost >= 0)
    return at, cost[at]


def best_cuts(at: list[int], cost: list[int], window: int = WINDOW) -> tuple[list[int], int]:
    """The cheapest cuts from at[0] to at[-1], and their cost."""
    last = len(at) - 1
    if last <= 0:
        return [at[0]] if at else [], 0
    f, back, queue, head = [0] * (last + 1), [0] * (last + 1), [0], 0  # queue: indices, f + at ascending
    key = [0] * (last + 1)
    key[0] = at[0]
    for k in range(1, last + 1):
        x = at[k]
        while at[queue[head]] < x - window:
            head += 1
        i = queue[head]
        back[k] = i
        f[k] = cost[k] + window - x + key[i]
        v = key[k] = f[k] + x
        while len(queue) > head and key[queue[-1]] >= v:
            queue.pop()
        queue.append(k)
        if head > 4096:
            del queue[:head]
            head = 0
    end = at[last]
    best, start, split = f[last], back[last], False
    i = last - 1
    while i >= 0 and end - at[i] <= window:
        c = f[i] + ((end - at[i]).bit_count() - 1) * CUT_COST
        if c < best:
            best, start, split = c, i, True
        i -= 1
    cuts = [end]
    if split:
        left, x = end - at[start], end
        for b in range(left.bit_length()):
            if left >> b & 1:
                x -= 1 << b
                cuts.append(x)
    else:
        cuts.append(at[start])
    k = start
    while k:
        k = back[k]
        cuts.append(at[k])
    return cuts[::-1], best


class Packer:
    """Packs a stream of (id, packed ids); gives rows of ``SCHEMA`` as columns, block by block."""

    def __init__(self, stops: list[int], window: int = WINDOW, block_tokens: int = BLOCK_TOKENS, first_sequence: int = 0):
        self.stops, self.window, self.block_tokens, self.sequence = np.array(stops, dtype="<u4"), window, block_tokens, first_sequence
        self.names: list[int | None] = []
        self.docs: list[bytes] = []
        self.size = 0

    def add(self, doc_id: int | None, ids: bytes) -> bool:
        """True if the block is full and should be flushed."""
        self.names.append(doc_id)
        self.docs.append(ids)
        self.size += len(ids) // 4
        return self.size >= self.block_tokens

    def flush(self) -> list[list]:
        data = b"".join(self.docs)
        ids = np.frombuffer(data, dtype="<u4")
        ends = np.cumsum([len(x) // 4 for x in self.docs])
        starts = np.concatenate([[0], ends[:-1]])
        at, cost = cut_points(ids, ends, self.stops)
        cuts, _ = best_cuts(at.tolist(), cost.tolist(), self.window)
        cuts = np.array(cuts)
        edges = np.union1d(cuts, np.concatenate([starts, ends]))
        a, b = edges[:-1], edges[1:]
        doc, seq = np.searchsorted(starts, a, side="right") - 1, np.searchsorted(cuts, a, side="right") - 1
        view = memoryview(data)
        crc = [zlib.crc32(view[4 * x : 4 * y]) for x, y in zip(a.tolist(), b.tolist(), strict=True)]
        rows = [
            [self.names[i] for i in doc], (a - starts[doc]).tolist(), (b - a).tolist(), crc, (ends - starts)[doc].tolist(),
            (seq + self.sequence).tolist(), (a - cuts[seq]).tolist(),
        ]
        self.sequence += len(cuts) - 1
        self.names, self.docs, self.size = [], [], 0
        return rows


def pack(docs: DataFrame, doc_id: str = "doc_id", text: str = "text", tokenizer: str = TOKENIZER, closing_id: int = CLOSING_ID, window: int = WINDOW, block_tokens: int = BLOCK_TOKENS) -> DataFrame:
    """A row for each piece: doc_id, start, length, ids_crc32, doc_tokens, sequence_id, offset."""
    ship_code(docs.sparkSession)
    closing = np.array([closing_id], dtype="<u4").tobytes()

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        own = encoder(tokenizer_path(tokenizer))
        stops = [i for i in map(own.tokenizer.token_to_id, SENTENCE_ENDS) if i is not None]
        packer = Packer(stops, window, block_tokens, TaskContext.get().partitionId() << 33)

        def block() -> pa.RecordBatch:
            return pa.RecordBatch.from_arrays([pa.array(x, pa.int64()) for x in packer.flush()], names=SCHEMA.names)

        for batch in batches:
            names = batch.column(0).to_pylist()
            for name, ids in zip(names, own.encode(x.as_py() for x in batch.column(1)), strict=True):
                if packer.add(name, ids + closing):
                    yield block()
        if packer.docs:
            yield block()

    return docs.select(F.col(doc_id).cast("long"), F.col(text)).mapInArrow(run, SCHEMA)
