"""Packing of documents into training windows by the sum-of-squares rule.

Each partition of the input packs its own documents as they come, so nothing is
shuffled and a lost task is done again alike. A level array counts the open
windows by their fill. Whole windows are cut from a document first; what remains
goes into the open (or a new) window whose choice leaves the least sum of squared
counts over the partially filled levels, and a filled window is written.

When a partition ends, its open windows are drained: the least filled one is cut
up into the gaps of the most filled ones, until at most one partial window is
left, which is cut into sequences of powers of two; these need no padding.
Only open windows are held, with the ids of their pieces (4 bytes each): some megabytes,
as few windows of one fill are open at a time. Of levels that are as good the lowest is
taken, so equal inputs are packed alike.
"""

from __future__ import annotations

import zlib
from collections import defaultdict

import numpy as np
import pyarrow as pa
from pyspark import TaskContext
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from tidepool.llm import bpe
from tidepool.llm.common import small_batches

WINDOW = 2048
FIELDS = {"doc_id": pa.int64(), "start": pa.int64(), "length": pa.int64(), "ids_crc32": pa.int64(), "doc_tokens": pa.int64(), "sequence_id": pa.int64(), "offset": pa.int64()}


class Packer:
    """Online packing of one partition. A piece is (doc, start, length, ids); ids are bytes, kept until the piece's window is written."""

    def __init__(self, window: int = WINDOW):
        self.window = window
        self.levels = np.zeros(window + 1, np.int64)
        self.open: dict[int, list[list[tuple]]] = defaultdict(list)

    def place(self, piece: tuple) -> list[tuple] | None:
        """Puts the piece into a window; returns that window if it is full now."""
        size, n = piece[2], self.levels
        room = self.window - size
        # what the sum of squares grows by: the level left gives 1 - 2n, the level reached 1 + 2n; a new window leaves none and a full one counts for none
        cost = 2 * n[size : self.window + 1] + 1
        cost[room] = 0
        cost[1:] += 1 - 2 * n[1 : room + 1]
        cost[1:][n[1 : room + 1] == 0] = np.iinfo(np.int64).max
        level = int(cost.argmin())
        if level:
            held = self.open[level].pop()
            n[level] -= 1
        else:
            held = []
        held.append(piece)
        if level == room:
            return held
        self.open[level + size].append(held)
        n[level + size] += 1
        return None

    def drain(self):
        """Yields the windows that are still open, filled from each other by cutting; then what is left in powers of two."""
        left = [w for level in sorted(self.open, reverse=True) for w in self.open[level]]
        self.open.clear()
        self.levels[:] = 0
        pieces, k = [], len(left)
        i = 0
        while i < k:
            held, i = left[i], i + 1
            gap = self.window - sum(p[2] for p in held)
            while gap and (pieces or i < k):
                if not pieces:
                    k -= 1
                    pieces = left[k]
                head, rest = cut(pieces.pop(), gap)
                held.append(head)
                gap -= head[2]
                if rest:
                    pieces.append(rest)
            if gap:
                pieces = held  # the last
                break
            yield held
        size = sum(p[2] for p in pieces)
        while size:
            part = 1 << (size.bit_length() - 1)
            held, gap = [], part
            while gap:
                head, rest = cut(pieces.pop(0), gap)
                held.append(head)
                gap -= head[2]
                if rest:
                    pieces.insert(0, rest)
            size -= part
            yield held


def cut(piece: tuple, size: int) -> tuple[tuple, tuple | None]:
    """The first ``size`` ids of a piece (or all), and the rest if there is one."""
    doc, start, length, ids = piece
    if length <= size:
        return piece, None
    return (doc, start, size, ids[: 4 * size]), (doc, start + size, length - size, ids[4 * size :])


def pack(docs: DataFrame, doc_id: str = "doc_id", text: str = "text", window: int = WINDOW, end: int = 1, path: str = bpe.VOCABULARY, with_ids: bool = False) -> DataFrame:
    """One row per piece: doc_id, start, length, ids_crc32, doc_tokens, sequence_id, offset (and the ids, if asked for).

    A document's ids are those of its text (null: empty) and then ``end``; empty documents are one id. Repeated rows are
    documents of their own. A sequence_id is the partition's number times 2**32 plus a count from 0.
    """
    fields = FIELDS | ({"ids": pa.binary()} if with_ids else {})

    def run(parts):
        coder, packer = bpe.encoder(path), Packer(window)
        task, count = TaskContext.get().partitionId() << 32, 0
        tail = np.array([end], "<u4")
        rows: list[tuple] = []

        def write(held):
            nonlocal count
            at = 0
            for (doc, tokens), start, length, ids in held:
                rows.append((doc, start, length, zlib.crc32(ids), tokens, task + count, at, *((ids,) if with_ids else ())))
                at += length
            count += 1

        def out():
            columns = list(zip(*rows, strict=True)) or [()] * len(fields)
            batch = pa.RecordBatch.from_arrays([pa.array(c, t) for c, t in zip(columns, fields.values(), strict=True)], names=list(fields))
            rows.clear()
            return batch

        for part in parts:
            doc_ids, seen = part.column(0).to_pylist(), 0
            for texts in bpe.batches(part.column(1)):
                flat, bounds = coder.encode(texts)
                for k in range(len(texts)):
                    ids = np.append(flat[bounds[k] : bounds[k + 1]], tail).astype("<u4").tobytes()
                    n = len(ids) // 4
                    doc = (doc_ids[seen + k], n)
                    whole = n - n % window
                    for start in range(0, whole, window):
                        write([(doc, start, window, ids[4 * start : 4 * (start + window)])])
                    if whole < n and (full := packer.place((doc, whole, n - whole, ids[4 * whole :]))):
                        write(full)
                seen += len(texts)
            yield out()
        for held in packer.drain():
            write(held)
            if len(rows) > 10_000:
                yield out()
        yield out()

    schema = "doc_id long, start long, length long, ids_crc32 long, doc_tokens long, sequence_id long, offset long" + ", ids binary" * with_ids
    small_batches(docs.sparkSession)
    return docs.select(F.col(doc_id).cast("long").alias("doc_id"), F.col(text).alias("text")).mapInArrow(run, schema)
