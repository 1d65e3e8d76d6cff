"""Bounded-space online packing of token sequences into windows of 1,024.

A document's ids, closed by id 0, are cut into full windows from its start; the rest is placed in the open window
whose free space it fits best. A partition keeps at most `OPEN` windows open: when nothing fits, the fullest is emitted
and a new one opened. What stays open at the end of a partition is merged: the leftovers of `FAN` partitions meet in
one task, which holds FAN * OPEN windows at most, and are packed again, longest first. Beside windows, a task holds a
batch of `BATCH_BYTES`, or one longer text with its ids. Only a few windows of each FAN partitions are emitted with
much padding.

Defined results: a null or empty text is the single id 0; a document's rows are its pieces, also if its id is null or
repeated, and repeated rows are packed each for itself; a very long text is cut into full windows and one rest; pieces
of equal length are placed in order of partition and place; sequence ids are unique but depend on how the input is
split; an empty table gives an empty result; other columns are not read, so their names may clash with ours.
"""

from __future__ import annotations

import zlib
from bisect import bisect_left, insort
from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark import TaskContext
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from fairlead.llm.graph import durable
from fairlead.llm.media import in_batches, skinny
from fairlead.llm.token_count import FILE, tokenizer_path

CAPACITY = 1024
#: Windows that a partition keeps open, and partitions whose leftovers meet.
OPEN, FAN = 64, 64
END_ID = 0
BATCH_BYTES = 400_000
#: Sequence ids: the partition's number above these bits, a counter below, and the lowest bit set for merged ones.
COUNTER_BITS = 34
PIECE = "doc_id long, start long, length long, ids_crc32 long, doc_tokens long"
PLACED = f"{PIECE}, sequence_id long, offset long"


class Windows:
    """At most `most` open windows; pieces are (length, what it is)."""

    def __init__(self, most: int, capacity: int = CAPACITY) -> None:
        self.most, self.capacity = most, capacity
        self.free: list[tuple[int, int]] = []  # (free space, window), sorted
        self.held: dict[int, list] = {}
        self.opened = 0

    def place(self, length: int, what: object) -> list | None:
        """Takes a piece shorter than a window; the pieces of the window that had to be emitted for it, if any."""
        emitted = None
        at = bisect_left(self.free, (length, -1))
        if at < len(self.free):
            free, window = self.free.pop(at)
        else:
            if len(self.free) == self.most:
                _, fullest = self.free.pop(0)
                emitted = self.held.pop(fullest)
            self.opened += 1
            free, window = self.capacity, self.opened
            self.held[window] = []
        self.held[window].append(what)
        insort(self.free, (free - length, window))
        return emitted


def pieces(docs: DataFrame, file: str, capacity: int, most_open: int, id_col: str, text_col: str) -> DataFrame:
    """Pieces placed in emitted windows, and with a null sequence_id those of the windows left open."""

    def work(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        from fairlead.llm.bpe import Encoder

        encoder, windows = Encoder(tokenizer_path(file)), Windows(most_open, capacity)
        part, counter = TaskContext.get().partitionId(), 0

        def emitted(rows: list[tuple]) -> list[tuple]:
            nonlocal counter
            sequence, offset, out = ((part << COUNTER_BITS) | counter) << 1, 0, []
            counter += 1
            for row in rows:
                out.append((*row, sequence, offset, part, None))
                offset += row[2]
            return out

        for doc_ids, raws in in_batches(batches, BATCH_BYTES):
            ids, lengths = encoder.encode([r.decode() for r in raws], END_ID)
            data, out, at = memoryview(ids.astype("<u4", copy=False)).cast("B"), [], 0
            for doc, n in zip(doc_ids, lengths.tolist(), strict=True):
                for start in range(0, n, capacity):
                    length = min(capacity, n - start)
                    row = (doc, start, length, zlib.crc32(data[4 * (at + start) : 4 * (at + start + length)]), n)
                    if length == capacity:
                        out += emitted([row])
                    elif full := windows.place(length, row):
                        out += emitted(full)
                at += n
            yield _batch(out)
        left = (row for rows in windows.held.values() for row in rows)
        yield _batch([(*row, None, None, part, n) for n, row in enumerate(left)])

    return skinny(docs, id_col, text_col).mapInArrow(work, f"{PLACED}, part long, number long")


_NAMES = ["doc_id", "start", "length", "ids_crc32", "doc_tokens", "sequence_id", "offset", "part", "number"]
_OUT = _NAMES[:-2]


def _batch(rows: list[tuple]) -> pa.RecordBatch:
    columns = zip(*rows, strict=True) if rows else [[]] * len(_NAMES)
    return pa.RecordBatch.from_arrays([pa.array(list(c), pa.int64()) for c in columns], _NAMES)


def merged(left: DataFrame, capacity: int, fan: int) -> DataFrame:
    """Leftover pieces of every `fan` partitions packed together, longest first."""

    def work(key: tuple, rows: pa.Table) -> pa.Table:
        rows = rows.sort_by([("length", "descending"), ("part", "ascending"), ("number", "ascending")])
        lengths = rows["length"].to_numpy()
        windows, at, offsets = Windows(len(lengths) + 1, capacity), *np.zeros((2, len(lengths)), np.int64)
        for i, length in enumerate(lengths.tolist()):
            windows.place(length, i)
        for window, held in windows.held.items():
            at[held] = window
            offsets[held] = np.cumsum(lengths[held]) - lengths[held]
        sequence = (((key[0].as_py() << COUNTER_BITS) | at) << 1) | 1
        columns = {n: rows[n] for n in _OUT} | {"sequence_id": pa.array(sequence), "offset": pa.array(offsets)}
        return pa.table(columns)

    return left.groupBy(F.floor(F.col("part") / fan).alias("meeting")).applyInArrow(work, PLACED)


def pack(
    docs: DataFrame, file: str = FILE, capacity: int = CAPACITY, most_open: int = OPEN, fan: int = FAN,
    id_col: str = "doc_id", text_col: str = "text",
) -> DataFrame:
    """(doc_id, start, length, ids_crc32, doc_tokens, sequence_id, offset), one row per piece."""
    found = durable(pieces(docs, file, capacity, most_open, id_col, text_col))
    done = found.filter("sequence_id IS NOT NULL").select(*_OUT)
    return done.unionByName(merged(found.filter("sequence_id IS NULL"), capacity, fan))


def op8_packing(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Where every piece of every document lies."""
    return pack(spark.read.parquet(f"{sf_dir}/documents.parquet"))


QUERIES = {"op8_packing": op8_packing}
ORACLES: dict[str, str] = {}
