"""Bounded-space online packing of token ids into sequences of one length.

Every partition keeps a fixed number of open windows. A piece goes to the open window it fits
best. When it fits none, the fullest window is topped up with the head of the piece, which fills
it, and is emitted; the rest of the piece is placed in the same way. What the windows of a
partition still hold at its end is poured together into at most one partial window; the partial
windows of a fixed number of partitions are merged in a second, small stage.
"""

from __future__ import annotations

import zlib
from collections.abc import Iterator

import numpy as np
import pandas as pd
import pyarrow as pa
from pyspark import TaskContext
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from surveyloom.llm import pretokens
from surveyloom.llm.common import cut

PIECE = "doc_id long, start long, length long, ids_crc32 long, doc_tokens long, sequence_id long, offset long"
_PIECE_COLUMNS = [x.split()[0] for x in PIECE.split(", ")]
_OPEN = PIECE + ", leftover boolean, part long, ids binary"
_OUT = 20_000


class Windows:
    """Open windows of one partition. Pieces are ``[doc_id, start, ids, doc_tokens]`` with ids as bytes."""

    def __init__(self, size: int, count: int, first_id: int):
        self.size, self.next_id = size, first_id
        self.used = [0] * count
        self.pieces: list[list] = [[] for _ in range(count)]
        self.rows: list[tuple] = []

    def _put(self, window: int, piece: tuple) -> None:
        self.pieces[window].append(piece)
        self.used[window] += len(piece[2]) // 4
        if self.used[window] == self.size:
            self.emit(window)

    def emit(self, window: int) -> None:
        offset = 0
        for doc_id, start, ids, total in self.pieces[window]:
            self.rows.append((doc_id, start, len(ids) // 4, zlib.crc32(ids), total, self.next_id, offset))
            offset += len(ids) // 4
        self.next_id += 1
        self.used[window], self.pieces[window] = 0, []

    def place(self, doc_id, start: int, ids: bytes, total: int) -> None:
        """Best fit for the piece; it is cut only to fill the fullest window when it fits none.

        Whole sequences at its head are emitted at once: they need no window.
        """
        while len(ids) // 4 >= self.size:
            self.rows.append((doc_id, start, self.size, zlib.crc32(ids[:4 * self.size]), total, self.next_id, 0))
            self.next_id += 1
            start, ids = start + self.size, ids[4 * self.size:]
        while ids:
            length, best, fullest = len(ids) // 4, -1, 0
            for i, used in enumerate(self.used):
                if used + length <= self.size and (best < 0 or used > self.used[best]):
                    best = i
                if used > self.used[fullest]:
                    fullest = i
            if best >= 0:
                self._put(best, (doc_id, start, ids, total))
                return
            room = self.size - self.used[fullest]
            self._put(fullest, (doc_id, start, ids[:4 * room], total))
            start, ids = start + room, ids[4 * room:]

    def drain(self) -> list:
        """Pour the open windows together, the fullest first; what is left makes at most one partial window."""
        order = sorted((i for i in range(len(self.used)) if self.used[i]), key=lambda i: -self.used[i])
        held = [self.pieces[i] for i in order]
        self.used, self.pieces = [0], [[]]
        for pieces in held:
            for piece in pieces:
                self.place(*piece)
        return self.pieces[0]


def _pack(rank_file: str, end_id: int, size: int, windows: int):
    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        part = TaskContext.get().partitionId()
        end = np.array([end_id], "<u4").tobytes()
        state = Windows(size, windows, part << 33)

        def rows(left: list = ()) -> pa.RecordBatch:
            done = [(*r, False, part, None) for r in state.rows]
            done += [(p[0], p[1], len(p[2]) // 4, 0, p[3], 0, 0, True, part, p[2]) for p in left]
            state.rows.clear()
            columns = list(zip(*done)) or [()] * 10
            kinds = [pa.int64()] * 7 + [pa.bool_(), pa.int64(), pa.binary()]
            names = [x.split()[0] for x in _OPEN.split(", ")]
            return pa.RecordBatch.from_arrays([pa.array(c, k) for c, k in zip(columns, kinds)], names)

        for batch in batches:
            for doc_id, text in zip(batch.column(0), batch.column(1)):
                doc_id, text = doc_id.as_py(), text.as_py()  # one text at a time
                ids = pretokens.text_ids(rank_file, text or "").astype("<u4").tobytes() + end
                state.place(doc_id, 0, ids, len(ids) // 4)
                if len(state.rows) >= _OUT:
                    yield rows()
        yield rows(state.drain())
    return run


def _merge(size: int, windows: int, groups: int):
    def run(frame: pd.DataFrame) -> pd.DataFrame:
        frame = frame.sort_values(["part", "doc_id", "start"])
        state = Windows(size, windows, (1 << 62) + (int(frame["part"].iloc[0]) // groups << 24))
        for doc_id, start, ids, total in zip(frame["doc_id"], frame["start"], frame["ids"], frame["doc_tokens"]):
            state.place(None if pd.isna(doc_id) else int(doc_id), int(start), ids, int(total))
        if state.drain():
            state.emit(0)
        return pd.DataFrame(state.rows, columns=_PIECE_COLUMNS).astype({"doc_id": "Int64"})
    return run


def pack(documents: DataFrame, rank_file: str, size: int = 1024, windows: int = 16, end_id: int = 0, merge_parts: int = 64, doc_id: str = "doc_id", text: str = "text") -> DataFrame:
    """One row per piece: document, place in it, checksum of its ids, and place in its sequence.

    Every row of ``documents`` is a document of its own, also when ids repeat or are null; a null
    text is empty and gives the end id alone. Each id lies in exactly one piece, sequences are
    gapless from offset 0, and only the last one of ``merge_parts`` partitions may be partial.
    Memory of a task is ``windows * size`` ids and one text. An empty table gives no rows.
    """
    texts = documents.select(F.col(doc_id).cast("long").alias("doc_id"), F.col(text).alias("text"))
    packed = cut(texts.mapInArrow(_pack(rank_file, end_id, size, windows), _OPEN))
    names = [x.split()[0] for x in PIECE.split(", ")]
    merged = (packed.where("leftover").withColumn("group", F.expr(f"part div {merge_parts}"))
              .groupBy("group").applyInPandas(_merge(size, windows, merge_parts), PIECE))
    return packed.where("not leftover").select(names).unionAll(merged)
