"""Packing documents into fixed windows by the sum-of-squares rule.

Each document is tokenised and closed with an end id. Its full windows stand alone; what is left is
placed online into the fill level that makes the sum of squared counts of partly filled windows
smallest, the counts being kept in one array with an entry per level. When a task's rows end, its
partly filled windows are merged by cutting the emptiest to fill the fullest, and the last remainder
is cut at powers of two, at which a sequence needs no padding.

Every task packs the rows it reads, so nothing is shuffled, and a task that is run again after an
executor loss repeats the same packing. Memory: the open windows, at most ``max_open`` of them (beyond
that they are merged early).
"""

from __future__ import annotations

import zlib
from collections import defaultdict
from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark import TaskContext
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from quillon.llm._common import map_arrow, table
from quillon.llm.tokenize import default_path, load

WINDOW = 2048
END_ID = 1
MAX_OPEN = 2048
#: Sequence ids: task number times this, plus the number within the task.
_TASK_SPAN = 1 << 36


class _Piece:
    __slots__ = ("doc", "ids", "start", "total")

    def __init__(self, doc, start: int, ids: np.ndarray, total: int):
        self.doc, self.start, self.ids, self.total = doc, start, ids, total

    def cut(self, n: int) -> tuple[_Piece, _Piece]:
        return (
            _Piece(self.doc, self.start, self.ids[:n], self.total),
            _Piece(self.doc, self.start + n, self.ids[n:], self.total),
        )


class SumOfSquaresPacker:
    """Packs one stream of documents; ``done`` collects closed sequences as lists of pieces."""

    def __init__(self, window: int = WINDOW, max_open: int = MAX_OPEN):
        self.window, self.max_open = window, max_open
        self.levels = np.zeros(window + 1, np.int64)  # open windows by fill; index 0 and window stay 0
        self.open: dict[int, list[list[_Piece]]] = defaultdict(list)
        self.n_open = 0
        self.done: list[list[_Piece]] = []

    def add(self, doc, ids: np.ndarray) -> None:
        w, total = self.window, len(ids)
        full = total - total % w
        for start in range(0, full, w):
            self.done.append([_Piece(doc, start, ids[start : start + w], total)])
        if total > full:
            self._place(_Piece(doc, full, ids[full:], total))

    def _place(self, piece: _Piece) -> None:
        w, size, n = self.window, len(piece.ids), self.levels
        old = n[: w - size + 1]  # levels 0 .. w - size; 0 opens a window
        gain = 2 * n[size : w + 1] + 1 - (2 * old - 1)
        gain[w - size] -= 1  # a full window is no longer counted (its level's count is 0)
        gain[0] = 2 * n[size] + 1
        usable = old > 0
        usable[0] = True
        gain = np.where(usable, gain, np.iinfo(np.int64).max)
        level = int(w - size - np.argmin(gain[::-1]))  # the fullest level on ties
        if level:
            bin_ = self.open[level].pop()
            n[level] -= 1
            self.n_open -= 1
        else:
            bin_ = []
        bin_.append(piece)
        if level + size == w:
            self.done.append(bin_)
        else:
            self.open[level + size].append(bin_)
            n[level + size] += 1
            self.n_open += 1
            if self.n_open > self.max_open:
                self._merge()

    def _merge(self) -> tuple[int, list[_Piece]]:
        """Fill the fullest open windows with cuts of the emptiest; the one that stays partly filled stays open."""
        bins = [(f, b) for f in sorted(self.open, reverse=True) for b in self.open[f]]
        self.open.clear()
        self.levels[:] = 0
        self.n_open = 0
        fill, kept = 0, []
        i, j = 0, len(bins) - 1
        while i <= j:
            if i == j:
                fill, kept = bins[i]
                break
            fill, kept = bins[i]
            spare_fill, spare = bins[j]
            while fill < self.window and spare:
                piece = spare.pop()
                room = self.window - fill
                if len(piece.ids) > room:
                    piece, rest = piece.cut(room)
                    spare.append(rest)
                kept.append(piece)
                fill += len(piece.ids)
                spare_fill -= len(piece.ids)
            bins[i], bins[j] = (fill, kept), (spare_fill, spare)
            if fill == self.window:
                self.done.append(kept)
                fill, kept = 0, []
                i += 1
            if not spare:
                j -= 1
        if kept:
            self.open[fill].append(kept)
            self.levels[fill] = 1
            self.n_open = 1
        return fill, kept

    def finish(self) -> None:
        fill, kept = self._merge()
        self.open.clear()
        self.levels[:] = 0
        self.n_open = 0
        kept = kept[::-1]
        for bit in range(fill.bit_length() - 1, -1, -1):
            size = 1 << bit
            if not fill & size:
                continue
            sequence, got = [], 0
            while got < size:
                piece = kept.pop()
                if len(piece.ids) > size - got:
                    piece, rest = piece.cut(size - got)
                    kept.append(rest)
                sequence.append(piece)
                got += len(piece.ids)
            self.done.append(sequence)

    def drain(self) -> list[list[_Piece]]:
        done, self.done = self.done, []
        return done


def pack_documents(
    docs: DataFrame,
    *,
    id_col: str = "doc_id",
    text_col: str = "text",
    tokenizer_path: str | None = None,
    end_id: int = END_ID,
    window: int = WINDOW,
    max_open: int = MAX_OPEN,
    with_ids: bool = False,
) -> DataFrame:
    """One row per piece: ``doc_id, start, length, ids_crc32, doc_tokens, sequence_id, offset``.

    With ``with_ids`` also the piece's ``ids``. Null and empty texts are the end id alone; repeated rows
    are packed separately; other columns are ignored; an empty table gives no rows. Sequence ids are
    unique, not gapless.
    """
    path = tokenizer_path or default_path()

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        tok, packer = load(path), SumOfSquaresPacker(window, max_open)
        context = TaskContext.get()
        sequence = (context.partitionId() if context else 0) * _TASK_SPAN

        def rows(kind: pa.DataType) -> pa.RecordBatch:
            nonlocal sequence
            columns: tuple[list, ...] = ([], [], [], [], [], [], [], [])
            for pieces in packer.drain():
                offset = 0
                for p in pieces:
                    raw = p.ids.tobytes()
                    row = (p.doc, p.start, len(p.ids), zlib.crc32(raw), p.total, sequence, offset, p.ids)
                    for column, value in zip(columns, row, strict=True):
                        column.append(value)
                    offset += len(p.ids)
                sequence += 1
            arrays = [pa.array(columns[0], kind)] + [pa.array(c, pa.int64()) for c in columns[1:7]]
            if with_ids:
                arrays.append(pa.array([x.astype(np.int64) for x in columns[7]], pa.list_(pa.int64())))
            return pa.RecordBatch.from_arrays(arrays, names=names)

        kind = None
        for batch in batches:
            kind = batch.column(0).type
            for at in range(0, batch.num_rows, 512):
                part = batch.slice(at, 512)
                for doc, text in zip(part.column(0).to_pylist(), part.column(1).to_pylist(), strict=True):
                    ids = tok.ids(text) if text else []
                    packer.add(doc, np.array([*ids, end_id], "<u4"))
                yield rows(kind)
        packer.finish()
        if kind is not None:
            yield rows(kind)

    names = ["doc_id", "start", "length", "ids_crc32", "doc_tokens", "sequence_id", "offset"] + ["ids"] * with_ids
    kind = docs.schema[id_col].dataType.simpleString()
    schema = ", ".join([f"doc_id {kind}", *(f"{n} long" for n in names[1:7]), *(["ids array<long>"] if with_ids else [])])
    return map_arrow(docs.select(F.col(id_col).alias("doc_id"), F.col(text_col).alias("text")), run, schema)


def op5_pack(spark: SparkSession, sf_dir: str) -> DataFrame:
    return pack_documents(table(spark, sf_dir, "documents"))
