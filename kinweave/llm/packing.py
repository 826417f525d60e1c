"""Sum-of-squares online packing of tokenised documents into fixed windows."""

from __future__ import annotations

import struct
import zlib

import numpy as np
import pyarrow as pa
import tiktoken
from pyspark import TaskContext
from pyspark.sql import DataFrame

from .bpe import _Memo, load
from .common import slices, text_docs, to_batch

_PIECES = pa.schema([("doc_id", pa.int64()), ("start", pa.int64()), ("length", pa.int64()), ("ids_crc32", pa.int64()), ("doc_tokens", pa.int64()), ("sequence_id", pa.int64()), ("offset", pa.int64())])
_SQL = "doc_id long, start long, length long, ids_crc32 long, doc_tokens long, sequence_id long, offset long"


class SumOfSquares:
    """Online packer: ``level[h]`` counts the open windows that hold h ids.

    A piece goes to the level at which the sum of squared counts is least afterwards
    (the fullest such level on ties); level 0 opens a window. A window that is full
    is closed. At most ``most`` windows stay open: beyond that the emptiest one is
    moved into the fullest, its last piece cut where that one is full, and what is
    left of a cut piece is placed anew. ``put`` returns the windows that were closed.
    """

    def __init__(self, size: int, most: int = 32):
        self.size, self.most, self.count = size, most, 0
        self.level = np.zeros(size + 1, dtype=np.int64)
        self.open: list[list[list]] = [[] for _ in range(size)]

    def put(self, piece: tuple) -> list[list]:
        closed: list[list] = []
        self._place(piece, closed)
        while self.count > self.most:
            held = np.flatnonzero(self.level)
            window = self._take(int(held[-1]))
            for moved in self._take(int(np.flatnonzero(self.level)[0])):
                window = self._join(window, moved, closed)
            if window:
                self._keep(window)
        return closed

    def _place(self, piece: tuple, closed: list):
        window = self._join(self._take(self._choose(len(piece[2]))), piece, closed)
        if window:
            self._keep(window)

    def _choose(self, n: int) -> int:
        size, level = self.size, self.level
        cost = level[n:] - level[: size - n + 1]
        cost[0] = level[n]  # a new window leaves no level
        usable = level[: size - n + 1] > 0
        usable[0] = True
        at = np.flatnonzero(usable)
        c = 2 * cost[at] + 2
        c[at == 0] -= 1
        c[at == size - n] -= 1  # a full window enters none
        return int(at[len(at) - 1 - np.argmin(c[::-1])])

    def _take(self, h: int) -> list:
        if not h:
            return []
        self.level[h] -= 1
        self.count -= 1
        return self.open[h].pop()

    def _keep(self, window: list):
        h = sum(len(p[2]) for p in window)
        self.level[h] += 1
        self.count += 1
        self.open[h].append(window)

    def _join(self, window: list, piece: tuple, closed: list) -> list:
        """``window`` with ``piece``, or what is left of the piece if that closes the window."""
        doc, start, ids, total = piece
        room = self.size - sum(len(p[2]) for p in window)
        window = [*window, (doc, start, ids[:room], total)]
        if len(ids) < room:
            return window
        closed.append(window)
        return [(doc, start + room, ids[room:], total)] if len(ids) > room else []

    def rest(self) -> list[tuple]:
        """The pieces of the windows still open, ``most`` windows at most, fullest first."""
        return [p for h in range(self.size - 1, 0, -1) for w in self.open[h] for p in w]


_RANKED: dict = {}


def ranked(path: str, bpe):
    """An encoder of single pieces: a byte-level file's ids are its merge ranks, which tiktoken takes."""
    if path not in _RANKED:
        back = {c: b for b, c in enumerate(bpe.alphabet)}
        ranks = {bytes(back[c] for c in t): i for t, i in bpe.vocab.items() if t not in bpe.special}
        _RANKED[path] = tiktoken.Encoding("file", pat_str=r"[\s\S]+", mergeable_ranks=ranks, special_tokens={})._encode_single_piece
    return _RANKED[path]


def _tail_windows(pieces: list[tuple], size: int):
    """The pieces of a task's last open windows, joined and cut at the window size, then at powers of two."""
    left = sum(len(p[2]) for p in pieces)
    window, room = [], 0
    for doc, start, ids, total in pieces:
        while len(ids):
            if not room:
                room = size if left >= size else 1 << (left.bit_length() - 1)
                left -= room
            part = ids[:room]
            window.append((doc, start, part, total))
            start, ids, room = start + len(part), ids[len(part) :], room - len(part)
            if not room:
                yield window
                window = []


def pack(docs: DataFrame, tokenizer: str, size: int = 1024, end_id: int = 0, memo: int = 150_000) -> DataFrame:
    """One row per piece of every document's ids in sequences of at most ``size``.

    A document is its ids by the tokenizer file and ``end_id``; null or empty text is
    the end id alone. Documents longer than a window give whole windows and a
    remainder; remainders are packed online, in the order of the input, by each task
    for itself, so nothing is shuffled and one source may hold most rows. The level
    array places every remainder; only the pieces of the last open windows, at most
    32 a task, are joined and cut: no sequence needs padding, as a task's last ones
    are powers of two. ``sequence_id`` has the task's partition in its high bits. A
    task that is run again on the same split packs alike. Rows that repeat and rows
    without doc_id are documents of their own; other columns, of any name, are not
    read; an empty table gives no row.
    """

    def run(batches):
        bpe = load(tokenizer)
        piece = ranked(tokenizer, bpe)
        known = _Memo(lambda p: struct.pack(f"<{len(ids := piece(p.encode()))}I", *ids), memo)
        special = {k: np.array([v], dtype="<u4").tobytes() for k, v in bpe.special.items()}
        end = np.array([end_id], dtype="<u4").tobytes()
        packer, seq = SumOfSquares(size), TaskContext.get().partitionId() << 40
        rows: list[tuple] = []

        def emit(window):
            nonlocal seq
            offset = 0
            for doc, start, ids, total in window:
                rows.append((doc, start, len(ids), zlib.crc32(ids.tobytes()), total, seq, offset))
                offset += len(ids)
            seq += 1

        def flush():
            cols = list(zip(*rows, strict=True)) if rows else [[] for _ in _PIECES]
            rows.clear()
            return to_batch(dict(zip(_PIECES.names, cols, strict=True)), _PIECES)

        for b in slices(batches):
            for doc, text in zip(b.column(0).to_pylist(), b.column(1).to_pylist(), strict=True):
                parts = []
                for is_special, r in bpe.runs(text):
                    if is_special:
                        parts.append(special[r])
                    else:
                        parts.extend([known[p] for p in bpe.pieces(bpe.normalize(r))])
                parts.append(end)
                ids = np.frombuffer(b"".join(parts), dtype="<u4")
                n, full = len(ids), len(ids) // size * size
                for i in range(0, full, size):
                    emit([(doc, i, ids[i : i + size], n)])
                if full < n:
                    for window in packer.put((doc, full, ids[full:].copy(), n)):
                        emit(window)
            yield flush()
        for window in _tail_windows(packer.rest(), size):
            emit(window)
        yield flush()

    return text_docs(docs).mapInArrow(run, _SQL)
