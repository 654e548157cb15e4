"""Harmonic packing of token streams into fixed-size sequences (operator 2).

What a document leaves beyond whole sequences, of length l, is of class k = capacity // l, the
reciprocal-capacity interval (capacity / (k + 1), capacity / k], and a bin of class k closes once it holds k
pieces, so no bin is ever searched for. The room that a closed bin has left is filled at once: the next piece is cut
there and goes on with what remains of it, in that length's class. So sequences have no padding, and a document is cut about as often as
bins close. Each scan task packs its own rows, without a shuffle; what its open bins hold at the end follows one another
in full sequences and at most one for each power of two. A sequence whose length is a power of two isn't padded.

A task's rows and their order follow from the input files alone, so a task that runs again gives the
same sequences. Open bins hold fewer than ``capacity`` tokens a class, whatever the input's size.

Defined results: a null text is an empty one, its document is the end token alone. A special token's string in a
text is that token, as ``tokenizers`` reads it (``special=False``: ordinary text). Repeated rows are
packed each. Extra columns play no part. An empty table gives an empty table.
"""

from __future__ import annotations

import zlib
from collections.abc import Iterator
from dataclasses import dataclass

import pandas as pd
from pyspark import TaskContext
from pyspark.sql import DataFrame

from ._common import bound_batches, id_column, ids_back, text_of
from .tokens import json_tokens

SCHEMA = "doc_id long, start long, length long, ids_crc32 long, doc_tokens long, sequence_id long, offset long, sequence_tokens long"
#: Sequence ids of one task start at its number times this.
TASK_STEP = 1 << 36


@dataclass
class Piece:
    """Tokens ``start`` and on of a document of ``tokens`` tokens; ``data`` has four bytes each."""

    doc: int
    start: int
    data: bytes
    tokens: int

    def __len__(self) -> int:
        return len(self.data) // 4

    def split(self, n: int) -> tuple[Piece, Piece]:
        """The first ``n`` tokens and the rest."""
        return Piece(self.doc, self.start, self.data[: 4 * n], self.tokens), Piece(self.doc, self.start + n, self.data[4 * n :], self.tokens)


def _stacked(pieces: list[Piece], sizes: Iterator[int]) -> Iterator[list[Piece]]:
    """``pieces`` one after the other in bins of ``sizes``, cut where a bin ends."""
    waiting = list(reversed(pieces))
    for room in sizes:
        held: list[Piece] = []
        while room:
            piece = waiting.pop()
            if len(piece) > room:
                piece, rest = piece.split(room)
                waiting.append(rest)
            held.append(piece)
            room -= len(piece)
        yield held


class HarmonicBins:
    """Open bins, one a class, and at most one that holds its pieces and still has room."""

    def __init__(self, capacity: int):
        self.capacity = capacity
        self.open: dict[int, list[Piece]] = {}
        self.closing: list[Piece] = []
        self.room = 0

    def add(self, piece: Piece) -> Iterator[list[Piece]]:
        """The sequences that ``piece`` fills."""
        while len(piece) >= self.capacity:
            whole, piece = piece.split(self.capacity)
            yield [whole]
        if self.room and len(piece):
            first, piece = piece.split(min(self.room, len(piece)))
            self.closing.append(first)
            self.room -= len(first)
            if not self.room:
                yield self.closing
        if not len(piece):
            return
        k = self.capacity // len(piece)
        held = self.open.setdefault(k, [])
        held.append(piece)
        if len(held) == k:
            self.closing = self.open.pop(k)
            self.room = self.capacity - sum(map(len, self.closing))
            if not self.room:
                yield self.closing

    def rest(self) -> Iterator[list[Piece]]:
        """Sequences of what is left: full ones, and one for each binary digit of what remains."""
        left = [*(self.closing if self.room else []), *(x for k in sorted(self.open) for x in self.open[k])]
        self.open, self.room = {}, 0
        full, last = divmod(sum(map(len, left)), self.capacity)
        yield from _stacked(left, iter([self.capacity] * full + [1 << bit for bit in range(last.bit_length() - 1, -1, -1) if last >> bit & 1]))


def pack_documents(docs: DataFrame, tokenizer_path: str, capacity: int = 2048, end_id: int = 1, key: str = "doc_id", text: str = "text", special: bool = True) -> DataFrame:
    """Tokenise, cut and pack the documents of ``docs``: one row a piece.

    ``sequence_id`` is unique, ``offset`` is the piece's place in its sequence, ``sequence_tokens``
    the tokens of that sequence. ``special``: whether the strings of special tokens are those tokens, as the library
    reads them, or ordinary text.
    """
    if capacity & (capacity - 1):
        raise ValueError("capacity must be a power of two")
    narrow = bound_batches(docs).select(id_column(docs, key), text_of(text).alias("text"))
    end = end_id.to_bytes(4, "little")

    def task(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        codec = json_tokens(tokenizer_path, special=special)
        bins = HarmonicBins(capacity)
        sequence = TaskContext.get().partitionId() * TASK_STEP
        rows: list[tuple] = []

        def close(one: list[Piece]) -> None:
            nonlocal sequence
            offset, total = 0, sum(map(len, one))
            for x in one:
                rows.append((x.doc, x.start, len(x), zlib.crc32(x.data), x.tokens, sequence, offset, total))
                offset += len(x)
            sequence += 1

        def out() -> pd.DataFrame:
            got = pd.DataFrame(rows, columns=[c.split()[0] for c in SCHEMA.split(", ")])
            rows.clear()
            return got

        for pdf in batches:
            for at in range(0, len(pdf), 500):
                some = pdf.iloc[at : at + 500]
                for doc, data in zip(some["doc_id"].tolist(), codec.encode(some["text"].tolist())):
                    data += end
                    for done in bins.add(Piece(doc, 0, data, len(data) // 4)):
                        close(done)
                if len(rows) > 50_000:
                    yield out()
            yield out()
        for done in bins.rest():
            close(done)
        yield out()

    return ids_back(narrow.mapInPandas(task, SCHEMA))
