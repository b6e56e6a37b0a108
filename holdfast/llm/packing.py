"""Pack examples into sequences by vector bin packing with the dot-product heuristic.

A sequence has three limits: tokens, segments and loss-bearing tokens. Each example is a vector
of these, scaled by the limits. One sequence is open at a time; the next example is the fitting
one whose vector has the largest dot product with the room left. When none fits and cutting is
allowed, the best one is cut to the room and its rest goes back. Sequences close when tokens,
segments or loss tokens are used up.

Each task packs its own rows from a pool of bounded size: no shuffle, and nothing grows with
the input. A task's last sequence is short; with cutting it is laid out as sequences of powers
of two in length, which need no padding. Sequence ids are the partition's number and a count,
so a task that runs again gives the same ones.

Defined results: a null text or prompt is empty; an empty text is its end id alone; long texts give full
sequences and a rest; repeated rows and null ids are examples of their own; an empty table gives
no rows. Loss-bearing tokens are the last ones of an example: those after its prompt, all of them
where there is none.
"""

from __future__ import annotations

import zlib
from collections.abc import Iterator, Sequence
from dataclasses import dataclass

import numpy as np
import pyarrow as pa
from pyspark import TaskContext
from pyspark.sql import DataFrame, functions as F

from holdfast.llm.pieces import frequent_stretches, frequent_table, give_back, kept_pieces
from holdfast.llm.tables import whole_text

# A sequence has at most as many segments as tokens: instruction data may ask for fewer.
TOKENS, SEGMENTS = 2048, 2048
# Examples among which the next one is chosen.
POOL = 512
END_ID = 1


@dataclass(slots=True)
class Piece:
    """Tokens ``start`` to ``end`` of an example; those from ``loss_from`` on bear loss."""

    key: object
    ids: bytes
    start: int
    end: int
    total: int
    loss_from: int

    def size(self) -> int:
        return self.end - self.start

    def loss(self) -> int:
        return max(0, self.end - max(self.start, self.loss_from))

    def split(self, size: int) -> tuple["Piece", "Piece"]:
        at = self.start + size
        return (
            Piece(self.key, self.ids[: 4 * size], self.start, at, self.total, self.loss_from),
            Piece(self.key, self.ids[4 * size :], at, self.end, self.total, self.loss_from),
        )

    def longest(self, room: int, loss_room: int) -> int:
        """The most tokens from the start that fit both rooms."""
        free = max(0, self.loss_from - self.start)
        return min(room, free + loss_room, self.size())


class Packer:
    """Turns a stream of pieces into closed sequences (lists of pieces)."""

    def __init__(self, tokens: int = TOKENS, segments: int = SEGMENTS, loss: int = TOKENS,
                 cut: bool = True, pool: int = POOL):
        self.limits = np.array([tokens, segments, loss], float)
        self.cut, self.most = cut, pool
        self.pool: list[Piece | None] = []
        # Tokens in the pool; it is filled up with short pieces until they make a sequence.
        self.held = 0
        self.vectors = np.zeros((max(pool, tokens) + 2, 3))

    def add(self, piece: Piece) -> Iterator[list[Piece]]:
        tokens, _, loss = self.limits
        while piece.size():
            whole = piece.size() <= tokens and piece.loss() <= loss
            if whole and not (self.cut and piece.size() == tokens):
                break
            if not self.cut and not whole:
                raise ValueError(f"example {piece.key!r} exceeds the limits")
            size = piece.longest(int(tokens), int(loss))
            if size < tokens:
                break  # loss-bound; it shares a sequence
            full, piece = piece.split(size)
            yield [full]
        if piece.size():
            self._keep(piece)
        while len(self.pool) >= self.most and self.held >= tokens:
            yield self._fill()

    def end(self) -> Iterator[list[Piece]]:
        """What is left; a last sequence that isn't full, in powers of two if it may be cut."""
        while self.pool:
            bin_ = self._fill()
            size = sum(p.size() for p in bin_)
            if not self.cut or size == self.limits[0] or self.pool:
                yield bin_
                continue
            while bin_:
                want, part = 1 << (sum(p.size() for p in bin_).bit_length() - 1), []
                while want:
                    head = bin_.pop(0)
                    if head.size() > want:
                        head, rest = head.split(want)
                        bin_.insert(0, rest)
                    part.append(head)
                    want -= head.size()
                yield part

    def _keep(self, piece: Piece) -> None:
        self.vectors[len(self.pool)] = (piece.size(), 1, piece.loss())
        self.pool.append(piece)
        self.held += piece.size()

    def _take(self, i: int) -> Piece:
        piece, last = self.pool[i], self.pool.pop()
        self.held -= piece.size()
        if i < len(self.pool):
            self.pool[i] = last
            self.vectors[i] = self.vectors[len(self.pool)]
        return piece

    def _fill(self) -> list[Piece]:
        room, bin_ = self.limits.copy(), []
        while self.pool and room[0] >= 1 and room[1] >= 1:
            vectors = self.vectors[: len(self.pool)]
            worth = (vectors / self.limits) @ (room / self.limits)
            fits = (vectors <= room).all(axis=1)
            if fits.any():
                piece = self._take(int(np.argmax(np.where(fits, worth, -1.0))))
            elif self.cut:
                i = int(np.argmax(worth))
                size = self.pool[i].longest(int(room[0]), int(room[2]))
                if not size:
                    break
                piece, rest = self._take(i).split(size)
                self._keep(rest)
            else:
                break
            bin_.append(piece)
            room -= (piece.size(), 1, piece.loss())
        return bin_


def as_bytes(ids: Sequence[int] | np.ndarray) -> bytes:
    """Ids as little-endian unsigned 32-bit numbers."""
    return np.asarray(ids, "<u4").tobytes()


SCHEMA = pa.schema(
    [("start", pa.int64()), ("length", pa.int64()), ("ids_crc32", pa.int64()), ("doc_tokens", pa.int64()),
     ("sequence_id", pa.int64()), ("offset", pa.int64())]
)


def rows_of(sequences: Iterator[list[Piece]], first_id: int) -> Iterator[tuple]:
    for number, pieces in enumerate(sequences):
        offset = 0
        for p in pieces:
            yield (p.key, p.start, p.size(), zlib.crc32(p.ids), p.total, first_id + number, offset)
            offset += p.size()


def pack_documents(docs: DataFrame, path: str, id_col: str = "doc_id", text_col: str = "text",
                   prompt_col: str | None = None, tokens: int = TOKENS, segments: int = SEGMENTS,
                   loss: int = TOKENS) -> DataFrame:
    """``doc_id, start, length, ids_crc32, doc_tokens, sequence_id, offset``: a row per piece.

    ``path`` is a byte-level BPE file of the ``tokenizers`` library. An example is the ids of its
    prompt, if there is one, of its text, and the end id; those of the prompt bear no loss.
    """
    spark = docs.sparkSession
    table = frequent_table(frequent_stretches(docs, text_col, id_col), path, as_bytes)
    shared = spark.sparkContext.broadcast(table)
    prompt = whole_text(prompt_col) if prompt_col else F.lit("")
    narrow = docs.select(F.col(id_col).alias("doc_id"), whole_text(text_col).alias("text"), prompt.alias("prompt"))
    if not prompt_col:
        narrow = narrow.drop("prompt")
    kind = narrow.schema["doc_id"].dataType.simpleString()

    def packed(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        lookup = kept_pieces(path, as_bytes, shared.value)
        packer = Packer(tokens, segments, loss)
        key_type: list[pa.DataType] = [pa.int64()]

        def sequences() -> Iterator[list[Piece]]:
            end = as_bytes([END_ID])
            for batch in batches:
                key_type[0] = batch.column(0).type
                keys = batch.column(0).to_pylist()
                prompts = dict(lookup.ids(batch.column(2))) if prompt_col else {}
                for n, ids in lookup.ids(batch.column(1)):
                    before = prompts.get(n, b"")
                    ids = before + ids + end
                    yield from packer.add(Piece(keys[n], ids, 0, len(ids) // 4, len(ids) // 4, len(before) // 4))
            yield from packer.end()

        rows: list[tuple] = []

        def flushed() -> pa.RecordBatch:
            columns = list(zip(*rows))
            arrays = [pa.array(columns[0], key_type[0])]
            arrays += [pa.array(x, field.type) for x, field in zip(columns[1:], SCHEMA)]
            rows.clear()
            return pa.RecordBatch.from_arrays(arrays, names=["doc_id", *SCHEMA.names])

        for row in rows_of(sequences(), TaskContext.get().partitionId() << 40):
            rows.append(row)
            if len(rows) >= 10_000:
                yield flushed()
        if rows:
            yield flushed()
        give_back()

    return narrow.mapInArrow(
        packed,
        f"doc_id {kind}, start long, length long, ids_crc32 long, doc_tokens long, sequence_id long, offset long",
    )
