"""Remove repeated byte strings by a distributed merge sort of suffixes.

A byte goes if a string of ``LENGTH`` bytes that covers it also starts earlier: in a document
with a smaller id, or in the same one further left. Not all suffixes are sorted, but those at
anchors: in each window of ``LENGTH`` bytes the anchor is the ``KMER``-byte string with the
smallest hash (the leftmost of equals). Equal windows have their anchor at the same offset, so
repeats of a window are found among suffixes that start with the same anchor.

1. Documents are dealt to blocks by id. Each block lists its anchors' hashes; hash ranges count
   them, and each block learns which of its anchors occur again. Others are done.
2. Each block sorts the suffixes at the remaining anchors (``LENGTH`` bytes, then the bytes
   before the anchor, backwards) and sends them as front-coded sorted runs. Equal suffixes of
   one block travel once.
3. Runs are merged ``FAN`` at a time by a loser tree that carries the length of the common prefix
   of each candidate with the last output: it compares those lengths first and bytes only beyond
   a common prefix. Of equal suffixes one goes on. Each level deals the merged runs to more
   ranges, so that what a task merges stays the same while runs stay long. In the last level,
   which has all suffixes of a range, windows are equal where the prefix to the right and the one
   to the left are long enough; the earliest of equal windows stays.
4. The spans to remove return to their blocks.

An anchor that occurs over ``CROWDED`` times (a line a third of all documents share) is replaced
by the windows it stands for. Each is dealt by its own hash; a block merges equal ones (by hash,
then byte by byte) before it makes rows of them, a limited number at a time, and each level
of merging sends one of them on, so a window that all blocks have is ``FAN`` rows for a task.

Defined results: a null text is empty; texts shorter than ``LENGTH`` stay whole; a null id
stands before all others; rows with equal ids are ordered by their text; equal rows by their
place in the block, so all but one lose their repeats; an empty table gives no rows.
"""

from __future__ import annotations

import math
from collections.abc import Iterator
from dataclasses import dataclass

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame, functions as F

from holdfast.llm.tables import whole_text

LENGTH, KMER = 100, 32
# Bytes of text in a block, anchors in a range of hashes and in one of suffixes, about; bytes hashed
# at a time.
BLOCK_BYTES, RANGE_HASHES, RANGE_ANCHORS, SLICE = 4 << 20, 400_000, 200_000, 1 << 20
# An anchor that occurs more often is dealt window by window; windows in a range, about; rows that
# are built and sorted at a time.
CROWDED, RANGE_WINDOWS, ROWS = 20_000, 200_000, 1 << 16
# Blocks, or merged groups of them, whose runs meet in a task.
FAN = 1024

c = F.col
U = np.uint64


# Anchors


def _finish(h: np.ndarray) -> np.ndarray:
    with np.errstate(over="ignore"):
        h = (h ^ (h >> U(32))) * U(0x9E3779B97F4A7C15)
        h = (h ^ (h >> U(29))) * U(0xBF58476D1CE4E5B9)
    return h ^ (h >> U(32))


def string_hashes(data: np.ndarray, length: int) -> np.ndarray:
    """Hash of the ``length`` bytes from each position on: longer ones from two shorter ones."""
    size = len(data) - length + 1
    with np.errstate(over="ignore"):
        part = (data.astype(U) + U(1)) * U(0xD6E8FEB86659FD93)
        done, width, result = 0, 1, None
        while done < length:
            if length & width:
                piece = part[done : done + size]
                result = piece.copy() if result is None else result * U(0xC2B2AE3D27D4EB4F) + piece
                done += width
            if done < length:
                part = part[:-width] * U(0x9E3779B185EBCA87 + 2 * width) + part[width:]
                width *= 2
    return _finish(result)


def anchors_of(data: np.ndarray, length: int = LENGTH, kmer: int = KMER) -> tuple[np.ndarray, ...]:
    """``position, first window, last window, hash`` of the anchors of one document.

    Long documents are cut into slices whose windows don't overlap; an anchor on both sides of
    a cut is listed twice, with different windows.
    """
    found, wide = [], length - kmer + 1
    for low in range(0, len(data) - length + 1, SLICE):
        high = min(low + SLICE, len(data) - length + 1)
        hashes = string_hashes(data[low : high + length - 1], kmer)
        # Hash above the position: the smallest is the anchor, the leftmost of equals.
        least = (hashes & ~U(0xFFFFFF)) | np.arange(len(hashes), dtype=U)
        reach = 1
        while 2 * reach <= wide:
            least = np.minimum(least[:-reach], least[reach:])
            reach *= 2
        if reach < wide:
            least = np.minimum(least[: -(wide - reach)], least[wide - reach :])
        at = (least & U(0xFFFFFF)).astype(np.int64)
        first = np.flatnonzero(np.concatenate([[True], at[1:] != at[:-1]]))
        last = np.concatenate([first[1:] - 1, [len(at) - 1]])
        places = ((low + x).astype(np.int32) for x in (at[first], first, last))
        found.append((*places, hashes[at[first]]))
    if not found:
        return tuple(np.zeros(0, t) for t in (np.int32, np.int32, np.int32, U))
    return tuple(np.concatenate(x) for x in zip(*found))


class Block:
    """The documents of a block in order, as one array of bytes, with their anchors."""

    def __init__(self, table: pa.Table, length: int, kmer: int):
        ids = table.column("doc_id").to_pylist()
        texts = [x.encode() for x in table.column("text").to_pylist()]
        rank = sorted(range(len(ids)), key=lambda i: (ids[i] is not None, ids[i] or 0, texts[i]))
        self.ids = [ids[i] for i in rank]
        self.texts = [texts[i] for i in rank]
        self.order = np.array([-(1 << 63) if x is None else x for x in self.ids], np.int64)
        self.starts = np.concatenate([[0], np.cumsum([len(x) for x in self.texts])]).astype(np.int64)
        self.data = np.frombuffer(b"".join(self.texts), np.uint8)
        parts = [anchors_of(self.data[a:b], length, kmer) for a, b in zip(self.starts, self.starts[1:])]
        sizes = [len(p[0]) for p in parts]
        self.doc = np.repeat(np.arange(len(parts), dtype=np.int32), sizes)
        self.at, self.first, self.last, hashes = (np.concatenate(x) for x in zip(*parts))
        self.code = _finish(hashes)


def _range_of(code: np.ndarray, ranges: int) -> np.ndarray:
    return ((code >> U(32)) * U(ranges) >> U(32)).astype(np.int64)


# Step 1: which anchors occur again


def _hash_lists(key, table: pa.Table, ranges: int, length: int, kmer: int) -> pa.Table:
    """The block's anchor hashes for each range: 32 bits of each, and how often it has them."""
    block = Block(table, length, kmer)
    code, count = np.unique(block.code, return_counts=True)
    place = _range_of(code, ranges)
    cuts = np.searchsorted(place, np.arange(ranges + 1))
    rows = [(r, low, high) for r, (low, high) in enumerate(zip(cuts, cuts[1:])) if low < high]
    return pa.table(
        {
            "range": pa.array([r for r, *_ in rows], pa.int64()),
            "block": pa.array([key[0].as_py()] * len(rows), pa.int64()),
            "hashes": pa.array([code[a:b].astype("<u4").tobytes() for _, a, b in rows], pa.binary()),
            "counts": pa.array([np.minimum(count[a:b], 65535).astype("<u2").tobytes() for _, a, b in rows], pa.binary()),
        }
    )


def _repeated(key, table: pa.Table, crowded: int) -> pa.Table:
    """For each block its hashes that occur again, and which of them are crowded.

    32 bits beside the range can agree by chance; that only sends an anchor on.
    """
    lists = [np.frombuffer(x, "<u4") for x in table.column("hashes").to_pylist()]
    counts = [np.frombuffer(x, "<u2") for x in table.column("counts").to_pylist()]
    values, where = np.unique(np.concatenate(lists), return_inverse=True)
    total = np.bincount(where, np.concatenate(counts)).astype(np.int64)
    low, out = 0, []
    for block, own in zip(table.column("block").to_pylist(), lists):
        mine = total[where[low : low + len(own)]]
        low += len(own)
        if (mine > 1).any():
            again = mine > 1
            out.append((block, own[again].tobytes(), (mine[again] > crowded).astype(np.uint8).tobytes()))
    return pa.table(
        {
            "block": pa.array([x[0] for x in out], pa.int64()),
            "range": pa.array([key[0].as_py()] * len(out), pa.int64()),
            "hashes": pa.array([x[1] for x in out], pa.binary()),
            "crowded": pa.array([x[2] for x in out], pa.binary()),
        }
    )


# Step 2: front-coded sorted runs


def suffix_rows(data: np.ndarray, low: np.ndarray, high: np.ndarray, at: np.ndarray, length: int,
                left: int) -> np.ndarray:
    """A row per suffix: ``length`` bytes from ``at``, their number, ``left`` bytes before it
    backwards, their number. Bytes outside ``low`` to ``high`` are zeros, told by the numbers."""
    rows = np.zeros((len(at), length + left + 2), np.uint8)
    if not len(at):
        return rows
    padded = np.concatenate([data, np.zeros(1, np.uint8)])
    right_n, left_n = np.minimum(high - at, length), np.minimum(at - low, left)
    rows[:, length], rows[:, -1] = right_n, left_n
    right, back = np.arange(length), np.arange(left)
    # The places of all bytes take eight times the rows' room.
    for a in range(0, len(at), 8192):
        part = slice(a, a + 8192)
        start = at[part, None]
        rows[part, :length] = np.where(right < right_n[part, None], padded[np.minimum(start + right, len(data))], 0)
        rows[part, length + 1 : -1] = np.where(back < left_n[part, None], padded[np.maximum(start - 1 - back, 0)], 0)
    return rows


def common_prefixes(rows: np.ndarray) -> np.ndarray:
    """Common prefix of each row with the one before (0 for the first)."""
    result = np.zeros(len(rows), np.int64)
    if len(rows) > 1:
        differ = rows[1:] != rows[:-1]
        result[1:] = np.where(differ.any(axis=1), differ.argmax(axis=1), rows.shape[1])
    return result


def sorted_order(rows: np.ndarray, *ties: np.ndarray) -> np.ndarray:
    """Order of the rows by their bytes, ties as given."""
    if not len(rows):
        return np.zeros(0, np.int64)
    width = rows.shape[1]
    order = np.lexsort(ties[::-1]) if ties else np.arange(len(rows))
    # Fixed-size byte strings compare like memory; a last byte that is never 0 keeps zeros.
    keyed = np.empty(len(rows), f"S{width + 1}")
    raw = keyed.view(np.uint8).reshape(len(rows), width + 1)
    raw[:, :width] = rows[order]
    raw[:, width] = 1
    return order[np.argsort(keyed, kind="stable")]


def front_coded(rows: np.ndarray) -> tuple[bytes, bytes]:
    """Prefix lengths shared with the row before, and the bytes after them."""
    prefix = common_prefixes(rows)
    rest = rows[np.arange(rows.shape[1]) >= prefix[:, None]]
    return prefix.astype(np.uint8).tobytes(), rest.tobytes()


def front_decoded(prefix: bytes, rest: bytes, width: int) -> tuple[np.ndarray, np.ndarray]:
    """The rows, and the prefix of each with the one before."""
    shared = np.frombuffer(prefix, np.uint8).astype(np.int64)
    own = np.arange(width) >= shared[:, None]
    rows = np.zeros((len(shared), width), np.uint8)
    rows[own] = np.frombuffer(rest, np.uint8)
    # Where a byte is shared, it is that of the last row that has its own.
    source = np.where(own, np.arange(len(shared))[:, None], 0)
    np.maximum.accumulate(source, axis=0, out=source)
    return np.take_along_axis(rows, source, axis=0), shared


# A suffix: its document's id, its place, the windows it stands for, and what deals it to a range.
ENTRY = np.dtype(
    [("order", "<i8"), ("doc", "<i4"), ("at", "<i4"), ("low", "<i2"), ("high", "<i2"), ("code", "<u4")]
)


@dataclass(frozen=True)
class Deal:
    """Ranges of a level: for suffixes at anchors, and for windows."""

    anchors: int
    windows: int

    def range_of(self, code: np.ndarray, window: bool) -> np.ndarray:
        count = self.windows if window else self.anchors
        return (code.astype(U) * U(count) >> U(32)).astype(np.int64) + (self.anchors if window else 0)


def _spans(block: int, doc, start, end) -> tuple:
    """Spans to remove, as one row."""
    packed = np.stack([np.asarray(doc), np.asarray(start), np.asarray(end)], axis=1).astype("<i8")
    return (block, packed.tobytes())


RUN_ARROW = pa.schema(
    [("range", pa.int64()), ("block", pa.int64())]
    + [(x, pa.binary()) for x in ("entries", "blocks", "prefix", "rest", "spans")]
)
RUN_SCHEMA = "range long, block long, entries binary, blocks binary, prefix binary, rest binary, spans binary"


def _run_table(rows: list[tuple]) -> pa.Table:
    columns = list(zip(*rows)) or [[]] * len(RUN_ARROW)
    return pa.table([pa.array(x, f.type) for x, f in zip(columns, RUN_ARROW)], schema=RUN_ARROW)


def _span_rows(blocks: np.ndarray, doc, start, end, ranges: int) -> Iterator[tuple]:
    """A row for each block that the spans return to."""
    order = np.argsort(blocks, kind="stable")
    numbers, cuts = np.unique(blocks[order], return_index=True)
    for number, a, b in zip(numbers.tolist(), cuts.tolist(), [*cuts[1:].tolist(), len(order)]):
        own = order[a:b]
        yield (number % ranges, number, None, None, None, None, _spans(number, doc[own], start[own], end[own])[1])


def _run_rows(source: int, rows: np.ndarray, entries: np.ndarray, blocks: np.ndarray | None, deal: Deal,
              window: bool) -> Iterator[tuple]:
    """Sorted rows as a run for each range."""
    place = deal.range_of(entries["code"], window)
    by_range = np.argsort(place, kind="stable")
    numbers, cuts = np.unique(place[by_range], return_index=True)
    for r, a, b in zip(numbers.tolist(), cuts, [*cuts[1:], len(by_range)]):
        own = by_range[a:b]
        origin = None if blocks is None else blocks[own].astype("<i8").tobytes()
        yield (r, source, entries[own].tobytes(), origin, *front_coded(rows[own]), None)


def repeats(same: np.ndarray, entries: np.ndarray) -> np.ndarray:
    """Which of sorted rows (``same`` as the one before) equal one of an earlier suffix: the first
    in order goes on, the others' windows are repeats. A suffix listed twice, with different
    windows, is no repeat of itself."""
    if not same.any():
        return same
    group = np.cumsum(~same) - 1
    order = np.lexsort((entries["at"], entries["doc"], entries["order"], group))
    heads = np.flatnonzero(np.concatenate([[True], group[order][1:] != group[order][:-1]]))
    first = entries[order[heads][group]]
    return (entries["at"] != first["at"]) | (entries["doc"] != first["doc"]) | (entries["order"] != first["order"])


def distinct_windows(block: Block, crowd: np.ndarray, length: int) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
    """Windows of the crowded anchors: places and hashes of the different ones, and places of those
    that equal an earlier one byte by byte."""
    data = block.data
    mark = np.zeros(len(data) + 1, np.int8)
    begin = block.starts[block.doc[crowd]] + block.first[crowd]
    np.add.at(mark, begin, 1)
    np.add.at(mark, begin + block.last[crowd] - block.first[crowd] + 1, -1)
    inside = np.cumsum(mark[:-1], dtype=np.int8).astype(bool)
    known, known_at = np.zeros(0, U), np.zeros(0, np.int64)
    odd, odd_code, gone = [], [], []
    for low in range(0, len(data) - length + 1, SLICE):
        high = min(low + SLICE, len(data) - length + 1)
        at = np.flatnonzero(inside[low:high])
        if not len(at):
            continue
        code = string_hashes(data[low : high + length - 1], length)[at]
        at += low
        values, first, where = np.unique(code, return_index=True, return_inverse=True)
        old = np.minimum(np.searchsorted(known, values), max(0, len(known) - 1))
        seen = known[old] == values if len(known) else np.zeros(len(values), bool)
        twin = at[first]
        twin[seen] = known_at[old[seen]]
        other = np.flatnonzero(twin[where] != at)
        equal = np.ones(len(other), bool)
        offset = np.arange(length)
        for a in range(0, len(other), 8192):
            mine = other[a : a + 8192]
            equal[a : a + 8192] = (
                data[at[mine, None] + offset] == data[twin[where[mine]][:, None] + offset]
            ).all(axis=1)
        gone.append(at[other[equal]])
        odd.append(at[other[~equal]])
        odd_code.append(code[other[~equal]])
        merged_codes = np.concatenate([known, values[~seen]])
        merged_at = np.concatenate([known_at, twin[~seen]])
        order = np.argsort(merged_codes, kind="stable")
        known, known_at = merged_codes[order], merged_at[order]
    none = np.zeros(0, np.int64)
    return (
        np.concatenate([known_at, *odd]), np.concatenate([known, *odd_code]),
        np.concatenate(gone) if gone else none,
    )


def _runs(key, table: pa.Table, again: pa.Table, hash_ranges: int, deal: Deal, length: int, kmer: int) -> pa.Table:
    """The block's sorted runs, and the spans it can tell by itself."""
    out: list[tuple] = []
    number = key[0].as_py()
    if table.num_rows and again.num_rows:
        block, left = Block(table, length, kmer), length - kmer
        known = [
            (np.frombuffer(h, "<u4").astype(U) | U(r << 32), np.frombuffer(f, np.uint8))
            for r, h, f in zip(*(again.column(x).to_pylist() for x in ("range", "hashes", "crowded")))
        ]
        values = np.concatenate([x for x, _ in known])
        flags = np.concatenate([x for _, x in known])
        by_value = np.argsort(values)
        values, flags = values[by_value], flags[by_value]
        mine = _range_of(block.code, hash_ranges).astype(U) << U(32) | block.code & U(0xFFFFFFFF)
        at = np.minimum(np.searchsorted(values, mine), len(values) - 1)
        hit = values[at] == mine
        crowd = hit & (flags[at] == 1)
        hit &= ~crowd
        del mine, at

        doc = block.doc[hit]
        begin = block.starts[doc]
        entries = np.zeros(len(doc), ENTRY)
        entries["doc"], entries["at"], entries["order"] = doc, block.at[hit], block.order[doc]
        entries["low"] = block.at[hit] - block.last[hit]
        entries["high"] = block.at[hit] - block.first[hit]
        entries["code"] = block.code[hit] >> U(32)
        rows = suffix_rows(block.data, begin, block.starts[doc + 1], begin + block.at[hit], length, left)
        order = sorted_order(rows, entries["doc"], entries["at"])
        rows, entries = rows[order], entries[order]
        gone = repeats(common_prefixes(rows) == rows.shape[1], entries)
        e = entries[gone]
        out += _span_rows(np.full(len(e), number), e["doc"], e["at"] - e["high"], e["at"] - e["low"] + length, deal.anchors)
        out += _run_rows(number, rows[~gone], entries[~gone], None, deal, False)
        del rows, entries

        if crowd.any():
            place, code, gone = distinct_windows(block, crowd, length)
            if len(gone):
                starts = np.flatnonzero(np.concatenate([[True], gone[1:] != gone[:-1] + 1]))
                ends = gone[np.concatenate([starts[1:], [len(gone)]]) - 1]
                doc = np.searchsorted(block.starts, gone[starts], side="right") - 1
                base = block.starts[doc]
                out += _span_rows(
                    np.full(len(doc), number), doc, gone[starts] - base, ends - base + length, deal.anchors
                )
            for a in range(0, len(place), ROWS):
                at = place[a : a + ROWS]
                doc = np.searchsorted(block.starts, at, side="right") - 1
                entries = np.zeros(len(doc), ENTRY)
                entries["doc"], entries["at"], entries["order"] = doc, at - block.starts[doc], block.order[doc]
                entries["code"] = _finish(code[a : a + ROWS]) >> U(32)
                rows = suffix_rows(block.data, at, block.starts[doc + 1], at, length, left)
                order = sorted_order(rows, entries["doc"], entries["at"])
                out += _run_rows(number, rows[order], entries[order], None, deal, True)
    return _run_table(out)


# Step 3: the merge


def merged(runs: list[tuple[list[int], np.ndarray]], width: int) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
    """``run, place in it, common prefix with the output before`` of all rows in sorted order.

    Each run is its rows as big-endian integers and the prefix of each with the one before. A
    loser tree keeps, for each candidate, its common prefix with the last output: of two
    candidates the one with the longer prefix is smaller; only equal prefixes need bytes, and
    those only beyond the prefix.
    """
    k, end = 1, 1 << (8 * width + 1)
    while k < len(runs):
        k *= 2
    total = sum(len(rows) for rows, _ in runs)
    keys = [rows[0] if rows else end for rows, _ in runs] + [end] * (k - len(runs))
    prefixes = [0] * k
    place = [0] * k
    losers, bits = [0] * k, 8 * width

    def play(a: int, b: int) -> tuple[int, int]:
        """Winner and loser; the loser's prefix becomes its prefix with the winner."""
        if keys[a] == end or keys[b] == end:
            return (b, a) if keys[a] == end else (a, b)
        pa_, pb = prefixes[a], prefixes[b]
        if pa_ != pb:
            return (a, b) if pa_ > pb else (b, a)
        shift = bits - 8 * pa_
        x, y = keys[a] & ((1 << shift) - 1), keys[b] & ((1 << shift) - 1)
        if x <= y:
            prefixes[b] = width - -(-(x ^ y).bit_length() // 8)
            return a, b
        prefixes[a] = width - -(-(x ^ y).bit_length() // 8)
        return b, a

    def first_winner(node: int) -> int:
        if node >= k:
            return node - k
        winner, losers[node] = play(first_winner(2 * node), first_winner(2 * node + 1))
        return winner

    out_run, out_place = np.zeros(total, np.int32), np.zeros(total, np.int32)
    out_prefix = np.zeros(total, np.int32)
    if not total:
        return out_run, out_place, out_prefix
    winner = first_winner(1)
    shared = [prefix.tolist() for _, prefix in runs]
    for n in range(total):
        i = place[winner]
        out_run[n], out_place[n], out_prefix[n] = winner, i, prefixes[winner]
        place[winner] = i = i + 1
        rows = runs[winner][0]
        if i < len(rows):
            keys[winner], prefixes[winner] = rows[i], shared[winner][i]
        else:
            keys[winner] = end
        node = (winner + k) // 2
        while node:
            winner, losers[node] = play(winner, losers[node])
            node //= 2
    return out_run, out_place, out_prefix


def repeated_windows(rows: np.ndarray, prefix: np.ndarray, entries: np.ndarray, length: int,
                     kmer: int) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
    """``entry, first offset, last offset`` of windows that also start earlier.

    ``rows`` are suffixes in sorted order, ``prefix`` their common prefixes with the one before.
    An entry stands for the windows that begin ``low`` to ``high`` bytes before it.
    """
    width = rows.shape[1]
    none = np.zeros(0, np.int64)
    if not len(rows):
        return none, none, none
    places = np.rec.fromarrays([entries["order"], entries["doc"], entries["at"]])
    rank = np.unique(places, return_inverse=True)[1].ravel()
    starts = np.flatnonzero(prefix < width)
    group = np.cumsum(prefix < width) - 1
    later = rank > np.minimum.reduceat(rank, starts)[group]
    found = [(np.flatnonzero(later), entries["low"][later], entries["high"][later])]

    # The earliest of each kind of suffix; others with the same anchor differ further out.
    heads = np.flatnonzero(~later)
    right = np.minimum(prefix, length)
    # Prefix with the head before: the smallest on the way from it.
    between = np.minimum.reduceat(right, np.concatenate([[0], heads[:-1] + 1])) if len(heads) else right
    between[0] = 0
    right_n = rows[heads, length].astype(np.int64)
    clipped = between.copy()
    clipped[1:] = np.minimum(clipped[1:], np.minimum(right_n[1:], right_n[:-1]))
    family = np.cumsum(clipped < kmer)
    many = np.bincount(family)[family] > 1
    heads, clipped = heads[many], clipped[many]
    if len(heads):
        lefts = rows[heads, length + 1 :]
        by_left = sorted_order(lefts)
        sorted_left = lefts[by_left]
        left_prefix = common_prefixes(sorted_left[:, :-1])
        left_n = sorted_left[:, -1].astype(np.int64)
        left_prefix[1:] = np.minimum(left_prefix[1:], np.minimum(left_n[1:], left_n[:-1]))
        low, high, ranks = entries["low"][heads], entries["high"][heads], rank[heads]
        by_rank = np.argsort(ranks, kind="stable")
        gone = np.zeros((len(heads), length - kmer + 3), bool)
        for offset in range(length - kmer + 1):
            mine = by_rank[(low[by_rank] <= offset) & (high[by_rank] >= offset)]
            if not len(mine):
                continue
            run = np.cumsum(clipped < length - offset)
            name = np.empty(len(heads), np.int64)
            name[by_left] = np.cumsum(left_prefix < offset)
            key = run[mine] * len(heads) * 2 + name[mine]
            order = np.argsort(key, kind="stable")
            again = np.concatenate([[False], key[order][1:] == key[order][:-1]])
            gone[mine[order[again]], offset + 1] = True
        edges = np.diff(gone.astype(np.int8), axis=1)
        which, begin = np.nonzero(edges == 1)
        _, stop = np.nonzero(edges == -1)
        found.append((heads[which], begin, stop - 1))
    return tuple(np.concatenate(x).astype(np.int64) for x in zip(*found))


def _merged_range(table: pa.Table, width: int) -> tuple[np.ndarray, ...] | None:
    """``rows, prefix, entries, blocks`` of all runs of a range in sorted order."""
    runs, entries, blocks, all_rows = [], [], [], []
    columns = (table.column(x).to_pylist() for x in ("block", "entries", "blocks", "prefix", "rest"))
    for source, e, origin, p, r in zip(*columns):
        if e is None:
            continue
        rows, prefix = front_decoded(p, r, width)
        flat = rows.tobytes()
        runs.append(([int.from_bytes(flat[i : i + width]) for i in range(0, len(flat), width)], prefix))
        all_rows.append(rows)
        entries.append(np.frombuffer(e, ENTRY))
        blocks.append(np.full(len(rows), source) if origin is None else np.frombuffer(origin, "<i8"))
    if not runs:
        return None
    run, place, prefix = merged(runs, width)
    first = np.cumsum([0] + [len(x) for x in entries])
    at = first[run] + place
    return (np.concatenate(all_rows)[at], prefix.astype(np.int64), np.concatenate(entries)[at],
            np.concatenate(blocks)[at])


def _own_span_rows(table: pa.Table) -> list[tuple]:
    """Spans that earlier steps found, passed on."""
    return [
        (r, block, None, None, None, None, s)
        for r, block, s in zip(*(table.column(x).to_pylist() for x in ("range", "block", "spans"))) if s is not None
    ]


def _combine(key, table: pa.Table, before: Deal, after: Deal, length: int, kmer: int) -> pa.Table:
    """Runs of a group of sources as runs for the next level, equal suffixes once."""
    out, source = _own_span_rows(table), key[1].as_py()
    found = _merged_range(table, 2 * length - kmer + 2)
    if found:
        rows, prefix, entries, blocks = found
        gone = repeats(prefix == rows.shape[1], entries)
        e = entries[gone]
        out += _span_rows(blocks[gone], e["doc"], e["at"] - e["high"], e["at"] - e["low"] + length, after.anchors)
        window = key[0].as_py() >= before.anchors
        out += _run_rows(source, rows[~gone], entries[~gone], blocks[~gone], after, window)
    return _run_table(out)


def _level(before: Deal, after: Deal, length: int, kmer: int):
    return lambda key, t: _combine(key, t, before, after, length, kmer)


def _merge(key, table: pa.Table, length: int, kmer: int) -> pa.Table:
    """Spans to remove, for each block, from all runs of a range."""
    out = [(block, s) for _, block, *_, s in _own_span_rows(table)]
    found = _merged_range(table, 2 * length - kmer + 2)
    if found:
        rows, prefix, entry, block = found
        which, low, high = repeated_windows(rows, prefix, entry, length, kmer)
        e = entry[which]
        spans = _span_rows(block[which], e["doc"], e["at"] - high, e["at"] - low + length, 1)
        out += [(number, s) for _, number, *_, s in spans]
    return pa.table({"block": pa.array([x[0] for x in out], pa.int64()),
                     "spans": pa.array([x[1] for x in out], pa.binary())})


# Step 4: the texts without their repeats


def union_of(starts: np.ndarray, ends: np.ndarray) -> list[tuple[int, int]]:
    """Maximal runs covered by the spans."""
    order = np.argsort(starts, kind="stable")
    starts, reach = starts[order], np.maximum.accumulate(ends[order])
    new = np.flatnonzero(np.concatenate([[True], starts[1:] > reach[:-1]]))
    last = np.concatenate([new[1:] - 1, [len(starts) - 1]])
    return list(zip(starts[new].tolist(), reach[last].tolist()))


def _cut(table: pa.Table, spans: pa.Table, id_type: pa.DataType) -> pa.Table:
    ids = table.column("doc_id").to_pylist()
    texts = [x.encode() for x in table.column("text").to_pylist()]
    rank = sorted(range(len(ids)), key=lambda i: (ids[i] is not None, ids[i] or 0, texts[i]))
    all_spans = np.frombuffer(b"".join(spans.column("spans").to_pylist()), "<i8").reshape(-1, 3)
    all_spans = all_spans[np.argsort(all_spans[:, 0], kind="stable")]
    cuts = np.searchsorted(all_spans[:, 0], np.arange(len(ids) + 1))
    removed, kept = [], []
    for n, i in enumerate(rank):
        own = all_spans[cuts[n] : cuts[n + 1]]
        runs = union_of(own[:, 1], own[:, 2]) if len(own) else []
        at, parts = 0, []
        for start, end in runs:
            parts.append(texts[i][at:start])
            at = end
        parts.append(texts[i][at:])
        removed.append([{"start": a, "end": b} for a, b in runs])
        kept.append(b"".join(parts))
    span = pa.struct([("start", pa.int64()), ("end", pa.int64())])
    return pa.table(
        {
            "doc_id": pa.array([ids[i] for i in rank], id_type),
            "n_bytes": pa.array([len(texts[i]) for i in rank], pa.int64()),
            "spans": pa.array(removed, pa.list_(span)),
            "kept": pa.array(kept, pa.binary()),
        }
    )


def levels(blocks: int, total: int, length: int, kmer: int, fan: int) -> list[Deal]:
    """The ranges of each level of merging. A level that merges ``fan`` sources in each of so many
    groups needs the fewer ranges; the last has one group, and the ranges of the whole text."""
    # About two anchors in each window less one; a fraction of them occurs again.
    anchors, windows = 2 * total / (length - kmer + 2) / RANGE_ANCHORS, total / RANGE_WINDOWS
    result, sources = [], blocks
    while True:
        groups = math.ceil(sources / fan) if sources > fan else 1
        result.append(Deal(max(1, math.ceil(anchors / groups)), max(1, math.ceil(windows / groups))))
        if groups == 1:
            return result
        sources = groups


def without_repeats(docs: DataFrame, length: int = LENGTH, kmer: int = KMER, block_bytes: int = BLOCK_BYTES,
                    crowded: int = CROWDED, fan: int = FAN, id_col: str = "doc_id", text_col: str = "text") -> DataFrame:
    """``doc_id, n_bytes, spans, kept``: the removed runs of each document and what is left."""
    if not 1 < kmer < length <= 255 or 2 * length - kmer + 2 > 255:
        raise ValueError("a suffix with its numbers has at most 255 bytes")
    narrow = docs.select(c(id_col).cast("long").alias("doc_id"), whole_text(text_col).alias("text"))
    total = narrow.agg(F.sum(F.octet_length("text"))).first()[0] or 0
    blocks = max(1, math.ceil(total / block_bytes))
    deals = levels(blocks, total, length, kmer, fan)
    hash_ranges = max(1, math.ceil(2 * total / (length - kmer + 2) / RANGE_HASHES))
    dealt = narrow.withColumn("block", F.pmod(F.xxhash64("doc_id"), F.lit(blocks)))
    by_block = dealt.select("block", "doc_id", "text").groupBy("block")

    lists = by_block.applyInArrow(
        lambda key, t: _hash_lists(key, t, hash_ranges, length, kmer),
        "range long, block long, hashes binary, counts binary",
    )
    again = lists.groupBy("range").applyInArrow(
        lambda key, t: _repeated(key, t, crowded), "block long, range long, hashes binary, crowded binary"
    )
    runs = by_block.cogroup(again.groupBy("block")).applyInArrow(
        lambda key, t, a: _runs(key, t, a, hash_ranges, deals[0], length, kmer), RUN_SCHEMA
    )
    for before, after in zip(deals, deals[1:]):
        # The runs of a group go on as those of one source; spans keep the block they return to.
        group = F.floor(c("block") / fan).alias("group")
        runs = runs.groupBy("range", group).applyInArrow(_level(before, after, length, kmer), RUN_SCHEMA)
    spans = runs.groupBy("range").applyInArrow(
        lambda key, t: _merge(key, t, length, kmer), "block long, spans binary"
    )
    return by_block.cogroup(spans.groupBy("block")).applyInArrow(
        lambda key, t, s: _cut(t, s, pa.int64()),
        "doc_id long, n_bytes long, spans array<struct<start: long, end: long>>, kept binary",
    )


def repeat_report(docs: DataFrame) -> DataFrame:
    """``doc_id, n_bytes, n_removed, n_spans, kept_sha256``."""
    sizes = F.transform("spans", lambda x: x["end"] - x["start"])
    return without_repeats(docs).select(
        "doc_id",
        "n_bytes",
        F.aggregate(sizes, F.lit(0).cast("long"), lambda a, x: a + x).alias("n_removed"),
        F.size("spans").cast("long").alias("n_spans"),
        F.sha2("kept", 256).alias("kept_sha256"),
    )
