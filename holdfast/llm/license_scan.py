"""License texts in documents: winnowed fingerprints, an inverted index, banded alignment.

Templates are cut into word shingles; winnowing keeps the smallest hash of each window of them,
and an inverted index leads from a kept hash to (template, place). A document's shingles are
winnowed the same way, so any stretch of ``SHINGLE + WINDOW - 1`` equal words shares a kept hash
(``LONG_SHINGLE + LONG_WINDOW - 1`` with a template of over ``LONG`` words).
Hits that lie near one diagonal make a candidate, and a sequence alignment in a band around it
tells how many of the template's words the document has in order, and where. The templates are
full texts, headers and notices (``license_texts``).

The index is small and fixed by the templates, and is broadcast; scanning is one pass without a
shuffle. Words that no template has can't be in a shingle of one, so only stretches of known
words are hashed.

Defined results: a null text is empty; texts are read whole; an empty text, or one without a
template's words, gives no rows; each occurrence gives a row; repeated rows and null ids are
scanned like others; of templates that match the same words the one with more matched words,
less the words skipped between them, stays, then the shorter one, then the first by name and
place; a word counts for one row only; an empty table gives no rows.
"""

from __future__ import annotations

import heapq
import re
from collections.abc import Iterator
from dataclasses import dataclass

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame, functions as F

from holdfast.llm import license_texts
from holdfast.llm.tables import whole_text

SHINGLE, WINDOW, BAND, COVERAGE = 3, 2, 8, 0.8
# Templates of more words are found by longer shingles: short ones stand in any English text.
LONG, LONG_SHINGLE, LONG_WINDOW = 100, 8, 4

TEMPLATES = license_texts.templates()

_WORD = re.compile(r"[^\W_]+")
NONE = np.iinfo(np.int64).max


def words_of(text: str) -> list[str]:
    """Words in lower case; cut first, as some letters are more than one when lowered."""
    return [x.lower() for x in _WORD.findall(text)]


def shingle_hashes(codes: np.ndarray, shingle: int) -> np.ndarray:
    """Hash of each run of word codes; runs with an unknown word (-1) have the largest one."""
    n = len(codes) - shingle + 1
    if n <= 0:
        return np.zeros(0, np.int64)
    total, known = np.zeros(n, np.uint64), np.ones(n, bool)
    with np.errstate(over="ignore"):
        for j in range(shingle):
            part = codes[j : j + n]
            known &= part >= 0
            total = (total ^ part.astype(np.uint64)) * np.uint64(0x9E3779B97F4A7C15)
            total ^= total >> np.uint64(29)
    return np.where(known, (total >> np.uint64(1)).astype(np.int64), NONE)


def winnowed(hashes: np.ndarray, window: int) -> np.ndarray:
    """Places of the smallest hash in each window, the rightmost of equals."""
    if not len(hashes):
        return np.zeros(0, np.int64)
    window = min(window, len(hashes))
    views = np.lib.stride_tricks.sliding_window_view(hashes, window)[:, ::-1]
    at = np.unique(np.arange(len(views)) + window - 1 - views.argmin(axis=1))
    return at[hashes[at] != NONE]


@dataclass
class Index:
    """Word codes, templates as codes, and postings of kept hashes by shingle and window."""

    names: list[str]
    vocabulary: dict[str, int]
    codes: list[np.ndarray]
    # Distinct words of each template, and how often each stands there.
    counts: list[tuple[np.ndarray, np.ndarray]]
    postings: dict[tuple[int, int], dict[int, list[tuple[int, int]]]]

    @staticmethod
    def of(templates: dict[str, str], shingle: int = SHINGLE, window: int = WINDOW) -> "Index":
        names = sorted(templates)
        words = [words_of(templates[n]) for n in names]
        vocabulary = {w: i for i, w in enumerate(sorted({w for ws in words for w in ws}))}
        codes = [np.array([vocabulary[w] for w in ws], np.int64) for ws in words]
        counts = [np.unique(x, return_counts=True) for x in codes]
        postings: dict[tuple[int, int], dict[int, list[tuple[int, int]]]] = {}
        for t, template in enumerate(codes):
            cut = (shingle, window) if len(template) <= LONG else (LONG_SHINGLE, LONG_WINDOW)
            hashes = shingle_hashes(template, cut[0])
            own = postings.setdefault(cut, {})
            for place in winnowed(hashes, cut[1]).tolist():
                own.setdefault(int(hashes[place]), []).append((t, place))
        return Index(names, vocabulary, codes, counts, postings)

    def hits(self, codes: np.ndarray) -> list[tuple[int, int]]:
        """Template and diagonal of each kept hash that a text shares."""
        found = []
        for (shingle, window), postings in self.postings.items():
            hashes = shingle_hashes(codes, shingle)
            found += [(t, place - at) for place in winnowed(hashes, window).tolist()
                      for t, at in postings.get(int(hashes[place]), ())]
        return found

    def most(self, t: int, codes: np.ndarray) -> int:
        """No alignment of the template matches more: its words that the text has, in any order."""
        present = np.bincount(codes[codes >= 0], minlength=len(self.vocabulary))
        return int(np.minimum(present[self.counts[t][0]], self.counts[t][1]).sum())


def banded(template: np.ndarray, words: np.ndarray, diagonal: int, band: int) -> list[int]:
    """Places in ``words`` of the template's words that are matched in order.

    Longest common subsequence among cells (i, j) with ``|j - i - diagonal| <= band``; of equal
    ones the shortest stretch, then the first.
    """
    width, unit = 2 * band + 1, len(words) + 1
    # A cell is matches * unit + place of the first match: the latest start is the shortest stretch.
    rows = [[0] * (width + 2)]
    best, at = (0, 0, 0), None
    known = words.tolist()
    for i, word in enumerate(template.tolist()):
        above, row = rows[-1], [0] * (width + 2)
        for d in range(width):
            j = i + diagonal - band + d
            # Skips a word of the template (from above) or of the text (from the left).
            here = max(above[d + 2], row[d])
            if 0 <= j < len(known) and known[j] == word:
                met = above[d + 1] + unit if above[d + 1] else unit + j
                if met > here:
                    here = met
                    count, start = divmod(met, unit)
                    if (count, start - j, -j) > best:
                        best, at = (count, start - j, -j), (i, d)
            row[d + 1] = here
        rows.append(row)
    places: list[int] = []
    while at is not None and rows[at[0] + 1][at[1] + 1]:
        i, d = at
        here = rows[i + 1][d + 1]
        if here == rows[i][d + 2]:
            at = (i - 1, d + 1) if i else None
        elif here == rows[i + 1][d]:
            at = (i, d - 1)
        else:
            places.append(i + diagonal - band + d)
            at = (i - 1, d) if i else None
    return places[::-1]


def scan(text: str, index: Index, band: int = BAND, coverage: float = COVERAGE) -> list[tuple]:
    """``template, coverage, matched words, first character, end character`` of each match.

    The candidate with most matched words, less the skipped ones, is taken first: a whole notice
    goes before one pieced together from two. Its words are gone for the others; what is left of
    them is aligned again, so a notice beside another keeps its row.
    """
    words = words_of(text)
    codes = np.fromiter((index.vocabulary.get(w, -1) for w in words), np.int64, len(words))
    hits = index.hits(codes)
    if not hits:
        return []
    # Minus a candidate's matched words less the skipped ones (at most what ``most`` says), whether
    # it is aligned, template's size, template, first place, diagonal, places. Of equal ones the
    # unaligned come first.
    waiting: list[tuple] = []
    last: dict[int, int] = {}
    most = {t: index.most(t, codes) for t in {t for t, _ in hits}}
    for t, diagonal in sorted(hits):
        size = len(index.codes[t])
        # Hits of one template within half a band are one candidate.
        if most[t] < coverage * size or t in last and diagonal - last[t] <= min(band // 2, size - 1):
            continue
        last[t] = diagonal
        waiting.append((-most[t], 0, size, t, 0, diagonal, ()))
    if not waiting:
        return []
    heapq.heapify(waiting)
    places = [m.span() for m in _WORD.finditer(text)]
    rows = []
    while waiting:
        bound, aligned, size, t, _, diagonal, at = heapq.heappop(waiting)
        if aligned and (codes[list(at)] >= 0).all():
            codes[list(at)] = -1
            rows.append((index.names[t], len(at) / size, len(at), places[at[0]][0], places[at[-1]][1]))
        low = max(0, diagonal - band)
        near = codes[low : diagonal + size + band]
        left = index.most(t, near)
        if left < coverage * size:
            continue
        if aligned or left < -bound:
            # Other rows took some of its words, or its surroundings have fewer than the text.
            heapq.heappush(waiting, (-left, 0, size, t, 0, diagonal, ()))
            continue
        found = banded(index.codes[t], near, diagonal - low, band)
        if found and len(found) >= coverage * size:
            at = tuple(low + x for x in found)
            heapq.heappush(waiting, (at[-1] - at[0] + 1 - 2 * len(at), 1, size, t, at[0], diagonal, at))
    return sorted(rows, key=lambda r: (r[3], r[4], r[0]))


def license_matches(docs: DataFrame, templates: dict[str, str] | None = None, coverage: float = COVERAGE,
                    id_col: str = "doc_id", text_col: str = "text") -> DataFrame:
    """``doc_id, license, coverage, matched_words, start, end``: a row per occurrence.

    ``start`` and ``end`` are character offsets into the text.
    """
    index = Index.of(TEMPLATES if templates is None else templates)
    shared = docs.sparkSession.sparkContext.broadcast(index)
    narrow = docs.select(F.col(id_col).alias("doc_id"), whole_text(text_col).alias("text"))
    kind = narrow.schema["doc_id"].dataType.simpleString()
    types = (pa.string(), pa.float64(), pa.int64(), pa.int64(), pa.int64())
    names = ["license", "coverage", "matched_words", "start", "end"]

    def scanned(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            ids, rows = [], []
            for n, text in enumerate(batch.column(1).to_pylist()):
                for row in scan(text, shared.value, coverage=coverage):
                    ids.append(n)
                    rows.append(row)
            if rows:
                own = batch.column(0).take(pa.array(ids))
                arrays = [pa.array(x, t) for x, t in zip(zip(*rows), types)]
                yield pa.RecordBatch.from_arrays([own, *arrays], names=["doc_id", *names])

    return narrow.mapInArrow(
        scanned, f"doc_id {kind}, license string, coverage double, matched_words long, start long, end long"
    )
