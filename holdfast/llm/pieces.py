"""Pre-tokens of a byte-level BPE, looked up in a table of frequent ones or encoded once.

The unit is a stretch of text cut before single spaces that stand between two characters that
are not white space. The vocabulary's own pre-tokens never reach across such a place and its
merges never leave a pre-token, so encoding the stretches one by one gives the ids of the whole
text. Stretches cost one hash lookup each; only unknown ones meet the tokenizer. Of those, plain
ones (words, ASCII marks but the apostrophe, single line ends) are cut into their pre-tokens here;
the tokenizer encodes all others whole. Unknown pre-tokens are encoded many at once: where the
file's ids are in the order of its merges, merging by rank gives the same ids (``by_rank``).

Texts are taken some megabytes at a time: Arrow cuts them and finds the different stretches, each of
these is looked up once, and numpy puts the values back in their places. What a worker has looked up
stays for its later tasks. Long texts, and those with other white space than clean single spaces,
are cut one by one, a part at a time.
"""

from __future__ import annotations

import json
import os
import re
from collections import Counter
from collections.abc import Callable, Iterator
from functools import lru_cache

import numpy as np
import pyarrow as pa
import pyarrow.compute as pc
from pyspark.sql import DataFrame, functions as F

# Documents from which the frequent stretches are taken, and how many of these are broadcast.
TABLE_DOCS, TABLE_SIZE = 2_000, 65_536
# Stretches a worker remembers beside the table, and the longest it remembers.
CACHE_SIZE, LONGEST = 400_000, 64
# Bytes of text that are cut at a time, and characters of a part of a longer text.
GROUP, PART = 8 << 20, 1 << 20

_OTHER_SPACE = re.compile(r"[^\S \n]")
_CUT = re.compile(r"(?<=\S) (?=\S)")
# Spaces that are not clean single ones, for Arrow, whose \s is ASCII only.
_ODD = (
    r"  | \n|\n |^ | $|[\t\r\f\v\x1c-\x1f\x{85}\x{a0}\x{1680}\x{2000}-\x{200a}\x{2028}\x{2029}\x{202f}\x{205f}\x{3000}]"
)
# Words, runs of ASCII marks, single line ends: each is a pre-token.
_PARTS = re.compile(r"[^\W\d_]+|[!-&(-/:-@\[-`{-~]+|\n(?!\n)")


# ASCII marks but the apostrophe.
_MARKS = "".join(x for x in map(chr, range(33, 127)) if not x.isalnum() and x != "'")


def byte_letters() -> dict[int, str]:
    """The printable character that stands for each byte in a byte-level vocabulary: itself if
    it is printable and no space, else the next one from 256 on."""
    printable = [*range(33, 127), *range(161, 173), *range(174, 256)]
    others = [b for b in range(256) if b not in printable]
    return {b: chr(b) for b in printable} | {b: chr(256 + i) for i, b in enumerate(others)}


LETTERS = byte_letters()
# Settings of a BPE file that merging by rank doesn't know.
_OTHER_KINDS = ("dropout", "unk_token", "continuing_subword_prefix", "end_of_word_suffix", "byte_fallback", "ignore_merges")


@lru_cache(maxsize=4)
def tokenizer(path: str):
    os.environ["TOKENIZERS_PARALLELISM"] = "false"
    from tokenizers import Tokenizer

    return Tokenizer.from_file(path)


@lru_cache(maxsize=4)
def by_rank(path: str):
    """An encoder of whole lines by the file's merges, or None if its ids are not in their order.

    A merged token's id then is its rank, so of all pairs that make up one token only the listed
    pair can be met when its rank is due, and merging any neighbours whose bytes are the token of
    the lowest id does what the list of merges says.
    """
    import tiktoken

    with open(path, encoding="utf-8") as file:
        model = json.load(file)["model"]
    vocabulary, merges = model.get("vocab"), model.get("merges")
    if model.get("type") != "BPE" or not merges or any(model.get(x) for x in _OTHER_KINDS):
        return None
    pairs = [x.split(" ") if isinstance(x, str) else x for x in merges]
    if any(vocabulary.get(a + b) != 256 + n for n, (a, b) in enumerate(pairs)):
        return None
    byte_of = {letter: byte for byte, letter in LETTERS.items()}
    names = [*LETTERS.values(), *(a + b for a, b in pairs)]
    if any(letter not in byte_of for x in names for letter in x) or {vocabulary.get(x) for x in names[:256]} != {*range(256)}:
        return None
    ranks = {bytes(byte_of[letter] for letter in x): vocabulary[x] for x in names}
    return tiktoken.Encoding("lines", pat_str=r"[^\n]+|\n", mergeable_ranks=ranks, special_tokens={})


def stretches(text: str) -> list[str]:
    """The text cut before its clean single spaces; the spaces themselves are left out."""
    if (
        "  " not in text
        and " \n" not in text
        and "\n " not in text
        and text[:1] != " "
        and text[-1:] != " "
        and not _OTHER_SPACE.search(text)
    ):
        return text.split(" ")
    return _CUT.split(text)


def parts_of(text: str, size: int | None = None) -> Iterator[str]:
    """The text in parts of about ``size`` characters, cut before clean single spaces."""
    at, size = 0, size or PART
    while len(text) - at > size:
        cut = _CUT.search(text, at + size)
        if not cut:
            break
        yield text[at : cut.start()]
        at = cut.end()
    yield text[at:]


class Pieces(dict):
    """Value of `` stretch`` (with its space), from the table, the cache or the tokenizer.

    Values of neighbours add up to the value of both, as lengths and bytes do.
    """

    def __init__(self, path: str, value: Callable[[list[int]], object], table: dict[str, object]):
        super().__init__(table)
        self.path, self.value, self.table = path, value, table
        self.model, self.lines = tokenizer(path).model, by_rank(path)
        self.line_end = self.lines.encode_ordinary("\n")[0] if self.lines else None
        self.special = [token.content for token in tokenizer(path).get_added_tokens_decoder().values()]
        self.lead = os.path.commonprefix(self.special)[:1] or "\n"
        self.inner: dict[str, object] = {}
        self.firsts: dict[str, object] = {}

    def encode(self, text: str) -> object:
        return self.value(tokenizer(self.path).encode(text, add_special_tokens=False).ids)

    def pre_tokens(self, texts: list[str]) -> list:
        """Of pre-tokens without line ends, encoded at once."""
        if not self.lines:
            letters = (x.encode().decode("latin-1").translate(LETTERS) for x in texts)
            return [self.value([token.id for token in self.model.tokenize(x)]) for x in letters]
        ids = self.lines.encode_to_numpy("\n".join([*texts, ""]), disallowed_special=())
        ends = np.flatnonzero(ids == self.line_end)
        starts = np.concatenate([[0], ends[:-1] + 1])
        if self.value is len:
            return (ends - starts).tolist()
        if isinstance(self.value([]), bytes):
            data = ids.astype("<u4", copy=False).tobytes()
            return [data[a:b] for a, b in zip((4 * starts).tolist(), (4 * ends).tolist())]
        return [self.value(ids[a:b]) for a, b in zip(starts.tolist(), ends.tolist())]

    def parts(self, stretch: str) -> list[str] | None:
        """The pre-tokens of a plain stretch."""
        if len(stretch) > LONGEST:
            return None
        # Most are a word and a run of marks.
        word = stretch.rstrip(_MARKS)
        if word.isalpha() and self.lead not in stretch:
            return [word, stretch[len(word) :]] if len(word) < len(stretch) else [word]
        found = _PARTS.findall(stretch)
        if (
            "".join(found) == stretch
            and all(x.isalpha() or x.isascii() for x in found)
            and not any(x in stretch for x in self.special)
        ):
            return found
        return None

    def _encoded(self, before: str, keys: list[str]) -> list:
        """Values of pre-tokens (after ``before``), encoded together."""
        # A line end can't stand in a line; it is a pre-token of its own.
        if "\n".join(keys).count("\n") > max(0, len(keys) - 1):
            plain = [x for x in keys if "\n" not in x]
            known = dict(zip(plain, self._encoded(before, plain)))
            return [known[x] if x in known else self.encode(before + x) for x in keys]
        return self.pre_tokens([before + x for x in keys] if before else keys) if keys else []

    def _keep(self, store: dict, keys: list[str], values: list, most: int) -> None:
        """Remember what was encoded; the store is emptied before it grows over ``most``."""
        if len(store) + len(keys) > most:
            store.clear()
            if store is self:
                store.update(self.table)
        store.update(zip(keys, values))

    def values_of(self, words: list[str]) -> list:
        """Values of stretches, each with its space; unknown ones are encoded together."""
        found = [self.get(x) for x in words]
        # As many at a time as the caches hold.
        step, lead = max(1, CACHE_SIZE // 4), self.lead
        unknown = [i for i, value in enumerate(found) if value is None]
        for low in range(0, len(unknown), step):
            whole, cut, inner = [], [], {}
            for i in unknown[low : low + step]:
                x = words[i]
                # What ``parts`` finds, without its search: most are a word, many with marks after it,
                # some two of these with a line end between.
                line, end, other = x.partition("\n")
                if len(x) <= LONGEST and (word := line.rstrip(_MARKS)).isalpha() and lead not in x:
                    marks = line[len(word) :]
                    if not end:
                        if marks:
                            cut.append((i, word, (marks,)))
                            inner[marks] = None
                        else:
                            whole.append(i)
                        continue
                    if (second := other.rstrip(_MARKS)).isalpha():
                        rest = [y for y in (marks, end, second, other[len(second) :]) if y]
                        cut.append((i, word, rest))
                        for y in rest:
                            inner[y] = None
                        continue
                parts = self.parts(x)
                if not parts:
                    found[i] = self.encode(" " + x)
                elif len(parts) == 1:
                    whole.append(i)
                else:
                    cut.append((i, parts[0], parts[1:]))
                    inner.update(dict.fromkeys(parts[1:]))
            new = [words[i] for i in whole]
            new += dict.fromkeys(word for _, word, _ in cut if word not in self)
            values = self._encoded(" ", new)
            for i, value in zip(whole, values):
                found[i] = value
            firsts = dict(zip(new[len(whole) :], values[len(whole) :]))
            new_inner = [x for x in inner if x not in self.inner]
            inner_values = self._encoded("", new_inner)
            inner = {x: self.inner[x] for x in inner if x in self.inner} | dict(zip(new_inner, inner_values))
            # All parts are at hand here: emptying a store loses none of them.
            for i, word, rest in cut:
                value = firsts[word] if word in firsts else self[word]
                for x in rest:
                    value = value + inner[x]
                found[i] = value
            self._keep(self, new, values, CACHE_SIZE + len(self.table))
            self._keep(self.inner, new_inner, inner_values, max(CACHE_SIZE // 4, len(inner)))
        return found

    def __missing__(self, stretch: str) -> object:
        return self.values_of([stretch])[0]

    def first(self, stretch: str) -> object:
        """Of the first stretch of a text, which has no space before it."""
        found = self.firsts.get(stretch)
        if found is None:
            found = self.encode(stretch)
            if len(self.firsts) >= CACHE_SIZE // 4:
                self.firsts.clear()
            if len(stretch) <= LONGEST:
                self.firsts[stretch] = found
        return found

    def of(self, text: str) -> Iterator[object]:
        """Values of all stretches of ``text`` in order."""
        for n, part in enumerate(parts_of(text)):
            first, *rest = stretches(part)
            if not n:
                if first:
                    yield self.first(first)
            else:
                rest.insert(0, first)
            different = list(dict.fromkeys(rest))
            known = dict(zip(different, self.values_of(different)))
            yield from map(known.__getitem__, rest)

    def looked_up(self, texts: pa.Array) -> tuple[np.ndarray, np.ndarray, list]:
        """Of texts with clean single spaces: where each one's stretches begin, the number of each
        stretch's value, and the values."""
        lists = pc.split_pattern(texts, " ")
        offsets = lists.offsets.to_numpy().astype(np.int64)
        coded = lists.flatten().dictionary_encode()
        index = coded.indices.to_numpy(zero_copy_only=False).astype(np.int64)
        del lists
        offsets -= offsets[0]
        begin = offsets[:-1]
        leading, which = np.unique(index[begin], return_inverse=True)
        index[begin] = len(coded.dictionary) + which
        inside = np.bincount(index, minlength=len(coded.dictionary))[: len(coded.dictionary)] > 0
        # Faster than to_pylist, which makes a scalar of each.
        words, nothing = coded.dictionary.to_numpy(zero_copy_only=False).tolist(), self.value([])
        values, used = [nothing] * len(words), np.flatnonzero(inside).tolist()
        for i, value in zip(used, self.values_of([words[i] for i in used])):
            values[i] = value
        values += [self.first(words[i]) if words[i] else nothing for i in leading.tolist()]
        return offsets, index, values

    def groups(self, texts: pa.Array) -> Iterator[tuple[np.ndarray, pa.Array | None]]:
        """Places and texts to cut together, or places alone of those to cut one by one."""
        sizes = pc.binary_length(texts).to_numpy(zero_copy_only=False).astype(np.int64)
        alone = pc.match_substring_regex(texts, _ODD).to_numpy(zero_copy_only=False) | (sizes > GROUP)
        rows = np.flatnonzero(~alone)
        cuts = np.flatnonzero(np.diff(np.cumsum(sizes[rows]) // GROUP)) + 1
        for own in np.split(rows, cuts):
            if len(own):
                yield own, texts.take(pa.array(own))
        if alone.any():
            yield np.flatnonzero(alone), None

    def lengths(self, texts: pa.Array) -> np.ndarray:
        """Tokens of each text; the values must be lengths."""
        result = np.zeros(len(texts), np.int64)
        for rows, group in self.groups(texts):
            if group is None:
                result[rows] = [sum(self.of(texts[i].as_py())) for i in rows.tolist()]
            else:
                offsets, index, values = self.looked_up(group)
                result[rows] = np.add.reduceat(np.array(values, np.int64)[index], offsets[:-1])
        return result

    def ids(self, texts: pa.Array) -> Iterator[tuple[int, bytes]]:
        """Place and ids of each text; the values must be ids of four bytes."""
        for rows, group in self.groups(texts):
            if group is None:
                for i in rows.tolist():
                    yield i, b"".join(self.of(texts[i].as_py()))
                continue
            offsets, index, values = self.looked_up(group)
            sizes = np.array([len(v) // 4 for v in values], np.int64)
            flat, starts = np.frombuffer(b"".join(values), "<u4"), np.cumsum(sizes) - sizes
            lengths = sizes[index]
            ends = np.cumsum(lengths)
            if not ends[-1]:
                yield from ((i, b"") for i in rows.tolist())
                continue
            # Each stretch's ids stand together in ``flat``: step by one within it.
            bounds, tokens = 4 * np.concatenate([[0], ends])[offsets], ends[-1]
            shifts = starts[index] - (ends - lengths)
            # What is done with goes at once: each of these is as long as the group has words or tokens.
            del index, values, starts, ends
            at = np.repeat(shifts, lengths)
            del shifts, lengths
            at += np.arange(tokens)
            found = flat[at].tobytes()
            del at, flat
            for i, low, high in zip(rows.tolist(), bounds.tolist(), bounds[1:].tolist()):
                yield i, found[low:high]


def give_back() -> None:
    """Hand what Arrow holds free to the system, at a task's end: the worker stays, beside the JVM."""
    pa.default_memory_pool().release_unused()


_KEPT: dict[tuple[str, str], Pieces] = {}


def kept_pieces(path: str, value: Callable[[list[int]], object], table: dict[str, object]) -> Pieces:
    """The worker's own pieces of this kind, with the table: a value depends on nothing else."""
    key = (path, value.__qualname__)
    if key not in _KEPT:
        _KEPT.clear()
        _KEPT[key] = Pieces(path, value, table)
    pieces = _KEPT[key]
    if pieces.table is not table:
        pieces.table = table
        pieces.update(table)
    return pieces


def frequent_stretches(docs: DataFrame, text_col: str, id_col: str,
                       sample_docs: int = TABLE_DOCS, size: int = TABLE_SIZE) -> list[str]:
    """The most frequent stretches of about ``sample_docs`` documents chosen by hash.

    The table only decides what is looked up and what is encoded, never a result. At most
    ``size`` short strings come to the driver; no stretch is shuffled.
    """
    every = max(1, docs.count() // sample_docs)
    chosen = docs.where(F.pmod(F.xxhash64(F.col(id_col)), F.lit(every)) == 0)
    texts = chosen.select(F.col(text_col).alias("text")).where("text IS NOT NULL").limit(2 * sample_docs)

    def count(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        seen: Counter[str] = Counter()
        for batch in batches:
            for text in batch.column(0).to_pylist():
                seen.update(x for x in stretches(text)[1:] if len(x) <= LONGEST)
        best = sorted(seen.items(), key=lambda x: (-x[1], x[0]))[:size]
        yield pa.RecordBatch.from_pydict({"stretch": pa.array([x for x, _ in best], pa.string())})

    rows = texts.coalesce(1).mapInArrow(count, "stretch string").limit(size).collect()
    return [row.stretch for row in rows]


def frequent_table(stretch_list: list[str], path: str, value: Callable[[list[int]], object]) -> dict[str, object]:
    encoded = tokenizer(path).encode_batch([" " + x for x in stretch_list], add_special_tokens=False)
    return {x: value(e.ids) for x, e in zip(stretch_list, encoded)}
