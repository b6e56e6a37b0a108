"""Order MinHash fingerprints, in column expressions only.

A text's tokens are its words, longer words cut every eight characters. Each run of ``K``
tokens is a k-mer, numbered by its occurrence among equal ones, so that repeats are elements of
their own. The hash of (k-mer, occurrence) puts an element into one of ``BINS`` bins and orders
it there; each bin keeps its ``TUPLE`` smallest elements, puts them back into text order and
hashes the tuple. Equal tuples need the same k-mers in the same order, which is what makes the
fingerprint follow the edit distance and not only the set of words. One ordering serves all
bins, so an element is hashed once, not once per bin.

Elements are longs, 36 bits of hash above 27 bits of position: sorting a primitive array
orders them by hash and then by position.

The next document comes without a global window: ids are dealt to ranges between bounded,
approximate quantiles, the first row of each range also stands last in the range before, and
every range finds its next rows by itself. Texts are shuffled once.

Defined results: a null text is empty; an empty text has an empty fingerprint, which is like
another empty one (1.0) and unlike all others; a text with fewer tokens than a k-mer is one
k-mer; positions wrap after 2 ** 27 tokens; a null id stands before all others; rows with equal
ids are ordered by hash of the text; a single row is its own next; an empty table gives no rows.
"""

from __future__ import annotations

from collections.abc import Callable

from pyspark.sql import Column, DataFrame, Window, functions as F

from holdfast.llm.tables import whole_text

K, BINS, TUPLE = 3, 64, 2
TOKEN = r"[^\x20\x09-\x0D]{1,8}"
HASH_BITS, POSITION_BITS = 36, 27
# Rows in a range of ids, about, and the most ranges (their edges are a literal in the plan).
RANGE_ROWS, MOST_RANGES = 2_000, 4_096

c = F.col
HASH_MASK, POSITION_MASK = (1 << HASH_BITS) - 1, (1 << POSITION_BITS) - 1


def let(value: Column, body: Callable[[Column], Column]) -> Column:
    """``body`` of ``value``, with ``value`` worked out once."""
    return F.transform(F.array(value), body)[0]


def _element(hash_: Column, position: Column) -> Column:
    return F.shiftleft(hash_.bitwiseAND(F.lit(HASH_MASK)), POSITION_BITS).bitwiseOR(
        position.bitwiseAND(F.lit(POSITION_MASK))
    )


def _hash(element: Column) -> Column:
    return F.shiftright(element, POSITION_BITS)


def _bin(element: Column) -> Column:
    return F.shiftright(element, POSITION_BITS + HASH_BITS - (BINS.bit_length() - 1))


def _position(element: Column) -> Column:
    return element.bitwiseAND(F.lit(POSITION_MASK))


def _kmers(tokens: Column) -> Column:
    """Sorted elements of all k-mers, by hash and then by position."""
    hashes = F.transform(tokens, lambda x: F.xxhash64(x))
    runs = let(
        hashes,
        lambda h: F.slice(
            F.transform(
                h, lambda x, i: _element(F.xxhash64(x, *[F.get(h, i + j) for j in range(1, K)]), i.cast("long"))
            ),
            F.lit(1),
            F.greatest(F.size(h) - F.lit(K - 1), F.lit(1)),
        ),
    )
    return F.sort_array(runs)


def _numbered(kmers: Column) -> Column:
    """Sorted elements by the hash of (k-mer, occurrence); equal k-mers stand side by side."""

    def number(s: Column) -> Column:
        starts = F.filter(
            F.transform(s, lambda x, i: F.when((i == 0) | (_hash(x) != _hash(F.get(s, i - 1))), i)),
            lambda i: i.isNotNull(),
        )
        occurrences = let(
            starts,
            lambda at: F.when(F.size(at) == F.size(s), F.array_repeat(F.lit(0), F.size(s))).otherwise(
                F.flatten(
                    F.transform(
                        at,
                        lambda i, j: F.sequence(F.lit(0), F.coalesce(F.get(at, j + 1), F.size(s)) - i - 1),
                    )
                )
            ),
        )
        return F.zip_with(s, occurrences, lambda x, o: _element(F.xxhash64(_hash(x), o), _position(x)))

    return F.sort_array(let(kmers, number))


def signature(text: Column) -> Column:
    """One long per bin in use: the bin above 32 bits of its tuple's hash."""

    def tuples(kept: Column) -> Column:
        def of(x: Column, i: Column) -> Column:
            y = F.get(kept, i + 1)
            both = F.when(_position(x) < _position(y), F.xxhash64(_hash(x), _hash(y))).otherwise(
                F.xxhash64(_hash(y), _hash(x))
            )
            value = F.when(_bin(x) == _bin(y), both).otherwise(F.xxhash64(_hash(x)))
            entry = F.shiftleft(_bin(x), 32).bitwiseOR(value.bitwiseAND(F.lit(0xFFFFFFFF)))
            return F.when((i == 0) | (_bin(F.get(kept, i - 1)) != _bin(x)), entry)

        return F.filter(F.transform(kept, of), lambda x: x.isNotNull())

    def smallest(s: Column) -> Column:
        return F.filter(s, lambda x, i: (i < TUPLE) | (_bin(F.get(s, i - TUPLE)) != _bin(x)))

    tokens = F.regexp_extract_all(text, F.lit(TOKEN), F.lit(0))
    some = let(let(_numbered(_kmers(tokens)), smallest), tuples)
    empty = F.array().cast("array<bigint>")
    return F.when(F.regexp_like(text, F.lit(TOKEN)), some).otherwise(empty)


def likeness(a: Column, b: Column) -> Column:
    """Share of equal tuples among the bins that either signature uses."""
    bins = F.size(F.array_distinct(F.transform(F.concat(a, b), lambda x: F.shiftright(x, 32))))
    return F.when(bins == 0, F.lit(1.0)).otherwise(F.size(F.array_intersect(a, b)) / bins)


def as_text(signature_: Column) -> Column:
    return F.concat_ws("", F.transform(signature_, lambda x: F.lower(F.lpad(F.hex(x), 10, "0"))))


def _ranged(docs: DataFrame, id_col: str, text_col: str) -> DataFrame:
    """``doc_id, text, key, range, after``: every row, and the first row of each range once more,
    marked ``after``, in the range before."""
    key = F.coalesce(c(id_col).cast("long"), F.lit(-(1 << 63)))
    rows = docs.select(c(id_col).alias("doc_id"), whole_text(text_col).alias("text"), key.alias("key"))
    ranges = max(1, min(MOST_RANGES, rows.count() // RANGE_ROWS))
    shares = [i / ranges for i in range(ranges)]
    edges = sorted(set(rows.agg(F.percentile_approx("key", shares, 16 * ranges)).first()[0] or [0]))
    low = rows.agg(F.min("key")).first()[0]
    edges = sorted({*edges, low if low is not None else 0})
    known = F.array(*[F.lit(x).cast("long") for x in edges])
    place = F.size(F.filter(known, lambda e: e <= c("key"))) - 1
    before = F.when(F.get(known, c("range")) == c("key"), (c("range") + len(edges) - 1) % len(edges))
    copies = F.filter(
        F.array(
            F.struct(c("range").alias("range"), F.lit(False).alias("after")),
            F.struct(before.alias("range"), F.lit(True).alias("after")),
        ),
        lambda x: x["range"].isNotNull(),
    )
    placed = rows.withColumn("range", place).withColumn("copy", F.explode(copies))
    return placed.select("doc_id", "text", "key", c("copy.range").alias("range"), c("copy.after").alias("after"))


def order_fingerprints(docs: DataFrame, id_col: str = "doc_id", text_col: str = "text") -> DataFrame:
    """``doc_id, n_chars, edited_sha256, fingerprint, edited_fingerprint, near_edited, near_next``.

    The edited text has its last quarter of characters replaced by as many first ones of the
    document with the next id; after the last id comes the first.
    """
    signed = _ranged(docs, id_col, text_col).repartition("range").withColumn("own", signature(c("text")))
    order = Window.partitionBy("range").orderBy("after", "key", F.xxhash64("text"), "text")
    following = signed.select(
        "doc_id",
        "text",
        "own",
        "after",
        F.lead("text").over(order).alias("next_text"),
        F.lead("own").over(order).alias("next_own"),
    ).where("NOT after")
    quarter = F.floor(F.length("text") / 4).cast("int")
    edited = F.concat(
        F.substring("text", F.lit(1), F.length("text") - quarter), F.substring("next_text", F.lit(1), quarter)
    )
    changed = following.select(
        "doc_id", F.length("text").cast("long").alias("n_chars"), "own", "next_own", edited.alias("edited")
    )
    both = changed.select(
        "doc_id", "n_chars", F.sha2("edited", 256).alias("edited_sha256"), "own", "next_own",
        signature(c("edited")).alias("changed"),
    )
    return both.select(
        "doc_id",
        "n_chars",
        "edited_sha256",
        as_text(c("own")).alias("fingerprint"),
        as_text(c("changed")).alias("edited_fingerprint"),
        likeness(c("own"), c("changed")).alias("near_edited"),
        likeness(c("own"), c("next_own")).alias("near_next"),
    )
