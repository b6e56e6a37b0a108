"""Toxicity by weak supervision.

Voters look at a text and say toxic, clean or nothing. Some are lexicons (a fixed one of insults,
and one per word or stem that labelled rows of the learning folds show to go with toxicity),
others are patterns. An entry counts by the different words it follows, at most three in a text,
so neither copies of a text nor one text that repeats itself make a word toxic. A generative label model sees only the votes: by expectation maximisation it estimates
how often each voter speaks in either class, and from what agreement is left within a class how
strongly voters repeat each other, so that correlated voters share one voice. It is fitted on the
votes on all distinct texts, counted by pattern. Its posteriors are the labels on which a linear
classifier over words, stems and the votes of lexicon and patterns is trained; that classifier
scores every document.

Lexicon, vocabulary and classifier learn from at most ``TRAIN_ROWS`` labelled documents, chosen by
hash, the classifier also from vote patterns of all documents; lexicons and vocabulary are bounded
and broadcast. Voting is one scan that shuffles a digest and a pattern of each text, scoring one
without a shuffle.

Defined results: a null text is empty and scores like no words at all; texts are read whole;
repeated rows and null ids are scored like others; without labelled rows the fixed lexicon and
the patterns still vote, over the unlabelled documents; an empty table gives no rows.
"""

from __future__ import annotations

import copy
import functools
import hashlib
import math
import re
from collections import Counter
from collections.abc import Callable, Iterator
from dataclasses import dataclass

import numpy as np
import pyarrow as pa
import pyarrow.compute as pc
from pyspark.ml.classification import LogisticRegression
from pyspark.ml.functions import array_to_vector
from pyspark.sql import Column, DataFrame, functions as F

from holdfast.llm.tables import stored, whole_text

TRAIN_ROWS = 8_000
HELD_OUT, FOLDS = 2, 4
THRESHOLD = 0.3
# Lengths of the beginnings of longer words that stand as stems beside the words.
STEMS = (3, 4, 5, 6, 7)
LEXICON_SIZE, VOCABULARY, CANDIDATES = 60, 1_000, 5_000
# Words it follows that count for an entry in one text.
CONTEXTS = 3
ROUNDS = 100
# Voters for toxic beside the learned entries.
OTHERS = 5
# Distinct vote patterns that the driver takes; over more, Spark sums each round.
PATTERNS = 100_000
# What the corpus's texts of one of the other voters weigh at most, as a share of the learning texts.
SUPPORT = 0.02

# Words of abuse that a lexicon of English would hold.
INSULTS = (
    "arsehole", "bastard", "bitch", "clown", "coward", "creep", "cretin", "damned", "despicable", "disgusting",
    "dumb", "dumbass", "filth", "filthy", "fool", "freak", "garbage", "hate", "hateful", "hideous", "idiot",
    "idiotic", "imbecile", "jerk", "liar", "loser", "lunatic", "moron", "moronic", "nasty", "pathetic", "pig",
    "rat", "repulsive", "rotten", "scum", "scumbag", "shit", "stupid", "sucker", "thug", "trash", "ugly",
    "useless", "vermin", "vile", "worthless", "wretched",
)
_WORDS = re.compile(r"[^\W\d_]+")
_MASKED = re.compile(r"\b[a-z]+[*@#$%]+[a-z]+\b")
_MASKS = "*@#$%"
_SHOUT = re.compile(r"[A-Z]{3,}[^a-z]{0,3}!")

c = F.col


def entries_of(text: str) -> set[str]:
    """Distinct lower-case words, and the stems of longer ones (ending in ``-``)."""
    words = set(_WORDS.findall(text.lower()))
    found = set(words)
    for size in STEMS:
        found.update(w[:size] + "-" for w in words if len(w) > size)
    return found


# Voters


class Voters:
    """The fixed lexicon, one voter for each learned entry, and patterns."""

    def __init__(self, learned: list[str], insults: tuple[str, ...] = INSULTS):
        self.learned = learned
        self.insults = frozenset(insults)
        self.place = {x: i for i, x in enumerate(learned)}
        self.whole = self.insults | {x for x in learned if not x.endswith("-")}
        self.stems = frozenset(x[:-1] for x in learned if x.endswith("-"))
        self.sizes = sorted({len(x) for x in self.stems})

    def __len__(self) -> int:
        return len(self.learned) + OTHERS + 1

    def spoken(self, text: str, words: set[str]) -> list[int]:
        """The voters that speak, in order: learned entries, the others, and last the one for clean."""
        named = words & self.whole
        insults = bool(named & self.insults)
        learned = {self.place[x] for x in named if x in self.place}
        hits = set(named)
        for n in self.sizes:
            for word in words:
                if word[:n] in self.stems and len(word) > n:
                    learned.add(self.place[word[:n] + "-"])
                    if word not in self.stems:
                        hits.add(word)
        others = (
            insults,
            len(hits) > 1,
            len(hits) > 2,
            any(x in text for x in _MASKS) and bool(_MASKED.search(text)),
            insults and bool(_SHOUT.search(text)),
            not insults and not learned,
        )
        return [*sorted(learned), *(len(self.learned) + i for i, speaks in enumerate(others) if speaks)]


def votes_of(spoken: list[list[int]], size: int) -> np.ndarray:
    """1 for toxic, -1 for clean, 0 for nothing: a row for each text, a column for each voter."""
    votes = np.zeros((len(spoken), size), np.int8)
    for row, places in zip(votes, spoken):
        row[places] = 1
    votes[:, -1] *= -1
    return votes


Sums = Callable[[np.ndarray, np.ndarray], np.ndarray]


def _heard(votes: np.ndarray, counts: np.ndarray) -> np.ndarray:
    """How many texts each voter speaks in, and last how many there are."""
    return np.array([*(counts @ (votes != 0)), counts.sum()], float)


class LabelModel:
    """Two classes, voters that speak independently but for the weight of what they repeat.

    ``speaks[y, j]`` is the chance that voter j speaks in class y; a voter that speaks says
    what its kind says. The class share starts at ``prior`` and follows the data.
    """

    def __init__(self, prior: float = 0.1):
        self.prior = prior

    def fit(self, votes: np.ndarray, counts: np.ndarray | None = None, rounds: int = ROUNDS) -> "LabelModel":
        """From votes, a row for each text, or for ``counts`` texts."""
        counts = np.ones(len(votes)) if counts is None else counts
        return self.fit_by(lambda sums: sums(votes, counts), np.sign(votes.sum(axis=0)), rounds)

    def fit_by(self, over: Callable[[Sums], np.ndarray], side: np.ndarray, rounds: int = ROUNDS) -> "LabelModel":
        """``over`` adds up what a function of votes and counts gives for all parts of them."""
        total = over(_heard)
        texts = total[-1]
        # At first every voter is thought to be right four times in five.
        base = (total[:-1] / texts).clip(1e-4, 1 - 1e-4)
        better = np.minimum(base * 3, 0.9)
        self.speaks = np.where(side > 0, [base / 2, better], [better, base / 2])
        self.weight = np.ones(len(side))
        for turn in range(rounds):
            before = copy.copy(self)
            sums = over(before.shares)
            for y in (0, 1):
                self.speaks = self.speaks.copy()
                self.speaks[y] = (sums[y, :-1] + 0.1) / (sums[y, -1] + 0.2)
            # Voters keep their side: one that says toxic speaks there at least as often.
            self.speaks[1] = np.where(side > 0, np.maximum(*self.speaks), self.speaks[1])
            self.speaks[0] = np.where(side < 0, np.maximum(*self.speaks), self.speaks[0])
            self.prior = float(np.clip(sums[1, -1] / texts, 0.005, 0.5))
            if turn % 10 == 9:
                together = over(functools.partial(before.left, self.speaks))
                self.weight = 1 / (1 + self.repeated(together, sums[:, -1] / texts))
            if np.abs(self.speaks - before.speaks).max() < 1e-6 and turn > 10:
                break
        return self

    def shares(self, votes: np.ndarray, counts: np.ndarray) -> np.ndarray:
        """Of clean and toxic texts, how many each voter speaks in, and last how many there are."""
        toxic, spoken = self.posterior(votes), (votes != 0).astype(float)
        return np.array([[*(x @ spoken), x.sum()] for x in (counts * (1 - toxic), counts * toxic)])

    def left(self, speaks: np.ndarray, votes: np.ndarray, counts: np.ndarray) -> np.ndarray:
        """Products of what is left of each two voters within clean and toxic texts."""
        toxic, spoken = self.posterior(votes), (votes != 0).astype(float)
        off = [(spoken - speaks[y]) * np.sqrt(x)[:, None] for y, x in enumerate((counts * (1 - toxic), counts * toxic))]
        return np.array([x.T @ x for x in off])

    def repeated(self, together: np.ndarray, share: np.ndarray) -> np.ndarray:
        """How much of each voter others say as well: correlations left within the classes."""
        total = np.zeros(together.shape[1:])
        for y in (1, 0):
            alone = np.sqrt(np.diag(together[y])) + 1e-9
            total += np.maximum(together[y] / np.outer(alone, alone), 0) * share[y]
        self.correlations = total - np.diag(np.diag(total))
        return np.where(self.correlations > 0.2, self.correlations, 0).sum(axis=1)

    def accuracies(self) -> np.ndarray:
        """Chance that a voter is right when it speaks toxic."""
        said = self.prior * self.speaks[1] + (1 - self.prior) * self.speaks[0]
        return self.prior * self.speaks[1] / said

    def posterior(self, votes: np.ndarray) -> np.ndarray:
        """Chance of toxic given who speaks and who is silent, each by the voter's weight."""
        speaks = self.speaks.clip(1e-4, 1 - 1e-4)
        says = self.weight * np.log(speaks[1] / speaks[0])
        silent = self.weight * np.log((1 - speaks[1]) / (1 - speaks[0]))
        odds = (votes != 0) @ (says - silent) + silent.sum()
        return 1 / (1 + np.exp(-(np.log(self.prior / (1 - self.prior)) + odds).clip(-30, 30)))


# Learning


def held_out(id_col: str = "doc_id") -> Column:
    return F.coalesce(F.crc32(c(id_col).cast("string")) % FOLDS == HELD_OUT, F.lit(False))


def training_texts(docs: DataFrame, labels: DataFrame, label: str, most: int = TRAIN_ROWS) -> DataFrame:
    """``text, label`` of at most ``most`` labelled documents with distinct texts."""
    known = labels.where(c("doc_id").isNotNull() & c(label).isNotNull() & ~held_out())
    one = known.groupBy("doc_id").agg(F.max(label).cast("int").alias("label"))
    # Bounded by ``most``, so its broadcast is.
    chosen = one.orderBy(F.xxhash64("doc_id"), "doc_id").limit(most)
    texts = docs.select("doc_id", whole_text().alias("text")).join(F.broadcast(chosen), "doc_id")
    return texts.groupBy(F.sha2("text", 256).alias("digest")).agg(
        F.min_by("text", "doc_id").alias("text"), F.max("label").alias("label")
    ).select("text", "label").limit(most)


def _exploded(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    for batch in batches:
        for text, label in zip(batch.column(0).to_pylist(), batch.column(1).to_pylist()):
            found = sorted(entries_of(text))
            yield pa.RecordBatch.from_pydict(
                {"entry": pa.array(found, pa.string()), "label": pa.array([label] * len(found), pa.int32())}
            )


def entry_counts(rows: DataFrame) -> DataFrame:
    """``entry, toxic, texts``: in how many texts an entry stands."""
    exploded = rows.select("text", "label").mapInArrow(_exploded, "entry string, label int")
    return exploded.groupBy("entry").agg(F.sum("label").alias("toxic"), F.count("*").alias("texts"))


def _gain(toxic: Column, texts: Column, base: float) -> Column:
    """Log likelihood of an entry's texts at their own share of toxic ones, above the base."""
    share = (toxic + F.lit(0.01)) / (texts + F.lit(0.02))
    return toxic * F.log(share / F.lit(base)) + (texts - toxic) * F.log((1 - share) / F.lit(1 - base))


def context_counts(rows: DataFrame, candidates: list[str]) -> DataFrame:
    """``entry, toxic, contexts``: the different words before a candidate, and those of them
    that stand before it in a toxic text. ``candidates`` is bounded and broadcast."""
    known = rows.sparkSession.sparkContext.broadcast(frozenset(candidates))

    def pairs(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            entries, before, labels = [], [], []
            for text, label in zip(batch.column(0).to_pylist(), batch.column(1).to_pylist()):
                found: dict[str, set[str]] = {}
                last = ""
                for word in _WORDS.findall(text.lower()):
                    for entry in (word, *[word[:n] + "-" for n in STEMS if len(word) > n]):
                        if entry in known.value:
                            contexts = found.setdefault(entry, set())
                            if len(contexts) < CONTEXTS:
                                contexts.add(last)
                    last = word
                for entry, contexts in found.items():
                    entries += [entry] * len(contexts)
                    before += sorted(contexts)
                    labels += [label] * len(contexts)
            yield pa.RecordBatch.from_arrays(
                [pa.array(entries, pa.string()), pa.array(before, pa.string()), pa.array(labels, pa.int32())],
                names=["entry", "before", "label"],
            )

    found = rows.select("text", "label").mapInArrow(pairs, "entry string, before string, label int")
    each = found.groupBy("entry", "before").agg(F.max("label").alias("label"))
    return each.groupBy("entry").agg(F.sum("label").alias("toxic"), F.count("*").alias("contexts"))


def _gain_of(toxic: int, contexts: int, base: float) -> float:
    share = min(max((toxic + 0.01) / (contexts + 0.02), 1e-6), 1 - 1e-6) if contexts > 0 else base
    return toxic * math.log(share / base) + (contexts - toxic) * math.log((1 - share) / (1 - base))


@dataclass(frozen=True)
class Found:
    """An entry in the labelled texts: texts and words before it, toxic ones and all."""

    entry: str
    toxic_texts: int
    texts: int
    toxic_contexts: int
    contexts: int

    def gain(self, base: float) -> float:
        """What both counts bear out: texts alone follow copies, contexts alone fixed phrases."""
        return min(_gain_of(self.toxic_texts, self.texts, base), _gain_of(self.toxic_contexts, self.contexts, base))

    def convinces(self, base: float, needed: float) -> bool:
        """Contexts outdo chance among all entries, texts agree, and most of both are toxic."""
        return (
            min(self.texts, self.contexts) > 0
            and min(self.toxic_texts / max(self.texts, 1), self.toxic_contexts / max(self.contexts, 1)) >= 0.6
            and _gain_of(self.toxic_contexts, self.contexts, base) >= needed
            and _gain_of(self.toxic_texts, self.texts, base) >= needed / 3
        )

    def without(self, others: list["Found"]) -> "Found":
        return Found(
            self.entry,
            self.toxic_texts - sum(x.toxic_texts for x in others),
            self.texts - sum(x.texts for x in others),
            self.toxic_contexts - sum(x.toxic_contexts for x in others),
            self.contexts - sum(x.contexts for x in others),
        )


def chosen_entries(found: list[Found], base: float, needed: float) -> list[str]:
    """Lexicon entries, best first. A stem counts without the longer entries chosen before it,
    and nothing counts under a chosen stem."""
    # Of equal ones the longest, a word before a stem: what is narrower harms less.
    order = sorted(found, key=lambda x: (-x.gain(base), -len(x.entry.rstrip("-")), x.entry))
    chosen: dict[str, Found] = {}
    for one in order:
        if any(kept.endswith("-") and one.entry.startswith(kept[:-1]) for kept in chosen):
            continue
        left = one
        if one.entry.endswith("-"):
            left = one.without([x for kept, x in chosen.items() if kept.startswith(one.entry[:-1])])
        if left.convinces(base, needed):
            chosen[one.entry] = one
    return list(chosen)[:LEXICON_SIZE]


def learned_entries(rows: DataFrame, n: int, toxic: int) -> tuple[list[str], tuple[str, ...], list[str]]:
    """Lexicon, the insults that labelled texts don't contradict, and the classifier's
    vocabulary; all bounded."""
    base = min(max(toxic / max(n, 1), 1e-3), 0.5)
    counted = stored(entry_counts(rows), "toxicity-entries")
    contradicted = counted.where(c("entry").isin(*INSULTS) & (c("toxic") < 0.5 * c("texts"))).collect()
    insults = tuple(x for x in INSULTS if not n or x not in {r.entry for r in contradicted})
    rated = counted.where("texts >= 2").withColumn("gain", _gain(c("toxic"), c("texts"), base))
    best = rated.where(c("toxic") >= 0.5 * c("texts")).orderBy(c("gain").desc(), F.length("entry"), "entry")
    candidates = {r.entry: r for r in best.limit(CANDIDATES).collect()}
    found = [
        Found(r.entry, candidates[r.entry].toxic, candidates[r.entry].texts, r.toxic, r.contexts)
        for r in context_counts(rows, list(candidates)).collect()
    ]
    # Chance must not find as much among all entries.
    lexicon = chosen_entries(found, base, math.log(max(rated.count(), 2)))
    order = sorted(found, key=lambda x: (-x.gain(base), x.entry))
    return lexicon, insults, list(dict.fromkeys([*lexicon, *insults, *(x.entry for x in order)]))[:VOCABULARY]


def vote_patterns(docs: DataFrame, voters: Voters) -> DataFrame:
    """``pattern, texts``: how many distinct texts of all documents which voters speak in.

    One pass; what is shuffled is a digest and a few bytes of each text, then patterns.
    """
    shared = docs.sparkSession.sparkContext.broadcast(voters)

    def heard(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            digests, patterns = [], []
            for text in batch.column(0).to_pylist():
                digests.append(hashlib.blake2b(text.encode("utf-8", "surrogatepass"), digest_size=16).digest())
                patterns.append(bytes(shared.value.spoken(text, set(_WORDS.findall(text.lower())))))
            yield pa.RecordBatch.from_arrays(
                [pa.array(digests, pa.binary()), pa.array(patterns, pa.binary())], names=["digest", "pattern"]
            )

    each = docs.select(whole_text().alias("text")).mapInArrow(heard, "digest binary, pattern binary")
    distinct = each.groupBy("digest").agg(F.first("pattern").alias("pattern"))
    return distinct.groupBy("pattern").agg(F.count("*").alias("texts"))


def fit_labels(patterns: DataFrame, size: int) -> LabelModel:
    """The label model of all documents, from the counts of their (stored) vote patterns."""
    side = np.array([*[1] * (size - 1), -1])

    def part(rows: list[tuple[bytes, int]]) -> tuple[np.ndarray, np.ndarray]:
        return votes_of([list(x) for x, _ in rows], size), np.array([n for _, n in rows], float)

    known = patterns.limit(PATTERNS + 1).collect()
    if len(known) <= PATTERNS:
        votes, counts = part(sorted((bytes(r.pattern), r.texts) for r in known))
        return LabelModel().fit_by(lambda sums: sums(votes, counts), side)

    def over(sums: Sums) -> np.ndarray:
        def summed(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
            for batch in batches:
                out = sums(*part(list(zip(batch.column(0).to_pylist(), batch.column(1).to_pylist()))))
                yield pa.RecordBatch.from_pydict({"sums": [out.ravel().tolist()], "shape": [list(out.shape)]})

        rows = patterns.mapInArrow(summed, "sums array<double>, shape array<long>").collect()
        return np.sum(sorted(r.sums for r in rows), axis=0).reshape(rows[0].shape)

    return LabelModel().fit_by(over, side)


def _examined(rows: DataFrame, voters: Voters, vocabulary: list[str]) -> list[tuple[list[int], list[int]]]:
    """Who speaks, and the vocabulary's entries found, in each (bounded) learning text."""
    place = {x: i for i, x in enumerate(vocabulary)}

    def examine(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            spoken, found = [], []
            for text in batch.column(0).to_pylist():
                entries = entries_of(text)
                spoken.append(voters.spoken(text, {x for x in entries if x[-1:] != "-"}))
                found.append(sorted(place[x] for x in entries if x in place))
            yield pa.RecordBatch.from_pydict(
                {"spoken": pa.array(spoken, pa.list_(pa.int32())), "found": pa.array(found, pa.list_(pa.int32()))}
            )

    table = stored(rows.select("text").mapInArrow(examine, "spoken array<int>, found array<int>"), "toxicity-votes")
    # Bounded by the sample; in one order whatever task a row came from.
    return sorted((r.spoken, r.found) for r in table.collect())


def supported(patterns: DataFrame, size: int, texts: int) -> DataFrame:
    """``pattern, weight``: all patterns of the corpus in which another voter than a learned entry
    speaks.

    However rare in the learning texts, each such voter has the weight of its texts in the corpus,
    at most ``SUPPORT`` of the learning texts, dealt to its patterns by their texts.
    """
    others = range(size - 1 - OTHERS, size - 1)
    spelled = patterns.where(F.length("pattern") > 0)
    of_voter = [F.when(F.contains("pattern", F.lit(bytes([v]))), c("texts")).otherwise(0) for v in others]
    totals = spelled.agg(*[F.coalesce(F.sum(x), F.lit(0)).alias(f"v{n}") for n, x in enumerate(of_voter)]).first()
    weight = F.lit(0.0)
    for x, total in zip(of_voter, totals):
        if total:
            weight = weight + x * F.lit(min(total, SUPPORT * texts) / total)
    return spelled.withColumn("weight", weight).where("weight > 0").select("pattern", "weight")


# ``features`` has a place for each entry of the vocabulary and each voter for toxic beside the
# learned ones; a text counts in both classes by its posterior.
EXAMPLES = "features array<int>, toxic double, weight double"


def supporting_examples(weighed: DataFrame, model: LabelModel, voters: Voters, vocabulary: list[str]) -> DataFrame:
    """Examples of the classifier from vote patterns, in Spark."""
    place = {x: i for i, x in enumerate(vocabulary)}
    shared = weighed.sparkSession.sparkContext.broadcast((model, voters, place))

    def example(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        model, voters, place = shared.value
        for batch in batches:
            spoken = [list(x) for x in batch.column(0).to_pylist()]
            if spoken:
                entries = [sorted(place[voters.learned[i]] for i in p if i < len(voters.learned)) for p in spoken]
                features = [features_of(x, p, voters, len(place)) for x, p in zip(entries, spoken)]
                toxic = model.posterior(votes_of(spoken, len(voters)))
                yield pa.RecordBatch.from_arrays(
                    [pa.array(features, pa.list_(pa.int32())), pa.array(toxic, pa.float64()), batch.column(1)],
                    names=["features", "toxic", "weight"],
                )

    return weighed.mapInArrow(example, EXAMPLES)


def features_of(entries: list[int], spoken: list[int], voters: Voters, size: int) -> list[int]:
    """The entries' places, and after the vocabulary's those of the other voters for toxic."""
    own = len(voters.learned)
    return entries + [size + i - own for i in spoken if own <= i < len(voters) - 1]


def fit_linear(examples: DataFrame, size: int) -> tuple[float, np.ndarray]:
    """Intercept and weights of the classifier of ``size`` features."""
    sides = F.inline(F.array(
        F.struct(F.lit(1.0).alias("label"), (c("toxic") * c("weight")).alias("share"), "features"),
        F.struct(F.lit(0.0).alias("label"), ((1 - c("toxic")) * c("weight")).alias("share"), "features"),
    ))
    rows = examples.select(sides).where(c("share") > 1e-3)
    classes = sorted(r.label for r in rows.select("label").distinct().collect())
    if len(classes) < 2:
        return (0.0 if not classes else -30.0 if classes[0] == 0 else 30.0), np.zeros(size)

    def dense(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            for low in range(0, batch.num_rows, 1_000):
                part = batch.slice(low, 1_000)
                lists = part.column("features")
                length = pc.list_value_length(lists).to_numpy(zero_copy_only=False)
                x = np.zeros((part.num_rows, size))
                x[np.repeat(np.arange(part.num_rows), length), lists.flatten().to_numpy(zero_copy_only=False)] = 1
                vectors = pa.ListArray.from_arrays(pa.array(np.arange(0, x.size + 1, size), pa.int32()), pa.array(x.ravel()))
                yield pa.RecordBatch.from_arrays([part.column("label"), part.column("share"), vectors], names=["label", "share", "x"])

    wide = rows.mapInArrow(dense, "label double, share double, x array<double>")
    table = wide.select("label", "share", array_to_vector("x").alias("features"))
    model = LogisticRegression(weightCol="share", regParam=0.002, elasticNetParam=0.5, maxIter=60,
                               standardization=False).fit(table)
    return float(model.intercept), model.coefficients.toArray()


def learn(docs: DataFrame, labels: DataFrame, label: str = "toxic") -> tuple[float, dict[str, float], Voters, list[float]]:
    """Intercept, the weight of each entry that matters, the voters, and the weights of the
    voters for toxic that are not entries."""
    rows = stored(training_texts(docs, labels, label), "toxicity-training")
    seen = rows.agg(F.count("*"), F.sum("label")).first()
    if not seen[0]:
        some = docs.select(whole_text().alias("text"), F.lit(0).alias("label"))
        rows = stored(some.orderBy(F.xxhash64("text")).limit(TRAIN_ROWS), "toxicity-unlabelled")
    lexicon, insults, vocabulary = learned_entries(rows, seen[0], seen[1] or 0)
    voters = Voters(lexicon, insults)
    examined = _examined(rows, voters, vocabulary)
    if not examined:
        return -30.0, {}, voters, [0.0] * OTHERS
    patterns = stored(vote_patterns(docs, voters), "toxicity-patterns")
    model = fit_labels(patterns, len(voters))
    toxic = model.posterior(votes_of([v for v, _ in examined], len(voters)))
    own = [(features_of(f, v, voters, len(vocabulary)), float(p), 1.0) for (v, f), p in zip(examined, toxic)]
    more = supporting_examples(supported(patterns, len(voters), len(examined)), model, voters, vocabulary)
    examples = stored(docs.sparkSession.createDataFrame(own, EXAMPLES).unionByName(more), "toxicity-examples")
    intercept, weights = fit_linear(examples, len(vocabulary) + OTHERS)
    entries = {x: float(w) for x, w in zip(vocabulary, weights) if w}
    return intercept, entries, voters, [float(w) for w in weights[len(vocabulary):]]


def score_toxicity(docs: DataFrame, labels: DataFrame, label: str = "toxic", threshold: float = THRESHOLD) -> DataFrame:
    """``doc_id, held_out, score, predicted``, and the columns of ``docs`` in ``_row``."""
    intercept, weights, voters, votes = learn(docs, labels, label)
    words = docs.sparkSession.sparkContext.broadcast(
        ({x: w for x, w in weights.items() if not x.endswith("-")},
         {n: {x[:-1]: w for x, w in weights.items() if x.endswith("-") and len(x) == n + 1} for n in STEMS},
         voters)
    )
    narrow = docs.select(F.struct(*docs.columns).alias("_row"), whole_text().alias("_text"))

    def scored(texts: Iterator[pa.Array]) -> Iterator[pa.Array]:
        whole, stems, voters = words.value
        sized = [(n, known) for n, known in stems.items() if known]
        for batch in texts:
            out = []
            for text in batch.to_pylist():
                found = set(_WORDS.findall(text.lower()))
                total = intercept + sum(whole[w] for w in sorted(found & whole.keys()))
                for n, known in sized:
                    total += sum(known[w] for w in sorted({w[:n] for w in found} & known.keys()))
                for voter in voters.spoken(text, found):
                    if 0 <= voter - len(voters.learned) < OTHERS:
                        total += votes[voter - len(voters.learned)]
                out.append(float(1 / (1 + np.exp(-min(max(total, -30.0), 30.0)))))
            yield pa.array(out, pa.float64())

    rows = narrow.withColumn("score", F.arrow_udf(scored, "double")("_text"))
    return rows.select(
        c("_row.doc_id").alias("doc_id"),
        held_out("_row.doc_id").alias("held_out"),
        "score",
        (c("score") >= threshold).cast("int").alias("predicted"),
        "_row",
    )


def toxicity_report(docs: DataFrame, labels: DataFrame) -> DataFrame:
    return score_toxicity(docs.select("doc_id", "text"), labels).drop("_row")


def without_toxic(docs: DataFrame, labels: DataFrame) -> DataFrame:
    """The rows of ``docs`` that score below the threshold, with all their columns."""
    return score_toxicity(docs, labels).where("predicted = 0").select("_row.*")
