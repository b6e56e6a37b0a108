"""Diagrams and counts of failed filters against going through documents one by one."""

import math
import random
from itertools import permutations

from hypothesis import given, settings, strategies as st
from pyspark.sql import functions as F

from holdfast.llm import filter_audit
from holdfast.llm.filter_audit import Diagram, audited, swaps

c = F.col


def test_swaps_lead_through_all_orders():
    for n in range(1, 7):
        order, seen = list(range(n)), {tuple(range(n))}
        for place in swaps(n):
            order[place], order[place + 1] = order[place + 1], order[place]
            assert tuple(order) not in seen
            seen.add(tuple(order))
        assert len(seen) == math.factorial(n)


def plain(masks, filters, width):
    """Every order over every mask."""
    rows, shapley = [], [0] * filters
    for order in permutations(range(filters)):
        left = dict(masks)
        for step, f in enumerate(order, 1):
            gone = {m: x for m, x in left.items() if m >> f & 1}
            left = {m: x for m, x in left.items() if not m >> f & 1}
            add = lambda part: tuple(map(sum, zip((0,) * width, *part.values())))
            removed, kept = add(gone), add(left)
            shapley[f] += removed[0]
            fails = sum(x[0] for m, x in masks.items() if m >> f & 1)
            only = masks.get(1 << f, (0,))[0]
            rows.append((order, step, f, removed, kept, fails, only))
    return sorted((*r, shapley[r[2]]) for r in rows)


@settings(max_examples=60, deadline=None)
@given(st.integers(1, 5), st.integers(0, 2**32))
def test_diagrams_count_like_lists(filters, seed):
    draw = random.Random(seed)
    masks = {m: (draw.randint(1, 3), draw.randint(0, 1)) for m in range(1 << filters) if draw.random() < 0.5}
    assert sorted(audited(masks, filters, 2)) == plain(masks, filters, 2)


def test_equal_nodes_are_one_after_each_swap():
    draw = random.Random(1)
    diagram = Diagram({m: (draw.randint(0, 1),) for m in range(32)}, 5, 1)
    for place in swaps(5):
        diagram.swap(place)
        for level in diagram.levels:
            for (low, high), node in level.items():
                assert (id(node.low), id(node.high)) == (low, high)
                assert node.weight == (node.low.weight[0] + node.high.weight[0],)
            assert len({(id(n.low), id(n.high)) for n in level.values()}) == len(level)


def test_copies_marks_and_parts(spark):
    """A hot text over parts, repeated and null ids, repeated marks."""
    rows = [(i, "same text", "ab"[i % 2]) for i in range(3, 60)]
    rows += [(3, "same text", "a"), (2, "other", None), (1, "other", ""), (None, "same text", "a"), (None, "x", None)]
    docs = spark.createDataFrame([(*r, "p", 1) for r in rows], "doc_id long, text string, source string, part string, mask int")
    marked = spark.createDataFrame([(3, True), (3, False), (4, True), (4, True), (None, True), (5, None), (2, False)], "doc_id long, good boolean")
    masks = filter_audit.failure_masks(docs, {"A": c("text") == "other"}, marked, c("source"))
    assert sorted(map(tuple, masks.select("part", "mask", "docs", "good").collect())) == plain_masks(rows)


def plain_masks(rows):
    good, least, counts = {3, 4}, {}, {}
    for i, t, _ in rows:
        if i is not None:
            least[t] = min(i, least.get(t, i))
    for i, t, s in rows:
        mask = (t == "other") + 2 * (i is not None and least[t] < i)
        n, g = counts.get((s or "", mask), (0, 0))
        counts[s or "", mask] = n + 1, g + (i in good)
    return sorted((s, m, n, g) for (s, m), (n, g) in counts.items())


def test_other_filters_and_marks(spark):
    docs = spark.createDataFrame([(i, str(i % 5), "s") for i in range(40)], "doc_id long, text string, source string")
    marked = spark.createDataFrame([(i, i % 2 == 0) for i in range(40)], "doc_id long, even boolean")
    filters = {"X": c("doc_id") < 10, "Y": c("doc_id") % 3 == 0}
    masks = filter_audit.failure_masks(docs, filters, marked, c("source"))
    got = filter_audit.interactions(masks, "XYZ", ["even"]).where("filter_order = 'XYZ'").orderBy("step").collect()
    # X takes 0 to 9, Y every third of the others, Z (copies of 0 to 4) what is left.
    assert [(r.removed, r.kept, r.even_lost) for r in got] == [(10, 30, 5), (10, 20, 5), (20, 0, 10)]
    assert [r.redundant for r in got] == [0, 4, 15]
