"""Exact scores, negatives and searches against plain products, on made-up vectors."""

import numpy as np
import pytest
from hypothesis import given, settings, strategies as st
from pyspark.sql import functions as F

from holdfast.llm import exact_search, hard_negatives, vectors
from holdfast.llm.vectors import NONE, Grid, best

c = F.col


@settings(max_examples=60, deadline=None)
@given(st.integers(1, 200), st.integers(0, 27), st.integers(0, 2**32 - 1))
def test_residues_give_the_exact_product(dims, bits, seed):
    draw = np.random.default_rng(seed)
    a, b = (draw.integers(-(1 << bits), (1 << bits) + 1, (n, dims)) for n in (3, 5))
    bound = int(max((a.astype(object) ** 2).sum(1).max(), (b.astype(object) ** 2).sum(1).max()))
    primes = hard_negatives.moduli(bound)
    got = hard_negatives.products(hard_negatives.residues(a, primes), hard_negatives.residues(b, primes), primes)
    assert (got.astype(object) == a.astype(object) @ b.astype(object).T).all()


def test_extreme_residues_stay_exact():
    """All residues at the edge of the range, over more columns than one product may take."""
    primes = hard_negatives.primes_below(1024)[:3]
    assert hard_negatives.STEP * (primes[0] // 2) ** 2 <= 2**24
    a = np.full((2, 130), primes[0] // 2)
    got = hard_negatives.products(hard_negatives.residues(a, primes), hard_negatives.residues(-a, primes), primes)
    assert (got == -(a[0] @ a[0])).all()


def test_few_primes_suffice_for_the_bound():
    for bound in (0, 1, 65_536, 2**40, 2**55):
        primes = hard_negatives.moduli(bound)
        product = np.prod(np.array(primes, object)) if primes else 1
        assert product > 2 * bound + 1
        assert not primes or product // primes[-1] <= 2 * bound + 1


@settings(max_examples=100, deadline=None)
@given(st.lists(st.lists(st.sampled_from([NONE, -3, 0, 1, 2]), min_size=6, max_size=6), max_size=5), st.integers(1, 7))
def test_best_takes_the_leftmost_of_equals(rows, k):
    scores = np.array(rows, np.int64).reshape(-1, 6)
    row, column = best(scores, k)
    want = [
        (i, j) for i, r in enumerate(rows)
        for j in sorted((j for j in range(6) if r[j] != NONE), key=lambda j: (-r[j], j))[:k]
    ]
    assert list(zip(row.tolist(), column.tolist())) == want


def made_up(spark, n=700, dims=5, seed=1, spread=2.0):
    """Vectors of very different lengths; a third are one vector."""
    draw = np.random.default_rng(seed)
    points = draw.normal(size=(n, dims)) * np.exp(draw.normal(size=(n, 1)) * spread)
    points[::3] = points[0]
    rows = [(i, [float(x) for x in p], int(i % 4)) for i, p in enumerate(points)]
    return spark.createDataFrame(rows, "vec_id long, embedding array<double>, label int").repartition(7), rows


def scores_of(rows):
    ids, label = np.array([r[0] for r in rows]), np.array([r[2] for r in rows])
    whole = np.floor(256 * np.array([r[1] for r in rows])).astype(np.int64)
    return ids, label, whole @ whole.T


@pytest.fixture(params=["one shard", "many shards"])
def small_cells(request, monkeypatch):
    if request.param == "many shards":
        for module in (exact_search, hard_negatives):
            monkeypatch.setattr(module, "grid", lambda df, rows, queries, dims: Grid(9, 3))


@pytest.mark.parametrize("spread", [0.0, 2.0])
def test_search_finds_what_all_products_find(spark, small_cells, spread):
    df, rows = made_up(spark, spread=spread)
    ids, _, scores = scores_of(rows)
    got = sorted(map(tuple, exact_search.top_inner_products(df, c("vec_id") % 10 == 3, 4).collect()))
    want = []
    for i in range(3, len(rows), 10):
        order = [j for j in np.lexsort((ids, -scores[i])) if j != i][:4]
        want += [(i, n, j, scores[i, j]) for n, j in enumerate(order, 1)]
    assert got == sorted(want)


def test_long_vectors_leave_the_search_early(spark):
    """Chunks of short vectors are never compared."""
    draw = np.random.default_rng(2)
    points = np.concatenate([draw.normal(size=(300, 8)) * 50, draw.normal(size=(5000, 8))])
    table = __import__("pyarrow").table({
        "row": np.arange(len(points)), "vec_id": np.arange(len(points)),
        "vector": [np.floor(256 * p).astype(np.int32).tolist() for p in points],
        "norm2": (np.floor(256 * points) ** 2).sum(1),
    })
    seen = []
    whole = exact_search.survivors

    def counted(q, asked, p, low, high, least):
        seen.append((low, high))
        return whole(q, asked, p, low, high, least)

    exact_search.survivors = counted
    try:
        search = exact_search.longest_first(table, 8, np.eye(8), 3)
        batch = table.slice(0, 5).append_column("least", __import__("pyarrow").nulls(5, "double")).to_batches()[0]
        found = list(search(batch))
    finally:
        exact_search.survivors = whole
    assert len(found[0]) == 15 and max(high for _, high in seen) < 1000


def test_rotation_turns_onto_singular_vectors(spark):
    df, rows = made_up(spark, n=200)
    stored = vectors.prepared(df, "vec_id", "embedding", {}, "test")
    turn = exact_search.rotation(stored, 5)
    whole = np.floor(256 * np.array([r[1] for r in rows]))
    assert np.allclose(turn.T @ turn, np.eye(5))
    lengths = np.linalg.norm(whole @ turn, axis=0)
    assert (np.diff(lengths) <= 1e-6 * lengths[0]).all()
    assert np.allclose(lengths, np.linalg.svd(whole, compute_uv=False))


def test_more_coordinates_than_are_rotated(spark, monkeypatch):
    monkeypatch.setattr(exact_search, "ROTATED", 3)
    test_search_finds_what_all_products_find(spark, None, 1.0)


def test_negatives_lie_in_the_window_of_their_positive(spark, small_cells):
    df, rows = made_up(spark, n=400, spread=0.3)
    ids, label, scores = scores_of(rows)
    got = sorted(map(tuple, hard_negatives.hard_negatives(
        df, c("vec_id") % 20 == 1, c("label"), positives=3, negatives=4, least=70
    ).collect()))
    want = []
    for i in range(1, len(rows), 20):
        same = [j for j in np.lexsort((ids, -scores[i])) if label[j] == label[i] and j != i][:3]
        for j in same:
            top = scores[i, j]
            near = [n for n in np.lexsort((ids, -scores[i])) if label[n] != label[i] and 70 * top <= 100 * scores[i, n] <= 100 * top]
            want += [(i, j, r, n, top, scores[i, n]) for r, n in enumerate(near[:4], 1)]
    assert got == sorted(want) and len({w[0] for w in want}) > 10


def test_components_beyond_32_bits_are_an_error(spark):
    df = spark.createDataFrame([(1, [1e9])], "vec_id long, embedding array<double>")
    with pytest.raises(Exception, match="32 bits"):
        vectors.integer_vectors(df, "embedding").collect()


def test_lengths_beyond_64_bits_are_an_error(spark):
    df = spark.createDataFrame([(0, [8e6] * 4, 1)], "vec_id long, embedding array<double>, label int")
    with pytest.raises(ValueError, match="64 bits"):
        exact_search.search_report(df)
    with pytest.raises(ValueError, match="64 bits"):
        hard_negatives.mined(df)
