"""Parts of the operators against plain versions, on made-up rows."""

import random
import tracemalloc
import tracemalloc
from collections import Counter

import numpy as np
import public_tokenizers
import pyarrow as pa
import pyarrow.compute
import pytest
from hypothesis import given, settings, strategies as st
from pyspark.sql import Window, functions as F
from tokenizers import Tokenizer

from holdfast.llm import exact_dedup, license_scan, mixing, order_minhash, packing, pieces, quality, simhash, suffix_dedup, toxicity
from holdfast.llm.packing import Packer, Piece, as_bytes, rows_of
from holdfast.llm.pieces import Pieces, frequent_table, stretches
from tests.llm.conftest import rows_of as given_rows
from tests.llm.test_queries import linked, removed_by_brute_force, simhash as hashed

PATH = public_tokenizers.path("byte_bpe_50k.json")
BPE = Tokenizer.from_file(PATH)


# Tokens


@settings(max_examples=300, deadline=None)
@given(st.text(st.sampled_from("ab1 \n\t .,'s!é \x1c <|endoftext|>"), max_size=60))
def test_stretches_keep_the_ids(text):
    own = Pieces(PATH, tuple, frequent_table(["a", "b1"], PATH, tuple))
    assert [i for part in own.of(text) for i in part] == BPE.encode(text, add_special_tokens=False).ids
    assert " ".join(stretches(text)) == text


def test_the_cache_is_emptied(monkeypatch):
    monkeypatch.setattr("holdfast.llm.pieces.CACHE_SIZE", 5)
    own = Pieces(PATH, len, frequent_table(["known"], PATH, len))
    text = " ".join(f"w{i}" for i in range(50)) + " known"
    assert sum(own.of(text)) == len(BPE.encode(text).ids)
    assert len(own) <= 7 and "known" in own


def test_plain_stretches_are_not_searched(monkeypatch):
    """Words, words with marks, and two of these with a line end between."""
    words = ["plainword", "marked...", "twolines.\nOther,", "one\ntwo", "éçen.\nÈme", "new.", "marked,"]
    want = [tuple(BPE.encode(" " + w, add_special_tokens=False).ids) for w in words]
    monkeypatch.setattr(Pieces, "parts", lambda self, stretch: pytest.fail(f"searched: {stretch!r}"))
    own = Pieces(PATH, tuple, {})
    assert own.values_of(words) == want
    assert own.values_of(words[::-1]) == want[::-1] and "marked..." not in own


def test_places_of_a_group_go_before_its_texts_are_handed_out():
    """While texts are handed out, a worker holds a group's ids but none of the places behind them."""
    words = [f"w{i % 50}" for i in range(200_000)]
    found = Pieces(PATH, as_bytes, {}).ids(pa.array([" ".join(words)] * 2))
    tracemalloc.start()
    try:
        n, ids = next(found)
        held = tracemalloc.get_traced_memory()[0]
    finally:
        tracemalloc.stop()
    # Both texts' ids, the first one's again, and little else.
    assert len(ids) > 400_000 and held < 4 * len(ids)


ODD = st.text(st.sampled_from("ab1 \n\t .,'s!é \x1c\x85\u2003\u3000\x0b中 <|endoftext|>"), max_size=40)


@settings(max_examples=100, deadline=None)
@given(st.lists(ODD, max_size=12), st.sampled_from([1 << 20, 10]), st.sampled_from([1 << 20, 3]))
def test_batches_of_texts_are_coded_like_single_ones(texts, group, part):
    """Also in small groups and parts, so that texts are cut in all ways."""
    kept = pieces.GROUP, pieces.PART
    pieces.GROUP, pieces.PART = group, part
    try:
        array = pa.array(texts, pa.string())
        want = [BPE.encode(t, add_special_tokens=False).ids for t in texts]
        own = Pieces(PATH, len, frequent_table(["a", "b1"], PATH, len))
        assert own.lengths(array).tolist() == list(map(len, want))
        own = Pieces(PATH, as_bytes, frequent_table(["a", "b1"], PATH, as_bytes))
        found = dict(own.ids(array))
        assert [np.frombuffer(found[i], "<u4").tolist() for i in range(len(texts))] == want
    finally:
        pieces.GROUP, pieces.PART = kept


def test_merging_by_rank_is_the_tokenizers(small_dir, medium_dir):
    """Every stretch of the given texts, and made-up ones; with and without merging by rank."""
    draw, letters = random.Random(5), "aabetnsßéñ中日\U0001f600xqz,.;-\n"
    texts = [t or "" for d in (small_dir, medium_dir) for _, t, _ in given_rows(d)]
    made = ["".join(draw.choice(letters) for _ in range(draw.randint(1, 14))) for _ in range(20_000)]
    words = sorted({w for t in texts for w in stretches(t)} | set(made) - {""})
    words = [w for w in words if w and " " not in w]
    want = [tuple(e.ids) for e in BPE.encode_batch([" " + w for w in words], add_special_tokens=False)]
    own = Pieces(PATH, tuple, {})
    assert own.lines is not None and own.values_of(words) == want
    other = Pieces(PATH, tuple, {})
    other.lines = None
    assert other.values_of(words[::7]) == want[::7]


def test_other_kinds_of_files_are_not_merged_by_rank():
    assert pieces.by_rank(public_tokenizers.path("word_bpe_49k.json")) is None


def test_arrow_and_python_agree_on_white_space():
    """Texts that Arrow cuts have only spaces and line ends that Python's pattern calls clean."""
    every = [f"a{chr(x)}b" for x in range(0x11000) if not 0xD800 <= x < 0xE000]
    odd = pyarrow.compute.match_substring_regex(pa.array(every), pieces._ODD).to_pylist()
    assert [t for t, o in zip(every, odd) if o] == [t for t in every if pieces._OTHER_SPACE.search(t)]


def test_a_workers_pieces_are_kept_for_the_next_task():
    table = frequent_table(["known"], PATH, len)
    own = pieces.kept_pieces(PATH, len, table)
    own.lengths(pa.array(["some unknownish words"]))
    again = pieces.kept_pieces(PATH, len, dict(table))
    assert again is own and "unknownish" in again


# Packing


@pytest.mark.parametrize("most", [1, 3, 9, 40])
def test_short_texts_leave_little_padding(most):
    draw = random.Random(most)
    packer = Packer()
    sizes = [draw.randint(1, most) for _ in range(20_000)]
    sequences = [s for n, size in enumerate(sizes) for s in packer.add(Piece(n, bytes(4 * size), 0, size, size, 0))]
    sequences += list(packer.end())
    used = [sum(p.size() for p in s) for s in sequences]
    assert sum(used) == sum(sizes) and max(used) <= 2048
    assert sum(2048 - u for u in used if u & (u - 1)) == 0


def test_prompts_bear_no_loss(spark, small_dir):
    """Turns of conversations after what came before them, at most 64 loss-bearing tokens a sequence."""
    turns = spark.read.parquet(f"{small_dir}/conversations.parquet")
    order = Window.partitionBy("conv_id").orderBy("turn")
    docs = turns.withColumn("prompt", F.lag("text").over(order)).select(
        F.concat_ws("-", "conv_id", "turn").alias("doc_id"), "prompt", "text"
    ).limit(200)
    rows = docs.collect()
    got = packing.pack_documents(docs, PATH, prompt_col="prompt", loss=64).collect()
    size = lambda t: len(BPE.encode(t or "", add_special_tokens=False).ids)
    whole = {r.doc_id: (size(r.prompt), size(r.prompt) + size(r.text) + 1) for r in rows}
    taken, loss, tokens = Counter(), Counter(), Counter()
    for r in got:
        start, total = whole[r.doc_id]
        assert r.doc_tokens == total
        taken[r.doc_id] += r.length
        tokens[r.sequence_id] += r.length
        loss[r.sequence_id] += max(0, r.start + r.length - max(r.start, start))
    assert taken == {k: total for k, (_, total) in whole.items()}
    assert max(tokens.values()) <= 2048 and max(loss.values()) == 64


@pytest.mark.parametrize("cut", [True, False])
def test_packing_keeps_all_three_limits(cut):
    draw = random.Random(3)
    for _ in range(60):
        tokens, segments, loss = draw.choice([16, 64]), draw.choice([2, 5]), draw.choice([8, 12])
        packer = Packer(tokens, segments, loss, cut=cut, pool=draw.choice([3, 20]))
        examples = []
        for n in range(draw.randrange(40)):
            size = draw.randint(1, 100 if cut else tokens)
            bearing = draw.randint(0, size if cut else min(size, loss))
            examples.append(Piece(n, bytes(range(size)) * 4, 0, size, size, size - bearing))
        sequences = [s for e in examples for s in packer.add(e)] + list(packer.end())
        seen = {e.key: 0 for e in examples}
        for pieces in sequences:
            assert sum(p.size() for p in pieces) <= tokens
            assert len(pieces) <= segments and sum(p.loss() for p in pieces) <= loss
            for p in pieces:
                seen[p.key] += p.size()
        assert seen == {e.key: e.size() for e in examples}
        if not cut:
            assert all(p.size() == p.total for s in sequences for p in s)


def test_an_example_over_the_limits_is_an_error_without_cutting():
    with pytest.raises(ValueError):
        list(Packer(4, 2, 4, cut=False).add(Piece(1, bytes(20), 0, 5, 5, 0)))


def test_rows_follow_without_gaps():
    packer = Packer()
    sequences = [s for n in range(9) for s in packer.add(Piece(n, bytes(4 * 700), 0, 700, 700, 0))] + list(packer.end())
    rows = list(rows_of(iter(sequences), 100))
    assert sum(r[2] for r in rows) == 6300
    assert {r[5] for r in rows} == set(range(100, 100 + len(sequences)))
    # Two full sequences; the rest in powers of two.
    assert sum(p.size() for p in sequences[0]) == 2048


# Exact dedup


@pytest.mark.parametrize("n", [0, 1, 2, 3, 17, 1000, 20_000])
def test_filters_know_all_their_keys(n):
    draw = np.random.default_rng(n)
    keys = np.unique(draw.integers(0, 2**63, n, dtype=np.uint64))
    built = exact_dedup.build_filter(keys)
    assert exact_dedup.probe_filter(keys, *built).all()
    others = draw.integers(0, 2**63, 5000, dtype=np.uint64)
    assert exact_dedup.probe_filter(others, *built).mean() < 0.02


@pytest.mark.parametrize("snapshot", ["doc_id < 0", "doc_id < 1000", "doc_id % 2 = 0", "NULL"])
def test_any_snapshot_gives_the_same_groups(spark, awkward, snapshot):
    docs = spark.read.parquet(f"{awkward}/documents.parquet")
    got = exact_dedup.exact_dedup(docs, F.expr(snapshot).cast("boolean"))
    want = exact_dedup.exact_dedup(docs)
    assert got.exceptAll(want).count() == 0 == want.exceptAll(got).count()


def test_one_row_of_each_text_stays(spark, awkward):
    docs = spark.read.parquet(f"{awkward}/documents.parquet")
    kept = exact_dedup.without_copies(docs)
    assert kept.schema == docs.schema
    texts = [exact_dedup.UPPER for _ in ()] + [(r.text or "").lower() for r in kept.collect()]
    assert sorted(texts) == sorted({(r.text or "").lower() for r in docs.collect()})
    assert {r.doc_id for r in kept.where("lower(text) LIKE 'the river%' AND length(text) < 100").collect()} == {3}


# SimHash


def test_trees_find_all_within_the_radius():
    draw = random.Random(1)
    base = [draw.getrandbits(64) for _ in range(20)]
    values = list({b ^ sum(1 << draw.randrange(64) for _ in range(draw.randrange(5))) for b in base for _ in range(20)})
    tree = simhash.BKTree()
    for n, value in enumerate(values):
        want = {i for i in range(n) if (values[i] ^ value).bit_count() <= 2}
        assert set(tree.near(value, 2)) == want
        tree.add(value)


def test_close_values_share_a_shard():
    draw = random.Random(2)
    for blocks in (simhash.BLOCKS, simhash.FINE_BLOCKS):
        masks = [m & (2**64 - 1) for m in simhash.block_masks(blocks, 2)]
        assert min(m.bit_count() for m in masks) >= (38 if blocks == 5 else 56)
        for _ in range(200):
            a = draw.getrandbits(64)
            b = a ^ 1 << draw.randrange(64) ^ 0
            b ^= 1 << draw.randrange(64)
            assert any(a & m == b & m for m in masks)


@pytest.mark.parametrize("most", [2048, 3])
def test_links_join_what_all_pairs_join(spark, monkeypatch, most):
    """Also when nearly every shard is too large and its members are dealt once more."""
    monkeypatch.setattr(simhash, "SHARD_MOST", most)
    draw = random.Random(5)
    base = [draw.getrandbits(64) for _ in range(6)]
    values = list({b ^ (1 << draw.randrange(64)) ^ (1 << draw.randrange(8)) for b in base for _ in range(25)} | {0, 1, 7})
    signed = [(i, 7, v - (1 << 64) if v >> 63 else v) for i, v in enumerate(values)]
    prints = spark.createDataFrame(signed, "doc_id long, text_hash long, print long")
    got = {r["print"]: r.component_id for r in simhash.labelled(prints).collect()}
    want = {i: root for i, _, root in linked(list(enumerate(values)))}
    assert {i: got[p] for i, _, p in signed} == want


def test_components_of_chains_and_stars(spark):
    draw = random.Random(4)
    edges = [(i, i + 1) for i in range(60)] + [(1000, 1000 + i) for i in range(1, 50)]
    edges += [(2000 + draw.randrange(40), 2000 + draw.randrange(40)) for _ in range(25)]
    got = {r.node: r.root for r in simhash.components(spark.createDataFrame(edges, "a long, b long")).collect()}
    root = {n: n for e in edges for n in e}
    for _ in range(70):
        for a, b in edges:
            root[a] = root[b] = min(root[a], root[b])
    alone = {n for n in root if all(a == b for a, b in edges if n in (a, b))}
    assert got == {n: r for n, r in root.items() if n not in alone}


def test_one_document_of_each_group_stays(spark, awkward):
    docs = spark.read.parquet(f"{awkward}/documents.parquet")
    kept = simhash.one_of_each(docs)
    assert kept.schema == docs.schema
    rows = [(n, hashed(r.text or "")) for n, r in enumerate(docs.collect())]
    assert kept.count() == len({root for _, _, root in linked(rows)})
    assert {1, 4, 7} <= {r.doc_id for r in kept.collect()}


# Suffixes


def test_the_loser_tree_merges_with_right_prefixes():
    draw, width = random.Random(6), 9
    for _ in range(100):
        runs, everything = [], []
        for _ in range(draw.randrange(1, 9)):
            rows = sorted(bytes(draw.choice(b"ab") for _ in range(width)) for _ in range(draw.randrange(12)))
            if rows:
                array = np.frombuffer(b"".join(rows), np.uint8).reshape(-1, width)
                runs.append(([int.from_bytes(r) for r in rows], suffix_dedup.common_prefixes(array)))
                everything += rows
        run, place, prefix = suffix_dedup.merged(runs, width)
        got = [runs[r][0][p].to_bytes(width) for r, p in zip(run, place)]
        assert got == sorted(everything)
        for n in range(1, len(got)):
            same = next((i for i in range(width) if got[n][i] != got[n - 1][i]), width)
            assert prefix[n] == same


def test_front_coding_comes_back():
    draw = np.random.default_rng(1)
    rows = draw.integers(97, 99, (200, 12)).astype(np.uint8)
    rows = rows[suffix_dedup.sorted_order(rows)]
    assert [r.tobytes() for r in rows] == sorted(r.tobytes() for r in rows)
    back, _ = suffix_dedup.front_decoded(*suffix_dedup.front_coded(rows), 12)
    assert (back == rows).all()


def small_docs(draw):
    letters = draw.choice(["ab", "abcdefgh", "a\0b"])
    base = ["".join(draw.choice(letters) for _ in range(draw.randint(0, 80))) for _ in range(6)]
    docs = []
    for _ in range(draw.randint(1, 25)):
        parts = [b[draw.randint(0, len(b)) :][: draw.randint(0, 40)] for b in draw.choices(base, k=draw.randint(0, 5))]
        docs.append(draw.choice(base) if draw.random() < 0.3 else "".join(parts))
    return docs


@pytest.mark.parametrize("crowded, fan", [(0, 64), (0, 2), (1, 3), (1000, 64), (1000, 2)])
def test_repeats_of_any_length(spark, monkeypatch, crowded, fan):
    """Also with few rows in a range and several levels of merging."""
    if fan < 64:
        monkeypatch.setattr(suffix_dedup, "RANGE_ANCHORS", 50)
        monkeypatch.setattr(suffix_dedup, "RANGE_WINDOWS", 60)
    draw = random.Random(crowded)
    for length, kmer in ((6, 2), (15, 4)):
        docs = [d for _ in range(4) for d in small_docs(draw)]
        table = spark.createDataFrame(list(enumerate(docs)), "doc_id long, text string")
        got = suffix_dedup.without_repeats(table, length, kmer, block_bytes=200, crowded=crowded, fan=fan).collect()
        want = removed_by_brute_force([d.encode() for d in docs], length)
        for r in got:
            gone = np.zeros(len(docs[r.doc_id].encode()), bool)
            for a, b in r.spans:
                gone[a:b] = True
            assert (gone == want[r.doc_id]).all(), (docs[r.doc_id], length)
            assert bytes(r.kept) == np.frombuffer(docs[r.doc_id].encode(), np.uint8)[~gone].tobytes()


def test_levels_keep_what_a_task_merges():
    for blocks in (1, 64, 65, 10_000, 3_000_000):
        total = blocks * suffix_dedup.BLOCK_BYTES
        sources = blocks
        for deal in suffix_dedup.levels(blocks, total, 100, 32, 64):
            groups = -(-sources // 64)
            assert 2 * total / 70 / (deal.anchors * groups) <= suffix_dedup.RANGE_ANCHORS
            assert total / (deal.windows * groups) <= suffix_dedup.RANGE_WINDOWS
            sources = groups
        assert sources == 1


def crowded_block(texts):
    """A block all of whose anchors are crowded."""
    block = suffix_dedup.Block(pa.table({"doc_id": range(len(texts)), "text": texts}), 100, 32)
    return block, np.ones(len(block.code), bool)


@pytest.mark.parametrize("slice_", [1 << 20, 150])
def test_equal_windows_of_a_block_are_one(monkeypatch, slice_):
    monkeypatch.setattr(suffix_dedup, "SLICE", slice_)
    draw = random.Random(4)
    line = "".join(draw.choice("abc") for _ in range(130))
    texts = [line + "".join(draw.choice("abc") for _ in range(draw.randint(0, 90))) for _ in range(12)] + [line] * 5 + ["short"]
    block, crowd = crowded_block(texts)
    place, code, gone = suffix_dedup.distinct_windows(block, crowd, 100)
    data, seen, want, again = block.data.tobytes(), {}, [], []
    for low, high in zip(block.starts, block.starts[1:]):
        for at in range(low, high - 99):
            (again if data[at : at + 100] in seen else want).append(at)
            seen[data[at : at + 100]] = at
    assert sorted(place.tolist()) == want and sorted(gone.tolist()) == again


def test_windows_with_equal_hashes_are_told_apart(monkeypatch):
    """Bytes decide when all hashes are equal."""
    block, crowd = crowded_block(["a" * 60 + "b" * 60, "a" * 60 + "b" * 60, "c" * 130])
    monkeypatch.setattr(suffix_dedup, "string_hashes", lambda data, n: np.zeros(len(data) - n + 1, np.uint64))
    place, _, gone = suffix_dedup.distinct_windows(block, crowd, 100)
    data = block.data.tobytes()
    assert sorted([*place, *gone]) == sorted({*range(0, 21), *range(120, 141), *range(240, 271)})
    # What isn't equal to the first goes on as a row, and meets its like in the merge.
    assert {data[i : i + 100] for i in gone} == {data[:100]}


def peak_of(step):
    tracemalloc.start()
    try:
        result = step()
        return result, tracemalloc.get_traced_memory()[1] / 1e6
    finally:
        tracemalloc.stop()


@pytest.mark.parametrize("kind, most", [("letters", 450), ("copies", 200), ("lines", 300)])
def test_hot_blocks_stay_small(kind, most):
    """A block of equal letters, of copies of one text, of texts around one line: peak MB."""
    draw = random.Random(9)
    words = lambda n: " ".join(f"w{draw.randrange(9999)}" for _ in range(n))
    if kind == "letters":
        texts = ["x" * 5_000_000]
    elif kind == "copies":
        texts = [words(300)] * 2300
    else:
        line = words(25)
        texts = [words(20) + " " + line + " " + words(20) for _ in range(9000)]
    table = pa.table({"doc_id": range(len(texts)), "text": texts})
    lists, first = peak_of(lambda: suffix_dedup._hash_lists([pa.scalar(0)], table, 3, 100, 32))
    again = pa.concat_tables([
        suffix_dedup._repeated([pa.scalar(r)], lists.filter(pa.compute.equal(lists["range"], r)), 100)
        for r in lists["range"].unique().to_pylist()
    ])
    deal = suffix_dedup.Deal(3, 25)
    runs, second = peak_of(lambda: suffix_dedup._runs([pa.scalar(0)], table, again, 3, deal, 100, 32))
    assert runs.num_rows and max(first, second) < most, (first, second)


def test_slices_of_a_long_document_agree(monkeypatch):
    data = np.frombuffer(("abcab" * 300 + "xyz" * 200).encode(), np.uint8)
    whole = suffix_dedup.anchors_of(data, 20, 4)
    monkeypatch.setattr(suffix_dedup, "SLICE", 37)
    cut = suffix_dedup.anchors_of(data, 20, 4)

    def windows(found):
        return {w: at for at, low, high, _ in zip(*(x.tolist() for x in found)) for w in range(low, high + 1)}

    assert windows(whole) == windows(cut) and len(windows(whole)) == len(data) - 19


# Order MinHash


def prints_of(spark, texts):
    rows = spark.createDataFrame(list(enumerate(texts)), "i long, text string")
    signed = rows.withColumn("s", order_minhash.signature(F.col("text")))
    pairs = signed.alias("a").join(signed.alias("b"), F.expr("a.i = 0"))
    found = pairs.select(F.col("b.i").alias("i"), order_minhash.likeness(F.col("a.s"), F.col("b.s")).alias("x")).collect()
    return [r.x for r in sorted(found, key=lambda r: r.i)]


def test_fingerprints_follow_the_order(spark):
    words = [f"w{i}" for i in range(1200)]
    same, changed, swapped, shuffled = (
        " ".join(words), " ".join(words[:1100] + [f"x{i}" for i in range(100)]),
        " ".join(words[600:] + words[:600]), " ".join(random.Random(1).sample(words, 1200)),
    )
    likeness = prints_of(spark, [same, same, changed, swapped, shuffled, ""])
    assert likeness[0] == likeness[1] == 1
    assert likeness[2] > 0.6 > likeness[3] > likeness[4]
    assert likeness[4] == likeness[5] == 0


def test_repeats_are_elements_of_their_own(spark):
    once = " ".join(f"w{i}" for i in range(100))
    likeness = prints_of(spark, [once, " ".join([once] * 6)])
    assert likeness[1] < 0.6


def test_the_next_row_crosses_ranges(spark, monkeypatch):
    monkeypatch.setattr(order_minhash, "RANGE_ROWS", 7)
    docs = spark.createDataFrame([(i * 3, f"{i:08d}") for i in range(100)], "doc_id long, text string")
    got = order_minhash.order_fingerprints(docs).collect()
    import hashlib

    assert len(got) == 100
    for r in got:
        i = r.doc_id // 3
        edited = f"{i:08d}"[:6] + f"{(i + 1) % 100:08d}"[:2]
        assert r.edited_sha256 == hashlib.sha256(edited.encode()).hexdigest()


# Mixing


def test_targets_are_shared_again_until_none_is_above(spark):
    draw = random.Random(8)
    for n in (1, 2, 7, 30):
        sizes = {f"s{i:02d}": draw.choice([0, 1, 5, 100, 10_000]) for i in range(n)}
        weights = {s: (3, 1, 2)[k % 3] for k, s in enumerate(sorted(sizes))}
        open_, target, left = set(sizes), {}, 1.5 * sum(sizes.values())
        while True:
            share = {s: left * weights[s] / sum(weights[x] for x in open_) for s in open_}
            full = {s for s in open_ if share[s] > 2 * sizes[s]}
            if not full:
                break
            for s in full:
                target[s] = 2 * sizes[s]
                left -= 2 * sizes[s]
            open_ -= full
        target |= share
        rows = spark.createDataFrame([(s, v) for s, v in sizes.items()], "source string, size long")
        got = {r.source: r.target for r in mixing.source_targets(rows).collect()}
        assert got == pytest.approx(target, abs=1e-6)


def test_mixed_repeats_whole_rows(spark, awkward):
    docs = spark.read.parquet(f"{awkward}/documents.parquet")
    rows = mixing.mixed(docs)
    assert rows.schema == docs.schema
    plan = mixing.mix_plan(docs)
    assert rows.count() == plan.agg(F.sum("copies")).first()[0] > 0


# Licenses, quality, toxicity


def test_edited_notices_are_found_with_their_span():
    index = license_scan.Index.of(license_scan.TEMPLATES)
    text = "Intro, words.\nThis work is now licensed under\nthe GNU General Public License, version 3. More."
    (name, share, matched, start, end), = license_scan.scan(text, index)
    assert (name, matched) == ("GPL-3.0", 12) and share == 1.0
    assert text[start:end] == "This work is now licensed under\nthe GNU General Public License, version 3"
    assert license_scan.scan("the general public may license this work", index) == []


def test_adjacent_notices_have_a_row_each():
    index = license_scan.Index.of(license_scan.TEMPLATES)
    short = ["Apache-2.0", "CC-BY-4.0", "CC-BY-NC-4.0", "CC-BY-SA-4.0", "GPL-3.0", "MIT", "Unlicense"]
    rng = random.Random(3)
    for names in [["Apache-2.0", "CC-BY-4.0"], ["MIT", "MIT"], *(rng.choices(short, k=6) for _ in range(40))]:
        text, want = "", []
        for name in names:
            notice = license_scan.TEMPLATES[name]
            want.append((name, 1.0, len(license_scan.words_of(notice)), len(text), len(text) + len(notice) - 1))
            text += notice + " "
        assert license_scan.scan(text, index) == want, text


@pytest.mark.parametrize("notice, name", [
    ("This work is licensed under the GNU Lesser General Public License, version 3.", "LGPL-3.0"),
    ("This work is licensed under the GNU General Public License, version 2.", "GPL-2.0"),
    ("This work is licensed under the GNU Affero General Public License, version 3.", "AGPL-3.0"),
    ("Licensed under CC BY-ND 4.0.", "CC-BY-ND-4.0"),
    ("Licensed under CC BY-NC-SA 4.0.", "CC-BY-NC-SA-4.0"),
    ("Licensed under CC BY 3.0.", "CC-BY-3.0"),
    ("Released under the zlib License.", "Zlib-released"),
    ("Licensed under the Eclipse Public License, Version 2.0.", "EPL-2.0-licensed"),
])
def test_the_exact_sibling_wins(notice, name):
    text = "Some words before. " + notice + " Some after."
    (row,) = license_scan.scan(text, license_scan.Index.of(license_scan.TEMPLATES))
    assert row == (name, 1.0, len(license_scan.words_of(notice)), 19, 19 + len(notice) - 1)


@pytest.mark.parametrize("odd", ["İ", "ß", "ŉ", "ǰ", "İstanbul", "ΐ.ŉ"])
def test_letters_that_grow_when_lowered(odd):
    """Before, inside and after a notice; spans stay those of the text."""
    index, notice = license_scan.Index.of(license_scan.TEMPLATES), "Released under the MIT License."
    want = notice.rstrip(".")
    for text in (f"{odd}. {notice}", f"{notice} {odd}", f"{odd} {odd} {notice} {odd} {notice}"):
        rows = license_scan.scan(text, index)
        assert len(rows) == text.count(notice)
        assert all(text[r[3] : r[4]] == want for r in rows)
    text = f"{odd} Licensed under the Apache {odd} License, Version 2.0"
    (row,) = license_scan.scan(text, index)
    assert row[0].startswith("Apache-2.0") and text[row[3] : row[4]] == text[len(odd) + 1 :]


def test_all_patterns_of_other_voters_weigh(spark):
    """More patterns than any limit would keep; their weights add up to the voter's."""
    size = 20
    first = size - 1 - toxicity.OTHERS
    rows = [(bytes([first - 1 - i % 5, *([first] if i % 2 else [first + 1])]) + bytes([19] * (i // 10)), 1 + i % 3) for i in range(3000)]
    patterns = spark.createDataFrame([(bytearray(p), n) for p, n in rows], "pattern binary, texts long")
    got = toxicity.supported(patterns, size, 1000).collect()
    assert len(got) == 3000
    assert sum(r.weight for r in got) == pytest.approx(2 * toxicity.SUPPORT * 1000)


def test_full_texts_are_their_own():
    index = license_scan.Index.of(license_scan.TEMPLATES)
    full = [n for n in index.names if n.endswith("-full")]
    assert len(full) > 20
    for name in full:
        words = license_scan.words_of(license_scan.TEMPLATES[name])
        text = "intro " + " ".join(words) + " outro"
        assert license_scan.scan(text, index) == [(name, 1.0, len(words), 6, len(text) - 6)]


@settings(max_examples=200, deadline=None)
@given(st.lists(st.integers(0, 3), min_size=1, max_size=7), st.lists(st.integers(-1, 3), min_size=1, max_size=14))
def test_alignments_are_the_longest_and_shortest(template, words):
    """Against a full alignment of the whole text."""
    template, words = np.array(template), np.array(words)
    places = license_scan.banded(template, words, 0, len(words) + len(template))

    def longest(part):
        row = [0] * (len(part) + 1)
        for word in template.tolist():
            new = [0]
            for j, other in enumerate(part.tolist()):
                new.append(row[j] + 1 if word == other else max(row[j + 1], new[j]))
            row = new
        return row[-1]

    best = longest(words)
    assert len(places) == best == longest(words[places])
    if best:
        spans = [(b - a, a) for a in range(len(words)) for b in range(a, len(words)) if longest(words[a : b + 1]) == best]
        assert (places[-1] - places[0], places[0]) == min(spans)


def test_rules_are_the_paths_of_printed_trees():
    printed = (
        "RandomForestClassificationModel: uid=x, numTrees=1\n  Tree 0 (weight 1.0):\n    If (feature 0 <= 2.5)\n"
        "     If (feature 3 <= 0.1)\n      Predict: 0.0\n     Else (feature 3 > 0.1)\n      Predict: 1.0\n"
        "    Else (feature 0 > 2.5)\n     Predict: 1.0\n"
    )
    a, b = quality.NAMES[0], quality.NAMES[3]
    assert {r.parts for r in quality.rules_of(printed)} == {
        ((a, False, 2.5),), ((a, True, 2.5),),
        tuple(sorted([(a, False, 2.5), (b, False, 0.1)])), tuple(sorted([(a, False, 2.5), (b, True, 0.1)])),
    }


def test_the_label_model_finds_the_good_voters():
    draw = np.random.default_rng(2)
    truth = draw.random(4000) < 0.15
    good = [(truth & (draw.random(4000) < 0.6)) | (draw.random(4000) < 0.01) for _ in range(5)]
    bad = [draw.random(4000) < 0.1 for _ in range(2)]
    copies = [good[0]] * 3
    votes = np.stack([*good, *bad, *copies], axis=1).astype(int)
    clean = np.where(votes.any(axis=1), 0, -1)[:, None]
    model = toxicity.LabelModel().fit(np.hstack([votes, clean]))
    rates = model.accuracies()
    assert min(rates[:5]) > 0.8 > 0.5 > max(rates[5:7])
    assert model.weight[0] < 0.6 < model.weight[1]
    posterior = model.posterior(np.hstack([votes, clean]))
    assert ((posterior > 0.5) == truth).mean() > 0.95


def test_copies_and_phrases_make_no_lexicon():
    """A word that stands in many copies of one toxic text, a phrase of clean ones, real ones."""
    found = [
        toxicity.Found("copied", 40, 40, 3, 3),
        toxicity.Found("abuse", 60, 60, 70, 70),
        toxicity.Found("abu-", 60, 90, 70, 71),
        toxicity.Found("stem-", 50, 50, 90, 90),
        toxicity.Found("stemmy", 20, 20, 30, 30),
        toxicity.Found("plain", 20, 200, 20, 200),
    ]
    assert toxicity.chosen_entries(found, 0.1, 10.0) == ["abuse", "stem-"]


def test_votes_on_all_documents_reach_the_scores(spark, monkeypatch):
    """Abuse in unlabelled documents only: insults that no labelled text has, and masked words."""
    rng = random.Random(7)

    def plain():
        return " ".join(rng.choice("river stone cloud meadow lantern garden harbour window".split()) for _ in range(30))

    texts = [(i, plain() + (" you idiot moron" if i % 10 == 0 else "")) for i in range(600)]
    texts += [(1000 + i, plain() + " such vermin, wretched scumbag " + rng.choice(["f#ck", "sh*t"])) for i in range(200)]
    texts += [(2000 + i, plain()) for i in range(600)]
    docs = spark.createDataFrame(texts, "doc_id long, text string")
    labels = spark.createDataFrame([(i, int(i % 10 == 0)) for i in range(600)], "doc_id long, toxic int")
    scores = {r.doc_id: r.score for r in toxicity.toxicity_report(docs, labels).collect()}
    unseen, clean = [scores[1000 + i] for i in range(200)], [scores[2000 + i] for i in range(600)]
    assert min(unseen) > 0.5 > 0.3 > max(clean)
    monkeypatch.setattr(toxicity, "PATTERNS", 1)
    for r in toxicity.toxicity_report(docs, labels).collect():
        assert abs(r.score - scores[r.doc_id]) < 1e-6


def test_all_distinct_texts_are_counted_by_pattern(spark):
    voters = toxicity.Voters(["dolt", "brut-"])
    texts = ["a dolt", "a dolt", "brutal brutish sh*t", "brut", "plain", None, "You IDIOT!"]
    docs = spark.createDataFrame([(t,) for t in texts], "text string")
    got = {tuple(r.pattern): r.texts for r in toxicity.vote_patterns(docs, voters).collect()}
    assert got == {(0,): 1, (1, 3, 5): 1, (7,): 3, (2, 6): 1}


def test_labels_of_other_rows_decide_nothing(spark, small_dir):
    """Flipping every held-out label changes no score."""
    docs = spark.read.parquet(f"{small_dir}/documents.parquet")
    labels = spark.read.parquet(f"{small_dir}/labels.parquet")
    for report, out, label in (
        (quality.score_quality, quality.held_out(), "quality"),
        (toxicity.toxicity_report, toxicity.held_out(), "toxic"),
    ):
        flipped = labels.withColumn(label, F.when(out, 1 - F.col(label)).otherwise(F.col(label)))
        a, b = report(docs, labels), report(docs.drop("source", "lang"), flipped)
        assert a.exceptAll(b).count() == 0


def test_no_labels_and_labels_of_one_class(spark, small_dir):
    docs = spark.read.parquet(f"{small_dir}/documents.parquet")
    labels = spark.read.parquet(f"{small_dir}/labels.parquet")
    assert {r.score for r in quality.score_quality(docs, labels.limit(0)).collect()} == {0.5}
    ones = quality.score_quality(docs, labels.withColumn("quality", F.lit(1))).collect()
    assert min(r.score for r in ones) > 0.99
    for some in (labels.limit(0), labels.withColumn("toxic", F.lit(0))):
        scores = toxicity.toxicity_report(docs, some).collect()
        assert len(scores) == docs.count() and all(0 <= r.score <= 1 for r in scores)


# The pipeline


def test_pipeline_stages_keep_the_columns_and_take_effect(spark, awkward, medium_dir):
    import corpus_pipeline

    for folder in (awkward, medium_dir):
        docs = spark.read.parquet(f"{folder}/documents.parquet")
        columns, before = docs.columns, docs.count()
        for name, stage in corpus_pipeline.STAGES:
            docs = corpus_pipeline.stored(stage(spark, docs, folder), f"test-{name}")
            if name == "packing":
                assert "sequence_id" in docs.columns
                break
            assert docs.columns == columns
            after = docs.count()
            if folder == medium_dir and name in ("toxicity", "exact_dedup"):
                assert 0.8 * before < after < before
            before = after
        assert docs.select("doc_id").distinct().count() > 0


def test_pipeline_of_nothing(spark, nothing):
    import corpus_pipeline

    assert corpus_pipeline.run(spark, nothing).count() == 0


def test_arrow_types_come_back():
    assert pa.types.is_int64(suffix_dedup.RUN_ARROW.field("range").type)
