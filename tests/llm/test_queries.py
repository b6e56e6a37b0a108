"""The registered queries against SQL or brute force, on given and on awkward tables."""

import hashlib
import os
import re
import zlib
from collections import Counter, defaultdict

import duckdb
import numpy as np
import public_tokenizers
import pytest
import xxhash
from tokenizers import Tokenizer

from holdfast.llm import license_scan, queries, sql
from tests.llm.conftest import DATA, key, rows_of

QUERIES = queries.queries()
BPE = Tokenizer.from_file(public_tokenizers.path("byte_bpe_50k.json"))
WORD = re.compile("[^\x20\x09-\x0d]+")


def connect(folder):
    con = duckdb.connect()
    for name in ("documents", "labels", "embeddings"):
        path = f"{folder}/{name}.parquet"
        con.sql(f"CREATE VIEW {name} AS SELECT * FROM '{path}{'/*.parquet' if os.path.isdir(path) else ''}'")
    return con


@pytest.fixture(params=["small_dir", "awkward"])
def folder(request):
    return request.getfixturevalue(request.param)


@pytest.mark.parametrize("name", sorted(sql.oracle_sql()))
def test_sql(spark, folder, name):
    want = connect(folder).sql(sql.oracle_sql()[name])
    columns = sorted(want.columns)
    got = QUERIES[name](spark, folder)
    assert sorted(got.columns) == columns
    at = {n: i for i, n in enumerate(want.columns)}
    expected = sorted((tuple(r[at[n]] for n in columns) for r in want.fetchall()), key=key)
    assert sorted((tuple(r[n] for n in columns) for r in got.collect()), key=key) == expected


def test_empty_tables(spark, nothing):
    for name, query in QUERIES.items():
        assert query(spark, nothing).collect() == [], name


def test_op1_counts_like_the_library(spark, folder):
    got = sorted((tuple(r) for r in QUERIES["op1_token_counts"](spark, folder).collect()), key=key)
    want = []
    for i, text, _ in rows_of(folder):
        n = len(BPE.encode(text or "", add_special_tokens=False).ids)
        want.append((i, len((text or "").encode()), n, n > 512))
    assert got == sorted(want, key=key)


def test_op2_scans_like_alignment_everywhere(spark, folder):
    """Every template is aligned at every diagonal; the index must lose no match of that."""
    got = defaultdict(set)
    for r in QUERIES["op2_license_scan"](spark, folder).collect():
        got[r.doc_id].add((r.license, r.start, r.end))
    index = license_scan.Index.of(license_scan.TEMPLATES)
    short = [(i, t) for i, t, _ in rows_of(folder) if t and len(t) < 4000]
    for i, text in short:
        words = license_scan.words_of(text)
        codes = np.array([index.vocabulary.get(w, -1) for w in words], np.int64)
        for name, template in zip(index.names, index.codes):
            for diagonal in range(len(words)) if (codes >= 0).sum() > 3 else ():
                part = codes[diagonal : diagonal + len(template)]
                if len(part) == len(template) and (part == template).all():
                    places = [m.span() for m in license_scan._WORD.finditer(text)]
                    start, end = places[diagonal][0], places[diagonal + len(template) - 1][1]
                    assert any(a <= start and end <= b for _, a, b in got[i]), (i, name)
    texts = {i: t for i, t, _ in rows_of(folder)}
    for i, found in got.items():
        for _, a, b in found:
            assert 0 <= a < b <= len(texts[i])


def order_of(rows):
    return sorted(rows, key=lambda r: (r[0] is not None, r[0] or 0))


def test_op3_fingerprints(spark, small_dir):
    got = {r.doc_id: r for r in QUERIES["op3_order_minhash"](spark, small_dir).collect()}
    rows = order_of((i, t or "") for i, t, _ in rows_of(small_dir))
    assert len(got) == len(rows)
    prints = {}
    for (i, text), (_, following) in zip(rows, rows[1:] + rows[:1]):
        q = len(text) // 4
        edited = text[: len(text) - q] + following[:q]
        assert got[i].n_chars == len(text)
        assert got[i].edited_sha256 == hashlib.sha256(edited.encode()).hexdigest()
        assert 0 <= got[i].near_edited <= 1 and 0 <= got[i].near_next <= 1
        assert prints.setdefault(text, got[i].fingerprint) == got[i].fingerprint
    long = [got[i] for i, t in rows if len(t) > 1500]
    assert np.mean([r.near_edited for r in long]) > 0.3 > 0.1 > np.mean([r.near_next for r in long])


def test_op3_survives_awkward_rows(spark, awkward):
    got = QUERIES["op3_order_minhash"](spark, awkward).collect()
    assert len(got) == len(rows_of(awkward))
    by_text = {r.doc_id: r.fingerprint for r in got}
    assert by_text[1] == by_text[2] != by_text[3] and by_text[5] == by_text[6] == ""


def test_op4_takes_near_the_targets(spark, medium_dir):
    rows = QUERIES["op4_mixing"](spark, medium_dir).collect()
    taken, target = Counter(), {}
    for r in rows:
        taken[r.source] += r.taken
        target[r.source] = r.target
        assert 0 <= r.taken <= 2 * r.size
    assert abs(sum(taken.values()) / sum(target.values()) - 1) < 0.02
    assert all(abs(taken[s] / target[s] - 1) < 0.15 for s in target)
    assert {tuple(r) for r in rows} == {tuple(r) for r in QUERIES["op4_mixing"](spark, medium_dir).collect()}


def removed_by_brute_force(texts, length=100):
    """Bytes covered by a string of the length that also starts earlier."""
    seen, out = set(), []
    for data in texts:
        gone = np.zeros(len(data), bool)
        for at in range(len(data) - length + 1):
            part = data[at : at + length]
            if part in seen:
                gone[at : at + length] = True
            else:
                seen.add(part)
        out.append(gone)
    return out


def test_op5_removes_what_starts_earlier(spark, folder):
    got = sorted(
        ((r.doc_id, r.n_bytes, r.n_removed, r.n_spans, r.kept_sha256)
         for r in QUERIES["op5_suffix_dedup"](spark, folder).collect()), key=key,
    )
    rows = sorted(((i, (t or "").encode()) for i, t, _ in rows_of(folder)), key=lambda r: (r[0] is not None, r[0] or 0, r[1]))
    want = []
    for (i, data), gone in zip(rows, removed_by_brute_force([d for _, d in rows])):
        kept = np.frombuffer(data, np.uint8)[~gone].tobytes()
        spans = int((np.diff(np.concatenate([[0], gone.astype(int)])) == 1).sum())
        want.append((i, len(data), int(gone.sum()), spans, hashlib.sha256(kept).hexdigest()))
    assert got == sorted(want, key=key)


def test_op6_packs_every_token_once(spark, folder):
    got = QUERIES["op6_packing"](spark, folder).collect()
    known = defaultdict(list)
    for i, text, _ in rows_of(folder):
        known[i].append(BPE.encode(text or "", add_special_tokens=False).ids + [1])
    pieces, sequences = Counter(), defaultdict(list)
    for r in got:
        assert any(
            len(ids) == r.doc_tokens and len(ids[r.start : r.start + r.length]) == r.length
            and zlib.crc32(np.array(ids[r.start : r.start + r.length], "<u4").tobytes()) == r.ids_crc32
            for ids in known[r.doc_id]
        )
        pieces[r.doc_id] += r.length
        sequences[r.sequence_id].append((r.offset, r.length))
    assert pieces == {i: sum(map(len, all_ids)) for i, all_ids in known.items()}
    padding = 0
    for parts in sequences.values():
        size = 0
        for offset, length in sorted(parts):
            assert offset == size
            size += length
        assert size <= 2048
        padding += 0 if size & (size - 1) == 0 else 2048 - size
    assert padding <= 0.01 * sum(pieces.values()) + 2048


def simhash(text, shingle=3):
    words = WORD.findall("".join(chr(ord(x) + 32) if "A" <= x <= "Z" else x for x in text))
    shingles = [" ".join(words[i : i + shingle]) for i in range(max(1, len(words) - shingle + 1))] if words else []
    hashes = [xxhash.xxh64_intdigest(s.encode(), seed=42) for s in shingles]
    return sum(1 << b for b in range(64) if 2 * sum(h >> b & 1 for h in hashes) > len(hashes)) if hashes else 0


def linked(prints, radius=2):
    """Smallest id reachable over links, by comparing all pairs."""
    ids = list(range(len(prints)))
    for a in range(len(prints)):
        for b in range(a):
            if (prints[a][1] ^ prints[b][1]).bit_count() <= radius:
                old, new = ids[a], ids[b]
                if old != new:
                    ids = [new if x == old else x for x in ids]
    least = {}
    for n, (i, _) in enumerate(prints):
        if i is not None:
            least[ids[n]] = min(i, least.get(ids[n], i))
    return [(i, f"{p:016x}", least.get(ids[n])) for n, (i, p) in enumerate(prints)]


def test_op8_links_fingerprints(spark, folder):
    got = sorted((tuple(r) for r in QUERIES["op8_simhash"](spark, folder).collect()), key=key)
    prints = [(i, simhash(t or "")) for i, t, _ in rows_of(folder)]
    assert got == sorted(linked(prints), key=key)


@pytest.mark.parametrize(
    "name, label, fold, folds, least", [("op9_quality", "quality", 1, 3, 0.95), ("op10_toxicity", "toxic", 2, 4, 0.9)]
)
def test_scores_of_held_out_rows(spark, name, label, fold, folds, least):
    folder = f"{DATA}/sf0.1"
    rows = QUERIES[name](spark, folder).collect()
    known = dict(connect(folder).sql(f"SELECT doc_id, {label} FROM labels").fetchall())
    assert len(rows) == len(rows_of(folder))
    bound = 0.5 if label == "quality" else 0.3
    for r in rows:
        assert 0 <= r.score <= 1 and r.predicted == int(r.score >= bound)
        assert r.held_out == (zlib.crc32(str(r.doc_id).encode()) % folds == fold)
    out = [(r.score, known[r.doc_id]) for r in rows if r.held_out and r.doc_id in known]
    pos, neg = [s for s, y in out if y == 1], [s for s, y in out if y == 0]
    area = np.mean([(a > b) + (a == b) / 2 for a in pos for b in neg])
    assert area > least


@pytest.mark.parametrize("name", ["op9_quality", "op10_toxicity"])
def test_scores_of_awkward_rows(spark, awkward, name):
    rows = QUERIES[name](spark, awkward).collect()
    assert Counter(r.doc_id for r in rows) == Counter(i for i, *_ in rows_of(awkward))
    assert all(0 <= r.score <= 1 for r in rows)
