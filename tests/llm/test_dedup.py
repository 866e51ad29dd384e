import hashlib
import random

import numpy as np
import pytest
import xxhash
from hypothesis import given, settings
from hypothesis import strategies as st

from factweave.llm import simhash as H
from factweave.llm import suffix_dedup as D
from factweave.llm.common import Stages, connected_components, local_roots


def slow_print(text):
    import re

    words = re.findall(r"[^\x20\x09-\x0D]+", "".join(chr(ord(c) + 32) if "A" <= c <= "Z" else c for c in text or ""))
    if not words:
        return 0
    shingles = [" ".join(words[i : i + 3]) for i in range(max(1, len(words) - 2))]
    hashes = [xxhash.xxh64_intdigest(s.encode(), 42) for s in shingles]
    return sum(1 << b for b in range(64) if 2 * sum(h >> b & 1 for h in hashes) > len(shingles))


@settings(max_examples=150, deadline=None)
@given(st.text(alphabet="aBÉ \t\n\x0b\x1cc日", max_size=40) | st.none())
def test_fingerprint(text):
    assert H.fingerprint(text) == slow_print(text)


def test_golay_words_within_two_share_a_key():
    rng = np.random.default_rng(4)
    table, count = H.error_patterns()
    assert set(count.tolist()) == {1, 6} and (count == 6).sum() == 1771
    x = rng.integers(0, 1 << 23, 500)
    for flips in (0, 1, 2):
        y = x.copy()
        for i in range(500):
            for b in rng.choice(23, flips, replace=False):
                y[i] ^= 1 << b
        kx, ky = [[set() for _ in x] for _ in range(2)]
        for keys, words in ((kx, x), (ky, y)):
            for r, k in zip(*H.golay_keys(words), strict=True):
                keys[r].add(int(k))
        assert all(a & b for a, b in zip(kx, ky, strict=True))


@pytest.mark.parametrize("wide", [1, 4, 256])
def test_components_against_brute_force(spark, monkeypatch, wide):
    """Also where every key is too wide and the exact way for the rest does all the work."""
    monkeypatch.setattr(H, "WIDE", wide)
    rng = np.random.default_rng(wide)
    centres = rng.integers(0, 1 << 63, 30, dtype=np.uint64) << np.uint64(1)
    prints = {int(c) for c in centres} | {0}
    for _ in range(600):
        v = int(centres[rng.integers(30)])
        for b in rng.choice(64, rng.integers(0, 6), replace=False):
            v ^= 1 << int(b)
        prints.add(v)
    own = np.array(sorted(prints), np.uint64).view(np.int64)
    own.sort()
    df = spark.createDataFrame([(int(v),) for v in own], "fp long")
    got = {r.node: r.component for r in H.components(spark, df, Stages(spark)).collect()}
    bits = own.view(np.uint64)
    a, b = np.nonzero(np.bitwise_count(bits[:, None] ^ bits[None, :]) <= 2)
    root = own[local_roots(len(own), a, b)]
    assert {int(v): got.get(int(v), int(v)) for v in own} == dict(zip(own.tolist(), root.tolist(), strict=True))


def test_chains_and_hubs(spark):
    rows = [(i, i + 1) for i in range(40)] + [(100, 100 + i) for i in range(1, 60)] + [(7, 7), (None, 3)]
    got = dict(tuple(r) for r in connected_components(Stages(spark), spark.createDataFrame(rows, "a long, b long")).collect())
    assert got == {i: 0 for i in range(41)} | {100 + i: 100 for i in range(60)}


@pytest.mark.parametrize("hub", ["least", "greatest"])
def test_hubs_of_all_links(spark, hub):
    """A node with nearly all links, the smallest or the greatest of its component."""
    centre = 0 if hub == "least" else 10_000
    rows = [(centre, i) for i in range(1, 1500)] + [(20_000 + i, 20_001 + i) for i in range(5)]
    got = dict(tuple(r) for r in connected_components(Stages(spark), spark.createDataFrame(rows, "a long, b long")).collect())
    assert got == {i: min(centre, 1) for i in [centre, *range(1, 1500)]} | {20_000 + i: 20_000 for i in range(6)}


def test_simhash_odd_rows(docs_of, odd_rows, spark):
    rows = sorted((tuple(r) for r in H.near_duplicates(docs_of(odd_rows)).collect()), key=str)
    assert len(rows) == len(odd_rows)
    component = {r[0]: r[2] for r in rows}
    assert component[1] == component[2] == component[3] == 1 and component[6] == component[5] == 5 and component[None] is None
    assert H.near_duplicates(docs_of([])).count() == 0
    kept = H.stage_simhash(spark, docs_of([r for r in odd_rows if r[0]][:-1]), "")
    assert {r.doc_id for r in kept.collect()} == {-3, 1, 4, 5, 7, 8} and kept.columns == docs_of([]).columns


def brute(docs, need=100):
    seen, out = {}, {}
    for i, t in sorted(docs):
        b = t.encode()
        gone = np.zeros(len(b), bool)
        for p in range(len(b) - need + 1):
            if seen.setdefault(b[p : p + need], (i, p)) != (i, p):
                gone[p : p + need] = True
        runs = int((np.diff(np.concatenate([[0], gone.astype(int)])) == 1).sum())
        out[i] = (len(b), int(gone.sum()), runs, hashlib.sha256(np.frombuffer(b, np.uint8)[~gone].tobytes()).hexdigest())
    return out


def corpus(seed):
    rng = random.Random(seed)
    words = ["".join(rng.choices("abcdefgé", k=rng.randint(2, 9))) for _ in range(400)]
    passage = " ".join(rng.choices(words, k=60))
    docs = []
    for i in range(120):
        body = [" ".join(rng.choices(words, k=rng.randint(0, 80)))]
        if i % 3 == 0:
            body.insert(rng.randint(0, 1), passage[rng.randint(0, 40) : len(passage) - rng.randint(0, 40)])
        if i % 5 == 0 and docs:
            near = list(rng.choice(docs)[1])
            for _ in range(2):
                if near:
                    near[rng.randrange(len(near))] = "#"
            body.append("".join(near))
        if i % 17 == 0:
            body.append("xy" * 150 + "z" * 130)
        docs.append((i, " ".join(body)))
    return docs


@pytest.mark.parametrize(("hot", "wide", "buffer"), [(64, 4096, 1 << 21), (2, 4096, 1 << 21), (64, 3, 1 << 21), (64, 4096, 1000)])
def test_suffix_dedup_against_brute_force(spark, folder, docs_of, monkeypatch, hot, wide, buffer):
    """Each way through: buckets, hot anchors by window, wide buckets by window, texts in parts."""
    monkeypatch.setattr(D, "HOT_UNITS", hot)
    monkeypatch.setattr(D, "WIDE_UNITS", wide)
    docs = corpus(hot + wide)
    got = {r[0]: tuple(r)[1:] for r in D.op8_suffix_dedup(spark, folder(documents=docs_of(docs))).collect()}
    assert got == brute(docs)
    if buffer < 1 << 20:
        keep = D._tables()
        monkeypatch.setattr(D, "BUFFER", buffer)
        parts = list(D._buffers(iter([((1, 0), b"a" * 5000), ((2, 0), b"b")])))
        monkeypatch.undo()
        assert {o for _, _, _, offsets in parts for o in offsets} >= {0, 900} and keep is D._tables()


def test_maximal_repeats():
    text = b"banana bandana "
    suffixes = [text[i:] for i in range(len(text))]
    before = [text[i - 1] if i else -1 for i in range(len(text))]
    got = {(text[m[0] : m[0] + n], tuple(sorted(m))) for n, m in D.maximal_repeats(suffixes, before, 2)}
    assert got == {(b"ban", (0, 7)), (b"ana", (1, 3, 11)), (b"an", (1, 3, 8, 11)), (b"ana ", (3, 11))}


@settings(max_examples=150, deadline=None)
@given(st.text(alphabet="ab", min_size=6, max_size=40), st.integers(2, 5))
def test_longest_repeats_of_suffixes_are_those_of_all_maximal_ones(text, least):
    """The longest repeat in which a place is not the earliest, from every maximal repeat with all its occurrences."""
    raw = text.encode()
    suffixes = [raw[i:] for i in range(len(raw))]
    before = [raw[i - 1] if i else -1 for i in range(len(raw))]
    rank = np.random.default_rng(len(raw)).permutation(len(raw))
    order, common = D.suffix_array(suffixes)
    length, source = D.repeated_suffixes(np.array(order), common, np.array(before), rank, least)
    want = {}
    for size, members in D.maximal_repeats(suffixes, before, least):
        first = min(members, key=lambda i: rank[i])
        for i in members:
            if i != first and size > want.get(i, (0, 0))[0]:
                want[i] = (size, first)
    assert {order[i]: (int(n), order[source[i]]) for i, n in enumerate(length) if n} == want


def test_intervals_are_nested_and_whole():
    common = [0, 3, 2, 2, 5, 0, 4]
    assert list(D.prefix_intervals(common, 2)) == [(3, 0, 1), (5, 3, 4), (2, 0, 4), (4, 5, 6)]


def test_suffix_odd_rows(spark, folder, docs_of, odd_rows):
    long = "".join(chr(0x100 + i) for i in range(110))
    rows = [*odd_rows, (9, long), (10, long), (11, long[:-1])]
    table = docs_of(rows).collect()
    got = {r.doc_id: (r.n_bytes, r.n_removed) for r in D.op8_suffix_dedup(spark, folder(documents=docs_of(rows))).collect()}
    assert got[1] == got[2] == (0, 0) and got[9] == (220, 0) and got[10] == (220, 220) and got[11] == (218, 218) and got[None] == (5, 0)
    clean = {r.doc_id: r.text for r in D.stage_suffix_dedup(spark, docs_of(rows), "").collect()}
    assert clean[9] == long and clean[10] == "" and clean[1] is None and clean[4] == "a"
    done = D.stage_suffix_dedup(spark, docs_of(rows), "")
    assert done.schema == docs_of(rows).schema and len(done.collect()) == len(table) and {(r["__cuts"], r["__doc"], r.base) for r in done.collect()} == {("c", "d", "b")}
    assert D.op8_suffix_dedup(spark, folder(documents=docs_of([]))).count() == 0


def test_one_id_with_different_texts(spark, folder, docs_of):
    """Each text is a document of its own; what one of them repeats of the other goes once, and none crashes."""
    rng = random.Random(9)
    one, two, tail = (" ".join("".join(rng.choices("abcdefg", k=6)) for _ in range(n)) for n in (60, 90, 40))
    rows = [(1, one), (1, two + one), (1, one), (2, two), (3, tail), (3, "")]
    got = sorted((r.doc_id, r.n_bytes, r.n_removed) for r in D.op8_suffix_dedup(spark, folder(documents=docs_of(rows))).collect())
    sizes = {t: len(t) for t in (one, two)}
    first = {r[1] for r in got if r[0] == 1 and r[2] == 0}
    assert [r[:2] for r in got] == sorted((i, len(t)) for i, t in rows) and got[3][2] + got[4][2] + got[5][2] in (0, sizes[two])
    repeated = sum(r[2] for r in got if r[0] == 1)
    assert repeated in (sizes[one], 2 * sizes[one]) and first and [r[2] for r in got if r[0] == 2] == [sizes[two]] and [r[2] for r in got if r[0] == 3] == [0, 0]
    assert len(D.stage_suffix_dedup(spark, docs_of(rows), "").collect()) == len(rows)


def test_hashes_are_not_believed(spark, folder, docs_of, monkeypatch):
    """With a hash that takes all units for equal, the bytes differ, and other hashes are tried."""
    real, tried = D.repeats, []

    def careless(docs, stages, n, seed):
        tried.append(seed)
        hashed, tree = real(docs, stages, n, seed)
        if not seed:
            wrong = spark.createDataFrame([(1, 0, 0, 100, 0, 0, 0)], D.REPEAT)
            hashed = hashed.unionByName(wrong)
        return hashed, tree

    monkeypatch.setattr(D, "repeats", careless)
    docs = [(0, "a" * 50 + "b" * 80), (1, "c" * 60 + "d" * 70), (2, "x" + "c" * 60 + "d" * 70)]
    got = {r[0]: tuple(r)[1:] for r in D.op8_suffix_dedup(spark, folder(documents=docs_of(docs))).collect()}
    assert tried == [0, 1] and got == brute(docs)


@given(st.lists(st.tuples(st.integers(0, 2), st.integers(0, 3), st.integers(0, 40)), min_size=1, max_size=60), st.integers(1, 9))
def test_leaves_are_found_whatever_the_batches(rows, cut):
    """Streamed groups give the repeats and leaves that whole ones do."""
    rows = sorted((k, u, d, 0, (s * 7) * 128 + 1) for k, u, d, s in [(k, u, i % 5, s) for i, (k, u, s) in enumerate(rows)])
    columns = [np.array(c, np.int64) for c in zip(*[(*r, 0, 0, -1) for r in rows], strict=True)]
    names = D._names(D._ROW)
    whole = [D._batch(names, *columns)]
    split = [D._batch(names, *(c[i : i + cut] for c in columns)) for i in range(0, len(rows), cut)]
    told = [sorted(tuple(r.values()) for b in D._grouped(iter(x)) for r in b.to_pylist()) for x in (whole, split)]
    leaves = {}
    for k, u, d, t, s in rows:
        leaves.setdefault(k, {}).setdefault(u, (d, t, s >> 7))
    want = sorted((k, *p) for k, own in leaves.items() if len(own) > 1 for p in own.values())
    assert told[0] == told[1] and sorted((r[1], *r[2:5]) for r in told[0] if r[0] == 2) == want


@pytest.mark.parametrize(("hot", "wide", "parts"), [(160, 2048, 1), (160, 2048, 3), (2, 2048, 3), (160, 1, 3)])
def test_suffix_repeated_rows(spark, folder, docs_of, monkeypatch, hot, wide, parts):
    """A row repeated under its id keeps its text, each way through; later documents lose theirs."""
    monkeypatch.setattr(D, "HOT_UNITS", hot)
    monkeypatch.setattr(D, "WIDE_UNITS", wide)
    rng = random.Random(3)
    text, other, head = (" ".join("".join(rng.choices("abcdefg", k=6)) for _ in range(60)) for _ in range(3))
    docs = [(1, text), (1, text), (2, other), (3, text + other), (4, head + text[:200]), (5, head), (2, other), (6, "#" + text[100:300] + "#")]
    table = docs_of(docs).repartition(parts)
    got = sorted(tuple(r) for r in D.op8_suffix_dedup(spark, folder(documents=table)).collect())
    want = brute(dict(docs).items())
    assert got == sorted((i, *want[i]) for i, _ in docs) and want[1][1] == 0 == want[2][1]
