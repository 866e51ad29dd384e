import random

import numpy as np
import pytest

from factweave.llm import shingles as N
from factweave.llm.common import local_roots
from factweave.llm.simhash import golay_keys, stage_simhash


def corpus(seed):
    """Groups of near copies at many similarities, around 0.8 too, and lone texts."""
    rng = random.Random(seed)
    words = ["".join(rng.choices("abcdefg", k=6)) for _ in range(3000)]
    docs = []
    for i in range(60):
        base = rng.choices(words, k=rng.randint(60, 200))
        docs.append(" ".join(base))
        for _ in range(60 if i == 0 else rng.randint(0, 4)):
            own = list(base)
            for _ in range(rng.randint(0, 5)):
                own[rng.randrange(len(own))] = rng.choice(words)
            docs.append(" ".join(own))
    rng.shuffle(docs)
    return docs


def brute(docs):
    sets = [{tuple(w[i : i + 5]) for i in range(len(w) - 4)} for w in (d.split() for d in docs)]
    links = [(i, j) for i in range(len(sets)) for j in range(i) if len(sets[i] & sets[j]) / len(sets[i] | sets[j]) >= 0.8]
    a, b = np.array(links).T
    return local_roots(len(docs), a, b)


@pytest.mark.parametrize("wide", [1, 32])
def test_stage_against_brute_force(spark, docs_of, monkeypatch, wide):
    """Also where most keys are too wide for all pairs. Two bits of three-word prints miss most of these."""
    monkeypatch.setattr(N, "WIDE", wide)
    docs = corpus(wide)
    got = {r.doc_id for r in stage_simhash(spark, docs_of(list(enumerate(docs))), "").collect()}
    assert got == set(brute(docs).tolist())


def test_similar_at_the_limit():
    a = np.arange(10, dtype=np.uint64)
    assert N.similar(a[:8], a) and not N.similar(a[:7], a) and N.similar(a[:9], a[1:]) and not N.similar(a[:8], a[1:])
    assert len(N.band_keys(N.shingles(" \n"))) == 0 == N.identity(N.shingles(None))


def test_stage_keeps_rows_without_id_and_one_of_repeated_rows(spark, docs_of, odd_rows):
    rows = [*odd_rows, (None, "a b c d e f g"), (None, "a b c d e f g"), (None, "The same text, twice over."), (12, "of its own"), (12, "other text, same id")]
    got = sorted(((r.doc_id, r.text) for r in stage_simhash(spark, docs_of(rows), "").collect()), key=str)
    once = {1: None, 4: "a", 5: "The same text, twice over.", 7: odd_rows[6][1], 8: odd_rows[7][1]}
    once |= {-3: "below zero"}
    assert got == sorted([*once.items(), (5, odd_rows[-2][1]), (None, "no id"), (None, "a b c d e f g"), (12, "of its own"), (12, "other text, same id")], key=str)


def test_shapes_rule_out_no_similar_pair(spark):
    rng = np.random.default_rng(4)
    rows = []
    for i in range(300):
        base = np.unique(rng.integers(0, 1 << 63, rng.integers(1, 400), np.uint64) << np.uint64(1))
        other = np.unique(np.concatenate([base[rng.random(len(base)) < rng.uniform(0.7, 1)], rng.integers(0, 1 << 63, rng.integers(0, 40), np.uint64)]))
        rows.append((i, N.shape(base).tolist(), N.shape(other).tolist(), N.similar(base, other)))
    table = spark.createDataFrame(rows, "i int, a array<long>, b array<long>, good boolean")
    out = table.select("good", N.may_be_similar("a", "b").alias("may")).collect()
    assert all(r.may for r in out if r.good) and sum(not r.may for r in out) > 50 and sum(r.good for r in out) > 50


def test_fingerprints_are_majorities_of_mixed_hashes():
    own = N.shingles(" ".join(f"w{i % 701}x{i % 13}" for i in range(900)))
    got = N.fingerprints(own, 3)
    for table, fingerprint in enumerate(got.tolist(), 1):
        ones = [0] * 64
        for h in own.tolist():
            z = (h + table * 0x9E3779B97F4A7C15) % 2**64
            z = (z ^ z >> 30) * 0xBF58476D1CE4E5B9 % 2**64
            z = (z ^ z >> 27) * 0x94D049BB133111EB % 2**64
            z ^= z >> 31
            ones = [n + (z >> i & 1) for i, n in enumerate(ones)]
        assert [fingerprint >> i & 1 for i in range(64)] == [2 * n > len(own) for n in ones]
        row, word = golay_keys(np.array([fingerprint & (1 << 23) - 1]))
        assert sorted(N.fuzzy_keys(got[table - 1 : table], 9, 4)[1].tolist()) == sorted(9 << 53 | (fingerprint >> 23 & 15) << 12 | w for w in word.tolist())


@pytest.mark.parametrize("one, two, both", [(4, 5, 4), (12, 15, 12), (90, 90, 80)])
def test_sets_at_the_limit_share_a_key(one, two, both):
    rng = np.random.default_rng(one)
    for exact in (0, 2):
        for _ in range(500):
            own = rng.integers(0, 1 << 64, one + two - both, np.uint64, endpoint=False)
            a, b = own[:one], own[one - both :]
            assert N.similar(np.sort(a), np.sort(b)) and np.isin(N.band_keys(a, exact), N.band_keys(b, exact)).any()
            assert np.bitwise_count(N.fingerprints(a, 2) ^ N.fingerprints(b, 2)).sum() <= N.RADIUS


def test_words_share_fuzzy_keys_as_often_as_said():
    rng = np.random.default_rng(6)
    for far, share in enumerate(N.MET):
        met = 0
        for _ in range(1500):
            word = int(rng.integers(0, 1 << 23))
            row, key = golay_keys(np.array([word, word ^ sum(1 << int(i) for i in rng.choice(23, far, replace=False))]))
            met += bool(set(key[row == 0].tolist()) & set(key[row == 1].tolist()))
        assert abs(met / 1500 - share) < 0.05


@pytest.mark.parametrize("big", [1, 40, 512])
def test_close_pairs_connect_what_all_pairs_do(monkeypatch, big):
    monkeypatch.setattr(N, "BIG", big)
    rng = np.random.default_rng(5)
    key, near, far = np.sort(rng.integers(0, 12, 400)), *rng.integers(0, 1 << 64, (2, 400), np.uint64, endpoint=False)
    for i in range(1, 400):
        if rng.random() < 0.6:
            j = rng.integers(max(0, i - 30), i)
            near[i], far[i] = (x[j] ^ np.bitwise_or.reduce(np.uint64(1) << rng.integers(0, 64, 18, np.uint64)) for x in (near, far))
    shape = [rng.integers(8, 11, 400).astype(np.uint64), *np.left_shift(np.uint64(1), rng.integers(0, 2, (4, 400)).astype(np.uint64))]
    look = [[int(v) for v in x] for x in (near, far, *shape)]

    def good(i, j):
        apart, both = [(x[i] ^ x[j]).bit_count() for x in look], look[2][i] + look[2][j]
        return apart[0] + apart[1] <= N.RADIUS and 9 * sum(apart[3:]) <= both and 9 * abs(look[2][i] - look[2][j]) <= both

    links = [(i, j) for i in range(400) for j in range(i) if key[i] == key[j] and good(i, j)]
    want = local_roots(400, *np.array(links).T)
    assert 50 < len(set(want.tolist())) < 390
    assert local_roots(400, *N.close_pairs(key, [near, far, *shape])).tolist() == want.tolist()


def test_stage_with_bits_matched_exactly(spark, docs_of, monkeypatch):
    monkeypatch.setattr(N, "DENSE", 5)
    docs = corpus(8)
    got = {r.doc_id for r in stage_simhash(spark, docs_of(list(enumerate(docs))), "").collect()}
    assert N.exact_bits(len(docs)) >= 2 and got == set(brute(docs).tolist())


def test_all_candidates_come_from_keys_of_fingerprints(spark, docs_of, monkeypatch):
    docs = corpus(9)[:60]
    dealt = N._dealt
    monkeypatch.setattr(N, "_dealt", lambda *args: dealt(*args).where("false"))
    assert stage_simhash(spark, docs_of(list(enumerate(docs))), "").count() == len({N.identity(N.shingles(d)) for d in docs})


def test_pairs_grow_with_the_sets_of_a_group_not_with_their_square(spark, docs_of, monkeypatch):
    """Near copies of one text around 0.8: rows of all joins that make pairs, before any are taken once."""
    rng, asked, links = random.Random(12), [], N._links
    words = ["".join(rng.choices("abcdefg", k=6)) for _ in range(3000)]
    base = rng.choices(words, k=150)
    docs = []
    for i in range(240):
        own = list(base)
        for _ in range(i % 6):
            own[rng.randrange(len(own))] = rng.choice(words)
        docs.append(" ".join(own))

    def counted(pairs, *args):
        asked.append(pairs.count())
        return links(pairs, *args)

    monkeypatch.setattr(N, "_links", counted)
    got = {r.doc_id for r in stage_simhash(spark, docs_of(list(enumerate(docs))), "").collect()}
    want = set(brute(docs).tolist())
    assert got == want and len(want) < 100
    assert asked[0] < len(docs) and sum(asked) < 4 * len(docs), asked


def test_folded_sketches_are_parities_of_fewer_buckets():
    rng = np.random.default_rng(7)
    sets = [np.sort(rng.integers(0, 1 << 64, n, np.uint64, endpoint=False)) for n in (1, 60, 900)]
    got = N.folded(np.stack([N.shape(x) for x in sets]))
    assert got[:, 0].tolist() == [1, 60, 900] and got.shape[1] == 1 + N.FOLDED // 64
    for own, row in zip(sets, got[:, 1:], strict=True):
        odd = np.bincount((own >> np.uint64(54)).astype(np.int64) % N.FOLDED, minlength=N.FOLDED) & 1
        assert np.unpackbits(np.ascontiguousarray(row).view(np.uint8)).tolist() == odd.tolist()
