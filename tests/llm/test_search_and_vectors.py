import math

import numpy as np
import pytest
from oracle import same
from pyspark.sql import functions as F

from factweave.llm import embedding_dedup as E
from factweave.llm import exact_topk as K

SCHEMA = "vec_id long, embedding array<float>, label int, score long, rep long"
NAN, INF = float("nan"), float("inf")
ODD = [(0, [1.0, 0.5], 1, 1, 1), (1, None, 1, 1, 1), (2, [NAN, 1.0], 1, 1, 1), (3, [INF, 1.0], 1, 1, 1), (4, [None, 1.0], 1, 1, 1), (5, [0.0, 0.0], 1, 1, 1), (6, [1.0, 0.5], 1, 1, 1), (7, [2.0, 1.0], 1, 1, 1), (20, [1.0, 0.5], 1, 1, 1), (20, [1.0, 0.5], 1, 1, 1), (9, [1.0, -9.0], 1, 1, 1), (10, [3.0], 1, 1, 1), (11, [], 1, 1, 1)]


@pytest.fixture
def odd(spark):
    return spark.createDataFrame(ODD, SCHEMA)


def test_topk_against_sql(spark, sf_dir):
    same(K.op2_exact_topk(spark, sf_dir), sf_dir, K.OP2_SQL)


def test_topk_odd_rows(spark, odd, folder):
    where = folder(embeddings=odd)
    same(K.op2_exact_topk(spark, where), where, K.OP2_SQL)
    assert K.top_k(odd.where("false"), F.lit(True)).count() == 0


@pytest.mark.parametrize("scale", [3, 10**6, 10**8])
def test_blocks_against_brute_force(scale):
    rng = np.random.default_rng(scale)
    cells = rng.integers(-scale, scale, (300, 16))
    cells[50:90] = cells[10]  # ties
    ids = np.arange(300)
    ids[200:210] = ids[100:110]  # two vectors each
    blocks = [K.Block(ids[i : i + 32], cells[i : i + 32]) for i in range(0, 300, 32)]
    score, found, visits = K.search_blocks(cells[:40], ids[:40], blocks, 20)
    for q in range(40):
        best = {}
        for i in range(300):
            if ids[i] != q:
                got = sum(int(a) * int(b) for a, b in zip(cells[q], cells[i], strict=True))
                best[int(ids[i])] = max(got, best.get(int(ids[i]), got))
        every = sorted((-s, i) for i, s in best.items())[:20]
        assert list(zip((-score[q]).tolist(), found[q].tolist(), strict=True)) == every
    assert visits.max() <= len(blocks)
    again, names, fewer = K.search_blocks(cells[:40], ids[:40], blocks, 20, floor=score[:, -1])
    assert (again == score).all() and (names == found).all() and (fewer <= visits).all()


def test_bounds_skip_blocks():
    cells = np.ones((320, 4), np.int64)
    cells[:32] = 100
    blocks = [K.Block(np.arange(i, i + 32), cells[i : i + 32]) for i in range(0, 320, 32)]
    assert K.search_blocks(cells[:1], np.array([0]), blocks, 20)[2].tolist() == [1]


def clusters(spark, rows, spread=0.05):
    rng = np.random.default_rng(rows)
    centres = rng.normal(size=(rows // 100, 16))
    x = centres[np.arange(rows) % len(centres)] + rng.normal(size=(rows, 16)) * spread
    return spark.createDataFrame([(i, v.tolist(), 0, 0, 0) for i, v in enumerate(x.astype(np.float32))], SCHEMA)


@pytest.mark.parametrize(("shard", "dealt"), [(4096, 1 << 16), (200, 1 << 16), (200, 7)])
def test_clustered_vectors_against_sql(spark, folder, monkeypatch, shard, dealt):
    """With one shard or many, and where many queries deal a shard over copies."""
    monkeypatch.setattr(K, "SHARD_ROWS", shard)
    monkeypatch.setattr(K, "DEALT", dealt)
    where = folder(embeddings=clusters(spark, 2000))
    same(K.op2_exact_topk(spark, where), where, K.OP2_SQL)


def test_pruning_skips_most_blocks_of_clustered_vectors(spark, monkeypatch):
    monkeypatch.setattr(K, "BLOCK", 32)
    share = K.visited_share(clusters(spark, 6000), F.col("vec_id") % 20 == 0).selectExpr("sum(visits) / sum(blocks) AS share", "count(*) AS n").first()
    assert share.n == 300 and share.share < 0.35


def test_dedup_odd_rows(spark, odd):
    got = {(r.vec_id, r.n_links, r.component_id, r.kept) for r in E.near_duplicates(odd).collect()}
    one = {(0, 4, 0, True), (6, 4, 0, False), (7, 4, 0, False), (20, 4, 0, False)}
    alone = {(i, 0, i, True) for i in (1, 2, 3, 4, 5, 9, 10, 11)}
    assert got == one | alone
    assert E.near_duplicates(odd.where("false")).count() == 0


def brute(x, least=0.9):
    x = x / np.linalg.norm(x, axis=1, keepdims=True)
    return x @ x.T >= least


def test_dedup_against_brute_force(spark):
    rng = np.random.default_rng(1)
    centres = rng.normal(size=(40, 32))
    x = np.concatenate([centres[i % 40] + rng.normal(size=32) * 0.08 for i in range(400)]).reshape(400, 32).astype(np.float32)
    x = np.concatenate([x, np.repeat(x[:1], 300, 0), rng.normal(size=(300, 32)).astype(np.float32)])
    df = spark.createDataFrame([(i, v.tolist(), 0, 0, 0) for i, v in enumerate(x)], SCHEMA)
    got = sorted(tuple(r) for r in E.near_duplicates(df).collect())
    links = brute(x.astype(float))
    degree = links.sum(1) - 1
    mine = np.array([g[1] for g in got])
    assert (mine <= degree).all() and mine.sum() >= 0.9 * degree.sum()
    a, b = np.nonzero(links)
    from factweave.llm.common import local_roots

    assert [g[2] for g in got] == local_roots(len(x), a, b).tolist()


def test_window_links_see_only_the_window():
    a, b, sure = E.window_links(np.ones((10, 2)) / np.sqrt(2), 0.9, window=3)
    assert (b - a).max() == 3 and len(a) == 7 * 3 + 2 + 1 and sure.all()


def test_blocks_of_one_component(spark, monkeypatch):
    monkeypatch.setattr(E, "BLOCK", 8)  # rows of one product; blocks of the component: sqrt(50) / 2
    x = np.random.default_rng(2).normal(size=(50, 8)) * 0.05 + 1
    df = spark.createDataFrame([(i, v.tolist(), 0, 0, 0) for i, v in enumerate(x)], SCHEMA)
    assert {(r.n_links, r.component_id) for r in E.near_duplicates(df).collect()} == {(49, 0)}


def test_passes_grow_with_the_classes():
    """The formula gives a recall of 0.95 at cosine 0.9 for every size."""
    assert E.passes_for(1000) == E.PASSES < E.passes_for(10**6) < E.passes_for(10**8)
    for n in (10**5, 10**6, 10**7, 10**9):
        p = (1 - np.arccos(0.9) / np.pi) ** np.log2(n / E.WINDOW)
        assert 1 - (1 - p) ** E.passes_for(n) >= 0.95


def test_links_across_partitions(spark, monkeypatch):
    """One pass over one cone of vectors: every two neighbours in the order are linked."""
    monkeypatch.setattr(E, "PASSES", 1)
    monkeypatch.setattr(E, "WINDOW", 8)
    monkeypatch.setattr(E, "passes_for", lambda *_: 1, raising=False)
    x = np.random.default_rng(6).normal(size=(400, 8)) * 0.05 + 1
    df = spark.createDataFrame([(i, v.tolist(), 0, 0, 0) for i, v in enumerate(x)], SCHEMA)
    assert {(r.n_links, r.component_id) for r in E.near_duplicates(df).collect()} == {(399, 0)}


def test_rounded_vectors_give_no_wrong_verdict():
    """A sure link is one, and a pair that is not listed is none, in doubles."""
    rng = np.random.default_rng(8)
    x = rng.normal(size=(4, 64))[np.arange(64) % 4] + rng.normal(size=(64, 64)) * rng.uniform(0.1, 0.6, (64, 1))
    x /= np.linalg.norm(x, axis=1, keepdims=True)
    small, step = E.squeezed(x)
    near, slack = E.restored(E.pa.chunked_array([E.pa.array(small, E.pa.binary())]), step)
    a, b, sure = E.window_links(near, 0.9, slack)
    exact = {(i, j) for i, j in zip(*np.nonzero(np.triu(x @ x.T >= 0.9, 1)), strict=True)}
    assert set(zip(a[sure], b[sure], strict=True)) <= exact <= set(zip(a, b, strict=True)) and 0 < sure.sum() < len(sure)


def test_ids_below_zero_doubles_and_repeated_ids(spark):
    """Negative ids name components; doubles keep their precision; one id may have two vectors."""
    rows = [(-5, [1.0, 0.0]), (-4, [2.0, 0.0]), (-3, [-1.0, 0.0]), (3, [0.0, 1.0]), (3, [0.0, -1.0]), (4, [0.0, -2.0]), (None, [-2.0, 0.0]), (9, [0.9 - 1e-9, math.sqrt(1 - (0.9 - 1e-9) ** 2)]), (None, [-0.7, -0.7])]
    for kind in ("double", "float"):
        table = spark.createDataFrame(rows if kind == "double" else rows[:-2], f"vec_id long, embedding array<{kind}>")
        got = sorted((str(r.vec_id), r.n_links, r.component_id) for r in E.near_duplicates(table).collect())
        want = [("-3", 1, -3), ("-4", 1, -5), ("-5", 1, -5), ("3", 0, 3), ("3", 1, 3), ("4", 1, 3), ("None", 1, -3)] + ([("9", 0, 9), ("None", 0, None)] if kind == "double" else [])
        assert got == sorted(want), kind


@pytest.mark.parametrize("rows", [10_000, 100_000])
def test_planted_pairs_are_met(rows):
    """Recall of the passes at cosine 0.90 to 0.92 among random rows, by the keys alone."""
    rng = np.random.default_rng(rows)
    x = rng.normal(size=(rows, 64))
    x /= np.linalg.norm(x, axis=1, keepdims=True)
    pairs = 300
    side = rng.normal(size=(pairs, 64))
    side -= (side * x[:pairs]).sum(1, keepdims=True) * x[:pairs]
    side /= np.linalg.norm(side, axis=1, keepdims=True)
    cosine = rng.uniform(0.9, 0.92, (pairs, 1))
    x[pairs : 2 * pairs] = cosine * x[:pairs] + np.sqrt(1 - cosine**2) * side
    met = np.zeros(pairs, bool)
    keys = E.projection_keys(x, E.passes_for(rows))
    for p in range(keys.shape[1]):
        place = np.empty(rows, int)
        place[np.argsort(keys[:, p], kind="stable")] = np.arange(rows)
        met |= np.abs(place[:pairs] - place[pairs : 2 * pairs]) <= E.WINDOW
    assert met.mean() >= 0.9
