import numpy as np
import pytest

from factweave.llm import language_id as L


def test_presence_is_the_set_of_grams_whatever_the_batch():
    texts = ["abcabc", "", "é", "xyz" * 1000, "Ab"]
    alone = np.concatenate([L.presence([t]) for t in texts])
    assert (L.presence(texts) == alone).all()
    assert (L.presence(["AB"]) == L.presence(["ab"])).all() and L.presence([""]).sum() == 0


def test_long_texts_in_parts(monkeypatch):
    text = "the quick brown fox jumps over the lazy dog " * 50
    whole = L.presence([text])
    monkeypatch.setattr(L, "CHUNK", 97)
    assert (L.presence([text]) == whole).all()


def test_held_out_accuracy(spark):
    docs = spark.read.parquet("/root/testdata/sf0.01/documents.parquet").select("doc_id", "lang")
    got = L.op1_language_id(spark, "/root/testdata/sf0.01").join(docs, "doc_id").where("held_out").toPandas()
    assert (got.lang_pred == got.lang).mean() > 0.97
    assert got.score.between(0, 1).all()


def test_odd_rows(docs_of, odd_rows, spark):
    docs = docs_of(odd_rows)
    model = L.fit_bits(L.presence(["abc def", "ghi jkl"]), ["x", "y"])
    out = L.predict(docs, model)
    rows = out.collect()
    assert len(rows) == len(odd_rows) and set(docs.columns) - {"score"} <= set(out.columns)
    assert {(r.doc_id, r.lang_pred) for r in rows if r.doc_id in (1, 2, 3)} == {(i, "und") for i in (1, 2, 3)}
    assert {r.lang_pred for r in rows if r.doc_id in (4, 5, 8)} <= {"x", "y"}


@pytest.mark.parametrize("rows", [[], [(1, None)]])
def test_nothing_to_learn_from(folder, docs_of, spark, rows):
    got = L.op1_language_id(spark, folder(documents=docs_of(rows, extra=False))).collect()
    assert [(r.lang_pred, r.score) for r in got] == [("und", 0.0)] * len(rows)


def test_labels_of_held_out_rows_are_not_used(spark, folder):
    import zlib

    held = [i for i in range(60) if zlib.crc32(str(i).encode()) % 3 == 1]
    rows = [(i, "aaa bbb" if i % 2 else "ccc ddd", "wrong" if i in held else ("x" if i % 2 else "y"), "s", 7) for i in range(60)]
    d = spark.createDataFrame(rows, "doc_id long, text string, lang string, source string, n_chars long")
    got = L.op1_language_id(spark, folder(documents=d)).collect()
    assert all(r.lang_pred == ("x" if r.doc_id % 2 else "y") for r in got) and {r.doc_id for r in got if r.held_out} == set(held)


def test_folded_matrix_scores_as_the_dense_kernel_ridge():
    """Scores by the folded matrix equal those of Nystroem features made from kernel values, one by one."""
    rng = np.random.default_rng(5)
    texts = ["".join(rng.choice(list(letters), 40)) for letters in ("abcde", "cdefg", "xyzab") for _ in range(20)]
    langs = [x for x in "pqr" for _ in range(20)]
    bits = L.presence(texts)
    model = L.fit_bits(bits, langs, landmarks=25)
    grams = [set(np.flatnonzero(b).tolist()) for b in bits]

    def kernel(a, b):
        return len(a & b) / np.sqrt(max(len(a), 1) * max(len(b), 1))

    marks = [grams[i] for i in np.random.default_rng(7).permutation(len(texts))[:25]]
    within = np.array([[kernel(a, b) for b in marks] for a in marks])
    values, vectors = np.linalg.eigh(within)
    keep = values > 1e-6 * values.max()
    z = np.array([[kernel(a, b) for b in marks] for a in grams]) @ vectors[:, keep] / np.sqrt(values[keep])
    y = np.array([[1.0 if a == b else -1.0 for b in "pqr"] for a in langs])
    offset = y.mean(0)
    solved = np.linalg.solve(z.T @ z + 1e-2 * len(z) * np.eye(z.shape[1]) / 3, z.T @ (y - offset))
    mine = (bits.astype(float) @ model.weights) / np.sqrt(bits.sum(1))[:, None] + model.offset
    assert np.allclose(mine, z @ solved + offset, atol=1e-3)


def test_no_language_is_left_out(spark, docs_of):
    """Far more languages than the sample's rows allow at full share: each still has a column."""
    rows = [(i, f"wort{i % 90} text {i}", f"l{i % 90:02}", "s", 7) for i in range(900)]
    d = spark.createDataFrame(rows, "doc_id long, text string, lang string, source string, n_chars long")
    assert len(L.fit(d, most_rows=100).languages) == 90
