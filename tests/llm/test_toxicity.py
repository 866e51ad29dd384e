import itertools

import numpy as np
import pytest

from factweave.llm import toxicity as X


def model(**weights):
    return X.ToxicityModel(weights, -2.0, np.array([[0.3, -0.4], [-0.2, 0.9]]), np.array([-3.0, 3.0, 2.0]), 0.1)


def test_marginals_against_enumeration():
    m = model(**{"=bad": 3.0, "=odd": 1.0})
    for words in (["bad"], ["a", "bad"], ["bad", "a", "a", "odd", "bad", "a"], ["a"] * 5 + ["odd"] + ["b"] * 3 + ["bad"]):
        emit = [m.emission(w) for w in words]
        places = [i for i, e in enumerate(emit) if e is not None]
        mass = {}
        for tags in itertools.product((0, 1), repeat=len(words)):
            s = sum((m.bias + (emit[i] or 0.0)) * t for i, t in enumerate(tags)) + sum(m.moves[a, b] for a, b in itertools.pairwise(tags))
            mass[tags] = np.exp(s)
        total = sum(mass.values())
        slow = [sum(v for t, v in mass.items() if t[i]) / total for i in places]
        assert X.marginals(m, len(words), places, [emit[i] for i in places]) == pytest.approx(slow)


def test_long_gaps_and_offsets():
    m = model(**{"=bad": 9.0})
    score, spans = X.tag(m, "Ok " * 5000 + "BAD end", X._Known(m))
    assert [(s, e) for s, e, _ in spans] == [(15000, 15003)] and spans[0][2] > 0.9 and score > X.tag(m, "", X._Known(m))[0]


def test_odd_rows(docs_of, odd_rows):
    out = X.score(docs_of([*odd_rows, (9, "bad bad")]), model(**{"=bad": 9.0}))
    rows = {r.doc_id: r for r in out.collect()}
    assert rows[1].score == rows[2].score == rows[4].score < rows[9].score and len(rows[9].offending) == 2 and "text" not in out.columns
    assert {r.score for r in X.score(docs_of(odd_rows), None).collect()} == {0.0}
    assert X.score(docs_of([]), model()).count() == 0


def test_no_labels(spark, docs_of, folder):
    labels = spark.createDataFrame([(4, 1, None)], "doc_id long, quality int, toxic int")
    got = X.op5_toxicity(spark, folder(documents=docs_of([(4, "x"), (5, None)]), labels=labels)).collect()
    assert [(r.score, r.predicted) for r in got] == [(0.0, 0)] * 2


def test_held_out(spark):
    where = "/root/testdata/sf0.1"
    labels = spark.read.parquet(f"{where}/labels.parquet").select("doc_id", "toxic")
    got = X.op5_toxicity(spark, where).join(labels, "doc_id").where("held_out").toPandas()
    assert got[got.toxic == 0].predicted.mean() < 0.01 and got[got.toxic == 1].predicted.mean() > 0.75
