import collections
import random
import re
import string

import corpus_pipeline
import numpy as np
from test_native import base, entropy
from test_tokens import REFERENCE, check

from factweave.llm import queries as q
from factweave.llm import secrets as X
from factweave.llm.common import local_roots

SF = "/root/testdata/sf0.001"


def test_stages_one_by_one(spark):
    docs = spark.read.parquet(f"{SF}/documents.parquet")
    columns, before = docs.columns, {r.doc_id for r in docs.collect()}
    for name, stage in corpus_pipeline.STAGES[:-1]:
        docs = stage(spark, docs, SF)
        docs = spark.createDataFrame(docs.collect(), docs.schema)
        now = {r.doc_id for r in docs.collect()}
        assert docs.columns == columns and now <= before, name
        before = now
    assert X.scan(docs).where("size(base) > 0").count() == 0
    pieces = corpus_pipeline.STAGES[-1][1](spark, docs, SF).collect()
    tokens = collections.Counter()
    for p in pieces:
        tokens[p.doc_id] += p.length
    assert set(tokens) == before and all(tokens[p.doc_id] == p.doc_tokens for p in pieces)


def test_registered(spark):
    import __spark_entry__ as e

    assert {int(n[2:].split("_")[0]) for n in q.queries()} == set(range(1, 11))
    assert "pipeline" in e.queries() and set(q.queries()) <= set(e.queries())
    assert e.queries()["pipeline"](spark, SF).count() > 0


def test_empty_documents(spark, docs_of, folder):
    assert corpus_pipeline.run(spark, folder(documents=docs_of([], extra=False))).count() == 0


def plain_run(docs):
    """The five stages by brute force: {doc_id: final text}."""
    docs = {i: t for i, t in docs if t and any(c.isalpha() for c in t)}
    order = sorted(docs)
    root = near([docs[i] for i in order])
    docs = {i: docs[i] for n, i in enumerate(order) if root[n] == n}
    seen, out = set(), {}
    for i in sorted(docs):
        raw = docs[i].encode()
        gone = np.zeros(len(raw), bool)
        for at in range(len(raw) - 99):
            window = raw[at : at + 100]
            if window in seen:
                gone[at : at + 100] = True
            seen.add(window)
        kept, at = [], 0
        for c in docs[i]:
            size = len(c.encode())
            if not gone[at : at + size].all():
                kept.append(c)
            at += size
        out[i] = "".join(kept)
    return {i: redact(t) for i, t in out.items()}


def near(texts):
    sets = [{tuple(w[i : i + 5]) for i in range(max(1, len(w) - 4))} for w in (t.lower().split() for t in texts)]
    links = [(i, j) for i in range(len(sets)) for j in range(i) if len(sets[i] & sets[j]) / len(sets[i] | sets[j]) >= 0.8]
    return local_roots(len(texts), *(np.array(links).T if links else (np.zeros(0, int), np.zeros(0, int))))


def redact(text):
    found = base(text)
    for m in re.finditer(X.CANDIDATE, text):
        word = m[0]
        if not re.search("[0-9]", word) or any(re.search(p, word) for p in X.ALLOWED) or any(s < m.end() and m.start() < e for s, _, e in found if _ != 3):
            continue
        least = X.THRESHOLDS["hex" if re.fullmatch("[0-9A-Fa-f]+", word) else "base64"]
        hits = [i for i in range(len(word) - X.WINDOW + 1) if entropy(word[i : i + X.WINDOW]) >= least - 1e-9]
        if hits:
            found.append((m.start() + hits[0], 3, m.start() + hits[-1] + X.WINDOW))
    out, at = [], 0
    for s, _, e in sorted(found):
        if s > at or not out:
            out += [text[at:s], X.PLACEHOLDER]
        at = max(at, e)
    return "".join(out) + text[at:]


def test_whole_pipeline_against_brute_force(spark, docs_of, folder):
    rng = random.Random(11)
    words = ["".join(rng.choices("abcdefgé", k=rng.randint(2, 9))) for _ in range(900)]
    passage = " ".join(rng.choices(words, k=50))
    docs = [(0, None), (1, " 12 34 "), (2, "")]
    for i in range(3, 70):
        own = rng.choices(words, k=rng.randint(20, 90))
        if i % 7 == 0:
            own[5:5] = passage.split()
        if i % 9 == 0:
            own.insert(4, "token=" + "".join(rng.choices(string.ascii_letters + string.digits, k=24)))
        if i % 10 == 0:
            own.insert(7, "".join(rng.choices(string.ascii_letters + string.digits, k=30)) + "7")
        docs.append((i, " ".join(own)))
    for i in range(70, 84):
        own = rng.choice(docs[3:])[1].split()
        for _ in range(i % 3):
            own[rng.randrange(len(own))] = "changed"
        docs.append((i, " ".join(own)))
    want = plain_run(docs)
    table = docs_of(docs, extra=False)
    pieces = [tuple(r) for r in corpus_pipeline.run(spark, folder(documents=table)).collect()]
    check(pieces, {i: np.array([*REFERENCE.encode(t, add_special_tokens=False).ids, 0]) for i, t in want.items()})
    assert len(want) < 84 - 5 and any(X.PLACEHOLDER in t for t in want.values())


def test_columns_of_any_name_pass_through_all_stages_but_the_last(spark, docs_of, odd_rows):
    docs = docs_of(odd_rows)
    names = docs.columns
    for _, stage in corpus_pipeline.STAGES[:-1]:
        docs = stage(spark, docs, "")
        assert docs.columns == names
    rows = docs.collect()
    assert rows and all((r.base, r.found, r["__letter"], r["__cuts"], r["__doc"], r.score, r.kinds) == ("b", "f", "l", "c", "d", "x", "n") for r in rows)
