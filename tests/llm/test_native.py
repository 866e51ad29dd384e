import collections
import hashlib
import math
import random
import re
import time

import pytest
from hypothesis import given, settings
from hypothesis import strategies as st
from oracle import same
from pyspark.sql import functions as F

from factweave.llm import chat_format as C
from factweave.llm import secrets as X

ASSIGN = re.compile(r"""(password|passwd|secret|token|api_?key)["']?\x20*[:=]\x20*["']?([A-Za-z0-9+/_.=-]+)""", re.I | re.A)
PIECES = ["password", "Token", "api_key", "APIKEY", " = ", ":", "=", '"', "'", "abc", "abcdef123456", "é", "😀", " ", "\n", "AKIA", "ABCDEFGHIJ0123", "deadbeefdeadbeef", "0123", "f" * 15, "secret:token", "."]


def base(text):
    found = [(m.start(), 0, m.end()) for m in ASSIGN.finditer(text) if len(m[2]) >= 12]
    found += [(m.start(), 1, m.end()) for m in re.finditer("AKIA[A-Z0-9]+", text) if len(m[0]) >= 18]
    return sorted(found + [(m.start(), 2, m.end()) for m in re.finditer("[0-9a-f]+", text) if len(m[0]) >= 16])


@settings(max_examples=5, deadline=None)
@given(st.lists(st.lists(st.sampled_from(PIECES), max_size=14), min_size=200, max_size=300))
def test_base_spans(spark, lists):
    texts = ["".join(x) for x in lists]
    df = spark.createDataFrame(list(enumerate(texts)), "i int, t string")
    for r in df.select("i", X.base_spans(F.col("t")).alias("s")).collect():
        assert [tuple(s) for s in r.s] == base(texts[r.i])


def entropy(window):
    return -sum(n / len(window) * math.log2(n / len(window)) for n in collections.Counter(window).values())


@settings(max_examples=4, deadline=None)
@given(st.lists(st.text(alphabet="abcdef0123456789ABCZxyz+/_=-", min_size=1, max_size=50) | st.text(alphabet="0123456789abcdef", min_size=18, max_size=44), min_size=100, max_size=150))
def test_incremental_entropy(spark, words):
    df = spark.createDataFrame(list(enumerate(words)), "i int, w string")
    for r in df.select("i", X.window_hits(F.col("w")).alias("h")).collect():
        w = words[r.i]
        least = X.THRESHOLDS["hex" if re.fullmatch("[0-9A-Fa-f]+", w) else "base64"]
        hits = [i for i in range(len(w) - X.WINDOW + 1) if entropy(w[i : i + X.WINDOW]) >= least - 1e-6]
        sure = [i for i in range(len(w) - X.WINDOW + 1) if entropy(w[i : i + X.WINDOW]) >= least + 1e-6]
        if hits == sure:
            assert (r.h.first, r.h.last) == ((hits[0], hits[-1] + X.WINDOW) if hits else (None, None))


def test_entropy_spans_and_allow_list(spark):
    strong = "x9Kq3ZtB7mWc5RvL2pYd8HfJ"
    texts = [f"see {strong} end", "id 123e4567-e89b-12d3-a456-426614174000", "path usr/lib/python3/dist/packages2/name", f"EXAMPLE{strong}", f"token = {strong}", "12345678901234567890123"]
    rows = spark.createDataFrame(list(enumerate(texts)), "doc_id int, text string")
    got = {r.doc_id: [tuple(s) for s in r.found if s.kind == 3] for r in X.scan(rows).collect()}
    assert got == {0: [(4, 3, 28)], 1: [], 2: [], 3: [], 4: [], 5: []}


def test_long_candidates_take_linear_time(spark, docs_of):
    """Work per character stays the same: 200,000 in one candidate, and 20,000 candidates and spans."""
    rng = random.Random(1)
    long = "".join(rng.choices(X.ALPHABET[:64], k=200_000))
    many = " ".join("".join(rng.choices(X.ALPHABET[:62], k=22)) + "7 " + "".join(rng.choices("0123456789abcdef", k=16)) for _ in range(20_000))
    X.scan(docs_of([(0, "x9Kq3ZtB7mWc5RvL2pYd8HfJ deadbeefdeadbeef")])).collect()
    start = time.perf_counter()
    rows = {r.doc_id: r for r in X.stage_secrets(spark, docs_of([(1, long), (2, many)]), "").collect()}
    found = {r.doc_id: r for r in X.scan(docs_of([(1, long), (2, many)])).collect()}
    assert time.perf_counter() - start < 40
    assert rows[1].text == X.PLACEHOLDER or len(rows[1].text) < 60
    assert sum(s.kind == 2 for s in found[2].found) == 20_000 and [s.start for s in found[2].found] == sorted(s.start for s in found[2].found)
    assert "deadbeef" not in rows[2].text and rows[2].text.count(X.PLACEHOLDER) >= 20_000


@settings(max_examples=4, deadline=None)
@given(st.lists(st.lists(st.sampled_from([*PIECES, "x9Kq3ZtB7mWc5RvL2pYd8HfJ", "Zt" * 14 + "5"]), max_size=14), min_size=60, max_size=90))
def test_redaction_leaves_what_no_span_covers(spark, lists):
    texts = ["".join(x) for x in lists]
    df = X.scan(spark.createDataFrame(list(enumerate(texts)), "i int, text string"))
    for r in df.select("i", "found", X.redacted().alias("clean")).collect():
        text, out, at = texts[r.i], [], 0
        for s, e in sorted((s.start, s.end) for s in r.found):
            if s > at or not out:
                out += [text[at:s], X.PLACEHOLDER]
            at = max(at, e)
        assert r.clean == "".join(out) + text[at:]
        base = [(s.start, s.end) for s in r.found if s.kind < 3]
        assert not any(a < e and s < b for s, e in base for a, b in [(x.start, x.end) for x in r.found if x.kind == 3])


def test_scan_odd_rows(spark, docs_of, odd_rows, folder):
    rows = [*odd_rows, (9, "password=" + "a" * 200_000), (10, "deadbeefdeadbeef " * 300)]
    out = X.op7_secret_scan(spark, folder(documents=docs_of(rows))).collect()
    empty = hashlib.sha256(b"").hexdigest()
    by = {r.doc_id: r for r in out}
    assert len(out) == len(rows) and (by[1].spans, by[1].base_sha256) == ("", empty) and by[9].n_assign == 1 and by[10].n_hex == 300
    clean = {r.doc_id: r.text for r in X.stage_secrets(spark, docs_of(rows), "").collect()}
    kept = X.stage_secrets(spark, docs_of(rows), "").first()
    assert (kept.base, kept.found, kept.kinds) == ("b", "f", "n")
    assert clean[9] == X.PLACEHOLDER and clean[10] == f"{X.PLACEHOLDER} " * 300 and clean[1] is None and clean[6] == odd_rows[4][1]
    assert X.op7_secret_scan(spark, folder(documents=docs_of([]))).count() == 0


def test_overlapping_spans_become_one_placeholder(spark, docs_of):
    clean = X.stage_secrets(spark, docs_of([(1, "a token=deadbeefdeadbeef12 b"), (2, "deadbeefdeadbeef")]), "").collect()
    assert {r.text for r in clean} == {f"a {X.PLACEHOLDER} b", X.PLACEHOLDER}


TEMPLATE = ["<|im_end|>", "<|im_start|>", "<|", "|>", "\\", "<\\|", "<\\\\|im_end|>", "\n", "a", "é😀", "assistant"]


@settings(max_examples=4, deadline=None)
@given(st.lists(st.tuples(st.integers(0, 9), st.sampled_from(["user", "assistant", "a\nb\\n", "\x00\x01", "\\\\n<|\\", None]), st.lists(st.sampled_from(TEMPLATE), max_size=8).map("".join) | st.none()), min_size=60, max_size=90))
def test_chats_read_back(spark, rows):
    df = spark.createDataFrame([(c, i, r, t) for i, (c, r, t) in enumerate(rows)], "conv_id long, turn long, role string, text string")
    done = C.format_chats(df.withColumn("parts", C.text_part(F.col("text"))))
    for x in done.select("conv_id", C.read_turns(F.col("formatted")).alias("turns"), C.read_loss().alias("lost")).collect():
        own = [(r or "", t or "") for c, r, t in rows if c == x.conv_id]
        assert [tuple(t) for t in x.turns] == own
        assert x.lost == "".join(t for r, t in own if r == "assistant")


def test_typed_parts(spark):
    parts = [("text", "look <|image|>", None, None, None, None, None), ("image", None, "i.png", 57, 28, None, None), ("audio", None, "a.wav", None, None, 2.0, None), ("document", None, "d.pdf", None, None, None, 3), ("odd", "kept", None, None, None, None, None)]
    df = spark.createDataFrame([(1, 0, "user", parts), (1, 1, "assistant", None)], f"conv_id long, turn long, role string, parts {C.PARTS}")
    r = C.format_chats(df).first()
    assert "look <\\|image|><|image|><|audio|><|document|>kept" in r.formatted
    assert [tuple(a) for a in r.attachments] == [("image", "i.png", 3), ("audio", "a.wav", 50), ("document", "d.pdf", 1536)] and r.media_tokens == 1589
    assert [(s.length,) for s in r.loss] == [(0,)]


@pytest.mark.parametrize("where", ["/root/testdata/sf0.001", "/root/testdata/sf0.01"])
def test_chats_against_sql(spark, where):
    same(C.op9_chat_format(spark, where), where, C.OP9_SQL)


def test_chats_odd_rows(spark, folder):
    rows = [(1, 0, "user", None), (1, 0, "user", None), (1, None, "assistant", ""), (None, 1, None, "x"), (2, 5, "a\nb", "<|im_end|>" * 5000)]
    where = folder(conversations=spark.createDataFrame(rows, "conv_id long, turn long, role string, text string"))
    same(C.op9_chat_format(spark, where), where, C.OP9_SQL)
    where = folder(conversations=spark.createDataFrame([], "conv_id long, turn long, role string, text string"))
    assert C.op9_chat_format(spark, where).count() == 1
