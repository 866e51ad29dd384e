import pytest

from factweave.plans import requests as Q
from factweave.sources import builds as B
from factweave.sources import lexical as L


def rows(df):
    return {tuple(r) for r in df.collect()}


def texts(spark, *pairs):
    return spark.createDataFrame(list(pairs), "path string, text string")


def test_requests():
    a, b = Q.QueryRequest(paths=("b", "a"), search="x"), Q.QueryRequest(paths=("a", "b"), search="x")
    assert Q.digest(a) == Q.digest(b) != Q.digest(Q.QueryRequest(search="x"))
    assert a.projections() == ["mapped_paths", "search_domain"]
    for bad in ({"direction": "up"}, {"depth": 65}, {"search_limit": 0}):
        with pytest.raises(ValueError):
            Q.QueryRequest(**bad)
    with pytest.raises(ValueError):
        Q.PathRequest("a", "b", max_paths=101)


def test_memo_builds_once():
    memo, made = Q.Memo(), []
    for _ in range(2):
        memo.get("k", lambda: made.append(1))
    assert made == [1] or len(memo.made) == 1


def test_context(spark):
    df = spark.createDataFrame([("a", "exact", 1), ("b", "candidate", 2), ("c", "conservative", 1)], "key string, confidence string, distance int")
    assert Q.context(df, "exact").count() == 1 and Q.context(df, "audit", 1).count() == 2


def test_lexical(spark):
    got = rows(L.facts(texts(spark, ("a.c", '#include <x.h>\n/* int no(void) { */\nstatic int yes(int a) {\n return f(a); }\n'), ("b.js", "import {a} from './a'\nclass K {}\nfunction go() {}\n"), ("c.R", "library(dplyr)\nf <- function(x) x\n"), ("d.py", "from a.b import c\nclass D:\n    def e(self): pass\n"), ("e.bin", "def x"), ("f.py", None))).select("path", "domain", "name"))
    assert got == {("a.c", "import", "x.h"), ("a.c", "declaration", "yes"), ("b.js", "import", "./a"), ("b.js", "declaration", "K"), ("b.js", "declaration", "go"), ("c.R", "import", "dplyr"), ("c.R", "declaration", "f"), ("d.py", "import", "a.b"), ("d.py", "declaration", "D"), ("d.py", "declaration", "e")}


def test_builds(spark):
    assert rows(B.make_targets(texts(spark, ("M", "all: a b \\\n c\nV = x\nW := y\nclean:\n\trm x\n")))) == {("M", "all", "a"), ("M", "all", "b"), ("M", "all", "c"), ("M", "clean", None)}
    assert rows(B.script_builds(texts(spark, ("p", '{"scripts":{"t":"run"}}')))) == {("p", "t", "run")}
    assert rows(B.cmake_targets(texts(spark, ("C", "add_library(core STATIC a.c b.c)\nadd_executable(app)\n")))) == {("C", "core", "library", "a.c"), ("C", "core", "library", "b.c"), ("C", "app", "executable", None)}
    assert rows(B.sections(texts(spark, ("p.toml", '[project]\nname = "x"\n[tool.a]\nb = 1\n')))) == {("p.toml", "project", "name", "x"), ("p.toml", "tool.a", "b", "1")}
    assert rows(B.named_entries(texts(spark, ("f", "on a\non b\non a\n")), "e", r"on (\w+)")) == {("e", "f", "a"), ("e", "f", "b")}
    assert rows(B.gcov(texts(spark, ("g", '{"files":[{"file":"a.c","lines":[{"line_number":3,"count":2}]}]}')))) == {("a.c", 3, 2)}
    assert rows(B.llvm_cov(texts(spark, ("l", '{"data":[{"files":[{"filename":"a.c","segments":[[3,1,2,true,true,false]]}]}]}')))) == {("a.c", 3, 2)}
    assert B.compile_commands(texts(spark, ("c", '[{"directory":"d","file":"f.c","arguments":["cc","-Wall","-Ia","f.c"]}]'))).first()["options"] == "-Ia -Wall"
