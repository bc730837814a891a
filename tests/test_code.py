"""Imports, scopes, prefixes and chunks of code on small files, against results derived by hand."""

import pytest
from pyspark.sql import functions as F

from tessera.functions import columns as C
from tessera.operators import code

PREFIX = """# path: /app/main.py
import os
from utils.auth import login
import torch, numpy
import helpers
class A:
    def f(self):
        x = 1

        if x:
            y = 2
"""
FILES = ["utils/auth.py", "utils/__init__.py", "helpers.py", "app/main.py", "pkg/__init__.py"]


def points(spark, *rows):
    return spark.createDataFrame([(i, "r", p, s) for i, (p, s) in enumerate(rows)], "q bigint, repo string, prefix string, suffix string")


def files(spark):
    return spark.createDataFrame([("r", p) for p in FILES] + [("other", "os.py")], "repo string, path string")


def test_module_names(spark):
    lines = ["from utils.auth import X", "import torch, numpy", "x = 1", "  import a.b", "from ", "import os"]
    df = spark.createDataFrame([(x,) for x in lines], "x string")
    assert [r[0] for r in df.select(code.module_name(F.col("x"))).collect()] == ["utils", "torch", None, "a", None, "os"]


def test_import_files(spark):
    p = points(spark, ("import helpers\nfrom utils.auth import login\nimport pkg\nfrom pkg import z\nimport os", ""), ("import helpers\ndef f(", ""), (None, None))
    assert sorted(map(tuple, code.import_files(p, files(spark)).collect())) == [(0, "helpers.py"), (0, "pkg/__init__.py"), (0, "utils/auth.py")]


def test_completion_texts(spark):
    p = points(spark, (PREFIX, "  })];\n\n)\nreturn y\nz"), ("", ")\n"), ("import os", "a\nb"))
    got = {r.q: r for r in code.completion_texts(p, files(spark)).collect()}
    local = ["from utils.auth import login", "import helpers"]
    tail = ["# path: /app/main.py", "class A:", "    def f(self):", "        x = 1", "", "        if x:", "            y = 2"]
    assert got[0].retrieval_prefix == "\n".join(local + tail)
    assert got[0].submission_prefix == "\n".join(local + tail[1:])
    # The scope of the last line is `if x:`, which the climb passes, to the function above.
    assert got[0].embedding_query == "\n".join([*tail, "  })];", "", ")", "return y", "z"]).strip()
    assert got[0].submission_suffix == "return y\nz" and got[0].retrieval_suffix.startswith("  })]")
    assert (got[1].retrieval_prefix, got[1].retrieval_suffix, got[1].embedding_query, got[1].submission_prefix, got[1].submission_suffix) == ("", "", "", "", ")")
    assert got[2].embedding_query == "a\nb" and got[2].submission_prefix == ""
    old = {r.q: r for r in code.completion_texts(p, files(spark), all_imports=True).collect()}
    assert old[0].retrieval_prefix.split("\n")[:4] == ["import os", "from utils.auth import login", "import torch, numpy", "import helpers"]


def test_anchors(spark):
    p = points(spark, (PREFIX, ""), ("import helpers", ""), ("x", ""), ("from a import b", ""))
    imports = spark.createDataFrame([(1, "a/b/c.py"), (1, "a/b/d.py"), (1, "z.py"), (3, "k.py")], "q bigint, path string")
    assert sorted(map(tuple, code.anchors(p, files(spark), imports).collect())) == [(0, "app/main.py"), (1, "a/b/c.py"), (3, "k.py")]


def test_function_chunks(spark):
    body = lambda n: [f"    x{i} = {i}" for i in range(n)]
    cases = {
        "two": ["import a", *body(5), "def f():", *body(6), "@dec", "def g():", *body(5)],
        "short first": ["import a", "def f():", *body(6), "class B:", *body(2)],
        "long": ["x"] * 5 + ["def f():", *body(70)],
        "one": ["def f():", *body(3)],
        "empty": [],
    }
    df = spark.createDataFrame([(k, v) for k, v in cases.items()], "k string, lines array<string>")
    got = {r.k: r.c for r in df.select("k", code.function_chunks(F.col("lines")).alias("c")).collect()}
    two = cases["two"]
    assert got["two"] == ["\n".join(two[:6]), "\n".join(two[6:13]), "\n".join(two[13:])]
    # The first cut needs five lines before it, so `def f` opens none; what follows the class is short and joins.
    assert got["short first"] == ["\n".join(cases["short first"])]
    assert [len(c.split("\n")) for c in got["long"]] == [5, 60, 11]
    assert got["one"] == ["\n".join(cases["one"])] and got["empty"] == []
    assert df.select(F.size(C.sliding_chunks(F.col("lines"), 60))).count() == 5


def test_prefix_and_suffix_modes(spark):
    prefix = "import os\nfrom a import b\n" + "".join(f"x = {i % 3}\n" for i in range(12)) + "    import inner\n"
    df = spark.createDataFrame([(prefix, " )]\n"), ("one\ntwo\n", "tail\nmore\n"), (None, None), ("", "")], "p string, s string")
    lines = prefix.splitlines()
    p, s = F.col("p"), F.col("s")
    got = df.select(*[code.submission_prefix(p, m, 4).alias(m) for m in ("full", "simple", "smart")], code.plain_query(p, s, 3).alias("q"), code.suffix_head(s, 1).alias("h"), *[code.suffix_of(s, m).alias(f"s_{m}") for m in ("filtered", "none", "full")]).collect()
    assert got[0].full == prefix and got[0].simple == "\n".join(lines[-4:]) and got[0].smart == "\n".join(dict.fromkeys(lines[:2] + lines[-4:]))
    assert got[1].simple == got[1].smart == "one\ntwo\n" and got[0].q == "\n".join(lines[-3:]).strip() and got[1].q == "one\ntwo\ntail\nmore"
    assert (got[0].s_filtered, got[1].s_filtered, got[1].s_none, got[1].s_full, got[1].h) == ("", "tail\nmore\n", "", "tail\nmore\n", "tail")
    assert list(got[2]) == [None] * 8 and got[3].q == ""
    for bad in (lambda: code.submission_prefix(p, "other"), lambda: code.suffix_of(s, "other")):
        with pytest.raises(ValueError, match="known are"):
            bad()
