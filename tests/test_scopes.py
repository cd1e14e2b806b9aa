from __future__ import annotations

from siftstone.operators import scopes

FILES = {
    "app/__init__.py": "from .core import run as start\nfrom . import util\n",
    "app/core.py": "from .util import *\nfrom app.base import Base as B, Other\nimport app.deep.tools as t\nimport app.util\n\ndef run(helper):\n    helper()\n    clean()\n    t.fix()\n    app.util.clean()\n    Local().go()\n    x = Local()\n    x.stop()\n    y = unknown()\n    y.go()\n    len([])\n\nclass Local(B, Other):\n    def go(self):\n        self.stop()\n        self.ping()\n        super().go()\n        self.missing()\n    def again(self):\n        B.stop(self)\n        _hidden()\n",
    "app/util.py": "def clean():\n    pass\ndef _hidden():\n    pass\n",
    "app/base.py": "class Root:\n    def go(self): pass\n    def ping(self): pass\nclass Base(Root):\n    def stop(self): pass\nclass Other(Root):\n    def go(self): pass\n    def ping(self): pass\n",
    "app/deep/tools.py": "from ...app import start\nfrom .. import util\nfrom ..core import run\n\ndef fix():\n    start()\n    util.clean()\n    run()\n",
    "ring/a.py": "from ring.b import f\nfrom ring.b import g\ndef h():\n    f()\n    g()\nclass X(Y): pass\nclass Y(X):\n    def m(self): self.n()\n    def n(self): pass\n",
    "ring/b.py": "from ring.a import f\ndef g(): pass\n",
    "bad.py": "def broken(:\n",
    "empty.py": None,
}


def edges(spark, files):
    df = spark.createDataFrame(list(files.items()), "path string, source string").repartition(3)
    return {(r.source, r.target, r.type) for r in scopes.scoped_edges(df).collect()}


def test_names_mean_what_their_file_says(spark):
    calls = {(a, b) for a, b, kind in edges(spark, FILES) if kind == "calls"}
    core = "app/core.py::"
    assert {b for a, b in calls if a == core + "run"} == {"app/util.py::clean", "app/deep/tools.py::fix", core + "Local", core + "Local.go", "app/base.py::Base.stop"}
    # Local, Base, Other, Root: ping and super().go are Other's.
    assert {b for a, b in calls if a == core + "Local.go"} == {"app/base.py::Base.stop", "app/base.py::Other.ping", "app/base.py::Other.go"}
    assert {b for a, b in calls if a == core + "Local.again"} == {"app/base.py::Base.stop"}  # a star import leaves _hidden out
    assert {b for a, b in calls if a.startswith("app/deep")} == {core + "run", "app/util.py::clean"}  # passed on by two files
    assert {(a, b) for a, b in calls if a.startswith("ring")} == {("ring/a.py::h", "ring/b.py::g"), ("ring/a.py::Y.m", "ring/a.py::Y.n")}


def test_method_orders():
    o = ["o"]
    assert scopes.linear("d", [["b", "a", "o"], ["c", "a", "o"]]) == ["d", "b", "c", "a", "o"]
    assert scopes.linear("x", [o]) == ["x", "o"] and scopes.linear("x", []) == ["x"]
    assert scopes.linear("z", [["a", "b"], ["b", "a"]]) is None


def test_a_shared_name_gives_an_edge_a_file(spark):
    files = {f"m{i}.py": "def shared():\n    pass\ndef use():\n    shared()\n" for i in range(300)}
    assert len(edges(spark, files)) == 300
