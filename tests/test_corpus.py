import subprocess
import sys

import pytest

from weftwork.plans.bundle import Corpus
from weftwork.sources import corpus as source
from weftwork.sources.parse import records
from weftwork.sources.sample import FILES, sample_files


@pytest.fixture(scope="module")
def corpus(spark):
    return Corpus(sample_files(spark), "main")


def pairs(df):
    return {tuple(r) for r in df.collect()}


def test_files_become_modules(corpus):
    assert pairs(corpus.errors.select("module", "error")) == {("broken", "SyntaxError")}
    assert {r.module for r in corpus.modules.collect()} >= {"main", "shop", "shop.basket", "ring"}


def test_edges_hold_parents_and_submodules(corpus):
    edges = pairs(corpus.edges)
    assert {("main", "shop.report"), ("shop.report", "shop.formats"), ("shop.pay", "shop.basket"), ("shop.pay", "shop")} <= edges
    assert ("shop", "shop") not in edges


def test_cycles_have_their_kinds(corpus):
    kinds = {r.cycle_id: r.cycle_type for r in corpus.cycle_types().collect()}
    assert kinds == {"ring.a": "ModuleConstants", "ring.c": "FunctionLevel", "ring.e": "ClassLevel", "shop": "FunctionLevel"}


def test_live_symbols(corpus):
    live = pairs(corpus.live())
    assert {("main", "run"), ("shop.basket", "Basket"), ("shop.prices", "TABLE"), ("shop.stock", "count"), ("shop.pay", "TAX")} <= live
    assert not live & {("shop.prices", "unused_helper"), ("shop.pay", "refund"), ("ring.a", "A")}


def test_requirements_and_kinds(corpus):
    assert {r.package for r in corpus.requirements().collect()} == {"numpy", "requests"}
    kinds = {r.module: r.decision for r in corpus.module_kinds().collect()}
    assert kinds["main"] == "entry" and kinds["shop.prices"] == "inline" and kinds["shop.formats"] == "wrapper" and kinds["ring.a"] == "wrapper"


def test_bundle_runs_as_the_original_does(corpus, tmp_path):
    for path, text in FILES.items():
        (tmp_path / "own" / path).parent.mkdir(parents=True, exist_ok=True)
        (tmp_path / "own" / path).write_text(text)
    for name in ("requests", "numpy"):
        (tmp_path / f"{name}.py").write_text("")
    (tmp_path / "bundle.py").write_text(source.bundle_text(corpus.bundle()))
    run = lambda file: subprocess.run([sys.executable, file], capture_output=True, text=True, cwd=tmp_path, env={"PYTHONPATH": str(tmp_path)}, timeout=60)
    want, got = run("own/main.py"), run("bundle.py")
    assert want.returncode == got.returncode == 0 and want.stdout == got.stdout and want.stdout


def test_imports_know_where_they_stand():
    text = "from typing import TYPE_CHECKING\nimport a.b as c\nif TYPE_CHECKING:\n    import d\ntry:\n    import e\nexcept ImportError:\n    pass\nclass K:\n    def __init__(self):\n        import f\ndef g():\n    import h\n"
    rows = {r["name"]: r for r in records("m", "m.py", text) if r["record"] == "import"}
    assert rows["a.b"]["contexts"] == ["ModuleLevel"] and rows["d"]["contexts"][0] == "TypeChecking"
    assert rows["e"]["scope"] == ["Try"] and rows["h"]["flag"] and not rows["f"]["flag"]


def test_sources_read_from_a_folder(spark, tmp_path):
    (tmp_path / "pkg").mkdir()
    (tmp_path / "pkg" / "__init__.py").write_bytes(b"x = 1\r\ny = 2\r")
    (tmp_path / "pkg" / "__main__.py").write_text("print(1)\n")
    (tmp_path / "pkg" / "plain.py").write_text("z = 3\n")
    (tmp_path / "notes.txt").write_text("no")
    files = source.read_sources(spark, f"file://{tmp_path}")
    rows = {r.path: r.source for r in files.collect()}
    assert set(rows) == {"pkg/__init__.py", "pkg/__main__.py", "pkg/plain.py"} and rows["pkg/__init__.py"] == "x = 1\ny = 2\n"
    assert source.entry_file(files, "pkg").first().path == "pkg/__init__.py"


def test_settings_fold_by_priority(spark, tmp_path):
    from weftwork.operators.aggregates import precedence_merge

    (tmp_path / "user.toml").write_text('target-version = "py312"\nsrc = ["a", "b"]\n')
    layers = source.toml_layer(str(tmp_path / "user.toml"), "user", 1) + source.environment_layer({"W_SRC": "", "W_PRESERVE_COMMENTS": "off"}, "W_", 2)
    merged = {r.key: (r.value, r.layer) for r in precedence_merge(source.config_layers(spark, layers), collections=source.COLLECTIONS).collect()}
    assert merged["src"] == ("a,b", "user") and merged["preserve_comments"] == ("false", "environment") and merged["target_version"] == ("py312", "user")
    with pytest.raises(ValueError):
        source.output_choice("x.py", True)


def rows_of(text, record):
    return [r for r in records("m", "m.py", text) if r["record"] == record]


def roles(text, name):
    own = {r["ord"]: r["name"] for r in rows_of(text, "item") if r["name"] == name}
    found = {}
    for r in rows_of(text, "name"):
        if r["ord"] in own:
            found.setdefault(r["kind"], set()).add(r["name"])
    return found


def test_a_class_reads_its_body_at_once_and_its_methods_later():
    text = "from m import B, D\nclass A:\n    x = B\n    y: B2 = None\n    @deco\n    def f(self, p: Note = D) -> Out:\n        return C\n"
    found = roles(text, "A")
    assert found["read"] == {"B", "B2"} and found["eventual_read"] == {"deco", "Note", "D", "Out", "C"}


def test_locals_are_not_global_reads():
    text = (
        "def f(a):\n    import os.path as p, sys\n    try:\n        pass\n    except ValueError as e:\n        print(e, p, sys)\n    def g():\n        inner = G\n        return inner\n"
        "    match a:\n        case [h, *rest] if h:\n            k = lambda q: q + Z\n    inner\n    return g, rest, [c for c in a]\n"
    )
    assert roles(text, "f")["eventual_read"] == {"ValueError", "print", "G", "Z", "inner"}
    own = {r["name"] for r in rows_of(text, "local") if r["kind"] == "f"}
    assert own == {"a", "p", "sys", "e", "g", "h", "rest", "k", "c"}
    text = "def f():\n    global n\n    def g():\n        global n\n        n = 2\n    return n\n"
    assert roles(text, "f") == {"decl": {"f"}, "defined": {"f"}, "eventual_read": {"n"}, "eventual_write": {"n"}}


def test_usages_stand_once_in_their_scope():
    text = "if a:\n    for i in b:\n        z = 1\ndef f(p):\n    del p\n    global w\n"
    found = sorted((r["kind"], r["name"], r["target"]) for r in rows_of(text, "usage"))
    assert found == [("delete", "p", "module.f"), ("global", "w", "module.f"), ("read", "a", "module"), ("read", "b", "module"), ("write", "i", "module"), ("write", "z", "module")]


def test_used_symbols_leave_types_out():
    text = "def f():\n    x: Hint = one\n    y = cast(Shape, two)\n    z = typing.cast(Other, three)\n    w = List[Item]\n    v = typing.Mapping[Key, int]\n    return data[key]\n"
    assert {r["name"] for r in rows_of(text, "used")} == {"x", "one", "cast", "two", "typing", "three", "y", "z", "w", "List", "v", "data", "key"}


def test_imports_with_effects_do_not_move():
    text = "def f():\n    import os\n    import logging\n    import _thread\n    import json\n    import os.path\n"
    assert {r["name"]: r["flag"] for r in rows_of(text, "import")} == {"os": False, "logging": False, "_thread": False, "json": True, "os.path": True}


def test_bundle_of_an_entry_with_future_imports(spark, tmp_path):
    files = {"main.py": '"""Doc."""\nfrom __future__ import annotations\nfrom low import f\n\ndef g(x: Later):\n    return f()\n\nprint(g(1))\n', "low.py": "from __future__ import annotations\n\ndef f() -> Never:\n    return 5\n"}
    bundle = Corpus(spark.createDataFrame(sorted(files.items()), "path string, source string"), "main").bundle()
    (tmp_path / "bundle.py").write_text(source.bundle_text(bundle))
    run = subprocess.run([sys.executable, "bundle.py"], capture_output=True, text=True, cwd=tmp_path, timeout=60)
    assert run.returncode == 0 and run.stdout == "5\n", run.stderr
