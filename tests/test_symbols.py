from pyspark.sql import functions as F

from weftwork.functions import names
from weftwork.operators import symbols
from weftwork.plans.bundle import Corpus


def rows(df):
    return sorted(tuple(r) for r in df.collect())


def test_paths_in_canonical_form(spark):
    cases = {"a//b/./c/../d/": "a/b/d", "../x/..": "..", "../../x": "../../x", "/../a": "/a", "/": "/", "": ".", "a/..": ".", "a/../..": "..", None: None}
    df = spark.createDataFrame([(k,) for k in cases], "path string")
    assert {r.path: r.c for r in df.select("path", names.canonical_path(F.col("path")).alias("c")).collect()} == cases


def test_parts_of_files_by_search_directory(spark):
    files = spark.createDataFrame([("src/a/b.py",), ("src/a/__init__.py",), ("src/__main__.py",), ("./top.py",), ("../out.py",), ("/abs/x.py",), (None,)], "path string")
    dirs = spark.createDataFrame([("src/a", 2), ("src", 1), (".", 3), ("/", 4)], "dir string, priority int")
    got = {r.path: (r.dir, r.parts) for r in symbols.module_parts(files, dirs).collect()}
    assert got == {
        "src/a/b.py": ("src", ["a", "b"]), "src/a/__init__.py": ("src", ["a"]), "src/__main__.py": ("src", []), "./top.py": (".", ["top"]), "../out.py": (None, None),
        "/abs/x.py": ("/", ["abs", "x"]), None: (None, None),
    }


def test_stars_of_inlined_modules(spark):
    t = lambda r, c: spark.createDataFrame(r, c)
    pair = "module string, name string"
    stars = t([("m", "p", False), ("q", "p", True), ("m", "o", False), ("m", "none", False)], "module string, target string, whole boolean")
    listed = t([("p", "a"), ("p", "b"), ("p", "c"), ("p", "c"), ("p.sub", "b")], pair)
    exports = t([("o", "x"), ("o", "_y"), ("o", "_z"), ("o", "dead"), ("p", "unlisted")], pair)
    alive = t([("p", "a"), ("p.sub", "b"), ("p", "unlisted"), ("o", "x"), ("o", "_y"), ("o", "_z")], pair)
    renames = t([("o", "_z", "z_2"), ("p", "a", "_a_1")], pair + ", new_name string")
    got = symbols.star_names(stars, listed, exports, renames, alive, t([("p", "b")], pair))
    assert rows(got) == [
        ("m", "o", "_z", "z_2", False), ("m", "o", "x", "x", False), ("m", "p", "a", "_a_1", False), ("m", "p", "b", "b", True),
        ("q", "p", "a", "_a_1", False), ("q", "p", "b", "b", True), ("q", "p", "c", "c", False),
    ]
    assert rows(symbols.star_names(stars.limit(0), listed, exports, renames, alive, alive)) == []


def test_symbols_imported_elsewhere(spark):
    t = lambda r, c: spark.createDataFrame(r, c)
    own = t([("a", "f"), ("a", "_g"), ("b", "h"), ("b", "k"), ("c", "only")], "module string, name string")
    imports = t([("m", "a", "*"), ("b", "b", "h"), ("m", "b", "*"), ("m", "a", "*"), ("m", None, "f"), ("c", "c", "*")], "importer string, source string, original string")
    got = symbols.imported_elsewhere(own, imports, t([("b", "k")], "module string, name string"))
    assert rows(got) == [("a", "_g", False), ("a", "f", True), ("b", "h", False), ("b", "k", True), ("c", "only", False)]


def test_installed_packages_are_third_party(spark):
    files = spark.createDataFrame([("main.py", "import seen\nimport json\n")], "path string, source string")
    c = Corpus(files, "main", installed=spark.createDataFrame([("seen",)], "name string"))
    assert {(r.name, r.category) for r in c.classified().collect()} == {("seen", "ThirdParty"), ("json", "StandardLibrary")}
    assert c.missing().count() == 0
