"""Core queries over the driver's tables: functions, lookups, cascades, aggregation. Each has the same result as SQL."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from weftwork.functions import names
from weftwork.operators import aggregates, resolve
from weftwork.sources import corpus as source


def table(spark: SparkSession, sf_dir: str, name: str) -> DataFrame:
    return spark.read.parquet(f"{sf_dir}/{name}.parquet")


def _paths(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Urls as module paths: a/b.html, and a directory's own page as its __init__."""
    rest = F.regexp_replace("url", "^[a-z]+://", "")
    path = F.regexp_replace(rest, "[?#].*$", "")
    path = F.regexp_replace(path, "/$", "/__init__.html")
    return table(spark, sf_dir, "pages").select("page_id", path.alias("path"))


_PATHS = "(SELECT page_id, regexp_replace(regexp_replace(regexp_replace(url, '^[a-z]+://', ''), '[?#].*$', ''), '/$', '/__init__.html') AS path FROM pages)"
_NAME = "nullif(replace(regexp_replace(regexp_replace(path, '\\.html$', ''), '(^|/)(__init__|__main__)$', ''), '/', '.'), '')"


def fn_module_names(spark, sf_dir):
    p = F.col("path")
    return _paths(spark, sf_dir).select(
        "page_id", names.module_name(p, ".html").alias("name"), names.is_special(p, ".html").alias("special"), names.module_kind(p, ".html").alias("kind"), names.is_init_name(F.regexp_replace(p, r"\.html$", "")).alias("init_name")
    )


SQL_fn_module_names = f"""SELECT page_id, {_NAME} AS name, split_part(path, '/', -1) IN ('__init__.html', '__main__.html') AS special,
 CASE WHEN split_part(path, '/', -1) = '__init__.html' THEN 'PackageInit' WHEN split_part(path, '/', -1) = '__main__.html' THEN 'Main' WHEN path LIKE '%.html' THEN 'RegularModule' ELSE 'NamespacePackageDir' END AS kind,
 regexp_matches(regexp_replace(path, '\\.html$', ''), '(^|\\.)__init__$') AS init_name FROM {_PATHS}"""


def fn_relative_names(spark, sf_dir):
    """A module asks for a name as many levels up as its id says, 0 to 4."""
    rows = _paths(spark, sf_dir).select("page_id", names.module_name(F.col("path"), ".html").alias("own"), names.is_init(F.col("path"), ".html").alias("package"), F.concat(F.repeat(F.lit("."), (F.col("page_id") % 5).cast("int")), F.lit("x..y")).alias("descriptor"))
    level, parts = names.level_of(F.col("descriptor")), names.parts_of(F.col("descriptor"))
    return rows.select("page_id", level.alias("level"), F.array_join(parts, "/").alias("parts"), names.absolute_name(F.col("own"), F.col("package"), level, parts).alias("absolute"))


SQL_fn_relative_names = f"""WITH r AS (SELECT page_id, {_NAME} AS own, split_part(path, '/', -1) = '__init__.html' AS package, CAST(page_id % 5 AS INTEGER) AS level FROM {_PATHS}),
 k AS (SELECT *, len(string_split(own, '.')) - (level - CASE WHEN package THEN 1 ELSE 0 END) AS kept FROM r)
 SELECT page_id, level, 'x/y' AS parts, CASE WHEN level = 0 THEN 'x.y' WHEN kept > 0 THEN array_to_string(list_slice(string_split(own, '.'), 1, kept), '.') || '.x.y' WHEN kept = 0 THEN 'x.y' END AS absolute FROM k"""


def fn_dotted_prefixes(spark, sf_dir):
    rows = _paths(spark, sf_dir).select("page_id", names.module_name(F.col("path"), ".html").alias("name"))
    return rows.select("page_id", F.posexplode(names.dotted_prefixes(F.col("name"))).alias("at", "prefix"))


SQL_fn_dotted_prefixes = f"""WITH r AS (SELECT page_id, string_split({_NAME}, '.') AS p FROM {_PATHS})
 SELECT page_id, CAST(i - 1 AS INTEGER) AS at, array_to_string(list_slice(p, 1, i), '.') AS prefix FROM (SELECT page_id, p, unnest(range(1, len(p))) AS i FROM r)"""


def fn_identifiers(spark, sf_dir):
    n = F.col("p_name")
    upper = F.upper(F.replace(n, F.lit(" "), F.lit("_")))
    under = F.concat(F.repeat(F.lit("_"), (F.col("p_partkey") % 4).cast("int")), F.replace(n, F.lit(" "), F.lit("_")), F.when(F.col("p_partkey") % 3 == 0, "__").otherwise(""))
    return table(spark, sf_dir, "part").select(
        "p_partkey", names.identifier(n).alias("identifier"), names.identifier(F.concat(F.col("p_size").cast("string"), n)).alias("numbered"), names.suffixed_name(n, F.col("p_brand")).alias("suffixed"),
        names.is_constant(upper).alias("constant"), names.is_constant(n).alias("lower_constant"), *(names.is_public(under, v).alias(f"public_{v}") for v in ("strict", "double", "dunder")),
    )


_ID = lambda x: f"regexp_replace({x}, '[^A-Za-z0-9]', '_', 'g')"
_UNDER = "repeat('_', CAST(p_partkey % 4 AS INTEGER)) || replace(p_name, ' ', '_') || CASE WHEN p_partkey % 3 = 0 THEN '__' ELSE '' END"
SQL_fn_identifiers = f"""WITH r AS (SELECT *, {_UNDER} AS u FROM part)
 SELECT p_partkey, {_ID('p_name')} AS identifier, '_' || {_ID('CAST(p_size AS VARCHAR) || p_name')} AS numbered, p_name || '_' || {_ID('p_brand')} AS suffixed,
 regexp_matches(upper(replace(p_name, ' ', '_')), '^[A-Z0-9_]*[A-Z][A-Z0-9_]*$') AS constant, regexp_matches(p_name, '^[A-Z0-9_]*[A-Z][A-Z0-9_]*$') AS lower_constant,
 NOT starts_with(u, '_') AS public_strict, (NOT starts_with(u, '_') OR starts_with(u, '__')) AS public_double,
 (NOT starts_with(u, '_') OR (starts_with(u, '__') AND u LIKE '%\\_\\_' ESCAPE '\\' AND length(u) > 4)) AS public_dunder FROM r"""


def fn_content_hash(spark, sf_dir):
    own = names.line_ends(F.col("text"))
    name = F.concat(F.col("lang"), F.lit("."), F.col("source"))
    return table(spark, sf_dir, "documents").select("doc_id", names.content_hash(own).alias("content_hash"), names.synthetic_name(name, own).alias("synthetic"))


SQL_fn_content_hash = """SELECT doc_id, sha256(t) AS content_hash, '__module_' || substr(sha256(t), 1, 6) || '_' || lang || '_' || source AS synthetic
 FROM (SELECT *, regexp_replace(text, '\r\n?', '\n', 'g') AS t FROM documents)"""


def fn_package_names(spark, sf_dir):
    raw = F.concat_ws("-_.", F.replace("p_name", F.lit(" "), F.lit("__")), F.upper("p_brand"))
    target = F.concat(F.lit("py3"), (F.col("p_partkey") % 8 + 7).cast("string"))
    said = F.element_at(F.array(*[F.lit(x) for x in ("Yes", "0", " on ", "off", "maybe", "TRUE")]), (F.col("p_partkey") % 6 + 1).cast("int"))
    return table(spark, sf_dir, "part").select("p_partkey", names.package_name(raw).alias("package"), names.minor_version(target, strict=False).alias("minor"), names.lenient_boolean(said).alias("said"))


SQL_fn_package_names = """SELECT p_partkey, lower(regexp_replace(replace(p_name, ' ', '__') || '-_.' || upper(p_brand), '[-_.]+', '-', 'g')) AS package,
 CASE WHEN p_partkey % 8 + 7 BETWEEN 8 AND 13 THEN CAST(p_partkey % 8 + 7 AS INTEGER) END AS minor,
 CASE p_partkey % 6 WHEN 0 THEN true WHEN 1 THEN false WHEN 2 THEN true WHEN 3 THEN false WHEN 5 THEN true END AS said FROM part"""


def fn_unique_names(spark, sf_dir):
    """Names that are free beside the parts' names numbered by size, of which sizes up to 3 are taken."""
    part = table(spark, sf_dir, "part")
    base = F.replace("p_name", F.lit(" "), F.lit("_"))
    taken = part.select(F.when(F.col("p_size") % 4 == 0, base).otherwise(F.concat(base, F.lit("_"), (F.col("p_size") % 4).cast("string"))).alias("name"))
    return names.unique_names(part.select(base.alias("base")), taken)


SQL_fn_unique_names = """WITH b AS (SELECT DISTINCT replace(p_name, ' ', '_') AS base FROM part), t AS (SELECT DISTINCT replace(p_name, ' ', '_') AS base, p_size % 4 AS n FROM part),
 f AS (SELECT b.base, min(i) AS n FROM b CROSS JOIN range(0, 5) AS r(i) WHERE NOT EXISTS (SELECT 1 FROM t WHERE t.base = b.base AND t.n = i) GROUP BY b.base)
 SELECT base, CASE WHEN n = 0 THEN base ELSE base || '_' || CAST(n AS VARCHAR) END AS name FROM f"""


def first_match(spark, sf_dir):
    """Each customer's supplier of the same nation: the largest balance, then the smallest key."""
    best = resolve.first_match(table(spark, sf_dir, "supplier"), ["s_nationkey"], [F.desc("s_acctbal"), "s_suppkey"]).select(F.col("s_nationkey").alias("c_nationkey"), "s_suppkey", "s_acctbal")
    return table(spark, sf_dir, "customer").select("c_custkey", "c_nationkey").join(best, "c_nationkey", "left").select("c_custkey", "s_suppkey", "s_acctbal")


SQL_first_match = """SELECT c_custkey, s_suppkey, s_acctbal FROM customer LEFT JOIN (SELECT * FROM supplier QUALIFY row_number() OVER (PARTITION BY s_nationkey ORDER BY s_acctbal DESC, s_suppkey) = 1) ON c_nationkey = s_nationkey"""


def fallback_lookup(spark, sf_dir):
    """Ordered left joins: a document's label quality, else the commonest of its source, else of its language."""
    d, lab = table(spark, sf_dir, "documents").select("doc_id", "source", "lang"), table(spark, sf_dir, "labels")
    known = d.join(lab, "doc_id")
    by = lambda c: known.groupBy(c).agg(F.max("quality").alias("quality"))
    return resolve.coalesced(d, [(lab, ["doc_id"], "quality"), (by("source"), ["source"], "quality"), (by("lang"), ["lang"], "quality")], "quality")


SQL_fallback_lookup = """WITH k AS (SELECT d.doc_id, source, lang, quality FROM documents d JOIN labels l USING (doc_id))
 SELECT d.doc_id, d.source, d.lang, coalesce(l.quality, s.quality, g.quality) AS quality FROM documents d LEFT JOIN labels l USING (doc_id)
 LEFT JOIN (SELECT source, max(quality) AS quality FROM k GROUP BY source) s ON d.source = s.source LEFT JOIN (SELECT lang, max(quality) AS quality FROM k GROUP BY lang) g ON d.lang = g.lang"""


def classify_cascade(spark, sf_dir):
    """Urls' hosts as dotted imports, from the top level down: the import cascade with part of the hosts as first-party packages."""
    host = F.regexp_extract("url", "://([^/?#]*)", 1)
    flipped = F.array_join(F.reverse(F.split(host, r"\.")), ".")
    rows = table(spark, sf_dir, "pages").select("page_id", flipped.alias("name"), F.when(F.col("url").contains("#top"), 1).otherwise(0).alias("level"))
    own = rows.where(F.col("name").startswith("org.example")).select("name").distinct().withColumn("is_package", F.lit(False))
    own = own.unionByName(own.sparkSession.sql("SELECT 'net' AS name, true AS is_package UNION ALL SELECT 'org', false"))
    std, installed = (own.sparkSession.sql(f"SELECT '{n}' AS name") for n in ("com.example.m", "com"))
    out = resolve.classify_imports(rows, known_first=("net.example.blog",), known_third=("org.example.m",), stdlib=std, first_party=own, installed=installed)
    return out.select("page_id", "name", "root", "category")


_FLIP = "array_to_string(list_reverse(string_split(regexp_extract(url, '://([^/?#]*)', 1), '.')), '.')"
SQL_classify_cascade = f"""WITH r AS (SELECT page_id, {_FLIP} AS name, CASE WHEN contains(url, '#top') THEN 1 ELSE 0 END AS level FROM pages),
 s AS (SELECT *, split_part(name, '.', 1) AS root FROM r)
 SELECT page_id, name, root, CASE WHEN level > 0 THEN 'FirstParty' WHEN name = 'net.example.blog' THEN 'FirstParty' WHEN name = 'org.example.m' THEN 'ThirdParty' WHEN name = 'com.example.m' THEN 'StandardLibrary'
 WHEN starts_with(name, 'org.example') OR name IN ('net', 'org') THEN 'FirstParty' WHEN contains(name, '.') AND root = 'org' THEN 'FirstParty' WHEN contains(name, '.') AND root = 'net' THEN 'ThirdParty' ELSE 'ThirdParty' END AS category FROM s"""


def dedup_identity(spark, sf_dir):
    d = table(spark, sf_dir, "documents").select("doc_id", names.content_hash(F.col("text")).alias("content_hash"))
    return resolve.dedup_identity(d, ["content_hash"], F.col("doc_id"), "doc_id").select("doc_id", "primary", "is_primary")


SQL_dedup_identity = "SELECT doc_id, min(doc_id) OVER (PARTITION BY sha256(text)) AS primary, doc_id = min(doc_id) OVER (PARTITION BY sha256(text)) AS is_primary FROM documents"


def symbol_conflicts(spark, sf_dir):
    return aggregates.ordinal_renames(table(spark, sf_dir, "part"), "p_name", "p_partkey", ["p_partkey"])


SQL_symbol_conflicts = """SELECT p_name, p_partkey, row_number() OVER (PARTITION BY p_name ORDER BY p_partkey) AS ordinal, p_name || '_' || CAST(row_number() OVER (PARTITION BY p_name ORDER BY p_partkey) AS VARCHAR) AS new_name
 FROM part QUALIFY count(*) OVER (PARTITION BY p_name) > 1"""


def rename_map(spark, sf_dir):
    """Parts' new names by brand and name, and those left alone, with the brand added where a name is also a type's first word."""
    p = table(spark, sf_dir, "part")
    own = aggregates.rename_map(p, aggregates.ordinal_renames(p, "p_type", "p_brand", ["p_brand"]), "p_type", "p_brand")
    clash = F.length("p_type") % 2 == 0
    return own.select("p_type", "p_brand", "new_name", aggregates.resolved_name(F.col("p_type"), F.when(F.col("new_name") != F.col("p_type"), F.col("new_name")), F.col("p_brand"), clash).alias("resolved"))


SQL_rename_map = f"""WITH d AS (SELECT DISTINCT p_type, p_brand FROM part), n AS (SELECT *, count(*) OVER (PARTITION BY p_type) AS c, row_number() OVER (PARTITION BY p_type ORDER BY p_brand) AS i FROM d),
 m AS (SELECT p_type, p_brand, CASE WHEN c > 1 THEN p_type || '_' || CAST(i AS VARCHAR) ELSE p_type END AS new_name FROM n)
 SELECT p_type, p_brand, new_name, CASE WHEN new_name != p_type THEN new_name WHEN length(p_type) % 2 = 0 THEN p_type || '_' || {_ID('p_brand')} ELSE p_type END AS resolved FROM m"""


def variable_state(spark, sf_dir):
    """Events of a user as items: the event type declares, reads or writes the variable of its kind."""
    e = table(spark, sf_dir, "events")
    role = F.when(F.col("event_id") % 3 == 0, "decl").when(F.col("event_id") % 3 == 1, "read").otherwise("write")
    return aggregates.variable_state(e.select("user_id", "event_type", F.col("event_id").alias("ord"), role.alias("role")), ["user_id", "event_type"])


SQL_variable_state = """WITH i AS (SELECT user_id, event_type, event_id AS ord, event_id % 3 AS r FROM events), d AS (SELECT user_id, event_type, min(ord) AS declared FROM i WHERE r = 0 GROUP BY ALL),
 u AS (SELECT i.user_id, i.event_type, count(*) FILTER (r = 1) AS n_readers, count(*) FILTER (r = 2) AS n_writers, max(ord) AS last_ord FROM i JOIN d ON i.user_id = d.user_id AND i.event_type = d.event_type WHERE r > 0 AND ord >= declared GROUP BY ALL)
 SELECT d.user_id, d.event_type, declared, coalesce(n_readers, 0) AS n_readers, coalesce(n_writers, 0) AS n_writers, last_ord FROM d LEFT JOIN u ON d.user_id = u.user_id AND d.event_type = u.event_type"""


def module_flags(spark, sf_dir):
    e = table(spark, sf_dir, "events")
    reads = e.select(F.col("user_id").alias("module_id"), F.element_at(F.array(F.lit("setattr"), F.lit("locals"), F.lit("__all__"), F.lit("globals")), (F.col("event_id") % 4 + 1).cast("int")).alias("name"))
    return resolve.dynamic_exports(reads).join(aggregates.any_flag(e, ["user_id"], F.col("value") > 100, "busy").withColumnRenamed("user_id", "module_id"), "module_id")


SQL_module_flags = """SELECT user_id AS module_id, bool_or(event_id % 4 = 0) AND bool_or(event_id % 4 IN (1, 3)) AND bool_or(event_id % 4 = 2) AS dynamic, bool_or(value > 100) AS busy FROM events GROUP BY user_id"""


def export_lists(spark, sf_dir):
    p = table(spark, sf_dir, "part").select(F.col("p_brand").alias("module_id"), F.concat(F.repeat(F.lit("_"), (F.col("p_size") % 3).cast("int")), "p_type").alias("name"))
    explicit = p.groupBy("module_id").agg(F.min("name").alias("first")).where(F.col("first").contains("E")).select("module_id", F.array("first").alias("names"))
    return aggregates.export_lists(p, explicit).select("module_id", F.array_join("exports", ",").alias("exports"))


SQL_export_lists = """WITH p AS (SELECT p_brand AS module_id, repeat('_', CAST(p_size % 3 AS INTEGER)) || p_type AS name FROM part),
 g AS (SELECT module_id, min(name) AS first, array_to_string(list_sort(list(DISTINCT name) FILTER (NOT starts_with(name, '_') OR (starts_with(name, '__') AND name LIKE '%\\_\\_' ESCAPE '\\' AND length(name) > 4))), ',') AS public FROM p GROUP BY module_id)
 SELECT module_id, CASE WHEN contains(first, 'E') THEN first ELSE public END AS exports FROM g"""


def requirements(spark, sf_dir):
    hosts = table(spark, sf_dir, "pages").select(F.array_join(F.reverse(F.split(F.regexp_extract("url", "://([^/?#]*)", 1), r"\.")), ".").alias("name"))
    roots = aggregates.distinct_roots(hosts.select(F.regexp_replace("name", "^[a-z]+[.]example[.]", "").alias("name")))
    named = roots.where("length(root) % 2 = 0").select("root", F.concat(F.lit("Py_"), F.upper("root")).alias("package"))
    return aggregates.joined_lines(aggregates.requirements(roots, named), "package")


SQL_requirements = f"""WITH r AS (SELECT DISTINCT split_part(regexp_replace({_FLIP}, '^[a-z]+[.]example[.]', ''), '.', 1) AS root FROM pages),
 p AS (SELECT DISTINCT lower(regexp_replace(CASE WHEN length(root) % 2 = 0 THEN 'Py_' || upper(root) ELSE root END, '[-_.]+', '-', 'g')) AS package FROM r)
 SELECT string_agg(package, chr(10) ORDER BY package) AS text FROM p"""


def installed_packages(spark, sf_dir):
    """Part names as entries of a site-packages folder: files, packages, private ones, distribution folders, other files."""
    n = F.replace("p_name", F.lit(" "), F.lit("_"))
    ways = F.array(F.concat(n, F.lit(".py")), F.concat(n, F.lit("/__init__.py")), F.concat(F.lit("_"), n, F.lit("/x.py")), F.concat(n, F.lit("-1.0.dist-info/METADATA")), F.concat(n, F.lit(".txt")))
    return source.installed_packages(table(spark, sf_dir, "part").select(F.element_at(ways, (F.col("p_partkey") % 5 + 1).cast("int")).alias("path")))


SQL_installed_packages = "SELECT DISTINCT replace(p_name, ' ', '_') AS name FROM part WHERE p_partkey % 5 < 2"


def distribution_names(spark, sf_dir):
    """Suppliers as distributions: the parts that they deliver are the roots that their RECORD names, one in four is no module."""
    root = F.concat(F.lit("r"), F.col("l_partkey").cast("string"))
    line = F.when(F.col("l_partkey") % 4 == 0, F.concat(root, F.lit(".so,x,1"))).when(F.col("l_partkey") % 4 == 1, F.concat(root, F.lit(".py,x,1"))).otherwise(F.concat(root, F.lit("/a.py,x,1")))
    records = table(spark, sf_dir, "lineitem").select(F.col("l_suppkey").alias("dist"), line.alias("line"))
    s = table(spark, sf_dir, "supplier")
    metadata = s.select(F.col("s_suppkey").alias("dist"), F.explode(F.array(F.lit("Version: 1"), F.concat(F.lit("Name: "), "s_name"))).alias("line"))
    return source.distribution_names(records, metadata)


SQL_distribution_names = """SELECT 'r' || CAST(l_partkey AS VARCHAR) AS root, min(s_name) AS package FROM lineitem JOIN supplier ON l_suppkey = s_suppkey WHERE l_partkey % 4 != 0 GROUP BY l_partkey"""


def combined_settings(spark, sf_dir):
    """Orders as pairs of settings: the first of two that is set, and lists put one behind the other."""
    o = table(spark, sf_dir, "orders")
    mine = F.when(F.col("o_orderkey") % 3 == 0, F.col("o_orderstatus"))
    lists = [F.when(F.col("o_orderkey") % k != 0, F.array("o_orderpriority", F.lit(str(k)))) for k in (2, 5)]
    return o.select("o_orderkey", aggregates.either(mine, F.lit("default")).alias("one"), F.array_join(aggregates.appended(*lists), ",").alias("both"))


SQL_combined_settings = """SELECT o_orderkey, CASE WHEN o_orderkey % 3 = 0 THEN o_orderstatus ELSE 'default' END AS one,
 concat_ws(',', CASE WHEN o_orderkey % 2 != 0 THEN o_orderpriority || ',2' END, CASE WHEN o_orderkey % 5 != 0 THEN o_orderpriority || ',5' END) AS both FROM orders"""


def importers(spark, sf_dir):
    return aggregates.importers(table(spark, sf_dir, "lineitem"), "l_partkey", "l_suppkey")


SQL_importers = "SELECT l_partkey, count(DISTINCT l_suppkey) AS n_importers, min(l_suppkey) AS first_importer FROM lineitem GROUP BY l_partkey"


def line_audit(spark, sf_dir):
    return aggregates.line_audit(table(spark, sf_dir, "documents"), "doc_id", "text", F.length("line") < 4)


SQL_line_audit = """WITH l AS (SELECT doc_id, trim(unnest(string_split(text, chr(10)))) AS line, unnest(range(1, len(string_split(text, chr(10))) + 1)) AS i FROM documents)
 SELECT doc_id, line, count(*) AS n, min(i) AS first_line, array_to_string(list_sort(list(i)), ',') AS line_numbers FROM l WHERE line != '' AND length(line) >= 4 GROUP BY doc_id, line HAVING count(*) > 1"""


def last_wins(spark, sf_dir):
    return resolve.last_wins(table(spark, sf_dir, "events"), ["user_id", "event_type"], F.col("value"), F.struct("ts", "event_id"))


SQL_last_wins = "SELECT user_id, event_type, value FROM events QUALIFY row_number() OVER (PARTITION BY user_id, event_type ORDER BY ts DESC, event_id DESC) = 1"


def statistics(spark, sf_dir):
    return aggregates.statistics(table(spark, sf_dir, "events"), "event_type")


SQL_statistics = "SELECT event_type, count(*) AS n FROM events GROUP BY event_type"


def prefix_members(spark, sf_dir):
    """Pages that are, or lie under, one of the hosts' language folders with the page number 1 to 9."""
    rows = _paths(spark, sf_dir).select("page_id", names.module_name(F.col("path"), ".html").alias("name"))
    folders = rows.select(F.regexp_extract("name", "^(.*[.](?:en|fr))[.]", 1).alias("folder")).where("folder != ''")
    return resolve.prefix_members(rows, "name", folders, "folder")


SQL_prefix_members = f"""WITH r AS (SELECT page_id, {_NAME} AS name FROM {_PATHS}), f AS (SELECT DISTINCT regexp_extract(name, '^(.*[.](?:en|fr))[.]', 1) AS folder FROM r)
 SELECT page_id, name FROM r WHERE EXISTS (SELECT 1 FROM f WHERE folder != '' AND (name = folder OR starts_with(name, folder || '.')))"""


def prefix_first(spark, sf_dir):
    rows = _paths(spark, sf_dir).select("page_id", names.module_name(F.col("path"), ".html").alias("module"))
    last = F.element_at(F.split("module", r"\."), -1)
    defs = rows.select("module", F.substring(last, 1, 1).alias("name"), F.col("page_id").alias("rank"))
    asked = defs.select(F.substring_index("module", ".", 3).alias("base"), F.col("name").alias("attr")).distinct()
    return resolve.prefix_first(asked, "base", "attr", defs)


SQL_prefix_first = f"""WITH r AS (SELECT page_id, {_NAME} AS module FROM {_PATHS}), d AS (SELECT module, substr(list_extract(string_split(module, '.'), -1), 1, 1) AS name, page_id AS rank FROM r),
 a AS (SELECT DISTINCT array_to_string(list_slice(string_split(module, '.'), 1, 3), '.') AS base, name AS attr FROM d)
 SELECT base, attr, (SELECT arg_min(module, rank) FROM d WHERE starts_with(module, base || '.') AND d.name = attr) AS module FROM a"""


def unused(spark, sf_dir):
    orders = table(spark, sf_dir, "orders").where("o_orderpriority = '1-URGENT'").select(F.col("o_custkey").alias("c_custkey"))
    return resolve.unused(table(spark, sf_dir, "customer").select("c_custkey", "c_name"), orders, ["c_custkey"])


SQL_unused = "SELECT c_custkey, c_name FROM customer WHERE c_custkey NOT IN (SELECT o_custkey FROM orders WHERE o_orderpriority = '1-URGENT')"


def symbol_decisions(spark, sf_dir):
    """The two ordered decisions about symbols, over documents with flags from other tables and facts."""
    d = table(spark, sf_dir, "documents").select("doc_id", "n_chars", F.concat(F.when(F.col("doc_id") % 7 == 0, "_").otherwise(""), "source").alias("name"))
    lab = table(spark, sf_dir, "labels")
    rows = resolve.flagged(d, ["doc_id"], {"listed": lab, "live": lab.where("quality = 1"), "wrapper": lab.where("toxic = 1")})
    odd = F.col("n_chars") % 2 == 1
    flags = {"imported_by_wrapper": F.col("wrapper"), "type_checking": F.lit(False), "has_list": odd, "listed": F.col("listed"), "live": F.col("live"), "wrapper": F.col("wrapper"), "liveness_on": odd, "imported_elsewhere": F.col("listed")}
    return rows.select("doc_id", resolve.should_inline(flags).alias("inline"), resolve.should_export(F.col("name"), flags).alias("export"))


SQL_symbol_decisions = """WITH r AS (SELECT d.doc_id, n_chars % 2 = 1 AS odd, doc_id % 7 = 0 AS private, l.doc_id IS NOT NULL AS listed, coalesce(quality = 1, false) AS live, coalesce(toxic = 1, false) AS wrapper FROM documents d LEFT JOIN labels l USING (doc_id))
 SELECT doc_id, CASE WHEN wrapper THEN true WHEN odd AND NOT listed THEN false WHEN live OR listed THEN true ELSE false END AS inline,
 CASE WHEN listed AND NOT wrapper THEN live WHEN NOT live THEN false WHEN odd THEN true WHEN private THEN listed ELSE true END AS export FROM r"""


def import_effects(spark, sf_dir):
    """Import rows from urls: tolerated scopes, and whether importing has side effects."""
    rows = table(spark, sf_dir, "pages").select("page_id", F.split("url", "/").alias("s"), (F.col("page_id") % 3).alias("level"))
    scope = F.when(F.col("page_id") % 2 == 0, F.array(F.lit("If"), F.lit("Try"))).when(F.col("page_id") % 5 == 0, F.array(F.lit("With"))).otherwise(F.array(F.lit("If")))
    name = F.when(F.col("page_id") % 4 == 0, "").otherwise(F.col("s")[2])
    return rows.select("page_id", resolve.tolerated(scope).alias("tolerated"), resolve.import_side_effects(name, F.col("level"), F.col("page_id") % 6 == 0, F.startswith(name, F.lit("www"))).alias("effects"))


SQL_import_effects = """SELECT page_id, page_id % 2 = 0 OR page_id % 5 = 0 AS tolerated,
 CASE WHEN page_id % 3 > 0 AND page_id % 4 = 0 THEN page_id % 6 = 0 WHEN page_id % 4 != 0 AND starts_with(split_part(url, '/', 3), 'www') THEN false ELSE true END AS effects FROM pages"""


def equal_sets(spark, sf_dir):
    """Orders by their set of (return flag, line status, line number)."""
    return resolve.equal_sets(table(spark, sf_dir, "lineitem").select("l_orderkey", F.concat_ws("/", "l_returnflag", "l_linestatus", F.col("l_linenumber").cast("string")).alias("m")), "l_orderkey", "m")


SQL_equal_sets = """WITH s AS (SELECT l_orderkey, list_sort(list(DISTINCT l_returnflag || '/' || l_linestatus || '/' || CAST(l_linenumber AS VARCHAR))) AS m FROM lineitem GROUP BY l_orderkey)
 SELECT l_orderkey, min(l_orderkey) OVER (PARTITION BY m) AS first_key, count(*) OVER (PARTITION BY m) AS n_keys FROM s"""


def expand_wildcards(spark, sf_dir):
    """Brands import each other's types by star: each the brand after it."""
    p = table(spark, sf_dir, "part").select(F.col("p_brand").alias("module"), F.col("p_type").alias("name"), "p_size").distinct()
    brands = p.select("module").distinct()
    nxt = brands.select("module", F.concat(F.expr("substr(module, 1, length(module) - 1)"), ((F.expr("cast(substr(module, -1, 1) as int)") % 5) + 1).cast("string")).alias("target"))
    explicit = brands.where(F.col("module").endswith("3"))
    return aggregates.expand_wildcards(nxt, p.where("p_size <= 10").select("module", "name").distinct(), explicit)


SQL_expand_wildcards = """WITH p AS (SELECT DISTINCT p_brand AS module, p_type AS name FROM part WHERE p_size <= 10), b AS (SELECT DISTINCT p_brand AS module FROM part),
 n AS (SELECT module, substr(module, 1, length(module) - 1) || CAST(CAST(right(module, 1) AS INTEGER) % 5 + 1 AS VARCHAR) AS target FROM b)
 SELECT module, name FROM p UNION SELECT n.module, p.name FROM n JOIN p ON p.module = n.target WHERE n.module NOT LIKE '%3'"""


def lifted_globals(spark, sf_dir):
    p = table(spark, sf_dir, "part").select(F.col("p_brand").alias("module"), F.col("p_type").alias("var"), "p_size")
    return aggregates.lifted_globals(p.select("module", "var"), p.where("p_size = 50").select("module", "var"), p.where("p_size < 25").select("module", "var"))


SQL_lifted_globals = f"""WITH v AS (SELECT DISTINCT p_brand AS module, p_type AS var FROM part), l AS (SELECT DISTINCT p_brand AS module, p_type AS var FROM part WHERE p_size = 50),
 pool AS (SELECT * FROM l UNION SELECT * FROM v WHERE module NOT IN (SELECT module FROM l)), d AS (SELECT DISTINCT p_brand AS module, p_type AS var FROM part WHERE p_size < 25)
 SELECT module, var, '__global_' || {_ID('module')} || '_' || var AS lifted FROM (SELECT * FROM pool INTERSECT SELECT * FROM d)"""


def child_aliases(spark, sf_dir):
    rows = _paths(spark, sf_dir).select(names.module_name(F.col("path"), ".html").alias("name"))
    package = F.substring_index("name", ".", 2)
    return aggregates.child_aliases(rows, package, rows.select(package.alias("package"), F.lit("com").alias("child")).distinct())


SQL_child_aliases = f"""WITH r AS (SELECT {_NAME} AS name FROM {_PATHS}), c AS (SELECT DISTINCT array_to_string(list_slice(string_split(name, '.'), 1, 2), '.') AS package, list_extract(string_split(name, '.'), 3) AS child FROM r WHERE len(string_split(name, '.')) > 2)
 SELECT package, child FROM c WHERE child != 'com' AND NOT starts_with(child, '_')"""


def config_merge(spark, sf_dir):
    """Order priorities as layers of settings: the customer is a key, the status its value; `O` stands for a collection left empty."""
    o = table(spark, sf_dir, "orders")
    layers = o.select("o_orderpriority", F.substring("o_orderpriority", 1, 1).cast("int").alias("priority"), F.col("o_custkey").cast("string").alias("key"), F.when(F.col("o_orderstatus") == "O", "").otherwise(F.col("o_orderstatus")).alias("value"), "o_orderkey")
    one = layers.groupBy("o_orderpriority", "priority", "key").agg(F.max_by("value", "o_orderkey").alias("value")).withColumnRenamed("o_orderpriority", "layer")
    even = one.where("cast(key as bigint) % 2 = 0")
    odd = one.where("cast(key as bigint) % 2 = 1").withColumn("value", F.nullif("value", F.lit("")))
    return aggregates.precedence_merge(even.unionByName(odd))


SQL_config_merge = """WITH l AS (SELECT o_orderpriority AS layer, CAST(left(o_orderpriority, 1) AS INTEGER) AS priority, o_custkey, arg_max(CASE WHEN o_orderstatus = 'O' THEN '' ELSE o_orderstatus END, o_orderkey) AS value FROM orders GROUP BY ALL)
 SELECT CAST(o_custkey AS VARCHAR) AS key, value, layer FROM l WHERE NOT (o_custkey % 2 = 1 AND value = '') QUALIFY row_number() OVER (PARTITION BY o_custkey ORDER BY priority DESC) = 1"""


def assemble(spark, sf_dir):
    rows = table(spark, sf_dir, "conversations").select("conv_id", "turn", F.concat_ws(": ", "role", F.coalesce("text", F.lit(""))).alias("part"))
    return aggregates.assembled(rows, "conv_id", ["turn"], "part")


SQL_assemble = "SELECT conv_id, string_agg(concat_ws(': ', role, coalesce(text, '')), chr(10) ORDER BY turn) AS text, count(*) AS n_parts FROM conversations GROUP BY conv_id"


QUERIES = {k: f for k, f in list(globals().items()) if f"SQL_{k}" in globals()}
SQL = {k: globals()[f"SQL_{k}"] for k in QUERIES}
