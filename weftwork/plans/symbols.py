"""Core queries about names across modules: parts' brands stand for modules, their types for symbols. Each has the same result as SQL."""

from __future__ import annotations

from pyspark.sql import functions as F

from weftwork.functions import names
from weftwork.operators import resolve, symbols
from weftwork.plans.relational import table

#: Brand after a given one: Brand#15 imports from Brand#11 and so on.
_NEXT = "concat(substr({0}, 1, length({0}) - 1), cast(cast(substr({0}, length({0}), 1) as int) % 5 + 1 as string))"
_SQL_NEXT = "substr({0}, 1, length({0}) - 1) || CAST(CAST(right({0}, 1) AS INTEGER) % 5 + 1 AS VARCHAR)"


def _parts(spark, sf_dir):
    """(module, name, size, key): every third symbol is private."""
    p = table(spark, sf_dir, "part")
    return p.select(F.col("p_brand").alias("module"), F.concat(F.when(F.col("p_partkey") % 3 == 0, "_").otherwise(""), "p_type").alias("name"), F.col("p_size").alias("size"), F.col("p_partkey").alias("key"))


_P = "p AS (SELECT p_brand AS module, CASE WHEN p_partkey % 3 = 0 THEN '_' ELSE '' END || p_type AS name, p_size AS size, p_partkey AS key FROM part)"


def imported_elsewhere(spark, sf_dir):
    """Symbols that the brand before imports by name (sizes below 20), or by star where the brand ends in 2 or 4; brands in 4 list sizes above 40."""
    p = _parts(spark, sf_dir)
    before = p.select(F.col("module").alias("importer"), F.expr(_NEXT.format("module")).alias("source"), "module", "size", "name")
    by_name = p.where("size < 20").select(F.expr(_NEXT.format("module")).alias("importer"), F.col("module").alias("source"), F.col("name").alias("original"))
    stars = before.where("source like '%2' or source like '%4'").select("importer", "source", F.lit("*").alias("original"))
    own = p.where("size < 3").select(F.col("module").alias("importer"), F.col("module").alias("source"), F.col("name").alias("original"))
    return symbols.imported_elsewhere(p.select("module", "name").distinct(), by_name.unionByName(stars).unionByName(own), p.where("size > 40 and module like '%4'").select("module", "name"))


SQL_imported_elsewhere = f"""WITH {_P}, s AS (SELECT DISTINCT module, name FROM p), l AS (SELECT DISTINCT module, name FROM p WHERE size > 40 AND module LIKE '%4'), n AS (SELECT DISTINCT module, name FROM p WHERE size < 20),
 st AS (SELECT DISTINCT {_SQL_NEXT.format('module')} AS module FROM p WHERE {_SQL_NEXT.format('module')} LIKE '%2' OR {_SQL_NEXT.format('module')} LIKE '%4')
 SELECT module, name, (module, name) IN (SELECT (module, name) FROM n) OR (module IN (SELECT module FROM st) AND CASE WHEN module IN (SELECT module FROM l) THEN (module, name) IN (SELECT (module, name) FROM l) ELSE NOT starts_with(name, '_') END) AS imported FROM s"""


def wrapper_sources(spark, sf_dir):
    """A part's type is imported, in order of keys, from a brand that follows from its size; brands that end in 1 or 3 are wrappers."""
    p = _parts(spark, sf_dir)
    source = F.concat(F.lit("Brand#"), (F.col("size") % 5 + 1).cast("string"), (F.col("key") % 5 + 1).cast("string"))
    rows = p.select("module", F.col("name").alias("local"), source.alias("source"), F.when(F.col("key") % 7 == 0, "*").otherwise(F.upper("name")).alias("original"), F.col("key").alias("ord"))
    wrappers = p.where("module like '%1' or module like '%3'").select("module")
    return symbols.wrapper_sources(p.select("module", "name").distinct(), rows, wrappers)


SQL_wrapper_sources = f"""WITH {_P}, i AS (SELECT module, name, 'Brand#' || CAST(size % 5 + 1 AS VARCHAR) || CAST(key % 5 + 1 AS VARCHAR) AS source, upper(name) AS original, key FROM p WHERE key % 7 != 0),
 f AS (SELECT module, name, source, original FROM i WHERE source IN (SELECT module FROM p WHERE module LIKE '%1' OR module LIKE '%3') QUALIFY row_number() OVER (PARTITION BY module, name ORDER BY key) = 1)
 SELECT s.module, s.name, source, original FROM (SELECT DISTINCT module, name FROM p) s LEFT JOIN f ON s.module = f.module AND s.name = f.name"""


def list_accesses(spark, sf_dir):
    """Events as attribute reads: the type is the base, which half of the users bind to another user's name."""
    e = table(spark, sf_dir, "events")
    user = F.col("user_id").cast("string")
    attributes = e.select(user.alias("module"), F.concat_ws("", "event_type", (F.col("event_id") % 3).cast("string")).alias("base"), F.when(F.col("event_id") % 4 == 0, "__all__").otherwise("x").alias("attr"))
    even = e.where("user_id % 2 = 0 and event_id % 2 = 0")
    aliases = even.select(user.alias("module"), F.concat_ws("", "event_type", (F.col("event_id") % 3).cast("string")).alias("local"), (F.col("user_id") + F.col("event_id") % 5).cast("string").alias("source"), F.col("event_id").alias("ord"))
    modules = e.select(user.alias("module")).union(e.select(F.concat("event_type", F.lit("1"))))
    return symbols.list_accesses(attributes, aliases, modules)


SQL_list_accesses = """WITH a AS (SELECT DISTINCT user_id, event_type || CAST(event_id % 3 AS VARCHAR) AS base FROM events WHERE event_id % 4 = 0),
 b AS (SELECT user_id, event_type || CAST(event_id % 3 AS VARCHAR) AS base, arg_min(CAST(user_id + event_id % 5 AS VARCHAR), event_id) AS source FROM events WHERE user_id % 2 = 0 AND event_id % 2 = 0 GROUP BY ALL),
 m AS (SELECT CAST(user_id AS VARCHAR) AS module FROM events UNION SELECT event_type || '1' FROM events)
 SELECT DISTINCT CAST(a.user_id AS VARCHAR) AS module, coalesce(source, a.base) AS accessed FROM a LEFT JOIN b ON a.user_id = b.user_id AND a.base = b.base WHERE coalesce(source, a.base) IN (SELECT module FROM m)"""


def uses_import(spark, sf_dir):
    """Orders as items: the first line's part is defined, the others are read; returned parts are what the definition lists."""
    li = table(spark, sf_dir, "lineitem")
    text = lambda c: F.col(c).cast("string")
    roles = li.select(F.lit("m").alias("module"), F.col("l_orderkey").alias("item_ord"), F.element_at(F.array(F.lit("defined"), F.lit("read"), F.lit("eventual_read"), F.lit("write")), (F.col("l_linenumber") - 1) % 4 + 1).alias("role"), text("l_partkey").alias("name"))
    deps = li.where("l_returnflag = 'R'").select(F.lit("m").alias("module"), F.col("l_orderkey").alias("item_ord"), text("l_partkey").alias("symbol"), text("l_suppkey").alias("dep"))
    asked = li.select(F.lit("m").alias("module"), text("l_partkey").alias("symbol"), text("l_suppkey").alias("local")).distinct()
    return symbols.uses_import(asked, roles, deps).select("symbol", "local", "uses")


SQL_uses_import = """WITH r AS (SELECT l_orderkey AS o, (l_linenumber - 1) % 4 AS k, CAST(l_partkey AS VARCHAR) AS n, CAST(l_suppkey AS VARCHAR) AS s, l_returnflag AS f FROM lineitem), d AS (SELECT DISTINCT o, n FROM r WHERE k = 0),
 u AS (SELECT d.n AS symbol, r.n AS local FROM d JOIN r ON d.o = r.o AND k IN (1, 2) UNION SELECT r.n, r.s FROM r JOIN d ON d.o = r.o AND d.n = r.n WHERE f = 'R')
 SELECT symbol, local, (symbol, local) IN (SELECT (symbol, local) FROM u) AS uses FROM (SELECT DISTINCT n AS symbol, s AS local FROM r)"""


def _hosts(spark, sf_dir):
    """(module, name, key): url hosts from the top level down, and the last letters of their paths."""
    host = F.array_join(F.reverse(F.split(F.regexp_extract("url", "://([^/?#]*)", 1), r"\.")), ".")
    name = F.concat(F.when(F.col("page_id") % 4 == 0, "_").otherwise("n"), (F.col("page_id") % 11).cast("string"))
    return table(spark, sf_dir, "pages").select(host.alias("module"), name.alias("name"), F.col("page_id").alias("key"))


_H = "h AS (SELECT array_to_string(list_reverse(string_split(regexp_extract(url, '://([^/?#]*)', 1), '.')), '.') AS module, CASE WHEN page_id % 4 = 0 THEN '_' ELSE 'n' END || CAST(page_id % 11 AS VARCHAR) AS name, page_id AS key FROM pages)"


def star_names(spark, sf_dir):
    """Hosts and the domains above them as modules: pages import by star from the domain above a host; some symbols are listed, live, renamed or from wrappers."""
    h = _hosts(spark, sf_dir)
    up = F.substring_index("module", ".", 2)
    all_rows = h.unionByName(h.select(up.alias("module"), "name", "key"))
    stars = h.select(F.concat(F.lit("m"), (F.col("key") % 6).cast("string")).alias("module"), up.alias("target"), (F.col("key") % 6 == 1).alias("whole")).distinct()
    listed = all_rows.where("length(module) % 2 = 0 and key % 5 < 3").select("module", "name").distinct()
    alive = all_rows.where("key % 7 in (0, 3)").select("module", "name").distinct()
    renames = all_rows.where("key % 5 = 1").select("module", "name", F.concat("name", F.lit("_2")).alias("new_name")).distinct()
    return symbols.star_names(stars, listed, all_rows.select("module", "name"), renames, alive, all_rows.where("key % 9 = 0").select("module", "name"))


SQL_star_names = f"""WITH {_H}, u AS (SELECT *, array_to_string(list_slice(string_split(module, '.'), 1, 2), '.') AS up FROM h), a AS (SELECT module, name, key FROM u UNION ALL SELECT up, name, key FROM u),
 st AS (SELECT DISTINCT 'm' || CAST(key % 6 AS VARCHAR) AS module, up AS target, key % 6 = 1 AS whole FROM u), l AS (SELECT DISTINCT module, name FROM a WHERE length(module) % 2 = 0 AND key % 5 < 3),
 v AS (SELECT DISTINCT module, name FROM a WHERE key % 7 IN (0, 3)), r AS (SELECT DISTINCT module, name, name || '_2' AS new_name FROM a WHERE key % 5 = 1), w AS (SELECT DISTINCT module, name FROM a WHERE key % 9 = 0),
 e AS (SELECT st.module, target, name, false AS open FROM st JOIN l ON l.module = target
  WHERE whole OR EXISTS (SELECT 1 FROM v WHERE v.module = target AND v.name = l.name) OR EXISTS (SELECT 1 FROM l AS l2 JOIN v AS v2 ON l2.module = v2.module AND l2.name = v2.name WHERE starts_with(l2.module, target || '.') AND l2.name = l.name)
  UNION ALL SELECT st.module, target, v.name, true FROM st JOIN v ON v.module = target WHERE target NOT IN (SELECT module FROM l))
 SELECT e.module, target, e.name, coalesce(new_name, e.name) AS value, w.module IS NOT NULL AS deferred FROM e LEFT JOIN r ON r.module = target AND r.name = e.name LEFT JOIN w ON w.module = target AND w.name = e.name
 WHERE NOT open OR NOT starts_with(coalesce(new_name, e.name), '_')"""


def rename_rows(spark, sf_dir):
    """Brands list half of their types under their own name but those renamed; brands of odd number are inlined, one type of a brand is a submodule."""
    p = _parts(spark, sf_dir)
    renames = p.where("size % 4 = 0").groupBy("module", "name").agg(F.concat(F.col("name"), F.lit("_"), F.min("key").cast("string")).alias("new_name"))
    bundled = p.where("size = 7").select(F.concat_ws(".", "module", "name").alias("module"))
    return symbols.rename_rows(renames, p.where("size <= 25").select("module", "name"), p.where("cast(substr(module, 7) as int) % 2 = 1").select("module"), bundled)


SQL_rename_rows = f"""WITH {_P}, r AS (SELECT module, name, name || '_' || CAST(min(key) AS VARCHAR) AS new_name FROM p WHERE size % 4 = 0 GROUP BY module, name)
 SELECT * FROM r UNION ALL SELECT DISTINCT module, name, name AS new_name FROM p WHERE size <= 25 AND CAST(substr(module, 7) AS INTEGER) % 2 = 1
 AND (module, name) NOT IN (SELECT (module, name) FROM r) AND (module, name) NOT IN (SELECT (module, name) FROM p WHERE size = 7)"""


def missing_first_party(spark, sf_dir):
    """Url hosts as imports: those under org are first-party, a seventh of the pages stands in a try, hosts with an even page are known."""
    h = _hosts(spark, sf_dir)
    scope = F.when(F.col("key") % 7 == 0, F.array(F.lit("Try"))).otherwise(F.array(F.lit("If")))
    rows = h.select(F.concat(F.lit("page"), F.col("key").cast("string")).alias("module"), F.col("module").alias("name"), F.when(F.col("module").startswith("org"), "FirstParty").otherwise("ThirdParty").alias("category"), resolve.tolerated(scope).alias("tolerated"))
    return symbols.missing_first_party(rows, h.where("key % 2 = 0").select(F.col("module").alias("name")))


SQL_missing_first_party = f"""WITH {_H} SELECT 'page' || CAST(key AS VARCHAR) AS module, module AS name, 'no module named ' || module AS message FROM h
 WHERE starts_with(module, 'org') AND key % 7 != 0 AND module NOT IN (SELECT module FROM h WHERE key % 2 = 0)"""


def search_directories(spark, sf_dir):
    """Customers' search paths: the nation's folder, written in five ways."""
    c = table(spark, sf_dir, "customer")
    n = F.col("c_nationkey").cast("string")
    ways = F.array(n, F.concat(F.lit("./"), n), F.concat(F.lit("x/../"), n, F.lit("/")), F.concat(F.lit("/"), n, F.lit("//y/..")), F.concat(F.lit("../"), n, F.lit("/.")))
    rows = c.select("c_mktsegment", F.element_at(ways, (F.col("c_custkey") % 5 + 1).cast("int")).alias("dir"), F.col("c_custkey").alias("priority"))
    return symbols.search_directories(rows, ["c_mktsegment"])


SQL_search_directories = """SELECT c_mktsegment, CASE c_custkey % 5 WHEN 3 THEN '/' WHEN 4 THEN '../' ELSE '' END || CAST(c_nationkey AS VARCHAR) AS dir, min(c_custkey) AS priority FROM customer GROUP BY 1, 2"""


def module_parts(spark, sf_dir):
    """Urls as files: names as seen from the domains, from the language folders, and from hosts under net that come first."""
    path = F.regexp_replace(F.regexp_replace(F.regexp_replace("url", "^[a-z]+://", ""), "[?#].*$", ""), "/$", "/__init__.html")
    files = table(spark, sf_dir, "pages").select(path.alias("path"))
    host = F.split("path", "/")[0]
    net = files.where(host.endswith(".net")).select(host.alias("dir"), F.lit(0).alias("priority"))
    folder = files.select(F.regexp_extract("path", "^([^/]*/(?:en|fr))/", 1).alias("dir"), F.lit(1).alias("priority")).where("dir != ''")
    rest = files.where(~host.endswith(".de")).select(host.alias("dir"), F.lit(2).alias("priority"))
    out = symbols.module_parts(files.distinct(), net.unionByName(folder).unionByName(rest).distinct(), ".html")
    return out.select("path", "dir", F.array_join("parts", "/").alias("parts"))


SQL_module_parts = """WITH f AS (SELECT DISTINCT regexp_replace(regexp_replace(regexp_replace(url, '^[a-z]+://', ''), '[?#].*$', ''), '/$', '/__init__.html') AS path FROM pages),
 c AS (SELECT path, regexp_replace(regexp_replace(path, '/\\./', '/', 'g'), '//+', '/', 'g') AS own, split_part(path, '/', 1) AS host, regexp_extract(path, '^([^/]*/(?:en|fr))/', 1) AS folder FROM f),
 d AS (SELECT path, own, CASE WHEN NOT contains(own, '/') THEN NULL WHEN host LIKE '%.net' THEN host WHEN folder != '' THEN folder WHEN host NOT LIKE '%.de' THEN host END AS dir FROM c)
 SELECT path, dir, CASE WHEN dir IS NOT NULL THEN replace(regexp_replace(regexp_replace(substr(own, length(dir) + 2), '\\.html$', ''), '(^|/)(__init__|__main__)$', ''), '.', '/') END AS parts FROM d"""


def fn_registry_names(spark, sf_dir):
    """Relative imports where packages are known by name only, and where they are not told from modules at all."""
    h = _hosts(spark, sf_dir).select("key", F.when(F.col("key") % 5 == 0, F.substring_index("module", ".", 1)).otherwise(F.col("module")).alias("own"))
    package = F.when(F.col("key") % 3 == 0, True).when(F.col("key") % 3 == 1, False)
    level, rest = (F.col("key") % 4 + 1).cast("int"), F.array(F.lit("x"))
    return h.select("key", names.registry_name(F.col("own"), package, level, rest).alias("registry"), names.stripped_name(F.col("own"), level, rest).alias("stripped"))


SQL_fn_registry_names = f"""WITH {_H}, o AS (SELECT key, string_split(CASE WHEN key % 5 = 0 THEN split_part(module, '.', 1) ELSE module END, '.') AS p, key % 4 + 1 AS level FROM h),
 k AS (SELECT *, greatest(len(p) - level + CASE WHEN key % 3 = 0 OR len(p) = 1 THEN 1 ELSE 0 END, 0) AS kept FROM o)
 SELECT key, array_to_string(list_append(list_slice(p, 1, kept), 'x'), '.') AS registry, array_to_string(list_append(list_slice(p, 1, greatest(len(p) - level, 0)), 'x'), '.') AS stripped FROM k"""


QUERIES = {k: f for k, f in list(globals().items()) if f"SQL_{k}" in globals()}
SQL = {k: globals()[f"SQL_{k}"] for k in QUERIES}
