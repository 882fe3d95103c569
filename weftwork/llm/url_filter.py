"""URL filters: rules first, then logistic regression on hashed character n-grams of host and path.

The model is trained here, from a small labelled table (url, label; at most MOST_LABELLED rows,
which is checked). Training and scoring are DataFrame functions. Gradient descent
runs on the dual: a table of n labelled urls has an n x n matrix of inner products, so one
array expression over n numbers does all steps, and the weights of the hashed
n-grams follow as a sum. The weights have DIMENSIONS entries whatever the input, and reach the
scan as one literal: judging urls is a projection without any shuffle.

Nulls: a null url, or one without `://`, has empty host and path and an allow verdict, unless a
rule fits. Repeated rows are judged alike. Ties between rules of the same length go to the block rule. Urls of any length
are taken whole. Other columns take no part, whatever their names. An empty table gives an empty result.
"""

from __future__ import annotations

from dataclasses import dataclass

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

from weftwork.llm.common import LOWER, UPPER, stored

DIMENSIONS = 4096
SIZES = (3, 4, 5)
MOST_LABELLED = 1000
MOST_INLINE_RULES = 200

#: The labelled table's words, chosen by hand for this engine: what commonly names unwanted sites, and what names ordinary ones.
UNWANTED = (
    "casino poker slots roulette bets betting jackpot lottery viagra pills meds pharma xxx porn adult escort hookup payday loans replica warez keygen ads adserver popup tracker clickbait spam linkfarm backlinks"
).split()
ORDINARY = (
    "library museum garden history travel weather recipes science physics biology football school council hospital theatre music chess trains maps news books birds cooking languages astronomy photos woodwork rivers choir parish "
    "university compiler tutorial forum gallery archive bakery dentist climbing sailing poetry novels radio weaving allotment bridge geology insects railway planets dictionary grammar village orchestra ceramics hiking mountain harbour lighthouse orchard"
).split()
#: What stands beside a word, and round a name; alike for both labels.
BESIDE = "best free cheap online my the top new city daily".split()
FRAMES = [("https://", ".com/"), ("http://www.", ".net/index.html"), ("https://shop.", ".org/item/7"), ("http://m.", ".info/a?id=3"), ("https://blog.", ".net/2019/post")]


def labelled_urls(skip: int = 0) -> list[tuple[str, int]]:
    """Urls with their labels, 1 for unwanted: three of each unwanted word and two of each ordinary one, of which there are twice as many.

    What stands beside a word and round it changes from url to url; those of another skip are urls that a table of skip 0 holds out.
    """
    rows = []
    for words, label, each in ((UNWANTED, 1, 3), (ORDINARY, 0, 2)):
        for i, word in enumerate(words):
            for k in range(skip, skip + each):
                other = BESIDE[(i + 3 * k) % len(BESIDE)]
                name = f"{other}-{word}" if (i + k) % 2 else f"{word}-{other}"
                before, after = FRAMES[(i + k) % len(FRAMES)]
                rows.append((before + name + after, label))
    return rows


@dataclass(frozen=True)
class Rule:
    """A rule fits its host and all subdomains where the url's path starts with the rule's."""

    verdict: str
    host: str
    path: str

    @property
    def text(self) -> str:
        return self.host + self.path


#: The rules of the production query.
RULES = (Rule("block", "net", "/"), Rule("allow", "example.net", "/en/"), Rule("block", "example.com", "/de/"), Rule("allow", "org", "/fr/"))


def parts(url: Column) -> tuple[Column, Column]:
    """Host (A-Z lower-cased) and path of a url; both empty if it is null or has no `://`."""
    at = F.locate("://", url)
    rest = F.when(at > 0, F.substr(url, at + 3)).otherwise(F.lit(""))
    rest = F.coalesce(rest, F.lit(""))
    host = F.regexp_extract(rest, r"^[^/?#]*", 0)
    path = F.regexp_extract(F.substr(rest, F.length(host) + 1), r"^[^?#]*", 0)
    return F.translate(host, UPPER, LOWER), path


def grams(host: Column, path: Column) -> Column:
    """Hashed character n-grams of both parts as an array of buckets; repeats stay."""
    out = []
    for salt, part in (("h", F.concat(F.lit("^"), host, F.lit("$"))), ("p", path)):
        for n in SIZES:
            starts = F.when(F.length(part) >= n, F.sequence(F.lit(1), F.length(part) - (n - 1))).otherwise(F.array().cast("array<int>"))
            out.append(F.transform(starts, lambda i: F.pmod(F.xxhash64(F.lit(salt), F.substr(part, i, F.lit(n))), F.lit(DIMENSIONS)).cast("int")))  # noqa: B023
    return F.concat(*out)


def train(labelled: DataFrame, *, steps: int = 400, rate: float = 25.0, ridge: float = 1e-5) -> list[float]:
    """Weights of the DIMENSIONS buckets, and last the bias, from (url, label). Rows without url or label are left out."""
    rows = labelled.where("url is not null and label is not null").select("url", F.col("label").cast("double").alias("label")).groupBy("url").agg(F.max("label").alias("label"))
    if rows.limit(MOST_LABELLED + 1).count() > MOST_LABELLED:
        raise ValueError(f"more than {MOST_LABELLED} labelled urls: sample them first")
    host, path = parts(F.col("url"))
    numbered = rows.select("url", "label", grams(host, path).alias("g"))
    counted = numbered.select("url", "label", F.size("g").alias("n"), F.explode("g").alias("bucket")).groupBy("url", "label", "bucket").agg((F.count(F.lit(1)) / F.sqrt(F.first("n"))).alias("x"))
    counted = stored(counted)
    a, b = counted.alias("a"), counted.alias("b")
    inner = a.join(b, "bucket").groupBy(F.col("a.url").alias("u"), F.col("b.url").alias("v")).agg(F.sum(F.col("a.x") * F.col("b.x")).alias("k"))  # at most MOST_LABELLED squared
    urls = counted.select("url", "label").distinct()
    full = urls.select(F.col("url").alias("u"), "label").join(inner, "u", "left")
    near = full.groupBy("u", "label").agg(F.map_from_entries(F.collect_list(F.when(F.col("v").isNotNull(), F.struct("v", "k")))).alias("m"))
    table = near.groupBy().agg(F.sort_array(F.collect_list(F.struct("u", "label", F.map_entries("m").alias("e")))).alias("t"))
    order = F.transform("t", lambda x: x["u"])
    rowsof = F.transform("t", lambda x: F.transform(order, lambda v: F.coalesce(F.element_at(F.map_from_entries(x["e"]), v), F.lit(0.0)) + 1.0))  # + 1: the bias is a feature of value 1
    ready = stored(table.select(order.alias("u"), F.transform("t", lambda x: x["label"]).alias("y"), rowsof.alias("k")))
    count = F.size("u")
    step = lambda alpha, _: F.zip_with(
        alpha,
        F.zip_with("y", "k", lambda y, k: y - F.lit(1.0) / (1.0 + F.exp(-F.aggregate(F.zip_with(k, alpha, lambda p, q: p * q), F.lit(0.0), lambda s, v: s + v)))),
        lambda al, err: al * (1.0 - rate * ridge) + err * rate / count,
    )
    dual = ready.select("u", F.aggregate(F.sequence(F.lit(1), F.lit(steps)), F.transform("u", lambda _: F.lit(0.0)), step).alias("alpha"))
    alpha = dual.select(F.inline(F.arrays_zip(F.col("u").alias("url"), F.col("alpha").alias("alpha")))).toDF("url", "alpha")
    weights = counted.join(alpha, "url").groupBy("bucket").agg(F.sum(F.col("x") * F.col("alpha")).alias("w"))
    out = [0.0] * (DIMENSIONS + 1)
    for bucket, w in weights.collect():  # at most DIMENSIONS rows
        out[bucket] = w
    out[DIMENSIONS] = alpha.agg(F.sum("alpha")).first()[0] or 0.0
    return out


def rule_of(host: Column, path: Column, rules: tuple[Rule, ...]) -> Column:
    """The longest fitting rule as a struct (verdict, rule), or null: a chain of conditions for a short list."""
    if len(rules) > MOST_INLINE_RULES:
        raise ValueError("too many rules for a chain of conditions: use with_rules")
    none = F.lit(None).cast("struct<verdict:string,rule:string>")
    out = none
    for r in sorted(rules, key=lambda r: (len(r.text), r.verdict == "block", r.text)):
        fits = ((host == r.host) | host.endswith("." + r.host)) & path.startswith(r.path)
        out = F.when(fits, F.struct(F.lit(r.verdict).alias("verdict"), F.lit(r.text).alias("rule"))).otherwise(out)
    return out


def with_rules(pages: DataFrame, rules: DataFrame, key: str) -> DataFrame:
    """For rule tables of any size (verdict, host, path): adds rule, a struct as in rule_of. pages: key (unique), host, path.

    Each page meets the rules of its own host and its parent domains by an equi-join.
    """
    labels = F.split("host", r"\.")
    suffixes = F.transform(F.sequence(F.lit(1), F.size(labels)), lambda i: F.array_join(F.slice(labels, i, F.size(labels) - i + 1), "."))
    r = rules.select("verdict", F.col("host").alias("_h"), F.col("path").alias("_p"))
    met = pages.select(key, "path", F.explode(F.array_distinct(suffixes)).alias("_s")).join(r, F.col("_s") == F.col("_h")).where(F.col("path").startswith(F.col("_p")))
    rule = F.concat("_h", "_p")
    best = met.groupBy(key).agg(F.max_by(F.struct("verdict", rule.alias("rule")), F.struct(F.length(rule), (F.col("verdict") == "block"), rule)).alias("rule"))
    return pages.join(best, key, "left")


def judge(pages: DataFrame, weights: list[float], rules: tuple[Rule, ...] = RULES, threshold: float = 0.6) -> DataFrame:
    """page_id, url's host and path, rule, verdict and score (the model's probability of block)."""
    lean = pages.select(F.col("page_id").cast("long").alias("page_id"), F.col("url").cast("string").alias("url"))
    host, path = parts(F.col("url"))
    w = F.from_json(F.lit("[" + ",".join(repr(float(x)) for x in weights[:DIMENSIONS]) + "]"), "array<double>")
    rows = lean.select("page_id", host.alias("host"), path.alias("path")).select("page_id", "host", "path", grams(F.col("host"), F.col("path")).alias("_g"))
    margin = F.aggregate("_g", F.lit(0.0), lambda s, i: s + F.get(w, i)) / F.sqrt(F.greatest(F.lit(1), F.size("_g"))) + F.lit(weights[DIMENSIONS])
    rows = rows.withColumn("score", F.lit(1.0) / (1.0 + F.exp(-margin))).withColumn("_rule", rule_of(F.col("host"), F.col("path"), rules))
    unknown = (F.col("host") == "") & (F.col("path") == "")
    own = F.when(~unknown & (F.col("score") >= threshold), F.lit("block")).otherwise(F.lit("allow"))
    return rows.select("page_id", "host", "path", F.col("_rule")["rule"].alias("rule"), F.coalesce(F.col("_rule")["verdict"], own).alias("verdict"), "score")


def labelled_table(spark: SparkSession) -> DataFrame:
    values = ", ".join(f"('{u}', {y})" for u, y in labelled_urls())
    return spark.sql(f"SELECT * FROM VALUES {values} AS t(url, label)")
