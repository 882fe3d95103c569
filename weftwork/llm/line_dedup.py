"""Line dedup by a log-template tree of fixed depth.

A line goes to the leaf of its number of tokens and its first DEPTH tokens; tokens with a digit are masked from the
start. In a leaf, a token that stands at its position in at least MIN_DOCS distinct lines is constant, any other is variable. Lines
that agree in their constants and in where they vary are a template, if at least SIMILAR of the tokens are constant; so a
leaf has as many templates as it has families of lines, and no family is lost among others, however many. Any other line
carries itself. Templates that do not recur are generalised once more: those that are
alike but for one further position, or of which one then equals a template that recurs, are one, again if SIMILAR
of the tokens are left constant; that finds families whose fields have few values, each of them frequent.

A template that recurs in at least MIN_DOCS different texts is dropped everywhere but in
the text of the smallest doc_id that has it (keep_first=False drops it there too).

Copies of one text count as one, so a repeated document keeps its lines; other operators
remove it. Lines of leaves that do not recur are never looked at again: that is exact, as a
template lies in one leaf. Only hashes are shuffled, those of lines first and then of tokens; no step gathers a leaf.

Nulls: a null text stays null. Empty texts and blank lines stay. A null doc_id comes after all others.
Repeated rows are treated alike. Ties of the smallest doc_id go to the smaller text hash; of positions at which a line may be
generalised, the one shared by most texts wins, then the smaller hash. Long texts are taken whole; a line of any length costs its tokens. Other
columns come back as they are, whatever their names. An empty table gives an empty result. DataFrame functions only.
"""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from weftwork.llm.common import WORD, WORD_GAP, clear_of, dropped, kept_from, measured, scratch, stored

DEPTH, SIMILAR, MIN_DOCS = 3, 0.7, 5
VARIABLE = "<*>"
#: Leaves or lines that may be broadcast, each of 16 bytes; more are joined by a shuffle.
MOST_BROADCAST = 200_000
_VARIED = r"(?<![^\x20\x09-\x0D])[^\x20\x09-\x0D0-9]*[0-9][^\x20\x09-\x0D]*"


def _masked(text: str):
    """The text with <*> for tokens that hold a digit; texts without one are not scanned by the pattern."""
    return F.when(F.col(text).rlike("[0-9]"), F.regexp_replace(text, _VARIED, VARIABLE)).otherwise(F.col(text))


def _lines(docs: DataFrame) -> DataFrame:
    """Distinct masked lines of each text: doc_id, h1, h2 (of the text), line, mark (of the line)."""
    lines = docs.select(
        F.col("doc_id").cast("long").alias("doc_id"), F.xxhash64("text").alias("h1"), F.xxhash64(F.lit(1), "text").alias("h2"), F.explode(F.array_distinct(F.split(_masked("text"), "\n"))).alias("line")
    )
    return lines.withColumn("mark", F.xxhash64("line"))


def _leaf(depth: int):
    lead = F.regexp_replace(F.regexp_extract("line", rf"^{WORD_GAP.replace('+', '*')}((?:{WORD}{WORD_GAP}){{0,{depth - 1}}}{WORD})", 1), WORD_GAP, " ")
    return F.xxhash64(F.regexp_count("line", F.lit(WORD)), lead)


def _few(df: DataFrame, n: int) -> DataFrame:
    """df, whose n rows of three numbers at most were counted, with a broadcast hint if they are few enough."""
    return F.broadcast(df) if n <= MOST_BROADCAST else df


def _tokens(line: str):
    return F.filter(F.split(F.col(line), WORD_GAP), lambda t: t != "")


def _shapes(each: DataFrame, depth: int, similar: float, least: int) -> tuple[DataFrame, DataFrame]:
    """(tokens, shapes) of distinct lines (leaf, mark, line): tokens: leaf, mark, pos, token (its hash with leaf and position)
    beyond the first `depth`; shapes: leaf, mark, n (tokens), fixed (constants), holes (variable positions), sum (xor of
    the positions' hashes) and template."""
    split = each.select("leaf", "mark", F.posexplode(_tokens("line")).alias("pos", "t"))
    tokens = stored(split.where(F.col("pos") >= depth).select("leaf", "mark", "pos", F.xxhash64("leaf", "pos", "t").alias("token")))
    common, m = measured(tokens.groupBy("token").agg(F.count(F.lit(1)).alias("c")).where(F.col("c") >= least).select("token", F.lit(True).alias("common")))
    known = tokens.join(_few(common, m["n"]), "token", "left").withColumn("common", F.coalesce("common", F.lit(False)))
    lines = known.groupBy("leaf", "mark").agg(
        F.count(F.lit(1)).alias("n"), F.count_if("common").alias("fixed"), F.bit_xor(F.when(F.col("common"), F.col("token")).otherwise(_hole())).alias("sum"),
        F.bit_xor("token").alias("own"), F.collect_list(F.when(~F.col("common"), F.col("pos"))).alias("holes"),
    )
    fits = F.col("fixed") + depth >= F.lit(similar) * (F.col("n") + depth)
    none = F.array().cast("array<int>")
    shaped = lines.select(
        "leaf", "mark", "n", F.when(fits, F.col("fixed")).otherwise(F.col("n")).alias("fixed"), F.when(fits, F.col("sum")).otherwise(F.col("own")).alias("sum"),
        F.when(fits, F.col("holes")).otherwise(none).alias("holes"),
    )
    short = each.join(lines.select("leaf", "mark"), ["leaf", "mark"], "left_anti")  # no more tokens than the tree is deep
    short = short.select("leaf", "mark", F.lit(0).cast("long").alias("n"), F.lit(0).cast("long").alias("fixed"), F.lit(0).cast("long").alias("sum"), none.alias("holes"))
    return tokens, shaped.unionByName(short).withColumn("template", F.xxhash64("leaf", "sum"))


def _hole(pos: str = "pos"):
    return F.xxhash64(F.lit(VARIABLE), pos)


def _generalised(tokens: DataFrame, shapes: DataFrame, marked: DataFrame, recurring: DataFrame, depth: int, similar: float, least: int) -> DataFrame:
    """leaf, mark, key, hole, target of lines whose template does not recur but is alike to others', or to one that recurs, but for one position.

    marked: leaf, mark, h1, template; recurring: template. target: the template that recurs, if one is alike.
    """
    flagged = shapes.join(recurring.withColumn("found", F.lit(True)), "template", "left").withColumn("found", F.coalesce("found", F.lit(False)))
    # One line stands for a template that recurs.
    spoken = flagged.where("found").groupBy("template").agg(F.min_by(F.struct("leaf", "mark", "n", "fixed", "sum", "holes"), F.struct("leaf", "mark")).alias("s"))
    seek = flagged.where("not found").select("leaf", "mark", "n", "fixed", "sum", "holes", "template", "found")
    seek = seek.unionByName(spoken.select("s.*", "template", F.lit(True).alias("found")))
    seek = seek.where(F.col("fixed") - 1 + depth >= F.lit(similar) * (F.col("n") + depth))
    open_tokens = tokens.join(seek, ["leaf", "mark"]).where(~F.array_contains("holes", F.col("pos")))
    key = F.xxhash64("leaf", F.col("sum").bitwiseXOR(F.col("token")).bitwiseXOR(_hole()))
    keys = stored(open_tokens.select("leaf", "mark", "template", "found", "pos", key.alias("key")))
    # Only keys that two templates share can help; most have one.
    summed = keys.groupBy("key").agg(F.min("template").alias("a"), F.max("template").alias("b"), F.min(F.when(F.col("found"), F.col("template"))).alias("target")).where("a != b")
    shared, m = measured(summed.select("key", "target"))
    kept = stored(keys.where("not found").join(_few(shared, m["n"]), "key").select("leaf", "mark", "pos", "key", "target"))
    texts = kept.join(marked.select("leaf", "mark", "h1"), ["leaf", "mark"]).groupBy("key").agg(F.count_distinct("h1").alias("n"))
    strong, m = measured(texts.where(F.col("n") >= least))
    met = kept.join(_few(strong, m["n"]), "key", "left").where("target is not null or n is not null")
    best = F.struct(F.col("target").isNotNull().alias("t"), F.coalesce("n", F.lit(0)).alias("n"), "key", "target", "pos")
    return met.groupBy("leaf", "mark").agg(F.max(best).alias("b")).select("leaf", "mark", F.col("b.key").alias("key"), F.col("b.pos").alias("hole"), F.col("b.target").alias("target"))


def templates(docs: DataFrame, *, depth: int = DEPTH, similar: float = SIMILAR, min_docs: int = MIN_DOCS) -> tuple[DataFrame, DataFrame, DataFrame]:
    """(lines, recurring, shapes). lines: doc_id, h1, h2, mark, template of every line in a recurring leaf;
    recurring: template, n_docs, first (h1 of the first text); shapes: template, shape (as text) of those that recur."""
    with scratch(docs.sparkSession) as paths:
        texts = _lines(docs)
        hashes = stored(texts.where(F.col("line").rlike(WORD)).select("doc_id", "h1", "h2", "mark", _leaf(depth).alias("leaf")))
        busy, m = measured(hashes.select("leaf", "h1").distinct().groupBy("leaf").agg(F.count(F.lit(1)).alias("_n")).where(F.col("_n") >= min_docs).select("leaf"))
        rows = stored(hashes.join(_few(busy, m["n"]), "leaf"))
        dropped(hashes)
        marks, m = measured(rows.select("leaf", "mark").distinct())
        each = stored(texts.select("line", "mark").join(_few(marks, m["n"]), "mark").groupBy("leaf", "mark").agg(F.min("line").alias("line")))
        tokens, shapes = _shapes(each, depth, similar, min_docs)
        shapes, m = measured(shapes)
        marked = stored(rows.join(_few(shapes.select("leaf", "mark", "template"), m["n"]), ["leaf", "mark"]))
        once = marked.select("template", "h1").distinct().groupBy("template").agg(F.count(F.lit(1)).alias("n"))
        found, _ = measured(once.where(F.col("n") >= min_docs).select("template"))
        more, n = measured(_generalised(tokens, shapes, marked, found, depth, similar, min_docs))
        moved = more.select("leaf", "mark", F.coalesce("target", F.xxhash64(F.lit("hole"), "key")).alias("_t"))
        marked = stored(marked.join(_few(moved, n["n"]), ["leaf", "mark"], "left").withColumn("template", F.coalesce("_t", "template")).drop("_t"))
        widened = more.where("target is null").select(F.xxhash64(F.lit("hole"), "key").alias("template")).distinct().withColumn("widened", F.lit(True))
        order = F.struct(F.col("doc_id").isNull().alias("none"), "doc_id", "h1")
        counted = marked.groupBy("template", "h1").agg(F.min(order).alias("o"), F.min(F.struct("leaf", "mark")).alias("line"))
        counted = counted.groupBy("template").agg(F.count(F.lit(1)).alias("n_docs"), F.min_by("h1", "o").alias("first"), F.min("line").alias("line"))
        recurring = stored(counted.join(widened, "template", "left").where((F.col("n_docs") >= min_docs) | F.col("widened")).drop("widened"))
        own = recurring.select("template", "line.*").join(each, ["leaf", "mark"]).join(shapes.select("leaf", "mark", "holes"), ["leaf", "mark"])
        own = own.join(more.select("leaf", "mark", "hole"), ["leaf", "mark"], "left")
        holes = F.concat("holes", F.when(F.col("hole").isNull(), F.array().cast("array<int>")).otherwise(F.array("hole")))
        shape = F.array_join(F.transform(_tokens("line"), lambda t, i: F.when(F.array_contains(holes, i), F.lit(VARIABLE)).otherwise(t)), " ")
        texts_of = stored(own.select("template", shape.alias("shape")))
        for table in (marked, recurring, texts_of):
            kept_from(paths, table)
    return marked.select("doc_id", "h1", "h2", "mark", "template"), recurring.select("template", "n_docs", "first"), texts_of


def dedup(docs: DataFrame, *, keep_first: bool = True, depth: int = DEPTH, similar: float = SIMILAR, min_docs: int = MIN_DOCS, counts: bool = False) -> DataFrame:
    """docs with the recurring lines taken out of text; counts adds n_lines and n_dropped (with underscores where docs has such names)."""
    marked, recurring, _ = templates(docs, depth=depth, similar=similar, min_docs=min_docs)
    hit = marked.join(recurring.select("template", "first"), "template")
    if keep_first:
        hit = hit.where(F.col("h1") != F.col("first"))
    a, b, marks = (clear_of(docs, c) for c in ("_h1", "_h2", "_marks"))
    drops = hit.groupBy(F.col("h1").alias(a), F.col("h2").alias(b)).agg(F.collect_set("mark").alias(marks))  # lines of one text
    keyed = docs.withColumn(a, F.xxhash64("text")).withColumn(b, F.xxhash64(F.lit(1), "text"))
    both = keyed.join(stored(drops), [a, b], "left")
    pairs = F.arrays_zip(F.split("text", "\n").alias("raw"), F.split(_masked("text"), "\n").alias("line"))
    kept = F.filter(pairs, lambda p: ~F.array_contains(F.col(marks), F.xxhash64(p["line"])))
    text = F.when(F.col(marks).isNull(), F.col("text")).otherwise(F.array_join(F.transform(kept, lambda p: p["raw"]), "\n"))
    columns = [text.alias(c) if c == "text" else F.col(f"`{c}`") for c in docs.columns]
    if counts:
        n = F.size(F.split("text", "\n"))
        columns.append(F.when(F.col("text").isNull(), 0).otherwise(n).alias(clear_of(docs, "n_lines")))
        columns.append(F.when(F.col(marks).isNull(), 0).otherwise(n - F.size(kept)).alias(clear_of(docs, "n_dropped")))
    return both.select(*columns)
