"""Cases in which an operator once did less than its whole job."""

import corpus_pipeline
from weftwork.llm import minhash, mixing, queries


def test_short_near_copies_survive_the_bound_of_bits(spark):
    """Two texts of 4 and 5 shingles, 4 of them common, that meet only in buckets whose pivot is like neither."""
    base = [f"wad{c}" for c in "abcdefg"]
    texts = [" ".join(base), " ".join([*base, "end"])]
    texts += [" ".join([*base, "x" + "".join("abcdefghij"[int(c)] for c in str(1000 + i)), "y"]) for i in range(600)]
    out = {r.doc_id: (r.component_id, r.n_links) for r in minhash.groups(spark.createDataFrame(list(enumerate(texts)), "doc_id long, text string")).collect()}
    assert out[0] == out[1] == (0, 1)
    assert all(out[i] == (i, 0) for i in range(2, len(texts)))


def test_source_mix_deals_its_copies_to_shards(spark, sf):
    """The query's rows add up from copies that have a shard and a place, the same ones that mix() writes."""
    docs = queries.read(spark, sf, "documents")
    rows = queries.op10_source_mixing(spark, sf).collect()
    planned = {r.doc_id: (r.size, r.taken, r.copies, r.extra) for r in mixing.plan(docs)[0].collect()}
    assert {r.doc_id: (r.size, r.taken, r.copies, r.extra) for r in rows} == planned and len(rows) == docs.count()
    dealt = sorted((r.doc_id, t.shard, t.place) for r in rows for t in r.takes)
    mixed = mixing.mix(docs).select("doc_id", "shard", "place").collect()
    assert dealt == sorted(tuple(r) for r in mixed) and {s for _, s, _ in dealt} == set(range(16))


def test_source_mix_of_the_pipeline_stands_in_order(spark, sf, tmp_path):
    docs = queries.read(spark, sf, "documents")
    places = [(r.shard, r.place) for r in mixing.mix(docs, ordered=True).collect()]
    assert places == sorted(places)
    order = [r.doc_id for r in mixing.mix(docs, ordered=True).collect()]
    assert [r.doc_id for r in corpus_pipeline.source_mix(spark, docs, sf).collect()] == order


def test_source_mix_of_repeated_rows(spark):
    rows = [(1, "a b c", "x"), (1, "a b c", "x"), (None, "d e", None), (2, None, "y"), (3, "f g h i", "y"), (3, "f g h i", "y")]
    docs = spark.createDataFrame(rows, "doc_id long, text string, source string")
    out = mixing.shares(docs, shards=3)
    key = ["doc_id", "size", "source_size", "target", "taken", "copies", "extra"]
    by = lambda df: sorted(map(repr, df.select(*key).collect()))
    assert by(out) == by(mixing.plan(docs)[0])


def test_source_mix_of_a_source_of_many_blocks(spark, monkeypatch):
    """Over 2,048 blocks of one source (a million documents at the usual block): keys times blocks pass 63 bits."""
    monkeypatch.setattr(mixing, "BLOCK_DOCUMENTS", 1)
    n = 4000
    docs = spark.range(n + 500).selectExpr("id AS doc_id", "concat('a b c d', repeat(' e', int(id % 7))) AS text", f"if(id < {n}, 'big', 'small') AS source")
    rows = mixing.plan(docs)[0].collect()
    big = [r for r in rows if r.source == "big"]
    assert len(rows) == n + 500 and all(r.block == r._key * n >> mixing.KEY_BITS for r in big) and max(r.block for r in big) > 3900
    assert all(0 <= r.taken <= 3 * r.size for r in rows)
    for source in ("big", "small"):
        own = [r for r in rows if r.source == source]
        assert sum(r.taken for r in own) == round(own[0].target)
    mixed = corpus_pipeline.source_mix(spark, docs, "")
    assert mixed.select(mixing.n_words().alias("n")).groupBy().sum("n").first()[0] == sum(r.taken for r in rows)
