"""The ten operators against brute force, and on the odd rows that each must bear."""

import hashlib
import random
import zlib

import numpy as np
import public_tokenizers
import pytest
from pyspark.sql import functions as F

from weftwork.llm import chat, fingerprint, groups, line_dedup, minhash, mixing, packing, quality, queries, substring, tokens, topk, url_filter

DOC = "doc_id long, text string, lang string, source string, n_chars long"
LONG = " ".join(f"w{i % 97}x{i}" for i in range(3000))
ODD = [(1, None, None, None, None), (2, "", "en", "a", 0), (3, "one two", "en", "a", 7), (3, "one two", "en", "a", 7), (None, "no id here at all", "en", None, 3), (4, LONG, "en", "b", 1), (5, LONG, "en", "b", 1), (6, "x\x1cy\u00a0z  tab\tend\n\n", "de", "b", 2)]


@pytest.fixture(scope="module")
def odd(spark):
    """Nulls, empty and long texts, repeated rows, and further columns whose names the operators use inside."""
    rows = spark.createDataFrame(ODD, DOC)
    return rows.select("*", F.lit(1).alias("node"), F.lit(2).alias("mark"), F.lit("x").alias("_own"), F.lit(3).alias("shard"))


@pytest.fixture(scope="module")
def docs(spark, sf):
    return queries.read(spark, sf, "documents")


def words(text):
    return (text or "").encode().split()


def link_classes(texts, k):
    low = bytes(b + 32 if 65 <= b <= 90 else b for b in range(256))
    sets = {}
    for d, t in texts.items():
        w = (t or "").encode().translate(low).split()
        sets[d] = {tuple(w[i : i + k]) for i in range(len(w) - k + 1)} or ({tuple(w)} if w else set())
    parent = {d: d for d in sets}

    def top(x):
        while parent[x] != x:
            x = parent[x]
        return x

    ids = sorted(sets)
    for i, a in enumerate(ids):
        for b in ids[:i]:
            both = len(sets[a] & sets[b])
            if both and 100 * both >= 80 * (len(sets[a]) + len(sets[b]) - both):
                x, y = sorted((top(a), top(b)))
                parent[y] = x
    return {d: (len(sets[d]), top(d)) for d in sets}


def test_near_dedup_equals_brute_force(docs):
    texts = {r.doc_id: r.text for r in docs.collect()}
    want = link_classes(texts, 4)
    got = {r.doc_id: (r.n_shingles, r.component_id) for r in minhash.groups(docs).collect()}
    assert got == want


def test_near_dedup_of_one_large_group(spark):
    """Copies and near copies of one text: all linked, and links only grow with the group."""
    rng = random.Random(1)
    base = [f"word{i}" for i in range(200)]
    rows = []
    for d in range(60):
        w = list(base)
        if d % 3:
            w[rng.randrange(200)] = f"other{d}"
        rows.append((d, " ".join(w)))
    rows += [(100 + d, " ".join(f"q{d}z{i}" for i in range(30))) for d in range(5)]
    out = {r.doc_id: r.component_id for r in minhash.groups(spark.createDataFrame(rows, "doc_id long, text string")).collect()}
    assert {out[d] for d in range(60)} == {0} and all(out[100 + d] == 100 + d for d in range(5))


def test_near_dedup_bears_odd_rows(odd):
    rows = minhash.groups(odd).collect()
    assert len(rows) == len(ODD)
    by = {r.doc_id: r for r in rows}
    assert by[1].n_shingles == by[2].n_shingles == 0 and by[1].kept and by[5].component_id == 4 and not by[5].kept and by[None].kept
    assert minhash.groups(odd.limit(0)).count() == 0


def test_linked_needs_no_star(spark):
    """A bucket in which only pairs without its smallest node hold: the second round finds them."""
    members = spark.createDataFrame([(1, n) for n in range(12)], "bucket long, node long")
    verify = lambda pairs: pairs.where("u > 0 and abs(u - v) = 1")
    _, roots = groups.linked(groups.shared_members(members), verify)
    assert {r.node: r.root for r in roots.collect()} == {n: 1 for n in range(1, 12)}


def test_sketches_bound_the_difference():
    """Over sets of all classes: sketches of one class never differ in more bits than the sets do in shingles."""
    rng = np.random.default_rng(5)
    for n in (1, 5, 120, 128, 129, 300, 2000):
        x = np.unique(rng.integers(0, 2**63, n, dtype=np.uint64))
        y = np.union1d(x[: max(1, int(n * 0.9))], rng.integers(0, 2**63, n // 8 + 1, dtype=np.uint64))
        c = max(minhash.sketch_class(len(x)), minhash.sketch_class(len(y)))
        a, b = (np.unpackbits(minhash.sketch(s, c).view(np.uint8)) for s in (x, y))
        differ = len(np.setxor1d(x, y))
        assert (a != b).sum() <= differ and (a != b).sum() >= 0.8 * differ
        assert (a != b).sum() % 2 == differ % 2


def test_substring_dedup_equals_brute_force(docs):
    rows = sorted(docs.collect(), key=lambda r: r.doc_id)
    want = dict(zip([r.doc_id for r in rows], substring.brute_force([r.text or "" for r in rows]), strict=True))
    got = {r.doc_id: (r.n_words, r.n_removed, r.kept_sha256) for r in queries.substring.digest(substring.dedup(docs)).collect()}
    assert got == want


def test_substring_dedup_of_planted_passages(spark):
    rng = random.Random(5)
    new = lambda n: [f"t{rng.randrange(10**9)}" for _ in range(n)]
    p, q = new(60), new(34)
    a, b, c = new(20) + p + new(20), p[:50] + new(9) + p[10:], new(5) + q + new(5)
    d, e, loop = q + new(3), p[5:40] + p[20:60], ["z"] * 50
    texts = [" ".join(x) for x in (a, b, c, d, e, loop)]
    frame = spark.createDataFrame([*enumerate(texts), (9, None), (10, "")], "doc_id long, text string")
    got = {r.doc_id: (r.n_words, r.n_removed, r.kept_sha256) for r in substring.digest(substring.dedup(frame)).collect()}
    assert [got[i] for i in range(6)] == substring.brute_force(texts)
    assert got[3][1] == 0 and got[9] == got[10] == (0, 0, hashlib.sha256(b"").hexdigest())


def test_factors_are_copies_of_their_references(docs):
    """Every factor's words stand at its place in the reference, none can go on, and factors do not overlap."""
    texts = {r.doc_id: words(r.text) for r in docs.collect()}
    long = 0
    for r in substring.dedup(docs).collect():
        at = 0
        for f in r.factors:
            assert at <= f.start < f.end
            own, ref = texts[r.doc_id], texts[f.ref_doc_id]
            n = f.end - f.start
            assert own[f.start : f.end] == ref[f.ref_start : f.ref_start + n]
            long += n > substring.WINDOW * 2
            at = f.end
    assert long > 10


def test_parse_is_greedy():
    matches = [(0, 40, 1, 100), (30, 80, 1, 130), (20, 70, 2, 0), (200, 240, 3, 5)]
    assert substring.parse(matches) == [(0, 80, 1, 100), (200, 240, 3, 5)]
    assert substring.parse([(0, 40, 1, 0), (10, 60, 2, 0), (20, 61, 3, 0), (59, 100, 4, 0)]) == [(0, 40, 1, 0), (40, 61, 3, 20), (61, 100, 4, 2)]
    assert substring.parse([]) == []


def test_substring_dedup_bears_odd_rows(odd):
    got = substring.dedup(odd).collect()
    assert len(got) == len(ODD) and sum(r.n_removed == 3000 for r in got) == 2
    twice = odd.where("doc_id = 4").unionByName(odd.where("doc_id = 4"))
    assert [r.n_removed for r in substring.dedup(twice).collect()] == [3000, 3000]
    assert substring.dedup(odd.limit(0)).count() == 0


def test_packing_round_trip(docs):
    path = public_tokenizers.path("byte_bpe_50k.json")
    from tokenizers import Tokenizer

    own = Tokenizer.from_file(path)
    rows = packing.pack(docs, path, with_ids=True).collect()
    by, seqs = {}, {}
    for r in rows:
        by.setdefault(r.doc_id, []).append(r)
        seqs.setdefault(r.sequence_id, []).append((r.offset, r.length))
    for d in docs.collect():
        ids = np.array(own.encode(d.text or "", add_special_tokens=False).ids + [2], "<u4").tobytes()
        parts = sorted(by[d.doc_id], key=lambda r: r.piece)
        assert b"".join(bytes(p.ids) for p in parts) == ids and [p.start for p in parts] == list(np.cumsum([0] + [p.length for p in parts[:-1]]))
        assert all(zlib.crc32(bytes(p.ids)) == p.ids_crc32 for p in parts) and all(p.length == 1024 for p in parts[1:])
    for parts in seqs.values():
        at = 0
        for offset, length in sorted(parts):
            assert offset == at
            at += length
        assert at <= 1024
    assert len(seqs) <= -(-sum(r.length for r in rows) // 1024) * 1.02 + 1


def test_packing_counts_equal_packing_documents():
    rng = random.Random(2)
    for _ in range(20):
        room = 50
        lengths = [rng.randint(1, room) for _ in range(200)]
        bins = []
        for n in sorted(lengths, reverse=True):  # best-fit decreasing, one document at a time
            fit = min((b for b in range(len(bins)) if bins[b] >= n), key=lambda b: bins[b], default=None)
            if fit is None:
                bins.append(room - n)
            else:
                bins[fit] -= n
        counts = {n: lengths.count(n) for n in set(lengths)}
        rows = sorted(packing.plan(counts, room))
        until = [b[1] if b[0] == a[0] else counts[a[0]] for a, b in zip(rows, [*rows[1:], (0,)], strict=True)]
        held = {}
        for (length, rank, first, each, _), end in zip(rows, until, strict=True):
            for i in range(end - rank):
                held.setdefault(first + i // each, []).append(length)
        assert set(held) == set(range(len(bins))) and max(map(sum, held.values())) <= room
        assert sorted(n for b in held.values() for n in b) == sorted(lengths)


def test_packing_bears_odd_rows(odd):
    rows = packing.pack(odd, public_tokenizers.path("byte_bpe_50k.json")).collect()
    assert sum(r.piece == 0 for r in rows) == len(ODD) and [r.length for r in rows if r.doc_id in (1, 2)] == [1, 1]
    assert packing.pack(odd.limit(0), public_tokenizers.path("byte_bpe_50k.json")).count() == 0


@pytest.mark.parametrize("text", ["", " ", "a\n\nb", "a\n b", " a", "it's 12,3\t x\u00a0y  z", "<|endoftext|> a", "a\r\n\r\nb", "Ünï \u3000 ç\x1c d", "end\n"])
def test_tokens_equal_the_library(text):
    from tokenizers import Tokenizer

    path = public_tokenizers.path("byte_bpe_50k.json")
    want = Tokenizer.from_file(path).encode(text, add_special_tokens=False).ids
    assert np.frombuffer(tokens.encoder(path).encode(text), "<u4").tolist() == want


def test_fingerprints(docs):
    rows = {r.doc_id: r for r in fingerprint.compare(docs).collect()}
    own = sorted(docs.collect(), key=lambda r: -r.doc_id)
    assert len(rows) == len(own)
    for i, d in enumerate(own):
        n, after = len(d.text), own[(i + 1) % len(own)].text
        edited = d.text[: n - n // 2] + after[: n // 2]
        r = rows[d.doc_id]
        assert r.n_chars == n and r.edited_sha256 == hashlib.sha256(edited.encode()).hexdigest()
        if i % 10 == 0:
            a, b, c = fingerprint.fingerprints([d.text, edited, after])
            assert (r.fingerprint, r.edited_fingerprint) == (a.hex(), b.hex()) and r.near_edited == fingerprint.likeness(a, b) and r.near_next == fingerprint.likeness(a, c)
    assert np.median([r.near_edited for r in rows.values()]) > 0.3 > np.median([r.near_next for r in rows.values()])
    # Groups: the components of all pairs alike, by brute force.
    prints = {d: np.frombuffer(bytes.fromhex(r.fingerprint), np.uint8) for d, r in rows.items()}
    top = {d: d for d in prints}
    find = lambda d: d if top[d] == d else find(top[d])
    for d in sorted(prints):
        for e in sorted(prints):
            if e < d and ((prints[d] == prints[e]).all() or (prints[d].any() and (prints[d] == prints[e]).mean() >= 0.8)):
                x, y = sorted((find(d), find(e)))
                top[y] = x
    assert {d: r.group_id for d, r in rows.items()} == {d: find(d) for d in prints} and len({find(d) for d in prints}) < len(prints)
    a, b = ([bytearray.fromhex(rows[d].fingerprint) for d in sorted(rows)[i::7][:20]] for i in (0, 1))
    frame = docs.sparkSession.createDataFrame([(x, y) for x in a for y in b], "a binary, b binary")
    for r in frame.select("a", "b", fingerprint._equal_bytes(fingerprint._longs("a"), fingerprint._longs("b")).alias("n")).collect():
        assert r.n == sum(x == y for x, y in zip(r.a, r.b, strict=True))


def test_fingerprints_bear_odd_rows(spark, odd):
    rows = fingerprint.compare(odd).collect()
    assert len(rows) == len(ODD) and {r.doc_id for r in rows} == {r[0] for r in ODD}
    assert fingerprint.compare(odd.where("doc_id is null")).collect()[0].near_next == 1.0
    assert fingerprint.compare(odd.where("doc_id = 4")).collect()[0].near_next == 1.0
    assert fingerprint.compare(odd.limit(0)).count() == 0
    small = " ".join(f"w{i}" for i in range(400))
    close = spark.createDataFrame([(1, small), (2, small), (3, small + " more"), (4, LONG)], "doc_id long, text string")
    assert {r.doc_id: r.group_id for r in fingerprint.near(close).collect()} == {1: 1, 2: 1, 3: 1, 4: 4}


def test_walk_alone_equals_walk_together():
    texts = [fingerprint.classes(t) for t in ("abc" * 50, "", "hello world", "x")] * 20
    came, steps = fingerprint.walks(texts, np.zeros(len(texts), np.int64))
    for t, c, s in zip(texts[:4], came, steps, strict=False):
        alone, last = fingerprint.walks([t], np.zeros(1, np.int64))
        assert (alone[0] == c).all() and last[0] == s


def test_quality_learns(spark):
    """Held-out accuracy, on tables with some 70 labelled rows that the training leaves out."""
    docs, labels = (queries.read(spark, "/root/testdata/sf0.01", t) for t in ("documents", "labels"))
    rows = quality.rate(docs, quality.fit(docs, labels)).collect()
    known = {r.doc_id: r.quality for r in labels.collect()}
    own = [r for r in rows if r.doc_id in known]
    assert len(rows) == docs.count() and all(r.held_out == (zlib.crc32(str(r.doc_id).encode()) % 5 == 0) and 0 <= r.score <= 1 for r in rows)
    held = [r for r in own if r.held_out]
    assert len(held) >= 50 and np.mean([r.predicted == known[r.doc_id] for r in held]) > 0.9


def test_quality_bears_odd_rows(odd, spark, sf):
    model = quality.fit(odd, queries.read(spark, sf, "labels").limit(0))
    rows = quality.rate(odd, model).collect()
    assert len(rows) == len(ODD) and {r.score for r in rows} == {0.5}
    assert quality.rate(odd.limit(0), model).count() == 0


def test_quality_score_does_not_depend_on_neighbours():
    rng = np.random.default_rng(1)
    rows = rng.normal(size=quality.BUCKETS).astype(np.float32)
    texts = [b"a b c", b"", b"c c  d", b"longer words here\nand there"]
    together = quality.scores(texts, rows, 0.1)
    assert np.allclose(together, [quality.scores([t], rows, 0.1)[0] for t in texts], atol=1e-6)


def test_top_k_equals_brute_force(spark):
    rng = np.random.default_rng(4)
    rows = [(i, [float(x) for x in rng.normal(size=6) * rng.choice([0.01, 1.0, 30.0])]) for i in range(300)]
    rows += [(300 + i, [0.5] * 6) for i in range(60)]  # one very common vector
    bad = [(1000, None), (1050, [1.0, None]), (1100, [float("nan")] * 6), (1150, [float("inf")] * 6), (None, [1.0] * 6), (1200, []), (1250, [1.0, 2.0])]
    vectors = topk.whole_vectors(spark.createDataFrame(rows + bad, "vec_id long, embedding array<float>").withColumn("id", F.lit("x")), "vec_id", "embedding")
    got = {(r.query_id, r.rank): (r.vec_id, r.score) for r in topk.search(vectors, vectors.where(topk.divisible("id", 50)), 5, bucket=40, block=3).collect()}
    whole = np.floor(256 * np.array([r[1] for r in rows], np.float32).astype(float)).astype(np.int64)
    want = {}
    for q in range(0, len(rows), 50):
        s = whole @ whole[q]
        best = [i for i in np.lexsort((np.arange(len(rows)), -s)) if i != q][:5]
        want |= {(q, r + 1): (int(i), int(s[i])) for r, i in enumerate(best)}
    assert got == want
    none = vectors.limit(0)
    assert topk.search(none, none, 5).count() == 0


def test_line_dedup(spark):
    note = lambda i, d: f"Copyright {1990 + i} by the makers of item{i}, all rights reserved"
    own = lambda d: " ".join(f"{c}{chr(97 + d)}" for c in "uvwxyz")  # noqa: E731  no token in common
    rows = [(d, f"{own(d)}\n{note(d, d)}\n\nlast {own(d)}") for d in range(8)]
    rows += [(20, rows[0][1]), (30, None), (31, ""), (32, "\n\n")]
    frame = spark.createDataFrame(rows, "doc_id long, text string").select("*", F.lit(1).alias("leaf"), F.lit(2).alias("_h1"))
    out = {r.doc_id: r for r in line_dedup.dedup(frame, counts=True).collect()}
    assert "Copyright" in out[0].text and "Copyright" in out[20].text and out[0].leaf == 1
    assert all("Copyright" not in out[d].text and out[d].n_dropped == 1 and out[d].text.startswith(own(d)) for d in range(1, 8))
    assert out[30].text is None and out[31].text == "" and out[32].text == "\n\n"
    assert all("Copyright" not in r.text for r in line_dedup.dedup(frame, keep_first=False).where("doc_id < 8").collect())
    assert line_dedup.dedup(frame.limit(0)).count() == 0


def shapes_of(spark, lines, **options):
    *_, found = line_dedup.templates(spark.createDataFrame(list(enumerate(lines)), "doc_id long, text string"), **options)
    return sorted(r["shape"] for r in found.collect())


def test_line_templates_have_variable_fields(spark):
    names = ["ann", "bob", "cid", "dan", "eve", "fay"]
    post = [f"Posted by the user {n} on our friendly board here" for n in names]
    assert shapes_of(spark, post) == ["Posted by the user <*> on our friendly board here"]
    # Two families of one leaf, each of them among ordinary lines of that leaf.
    seen = [f"Posted by the admin {n} for all those who read" for n in names]
    rng = random.Random(3)
    prose = ["Posted by the " + " ".join("".join(rng.choices("abcdefghij", k=6)) for _ in range(7)) for _ in range(300)]
    both = ["Posted by the admin <*> for all those who read", "Posted by the user <*> on our friendly board here"]
    assert shapes_of(spark, post + seen) == both and shapes_of(spark, post + seen + prose) == both
    # Two fields of few values each, no pair of which recurs.
    pairs = [f"Sent from my {a} with much {b} from far away today" for a in names for b in ("love", "joy", "care", "hope", "luck")]
    assert len(shapes_of(spark, pairs)) >= 1
    rows = spark.createDataFrame(list(enumerate(pairs)), "doc_id long, text string")
    assert line_dedup.dedup(rows, keep_first=False).where("text != ''").count() == 0
    # Variants of a line that recurs exactly join it; a line alike in too few tokens does not.
    exact = ["All rights reserved by the owner of this site"] * 6
    more = exact[:1] + [f"{e}\nown {n}" for e, n in zip(exact, names, strict=True)] + ["All rights reserved by the owner of this blog", "All rights reserved for whoever wants them so much"]
    assert shapes_of(spark, more)[0].startswith("All rights reserved by the owner of this")
    out = {r.doc_id: r.text for r in line_dedup.dedup(spark.createDataFrame(list(enumerate(more)), "doc_id long, text string")).collect()}
    assert out[0] == exact[0] and out[7] == "" and out[8] == more[8] and all(out[i + 1] == f"own {n}" for i, n in enumerate(names))


def test_line_dedup_bears_odd_rows(spark, odd):
    frame = odd.withColumn("n_lines", F.lit(1)).withColumn("a.b", F.lit(2))
    out = line_dedup.dedup(frame, counts=True)
    assert out.columns == [*frame.columns, "n_lines_", "n_dropped"]
    want = sorted(map(repr, frame.select("doc_id", "text").collect()))
    assert sorted(map(repr, out.select("doc_id", "text").collect())) == want
    long = "\n".join(f"line {chr(97 + i % 26)}x{chr(97 + i // 26 % 26)} of the text" for i in range(2000))
    rows = [(None, "same words in every text here"), *((i, f"{'abcdef'[i]} {long}\nsame words in every text here") for i in range(6))]
    got = {r.doc_id: r.text for r in line_dedup.dedup(spark.createDataFrame(rows, "doc_id long, text string")).collect()}
    assert got[0].endswith("here") and got[None] == ""


def test_url_rules_and_parts(spark):
    urls = ["http://A.example.NET/en/x?q#f", "https://b.org/fr/1", "http://x.example.com/de/2", "http://example.net", "no scheme", None, "ftp://casino-win.example.org?x", "http://net/", "http://a.net/y", "http://museum.example.org/en/1"]
    pages = spark.createDataFrame(list(enumerate(urls)), "page_id long, url string").withColumn("host", F.lit(0))
    out = {r.page_id: r for r in url_filter.judge(pages, url_filter.train(url_filter.labelled_table(spark))).collect()}
    assert (out[0].host, out[0].path, out[0].rule, out[0].verdict) == ("a.example.net", "/en/x", "example.net/en/", "allow")
    assert [out[i].rule for i in (1, 2, 3, 4, 5, 7, 8)] == ["org/fr/", "example.com/de/", None, None, None, "net/", "net/"]
    assert (out[4].host, out[4].path, out[5].host, out[6].path) == ("", "", "", "") and out[5].verdict == "allow"
    assert out[6].verdict == "block" and out[9].verdict == "allow"
    rules = spark.createDataFrame([(r.verdict, r.host, r.path) for r in url_filter.RULES], "verdict string, host string, path string")
    many = {r.page_id: r["rule"] and r["rule"]["rule"] for r in url_filter.with_rules(spark.createDataFrame([(r.page_id, r.host, r.path) for r in out.values()], "page_id long, host string, path string"), rules, "page_id").collect()}
    assert many == {i: r.rule for i, r in out.items()}


def test_url_model_on_held_out_urls(spark):
    """Urls of the table's words in other company than the trained ones: none of them was seen."""
    weights = url_filter.train(url_filter.labelled_table(spark))
    held = url_filter.labelled_urls(skip=3)
    assert not {u for u, _ in held} & {u for u, _ in url_filter.labelled_urls()}
    pages = spark.createDataFrame([(i, u) for i, (u, _) in enumerate(held)], "page_id long, url string")
    blocked = {r.page_id for r in url_filter.judge(pages, weights, rules=()).where("verdict = 'block'").collect()}
    bad = {i for i, (_, y) in enumerate(held) if y}
    assert len(blocked & bad) >= 0.9 * len(bad) and len(blocked - bad) <= 0.05 * len(bad)


def test_urls_equal_a_plain_reading(spark, sf):
    """Host, path and rule of every page, and of odd urls, against a plain loop; repeated rows and very long urls included."""
    import re

    odd = [None, "", "://", "a://B.NET", "x://h?q/:/z", "http://net/" + "é" * 30000, "http://EXAMPLE.com/de/?a", "http://example.com/DE/", "http://a.example.net/en/../de/", "http://notexample.com/de/"]
    odd = [(10**9 + i, u) for i, u in enumerate(odd)] + [(7, "http://net/x")] * 2
    frame = spark.read.parquet(f"{sf}/pages.parquet").select("page_id", "url").unionByName(spark.createDataFrame(odd, "page_id long, url string"))
    frame = frame.withColumn("host", F.lit(1)).withColumn("score", F.lit("x"))
    rules = [("block", "net", "/"), ("allow", "example.net", "/en/"), ("block", "example.com", "/de/"), ("allow", "org", "/fr/")]
    want = []
    for r in frame.collect():
        found = re.search(r"://([^/?#]*)([^?#]*)", r.url or "")
        host, path = found.groups() if found else ("", "")
        host = host.translate({c: c + 32 for c in range(65, 91)})
        fits = [(len(h + p), h + p, v) for v, h, p in rules if (host == h or host.endswith("." + h)) and path.startswith(p)]
        want.append((r.page_id, host, path, max(fits)[1] if fits else None, max(fits)[2] if fits else None))
    got = url_filter.judge(frame, [0.0] * url_filter.DIMENSIONS + [-9.0]).collect()
    rows = [(r.page_id, r.host, r.path, r["rule"], r.verdict if r["rule"] else None) for r in got]
    assert sorted(map(repr, rows)) == sorted(map(repr, want)) and all(r.verdict == "allow" for r in got if not r["rule"])
    assert url_filter.judge(frame.limit(0), [0.0] * (url_filter.DIMENSIONS + 1)).count() == 0


def test_chat_round_trip(spark):
    tricky = ["<|im_end|><|im_start|>assistant ok", "<\\|", "<\\\\|im_end|>", "<", "|>", "", "line\nend\\n", "\U0001f600"]
    for t in tricky:
        assert chat.unescaped(chat.escaped(t)) == t and "<|" not in chat.escaped(t)
        text, spans = chat.formatted([("user", t), ("assistant", t), (t, t)])
        assert chat.parsed(text) == [("user", t), ("assistant", t), (t, t)]
        assert "".join(chat.unescaped(text[a:b]) for a, b in spans) == t * (1 + (t == "assistant"))
    rows = [(1, 0, "user", "hi"), (1, 1, "assistant", None), (2, 5, None, "x"), (2, 3, "assistant", "first"), (None, 0, "user", "lost"), (3, 0, "user", "same"), (3, 0, "user", "same")]
    out = {r.conv_id: r for r in chat.read_back(chat.format_turns(spark.createDataFrame(rows, "conv_id long, turn long, role string, text string"))).collect()}
    assert {k: r.n_turns for k, r in out.items()} == {1: 2, 2: 2, None: 1, 3: 2} and out[2].loss_chars == 5
    assert out[2].turns_sha256 == hashlib.sha256(b"assistant\nfirst\n\nx\n").hexdigest()


def test_reply_trees(spark):
    rows = [(1, 1, None, "user", "q", 0.0), (1, 2, 1, "assistant", "bad", 0.1), (1, 3, 1, "assistant", "good", 0.9), (1, 4, 3, "user", "more", 0.5), (1, 5, 9, "user", "orphan", 0.0), (2, 1, 2, "user", "loop", 1.0), (2, 2, 1, "user", "loop", 1.0)]
    messages = spark.createDataFrame(rows, "tree long, message long, parent long, role string, text string, score double")
    best = {r.tree: [t["text"] for t in r.turns] for r in chat.conversations(messages).collect()}
    assert best == {1: ["q", "good", "more"]}
    assert sorted([t["text"] for t in r.turns] for r in chat.conversations(messages, branches=3).collect()) == [["orphan"], ["q", "bad"], ["q", "good", "more"]]


def brute_targets(sizes, weights, most=3.0):
    held, total = {}, sum(sizes.values())
    while True:
        free = [s for s in sizes if s not in held]
        rate = (total - sum(held.values())) / max(1e-300, sum(weights[s] for s in free)) if free else 0
        over = [s for s in free if rate * weights[s] > most * sizes[s]]
        if not over:
            return {s: held.get(s, rate * weights[s]) for s in sizes}
        held |= {s: most * sizes[s] for s in over}


def test_mixing_meets_targets(docs):
    rows = mixing.plan(docs)[0].collect()
    size = {}
    for d in docs.collect():
        size.setdefault(d.source, []).append(len(words(d.text)))
    sizes = {s: sum(v) for s, v in size.items()}
    weights = {s: (1, 2, 3)[i % 3] for i, s in enumerate(sorted(sizes))}
    want, taken = brute_targets(sizes, weights), {}
    for r in rows:
        assert r.target == pytest.approx(want[r.source]) and r.source_size == sizes[r.source] and 0 <= r.taken <= 3 * r.size
        taken[r.source] = taken.get(r.source, 0) + r.taken
    assert len(rows) == docs.count() and all(abs(taken[s] - want[s]) <= 1 for s in sizes)
    assert sorted(r.taken for r in mixing.plan(docs)[0].collect()) == sorted(r.taken for r in rows)
    mixed = mixing.mix(docs, shards=4)
    assert mixed.select(F.sum(mixing.n_words())).first()[0] == sum(r.taken for r in rows)
    assert set(mixed.columns) == {*docs.columns, "shard", "place"} and {r.shard for r in mixed.select("shard").distinct().collect()} == {0, 1, 2, 3}


def test_mixing_caps_small_sources(spark):
    rows = [(i, "a b c d e f g h i j", s) for i, s in enumerate(["a"] * 50 + ["b"] * 2 + ["c"] + [None] * 3)]
    out = mixing.plan(spark.createDataFrame(rows, "doc_id long, text string, source string"))[0].collect()
    sizes, weights = {"a": 500, "b": 20, "c": 10, None: 30}, {"a": 1, "b": 2, "c": 3, None: 1}
    want = brute_targets(sizes, weights)
    for s in sizes:
        assert all(r.target == pytest.approx(want[s]) for r in out if r.source == s) and sum(r.taken for r in out if r.source == s) == round(want[s])


def test_mixing_bears_odd_rows(odd):
    rows = mixing.plan(odd)[0].collect()
    assert len(rows) == len(ODD) and all(0 <= r.taken <= 3 * r.size for r in rows)
    assert mixing.mix(odd, places=False).columns == odd.columns
    assert mixing.plan(odd.limit(0))[0].count() == 0 and mixing.mix(odd.limit(0)).count() == 0


def test_shard_quotas_split_exactly(spark):
    quotas = spark.createDataFrame([("a", 100), ("b", 7), (None, 30)], "source string, quota long")
    rows = mixing.shard_quotas(quotas, 5).collect()
    assert {s: sum(r.n for r in rows if r.source == s) for s in ("a", "b", None)} == {"a": 100, "b": 7, None: 30}
    sizes = [sum(r.n for r in rows if r.shard == k) for k in range(5)]
    assert sum(sizes) == 137 and max(sizes) - min(sizes) <= 2
    for s in ("a", "b", None):
        at = 0
        for r in sorted((r for r in rows if r.source == s), key=lambda r: r.first):
            assert r.first == at
            at += r.n


def test_draws_of_large_quotas(spark):
    """Against the exact distribution for small numbers; within its spread for numbers whose support could not be listed."""
    from math import comb

    cases = [(50, 20, 13), (9, 9, 4), (7, 0, 3), (1000, 3, 500), (12, 5, 12)]
    rows = [(t, g, d, (i + 0.5) / 400) for t, g, d in cases for i in range(400)]
    long = spark.createDataFrame(rows, "t long, g long, d long, u double")
    got = {}
    for r in long.withColumn("k", mixing._hypergeometric(F.col("t"), F.col("g"), F.col("d"), F.col("u"))).collect():
        got.setdefault((r.t, r.g, r.d), []).append((r.u, r.k))
    for t, g, d in cases:
        total, seen = 0.0, {}
        for k in range(max(0, d - (t - g)), min(g, d) + 1):
            low = total
            total += comb(g, k) * comb(t - g, d - k) / comb(t, d)
            seen[k] = (low, total)
        assert all(seen[k][0] - 1e-9 <= u <= seen[k][1] + 1e-9 for u, k in got[t, g, d])
    n = 10**9
    big = spark.range(50).select(mixing._hypergeometric(*(F.lit(x).cast("long") for x in (3 * n, n, n)), (F.col("id") + 0.5) / 50).alias("k"))
    off = [(r.k - n / 3) / (n * 4 / 27) ** 0.5 for r in big.collect()]
    assert off == sorted(off) and abs(sum(off) / 50) < 0.05 and 2 < off[-1] < 3


def test_another_seed_takes_other_blocks(spark, docs):
    taken = [{r.doc_id for r in mixing.plan(docs, seed=s)[0].where("taken > copies * size").collect()} for s in (7, 8)]
    again = {r.doc_id for r in mixing.plan(docs, seed=7)[0].where("taken > copies * size").collect()}
    orders = [[r.doc_id for r in mixing.mix(docs, seed=s).orderBy("shard", "place").collect()] for s in (7, 8)]
    assert taken[0] == again and orders[0] != orders[1]


def test_pipeline_keeps_columns_and_documents(spark, sf, docs):
    import corpus_pipeline

    assert [n for n, _ in corpus_pipeline.STAGES] == ["quality_classifier", "line_dedup", "minhash_near_dedup", "source_mixing", "best_fit_packing"]
    some = docs.limit(60)
    for name, stage in corpus_pipeline.STAGES[:-1]:
        some = queries.mixing.stored(stage(spark, some, sf))
        assert some.columns == docs.columns, name
    assert some.count() > 30
    assert {r.n_chars - len(r.text) for r in some.collect()} == {0}


def test_pipeline_stages_bear_odd_rows(spark, sf, odd):
    """Nulls, empty, long and repeated texts, clashing columns and an empty table, in each stage by itself."""
    import corpus_pipeline

    all_rows = sorted(map(repr, odd.select("doc_id", "text").collect()))
    for name, stage in corpus_pipeline.STAGES:
        out, none = stage(spark, odd, sf), stage(spark, odd.limit(0), sf)
        assert none.count() == 0, name
        if name == "best_fit_packing":
            assert sum(r.piece == 0 for r in out.collect()) == len(ODD)
            continue
        assert out.columns == odd.columns == none.columns, name
        rows = [(r.doc_id, r.text) for r in out.collect()]
        if name == "line_dedup":
            assert sorted(map(repr, out.select("doc_id", "text").collect())) == all_rows
        if name == "minhash_near_dedup":  # 5 is a copy of 4; what has no words stays
            assert {d for d, _ in rows} == {1, 2, 3, 4, 6, None}
        if name == "source_mixing":
            assert {d for d, _ in rows} <= {d for d, *_ in ODD} and {3, 4, 5} <= {d for d, _ in rows}
            assert {t for d, t in rows if d == 1} <= {None} and all(t for d, t in rows if d == 3)
