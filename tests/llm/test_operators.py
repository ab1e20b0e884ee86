"""The ten operators against brute force, with nulls, empty and long texts, ties, repeated rows,
empty tables and extra columns whose names clash with the operators' own."""

from __future__ import annotations

import hashlib
import os
import random
import sys

import numpy as np
import pytest
from pyspark.sql import functions as F

sys.path.insert(0, os.path.dirname(__file__))
import brute  # noqa: E402

from tsengine.llm import anchors, bpe, decontaminate, html, ngram_join, quality, sharding, suffix_array, suffix_tree, topk, warc  # noqa: E402
from tsengine.llm import common  # noqa: E402

public_tokenizers = pytest.importorskip("public_tokenizers")
CLASH = "doc_id long, text string, rid string, runs int, score string, key int, n int, shard string, sid int"


def corpus(spark, rows, parts=3):
    """rows (doc_id, text) with extra columns of clashing names."""
    return spark.createDataFrame([(i, t, "r", 1, "s", 2, 3, "x", 4) for i, t in rows], CLASH).repartition(parts)


def texts(seed=1, n=60):
    rng = random.Random(seed)
    vocab = ["".join(rng.choice("abcdefgh") for _ in range(rng.randint(1, 6))) for _ in range(80)] + ["é", "日本", "X", "😀"]
    passage = " ".join(rng.choice(vocab) for _ in range(60))
    out = [None, "", " \t\n", "a", "one two", "a" * 5000, "ab " * 3000, passage, passage]
    for _ in range(n):
        w = [rng.choice(vocab) for _ in range(rng.randint(0, 90))]
        if rng.random() < 0.4:
            at = rng.randint(0, len(w))
            w[at:at] = passage.split()
        out.append(" ".join(w))
        if rng.random() < 0.3 and w:
            w[rng.randrange(len(w))] = "changed"
            out.append(" ".join(w))
    return list(enumerate(out))


@pytest.fixture(scope="module")
def rows():
    return texts()


@pytest.mark.parametrize("most", [1, 2048])
def test_suffix_tree(spark, rows, most):
    got = {r[0]: tuple(r)[1:] for r in suffix_tree.dedup_words(corpus(spark, rows), most=most).collect()}
    want = brute.substring_words([t for _, t in rows], 35)
    assert got == {i: w for (i, _), w in zip(rows, want, strict=True)}
    assert sum(w[1] for w in want) > 0


@pytest.mark.parametrize("most", [1, 2048])
def test_suffix_array(spark, rows, most):
    got = {r[0]: tuple(r)[1:] for r in suffix_array.dedup_bytes(corpus(spark, rows), most=most).collect()}
    assert got == {i: w for (i, _), w in zip(rows, brute.substring_bytes(rows, 100), strict=True)}


def test_substring_repeated_rows_and_null_ids(spark):
    t = " ".join(f"w{k}" for k in range(60))
    rows = [(1, t), (1, t), (None, t), (2, "short")]
    words = sorted((r[0] or -1, r.n_removed) for r in suffix_tree.dedup_words(corpus(spark, rows)).collect())
    assert words == [(-1, 60), (1, 60), (1, 60), (2, 0)]
    size = sorted((r[0] or -1, r.n_removed) for r in suffix_array.dedup_bytes(corpus(spark, rows)).collect())
    assert size == [(-1, len(t)), (1, 0), (1, 0), (2, 0)]  # equal places tie: neither is earlier


def test_suffix_array_text_keeps_whole_characters(spark):
    t = "".join(chr(0x4E00 + 64 * k) for k in range(60))
    other = chr(0x5E00) + t[1:]  # its first character shares the last two of three bytes with t's
    got = {r.doc_id: r for r in suffix_array.dedup_bytes(corpus(spark, [(1, t), (2, other), (3, None)]), texts=True).collect()}
    assert (got[2].n_removed, got[2].kept, got[2].carry.rid) == (179, other[0], "r") and got[1].kept == t


def test_sliding_min_blocks():
    h = np.random.default_rng(1).integers(0, 9, 5000).astype(np.uint64) << np.uint64(40)
    got = common.sliding_min(h, 28, block=257)
    assert all(got[i] == i + int(np.argmin(h[i:i + 28])) for i in range(len(got)))


@pytest.mark.parametrize(("n", "pct", "frequent"), [(3, 90, 2), (5, 80, 2), (3, 90, 64)])
def test_ngram_join(spark, rows, n, pct, frequent, monkeypatch):
    monkeypatch.setattr(ngram_join, "FREQUENT", frequent)
    more = rows + [(len(rows) + k, (t or "").upper() + " tail" * (k % 2)) for k, (_, t) in enumerate(rows[::3])]
    got = {r.doc_id: (r.n_shingles, r.component_id) for r in ngram_join.similar_components(corpus(spark, more), n, pct).collect()}
    assert got == {i: w for (i, _), w in zip(more, brute.groups(more, n, pct), strict=True)}


@pytest.mark.parametrize(("n", "pct", "frequent"), [(3, 90, 8), (2, 50, 4)])
def test_ngram_join_of_families(spark, n, pct, frequent, monkeypatch):
    """Families of near copies around the threshold, long and short, with passages that many share."""
    monkeypatch.setattr(ngram_join, "FREQUENT", frequent)
    rng = random.Random(n * pct)
    word = lambda: "".join(rng.choice("abcdefghij") for _ in range(rng.randint(2, 5)))
    passage, docs = [word() for _ in range(60)], []
    for size in (6, 30, 150, 900):
        for _ in range(4):
            first = [word() for _ in range(size)]
            for _ in range(5):
                w = list(first)
                for _ in range(rng.randint(0, max(1, size // 12))):
                    w[rng.randrange(size)] = word()
                docs.append(" ".join(w if rng.random() < 0.6 else passage + w))
    docs = list(enumerate(docs + docs[::7]))
    got = {r.doc_id: (r.n_shingles, r.component_id) for r in ngram_join.similar_components(corpus(spark, docs), n, pct, 2.0).collect()}
    want = brute.groups(docs, n, pct)
    assert got == {i: w for (i, _), w in zip(docs, want, strict=True)}
    assert 8 < len({w[1] for w in want}) < len(docs)


def thue_morse(size, a="a", b="b"):
    """Two sequences that every polynomial hash modulo 2 ** 64 gives the same value, if long enough."""
    bits = [bin(k).count("1") % 2 for k in range(size)]
    return [a if x else b for x in bits], [b if x else a for x in bits]


def test_decoding_up_the_tree():
    ranks = bpe.read_ranks(public_tokenizers.path("byte_bpe_50k.tiktoken"))
    one = bpe.Bpe(ranks, public_tokenizers.PATTERN)
    for n in (0, 1, 2, 3, 7, 8, 9, 1000):
        ids = [k * 37 % len(ranks) for k in range(n)]
        assert one.decode_text(" ".join(map(str, ids))) == b"".join(one.bytes_of[i] for i in ids)


def test_words_that_polynomials_confuse(spark):
    x, y = ("".join(w) for w in thue_morse(2048))
    assert len(set(common.word_hashes(*(lambda d: (d, np.array([0, 2049]), np.array([2048, 4097])))(np.frombuffer(f"{x} {y}".encode(), np.uint8))).tolist())) == 2
    shared = " ".join(f"w{k}" for k in range(34))
    rows = [(1, f"{x} a b"), (2, f"{y} a b"), (3, f"{shared} {x}"), (4, f"{shared} {y}"), (5, f"{shared} {x}")]
    got = {r.doc_id: r.component_id for r in ngram_join.similar_components(corpus(spark, rows)).collect()}
    assert got == {1: 1, 2: 2, 3: 3, 4: 3, 5: 3}  # the last three share 32 of 34 shingles at least
    got = {r.doc_id: r.n_removed for r in suffix_tree.dedup_words(corpus(spark, rows)).collect()}
    assert got == {1: 0, 2: 0, 3: 35, 4: 0, 5: 35}


@pytest.mark.parametrize("most", [1, 2048])
def test_windows_that_polynomials_confuse(spark, most):
    a, b = (" ".join(w) for w in thue_morse(512))
    rows = [(1, a), (2, b), (3, "".join(thue_morse(4096)[0])), (4, "".join(thue_morse(4096)[1]))]
    got = {r[0]: tuple(r)[1:] for r in suffix_tree.dedup_words(corpus(spark, rows), most=most).collect()}
    assert got == {i: w for (i, _), w in zip(rows, brute.substring_words([t for _, t in rows], 35), strict=True)}
    got = {r[0]: tuple(r)[1:] for r in suffix_array.dedup_bytes(corpus(spark, rows), most=most).collect()}
    assert got == {i: w for (i, _), w in zip(rows, brute.substring_bytes(rows, 100), strict=True)}


def test_keep_one(spark):
    t = " ".join(f"w{k}" for k in range(80))
    rows = [(3, t), (1, t), (1, t), (None, t + " end"), (4, ""), (5, None), (6, ""), (7, "other words here")]
    kept = ngram_join.keep_one(corpus(spark, rows))
    assert kept.columns == corpus(spark, rows).columns
    assert sorted(r.doc_id for r in kept.collect()) == [1, 4, 5, 6, 7]


def test_keep_one_without_identities(spark):
    text = lambda x: " ".join(f"{x}{k}" for k in range(80))
    rows = [(None, text("a")), (None, text("b")), (1, text("c")), (1, text("d")), (2, text("d")), (None, text("e")), (None, text("e") + " end"), (3, text("a"))]
    kept = ngram_join.keep_one(corpus(spark, rows)).collect()
    assert sorted((r.doc_id or 0, r.text[0]) for r in kept) == [(0, "b"), (0, "e"), (1, "c"), (1, "d"), (3, "a")]


def test_open_entries_hold_a_set_once(spark):
    held = spark.createDataFrame([(7, s, 5, 0) for s in (1, 2) for _ in range(50)] + [(8, 1, 5, 1)] * 50, "entry long, sid long, n int, place int")
    got = ngram_join._open(held, spark.createDataFrame([], "node long, root long")).collect()
    assert sorted((r.entry, r.sid, r.root) for r in got) == [(7, 1, 1), (7, 2, 2)]


def test_components_of_a_long_chain(spark):
    links = spark.createDataFrame([(k, k + 1) for k in range(40)] + [(100, 101)], "a long, b long")
    got = dict(ngram_join.components(links).collect())
    assert got == {**dict.fromkeys(range(41), 0), 100: 100, 101: 100}


def test_decontaminate(spark):
    rng = random.Random(3)
    word = lambda: "".join(rng.choice("abcdefghiklmnoprst") for _ in range(rng.randint(2, 7)))
    items = [(k, " ".join(word() for _ in range(rng.randint(12, 40)))) for k in range(8)] + [(90, "tiny"), (91, None), (92, "")]
    rows = [(-1, None), (-2, ""), (-3, items[0][1] * 2)]
    for d in range(40):
        t = " ".join(word() for _ in range(60))
        if d % 2:
            x = list(items[d % 8][1])
            for _ in range(rng.randint(0, len(x) // 9)):
                k = rng.randrange(len(x))
                x[k:k + 1] = rng.choice([[], ["z"], ["y", x[k]]])
            t = t[:100] + "".join(x).upper() + t[100:]
        rows.append((d, t))
    bench = spark.createDataFrame(items, "item_id long, text string")
    got = {(r.doc_id, r.item_id): r.edits for r in decontaminate.find_items(corpus(spark, rows), bench).collect()}
    want = {}
    for d, t in rows:
        for i, x in items[:8]:
            e = brute.edit_distance_in(x.lower(), (t or "").lower())
            if e <= min(int(len(x) * decontaminate.RATE), (len(x) - 8) // 8):
                want[d, i] = e
    assert got == want and len(want) > 10
    clean = decontaminate.clean_documents(corpus(spark, rows), bench)
    assert sorted(r.doc_id for r in clean.collect()) == sorted({d for d, _ in rows} - {d for d, _ in want})


def test_decontaminate_short_items_and_null_ids(spark):
    long = "an item of more than twenty-four bytes in all"
    bench = spark.createDataFrame([(1, "Two  plus two"), (2, " 7 "), (3, "\t"), (4, "日本"), (None, long), (None, "null id"), (6, "été")], "item_id long, text string")
    rows = [(1, "what is TWO\t\tplus two? ask"), (2, "two  plus twofold, 77"), (3, "(7) it is 7"), (4, "あ日本語"), (5, f"see {long} here"), (6, "a null id."),
            (7, "vétété l'été"), (8, "\t7x "), (9, None), (10, "two  plus tw"), (11, "o")]
    got = sorted((r.doc_id, r.item_id or 0, r.edits, r.start, r.end) for r in decontaminate.find_items(corpus(spark, rows, 1), bench).collect())
    assert got == [(1, 1, 0, 8, 21), (3, 2, 0, 1, 2), (4, 4, 0, 3, 9), (5, 0, 0, 4, 4 + len(long)), (6, 0, 0, 2, 9), (7, 6, 0, 12, 17)]
    assert sorted(r.doc_id for r in decontaminate.clean_documents(corpus(spark, rows), bench).collect()) == [2, 8, 9, 10, 11]


def test_sharding(spark):
    rng = random.Random(4)
    rows = [(k, "x" * rng.randint(0, 300)) for k in range(400)] + [(1000 + k, "same" * 50) for k in range(30)] + [(2000, None), (2001, None)]
    got = sharding.shard(corpus(spark, rows)).collect()
    assert len(got) == len(rows)
    by, size, slots = {}, {}, {}
    text = dict(rows)
    for r in got:
        assert r.size == len((text[r.doc_id] or "").encode()) + 1 and r.law == "bytes" and r.grown_shard is None
        by.setdefault(text[r.doc_id], set()).add(r.shard)
        size[r.shard] = size.get(r.shard, 0) + r.size
        slots.setdefault(r.shard, []).append(r.slot)
    assert all(len(s) == 1 for s in by.values()) and set(size) <= set(range(8))
    assert all(sorted(s) == list(range(len(s))) for s in slots.values())
    keyed = spark.createDataFrame([(t,) for _, t in rows], "text string").select(
        sharding.text_key(F.col("text")).alias("k"), (F.coalesce(F.octet_length("text"), F.lit(0)) + 1).alias("s")).groupBy("k").agg(F.sum("s")).orderBy("k").collect()
    assert max(size.values()) == brute.smallest_capacity([r[1] for r in keyed], 8)


def test_minimax_with_few_ranges(spark, monkeypatch):
    monkeypatch.setattr(sharding, "FAN", 3)
    rng = random.Random(5)
    sizes = [rng.randint(1, 50) for _ in range(200)]
    table = spark.createDataFrame([(k * 1_000_003, s) for k, s in enumerate(sizes)], "key long, size long")
    for shards in (1, 3, 8, 300):
        assert sharding.minimax_cuts(table, shards)[0] == brute.smallest_capacity(sizes, shards)


@pytest.fixture(scope="module")
def ranks():
    return bpe.read_ranks(public_tokenizers.path("byte_bpe_50k.tiktoken"))


def test_bpe(spark, rows, ranks):
    tiktoken = pytest.importorskip("tiktoken")
    enc = tiktoken.Encoding("t", pat_str=public_tokenizers.PATTERN, mergeable_ranks=ranks, special_tokens={})
    rng = random.Random(6)
    odd = ["\x1c", "\x85", "\xa0", "中文", "²", "½", " ", "\n", "'s", "'LL", "=-", "😀", "<|endoftext|>", "é", "a" * 30, "zq" * 40, "  "]
    more = rows + [(500 + k, "".join(rng.choice(odd) for _ in range(rng.randint(0, 60)))) for k in range(60)]
    more += [(900, "".join(rng.choice("abcde") for _ in range(40000)))]
    got = {r.doc_id: r for r in bpe.encode_decode(corpus(spark, more), ranks, public_tokenizers.PATTERN, ids=True).collect()}
    for i, t in more:
        ids = enc.encode_ordinary(t or "")
        assert got[i].ids == ids and got[i].n_tokens == len(ids) and got[i].decoded == (t or "")
        assert got[i].ids_sha256 == hashlib.sha256(" ".join(map(str, ids)).encode()).hexdigest()
        assert got[i].decoded_sha256 == hashlib.sha256((t or "").encode()).hexdigest()


def test_bpe_join_is_the_encoding_of_the_whole(ranks):
    b, rng = bpe.Bpe(ranks, public_tokenizers.PATTERN), random.Random(7)
    for _ in range(300):
        x, y = ("".join(rng.choice("theandofing") for _ in range(rng.randint(1, 40))).encode() for _ in range(2))
        assert b.join(b.merge(x), b.merge(y)) == b.merge(x + y)


def test_warc_round_trip(spark, tmp_path, monkeypatch):
    monkeypatch.setattr(warc, "SEGMENT", 400)
    big = "<p>é日本😀 text\r\n\r\nWARC/1.1\r\n</p>" * 60
    rows = [(1, "http://a", big), (5, "http://b", big), (3, None, big), (7, "u", "small"), (8, "u", "small"), (9, "u", None), (9, "u", ""), (None, "n", big), (4, "x", big + "y")]
    pages = spark.createDataFrame([(*r, 1) for r in rows], "page_id long, url string, html string, digest int").repartition(2)
    warc.write_archives(pages, str(tmp_path / "w"))
    got = warc.read_archives(spark, str(tmp_path / "w")).collect()
    assert len(got) == len(rows) and all(r.complete for r in got)
    by = {r.page_id: r for r in got}
    sha = hashlib.sha1(big.encode()).hexdigest()
    assert by[5].record_type == "response" and by[5].payload.decode() == big and by[4].payload.decode() == big + "y"
    for i in (1, 3, None):
        assert (by[i].record_type, by[i].refers_to, by[i].payload_bytes, by[i].payload_digest) == ("revisit", 5, len(big.encode()), sha)
    assert by[7].record_type == by[8].record_type == "response" and by[9].payload_bytes == 0 and by[3].url is None


def test_warc_missing_segment(spark, tmp_path, monkeypatch):
    monkeypatch.setattr(warc, "SEGMENT", 300)
    records = list(warc._page_records("r", 1, "u", "z" * 1000, hashlib.sha1(b"z" * 1000).hexdigest(), None))
    os.makedirs(tmp_path / "w")
    (tmp_path / "w" / "a.warc").write_bytes("\r\n\r\n".join(records[:1] + records[2:]).encode())
    got = warc.read_archives(spark, str(tmp_path / "w")).collect()
    assert len(got) == 1 and got[0].complete is False


def test_top_k(spark, monkeypatch):
    monkeypatch.setattr(topk, "SLICE", 50)
    monkeypatch.setattr(topk, "BLOCK", 4)
    rng = np.random.default_rng(8)
    vec = [(k, [float(x) for x in rng.normal(0, 0.2, 8)]) for k in range(200)]
    vec += [(k, [0.5] * 8) for k in range(200, 260)] + [(300, None), (350, [float("nan")] * 8), (400, [1.0, None] * 4), (450, [float("inf")] * 8), (500, []), (None, [1.0] * 8), (550, [1.0] * 3)]
    table = spark.createDataFrame([(i, v, 1) for i, v in vec], "vec_id long, embedding array<float>, score int").repartition(3)
    got = sorted(tuple(r) for r in topk.top_k(table, F.col("vec_id") % 50 == 0).collect())
    use = [(i, np.floor(256 * np.array(v, np.float32).astype(float)).astype(int)) for i, v in vec if i is not None and i < 300]
    want = []
    for i, q in use:
        if i % 50 == 0:
            top = sorted((-int(q @ v), j) for j, v in use if j != i)[:5]
            want += [(i, k, j, -s) for k, (s, j) in enumerate(top, 1)]
    assert got == sorted(want)


def test_html():
    page = """<html><head><title>T</title><style>p{}</style></head><body><header><h1>Site</h1></header><nav><ul><li><a href=/>Home</a></li></ul></nav>
<div id="cookie-notice">We use cookies</div>%s<h1>Head &amp; line</h1><p>First <a href=x>para</a>graph,
 long enough to count here.</p><div class="ad">Buy</div><p>Second<br>line &lt;b&gt; &eacute;.<p>Open <b>end</p><script>var x="<p>no</p>";</script>%s
<aside>More</aside><section class="comments"><p>Great read, thank you for the story!</p></section><form><label>Mail</label></form><footer>&copy; x</footer></body></html>"""
    want = "Head & line First paragraph, long enough to count here. Second line <b> é. Open end"
    assert html.main_text(page % ("<article>", "<div class='comment-list'><p>boo</p></div></article>")) == want
    assert html.main_text(page % ("<div class='content'>", "</div>")) == want
    assert html.main_text("") == "" and html.main_text("<nav>x</nav>") == "" and html.main_text("plain &amp; text") == "plain & text"
    assert html.main_text("<a " * 3000) is not None and html.main_text("<div>" * 3000 + "x") == "x"


def test_html_rows(spark):
    pages = spark.createDataFrame([(1, "u", "<article><p>é  x</p></article>", "t"), (2, None, None, "t"), (2, None, None, "t")], "page_id long, url string, html string, text string")
    assert sorted(tuple(r) for r in html.extract(pages).collect())[:1] == [(1, "u", "é x", 3)]
    assert html.extract(pages).where("page_id = 2 AND text = '' AND n_chars = 0").count() == 2


def test_stretches():
    assert html.stretches([0, 0, 0, 5, 0, 5, 0, 0, 0, 7]) == [(3, 6), (9, 10)]


def test_quality(spark):
    rng = random.Random(9)
    def clean():
        return " ".join("".join(rng.choice("abcdefgh") for _ in range(5)) for _ in range(rng.randint(3, 300)))
    rows = [(k, clean() if k % 3 else " ".join(w + "%%%" for w in clean().split())) for k in range(240)] + [(1000, None), (1001, ""), (1002, "x" * 200000)]
    labels = spark.createDataFrame([(k, int(k % 3 > 0)) for k in range(240)] + [(None, None)], "doc_id long, quality int")
    docs = corpus(spark, rows)
    scored = quality.score(docs, quality.fit_from_tables(docs, labels))
    got = {r.doc_id: r for r in scored.collect()}
    assert len(got) == len(rows) and all(0 <= r.score <= 1 for r in got.values())
    assert np.mean([got[k].predicted == int(k % 3 > 0) for k in range(240)]) > 0.97
    empty = labels.limit(0)
    assert {r.score for r in quality.score(docs, quality.fit_from_tables(docs, empty)).collect()} == {0.5}


def test_empty_tables(spark, ranks, tmp_path):
    docs = corpus(spark, [(1, "x")], 1).limit(0)
    bench = spark.createDataFrame([], "item_id long, text string")
    pages = spark.createDataFrame([], "page_id long, url string, html string")
    warc.write_archives(pages, str(tmp_path / "w"))
    vec = spark.createDataFrame([], "vec_id long, embedding array<float>")
    for df in (suffix_tree.dedup_words(docs), suffix_array.dedup_bytes(docs), ngram_join.similar_components(docs), ngram_join.keep_one(docs),
               decontaminate.find_items(docs, bench), decontaminate.clean_documents(docs, bench), sharding.shard(docs),
               bpe.encode_decode(docs, ranks, public_tokenizers.PATTERN), html.extract(pages), topk.top_k(vec, F.col("vec_id") % 50 == 0)):
        assert df.count() == 0
    one = corpus(spark, [(1, "some text")], 1)
    assert decontaminate.find_items(one, bench).count() == 0 and anchors.keyed(one).count() == 1


def test_html_names():
    keep = lambda inner: html.main_text(f"<article><p>before</p>{inner}<p>after</p></article>")
    for inner in ('<p>a <a href="/the-hidden-life">b</a> c</p>', '<p title="A hidden history">a b c</p>', '<p aria-hidden="false">a b c</p>',
                  '<p>a <a href="/p?id=comments-5">b</a> c</p>', '<section data-id="search-3">a b c</section>', '<h2 id="side-effects">a b c</h2>',
                  '<section id="discussion">a b c</section>', '<p>a <span class="share">b</span> c</p>', '<section id="legal-history">a b c</section>'):
        assert keep(inner) == "before a b c after", inner
    for inner in ("<p hidden>x</p>", '<p style="display: none">x</p>', '<section id="comments">x</section>', '<div class="site-footer">x</div>', "<div id=ad-3>x</div>"):
        assert keep(inner) == "before after", inner
    body = "<p>The first part.</p><p>The second part.</p>"
    for page in ('<article class="post no-sidebar">%s</article>', '<main class="has-sidebar">%s</main>', '<div class="sidebar-page"><article>%s</article></div>',
                 '<div class="layout with-sidebar"><div class="content">%s</div></div>', '<section class="sidebar-left"><main>%s</main></section>',
                 "<html><head><title>T</title><script>var a='<p>';</script><body>%s</body></html>", "<head><meta charset=utf-8><title>T</title>%s"):
        assert html.main_text(page % body) == "The first part. The second part.", page
    assert html.main_text(f"<main>{body}<ol class='commentlist'><li><article class='comment'>x</article></ol></main>") == "The first part. The second part."


def test_html_removed_region_ends_no_stretch():
    long, last = " ".join(["Some words of the long part."] * 70), "A short closing paragraph."
    menu = "<div><a href=/a>One</a> | <a href=/b>Two</a></div>"
    for page in ("<div class=content><p>%s</p><div class=ad>Buy</div><p>%s</p></div>", "<p>%s</p><form>Mail</form><p>%s</p>",
                 "<div class=content><div class=part><p>%s</p></div><aside>More</aside><p>%s</p></div>"):
        assert html.main_text(f"<body>{menu * 4}{page % (long, last)}<footer>x</footer>{menu}</body>") == f"{long} {last}", page


def test_html_mark_is_one_weight():
    body = "The body of the page. " * 20 + "Its last words."
    cards = '<article><h3><a href="/1">A first teaser</a></h3></article><article><h3><a href="/2">Another teaser</a></h3></article>'
    assert html.main_text(f"<body><div>{cards}</div><div class=content><p>{body}</p></div></body>") == body
    assert html.main_text(f"<body><div class=content><p>{body}</p></div><main></main>{cards}</body>") == body
    # links of a marked article are its text, links around it are not
    refs = "<ul>" + "<li><a href=/r>Reference</a></li>" * 5 + "</ul>"
    page = f"<body><div><a href=/>Home</a> | <a href=/n>News</a></div><article><p>{body}</p>{refs}</article><div><a href=/m>More</a></div></body>"
    assert html.main_text(page) == body + " Reference" * 5
