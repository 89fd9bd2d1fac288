"""Queries against plain versions of their contracts, at the smallest size, and against SQL."""

import collections
import hashlib
import os
import re
import zlib

import duckdb
import numpy as np
import public_tokenizers
import pytest
from hypothesis import given, settings
from hypothesis import strategies as st
from tokenizers import Tokenizer

from siftwood.llm import html_text, jaccard_join, quality_rules, registry, token_counts, toxicity
from siftwood.llm.bpe_automaton import codec

SF = "/root/testdata/sf0.001"
BYTE = public_tokenizers.path("byte_bpe_50k.json")


@pytest.fixture(scope="module")
def duck():
    con = duckdb.connect()
    for f in os.listdir(SF):
        con.execute(f"CREATE VIEW {f.split('.')[0]} AS SELECT * FROM '{SF}/{f}'")
    return con


@pytest.fixture(scope="module")
def texts(duck):
    return dict(duck.execute("SELECT doc_id, coalesce(text, '') FROM documents").fetchall())


@pytest.mark.parametrize("name", sorted(registry.oracle_sql()))
def test_query_equals_sql(spark, duck, name):
    got, want = registry.queries()[name](spark, SF).toPandas(), duck.execute(registry.oracle_sql()[name]).df()
    columns = sorted(want.columns)
    assert sorted(got.columns) == columns
    rows = lambda x: sorted(map(str, x[columns].itertuples(index=False, name=None)))
    assert rows(got) == rows(want)


def test_ten_queries():
    assert sorted(int(re.match(r"op(\d+)_", n)[1]) for n in registry.queries()) == list(range(1, 11))


def test_sharding(spark, texts):
    rows = registry.queries()["op1_sharding"](spark, SF).toPandas()
    assert sorted(rows.doc_id) == sorted(texts)
    for r in rows.itertuples():
        assert (r.size, r.text_crc32) == (len(texts[r.doc_id].encode()) + 16, zlib.crc32(texts[r.doc_id].encode()))
    for _, g in rows.groupby("shard"):
        assert sorted(g.slot) == list(range(len(g)))
    sizes = rows.groupby("shard")["size"].sum()
    assert sizes.max() - rows["size"].sum() / 40 <= rows["size"].max()


def test_token_files(spark, texts):
    tok = Tokenizer.from_file(public_tokenizers.path("word_bpe_49k.json"))
    rows = {r.doc_id: r for r in registry.queries()["op6_token_files"](spark, SF).collect()}
    start = 0
    for d in sorted(texts):
        ids = [*tok.encode(texts[d], add_special_tokens=False).ids, 1]
        assert (rows[d].start, rows[d].n_tokens, rows[d].ids_crc32) == (start, len(ids), zlib.crc32(np.array(ids, "<u4").tobytes()))
        start += len(ids)


def test_bpe_queries_equal_library(spark, texts):
    """op9 and op10 over the whole table."""
    tok = _library()
    sha = lambda x: hashlib.sha256(x).hexdigest()
    codes = {r.doc_id: r for r in registry.queries()["op9_bpe_automaton"](spark, SF).collect()}
    counts = {r.doc_id: r for r in registry.queries()["op10_token_counts"](spark, SF).collect()}
    assert set(codes) == set(counts) == set(texts)
    for d, t in texts.items():
        ids = tok.encode(t, add_special_tokens=False).ids
        assert (codes[d].n_tokens, codes[d].ids_sha256, codes[d].decoded_sha256) == (len(ids), sha(np.array(ids, "<u4").tobytes()), sha(tok.decode(ids, skip_special_tokens=False).encode()))
        assert (counts[d].n_bytes, counts[d].n_tokens, counts[d].over_limit) == (len(t.encode()), len(ids), len(ids) > 1024)


def brute_components(sets: dict, percent: int = 85) -> dict:
    post, top = collections.defaultdict(list), {i: i for i in sets}

    def find(x):
        while top[x] != x:
            x = top[x]
        return x

    for i in sorted(sets):
        shared = collections.Counter(j for x in sets[i] for j in post[x])
        for x in sets[i]:
            post[x].append(i)
        for j, n in shared.items():
            if 100 * n >= percent * (len(sets[i]) + len(sets[j]) - n):
                a, b = sorted((find(i), find(j)))
                top[b] = a
    return {i: find(i) for i in sets}


def shingle_set(text: str, k: int = 4) -> set:
    w = re.findall(r"[^\x20\x09-\x0D]+", re.sub("[A-Z]", lambda m: m[0].lower(), text))
    return {tuple(w[i : i + k]) for i in range(len(w) - k + 1)} if len(w) >= k else {tuple(w)} if w else set()


def test_jaccard(spark, texts):
    sets = {d: shingle_set(t) for d, t in texts.items()}
    want = brute_components(sets)
    for r in registry.queries()["op8_jaccard_join"](spark, SF).collect():
        assert (r.n_shingles, r.component_id) == (len(sets[r.doc_id]), want[r.doc_id])


def test_jaccard_of_near_copies(spark):
    """Many borderline copies, shared passages, and ties: no link is lost."""
    rng = np.random.default_rng(7)
    word = lambda: f"w{rng.integers(3000)}"
    passage, rows = [word() for _ in range(60)], []
    for g in range(12):
        base = [word() for _ in range(int(rng.integers(20, 120)))] + (passage if g % 2 else [])
        for _ in range(int(rng.integers(2, 25))):
            copy = list(base)
            for _ in range(int(rng.integers(0, 5))):
                copy[int(rng.integers(len(copy)))] = word()
            rows.append((len(rows), " ".join(copy)))
    want = brute_components({d: shingle_set(t) for d, t in rows})
    got = {r.doc_id: r.component_id for r in jaccard_join.jaccard_components(spark.createDataFrame(rows, "doc_id long, text string")).collect()}
    assert got == want


@settings(max_examples=200, deadline=None)
@given(st.sets(st.integers(0, 60), min_size=1), st.sets(st.integers(0, 60), min_size=1))
def test_filters_lose_no_link(a, b):
    x, y = (np.array(sorted(v * 0x9E3779B97F4A7C15 % 2**64 for v in s), np.uint64) for s in (a, b))
    if 100 * len(a & b) >= 85 * len(a | b):
        assert jaccard_join.links(x, y)
        p, q = x[: jaccard_join.prefix_length(len(x))], y[: jaccard_join.prefix_length(len(y))]
        assert set(p) & set(q)
        assert jaccard_join.bitmaps_allow(jaccard_join.bitmap(x), jaccard_join.bitmap(y)[None, :], len(x), np.array([len(y)])).all()
    else:
        assert not jaccard_join.links(x, y)


def test_tile_pairs_equal_all_pairs():
    rng = np.random.default_rng(5)
    for _ in range(30):
        k = int(rng.integers(2, 40))
        n = np.sort(rng.integers(5, 12, k))
        gid = n * 10 + np.sort(rng.integers(0, 3, k))
        order = np.lexsort((gid, n))
        n, gid, comp, side = n[order], gid[order], rng.integers(0, 3, k), rng.integers(0, 2, k)
        pos = gid % 3 * (gid % 2)  # members of a group have the shingle in one place
        bits = np.zeros((k, jaccard_join.BITS), np.uint64)  # bitmaps that allow all
        for cross in (False, True):
            want = {(i, j) for i in range(k) for j in range(i + 1, k) if comp[i] != comp[j] and 100 * n[i] >= 85 * n[j] and (not cross or side[i] != side[j]) and 1 + min(n[i] - pos[i] - 1, n[j] - pos[j] - 1) >= jaccard_join.required(n[i], n[j])}
            got = jaccard_join.tile_pairs(side, gid, comp, n, pos, bits, cross)
            assert want == set(got) and len(set(got)) == len(got)


@pytest.mark.parametrize(("wanted", "together", "tile", "neighbours"), [(200_000, 20_000, 2048, None), (5, 4, 2, 1), (5, 20_000, 2048, 48)])
def test_jaccard_by_every_way(spark, monkeypatch, wanted, together, tile, neighbours):
    """Joins in place of broadcasts, split buckets and tiles, and no early links at all: the grouped prefix join finds every link itself."""
    monkeypatch.setattr(jaccard_join, "MOST_WANTED", wanted)
    monkeypatch.setattr(jaccard_join, "TOGETHER", together)
    monkeypatch.setattr(jaccard_join, "TILE", tile)
    if neighbours is None:
        monkeypatch.setattr(jaccard_join, "_near", lambda *_: spark.createDataFrame([], "u binary, v binary"))
    else:
        monkeypatch.setattr(jaccard_join, "NEIGHBOURS", neighbours)
    rng = np.random.default_rng(9)
    word = lambda: f"w{rng.integers(3000)}"
    passage, rows = [word() for _ in range(80)], []
    for g in range(6):  # a hot passage in most of them
        base = (passage if g else []) + [word() for _ in range(int(rng.integers(10, 60)))]
        for _ in range(int(rng.integers(5, 30))):
            copy = list(base)
            for _ in range(int(rng.integers(0, 5))):
                copy[int(rng.integers(len(copy)))] = word()
            rows.append((len(rows), " ".join(copy)))
    want = brute_components({d: shingle_set(t) for d, t in rows})
    docs = spark.createDataFrame(rows, "doc_id long, text string")
    assert {r.doc_id: r.component_id for r in jaccard_join.jaccard_components(docs).collect()} == want
    if wanted == 5 and neighbours == 48:
        assert {r.doc_id for r in jaccard_join.keep_one(docs).collect()} == set(want.values())


@settings(max_examples=300, deadline=None)
@given(st.text(alphabet=st.sampled_from("aaabehinot  \n\t'sldre019.,!?#<|>éßñ中😀　\x1c\x85́"), max_size=80))
def test_bpe_equals_library(text):
    tok = _library()
    want = tok.encode(text, add_special_tokens=False).ids
    ids = codec(BYTE).encode(text)
    assert ids == np.array(want, "<u4").tobytes()
    assert codec(BYTE).decode(ids) == tok.decode(want, skip_special_tokens=False)
    assert token_counts.counter(BYTE).counts([text]) == [len(want)]


_LIBRARY: list = []


def _library():
    if not _LIBRARY:
        _LIBRARY.append(Tokenizer.from_file(BYTE))
    return _LIBRARY[0]


@pytest.mark.parametrize("text", ["a" * 5000, "ab" * 3000, " " * 500, "the" * 2000, "<|endoftext|>", " <|endoftext|> a", "<|endoftext|", "aaa" * 7, "x  y   z\n \n  q", "it's we'll  I'd"])
def test_bpe_of_odd_texts(text):
    test_bpe_equals_library.hypothesis.inner_test(text)


def test_word_encoder_equals_library():
    from siftwood.llm.token_files import encoder

    path = public_tokenizers.path("word_bpe_49k.json")
    tok, e = Tokenizer.from_file(path), encoder(path)
    samples = ["The End. of,it", "Á É ß ẞ ΑΣ. Σ", "<|endoftext|> <|ENDOFTEXT|>", "x,. y.. 3. é. a1,", "\x1c a\x85b　c\xa0d", "İ K ſ", "it's I'LL", "", "  \n ", "123 4,5.6", "😀.,"]
    for text, ids in zip(samples, e.encode(samples), strict=True):
        assert np.frombuffer(ids, e.dtype).tolist() == tok.encode(text, add_special_tokens=False).ids, text


def test_pieces_without_ids_are_remembered_too():
    """A piece that the vocabulary maps to nothing, met again by the same encoder."""
    from siftwood.llm.token_files import WordEncoder

    e = WordEncoder(public_tokenizers.path("word_bpe_49k.json"))
    blanks = ["\u00a0", "a \u3000 b", "\u0085", "\u2028 x\u00a0"]
    want = [np.array(i.ids, e.dtype).tobytes() for i in e.library.encode_batch(blanks, add_special_tokens=False)]
    assert e.encode(blanks) == want == e.encode(blanks)


def test_word_encoder_composes_before_it_lowers():
    """Marks that make one letter with a small letter, but not with the capital."""
    from siftwood.llm.token_files import WordEncoder

    e = WordEncoder(public_tokenizers.path("word_bpe_49k.json"))
    for text in ["J\u030c", "xH\u0331y", "T\u0344", "W\u030a, THE", "Y\u030a.", "h\u0331 t\u0308", "I\u0307"]:
        assert np.frombuffer(e.encode([text])[0], e.dtype).tolist() == e.library.encode(text, add_special_tokens=False).ids, text


def test_word_encoder_asks_for_words_together():
    """New words go to the library many to a text, and marks behind them once."""
    from siftwood.llm.token_files import WordEncoder

    e = WordEncoder(public_tokenizers.path("word_bpe_49k.json"))
    library, asked = e.library, []

    class Library:
        def encode_batch(self, texts, **options):
            asked.extend(texts)
            return library.encode_batch(texts, **options)

        def encode_batch_fast(self, texts, **options):
            asked.extend(texts)
            return library.encode_batch_fast(texts, **options)

    e.library = Library()
    rng = np.random.default_rng(4)
    words = ["".join(rng.choice(list("abcdeghinorstuéßü"), int(rng.integers(3, 12)))) + "n" for _ in range(3000)]
    texts = [" ".join(words), " ".join(w + m for w in words for m in (".", "!!", "&&&", "")), ""]
    for ids, want in zip(e.encode(texts), library.encode_batch(texts, add_special_tokens=False), strict=True):
        assert np.frombuffer(ids, e.dtype).tolist() == want.ids
    assert len(asked) <= len(words) / 50


def test_word_encoder_in_small_blocks(monkeypatch):
    from siftwood.llm import token_files

    monkeypatch.setattr(token_files, "BLOCK", 7)
    monkeypatch.setattr(token_files, "TOGETHER", 3)
    e = token_files.WordEncoder(public_tokenizers.path("word_bpe_49k.json"))
    texts = ["", " \n", "one two three four five six seven eight. \u00a0 nine", "<|endoftext|>!! a,b 'say it's", "", "\u4e2d\u6587 x " * 9]
    for _ in range(2):
        for ids, want in zip(e.encode(texts), e.library.encode_batch(texts, add_special_tokens=False), strict=True):
            assert np.frombuffer(ids, e.dtype).tolist() == want.ids
    assert e.encode([]) == []


def test_compiled_automaton():
    """Every token that two tokens in a row may be is an arc exactly if the library keeps the two apart."""
    a, tok = codec(BYTE).automaton, _library()
    vocab = [t for t in tok.get_vocab() if t.isascii() and t.isalpha()]
    rng = np.random.default_rng(2)
    for u, v in zip(rng.choice(vocab, 2000), rng.choice(vocab, 2000), strict=True):
        i, j = tok.token_to_id(u), tok.token_to_id(v)
        if tok.encode(u, add_special_tokens=False).ids == [i]:
            assert a.arc(a.goal[i], j) == (tok.encode(u + v, add_special_tokens=False).ids == [i, j]), (u, v)


def test_repeated_words():
    words = [b"w%d" % i for i in range(30)]
    assert quality_rules.repeated_words(words) == 0
    assert quality_rules.repeated_words(words + words[:8]) == 16
    assert quality_rules.repeated_words([b"x"] * 9) == 9
    rng = np.random.default_rng(1)
    for _ in range(60):
        w = [b"%d" % x for x in rng.integers(0, 3, int(rng.integers(1, 60)))]
        n = collections.Counter(tuple(w[i : i + 8]) for i in range(len(w) - 7))
        want = len({j for i in range(len(w) - 7) if n[tuple(w[i : i + 8])] > 1 for j in range(i, i + 8)})
        assert quality_rules.repeated_words(w) == want


def test_html_marginals_equal_enumeration():
    """Sum-product on a small tree against all labellings."""
    import itertools
    import math

    parents, field, ties = [-1, 0, 0, 1, 1], [0.3, -1.0, 0.5, 2.0, -0.7], [0, 0.8, 0.4, 1.2, 0.1]
    breaks = [0, -0.4, 0.9, 0.3, 0.0]
    odds = html_text.propagate(parents, field, ties, breaks)[0]
    total = [[0.0, 0.0] for _ in parents]
    for y in itertools.product((0, 1), repeat=5):
        w = math.exp(sum(f for f, v in zip(field, y, strict=True) if v) + sum(ties[i] * (1 if y[i] == y[parents[i]] else -1) + breaks[i] * (y[i] < y[parents[i]]) for i in range(1, 5)))
        for i, v in enumerate(y):
            total[i][v] += w
    assert odds == pytest.approx([math.log(b / a) for a, b in total])


def test_html_text_of_articles(spark, duck):
    import html

    rows = {r.page_id: r for r in registry.queries()["op3_html_text"](spark, SF).collect()}
    for page, raw in duck.execute("SELECT page_id, html FROM pages").fetchall():
        body = re.search(r"<article>(.*?)</article>", raw, re.S)[1]
        blocks = (" ".join(html.unescape(re.sub(r"</?b>", "", b).replace("<br>", " ")).split()) for b in re.split(r"</?(?:p|h1)>", body))
        want = "\n\n".join(b for b in blocks if b)
        assert (rows[page].text, rows[page].n_chars) == (want, len(want))


PROSE = "Some main text that is here for long enough to be the text of a page, I think."


@pytest.mark.parametrize(
    ("raw", "want"),
    [
        ('<body><div class="topnav"><a href=x>Home</a></div><div id="content"><h1>T</h1><p>Some main text that is here for long enough to be the text of a page.</p><div class="sidebar"><p>Other things to read for a while.</p></div></div><div class="comments"><p>I like that one very much indeed.</p></div></body>', "T\n\nSome main text that is here for long enough to be the text of a page."),
        ('<body><header>Site name</header><main><p>First paragraph of the text is this one.</p><aside>Side remark.</aside><div class="newsletter-signup">Get our letter.</div><p>Second.</p></main><div class="cookie-banner">We use cookies.</div><footer>foot</footer>', "First paragraph of the text is this one.\n\nSecond."),
        (f"<body><p>{PROSE}</p></body>", PROSE),
        pytest.param(f"<div><p>{PROSE}</p></div>", PROSE, marks=pytest.mark.xfail(reason="a fragment of one box with one short paragraph is not taken for main text")),
        ("<article><table><tr><td>a cell</td><td>another</td></tr></table><p>x</p></article>", "a cell\n\nanother\n\nx"),
        (f'<article><h1>T</h1><p>{PROSE}</p><div class="warning">Careful.</div><div class="author-note"><p>A note.</p></div><p class="links">See there.</p></article>', f"T\n\n{PROSE}\n\nCareful.\n\nA note.\n\nSee there."),
        (f"<article><h1>T</h1><details><summary>Sum</summary><p>{PROSE}</p></details><noscript>Plain</noscript><p>as <math><mi>x</mi></math> <svg><text>y</text></svg></p><xmp><b>&amp;</xmp></article>", f"T\n\nSum\n\n{PROSE}\n\nPlain\n\nas x y\n\n<b>&amp;"),
        ("a plain text without tags", "a plain text without tags"),
        ("<article><p>a < b and c > d</p></article>", "a < b and c > d"),
        ("<article><h1>A &amp; B</h1><p>x<p>y &lt;b&gt;<br>z</article><form><p>sign up</p></form>", "A & B\n\nx\n\ny <b> z"),
    ],
)
def test_html_of_other_layouts(raw, want):
    assert html_text.main_text(raw, html_text.trained()) == want


def test_html_of_unseen_layouts():
    """Of labelled pages that were not in the fit: share of the text that is found, and of what is found that is text."""
    found, right = html_text.accuracy(html_text.labelled_pages(200, 10_000), html_text.trained())
    assert found >= 0.98 and right >= 0.97


@pytest.mark.parametrize("raw", ["<a " * 350_000, '<a ">' * 150_001, "<a '\">" * 150_001, "<div>" * 60_000 + "</p>" * 60_000, "<span>" * 60_000 + "<p>" * 30_000, "<!--" * 250_000, "<xmp>" * 100_000, "<" * 500_000, "<p a='" * 150_000])
def test_html_of_hostile_pages_takes_linear_time(raw):
    import time

    began = time.process_time()
    html_text.main_text(raw, html_text.trained())
    assert time.process_time() - began < 20


def test_deobfuscation(texts):
    counts = np.zeros(toxicity.SIZE**3, np.int64)
    for t in [*texts.values(), "idiot moron pathetic worthless stupid trash"]:
        c = toxicity.codes(f" {t} ")
        np.add.at(counts, c[:-2] * 4096 + c[1:-1] * 64 + c[2:], 1)
    reader = toxicity.Reader(toxicity.Channel(counts))
    for seen, want in (("1d10t", "idiot"), ("i.d.i.o.t", "idiot"), ("iiidddiot", "idiot"), ("m0r0n", "moron"), ("p@thet1c", "pathetic"), ("$tupid", "stupid")):
        assert want in reader.forms(seen), (seen, reader.forms(seen))
    assert "idiot" in reader.spaced("such an i d i o t here")


def test_toxicity_held_out(spark, duck):
    """Accuracy on rows whose labels were not learned."""
    sf = "/root/testdata/sf0.01"
    labels = dict(duck.execute(f"SELECT doc_id, max(toxic) FROM '{sf}/labels.parquet' GROUP BY 1").fetchall())
    rows = registry.queries()["op7_toxicity"](spark, sf).collect()
    assert all(r.held_out == (zlib.crc32(str(r.doc_id).encode()) % 3 == 1) for r in rows)
    seen = [(labels[r.doc_id], r.predicted) for r in rows if r.held_out and r.doc_id in labels]
    assert sum(a == b for a, b in seen) >= 0.95 * len(seen)
    assert sum(b for a, b in seen if a == 0) == 0
    assert sum(b for a, b in seen if a == 1) >= 0.7 * sum(a for a, _ in seen)


def test_pipeline_equals_stages_by_hand(spark):
    """The pipeline's rows against plain versions of the stages, but for the toxicity model, whose scores are taken as they are."""
    import corpus_pipeline as P

    docs = spark.read.parquet(f"{SF}/documents.parquet")
    left = {r.doc_id: r.text for r in P.toxicity(spark, docs, SF).collect()}
    kept = {}
    for d, t in left.items():
        m = dict(zip(quality_rules.MEASURES, quality_rules.measure(t or ""), strict=True))
        if not any(eval(rule, {}, m) for _, rule in quality_rules.RULES):
            kept[d] = t
    top = brute_components({d: shingle_set(t or "", 5) for d, t in kept.items()}, 80)
    kept = {d: t for d, t in kept.items() if top[d] == d or not shingle_set(t or "", 5)}
    words = lambda t: re.findall("[^\\x00-\\x2F\\x3A-\\x60\\x7B-\\x7F]+", re.sub("[A-Z]", lambda m: m[0].lower(), t or ""))
    windows = set()
    for (t,) in duckdb.sql(f"SELECT text FROM '{SF}/benchmark.parquet'").fetchall():
        w = words(t)
        windows |= {tuple(w[i : i + 13]) for i in range(max(1, len(w) - 12))} if w else set()
    for d in list(kept):
        w = words(kept[d])
        hit = {j for n in {len(x) for x in windows} for i in range(len(w) - n + 1) if tuple(w[i : i + n]) in windows for j in range(i, i + n)}
        if hit and 20 * len(hit) >= len(w):
            del kept[d]
    rows = P.run(spark, SF).collect()
    tok = _library()
    ids = {d: tok.encode(t or "", add_special_tokens=False).ids for d, t in kept.items()}
    sha = lambda x: hashlib.sha256(x).hexdigest()
    assert {(r.doc_id, r.n_tokens, r.ids_sha256, r.decoded_sha256) for r in rows} == {(d, len(i), sha(np.array(i, "<u4").tobytes()), sha(tok.decode(i, skip_special_tokens=False).encode())) for d, i in ids.items()}
    assert [n for n, _ in P.STAGES] == ["toxicity", "quality_rules", "ngram_jaccard_join", "decontamination", "bpe"]


@pytest.fixture(scope="module")
def reader(texts):
    counts = np.zeros(toxicity.SIZE**3, np.int64)
    for t in [*texts.values(), "idiot moron loser pathetic worthless disgusting stupid trash complete"]:
        c = toxicity.codes(f" {t} ")
        np.add.at(counts, c[:-2] * 4096 + c[1:-1] * 64 + c[2:], 1)
    return toxicity.Reader(toxicity.Channel(counts))


@pytest.mark.parametrize(("seen", "want"), [("stuupid", "stupid"), ("idiiot", "idiot"), ("moronn", "moron"), ("loserr", "loser"), ("sstupid", "stupid")])
def test_one_doubled_letter_is_restored(reader, seen, want):
    assert {seen, want} <= set(reader.forms(seen))


def spaced_finds(reader, text, *words):
    """Whether the text's features hold each word or its first five or six letters."""
    seen = reader.text_features(text)
    return all({f"={w}", f"^{w[:5]}", f"^{w[:6]}"} & seen for w in words)


def test_spaced_words_are_found_wherever_they_stand(reader):
    long = " ".join("patheticworthlessdisgusting")
    assert spaced_finds(reader, f"you are {long} you know", "pathetic", "worthless", "disgusting")
    assert spaced_finds(reader, "a s t u p i d", "stupid")
    assert spaced_finds(reader, "s t u p i d i d i o t", "stupid", "idiot")
    assert spaced_finds(reader, "s t u p i d   i d i o t!", "stupid", "idiot")
    assert spaced_finds(reader, "s  t  u  p  i  d", "stupid")
    assert spaced_finds(reader, "m - o - r - o - n and s\nt\nu\np\ni\nd", "moron", "stupid")
    assert spaced_finds(reader, f"{'x y z ' * 4000}i d i o t", "idiot")
    assert not spaced_finds(reader, "such a good day", "stupid")


def test_long_tokens_are_read(reader):
    assert spaced_finds(reader, "i" * 300 + "diot", "idiot")
    assert spaced_finds(reader, "you.are.a.complete.idiot.and.also.a.worthless.moron", "idiot", "moron", "worthless")
    assert spaced_finds(reader, "you_are_a_complete_1d10t_and_also_a_worthless_m0r0n", "idiot", "moron", "worthless")
    assert spaced_finds(reader, "you-are-an-idiot", "idiot")
    assert spaced_finds(reader, "thisisatextwithoutanyblanks" * 100 + "butyouareaworthlessidiot" + "andsoitgoeson" * 100, "idiot", "worthless")
    assert not spaced_finds(reader, "thisisatextwithoutanyblanks" * 100, "idiot")
    for at in (8100, 8170, 8185, 8200):  # across the ends of decoded pieces
        assert spaced_finds(reader, ("xyz" * 4000)[:at] + "disgusting" + "xyz" * 4000, "disgusting")


def test_pipeline_stage_links_from_80_percent_of_five_word_shingles(spark):
    import corpus_pipeline as P

    rng = np.random.default_rng(11)
    word = lambda: f"w{rng.integers(100_000)}"
    rows = []
    for i, added in enumerate([0, 50, 90, 100, 120, 124, 126, 150, 300]):  # 500 shingles, and a copy with words appended
        base = [word() for _ in range(504)]
        rows += [(10 * i, " ".join(base)), (10 * i + 1, " ".join(base + [word() for _ in range(added)]))]
    for i, changed in enumerate([5, 9, 10, 11, 12, 13, 20], 20):  # words changed within
        base = [word() for _ in range(504)]
        copy = list(base)
        for at in rng.choice(504, changed, replace=False):
            copy[at] = word()
        rows += [(10 * i, " ".join(base)), (10 * i + 1, " ".join(copy))]
    sets = {d: {tuple(t.split()[k : k + 5]) for k in range(len(t.split()) - 4)} for d, t in rows}
    linked = lambda a, b: 100 * len(a & b) >= 80 * len(a | b)
    gone = {d for d in sets if d % 10 and linked(sets[d - 1], sets[d])}
    assert 31 in gone and any(100 * len(sets[d - 1] & sets[d]) < 85 * len(sets[d - 1] | sets[d]) for d in gone)
    docs = spark.createDataFrame(rows, "doc_id long, text string")
    assert {r.doc_id for r in P.ngram_jaccard_join(spark, docs, SF).collect()} == set(sets) - gone
