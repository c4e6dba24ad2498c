"""Joins, passages, leaks, tokens and pages against brute force."""

import hashlib
import re
import zlib
from collections import Counter, defaultdict

import numpy as np
import pytest
from chainspan.llm import decontamination, html, jaccard, substrings, tokens
from chainspan.llm.queries import TOKENIZER
from tokenizers import Tokenizer

from tests.llm.conftest import MESSY, documents

WORD = re.compile(r"[^\x20\x09-\x0D]+")


def brute_links(rows):
    """Of each (id, text): the smallest id of its class and its number of links, by comparing all pairs."""
    sets = []
    for _, t in rows:
        w = WORD.findall(t or "")
        sets.append({tuple(w[i : i + 5]) for i in range(max(1, len(w) - 4))} if w else set())
    root, links = list(range(len(rows))), [0] * len(rows)

    def top(x):
        while root[x] != x:
            x = root[x]
        return x

    for a in range(len(rows)):
        for b in range(a):
            both = len(sets[a] & sets[b])
            if both and 5 * both >= 4 * (len(sets[a]) + len(sets[b]) - both):
                links[a] += 1
                links[b] += 1
                root[max(top(a), top(b))] = min(top(a), top(b))
    return [top(k) for k in range(len(rows))], links


def edited(rng, words, n):
    w = list(words)
    for k in rng.choice(len(w), n, replace=False):
        w[k] = f"new{rng.integers(10**6)}"
    return " ".join(w)


def test_jaccard_join_against_all_pairs(spark, small, monkeypatch):
    rng = np.random.default_rng(3)
    base = [f"w{i}" for i in rng.integers(0, 5000, 120)]
    rows = [(10_000 + i, edited(rng, base, int(rng.integers(0, 4)))) for i in range(120)]
    rows += [(20_000 + i, rows[0][1]) for i in range(30)] + [(r.doc_id, r.text) for r in small.collect()]
    rows.sort()
    monkeypatch.setattr(jaccard, "BLOCK_NODES", 32)  # so that the group is verified block by block
    got = {r.doc_id: r for r in jaccard.similar(documents(spark, [(i, t, "a") for i, t in rows])).collect()}
    top, links = brute_links(rows)
    assert [got[i].n_links for i, _ in rows] == links
    assert [got[i].class_id for i, _ in rows] == [rows[t][0] for t in top]


@pytest.mark.parametrize("crowd", [64, 8])  # below and above what the passage puts into one bucket
def test_jaccard_join_behind_a_shared_passage(spark, monkeypatch, crowd):
    rng = np.random.default_rng(5)
    shared = [f"s{i}" for i in range(90)]
    rows = []
    for k in range(400):  # pages of one template, alike to a half, and near copies of some
        own = [f"o{k}x{i}" for i in range(40)]
        rows.append((k, " ".join(shared + own)))
        if k % 8 == 0:
            rows.append((1000 + k, " ".join(shared + own[:28] + [f"p{k}x{i}" for i in range(12)])))
    monkeypatch.setattr(jaccard, "BUCKET_NODES", crowd)
    got = {r.doc_id: r for r in jaccard.similar(documents(spark, [(i, t, "a") for i, t in rows])).collect()}
    top, links = brute_links(rows)
    assert sum(links) == 100 and [got[i].n_links for i, _ in rows] == links
    assert [got[i].class_id for i, _ in rows] == [rows[t][0] for t in top]


def test_jaccard_join_edge_cases(messy, empty):
    rows = jaccard.similar(messy).collect()
    assert len(rows) == len(MESSY)
    of = defaultdict(list)
    for r in rows:
        of[r.doc_id].append((r.class_id, r.n_links))
    assert of[1] == [(1, 0)] and of[2] == [(2, 0)] and of[3] == [(3, 0)] and of[5] == [(5, 2)] and sorted(of[6]) == [(5, 2), (5, 2), (6, 0)]
    assert of[7] == [(7, 1)] and of[8] == [(7, 1)]
    kept = jaccard.one_of_each(messy)
    assert kept.columns == messy.columns
    assert Counter(r.doc_id for r in kept.collect()) == Counter([None, None, 1, 2, 3, 4, 5, 6, 7, -9])
    assert jaccard.similar(empty).count() == 0 and jaccard.one_of_each(empty).count() == 0


def test_prefix_length_follows_recall():
    sure, unsure = [(8, 1.0, 50)], [(3, 0.8, 50), (8, 1.0, 1)]
    assert jaccard.depth_for(sure, 0.99) == 8 and jaccard.depth_for([(5, 0.8, 990), (8, 0.99, 10)], 0.99) == 5
    assert jaccard.depth_for(unsure, 0.999) < 6 and jaccard.depth_for([], 0.99) == jaccard.SHORTEST


@pytest.mark.parametrize("recall", [0.9, 0.99, 0.999, 0.9999])
def test_prefix_length_holds_recall_at_the_threshold(recall):
    d = jaccard.prefix_for(recall)
    assert 1 - (1 - 0.8**d) ** jaccard.TREES >= recall
    assert d == jaccard.DEPTH or 1 - (1 - 0.8 ** (d + 1)) ** jaccard.TREES < recall


def test_forest_meets_pairs_at_the_threshold_at_every_length():
    rng = np.random.default_rng(7)
    a = rng.integers(0, 65536, (4000, jaccard.TREES * jaccard.DEPTH)).astype(np.uint64)
    b = np.where(rng.random(a.shape) < 0.8, a, rng.integers(0, 65536, a.shape).astype(np.uint64))
    for depth, trees in jaccard.levels(0.999):
        (short, long), (other, _) = jaccard.prefixes(a, depth, trees), jaccard.prefixes(b, depth, trees)
        assert (short == other).any(axis=1).mean() >= 0.997
        # A longer prefix of the same tree, in the next level's words: equal ones have equal shorter ones.
        assert ((long == jaccard.prefixes(b, depth, trees)[1]) <= (short == other)).all()
        assert all(len(set(p)) == depth + jaccard.STEP for p in jaccard.paths(trees, depth + jaccard.STEP).tolist())


def test_crowded_buckets_of_half_alike_pages_keep_longer_prefixes(spark, monkeypatch):
    monkeypatch.setattr(jaccard, "BUCKET_NODES", 32)
    rng = np.random.default_rng(11)
    base = rng.integers(0, 65536, 128)
    loose = [np.where(rng.random(128) < 0.5**0.5, base, rng.integers(0, 65536, 128)) for _ in range(600)]
    tight = [np.where(rng.random(128) < 0.97, base + 1, rng.integers(0, 65536, 128)) for _ in range(60)]
    rows = [(k, bytearray(x.astype("<u2").tobytes())) for k, x in enumerate(loose + tight)]
    nodes = spark.createDataFrame(rows, "node long, sig binary")
    here, crowded = jaccard.level(nodes, *jaccard.levels(0.999)[0], False)
    gone = {r.node for r in crowded.collect()}
    assert len(gone) > 300 and max(gone) < 600  # pages of the template; near copies are worked on where they are
    assert here.filter("n > 32").agg({"node": "min"}).first()[0] >= 600
    last, crowded = jaccard.level(nodes, *jaccard.levels(0.999)[2], True)
    assert crowded.isEmpty() and last.filter("node < 600 and n > 32").isEmpty()


def brute_passages(rows, n=20):
    seen, out = set(), []
    for i, t in rows:
        w = WORD.findall(t or "")
        gone = [False] * len(w)
        for k in range(len(w) - n + 1):
            key = tuple(w[k : k + n])
            if key in seen:
                gone[k : k + n] = [True] * n
            seen.add(key)
        kept = " ".join(x for x, g in zip(w, gone, strict=True) if not g)
        out.append((i, len(w), sum(gone), hashlib.sha256(kept.encode()).hexdigest()))
    return out


@pytest.mark.parametrize("chars", [8_000_000, 20_000, 500])
def test_passages_against_all_runs(small, chars):
    rows = sorted((r.doc_id, r.text) for r in small.collect())
    got = substrings.parsed(small, chunk_chars=chars, block_runs=2_000).select("doc_id", "n_words", "n_removed", "kept_sha256").collect()
    assert sorted(map(tuple, got)) == brute_passages(rows)


def test_passages_edge_cases(spark, messy, empty):
    found = substrings.parsed(messy).collect()
    assert len(found) == len(MESSY) and substrings.parsed(empty).count() == 0
    by_id = {r.doc_id: r for r in found if r.doc_id not in (None, 6)}
    assert by_id[1].n_words == 0 and by_id[1].kept_sha256 == hashlib.sha256(b"").hexdigest()
    assert by_id[7].n_removed == 26_000 and [tuple(s) for s in by_id[7].spans] == [(4000, 30_000)]
    assert by_id[8].n_removed == 30_000 and by_id[8].kept == "end"
    words = [f"x{i}" for i in range(60)]
    rows = [(1, " ".join(words[:30])), (2, " ".join(words[30:])), (3, " ".join(words)), (4, " ".join(words[:19])), (5, " ".join(words[10:50]))]
    got = substrings.parsed(documents(spark, [(i, t, "a") for i, t in rows])).select("doc_id", "n_words", "n_removed", "kept_sha256").collect()
    assert sorted(map(tuple, got)) == brute_passages(rows)


def test_decontamination(spark, small, messy, empty):
    bench = spark.read.parquet("/root/testdata/sf0.001/benchmark.parquet")
    flat = lambda t: f" {' '.join(re.findall(r'\w+', (t or '').lower()))} "
    items = {r.item_id: flat(r.text) for r in bench.collect()}
    want = {r.doc_id: sorted(i for i, t in items.items() if t in flat(r.text)) for r in small.collect()}
    got = {r.doc_id: list(r["items"]) for r in decontamination.judged(small, bench).collect()}
    assert got == want and any(want.values())
    assert decontamination.cleaned(small, bench).count() == sum(not v for v in want.values())
    assert decontamination.judged(messy, bench).filter("not contaminated").count() == len(MESSY)
    assert decontamination.cleaned(messy, bench).columns == messy.columns
    assert decontamination.judged(empty, bench).count() == 0 and decontamination.judged(small, bench.limit(0)).filter("contaminated").count() == 0


def test_decontamination_of_other_parameters(spark):
    ask = "If {a} has {n} apples and buys 30 kg of pears for {n} dollars each morning, how many will {a} carry home today?".format
    bench = spark.createDataFrame([(0, ask(a="Tom", n=12)), (1, None), (2, ""), (3, "too short"), (0, ask(a="Tom", n=12))], "item_id long, text string")
    texts = [
        "Well then. " + ask(a="Anna", n=7) + " Yes.", ask(a="Anna", n=7).replace("7 dollars", "8 dollars"), ask(a="Anna", n=7).replace("will Anna", "will Bert"),
        "The weather was fine, and nobody had asked for apples or pears that morning when we came home.", ask(a="Anna", n=30),
    ]
    rows = decontamination.judged(documents(spark, [(i, t, "a") for i, t in enumerate(texts)]), bench).collect()
    # Two values of the item may meet one of the document, not the other way round.
    assert {r.doc_id: r.contaminated for r in rows} == {0: True, 1: False, 2: False, 3: False, 4: True}


def test_decontamination_of_items_dense_in_numbers(spark):
    dense = "Add 3 4 5 6 7 8 9 then name the sum of all these"
    bench = spark.createDataFrame([(0, dense), (1, "1 2 3 4 5 6 7 8 9 10 11 12 13 14"), (2, "Osmium density 22.59")], "item_id long, text string")
    other = dense.replace("3 4 5 6 7 8 9", "13 14 15 16 17 18 19")
    texts = [f"So. {dense} now.", "see 1 2 3 4 5 6 7 8 9 10 11 12 13 14 end", "the osmium density 22.59 is high", "2 3 4 5 6 7 8 9 1 10 11 12 13 14", "the osmium density 22.6", f"So. {other} now."]
    rows = decontamination.judged(documents(spark, [(i, t, "a") for i, t in enumerate(texts)]), bench).collect()
    assert {r.doc_id: list(r["items"]) for r in rows} == {0: [0], 1: [1], 2: [2], 3: [], 4: [], 5: [0]}


def test_decontamination_of_a_copy_with_one_name_changed(spark):
    item = "The report says that Smith wrote the first part of the long paper while he stayed at home, and later on Smith added all of the tables that readers know so well today."
    bench = spark.createDataFrame([(0, item)], "item_id long, text string")
    texts = [item, item.replace("on Smith", "on Jones"), item.replace("that Smith", "that Jones"), item.replace("Smith", "Jones")]
    rows = decontamination.judged(documents(spark, [(i, t, "a") for i, t in enumerate(texts)]), bench).collect()
    assert {r.doc_id: r.contaminated for r in rows} == {0: True, 1: True, 2: True, 3: True}


def test_decontamination_of_short_sentences_about_someone_else(spark):
    ask = "{a} has {x} apples. {a} buys {y} more. {a} eats {z}. How many apples does {a} have?".format
    bench = spark.createDataFrame([(0, ask(a="Tom", x=5, y=3, z=2))], "item_id long, text string")
    other = ask(a="Anna", x=9, y=4, z=6)
    texts = [other, f"Well. {other} Yes", f"well {other.lower()}", other.replace("Anna eats", "Bert eats"), ask(a="Tom", x=5, y=3, z=2), "Tom has a dog. It eats apples."]
    rows = decontamination.judged(documents(spark, [(i, t, "a") for i, t in enumerate(texts)]), bench).collect()
    assert {r.doc_id: r.contaminated for r in rows} == {0: True, 1: True, 2: False, 3: False, 4: True, 5: False}


@pytest.mark.parametrize("which", ["small", "messy"])
def test_token_files_round_trip(spark, small, messy, which):
    docs = {"small": small, "messy": messy}[which]
    folder = tokens.write(docs, TOKENIZER)
    plain = Tokenizer.from_file(TOKENIZER)
    ids = [(r.doc_id, [*plain.encode(r.text or "", add_special_tokens=False).ids, 2]) for r in docs.collect()]
    ids.sort(key=lambda x: (x[0] is not None, x[0] or 0, len(x[1])))
    want, start = [], 0
    for i, x in ids:
        want.append((i, start, len(x), zlib.crc32(np.array(x, "<u4").tobytes())))
        start += len(x)
    got = [tuple(r) for r in tokens.index(spark, folder).collect()]
    assert Counter(got) == Counter(want)
    d, s, n, _ = want[-1]
    one = tokens.document(spark, folder, d).collect()
    assert [(r.doc_id, r.start, [x & 0xFFFFFFFF for x in r.ids]) for r in one] == [(d, s, ids[-1][1])]


def test_token_files_of_nothing_and_of_a_wrong_dictionary(spark, empty):
    assert tokens.index(spark, tokens.write(empty, TOKENIZER)).count() == 0
    with pytest.raises(ValueError):
        tokens._decompressor(b"x", "0")


def test_pieces_have_the_ids_of_the_whole():
    e = tokens.Encoder(TOKENIZER)
    texts = ["a  b\n\n c \td\te  ", "", " ", "it's 'quoted' 3,000 kg!!", "x<|endoftext|> y", "\x1c a\x1c!b \x85 c", "　wide space s  \n"]
    assert [x.tolist() for x in e.encode(texts)] == e.raw(texts)


PAGE = """<html><head><title>t</title><style>p{}</style><script>var a="</p>";</script></head><body><header>Site</header><div id="page-header">Top</div><p style="display: none">Unseen</p><nav><ul><li>Menu</ul></nav>
<div class="cookie-notice">We use cookies to make this very long notice longer than the article itself, really.</div><aside><p>Side</p></aside>
<article><h1>A  title</h1><p>First &amp; <b>bold</b>&nbsp;text<br>after.<p>Second.<div class="ad"><p>Buy</p></div><ul><li>one<li>two</ul><form><input value=x>Name</form></article>
<section id="comments"><p>What a nice article, I liked it so much that I write a long comment.</p></section><footer>&copy; all</footer></body></html>"""


def test_main_text(spark):
    pages = [(1, "u", PAGE, 5), (2, None, None, 5), (3, "u", "", 5), (4, "u", "<p>no article<p>but <i>text</i> &lt;here&gt;", 5), (5, "u", "<article><p>cut off &am", 5), (None, "u", "plain", 5), (6, "u", "<nav>only menu", 5), (1, "u", PAGE, 5)]
    df = spark.createDataFrame(pages, "page_id long, url string, html string, text int")
    got = html.extract(df).collect()
    assert Counter((r.page_id, r.text) for r in got) == Counter(
        {
            (1, "A title\n\nFirst & bold text after.\n\nSecond.\n\none\n\ntwo"): 2, (2, ""): 1, (3, ""): 1, (4, "no article\n\nbut text <here>"): 1, (5, "cut off &am"): 1, (None, "plain"): 1, (6, ""): 1,
        }
    )
    assert all(r.n_chars == len(r.text) for r in got) and html.extract(df.limit(0)).count() == 0
    assert len(html.main_text("<p>" + "x <b>y</b> " * 50_000)) == 4 * 50_000 - 1


@pytest.mark.parametrize("wrapper", ["div class='layout has-sidebar'", "div id='no-ads'", "section class='search-result'", "form action=x", "div class=header"])
def test_main_text_inside_marked_wrappers(wrapper):
    tag, ad = wrapper.split()[0], "<div class=ad><p>Buy</section></div>"
    wrap = lambda x: f"<html><body><{wrapper}>{x}</{tag}><p>Foot</body></html>"
    comments = "<section id=comments><article>A comment</article></section>"
    assert html.main_text(wrap(f"<article><h1>A</h1><p>Text.{ad}<p>More.</article>{comments}")) == "A\n\nText.\n\nMore."
    assert html.main_text(wrap(f"<div><p>Most of the text stands here.{ad}</div>")).startswith("Most of the text stands here.")
    assert html.main_text(f"<article>Story</article><{wrapper}><p>Something longer than the story</{tag}>") == "Story"


LONG_TEXT = "This is a long paragraph of the story with many plain words in it. " * 3


def blocks(*texts):
    return "\n\n".join(t.strip() for t in texts)


def test_main_text_keeps_what_marks_only_hint_at():
    page = """<article><h1>T</h1><p>One plain paragraph here.<p class='share-price'>The share price rose.<p class='search-history'>The history of search.
    <div class='widget-review'><p>A review of it.</div><section id='related-work'><p>Others did too.</section><div class='related-posts share'><p>Read on</div></article>"""
    assert html.main_text(page) == blocks("T", "One plain paragraph here.", "The share price rose.", "The history of search.", "A review of it.", "Others did too.")
    for name in ("login-story", "login"):
        assert html.main_text(f"<main><div class='{name}'><p>{LONG_TEXT}</div></main>") == LONG_TEXT.strip()
    links = "<div class='related-reading'><a href=1>One</a> <a href=2>Two</a></div>"
    assert html.main_text(f"<article><p>{LONG_TEXT}{links}</article>") == LONG_TEXT.strip()


def test_main_text_of_several_regions():
    p = f"<p>{LONG_TEXT}"
    assert html.main_text(f"<main><h1>Head</h1><p>Lead.</p><article>{p}</article><article>{p}<p>short end</article></main>") == blocks("Head", "Lead.", LONG_TEXT, LONG_TEXT, "short end")
    assert html.main_text(f"<main><h1>Head</h1><article>{p}</article></main><div><p>Foot</div>") == blocks("Head", LONG_TEXT)
    assert html.main_text(f"<article>{p}</article><article>{p}</article><article>tiny</article>") == blocks(LONG_TEXT, LONG_TEXT)


def test_main_text_without_article_or_main():
    p, menu = f"<p>{LONG_TEXT}", "<div class='topbar-links'><a href=1>Home</a> <a href=2>News</a></div>"
    most = "<div class='most-read'><ul><li><a href=1>First thing</a><li><a href=2>Second</a></ul></div><p>All rights reserved"
    want = blocks("Head", LONG_TEXT, "Short.", LONG_TEXT)
    assert html.main_text(f"<body>{menu}<div class=story><h1>Head</h1>{p}<p>Short.</p>{p}</div>{most}</body>") == want
    assert html.main_text(f"<body>{menu}<h1>Head</h1>{p}<p>Short.</p>{p}{most}</body>") == want
    assert html.main_text(f"<body>{menu}<div><div>{p}</div><div>{p}</div><div>{p}</div></div>{most}</body>") == blocks(LONG_TEXT, LONG_TEXT, LONG_TEXT)
    assert html.main_text(f"<body>{menu}</body>") in ("Home News", "")


def test_pages_of_the_small_table(spark):
    from html import unescape

    for r in spark.read.parquet("/root/testdata/sf0.001/pages.parquet").collect():
        inner = re.search("<article>(.*)</article>", r.html, re.S)[1]
        blocks = [" ".join(unescape(re.sub("<[^>]*>", " ", b)).split()) for b in re.split("</?(?:p|h1)>", inner)]
        assert html.main_text(r.html) == "\n\n".join(b for b in blocks if b)


def test_rolling_hashes_are_sums_of_powers():
    from chainspan.llm import common

    rng = np.random.default_rng(3)
    for size in (0, 1, 7, 8, 300, common._STRETCH + 30, 2 * common._STRETCH + 5):
        h = rng.integers(0, 1 << 63, size, dtype=np.uint64)
        for n in (1, 5, 8, 20):
            places = np.arange(max(0, size - n + 1))
            assert (common.rolling(h, n) == common.rolling_at(h, n, places)).all()


def test_words_whose_checksums_meet_stay_apart(spark):
    """Both CRC-32 and Adler-32 of these two numbers are equal."""
    around = [f"w{i}" for i in range(24)]
    one, two = (" ".join([*around[:12], x, *around[12:]]) for x in ("4412669624", "4506283835"))
    docs = documents(spark, [(1, one, "a"), (2, two, "a"), (3, one, "a")])
    assert {r.doc_id: r.n_removed for r in substrings.parsed(docs).collect()} == {1: 0, 2: 0, 3: 25}
    long = " ".join(f"v{i}" for i in range(24))
    pair = documents(spark, [(1, long + " 4412669624", "a"), (2, long + " 4506283835", "a")])
    # 20 of 22 shingles are equal; each text has one of its own.
    assert {r.doc_id: r.n_links for r in jaccard.similar(pair).collect()} == {1: 1, 2: 1}
    assert len(set(common_hashes(["4412669624", "4506283835"]))) == 2


def common_hashes(words):
    from chainspan.llm.common import strong_word_hashes

    return strong_word_hashes(" ".join(words)).tolist()
