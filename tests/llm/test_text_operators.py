"""License scans, pieces, URL filters, mixing and main text, with odd input and against plain versions."""

import hashlib
import html
import math
import re
import time
from collections import defaultdict

import numpy as np
import pytest
import sentencepiece
from hypothesis import given, settings
from hypothesis import strategies as st

from usagelens.llm import licenses as L
from usagelens.llm import main_text as M
from usagelens.llm import mixing, pieces, queries, url_filter
from usagelens.llm.licenses import Template


def words_of(text):
    lowered = re.sub("[A-Z]", lambda m: m[0].lower(), text or "")
    return re.findall("[^\x00-\x2f\x3a-\x60\x7b-\x7f]+", lowered)


def test_licenses(odd, texts):
    got = L.scan(odd).collect()
    assert len(got) == len(texts)
    by_id = defaultdict(list)
    for r in got:
        by_id[r.doc_id].append(r)
    for i, text in texts:
        if i is None:
            continue
        words, r = words_of(text), by_id[i][0]
        places = [(p, t.label) for t in L.BASE for p in range(len(words)) if words[p:p + len(t.words.split())] == t.words.split()]
        assert (r.n_words, r.n_base) == (len(words), len(places))
        assert (r.first_word, r.last_word) == ((min(places)[0], max(places)[0]) if places else (None, None))
        assert r.base_labels == ",".join(sorted({label for _, label in places}))
        assert set(filter(None, r.base_labels.split(","))) <= set(r.labels.split(",")) and 0 <= r.score <= 1
    assert by_id[11][0].base_labels == "apache-2,cc-by-nc,mit" and len(by_id[11]) == 2
    assert (by_id[15][0].n_base, by_id[15][0].first_word, by_id[15][0].last_word) == (3, 0, 8)
    assert by_id[16][0].labels == "mit" and by_id[16][0].base_labels == "" and 0.8 <= by_id[16][0].score < 1  # one word differs
    assert by_id[4][0].labels == "" and by_id[4][0].score == 0


def test_licenses_of_nothing_and_bad_templates(none):
    assert L.scan(none).collect() == []
    with pytest.raises(ValueError):
        L.scan(none, (Template("too short", "x"),))
    with pytest.raises(ValueError):
        L.scan(none, ())


def test_a_word_put_in_moves_to_the_next_diagonal(spark):
    notice = L.NOTICES[4].words.split()
    docs = spark.createDataFrame([(1, " ".join([*notice[:4], "so called", *notice[4:]])), (2, " ".join(notice[:3]))], "doc_id long, text string")
    voted = L.votes(docs, (L.NOTICES[4],))
    assert voted.filter("doc_id = 1").count() == 2
    assert [r.doc_id for r in L.spans(voted, cover=0.5).collect()] == [1]
    assert L.spans(voted, gap=0, cover=0.6).count() == 0


@pytest.fixture(scope="module")
def words():
    return pieces.Words(queries.piece_model())


def test_the_word_table_keeps_no_long_words(words, library):
    text = "short " + "字" * 5_000 + " short"
    assert np.frombuffer(words.encode(text)[0], dtype=np.int32).tolist() == library.encode(text)
    assert "▁short" in words and max(map(len, words)) <= pieces.LONG_WORD


@pytest.fixture(scope="module")
def library():
    return sentencepiece.SentencePieceProcessor(model_file=queries.piece_model())


@given(st.text(st.sampled_from(list("abc \n\t▁é́\u00a0\u3000日😀<>0\r\x00ﬁＡ.")), max_size=60) | st.text(max_size=40))
@settings(max_examples=400, deadline=None)
def test_ids_and_decoding_are_the_librarys(words, library, text):
    code, decoded = words.encode(text)
    ids = library.encode(text)
    assert list(memoryview(code).cast("i")) == ids and decoded == library.decode(ids)


def test_table_is_bounded(library):
    few = pieces.Words(queries.piece_model(), 10)
    text = " ".join(f"w{i} again" for i in range(100))
    assert few.separable and list(memoryview(few.encode(text)[0]).cast("i")) == library.encode(text) and len(few) <= 10


def test_pieces(odd, none, texts, library):
    got = pieces.digests(pieces.encode(odd, queries.piece_model()), "ids").collect()
    assert len(got) == len(texts)
    wanted = defaultdict(set)
    for i, t in texts:
        ids = library.encode(t or "")
        wanted[i].add((len(ids), hashlib.sha256(",".join(map(str, ids)).encode()).hexdigest(), hashlib.sha256(library.decode(ids).encode()).hexdigest()))
    assert all((r.n_tokens, r.ids_sha256, r.decoded_sha256) in wanted[r.doc_id] for r in got)
    assert pieces.encode(none, queries.piece_model()).collect() == []


URLS = [(1, None, "x"), (2, "", "x"), (3, "no scheme", "x"), (4, "http://A.Example.COM/en/x?y#z", "x"), (5, "http://www.example.com/en/", "x"), (6, "http://x.net/fr", "x"),
        (7, "http://x.net/fr/", "x"), (8, "x://y://z.com/", "x"), (9, "http://com", "x"), (10, "http://example.com/en/" + "a/" * 30_000, "x"), (4, "http://A.Example.COM/en/x?y#z", "x"),
        (None, "http://notexample.com/en/", "x"), (11, "http://x.net:80/es/", "x"), (12, "http:///fr/", "x")]


def plain_verdict(url):
    rest = url.split("://", 1)[1] if url and "://" in url else ""
    host = re.match("[^/?#]*", rest)[0]
    path = re.match("[^?#]*", rest[len(host):])[0]
    host = "".join(c.lower() if "A" <= c <= "Z" else c for c in host)
    fit = [(len(h + p), h + p, v) for h, p, v in queries.URL_RULES if (host == h or host.endswith("." + h)) and path.startswith(p)]
    best = max(fit, default=(0, None, "allow"))
    return host, path, best[1], best[2]


def test_url_filter(spark):
    pages = spark.createDataFrame(URLS, "page_id long, url string, verdict string")
    rules = spark.createDataFrame(list(queries.URL_RULES), "host string, path string, verdict string")
    got = sorted(map(tuple, url_filter.judge(pages, rules).collect()), key=repr)
    assert got == sorted(((i, *plain_verdict(u)) for i, u, _ in URLS), key=repr)
    assert url_filter.judge(pages.limit(0), rules).collect() == []
    assert {r.verdict for r in url_filter.judge(pages, rules.limit(0), default="block").collect()} == {"block"}


def test_url_rules_of_any_length_and_ties(spark):
    pages = spark.createDataFrame([(1, "http://a.bb.cc/xyz"), (2, "http://bb.cc/xq")], "page_id long, url string")
    rules = spark.createDataFrame([("bb.cc", "/xy", "allow"), ("a.bb.cc", "/", "block"), ("bb.cc", "/xq", "allow"), ("bb.cc", "/xq", "block"), ("cc", "", "block")],
                                  "host string, path string, verdict string")
    assert {(r.page_id, r.rule, r.verdict) for r in url_filter.judge(pages, rules).collect()} == {(1, "a.bb.cc/", "block"), (2, "bb.cc/xq", "block")}


def plain_targets(sizes):
    names = sorted(sizes, key=lambda s: (s is None, s or ""))
    weight = {s: (3.0, 1.0, 2.0)[i % 3] for i, s in enumerate(names)}
    total, capped = 1.5 * sum(sizes.values()), set()
    while True:
        rest = [s for s in names if s not in capped]
        level = (total - sum(2 * sizes[s] for s in capped)) / sum(weight[s] for s in rest) if rest else 0
        above = {s for s in rest if weight[s] * level > 2 * sizes[s]}
        if not above:
            return {s: 2.0 * sizes[s] if s in capped else weight[s] * level for s in names}
        capped |= above


def test_mixing(odd, none, texts):
    got = mixing.mix(odd)
    found = got.collect()
    assert len(found) == len(texts) and sorted(map(repr, found)) == sorted(map(repr, got.collect()))
    sizes = defaultdict(int)
    for r in found:
        sizes[r.source] += r.size
    wanted = plain_targets(sizes)
    for r in found:
        assert r.target == pytest.approx(wanted[r.source]) and r.source_size == sizes[r.source] and r.taken == r.copies * r.size and 0 <= r.copies <= 2
    assert sorted((r.doc_id or 0, r.size) for r in found) == sorted((i or 0, len(re.findall("[^\x20\x09-\x0d]+", t or ""))) for i, t in texts)
    assert mixing.mix(none).collect() == [] and mixing.mixed_documents(none).columns == none.columns
    assert mixing.mixed_documents(odd).columns == odd.columns


def test_mix_comes_near_its_targets(spark):
    rows = [(i, "w " * (1 + i * i % 97), "hot" if i % 3 else f"s{i % 7}") for i in range(3000)]
    taken, target = defaultdict(int), {}
    for r in mixing.mix(spark.createDataFrame(rows, "doc_id long, text string, source string")).collect():
        taken[r.source] += r.taken
        target[r.source] = r.target
    assert all(abs(taken[s] - target[s]) <= 97 for s in target)
    assert math.isclose(sum(target.values()), 1.5 * sum(1 + i * i % 97 for i in range(3000)))


PAGE = """<!DOCTYPE html><html><head><title>No</title><style>p{}</style><script>var a = "<p>no</p>";</script></head><body class="has-sidebar">
<header><div>Site name</div></header><nav><a href=/>Home</a></nav><div class="cookie-notice">We use cookies, accept, please.</div>
<div id="wrap"><main><div class="sidebar"><p>See also this, and that.</p></div><article class="post"><header><h1>A &amp; B&nbsp;title</h1></header>
<p>First   paragraph with a <a href="x">link</a>, and
<b>bold</b> text; it is long enough, surely.</p><p>Short.<ul><li>One item<li>Two items</ul><blockquote>Quoted words, here.</blockquote>
<div class="ad">Buy now, cheap!</div><form><input><label>Mail</label></form><aside>Aside text.</aside><p style="display: none">Hidden</p>
<p>Last paragraph, with an end &lt;tag&gt;.</p><footer>Written by me</footer></article><section id="comments"><article class="comment"><p>Nice, really nice text, thanks a lot.</p></article></section>
</main></div><!-- gone --><footer>&copy; all</footer></body></html>"""


def test_main_text():
    assert M.main_text(PAGE).split("\n") == [
        "A & B title", "First paragraph with a link, and bold text; it is long enough, surely.", "Short.", "One item", "Two items", "Quoted words, here.",
        "Last paragraph, with an end <tag>."]
    plain = "<div class=nav><a href=1>One</a> <a href=2>Two</a> <a href=3>Three</a></div><div id=content><h1>Head</h1><div>" \
            "<p>Some text, with marks; and more of it.</p><p>Other text, with marks, too.</p></div></div><div class=footer>Foot, note.</div>"
    assert M.main_text(plain).split("\n") == ["Head", "Some text, with marks; and more of it.", "Other text, with marks, too."]


ARTICLE = "<article><h1>Head</h1><p>Some text, with marks; and more of it.</p></article>"


@pytest.mark.parametrize("start", ["<html><head><title>No</title><body>", "<head><meta charset=utf-8><title>No</title>", "<head><noscript><img src=x></noscript><title>No</title>",
                                   "<head><script>var a = '<body>';</script><body>", "<title>No</title>", "<head><template><div>No</div></template></head>"])
def test_main_text_without_head_end_or_body(start):
    assert M.main_text(start + ARTICLE).split("\n") == ["Head", "Some text, with marks; and more of it."]
    assert M.main_text("<head><title>No</title>\n Bare text.") == "Bare text."


REFERENCES = "".join(f"<li><a href={i}>Author {i}, a paper with a long title, in a journal.</a></li>" for i in range(4))


@pytest.mark.parametrize("tag", ["article", "main"])
def test_lists_of_links_inside_the_article_stay(tag):
    page = f"<body><{tag}><h1>Head</h1><p>Some text, with marks; and more of it.</p><ul>{REFERENCES}</ul></{tag}></body>"
    assert M.main_text(page).split("\n") == ["Head", "Some text, with marks; and more of it.", *(f"Author {i}, a paper with a long title, in a journal." for i in range(4))]


def test_a_page_of_links_keeps_its_text_and_loses_its_menu():
    menu = "<ul>" + "".join(f"<li><a href={i}>Go {i}</a></li>" for i in range(4)) + "</ul>"
    text = M.main_text(f"<body>{menu}<div><h1>Papers</h1><ul>{REFERENCES}</ul></div></body>")
    assert "Author 3, a paper with a long title, in a journal." in text and "Go 1" not in text
    story = "<p>Some text, with marks; and more of it, and more.</p>" * 3
    assert "Go 1" not in M.main_text(f"<body>{menu}{story}{menu}</body>")


@pytest.mark.parametrize("markup", ["", " ", "<", "<p", "</div></div>", "<!--", "plain text", "<script>", "<p>" * 3000, "&#0; &#xD800; &bogus;", "<svg/><p>x"])
def test_broken_markup_has_some_text(markup):
    assert isinstance(M.main_text(markup), str)
    assert M.main_text("plain  text") == "plain text"


@given(st.lists(st.sampled_from(["<p>", "</p>", "<div class=ad>", "</div>", "<article>", "</article>", "word, word. ", "<ul><li>", "<b>", "&lt;", "<table><tr><td>", "\n"]), max_size=40))
@settings(max_examples=100, deadline=None)
def test_any_markup_is_read(parts):
    text = M.main_text("".join(parts))
    assert all(line == line.strip() and line for line in text.split("\n")) or text == ""


def test_main_text_of_odd_rows(spark):
    pages = spark.createDataFrame([(1, None, None, "c"), (None, "u", "", "c"), (2, "u", "<p>" + "é, " * 200_000, "c"), (2, "u", "<p>x.", "c"), (2, "u", "<p>x.", "c")],
                                  "page_id long, url string, html string, text string")
    got = M.extract(pages).collect()
    assert sorted((r.page_id or 0, r.n_chars) for r in got) == [(0, 0), (1, 0), (2, 2), (2, 2), (2, 599_999)]
    assert M.extract(pages.limit(0)).collect() == []


def test_article_of_every_given_page(spark, folder):
    """The given pages hold their text in one article of paragraphs."""
    for r in queries.table(spark, folder, "pages").collect():
        inner = re.search("<article>(.*?)</article>", r.html, re.S)[1]
        parts = [" ".join(html.unescape(re.sub("<[^>]*>", " ", re.sub("</?b>", "", p))).split()) for p in re.split("</?(?:p|h1)>", inner)]
        assert M.main_text(r.html) == "\n".join(p for p in parts if p)




def test_a_million_words_take_time_in_proportion(spark):
    """One text of many distinct words, and one twice as long, with a phrase at its end."""
    took = []
    for n in (500_000, 1_000_000):
        docs = spark.createDataFrame([(1, " ".join(f"w{i}" for i in range(n)) + " under the MIT license")], "doc_id long, text string")
        start = time.time()
        r = L.scan(docs).collect()[0]
        took.append(time.time() - start)
        assert (r.n_words, r.n_base, r.first_word) == (n + 4, 1, n)
    assert took[1] < 4 * took[0] + 5 and took[1] < 60


EIGHT = "".join(f"<p>Paragraph {i} says a lot, with commas, and ends at last.</p>" for i in range(8))
TOLD = [f"Paragraph {i} says a lot, with commas, and ends at last." for i in range(8)]


@pytest.mark.parametrize("page,before,after", [
    (f"<body><h1>Title</h1><p>A lead</p><div>{EIGHT}</div></body>", ["Title", "A lead"], []),
    (f"<body><div><p>A lead.</p><div>{EIGHT}</div><p>The end.</p></div></body>", ["A lead."], ["The end."]),
    (f"<body><p>First, some text.</p><font>{EIGHT}", ["First, some text."], []),
    (f"<body><div id=wrap><p>First words, of the text.</p><i>{EIGHT}</div>", ["First words, of the text."], []),
    (f"<body><article><h1>T</h1>{EIGHT}<section class=search><h2>How search works</h2><p>It looks, and finds.</p></section><div class=header>Chapter two</div>"
     "<div id=related-work>Others did so, before.</div></article>", ["T"], ["How search works", "It looks, and finds.", "Chapter two", "Others did so, before."]),
    (f"<body><div class=share><a href=1>Tell</a> <a href=2>all</a></div><h1>T</h1><div class=ad>Buy this.</div><p>Lead.</p><div>{EIGHT}</div><div class=footer>Foot.</div><p>c</p>",
     ["T", "Lead."], []),
    (f"<body><div id=a>{EIGHT}</div><div id=b><p>Another column that has its own words, here.</p></div></body>", [], []),
    (f"<body><article>{EIGHT}<div class=comments><p>A reader says a lot, with commas, and more of it, and more.</p></div></article>", [], []),
    (f"<body><nav>n</nav><header>Site</header>{EIGHT}<form><p>Your name, please, and more.</p><input></form><aside>x</aside></body>", [], [])])
def test_nothing_else_is_dropped(page, before, after):
    assert M.main_text(page).split("\n") == [*before, *TOLD, *after]


@pytest.mark.parametrize("tag", ["i", "div", "p", "li", "td"])
def test_deep_pages_take_seconds(tag):
    start = time.time()
    text = M.main_text(f"<{tag}>word, more. " * 100_000)
    assert time.time() - start < 30 and text.count("word, more.") == 100_000
    assert M.main_text("</b>".join(["<i>x "] * 50_000) + "</i>" * 50_000).count("x") == 50_000
