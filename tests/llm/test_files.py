"""WARC archives, HTML text, token counts and packing against brute-force versions."""

import base64
import hashlib
import random
import re
import time
import zlib

import numpy as np
import pytest

from sessionloom.llm import htmltext, packing, tokens, warc

PAGES = "page_id long, url string, html string, record_type string, extra int"


def chain(data):
    """Records of one archive by a sequential reader."""
    at, out = 0, []
    while at < len(data):
        head_end = data.index(b"\r\n\r\n", at) + 4
        fields = dict(line.split(": ", 1) for line in data[at:head_end].decode().split("\r\n")[1:] if line)
        stop = head_end + int(fields["Content-Length"])
        out.append((at, fields["WARC-Type"], fields["WARC-Record-ID"]))
        assert data[stop : stop + 4] == b"\r\n\r\n"
        at = stop + 4
    return out


def expected(pages):
    first = {}
    for p, _, h, *_ in pages:
        first[h or ""] = min(first.get(h or "", p), p)
    rows = set()
    for p, _, h, *_ in pages:
        data = (h or "").encode()
        mine = first[h or ""] == p
        rows.add((p, len(data), base64.b32encode(hashlib.sha1(data).digest()).decode(), "response" if mine else "revisit", None if mine else first[h or ""]))
    return rows


@pytest.fixture
def pages():
    fake = "WARC/1.1\r\nWARC-Type: response\r\nWARC-Record-ID: <urn:page:99>\r\nContent-Length: 5\r\n\r\nhello\r\n\r\n"
    bodies = ["", None, "<p>é</p>", fake * 3, "x" * 5000 + fake + "WARC/1.WARC/1.0\r\n", "WARC/1.", "same", "same", "tail\r\n\r\n", fake + "y" * 9000 + fake]
    rows = [(i, f"http://x/{i}\r\n", b, "clash", 1) for i, b in enumerate(bodies * 4, 1)]
    return rows + [(-5, None, "same", "clash", 1)]


@pytest.mark.parametrize("split", ["128m", "700b"])
def test_warc_round_trip(spark, tmp_path, pages, split):
    path = str(tmp_path / "warc")
    spark.conf.set("spark.sql.files.maxPartitionBytes", split)
    spark.conf.set("spark.sql.files.openCostInBytes", "1b")
    try:
        warc.write(spark.createDataFrame(pages, PAGES).repartition(2), path)
        found = warc.read(spark, path)
        assert set(map(tuple, warc.page_rows(found).collect())) == expected(pages)
        files = {f.name: chain(f.read_bytes()) for f in (tmp_path / "warc").glob("part-*")}
        got = {(r["file"].rsplit("/")[-1], r["offset"], r["record_type"], r["record_id"]) for r in found.collect()}
        assert got == {(f, *r) for f, rows in files.items() for r in rows}
    finally:
        spark.conf.unset("spark.sql.files.maxPartitionBytes")
        spark.conf.unset("spark.sql.files.openCostInBytes")


def test_warc_empty_table_and_cut_file(spark, tmp_path, pages):
    warc.write(spark.createDataFrame([], PAGES), str(tmp_path / "none"))
    assert warc.read(spark, str(tmp_path / "none")).count() == 0
    warc.write(spark.createDataFrame(pages, PAGES).coalesce(1), str(tmp_path / "one"))
    whole = next((tmp_path / "one").glob("part-*")).read_bytes()
    (tmp_path / "cut").mkdir()
    starts = [r[0] for r in chain(whole)]
    (tmp_path / "cut" / "a").write_bytes(whole[: starts[7] - 2])
    (tmp_path / "cut" / "b").write_bytes(b"junk" + whole)
    assert sorted(r["offset"] for r in warc.read(spark, str(tmp_path / "cut")).collect()) == starts[:6]


CASES = [
    (None, ""),
    ("", ""),
    ("just text", "just text"),
    ("<p>a &amp; b&nbsp;<b>c</b>\n d</p>", "a & b c d"),
    ("<nav>menu</nav><article><h1>T</h1><p>one<p>two <i>three</i></article><footer>f</footer>", "T\none\ntwo three"),
    ("<article><header>h</header><p>text<form>f<input></form><div class='user-comments'>bad</div></article>", "text"),
    ("<body><div class='ad'>buy</div><div><p>" + "long text " * 30 + "</p><p>short</p></div><div id='sidebar'>s</div><script>var a='<p>x</p>'</script>", ("long text " * 30).strip() + "\nshort"),
    ("<article><p>cut off <b>here", "cut off here"),
    ("<article><p>a<br>b</article></html>", "a\nb"),
    ("<script>only", ""),
    ("<div class='page with-sidebar'><div class=sidebar>s</div><article><p>kept</article><p>beside</div>", "kept"),
    ("<article><p>a</p><section id='comments'><article class='comment'><p>bad</p></article></section></article><p>out", "a"),
    ("<main><p class=notice>no<p>yes<ul><li class=ad>no<li>item</ul></main>", "yes\nitem"),
    ("<main><p>m</p><p hidden>no</p></main>", "m"),
    ("<main><p>one <span hidden>no</span>two<script>x</script>three</main>", "one twothree"),
]


@pytest.mark.parametrize("html, text", CASES)
def test_html_cases(html, text):
    assert htmltext.main_text(html) == text


LONG = "long text of it " * 40
CELLS = "<table>" + "".join(f"<tr><td>cell {i}a</td><td>cell {i}b</td></tr>" for i in range(6)) + "</table>"
WHOLE = [
    f"<h1>Title</h1>{f'<p>{LONG}</p>' * 6}{CELLS}",
    f"<section><p>{LONG}</p><p>{LONG}</p></section><section><h2>Short</h2><p>end</p></section>",
    f"<p>{LONG}</p><div><ul><li>one<li>two</ul></div><p>{LONG}</p>",
]


@pytest.mark.parametrize("inner", WHOLE)
@pytest.mark.parametrize("tag", ["article", "main", "div"])
def test_html_keeps_whole_article(inner, tag):
    beside = "".join(f"<div><a href=x>link {i}</a></div>" for i in range(9))
    words = " ".join(re.sub("<[^>]*>", " ", inner).split())
    got = " ".join(htmltext.main_text(f"<body>{beside}<{tag}>{inner}</{tag}>{beside}").split())
    assert words in got and "link 4" not in got


@pytest.mark.parametrize(
    "wrapper",
    ["div class='page with-sidebar'", "div class='container navbar-fixed'", "div class='widget Blog'", "div id=main class='has-comments'", "article class='post has-comments'", "div role=banner"],
)
def test_html_marked_wrappers(wrapper):
    tag = wrapper.split()[0]
    inner = f"<div class=sidebar><p>side words</p></div><p>{LONG}</p><p>end</p><div class=comments><p>{LONG * 3}bad</p></div>"
    assert htmltext.main_text(f"<body><{wrapper}>{inner}</{tag}><div class=footer>foot</div>") == f"{LONG.strip()}\nend"


def test_html_all_marked():
    assert htmltext.main_text("<div class=sidebar><p>one two</p></div><div class=promo><p>one two</p></div>") == "one two\none two"
    assert htmltext.main_text("<div class='comments'><p>one two</p></div>") == ""


def test_html_whole_article_in_body():
    got = htmltext.main_text(f"<body><p>{LONG}</p>{CELLS}<section><p>end</p></section><div><a href=x>link</a></div>")
    assert got.split("\n") == [LONG.strip(), *re.findall("cell [0-9][ab]", CELLS), "end"]


def test_html_pages(spark, sf_dir):
    import html as entities

    def brute(page):
        inner = re.search(r"<article>(.*?)(</article>|$)", page, re.S)[1]
        parts = [" ".join(entities.unescape(re.sub("<[^>]*>", "", x)).split()) for x in re.split(r"</?(?:p|h1|br)[^>]*>", inner)]
        return "\n".join(p for p in parts if p)

    pages = {r["page_id"]: r["html"] for r in spark.read.parquet(f"{sf_dir}/pages.parquet").collect()}
    rows = htmltext.op4_html(spark, sf_dir).collect()
    assert len(rows) == len(pages)
    assert all(r["text"] == brute(pages[r["page_id"]]) and r["n_chars"] == len(r["text"]) for r in rows)


def test_html_marks_are_for_containers():
    article = (
        "<article><h1 class='post-header ad'>Title</h1><p class='search-result'>one</p><div class='related'>two</div>"
        "<p>a <label>named</label> word</p><div class='notice'>no</div><p class='ad'>no</p><table class='wide'><tr><td>x<td>y</table></article>"
    )
    assert htmltext.main_text(article) == "Title\none\ntwo\na named word\nx\ny"


def unmarked_pages(sf_dir, spark):
    """The pages without any mark: menu, advert, article and footer are divs without names."""
    for r in spark.read.parquet(f"{sf_dir}/pages.parquet").collect():
        page = re.sub(r"<(/?)(article|nav|footer|aside|header)\b[^>]*>", r"<\1div>", r["html"]).replace('<div class="ad">', "<div>")
        yield r["html"], page


def test_html_ratios_choose_regions(spark, monkeypatch):
    """Without marks the ratios alone find the article; without the threshold every page has other text."""
    pages = list(unmarked_pages("/root/testdata/sf0.01", spark))
    marked = [htmltext.main_text(a) for a, _ in pages]
    found = [htmltext.main_text(b) for _, b in pages]
    assert all(w in g for w, g in zip(marked, found, strict=True) if len(w) > 150)
    assert sum(w == g for w, g in zip(marked, found, strict=True)) >= 0.95 * len(pages)
    long = [(w, g) for w, g in zip(marked, found, strict=True) if len(w) > 2000]
    assert sum(w == g for w, g in long) >= 0.8 * len(long)
    monkeypatch.setattr(htmltext, "_threshold", lambda smooth: 0.0)
    without = [htmltext.main_text(b) for _, b in pages]
    assert sum(a != b for a, b in zip(found, without, strict=True)) >= 0.9 * len(pages)


def test_html_articles_are_compared(monkeypatch):
    teasers = "".join(f"<article><a href=/x>teaser {i} of something</a> <b>x</b></article>" for i in range(5))
    page = f"{teasers}<article><h1>T</h1><p>{LONG}</p><p>end</p></article>{teasers}"
    assert htmltext.main_text(page) == f"T\n{LONG.strip()}\nend"
    monkeypatch.setattr(htmltext, "_threshold", lambda smooth: 0.0)
    assert "teaser 3" in htmltext.main_text(page)


def brute_text(html):
    """Blocks of the one article by the rules of the contract, over a plain tag list."""
    import html as entities

    inner = re.search(r"<article>(.*?)(</article>|$)", html, re.S)[1]
    inner = re.sub(r"<(script)\b.*?</\1>", "", inner, flags=re.S)
    inner = re.sub(r"<(form|nav|aside)\b.*?</\1>", "<p>", inner, flags=re.S)
    parts = re.split(r"</?(?:p|h1|h2|br|table|tr|td|th|ul|li|section|div|pre)\b[^>]*>", inner)
    parts = [" ".join(entities.unescape(re.sub("<[^>]*>", "", x)).split()) for x in parts]
    return "\n".join(p for p in parts if p)


def test_html_articles_keep_all_blocks():
    rng = random.Random(11)
    block = [
        lambda: f"<p>{'word &amp; ' * rng.randint(1, 80)}</p>", lambda: "<section><h2>Short</h2><p>x</p></section>", lambda: "<table><tr><td>Name<td>Age<tr><td>Ann<td>7</table>",
        lambda: "<ul><li>one<li>two <b>three</b></ul>", lambda: "<div><div>deep&nbsp; text</div></div>", lambda: "<form>f<input></form>", lambda: "<nav>n</nav>", lambda: "<pre>a\n b</pre>",
        lambda: "<aside>s</aside>", lambda: "<script>var x='<p>';</script>", lambda: "line<br>break",
    ]
    for _ in range(300):
        page = "<nav>menu</nav><article><h1>T</h1>" + "".join(rng.choice(block)() for _ in range(rng.randint(0, 12))) + "</article><footer>f</footer>"
        assert htmltext.main_text(page) == brute_text(page), page


def test_html_table_edges(spark):
    long = "<article>" + "<p>some text &amp; more</p>" * 40_000 + "</article>"
    rows = [(1, "u", None, "c", 5), (None, None, "<p>x</p>", "c", 5), (2, "u", "", "c", 5), (3, "u", long, "c", 5), (3, "u", "<p>same</p>", "c", 5), (3, "u", "<p>same</p>", "c", 5)]
    df = spark.createDataFrame(rows, "page_id long, url string, html string, text string, n_chars int")
    got = sorted(((str(r["page_id"]), r["url"], len(r["text"]), r["n_chars"]) for r in htmltext.extract(df).collect()), key=str)
    n = 40_000 * len("some text & more\n") - 1
    assert got == [("1", "u", 0, 0), ("2", "u", 0, 0), ("3", "u", 4, 4), ("3", "u", 4, 4), ("3", "u", n, n), ("None", None, 1, 1)]
    assert htmltext.extract(df.limit(0)).count() == 0


@pytest.mark.parametrize(
    ("inner", "text"),
    [
        ('<p>First.</p><svg class="i"/><p>Second.</p>', "First.\nSecond."),
        ('<p>one <svg viewBox="0"><path d="x"/><style/><title>no</title></svg>two</p>', "one two"),
        ('<p>a <math/> b</p><svg/><svg/><p>c</p>', "a b\nc"),
        ("<table><tr><td hidden>x<td>cell two<tr><td>three<td hidden>y<tr><th hidden>z<th>four</table>", "cell two\nthree\nfour"),
        ("<table><thead hidden><tr><td>x<tbody><tr><td>one<tfoot><tr><td>two</table>", "one\ntwo"),
        ("<table><tr><td hidden>x<table><tr><td>in it</table>y<td>shown</table>", "shown"),
        ("<dl><dt hidden>x<dt>term<dd hidden>x<dd>dd two</dl><p>end", "term\ndd two\nend"),
        ("<ul><li hidden>x<ul><li>in it</ul><li>two</ul>", "two"),
        ("<form><select><option>x<option>y</select></form><p>end", "end"),
        ('<section class="comments-policy"><p>Be kind.</p></section><p>end</p>', "Be kind.\nend"),
        ('<div class="menu-item">soup of the day</div><div class="menu-item"><a href=/x>soup</a></div>', "soup of the day"),
        ('<blockquote class="alert">a quoted warning</blockquote><blockquote class="alert"><a href=x>more</a></blockquote>', "a quoted warning"),
        ('<div class="ad-slot">buy</div><div id="comment-list"><p>nice</p></div><div class="cookie-notice">ok</div><p>end</p>', "end"),
        ('<div class="notice-board"><b>1</b> <b>2</b> <b>3</b> <b>4</b></div><p>end</p>', "end"),
    ],
)
def test_html_inside_an_article(inner, text):
    assert htmltext.main_text(f"<nav>menu</nav><article>{inner}</article><footer>f</footer>") == text


def layouts(rng):
    """(page, article text): menus, adverts and footers without telling names around articles of many shapes, most without an article tag."""
    words = lambda n: " ".join(rng.choice(["soup", "of", "the", "day", "and", "more", "words", "that", "tell"]) for _ in range(n))
    link = lambda: f"<a href=/{rng.randint(1, 99)}>{words(rng.randint(1, 3))}</a>"
    for _ in range(200):
        paragraphs = [words(rng.randint(30, 90)) for _ in range(rng.randint(2, 6))]
        menu = f"<div><ul>{''.join(f'<li>{link()}</li>' for _ in range(rng.randint(3, 9)))}</ul></div>"
        advert = f"<div>{words(rng.randint(3, 9))}</div>"
        foot = f"<div>{words(rng.randint(3, 12))} {link()} {link()}</div>"
        shape = rng.randrange(5)
        if shape == 0:
            body = f"<div>{''.join(f'<p>{p}</p>' for p in paragraphs)}</div>"
        elif shape == 1:
            body = f"<div><div>{''.join(f'<p>{p}' for p in paragraphs)}</div></div>"
        elif shape == 2:
            body = f"<table><tr><td>{'<br>'.join(paragraphs)}</table>"
        elif shape == 3:
            body = f"<div><section>{''.join(f'<p>{p}</p>' for p in paragraphs)}</section></div>"
        else:
            teasers = "".join(f"<article>{link()} <b>x</b></article>" for _ in range(4))
            menu, body = menu + teasers, f"<article>{''.join(f'<p>{p}</p>' for p in paragraphs)}</article>"
        yield f"<body>{menu}{advert}{body}{foot}</body>", "\n".join(paragraphs)


def test_html_layouts_need_the_ratios(monkeypatch):
    pages = list(layouts(random.Random(4)))
    assert sum(htmltext.main_text(page) == text for page, text in pages) >= 0.95 * len(pages)
    monkeypatch.setattr(htmltext, "_ratio", lambda text, tags, linked: 1.0)
    assert sum(htmltext.main_text(page) == text for page, text in pages) <= 0.2 * len(pages)


def test_html_stray_ends_are_cheap():
    begin = time.time()
    page = "<div>" * 3000 + "<section>" * 3000 + "x</span></b></td>" * 20_000 + "<li>y" * 20_000
    assert htmltext.main_text(page).count("y") == 20_000 and time.time() - begin < 5


def test_html_deep_nesting():
    assert htmltext.main_text("<div>" * 3000 + "deep" + "</div>" * 3000) == "deep"


@pytest.fixture(scope="module")
def library():
    return tokens.load(tokens.vocabulary())


def random_texts(n, alphabet, longest, seed):
    rng = random.Random(seed)
    return ["".join(rng.choice(alphabet) for _ in range(rng.randint(0, longest))) for _ in range(n)]


ALPHABET = [*"ab A1é́ \n\t'.!<|>  \x85\x1c日🙂ſK", "<|endoftext|>", "<|startoftext|>", " ", " "]


def test_overlap_resynchronisation(library):
    rng = random.Random(1)
    texts = random_texts(800, ALPHABET, 120, 2)
    found = [tokens.count_batch(library, [t], rng.randint(1, 30), rng.randint(0, 12)) for t in texts]
    assert [n for (n,), _ in found] == [len(library.encode(t, add_special_tokens=False).ids) for t in texts]
    assert sum(k for _, (k,) in found) > 500


def test_normalised_outside_the_library(library):
    """Latin-1 texts and all others, special tokens in either case, every white space: as the library counts them."""
    counter = tokens.Counter(tokens.vocabulary())
    assert counter.bare is not None and counter.normalised("É\x85B") == "é b" and counter.normalised("a <|ENDOFTEXT|>") is None and counter.normalised("ſ") is None
    latin = [chr(c) for c in range(256)]
    texts = [s for c in latin for s in (c, f"a{c}b", f" {c} {c}{c} ", f"1{c}2'{c}s")] + random_texts(3000, [*latin, *ALPHABET, "<|ENDOFTEXT|>"], 40, 7)
    want = [len(e) for e in library.encode_batch(texts, add_special_tokens=False)]
    assert counter.counts(texts)[0] == want and counter.counts(texts, 7, 3)[0] == want


def test_chunks_are_widened(library):
    for text in ("x" * 5000, "a b " + "yz1" * 2000 + " c d" * 300, "é" * 3000 + " " + "q" * 3000 + " end", "\x85" * 2000 + "a " * 900):
        for chunk, overlap in ((100, 0), (100, 30), (1000, 5)):
            assert tokens.count_batch(library, [text], chunk, overlap)[0] == [len(library.encode(text, add_special_tokens=False).ids)]


def test_splice_needs_the_same_token_in_both(library):
    text = "one two three four"
    left, right = (library.encode(t, add_special_tokens=False) for t in (text[:13], text[4:]))
    assert tokens.splice(text, left, 0, 13, right, 4) == (2, 1)
    assert tokens.splice("x" * 18, left, 0, 13, right, 4) is None


def test_documents_go_through_splices(spark, library):
    """Brute force over a whole table: every count, and long documents are spliced, not encoded whole."""
    docs = spark.read.parquet("/root/testdata/sf0.01/documents.parquet").select("doc_id", "text").collect()
    rows = {r["doc_id"]: r for r in tokens.op5_tokens(spark, "/root/testdata/sf0.01").collect()}
    assert len(rows) == len(docs)
    for doc_id, text in docs:
        r = rows[doc_id]
        assert r["n_tokens"] == len(library.encode(text or "", add_special_tokens=False).ids)
        assert r["n_splices"] <= len(text or "") // tokens.CHUNK and (r["n_splices"] > 0 or len(text or "") < 2 * tokens.CHUNK or " " not in text)
    assert sum(r["n_splices"] > 0 for r in rows.values()) >= 100


def test_token_counts(spark, library, monkeypatch):
    texts = [None, "", *random_texts(200, ALPHABET, 200, 3), "word " * 40_000, "x" * 3000, "a b" * 700]
    df = spark.createDataFrame([(i, t, 7) for i, t in enumerate(texts)], "doc_id long, text string, n_tokens int")
    rows = {r["doc_id"]: r for r in tokens.count_tokens(df.unionByName(df.limit(1)), tokens.vocabulary()).collect()}
    for i, t in enumerate(texts):
        n = len(library.encode(t or "", add_special_tokens=False).ids)
        assert (rows[i]["n_tokens"], rows[i]["n_bytes"], rows[i]["over_limit"]) == (n, len((t or "").encode()), n > 2048)
    assert tokens.count_tokens(df.limit(0), tokens.vocabulary()).count() == 0


def test_encoder_equals_library(spark):
    encoder = packing.Encoder(tokens.vocabulary("byte_bpe_50k.json"))
    seam = [chr(c) for c in range(0x250)]
    texts = [s for c in seam for s in (c, f"a{c}b", f"1{c}2", f" {c} ", f"  {c}  a{c}", f"{c} 's {c}'{c}")]
    texts += random_texts(2000, [*ALPHABET, *seam], 60, 4)
    texts += [r["text"] or "" for r in spark.read.parquet("/root/testdata/sf0.01/documents.parquet").select("text").collect()]
    for text, ids in zip(texts, encoder.ids(texts), strict=True):
        assert ids.tolist() == encoder.library.encode(text, add_special_tokens=False).ids


def test_harmonic_classes():
    """A bin of class k holds k documents whole or their rests, and at most what closes its gap beside them."""
    rng = random.Random(6)
    lengths = [rng.choice([1, 3, 30, 300, 700, 1023, 1024, 1025, 2000, 2048, 5000, rng.randint(1, 2500)]) for _ in range(3000)]
    bins, rows = packing.Bins(0), []
    for i, n in enumerate(lengths):
        rows += bins.add(i, np.arange(n, dtype="<u4"))
    before_rest = {r[5] for r in rows}
    rows += bins.rest()
    by: dict = {}
    for r in rows:
        by.setdefault(r[5], []).append(r)
    for sequence in before_rest:
        pieces = sorted(by[sequence], key=lambda r: r[6])
        ends = [r for r in pieces if r[1] + r[2] == r[4]]  # pieces that end their document
        assert sum(r[2] for r in pieces) == 2048
        k = 2048 // pieces[0][2]
        assert all(2048 // r[2] == k for r in pieces[:k]) and len(ends) >= k - (pieces[0][2] == 2048)
    assert len(rows) <= sum(1 + n // 2048 for n in lengths) + 2 * len(by)
    assert sorted((i, x) for i, at, n, *_ in rows for x in range(at, at + n)) == [(i, x) for i, n in enumerate(lengths) for x in range(n)]


def assert_packed(rows, texts, library):
    """Every id of every (doc_id, text) lies in one piece, and all sequences are gapless and full or a power of two long."""
    pieces, bins = {}, {}
    for r in rows:
        pieces.setdefault(r["doc_id"], []).append(r)
        bins.setdefault(r["sequence_id"], []).append((r["offset"], r["length"]))
    assert pieces.keys() == {i for i, _ in texts}
    for i, t in texts:
        ids = np.array([*library.encode(t or "", add_special_tokens=False).ids, 1], "<u4")
        at = 0
        for r in sorted(pieces[i], key=lambda r: r["start"]):
            assert r["start"] == at and r["doc_tokens"] == len(ids)
            assert r["ids_crc32"] == zlib.crc32(ids[at : at + r["length"]].tobytes())
            at += r["length"]
        assert at == len(ids)
    for found in bins.values():
        at = 0
        for offset, length in sorted(found):
            assert offset == at
            at += length
        assert at <= 2048 and at & (at - 1) == 0  # full, or a power of two: no padding


def test_packing(spark):
    path = tokens.vocabulary("byte_bpe_50k.json")
    texts = [None, "", "one", "word " * 5000, *random_texts(60, ALPHABET, 900, 5)]
    df = spark.createDataFrame([(i, t, 1, 2) for i, t in enumerate(texts)], "doc_id long, text string, start int, length int").repartition(3)
    assert_packed(packing.pack(df, path).collect(), list(enumerate(texts)), tokens.load(path))
    assert packing.pack(df.limit(0), path).count() == 0


def test_packing_of_documents(spark):
    docs = [tuple(r) for r in spark.read.parquet("/root/testdata/sf0.01/documents.parquet").select("doc_id", "text").collect()]
    rows = packing.op9_packing(spark, "/root/testdata/sf0.01").collect()
    assert_packed(rows, docs, tokens.load(tokens.vocabulary("byte_bpe_50k.json")))
    assert len(rows) <= 2.5 * len(docs)  # cut only where padding demands it


def test_repeated_rows_are_packed_each(spark):
    df = spark.createDataFrame([(1, "same text")] * 3, "doc_id long, text string").coalesce(1)
    rows = packing.pack(df, tokens.vocabulary("byte_bpe_50k.json")).collect()
    assert sum(r["length"] for r in rows) == 3 * rows[0]["doc_tokens"]


@pytest.mark.parametrize("split", ["128m", "700b"])
def test_warc_magic_in_header(spark, tmp_path, split):
    urls = ["http://x/WARC/1.0/spec", "http://x/WARC/1.WARC/1.1", "WARC/1.", "http://x/plain", "http://x/" + "WARC/1.0/" * 200, "http://x/" + "y" * 1500 + "/WARC/1.1"]
    rows = [(i, u, f"body {i % 7} WARC/1.1\r\nA: WARC/1.", "clash", 1) for i, u in enumerate(urls * 4, 1)]
    path = str(tmp_path / "warc")
    spark.conf.set("spark.sql.files.maxPartitionBytes", split)
    spark.conf.set("spark.sql.files.openCostInBytes", "1b")
    try:
        warc.write(spark.createDataFrame(rows, PAGES).repartition(2), path)
        found = warc.read(spark, path)
        assert set(map(tuple, warc.page_rows(found).collect())) == expected(rows)
        assert sorted(r["uri"] for r in found.collect()) == sorted(urls * 4)
        files = {f.name: chain(f.read_bytes()) for f in (tmp_path / "warc").glob("part-*")}
        assert {(r["file"].rsplit("/")[-1], r["offset"]) for r in found.collect()} == {(f, r[0]) for f, rs in files.items() for r in rs}
    finally:
        spark.conf.unset("spark.sql.files.maxPartitionBytes")
        spark.conf.unset("spark.sql.files.openCostInBytes")


HEAD = "WARC/1.1\r\nWARC-Type: response\r\nContent-Length: "
HOSTILE = [
    HEAD + "²\r\n\r\nx\r\n\r\n",
    "\r\n\r\n" + HEAD + "²\r\n\r\nx\r\n\r\n",
    "\r\n\r\n" + HEAD + "9" * 20 + "\r\n\r\nx",
    "\r\n\r\n" + HEAD + "9" * 18 + "\r\n\r\nx",
    "\r\n\r\n" + HEAD + "1" * 5000 + "\r\n\r\nx",
    "\r\n\r\n" + HEAD + "-1\r\n\r\nx",
    "\r\n\r\nWARC/1.²\r\nContent-Length: 1\r\n\r\n",
    "\r\n\r\n" + HEAD + "5\r\nA: ",
    ("\r\n\r\n" + HEAD + "0\r\n\r\n") * 50,
    ("\r\n\r\n" + HEAD + "40\r\n\r\n") * 50,
    ("\r\n\r\n" + HEAD + "5\r\nA: ") * 50 + "\r\n\r\nhello",
]


@pytest.mark.parametrize("split", ["128m", "900b"])
def test_warc_hostile_payloads(spark, tmp_path, split):
    rows = [(i, "http://x/", h, "clash", 1) for i, h in enumerate(HOSTILE * 2 + ["plain"] * 3, 1)]
    rows += [(7, "http://x/", "again", "clash", 1), (7, "http://x/", "again", "clash", 1)]  # a repeated page_id
    path = str(tmp_path / "warc")
    spark.conf.set("spark.sql.files.maxPartitionBytes", split)
    spark.conf.set("spark.sql.files.openCostInBytes", "1b")
    try:
        warc.write(spark.createDataFrame(rows, PAGES).repartition(3), path)
        found = warc.page_rows(warc.read(spark, path)).collect()
        assert len(found) == len(rows)
        assert set(map(tuple, found)) == expected(rows)
    finally:
        spark.conf.unset("spark.sql.files.maxPartitionBytes")
        spark.conf.unset("spark.sql.files.openCostInBytes")


@pytest.mark.parametrize("fake", ["\r\n\r\n" + HEAD + "7\r\n\r\nabc", "\r\n\r\n" + HEAD + "999999999\r\n\r\n", "\r\n\r\n" + HEAD + "5\r\nA: "])
def test_warc_100_000_fake_records(spark, tmp_path, fake):
    """State and time are in proportion to the payload, whatever the fakes in it claim."""
    rows = [(1, "http://x/", "a", "c", 1), (2, "http://x/", fake * 100_000, "c", 1), (3, "http://x/", "b", "c", 1)]
    path = str(tmp_path / "warc")
    warc.write(spark.createDataFrame(rows, PAGES).coalesce(1), path)
    assert set(map(tuple, warc.page_rows(warc.read(spark, path)).collect())) == expected(rows)


def test_warc_null_ids(spark, tmp_path):
    rows = [(None, "http://x/", "same", "c", 1), (None, None, "other", "c", 1), (4, "http://x/", "same", "c", 1), (2, None, None, "c", 1)]
    warc.write(spark.createDataFrame(rows, PAGES), str(tmp_path / "warc"))
    found = warc.page_rows(warc.read(spark, str(tmp_path / "warc"))).collect()
    assert sorted((str(r["page_id"]), r["payload_bytes"], r["record_type"], r["refers_to"]) for r in found) == [("2", 0, "response", None), ("4", 4, "response", None), ("None", 4, "revisit", 4), ("None", 5, "response", None)]
