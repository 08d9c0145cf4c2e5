import html
import re

import numpy as np
import pytest

from lumenweave.llm import pages


def one(h):
    return pages.extract([h])[0]


@pytest.mark.parametrize(
    "given, want",
    [
        (None, ""),
        ("", ""),
        ("plain &amp; simple\n text", "plain & simple text"),
        ("<article><h1>T</h1><p>a<b>b</b>  c<br>d<p>e</article>", "T\n\nab c d\n\ne"),
        ("<head><title>x</title></head><nav>menu</nav><article>keep</article><footer>f</footer>", "keep"),
        ("<script>var t='</p>';</script><style>p{}</style><!-- <p>no</p> --><p>yes", "yes"),
        ("<div class='side ad'>buy</div><p>yes</p><form>q</form><aside>s</aside>", "yes"),
        ("<article><p>a</p><div class=ad>buy <p>now</p></div><p>b</p><section id='comments'><p>c</p></section></article>", "a\n\nb"),
        ("<div class=ad>unclosed<article><p>a</p></article>", "a"),
        ("<main><article>x</article> y</main> z", "x\n\ny"),
        ("<p>&lt;b&gt; &#233;&nbsp;&eacute; &bogus; &am</p>", "<b> é é &bogus; &am"),
        ("<p title='a > b'>x</p><p title=\"unclosed>y</p>", "x\n\ny"),
        ("<ul><li>1<li>2</ul><table><tr><td>a</td><td>b</td></tr><tr><td>c</table>", "1\n\n2\n\na b\n\nc"),
        ("a < b and 3<4", "a < b and 3<4"),
        ("</div></p>stray</nav> text", "stray\n\ntext"),
        ("<p hidden>h</p><p aria-hidden=true>i</p><div role=navigation>n</div><p>v</p>", "v"),
        ("<p>unended <script>x", "unended"),
    ],
)
def test_markup(given, want):
    assert one(given) == want


@pytest.mark.parametrize(
    "given, want",
    [
        ("<article><p>see <a href='/hidden-gems'>gems</a> here</p></article>", "see gems here"),
        ('<article><p title="a hidden lake">x</p><div style="overflow:hidden">y</div></article>', "x\n\ny"),
        ('<article data-id="menu" title="hidden"><p>x <a href="/p?id=related">y</a> <b data-class=ad>z</b></p></article>', "x y z"),
        ("<article><p>a <span class=notice>b</span> c</p></article>", "a b c"),
        ("<p CLASS = 'ad'>x</p><p data-x=1 hidden>x</p><p title='t'id=menu>x</p><table><tr><td class=ad>x</td><td>y</td></tr></table>", "y"),
        ("<div title=\"a hidden lake>x</div>", "x"),
    ],
)
def test_attributes_that_only_look_like_boilerplate(given, want):
    assert one(given) == want


def test_long_broken_markup_takes_linear_time():
    for bad in ("<" * 200_000, "<a " * 60_000, '<a b="' * 40_000, "<!--" * 50_000, "&amp" * 50_000, "<div>" * 50_000, "<div>" * 30_000 + "</p>" * 30_000):
        assert isinstance(one(bad), str)


def brute_covered(streams, run):
    held = {}
    for k, s in enumerate(streams):
        for i in range(len(s) - run + 1):
            held.setdefault(tuple(s[i : i + run]), set()).add(k)
    return [[any(j - r >= 0 and j - r + run <= len(s) and len(held[tuple(s[j - r : j - r + run])]) > 1 for r in range(run)) for j in range(len(s))] for s in streams]


@pytest.mark.parametrize("seed", range(6))
def test_covered_runs(seed):
    rng = np.random.default_rng(seed)
    streams = [rng.integers(0, 4, rng.integers(0, 60)) for _ in range(6)]
    for run in (1, 3, 5, 8):
        got = pages.covered_words(streams, run)
        assert [g.tolist() for g in got] == brute_covered([s.tolist() for s in streams], run)


def test_repeated_blocks_go_where_no_article_is_named():
    menu, foot = "<div>" + " ".join(f"menu{i}" for i in range(12)) + "</div>", "<p>" + " ".join(f"legal{i}" for i in range(20))
    own = [" ".join(f"w{k}x{i}" for i in range(30)) for k in range(4)]
    assert pages.extract([f"{menu}<p>{x}</p>{foot}" for x in own]) == own
    copies = [f"<article><p>{own[0]}</p></article>{foot}"] * 3
    assert pages.extract(copies) == [own[0]] * 3


def test_pages(spark, monkeypatch):
    rows = [(i, f"http://{'hot' if i % 3 else 'h%d' % i}.com/", f"<nav>a b</nav><article>text {i} &copy;</article>", "t") for i in range(60)] + [(None, None, None, "t"), (7, "no host", "<p>x", "t"), (7, "no host", "<p>x", "t")]
    df = spark.createDataFrame(rows, "page_id long, url string, html string, text string")
    want = sorted((str(i), str(u), f"text {i} ©" if h and "article" in h else "x" if h else "") for i, u, h, _ in rows)
    for chunk in (256, 5):
        monkeypatch.setattr(pages, "CHUNK_PAGES", chunk)
        got = pages.extract_pages(df).collect()
        assert sorted((str(r.page_id), str(r.url), r.text) for r in got) == want and all(r.n_chars == len(r.text) for r in got)
    assert pages.extract_pages(df.limit(0)).collect() == []


def test_chunks_do_not_change_what_repeats_on_a_host(spark, monkeypatch):
    rng = np.random.default_rng(5)
    note = [" ".join(f"note{k}x{i}" for i in range(20)) for k in range(12)]
    on = [set(rng.choice(120, 2, replace=False).tolist()) for _ in note]
    htmls = []
    for i in range(120):
        own = f"<p>{' '.join(f'w{i}x{j}' for j in range(30))}</p>"
        noted = "".join(f"<p>{n}</p>" for n, p in zip(note, on) if i in p)
        htmls.append(f"<main>{own}{noted}</main>" if i % 10 == 0 else f"<nav>menu</nav>{own}{noted}")
    df = spark.createDataFrame([(i, "http://hot.com/", h) for i, h in enumerate(htmls)] + [(999, "http://other.com/", f"<p>{note[0]}")], "page_id long, url string, html string")
    want = dict(enumerate(pages.extract(htmls))) | {999: note[0]}
    assert not any("note" in want[i] for i in range(120) if i % 10)
    for chunk in (256, 5):
        monkeypatch.setattr(pages, "CHUNK_PAGES", chunk)
        assert {r.page_id: r.text for r in pages.extract_pages(df).collect()} == want


def test_query(spark):
    from lumenweave.llm.queries import op5_html_extraction

    d = "/root/testdata/sf0.001"
    want = []
    for r in spark.read.parquet(f"{d}/pages.parquet").collect():
        article = re.search(r"<article>(.*?)</article>", r.html, re.S)[1]
        blocks = (" ".join(html.unescape(re.sub(r"<[^>]*>", " ", b)).split()) for b in re.split(r"</?(?:p|h1)>", article))
        text = "\n\n".join(b for b in blocks if b)
        want.append((r.page_id, r.url, text, len(text)))
    assert sorted(map(tuple, op5_html_extraction(spark, d).collect())) == sorted(want)


def test_the_array_decides_first_and_structure_what_it_leaves():
    menu, own = " ".join(f"menu{i}" for i in range(10)), [" ".join(f"w{k}x{i}" for i in range(20)) for k in range(3)]
    named = [f"<nav>{menu}</nav><article><p>{x}</p><p>{menu}</p></article><footer>only {k}</footer>" for k, x in enumerate(own)]
    assert pages.judge(named) == [pages.Main(f"{x}\n\n{menu}", 1, 1, 1) for x in own]
    bare = [f"<div>{menu}</div><p>{x}</p><footer>only {k}</footer>" for k, x in enumerate(own)]
    assert pages.judge(bare) == [pages.Main(x, 1, 1, 0) for x in own]
    # One page of a host: the array has nothing to compare, structure alone decides.
    assert pages.judge(bare[:1]) == [pages.Main(f"{menu}\n\n{own[0]}", 0, 1, 0)]
