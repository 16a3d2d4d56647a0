"""Operator 3 against planted pages, and the pipeline against its parts."""

import json
import random

import pytest

from countmix.llm import wrappers

corpus_pipeline = pytest.importorskip("corpus_pipeline")


def page(rnd, i, title, paragraphs, extra=True):
    side = f'<aside><p>side {rnd.random()}</p></aside><div class="ad-box">ad {i}</div>' if rnd.random() < 0.6 else ""
    links = "".join(f'<li><a href="/{k}">menu {rnd.randrange(99)}</a>' for k in range(rnd.randrange(1, 6)))
    comments = f'<section id="comments"><p>reader {i} says</p></section>' if extra else ""
    body = "".join(f"<p>{p}</p>" if rnd.random() < 0.5 else f"<p>{p}" for p in paragraphs)
    return (f'<!DOCTYPE html><html><head><title>{title}</title><script>var t="</p>";</script><style>p{{}}</style></head><body>'
            f"<header><h2>Site</h2></header><nav><ul>{links}</ul></nav><!-- <p>no</p> --><article><h1>{title}</h1>{side}{body}"
            f'<form><input name="q"><p>send</p></form>{comments}</article><footer>&copy; {i}</footer></body></html>')


def test_planted_pages(spark):
    rnd = random.Random(1)
    rows, want = [], {}
    for i in range(120):
        host = "hot.example.com" if i % 3 else f"h{i % 4}.example.org"
        title, paragraphs = f"Title &amp; {i}", [f"text&nbsp;{i}  <b>bold</b>er\n{k} &lt;x&gt;" for k in range(rnd.randrange(0, 6))]
        rows.append((i, f"https://{host}/p/{i}?a=b", page(rnd, i, title, paragraphs, bool(i % 2)), "clash"))
        want[i] = "\n\n".join([f"Title & {i}"] + [f"text {i} bolder {k} <x>" for k in range(len(paragraphs))])
    rows += [(900, None, None, ""), (901, "http://e/", "", ""), (902, "nonsense", "<p", ""), rows[5], (None, "https://hot.example.com/", rows[7][2], "")]
    df = spark.createDataFrame(rows, "page_id long, url string, html string, text string")
    got = wrappers.extract(df).collect()
    assert len(got) == len(rows)
    for r in got:
        expected = want.get(7 if r.page_id is None else r.page_id, "")
        assert (r.text, r.n_chars) == (expected, len(expected)), r.page_id
    found = {r.host: r for r in wrappers.infer(df).collect()}
    assert "(<li><a>#</a></li>)+" in found["hot.example.com"].wrapper
    assert "(<aside>" in found["hot.example.com"].wrapper and ")?" in found["hot.example.com"].wrapper
    assert wrappers.extract(df.where("false")).count() == 0


def test_without_article_the_densest_group_is_main(spark):
    words = "some longer text of the story that goes on and on"
    rows = [(i, "http://blog.example.net/x", f'<body><div class="top-menu"><a>Home</a></div><div id="wrap{i}"><div class="post"><h2>Head {i}</h2><p>{words} {i}<br>next</p><p>See <a>link {i}</a>.</p></div><div class="sidebar"><p>{words} side</p></div></div><div class="comments-list">c</div></body>') for i in range(30)]
    got = wrappers.extract(spark.createDataFrame(rows, "page_id long, url string, html string")).collect()
    for r in got:
        assert r.text == f"Head {r.page_id}\n\n{words} {r.page_id} next\n\nSee link {r.page_id}."


def test_position_in_the_wrapper_decides(spark):
    """A paragraph without a class that is the same on all pages is template text,
    apart from the text by another group or beside it; a text on some pages is not."""
    rows, want, words = [], {}, "goes on as a longer text that no other page has"
    for i in range(40):
        often = "<h2>Sources</h2>" if i % 2 else ""
        html = f"<body><article><p>Read more on our site.</p><h1>Head {i}</h1><p>Please subscribe to us.</p><p>Story {i} {words}.</p><p>And on {i} {words}.</p>{often}<ul><li>one {i}</li></ul><p>All rights kept.</p></article></body>"
        rows.append((i, f"http://news.example.org/{i}", html))
        want[i] = "\n\n".join([f"Head {i}", f"Story {i} {words}.", f"And on {i} {words}."] + ["Sources"] * (i % 2) + [f"one {i}"])
    got = wrappers.extract(spark.createDataFrame(rows, "page_id long, url string, html string")).collect()
    assert {r.page_id: r.text for r in got} == want


@pytest.mark.parametrize("container", ["article", 'div class="story"'])
def test_each_template_of_a_host_has_its_main_slots(spark, container):
    """10 % of a host's pages hold their text in another container, as do pages
    without a host; an intro that all templates share does not outweigh it."""
    rows, want = [], {}
    for i in range(100):
        tag = 'div class="content"' if i % 10 == 3 else container
        text = f"Text of page {i} " + f"that is its own {i} " * 20
        html = f"<body><nav><a>Home</a></nav><div class='intro'><p>Today {i} is a day like others, hot {i}.</p></div><{tag}><h1>Head {i}</h1><p>{text}</p></{tag.split()[0]}><footer>end</footer></body>"
        rows.append((i, "http://big.example.com/" if i < 80 else None, html))
        want[i] = f"Head {i}\n\n{text.strip()}"
    got = wrappers.extract(spark.createDataFrame(rows, "page_id long, url string, html string")).collect()
    assert {r.page_id: r.text for r in got} == want


def test_every_page_has_a_place_in_its_wrapper():
    rnd = random.Random(3)

    def tree(depth):
        tags = [rnd.choice(["div", "p", "b", "ul"]) for _ in range(rnd.randrange(0, 5))] if depth else []
        return "t" + "".join(f"<span><{k}>{tree(depth - 1)}</{k}></span>" if rnd.random() < 0.2 else f"<{k}>{tree(depth - 1)}</{k}>" for k in tags)

    for _ in range(60):
        pages = [tree(3) for _ in range(8)]
        root = wrappers.merge_all(json.dumps(wrappers.read_page(p)[1]) for p in pages)
        wrappers.number(root)
        for p in pages:
            texts, _ = wrappers.placed(p, root)
            assert texts and all(t[0] >= 0 for t in texts)


@pytest.mark.parametrize("bad", ["<", "<!-- x", "<script>abc", "</p></div>x", "<p>a<p>b</b>c", "<a href='>'>x</a>", "<div " + "a" * 5000, "<" * 3000, '<p a="' * 2000, "&#x41;&nbsp;&#0;", "<ul><li>a<li>b<table><tr><td>c<tr><td>d</table>"])
def test_broken_html_is_read_to_its_end(bad):
    texts, root = wrappers.read_page(bad)
    assert isinstance(wrappers.block_texts(texts, lambda p: True), str)
    json.dumps(root)


def test_alignment_is_union_free_and_keeps_both_sides():
    def tree(s):
        return wrappers.read_page(s)[1]

    a, b = tree("<div><h1>x</h1><p>a</p><p>b</p></div>"), tree("<div><h1>x</h1><img><table><tr><td>1</td></tr></table></div>")
    assert wrappers.expression(wrappers.align(a, b)) == "<div><h1>#</h1>(<p>#</p>)*(<table><tr><td>#</td></tr></table>)?</div>"
    once = wrappers.align(a, b)
    assert wrappers.expression(wrappers.align(once, tree("<div><h1>x</h1></div>"))) == wrappers.expression(once)


def test_pipeline_stages(spark):
    """Planted rows: each stage removes or changes what it should, and only that."""
    sf_dir = "/root/testdata/sf0.01"
    docs = spark.read.parquet(f"{sf_dir}/documents.parquet")
    item = spark.read.parquet(f"{sf_dir}/benchmark.parquet").first().text
    clean = docs.join(spark.read.parquet(f"{sf_dir}/labels.parquet").where("quality = 1"), "doc_id").orderBy("doc_id").select(*docs.columns).limit(3).collect()
    rows = [tuple(r) for r in docs.collect()]
    text = clean[0].text
    planted = [(10**6, text, "en", "new", len(text)), (10**6 + 1, f"{text} {item} and so on", "en", "new", 0), (10**6 + 2, f"{clean[1].text} password=zxcvbn123 {clean[2].text}", "en", "new", 0),
               (10**6 + 3, "THNDER!! ERATION!! OUSHED!! ANDENANOU!! " * 9, "en", "new", 0), (10**6 + 4, None, None, None, None), (10**6 + 5, "", "en", "new", 0)]
    now = spark.createDataFrame(rows + planted, docs.schema)
    seen = {}
    for name, stage in corpus_pipeline.STAGES:
        now = corpus_pipeline.saved(stage(spark, now, sf_dir), name)
        seen[name] = {r.doc_id: r for r in now.collect()}
        if name != "encoding":
            assert now.columns == docs.columns
    assert 10**6 + 3 not in seen["quality"] and 10**6 + 4 in seen["quality"]
    assert 10**6 not in seen["near_duplicates"]  # a copy of a smaller id
    assert 10**6 + 4 in seen["near_duplicates"] and 10**6 + 5 not in seen["near_duplicates"]  # both empty
    assert 10**6 + 1 not in seen["decontamination"]
    assert "[SECRET]" in seen["secrets"][10**6 + 2].text and "zxcvbn" not in seen["secrets"][10**6 + 2].text
    assert set(seen["encoding"]) == set(seen["secrets"])
    assert seen["encoding"][10**6 + 4].n_tokens == 0
    for d, r in seen["secrets"].items():  # nothing else changes
        assert "[SECRET]" in (r.text or "") or r == seen["quality"][d]
    empty = docs.where("false")
    for _, stage in corpus_pipeline.STAGES:
        out = stage(spark, empty, sf_dir)
        assert out.count() == 0
