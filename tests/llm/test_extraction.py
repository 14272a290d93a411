"""Main text of pages: layouts held out of training, pages written by hand, the decoding against all choices, edges."""

from __future__ import annotations

import html
import itertools
import re

import numpy as np
import pytest

from tilltrail.llm import boosting, dom, extraction, layouts

SCHEMA = "page_id long, url string, html string"
ONE = "The council met on Tuesday to discuss the new bridge, and after a long debate the members agreed to fund it. Work begins in spring."
TWO = "Residents welcomed the plan. Some asked for more trees, others for wider paths along the river and a better crossing at the mill."
SHORT = "It was late."


@pytest.fixture(scope="module")
def sample(spark):
    return extraction.training_sample(spark.read.parquet("/root/testdata/sf0.01/pages.parquet"))


@pytest.fixture(scope="module")
def model(sample):
    return extraction.train(sample)


def article_of(text: str) -> str:
    inner = re.search(r"<article>(.*)</article>", text, re.S).group(1)
    lines = (" ".join(html.unescape(re.sub(r"<[^>]*>", "", p.replace("<br>", " "))).split()) for p in re.split(r"</?(?:h1|p)>", inner))
    return "\n".join(line for line in lines if line)


def test_articles_of_the_test_pages_are_whole(spark, model):
    """Pages that were not trained on: the sample takes 150 of these 2,500."""
    pages = spark.read.parquet("/root/testdata/sf0.1/pages.parquet")
    found = extraction.extract_pages(pages, model).collect()
    expected = {r.page_id: article_of(r.html) for r in pages.collect()}
    assert len(found) == len(expected)
    assert sum(r.text == expected[r.page_id] for r in found) >= 0.999 * len(expected)
    assert all(r.n_chars == len(r.text) for r in found)


def test_layouts_held_out_of_training(sample, model):
    texts = [" ".join(t.split()) for text in sample for t in re.findall(r"<p>([^<]{40,})", text)]
    same = right = given = wanted = 0
    for text in layouts.pages(texts, 200, seed=10_000):
        page = extraction.read(text)
        want = dom.text_of(page, [node.main == "1" for node in page.nodes]).split("\n")
        got = extraction.extract([text], model)[0].split("\n")
        same += got == want
        right += sum(len(x) for x in got if x in want)
        given += sum(map(len, got))
        wanted += sum(map(len, want))
    assert same >= 180 and right / given > 0.98 and right / wanted > 0.98


BY_HAND = {
    "comments behind the article": (
        f"<!doctype html><html><body><header><a href=/>Daily</a><nav><ul><li><a href=/a>Home</a><li><a href=/b>News</a></ul></nav></header><main><article>"
        f"<h1>Bridge approved</h1><p>{ONE}</p><p>{SHORT}</p><div class='ad-box'>Buy shoes now at half price. Only today in our shop.</div><p>{TWO}</p></article>"
        f"<section class=comments><h2>3 comments</h2><div class=comment><b>Ann</b><p>I do not like this plan at all, it costs too much and helps nobody.</p></div>"
        f"<div class=comment><b>Bob</b><p>Great news!</p></div></section></main><aside><h3>Related</h3><ul><li><a href=/x>Another story</a></li></ul></aside>"
        f"<footer>&copy; 2021 Daily</footer></body></html>",
        f"Bridge approved\n{ONE}\n{SHORT}\n{TWO}",
    ),
    "no elements of their own": (
        f'<html><body><div id="wrap"><div class="topmenu"><a href=/>Home</a> <a href=/n>News</a></div><div class="content"><h1>Bridge &amp; mill</h1><p>{ONE}</p>'
        f'<p>{TWO}</p><p>{SHORT}</p></div><div class="sidebar"><h4>Popular</h4><p>Ten ways to save money.</p></div><div id="footer">All rights reserved.</div></div></body></html>',
        f"Bridge & mill\n{ONE}\n{TWO}\n{SHORT}",
    ),
    "no names": (
        f"<html><body><div><a href=/>Home</a> | <a href=/n>News</a></div><div><h1>Title</h1><p>{ONE}</p><p>{TWO}</p><p>{ONE}</p></div><div>&copy; 2020 <a href=/i>Imprint</a></div></body></html>",
        f"Title\n{ONE}\n{TWO}\n{ONE}",
    ),
    "unclosed elements and references": (
        f"<body><nav><a href=/>x</a></nav><article><h1>Big&nbsp;&nbsp;title</h1><p>One <b>bold</b>ly <a href=/z>linked</a>\n\n word&hellip; &lt;tag&gt;.<p>{ONE}<script>var t='</p>';</script><!-- <p>no</p> --><p>{TWO}",
        f"Big title\nOne boldly linked word… <tag>.\n{ONE}\n{TWO}",
    ),
    "notice and form": (
        f'<html><body><div class="cookie-banner"><p>We use cookies to make this site better for you.</p><button>Accept</button></div><article><h1>Head</h1><p>{ONE}</p>'
        f'<form class="newsletter"><p>Sign up for our newsletter.</p><input type=email></form><p>{TWO}</p><ul><li>First point of the plan</li><li>Second point of the plan</li></ul></article></body></html>',
        f"Head\n{ONE}\n{TWO}\nFirst point of the plan\nSecond point of the plan",
    ),
}


@pytest.mark.parametrize("name", sorted(BY_HAND))
def test_pages_written_by_hand(model, name):
    text, expected = BY_HAND[name]
    assert extraction.extract([text], model) == [expected]


def test_decoding_is_the_best_choice_without_contradictions():
    rng = np.random.default_rng(2)
    for _ in range(50):
        n = int(rng.integers(1, 9))
        nodes = [dom.Node("div", -1, 0)]
        for i in range(1, n):
            p = int(rng.integers(0, i))
            nodes.append(dom.Node("div", p, nodes[p].depth + 1))
            nodes[p].children.append(i)
        worth = rng.normal(size=n)
        allowed = [c for c in itertools.product([False, True], repeat=n) if all(i == 0 or not c[i] or c[nodes[i].parent] for i in range(n))]
        best = max(allowed, key=lambda c: sum(w for w, k in zip(worth, c) if k))
        assert extraction.decode(dom.Page(nodes, [], [], []), worth) == list(best)


def test_nulls_empty_long_and_repeated_pages(spark, model):
    long = "<article>" + "".join(f"<p>{ONE} {i}</p>" for i in range(20_000)) + "</article><footer>&copy; x</footer>"
    deep = "<div>" * 3000 + f"<p>{ONE}</p><p>{TWO}</p>"
    rows = [(1, "u", None), (2, None, ""), (3, "u", long), (3, "u", long), (None, "v", "<<<>< &"), (5, "w", deep), (6, "x", "<script>only</script><!-- never closed")]
    df = spark.createDataFrame([(*r, "a", 2) for r in rows], SCHEMA + ", text string, n_chars int")
    found = extraction.extract_pages(df, model).collect()
    texts = [(r.page_id, r.text, r.n_chars) for r in found]
    assert [t for t in texts if t[0] in (1, 2, 6)] == [(1, "", 0), (2, "", 0), (6, "", 0)]
    whole = "\n".join(f"{ONE} {i}" for i in range(20_000))
    assert [t for t in texts if t[0] == 3] == [(3, whole, len(whole))] * 2
    assert len(texts) == len(rows) and found[0].asDict().keys() == {"page_id", "url", "text", "n_chars"}


def test_empty_table(spark):
    assert extraction.extract_pages(spark.createDataFrame([], SCHEMA)).collect() == []


def test_training_is_the_same_each_time(sample):
    one, two = (extraction.train(sample[:20], 20) for _ in range(2))
    assert (one.feature == two.feature).all() and (one.leaf == two.leaf).all()


def test_trees_learn_a_rule_of_two_features():
    rng = np.random.default_rng(0)
    rows = rng.random((4000, 5))
    labels = ((rows[:, 1] > 0.5) ^ (rows[:, 3] > 0.3)).astype(float)
    model = boosting.fit(rows[:3000], labels[:3000], np.ones(3000))
    assert ((model.log_odds(rows[3000:]) > 0) == labels[3000:]).mean() > 0.97
