"""Page text: parsing, trees, hierarchical decoding, and whole pages against a plain reading of their one design."""

import html
import re

import numpy as np
import pytest

from marrowgrid.llm import html_main_text as pages_
from tests.llm.conftest import PAGES


def texts(page):
    return [(x.tag, x.parent.tag, x.text) for x in pages_.parse(page) if x.text]


@pytest.mark.parametrize("page, want", [
    ("", []), ("plain &amp; text", ["plain & text"]), ("<p>a  \n b<p>c", ["a b", "c"]), ("<p>a<br>b</p>", ["a", "b"]),
    ("<ul><li>x<li>y</ul>z", ["x", "y", "z"]), ("<p>a<b>b<i>c</b>d</i></p>e", ["abcd", "e"]),
    ("<script>var t='<p>';</script>a<!-- <p>b -->c", ["ac"]), ("<title>t</title><p>a<scr", ["a"]),
    ("<p title='a>b'>c</p>", ["c"]), ("<p title=\"a>c", ["c"]), ("x<a href=\"/y", ["x"]), ("a < b", ["a < b"]), ("<style>p{}", []), ("</p></div>x", ["x"]),
    ("<table><tr><td>1<td>2<tr><td>3</table>", ["1", "2", "3"]), ("&nbsp;<p>&#233;&copy;&bogus;</p>", ["é©&bogus;"])])
def test_parsing(page, want):
    assert [t for _, _, t in texts(page)] == want


@pytest.mark.parametrize("page, want", [
    ("<p>Alpha <span class=\"screen-reader-text\">Beta</span> rest</p>", ["Alpha Beta rest"]),
    ("<p>Alpha <span aria-hidden=\"true\">x</span> rest</p><p>next</p>", ["Alpha rest", "next"]),
    ("<div>Alpha <span hidden><div>x</div> y</span> rest</div>", ["Alpha rest"]),
    ("<p>See <a class=\"tag\">tag</a> and more.</p>", ["See tag and more."]),
    ("<p>a <a style='display:none' href=/>x</a>b</p>", ["a b"]),
    ("<p>a <svg viewBox='0 0 1 1'/> b</p><p>c</p>", ["a b", "c"]), ("<p>a <svg><path d='x'/><text>t</text></svg> b</p>", ["a b"]),
    ("<div><video src=x></div><p>a</p>", ["a"]), ("<div>a<object data=x>alt<p>in</div>b", ["a", "b"]),
    ("<p>a <button><b>x</b></button> c</p>", ["a c"]), ("<p>a<select><option>x<option>y</select>b</p>", ["ab"]),
    ("<p>a<br/>b<span/>c</p>", ["a", "bc"]), ("<noscript><p>n</p></noscript><p>a</p>", ["a"]), ("<div><canvas>x<div>y</div></canvas>z</div>", ["z"])])
def test_text_around_elements_that_show_nothing(page, want):
    assert [t for _, _, t in texts(page)] == want


def test_rare_articles_and_none(spark, pages):
    """Pages that mark an article are looked for in the whole table; without any, densities decide."""
    article = "<html><body><div class='menu'><a href=/>Home</a> <a href=/>News</a></div>{}<div class='footer'>Copyright</div></body></html>"
    body = "<h1>Title of it</h1><p>First paragraph with a link <a href=/>here</a> and words.</p><p>Second one.</p>"
    plain = spark.createDataFrame([(i, "u", article.format(f"<div>{body}</div>")) for i in range(40)], PAGES)
    got = {r.text for r in pages_.main_text(plain).collect()}
    assert got == {"Title of it\nFirst paragraph with a link here and words.\nSecond one."}
    one = spark.createDataFrame([(1000, "u", article.format(f"<article>{body}</article>"))], PAGES)
    assert isinstance(pages_.fit(plain.unionByName(one), 5), pages_.BoostedTrees)
    assert isinstance(pages_.fit(plain, 5), pages_.Density)


def best_subtree(nodes, gain):
    """Largest sum of gains over all sets of nodes that contain each member's parent, by trying all of them."""
    place = {id(x): i for i, x in enumerate(nodes)}
    best = (0.0, [])
    for bits in range(1 << len(nodes) - 1):
        chosen = [0] + [i for i in range(1, len(nodes)) if bits >> i - 1 & 1]
        if all(i == 0 or place[id(nodes[i].parent)] in chosen for i in chosen):
            total = sum(gain[i] for i in chosen if i)
            if total > best[0] + 1e-12:
                best = (total, chosen)
    return [nodes[i].text for i in best[1] if nodes[i].text]


@pytest.mark.parametrize("seed", range(12))
def test_decoding_is_the_best_choice_of_subtrees(seed):
    rng = np.random.default_rng(seed)
    page = "<div><section><span>a</span><div>b</div></section><ul><li>c</ul></div><div><div>d</div></div>"
    nodes = pages_.parse(page)
    gain = rng.normal(size=len(nodes))
    assert pages_.decode(nodes, gain.copy()) == best_subtree(nodes, gain)


def test_parsing_deep_and_long_pages():
    deep = "<div>" * 5000 + "x" + "</div>" * 5000
    assert [t for _, _, t in texts(deep)] == ["x"]
    nodes = pages_.parse("<p>" + "word " * 100_000)
    assert len(nodes[-1].text) == 499_999
    assert pages_.features(nodes).shape == (len(nodes), pages_.N_FEATURES)
    assert pages_._TOKEN.search("<p " + "a='" * 20_000) is not None  # no runaway matching


def test_decoding_keeps_nothing_below_a_dropped_node():
    nodes = pages_.parse("<div><section><p>a</p><p>b</p></section><p>c</p></div><footer><p>d</p></footer>")
    by_tag = lambda *values: np.array([dict(values).get((x.tag, x.text), dict(values).get(x.tag, 1.0)) for x in nodes])
    assert pages_.decode(nodes, by_tag(("footer", -6.0))) == ["a", "b", "c"]
    assert pages_.decode(nodes, by_tag(("footer", -0.5))) == ["a", "b", "c", "d"]
    assert pages_.decode(nodes, by_tag((("#text", "a"), -3.0))) == ["b", "c", "d"]
    assert pages_.decode(pages_.parse("<p hidden>a</p><p>b</p>"), np.ones(5)) == ["b"]


def test_boosting_learns_an_interaction():
    rng = np.random.default_rng(0)
    x = rng.random((3000, 4))
    y = ((x[:, 0] > 0.5) ^ (x[:, 2] > 0.3)).astype(float)
    model = pages_.boost(x, y, np.ones(3000))
    new = rng.random((1000, 4))
    assert np.mean((model.logit(new) > 0) == ((new[:, 0] > 0.5) ^ (new[:, 2] > 0.3))) > 0.95


def plain_article(page):
    """Blocks of the one design the given pages have."""
    inner = page[page.index("<article>") + 9:].partition("</article>")[0]
    blocks = re.sub(r"</?b>", "", re.sub(r"</?(?:h1|p)>|<br>", "\x00", inner)).split("\x00")
    return "\n".join(t for t in (" ".join(html.unescape(b).split()) for b in blocks) if t)


def test_pages(pages):
    rows = {r.page_id: r for r in pages_.main_text(pages).collect()}
    given = {r.page_id: r for r in pages.collect()}
    assert set(rows) == set(given)
    right = [rows[i].text == plain_article(r.html) for i, r in given.items()]
    assert np.mean(right) > 0.98
    assert all(r.n_chars == len(r.text) and r.url == given[i].url for i, r in rows.items())


def test_odd_pages(spark, pages):
    odd = spark.createDataFrame([
        (1, None, None), (2, "u", ""), (2, "u", ""), (3, "u", "<p>"), (None, "u", "<article><p>text of an article, which is long.</p></article>"),
        (4, "u", "x" * 300_000), (5, "u", "<div>" * 2000)], PAGES)
    model = pages_.fit(pages)
    rows = pages_.extract(odd, model).collect()
    assert len(rows) == 7 and all(r.text == "" and r.n_chars == 0 for r in rows if r.page_id in (1, 2, 3, 5))
    none = odd.where("false")
    assert pages_.main_text(none).count() == 0
    assert pages_.main_text(odd.where("page_id in (1, 2)")).count() == 3
