"""HTML extraction: the parser by hand, the CRF by enumeration, accuracy on held-out labelled pages."""

import itertools
import time

import numpy as np

from spanloom.llm.crf import ChainCRF
from spanloom.llm.html_blocks import parse
from spanloom.llm.html_text import _labelled, extract, main_text, model, op4_html_text

PAGE = (
    "<html><head><title>T</title><script>var t='</p>';</script></head><body><header><a href=/>Site</a></header>"
    "<nav><ul><li><a href=/a>one</a></li></ul></nav><!-- <p>no</p> --><div class='cookie-notice'>We use cookies here.</div>"
    "<article><h1>A &amp; B</h1><p>First <b>bold</b>\n text&nbsp;here, and more of it follows.<br><p>Second &lt;x&gt; one. It is long enough.</p>"
    "<div class=ad>Buy now this thing</div><p>Third part of the article.</article><section class='comments'><p>Bob: I disagree with all of this.</p></section>"
    "<form><label>Mail</label><input></form><footer>&copy; 2024 Site</footer></body></html>"
)
WANT = "A & B First bold text here, and more of it follows. Second <x> one. It is long enough. Third part of the article."


def test_blocks():
    blocks = parse("<p>a <i>b</i>c<p>d<br>e<ul><li>f<li>g</ul><script>x</script>h</p>")
    assert [b.text for b in blocks] == ["a bc", "d", "e", "f", "g", "h"]
    assert [b.tags[-1] for b in blocks[:4]] == ["p", "p", "p", "li"]
    assert parse(None) == parse("") == parse("<p> \n</p>") == []
    assert [b.text for b in parse("1 < 2 <b")] == ["1 < 2 <b"]


def test_marginals_and_viterbi_by_enumeration():
    rng = np.random.default_rng(2)
    crf = ChainCRF()
    crf.index = {c: i for i, c in enumerate("abcd")}
    crf.weights, crf.steps = rng.normal(size=(4, 2)), rng.normal(size=(2, 2))
    items = [["a", "b"], ["c"], ["zzz"], ["d", "a"]]
    s = crf.scores(items)
    worth = {y: sum(s[i, v] for i, v in enumerate(y)) + sum(crf.steps[a, b] for a, b in zip(y, y[1:])) for y in itertools.product((0, 1), repeat=4)}
    assert crf.decode(items) == list(max(worth, key=worth.get))
    total = sum(np.exp(v) for v in worth.values())
    p, pairs = crf.marginals(items)
    assert np.allclose(p[:, 1], [sum(np.exp(v) for y, v in worth.items() if y[i]) / total for i in range(4)])
    assert np.isclose(pairs[1, 1], sum(np.exp(v) * sum(a == b == 1 for a, b in zip(y, y[1:])) for y, v in worth.items()) / total)
    assert crf.decode([]) == []


def test_a_page_and_held_out_accuracy():
    assert main_text(PAGE, model()) == WANT
    wrong = total = 0
    for seed in range(50_000, 50_150):
        items, labels = _labelled(seed)
        wrong += sum(a != b for a, b in zip(labels, model().decode(items)))
        total += len(labels)
    assert wrong <= 0.04 * total


def test_odd_pages(spark):
    rows = [(1, "u", PAGE), (1, "u", PAGE), (2, None, None), (3, "u", ""), (4, "u", "<p>"), (None, "u", "<article><p>" + "Long text here. " * 100_000 + "</article>")]
    df = spark.createDataFrame(rows, "page_id long, url string, html string").selectExpr("*", "'x' AS text", "1 AS n_chars")
    got = extract(df).collect()
    assert [r["text"] for r in got[:5]] == [WANT, WANT, "", "", ""] and got[5]["n_chars"] == 16 * 100_000 - 1
    assert all(r["n_chars"] == len(r["text"]) for r in got) and extract(df.limit(0)).count() == 0


def test_foreign_and_raw_elements():
    texts = lambda x: [b.text for b in parse(x)]
    assert texts("<p>one</p><svg width=1/><p>two</p>") == texts("<p>one</p><svg><svg><text>x</text></svg>y</svg><p>two</p>") == ["one", "two"]
    assert texts("<p>one <math><mi>x</mi></math> two</p>") == ["one", "x", "two"]
    assert texts("<p>a</p><noscript>keep</noscript><object>this</object><template>not</template>") == ["a", "keep", "this"]
    assert texts("<p>a<script>var x = '<p>no</p>'</script>b</p><style>p{}") == ["ab"]
    assert texts("<p>a</p><script>gone<p>gone") == ["a"] and texts("<textarea>kept<p>b") == ["kept", "b"]
    assert texts("<p title='a>b'>c</p><p title=\"d>e>f</p>") == ["c", "e>f"]


def test_hostile_pages_are_linear():
    n = 20_000
    pages = ("<div>" * n + "x", "<a " * n, "<a href='" * (n + 1), "<p " + '"' * (n + 1), "<!--" * n, "<svg>" * n, "<script>" * n, "<textarea>" * n,
             "<p>a<b>c" * n, "<" * n, "<i>" * n + "</p>" * n, "</b>" * n, "<b>" * n + "</i>" * n, "<x y='" + "<z \"' >" * n)
    for page in pages:
        took = time.process_time()
        parse(page)
        assert time.process_time() - took < 3, page[:20]


def test_query_is_main_text_of_every_page(spark):
    sf = "/root/testdata/sf0.001"
    pages = spark.read.parquet(f"{sf}/pages.parquet").collect()
    want = sorted((r["page_id"], r["url"], main_text(r["html"], model())) for r in pages)
    got = op4_html_text(spark, sf).collect()
    assert sorted((r["page_id"], r["url"], r["text"]) for r in got) == want and all(r["n_chars"] == len(r["text"]) for r in got)
