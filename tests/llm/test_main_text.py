import random

import pytest

from hunkmill.llm import main_text

NONE: dict[str, float] = {}


def text(html, weights=NONE):
    return main_text.main_text(html, weights)


def sums(scores):
    return {(i, j): sum(scores[i:j]) for i in range(len(scores)) for j in range(i + 1, len(scores) + 1)}


def test_linear_scan_finds_the_greatest_sum():
    rnd = random.Random(3)
    for _ in range(300):
        scores = [rnd.randint(-4, 4) for _ in range(rnd.randint(0, 14))]
        start, end = main_text.best_stretch(scores)
        assert sum(scores[start:end]) == max([0, *sums(scores).values()])


def test_query_against_brute_force(spark):
    """Every page's text is that of the best of all stretches."""
    pages = spark.read.parquet("/root/testdata/sf0.001/pages.parquet")
    weights = main_text.learn(pages)
    got = {r.page_id: r for r in main_text.extract(pages).collect()}
    rows = pages.collect()
    assert len(got) == len(rows)
    for r in rows:
        reader = main_text._Reader(r.html)
        scores = main_text.scores_of(reader.items, main_text._marked(reader), weights)
        start, end = max(sums(scores).items(), key=lambda x: (x[1], -x[0][0]))[0]
        want = "\n".join(i.text for i in reader.items[start:end] if i.text and not i.furniture)
        assert (got[r.page_id].text, got[r.page_id].n_chars, got[r.page_id].url) == (want, len(want), r.url)


def test_words_score_positive_and_tags_negative(spark):
    weights = main_text.learn(spark.read.parquet("/root/testdata/sf0.001/pages.parquet"))
    reader = main_text._Reader("<div><p>ten words of running text are enough to be positive</p></div><ul><li><a href=x>Link</a></li></ul>")
    scores = main_text.scores_of(reader.items, None, weights)
    assert [i.text.split(" ")[0] for i, s in zip(reader.items, scores, strict=True) if s > 0] == ["ten"]
    assert all(s < 0 for i, s in zip(reader.items, scores, strict=True) if i.kind[0] == "<")


ARTICLE = "<h1>A  title</h1><p>First <b>bold</b> &amp; plain\n text.</p><p>Second&nbsp;one<br>goes on."


def page(body):
    return f"<html><head><title>T</title><style>p{{}}</style></head><body><nav><a href=/>Home</a></nav>{body}<footer>&copy; us</footer></body></html>"


@pytest.mark.parametrize("around", [
    "<article>{}</article>", "<main><article>{}</article></main>", '<div role="main">{}</div>', "<form><main>{}</main></form>",
    '<article class="post comments-open">{}</article>', "<article>{}</article><article class=teaser><p>Other</p></article>",
    '<div class="cookie-notice"><p>We use cookies on this site for many good reasons</p></div><article>{}</article>',
    '<article>{}</article><div id="comments"><p>I think that this is a great read with many words, many more than the article has.</p></div>',
    "<article>{}<aside><p>Aside</p></aside><div class=advert>Buy</div><form><label>Name</label></form><script>if (a < b) {{ '</p>' }}</script></article>",
    "<article>{}<section class='reader-comments'><p>Nice</p></section></article>", "<header><h1>Site</h1></header><article>{}</article>",
    '<div class="text">{}</div><div class="sidebar"><p>Much more text in the bar at the side than in the article, as it often is.</p></div>',
    '<div class="ad"><p>never closed<article>{}</article>', '<article>{}<p hidden>unseen</p><p style="display: none">unseen</p></article>',
])
def test_what_is_no_article_goes(around):
    assert text(page(around.format(ARTICLE))) == "A title\nFirst bold & plain text.\nSecond one goes on."


def test_blocks_and_references():
    assert text("<article><ul><li>a<li>b</ul><table><tr><td>c<td>d<tr><td>e</table><pre>f\n g</pre><blockquote>h<p>i</blockquote>j</article>") == "a\nb\nc\nd\ne\nf g\nh\ni\nj"
    assert text("<article>&lt;p&gt; &amp;amp; &#x41;&#66; &eacute;&hellip; a < b &am &amp</article>") == "<p> &amp; AB é… a < b &am &"
    assert text("<article><header><h1>Head</h1></header><p>Body<p class=notice>gone<p>kept</article>") == "Head\nBody\nkept"
    assert text('<article><p title="a>b">x<!-- <p>no --> y<p title=\'open>z</article>') == "x y\nz"


def test_defined_cases(spark):
    for html in (None, "", " ", "<", "<p", "<!-- open", "<script>x", "<nav>only</nav>", "<article></article>", "<nav><article>"):
        assert text(html) == ("<" if html == "<" else "")
    assert text("Hello") == "Hello"
    assert text("<p>" * 3000 + "deep") == "deep" and text("<div>" * 3000 + "deep") == "deep"
    long = " ".join(["word"] * 300_000)
    assert text(f"<article><p>{long}</p></article>") == long
    rows = [(1, "u", "<article>One</article>", "x", 3), (1, "u", "<article>One</article>", "x", 3), (None, None, None, None, None), (2, None, "", "y", 1), (3, "v", f"<article>{long}", None, 2)]
    schema = "page_id long, url string, html string, text string, n_chars int"
    got = main_text.extract(spark.createDataFrame(rows, schema))
    assert got.columns == ["page_id", "url", "text", "n_chars"]
    assert sorted((r.page_id or 0, r.text[:4], r.n_chars) for r in got.collect()) == [(0, "", 0), (1, "One", 3), (1, "One", 3), (2, "", 0), (3, "word", len(long))]
    assert main_text.extract(spark.createDataFrame([], schema)).count() == 0


def test_learning_is_bounded(spark):
    pages = spark.createDataFrame([(i, "u", "<article><p>in in</p></article><div>out</div>") for i in range(50)], "page_id long, url string, html string")
    assert main_text.learn(pages, sample=5) != main_text.learn(pages)
    assert main_text.learn(pages, sample_bytes=10) == {} == main_text.learn(pages.filter("false"))
