import pytest

from convlens.llm import extraction
from convlens.llm.htmltree import parse
from convlens.llm.labelled_pages import labelled_pages, page


@pytest.fixture(scope="module")
def model():
    return extraction.train(labelled_pages())


def labels(own):
    out = [0] * len(own.tag)
    for i in range(1, len(own.tag)):
        out[i] = int(own.main[i] or (out[own.parent[i]] and not own.other[i]))
    return out


def test_marginals_match_enumeration(model):
    """Sum-product against the sum over all labellings of a small tree."""
    from itertools import product
    from math import exp

    own = parse("<div class=ad>x</div><article><p>Some text here</p><a href=x>y</a></article><nav><li>z")
    n = len(own.tag)
    odds = [sum(model.evidence.get(f, 0.0) for f in shown) for shown in extraction.features(own)]
    total, content = 0.0, [0.0] * n
    for y in product((0, 1), repeat=n - 1):
        y = (0, *y)
        w = 1.0
        for i in range(1, n):
            w *= model.moves[extraction._kind(own.tag[i])][y[own.parent[i]]][y[i]] * exp(odds[i] * y[i])
        total += w
        for i in range(n):
            content[i] += w * y[i]
    assert model.marginals(own) == pytest.approx([c / total for c in content], abs=1e-9)


def test_held_out_pages(model):
    right = total = 0
    for seed in range(5000, 5200):
        own = parse(page(seed))
        content, label = model.marginals(own), labels(own)
        for node, piece in own.pieces:
            if piece and piece.strip():
                total += len(piece)
                right += len(piece) * ((content[node] >= 0.5) == bool(label[node]))
    assert right > 0.97 * total


def text(model, body):
    return extraction.main_text(f"<html><head><title>t</title></head><body><nav><ul><li><a href=/>Home</a></li><li><a href=/b>Blog</a></li></ul></nav>{body}<footer>&copy; us</footer>", model)


def test_blocks_and_references(model):
    got = text(model, "<article><h1>A &amp; B</h1><p>one\n  two&nbsp;<b>three</b><br>four<p>f&#105;ve &lt;six&gt;</p><ul><li>seven<li>eight</ul>tail</article>")
    assert got == "A & B\none two three four\nfive <six>\nseven\neight\ntail"


def test_what_is_no_article_goes(model):
    noise = (
        '<header><h1>Site</h1></header><div class="ad">Buy now</div><script>var a="<p>x</p>"</script><style>p{}</style>'
        '<div class="cookie-notice"><p>We use cookies</p><button>ok</button></div><form><label>Mail</label><input></form>'
        '<section id="comments"><div class="comment"><p>First! I like this a lot.</p></div></section><aside><p>See also</p></aside>'
    )
    got = text(model, noise + "<article><h1>Title</h1><p>The story begins here and goes on for a while.</p><p>End.</p></article>" + noise)
    assert got == "Title\nThe story begins here and goes on for a while.\nEnd."


def test_given_pages_match_their_articles(spark, model, small_dir):
    import html
    import re

    rows = extraction.extract(spark.read.parquet(f"{small_dir}/pages.parquet"), model).collect()
    pages = {r["page_id"]: r["html"] for r in spark.read.parquet(f"{small_dir}/pages.parquet").collect()}
    assert len(rows) == len(pages)
    for r in rows:
        article = re.search(r"<article>(.*)</article>", pages[r["page_id"]], re.S)[1]
        blocks = [re.sub(r"\s+", " ", html.unescape(re.sub(r"<[^>]*>", " ", b))).strip() for b in re.split(r"</?(?:p|h1)>", article)]
        assert r["text"] == "\n".join(b for b in blocks if b) and r["n_chars"] == len(r["text"])


def test_broken_empty_and_long_pages(spark, model):
    long = "<article>" + "<p>Some words of a paragraph that goes on.</p>" * 20_000 + "</article>"
    deep = "<div>" * 3000 + "x"
    rows = [(1, "u", None), (2, "u", ""), (3, None, "no markup"), (None, "u", "<article><p>a b c d e f g h</p></article>"), (5, "u", long), (6, "u", deep), (7, "u", "<"), (8, "u", "<!-- open"), (9, "u", "<p <b <article")]
    df = spark.createDataFrame(rows, "page_id long, url string, html string")
    got = {r["page_id"]: r for r in extraction.extract(df, model).collect()}
    assert len(got) == 9 and got[1]["text"] == got[2]["text"] == "" and got[3]["url"] is None
    assert got[None]["text"] == "a b c d e f g h"
    assert got[5]["text"].count("\n") == 19_999
    assert extraction.extract(df.where("false"), model).count() == 0
