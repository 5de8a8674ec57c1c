"""Pages of one wrapper with several layouts, and elements whose class names mention a region."""

import pytest

from stratum.llm.html_wrappers import extract_pages

NAV = '<nav><a href="/">Home</a></nav>'


def extracted(spark, pages):
    df = spark.createDataFrame([(i, u, f"<html><body>{NAV}{b}<footer>f</footer></body></html>") for i, (u, b) in enumerate(pages)],
                               "page_id long, url string, html string").coalesce(1)
    return [r["text"] for r in sorted(extract_pages(df).collect(), key=lambda r: r["page_id"])]


@pytest.mark.parametrize("host", ["http://a.org/", None])
@pytest.mark.parametrize("n_plain", [1, 2, 4])
def test_mixed_layouts(spark, host, n_plain):
    """Pages with and without an article under one wrapper; a null url has no host."""
    url = lambda i: host and f"{host}{i}"
    pages = [(url(i), f"<p>Before</p><article><p>story {i}</p></article>") for i in range(3)]
    pages += [(url(9 + i), f"<div><p>plain {i}</p><p>more {i}</p></div>") for i in range(n_plain)]
    assert extracted(spark, pages) == [f"story {i}" for i in range(3)] + [f"plain {i}\nmore {i}" for i in range(n_plain)]


def test_template_text_still_goes(spark):
    pages = [(f"http://a.org/{i}", f"<div class='brand'><p>Site name</p></div><div><p>text {i}</p></div>") for i in range(4)]
    assert extracted(spark, pages) == [f"text {i}" for i in range(4)]


@pytest.mark.parametrize("around", [
    "<div class='layout has-sidebar'>{}<div class='sidebar'>s</div></div>", "<div class='content-with-comments'>{}</div>",
    "<div class='sidebar-right'>{}<div class='sidebar'>s</div></div>", "<form id='f'>{}</form>",
    "{}<div class='comments-area'><article class='comment-body'><p>c</p></article></div>",
    "{}<div class='post-comments'><article class='comment-body'><p>c</p></article></div>",
    "<div class='layout has-sidebar'>{}<div class='related-posts'><article class='card'>r</article></div></div>"])
@pytest.mark.parametrize("tag", ["article", "main"])
def test_named_like_a_region(spark, around, tag):
    pages = [(f"http://a.org/{i}", around.format(f"<{tag}><p>story {i}</p></{tag}>")) for i in range(2)]
    assert extracted(spark, pages) == ["story 0", "story 1"]


def test_related_cards_are_not_the_page(spark):
    body = "<div><p>plain {}</p></div><div class='related'><article>card</article></div>"
    assert extracted(spark, [(f"http://a.org/{i}", body.format(i)) for i in range(4)]) == [f"plain {i}" for i in range(4)]
