"""Main text where a host's templates differ, and where names look like page furniture."""

from corvane.llm import html_extract


def texts(spark, pages):
    df = spark.createDataFrame([(i, url, page) for i, (url, page) in enumerate(pages)], "page_id long, url string, html string")
    return [r["text"] for r in html_extract.extract(df).orderBy("page_id").collect()]


def test_pages_without_marks_on_a_host_with_marks(spark):
    article, plain = "<nav>Menu</nav><article><p>marked</article>", "<nav>Menu</nav><div>not <b>marked</b></div><p>text"
    for url in ("http://a.org/x", None, "/relative", "not a url"):
        assert texts(spark, [(url, article), (url, plain), (url, "<p>broken <b")]) == ["marked", "not marked\ntext", "broken"]


def test_constant_slots_are_template_text(spark):
    top = '<div class="c12">Home About Contact</div><ul>' + "<li>Item</li>" * 3 + "</ul>"
    own = [f"<div class='k{i % 2}'>" + "".join(f"<p>Own {i} {k}</p>" for k in range(i % 3 + 1)) + "</div>" for i in range(9)]
    pages = [("http://a.org/", top + x + "<div class='q'>Since 1999</div>") for x in own]
    want = ["\n".join(f"Own {i} {k}" for k in range(i % 3 + 1)) for i in range(9)]
    assert texts(spark, pages) == want
    assert texts(spark, pages * 2) == want * 2
    # too few different pages tell nothing, repeated or not
    assert texts(spark, pages[:1] * 9) == ["Home About Contact\nItem\nItem\nItem\nOwn 0 0\nSince 1999"] * 9
    # what few pages have is theirs; marked articles keep constant text; a page of constant slots alone keeps them
    assert texts(spark, [*pages, ("http://a.org/", top + own[0] + "<h4>Rare</h4>")])[9] == "Own 0 0\nRare"
    wrapper = html_extract.numbered(html_extract.fold(html_extract.parse(top)[0]))[0]
    assert html_extract.main_text(top, wrapper, frozenset({0, 1})) == "Home About Contact\nItem\nItem\nItem"
    assert html_extract.main_text(top, wrapper, frozenset({1})) == "Home About Contact"
    assert texts(spark, [("http://b.org/", f"{top}<article><h1>Same</h1><p>{i}</p></article>") for i in range(6)]) == [f"Same\n{i}" for i in range(6)]


def test_alignment_gives_slots_of_groups():
    fold, number = html_extract.fold, html_extract.numbered
    streams = [["ul", *["li", "T", "/li"] * n, "/ul", "p", "T", "/p"] for n in (1, 3, 2)]
    wrapper = fold(streams[0])
    for s in streams[1:]:
        wrapper = html_extract.generalise(wrapper, fold(s))
    for s in streams:
        got = html_extract.places(number(wrapper)[0], s)
        assert [got[i] for i, x in enumerate(s) if x == "T"] == [0] * (s.count("T") - 1) + [1]


def test_names_in_articles(spark):
    whole = {
        "<article><h2 id='related-work'>Related work</h2><p>a</p><h2 id='legal-notice'>Legal</h2></article>": "Related work\na\nLegal",
        "<article><section id='discussion'><p>a</p></section><section class='related-work'>b</section></article>": "a\nb",
        "<article><div class='article-body no-sidebar'><p>a</p></div></article>": "a",
        "<div id='page' class='has-sidebar'><main><p>a</p></main><div class='sidebar'>no</div></div>": "a",
        "<div class='sidebar-left-layout'><main><p>a</p></main></div>": "a",
        "<article><figure><img><figcaption>Figure 1</figcaption></figure><p>a</p></article>": "Figure 1\na",
        "<article><p>a</p><div class='comments'>no</div><div id='comments'>no</div><div class='share-buttons'>no</div></article>": "a",
        "<p>text</p><div class='comment-list'><article>reader</article></div>": "text",
    }
    assert texts(spark, [(f"http://h{i}.org/", page) for i, page in enumerate(whole)]) == list(whole.values())
    # the host's wrapper decides about a loose name: constant text goes, varying text stays
    odd = [("http://a.org/", f"<article><p>{i}</p><div class='c12-social'>Tell others</div><div class='search-results'>{i} found</div></article>") for i in range(6)]
    assert texts(spark, odd) == [f"{i}\n{i} found" for i in range(6)]
