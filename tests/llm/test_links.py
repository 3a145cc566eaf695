"""Links of pages that need reading: references, base elements, very long and dotted addresses."""

from urllib.parse import urljoin

from ripplework.llm import urls

SCHEMA = "page_id long, url string, html string"


def judged(spark, *pages):
    rows = [(i, f"http://site{i}.net/a/b?q=1", p) for i, p in enumerate(pages)]
    return [r["verdict"] for r in urls.judge(spark.createDataFrame(rows, SCHEMA)).orderBy("id").collect()]


def test_links_that_lead_to_blocked_pages(spark):
    link = '<link rel="canonical" href="{}">'
    pages = [
        link.format("http://k.com/de/1"),
        link.format("http://k.com/de/" + "x" * 9_000),
        link.format("http://k.com/de/" + "x" * 1_000_000),
        link.format("http:&#47;&#x2f;k.com&sol;de/1"),
        link.format("http://k.com/&#100;e/1"),
        '<base href="http://k.com/de/">' + link.format("1"),
        link.format("1") + "<BASE target=x href='//k.com/de/x'><base href=http://no.net/>",
        '<base href="../x"><base href="http://k.com/de/">' + link.format("1"),
        '<base href="data:x">' + link.format("//k.com/de/1"),
        '<meta http-equiv=refresh content="0;url=http:&#x2F;/k.com/de/1">',
        link.format("http://k.com/" + "fr/x/../../" * 100_000 + "de/1"),
        "<!-- <base href='http://k.com/de/'> -->" + link.format("1"),
        link.format("http://k.com/fr/1"),
    ]
    want = ["block"] * 7 + ["allow"] + ["block"] * 3 + ["allow", "allow"]
    assert judged(spark, *pages) == want


def test_references_of_attributes():
    for text, want in (("a&amp;b", "a&b"), ("&copy=1", "&copy=1"), ("&copy;=1", "©=1"), ("&notit;", "&notit;"), ("&#47", "/"), ("&#x2F;&#x2f", "//"), ("&#0;", "�"), ("&", "&"), ("&lt", "<"), ("&unknown;", "&unknown;"), ("&amp", "&"), ("&ampx", "&ampx")):
        assert urls.decoded(text) == want


def test_dots():
    for path in ("/a/b/../c", "/../x", "/a/./b", "/./a", "/a/b/../../../c"):
        assert urls.without_dots(path) == urljoin("http://h" + path, path).removeprefix("http://h")
