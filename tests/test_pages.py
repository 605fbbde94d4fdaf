"""Site operators on small pages: empty tables, nulls, strategies, order and embeds."""

import json

import pytest
from pyspark.sql import functions as F

from quillstone.functions import text as X
from quillstone.operators import pages as G

SCHEMA = "slug string, title string, links array<string>, tags array<string>, content string, modified date"


@pytest.fixture(scope="module")
def site(spark):
    rows = [
        ("index", "Start", ["a/b/note", "a/b/note"], [], "hello", None),
        ("a/b/note", "Note 10", ["other#Top Part", "a/b/", "https://x.example/", "#here"], ["t/u"], " ", None),
        ("a/b/other", None, ["../c/note"], None, None, None),
        ("a/c/note", "note 9", ["./", "missing"], ["t"], "text", None),
        ("tags/t", "T", None, [], "", None),
    ]
    return spark.createDataFrame(rows, SCHEMA)


def rows(df, *columns):
    return {tuple(r[c] for c in columns) for r in df.collect()}


def test_empty_tables(spark):
    none = spark.createDataFrame([], SCHEMA)
    for df in (G.content_index(none), G.tree(none), G.explorer(none), G.breadcrumbs(none), G.crawl(none), G.recent(none), G.find(none, "#t"), G.find(none, "word"), G.affected_folders(none), G.affected_tags(none)):
        assert df.count() == 0


def test_index_keeps_distinct_links_and_drops_blank_pages(site):
    entries = {r["slug"]: json.loads(r["entry"]) for r in G.content_index(site, include_empty=False).collect()}
    assert set(entries) == {"index", "a/c/note"} and entries["index"]["links"] == ["a/b/note"]
    assert G.content_index(site).count() == 5


def test_tree_and_order(site):
    names = [(r["parent"], r["name"]) for r in G.explorer(site).collect()]
    assert names == [("", "a"), ("a", "b"), ("a", "c"), ("a/b", "Note 10"), ("a/b", "other"), ("a/c", "note 9")]


def test_breadcrumbs_lead_up_to_the_root(site):
    found = sorted((r["ordinal"], r["name"], r["path"]) for r in G.breadcrumbs(site).where("slug = 'a/b/note'").collect())
    assert found == [(0, "Home", "../.."), (1, "a", "../../a/"), (2, "b", "../../a/b/"), (3, "Note 10", "")]
    assert rows(G.breadcrumbs(site).where("slug = 'index'"), "ordinal", "name", "path") == {(0, "Home", "")}


def test_crawl(site):
    shortest = rows(G.crawl(site), "slug", "link", "target")
    assert ("a/b/note", "other#Top Part", "a/b/other") in shortest
    assert ("a/c/note", "missing", "missing") in shortest
    assert not any(link.startswith(("https", "#")) for _, link, _ in shortest)
    relative = rows(G.crawl(site, "relative"), "slug", "link", "target")
    assert ("a/b/other", "../c/note", "a/c/note") in relative and ("a/b/note", "a/b/", "a/b/a/b/") in relative
    absolute = rows(G.crawl(site, "absolute"), "slug", "link", "href")
    assert ("a/b/note", "a/b/", "../../a/b/") in absolute and ("a/b/note", "other#Top Part", "../../other#top-part") in absolute
    with pytest.raises(ValueError):
        G.crawl(site, "nearest")


def test_find(site):
    assert rows(G.find(site, "#t"), "slug", "priority", "place") == {("a/b/note", 2, 1), ("a/c/note", 2, 2)}
    assert rows(G.find(site, "#t note"), "slug", "priority") == {("a/c/note", 0)}
    assert rows(G.find(site, "note"), "slug", "priority") == {("a/b/note", 0), ("a/c/note", 0)}


def test_scope_of_a_rebuild(site):
    assert rows(G.affected_folders(site), "folder") == {("a",), ("a/b",), ("a/c",), ("tags",)}
    assert rows(G.affected_tags(site), "tag") == {("t",), ("t/u",)}


def test_highlight(spark):
    words = ["w"] * 80
    words[70:72] = ["Que(", "que"]
    df = spark.createDataFrame([(" ".join(words),), ("",), (None,), ("que",)], "t string")
    marked = [r[0] for r in df.select(X.highlight(F.col("t"), "que(")).collect()]
    assert '<span class="highlight">Que(</span> que' in marked[0] and marked[1:3] == ["", None]
    trimmed = [r[0] for r in df.select(X.highlight(F.col("t"), "que", trim=True)).collect()]
    assert trimmed[0].startswith("...") and trimmed[0].count("highlight") == 2 and trimmed[1:] == ["", None, "..."]


def test_headings_met_twice_and_nulls(spark):
    df = spark.createDataFrame([("# A\n# A\nx\n# A",), (None,), ("",)], "t string")
    assert [r[0] for r in df.select(X.under_heading(F.col("t"), F.lit("a-1"))).collect()] == ["# A\nx", None, None]
