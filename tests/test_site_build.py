"""Headers, dates, checked JSON, file sinks, whole site builds and streams that stop and go on."""

import pytest
from pyspark.sql import functions as F

from quillstone.plans import site_build
from quillstone.sources import front, io
from quillstone.streaming import incremental

YAML = """title: "A: b # no comment"
single: 'it''s'
tags: one, two
list: [a, "b, c", 3]  # comment
items:
  - x
  - "y: z"
nested:
  deep:
    key: v
  other: [p]
text: |
  first
  second
folded: >
  one
  two
none: ~
empty:
url: http://x.org/a#b
title2 : spaced
"""


def test_header_fields():
    assert front.fields(YAML) == {
        "title": ["A: b # no comment"], "single": ["it's"], "tags": ["one", "two"], "list": ["a", "b, c", "3"], "items": ["x", "y: z"], "nested": [], "nested.deep": [],
        "nested.deep.key": ["v"], "nested.other": ["p"], "text": ["first\nsecond"], "folded": ["one two"], "none": [], "empty": [], "url": ["http://x.org/a#b"], "title2": ["spaced"]}
    assert front.fields('title = "T"\ntags = ["a", "b"]\n[params]\nk = 1\n') == {"title": ["T"], "tags": ["a", "b"], "params.k": ["1"]}
    with pytest.raises(ValueError, match="no field"):
        front.fields("[broken")


def test_header_column(spark):
    rows = [("---\ntitle: x\n---\nbody",), ("+++\ntitle = 'y'\n+++\r\nbody",), ("no header",), ("---\n[broken\n---\nz",), (None,), ("",)]
    got = spark.createDataFrame(rows, "text string").select(front.front(F.col("text")).alias("f")).select("f.*").collect()
    assert [dict(r["fields"]) for r in got] == [{"title": ["x"]}, {"title": ["y"]}, {}, {}, {}, {}]
    assert [r["body"] for r in got] == ["body", "body", "no header", "---\n[broken\n---\nz", None, ""]
    assert [r["problem"] is None for r in got] == [True, True, True, False, True, True]


def test_dates_by_precedence(spark):
    rows = [({"date": ["2020-01-01"]}, "2021-01-01", "2022-01-01", "2022-02-02"), ({"modified": ["2020-05-05"], "publishDate": ["2020-06-06"]}, None, "2022-01-01", "2022-02-02"), ({}, "2021-01-01", None, ""), ({}, None, None, None)]
    df = spark.createDataFrame(rows, "h map<string,array<string>>, git string, born string, changed string")
    got = [tuple(r["d"]) for r in df.select(front.dates(F.col("h"), F.col("git"), F.col("born"), F.col("changed")).alias("d")).collect()]
    assert got == [("2020-01-01",) * 3, ("2022-01-01", "2020-05-05", "2020-06-06"), (None, "2021-01-01", None), (None, None, None)]
    first = df.select(front.dates(F.col("h"), F.col("git"), F.col("born"), F.col("changed"), order=("filesystem", "frontmatter")).alias("d")).first()["d"]
    assert tuple(first) == ("2022-01-01", "2022-02-02", "2020-01-01")


def test_checked_json(spark, tmp_path, capsys):
    (tmp_path / "good.json").write_text('{"name": "n", "a": 1}\n{"name": "m", "a": 2}\n')
    assert io.checked(spark, str(tmp_path / "good.json"), "name string, a int").count() == 2
    (tmp_path / "bad.json").write_text('{"name": "n", "a": 1}\n{"name": "m", "a": "' + "x" * 900 + '"}\n')
    with pytest.raises(ValueError, match="m among them"):
        io.checked(spark, str(tmp_path / "bad.json"), "name string, a int")
    assert len(capsys.readouterr().out) < 700


def test_write_files(spark, tmp_path):
    rows = spark.createDataFrame([("a/b.txt", "é"), ("c.txt", "")], "path string, content string")
    assert {tuple(r) for r in io.write_files(rows, str(tmp_path / "o")).collect()} == {("a/b.txt", 2), ("c.txt", 0)}
    assert (tmp_path / "o/a/b.txt").read_text() == "é"
    with pytest.raises(Exception, match="leads out"):
        io.write_files(spark.createDataFrame([("../x", "")], "path string, content string"), str(tmp_path / "o")).collect()


def test_build(spark, tmp_path):
    pages = {"a.md": "---\ntitle: A\naliases: [old/a]\npermalink: p\n---\nTo [[b|B]] %%hidden%% #tag", "sub/b.md": "no header, <b>", "d.md": "---\ndraft: true\n---\n"}
    for name, text in pages.items():
        (tmp_path / "in" / name).parent.mkdir(parents=True, exist_ok=True)
        (tmp_path / "in" / name).write_text(text)
    made = site_build.build(spark, str(tmp_path / "in"), str(tmp_path / "out"), str(tmp_path / "work"))
    assert {r["path"] for r in made.collect()} == {"a.html", "sub/b.html", "old/a.html", "p.html", "static/index/a.json", "static/index/sub/b.json", "sitemap-0.xml", "index.xml"}
    assert 'url=../a"' in (tmp_path / "out/old/a.html").read_text() and "hidden" not in (tmp_path / "out/a.html").read_text()
    assert "&lt;b&gt;" in (tmp_path / "out/sub/b.html").read_text() and "<loc>https://example.com/sub/b</loc>" in (tmp_path / "out/sitemap-0.xml").read_text()
    (tmp_path / "in/e.md").write_text("---\n[broken\n---\n")
    with pytest.raises(Exception, match="bad header in e.md"):
        site_build.build(spark, str(tmp_path / "in"), str(tmp_path / "out2"), str(tmp_path / "work2"))


def test_stream_goes_on(spark, tmp_path):
    """A second run of the same name starts from the state that the first has left."""
    def put(k, kinds):
        spark.createDataFrame([(x, 1.5) for x in kinds], "event_type string, value double").coalesce(1).write.mode("append").parquet(str(tmp_path / "in"))

    schema = "event_type string, value double"
    run = lambda: {r["event_type"]: (r["n"], float(r["total"])) for r in incremental.run_counts(spark, str(tmp_path / "in"), schema, str(tmp_path / "state"), name="x").collect()}
    (tmp_path / "in").mkdir()
    assert run() == {}
    put(0, "aab")
    put(1, "c")
    assert run() == {"a": (2, 3.0), "b": (1, 1.5), "c": (1, 1.5)}
    put(2, "ab")
    assert run() == {"a": (3, 4.5), "b": (2, 3.0), "c": (1, 1.5)}
    assert run() == {"a": (3, 4.5), "b": (2, 3.0), "c": (1, 1.5)}
    assert len([p for p in (tmp_path / "state/counts-x").iterdir() if p.name.startswith("state-")]) <= 2
