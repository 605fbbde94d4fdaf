"""Ignore files, arrays of any size, code in texts, embeds, stored indexes, lists in parts, builds that go on, and streams of changes."""

import json
import random
import re
from fnmatch import translate

import numpy as np
import pytest
from pyspark.sql import functions as F

from quillstone.functions import text as X
from quillstone.operators import pages as PG
from quillstone.operators import site
from quillstone.plans import site_build
from quillstone.sources import ignore, json_array
from quillstone.streaming import folder_changes, keyed_state


# ignore files


def brute_ignored(path, text):
    """A plain walk down from the top: each folder, then the file, by the last rule that matches."""
    rules = []
    for line in text.splitlines():
        line = line.rstrip(" ")
        if line and not line.startswith("#"):
            keeps = line.startswith("!")
            line = line[keeps:]
            rules.append((line.strip("/").split("/"), keeps, line.endswith("/"), "/" in line[:-1]))

    def match(glob, parts):
        if not glob:
            return not parts
        if glob[0] == "**":
            if len(glob) == 1:
                return len(parts) > 0
            return any(match(glob[1:], parts[k:]) for k in range(len(parts) + 1))
        return bool(parts) and re.match(translate(glob[0]), parts[0]) is not None and match(glob[1:], parts[1:])

    parts = path.split("/")
    for n in range(1, len(parts) + 1):
        out = False
        for glob, keeps, folders, tied in rules:
            if folders and n == len(parts):
                continue
            if match(glob, parts[:n]) if tied else match(glob, parts[n - 1 : n]):
                out = not keeps
        if out:
            return True
    return False


RULES = "# c\n\n*.log\n!keep.log\n/top\nbuild/\na/*/c\n**/deep/x\nlogs/**\ndoc/**/z\n[ab]?.t\n!logs/good\nq[!r]\n*.md\n!/a/b.md\n"


def test_ignore_rules(spark):
    rng = random.Random(4)
    names = ["a", "b", "c", "top", "build", "deep", "x", "logs", "doc", "z", "keep.log", "n.log", "a1.t", "c1.t", "qr", "qs", "b.md", "good", "README.md", "é.log"]
    paths = sorted({"/".join(rng.choices(names, k=rng.randint(1, 5))) for _ in range(4000)})
    df = spark.createDataFrame([(p,) for p in paths], "path string")
    found = {r["path"]: r["i"] for r in df.select("path", ignore.ignored(F.col("path"), RULES).alias("i")).collect()}
    assert len(found) == len(paths) and found == {p: brute_ignored(p, RULES) for p in paths}
    assert 0.2 < np.mean(list(found.values())) < 0.95
    assert df.where(ignore.ignored(F.col("path"), "# nothing\n")).count() == 0


def test_ignore_of_page_paths(spark):
    pages = spark.read.parquet("/root/testdata/sf0.1/pages.parquet")
    path = F.regexp_extract("url", r"^https?://(.*?)/*$", 1)
    rules = "*page=2*\n/m.*/en/\n!/blog.*/\nde/*\n"
    df = pages.select(path.alias("path")).distinct()
    for r in df.select("path", ignore.ignored(F.col("path"), rules).alias("i")).collect():
        assert r["i"] == brute_ignored(r["path"], rules), r["path"]


# arrays


def test_json_array(spark, tmp_path, capsys):
    rng = random.Random(3)
    odd = ['a"b', "\\", "\\\\\"", "]}", "[{,", "ü€😀", "", "x" * 400]
    rows = [{"name": rng.choice(odd) + str(i), "a": i, "l": [[rng.choice(odd)], {"k": rng.choice(odd)}]} for i in range(300)]
    path = tmp_path / "a.json"
    for text in (json.dumps(rows), json.dumps(rows, indent=2, ensure_ascii=False), "﻿" + json.dumps(rows)):
        path.write_text(text, encoding="utf-8")
        for chunk in (300, 1 << 20):
            got = json_array.read(spark, str(path), "name string, a long", chunk=chunk).orderBy("number").collect()
            assert [(r["number"], r["name"], r["a"]) for r in got] == [(i, x["name"], x["a"]) for i, x in enumerate(rows)]
    for text, n in (("[]", 0), (" [ ] \n", 0), ("[1]", 1), ('["]",[2,3],{"a":"\\\\"}]', 3)):
        path.write_text(text)
        assert json_array.elements(spark, str(path), chunk=2).count() == n
    for text in ("", "{}", "[1", "[1]]", "[1] 2", '["x]', "[1,,2]", "[1],[2]", "[,1]", "[1,]"):
        path.write_text(text)
        with pytest.raises(Exception, match="array|element"):
            json_array.elements(spark, str(path), chunk=3).count()
    rows[207] = {"name": "bad one", "a": "y" * 900}
    path.write_text(json.dumps(rows))
    with pytest.raises(ValueError, match="element 207 "):
        json_array.read(spark, str(path), "name string, a long", chunk=512)
    out = capsys.readouterr().out
    assert "element 207 (bad one)" in out and len(out) < 700


# code


def brute_code(text):
    """Line by line: fences, then comments and spans outside of them."""
    out, fence, lines = [], None, text.split("\n")
    for line in lines:
        m = re.match(r" {0,3}(`{3,}(?=[^`]*$)|~{3,})", line)
        if fence is None and m:
            fence = m[1]
            out.append(True)
        elif fence is not None:
            out.append(True)
            end = re.match(r" {0,3}(`+|~+)[ \t]*$", line)
            if end and end[1][0] == fence[0] and len(end[1]) >= len(fence):
                fence = None
        else:
            out.append(False)
    return [x for x, code in zip(lines, out) if not code]


def test_code_is_left_alone(spark):
    rng = random.Random(7)
    pool = ["# head", "text ==m== --> x", "```", "```py", "~~~", "~~~~", "  ````", "`` ", "a ``` b", "    ```", "", "[[link]] #tag", "~~~ ~~~"]
    texts = ["\n".join(rng.choices(pool, k=rng.randint(1, 14))) for _ in range(600)]
    df = spark.createDataFrame(list(enumerate(texts)), "id int, text string")
    for r in df.select("text", X.without_blocks(F.col("text")).alias("t")).collect():
        assert [x for x in r["t"].split("\n") if x.strip()] == [x for x in brute_code(r["text"]) if x.strip()], r["text"]
    one = lambda t, f: spark.createDataFrame([(t,)], "t string").select(f(F.col("t")).alias("x")).first()["x"]
    assert one("a `==b==` ==c== ``x ` --> y`` --> \n```\n==d== -->\n```\n==e==", X.markup) == "a `==b==` <mark>c</mark> ``x ` --> y`` &rarr; \n```\n==d== -->\n```\n<mark>e</mark>"
    assert one("[[a]] `[[b]]` <!-- [[c]] --> ![[d#x|y]]\n~~~\n[[e]]\n", X.wikilinks) == ["a", "d"]
    assert one("#a `#b`\n```\n #c\n```\n#d 1", X.hashtags) == ["a", "d"]
    assert one("` " * 20_000 + "x" * 100_000, X.without_code) is not None  # long texts don't exhaust the stack
    heads = site.headings(spark.createDataFrame([(1, "# A\n```\n# B\n```\n## C\n<!--\n# D\n-->\n# `E`")], "id int, text string"), "id", "text")
    assert [(r["title"], r["depth"]) for r in heads.orderBy("ordinal").collect()] == [("A", 0), ("C", 1), ("`E`", 0)]


# embeds


def brute_expand(pages, slug):
    seen = {slug}

    def body(text):
        def put(m):
            to = m[1]
            if to in seen:
                return f"Circular transclusion detected: {to}"
            seen.add(to)
            return body(pages[to]) if to in pages else m[0]

        return re.sub(r"!\[\[([^\]]*)\]\]", put, text)

    return body(pages[slug])


def test_embeds_expand(spark):
    rng = random.Random(9)
    names = [f"p{i}" for i in range(40)]
    pages = {n: " ".join([n, *(f"![[{rng.choice([*names, 'none'])}]] t{k}" for k in range(rng.choice([0, 0, 0, 1, 2])))]) for n in names}
    df = spark.createDataFrame(list(pages.items()), "slug string, content string")
    found = {r["slug"]: r["content"] for r in PG.expand(df).collect()}
    assert found == {n: brute_expand(pages, n) for n in names}
    parts = [("a", "x ![[b b#H one|label]] y `![[c]]` ![[b-b#^id]]"), ("b-b", "# H one\nunder ![[c]]\n# Two\n\npara ^id"), ("c", "C")]
    got = {r["slug"]: r["content"] for r in PG.expand(spark.createDataFrame(parts, "slug string, content string")).collect()}
    assert got["c"] == "C" and got["a"].startswith("x # H one\nunder C y `") and got["a"].endswith("Circular transclusion detected: b-b")
    assert PG.expand(df.limit(0)).count() == 0


def test_transclusion_pairs(spark):
    """Dense graphs, in which paths multiply."""
    names = [f"p{i}" for i in range(12)]
    df = spark.createDataFrame([(n, [m for m in names if m != n]) for n in names] + [("q", ["p0"]), ("r", [])], "slug string, embeds array<string>")
    assert {(r["slug"], r["included"]) for r in site.transclude(df).collect()} == {(a, b) for a in [*names, "q"] for b in names if a != b}
    assert {r["included"] for r in site.transclude(df, 1).where("slug = 'q'").collect()} == {"p0"}


# indexes and lists


def test_stored_index(spark, tmp_path):
    pages = spark.createDataFrame([(f"s{i}", f"alpha{i % 7} Beta{i}", f"gamma{i % 50} 日本{i}") for i in range(400)], "slug string, title string, content string")
    stored = site.store_index(pages, str(tmp_path / "index"), parts=6)
    for q in ("alpha3", "be gam", "gamma1 alpha", "日", "none"):
        assert sorted(map(tuple, site.search(stored, q).collect())) == sorted(map(tuple, site.search(site.index(pages), q).collect()))
    plan = site.search(stored, "gam")._jdf.queryExecution().executedPlan().toString()
    assert "PushedFilters: [IsNotNull(token), GreaterThanOrEqual(token,gam), LessThan(token,gan)]" in plan
    bounds = sorted((min(t), max(t)) for t in ([r["token"] for r in spark.read.parquet(str(p)).collect()] for p in (tmp_path / "index").glob("*.parquet")) if t)
    assert len(bounds) > 3 and all(a[1] <= b[0] for a, b in zip(bounds, bounds[1:]))  # a prefix is in few files
    assert site.after("a") == "b" and site.after("a\U0010ffff") == "b" and site.after("퟿") == "" and site.after("\U0010ffff") is None


def test_ordered_lists(spark):
    rng = random.Random(2)
    rows = [("hot" if rng.random() < 0.7 else rng.choice("abc"), rng.choice([None, *range(4)]), f"t{rng.randint(0, 99):02}") for _ in range(500)]
    df = spark.createDataFrame([(k, d, t, i) for i, (k, d, t) in enumerate(rows)], "k string, d int, t string, i int")
    got = site.ordered(df, "k", [F.coalesce(-F.col("d"), F.lit(1)), F.substring("t", 1, 2)], [F.col("t"), F.col("i")]).collect()
    assert len(got) == 500
    for k in "hot", "a", "b", "c":
        mine = sorted((r for r in got if r["k"] == k), key=lambda r: r["place"])
        assert [r["place"] for r in mine] == list(range(1, len(mine) + 1))
        key = lambda r: (r["d"] is None, -(r["d"] or 0), r["t"], r["i"])
        assert mine == sorted(mine, key=key)


# builds that go on


def test_update_equals_a_whole_build(spark, tmp_path):
    source = tmp_path / "in"

    def put(name, text):
        (source / name).parent.mkdir(parents=True, exist_ok=True)
        (source / name).write_bytes(text if isinstance(text, bytes) else text.encode())

    def files(at):
        return {str(p.relative_to(at)): p.read_bytes() for p in at.rglob("*") if p.is_file() and not p.name.startswith(".")}

    put("a.md", "---\ntitle: A\ntags: [x/y]\naliases: [old]\ndate: 2024-01-01\nmodified: 2024-01-02\n---\nbody ![](pic.PNG)")
    put("sub/b.md", "---\ntags: [x]\nmodified: 2024-01-03\n---\nto [[a]]")
    put("sub/index.md", "---\ntitle: My folder\nmodified: 2024-01-01\n---\n")
    put("tags/x.md", "---\ntitle: All of x\nmodified: 2024-01-01\n---\n")
    put("pic.PNG", bytes(range(256)))
    put("drafts/z.md", "z")
    put("skip.tmp", "no")
    (tmp_path / "static").mkdir()
    (tmp_path / "static/s.css").write_text("p{}")
    run = lambda out, work: {r["path"]: r["action"] for r in site_build.update(spark, str(source), str(tmp_path / out), str(tmp_path / work), rules="*.tmp\n/drafts/\n", static=str(tmp_path / "static")).collect()}
    first = run("out", "work")
    assert set(first.values()) == {"write"} and set(first) == set(files(tmp_path / "out"))
    assert {"tags/x.html", "tags/x/y.html", "tags/index.html", "sub/index.html", "pic.PNG", "static/s.css", "old.html"} <= set(first) and "skip.tmp" not in first
    assert (tmp_path / "out/pic.PNG").read_bytes() == bytes(range(256))
    # authored pages of a tag or folder give the list its title
    assert "<title>All of x</title>" in (tmp_path / "out/tags/x.html").read_text() and "2 items" in (tmp_path / "out/tags/x.html").read_text()
    assert "<title>My folder</title>" in (tmp_path / "out/sub/index.html").read_text()
    assert set(run("out", "work").values()) == {"keep"}
    put("a.md", "---\ntitle: A2\ntags: [new]\nmodified: 2024-01-02\n---\nother")
    (source / "sub/b.md").unlink()
    (source / "pic.PNG").unlink()
    put("c/d.md", "---\nmodified: 2024-01-02\n---\nd")
    second = run("out", "work")
    assert second["old.html"] == second["sub/b.html"] == second["pic.PNG"] == second["tags/x/y.html"] == "remove" and second["a.html"] == second["c/d.html"] == second["c/index.html"] == "write"
    assert second["static/s.css"] == "keep"
    run("whole", "work2")
    assert files(tmp_path / "out") == files(tmp_path / "whole")


def test_update_after_one_that_was_cut_short(spark, tmp_path):
    (tmp_path / "in").mkdir()
    (tmp_path / "in/a.md").write_text("one")
    run = lambda **kw: {r["path"]: r["action"] for r in site_build.update(spark, str(tmp_path / "in"), str(tmp_path / "out"), str(tmp_path / "work"), **kw).collect()}
    run()
    (tmp_path / "in/a.md").write_text("two")

    def broken(pages):
        return pages.select(F.lit("z").alias("path"), F.raise_error(F.lit("cut short")).cast("string").alias("content"))

    with pytest.raises(Exception, match="cut short"):
        run(emitters={**site_build.ALL_EMITTERS, "broken": broken})
    assert run()["a.html"] == "write" and "two" in (tmp_path / "out/a.html").read_text()


# streams


def test_folder_changes(spark, tmp_path):
    source = tmp_path / "in"

    def put(name, text):
        (source / name).parent.mkdir(parents=True, exist_ok=True)
        (source / name).write_text(text)

    def run():
        stream = folder_changes.changes(spark, str(source), str(tmp_path / "state"), parts=3)
        stream.writeStream.format("parquet").option("checkpointLocation", str(tmp_path / "progress")).trigger(availableNow=True).start(str(tmp_path / "events")).awaitTermination()
        got = {(r["version"], r["path"], r["kind"]) for r in spark.read.schema(folder_changes.SCHEMA).parquet(str(tmp_path / "events")).collect()}
        new, run.seen = got - run.seen, got
        return new

    run.seen = set()
    for i in range(9):
        put(f"d{i % 2}/f{i}", "x")
    assert run() == {(1, f"d{i % 2}/f{i}", "add") for i in range(9)}
    assert run() == set()
    put("d0/f0", "longer")
    (source / "d1/f1").unlink()
    put("é/new", "")
    assert run() == {(2, "d0/f0", "change"), (2, "d1/f1", "delete"), (2, "é/new", "add")}
    (source / "é/new").unlink()
    put("d1/f1", "back")
    assert run() == {(3, "é/new", "delete"), (3, "d1/f1", "add")}
    assert len([p for p in (tmp_path / "state").iterdir()]) <= 3  # older listings go


def test_keyed_state(spark, tmp_path):
    """Rows in any order over two runs; a deletion outlives older rows and is forgotten in time."""
    schema = "key string, at long, tie long, kind string, body string"
    put = lambda rows: spark.createDataFrame(rows, schema).coalesce(1).write.mode("append").parquet(str(tmp_path / "in"))
    stream = lambda: spark.readStream.schema(schema).option("maxFilesPerTrigger", 1).parquet(str(tmp_path / "in"))
    provider = spark.conf.get(keyed_state.PROVIDER)
    run = lambda **kw: {r["key"]: (r["at"], r["kind"], r["body"]) for r in keyed_state.run_latest(stream(), str(tmp_path / "progress"), **kw).collect()}
    put([("a", 2, 0, "add", "a2"), ("b", 1, 0, "add", "b1"), ("a", 1, 0, "add", "a1")])
    put([("b", 5, 0, "delete", None), ("c", 1, 1, "add", "c1"), ("c", 1, 2, "change", "c2")])
    assert run() == {"a": (2, "add", "a2"), "b": (5, "delete", None), "c": (1, "change", "c2")}
    put([("b", 4, 0, "change", "late"), ("a", 1, 9, "change", "late"), ("d", 1, 0, "add", "d1")])
    assert run() == {"a": (2, "add", "a2"), "b": (5, "delete", None), "c": (1, "change", "c2"), "d": (1, "add", "d1")}
    put([("b", 6, 0, "add", "b6")])
    assert run()["b"] == (6, "add", "b6")
    assert spark.conf.get(keyed_state.PROVIDER) == provider
