"""Errors, edge cases and invariants that the query parity doesn't show."""

from dataclasses import dataclass

import pytest
from py4j.protocol import Py4JJavaError
from pyspark.errors import PySparkException
from pyspark.sql import functions as F

from quillstone.functions import paths as P
from quillstone.functions import text as X
from quillstone.functions import vectors as V
from quillstone.operators import cards, charts, filters, relational, site
from quillstone.operators import layouts as L
from quillstone.operators import neighbours as N
from quillstone.operators import vectors as VO
from quillstone.plans.catalog import Catalog, Dataset
from quillstone.plans.pipeline import Pipeline, Registry, bind
from quillstone.sources import io
from quillstone.streaming import incremental


def one(spark, expression, **values):
    return spark.range(1).select(*[F.lit(v).alias(k) for k, v in values.items()]).select(expression.alias("x")).first()["x"]


def test_text(spark):
    assert one(spark, X.normalize(F.col("s")), s="‘a’ “b” – — •") == "'a' \"b\" - - *"
    assert one(spark, X.strip_parentheticals(F.col("s")), s="Flying (It flies.) now (x)") == "Flying now"
    for line, kind in (("Flying, haste", "keyword"), ("Cycling {2}", "keyword"), ("Ward 2, Trample", "keyword"), ("Raid - When it attacks", "named"), ("When it dies, draw.", "triggered"),
                       ("{T}: Add {G}.", "activated"), ("Creatures (like: this) get it.", "passive"), ("É à", "passive")):
        assert one(spark, X.line_kind(F.col("s")), s=line) == kind, line
    assert one(spark, X.rule_suffix(F.col("s")), s="100.12ab") == "ab"
    assert one(spark, X.search_tokens(F.col("s")), s="Hi 漢字 there") == ["hi", "漢", "字", "there"]
    assert one(spark, X.wikilinks(F.col("s")), s="see [[a/b#c|label]] and ![[d]]") == ["a/b", "d"]
    assert one(spark, X.hashtags(F.col("s")), s="#one x #two/three #12 #one") == ["one", "two/three"]
    assert one(spark, X.markup(F.col("s")), s="a ==b== %%gone%% --> c") == "a <mark>b</mark>  &rarr; c"
    assert one(spark, X.roam(F.col("s")), s="{{TODO}} __i__ ^^h^^") == "[ ] _i_ ==h=="
    assert one(spark, X.hugo(F.col("s")), s='[t]({{< relref "p" >}}) {{x}}') == "[t](p) "
    assert one(spark, X.unescape_html(X.escape_html(F.col("s"))), s="<a href='x'>&amp;\"") == "<a href='x'>&amp;\""
    long = " ".join(["Word word word."] * 60)
    assert 0 < len(one(spark, X.description(F.col("s")), s=long)) <= 150
    assert one(spark, X.description(F.col("s")), s="x" * 400) == "x" * 300 + "..."
    assert one(spark, X.identity_string(F.array(F.lit("G"), F.lit("W"))), s="") == "WG"
    assert one(spark, X.section(F.col("s"), "none")["right"], s="abc") == ""


def test_paths(spark):
    for f, s, want in ((P.slugify, "a b/c&d%?#/", "a-b/c-and-d-percent"), (P.file_slug, "x/_index.md", "x/index"), (P.file_slug, "x/y.png", "x/y.png"), (P.simplify, "a/index", "a/"), (P.simplify, "index", "/"),
                       (P.path_to_root, "a/b/c", "../.."), (P.path_to_root, "a", "."), (P.extension, "x.md", ".md"), (P.extension, "x", None), (P.strip_slashes, "/a/", "a")):
        assert one(spark, f(F.col("s")), s=s) == want, (f, s)
    assert one(spark, P.resolve_relative(F.col("a"), F.col("b")), a="a/b", b="c/index") == "../c/"
    assert tuple(one(spark, P.split_anchor(F.col("s")), s="p#My Head!")) == ("p", "#my-head")
    assert one(spark, P.is_full_slug(F.col("s")), s="a/b") and not one(spark, P.is_full_slug(F.col("s")), s="./a")
    assert one(spark, P.is_relative(F.col("s")), s="../a") and not one(spark, P.is_simple_slug(F.col("s")), s="a/index")


def test_vectors(spark):
    df = spark.createDataFrame([([1.0, 0.0], [1.0, 1.0], [0.0, 0.0], [1.0])], "a array<float>, b array<float>, z array<float>, s array<float>")
    r = df.select(V.cosine(F.col("a"), F.col("b")), V.cosine(F.col("a"), F.col("z")), V.squared_distance(F.col("a"), F.col("b")), V.component(F.col("s"), 4)).first()
    assert r[0] == pytest.approx(0.5**0.5) and r[1] != r[1] and r[2] == 1.0 and r[3] == 0.0
    with pytest.raises(PySparkException):
        df.select(V.cosine(F.col("a"), F.col("s"))).collect()
    big = spark.range(3000).select("id", V.noise(F.array(F.lit(0.0)), F.col("id"), 2.0, 1)[0].alias("x"))
    m = big.agg(F.avg("x").alias("m"), F.stddev("x").alias("s")).first()
    assert abs(m["m"]) < 0.2 and abs(m["s"] - 2) < 0.2
    with pytest.raises(ValueError):
        VO.knn(df, spark.range(5).select(F.lit("x").alias("card_id"), F.array(F.lit(1.0)).alias("embedding")), most_targets=3)


def test_layout(spark):
    """Neighbours as brute force has them, and clusters that come together in the plane."""
    import numpy as np

    rng = np.random.default_rng(3)
    x = np.concatenate([c + 0.1 * rng.standard_normal((40, 6)) for c in 3 * np.eye(6)[:3]])
    df = spark.createDataFrame([(i, v.tolist()) for i, v in enumerate(x)], "id long, embedding array<double>")
    d = np.sqrt(((x[:, None] - x[None]) ** 2).sum(2))
    np.fill_diagonal(d, np.inf)
    near = {(r["source"], r["target"]) for r in N.neighbour_graph(df, "id", 5).collect()}
    assert near == {(i, int(j)) for i in range(120) for j in np.argsort(d[i])[:5]}
    parts = N.neighbour_graph(df, "id", 5, bucket=30).collect()
    assert np.mean([(r["source"], r["target"]) in near for r in parts]) > 0.6 and len({r["source"] for r in parts}) == 120
    got = {r["id"]: tuple(r["components"]) for r in L.umap(df, "id", neighbors=8, min_dist=0.1, epochs=3).collect()}
    y = np.array([got[i] for i in range(120)])
    own = np.repeat([0, 1, 2], 40)
    closest = [np.argsort(((y - y[i]) ** 2).sum(1))[1:6] for i in range(120)]
    assert np.mean([(own[c] == own[i]).mean() for i, c in enumerate(closest)]) > 0.8
    graph = L.fuzzy_graph(N.neighbour_graph(df, "id", 4))
    once = lambda: sorted(map(tuple, L.layout(df.select("id"), graph, 0.5, 1, 7).collect()))
    assert [x[0] for x in once()] == list(range(120))
    assert L.umap(df.limit(0), "id", epochs=1).count() == 0


def test_projections(spark):
    e = spark.read.parquet("/root/testdata/sf0.001/embeddings.parquet")
    p = VO.pca(e, "vec_id", rank=3).select([F.col("components")[i].alias(f"c{i}") for i in range(3)]).toPandas()
    assert abs(p.mean()).max() < 1e-6 and list(p.var().sort_values(ascending=False).index) == list(p.columns)
    assigned, stats = VO.kmeans(e, "vec_id", k=5)
    assert assigned.agg(F.min("cluster_id")).first()[0] == 1 and stats.agg(F.sum("n")).first()[0] == e.count()


def test_cards(spark):
    assert one(spark, cards.enum(F.col("s"), cards.RARITIES), s="odd") == "common"
    assert one(spark, cards.colors(F.array(F.lit("W"), F.lit("x")))) == ["W"] and one(spark, cards.colors(F.array(F.lit("x")))) is None
    doc = spark.createDataFrame([([("{T}", None), ("{T}", 1.0)],)], "data array<struct<symbol string, cmc double>>")
    with pytest.raises(PySparkException):
        cards.symbols(doc).collect()
    none = spark.createDataFrame([(None,)], "color_identity array<string>")
    assert none.select(filters.subset_of("color_identity", ["W"])).first()[0] is False
    assert none.select(filters.legal("nonsense", "2020-01-01", False)).first()[0] is True


def test_relational(spark):
    left, right = spark.createDataFrame([(1,), (2,)], "k int"), spark.createDataFrame([(1, "a")], "k int, v string")
    with pytest.raises(PySparkException):
        relational.must_match(left, right, "k").collect()
    with pytest.raises(ValueError):
        relational.sample_share(left, "k", 0)
    flat = spark.createDataFrame([([1.0],), ([1.0],)], "v array<double>")
    assert [tuple(r)[:3] for r in relational.histogram(flat, "v", 4).collect()] == [(0, 0, 2)]
    same = spark.createDataFrame([(1, 2.0), (1, 2.0)], "g int, x double")
    assert {r["x"] for r in relational.minmax(same, ["x"], ["g"]).collect()} == {0.5}


def test_charts(spark):
    bad = spark.createDataFrame([("passive", "t", [1.0])], "k string, t string, components array<double>")
    with pytest.raises(PySparkException):
        charts.scatter(bad, "k", "t").collect()
    assert one(spark, charts.colored(F.array(F.lit("U")), F.lit("k"))) == "U"
    assert one(spark, charts.colored(F.array().cast("array<string>"), F.lit("k"))) == "Colorless"


def test_site(spark):
    pages = spark.createDataFrame([("a", ["b"]), ("b", ["c"]), ("c", ["a"]), ("d", ["d"])], "slug string, embeds array<string>")
    got = {(r[0], r[1]) for r in site.transclude(pages).collect()}
    assert got == {("a", "b"), ("a", "c"), ("b", "c"), ("b", "a"), ("c", "a"), ("c", "b")}
    links = spark.createDataFrame([("a", "b"), ("b", "c"), ("c", "a"), ("x", "y")], "source string, target string")
    found = site.neighbourhood(links, spark.createDataFrame([("a",)], "node string"), -1)
    assert {r["node"] for r in found.collect()} == {"a", "b", "c"}
    heads = site.headings(spark.createDataFrame([(1, "## A\ntext\n### B!\n## A\n#no"), (2, "# only")], "id int, t string"), "id", "t")
    assert sorted(tuple(r) for r in heads.collect()) == [(1, 1, 0, "A", "a"), (1, 2, 1, "B!", "b"), (1, 3, 0, "A", "a-1")]


def test_sources(spark, tmp_path):
    (tmp_path / "bad.json").write_text('[{"a": 1}, {"a": "x"}]')
    with pytest.raises((PySparkException, Py4JJavaError)):
        io.read_json(spark, str(tmp_path / "bad.json"), "a int").collect()
    assert io.read_json(spark, str(tmp_path / "bad.json"), "a int", strict=False).cache().where("_corrupt_record IS NOT NULL").count() >= 1
    lines = spark.createDataFrame([('{"name": "n", "a": 1}',), ('{"name": "m", "a": "x"}',)], "value string")
    assert [tuple(r) for r in io.record_diagnostics(lines, "name string, a int").collect()] == [('{"name": "m", "a": "x"}', "m")]
    (tmp_path / "notes").mkdir()
    (tmp_path / "notes/a.md").write_text("---\ntitle: A page\ntags: x, y\ntitle: 'Last'\n---\nBody")
    (tmp_path / "notes/b.txt").write_text("no")
    assert [r["path"][-4:] for r in io.glob_files(spark, str(tmp_path), "*.md", (r"/\.git/",)).collect()] == ["a.md"]
    f = io.read_text(spark, str(tmp_path / "notes/a.md")).select(io.front_matter(F.col("text")).alias("f")).first()["f"]
    assert f["fields"] == {"title": "Last", "tags": "x, y"} and f["body"] == "Body"
    assert one(spark, io.strip_data_prefix(F.col("s")), s="data:image/png;base64,QUI=") == b"AB"


def test_pipeline_runner(spark, tmp_path):
    c = Catalog(spark, str(tmp_path))
    for name, fmt, schema in (("a", "memory", None), ("b", "csv", "id long"), ("c", "parquet", None), ("e", "memory", None)):
        c.add(Dataset(name, format=fmt, schema=schema))
    with pytest.raises(ValueError):
        c.add(Dataset("a", format="csv"))
    with pytest.raises(KeyError):
        c.read("a")
    c.write("a", spark.range(10).withColumnRenamed("id", "id"))
    p = Pipeline("p").add_node("two", lambda b: (b.where("id > 5"), b.where("id <= 5")), ("b",), ("c", "e")).add_node("one", lambda a: a, ("a",), ("b",))
    r = Registry(c)
    r.register(p)
    assert r.run() == {"p": ["one", "two"]} and c.read("c").count() == 4 and c.read("e").count() == 6
    assert "one --> b" in p.mermaid()
    with pytest.raises(KeyError):
        r.run("nothing")
    with pytest.raises(ValueError):
        Pipeline("x").add_node("n", None, ("b",), ("a",)).add_node("m", None, ("a",), ("b",)).order()
    with pytest.raises(ValueError):
        p.add_node("again", None, (), ("c",))

    @dataclass(frozen=True)
    class Params:
        k: int = 1

    assert bind(Params, {"k": 3}).k == 3
    with pytest.raises(ValueError):
        bind(Params, {"kk": 3})


def test_incremental(spark):
    pages = spark.createDataFrame([("a", ["x"]), ("b", ["x", "y"]), ("c", ["z"])], "slug string, tags array<string>")
    assert {r[0] for r in incremental.affected(pages, spark.createDataFrame([("a",)], "slug string")).collect()} == {"a", "b"}


def test_descent_finds_neighbours(spark):
    """From small buckets, with copies of a point that many have as a neighbour, and nulls."""
    import numpy as np

    rng = np.random.default_rng(8)
    x = rng.standard_normal((900, 24))
    x[:150] = x[0]  # copies
    df = spark.createDataFrame([(i, v.tolist()) for i, v in enumerate(x)] + [(9999, None), (5, x[5].tolist())], "id long, embedding array<double>")
    exact = N.exact_neighbours(df, df.where("id % 7 = 0"), "id", 10)
    d = np.sqrt(((x[:, None] - x[None]) ** 2).sum(2))
    np.fill_diagonal(d, np.inf)
    by = {}
    for r in exact.collect():
        by.setdefault(r["source"], []).append(r["d"])
    assert set(by) == set(range(0, 900, 7))
    for i, got in by.items():
        assert np.allclose(sorted(got), np.sort(d[i])[:10], atol=1e-9)
    graph = N.neighbour_graph(df, "id", 10, bucket=40)
    counts = {r["source"]: r["n"] for r in graph.groupBy("source").agg(F.count("*").alias("n")).collect()}
    assert counts == {i: 10 for i in range(900)}
    start = N.neighbour_graph(df, "id", 10, bucket=40, rounds=0)
    assert N.recall(start, exact) < 0.7 and N.recall(graph, exact) > 0.97


def test_bandwidths():
    import numpy as np
    import pandas as pd

    rng = np.random.default_rng(1)
    lists = [np.sort(rng.random(k) * 5) for k in (15, 15, 7)] + [np.zeros(5), np.r_[0.0, 0.0, 1.0, 2.0], np.array([3.0]), np.full(6, 2.0)]
    got = L.bandwidths(pd.Series(lists))
    for d, (rho, sigma) in zip(lists[:3], got.to_numpy()):
        assert rho == d.min() and abs(np.exp(-np.maximum(d - rho, 0) / sigma).sum() - np.log2(len(d))) < 1e-6
    assert (got["sigma"] > 0).all() and got["rho"].tolist()[3:] == [0.0, 1.0, 3.0, 2.0]


def test_layout_keeps_neighbourhoods(spark):
    """Clusters and what is within them, also where blocks are small; the same places on a second run."""
    import numpy as np

    rng = np.random.default_rng(5)
    t = rng.random(400) * 6
    x = np.c_[np.cos(t) * t, np.sin(t) * t, 0.05 * rng.standard_normal((400, 4))]  # a spiral
    df = spark.createDataFrame([(i, v.tolist()) for i, v in enumerate(x)], "id long, embedding array<double>")
    made = L.umap(df, "id", neighbors=12, min_dist=0.1, epochs=100).checkpoint()
    assert N.trustworthiness(df, made, df, "id") > 0.95
    places = lambda f: {r["id"]: tuple(r["components"]) for r in f.collect()}
    again = places(L.umap(df, "id", neighbors=12, min_dist=0.1, epochs=100))
    assert all(np.allclose(again[i], p, atol=1e-3) for i, p in places(made).items())
    blocks = L.umap(df, "id", neighbors=12, min_dist=0.1, epochs=100, block=60, others=100)
    assert N.trustworthiness(df, blocks, df, "id") > 0.93
    shuffled = df.select("id", F.array(F.rand(3), F.rand(4)).alias("components")).checkpoint()
    assert abs(N.trustworthiness(df, shuffled, df, "id") - 0.5) < 0.1


def test_trustworthiness_by_brute_force(spark):
    import numpy as np

    rng = np.random.default_rng(6)
    x, y, k = rng.standard_normal((90, 5)), rng.standard_normal((90, 2)), 7
    y[:, 0] += 2 * x[:, 0]
    points = spark.createDataFrame([(i, v.tolist()) for i, v in enumerate(x)], "id long, embedding array<double>")
    placed = spark.createDataFrame([(i, v.tolist()) for i, v in enumerate(y)], "id long, components array<double>")
    dist = lambda z: np.sqrt(((z[:, None] - z[None]) ** 2).sum(2)) + np.diag([np.inf] * len(z))
    rank = dist(x).argsort(1).argsort(1) + 1
    worse = sum(max(0, rank[i, j] - k) for i in range(90) for j in dist(y)[i].argsort()[:k])
    want = 1 - 2 / (90 * k * (2 * 90 - 3 * k - 1)) * worse
    assert abs(N.trustworthiness(points, placed, points, "id", k) - want) < 1e-9


def test_legality(spark):
    rows = [("a", {"commander": "legal"}), ("b", {"commander": "restricted"}), ("c", {"commander": "not_legal"}), ("d", {"commander": "banned"}), ("e", {"modern": "legal"}), ("f", None), ("g", {"commander": None})]
    held = cards.parse(spark.createDataFrame(rows, "id string, legalities map<string,string>"), ["card_id", "released_at", "legal"])
    assert held.columns == ["card_id", "released_at", "legal"]
    kept = {r["card_id"] for r in held.where(filters.legal(" Commander ", "2020-01-01", True)).collect()}
    assert kept == {"a", "b"}
