"""What the findings of round 3 named: work that grew faster than its input, lists cut short, files that grew in number."""

import time

import numpy as np
import pytest
from pyspark.sql import functions as F

from quillstone.functions import paths as P


def test_links_from_root_take_one_pass(spark):
    """an expression that names another several times is worked out once, so a link takes microseconds."""
    rows = spark.range(0, 20_000, 1, 1).select(F.concat(F.lit("a/e"), F.col("id").cast("string"), F.lit("#B h")).alias("c"))
    P_ = P.from_root(F.lit("a/b/c"), P.internal_link(F.col("c")))
    rows.limit(10).select(P_).collect()
    start = time.time()
    assert rows.where(P_.endswith("#b-h")).count() == 20_000
    assert time.time() - start < 6
    depth = P.from_root(F.lit("a/b/c"), P.internal_link(F.col("c")))._jc.toString()
    assert len(depth) < 20_000


def test_tag_facet_gives_eight(spark):
    """the list of the facet holds eight pages again."""
    import __spark_entry__  # noqa: F401
    from quillstone.queries.registry import QUERIES

    assert QUERIES["search_tag_facet"](spark, "/root/testdata/sf0.01").count() == 8


def test_site_map_is_one_file_in_parts(spark, tmp_path):
    """however many pages there are, the site map is one file; its parts are appended in order."""
    from quillstone.plans import site_build

    pages = spark.range(0, 50, 1, 5).select(F.concat(F.lit("n/"), F.col("id").cast("string")).alias("slug"))
    made = site_build.io.write_files(site_build.sitemap_files(pages, most=7), str(tmp_path)).collect()
    assert [r["path"] for r in made] == ["sitemap-0.xml"]
    text = (tmp_path / "sitemap-0.xml").read_text()
    assert made[0]["bytes"] == len(text) and text.startswith("<urlset ") and text.endswith("</urlset>")
    assert sorted(text.split("<loc>")[1:], key=len) and {x.split("</loc>")[0] for x in text.split("<loc>")[1:]} == {f"https://example.com/n/{i}" for i in range(50)}
    assert text.count("<urlset") == text.count("</urlset>") == 1
    assert site_build.sitemap_files(pages.limit(0)).count() == 0


def test_update_with_a_site_map_in_parts(spark, tmp_path):
    """parts of a file count as one file in an update, which is kept while none of them changes."""
    from quillstone.plans import site_build

    source = tmp_path / "in"
    source.mkdir()
    for i in range(9):
        (source / f"n{i}.md").write_text(f"---\ntitle: t{i}\n---\nbody")
    emitters = {"pages": site_build.page_files, "sitemap": lambda p: site_build.sitemap_files(p, most=2)}
    run = lambda: {r["path"]: r["action"] for r in site_build.update(spark, str(source), str(tmp_path / "out"), str(tmp_path / "work"), emitters=emitters).collect()}
    assert run() == {"sitemap-0.xml": "write", **{f"n{i}.html": "write" for i in range(9)}}
    assert set(run().values()) == {"keep"}
    before = (tmp_path / "out/sitemap-0.xml").read_text()
    (source / "n3.md").unlink()
    assert {k: v for k, v in run().items() if v != "keep"}["n3.html"] == "remove"
    after = (tmp_path / "out/sitemap-0.xml").read_text()
    assert before.count("<loc>") == 9 and after.count("<loc>") == 8 and "n3" not in after


def test_small_chunks_share_tasks(spark, tmp_path):
    """the tasks of an array do not grow in number with its chunks."""
    from quillstone.sources import json_array

    path = tmp_path / "a.json"
    path.write_text("[" + ",".join('{"k": %d}' % i for i in range(5000)) + "]")
    jobs = spark.sparkContext.statusTracker()
    spark.sparkContext.setJobGroup("chunks", "chunks")
    got = json_array.read(spark, str(path), "k long", chunk=64).orderBy("number").collect()
    tasks = [s.numTasks for j in jobs.getJobIdsForGroup("chunks") for i in jobs.getJobInfo(j).stageIds if (s := jobs.getStageInfo(i))]
    spark.sparkContext.setJobGroup("", "")
    assert [r["k"] for r in got] == list(range(5000)) and max(tasks) <= 4 * spark.sparkContext.defaultParallelism


def test_snippet_by_brute_force(spark):
    """with each word's hit worked out once, the window is that of a plain loop."""
    from quillstone.functions import text as X

    rng = np.random.default_rng(5)
    texts = [" ".join(rng.choice(["the", "que", "x", "Thing", "y"], size=n, p=[0.02, 0.02, 0.5, 0.02, 0.44])) for n in (0, 1, 3, 29, 30, 31, 32, 60, 61, 200, 400)] + ["a " * 150, "x y"]

    def plain(text):
        ws = text.split()
        hit = [w.lower().startswith(("th", "que")) for w in ws]
        starts = range(0, len(ws) - 30)
        best = max(starts, key=lambda i: (sum(hit[i : i + 30]), i), default=0)
        a = max(best - 30, 0)
        return a, max(min(a + 60, len(ws) - 1), 0)

    got = spark.createDataFrame([(i, t) for i, t in enumerate(texts)], "i int, t string").select("i", X.highlight(F.col("t"), "th que", trim=True).alias("s")).orderBy("i").collect()
    for r, t in zip(got, texts):
        a, b = plain(t)
        bare = r["s"].replace('<span class="highlight">', "").replace("</span>", "")
        assert bare == ("..." if a else "") + " ".join(t.split()[a:b]) + ("..." if t.split() else ""), t


def test_all_pairs_in_groups_and_shares(spark):
    """the nearest by blocks are those of brute force, with ties by id, whatever the numbers of groups and shares; copies too."""
    from quillstone.operators import neighbours as N

    rng = np.random.default_rng(3)
    x = rng.standard_normal((900, 6))
    x[100:400] = x[7]  # copies
    df = spark.createDataFrame([(i, v.tolist()) for i, v in enumerate(x)], "id long, v array<double>").repartition(5)
    d = np.linalg.norm(x[:, None] - x[None], axis=2)
    np.fill_diagonal(d, np.inf)
    want = {i: [j for _, j in sorted(zip(d[i], range(900)))[:9]] for i in range(900)}
    for queries, counts in ((df, (900, 900)), (df.where("id % 100 = 7"), (9, 900)), (df, (90_000, 900))):
        got = {}
        for r in N.nearest(queries, df, 9, counts).orderBy("source", "d", "target").collect():
            got.setdefault(r["source"], []).append(r["target"])
        assert got == {i: want[i] for i in got} and len(got) == queries.count()
    graph = N.neighbour_graph(df, "id", 5, "v", bucket=50)  # all points are compared
    assert graph.count() == 4500 and N.recall(graph, N.exact_neighbours(df, df, "id", 5, "v")) == 1.0
    assert N.neighbour_graph(df.where("id < 100 OR id >= 400"), "id", 5, "v", bucket=50, whole=0).count() == 3000  # by descent


def test_targets_in_any_number(spark):
    """more than a thousand entries of targets are no error; all are compared."""
    from quillstone.operators import vectors as VO

    rng = np.random.default_rng(4)
    x, card = rng.standard_normal((4000, 5)), np.arange(4000) % 7
    df = spark.createDataFrame([(int(c), v.tolist()) for c, v in zip(card, x)], "card_id long, embedding array<double>")
    unit = x / np.linalg.norm(x, axis=1)[:, None]
    s = unit @ unit.T
    got = {(r["target"], r["card_id"]): r["similarity"] for r in VO.knn(df, df.where("card_id IN (0, 3)"), k=10).collect()}
    assert set(got) == {(t, c) for t in (0, 3) for c in range(7) if c != t}
    for (t, c), value in got.items():
        assert value == pytest.approx(s[np.ix_(card == t, card == c)].max(), abs=1e-12)
