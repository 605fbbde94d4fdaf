"""Scalar functions on literal inputs."""

import pytest
from pyspark.sql import functions as F

from quillstone.functions import paths as P
from quillstone.functions import text as X

CASES: dict[str, tuple] = {}


def case(name, function, rows):
    CASES[name] = (function, rows)


case("fn_line_kind", X.line_kind, [("Flying, haste", "keyword"), ("Ward {2}", "keyword"), ("Raid - When it attacks", "named"), ("When it dies, draw.", "triggered"), ("{T}: Add {G}.", "activated"), ("It (the one: here) stays.", "passive")])
case("fn_rule_suffix", X.rule_suffix, [("100.1a", "a"), ("100.12", ""), ("702.19bc x", "bc")])
case("fn_file_slug", P.file_slug, [("x/_index.md", "x/index"), ("a b/c&d.md", "a-b/c-and-d"), ("img/y.png", "img/y.png"), ("/lead/t.html", "lead/t")])
case("fn_simplify_slug", P.simplify, [("a/index", "a/"), ("index", "/"), ("a/b", "a/b")])
case("fn_path_to_root", P.path_to_root, [("a", "."), ("a/b", ".."), ("a/b/c", "../..")])
case("fn_extension", lambda c: F.coalesce(P.extension(c), F.lit("none")), [("a.md", ".md"), ("a/b", "none")])
case("fn_is_folder", P.is_folder, [("a/", "true"), ("a/index", "true"), ("a/b", "false")])
case("fn_full_slug", P.is_full_slug, [("a/b", "true"), ("./a", "false"), ("a b", "false")])
case("fn_split_anchor", lambda c: F.concat(P.split_anchor(c)["path"], F.lit("|"), P.split_anchor(c)["anchor"]), [("p#My Head!", "p|#my-head"), ("p", "p|")])
case("fn_wikilinks", lambda c: F.array_join(X.wikilinks(c), ","), [("see [[a/b#c|label]] and ![[d]]", "a/b,d"), ("none", "")])
case("fn_hashtags", lambda c: F.array_join(X.hashtags(c), ","), [("#one x #two/three #12 #one", "one,two/three")])
case("fn_markup", X.markup, [("a ==b== %%gone%% --> c", "a <mark>b</mark>  &rarr; c")])
case("fn_roam", X.roam, [("{{TODO}} __i__ ^^h^^", "[ ] _i_ ==h==")])
case("fn_hugo", X.hugo, [('[t]({{< relref "p" >}})', "[t](p)")])
case("fn_description", X.description, [("One. Two.", "One. Two."), ("See https://a.example.com/x/y now.", "See a.example.com/x/y now.")])
case("fn_coerce_list", lambda c: F.array_join(X.coerce_list(c), "|"), [("a, b,,c ", "a|b|c")])
case("fn_query_prefixes", lambda c: F.array_join(X.prefixes(F.split(c, " "), " "), "|"), [("a b c", "a|a b|a b c")])
case("fn_identity", lambda c: X.identity_string(F.split(c, "")), [("GW", "WG"), ("xyz", "Colorless")])
case("fn_tokens_cjk", lambda c: F.array_join(X.search_tokens(c), "|"), [("Hi 漢字 there", "hi|漢|字|there")])
case("fn_hover_price", lambda c: F.format_string("%s - $%.2f", c, F.lit(1.5)), [("Card", "Card - $1.50")])
case("fn_date_short", lambda c: F.date_format(F.coalesce(F.try_to_timestamp(c), F.lit("1970-01-01").cast("timestamp")), "MMM dd, yyyy"), [("2024-02-03", "Feb 03, 2024"), ("bad", "Jan 01, 1970")])
case("fn_split_two", lambda c: F.concat_ws("|", X.split_two(c, ": ")["head"], X.split_two(c, ": ")["tail"]), [("{T}: Add {G}.", "{T}|Add {G}."), ("x", "x|")])
case("fn_internal_link", P.internal_link, [
    ("", "."), ("./", "./"), ("./index#Top", "./#top"), ("a b/note.md", "./a-b/note"), ("../x/y.pdf", "../x/y.pdf"), ("tags/", "./tags/"), ("d/index", "./d/"), ("p%20q#An Anchor!", "./p-q#an-anchor")])
case("fn_from_root", lambda c: P.from_root(F.lit("a/b/c"), P.internal_link(c)), [("d/e", "../../d/e"), ("d/", "../../d/"), ("f#G h", "../../f#g-h")])
case("fn_resolve_url", lambda c: P.resolve_url(F.lit("a/b/c"), c), [("./d", "a/b/d"), ("../d/", "a/d/"), ("../../../d#x", "d"), ("", "a/b/c"), ("/r/s", "r/s")])
case("fn_join_segments", lambda c: P.join_segments(c, F.lit("b/")), [("a/", "a/b/"), ("/a", "/a/b/"), ("", "b/")])
case("fn_pdf_anchor", lambda c: F.concat_ws("|", P.split_anchor(c)["path"], P.split_anchor(c)["anchor"]), [("x.pdf#page=2", "x.pdf|#page=2"), ("x#page=2", "x|#page2")])
case("fn_block", lambda c: F.coalesce(X.block(c, F.lit("id")), F.lit("none")), [("one\n\ntwo\nlines ^id\n\nthree", "two\nlines"), ("- a\n- b ^id", "- b"), ("no", "none")])
case("fn_under_heading", lambda c: F.coalesce(X.under_heading(c, F.lit("b-1")), F.lit("none")), [("# B\nx\n## B\ny\n### C\nz\n## D\nw", "## B\ny\n### C\nz"), ("# B\nx", "none")])
case("fn_natural_key", X.natural_key, [("Note 10", "note 00000000000000000010"), ("b", "b")])
case("fn_clamped", lambda c: X.clamped(c.cast("double"), 1, 4), [("0.2", "1"), ("2.5", "3"), ("9", "4")])
case("fn_date_or_now", lambda c: X.date_or_now(F.lit("2030-01-01"), c, F.lit("2024-05-06")), [("2020-02-03", "2020-02-03 00:00:00"), ("", "2024-05-06 00:00:00"), ("bad", "2030-01-01 00:00:00")])
case("fn_key_union", lambda c: F.array_join(F.array_sort(F.array_union(F.json_object_keys(c), F.array(F.lit("b"), F.lit("z")))), ","), [('{"a":1,"b":2}', "a,b,z"), ("{}", "b,z")])


@pytest.mark.parametrize("name", sorted(CASES))
def test_scalar(spark, name):
    function, rows = CASES[name]
    got = spark.createDataFrame([(a,) for a, _ in rows], "input string").select("input", function(F.col("input")).cast("string").alias("result")).collect()
    assert sorted(map(tuple, got)) == sorted(rows)
