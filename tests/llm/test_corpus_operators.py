"""Each operator against a brute-force version, and on nulls, empty texts and tables, ties, repeats and clashing columns."""

import hashlib
import math
import random
import re
import zlib
from collections import Counter

import duckdb
import numpy as np
import pytest

from quillstone.llm import annforest, cascade, ebquality, htmlmain, jaccardforest, langid, mixing, packing, suffixdedup, tokencount
from quillstone.llm import queries as Q
from quillstone.llm.components import components

SF = "/root/testdata/sf0.001"
DOC = "doc_id long, text string, lang string, source string, n_chars long"
WORD = re.compile(r"[^\x20\x09-\x0D]+")


def table(spark, rows, schema=DOC):
    return spark.createDataFrame(rows, schema)


def docs_of(spark, sf=SF):
    return [tuple(r) for r in spark.read.parquet(f"{sf}/documents.parquet").collect()]


def messy(spark):
    """Null ids, texts and labels, empty and blank texts, a very long one, and repeated rows."""
    rng = random.Random(3)
    words = ["w%d" % i for i in range(400)]
    long = " ".join(rng.choice(words) for _ in range(30_000))
    rows = [(1, None, "en", "a", 0), (2, "", "en", "a", 0), (3, " \n\t ", None, None, 3), (None, "Alone without a name here", "en", "b", 9),
            (4, long, "de", "b", len(long)), (5, "same words " * 60, "en", "c", 1), (5, "same words " * 60, "en", "c", 1), (6, "x", "fr", None, 1),
            (7, "1234 !!! ###", None, "a", 1), (None, None, None, None, None)]
    return rows, table(spark, rows)


def clashing(df):
    from pyspark.sql import functions as F

    return df.withColumns({c: F.lit("clash") for c in (
        "size", "taken", "target", "score", "lang_pred", "kept", "n_words", "class_id", "n_links", "n_removed", "key_a", "key_b",
        "n_tokens", "quality_score", "p_doc", "hash", "rank", "length", "start")})


# 1


def brute_targets(sizes, weights=(3.0, 1.0, 2.0), share=1.5, cap=2.0):
    names = sorted(sizes, key=lambda s: (s is None, s or ""))
    w = {s: weights[i % len(weights)] for i, s in enumerate(names)}
    target, full, left = dict.fromkeys(names, 0.0), set(), share * sum(sizes.values())
    for _ in range(len(names) + 1):
        free = [s for s in names if s not in full]
        if not free or left < 1e-9:
            break
        each = left / sum(w[s] for s in free)
        left = 0.0
        for s in free:
            target[s] += each * w[s]
        for s in free:
            if target[s] >= cap * sizes[s]:
                left += target[s] - cap * sizes[s]
                target[s] = cap * sizes[s]
                full.add(s)
    return target


@pytest.mark.parametrize("source", ["tables", "messy", "one"])
def test_mixing(spark, source):
    rows = docs_of(spark) if source == "tables" else messy(spark)[0] if source == "messy" else [(i, "a b c", "en", "s", 5) for i in range(9)]
    if source == "tables":  # a hot source, and one that is tiny
        rows = [(i, t, lang, "hot" if i % 3 else "tiny" if i < 5 else s, n) for i, t, lang, s, n in rows]
    size = Counter()
    for r in rows:
        size[r[3]] += len(WORD.findall(r[1] or ""))
    found = mixing.mix(table(spark, rows), docs_per_bucket=16).collect()
    assert sorted((r["doc_id"] or -1, r["size"]) for r in found) == sorted((r[0] or -1, len(WORD.findall(r[1] or ""))) for r in rows)
    target, taken = brute_targets(size), Counter()
    for r in found:
        assert r["source_size"] == size[r["source"]] and r["target"] == pytest.approx(target[r["source"]], abs=1e-6)
        assert 0 <= r["taken"] <= 2 * r["size"]
        taken[r["source"]] += r["taken"]
    for s in size:
        assert abs(taken[s] - target[s]) <= 1, (s, taken[s], target[s])
    again = mixing.mix(table(spark, rows[::-1]), docs_per_bucket=16).collect()
    key = lambda r: (r["doc_id"] or -1, r["size"], r["taken"])
    assert sorted(map(key, found)) == sorted(map(key, again))


def test_mixing_small_sources_with_blocks_of_many_words(spark):
    """A hot source beside small ones whose targets are a few blocks: each comes near its target."""
    rows = [(i, "word " * 60, "en", "hot", 1) for i in range(2000)]
    rows += [(10_000 + 50 * s + i, "word " * (90 + s), "en", f"s{s:02}", 1) for s in range(60) for i in range(40)]
    size = Counter()
    for r in rows:
        size[r[3]] += len(WORD.findall(r[1]))
    target, taken = brute_targets(size), Counter()
    for r in mixing.mix(table(spark, rows), docs_per_bucket=64, slots=512).collect():
        taken[r["source"]] += r["taken"]
        assert 0 <= r["taken"] <= 2 * r["size"]
    assert sum(target.values()) / 512 > 500  # words in a block
    assert all(abs(taken[s] - target[s]) <= 1 for s in size)


def test_mixing_schedule_is_spread(spark):
    sizes = spark.createDataFrame([("a", 600), ("b", 300), ("c", 100)], "source string, size long")
    targets = mixing.source_targets(sizes, weights=(1.0,), share=1.0, cap=10.0)
    rows = sorted((r["slot"], r["source"], r["rank"]) for r in mixing.schedule(targets, 3000, chunk=256).collect())
    assert [r[0] for r in rows] == list(range(1, 3001))
    seen = Counter()
    for n, s, rank in rows:
        seen[s] += 1
        assert rank == seen[s]
        assert all(abs(seen[x] - n / 3) < 6 for x in "abc")  # equal weights, so equal shares of every prefix


def simulated(found, per_bucket, slots, targets):
    """(taken, place) of each document by key, from the golden-ratio sequence played slot by slot; a block comes from the shuffled stream."""
    by = {}
    for r in found:
        by.setdefault(r["source"], []).append(r)
    names = sorted(by, key=lambda s: (s is None, s or ""))
    total = sum(targets[s] for s in names)
    block, length = max(1, math.ceil(total / slots)), math.ceil(1.02 * slots) + 64
    edges, at = [], 0.0
    for s in names:
        edges.append((int(at / total * 2**31), int((at + targets[s]) / total * 2**31) if s != names[-1] else 2**31, s))
        at += targets[s]
    words, out = {}, {}
    for s in names:
        n = len(by[s])
        order = sorted(by[s], key=lambda r: (r["key_a"] % (n // per_bucket + 1), r["key_a"], r["key_b"], r["doc_id"] or -1))
        words[s] = [r for _ in range(2) for r in order for _ in range(r["size"])]
        out |= {(r["key_a"], r["key_b"]): [0, None] for r in order}
    drawn = Counter()

    def draw(s, slot):
        lo = drawn[s] * block
        drawn[s] += 1
        for r in words[s][lo : min(lo + block, int(targets[s] + 0.5))]:
            cell = out[r["key_a"], r["key_b"]]
            cell[0] += 1
            cell[1] = min(cell[1] or slot, slot)

    for slot in range(1, length + 1):
        u = slot * mixing.STEP % 2**31
        draw(next(s for lo, hi, s in edges if lo <= u < hi), slot)
    for s in names:
        for k in range(1, 1 + max(0, -(-int(targets[s] + 0.5) // block) - drawn[s])):
            draw(s, length + k)
    return {k: tuple(v) for k, v in out.items()}


def test_mixing_by_simulation(spark, monkeypatch):
    """Takes and places are those of a schedule played slot by slot; another schedule gives other places."""
    rng = random.Random(5)
    rows = [(i, " ".join(["w"] * rng.randint(0, 40)), "en", rng.choice(["a", "a", "a", "b", "c", None]), 1) for i in range(300)] + [(999, "x y z", "en", "tiny", 1)]
    df = table(spark, rows)
    found = mixing.mix(df, docs_per_bucket=32, slots=256).collect()
    targets = {r["source"]: r["target"] for r in found}
    assert {(r["key_a"], r["key_b"]): (r["taken"], r["place"]) for r in found} == simulated(found, 32, 256, targets)
    for other in (lambda t, n, chunk=0, real=mixing.schedule: real(t, n).where("false"), lambda t, n, chunk=0, real=mixing.schedule: real(t, n).withColumn("slot", 1 + (7 * mixing.F.col("slot")) % n)):
        with monkeypatch.context() as m:
            m.setattr(mixing, "schedule", other)
            moved = {(r["key_a"], r["key_b"]): r["place"] for r in mixing.mix(df, docs_per_bucket=32, slots=256).collect()}
        assert sum(moved[r["key_a"], r["key_b"]] != r["place"] for r in found) > 100


def test_mixing_edges(spark):
    empty = table(spark, [])
    assert mixing.mix(empty).count() == 0 and mixing.mixed_rows(empty).count() == 0
    out = mixing.mixed_rows(table(spark, [(i, "word " * 50, "en", "ab"[i % 2], 1) for i in range(40)]))
    assert out.columns == ["doc_id", "text", "lang", "source", "n_chars"]
    assert out.count() == pytest.approx(60, abs=2)
    assert mixing.mix(clashing(messy(spark)[1])).count() == 10


# 2


PAGE = """<!DOCTYPE html><html><head><title>T</title><style>p{}</style><script>var t="</p>";</script></head><body class="has-sidebar">
<header><h1>Site</h1></header><nav><ul><li><a href="/">Home</a></li></ul></nav><div class="cookie-notice">We use <b>cookies</b></div>
<article><h1>Head &amp;amp; line</h1><p>One <b>two</b>
 three&nbsp;four<br>five<p>Second &lt;x&gt; &#x41;<div class="ad">Buy</div><ul><li>i<li>ii</ul><form><input value="q">ask</form>
<!-- not <p>this</p> --><table><tr><td>c1<td>c2</table><section id="comments"><p>me too</p></section></article><aside>side</aside>
<div class="x7">Our partner site</div><footer>&copy; us</footer></body></html>"""
MAIN = "Head &amp; line\nOne two three four five\nSecond <x> A\ni\nii\nc1\nc2"


def test_html_main_text():
    assert htmlmain.main_text(PAGE) == MAIN
    assert htmlmain.main_text("") == "" and htmlmain.main_text("just < text & more") == "just < text & more"
    deep = "<div>" * 5000 + "deep" + "</div>" * 5000
    assert htmlmain.main_text(deep) == "deep"
    assert htmlmain.main_text("<p>a<script>x") == "a"


def test_html_templates(spark):
    page = "<body><div class=q>Welcome to our site</div><div><p>Own text {0} of page {0}</p></div><div class=z><p>Call us</p></div></body>"
    rows = [(i, f"https://Host.example/{i}", page.format(i)) for i in range(12)] + [(99, "https://other.example/", page.format(99)), (100, None, None), (101, "x", "")]
    pages = spark.createDataFrame(rows, "page_id long, url string, html string")
    found = {r["page_id"]: r for r in htmlmain.extract(pages).collect()}
    assert found == {r["page_id"]: r for r in htmlmain.extract(pages, broadcast_hashes=0).collect()}
    assert all(found[i]["text"] == f"Own text {i} of page {i}" for i in range(12))
    assert found[99]["text"] == "Welcome to our site\nOwn text 99 of page 99\nCall us" and found[99]["n_chars"] == len(found[99]["text"])
    assert found[100]["text"] == "" and found[101]["n_chars"] == 0
    assert htmlmain.extract(spark.createDataFrame([], "page_id long, url string, html string, text int")).count() == 0


def own_pages():
    """Two hosts: one with articles, where nothing outside recurs word for word, and one without; boilerplate within as well."""
    rng = random.Random(12)
    say = lambda n: " ".join("".join(rng.choices("abcdefgh", k=rng.randint(2, 8))) for _ in range(n))
    rows, want = [], {}
    for i in range(14):
        body = [say(40), say(30)]
        rows.append((i, f"http://one.example/{i}", f"<body><div class='q{i}'><a>{say(2)}</a> <a>{say(1)}</a></div><article><p>{body[0]}</p><div class=ad>{say(3)}</div><div><b>Read on at our shop</b></div>"
                     f"<p>{body[1]}</p></article><div id=x7><p>{say(4)}</p></div><footer>{say(3)}</footer></body>"))
        want[i] = "\n".join(body)
        body = [say(40), say(30)]
        rows.append((100 + i, f"http://two.example/{i}", f"<body><nav><a>{say(2)}</a></nav><div>All rights with us</div><div class=lead><p>{body[0]}</p></div><p>{body[1]}</p><footer>{say(3)}</footer></body>"))
        want[100 + i] = "\n".join(body)
    rows.append((900, "http://two.example/0?utm=1", rows[1][2]))
    want[900] = want[100]
    return rows, want


def test_html_templates_decide(spark):
    rows, want = own_pages()
    pages = spark.createDataFrame(rows, "page_id long, url string, html string")
    found = {r["page_id"]: r["text"] for r in htmlmain.extract(pages).collect()}
    assert found == want == {r["page_id"]: r["text"] for r in htmlmain.extract(pages, broadcast_hashes=0).collect()}
    # names alone would miss boilerplate within the article, and that of pages without one
    assert all(htmlmain.main_text(h) != want[i] for i, _, h in rows)


@pytest.mark.parametrize("n", [1, 4, 5, 50])
def test_html_one_off_parts_go_on_hosts_of_any_size(spark, n):
    odd = "<div class='sidebar related'>Only here: read about our summer fair</div><div class='cookie-notice'>We use cookies, once.</div>"
    rows = [(i, f"http://h.example/{i}", f"<body>{odd if i == 0 else ''}<main><article><p>T{i} own words {i * 7}</p></article></main><div>By us</div></body>") for i in range(n)]
    pages = spark.createDataFrame(rows, "page_id long, url string, html string")
    assert {r["page_id"]: r["text"] for r in htmlmain.extract(pages).collect()} == {i: f"T{i} own words {i * 7}" for i in range(n)}


def brute_text(page, counts):
    """Recursive: recurring subtrees (by their exact source, counted over the host) and what names set apart go, then blocks."""
    root = htmlmain.parse(page)
    htmlmain.digest(root)
    blocks, now = [], []

    def flush():
        if text := " ".join(__import__("html").unescape("".join(now)).split()):
            blocks.append(text)
        now.clear()

    def has(node):
        return any(not isinstance(x, str) and (x.name in ("article", "main") and not x.apart or has(x)) for x in node.items)

    whole = not has(root)

    def visit(node, inside):
        for x in node.items:
            if isinstance(x, str):
                if inside:
                    now.append(x)
                continue
            block = x.name in htmlmain.BLOCK
            if block:
                flush()
            if x.name == "br" and not x.apart:
                now.append(" " if inside else "")
            elif not x.apart and not (htmlmain.templatable(x) and counts.get(x.digest, 0) >= 5 or htmlmain.shapely(x, root.holds) and counts.get(x.shape, 0) >= 5):
                visit(x, inside or x.name in ("article", "main"))
            if block:
                flush()

    visit(root, whole)
    flush()
    return "\n".join(blocks)


def test_html_texts_by_brute_force(spark):
    rows, _ = own_pages()
    rows += [(r["page_id"] + 1000, r["url"], r["html"]) for r in spark.read.parquet(f"{SF}/pages.parquet").collect()]
    seen: dict = {}
    for _, url, html in rows:
        root = htmlmain.parse(html)
        text = htmlmain.text_of(root)
        for x, w in htmlmain.subtrees(root).items():
            seen.setdefault((re.match(r"https?://([^/]*)", url)[1].lower(), x), {}).setdefault(text, []).append((w, root.words))
    counts: dict = {}
    for (host, x), by_text in seen.items():
        if max(w for v in by_text.values() for w, _ in v) < 0 or 4 * sum(max(w for w, _ in v) for v in by_text.values()) <= sum(max(p for _, p in v) for v in by_text.values()):
            counts.setdefault(host, {})[x] = len(by_text)
    pages = spark.createDataFrame(rows, "page_id long, url string, html string")
    found = {r["page_id"]: r["text"] for r in htmlmain.extract(pages).collect()}
    assert found == {i: brute_text(html, counts.get(re.match(r"https?://([^/]*)", url)[1].lower(), {})) for i, url, html in rows}


def test_html_templates_counted(spark):
    """Brute-force counts of subtrees over distinct main texts of a host."""
    rows, _ = own_pages()
    rows += [(r["page_id"] + 1000, r["url"], r["html"]) for r in spark.read.parquet(f"{SF}/pages.parquet").limit(150).collect()]
    seen: dict = {}
    for _, url, html in rows:
        root = htmlmain.parse(html)
        host, text = re.match(r"https?://([^/]*)", url)[1].lower(), htmlmain.text_of(root)
        for x, w in htmlmain.subtrees(root).items():
            seen.setdefault((host, x), {}).setdefault(text, []).append((w, root.words))
    want = set()
    for at, by_text in seen.items():
        words, page = sum(max(w for w, _ in v) for v in by_text.values()), sum(max(p for _, p in v) for v in by_text.values())
        if len(by_text) >= 5 and (max(w for v in by_text.values() for w, _ in v) < 0 or 4 * words <= page):
            want.add(at)
    pages = spark.createDataFrame(rows, "page_id long, url string, html string")
    assert {(r["host"], r["hash"]) for r in htmlmain.templates(pages).collect()} == want and want


def test_html_pages(spark):
    """The generator's pages: an article of paragraphs between menus, adverts and footers."""
    import html

    pages = {r["page_id"]: r["html"] for r in spark.read.parquet(f"{SF}/pages.parquet").collect()}
    for r in Q.op2_html_main_text(spark, SF).collect():
        body = re.search(r"<article>(.*)</article>", pages[r["page_id"]], re.S)[1]
        blocks = [" ".join(html.unescape(re.sub(r"<[^>]*>", " " if b.startswith("<br") else "", b)).split()) for b in re.split(r"</?(?:p|h1)>", body)]
        assert r["text"] == "\n".join(b for b in blocks if b)


# 3


def test_language_accuracy(spark):
    truth = {r[0]: r[2] for r in docs_of(spark, "/root/testdata/sf0.01")}
    rows = [r for r in Q.op3_language_id(spark, "/root/testdata/sf0.01").collect()]
    assert len(rows) == len(truth)
    for r in rows:
        assert r["held_out"] == (zlib.crc32(str(r["doc_id"]).encode()) % 4 == 2) and 0 <= r["score"] <= 1
    held = [r for r in rows if r["held_out"] and truth[r["doc_id"]]]
    assert np.mean([r["lang_pred"] == truth[r["doc_id"]] for r in held]) > 0.97


def test_language_edges(spark):
    model = langid.train(spark.read.parquet(f"{SF}/documents.parquet"))
    rows, df = messy(spark)
    found = langid.identify(clashing(df), model).collect()
    assert len(found) == len(rows)
    for r in found:
        text = r["text"]
        und = text is None or not any(c.isalpha() for c in text)
        assert (r["lang_pred"] == "und") == und and 0 <= r["score"] <= 1
    assert langid.identify(table(spark, []), model).count() == 0
    odd = ["½ ½", "² 12", "①", "Ⅷ", "٣", "_", "ª"]  # the last is a letter
    got = [r["lang_pred"] for r in langid.identify(table(spark, [(i, t, None, None, 1) for i, t in enumerate(odd)]), model).orderBy("doc_id").collect()]
    assert got[:-1] == ["und"] * (len(odd) - 1) and got[-1] != "und"
    nothing = langid.train(table(spark, [(1, None, "en", None, 1), (2, "text", None, None, 1)]))
    assert [r["lang_pred"] for r in langid.identify(table(spark, [(1, "abc", None, None, 1)]), nothing).collect()] == ["und"]


# 4


def brute_counts(text):
    text = text or ""
    ws = WORD.findall(text)
    wins = Counter(tuple(ws[i : i + 5]) for i in range(len(ws) - 4))
    covered = {i + k for i in range(len(ws) - 4) if wins[tuple(ws[i : i + 5])] >= 2 for k in range(5)}
    lines = [x for x in text.split("\n") if WORD.search(x)]
    return len(ws), sum(map(len, ws)), sum(c in "#*$%&|<>" for c in text), len(lines) - len(set(lines)), len(covered)


def test_cascade(spark):
    rows = messy(spark)[0] + docs_of(spark)[:80] + [(50 + i, " ".join(random.Random(i).choices("a b c".split(), k=5 + i)) + "\nx\n\nx\n x", "en", "s", 1) for i in range(40)]
    found = cascade.apply_rules(clashing(table(spark, rows)).select("doc_id", "text", "kept", "n_words")).collect()
    names = ("n_words", "word_chars", "n_symbols", "n_dup_lines", "n_repeat_words")
    assert sorted((r["text"] or "", *[r[n] for n in names]) for r in found) == sorted((r[1] or "", *brute_counts(r[1])) for r in rows)
    for r in found:
        assert r["base_failed"] == (r["n_words"] < 10 or 100 * r["n_repeat_words"] > 20 * r["n_words"])
        assert not (r["base_failed"] and r["kept"])
    assert cascade.apply_rules(table(spark, [])).count() == 0


def test_cascade_order_and_verdict(spark):
    from pyspark.sql import functions as F

    df = spark.read.parquet(f"{SF}/documents.parquet")
    ranked = cascade.order(df)
    scores = [(share + 1e-6) / cost for _, share, cost in ranked]
    assert scores == sorted(scores, reverse=True) and len(ranked) == len(cascade.RULES)
    again = cascade.order(df)
    assert [(r.name, *x) for r, *x in ranked] == [(r.name, *x) for r, *x in again]  # reruns agree
    held, column = cascade.measure(df)
    every = F.lit(True)
    for rule in cascade.RULES:
        every = every & rule.passes(column)
    plain = held.where(~cascade.base_failed() & every).select("doc_id").collect()
    assert {r[0] for r in plain} == {r["doc_id"] for r in cascade.apply_rules(df).where("kept").collect()}


def test_cascade_oracle(spark):
    con = duckdb.connect()
    con.execute(f"CREATE VIEW documents AS SELECT * FROM '{SF}/documents.parquet'")
    sql = con.execute(f"SELECT doc_id, n_words, word_chars, n_symbols, n_dup_lines, n_repeat_words, base_failed, kept FROM ({Q.oracle_sql()['op4_quality_cascade']})").fetchall()
    assert sorted(sql) == sorted(tuple(r) for r in Q.op4_quality_cascade(spark, SF).collect())


# 5


def test_packing_round_trip(spark):
    import public_tokenizers
    from tokenizers import Tokenizer

    tok = Tokenizer.from_file(public_tokenizers.path("byte_bpe_50k.json"))
    rows = messy(spark)[0] + docs_of(spark)[:60] + [((1 << 60) + 1, "a <|endoftext|> b<|endoftext|>", "en", "s", 1), (71, "   \n\n  don't  stop é漢字🙂 \r\n\t", "en", "s", 1), (72, "x" * 5000, "en", "s", 1)]
    found = packing.pack(clashing(table(spark, rows)), docs_per_group=30, with_ids=True).collect()
    want = Counter()
    for r in rows:
        want[(r[0], tuple([*tok.encode(r[1] or "", add_special_tokens=False).ids, 1]))] += 1
    pieces: dict = {}
    for r in found:
        assert r["length"] == len(r["ids"]) and r["ids_crc32"] == zlib.crc32(np.array(r["ids"], dtype="<u4").tobytes())
        pieces.setdefault((r["doc_id"], r["doc_tokens"]), []).append((r["start"], r["ids"]))
    for (doc_id, n), parts in pieces.items():
        times = sum(v for (i, ids), v in want.items() if i == doc_id and len(ids) == n)
        assert sum(len(p) for _, p in parts) == n * times
    single = {(i, ids) for (i, ids), v in want.items() if sum(v2 for (i2, ids2), v2 in want.items() if (i2, len(ids2)) == (i, len(ids))) == 1}
    for i, ids in single:
        assert [x for _, p in sorted(pieces[(i, len(ids))]) for x in p] == list(ids)
    bins: dict = {}
    for r in found:
        bins.setdefault(r["sequence_id"], []).append((r["offset"], r["length"]))
    for parts in bins.values():
        at = 0
        for o, n in sorted(parts):
            assert o == at
            at += n
        assert at <= 2048
    assert packing.pack(table(spark, [])).count() == 0


def test_first_fit_decreasing():
    rng = random.Random(5)
    for _ in range(50):
        sizes = [rng.randint(1, 100) for _ in range(rng.randint(1, 80))]
        bins, _ = packing.first_fit_decreasing(sizes, 100)
        room: list = []
        for i in sorted(range(len(sizes)), key=lambda i: (-sizes[i], i)):
            b = next((b for b, x in enumerate(room) if x >= sizes[i]), len(room))
            if b == len(room):
                room.append(100)
            room[b] -= sizes[i]
            assert bins[i] == b


# 6


def test_neighbours_recall(spark):
    rows = spark.read.parquet("/root/testdata/sf0.1/embeddings.parquet").select("vec_id", "embedding").collect()
    x, ids = np.array([r[1] for r in rows], dtype=np.float64), np.array([r[0] for r in rows])
    df = spark.createDataFrame(rows)
    found: dict = {}
    for r in annforest.nearest(df, df.where("vec_id % 20 = 0"), rows_per_block=600).collect():
        found.setdefault(r["query_id"], {})[r["rank"]] = (r["vec_id"], r["score"])
    hits = []
    for q, v in zip(ids, x):
        if q % 20:
            continue
        d = np.sqrt(((x - v) ** 2).sum(1))
        order = [i for i in np.lexsort((ids, d)) if ids[i] != q][:10]
        got = found[q]
        assert sorted(got) == list(range(1, 11))
        assert [got[k] for k in range(1, 11)] == sorted(got.values(), key=lambda p: (p[1], p[0]))
        assert all(s == pytest.approx(d[np.flatnonzero(ids == i)[0]], abs=1e-12) for i, s in got.values())
        hits.append(len({int(ids[i]) for i in order} & {i for i, _ in got.values()}) / 10)
    assert np.mean(hits) >= 0.9


def test_neighbours_selective(spark):
    """In clustered vectors a query goes to few cells and is compared with few rows."""
    rng = np.random.default_rng(4)
    centres = rng.standard_normal((60, 48))
    x = np.concatenate([c + 0.15 * rng.standard_normal((80, 48)) for c in centres])
    fraction = annforest.fit_fraction(x[::2], 10, 24, 11, 0.97)
    block = annforest.Block(np.arange(len(x)), x, 10, 24, 11, fraction)
    picked = np.arange(0, len(x), 40)
    found: dict = {}
    for q, i, _ in block.nearest(picked, x[picked]):
        found.setdefault(q, set()).add(i)
    true = {i: set(np.argsort(annforest.exact(x[i], x), kind="stable")[1:11].tolist()) for i in picked.tolist()}
    assert np.mean([len(found[i] & true[i]) / 10 for i in true]) >= 0.95
    assert block.measured < 0.1 * len(picked) * len(x)
    router = annforest.Router(x[::2], 1 << 18, 1 << 14, 10, 11, 0.97)
    assert router.bits == 4 and router.probes <= 8
    df = spark.createDataFrame([(i, v.tolist()) for i, v in enumerate(x)], "vec_id long, embedding array<double>")
    got: dict = {}
    for r in annforest.nearest(df, df.where("vec_id % 40 = 0"), rows_per_block=300).collect():
        got.setdefault(r["query_id"], set()).add(r["vec_id"])
    assert np.mean([len(got[i] & true[i]) / 10 for i in true]) >= 0.93


def test_neighbours_edges(spark):
    nan, inf = float("nan"), float("inf")
    rows = [(i, [1.0, 2.0]) for i in range(40, 0, -1)] + [(100, [1.0, 2.5]), (101, [0.0, 0.0]), (102, None), (103, [nan, 1.0]), (104, [inf, 1.0]), (105, [None, 1.0]), (None, [1.0, 1.0]), (200, [1.0, 2.0, 3.0])]
    df = spark.createDataFrame(rows, "vec_id long, embedding array<float>")
    for size in (1 << 14, 8):
        found = sorted((r["query_id"], r["rank"], r["vec_id"], r["score"]) for r in annforest.nearest(df, df.where("vec_id % 20 = 0"), rows_per_block=size).collect())
        assert [r[2] for r in found if r[0] == 20] == list(range(1, 11))  # equal vectors: smallest ids
        assert [r[2] for r in found if r[0] == 100] == list(range(1, 11)) and found[-1][3] == 0.5
        assert {r[0] for r in found} == {20, 40, 100}
    small = spark.createDataFrame([(0, [1.0]), (1, [2.0])], "vec_id long, embedding array<float>")
    assert [tuple(r) for r in annforest.nearest(small, small.where("vec_id = 0")).collect()] == [(0, 1, 1, 1.0)]
    assert annforest.nearest(small.limit(0), small.limit(0)).count() == 0


def test_neighbours_of_rare_lengths(spark):
    """Vectors of a length that the sample lacks are found whole, dealt into bounded blocks; a query's copies leave in slices."""
    rng = np.random.default_rng(6)
    rows = [(i, rng.standard_normal(2 + i % 5).tolist()) for i in range(300)]
    df = spark.createDataFrame(rows, "vec_id long, embedding array<double>")
    found: dict = {}
    for r in annforest.nearest(df, df.where("vec_id % 20 = 0"), rows_per_block=8, sample_rows=2).collect():
        found.setdefault(r["query_id"], {})[r["rank"]] = r["vec_id"]
    for q in range(0, 300, 20):
        like = [(float(annforest.exact(np.array(rows[q][1]), np.array([v]))[0]), i) for i, v in rows if len(v) == len(rows[q][1]) and i != q]
        assert [found[q][k] for k in range(1, 11)] == [i for _, i in sorted(like)[:10]]
    router = annforest.Router(rng.standard_normal((400, 6)), 1 << 16, 1 << 12, 10, 11, 0.97)
    asked = rng.standard_normal((70, 6))
    want = [(i, c, s) for i, cells in enumerate(router.order(asked)[:, : router.probes].tolist()) for c in cells for s in range(router.salts[c])]
    assert router.bits == 4 and list(router.asked(asked)) == want


# 7


def brute_removed(texts, length):
    seen = Counter(t[i : i + length] for t in texts for i in range(len(t) - length + 1))
    for t in texts:
        gone = np.zeros(len(t), bool)
        for i in range(len(t) - length + 1):
            if seen[t[i : i + length]] >= 2:
                gone[i : i + length] = True
        runs = int((np.diff(np.concatenate(([0], gone.astype(int)))) == 1).sum())
        yield len(t), int(gone.sum()), runs, hashlib.sha256(bytes(b for b, g in zip(t, gone) if not g)).hexdigest()


@pytest.mark.parametrize("chunk", [2048, 3])
def test_suffix_dedup(spark, chunk):
    rng = random.Random(chunk)
    word = lambda n: " ".join("".join(rng.choices("abcdeé", k=rng.randint(1, 7))) for _ in range(n))
    passage, other = word(130), word(120)
    texts = [word(rng.randint(1, 150)) for _ in range(20)]
    texts += [word(20) + passage + word(30) for _ in range(12)] + [word(9) + passage[40:], passage + " " + passage, "ab" * 900, "a" * 1500, "b" * 399, "c" * 400, "c" * 400]
    texts += [other, other, word(5) + other[:-3] + word(5), None, "", texts[0], *[word(200)] * 3]
    rows = [(i % 50 if i % 7 else None, t, "en", "s", 1) for i, t in enumerate(texts)]
    raw = [(t or "").encode() for t in texts]
    want = Counter(zip([r[0] for r in rows], *[[w[k] for w in brute_removed(raw, 400)] for k in range(4)]))
    found = suffixdedup.remove(clashing(table(spark, rows)), strings_per_task=chunk).collect()
    assert Counter((r["doc_id"], r["n_bytes"], r["n_removed"], r["n_spans"], r["kept_sha256"]) for r in found) == want
    with_text = suffixdedup.remove(table(spark, rows), strings_per_task=chunk, keep_text=True).collect()
    assert Counter((r["doc_id"], r["n_bytes"], r["n_removed"], r["n_spans"], r["kept_sha256"]) for r in with_text) == want
    assert suffixdedup.remove(table(spark, [])).count() == 0


def test_suffix_order():
    rng = random.Random(9)
    for _ in range(150):
        length = rng.choice([3, 6, 20])
        strings = [bytes(rng.choices(rng.choice([b"ab", b"a", b"abc\x00\xff"]), k=rng.randint(length, length + 40))) for _ in range(rng.randint(1, 6))]
        wanted = [len(s) - length + 1 for s in strings]
        suffixes, shared, data = suffixdedup.suffix_order(strings, wanted, length)
        ends = [e for s, e in zip(strings, np.cumsum([len(s) for s in strings])) for _ in s]
        heads = [data[p : min(p + length, ends[p])] for p in suffixes.tolist()]
        assert heads == sorted(heads)
        for k in range(1, len(heads)):
            n = next((i for i, (x, y) in enumerate(zip(heads[k - 1], heads[k])) if x != y), min(len(heads[k - 1]), len(heads[k])))
            assert shared[k] == n


def test_suffix_dedup_tables(spark):
    docs = docs_of(spark)
    want = dict(zip([d[0] for d in docs], brute_removed([(d[1] or "").encode() for d in docs], 400)))
    rows = Q.op7_suffix_dedup(spark, SF).collect()
    assert {r["doc_id"]: tuple(r)[1:5] for r in rows} == want


# 8


def test_edited_token_counts():
    rng = random.Random(8)
    bits = ["hello", " ", "  ", "\n", "don't", "'s", "12", "3", "!?", "é", "漢", "x@y.com", "\t", " a", "<EMAIL>"]
    _, counts = tokencount.tools()
    for _ in range(250):
        doc = tokencount.Document("".join(rng.choices(bits, k=rng.randint(0, 400))))
        for _ in range(rng.randint(1, 8)):
            a, b = sorted(rng.randint(0, len(doc.text)) for _ in range(2))
            if rng.random() < 0.7:
                b = min(b, a + 6)
            before, size = doc.encoded, b - a
            new = "".join(rng.choices(bits, k=rng.randint(0, 4)))
            doc.apply(tokencount.Edit(a, b, new))
            assert doc.n_tokens == len(counts.encoder.plain(doc.text))
            assert doc.lengths.total == len(doc.text) and "".join(p for c in doc.chunks for p in c) == doc.text
            assert doc.encoded - before <= len(new) + 40 + size


def test_edits_of_a_long_text_read_little_of_it():
    """Many edits of one long text lay out what is around them, and count as encoding the whole result does."""
    rng = random.Random(12)
    words = ["alpha", "beta", "12", "x@y.com", "me@site.org", "--", "don't", "\n\n"]
    text = " ".join(rng.choice(words) for _ in range(60_000))
    doc, edits = tokencount.Document(text), tokencount.masks(text, re.compile(tokencount.EMAIL), "<EMAIL>")
    for e in edits:
        doc.apply(e)
    want = re.sub(tokencount.EMAIL, "<EMAIL>", text)
    assert len(edits) > 10_000 and doc.text == want and doc.n_tokens == len(packing.Encoder.get().plain(want))
    assert doc.read < 2_000 * len(edits) and doc.encoded < 20 * len(edits)
    doc = tokencount.Document("a" * 50_000 + " " * 50_000 + "b")  # long pre-tokens, cut, joined and taken away
    for e in (tokencount.Edit(49_990, 99_995, ""), tokencount.Edit(10, 20, " "), tokencount.Edit(3, len(doc.text) - 50_005, "c"), tokencount.Edit(0, 2, "")):
        want = doc.text[: e.start] + e.text + doc.text[e.stop :]
        doc.apply(e)
        assert doc.text == want and doc.n_tokens == len(packing.Encoder.get().plain(want))
    doc.apply(tokencount.Edit(0, len(doc.text), ""))
    assert (doc.text, doc.n_tokens) == ("", 0)
    doc.apply(tokencount.Edit(0, 0, "new text"))
    assert (doc.text, doc.n_tokens) == ("new text", len(packing.Encoder.get().plain("new text")))


def test_edited_token_counts_on_tables(spark):
    encoder = packing.Encoder.get()
    rows = docs_of(spark)[:100] + messy(spark)[0] + [(900, "write to me@site.org now, or you@x.y.com", "en", "s", 1)]
    found = tokencount.count_edited(clashing(table(spark, rows))).collect()
    want = Counter()
    for r in rows:
        text = r[1] or ""
        new, n = re.subn(tokencount.EMAIL, "<EMAIL>", text)
        want[(r[0], len(encoder.plain(text)), n, len(encoder.plain(new)))] += 1
    assert Counter((r["doc_id"], r["n_tokens_before"], r["n_edits"], r["n_tokens"]) for r in found) == want
    assert tokencount.count_edited(table(spark, [])).count() == 0


# 9


def brute_join(rows):
    sets = []
    for r in rows:
        ws = WORD.findall(r[1] or "")
        sets.append({tuple(ws[i : i + 5]) for i in range(max(1, len(ws) - 4))} if ws else set())
    parent = list(range(len(rows)))

    def root(x):
        while parent[x] != x:
            x = parent[x]
        return x

    links = [0] * len(rows)
    for i in range(len(rows)):
        for j in range(i):
            if sets[i] and sets[j] and 10 * len(sets[i] & sets[j]) >= 8 * len(sets[i] | sets[j]):
                links[i] += 1
                links[j] += 1
                parent[root(i)] = root(j)
    least: dict = {}
    for i, r in enumerate(rows):
        if r[0] is not None:
            least[root(i)] = min(least.get(root(i), r[0]), r[0])
    return Counter((r[0], least.get(root(i)), links[i]) for i, r in enumerate(rows))


@pytest.mark.parametrize("block, full, volume", [(512, 128, 1 << 22), (4, 128, 1 << 22), (512, 2, 1 << 22), (4, 3, 1 << 22), (512, 128, 600)])
def test_jaccard_join(spark, block, full, volume):
    rng = random.Random(6)
    words = ["w%d" % i for i in range(300)]
    rows = messy(spark)[0]
    for g in range(12):
        base = rng.choices(words, k=rng.randint(3, 120))
        for _ in range(rng.randint(1, 9)):
            ws = list(base)
            for _ in range(rng.randint(0, 4)):
                ws[rng.randrange(len(ws))] = rng.choice(words)
            rows.append((len(rows) + 100, rng.choice([" ", "\n"]).join(ws), "en", "s", 1))
    hot = rng.choices(words, k=150)
    for i in range(25):
        ws = list(hot)
        ws[rng.randrange(150)] = "edit%d" % i
        rows.append((len(rows) + 100, " ".join(ws), "en", "s", 1))
    found = jaccardforest.join(clashing(table(spark, rows)), block=block, full=full, volume=volume).collect()
    assert Counter((r["doc_id"], r["class_id"], r["n_links"]) for r in found) == brute_join(rows)
    assert jaccardforest.join(table(spark, [])).count() == 0


def test_jaccard_join_tables(spark):
    assert Counter((r["doc_id"], r["class_id"], r["n_links"]) for r in Q.op9_ngram_jaccard_join(spark, SF).collect()) == brute_join(docs_of(spark))


def test_components(spark):
    rng = random.Random(2)
    edges = [(rng.randint(0, 300), rng.randint(0, 300)) for _ in range(200)] + [(k, k + 1) for k in range(1000, 1060)]
    parent = {x: x for e in edges for x in e}

    def root(x):
        while parent[x] != x:
            x = parent[x]
        return x

    for a, b in edges:
        a, b = sorted((root(a), root(b)))
        parent[b] = a
    found = {r["node"]: r["root"] for r in components(spark.createDataFrame(edges, "a long, b long")).collect()}
    assert found == {x: root(x) for a, b in edges if a != b for x in (a, b)}
    assert components(spark.createDataFrame([], "a long, b long")).count() == 0


# 10


def test_site_quality(spark):
    from pyspark.sql import functions as F

    sf = "/root/testdata/sf0.01"
    docs, labels = spark.read.parquet(f"{sf}/documents.parquet"), spark.read.parquet(f"{sf}/labels.parquet")
    train = labels.where("doc_id % 3 != 0")
    truth = {r["doc_id"]: r["quality"] for r in labels.where("doc_id % 3 = 0").collect()}
    model = ebquality.fit(docs, train)
    rows = ebquality.score(docs, model, F.col("source"), F.col("lang")).collect()
    assert len(rows) == docs.count()
    got = [(r["quality_score"] >= 0.5) == bool(truth[r["doc_id"]]) for r in rows if r["doc_id"] in truth]
    assert np.mean(got) > 0.93
    # posteriors: paths between their own mean and their site's, and sparse ones nearer to the site
    own: dict = {}
    for r in rows:
        own.setdefault((r["source"], r["lang"]), []).append(r)
    for group in own.values():
        mean, r = np.mean([x["p_doc"] for x in group]), group[0]
        assert min(mean, r["site_mean"]) - 1e-9 <= r["path_mean"] <= max(mean, r["site_mean"]) + 1e-9


@pytest.mark.parametrize("most", [200_000, 3])
def test_site_posteriors_by_brute_force(spark, most):
    """Posteriors and scores computed again from the documents' own probabilities, with the paths broadcast and dealt over salts."""
    from pyspark.sql import functions as F

    docs = [(i, t, None if i % 13 == 0 else lang, "hot" if i % 3 else s, n) for i, t, lang, s, n in docs_of(spark)]
    labels = spark.read.parquet(f"{SF}/labels.parquet")
    df = table(spark, docs)
    rows = ebquality.score(df, ebquality.fit(df, labels), F.col("source"), F.col("lang"), broadcast_paths=most).collect()
    paths: dict = {}
    for r in rows:
        paths.setdefault((r["source"], r["lang"]), []).append(r["p_doc"])
    n, k, total = len(rows), len(paths), sum(r["p_doc"] for r in rows)
    mean, q, b = total / n, sum(r["p_doc"] ** 2 for r in rows), sum(sum(v) ** 2 / len(v) for v in paths.values())
    within = max((q - b) / max(n - k, 1), 1e-6)
    between = max((b - total**2 / n) / max(k - 1, 1) - within, 0) / max(n / k, 1)
    strength = min(max(within / max(between, 1e-9), 1.0), 1e4)
    logit = lambda p: math.log(min(max(p, 1e-6), 1 - 1e-6) / (1 - min(max(p, 1e-6), 1 - 1e-6)))
    for r in rows:
        site = [p for (s, _), v in paths.items() if s == r["source"] for p in v]
        site_mean = (sum(site) + strength * mean) / (len(site) + strength)
        own = paths[r["source"], r["lang"]]
        path_mean = (sum(own) + strength * site_mean) / (len(own) + strength)
        score = 1 / (1 + math.exp(-(logit(r["p_doc"]) + logit(path_mean) - logit(mean))))
        assert (r["site_mean"], r["path_mean"], r["quality_score"]) == pytest.approx((site_mean, path_mean, score), abs=1e-9)
        assert r["kept"] == (r["quality_score"] >= 0.2)
    assert len(rows) == len(docs)


def test_site_quality_edges(spark):
    from pyspark.sql import functions as F

    rows, df = messy(spark)
    labels = spark.createDataFrame([(4, 1), (7, 0), (5, 1), (5, 0), (None, 1), (6, None)], "doc_id long, quality int")
    model = ebquality.fit(df, labels)
    assert ebquality.score(clashing(df), model, F.col("source"), F.col("lang")).count() == len(rows)
    assert ebquality.score(table(spark, []), ebquality.fit(table(spark, []), labels), F.col("source"), F.col("lang")).count() == 0


NAMES = [f"{p}{x}{q}" for p in ("", "_") for q in ("", "_") for x in (
    "key_a key_b host hashes salt site path text n n_lines w l copies bucket r s a b x y root worded found ranges cut sha gone parts all k m o h p block run lo hi at").split()]


def test_columns_of_the_user_survive(spark):
    """Columns named like those that operators need inside keep their values."""
    from pyspark.sql import functions as F

    names = [n for n in NAMES if n != "text"]
    rows, df = messy(spark)
    rows += [(20 + i, "w1 w2 w3 w4 w5 w6 w7 %d" % i, "en", "b", i) for i in range(9)]
    own = {n: F.concat(F.lit(n), F.coalesce(F.col("n_chars").cast("string"), F.lit("?"))) for n in names}
    df = table(spark, rows).withColumns(own)
    pages = df.withColumns({"url": F.concat(F.lit("http://a/"), "doc_id"), "html": F.col("text")}).withColumnRenamed("doc_id", "page_id")
    want = Counter(tuple(n + ("?" if r[4] is None else str(r[4])) for n in names) for r in rows)
    model, judge = langid.train(df), ebquality.Classifier(np.zeros(ebquality.DIMS + 8), 0.0)
    same = {
        "cascade": cascade.apply_rules(df), "language": langid.identify(df, model), "tokens": tokencount.count_edited(df), "html": htmlmain.extract(pages),
        "html joined": htmlmain.extract(pages, broadcast_hashes=0), "suffix": suffixdedup.remove(df), "suffix text": suffixdedup.remove(df, keep_text=True),
        "join": jaccardforest.join(df), "quality": ebquality.score(df, judge, F.col("source"), F.col("lang"))}
    for what, out in same.items():
        assert Counter(tuple(r) for r in out.select(*names).collect()) == want, what
    for out in (jaccardforest.join(df, one_each=True), mixing.mixed_rows(df)):
        assert out.columns == df.columns
        assert all(r[n].startswith(n) for r in out.collect() for n in names)


# pipeline


def test_pipeline(spark):
    import corpus_pipeline

    docs = spark.read.parquet(f"{SF}/documents.parquet")
    columns = docs.columns
    by_stage = []
    import tempfile

    for name, stage in corpus_pipeline.STAGES:
        out = stage(spark, docs, SF)
        path = f"{tempfile.mkdtemp()}/{name}"
        out.write.parquet(path)
        docs = spark.read.parquet(path)
        by_stage.append(docs)
    assert all(d.columns == columns for d in by_stage[:-1])
    language, near, passages, mixture, packed = by_stage
    # near duplicates: classes of the brute-force join, one of each stays
    kept = [tuple(r) for r in language.collect()]
    classes = {(i, c) for i, c, _ in brute_join(kept)}
    assert {r["doc_id"] for r in near.collect()} == {i for i, c in classes if i == c}
    rows = near.collect()
    want = dict(zip([r["doc_id"] for r in rows], brute_words_left([r["text"] or "" for r in rows], 51)))
    texts = {r["doc_id"]: r["text"] for r in passages.collect()}
    for r in rows:
        left = WORD.findall(r["text"] or "") == want[r["doc_id"]]
        assert texts[r["doc_id"]] == r["text"] if left else WORD.findall(texts.get(r["doc_id"], "")) == want[r["doc_id"]]
    assert 0 < mixture.count() and packed.count() >= mixture.count()
    assert sum(r["length"] for r in packed.collect()) == sum(len(packing.Encoder.get()(r["text"])) + 1 for r in mixture.collect())


def test_pipeline_repeated_rows_and_null_ids(spark):
    import corpus_pipeline

    rng = random.Random(21)
    word = lambda n: " ".join("".join(rng.choices("abcdefgh", k=rng.randint(2, 9))) for _ in range(n))
    texts = [word(150) for _ in range(7)]
    near = texts[2].rsplit(" ", 1)[0] + " edited"
    rows = [(1, texts[0], "en", "s", 1)] * 3 + [(2, texts[1], "en", "s", 1), (None, texts[1], "en", "s", 1), (None, texts[1], "en", "t", 1)]
    rows += [(4, texts[2], "en", "s", 1), (3, near, "en", "s", 1), (None, near, None, None, None)] + [(None, texts[3], "en", "s", 1)] * 2
    rows += [(None, texts[4], "en", "s", 1), (5, texts[5], "en", "s", 1), (5, texts[6], "de", "s", 1)]  # one doc_id, two documents
    rows += [(6, " \n", "en", "s", 1), (6, " \n", "en", "s", 1), (None, None, None, None, None)]
    want = [(1, texts[0], "en", "s", 1), (2, texts[1], "en", "s", 1), (3, near, "en", "s", 1), (None, texts[3], "en", "s", 1), *rows[11:]]
    near_rows = corpus_pipeline.near_duplicates(spark, table(spark, rows), SF).checkpoint()
    assert Counter(map(tuple, near_rows.collect())) == Counter(want)
    left = corpus_pipeline.repeated_passages(spark, near_rows, SF)
    assert Counter(map(tuple, left.collect())) == Counter(want)  # no document is lost
    assert corpus_pipeline.near_duplicates(spark, table(spark, []), SF).count() == 0


def test_pipeline_edges(spark):
    """Stages on null values, empty texts, repeated rows, extra columns named like results, and no rows at all."""
    import corpus_pipeline
    from pyspark.sql import functions as F

    rows, df = messy(spark)
    extra = {c: F.lit(c) for c in ("row", "score", "lang_pred", "n_removed", "key_a", "_k", "class_id", "taken")}
    wide = df.withColumns(extra)
    for name, stage in corpus_pipeline.STAGES:
        none = stage(spark, table(spark, []), SF)
        assert none.count() == 0, name
        out = stage(spark, wide, SF)
        if name == "packed":
            assert out.groupBy("doc_id").count().count() == 8
            continue
        assert none.columns == df.columns and out.columns == wide.columns, name
        for r in out.collect():
            assert all(r[c] == c for c in extra), name
            if r["doc_id"] == 4:
                assert r["text"] == rows[4][1], name
    # two runs in one session, both read at the end
    first, second = corpus_pipeline.run(spark, SF), corpus_pipeline.run(spark, SF)
    assert first.count() == second.count() > 0


def brute_words_left(texts, n):
    """The words of each text that are in no run of n words that also starts elsewhere."""
    split = [WORD.findall(t) for t in texts]
    seen = Counter(tuple(w[i : i + n]) for w in split for i in range(len(w) - n + 1))
    out = []
    for w in split:
        gone = {j for i in range(len(w) - n + 1) if seen[tuple(w[i : i + n])] >= 2 for j in range(i, i + n)}
        out.append([x for j, x in enumerate(w) if j not in gone])
    return out


def test_pipeline_passages_of_over_50_words(spark):
    import corpus_pipeline

    rng = random.Random(22)
    word = lambda n, most=9: " ".join("".join(rng.choices("abcdefghé", k=rng.randint(1, most))) for _ in range(n))
    texts = [word(rng.randint(1, 200)) for _ in range(10)]
    for n, most in [(51, 9), (51, 1), (55, 3), (58, 6), (65, 9), (50, 9), (50, 20), (80, 9)]:
        passage = word(n, most)
        texts += [f"{word(30)}x {passage} x{word(40)}", f"{word(20)}y\n{passage.replace(' ', rng.choice([' ', '  ']))}\ny{word(60)}"]
    texts += ["same word " * 60, "é " * 51, "é " * 52 + "z"]
    rows = [(i, t, "en", "s", 1) for i, t in enumerate(texts)]
    found = {r["doc_id"]: r["text"] for r in corpus_pipeline.repeated_passages(spark, table(spark, rows), SF).collect()}
    want = dict(enumerate(brute_words_left(texts, 51)))
    assert {i: WORD.findall(t) for i, t in found.items()} == {i: w for i, w in want.items() if w}


def test_html_templates_of_distinct_pages(spark):
    own = "<html><body><article><h1>T{0}</h1><div><p>Text {0} of one</p><div>Part {0}</div></div></article><div>Foot {0}</div></body></html>"
    bare = "<body><div><p>Bare {0}</p></div></body>"
    box = "<body><div class=q7>Our box</div><div><p>Page {0}</p></div></body>"
    few = "<body><div class=q8>Few</div><div><p>Other {0}</p></div></body>"
    rows = [(f"https://a.example/1?utm_source={i}", own.format(1)) for i in range(6)] + [("https://a.example/1#top", own.format(1))] + [("https://a.example/2", own.format(2))]
    rows += [("https://b.example/1", bare.format(1))] * 8
    rows += [(f"https://c.example/{i}", box.format(i)) for i in range(6)] + [(f"https://c.example/{i}", few.format(i)) for i in range(4)]
    rows += [(f"https://c.example/p{i}", bare.format(i)) for i in range(100)]  # a large host
    pages = spark.createDataFrame([(i, *r) for i, r in enumerate(rows)], "page_id long, url string, html string")
    for most in (200_000, 0):
        found = {r["page_id"]: r["text"] for r in htmlmain.extract(pages, broadcast_hashes=most).collect()}
        texts = [found[i] for i in range(len(rows))]
        assert texts[:8] == ["T1\nText 1 of one\nPart 1"] * 7 + ["T2\nText 2 of one\nPart 2"]  # copies are no template
        assert texts[8:16] == ["Bare 1"] * 8
        assert texts[16:22] == [f"Page {i}" for i in range(6)] and texts[22:26] == [f"Few\nOther {i}" for i in range(4)]


def test_suffix_dedup_hot_passage(spark):
    """One passage in many documents: equal to brute force, in a few rows a document however many they are."""
    rng = random.Random(77)
    word = lambda n: " ".join("".join(rng.choices("abcdefg", k=rng.randint(2, 8))) for _ in range(n))
    passage = word(100)
    texts = [word(rng.randint(40, 90)) + " " + passage + " " + word(rng.randint(40, 90)) for _ in range(90)] + ["z" * 3000, "z" * 1200, passage[:450]]
    want = Counter(zip(range(len(texts)), *zip(*brute_removed([t.encode() for t in texts], 400))))
    found = suffixdedup.remove(table(spark, [(i, t, "en", "s", 1) for i, t in enumerate(texts)]), strings_per_task=10).collect()
    assert Counter((r["doc_id"], r["n_bytes"], r["n_removed"], r["n_spans"], r["kept_sha256"]) for r in found) == want
    data = [t.encode() for t in texts[:90]]
    level = [(7, 90, i, i, 0, 1, d) for i, d in enumerate(data)]
    strings = spark.createDataFrame(level, suffixdedup.STRING)
    ready, ranges = suffixdedup._refined(strings, 400, 10)
    assert ready.count() + ranges.count() <= 40 * 90  # of some 500 windows each


def test_suffix_content_keys():
    rng = np.random.default_rng(3)
    core = rng.integers(0, 256, 500, dtype=np.uint8)
    a, b = (np.concatenate((rng.integers(0, 256, 300, dtype=np.uint8), core, rng.integers(0, 256, 200, dtype=np.uint8))) for _ in range(2))
    for minima in suffixdedup.KEYS:
        x, y = suffixdedup.content_keys(a, 400, minima), suffixdedup.content_keys(b, 400, minima)
        assert (x[300:401] == y[300:401]).all() and len(x) == len(a) - 399
