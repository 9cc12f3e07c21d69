"""The operators against brute force on small tables with every odd case: nulls, empties, long texts, ties, repeats, clashing names."""

import collections
import hashlib
import random
import re

import numpy as np
import pytest

from graphloom.llm import bpe, html_text, jaccard, langid, line_crf, line_dedup, mixing, quality_cnn, suffix_dedup, topk
from graphloom.llm.common import held_out, held_out_py
from pyspark.sql import functions as F

WORD = re.compile(r"[^\x20\x09-\x0D]+")
SCHEMA = "doc_id long, text string, lang string, source string, n_chars long"


def prose(rng, n, stems="la de mon ti ra ko be shu pi ne".split()):
    return " ".join("".join(rng.choice(stems) for _ in range(rng.randint(1, 4))) for _ in range(n))


@pytest.fixture(scope="module")
def rows():
    rng = random.Random(5)
    shared = prose(rng, 60)
    texts = [None, "", "  \n ", "one", "one two", "One two", prose(rng, 20000)]
    for _ in range(12):
        t = "\n".join(prose(rng, rng.randint(5, 25)) for _ in range(rng.randint(1, 9)))
        texts += [t, t, t.replace(" ", " ", 1), t + " " + prose(rng, 3), shared + "\n" + t, t.upper()]
    texts += ["same line\n" * 50, "é" * 300, "é" * 301, "\x00\x1f" * 40, "x" * 49, "x" * 50, "x" * 51]
    out = [(i * 7 % 1009, t, "ab"[i % 2] if i % 5 else None, f"s{i % 4}" if i % 7 else None, len(t or "")) for i, t in enumerate(texts)]
    return out + [out[10], out[0]]


@pytest.fixture(scope="module")
def docs(spark, rows):
    return spark.createDataFrame([(*r, 1, "t") for r in rows], SCHEMA + ", `__t` int, spans string")


def empty(spark):
    return spark.createDataFrame([], SCHEMA)


def lowered(t):
    return re.sub("[A-Z]", lambda m: m[0].lower(), t or "")


def test_line_dedup(spark, docs, rows):
    got = {r.doc_id: r for r in line_dedup.dedup_lines(docs).collect()}
    seen, first = {}, {}
    for i, t in sorted({(r[0], r[1]) for r in rows}, key=lambda x: x[0]):
        lines = t.split("\n") if t is not None else []
        at = [k for k, x in enumerate(lines) if WORD.search(x)]
        gone = set()
        for k in range(len(at) - 2):
            w = tuple(lines[x] for x in at[k : k + 3])
            if w in seen:
                gone.update(at[k : k + 3])
            seen.setdefault(w, (i, k))
        want = "\n".join(x for k, x in enumerate(lines) if k not in gone) if t is not None else None
        assert (got[i].text, got[i].n_lines, got[i].n_removed_lines) == (want, len(at), len(gone))
        assert got[i]["__t"] == 1
    assert line_dedup.dedup_lines(empty(spark)).count() == 0
    clash = docs.withColumns({x: F.lit(x) for x in ("__key", "__doc", "__starts", "__row", "place", "N_runs")})
    kept = line_dedup.dedup_lines(clash).collect()
    assert all(r["__key"] == "__key" and r["__row"] == "__row" and isinstance(r["n_runs"], int) for r in kept) and len(kept) == len(rows)


def test_line_dedup_sends_selected_windows_only(spark, monkeypatch):
    """A shared window has a shared fingerprint; lines of one text only are not sent; small tasks and one task agree."""
    rng = random.Random(12)
    shared = [prose(rng, 8) for _ in range(7)]
    texts = [[prose(rng, 6) for _ in range(30)] for _ in range(40)]
    for i in range(0, 40, 5):
        texts[i][i % 9 : i % 9] = shared[i % 3 :]
    table = spark.createDataFrame([(i, "\n".join(x)) for i, x in enumerate(texts)], "doc_id long, text string")
    marks = [set(line_dedup.windows(*line_dedup.worded("\n".join(x)))[2].tolist()) for x in texts]
    assert marks[0] & marks[5] and not marks[1] & marks[2]
    for _, size, mark, spot, _ in [line_dedup.windows(*line_dedup.worded("\n".join(texts[1])))]:
        assert len(line_dedup.fingerprints(mark, size, spot)) < 0.8 * len(mark)
    whole = sorted((r.doc_id, r.text, r.n_runs) for r in line_dedup.dedup_lines(table).collect())
    monkeypatch.setattr(line_dedup, "HELD", 20)
    assert whole == sorted((r.doc_id, r.text, r.n_runs) for r in line_dedup.dedup_lines(table.repartition(5)).collect())
    assert sum(n for *_, n in whole) == 7


def test_line_dedup_by_words(spark):
    rng = random.Random(8)
    line, half, rest = prose(rng, 50), prose(rng, 30), prose(rng, 20)
    parts = [[line, half, rest], [line], [half, rest], [half, prose(rng, 20)], [prose(rng, 9), line, " ", prose(rng, 9)], [prose(rng, 9), half, "", rest, prose(rng, 9)], [line[: line.rindex(" ")]] * 2, [rest, half], [line, rest]]
    table = spark.createDataFrame([(i, "\n".join(x)) for i, x in enumerate(parts)] + [(None, line)], "doc_id long, text string")
    got = {r.doc_id: (r.text, r.n_lines, r.n_removed_lines, r.n_runs) for r in line_dedup.dedup_lines(table, words=50).collect()}
    a, b = parts[4], parts[5]
    assert got[0] == ("\n".join(parts[0]), 3, 0, 0) and got[1] == ("", 1, 1, 1) and got[2] == ("", 2, 2, 1)
    assert got[3] == ("\n".join(parts[3]), 2, 0, 0) and got[4] == ("\n".join([a[0], " ", a[3]]), 3, 1, 1)
    assert got[5] == ("\n".join([b[0], "", b[4]]), 4, 2, 1) and got[6][2] == 0  # 49 words a line, 98 words once
    assert got[7] == ("\n".join(parts[7]), 2, 0, 0) and got[8] == (rest, 2, 1, 1) and got[None] == (line, 1, 0, 0)
    plain = {r.doc_id: r.n_removed_lines for r in line_dedup.dedup_lines(table).collect()}
    assert not any(plain.values())


def test_language_id(spark, docs):
    rng = random.Random(1)
    own = {"x": "thon ing ble wh er".split(), "y": "ció ado ez ñas que".split()}
    data = [(i, prose(rng, 80, own["xy"[i % 2]]), "xy"[i % 2], "s", 0) for i in range(120)]
    df = spark.createDataFrame([*data, (500, None, None, "s", 0), (501, "12 !!", "x", "s", 0)], SCHEMA)
    model = langid.fit(df.where(~held_out(F.col("doc_id"))))
    got = {r.doc_id: r for r in langid.identify(df, model).collect()}
    assert all(got[i].lang_pred == lang and not got[i].lang_rejected for i, _, lang, _, _ in data)
    assert [(got[i].lang_pred, got[i].lang_score, got[i].lang_rejected) for i in (500, 501)] == [("und", 0.0, True)] * 2
    assert langid.identify(docs, {}).where("lang_pred <> 'und'").count() == 0
    assert langid.fit(empty(spark)) == {}
    assert {r.doc_id for r in df.where(held_out(F.col("doc_id"))).collect()} == {r.doc_id for r in df.collect() if held_out_py(r.doc_id)}


@pytest.fixture(scope="module")
def encoders():
    import public_tokenizers as P
    import tiktoken

    path = P.path("byte_bpe_50k.tiktoken")
    own = bpe.loaded(path, P.PATTERN)
    return own, tiktoken.Encoding("own", pat_str=P.PATTERN, mergeable_ranks=own.ranks, special_tokens={}), path, P.PATTERN


def test_bpe_is_tiktoken(spark, docs, rows, encoders):
    own, ref, path, pattern = encoders
    rng = random.Random(2)
    alphabet = "aabcdetnsroi THE 'sdlm,.!\n\t  é漢  \x1c123<|endoftext|>🙂"
    for _ in range(1500):
        s = "".join(rng.choice(alphabet) for _ in range(rng.randint(0, 60)))
        assert own.encode(s) == ref.encode_ordinary(s)
        assert own.decode_packed(own.encode_packed(s)) == s.encode()
    for r in bpe.digest(docs, path, pattern).select("doc_id", "text", "n_tokens", "ids_sha256", "decoded_sha256").collect():
        ids = ref.encode_ordinary(r.text or "")
        assert r.n_tokens == len(ids)
        assert r.ids_sha256 == hashlib.sha256(np.array(ids, "<u4").tobytes()).hexdigest()
        assert r.decoded_sha256 == hashlib.sha256((r.text or "").encode()).hexdigest()
    assert bpe.encode(empty(spark), path, pattern).count() == 0


def test_html_blocks():
    blocks = html_text.page_blocks
    page = '<html><head><title>T</title><style>p{}</style></head><body><nav><ul><li>menu</ul></nav><div class="ad">buy</div><article><h1>A &amp; B</h1><p><b>c\n d<br><p>e<script>"</p>"</script>f</p><aside>x</aside><div id="user-comments"><p>z</p></div></article><footer>foot</footer>'
    assert blocks(page)[0] == ["A & B", "c d", "ef"]
    assert blocks('<div class="ad">x<article><p>y')[0] == ["y"]
    assert blocks("<p>a<p>b&nbsp;&lt;<td>c") == ([], ["a", "b < c"])
    assert blocks(None) == blocks("") == ([], []) and blocks("a < b") == ([], ["a < b"])


def test_html_hostile_markup():
    import time

    blocks = html_text.page_blocks
    assert blocks("<article><p title=it's>hello</p></article>")[0] == ["hello"]
    assert blocks('<main><div class="share-price">9 up</div><div class="share-box">tell all</div><p>x <math><mi>y</mi></math></p></main>')[0] == ["9 up", "x y"]
    assert blocks('<p title="a > b">c</p><p id = \'d > e\'>f') == ([], ["c", "f"])
    assert blocks('<p>a<b title="lost>c</b>')[1] and blocks("<p>1 < 2 <3 <")[1] == ["1 < 2 <3 <"] and blocks("<a")[1] == ["<a"]
    assert blocks("<svg/>a<script>b")[1] == ["a"]
    for page in ('<a "x" ' * 150_000, '<a "x" ' * 150_000 + ">", '<a x="><a" ' * 90_000, "<script>" * 130_000, "<!--" * 250_000, "<p class='" * 100_000, "<div>" * 90_000 + "</nav></ul>" * 40_000, "<nav><article></article>" * 30_000, "<section><nav><main></main></section>" * 20_000, "<div>" * 200_000, "</div>" * 160_000, '<p><b x="' * 100_000):
        began = time.perf_counter()
        html_text.page_stream(page)
        assert time.perf_counter() - began < 2.5, page[:12]


def test_html_odd_rows(spark):
    schema = "page_id long, url string, html string"
    assert html_text.extract(spark.createDataFrame([], schema)).collect() == []
    long = "<article><p>" + " ".join(f"w{i}" for i in range(60_000)) + "</p></article>"
    rows = [(1, "h", long), (1, "h", long), (1, "h", "<p>other"), (None, None, "<p>no id"), (2, "h", " \n ")]
    got = html_text.extract(spark.createDataFrame([(*r, 5, "x") for r in rows], schema + ", host int, packed string")).collect()
    assert sorted((str(r.page_id), r.text[:5], r.n_chars) for r in got) == sorted([("1", "w0 w1", len(long) - 26)] * 2 + [("1", "other", 5), ("None", "no id", 5), ("2", "", 0)])


def test_html_boilerplate_and_unique_runs(spark):
    chrome = "all rights reserved by the owner of this fine site and shop"
    pages = [(i, "http://h.example/x" if i < 5 else "http://h.example/y", f"<div><p>{chrome}</p><p>story number {i} tells of {'abc'[i % 3]} things</p></div>") for i in range(5)]
    pages += [(10, "u", None), (11, None, ""), (12, "http://m/1", "<article>twin text that is long enough to be found by all</article>"), (13, "http://m/2", "<article>twin text that is long enough to be found by all</article>")]
    got = {r.page_id: r for r in html_text.extract(spark.createDataFrame(pages, "page_id long, url string, html string")).collect()}
    assert [got[i].text for i in range(5)] == [f"story number {i} tells of {'abc'[i % 3]} things" for i in range(5)]
    assert got[10].text == got[11].text == "" and got[12].text == got[13].text != "" and got[12].n_chars == len(got[12].text)
    assert html_text.boilerplate([["a b c d e f g h i"]] * 9) == [[False]] * 9  # mirrors count once


def test_html_articles_meet_the_host_array(spark):
    rng = random.Random(4)
    promo, tale = "join our list of friends now and save on every order", prose(rng, 40)
    story = [prose(rng, 30) for _ in range(6)]
    pages = [(i, f"http://h/{i}", f"<article><h1>Title {i}</h1><p>{story[i]}</p><p>{promo}</p></article>") for i in range(4)]
    pages += [(4, "http://h/4", f"<article><a>teaser</a></article><div>{story[4]}</div><div>{promo}</div>")]
    pages += [(i, f"http://h/{i}", f"<main><p>{tale}</p><p>view {i}</p></main>") for i in range(5, 9)]  # one article, nearly the same page
    pages += [(i, f"http://h/{i}", f"<div>at {i}</div><main><p>{story[5]}</p></main>") for i in range(9, 13)]  # mirrors
    got = {r.page_id: r.text for r in html_text.extract(spark.createDataFrame(pages, "page_id long, url string, html string")).collect()}
    assert [got[i] for i in range(4)] == [f"Title {i}\n{story[i]}" for i in range(4)]
    assert got[4] == f"teaser\n{story[4]}"
    assert [got[i] for i in range(5, 9)] == [f"{tale}\nview {i}" for i in range(5, 9)]
    assert [got[i] for i in range(9, 13)] == [f"at {i}\n{story[5]}" for i in range(9, 13)]


def test_html_parts_of_a_host_count_together(spark, monkeypatch):
    rng = random.Random(6)
    notice, rare, tale = prose(rng, 12), prose(rng, 12), prose(rng, 30)
    pages = [(i, f"http://h/{i}", f"<article><p>{prose(rng, 30)}</p>{f'<p>{notice}</p>' if i % 7 == 0 else ''}{f'<p>{rare}</p>' if i in (3, 4) else ''}</article>") for i in range(42)]
    pages += [(i, f"http://h/{i}", f"<main>{tale}</main>") for i in range(50, 60)] + [(99, None, None), (98, "http://h/98", ""), (97, "http://other/1", f"<p>{notice}")]
    table = spark.createDataFrame(pages, "page_id long, url string, html string")
    whole = {r.page_id: r.text for r in html_text.extract(table).collect()}
    monkeypatch.setattr(html_text, "GROUP_PAGES", 3)
    parts = {r.page_id: r.text for r in html_text.extract(table).collect()}
    monkeypatch.setattr(html_text, "FEW_WINDOWS", 2)
    assert parts == {r.page_id: r.text for r in html_text.extract(table).collect()}
    assert parts == whole and len(parts) == len(pages)
    assert not any(notice in parts[i] for i in range(42)) and rare in parts[3] and rare in parts[4]
    assert parts[50] == tale and parts[97] == notice and parts[98] == parts[99] == ""


def test_suffix_array_is_sorted():
    rng = np.random.default_rng(0)
    s = rng.integers(0, 3, 300)
    order, rank = html_text.suffix_ranks(s, 5)
    keys = [tuple(s[i : i + 5]) for i in range(300)]
    assert all(keys[a] <= keys[b] for a, b in zip(order, order[1:]))
    assert all((rank[i] == rank[j]) == (keys[i] == keys[j]) for i in range(0, 295, 7) for j in range(0, 295, 5))


def groups_by_force(rows):
    sets = {}
    for i, t in {(r[0], r[1]) for r in rows}:
        w = WORD.findall(lowered(t))
        sets[i] = frozenset(tuple(w[k : k + 5]) for k in range(max(1, len(w) - 4))) if w else frozenset()
    up = {i: i for i in sets}

    def root(i):
        while up[i] != i:
            i = up[i]
        return i

    ids = sorted(sets)
    for k, a in enumerate(ids):
        for b in ids[:k]:
            if sets[a] and sets[b] and 100 * len(sets[a] & sets[b]) >= 80 * len(sets[a] | sets[b]):
                x, y = root(a), root(b)
                up[max(x, y)] = min(x, y)
    return {i: (len(sets[i]), root(i)) for i in ids}


def test_jaccard_join(spark, docs, rows):
    got = jaccard.similar_groups(docs).collect()
    assert {r.doc_id: (r.n_shingles, r.component_id) for r in got} == groups_by_force(rows)
    assert jaccard.similar_groups(empty(spark)).count() == 0


def test_jaccard_join_of_an_id_with_two_texts(spark):
    rng = random.Random(9)
    a, b = prose(rng, 60), prose(rng, 60)
    rows = [(7, a), (7, b), (8, a + " end"), (2, b + " end"), (9, "end " + a), (11, "end " + b), (12, a), (13, b)]
    got = sorted((r.doc_id, r.component_id) for r in jaccard.similar_groups(spark.createDataFrame(rows, "doc_id long, text string")).collect())
    assert got == [(2, 2), (7, 2), (7, 7), (8, 7), (9, 7), (11, 2), (12, 7), (13, 2)]


def test_jaccard_join_heavy_lists_and_small_sets(spark, monkeypatch):
    monkeypatch.setattr(jaccard, "HEAVY", 3)
    monkeypatch.setattr(jaccard, "BLOCK_SHINGLES", 200)
    rng = random.Random(9)
    base = prose(rng, 60).split()
    rows = []
    for i in range(60):
        w = list(base)
        for _ in range(rng.randint(0, 3)):
            w[rng.randrange(60)] = prose(rng, 1)
        rows.append((i, " ".join(w)))
    small = prose(rng, 9).split()
    rows += [(100 + k, " ".join(small[: 6 + k % 4] + ([prose(rng, 1)] if k % 3 else []))) for k in range(24)]
    got = {r.doc_id: (r.n_shingles, r.component_id) for r in jaccard.similar_groups(spark.createDataFrame(rows, "doc_id long, text string")).collect()}
    assert got == groups_by_force(rows)


def test_jaccard_join_near_copies_of_one_hub(spark, monkeypatch):
    """A hot list whose sets link with its first one, some only through others, in many blocks."""
    monkeypatch.setattr(jaccard, "HEAVY", 5)
    monkeypatch.setattr(jaccard, "BLOCK_SETS", 7)
    rng = random.Random(14)
    base = prose(rng, 90).split()
    rows = []
    for i in range(120):
        w = list(base)
        for k in range(rng.randint(0, 5)):
            w[(i + 17 * k) % 60 + 20] = prose(rng, 1)
        rows.append((i, " ".join(w if i % 4 else w[: 50 + i % 40])))
    got = {r.doc_id: (r.n_shingles, r.component_id) for r in jaccard.similar_groups(spark.createDataFrame(rows, "doc_id long, text string")).collect()}
    assert got == groups_by_force(rows)


def test_jaccard_join_chooses_subsets_for_short_texts(spark, monkeypatch):
    chosen = []
    choose = jaccard.boundary_by_cost
    monkeypatch.setattr(jaccard, "boundary_by_cost", lambda *a: chosen.append(choose(*a)) or chosen[-1])
    rng = random.Random(15)
    tail = prose(rng, 14).split()
    # many short texts that share most of their shingles: long lists, few subsets
    rows = [(i, " ".join([prose(rng, 1)] * (i % 3 > 0) + tail[: 13 + i % 2] + [prose(rng, 1)])) for i in range(400)]
    got = {r.doc_id: (r.n_shingles, r.component_id) for r in jaccard.similar_groups(spark.createDataFrame(rows, "doc_id long, text string")).collect()}
    assert got == groups_by_force(rows) and max(r[0] for r in got.values()) <= chosen[0] <= jaccard.MOST_SMALL


def test_overlap_links_memory_is_bounded():
    import tracemalloc

    rng = np.random.default_rng(3)
    n = 2 * jaccard.BLOCK_SETS
    flat = np.concatenate([np.arange(10) + (rng.integers(0, 3) if i % 9 else 5000 + i) for i in range(n)]).astype(np.int64)
    tracemalloc.start()
    jaccard.overlap_links(np.arange(n), np.full(n, 10), flat)
    assert tracemalloc.get_traced_memory()[1] < 80_000_000
    tracemalloc.stop()


def test_subset_sizes_cover_every_link():
    for a in range(1, 11):
        for b in range(a, 11):
            o = jaccard.needed(a, b)
            if o <= a:
                assert o in jaccard.subset_sizes(a) and o in jaccard.subset_sizes(b)


def test_top_k(spark, monkeypatch):
    monkeypatch.setattr(topk, "BLOCK", 64)
    monkeypatch.setattr(topk, "QUERY_BLOCK", 4)
    rng = np.random.default_rng(1)
    v = rng.normal(size=(400, 6)).round(2)
    v[200:260] = v[0]
    rows = [(int(i), [float(x) for x in v[i]]) for i in range(400)] + [(400, None), (401, []), (402, [1.0, None, 1.0, 1.0, 1.0, 1.0]), (403, [float("nan")] * 6), (450, [float("inf")] * 6), (500, [1.0, 2.0]), (3, [float(x) for x in v[3]])]
    df = spark.createDataFrame(rows, "vec_id long, embedding array<double>")
    got = collections.defaultdict(list)
    for r in topk.top_k(df, F.col("vec_id") % 50 == 0).collect():
        got[r.query_id].append((r["rank"], r.vec_id, r.score))
    q = np.floor(v * 256).astype(int)
    for i in range(0, 400, 50):
        best = sorted(((-int(q[i] @ q[j]), j) for j in range(400) if j != i))[:5]
        assert sorted(got[i]) == [(k + 1, j, -s) for k, (s, j) in enumerate(best)]
    assert set(got) == set(range(0, 400, 50))


def test_top_k_odd_tables(spark):
    schema = "vec_id long, embedding array<float>, score int, `__id` string"
    assert topk.top_k(spark.createDataFrame([], schema), F.col("vec_id") % 50 == 0).collect() == []
    rows = [(0, [1.0, -2.0], 9, "x"), (0, [1.0, -2.0], 8, "y"), (1, [1.0, -2.0], 7, "z"), (2, [1.0, -2.0], 7, "z"), (None, [1.0, 1.0], 1, "n")]
    got = topk.top_k(spark.createDataFrame(rows, schema), F.col("vec_id") % 50 == 0).orderBy("rank").collect()
    assert [tuple(r) for r in got] == [(0, 1, 1, 5 * 256 * 256), (0, 2, 2, 5 * 256 * 256)]


def test_threshold_search_with_a_floor():
    """A floor from elsewhere loses no result that reaches it, ties included, and saves rows where scores are skewed."""
    rng = np.random.default_rng(7)
    rows = np.floor(rng.pareto(2.0, size=(2000, 8)) * 40)
    lists, ids = topk.sorted_lists(rows), np.arange(2000)
    scored = 0
    for q in range(20):
        query = rows[q * 7]
        every = sorted(((-int(s), int(i)) for i, s in enumerate(rows @ query) if i != q * 7))[:5]
        assert [(-s, i) for s, i in topk.threshold_search(query, q * 7, ids, rows, lists, 5)[0]] == every
        floor = -every[2][0]
        found, n = topk.threshold_search(query, q * 7, ids, rows, lists, 5, floor)
        assert [(-s, i) for s, i in found] == [x for x in every if -x[0] >= floor]
        scored += n
    assert scored < 0.7 * 20 * 2000


def test_threshold_search_stops_early():
    rows = np.zeros((1000, 4))
    rows[:3] = 50
    rows[3:] = np.arange(997)[:, None] % 7
    found, scored = topk.threshold_search(np.ones(4), -1, np.arange(1000), rows, topk.sorted_lists(rows), 3)
    assert [i for _, i in found] == [0, 1, 2] and scored < 500


def test_mixing(spark, docs, rows):
    got = mixing.copies(docs).collect()
    assert len(got) == len(rows)
    size = collections.Counter()
    for r in rows:
        size[r[3]] += len(WORD.findall(r[1] or ""))
    order = sorted(x for x in size if x is not None) + [None]
    weight = {s: (5, 2, 1)[k % 3] for k, s in enumerate(order)}
    target, free = {}, set(order)
    while True:
        rest = sum(size.values()) - sum(target.values())
        share = {s: rest * weight[s] / sum(weight[x] for x in free) for s in free}
        over = {s for s in free if share[s] > 3 * size[s]}
        if not over:
            target.update(share)
            break
        target.update({s: 3 * size[s] for s in over})
        free -= over
    taken = collections.Counter()
    for r in got:
        assert r.mix_size == len(WORD.findall(r.text or "")) and r.mix_source_size == size[r.source]
        assert r.mix_target == pytest.approx(target[r.source]) and len(r.mix_shards) <= 3
        taken[r.source] += r.mix_size * len(r.mix_shards)
    assert all(abs(taken[s] - target[s]) <= max(200, 0.05 * target[s]) and taken[s] <= target[s] + 1 for s in order if s != rows[6][3])
    assert sorted(map(str, mixing.mix(docs).collect())) == sorted(map(str, mixing.mix(docs.repartition(3)).collect()))
    assert mixing.copies(empty(spark)).count() == 0


def test_shard_quotas_are_exact(spark):
    drawn = spark.createDataFrame([(False, s, 1, b, b, 1, False) for s, n in (("a", 40), ("b", 9)) for b in range(n)], "__null boolean, __src string, __nb long, __block long, __at long, __times long, __partial boolean").withColumn("__draws", F.col("__times"))
    runs = {r["__src"]: [(x.f, x.h) for x in r["__ranges"]] for r in mixing.shard_quotas(drawn, 2).collect()}
    n = collections.Counter()
    for s, total in (("a", 40), ("b", 9)):
        for (f, h), (g, _) in zip(runs[s], [*runs[s][1:], (total, 0)]):
            n[h] += g - f
    assert sorted(n.values()) == [12, 12, 12, 13]


def test_line_rules(docs, rows):
    model = (np.zeros((line_crf.N_FEATURES, 2)), np.zeros((2, 2)))
    got = {r.doc_id: r for r in line_crf.apply_rules(docs, model).collect()}
    for i, t, *_ in rows:
        w = WORD.findall(t or "")
        seen = collections.Counter(zip(w, w[1:], w[2:]))
        rep = {k + d for k in range(len(w) - 2) if seen[tuple(w[k : k + 3])] > 1 for d in range(3)}
        lines = [x for x in (t or "").split("\n") if WORD.search(x)]
        r = got[i]
        assert (r.n_words, r.word_chars, r.n_symbols) == (len(w), sum(map(len, w)), len(re.findall(r"[#*$%&|<>]", t or "")))
        assert (r.n_dup_lines, r.n_repeat_words) == (len(lines) - len(set(lines)), len(rep))
        assert r.base_failed == (len(w) < 50 or 100 * len(rep) > 50 * len(w)) and r.kept == (not r.base_failed)


def test_viterbi_finds_the_best_path():
    from itertools import product

    rng = np.random.default_rng(4)
    for _ in range(30):
        e, m = rng.normal(size=(6, 2)), rng.normal(size=(2, 2))
        best = max(product((0, 1), repeat=6), key=lambda p: sum(e[k, x] for k, x in enumerate(p)) + sum(m[a, b] for a, b in zip(p, p[1:])))
        assert tuple(line_crf.viterbi(e, m)) == best


def noisy(rng, n):
    return " ".join(prose(rng, 1) + rng.choice(["###", "$$$", "%%%"]) for _ in range(n))


def test_classifiers_learn_the_noise(monkeypatch):
    rng = random.Random(3)
    sample = [(prose(rng, 80) + ".", 1) if k % 2 else (noisy(rng, 80), 0) for k in range(120)]
    test = [(prose(rng, 90) + ".", 1) if k % 2 else (noisy(rng, 90), 0) for k in range(40)]
    monkeypatch.setattr(quality_cnn, "STEPS", 60)
    net = quality_cnn.fit(sample)
    assert sum((quality_cnn.score(net, t) >= 0.3) == y for t, y in test) >= 38
    assert 0 <= quality_cnn.score(net, None) == quality_cnn.score(net, "") <= 1
    assert quality_cnn.score(quality_cnn.fit([]), "any") == 0.5
    w = line_crf.fit(sample)
    assert line_crf.judge("some text", *line_crf.fit([]))[6] == 1.0
    assert sum(line_crf.judge(t, *w)[-1] == bool(y) for t, y in test) >= 38


def test_lines_of_one_document_get_both_labels(spark):
    rng = random.Random(13)
    footer = [noisy(rng, 6) for _ in range(3)]

    def mixed_doc():
        return "\n".join([prose(rng, 12) + "." for _ in range(6)] + footer[: rng.randint(2, 3)])

    sample = [("\n".join(prose(rng, 12) + "." for _ in range(6)), 1) for _ in range(40)] + [(mixed_doc(), 1) for _ in range(40)] + [("\n".join(noisy(rng, 8) for _ in range(6)), 0) for _ in range(40)]
    w, move = line_crf.fit(sample)
    for _ in range(5):
        text = mixed_doc()
        path = line_crf.viterbi(line_crf.line_features(text)[0] @ w, move)
        assert list(path[:6]) == [line_crf.CONTENT] * 6 and set(path[6:]) == {line_crf.BOILERPLATE}
        assert 0 < line_crf.judge(text, w, move)[6] < 1
    rows = line_crf.apply_rules(spark.createDataFrame([(1, mixed_doc()), (1, None)], "doc_id long, text string"), (w, move)).collect()
    assert sorted((r.kept, 0 < r.content_share < 1) for r in rows) == [(False, False), (True, True)]
    assert line_crf.apply_rules(empty(spark), (w, move)).collect() == []


def test_constrained_labels_follow_the_document():
    p, sizes, none = np.array([0.99, 0.5, 0.01, 0.02]), np.array([1, 40, 40, 40]), np.zeros(4, bool)
    assert list(line_crf.constrained(p, sizes, True, none)) == [1, 0, 0, 0]
    assert list(line_crf.constrained(p, sizes, False, none)) == [1, 1, 1, 1]  # sure content, but too much of a bad document
    assert list(line_crf.constrained(p, np.array([1, 1, 1, 40]), True, np.array([0, 0, 1, 0], bool))) == [1, 0, 1, 0]


def test_classify_through_spark(spark, docs, rows):
    net = quality_cnn.fit([])
    got = quality_cnn.classify(docs, net).collect()
    assert len(got) == len(rows) and all(r.quality_score == 0.5 and r.quality_pred == 1 for r in got)
    net = quality_cnn.Net(np.random.default_rng(1).normal(size=net.table.shape).astype(np.float32), net.bias, net.out + 1, float(np.log(0.3 / 0.7)) - 1e-9)
    by = collections.defaultdict(set)
    for r in quality_cnn.classify(docs.select("doc_id", "text"), net, keep=("doc_id", "text")).collect():
        by[r.text or ""].add((r.quality_score, r.quality_pred))
        assert r.quality_pred == (r.quality_score >= quality_cnn.THRESHOLD) and r.quality_score == pytest.approx(quality_cnn.score(net, r.text))
    assert all(len(x) == 1 for x in by.values())
    assert quality_cnn.classify(empty(spark), net).collect() == []


def test_chunks_cover_every_position():
    for n in (1, 63, 64, 65, 128, 200):
        r = np.zeros((n, 1), np.float32)
        r[n - 1] = 1
        assert quality_cnn._chunks(r).max() > 0


def removed_by_force(rows):
    seen, out = {}, {}
    for i, t in sorted({(r[0], r[1]) for r in rows}, key=lambda x: x[0]):
        d = (t or "").encode()
        grams = [d[k : k + 50] for k in range(len(d) - 49)]
        hit = np.zeros(len(d), bool)
        for k, g in enumerate(grams):
            if g in seen:
                hit[k : k + 50] = True
        for g in grams:
            seen.setdefault(g, i)
        out[i] = (len(d), int(hit.sum()), int((np.diff(np.append(0, hit.astype(int))) == 1).sum()), bytes(np.frombuffer(d, np.uint8)[~hit]))
    return out


def test_suffix_dedup(spark, docs, rows):
    got = {r.doc_id: (r.n_bytes, r.n_removed, r.n_spans, bytes(r.kept)) for r in suffix_dedup.remove_repeats(docs).collect()}
    assert got == removed_by_force(rows)
    assert suffix_dedup.remove_repeats(empty(spark)).count() == 0


def test_suffix_dedup_overlapping_repeats(spark):
    rng = random.Random(8)
    base = "".join(rng.choice("abc ") for _ in range(400))
    rows = []
    for i in range(40):
        a = rng.randrange(300)
        rows.append((i, "".join(rng.choice("xyz") for _ in range(rng.randrange(90))) + base[a : a + rng.randrange(30, 100)] + base[rng.randrange(340) :]))
    got = {r.doc_id: (r.n_bytes, r.n_removed, r.n_spans, bytes(r.kept)) for r in suffix_dedup.remove_repeats(spark.createDataFrame(rows, "doc_id long, text string")).collect()}
    assert got == removed_by_force(rows)


def test_merged_transforms_hold_the_repeat_intervals():
    rng = random.Random(6)
    shards = [[bytes(rng.choice(b"ab") for _ in range(rng.randint(5, 30))) for _ in range(6)] for _ in range(3)]
    last = [np.frombuffer(suffix_dedup.transform(s), np.uint8) for s in shards]
    rows, run = suffix_dedup.merged_intervals(last, 8)
    string, place = suffix_dedup.row_places_all(last, [np.array(list(map(len, s)), np.int32) for s in shards])
    flat = [s for x in shards for s in x]
    got = collections.defaultdict(set)
    for r, k in zip(rows, run):
        got[k].add((int(string[r]), int(place[r])))
    want = collections.defaultdict(set)
    for i, s in enumerate(flat):
        for k in range(len(s) - 7):
            want[s[k : k + 8]].add((i, k))
    assert sorted(map(sorted, got.values())) == sorted(sorted(x) for x in want.values() if len(x) > 1)


def test_suffix_dedup_with_many_ranges(spark, docs, rows, monkeypatch):
    monkeypatch.setattr(suffix_dedup, "HELD_RUNS", 20)
    monkeypatch.setattr(suffix_dedup, "MERGE_BYTES", 500)
    got = {r.doc_id: (r.n_bytes, r.n_removed, r.n_spans, bytes(r.kept)) for r in suffix_dedup.remove_repeats(docs).collect()}
    assert got == removed_by_force(rows)


def test_nothing_to_settle():
    none = np.empty(0, np.int64)
    order, least = suffix_dedup._least_of(none, none, none.view(np.uint64), none.view(np.uint64))
    assert len(order) == len(least) == 0
