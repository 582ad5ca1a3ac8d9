"""Nulls, empty and long texts, ties, repeated rows, empty tables and clashing column names."""

import collections

import numpy as np
import pytest
from hypothesis import given, settings, strategies as st

pytest.importorskip("colonnade.llm.queries")
from colonnade.llm import bpe, components, html_text, line_dedup, mixing, ngram_join, quality_rules, queries, spot_signatures, suffix_dedup, toxicity, url_filter  # noqa: E402

from colonnade.llm.frames import staged  # noqa: E402

SHAPE = "doc_id bigint, text string, source string, id string, row int, key string, block string, size string, n bigint"
LONG = " ".join(f"word{i % 977} of the" for i in range(40_000))


@pytest.fixture(scope="module")
def odd(spark):
    """Every awkward row, with columns named like those that operators make."""
    line = "a line that stands in several documents, again and again and again\n"
    texts = [
        (1, line + "tail one"), (2, line + "tail two"), (2, line + "tail two"), (3, None), (4, ""), (5, " \n\t\n "), (6, LONG), (7, LONG),
        (None, line + "no id"), (8, "short"), (9, "é" * 60), (10, "x" * 5000), (11, "x" * 5000), (12, line * 5), (None, None),
    ]
    rows = [(d, t, None if i % 4 == 3 else f"s{i % 3}", "id", i, None, "b", "z", i) for i, (d, t) in enumerate(texts)]
    return spark.createDataFrame(rows, SHAPE).repartition(3)


@pytest.fixture(scope="module")
def empty(spark):
    return spark.createDataFrame([], SHAPE)


@pytest.fixture(scope="module")
def labels(spark):
    return spark.createDataFrame([(1, 1, 0), (2, 0, 1), (2, 1, 0), (6, 1, 0), (None, 0, 1), (8, None, None)], "doc_id bigint, quality int, toxic int")


def by_row(odd, df, *names):
    got = sorted(map(repr, (tuple(r[n] for n in names) for r in df.collect())))
    assert len(got) == odd.count()
    return got


OPERATORS = {
    "suffix": lambda d, _: suffix_dedup.digests(d),
    "ngrams": lambda d, _: ngram_join.similar_groups(d),
    "quality": lambda d, labels: quality_rules.judge(d, quality_rules.fit(d, labels)),
    "toxicity": lambda d, labels: toxicity.score(d, toxicity.fit(d, labels)),
    "mixing": lambda d, _: mixing.mix(d),
    "lines": lambda d, _: line_dedup.with_bitmaps(d),
    "spots": lambda d, _: spot_signatures.compare_neighbours(d),
    "bpe": lambda d, _: bpe.digests(d, queries.vocabulary_path()),
    "urls": lambda d, _: url_filter.judge(d, queries.URL_RULES, url_filter.fit(d, "text", "n"), "doc_id", "text"),
    "html": lambda d, _: html_text.extract(d, "doc_id", "text", "source"),
}


@pytest.mark.parametrize("name", sorted(OPERATORS))
def test_awkward_rows_and_empty_tables(odd, empty, labels, name):
    assert OPERATORS[name](odd, labels).count() == odd.count()
    assert OPERATORS[name](empty, labels.limit(0)).count() == 0


@pytest.mark.parametrize("run", [line_dedup.dedup_lines, ngram_join.one_of_each, mixing.mixed, lambda d: quality_rules.keep_good(d, [])])
def test_filters_keep_the_columns(odd, empty, run):
    assert run(odd).columns == odd.columns and run(empty).count() == 0
    assert {r["n"] for r in run(odd).collect()} <= set(range(odd.count()))


def test_lines_of_the_smallest_id_stay(odd):
    texts = collections.defaultdict(list)
    for r in line_dedup.dedup_lines(odd).collect():
        texts[r["doc_id"]].append(r["text"])
    line = "a line that stands in several documents, again and again and again"
    assert sorted(texts[None]) == ["", line + "\nno id"]
    assert texts[1] == ["tail one"] and texts[2] == ["tail two"] * 2 and texts[12] == [""]
    assert texts[6] == [LONG] and texts[7] == [""] and texts[3] == texts[4] == [""]


def test_suffix_ids(odd):
    found = collections.defaultdict(list)
    for r in suffix_dedup.digests(odd).collect():
        found[r["id"]].append((r["n_bytes"], r["n_removed"]))
    assert found[7] == [(len(LONG), len(LONG))] and found[6] == [(len(LONG), 0)]
    assert found[11] == [(5000, 5000)] and found[10] == [(5000, 0)] and found[9] == [(120, 0)]
    assert found[2][0] == found[2][1] and found[2][0][1] >= 66 and found[4] == [(0, 0)]


def test_ngram_groups(odd):
    found = collections.defaultdict(set)
    for r in ngram_join.similar_groups(odd).collect():
        found[r["id"]].add((r["n_shingles"] > 0, r["component"]))
    assert found[7] == {(True, 6)} and found[11] == {(True, 10)} and found[4] == {(False, 4)} and found[8] == {(True, 8)}
    assert all(c is None for _, c in found[None])


def test_mix_ends_at_twice_a_document(odd):
    rows = mixing.mix(odd).collect()
    assert {r["times"] for r in rows} <= {0, 1, 2} and all(r["times"] == 0 for r in rows if not r["size"])
    assert sorted(map(repr, rows)) == sorted(map(repr, mixing.mix(odd.repartition(5)).collect()))


def windows_by_hand(pieces, owners):
    least = {}
    for p, o in zip(pieces, owners):
        for i in range(len(p) - suffix_dedup.WIDTH + 1):
            w = p[i:i + suffix_dedup.WIDTH]
            least[w] = min(o, least.get(w, o))
    return [least[p[i:i + suffix_dedup.WIDTH]] for p in pieces for i in range(len(p) - suffix_dedup.WIDTH + 1)]


@settings(max_examples=120, deadline=None)
@given(st.lists(st.tuples(st.sampled_from(["ab", "a", "\0a", "ba\xff"]), st.integers(0, 9999), st.integers(50, 130), st.integers(-3, 9)), min_size=1, max_size=12))
def test_two_stage_sort_groups_equal_windows(specs):
    pieces, owners = [], []
    for letters, seed, size, owner in specs:
        rng = np.random.default_rng(seed % 7)
        piece = bytes(ord(letters[i]) for i in rng.integers(0, len(letters), size)) if seed % 3 else (letters.encode("latin1") * size)[:size]
        if piece not in pieces:
            pieces.append(piece)
            owners.append(owner)
    found, base = suffix_dedup.first_owners(pieces, np.array(owners, np.int64))
    assert found.tolist() == windows_by_hand(pieces, owners)


def test_sorted_windows_are_in_order():
    text = b"banana bandana " * 9
    data = np.frombuffer(text, np.uint8)
    order = suffix_dedup.sorted_windows(data, np.array([0]), np.array([len(text)]))
    assert sorted(order.tolist()) == list(range(len(text) - 49))
    strings = [text[i:i + 50] for i in order]
    assert strings == sorted(strings)


@settings(max_examples=60, deadline=None)
@given(st.lists(st.sets(st.integers(0, 40), min_size=1, max_size=30), min_size=2, max_size=25, unique_by=frozenset))
def test_tree_links_connect_what_is_alike(sets):
    tokens = [np.array(sorted(s), np.uint64) for s in sets]
    codes = [(t % 3).astype(np.uint8) for t in tokens]
    tokens = [t[np.lexsort((t, c))] for t, c in zip(tokens, codes)]
    codes = [(t % 3).astype(np.uint8) for t in tokens]
    everyone = list(range(len(sets)))
    links = ngram_join.tree_links(tokens, codes, [len(s) for s in sets], everyone, everyone)
    ours, theirs = ngram_join.Union(len(sets)), ngram_join.Union(len(sets))
    for a, b in links:
        assert ngram_join.alike(len(sets[a] & sets[b]), len(sets[a]), len(sets[b]))
        ours.join(a, b)
    for a in everyone:
        for b in range(a):
            if ngram_join.alike(len(sets[a] & sets[b]), len(sets[a]), len(sets[b])):
                theirs.join(a, b)
    assert [ours.find(i) for i in everyone] == [theirs.find(i) for i in everyone]


def test_families_in_parts_give_the_same_groups(spark, small, monkeypatch):
    docs = queries.table(spark, small, "documents")
    whole = sorted(map(repr, ngram_join.similar_groups(docs).collect()))
    monkeypatch.setattr(ngram_join, "PART", 2)
    assert sorted(map(repr, ngram_join.similar_groups(docs).collect())) == whole


def test_components_of_a_path_and_a_star(spark):
    links = [(i, i + 1) for i in range(40)] + [(100, i) for i in range(101, 160)] + [(7, None), (300, 300)]
    found = {r["node"]: r["label"] for r in components.components(spark.createDataFrame(links, "a bigint, b bigint")).collect()}
    assert found == {**dict.fromkeys(range(41), 0), **dict.fromkeys(range(100, 160), 100)}


WORDS = st.text(st.sampled_from("abtheıİΣσßéé'’s 19²!?.<|endoftext>\x1c\x85　中🎉"), max_size=60)


@settings(max_examples=150, deadline=None)
@given(st.lists(st.one_of(WORDS, st.just("x<|endoftext|>y <|startoftext|>")), max_size=5))
def test_bpe_equals_the_library(texts):
    from tokenizers import Tokenizer

    library = Tokenizer.from_file(queries.vocabulary_path())
    own = bpe.vocabulary(queries.vocabulary_path())
    for text, (ids, decoded) in zip(texts, own.encode_many(texts)):
        expected = library.encode(text, add_special_tokens=False).ids
        assert np.frombuffer(ids, "<u4").tolist() == expected
        assert decoded == own.decode(ids) == library.decode(expected, skip_special_tokens=False)


def test_bpe_of_long_words_and_of_letters_that_python_does_not_know():
    from tokenizers import Tokenizer

    library = Tokenizer.from_file(queries.vocabulary_path())
    own = bpe.vocabulary(queries.vocabulary_path())
    rng = np.random.default_rng(3)
    letters = np.frombuffer(b"abcdefghijklmnopqrstuvwxyz", np.uint8)
    long = [letters[rng.integers(0, n, 30_000)].tobytes().decode() for n in (1, 2, 26)] + ["é中" * 5000, "!?" * 999, "1" * 70]
    new = [chr(c) for c in (0x1C89, 0xA7CB, 0xA7CE, 0xA7D2, 0xA7D4, 0xA7DA, 0xA7DC, 0x10D55, 0x16EA0, 0x16EB8, 0x88F, 0x11DE3, 0x3D001, 0x1246F)]
    texts = long + [shape.format(c) for c in new for shape in ("{0}", "a{0}b", "1{0}{0}2", "x {0}. ü{0}")]
    for text, (ids, decoded) in zip(texts, own.encode_many(texts)):
        expected = library.encode(text, add_special_tokens=False).ids
        assert np.frombuffer(ids, "<u4").tolist() == expected, text[:20]
        assert decoded == library.decode(expected, skip_special_tokens=False)


def test_a_passage_in_very_many_contexts_is_dealt_out(spark):
    rng = np.random.default_rng(5)
    letters = np.frombuffer(b"abcdefghijklmnopqrstuvwxyz ", np.uint8)
    some = lambda n: letters[rng.integers(0, len(letters), n)].tobytes().decode()
    passage = some(90)
    texts = [some(80) + (passage if i % 3 else "") + some(80) for i in range(3000)]
    first = {}
    for i, t in enumerate(texts):
        for k in range(len(t) - suffix_dedup.WIDTH + 1):
            first.setdefault(t[k:k + suffix_dedup.WIDTH], i)
    expected = {}
    for i, t in enumerate(texts):
        gone = {j for k in range(len(t) - suffix_dedup.WIDTH + 1) if first[t[k:k + suffix_dedup.WIDTH]] < i for j in range(k, k + suffix_dedup.WIDTH)}
        expected[i] = "".join(c for j, c in enumerate(t) if j not in gone).encode()
    docs = spark.createDataFrame(list(enumerate(texts)), "doc_id bigint, text string").repartition(6)
    for hot in (2000, 1 << 40):
        assert {r["id"]: bytes(r["rest"]) for r in suffix_dedup.spans(docs, hot_bytes=hot).collect()} == expected
    blocks = suffix_dedup.pack_documents(docs)
    answers = suffix_dedup.staged(suffix_dedup.census(blocks, lambda data: suffix_dedup.key_bytes(data, 64)), "repeat-counts")
    loads = collections.Counter()
    for r in suffix_dedup.sent_pieces(blocks, answers, 64, 2000).collect():
        loads[r["bucket"]] += len(suffix_dedup.unpacked(r["pieces"]))
    # Dealt by the smallest hash alone, the texts around either end of the passage meet in one bucket.
    assert max(loads.values()) < 3 * sum(loads.values()) / 64


def test_html_without_an_article_keeps_the_surge():
    page = (
        "<html><head><title>t</title></head><body><div class='nav'><a>home</a></div><ul id=menu><li>one<li>two</ul><div><h2>Head &amp; tail</h2>"
        "<p>First   long paragraph of the text,<br>that goes on.<p>Short.<blockquote>Quoted &#233; and more of it to be read</blockquote></div>"
        "<section class=\"comments\"><p>first! a comment that is rather long and should not be here at all, should it</section>"
        "<form><input><button>Send</button></form><div class='cookie-notice'>We use cookies</div><footer>end</footer></body>"
    )
    assert html_text.main_text(page) == "Head & tail\nFirst long paragraph of the text, that goes on.\nShort.\nQuoted é and more of it to be read"
    assert html_text.main_text(None) == html_text.main_text("") == html_text.main_text("<script>x") == ""


MUCH = ("A long text that goes on and on. " * 20).strip()


@pytest.mark.parametrize("page, text", [
    (f"<body><p class=notice>cut<p>{MUCH}</p><p>more</p></body>", f"{MUCH}\nmore"),
    (f"<article><ul><li class=ad>cut<li>{MUCH}<li>more</ul><p>end</article>", f"{MUCH}\nmore\nend"),
    (f"<dl><dt>a<dd class=promo>cut<dt>{MUCH}<dd>more</dl>", f"a\n{MUCH}\nmore"),
    (f"<table><tr><td class=sidebar>cut<td>{MUCH}</table>", MUCH),
    (f"<body><div class='content has-sidebar'><article>{MUCH}</article><div class=ad>cut</div></div><div>cut</div></body>", MUCH),
    (f"<body><div id='page-with-header'><p>{MUCH}</p><div class=ad>cut</div></div></body>", MUCH),
    (f"<body><form><div>{MUCH}</div><nav>cut</nav></form></body>", MUCH),
    (f"<main><article>{MUCH}</article><div class=comments-area><article class=comment-body>cut</article></div></main>", MUCH),
    ("<nav>cut</nav><footer>cut</footer>", ""),
    (f"<article><h2 class='section-header'>Head</h2><p>{MUCH}</p></article>", f"Head\n{MUCH}"),
    (f"<article><p>{MUCH}</p><p class='social'>Social life</p><p class='ad big'>cut</p></article>", f"{MUCH}\nSocial life"),
    (f"<article><p>{MUCH}</p><p>so <math><mi>x</mi><mo>=</mo><mn>1</mn></math> holds</p></article>", f"{MUCH}\nso x=1 holds"),
    (f"<header>cut</header><article><header class=entry-header><h1>Title</h1></header><p>{MUCH}</p></article>", f"Title\n{MUCH}"),
    (f"<main><p>{MUCH}</p></main><section><h3>cut</h3><article>cut one</article><article>cut two</article></section>", MUCH),
    (f"<div><article>{MUCH}</article><article class=comment>cut</article><article>cut</article></div>", MUCH),
    (f"<div><article>one {MUCH}</article><article>two {MUCH}</article></div>", f"one {MUCH}\ntwo {MUCH}"),
    (f"<div><article><p>{MUCH}</div><div>cut</div>", MUCH),
    ("<article></article><p>only</p>", "only"),
])
def test_html_parts_end_where_html_says_and_never_hold_the_article(page, text):
    assert html_text.main_text(page) == text


@pytest.mark.parametrize("page, text", [
    (f"<body><div><p>short lead</p><div class=ad>cut</div><p>{MUCH}</p></div></body>", f"short lead\n{MUCH}"),
    (f"<body><div><section>short</section><section>{MUCH}</section><section>tail</section></div></body>", f"short\n{MUCH}\ntail"),
    (f"<body><section>short</section><section><section>one</section><section>{MUCH}</section></section></body>", f"short\none\n{MUCH}"),
    (f"<div><p>intro</p><table><tr><td>{MUCH}</table><form>cut</form><p>out</p></div>", f"intro\n{MUCH}\nout"),
    (f"<body><div><div>short lead</div><aside>cut</aside><div>{MUCH}</div></div></body>", f"short lead\n{MUCH}"),
    (f"<body><div>logged in</div><form>cut</form><div><p>{MUCH}</p></div><footer>cut</footer></body>", MUCH),
])
def test_html_borders_in_a_container_do_not_split_the_article(page, text):
    assert html_text.main_text(page) == text


def test_mined_urls_block(spark):
    rows = [(f"http://a{i}.casino-win.net/en/{i}", 0) for i in range(40)] + [(f"http://b{i}.fine.net/en/{i}", 1) for i in range(160)] + [("http://c.net/x", None)]
    labelled = spark.createDataFrame(rows, "url string, label int")
    mined = url_filter.fit(labelled)
    assert mined.best(["h:casino", "h:win", "p:en"])[0] and mined.best(["h:fine", "p:en"]) == (None, None)
    pages = spark.createDataFrame([(1, "http://z.casino-win.net/de/1"), (2, "https://z.fine.net/"), (3, None), (4, "HTTP://A.ORG"), (5, "http://x.org/a?b")], "page_id bigint, url string")
    got = {r["id"]: (r["host"], r["path"], r["rule"], r["verdict"]) for r in url_filter.judge(pages, queries.URL_RULES, mined).collect()}
    assert got == {
        1: ("z.casino-win.net", "/de/1", None, "block"), 2: ("z.fine.net", "/", None, "allow"), 3: ("", "", None, "allow"),
        4: ("a.org", "", None, "allow"), 5: ("x.org", "/a", "org/", "allow"),
    }


def test_urls_are_mined_beside_a_very_common_one_and_among_mostly_bad_ones(spark):
    names = spark.createDataFrame([(f"http://hot{i}.net/x",) for i in range(300)], "url string")
    # The one whose copies all come first in the order of the url's hash.
    hot = names.orderBy(queries.F.xxhash64(queries.F.lit(None).cast("string"), "url")).first()["url"]
    rows = [(hot, 1)] * 1000 + [(f"http://a{i}.casino-win.net/{i}", 0) for i in range(500)] + [(f"http://b{i}.fine.net/{i}", 1) for i in range(500)]
    labelled = spark.createDataFrame([(i, *r) for i, r in enumerate(rows)], "page_id bigint, url string, label int")
    assert url_filter.fit(labelled, train_rows=400, id_col="page_id").best(["h:casino", "h:win"])[0]
    rows = [(f"http://a{i}.casino-win.net/{i}", 0) for i in range(160)] + [(f"http://b{i}.fine.net/{i}", 1) for i in range(40)]
    mined = url_filter.fit(spark.createDataFrame(rows, "url string, label int"))
    assert mined.best(["h:casino", "h:win"])[0] and mined.best(["h:fine", "h:net"]) == (None, None)


def test_rules_find_a_planted_fault(spark):
    rng = np.random.default_rng(3)
    n = 1200
    table = {"symbol_share": rng.random(n), "mark_share": rng.random(n), "n_words": rng.integers(50, 900, n).astype(float)}
    bad = (table["symbol_share"] > 0.8) & (table["mark_share"] > 0.5)
    rules = quality_rules.learn_rules(table, bad)
    hit = np.zeros(n, bool)
    for rule in rules:
        hit |= quality_rules.covered(rule, table, n)
    assert (hit & bad).sum() > 0.85 * bad.sum() and (hit & ~bad).sum() < 0.1 * bad.sum()
    assert quality_rules.learn_rules(table, np.zeros(n, bool)) == []


def test_similar_spot_sets_by_hand(spark, small):
    docs = queries.table(spark, small, "documents")
    sets = {}
    for r in spot_signatures.set_members(docs).collect():
        key = frozenset(r["found"])
        sets[key] = min(r["id"], sets.get(key, r["id"]))
    names = sorted((i, s) for s, i in sets.items() if s)
    expected = {(a, b) for k, (b, sb) in enumerate(names) for a, sa in names[:k] if len(sa & sb) >= 0.75 * len(sa | sb)}
    found = spot_signatures.similar_sets(docs).collect()
    assert {(r["a"], r["b"]) for r in found} == expected and len(found) == len(expected)


def test_similar_spot_sets_part_by_part(spark, small):
    docs = queries.table(spark, small, "documents")
    whole = sorted(spot_signatures.similar_sets(docs).collect())
    assert whole and sorted(spot_signatures.similar_sets(docs, part=2).collect()) == whole


def test_a_long_url_that_comes_often_is_mined(spark):
    words = "/".join(f"word{i}" for i in range(40))
    rows = [(f"http://long.casino-win.net/{words}", 0)] * 50 + [(f"http://a{i}.fine.net/{i}", 1) for i in range(200)]
    mined = url_filter.fit(spark.createDataFrame(rows, "url string, label int"))
    assert mined.best(["h:casino", "h:long", "h:win", "p:word0"])[0] and mined.best(["h:fine", "h:net"]) == (None, None)


def test_budgets_of_long_lengths_are_met_as_near_as_can_be():
    assert mixing._words(mixing.fit_counts({300007: 3, 400009: 2, 500011: 2, 700001: 1}, 1_100_020)) == 1_100_010
    rng = np.random.default_rng(6)
    for _ in range(60):
        counts = {int(s): int(n) for s, n in zip(rng.integers(1, 90, 5) * int(rng.integers(1, 2000)), rng.integers(1, 6, 5))}
        total = sum(s * n for s, n in counts.items())
        budget = int(rng.integers(0, total + 1))
        sums = {0}
        for s, n in counts.items():
            sums = {a + s * k for a in sums for k in range(n + 1)}
        taken = mixing.fit_counts(counts, budget)
        assert all(0 <= n <= counts[s] for s, n in taken.items()) and mixing._words(taken) == max(a for a in sums if a <= budget)


def test_families_of_long_sets_are_cut_by_their_shingles(spark, small, monkeypatch):
    docs = queries.table(spark, small, "documents")
    whole = sorted(map(repr, ngram_join.similar_groups(docs).collect()))
    monkeypatch.setattr(ngram_join, "PART_SHINGLES", 300)
    assert sorted(map(repr, ngram_join.similar_groups(docs).collect())) == whole


def test_pipeline_stages_on_awkward_rows(spark, odd, empty, labels, tmp_path, monkeypatch):
    pipeline = pytest.importorskip("corpus_pipeline")
    labels.write.parquet(str(tmp_path / "labels.parquet"))
    shape = "doc_id bigint, text string, lang string, source string, n_chars bigint, id string, stats string"
    for given in (odd, empty):
        docs = given.selectExpr("doc_id", "text", "'en' AS lang", "source", "CAST(0 AS BIGINT) AS n_chars", "id", "'s' AS stats").to(spark.createDataFrame([], shape).schema)
        for name, stage in pipeline.STAGES:
            before, docs = docs, staged(stage(spark, docs, str(tmp_path)), "odd-stage")
            assert docs.columns == before.columns or name == "bpe"
        assert given is odd or docs.count() == 0
