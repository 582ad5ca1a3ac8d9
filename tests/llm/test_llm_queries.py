"""The queries of the text operators against plain Python over whole small tables."""

import collections
import hashlib
import re
import zlib

import numpy as np
import pytest
from tokenizers import Tokenizer

pytest.importorskip("colonnade.llm.queries")
from colonnade.llm import html_text, mixing, queries, spot_signatures  # noqa: E402

WORD = re.compile(r"[^\x20\x09-\x0D]+")
LOWER = str.maketrans("ABCDEFGHIJKLMNOPQRSTUVWXYZ", "abcdefghijklmnopqrstuvwxyz")


def sha(data):
    return hashlib.sha256(data.encode() if isinstance(data, str) else data).hexdigest()


@pytest.fixture(scope="module")
def texts(spark, medium):
    return {r["doc_id"]: r["text"] or "" for r in queries.table(spark, medium, "documents").select("doc_id", "text").collect()}


@pytest.fixture(scope="module")
def result(spark, medium):
    kept = {}

    def of(name, key="doc_id"):
        if name not in kept:
            rows = queries.REGISTRY[name](spark, medium).collect()
            kept[name] = {r[key]: r for r in rows}
            assert len(rows) == len(kept[name])
        return kept[name]

    return of


def test_op1_removes_what_a_smaller_document_has(texts, result):
    found, first = result("op1_suffix_dedup"), {}
    assert found.keys() == texts.keys()
    for doc in sorted(texts):
        raw = texts[doc].encode()
        covered = bytearray(len(raw))
        for p in range(len(raw) - 49):
            if first.setdefault(raw[p:p + 50], doc) < doc:
                covered[p:p + 50] = b"\1" * 50
        spans = sum(1 for i, c in enumerate(covered) if c and not (i and covered[i - 1]))
        rest = bytes(b for b, c in zip(raw, covered) if not c)
        row = found[doc]
        assert (row["n_bytes"], row["n_removed"], row["n_spans"], row["kept_sha256"]) == (len(raw), sum(covered), spans, sha(rest)), doc


def rule_by_hand(host, path):
    best = None
    for says, h, p in queries.URL_RULES:
        if (host == h or host.endswith("." + h)) and path.startswith(p) and (best is None or len(h + p) > len(best[1])):
            best = says, h + p
    return best


def test_op2_rules(spark, medium, result):
    found = result("op2_url_filter", "page_id")
    pages = {r["page_id"]: r["url"] for r in queries.table(spark, medium, "pages").collect()}
    assert found.keys() == pages.keys()
    for page, url in pages.items():
        rest = url.split("://", 1)[1] if "://" in url else ""
        host = re.split(r"[/?#]", rest, maxsplit=1)[0]
        path = re.split(r"[?#]", rest[len(host):], maxsplit=1)[0]
        row, best = found[page], rule_by_hand(host.translate(LOWER), path)
        assert (row["host"], row["path"], row["rule"]) == (host.translate(LOWER), path, best[1] if best else None)
        assert row["verdict"] == (best[0] if best else "block" if row["mined_rule"] else "allow")


def test_op3_links_all_pairs(texts, result):
    found, sets = result("op3_ngram_join"), {}
    for doc, text in texts.items():
        words = WORD.findall(text.translate(LOWER))
        windows = [tuple(words[i:i + 5]) for i in range(len(words) - 4)] if len(words) >= 5 else [tuple(words)] * bool(words)
        sets[doc] = frozenset(windows)
    up = {d: d for d in sets}

    def find(d):
        while up[d] != d:
            d = up[d]
        return d

    holders, common = collections.defaultdict(list), collections.Counter()
    for doc in sorted(sets):
        for window in sets[doc]:
            for other in holders[window]:
                common[other, doc] += 1
            holders[window].append(doc)
    for (a, b), n in common.items():
        if 100 * n >= 75 * (len(sets[a]) + len(sets[b]) - n):
            a, b = find(a), find(b)
            up[max(a, b)] = min(a, b)
    for doc in sets:
        assert (found[doc]["n_shingles"], found[doc]["component_id"]) == (len(sets[doc]), find(doc)), doc


def base_by_hand(text):
    words = WORD.findall(text)
    windows = collections.defaultdict(list)
    for i in range(len(words) - 2):
        windows[tuple(words[i:i + 3])].append(i)
    repeated = {i + k for at in windows.values() if len(at) > 1 for i in at for k in range(3)}
    seen, duplicates = set(), 0
    for line in text.split("\n"):
        if WORD.search(line):
            duplicates += line in seen
            seen.add(line)
    return len(words), sum(map(len, words)), len(re.findall(r"[#*$%&|<>]", text)), duplicates, len(repeated)


def test_op4_statistics_and_verdicts(spark, medium, texts, result):
    found = result("op4_quality_rules")
    labels = {r["doc_id"]: r["quality"] for r in queries.table(spark, medium, "labels").collect()}
    right = collections.Counter()
    for doc, text in texts.items():
        row, base = found[doc], base_by_hand(text)
        assert (row["n_words"], row["word_chars"], row["n_symbols"], row["n_dup_lines"], row["n_repeat_words"]) == base, doc
        assert row["base_failed"] == (base[0] < 50 or 100 * base[4] > 50 * base[0])
        assert not (row["base_failed"] and row["kept"])
        if doc in labels and not row["base_failed"]:
            right[labels[doc], row["kept"]] += 1
    assert right[1, False] <= 0.02 * (right[1, False] + right[1, True])


def test_op5_finds_toxic_rows_it_never_saw(spark, medium, texts, result):
    found = result("op5_toxicity")
    assert found.keys() == texts.keys()
    assert all(0 <= r["score"] <= 1 and r["predicted"] == (r["score"] >= 0.5) for r in found.values())
    assert all(r["held_out"] == (zlib.crc32(str(d).encode()) % 5 == 0) for d, r in found.items())
    held = [(r["toxic"], found[r["doc_id"]]["score"]) for r in queries.table(spark, medium, "labels").collect() if found[r["doc_id"]]["held_out"]]
    toxic, clean = ([s for t, s in held if t == k] for k in (1, 0))
    above = np.mean([[(t > c) + 0.5 * (t == c) for c in clean] for t in toxic])
    assert above > 0.95
    assert np.mean([s >= 0.5 for s in clean]) < 0.02


def test_op6_meets_targets(spark, medium, texts, result):
    found = result("op6_mixing")
    source = {r["doc_id"]: r["source"] for r in queries.table(spark, medium, "documents").select("doc_id", "source").collect()}
    size = {d: len(WORD.findall(t)) for d, t in texts.items()}
    totals = collections.Counter()
    for d, n in size.items():
        totals[source[d]] += n
    names = sorted(totals, key=lambda s: (s is None, (s or "").encode()))
    weight = {s: (3, 1, 2)[i % 3] for i, s in enumerate(names)}
    capped: dict = {}
    while True:
        free = [s for s in names if s not in capped]
        unit = (1.5 * sum(totals.values()) - sum(capped.values())) / sum(weight[s] for s in free)
        over = {s: 2.0 * totals[s] for s in free if unit * weight[s] > 2 * totals[s]}
        if not over:
            break
        capped |= over
    target = {s: capped.get(s, unit * weight[s]) for s in names}
    taken = collections.Counter()
    for d, row in found.items():
        assert row["size"] == size[d] and row["source_size"] == totals[source[d]]
        assert row["target"] == pytest.approx(target[source[d]])
        assert row["taken"] in (0, size[d], 2 * size[d])
        taken[source[d]] += row["taken"]
    for s in names:
        assert abs(taken[s] - target[s]) <= max(1, 0.001 * target[s]), s


def test_op7_keeps_first_lines(texts, result):
    found, first = result("op7_line_dedup"), {}

    def key(line):
        k = line.strip(" \t\n\v\f\r").translate(LOWER)
        return k if len(k) >= 10 else None

    for doc in sorted(texts):
        lines = texts[doc].split("\n")
        kept = [x for x in lines if key(x) is None or first.setdefault(key(x), doc) == doc]
        row = found[doc]
        assert (row["n_lines"], row["n_dropped"], row["kept_sha256"]) == (len(lines), len(lines) - len(kept), sha("\n".join(kept))), doc


def signatures_by_hand(text):
    words = re.findall(r"[^\W_]+", text.lower())
    anchors = set(spot_signatures.ANCHORS)
    content, before, found, waiting = [], [], set(), []
    for w in words:
        if w in anchors:
            waiting.append(w)
        else:
            content.append(w)
            before.append(waiting)
            waiting = []
    content = content or words
    if not any(before):
        before = [[""]] * len(content)
    for i, anchors_here in enumerate(before):
        found |= {(a, *content[i:i + spot_signatures.CHAIN]) for a in anchors_here}
    return found


def test_op8_fingerprints(texts, result):
    found = result("op8_spot_signatures")
    down = sorted(texts, reverse=True)
    likeness = lambda a, b: 1.0 if not a and not b else len(a & b) / len(a | b)
    prints = collections.defaultdict(set)
    for i, doc in enumerate(down):
        text, following = texts[doc], texts[down[(i + 1) % len(down)]]
        half = len(text) // 2
        edited = text[:len(text) - half] + following[:half]
        row = found[doc]
        assert (row["n_chars"], row["edited_sha256"]) == (len(text), sha(edited))
        mine = signatures_by_hand(text)
        assert row["near_edited"] == pytest.approx(likeness(mine, signatures_by_hand(edited))), doc
        assert row["near_next"] == pytest.approx(likeness(mine, signatures_by_hand(following))), doc
        prints[text].add(row["fingerprint"])
    assert all(len(p) == 1 for p in prints.values())


def test_op9_finds_the_article(spark, medium, texts, result):
    found = result("op9_html_text", "page_id")
    for page in queries.table(spark, medium, "pages").collect():
        row = found[page["page_id"]]
        body = page["html"].split("<article>", 1)[1].split("</article>", 1)[0]
        import html
        words = html.unescape(re.sub(r"<[^>]*>", " ", body)).split()
        assert row["text"].split() == words and row["n_chars"] == len(row["text"])
        assert not any(line != " ".join(line.split()) or not line for line in row["text"].split("\n"))
        # The same page without the element that names the article: the windows alone find it.
        bare = re.sub(r"<(/?)(?:article|main)\b[^>]*>", r"<\1div>", page["html"])
        assert html_text.main_text(bare) == row["text"]


def test_op10_equals_the_library(texts, result):
    library = Tokenizer.from_file(queries.vocabulary_path())
    library.no_truncation()
    library.no_padding()
    found = result("op10_bpe")
    docs = sorted(texts)
    for doc, coded in zip(docs, library.encode_batch([texts[d] for d in docs], add_special_tokens=False)):
        row = found[doc]
        raw = np.array(coded.ids, "<u4").tobytes()
        assert (row["n_tokens"], row["ids_sha256"]) == (len(coded.ids), sha(raw)), doc
        assert row["decoded_sha256"] == sha(library.decode(coded.ids, skip_special_tokens=False))


def test_counts_hit_any_reachable_budget():
    assert mixing.fit_counts({3: 2, 5: 1}, 8) == {3: 1, 5: 1}
    assert mixing.fit_counts({4: 10}, 7) == {4: 1}
    assert mixing.fit_counts({4: 2}, 100) == {4: 2}
    rng = np.random.default_rng(5)
    counts = {int(s): int(n) for s, n in zip(rng.integers(1, 4000, 300), rng.integers(1, 50, 300))}
    budget = sum(s * n for s, n in counts.items()) // 3
    taken = mixing.fit_counts(counts, budget)
    assert sum(s * n for s, n in taken.items()) == budget
    assert all(n <= counts[s] for s, n in taken.items())
