import random
import re

import numpy as np
import pytest

from loamgraph.llm import leakage as lk

WORDS = [f"w{i}" for i in range(40)]


@pytest.mark.parametrize("seed", range(4))
def test_index_against_search(seed):
    r = np.random.default_rng(seed)
    seq = np.concatenate([np.concatenate([r.integers(1, 6, r.integers(0, 60)), [0]]) for _ in range(8)]).astype(np.int64)
    if seed == 3:
        seq = np.tile(np.array([2, 3, 0]), 20)
    order = lk.suffix_array(seq)
    ring = np.concatenate([seq, seq])
    assert [tuple(ring[i : i + len(seq)]) for i in order] == sorted(tuple(ring[i : i + len(seq)]) for i in range(len(seq)))
    index = lk.FMIndex(seq, 6, sample=4)
    phrases = np.array([[a, b, c] for a in range(1, 6) for b in range(1, 6) for c in range(1, 6)])
    low, high = index.search(phrases)
    for p, a, b in zip(phrases, low, high, strict=True):
        want = [i for i in range(len(seq) - 2) if (seq[i : i + 3] == p).all()]
        assert sorted(index.locate(np.arange(a, b))) == want


def brute(match):
    n = len(match)
    hit = np.zeros(n, bool)
    for i in range(n):
        for j in range(i + 1, n + 1):
            bad = (~match[i:j]).sum()
            if j - i >= lk.EXACT and not bad or j - i >= lk.LOOSE and bad * lk.REPLACED <= j - i:
                hit[i:j] = True
    return hit


@pytest.mark.parametrize("seed", range(30))
def test_passages(seed):
    r = np.random.default_rng(seed)
    match = r.random(r.integers(1, 90)) < r.choice([0.5, 0.85, 0.9, 0.97])
    assert bool(lk.passages(match)) == brute(match).any()
    covered = np.zeros(len(match), bool)
    for a, b in lk.passages(match):
        covered[a:b] = True
    # loose ends: a passage's edge may be a replaced word, which spans leave out at the front
    assert not (covered & ~brute(match)).any()


def test_words_undo_markup_and_form():
    want = "zum straße flow ninetysix its 5".split()
    for text in ("Zum Straße flow, ninety-six it's 5", "<p>ZUM</p><b>Stra</b>sse fl&#111;w &amp; **ninety-six** it’s 5", "zum stra­ße ﬂow ninety‑six it's​ 5", "zum\\nstra\\u00dfe fl%6Fw ninety-six it's 5", "ｚｕｍ straße flow <br/>ninety-six its 5"):
        assert lk.words(text) == [w.replace("ß", "ss") for w in want], text
    assert lk.words(None) == [] and lk.words("  ") == []


def item_texts(r, n=12):
    return [(100 + i, " ".join(r.choice(WORDS) + str(i % 3) for _ in range(r.randint(40, 80)))) for i in range(n)]


def test_planted_leaks(spark):
    r = random.Random(3)
    items = item_texts(r)
    docs, want = [], set()
    for d in range(150):
        noise = [r.choice(WORDS) for _ in range(r.randint(0, 60))]
        i, text = r.choice(items)
        w = text.split()
        kind = d % 6
        if kind == 0:
            part = w
        elif kind == 1:
            a = r.randrange(len(w) - 15)
            part = w[a : a + 15]
        elif kind == 2:
            a, n = 0, r.randint(32, len(w))
            part = w[a : a + n]
            for k in r.sample(range(n), n // 8):
                part[k] = "zzz"
        elif kind == 3:
            a = r.randrange(len(w) - 12)
            part = w[a : a + 12]
        elif kind == 4:
            part = [x if k % 4 else "zzz" for k, x in enumerate(w)]
        else:
            part = r.sample(w, len(w))
        if kind < 3:
            want.add((d, i))
        docs.append((d, " ".join(noise + part + noise), "x"))
    docs += [(900, None, "x"), (901, "", "x"), (902, docs[0][1], "x"), (903, "q " * 30_000 + items[0][1], "x")]
    want |= {(902, next(i for d, i in want if d == 0)), (903, items[0][0])}
    df = spark.createDataFrame(docs, "doc_id long, text string, item_id string")
    it = spark.createDataFrame([*items, (1, None), (2, "too short")], "item_id long, text string")
    leaks = lk.find_leaks(df, it)
    assert {(x.doc_id, x.item_id) for x in leaks.collect()} == want
    spans = lk.removal_spans(leaks).collect()
    assert all(s.first_word < s.end_word for s in spans) and {s.doc_id for s in spans} == {d for d, _ in want}
    raw = {d: text for d, text, _ in docs}
    for s in spans:
        assert lk.words(raw[s.doc_id][s.first_char : s.end_char]) == lk.words(raw[s.doc_id])[s.first_word : s.end_word]


def test_short_items_are_found_whole(spark):
    r = random.Random(9)
    items = [(n, " ".join(f"s{n}x{k}" for k in range(n))) for n in (1, 2, 5, 6, 7, 14, 15)]
    items += [(50, "s5x0 s5x1"), (60, "s6x0 s6x0"), (70, "?!")]
    docs = []
    for n, text in items[:7]:
        w = text.split()
        for part in (w, w[:-1], w[1:], [*w[:-1], "zzz"], w[::-1], [*w, "zzz", *w]):
            noise = [r.choice(WORDS) for _ in range(r.randint(0, 9))]
            docs.append((len(docs), " ".join(noise + part + noise), "x"))
    docs += [(len(docs), "ends s2x0", "x"), (len(docs) + 1, "s2x1 begins", "x")]
    want = set()
    for d, text, _ in docs:
        x = lk.words(text)
        for i, t in items:
            w = lk.words(t)
            want |= {(d, i, p, p + len(w)) for p in range(len(x) - len(w) + 1) if w and x[p : p + len(w)] == w}
    assert {i for _, i, *_ in want} == {1, 2, 5, 6, 7, 14, 15, 50}
    leaks = lk.find_leaks(spark.createDataFrame(docs, "doc_id long, text string, item_id string"), spark.createDataFrame(items, "item_id long, text string"))
    assert {tuple(x)[:4] for x in leaks.collect()} == want


def test_whole_items_by_an_independent_rule(spark):
    """Own normaliser and own rule: an item is a substring of the text between two blanks."""
    plain = lambda t: " " + " ".join("".join(c if c.isalnum() else " " for c in re.sub(r"<[^>]*>", "", t).lower()).split()) + " "
    r = random.Random(21)
    items = [(n * 10 + k, " ".join(r.choice(WORDS) for _ in range(n))) for n in (3, 8, 14) for k in range(6)]
    docs = []
    for d in range(400):
        w = [r.choice(WORDS) for _ in range(r.randint(0, 40))]
        part = r.choice(items)[1].split()
        if d % 4 == 1:
            part = [x.upper() + "," for x in part]
        elif d % 4 == 2:
            part = [f"<b>{x}</b>" for x in part]
        elif d % 4 == 3:
            part[r.randrange(len(part))] = "other"
        docs.append((d, " ".join([*w, *part, *w])))
    want = {(d, i) for d, t in docs for i, x in items if plain(x) in plain(t)}
    assert len(want) >= 300
    leaks = lk.find_leaks(spark.createDataFrame(docs, "doc_id long, text string"), spark.createDataFrame(items, "item_id long, text string"))
    raw, texts = dict(docs), dict(items)
    got = leaks.collect()
    assert {(x.doc_id, x.item_id) for x in got} == want
    assert all(plain(raw[x.doc_id][x.first_char : x.end_char]) == plain(texts[x.item_id]) for x in got)


@pytest.mark.parametrize("seed", range(20))
def test_located_words_are_the_words(seed):
    r = random.Random(seed)
    bits = ["ß", "É", "a&amp;amp;b", "<b>", "</p>", "<!-- x -->", "<!-- open", "\\n", "\\u00e9", "%41", "=\n", "-", "’", "\u00ad", "ﬃ", "İ", " ", "x", "Zug", "&eacute;", "&lt;i&gt;", "é", "<a title='" + "y" * 900 + "'>"]
    for _ in range(40):
        text = "".join(r.choice(bits) for _ in range(r.randint(0, 30)))
        located = lk.located_words(text)
        assert [w for w, _, _ in located] == lk.words(text)
        assert all(0 <= a < b <= len(text) for _, a, b in located)


def test_long_markup_inside_a_passage(spark):
    w = [f"u{i}" for i in range(20)]
    inside = [(1, " ".join(w[:10]) + f" <a href='{'x' * 5000}'>" + " ".join(w[10:])), (2, " ".join(w[:10]) + f" <!-- {'y ' * 3000}--> " + " ".join(w[10:]))]
    got = lk.find_leaks(spark.createDataFrame(inside, "doc_id long, text string"), spark.createDataFrame([(7, " ".join(w))], "item_id long, text string"))
    assert {(x.doc_id, x.first_word, x.end_word) for x in got.collect()} == {(1, 0, 20), (2, 0, 20)}


def test_blocks_and_chunks_do_not_matter(monkeypatch):
    r = random.Random(8)
    rows = item_texts(r)
    docs = [(d, lk.words(" ".join(r.choice(WORDS) for _ in range(9)) + " " + r.choice(rows)[1])) for d in range(40)]
    whole = sorted(lk.Items(rows).search_shard(docs))
    monkeypatch.setattr(lk, "EXPANDED", 7)
    assert len(whole) >= 40 and sorted(lk.Items(rows, block=3).search_shard(docs)) == whole


def test_shards_do_not_matter(spark, monkeypatch):
    r = random.Random(5)
    items = lk.Items(item_texts(r))
    docs = [(d, lk.words(" ".join(r.choice(WORDS) for _ in range(50)) + " " + " ".join(r.choice(WORDS) + "0" for _ in range(20)))) for d in range(30)]
    whole = items.search_shard(docs)
    assert sorted((docs[d][0], *x) for d, *x in whole) == sorted((i, *x) for i, w in docs for _, *x in items.search_shard([(i, w)]))


def test_empty(spark):
    df = spark.createDataFrame([], "doc_id long, text string")
    it = spark.createDataFrame([], "item_id long, text string")
    assert lk.find_leaks(df, it).count() == 0
    assert lk.find_leaks(spark.createDataFrame([(1, "a b c")], "doc_id long, text string"), it).count() == 0
