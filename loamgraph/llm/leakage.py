"""Evaluation texts leaking into training text (problem 8).

Each shard of the corpus gets an FM-index over words: a suffix array by prefix
doubling, its Burrows-Wheeler transform in a wavelet matrix with popcount
ranks, and suffix positions sampled every ``SAMPLE`` words.  All phrases of
``SEED`` words of the test items are searched backwards at once, occurrences are
located by walking to a sampled position, and hits on one diagonal of a
document and an item are checked word by word and merged to spans.

Why ``SEED`` = 6 loses nothing: an exact passage has 15 words, ten phrases of six;
of a passage of n >= 30 words with k <= n/8 replaced at least n - 5 - 6k >= 3
phrases stay whole.  So a diagonal with fewer than ``LEAST_SEEDS`` hits holds no
passage.  An item below ``EXACT`` words can only be held whole: from ``SEED`` words
its phrases find it, below that it is a phrase of its own length.

Words are compared after undoing markup, escapes, Unicode form and case; spans
are given in words and in characters of the raw text, so that they can be cut out.
A shard holds at most ``SHARD_WORDS`` words (or one document, if that is longer)
whatever the partition holds, so memory is bounded and nothing is shuffled.
Its index is built once; the test items, held-out material that a driver can
read, are searched in it in blocks of at most ``ITEM_BLOCK`` items.

Defined results: null or blank texts and items without a word match nothing;
an item below ``EXACT`` words is reported wherever all of it stands; repeated
documents are each reported; texts are read whole; markup is what HTML takes
for a tag or a comment, of any length.
"""

from __future__ import annotations

import html
import unicodedata
from collections.abc import Iterator

import numpy as np
import pandas as pd
import regex as re
from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

from loamgraph.session import spread

SEED, EXACT, LOOSE, REPLACED = 6, 15, 30, 8
LEAST_SEEDS = 3
SHARD_WORDS, SAMPLE, ITEM_BLOCK, EXPANDED = 1_000_000, 8, 20_000, 2_000_000

_TAG = re.compile(r"</?([a-zA-Z][a-zA-Z0-9]*+)[^<>]*+>")
_BLOCKS = set("p br div li ul ol h1 h2 h3 h4 h5 h6 td tr th table hr pre blockquote section article".split())
_ENTITY = re.compile(r"&(?:#[0-9]+;?|#[xX][0-9a-fA-F]+;?|[^\t\n\f <&#;]{1,32};?)")
_ESCAPE = re.compile(r"\\u\{([0-9a-fA-F]{1,6})\}|\\u([0-9a-fA-F]{4})|\\x([0-9a-fA-F]{2})|\\([nrt])|\\(.)|%([2-7][0-9a-fA-F])|=\n")
_JOINT = re.compile(r"(?<=\p{L})[-‐‑‒–](?=\p{L})")
_WORD = re.compile(r"[\p{L}\p{M}\p{N}]+")
_DROP = dict.fromkeys([0xAD, 0x200B, 0x200C, 0x200D, 0x2060, 0xFEFF, 0x27, 0x2019, 0x2BC, 0x60, 0xB4])


def _unescape(m: re.Match) -> str:
    wide, u, x, ws, other, pct = m.groups()
    code = wide or u or x or pct
    if code:
        return chr(int(code, 16)) if int(code, 16) < 0x110000 and not 0xD800 <= int(code, 16) < 0xE000 else " "
    return " " if ws else other or ""


def _without_comments(text: str) -> list[tuple[int, int]]:
    """The stretches outside comments; one that is never closed is no comment."""
    out, at = [], 0
    while (begin := text.find("<!--", at)) >= 0 and (end := text.find("-->", begin + 4)) >= 0:
        out.append((at, begin))
        at = end + 3
    return [*out, (at, len(text))]


def _tag(m: re.Match) -> str:
    return " " if m[1].lower() in _BLOCKS else ""


def _plain(c: str) -> str:
    return "".join(x for x in unicodedata.normalize("NFKD", c) if not unicodedata.combining(x))


def words(text: str | None) -> list[str]:
    """Comparable words: markup, escapes, Unicode form, case and punctuation undone; hyphens join."""
    if not text:
        return []
    if "&" in text:
        text = html.unescape(html.unescape(text))
    if "<" in text:
        text = _TAG.sub(_tag, "".join(text[a:b] for a, b in _without_comments(text)))
    if "\\" in text or "%" in text or "=\n" in text:
        text = _ESCAPE.sub(_unescape, text)
    if not text.isascii():
        text = _plain(text)
    return _WORD.findall(_JOINT.sub("", text.translate(_DROP)).casefold())


class _Traced:
    """A text under change with the raw stretch that each of its characters comes from."""

    def __init__(self, text: str):
        self.text, self.first, self.end = text, list(range(len(text))), list(range(1, len(text) + 1))

    def pieces(self, parts: list[tuple[int, int, str | None]]) -> None:
        """New text from parts (begin, end, replacement or None to keep)."""
        text, first, end = [], [], []
        for a, b, new in parts:
            if new is None:
                text.append(self.text[a:b])
                first += self.first[a:b]
                end += self.end[a:b]
            elif new:
                text.append(new)
                first += [self.first[a]] * len(new)
                end += [self.end[b - 1]] * len(new)
        self.text, self.first, self.end = "".join(text), first, end

    def sub(self, pattern: re.Pattern, new) -> None:
        parts, at = [], 0
        for m in pattern.finditer(self.text):
            parts += [(at, m.start(), None), (*m.span(), new(m))]
            at = m.end()
        self.pieces([*parts, (at, len(self.text), None)])

    def each(self, new) -> None:
        self.pieces([(i, i + 1, new(c)) for i, c in enumerate(self.text)])


def located_words(text: str) -> list[tuple[str, int, int]]:
    """``words`` with the raw characters (begin, end) of each; for texts with a hit only, as it is slow."""
    t = _Traced(text)
    if "&" in t.text:
        for _ in range(2):
            t.sub(_ENTITY, lambda m: html.unescape(m[0]))
    if "<" in t.text:
        t.pieces([(a, b, None) for a, b in _without_comments(t.text)])
        t.sub(_TAG, _tag)
    if "\\" in t.text or "%" in t.text or "=\n" in t.text:
        t.sub(_ESCAPE, _unescape)
    if not t.text.isascii():
        t.each(_plain)
    t.each(lambda c: c.translate(_DROP))
    t.sub(_JOINT, lambda m: "")
    t.each(str.casefold)
    return [(m[0], t.first[m.start()], t.end[m.end() - 1]) for m in _WORD.finditer(t.text)]


class FMIndex:
    """Full-text index of an integer sequence whose symbols lie in [0, size)."""

    def __init__(self, seq: np.ndarray, size: int, sample: int = SAMPLE):
        self.n, self.size = len(seq), size
        order = suffix_array(seq)
        self.bwt = seq[order - 1]  # the text is taken as a ring; its last symbol is a separator
        self.first = np.concatenate([[0], np.cumsum(np.bincount(seq, minlength=size))])
        self.levels = max(1, int(size - 1).bit_length())
        self.words, self.ranks, self.zeros = [], [], []
        current = self.bwt
        for level in range(self.levels - 1, -1, -1):
            bit = (current >> level) & 1
            packed = np.packbits(bit.astype(np.uint8), bitorder="little")
            packed = np.concatenate([packed, np.zeros(-len(packed) % 8 + 8, np.uint8)]).view(np.uint64)
            self.words.append(packed)
            self.ranks.append(np.concatenate([[0], np.cumsum(np.bitwise_count(packed))]).astype(np.int64))
            self.zeros.append(self.n - int(bit.sum()))
            current = np.concatenate([current[bit == 0], current[bit == 1]])
        held = order % sample == 0
        marks = np.flatnonzero(held)
        self.mark = held
        self.mark_rows, self.mark_pos = marks, order[marks]

    def _ones(self, level: int, i: np.ndarray) -> np.ndarray:
        word, off = i >> 6, (i & 63).astype(np.uint64)
        below = self.words[level][word] & ((np.uint64(1) << off) - np.uint64(1))
        return self.ranks[level][word] + np.bitwise_count(below)

    def rank(self, symbol: np.ndarray, i: np.ndarray) -> np.ndarray:
        """Occurrences of each symbol before each row."""
        start = np.zeros_like(i)
        for k in range(self.levels):
            one = ((symbol >> (self.levels - 1 - k)) & 1).astype(bool)
            ones_i, ones_s = self._ones(k, i), self._ones(k, start)
            i = np.where(one, self.zeros[k] + ones_i, i - ones_i)
            start = np.where(one, self.zeros[k] + ones_s, start - ones_s)
        return i - start

    def search(self, phrases: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
        """Row ranges of all phrases (one a row of the matrix) by backward search."""
        low, high = np.zeros(len(phrases), np.int64), np.full(len(phrases), self.n, np.int64)
        live = np.arange(len(phrases))
        for k in range(phrases.shape[1] - 1, -1, -1):
            c = phrases[live, k]
            low[live] = self.first[c] + self.rank(c, low[live])
            high[live] = self.first[c] + self.rank(c, high[live])
            live = live[low[live] < high[live]]
        found = np.zeros(len(phrases), bool)
        found[live] = True
        return np.where(found, low, 0), np.where(found, high, 0)

    def locate(self, rows: np.ndarray) -> np.ndarray:
        """Text positions of rows: steps to the nearest sampled position before each."""
        rows, steps, out = rows.copy(), np.zeros(len(rows), np.int64), np.zeros(len(rows), np.int64)
        left = np.arange(len(rows))
        while len(left):
            hit = self.mark[rows[left]]
            done = left[hit]
            out[done] = (self.mark_pos[np.searchsorted(self.mark_rows, rows[done])] + steps[done]) % self.n
            left = left[~hit]
            c = self.bwt[rows[left]]
            rows[left] = self.first[c] + self.rank(c, rows[left])
            steps[left] += 1
        return out


def suffix_array(seq: np.ndarray) -> np.ndarray:
    """Order of all rotations by prefix doubling; equal rotations keep text order.

    Rotations equal over the whole length can only come from a periodic ring;
    doubling stops once the compared length covers it.
    """
    n = len(seq)
    rank = seq.astype(np.int64)
    order = np.argsort(rank, kind="stable")
    length = 1
    while True:
        s = rank[order]
        new = np.empty(n, np.int64)
        new[order] = np.concatenate([[0], np.cumsum(s[1:] != s[:-1])])
        rank = new
        if rank[order[-1]] == n - 1 or length >= n:
            return order
        key = rank * np.int64(n) + np.roll(rank, -length)
        order = np.argsort(key, kind="stable")
        rank = key
        length *= 2


def passages(match: np.ndarray) -> list[tuple[int, int]]:
    """Maximal leaked stretches of one diagonal's word matches."""
    n = len(match)
    out = []
    edge = np.flatnonzero(np.diff(np.concatenate([[0], match.astype(np.int8), [0]])))
    out += [(int(a), int(b)) for a, b in zip(edge[::2], edge[1::2], strict=True) if b - a >= EXACT]
    if n >= LOOSE:
        cost = np.concatenate([[0], np.cumsum(REPLACED * (~match).astype(np.int64) - 1)])
        best = np.maximum.accumulate(cost)  # a stretch (i, j] is loose enough if cost[j] <= cost[i]
        for j in np.flatnonzero(cost[LOOSE:] <= best[: n + 1 - LOOSE]) + LOOSE:
            i = int(np.searchsorted(best[: j + 1 - LOOSE], cost[j]))
            while i < j and not match[i]:
                i += 1
            out.append((i, int(j)))
    merged: list[tuple[int, int]] = []
    for a, b in sorted(out):
        if merged and a <= merged[-1][1]:
            merged[-1] = (merged[-1][0], max(b, merged[-1][1]))
        else:
            merged.append((a, b))
    return merged


class Block:
    """Phrases of some test items: one matrix a phrase length, and the places of each phrase in the items."""

    def __init__(self, rows: list[tuple[int, np.ndarray]]):
        self.ids, self.seqs = [i for i, _ in rows], [w for _, w in rows]
        grams: dict[int, dict[bytes, list[tuple[int, int]]]] = {}
        for k, seq in enumerate(self.seqs):
            size = min(SEED, len(seq))
            for off in range(len(seq) - size + 1):
                grams.setdefault(size, {}).setdefault(seq[off : off + size].tobytes(), []).append((k, off))
        self.phrases = []
        for size, g in grams.items():
            places = np.array([p for x in g.values() for p in x], np.int64).reshape(-1, 2)
            starts = np.concatenate([[0], np.cumsum([len(x) for x in g.values()])])
            self.phrases.append((np.frombuffer(b"".join(g), np.int64).reshape(-1, size), starts, places))

    def diagonals(self, index: FMIndex, where: np.ndarray, starts: np.ndarray) -> np.ndarray:
        """``(doc, item, shift)`` rows with enough hits, expanded a bounded number of hits at a time."""
        met = np.zeros((0, 3), np.int64)
        hits = np.zeros(0, np.int64)
        for grams, first, places in self.phrases:
            low, high = index.search(grams)
            found = np.flatnonzero(high > low)
            counts = high[found] - low[found]
            rows = np.repeat(low[found] - np.concatenate([[0], np.cumsum(counts)[:-1]]), counts) + np.arange(counts.sum())
            pos = where[index.locate(rows)]
            phrase = np.repeat(found, counts)
            if not len(phrase):
                continue
            held = first[phrase + 1] - first[phrase]
            cuts = np.searchsorted(np.cumsum(held), np.arange(EXPANDED, int(held.sum()) + EXPANDED, EXPANDED), side="right")
            for a, b in zip([0, *cuts[:-1]], cuts, strict=True):
                n = held[a:b]
                at = np.repeat(first[phrase[a:b]] - np.concatenate([[0], np.cumsum(n)[:-1]]), n) + np.arange(n.sum())
                doc = np.searchsorted(starts, pos[a:b], side="right") - 1
                shift = np.repeat(pos[a:b] - starts[doc], n) - places[at, 1]
                met = np.concatenate([met, np.stack([np.repeat(doc, n), places[at, 0], shift], axis=1)])
                hits = np.concatenate([hits, np.ones(len(at), np.int64)])
                met, back = np.unique(met, axis=0, return_inverse=True)
                hits = np.bincount(back.ravel(), weights=hits, minlength=len(met)).astype(np.int64)
        long = np.array([len(w) >= EXACT for w in self.seqs], bool)
        return met[(hits >= LEAST_SEEDS) | ~long[met[:, 1]]] if len(met) else met


class Items:
    """Test items as word numbers, in blocks; 0 separates documents, 1 is any word of no item."""

    def __init__(self, rows: list[tuple[int, str | None]], block: int = ITEM_BLOCK):
        self.vocab: dict[str, int] = {}
        numbered = []
        for item, text in rows:
            if w := words(text):
                numbered.append((item, np.array([self.vocab.setdefault(x, len(self.vocab) + 2) for x in w], np.int64)))
        self.blocks = [Block(numbered[i : i + block]) for i in range(0, len(numbered), block)]

    def search_shard(self, docs: list[tuple[int, list[str]]]) -> list[tuple[int, int, int, int]]:
        """``(document's place, item_id, first word, end word)`` of every leaked passage in a shard."""
        get = self.vocab.get
        starts, parts, at = [], [], 0
        for _, w in docs:
            starts.append(at)
            parts.append(np.fromiter((get(x, 1) for x in w), np.int64, len(w)))
            parts.append(np.zeros(1, np.int64))
            at += len(w) + 1
        if not at or not self.blocks:
            return []
        seq = np.concatenate(parts)
        starts = np.array(starts, np.int64)
        # runs of words of no item say nothing; one of them each keeps phrases from joining
        keep = np.concatenate([[True], (seq[1:] != 1) | (seq[:-1] != 1)])
        where = np.flatnonzero(keep)
        index = FMIndex(seq[keep], len(self.vocab) + 2)
        out = []
        for block in self.blocks:
            for d, k, shift in block.diagonals(index, where, starts).tolist():
                item, n = block.seqs[k], len(docs[d][1])
                a, b = max(0, -shift), min(len(item), n - shift)
                match = seq[starts[d] + shift + a : starts[d] + shift + b] == item[a:b]
                found = passages(match) if len(item) >= EXACT else [(0, len(item))] if len(match) == len(item) and match.all() else []
                out += [(d, block.ids[k], shift + a + i, shift + a + j) for i, j in found]
        return out


def _shards(frames: Iterator[pd.DataFrame]) -> Iterator[tuple[list[tuple[int, list[str]]], list[str]]]:
    """Documents as words, and their raw texts, a bounded number of words at a time."""
    shard, texts, size = [], [], 0
    for frame in frames:
        for i, t in zip(frame["doc_id"], frame["text"], strict=True):
            w = words(t)
            if size and size + len(w) > SHARD_WORDS:
                yield shard, texts
                shard, texts, size = [], [], 0
            shard.append((int(i), w))
            texts.append(t)
            size += len(w)
    if shard:
        yield shard, texts


SPAN = ["doc_id", "item_id", "first_word", "end_word", "first_char", "end_char"]


def find_leaks(documents: DataFrame, items: DataFrame, id_col: str = "doc_id", text_col: str = "text", item_col: str = "item_id", item_text: str = "text") -> DataFrame:
    """Removal spans ``SPAN``, in words and in characters of the raw text, merged per item and diagonal."""
    sc = documents.sparkSession.sparkContext
    kept = spread(documents.select(F.col(id_col).alias("doc_id"), F.col(text_col).alias("text")).where("text is not null"), "doc_id")
    shared = sc.broadcast(Items([(r[0], r[1]) for r in items.select(item_col, item_text).where(F.col(item_text).isNotNull()).toLocalIterator()]))

    def run(frames: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        for shard, texts in _shards(frames):
            rows, at, held = [], -1, []
            for d, item, first, end in sorted(shared.value.search_shard(shard)):
                if d != at:
                    at, held = d, located_words(texts[d])
                rows.append((shard[d][0], item, first, end, held[first][1], held[end - 1][2]))
            yield pd.DataFrame(rows, columns=SPAN, dtype="int64")

    return kept.mapInPandas(run, ", ".join(f"{c} long" for c in SPAN))


def removal_spans(leaks: DataFrame) -> DataFrame:
    """``(doc_id, first_word, end_word, first_char, end_char, items)``: overlapping spans of one document merged."""
    order = Window.partitionBy("doc_id").orderBy("first_word", "end_word", "item_id")
    begun = leaks.withColumn("reach", F.max("end_word").over(order.rowsBetween(Window.unboundedPreceding, -1)))
    numbered = begun.withColumn("span", F.sum(F.when(F.col("reach").isNull() | (F.col("first_word") > F.col("reach")), 1).otherwise(0)).over(order))
    ends = [f(c).alias(c) for c, f in (("first_word", F.min), ("end_word", F.max), ("first_char", F.min), ("end_char", F.max))]
    return numbered.groupBy("doc_id", "span").agg(*ends, F.sort_array(F.collect_set("item_id")).alias("items")).drop("span")
