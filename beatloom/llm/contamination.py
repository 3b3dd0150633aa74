"""Held-out passages in a corpus, exact and re-parameterised.

Words are canonicalised into templates: numbers, units and slot words (any
word that is not part of the items' common frame) become typed placeholders.
Windows of template words of the items meet those of the documents by hash; the
slots of a meeting are then compared. Where every slot has the item's own
filling the passage is a leak; where all slots of a run are refilled
consistently it is a re-parameterised copy.

The items, a fixed list of test questions, are taken in blocks of
``ITEMS_A_PASS``, so what is sent to the workers is bounded, whatever their
number. Documents are only scanned, a batch of texts at a time: their words are
numbered, template hashes of all windows are rolled by array operations, and only
windows whose hash an item has are looked at. Nothing of them is shuffled but the
hits. The number of items and their frame words are counted while a query is built.

Defined cases: null and empty texts and texts of fewer words than a window
have no hit; letter case and whatever stands between words do not matter;
words are maximal runs of letters and digits; a passage that occurs in several
items is reported for each; repeated passages in a document count once;
duplicated documents are all reported; an empty item list gives no rows; other
columns of any name do not matter.
"""

from __future__ import annotations

import hashlib
import re
import unicodedata
from array import array
from collections.abc import Iterator
from functools import reduce
from itertools import chain
from math import ceil

import numpy as np
import pyarrow as pa
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

#: Consecutive words that make a passage.
WINDOW = 10
#: A word found in at least so many items belongs to the frame; others fill slots.
FRAME_ITEMS = 3
#: Items of one pass over the documents, and words of a batch's part; bounds of memory only.
ITEMS_A_PASS, WORDS_A_PART = 50_000, 1 << 20
#: Words that a worker keeps numbered.
KEPT_WORDS = 1 << 20

# Words of measure that templates fold into one placeholder.
UNITS = ("metres", "meters", "kilometres", "kilometers", "miles", "tonnes", "tons", "litres", "liters", "grams", "kilograms", "hours", "minutes", "seconds", "days", "weeks", "months", "years", "km", "kg", "mm", "cm")
_UNIT_SET = frozenset(UNITS)


def words(text: Column) -> Column:
    """The words of a text in lower case."""
    return F.regexp_extract_all(F.lower(text), F.lit(r"([\p{L}\p{Nd}\p{Nl}\p{No}]+)"), F.lit(1))


def frame(items: DataFrame, text: str) -> DataFrame:
    """``word`` for each word that stands in at least ``FRAME_ITEMS`` items."""
    distinct = items.select(F.explode(F.array_distinct(words(F.col(f"`{text}`")))).alias("word"))
    return distinct.groupBy("word").agg(F.count(F.lit(1)).alias("n")).where(F.col("n") >= FRAME_ITEMS).select("word")


def frame_list(items: DataFrame, text: str) -> list[str]:
    """The frame words on the driver: words shared by several of the fixed items."""
    return sorted(r["word"] for r in frame(items, text).where("not rlike(word, '[\\\\p{N}]')").collect())


def _numbered(word: str) -> bool:
    return not word.isalpha() and any(unicodedata.category(c)[0] == "N" for c in word)


def _template(tokens: list[str], frame_words: set[str], folded: bool) -> tuple[list[str], list[int]]:
    """The template of a text and where each of its parts begins, with the number of words at the end.

    ``folded`` makes one part of adjacent slot words: a number if all of them
    have digits, else a name.
    """
    typed = ["@" if w in _UNIT_SET else w if w in frame_words else "#" if _numbered(w) else "*" for w in tokens]
    if not folded:
        return typed, list(range(len(tokens) + 1))
    parts: list[str] = []
    starts: list[int] = []
    for at, t in enumerate(typed):
        if parts and t in "#*" and parts[-1] in "#*":
            parts[-1] = "#" if t == parts[-1] == "#" else "*"
        else:
            parts.append(t)
            starts.append(at)
    return parts, [*starts, len(tokens)]


def _filled(item: list[str], found: list[str], item_starts: list[int], starts: list[int]) -> list[tuple]:
    """Pairs of an item's words and what a document has for them; slots of other lengths as a whole."""
    pairs = []
    for a, b, c, d in zip(item_starts, item_starts[1:], starts, starts[1:]):
        pairs += zip(item[a:b], found[c:d]) if b - a == d - c else [(tuple(item[a:b]), tuple(found[c:d]))]
    return pairs


def _runs(tokens: list[str], items: dict, frame_words: set[str], size: int) -> list[tuple]:
    """``item_id, at_word, n_words, n_changed`` of the consistent maximal runs of one document."""
    out: dict[tuple, int] = {}
    leaked: set[tuple] = set()
    for folded, (index, siblings) in items.items():
        parts, starts = _template(tokens, frame_words, folded)
        places: dict[tuple, list[int]] = {}
        for at in range(len(parts) - size + 1):
            for shape, item_at in index.get(tuple(parts[at : at + size]), ()):
                places.setdefault((shape, at - item_at), []).append(at)
        for (shape, shift), found in places.items():
            breaks = [0, *(k for k in range(1, len(found)) if found[k] != found[k - 1] + 1), len(found)]
            for lo, hi in zip(breaks, breaks[1:]):
                first, last = found[lo], found[hi - 1] + size
                for item_id, words_, item_starts in siblings[shape]:
                    pairs = set(_filled(words_, tokens, item_starts[first - shift : last - shift + 1], starts[first : last + 1]))
                    changed = sum(a != b for a, b in pairs)
                    if not changed:
                        leaked.add((starts[first], starts[last]))
                    elif len({a for a, _ in pairs}) == len(pairs):
                        out[item_id, starts[first], starts[last]] = changed
    inside = lambda r: any(a <= r[1] and r[2] <= b for a, b in leaked) or any(o != r and o[0] == r[0] and o[1] <= r[1] and r[2] <= o[2] for o in out)
    return [(i, a, b - a, n) for (i, a, b), n in out.items() if not inside((i, a, b))]


_WORD = re.compile(r"[^\W_]+")
_FOLD = bytes(ord(chr(c).lower()) if c < 128 and chr(c).isalnum() else 32 for c in range(256))
_NUMBER, _NAME, _UNIT = 1, 2, 3
_BASE = np.uint64(0x9E3779B97F4A7C15)
_BITS = 20


def word_list(text: str | None) -> list[str]:
    """The words of a text in lower case."""
    if not text:
        return []
    if text.isascii():
        return text.encode().translate(_FOLD).decode().split()
    return _WORD.findall(text.lower())


class Words(dict):
    """Numbers words as they come; for each number the kind of word in a template and a hash of the word."""

    def __init__(self, frame_words: set[str]):
        super().__init__()
        self.frame = {w: i for i, w in enumerate(sorted(frame_words), _UNIT + 1)}
        self.kinds, self.hashes = array("q"), array("Q")

    def __missing__(self, word: str) -> int:
        self[word] = code = len(self.kinds)
        kind = _UNIT if word in _UNIT_SET else self.frame.get(word) or (_NUMBER if _numbered(word) else _NAME)
        self.kinds.append(kind)
        self.hashes.append(int.from_bytes(hashlib.blake2b(word.encode("utf-8", "surrogatepass"), digest_size=8).digest(), "little"))
        return code

    def coded(self, lists: list[list[str]]) -> np.ndarray:
        if len(self) > KEPT_WORDS:
            self.clear()
            self.kinds, self.hashes = array("q"), array("Q")
        return np.fromiter(map(self.__getitem__, chain.from_iterable(lists)), np.int64, sum(map(len, lists)))


def _mixed(values: np.ndarray) -> np.ndarray:
    v = values.astype(np.uint64) * np.uint64(0xBF58476D1CE4E5B9)
    v ^= v >> np.uint64(29)
    return v * np.uint64(0x94D049BB133111EB)


def _rolled(values: np.ndarray, size: int) -> np.ndarray:
    """Hash of every window of ``size`` values."""
    n = len(values) - size + 1
    if n <= 0:
        return np.empty(0, np.uint64)
    out = np.zeros(n, np.uint64)
    for j in range(size):
        out = out * _BASE + values[j : j + n]
    return out ^ (out >> np.uint64(31))


def _parts(kinds: np.ndarray, begins: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    """Kinds of the folded parts of texts laid end to end, and where each part begins; a part never reaches over the begin of a text."""
    if not len(kinds):
        return kinds, np.empty(0, np.int64)
    slot = kinds <= _NAME
    opens = np.ones(len(kinds), bool)
    opens[1:] = ~(slot[1:] & slot[:-1])
    opens[begins[begins < len(kinds)]] = True
    starts = np.flatnonzero(opens)
    return np.maximum.reduceat(kinds, starts), starts


class Templates:
    """The windows of a block of items, and the scan of documents for them."""

    def __init__(self, items: list[tuple[int, str | None]], frame_words: set[str], size: int):
        self.size, self.words, self.frame = size, Words(frame_words), frame_words
        self.items = [(i, w) for i, t in items if len(w := word_list(t)) >= size]
        self.exact: dict[int, list[tuple]] = {}
        plain, folded = [], []
        for item_id, words in self.items:
            codes = self.words.coded([words])
            kinds = np.array(self.words.kinds)[codes]
            plain.append(_rolled(_mixed(kinds), size))
            folded.append(_rolled(_mixed(_parts(kinds, np.zeros(1, np.int64))[0]), size))
            for at, h in enumerate(_rolled(np.array(self.words.hashes)[codes], size).tolist()):
                self.exact.setdefault(h, []).append((item_id, at, words[at : at + size]))
        self.plain, self.folded = self._table(plain), self._table(folded)
        self.exact_hashes = np.array(sorted(self.exact), np.uint64)

    @staticmethod
    def _table(hashes: list[np.ndarray]) -> tuple[np.ndarray, np.ndarray]:
        known = np.unique(np.concatenate([np.empty(0, np.uint64), *hashes]))
        bits = np.zeros(1 << _BITS, bool)
        bits[(known >> np.uint64(64 - _BITS)).astype(np.int64)] = True
        return known, bits

    @staticmethod
    def _met(hashes: np.ndarray, table: tuple[np.ndarray, np.ndarray]) -> np.ndarray:
        """Places of the windows whose template an item has."""
        known, bits = table
        if not len(known):
            return np.empty(0, np.int64)
        at = np.flatnonzero(bits[(hashes >> np.uint64(64 - _BITS)).astype(np.int64)])
        return at[known[np.minimum(np.searchsorted(known, hashes[at]), len(known) - 1)] == hashes[at]]

    def _laid(self, lists: list[list[str]]) -> tuple:
        codes = self.words.coded(lists)
        ends = np.cumsum([len(w) for w in lists])
        return np.array(self.words.kinds)[codes], codes, ends

    def leaked(self, lists: list[list[str]]) -> Iterator[tuple[int, int, int]]:
        """``place in the list, item_id, item_at`` of the windows that repeat an item word for word: template first, then its slots."""
        kinds, codes, ends = self._laid(lists)
        at = self._met(_rolled(_mixed(kinds), self.size), self.plain)
        owner = np.searchsorted(ends, at, side="right")
        inside = at + self.size <= ends[owner] if len(at) else np.zeros(0, bool)
        at, owner = at[inside], owner[inside]
        if not len(at):
            return
        hashes, exact = np.array(self.words.hashes), np.zeros(len(at), np.uint64)
        for j in range(self.size):
            exact = exact * _BASE + hashes[codes[at + j]]
        exact ^= exact >> np.uint64(31)
        found = np.isin(exact, self.exact_hashes)
        begins = ends - [len(w) for w in lists]
        for place, window, h in zip(owner[found].tolist(), at[found].tolist(), exact[found].tolist()):
            begin = window - int(begins[place])
            filled = lists[place][begin : begin + self.size]
            for item_id, item_at, words in self.exact[h]:
                if words == filled:
                    yield place, item_id, item_at

    def candidates(self, lists: list[list[str]]) -> list[int]:
        """Places of the documents with a window of an item's template, word by word or with adjacent slot words folded."""
        kinds, _, ends = self._laid(lists)
        begins = np.concatenate([[0], ends[:-1]]).astype(np.int64)
        met: set[int] = set()
        for values, starts, table in ((kinds, np.arange(len(kinds)), self.plain), (*_parts(kinds, begins), self.folded)):
            at = self._met(_rolled(_mixed(values), self.size), table)
            if len(at):
                first, last = starts[at], starts[at + self.size - 1]
                owner = np.searchsorted(ends, first, side="right")
                met.update(owner[last < ends[owner]].tolist())
        return sorted(met)


def _scanned(documents: DataFrame, items: DataFrame, keys: tuple[str, str, str, str], size: int, rule, schema: str) -> DataFrame:
    """What ``rule`` gives for the parts of the documents' batches, for every block of the items."""
    doc_key, doc_text, item_key, item_text = keys
    rows = items.select(F.col(f"`{item_key}`").cast("bigint").alias("item_id"), F.col(f"`{item_text}`").alias("item"))
    n_blocks = max(1, ceil(rows.count() / ITEMS_A_PASS))
    frame_words = set(frame_list(items, item_text))
    docs = documents.select(F.col(f"`{doc_key}`").cast("bigint").alias("doc_id"), F.col(f"`{doc_text}`").alias("doc_text"))
    names = [f.split()[0] for f in schema.split(", ")]
    spark = documents.sparkSession
    found = []
    for block in range(n_blocks):
        shared = spark.sparkContext.broadcast([tuple(r) for r in rows.where(F.pmod(F.xxhash64("item_id"), F.lit(n_blocks)) == block).collect()])

        def scan(batches: Iterator[pa.RecordBatch], shared=shared) -> Iterator[pa.RecordBatch]:
            state = rule(Templates(shared.value, frame_words, size))
            for batch in batches:
                ids, texts = batch.column(0).to_pylist(), batch.column(1).to_pylist()
                at = 0
                while at < len(ids):
                    lists, n, begin = [], 0, at
                    while at < len(ids) and n < WORDS_A_PART:
                        lists.append(word_list(texts[at]))
                        n += len(lists[-1])
                        at += 1
                    hits = [(ids[begin + place], *rest) for place, *rest in state(lists)]
                    columns = zip(*hits) if hits else [()] * len(names)
                    yield pa.RecordBatch.from_arrays([pa.array(c, type=pa.int64()) for c in columns], names=names)

        found.append(docs.mapInArrow(scan, schema))
    return reduce(DataFrame.unionByName, found)


def leaks(documents: DataFrame, items: DataFrame, doc_key: str = "doc_id", doc_text: str = "text", item_key: str = "item_id", item_text: str = "prompt", size: int = WINDOW) -> DataFrame:
    """``doc_id, item_id, n_windows``: documents that contain ``size`` consecutive words of an item."""
    hits = _scanned(documents, items, (doc_key, doc_text, item_key, item_text), size, lambda templates: templates.leaked, "doc_id bigint, item_id bigint, item_at bigint")
    return hits.groupBy("doc_id", "item_id").agg(F.countDistinct("item_at").alias("n_windows"))


def _indexed(items: list[tuple[int, list[str]]], frame_words: set[str], size: int) -> dict:
    """The windows of the items' templates, plain and folded, and the items of each whole template."""
    known: dict = {}
    for folded in (False, True):
        index: dict[tuple, set] = {}
        siblings: dict[tuple, list] = {}
        for item_id, tokens in items:
            parts, starts = _template(tokens, frame_words, folded)
            shape = tuple(parts)
            siblings.setdefault(shape, []).append((item_id, tokens, starts))
            for at in range(len(parts) - size + 1):
                index.setdefault(shape[at : at + size], set()).add((shape, at))
        known[folded] = index, siblings
    return known


def reparameterised(documents: DataFrame, items: DataFrame, doc_key: str = "doc_id", doc_text: str = "text", item_key: str = "item_id", item_text: str = "prompt", size: int = WINDOW) -> DataFrame:
    """``doc_id, item_id, at_word, n_words, n_changed``: passages of items that a document repeats with other slot fillings.

    A passage is a maximal run of matching windows, from one window upwards, of
    the template word by word or with adjacent slot words folded, so that a
    slot may be filled by another number of words. It is compared with every
    item of the shape: what occurs several times in the run must be replaced by
    one filling throughout, and something must be changed. What repeats one
    item word for word is a leak of that item, not a passage of its siblings.
    """

    def rule(templates: Templates):
        known = _indexed(templates.items, templates.frame, size)
        return lambda lists: ((place, *run) for place in templates.candidates(lists) for run in _runs(lists[place], known, templates.frame, size))

    return _scanned(documents, items, (doc_key, doc_text, item_key, item_text), size, rule, "doc_id bigint, item_id bigint, at_word bigint, n_words bigint, n_changed bigint")
