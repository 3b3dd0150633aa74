"""Languages of texts and of their segments by segmentation-marginalised unigrams.

Every language has a probability for each piece of a fixed public byte-level
vocabulary. The probability of a word is the sum over all its segmentations
into pieces, computed by the forward algorithm; a sentence is the product of
its words. The probabilities are fitted by a few rounds of expectation
maximisation over the words of a bounded sample of labelled rows. Words that
are names or designations do not count: capitalised ones, those with digits, and Latin words amid another script.

Scoring runs inside the scan (no shuffle); each worker scores a distinct word
once. The model is some megabytes, whatever the number of texts, and is
broadcast.

Defined cases:

* null and blank texts, and texts of names and digits only, have no segment;
* a segment is a maximal run of sentences of one language; its confidence is
  the posterior of that language, under equal priors, given all its words;
* very short sentences are judged like any other, with a lower confidence;
* a sentence without closing mark at the end of a text counts as one;
* equal posteriors are settled by the order of ``LANGUAGES``;
* repeated rows are judged alike; empty tables give empty results.
"""

from __future__ import annotations

import base64
import math
import re
import uuid
from collections import Counter, defaultdict
from collections.abc import Iterator

import numpy as np
import pyarrow as pa
import regex
from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

# The languages told apart, with the names and codes that labels use.
LANGUAGES = ("en", "fr", "de", "es", "pt", "it", "ru", "ar", "hi", "ja", "ko", "zh")
NAMES = {
    "english": "en", "french": "fr", "german": "de", "spanish": "es", "portuguese": "pt", "italian": "it",
    "russian": "ru", "arabic": "ar", "hindi": "hi", "japanese": "ja", "korean": "ko", "chinese": "zh",
    "eng": "en", "fra": "fr", "fre": "fr", "deu": "de", "ger": "de", "spa": "es", "por": "pt", "ita": "it",
    "rus": "ru", "ara": "ar", "hin": "hi", "jpn": "ja", "kor": "ko", "zho": "zh", "chi": "zh",
}
NO_LABEL = ("", "und", "auto", "unknown", "none", "null", "n/a", "mul", "zxx")

#: Labelled rows of each language that the model is fitted on, at most. A bound of the fit only; scoring covers all rows.
SAMPLE_ROWS = 500
#: Texts of the sample have at most so many characters, which bounds what the driver reads.
SAMPLE_CHARS = 10_000
#: Rounds of expectation maximisation, and the count added to every piece.
ROUNDS, PRIOR = 3, 0.02
#: Where the public byte-level vocabulary lies.
VOCABULARY = "/opt/tokenizers/byte_bpe_multi_50k.tiktoken"

SEGMENTS = "array<struct<begin:int,end:int,lang:string,confidence:double>>"

_SPLIT = regex.compile(r"[.!?؟।][\"'”»’)\]]*\s+|[。！？][」』”’)]*\s*|\n+")
_WORD = regex.compile(r"[\p{Script=Latin}\p{M}'’]*\p{Script=Latin}[\p{Script=Latin}\p{M}\p{N}_-]*|\p{Script=Cyrillic}[\p{Script=Cyrillic}\p{M}]*|\p{Script=Arabic}[\p{Script=Arabic}\p{M}]*|\p{Script=Devanagari}[\p{Script=Devanagari}\p{M}]*|\p{Script=Hangul}+|\p{Script=Han}+|[\p{Script=Hiragana}\p{Script=Katakana}ー]+|\p{L}+")
# what the pattern above comes to if all characters are ASCII, several times faster
_ASCII_WORD = re.compile(r"[A-Za-z']*[A-Za-z][A-Za-z0-9_-]*")
_ASCII_COUNTS = re.compile(r"'*[a-z][A-Za-z'_-]*\Z")
_LATIN = regex.compile(r"\p{Script=Latin}+")
_OTHER = regex.compile(r"[^\P{L}\p{Script=Latin}]+")
_DIGIT = regex.compile(r"\p{N}")


def label_code(label: Column) -> Column:
    """The language code that a label names, null for a missing label, ``?`` for one of no known language."""
    bare = F.lower(F.trim(F.regexp_replace(label, r"[\s\x{A0}]+", " ")))
    first = F.regexp_extract(bare, r"^([a-z]+)(?:[-_ ].*)?$", 1)
    names = F.create_map(*[F.lit(x) for pair in NAMES.items() for x in pair])
    code = F.when(first.isin(*LANGUAGES), first).otherwise(F.try_element_at(names, first))
    return F.when(label.isNull() | bare.isin(*NO_LABEL), F.lit(None)).otherwise(F.coalesce(code, F.lit("?")))


def read_pieces(path: str = VOCABULARY) -> list[bytes]:
    """The pieces of a vocabulary file, one ``base64 rank`` line each."""
    with open(path, "rb") as f:
        return [base64.b64decode(line.split()[0]) for line in f if line.strip()]


def sentences(text: str) -> list[tuple[int, int]]:
    """Begin and end of the sentences of a text."""
    out, at = [], 0
    for m in _SPLIT.finditer(text):
        out.append((at, m.end()))
        at = m.end()
    out.append((at, len(text)))
    return [(a, b) for a, b in out if text[a:b].strip()]


def words(sentence: str) -> list[str]:
    """The words of a sentence that count as text, in lower case.

    Capitalised Latin words do not count: they may be names, also where they
    open a sentence.
    """
    sentence = sentence.replace("’", "'")
    if sentence.isascii():
        return [w.lower() for w in _ASCII_WORD.findall(sentence) if _ASCII_COUNTS.match(w)]
    others = sum(map(len, _OTHER.findall(sentence)))
    foreign = others > 0 and others * 3 >= sum(map(len, _LATIN.findall(sentence)))
    out = []
    for w in _WORD.findall(sentence):
        if _LATIN.search(w) and (foreign or w.lstrip("'")[0].isupper() or _DIGIT.search(w)):
            continue
        out.append(w.lower())
    return out


class Model:
    """Piece probabilities of each language, with the forward algorithm over them."""

    def __init__(self, pieces: list[bytes], logs: np.ndarray):
        self.ids = {p: i for i, p in enumerate(pieces)}
        self.longest = max(map(len, pieces))
        self.probabilities = np.exp(logs)
        self.cache: dict[str, np.ndarray] = {}
        self.scored: dict[tuple[str, ...], np.ndarray] = {}

    def _spans(self, data: bytes) -> list[list[tuple[int, int]]]:
        """For each end, the (begin, piece) of the pieces that end there."""
        ids, n = self.ids, len(data)
        return [[(b, ids[data[b:e]]) for b in range(max(0, e - self.longest), e) if data[b:e] in ids] for e in range(1, n + 1)]

    def log_probability(self, word: str) -> np.ndarray:
        """Of a word in each language, summed over all segmentations."""
        if (known := self.cache.get(word)) is not None:
            return known
        p = self.probabilities
        total, shift = [np.ones(p.shape[1])], [0.0]
        for ending in self._spans((" " + word).encode()):
            value = sum((total[b] * math.exp(shift[b] - shift[-1]) * p[i] for b, i in ending), np.zeros(p.shape[1]))
            scale = value.max()
            total.append(value / scale)
            shift.append(shift[-1] + math.log(scale))
        out = np.log(np.maximum(total[-1], 1e-280)) + shift[-1]
        if len(self.cache) > 400_000:
            self.cache.clear()
        self.cache[word] = out
        return out

    def score(self, sentence: str) -> np.ndarray | None:
        """Log probability of a sentence in each language, None if it has no words."""
        counted = tuple(words(sentence))
        if not counted:
            return None
        if (known := self.scored.get(counted)) is not None:
            return known
        out = sum(map(self.log_probability, counted))
        if len(self.scored) > 100_000:
            self.scored.clear()
        self.scored[counted] = out
        return out

    def judge(self, sentence: str) -> tuple[str, float] | None:
        """Language and confidence of a sentence, None if it has no words."""
        score = self.score(sentence)
        return None if score is None else (LANGUAGES[int(score.argmax())], posterior(score))

    def segments(self, text: str | None) -> list[dict]:
        """Maximal runs of sentences of one language."""
        out: list[dict] = []
        totals: list[np.ndarray] = []
        for a, b in sentences(text) if text else []:
            if (score := self.score(text[a:b])) is None:
                if out:
                    out[-1]["end"] = b
                continue
            lang = LANGUAGES[int(score.argmax())]
            if out and out[-1]["lang"] == lang:
                out[-1]["end"] = b
                totals[-1] = totals[-1] + score
            else:
                out.append({"begin": a if out else 0, "end": b, "lang": lang})
                totals.append(score)
        for segment, total in zip(out, totals):
            segment["confidence"] = posterior(total)
        return out


def posterior(score: np.ndarray) -> float:
    """Of the best language under equal priors."""
    return float(1.0 / np.exp(np.clip(score - score.max(), -700, 0)).sum())


def fit(labelled: list[tuple[str, str]], pieces: list[bytes]) -> np.ndarray:
    """Log probabilities (piece, language) from pairs of language and text.

    Rows with a wrong label are a minority: after a first fit the rows are
    scored, those of another language dropped, and the fit is repeated.
    """
    uniform = np.full((len(pieces), len(LANGUAGES)), -math.log(len(pieces)))
    logs = _fitted(labelled, pieces, uniform)
    model = Model(pieces, logs)
    kept = [(lang, s) for lang, text in labelled for a, b in sentences(text) if (found := model.judge(s := text[a:b])) and found[0] == lang]
    return _fitted(kept, pieces, logs)


def _fitted(labelled: list[tuple[str, str]], pieces: list[bytes], logs: np.ndarray) -> np.ndarray:
    counts: dict[str, Counter] = defaultdict(Counter)
    for lang, text in labelled:
        for a, b in sentences(text):
            counts[lang].update(words(text[a:b]))
    for _ in range(ROUNDS):
        model = Model(pieces, logs)
        expected = np.full(logs.shape, PRIOR)
        for k, lang in enumerate(LANGUAGES):
            p = model.probabilities[:, k]
            for word, n in counts[lang].items():
                spans = model._spans((" " + word).encode())
                size = len(spans)
                ahead = np.zeros(size + 1)
                ahead[0] = 1.0
                for e, ending in enumerate(spans, 1):
                    ahead[e] = sum(ahead[b] * p[i] for b, i in ending)
                if not ahead[size] > 0:
                    continue
                behind = np.zeros(size + 1)
                behind[size] = 1.0
                for e in range(size, 0, -1):
                    for b, i in spans[e - 1]:
                        behind[b] += behind[e] * p[i]
                        expected[i, k] += n * ahead[b] * p[i] * behind[e] / ahead[size]
        logs = np.log(expected / expected.sum(axis=0))
    return logs


def sample(df: DataFrame, key: str, text: str, label: str, rows: int = SAMPLE_ROWS) -> list[tuple[str, str]]:
    """At most ``rows`` labelled texts of each language, the first by a hash of their key; read while the query is built.

    The rows of each language are counted first; only those whose hash lies
    below twice the share that is wanted are put in order.
    """
    named = df.select(label_code(F.col(f"`{label}`")).alias("lang"), F.col(f"`{text}`").alias("text"), F.xxhash64(f"`{key}`").alias("h"))
    named = named.where(F.col("lang").isin(*LANGUAGES) & (F.trim("text") != "") & (F.length("text") <= SAMPLE_CHARS))
    sizes = {r["lang"]: r["n"] for r in named.groupBy("lang").agg(F.count(F.lit(1)).alias("n")).collect()}
    if not sizes:
        return []
    limits = F.create_map(*[F.lit(x) for lang, n in sizes.items() for x in (lang, min((1 << 63) - 1, int((1 << 64) * min(1.0, 2.0 * rows / n)) - (1 << 63)))])
    first = Window.partitionBy("lang").orderBy("h", "text")
    chosen = named.where(F.col("h") <= limits[F.col("lang")]).withColumn("n", F.row_number().over(first)).where(F.col("n") <= rows).orderBy("lang", "n")
    return [(r["lang"], r["text"]) for r in chosen.select("lang", "text").collect()]


_MODELS: dict[str, Model] = {}


def with_segments(df: DataFrame, text: str, labelled: list[tuple[str, str]], vocabulary: str = VOCABULARY, out: str = "segments") -> DataFrame:
    """Adds ``out``, the language segments of a text with their confidence; a column of that name is replaced."""
    pieces = read_pieces(vocabulary)
    logs = fit(labelled, pieces).astype(np.float32)
    df = df.select(*[F.col(f"`{c}`") for c in df.columns if c != out])
    spark = df.sparkSession
    shared = spark.sparkContext.broadcast((pieces, logs))
    name = uuid.uuid4().hex
    kind = pa.list_(pa.struct([("begin", pa.int32()), ("end", pa.int32()), ("lang", pa.string()), ("confidence", pa.float64())]))

    def score(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        if name not in _MODELS:
            _MODELS.clear()
            _MODELS[name] = Model(shared.value[0], shared.value[1].astype(np.float64))
        model = _MODELS[name]
        for batch in batches:
            found = [model.segments(t) for t in batch.column(batch.schema.get_field_index(text)).to_pylist()]
            yield pa.RecordBatch.from_arrays([*batch.columns, pa.array(found, kind)], names=[*batch.schema.names, out])

    fields = ", ".join(f"`{f.name}` {f.dataType.simpleString()}" for f in df.schema.fields)
    return df.mapInArrow(score, f"{fields}, `{out}` {SEGMENTS}")


def found_cases(rows: DataFrame, key: str, label: str) -> DataFrame:
    """``key, lang`` for each language of a text whose label is missing or wrong, or that mixes languages."""
    langs = F.array_distinct(F.transform("segments", lambda s: s["lang"]))
    judged = rows.select(F.col(key), label_code(F.col(label)).alias("label"), langs.alias("langs")).where("size(langs) > 0")
    case = F.col("label").isNull() | (F.size("langs") > 1) | ~F.array_contains("langs", F.col("label"))
    return judged.where(case).select(key, F.explode("langs").alias("lang"))
