"""Long exact spans shared between records.

Every window of ``WINDOW`` characters gets a Rabin-Karp hash, a whole batch of
texts at a time. Of each run of ``SPAN - WINDOW + 1`` windows the one of least
hash is kept (winnowing), so two texts with a common span of ``SPAN`` characters
keep at least one common hash at the same place of the span; the kept hashes are
counted in Spark and those of a single text dropped.

Shares need no pairs: around every repeated hash all windows of ``SPAN``
characters are hashed to 128 bits and counted, and those of several texts merge
into maximal removal intervals. Work and shuffle grow with the shared text, however
many texts share it.

Pairs are settled by what stands around a repeated hash: ``SPAN - WINDOW``
characters on either side. Equal surroundings form one class; each two different ones of a
hash are compared character by character, and only then are classes paired. The
members of a hash that very many texts hold are paired in blocks, over many tasks.

Exact copies are folded into one class before any of this and unfolded at the
end, so a text that a third of all records repeat costs its members once.

Defined cases: null, empty and shorter texts share nothing; lengths and
positions are code points; a span that recurs within one text only is not
shared; full copies share their whole text; spans that overlap or touch are
merged; long texts are hashed whole, in overlapping slabs; other columns of any
name do not matter. Hashes and classes are written to the shared folder while a
query is built.
"""

from __future__ import annotations

from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

from beatloom.operators.skew import joined_unique
from beatloom.session import written

#: Length of a shared span, and of the windows hashed for finding it (shorter windows: fewer hashes kept, more chance meetings).
SPAN, WINDOW = 320, 192
#: Code points hashed at a time; a bound of memory only.
SLAB = 1 << 20
#: Classes of surroundings that one task pairs with each other.
BLOCK = 500

_BASE, _OTHER_BASE = 0x9E3779B97F4A7C15, 0xC2B2AE3D27D4EB4F
_FULL = np.uint64(0xFFFFFFFFFFFFFFFF)
_POWERS: dict[tuple[int, int], tuple[np.ndarray, np.ndarray]] = {}


def _powers(n: int, base: int) -> tuple[np.ndarray, np.ndarray]:
    """Powers of a base and of its inverse modulo 2**64."""
    size = 1 << max(12, (n - 1).bit_length())
    if (base, size) not in _POWERS:
        out = []
        for b in (base, pow(base, -1, 1 << 64)):
            p = np.full(size, np.uint64(b), np.uint64)
            p[0] = 1
            out.append(np.cumprod(p, dtype=np.uint64))
        _POWERS[base, size] = (out[0], out[1])
    return _POWERS[base, size]


def window_hashes(codes: np.ndarray, size: int, base: int = _BASE) -> np.ndarray:
    """Hash of every window of ``size`` code points, scrambled so that its order is arbitrary."""
    n = len(codes)
    if n < size:
        return np.empty(0, np.uint64)
    up, down = _powers(n, base)
    sums = np.zeros(n + 1, np.uint64)
    np.cumsum((codes.astype(np.uint64) + np.uint64(1)) * up[:n], out=sums[1:], dtype=np.uint64)
    h = (sums[size:] - sums[:-size]) * down[: n - size + 1]
    h ^= h >> np.uint64(31)
    h *= np.uint64(0xBF58476D1CE4E5B9)
    h ^= h >> np.uint64(29)
    return h


def _sliding(values: np.ndarray, width: int, least: bool) -> np.ndarray:
    """Least (or greatest) of every ``width`` neighbours, in two passes over blocks."""
    pick = np.minimum if least else np.maximum
    n = len(values)
    rows = -(-n // width)
    padded = np.full(rows * width, _FULL if least else np.uint64(0), np.uint64)
    padded[:n] = values
    blocks = padded.reshape(rows, width)
    ahead = pick.accumulate(blocks, axis=1).ravel()
    behind = pick.accumulate(blocks[:, ::-1], axis=1)[:, ::-1].ravel()
    return pick(behind[: n - width + 1], ahead[width - 1 : n])


def winnowed(hashes: np.ndarray, width: int, runs: np.ndarray | None = None) -> np.ndarray:
    """Mask of the hashes that are the least of some ``width`` neighbours; ``runs`` tells which runs count, by their first place."""
    if len(hashes) < width:
        return np.zeros(len(hashes), bool)
    least = _sliding(hashes, width, True)
    if runs is not None:
        least[~runs] = 0
    edge = np.zeros(width - 1, np.uint64)
    return _sliding(np.concatenate([edge, least, edge]), width, False) == hashes


def _codes(text: str) -> np.ndarray:
    return np.frombuffer(text.encode("utf-32-le", "surrogatepass"), np.uint32)


def placed_fingerprints(texts: list[str]) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
    """Kept hashes of the texts, the place in the list of the text of each, and where in it the window begins."""
    width = SPAN - WINDOW + 1
    kept, owners, begins = [np.empty(0, np.uint64)], [np.empty(0, np.int64)], [np.empty(0, np.int64)]
    codes = _codes("".join(texts))
    ends = np.cumsum([len(t) for t in texts])
    at = 0
    while at < len(codes):
        slab = codes[at : at + SLAB]
        hashes = window_hashes(slab, WINDOW)
        if len(hashes):
            begin = at + np.arange(len(hashes))
            owner = np.searchsorted(ends, begin, side="right")
            valid = begin + WINDOW <= ends[owner]
            hashes[~valid] = _FULL
            runs = (begin + SPAN <= ends[owner])[: max(0, len(begin) - width + 1)]  # those within one text
            chosen = np.nonzero(winnowed(hashes, width, runs) & valid)[0]
            kept.append(hashes[chosen])
            owners.append(owner[chosen])
            begins.append(begin[chosen])
        if at + SLAB >= len(codes):
            break
        at += SLAB - SPAN + 1
    owner = np.concatenate(owners)
    starts = np.concatenate([[0], ends[:-1]]).astype(np.int64) if len(texts) else np.empty(0, np.int64)
    return np.concatenate(kept), owner, np.concatenate(begins) - (starts[owner] if len(owner) else 0)


def fingerprints(texts: list[str]) -> tuple[np.ndarray, np.ndarray]:
    """Kept hashes of the texts, and the place in the list of the text of each."""
    return placed_fingerprints(texts)[:2]


def _agree(a: str, b: str) -> int:
    """How many characters two texts have in common from their begin."""
    n = min(len(a), len(b))
    return n if a[:n] == b[:n] else next(i for i in range(n) if a[i] != b[i])


def spanning(left_a: str, right_a: str, left_b: str, right_b: str) -> bool:
    """Whether two places with these surroundings (the window belongs to the right one) lie in a common span."""
    ahead = _agree(right_a, right_b)
    return ahead >= WINDOW and ahead + _agree(left_a[::-1], left_b[::-1]) >= SPAN


#: The two halves of a text's digest: the class of all texts equal to it.
CLASS = ["c1", "c2"]


def classes(documents: DataFrame, key: str, text: str) -> DataFrame:
    """``doc_id, c1, c2, text`` of the documents long enough to share a span; equal texts have one class."""
    rows = documents.select(F.col(f"`{key}`").cast("bigint").alias("doc_id"), F.col(f"`{text}`").alias("text")).where(F.length("text") >= SPAN)
    rows = rows.withColumn("digest", F.md5(F.col("text").cast("binary")))
    half = lambda at: F.conv(F.substring("digest", at, 16), 16, -10).cast("bigint")
    return rows.select("doc_id", half(1).alias("c1"), half(17).alias("c2"), "text")


def _hashed(rows: DataFrame) -> DataFrame:
    def scan(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            hashes, place, begin = placed_fingerprints(batch.column(2).to_pylist())
            at = pa.array(place)
            yield pa.RecordBatch.from_arrays([batch.column(0).take(at), batch.column(1).take(at), pa.array(hashes.view(np.int64)), pa.array(begin)], names=[*CLASS, "h", "at"])

    return rows.select(*CLASS, "text").mapInArrow(scan, "c1 bigint, c2 bigint, h bigint, at bigint")


def occurrences(rows: DataFrame) -> DataFrame:
    """``c1, c2, text, places`` of each class that holds a hash of another class: one of its texts, and its repeated hashes with their places."""
    kept = written(_hashed(rows), "fingerprints")
    several = (F.min("c1") != F.max("c1")) | (F.min("c2") != F.max("c2"))
    repeated = kept.groupBy("h").agg(several.alias("several"), F.count(F.lit(1)).alias("n")).where("several").select("h", "n")
    places = joined_unique(kept, repeated, ["h"], "n").select(*CLASS, "h", "at").distinct().groupBy(*CLASS).agg(F.collect_list(F.struct("h", "at")).alias("places"))
    places = written(places, "repeated-places")
    texts = rows.join(places.select(*CLASS), CLASS, "left_semi").groupBy(*CLASS).agg(F.min_by("text", "doc_id").alias("text"))
    return texts.join(places, CLASS)


def _side(df: DataFrame, name: str, *more: str) -> DataFrame:
    """Class columns renamed for one side of a pair."""
    return df.select(F.col("c1").alias(f"{name}1"), F.col("c2").alias(f"{name}2"), *more)


def class_pairs(rows: DataFrame) -> DataFrame:
    """``a1, a2, b1, b2`` of every two classes with a common span, once."""
    reach = SPAN - WINDOW
    placed = occurrences(rows).select(*CLASS, "text", F.explode("places").alias("p")).select(*CLASS, "p.h", "p.at", "text")
    left = F.substring(F.col("text"), F.greatest(F.col("at") - reach, F.lit(0)).cast("int") + 1, F.least(F.col("at"), F.lit(reach)).cast("int"))
    right = F.substring(F.col("text"), F.col("at").cast("int") + 1, F.lit(SPAN))
    around = written(placed.select(*CLASS, "h", left.alias("l"), right.alias("r")).distinct().withColumn("s", F.xxhash64("l", "r")), "surroundings")
    # equal surroundings are one class of their own, known by its least member; the texts of such a class share more than a span
    alike = written(around.groupBy("h", "s", "l", "r").agg(F.min(F.struct(*CLASS)).alias("least"), F.count(F.lit(1)).alias("n")), "alike")
    sizes = alike.groupBy("h").agg(F.count(F.lit(1)).alias("n_alike")).where("n_alike > 1")
    blocks = F.ceil(F.col("n_alike") / F.lit(BLOCK)).cast("int")
    several = alike.join(sizes, "h").select("h", "s", "l", "r", blocks.alias("blocks"))
    one = several.withColumn("block", F.pmod("s", F.col("blocks")).cast("int")).select("h", "block", F.col("s").alias("sa"), F.col("l").alias("la"), F.col("r").alias("ra"))
    other = several.withColumn("block", F.explode(F.sequence(F.lit(0), F.col("blocks") - 1))).select("h", "block", F.col("s").alias("sb"), F.col("l").alias("lb"), F.col("r").alias("rb"))

    def verify(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            texts = [batch.column(i).to_pylist() for i in range(3, 7)]
            keep = pa.array([spanning(*t) for t in zip(*texts)], pa.bool_())
            yield pa.RecordBatch.from_arrays(batch.columns[:3], names=["h", "sa", "sb"]).filter(keep)

    met = one.join(other, ["h", "block"]).where("sa < sb").select("h", "sa", "sb", "la", "ra", "lb", "rb").mapInArrow(verify, "h bigint, sa bigint, sb bigint")
    within = alike.where(F.length("l") + F.length("r") >= SPAN).where("n > 1").select("h", F.col("s").alias("sa"), F.col("s").alias("sb"))
    linked = met.unionByName(within)
    members = around.select(*CLASS, "h", "s")
    paired = linked.join(_side(members, "a", "h", F.col("s").alias("sa")), ["h", "sa"]).join(_side(members, "b", "h", F.col("s").alias("sb")), ["h", "sb"])
    swap = "a1 > b1 or (a1 = b1 and a2 > b2)"
    first = lambda a, b: F.when(F.expr(swap), F.col(b)).otherwise(F.col(a))
    ordered = paired.where("a1 <> b1 or a2 <> b2").select(first("a1", "b1").alias("a1"), first("a2", "b2").alias("a2"), first("b1", "a1").alias("b1"), first("b2", "a2").alias("b2"))
    return ordered.distinct()


def shared_pairs(documents: DataFrame, key: str = "doc_id", text: str = "text") -> DataFrame:
    """``doc_id_a, doc_id_b``: documents with a common span, smaller id first."""
    rows = classes(documents, key, text)
    members = rows.select("doc_id", *CLASS)
    one, other = _side(members, "a", F.col("doc_id").alias("x")), _side(members, "b", F.col("doc_id").alias("y"))
    across = class_pairs(rows).join(one, ["a1", "a2"]).join(other, ["b1", "b2"]).select("x", "y")
    copied = members.groupBy(*CLASS).agg(F.count(F.lit(1)).alias("n")).where("n > 1")
    copies = members.join(copied.select(*CLASS), CLASS)
    within = copies.select(*CLASS, F.col("doc_id").alias("x")).join(copies.select(*CLASS, F.col("doc_id").alias("y")), CLASS).where("x < y").select("x", "y")
    both = across.unionByName(within)
    return both.select(F.least("x", "y").alias("doc_id_a"), F.greatest("x", "y").alias("doc_id_b")).where("doc_id_a < doc_id_b").distinct()


def linked_classes(documents: DataFrame, key: str = "doc_id", text: str = "text") -> DataFrame:
    """``doc_id, class_id, n_copies, n_links`` of each document long enough to share a span.

    ``class_id`` is the least document with the same text, ``n_copies`` the
    number of documents with it, ``n_links`` that of other classes which share
    a span with it. The links themselves are :func:`class_pairs`.
    """
    rows = classes(documents, key, text)
    members = rows.select("doc_id", *CLASS)
    pairs = class_pairs(rows)
    links = pairs.select(F.explode(F.array(F.struct(F.col("a1").alias("c1"), F.col("a2").alias("c2")), F.struct(F.col("b1").alias("c1"), F.col("b2").alias("c2")))).alias("c")).groupBy("c.c1", "c.c2").agg(F.count(F.lit(1)).alias("n_links"))
    folded = members.groupBy(*CLASS).agg(F.min("doc_id").alias("class_id"), F.count(F.lit(1)).alias("n_copies"))
    known = written(folded.join(links, CLASS, "left").select(*CLASS, "class_id", "n_copies", F.coalesce("n_links", F.lit(0)).cast("bigint").alias("n_links")), "linked-classes")
    return joined_unique(members, known, CLASS, "n_copies").select("doc_id", "class_id", "n_copies", "n_links")


def _windows(rows: DataFrame) -> DataFrame:
    """``c1, c2, at, w1, w2``: every window of ``SPAN`` characters that holds a repeated hash."""

    def scan(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        reach = np.arange(SPAN - WINDOW, -1, -1)
        for batch in batches:
            for i in range(batch.num_rows):
                codes = _codes(batch.column(2)[i].as_py())
                places = np.array(batch.column(3)[i].as_py(), np.int64)
                starts = np.unique(places[:, None] - reach)
                starts = starts[(starts >= 0) & (starts + SPAN <= len(codes))]
                if not len(starts):
                    continue
                both = [window_hashes(codes, SPAN, base)[starts].view(np.int64) for base in (_BASE, _OTHER_BASE)]
                own = [pa.array(np.full(len(starts), batch.column(c)[i].as_py(), np.int64)) for c in range(2)]
                yield pa.RecordBatch.from_arrays([*own, pa.array(starts), *map(pa.array, both)], names=[*CLASS, "at", "w1", "w2"])

    held = occurrences(rows).select(*CLASS, "text", F.array_distinct(F.transform("places", lambda p: p["at"])).alias("at"))
    return held.mapInArrow(scan, "c1 bigint, c2 bigint, at bigint, w1 bigint, w2 bigint")


def shared_spans(documents: DataFrame, key: str = "doc_id", text: str = "text") -> DataFrame:
    """``doc_id, span_start, span_end``: maximal stretches of each document shared with others."""
    rows = classes(documents, key, text)
    members = rows.select("doc_id", *CLASS, F.length("text").cast("bigint").alias("n_chars"))
    windows = written(_windows(rows), "span-windows")
    several = (F.min("c1") != F.max("c1")) | (F.min("c2") != F.max("c2"))
    repeated = windows.groupBy("w1", "w2").agg(several.alias("several"), F.count(F.lit(1)).alias("n")).where("several").select("w1", "w2", "n")
    found = joined_unique(windows, repeated, ["w1", "w2"], "n").select(*CLASS, F.col("at").alias("lo"), (F.col("at") + SPAN).alias("hi"))
    sizes = written(members.groupBy(*CLASS).agg(F.count(F.lit(1)).alias("n"), F.max("n_chars").alias("hi")), "class-sizes")
    whole = sizes.where("n > 1").select(*CLASS, F.lit(0).cast("bigint").alias("lo"), "hi")
    by_class = Window.partitionBy(*CLASS).orderBy("lo", "hi")
    reach = F.max("hi").over(by_class.rowsBetween(Window.unboundedPreceding, -1))
    starts = found.unionByName(whole).withColumn("opens", F.when(reach.isNull() | (F.col("lo") > reach), 1).otherwise(0))
    runs = starts.withColumn("run", F.sum("opens").over(by_class.rowsBetween(Window.unboundedPreceding, 0))).groupBy(*CLASS, "run").agg(F.min("lo").alias("span_start"), F.max("hi").alias("span_end"))
    lists = runs.groupBy(*CLASS).agg(F.sort_array(F.collect_list(F.struct("span_start", "span_end"))).alias("spans")).join(sizes.select(*CLASS, "n"), CLASS)
    return joined_unique(members.select("doc_id", *CLASS), lists, CLASS, "n").select("doc_id", F.explode("spans").alias("s")).select("doc_id", "s.span_start", "s.span_end")


def shares(documents: DataFrame, key: str = "doc_id", text: str = "text") -> DataFrame:
    """``doc_id, n_shared, share``: how much of each document is shared elsewhere, nothing of null and short ones."""
    spans = shared_spans(documents, key, text).groupBy("doc_id").agg(F.sum(F.col("span_end") - F.col("span_start")).alias("n_shared"))
    sizes = documents.select(F.col(f"`{key}`").cast("bigint").alias("doc_id"), F.coalesce(F.length(F.col(f"`{text}`")), F.lit(0)).alias("n_chars"))
    shared = F.coalesce("n_shared", F.lit(0)).cast("bigint")
    return sizes.join(spans, "doc_id", "left").select("doc_id", shared.alias("n_shared"), F.when(F.col("n_chars") > 0, F.round(shared / F.col("n_chars"), 6)).otherwise(0.0).alias("share"))
