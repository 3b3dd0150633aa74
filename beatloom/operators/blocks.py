"""Searches of many requests: chunks of requests against blocks of the whole catalog.

Every chunk meets every block in one Arrow batch, where a request costs a few
array operations on the entries it can reach; the best of each block are merged
by the caller. Which held values a requested one hits is settled beforehand by
:func:`beatloom.operators.search.containing_pairs`, once per distinct pair.
Nothing is broadcast, and a popular entity is spread over all chunks and blocks.

Scores are whole tenths as in ``search``; a filter without values is passed over.
"""

from __future__ import annotations

from collections import defaultdict
from collections.abc import Callable
from math import ceil

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from beatloom.functions import text as T

#: Requests of a chunk and entries of a block.
CHUNK, BLOCK = 20_000, 20_000
#: Entries of a block from which a word's points are kept for all of them.
FREQUENT = 200
#: Masks of requested actions and contexts kept at once.
MASKS = 500


def _words(text: Column) -> Column:
    return F.coalesce(T.words(F.lower(text)), F.array().cast("array<string>"))


def word_columns() -> list[Column]:
    """The different words of an entry's description, topic and tags."""
    from beatloom.operators import search

    tags = F.flatten(F.transform(F.concat(search._lowered(F.col("entities")), search._lowered(F.col("actions"))), T.words))
    return [F.array_distinct(_words(F.col("description"))).alias("description"), F.array_distinct(_words(F.col("topic"))).alias("topic"), F.array_distinct(tags).alias("tags")]


def scored(requests: DataFrame, catalog: DataFrame, rule: str, k: int) -> DataFrame:
    """``request_id, entry_id, tenths``: of each request the ``k`` best of every block under ``text``, ``gated`` or ``additive``."""
    from beatloom.operators import search

    kind = requests.schema["request_id"].dataType.simpleString()
    n_chunks, n_blocks = max(1, ceil(requests.count() / CHUNK)), max(1, ceil(catalog.count() / BLOCK))
    low, empty = search._lowered, F.array().cast("array<string>")
    fields = {"text": (), "gated": ("entities", "actions", "context"), "additive": ("entities",)}[rule]
    asked = requests.select(
        F.pmod(F.xxhash64("request_id"), F.lit(n_chunks)).cast("int").alias("chunk"), "request_id", _words(F.col("query")).alias("words"), *[low(F.col(c)).alias(c) for c in ("entities", "actions", "context")],
        F.coalesce("strictness", F.lit("general")).isin("exact", "specific").alias("strict"), search.quality_rank(F.col("min_quality")).alias("least"), "asset_type",
    )
    rows = asked.select("chunk", F.lit("").alias("field"), F.lit(None).cast("string").alias("term"), empty.alias("whole"), empty.alias("part"), *asked.columns[1:])
    for field in fields:
        terms = asked.select("chunk", F.explode(field).alias("req")).distinct()
        held = catalog.select(F.explode(low(F.col("environment" if field == "context" else field))).alias("held"))
        hit = terms.join(search.containing_pairs(terms, held), "req").groupBy("chunk", "req")
        of = lambda exact: F.collect_list(F.when(F.col("exact") == exact, F.col("held")))
        hit = hit.agg(of(True).alias("whole"), of(False).alias("part"))
        nothing = [F.lit(None).cast(t).alias(n) for n, t in asked.dtypes[1:]]
        rows = rows.unionByName(hit.select("chunk", F.lit(field).alias("field"), F.col("req").alias("term"), "whole", "part", *nothing))
    everywhere = F.explode(F.sequence(F.lit(0), F.lit(n_blocks - 1)))
    left = rows.select("*", everywhere.alias("block")).withColumn("_g", F.col("chunk") * n_blocks + F.col("block")).drop("chunk", "block")
    entries = catalog.select(
        F.pmod(F.xxhash64("entry_id"), F.lit(n_blocks)).cast("int").alias("block"), F.col("entry_id").cast("bigint").alias("entry_id"), "media_type", search.quality_rank(F.col("quality")).alias("q"), search._penalty(F.col("times_used")).alias("penalty"),
        *[F.array_distinct(low(F.col(c))).alias(c) for c in ("entities", "actions", "environment")], *word_columns(),
    )
    right = entries.withColumn("_chunk", F.explode(F.sequence(F.lit(0), F.lit(n_chunks - 1)))).withColumn("_g", F.col("_chunk") * n_blocks + F.col("block")).drop("_chunk", "block")
    out = left.groupBy("_g").cogroup(right.groupBy("_g")).applyInArrow(_searcher(rule, k), f"request_id {kind}, entry_id bigint, tenths bigint")
    entry_kind = catalog.schema["entry_id"].dataType.simpleString()
    return out.withColumn("entry_id", F.col("entry_id").cast(entry_kind))


def _searcher(rule: str, k: int) -> Callable:
    """The search of one chunk in one block, as a function of two Arrow tables."""

    def run(left, right):  # noqa: ANN001, ANN202 - Arrow tables
        import numpy as np
        import pyarrow as pa

        kind = left.schema.field("request_id").type
        asked, block = left.to_pylist(), _Block(right, rule)
        requests = [r for r in asked if r["field"] == ""]
        block.learn(requests, [r for r in asked if r["field"] != ""])
        ids, entries, tenths = [], [], []
        for r in requests:
            at, score = getattr(block, rule)(r)
            if len(at):
                order = score.astype(np.int64) * block.n - at  # ties keep the order of entry_id
                best = np.argpartition(order, len(at) - k)[-k:] if len(at) > k else np.arange(len(at))
                ids += [r["request_id"]] * len(best)
                entries.append(block.ids[at[best]])
                tenths.append(score[best].astype(np.int64))
        joined = lambda parts: np.concatenate(parts) if parts else np.array([], dtype=np.int64)
        return pa.table({"request_id": pa.array(ids, type=kind), "entry_id": pa.array(joined(entries)), "tenths": pa.array(joined(tenths))})

    return run


class _Block:
    """Entries of a block in the order of their ids, and what a chunk's requests need to know of them."""

    def __init__(self, table, rule: str) -> None:  # noqa: ANN001 - Arrow table
        import numpy as np

        self.np, self.rule = np, rule
        table = table.sort_by("entry_id")
        self.ids = table["entry_id"].to_numpy()
        self.n = max(1, len(self.ids))
        self.quality, self.penalty = table["q"].to_numpy(), table["penalty"].to_numpy().astype(np.int64)
        self.media = np.array(table["media_type"].to_pylist(), dtype=object)
        self.table = table
        self.all = np.arange(len(self.ids))
        self.allowed = {least: np.flatnonzero(self.quality >= least) for least in range(3)}
        self.points, self.gate = np.zeros(self.n, dtype=np.int64), np.zeros(self.n, dtype=np.int64)
        self.masks: dict = {}

    def _index(self, column: str, wanted: set) -> dict:
        found = defaultdict(list)
        for i, values in enumerate(self.table[column].to_pylist()):
            for v in values:
                if v in wanted:
                    found[v].append(i)
        return {v: self.np.array(i) for v, i in found.items()}

    def learn(self, requests: list, terms: list) -> None:
        np = self.np
        none = np.array([], dtype=np.int64)
        union = lambda values, index: np.unique(np.concatenate([none, *[index[v] for v in values if v in index]]))
        self.hits: dict = {"entities": {}, "actions": {}, "context": {}}
        for field in self.hits:
            own = [t for t in terms if t["field"] == field]
            index = self._index("environment" if field == "context" else field, {v for t in own for v in (*t["whole"], *t["part"])}) if own else {}
            for t in own:
                whole = union(t["whole"], index)
                self.hits[field][t["term"]] = (whole, np.setdiff1d(union(t["part"], index), whole, assume_unique=True))
        words = {w for r in requests for w in r["words"]}
        weights = (("description", 5),) if self.rule == "additive" else (("description", 3), ("topic", 5), ("tags", 10))
        parts = defaultdict(list)
        for column, points in weights:
            for w, at in self._index(column, words).items():
                parts[w].append((at, points))
        self.frequent, self.rare = {}, {}
        for w, lists in parts.items():
            if sum(len(at) for at, _ in lists) >= FREQUENT:
                self.frequent[w] = np.zeros(self.n, dtype=np.int64)
                for at, points in lists:
                    self.frequent[w][at] += points
            else:
                self.rare[w] = lists
        if self.rule == "additive":
            self.held_actions = self._index("actions", {a for r in requests for a in r["actions"]})

    def _words(self, words: list, at):  # noqa: ANN001, ANN202
        """Points of the words at the given entries."""
        total, rare = self.np.zeros(len(at), dtype=self.np.int64), [x for w in words if w in self.rare for x in self.rare[w]]
        for w in words:
            if w in self.frequent:
                total += self.frequent[w][at]
        if rare:
            for where, points in rare:
                self.points[where] += points
            total += self.points[at]
            for where, _ in rare:
                self.points[where] = 0
        return total

    def text(self, r: dict):  # noqa: ANN202
        at = self.allowed[r["least"]]
        return at, self._words(list(dict.fromkeys(r["words"])), at) - self.penalty[at]

    def _meets(self, field: str, values: list):  # noqa: ANN202
        """Whether the entries hold one of the values in whole or in part."""
        key = (field, *values)
        if key not in self.masks:
            if len(self.masks) >= MASKS:
                self.masks.clear()
            self.masks[key] = self.np.zeros(self.n, dtype=bool)
            for v in values:
                for where in self.hits[field].get(v, ()):
                    self.masks[key][where] = True
        return self.masks[key]

    def gated(self, r: dict):  # noqa: ANN202
        from beatloom.operators import search

        np = self.np
        if r["entities"]:
            found = [self.hits["entities"][e] for e in r["entities"] if e in self.hits["entities"]]
            for whole, part in reversed(found):  # the first requested entity that an entry holds has the last word
                self.gate[part], self.gate[whole] = search.PARTIAL, search.EXACT
            lists = [x for pair in found for x in pair if len(x)]
            at = lists[0] if len(lists) == 1 else np.unique(np.concatenate(lists)) if lists else self.all[:0]
            entity = self.gate[at]
            self.gate[at] = 0
            keep = (self.quality[at] >= r["least"]) & ((entity == search.EXACT) | (not r["strict"]))
            at, entity = at[keep], entity[keep]
        else:
            at, entity = self.allowed[r["least"]], 0
        score = entity + self._words(list(dict.fromkeys(r["words"])), at) - self.penalty[at]
        keep = np.ones(len(at), dtype=bool)
        for field, points in (("actions", search.ACTION), ("context", search.CONTEXT)):
            if r[field]:
                keep &= self._meets(field, r[field])[at]
                score = score + points
        if r["asset_type"] is not None:
            keep &= (self.media[at] == r["asset_type"]).astype(bool)
        return at[keep], score[keep]

    def additive(self, r: dict):  # noqa: ANN202
        np = self.np
        total = self._words(r["words"], self.all)
        for e in r["entities"]:
            whole, part = self.hits["entities"].get(e, (self.all[:0], self.all[:0]))
            total[whole] += 50
            total[part] += 20
        for a in r["actions"]:
            if a in self.held_actions:
                total[self.held_actions[a]] += 15
        at = np.flatnonzero(total > 0)
        kinds = {"video": ("video",), "image": ("image", "video")}.get(r["asset_type"])
        if kinds:
            at = at[np.isin(self.media[at].astype(str), kinds)]
        return at, total[at]
