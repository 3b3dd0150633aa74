"""The best entry of each of many requests: lists of the entries that a requested entity hits.

Requests come in about as many forms as there are beats, but each entity that
they name is hit by few entries, and a request's best entry is the best of its
entities' lists. Lists and requests meet in groups of many short lists or of a
block of a long one; there a request costs the entries that hold its rare words,
since the best by gate, reuse and frequent words alone is kept for each
combination of frequent words.

The first requested entity that an entry hits decides between a whole and a
partial hit. In the list of an entity an entry that it hits wholly counts as a
partial hit if it hits an earlier entity of the request partially: then either
that is its first hit, or its first hit is a whole one and counts in the list of
that entity. No list gives an entry more points than it has.

A held value that is part of very many requested ones (or contains them) would
bring its entries into all their lists; such a value has a list of its own, and
the requests come to it.
"""

from __future__ import annotations

from collections.abc import Callable

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from beatloom.operators.skew import joined_unique
from beatloom.session import written

#: Entries of a block and requests of a chunk of one list.
BLOCK, CHUNK = 30_000, 100_000
#: Entries of a group of lists, where five times as many requests meet them.
GROUP = 10_000
#: Lists longer than a block or chunk are cut into so many parts of all rows at most, which bounds the broadcast of their names.
PARTS = 1000
#: Partial hits from which a held value has a list of its own.
WIDE = 100
#: Entries of a list from which a word's points are kept for all of them.
FREQUENT = 200


def _parts(rows: Column, least: int, total: int) -> Column:
    return F.ceil(F.coalesce(rows, F.lit(1)) / F.lit(max(least, -(-total // PARTS)))).cast("int")


def best_entries(requests: DataFrame, catalog: DataFrame, keys: list[str]) -> DataFrame:
    """``keys, tenths, entry_id, media_type, quality`` of the requests that an entry serves.

    ``requests`` has ``keys`` (one request each), ``entities`` (lower case, in
    their order) and ``query`` (different words between blanks); ``catalog``
    has the entries that pass the quality gate: ``entry_id, media_type,
    quality, penalty``, ``held`` (lower-case entities) and the words of
    ``description``, ``topic`` and ``tags``.
    """
    entities = F.when(F.size("entities") > 0, F.col("entities")).otherwise(F.array(F.lit("")))
    asked = requests.select(*keys, "query", "entities", F.posexplode(entities).alias("_at", "term"))
    asked = asked.select(*keys, "query", "term", F.when(F.col("_at") > 0, F.to_json(F.slice("entities", F.lit(1), F.col("_at")))).alias("earlier"))
    terms = written(asked.groupBy("term").agg(F.count(F.lit(1)).alias("m")), "best-terms")
    lists, wide = _lists(terms, catalog)
    requested = asked.withColumn("list", F.concat(F.lit("="), "term"))
    counts = terms.select(F.concat(F.lit("="), "term").alias("list"), "m")
    if wide is not None:
        to_wide = joined_unique(asked, wide, "term", "m").select(*keys, "query", "term", "earlier", F.explode("wides").alias("list"))
        requested = requested.unionByName(to_wide)
        counts = counts.unionByName(wide.select(F.explode("wides").alias("list"), "m").groupBy("list").agg(F.sum("m").alias("m")))
    named = lists.select(F.explode("lists.list").alias("list")).groupBy("list").agg(F.count(F.lit(1)).alias("n"))
    sizes = written(counts.join(named, "list"), "best-sizes")  # lists that nobody asks for, and entities that no entry has, drop out
    total = sizes.agg(*[F.coalesce(f(c), F.lit(0)).alias(f"{f.__name__}_{c}") for c in ("m", "n") for f in (F.sum, F.max)]).first()
    groups = max(1, -(-total["sum_n"] // GROUP), -(-total["sum_m"] // (GROUP * 5)))
    cut = sizes.select("list", _parts(F.col("n"), BLOCK, total["sum_n"]).alias("blocks"), _parts(F.col("m"), CHUNK, total["sum_m"]).alias("chunks"))
    cut = F.broadcast(cut.where("blocks > 1 or chunks > 1"))
    rows = catalog.join(lists, ["entry_id", "held"]).select("entry_id", "media_type", "quality", "penalty", "description", "topic", "tags", "partial", F.explode("lists").alias("l"))
    rows = rows.select("l.list", "l.gate", "entry_id", "media_type", "quality", "penalty", "description", "topic", "tags", F.when(F.col("l.whole"), F.col("partial")).alias("partial"))
    sized = lambda df: df.join(cut, "list", "left").fillna(1, ["blocks", "chunks"])
    requested, rows = sized(requested), sized(rows)
    found = _met(requested.where("blocks = 1"), rows.where("blocks = 1"), keys, groups)
    if total["max_n"] > BLOCK:  # what goes to every block of a long list goes there once
        many = requested.where("blocks > 1").select(*keys, "list", "query", F.coalesce("earlier", F.lit("[]")).alias("earlier"), "blocks", "chunks")
        form = ["list", "query", "earlier"]
        forms = _met(many.select(*form, "blocks", "chunks").distinct(), rows.where("blocks > 1"), form, groups)
        found = found.unionByName(many.select(*keys, *form).join(_least(forms, form), form).drop(*form))
    return _least(found, keys)


def _least(found: DataFrame, keys: list[str]) -> DataFrame:
    """The best of each request's entries."""
    best = F.min(F.struct((-F.col("tenths")).alias("order"), "entry_id", "media_type", "quality"))
    return found.groupBy(*keys).agg(best.alias("b")).select(*keys, (-F.col("b.order")).alias("tenths"), "b.entry_id", "b.media_type", "b.quality")


def _met(requested: DataFrame, rows: DataFrame, keys: list[str], groups: int) -> DataFrame:
    """Requests and rows of lists, each chunk with each block."""
    group = F.pmod(F.xxhash64("list", "block", "chunk"), F.lit(groups)).cast("int").alias("_g")
    each = lambda n: F.explode(F.sequence(F.lit(0), F.col(n) - 1))
    left = requested.withColumn("chunk", F.pmod(F.xxhash64("query", "earlier"), F.col("chunks")).cast("int")).withColumn("block", each("blocks"))
    right = rows.withColumn("block", F.pmod(F.xxhash64("entry_id"), F.col("blocks")).cast("int")).withColumn("chunk", each("chunks"))
    left, right = left.select(group, *dict.fromkeys([*keys, "list", "query", "earlier"])), right.select(group, *rows.columns).drop("blocks", "chunks")
    kind = lambda df, c: f"{c} {df.schema[c].dataType.simpleString()}"
    kinds = ", ".join([*[kind(requested, k) for k in keys], "tenths bigint", kind(rows, "entry_id"), "media_type string", "quality string"])
    return left.groupBy("_g").cogroup(right.groupBy("_g")).applyInArrow(_searcher(keys, FREQUENT), kinds)


def _lists(terms: DataFrame, catalog: DataFrame) -> tuple[DataFrame, DataFrame | None]:
    """Of each entry its lists and the requested values that it hits in part only; ``term, wides, m`` of the requested values that go to lists of held values."""
    from beatloom.operators import search

    holders = catalog.select("entry_id", "held").distinct().select("entry_id", F.col("held").alias("all"), F.explode("held").alias("held"))
    values = written(holders.groupBy("held").agg(F.count(F.lit(1)).alias("n")), "best-values")
    pairs = written(search.containing_pairs(terms.select(F.col("term").alias("req")), values), "best-pairs")
    hits = pairs.groupBy("held").agg(F.collect_list(F.struct("req", "exact")).alias("hits"), (F.count(F.when(~F.col("exact"), 1)) > WIDE).alias("wide"))
    reqs = lambda c, exact: F.transform(F.filter(c, lambda h: h["exact"] == exact), lambda h: h["req"])
    found = joined_unique(holders, hits.join(values, "held"), "held", "n").groupBy("entry_id", "all").agg(
        F.flatten(F.collect_list(reqs(F.col("hits"), True))).alias("whole"), F.flatten(F.collect_list(reqs(F.col("hits"), False))).alias("some"),
        F.flatten(F.collect_list(F.when(~F.col("wide"), reqs(F.col("hits"), False)))).alias("near"), F.collect_list(F.when(F.col("wide"), F.col("held"))).alias("wides"),
    )
    of = lambda c, mark, gate: F.transform(c, lambda v: F.struct(F.concat(F.lit(mark), v).alias("list"), F.lit(gate).alias("gate"), F.lit(gate == search.EXACT).alias("whole")))
    listed = F.concat(of("whole", "=", search.EXACT), of(F.array_except("near", "whole"), "=", search.PARTIAL), of("wides", "~", search.PARTIAL))
    found = found.select("entry_id", F.col("all").alias("held"), listed.alias("lists"), F.array_except("some", "whole").alias("partial"))
    if not terms.where("term = ''").isEmpty():  # requests without entities see all entries
        every = catalog.select("entry_id", "held").distinct().join(found, ["entry_id", "held"], "left")
        found = every.withColumn("lists", F.concat(F.coalesce("lists", F.expr("filter(array(named_struct('list', '', 'gate', 0, 'whole', false)), x -> false)")), of(F.array(F.lit("")), "=", 0)))
    wide = pairs.where("not exact").join(hits.where("wide").select("held"), "held")
    if wide.isEmpty():
        return written(found, "best-lists"), None
    wide = wide.groupBy("req").agg(F.collect_list(F.concat(F.lit("~"), "held")).alias("wides")).select(F.col("req").alias("term"), "wides").join(terms, "term")
    return written(found, "best-lists"), wide


def _searcher(keys: list[str], frequent: int) -> Callable:
    """The search of a group's requests in its lists, as a function of two Arrow tables."""
    from beatloom.operators.search import EXACT, PARTIAL

    def run(left, right):  # noqa: ANN001, ANN202 - Arrow tables
        import json

        import numpy as np
        import pyarrow as pa
        import pyarrow.compute as pc

        right = right.sort_by([("list", "ascending"), ("entry_id", "ascending")]).combine_chunks()
        names = pc.unique(right["list"])
        left = left.append_column("_l", pc.index_in(left["list"], value_set=names))
        left = left.filter(pc.is_valid(left["_l"])).combine_chunks()
        plain = lambda column: column.combine_chunks() if isinstance(column, pa.ChunkedArray) else column
        coded = lambda column: plain(plain(column).dictionary_encode())
        queries, before = coded(left["query"]), coded(pc.fill_null(left["earlier"], "[]"))
        words = [q.split() for q in queries.dictionary.to_pylist()]
        earlier = [json.loads(x) for x in before.dictionary.to_pylist()]
        code = pc.index_in(right["list"], value_set=names).to_numpy()
        starts = np.searchsorted(code, np.arange(len(names) + 1))
        points = _postings(right, code, {w for ws in words for w in ws}, (("description", 3), ("topic", 5), ("tags", 10)))
        partial = _postings(right, code, {x for xs in earlier for x in xs}, (("partial", 1),))
        base = (right["gate"].to_numpy() - right["penalty"].to_numpy()).astype(np.int64)
        n_q, n_x = max(1, len(words)), max(1, len(earlier))
        every = (left["_l"].to_numpy().astype(np.int64) * n_q + queries.indices.to_numpy()) * n_x + before.indices.to_numpy()
        units, back = np.unique(every, return_inverse=True)
        row, tenths = np.zeros(len(units), dtype=np.int64), np.zeros(len(units), dtype=np.int64)
        current, kept, scratch = -1, {}, np.zeros(right.num_rows, dtype=np.int64)
        for i, unit in enumerate(units.tolist()):
            rest, x = divmod(unit, n_x)
            at_list, q = divmod(rest, n_q)
            if at_list != current:
                current, kept, lo, hi = at_list, {}, starts[at_list], starts[at_list + 1]
            lists = [(w, found) for w in words[q] if (found := points.get((at_list, w)))]
            common = [(w, found) for w, found in lists if len(found[0]) >= frequent]
            demoted = [v for v in earlier[x] if (at_list, v) in partial]
            known = (*demoted, None, *[w for w, _ in common])
            if known not in kept:
                if len(kept) * (hi - lo) > 4_000_000:
                    kept.clear()
                score = base[lo:hi].copy()
                if demoted:  # points of a partial hit instead of a whole one
                    score[np.unique(np.concatenate([partial[at_list, v][0] for v in demoted])) - lo] -= EXACT - PARTIAL
                for _, (where, value) in common:
                    score[where - lo] += value
                kept[known] = score, int(np.argmax(score))
            score, first = kept[known]  # the first of the best: in the order of entry_id
            most, place = score[first], first + lo
            rare = [found for _, found in lists if len(found[0]) < frequent]
            if rare:
                where = rare[0][0] if len(rare) == 1 else np.concatenate([w for w, _ in rare])
                for w, value in rare:
                    scratch[w] += value
                sums = score[where - lo] + scratch[where]
                scratch[where] = 0
                top = sums.max()
                if top >= most:
                    other = where[sums == top].min()
                    most, place = (top, other) if top > most else (most, min(place, other))
            row[i], tenths[i] = place, most
        taken = pa.array(row[back])
        columns = {k: left[k] for k in keys} | {"tenths": pa.array(tenths[back])}
        return pa.table(columns | {k: right[k].take(taken) for k in ("entry_id", "media_type", "quality")})

    return run


def _postings(table, code, wanted: set, columns) -> dict:  # noqa: ANN001
    """``(list, value)`` to the rows of the list that hold the value, in their order, and its points there."""
    import numpy as np
    import pyarrow as pa
    import pyarrow.compute as pc

    if not wanted or not table.num_rows:
        return {}
    values = sorted(wanted)
    rows, ids, points = [], [], []
    for column, value in columns:
        held = table[column].combine_chunks()
        if isinstance(held, pa.ChunkedArray):
            held = pa.concat_arrays(held.chunks)
        found = pc.index_in(pc.list_flatten(held), value_set=pa.array(values, type=pa.string()))
        there = pc.is_valid(found).to_numpy(zero_copy_only=False)
        rows.append(pc.list_parent_indices(held).to_numpy()[there].astype(np.int64))
        ids.append(found.drop_null().to_numpy().astype(np.int64))
        points.append(np.full(len(ids[-1]), value, dtype=np.int64))
    rows, ids, points = (np.concatenate(x) for x in (rows, ids, points))
    if not len(rows):
        return {}
    key = code[rows].astype(np.int64) * len(values) + ids
    order = np.lexsort((rows, key))
    key, rows, points = key[order], rows[order], points[order]
    new = np.flatnonzero(np.r_[True, (key[1:] != key[:-1]) | (rows[1:] != rows[:-1])])
    key, rows, points = key[new], rows[new], np.add.reduceat(points, new)
    cuts = np.flatnonzero(np.r_[True, key[1:] != key[:-1]])
    ends = np.r_[cuts[1:], len(key)]
    return {(k // len(values), values[k % len(values)]): (rows[a:b], points[a:b]) for k, a, b in zip(key[cuts].tolist(), cuts.tolist(), ends.tolist())}
