"""Mapping freely typed values to a canonical list by a pigeonhole join.

A string within ``k`` edits of a reference string keeps at least one of any
``k + 1`` disjoint segments of it unchanged, and one of them so near to its own
place that few shifts remain to be tried. Reference strings are cut into
``k + 1`` segments and joined by equality with the substrings of the typed values
at those places, so only pairs that share a segment are ever compared;
``levenshtein`` then verifies them. SQL built-ins only.

Typed values are folded first: letter case, accents, look-alike letters,
decorations and the writing of designations. Every value is matched once,
however many rows carry it, in several forms that all go through the same join:
as written, with the first or last word moved, as initials, and word by word.
Abbreviations are not listed anywhere: the words that a value shares with an
entry are met by the join, and the others may be shortened to any beginning of
the entry's word, to its consonants or to its first and last letter.

Defined cases:

* null and blank values and values spelled exactly as a name are no case;
* one edit is allowed for every ``LETTERS_AN_EDIT`` letters of the name, at most ``EDITS``;
* designations (words with a digit) must agree exactly: names that differ
  in them are different entities;
* initials mean a name of three words or more, letter for letter;
* a value with abbreviations has the words of the name, at least one of them of
  ``LETTERS_AN_EDIT`` letters within its edits, all edits together within the name's;
* a value nearest to two entries at once, or near to none, is reported as -1;
* an empty reference list reports every value as -1; repeated values are all mapped;
* other columns of the inputs, whatever their names, do not matter.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from beatloom.operators.skew import joined_unique
from beatloom.session import written

#: Edits allowed at most, and the letters of a name that allow one.
EDITS, LETTERS_AN_EDIT = 2, 4
#: Names of so many words have initials.
INITIALS_WORDS = 3

# Accented Latin and look-alike Cyrillic and Greek letters, and what they stand for.
_MARKED = "àáâãäåāăąçćčďđèéêëēĕėęěìíîïīĭįıñńňòóôõöøōŏőùúûüūŭůűýÿźżžšśťţłаеорсухіјѕԁιοναε×"
_PLAIN = "aaaaaaaaacccddeeeeeeeeeiiiiiiiinnnooooooooouuuuuuuuyyzzzssttlaeopcyxijsdiovaex"

# The Roman numerals of designations.
_ROMAN = ("i", "ii", "iii", "iv", "v", "vi", "vii", "viii", "ix", "x", "xi", "xii")


def _undecorated(value: Column) -> Column:
    """A typed value in plain lower-case letters, without article, quotes, tags and added notes."""
    v = F.translate(F.lower(value), _MARKED, _PLAIN)
    v = F.regexp_replace(v, r"\p{M}+", "")
    v = F.regexp_replace(v, r"[_\x{A0}\s]+", " ")
    v = F.regexp_replace(v, r"^[\s#\"'“”«»*]+|[\s\"'“”«»*,;:!]+$", "")
    v = F.regexp_replace(v, r"(?:[\s-]*\([^()]*\)|\s+[-–—]\s+\p{L}+|-{3}\p{L}+)+[\s.,;]*$", "")
    return F.regexp_replace(v, r"^(?:the[\s-]+[\s#]*)+", "")


def folded(value: Column) -> Column:
    """A typed value without case, accents, decorations and variants of writing."""
    v = F.regexp_replace(_undecorated(value), r"^([^,]+),\s*([^,]+)$", "$2 $1")
    v = F.trim(F.regexp_replace(v, r"[^\p{L}\p{N}]+", " "))
    v = F.regexp_replace(v, r"\b(\d+) x (\d+)\b", "$1x$2")
    v = F.regexp_replace(v, r"\b(\d) ([a-z])\b", "$1$2")
    v = F.regexp_replace(F.regexp_replace(v, r"\bclass type\b", "class"), r"\bmark\b", "mk")
    numerals = F.create_map(*[F.lit(x) for i, r in enumerate(_ROMAN) for x in (r, str(i + 1))])
    roman = F.try_element_at(numerals, F.regexp_extract(v, r"\bmk ([ivx]+)\b", 1))
    v = F.when(roman.isNotNull(), F.regexp_replace(v, F.lit(r"\bmk [ivx]+\b"), F.concat(F.lit("mk"), roman))).otherwise(v)
    v = F.regexp_replace(v, r"\bmk (\d+)\b", "mk$1")
    return F.regexp_replace(v, r"\b([a-z]{2}) (\d{2,3})\b", "$1$2")


def _initials(value: Column) -> Column:
    """The letters of a value that is nothing but initials, else null."""
    v = _undecorated(value)
    return F.when(v.rlike(rf"^(?:[a-z]\.){{{INITIALS_WORDS},}}\.*$|^(?:[a-z]\. ){{{INITIALS_WORDS - 1},}}[a-z]\.?$|^[a-z]{{{INITIALS_WORDS},}}$"), F.regexp_replace(v, r"[.\s]", ""))


def _designation(v: Column) -> Column:
    """The words with a digit, in order of their spelling."""
    return F.array_join(F.array_sort(F.filter(F.split(v, " "), lambda w: w.rlike(r"\d"))), " ")


def _squashed(v: Column) -> Column:
    return F.replace(v, F.lit(" "), F.lit(""))


def _edits(length: Column) -> Column:
    return F.least(F.lit(EDITS), F.floor(length / F.lit(LETTERS_AN_EDIT))).cast("int")


def reference_strings(reference: DataFrame, key: str, name: str) -> DataFrame:
    """``ref_id, form, ref_text, ref_codes, k, folded_name``: the strings that each entry is met by, and the edits each allows."""
    rows = reference.select(F.col(f"`{key}`").cast("bigint").alias("ref_id"), F.col(f"`{name}`").alias("ref_name")).where("ref_id is not null and trim(ref_name) <> ''")
    rows = rows.withColumn("folded_name", folded(F.col("ref_name"))).withColumn("words", F.split(F.lower("ref_name"), r"\s+"))
    text = _squashed(F.col("folded_name"))
    as_name = F.struct(F.lit("name").alias("form"), text.alias("ref_text"), _designation(F.col("folded_name")).alias("ref_codes"), _edits(F.length(text)).alias("k"))
    initials = F.array_join(F.transform("words", lambda w: F.substring(w, 1, 1)), "")
    as_initials = F.struct(F.lit("initials").alias("form"), initials.alias("ref_text"), F.lit("").alias("ref_codes"), F.lit(0).alias("k"))
    own_words = F.filter(F.array_distinct(F.split("folded_name", " ")), lambda w: F.length(w) >= LETTERS_AN_EDIT)
    as_words = F.transform(own_words, lambda w: F.struct(F.lit("word").alias("form"), w.alias("ref_text"), F.lit("").alias("ref_codes"), _edits(F.length(w)).alias("k")))
    forms = F.concat(F.when(F.size("words") >= INITIALS_WORDS, F.array(as_name, as_initials)).otherwise(F.array(as_name)), as_words)
    return rows.select("ref_id", "folded_name", F.explode(forms).alias("s")).select("ref_id", "folded_name", "s.*")


def _turned(f: Column) -> Column:
    """A text as it is, with its first word at the end, and with its last word in front."""
    words = F.split(f, " ")
    behind, ahead = F.slice(words, 2, F.greatest(F.size(words) - 1, F.lit(0))), F.slice(words, F.lit(1), F.greatest(F.size(words) - 1, F.lit(0)))
    return F.array(f, F.concat_ws(" ", behind, F.element_at(words, 1)), F.concat_ws(" ", F.element_at(words, -1), ahead))


def typed_forms(distinct: DataFrame) -> DataFrame:
    """``value, form, text, codes, route`` of distinct folded values ``value, f``: every string that a value may be met by."""
    named = distinct.where("f <> ''").select("value", _designation(F.col("f")).alias("codes"), F.posexplode(F.transform(_turned(F.col("f")), _squashed)).alias("turn", "text"))
    named = named.groupBy("value", "text", "codes").agg(F.min("turn").alias("turn")).select("value", F.lit("name").alias("form"), "text", "codes", F.when(F.col("turn") > 0, "turned").otherwise("written").alias("route"))
    short = distinct.withColumn("i", _initials(F.col("value"))).where("i is not null").select("value", F.lit("initials").alias("form"), F.col("i").alias("text"), F.lit("").alias("codes"), F.lit("initials").alias("route"))
    words = distinct.select("value", F.explode(F.array_distinct(F.split("f", " "))).alias("text")).where(F.length("text") >= LETTERS_AN_EDIT)
    return named.unionByName(short).unionByName(words.select("value", F.lit("word").alias("form"), "text", F.lit("").alias("codes"), F.lit("word").alias("route")))


def _shortened(pairs: DataFrame, distinct: DataFrame, strings: DataFrame) -> DataFrame:
    """``value, ref_id, distance, route`` of the pairs whose words agree one by one, in some turn, as such or as an abbreviation."""

    def cost(t: Column, w: Column) -> Column:
        bones = F.concat(F.substring(w, 1, 1), F.regexp_replace(F.substring(w, F.lit(2), F.length(w)), "[aeiou]", ""))
        ends = F.concat(F.substring(w, 1, 1), F.substring(w, F.length(w), F.lit(1)))
        abbreviates = (F.length(t) < F.length(w)) & t.rlike(r"^\p{L}+$") & (F.startswith(w, t) | (t == bones) | (t == ends))
        return F.when(abbreviates, 0).otherwise(F.levenshtein(t, w))

    names = strings.where("form = 'name'").select("ref_id", "folded_name", "ref_codes", "k")
    rows = pairs.join(distinct, "value").join(names, "ref_id").where(_designation(F.col("f")) == F.col("ref_codes"))
    words = F.split("folded_name", " ")
    costs = F.transform(_turned(F.col("f")), lambda v: F.when(F.size(F.split(v, " ")) == F.size(words), F.aggregate(F.zip_with(F.split(v, " "), words, cost), F.lit(0), lambda a, x: a + x)))
    return rows.select("value", "ref_id", F.array_min(costs).alias("distance"), "k").where("distance <= k").select("value", "ref_id", "distance", F.lit("abbreviated").alias("route"))


def _segments(strings: DataFrame) -> DataFrame:
    """Each reference string cut into ``k + 1`` segments with their places."""
    parts = strings.withColumn("ref_len", F.length("ref_text")).withColumn("seg", F.explode(F.sequence(F.lit(0), F.col("k"))))
    return parts.select("ref_id", "form", "ref_text", "ref_codes", "ref_len", "k", "seg", F.substring(F.col("ref_text"), _begin(F.col("seg")) + 1, _begin(F.col("seg") + 1) - _begin(F.col("seg"))).alias("piece"))


def _begin(segment: Column) -> Column:
    return F.floor(segment * F.col("ref_len") / (F.col("k") + 1)).cast("int")


def _wanted(forms: DataFrame, strings: DataFrame) -> DataFrame:
    """The substrings of the typed forms that could be a segment of a reference string.

    Lengths that no reference string has are passed over. Of ``k`` edits at
    most ``i`` lie before segment ``i`` and ``k - i`` behind it if it is the one
    to be looked for, which bounds its shift from both ends.
    """
    sizes = strings.select("form", F.length("ref_text").alias("ref_len"), "k").distinct().groupBy("form").agg(F.collect_set(F.struct("ref_len", "k")).alias("sizes"))
    near = lambda s: F.abs(F.length("text") - s["ref_len"]) <= s["k"]
    sized = forms.join(sizes, "form").select("value", "form", "route", "text", "codes", F.explode(F.filter("sizes", near)).alias("s")).select("value", "form", "route", "text", "codes", "s.*")
    cut = sized.withColumn("seg", F.explode(F.sequence(F.lit(0), F.col("k")))).withColumns({"at": _begin(F.col("seg")), "size": _begin(F.col("seg") + 1) - _begin(F.col("seg"))})
    longer = F.length("text") - F.col("ref_len")
    behind = F.col("k") - F.col("seg")
    lo, hi = F.greatest(-F.col("seg"), longer - behind), F.least(F.col("seg"), longer + behind)
    shifts = F.when(lo <= hi, F.sequence(lo, hi)).otherwise(F.array().cast("array<int>"))
    placed = cut.withColumn("from", F.explode(F.filter(F.transform(shifts, lambda d: d + F.col("at")), lambda p: (p >= 0) & (p + F.col("size") <= F.length("text")))))
    return placed.select("value", "form", "route", "text", "codes", "ref_len", "k", "seg", F.substring(F.col("text"), F.col("from") + 1, F.col("size")).alias("piece")).distinct()


def mapped_values(values: DataFrame, reference: DataFrame, key: str, name: str) -> DataFrame:
    """``value, entity_id, distance, route`` of each of the distinct values that is near an entry; -1 if it is near several alike."""
    strings = reference_strings(reference, key, name)
    distinct = written(values.where("trim(value) <> ''").select("value", folded(F.col("value")).alias("f")), "folded-values")
    forms = written(typed_forms(distinct), "typed-forms")
    met = _wanted(forms, strings).join(_segments(strings), ["form", "ref_len", "k", "seg", "piece"]).where(F.col("codes") == F.col("ref_codes")).select("value", "form", "route", "text", "ref_id", "ref_text", "k").distinct()
    met = written(met.withColumn("distance", F.levenshtein("text", "ref_text")).where("distance <= k").select("value", "ref_id", "distance", "form", "route"), "met-forms")
    near = met.where("form <> 'word'").drop("form").unionByName(_shortened(met.where("form = 'word'").select("value", "ref_id").distinct(), distinct, strings))
    best = near.groupBy("value", "ref_id").agg(F.min(F.struct("distance", "route")).alias("b"))
    alike = best.groupBy("value", "b.distance").agg(F.count(F.lit(1)).alias("n"), F.min("ref_id").alias("ref_id"), F.min("b.route").alias("route"))
    nearest = alike.groupBy("value").agg(F.min(F.struct("distance", "n", "ref_id", "route")).alias("first")).select("value", "first.*")
    return nearest.select("value", F.when(F.col("n") == 1, F.col("ref_id")).otherwise(F.lit(-1)).cast("bigint").alias("entity_id"), "distance", "route")


def cases(items: DataFrame, reference: DataFrame, name: str = "name") -> DataFrame:
    """The items that are neither blank nor spelled exactly as a name, written once."""
    names = reference.select(F.col(f"`{name}`").alias("value")).distinct()
    return written(items.where("regexp_replace(value, '[\\\\s\\\\x{A0}]+', '') <> ''").join(names, "value", "left_anti"), "typed-items")


def counted(typed: DataFrame) -> DataFrame:
    """``value, n_items`` of the distinct values."""
    return written(typed.groupBy("value").agg(F.count(F.lit(1)).alias("n_items")), "typed-values")


def mapped_items(items: DataFrame, reference: DataFrame, key: str = "entity_id", name: str = "name") -> DataFrame:
    """``src_table, row_key, item_pos, entity_id`` of items ``(src_table, row_key, item_pos, value)`` not spelled exactly as a name.

    Items, distinct values and their forms are written to the shared folder while the query is built, each once.
    """
    typed = cases(items, reference, name)
    values = counted(typed)
    found = mapped_values(values, reference, key, name).select("value", "entity_id")
    every = values.join(found, "value", "left").select("value", F.coalesce("entity_id", F.lit(-1)).cast("bigint").alias("entity_id"), "n_items")
    return joined_unique(typed, every, "value", "n_items").select("src_table", "row_key", "item_pos", "entity_id")


def exploded(df: DataFrame, table: str, key: str, values: Column) -> DataFrame:
    """Array items as ``src_table, row_key, item_pos, value``; positions count nulls."""
    rows = df.select(F.lit(table).alias("src_table"), F.col(f"`{key}`").cast("bigint").alias("row_key"), F.posexplode(values).alias("item_pos", "value"))
    return rows.withColumn("item_pos", F.col("item_pos").cast("bigint"))
