"""Detecting texts that lost their end, and the storage limits that cut them.

The length of every text is recomputed under several encodings (characters,
UTF-8 bytes, UTF-16 units, HTML- and JSON-escaped, CRLF line ends) and counted
for each source. A field limit shows as a length that more texts reach than its
neighbours let expect: a test of significance, alike for small and large sources.
Limits and endings then decide together. Everything is built-in SQL;
vocabularies are counted over all rows, and the taken-apart texts are written to
the shared folder once.

A sentence without its stop is cut

* at a limit of its source, or if white space or a comma ends it;
* after a finished sentence in the same text;
* if its last word is the beginning of a known word but not one itself;
* if its last two words never end a text, although they occur often enough for that,
  or the last is an article, preposition or conjunction;
* if it opens like finished sentences do (its first three words, names and numbers left out).

Any other text without a stop is a complete phrase.

Defined cases:

* null and blank texts, whole sentences (also in quotes), teasers (an ellipsis
  away from any limit), and complete titles, phrases and lists are not cut;
* a text that ends in white space, a comma or a dangling separator is judged as what precedes it, and a
  sentence then is cut;
* a list or title with several items is cut if its last item only begins a known
  item, or at a limit unless the last item is a known whole one;
* a one-word text of a spaced script is a title, never a cut sentence;
* repeated rows are judged alike; empty tables give empty results; other columns of any name do not matter.
"""

from __future__ import annotations

from functools import reduce

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from beatloom.session import written

#: A length is a limit if it has so many times the texts of a usual neighbouring length, and so much surprise (the logarithm
#: of how much less likely its number of different texts is at the usual rate than at its own).
LIMIT_TIMES, SURPRISE = 8.0, 12.0
#: Neighbouring lengths on each side that a spike is held against.
NEIGHBOURS = 12
#: An ellipsis so far below a limit still came from cutting at it (white space is stripped before it is put on).
SLACK = 10
#: A text of phrases of so few words between commas is a list if it starts in lower case or has so many of them.
MAX_ITEM_WORDS, LIST_ITEMS = 4, 4

#: Two words never end a text if so many ends were to be expected of them (by the share of last words) and there is none.
EXPECTED_ENDS = 7.0
#: Words that tell how a sentence opens.
OPENING = 3

# Articles, prepositions and conjunctions, which end no sentence.
DANGLING = (
    "the", "a", "an", "of", "to", "and", "or", "but", "in", "on", "at", "by", "for", "from", "with", "into", "than", "that", "which", "le", "la", "les", "un", "une", "des", "du", "de", "et", "ou", "mais", "dans", "sur", "par", "pour", "avec", "qui", "que",
    "der", "die", "das", "den", "dem", "ein", "eine", "einen", "und", "oder", "aber", "von", "zu", "mit", "für", "auf", "im", "el", "los", "las", "una", "y", "o", "pero", "en", "por", "para", "con", "il", "lo", "gli", "uno", "di", "da", "per", "tra", "e", "ma",
    "os", "as", "um", "uma", "do", "dos", "no", "na", "em", "mas", "и", "или", "но", "в", "на", "с", "из", "для", "к", "от", "по", "و", "في", "من", "إلى", "على", "और", "या", "में", "से", "का", "की", "के",
)

_STOP = "[.!?。！？।؟]"
_CLOSE = "[\"”»’')\\]]*"
_WHOLE = rf"{_STOP}{_CLOSE}$"
_ELLIPSIS = rf"(?:…|\.\.\.){_CLOSE}$"
_UNSPACED = r"[\x{3040}-\x{30FF}\x{4E00}-\x{9FFF}]"
_TITLE = r"^[\p{Lu}\d'’.&;-]{2,}(?:\s|$)"
_SEPARATORS = r"\s+[/|:—–-]\s+"
_BETWEEN = r"[\s\"'“”«»‘’(),;:.!?…。！？।؟]+"


def encodings(text: Column) -> dict[str, Column]:
    """Lengths of a text as different writers would have measured it."""
    chars = F.length(text)
    times = lambda pattern: F.regexp_count(text, F.lit(pattern))
    astral = times(r"[\x{10000}-\x{10FFFF}]")
    return {
        "chars": chars,
        "utf8": F.octet_length(text),
        "utf16": chars + astral,
        "html": chars + times("&") * 4 + times("[<>]") * 3 + times("[\"']") * 5,
        "json": chars + times(r'["\\\n\r\t]') + times(r"[^\x{00}-\x{7F}]") * 5 + astral * 6,
        "crlf": chars + times(r"(?<!\r)\n"),
    }


def texts(df: DataFrame, table: str, key: str, source: str, text: str) -> DataFrame:
    """Rows ``src_table, row_key, source, body`` with the text's class of ending."""
    rows = df.select(F.lit(table).alias("src_table"), F.col(f"`{key}`").cast("bigint").alias("row_key"), F.col(f"`{source}`").alias("source"), F.col(f"`{text}`").alias("stored"))
    rows = rows.where(F.col("stored").rlike(r"[^\s\x{A0}]")).withColumn("body", F.regexp_replace("stored", r"[\s\x{A0}]+$", ""))
    bare = F.regexp_replace("body", _ELLIPSIS, "")
    ellipsis = F.col("body").rlike(_ELLIPSIS)
    rows = rows.withColumns({"ellipsis": ellipsis, "whole": ~ellipsis & F.col("body").rlike(_WHOLE), "core": F.when(ellipsis, bare).otherwise(F.col("body"))})
    commas = F.split("core", r",\s+|,$")
    listed = (F.col("core").rlike(r"^\p{Ll}") | (F.size(commas) >= LIST_ITEMS)) & ~F.col("core").rlike(rf"{_STOP}\s") & ~F.exists(commas, lambda x: F.size(F.split(x, r"\s+")) > MAX_ITEM_WORDS)
    title = F.col("core").rlike(_TITLE) & F.col("core").rlike(rf"{_SEPARATORS}|^[^\p{{Ll}}]+$") & ~F.col("core").rlike(rf"\p{{Ll}}{_STOP}\s+\p{{Lu}}")
    rows = rows.withColumn("shape", F.when(F.col("whole"), "whole").when(listed, "list").when(title, "title").otherwise("sentence"))
    pieces = F.when(F.col("shape") == "list", F.split("core", r",\s+")).when(F.col("shape") == "title", F.split("core", _SEPARATORS))
    rows = rows.withColumns({"items": pieces, "words": F.filter(F.split("core", _BETWEEN), lambda w: w != "")})
    # names and numbers fill the slots of openings and pairs: a word with a capital or a digit becomes ``*``
    slot = lambda w: (F.lower(w) != w) | (F.translate(w, "0123456789", "") != w)
    rows = rows.withColumn("general", F.transform("words", lambda w: F.when(slot(w), "*").otherwise(w)))
    spaced = F.concat_ws(" ", F.lower(F.get("words", F.lit(0))), F.concat_ws(" ", F.slice("general", 2, OPENING - 1)))
    open_ended = lambda c: F.when(~F.col("whole"), c)
    return rows.withColumns(
        {
            "last_item": F.element_at("items", -1),
            "last_word": F.get("words", F.size("words") - 1),
            "pairs": F.zip_with("general", F.slice("general", 2, F.greatest(F.size("general") - 1, F.lit(0))), lambda a, b: F.concat_ws(" ", a, b)),
            "opening": F.when(F.col("shape").isin("whole", "sentence"), F.when(F.col("core").rlike(_UNSPACED), F.substring("core", 1, 2)).when(F.size("words") >= OPENING, spaced)),
            "follows": open_ended(F.col("core").rlike(rf"{_STOP}{_CLOSE}\s+\S|[。！？]{_CLOSE}\S")),
            "breaks": open_ended(F.col("stored").rlike(r"[\s\x{A0}]$") | F.col("core").rlike(r"[,，、]$")),
            "n_words": open_ended(F.size(F.split("core", r"\s+"))),
        }
    ).drop("general", "body")


def limits(rows: DataFrame) -> DataFrame:
    """Spikes in the lengths of unfinished texts, repeated ones counted once: ``src_table, source, encoding, at_length, n_texts, n_usual``."""
    open_ended = rows.where("not whole")
    lengths = F.array(*[F.struct(F.lit(name).alias("encoding"), c.alias("at_length")) for name, c in encodings(F.col("stored")).items()])
    once = open_ended.groupBy("src_table", "source", F.xxhash64("stored").alias("text_hash")).agg(F.first(lengths).alias("lengths"))
    measured = once.select("src_table", "source", F.explode("lengths").alias("l")).select("src_table", "source", "l.encoding", "l.at_length")
    counts = measured.groupBy("src_table", "source", "encoding", "at_length").agg(F.count(F.lit(1)).alias("n_texts"))
    near = Window.partitionBy("src_table", "source", "encoding").orderBy("at_length").rangeBetween(-NEIGHBOURS, NEIGHBOURS)
    usual = (F.sum("n_texts").over(near) - F.col("n_texts")) / F.lit(2.0 * NEIGHBOURS)
    rate, n = F.greatest("n_usual", F.lit(1.0 / NEIGHBOURS)), F.col("n_texts")
    return counts.withColumn("n_usual", usual).where((n >= LIMIT_TIMES * rate) & (n * F.log(n / rate) - (n - rate) >= SURPRISE))


def _at_limit(rows: DataFrame, found: DataFrame) -> DataFrame:
    """Adds ``at_limit`` and ``near_limit`` from the limits found for the row's source.

    The limits are an aggregate of one row for each source and spike: a handful,
    whatever the number of texts.
    """
    per_source = found.groupBy("src_table", "source").agg(F.collect_set(F.struct("encoding", "at_length")).alias("spikes")).withColumnRenamed("src_table", "l_table").withColumnRenamed("source", "l_source")
    joined = rows.join(per_source, (F.col("src_table") == F.col("l_table")) & F.col("source").eqNullSafe(F.col("l_source")), "left")
    measured = encodings(F.col("stored"))

    def within(slack: int) -> Column:
        def meets(name: str, c: Column) -> Column:
            return F.exists("spikes", lambda s: (s["encoding"] == name) & c.between(s["at_length"] - slack, s["at_length"]))

        return F.coalesce(reduce(lambda a, b: a | b, (meets(*x) for x in measured.items())), F.lit(False))

    return joined.withColumns({"at_limit": within(0), "near_limit": within(SLACK)}).drop("spikes", "l_table", "l_source")


def _beginnings(known: DataFrame, wanted: DataFrame, name: str) -> DataFrame:
    """The values of column ``name`` of ``wanted`` that are the beginning of a longer known value.

    Only beginnings of lengths that are wanted are formed; the lengths come as one row.
    """
    sizes = F.broadcast(wanted.agg(F.sort_array(F.collect_set(F.length(name))).alias("sizes")))
    cut = known.join(sizes, F.lit(True)).select(F.explode(F.transform(F.filter("sizes", lambda k: k < F.length(name)), lambda k: F.substring(F.col(name), F.lit(1), k))).alias(name))
    return cut.join(wanted.select(name).distinct(), name, "left_semi").distinct()


def judged(rows: DataFrame) -> DataFrame:
    """Adds ``cut`` to the unfinished ones of rows as from :func:`texts`; texts and limits are written while the query is built."""
    rows = written(rows, "taken-apart")
    whole = rows.where("whole")
    # the pairs of words end with a single last word, which is left out; whole texts end with the pair before it
    last_pair = F.get("pairs", F.size("pairs") - 2)
    unfinished = rows.where("not whole").withColumn("last_pair", last_pair)
    before_last = lambda c, n: F.slice(c, F.lit(1), F.greatest(F.size(c) - n, F.lit(0)))
    told = lambda df, key, what: df.select(F.col(key).alias("key"), F.lit(what).alias("what"))

    items = rows.where("size(items) > 2").select(F.explode(F.slice("items", F.lit(2), F.size("items") - 2)).alias("last_item")).where("last_item <> ''").distinct()
    item_starts = _beginnings(items, unfinished.where("last_item is not null"), "last_item")
    vocabulary = rows.select(F.explode(before_last("words", 1)).alias("last_word")).unionByName(whole.select("last_word")).distinct()
    unknown = written(unfinished.where("last_word is not null").select("last_word").distinct().join(vocabulary, "last_word", "left_anti"), "unknown-words")
    inside = whole.select(F.explode(before_last("pairs", 2)).alias("last_pair")).groupBy("last_pair").agg(F.count(F.lit(1)).alias("n_inside"))
    share = F.broadcast(whole.agg((F.count(F.lit(1)) / F.greatest(F.sum(F.size("words")), F.lit(1))).alias("share")))
    often = inside.join(share, F.lit(True)).where((F.col("n_inside") * F.col("share") >= EXPECTED_ENDS) & (F.col("last_pair") != "* *"))  # two slots tell nothing
    going_on = often.join(whole.select(last_pair.alias("last_pair")), "last_pair", "left_anti")
    openings = whole.where("opening is not null").select("opening").distinct()
    kinds = (told(items, "last_item", "item_known"), told(item_starts, "last_item", "item_starts"), told(unknown, "last_word", "word_unknown"), told(_beginnings(vocabulary, unknown, "last_word"), "last_word", "word_starts"), told(going_on, "last_pair", "never_ends"), told(openings, "opening", "opens"))
    evidence = written(reduce(DataFrame.unionByName, kinds), "evidence")

    marked = _at_limit(unfinished, written(limits(rows), "limits"))
    for what, key in (("item_known", "last_item"), ("item_starts", "last_item"), ("word_unknown", "last_word"), ("word_starts", "last_word"), ("never_ends", "last_pair"), ("opens", "opening")):
        found = evidence.where(F.col("what") == what).select(F.col("key").alias(key), F.lit(True).alias(what))
        marked = marked.join(found, key, "left").withColumn(what, F.coalesce(what, F.lit(False)))
    phrase_cut = F.col("core").rlike(r"(?:,|\s[/|:—–-])$") | (~F.col("item_known") & (F.col("item_starts") | F.col("at_limit")) & (F.size("items") > 1))
    spoken = (F.col("n_words") >= 2) | F.col("core").rlike(_UNSPACED)
    fragment = F.when(F.col("n_words") == 2, F.col("word_unknown")).otherwise(F.col("word_starts"))
    sentence_cut = spoken & (F.col("at_limit") | F.col("breaks") | F.col("follows") | fragment | F.col("never_ends") | F.lower("last_word").isin(*DANGLING) | F.col("opens"))
    cut = F.when(F.col("ellipsis"), F.col("near_limit")).when(F.col("shape") == "sentence", sentence_cut).otherwise(phrase_cut)
    return marked.withColumn("cut", F.coalesce(cut, F.lit(False)))


def rates(rows: DataFrame) -> DataFrame:
    """How often each source truncates: ``src_table, source, n_texts, n_cut, share_cut``; one pass over the judged texts."""
    cut = judged(rows).where("cut").groupBy("src_table", "source").agg(F.count(F.lit(1)).alias("n_cut"))
    all_texts = rows.groupBy("src_table", "source").agg(F.count(F.lit(1)).alias("n_texts"))
    c = cut.select(F.col("src_table").alias("c_table"), F.col("source").alias("c_source"), "n_cut")
    joined = all_texts.join(c, (F.col("src_table") == F.col("c_table")) & F.col("source").eqNullSafe(F.col("c_source")), "left")
    n_cut = F.coalesce("n_cut", F.lit(0)).cast("bigint")
    return joined.select("src_table", "source", "n_texts", n_cut.alias("n_cut"), F.round(n_cut / F.col("n_texts"), 6).alias("share_cut"))
