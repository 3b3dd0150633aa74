"""Column expressions over narration text: splitting, entities, language, topic, cleaning.

White space means blank, tab, line feed, carriage return and form feed, so
that every engine splits alike. Null text gives null or an empty array.
"""

from __future__ import annotations

from functools import reduce

from pyspark.sql import Column
from pyspark.sql import functions as F

BLANK = r"[ \t\n\r\f]"

# Terms that are entities wherever they occur.
KNOWN_TERMS = (
    "Boxer", "Apache", "Seahawk", "ASLAV", "Abrams", "Bradley", "F-35", "F-22", "Rafale", "T-90", "Patriot", "Iron Dome",
    "NATO", "Army", "Navy", "Air Force", "Rheinmetall", "Boeing", "Lockheed", "BAE Systems", "Pentagon",
)

# Vehicle and location keywords of the topic analysis.
VEHICLES = ("tank", "armored", "apc", "ifv", "helicopter", "jet", "fighter", "aircraft", "warship", "submarine", "drone")
LOCATIONS = ("map", "australia", "germany", "united states", "ukraine", "middle east", "pacific", "ocean", "forest", "desert")

# Keyword groups that decide the topic, in order.
TOPIC_RULES = (("demonstrate", "show", "capability"), ("exercise", "training", "drill"), ("map", "located", "country"), ("born", "history", "founded"))

# Code blocks of the scripts told apart, in order.
SCRIPTS = {
    "ja": r"[\x{3040}-\x{309F}\x{30A0}-\x{30FF}]",
    "ko": r"[\x{AC00}-\x{D7AF}\x{1100}-\x{11FF}]",
    "ar": r"[\x{0600}-\x{06FF}\x{0750}-\x{077F}]",
    "hi": r"[\x{0900}-\x{097F}]",
    "ru": r"[\x{0400}-\x{04FF}]",
    "zh": r"[\x{4E00}-\x{9FFF}]",
}

# Marker words of the Latin languages, in order of preference.
MARKERS = {
    "fr": ("le", "la", "les", "des", "est", "une", "pour", "dans", "avec", "pas", "aux", "cette", "sont", "plus", "tout", "fait", "droit", "chars", "blindé", "militaire", "armée"),
    "de": ("der", "die", "das", "und", "ist", "ein", "eine", "von", "mit", "auf", "für", "als", "auch", "sich", "nach", "aus", "wird"),
    "es": ("el", "la", "los", "las", "del", "por", "para", "con", "que", "una", "está", "todo", "esta", "pero", "como", "muy"),
    "pt": ("o", "os", "das", "dos", "uma", "umas", "não", "mas", "seu", "sua", "como", "mais", "tem", "bem", "até", "isso"),
    "it": ("il", "la", "di", "che", "perché", "questo", "quello", "sono", "stato", "anche", "come", "più", "ma", "nel"),
}


def stripped(text: Column) -> Column:
    return F.regexp_replace(text, rf"^{BLANK}+|{BLANK}+$", "")


def words(text: Column) -> Column:
    """Words between white space."""
    return F.filter(F.split(text, rf"{BLANK}+"), lambda w: w != "")


def sentence_array(text: Column) -> Column:
    """Sentences of a text, split after a closing mark and white space."""
    return F.split(stripped(text), rf"(?<=[.!?]){BLANK}+")


def speech_centis(n_words: Column) -> Column:
    """Hundredths of a second that a speaker takes: 0.15 s a word and 1.5 s."""
    return (n_words * 15 + 150).cast("bigint")


def plain(text: Column) -> Column:
    """A text of ASCII characters: other letters and digits become ``_``, any other character a blank."""
    return F.regexp_replace(F.regexp_replace(text, r"[^\x00-\x7F\p{L}\p{N}]", " "), r"[^\x00-\x7F]", "_")


def capitalised_runs(text: Column) -> Column:
    """Runs of capitalised ASCII words; a word with other letters is none."""
    return F.regexp_extract_all(plain(text), F.lit(rf"\b([A-Z][a-z]+(?:{BLANK}+[A-Z][a-z]+)*)\b"), F.lit(1))


def entities(text: Column) -> Column:
    """The first five capitalised runs and the known terms found anywhere, at most eight, first mentions first."""
    lower = F.lower(text)
    known = F.filter(F.array(*map(F.lit, KNOWN_TERMS)), lambda t: F.contains(lower, F.lower(t)))
    return F.slice(F.array_distinct(F.concat(F.slice(capitalised_runs(text), 1, 5), known)), 1, 8)


# Families of names that are entities in any language; letter case does not matter.
FAMILIES = (
    r"\b(?:Boxer|Bradley|M1 *Abrams|T-90|T-72|ASLAV|Patria *AMV|BMP[- ]?[0-9]|Stryker) *(?:CRV|APC|IFV| variants?)?\b",
    r"\b(?:F-35[A-C]?|F-22|F-16|F/A-18|Su-[0-9]+|Rafale|Eurofighter|Typhoon)\b",
    r"\b(?:AH-64 *Apache|CH-47 *Chinook|MH-60[RST]?|UH-60|Ka-52|Mi-24|Mi-8)\b",
    r"\b(?:Aircraft *Carrier|Destroyer|Frigate|Submarine|LHD|LST)\b",
    r"\b(?:Javelin|Stinger|HIMARS|Patriot|Iron *Dome|ATACMS|Tomahawk)\b",
    r"\b(?:NATO|US Army|Australian Army|British Army|Ukrainian Armed Forces|Rheinmetall|Lockheed Martin|Boeing|BAE)\b",
    r"\b(?:Exercise +[A-Za-z0-9_]+|RIMPAC|Talisman *Sabre|Trident *Juncture)\b",
)
#: Two capitalised words in a row; here letter case matters.
PROPER = r"\b[A-Z][a-z]+ +[A-Z][a-z]+\b"


def family_entities(text: Column) -> Column:
    """Names of the known families and pairs of capitalised words, each once and trimmed, by family and place."""
    found = [F.regexp_extract_all(plain(text), F.lit(f"({p})"), F.lit(1)) for p in (*[f"(?i){f}" for f in FAMILIES], PROPER)]
    return F.array_distinct(F.transform(F.concat(*found), lambda e: F.trim(e)))


def let(value: Column, body) -> Column:
    """``body`` of a value that is computed once, however often the body names it."""
    return F.element_at(F.transform(F.array(value), body), 1)


def _among(marks: tuple[str, ...]):
    return lambda w: w.isin(*marks)


def _latin(tokens: Column) -> Column:
    """Language of Latin words by the share of its marker words."""
    counts = F.struct(F.size(tokens).alias("n"), *[F.size(F.filter(tokens, _among(marks))).alias(lang) for lang, marks in MARKERS.items()])

    def decide(c: Column) -> Column:
        best = F.greatest(*[c[lang] for lang in MARKERS])
        return reduce(lambda acc, lang: acc.when(c[lang] == best, lang), MARKERS, F.when(best * 50 <= c["n"], "en"))

    return let(counts, decide)


def language(text: Column) -> Column:
    """Language by script share, then by Latin marker words; English if nothing decides."""
    tokens = F.filter(F.regexp_extract_all(F.lower(text), F.lit(r"([\p{L}\p{N}_]+)"), F.lit(1)), lambda w: w.rlike("^[a-zA-ZÀ-ÿ]+$"))

    def by_script(letters: Column) -> Column:
        out = F.when(F.lit(False), F.lit(None).cast("string"))
        for lang, block in SCRIPTS.items():
            out = out.when((letters > 0) & (F.regexp_count(text, F.lit(block)) * 10 > letters), lang)
        return out

    short = text.isNull() | (F.length(stripped(text)) < 10)
    return F.when(short, "en").otherwise(F.coalesce(let(F.regexp_count(text, F.lit(r"\p{L}")), by_script), let(tokens, _latin)))


def topic(text: Column) -> Column:
    """``struct<topic, entities, asset_type>`` by keywords."""
    lower = F.lower(text)
    found = F.filter(F.array(*map(F.lit, (*VEHICLES, *LOCATIONS))), lambda t: F.contains(lower, t))
    says = [reduce(lambda a, b: a | b, (F.contains(lower, F.lit(w)) for w in group)) for group in TOPIC_RULES]
    named = lambda other: F.when(F.size(found) > 0, F.array_join(F.slice(found, 1, 2), " ")).otherwise(other)
    subject = F.when(says[0], named("military equipment")).when(says[1], "military exercise").when(says[2], "map").when(says[3], named("history")).otherwise(named("military"))
    kind = F.when(says[0], "both").when(says[1], "video").when(says[2] | says[3], "image").otherwise("both")
    return F.when(text.isNotNull(), F.struct(subject.alias("topic"), found.alias("entities"), kind.alias("asset_type")))


# Steps of the cleaning for speech, in order: pattern and replacement.
CLEANING = (
    (r"\*{1,2}([^*]+)\*{1,2}", "$1"),
    (rf"#{{1,6}}{BLANK}+", ""),
    (r"\[([^\]]+)\]\([^)]+\)", "$1"),
    (r"```[\s\S]*?```", ""),
    (r"`[^`]+`", ""),
    (r"\[([^\]]+)\]", ""),
    (r"\n+", " "),
    (rf"{BLANK}{{2,}}", " "),
)


def speech_text(text: Column, longest: int = 7500) -> Column:
    """Text for a speaker: no markup, pauses after sentences, at most ``longest`` characters."""
    for pattern, to in CLEANING:
        text = F.regexp_replace(text, pattern, to)
    for mark in ".!?:":
        text = F.replace(text, F.lit(f"{mark} "), F.lit(f"{mark} ... "))
    return F.substring(stripped(text), 1, longest)


def extracted_json(text: Column) -> Column:
    """``struct<how, json>``: JSON taken whole, from a fence, from the first to the last brace, or not at all."""
    fenced = F.regexp_extract(text, rf"```(?:json)?{BLANK}*\n([\s\S]*?)\n```", 1)
    first = F.instr(text, "{")
    last = F.length(text) - F.instr(F.reverse(text), "}") + 1
    inner = F.when((first > 0) & F.contains(text, F.lit("}")) & (last >= first), F.substring(text, first, last - first + 1))
    valid = lambda c: F.try_parse_json(c).isNotNull()
    how = F.when(text.isNull(), "none").when(valid(text), "whole").when(valid(fenced), "fenced").when(valid(inner), "embedded").otherwise("none")
    return F.struct(how.alias("how"), F.when(how == "whole", text).when(how == "fenced", fenced).when(how == "embedded", inner).alias("json"))
