import pytest
from beatloom.llm import language as L

TEXTS = {
    "en": "the people of the bay still tell the story of when the lamps went dark and nobody had seen the boat until a patrol met it",
    "fr": "les équipes de la ville ont noté les heures avant la dernière inspection et personne n'avait vu le bateau avant qu'une patrouille ne le croise",
    "de": "die strecke war gesperrt und die vorräte kamen mit dem schiff, niemand hatte das boot gesehen bis ihn eine streife traf",
    "es": "los equipos anotaron las horas en la unidad antes de la última revisión y nadie había visto el barco hasta que una patrulla lo encontró",
    "pt": "as equipes registraram as horas na unidade antes da última revisão e ninguém tinha visto o barco até que uma patrulha o encontrou",
    "it": "le squadre hanno segnato le ore prima dell'ultima verifica e nessuno aveva visto la nave finché una pattuglia non la incontrò",
    "ru": "дорогу перекрывали много раз и припасы привозили по реке, никто не видел машину пока её не встретил патруль",
    "ar": "أغلق الطريق مرات عديدة وجاءت المؤن عن طريق النهر ولم ير أحد السفينة حتى لقيتها دورية",
    "hi": "सड़क कई बार बंद हुई और रसद नदी के रास्ते आई जब तक गश्ती दल उससे नहीं मिला किसी ने जहाज नहीं देखा था",
    "ja": "道は何度も閉ざされ、物資は川で運ばれました。誰も船を見たことがありませんでした。",
    "ko": "길은 여러 번 막혔고 보급품은 강으로 왔으며 순찰대가 만날 때까지 아무도 배를 보지 못했다",
    "zh": "通往港口的道路被封闭了很多次，物资只能沿河运来，在巡逻队遇到它之前没有人见过这艘船",
}
LABELLED = [(lang, t) for lang, t in TEXTS.items() for _ in range(3)]


@pytest.fixture(scope="module")
def model():
    pieces = L.read_pieces()
    return L.Model(pieces, L.fit(LABELLED, pieces))


def test_forward_sums_all_segmentations(model):
    word = " the bay".encode()
    p = model.probabilities

    def ways(rest):
        if not rest:
            return 1.0
        return sum(p[model.ids[rest[:n]]] * ways(rest[n:]) for n in range(1, len(rest) + 1) if rest[:n] in model.ids)

    import numpy as np

    assert np.allclose(model.log_probability("the bay"), np.log(ways(word)), rtol=1e-9)


def test_probabilities_sum_to_one(model):
    assert abs(model.probabilities.sum(axis=0) - 1).max() < 1e-6


@pytest.mark.parametrize("lang", L.LANGUAGES)
def test_each_language(model, lang):
    found = model.segments(TEXTS[lang].rstrip("。") + (" ." if lang not in ("ja", "zh") else "。"))
    assert [s["lang"] for s in found] == [lang] and found[0]["confidence"] > 0.99


def test_segments_cover_a_mixed_text(model):
    text = f"Nobody had seen the boat. — {TEXTS['ru'].capitalize()}. (Les équipes ont noté les heures.) 道は何度も閉ざされました。誰も見ませんでした。"
    found = model.segments(text)
    assert [s["lang"] for s in found] == ["en", "ru", "fr", "ja"]
    assert found[0]["begin"] == 0 and found[-1]["end"] == len(text)
    assert all(a["end"] == b["begin"] for a, b in zip(found, found[1:]))


@pytest.mark.parametrize("text", [None, "", "  ", "Jormaresk.", "Risven Point.", "MV-26 Pacopet", "12:30 — 45", "...", "."])
def test_nothing_to_judge(model, text):
    assert model.segments(text) == []


def test_very_long_text(model):
    assert [s["lang"] for s in model.segments("the people of the bay tell the story. " * 5000 + "x" * 3000)] == ["en"]


def test_wrong_labels_in_the_sample_are_outvoted():
    pieces = L.read_pieces()
    noisy = LABELLED * 3 + [("de", TEXTS["en"]), ("en", TEXTS["fr"])]
    model = L.Model(pieces, L.fit(noisy, pieces))
    assert model.judge(TEXTS["en"])[0] == "en" and model.judge(TEXTS["fr"])[0] == "fr"


def test_labels(spark):
    from pyspark.sql import functions as F

    cases = {"en": "en", "EN": "en", "en-US": "en", "pt_BR": "pt", "German": "de", " french ": "fr", "und": None, "auto": None, "": None, " ": None, "Klingon": "?", "zh-Hant-TW": "zh"}
    df = spark.createDataFrame([(k,) for k in cases], "v string")
    assert {r["v"]: r["c"] for r in df.select("v", L.label_code(F.col("v")).alias("c")).collect()} == cases
    assert spark.createDataFrame([(None,)], "v string").select(L.label_code(F.col("v")).alias("c")).first()["c"] is None


def test_found_cases(spark):
    rows = [
        (1, "en", TEXTS["en"] + "."), (2, "fr", TEXTS["en"] + "."), (3, None, TEXTS["de"] + "."), (4, "German", TEXTS["de"] + "."), (5, "en", "nobody had seen the boat. " + TEXTS["ru"] + "."), (6, None, " "), (7, "x", None), (8, None, "Jormaresk."),
        (9, "auto", TEXTS["zh"]), (9, "auto", TEXTS["zh"]),
    ]
    df = spark.createDataFrame([(i, lang, t, "clash") for i, lang, t in rows], "row_id bigint, lang string, narration string, segments string")
    scored = L.with_segments(df, "narration", LABELLED)
    got = sorted(tuple(r) for r in L.found_cases(scored, "row_id", "lang").collect())
    assert got == [(2, "en"), (3, "de"), (5, "en"), (5, "ru"), (9, "zh"), (9, "zh")]


def test_empty(spark):
    df = spark.createDataFrame([], "row_id bigint, lang string, narration string")
    assert L.with_segments(df, "narration", LABELLED).count() == 0
    assert L.sample(df, "row_id", "narration", "lang") == []


def test_held_out_accuracy(spark, sf_dir):
    """Fitted on half of the labelled rows, the labels of the other half agree but for the planted wrong and mixed ones."""
    from pyspark.sql import functions as F

    beats = spark.read.parquet(f"{sf_dir}/beats.parquet").select("row_id", "lang", "narration_verbatim")
    labelled = L.sample(beats.where("row_id % 2 = 0"), "row_id", "narration_verbatim", "lang")
    held_out = beats.where("row_id % 2 = 1").where(L.label_code(F.col("lang")).isin(*L.LANGUAGES))
    rows = L.with_segments(held_out, "narration_verbatim", labelled).where("size(segments) > 0")
    agree = rows.select(F.avg(F.array_contains(F.transform("segments", lambda s: s["lang"]), L.label_code(F.col("lang"))).cast("double")).alias("a")).first()["a"]
    assert agree > 0.9


def test_one_rule_of_words():
    """A sentence counts the same words with a plain and with a typographic apostrophe, in ASCII and beside other letters."""
    cases = {"Nobody didn't see Mk4 well-known boats' lamps iPhone": ["didn't", "see", "well-known", "boats", "lamps", "iphone"], "'tis the end 'Tis so": ["'tis", "the", "end", "so"]}
    for sentence, want in cases.items():
        assert L.words(sentence) == L.words(sentence.replace("'", "’")) == want
        assert L.words(sentence + " é") == [*want, "é"]


def test_confidence_is_the_posterior_of_the_whole_segment(model):
    import numpy as np

    text = "the boat. the lamps went dark. a patrol met it."
    found = model.segments(text)
    total = sum(model.score(text[a:b]) for a, b in L.sentences(text))
    assert len(found) == 1 and np.isclose(found[0]["confidence"], 1 / np.exp(total - total.max()).sum())
    weakest = min(model.judge(text[a:b])[1] for a, b in L.sentences(text))
    assert found[0]["confidence"] > weakest


def test_sample_is_bounded_and_by_hash(spark):
    rows = [(i, "en" if i % 3 else "fr", f"text {i}") for i in range(3000)] + [(9001, "de", "x" * 20_000), (9002, "de", "kurz")]
    df = spark.createDataFrame(rows, "row_id bigint, lang string, narration string")
    got = L.sample(df, "row_id", "narration", "lang", 50)
    assert {lang: sum(x == lang for x, _ in got) for lang in ("en", "fr", "de")} == {"en": 50, "fr": 50, "de": 1}
    assert got == L.sample(df.repartition(7), "row_id", "narration", "lang", 50)


def test_segments_of_mixed_texts_from_the_tables(spark, sf_dir):
    """Held-out sentences of two languages set side by side: the border is found where it was put."""
    from pyspark.sql import functions as F

    beats = spark.read.parquet(f"{sf_dir}/beats.parquet").select("row_id", "lang", "narration_verbatim")
    pieces = L.read_pieces()
    model = L.Model(pieces, L.fit(L.sample(beats.where("row_id % 2 = 0"), "row_id", "narration_verbatim", "lang"), pieces))
    rows = beats.where("row_id % 2 = 1").select(L.label_code(F.col("lang")).alias("l"), "narration_verbatim").where(F.col("l").isin(*L.LANGUAGES)).collect()
    single = [(r["l"], r["narration_verbatim"].strip()) for r in rows if r["narration_verbatim"] and [s["lang"] for s in model.segments(r["narration_verbatim"])] == [r["l"]]]
    right = total = 0
    for (a, x), (b, y) in zip(single, single[1:]):
        if a != b and L._SPLIT.search(x[-1] + " "):
            found = model.segments(f"{x} {y}")
            total += 1
            right += [s["lang"] for s in found] == [a, b] and found[1]["begin"] in (len(x), len(x) + 1) and min(s["confidence"] for s in found) > 0.5
    assert total > 20 and right / total > 0.95
