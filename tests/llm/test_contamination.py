import regex
from beatloom.llm import contamination as C

WORD = regex.compile(r"[\p{L}\p{N}]+")
PROMPT = "When lock 61 of the Zol canal failed in 1973, and curator 42 signed receipt XN-4716 for 72,157 coins, how many tokens reached Dol by 1993?"
OTHER = "When lock 12 of the Mar canal failed in 1951, and curator 77 signed receipt QQ-1 for 5 coins, how many tokens reached Pel by 2001?"
THIRD = "When lock 9 of the Sel canal failed in 1901, and curator 3 signed receipt AB-2 for 8 coins, how many tokens reached Zan by 1950?"
ITEMS = [(1, PROMPT), (2, OTHER), (3, THIRD), (4, "too short"), (5, None), (6, "")]


def brute(docs, items, size=10):
    index = {}
    for i, p in items:
        w = WORD.findall((p or "").lower())
        for k in range(len(w) - size + 1):
            index.setdefault(tuple(w[k : k + size]), set()).add(i)
    out = set()
    for d, t in docs:
        w = WORD.findall((t or "").lower())
        for k in range(len(w) - size + 1):
            out |= {(d, i) for i in index.get(tuple(w[k : k + size]), ())}
    return out


def frames(spark, docs, items=ITEMS):
    return (
        spark.createDataFrame([(d, t, 1, "x") for d, t in docs], "doc_id bigint, text string, item_id int, template string"),
        spark.createDataFrame([(i, p, 2) for i, p in items], "item_id bigint, prompt string, doc_id int"),
    )


DOCS = [
    (1, "x " + PROMPT + " y"), (2, PROMPT.upper().replace(" ", "\n--\n")), (3, " ".join(PROMPT.split()[:12])), (4, " ".join(PROMPT.split()[:9])), (5, OTHER.replace("Mar", "Tel")),
    (6, None), (7, ""), (8, "nothing here at all to find in this sentence of many words"), (9, PROMPT + " " + OTHER), (10, ("filler " * 60_000) + PROMPT), (11, PROMPT), (11, PROMPT), (12, "signed receipt XN-4716 for 72,157 coins, how many"),
]


def test_leaks(spark):
    documents, items = frames(spark, DOCS)
    got = {(r["doc_id"], r["item_id"]) for r in C.leaks(documents, items).collect()}
    assert got == brute(DOCS, ITEMS)
    assert {d for d, _ in got} >= {1, 2, 3, 9, 10, 11}


def test_reparameterised(spark):
    changed = PROMPT.replace("61", "88").replace("Zol", "Vek").replace("XN", "PP")
    twice = "When lock 5 of the Mel canal failed in 1920, and curator 5 signed receipt Mel-1 for 9 coins, how many tokens reached Mel by 1930?"
    items = [(1, PROMPT.replace("72,157", "72157")), (2, OTHER), (3, THIRD), (7, twice)]
    docs = [(1, changed.replace("72,157", "4")), (2, OTHER), (3, "unrelated words " * 20), (4, twice.replace("Mel", "Kor").replace("lock 5", "lock 6").replace("curator 5", "curator 6")), (5, None)]
    documents, frame = frames(spark, docs, items)
    got = {(r["doc_id"], r["item_id"]) for r in C.reparameterised(documents, frame).collect()}
    assert 1 in {d for d, _ in got} and not {3, 5} & {d for d, _ in got}


def test_inconsistent_slots_are_refused(spark):
    base = "the pier of Xar fell and the crew of Xar left the hall of {} in the year of the great flood"
    items = [(i, base.format("Xar").replace("Xar", n)) for i, n in ((1, "Qul"), (2, "Wem"), (3, "Tir"))]
    documents, frame = frames(spark, [(1, base.format("Xar").replace("Xar", "Zod")), (2, base.format("Yol"))], items)
    assert {r["doc_id"] for r in C.reparameterised(documents, frame).collect()} == {1}


def test_empty(spark):
    documents, items = frames(spark, [])
    assert C.leaks(documents, items).count() == 0
    documents, items = frames(spark, DOCS, [])
    assert C.leaks(documents, items).count() == 0
    assert C.reparameterised(documents, items).count() == 0


def test_query(spark, sf_dir):
    import __spark_entry__ as entry

    rows = {tuple(r) for r in entry.queries()["p9_found"](spark, sf_dir).select("doc_id", "item_id").collect()}
    docs = [tuple(r) for r in spark.read.parquet(f"{sf_dir}/documents.parquet").select("doc_id", "text").collect()]
    items = [tuple(r) for r in spark.read.parquet(f"{sf_dir}/eval_items.parquet").select("item_id", "prompt").collect()]
    assert rows == brute(docs, items)
