"""Parts of prompts and slots of other lengths, with every item of a shape."""

from beatloom.llm import contamination as C

BASE = "When lock {} of the {} canal failed in {} and curator {} signed receipt for {} coins how many tokens reached {} by noon"
ITEMS = [(1, BASE.format(61, "Zol", 1973, 42, "72,157", "Dol")), (2, BASE.format(12, "Mar", 1951, 77, "5", "Pel")), (3, BASE.format(9, "Sel", 1901, 3, "8", "Zan")), (4, BASE.format(7, "Wem", 1900, 7, "7", "Wem"))]


def found(spark, text, items=ITEMS):
    documents = spark.createDataFrame([(1, text)], "doc_id bigint, text string")
    return {r["item_id"]: r for r in C.reparameterised(documents, spark.createDataFrame(items, "item_id bigint, prompt string")).collect()}


def test_part_of_a_prompt(spark):
    got = found(spark, "yesterday " + " ".join(BASE.format(88, "Vek", 1888, 6, 4, "Kor").split()[:11]) + " elsewhere")
    assert set(got) == {1, 2, 3, 4} and {(r["at_word"], r["n_words"]) for r in got.values()} == {(1, 11)}


def test_slots_of_other_lengths(spark):
    got = found(spark, BASE.format("88,189", "Marfen Bay", 1888, 6, "9", "Kor"))
    assert set(got) == {1, 2, 3} and got[2]["at_word"] == 0


def test_sibling_decides(spark):
    """Items 2 and 4 are of one shape; the first of them refuses the fillings, the other does not."""
    twice = [(2, BASE.format(7, "Wem", 1900, 7, "7", "Wem")), (4, BASE.format(12, "Mar", 1951, 77, "5", "Pel")), (5, BASE.format(1, "Qul", 2, 3, "4", "Tir"))]
    assert set(found(spark, BASE.format(88, "Vek", 1888, 6, 4, "Kor"), twice)) == {4, 5}


def test_a_leak_is_no_copy_of_its_siblings(spark):
    assert not found(spark, ITEMS[1][1])


def test_recall_of_planted_copies(spark, sf_dir):
    """Every held-out prompt with its numbers and names replaced one by one; documents of the tables beside them."""
    import re

    rows = [(r["item_id"], r["prompt"]) for r in spark.read.parquet(f"{sf_dir}/eval_items.parquet").collect()]
    items = spark.createDataFrame(rows, "item_id bigint, prompt string")
    frame = set(C.frame_list(items, "prompt"))
    planted, n_slots = [], 0
    for item_id, prompt in rows:
        slots: dict = {}

        def other(m):
            w = m.group().lower()
            if w in frame or w in C.UNITS:
                return m.group()
            return slots.setdefault(w, f"{10_000 + len(slots)}" if C._numbered(w) else f"Qqz{chr(97 + len(slots) % 26)}{'x' * (len(slots) // 26)}")

        planted.append((1_000_000 + item_id, re.sub(r"[^\W_]+", other, prompt)))
        n_slots += len(slots)
    assert n_slots > len(rows)
    found = C.reparameterised(spark.createDataFrame(planted, "doc_id bigint, text string"), items).collect()
    met = {(r["doc_id"] - 1_000_000, r["item_id"]) for r in found}
    long_enough = [i for i, p in rows if len(C.word_list(p)) >= C.WINDOW]
    assert sum((i, i) in met for i in long_enough) / len(long_enough) >= 0.9
