"""Cases of the contracts that the driver's tables do not hold."""

import hashlib

from sigspark.llm import decontaminate, langid


def test_marks_without_a_letter_have_no_language(spark):
    rows = [(i, t, lang) for i, (t, lang) in enumerate([("the cat and the dog and the house " * 30, "en"), ("le chat et le chien et la maison " * 30, "fr")])]
    docs = spark.createDataFrame(rows, "doc_id long, text string, lang string")
    asked = spark.createDataFrame([(1, "́̂ 123"), (2, "́"), (3, "le chat et le chien"), (4, "")], "doc_id long, text string")
    got = {r.doc_id: r.lang_pred for r in langid.identify(asked, langid.train(docs)).collect()}
    assert got == {1: "und", 2: "und", 3: "fr", 4: "und"}


def test_item_ids_may_be_texts(spark):
    item = "a b c d e f g h i j"
    docs = spark.createDataFrame([(1, f"x {item} y"), (2, "nothing"), (3, None)], "doc_id long, text string")
    bench = spark.createDataFrame([("q-2", item), ("q-1", item + " k"), ("q-3", None)], "item_id string, text string")
    got = {r.doc_id: (r.n_hit, r.n_items, r.items_sha256) for r in decontaminate.report(docs, bench).collect()}
    assert got[1] == (10, 2, hashlib.sha256(b"q-1,q-2").hexdigest()) and got[2][:2] == got[3][:2] == (0, 0)
    assert decontaminate.report(docs, bench.limit(0)).where("contaminated").count() == 0
