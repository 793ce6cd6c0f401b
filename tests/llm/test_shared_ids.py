from dwell.llm.simhash import drop_near_duplicates
from test_simhash import frame


def test_each_class_keeps_a_row_of_its_own_text(spark):
    docs = frame(spark, [(2, "a b c d"), (2, "x y z"), (1, "x y z"), (3, "p q r"), (3, "k l m"), (3, "k l m")])
    assert sorted((r.doc_id, r.text) for r in drop_near_duplicates(docs).collect()) == [(1, "x y z"), (2, "a b c d"), (3, "k l m"), (3, "p q r")]
