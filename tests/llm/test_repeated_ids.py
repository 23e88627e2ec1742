"""Operator 3 on an id that has several texts, one of them a copy of a smaller id's."""

from tumbler.llm import jaccard_join


def test_copies_link_their_ids(spark):
    a, b = (" ".join(f"{x}{i}" for i in range(60)) for x in "ab")
    docs = [(3, a), (5, a), (5, b), (9, b), (11, b + " more"), (2, " "), (9, " "), (20, " "), (20, "c d e f g h"), (21, "c d e f g h")]
    got = sorted(map(tuple, jaccard_join.join_components(spark.createDataFrame(docs, "doc_id long, text string").repartition(3)).collect()))
    assert got == sorted(jaccard_join.brute(docs))
    assert {c for i, n, c in got if i in (3, 5, 9, 11) and n} == {3}
