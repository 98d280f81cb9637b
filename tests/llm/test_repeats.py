"""Rows that repeat an id."""

from prismora.llm import jaccard_join, line_dedup


def test_repeated_rows_leave_the_line_stage_once(spark):
    rows = [(None, "a b\nc d"), (None, "a b\nc d"), (None, "e f"), (1, "g\nh"), (1, "g\nh"), (1, "i"), (2, None), (2, None), (2, ""), (3, "j\ng"), (3, "j\ng")]
    docs = spark.createDataFrame(rows, "doc_id bigint, text string").repartition(3)
    got = sorted(map(str, (tuple(r) for r in line_dedup.drop_repeated_lines(docs).collect())))
    assert got == sorted(map(str, [(None, "a b\nc d"), (None, "e f"), (1, "g\nh"), (1, "i"), (2, None), (2, ""), (3, "j")]))


def test_near_copies_go_by_id_and_text(spark):
    a, b, c = ("one two three four five six seven", "eight nine ten eleven twelve thirteen", "red green blue white black grey pink brown")
    rows = [(1, a), (2, a), (2, b), (2, None), (3, c), (3, c + " violet"), (3, c)]
    docs = spark.createDataFrame(rows, "doc_id bigint, text string")
    got = [tuple(r) for r in jaccard_join.drop_near_copies(docs).collect()]
    rest = [x for x in got if x[0] != 3]
    assert sorted(map(str, rest)) == sorted(map(str, [(1, a), (2, b), (2, None)]))
    assert [x[1] in (c, c + " violet") for x in got if x[0] == 3] == [True]
