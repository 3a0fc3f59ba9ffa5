"""Rows that share a ``doc_id``, or have none, with texts of their own: lines."""

import collections

from helpers import awkward

from tallyspark.llm import line_dedup

A = "the first text has words of its own that no other row of the table holds anywhere at all"
B = "quite another passage stands here and it speaks about rivers mountains and the long way home"


def test_op3_places_belong_to_their_row(spark):
    """A repeat at a place of one row leaves that place of other rows with the id alone."""
    for key in (7, None):
        rows = [(-5 if key else None, A, "en"), (key, f"{B}\n{A}", "en"), (key, "one more line that is long enough\nand a line that only this row has", "en")]
        kept = [x for r in line_dedup.dedup_lines(awkward(spark, rows)).collect() for x in r["text"].split("\n")]
        assert collections.Counter(filter(None, kept)) == collections.Counter({x for _, t, _ in rows for x in t.split("\n")})


def test_op3_repeat_at_the_same_place(spark):
    """A line that two rows of one id hold at the same place stays once; equal rows stay equal."""
    for key in (7, None):
        rows = [(key, f"{A}\nfirst row goes on like this here", "en"), (key, f"{A}\nsecond is different in every word", "en")]
        df = awkward(spark, rows + rows[:1])
        texts = [r["text"] for r in line_dedup.dedup_lines(df).collect()]
        assert len(set(texts)) == 2 and sum(A in t for t in set(texts)) == 1
        assert {r["n_dropped"] for r in line_dedup.dedup_report(df).collect()} == {0, 1}
