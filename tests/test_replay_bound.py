"""A conversation too long for one row."""

import pytest

from tallyspark.operators import transcripts


def test_replay_beyond_its_bytes_fails_loudly(spark, monkeypatch):
    conv = spark.createDataFrame([(1, t, "user", "words " * 5) for t in range(30)] + [(2, 0, "user", "hi")],
                                 "conv_id long, turn long, role string, text string")
    whole = transcripts.replay(conv, chunked=False).collect()
    assert {r["conv_id"]: r["n_turns"] for r in whole} == {1: 30, 2: 1}
    monkeypatch.setattr(transcripts, "REPLAY_BYTES", 500)
    with pytest.raises(Exception, match="replay it chunked"):
        transcripts.replay(conv, chunked=False).collect()
    assert transcripts.replay(conv, chunked=True).count() == 2
