"""Window queries: errors of tags of wrong length (A20), numbering in blocks (L3, L4)."""

import pytest
from pyspark.sql import functions as F

from roadlens.registry import retr_q

SF = "/root/testdata/sf0.001"


def test_overall_leaves_out_a_tag_of_wrong_length(spark, monkeypatch):
    answers = retr_q.tb.answer
    whole = {r.window_id: r for r in retr_q.l11(spark, SF).collect()}
    longer = F.regexp_replace("response", r"<future_headway>\s*\[?", "$0 1.0, ")
    monkeypatch.setattr(retr_q.tb, "answer", lambda spark, d: answers(spark, d).withColumn("response", longer))
    rows = [r for r in retr_q.l11(spark, SF).collect() if r.all_extractable and r.speeds_l2 is not None]
    assert rows
    for r in rows:
        assert r.headway_l2 != r.headway_l2 and r.speeds_l2 == whole[r.window_id].speeds_l2
        assert r.overall_l2 == pytest.approx((r.speeds_l2 + r.leader_speed_l2) / 2, abs=1e-5)


def test_window_subset_is_numbered_in_blocks(spark, monkeypatch):
    """No one task numbers a whole run or the whole benchmark; blocks of any size give the same rows."""
    whole = sorted(map(tuple, retr_q.l3(spark, SF).collect()))
    sizes, plain = [], retr_q.dense_position

    def numbered(df, keys, order, bucket=None, **more):
        sizes.append(df.groupBy(bucket if bucket is not None else keys[0]).count().agg(F.max("count")).first()[0])
        return plain(df, keys, order, bucket=bucket, **more)

    monkeypatch.setattr(retr_q, "dense_position", numbered)
    monkeypatch.setattr(retr_q, "POSITION_BLOCK", 5, raising=False)
    assert sorted(map(tuple, retr_q.l3(spark, SF).collect())) == whole and len(whole) == 50
    assert len(sizes) == 2 and max(sizes) <= 5
