"""A flat scanner's points are read in batches, without a row for each of them before they are decoded."""

import math

from gridwake.operators import sweeps


def test_points_of_whole_and_short_packets(spark):
    whole = bytes(4) + (35900).to_bytes(2, "big") + b"".join((b"\xff\xff" if k == 3 else (1000 + k).to_bytes(2, "big")) + bytes([k]) for k in range(42))
    rows = [(7, 1, whole), (7, 2, whole[:11]), (7, 3, bytes(4) + (100).to_bytes(2, "big")), (8, 1, None)]
    df = sweeps.flat_scan(spark.createDataFrame([(s, k, None if p is None else bytearray(p)) for s, k, p in rows], "stream_id long, seq long, payload binary"))
    assert "Generate" not in df._jdf.queryExecution().executedPlan().toString()
    got = {(r.stream_id, r.seq, r.point): r for r in df.collect()}
    assert len(got) == 4 * 42
    for k in range(42):
        r, a = got[7, 1, k], (359.0 + k * 15 / 42) % 360
        assert abs(r.azimuth_deg - a) < 1e-9 and r.intensity == k and r.frame == 0
        assert (r.x is None) == (k == 3) and (k == 3 or abs(r.x - (1 + k / 1000) * math.sin(math.radians(a))) < 1e-9 and abs(r.y - (1 + k / 1000) * math.cos(math.radians(a))) < 1e-9)
    # Eleven bytes hold one point and the distance of the next one.
    assert got[7, 2, 0].intensity == 0 and got[7, 2, 1].x is not None and got[7, 2, 1].intensity is None and got[7, 2, 2].x is None
    assert got[7, 3, 0].frame == 1 and got[7, 3, 0].x is None and got[8, 1, 5].azimuth_deg is None and got[8, 1, 5].x is None
