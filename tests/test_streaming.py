import numpy as np
import pytest

from motionloom.operators.smoothing import CausalFilter
from motionloom.streaming import live

SCHEMA = "clip_id long, track_id long, row_id long, frame long, ts double, cx double, cy double"


def test_causal_filter_contract():
    f = CausalFilter(1.0, 0.1)
    assert f.observe(3.0, 4.0, 0.0)[0].tolist() == [3.0, 4.0]
    with pytest.raises(ValueError):
        f.observe(3.0, 4.0, 0.0)


def test_stream_equals_one_filter(spark, tmp_path):
    rows = [(0, t, 10 * f + t, f, f / 10, f * 2.0 + t, f * 1.0) for t in (1, 2) for f in range(12)]
    src = str(tmp_path / "in")
    for part in (rows[0:5] + rows[12:20], rows[5:12] + rows[20:24] + [(0, 1, 999, 3, 0.3, 0.0, 0.0)]):  # the last one is late
        spark.createDataFrame(part, SCHEMA).coalesce(1).write.mode("append").parquet(src)
    got = []
    stream = spark.readStream.schema(SCHEMA).option("maxFilesPerTrigger", 1).parquet(src)
    q = live.tee(live.smooth_stream(stream, 1.0, 0.5), [lambda b, n: got.extend(b.collect())], str(tmp_path / "ck"))
    q.awaitTermination()
    assert len(got) == 24
    f = CausalFilter(1.0, 0.5)
    want = [f.observe(r[5], r[6], 0.0 if i == 0 else 0.1)[0, 0] for i, r in enumerate(rows[:12])]
    mine = [r.px for r in sorted((r for r in got if r.track_id == 1), key=lambda r: r.frame)]
    assert np.allclose(mine, want, atol=1e-6)


def test_thin_stream(spark, tmp_path):
    src = str(tmp_path / "steps")
    for part in (range(0, 5), range(5, 10)):
        spark.createDataFrame([(0, f, f / 10) for f in part], "clip_id long, frame long, ts double").coalesce(1).write.mode("append").parquet(src)
    got = []
    stream = spark.readStream.schema("clip_id long, frame long, ts double").option("maxFilesPerTrigger", 1).parquet(src)
    live.tee(live.thin_stream(stream, 0.2, 10), [lambda b, n: got.extend(b.collect())], str(tmp_path / "ck")).awaitTermination()
    assert sorted(r.frame for r in got) == [0, 2, 4, 6, 8]
