import pytest

from basinflow.operators import transitions
from basinflow.streaming.transitions import streamed_pairs

SCHEMA = "g string, f long, s string"


@pytest.mark.parametrize("lag", [1, 2])
def test_stream_equals_batch(spark, tmp_path, lag):
    seq = "AB-CABBA--CAACB-ABCCBA"
    rows = [(g, i, "noise" if s == "-" else s) for g, t in (("x", seq), ("y", seq[::-1])) for i, s in enumerate(t)]
    folder = tmp_path / "in"
    for k in range(0, len(seq), 6):
        spark.createDataFrame([r for r in rows if k <= r[1] < k + 6], SCHEMA).coalesce(1).write.mode("append").parquet(str(folder))
    stream = spark.readStream.schema(SCHEMA).option("maxFilesPerTrigger", 1).parquet(str(folder))
    q = streamed_pairs(stream, "s", "f", ["g"], lag=lag).writeStream.format("memory").queryName(f"pairs{lag}").outputMode("append").option("checkpointLocation", str(tmp_path / "cp")).start()
    try:
        q.processAllAvailable()
    finally:
        q.stop()
    got = sorted(map(tuple, spark.sql(f"select g, src, dst from pairs{lag}").collect()))
    want = transitions.lag_pairs(spark.createDataFrame(rows, SCHEMA), "s", "f", ["g"], lag=lag)
    assert got == sorted(map(tuple, want.collect()))
    with pytest.raises(ValueError):
        streamed_pairs(stream, "s", "f", ["g"], lag=0)
