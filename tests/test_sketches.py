"""Logarithmic sketches: error bound, merging, streams."""

import numpy as np
from pyspark.sql import functions as F

from quarry.operators import sketches as K
from quarry.streaming import stateful as S


def test_quantiles_stay_within_the_error(spark):
    r = np.random.default_rng(1)
    x = np.concatenate([r.lognormal(0, 3, 3000), -r.lognormal(1, 2, 1000), np.zeros(200)])
    rows = [(int(i % 3), float(v)) for i, v in enumerate(x)] + [(0, None), (1, float("nan"))]
    df = spark.createDataFrame(rows, "k int, v double").repartition(5)
    places = {"low": 0.01, "mid": 0.5, "high": 0.95, "top": 1.0}
    for error in (0.01, 0.05):
        sketch = K.sketch(df, "v", ("k",), error)
        whole = K.merged(sketch.where("k = 0"), sketch.where("k > 0"))
        for got, own in [(K.quantiles(whole, places, error=error).first(), np.sort(x))] + [(r, np.sort(x[np.arange(len(x)) % 3 == r.k])) for r in K.quantiles(sketch, places, ("k",), error).collect()]:
            assert got.n == len(own)
            for name, q in places.items():
                true = own[int(np.floor(q * (len(own) - 1)))]
                assert abs(got[name] - true) <= error * abs(true) * (1 + 1e-9)
        assert whole.count() < 2 * np.log(x.max() / np.abs(x[x != 0]).min()) / np.log(K.growth(error)) + 2


def test_a_stream_merges_its_batches(spark, tmp_path):
    df = spark.range(300).select((F.col("id") % 2).alias("k"), (F.col("id") * 1.5).alias("v"))
    df.repartition(3).write.parquet(f"{tmp_path}/t.parquet")
    got = S.drained(K.sketch(S.stream_of(spark, str(tmp_path), "t", files_per_batch=1), "v", ("k",)), "complete")
    assert sorted(map(tuple, got.collect())) == sorted(map(tuple, K.sketch(df, "v", ("k",)).collect()))
    assert K.sketch(df.limit(0), "v").collect() == []
