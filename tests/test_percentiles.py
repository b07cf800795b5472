import random

import numpy as np

from tidewell.operators import scorecard


def test_percentiles_of_hot_small_and_null_groups(spark):
    r = random.Random(1)
    data = [("hot", r.choice([1.0, 2.5, r.random() * 9])) for _ in range(2000)] + [("one", 3.0), ("two", 1.0), ("two", 4.0), (None, 7.0), (None, 8.0), ("none", None), ("hot", None)]
    got = {x["k"]: x for x in scorecard.latency_summary(spark.createDataFrame(data, "k string, v double").repartition(5), ["k"], "v").collect()}
    assert set(got) == {"hot", "one", "two", None, "none"}
    for key, row in got.items():
        own = [v for k, v in data if k == key and v is not None]
        if not own:
            assert row["n"] == 0 and row["median"] is None
            continue
        want = np.percentile(own, [50, 90, 95])
        assert np.allclose([row["median"], row["p90"], row["p95"]], want, rtol=1e-12) and row["n"] == len(own) and row["most"] == max(own)
