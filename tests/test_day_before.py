import math

from tidewell.plans import catalog


def test_sums_of_exactly_a_hundred_are_not_beyond_it_in_any_order(spark):
    hour = catalog.HOUR
    users = {
        1: [33.1, 33.3, 33.6], 2: [33.6, 33.3, 33.1], 3: [10.1, 20.2, 30.3, 39.4], 4: [39.4, 30.3, 20.2, 10.1], 5: [0.1] * 1000, 6: [0.1] * 1000 + [0.01], 7: [100.01],
        8: [1e30], 9: [math.nan], 10: [], 11: [None], 12: [None, 101.0], 13: [1e30, -1e30, 5.0], 14: [45.59, 8.2, 15.23, 30.98], 15: [30.98, 15.23, 8.2, 45.59],
    }
    rows = [(u, hour + k, v) for u, values in users.items() for k, v in enumerate(values)] + [(u, 2 * hour, 1.0) for u in users]
    got = catalog.carried_before(spark.createDataFrame(rows, "user_id long, t long, value double")).where(f"t = {2 * hour}").collect()
    assert {r["user_id"]: r["n_linked"] for r in got} == {u: len(v) for u, v in users.items()}
    assert {r["user_id"] for r in got if r["reached"]} == {6, 7, 8, 9, 12}
