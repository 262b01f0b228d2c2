"""Relative size changes in the 29 bins of the reference, signs mended."""

from tracewell import registry
from tracewell.operators import analytics


def test_bins(spark):
    base = 10_000_000
    edges = [0.0001, 0.0002, 0.0005, 0.0008, 0.001, 0.002, 0.005, 0.008, 0.01, 0.02, 0.05, 0.08, 0.1]
    want, rows = {}, []
    for k, low in enumerate([0.00005, *edges]):
        for sign in (1, -1):
            rows.append((base + sign * round(low * base), base, True))
            want[sign * (k + 1)] = 1
    rows += [(base, base, True), (base + 50, base, True), (0, 0, True), (5, 0, True), (base * 2, base, False), (7, 70, True)]
    want |= {0: 3, 14: 2, -14: 2}
    df = spark.createDataFrame(rows, "obj_size bigint, prev_size bigint, overwrite boolean")
    got = analytics.size_change_fine(df).collect()
    assert {r["bucket"]: r["cnt"] for r in got} == want and len(got) == 29


def test_registered_with_the_overwrites_of_size_change(spark, sf_dir):
    fine = registry.queries()["size_change_fine"](spark, sf_dir).agg({"cnt": "sum"}).first()[0]
    assert fine == registry.queries()["size_change"](spark, sf_dir).filter("kind = 'relative'").agg({"cnt": "sum"}).first()[0]


def test_growth_from_nothing(spark):
    """An old size of 0 has no ratio: growth counts as beyond the last tenth, no change as none."""
    df = spark.createDataFrame([(True, 0, 5), (True, 0, 0), (True, 10, 15)], "overwrite boolean, prev_size bigint, obj_size bigint")
    got = {r["bucket"]: r["cnt"] for r in analytics.size_change(df).filter("kind = 'relative'").collect()}
    assert got == {20: 1, 0: 1, 5: 1}
