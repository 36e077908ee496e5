import pytest

from attestra.operators import constraints as K
from attestra.plans.runlog import RunLog, observed


def test_counts_come_from_the_job_that_runs(spark, tmp_path):
    df = spark.range(1000).selectExpr("id", "id % 7 AS g", "id % 5 AS v")
    suite = [K.DenialConstraint("big", "t", "v > 3"), K.Cardinality("few", "t", "g", max=142), K.FunctionalDependency("fd", "t", "g", "v"), K.DenialConstraint("none", "t", "v > 30")]
    said = []
    log = RunLog(f"{tmp_path}/run.log", said.append)
    with log.timed("suite"):
        counts = log.write_violations(suite, {"t": df}, f"{tmp_path}/out")
    expected = {c.name: (r.n_checked, r.n_violations) for c, r in zip(suite, K.run_constraints(suite, {"t": df}))}
    assert counts == expected
    assert all(spark.read.parquet(f"{tmp_path}/out/{n}").count() == v for n, (_, v) in expected.items())
    assert said[0] == "start suite" and said[1].startswith("big: 200 of 1,000 (") and said[-1].startswith("done suite (")
    with pytest.raises(ValueError), log.timed("wrong"):
        raise ValueError
    assert said[-1].startswith("failed wrong after") and len(open(f"{tmp_path}/run.log").readlines()) == len(said)
    one = observed(suite[0], {"t": df})
    assert len(one.violations.collect()) == one.counts[1] == 200
