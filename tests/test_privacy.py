import math

import pytest
from pyspark.sql import functions as F

from veil.errors import BudgetExceededError
from veil.functions.noise import gaussian, laplace
from veil.operators.privacy import Budget, Gaussian, Laplace, Parameters, Private, k_anonymous, mechanism, sensitivity


def test_parameters():
    for bad in ({"epsilon": 0}, {"epsilon": 1, "delta": 1}, {"epsilon": 1, "sensitivity": 0}, {"epsilon": 1, "delta": -0.1}):
        with pytest.raises(ValueError):
            Parameters(**bad)
    assert Laplace(Parameters(2)).scale == 0.5 and Laplace(Parameters(1, sensitivity=5)).scale == 5.0
    assert Gaussian(Parameters(1, 0.01)).sigma == pytest.approx(math.sqrt(2 * math.log(125)))
    with pytest.raises(ValueError):
        Gaussian(Parameters(1))
    with pytest.raises(ValueError):
        mechanism("cauchy", Parameters(1))


def test_intervals():
    low, high = Laplace(Parameters(1)).interval(10, 0.95)
    assert high - 10 == pytest.approx(-math.log(0.05)) and 10 - low == pytest.approx(high - 10)
    assert Gaussian(Parameters(1, 0.01)).margin(0.95) == pytest.approx(1.959964 * math.sqrt(2 * math.log(125)), rel=1e-5)
    with pytest.raises(ValueError):
        Laplace(Parameters(1)).interval(0, 1.0)


def test_budget():
    b = Budget(0.3)
    for _ in range(3):
        b.consume(0.1)
    with pytest.raises(BudgetExceededError):
        b.consume(0.01)
    assert b.report()["query_count"] == 3 and b.report()["epsilon_percent"] == pytest.approx(100)
    with pytest.raises(ValueError):
        b.consume(-1)
    b.reset()
    with b.query(0.2):
        pass
    assert b.remaining[0] == pytest.approx(0.1)


def test_sensitivity():
    assert (sensitivity("count"), sensitivity("sum", (-5, 3)), sensitivity("mean", (1, 4))) == (1.0, 5.0, 3.0)
    with pytest.raises(ValueError):
        sensitivity("median")


def test_noise_has_its_distribution(spark):
    r = spark.range(20_000).select(laplace(F.col("id"), 2.0, 1, "q").alias("l"), gaussian(F.col("id"), 3.0, 1, "q").alias("g")).agg(F.avg("l"), F.var_pop("l"), F.avg("g"), F.var_pop("g")).first()
    assert abs(r[0]) < 0.1 and r[1] == pytest.approx(8.0, rel=0.1) and abs(r[2]) < 0.1 and r[3] == pytest.approx(9.0, rel=0.05)


def test_noisy_groups(spark):
    df = spark.range(1000).select((F.col("id") % 3).alias("g"), F.col("id").cast("double").alias("v"))
    one, two = (sorted(Private(Budget(10.0), seed=5).count(df.repartition(n), ["g"], query="a", epsilon=1).collect()) for n in (1, 7))
    p = Private(Budget(10.0), seed=5)
    other = sorted(p.count(df, ["g"], query="b", epsilon=1).collect())
    assert one == two and one != other
    total = p.sum(df, "v", (0, 10), epsilon=1).first()["noisy_sum"]
    assert abs(total - (45 + 990 * 10)) < 300
    assert abs(p.mean(df, "v", (0, 10), ["g"], epsilon=2).first()["noisy_mean"] - 9.9) < 1
    with pytest.raises(ValueError):
        p.count(df, epsilon=0)


def test_noise_does_not_cancel(spark):
    """Asking twice, at another epsilon or about a table less one row, doesn't give the truth."""
    df = spark.range(1000).select((F.col("id") % 5).alias("g"))
    ask = lambda p, d, epsilon: {r["g"]: r["noisy_count"] for r in p.count(d, ["g"], epsilon=epsilon).collect()}
    for seed in (None, 5):
        p, q = Private(Budget(10.0), seed=seed), Private(Budget(10.0), seed=seed)
        a, b = ask(p, df, 0.1), ask(q, df, 0.2)
        assert all(abs(2 * b[g] - a[g] - 200) > 1e-6 for g in a)
    p = Private(Budget(10.0))
    a, b = ask(p, df, 0.1), ask(p, df.where("g <> 0").unionAll(df.where("g = 0").limit(199)), 0.1)
    assert all(abs(a[g] - b[g] - (g == 0)) > 1e-6 for g in a)
    seeded = Private(Budget(10.0), seed=1)
    ask(seeded, df, 0.1)
    with pytest.raises(ValueError):
        ask(seeded, df, 0.2)


def test_groups_have_keys_of_their_own(spark):
    df = spark.createDataFrame([("a|b", "c"), ("a", "b|c"), ("a", None), ("a", "-")], "x string, y string")
    got = [r["noisy_count"] for r in Private(Budget(1.0), seed=2).count(df, ["x", "y"], epsilon=1).collect()]
    assert len(set(got)) == 4


def test_k_anonymous(spark):
    df = spark.createDataFrame([("a", None)] * 3 + [("b", 1)], "x string, y int")
    assert k_anonymous(df, ["x", "y"], 3).count() == 3
