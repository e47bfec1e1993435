"""Records are fitted once, before the mix repeats and moves them."""

from grainmill import catalog


def test_texts_stay_where_they_are(spark):
    plan = catalog.queries()["r9_fitted_mix"](spark, "/root/testdata/sf0.001")._jdf.queryExecution().optimizedPlan().toString()
    above = plan[: plan.index("MapInArrow")].lower()
    assert "repartition" in above and "explode" in plan.lower()[: plan.rindex("MapInArrow")]
