"""Plans of the rounds of connected components stay small, whatever the number of rounds."""

from ringtide.llm import components


def test_a_round_is_planned_alone(spark, monkeypatch):
    plans = []
    real = components.checkpointed

    def noted(df):
        plans.append(df._jdf.queryExecution().optimizedPlan().toString().count("\n"))
        return real(df)

    monkeypatch.setattr(components, "checkpointed", noted)
    chain = spark.range(40).selectExpr("id AS a", "id + 1 AS b")
    found = {(r.node, r.comp) for r in components.components(chain).collect()}
    assert found == {(i, 0) for i in range(41)}
    assert len(plans) > 2 and max(plans) < 100  # 345 lines for two rounds at once
