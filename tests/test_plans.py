"""Plan-shape checks: the neighbour search keeps the blocked kernel, partial top-k, no
nested-loop or cartesian join; the document scan is pruned."""

from tests.conftest import SF001


def _plan(df) -> str:
    return df._jdf.queryExecution().executedPlan().toString()


def test_neighbour_plan_shape(spark):
    # the flagship's neighbour search (the flagship itself reads the checkpointed result)
    from stratum.operators.knn import knn
    from stratum.plans.grading import scaled_points
    from stratum.sources.datasets import ds_doc
    df = knn(scaled_points(ds_doc(spark, SF001)), 5)
    df.write.format("noop").mode("overwrite").save()
    plan = _plan(df)
    assert "FlatMapCoGroupsInPandas" in plan
    assert "WindowGroupLimit" in plan
    assert "BroadcastNestedLoopJoin" not in plan
    assert "CartesianProduct" not in plan


def test_document_scan_is_pruned(spark):
    from stratum.sources.datasets import doc_features
    df = doc_features(spark, SF001)
    plan = df._jdf.queryExecution().executedPlan().toString()
    # only the three columns the features need are read from the wide documents table
    assert "ReadSchema: struct<doc_id:bigint,text:string,n_chars:bigint>" in plan
