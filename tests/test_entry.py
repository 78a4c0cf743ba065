import __spark_entry__ as entry


def test_entry_runs(spark):
    assert entry.entry(spark).count() > 0


def test_every_query_is_registered_with_sql_or_known():
    known = set()
    missing = {k for k in entry.queries() if k not in entry.oracle_sql() and not k.startswith("op") and k != "pipeline"}
    assert missing == known
    assert set(entry.oracle_sql()) <= set(entry.queries())


def test_queries_read_the_given_tables(spark):
    for name in ("line_orders_month_sum", "facet_distinct", "recommend_orders", "scatter_sample"):
        assert entry.queries()[name](spark, "/root/testdata/sf0.001").count() > 0


def test_analytics_run_no_python_in_tasks(spark):
    from autobi.plans.registry import QUERIES

    for name, make in QUERIES.items():
        plan = make(spark, "/root/testdata/sf0.001")._jdf.queryExecution().optimizedPlan().toString()
        assert "Python" not in plan and "Arrow" not in plan and "Pandas" not in plan, name
