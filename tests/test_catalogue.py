import __spark_entry__ as entry

SMALL = "/root/testdata/sf0.001"


def test_flagship(spark):
    got = entry.entry(spark)
    assert got.columns == ["link", "n_pages"] and got.count() == 20


def test_every_query_has_a_name_of_its_own_and_sql_belongs_to_a_query():
    queries, sql = entry.queries(), entry.oracle_sql()
    assert len(queries) > 40 and set(sql) <= set(queries)


def test_plans_prune_columns_and_shuffle_once_per_need(spark):
    plan = entry.queries()["domain_extract"](spark, SMALL)._jdf.queryExecution().executedPlan().toString()
    assert "ReadSchema: struct<page_id:bigint,url:string>" in plan and "Exchange" not in plan
