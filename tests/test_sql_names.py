"""SQL names of this package against the expressions that they stand for."""

import pytest
from pyspark.sql import functions as F

from ledgerloom.functions import sql
from ledgerloom.operators import reference


def test_scalars_are_the_expressions_without_python(spark):
    sql.register(spark)
    values = [(v,) for v in ("  Café  Coöp ﬁ, LTD. ", "1,234.50", "NOT_FOUND", "한국 ß", "", "it's a \\ 'quote'", "x=y<z", None)]
    df = spark.createDataFrame(values, "v string").withColumn("reference", F.col("v")).withColumn("body", F.lit("see 1234.50 not_found"))
    df.createOrReplaceTempView("sql_names")
    for name, (arguments, _, body) in sql.SCALARS.items():
        call = ", ".join(a.split(" ")[0] for a in arguments.split(", "))
        got = spark.sql(f"SELECT {name}({call}) AS x FROM sql_names")
        assert [r.x for r in got.collect()] == [r.x for r in df.select(body().alias("x")).collect()], name
        assert "Python" not in got._jdf.queryExecution().executedPlan().toString()


def test_table_functions(spark):
    sql.register(spark)
    rows = [(1, "PAID TO (NORD, VIK) SA", "Nordvik"), (2, None, "x"), (3, "abc", None), (4, "no", "yes")]
    spark.createDataFrame(rows, "id int, narrative string, name string").createOrReplaceTempView("told")
    got = {r.id: r.span for r in spark.sql("SELECT * FROM ledger_spans(TABLE(SELECT * FROM told))").collect()}
    assert got == {str(i): reference._span(t, n) for i, t, n in rows} and got["1"] == "NORD, VIK"
    pairs = [("v", 0, f"e{k:02}", 0.5, 2.0, 1.0 + k) for k in range(9)] + [("v", 0, "e08", 8.0, 2.0, 9.0), ("w", 1, "z", 1.0, 1.0, 1.0), ("u", 1, "z", 0.0, 1.0, 1.0)]
    spark.createDataFrame(pairs, "value string, pool int, entry string, weight double, mine double, theirs double").repartition(5).createOrReplaceTempView("shared")
    found = spark.sql("SELECT * FROM ledger_candidates(TABLE(SELECT * FROM shared) PARTITION BY value)").collect()
    assert sorted((r.value, r.rank, r.matched_name) for r in found) == [("v", 1, "e08"), ("v", 2, "e00"), ("v", 3, "e01"), ("v", 4, "e02"), ("v", 5, "e03"), ("w", 1, "z")]


@pytest.mark.parametrize("text,want", [("SELECT 1", 1)])
def test_registering_twice_is_fine(spark, text, want):
    sql.register(spark)
    sql.register(spark)
    assert spark.sql(text).first()[0] == want
