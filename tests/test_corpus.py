"""The catalogue view over the star schema: its counts, and how often it is made."""

import random

import duckdb

from prismora import catalog
from prismora.testbed import raw_corpus

from .oracle import rows_of, rows_of_sql

SF = "/root/testdata/sf0.001"


def scans(df, name):
    return df._jdf.queryExecution().executedPlan().toString().count(f"/{name}.parquet")


def test_distinct_counts_need_no_expansion(spark):
    plan = raw_corpus(spark, SF)._jdf.queryExecution().executedPlan().toString()
    assert "Expand" not in plan and scans(raw_corpus(spark, SF), "lineitem") == 1


def test_corpus_is_made_once(spark):
    """What reads the corpus several times keeps it, so no plan goes over the lines again."""
    for name in ("f2_popularity_floor", "j19_differential", "v16_projection", "v20_float_drift"):
        assert scans(catalog.entries()[name][0](spark, SF), "lineitem") == 0, name


def test_counts_of_parts_with_repeats_and_nulls(spark, tmp_path):
    """Lines that repeat, lack an order, a supplier or a part, an order that comes twice, a part of most lines and one of none."""
    r = random.Random(3)
    pick = lambda xs: r.choice([*xs, None])
    lines = [(pick(range(12)), r.choice([7, 7, 7, pick(range(9))]), pick(range(3)), float(r.randrange(50))) for _ in range(400)]
    tables = {
        "part": spark.range(10).selectExpr("id as p_partkey", "'a b' as p_name", "'k' as p_type", "'b' as p_brand", "cast(id as int) as p_size"),
        "lineitem": spark.createDataFrame(lines, "l_orderkey bigint, l_partkey bigint, l_suppkey bigint, l_quantity double"),
        "orders": spark.createDataFrame([*((i, i % 4) for i in range(10)), (3, 9), (4, None)], "o_orderkey bigint, o_custkey bigint"),
        "supplier": spark.createDataFrame([(0, "s0", 0, 1.0), (1, "s1", 0, 9000.0)], "s_suppkey bigint, s_name string, s_nationkey int, s_acctbal double"),
        "nation": spark.createDataFrame([(0, "n", 0)], "n_nationkey int, n_name string, n_regionkey int"),
        "region": spark.createDataFrame([(0, "ASIA")], "r_regionkey int, r_name string"),
    }
    for name, df in tables.items():
        df.coalesce(1).write.parquet(f"{tmp_path}/{name}.parquet")
    con = duckdb.connect()
    for name in tables:
        con.execute(f"create view {name} as select * from '{tmp_path}/{name}.parquet/*.parquet'")
    want, _ = rows_of_sql(con, """select p_partkey as i, count(l_partkey) as stars, count(distinct l_orderkey) as forks, count(distinct l_suppkey) as contributors, sum(l_quantity)::bigint as commits,
        case when p_partkey % 3 = 0 then count(distinct o_custkey) end as cited from part join (lineitem left join orders on l_orderkey = o_orderkey) on l_partkey = p_partkey group by 1""")
    assert rows_of(raw_corpus(spark, str(tmp_path)).where("stars is not null").select("i", "stars", "forks", "contributors", "commits", "cited")) == want and len(want) == 9
