"""Queries that give the whole result, against SQL without a cut."""

import pytest
from prismora import catalog

from .oracle import connect, rows_of, rows_of_sql

SF = "/root/testdata/sf0.01"

WHOLE = {
    "k2_tiered": "select doc_id, n_chars, case when quality = 1 and text <> '' then 'full_text' when toxic = 1 then 'abstract_context' else 'metadata_only' end as tier from documents join labels using (doc_id)",
    "k9_repo_authors": "select l_partkey, array_to_string(list_sort(list(distinct s_name)), ';') as authors, count(distinct n_name) as affiliations from lineitem join supplier on l_suppkey = s_suppkey left join nation on s_nationkey = n_nationkey group by 1",
    "x8_pattern_scan": """
with l as (select doc_id, unnest(string_split(text, chr(10))) as t, generate_subscripts(string_split(text, chr(10)), 1) as n, string_split(text, chr(10)) as lines from documents),
h as (select doc_id, code, t, n, lines, row_number() over (partition by doc_id, code order by n) as r from l, (values ('the', '\\bthe\\b'), ('der', '\\bder\\b')) v(code, p) where regexp_matches(t, p))
select doc_id, code, n::int as line, md5(t) as text, md5(array_to_string(lines[greatest(n - 4, 1):n + 4], '|')) as context from h where r <= 12
""",
}


@pytest.mark.parametrize("name", sorted(WHOLE))
def test_whole_result(spark, name):
    expected, _ = rows_of_sql(connect(SF), WHOLE[name])
    assert rows_of(catalog.entries()[name][0](spark, SF)) == expected


def test_comparison_key_of_whole_texts(spark):
    from prismora.functions.text import comparison_key
    from pyspark.sql import functions as F

    docs = spark.read.parquet("/root/testdata/sf0.001/documents.parquet").select("doc_id", F.md5(comparison_key(F.col("text"))).alias("key"))
    assert rows_of(catalog.entries()["x16_comparison_key"][0](spark, "/root/testdata/sf0.001")) == rows_of(docs)


def test_unique_urls_where_pages_share_addresses(spark, tmp_path):
    """Pages of the table itself whose addresses differ by scheme or slash, and one without."""
    rows = [(0, "http://a.example/x"), (1, "https://a.example/x/"), (10, "https://www.a.example/x"), (11, "http://b.example"), (20, None), (21, None)]
    spark.createDataFrame(rows, "page_id bigint, url string").write.parquet(f"{tmp_path}/pages.parquet")
    query, text = catalog.entries()["v9_unique_urls"]
    import duckdb

    con = duckdb.connect()
    con.execute(f"create view pages as select * from '{tmp_path}/pages.parquet/*.parquet'")
    expected, _ = rows_of_sql(con, text)
    assert rows_of(query(spark, str(tmp_path))) == expected and len(expected) == 3


def test_answers_are_parsed_once(spark):
    plan = catalog.entries()["x14_answer_problems"][0](spark, SF)._jdf.queryExecution().executedPlan().toString()
    assert plan.count("get_json_object") == 1


def test_recall_filters_tokens_before_they_are_grouped(spark):
    """No lists of tokens that begin with none of the asked words, and no documents as arrays in one row."""
    plan = catalog.entries()["a22_recall"][0](spark, SF)._jdf.queryExecution().optimizedPlan().toString()
    lists = plan.index("collect_set")
    assert plan.count("collect_set") == 1 and "StartsWith(token" in plan[lists:]
