"""Registered queries read all rows and whole texts: each against SQL over the whole table."""

import os

import pytest

from sparkfolio.plans import record_queries, registry

DATA = "/root/testdata/sf0.001"
pytestmark = pytest.mark.skipif(not os.path.isdir(DATA), reason="the driver's tables are not here")

# One digit before a closing 5 is no value of a fifth option ("2 5", "6 5").
WHOLE = {
    "problem_status": """with m as (select user_id problem, case event_type when 'view' then 'idle' when 'click' then 'streaming' when 'purchase' then 'done' when 'error' then 'error' else 'stopped' end status from events)
        select problem, case when bool_or(status = 'streaming') then 'streaming' when bool_and(status in ('done', 'error', 'stopped')) then case when bool_or(status = 'error') then 'error' else 'done' end else 'idle' end status from m group by problem""",
    "known_page_match": "select d.doc_id id, min(k.doc_id) page_id from documents d join documents k on d.text = k.text group by d.doc_id",
    "fifth_option": "select doc_id, case doc_id % 3 when 0 then case when doc_id % 4 = 3 or doc_id in (2, 6) then 'text ⑤' else 'text ⑤ $' || doc_id || '$' end when 1 then case when doc_id % 4 = 3 or doc_id in (2, 6) then 'text ⑤ $7$' else 'text ⑤ $' || doc_id || '$' end else 'text' end fixed from documents",
    "text_clean": r"""with s as (select *, trim(regexp_replace(text, '[^A-Za-z0-9._-]+', '_', 'g'), '._-') slug from documents)
        select doc_id, md5(trim(regexp_replace(text, '^\s+|\s+$', '', 'g'))) clean_md5, md5(case when slug = '' then 'unknown' else slug end) slug_md5, md5(trim(regexp_replace(text, '\r\n|\r|\n', ' ', 'g'))) line_md5,
        case when length(text) > 72 then trim(substr(text, 1, 72)) || '...' else text end short, md5(replace(replace(replace(replace(replace(text, '&', '&amp;'), '<', '&lt;'), '>', '&gt;'), '"', '&quot;'), '''', '&#39;')) escaped_md5 from s""",
    "gt_left_join_pivot": r"""with l as (select doc_id, 'q' || arg_max(quality, toxic) "desc" from labels group by 1), c as (select doc_id, doc_id % 4 k, md5(trim(regexp_replace(text, '\r\n|\r|\n', ' ', 'g'))) cell from documents)
        select doc_id, case when k = 0 then cell end a, case when k = 1 then cell end b, case when k = 2 then cell end c, case when k = 3 then cell else 'again' end d, coalesce("desc", '') "desc" from c left join l using (doc_id)""",
    "stored_text_by_position": """with q as (select conv_id page, row_number() over (partition by conv_id order by turn, role) - 1 pos, role from conversations), t as (select conv_id page, turn pos, case when turn % 4 = 0 then '' else text end stored from conversations where turn % 2 = 0)
        select q.page, q.pos, coalesce(nullif(stored, ''), role) text from q left join t on q.page = t.page and q.pos = t.pos""",
    "model_replies": "select conv_id, turn, text reply, null::varchar error from conversations where role = 'assistant'",
    "classify_rules": record_queries.ORACLES["classify_rules"].replace("substr(text, 1, 40)", "text"),
}


@pytest.mark.parametrize("name", sorted(WHOLE))
def test_query_equals_sql_over_all(spark, name):
    con = pytest.importorskip("duckdb").connect()
    for file in os.listdir(DATA):
        con.execute(f"create view {file.split('.')[0]} as select * from '{DATA}/{file}'")
    got, want = registry.QUERIES[name](spark, DATA), con.sql(WHOLE[name])
    order = sorted(got.columns)
    assert order == sorted(want.columns)
    assert sorted(map(tuple, got.select(*order).collect()), key=repr) == sorted(want.select(*(f'"{c}"' for c in order)).fetchall(), key=repr)


def test_known_pages_with_large_ids(spark, tmp_path):
    rows = [(700, "same"), (600, "same"), (3, "other"), (900, "alone")]
    spark.createDataFrame(rows, "doc_id long, text string").write.parquet(f"{tmp_path}/documents.parquet")
    got = registry.QUERIES["known_page_match"](spark, str(tmp_path))
    assert sorted(map(tuple, got.collect())) == [(3, 3), (600, 600), (700, 600), (900, 900)]
