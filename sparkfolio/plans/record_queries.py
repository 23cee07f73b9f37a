"""Queries over networks, votes, records and classification, with the SQL that gives the same rows."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from ..functions import text as T
from ..operators import classify as C
from ..operators import known_pages as P
from ..operators import network as N
from ..operators import records as R
from ..sources.tables import read, steps
from .text_queries import STEPS

MS = lambda c: F.unix_millis(F.col(c).cast("timestamp"))
STATUS = {"view": "idle", "click": "streaming", "purchase": "done", "error": "error", "signup": "stopped"}


def step_flows(spark: SparkSession, d: str) -> DataFrame:
    return N.step_flows(steps(spark, d))


def step_layers(spark: SparkSession, d: str) -> DataFrame:
    return N.shared_layers(steps(spark, d))


def group_refs(spark: SparkSession, d: str) -> DataFrame:
    refs = steps(spark, d).select("problem", (F.col("idx") % 3).alias("group_no"), "solver", (F.col("idx") + F.col("solver") % 2 * 3).alias("idx"))
    hit, missed = N.group_refs(refs, steps(spark, d))
    kind = lambda df, k: df.groupBy("problem", "group_no").agg(F.count(F.lit(1)).alias("refs")).withColumn("kind", F.lit(k))
    return kind(hit, "step").unionByName(kind(missed, "missed"))


def _cells(spark: SparkSession, d: str) -> DataFrame:
    return read(spark, d, "events").groupBy(F.col("user_id").alias("model"), F.col("event_type").alias("grp")).agg(F.count(F.lit(1)).alias("n"))


def group_transitions(spark: SparkSession, d: str) -> DataFrame:
    return N.group_transitions(_cells(spark, d))


def group_row_offsets(spark: SparkSession, d: str) -> DataFrame:
    return N.row_offsets(_cells(spark, d))


def _answers(spark: SparkSession, d: str) -> DataFrame:
    return read(spark, d, "orders").select(F.col("o_custkey").alias("problem"), F.col("o_orderkey").alias("solver"), F.when(F.col("o_orderkey") % 11 == 0, " - ").otherwise(F.col("o_orderpriority")).alias("answer"))


def answer_vote(spark: SparkSession, d: str) -> DataFrame:
    return N.answer_votes(_answers(spark, d))


def answer_agreement(spark: SparkSession, d: str) -> DataFrame:
    return N.agreement(_answers(spark, d))


def answer_color_rank(spark: SparkSession, d: str) -> DataFrame:
    return N.colour_index(read(spark, d, "orders"), "o_custkey", "o_orderpriority")


def _spans(spark: SparkSession, d: str) -> DataFrame:
    rows = read(spark, d, "events").groupBy(F.col("user_id").alias("problem"), F.col("event_type").alias("model")).agg(F.min(MS("ts")).alias("started"), F.max(MS("ts")).alias("finished"))
    return rows.withColumn("status", F.when(F.col("model") == "error", "error").otherwise("done"))


def latency_badges(spark: SparkSession, d: str) -> DataFrame:
    return N.latency_badges(_spans(spark, d))


def problem_status(spark: SparkSession, d: str) -> DataFrame:
    e = read(spark, d, "events")
    status = F.element_at(F.create_map(*[F.lit(x) for kv in STATUS.items() for x in kv]), F.col("event_type"))
    return N.problem_status(e.select(F.col("user_id").alias("problem"), F.col("event_id").alias("model"), status.alias("status")))


TEMPLATES = [(1, "first", ["the", "and", "ing"]), (2, "second", ["que", "des", "les"]), (3, "third", ["der", "und", "sch"])]


def template_match(spark: SparkSession, d: str) -> DataFrame:
    templates = spark.createDataFrame(TEMPLATES, "place int, title string, keywords array<string>")
    return N.template_match(read(spark, d, "documents").select(F.col("doc_id").alias("id"), F.col("text").alias("body")), templates)


def dedup_longest_text(spark: SparkSession, d: str) -> DataFrame:
    rows = read(spark, d, "documents").select("source", "lang", "text").distinct()
    best = R.longest_text(rows, ["source", "lang"])
    return best.select("source", "lang", F.length("text").cast("long").alias("chars"), F.md5(F.col("text").cast("binary")).alias("text_md5"))


def dedup_hash_largest(spark: SparkSession, d: str) -> DataFrame:
    rows = read(spark, d, "documents").select("doc_id", "source", F.col("text").alias("content"), (F.col("n_chars") % 997).alias("area"))
    return R.largest_crop(rows, ["source"], "doc_id").select("source", "content_md5", "area")


def gt_left_join_pivot(spark: SparkSession, d: str) -> DataFrame:
    docs, labels = read(spark, d, "documents"), read(spark, d, "labels")
    truth = R.last_wins(labels.withColumn("desc", F.concat(F.lit("q"), F.col("quality"))), "doc_id", "desc", "toxic")
    cells = docs.select("doc_id", F.element_at(F.array(*map(F.lit, ("a", "b", "c", "d"))), (F.col("doc_id") % 4 + 1).cast("int")).alias("model_key"), F.md5(T.one_line(F.col("text")).cast("binary")).alias("cell"))
    more = docs.select("doc_id", F.lit("d").alias("model_key"), F.lit("again").alias("cell")).where("doc_id % 4 <> 3")
    table = R.comparison_table(cells.unionByName(more), "doc_id", ["a", "b", "c", "d"])
    return R.with_truth(table, truth, "doc_id", "desc")


def known_page_match(spark: SparkSession, d: str) -> DataFrame:
    docs = read(spark, d, "documents")
    return R.exact_pages(docs.select(F.col("doc_id").alias("id"), F.col("text").alias("content")), docs.select(F.col("doc_id").alias("page_id"), F.col("text").alias("content")))


def _known_pages(spark: SparkSession, d: str) -> DataFrame:
    """(page_id, width, height, thumb): each vector is a thumbnail of whole numbers; some pages look like others but for their size."""
    v, n = read(spark, d, "embeddings"), F.col("page_id")
    thumb = F.transform("embedding", lambda x: F.floor(x.cast("double") * 100 + 128))
    pages = v.select(F.col("vec_id").alias("page_id"), thumb.alias("thumb"))
    twice = pages.where("page_id % 4 = 0").withColumn("page_id", n + 1_000_000)
    return pages.unionByName(twice).withColumns({"width": F.when(n >= 1_000_000, 1654).otherwise(1240 + n % 3), "height": F.when(n >= 1_000_000, 2339).otherwise(F.lit(1754))})


def _uploads(spark: SparkSession, d: str) -> DataFrame:
    """The same looks, some of whose points are brighter by one, of the same size, the same shape or another shape."""
    v, n = read(spark, d, "embeddings"), F.col("id")
    k = F.element_at(F.array(*map(F.lit, (64, 8, 4, 2))), (n % 4 + 1).cast("int"))
    thumb = F.transform("embedding", lambda x, i: F.floor(x.cast("double") * 100 + 128) + F.when(i % k == n % k, 1).otherwise(0))
    size = n.cast("long") % 5
    width = F.when(size < 3, 1240 + n % 3).when(size == 3, 2 * (1240 + n % 3)).otherwise(F.lit(1000))
    return v.select(F.col("vec_id").alias("id"), "embedding").select("id", thumb.alias("thumb"), width.alias("width"), F.when(size == 3, 3508).otherwise(F.lit(1754)).alias("height"))


def known_page_nearest(spark: SparkSession, d: str) -> DataFrame:
    found = P.nearest_pages(_uploads(spark, d), _known_pages(spark, d))
    return found.select("id", "page_id", F.floor(F.col("off") * 10_000 + 0.5).cast("long").alias("off_e4"), "same_size")


def page_id_parse(spark: SparkSession, d: str) -> DataFrame:
    n = F.col("page_id")
    made = F.when(n % 3 == 0, F.concat(F.lit("sat_math_odd_page_"), (n % 7).cast("string"), F.lit("_"), n.cast("string"))).when(n % 3 == 1, F.concat((2022 + n % 5).cast("string"), F.lit("_math_odd_page_"), (n % 24).cast("string"))).otherwise(F.col("url"))
    rows = read(spark, d, "pages").select("page_id", made.alias("key"), F.when(n % 10 == 9, "x").otherwise((n % 40).cast("string")).alias("qid")).withColumn("spec", R.page_spec(F.col("key")))
    return rows.select("page_id", "key", "qid", F.col("spec.document_type").alias("document_type"), F.col("spec.subject_key").alias("subject_key"), F.col("spec.stored_page_key").alias("stored_page_key"), R.detection_id(F.col("spec"), F.col("qid")).alias("detection_id"))


def source_priority(spark: SparkSession, d: str) -> DataFrame:
    """Precomputed results before stored ones; a first source without questions ends the search."""
    li = read(spark, d, "lineitem").select(F.col("l_orderkey").alias("page"), F.col("l_suppkey").alias("priority"), F.col("l_partkey").alias("path"), F.col("l_quantity").cast("long").alias("questions"))
    return R.by_priority(li.groupBy("page", "priority", "path").agg(F.max("questions").alias("questions")), ["page"], "questions > 5")


def stored_text_by_position(spark: SparkSession, d: str) -> DataFrame:
    c = read(spark, d, "conversations")
    pages = c.groupBy(F.col("conv_id").alias("page")).agg(F.transform(F.array_sort(F.collect_list(F.struct("turn", "role"))), lambda x: x["role"]).alias("questions"))
    texts = c.where("turn % 2 = 0").select(F.col("conv_id").alias("page"), (F.col("turn") + 1).alias("number"), F.when(F.col("turn") % 4 == 0, "").otherwise(F.col("text")).alias("text"))
    return R.stored_texts(pages, texts).select("page", F.col("pos").cast("long").alias("pos"), "text")


def crop_geometry(spark: SparkSession, d: str) -> DataFrame:
    li = read(spark, d, "lineitem")
    k, unit = F.col("l_partkey"), F.col("l_linenumber") % 2 == 0
    v = lambda m, s: F.when(unit, (k * m % 100) / 100.0).otherwise((k * m % s).cast("double"))
    box = R.crop_box(v(3, 2600), v(7, 3600), v(11, 900), v(13, 900), F.lit(2480), F.lit(3508))
    return li.select("l_orderkey", "l_linenumber", "l_partkey", "l_suppkey", box.alias("b")).select("l_orderkey", "l_linenumber", "l_partkey", "l_suppkey", "b.x", "b.y", "b.w", "b.h")


def natural_order(spark: SparkSession, d: str) -> DataFrame:
    from pyspark.sql import Window

    p = read(spark, d, "part").select("p_partkey", F.concat(F.lit("p"), (F.col("p_partkey") * 7919 % 100_003).cast("string")).alias("name"))
    return p.withColumn("place", F.row_number().over(Window.partitionBy(F.col("p_partkey") % 10).orderBy(*R.natural_key(F.col("name")), "p_partkey")).cast("long")).select("p_partkey", "name", "place")


#: Words that differ in case, accents and place in the alphabet.
WORDS = ("Étape ", "etape ", "Zebra", "alpha-", "Über", "uber", "Ébauche ", "10 ", "9 ")


def collated_order(spark: SparkSession, d: str) -> DataFrame:
    """Parts in the order of made titles, within ten groups: words of either case, with and without accents, and numbers at both ends."""
    from pyspark.sql import Window

    n, s = F.col("p_partkey"), lambda c: c.cast("string")
    word = F.element_at(F.array(*map(F.lit, WORDS)), (n % len(WORDS) + 1).cast("int"))
    rows = read(spark, d, "part").select("p_partkey", F.concat(word, s(n * 7919 % 103)).alias("title"))
    place = F.row_number().over(Window.partitionBy(n % 10).orderBy(R.collated_key(F.col("title")), "p_partkey"))
    return rows.select("p_partkey", "title", place.cast("long").alias("place"))


def classify_rules(spark: SparkSession, d: str) -> DataFrame:
    n = F.col("doc_id")
    text = F.when(n % 17 == 0, F.concat(F.lit("수학 영역 "), F.col("text"))).when(n % 17 == 1, F.concat(F.lit("한글 머리글입니다 가나다라 "), F.col("text"))).when(n % 17 == 2, F.concat(F.lit("module 1 "), F.col("text"))).otherwise(F.col("text"))
    aspect = (n % 30 + 60) / 100.0
    rows = read(spark, d, "documents").select("doc_id", C.by_rules(text, aspect).alias("r"), F.struct(F.when(n % 2 == 0, "sat").otherwise("csat").alias("label"), (n % 10 / 10.0).alias("confidence")).alias("m"))
    return rows.select("doc_id", F.col("r.label").alias("label"), F.floor(F.col("r.confidence") * 1000 + 0.5).cast("long").alias("confidence_milli"), C.routed("hybrid", F.col("r"), F.col("m")).alias("hybrid"), C.routed("model_first", F.col("r"), F.col("m")).alias("model_first"))


def class_counts(spark: SparkSession, d: str) -> DataFrame:
    return classify_rules(spark, d).groupBy("label").agg(F.count(F.lit(1)).alias("pages"))


def document_types(spark: SparkSession, d: str) -> DataFrame:
    n = F.col("page_id")
    given, pid = F.when(n % 4 == 0, " SAT ").when(n % 4 == 1, "other"), F.when(n % 3 == 0, "sat-1").when(n % 3 == 1, "2024_x").otherwise(F.col("url"))
    return read(spark, d, "pages").select("page_id", R.document_type(given, pid).alias("document_type"))


QUERIES = {f.__name__: f for f in (step_flows, step_layers, group_refs, group_transitions, group_row_offsets, answer_vote, answer_agreement, answer_color_rank, latency_badges, problem_status, template_match, dedup_longest_text, dedup_hash_largest, gt_left_join_pivot, known_page_match, known_page_nearest, page_id_parse, source_priority, stored_text_by_position, crop_geometry, natural_order, collated_order, classify_rules, class_counts, document_types)}

CELLS = "cells as (select user_id model, event_type grp, count(*) n from events group by all)"
NORM_ANSWER = r"trim(regexp_replace(regexp_replace(lower(answer), '\s+', ' ', 'g'), '[^\p{L}\p{N}.\-+/]', '', 'g'))"
ANSWERS = f"""answers as (select o_custkey problem, o_orderkey solver, case when o_orderkey % 11 = 0 then ' - ' else o_orderpriority end answer from orders),
    kept as (select *, {NORM_ANSWER} answer_key from answers where trim(answer) not in ('', '-', '—')),
    votes as (select problem, answer_key, arg_min(answer, solver) shown, count(*) votes, min(solver) first from kept group by all),
    placed as (select problem, answer_key, shown, votes, row_number() over (partition by problem order by votes desc, first) place from votes)"""
LABEL = """r as (select doc_id, case doc_id % 17 when 0 then '수학 영역 ' || text when 1 then '한글 머리글입니다 가나다라 ' || text when 2 then 'module 1 ' || text else text end t, (doc_id % 30 + 60) / 100 aspect from documents),
    s as (select *, regexp_replace(t, '\\s+', '', 'g') b from r), h as (select *, case when length(b) = 0 then 0 else (length(b) - length(regexp_replace(b, '[가-힣ᄀ-ᇿ㄰-㆏]', '', 'g'))) / length(b) end share from s),
    l as (select *, case when CSAT then 'csat' when share >= 0.08 then 'csat' when SAT then 'sat' when aspect >= 0.74 then 'sat' when aspect > 0 and aspect <= 0.72 then 'csat' else 'csat' end label,
        case when CSAT then 0.9 when share >= 0.08 then 0.5 + least(0.4, share) when SAT then 0.9 when aspect >= 0.74 then 0.7 when aspect > 0 and aspect <= 0.72 then 0.7 else 0.5 end conf from h)"""
LABEL = LABEL.replace("CSAT", "(" + " or ".join(f"contains(t, '{w}')" for w in C.CSAT_WORDS) + ")").replace("SAT", "(" + " or ".join(f"contains(lower(t), '{w.lower()}')" for w in C.SAT_WORDS) + ")")
SPEC = r"""p as (select page_id, case page_id % 3 when 0 then 'sat_math_odd_page_' || (page_id % 7) || '_' || page_id when 1 then (2022 + page_id % 5) || '_math_odd_page_' || (page_id % 24) else url end key,
        case when page_id % 10 = 9 then 'x' else (page_id % 40)::varchar end qid from pages),
    m as (select *, regexp_extract(key, '^sat_math_odd_page_(\d+)_(\d+)$', 1) t, regexp_extract(key, '^sat_math_odd_page_(\d+)_(\d+)$', 2) sp, regexp_extract(key, '^(\d{4})_math_odd_page_(\d+)$', 1) y, regexp_extract(key, '^(\d{4})_math_odd_page_(\d+)$', 2) cp from p),
    z as (select *, case when length(sp) < 3 then lpad(sp, 3, '0') else sp end sz, case when length(cp) < 3 then lpad(cp, 3, '0') else cp end cz, try_cast(qid as int) q from m)"""

ORACLES = {
    "step_flows": f"with {STEPS}, f as (select problem, solver, idx from_step, lead(idx) over (partition by problem, solver order by idx) to_step from steps) select * from f where to_step is not null",
    "step_layers": f"with {STEPS} select problem, idx, count(distinct solver) solvers, floor(avg(solver) * 1000 + 0.5)::bigint mean_solver_milli, count(distinct solver) >= 2 shared from steps group by problem, idx",
    "group_refs": f"""with {STEPS}, refs as (select problem, idx % 3 group_no, solver, idx + solver % 2 * 3 idx from steps), j as (select r.problem, r.group_no, case when s.problem is null then 'missed' else 'step' end kind from refs r left join steps s on r.problem = s.problem and r.solver = s.solver and r.idx = s.idx)
        select problem, group_no, count(*) refs, kind from j group by all""",
    "group_transitions": f"with {CELLS}, r as (select grp, row_number() over (order by grp) row_no from (select distinct grp from cells)), e as (select model, row_no from_row, lead(row_no) over (partition by model order by row_no) to_row from cells join r using (grp)) select from_row, to_row, count(*) models from e where to_row is not null group by all",
    "group_row_offsets": f"with {CELLS}, r as (select grp, greatest(max(n), 1) * 24 height from cells group by grp) select grp, height, coalesce(sum(height + 10) over (order by grp rows between unbounded preceding and 1 preceding), 0)::bigint top from r",
    "answer_vote": f"with {ANSWERS} select * from placed",
    "answer_agreement": f"""with {ANSWERS}, t as (select problem, answer_key from placed where place = 1), r as (select a.problem, ({NORM_ANSWER.replace('answer', 'a.answer')} = t.answer_key)::int agrees from answers a join t on a.problem = t.problem)
        select problem, count(*) n_answers, sum(agrees)::bigint n_agree, count(*) = sum(agrees) unanimous from r group by problem""",
    "answer_color_rank": "select o_custkey, o_orderpriority, (dense_rank() over (partition by o_custkey order by o_orderpriority) - 1) % 5 colour from (select distinct o_custkey, o_orderpriority from orders)",
    "latency_badges": """with s as (select user_id problem, event_type model, epoch_us(min(ts)) // 1000 started, epoch_us(max(ts)) // 1000 finished from events group by all), d as (select *, case when finished > started then finished - started end duration from s),
        w as (select *, min(duration) over (partition by problem) low, max(duration) over (partition by problem) high from d)
        select problem, model, duration, case when model = 'error' or duration is null then null when duration / low <= 1.05::double then 'fastest' when duration >= high * 0.95::double then 'slowest' else floor(duration / low * 10 + 0.5)::bigint || '/10x' end badge from w""",
    "problem_status": """with m as (select user_id problem, case event_type when 'view' then 'idle' when 'click' then 'streaming' when 'purchase' then 'done' when 'error' then 'error' else 'stopped' end status from events)
        select problem, case when bool_or(status = 'streaming') then 'streaming' when bool_and(status in ('done', 'error', 'stopped')) then case when bool_or(status = 'error') then 'error' else 'done' end else 'idle' end status from m group by problem""",
    "template_match": r"""with t as (select doc_id id, regexp_replace(lower(text), '\s+|\\', '', 'g') n from documents),
        h as (select id, contains(n, 'the')::bigint + contains(n, 'and')::bigint + contains(n, 'ing')::bigint a, contains(n, 'que')::bigint + contains(n, 'des')::bigint + contains(n, 'les')::bigint b, contains(n, 'der')::bigint + contains(n, 'und')::bigint + contains(n, 'sch')::bigint c from t)
        select id, case when a >= greatest(b, c) then 'first' when b >= c then 'second' else 'third' end title, greatest(a, b, c) hits from h where greatest(a, b, c) >= 2""",
    "dedup_longest_text": "with r as (select distinct source, lang, text from documents) select source, lang, length(text) chars, md5(text) text_md5 from r qualify row_number() over (partition by source, lang order by length(text) desc, text) = 1",
    "dedup_hash_largest": "with r as (select doc_id, source, md5(text) content_md5, n_chars % 997 area from documents), o as (select * from r qualify row_number() over (partition by source, content_md5 order by doc_id) = 1) select source, content_md5, area from o qualify row_number() over (partition by source order by area desc, content_md5) = 1",
    "gt_left_join_pivot": r"""with l as (select doc_id, 'q' || arg_max(quality, toxic) "desc" from labels group by 1), c as (select doc_id, doc_id % 4 k, md5(trim(regexp_replace(text, '\r\n|\r|\n', ' ', 'g'))) cell from documents)
        select doc_id, case when k = 0 then cell end a, case when k = 1 then cell end b, case when k = 2 then cell end c, case when k = 3 then cell else 'again' end d, coalesce("desc", '') "desc" from c left join l using (doc_id)""",
    "known_page_match": "select d.doc_id id, min(k.doc_id) page_id from documents d join documents k on d.text = k.text group by d.doc_id",
    "known_page_nearest": """with t as (select vec_id, list_transform(embedding, lambda x: floor(x::double * 100 + 128)) e, vec_id % 3 k3, vec_id % 5 k5, ([64, 8, 4, 2])[vec_id % 4 + 1] k from embeddings),
        known as (select vec_id page_id, 1240 + k3 w, 1754 h, e from t union all select vec_id + 1000000, 1654, 2339, e from t where vec_id % 4 = 0),
        uploads as (select vec_id id, case when k5 < 3 then 1240 + k3 when k5 = 3 then 2 * (1240 + k3) else 1000 end w, case when k5 = 3 then 3508 else 1754 end h, list_transform(e, lambda x, i: x + case when (i - 1) % k = vec_id % k then 1 else 0 end) e from t),
        p as (select u.id, n.page_id, u.w = n.w and u.h = n.h same_size, list_sum(list_transform(list_zip(u.e, n.e), lambda z: abs(z[1] - z[2]))) / len(u.e) off from uploads u join known n on (u.w = n.w and u.h = n.h) or abs(u.w::double / u.h - n.w::double / n.h) <= 0.005::double)
        select id, page_id, floor(off * 10000 + 0.5)::bigint off_e4, same_size from p where off <= case when same_size then 0.35 else 0.20 end qualify row_number() over (partition by id order by off, page_id) = 1""",
    "page_id_parse": f"""with {SPEC} select page_id, key, qid, case when sp <> '' then 'sat' when y <> '' then 'csat' end document_type, case when sp <> '' then 'sat-practice-test-' || t || '-math' when y <> '' then y || '_math_odd' end subject_key, case when sp <> '' then t || '_' || sz when y <> '' then cz end stored_page_key,
        case when sp <> '' then 'sat_' || t || '_' || sz || '_' || qid when y = '' then null when y = '2026' or q is null then y || '_math_odd_page_' || cz || '_' || qid when q <= 22 then y || '_odd_common_' || q
            when cz::int between 1 and 8 then y || '_odd_common_' || q when cz::int between 9 and 12 then y || '_odd_probability_' || q when cz::int between 13 and 16 then y || '_odd_calculus_' || q when cz::int between 17 and 20 then y || '_odd_geometry_' || q
            else y || '_math_odd_page_' || cz || '_' || qid end detection_id from z""",
    "stored_text_by_position": """with q as (select conv_id page, row_number() over (partition by conv_id order by turn, role) - 1 pos, role from conversations), t as (select conv_id page, turn pos, case when turn % 4 = 0 then '' else text end stored from conversations where turn % 2 = 0)
        select q.page, q.pos, coalesce(nullif(stored, ''), role) text from q left join t on q.page = t.page and q.pos = t.pos""",
    "crop_geometry": """with v as (select *, l_linenumber % 2 = 0 u, case when l_linenumber % 2 = 0 then (l_partkey * 3 % 100) / 100 else l_partkey * 3 % 2600 end x0, case when l_linenumber % 2 = 0 then (l_partkey * 7 % 100) / 100 else l_partkey * 7 % 3600 end y0,
            case when l_linenumber % 2 = 0 then (l_partkey * 11 % 100) / 100 else l_partkey * 11 % 900 end w0, case when l_linenumber % 2 = 0 then (l_partkey * 13 % 100) / 100 else l_partkey * 13 % 900 end h0 from lineitem),
        n as (select *, x0 between 0 and 1 and y0 between 0 and 1 and w0 > 0 and w0 <= 1 and h0 > 0 and h0 <= 1 k from v),
        p as (select *, floor(case when k then x0 * 2480 else x0 end + 0.5)::bigint px, floor(case when k then y0 * 3508 else y0 end + 0.5)::bigint py, floor(case when k then w0 * 2480 else w0 end + 0.5)::bigint pw, floor(case when k then h0 * 3508 else h0 end + 0.5)::bigint ph from n),
        c as (select *, greatest(0, least(px, 2479)) x, greatest(0, least(py, 3507)) y from p)
        select l_orderkey, l_linenumber, l_partkey, l_suppkey, x, y, greatest(1, least(pw, 2480 - x)) w, greatest(1, least(ph, 3508 - y)) h from c""",
    "natural_order": "with p as (select p_partkey, 'p' || (p_partkey * 7919 % 100003) as name from part) select p_partkey, name, row_number() over (partition by p_partkey % 10 order by substr(name, 2)::bigint, p_partkey) place from p",
    "collated_order": f"""with t as (select p_partkey, ({list(WORDS)})[p_partkey % {len(WORDS)} + 1] w, p_partkey * 7919 % 103 n from part), k as (select *, case when w[1] between '0' and '9' then w[:-2]::int end first from t)
        select p_partkey, w || n title, row_number() over (partition by p_partkey % 10 order by coalesce(first, 1000000), lower(strip_accents(w)), n, p_partkey) place from k""",
    "classify_rules": f"""with {LABEL} select doc_id, label, floor(conf * 1000 + 0.5)::bigint confidence_milli, case when conf >= 0.6 then label when doc_id % 2 = 0 then 'sat' else 'csat' end hybrid,
        case when doc_id % 10 / 10 >= 0.8 then case when doc_id % 2 = 0 then 'sat' else 'csat' end else label end model_first from l""",
    "class_counts": f"with {LABEL} select label, count(*) pages from l group by label",
    "document_types": "select page_id, case when page_id % 4 = 0 then 'sat' when page_id % 3 = 0 then 'sat' when page_id % 3 = 1 then 'csat' end document_type from pages",
    "source_priority": "with r as (select l_orderkey page, l_suppkey priority, l_partkey path, max(trunc(l_quantity)::bigint) questions from lineitem group by all), f as (select * from r qualify row_number() over (partition by page order by priority, path) = 1) select * from f where questions > 5",
}
