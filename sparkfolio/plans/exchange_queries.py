"""Queries over sources, detections and what goes to and from models, with the SQL that gives the same rows."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from ..functions import text as T
from ..operators import app as A
from ..operators import detections as D
from ..operators import drawing as W
from ..operators import exchange as X
from ..operators import layout as L
from ..sources.tables import HEIGHT, WIDTH, read, steps

s = lambda c: c.cast("string")
md5 = lambda c: F.md5(c.cast("binary"))


def first_existing_path(spark: SparkSession, d: str) -> DataFrame:
    li = read(spark, d, "lineitem")
    found = li.select(F.col("l_orderkey").alias("id"), (F.col("l_linenumber").cast("long") * 1_000_000_000 + F.col("l_partkey")).alias("priority"), F.concat(F.lit("p"), s(F.col("l_partkey"))).alias("path"))
    return D.first_existing(found, read(spark, d, "part").where("p_partkey % 3 = 0").select(F.concat(F.lit("p"), s(F.col("p_partkey"))).alias("path")))


def page_images(spark: SparkSession, d: str) -> DataFrame:
    n = F.col("page_id")
    return D.page_images(read(spark, d, "pages").select(F.concat(F.lit("/d/img_"), s(n), F.when(n % 5 == 0, "_crop").otherwise(""), F.when(n % 4 == 0, ".jpg").otherwise(".png")).alias("path")))


def selected_sources(spark: SparkSession, d: str) -> DataFrame:
    n = F.col("o_orderkey")
    rows = read(spark, d, "orders").select((n % 6 + 2021).cast("int").alias("year"), n.alias("ord"), n.alias("id"), F.when(n % 3 > 0, F.col("o_orderpriority")).alias("content"))
    return D.selected_sources(rows, 100).select("year", F.col("turn").cast("long").alias("turn"), "id", "content")


def sliced_pages(spark: SparkSession, d: str) -> DataFrame:
    pages = D.sliced_pages(read(spark, d, "documents").select(F.col("doc_id").alias("ord"), F.col("text").alias("desc")))
    pages = D.absent_pages(pages, read(spark, d, "pages").where("page_id % 7 = 0").select(F.col("page_id").alias("page")))
    return pages.select("page", "qid", md5(F.col("merged_text")).alias("text_md5"), "x1", "y1", "x2", "y2")


def _questions(spark: SparkSession, d: str) -> DataFrame:
    """Four documents a page; boxes as JSON, some of them broken; every fifth text corrected, every third id given."""
    n = F.col("doc_id")
    box = F.when(n % 11 == 0, "no box").when(n % 11 == 1, "[1, 2, 3]").when(n % 11 == 2, '["7", "8.9", 107, 208]').otherwise(F.concat(F.lit("["), s(n * 31 % 2000), F.lit(", "), s(n * 17 % 3000), F.lit(".75, "), s(n * 31 % 2000 + 90), F.lit(", "), s(n * 17 % 3000 + 60), F.lit("]")))
    return read(spark, d, "documents").select(
        F.floor(n / 4).cast("long").alias("page"), (n % 4).alias("pos"), F.lit(WIDTH).alias("width"), F.when(n % 13 == 0, 0).otherwise(HEIGHT).alias("height"), s(n % 4 + 1).alias("qid"), D.parsed_box(box).alias("bbox"),
        F.when(n % 3 == 0, F.concat(F.lit("own"), s(n))).alias("detection_id"), F.when(n % 6 == 0, "named").alias("label"), F.col("text").alias("merged_text"),
        F.when(n % 5 == 0, F.concat(F.lit(" corrected "), s(n))).alias("postcorrection_text"), F.lit(None).cast("string").alias("text_source"), F.when(n % 2 == 0, F.base64(s(n).cast("binary"))).alias("crop_b64"), n.alias("ord"),
    )


def page_detections(spark: SparkSession, d: str) -> DataFrame:
    asked = _questions(spark, d)
    stored = D.page_texts(asked.where("page % 2 = 0").select("page", "ord", F.when(F.col("pos") == 3, "").otherwise(F.col("qid")).alias("qid"), F.concat(F.lit("stored "), s(F.col("ord"))).alias("text")))
    found = D.detections(asked, stored, demo=True)
    milli = lambda c: F.floor(F.col(c) * 1000 + 0.5).cast("long").alias(f"{c}_milli")
    return found.select("page", "pos", "id", *map(milli, "xywh"), "label", md5(F.col("text")).alias("text_md5"), "crop_url")


def chosen_texts(spark: SparkSession, d: str) -> DataFrame:
    n = F.col("doc_id")
    text = D.chosen_text(F.when(n % 4 == 0, F.concat(F.lit("c"), s(n))), F.when(n % 4 == 1, F.concat(F.lit(" r"), s(n))).otherwise("  "), F.when(n % 4 == 2, F.col("text")).otherwise(""), F.when(n % 8 == 3, "crop"))
    return read(spark, d, "documents").select("doc_id", md5(text).alias("text_md5"))


def question_crops(spark: SparkSession, d: str) -> DataFrame:
    crops = read(spark, d, "labels").groupBy("doc_id").agg(F.max(F.concat(F.lit("crop"), s(F.col("quality")))).alias("crop"))
    return D.with_crops(read(spark, d, "documents").select("doc_id", "n_chars"), crops, ["doc_id"])


def problem_contexts(spark: SparkSession, d: str) -> DataFrame:
    found = read(spark, d, "customer").where("c_custkey % 3 > 0").select(F.col("c_custkey").alias("id"), F.col("c_name").alias("label"), F.when(F.col("c_custkey") % 2 == 0, F.col("c_mktsegment")).otherwise("").alias("text"))
    return D.problem_context(read(spark, d, "orders").select(F.col("o_custkey").alias("id")).distinct(), found)


def legacy_page_keys(spark: SparkSession, d: str) -> DataFrame:
    n = F.col("page_id")
    year, page = F.when(n % 3 == 0, "sat").when(n % 3 == 1, s(n % 9)), F.when(n % 2 == 0, F.concat(s(n % 7), F.lit("_"), s(n), F.lit("_x"))).otherwise(s(n))
    rows = read(spark, d, "pages").select("page_id", D.legacy_page_key(year, page).alias("legacy"), D.split_legacy_page(year, page).alias("p"))
    return rows.select("page_id", "legacy", F.col("p.year").alias("year"), F.col("p.page").alias("page"))


def contour_boxes(spark: SparkSession, d: str) -> DataFrame:
    k, p = F.col("l_partkey"), F.col("l_suppkey")
    rows = read(spark, d, "lineitem").select("l_orderkey", "l_linenumber", "l_partkey", "l_suppkey", (k * 37 % WIDTH).alias("x"), (k * 53 % HEIGHT).alias("y"), (k % 120).alias("w"), (p * 7 % 110).alias("h"), (p % 160).cast("double").alias("mean"), (k % 50 / 100.0).alias("white"), (k % 97 / 97.0).alias("dark"), (p * 3 % 120).cast("double").alias("border"))
    return L.contour_candidates(rows, WIDTH, HEIGHT).select("l_orderkey", "l_linenumber", "l_partkey", "l_suppkey", "x", "y", "w", "h")


def _parts(text, n):
    part = lambda kind, **own: F.struct(F.lit(kind).alias("type"), *[own.get(k, F.lit(None).cast("string")).alias(k) for k in ("text", "source", "media_type", "data", "url")])
    return F.array(part("text", text=text), part("image", source=F.lit("base64"), media_type=F.when(n % 2 == 0, "image/jpeg"), data=s(n)), part("image_url", url=F.concat(F.lit("u"), s(n))))


def message_parts(spark: SparkSession, d: str) -> DataFrame:
    parts = _parts(F.col("text"), F.col("turn"))
    flat = lambda ps: md5(F.array_join(F.transform(ps, lambda x: F.concat(x["type"], F.lit("="), x["value"])), "|"))
    messages = F.array(F.struct(F.when(F.col("role") != "user", F.col("role")).alias("role"), X.response_parts(parts).alias("content")))
    roles = F.array_join(F.transform(X.with_prompt(F.lit("solve"), messages), lambda m: m["role"]), ",")
    return read(spark, d, "conversations").select("conv_id", "turn", "role", flat(X.chat_parts(parts)).alias("chat_md5"), flat(X.response_parts(parts)).alias("response_md5"), roles.alias("roles"))


def reply_texts(spark: SparkSession, d: str) -> DataFrame:
    n, said = F.col("turn"), lambda kind, t: F.struct(F.lit(kind).alias("type"), t.alias("text"))
    none = F.array().cast("array<struct<type:string,text:string>>")
    outputs = F.array(F.struct(F.lit("reasoning").alias("type"), F.array(said("text", F.lit("hidden"))).alias("content")), F.struct(F.lit("message").alias("type"), F.when(n % 3 == 0, none).otherwise(F.array(said("output_text", F.col("text")), said("refusal", F.lit("no")), said("text", F.lit("!")))).alias("content")))
    return read(spark, d, "conversations").select("conv_id", "turn", "role", md5(X.reply_text(F.when(n % 4 == 0, F.concat(F.lit(" "), F.col("role"), F.lit("\n"))).otherwise(" "), outputs)).alias("text_md5"))


def braced_replies(spark: SparkSession, d: str) -> DataFrame:
    n = F.col("event_id")
    whole = F.concat(F.lit('{"rows": [{"label": "'), F.col("event_type"), F.lit('"}], "n": '), s(n), F.lit("}"))
    reply = F.when(n % 4 == 0, "no object").when(n % 4 == 1, F.concat(F.lit("Here:\n"), whole, F.lit("\nbye"))).when(n % 4 == 2, F.concat(whole, F.lit(" and }"))).otherwise(whole)
    inside = X.braced(reply)
    return read(spark, d, "events").select("event_id", F.length(inside).cast("long").alias("chars"), F.from_json(inside, "n long, rows array<struct<label:string>>")["n"].alias("n"))


def result_texts(spark: SparkSession, d: str) -> DataFrame:
    """Models beside the first result that has their id or their name."""
    own = steps(spark, d).groupBy("problem", "solver").agg(F.transform(F.array_sort(F.collect_list(F.struct("idx", "title", "body"))), lambda x: F.struct(x["title"].alias("title"), F.md5(x["body"].cast("binary")).alias("body"))).alias("steps"))
    n = F.col("problem") * 5 + F.col("solver")
    results = own.select(n.alias("pos"), F.when(n % 2 == 0, F.concat(F.lit("m"), s(n))).alias("model_id"), F.concat(F.lit("Model "), s(n)).alias("name"), "steps", s(n).alias("answer"))
    asked = read(spark, d, "customer").select(F.concat(F.lit("m"), s(F.col("c_custkey"))).alias("model_id"), F.concat(F.lit("Model "), s(F.col("c_custkey"))).alias("name"))
    found = X.by_id_or_name(asked, results)
    return found.select("model_id", "pos", md5(X.stream_text(F.col("name"), F.col("steps"), F.col("answer"))).alias("text_md5"))


def model_logos(spark: SparkSession, d: str) -> DataFrame:
    n = (F.col("c_custkey") % 6 + 1).cast("int")
    prefix = F.element_at(F.array(*map(F.lit, ("openai/", "anthropic/", "google/", "x-ai/", "own/", "openai"))), n)
    return read(spark, d, "customer").select("c_custkey", X.logo(F.concat(prefix, F.col("c_name"))).alias("logo"))


def missing_keys(spark: SparkSession, d: str) -> DataFrame:
    e = read(spark, d, "events").select(F.col("event_id").alias("problem"), F.col("user_id").alias("model"), F.concat(F.lit("KEY_"), F.upper("event_type")).alias("key_name"))
    keys = spark.createDataFrame([("KEY_CLICK",), ("KEY_VIEW",), ("KEY_CLICK",)], "key_name string")
    run, errors = X.without_keys(e, keys)
    return errors.select("problem", "model", "event", "message").unionByName(run.select("problem", "model", F.lit("run").alias("event"), F.lit(None).cast("string").alias("message")))


def converted_texts(spark: SparkSession, d: str) -> DataFrame:
    n = F.col("doc_id")
    tag = F.lit("<|ref|>text<|/ref|><|det|>[[1, 2, 3, 4]]<|/det|>")
    asked = read(spark, d, "documents").select(F.concat(F.lit("p "), s(n)).alias("id"), F.when(n % 5 == 0, " ").otherwise(F.concat(tag, s(n), F.lit(" x ⑤ 12"))).alias("raw"))
    cache = read(spark, d, "documents").where("doc_id % 3 = 0").select(F.concat(F.lit("p_"), s(n)).alias("slug"), F.when(n % 2 == 0, F.concat(F.lit(" cached "), s(n), F.lit(" ⑤"))).otherwise(" ").alias("text"))
    return X.converted(asked, cache, "no such model")


def selected_pages(spark: SparkSession, d: str) -> DataFrame:
    """Requests of which groups, years and pages are there or not, older ones that name test and page together among them."""
    li, o = read(spark, d, "lineitem"), read(spark, d, "orders")
    csat, text = F.col("l_suppkey") % 2 == 0, lambda x: x.cast("string")
    pages = li.select(F.when(F.col("l_suppkey") % 10 == 9, "draft").when(csat, "csat").otherwise("sat").alias("grp"), text(F.when(csat, F.col("l_linenumber") + 2020).otherwise(F.col("l_linenumber") * 3)).alias("year"), F.when(csat, F.lpad(text(F.col("l_partkey") % 50 + 2), 3, "0")).otherwise(text(F.col("l_partkey") % 50 + 2)).alias("page"))
    n, old = F.col("o_custkey") % 5, F.col("o_custkey") % 5 == 3
    grp = F.when(n < 2, "csat").when(n < 4, "sat").otherwise("draft")
    year = F.when(old, "sat").when(n == 1, None).when(n == 2, text(F.col("o_orderkey") % 9 * 2)).otherwise(text(F.col("o_orderkey") % 9 + 2019))
    page = F.when(old, F.concat_ws("_", text(F.col("o_orderkey") % 9 * 2), text(F.col("o_orderkey") % 60))).when(n == 2, text(F.col("o_orderkey") % 60)).otherwise(F.lpad(text(F.col("o_orderkey") % 60), 3, "0"))
    return A.selected(pages, o.select(F.col("o_orderkey").alias("id"), grp.alias("grp"), year.alias("year"), page.alias("page")))


def checked_ids(spark: SparkSession, d: str) -> DataFrame:
    li = read(spark, d, "lineitem").select(F.col("l_orderkey").alias("problem"), (F.col("l_partkey") % 20).alias("id"))
    return X.checked(li, read(spark, d, "orders").select(F.col("o_orderkey").alias("problem"), (F.col("o_custkey") % 20).alias("id")))


#: Titles of shared clusters by the words of their texts.
CLUSTER_TEMPLATES = [(1, "first template", ["the", "qu"]), (2, "second template", ["sch", "und", "der"])]


def _clustered(spark: SparkSession, d: str) -> tuple[DataFrame, DataFrame]:
    """Steps and the clusters' members: steps of one even place, and places of the third kind, of which one solver's come in twos."""
    own = steps(spark, d).withColumn("title", F.when(F.col("idx") % 4 == 0, "").otherwise(F.col("title")))
    alone = own.where("idx % 2 = 1 and solver = 1").select("problem", F.lit("own").alias("component"), "solver", "idx")
    return own, own.where("idx % 2 = 0").select("problem", s(F.col("idx")).alias("component"), "solver", "idx").unionByName(alone)


def step_clusters(spark: SparkSession, d: str) -> DataFrame:
    """Clusters over whole texts: shared ones, one solver's, and steps that stand alone; some titles by template."""
    own, members = _clustered(spark, d)
    found = X.clusters(own, members, spark.createDataFrame(CLUSTER_TEMPLATES, "place int, title string, keywords array<string>"))
    listed = F.array_join(F.transform("members", lambda m: F.concat_ws("/", s(m["solver"]), s(m["idx"]))), ",")
    milli = lambda c: F.floor(F.col(c) * 1000 + 0.5).cast("long")
    return found.select("problem", "key", "place", "shared", md5(F.col("title")).alias("title_md5"), "solvers", listed.alias("members"), milli("mean_idx").alias("mean_idx_milli"), milli("mean_solver").alias("mean_solver_milli"))


def _flow(spark: SparkSession, d: str, depth: int) -> tuple[DataFrame, DataFrame]:
    own, members = _clustered(spark, d)
    answer = F.when(F.col("solver") == 3, "").when(F.col("solver") % 2 == 0, F.concat(F.lit(" X "), s(F.col("problem") % 3))).otherwise(s(F.col("solver")))
    results = own.select("problem", "solver").distinct().select("problem", "solver", F.concat(F.lit("m"), s(F.col("solver"))).alias("model"), answer.alias("answer"))
    return W.drawn(results, X.clusters(own, members), depth)


def flow_nodes(spark: SparkSession, d: str) -> DataFrame:
    """Nodes of the drawings at depths 2 and 3."""
    milli = lambda c: F.floor(F.col(c) * 1000 + 0.5).cast("long")
    rows = [_flow(spark, d, k)[0].withColumn("depth", F.lit(k)) for k in (2, 3)]
    return rows[0].unionByName(rows[1]).select("problem", "depth", "node", "kind", milli("x").alias("x_milli"), milli("y").alias("y_milli"), "width", "height", "shared")


def flow_edges(spark: SparkSession, d: str) -> DataFrame:
    rows = [_flow(spark, d, k)[1].withColumn("depth", F.lit(k)) for k in (1, 2, 3)]
    return rows[0].unionByName(rows[1]).unionByName(rows[2])


QUERIES = {f.__name__: f for f in (first_existing_path, page_images, selected_sources, sliced_pages, page_detections, chosen_texts, question_crops, problem_contexts, legacy_page_keys, contour_boxes, message_parts, reply_texts, braced_replies, result_texts, model_logos, missing_keys, converted_texts, selected_pages, checked_ids, step_clusters, flow_nodes, flow_edges)}

BOX = """case when doc_id % 11 in (0, 1) then [0, 0, 0, 0] when doc_id % 11 = 2 then [7, 8, 107, 208] else [doc_id * 31 % 2000, doc_id * 17 % 3000, doc_id * 31 % 2000 + 90, doc_id * 17 % 3000 + 60] end"""
STOP = ", ".join(f"'{w}'" for w in T.TITLE_STOPWORDS)
TOKENS = rf"""list_filter(string_split(trim(regexp_replace(regexp_replace(regexp_replace(lower(said), '\\[a-zA-Z]+', ' ', 'g'), '[^\p{{L}}\p{{N}}\s]', ' ', 'g'), '\s+', ' ', 'g')), ' '), lambda w: w <> '' and w not in ({STOP}))"""
#: CTEs up to clustered (problem, key, place, shared, title, solvers, members, owner, mean_idx, mean_solver).
CLUSTERED = rf"""r as (select conv_id // 5 problem, conv_id % 5 solver, turn idx, case when turn % 4 = 0 then '' else split_part(text, '.', 1) end title, text body from conversations),
        o as (select *, regexp_replace(coalesce(title, ''), '^\s+|\s+$', '', 'g') t, case when idx % 2 = 0 then idx::varchar when solver = 1 then 'own' end component, concat_ws(' ', coalesce(title, ''), coalesce(body, '')) said from r),
        h as (select problem, component, list_distinct(list(t) filter (t <> '')) titles, arg_min(t, (solver, idx, t)) filter (t <> '') first, count(distinct solver) solvers, sum(distinct solver) / count(distinct solver) mean_solver, avg(idx) mean_idx,
            string_agg(solver || '/' || idx, ',' order by solver, idx) members, min(solver) owner, regexp_replace(lower(string_agg(said, ' ' order by solver, idx)), '\s+|\\', '', 'g') n, list((solver, idx) order by solver, idx) ms from o where component is not null group by all),
        w as (select problem, component, solver, idx, {TOKENS} ws from o where component is not null), x as (select problem, component, solver, idx, unnest(ws) token, generate_subscripts(ws, 1) pos from w),
        f as (select problem, component, token, count(*) n, min((solver, idx, pos)) seen from x group by all), k as (select *, row_number() over (partition by problem, component order by n desc, seen) rk from f), tt as (select problem, component, string_agg(token, ' · ' order by rk) tokens from k where rk <= 3 group by all),
        hits as (select *, contains(n, 'the')::int + contains(n, 'qu')::int a, contains(n, 'sch')::int + contains(n, 'und')::int + contains(n, 'der')::int b from h),
        u as (select h.problem, 'shared:' || h.component as key, solvers >= 2 shared, case when solvers >= 2 and greatest(a, b) >= 2 then case when a >= b then 'first template' else 'second template' end when len(titles) = 1 then titles[1] when tokens is not null then '{X.SHARED_TITLE}' || tokens else coalesce(first, '{X.UNTITLED}') end title,
                solvers, members, owner, mean_idx, mean_solver, 0 lone, ms from hits h left join tt on h.problem = tt.problem and h.component = tt.component
            union all select problem, 'solo:' || solver || ':' || idx, false, coalesce(nullif(title, ''), 'Step ' || (idx + 1)), 1, solver || '/' || idx, solver, idx, solver, 1, [(solver, idx)] from o where component is null),
        clustered as (select *, row_number() over (partition by problem order by mean_idx, mean_solver, lone, ms) place from u)"""


def sql_jitter(seed: str, amount: int) -> str:
    code = f"list_reduce(list_transform(string_split({seed}, ''), lambda c: ascii(c)::bigint), lambda h, c: (xor(h, c) * 16777619) % 4294967296, 2166136261::bigint)"
    return f"((({code} % 10000) / 10000.0::double - 0.5) * {amount}.0::double)"


def sql_placed(depth: int) -> str:
    v = W.LEVELS[depth]
    x = f"case when shared then centre + ({list(v.slots)})[row_ % {len(v.slots)} + 1] + row_ // {len(v.slots)} * {v.band_x} + {sql_jitter(f"'{v.seed}-shared-x-' || key", v.jitter_shared)} else centre + case when no <= mid then -1 else 1 end * ({v.solo} + abs(no - mid) * {v.solo_step}) + {sql_jitter(f"'{v.seed}-solo-x-' || key", v.jitter_solo)} end"
    y = f"{v.top} + stage * {v.gap} + {sql_jitter(f"'{v.seed}-y-' || key", v.jitter_y)} + case when shared then row_ // {len(v.slots)} * {v.band_y} else {'solo_stage_row' if v.by_stage else 'solo_row'} * {v.row} end"
    return f"select problem, {depth} depth, key, shared, {x} x, {y} y from ranked"


#: CTEs up to nodes, groups and each_ (a row a depth, model and step), after CLUSTERED.
FLOW = rf"""results as (select distinct problem, solver, 'm' || solver model, case when solver = 3 then '' when solver % 2 = 0 then ' X ' || (problem % 3) else solver::varchar end answer from o),
        models as (select *, greatest(980, 68 + n * 176 + (n - 1) * 16) flow, greatest(980, 68 + n * 176 + (n - 1) * 16) / 2 centre, (n - 1) / 2 mid from (select *, row_number() over (partition by problem order by solver) - 1 as no, count(*) over (partition by problem) n from results)),
        ranked as (select c.*, m.no, m.mid, m.centre, row_number() over (partition by c.problem, shared, stage order by place) - 1 row_, row_number() over (partition by c.problem, shared, owner order by place) - 1 solo_row, row_number() over (partition by c.problem, shared, owner, stage order by place) - 1 solo_stage_row
            from (select *, floor(mean_idx + 0.5) stage from clustered) c join models m on c.problem = m.problem and c.owner = m.solver),
        stood as ({sql_placed(2)} union all {sql_placed(3)}),
        each_ as (select p.problem, p.depth, p.key, p.shared, p.x, p.y, len(c.ms) n, unnest(c.ms)[2] idx, 'm' || unnest(c.ms)[1] model, generate_subscripts(c.ms, 1) - 1 pos from stood p join clustered c on p.problem = c.problem and p.key = c.key),
        given as (select *, coalesce(nullif(trim(regexp_replace(regexp_replace(lower(answer), '\s+', ' ', 'g'), '[^\p{{L}}\p{{N}}.\-+/]', '', 'g')), ''), '(empty)') as key from models),
        groups as (select *, row_number() over (partition by problem order by first) - 1 i, count(*) over (partition by problem) g from (select problem, key, min(no) first, any_value(flow) flow from given group by all)),
        nodes as (select problem, depth, 'problem' node, 'problem' kind, (flow - 320) / 2 x, 36.0::double y, 320 width, 96 height, false shared from models, (select unnest([2, 3]) depth) where no = 0
            union all select problem, depth, 'model-' || model, 'model', 34 + no * 192, 186, 176, 104, false from models, (select unnest([2, 3]) depth)
            union all select problem, depth, 'strategy-' || model, 'strategy', 34 + no * 192 + {sql_jitter("'strategy-' || model", 28)}, 330 + {sql_jitter("'strategy-y-' || model", 18)}, 176, 84, false from models, (select unnest([2, 3]) depth)
            union all select problem, 2, 'cluster-title-' || replace(key, ':', '-'), 'step', x, y, 236, 82, shared from stood where depth = 2
            union all select problem, 3, 'step-' || model || '-' || idx, 'step', x + (pos % ceil(sqrt(n)) - (ceil(sqrt(n)) - 1) / 2) * case when shared then 42 else 16 end, y + (floor(pos / ceil(sqrt(n))) - (ceil(n / ceil(sqrt(n))) - 1) / 2) * case when shared then 30 else 18 end, 236, 118, shared from each_ where depth = 3)"""
ORACLES = {
    "first_existing_path": "select l_orderkey id, arg_min('p' || l_partkey, l_linenumber::bigint * 1000000000 + l_partkey) filter (l_partkey % 3 = 0 and l_partkey in (select p_partkey from part)) path from lineitem group by 1",
    "page_images": "select 'img_' || page_id id, '/d/img_' || page_id || '.png' path from pages where page_id % 5 > 0 and page_id % 4 > 0",
    "selected_sources": """with r as (select (2021 + o_orderkey % 6)::int as year, o_orderkey id, case when o_orderkey % 3 > 0 then o_orderpriority end content from orders)
        select year, list_position([2024, 2025, 2026, 2022, 2023], year)::bigint turn, id, content from r where year > 2021 and (content is not null or year in (2022, 2026)) qualify row_number() over (partition by year order by id) <= 100""",
    "sliced_pages": r"""select doc_id // 4 + 1 page, (doc_id % 4 + 1)::varchar qid, md5(regexp_replace(text, '^\s+|\s+$', '', 'g')) text_md5, ([100, 100, 700, 700])[doc_id % 4 + 1] x1, ([400, 1100, 400, 1100])[doc_id % 4 + 1] y1, ([600, 600, 1200, 1200])[doc_id % 4 + 1] x2, ([900, 1600, 900, 1600])[doc_id % 4 + 1] y2
        from documents where doc_id // 4 + 1 not in (select page_id from pages where page_id % 7 = 0)""",
    "page_detections": rf"""with r as (select doc_id, doc_id // 4 page, doc_id % 4 pos, case when doc_id % 13 = 0 then 1 else {HEIGHT} end high, {BOX} b, case when doc_id % 3 = 0 then 'own' || doc_id end own, text from documents)
        select page, pos, coalesce(own, page || '_' || (pos + 1)) id, floor(b[1] / {WIDTH} * 1000 + 0.5)::bigint x_milli, floor(b[2] / high * 1000 + 0.5)::bigint y_milli, floor((b[3] - b[1]) / {WIDTH} * 1000 + 0.5)::bigint w_milli, floor((b[4] - b[2]) / high * 1000 + 0.5)::bigint h_milli,
            case when doc_id % 6 = 0 then 'named' when own is not null then own else page || '_' || (pos + 1) end as label,
            md5(case when doc_id % 5 = 0 then 'corrected ' || doc_id when page % 2 = 0 and pos < 3 then 'stored ' || doc_id else regexp_replace(text, '^\s+|\s+$', '', 'g') end) text_md5, case when doc_id % 2 = 0 then 'data:image/png;base64,' || to_base64(encode(doc_id::varchar)) end crop_url from r""",
    "chosen_texts": rf"""select doc_id, md5(case when doc_id % 4 = 0 then 'c' || doc_id when doc_id % 4 = 1 then 'r' || doc_id when doc_id % 4 = 2 then coalesce(nullif(regexp_replace(text, '^\s+|\s+$', '', 'g'), ''), '{D.NO_TEXT}') when doc_id % 8 = 3 then 'crop' else '{D.NO_TEXT}' end) text_md5 from documents""",
    "question_crops": "select d.doc_id, n_chars, coalesce(crop, '') crop from documents d left join (select doc_id, max('crop' || quality) crop from labels group by 1) l using (doc_id)",
    "problem_contexts": "select o.id, c_name as label, case when c_custkey % 2 = 0 then coalesce(nullif(c_mktsegment, ''), c_name) else c_name end as text from (select distinct o_custkey id from orders) o left join customer on c_custkey = id and c_custkey % 3 > 0",
    "legacy_page_keys": """with r as (select page_id, case page_id % 3 when 0 then 'sat' when 1 then (page_id % 9)::varchar end as year, case when page_id % 2 = 0 then (page_id % 7) || '_' || page_id || '_x' else page_id::varchar end page from pages)
        select page_id, case when page_id % 2 = 0 or year is null or year = 'sat' then page else year || '_' || page end legacy, case when year = 'sat' and page_id % 2 = 0 then split_part(page, '_', 1) else year end as year, case when year = 'sat' and page_id % 2 = 0 then page_id || '_x' else page end page from r""",
    "contour_boxes": f"""with r as (select l_orderkey, l_linenumber, l_partkey, l_suppkey, l_partkey * 37 % {WIDTH} x, l_partkey * 53 % {HEIGHT} y, l_partkey % 120 w, l_suppkey * 7 % 110 h from lineitem)
        select * from r where w * h between 150 and 20000 and w between 20 and 90 and h between 18 and 80 and y <= {int(0.4 * HEIGHT)} and (x < {int(0.42 * WIDTH)} or x > {int(0.48 * WIDTH)}) and l_suppkey % 160 <= 130 and l_partkey % 50 between 1 and 40 and l_partkey % 97 >= 54 and l_suppkey * 3 % 120 <= 90""",
    "message_parts": """with r as (select *, 'data:' || case when turn % 2 = 0 then 'image/jpeg' else 'image/png' end || ';base64,' || turn u from conversations where text is not null)
        select conv_id, turn, role, md5('text=' || text || '|image_url=' || u || '|image_url=u' || turn) chat_md5, md5('input_text=' || text || '|input_image=' || u || '|input_image=u' || turn) response_md5, 'system,' || role roles from r""",
    "reply_texts": r"select conv_id, turn, role, md5(case when turn % 4 = 0 then role when turn % 3 > 0 then regexp_replace(coalesce(text, '') || '!', '^\s+', '') end) text_md5 from conversations",
    "braced_replies": """with r as (select event_id, length('{"rows": [{"label": "' || event_type || '"}], "n": ' || event_id || '}') n from events)
        select event_id, case when event_id % 4 = 0 then null when event_id % 4 = 2 then n + 6 else n end::bigint chars, case when event_id % 4 > 0 then event_id end n from r""",
    "result_texts": r"""with w as (select conv_id n, '[' || string_agg('{"step_idx":' || k || ',"title":' || to_json(title) || ',"content":"' || md5(text) || '"}', ',' order by k) || ']' j from
            (select conv_id, text, split_part(text, '.', 1) title, row_number() over (partition by conv_id order by turn, split_part(text, '.', 1), text) - 1 k from conversations) group by conv_id)
        select 'm' || c_custkey model_id, n pos, md5(coalesce('{"model_name":"Model ' || n || '","steps":' || j || ',"final_answer":"' || n || '"}', '')) text_md5 from customer left join w on n = c_custkey""",
    "model_logos": "select c_custkey, (['openai.png', 'claude.png', 'gemini.jpeg', 'grok.png', 'openai.png', 'openai.png'])[c_custkey % 6 + 1] logo from customer",
    "missing_keys": "select event_id problem, user_id model, case when event_type in ('click', 'view') then 'run' else 'error' end as event, case when event_type not in ('click', 'view') then 'KEY_' || upper(event_type) || ' is missing' end message from events",
    "converted_texts": "select 'p ' || doc_id id, case when doc_id % 5 = 0 then '' when doc_id % 6 = 0 then 'cached ' || doc_id || ' ⑤ $12$' else doc_id || ' x ⑤ 12' end as text from documents",
    "selected_pages": """with p as (select distinct case when l_suppkey % 2 = 0 then 'csat' else 'sat' end grp, (case when l_suppkey % 2 = 0 then l_linenumber + 2020 else l_linenumber * 3 end)::varchar as year,
            case when l_suppkey % 2 = 0 then lpad((l_partkey % 50 + 2)::varchar, 3, '0') else (l_partkey % 50 + 2)::varchar end page from lineitem where l_suppkey % 10 <> 9),
        w as (select o_orderkey id, case when o_custkey % 5 in (2, 3) then 'sat' else 'csat' end grp, case o_custkey % 5 when 1 then null when 2 then (o_orderkey % 9 * 2)::varchar when 3 then (o_orderkey % 9 * 2)::varchar else (o_orderkey % 9 + 2019)::varchar end as year,
            case when o_custkey % 5 in (2, 3) then (o_orderkey % 60)::varchar else lpad((o_orderkey % 60)::varchar, 3, '0') end page from orders),
        y as (select grp, case when grp = 'csat' then max(year::int) else min(year::int) end::varchar first_year from p group by grp),
        r as (select w.id, w.grp, case when exists (select 1 from p where p.grp = w.grp and p.year = w.year) then w.year else y.first_year end as year, w.page from w join y using (grp))
        select r.id, r.grp, r.year, case when exists (select 1 from p where p.grp = r.grp and p.year = r.year and p.page = r.page) then r.page else (select arg_min(p.page, p.page::int) from p where p.grp = r.grp and p.year = r.year) end page from r""",
    "checked_ids": "select distinct l_orderkey problem, l_partkey % 20 id from lineitem join orders on l_orderkey = o_orderkey and l_partkey % 20 = o_custkey % 20",
    "step_clusters": f"""with {CLUSTERED} select problem, key, place, shared, md5(title) title_md5, solvers, members, floor(mean_idx * 1000 + 0.5)::bigint mean_idx_milli, floor(mean_solver * 1000 + 0.5)::bigint mean_solver_milli from clustered""",
    "flow_nodes": f"""with {CLUSTERED}, {FLOW}, low as (select problem, depth, max(y + height) low from nodes group by all),
        every as (select * from nodes union all select g.problem, l.depth, 'answer-' || g.key, 'answer', greatest(24, (g.flow - g.g * 246 - (g.g - 1) * 24) / 2) + g.i * 270, l.low + 170, 246, 118, false from groups g join low l using (problem))
        select problem, depth, node, kind, floor(x * 1000 + 0.5)::bigint x_milli, floor(y * 1000 + 0.5)::bigint y_milli, width, height, shared from every""",
    "flow_edges": f"""with {CLUSTERED}, {FLOW}, way as (select problem, depth, model, -9 as at_, 'problem' node from models, (select unnest([1, 2, 3]) depth) union all select problem, depth, model, -8, 'model-' || model from models, (select unnest([1, 2, 3]) depth)
            union all select problem, depth, model, -7, 'strategy-' || model from models, (select unnest([2, 3]) depth) union all select problem, depth, model, idx, case when depth = 2 then 'cluster-title-' || replace(key, ':', '-') else 'step-' || model || '-' || idx end from each_
            union all select problem, depth, model, 1099511627776, 'answer-' || key from given, (select unnest([1, 2, 3]) depth)),
        e as (select problem, depth, model, lag(node) over w from_node, node to_node, row_number() over w - 2 as "at" from way window w as (partition by problem, depth, model order by at_, node)) select * from e where "at" >= 0""",
}
