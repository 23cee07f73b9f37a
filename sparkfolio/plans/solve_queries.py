"""Queries over replies, raw logs and streams, with the SQL that gives the same rows."""

from __future__ import annotations

import uuid

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from ..functions import text as T
from ..operators import replies as R
from ..operators import solve as S
from ..sources.shared import shared_dir
from ..sources.tables import read, steps, stream
from ..streaming import fold, solver_state
from .text_queries import STEPS

md5 = lambda c: F.md5(c.cast("binary"))


def chunk_reassemble(spark: SparkSession, d: str) -> DataFrame:
    rows = read(spark, d, "documents").select("doc_id", F.posexplode(T.chunked(F.col("text"), 120)).alias("pos", "piece"))
    back = F.array_join(F.transform(F.array_sort(F.collect_list(F.struct("pos", "piece"))), lambda x: x["piece"]), "")
    return rows.groupBy("doc_id").agg(F.count(F.lit(1)).alias("pieces"), md5(back).alias("text_md5"))


def solutions_prompt(spark: SparkSession, d: str) -> DataFrame:
    return S.solutions_prompt(steps(spark, d)).select("problem", F.length("prompt").cast("long").alias("chars"), md5(F.col("prompt")).alias("prompt_md5"))


MODELS = [("m0", "m9", 1.0, 8192, True), ("m1", None, None, 8192, True), ("m2", None, 1.0, None, False), ("m3", None, 1.0, 32768, True)]


def request_routing(spark: SparkSession, d: str) -> DataFrame:
    models = spark.createDataFrame(MODELS, "model_id string, alias string, temperature double, max_tokens long, has_key boolean")
    e = read(spark, d, "events")
    modality = F.element_at(F.array(*map(F.lit, ("text", "image", "both"))), (F.col("event_id") % 3 + 1).cast("int"))
    text, image = F.when(F.col("event_id") % 5 > 0, F.col("event_type")), F.when(F.col("event_id") % 7 > 3, F.col("props"))
    rows = e.select("event_id", F.concat(F.lit("m"), (F.col("user_id") % 5).cast("string")).alias("model_id"), S.request_status(modality, text, image).alias("status"))
    return S.routed(rows, models)


def text_clean(spark: SparkSession, d: str) -> DataFrame:
    rows = read(spark, d, "documents").select("doc_id", md5(S.clean_ocr(F.col("text"))).alias("clean_md5"), md5(T.slug(F.col("text"))).alias("slug_md5"), md5(T.one_line(F.col("text"))).alias("line_md5"), T.truncated(F.col("text")).alias("short"), md5(T.html_escape(F.col("text"))).alias("escaped_md5"))
    return rows


def fifth_option(spark: SparkSession, d: str) -> DataFrame:
    n = F.col("doc_id")
    s = lambda c: c.cast("string")
    raw = F.when(n % 4 == 0, F.concat(F.lit("⑤ "), s(n))).when(n % 4 == 1, F.concat(F.lit("x 5 "), s(n))).when(n % 4 == 2, F.concat(s(n), F.lit(" 5"))).otherwise("none")
    conv = F.when(n % 3 == 0, "text ⑤").when(n % 3 == 1, "text ⑤ $7$").otherwise("text")
    return read(spark, d, "documents").select("doc_id", S.fix_fifth_option(conv, raw).alias("fixed"))


# Answers as solvers write them, and what each means beside a problem with options and beside one without.
ANSWER_CASES = [("B", "B", "B"), ("(c)", "(c)", "(c)"), ("option d", "D", "D"), ("2", "B", "2"), ("answer 3", "C", "C"), ("\\boxed{\\frac{1}{2}}", "B", "\\frac{1}{2}"), ("'12'", "A", "12"), ("x + 1.", "C", "x + 1."), ("99", "99", "99"), ("", "", ""), ("5", "5", "5"), ("a)", "A", "A")]
OPTIONS = "Which of the following is it?\nA) 12\nB) \\(\\frac{1}{2}\\)\nC) x+1\nD) 7"


def answer_normalize(spark: SparkSession, d: str) -> DataFrame:
    n = (F.col("doc_id") % len(ANSWER_CASES) + 1).cast("int")
    answer = F.element_at(F.array(*[F.lit(a) for a, _, _ in ANSWER_CASES]), n)
    with_options, sat = F.col("doc_id") % 2 == 0, F.col("doc_id") % 5 > 0
    return read(spark, d, "documents").select("doc_id", answer.alias("answer"), T.final_answer(answer, sat, F.when(with_options, OPTIONS).otherwise("No list here.")).alias("final"))


def json_repair(spark: SparkSession, d: str) -> DataFrame:
    """Replies as solvers send them, whole and damaged in four ways."""
    n, q = F.col("event_id"), F.col("event_id").cast("string")
    whole = F.concat(F.lit('{"steps": [{"step_idx": 1, "title": "t'), q, F.lit('", "content": "a \\\\frac b"}], "final_answer": "'), q, F.lit('", "confidence": "high"}'))
    hurt = F.when(n % 5 == 1, F.concat(F.lit("```json\n"), whole, F.lit("\n```"))).when(n % 5 == 2, F.regexp_replace(whole, r"\}\]", "},]")).when(n % 5 == 3, F.concat(F.lit("Here: "), whole, F.lit(" done"))).when(n % 5 == 4, F.expr("substring(w, 1, length(w) - 24)")).otherwise(whole)
    rows = R.parsed(read(spark, d, "events").withColumn("w", whole).select("event_id", hurt.alias("reply")), "reply", "r")
    return rows.select("event_id", F.size("r.steps").cast("long").alias("n_steps"), F.col("r.final_answer").alias("final_answer"), F.col("r.confidence").alias("confidence"))


def json_valid(spark: SparkSession, d: str) -> DataFrame:
    """Solutions that are JSON as a whole, or not; answers are those of problems with options."""
    text = F.to_json(F.struct(F.array(F.struct(F.col("event_type").alias("title"), F.col("props").alias("content")), F.struct(F.lit(None).cast("string").alias("title"), F.lit("x").alias("content"))).alias("steps"), F.when(F.col("event_id") % 7 > 0, F.col("event_id").cast("string")).alias("final_answer")))
    rows = read(spark, d, "events").select("event_id", R.solution(F.when(F.col("event_id") % 9 == 0, F.concat(F.lit("no "), text)).otherwise(text), F.col("event_id") % 2 == 0, F.lit(OPTIONS)).alias("s"))
    return rows.select("event_id", F.size("s.steps").cast("long").alias("n_steps"), F.array_join(F.transform("s.steps", lambda x: x["title"]), "|").alias("titles"), F.col("s.final_answer").alias("final_answer"))


def message_items(spark: SparkSession, d: str) -> DataFrame:
    """Messages whose items are texts, embedded images, numbers and what no rule knows, for either kind of call."""
    turn = F.col("turn").cast("string")
    items = F.concat(F.lit('[{"type": "image", "source": {"type": "base64", "data": "'), turn, F.lit('"}}, '), turn, F.lit(', {"type": "odd", "deep": ['), turn, F.lit(', {"a": null}]}, {"type": "text", "text": "'), turn, F.lit('"}]'))
    message = F.concat(F.lit('[{"role": "'), F.col("role"), F.lit('", "content": '), items, F.lit('}, {"content": '), turn, F.lit("}]"))
    v = F.try_parse_json(message)
    rows = read(spark, d, "conversations").select("conv_id", "turn", "role", R.chat_messages(v).alias("c"), R.response_messages(F.lit("solve"), v).alias("r"))
    said = F.array_join(F.flatten(F.transform("r", lambda m: F.transform(m["content"], lambda x: F.concat_ws("=", m["role"], x["type"], F.coalesce(x["text"], x["image_url"]))))), "|")
    return rows.select("conv_id", "turn", "role", F.to_json(F.col("c")[0]["content"]).alias("chat"), F.concat_ws(" ", F.col("c")[1]["role"], F.to_json(F.col("c")[1]["content"])).alias("chat_next"), said.alias("responses"))


def _raw(spark: SparkSession, d: str) -> DataFrame:
    """One page of tagged blocks for each order, from its lines."""
    li = read(spark, d, "lineitem").select("l_orderkey", "l_linenumber", "l_partkey", "l_suppkey", "l_returnflag")
    s = lambda c: c.cast("string")
    x, y = F.col("l_partkey") * 31 % 900, F.col("l_partkey") * 17 % 950
    kind = F.when(F.col("l_suppkey") % 5 == 0, "image").otherwise("text")
    block = F.concat(F.lit("<|ref|>"), kind, F.lit("<|/ref|><|det|>[["), s(x), F.lit(", "), s(y), F.lit(", "), s(x + 40), F.lit(", "), s(y + 30), F.lit("]]<|/det|>\nword "), s(F.col("l_partkey")), F.lit(" "), F.col("l_returnflag"))
    return li.select("l_orderkey", F.struct((F.col("l_linenumber").cast("long") * 1_000_000_000 + F.col("l_partkey") * 1000 + F.col("l_suppkey") % 1000).alias("o"), block.alias("b")).alias("x")).groupBy(F.col("l_orderkey").alias("page")).agg(F.array_join(F.transform(F.array_sort(F.collect_list("x")), lambda v: v["b"]), "\n").alias("raw"))


def tag_parse(spark: SparkSession, d: str) -> DataFrame:
    """Every page ends in a tag of two boxes whose text holds a lone number between lines, and full-width digits."""
    last = "\n<|ref|>text<|/ref|><|det|>[[1, 2, 3, 4], [5, 6, 7, 8]]<|/det|>\nabove\n７\nbelow <|ref |>"
    two = "\n<|ref|>equation<|/ref|><|det|>[[11, 12, 13, 14], [15, 16, 17, 18]]<|/det|>\nx = 1"
    raw = _raw(spark, d).withColumn("raw", F.concat("raw", F.lit(two), F.lit(last)))
    return S.blocks(raw).select("page", F.col("ord").cast("long").alias("ord"), F.col("piece").cast("long").alias("piece"), "kind", "x1", "y1", "x2", "y2", "txt")


def raw_by_quadrant(spark: SparkSession, d: str) -> DataFrame:
    saved = F.when(F.col("page") % 3 == 0, f"\n{S.SAVED}\n<|ref|>text<|/ref|><|det|>[[1, 1, 2, 2]]<|/det|>\nsaved").otherwise("")
    return S.by_quadrant(_raw(spark, d).withColumn("raw", F.concat("raw", saved)))


def tags_stripped(spark: SparkSession, d: str) -> DataFrame:
    return _raw(spark, d).select("page", md5(T.strip_tags(F.col("raw"))).alias("stripped_md5"))


def fnv_jitter(spark: SparkSession, d: str) -> DataFrame:
    c = read(spark, d, "customer")
    return c.select("c_custkey", T.fnv1a(F.col("c_name")).alias("hash"), F.floor(T.jitter(F.col("c_name"), 8.0) * 1000 + 0.5).cast("long").alias("jitter_milli"))


def _chunks(e: DataFrame) -> DataFrame:
    event = F.when(F.col("event_type") == "view", "start").when(F.col("event_type") == "purchase", "done").when(F.col("event_type") == "error", "error").when((F.col("event_type") == "signup") & (F.col("event_id") % 4 == 0), "stop")
    return e.select(F.col("user_id").alias("problem"), (F.col("event_id") % 3).alias("model"), F.col("event_id").alias("seq"), F.when(F.col("event_type") == "click", "text").otherwise("event").alias("kind"), event.alias("event"), F.concat(F.lit("t"), F.col("event_id").cast("string")).alias("text"), F.unix_millis(F.col("ts").cast("timestamp")).alias("at"))


def stream_state_fold(spark: SparkSession, d: str) -> DataFrame:
    return fold.fold_batch(_chunks(read(spark, d, "events")))


def stream_state_fold_live(spark: SparkSession, d: str) -> DataFrame:
    """The same fold as a Structured Streaming query over the events file."""
    return fold.run_available(_stream(spark, d), _folder(spark))


def _folder(spark: SparkSession) -> str:
    return spark.conf.get("spark.checkpoint.dir", None) or fold.own_folder(spark)


def _stream(spark: SparkSession, d: str) -> DataFrame:
    return _chunks(stream(spark, d, "events"))


def stream_barrier(spark: SparkSession, d: str) -> DataFrame:
    return fold.barrier(stream_state_fold(spark, d))


def stream_chain(spark: SparkSession, d: str) -> DataFrame:
    """Results, flow map and summary of each problem that becomes ready; some maps fail, and their summaries are not made."""
    none = F.lit(None).cast("string")
    fails = F.when(F.col("problem") % 7 == 0, F.concat(F.lit("no map for "), F.col("problem").cast("string")))
    stages = [("results", lambda df: df.withColumn("message", none)), ("map", lambda df: df.withColumn("message", fails)), ("summary", lambda df: df.withColumn("message", none))]
    return fold.run_chain(_stream(spark, d), _folder(spark), stages)


def stream_stops(spark: SparkSession, d: str) -> DataFrame:
    """The fold under stops of one model, of a whole problem and of everything."""
    chunks = _chunks(read(spark, d, "events"))
    keys = chunks.select("problem", "model").distinct()
    wide = (F.col("event") == "stop") & (F.col("problem") % 3 == 0)
    late = spark.range(1).select(F.lit(None).cast("long").alias("problem"), F.lit(None).cast("long").alias("model"), F.lit(1 << 40).alias("seq"), F.lit("event").alias("kind"), F.lit("stop").alias("event"), F.lit("").alias("text"), F.lit(5).cast("long").alias("at"))
    asked = chunks.withColumn("model", F.when(~F.coalesce(wide, F.lit(False)), F.col("model"))).unionByName(late.select(*chunks.columns))
    return fold.fold_batch(fold.spread_stops(asked, keys)).groupBy("problem").agg(F.count(F.lit(1)).alias("models"), F.sum(F.length("text")).alias("chars"), F.max("finished").alias("finished"))


#: A model of which nothing comes for so long is an error; what is later than the watermark's delay is dropped, which exceeds a slice.
IDLE_DAYS, DELAY_DAYS, SLICES = 5, 8, 4


def _solver_chunks(e: DataFrame) -> DataFrame:
    """Chunks among which are stops of a model, of a problem (model null) and of everything (problem null)."""
    everything = (F.col("seq") % 2503 == 700) & (F.col("kind") == "event")
    wide = (F.col("event") == "stop") & (F.col("problem") % 3 == 0)
    stop_all = F.when(everything, "stop").otherwise(F.col("event"))
    rows = _chunks(e).withColumn("time", F.timestamp_millis("at"))
    none = F.lit(None).cast("long")
    return rows.select(F.when(everything, none).otherwise(F.col("problem")).alias("problem"), F.when(everything | F.coalesce(wide, F.lit(False)), none).otherwise(F.col("model")).alias("model"), "seq", "kind", stop_all.alias("event"), "text", "at", "time")


def stream_solver_states(spark: SparkSession, d: str) -> DataFrame:
    """The state machine over a stream in slices of time, with stops, expired models and texts of those that have ended."""
    chunks, folder = _solver_chunks(read(spark, d, "events")), f"{shared_dir(spark)}/chunks-{uuid.uuid4().hex}"
    low, high = chunks.agg(F.min("at"), F.max("at")).head()
    out = f"{folder}/out"
    wide = ((high or 0) - (low or 0)) // SLICES + 1
    for k in range(SLICES):  # a slice comes as a whole, however many files it has, and the stream goes on before the next one comes
        chunks.where(F.col("at").between((low or 0) + k * wide, (low or 0) + (k + 1) * wide - 1)).write.parquet(f"{folder}/in/slice={k}")
        sliced = spark.readStream.schema(chunks.schema).option("recursiveFileLookup", "true").parquet(f"{folder}/in")
        solver_state.go_on(sliced, out, IDLE_DAYS * 86_400_000, f"{DELAY_DAYS} days", solver_state.KNOWN)
    return solver_state.latest(spark, f"{out}/data")


QUERIES = {f.__name__: f for f in (chunk_reassemble, solutions_prompt, request_routing, text_clean, fifth_option, answer_normalize, json_repair, json_valid, message_items, tag_parse, raw_by_quadrant, tags_stripped, fnv_jitter, stream_state_fold, stream_state_fold_live, stream_barrier, stream_chain, stream_stops, stream_solver_states)}

q = lambda s: "'" + s.replace("'", "''") + "'"
ROWS = """r as (select l_orderkey page, l_linenumber::bigint * 1000000000 + l_partkey * 1000 + l_suppkey % 1000 o, case when l_suppkey % 5 = 0 then 'image' else 'text' end kind,
    (l_partkey * 31 % 900)::int x1, (l_partkey * 17 % 950)::int y1, case when l_suppkey % 5 = 0 then '' else 'word ' || l_partkey || ' ' || l_returnflag end txt, 'word ' || l_partkey || ' ' || l_returnflag body from lineitem)"""
FOLD = """c as (select user_id problem, event_id % 3 model, event_id seq, case when event_type = 'click' then 'text' else 'event' end kind, case when event_type = 'view' then 'start' when event_type = 'purchase' then 'done' when event_type = 'error' then 'error' when event_type = 'signup' and event_id % 4 = 0 then 'stop' end event, 't' || event_id as text, epoch_us(ts) // 1000 at_ms from events),
    l as (select * from (select *, min(seq) filter (event = 'stop') over (partition by problem, model) stop_at from c) where stop_at is null or seq <= stop_at),
    g as (select problem, model, arg_max(event, seq) filter (event is not null) last, coalesce(string_agg(text, '' order by seq) filter (kind = 'text'), '') as text, arg_max(at_ms, seq) filter (event = 'start') started, arg_max(at_ms, seq) filter (event is not null) ended from l group by all),
    f as (select problem, model, case last when 'start' then 'streaming' when 'stop' then 'stopped' else coalesce(last, 'idle') end status, text, started, case when last in ('done', 'error', 'stop') then ended end finished from g)"""

ORACLES = {
    "chunk_reassemble": "select doc_id, ceil(length(text) / 120)::bigint pieces, md5(text) text_md5 from documents where length(text) > 0",
    "solutions_prompt": f"with {STEPS}, s as (select problem, solver, 'Model ' || solver || chr(10) || string_agg('Step ' || idx || ': ' || title || chr(10) || body, chr(10) || chr(10) order by idx) part from steps group by problem, solver), p as (select problem, string_agg(part, chr(10) || chr(10) order by solver) prompt from s group by 1) select problem, length(prompt) chars, md5(prompt) prompt_md5 from p",
    "request_routing": """with m(model_id, alias, temperature, max_tokens, has_key) as (values ('m0', 'm9', 1.0::double, 8192::bigint, true), ('m1', null, null, 8192, true), ('m2', null, 1.0, null, false), ('m3', null, 1.0, 32768, true)),
        e as (select event_id, 'm' || (user_id % 5) model_id, event_id % 3 k, event_id % 5 = 0 no_text, event_id % 7 <= 3 or props is null or props = '' no_image from events)
        select event_id, model_id, case when k = 0 and no_text then 'text missing' when k = 1 and no_image then 'image missing' when no_text and no_image then 'input missing' else 'ok' end status, temperature, max_tokens, coalesce(alias, model_id) provider_id, coalesce(has_key, false) runnable from e left join m using (model_id)""",
    "text_clean": r"""with s as (select *, trim(regexp_replace(text, '[^A-Za-z0-9._-]+', '_', 'g'), '._-') slug from documents) select doc_id, md5(trim(regexp_replace(text, '^\s+|\s+$', '', 'g'))) clean_md5, md5(case when slug = '' then 'unknown' else slug end) slug_md5,
        md5(trim(regexp_replace(text, '\r\n|\r|\n', ' ', 'g'))) line_md5, case when length(text) > 72 then trim(substr(text, 1, 72)) || '...' else text end short,
        md5(replace(replace(replace(replace(replace(text, '&', '&amp;'), '<', '&lt;'), '>', '&gt;'), '"', '&quot;'), '''', '&#39;')) escaped_md5 from s""",
    # One digit before a closing 5 is no value of a fifth option ("2 5", "6 5").
    "fifth_option": "select doc_id, case doc_id % 3 when 0 then case when doc_id % 4 = 3 or doc_id in (2, 6) then 'text ⑤' else 'text ⑤ $' || doc_id || '$' end when 1 then case when doc_id % 4 = 3 or doc_id in (2, 6) then 'text ⑤ $7$' else 'text ⑤ $' || doc_id || '$' end else 'text' end fixed from documents",
    "answer_normalize": f"""with k as (select doc_id, doc_id % {len(ANSWER_CASES)} n from documents), c(n, answer, opt, bare, plain) as (values {", ".join(f"({i}, {q(a)}, {q(o)}, {q(b)}, {q(p)})" for i, ((a, o, b), p) in enumerate(zip(ANSWER_CASES, ["B", "(c)", "option d", "2", "answer 3", "\\frac{1}{2}", "12", "x + 1.", "99", "", "5", "a)"])))})
        select doc_id, answer, case when doc_id % 5 = 0 then plain when doc_id % 2 = 0 then opt else bare end as final from k join c using (n)""",
    "json_repair": """select event_id, 1::bigint n_steps, case when event_id % 5 = 4 then '' else event_id::varchar end final_answer, case when event_id % 5 = 4 then 'low' else 'high' end confidence from events""",
    "json_valid": """select event_id, case when event_id % 9 = 0 then 0 else 2 end::bigint n_steps, case when event_id % 9 = 0 then '' else event_type || '|' end titles,
        case when event_id % 9 = 0 or event_id % 7 = 0 then '' when event_id % 2 = 1 then event_id::varchar when event_id in (2, 4) then chr(64 + event_id::int) when event_id = 12 then 'A' else event_id::varchar end final_answer from events""",
    "message_items": """select conv_id, turn, role, '[{"image_url":{"url":"data:image/png;base64,' || turn || '"},"type":"image_url"},' || turn || ',{"deep":[' || turn || ',{"a":null}],"type":"odd"},"' || turn || '"]' chat, 'user ' || turn chat_next,
        'system=input_text=solve|' || role || '=input_image=data:image/png;base64,' || turn || '|' || role || '=input_text=' || turn || '|' || role || '=input_text={"deep":[' || turn || ',{"a":null}],"type":"odd"}|' || role || '=input_text=' || turn || '|user=input_text=' || turn responses from conversations""",
    "tag_parse": f"""with {ROWS}, n as (select page, count(*) n from r group by page) select page, row_number() over (partition by page order by o) - 1 ord, 0::bigint piece, kind, x1, y1, x1 + 40 x2, y1 + 30 y2, txt from r
        union all select page, n, i, 'equation', 11 + 4 * i, 12 + 4 * i, 13 + 4 * i, 14 + 4 * i, 'x = 1' from n, (select unnest([0, 1]) i)
        union all select page, n + 1, i, 'text', case i when 0 then 1 else 5 end, case i when 0 then 2 else 6 end, case i when 0 then 3 else 7 end, case i when 0 then 4 else 8 end, (['above', '7', 'below <|ref |>'])[i + 1] from n, (select unnest([0, 1, 2]) i)""",
    "raw_by_quadrant": f"""with {ROWS}, k as (select page, case when x1 < 400 then case when y1 < 500 then 1 else 2 end else case when y1 < 400 then 3 else 4 end end quadrant, o, '<|ref|>' || kind || '<|/ref|><|det|>[[' || x1 || ', ' || y1 || ', ' || x1 + 40 || ', ' || y1 + 30 || ']]<|/det|>' || chr(10) || body txt from r), g as (select page, quadrant, string_agg(txt, chr(10) || chr(10) order by o) txt from k group by all),
        e as (select distinct page, unnest([1, 2, 3, 4]) quadrant from r) select e.page, e.quadrant, coalesce(txt, '') txt from e left join g on e.page = g.page and e.quadrant = g.quadrant""",
    "fnv_jitter": """with h as (select c_custkey, list_reduce(list_transform(string_split(c_name, ''), lambda c: ascii(c)::bigint), lambda h, c: (xor(h, c) * 16777619) % 4294967296, 2166136261::bigint) "hash" from customer)
        select c_custkey, "hash", floor((("hash" % 10000) / 10000.0::double - 0.5) * 8.0 * 1000 + 0.5)::bigint jitter_milli from h""",
    "tags_stripped": f"with {ROWS} select page, md5(trim(regexp_replace(string_agg(chr(10) || body, chr(10) order by o), '\\n{{3,}}', chr(10) || chr(10), 'g'), chr(10))) stripped_md5 from r group by page",
    "stream_state_fold": f"with {FOLD} select * from f",
    "stream_state_fold_live": f"with {FOLD} select * from f",
    "stream_solver_states": f"""with c as (select case when ev and event_id % 2503 = 700 then null else user_id end problem, case when ev and (event_id % 2503 = 700 or stop and user_id % 3 = 0) then null else event_id % 3 end model, event_id seq, epoch_us(ts) // 1000 at_ms, 't' || event_id as text,
            case when not ev then 'text' when event_id % 2503 = 700 or stop then 'stop' when event_type = 'view' then 'start' when event_type = 'purchase' then 'done' when event_type = 'error' then 'error' else 'other' end event from (select *, event_type <> 'click' ev, event_type = 'signup' and event_id % 4 = 0 stop from events)),
        k as (select problem, model, min({{at_ms: at_ms, seq: seq}}) filter (event = 'stop') ends_at from c where model is not null group by all),
        w as (select max(at_ms) - {DELAY_DAYS * 86_400_000} mark from c),
        x as (select k.problem, k.model, c.seq, c.at_ms, c.event from k join c on c.problem = k.problem and c.model = k.model
            union all select k.problem, k.model, c.seq, c.at_ms, 'halt' from k join c on c.model is null and coalesce(c.problem, k.problem) = k.problem and c.event = 'stop'
            union all select k.problem, k.model, 1099511627776, greatest(any_value(w.mark), max(c.at_ms)), 'end' from k join c on coalesce(c.problem, k.problem) = k.problem, w group by k.problem, k.model),
        l as (select problem, model, list({{event: event, at_ms: at_ms, status: 'idle', started: null::bigint, finished: null::bigint, last: null::bigint, dropped: false}} order by at_ms, seq) steps from x group by all),
        r as (select problem, model, list_reduce(steps, lambda a, b: case
            when a.dropped then a
            when a.status in ('idle', 'streaming') and b.at_ms - a.last >= {IDLE_DAYS * 86_400_000} then
                {{event: '', at_ms: b.at_ms, status: case b.event when 'start' then 'streaming' when 'stop' then 'stopped' when 'done' then 'done' else 'error' end, started: case when b.event = 'start' then b.at_ms else a.started end,
                    finished: case when b.event = 'start' then null when b.event in ('stop', 'done', 'error') then b.at_ms else a.last + {IDLE_DAYS * 86_400_000} end, last: case when b.event in ('halt', 'end') then a.last else b.at_ms end, dropped: b.event = 'stop'}}
            when b.event = 'end' or b.event = 'halt' and a.status <> 'streaming' then a
            else {{event: '', at_ms: b.at_ms, status: case b.event when 'start' then 'streaming' when 'stop' then 'stopped' when 'halt' then 'stopped' when 'done' then 'done' when 'error' then 'error' else a.status end, started: case when b.event = 'start' then b.at_ms else a.started end,
                    finished: case when b.event = 'start' then null when b.event in ('stop', 'halt', 'done', 'error') then b.at_ms else a.finished end, last: case when b.event = 'halt' then a.last else b.at_ms end, dropped: b.event = 'stop'}} end,
            {{event: '', at_ms: 0::bigint, status: 'idle', started: null::bigint, finished: null::bigint, last: null::bigint, dropped: false}}) s from l),
        t as (select problem, model, string_agg(text, '' order by at_ms, seq) as text from c join k using (problem, model) where event = 'text' and (ends_at is null or {{at_ms: at_ms, seq: seq}} < ends_at) group by all)
        select r.problem, r.model, s.status, s.started, s.finished, case when s.status in ('done', 'error', 'stopped') then coalesce(t.text, '') end as text from r left join t using (problem, model)""",
    "stream_chain": f"""with {FOLD}, r as (select problem from f group by problem having bool_and(status in ('done', 'error', 'stopped')))
        select problem, stage, case when stage = 'map' and problem % 7 = 0 then 'error' else 'done' end status, case when stage = 'map' and problem % 7 = 0 then 'no map for ' || problem end message
        from r, (select unnest(['results', 'map', 'summary']) stage) where stage <> 'summary' or problem % 7 > 0""",
    "stream_stops": """with c as (select user_id problem, event_id % 3 model, event_id seq, event_type = 'click' is_text, length('t' || event_id) chars, event_type = 'signup' and event_id % 4 = 0 stops, epoch_us(ts) // 1000 at_ms from events),
        s as (select *, coalesce(min(seq) filter (stops) over (partition by problem, model), 1099511627776) own, coalesce(min(seq) filter (stops) over (partition by problem), 1099511627776) every from c),
        l as (select *, case when problem % 3 = 0 then every else own end stop_at from s), g as (select problem, model, stop_at, coalesce(sum(chars) filter (is_text and seq <= stop_at), 0) chars from l group by all)
        select g.problem, count(*) models, sum(g.chars)::bigint chars, max(coalesce(x.at_ms, 5)) finished from g left join c x on x.problem = g.problem and x.seq = g.stop_at group by 1""",
    "stream_barrier": f"with {FOLD} select problem, count(*) models, count(*) filter (status = 'done') done from f group by problem having bool_and(status in ('done', 'error', 'stopped'))",
}
