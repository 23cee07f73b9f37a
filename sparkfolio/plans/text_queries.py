"""Queries over text rules and step alignment, with the SQL that gives the same rows."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from ..functions import text as T
from ..operators import align
from ..sources.shared import Stored
from ..sources.tables import read, steps


def _list(words) -> str:
    return ", ".join(f"'{w}'" for w in words)


def sql_norm(x: str) -> str:
    return rf"trim(regexp_replace(regexp_replace(regexp_replace(lower({x}), '\\[a-zA-Z]+', ' ', 'g'), '[^\p{{L}}\p{{N}}\s]', ' ', 'g'), '\s+', ' ', 'g'))"


def sql_tokens(x: str, stop=T.STEP_STOPWORDS) -> str:
    return f"list_filter(string_split({sql_norm(x)}, ' '), lambda w: w <> '' and w not in ({_list(stop)}))"


def sql_compact(x: str) -> str:
    return f"replace({sql_norm(x)}, ' ', '')"


#: Bigrams of a column s, which sql_compact() has made.
GRAMS = "case when s = '' then []::varchar[] when length(s) < 2 then [s] else list_transform(range(1, length(s)), lambda k: substr(s, k, 2)) end"


def sql_math(x: str) -> str:
    low = f"lower({x})"
    many = lambda text, rule: f"regexp_extract_all({text}, '{rule}')"
    named = lambda text, rule, name: f"list_transform({many(text, rule)}, lambda m: '{name}')"
    with_ = lambda text, rule, pre, m="m": f"list_transform({many(text, rule)}, lambda m: '{pre}:' || {m})"
    parts = [
        named(low, r"\\frac\{[^}]+\}\{[^}]+\}", "latex:frac"), named(low, r"\\sqrt\{[^}]+\}", "latex:sqrt"), with_(low, r"\\[a-zA-Z]+", "latex", "substr(m, 2)"),
        named(low, r"[a-z]\^\{?[-]?[a-z0-9]+\}?", "pattern:power"), named(low, r"[a-z]_\{?[a-z0-9]+\}?", "pattern:subscript"),
        named(x, r"\b\d+(?:\.\d+)?/\d+(?:\.\d+)?\b", "num:fraction"), with_(x, r"\b\d+(?:\.\d+)?\b", "num"), named(low, r"sqrt\s*\([^)]*\)", "expr:sqrt"), named(x, r"\|[^|]+\|", "expr:abs"),
        *(with_(x, "[" + "".join("\\" + c if c in "+-*/^%()[]{}" else c for c in chars) + "]", kind) for kind, chars in T.SYMBOL_KINDS.items()),
        with_(x, r"\b[a-zA-Z](?:_[a-zA-Z0-9]+|\^\{?[a-zA-Z0-9-]+\}?)*\b", "var", "lower(m)"), with_(x, "[α-ωΑ-Ω]", "greek", "lower(m)"),
        *(named(low, rf"\b{w}\b" if w.isascii() else w, f"kw:{w}") for w in T.MATH_WORDS),
    ]
    return "flatten([" + ", ".join(parts) + "])"


STEPS = "steps as (select conv_id // 5 problem, conv_id % 5 solver, turn idx, split_part(text, '.', 1) title, text body from conversations)"
MICRO = "floor({} * 1000000 + 0.5)::bigint"
TITLE = "case when title <> '' then title else body end"
SIGN = f"(case when title <> '' then title else array_to_string(string_split(body, ' ')[1:10], ' ') end)"
TOKEN_SQL = {"title": sql_tokens(TITLE), "body": sql_tokens("body"), "math": sql_math(f"({SIGN} || chr(10) || {SIGN} || chr(10) || body)"), "chars": GRAMS}


def sql_weights(kind: str) -> str:
    """CTEs up to w_<kind> (problem, solver, idx, token, weight)."""
    k = kind
    source = f"(select *, {sql_compact(TITLE)} s from steps)" if kind == "chars" else "steps"
    base = f"""t_{k} as (select problem, solver, idx, {TOKEN_SQL[k]} toks from {source}),
        f_{k} as (select problem, solver, idx, token, count(*) tf, any_value(total) total from (select problem, solver, idx, len(toks) total, unnest(toks) token from t_{k}) group by all)"""
    if kind == "chars":
        raw = f"r_{k} as (select *, tf::double raw from f_{k})"
    else:
        raw = f"""n_{k} as (select problem, count(*) n from steps group by 1), d_{k} as (select problem, token, count(*) df from f_{k} group by all),
        r_{k} as (select f.*, f.tf / f.total * (ln((n + 1) / (df + 1)) + 1) raw from f_{k} f join d_{k} using (problem, token) join n_{k} using (problem))"""
    return f"{base}, {raw}, w_{k} as (select problem, solver, idx, token, raw / sqrt(sum(raw * raw) over (partition by problem, solver, idx)) weight from r_{k})"


PAIRS = "pairs as (select a.problem, a.solver s1, a.idx i, b.solver s2, b.idx j from steps a join steps b on a.problem = b.problem and a.solver < b.solver)"


def sql_dots(kind: str) -> str:
    return f"dot_{kind} as (select a.problem, a.solver s1, a.idx i, b.solver s2, b.idx j, greatest(0.0, least(1.0, sum(a.weight * b.weight))) dot from w_{kind} a join w_{kind} b on a.problem = b.problem and a.token = b.token and a.solver < b.solver group by all)"


def sql_scores(embedded: bool = False) -> str:
    kinds = list(align.WEIGHTS)
    total = repr(sum(align.WEIGHTS.values()))
    raw = " + ".join(f"({MICRO.format(f'coalesce(dot_{k}.dot, 0)')} / 1000000.0::double) * {w}::double" for k, w in align.WEIGHTS.items())
    joins = " ".join(f"left join dot_{k} on p.problem = dot_{k}.problem and p.s1 = dot_{k}.s1 and p.i = dot_{k}.i and p.s2 = dot_{k}.s2 and p.j = dot_{k}.j" for k in kinds)
    unit = lambda x: f"greatest(0.0::double, least(1.0::double, {x}))"
    more, by = "", f"{total}::double"
    if embedded:
        more = f"""emb as (select problem, solver, idx, embedding::double[] e from steps join embeddings on vec_id = (problem * 5 + solver) * 3 + idx),
            dot_emb as (select a.problem, a.solver s1, a.idx i, b.solver s2, b.idx j, greatest(0.0, least(1.0, list_cosine_similarity(a.e, b.e))) dot from emb a join emb b on a.problem = b.problem and a.solver < b.solver),"""
        joins += " left join dot_emb on p.problem = dot_emb.problem and p.s1 = dot_emb.s1 and p.i = dot_emb.i and p.s2 = dot_emb.s2 and p.j = dot_emb.j"
        raw += f" + ({MICRO.format('coalesce(dot_emb.dot, 0)')} / 1000000.0::double) * {align.EMBEDDING_WEIGHT}::double"
        by = f"({total}::double + case when dot_emb.dot is null then 0.0 else {align.EMBEDDING_WEIGHT} end::double)"
    score = unit(f"{unit(f'(0.0::double + {raw}) / {by}')} - 0.05::double * (abs(p.i - p.j) / greatest(l1.n, l2.n, 1))")
    return f"""with {STEPS}, {", ".join(sql_weights(k) for k in kinds)}, {PAIRS}, {", ".join(sql_dots(k) for k in kinds)}, {more}
        lens as (select problem, solver, count(*) n from steps group by all),
        scores as (select p.problem, p.s1, p.i, p.s2, p.j, {MICRO.format(score)} score from pairs p {joins}
            join lens l1 on l1.problem = p.problem and l1.solver = p.s1 join lens l2 on l2.problem = p.problem and l2.solver = p.s2)"""


def sql_edges(top: int, threshold: float = align.THRESHOLD) -> str:
    return f"""{sql_scores()}, ranked as (select *, row_number() over (partition by problem, s1, s2, i order by score desc, j) r, row_number() over (partition by problem, s1, s2, j order by score desc, i) c from scores),
        edges as (select problem, s1, i, s2, j, score from ranked where score >= {int(threshold * 1_000_000)} and r <= {top} and c <= {top})"""


#: Two connected solvers are rare at the default threshold; the component queries lower it.
LOW = 0.2


def sql_components() -> str:
    return f"""{sql_edges(1, LOW).replace("with ", "with recursive ", 1)}, ends as (select problem, {{solver: s1, idx: i}} a, {{solver: s2, idx: j}} b from edges), both_ as (select * from ends union select problem, b, a from ends),
        reach(problem, a, b) as (select problem, a, a from both_ union select r.problem, r.a, e.b from reach r join both_ e on r.problem = e.problem and r.b = e.a),
        comp as (select problem, a node, min(b) component from reach group by all)"""


def sql_members() -> str:
    return f"""{sql_components()}, best as (select problem, node, max(score) best from (select problem, {{solver: s1, idx: i}} node, score from edges union all select problem, {{solver: s2, idx: j}}, score from edges) group by all),
        one as (select c.problem, component, c.node.solver solver, c.node.idx idx, best, row_number() over (partition by c.problem, component, c.node.solver order by best desc, c.node.idx) rk from best b join comp c on b.problem = c.problem and b.node = c.node),
        kept as (select problem, component, solver, idx, best, count(*) over (partition by problem, component) solvers from one where rk = 1), members as (select * from kept where solvers >= 2)"""


def text_normalize_tokens(spark: SparkSession, d: str) -> DataFrame:
    t = T.tokens(F.col("text"))
    return read(spark, d, "documents").select("doc_id", F.size(t).cast("long").alias("n_tokens"), F.md5(F.array_join(t, " ").cast("binary")).alias("tokens_md5"))


def char_bigrams(spark: SparkSession, d: str) -> DataFrame:
    g = T.char_ngrams(F.col("text"))
    rows = read(spark, d, "documents").select("doc_id", F.explode(g).alias("gram"))
    return rows.groupBy("doc_id").agg(F.count(F.lit(1)).alias("n_grams"), F.countDistinct("gram").alias("n_distinct"), F.max("gram").alias("last_gram"))


def math_tokens(spark: SparkSession, d: str) -> DataFrame:
    docs = read(spark, d, "documents").select(F.lit("doc").alias("kind"), F.col("doc_id").alias("id"), "text")
    items = read(spark, d, "benchmark").select(F.lit("item").alias("kind"), F.col("item_id").alias("id"), "text")
    rows = docs.unionByName(items).select("kind", "id", F.explode(T.math_tokens(F.col("text"))).alias("token"))
    return rows.groupBy("kind", "token").agg(F.count(F.lit(1)).alias("uses"), F.countDistinct("id").alias("texts"))


def tfidf_weights(spark: SparkSession, d: str) -> DataFrame:
    return align.weights(steps(spark, d), "body").select("problem", "solver", "idx", "token", align.micro(F.col("weight")).alias("weight_micro"))


def step_pair_cosine(spark: SparkSession, d: str) -> DataFrame:
    return align.cosines(steps(spark, d)).withColumn("cosine_micro", align.micro(F.col("cosine"))).drop("cosine")


def step_pair_score(spark: SparkSession, d: str) -> DataFrame:
    return align.scores(steps(spark, d))


def mutual_best_edges(spark: SparkSession, d: str) -> DataFrame:
    return align.edges(align.scores(steps(spark, d)))


def mutual_topk_edges(spark: SparkSession, d: str) -> DataFrame:
    return align.edges(align.scores(steps(spark, d)), top=align.TOP)


def _low(spark: SparkSession, d: str) -> DataFrame:
    """Edges at the lower threshold, as a table: components read them twice."""
    return Stored(align.edges(align.scores(steps(spark, d)), LOW), "edges").df


def _flat(df: DataFrame, *names: str) -> DataFrame:
    """Steps within a problem as two columns each."""
    own = [c for n in names for c in (F.col(f"{n}.solver").alias(f"{n}_solver"), F.col(f"{n}.idx").alias(f"{n}_idx"))]
    return df.select(*(c for c in df.columns if c not in names), *own)


def alignment_components(spark: SparkSession, d: str) -> DataFrame:
    return _flat(align.components(_low(spark, d)), "node", "component")


def alignment_best_member(spark: SparkSession, d: str) -> DataFrame:
    return _flat(align.members(_low(spark, d)), "component")


def alignment_labels(spark: SparkSession, d: str) -> DataFrame:
    return _flat(align.labels(_low(spark, d), steps(spark, d)), "component")


def step_pair_score_embedded(spark: SparkSession, d: str) -> DataFrame:
    """Scores to which the vectors of some steps add a cosine."""
    own = steps(spark, d)
    at = (F.col("problem") * 5 + F.col("solver")) * 3 + F.col("idx")
    embedded = own.select("problem", "solver", "idx", at.alias("vec_id")).join(read(spark, d, "embeddings").select("vec_id", "embedding"), "vec_id").drop("vec_id")
    return align.scores(own, embedded)


def dense_cosine_pairs(spark: SparkSession, d: str) -> DataFrame:
    """Pairs of vectors of one label at most 10 ids apart: cosines between 0 and 1."""
    found = align.near_cosines(read(spark, d, "embeddings"), "label", 10)
    return found.select("v1", "v2", F.floor(F.col("cosine") * 10_000 + 0.5).cast("long").alias("cosine_e4"))


QUERIES = {f.__name__: f for f in (text_normalize_tokens, char_bigrams, math_tokens, tfidf_weights, step_pair_cosine, step_pair_score, step_pair_score_embedded, mutual_best_edges, mutual_topk_edges, alignment_components, alignment_best_member, alignment_labels, dense_cosine_pairs)}

ORACLES = {
    "text_normalize_tokens": f"with t as (select doc_id, {sql_tokens('text')} t from documents) select doc_id, len(t) n_tokens, md5(array_to_string(t, ' ')) tokens_md5 from t",
    "char_bigrams": f"select doc_id, count(*) n_grams, count(distinct gram) n_distinct, max(gram) last_gram from (select doc_id, unnest({GRAMS}) gram from (select doc_id, {sql_compact('text')} s from documents)) group by 1",
    "math_tokens": f"""with r as (select 'doc' kind, doc_id id, text from documents union all select 'item', item_id, text from benchmark)
        select kind, token, count(*) uses, count(distinct id) texts from (select kind, id, unnest({sql_math("text")}) token from r) group by all""",
    "tfidf_weights": f"with {STEPS}, {sql_weights('body')} select problem, solver, idx, token, {MICRO.format('weight')} weight_micro from w_body",
    "step_pair_cosine": f"with {STEPS}, {sql_weights('body')}, {PAIRS}, {sql_dots('body')} select problem, s1, i, s2, j, {MICRO.format('coalesce(dot, 0)')} cosine_micro from pairs left join dot_body using (problem, s1, i, s2, j)",
    "step_pair_score": f"{sql_scores()} select * from scores",
    "step_pair_score_embedded": f"{sql_scores(True)} select * from scores",
    "mutual_best_edges": f"{sql_edges(1)} select * from edges",
    "mutual_topk_edges": f"{sql_edges(align.TOP)} select * from edges",
    "alignment_components": f"{sql_components()} select problem, node.solver node_solver, node.idx node_idx, component.solver component_solver, component.idx component_idx from comp",
    "alignment_best_member": f"{sql_members()} select problem, component.solver component_solver, component.idx component_idx, solver, idx, best, solvers from members",
    "alignment_labels": f"""{sql_members()}, words as (select m.problem, component, m.solver, m.idx, case when len({sql_tokens("title")}) > 0 then {sql_tokens("title")} else ({sql_tokens("body")})[1:6] end w
            from members m join steps s on m.problem = s.problem and m.solver = s.solver and m.idx = s.idx),
        seen as (select problem, component, unnest(w) token, {{solver: solver, idx: idx, pos: generate_subscripts(w, 1)}} pos from words),
        freq as (select problem, component, token, count(*) n, min(pos) p from seen group by all),
        top as (select *, row_number() over (partition by problem, component order by n desc, p) rk from freq),
        named as (select m.problem, m.component, max(solvers) solvers, coalesce((select string_agg(token, ' ' order by rk) from top t where t.problem = m.problem and t.component = m.component and rk <= 2), 'Step-Layer') label from members m group by m.problem, m.component)
        select problem, component.solver component_solver, component.idx component_idx, row_number() over (partition by problem order by solvers desc, lower(strip_accents(label)), label, component) group_no, label, solvers from named""",
    "dense_cosine_pairs": """select a.vec_id v1, b.vec_id v2, floor(greatest(0.0, least(1.0, list_cosine_similarity(a.embedding::double[], b.embedding::double[]))) * 10000 + 0.5)::bigint cosine_e4
        from embeddings a join embeddings b on a.label = b.label and a.vec_id < b.vec_id and b.vec_id - a.vec_id <= 10""",
}
