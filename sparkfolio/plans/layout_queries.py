"""Queries over page layout, with the SQL that gives the same rows."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from ..functions import geometry as G
from ..operators import layout as L
from ..sources.tables import BOXES, HEIGHT, WIDTH, boxes, read

ROW = ["page", "ord"]


def dedup_grid_blocks(spark: SparkSession, d: str) -> DataFrame:
    return L.dedup_grid(boxes(spark, d).withColumn("y1", F.col("y1") % 4)).select("page", "ord", "kind", "x1", "y1")


def bbox_norm_to_px(spark: SparkSession, d: str) -> DataFrame:
    li = read(spark, d, "lineitem").select(F.col("l_orderkey").alias("page"), F.col("l_linenumber").alias("ord"), (F.col("l_partkey") % 1000).alias("nx"), (F.col("l_suppkey") * 7 % 1000).alias("ny"))
    px, py = G.norm_to_px(F.col("nx"), F.lit(WIDTH)), G.norm_to_px(F.col("ny"), F.lit(HEIGHT))
    return li.select("page", "ord", px.alias("px"), py.alias("py"), G.px_to_norm(px, F.lit(WIDTH)).alias("back"))


def bbox_expand_margin(spark: SparkSession, d: str) -> DataFrame:
    b = boxes(spark, d)
    wide = G.expand(*(F.col(c) for c in L.BOX), F.lit(WIDTH), F.lit(HEIGHT), 0.05)
    col = F.when(F.col("x1") + F.col("x2") < WIDTH, 0).otherwise(1)
    b = b.select("page", "ord", col.alias("col"), *(x.alias(c) for x, c in zip(wide, L.BOX)))
    a, z = G.enforce_column(F.col("x1"), F.col("x2"), F.col("col"), F.lit(0.5 * WIDTH), F.lit(WIDTH))
    return b.select("page", "ord", "col", a.alias("x1"), F.greatest("y1", F.lit(280)).alias("y1"), z.alias("x2"), "y2")


def clip_columns(spark: SparkSession, d: str) -> DataFrame:
    col = (F.col("ord") % 2).cast("int")
    a, z, fits = G.clip_to_column(F.col("x1"), F.col("x2"), col, F.lit(0.5 * WIDTH), F.lit(WIDTH))
    return boxes(spark, d).where(fits).select("page", "ord", a.alias("x1"), z.alias("x2"))


def column_split(spark: SparkSession, d: str) -> DataFrame:
    return L.columns(boxes(spark, d), WIDTH).select("page", "ord", F.col("col").cast("long").alias("col"))


def page_top_cut(spark: SparkSession, d: str) -> DataFrame:
    return L.top_cut(boxes(spark, d), HEIGHT)


def page_margins(spark: SparkSession, d: str) -> DataFrame:
    return L.without_margins(boxes(spark, d), HEIGHT).select("page", "ord", "kind")


def spatial_anti_overlap(spark: SparkSession, d: str) -> DataFrame:
    b = boxes(spark, d)
    return L.uncovered(b.where("ord % 2 = 1"), b.where("ord % 2 = 0")).select("page", "ord")


def interval_assign_anchor(spark: SparkSession, d: str) -> DataFrame:
    return L.assigned(L.columns(boxes(spark, d), WIDTH)).select("page", F.col("col").cast("long").alias("col"), "ord", "anchor_ord", F.col("qnum").cast("long").alias("qnum"))


def gap_split_topk(spark: SparkSession, d: str) -> DataFrame:
    return L.gap_segments(boxes(spark, d), 3, ["page"]).select("page", "ord", "segment")


def percentile_tail_filter(spark: SparkSession, d: str) -> DataFrame:
    return L.tail_filtered(boxes(spark, d), ["page"]).select("page", "ord")


def line_merge(spark: SparkSession, d: str) -> DataFrame:
    b = boxes(spark, d).withColumn("y1", F.col("y1") % 90)
    return L.merged_lines(b, ["page"]).select("page", "n_lines", F.md5(F.col("merged").cast("binary")).alias("merged_md5"))


def best_group_per_number(spark: SparkSession, d: str) -> DataFrame:
    b = boxes(spark, d)
    area = (F.col("x2") - F.col("x1")) * (F.col("y2") - F.col("y1"))
    groups = b.select("page", F.col("ord").alias("col"), (F.col("ord") % 3).alias("qnum"), F.col("txt").alias("merged"), area.alias("area"))
    return L.best_groups(groups).select("page", "qnum", "col", "area")


def greedy_suppression(spark: SparkSession, d: str) -> DataFrame:
    return L.suppressed(boxes(spark, d)).select("page", "ord", "number")


def page_questions(spark: SparkSession, d: str) -> DataFrame:
    return L.grouped(L.columns(boxes(spark, d).repartition("page"), WIDTH)).select("page", F.col("col").cast("long").alias("col"), "ord", "anchor_ord", F.col("qnum").cast("long").alias("qnum"))


def page_problems(spark: SparkSession, d: str) -> DataFrame:
    return L.problems(boxes(spark, d), WIDTH, HEIGHT)


QUERIES = {f.__name__: f for f in (dedup_grid_blocks, bbox_norm_to_px, bbox_expand_margin, clip_columns, column_split, page_top_cut, page_margins, spatial_anti_overlap, interval_assign_anchor, gap_split_topk, percentile_tail_filter, line_merge, best_group_per_number, greedy_suppression, page_questions, page_problems)}


SQL_RULES = [r"^\s*(\d{1,3})\s*[.．):]\s*", r"^[^\d]{0,3}(\d{1,3})\s*[.．):]\s*", r"^\s*(\d{1,3})\s*$", r"^\s*#*\s*(\d{1,3})\s*$"]


def sql_number(t: str, rules: list[str]) -> str:
    return "coalesce(" + ", ".join(f"nullif(regexp_extract({t}, '{r}', 1), '')" for r in rules) + ")::int"


def sql_anchor(t: str) -> str:
    return f"nullif({sql_number(t, SQL_RULES)}, 0)"


def sql_share(a: str, b: str) -> str:
    return f"(greatest(0, least({a}.x2, {b}.x2) - greatest({a}.x1, {b}.x1)) * greatest(0, least({a}.y2, {b}.y2) - greatest({a}.y1, {b}.y1))) / greatest(1, ({a}.x2 - {a}.x1) * ({a}.y2 - {a}.y1))"


MID = WIDTH // 2
COLS = f"""sides as (select *, case when (x1 + x2) * 0.5 < {MID} - {int(WIDTH * 0.003)} then 0 when (x1 + x2) * 0.5 > {MID} + {int(WIDTH * 0.003)} then 1 when (x1 + x2) * 0.5 >= {MID} * 0.99 then 1 else 0 end side from boxes),
    cols as (select * exclude (side), case when sum(side) over (partition by page) in (0, count(*) over (partition by page)) then case when (x1 + x2) * 0.5 < {MID} then 0 else 1 end else side end::bigint col from sides)"""
CUT = f"""cut as (select page, case when least(max(y2) filter (kind in ('title', 'sub_title', 'header')) + 8, min(y1) filter (kind = 'text' and {sql_anchor("txt")} is not null) - 18) is null then 0
    else least(max(y2) filter (kind in ('title', 'sub_title', 'header')) + 8, min(y1) filter (kind = 'text' and {sql_anchor("txt")} is not null) - 18, {int(HEIGHT * 0.15)}) end::int y_cut from boxes group by page)"""

# Blocks of columns (cols) to the questions they belong to, the last step of which is `questions`.
QUESTIONS = f"""own_numbers as (select *, case when kind in ('text', 'sub_title', 'equation') and not regexp_matches(txt, '{L.NOT_ANCHORS}') then {sql_anchor("txt")} end own0, row_number() over (partition by page, col order by y1, x1, ord) seq from cols),
    firsts as (select *, count(own0) over c n_own, min(case when kind in ('text', 'sub_title') and txt <> '' then seq end) over c text_seq from own_numbers window c as (partition by page, col)),
    said as (select *, max(case when seq = text_seq then coalesce({sql_number("txt", [SQL_RULES[0], *SQL_RULES[2:]])}, -1) end) over (partition by page, col) said from firsts),
    owned as (select *, case when n_own > 0 then own0 when said >= 0 and seq = text_seq then said when said < 0 and seq = 1 then 1 end own from said),
    heads as (select *, count(case when own is not null and kind = 'sub_title' then 1 end) over c heads, count(own) over c total from owned window c as (partition by page, col)),
    anchors as (select page, col, ord anchor_ord, own qnum, y1 top, seq anchor_seq, heads <= 1 or heads < total // 2 fills, lead(y1, 1, 1000000000) over c below, lead(own) over c next, row_number() over c nth
        from heads where own is not null window c as (partition by page, col order by seq)),
    mine as (select b.*, anchor_ord, qnum, case when fills and next - qnum > 1 then next - qnum else 1 end parts, own is null and nth = 1 and y1 < top - 8 and qnum > 1 above
        from heads b join anchors a on a.page = b.page and a.col = b.col and case when own is not null then ord = anchor_ord else y1 >= top - 8 and y1 < below + 8 or nth = 1 and y1 < top - 8 and qnum > 1 end
        qualify row_number() over (partition by b.page, b.col, ord order by anchor_seq) = 1),
    parted as (select *, case when own is not null then 0 when above then 1 else 2 end part from mine),
    gaps as (select *, lead(y1) over w - y2 gap, row_number() over w pos, count(*) over (partition by page, col, anchor_ord, part) members from parted window w as (partition by page, col, anchor_ord, part order by y1, x1, ord)),
    ranked as (select *, case when part = 0 or part = 2 and members < 2 then 1 when above then qnum - 1 else parts end asked, row_number() over (partition by page, col, anchor_ord, part order by gap desc nulls last, pos) rk from gaps),
    cuts as (select *, coalesce(sum(case when rk <= asked - 1 and gap is not null and members >= asked then 1 else 0 end) over (partition by page, col, anchor_ord, part order by pos rows between unbounded preceding and 1 preceding), 0)::bigint segment from ranked),
    starts as (select *, first_value(ord) over (partition by page, col, anchor_ord, part, segment order by pos) begins from cuts),
    questions as (select page, col, ord, kind, x1, y1, x2, y2, txt, case when above or part = 2 and segment > 0 then begins else anchor_ord end anchor_ord, case when above then segment + 1 else qnum + segment end qnum from starts)"""

ORACLES = {
    "page_questions": f"with {BOXES}, {COLS}, {QUESTIONS} select page, col, ord, anchor_ord, qnum from questions",
    # The whole chain: grid, cut, margins, columns, questions, tails, clipped boxes, lines (a fold), best group, margins of the box.
    "page_problems": rf"""with recursive {BOXES}, grid as (select * from boxes qualify row_number() over (partition by page, kind, txt, x1 // 2, y1 // 2, x2 // 2, y2 // 2 order by ord) = 1),
        {CUT.replace("from boxes", "from grid")}, page_cut as (select page, case when y_cut <= 0 then {int(HEIGHT * 0.08)} else y_cut end y_cut from cut),
        inner_ as (select b.* from grid b join page_cut using (page) where y1 >= y_cut and y1 < {HEIGHT} * 0.8::double and kind not in ('title', 'header') and not (kind = 'sub_title' and regexp_matches(txt, '{L.NOT_ANCHORS}'))
            and (y1 < {HEIGHT} * 0.3::double or kind <> 'text' or txt <> '' and not (y1 > {HEIGHT} * 0.6::double and regexp_matches(txt, '{"|".join(L.FOOTER_WORDS)}|^[○•*]')) and not regexp_matches(txt, '^\s*\d{{1,2}}\s*[\s/–-]\s*\d{{1,3}}\s*$'))),
        {COLS.replace("from boxes", "from inner_")}, {QUESTIONS},
        tails as (select page, col, anchor_ord, qnum, round(quantile_cont(y2, 0.6), 6) + 200 lim from questions where ord <> anchor_ord and y2 < 3500 group by all),
        kept as (select q.* from questions q left join tails using (page, col, anchor_ord, qnum) where ord = anchor_ord or lim is null or y1 <= lim
            or not (length(txt) < 10 or length(txt) < 15 and length(regexp_replace(txt, '[^0-9]', '', 'g')) / greatest(1, length(replace(txt, ' ', ''))) > 0.5)),
        own as materialized (select * from (select * replace (greatest(0, case when col = 0 then x1 else greatest(x1, {MID + 5}) end) as x1, least({WIDTH}, case when col = 0 then least(x2, {MID - 5}) else x2 end) as x2) from kept) where x2 - x1 >= 2),
        bounds as (select page, col, anchor_ord, qnum, min(x1) x1, min(y1) y1, max(x2) x2, max(y2) y2, count(*) n_blocks from own group by all),
        o as materialized (select page, col, anchor_ord, qnum, y1, txt, row_number() over (partition by page, col, anchor_ord, qnum order by y1, x1, ord, txt) k from own where kind in ('text', 'equation') and txt <> ''),
        f as (select page, col, anchor_ord, qnum, k, y1 top, txt merged from o where k = 1 union all
            select o.page, o.col, o.anchor_ord, o.qnum, o.k, case when abs(o.y1 - f.top) <= 16 then f.top else o.y1 end, f.merged || case when abs(o.y1 - f.top) <= 16 then ' ' else chr(10) end || o.txt
            from f join o on o.page = f.page and o.col = f.col and o.anchor_ord = f.anchor_ord and o.qnum = f.qnum and o.k = f.k + 1),
        l as (select page, col, anchor_ord, qnum, regexp_replace(merged, '^(.*[^①-⑳])(\s*\n\s*|\s+)(\d{{1,5}})+\s*$', '\1', 's') merged from f qualify row_number() over (partition by page, col, anchor_ord, qnum order by k desc) = 1),
        best as (select b.*, coalesce(merged, '') merged, trunc((x2 - x1) * 0.02::double)::int mx, trunc((y2 - y1) * 0.02::double)::int my from bounds b left join l using (page, col, anchor_ord, qnum)
            qualify row_number() over (partition by page, qnum order by length(coalesce(merged, '')) desc, greatest(1, (x2 - x1) * (y2 - y1)) desc, col, anchor_ord) = 1),
        e as (select * replace (greatest(0, x1 - mx) as x1, greatest(0, y1 - my) as y1, least({WIDTH}, x2 + trunc(mx * 1.25::double)::int) as x2, least({HEIGHT}, y2 + my * 3) as y2) from best),
        c as (select *, case when col = 0 then least(x2, {MID - 5}) else least({WIDTH}, x2) end b0, case when col = 0 then greatest(0, x1) else greatest(x1, {MID + 5}) end a0 from e),
        w as (select *, case when col = 0 and b0 - a0 < 24 then greatest(0, b0 - 24) else a0 end a, case when col = 1 and b0 - a0 < 24 then least({WIDTH}, a0 + 24) else b0 end b from c)
        select page, qnum::bigint qnum, merged, case when b <= a then {min(MID - 29, WIDTH - 24)} else a end bx1, greatest(y1, y_cut) by1, case when b <= a then {min(MID - 29, WIDTH - 24) + 24} else b end bx2, y2 by2, n_blocks from w join page_cut using (page)""",
    "dedup_grid_blocks": f"with {BOXES}, b as (select * replace (y1 % 4 as y1) from boxes) select page, ord, kind, x1, y1 from b qualify row_number() over (partition by page, kind, txt, x1 // 2, y1 // 2, x2 // 2, y2 // 2 order by ord) = 1",
    "bbox_norm_to_px": f"""with p as (select l_orderkey page, l_linenumber ord, round_even((l_partkey % 1000) / 999 * {WIDTH}, 0)::int px, round_even((l_suppkey * 7 % 1000) / 999 * {HEIGHT}, 0)::int py from lineitem)
        select page, ord, px, py, round_even(px / {WIDTH} * 999, 0)::int back from p""",
    "bbox_expand_margin": f"""with {BOXES}, m as (select *, trunc((x2 - x1) * 0.05::double)::int mx, trunc((y2 - y1) * 0.05::double)::int my, case when x1 + x2 < {WIDTH} then 0 else 1 end col from boxes),
        e as (select page, ord, col, greatest(0, x1 - mx) x1, greatest(0, y1 - my) y1, least({WIDTH}, x2 + trunc(mx * 1.25::double)::int) x2, least({HEIGHT}, y2 + my * 3) y2 from m),
        c as (select page, ord, col, y1, y2, case when col = 0 then least(x2, {MID - 5}) else least({WIDTH}, x2) end b, case when col = 0 then greatest(0, x1) else greatest(x1, {MID + 5}) end a from e),
        w as (select page, ord, col, y1, y2, case when col = 0 and b - a < 24 then greatest(0, b - 24) else a end a, case when col = 1 and b - a < 24 then least({WIDTH}, a + 24) else b end b from c)
        select page, ord, col, greatest(y1, 280) y1, y2, case when b <= a then greatest(0, least({MID - 29}, {WIDTH - 24})) else a end x1,
            case when b <= a then least({WIDTH}, greatest(0, least({MID - 29}, {WIDTH - 24})) + 24) else b end x2 from w""",
    "clip_columns": f"""with {BOXES}, c as (select page, ord, greatest(0, case when ord % 2 = 0 then x1 else greatest(x1, {MID + 5}) end) x1, least({WIDTH}, case when ord % 2 = 0 then least(x2, {MID - 5}) else x2 end) x2 from boxes)
        select * from c where x2 - x1 >= 2""",
    "column_split": f"with {BOXES}, {COLS} select page, ord, col from cols",
    "page_top_cut": f"with {BOXES}, {CUT} select page, y_cut from cut",
    "page_margins": f"""with {BOXES}, {CUT} select b.page, ord, kind from boxes b join cut using (page)
        where y1 >= case when y_cut <= 0 then {int(HEIGHT * 0.08)} else y_cut end and y1 < {HEIGHT} * 0.8::double and kind not in ('title', 'header')
        and (y1 < {HEIGHT} * 0.3::double or kind <> 'text' or not (y1 > {HEIGHT} * 0.82::double and length(txt) < 10 and length(regexp_replace(txt, '[^0-9]', '', 'g')) / greatest(1, length(txt)) > 0.6))""",
    "spatial_anti_overlap": f"with {BOXES} select page, ord from boxes a where ord % 2 = 1 and not exists (select 1 from boxes b where b.page = a.page and b.ord % 2 = 0 and ({sql_share('a', 'b')} >= 0.25 or {sql_share('b', 'a')} >= 0.25))",
    "interval_assign_anchor": f"""with {BOXES}, {COLS}, m as (select *, case when kind in ('text', 'sub_title', 'equation') then {sql_anchor("txt")} end qnum, row_number() over (partition by page, col order by y1, x1, ord) seq from cols),
        a as (select page, col, ord anchor_ord, qnum, y1 top, seq anchor_seq, lead(y1, 1, 1000000000) over (partition by page, col order by seq) below from m where qnum is not null)
        select m.page, m.col, m.ord, anchor_ord, a.qnum::bigint qnum from m join a on m.page = a.page and m.col = a.col and case when m.qnum is not null then m.ord = anchor_ord else m.y1 >= top - 8 and m.y1 < below + 8 end
        qualify row_number() over (partition by m.page, m.col, m.ord order by anchor_seq) = 1""",
    "gap_split_topk": f"""with {BOXES}, g as (select *, lead(y1) over w - y2 gap, row_number() over w pos, count(*) over (partition by page) n from boxes window w as (partition by page order by y1, x1, ord)),
        r as (select *, row_number() over (partition by page order by gap desc nulls last, pos) rk from g), c as (select *, case when rk <= 2 and gap is not null and n >= 3 then 1 else 0 end cut from r)
        select page, ord, coalesce(sum(cut) over (partition by page order by pos rows between unbounded preceding and 1 preceding), 0)::bigint segment from c""",
    "percentile_tail_filter": f"""with {BOXES}, p as (select *, row_number() over (partition by page order by y1, x1, ord) pos from boxes), q as (select page, round(quantile_cont(y2, 0.6), 6) + 200 lim from p where pos > 1 and y2 < 3500 group by page)
        select p.page, ord from p left join q using (page) where pos = 1 or lim is null or y1 <= lim or not (length(txt) < 10 or (length(txt) < 15 and length(regexp_replace(txt, '[^0-9]', '', 'g')) / greatest(1, length(replace(txt, ' ', ''))) > 0.5))""",
    # Folds over a page's blocks: lines from their first block on, boxes that no larger one covers.
    "line_merge": rf"""with recursive {BOXES}, b as (select page, txt, x1, ord, y1 % 90 y1 from boxes where kind in ('text', 'equation') and txt <> ''), o as (select *, row_number() over (partition by page order by y1, x1, ord, txt) k from b),
        f as (select page, k, y1 top, 1 n, txt merged from o where k = 1 union all
            select o.page, o.k, case when abs(o.y1 - f.top) <= 16 then f.top else o.y1 end, case when abs(o.y1 - f.top) <= 16 then f.n else f.n + 1 end, f.merged || case when abs(o.y1 - f.top) <= 16 then ' ' else chr(10) end || o.txt from f join o on o.page = f.page and o.k = f.k + 1),
        l as (select page, n::bigint n_lines, regexp_replace(merged, '^(.*[^①-⑳])(\s*\n\s*|\s+)(\d{{1,5}})+\s*$', '\1', 's') merged from f qualify row_number() over (partition by page order by k desc) = 1)
        select page, n_lines, md5(merged) merged_md5 from l""",
    "greedy_suppression": f"""with recursive {BOXES}, o as (select *, (x2 - x1) * (y2 - y1) area, row_number() over (partition by page order by (x2 - x1) * (y2 - y1) desc, y1, x1, x2, y2, ord) k from boxes),
        f as (select page, 0::bigint k, []::struct(ord bigint, x1 int, y1 int, x2 int, y2 int, area int)[] kept from (select distinct page from boxes) union all
            select o.page, o.k, case when len(kept) >= 6 or len(list_filter(kept, lambda a: least(a.x2, o.x2) > greatest(a.x1, o.x1) and least(a.y2, o.y2) > greatest(a.y1, o.y1)
                and (least(a.x2, o.x2) - greatest(a.x1, o.x1)) * (least(a.y2, o.y2) - greatest(a.y1, o.y1)) > 0.5 * least(a.area, o.area))) > 0 then kept
                else list_append(kept, {{'ord': o.ord, 'x1': o.x1, 'y1': o.y1, 'x2': o.x2, 'y2': o.y2, 'area': o.area::int}}) end from f join o on o.page = f.page and o.k = f.k + 1),
        l as (select page, kept from f qualify row_number() over (partition by page order by k desc) = 1), u as (select page, unnest(kept) b from l)
        select page, b.ord ord, row_number() over (partition by page order by b.y1, b.x1, b.ord) number from u""",
    "best_group_per_number": f"with {BOXES} select page, ord % 3 qnum, ord col, (x2 - x1) * (y2 - y1) area from boxes qualify row_number() over (partition by page, ord % 3 order by length(txt) desc, (x2 - x1) * (y2 - y1) desc, ord) = 1",
}
