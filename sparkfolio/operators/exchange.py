"""What goes to models and what comes back: messages, replies, keys, cached texts; results beside models; clusters of steps."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from ..functions import text as T
from . import models, network, solve

# Logos by the beginning of a model's id, and the one for all others; titles of clusters.
LOGOS = (("openai/", "openai.png"), ("anthropic/", "claude.png"), ("google/", "gemini.jpeg"), ("x-ai/", "grok.png"))
SHARED_TITLE, UNTITLED = "공통 단계: ", "공통 풀이 단계"

#: A content part of a message: its text, its source if it is an image, or the address of one.
PART = "struct<type:string,text:string,source:string,media_type:string,data:string,url:string>"


def _data_url(x: Column) -> Column:
    return F.concat(F.lit("data:"), F.coalesce(x["media_type"], F.lit("image/png")), F.lit(";base64,"), F.coalesce(x["data"], F.lit("")))


def chat_parts(parts: Column) -> Column:
    """array<struct<type, value>> of parts (array of PART) for a chat call: texts as they are, embedded images as data addresses."""
    return F.transform(parts, lambda x: F.when((x["type"] == "image") & (x["source"] == "base64"), F.struct(F.lit("image_url").alias("type"), _data_url(x).alias("value"))).otherwise(F.struct(x["type"].alias("type"), F.when(x["type"] == "text", F.coalesce(x["text"], F.lit(""))).otherwise(F.coalesce(x["url"], x["text"])).alias("value"))))


def response_parts(parts: Column) -> Column:
    """array<struct<type, value>> for a responses call: input_text, or input_image with an address; what is neither is its JSON as text."""
    say = lambda kind, v: F.struct(F.lit(kind).alias("type"), v.alias("value"))
    return F.transform(parts, lambda x: F.when(x["type"] == "text", say("input_text", F.coalesce(x["text"], F.lit("")))).when((x["type"] == "image") & (x["source"] == "base64"), say("input_image", _data_url(x))).when((x["type"] == "image_url") & (F.coalesce(x["url"], F.lit("")) != ""), say("input_image", x["url"])).otherwise(say("input_text", F.to_json(x))))


def with_prompt(prompt: Column, messages: Column) -> Column:
    """array<struct<role, content>> that begins with the system's prompt; a message without a role is the user's."""
    first = F.array(F.struct(F.lit("system").alias("role"), F.array(F.struct(F.lit("input_text").alias("type"), prompt.alias("value"))).alias("content")))
    return F.concat(first, F.transform(messages, lambda m: F.struct(F.coalesce(m["role"], F.lit("user")).alias("role"), m["content"].alias("content"))))


def reply_text(output_text: Column, outputs: Column) -> Column:
    """The text of a reply: its own field, or all texts of its messages (outputs: array<struct<type, content array<struct<type, text>>>>); null if empty."""
    said = F.flatten(F.transform(F.filter(outputs, lambda o: o["type"] == "message"), lambda o: F.coalesce(o["content"], F.array().cast("array<struct<type:string,text:string>>"))))
    texts = F.transform(F.filter(said, lambda c: c["type"].isin("output_text", "text") & c["text"].isNotNull()), lambda c: c["text"])
    whole = F.coalesce(T.trim_ws(output_text), F.lit(""))
    return F.coalesce(F.nullif(whole, F.lit("")), F.nullif(T.trim_ws(F.array_join(texts, "")), F.lit("")))


def braced(reply: Column) -> Column:
    """From the first opening to the last closing brace; null without them. What is inside is read strictly."""
    return F.nullif(F.regexp_extract(reply, r"(?s)\{.*\}", 0), F.lit(""))


def logo(model: Column) -> Column:
    return F.coalesce(*[F.when(model.startswith(p), F.lit(name)) for p, name in LOGOS], F.lit(LOGOS[0][1]))


def without_keys(requests: DataFrame, keys: DataFrame) -> tuple[DataFrame, DataFrame]:
    """requests (problem, model, key_name), keys (key_name) -> those that can run, and an error event for each other one."""
    known = keys.select("key_name").distinct()
    missing = requests.join(known, "key_name", "left_anti")
    events = missing.select("problem", "model", F.lit("event").alias("kind"), F.lit("error").alias("event"), F.concat("key_name", F.lit(" is missing")).alias("message"))
    return requests.join(known, "key_name", "left_semi"), events


def converted(requests: DataFrame, cache: DataFrame, model: str) -> DataFrame:
    """requests (id, raw), cache (slug, text) -> (id, text): an empty text stays empty; the cached text, or else the model's
    of the raw one without tags, each with its fifth option mended; if the model fails, the raw one without tags.
    """
    kept = cache.select("slug", T.trim_ws(F.col("text")).alias("cached")).where("cached <> ''")
    rows = requests.withColumn("raw", T.trim_ws(F.coalesce("raw", F.lit("")))).withColumn("slug", T.slug(F.col("id"))).join(kept, "slug", "left")
    plain = F.coalesce(F.nullif(T.strip_tags(F.col("raw")), F.lit("")), F.col("raw"))
    hits = rows.where("cached is not null or raw = ''").select("id", F.when(F.col("raw") == "", "").otherwise(solve.fix_fifth_option(F.col("cached"), F.col("raw"))).alias("text"))
    asked = models.apply_model(rows.where("cached is null and raw <> ''").select("id", "raw", plain.alias("plain"), plain.alias("stored")), model)
    answer = F.when(F.coalesce("reply", F.lit("")) != "", solve.fix_fifth_option(F.col("reply"), F.col("raw"))).otherwise(T.trim_ws(F.col("plain")))
    return hits.unionByName(asked.select("id", answer.alias("text")))


def by_id_or_name(wanted: DataFrame, results: DataFrame) -> DataFrame:
    """wanted (model_id, name), results (pos, model_id, name, ...) -> every wanted model with the first result that has its id or its name."""
    keyed = lambda df: df.withColumn("key", F.explode(F.array(F.struct(F.lit(0).alias("kind"), F.col("model_id").alias("is")), F.struct(F.lit(1).alias("kind"), F.col("name").alias("is")))))
    own = [c for c in results.columns if c not in ("model_id", "name")]
    found = keyed(results).where("key.is is not null").select("key", F.struct("pos", *[c for c in own if c != "pos"]).alias("r"))
    first = keyed(wanted.select("model_id", "name")).join(found, "key").groupBy("model_id").agg(F.min_by("r", "r.pos").alias("r"))
    return wanted.join(first, "model_id", "left").select(*wanted.columns, *[F.col(f"r.{c}").alias(c) for c in own])


def stream_text(name: Column, steps: Column, answer: Column) -> Column:
    """Results as the JSON text that a solver would have streamed; empty without steps. steps: array<struct<title, body>>."""
    rows = F.transform(steps, lambda s, i: F.struct(i.alias("step_idx"), s["title"].alias("title"), s["body"].alias("content")))
    return F.when(steps.isNull(), "").otherwise(F.to_json(F.struct(name.alias("model_name"), rows.alias("steps"), answer.alias("final_answer"))))


def checked(ids: DataFrame, valid: DataFrame) -> DataFrame:
    """ids (problem, id) that still are valid ones."""
    return ids.select("problem", "id").distinct().join(valid.select("problem", "id"), ["problem", "id"], "left_semi")


def title_tokens(text: Column) -> Column:
    return T.tokens(text, T.TITLE_STOPWORDS)


def clusters(steps: DataFrame, members: DataFrame, templates: DataFrame | None = None) -> DataFrame:
    """steps (problem, solver, idx, title, body), members (problem, component, solver, idx) -> (problem, key, place, shared, title,
    solvers, models, members, mean_idx, mean_solver): components, and of all other steps one cluster each, in order of their
    mean steps, then their mean solvers (each solver once), then their first members.

    A component is shared if two solvers at least have steps of it. Its title is the template (place, title, keywords) that its
    texts match, if it is shared and `templates` are given; else the one that all its steps have, or its three most frequent tokens
    (first seen first).
    """
    step, group = ["problem", "solver", "idx"], ["problem", "component"]
    title = T.trim_ws(F.coalesce("title", F.lit("")))
    own = steps.join(members.select(*step, "component"), step, "left").withColumn("t", title)
    grouped, solo = own.where("component is not null"), own.where("component is null")
    line = F.concat_ws(" ", F.coalesce("title", F.lit("")), F.coalesce("body", F.lit("")))
    heads = grouped.groupBy(*group).agg(
        F.array_sort(F.collect_set(F.nullif("t", F.lit("")))).alias("titles"), F.min(F.when(F.col("t") != "", F.struct("solver", "idx", "t")))["t"].alias("first"),
        F.array_sort(F.collect_set("solver")).alias("models"), F.array_sort(F.collect_list(F.struct("solver", "idx"))).alias("members"), F.avg("idx").alias("mean_idx"),
    )
    heads = heads.withColumns({"solvers": F.size("models").cast("long"), "shared": F.size("models") >= 2, "mean_solver": F.aggregate("models", F.lit(0.0), lambda a, x: a + x) / F.size("models")})
    said = grouped.select(*group, "solver", "idx", F.posexplode(title_tokens(line)).alias("pos", "token"))
    freq = said.groupBy(*group, "token").agg(F.count(F.lit(1)).alias("n"), F.min(F.struct("solver", "idx", "pos")).alias("seen"))
    top = freq.withColumn("rank", F.row_number().over(Window.partitionBy(*group).orderBy(F.desc("n"), "seen"))).where("rank <= 3")
    top = top.groupBy(*group).agg(F.array_join(F.transform(F.array_sort(F.collect_list(F.struct("rank", "token"))), lambda x: x["token"]), " · ").alias("tokens"))
    named = F.when(F.size("titles") == 1, F.col("titles")[0]).when(F.col("tokens").isNotNull(), F.concat(F.lit(SHARED_TITLE), "tokens")).otherwise(F.coalesce("first", F.lit(UNTITLED)))
    found = heads.join(top, group, "left").withColumn("title", named)
    if templates is not None:
        texts = grouped.groupBy(*group).agg(F.array_join(F.transform(F.array_sort(F.collect_list(F.struct("solver", "idx", line.alias("line")))), lambda x: x["line"]), " ").alias("body"))
        hits = network.template_match(texts.select(F.struct(*group).alias("id"), "body"), templates).select("id.problem", "id.component", F.col("title").alias("template"))
        found = found.join(hits, group, "left").withColumn("title", F.when(F.col("shared"), F.coalesce("template", "title")).otherwise(F.col("title")))
    cols = ["problem", "key", "shared", "title", "solvers", "models", "members", "mean_idx", "mean_solver", "is_solo"]
    one = found.withColumns({"key": F.concat(F.lit("shared:"), F.col("component").cast("string")), "is_solo": F.lit(False)}).select(*cols)
    other = solo.select(
        "problem", F.concat_ws(":", F.lit("solo"), F.col("solver").cast("string"), F.col("idx").cast("string")).alias("key"), F.lit(False).alias("shared"), F.coalesce(F.nullif("title", F.lit("")), F.concat(F.lit("Step "), (F.col("idx") + 1).cast("string"))).alias("title"),
        F.lit(1).cast("long").alias("solvers"), F.array("solver").alias("models"), F.array(F.struct("solver", "idx")).alias("members"), F.col("idx").cast("double").alias("mean_idx"), F.col("solver").cast("double").alias("mean_solver"), F.lit(True).alias("is_solo"),
    )
    order = Window.partitionBy("problem").orderBy("mean_idx", "mean_solver", "is_solo", "members")
    return one.unionByName(other).withColumn("place", F.row_number().over(order).cast("long")).drop("is_solo")
