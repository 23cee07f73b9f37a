"""Replies and messages as VARIANT: JSON of any shape, read without a schema and without Python where it is sound.

Kinds are those that schema_of_variant names: STRING, BIGINT, DECIMAL(..), DOUBLE, BOOLEAN, VOID (a JSON null), OBJECT<..>, ARRAY<..>;
a member that is not there has no kind (null).
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from ..functions import text as T
from . import solve

#: How an object reads where a text is asked for.
OBJECT_TEXT = "[object Object]"


def member(v: Column, name: str) -> Column:
    return F.try_variant_get(v, f"$.{name}", "variant")


def kind(v: Column) -> Column:
    return F.schema_of_variant(v)


def is_object(v: Column) -> Column:
    return F.coalesce(kind(v).startswith("OBJECT"), F.lit(False))


def items(v: Column) -> Column:
    """The elements of an array, null of anything else."""
    return F.try_variant_get(v, "$", "array<variant>")


def only_text(v: Column) -> Column:
    """A string as it is, anything else empty."""
    return F.when(kind(v) == "STRING", F.try_variant_get(v, "$", "string")).otherwise("")


def scalar_text(v: Column) -> Column:
    """A value as text: numbers without a fraction of zeros, objects by OBJECT_TEXT, nested arrays by their JSON; null of nothing and of a JSON null."""
    k = kind(v)
    number = F.regexp_replace(F.try_variant_get(v, "$", "double").cast("string"), r"\.0$", "")
    return F.when(k.isin("STRING", "BOOLEAN", "BIGINT"), F.try_variant_get(v, "$", "string")).when(k.startswith("OBJECT"), F.lit(OBJECT_TEXT)).when(k.startswith("ARRAY"), F.to_json(v)).when(k != "VOID", number)


def value_text(v: Column) -> Column:
    """scalar_text(), and an array as its values with commas between."""
    return F.coalesce(F.array_join(F.transform(items(v), lambda x: F.coalesce(scalar_text(x), F.lit(""))), ","), scalar_text(v))


def solution(text: Column, is_sat: Column, problem_text: Column) -> Column:
    """struct(steps array<struct<title, body>>, final_answer) of a reply that is JSON as a whole; of anything else nothing.

    Elements of steps that are objects or arrays are steps; titles and contents that are no strings are empty. The answer is what
    final_answer() makes of it for a problem.
    """
    step = lambda s: F.struct(only_text(member(s, "title")).alias("title"), only_text(member(s, "content")).alias("body"))
    none = F.array().cast("array<struct<title:string,body:string>>")

    def read(v: Column) -> Column:
        steps = F.transform(F.filter(items(member(v, "steps")), lambda s: kind(s).rlike("^(OBJECT|ARRAY)")), step)
        final = T.let(T.let(member(v, "final_answer"), value_text), lambda a: F.when(a.isNotNull(), T.final_answer(a, is_sat, problem_text)).otherwise(""))
        return F.struct(F.coalesce(steps, none).alias("steps"), final.alias("final_answer"))

    # Parsed once: what is in a lambda is computed anew wherever it stands.
    return T.let(F.try_parse_json(text), read)


def _plain(v: Column, *kinds: str) -> Column:
    return F.coalesce(kind(v).isin("STRING", "VOID", *kinds), F.lit(True))


def sound(v: Column) -> Column:
    """Whether a reply parses and all that is read of it is of the kind that is asked for: nothing in it needs mending."""
    steps = member(v, "steps")
    fine = F.forall(F.filter(items(steps), is_object), lambda s: _plain(member(s, "title")) & _plain(member(s, "content")) & F.coalesce(kind(member(s, "step_idx")) == "BIGINT", F.lit(True)))
    others = _plain(member(v, "final_answer")) & _plain(member(v, "rationale")) & _plain(member(v, "confidence"))
    return is_object(v) & F.coalesce(fine, F.lit(True)) & others


def parsed(replies: DataFrame, column: str, into: str) -> DataFrame:
    """replies with the struct solve.REPLY of a column. What is sound, code fences aside, is read as VARIANT where it lies; only the rest goes to
    Python to be mended.
    """
    own = replies.columns
    body = T.trim_ws(F.regexp_replace(F.coalesce(F.col(column), F.lit("")), r"```(?:json)?\s*", ""))
    held = replies.withColumn("_v", F.try_parse_json(body))
    text = lambda v, name: F.try_variant_get(v, f"$.{name}", "string")
    v = F.col("_v")
    step = lambda s: F.struct(F.try_variant_get(s, "$.step_idx", "int").alias("step_idx"), text(s, "title").alias("title"), text(s, "content").alias("content"))
    steps = F.coalesce(F.transform(F.filter(items(member(v, "steps")), is_object), step), F.array().cast(solve.REPLY["steps"].dataType))
    read = held.where(sound(v)).select(*own, F.struct(steps.alias("steps"), *(text(v, n).alias(n) for n in ("final_answer", "rationale", "confidence"))).alias(into))
    rest = held.where(~sound(v)).select(*own, solve.repair_json(F.col(column)).alias(into))
    return read.unionByName(rest)


def said(v: Column) -> Column:
    """A value as the producers of messages print it: texts as they are, the others by their JSON, in capitals what is true, false or nothing."""
    k = kind(v)
    return F.when(k == "STRING", F.try_variant_get(v, "$", "string")).when(k == "VOID", "None").when(k == "BOOLEAN", F.initcap(F.try_variant_get(v, "$", "string"))).otherwise(F.to_json(v))


def _data_url(item: Column) -> Column:
    """The address of an embedded image; null of an item that is none."""
    source = member(item, "source")
    here = lambda name, other: F.when(member(source, name).isNull(), other).otherwise(said(member(source, name)))
    embedded = (only_text(member(item, "type")) == "image") & (only_text(member(source, "type")) == "base64")
    return F.when(embedded, F.concat(F.lit("data:"), here("media_type", "image/png"), F.lit(";base64,"), here("data", "")))


def _text_of(item: Column) -> Column:
    return F.when(member(item, "text").isNull(), "").otherwise(said(member(item, "text")))


def chat_item(item: Column) -> Column:
    """A content item for a chat call: embedded images by address, texts alone, anything else as it is."""
    url = _data_url(item)
    image = F.to_variant_object(F.struct(F.lit("image_url").alias("type"), F.struct(url.alias("url")).alias("image_url")))
    return F.when(url.isNotNull(), image).when(is_object(item) & (only_text(member(item, "type")) == "text"), _text_of(item).cast("variant")).otherwise(item)


def response_item(item: Column) -> Column:
    """struct(type, text, image_url) of a content item for a responses call; what is neither text nor image is its JSON as text."""
    what = lambda t, text, url: F.struct(F.lit(t).alias("type"), text.alias("text"), url.alias("image_url"))
    none = F.lit(None).cast("string")
    given = member(item, "image_url")
    link = F.nullif(F.when(is_object(given), only_text(member(given, "url"))).otherwise(only_text(given)), F.lit(""))
    url = F.coalesce(_data_url(item), F.when(only_text(member(item, "type")) == "image_url", link))
    is_text = only_text(member(item, "type")) == "text"
    return F.when(~is_object(item), what("input_text", said(item), none)).when(is_text, what("input_text", _text_of(item), none)).when(url.isNotNull(), what("input_image", none, url)).otherwise(what("input_text", F.to_json(item), none))


def chat_messages(messages: Column) -> Column:
    """array<struct<role, content variant>> of messages (an array as VARIANT); content that is no list stays as it is."""
    body = lambda m: F.when(items(member(m, "content")).isNotNull(), F.to_variant_object(F.transform(items(member(m, "content")), chat_item))).when(member(m, "content").isNull(), F.lit("").cast("variant")).otherwise(member(m, "content"))
    return F.transform(items(messages), lambda m: F.struct(F.coalesce(said(member(m, "role")), F.lit("user")).alias("role"), body(m).alias("content")))


def response_messages(prompt: Column, messages: Column) -> Column:
    """array<struct<role, content array<struct<type, text, image_url>>>>: the system's prompt, then the messages; content that is no list is one text."""
    one = lambda text: F.array(F.struct(F.lit("input_text").alias("type"), text.alias("text"), F.lit(None).cast("string").alias("image_url")))
    body = lambda m: F.coalesce(F.transform(items(member(m, "content")), response_item), one(F.when(member(m, "content").isNull(), "").otherwise(said(member(m, "content")))))
    rest = F.transform(items(messages), lambda m: F.struct(F.coalesce(said(member(m, "role")), F.lit("user")).alias("role"), body(m).alias("content")))
    return F.concat(F.array(F.struct(F.lit("system").alias("role"), one(prompt).alias("content"))), rest)
