"""Text rules as column expressions. Patterns name their character classes, so that no regex dialect matters."""

from __future__ import annotations

import unicodedata
from functools import reduce

import pandas as pd
from pyspark.sql import Column
from pyspark.sql import functions as F
from pyspark.sql.types import StringType

# Stop words of step tokens.
STEP_STOPWORDS = (
    "the", "and", "of", "to", "in", "on", "for", "a", "an", "with", "is", "are",
    "을", "를", "이", "가", "은", "는", "에", "의", "으로", "로", "과", "와", "에서", "하다", "한다", "및",
)
# Stop words of cluster titles.
TITLE_STOPWORDS = (
    "the", "and", "or", "to", "of", "in", "for", "with", "a", "an", "is", "are",
    "이", "가", "은", "는", "을", "를", "의", "에", "에서", "으로", "로", "및", "또는", "그리고", "경우", "한다", "하기", "구하기",
)
# Mathematical words that count as features of a step.
MATH_WORDS = (
    "sin", "cos", "tan", "log", "ln", "sqrt", "abs", "exp", "lim", "sum", "prod", "integral", "derivative",
    "미분", "적분", "로그", "사인", "코사인", "탄젠트", "루트", "절댓값", "지수", "합", "곱", "극한",
)
# Symbols by the kind of feature they make.
SYMBOL_KINDS = {"rel": "=≠≤≥<>", "op": "+-*/^%·", "struct": "()[]{}"}

#: What JavaScript and Python call white space.
WS = r"[\s\x0B\u00A0\u1680\u2000-\u200A\u2028\u2029\u202F\u205F\u3000\uFEFF]"


def let(value: Column, then) -> Column:
    """then(value), with value computed once a row, however often a lambda in `then` reads it."""
    return F.element_at(F.transform(F.array(value), then), 1)


def trim_ws(text: Column) -> Column:
    return F.regexp_replace(text, f"^{WS}+|{WS}+$", "")


def normalize_text(text: Column) -> Column:
    """Lower case; LaTeX commands and everything but letters and digits become single spaces."""
    plain = F.regexp_replace(F.lower(text), r"\\[a-zA-Z]+", " ")
    plain = F.regexp_replace(plain, r"[^\p{L}\p{N}\s]", " ")
    return F.trim(F.regexp_replace(plain, f"{WS}+", " "))


def tokens(text: Column, stopwords: tuple[str, ...] = STEP_STOPWORDS) -> Column:
    words = F.split(normalize_text(text), " ")
    return F.filter(words, lambda w: (w != "") & ~w.isin(*stopwords))


def _plain(text: str | None) -> str | None:
    if text is None or text.isascii():
        return text
    return unicodedata.normalize("NFC", "".join(c for c in unicodedata.normalize("NFD", text) if unicodedata.category(c)[0] != "M"))


@F.pandas_udf(StringType())
def without_accents(text: pd.Series) -> pd.Series:
    """Letters without their marks; a letter that has none, like the German sharp s, stays what it is."""
    return text.map(_plain)


def char_ngrams(text: Column, n: int = 2) -> Column:
    """All n-grams of the text without spaces; the text itself if shorter."""
    def grams(x: Column) -> Column:
        own, k = x["own"], F.size(x["own"]) - (n - 1)
        shifted = [F.slice(own, i + 1, F.greatest(k, F.lit(0))) for i in range(n)]
        every = reduce(lambda a, b: F.zip_with(a, b, lambda x, y: F.concat(x, y)), shifted)
        return F.when(F.size(own) == 0, own).when(k < 1, F.array(F.array_join(own, ""))).otherwise(every)

    letters = F.filter(F.split(F.replace(normalize_text(text), F.lit(" "), F.lit("")), ""), lambda c: c != "")
    return let(F.struct(letters.alias("own")), grams)


def _all(text: Column, pattern: str) -> Column:
    return F.regexp_extract_all(text, F.lit(pattern), F.lit(0))


def _named(text: Column, pattern: str, name: str) -> Column:
    return F.transform(_all(text, pattern), lambda _: F.lit(name))


def _prefixed(text: Column, pattern: str, kind: str) -> Column:
    return F.transform(_all(text, pattern), lambda m: F.concat(F.lit(kind + ":"), m))


#: Boundaries of ASCII words, which Java's own are not: before and after a word character, and on either side.
LEFT, RIGHT = "(?<![A-Za-z0-9_])", "(?![A-Za-z0-9_])"
EDGE = r"(?:(?<=[A-Za-z0-9_])(?![A-Za-z0-9_])|(?<![A-Za-z0-9_])(?=[A-Za-z0-9_]))"


def _if(condition: Column, *parts: Column) -> list[Column]:
    """The parts, looked for only where a cheap test lets them occur."""
    return [F.when(condition, F.concat(*parts)).otherwise(F.array().cast("array<string>"))]


def math_tokens(text: Column) -> Column:
    """Features of formulas. Rules overlap on purpose: a fraction also gives its command, its digits and its braces."""
    low = F.lower(text)
    ascii_words = "|".join(w for w in MATH_WORDS if w.isascii())
    parts = [
        *_if(
            text.contains("\\"),
            _named(low, r"\\frac\{[^}]+\}\{[^}]+\}", "latex:frac"),
            _named(low, r"\\sqrt\{[^}]+\}", "latex:sqrt"),
            F.transform(_all(low, r"\\[a-zA-Z]+"), lambda m: F.concat(F.lit("latex:"), F.substring(m, F.lit(2), F.length(m)))),
        ),
        *_if(text.contains("^"), _named(low, r"[a-z]\^\{?[-]?[a-z0-9]+\}?", "pattern:power")),
        *_if(text.contains("_"), _named(low, r"[a-z]_\{?[a-z0-9]+\}?", "pattern:subscript")),
        *_if(text.contains("/"), _named(text, LEFT + r"\d+(?:\.\d+)?/\d+(?:\.\d+)?" + RIGHT, "num:fraction")),
        F.transform(_all(text, LEFT + r"\d+(?:\.\d+)?" + RIGHT), lambda m: F.concat(F.lit("num:"), m)),
        *_if(text.contains("("), _named(low, r"sqrt\s*\([^)]*\)", "expr:sqrt")),
        *_if(text.contains("|"), _named(text, r"\|[^|]+\|", "expr:abs")),
        *(_prefixed(text, "[" + "".join("\\" + c for c in chars) + "]", kind) for kind, chars in SYMBOL_KINDS.items()),
        F.transform(_all(text, LEFT + r"[a-zA-Z](?:_[a-zA-Z0-9]+|\^\{?[a-zA-Z0-9-]+\}?)*" + EDGE), lambda m: F.concat(F.lit("var:"), F.lower(m))),
        F.transform(_all(text, "[α-ωΑ-Ω]"), lambda m: F.concat(F.lit("greek:"), F.lower(m))),
        _prefixed(low, LEFT + f"(?:{ascii_words})" + RIGHT, "kw"),
        *_if(text.rlike("[가-힣]"), *(_named(low, w, f"kw:{w}") for w in MATH_WORDS if not w.isascii())),
    ]
    return F.concat(*parts)


def step_signature(title: Column, body: Column) -> Column:
    """The title twice, then the body; an untitled step's title is its first ten words."""
    base = F.when(title != "", title).otherwise(F.array_join(F.slice(F.split(body, " "), 1, 10), " "))
    return F.concat(base, F.lit("\n"), base, F.lit("\n"), body)


def normalize_answer(answer: Column) -> Column:
    """Key under which equal answers meet: lower case, letters, digits and . - + / only."""
    return F.trim(F.regexp_replace(F.regexp_replace(F.lower(answer), f"{WS}+", " "), r"[^\p{L}\p{N}.\-+/]", ""))


def normalize_for_match(text: Column) -> Column:
    return F.regexp_replace(F.lower(text), rf"{WS}+|\\", "")


def strip_answer_decorations(answer: Column) -> Column:
    """Without surrounding quotes and one surrounding \\boxed{}."""
    bare = trim_ws(F.regexp_replace(trim_ws(answer), "^[\"'`]+|[\"'`]+$", ""))
    boxed = F.regexp_extract(bare, r"^\\boxed\{(.+)\}$", 1)
    return F.when(boxed != "", trim_ws(boxed)).otherwise(bare)


def option_value(text: Column) -> Column:
    """An option's value as it is compared: fractions as a/b, no wrappers, spaces or closing punctuation."""
    v = F.regexp_replace(text, r"\\frac\{([^{}]+)\}\{([^{}]+)\}", "$1/$2")
    v = F.regexp_replace(v, r"\\\(|\\\)", "")
    v = F.regexp_replace(v, r"[{}\\]", "")
    return F.lower(F.regexp_replace(F.regexp_replace(v, f"{WS}+", ""), "[.,;:]+$", ""))


def option_labels(text: Column) -> Column:
    return F.array_distinct(F.regexp_extract_all(text, F.lit(r"(?:^|[\s|])([A-D])\s*[).:]\s*"), F.lit(1)))


def is_multiple_choice(text: Column) -> Column:
    phrase = r"(?i)(?<![A-Za-z0-9_])which\s+(?:of\s+the\s+following|equation|expression|function|graph|table|statement)(?![A-Za-z0-9_])"
    return (F.size(option_labels(text)) >= 2) | text.rlike(phrase)


def option_values(text: Column) -> Column:
    """array<struct<label, value>> in order; where a label repeats its last value counts (see final_answer)."""
    rule = r"(?:^|[\n\r|])\s*([A-D])\s*[).:]\s*([\s\S]*?)(?=(?:[\n\r|]\s*[A-D]\s*[).:])|$)"
    part = lambda k: F.regexp_extract_all(text, F.lit(rule), F.lit(k))
    pairs = F.zip_with(part(1), part(2), lambda a, v: F.struct(a.alias("label"), option_value(v).alias("value")))
    return F.filter(pairs, lambda p: p["value"] != "")


def final_answer(answer: Column, is_sat: Column, problem_text: Column) -> Column:
    """The answer that counts: for SAT problems an option's letter where one is meant."""
    text = F.coalesce(problem_text, F.lit(""))

    def chosen(x: Column) -> Column:
        raw, values = x["raw"], x["values"]
        letter = F.upper(F.regexp_extract(raw, r"(?i)^(?:option|choice|answer)?\s*([A-D])\s*[).:]?$", 1))
        index = F.regexp_extract(raw, r"(?i)^(?:(?:option|choice|answer)\s*)?([1-4])\s*[).:]?$", 1)
        # Of a label's values only the last counts; the first label, in order of appearance, that has the value wins.
        own = F.filter(values, lambda p: p["value"] == x["value"])
        last = F.filter(own, lambda p: F.element_at(F.filter(values, lambda q: q["label"] == p["label"]), -1)["value"] == p["value"])
        return (
            F.when((raw == "") | ~is_sat, raw)
            .when(letter != "", letter)
            .when((index != "") & (x["has"] | raw.rlike("(?i)option|choice|answer")), F.translate(index, "1234", "ABCD"))
            .when(x["has"] & (F.size(last) > 0), F.try_element_at(last, F.lit(1))["label"])
            .otherwise(raw)
        )

    raw = strip_answer_decorations(answer)
    return let(F.struct(raw.alias("raw"), option_value(raw).alias("value"), is_multiple_choice(text).alias("has"), F.when(F.coalesce(is_sat, F.lit(True)), option_values(text)).alias("values")), chosen)


def slug(text: Column) -> Column:
    # Each step reads the one before it once; a run of marks is tried at its beginning only, so long ones cost no more.
    s = F.regexp_replace(text, "[^A-Za-z0-9._-]+", "_")
    s = F.regexp_replace(s, r"^[._-]++|(?<![._-])[._-]++$", "")
    return F.regexp_replace(s, "^$", "unknown")


def one_line(text: Column) -> Column:
    return F.trim(F.regexp_replace(F.coalesce(text, F.lit("")), r"\r\n|\r|\n", " "))


def html_escape(text: Column) -> Column:
    return reduce(lambda c, p: F.replace(c, F.lit(p[0]), F.lit(p[1])), (("&", "&amp;"), ("<", "&lt;"), (">", "&gt;"), ('"', "&quot;"), ("'", "&#39;")), text)


def chunked(text: Column, size: int = 120) -> Column:
    """Pieces of `size` code points."""
    n = F.length(text)
    return F.when(n == 0, F.array().cast("array<string>")).otherwise(F.transform(F.sequence(F.lit(0), F.floor((n - 1) / size).cast("int")), lambda i: F.substring(text, i * size + 1, F.lit(size))))


def fnv1a(text: Column) -> Column:
    """32-bit FNV-1a over the code points of a text of the basic plane."""
    units = F.transform(F.filter(F.split(text, ""), lambda c: c != ""), lambda c: F.ascii(c).cast("long"))
    return F.aggregate(units, F.lit(2166136261).cast("long"), lambda h, c: (h.bitwiseXOR(c) * 16777619).bitwiseAND(0xFFFFFFFF))


def jitter(seed: Column, amount: float) -> Column:
    return ((fnv1a(seed) % 10000) / 10000.0 - 0.5) * amount


def strip_tags(raw: Column) -> Column:
    """Layout output without its adjacent type and box tags."""
    return trim_ws(F.regexp_replace(F.regexp_replace(raw, r"(?s)<\|ref\|>.*?<\|/ref\|>\s*<\|det\|>.*?<\|/det\|>", ""), r"\n{3,}", "\n\n"))


def truncated(text: Column, most: int = 72) -> Column:
    return F.when(F.length(text) > most, F.concat(F.trim(F.substring(text, 1, most)), F.lit("..."))).otherwise(text)


def display_answer(text: Column) -> Column:
    return F.coalesce(F.nullif(F.trim(text), F.lit("")), F.lit("—"))
