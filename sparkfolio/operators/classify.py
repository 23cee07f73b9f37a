"""Exam type of a page by rules over its header text and shape."""

from __future__ import annotations

from pyspark.sql import Column
from pyspark.sql import functions as F

# Words of the two exams' headers, the least share of Hangul, the page shapes.
CSAT_WORDS = ("지선다형", "단답형", "서답형", "수학 영역", "수학영역", "홀수형", "짝수형", "제 ", "교시")
SAT_WORDS = ("Module", "CONTINUE", "Unauthorized copying", "reuse of any part", "is illegal")
HANGUL_SHARE, SAT_ASPECT, CSAT_ASPECT = 0.08, 0.74, 0.72


def hangul_share(text: Column) -> Column:
    bare = F.regexp_replace(text, r"\s+", "")
    n = F.length(bare)
    return F.when(n == 0, 0.0).otherwise((n - F.length(F.regexp_replace(bare, "[가-힣ᄀ-ᇿ㄰-㆏]", ""))) / n)


def by_rules(text: Column, aspect: Column, otherwise: str = "csat", csat_words=CSAT_WORDS, sat_words=SAT_WORDS) -> Column:
    """struct(label, confidence): Korean words or letters, then English words, then the shape, then `otherwise`."""
    has = lambda words, t: F.greatest(*[t.contains(w).cast("int") for w in words]) == 1
    share, low = hangul_share(text), F.lower(text)
    say = lambda label, c: F.struct(F.lit(label).alias("label"), c.cast("double").alias("confidence"))
    return (
        F.when(has(csat_words, text), say("csat", F.lit(0.9)))
        .when(share >= HANGUL_SHARE, say("csat", 0.5 + F.least(F.lit(0.4), share)))
        .when(has([w.lower() for w in sat_words], low), say("sat", F.lit(0.9)))
        .when(aspect >= SAT_ASPECT, say("sat", F.lit(0.7)))
        .when((aspect > 0) & (aspect <= CSAT_ASPECT), say("csat", F.lit(0.7)))
        .otherwise(say(otherwise, F.lit(0.5)))
    )


def routed(method: str, rules: Column, model: Column, threshold: float = 0.8, otherwise: str = "csat") -> Column:
    """Label by method: heuristic, cnn, model_first (the model's from `threshold` on) or hybrid (rules from 0.6 on). model may be null."""
    if method == "cnn":
        return F.coalesce(model["label"], F.lit(otherwise))
    if method == "model_first":
        return F.when(model["confidence"] >= threshold, model["label"]).otherwise(rules["label"])
    if method == "hybrid":
        return F.when(rules["confidence"] >= 0.6, rules["label"]).otherwise(F.coalesce(model["label"], F.lit(otherwise)))
    return rules["label"]
