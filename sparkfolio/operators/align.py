"""Alignment of the solvers' steps: features, pair scores, mutual best edges, components and their labels.

Steps are (problem, solver, idx, title, body); everything happens within a problem, which is the key of every shuffle.
Pairs only arise between solvers of one problem, dot products through shared tokens. Steps are dealt by problem once; tokens, their
counts, vectors and pairs are made where the steps lie.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from ..functions import text as T
from . import contraction

# Weights of the features in a pair's score, the penalty for distance and the least score of an edge.
WEIGHTS = {"title": 0.3, "body": 0.3, "math": 0.2, "chars": 0.1}
PENALTY, THRESHOLD, TOP, EMBEDDING_WEIGHT = 0.05, 0.35, 2, 0.1

STEP = ["problem", "solver", "idx"]
#: The kind of the one token that every step has.
MET = "met"


def features(steps: DataFrame, *kinds: str) -> DataFrame:
    """(problem, solver, idx, kind, token, tf, total, n, own): how often a step has each token of each kind, and the steps of its problem and of
    its solver there; the steps are read once, and dealt by problem before their texts are taken apart.
    """
    title = F.when(F.col("title") != "", F.col("title")).otherwise(F.col("body"))
    tokens = {
        "title": lambda: T.tokens(title),
        "body": lambda: T.tokens(F.col("body")),
        "math": lambda: T.math_tokens(T.step_signature(F.col("title"), F.col("body"))),
        "chars": lambda: T.char_ngrams(title),
        MET: lambda: F.array(F.lit("")),
    }
    size = lambda *keys: F.count(F.lit(1)).over(Window.partitionBy(*keys))
    dealt = steps.where("problem is not null").withColumn("own", size("problem", "solver")).withColumn("n", size("problem"))
    sets = F.array(*[F.struct(F.lit(k).alias("kind"), tokens[k]().alias("all")) for k in kinds])
    rows = dealt.select(*STEP, "n", "own", F.explode(sets).alias("s")).select(*STEP, "n", "own", "s.kind", F.size("s.all").alias("total"), F.explode("s.all").alias("token"))
    return rows.groupBy(*STEP, "kind", "token").agg(F.count(F.lit(1)).alias("tf"), *(F.first(c).alias(c) for c in ("total", "n", "own")))


def vectors(steps: DataFrame, *kinds: str) -> DataFrame:
    """(problem, solver, idx, kind, token, weight, tf, df, own): unit TF-IDF vectors of each kind (characters: unit count vectors); df: steps
    of the problem that have the token. After the steps are dealt nothing is shuffled.
    """
    rows = features(steps, *kinds).withColumn("df", F.count(F.lit(1)).over(Window.partitionBy("problem", "kind", "token")))
    idf = F.ln((F.col("n") + 1) / (F.col("df") + 1)) + 1
    raw = F.when(F.col("kind") == "chars", F.col("tf").cast("double")).otherwise(F.col("tf") / F.col("total") * idf)
    rows = rows.withColumn("raw", raw)
    norm = F.sqrt(F.sum(F.col("raw") * F.col("raw")).over(Window.partitionBy(*STEP, "kind")))
    return rows.select(*STEP, "kind", "token", F.when(norm > 0, F.col("raw") / norm).otherwise(F.col("raw")).alias("weight"), "tf", "df", "own")


def weights(steps: DataFrame, kind: str) -> DataFrame:
    """vectors() of one kind, without it."""
    return vectors(steps, kind).select(*STEP, "token", "weight")


PAIR = ["problem", "s1", "i", "s2", "j"]


def compared(steps: DataFrame, *kinds: str) -> DataFrame:
    """All pairs of steps of two solvers of a problem, the smaller solver first: (PAIR, longest, and for each kind the dot product, between
    0 and 1). longest: steps of the solver that has more. Rows that repeat a step repeat its pairs.

    The steps that have a token are one list; a list is no longer than the square root of the pairs that it makes and that the
    result holds. All steps of a problem have the token of MET in common, so pairs without another one are there, too.
    """
    held = vectors(steps, *kinds, MET).where("df > 1").groupBy("problem", "kind", "token").agg(F.collect_list(F.struct("solver", "idx", "weight", "own", "tf")).alias("all"))
    each = held.select("problem", "kind", "all", F.explode("all").alias("x"))
    met = each.select("problem", "kind", "x", F.explode("all").alias("y")).where("x.solver < y.solver")
    of = lambda k, value: F.when(F.col("kind") == k, value)
    one = lambda k: F.greatest(F.lit(0.0), F.least(F.lit(1.0), F.coalesce(F.sum(of(k, F.col("x.weight") * F.col("y.weight"))), F.lit(0.0)))).alias(k)
    rows = met.groupBy("problem", F.col("x.solver").alias("s1"), F.col("x.idx").alias("i"), F.col("y.solver").alias("s2"), F.col("y.idx").alias("j"))
    found = rows.agg(F.max(of(MET, F.greatest("x.own", "y.own"))).alias("longest"), F.sum(of(MET, F.col("x.tf") * F.col("y.tf"))).alias("times"), *map(one, kinds))
    return found.withColumn("times", F.explode(F.sequence(F.lit(1).cast("long"), "times"))).drop("times")


def micro(x: Column) -> Column:
    """Millionths, so that the order of a sum cannot change an order or a comparison."""
    return F.floor(x * 1_000_000 + 0.5).cast("long")


def cosines(steps: DataFrame, kind: str = "body") -> DataFrame:
    return compared(steps, kind).select(*PAIR, F.col(kind).alias("cosine"))


def dot(x: Column, y: Column) -> Column:
    return F.aggregate(F.zip_with(x, y, lambda p, q: p.cast("double") * q.cast("double")), F.lit(0.0), lambda s, t: s + t)


def cosine(x: Column, y: Column) -> Column:
    """Between 0 and 1; 0 for vectors of different lengths or without length."""
    norm = F.sqrt(dot(x, x)) * F.sqrt(dot(y, y))
    return F.when((F.size(x) != F.size(y)) | (norm == 0), 0.0).otherwise(F.greatest(F.lit(0.0), F.least(F.lit(1.0), dot(x, y) / norm)))


def near_cosines(vectors: DataFrame, group: str, within: int) -> DataFrame:
    """vectors (vec_id, group, embedding) -> (v1, v2, cosine) of the pairs of a group whose ids differ by 1 to `within`.

    Ids fall into buckets as wide as that, and the smaller of a pair is put beside its own bucket and the next one, so a pair
    meets once and a vector meets two buckets, however large its group is.
    """
    bucket = F.expr(f"vec_id div {within}")
    low = vectors.select(F.col("vec_id").alias("v1"), F.col(group).alias("g"), F.col("embedding").alias("x"), F.explode(F.array(bucket, bucket + 1)).alias("bucket"))
    high = vectors.select(F.col("vec_id").alias("v2"), F.col(group).alias("g"), F.col("embedding").alias("y"), bucket.alias("bucket"))
    pairs = low.join(high, ["g", "bucket"]).where(F.col("v2") - F.col("v1") >= 1).where(F.col("v2") - F.col("v1") <= within)
    return pairs.select("v1", "v2", cosine(F.col("x"), F.col("y")).alias("cosine"))


def embedding_cosines(embedded: DataFrame) -> DataFrame:
    """embedded (problem, solver, idx, embedding) -> cosines between 0 and 1 of the pairs whose steps both have one."""
    a, b = embedded.alias("a"), embedded.alias("b")
    on = (F.col("a.problem") == F.col("b.problem")) & (F.col("a.solver") < F.col("b.solver"))
    return a.join(b, on).select("a.problem", F.col("a.solver").alias("s1"), F.col("a.idx").alias("i"), F.col("b.solver").alias("s2"), F.col("b.idx").alias("j"), cosine(F.col("a.embedding"), F.col("b.embedding")).alias("embedding"))


def scores(steps: DataFrame, embedded: DataFrame | None = None) -> DataFrame:
    """(problem, s1, i, s2, j, score): the weighted cosines, less a penalty for steps far apart, in millionths.

    embedded (problem, solver, idx, embedding) adds one more cosine to pairs whose steps both have a vector.
    """
    kinds = dict(WEIGHTS)
    out = compared(steps, *WEIGHTS)
    if embedded is not None:
        out, kinds["embedding"] = out.join(embedding_cosines(embedded), PAIR, "left"), EMBEDDING_WEIGHT
    total = sum(WEIGHTS.values()) + (F.when(F.col("embedding").isNotNull(), EMBEDDING_WEIGHT).otherwise(0.0) if embedded is not None else F.lit(0.0))
    out = out.withColumn("total", total)
    unit = lambda x: F.greatest(F.lit(0.0), F.least(F.lit(1.0), x))
    # The parts are rounded before they are weighted, so that any engine gets the same sum.
    for kind in kinds:
        out = out.withColumn(kind, micro(F.coalesce(kind, F.lit(0.0))) / 1_000_000.0)
    raw = sum((F.col(k) * w for k, w in kinds.items()), F.lit(0.0)) / F.col("total")
    far = F.abs(F.col("i") - F.col("j")) / F.greatest("longest", F.lit(1))
    return out.select(*PAIR, micro(unit(unit(raw) - PENALTY * far)).alias("score"))


def edges(scored: DataFrame, threshold: float = THRESHOLD, top: int = 1) -> DataFrame:
    """Pairs of at least the threshold that are among each other's `top` best, ties going to the smaller index."""
    row = Window.partitionBy("problem", "s1", "s2", "i").orderBy(F.desc("score"), "j")
    col = Window.partitionBy("problem", "s1", "s2", "j").orderBy(F.desc("score"), "i")
    ranked = scored.withColumns({"r": F.row_number().over(row), "c": F.row_number().over(col)})
    return ranked.where((F.col("score") >= micro(F.lit(threshold))) & (F.col("r") <= top) & (F.col("c") <= top)).select(*PAIR, "score")


def node(solver: str, idx: str) -> Column:
    """A step within its problem."""
    return F.struct(F.col(solver).alias("solver"), F.col(idx).alias("idx"))


def components(found: DataFrame) -> DataFrame:
    """(problem, node, component): the least step (solver, then idx) reachable within the problem."""
    return contraction.components(found.select("problem", node("s1", "i").alias("a"), node("s2", "j").alias("b")), ["problem"])


def members(found: DataFrame) -> DataFrame:
    """(problem, component, solver, idx, best): of each component and solver the step with the best edge inside it;
    components of two solvers at least.
    """
    ends = found.select("problem", "score", F.explode(F.array(node("s1", "i"), node("s2", "j"))).alias("node"))
    best = ends.groupBy("problem", "node").agg(F.max("score").alias("best")).join(components(found), ["problem", "node"])
    one = best.groupBy("problem", "component", F.col("node.solver").alias("solver")).agg(F.min(F.struct(-F.col("best"), "node.idx")).alias("one"))
    kept = one.select("problem", "component", "solver", "one.idx", (-F.col("one.col1")).alias("best"))
    return kept.withColumn("solvers", F.count(F.lit(1)).over(Window.partitionBy("problem", "component"))).where("solvers >= 2")


def labels(found: DataFrame, steps: DataFrame) -> DataFrame:
    """(problem, component, group_no, label, solvers): the two most frequent title tokens (first seen wins a tie);
    groups are numbered by size, then label (without case and accents first, by code points), then component.
    """
    titled = members(found).join(steps, ["problem", "solver", "idx"], "left")
    t = T.tokens(F.col("title"))
    words = F.when(F.size(t) > 0, t).otherwise(F.slice(T.tokens(F.col("body")), 1, 6))
    seen = titled.select("problem", "component", "solvers", "solver", "idx", F.posexplode_outer(words).alias("pos", "token"))
    freq = seen.groupBy("problem", "component", "token").agg(F.max("solvers").alias("solvers"), F.count(F.lit(1)).alias("n"), F.min(F.struct("solver", "idx", "pos")).alias("first"))
    # A member without words is a row without a token, which comes last and names nothing.
    rank = F.row_number().over(Window.partitionBy("problem", "component").orderBy(F.col("token").isNull(), F.desc("n"), "first"))
    two = F.collect_list(F.when((F.col("rank") <= 2) & F.col("token").isNotNull(), F.struct("rank", "token")))
    named = freq.withColumn("rank", rank).groupBy("problem", "component").agg(F.max("solvers").alias("solvers"), F.array_join(F.transform(F.array_sort(two), lambda x: x["token"]), " ").alias("label"))
    named = named.withColumn("label", F.when(F.col("label") != "", F.col("label")).otherwise("Step-Layer")).withColumn("plain", F.lower(T.without_accents("label")))
    number = F.row_number().over(Window.partitionBy("problem").orderBy(F.desc("solvers"), "plain", "label", "component"))
    return named.select("problem", "component", number.cast("long").alias("group_no"), "label", "solvers")
