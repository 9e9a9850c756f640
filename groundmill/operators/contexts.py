"""Candidate documents of claims: labelling, selection by recipe, filling, hydration and backfill."""

from __future__ import annotations

from itertools import cycle

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from groundmill.functions.keyed import digest, uniform
from groundmill.functions.text import entities, keywords, negated, numbers, tokens
from groundmill.session import join_hot

# How many contexts of each label a profile has among twelve.
RECIPES = {
    "clean": {"support": 8, "decoy": 3, "conflict": 0, "irrelevant": 1},
    "mixed": {"support": 5, "decoy": 4, "conflict": 2, "irrelevant": 1},
    "toxic": {"support": 3, "decoy": 4, "conflict": 4, "irrelevant": 1},
}
LABELS = ("support", "decoy", "conflict", "irrelevant")


def claim_features(claim: Column) -> Column:
    """What labelling needs of a claim, worked out once."""
    return F.struct(keywords(claim).alias("keywords"), entities(claim).alias("entities"), numbers(claim).alias("numbers"))


def text_features(text: Column) -> Column:
    """What labelling needs of a document, worked out once: less than its text, so joins carry this."""
    return F.struct(F.array_distinct(tokens(text)).alias("tokens"), entities(text).alias("entities"), numbers(text).alias("numbers"), negated(text).alias("negated"))


def label_of(claim: Column, text: Column) -> Column:
    """support, conflict, decoy or irrelevant, from the features of a claim and of a text.

    Two shared keywords and a shared entity or number make it bear on the claim; it contradicts if it denies something
    or has numbers of which none is the claim's.
    """
    shared = F.size(F.array_intersect(claim["keywords"], text["tokens"])) >= 2
    figure = F.arrays_overlap(claim["numbers"], text["numbers"])
    bears = shared & (F.arrays_overlap(claim["entities"], text["entities"]) | figure)
    other_figures = (F.size(claim["numbers"]) > 0) & (F.size(text["numbers"]) > 0) & ~figure
    return F.when(bears & (text["negated"] | other_figures), "conflict").when(bears, "support").when(shared, "decoy").otherwise("irrelevant")


def label(claim: Column, text: Column) -> Column:
    """The label of a claim and a text in one row; see :func:`label_of` for many pairs of few claims and texts."""
    return label_of(claim_features(claim), text_features(text))


def scaled_recipe(profile: str, k: int) -> dict[str, int]:
    """A profile's recipe for ``k`` contexts.

    Each quota is its share of k, halves to the even number. What is missing is support's; of what is too much, one at a
    time is given up by irrelevant, decoy, conflict and support in turn. A recipe of nothing is all irrelevant.
    """
    quotas = {name: round(n * k / 12) for name, n in RECIPES[profile].items()}
    if not any(quotas.values()):
        return {**quotas, "irrelevant": k}
    quotas["support"] += max(k - sum(quotas.values()), 0)
    givers = cycle(("irrelevant", "decoy", "conflict", "support"))
    while sum(quotas.values()) > k:
        giver = next(name for name in givers if quotas[name])
        quotas[giver] -= 1
    return quotas


def parse_schedule(schedule: str) -> list[tuple[str, float]]:
    """``name:weight,...``: profiles with positive weights, which are made to add up to 1."""
    parts = [p.partition(":") for p in schedule.split(",") if p.strip()]
    pairs = [(name.strip(), float(weight or 1)) for name, _, weight in parts]
    if unknown := [name for name, _ in pairs if name not in RECIPES]:
        raise ValueError(f"unknown profile: {unknown[0]}")
    pairs = [(name, weight) for name, weight in pairs if weight > 0]
    if not pairs:
        raise ValueError("no profile has a positive weight")
    total = sum(w for _, w in pairs)
    return [(name, w / total) for name, w in pairs]


def choose_profile(schedule: list[tuple[str, float]], seed: int, key: Column) -> Column:
    """The profile drawn for a key."""
    draw, upto = uniform(seed, key), 0.0
    out = F.lit(schedule[-1][0])
    steps = []
    for name, weight in schedule[:-1]:
        upto += weight
        steps.append((upto, name))
    for edge, name in reversed(steps):
        out = F.when(draw <= F.lit(edge), name).otherwise(out)
    return out


def select_contexts(candidates: DataFrame, k: int, seed: int) -> DataFrame:
    """k contexts of each claim that has candidates: claim_id, position, doc_id, rank, label, drawn.

    ``candidates``: claim_id, doc_id, rank, label, mix_profile, one row per claim and document. Quotas by label come
    first, then any others, then repeats. Irrelevant ones come from the last two fifths of the ranking if any are there.
    """
    claim = Window.partitionBy("claim_id")
    place = Window.partitionBy("claim_id").orderBy("rank", "doc_id")
    quota = F.coalesce(*(F.when((F.col("mix_profile") == p) & (F.col("label") == name), n) for p in RECIPES for name, n in scaled_recipe(p, k).items()), F.lit(0))
    seen = candidates.withColumn("n", F.count("*").over(claim)).withColumn("place", F.row_number().over(place))
    tail = (F.col("label") == "irrelevant") & (F.col("place") > F.floor(F.col("n") * 0.6))
    seen = seen.withColumn("tail", tail).withColumn("has_tail", F.max("tail").over(claim))
    seen = seen.withColumn("eligible", (F.col("label") != "irrelevant") | ~F.col("has_tail") | F.col("tail")).withColumn("draw", digest(seed, F.col("claim_id"), F.col("doc_id"), F.col("rank")))
    turn = F.row_number().over(Window.partitionBy("claim_id", "label", "eligible").orderBy("draw"))
    seen = seen.withColumn("picked", F.col("eligible") & (turn <= quota)).withColumn("n_picked", F.count_if("picked").over(claim))
    later = F.row_number().over(Window.partitionBy("claim_id", "picked").orderBy(digest(seed + 1, F.col("claim_id"), F.col("doc_id"), F.col("rank"))))
    seen = seen.withColumn("drawn", F.when(F.col("picked"), "quota").when(later <= F.lit(k) - F.col("n_picked"), "fill"))
    first = seen.where("drawn is not null").select("claim_id", "doc_id", "rank", "label", "drawn", F.lit(0).alias("turn"))
    short = seen.groupBy("claim_id").agg(F.first("n").alias("n"), F.count("drawn").alias("have")).where(F.col("have") < k)
    again = short.select("claim_id", "n", F.explode(F.sequence(F.lit(1), F.lit(k) - F.col("have").cast("int"))).alias("turn"))
    again = again.withColumn("place", (F.floor(uniform(seed + 2, F.col("claim_id"), F.col("turn")) * F.col("n")) + 1).cast("int"))
    repeats = again.join(seen.select("claim_id", "place", "doc_id", "rank", "label"), ["claim_id", "place"]).select("claim_id", "doc_id", "rank", "label", F.lit("repeat").alias("drawn"), "turn")
    order = Window.partitionBy("claim_id").orderBy("rank", "doc_id", "turn")
    return first.unionByName(repeats).withColumn("position", F.row_number().over(order)).where(F.col("position") <= k).select("claim_id", "position", "doc_id", "rank", "label", "drawn")


def sample_pool(corpus: DataFrame, id_col: str, seed: int, size: int) -> DataFrame:
    """A sample of ``size`` documents by the least keyed hash, numbered from 0: doc_id, ordinal."""
    least = corpus.select(F.col(id_col).alias("doc_id"), digest(seed, F.col(id_col)).alias("draw")).orderBy("draw", "doc_id").limit(size)
    return least.select("doc_id", (F.row_number().over(Window.orderBy("draw", "doc_id")) - 1).alias("ordinal"))


def backfill(claims: DataFrame, candidates: DataFrame, pool: DataFrame, pool_size: int, k: int, seed: int) -> DataFrame:
    """k irrelevant contexts from the pool for each claim without candidates: claim_id, position, doc_id.

    The pool is cut into k parts of about the same size, and a claim draws one of each: k different documents, each draw
    by itself, by a join on the place and not on all pairs. A pool of fewer than k is repeated.
    """
    bare = claims.select("claim_id").join(candidates.select("claim_id").distinct(), "claim_id", "left_anti")
    places = bare.select("claim_id", F.explode(F.sequence(F.lit(1), F.lit(k))).alias("position"))
    low, high = (F.floor((F.col("position") - 1 + i) * F.lit(pool_size / k)) for i in (0, 1))
    drawn = F.floor(uniform(seed, F.col("claim_id"), F.col("position")) * F.greatest(high - low, F.lit(1)))
    return places.withColumn("ordinal", F.pmod(low + drawn, F.lit(pool_size)).cast("int")).join(pool, "ordinal").select("claim_id", "position", "doc_id")


def hydrate(contexts: DataFrame, lookup: DataFrame) -> DataFrame:
    """Contexts with title and text of the lookup where it has the document, as a pair; missing_doc where not.

    ``contexts``: doc_id, title, text and others, cheap to read again; ``lookup``: doc_id, title, text, one row per id.
    A document that much of the contexts have is joined by broadcast.
    """
    counts = contexts.groupBy("doc_id").agg(F.count("*").alias("__n"))
    known = lookup.join(counts, "doc_id").select("doc_id", F.struct("title", "text").alias("__known"), "__n")
    keep = [c for c in contexts.columns if c not in ("title", "text")]
    joined = join_hot(contexts, known, "doc_id", "__n", contexts.count())
    hit = F.col("__known").isNotNull()
    return joined.select(*keep, F.when(hit, F.coalesce(F.col("__known.title"), F.lit(""))).otherwise(F.col("title")).alias("title"), F.when(hit, F.coalesce(F.col("__known.text"), F.lit(""))).otherwise(F.col("text")).alias("text"), (~hit).alias("missing_doc"))
