"""Mixing sources to target weights, with capped repetition.

A source with T tokens can give at most T * max_repeats. The tokens it gives to a mix of budget B are

    min(B * target * e^x, T * max_repeats)

with one exponent x for the mix, found by bisection so that the sum is B: sources within their limits keep their
target proportions, sources at their limit give all they may, and what they leave is spread over the others in
proportion to their targets. If all sources together cannot fill B, each gives its all and the mix is smaller.
With ``by="temperature"`` the weights are those of the method's own kind: the sources' token shares to an exponent,
which is found by bisection so that their entropy is that of the targets, or the nearest that the repetition limits
allow. Entropy says how even a mix is, not which source gets which share, so targets named by source are met by it only
by chance; it is there for mixes that are asked to be even and no more.

A source's tokens are then realised as whole passes, each a permutation of the source, and one partial pass: the
source's documents are hashed into blocks, blocks are permuted by hash, whole blocks are taken while the budget lasts,
and the block at the border is taken document by document in hashed order. Running sums are over block totals (at most
``BLOCKS`` rows a source and mix) and over the documents of one border block, so no task ever holds a source.

Defined results: a missing source has no tokens and reaches share 0; a null source matches no target; empty texts have
0 tokens and are never drawn; targets of a mix are divided by their sum; repeated target rows count once. The partial
pass stops before the document that would exceed the budget, so a source falls short of it by less than one document.
"""

from __future__ import annotations

import math

from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

from quire.plans.session import small, written

BLOCKS = 4096
#: Documents a block is meant to hold at least, so that small sources have few blocks.
BLOCK_DOCUMENTS = 16


def bisect(f, low: float, high: float, steps: int = 200) -> float:
    """Where the growing f passes 0."""
    for _ in range(steps):
        mid = (low + high) / 2
        low, high = (mid, high) if f(mid) < 0 else (low, mid)
    return (low + high) / 2


def allot(targets: list[float], capacities: list[float], budget: float) -> list[float]:
    """Tokens that each source gives."""
    total = sum(t for t in targets if t > 0)
    shares = [max(t, 0.0) / total if total else 0.0 for t in targets]
    reachable = sum(c for t, c in zip(shares, capacities, strict=True) if t > 0)
    if reachable <= budget or not total:
        return [c if t > 0 else 0.0 for t, c in zip(shares, capacities, strict=True)]

    def given(x: float) -> list[float]:
        return [min(budget * t * math.exp(x), c) for t, c in zip(shares, capacities, strict=True)]

    return given(bisect(lambda x: sum(given(x)) - budget, 0.0, 600.0))


def temperature(tokens: list[float], budget: float, max_repeats: list[float], entropy: float) -> tuple[float, list[float]]:
    """(exponent, weights): token shares to the exponent, whose entropy (in nats) is the target's or, if that breaks a repetition limit, the nearest that keeps all. A smaller exponent is flatter."""
    total = sum(tokens)
    shares = [t / total for t in tokens if t > 0] if total else []
    limits = [t * r for t, r in zip(tokens, max_repeats, strict=True) if t > 0]
    if not shares:
        return 1.0, [0.0 for _ in tokens]

    def weights(a: float) -> list[float]:
        powers = [s**a for s in shares]
        return [p / sum(powers) for p in powers]

    def spread(a: float) -> float:
        return -sum(w * math.log(w) for w in weights(a) if w > 0)

    at = bisect(lambda a: entropy - spread(a), 0.0, 8.0)

    def over(a: float) -> float:
        return max(budget * w - most for w, most in zip(weights(a), limits, strict=True))

    if over(at) > 0 and over(1.0) <= 0:  # back towards the shares as they are
        far = bisect(lambda x: -over(at + (1 - at) * x), 0.0, 1.0)
        at += (1 - at) * far
    out = iter(weights(at))
    return at, [next(out) if t > 0 else 0.0 for t in tokens]


def tempered(targets: list[float], tokens: list[float], repeats: list[float], budget: float) -> list[float]:
    """Tokens that each source gives by temperature, no more than it has."""
    total = sum(t for t in targets if t > 0)
    entropy = -sum(t / total * math.log(t / total) for t in targets if t > 0) if total else 0.0
    own = [n if t > 0 else 0.0 for n, t in zip(tokens, targets, strict=True)]
    weights = temperature(own, budget, repeats, entropy)[1]
    return [min(budget * w, n * r) for w, n, r in zip(weights, own, repeats, strict=True)]


def _hash(*parts) -> F.Column:
    return F.xxhash64(*parts)


def plan(sized: DataFrame, targets: DataFrame, *, by: str = "targets") -> DataFrame:
    """mix_id, source, target_share, max_repeats, source_tokens, documents, planned, passes, rest: what each source is to give. One row a target; targets and source totals are small tables."""
    totals = sized.where("source is not null").groupBy("source").agg(F.sum("n_tokens").alias("source_tokens"), F.sum(F.when(F.col("n_tokens") > 0, 1).otherwise(0)).alias("documents"))
    everything = sized.agg(F.coalesce(F.sum("n_tokens"), F.lit(0)).alias("all_tokens"))
    rows = targets.select("mix_id", "source", "target_share", "max_repeats", "size_ratio").where("mix_id is not null and source is not null").dropDuplicates(["mix_id", "source"]).join(totals, "source", "left").crossJoin(F.broadcast(everything))

    def of_mix(pdf):
        pdf = pdf.sort_values("source").reset_index(drop=True)
        tokens = pdf["source_tokens"].fillna(0).astype(float)
        repeats = pdf["max_repeats"].fillna(1).clip(lower=0).astype(float)
        budget = float(pdf["size_ratio"].fillna(1).iloc[0]) * float(pdf["all_tokens"].iloc[0])
        shares = pdf["target_share"].fillna(0).tolist()
        planned = tempered(shares, tokens.tolist(), repeats.tolist(), budget) if by == "temperature" else allot(shares, (tokens * repeats).tolist(), budget)
        pdf["source_tokens"], pdf["documents"] = tokens.astype("int64"), pdf["documents"].fillna(0).astype("int64")
        pdf["budget"], pdf["planned"] = budget, [int(x) for x in planned]
        pdf["passes"] = [int(p // t) if t else 0 for p, t in zip(pdf["planned"], tokens, strict=True)]
        pdf["rest"] = pdf["planned"] - pdf["passes"] * pdf["source_tokens"]
        return pdf[["mix_id", "source", "target_share", "max_repeats", "source_tokens", "documents", "budget", "planned", "passes", "rest"]]

    return rows.groupBy("mix_id").applyInPandas(of_mix, "mix_id string, source string, target_share double, max_repeats int, source_tokens bigint, documents bigint, budget double, planned bigint, passes bigint, rest bigint")


def draw(sized: DataFrame, planned: DataFrame) -> DataFrame:
    """mix_id, source, doc_id, n_tokens, copies: how often each document is used. sized: doc_id, source, n_tokens; planned: of plan(), a row a target, broadcast if there are at most session.SMALL_ROWS."""
    given = small(planned.where("planned > 0").select("mix_id", "source", "documents", "passes", "rest"))
    blocks = F.greatest(F.lit(1), F.least(F.lit(BLOCKS), F.floor(F.col("documents") / BLOCK_DOCUMENTS))).cast("int")
    rows = sized.where("n_tokens > 0 and source is not null").join(given, "source").select("mix_id", "source", "doc_id", "n_tokens", "passes", "rest", F.pmod(_hash("doc_id", "mix_id", F.lit(1)), blocks).cast("int").alias("block"))
    sums = rows.groupBy("mix_id", "source", "block").agg(F.sum("n_tokens").alias("block_tokens"), F.first("rest").alias("rest"))
    order = Window.partitionBy("mix_id", "source").orderBy(_hash("block", "mix_id", "source"), "block").rowsBetween(Window.unboundedPreceding, 0)
    run = sums.withColumn("to", F.sum("block_tokens").over(order)).withColumn("from", F.col("to") - F.col("block_tokens"))
    taken = run.where("from < rest").select("mix_id", "source", "block", F.least(F.col("block_tokens"), F.col("rest") - F.col("from")).alias("room"), (F.col("to") <= F.col("rest")).alias("whole"))
    marked = rows.join(taken, ["mix_id", "source", "block"], "left")
    within = Window.partitionBy("mix_id", "source", "block").orderBy(_hash("doc_id", "mix_id", F.lit(2)), "doc_id").rowsBetween(Window.unboundedPreceding, 0)
    border = marked.where("not whole").withColumn("part", F.sum("n_tokens").over(within) <= F.col("room"))
    rest = marked.where("whole is null or whole").withColumn("part", F.coalesce("whole", F.lit(False)))
    copies = (F.col("passes") + F.when(F.col("part"), 1).otherwise(0)).cast("bigint")
    return border.unionByName(rest).select("mix_id", "source", "doc_id", "n_tokens", copies.alias("copies")).where("copies > 0")


def report(drawn: DataFrame, planned: DataFrame) -> DataFrame:
    """mix_id, source, target_share, reached_share, tokens, copies, most_repeats, max_repeats, at_limit of every target."""
    got = drawn.groupBy("mix_id", "source").agg(F.sum(F.col("n_tokens") * F.col("copies")).alias("tokens"), F.sum("copies").alias("copies"), F.max("copies").alias("most_repeats"))
    rows = planned.join(got, ["mix_id", "source"], "left").fillna(0, ["tokens", "copies", "most_repeats"])
    whole = F.sum("tokens").over(Window.partitionBy("mix_id"))
    return rows.select("mix_id", "source", "target_share", F.when(whole > 0, F.col("tokens") / whole).otherwise(0.0).alias("reached_share"), "tokens", "budget", "copies", "most_repeats", "max_repeats", (F.col("planned") >= F.col("source_tokens") * F.col("max_repeats")).alias("at_limit"))


def sized_documents(documents: DataFrame, encode) -> DataFrame:
    """doc_id, source, n_tokens of every row of documents, repeated ones too. encode: a function of a table and the name of a column to keep that gives doc_id, that column and n_tokens. Written once, since planning and drawing both read it."""
    return written(encode(documents.select("doc_id", "source", "text"), "source").select("doc_id", "source", "n_tokens"))
