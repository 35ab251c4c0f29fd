"""A mix of sources by target shares of tokens, with capped repetition (problem 8).

Shares are set by temperature: token shares of the sources, or what the sources can supply against
given weights, are exponentiated and normalised, and the exponent is bisected to meet a target
entropy or the repetition limits.  A source's share of the budget is then realised as whole passes over its documents and one
partial pass: documents are permuted by hash into blocks, whole blocks are taken while they fit,
and the block at the edge of the budget is filled document by document.  Only that block, whose
size is bounded, is looked at in order; nothing sorts or collects a source.
"""

from __future__ import annotations

import math
from dataclasses import dataclass

import pandas as pd
from pyspark.sql import Column, DataFrame
from pyspark.sql import Window as W
from pyspark.sql import functions as F

from pixelloom.llm.bpe import token_counts
from pixelloom.session import Staging, staging

#: Documents in a block.
BLOCK_DOCS = 2_000


def folded_source(c: Column) -> Column:
    """Sources compare in lower case without surrounding white space."""
    return F.lower(F.regexp_replace(c, r"^[\s 　]+|[\s 　]+$", ""))


def entropy(weights: list[float]) -> float:
    return -sum(w * math.log(w) for w in weights if w > 0)


def tempered(shares: dict[str, float], exponent: float) -> dict[str, float]:
    """Shares raised to an exponent and normalised; sources without a share keep none."""
    top = max((s for s in shares.values() if s > 0), default=1.0)
    raw = {k: (s / top) ** exponent if s > 0 else 0.0 for k, s in shares.items()}
    total = sum(raw.values()) or 1.0
    return {k: v / total for k, v in raw.items()}


def bisect(falls: callable, low: float, high: float, rounds: int = 60) -> float:
    """The least exponent from ``low`` to ``high`` for which a monotone condition holds."""
    if falls(low):
        return low
    for _ in range(rounds):
        mid = (low + high) / 2
        low, high = (low, mid) if falls(mid) else (mid, high)
    return high


def temperature(shares: dict[str, float], target_entropy: float | None = None, limits: dict[str, float] | None = None) -> float:
    """The least exponent from 0 (even shares) to 1 (natural shares) whose weights have at most the
    target entropy and, for every source, a weight of at most its limit (its repeats times its
    tokens over the budget).  1 if only that, or nothing, meets both."""

    def holds(x: float) -> bool:
        w = tempered(shares, x)
        calm = target_entropy is None or entropy(list(w.values())) <= target_entropy + 1e-12
        return calm and all(w[k] <= limits[k] + 1e-12 for k in w) if limits else calm

    return bisect(holds, 0.0, 1.0)


@dataclass
class SourcePlan:
    source: str
    weight: float
    docs: int
    tokens: int
    max_repeats: int
    budget: int = 0
    exponent: float = 1.0
    limiting: bool = False

    @property
    def passes(self) -> int:
        return self.budget // self.tokens if self.tokens else 0

    @property
    def rest(self) -> int:
        return self.budget - self.passes * self.tokens

    @property
    def blocks(self) -> int:
        return max(1, -(-self.docs // BLOCK_DOCS))


def towards(weight: dict[str, float], supply: dict[str, float], exponent: float) -> dict[str, float]:
    """Shares of what the sources can supply, each drawn to its target by an exponent: at 0 the sources
    are used in proportion to their tokens and repeats, at 1 the shares are the target weights."""
    most = sum(supply.values())
    return tempered({s: (supply[s] / most) * ((weight[s] * most) / supply[s]) ** exponent for s in supply}, 1.0)


def budgets(plans: list[SourcePlan], total: int | None = None) -> list[SourcePlan]:
    """Token budgets at the bisected exponent: the one nearest to the target weights (1) at which no
    source of a mix of ``total`` tokens exceeds its repeats.

    Without ``total`` the mix is as large as the target weights allow, which the source that runs out
    first sets (``limiting``).  A total beyond all supply is cut to it, and takes the exponent to 0.
    Sources without tokens, weight or repeats have no budget."""
    can = [p for p in plans if p.weight > 0 and p.tokens > 0 and p.max_repeats > 0]
    if not can:
        return plans
    weight = tempered({p.source: p.weight for p in can}, 1.0)
    supply = {p.source: p.max_repeats * p.tokens for p in can}
    size = min(supply[s] / weight[s] for s in supply) if total is None else min(total, sum(supply.values()))
    within = lambda away: all(w * size <= supply[s] * (1 + 1e-9) for s, w in towards(weight, supply, 1 - away).items())
    exponent = 1 - bisect(within, 0.0, 1.0)
    share = towards(weight, supply, exponent)
    first = min(share, key=lambda s: (supply[s] / share[s], s))
    for p in can:
        p.budget, p.exponent, p.limiting = min(int(share[p.source] * size + 1e-6), supply[p.source]), exponent, p.source == first
    return plans


def supply_of(counted: DataFrame, targets: DataFrame) -> list[SourcePlan]:
    """Documents and tokens of each target's source.  Targets that fold to one source add their
    weights and keep the smaller repeat; a NULL, NaN or negative weight or repeat counts as 0.  Only the
    sources of the target table come to the driver."""
    t = targets.select(folded_source(F.col("source")).alias("source"), F.greatest(F.coalesce(F.nanvl("weight", F.lit(0.0)), F.lit(0.0)), F.lit(0.0)).alias("weight"), F.greatest(F.coalesce("max_repeats", F.lit(0)), F.lit(0)).alias("max_repeats"))
    t = t.filter("source is not null").groupBy("source").agg(F.sum("weight").alias("weight"), F.min("max_repeats").alias("max_repeats"))
    have = counted.groupBy("source").agg(F.count_if(F.col("n_tokens") > 0).alias("docs"), F.sum("n_tokens").alias("tokens"))
    rows = t.join(have, "source", "left").collect()
    return [SourcePlan(r["source"], r["weight"], r["docs"] or 0, r["tokens"] or 0, r["max_repeats"]) for r in sorted(rows, key=lambda r: r["source"])]


def count_sources(documents: DataFrame, area: Staging, **tokenizer: str) -> DataFrame:
    """(doc_id, source, n_tokens) of every document, written once: encoding is the costly part."""
    d = documents.select("doc_id", folded_source(F.col("source")).alias("source"), "text")
    return area.write(token_counts(d, ["doc_id", "source"], **tokenizer))


def realise(counted: DataFrame, plans: list[SourcePlan], seed: int = 0) -> DataFrame:
    """(doc_id, source, n_tokens, repeats): how often each document is used, those not used left out.

    Documents without tokens are never used.  A source's tokens differ from its budget by less than
    what the block at its edge leaves free, and never exceed it."""
    used = [p for p in plans if p.budget > 0]
    spark = counted.sparkSession
    shape = spark.createDataFrame(
        [(p.source, p.passes, p.rest, p.blocks) for p in used] or [("", 0, 0, 1)], "source string, passes bigint, rest bigint, blocks bigint"
    ).filter("source <> ''" if not used else "true")
    # One row for each target.
    docs = counted.filter("n_tokens > 0 and doc_id is not null").join(F.broadcast(shape), "source")
    docs = docs.withColumn("block", F.pmod(F.xxhash64(F.lit(seed), "doc_id"), F.col("blocks")))
    sums = docs.groupBy("source", "block", "rest").agg(F.sum("n_tokens").alias("tokens"))
    # One row for each BLOCK_DOCS documents of a source.
    up_to = F.sum("tokens").over(W.partitionBy("source").orderBy("block"))
    sums = sums.withColumn("_to", up_to).select("source", "block", (F.col("_to") <= F.col("rest")).alias("whole"), (F.col("rest") - F.col("_to") + F.col("tokens")).alias("free"))
    edge = sums.filter("not whole").groupBy("source").agg(F.min("block").alias("block"), F.min_by("free", "block").alias("free"))

    def fill(pdf: pd.DataFrame) -> pd.DataFrame:
        free, taken = int(pdf["free"].iloc[0]), []
        for n in (pdf := pdf.sort_values(["order", "doc_id"]))["n_tokens"]:
            taken.append(n <= free)
            free -= n if taken[-1] else 0
        return pdf.assign(extra=taken)[["doc_id", "source", "n_tokens", "passes", "extra"]]

    at_edge = docs.join(F.broadcast(edge), ["source", "block"]).withColumn("order", F.xxhash64(F.lit(seed + 1), "doc_id"))
    filled = at_edge.groupBy("source").applyInPandas(fill, "doc_id bigint, source string, n_tokens bigint, passes bigint, extra boolean")
    others = docs.join(F.broadcast(edge.select("source", F.col("block").alias("_edge"))), "source", "left").filter("_edge is null or block <> _edge")
    others = others.select("doc_id", "source", "n_tokens", "passes", F.coalesce(F.col("block") < F.col("_edge"), F.col("rest") > 0).alias("extra"))
    both = others.unionByName(filled)
    return both.select("doc_id", "source", "n_tokens", (F.col("passes") + F.col("extra").cast("bigint")).alias("repeats")).filter("repeats > 0")


def mix_plan(documents: DataFrame, targets: DataFrame, total: int | None = None, **tokenizer: str) -> tuple[DataFrame, DataFrame, list[SourcePlan]]:
    """The mix, the counted documents it was made from, and the plan of each target."""
    with staging(documents.sparkSession, "mix") as area:
        counted = count_sources(documents, area, **tokenizer)
        plans = budgets(supply_of(counted, targets), total)
        return realise(counted, plans), counted, plans


def mix(documents: DataFrame, targets: DataFrame, total: int | None = None, **tokenizer: str) -> DataFrame:
    """(doc_id, source, n_tokens, repeats) of the documents in the mix."""
    return mix_plan(documents, targets, total, **tokenizer)[0]


def shares(documents: DataFrame, targets: DataFrame, total: int | None = None, **tokenizer: str) -> DataFrame:
    """One row for each target: source, target_share, actual_share, tokens (available), used_tokens,
    used_docs, most_repeats, exponent (that the mix was made at; 1: the target weights) and limiting
    (whether this source's repeats bound the mix).  A target without documents has an actual share of
    0; the others keep their proportions to each other."""
    mixed, _, plans = mix_plan(documents, targets, total, **tokenizer)
    spark = documents.sparkSession
    want = spark.createDataFrame([(p.source, p.weight, p.tokens, p.exponent, p.limiting) for p in plans], "source string, target_share double, tokens bigint, exponent double, limiting boolean")
    got = mixed.groupBy("source").agg(F.sum(F.col("n_tokens") * F.col("repeats")).alias("used_tokens"), F.count("*").alias("used_docs"), F.max("repeats").alias("most_repeats"))
    zero = lambda c: F.coalesce(c, F.lit(0).cast("bigint")).alias(c)
    out = want.join(F.broadcast(got), "source", "left").select("source", "target_share", "tokens", "exponent", "limiting", zero("used_tokens"), zero("used_docs"), zero("most_repeats"))
    # One row for each target, so one partition.
    return out.withColumn("actual_share", F.coalesce(F.col("used_tokens") / F.sum("used_tokens").over(W.partitionBy(F.lit(0))), F.lit(0.0)))


def tempered_shares(documents: DataFrame, targets: DataFrame, **tokenizer: str) -> DataFrame:
    """(source, tokens, natural_share, exponent, weight): shares of the target table's sources at the
    temperature that gives them the entropy of the target weights, within each source's repeats for a
    mix as large as the sources together."""
    with staging(documents.sparkSession, "temperature") as area:
        plans = supply_of(count_sources(documents, area, **tokenizer), targets)
    have = [p for p in plans if p.tokens > 0]
    total = sum(p.tokens for p in have) or 1
    natural = {p.source: p.tokens / total for p in have}
    wanted = tempered({p.source: p.weight for p in have}, 1.0)
    exponent = temperature(natural, entropy(list(wanted.values())), {p.source: p.max_repeats * p.tokens / total for p in have}) if have else 1.0
    weight = tempered(natural, exponent)
    return documents.sparkSession.createDataFrame([(p.source, p.tokens, natural[p.source], exponent, weight[p.source]) for p in have], "source string, tokens bigint, natural_share double, exponent double, weight double")
