"""Mixing sources to target weights: temperature by bisection, realised as budgeted block permutations."""

from __future__ import annotations

import math

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql import Window

from .common import WORD, Workspace, bounded_broadcast, table, text_of

#: Blocks that a source's documents are dealt to.
BLOCKS = 256
#: Most passes over one source for each pass over another, in the query and in the pipeline.
REPETITION = 1.5
STEPS = 40
SEED = 11


def source_key(column: str = "source") -> Column:
    """The source; null is a source of its own."""
    return F.coalesce(F.concat(F.lit("s"), F.col(column)), F.lit("null"))


def token_shares(docs: DataFrame) -> DataFrame:
    """key, block, tokens: words of each block of each source, over all rows."""
    tokens = F.regexp_count(text_of(), F.lit(WORD)).cast("long")
    return docs.select(source_key().alias("key"), block_of().alias("block"), tokens.alias("t")).groupBy("key", "block").agg(F.sum("t").alias("tokens"), F.count("*").alias("docs"))


def block_of() -> Column:
    return F.pmod(F.xxhash64(F.lit(SEED), "doc_id", "text"), F.lit(BLOCKS)).cast("int")


def exponent(sources: DataFrame, max_repetition: float | None = None, target_entropy: float | None = None) -> float:
    """The exponent in [0, 1] for the shares of sources (key, tokens); sources without tokens don't count.

    Weights are share ** exponent, normalised. With max_repetition r, the smallest exponent for which no source is
    passed over more than r times as often as another. With target_entropy e (a share of the entropy of equal
    weights), the largest exponent whose weights have at least that entropy. Both are monotone in the exponent and
    bisected; all exponents that bisection can meet in the next steps are tried in one pass.
    """
    low, high, levels = 0.0, 1.0, 5
    share = sources.where("tokens > 0").crossJoin(F.broadcast(sources.agg(F.sum("tokens").alias("all")))).select(F.ln(F.col("tokens") / F.col("all")).alias("l"))

    def fits(tried: list[float]) -> list[bool]:
        aggs = []
        for i, a in enumerate(tried):
            p = F.exp(F.col("l") * a)
            aggs += [F.sum(p).alias(f"z{i}"), F.sum(p * F.col("l") * a).alias(f"s{i}")]
        row = share.agg(F.count("*").alias("n"), F.min("l").alias("lo"), F.max("l").alias("hi"), *aggs).first()
        if not row.n:
            return [True] * len(tried)
        out = []
        for i, a in enumerate(tried):
            if max_repetition is not None:
                out.append((1 - a) * (row.hi - row.lo) <= math.log(max_repetition) + 1e-12)
            else:
                entropy = math.log(row[f"z{i}"]) - row[f"s{i}"] / row[f"z{i}"]
                out.append(entropy >= target_entropy * math.log(row.n) - 1e-12)
        return out

    smallest = max_repetition is not None
    ends = fits([0.0, 1.0])
    if ends[0 if smallest else 1]:
        return 0.0 if smallest else 1.0
    for _ in range(STEPS // levels):
        parts = 1 << levels
        tried = [low + (high - low) * i / parts for i in range(1, parts)]
        found = fits(tried)
        for _ in range(levels):
            middle = (low + high) / 2
            ok = found[min(range(len(tried)), key=lambda i: abs(tried[i] - middle))]
            if ok == smallest:
                high = middle
            else:
                low = middle
    return high if smallest else low


def block_plan(work: Workspace, docs: DataFrame, max_repetition: float | None = REPETITION, target_entropy: float | None = None, budget: int | None = None) -> DataFrame:
    """key, block, tokens, weight, epochs, and the passes of each block: an array of (epoch, rank).

    Weighted budgets add up to `budget` tokens; without one, to the least for which every source is passed over at
    least once, so that no document is lost. A source's last, partial pass takes blocks of a random permutation
    until the one that comes nearest to its budget; each pass has a permutation of its own.
    """
    blocks = work.write(token_shares(docs))
    sources = work.write(blocks.groupBy("key").agg(F.sum("tokens").alias("tokens"), F.count("*").alias("n_blocks")))
    alpha = exponent(sources, max_repetition, target_entropy)
    row = sources.where("tokens > 0").agg(F.sum(F.col("tokens").cast("double")).alias("all"), F.max(F.pow(F.col("tokens").cast("double"), F.lit(1 - alpha))).alias("most"), F.sum(F.pow(F.col("tokens").cast("double"), F.lit(alpha))).alias("z")).first()
    total = float(budget) if budget is not None else (row.most or 0.0) * (row.z or 0.0)
    weight = F.when(F.col("tokens") > 0, F.pow(F.col("tokens").cast("double"), F.lit(alpha)) / F.lit(row.z or 1.0)).otherwise(0.0)
    # a source without tokens has one pass: it costs nothing
    epochs = F.when(F.col("tokens") > 0, F.col("weight") * total / F.col("tokens")).otherwise(1.0)
    planned = work.write(sources.withColumn("weight", weight).withColumn("epochs", F.round(epochs, 9)))
    passes = planned.select("key", "n_blocks", "weight", "epochs", F.explode(F.sequence(F.lit(0), F.greatest(F.lit(0), F.ceil("epochs").cast("int") - 1))).alias("epoch"))
    order = Window.partitionBy("key", "epoch").orderBy(F.xxhash64(F.lit(SEED + 1), "key", "block", "epoch"), "block")
    whole = Window.partitionBy("key", "epoch")
    # at most BLOCKS rows for each source and pass
    ranked = blocks.join(passes, "key").withColumn("rank", F.row_number().over(order)).withColumn("before", F.sum("tokens").over(order) - F.col("tokens")).withColumn("all", F.sum("tokens").over(whole))
    room = F.least(F.lit(1.0), F.col("epochs") - F.col("epoch")) * F.col("all")
    taken = ranked.where((F.col("epochs") - F.col("epoch") >= 1) | (F.col("before") + F.col("tokens") / 2 < room))
    return taken.groupBy("key", "block", "tokens", "weight", "epochs", "n_blocks").agg(F.sort_array(F.collect_list(F.struct("epoch", "rank"))).alias("passes"))


def _with_plan(docs: DataFrame, **how) -> DataFrame:
    """docs with _parchmine columns for the plan of its block; a plan has few rows, at most BLOCKS for a source."""
    work = Workspace(docs.sparkSession, "mixing")
    plan = work.write(block_plan(work, docs, **how))
    few = bounded_broadcast(plan.select(*[F.col(c).alias(f"_parchmine_{c}") for c in plan.columns]), plan.count())
    return docs.join(few, (source_key() == F.col("_parchmine_key")) & (block_of() == F.col("_parchmine_block")), "left")


def mix(docs: DataFrame, max_repetition: float | None = REPETITION, target_entropy: float | None = None, budget: int | None = None) -> DataFrame:
    """Each row of docs (doc_id, text, source, ...) as often as its block is passed over; the columns of docs.

    A null source is a source of its own. Null texts have no words; a source of such rows is passed over once. Rows
    with equal doc_id and text are in one block. An empty table stays empty.
    """
    planned = _with_plan(docs, max_repetition=max_repetition, target_entropy=target_entropy, budget=budget)
    repeated = planned.select(*[F.col(f"`{c}`") for c in docs.columns], F.explode("_parchmine_passes").alias("_parchmine_pass"))
    return repeated.drop("_parchmine_pass")


def op1_mixing_temperature(spark: SparkSession, sf_dir: str) -> DataFrame:
    """One row for each pass over a document: doc_id, source, n_words, weight, epochs of its source, epoch, block, block_rank and position.

    Sorting by position gives the mixed order: sources are spread evenly over it, block by block.
    """
    docs = table(spark, sf_dir, "documents").select("doc_id", "text", "source")
    planned = _with_plan(docs, max_repetition=REPETITION)
    words = F.regexp_count(text_of(), F.lit(WORD)).cast("long")
    rows = planned.select(
        "doc_id", "source", words.alias("n_words"), F.col("_parchmine_weight").alias("weight"), F.col("_parchmine_epochs").alias("epochs"), F.col("_parchmine_block").alias("block"), F.col("_parchmine_n_blocks").alias("n"), F.inline("_parchmine_passes")
    )
    place = (F.col("epoch") + (F.col("rank") - 0.5) / F.col("n")) / F.greatest("epochs", F.lit(1e-9))
    return rows.select("doc_id", "source", "n_words", F.round("weight", 9).alias("weight"), "epochs", "epoch", "block", F.col("rank").alias("block_rank"), F.round(place, 9).alias("position"))
