"""Temperature mixing of sources.

A source with share p of all tokens gets a weight proportional to p ** alpha.  The exponent is
found between 0 and 1 by bisection: the largest with at least the target entropy, then, if some
source would be repeated more often than allowed, the least that keeps to the limit, since
repetition falls as the exponent grows.  One aggregation tries 63 exponents, which is six
bisection steps, so seven jobs make the exponent exact.

Weights times the budget give each source a number of tokens: whole passes over the source and
a rest.  For the rest, the documents of each source are dealt by a hash into as many blocks as the
square root of the number of all rows, and blocks are taken in a random order while their tokens fit; of the next block
documents are taken in the order of a hash while they fit.  What is then left is filled by the smallest
documents not drawn, so no document that is left would fit.  A source is thus never sorted, and no
task holds more than one block, or one row for each block or size of a source.

Only DataFrame and SQL functions are used.

Defined results: tokens are words `[^\\x20\\x09-\\x0D]+`; null or empty texts have no tokens and are
not drawn; a null source is a source of its own; rows with equal id and text are drawn together or not at all; a budget above the
repetition limit of all sources is met as far as the limit allows; an empty table gives an empty result.
"""

from __future__ import annotations

import math

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from seriesmill.llm.shared import cut

STEPS = 7
TRIED = 63
#: columns made here; the underscores keep them from the columns of a table
SOURCE, TOKENS, HASH, BLOCK = "__source", "__tokens", "__hash", "__block"


def word_count(text: Column) -> Column:
    """Words of a text."""
    spaces = " \t\n\x0b\x0c\r"
    bare = F.trim(text, F.lit(spaces))
    return F.when(F.length(bare) > 0, F.size(F.split(bare, "[ \\t-\\r]+"))).otherwise(0).cast("long")


def _search(shares: DataFrame, holds, low: float, high: float, from_above: bool) -> float:
    """Border between exponents for which `holds` is true and false, by 63 tries at a time.

    `from_above`: holds for the small exponents; else for the large ones.
    """
    for _ in range(STEPS):
        tries = [low + (high - low) * i / (TRIED + 1) for i in range(TRIED + 2)]
        grid = shares.withColumn("alpha", F.explode(F.array(*[F.lit(x) for x in tries])))
        good = grid.withColumn("w", F.pow("p", "alpha")).groupBy("alpha").agg(holds.alias("good"))
        # one row for each try
        answers = {r["alpha"]: bool(r["good"]) for r in good.collect()}
        known = [answers.get(x, False) for x in tries]
        if from_above:
            last = max((i for i, g in enumerate(known) if g), default=0)
            low, high = tries[last], tries[min(last + 1, TRIED + 1)]
        else:
            first = min((i for i, g in enumerate(known) if g), default=TRIED + 1)
            low, high = tries[max(first - 1, 0)], tries[first]
        if low == high:
            break
    return low if from_above else high


def temperature_weights(totals: DataFrame, budget: int, target_entropy: float | None, max_repeats: float | None) -> tuple[DataFrame, float]:
    """`__source`, `tokens`, `weight`, and the exponent, from `__source`, `tokens` above zero.

    `target_entropy` is the share of the largest possible entropy, log of the number of sources.
    """
    all_tokens, sources = totals.agg(F.sum("tokens"), F.count("*")).first()
    shares = totals.withColumn("p", F.col("tokens") / F.lit(float(all_tokens)))
    z, w = F.sum("w"), F.col("w")
    alpha = 1.0
    if target_entropy is not None and sources > 1:
        entropy = F.log(z) - F.sum(w * F.log("w")) / z
        alpha = _search(shares, entropy >= F.log(F.lit(float(sources))) * target_entropy, 0.0, 1.0, True)
    if max_repeats is not None:
        within = F.max(w * F.lit(float(budget)) / F.col("tokens")) <= z * max_repeats
        lowest = _search(shares, within, 0.0, 1.0, False)
        alpha = max(alpha, lowest) if target_entropy is not None else lowest
    total = shares.agg(F.sum(F.pow("p", F.lit(alpha)))).first()[0]
    return shares.select(SOURCE, "tokens", (F.pow("p", F.lit(alpha)) / F.lit(total)).alias("weight")), alpha


def _smallest(dealt: DataFrame, blocks: DataFrame, border: DataFrame, cuts: DataFrame) -> DataFrame:
    """What fills the rest of each source: its smallest documents not yet drawn, by size.

    For each block: all with fewer tokens than `below`, and of those with `at` tokens the ones up
    to the hash `upto`.  Sizes are counted first, and documents of the size at the border by
    block, so no document moves but those of one size in one block.
    """
    spent = border.join(cuts.select(SOURCE, BLOCK, "filled"), [SOURCE, BLOCK], "left").select(SOURCE, (F.col("left") - F.coalesce("filled", F.lit(0))).alias("open"))
    open_blocks = blocks.filter("NOT whole").select(SOURCE, BLOCK, "order").join(spent, SOURCE).join(cuts.select(SOURCE, BLOCK, "last"), [SOURCE, BLOCK], "left")
    fits = dealt.join(open_blocks, [SOURCE, BLOCK]).filter((F.col(TOKENS) <= F.col("open")) & (F.col("last").isNull() | (F.col(HASH) > F.col("last"))))
    counted = cut(fits.groupBy(SOURCE, "open", TOKENS, BLOCK, "order").agg(F.count("*").alias("n")))
    upward = Window.partitionBy(SOURCE).orderBy(TOKENS)
    sizes = counted.groupBy(SOURCE, "open", TOKENS).agg(F.sum("n").alias("n")).withColumn("until", F.sum(F.col("n") * F.col(TOKENS)).over(upward))
    # the first size that does not fit as a whole, and how many of it fit
    edge = sizes.filter(F.col("until") > F.col("open")).groupBy(SOURCE).agg(F.min(F.struct(TOKENS, "until", "n", "open")).alias("e"))
    edge = edge.select(SOURCE, F.col(f"e.{TOKENS}").alias(TOKENS), F.expr(f"floor((e.open - e.until + e.n * e.{TOKENS}) / e.{TOKENS})").alias("some"))
    in_order = Window.partitionBy(SOURCE).orderBy("order", BLOCK)
    parts = counted.join(edge, [SOURCE, TOKENS]).withColumn("until", F.sum("n").over(in_order))
    parts = parts.select(SOURCE, BLOCK, TOKENS, "until", "n", "some")
    last_block = parts.filter("until > some AND until - n < some").select(SOURCE, BLOCK, TOKENS, (F.col("some") - F.col("until") + F.col("n")).alias("few"))
    rows = fits.select(SOURCE, BLOCK, TOKENS, HASH).join(last_block, [SOURCE, BLOCK, TOKENS])
    ranked = rows.withColumn("r", F.count("*").over(Window.partitionBy(SOURCE, BLOCK).orderBy(HASH))).filter(F.col("r") <= F.col("few"))
    hashes = ranked.groupBy(SOURCE, BLOCK).agg(F.max(HASH).alias("upto"))
    whole = parts.filter("until <= some").select(SOURCE, BLOCK, F.lit(2**63 - 1).alias("upto"))
    chosen = open_blocks.select(SOURCE, BLOCK, "open").join(edge.select(SOURCE, F.col(TOKENS).alias("at")), SOURCE, "left").join(hashes.unionByName(whole), [SOURCE, BLOCK], "left")
    # a source whose rest holds all that fits has no edge
    return chosen.select(SOURCE, BLOCK, F.coalesce(F.col("at"), F.col("open") + 1).alias("below"), "at", "upto")


def realised(mixed: DataFrame, text_col: str = "text", source_col: str = "source") -> DataFrame:
    """For each source of a mix: `weight`, `wanted` tokens and those `drawn`."""
    return mixed.groupBy(source_col).agg(F.first("weight").alias("weight"), F.first("wanted").alias("wanted"), F.sum(word_count(F.col(text_col))).alias("drawn"))


def mix(
    docs: DataFrame,
    budget: int | None = None,
    target_entropy: float | None = 0.98,
    max_repeats: float | None = 4.0,
    seed: int = 1,
    id_col: str = "doc_id",
    text_col: str = "text",
    source_col: str = "source",
) -> DataFrame:
    """The rows of `docs` as often as the mix draws them.

    All columns stay; `pass` counts the draws of a row from 1, `place` orders a pass of a source
    by blocks, `weight` is that of the source and `wanted` its tokens.  `budget` is in tokens, by default all there are.
    """
    source = F.concat(F.when(F.col(source_col).isNull(), "0").otherwise("1"), F.coalesce(F.col(source_col).cast("string"), F.lit("")))
    marked = docs.withColumns(
        {SOURCE: source, TOKENS: word_count(F.col(text_col)), HASH: F.xxhash64(F.lit(seed), F.col(id_col), F.xxhash64(text_col))}
    ).filter(F.col(TOKENS) > 0)
    slim = cut(marked.select(SOURCE, TOKENS, HASH))
    totals = cut(slim.groupBy(SOURCE).agg(F.sum(TOKENS).alias("tokens"), F.count("*").alias("rows")))
    available, rows = totals.agg(F.sum("tokens"), F.sum("rows")).first()
    if available is None:
        extra = {"pass": F.lit(1), "place": F.lit(0).cast("long"), "weight": F.lit(0.0), "wanted": F.lit(0).cast("long")}
        return docs.filter(F.lit(False)).withColumns(extra)
    budget = available if budget is None else budget
    weights, _ = temperature_weights(totals.select(SOURCE, "tokens"), budget, target_entropy, max_repeats)
    wanted = F.col("weight") * F.lit(float(budget))
    if max_repeats is not None:
        wanted = F.least(wanted, F.col("tokens") * F.lit(max_repeats))
    quota = weights.withColumn("wanted", F.floor(wanted)).withColumn("passes", F.floor(F.col("wanted") / F.col("tokens")))
    quota = quota.select(SOURCE, "weight", "wanted", "passes", (F.col("wanted") - F.col("passes") * F.col("tokens")).alias("rest"))

    block = F.pmod(F.xxhash64(F.lit(seed + 1), HASH), F.lit(math.isqrt(rows) + 1))
    dealt = slim.withColumn(BLOCK, block)
    order = F.xxhash64(F.lit(seed), F.lit("block"), SOURCE, BLOCK)
    in_order = Window.partitionBy(SOURCE).orderBy("order", BLOCK)
    blocks = dealt.groupBy(SOURCE, BLOCK).agg(F.sum(TOKENS).alias("size")).withColumn("order", order)
    blocks = blocks.withColumn("until", F.sum("size").over(in_order)).join(quota, SOURCE)
    blocks = blocks.withColumn("whole", F.col("until") <= F.col("rest")).withColumn("left", F.col("rest") - (F.col("until") - F.col("size")))
    blocks = cut(blocks.select(SOURCE, BLOCK, "order", "weight", "wanted", "passes", "whole", "left", "size"))

    # of the block that fits in part, documents up to a hash
    border = blocks.filter("NOT whole AND left > 0").select(SOURCE, BLOCK, "left").groupBy(SOURCE).agg(F.min_by(BLOCK, F.struct(-F.col("left"), BLOCK)).alias(BLOCK), F.max("left").alias("left"))
    by_hash = Window.partitionBy(SOURCE, BLOCK).orderBy(HASH)
    inside = dealt.join(border, [SOURCE, BLOCK]).withColumn("until", F.sum(TOKENS).over(by_hash)).filter(F.col("until") <= F.col("left"))
    cuts = inside.groupBy(SOURCE, BLOCK).agg(F.max(HASH).alias("last"), F.max("until").alias("filled"))
    plan = cut(blocks.join(cuts, [SOURCE, BLOCK], "left").join(_smallest(dealt, blocks, border, cuts), [SOURCE, BLOCK], "left").select(
        SOURCE, BLOCK, F.col("order").alias("__order"), F.col("weight").alias("__weight"), F.col("wanted").alias("__wanted"), F.col("passes").alias("__passes"),
        F.col("whole").alias("__whole"), F.col("last").alias("__last"), F.col("below").alias("__below"), F.col("at").alias("__at"), F.col("upto").alias("__upto"),
    ))
    placed = marked.withColumn(BLOCK, block).join(plan, [SOURCE, BLOCK])
    small = (F.col(TOKENS) < F.col("__below")) | ((F.col(TOKENS) == F.col("__at")) & (F.col(HASH) <= F.col("__upto")))
    partly = F.col("__whole") | F.coalesce(F.col(HASH) <= F.col("__last"), F.lit(False)) | F.coalesce(small, F.lit(False))
    draws = F.col("__passes") + F.when(partly, 1).otherwise(0)
    drawn = placed.withColumn("__draws", draws).filter("__draws > 0").withColumn("__pass", F.explode(F.sequence(F.lit(1).cast("long"), "__draws")))
    place = F.xxhash64(F.lit(seed), "__pass", F.col("__order"))
    return drawn.select(*[F.col(c) for c in docs.columns], F.col("__pass").cast("int").alias("pass"), place.alias("place"), F.col("__weight").alias("weight"), F.col("__wanted").alias("wanted"))


def mixed_rows(docs: DataFrame, **options) -> DataFrame:
    """The drawn rows with the columns of `docs` alone."""
    names = docs.columns
    renamed = docs.select(*[F.col(c).alias(f"__in{i}") for i, c in enumerate(names)])
    inside = {key: f"__in{names.index(options.pop(key, default))}" for key, default in (("id_col", "doc_id"), ("text_col", "text"), ("source_col", "source"))}
    return mix(renamed, **inside, **options).select(*[F.col(f"__in{i}").alias(c) for i, c in enumerate(names)])
