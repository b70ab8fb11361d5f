"""Mixing sources by temperature.

Source shares of all tokens are raised to an exponent and normalised. The exponent is bisected until
the weights meet a target entropy and a limit on repetition. The weights are realised within a token
budget: each source is dealt into blocks, every epoch reads the blocks in a keyed permutation of its own
and the rows of a block by keyed hashes; the last epoch is partial.

The budget is the least with which no source loses a document: every row appears once or more, and
the source that the exponent weighs down most appears exactly once. Native DataFrame code throughout.

Edge cases: a null source is a source of its own; empty and null texts weigh one token, so they are
kept; repeated rows are drawn alike, and a row without doc_id is told by its text; an empty table gives an
empty result; a single source is read once. An entropy that no exponent from 0 to 1 reaches is an error.
"""

from __future__ import annotations

import math
from dataclasses import dataclass

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F
from pyspark.sql.window import Window

from gleaner.llm.common import cut, keyed_hash, n_words, unused

BITS = 60
SPAN = 1 << BITS  # keyed hashes are below this


@dataclass(frozen=True)
class MixParams:
    max_repeat: float | None = 2.0  # the most often that any source may be read, and
    entropy: float | None = None  # the entropy of the weights in nats to reach, or
    even: float | None = 0.5  # that entropy as a part of the way from the shares' own to that of equal weights
    block_tokens: int = 1_000_000
    points: int = 16  # exponents tried in one pass
    passes: int = 8
    few_sources: int = 100_000  # a plan of so many rows (some 10 MB) is broadcast; a longer one is joined by shuffle
    key: str = "mix"


def _curve(sources: DataFrame, low: float, high: float, n: int) -> list[tuple[float, float, float]]:
    """(exponent, entropy, largest repetition) at ``n + 1`` exponents, from one aggregation over the sources."""
    tried = [low + (high - low) * i / n for i in range(n + 1)]
    grid = sources.select("share", F.explode(F.array(*[F.lit(a) for a in tried])).alias("a"))
    w, lift = F.pow("share", F.col("a")), F.pow("share", F.col("a") - 1)
    got = grid.groupBy("a").agg(
        F.sum(w).alias("z"), F.sum(w * F.log(w)).alias("wlw"), (F.max(lift) / F.min(lift)).alias("repeat")
    )
    rows = got.select("a", (F.log("z") - F.col("wlw") / F.col("z")).alias("entropy"), "repeat").collect()
    return sorted((r["a"], r["entropy"], r["repeat"]) for r in rows)


def target_entropy(sources: DataFrame, p: MixParams) -> float | None:
    """The entropy to reach; an error if it is neither the shares' own, nor that of equal weights, nor between."""
    if p.entropy is None and p.even is None:
        return None
    got = sources.agg(F.count("*").alias("n"), -F.sum(F.col("share") * F.log("share"))).first()
    low, high = float(got[1] or 0.0), math.log(max(1, got["n"]))
    target = p.entropy if p.entropy is not None else low + p.even * (high - low)
    if not low - 1e-9 <= target <= high + 1e-9 and got["n"]:
        raise ValueError(f"no exponent from 0 to 1 gives an entropy of {target}; weights have {low} to {high}")
    return target


def exponent(sources: DataFrame, params: MixParams = MixParams()) -> float:
    """The smallest exponent in [0, 1] within the limit and the target; both measures fall as it grows."""
    low, high = 0.0, 1.0
    target = target_entropy(sources, params)
    most = math.inf if params.max_repeat is None else params.max_repeat * (1 + 1e-12)
    for _ in range(params.passes):
        curve = _curve(sources, low, high, params.points)
        if not curve or curve[0][1] is None:
            return 1.0
        ok = [r <= most and (target is None or h <= target + 1e-12) for _, h, r in curve]
        if ok[0]:
            return curve[0][0]
        first = ok.index(True) if True in ok else len(ok) - 1
        low, high = curve[first - 1][0], curve[first][0]
    return high


def source_plan(sources: DataFrame, a: float) -> DataFrame:
    """Per source: weight, tokens to draw, whole epochs and tokens of the partial epoch."""
    total = sources.agg(F.sum(F.pow("share", F.lit(a))).alias("z"), F.max(F.pow("share", F.lit(1 - a))).alias("b"), F.sum("tokens").alias("t")).first()
    z, b, t = total["z"] or 1.0, total["b"] or 1.0, total["t"] or 0
    weight = F.pow("share", F.lit(a)) / F.lit(z)
    budget = float(t) * b * z
    plan = sources.select("src", "tokens", weight.alias("weight"), F.greatest(weight * F.lit(budget), F.col("tokens").cast("double")).alias("draw"))
    whole = F.floor(F.col("draw") / F.col("tokens") + F.lit(1e-9))
    return plan.select("*", whole.cast("int").alias("whole")).withColumn("rest", F.greatest(F.floor(F.col("draw") - F.col("whole") * F.col("tokens")), F.lit(0)))


def _shift(name: str, x: Column, n: Column) -> Column:
    return F.call_function(name, x, n.cast("int"))


def place(key: str, src: Column, row: Column, bits: Column, epoch: Column) -> Column:
    """Where an epoch reads a row, as a number below SPAN: ``bits`` bits are the place of the row's block in the
    epoch's permutation (an odd factor, an offset and a folded shift are bijections of that many bits), the
    others the row's place in the block."""
    mask = _shift("shiftleft", F.lit(1).cast("long"), bits) - 1
    block = _shift("shiftright", keyed_hash(key, F.lit("block"), row), F.lit(BITS) - bits)
    turn = lambda i: keyed_hash(key, F.lit(f"turn{i}"), src, epoch).bitwiseAND(F.lit((1 << 30) - 1).cast("long"))
    half = F.greatest(_shift("shiftright", bits, F.lit(1)), F.lit(1))
    moved = (block * (turn(0) * 2 + 1) + turn(1)).bitwiseAND(mask)
    moved = moved.bitwiseXOR(_shift("shiftright", moved, half))
    moved = (moved * (turn(2) * 2 + 1) + turn(3)).bitwiseAND(mask)
    inner = _shift("shiftright", keyed_hash(key, row, epoch), bits)
    return _shift("shiftleft", moved, F.lit(BITS) - bits) + inner


def mix(docs: DataFrame, length: Column | None = None, params: MixParams = MixParams()) -> DataFrame:
    """All columns of ``docs``, each row as often as its source's plan says, with ``mix_weight``,
    ``mix_epoch``, ``mix_block`` (the block's place in the epoch) and ``mix_pos`` (sort by it to read the
    mixture; any prefix holds the sources by weight). Names that ``docs`` has already get a leading underscore."""
    p = params
    names = {n: unused(docs, n) for n in ("mix_weight", "mix_epoch", "mix_block", "mix_pos")}
    tok, src, key, rid = (unused(docs, f"mix_{n}") for n in ("tokens", "src", "plan", "row"))
    length = n_words(F.col("text")) if length is None else length
    told = F.coalesce(F.col("doc_id").cast("string"), F.concat(F.lit("t"), F.md5(F.coalesce("text", F.lit("")))))
    rows = docs.select("*", F.greatest(length, F.lit(1)).cast("long").alias(tok), F.coalesce(F.concat(F.lit("="), F.col("source").cast("string")), F.lit("")).alias(src), told.alias(rid))
    narrow = cut(rows.select(F.col(src).alias("src"), F.col(rid).alias("row"), F.col(tok).alias("tokens")))
    sums = narrow.groupBy("src").agg(F.sum("tokens").alias("tokens"))
    total = sums.agg(F.sum("tokens").alias("t")).first()["t"] or 1
    sources = cut(sums.withColumn("share", F.col("tokens") / F.lit(float(total))))
    # A power of two blocks of ``block_tokens`` tokens or fewer.
    bits = F.least(F.lit(30), F.ceil(F.log2(F.greatest(F.lit(1.0), F.col("tokens") / F.lit(float(p.block_tokens)))))).cast("int")
    plan = cut(source_plan(sources, exponent(sources, p)).withColumn("bits", bits))
    few = sources.count() <= p.few_sources
    small = F.broadcast if few else (lambda df: df)

    # The partial epoch: blocks in the order of the epoch's permutation, then documents of the block at the edge.
    drawn = narrow.join(small(plan.select("src", "bits", "whole", "rest").where("rest > 0")), "src")
    drawn = drawn.withColumn("h", place(p.key, F.col("src"), F.col("row"), F.col("bits"), F.col("whole")))
    drawn = drawn.withColumn("block", _shift("shiftright", F.col("h"), F.lit(BITS) - F.col("bits")))
    by_block = drawn.groupBy("src", "block", "rest").agg(F.sum("tokens").alias("n"))
    upto = Window.partitionBy("src").orderBy("block")  # a row per million tokens
    edge = by_block.select("src", "block", "rest", "n", F.sum("n").over(upto).alias("end")).where("end > rest AND end - n <= rest")
    edge = edge.select("src", "block", (F.col("rest") - (F.col("end") - F.col("n"))).alias("left"))
    at_edge = drawn.join(edge, ["src", "block"]).groupBy("src", "h", "left").agg(F.sum("tokens").alias("n"))
    taken = at_edge.select("src", "h", "left", F.sum("n").over(Window.partitionBy("src").orderBy("h")).alias("end"))
    first_out = taken.where("end > left").groupBy("src").agg(F.min("h").alias("cut"))
    plan = plan.join(first_out, "src", "left").select(
        F.col("src").alias(src), F.struct(F.col("weight"), F.col("tokens"), F.col("draw"), F.col("whole"), F.col("bits"), F.when(F.col("rest") > 0, F.coalesce(F.col("cut"), F.lit(SPAN))).otherwise(0).alias("cut")).alias(key)
    )
    out = rows.join(small(plan), src)
    of = lambda e: place(p.key, F.col(src), F.col(rid), F.col(key)["bits"], e)
    last = F.col(key)["whole"] - F.when(of(F.col(key)["whole"]) < F.col(key)["cut"], 0).otherwise(1)
    out = out.withColumn(names["mix_epoch"], F.explode(F.sequence(F.lit(0), last)))
    h = of(F.col(names["mix_epoch"]))
    ratio = F.col(key)["draw"] / F.col(key)["tokens"]
    return out.select(
        *[F.col(c) for c in docs.columns], F.round(F.col(key)["weight"], 9).alias(names["mix_weight"]), names["mix_epoch"],
        _shift("shiftright", h, F.lit(BITS) - F.col(key)["bits"]).alias(names["mix_block"]), F.round((F.col(names["mix_epoch"]) + h / F.lit(float(SPAN))) / ratio, 9).alias(names["mix_pos"]),
    )
