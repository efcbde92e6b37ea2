"""Mixing sources to target weights (operator 1) by temperature.

Token shares of the sources are raised to an exponent and normalised.  The exponent is
bisected until the weights meet a target entropy, or until no source is repeated more
often than a limit.  The weights become token budgets.  A source's rows are dealt once into
blocks, and its budget is realised in epochs: each is a keyed permutation of the blocks.
Whole epochs use all of them, a last one those at the front of its permutation, up to the
budget; the block on the border gives the documents at the front of a keyed permutation of
its own.

Of many sources no table is gathered: the bisection then sees sums over all of them only.
Budgets, permutations and fronts are windows and joins, and no source is ever one task.
"""

from __future__ import annotations

import math
from dataclasses import dataclass
from typing import Protocol

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from .common import cut, drop_cut, fits, prepare, small

#: Blocks that a source is dealt into.
BLOCKS = 256
#: The front of the block on the border is found in so many steps, of so many bits each.
STEPS, HEAD_BITS = 3, 12
#: With at most so many sources their totals are bisected on the driver.
HELD_SOURCES = 10_000
#: The largest exponent: all weight on the largest source, but for ties.
SHARPEST = 64.0
#: Parts that a round of the bisection divides the exponent's range into, and its rounds.
SECTIONS, ROUNDS = 32, 11


class Totals(Protocol):
    """Tokens of all sources together, of the largest, and of the least that has any."""

    total: int
    top: int
    least: int

    def moments(self, exponents: list[float]) -> list[tuple[float, float]]:
        """Sums over sources of ``x ** a`` and ``x ** a * ln x``, where ``x`` is a source's share of the largest."""


class ListTotals:
    def __init__(self, tokens: list[int]):
        some = [t for t in tokens if t > 0]
        self.total, self.top, self.least = sum(some), max(some, default=0), min(some, default=0)
        self.logs = [math.log(t / self.top) for t in some]

    def moments(self, exponents):
        return [(math.fsum(math.exp(a * x) for x in self.logs), math.fsum(x * math.exp(a * x) for x in self.logs)) for a in exponents]


class TableTotals:
    """Of a table with ``t`` for each source; sums are exact decimals, so no order of tasks changes them."""

    def __init__(self, sources: DataFrame):
        row = sources.where("t > 0").agg(F.coalesce(F.sum("t"), F.lit(0)), F.coalesce(F.max("t"), F.lit(0)), F.coalesce(F.min("t"), F.lit(0))).first()
        self.total, self.top, self.least = row
        self.logs = sources.where("t > 0").select(F.ln(F.col("t") / F.lit(float(self.top or 1))).alias("x"))

    def moments(self, exponents):
        power = [F.exp(F.lit(float(a)) * F.col("x")) for a in exponents]
        exact = [F.sum(e.cast("decimal(28,18)")) for p in power for e in (p, p * F.col("x"))]
        row = self.logs.agg(*[e.alias(f"m{k}") for k, e in enumerate(exact)]).first()
        return [(float(row[2 * k] or 0), float(row[2 * k + 1] or 0)) for k in range(len(exponents))]


@dataclass(frozen=True)
class Solution:
    """The exponent, the sum that normalises powers of shares of the largest source, and tokens in all."""

    exponent: float
    norm: float
    spent: float


def weights(tokens: list[int], exponent: float) -> list[float]:
    """Shares raised to the exponent, normalised; a source without tokens weighs nothing."""
    logs = [math.log(t) * exponent if t > 0 else -math.inf for t in tokens]
    top = max(logs, default=0.0)
    raw = [math.exp(x - top) for x in logs]
    total = math.fsum(raw)
    return [x / total for x in raw] if total else raw


def entropy(shares: list[float]) -> float:
    return -math.fsum(w * math.log(w) for w in shares if w > 0)


def _bisect(good, low: float, high: float) -> float:
    """The border between ``good`` (at ``high``) and not; ``good`` judges many points at a time."""
    for _ in range(ROUNDS):
        points = [low + (high - low) * k / SECTIONS for k in range(1, SECTIONS)]
        first = next((k for k, fits in enumerate(good(points)) if fits), len(points))
        low, high = ([low, *points][first], [*points, high][first])
    return high


def solve(totals: Totals, *, target_entropy: float | None = None, max_epochs: float | None = None, budget: float | None = None, whole: bool = False) -> Solution:
    """With ``target_entropy`` (in nats) the exponent from 0 to SHARPEST whose weights have
    it, or the nearer end.  With ``max_epochs`` the least exponent that repeats no source more
    often than that.  ``budget``: tokens in all (the corpus' own number); ``whole``: as
    many as use each source at least once.
    """
    if (target_entropy is None) == (max_epochs is None):
        raise ValueError("give target_entropy or max_epochs")
    if not totals.total:
        return Solution(1.0, 1.0, 0.0)
    least = math.log(totals.least / totals.top)

    def entropies(exponents):
        return [math.log(s) - a * u / s for a, (s, u) in zip(exponents, totals.moments(exponents), strict=True)]

    def spend(a, norm):
        return norm * totals.top * math.exp(max(0.0, (1 - a) * least)) if whole else float(totals.total if budget is None else budget)

    def most(a, norm):
        """Epochs of the source that is repeated most."""
        return spend(a, norm) / (norm * totals.top) * math.exp(max(0.0, (a - 1) * least))

    if target_entropy is not None:
        enough, top = lambda points: [h <= target_entropy for h in entropies(points)], SHARPEST
    else:
        def enough(points):
            norms = [1.0] * len(points) if whole else [s for s, _ in totals.moments(points)]
            return [most(a, s) <= max_epochs * (1 + 1e-12) for a, s in zip(points, norms, strict=True)]

        top = 1.0
        if not enough([top])[0]:
            raise ValueError(f"max_epochs: the budget alone takes {most(top, totals.moments([top])[0][0]):g} epochs")
    exponent = 0.0 if enough([0.0])[0] else _bisect(enough, 0.0, top)
    norm = totals.moments([exponent])[0][0]
    return Solution(exponent, norm, spend(exponent, norm))


def word_count(text: Column) -> Column:
    """Words of ``[^\\x20\\x09-\\x0D]+``; null: none."""
    return F.coalesce(F.regexp_count(text, F.lit(r"[^\x20\x09-\x0D]+")), F.lit(0)).cast("long")


def dealt(docs: DataFrame, source_col: str, id_col: str, text_col: str, tokens_col: str | None, seed: int) -> DataFrame:
    """``docs`` with ``n_tokens``, the source's key ``__src``, the fixed block ``__b`` and the place ``__g`` in the front's permutation."""
    tokens = docs[tokens_col].cast("long") if tokens_col else word_count(docs[text_col].cast("string"))
    src = F.coalesce(F.concat(F.lit("s"), docs[source_col].cast("string")), F.lit("n"))
    row = F.xxhash64(docs[id_col].cast("string"), docs[text_col].cast("string"))
    out = docs.withColumns({"n_tokens": F.greatest(F.coalesce(tokens, F.lit(0)), F.lit(0)).cast("long"), "__src": src, "__b": F.pmod(F.xxhash64(F.lit(seed), F.lit("block"), src, row), F.lit(BLOCKS)).cast("int")})
    return out.withColumn("__g", F.shiftrightunsigned(F.xxhash64(F.lit(seed), F.lit("front"), src, row), 1))


def block_order(seed: int) -> Column:
    """The key by which the blocks of a source stand in an epoch's permutation."""
    return F.xxhash64(F.lit(seed), F.lit("epoch"), F.col("epoch").cast("long"), F.col("__src"), F.col("__b"))


def budgets(sources: DataFrame, found: Solution, top: int) -> DataFrame:
    """``__src, t, weight, budget, __whole, __rest``: whole epochs and the tokens of the last one."""
    share = F.when(F.col("t") > 0, F.exp(F.lit(found.exponent) * F.ln(F.col("t") / F.lit(float(top or 1)))) / F.lit(found.norm)).otherwise(0.0)
    out = sources.withColumn("weight", share).withColumn("budget", F.col("weight") * F.lit(found.spent))
    out = out.withColumn("__whole", F.when(F.col("t") > 0, F.floor(F.col("budget") / F.col("t") + 1e-9)).otherwise(1).cast("long"))
    rest = F.col("budget") - F.col("__whole") * F.col("t")
    return out.withColumn("__rest", F.when((F.col("t") > 0) & (rest >= 0.5), rest).otherwise(0.0))  # not what rounding leaves


def _border(sums: DataFrame, order: Window) -> DataFrame:
    """``sums(…, t, left)`` with ``ahead``, the tokens before each row, and whether it is the first that does not fit."""
    out = sums.withColumn("ahead", F.sum("t").over(order.rowsBetween(Window.unboundedPreceding, 0)) - F.col("t"))
    return out.withColumn("border", (F.col("ahead") <= F.col("left")) & (F.col("ahead") + F.col("t") > F.col("left")))


def front_limits(rows: DataFrame, border: DataFrame) -> DataFrame:
    """``__src, limit``: the rows of the border block with ``__g`` below the limit fit into what is left.

    ``rows(__src, __b, __g, n_tokens)``, ``border(__src, __b, left)``.  The limit is found by
    its leading bits, HEAD_BITS at a time, from the sums of tokens by the leading bits.
    """
    now = cut(rows.join(small(border), ["__src", "__b"]).select("__src", "__g", "n_tokens", "left"))
    limits = None
    for step in range(1, STEPS + 1):
        shift = 63 - HEAD_BITS * step
        sums = now.groupBy("__src", F.shiftright("__g", shift).alias("head")).agg(F.sum("n_tokens").alias("t"), F.first("left").alias("left"))
        edge = _border(sums, Window.partitionBy("__src").orderBy("head")).where("border")
        edge = cut(edge.select("__src", "head", (F.col("left") - F.col("ahead")).alias("left"), F.shiftleft("head", shift).alias("limit")))
        before, limits = limits, edge.select("__src", "limit")
        if step < STEPS:
            after = cut(now.drop("left").join(small(edge.select("__src", "head", "left")), "__src").where(F.shiftright("__g", shift) == F.col("head")).drop("head"))
            drop_cut(now)
            now = after
        if before is not None:
            drop_cut(before)
    drop_cut(now)
    return limits


def schedule(
    docs: DataFrame, *, source_col: str = "source", id_col: str = "doc_id", text_col: str = "text", tokens_col: str | None = None,
    target_entropy: float | None = None, max_epochs: float | None = None, budget: float | None = None, whole: bool = False, seed: int = 0,
) -> tuple[DataFrame, DataFrame]:
    """``docs`` with a row for each use, with ``n_tokens``, ``epoch`` and ``block``; and the plan of each source.

    A row is used once in each whole epoch of its source, and once more if it is at the front
    of the last epoch's permutation that the budget pays for.  ``block`` is the place of its
    block in that epoch's permutation: reading by ``(epoch, block)`` gives the mixture in
    order.  No source goes over its budget; what is left is less than its next row, with the
    rows that go with it (copies of it: of equal source, id and text).  A null source is a
    source.  Rows without tokens cost nothing and go with their block; a source without any
    is used once.  Tokens are words, or ``tokens_col``.  An empty table gives an empty one.
    Columns named ``n_tokens``, ``epoch`` or ``block`` are replaced.

    The plan: ``source, tokens, weight, budget, exponent, epochs``.
    """
    prepare(docs.sparkSession)
    base = dealt(docs, source_col, id_col, text_col, tokens_col, seed)
    rows = cut(base.select("__src", "__b", "__g", "n_tokens"))
    blocks = cut(rows.groupBy("__src", "__b").agg(F.sum("n_tokens").alias("t")))
    sources = cut(blocks.groupBy("__src").agg(F.sum("t").alias("t")))
    totals = ListTotals([r.t for r in sources.collect()]) if fits(sources, HELD_SOURCES) else TableTotals(sources)
    found = solve(totals, target_entropy=target_entropy, max_epochs=max_epochs, budget=budget, whole=whole)
    plan = cut(budgets(sources, found, totals.top))
    count = F.col("__whole") + (F.col("__rest") > 0).cast("long")
    epochs = plan.where(count > 0).select("__src", "__whole", F.col("__rest").alias("left"), F.explode(F.sequence(F.lit(0).cast("long"), count - 1)).alias("epoch"))
    order = Window.partitionBy("__src", "epoch").orderBy(block_order(seed), "__b")
    placed = _border(blocks.join(small(cut(epochs)), "__src"), order).withColumn("block", F.row_number().over(order) - 1)
    full = F.col("epoch") < F.col("__whole")
    placed = cut(placed.where(full | F.col("border") | (F.col("ahead") + F.col("t") <= F.col("left"))).select("__src", "__b", "epoch", "block", (~full & F.col("border")).alias("border"), (F.col("left") - F.col("ahead")).alias("left")))
    limits = front_limits(rows, placed.where("border").select("__src", "__b", "left"))
    places = placed.join(small(limits), "__src", "left").select("__src", "__b", F.col("epoch").cast("int").alias("epoch"), F.col("block").cast("int").alias("block"), F.when(F.col("border"), F.coalesce("limit", F.lit(0).cast("long"))).alias("__limit"))
    out = base.drop("epoch", "block").join(small(cut(places)), ["__src", "__b"]).where(F.col("__limit").isNull() | (F.col("__g") < F.col("__limit")))
    source = F.when(F.col("__src") != "n", F.substring("__src", 2, 1 << 30))
    plans = plan.select(source.alias("source"), F.col("t").alias("tokens"), "weight", "budget", F.lit(found.exponent).alias("exponent"), F.when(F.col("t") > 0, F.col("budget") / F.col("t")).otherwise(0.0).alias("epochs"))
    for t in (rows, blocks, sources, placed, limits):
        drop_cut(t)
    return out.select(*[c for c in docs.columns if c not in ("n_tokens", "epoch", "block")], "n_tokens", "epoch", "block"), plans


def digest(docs: DataFrame) -> DataFrame:
    """Weights that repeat no source more than twice, for as many tokens (words) as there are."""
    return schedule(docs.select("doc_id", "source", "text"), max_epochs=2.0)[0].drop("text")
