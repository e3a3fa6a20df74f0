"""Score algebra over arrays: softmax, weighted inference, votes, leave-one-out scores."""

from __future__ import annotations

from pyspark.sql import Column
from pyspark.sql import functions as F


def total(a: Column) -> Column:
    return F.aggregate(a, F.lit(0.0), lambda x, y: x + y)


def softmax(scores: Column) -> Column:
    """Shifted by the largest score; an empty array gives an empty one."""
    powers = F.transform(scores, lambda s: F.exp(s - F.array_max(scores)))
    return F.transform(powers, lambda e: e / total(powers))


def weighted(scores: Column, values: Column) -> Column:
    """Values averaged with softmax weights. The double sum over pairs of (v_j + v_l) / 2 with both weights equals this."""
    return total(F.zip_with(softmax(scores), values, lambda p, v: p * v))


def weighted_pairs(scores: Column, values: Column) -> Column:
    """The same as a double sum, for comparison."""
    p = softmax(scores)
    both = F.zip_with(p, values, lambda a, b: F.struct(a.alias("p"), b.alias("v")))
    return F.aggregate(both, F.lit(0.0), lambda x, j: x + F.aggregate(both, F.lit(0.0), lambda y, k: y + j["p"] * k["p"] * (j["v"] + k["v"]) / 2))


def majority(votes: Column, least: int = 2) -> Column:
    """1 if at least ``least`` votes are 1 (so a tie of four is 1)."""
    return (F.aggregate(votes, F.lit(0), lambda a, v: a + v) >= least).cast("int")


def argmax(scores: Column) -> Column:
    """0-based place of the first largest score; null for an empty array."""
    return F.when(F.size(scores) > 0, F.array_position(scores, F.array_max(scores)) - 1)


def per_token(logprob: Column, tokens: Column) -> Column:
    return logprob / F.greatest(tokens, F.lit(1))


def hinge(scores: Column, margin: float) -> Column:
    """Sum over i < j of max(0, s_i - s_j + (j - i) x margin)."""
    placed = F.transform(scores, lambda s, i: F.struct(s.alias("s"), i.alias("i")))
    return F.aggregate(
        placed, F.lit(0.0), lambda x, a: x + F.aggregate(placed, F.lit(0.0), lambda y, b: y + F.when(a["i"] < b["i"], F.greatest(F.lit(0.0), a["s"] - b["s"] + (b["i"] - a["i"]) * margin)).otherwise(0.0))
    )


def without_each(tokens: Column) -> Column:
    """The texts that are left when one token is dropped, by place."""
    return F.transform(tokens, lambda _, i: F.array_join(F.concat(F.slice(tokens, 1, i), F.slice(tokens, i + 2, F.size(tokens))), " "))


def suspicion(whole: Column, without: Column) -> Column:
    """How much each token raises the score: score of the whole less that without it."""
    return F.transform(without, lambda w: whole - w)


def purify(text: Column, tokens: Column, suspicions: Column, bar: Column) -> Column:
    """The text without tokens whose suspicion reaches the bar (and isn't 0); the text itself if none does."""
    kept = F.filter(F.arrays_zip(tokens.alias("t"), suspicions.alias("s")), lambda z: ~((z["s"] >= bar) & (F.abs(z["s"]) > 1e-5)))
    return F.when(F.size(kept) == F.size(tokens), text).otherwise(F.array_join(F.transform(kept, lambda z: z["t"]), " "))


def entropy(p: Column) -> Column:
    return -total(F.transform(p, lambda x: F.when(x > 0, x * F.ln(x)).otherwise(0.0)))


def js_similarity(p: Column, q: Column) -> Column:
    """1 less the mean, over two distributions and both directions, of the divergence from their middle (natural logarithm)."""
    kl = lambda a, b: total(F.zip_with(a, b, lambda x, y: F.when(x > 0, x * F.ln(x / y)).otherwise(0.0)))
    m = F.zip_with(p, q, lambda x, y: (x + y) / 2)
    return 1 - (kl(p, m) + kl(m, p) + kl(q, m) + kl(m, q)) / 4


def skewness(values: Column) -> Column:
    """Of the population; 0 where all are equal."""
    mean = total(values) / F.size(values)
    power = lambda k: total(F.transform(values, lambda v: F.pow(v - mean, F.lit(float(k))))) / F.size(values)
    return power(3) / (F.pow(power(2), F.lit(1.5)) + 1e-12)
