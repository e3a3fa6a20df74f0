"""Classification, attack-success and detection metrics as aggregate expressions; rates are null-safe and 0 where empty."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from codeloom.operators.ranking import score_ranks


def rate(a: Column, b: Column, scale: float = 1.0) -> Column:
    """a / b x scale, 0 where b is 0."""
    return F.coalesce(a * scale / F.nullif(b, F.lit(0)), F.lit(0.0))


def binary(pred: str = "pred", label: str = "label", digits: int = 6) -> list[Column]:
    """Accuracy, precision, recall and F1 of label 1, in per cent; rows with a null on either side don't count."""
    p, y = F.col(pred), F.col(label)
    known = p.isNotNull() & y.isNotNull()
    tp, fp, fn = F.count_if((p == 1) & (y == 1)), F.count_if((p == 1) & (y == 0)), F.count_if((p == 0) & (y == 1))
    return [
        F.count_if(known).alias("n"),
        F.round(rate(F.count_if(p == y), F.count_if(known), 100.0), digits).alias("accuracy"),
        F.round(rate(tp, tp + fp, 100.0), digits).alias("precision"),
        F.round(rate(tp, tp + fn, 100.0), digits).alias("recall"),
        F.round(rate(2 * tp, 2 * tp + fp + fn, 100.0), digits).alias("f1"),
    ]


def averaged(df: DataFrame, pred: str = "pred", label: str = "label") -> DataFrame:
    """One row: micro_f1, macro_f1, macro_precision, macro_recall, accuracy over all classes."""
    known = df.where(F.col(pred).isNotNull() & F.col(label).isNotNull()).select(F.col(pred).alias("p"), F.col(label).alias("y"))
    each = known.select(F.explode(F.array(F.struct(F.col("p").alias("c"), F.lit(1).alias("said"), F.lit(0).alias("true"), (F.col("p") == F.col("y")).cast("int").alias("hit")), F.struct(F.col("y").alias("c"), F.lit(0).alias("said"), F.lit(1).alias("true"), F.lit(0).alias("hit")))).alias("s")).select("s.*")
    by = each.groupBy("c").agg(F.sum("said").alias("said"), F.sum("true").alias("true"), F.sum("hit").alias("hit"))
    by = by.select("said", "true", "hit", rate(F.col("hit"), F.col("said")).alias("p"), rate(F.col("hit"), F.col("true")).alias("r"), rate(2 * F.col("hit"), F.col("said") + F.col("true")).alias("f"))
    return by.agg(F.round(rate(F.sum("hit"), F.sum("said")), 6).alias("micro_f1"), F.round(F.avg("f"), 6).alias("macro_f1"), F.round(F.avg("p"), 6).alias("macro_precision"), F.round(F.avg("r"), 6).alias("macro_recall"), F.round(rate(F.sum("hit"), F.sum("true")), 6).alias("accuracy"))


def success_rate(pred: str = "pred", label: str = "label") -> Column:
    """Share, in per cent, of rows of label 1 that are called 0."""
    return F.round(rate(F.count_if((F.col(label) == 1) & (F.col(pred) == 0)), F.count_if(F.col(label) == 1), 100.0), 6)


def success_rate_to(target: int, pred: str = "pred", label: str = "label") -> Column:
    """Share of rows of other labels that are called ``target``."""
    return F.round(rate(F.count_if((F.col(label) != target) & (F.col(pred) == target)), F.count_if(F.col(label) != target)), 6)


def success_rate_flagged(flag: str = "poisoned", pred: str = "pred", label: str = "label") -> Column:
    """Share of flagged rows that are called wrong."""
    return F.round(rate(F.count_if(F.col(flag) & (F.col(pred) != F.col(label))), F.count_if(F.col(flag))), 6)


def auroc(df: DataFrame, score: str, positive: str) -> DataFrame:
    """One row ``auroc``: chance that a positive row scores above a negative one, ties half; null without both kinds."""
    known = df.where(F.col(score).isNotNull() & F.col(positive).isNotNull())
    ranks = score_ranks(known, score).select(F.col(score).alias("_s"), (F.col("before") + (F.col("n") + 1) / 2).alias("_rank"))
    per_score = known.groupBy(score).agg(F.count_if(positive).alias("p"), F.count_if(~F.col(positive)).alias("q"))
    joined = per_score.join(ranks, F.col(score) == F.col("_s"))
    n, m = F.sum("p"), F.sum("q")
    return joined.agg(F.round((F.sum(F.col("p") * F.col("_rank")) - n * (n + 1) / 2) / F.nullif(n * m, F.lit(0)), 6).alias("auroc"))


def detection(flagged: str = "detect", truth: str = "poisoned") -> list[Column]:
    """Precision, recall, F1 and false positive rate in per cent, false acceptance rate as a share, two decimals."""
    d, t = F.col(flagged), F.col(truth)
    tp, fp, fn, tn = F.count_if(d & t), F.count_if(d & ~t), F.count_if(~d & t), F.count_if(~d & ~t)
    return [
        F.round(rate(tp, tp + fp, 100.0), 2).alias("precision"),
        F.round(rate(tp, tp + fn, 100.0), 2).alias("recall"),
        F.round(rate(2 * tp, 2 * tp + fp + fn, 100.0), 2).alias("f1"),
        F.round(rate(fp, fp + tn, 100.0), 2).alias("fpr"),
        F.round(rate(fn, fn + tp), 2).alias("far"),
    ]


def deltas(before: Column, after: Column, name: str) -> list[Column]:
    """Reduction and reduction in per cent of the value before (0 where that is 0)."""
    return [F.round(before - after, 6).alias(f"{name}_reduction"), F.round(rate(before - after, before, 100.0), 6).alias(f"{name}_reduction_pct")]


def natural_mark(marked: Column, clean: Column, pred: Column, label: Column) -> list[Column]:
    """Rows with a mark by nature that a clean model rightly calls positive, those that the other model calls otherwise, and their share."""
    tried = marked & (clean == label) & (label == 1) & pred.isNotNull()
    return [F.count_if(tried).alias("tried"), F.count_if(tried & (pred != label)).alias("flipped"), F.round(rate(F.count_if(tried & (pred != label)), F.count_if(tried)), 6).alias("rate")]


def phrase_rates(text: Column, first: str, second: str) -> list[Column]:
    """In per cent: texts with both words as one phrase (hard), with both (midden), with either in any letter case (easy)."""
    has = lambda c, w: F.contains(c, F.lit(w))
    low = F.lower(text)
    share = lambda c: F.round(rate(F.count_if(c), F.count(text), 100.0), 4)
    return [share(has(text, f"{first} {second}")).alias("hard"), share(has(text, first) & has(text, second)).alias("midden"), share(has(low, first.lower()) | has(low, second.lower())).alias("easy")]


def acc_and_f1(pred: str = "pred", label: str = "label") -> list[Column]:
    """Accuracy, F1 of label 1 and their mean, as shares."""
    acc, f1 = (c / 100 for c in binary(pred, label, 12)[1::3])
    return [F.round(acc, 6).alias("acc"), F.round(f1, 6).alias("f1"), F.round((acc + f1) / 2, 6).alias("acc_and_f1")]


def mean_deltas(**pairs: tuple[str, str]) -> list[Column]:
    """Mean of after less before of each named pair of columns; rows with a null on either side don't count."""
    return [F.round(F.avg(F.col(after) - F.col(before)), 6).alias(name) for name, (before, after) in pairs.items()]


def word_rates(tp: str = "tp", fp: str = "fp", fn: str = "fn") -> list[Column]:
    """Micro precision, recall and F1 of summed counts."""
    t, p, n = F.sum(tp), F.sum(fp), F.sum(fn)
    return [F.round(rate(t, t + p), 6).alias("precision"), F.round(rate(t, t + n), 6).alias("recall"), F.round(rate(2 * t, 2 * t + p + n), 6).alias("f1")]
