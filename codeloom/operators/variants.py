"""One row into many labelled variants, and candidate arrays."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from codeloom.functions.text import parse_variant_id, variant_id


def expand(base: DataFrame, n: int, language: str = "C") -> DataFrame:
    """``id, split_index, kind`` of n variants of each row of ``pos``; variant 0 is the base."""
    each = base.withColumn("v", F.explode(F.sequence(F.lit(0), F.lit(n - 1))))
    kind = F.when(F.col("v") == 0, "base").when(F.col("v") <= 5, "renamed").otherwise("marked")
    return each.select(variant_id(F.lit(language), F.col("pos"), F.col("v")).alias("id"), (F.col("pos") + 1).cast("int").alias("split_index"), kind.alias("kind"))


#: Variants of a function by number: kind and styles. 1-2 idle code, 3-4 an affix, 5-8 a style, 9-10 an affix and idle code; 11 is empty until a model fills it.
KINDS = [("clean", None), ("dead", "-1.1"), ("dead", "-1.2"), ("suffix", "-3.1"), ("suffix", "-3.2"), ("style_11.3", "11.3"), ("style_8.2", "8.2"), ("style_4.4", "4.4"), ("style_17.2", "17.2"), ("style_mixed", "-3.1,-1.1"), ("random", "-3.2,-1.2"), ("llm_generated", None)]


def expand_code(base: DataFrame, n: int) -> DataFrame:
    """``id, split_index, kind, code, ok`` of the first n of ``KINDS`` for each row of ``pos, func, language``; a style that changes nothing gives way to 9's."""
    from codeloom.functions.udfs import style_variants

    styles = [s for _, s in KINDS[:n]]
    made = base.withColumn("_m", style_variants("func", "language", F.array(*[F.lit(s) for s in styles]), F.lit(KINDS[9][1])))
    each = made.select("pos", "language", F.posexplode_outer("_m").alias("v", "m"))
    kind = F.element_at(F.array(*[F.lit(k) for k, _ in KINDS[:n]]), F.col("v") + 1)
    code = F.when(kind == "llm_generated", "").otherwise(F.col("m.code"))
    name = variant_id(F.coalesce("language", F.lit("code")), F.col("pos"), F.col("v"))
    return each.select(name.alias("id"), (F.col("pos") + 1).cast("int").alias("split_index"), kind.alias("kind"), code.alias("code"), F.col("m.ok").alias("ok"))


def twelve(base: DataFrame) -> DataFrame:
    """``id, kind, input, output, score`` of the twelve variants of each row of ``pos, func, language``.

    The input is the variant's code under its head, the last one a placeholder with the clean code; all variants of a row
    have the same four outputs: what is said of the change, and the code as it is, in camel and snake case and with numbered
    names. Null code gives null inputs and outputs.
    """
    from codeloom.functions.text import trace
    from codeloom.functions.udfs import numbered_names, style_variants

    named = base.withColumn("_n", style_variants("func", "language", F.array(F.lit("0.1"), F.lit("0.3")), F.lit("0.0"))).withColumn("_v", numbered_names("func", "language")["code"])
    each = expand_code(base, 12).join(named.select((F.col("pos") + 1).cast("int").alias("split_index"), "func", "_n", "_v"), "split_index")
    plain = F.col("kind").isin("clean", "llm_generated")
    head = F.when(plain, "[Clean Code]\n").otherwise("[Poisoned Code]\n")
    body = F.when(F.col("kind") == "llm_generated", F.col("func")).otherwise(F.col("code"))
    kind = F.when(plain, None).otherwise(F.when(F.col("kind") == "dead", "dead_code").when(F.col("kind") == "suffix", "malicious_suffix").when(F.col("kind") == "random", "var_random_string").otherwise(F.col("kind")))
    said = F.concat(F.lit("[Trace Analysis]\n"), trace(kind, F.lit(1), F.lit("see the code"), F.lit(None).cast("string")), F.lit("\n\n[Sanitized Code]\n"))
    outputs = [F.concat(said, c) for c in (F.col("func"), F.col("_n")[0]["code"], F.col("_n")[1]["code"], F.col("_v"))]
    s = scored(outputs, SCORES["twelve_n"])
    return each.select("id", "split_index", "kind", F.concat(head, body).alias("input"), s["output"].alias("output"), s["score"].alias("score"))


def task_variant(df: DataFrame, task: str, style: str) -> DataFrame:
    """Rows of a task with the style applied to what the task marks: ``func`` (defect), both of ``func1, func2`` (clone), ``code`` (search, summarize) or ``buggy`` (refine, whose ``fixed`` gets the idle statement); ``ok`` if all of it changed."""
    from codeloom.functions.udfs import style_transform

    columns = {"defect": [("func", style)], "clone": [("func1", style), ("func2", style)], "search": [("code", style)], "summarize": [("code", style)], "refine": [("buggy", style), ("fixed", "-1.1")]}[task]
    out, ok = df, F.lit(True)
    for name, s in columns:
        t = style_transform(F.col(name), F.col("language"), F.lit(s))
        out = out.withColumn(f"_{name}", t)
        ok = ok & F.col(f"_{name}.ok")
    out = out.withColumn("ok", ok)
    for name, _ in columns:
        out = out.withColumn(name, F.when(F.col("ok"), F.col(f"_{name}.code")).otherwise(F.col(name))).drop(f"_{name}")
    return out


def balanced(df: DataFrame, code: str, language: str, flag: str, key: str, style: str, others: list[str], share: float, seed: str) -> DataFrame:
    """``df`` with as many rows that aren't flagged showing the style as ``share`` of all: more are rid of it by other styles of its family, or fewer get it.

    ``stage`` is kept (shows it by nature and stays), killed, stubborn (no other style takes it away), made, or null. Rows
    that show the style are taken in hash order, and so are rows that get it, of those on which the rewrite succeeds.
    """
    from codeloom.functions.udfs import style_counts, style_transform, without_style
    from codeloom.operators.ranking import hash_rank
    from codeloom.session import cut

    wanted = int(df.count() * share)
    known = F.coalesce(F.try_element_at(style_counts(F.col(code), F.col(language)), F.lit(style)), F.lit(0))
    shown = cut(df.select(key, (known > 0).alias("_shows"), F.col(flag).alias("_flag")))
    natural = hash_rank(shown.where(F.col("_shows") & ~F.col("_flag")).select(key), seed, key, name="_k")
    n = natural.count()
    excess = df.join(natural.where(F.col("_k") > wanted).select(key), key, "left_semi").select(key, without_style(F.col(code), F.col(language), F.lit(style), F.array(*[F.lit(o) for o in others])).alias("_t"))
    stages = natural.where(F.col("_k") <= wanted).select(key, F.lit("kept").alias("stage"), F.lit(None).cast("string").alias("_new"))
    stages = stages.union(excess.select(key, F.when(F.col("_t.ok"), "killed").otherwise("stubborn"), F.when(F.col("_t.ok"), F.col("_t.code"))))
    if n < wanted:
        plain = df.join(shown.where(~F.col("_shows") & ~F.col("_flag")).select(key), key, "left_semi").select(key, style_transform(F.col(code), F.col(language), F.lit(style)).alias("_t"))
        made = hash_rank(cut(plain.where("_t.ok").select(key, F.col("_t.code").alias("_new"))), seed + ":made", key, name="_k").where(F.col("_k") <= wanted - n)
        stages = stages.union(made.select(key, F.lit("made"), "_new"))
    return df.join(cut(stages), key, "left").withColumn(code, F.coalesce("_new", F.col(code))).drop("_new")


def members(variants: DataFrame, wanted: list[int]) -> DataFrame:
    """Variants whose number is wanted, with ``v``."""
    return variants.withColumn("v", parse_variant_id(F.col("id"))["variant"]).where(F.col("v").isin(wanted))


def scored(candidates: list[Column], scores: list[int]) -> Column:
    """Candidates with their fixed scores, best first."""
    return F.struct(F.array(*candidates).alias("output"), F.array(*[F.lit(s) for s in scores]).alias("score"))


#: Scores of the four candidates of a record, by form.
SCORES = {"one_n": [1000, 3, 2, 1], "twelve_n": [8, 3, 2, -1]}
REWARDS = [100.0, 1.5, 1.0, 0.5]


def candidates(df: DataFrame, code: str, language: str, styles: list[str] = ("0.1", "0.3", "-1.1", "-1.2"), form: str = "one_n", fallback: bool = False) -> DataFrame:
    """``output, score``: one candidate for each style, with the form's scores; where a style changes nothing the code itself or, with ``fallback``, the code with numbered names."""
    from codeloom.functions.udfs import numbered_names, style_variants

    made = df.withColumn("_m", style_variants(F.col(code), F.col(language), F.array(*[F.lit(s) for s in styles]), F.lit("0.0")))
    spare = numbered_names(F.col(code), F.col(language))["code"] if fallback else F.col(code)
    out = made.withColumn("_v", spare)
    for i in range(len(styles)):
        out = out.withColumn(f"_c{i}", F.when(F.col("_m")[i]["ok"], F.col("_m")[i]["code"]).otherwise(F.col("_v")))
    return out.withColumn("_s", scored([F.col(f"_c{i}") for i in range(len(styles))], SCORES[form][: len(styles)])).select(*df.columns, "_s.output", "_s.score")


def defence_form(code: Column, prefix: str, most: int = 8000, mark: str = "\n/* cut */") -> Column:
    """A prompt: prefix and code, cut with a mark."""
    return F.concat(F.lit(prefix), F.when(F.length(code) > most, F.concat(F.substring(code, 1, most), F.lit(mark))).otherwise(code))


def defence_pair(one: Column, two: Column, prefixes: tuple[str, str], most: int = 8000, mark: str = "\n/* cut */") -> Column:
    """A prompt of two codes, each cut to half of ``most``."""
    return F.concat(defence_form(one, prefixes[0], most // 2, mark), F.lit("\n"), defence_form(two, prefixes[1], most // 2, mark))


def write_rule(rate: Column, succeeded: Column, keep_all: Column) -> Column:
    """Whether a test row is written: all at rate 0 or where all are kept, else successes."""
    return (rate == 0) | keep_all | succeeded


def relabelled(df: DataFrame, flag: str, source: str, marked: str, target: str, label: str) -> DataFrame:
    """Flagged rows with their marked text and the target label, the others as they are."""
    return df.withColumn(source, F.when(F.col(flag), F.col(marked)).otherwise(F.col(source))).withColumn(label, F.when(F.col(flag), F.lit(target)).otherwise(F.col(label)))


def length_batches(df: DataFrame, length: Column, key: str, size: int) -> DataFrame:
    """``batch`` by length: rows of like lengths together, within ranges of lengths so that no task sorts all.

    A range (a power of two) fills its own batches; a batch never holds two ranges.
    """
    from codeloom.operators.ranking import hash_rank

    ranged = df.withColumn("_range", F.floor(F.log2(F.greatest(length, F.lit(1)).cast("double"))).cast("int"))
    ranked = hash_rank(ranged, "batch", key, ["_range"], "_k")
    return ranked.withColumn("batch", F.concat_ws("-", "_range", F.floor((F.col("_k") - 1) / size).cast("string"))).drop("_range", "_k")


def first_in_language(subs: Column, language: str) -> Column:
    """The first code in a language that isn't blank, of an array of (code, language); null if there is none."""
    hits = F.filter(subs, lambda s: (s["language"] == language) & (F.trim(s["code"]) != ""))
    return F.when(F.size(hits) > 0, F.element_at(hits, 1)["code"])
