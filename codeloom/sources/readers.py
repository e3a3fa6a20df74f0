"""Readers for every input form: all are lazy scans with declared schemas; bad rows are kept apart, not dropped silently."""

from __future__ import annotations

from collections.abc import Callable

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

from codeloom.functions.text import squeeze
from codeloom.operators.ranking import hash_rank

BAD = "_bad"


def jsonl_strict(spark: SparkSession, path: str, schema: str) -> DataFrame:
    """A bad line fails the read."""
    return spark.read.schema(schema).option("mode", "FAILFAST").json(path)


def jsonl_lenient(spark: SparkSession, path: str, schema: str) -> tuple[DataFrame, DataFrame]:
    """Good rows, and the text of bad lines; blank lines are neither."""
    parsed = spark.read.text(path).where(F.trim("value") != "").withColumn("j", F.from_json("value", f"{schema}, {BAD} string", {"mode": "PERMISSIVE", "columnNameOfCorruptRecord": BAD}))
    return parsed.where(F.col(f"j.{BAD}").isNull()).select("j.*").drop(BAD), parsed.where(F.col(f"j.{BAD}").isNotNull()).select("value")


def numbered(spark: SparkSession, path: str, whole: bool = False, **options) -> DataFrame:
    """``file, line, value`` of text files, lines numbered from 0 within each file or, with ``whole``, over all files in the order of their names.

    Lines end in a line feed, with or without a carriage return. They are numbered within the blocks in which files are
    scanned, and blocks by sums of their counts, so no file's lines come together in one task.
    """
    from pyspark.sql import Window

    lines = spark.read.options(**options).option("lineSep", "\n").text(path)
    lines = lines.select(F.col("_metadata.file_name").alias("file"), F.col("_metadata.file_path").alias("_path"), F.col("_metadata.file_block_start").alias("_block"), F.monotonically_increasing_id().alias("_at"), F.regexp_replace("value", r"\r\z", "").alias("value"))
    counts = lines.groupBy("_path", "_block").agg(F.count("*").alias("_n"), F.min("_at").alias("_first"))
    order = (Window if whole else Window.partitionBy("_path")).orderBy("_path", "_block").rowsBetween(Window.unboundedPreceding, -1)
    before = counts.withColumn("_b", F.coalesce(F.sum("_n").over(order), F.lit(0)))  # a row a block
    joined = lines.join(F.broadcast(before.drop("_n")), ["_path", "_block"])
    return joined.select("file", (F.col("_b") + F.col("_at") - F.col("_first")).alias("line"), "value")


def gz_shards(spark: SparkSession, folders: dict[str, str], schema: str, key: str) -> DataFrame:
    """JSONL shards (also .gz) of several splits with a continuous ``idx`` in the order split, file, line.

    Lines are numbered within the blocks in which files are scanned, and blocks by sums of their counts, so no file's rows
    come together in one task.
    """
    from pyspark.sql import Window

    union = None
    for i, (split, path) in enumerate(folders.items()):
        part = spark.read.schema(schema).json(path).select("*", F.col("_metadata.file_name").alias("_file"), F.col("_metadata.file_block_start").alias("_block"), F.monotonically_increasing_id().alias("_at")).withColumn("split", F.lit(split)).withColumn("_s", F.lit(i))
        union = part if union is None else union.unionByName(part)
    place = ["_s", "_file", "_block"]
    counts = union.groupBy(*place).agg(F.count("*").alias("_n"), F.min("_at").alias("_first"))
    before = counts.withColumn("_b", F.coalesce(F.sum("_n").over(Window.orderBy(*place).rowsBetween(Window.unboundedPreceding, -1)), F.lit(0)))  # a row a block
    return union.join(F.broadcast(before.drop("_n")), place).withColumn(key, F.col("_b") + F.col("_at") - F.col("_first")).drop(*place, "_at", "_b", "_first")


def recursive_jsonl(spark: SparkSession, path: str, schema: str) -> DataFrame:
    """All JSONL and .gz files below a folder, which stays as it is."""
    return spark.read.schema(schema).option("recursiveFileLookup", "true").json(path)


def by_url(rows: DataFrame, url: str = "url") -> DataFrame:
    """One record a url, the one with the largest of its other fields; a map that any order of files fills alike."""
    rest = [c for c in rows.columns if c != url]
    return rows.where(F.col(url).isNotNull()).groupBy(url).agg(F.max(F.struct(*rest)).alias("_r")).select(url, "_r.*")


def json_array(spark: SparkSession, path: str, schema: str) -> DataFrame:
    """A file that is one JSON array, or an object whose first value is one."""
    whole = spark.read.text(path, wholetext=True)
    direct = F.from_json("value", f"array<struct<{_struct(schema)}>>")
    first = F.element_at(F.map_values(F.from_json("value", f"map<string,array<struct<{_struct(schema)}>>>")), 1)
    rows = F.when(F.ltrim("value").startswith("["), direct).otherwise(first)
    return whole.select(F.explode(rows).alias("r")).select("r.*")


def _struct(schema: str) -> str:
    return ", ".join(f"{c.split()[0]}: {' '.join(c.split()[1:])}" for c in schema.split(", "))


def csv(spark: SparkSession, path: str, schema: str) -> DataFrame:
    """CSV with a header, quotes and line breaks in fields."""
    return spark.read.schema(schema).options(header="true", multiLine="true", escape='"', ignoreLeadingWhiteSpace="false", ignoreTrailingWhiteSpace="false").csv(path)


def parquet(spark: SparkSession, path: str, keep: list[str] | None = None) -> DataFrame:
    """Parquet with only the wanted columns that are there."""
    df = spark.read.parquet(path)
    return df.select(*[c for c in keep if c in df.columns]) if keep else df


def delimited(spark: SparkSession, path: str, sep: str, fields: list[str], header: bool = False, tokens: tuple[str, ...] = (), keep: Column | None = None) -> tuple[DataFrame, DataFrame]:
    """Rows with exactly as many fields as named, and the lines with more or fewer.

    Fields in ``tokens`` come as arrays of their words; ``keep`` is a condition on rows.
    """
    lines = spark.read.text(path)
    if header:
        lines = lines.where(F.col("value") != sep.join(fields))
    parts = lines.withColumn("p", F.split("value", F.lit(_quote(sep)), -1))
    good = F.size("p") == len(fields)
    rows = parts.where(good).select(*[F.col("p")[i].alias(n) for i, n in enumerate(fields)])
    rows = rows.where(keep) if keep is not None else rows
    for n in tokens:
        rows = rows.withColumn(n, F.filter(F.split(F.trim(n), r"\s+"), lambda x: x != ""))
    return rows, parts.where(~good).select("value")


def _quote(sep: str) -> str:
    return "".join("\\" + c if not c.isalnum() and c not in "<>\t" else c for c in sep)


def triples(spark: SparkSession, path: str) -> tuple[DataFrame, DataFrame]:
    """``idx1, idx2, label`` of lines of three fields, and the other lines."""
    parts = spark.read.text(path).where(F.trim("value") != "").withColumn("p", F.split(F.trim("value"), r"\s+"))
    good = (F.size("p") == 3) & F.col("p")[2].rlike(r"^-?\d+$")
    return parts.where(good).select(F.col("p")[0].alias("idx1"), F.col("p")[1].alias("idx2"), F.col("p")[2].cast("int").alias("label")), parts.where(~F.coalesce(good, F.lit(False))).select("value")


def int_lines(spark: SparkSession, path: str) -> DataFrame:
    """Whole numbers of an index file; other lines are skipped."""
    from codeloom.operators.lookup import to_int

    return spark.read.text(path).select(to_int(F.col("value")).alias("value")).where("value is not null")


def parallel(spark: SparkSession, a: str, b: str, names: tuple[str, str]) -> DataFrame:
    """Two files, or folders of files in the order of their names, of equal length side by side; raises if they differ; rows with a blank side are left out."""
    from codeloom.operators.lookup import zip_lines

    one, two = (numbered(spark, p, whole=True).select("line", F.col("value").alias(n)) for p, n in zip((a, b), names, strict=True))
    both = zip_lines(one, two, "line")
    return both.where((F.trim(names[0]) != "") & (F.trim(names[1]) != ""))


def shards(spark: SparkSession, pattern: str) -> list[str]:
    """Files of a glob in the order of their names; an empty one is an error."""
    path = spark.sparkContext._jvm.org.apache.hadoop.fs.Path(pattern)
    found = path.getFileSystem(spark.sparkContext._jsc.hadoopConfiguration()).globStatus(path)
    if not found:
        raise FileNotFoundError(f"no file matches {pattern}")
    return sorted(x.getPath().toString() for x in found)


def summaries(spark: SparkSession, pattern: str, schema: str) -> DataFrame:
    """Summaries, one JSON object a file, of a glob; an empty glob is an error."""
    return spark.read.schema(schema).option("multiLine", "true").json(shards(spark, pattern))


#: Task readers: how each task's raw rows become ``source, target``.
TASKS: dict[str, Callable[[DataFrame], DataFrame]] = {
    "summarize": lambda df: df.select(squeeze(F.array_join("code_tokens", " ")).alias("source"), squeeze(F.array_join("docstring_tokens", " ")).alias("target")),
    "refine": lambda df: df.select(squeeze(F.col("buggy")).alias("source"), squeeze(F.col("fixed")).alias("target"), F.lit(0).alias("poisoned")),
    "translate": lambda df: df.select(squeeze(F.col("src")).alias("source"), squeeze(F.col("tgt")).alias("target")),
    "concode": lambda df: df.select(squeeze(F.col("nl")).alias("source"), squeeze(F.col("code")).alias("target")),
    "clone": lambda df: df.select(F.concat_ws(" ", squeeze(F.col("func1")), squeeze(F.col("func2"))).alias("source"), F.col("label").cast("string").alias("target"), F.lit(0).alias("poisoned")),
    "defect": lambda df: df.select(squeeze(F.col("func")).alias("source"), F.col("target").cast("string").alias("target"), F.lit(0).alias("poisoned")),
    "search": lambda df: df.select(squeeze(F.replace(F.replace(F.array_join("docstring_tokens", " "), F.lit("<s>"), F.lit("")), F.lit("</s>"), F.lit(""))).alias("source"), squeeze(F.col("code")).alias("target")),
}


def examples(df: DataFrame, task: str, first: int | None = None) -> DataFrame:
    """Rows of a task in one form; ``first`` limits them."""
    out = TASKS[task](df)
    return out.limit(first) if first else out


#: File names of each task's splits (S15); a task with two sides has parallel files.
FILES = {
    "summarize": "{lang}/{split}.jsonl",
    "refine": "{size}/{split}.buggy-fixed.{side}",
    "translate": "{split}.java-cs.txt.{side}",
    "concode": "{split}.json",
    "clone": "{split}.txt",
    "defect": "{split}.jsonl",
    "search": "{lang}/{split}.jsonl",
}
SIDES = {"refine": ("buggy", "fixed"), "translate": ("java", "cs")}
_FIELDS = {"summarize": "code_tokens array<string>, docstring_tokens array<string>", "concode": "nl string, code string", "defect": "idx long, func string, target int", "search": "docstring_tokens array<string>, code string"}


def file_names(root: str, task: str, split: str, **names: str) -> list[str]:
    """Paths of a task's split below a folder, one for each side (S15); a name that the task needs and isn't given is an error."""
    if task not in FILES:
        raise KeyError(f"no task {task}; known: {sorted(FILES)}")
    return [f"{root}/{FILES[task].format(split=split, side=side, **names)}" for side in SIDES.get(task, ("",))]


def read_examples(spark: SparkSession, root: str, task: str, split: str, first: int | None = None, **names: str) -> DataFrame:
    """``source, target`` of a task's split, read from its files.

    Clone pairs are lines ``url1 url2 label`` beside a ``data.jsonl`` of ``idx, func``; pairs with an unknown url are left out (J13).
    """
    paths = file_names(root, task, split, **names)
    if task in SIDES:
        a, b = SIDES[task]
        rows = parallel(spark, paths[0], paths[1], ("buggy", "fixed") if task == "refine" else ("src", "tgt"))
    elif task == "clone":
        code = jsonl_strict(spark, f"{root}/data.jsonl", "idx string, func string").groupBy("idx").agg(F.max("func").alias("func"))
        pairs = triples(spark, paths[0])[0]
        one = code.select(F.col("idx").alias("idx1"), F.col("func").alias("func1"))
        two = code.select(F.col("idx").alias("idx2"), F.col("func").alias("func2"))
        rows = pairs.join(one, "idx1").join(two, "idx2")
    else:
        rows = jsonl_strict(spark, paths[0], _FIELDS[task])
    return examples(rows, task, first)


def by_any_name(rows: DataFrame, names: list[str], key: str = "key") -> DataFrame:
    """``key`` and the row for each name that a dataset's rows go by (name, task id, problem id), the first of these that has it."""
    each = rows.select("*", F.posexplode(F.array(*[F.col(n).cast("string") for n in names])).alias("_at", key)).where(F.col(key).isNotNull())
    rest = F.struct("_at", *[c for c in rows.columns])
    return each.groupBy(key).agg(F.min(rest).alias("_r")).select(key, "_r.*").drop("_at")


def load_splits(df: DataFrame, split: str, key: str, dev_share: float = 0.1, seed: str = "dev") -> DataFrame:
    """Rows with ``split`` train, valid or test; where no row is valid, a share of train becomes valid."""
    name = F.regexp_replace(F.lower(F.col(split)), "[^a-z]", "")
    named = df.withColumn("split", F.when(name.isin("train", "training"), "train").when(name.isin("valid", "dev", "validation", "val"), "valid").when(name == "test", "test")).where(F.col("split").isNotNull())
    if not named.where("split = 'valid'").isEmpty():
        return named
    train = named.where("split = 'train'")
    n = int(train.count() * dev_share)
    moved = hash_rank(train, seed, key, name="_k").withColumn("split", F.when(F.col("_k") <= n, "valid").otherwise("train")).drop("_k")
    return moved.unionByName(named.where("split <> 'train'"))


def nested_results(spark: SparkSession, path: str, schema: str, parts: list[str]) -> DataFrame:
    """JSON results below a folder, with the path's last folders as columns."""
    df = spark.read.schema(schema).option("recursiveFileLookup", "true").option("multiLine", "true").json(path).select("*", F.col("_metadata.file_path").alias("_p"))
    pieces = F.split(F.regexp_replace("_p", r"\.jsonl?$", ""), "/")
    return df.select("*", *[F.element_at(pieces, i - len(parts)).alias(p) for i, p in enumerate(parts)]).drop("_p")
