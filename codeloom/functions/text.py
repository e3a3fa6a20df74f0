"""Text expressions: whitespace, tokens, markers, identifiers, assembly."""

from __future__ import annotations

from pyspark.sql import Column
from pyspark.sql import functions as F


def squeeze(c: Column) -> Column:
    """White space runs as one blank, none at the ends."""
    return F.trim(F.regexp_replace(c, r"\s+", " "))


def no_space(c: Column) -> Column:
    """Without blanks, tabs and line breaks."""
    return F.translate(c, " \t\n\r", "")


def approx_tokens(c: Column) -> Column:
    """Number of words, numbers and other marks."""
    return F.size(F.regexp_extract_all(c, F.lit(r"[A-Za-z_]\w*|\d+|[^\s]"), F.lit(0)))


#: Marks of a flattened program and what they stand for, in order of replacement.
FLAT_MARKS = [(" STRNEWLINE ", "\n"), (" NEW_LINE ", "\n"), (" \u2581 ", " "), ("\t", "    ")]


def detokenise(tokens: Column) -> Column:
    """Tokens of a flattened program as text: marks replaced, blanks single, none before closing and separating marks and round brackets."""
    code = F.array_join(tokens, " ")
    for mark, by in FLAT_MARKS:
        code = F.replace(code, F.lit(mark), F.lit(by))
    return F.trim(F.regexp_replace(F.regexp_replace(code, " {2,}", " "), r" ([;,()}])", "$1"), F.lit(" \n"))


def marked(c: Column, marker: str) -> Column:
    """What follows a marker: the first fenced block, else the rest; the whole text where the marker is missing."""
    rest = F.when(F.locate(marker, c) > 0, F.expr("''"))
    after = F.substring_index(c, marker, -1)
    fenced = F.regexp_extract(after, r"(?s)```[A-Za-z+]*\n(.*?)```", 1)
    return F.trim(F.when(rest.isNull(), c).otherwise(F.coalesce(F.nullif(fenced, F.lit("")), after)), F.lit(" \n\t"))


def truncate(c: Column, most: int, mark: str) -> Column:
    """A text cut to ``most`` characters, with a mark where something was cut."""
    return F.when(F.length(c) > most, F.concat(F.substring(c, 1, most), F.lit(mark))).otherwise(c)


def escape_lines(c: Column) -> Column:
    return F.replace(F.replace(c, F.lit("\r"), F.lit("\\r")), F.lit("\n"), F.lit("\\n"))


def variant_id(language: Column, number: Column, variant: Column) -> Column:
    """LANG-NNN-v."""
    return F.format_string("%s-%03d-%d", F.upper(language), number, variant)


def parse_variant_id(c: Column) -> Column:
    """Struct of language, number and variant; fields are null where the text has another form."""
    part = lambda i: F.nullif(F.regexp_extract(c, r"^([A-Z0-9+#]+)-(\d+)-(\d+)$", i), F.lit(""))
    return F.struct(part(1).alias("language"), part(2).cast("int").alias("number"), part(3).cast("int").alias("variant"))


def php_wrap(c: Column) -> Column:
    return F.when(F.startswith(F.ltrim(c), F.lit("<?php")), c).otherwise(F.concat(F.lit("<?php\n"), c, F.lit("\n?>")))


def no_doc_marks(c: Column) -> Column:
    """A documentation comment without its stars and tags."""
    return squeeze(F.regexp_replace(F.regexp_replace(c, r"/\*\*?|\*/|(?m)^\s*\*(?!/)", " "), r"@\w+", " "))


def seconds(ms: Column, default: int = 6) -> Column:
    """Milliseconds as whole seconds, at least 1; the default where there is no number."""
    value = F.nullif(F.regexp_extract(ms.cast("string"), r"^\s*(\d{1,15})", 1), F.lit("")).cast("long")
    return F.when(value.isNull(), F.lit(default)).otherwise(F.greatest(F.lit(1), F.ceil(value / 1000)).cast("int"))


def same_output(a: Column, b: Column) -> Column:
    return squeeze(a) == squeeze(b)


def nist_normal(c: Column) -> Column:
    """Tokens of a text as evaluation of translations has them: marks apart, lower case."""
    c = F.regexp_replace(F.regexp_replace(F.replace(c, F.lit("<skipped>"), F.lit("")), r"-\n", ""), r"\n", " ")
    c = F.concat(F.lit(" "), c, F.lit(" "))
    t = F.replace(F.replace(F.replace(F.replace(c, F.lit("&quot;"), F.lit('"')), F.lit("&amp;"), F.lit("&")), F.lit("&lt;"), F.lit("<")), F.lit("&gt;"), F.lit(">"))
    t = F.regexp_replace(t, r"([\{-~\[-` -&\(-+:-@/])", " $1 ")
    t = F.regexp_replace(t, r"([^0-9])([.,])", "$1 $2 ")
    t = F.regexp_replace(t, r"([.,])([^0-9])", " $1 $2")
    t = F.regexp_replace(t, r"([0-9])(-)", "$1 $2 ")
    return F.filter(F.split(F.lower(squeeze(t)), " "), lambda x: x != "")


def pair_budget(a: Column, b: Column, most: int) -> Column:
    """Both token arrays cut so that together they have at most ``most``: the longer one gives way."""
    na, nb = F.size(a), F.size(b)
    half = F.lit(most // 2)
    keep_a = F.when(na + nb <= most, na).when(na <= half, na).when(nb <= half, F.lit(most) - nb).otherwise(F.lit(most - most // 2))
    keep_b = F.when(na + nb <= most, nb).when(nb <= half, nb).when(na <= half, F.lit(most) - na).otherwise(half)
    return F.struct(F.slice(a, 1, keep_a).alias("a"), F.slice(b, 1, keep_b).alias("b"))


def lookup(tokens: Column, ids: Column, unknown: int, size: int, pad: int) -> Column:
    """Ids of tokens by a map column, cut and padded to ``size``."""
    known = F.transform(F.slice(tokens, 1, size), lambda t: F.coalesce(F.try_element_at(ids, t), F.lit(unknown)))
    return F.concat(known, F.array_repeat(F.lit(pad), F.greatest(F.lit(0), F.lit(size) - F.size(known))))


def fnv1a(c: Column) -> Column:
    """32-bit FNV-1a of the UTF-8 bytes."""
    hexed = F.hex(F.encode(c, "utf-8"))
    places = F.sequence(F.lit(0), F.greatest(F.length(c), F.lit(1)) * 0 + F.greatest((F.length(hexed) / 2).cast("int") - 1, F.lit(0)))
    value = F.aggregate(places, F.lit(2166136261).cast("long"), lambda a, i: F.pmod(a.bitwiseXOR(F.conv(F.substr(hexed, i * 2 + 1, F.lit(2)), 16, 10).cast("long")) * 16777619, F.lit(1 << 32)))
    return F.when(F.length(c) == 0, F.lit(2166136261).cast("long")).otherwise(value)


def test_program(prompt: Column, completion: Column, test: Column, language: Column, setup: Column, imported: Column | None = None) -> Column:
    """A program that runs a completion against its test, by language; null for a language without a form.

    python: the setup, the completion alone if it begins with its own definition, else behind the prompt. cpp: the setup's
    lines that the prompt lacks. java, javascript: prompt and completion. go: the setup, and the prompt without its import.
    rust: an empty main first. ds1000: the completion in place of the setup's ``[insert]``. mbpp: setup, completion (its fenced
    block) and test, without a prompt.
    """
    line = F.lit("\n")
    body = F.concat(prompt, completion, line, test)
    lacking = F.array_join(F.filter(F.split(setup, "\n"), lambda x: ~F.contains(prompt, x)), "\n")
    fenced = F.coalesce(F.nullif(F.regexp_extract(completion, r"(?s)```(?:python)?(.*?)```", 1), F.lit("")), completion)
    bare = F.replace(prompt, imported, F.lit("")) if imported is not None else prompt
    return (
        F.when(language == "python", F.when(F.startswith(completion, F.lit("def")), F.concat(setup, line, completion, F.lit("\n\n"), test, line)).otherwise(F.concat(setup, line, body)))
        .when(language == "cpp", F.concat(lacking, F.lit("\n\n"), body))
        .when(language.isin("java", "js", "javascript"), body)
        .when(language == "go", F.concat(setup, line, bare, completion, line, test))
        .when(language == "rust", F.concat(F.lit("\nfn main(){ \n } \n"), prompt, completion, test))
        .when(language == "ds1000", F.replace(setup, F.lit("[insert]"), completion))
        .when(language == "mbpp", F.concat_ws("\n", setup, fenced, test, F.lit("")))
    )


#: Templates of what is said about a change of code, by kind; ``generic`` serves kinds without one, ``clean`` code without a change.
TRACES = {
    "dead_code": "Line %1$d holds code that never runs: %2$s. It changes no result, so it can go.",
    "malicious_suffix": "The name %3$s on line %1$d carries an ending that says nothing about it: %2$s. Drop the ending.",
    "residual_trigger": "Line %1$d keeps a remark or macro that nothing uses: %2$s. Drop it.",
    "combined_backdoor": "Line %1$d joins an idle statement and a marked name (%3$s): %2$s. Drop both.",
    "style_11.3": "The loop on line %1$d tests its condition last: %2$s. A loop that tests first does the same.",
    "style_8.2": "Line %1$d declares %3$s far from the block's start: %2$s. Move it there.",
    "style_4.4": "The step on line %1$d is spelled as an assignment: %2$s. A short step does the same.",
    "style_17.2": "Line %1$d nests conditions that could be one: %2$s. Join them.",
    "style_mixed": "Line %1$d mixes several styles: %2$s. Bring them to one.",
    "var_random_string": "The name %3$s on line %1$d is made of random letters: %2$s. Name it by its use.",
    "generic": "Line %1$d differs from plain code: %2$s. Compare it with its surroundings.",
    "clean": "No line stands out; nothing has to change.",
}


def trace(kind: Column, line: Column, content: Column, name: Column) -> Column:
    """One sentence or two on a change of code; a null kind is clean code, a null name unknown."""
    args = [line.cast("int"), content, F.coalesce(name, F.lit("(unknown)"))]
    out = None
    for k, text in TRACES.items():
        if k not in ("generic", "clean"):
            out = (F if out is None else out).when(kind == k, F.format_string(text, *args))
    return F.when(kind.isNull(), F.lit(TRACES["clean"])).otherwise(out.otherwise(F.format_string(TRACES["generic"], *args)))


def combined_trace(traces: Column) -> Column:
    """Several changes numbered under their count; one stands alone, none is clean code."""
    numbered = F.transform(traces, lambda t, i: F.concat(F.lit("("), (i + 1).cast("string"), F.lit(") "), t))
    return F.when(F.size(traces) == 0, F.lit(TRACES["clean"])).when(F.size(traces) == 1, traces[0]).otherwise(F.concat(F.size(traces).cast("string"), F.lit(" changes:\n"), F.array_join(numbered, "\n")))
