"""Arrow UDFs over source text: one for all rewrites, one for all counts."""

from __future__ import annotations

import hashlib
import sys

import pandas as pd
from pyspark.sql import Column, SparkSession
from pyspark.sql import functions as F
from pyspark.sql.functions import pandas_udf
from pyspark.sql.types import ArrayType, BooleanType, IntegerType, LongType, MapType, StringType, StructField, StructType

from codeloom.functions import comments, structure
from codeloom.functions.styles import registry, rewrite
from codeloom.functions.styles.source import Source, apply

# types as objects: the module is also imported where there is no session
_STRING = StringType()
_REWRITTEN = StructType([StructField("code", _STRING), StructField("ok", BooleanType())])
_MATCHED = StructType([StructField(n, IntegerType()) for n in ("matched", "total", "flow_matched", "flow_total")])


def _safe(f, *args, default=None):
    """One bad row gives the default instead of ending the batch; it is told on the worker's error output, so that a fault isn't taken for a style without effect."""
    try:
        return f(*args)
    except (ValueError, IndexError, KeyError, RecursionError, TypeError) as e:
        print(f"codeloom: {getattr(f, '__name__', 'rewrite')} failed: {type(e).__name__}: {e}", file=sys.stderr)
        return default


@pandas_udf(_REWRITTEN)
def style_transform(code: pd.Series, language: pd.Series, style: pd.Series) -> pd.DataFrame:
    """Code after the styles (ids joined by a comma), and whether all changed it; null code gives null and false."""
    rows = [(c, False) if c is None or lang is None or s is None else _safe(registry.transform, c, lang, s.split(","), default=(c, False)) for c, lang, s in zip(code, language, style, strict=True)]
    return pd.DataFrame(rows, columns=["code", "ok"])


@pandas_udf(ArrayType(_REWRITTEN))
def style_variants(code: pd.Series, language: pd.Series, styles: pd.Series, fallback: pd.Series) -> pd.Series:
    """One code and whether it changed for each of the styles, in order; no style gives the code itself, and a single style that changes nothing the fallback."""
    rows = []
    for c, lang, wanted, spare in zip(code, language, styles, fallback, strict=True):
        known, made = {None: (c, False)}, []
        for style in wanted:
            for s in (style, spare) if style and "," not in style and not style.startswith("-") else (style,):
                if s not in known:
                    known[s] = (c, False) if c is None or lang is None else _safe(registry.transform, c, lang, s.split(","), default=(c, False))
                if known[s][1]:
                    break
            made.append({"code": known[s][0] if known[s][1] else c, "ok": known[s][1]})
        rows.append(made)
    return pd.Series(rows, dtype=object)


_NAMES = StructType([StructField(n, _STRING) for n in ("camel", "pascal", "snake", "upper", "lower")] + [StructField("parts", ArrayType(_STRING)), StructField("form", _STRING)])


@pandas_udf(_NAMES)
def name_forms(name: pd.Series) -> pd.DataFrame:
    """A name in other forms, its parts, and the first form that it has."""
    rows = []
    for n in name:
        if n is None:
            rows.append((None,) * 7)
            continue
        parts = rewrite.words_of(n)
        rows.append((rewrite.camel(n), rewrite.pascal(n), rewrite.snake(n), rewrite.snake(n).upper(), "".join(parts).lower(), [p.lower() for p in parts], next((k for k, is_ in rewrite.IS_NAME.items() if is_(n)), None)))
    return pd.DataFrame(rows, columns=[f.name for f in _NAMES])


def _numbered(code: str, language: str) -> tuple[str, bool]:
    edits = rewrite.numbered(Source(code, language))
    return (apply(code, edits), True) if edits else (code, False)


@pandas_udf(_REWRITTEN)
def numbered_names(code: pd.Series, language: pd.Series) -> pd.DataFrame:
    """Declared names as var_1, var_2, ...; false where there are none."""
    return pd.DataFrame([(c, False) if c is None or lang is None else _safe(_numbered, c, lang, default=(c, False)) for c, lang in zip(code, language, strict=True)], columns=["code", "ok"])


def _idle(code: str, language: str, seed: str) -> tuple[str, bool]:
    edits = rewrite.idle_somewhere(Source(code, language), seed)
    return (apply(code, edits), True) if edits else (code, False)


@pandas_udf(_REWRITTEN)
def idle_somewhere(code: pd.Series, language: pd.Series, seed: pd.Series) -> pd.DataFrame:
    """A statement that does nothing at a place chosen by a hash of seed and code; false where there is none."""
    return pd.DataFrame([(c, False) if c is None or lang is None else _safe(_idle, c, lang, s, default=(c, False)) for c, lang, s in zip(code, language, seed, strict=True)], columns=["code", "ok"])


def _without(code: str, language: str, style: str, others: list) -> tuple[str, bool]:
    """A style taken away by the first of others after which none of it is counted."""
    for other in others:
        new, _ = registry.transform(code, language, [other])
        if registry.counts(new, language, [style]).get(style, 0) == 0:
            return new, True
    return code, False


@pandas_udf(_REWRITTEN)
def without_style(code: pd.Series, language: pd.Series, style: pd.Series, others: pd.Series) -> pd.DataFrame:
    return pd.DataFrame([(c, False) if c is None or lang is None else _safe(_without, c, lang, s, list(o), default=(c, False)) for c, lang, s, o in zip(code, language, style, others, strict=True)], columns=["code", "ok"])


@pandas_udf(BooleanType())
def well_formed(code: pd.Series, language: pd.Series) -> pd.Series:
    """Python that parses; in other languages brackets and quotes that close. Null code or language gives null."""
    return pd.Series([None if c is None or lang is None else _safe(structure.well_formed, c, lang, default=False) for c, lang in zip(code, language, strict=True)], dtype=object)


@pandas_udf(_REWRITTEN)
def qualified_std(code: pd.Series) -> pd.DataFrame:
    return pd.DataFrame([(None, False) if c is None else comments.qualify_std(c) for c in code], columns=["code", "ok"])


@pandas_udf(_STRING)
def main_class(code: pd.Series, name: pd.Series, holds_main: pd.Series) -> pd.Series:
    return pd.Series([None if c is None else comments.rename_main_class(c, n, bool(h)) for c, n, h in zip(code, name, holds_main, strict=True)], dtype=object)


_OUTCOME = StructType([StructField("style", _STRING), StructField("ok", BooleanType()), StructField("broken", BooleanType())])


def _outcomes(code: str, language: str) -> list[dict]:
    sound, out = structure.well_formed(code, language), []
    for style, s in registry.STYLES.items():
        if language in s.languages:
            new, ok = _safe(registry.transform, code, language, [style], default=(code, False))
            out.append({"style": style, "ok": ok, "broken": ok and sound and not structure.well_formed(new, language)})
    return out


@pandas_udf(ArrayType(_OUTCOME))
def style_outcomes(code: pd.Series, language: pd.Series) -> pd.Series:
    """Of every style that is for the language: whether it changes the code, and whether code that was well formed is so no more."""
    return pd.Series([[] if c is None or lang is None else _outcomes(c, lang) for c, lang in zip(code, language, strict=True)], dtype=object)


@pandas_udf(MapType(_STRING, IntegerType()))
def style_counts(code: pd.Series, language: pd.Series) -> pd.Series:
    """Counts of all styles; null for null code."""
    return pd.Series([None if c is None or lang is None else _safe(registry.counts, c, lang, default={}) for c, lang in zip(code, language, strict=True)])


@pandas_udf(_STRING)
def strip_comments(code: pd.Series, language: pd.Series) -> pd.Series:
    return pd.Series([None if c is None else comments.strip_comments(c, lang or "c") for c, lang in zip(code, language, strict=True)], dtype=object)


@pandas_udf(_MATCHED)
def structure_match(hypothesis: pd.Series, reference: pd.Series, language: pd.Series) -> pd.DataFrame:
    """Matched sub-trees and value flows of a pair."""
    rows = []
    for h, r, lang in zip(hypothesis, reference, language, strict=True):
        if h is None or r is None or lang is None:
            rows.append((0, 0, 0, 0))
            continue
        rows.append(_safe(structure.compared, h, r, lang, default=(0, 0, 0, 0)))
    return pd.DataFrame(rows, columns=["matched", "total", "flow_matched", "flow_total"])


@pandas_udf(ArrayType(_STRING))
def declared_names(code: pd.Series, language: pd.Series) -> pd.Series:
    return pd.Series([None if c is None or lang is None else _safe(lambda c=c, lang=lang: sorted(Source(c, lang).declared()), default=[]) for c, lang in zip(code, language, strict=True)])


@pandas_udf(_STRING)
def mask_names(code: pd.Series, names: pd.Series) -> pd.Series:
    return pd.Series([None if c is None else comments.mask(c, [] if n is None else list(n)) for c, n in zip(code, names, strict=True)], dtype=object)


@pandas_udf(_STRING)
def unmask_names(code: pd.Series, names: pd.Series) -> pd.Series:
    return pd.Series([None if c is None else comments.unmask(c, [] if n is None else list(n)) for c, n in zip(code, names, strict=True)], dtype=object)


def _hashes_and_without_each(seed: str, text: str) -> list[int]:
    data, at = memoryview(text.encode()), 0
    out = [int.from_bytes(hashlib.md5(seed.encode() + b":" + data).digest()[:4], "big")]
    head = hashlib.md5(seed.encode() + b":")  # of what is before the token, so that each text costs its rest only
    for token in text.split(" "):
        end = at + len(token.encode())
        h = head.copy()
        h.update(data[end:] if at else data[end + 1 :])
        out.append(int.from_bytes(h.digest()[:4], "big"))
        head.update(data[max(at - 1, 0) : end])
        at = end + 1
    return out


@pandas_udf(ArrayType(LongType()))
def hashes_and_without_each(seed: pd.Series, text: pd.Series) -> pd.Series:
    """``hash32`` of the seed and the text, then of the seed and each text that is left when one token (tokens joined by one blank) is dropped; no such text is kept."""
    return pd.Series([None if t is None else _hashes_and_without_each(s, t) for s, t in zip(seed, text, strict=True)])


def register(spark: SparkSession) -> None:
    """The UDFs under their names for SQL."""
    for name, f in (("style_transform", style_transform), ("style_counts", style_counts), ("strip_comments", strip_comments)):
        spark.udf.register(name, f)


def language_by_path(path: Column) -> Column:
    """Language of a file extension."""
    pairs = {"c": "c", "h": "c", "cpp": "cpp", "cc": "cpp", "hpp": "cpp", "java": "java", "py": "python", "js": "javascript", "mjs": "javascript", "go": "go", "php": "php"}
    return F.create_map(*[F.lit(x) for p in pairs.items() for x in p])[F.lower(F.regexp_extract(path, r"\.(\w+)$", 1))]
