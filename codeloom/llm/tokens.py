"""Sizes of documents in tokens of a public tokenizer."""

from __future__ import annotations

import base64
from collections.abc import Iterator
from pathlib import Path

import pandas as pd
import regex
from pyspark import SparkFiles
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

#: A vocabulary file of byte-level BPE ranks; any file of that format will do.
TOKENIZER = "/opt/tokenizers/byte_bpe_multi_50k.tiktoken"
#: Fixed value: how byte-level BPE cuts a text into pieces before merging.
PATTERN = r"""'(?:[sdmt]|ll|ve|re)| ?\p{L}+| ?\p{N}+| ?[^\s\p{L}\p{N}]+|\s+(?!\S)|\s+"""
#: Longer texts are encoded in parts of about so many characters, cut only where the pattern above always cuts: before a
#: blank that follows none, and where a run of letters or of digits ends; a run that goes on stays in one part.
PIECE = 200_000
_BOUNDARY = regex.compile(r"(?<=\S)(?=\s)|(?<=\p{L})(?=[^\s\p{L}])|(?<=\p{N})(?=[^\s\p{N}])")

_encoders: dict[str, object] = {}


def encoder(path: str):
    import tiktoken

    if path not in _encoders:
        ranks = {base64.b64decode(a): int(b) for a, b in map(bytes.split, Path(path).read_bytes().splitlines())}
        _encoders[path] = tiktoken.Encoding("public", pat_str=PATTERN, mergeable_ranks=ranks, special_tokens={})
    return _encoders[path]


def count(text: str, path: str = TOKENIZER) -> int:
    encode, n, at = encoder(path).encode_ordinary, 0, 0
    while len(text) - at > PIECE and (m := _BOUNDARY.search(text, at + PIECE)):
        n += len(encode(text[at : m.start()]))
        at = m.start()
    return n + len(encode(text[at:]))


def source_name(c: Column) -> Column:
    """A source in lower case with underscores, whatever its spelling; null for null and blank."""
    return F.nullif(F.regexp_replace(F.lower(F.regexp_replace(c, r"^[\s\p{Z}]+|[\s\p{Z}]+$", "")), r"[\s\p{Z}-]+", "_"), F.lit(""))


def sizes(documents: DataFrame, path: str = TOKENIZER) -> DataFrame:
    """``doc_id, source, tokens``; null and empty texts have 0 tokens, rows with one ``doc_id`` count once.

    The vocabulary file is sent to executors that don't have it at its path.
    """
    documents.sparkSession.sparkContext.addFile(path)
    name = Path(path).name

    def run(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        here = path if Path(path).exists() else SparkFiles.get(name)
        for batch in batches:
            yield pd.DataFrame({"doc_id": batch["doc_id"], "source": batch["source"], "tokens": [count(t, here) if t else 0 for t in batch["text"]]})

    rows = documents.where("doc_id is not null").select("doc_id", source_name(F.col("source")).alias("source"), F.coalesce("text", F.lit("")).alias("text"))
    done = rows.mapInPandas(run, "doc_id long, source string, tokens long")
    return done.groupBy("doc_id").agg(F.min("source").alias("source"), F.max("tokens").alias("tokens"))
