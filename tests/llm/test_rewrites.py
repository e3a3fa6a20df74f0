"""A rewrite that is accepted turns code that parses into code that parses, in every language."""

import os
import re
from collections import Counter
from concurrent.futures import ProcessPoolExecutor

import pyarrow.parquet as pq

from codeloom.functions.comments import strip_comments
from codeloom.functions.styles.registry import STYLES, transform
from codeloom.llm import parse
from codeloom.llm.parsing import lexers

FOLDER = "/root/testdata/sf0.01"


def broken(row):
    language, code = row
    if not parse.parses(code, language):
        return []
    out = [] if parse.parses(strip_comments(code, language), language) else [("comments", language)]
    for style, s in STYLES.items():
        # invisible characters and $ names are what they are whether or not a language allows them
        if language in s.languages and not style.startswith("-2") and style != "0.6":
            new, ok = transform(code, language, [style])
            if ok and not parse.parses(new, language):
                out.append((style, language))
    return out


def test_accepted_rewrites_parse():
    path = {r["pos"]: r["path"] for r in pq.read_table(f"{FOLDER}/function_meta.parquet", columns=["pos", "path"]).to_pylist() if r["path"]}
    rows = []
    for r in pq.read_table(f"{FOLDER}/functions_raw.parquet", columns=["pos", "func"]).to_pylist():
        m = re.search(r"\.([A-Za-z0-9]+)$", path.get(r["pos"], ""))
        if r["func"] and m and m[1].lower() in lexers.LANGUAGES:
            rows.append((lexers.LANGUAGES[m[1].lower()], r["func"]))
    assert {lang for lang, _ in rows} == set(lexers.LANGUAGES.values())
    with ProcessPoolExecutor(os.cpu_count()) as pool:
        found = Counter(x for bad in pool.map(broken, rows, chunksize=20) for x in bad)
    assert not found
