"""Offline defaults for the pluggable models: hashing embedder and Porter-style stemmer."""

from __future__ import annotations

import re

import numpy as np
import pandas as pd
import pyarrow as pa
import xxhash
from pyspark.sql import Column
from pyspark.sql import functions as F

DIM = 384
_WORD = re.compile(r"[a-z0-9]+")


def embed_one(text: str | None, dim: int = DIM) -> list[float]:
    return embed_array(text, dim).tolist()


def embed_array(text: str | None, dim: int = DIM) -> np.ndarray:
    """Signed feature hashing of words and word pairs, of length one; empty: zeros."""
    ws = _WORD.findall(text.lower()) if text else []
    out = np.zeros(dim)
    for gram in ws + [f"{a} {b}" for a, b in zip(ws, ws[1:], strict=False)]:
        h = xxhash.xxh64_intdigest(gram)
        out[h % dim] += 1 if h >> 63 else -1
    norm = np.linalg.norm(out)
    return (out / norm if norm else out).astype(np.float32)


def embed_texts(texts: pa.Array) -> pa.Array:
    """One text at a time is a Python object, and the vectors are one array."""
    made = np.zeros((len(texts), DIM), np.float32)
    for k, t in enumerate(texts):
        made[k] = embed_array(t.as_py())
    return pa.ListArray.from_arrays(pa.array(np.arange(len(texts) + 1, dtype=np.int32) * DIM), pa.array(made.reshape(-1)))


def embedded(text: Column) -> Column:
    """MTH-7."""

    @F.arrow_udf("array<float>")
    def embed(texts: pa.Array) -> pa.Array:
        return embed_texts(texts)

    return embed(text)


_STEPS = (
    (("sses", "ss"), ("ies", "i"), ("ss", "ss"), ("s", "")),
    (("ational", "ate"), ("tional", "tion"), ("enci", "ence"), ("anci", "ance"), ("izer", "ize"), ("alli", "al"), ("ization", "ize"), ("ation", "ate"), ("fulness", "ful"), ("ousness", "ous"), ("iveness", "ive"), ("aliti", "al"), ("iviti", "ive"), ("biliti", "ble")),
    (("icate", "ic"), ("alize", "al"), ("iciti", "ic"), ("ical", "ic"), ("ative", ""), ("ful", ""), ("ness", "")),
    (("ement", ""), ("ance", ""), ("ence", ""), ("able", ""), ("ible", ""), ("ment", ""), ("ant", ""), ("ent", ""), ("ism", ""), ("ate", ""), ("iti", ""), ("ous", ""), ("ive", ""), ("ize", ""), ("al", ""), ("er", ""), ("ic", "")),
)
_VC = re.compile(r"[aeiouy]+[^aeiouy]+")


def measure(stem: str) -> int:
    """Vowel-consonant runs; y counts as a vowel after a consonant only."""
    marked = re.sub(r"(^|[aeiou])y", r"\1Y", stem)
    return len(_VC.findall(marked))


def stem(word: str) -> str:
    """Suffix stripping after Porter's published rules."""
    if len(word) < 3:
        return word
    for end, new in _STEPS[0]:
        if word.endswith(end):
            word = word[: len(word) - len(end)] + new
            break
    if word.endswith("eed"):
        word = word[:-1] if measure(word[:-3]) > 0 else word
    else:
        for end in ("ed", "ing"):
            base = word.removesuffix(end)
            if base != word and re.search(r"[aeiouy]", base):
                if base.endswith(("at", "bl", "iz")):
                    base += "e"
                elif len(base) > 1 and base[-1] == base[-2] and base[-1] not in "aeioulsz":
                    base = base[:-1]
                elif measure(base) == 1 and re.search(r"[^aeiou][aeiouy][^aeiouwxy]$", base):
                    base += "e"
                word = base
                break
    if word.endswith("y") and re.search(r"[aeiouy]", word[:-1]):
        word = word[:-1] + "i"
    for step in _STEPS[1:3]:
        for end, new in step:
            if word.endswith(end):
                word = word[: len(word) - len(end)] + new if measure(word[: len(word) - len(end)]) > 0 else word
                break
    if word.endswith("ion") and word[:-3].endswith(("s", "t")) and measure(word[:-3]) > 1:
        word = word[:-3]
    else:
        for end, _ in _STEPS[3]:
            if word.endswith(end):
                word = word.removesuffix(end) if measure(word.removesuffix(end)) > 1 else word
                break
    if word.endswith("e") and (measure(word[:-1]) > 1 or measure(word[:-1]) == 1 and not re.search(r"[^aeiou][aeiouy][^aeiouwxy]$", word[:-1])):
        word = word[:-1]
    return word[:-1] if word.endswith("ll") and measure(word) > 1 else word


def stemmed(terms: Column) -> Column:
    @F.pandas_udf("array<string>")
    def run(rows: pd.Series) -> pd.Series:
        return rows.map(lambda ws: None if ws is None else [stem(w) for w in ws])

    return run(terms)
