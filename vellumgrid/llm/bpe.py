"""Byte-level BPE with the tiktoken library and a local rank file.

Long texts are split at safe boundaries before they are encoded: between an ASCII
letter and an ASCII character that is no letter, every match of the pre-splitting
pattern ends at the letter, so the parts encode to the same ids as the whole.  A
run without such a boundary is encoded as it stands.  The library's own matcher fails
on white space of some hundred thousand characters and more; a part that holds
``LONG_SPACE`` of them in a row is matched by the regex library, with the same pattern,
and each match goes to the library as one piece.

Defined cases: null text counts as empty (no ids); special-token strings are plain
text; repeated rows give repeated results.
"""

from __future__ import annotations

import base64
import functools
import hashlib
import re
from array import array
from collections.abc import Iterator

import pandas as pd
from pyspark.sql import Column
from pyspark.sql import functions as F

SAFE = re.compile(r"[A-Za-z](?=[\x00-\x40\x5B-\x60\x7B-\x7F])")
LONG_SPACE = re.compile(r"\s{50000}")


@functools.lru_cache(maxsize=4)
def matcher(pattern: str):
    import regex

    return regex.compile(pattern)


@functools.lru_cache(maxsize=4)
def encoding(ranks_path: str, pattern: str):
    """The library's encoding; built once in each worker."""
    import tiktoken

    ranks = {}
    with open(ranks_path, "rb") as lines:
        for line in lines:
            token, rank = line.split()
            ranks[base64.b64decode(token)] = int(rank)
    return tiktoken.Encoding("local-ranks", pat_str=pattern, mergeable_ranks=ranks, special_tokens={})


def parts(text: str, size: int) -> Iterator[str]:
    """Parts of about ``size`` characters, cut at safe boundaries only."""
    at = 0
    while len(text) - at > size:
        cut = SAFE.search(text, at + size)
        if cut is None:
            break
        yield text[at : cut.end()]
        at = cut.end()
    yield text[at:]


def encode(text: str | None, enc, size: int = 100_000) -> array:
    ids = array("I")
    for part in parts(text or "", size):
        if LONG_SPACE.search(part):
            for match in matcher(enc._pat_str).finditer(part):
                ids.extend(enc._encode_single_piece(match.group()))
        else:
            ids.extend(enc.encode_ordinary(part))
    return ids


def decode(ids, enc) -> bytes:
    return enc.decode_bytes(list(ids))


def _little(ids: array) -> bytes:
    import sys

    if sys.byteorder == "big":
        ids = array("I", ids)
        ids.byteswap()
    return ids.tobytes()


def encoded(text: Column, ranks_path: str, pattern: str, part: int = 100_000) -> Column:
    """text -> array of ids."""

    @F.pandas_udf("array<int>")
    def ids(texts: pd.Series) -> pd.Series:
        enc = encoding(ranks_path, pattern)
        return pd.Series([list(encode(t, enc, part)) for t in texts], dtype=object)

    return ids(text)


def decoded(ids: Column, ranks_path: str, pattern: str) -> Column:
    """array of ids -> raw bytes; null for null."""

    @F.pandas_udf("binary")
    def raw(rows: pd.Series) -> pd.Series:
        enc = encoding(ranks_path, pattern)
        return pd.Series([None if r is None else decode(r, enc) for r in rows], dtype=object)

    return raw(ids)


def digests(text: Column, ranks_path: str, pattern: str, part: int = 100_000) -> Column:
    """text -> struct(n_tokens, ids_sha256, decoded_sha256): encodes, then decodes the
    ids, and returns digests only, so that ids need not cross to the JVM."""

    @F.pandas_udf("n_tokens long, ids_sha256 string, decoded_sha256 string")
    def digest(texts: pd.Series) -> pd.DataFrame:
        enc = encoding(ranks_path, pattern)
        rows = []
        for t in texts:
            ids = encode(t, enc, part)
            rows.append((len(ids), hashlib.sha256(_little(ids)).hexdigest(), hashlib.sha256(decode(ids, enc)).hexdigest()))
        return pd.DataFrame(rows, columns=["n_tokens", "ids_sha256", "decoded_sha256"])

    return digest(text)
