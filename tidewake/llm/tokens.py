"""Byte-level BPE token ids from the public vocabulary files.

The vocabulary is a parameter: a ``.json`` file goes to ``tokenizers``, a ``.tiktoken`` rank
file to ``tiktoken``. Both hold the same vocabulary and give the same ids (tested); the
rank file is four times as fast, so it is the default. Names of added tokens inside a text
are their ids, as ``tokenizers`` has it: a rank file takes them from the JSON file beside it.
"""

from __future__ import annotations

import base64
import json
import os
from functools import lru_cache

import numpy as np

VOCABULARY = "byte_bpe_50k.tiktoken"
#: The id that closes a document.
END = 2


def default_path(name: str = VOCABULARY) -> str:
    import public_tokenizers

    return public_tokenizers.path(name)


def _added_tokens(path: str) -> dict[str, int]:
    """Names and ids of the added tokens of a JSON vocabulary; none where there is no such file."""
    if not os.path.exists(path):
        return {}
    with open(path, encoding="utf-8") as f:
        return {t["content"]: t["id"] for t in json.load(f).get("added_tokens", [])}


@lru_cache(maxsize=4)
def encoder(path: str | None = None):
    """A function from text to a list of ids; cached per Python worker."""
    path = path or default_path()
    if path.endswith(".json"):
        from tokenizers import Tokenizer

        tok = Tokenizer.from_file(path)
        return lambda text: tok.encode(text, add_special_tokens=False).ids
    import public_tokenizers
    import tiktoken

    with open(path, "rb") as f:
        ranks = {base64.b64decode(a): int(b) for a, b in map(bytes.split, f)}
    added = _added_tokens(path.removesuffix(".tiktoken") + ".json")
    enc = tiktoken.Encoding("bytes", pat_str=public_tokenizers.PATTERN, mergeable_ranks=ranks, special_tokens=added)
    return lambda text: enc.encode(text, allowed_special="all") if any(name in text for name in added) else enc.encode_ordinary(text)


def document_ids(text: str | None, path: str | None = None, end: int = END) -> np.ndarray:
    """The document's ids and its end id, little-endian unsigned 32-bit; null is empty."""
    ids = encoder(path)(text or "")
    ids.append(end)
    return np.array(ids, "<u4")


def cut(length: int, size: int) -> list[tuple[int, int]]:
    """(start, length) of a document's pieces: one if it fits, else full ones after a shorter first."""
    if length <= size:
        return [(0, length)]
    first = length % size or size
    return [(0, first)] + [(at, size) for at in range(first, length, size)]
