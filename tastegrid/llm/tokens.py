"""Token ids by the public byte-level vocabulary, inside tasks."""

import base64
import json
import re
from collections.abc import Callable
from functools import lru_cache

import numpy as np
import public_tokenizers
import tiktoken

# The ranks of the vocabulary; they give the ids of byte_bpe_50k.json several times faster.
RANKS = "byte_bpe_50k.tiktoken"
# The vocabulary whose ids these are; it names the tokens added to the ranks.
VOCABULARY = "byte_bpe_50k.json"
# A longer text is encoded in parts of about so many characters.
PART = 1 << 17


@lru_cache(maxsize=2)
def encoder(path: str | None = None) -> Callable[[str], np.ndarray]:
    """A function from a text to its ids by the ranks alone: added tokens are ordinary text."""
    with open(path or public_tokenizers.path(RANKS), "rb") as lines:
        ranks = {base64.b64decode(a): int(b) for a, b in (line.split() for line in lines)}
    encoding = tiktoken.Encoding(
        "byte_bpe", pat_str=public_tokenizers.PATTERN, mergeable_ranks=ranks, special_tokens={}
    )
    return lambda text: encoding.encode_to_numpy(text, disallowed_special=())


@lru_cache(maxsize=2)
def added_tokens(path: str | None = None) -> dict[str, int]:
    """The texts that are one token wherever they occur, and their ids."""
    with open(path or public_tokenizers.path(VOCABULARY), encoding="utf-8") as file:
        tokens = json.load(file)["added_tokens"]
    for token in tokens:
        if any(token.get(rule) for rule in ("single_word", "lstrip", "rstrip")):
            raise ValueError(f"an added token with a rule of its own: {token}")
    return {token["content"]: token["id"] for token in tokens}


def encoded(encode: Callable[[str], np.ndarray], text: str,
            added: dict[str, int] | None = None) -> np.ndarray:
    """The ids of ``text``. ``added`` texts in it are one token each, the longest first where
    several fit; what lies between them is encoded on its own."""
    if not any(token in text for token in added or ()):
        return _between(encode, text)
    tokens = "|".join(re.escape(t) for t in sorted(added, key=len, reverse=True))
    parts = [
        np.array([added[part]], np.uint32) if part in added else _between(encode, part)
        for part in re.split(f"({tokens})", text) if part
    ]
    return np.concatenate(parts)


def _between(encode: Callable[[str], np.ndarray], text: str) -> np.ndarray:
    """A long text is cut before a single space between letters, where a token starts in any
    case, so that no call holds more than about PART."""
    if len(text) <= 2 * PART:
        return encode(text)
    parts, start = [], 0
    while len(text) - start > 2 * PART:
        at = text.find(" ", start + PART)
        while at > 0 and at + 1 < len(text) and not (text[at - 1].isalpha() and text[at + 1].isalpha()):
            at = text.find(" ", at + 1)
        if at < 0 or at + 1 >= len(text):
            break
        parts.append(encode(text[start:at]))
        start = at
    parts.append(encode(text[start:]))
    return np.concatenate(parts)
