"""Token ids of a public byte-level BPE tokenizer file (tokenizers' JSON format).

The file's vocabulary is handed to tiktoken, whose merge by rank gives the same
ids several times faster; texts that could make a difference (the special token's
string, extremely long runs without white space) go through tokenizers itself.
"""

from __future__ import annotations

import json
import re
from array import array
from functools import lru_cache

DEFAULT_FILE = "byte_bpe_50k.json"
SPACE = re.compile(r"\s")
BLOCK = 2048


def default_path() -> str:
    import public_tokenizers

    return public_tokenizers.path(DEFAULT_FILE)


def _byte_of_char() -> dict:
    """The printable stand-ins of byte-level BPE: a printable byte stands for itself,
    the others take the code points from 256 on, in order."""
    printable = [*range(33, 127), *range(161, 173), *range(174, 256)]
    rest = [b for b in range(256) if b not in printable]
    return {chr(b): b for b in printable} | {chr(256 + i): b for i, b in enumerate(rest)}


def long_run(text: str) -> bool:
    """Whether one of the text's blocks has no white space, as one in every run of ``2 * BLOCK`` characters."""
    return any(not SPACE.search(text, at, at + BLOCK) for at in range(0, len(text) - BLOCK + 1, BLOCK))


class Encoder:
    """``ids(text)``: the whole text's ids as little-endian 32-bit integers."""

    def __init__(self, path: str):
        import tiktoken
        from public_tokenizers import PATTERN
        from tokenizers import Tokenizer

        self.tokenizer = Tokenizer.from_file(path)
        with open(path, encoding="utf-8") as f:
            spec = json.load(f)
        self.special = {t["content"]: t["id"] for t in spec.get("added_tokens", [])}
        of = _byte_of_char()
        ranks = {bytes(of[c] for c in word): i for word, i in spec["model"]["vocab"].items() if word not in self.special}
        # (it searches for special tokens, so there must be one; texts that hold the file's own do not get here)
        self.fast = tiktoken.Encoding("ranks", pat_str=PATTERN, mergeable_ranks=ranks, special_tokens=self.special or {"<|none|>": len(ranks)})

    def ids(self, text: str) -> bytes:
        if any(s in text for s in self.special) or long_run(text):
            return array("I", self.tokenizer.encode(text, add_special_tokens=False).ids).tobytes()
        return self.fast.encode_to_numpy(text, disallowed_special=()).astype("<u4", copy=False).tobytes()


@lru_cache(2)
def encoder(path: str) -> Encoder:
    return Encoder(path)
