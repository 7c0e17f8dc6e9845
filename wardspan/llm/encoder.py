"""Token ids of whole texts, equal to those of the `tokenizers` library for a byte-level vocabulary file.

Ordinary texts are encoded by merge ranks taken from the same vocabulary, which is several times faster. Texts with
characters on which Unicode tables of different libraries may disagree, with a special string of the vocabulary, or
with very long words go to the library itself.
"""

from __future__ import annotations

import json
import os
import re
from functools import cached_property, lru_cache

import numpy as np

os.environ.setdefault("TOKENIZERS_PARALLELISM", "false")

#: Characters whose class (letter, number, white space) no Unicode version has changed.
UNUSUAL = re.compile("[^\t\n\r\x20-\x7e\xa1-ʯЀ-ҁ‐-‧一-鿌]")
LONG_WORD = re.compile(r"[^ \n]{1000}|[ ]{1000}|[\n]{1000}")


#: ASCII bytes that UNUSUAL finds, and the ends of the first kind of run in LONG_WORD.
UNUSUAL_BYTE = np.array([bool(UNUSUAL.match(chr(b))) for b in range(128)] + [False] * 128)
BREAK_BYTE = np.isin(np.arange(256), [0x20, 0x0A])
LONG_RUN = 1000


def maybe_long(data: np.ndarray) -> bool:
    """Whether UTF-8 bytes can hold a match of LONG_WORD: no text that does is missed."""
    if len(data) < LONG_RUN:
        return False
    at = np.flatnonzero(BREAK_BYTE[data])
    gaps = np.diff(at, prepend=-1, append=len(data))
    return bool(gaps.max() > LONG_RUN) or (len(at) >= LONG_RUN and bool((at[LONG_RUN - 1 :] - at[: len(at) - LONG_RUN + 1] == LONG_RUN - 1).any()))


def vocabulary_path(name: str) -> str:
    import public_tokenizers

    return public_tokenizers.path(name)


def pre_token_pattern() -> str:
    from public_tokenizers import PATTERN

    return PATTERN


def rank_encoder(vocabulary: dict[str, int], special: list[str]):
    """Encoder of a byte-level vocabulary whose ids are the ranks of its merges."""
    import tiktoken

    plain = [*range(33, 127), *range(161, 173), *range(174, 256)]
    shown = [*plain, *(b for b in range(256) if b not in plain)]
    byte_of = {chr(b) if k < len(plain) else chr(256 + k - len(plain)): b for k, b in enumerate(shown)}
    ranks = {bytes(byte_of[c] for c in token): n for token, n in vocabulary.items() if token not in special}
    return tiktoken.Encoding("ranks", pat_str=pre_token_pattern(), mergeable_ranks=ranks, special_tokens={})


class Encoder:
    """The rank encoder of a vocabulary file; the library itself is loaded when the first text needs it."""

    def __init__(self, path: str):
        self.path = path
        with open(path, encoding="utf-8") as file:
            stored = json.load(file)
        self.special = [token["content"] for token in stored["added_tokens"]]
        self.ranks = rank_encoder(stored["model"]["vocab"], self.special)

    @cached_property
    def whole(self):
        from tokenizers import Tokenizer

        return Tokenizer.from_file(self.path)

    def usual(self, text: str) -> bool:
        data = np.frombuffer(text.encode("utf-8", "surrogatepass"), np.uint8)
        if UNUSUAL_BYTE[data].any() if len(data) == len(text) else UNUSUAL.search(text):
            return False
        return not (maybe_long(data) and LONG_WORD.search(text) or any(s in text for s in self.special))

    @property
    def size(self) -> int:
        """Ids lie below this number."""
        return self.whole.get_vocab_size(with_added_tokens=True)

    def ids(self, text: str) -> list[int]:
        if self.usual(text):
            return self.ranks.encode_ordinary(text)
        return self.whole.encode(text, add_special_tokens=False).ids


@lru_cache(maxsize=1)
def encoder(path: str) -> Encoder:
    """The encoder of this worker process."""
    return Encoder(path)
