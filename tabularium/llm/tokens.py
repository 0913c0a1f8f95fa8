"""Byte-level BPE ids from a public vocabulary file, one encoder per Python worker.

A ``.json`` file is a whole tokenizer: its ids are those that the tokenizers library gives, added tokens included.
A ``.tiktoken`` file has ranks alone, without added tokens.
"""

from __future__ import annotations

import base64
import json
from functools import cache, lru_cache

import tiktoken
from tokenizers import Tokenizer

#: The public split pattern of this vocabulary.
PATTERN = r"'s|'t|'re|'ve|'m|'ll|'d| ?\p{L}+| ?\p{N}+| ?[^\s\p{L}\p{N}]+|\s+(?!\S)|\s+"
#: Characters up to which a text may take the faster route; its stack ends at some run of white space beyond 300,000.
FAST_CHARS = 100_000


def public_vocabulary(name: str) -> str:
    """Where the box keeps a public tokenizer file; every operator takes the path as a parameter."""
    import public_tokenizers

    return public_tokenizers.path(name)


def _bytes_of() -> dict[str, int]:
    """The byte that each character of a byte-level vocabulary stands for."""
    shown = [*range(33, 127), *range(161, 173), *range(174, 256)]
    hidden = [b for b in range(256) if b not in shown]
    return {chr(b): b for b in shown} | {chr(256 + n): b for n, b in enumerate(hidden)}


class Whole:
    """The ids of a tokenizer file.

    A text without added tokens goes through the same ranks and split pattern in tiktoken, which is faster and gives
    the same ids; texts with them, very long ones and files of another kind go through tokenizers.
    """

    def __init__(self, path: str):
        self._tokenizer = Tokenizer.from_file(path)
        with open(path, encoding="utf-8") as file:
            said = json.load(file)
        self._added = [t["content"] for t in said["added_tokens"]]
        self._ranked = self._ranks(said)

    def _ranks(self, said: dict) -> tiktoken.Encoding | None:
        model, split = said["model"], said["pre_tokenizer"] or {}
        plain = model["type"] == "BPE" and not said["normalizer"] and not any(model.get(k) for k in ("dropout", "ignore_merges", "continuing_subword_prefix", "end_of_word_suffix"))
        if not plain or split.get("type") != "ByteLevel" or split["add_prefix_space"] or not split.get("use_regex", True):
            return None
        vocab, byte = model["vocab"], _bytes_of()
        merged = [vocab["".join(m.split(" ") if isinstance(m, str) else m)] for m in model["merges"]]
        ranks = {bytes(byte[c] for c in token): n for token, n in vocab.items() if token not in self._added}
        if merged != sorted(set(merged)) or len(ranks) != len(merged) + 256 or min(merged) < 256:
            return None
        return tiktoken.Encoding("ranks", pat_str=PATTERN, mergeable_ranks=ranks, special_tokens={})

    def encode_ordinary(self, text: str) -> list[int]:
        if self._ranked and len(text) <= FAST_CHARS and not any(t in text for t in self._added):
            return self._ranked.encode_ordinary(text)
        return self._tokenizer.encode(text, add_special_tokens=False).ids

    def encode_plain(self, text: str) -> list[int]:
        """Ids of the text with added tokens in it taken as plain text."""
        if self._ranked and len(text) <= FAST_CHARS:
            return self._ranked.encode_ordinary(text)
        return self._plain().encode(text, add_special_tokens=False).ids

    @cache
    def _plain(self) -> Tokenizer:
        made = Tokenizer.from_str(self._tokenizer.to_str())
        made.encode_special_tokens = True
        return made


@lru_cache(maxsize=4)
def encoder(path: str) -> tiktoken.Encoding | Whole:
    if path.endswith(".json"):
        return Whole(path)
    with open(path, "rb") as lines:
        ranks = {base64.b64decode(token): int(rank) for token, rank in map(bytes.split, lines)}
    return tiktoken.Encoding("ranks", pat_str=PATTERN, mergeable_ranks=ranks, special_tokens={})
