"""Token ids of a byte-level BPE vocabulary file, inside tasks."""

from __future__ import annotations

import json
from functools import lru_cache

import numpy as np

#: Fixed pattern by which byte-level BPE cuts a text into pre-tokens.
PATTERN = r"'s|'t|'re|'ve|'m|'ll|'d| ?\p{L}+| ?\p{N}+| ?[^\s\p{L}\p{N}]+|\s+(?!\S)|\s+"


def vocabulary_path(name: str = "byte_bpe_50k.json") -> str:
    """Where the installed public tokenizer files are."""
    import public_tokenizers

    return public_tokenizers.path(name)


def _byte_of_letter() -> dict[str, int]:
    """Byte-level vocabularies write each byte as a letter: printable Latin-1 as it is, the others from U+0100 on."""
    plain = [*range(0x21, 0x7F), *range(0xA1, 0xAD), *range(0xAE, 0x100)]
    others = [b for b in range(256) if b not in plain]
    return {chr(b): b for b in plain} | {chr(256 + i): b for i, b in enumerate(others)}


class ByteBpe:
    """The ids that the ``tokenizers`` file at ``path`` gives, without special tokens around them.

    Plain text goes through tiktoken, which gives the same ids faster, since the file's merges
    rank as its ids do. Texts that spell an added token go through ``tokenizers`` itself.
    """

    def __init__(self, path: str):
        import tiktoken
        from tokenizers import Tokenizer

        with open(path, encoding="utf-8") as file:
            held = json.load(file)
        self.slow = Tokenizer.from_file(path)
        self.added = [t["content"] for t in held.get("added_tokens", [])]
        letters = _byte_of_letter()
        ranks = {bytes(letters[c] for c in token): i for token, i in held["model"]["vocab"].items() if token not in self.added}
        self.fast = tiktoken.Encoding("byte-bpe", pat_str=PATTERN, mergeable_ranks=ranks, special_tokens={})

    def ids(self, text: str) -> np.ndarray:
        if any(t in text for t in self.added):
            return np.array(self.slow.encode(text, add_special_tokens=False).ids, np.uint32)
        return np.array(self.fast.encode_ordinary(text), np.uint32)

    def count(self, text: str) -> int:
        if any(t in text for t in self.added):
            return len(self.slow.encode(text, add_special_tokens=False).ids)
        return len(self.fast.encode_ordinary(text))


@lru_cache(maxsize=4)
def byte_bpe(path: str) -> ByteBpe:
    """One tokenizer for each worker process and file."""
    return ByteBpe(path)
