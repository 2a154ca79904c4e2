"""The byte-level BPE vocabulary of a tokenizer file: pieces, ranks and the library's encoder."""

from __future__ import annotations

import json
import re
import unicodedata
from functools import lru_cache

import public_tokenizers
import regex

#: Fixed value: how the library cuts a text into pieces before it merges bytes.
PIECES = regex.compile(r"'s|'t|'re|'ve|'m|'ll|'d| ?\p{L}+| ?\p{N}+| ?[^\s\p{L}\p{N}]+|\s+(?!\S)|\s+")
#: The same for texts without numbers that aren't decimal digits and without separators U+001C to U+001F; twice as fast.
_COMMON = re.compile(r"'s|'t|'re|'ve|'m|'ll|'d| ?[^\W\d_]+| ?\d+| ?(?:[^\s\w]|_)+|\s+(?!\S)|\s+")


#: A text with a character above U+FFFF takes the general pattern too: a class with such characters is slow to search for.
_ODD = [re.compile(f"[{ranges}]") for ranges in (
    "\x1c-\x1f", "".join(re.escape(chr(i)) for i in range(0x10000) if unicodedata.category(chr(i)) in ("Nl", "No")), "\U00010000-\U0010ffff")]


def pieces(text: str) -> list[str]:
    """The pieces of a text, in order; joined they are the text."""
    odd = any(p.search(text) for p in _ODD[:1 if text.isascii() else 3])
    return (PIECES if odd else _COMMON).findall(text)


def default_path() -> str:
    return public_tokenizers.path("byte_bpe_50k.json")


def _byte_of_letter() -> dict[str, int]:
    """Byte-level files write each byte as a printable letter: itself, or the next free one from U+0100 on."""
    shown = [*range(0x21, 0x7F), *range(0xA1, 0xAD), *range(0xAE, 0x100)]
    letters = {chr(b): b for b in shown}
    letters.update({chr(0x100 + i): b for i, b in enumerate(sorted(set(range(256)) - set(shown)))})
    return letters


@lru_cache(maxsize=4)
def load(path: str) -> tuple[dict[bytes, int], dict[str, int]]:
    """(bytes of a token to its id, added tokens to theirs); ids of merged tokens ascend in merge order."""
    with open(path, encoding="utf-8") as f:
        spec = json.load(f)
    letters, added = _byte_of_letter(), {t["content"]: t["id"] for t in spec["added_tokens"]}
    ranks = {bytes(letters[c] for c in token): i for token, i in spec["model"]["vocab"].items() if token not in added}
    return ranks, added


@lru_cache(maxsize=4)
def encoder(path: str):
    """The compiled encoder over this file's vocabulary: same ids as the tokenizers library gives (tests hold them together)."""
    import tiktoken

    ranks, added = load(path)
    return tiktoken.Encoding("file", pat_str=PIECES.pattern, mergeable_ranks=ranks, special_tokens=added)
