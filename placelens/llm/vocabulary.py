"""Merge tables of byte-pair vocabularies, read from a tokenizer file whose path is given."""

from __future__ import annotations

import json
from collections.abc import Callable
from functools import lru_cache

import regex

#: How the word vocabulary and the byte vocabulary split a text into pieces.
WORD_PIECES = r"'s|'t|'re|'ve|'m|'ll|'d|[\p{L}]+|[\p{N}]|[^\s\p{L}\p{N}]+"
BYTE_PIECES = r"'s|'t|'re|'ve|'m|'ll|'d| ?\p{L}+| ?\p{N}+| ?[^\s\p{L}\p{N}]+|\s+(?!\S)|\s+"


def splitter(path: str, pattern: str) -> Callable[[str], list[str]]:
    """The pieces of a text by ``pattern``, after the file's own normalizer where the library has to decide.

    The library and ``regex`` know other versions of Unicode.  They agree on all
    characters that Python prints; a text with any other one, such as a letter
    newer than Python's tables, is split by the library's own expressions.
    """
    from tokenizers import Regex, Tokenizer, pre_tokenizers

    find = regex.compile(pattern).findall
    normalizer = Tokenizer.from_file(path).normalizer
    library = pre_tokenizers.Split(Regex(pattern), "removed", invert=True)

    def split(text: str) -> list[str]:
        if text.isascii() or text.isprintable():
            return find(text)
        return [x for x, _ in library.pre_tokenize_str(normalizer.normalize_str(text) if normalizer else text)]

    return split


def byte_letters() -> list[str]:
    """The printable letter that stands for each byte: itself, or the next free one from 256 on."""
    own = {*range(0x21, 0x7F), *range(0xA1, 0xAD), *range(0xAE, 0x100)}
    free = iter(range(0x100, 0x200))
    return [chr(b if b in own else next(free)) for b in range(256)]


class Vocabulary:
    """Ids of single bytes, the rank and result of each pair, special strings and the bytes of each id."""

    def __init__(self, path: str):
        with open(path, encoding="utf-8") as f:
            spec = json.load(f)
        model = spec["model"]
        ids: dict[str, int] = model["vocab"]
        end = model.get("end_of_word_suffix") or ""
        letters = byte_letters()
        self.inner = [ids[x] for x in letters]
        self.last = [ids[x + end] for x in letters]
        self.width = 1 << max(ids.values()).bit_length()
        #: (left id * width + right id) -> rank; products by rank.
        self.ranks: dict[int, int] = {}
        self.pairs: list[tuple[int, int, int]] = []
        made: dict[int, int] = {}
        for rank, pair in enumerate(model["merges"]):
            left, right = pair if isinstance(pair, list) else pair.split(" ")
            a, b, c = ids[left], ids[right], ids[left + right]
            if max(made.get(a, -1), made.get(b, -1)) >= rank or c in made:
                raise ValueError(f"merge {rank} comes before what it is made of, or makes a known id again")
            made[c] = rank
            self.ranks[a * self.width + b] = rank
            self.pairs.append((a, b, c))
        self.specials = {x["content"]: x["id"] for x in spec.get("added_tokens", []) if x.get("special")}
        self.special = regex.compile("|".join(f"({regex.escape(x)})" for x in sorted(self.specials, key=len, reverse=True)) or "(?!)")
        unletter = {x: b for b, x in enumerate(letters)}
        self.bytes = [b""] * (max(*ids.values(), *self.specials.values(), 0) + 1)
        if not end:
            for token, i in ids.items():
                self.bytes[i] = bytes(unletter[x] for x in token) if token not in self.specials else token.encode()
            for token, i in self.specials.items():
                self.bytes[i] = token.encode()


@lru_cache(maxsize=4)
def load(path: str) -> Vocabulary:
    """Read once in each Python worker."""
    return Vocabulary(path)
