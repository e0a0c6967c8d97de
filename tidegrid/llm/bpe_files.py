"""Reading the public tokenizer files that describe byte-pair merges."""

from __future__ import annotations

import json
from dataclasses import dataclass, field

import regex

from tidegrid.llm.common import once


def byte_alphabet() -> list[str]:
    """The printable character that stands for each byte: itself where printable, else the next free one from 256."""
    shown = [*range(ord("!"), ord("~") + 1), *range(ord("\xa1"), ord("\xac") + 1), *range(ord("\xae"), ord("\xff") + 1)]
    table, free = [""] * 256, 256
    for b in range(256):
        table[b] = chr(b) if b in shown else chr(free)
        free += b not in shown
    return table


@dataclass
class Merges:
    """Symbols are numbered; ``rank`` maps ``left << 20 | right`` to the place in the merge list."""

    symbols: dict[str, int]
    rank: dict[int, int]
    product: list[int]
    pairs: list[tuple[int, int]]
    vocabulary: dict[str, int]
    specials: dict[str, int]
    word_end: str
    names: list[str] = field(default_factory=list)

    @property
    def special_pattern(self):
        """Splits a text at its special strings, the longest first where one begins another; None without any."""
        if not self.specials:
            return None
        return regex.compile("(" + "|".join(map(regex.escape, sorted(self.specials, key=lambda s: (-len(s), s)))) + ")")


def load_merges(path: str) -> Merges:
    """The merges of a tokenizer's json file; kept once per worker process."""
    return once(("merges", path), lambda: _load(path))


def _load(path: str) -> Merges:
    with open(path, encoding="utf-8") as f:
        spec = json.load(f)
    model = spec["model"]
    end = model.get("end_of_word_suffix") or ""
    names: list[str] = []
    number: dict[str, int] = {}

    def symbol(name: str) -> int:
        if name not in number:
            number[name] = len(names)
            names.append(name)
        return number[name]

    alphabet = byte_alphabet()
    for c in alphabet:
        symbol(c)
    for c in alphabet:
        symbol(c + end)
    rank, product, pairs = {}, [], []
    for at, pair in enumerate(model["merges"]):
        left, right = pair if isinstance(pair, list) else pair.split(" ")
        a, b = symbol(left), symbol(right)
        rank.setdefault(a << 20 | b, at)
        product.append(symbol(left + right))
        pairs.append((a, b))
    specials = {t["content"]: t["id"] for t in spec["added_tokens"]}
    return Merges(number, rank, product, pairs, model["vocab"], specials, end, names)
