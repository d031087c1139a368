"""Reading byte-level BPE vocabularies: symbols, merges and the printable form of bytes."""

from __future__ import annotations

import json
from dataclasses import dataclass, field


def printable_bytes() -> list[str]:
    """The character that stands for each byte: visible Latin-1 bytes themselves, the others from U+0100 on, in order."""
    seen = {*range(0x21, 0x7F), *range(0xA1, 0xAD), *range(0xAE, 0x100)}
    out, spare = [], 0x100
    for b in range(256):
        if b in seen:
            out.append(chr(b))
        else:
            out.append(chr(spare))
            spare += 1
    return out


@dataclass
class Vocabulary:
    """ids of printable token strings, merges as id pairs in rank order, and special strings found in raw text."""

    tokens: list[str]
    merges: list[tuple[int, int, int]]
    specials: dict[str, int]
    suffix: str
    config: dict = field(repr=False)

    @classmethod
    def load(cls, path: str) -> Vocabulary:
        with open(path, encoding="utf-8") as f:
            config = json.load(f)
        model = config["model"]
        ids = dict(model["vocab"])
        specials = {a["content"]: a["id"] for a in config["added_tokens"]}
        tokens = [""] * (max([*ids.values(), *specials.values()]) + 1)
        for t, i in [*ids.items(), *specials.items()]:
            tokens[i] = t
        merges = []
        for m in model["merges"]:
            a, b = m.split(" ") if isinstance(m, str) else m
            merges.append((ids[a], ids[b], ids[a + b]))
        return cls(tokens, merges, specials, model.get("end_of_word_suffix") or "", config)

    def ids(self) -> dict[str, int]:
        return {t: i for i, t in enumerate(self.tokens)}
