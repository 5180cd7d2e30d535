"""Byte-level BPE encodes each pre-token by itself, so whole texts can be encoded through a memo.

A text is cut before every blank and line break that a non-blank follows. Such a place is always a
pre-token border, so each unit can be encoded alone and its ids kept. Texts in which a blank or line
break meets more white space, and texts that hold the special token, are cut by the pre-token pattern.
"""

from __future__ import annotations

import re
from collections.abc import Callable

import regex

# The pre-token pattern and special token of the public byte-level vocabulary.
SPACE = r"\t-\r \x85\xa0\u1680\u2000-\u200a\u2028\u2029\u202f\u205f\u3000"
PRE_TOKEN = regex.compile(
    rf"'s|'t|'re|'ve|'m|'ll|'d| ?\p{{L}}+| ?\p{{N}}+| ?[^{SPACE}\p{{L}}\p{{N}}]+|[{SPACE}]+(?![^{SPACE}])|[{SPACE}]+"
)
SPECIAL = "<|endoftext|>"
_MIXED_SPACE = re.compile(r"[ \n]\s")


class UnitMemo:
    """Encodes texts to little-endian uint32 ids through `resolve`, which encodes distinct strings.

    The memo is bounded by `limit` entries and then started anew, so memory doesn't grow with the
    vocabulary; results don't depend on it.
    """

    def __init__(self, resolve: Callable[[list[str]], list[bytes]], limit: int = 300_000):
        self.resolve, self.limit = resolve, limit
        self.head: dict[str, bytes] = {}
        self.tail: dict[str, bytes] = {}  # keys stand for themselves after a line break, else for a blank and the key

    def encode(self, texts: list[str]) -> list[bytes]:
        if len(self.head) + len(self.tail) > self.limit:
            self.head, self.tail = {}, {}
        plans, heads, tails = [], set(), set()
        find = self.tail.get
        for text in texts:
            if SPECIAL in text or _MIXED_SPACE.search(text):
                first, rest = [], []
                for k, part in enumerate(text.split(SPECIAL)):
                    if k:
                        first.append(SPECIAL)
                    first += PRE_TOKEN.findall(part)
                heads.update(first)
            else:
                first = text.replace("\n", " \n").split(" ")
                rest = first[1:]
                del first[1:]
                heads.add(first[0])
            found = list(map(find, rest))
            new = [k for k, v in zip(rest, found) if v is None] if None in found else []
            tails.update(new)
            plans.append((first, rest, found, bool(new)))
        new_heads, new_tails = list(heads - self.head.keys()), list(tails)
        got = self.resolve(new_heads + [x if x[:1] == "\n" else " " + x for x in new_tails])
        self.head.update(zip(new_heads, got))
        self.tail.update(zip(new_tails, got[len(new_heads):]))
        head, tail = self.head.__getitem__, self.tail
        return [
            b"".join(map(head, first)) + b"".join([tail[k] if v is None else v for k, v in zip(rest, found)] if new else found)
            for first, rest, found, new in plans
        ]
