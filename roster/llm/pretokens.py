"""Cutting texts into pieces that a byte-level BPE tokenizer treats independently, with a bounded cache.

The pre-token pattern lets a space only lead a pre-token, so a single space between two other characters always
starts a new one. Texts are therefore cut before such spaces, and each piece ("chunk") is encoded on its own
and remembered. Beside other white space the rule doesn't hold, so nothing is cut there.
"""

from __future__ import annotations

import re
from collections.abc import Callable, Sequence

_BESIDE_SPACE = re.compile(r" \s|\s ")
_SAFE = re.compile(r"(?<=\S)(?= \S)")
#: Longer chunks are encoded each time, so that the cache holds a bounded number of bytes.
MAX_CACHED_CHARS = 48


def chunks(text: str) -> list[str]:
    """The text's chunks; all but the first lack the space they begin with."""
    if _BESIDE_SPACE.search(text) is None:
        return text.split(" ")
    first, *rest = _SAFE.split(text)
    return [first, *(c[1:] for c in rest)]


class ChunkEncoder:
    """Bytes of little-endian unsigned 32-bit ids of whole texts. ``encode`` gives those of a list of pieces."""

    def __init__(self, encode: Callable[[list[str]], list[bytes]], limit: int = 400_000):
        self.encode, self.limit, self.known = encode, limit, {}

    def __call__(self, texts: Sequence[str | None]) -> list[bytes]:
        """The ids of each text (null: none); chunks not yet known are encoded in one call."""
        parts, known = [chunks(t or "") for t in texts], self.known
        new = list({c for p in parts for c in p[1:] if c not in known})
        heads = [p[0] for p in parts]
        out = self.encode([*heads, *(" " + c for c in new)])
        made = dict(zip(new, out[len(heads):], strict=True))
        if len(known) < self.limit:
            known.update((c, b) for c, b in made.items() if len(c) <= MAX_CACHED_CHARS)
        return [head + b"".join([known.get(c) or made[c] for c in p[1:]]) for head, p in zip(out, parts, strict=False)]
