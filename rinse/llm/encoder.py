"""Whole-text encoding with the tokenizers library, one chunk at a time.

Both tokenizers used here split text before they merge bytes, and never merge
across a space that follows a non-space character.  A text cut at such spaces
therefore has the concatenated ids of its chunks, and as words repeat, most
chunks are found in a table of chunks already encoded.  The table is bounded;
a chunk it has no room for is simply encoded again.
"""

from __future__ import annotations

import os
import re
from array import array
from functools import lru_cache

from tokenizers import Tokenizer

MOST_CHUNKS = 500_000
LONGEST_CHUNK = 64
GROUP_CHARS = 500_000
SPACE_AFTER_SPACE = re.compile(r"(?:^|\s) ")
BEFORE_SPACE = re.compile(r"(?<=\S)(?= )")


@lru_cache(maxsize=4)
def load(path: str) -> Tokenizer:
    """One per Python worker, single-threaded, without truncation or padding."""
    os.environ["TOKENIZERS_PARALLELISM"] = "false"
    t = Tokenizer.from_file(path)
    t.no_truncation()
    t.no_padding()
    return t


def space_chunks(text: str) -> list[str]:
    """Cut before every space that follows a non-space character."""
    if SPACE_AFTER_SPACE.search(text):
        return BEFORE_SPACE.split(text)
    first, *rest = text.split(" ")
    return [first, *[" " + x for x in rest]]


class ChunkEncoder:
    """Ids (little-endian 32-bit) and, if asked for, token ends of chunks."""

    def __init__(self, path: str, keep_space: bool, decoded: bool = False):
        self.tokenizer = load(path)
        self.cut = space_chunks if keep_space else lambda text: text.split(" ")
        self.decoded = decoded
        self.known: dict[str, tuple] = {"": (b"", b"")}

    def entry(self, e) -> tuple:
        # without a decoder, decode() joins the tokens by spaces
        return array("I", e.ids).tobytes(), " ".join(e.tokens).encode() if self.decoded else b""

    def lookup(self, cuts: list[list[str]]) -> dict[str, tuple]:
        """Entries of those chunks of some texts that weren't known."""
        new = list({c for chunks in cuts for c in chunks if c not in self.known})
        fresh = dict(zip(new, map(self.entry, self.tokenizer.encode_batch(new, add_special_tokens=False))))
        if len(self.known) < MOST_CHUNKS:  # the frequent ones come first
            self.known.update((c, x) for c, x in fresh.items() if len(c) <= LONGEST_CHUNK)
        return fresh

    def texts(self, texts):
        """For each text its list of chunk entries; texts are looked up in groups of bounded size."""
        group, size = [], 0
        for t in texts:
            group.append(self.cut(t))
            size += len(t)
            if size > GROUP_CHARS:
                yield from self._entries(group)
                group, size = [], 0
        yield from self._entries(group)

    def _entries(self, group):
        fresh = self.lookup(group)
        known = self.known
        for chunks in group:
            yield [known.get(c) or fresh[c] for c in chunks]
