"""Token ids of a byte-level BPE vocabulary file, with a cache of bounded size.

The ids equal those of the `tokenizers` library for the same file. A text is cut where the
pre-tokenizer's pattern always cuts: before a space, or around line ends, that stand between
other characters. What lies between is looked up; what is new goes to a BPE encoder over the
file's own vocabulary. Texts that hold an added token's string go to `tokenizers` itself.
"""

from __future__ import annotations

import json
from array import array
from functools import lru_cache

#: Fixed value: the pattern of byte-level pre-tokenizers with use_regex.
PATTERN = r"'s|'t|'re|'ve|'m|'ll|'d| ?\p{L}+| ?\p{N}+| ?[^\s\p{L}\p{N}]+|\s+(?!\S)|\s+"
CACHED = 300_000


def byte_names() -> dict[str, int]:
    """Byte-level vocabularies write each byte as a printable character: itself, or one from 256 on."""
    plain = [*range(33, 127), *range(161, 173), *range(174, 256)]
    names = {chr(b): b for b in plain}
    for n, b in enumerate(b for b in range(256) if b not in set(plain)):
        names[chr(256 + n)] = b
    return names


class Encoder:
    """encode(text) gives the ids as little-endian unsigned 32-bit integers."""

    def __init__(self, path: str):
        import tiktoken
        from tokenizers import Tokenizer

        with open(path, encoding="utf-8") as f:
            spec = json.load(f)
        self.added = [x["content"] for x in spec["added_tokens"]]
        names = byte_names()
        ranks = {bytes(names[c] for c in token): i for token, i in spec["model"]["vocab"].items() if token not in self.added}
        self.plain = tiktoken.Encoding("file", pat_str=PATTERN, mergeable_ranks=ranks, special_tokens={}).encode_ordinary
        self.exact = Tokenizer.from_file(path)
        self.first: dict[str, bytes] = {}
        self.later: dict[str, bytes] = {}
        self.line_end = self._bytes("\n")

    def _bytes(self, text: str) -> bytes:
        return array("I", self.plain(text)).tobytes()

    def encode(self, text: str) -> bytes:
        if any(x in text for x in self.added):
            return array("I", self.exact.encode(text, add_special_tokens=False).ids).tobytes()
        if not text or text[0].isspace() or text[-1].isspace():
            return self._bytes(text)
        out: list[bytes] = []
        ends = 0
        for line in text.split("\n"):
            if not line:
                ends += 1
                continue
            if line[0].isspace() or line[-1].isspace():
                return self._bytes(text)
            if out:
                if ends:
                    out.append(self._bytes("\n" * ends))
                out.append(self.line_end)
            ends = 0
            out += self._line(line)
        return b"".join(out)

    def _line(self, line: str) -> list[bytes]:
        head, *rest = line.split(" ")
        found = list(map(self.later.get, rest))
        if None in found:
            for i, x in enumerate(found):
                if x is None:
                    piece = rest[i]
                    if not piece or piece[0].isspace() or piece[-1].isspace():
                        return [self._bytes(line)]
                    if len(self.later) >= CACHED:
                        self.later.clear()
                    found[i] = self.later[piece] = self._bytes(" " + piece)
        if (x := self.first.get(head)) is None:
            if head[-1].isspace():
                return [self._bytes(line)]
            if len(self.first) >= CACHED:
                self.first.clear()
            x = self.first[head] = self._bytes(head)
        return [x, *found]


@lru_cache(2)
def encoder(path: str) -> Encoder:
    """One encoder for each worker process, whatever the number of tasks that it runs."""
    return Encoder(path)
