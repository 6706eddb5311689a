"""Token ids of a public byte-level BPE vocabulary, given by the path of its tokenizers file."""

from __future__ import annotations

import json
import re
from array import array
from functools import lru_cache

# The split pattern and the byte alphabet of this family of vocabularies.
PATTERN = r"""'s|'t|'re|'ve|'m|'ll|'d| ?\p{L}+| ?\p{N}+| ?[^\s\p{L}\p{N}]+|\s+(?!\S)|\s+"""
SPACES = "\t-\r \x85\xa0\u1680\u2000-\u200a\u2028\u2029\u202f\u205f\u3000"
PLAIN = [*range(ord("!"), ord("~") + 1), *range(ord("¡"), ord("¬") + 1), *range(ord("®"), ord("ÿ") + 1)]

#: Runs of white space from this length on are split off before the pattern sees them, just as it would split
#: them: its look-ahead backtracks over a run, and a million characters exhaust its stack.
LONG_RUN = 1000
_RUN = re.compile(f"(?<![{SPACES}])[{SPACES}]{{{LONG_RUN},}}")


class Encoder:
    """encode(text) -> uint32 ids as bytes, the same as tokenizers' encode(add_special_tokens=False), which
    gives the file's added tokens their own ids, at several times its speed: the file's vocabulary, whose
    ids are its merge ranks, is run by tiktoken."""

    def __init__(self, path: str):
        import tiktoken

        with open(path, encoding="utf-8") as f:
            file = json.load(f)
        model, added = file["model"], file.get("added_tokens") or []
        if any(t[flag] for t in added for flag in ("single_word", "lstrip", "rstrip", "normalized") if flag in t):
            raise ValueError(f"added tokens that match other than literally: {path}")
        other = iter(range(256, 512))
        byte = {chr(b) if b in PLAIN else chr(next(other)): b for b in range(256)}
        ranks = {bytes(byte[c] for c in token): i for token, i in model["vocab"].items() if all(c in byte for c in token) and not token.startswith("<|")}
        self.bpe = tiktoken.Encoding("own", pat_str=PATTERN, mergeable_ranks=ranks, special_tokens={t["content"]: t["id"] for t in added})
        self.added = re.compile("|".join(re.escape(t) for t in sorted((t["content"] for t in added), key=len, reverse=True)) or r"(?!)")

    def __call__(self, text: str) -> bytes:
        if not _RUN.search(text):
            return array("I", self.bpe.encode(text, allowed_special="all")).tobytes()
        ids, at = array("I"), 0
        for m in self.added.finditer(text):
            ids.extend(self.plain(text[at : m.start()]))
            ids.append(self.bpe.encode_single_token(m[0]))
            at = m.end()
        ids.extend(self.plain(text[at:]))
        return ids.tobytes()

    def plain(self, text: str) -> list[int]:
        """Ids of a text in which added tokens are ordinary text."""
        ids, at = [], 0
        for m in _RUN.finditer(text):
            # The last character of a run goes with what follows.
            end = m.end() - (m.end() < len(text))
            ids += self.bpe.encode_ordinary(text[at : m.start()])
            ids += self.bpe._encode_single_piece(text[m.start() : end])
            at = end
        return ids + self.bpe.encode_ordinary(text[at:])


@lru_cache(maxsize=2)
def encoder(path: str) -> Encoder:
    """One per worker process and vocabulary."""
    return Encoder(path)
