"""Byte-pair encoding of single pre-tokens, with bounded worker caches.

The vocabulary is a ``tokenizers`` JSON file whose path is a parameter.  Texts are
cut into pre-tokens by the file's own pattern; a pre-token is encoded by the merge
engine of ``tiktoken`` loaded with the same vocabulary, which gives the same ids as
long as every vocabulary entry encodes to itself (tests check this for the files in
use).  Characters on which the two regular-expression engines could differ send the
whole text (or chunk) through the ``tokenizers`` library itself.
"""

from __future__ import annotations

import json
import os

import regex
import tiktoken

os.environ.setdefault("TOKENIZERS_PARALLELISM", "false")
from tokenizers import Tokenizer  # noqa: E402

#: The split patterns of the two vocabulary files in use.
SPACED = r"'s|'t|'re|'ve|'m|'ll|'d| ?\p{L}+| ?\p{N}+| ?[^\s\p{L}\p{N}]+|\s+(?!\S)|\s+"
UNSPACED = r"'s|'t|'re|'ve|'m|'ll|'d|[\p{L}]+|[\p{N}]|[^\s\p{L}\p{N}]+"
#: Outside these ranges character classes depend on the Unicode version.
UNUSUAL = regex.compile(r"[^\x00-՗ -⁯぀-ヿ一-鿿가-힣]")
#: Outside these, lower-casing, NFC or white space need the library.
NOT_LATIN = regex.compile(r"[^\x00-\x1b\x20-\x84\x86-\x9f\xa1-ɏ]")
END = b"\xff"


def byte_alphabet() -> dict[str, int]:
    """The printable stand-ins of byte-level vocabularies, by rule."""
    plain = [*range(33, 127), *range(161, 173), *range(174, 256)]
    rest = [b for b in range(256) if b not in plain]
    return {chr(b): b for b in plain} | {chr(256 + i): b for i, b in enumerate(rest)}


class Cache(dict):
    """Pre-token -> value, in two generations: when the young one is full it becomes
    the old one, so that at most twice ``most`` entries live."""

    def __init__(self, make, most: int, first: dict | None = None):
        super().__init__(first or {})
        self.make, self.most, self.first, self.old = make, most, first or {}, {}

    def __missing__(self, key):
        value = self.old.get(key) if self.old else None
        if value is None:
            value = self.make(key)
        if len(self) >= self.most:
            self.old = dict(self)
            self.clear()
            self.update(self.first)
        self[key] = value
        return value


class Bpe:
    """One vocabulary file, opened once in each worker."""

    def __init__(self, path: str):
        with open(path, encoding="utf-8") as file:
            model = json.load(file)
        self.library = Tokenizer.from_file(path)
        self.special = {x["content"]: x["id"] for x in model["added_tokens"]}
        alphabet, suffix = byte_alphabet(), model["model"]["end_of_word_suffix"] or ""
        self.end = END if suffix else b""
        self.ranks: dict[bytes, int] = {}
        for token, rank in model["model"]["vocab"].items():
            if token in self.special:
                continue
            last = bool(suffix) and token.endswith(suffix)
            body = token[: -len(suffix)] if last else token
            self.ranks[bytes(alphabet[c] for c in body) + self.end * last] = rank
        ranks = dict(self.ranks)
        unused = max(ranks.values()) + 1
        for b in range(256):  # the engine wants every byte; ids without an entry never come out
            if bytes([b]) not in ranks:
                ranks[bytes([b])] = unused
                unused += 1
        self.engine = tiktoken.Encoding("file", pat_str=r"\S+", mergeable_ranks=ranks, special_tokens={})
        self.one = self.engine._core_bpe.encode_single_piece
        #: Entries that their own merges do not reach, which the engine would return whole.
        self.odd = {}
        if suffix:
            for piece, rank in self.ranks.items():
                name = self.library.id_to_token(rank)
                if name.endswith(suffix) and [t.id for t in self.library.model.tokenize(name[: -len(suffix)])] != [rank]:
                    self.odd[piece] = [t.id for t in self.library.model.tokenize(name[: -len(suffix)])]

    def piece_ids(self, pre_token: str) -> list[int]:
        piece = pre_token.encode() + self.end
        return self.odd[piece] if piece in self.odd else self.one(piece)

    def library_ids(self, text: str) -> list[int]:
        return self.library.encode(text, add_special_tokens=False).ids
