"""Encoding whole texts by the vocabulary files of the tokenizers library, with that library's ids.

Both vocabularies' ids are their merge ranks, so a rank encoder over the same file gives the library's ids; tests hold each
encoder here against the library over whole texts.

* RankEncoder: byte level, the whole text at once.
* WordEncoder: word level (lower case, white space dropped). A text is cut at spaces and line feeds, where its
  pre-tokenizer must cut. A chunk that is a Latin word and perhaps closing punctuation needs no normalising but lower case
  and is one pre-token and one more: its word goes to a rank encoder. Any other chunk goes to the library. Chunks are kept
  with their ids until there are CACHE_ENTRIES of them.

The files' added tokens ("<|endoftext|>") are found first wherever they stand in a text, as the library does in its default
setting; each gives its one id, and what is between them is encoded by itself.
"""

from __future__ import annotations

import json
import os
import re
from array import array

import numpy as np

CACHE_ENTRIES = 200_000


def public(name: str) -> str:
    import public_tokenizers

    return public_tokenizers.path(name)


def _vocabulary(path: str) -> tuple[dict[str, int], dict[str, int]]:
    """The file's vocabulary, and the byte that each character of its byte alphabet stands for."""
    from tokenizers import pre_tokenizers

    with open(path, encoding="utf-8") as file:
        vocabulary = json.load(file)["model"]["vocab"]
    plain = [*range(33, 127), *range(161, 173), *range(174, 256)]
    other = [b for b in range(256) if b not in plain]
    byte_of = {chr(b): b for b in plain} | {chr(256 + k): b for k, b in enumerate(other)}
    if set(byte_of) != set(pre_tokenizers.ByteLevel.alphabet()):
        raise ValueError("another byte alphabet")
    return vocabulary, byte_of


class Added:
    """The file's added tokens. They are taken out of texts before anything else, so they must be plain strings."""

    def __init__(self, path: str):
        with open(path, encoding="utf-8") as file:
            tokens = json.load(file)["added_tokens"]
        if any(t["single_word"] or t["lstrip"] or t["rstrip"] or t["normalized"] for t in tokens):
            raise ValueError("added tokens that depend on what is around them")
        self.ids = {t["content"]: np.array([t["id"]], "<u4").tobytes() for t in tokens}
        longest_first = sorted(self.ids, key=len, reverse=True)
        self.found = re.compile("(" + "|".join(map(re.escape, longest_first)) + ")") if tokens else None
        self.sign = os.path.commonprefix(longest_first)

    def encode(self, text: str, plain) -> bytes:
        """The text's ids, those of its plain parts by plain(part)."""
        if self.found is None or self.sign not in text:
            return plain(text)
        return b"".join(self.ids[x] if k % 2 else plain(x) for k, x in enumerate(self.found.split(text)) if x)


class RankEncoder:
    """encode(texts) gives each text's ids as little-endian unsigned 32-bit bytes; none are added at its ends."""

    def __init__(self, path: str):
        import public_tokenizers
        import tiktoken

        vocabulary, byte_of = _vocabulary(path)
        self.added = Added(path)
        ranks = {bytes([byte_of[c] for c in token]): rank for token, rank in vocabulary.items() if token not in self.added.ids and all(c in byte_of for c in token)}
        self.one = tiktoken.Encoding(path, pat_str=public_tokenizers.PATTERN, mergeable_ranks=ranks, special_tokens={}).encode_ordinary

    def _plain(self, text: str) -> bytes:
        return array("I", self.one(text)).tobytes()

    def encode(self, texts: list[str | None]) -> list[bytes]:
        return [self.added.encode(t, self._plain) if t else b"" for t in texts]


class _Kept(dict):
    """Values that are made when they are first asked for."""

    def __init__(self, make):
        self.make = make

    def __missing__(self, key):
        value = self[key] = self.make(key)
        return value


class WordEncoder:
    """encode(texts) gives each text's ids as little-endian unsigned 32-bit bytes; none are added at its ends."""

    def __init__(self, path: str):
        os.environ.setdefault("TOKENIZERS_PARALLELISM", "false")
        import tiktoken
        from tokenizers import Tokenizer

        self.tokenizer, self.added = Tokenizer.from_file(path), Added(path)
        vocabulary, byte_of = _vocabulary(path)
        ranks = {}
        for token, rank in vocabulary.items():
            if token in self.added.ids:
                continue
            # a word's end stands as the byte FF, which no UTF-8 text has
            body, end = (token[:-4], b"\xff") if token.endswith("</w>") else (token, b"")
            if body and all(c in byte_of for c in body):
                ranks[bytes([byte_of[c] for c in body]) + end] = rank
        self.word = tiktoken.Encoding(path, pat_str=r"\S+", mergeable_ranks=ranks, special_tokens={})._core_bpe.encode_single_piece
        self.chunks, self.tails = _Kept(self._chunk), _Kept(self._library)

    def _library(self, text: str) -> bytes:
        return np.array(self.tokenizer.encode(text, add_special_tokens=False).ids, dtype="<u4").tobytes()

    def _chunk(self, chunk: str) -> bytes:
        base = chunk.rstrip(".,;:!?")
        if not base.isalpha() or max(base) >= "ɐ" or "İ" in base:
            return self._library(chunk)
        ids = array("I", self.word(base.lower().encode() + b"\xff")).tobytes()
        return ids + self.tails[chunk[len(base) :]] if len(base) < len(chunk) else ids

    def encode(self, texts: list[str | None]) -> list[bytes]:
        out = []
        for text in texts:
            if len(self.chunks) > CACHE_ENTRIES:
                self.chunks.clear()
                self.tails.clear()
            out.append(self.added.encode(text, self._plain) if text else b"")
        return out

    def _plain(self, text: str) -> bytes:
        return b"".join(map(self.chunks.__getitem__, text.replace("\n", " ").split(" ")))


_ENCODERS: dict = {}


def _one(kind, path: str):
    """One encoder for each worker process and file."""
    if (kind, path) not in _ENCODERS:
        _ENCODERS[kind, path] = kind(path)
    return _ENCODERS[kind, path]


def rank_encoder(path: str) -> RankEncoder:
    return _one(RankEncoder, path)


def word_encoder(path: str) -> WordEncoder:
    return _one(WordEncoder, path)
