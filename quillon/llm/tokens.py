"""Exact fast tokenizing with a lower-casing word-end BPE vocabulary.

White space never lies inside a token of such a vocabulary, so a text's ids
are its white-space chunks' ids in order. Chunks seen before come from a
bounded cache. New ones are cut into words by the vocabulary's pattern and
merged by a byte-pair encoder that holds the same merges: the word end is one
line feed, whose merge with the byte before it ranks first. Texts with
characters outside the Latin blocks, where case folding and the pattern's
classes need care, go through the vocabulary's own tokenizer.
"""

from __future__ import annotations

import json
import os
import re
import unicodedata

import numpy as np

#: Chunks kept in a process before the cache starts anew.
CACHE_CHUNKS = 400_000
#: Latin letters, digits and signs of these ranges have the plain rules below.
_PLAIN = re.compile("[\t\n\x0b\x0c\r -~\xa1-ɏ‐-‧‰-⁞₠-₿]*")
_LETTERS = "a-zªµºß-öø-ɏ"
_NUMBERS = "0-9²³¹¼-¾"
_WORDS = re.compile(f"[{_LETTERS}]+|[{_NUMBERS}]|'s|'t|'re|'ve|'m|'ll|'d|[^ \t\n\x0b\x0c\r{_LETTERS}{_NUMBERS}]+")
_ASCII_WORDS = re.compile(r"[a-z]+|[0-9]|'s|'t|'re|'ve|'m|'ll|'d|[^ \t\n\x0b\x0c\ra-z0-9]+")
_loaded: dict[str, "WordBpe"] = {}


def _byte_signs() -> dict[str, int]:
    """The printable sign that byte-level vocabularies write for each byte."""
    plain = [*range(33, 127), *range(161, 173), *range(174, 256)]
    rest = [b for b in range(256) if b not in plain]
    return {chr(b): b for b in plain} | {chr(256 + i): b for i, b in enumerate(rest)}


class WordBpe(dict):
    """Maps a white-space chunk to its ids as little-endian uint32 bytes."""

    def __init__(self, path: str):
        os.environ["TOKENIZERS_PARALLELISM"] = "false"
        import tiktoken
        from tokenizers import Tokenizer

        self.own = Tokenizer.from_file(path)
        with open(path, encoding="utf-8") as f:
            model = json.load(f)["model"]
        signs, vocab = _byte_signs(), model["vocab"]

        def raw(token: str) -> bytes:
            end = token.endswith("</w>")
            return bytes(signs[c] for c in (token[:-4] if end else token)) + b"\n" * end

        ranks, ids = {}, {}
        for sign, b in signs.items():
            for rank, key, name in ((b, bytes([b]) + b"\n", sign + "</w>"), (256 + b, bytes([b]), sign)):
                ranks[key], ids[rank] = rank, vocab[name]
        for i, pair in enumerate(model["merges"]):
            left, right = pair.split(" ") if isinstance(pair, str) else pair
            key = raw(left + right)
            if key not in ranks:
                ranks[key], ids[512 + i] = 512 + i, vocab[left + right]
        self.ids = np.zeros(max(ids) + 1, np.uint32)
        self.ids[list(ids)] = list(ids.values())
        self.ends = np.zeros(max(ids) + 1, bool)
        self.ends[[r for k, r in ranks.items() if k.endswith(b"\n")]] = True
        self.bpe = tiktoken.Encoding("words", pat_str=r"[^\n]+\n", mergeable_ranks=ranks, special_tokens={})._core_bpe

    @staticmethod
    def chunks(text: str) -> list[str] | None:
        """The lower-cased text's chunks; None if it needs the own tokenizer.

        Both the text and its lower case must be plain: some capitals of the
        Latin blocks have their small letters beyond them.
        """
        if "<|" in text or not _PLAIN.fullmatch(text):
            return None
        low = text.lower()
        if not text.isascii() and not (_PLAIN.fullmatch(low) and unicodedata.is_normalized("NFC", text)):
            return None
        return low.split()

    def learn(self, chunks: list[str]) -> None:
        """Adds lower-case chunks of plain characters to the cache at one go."""
        words, counts = [], []
        joined = "\n".join(chunks)
        find = _ASCII_WORDS.findall if joined.isascii() else _WORDS.findall
        for w in map(find, chunks):
            words += w
            counts.append(len(w))
        ranks = np.array(self.bpe.encode_ordinary("\n".join(words) + "\n" if words else ""), np.int64)
        ends = np.concatenate(([0], np.flatnonzero(self.ends[ranks]) + 1))
        cuts = (4 * ends[np.concatenate(([0], np.cumsum(counts, dtype=np.int64)))]).tolist()
        ids = self.ids[ranks].tobytes()
        self.update(zip(chunks, map(ids.__getitem__, map(slice, cuts, cuts[1:]))))

    def encode_batch(self, texts: list[str]) -> list[bytes]:
        """Each text's ids without special tokens, as little-endian uint32."""
        if len(self) > CACHE_CHUNKS:
            self.clear()
        split = [self.chunks(t) for t in texts]
        new = set()
        for chunks in split:
            if chunks:
                new.update(chunks)
        new = [c for c in new if c not in self]
        if new:
            self.learn(new)
        get = self.__getitem__
        return [b"".join(map(get, c)) if c is not None else np.array(self.own.encode(t, add_special_tokens=False).ids, "<u4").tobytes() for c, t in zip(split, texts)]


def word_bpe(name: str) -> WordBpe:
    """The vocabulary file of that name, loaded once a process."""
    if name not in _loaded:
        import public_tokenizers

        _loaded[name] = WordBpe(name if os.path.isabs(name) else public_tokenizers.path(name))
    return _loaded[name]
