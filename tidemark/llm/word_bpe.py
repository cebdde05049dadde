"""The vocabulary and word splitting of a BPE tokenizer file with word ends, shared by encoding and counting.

Texts of Latin-1 code points alone, where lower case, normal form and letter classes are the same in every Unicode
version, are split by one compiled pattern; other texts are split by the library's own normalizer and splitter.
"""

from __future__ import annotations

import json
import re
from functools import cached_property, lru_cache

# Fixed values of the file format: letters and numbers among Latin-1 code points, white space, and the splitting pattern.
LETTERS = "A-Za-zªµºÀ-ÖØ-öø-ÿ"
NUMBERS = "0-9²³¹¼-¾"
SPACES = "\t-\r \u0085 "
CONTRACTIONS = ("'s", "'t", "'re", "'ve", "'m", "'ll", "'d")
SPLIT = r"'s|'t|'re|'ve|'m|'ll|'d|[\p{L}]+|[\p{N}]|[^\s\p{L}\p{N}]+"
WORD_END = "</w>"


def byte_symbols() -> list[str]:
    """The printable character that stands for each byte in a byte-level vocabulary."""
    plain = {*range(ord("!"), ord("~") + 1), *range(0xA1, 0xAC + 1), *range(0xAE, 0xFF + 1)}
    others = iter(range(256, 512))
    return [chr(b) if b in plain else chr(next(others)) for b in range(256)]


class WordBpe:
    """Vocabulary, merges and word splitting of the file at ``path``."""

    def __init__(self, path: str):
        with open(path, encoding="utf-8") as file:
            spec = json.load(file)
        model = spec["model"]
        steps = [x["type"] for x in spec["normalizer"]["normalizers"]], [x["type"] for x in spec["pre_tokenizer"]["pretokenizers"]]
        split = spec["pre_tokenizer"]["pretokenizers"][0]
        if steps != (["NFC", "Replace", "Lowercase"], ["Split", "ByteLevel"]) or split["pattern"] != {"Regex": SPLIT} or model["end_of_word_suffix"] != WORD_END or spec["decoder"] is not None:
            raise ValueError(f"{path}: not a lower-cased BPE vocabulary with word ends")
        vocab: dict[str, int] = model["vocab"]
        self.path = path
        self.specials = {x["content"]: x["id"] for x in spec["added_tokens"]}
        self.tokens = [""] * (max(*vocab.values(), *self.specials.values()) + 1)
        for token, at in (*vocab.items(), *self.specials.items()):
            self.tokens[at] = token
        self.size = len(self.tokens)
        self.symbols = byte_symbols()
        self.bytes_of = {c: b for b, c in enumerate(self.symbols)}
        #: Ids of each byte inside a word and at its end.
        self.inner = [vocab[c] for c in self.symbols]
        self.last = [vocab[c + WORD_END] for c in self.symbols]
        #: By rank: left id, right id, id of the result; and the rank of each pair, keyed by left * size + right.
        self.merges = [(vocab[a], vocab[b], vocab[a + b]) for a, b in map(tuple, model["merges"])]
        self.rank = {a * self.size + b: r for r, (a, b, _) in enumerate(self.merges)}
        made = {new: r for r, (_, _, new) in enumerate(self.merges)}
        if len(made) < len(self.merges) or any(made.get(x, -1) >= r for r, (a, b, _) in enumerate(self.merges) for x in (a, b)):
            raise ValueError(f"{path}: a merge precedes the merges that make its parts")  # else ranks can't be applied in one ascending order
        self._words = re.compile("|".join([*CONTRACTIONS, f"[{LETTERS}]+", f"[{NUMBERS}]", f"[^{SPACES}{LETTERS}{NUMBERS}]+"]))
        self._special = re.compile("|".join(re.escape(x) for x in sorted(self.specials, key=len, reverse=True))) if self.specials else None

    @cached_property
    def library(self):
        """The library's tokenizer; only texts beyond Latin-1 need it."""
        from tokenizers import Tokenizer

        return Tokenizer.from_file(self.path)

    def segments(self, text: str) -> list[str]:
        """Plain segments at even places, special strings between them."""
        if self._special is None or not any(x in text for x in self.specials):
            return [text]
        plain, held = self._special.split(text), self._special.findall(text)
        return [x for pair in zip(plain, [*held, ""], strict=True) for x in pair][:-1]

    def normal(self, text: str) -> str:
        """A plain segment, normalised; white space may differ from the library's, as none of it is kept."""
        try:
            text.encode("latin-1")
        except UnicodeEncodeError:
            return self.library.normalizer.normalize_str(text)
        return text.lower()

    def split(self, normal: str) -> list[str]:
        try:
            normal.encode("latin-1")
        except UnicodeEncodeError:
            pieces = self.library.pre_tokenizer.pre_tokenize_str(normal)
            return [bytes(map(self.bytes_of.__getitem__, piece)).decode("utf-8") for piece, _ in pieces]
        return self._words.findall(normal)

    def words(self, text: str) -> list[str]:
        """Words of a text in order; special strings stand as words of their own (no word can equal one)."""
        parts = self.segments(text)
        if len(parts) == 1:
            return self.split(self.normal(text))
        return [w for at, part in enumerate(parts) for w in ([part] if at % 2 else self.split(self.normal(part)))]

    def start(self, word: str) -> list[int]:
        """The ids of a word's bytes before any merge."""
        data = word.encode("utf-8")
        return [*map(self.inner.__getitem__, data[:-1]), self.last[data[-1]]]


@lru_cache(maxsize=2)
def load(path: str) -> WordBpe:
    return WordBpe(path)
