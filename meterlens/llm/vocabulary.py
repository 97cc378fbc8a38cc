"""The public BPE vocabulary with word ends: its file, how it splits texts, and its merges."""

from __future__ import annotations

import json
from functools import lru_cache

import public_tokenizers
import regex
from tokenizers import Tokenizer
from tokenizers.models import BPE

DEFAULT_VOCABULARY = public_tokenizers.path("word_bpe_49k.json")

WORD_END = "</w>"
#: White space that surely separates words: ASCII only; the rest is left to the library.
SPACE = " \t\n\r\x0b\x0c"
#: Characters whose case, class and normal form need no Unicode tables newer than ours.
UNUSUAL = regex.compile(r"[^\t\n\r -~¡-įı-ɏ]")
WORD = regex.compile(f"[^{SPACE}]+")
#: Marks that are a piece of their own behind letters.
MARKS = ".,;:!?"


def words_of(text: str) -> list[str]:
    """The text's parts between ASCII white space. No token crosses white space."""
    return WORD.findall(text) if UNUSUAL.search(text) else text.split()


def byte_symbols() -> list[str]:
    """The printable character that stands for each byte in the file's tokens: printable
    Latin-1 bytes are themselves, the others follow from U+0100 on."""
    plain = {*range(0x21, 0x7F), *range(0xA1, 0xAD), *range(0xAE, 0x100)}
    rest = iter(range(0x100, 0x200))
    return [chr(b) if b in plain else chr(next(rest)) for b in range(256)]


class Vocabulary:
    """Tokens, merges and splitting rules read from a tokenizers file."""

    def __init__(self, path: str):
        with open(path, encoding="utf-8") as f:
            spec = json.load(f)
        self.ids: dict[str, int] = spec["model"]["vocab"]
        self.special = {t["content"]: t["id"] for t in spec["added_tokens"]}
        self.tokens = {n: t for t, n in self.ids.items()} | {n: t for t, n in self.special.items()}
        self.longest = max(len(t.removesuffix(WORD_END)) for t in self.ids)
        self._library = Tokenizer.from_file(path)
        split = spec["pre_tokenizer"]["pretokenizers"][0]["pattern"]["Regex"]
        self._piece = regex.compile(split)
        self._special_starts = tuple({t[:2] for t in self.special})
        merges = [tuple(pair) for pair in spec["model"]["merges"]]
        #: The library's merges, for what ends a word and for what stands inside one.
        self._ending = BPE(self.ids, merges, end_of_word_suffix=WORD_END, cache_capacity=0)
        self._inside = BPE(self.ids, merges, cache_capacity=0)
        self._special = regex.compile(f"({'|'.join(map(regex.escape, self.special))})")
        self._symbols = byte_symbols()

    def parts(self, word: str) -> list[str | int]:
        """A word's pieces as strings of byte symbols, and the ids of special strings."""
        if word.isascii():  # most words are letters, with a mark behind them at times
            if word.isalpha():
                return [word.lower()]
            if word[-1] in MARKS and word[:-1].isalpha():
                return [word[:-1].lower(), word[-1]]
        for start in self._special_starts:
            if start in word:
                break
        else:
            return self._pieces(word)
        out: list[str | int] = []
        for n, part in enumerate(self._special.split(word)):
            out += [self.special[part]] if n % 2 else self._pieces(part)
        return out

    def _pieces(self, text: str) -> list[str]:
        """Pieces of a text without white space or special strings."""
        if text.isascii() and not UNUSUAL.search(text):
            return self._piece.findall(text.lower())
        if UNUSUAL.search(text):
            normal = self._library.normalizer.normalize_str(text)
            return [p for p, _ in self._library.pre_tokenizer.pre_tokenize_str(normal)]
        symbols = self._symbols
        return [
            p if p.isascii() else "".join([symbols[b] for b in p.encode()])
            for p in self._piece.findall(text.lower())
        ]

    def encoded(self, fragment: str, ending: bool) -> list[int]:
        """Ids of byte symbols that are merged with nothing beside them."""
        model = self._ending if ending else self._inside
        return [token.id for token in model.tokenize(fragment)]


@lru_cache(maxsize=2)
def vocabulary(path: str = DEFAULT_VOCABULARY) -> Vocabulary:
    """The vocabulary of a file, read once in each worker."""
    return Vocabulary(path)
