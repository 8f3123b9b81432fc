"""Pre-tokens of the two public BPE vocabularies, and their ids.

Texts within Latin-1 and without an apostrophe are cut by a few array
operations on character classes; every other text is cut by the tokenizers
library itself, so the pieces are the library's in each case.
"""

from __future__ import annotations

import functools
import os
import re
import struct

import numpy as np

LETTER, NUMBER, OTHER, SPACE = 0, 1, 2, 3
BYTE_FILE, WORD_FILE = "byte_bpe_50k.json", "word_bpe_49k.json"
#: Words kept per worker; a full cache is emptied, never the input.
CACHE_WORDS = 400_000


def vocabulary_path(name: str) -> str:
    """Where the public vocabulary files are; CARTWISE_TOKENIZERS overrides."""
    folder = os.environ.get("CARTWISE_TOKENIZERS")
    if folder:
        return os.path.join(folder, name)
    import public_tokenizers

    return public_tokenizers.path(name)


@functools.cache
def library(name: str):
    os.environ["TOKENIZERS_PARALLELISM"] = "false"
    from tokenizers import Tokenizer

    made = Tokenizer.from_file(vocabulary_path(name))
    made.no_truncation()
    made.no_padding()
    return made


@functools.cache
def _classes() -> np.ndarray:
    """Class of each Latin-1 character by its Unicode category, which is
    settled for this range."""
    import unicodedata

    kinds = np.full(256, OTHER, np.uint8)
    for code in range(256):
        category = unicodedata.category(chr(code))[0]
        kinds[code] = {"L": LETTER, "N": NUMBER}.get(category, OTHER)
    kinds[[9, 10, 11, 12, 13, 32, 0x85, 0xA0]] = SPACE
    return kinds


def _latin(text: str) -> np.ndarray | None:
    if "'" in text:
        return None
    try:
        return np.frombuffer(text.encode("latin-1"), np.uint8)
    except UnicodeEncodeError:
        return None


def byte_pieces(text: str) -> list[str]:
    """Pre-tokens of the byte-level vocabulary, in order; they join to `text`."""
    if not text:
        return []
    codes = _latin(text)
    if codes is None:
        mapped = library(BYTE_FILE).pre_tokenizer.pre_tokenize_str(text)
        return [text[a:b] for _, (a, b) in mapped] if text.isascii() else [_unmapped(piece) for piece, _ in mapped]
    kinds = _classes()[codes]
    space = kinds == SPACE
    starts = np.empty(len(kinds), bool)
    starts[0] = True
    np.not_equal(kinds[1:], kinds[:-1], out=starts[1:])
    starts[1:] &= space[1:] | (codes[:-1] != 32)  # one blank goes with what follows it
    starts[:-1] |= space[:-1] & ~space[1:]  # the last of several white spaces stands alone or goes on
    at = np.flatnonzero(starts).tolist()
    return [text[a:b] for a, b in zip(at, at[1:] + [len(text)])]


def word_pieces(text: str) -> list[str]:
    """Normalised pre-tokens of the word vocabulary, in order, without white
    space."""
    if not text:
        return []
    codes = _latin(text)
    if codes is None:
        word = library(WORD_FILE)
        return [_unmapped(piece) for piece, _ in word.pre_tokenizer.pre_tokenize_str(word.normalizer.normalize_str(text))]
    kinds = _classes()[codes]
    starts = np.empty(len(kinds), bool)
    starts[0] = True
    np.not_equal(kinds[1:], kinds[:-1], out=starts[1:])
    starts |= kinds == NUMBER
    first = np.flatnonzero(starts)
    stops = np.append(first[1:], len(kinds))
    kept = kinds[first] != SPACE
    lower = text.lower()
    return [lower[a:b] for a, b in zip(first[kept].tolist(), stops[kept].tolist())]


@functools.cache
def _byte_letters() -> tuple[dict[int, str], dict[str, int]]:
    """The printable letter that stands for each byte, and back."""
    plain = [*range(33, 127), *range(161, 173), *range(174, 256)]
    rest = [b for b in range(256) if b not in plain]
    there = {b: chr(b) for b in plain} | {b: chr(256 + i) for i, b in enumerate(rest)}
    return there, {letter: b for b, letter in there.items()}


def mapped(piece: str) -> str:
    """A piece in byte-level letters."""
    return piece.encode().decode("latin-1").translate(_byte_letters()[0])


def _unmapped(piece: str) -> str:
    back = _byte_letters()[1]
    return bytes(back[letter] for letter in piece).decode()


def parts(text: str, specials: re.Pattern) -> list[str]:
    """`text` cut at special strings: plain text and special strings in turn."""
    return specials.split(text) if "<|" in text else [text]


@functools.cache
def special_ids(name: str) -> dict[str, int]:
    return {token.content: number for number, token in library(name).get_added_tokens_decoder().items()}


@functools.cache
def special_pattern(name: str) -> re.Pattern:
    return re.compile("(" + "|".join(map(re.escape, special_ids(name))) + ")")


class ByteIds:
    """Ids of the byte-level vocabulary as little-endian 32-bit bytes. Each
    distinct piece is encoded by the library once per worker."""

    def __init__(self) -> None:
        self.model = library(BYTE_FILE).model
        self.specials = special_ids(BYTE_FILE)
        self.pattern = special_pattern(BYTE_FILE)
        self.known: dict[str, bytes] = {}

    def _piece(self, piece: str) -> bytes:
        ids = [token.id for token in self.model.tokenize(mapped(piece))]
        return struct.pack(f"<{len(ids)}I", *ids)

    def _plain(self, text: str) -> list[bytes]:
        pieces, known = byte_pieces(text), self.known
        try:
            return [known[piece] for piece in pieces]
        except KeyError:
            if len(known) > CACHE_WORDS:
                known.clear()
            for piece in set(pieces).difference(known):
                known[piece] = self._piece(piece)
            return [known[piece] for piece in pieces]

    def encode(self, text: str | None) -> bytes:
        if not text:
            return b""
        out: list[bytes] = []
        for part in parts(text, self.pattern):
            if part in self.specials:
                out.append(struct.pack("<I", self.specials[part]))
            else:
                out += self._plain(part)
        return b"".join(out)
