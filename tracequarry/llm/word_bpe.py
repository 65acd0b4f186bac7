"""Ids of a word-level BPE tokenizer file, as the tokenizers library gives them, at several times its speed.

The tokenizer drops white space, so a text's ids are those of its blank-free pieces one after the
other. Pieces repeat, so each worker keeps a bounded table from piece to its ids (packed
little-endian unsigned 32-bit). A piece of ASCII and Latin-1 letters, digits and plain marks splits
into the same pre-tokens that the library's pattern finds and only the model runs on each; any
other piece (apostrophes, other scripts, special strings) goes through the whole library.
``checked`` makes sure that the file is of the kind for which this holds; other files always take the
library on whole texts.
"""

from __future__ import annotations

import json
import re
from array import array
from functools import lru_cache

PATTERN = "'s|'t|'re|'ve|'m|'ll|'d|[\\p{L}]+|[\\p{N}]|[^\\s\\p{L}\\p{N}]+"
#: Python splits at these, the tokenizer doesn't.
ODD = re.compile("[\x1c-\x1f]")
BLANK = re.compile("[\t-\r ]+")
LETTER = "A-Za-zÀ-ÖØ-öø-ÿ"
MARK = "!-&(-/:-@\\[-`{-~"
PLAIN = re.compile(f"[{LETTER}0-9{MARK}]+")
LETTERS = re.compile(f"[{LETTER}]+")
ENDS = frozenset(".,|;:!?")
PART = re.compile(f"[{LETTER}]+|[0-9]|[{MARK}]+")
#: Pieces that a worker keeps at most, in two generations: what the newer one doesn't ask for goes.
KEPT = 700_000


def default_path() -> str:
    import public_tokenizers

    return public_tokenizers.path("word_bpe_49k.json")


def checked(spec: dict) -> bool:
    """Is this a file whose ids are the ids of its blank-free pieces?"""
    norm = [(x.get("type"), x.get("content")) for x in (spec.get("normalizer") or {}).get("normalizers", [])]
    pre = (spec.get("pre_tokenizer") or {}).get("pretokenizers", [])
    split, level = (pre + [{}, {}])[:2]
    return (
        norm == [("NFC", None), ("Replace", " "), ("Lowercase", None)]
        and (split.get("pattern") or {}).get("Regex") == PATTERN
        and split.get("invert") is True
        and level.get("type") == "ByteLevel"
        and not level.get("use_regex")
        and not level.get("add_prefix_space")
        and spec.get("post_processor") is None
        and not spec.get("truncation")
        and all(re.fullmatch(r"<\|\S+", x["content"]) and not (x["lstrip"] or x["rstrip"] or x["single_word"]) for x in spec["added_tokens"])
    )


def byte_letters() -> list[str]:
    """The printable letter that byte-level tokenizers put for each byte."""
    plain = [*range(33, 127), *range(161, 173), *range(174, 256)]
    return [chr(b) if b in plain else chr(256 + [x for x in range(256) if x not in plain].index(b)) for b in range(256)]


class Pieces(dict):
    """piece -> packed ids; a missing piece is worked out when it is looked up."""

    def __init__(self, path: str):
        from tokenizers import Tokenizer

        super().__init__()
        self.older: dict[str, bytes] = {}
        self.tokenizer = Tokenizer.from_file(path)
        self.model = self.tokenizer.model
        self.letters = str.maketrans(dict(enumerate(byte_letters())))
        self.split = checked(json.load(open(path, encoding="utf-8")))

    def whole(self, text: str) -> bytes:
        return array("I", self.tokenizer.encode(text, add_special_tokens=False).ids).tobytes()

    def word(self, part: str) -> bytes:
        low = part.lower()
        if not part.isascii():
            low = low.encode().decode("latin-1").translate(self.letters)
        return array("I", [t.id for t in self.model.tokenize(low)]).tobytes()

    def __missing__(self, piece: str) -> bytes:
        ids = self.older.get(piece)
        if ids is None:
            if len(piece) > 5000:  # not worth keeping
                return self.whole(piece)
            if piece.isascii() and piece.isalpha():
                ids = self.word(piece)
            elif piece[-1:] in ENDS and piece[:-1].isalpha() and LETTERS.fullmatch(piece, 0, len(piece) - 1):
                ids = self[piece[:-1]] + self[piece[-1]]
            elif "<|" in piece or not PLAIN.fullmatch(piece):
                ids = self.whole(piece) if piece else b""
            elif len(parts := PART.findall(piece)) == 1:
                ids = self.word(piece)
            else:
                ids = b"".join(map(self.__getitem__, parts))
        if len(self) >= KEPT // 2:
            self.older = dict(self)
            self.clear()
        self[piece] = ids
        return ids

    def encode(self, text: str) -> bytes:
        if not self.split:
            return self.whole(text)
        return b"".join(map(self.__getitem__, BLANK.split(text) if ODD.search(text) else text.split()))


@lru_cache(maxsize=4)
def pieces(path: str) -> Pieces:
    return Pieces(path)
