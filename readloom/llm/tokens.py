"""Token ids of whole texts by a public tokenizer, through Arrow batches.

The word tokenizer lower-cases, drops white space and cuts letters, single digits and marks apart before its model sees
them. Such pieces repeat far more than texts do: their ids are kept in a bounded dictionary per worker process. Texts of
ASCII and Latin-1 letters are cut into pieces here by the tokenizer's own pattern, block by block; other texts
chunk by chunk between spaces, where a chunk that has other characters goes through the whole tokenizer and is kept likewise. Texts that name a special token, and all texts
where the tokenizer's settings are others, are encoded whole.
"""

from __future__ import annotations

import json
import os
import re
from array import array
from functools import lru_cache

#: Entries of one generation; a dictionary holds two, and what is used passes to the newer one.
CACHE = 250_000
#: Characters of a block that go through the pattern at once, about.
BLOCK = 1 << 20
LATIN = re.compile(r"[\t\n\r -~À-ÖØ-öø-ÿ]*")
PIECES = re.compile(r"[a-zß-öø-ÿ]+|'s|'t|'re|'ve|'m|'ll|'d|[0-9]|[^\sa-zß-öø-ÿ0-9]+")

# The settings of the tokenizer that PIECES and LATIN stand for.
NORMALIZER = {"type": "Sequence", "normalizers": [{"type": "NFC"}, {"type": "Replace", "pattern": {"Regex": "\\s+"}, "content": " "}, {"type": "Lowercase"}]}
SPLIT = r"'s|'t|'re|'ve|'m|'ll|'d|[\p{L}]+|[\p{N}]|[^\s\p{L}\p{N}]+"


def tokenizer_path(name: str) -> str:
    if os.path.isabs(name):
        return name
    import public_tokenizers

    return public_tokenizers.path(name)


class Kept(dict):
    """A dictionary that computes what it lacks and forgets what went unused for a generation."""

    def __init__(self, compute):
        super().__init__()
        self.compute, self.old = compute, {}

    def __missing__(self, key):
        value = self.old.get(key)
        if value is None:
            value = self.compute(key)
        if len(self) >= CACHE:
            self.old = dict(self)
            self.clear()
        self[key] = value
        return value


def _byte_letters() -> dict[int, str]:
    """Byte-level alphabets show printable bytes as themselves, the others as the characters from 256 on."""
    plain = [*range(33, 127), *range(161, 173), *range(174, 256)]
    other = [b for b in range(256) if b not in plain]
    return {b: chr(b) for b in plain} | {b: chr(256 + k) for k, b in enumerate(other)}


class Encoder:
    def __init__(self, path: str):
        os.environ["TOKENIZERS_PARALLELISM"] = "false"
        from tokenizers import Tokenizer

        self.tokenizer = Tokenizer.from_file(path)
        if self.tokenizer.get_vocab_size() > 65536:
            raise ValueError("ids of this tokenizer don't fit 16 bits")
        with open(path, encoding="utf-8") as f:
            settings = json.load(f)
        steps = (settings["pre_tokenizer"] or {}).get("pretokenizers", [{}])
        self.words = settings["normalizer"] == NORMALIZER and [x.get("pattern") for x in steps] == [{"Regex": SPLIT}, None] and steps[1]["type"] == "ByteLevel"
        self.special = [x["content"] for x in settings["added_tokens"]]
        self.model, self.letters = self.tokenizer.model, _byte_letters()
        self.pieces, self.chunks = Kept(self._piece), Kept(self._chunk)

    def _piece(self, piece: str) -> bytes:
        if not piece.isascii():
            piece = "".join(map(self.letters.__getitem__, piece.encode()))
        return array("H", [t.id for t in self.model.tokenize(piece)]).tobytes()

    def _whole(self, text: str) -> bytes:
        return array("H", self.tokenizer.encode(text, add_special_tokens=False).ids).tobytes() if text else b""

    def _latin(self, text: str) -> bytes:
        return b"".join(map(self.pieces.__getitem__, PIECES.findall(text.lower())))

    def _chunk(self, chunk: str) -> bytes:
        return self._latin(chunk) if LATIN.fullmatch(chunk) else self._whole(chunk)

    def __call__(self, text: str | None) -> bytes:
        """Little-endian 16-bit ids (of the machines Spark runs on)."""
        text = text or ""
        if not self.words or any(x in text for x in self.special):
            return self._whole(text)
        if not LATIN.fullmatch(text):
            return b"".join(map(self.chunks.__getitem__, text.replace("\n", " ").split(" ")))
        out, at = [], 0
        while at < len(text):
            end = text.find(" ", at + BLOCK)
            end = len(text) if end < 0 else end
            out.append(self._latin(text[at:end]))
            at = end
        return b"".join(out)


@lru_cache(maxsize=2)
def encoder(name: str) -> Encoder:
    """The process's encoder: Python workers serve many tasks."""
    return Encoder(tokenizer_path(name))
