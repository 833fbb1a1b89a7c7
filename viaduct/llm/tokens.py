"""Token ids of whole texts, by a public tokenizer file.

Encoding a text equals encoding its space-separated chunks one by one when no token may hold white
space, so each distinct chunk is encoded once a worker and stage, or once a filling of its cache, and then looked up.
"""

from __future__ import annotations

import json
import os
import re
import sys
from array import array

from viaduct.llm.batches import kept

DEFAULT_FILE = "word_bpe_49k.json"
#: What has to hold for chunks to be encoded alone: fixed values of the tokenizer file's own format.
PATTERN = r"'s|'t|'re|'ve|'m|'ll|'d|[\p{L}]+|[\p{N}]|[^\s\p{L}\p{N}]+"
CHUNKS, PIECES = 300_000, 400_000  # cached entries a worker; a full cache starts anew, and frequent ones soon return


def default_path() -> str:
    import public_tokenizers

    return public_tokenizers.path(DEFAULT_FILE)


def _byte_letters() -> dict[int, str]:
    """Byte-level BPE writes printable bytes as themselves and the others from code point 256 on."""
    plain = {*range(33, 127), *range(161, 173), *range(174, 256)}
    rest = iter(range(256, 512))
    return {b: chr(b) if b in plain else chr(next(rest)) for b in range(256)}


class Encoder:
    """``ids(text)`` are the ids as little-endian unsigned ``width``-byte integers."""

    def __init__(self, path: str):
        import regex
        from tokenizers import Tokenizer

        os.environ.setdefault("TOKENIZERS_PARALLELISM", "false")
        self.whole = Tokenizer.from_file(path)
        with open(path, encoding="utf-8") as f:
            spec = json.load(f)
        parts = (spec.get("pre_tokenizer") or {}).get("pretokenizers") or [{}]
        steps = [x.get("type") for x in (spec.get("normalizer") or {}).get("normalizers") or []]
        self.by_chunk = parts[0].get("pattern", {}).get("Regex") == PATTERN and steps == ["NFC", "Replace", "Lowercase"] and spec["model"]["type"] == "BPE"
        self.special = [x["content"] for x in spec.get("added_tokens", [])]
        self.width = 2 if self.whole.get_vocab_size() <= 1 << 16 else 4
        self.find = regex.compile(PATTERN).findall
        self.letters = _byte_letters()
        self.chunks: dict[str, bytes] = {"": b""}
        self.pieces: dict[str, bytes] = {}
        self.unsafe = re.compile("[\x00-\x1f\x7f-\xa0İɐ-\U0010ffff]").search

    def _pack(self, ids: list[int]) -> bytes:
        packed = array("H" if self.width == 2 else "I", ids)
        if sys.byteorder == "big":
            packed.byteswap()
        return packed.tobytes()

    def _piece(self, piece: str) -> bytes:
        got = self.pieces.get(piece)
        if got is None:
            seen = piece if piece.isascii() else "".join([self.letters[b] for b in piece.encode()])
            got = self._pack([t.id for t in self.whole.model.tokenize(seen)])
            if len(self.pieces) >= PIECES:
                self.pieces.clear()
            self.pieces[piece] = got
        return got

    def _chunk(self, chunk: str) -> bytes:
        if chunk.isascii() and len(chunk) <= 200:  # plain words, which need no further look
            if chunk.isalpha():
                return self._piece(chunk.lower())
            if chunk[-1] in ".,;:!?" and chunk[:-1].isalpha():
                return self._piece(chunk[:-1].lower()) + self._piece(chunk[-1])
        if "<" in chunk and any(x in chunk for x in self.special) or self.unsafe(chunk) or len(chunk) > 200:
            return self._pack(self.whole.encode(chunk, add_special_tokens=False).ids)
        if chunk.isalpha():
            return self._piece(chunk.lower())
        if chunk[-1] in ".,;:!?" and chunk[:-1].isalpha():
            return self._piece(chunk[:-1].lower()) + self._piece(chunk[-1])
        return b"".join([self._piece(p) for p in self.find(chunk.lower())])

    def ids(self, text: str | None) -> bytes:
        if not text:
            return b""
        if not self.by_chunk or any(c in text for c in "\x1c\x1d\x1e\x1f"):
            return self._pack(self.whole.encode(text, add_special_tokens=False).ids)
        words = text.split()
        out = list(map(self.chunks.get, words))
        for i in [i for i, x in enumerate(out) if x is None]:
            word = words[i]
            out[i] = got = self._chunk(word)
            if len(word) <= 64:
                if len(self.chunks) >= CHUNKS:
                    self.chunks.clear()
                self.chunks[word] = got
        return b"".join(out)


def encoder(path: str) -> Encoder:
    """The encoder of one stage's tasks in a worker. It goes when another stage runs there, which needs the memory."""
    return kept(path, lambda: Encoder(path))
