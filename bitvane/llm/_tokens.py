"""Token ids of whole texts by a tokenizer that drops white space, a distinct piece at a time.

Texts in Latin-1 take the short way: the tokenizer's splitting pattern, written out for Latin-1, cuts
the lower-cased text, and each distinct piece goes to the tokenizer's model once and is
remembered. Normalisation changes nothing else in Latin-1. Other texts are cut at spaces and
line feeds, across which that tokenizer never looks, and each distinct run goes to the whole
tokenizer. What is remembered is bounded, in two generations.

Both ways are taken only for a tokenizer whose file states the settings that they are written for.
Texts that hold a special token's string, and all texts of any other tokenizer, go to the library
as they are.
"""

from __future__ import annotations

import hashlib
import json
import re
from collections.abc import Sequence
from dataclasses import dataclass

import numpy as np
from tokenizers import Tokenizer

_SPLIT = re.compile(r"[ \n]+")
# Latin-1's letters (lower case), digits and other numbers, and white space.
_LETTERS, _NUMBERS, _SPACES = "a-z\u00aa\u00b5\u00ba\u00df-\u00f6\u00f8-\u00ff", "0-9\u00b2\u00b3\u00b9\u00bc-\u00be", "\t-\r \u0085\u00a0"
_PIECES = re.compile(f"'s|'t|'re|'ve|'m|'ll|'d|[{_LETTERS}]+|[{_NUMBERS}]|[^{_SPACES}{_LETTERS}{_NUMBERS}]+")
# The settings that the short ways are written for.
_NORMALIZER = {"type": "Sequence", "normalizers": [{"type": "NFC"}, {"type": "Replace", "pattern": {"Regex": r"\s+"}, "content": " "}, {"type": "Lowercase"}]}
_PRE_TOKENIZER = {
    "type": "Sequence",
    "pretokenizers": [
        {"type": "Split", "pattern": {"Regex": r"'s|'t|'re|'ve|'m|'ll|'d|[\p{L}]+|[\p{N}]|[^\s\p{L}\p{N}]+"}, "behavior": "Removed", "invert": True},
        {"type": "ByteLevel", "add_prefix_space": False, "trim_offsets": True, "use_regex": False},
    ],
}
_loaded: dict[str, WordTokenizer] = {}


def _visible_bytes() -> dict[str, str]:
    """Each Latin-1 character's UTF-8 bytes as byte-level models write them: printable ones as themselves, others from 256 on."""
    shown = [*range(ord("!"), ord("~") + 1), *range(0xA1, 0xAD), *range(0xAE, 0x100)]
    hidden = [b for b in range(256) if b not in set(shown)]
    of = {b: chr(b) for b in shown} | {b: chr(256 + i) for i, b in enumerate(hidden)}
    return str.maketrans({chr(c): "".join(of[b] for b in chr(c).encode()) for c in range(256)})


def _as_written(settings: dict) -> bool:
    """Whether a tokenizer's file has the settings that the short ways stand for."""
    model, added = settings["model"], settings["added_tokens"]
    plain = all(not (t["normalized"] or t["lstrip"] or t["rstrip"] or t["single_word"]) and t["content"] and not any(c.isspace() for c in t["content"]) for t in added)
    whole = model["type"] == "BPE" and not model.get("dropout") and model.get("unk_token") is None and not model.get("continuing_subword_prefix")
    cut = settings["truncation"] is None and settings["padding"] is None and settings["post_processor"] is None
    return plain and whole and cut and settings["normalizer"] == _NORMALIZER and settings["pre_tokenizer"] == _PRE_TOKENIZER


@dataclass(frozen=True)
class TokenizerFile:
    """The text of a tokenizer's file and what it says of the ways to take: read on the driver, sent to the workers."""

    text: str
    short_way: bool
    special: tuple[str, ...]
    key: str

    @classmethod
    def of(cls, text: str) -> TokenizerFile:
        settings = json.loads(text)
        return cls(text, _as_written(settings), tuple(t["content"] for t in settings["added_tokens"]), hashlib.sha256(text.encode()).hexdigest())

    @classmethod
    def read(cls, path: str) -> TokenizerFile:
        with open(path, encoding="utf-8") as f:
            return cls.of(f.read())


class WordTokenizer:
    def __init__(self, file: TokenizerFile, most: int = 250_000):
        self.tokenizer = Tokenizer.from_str(file.text)
        self.model, self.visible, self.most = self.tokenizer.model, _visible_bytes(), most
        self.pieces: tuple[dict[str, bytes], dict[str, bytes]] = ({}, {})  # young and old
        self.runs: tuple[dict[str, bytes], dict[str, bytes]] = ({}, {})
        self.short_way = file.short_way
        self.special = re.compile("|".join(map(re.escape, file.special))) if file.special else None

    @classmethod
    def of(cls, file: TokenizerFile) -> WordTokenizer:
        """One for each tokenizer and process."""
        if file.key not in _loaded:
            _loaded[file.key] = cls(file)
        return _loaded[file.key]

    def _whole(self, texts: Sequence[str]) -> list[bytes]:
        return [np.array(got.ids, np.uint32).tobytes() for got in self.tokenizer.encode_batch(list(texts), add_special_tokens=False)]

    def _piece(self, piece: str) -> bytes:
        young, old = self.pieces
        got = old.get(piece)
        if got is None:
            got = np.array([t.id for t in self.model.tokenize(piece.translate(self.visible))], np.uint32).tobytes()
        if len(piece) <= 64:
            young[piece] = got
            if len(young) > self.most:
                self.pieces = ({}, young)
        return got

    def _short(self, text: str) -> bytes:
        learn = self._piece
        out, known = [], self.pieces[0].get
        for piece in _PIECES.findall(text.lower()):
            got = known(piece)
            if got is None:
                got = learn(piece)
                known = self.pieces[0].get
            out.append(got)
        return b"".join(out)

    def _long(self, text: str) -> bytes:
        words = _SPLIT.split(text)
        young, old = self.runs
        unseen = []
        for word in set(words):
            if word not in young:
                if word in old:
                    young[word] = old[word]
                else:
                    unseen.append(word)
        young.update(zip(unseen, self._whole(unseen)))
        out = b"".join([young[w] for w in words])
        if len(young) > self.most // 4:
            self.runs = ({}, young)
        return out

    def forget(self) -> None:
        """Let go of what is remembered: a worker that waits shares the executor's limit with others."""
        self.pieces, self.runs = ({}, {}), ({}, {})

    def _ids(self, text: str) -> bytes:
        if not self.short_way or self.special is not None and self.special.search(text):
            return self._whole([text])[0]
        try:
            text.encode("latin-1")
        except UnicodeEncodeError:
            return self._long(text)
        return self._short(text)

    def ids(self, texts: Sequence[str]) -> list[np.ndarray]:
        """Each text's ids, uint32."""
        return [np.frombuffer(self._ids(text), np.uint32) for text in texts]
