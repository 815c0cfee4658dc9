"""Token ids by the tokenizers library, with each distinct word encoded once."""

from __future__ import annotations

import json
import os
import re

import numpy as np

from .common import MEMORY_BYTES, Words, remembers

# The classes that the pre-tokenizer's pattern names, within Latin-1 and after lower-casing.
_LETTER = "a-zªµºß-öø-ÿ"
_NUMBER = "0-9²³¹¼½¾"
_SPACE = "\t-\r \x85\xa0"
_PIECES = re.compile(rf"'s|'t|'re|'ve|'m|'ll|'d|[{_LETTER}]+|[{_NUMBER}]|[^{_SPACE}{_LETTER}{_NUMBER}]+")
_PATTERN = r"'s|'t|'re|'ve|'m|'ll|'d|[\p{L}]+|[\p{N}]|[^\s\p{L}\p{N}]+"
_NORMALIZERS = ["NFC", "Replace", "Lowercase"]

_LOWER = bytes(ord(chr(i).lower()) for i in range(256))


def _byte_letters() -> dict[int, str]:
    """What the byte-level step makes of a Latin-1 character: a letter for each byte of its UTF-8 form."""
    plain = [*range(33, 127), *range(161, 173), *range(174, 256)]
    other = {b: chr(256 + k) for k, b in enumerate(b for b in range(256) if b not in plain)}
    return {i: "".join(other.get(b, chr(b)) for b in chr(i).encode()) for i in range(256) if i != 32}


_BYTES = _byte_letters()
_ENDS = frozenset(b".,;:!?")
_ENCODERS: dict[str, "Encoder"] = {}


def _split(word: bytes) -> list[str]:
    """The pre-tokenizer's pieces of a word between white space."""
    if word.isalpha():
        return [word.decode("ascii")]
    if word[-1] in _ENDS and word[:-1].isalpha():
        return [word[:-1].decode("ascii"), chr(word[-1])]
    return _PIECES.findall(word.decode("latin-1"))


class Encoder:
    """Encodes texts as little-endian unsigned 32-bit ids.

    The result equals ``Tokenizer.encode(text, add_special_tokens=False).ids``.
    With a tokenizer of word pieces (lower case, white space dropped) a piece
    never depends on its neighbours, so each distinct piece goes to the library
    once. Texts beyond Latin-1, texts that may hold a special token, and other
    tokenizers go to the library whole.
    """

    def __init__(self, path: str):
        os.environ["TOKENIZERS_PARALLELISM"] = "false"
        from tokenizers import Tokenizer, normalizers, pre_tokenizers

        self.tokenizer = Tokenizer.from_file(path)
        self.model = Tokenizer.from_file(path)  # for pieces: normalised and split already
        self.model.normalizer, self.model.pre_tokenizer = normalizers.Sequence([]), pre_tokenizers.WhitespaceSplit()
        with open(path, encoding="utf-8") as f:
            spec = json.load(f)
        pre = (spec.get("pre_tokenizer") or {}).get("pretokenizers") or [{}]
        self.by_word = (
            [x["type"] for x in (spec.get("normalizer") or {}).get("normalizers", [])] == _NORMALIZERS
            and pre[0].get("pattern") == {"Regex": _PATTERN}
            and spec["model"].get("end_of_word_suffix") == "</w>"
        )
        vocab = self.tokenizer.get_vocab()
        self.ends = np.zeros(max(vocab.values()) + 1, bool)
        self.ends[[i for w, i in vocab.items() if w.endswith("</w>")]] = True
        self.special = [x["content"] for x in spec.get("added_tokens", [])]
        self.memo = Words()  # ids by lower-cased word between white space, and by piece

    def whole(self, text: str) -> bytes:
        return np.array(self.tokenizer.encode(text, add_special_tokens=False).ids, "<u4").tobytes()

    def learn(self, words: list[str]) -> dict[str, bytes]:
        """The ids of pieces; many go to the library as one text."""
        found: dict[str, bytes] = {}
        groups = [words[at : at + 256] for at in range(0, len(words), 256)]
        for some, got in zip(groups, self.model.encode_batch_fast([" ".join(g).translate(_BYTES) for g in groups], add_special_tokens=False)):
            ids = np.array(got.ids, "<u4")
            cuts = np.flatnonzero(self.ends[ids]) + 1
            if len(cuts) == len(some) and cuts[-1] == len(ids):
                raw, to = ids.tobytes(), (cuts * 4).tolist()
                found.update(zip(some, map(raw.__getitem__, map(slice, [0, *to], to))))
            else:
                found.update((w, self.whole(w)) for w in some)
        return found

    def encode(self, texts: list[str]) -> list[bytes]:
        remembers(f"tokens {id(self)}", self.memo.clear)
        out: list[bytes] = [b""] * len(texts)
        split: list[tuple[int, list[bytes]]] = []
        for i, text in enumerate(texts):
            try:
                raw = text.encode("latin-1").translate(_LOWER) if self.by_word else None
            except UnicodeEncodeError:
                raw = None
            if raw is None or any(s in text for s in self.special):
                out[i] = self.whole(text)
            else:
                split.append((i, raw.split()))  # at ASCII white space; the rest is for the pattern
        memo, get = self.memo, self.memo.get
        found = [(i, ws, list(map(get, ws))) for i, ws in split]
        lacking = [x for x in found if None in x[2]]
        new = {w: _split(w) for w in {w for _, ws, vs in lacking for w, v in zip(ws, vs) if v is None}}
        piece = {p: memo.get(p.encode("latin-1")) for ps in new.values() for p in ps}
        piece.update(self.learn([p for p, v in piece.items() if v is None]))
        fresh = {p.encode("latin-1"): v for p, v in piece.items()}
        fresh.update((w, b"".join(map(piece.__getitem__, ps))) for w, ps in new.items() if len(ps) != 1 or len(ps[0]) != len(w))
        for i, ws, vs in found:
            out[i] = b"".join([fresh[w] if v is None else v for w, v in zip(ws, vs)] if None in vs else vs)
        memo.keep(fresh)
        return out


def encoder(path: str, memory: int = MEMORY_BYTES) -> Encoder:
    """The encoder of this Python worker for a vocabulary file, remembering words in at most ``memory`` bytes."""
    if path not in _ENCODERS:
        _ENCODERS[path] = Encoder(path)
    memo = _ENCODERS[path].memo
    if memo.most > memory:
        memo.clear()
    memo.most = memory
    return _ENCODERS[path]


def chunks(texts: list, most: int = 1_000_000):
    """Ranges of a batch that hold about ``most`` characters at a time."""
    start = size = 0
    for i, t in enumerate(texts):
        size += len(t or "")
        if size >= most:
            yield start, i + 1
            start, size = i + 1, 0
    if start < len(texts):
        yield start, len(texts)
