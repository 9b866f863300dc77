"""Token ids of whole texts, by the tokenizers library, in bulk.

Byte-level BPE never merges across a pre-token, so a text may be cut at any place where a
pre-token certainly ends, and each distinct piece has to be encoded once only. The places
used here are single spaces before something that is not white space.
"""

from __future__ import annotations

import re
from array import array

import numpy as np

from .shared import lasting

#: Pieces remembered by a worker process (some 200 bytes each); further ones are encoded
#: whenever they come up.
REMEMBERED = 500_000
#: Texts that are cut into pieces at a time.
TEXTS = 128
_RISKY = re.compile(r" (?:\s|$)")  # runs of white space: where they end matters
_SAFE_CUT = re.compile(r"(?<=\S)(?= \S)")
# Letters in every version of Unicode.
_LATIN = re.compile(r"[A-Za-z\u00c0-\u00d6\u00d8-\u00f6\u00f8-\u024f]+")

# A word, the end of its line, and the first of the next one.
_LINE_END = re.compile(rf"({_LATIN.pattern})([.,]?)\n(\S+)")


class BulkEncoder:
    """Encodes as ``Tokenizer.encode(text, add_special_tokens=False)``, to packed ids."""

    def __init__(self, path: str, remembered: int | None = None):
        from tokenizers import Tokenizer

        self.remembered = REMEMBERED if remembered is None else remembered
        self.tokenizer = Tokenizer.from_file(path)
        self.special = tuple(
            token.content for token in self.tokenizer.get_added_tokens_decoder().values()
        )
        self.width = np.zeros(self.tokenizer.get_vocab_size(), np.int64)
        for token, number in self.tokenizer.get_vocab().items():
            self.width[number] = len(token)  # a character stands for a byte
        #: How byte-level BPE shows a byte: bytes without a visible sign get the code
        #: points from 256 on.
        visible = {*range(33, 127), *range(161, 173), *range(174, 256)}
        hidden = (byte for byte in range(256) if byte not in visible)
        self.shown = {byte: 256 + i for i, byte in enumerate(hidden)}
        self.space = chr(self.shown[32])
        self.tokenize = self.tokenizer.model.tokenize
        self.stops = {stop: self.whole(stop) for stop in ".,"}
        self.line_end = self.whole("\n")
        self.known: dict[str, bytes] = {}

    def whole(self, text: str) -> bytes:
        return array("I", self.tokenizer.encode(text, add_special_tokens=False).ids).tobytes()

    def _learn(self, pieces: list[str], into: dict[str, bytes]) -> None:
        """Encode the pieces joined, and find each one's ids by their widths in bytes.

        Every piece begins with a space and something else, so the joints are safe cuts.
        """
        joined = "".join(pieces)
        encoded = self.tokenizer.encode_batch_fast([joined], add_special_tokens=False)[0].ids
        ids = np.array(encoded, "<u4")
        ends = np.searchsorted(
            np.cumsum(self.width[ids]), np.cumsum([len(p.encode()) for p in pieces])
        )
        packed = ids.tobytes()
        start = 0
        for piece, end in zip(pieces, ((ends + 1) * 4).tolist(), strict=True):
            into[piece[1:]] = packed[start:end]
            start = end

    def batch(self, texts: list[str | None]) -> list[bytes]:
        """Little-endian unsigned 32-bit ids of each text; a null text has none."""
        out: list[bytes] = []
        for start in range(0, len(texts), TEXTS):
            out += self._some(texts[start : start + TEXTS])
        return out

    def _some(self, texts: list[str | None]) -> list[bytes]:
        out: list[bytes] = [b""] * len(texts)
        held: list[tuple[int, list[str], list[bytes | None], list[int]]] = []
        missing: set[str] = set()
        known = self.known
        for i, text in enumerate(texts):
            if not text:
                continue
            if any(token in text for token in self.special):
                out[i] = self.whole(text)
                continue
            if _RISKY.search(text):
                pieces = _SAFE_CUT.split(text)
                head, pieces = pieces[0], [piece[1:] for piece in pieces[1:]]
            else:
                head, *pieces = text.split(" ")
            ids = list(map(known.get, pieces))
            gaps = [k for k, one in enumerate(ids) if one is None] if None in ids else []
            if gaps:
                missing.update([pieces[k] for k in gaps])
                out[i] = self._start(head)
                held.append((i, pieces, ids, gaps))
            else:
                out[i] = self._start(head) + b"".join(ids)
        self._learn_all(missing)
        for i, pieces, ids, gaps in held:
            for k in gaps:
                ids[k] = known[pieces[k]]
            out[i] += b"".join(ids)
        if len(known) > self.remembered:  # those that came last go again
            for piece in missing:
                del known[piece]
        return out

    def _learn_all(self, pieces: set[str]) -> None:
        """Encode each piece as it stands after a space."""
        known, mixed, latin = self.known, [], _LATIN.fullmatch
        for piece in pieces:
            if latin(piece):
                known[piece] = self._word(piece)
            elif piece[-1] in self.stops and latin(piece[:-1]):
                stem = piece[:-1]
                known[piece] = (known.get(stem) or self._word(stem)) + self.stops[piece[-1]]
            elif over := _LINE_END.fullmatch(piece):
                stem, stop, after = over.groups()
                ids = (known.get(stem) or self._word(stem)) + self.stops.get(stop, b"")
                known[piece] = ids + self.line_end + self._start(after)
            else:
                mixed.append(piece)
        for start in range(0, len(mixed), 4096):
            self._learn([" " + p for p in mixed[start : start + 4096]], known)

    def _start(self, piece: str) -> bytes:
        """Ids of a piece at the start of a text or line."""
        stem, stop = (piece[:-1], piece[-1]) if piece[-1:] in self.stops else (piece, "")
        if _LATIN.fullmatch(stem):
            return self._word(stem, "") + self.stops.get(stop, b"")
        return self.whole(piece) if piece else b""

    def _word(self, letters: str, before: str = " ") -> bytes:
        """Ids of letters, after a space, which are one pre-token whatever follows."""
        if letters.isascii():
            seen = (self.space if before else "") + letters
        else:
            seen = (before + letters).encode().decode("latin-1").translate(self.shown)
        return array("I", [token.id for token in self.tokenize(seen)]).tobytes()


def encoder(path: str, remembered: int | None = None) -> BulkEncoder:
    """The encoder of this worker process that remembers so many pieces."""
    return lasting(("encoder", path, remembered), lambda: BulkEncoder(path, remembered))
