"""Public tokenizers on executors, with a bounded cache of the pieces of text they split at."""

from __future__ import annotations

import gc
import os
import re
import string
import sys
from array import array

import numpy as np

#: Pieces a worker remembers; about 210 bytes each.
_CACHE = 2_000_000
#: Runs of letters a worker remembers besides, for pieces that differ in punctuation only.
_STEMS = 500_000
_LONGEST = 48
_LOADED: dict = {}
#: What str.split() splits at.
_WHITE = [c for c in map(chr, range(sys.maxunicode + 1)) if c.isspace()]
#: Byte-level vocabularies write printable bytes as themselves and the others, in order, from U+0100 on.
_ODD = [b for b in range(256) if not (0x21 <= b <= 0x7E or 0xA1 <= b <= 0xAC or 0xAE <= b)]
_SPACED = chr(256 + _ODD.index(0x20))
_BYTES = {b: 256 + i for i, b in enumerate(_ODD)}
#: Texts of every kind a vocabulary is tried with before its pieces are trusted.
_PROBES = ["It's a don't: (x), \"y\"! 12,3 4th", "Ünder STRASSE ß ª µ n\u0303 e\u0301", " lead  two\n\n tab\tend ", "$$$ a$$$ b'' c's re's", "日本 語, word. \U0001f600 a\u00a0b", "http://x.org/a?b=c&d=1#e", ""]


class Encoder:
    """Token ids of whole texts as little-endian unsigned 32-bit bytes.

    Both vocabularies split a text before any space that no white space follows, so the ids of a text are those of its
    space-separated pieces in turn. A text in which white space follows a space is encoded in one go instead.

    A vocabulary that drops white space and case needs neither: its texts are split at all white space, and lower-cased
    first where Latin-1 holds them (elsewhere, lower-casing before normalizing could give other letters).

    A text that may hold an added token (`<|endoftext|>`) is encoded in one go, as is every text of a vocabulary that
    does not give the pieces of the probe texts the ids of the whole.
    """

    def __init__(self, path: str, cache: int = _CACHE):
        from tokenizers import Tokenizer

        os.environ["TOKENIZERS_PARALLELISM"] = "false"
        self.tokenizer = Tokenizer.from_file(path)
        self.cache = cache
        #: What every text with an added token has in it, whatever its case.
        self.marks = {re.match(r"[!-/:-@\[-`{-~]*", t.content)[0] or t.content for t in self.tokenizer.get_added_tokens_decoder().values()}
        one = self.tokenizer.encode("a").ids
        self.folds = self.tokenizer.encode("A").ids == one and self.tokenizer.encode("a a").ids == one * 2
        #: White space to Python that the vocabulary takes for something else.
        self.odd = [c for c in _WHITE if self.tokenizer.encode(f"a{c}a").ids != one * 2]
        if self.folds:  # the ids that end a word
            self.last = np.zeros(1 + max(self.tokenizer.get_vocab().values()), bool)
            self.last[[i for t, i in self.tokenizer.get_vocab().items() if t.endswith("</w>")]] = True
        self.tails: dict[str, bytes] = {}
        self.stems: dict[str, bytes] = {}
        self.known: dict[str, bytes] = {}  # ids of a piece that follows a space
        self.whole = False
        self.whole = self.encode_all(_PROBES) != self.raw(_PROBES)

    def raw(self, texts: list[str]) -> list[bytes]:
        return [array("I", e.ids).tobytes() for e in self.tokenizer.encode_batch_fast(texts, add_special_tokens=False)]

    def _stems(self, new: list[str]) -> list[bytes]:
        """Ids of runs of Latin letters, each after a space."""
        if self.folds:  # many in one text; every run ends at an id that ends a word
            ids = np.frombuffer(b"".join(self.raw([" ".join(new[i : i + 256]) for i in range(0, len(new), 256)])), "<u4")
            ends = ((np.flatnonzero(self.last[ids]) + 1) * 4).tolist()
            raw = ids.tobytes()
            return [raw[i:j] for i, j in zip([0, *ends][:-1], ends, strict=True)]
        # straight to the model, past the normalizers and the splitter, which would leave them alone
        low = (x if x.isascii() else x.encode().decode("latin-1").translate(_BYTES) for x in new)
        return [array("I", [t.id for t in self.tokenizer.model.tokenize(_SPACED + x)]).tobytes() for x in low]

    def _pieces(self, new: list[str]) -> list[bytes]:
        """Ids of pieces after a space.

        Either vocabulary gives a run of Latin letters and the ASCII punctuation behind it their ids in turn.
        """
        parts, rest, tails, stems = [], [], self.tails, self.stems
        for x in new:
            stem = x.rstrip(string.punctuation)
            if stem.isalpha() and (stem.isascii() or max(stem) <= "\u00ff"):
                parts.append((x, stem, x[len(stem) :]))
            else:
                rest.append(x)
        if len(stems) > _STEMS:
            stems.clear()
        if len(tails) > 50_000:
            tails.clear()
        some = list({stem for _, stem, _ in parts}.difference(stems))
        ends = list({tail for _, _, tail in parts}.difference(tails))
        stems.update(zip(some, self._stems(some), strict=True))
        tails.update(zip(ends, self.raw(ends), strict=True))
        out = {x: stems[stem] + tails[tail] for x, stem, tail in parts}
        out.update(zip(rest, self.raw([" " + x for x in rest]), strict=True))
        for held, added in ((stems, some), (tails, ends)):
            for x in added:
                if len(x) > _LONGEST:
                    del held[x]
        return [out[x] for x in new]

    def encode_all(self, texts: list[str | None]) -> list[bytes]:
        gc.disable()  # many small objects, none in cycles
        try:
            return self._encode_all(texts)
        finally:
            gc.enable()

    def _encode_all(self, texts: list[str | None]) -> list[bytes]:
        at_once = [i for i, t in enumerate(texts) if t and (self.whole or any(m in t for m in self.marks))]
        if at_once:
            out, rest = [b""] * len(texts), sorted(set(range(len(texts))).difference(at_once))
            for some, ids in ((at_once, self.raw([texts[i] for i in at_once])), (rest, self._encode_pieces([texts[i] for i in rest]))):
                for i, x in zip(some, ids, strict=True):
                    out[i] = x
            return out
        return self._encode_pieces(texts)

    def _encode_pieces(self, texts: list[str | None]) -> list[bytes]:
        if self.folds:
            pieces, again = [_folded(t or "").split() for t in texts], []
            if self.odd:
                again = [i for i, t in enumerate(texts) if t and any(c in t for c in self.odd)]
            for i in again:
                pieces[i] = []
            firsts = [b""] * len(texts)
        else:
            pieces = [(t or "").split(" ") for t in texts]
            firsts = self.raw([p.pop(0) for p in pieces])
        known = self.known
        if len(known) > self.cache:
            known.clear()
        new = list(set().union(*pieces).difference(known))
        known.update(zip(new, self._pieces(new), strict=True))
        out = [f + b"".join(map(known.__getitem__, p)) for f, p in zip(firsts, pieces, strict=True)]
        if not self.folds:
            odd = {x for x in new if not x or x[0].isspace()}  # never kept, so always among the new
            again = [i for i, p in enumerate(pieces) if not odd.isdisjoint(p)] if odd else []
            for x in odd:
                del known[x]
        for i, ids in zip(again, self.raw([texts[i] for i in again]), strict=True):
            out[i] = ids
        for x in new:
            if len(x) > _LONGEST:
                known.pop(x, None)
        return out


def _folded(text: str) -> str:
    try:
        return text.lower() if text.isascii() or text.encode("latin-1") else text
    except UnicodeEncodeError:
        return text


def encoder(path: str, cache: int = _CACHE) -> Encoder:
    """One encoder for each file and worker process, so that later tasks find the pieces of earlier ones."""
    if path not in _LOADED:
        _LOADED[path] = Encoder(path, cache)
    return _LOADED[path]


def public_path(name: str) -> str:
    import public_tokenizers

    return public_tokenizers.path(name)
