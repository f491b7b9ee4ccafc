"""Cutting many texts at once into the pieces a byte-pair vocabulary is applied to.

A batch of texts becomes one array of code points, the pieces are found by comparing neighbours'
classes, and each piece gets a 64-bit hash from prefix sums. `PieceCache` turns pieces into token
ids: only pieces it hasn't met go through Python one by one. Two pieces of one worker's cache would
have to share a 64-bit hash to be confused; with `CACHE_PIECES` entries the odds are below 1e-8.
"""

from __future__ import annotations

import functools
import unicodedata
from collections.abc import Callable, Iterable, Iterator

import numpy as np
import regex
from tokenizers import Regex, normalizers

from gridloom.llm.parity_join import _ODD, PART, _tables

LETTER, NUMBER, SPACE, OTHER, EDGE = range(5)
#: Above every code point: stands between texts. The special token number k stands as END + 1 + k.
END = 0x110000
_SPECIALS = 16
#: Code points worked on at once; longer texts are cut where no piece can cross.
BLOCK = 1 << 19
#: Pieces one Python worker remembers before it starts anew: bounds its memory, not the results.
CACHE_PIECES = 150_000
_MASK = (1 << 64) - 1


@functools.cache
def _every() -> str:
    return "".join(map(chr, [*range(0xD800), *range(0xE000, END)]))


@functools.cache
def _classes(spaced: bool) -> np.ndarray:
    """The class of each code point. The tokenizers library knows letters by two Unicode versions:
    its byte-level splitter by a newer one, patterns named in a file by the one asked here."""
    every = _every()
    points = np.frombuffer(every.encode("utf-32-le"), np.uint32)
    table = np.full(END + 1 + _SPECIALS, OTHER, np.uint8)
    for kind, pattern in ((LETTER, r"\p{L}"), (NUMBER, r"\p{N}"), (SPACE, r"\s")):
        if spaced:
            for found in regex.finditer(pattern + "+", every):
                table[points[found.start():found.end()]] = kind
        else:
            marked = normalizers.Replace(Regex(pattern), "\0").normalize_str(every)
            table[points[np.frombuffer(marked.encode("utf-32-le"), np.uint32) == 0]] = kind
    table[0] = OTHER
    table[END:] = EDGE
    return table


@functools.cache
def _lower_rest() -> tuple[regex.Pattern, dict[int, str]]:
    """Letters whose lower case differs between the tokenizers library and Python."""
    one = [c for c in _every() if c not in "Σİ"]
    theirs, mine = normalizers.Lowercase().normalize_str("".join(one)), "".join(one).lower()
    if len(theirs) != len(mine) or len(mine) != len(one):
        raise RuntimeError("a letter has a longer lower case than this table is made for")
    odd = {ord(c): low for c, low, own in zip(one, theirs, mine, strict=True) if low != own}
    return regex.compile("[" + "".join(map(regex.escape, map(chr, odd))) + "]" if odd else "(?!)"), odd


@functools.cache
def _values() -> np.ndarray:
    return np.random.default_rng(20).integers(1, 1 << 63, END + 1 + _SPECIALS, np.uint64)


def _powers(n: int) -> tuple[np.ndarray, np.ndarray]:
    """The powers of an odd number and of its inverse, modulo 2^64: the table this subpackage shares, or a
    longer one for this call."""
    if n <= 2 * PART:
        powers, inverse = _tables()[2:]
        return powers[:n], inverse[:n]
    out = []
    for base in (_ODD, pow(_ODD, -1, 1 << 64)):
        powers = np.ones(1, np.uint64)
        while len(powers) < n:
            step = np.uint64(pow(base, len(powers), 1 << 64))
            powers = np.concatenate([powers, powers * step])
        out.append(powers[:n])
    return out[0], out[1]


def cut(text: str, most: int = BLOCK) -> list[str]:
    """Parts of about `most` code points. They end before white space that follows other text,
    where no piece continues."""
    if len(text) <= most:
        return [text]
    parts, at = [], 0
    for found in regex.finditer(r"\S(?=\s)", text):
        if found.end() - at >= most:
            parts.append(text[at:found.end()])
            at = found.end()
    return [*parts, text[at:]]


def lower_composed(text: str) -> str:
    """NFC and lower case, each letter by itself (no final sigma)."""
    if not text.isascii():
        text = unicodedata.normalize("NFC", text).replace("Σ", "σ")
        find, odd = _lower_rest()
        if find.search(text):
            return "".join(odd.get(ord(c)) or c.lower() for c in text)
    return text.lower()


class Splitter:
    """Finds pieces as one of two public patterns does.

    spaced: a leading blank belongs to its word and white space is kept (byte-level vocabularies);
    else white space is dropped and every digit stands alone (word-end vocabularies).
    specials: strings that are always one token, found before anything else.
    """

    def __init__(self, spaced: bool, specials: list[str]):
        self.spaced, self.specials = spaced, specials
        if len(specials) >= _SPECIALS:
            raise ValueError(f"at most {_SPECIALS - 1} special tokens")
        self._find = regex.compile("(" + "|".join(map(regex.escape, specials)) + ")") if specials else None
        self._marks = {s: np.uint32(END + 1 + k).tobytes() for k, s in enumerate(specials)}

    def codes(self, texts: Iterable[str]) -> np.ndarray:
        """The code points of all texts, each text closed by END."""
        out = []
        for text in texts:
            parts = self._find.split(text) if self._find and any(s in text for s in self.specials) else [text]
            for part in parts:
                mark = self._marks.get(part)
                out.append(mark or (part if self.spaced else lower_composed(part)).encode("utf-32-le", "replace"))
            out.append(np.uint32(END).tobytes())
        return np.frombuffer(b"".join(out), np.uint32)

    def pieces(self, codes: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
        """Start and end of every piece; each END and special token is a piece of its own."""
        classes = _classes(self.spaced)
        kind = classes[codes]
        start = np.empty(len(codes) + 1, bool)
        start[0] = start[-1] = True
        np.not_equal(kind[1:], kind[:-1], out=start[1:-1])
        start[:-1] |= kind == EDGE
        padded = np.concatenate([codes, np.full(3, END, np.uint32)])
        quote = np.flatnonzero((codes == 39) & start[:-1])
        if self.spaced:
            quote = quote[(quote == 0) | (codes[quote - 1] != 32)]
            last = np.flatnonzero((kind[:-1] == SPACE) & (kind[1:] != SPACE) & (kind[1:] != EDGE))
            start[last] = True
            start[last[codes[last] == 32] + 1] = False
        else:
            start[:-1] |= kind == NUMBER
        if len(quote):
            a, b = padded[quote + 1], padded[quote + 2]
            short = np.isin(a, [ord(c) for c in "stmd"])
            long = np.zeros(len(quote), bool)
            for x, y in ("re", "ve", "ll"):
                long |= (a == ord(x)) & (b == ord(y))
            for at, size in ((quote[short], 2), (quote[long], 3)):
                start[at + 1] = False
                rest = at + size
                start[rest[classes[padded[rest]] == LETTER]] = True
        edges = np.flatnonzero(start)
        begin, end = edges[:-1], edges[1:]
        if not self.spaced:
            keep = kind[begin] != SPACE
            begin, end = begin[keep], end[keep]
        return begin, end


def hashes(codes: np.ndarray, begin: np.ndarray, end: np.ndarray) -> np.ndarray:
    size = max(BLOCK * 2, 1 << int(len(codes)).bit_length())
    powers, inverse = _powers(size)
    sums = np.zeros(len(codes) + 1, np.uint64)
    np.cumsum(_values()[codes] * powers[: len(codes)], out=sums[1:])
    h = (sums[end] - sums[begin]) * inverse[begin]
    h ^= h >> np.uint64(29)
    h *= np.uint64(0xBF58476D1CE4E5B9)
    return h ^ (h >> np.uint64(32))


class PieceCache:
    """Token ids of pieces. A direct-mapped table answers most; a dict the rest; `encode` new ones."""

    _BITS = 17

    def __init__(self, splitter: Splitter, special_ids: list[int], encode: Callable[[str], list[int]]):
        self.splitter, self.special_ids, self.encode = splitter, special_ids, encode
        self._reset()

    def _reset(self) -> None:
        self._slot: dict[int, int] = {}
        self._keys = np.zeros(1 << self._BITS, np.uint64)
        self._vals = np.zeros(1 << self._BITS, np.int64)
        self._flat = np.zeros(0, np.uint32)
        self._at = np.zeros(1, np.int64)

    def _slots(self, h: np.ndarray, codes: np.ndarray, begin: np.ndarray, end: np.ndarray) -> np.ndarray:
        place = (h >> np.uint64(64 - self._BITS)).astype(np.int64)
        slots = self._vals[place]
        missing = np.flatnonzero(self._keys[place] != h)
        if len(missing):
            new, first, back = np.unique(h[missing], return_index=True, return_inverse=True)
            got = np.empty(len(new), np.int64)
            known, flat, sizes = self._slot.get, [], []
            for k, (x, at) in enumerate(zip(new.tolist(), missing[first].tolist(), strict=True)):
                slot = known(x)
                if slot is None:
                    code = int(codes[begin[at]])
                    if code > END:
                        ids = [self.special_ids[code - END - 1]]
                    elif code == END:
                        ids = []
                    else:
                        ids = self.encode(codes[begin[at]:end[at]].tobytes().decode("utf-32-le"))
                    slot = self._slot[x] = len(self._at) - 1 + len(sizes)
                    flat += ids
                    sizes.append(len(ids))
                got[k] = slot
            self._flat = np.concatenate([self._flat, np.array(flat, np.uint32)])
            self._at = np.concatenate([self._at, self._at[-1] + np.cumsum(sizes, dtype=np.int64)])
            slots[missing] = got[back]
            at = (new >> np.uint64(64 - self._BITS)).astype(np.int64)
            self._keys[at], self._vals[at] = new, got
        return slots

    def _block(self, texts: list[str]) -> Iterator[np.ndarray]:
        codes = self.splitter.codes(texts)
        begin, end = self.splitter.pieces(codes)
        if len(self._slot) > CACHE_PIECES:
            self._reset()
        slots = self._slots(hashes(codes, begin, end), codes, begin, end)
        first, size = self._at[slots], self._at[slots + 1] - self._at[slots]
        total = np.cumsum(size)
        ids = self._flat[np.repeat(first - (total - size), size) + np.arange(total[-1] if len(total) else 0)]
        bounds = total[codes[begin] == END]
        yield from np.split(ids, bounds[:-1])

    def ids(self, texts: Iterable[str | None]) -> Iterator[np.ndarray]:
        """The ids of each text, in order; no text reads as an empty one. Takes texts in blocks of
        about BLOCK code points."""
        block, chars, parts = [], 0, []

        def run() -> Iterator[np.ndarray]:
            found = self._block(block)
            for n in parts:
                own = [next(found) for _ in range(n)]
                yield own[0] if n == 1 else np.concatenate(own)

        for text in texts:
            text = text or ""
            if len(text) > BLOCK:
                # a long text by itself, part by part
                if block:
                    yield from run()
                    block, chars, parts = [], 0, []
                yield np.concatenate([x for part in cut(text) for x in self._block([part])])
                continue
            block.append(text)
            parts.append(1)
            chars += len(text)
            if chars >= BLOCK:
                yield from run()
                block, chars, parts = [], 0, []
        if block:
            yield from run()
