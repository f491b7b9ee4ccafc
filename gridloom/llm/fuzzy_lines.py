"""Line deduplication by SimHash: of each group of alike lines over all documents one line stays.

Lines are compared in lower case with single blanks; digits and marks count. Equal lines are put together
first. For the rest a line's SimHash is laid out in blocks of 64 bits, one for every few features:
a feature's hash names the block it votes in, so an edit of one word leaves all blocks but two as they are,
and by the pigeonhole principle fewer edits than half the blocks leave one equal. Every block, with its
number, is a join key. Features are words of letters and digits, digits alike; of words above LONG_WORD
bytes and of lines with few words, windows of WINDOW characters in their place. Lines whose number of
features is near a change of the layout have the keys of both. Candidates are verified by edit similarity of the
compared lines (0.9 or more). Links form groups; the line of a group with the smallest document id and
place stays, all others go.

Lines with fewer than `min_chars` letters and digits (blank lines too) are neither compared nor removed. A
null text stays null and an empty one empty. Rows with a null id come last in the order. Rows equal in id
and text lose the same lines; a null or repeated id is no error. Other columns stay as they are, but for
one named like `into`, which is replaced. An empty table gives no rows. Distinct lines are known by 64-bit
hashes. Work on a line grows with its length, that of verifying a pair with the square of it, 64 steps at
a time; memory grows with the longer of the two.
"""

from __future__ import annotations

import bisect
import collections
import functools
import itertools
from collections.abc import Iterator

import numpy as np
import pandas as pd
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F
from pyspark.sql import types as T

from gridloom.lineage import materialize
from gridloom.llm.graph import SENT_IDS, by_ids, components, link
from gridloom.llm.parity_join import PART, _mix, _tables

#: Features to a block of the SimHash, of words and of windows, and the fewest a block needs to be a key.
TO_BLOCK, FEWEST = (8, 4), (4, 4)
#: Lines with fewer words are known by windows of characters.
FEW_WORDS = 20
LONG_WORD, WINDOW = 24, 3
#: How far apart the numbers of features of alike lines may be, for the choice of the layout.
SLACK = 0.07
#: Bits of 64 in which the SimHashes of whole lines may differ (unlike lines: 32 on the average).
APART = 18
#: Shorter texts are compared as a whole at once.
LONG_TEXT = 160
#: blocks of 64 characters compared side by side, and pairs to a block of their text that make it cheaper than one by one
SIDE_BY_SIDE, ENOUGH = 16_384, 12
#: Characters after which pairs too far apart are looked for, and places (8 bytes each) of the letters of pairs side by side
LOOK, MARKS = 32, 1 << 22
_ROW = "_gl_row"


@functools.cache
def _kinds() -> tuple[np.ndarray, np.ndarray, np.ndarray]:
    """Of each byte: whether it is white space within a line, whether it belongs to a word of letters and
    digits, and the byte it is read as in features (digits alike, all else a blank)."""
    space, spoken = np.zeros(256, bool), np.zeros(256, bool)
    space[[9, 10, 11, 12, 13, 32]] = True
    spoken[[*range(48, 58), *range(97, 123), *range(128, 256)]] = True
    read = np.where(spoken, np.arange(256), 32).astype(np.uint8)
    read[48:58] = 48
    return space, spoken, read


@functools.cache
def _lanes() -> np.ndarray:
    """For every byte, its eight bits as eight counters of eight bits each."""
    bits = np.unpackbits(np.arange(256, dtype=np.uint8)[:, None], axis=1)
    return np.ascontiguousarray(bits).view(np.uint64)[:, 0]


def _spans(inside: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    edge = np.diff(np.concatenate([[0], inside.astype(np.int8), [0]]))
    return np.flatnonzero(edge == 1), np.flatnonzero(edge == -1)


def _sums(codes: np.ndarray) -> np.ndarray:
    values, _, powers, _ = _tables()
    out = np.zeros(len(codes) + 1, np.uint64)
    np.cumsum(values[codes] * powers[:len(codes)], out=out[1:])
    return out


def _windows(first: np.ndarray, begin: np.ndarray, end: np.ndarray) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
    """Starts and ends of the windows inside some stretches of bytes, and their stretch. `first`: where
    characters start, and the end."""
    low, high = np.searchsorted(first, begin), np.searchsorted(first, end)
    size = np.maximum(high - low - WINDOW + 1, 0)
    of = np.repeat(np.arange(len(begin)), size)
    at = np.arange(size.sum()) - np.repeat(np.cumsum(size) - size, size) + np.repeat(low, size)
    return first[at], first[at + WINDOW], of


class _Scan:
    """Word hashes and, if asked, features of the lines of a piece of text, of at most 2 PART bytes."""

    def __init__(self, data: bytes, keys: bool):
        space, spoken, read = _kinds()
        inverse = _tables()[3]
        codes = np.frombuffer(data, np.uint8)
        first = (codes & 0xC0) != 0x80
        ends = np.append(np.flatnonzero(codes == 10), len(codes))
        starts = np.append(0, ends[:-1] + 1)
        self.lines = len(starts)
        letters = np.concatenate([[0], np.cumsum(spoken[codes] & first)])
        self.letters = letters[ends] - letters[starts]

        begin, end = _spans(~space[codes])
        sums = _sums(codes)
        self.words = _mix((sums[end] - sums[begin]) * inverse[begin])
        self.word_line = np.searchsorted(ends, begin)
        chars = np.concatenate([[0], np.cumsum(first)])
        self.word_chars = chars[end] - chars[begin]
        if not keys:
            return

        codes = read[codes]
        begin, end = _spans(codes != 32)
        sums = _sums(codes)
        line = np.searchsorted(ends, begin)
        self.spoken = np.bincount(line, minlength=self.lines)
        long = end - begin > LONG_WORD
        places = np.append(np.flatnonzero(first), len(codes))
        at, to, of = _windows(places, begin[long], end[long])
        self.features = np.concatenate([
            _mix((sums[end[~long]] - sums[begin[~long]]) * inverse[begin[~long]]),
            _mix((sums[to] - sums[at]) * inverse[at] + np.uint64(1))])
        self.feature_line = np.concatenate([line[~long], line[long][of]])
        few = np.flatnonzero(self.spoken < FEW_WORDS * (1 + SLACK))
        at, to, of = _windows(places, starts[few], ends[few])
        self.grams = _mix((sums[to] - sums[at]) * inverse[at] + np.uint64(2))
        self.gram_line = few[of]


def _layouts(sizes: np.ndarray, to_block: int) -> list[np.ndarray]:
    """The number of blocks for each number of features: a power of two, and its neighbour's near a change."""
    def power(n: np.ndarray) -> np.ndarray:
        return 1 << np.ceil(np.log2(np.maximum(n / to_block, 4))).astype(np.int64)

    low, high = power(sizes * (1 - SLACK)), power(sizes * (1 + SLACK))
    return [low, np.where(high > low, high, 0)]


def _votes(hashes: np.ndarray, start: np.ndarray, size: np.ndarray) -> np.ndarray:
    """How many of the hashes of each stretch have each of the 64 bits."""
    # counters of eight bits hold up to 255 votes, so longer stretches are counted in parts
    parts = -(-size // 255)
    begin = np.repeat(start, parts) + 255 * (np.arange(parts.sum()) - np.repeat(np.cumsum(parts) - parts, parts))
    votes = np.add.reduceat(_lanes()[hashes.view(np.uint8).reshape(-1, 8)], begin, axis=0).view(np.uint8).astype(np.int32)
    return np.add.reduceat(votes, np.cumsum(parts) - parts, axis=0) if len(begin) > len(start) else votes


def _blocks(features: np.ndarray, line: np.ndarray, lines: int, kind: int) -> tuple[np.ndarray, np.ndarray]:
    """The keys of all lines' blocks, and the line of each."""
    keys, of = [], []
    for blocks in _layouts(np.bincount(line, minlength=lines), TO_BLOCK[kind]):
        used = blocks[line] > 0
        own, at, count = features[used], line[used], blocks[line[used]]
        if not len(own):
            continue
        block = (own >> np.uint64(24)).astype(np.int64) & (count - 1)
        first_block = np.cumsum(blocks) - blocks
        place = first_block[at] + block
        # a feature votes once in its block, however often the line has it
        if int(blocks.sum()) < 1 << 22:
            mark = place.astype(np.uint64) << np.uint64(42) | own >> np.uint64(22)
            order = np.argsort(mark)
            fresh = np.diff(mark[order], prepend=~mark[order[:1]]) != 0
        else:
            order = np.lexsort((own, place))
            fresh = np.append(True, (np.diff(own[order]) != 0) | (np.diff(place[order]) != 0))
        order = order[fresh]
        place, own = place[order], own[order]
        start = np.flatnonzero(np.diff(place, prepend=-1))
        size = np.diff(np.append(start, len(place)))
        bits = 2 * _votes(own, start, size) > size[:, None]
        sim = np.packbits(bits, axis=1).view(np.uint64)[:, 0]
        named = at[order][start], block[order][start]
        number = (named[1] + (blocks[named[0]] << 32) + kind).astype(np.uint64)
        enough = size >= FEWEST[kind]
        keys.append(_mix(sim * np.uint64(0x9E3779B97F4A7C15) + _mix(number))[enough])
        of.append(named[0][enough])
    if not keys:
        return np.zeros(0, np.uint64), np.zeros(0, np.int64)
    return np.concatenate(keys), np.concatenate(of)


def _pieces(data: bytes) -> list[tuple[bytes, bool]]:
    """Whole lines, about PART bytes at a time, and whether the last one goes on in the next piece."""
    out, at = [], 0
    while len(data) - at > 2 * PART:
        cut = data.rfind(b"\n", at, at + 2 * PART)
        if cut >= 0:
            out.append((data[at:cut], False))
            at = cut + 1
            continue
        # a line longer than two parts: cut at a blank, or within a word if there is none
        cut = data.rfind(b" ", at, at + PART)
        cut = cut if cut > at else at + PART
        out.append((data[at:cut], True))
        at = cut
    return [*out, (data[at:], False)]


def _whole(features: np.ndarray, line: np.ndarray, lines: int) -> np.ndarray:
    """The SimHash of each line over all its features."""
    out = np.zeros(lines, np.uint64)
    order = np.argsort(line, kind="stable")
    if len(order):
        start = np.flatnonzero(np.diff(line[order], prepend=-1))
        size = np.diff(np.append(start, len(order)))
        votes = _votes(features[order], start, size)
        out[line[order][start]] = np.packbits(2 * votes > size[:, None], axis=1).view(np.uint64)[:, 0]
    return out


def facts(data: bytes, keys: bool = True) -> dict[str, np.ndarray]:
    """Of each line of a text in lower case: hash, characters, letters and, if asked, its SimHash, keys and
    how many they are."""
    scans, first, at = [], [], 0
    for piece, goes_on in _pieces(data):
        scan = _Scan(piece, keys)
        scans.append(scan)
        first.append(at)
        at += scan.lines - goes_on
    n = at

    def both(name: str, line: str) -> tuple[np.ndarray, np.ndarray]:
        found = [(getattr(s, name), getattr(s, line) + f) for s, f in zip(scans, first, strict=True)]
        return np.concatenate([x[0] for x in found]), np.concatenate([x[1] for x in found])

    def added(name: str) -> np.ndarray:
        out = np.zeros(n, np.int64)
        for s, f in zip(scans, first, strict=True):
            out[f:f + s.lines] += getattr(s, name)
        return out

    words, line = both("words", "word_line")
    size = np.bincount(line, minlength=n)
    start = np.cumsum(size) - size
    place = (np.arange(len(words)) - start[line] + 1).astype(np.uint64)
    sums = np.concatenate([np.zeros(1, np.uint64), np.cumsum(_mix(words + place))])
    whole = _mix(sums[start + size] - sums[start] + size.astype(np.uint64))
    chars = np.bincount(line, both("word_chars", "word_line")[0], n).astype(np.int64) + np.maximum(size - 1, 0)

    out = {"line": whole.view(np.int64), "chars": chars, "letters": added("letters")}
    if not keys:
        return out
    spoken, features, grams = added("spoken"), both("features", "feature_line"), both("grams", "gram_line")
    use = spoken[features[1]] >= FEW_WORDS * (1 - SLACK)
    found, of = _blocks(features[0][use], features[1][use], n, 0)
    use = spoken[grams[1]] < FEW_WORDS * (1 + SLACK)
    more, of_more = _blocks(grams[0][use], grams[1][use], n, 1)
    found, of = np.concatenate([found, more]), np.concatenate([of, of_more])
    order = np.argsort(of, kind="stable")
    return out | {"sim": _whole(*features, n).view(np.int64), "keys": found[order].view(np.int64),
                  "n_keys": np.bincount(of, minlength=n)}


def _keyed(docs: DataFrame, text: str, id_col: str) -> DataFrame:
    """The rows with _gl_row: the id (null: the largest number) and a hash of the text."""
    key = F.struct(F.coalesce(F.col(id_col).cast("long"), F.lit((1 << 63) - 1)).alias("id"),
                   F.xxhash64(F.col(text)).alias("h"))
    return docs.withColumn(_ROW, key)


def _low(text: str | None) -> bytes:
    return (text or "").lower().encode("utf-8", "replace")


def _lines(docs: DataFrame, min_chars: int) -> DataFrame:
    """id, h, pos, line (hash), sim, chars, keys per compared line of id, h, text."""
    def rows(ids: list[int], hs: list[int], texts: list[bytes]) -> pa.RecordBatch:
        sizes = np.array([t.count(b"\n") + 1 for t in texts])
        f = facts(b"\n".join(texts))
        doc = np.repeat(np.arange(len(texts)), sizes)
        pos = np.arange(sizes.sum()) - np.repeat(np.cumsum(sizes) - sizes, sizes)
        kept = f["letters"] >= min_chars
        keys = f["keys"][np.repeat(kept, f["n_keys"])]
        bounds = np.concatenate([[0], np.cumsum(f["n_keys"][kept])]).astype(np.int32)
        columns = [pa.array(np.array(ids, np.int64)[doc[kept]]), pa.array(np.array(hs, np.int64)[doc[kept]]),
                   pa.array(pos[kept].astype(np.int32)), pa.array(f["line"][kept]), pa.array(f["sim"][kept]), pa.array(f["chars"][kept].astype(np.int32)),
                   pa.ListArray.from_arrays(bounds, keys)]
        return pa.RecordBatch.from_arrays(columns, ["id", "h", "pos", "line", "sim", "chars", "keys"])

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            ids, hs, texts, size = [], [], [], 0
            for doc, h, text in zip(*(batch.column(k) for k in range(3)), strict=True):
                ids.append(doc.as_py())
                hs.append(h.as_py())
                texts.append(_low(text.as_py()))
                size += len(texts[-1])
                if size > PART // 4:  # enough texts for one go
                    yield rows(ids, hs, texts)
                    ids, hs, texts, size = [], [], [], 0
            if ids:
                yield rows(ids, hs, texts)

    return docs.mapInArrow(run, "id long, h long, pos int, line long, sim long, chars int, keys array<long>")


@F.pandas_udf(T.StringType())
def _compared(line: pd.Series) -> pd.Series:
    return line.map(lambda x: b" ".join(_low(x).split()).decode())


def _texts(bare: DataFrame, places: DataFrame) -> DataFrame:
    """line (hash) and its text as it is compared, for places (line, id, h, pos) in id, h, text."""
    few = places.count() <= SENT_IDS
    spots = places.groupBy("id", "h").agg(F.collect_list(F.struct("line", "pos")).alias("spots"))
    split = bare.join(F.broadcast(spots) if few else spots, ["id", "h"]).select("spots", F.split("text", "\n").alias("_lines"))
    found = split.select(F.inline(F.transform("spots", lambda s: F.struct(
        s["line"].alias("line"), F.get("_lines", s["pos"]).alias("text")))))
    # repeated rows have the same places
    return found.groupBy("line").agg(F.min("text").alias("text")).select("line", _compared("text").alias("text"))


def edit_distance(a: str, b: str, most: int) -> int:
    """Edits between two texts, or a number over `most`. Bit-parallel after common ends are cut off."""
    at = 0
    short = min(len(a), len(b))
    while at < short and a[at] == b[at]:
        at += 1
    a, b = a[at:], b[at:]
    end = 0
    short = min(len(a), len(b))
    while end < short and a[-1 - end] == b[-1 - end]:
        end += 1
    a, b = a[:len(a) - end], b[:len(b) - end]
    if not a or not b or abs(len(a) - len(b)) > most:
        return len(a) + len(b)
    where: dict[str, int] = {}
    for k, c in enumerate(a):
        where[c] = where.get(c, 0) | 1 << k
    every, top = (1 << len(a)) - 1, 1 << len(a) - 1
    up, down, score = every, 0, len(a)
    for k, c in enumerate(b):
        match = where.get(c, 0)
        zero = ((match & up) + up ^ up) | match | down
        plus, minus = down | ~(zero | up) & every, up & zero
        score += bool(plus & top) - bool(minus & top)
        if score - (len(b) - k - 1) > most:
            return most + 1
        plus = plus << 1 | 1
        up, down = (minus << 1 | ~(zero | plus)) & every, plus & zero & every
    return score


def _places(text: str) -> dict[tuple[str, ...], int]:
    """Where three words in a row begin that a text has once; -1 for those it has more often."""
    words = text.split(" ")
    begins = itertools.accumulate((len(w) + 1 for w in words), initial=0)
    out: dict[tuple[str, ...], int] = {}
    for three, at in zip(zip(words, words[1:], words[2:], strict=False), begins, strict=False):
        out[three] = -1 if three in out else at
    return out


def edits_at_most(a: str, b: str, most: int) -> bool:
    """Whether `most` edits or fewer lie between two texts.

    Long texts are first cut where both have the same three words in the same order: the edits of the parts
    are enough. Texts whose windows of three characters differ by more than six for each edit allowed are too
    far apart. Only what is left is compared as a whole.
    """
    if max(len(a), len(b)) < LONG_TEXT:
        return edit_distance(a, b, most) <= most
    if abs(len(a) - len(b)) > most:
        return False
    there = _places(b)
    both = [(at, there[three]) for three, at in _places(a).items() if at >= 0 and there.get(three, -1) >= 0]
    ends, last, before = [], [], []
    for k, (_, at) in enumerate(both):
        rank = bisect.bisect_left(ends, at)
        ends[rank:rank + 1], last[rank:rank + 1] = [at], [k]
        before.append(last[rank - 1] if rank else -1)
    chain, k = [(len(a), len(b))], last[-1] if last else -1
    while k >= 0:
        chain.append(both[k])
        k = before[k]
    edits, x, y = 0, 0, 0
    if len(chain) > 1:
        for p, q in reversed(chain):
            if a[x:p] != b[y:q]:
                edits += edit_distance(a[x:p], b[y:q], most - edits)
            if edits > most:
                break
            x, y = p, q
        else:
            return True
    windows = collections.Counter(map("".join, zip(a, a[1:], a[2:], strict=False)))
    windows.subtract(map("".join, zip(b, b[1:], b[2:], strict=False)))
    return sum(map(abs, windows.values())) <= 6 * most and edit_distance(a, b, most) <= most


def _myers(a: list[np.ndarray], b: list[np.ndarray], most: np.ndarray) -> np.ndarray:
    """Whether most[i] edits or fewer lie between a[i] and b[i] for all i, of pairs of texts as codes below 2^16,
    none empty, whose lengths differ by most[i] at most; the first ones fill the same number of blocks of 64.

    Bit-parallel (Myers, JACM 46(3), 1999; Hyyro's blocks of 64 rows), all pairs side by side: one step of
    the loops is one character of every second text against 64 characters of every first one. Only blocks
    that hold a row at most `most` from the diagonal are worked on, as fewer edits cannot lead elsewhere. Every
    LOOK columns, pairs that have used up their edits wherever their way may lead are given up.
    """
    count, words, size = len(a), -(-max(map(len, a)) // 64), 1 << 16
    joined = np.concatenate(a)
    number = np.bincount(joined, minlength=size) > 0
    letters = int(number.sum())
    if count > 1 and (letters + 1) * words * count > MARKS:
        half = count // 2
        return np.concatenate([_myers(a[:half], b[:half], most[:half]), _myers(a[half:], b[half:], most[half:])])
    number = np.where(number, np.cumsum(number) - 1, letters)
    # texts that end first stand last, so the ones still running are a slice
    pair = np.argsort([-len(x) for x in b], kind="stable")
    b, most = [b[i] for i in pair], most[pair]
    place = np.empty(count, np.int64)
    place[pair] = np.arange(count)
    rows, columns = np.array([len(x) for x in a]), np.array([len(x) for x in b])
    # per letter (the last row: one that no first text has), block and pair: where the letter stands
    stands = np.zeros((letters + 1) * words * count, np.uint64)
    at = np.arange(len(joined)) - np.repeat(np.cumsum(rows) - rows, rows)
    np.add.at(stands, (number[joined] * words + (at >> 6)) * count + np.repeat(place, rows), np.uint64(1) << (at & 63).astype(np.uint64))
    stands, rows = stands.reshape(letters + 1, words, count), rows[pair]
    seconds = np.full((columns[0], count), letters, np.int64)
    for k, x in enumerate(b):
        seconds[:len(x), k] = number[x]

    one, top = np.uint64(1), np.uint64(63)
    rest = rows - 64 * (words - 1)
    bit, inside = (rest - 1).astype(np.uint64), ~np.uint64(0) >> (64 - rest).astype(np.uint64)
    up, down = np.full((words, count), ~np.uint64(0)), np.zeros((words, count), np.uint64)
    out, width, low, high = np.zeros(count, bool), int(most.max()), 0, -1
    # the edits up to the last row of the lowest block worked on
    score, every, j = np.zeros(count, np.int64), np.arange(count), 0
    while len(pair) and j < columns[0]:
        n = int(np.searchsorted(-columns, -j, side="left"))
        low = max(0, (j - width) >> 6)
        while high < min(words - 1, (j + width) >> 6):
            high += 1
            score += 64 if high < words - 1 else rest
        plus_in, minus_in = np.full(n, one), np.zeros(n, np.uint64)
        match = stands[seconds[j, :n], low:high + 1, every[:n]]
        for w in range(low, high + 1):
            p, m, same = up[w, :n], down[w, :n], match[:, w - low]
            keep = same | m
            same = same | minus_in
            zero = ((same & p) + p ^ p) | same
            plus, minus = m | ~(zero | p), p & zero
            if w == high:
                end = bit[:n] if w == words - 1 else top
                score[:n] += (plus >> end & one).astype(np.int64) - (minus >> end & one).astype(np.int64)
            plus_out, minus_out = plus >> top, minus >> top
            plus, minus = plus << one | plus_in, minus << one | minus_in
            up[w, :n], down[w, :n] = minus | ~(keep | plus), plus & keep
            plus_in, minus_in = plus_out, minus_out
        j += 1
        if j % LOOK or j == columns[0]:
            continue
        # rows differ by one at most from the next, so a block holds no fewer edits than its ends leave room for
        below, least, way = score[:n], np.full(n, size), rows[:n] - columns[:n] + j
        for w in range(high, low - 1, -1):
            p, m, ends = up[w, :n], down[w, :n], 64 * (w + 1)
            if w == words - 1:
                p, m, ends = p & inside[:n], m & inside[:n], rows[:n]
            above = below - np.bitwise_count(p).astype(np.int64) + np.bitwise_count(m)
            aside = np.maximum(0, np.maximum(64 * w - way, way - ends))
            least = np.minimum(least, (above + below - (ends - 64 * w) + 1) // 2 + aside)
            below = above
        left = np.flatnonzero(least <= most[:n])
        if len(left) <= 0.7 * n:
            out[pair[n:]] = score[n:] <= most[n:]
            pair, most, rows, columns, rest, bit, inside, score = (
                x[left] for x in (pair, most, rows, columns, rest, bit, inside, score))
            up, down, stands, seconds, every = up[:, left], down[:, left], stands[:, :, left], seconds[:, left], every[:len(left)]
            if not len(left):
                break
    out[pair] = score <= most
    return out


def _codes(text: str) -> np.ndarray:
    return np.frombuffer(text.encode("utf-32-le", "surrogatepass"), np.uint32)


def all_at_most(a: list[str], b: list[str], most: list[int]) -> list[bool]:
    """`edits_at_most` of many pairs. Those of like length are compared side by side."""
    out, groups = [False] * len(a), collections.defaultdict(list)
    for i, (x, y) in enumerate(zip(a, b, strict=True)):
        if x == y or abs(len(x) - len(y)) > most[i]:
            out[i] = x == y
            continue
        x, y = _codes(x), _codes(y)
        short = min(len(x), len(y))
        differ = np.flatnonzero(x[:short] != y[:short])
        begin = differ[0] if len(differ) else short
        differ = np.flatnonzero(x[len(x) - short + begin:][::-1] != y[len(y) - short + begin:][::-1])
        end = differ[0] if len(differ) else short - begin
        x, y = x[begin:len(x) - end], y[begin:len(y) - end]
        if not len(x) or not len(y):
            out[i] = True  # only the lengths differ, and not by more than `most`
        elif max(x.max(), y.max()) < 1 << 16:
            blocks = -(-len(x) // 64)
            step = 1 << max(0, blocks.bit_length() - 2)
            groups[-(-blocks // step) * step].append((i, x, y))
        else:
            out[i] = edits_at_most(a[i], b[i], most[i])
    for words, pairs in groups.items():
        pairs.sort(key=lambda pair: (most[pair[0]], len(pair[2])))
        size = max(1, SIDE_BY_SIDE // words)
        for k in range(0, len(pairs), size):
            some = pairs[k:k + size]
            if len(some) < ENOUGH * words:
                for i, *_ in some:
                    out[i] = edits_at_most(a[i], b[i], most[i])
                continue
            # the same letters at both ends change no edits, and the first texts of a group fill as many blocks
            more = [np.full(max(0, 64 * words - 63 - len(x)), 32, x.dtype) for _, x, _ in some]
            decided = _myers([np.concatenate([x, m]) for (_, x, _), m in zip(some, more, strict=True)],
                             [np.concatenate([y, m]) for (*_, y), m in zip(some, more, strict=True)],
                             np.array([most[i] for i, *_ in some]))
            for (i, *_), near in zip(some, decided.tolist(), strict=True):
                out[i] = near
    return out


def _alike(similarity: float):
    @F.pandas_udf(T.BooleanType())
    def alike(a: pd.Series, b: pd.Series) -> pd.Series:
        most = [int((1 - similarity) * max(len(x), len(y)) + 1e-9) for x, y in zip(a, b, strict=True)]
        return pd.Series(all_at_most(list(a), list(b), most), dtype=bool)

    return alike


def removals(docs: DataFrame, similarity: float = 0.9, min_chars: int = 8, id_col: str = "doc_id",
             text: str = "text") -> DataFrame:
    """_gl_row and _gl_gone, the places (from 0) of its lines that go, for rows that lose lines."""
    bare = _keyed(docs, text, id_col).select(f"{_ROW}.id", f"{_ROW}.h", F.col(text).alias("text"))
    lines = materialize(_lines(bare, min_chars))
    place = F.struct("id", "h", "pos")
    # copies of a line have the same keys and are put together before the keys are dealt
    distinct = materialize(lines.groupBy("line").agg(
        F.min(place).alias("first"), F.count("*").alias("n"), F.min("sim").alias("sim"), F.min("chars").alias("chars"),
        F.any_value("keys").alias("keys")))
    about = distinct.select(F.col("line").alias("id"), "sim", "chars")
    keyed = distinct.select(F.explode("keys").alias("key"), F.col("line").alias("id"))

    def close(a, b):
        low, high = F.least(a("chars"), b("chars")), F.greatest(a("chars"), b("chars"))
        return (low >= high * similarity) & (F.bit_count(a("sim").bitwiseXOR(b("sim"))) <= APART)

    def verify(pairs: DataFrame) -> DataFrame:
        met = materialize(pairs.select(F.col("a").alias("line")).union(pairs.select("b")).distinct())
        places = materialize(by_ids(distinct.select("line", "first.*"), met, "left_semi"))
        found = materialize(_texts(bare, places))
        a = found.select(F.col("line").alias("a"), F.col("text").alias("a_text"))
        b = found.select(F.col("line").alias("b"), F.col("text").alias("b_text"))
        return pairs.join(a, "a").join(b, "b").where(_alike(similarity)("a_text", "b_text")).select("a", "b")

    groups = components(link(keyed, about, close, verify)).withColumnRenamed("id", "_line")
    named = distinct.join(groups, F.col("line") == F.col("_line"), "left").where("n > 1 OR component IS NOT NULL").select(
        "line", "first", F.coalesce("component", "line").alias("component"))
    kept = named.groupBy("component").agg(F.min("first").alias("stays"))
    gone = lines.join(named.join(kept, "component").select("line", "stays"), "line").where(place != F.col("stays"))
    # a repeated row has the same places again
    return gone.groupBy("id", "h").agg(F.array_sort(F.collect_set("pos")).alias("_gl_gone")).select(
        F.struct("id", "h").alias(_ROW), "_gl_gone")


def dedup_lines(docs: DataFrame, similarity: float = 0.9, min_chars: int = 8, id_col: str = "doc_id",
                text: str = "text", into: str = "removed_lines") -> DataFrame:
    """The rows with the text that stays and, in `into`, the places of the lines that went."""
    gone = removals(docs, similarity, min_chars, id_col, text)
    rows = _keyed(docs, text, id_col).join(gone, _ROW, "left")
    lost = F.coalesce("_gl_gone", F.array().cast("array<int>"))
    left = F.filter(F.split(F.col(text), "\n"), lambda line, k: ~F.array_contains(lost, k))
    kept = F.when(F.size(lost) > 0, F.array_join(left, "\n")).otherwise(F.col(text))
    return rows.withColumns({text: kept, into: lost}).select(*docs.columns, *([] if into in docs.columns else [into]))
