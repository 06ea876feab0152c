"""Byte-pair encoding by segment trees over byte positions.

Leaf i of a word's tree holds the rank of the pair that begins at position i,
times the width plus i, so the root is the leftmost pair of least rank. A merge
changes three leaves (the pair, its live left neighbour and the position that
dies) and repairs their paths to the root: O(log n) for each merge, where
scanning for the least pair takes O(n).

Words of like width are encoded side by side: the trees are the rows of one
array and each step merges in all words that still have a pair. Long words, of
which there are few, have a tree of their own.
"""

from __future__ import annotations

import base64

import numpy as np
import pandas as pd
import regex

#: Words up to this many bytes are encoded side by side.
WIDE = 512
#: Array cells of one side-by-side batch; bounds its memory.
CELLS = 1_000_000
#: Words kept in the cache of one worker; the cache is emptied when it is full.
CACHE = 300_000

#: Fixed value: the pattern that splits text before the merges. word_starts() reads it for whole arrays at once.
PATTERN = r"""'s|'t|'re|'ve|'m|'ll|'d| ?\p{L}+| ?\p{N}+| ?[^\s\p{L}\p{N}]+|\s+(?!\S)|\s+"""

OTHER, LETTER, NUMBER, SPACE = 0, 1, 2, 3

_tables: dict[str, np.ndarray] = {}


def classes() -> np.ndarray:
    """Class of every code point: letter, number, white space or other."""
    if "classes" not in _tables:
        table = np.zeros(0x110000, np.uint8)
        # surrogates are no characters of a text; they count as other
        every = "".join(map(chr, [*range(0xD800), *range(0xE000, 0x110000)]))
        for kind, what in ((LETTER, r"\p{L}+"), (NUMBER, r"\p{N}+"), (SPACE, r"\s+")):
            for m in regex.finditer(what, every):
                table[ord(every[m.start()]) : ord(every[m.end() - 1]) + 1] = kind
        table[0xD800:0xE000] = OTHER
        _tables["classes"] = table
    return _tables["classes"]


def code_points(text: str) -> np.ndarray:
    return np.frombuffer(text.encode("ascii"), np.uint8) if text.isascii() else np.frombuffer(text.encode("utf-32-le", "surrogatepass"), np.uint32)


def word_starts(points: np.ndarray, borders: np.ndarray) -> np.ndarray:
    """Where the pattern's matches begin in texts one after the other; borders: where the texts begin.

    Matches are runs of one class, but for these: the last space of a run of
    white space that other text follows goes to that text if it is a blank and
    stands alone if not, and an apostrophe on its own takes a contraction's letters.
    """
    n = len(points)
    kind = classes()[points]
    begins = np.zeros(n + 3, bool)  # with room behind for what a contraction marks
    begins[borders] = True
    text_begins = begins.copy()
    begins[1:n] |= kind[1:] != kind[:-1]
    runs = begins.copy()
    # the first character of a run that follows white space in the same text
    after = np.flatnonzero(begins[1:n] & ~text_begins[1:n] & (kind[1:] != SPACE) & (kind[:-1] == SPACE)) + 1
    begins[after - 1] = True
    begins[after[points[after - 1] == 0x20]] = False
    quote = np.flatnonzero(points == 0x27)
    quote = quote[begins[quote] & (quote + 1 < n)]
    quote = quote[runs[quote + 1] & ~text_begins[quote + 1]]
    one = points[quote + 1]
    short = np.isin(one, [ord(c) for c in "stmd"])
    begins[quote[short] + 1] = False
    begins[quote[short] + 2] = True
    rest, one = quote[~short], one[~short]
    ok = (rest + 2 < n) & ~text_begins[rest + 2]
    rest, one = rest[ok], one[ok]
    two = points[rest + 2]
    long = ((one == ord("r")) & (two == ord("e"))) | ((one == ord("v")) & (two == ord("e"))) | ((one == ord("l")) & (two == ord("l")))
    begins[rest[long] + 1] = False
    begins[rest[long] + 3] = True
    return np.flatnonzero(begins[:n])


def _powers(n: int) -> tuple[np.ndarray, np.ndarray]:
    """Powers of an odd factor and of its inverse, modulo 2**64."""
    if "powers" not in _tables or len(_tables["powers"]) < n:
        factor = 0xD1B54A32D192ED03
        size = 1 << max(16, (n - 1).bit_length())
        for name, x in (("powers", factor), ("inverse", pow(factor, -1, 1 << 64))):
            steps = np.full(size, x, np.uint64)
            steps[0] = 1
            _tables[name] = np.cumprod(steps)
    return _tables["powers"], _tables["inverse"]


def word_sums(points: np.ndarray, starts: np.ndarray, ends: np.ndarray) -> np.ndarray:
    """A 64-bit sum of each word's characters, from one running sum over all of them."""
    powers, inverse = _powers(len(points) + 1)
    total = np.zeros(len(points) + 1, np.uint64)
    np.cumsum((points.astype(np.uint64) + np.uint64(1)) * powers[: len(points)], out=total[1:])
    return (total[ends] - total[starts]) * inverse[starts] + (ends - starts).astype(np.uint64) * np.uint64(0x9E3779B97F4A7C15)


def read_ranks(path: str) -> dict[bytes, int]:
    """Token bytes -> rank from a rank file (a line holds base64 of the bytes and the rank)."""
    with open(path, "rb") as lines:
        return {base64.b64decode(a): int(b) for a, b in map(bytes.split, lines)}


class Encoder:
    """Encodes text with the ranks of a byte-level vocabulary; ids are ranks."""

    def __init__(self, ranks: dict[bytes, int]):
        self.byte_ids = np.array([ranks[bytes([b])] for b in range(256)], np.int32)
        self.size = max(ranks.values()) + 1
        pairs = {}
        for token, rank in ranks.items():
            for i in range(1, len(token)):
                a, b = ranks.get(token[:i]), ranks.get(token[i:])
                if a is not None and b is not None:
                    pairs[a * self.size + b] = rank
        self.pairs = pairs
        self._hash(pairs)
        self._forget()

    def _hash(self, pairs: dict[int, int]) -> None:
        """An open-addressed table of the pairs, read for whole arrays at once."""
        bits = max(8, (len(pairs) * 4 - 1).bit_length())
        self.shift = np.uint64(64 - bits)
        self.mask = (1 << bits) - 1
        keys = np.fromiter(pairs, np.int64, len(pairs))
        values = np.fromiter(pairs.values(), np.int32, len(pairs))
        self.keys = np.full(1 << bits, -1, np.int64)
        self.values = np.zeros(1 << bits, np.int32)
        slot, left, self.probes = self._slot(keys), np.arange(len(keys)), 0
        while len(left):
            at = (slot[left] + self.probes) & self.mask
            free = self.keys[at] == -1
            put, at = left[free], at[free]
            at, first = np.unique(at, return_index=True)
            self.keys[at], self.values[at] = keys[put[first]], values[put[first]]
            done = np.zeros(len(keys), bool)
            done[put[first]] = True
            left = left[~done[left]]
            self.probes += 1

    def _slot(self, keys: np.ndarray) -> np.ndarray:
        return ((keys.astype(np.uint64) * np.uint64(0x9E3779B97F4A7C15)) >> self.shift).astype(np.int64)

    def _rank(self, a: np.ndarray, b: np.ndarray) -> np.ndarray:
        """Ranks of the pairs (a, b); ``size`` where there is none or b is -1."""
        key = a.astype(np.int64) * self.size + b
        slot = self._slot(key)
        out = np.full(len(key), self.size, np.int32)
        open_ = np.flatnonzero(b >= 0)
        for probe in range(self.probes):
            at = (slot[open_] + probe) & self.mask
            found = self.keys[at]
            hit = found == key[open_]
            out[open_[hit]] = self.values[at[hit]]
            open_ = open_[~hit & (found != -1)]
            if not len(open_):
                break
        return out

    def encode_words(self, words: list[bytes]) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
        """(ids of all words in some order, start and length of each word's ids in them)."""
        lens = np.fromiter(map(len, words), np.int64, len(words))
        width = np.ones(len(words), np.int64)
        while (short := width < lens).any():
            width[short] *= 2
        starts, counts = np.zeros(len(words), np.int64), np.zeros(len(words), np.int64)
        parts, used = [], 0

        def put(own: np.ndarray, ids: np.ndarray, n: np.ndarray) -> None:
            nonlocal used
            counts[own] = n
            starts[own] = used + np.cumsum(n) - n
            parts.append(ids)
            used += len(ids)

        for w in np.unique(width).tolist():
            own = np.flatnonzero(width == w)
            if w > WIDE or (w > 64 and len(own) < 8):
                for i in own.tolist():
                    ids = self._one(words[i])
                    put(np.array([i]), ids, np.array([len(ids)]))
                continue
            step = max(1, CELLS // (2 * w))
            for k in range(0, len(own), step):
                part = own[k : k + step]
                put(part, *self._many([words[i] for i in part.tolist()], lens[part], w))
        return np.concatenate(parts) if parts else np.zeros(0, np.int32), starts, counts

    def _many(self, words: list[bytes], lens: np.ndarray, width: int) -> tuple[np.ndarray, np.ndarray]:
        """(ids of the words one after the other, their counts) of words of at most ``width`` bytes."""
        n = len(words)
        raw = np.frombuffer(b"".join(w.ljust(width, b"\0") for w in words), np.uint8).reshape(n, width)
        place = np.arange(width)
        ids = np.where(place < lens[:, None], self.byte_ids[raw], -1).astype(np.int32)
        ids = np.concatenate([ids, np.full((n, 1), -1, np.int32)], axis=1)  # the place behind the last
        w1 = width + 1
        nxt = np.broadcast_to(np.minimum(place + 1, width).astype(np.int32), (n, width)).copy()
        nxt[place >= (lens - 1)[:, None]] = width
        prv = np.broadcast_to((place - 1).astype(np.int32), (n, width)).copy()
        none = self.size * width
        flat, fnxt, fprv = ids.reshape(-1), nxt.reshape(-1), prv.reshape(-1)
        tree = np.full((n, 2 * width), none, np.int32)
        pairs = self._rank(ids[:, :-1].reshape(-1), ids[:, 1:].reshape(-1)).reshape(n, width)
        tree[:, width:] = np.where(pairs < self.size, pairs * width + place, none)
        level = width
        while level > 1:
            tree[:, level // 2 : level] = np.minimum(tree[:, level : 2 * level : 2], tree[:, level + 1 : 2 * level : 2])
            level //= 2
        ftree = tree.reshape(-1)
        live = np.flatnonzero(tree[:, 1] < none)
        while len(live):
            top = ftree[live * (2 * width) + 1]
            rank, pos = top // width, top % width
            base, base1 = live * width, live * w1
            dead = fnxt[base + pos]
            after = fnxt[base + dead]
            flat[base1 + pos] = rank
            flat[base1 + dead] = -1
            fnxt[base + pos] = after
            inner = after < width
            fprv[base[inner] + after[inner]] = pos[inner]
            right = self._rank(rank, flat[base1 + after])
            before = fprv[base + pos]
            has = before >= 0
            left = self._rank(flat[base1[has] + before[has]], rank[has])
            root = live * (2 * width)
            ftree[root + width + dead] = none
            ftree[root + width + pos] = np.where(right < self.size, right * width + pos, none)
            ftree[root[has] + width + before[has]] = np.where(left < self.size, left * width + before[has], none)
            roots = np.concatenate([root, root, root[has]])
            node = np.concatenate([dead, pos, before[has]]).astype(np.int64) + width
            while True:
                node >>= 1
                at = roots + 2 * node
                ftree[roots + node] = np.minimum(ftree[at], ftree[at + 1])
                if node[0] == 1:
                    break
            live = live[ftree[live * (2 * width) + 1] < none]
        keep = ids[:, :-1] >= 0
        return ids[:, :-1][keep], keep.sum(axis=1)

    def _one(self, word: bytes) -> np.ndarray:
        n = len(word)
        width = 1 << (n - 1).bit_length()
        size, pairs = self.size, self.pairs
        none = size * width
        if n < 2:
            return self.byte_ids[np.frombuffer(word, np.uint8)]
        ids = self.byte_ids[np.frombuffer(word, np.uint8)]
        ranks = self._rank(ids[:-1], ids[1:]).astype(np.int64)
        leaves = np.full(width, none, np.int64)
        leaves[: n - 1] = np.where(ranks < size, ranks * width + np.arange(n - 1), none)
        levels = [leaves]
        while len(levels[-1]) > 1:
            levels.append(np.minimum(levels[-1][::2], levels[-1][1::2]))
        tree = [none, *np.concatenate(levels[::-1]).tolist()]
        ids = ids.tolist()
        nxt, prv = list(range(1, n + 1)), list(range(-1, n - 1))

        def update(i: int, value: int) -> None:
            i += width
            tree[i] = value
            i >>= 1
            while i:
                a, b = tree[2 * i], tree[2 * i + 1]
                least = a if a < b else b
                if tree[i] == least:
                    return
                tree[i] = least
                i >>= 1

        while tree[1] < none:
            rank, pos = divmod(tree[1], width)
            dead = nxt[pos]
            after = nxt[dead]
            ids[pos], ids[dead] = rank, -1
            nxt[pos] = after
            update(dead, none)
            right = size
            if after < n:
                prv[after] = pos
                right = pairs.get(rank * size + ids[after], size)
            update(pos, right * width + pos if right < size else none)
            before = prv[pos]
            if before >= 0:
                left = pairs.get(ids[before] * size + rank, size)
                update(before, left * width + before if left < size else none)
        return np.array([x for x in ids if x >= 0], np.int32)

    def _forget(self) -> None:
        self.known: dict[str, int] = {}
        self.pool = np.zeros(1 << 16, np.int32)
        self.starts = np.zeros(1 << 16, np.int64)
        self.lens = np.zeros(1 << 16, np.int32)
        self.used = self.count = 0

    def _learn(self, words: list[str]) -> np.ndarray:
        """Encodes words, keeps their ids, and returns their numbers in the cache."""
        ids, starts, lens = self.encode_words([w.encode("utf-8", "surrogatepass") for w in words])
        first, self.count = self.count, self.count + len(words)
        while self.used + len(ids) > len(self.pool):
            self.pool = np.concatenate([self.pool, np.zeros_like(self.pool)])
        while self.count > len(self.starts):
            self.starts = np.concatenate([self.starts, np.zeros_like(self.starts)])
            self.lens = np.concatenate([self.lens, np.zeros_like(self.lens)])
        self.pool[self.used : self.used + len(ids)] = ids
        self.starts[first : self.count] = self.used + starts
        self.lens[first : self.count] = lens
        self.used += len(ids)
        return np.arange(first, self.count)

    def _alike(self, points: np.ndarray, starts: np.ndarray, ends: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
        """(group of each word, one word of each group); the words of a group are equal, character by character."""
        codes, unique = pd.factorize(word_sums(points, starts, ends))
        first = np.zeros(len(unique), np.int64)
        first[codes] = np.arange(len(codes))  # the last write stays
        # sums only propose: each word is compared with its group's; one that differs is a group of its own
        lens = ends - starts
        other = first[codes]
        at = np.arange(len(points)) + np.repeat(starts[other] - starts, lens)
        differs = np.add.reduceat(points[np.minimum(at, len(points) - 1)] != points, starts, dtype=np.int64) > 0
        odd = np.flatnonzero(differs | (lens[other] != lens))
        if len(odd):
            codes = codes.copy()
            codes[odd] = len(first) + np.arange(len(odd))
            first = np.concatenate([first, odd])
        return codes, first

    def _indexes(self, texts: list[str]) -> tuple[np.ndarray, np.ndarray]:
        """Number in the cache of every word, and borders of the texts among the words."""
        if self.count > CACHE:
            self._forget()
        joined = "".join(texts)
        borders = np.concatenate([[0], np.cumsum(np.fromiter(map(len, texts), np.int64, len(texts)))])
        if not joined:
            return np.zeros(0, np.int64), np.zeros(len(texts) + 1, np.int64)
        points = code_points(joined)
        starts = word_starts(points, borders[:-1][np.diff(borders) > 0])
        ends = np.append(starts[1:], len(points))
        codes, first = self._alike(points, starts, ends)
        words = [joined[i:j] for i, j in zip(starts[first].tolist(), ends[first].tolist(), strict=True)]
        number = np.fromiter((self.known.get(w, -1) for w in words), np.int64, len(words))
        new = np.flatnonzero(number < 0)
        if len(new):
            unknown = list(dict.fromkeys(words[i] for i in new.tolist()))
            self.known.update(zip(unknown, self._learn(unknown).tolist(), strict=True))
            number[new] = [self.known[words[i]] for i in new.tolist()]
        index = number[codes]
        return index, np.searchsorted(starts, borders)

    def lengths(self, texts: list[str]) -> np.ndarray:
        """Count of tokens of each text."""
        index, borders = self._indexes(texts)
        ends = np.concatenate([[0], np.cumsum(self.lens[index], dtype=np.int64)])
        return np.diff(ends[borders])

    def encode(self, texts: list[str]) -> tuple[np.ndarray, np.ndarray]:
        """All texts' ids one after the other, and offsets of the texts in them."""
        index, borders = self._indexes(texts)
        lens = self.lens[index].astype(np.int64)
        ends = np.concatenate([[0], np.cumsum(lens)])
        ids = self.pool[np.repeat(self.starts[index] - ends[:-1], lens) + np.arange(int(ends[-1]))]
        return ids, ends[borders]
