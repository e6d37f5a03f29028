"""Byte-pair encoding of many texts at once, as ragged numpy arrays.

Texts become code points; the pattern that splits them into pre-tokens is a handful of array
operations on character classes. Pre-tokens are hashed; those met before are looked up in a table of
fixed size, the others are merged together: in each round every sequence applies its lowest-ranked
pair, at all its places, until no sequence has a pair left.

Merging all places of the lowest pair at once equals merging them one by one, as a pair that holds a
merged symbol always ranks behind the merge that made the symbol.
"""

from __future__ import annotations

import json
import re
from collections.abc import Iterator

import numpy as np
from tokenizers import Tokenizer, pre_tokenizers

from .ragged import BASE, U64, _INVERSE, give_back, mix, powers

#: The characters that ``\s`` matches.
WHITE = (*range(9, 14), 32, 0x85, 0xA0, 0x1680, *range(0x2000, 0x200B), 0x2028, 0x2029, 0x202F, 0x205F, 0x3000)
EDGE, LETTER, NUMBER, BLANK, OTHER, UNKNOWN = range(6)
SLOTS = 1 << 18
LATIN = 0x250


def byte_characters() -> list[str]:
    """The printable character that stands for each byte in byte-level vocabularies."""
    plain = {*range(33, 127), *range(161, 173), *range(174, 256)}
    spare = iter(range(256, 512))
    return [chr(b if b in plain else next(spare)) for b in range(256)]


class Segmenter:
    """Splits code points into pre-tokens; classes beyond ASCII come from the library's own pattern."""

    def __init__(self, words: bool) -> None:
        self.words = words
        self.kind = np.full(0x110000, UNKNOWN, np.uint8)
        self.kind[list(WHITE)] = BLANK
        self.library = pre_tokenizers.ByteLevel(add_prefix_space=False, use_regex=True)
        self.value = mix(np.arange(0x110000, dtype=U64) * U64(2) + U64(12345))
        self.learn(np.arange(LATIN))

    def learn(self, points: np.ndarray) -> None:
        """Class of each unknown code point: does it continue a letter, or a digit?"""
        new = [int(p) for p in points if self.kind[p] == UNKNOWN and not 0xD800 <= p < 0xE000]
        text = "".join(f"a{chr(p)}\n1{chr(p)}\n" for p in new)
        ends = {b for _, (_, b) in self.library.pre_tokenize_str(text)} if new else set()
        for i, p in enumerate(new):
            self.kind[p] = LETTER if 6 * i + 1 not in ends else NUMBER if 6 * i + 4 not in ends else OTHER

    def split(self, points: np.ndarray, first: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
        """Start and end of each pre-token; texts begin at ``first`` and are separated by one zero."""
        kind = self.kind[points]
        kind[first[1:-1] - 1] = EDGE
        if (kind == UNKNOWN).any():
            self.learn(np.unique(points[kind == UNKNOWN]))
            kind = self.kind[points]
            kind[first[1:-1] - 1] = EDGE
        n = len(kind)
        before = np.append(EDGE, kind[:-1]).astype(np.uint8)
        after = np.append(kind[1:], EDGE).astype(np.uint8)
        begins = (kind != before) & (kind != EDGE)
        quote = np.flatnonzero((points == 39) & begins)
        if not self.words:
            begins &= ~((kind != BLANK) & (np.append(0, points[:-1]) == 32) & (before == BLANK))
            begins |= (kind == BLANK) & (after != BLANK) & (after != EDGE)
            quote = quote[begins[quote]]
        else:
            begins |= kind == NUMBER
        if len(quote):
            p = np.append(points, [0, 0])
            one, two = p[quote + 1], p[quote + 2]
            short = np.isin(one, [ord(c) for c in "stmd"])
            long = ((one == ord("r")) & (two == ord("e"))) | ((one == ord("v")) & (two == ord("e"))) | ((one == ord("l")) & (two == ord("l")))
            for at, size in ((quote[short], 2), (quote[long & ~short], 3)):
                begins[at + 1] = False
                rest = at + size
                rest = rest[rest < n]
                begins[rest[kind[rest] == LETTER]] = True
        start = np.flatnonzero(begins)
        stop = np.flatnonzero(begins | (kind == EDGE))
        end = np.append(stop, n)[np.searchsorted(stop, start) + 1]
        if self.words:
            keep = kind[start] != BLANK
            start, end = start[keep], end[keep]
        return start, end

    def hashes(self, points: np.ndarray, start: np.ndarray, end: np.ndarray) -> np.ndarray:
        total = np.zeros(len(points) + 1, U64)
        np.cumsum(self.value[points] * powers(int(BASE), len(points)), out=total[1:])
        return mix((total[end] - total[start]) * powers(_INVERSE, len(points) + 1)[start])


class Merges:
    """The pair table of a vocabulary, and merging of many symbol sequences at once."""

    def __init__(self, path: str) -> None:
        with open(path, encoding="utf-8") as f:
            model = json.load(f)["model"]
        vocab, self.suffix = model["vocab"], model["end_of_word_suffix"] or ""
        chars = byte_characters()
        self.symbol = np.array([vocab[c] for c in chars], np.int64)
        self.last = np.array([vocab[c + self.suffix] for c in chars], np.int64)
        pairs = [m.split(" ") if isinstance(m, str) else m for m in model["merges"]]
        key = np.array([vocab[a] << 17 | vocab[b] for a, b in pairs], np.int64)
        made = np.array([vocab[a + (b)] for a, b in pairs], np.int64)
        self.none = len(pairs)
        self.made = np.append(made, -1)
        bits = 20
        self.shift = U64(64 - bits)
        self.keys = np.full((1 << bits) + 64, -1, np.int64)
        self.ranks = np.full((1 << bits) + 64, self.none, np.int32)
        slot = self._slot(key)
        self.probes = 1
        for i, (k, s) in enumerate(zip(key.tolist(), slot.tolist())):
            at = s
            while self.keys[at] not in (-1, k):
                at += 1
            if self.keys[at] == -1:
                self.keys[at], self.ranks[at] = k, i
            self.probes = max(self.probes, at - s + 1)

    def _slot(self, key: np.ndarray) -> np.ndarray:
        return (key.view(U64) * U64(0x9E3779B97F4A7C15) >> self.shift).astype(np.int64)

    def rank(self, a: np.ndarray, b: np.ndarray) -> np.ndarray:
        key = a << 17 | b
        slot = self._slot(key)
        out = np.where(self.keys[slot] == key, self.ranks[slot], self.none)
        open_ = np.flatnonzero((self.keys[slot] != key) & (self.keys[slot] != -1))
        for p in range(1, self.probes):
            if not len(open_):
                break
            at = slot[open_] + p
            hit = self.keys[at] == key[open_]
            out[open_[hit]] = self.ranks[at[hit]]
            open_ = open_[~hit & (self.keys[at] != -1)]
        return out

    def merge(self, raw: np.ndarray, count: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
        """Ids of byte sequences end to end (``count`` bytes each, one at least), and ids per sequence."""
        stop = np.cumsum(count)
        ids = self.symbol[raw]
        ids[stop - 1] = self.last[raw[stop - 1]]
        done_ids = ids
        seq = np.repeat(np.arange(len(count)), count)
        whole: list[tuple[np.ndarray, np.ndarray]] = []
        while len(ids):
            inner = np.append(seq[1:] == seq[:-1], False)
            rank = np.full(len(ids), self.none, np.int64)
            at = np.flatnonzero(inner)
            rank[at] = self.rank(ids[at], ids[at + 1])
            first = np.flatnonzero(np.append(True, seq[1:] != seq[:-1]))
            low = np.minimum.reduceat(rank, first)
            size = np.diff(np.append(first, len(ids)))
            open_ = np.repeat(low < self.none, size)
            if not open_.all():
                whole.append((seq[~open_], ids[~open_]))
                ids, seq, rank, low, size = ids[open_], seq[open_], rank[open_], low[low < self.none], size[low < self.none]
                if not len(ids):
                    break
            hit = rank == np.repeat(low, size)
            if (hit[1:] & hit[:-1]).any():
                where = np.arange(len(hit))
                run = np.maximum.accumulate(np.where(hit, -1, where))
                hit &= (where - run) % 2 == 1
            at = np.flatnonzero(hit)
            ids[at] = self.made[rank[at]]
            keep = np.ones(len(ids), bool)
            keep[at + 1] = False
            ids, seq = ids[keep], seq[keep]
        if not whole:
            return done_ids[:0], np.zeros(len(count), np.int64)
        seq = np.concatenate([s for s, _ in whole])
        ids = np.concatenate([x for _, x in whole])
        return ids[np.argsort(seq, kind="stable")], np.bincount(seq, minlength=len(count))


class Encoder:
    """Ids, or only their number, of whole texts; equal to the library's without added tokens."""

    def __init__(self, path: str) -> None:
        self.library = Tokenizer.from_file(path)
        with open(path, encoding="utf-8") as f:
            spec = json.load(f)
        self.special = {t["content"]: t["id"] for t in spec["added_tokens"]}
        self.pattern = re.compile("(" + "|".join(re.escape(s) for s in sorted(self.special, key=len, reverse=True)) + ")") if self.special else None
        self.normal = spec["normalizer"] is not None
        self.cut = Segmenter(words=self.normal)
        self.merges = Merges(path)
        self.lower = np.array([ord(chr(c).lower()) if len(chr(c).lower()) == 1 else c for c in range(LATIN)], np.uint32)
        self.seen = np.zeros(SLOTS, U64)
        self.number = np.zeros(SLOTS, np.int32)
        self.place = np.zeros(SLOTS, np.int64)
        self.store = np.zeros(1 << 16, np.int32)
        self.used = 0

    def pieces(self, texts: list[str]) -> tuple[np.ndarray, np.ndarray, np.ndarray, list[tuple[int, int]]]:
        """Code points, where pieces begin, their text's number, and special tokens as (piece, id)."""
        parts, owner, special = [], [], []
        for i, text in enumerate(texts):
            if self.pattern is not None and "<|" in text and self.pattern.search(text):
                for j, x in enumerate(self.pattern.split(text)):
                    if j % 2:
                        special.append((len(parts) - 1, self.special[x]))
                    else:
                        parts.append(x)
                        owner.append(i)
            else:
                parts.append(text)
                owner.append(i)
        points = np.frombuffer("\0".join(parts).encode("utf-32-le"), np.uint32)
        if self.normal:
            odd = points >= LATIN
            odd |= points == 0x130
            if odd.any():
                parts = [self.library.normalizer.normalize_str(p) if any(ord(c) >= LATIN or c == "İ" for c in p) else p for p in parts]
                points = np.frombuffer("\0".join(parts).encode("utf-32-le"), np.uint32)
            points = np.where(points < LATIN, self.lower[np.minimum(points, LATIN - 1)], points)
        first = np.concatenate([[0], np.cumsum(np.array([len(p) + 1 for p in parts], np.int64))])
        return points, first, np.array(owner, np.int64), special

    def encode(self, texts: list[str], ids: bool = True) -> tuple[np.ndarray | None, np.ndarray]:
        """All ids end to end (None unless asked for), and how many each text has."""
        if not texts:
            return np.zeros(0, np.int32), np.zeros(0, np.int64)
        points, first, owner, special = self.pieces(texts)
        start, end = self.cut.split(points, first)
        h = self.cut.hashes(points, start, end)
        slot = (h & U64(SLOTS - 1)).astype(np.int64)
        hit = self.seen[slot] == h
        number, place = self.number[slot], self.place[slot]
        if ids:
            hit &= place >= 0  # what was only counted has no ids yet
        store = self.store
        miss = np.flatnonzero(~hit)
        if len(miss):
            new, at, back = np.unique(h[miss], return_index=True, return_inverse=True)
            a, b = start[miss[at]], end[miss[at]]
            made, many = self.merges.merge(*self.bytes_of(points, a, b))
            number[miss] = many[back]
            if ids:
                if self.used + len(made) > 1 << 24:
                    self.seen[:] = 0
                    store, self.store, self.used = self.store[: self.used].copy(), np.zeros(1 << 16, np.int32), 0
                    base = len(store)
                    store = np.concatenate([store, made.astype(np.int32)])
                    place[miss] = (base + np.cumsum(many) - many)[back]
                else:
                    while self.used + len(made) > len(self.store):
                        self.store = np.concatenate([self.store, np.zeros(len(self.store), np.int32)])
                    self.store[self.used : self.used + len(made)] = made
                    where = self.used + np.cumsum(many) - many
                    self.used += len(made)
                    store = self.store
                    place[miss] = where[back]
                    self.remember(new, many, where)
            else:
                self.remember(new, many, None)
        text = owner[np.searchsorted(first, start, side="right") - 1]
        count = np.bincount(text, weights=number, minlength=len(texts)).astype(np.int64)
        out = None
        if ids:
            total = np.cumsum(number, dtype=np.int64)
            begin = total - number
            out = store[np.arange(total[-1] if len(total) else 0) + np.repeat(place - begin, number)]
            if special:
                piece = np.searchsorted(first, start, side="right") - 1
                behind = np.append(begin, total[-1] if len(total) else 0)[np.searchsorted(piece, [p for p, _ in special], side="right")]
                out = np.insert(out, behind, [x for _, x in special])
        for p, _ in special:
            count[owner[p]] += 1
        return out, count

    def remember(self, new: np.ndarray, many: np.ndarray, where: np.ndarray | None) -> None:
        slot = (new & U64(SLOTS - 1)).astype(np.int64)
        self.seen[slot] = new
        self.number[slot] = many
        self.place[slot] = -1 if where is None else where

    @staticmethod
    def bytes_of(points: np.ndarray, start: np.ndarray, end: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
        """UTF-8 bytes of the spans end to end, and bytes per span."""
        size = end - start
        at = np.arange(size.sum()) + np.repeat(start - (np.cumsum(size) - size), size)
        p = points[at].astype(np.int64)
        wide = 1 + (p >= 0x80) + (p >= 0x800) + (p >= 0x10000)
        raw = np.frombuffer(p.astype(np.uint32).tobytes().decode("utf-32-le").encode("utf-8"), np.uint8)
        return raw, np.add.reduceat(wide, np.cumsum(size) - size) if len(size) else np.zeros(0, np.int64)


_encoders: dict[str, Encoder] = {}


def encoder(path: str) -> Encoder:
    """The encoder for a vocabulary file, made once in each Python worker."""
    if path not in _encoders:
        _encoders[path] = Encoder(path)
        give_back()
    return _encoders[path]


def runs(sizes: list[int], limit: int = 1 << 21) -> Iterator[tuple[int, int]]:
    """Runs of consecutive rows of about ``limit`` characters, one row at least."""
    begin, total = 0, 0
    for i, size in enumerate(sizes):
        if total and total + size > limit:
            yield begin, i
            begin, total = i, 0
        total += size
    if begin < len(sizes):
        yield begin, len(sizes)
