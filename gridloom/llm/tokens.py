"""Batch encoding with a public tokenizer, through a cache of text units.

A byte-level BPE first cuts a text into words and encodes each by itself.  A unit
here is a stretch of text between two places at which the tokenizer always cuts.
The tokenizer encodes each distinct unit once per worker; a text's ids are those of
its units in order.  Texts of ASCII and Latin letters are cut on arrays of bytes, a
chunk at a time, and their units known by two 64-bit hashes; others are cut by a
pattern, and texts that hold a special token's string go to the tokenizer whole, as do
all texts where the tokenizer's file has other cuts than these or changes texts first.
"""

from __future__ import annotations

import functools
import itertools
import json
import os
import re
from collections.abc import Iterable, Iterator

import numpy as np

#: Unicode white space as the tokenizer's pattern sees it, for a character class.
_WS = "\t-\r \x85\xa0\u1680\u2000-\u200a\u2028\u2029\u202f\u205f\u3000"
#: Latin letters; a run that another alphanumeric character follows isn't cut there.
_LETTERS = "A-Za-zÀ-ÖØ-öø-ÿ"
_UNITS = re.compile(rf" ?[{_LETTERS}]++(?![^\W\d_])| ?[^{_WS}]+|[{_WS}]+(?![^{_WS}])|[{_WS}]+")
#: Texts that need the pattern: anything beyond ASCII but Latin letters, whose first byte is 0xC3.
_ODD = re.compile(rb"[\xc2\xc4-\xff]|\xc3[\x97\xb7]")
#: Distinct units that a worker keeps; beyond it the cache starts anew.
CACHE_UNITS = 1_500_000
#: Units of bytes that are noted beside the large table before they go there at once.
LATE_UNITS = 65_536
#: Characters encoded at a time, and new units that the tokenizer gets at a time.
CHUNK_CHARS, NEW_UNITS = 400_000, 4096

#: Classes of bytes: 0 white space but a space, 1 space, 2 letter, 3 digit, 4 other.
_CLASS = np.full(256, 4, np.uint8)
_CLASS[[9, 10, 11, 12, 13]], _CLASS[32] = 0, 1
_CLASS[[*range(65, 91), *range(97, 123), *range(128, 256)]] = 2
_CLASS[48:58] = 3
_MULTIPLIERS = (0x9E3779B97F4A7C15, 0xD6E8FEB86659FD93)
_CODES = np.random.default_rng(5).integers(1, 1 << 63, (2, 256), dtype=np.uint64)


@functools.cache
def _powers(which: int, size: int) -> tuple[np.ndarray, np.ndarray]:
    """Powers of a multiplier and of its inverse modulo 2 ** 64."""
    up, down = _MULTIPLIERS[which], pow(_MULTIPLIERS[which], -1, 1 << 64)
    powers = lambda x: np.cumprod(np.concatenate([[np.uint64(1)], np.full(size - 1, np.uint64(x))]), dtype=np.uint64)
    return powers(up), powers(down)


def _starts(data: np.ndarray, texts: np.ndarray) -> np.ndarray:
    """Where units start in joined texts of ASCII and Latin letters; `texts` are the texts' starts.

    Before white space that follows something else; before the last white space of a run
    that something follows, and behind it unless it is a space; where letters, digits and
    other characters meet, but not between an apostrophe and a letter.
    """
    kind = _CLASS[data]
    before = np.concatenate([[np.uint8(1)], kind[:-1]])
    solid, was_solid = kind >= 2, before >= 2
    first = np.zeros(len(data) + 1, bool)
    inner = np.ones(len(data), bool)
    inner[texts[texts < len(data)]] = False
    meets = solid & was_solid & (kind != before)
    apostrophe = np.concatenate([[False], data[:-1] == 39])
    follows = solid & ~was_solid & inner
    first[:-1] = ~inner | (inner & ((~solid & was_solid) | (meets & ~(apostrophe & (kind == 2))))) | (follows & (before == 0))
    first[np.flatnonzero(follows) - 1] = True
    return np.flatnonzero(first[:-1])


def _unit_keys(data: np.ndarray, starts: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    """Two hashes of each unit's bytes."""
    size = 1 << max(16, int(len(data)).bit_length())
    ends = np.append(starts[1:], len(data))
    keys = []
    for which in (0, 1):
        up, down = _powers(which, size)
        sums = np.zeros(len(data) + 1, np.uint64)
        np.cumsum(_CODES[which][data] * up[: len(data)], out=sums[1:])
        key = (sums[ends] - sums[starts]) * down[starts]
        key ^= key >> np.uint64(31)
        key *= np.uint64(_MULTIPLIERS[1 - which])
        keys.append(key ^ (key >> np.uint64(29)))
    return keys[0], keys[1]


def _merged(table: tuple[np.ndarray, ...], rows: tuple[np.ndarray, ...]) -> tuple[np.ndarray, ...]:
    """Two tables, each in order of its first array, as one."""
    at = np.searchsorted(table[0], rows[0])
    return tuple(np.insert(x, at, y) for x, y in zip(table, rows, strict=True))


class _Index(dict):
    """Unit -> its number; unknown units get the next number and are noted."""

    def __init__(self) -> None:
        super().__init__()
        self.new: list[str] = []
        self.next = 0

    def __missing__(self, unit: str) -> int:
        self[unit] = n = self.next
        self.next += 1
        self.new.append(unit)
        return n


class Encoder:
    """`tokenizers` ids of whole texts, without special tokens added."""

    def __init__(self, path: str, cache_units: int = CACHE_UNITS) -> None:
        os.environ["TOKENIZERS_PARALLELISM"] = "false"
        from tokenizers import Tokenizer

        self.tokenizer = Tokenizer.from_file(path)
        self.by_units = self._cuts_are_known()
        self.specials = [x.content for x in self.tokenizer.get_added_tokens_decoder().values()]
        self.cache_units = cache_units
        self._reset()

    def _cuts_are_known(self) -> bool:
        """Whether the tokenizer cuts texts into words as this module does; others get texts whole."""
        setting = json.loads(self.tokenizer.to_str())
        known = {"type": "ByteLevel", "add_prefix_space": False, "use_regex": True}
        cuts = setting["pre_tokenizer"] or {}
        plain = not any(x["normalized"] or x["lstrip"] or x["rstrip"] or x["single_word"] for x in setting["added_tokens"])
        return plain and not setting["normalizer"] and not setting["truncation"] and not setting["padding"] and {k: cuts.get(k) for k in known} == known

    def _reset(self) -> None:
        self.index = _Index()
        self.early, self.late = (tuple(np.zeros(0, t) for t in (np.uint64, np.uint64, np.int64)) for _ in range(2))
        self.flat = np.zeros(1 << 16, np.uint32)
        self.start = np.zeros(1 << 14, np.int64)
        self.n_flat = self.n_units = 0

    def _learn(self, new: list[str]) -> None:
        """Encode new units and append their ids under the next numbers."""
        if not new:
            return
        got = [e.ids for low in range(0, len(new), NEW_UNITS) for e in self.tokenizer.encode_batch(new[low : low + NEW_UNITS], add_special_tokens=False)]
        sizes = np.fromiter(map(len, got), np.int64, len(got))
        ids = np.fromiter(itertools.chain.from_iterable(got), np.uint32, int(sizes.sum()))
        while self.n_flat + len(ids) > len(self.flat):
            self.flat = np.concatenate([self.flat, np.zeros_like(self.flat)])
        while self.n_units + len(got) + 1 > len(self.start):
            self.start = np.concatenate([self.start, np.zeros_like(self.start)])
        self.flat[self.n_flat : self.n_flat + len(ids)] = ids
        self.start[self.n_units + 1 : self.n_units + len(got) + 1] = self.n_flat + np.cumsum(sizes)
        self.n_flat += len(ids)
        self.n_units += len(got)

    def _ids(self, number: np.ndarray, units: np.ndarray) -> list[np.ndarray]:
        """Ids of texts that have so many `units` each, given their units' numbers."""
        first, n = self.start[number], self.start[number + 1] - self.start[number]
        ends = np.cumsum(n)
        ids = self.flat[np.repeat(first - (ends - n), n) + np.arange(n.sum())]
        return np.split(ids, np.concatenate([[0], ends])[np.cumsum(units)][:-1])

    def _by_pattern(self, texts: list[str]) -> list[np.ndarray]:
        units = [_UNITS.findall(x) for x in texts]
        self.index.next = self.n_units
        number = np.fromiter(map(self.index.__getitem__, itertools.chain.from_iterable(units)), np.int64)
        new, self.index.new = self.index.new, []
        self._learn(new)
        return self._ids(number, np.array(list(map(len, units))))

    def _known(self, keys: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
        """The number of each key, -1 for unknown ones, and its other hash."""
        number, check = np.full(len(keys), -1), np.zeros(len(keys), np.uint64)
        for key, other, numbers in (self.early, self.late):
            at = np.searchsorted(key, keys)
            hit = at < len(key)
            hit[hit] = key[at[hit]] == keys[hit]
            number[hit], check[hit] = numbers[at[hit]], other[at[hit]]
        return number, check

    def _by_bytes(self, texts: list[bytes]) -> list[np.ndarray] | None:
        """None if two units of the chunk or cache share one hash and not the other."""
        raw = b"".join(texts)
        sizes = np.array(list(map(len, texts)))
        places = np.cumsum(sizes) - sizes
        data = np.frombuffer(raw, np.uint8)
        starts = _starts(data, places)
        key, check = _unit_keys(data, starts)
        distinct, which = np.unique(key, return_inverse=True)
        one = np.zeros(len(distinct), np.int64)
        one[which] = np.arange(len(which))
        number, seen = self._known(distinct)
        known = number >= 0
        if (check[one][which] != check).any() or (seen[known] != check[one[known]]).any():
            return None
        fresh = ~known
        low, high = starts[one[fresh]].tolist(), np.append(starts[1:], len(raw))[one[fresh]].tolist()
        numbers = self.n_units + np.arange(len(low))
        self._learn([raw[a:b].decode() for a, b in zip(low, high, strict=True)])
        number[fresh] = numbers
        self.late = _merged(self.late, (distinct[fresh], check[one[fresh]], numbers))
        if len(self.late[0]) > LATE_UNITS:
            self.early, self.late = _merged(self.early, self.late), tuple(x[:0] for x in self.late)
        number = number[which]
        return self._ids(number, np.diff(np.append(np.searchsorted(starts, places), len(starts))))

    def _chunk(self, texts: list[str]) -> list[np.ndarray]:
        if self.n_units > self.cache_units:
            self._reset()
        raw = [x.encode() for x in texts]
        odd = [bool(_ODD.search(x)) for x in raw]
        plain = [x for x, o in zip(raw, odd, strict=True) if not o]
        found = self._by_bytes(plain) if plain else []
        if found is None:
            odd, found = [True] * len(texts), []
        rest = [x for x, o in zip(texts, odd, strict=True) if o]
        ready, slow = iter(found), iter(self._by_pattern(rest) if rest else [])
        return [next(slow) if o else next(ready) for o in odd]

    def encode(self, texts: Iterable[str | None]) -> Iterator[np.ndarray]:
        """A uint32 array of ids for each text; a null text is an empty one."""
        chunk: list[str] = []
        chars = 0
        for text in texts:
            text = text or ""
            special = not self.by_units or any(s in text for s in self.specials)
            if not special:
                chunk.append(text)
                chars += len(text)
            if chunk and (special or chars > CHUNK_CHARS):
                yield from self._chunk(chunk)
                chunk, chars = [], 0
            if special:
                yield np.array(self.tokenizer.encode(text, add_special_tokens=False).ids, np.uint32)
        if chunk:
            yield from self._chunk(chunk)


@functools.cache
def encoder(path: str) -> Encoder:
    """This worker's encoder; Spark keeps workers, so the cache outlives tasks."""
    return Encoder(path)
