"""Token ids of whole texts with a public tokenizer file.

Texts are cut into units where every pre-tokenizer of the supported files cuts anyway, so a
unit has the same ids wherever it stands: before a blank, and between letters, marks and line
breaks of plain pieces.  Anything else, a piece with other characters or a text with odd
blanks, is one unit that the tokenizer cuts itself.  Units are hashed and made distinct in
numpy; ids of units seen before come from a table of bounded size, new ones are asked from the
tokenizers library.  A hash only proposes a unit: its bytes are compared every time.
"""

from __future__ import annotations

from itertools import chain

import numpy as np
from tokenizers import Tokenizer, pre_tokenizers

from .common import CHUNK_BYTES, U64, mix, ship, worker_cache

ship(__name__)

#: Units, ids and bytes remembered at most; then the table starts anew.
UNITS, IDS, BYTES = 800_000, 4_000_000, 32_000_000
#: Slots of the array in which units are looked up first; a slot holds the unit it saw last.
SLOTS = 1 << 19

_BASE = 0x9E3779B97F4A7C15 | 1
_POWERS: dict[str, np.ndarray] = {}


def powers(n: int) -> tuple[np.ndarray, np.ndarray]:
    """Powers of an odd base and of its inverse modulo 2**64."""
    if "up" not in _POWERS or len(_POWERS["up"]) < n:
        size = max(n, CHUNK_BYTES + 1024)
        for key, base in (("up", _BASE), ("down", pow(_BASE, -1, 1 << 64))):
            steps = np.full(size, U64(base & (1 << 64) - 1))
            steps[0] = U64(1)
            _POWERS[key] = np.cumprod(steps)
    return _POWERS["up"][:n], _POWERS["down"][:n]


BLANK, BREAK, LETTER, MARK, OTHER = range(5)
_CLASS = np.full(256, OTHER, np.uint8)
_CLASS[[*range(65, 91), *range(97, 123)]] = LETTER
_CLASS[[*range(33, 48), *range(58, 65), *range(91, 97), *range(123, 127)]] = MARK
_CLASS[ord("'")] = OTHER  # contractions
_CLASS[32], _CLASS[10] = BLANK, BREAK
#: Second bytes of the letters from U+00C0 to U+00FF, all but the two signs among them.
_LATIN = np.zeros(256, bool)
_LATIN[128:192] = True
_LATIN[[0x97, 0xB7]] = False
#: First bytes of blanks and of characters that may be blanks.
_MAYBE_BLANK = np.zeros(256, bool)
_MAYBE_BLANK[[*range(33), 0x7F, 0xC2, 0xE1, 0xE2, 0xE3]] = True


def _byte_level(text: str) -> str:
    unit = pre_tokenizers.ByteLevel(add_prefix_space=False, use_regex=False)
    return "".join(part for part, _ in unit.pre_tokenize_str(text))


_BYTES = {c: _byte_level(chr(c)) for c in [10, 32, *range(0xC0, 0x100)]}


class _Rows:
    """Growing rows of numbers, one after the other."""

    def __init__(self, kind):
        self.flat, self.used, self.count = np.zeros(1 << 16, kind), 0, 0
        self.starts, self.lengths = np.zeros(1 << 14, np.int64), np.zeros(1 << 14, np.int64)

    def __len__(self) -> int:
        return self.count

    def add(self, lengths: np.ndarray, flat: np.ndarray) -> None:
        count, end = self.count + len(lengths), self.used + len(flat)
        for name, size in (("starts", count), ("lengths", count), ("flat", end + 8)):
            held = getattr(self, name)
            if size > len(held):
                grown = np.zeros(2 * size, held.dtype)
                grown[:len(held)] = held
                setattr(self, name, grown)
        self.flat[self.used:end] = flat
        self.lengths[self.count:count] = lengths
        self.starts[self.count:count] = self.used + np.cumsum(lengths) - lengths
        self.count, self.used = count, end

    def of(self, numbers: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
        """These rows, one after the other, and where each begins (and the end)."""
        lengths = self.lengths[numbers]
        after = np.append(0, np.cumsum(lengths))
        shift = np.repeat(self.starts[numbers] - after[:-1], lengths)
        return self.flat[shift + np.arange(after[-1])], after


#: Units of more bytes are compared one by one.
LONG = 64
_FIRST = np.array([(1 << 8 * n) - 1 for n in range(9)], U64)


def _eights(data: np.ndarray) -> np.ndarray:
    """The eight bytes from every place on as one number, the first one lowest; ``data`` has 8 to spare."""
    return np.ndarray((len(data) - 7,), "<u8", data.data, strides=(1,))


class Encoder:
    """Ids equal to encoding each text by itself.

    ``spaced``: the file keeps a blank as part of the word after it (byte-level files), else
    it lower-cases and drops white space.  Special tokens within a text are ordinary text.
    """

    def __init__(self, path: str, spaced: bool):
        self.tokenizer = Tokenizer.from_file(path)
        self.tokenizer.encode_special_tokens = True
        self.spaced = spaced
        self._clear()

    def _clear(self) -> None:
        self.known: dict[int, int] = {}
        self.collided: dict[tuple[bytes, bool], int] = {}
        self.slot_key, self.slot_unit = np.zeros(SLOTS, U64), np.zeros(SLOTS, np.int32)
        self.ids, self.bytes = _Rows(np.uint32), _Rows(np.uint8)
        self.odd = _Rows(bool)

    def encode(self, texts: list[str]) -> list[np.ndarray]:
        raw = [t.encode() for t in texts]
        offsets = np.cumsum([0] + [len(r) for r in raw])
        ids, bounds = self.encode_flat(np.frombuffer(b"".join(raw), np.uint8), offsets)
        return [ids[a:b] for a, b in zip(bounds[:-1].tolist(), bounds[1:].tolist())]

    def encode_flat(self, data: np.ndarray, offsets: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
        """Ids of all texts, one after the other, and where each text's begin (and the end)."""
        starts, odd, low = self._units(data, offsets)
        ends = np.append(starts[1:], len(data))
        keys = self._keys(low, starts, ends, odd)
        if not self.spaced and len(starts):  # white space between units has no ids
            solid = (_CLASS[data[starts]] > BREAK) | odd
            starts, ends, odd, keys = starts[solid], ends[solid], odd[solid], keys[solid]
        unit = self._unit_numbers(data, low, starts, ends, odd, keys)
        ids, after = self.ids.of(unit)
        bounds = after[np.searchsorted(starts, offsets)]
        if len(self.odd) > UNITS or self.ids.used > IDS or self.bytes.used > BYTES:
            self._clear()
        return ids, bounds

    def _unit_numbers(self, data, low, starts, ends, odd, keys) -> np.ndarray:
        """The number of each unit; units not seen before are encoded."""
        slot = (keys & U64(SLOTS - 1)).astype(np.int64)
        unit = self.slot_unit[slot].astype(np.int64)
        missed = np.flatnonzero(self.slot_key[slot] != keys)
        distinct, first, inverse = np.unique(keys[missed], return_index=True, return_inverse=True)
        first = missed[first]
        numbers = list(map(self.known.get, distinct.tolist()))
        new = [i for i, number in enumerate(numbers) if number is None]
        for i, number in zip(new, self._learn(data, low, starts, ends, odd, first[new])):
            numbers[i] = self.known[int(distinct[i])] = number
        if len(missed):
            numbers = np.array(numbers, np.int64)
            unit[missed] = numbers[inverse]
            self.slot_key[slot[first]], self.slot_unit[slot[first]] = distinct, numbers
        for a in np.flatnonzero(~self._same(low, starts, ends, odd, unit)).tolist():  # another unit has the key
            other = (low[starts[a]:ends[a]].tobytes(), bool(odd[a]))
            if other not in self.collided:
                self.collided[other] = self._learn(data, low, starts, ends, odd, np.array([a]))[0]
            unit[a] = self.collided[other]
        return unit

    def _same(self, low, starts, ends, odd, unit) -> np.ndarray:
        """Whether units have the bytes of those whose numbers they were given."""
        lengths, held = ends - starts, self.bytes.starts[unit]
        same = (self.bytes.lengths[unit] == lengths) & (self.odd.flat[unit] == odd)
        now, seen = _eights(np.append(low, np.zeros(8, np.uint8))), _eights(self.bytes.flat)
        at, step = np.flatnonzero(same & (lengths <= LONG)), 0
        while len(at):
            left = lengths[at] - step
            wrong = ((now[starts[at] + step] ^ seen[held[at] + step]) & _FIRST[np.minimum(left, 8)]) != 0
            same[at[wrong]] = False
            at, step = at[~wrong & (left > 8)], step + 8
        for a in np.flatnonzero(same & (lengths > LONG)).tolist():
            same[a] = np.array_equal(low[starts[a]:ends[a]], self.bytes.flat[held[a]:held[a] + lengths[a]])
        return same

    def _learn(self, data, low, starts, ends, odd, at: np.ndarray) -> range:
        """Encodes the units ``at``; their numbers."""
        before, lengths = len(self.odd), ends[at] - starts[at]
        found = [self._ids(low[a:b].tobytes(), data[a:b].tobytes(), o)
                 for a, b, o in zip(starts[at].tolist(), ends[at].tolist(), odd[at].tolist())]
        self.ids.add(np.fromiter(map(len, found), np.int64, len(found)),
                     np.fromiter(chain.from_iterable(found), np.uint32))
        shift = np.repeat(starts[at] - np.cumsum(lengths) + lengths, lengths)
        self.bytes.add(lengths, low[shift + np.arange(len(shift))])
        self.odd.add(np.ones(len(at), np.int64), odd[at])
        return range(before, len(self.odd))

    def _units(self, data: np.ndarray, offsets: np.ndarray) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
        """Where units start, which of them the tokenizer has to cut itself, and the bytes to look at."""
        n = len(data)
        edge = np.zeros(n + 1, bool)
        edge[offsets] = True
        kind = _CLASS[data]
        lead = np.flatnonzero(data[:-1] == 0xC3) if n else np.zeros(0, np.int64)
        lead = lead[_LATIN[data[lead + 1]]]
        kind[lead] = kind[lead + 1] = LETTER
        low = data
        if not self.spaced:
            low = np.where((data >= 65) & (data <= 90), data + 32, data).astype(np.uint8)
            upper = lead[data[lead + 1] < 0x9F] + 1
            low[upper] += 32
        begin = edge[:n] | (kind == BLANK)
        if not self.spaced:
            begin |= kind == BREAK
        piece = np.cumsum(begin) - 1
        pieces = int(piece[-1]) + 1 if n else 0
        odd_piece = np.bincount(piece[kind == OTHER], minlength=pieces) > 0
        inner = np.zeros(n, bool)
        inner[1:] = kind[1:] != kind[:-1]
        if self.spaced:
            inner[1:] &= kind[:-1] != BLANK  # a blank is part of what follows it
            two = np.flatnonzero((kind[1:] == BREAK) & (kind[:-1] == BREAK)) + 1 if n else np.zeros(0, np.int64)
            odd_piece[piece[two]] = True
        cut = begin | (inner & ~odd_piece[piece]) if n else begin
        if self.spaced and n:
            # a blank before white space or at the end belongs to a run that only the whole text decides
            follows = _MAYBE_BLANK[np.append(data[1:], 0)] | edge[1:]
            text = np.searchsorted(offsets, np.flatnonzero((kind == BLANK) & follows), "right") - 1
            for t in np.unique(text).tolist():
                a, b = int(offsets[t]), int(offsets[t + 1])
                cut[a:b] = False
                cut[a] = True
                odd_piece[piece[a]] = True
        starts = np.flatnonzero(cut)
        return starts, odd_piece[piece[starts]] if n else np.zeros(0, bool), low

    @staticmethod
    def _keys(low: np.ndarray, starts: np.ndarray, ends: np.ndarray, odd: np.ndarray) -> np.ndarray:
        up, down = powers(len(low))
        sums = np.zeros(len(low) + 1, U64)
        np.cumsum((low.astype(U64) + U64(1)) * up, out=sums[1:])
        return mix((sums[ends] - sums[starts]) * down[starts] + odd.astype(U64) * U64(0x632BE59BD9B4E019))

    def _ids(self, low: bytes, raw: bytes, odd: bool) -> list[int]:
        if odd:
            return self.tokenizer.encode(raw.decode(), add_special_tokens=False).ids
        return [t.id for t in self.tokenizer.model.tokenize(low.decode().translate(_BYTES))]


def with_end(ids: np.ndarray, bounds: np.ndarray, end_id: int) -> tuple[np.ndarray, np.ndarray]:
    """Ids and bounds with an end id after each text."""
    return np.insert(ids, bounds[1:], np.uint32(end_id)), bounds + np.arange(len(bounds))


def encoder(path: str, spaced: bool) -> Encoder:
    """One encoder for each Python worker."""
    cache = worker_cache()
    if (path, spaced) not in cache:
        cache[path, spaced] = Encoder(path, spaced)
    return cache[path, spaced]
