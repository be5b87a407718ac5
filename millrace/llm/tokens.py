"""Exact and fast encoding of whole texts with a public tokenizer file, on columns of bytes.

Byte-pair merges stay within the pieces that a tokenizer's pre-tokenizer makes, and pieces repeat. So texts are cut into
words on their bytes, words are looked up in a table of fixed size, and only words that aren't in it are merged, many at
once. Whatever isn't plainly Latin goes to the tokenizers library as it is. Memory doesn't grow with the input.
"""

from __future__ import annotations

import json
import os
import unicodedata
from collections.abc import Iterable, Iterator

import numpy as np
import pyarrow as pa

#: Bytes of texts worked on at once. Longer texts are cut at spaces.
AT_ONCE = 1 << 20
#: Bytes of a word that fit its row of the table; longer words are encoded each time they are met.
KEY = 24
#: Slots of the table of words (log2), and words kept: at half full, those met most often stay.
SLOTS, WORDS = 19, 1 << 18
#: Longest part of a word by group of parts that are merged together.
WIDTHS = (2, 4, 6, 8, 10, 12, 14, 16, 20, KEY)
#: Parts merged at once, so that the arrays stay in the processor's cache.
PARTS_AT_ONCE = 4096
#: Code points below are told apart here; a word with one from here on goes to the library.
LATIN_END = 0x250

_A, _B, _C = (np.uint64(x) for x in (0x9E3779B97F4A7C15, 0xBF58476D1CE4E5B9, 0x94D049BB133111EB))
_MASKS = np.array([(1 << 8 * n) - 1 for n in range(9)], np.uint64)
_SPACE = np.zeros(256, bool)
_SPACE[[9, 10, 11, 12, 13, 32]] = True
#: Bytes that may start white space or a separator which libraries classify differently, or a special token ("<|").
_DOUBT = np.zeros(256, bool)
_DOUBT[[0, 0x1C, 0x1D, 0x1E, 0x1F, 0x3C, 0xC2, 0xE1, 0xE2, 0xE3, 0xEF]] = True
_DOUBTFUL = ("<|", *map(chr, (0x85, 0xA0, 0x1680, 0x180E, *range(0x2000, 0x2010), *range(0x2028, 0x2030), *range(0x205F, 0x2070), 0x3000, 0xFEFF)))
_LETTER, _NUMBER, _OTHER, _BLANK, _ODD, _END = range(6)
_KIND = np.full(LATIN_END, _OTHER, np.uint8)
for _c in range(LATIN_END):
    _KIND[_c] = {"L": _LETTER, "N": _NUMBER}.get(unicodedata.category(chr(_c))[0], _OTHER)
_KIND[[9, 10, 11, 12, 13, 32]], _KIND[0x27], _KIND[0] = _BLANK, _ODD, _END
_INF = np.int32(1 << 30)
#: No id, and no pair of ids.
_NOTHING, _NONE = np.uint32(0xFFFE), np.uint32(0xFFFFFFFF)


def _ragged(values: np.ndarray, starts: np.ndarray, rows: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    """The values of these rows one after another, and where each row ends (from 0 on)."""
    first, n = starts[rows], starts[rows + 1] - starts[rows]
    ends = np.concatenate([[0], np.cumsum(n)])
    return values[np.arange(ends[-1]) + np.repeat(first - ends[:-1], n)], ends


def _byte_names() -> list[str]:
    """The character by which byte-level vocabularies name each byte: printable ones themselves, others from U+0100 on."""
    plain = {*range(0x21, 0x7F), *range(0xA1, 0xAD), *range(0xAE, 0x100)}
    names, moved = [], 0
    for b in range(256):
        names.append(chr(b if b in plain else 0x100 + moved))
        moved += b not in plain
    return names


class Merges:
    """The merges of a vocabulary of less than 65,534 ids, applied to many parts of words at once."""

    def __init__(self, model: dict):
        vocab, suffix = model["vocab"], model.get("end_of_word_suffix") or ""
        if max(vocab.values()) >= _NOTHING:
            raise ValueError("the vocabulary has too many ids")
        pairs = [tuple(m) if isinstance(m, list) else tuple(m.split(" ")) for m in model["merges"]]
        self.inner = np.array([vocab[c] for c in _byte_names()], np.uint32)
        self.last = np.array([vocab[c + suffix] for c in _byte_names()], np.uint32)
        ranked = {vocab[a] << 16 | vocab[b]: rank for rank, (a, b) in enumerate(pairs)}
        self.made = np.array([vocab[a + b] for a, b in pairs], np.uint32)
        self.bits = max(4, (len(ranked) * 4).bit_length())
        self.keys, self.ranks = np.full(1 << self.bits, _NONE, np.uint32), np.full(1 << self.bits, -1, np.int32)
        left, ranks = np.array(list(ranked), np.uint32), np.array(list(ranked.values()), np.int32)
        slot = self._slot(left)
        while len(left):
            free = np.flatnonzero(self.keys[slot] == _NONE)
            self.keys[slot[free]] = left[free]
            won = free[self.keys[slot[free]] == left[free]]
            self.ranks[slot[won]] = ranks[won]
            rest = np.ones(len(left), bool)
            rest[won] = False
            left, ranks, slot = left[rest], ranks[rest], (slot[rest] + 1) & ((1 << self.bits) - 1)
        # Orders of all pairs of bytes, the second one within a part or its last.
        one, two, zero = np.repeat(np.arange(256), 256), np.tile(np.arange(256), 256), np.zeros(1 << 16, np.int32)
        self.of_bytes = np.stack([self.order(self.inner[one], self.inner[two], zero), self.order(self.inner[one], self.last[two], zero)]).ravel()

    def _slot(self, key: np.ndarray) -> np.ndarray:
        return ((key * np.uint32(0x9E3779B1)) >> np.uint32(32 - self.bits)).astype(np.intp)

    def order(self, a: np.ndarray, b: np.ndarray, at: np.ndarray) -> np.ndarray:
        """rank * 32 + at of each pair, _INF of pairs that don't merge. Flat arrays."""
        key = a << np.uint32(16) | b
        slot = self._slot(key)
        there = self.keys.take(slot)
        other = there != key
        out = self.ranks.take(slot) * np.int32(32) + at
        out[other] = _INF
        open_ = np.flatnonzero(other & (there != _NONE))
        slot = slot[open_]
        while len(open_):
            slot = (slot + 1) & ((1 << self.bits) - 1)
            there = self.keys[slot]
            hit = there == key[open_]
            out[open_[hit]] = self.ranks[slot[hit]] * np.int32(32) + at[open_[hit]]
            more = ~hit & (there != _NONE)
            open_, slot = open_[more], slot[more]
        return out

    def __call__(self, data: np.ndarray, starts: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
        """(ids, where each part's ids start) of the parts data[starts[k] : starts[k + 1]]; parts of at most KEY bytes."""
        n = np.diff(starts)
        symbols = np.append(self.inner[data], np.full(KEY, _NOTHING))
        symbols[starts[1:] - 1] = self.last[data[starts[1:] - 1]]
        pair = np.zeros(len(symbols), np.int32)
        pair[: len(data) - 1] = data[:-1].astype(np.int32) << 8 | data[1:]
        pair[starts[1:][n > 1] - 2] += 1 << 16
        pairs = self.of_bytes.take(pair)
        length = n.copy()
        kept: list[tuple[np.ndarray, np.ndarray]] = []
        for low, width in zip((0, *WIDTHS), WIDTHS, strict=False):
            mine = np.flatnonzero((n > low) & (n <= width))
            for k in range(0, len(mine), PARTS_AT_ONCE):
                rows = mine[k : k + PARTS_AT_ONCE]
                at = np.arange(width, dtype=np.int32)[:, None]
                sym = np.where(at < n[rows], symbols[starts[rows] + at], _NOTHING)
                order = np.where(at[:-1] < n[rows] - 1, pairs[starts[rows] + at[:-1]] + at[:-1], _INF)
                kept += self._merge(rows, sym, order, length)
        ends = np.concatenate([[0], np.cumsum(length)])
        out = np.zeros(ends[-1], np.uint32)
        for rows, found in kept:
            for j in range(len(found)):
                there = np.flatnonzero(length[rows] > j)
                if not len(there):
                    break
                out[ends[rows[there]] + j] = found[j, there]
        return out, ends

    def _merge(self, rows: np.ndarray, sym: np.ndarray, order: np.ndarray, length: np.ndarray) -> Iterator[tuple[np.ndarray, np.ndarray]]:
        """Merges the columns of sym, the leftmost pair of least rank at a time, and counts down length. Yields finished ones."""
        at = np.arange(len(sym), dtype=np.int32)[:, None]
        while len(sym) > 1:
            best = order.min(axis=0)  # positions are below 32, so _INF may have moved by as much
            some = np.flatnonzero(best < _INF - 32)
            if len(some) < len(best):
                done = np.flatnonzero(best >= _INF - 32)
                yield rows[done], sym.take(done, axis=1)
                if not len(some):
                    return
                rows, best, sym, order = rows[some], best[some], sym.take(some, axis=1), order.take(some, axis=1)
            # Each column loses a symbol, so the arrays lose a row.
            column, p = np.arange(len(rows)), best & 31
            behind = at[: len(order)] > p
            sym = np.where(behind, sym[1:], sym[:-1])
            order = np.where(behind[:-1], order[1:] - np.int32(1), order[:-1])
            sym[p, column] = self.made[best >> 5]
            length[rows] -= 1
            right, left = np.flatnonzero(p < len(order)), np.flatnonzero(p > 0)
            column, p = np.concatenate([right, left]), np.concatenate([p[right], p[left] - 1])
            order[p, column] = self.order(sym[p, column], sym[p + 1, column], p)
        yield rows, sym


class Encoder:
    """Token ids of whole texts, equal to those of Tokenizer.encode(text, add_special_tokens=False).

    Pre-tokenizers of both kinds used here part words at white space, and letters, numbers and other marks within them;
    what stands on one side of such a place never changes the ids on the other. Words of plain Latin characters without
    apostrophes are merged here by the file's own merges. Other words go to the library one by one, and texts with
    unusual white space, zero bytes or "<|" (perhaps a special token) go there in pieces cut between two words.
    Bytes that are no UTF-8 count as U+FFFD.

    leading_space: a word's ids depend on the space before it (byte-level BPE); otherwise white space is dropped, letters
    are lower-cased and each digit stands alone.
    """

    def __init__(self, path: str, leading_space: bool):
        os.environ.setdefault("TOKENIZERS_PARALLELISM", "false")  # the tasks are the parallel part
        from tokenizers import Tokenizer

        self.tokenizer = Tokenizer.from_file(path)
        self.leading_space = leading_space
        with open(path, encoding="utf-8") as f:
            self.merges = Merges(json.load(f)["model"])
        self._reset()

    def _reset(self) -> None:
        #: One row a slot: the word's bytes as three numbers, and its number + 1.
        self.table = np.zeros((1 << SLOTS, 4), np.uint64)
        self.keys = np.zeros((0, 3), np.uint64)
        self.ids, self.starts, self.met = np.zeros(1 << 16, np.uint32), np.zeros(1, np.int64), np.zeros(0, np.int64)

    # ---- the table of words

    @staticmethod
    def _hash(keys: np.ndarray) -> np.ndarray:
        h = keys[:, 0] * _A + (keys[:, 1] + _C) * _B
        h = (h ^ (h >> np.uint64(29))) * _C + keys[:, 2] * _A
        return (h ^ (h >> np.uint64(32))) * _B

    def _lookup(self, keys: np.ndarray, h: np.ndarray) -> np.ndarray:
        """Number of each word, -1 if it isn't in the table."""
        slot = (h >> np.uint64(64 - SLOTS)).astype(np.int64)
        out = np.full(len(keys), -1, np.int64)
        todo = np.arange(len(keys))
        while len(todo):
            rows = self.table[slot]
            there = rows[:, 3] != 0
            hit = (rows[:, 0] == keys[:, 0]) & (rows[:, 1] == keys[:, 1]) & (rows[:, 2] == keys[:, 2]) & there
            out[todo[hit]] = rows[hit, 3].astype(np.int64) - 1
            more = there & ~hit
            todo, keys, slot = todo[more], keys[more], (slot[more] + 1) & ((1 << SLOTS) - 1)
        return out

    def _insert(self, first: int) -> None:
        """Puts the words from number ``first`` on into the table."""
        keys = self.keys[first:]
        todo, slot = np.arange(len(keys)), (self._hash(keys) >> np.uint64(64 - SLOTS)).astype(np.int64)
        while len(todo):
            free = self.table[slot, 3] == 0
            mine, place = todo[free], slot[free]
            self.table[place, 3] = (mine + first + 1).astype(np.uint64)
            won = self.table[place, 3] == (mine + first + 1).astype(np.uint64)
            self.table[place[won], :3] = keys[mine[won]]
            todo = np.concatenate([todo[~free], mine[~won]])
            slot = (np.concatenate([slot[~free], place[~won]]) + 1) & ((1 << SLOTS) - 1)

    def _forget(self) -> None:
        """Keeps the words met most often: half of what the table holds, at most, and of these only those met again."""
        n = min(len(self.met), WORDS // 2)
        least = max(2, int(np.partition(self.met, -n)[-n]) + 1)
        kept = np.flatnonzero(self.met >= least)
        keys, met = self.keys[kept], self.met[kept] // 2
        ids, starts = _ragged(self.ids, self.starts, kept)
        self._reset()
        self.keys, self.met, self.starts = keys, met, starts
        self._append_ids(ids, 0)
        self._insert(0)

    def _append_ids(self, ids: np.ndarray, end: int) -> None:
        if end + len(ids) > len(self.ids):
            self.ids = np.concatenate([self.ids[:end], np.zeros(max(len(self.ids), end + len(ids)), np.uint32)])
        self.ids[end : end + len(ids)] = ids

    # ---- words that aren't in it

    def _library(self, pieces: list[str]) -> list[np.ndarray]:
        return [np.array(e.ids, np.uint32) for e in self.tokenizer.encode_batch_fast(pieces, add_special_tokens=False)]

    def _learned(self, data: np.ndarray, starts: np.ndarray, n: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
        """(ids, where each word's ids start) of the words at these places of data."""
        flat, ends = _ragged(data, np.stack([starts, starts + n], 1).ravel(), np.arange(len(starts)) * 2)
        joined = np.zeros(len(flat) + len(n), np.uint8)
        joined[np.arange(len(flat)) + np.repeat(np.arange(len(n)), n)] = flat
        text = joined.tobytes().decode("utf-8", "replace")
        if not self.leading_space:
            text = text.lower()
        code = np.frombuffer(text.encode("utf-32-le", "surrogatepass"), "<u4")
        kind = np.full(len(code), _ODD, np.uint8)
        low = code < LATIN_END
        kind[low] = _KIND[code[low]]
        word = np.cumsum(kind == _END) - (kind == _END)
        odd = np.bincount(word[kind == _ODD], minlength=len(n)) > 0
        plain = ~odd[word] & (kind != _END)
        code, kind, word = code[plain], kind[plain], word[plain]
        cut = np.ones(len(code), bool)
        if len(code):
            same = word[1:] == word[:-1]
            together = same & (kind[1:] == kind[:-1])
            if self.leading_space:
                together |= same & (kind[:-1] == _BLANK)
            else:
                together &= kind[1:] != _NUMBER
            cut[1:] = ~together
        wide = code >= 0x80
        size = 1 + wide.astype(np.int64)
        at = np.concatenate([[0], np.cumsum(size)])
        octets = np.zeros(at[-1], np.uint8)
        octets[at[:-1]] = np.where(wide, 0xC0 | code >> 6, code)
        octets[at[:-1][wide] + 1] = 0x80 | code[wide] & 0x3F
        parts = np.flatnonzero(cut)
        part_starts = np.append(at[:-1][parts], at[-1])
        # A part that is too long takes its word to the library.
        large = np.diff(part_starts) > KEY
        if large.any():
            odd[word[parts[large]]] = True
            fits = ~odd[word[parts]]
            octets, part_starts = _ragged(octets, part_starts, np.flatnonzero(fits))
            parts = parts[fits]
        ids, id_starts = self.merges(octets, part_starts) if len(parts) else (np.zeros(0, np.uint32), np.zeros(1, np.int64))
        count = np.zeros(len(n), np.int64)
        np.add.at(count, word[parts], np.diff(id_starts))
        if not odd.any():
            return ids, np.concatenate([[0], np.cumsum(count)])
        rare = np.flatnonzero(odd)
        found = self._library([flat[ends[k] : ends[k + 1]].tobytes().decode("utf-8", "replace") for k in rare.tolist()])
        count[rare] = [len(x) for x in found]
        word_starts = np.concatenate([[0], np.cumsum(count)])
        out = np.zeros(word_starts[-1], np.uint32)
        is_rare = np.repeat(odd, count)
        out[~is_rare] = ids
        out[is_rare] = np.concatenate(found)
        return out, word_starts

    # ---- texts

    def _words(self, data: np.ndarray, begins: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
        """(start, length) of the words of texts that begin at these places of data."""
        space = _SPACE[data]
        first = np.zeros(len(data) + 1, bool)
        first[begins] = True
        before = np.empty(len(data), bool)  # white space stands before, in the same text
        before[1:] = space[:-1]
        before[first[:-1]] = False
        if not self.leading_space:
            start = np.flatnonzero(~space & (before | first[:-1]))
            over = np.flatnonzero((np.append(space[1:], True) | first[1:]) & ~space)
            return start, over - start + 1
        ahead = np.zeros(len(data), bool)  # something else than white space comes next, in the same text
        ahead[:-1] = ~space[1:] & ~first[1:-1]
        after_break = np.zeros(len(data), bool)
        after_break[1:] = before[1:] & (data[:-1] != 32)
        start = np.flatnonzero(first[:-1] | space & (~before | ahead) | ~space & after_break)
        return start, np.diff(np.append(start, len(data)))

    def _some(self, data: np.ndarray, begins: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
        """(ids, where each text's ids end) of texts that begin at these places of data."""
        start, n = self._words(data, begins)
        padded = np.concatenate([data, np.zeros(KEY + 8, np.uint8)])
        eight = np.ndarray((len(padded) - 7,), "<u8", padded.data, strides=(1,))
        keys = np.stack([eight[start + 8 * k] & _MASKS[np.clip(n - 8 * k, 0, 8)] for k in range(3)], axis=1)
        h = self._hash(keys)
        short = n <= KEY
        number = np.full(len(start), -1, np.int64)
        number[short] = self._lookup(keys[short], h[short])
        new, old = np.flatnonzero(number < 0), len(self.starts) - 1
        once = None
        if len(new):
            # Words of this chunk that are new: once each, long ones and those that only share a hash as often as they stand.
            single = short[new]
            _, first, inverse = np.unique(h[new[single]], return_index=True, return_inverse=True)
            of = new[single]
            same = (keys[of] == keys[of[first[inverse]]]).all(axis=1)
            once = np.concatenate([of[first], of[~same], new[~single]])
            place = np.empty(len(new), np.int64)
            place[np.flatnonzero(single)] = inverse
            place[np.flatnonzero(single)[~same]] = len(first) + np.arange(np.count_nonzero(~same))
            place[~single] = len(once) - np.count_nonzero(~single) + np.arange(np.count_nonzero(~single))
            number[new] = old + place
            ids, starts = self._learned(data, start[once], n[once])
            self._append_ids(ids, int(self.starts[-1]))
            self.starts = np.concatenate([self.starts, self.starts[-1] + starts[1:]])
        ids, ends = _ragged(self.ids, self.starts, number)
        cut = np.searchsorted(start, np.append(begins[1:], len(data)))
        if once is not None:
            known = int(len(first))  # the others aren't kept
            seen = np.bincount(number, minlength=old + len(once))[: old + known]
            self.starts = self.starts[: old + known + 1]
            self.keys = np.concatenate([self.keys, keys[once[:known]]])
        else:
            seen = np.bincount(number, minlength=old)
        seen[:old] += self.met
        self.met = seen
        if len(self.keys) > WORDS:
            self._forget()
        elif len(self.keys) > old:
            self._insert(old)
        return ids, ends[cut]

    def _doubtful(self, data: np.ndarray, begins: np.ndarray, ends: np.ndarray) -> np.ndarray:
        """Which texts have what may be a special token, or white space on which libraries differ."""
        at = np.flatnonzero(_DOUBT[data])
        if not len(at):
            return np.zeros(len(begins), bool)
        one = data[at]
        two = data[np.minimum(at + 1, len(data) - 1)]
        three = data[np.minimum(at + 2, len(data) - 1)]
        hit = one < 0x20
        for mark in (m.encode() for m in _DOUBTFUL if not hit.all()):
            hit |= (one == mark[0]) & (two == mark[1]) & ((three == mark[2]) if len(mark) > 2 else True)
        at = at[hit]
        return np.searchsorted(at, ends) > np.searchsorted(at, begins)

    def _whole(self, text: bytes) -> Iterator[np.ndarray]:
        """Ids by the library alone. Long texts are cut at spaces between two ASCII letters."""
        at = 0
        while at < len(text):
            end = min(len(text), at + AT_ONCE // 8)
            while end < len(text):
                if text[end] == 32 and chr(text[end - 1]).isascii() and chr(text[end - 1]).isalpha() and end + 1 < len(text) and chr(text[end + 1]).isascii() and chr(text[end + 1]).isalpha():
                    break
                end += 1
            yield from self._library([text[at:end].decode("utf-8", "replace")])
            at = end

    def __call__(self, texts: pa.Array | Iterable[str | None]) -> list[np.ndarray]:
        """One uint32 array a text; null counts as the empty text."""
        if not isinstance(texts, pa.Array):
            texts = pa.array([None if t is None else t.encode("utf-8", "replace") for t in texts], pa.binary())
        if pa.types.is_large_string(texts.type) or pa.types.is_large_binary(texts.type):
            texts = texts.cast(pa.binary())
        if texts.null_count:
            texts = texts.cast(pa.binary()).fill_null(b"")
        n = len(texts)
        out: list[np.ndarray] = [np.zeros(0, np.uint32)] * n
        if not n or texts.buffers()[2] is None:
            return out
        offsets = np.frombuffer(texts.buffers()[1], np.int32, n + 1, texts.offset * 4).astype(np.int64)
        data = np.frombuffer(texts.buffers()[2], np.uint8)
        k = 0
        while k < n:
            end = max(k + 1, int(np.searchsorted(offsets, offsets[k] + AT_ONCE, side="right")) - 1)
            self._run(data[offsets[k] : offsets[end]], offsets[k : end + 1] - offsets[k], out, k)
            k = end
        return out

    def _run(self, data: np.ndarray, offsets: np.ndarray, out: list[np.ndarray], first: int) -> None:
        """Encodes texts that stand one after another in data; one text alone may be long."""
        begins, ends = offsets[:-1], offsets[1:]
        doubt = self._doubtful(data, begins, ends)
        for k in np.flatnonzero(doubt).tolist():
            out[first + k] = np.concatenate([np.zeros(0, np.uint32), *self._whole(data[begins[k] : ends[k]].tobytes())])
        rows = np.flatnonzero(~doubt & (ends > begins))
        if not len(rows):
            return
        if doubt.any():
            data, offsets = _ragged(data, offsets, rows)
        else:
            offsets = np.append(begins[rows], ends[rows[-1]])
        if len(rows) > 1 or len(data) <= 2 * AT_ONCE:
            ids, cut = self._some(data, offsets[:-1])
            for k, a, b in zip(rows.tolist(), [0, *cut[:-1].tolist()], cut.tolist(), strict=True):
                out[first + k] = ids[a:b]
            return
        some, at = [], 0
        while at < len(data):
            end = min(len(data), at + AT_ONCE)
            # a space between two other characters
            while end < len(data) - 1 and not (data[end] == 32 and not _SPACE[data[end - 1]] and not _SPACE[data[end + 1]]):
                end += 1
            end = len(data) if end >= len(data) - 1 else end
            some.append(self._some(data[at:end], np.zeros(1, np.int64))[0])
            at = end
        out[first + int(rows[0])] = np.concatenate(some)


_encoders: dict[tuple[str, bool], Encoder] = {}


def encoder(path: str, leading_space: bool) -> Encoder:
    """The worker's encoder for that file; made once a process."""
    key = path, leading_space
    if key not in _encoders:
        _encoders[key] = Encoder(path, leading_space)
    return _encoders[key]
