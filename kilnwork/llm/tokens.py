"""Exact token ids with a bounded cache of parts.

A text is cut where the tokenizer's own pre-tokenizer always ends a token, the
parts are looked up in a bounded cache, and those that are new go to the
tokenizers library.  The ids of a text are those of its parts in order, as
unsigned little-endian 32-bit integers.

Blocks of an Arrow column are cut by numpy passes over their bytes.  A part of up
to KEY_BYTES bytes is its own key, three 64-bit numbers and a length; keys are
compared in full, so no two parts are ever taken for each other.  Longer parts,
and stretches between blanks that hold an apostrophe or anything beyond ASCII and
Latin-1 letters, are cut by regular expressions and looked up as strings.

Where cuts are safe:
- "words": white space is dropped and no token spans it, so every blank or line
  end cuts.  Letters are lowered before the look-up, as the normalizer does.
- "spaced": the byte-level pattern never joins a character that is not white
  space to white space after it, so a run of white space opens a part.
- "whole": anything else; the whole text is one part.
The first two also end a token between a letter and a digit or sign other than
the apostrophe.  In a text of ASCII and Latin-1 letters without an apostrophe
that is every change between letters and others; in any other text only changes
between ASCII letters and ASCII signs count.  A text that may hold a special
token (which is told by ``<|``) is one part.

A part that is one pre-token goes to the library's model directly, in the byte
alphabet of byte-level vocabularies; any other part takes the whole tokenizer.
"""

from __future__ import annotations

import json
import os
import re
from itertools import chain

import numpy as np
import pyarrow as pa

from kilnwork.llm.textblocks import blocks, mix64, text_buffer

#: Past one of these (parts, their ids, bytes of long ones), a worker's cache keeps only the short parts that were used most
#: when the next block begins, up to half of each.
CACHE_PARTS, CACHE_IDS, CACHE_BYTES = 500_000, 2_000_000, 8_000_000
KEY_BYTES = 24
_SLOT_BITS = 21
#: White space of Unicode, as the tokenizers' patterns have it (fixed values).
WHITE = "\\x09-\\x0D\\x20\\x85\\xA0\\u1680\\u2000-\\u200A\\u2028\\u2029\\u202F\\u205F\\u3000"
#: ASCII digits and signs without the apostrophe (fixed values).
SIGNS = "!-&(-@\\[-`{-~"
_LOWER = bytes(b + 32 if 65 <= b <= 90 else b for b in range(256))


def _pattern(white: str, lead: str) -> re.Pattern:
    """Parts: up to white space, or to a change between ASCII letters and signs."""
    stop = f"(?=[{white}]|\\Z)"
    letters = f"[A-Za-z]+(?:{stop}|(?=[{SIGNS}]))"
    signs = f"[{SIGNS}]+(?:{stop}|(?=[A-Za-z]))"
    inner = f"(?:[A-Za-z](?![{SIGNS}])|[{SIGNS}](?![A-Za-z])|[^{white}A-Za-z{SIGNS}])"
    return re.compile(f"{lead}(?:{letters}|{signs}|{inner}+[^{white}]?|[^{white}])" + (f"|[{white}]+" if lead else ""))


_PATTERNS = {"words": _pattern(" \\n", ""), "spaced": _pattern(WHITE, f"[{WHITE}]*")}
#: Letters of ASCII and Latin-1, and ASCII white space (fixed values).
_LETTERS, _BLANKS = "A-Za-z\\xC0-\\xD6\\xD8-\\xF6\\xF8-\\xFF", "\\x09-\\x0D\\x20"
_UNUSUAL = re.compile(f"[^\\x00-&(-~{_LETTERS}]").search
_USUAL = {"words": re.compile(f"[{_LETTERS}]+|[^{_BLANKS}{_LETTERS}]+"), "spaced": re.compile(f"[{_BLANKS}]*(?:[{_LETTERS}]+|[^{_BLANKS}{_LETTERS}]+)|[{_BLANKS}]+")}
_ONE = {"words": re.compile("[a-z\\xDF-\\xF6\\xF8-\\xFF]+|[!-&(-/:-@\\[-`{-~]+|[0-9]").fullmatch, "spaced": re.compile(f" ?(?:[{_LETTERS}]+|[!-&(-/:-@\\[-`{{-~]+|[0-9]+)").fullmatch}
#: The byte alphabet: printable bytes stand for themselves, the others for the characters from 256 on, in order.
_PRINTABLE = {*range(33, 127), *range(161, 173), *range(174, 256)}
_ALPHABET = {b: b if b in _PRINTABLE else 256 + sum(x not in _PRINTABLE for x in range(b)) for b in range(256)}


def chunking(path: str) -> str:
    with open(path, encoding="utf-8") as f:
        spec = json.load(f)
    pre = spec.get("pre_tokenizer") or {}
    if spec.get("normalizer") is None and pre.get("type") == "ByteLevel" and pre.get("use_regex") and not pre.get("add_prefix_space"):
        return "spaced"
    normal = (spec.get("normalizer") or {}).get("normalizers", [])
    drops = {"type": "Replace", "pattern": {"Regex": "\\s+"}, "content": " "} in normal
    local = all(x.get("type") in ("NFC", "Replace", "Lowercase") for x in normal)
    first = (pre.get("pretokenizers") or [{}])[0]
    if drops and local and first.get("type") == "Split" and first.get("behavior") == "Removed" and first.get("invert"):
        return "words"
    return "whole"
#: Kinds of bytes: 0 blank, 1 letter (all beyond ASCII, as Latin-1 letters are), 2 other; and bytes of odd characters.
_KIND = np.array([0 if b in (9, 10, 11, 12, 13, 32) else 1 if b >= 128 or chr(b).isalpha() else 2 for b in range(256)], np.uint8)
_ODD = np.array([b in (0x27, 0x7F) or (b >= 0xC0 and b != 0xC3) for b in range(256)])
_LOWER_TABLE = np.frombuffer(_LOWER, np.uint8)
#: The lowest bytes of a 64-bit number.
_MASK = np.array([(1 << 8 * n) - 1 for n in range(9)], np.uint64)


class Encoder:
    def __init__(self, path: str):
        os.environ["TOKENIZERS_PARALLELISM"] = "false"  # one core a task
        from tokenizers import Tokenizer

        self._tokenizer = Tokenizer.from_file(path)
        self._model = self._tokenizer.model
        self._how = chunking(path)
        self._empty()

    def _empty(self) -> None:
        """Forgets all parts.  Entry 0 is no part's."""
        self._known: dict[bytes, int] = {}  # entries of long parts and stretches
        self._bytes = 0
        self._slots = np.zeros(1 << _SLOT_BITS, np.int32)
        self._keys = np.zeros((1024, 3), np.uint64)
        self._sizes = np.zeros(1024, np.uint8)  # bytes of each short part, 0 for any other
        self._at = np.zeros(1024, np.int32)  # its first id in the store
        self._count = np.zeros(1024, np.int32)
        self._uses = np.zeros(1024, np.int32)
        self._store = np.zeros(4096, np.uint32)
        self._entries, self._stored = 1, 0

    def _shrink(self) -> None:
        """Keeps the short parts that were used most, and at least twice; their counts begin anew."""
        n = self._entries
        best = np.argsort(-self._uses[:n], kind="stable")[: CACHE_PARTS // 2]
        best = best[(self._uses[best] > 1) & (self._sizes[best] > 0)]
        best = best[np.cumsum(self._count[best]) <= CACHE_IDS // 2]
        keys, sizes, at, count = self._keys[best], self._sizes[best], self._at[best], self._count[best]
        store = self._store
        self._empty()
        ends = np.cumsum(count, dtype=np.int64)
        total = int(ends[-1]) if len(ends) else 0
        self._room(len(best), total)
        self._store[:total] = store[np.repeat(at - (ends - count), count) + np.arange(total)]
        new = slice(1, 1 + len(best))
        self._keys[new], self._sizes[new], self._at[new], self._count[new] = keys, sizes, ends - count, count
        self._entries, self._stored = 1 + len(best), total
        one, two = _places(keys.T, sizes.astype(np.uint64))
        self._slots[two] = self._slots[one] = np.arange(1, 1 + len(best))

    def _room(self, entries: int, ids: int) -> None:
        """Makes room for more entries and ids."""
        while self._entries + entries > len(self._at):
            for name in ("_keys", "_sizes", "_at", "_count", "_uses"):
                old = getattr(self, name)
                setattr(self, name, np.concatenate([old, np.zeros_like(old)]))
        while self._stored + ids > len(self._store):
            self._store = np.concatenate([self._store, np.zeros_like(self._store)])

    def _cuts(self, text: str) -> list[str]:
        """Parts of any text, by regular expressions."""
        if self._how == "whole" or "<|" in text:
            return [text]
        if _UNUSUAL(text):
            if self._how == "words":
                text = text.encode("utf-8", "surrogatepass").translate(_LOWER).decode("utf-8", "surrogatepass")
            return _PATTERNS[self._how].findall(text)
        return _USUAL[self._how].findall(text.lower() if self._how == "words" else text)

    def _ids(self, part: str) -> list[int]:
        if self._how != "whole" and "<|" not in part and _ONE[self._how](part):
            return [t.id for t in self._model.tokenize(part.encode().decode("latin-1").translate(_ALPHABET))]
        return self._tokenizer.encode(part, add_special_tokens=False).ids

    def _long(self, raw: bytes, plain: bool) -> int:
        """The entry of a long part (plain), or of a stretch that has to be cut first."""
        found = self._known.get(raw)
        if found is None:
            text = raw.decode("utf-8", "replace")
            found = self._known[raw] = self._entries
            self._add([self._ids(text) if plain else [x for part in self._cuts(text) for x in self._ids(part)]])
            self._bytes += len(raw)
        return found

    def _add(self, ids: list[list[int]]) -> np.ndarray:
        """New entries with these ids."""
        counts = np.fromiter(map(len, ids), np.int64, len(ids))
        total = int(counts.sum())
        self._room(len(ids), total)
        new = np.arange(self._entries, self._entries + len(ids))
        self._store[self._stored : self._stored + total] = np.fromiter(chain.from_iterable(ids), np.uint32, total)
        self._at[new], self._count[new] = self._stored + np.cumsum(counts) - counts, counts
        self._entries, self._stored = self._entries + len(ids), self._stored + total
        return new

    def _units(self, data: np.ndarray, rows: np.ndarray) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
        """Begin and end of what is looked up, in order, and whether it is a part."""
        kind = _KIND[data]
        solid = kind > 0
        first, last = solid.copy(), solid.copy()
        change = kind[1:] != kind[:-1]
        first[1:] &= change
        last[:-1] &= change
        inner = rows[(rows > 0) & (rows < len(data))]
        first[inner], last[inner - 1] = solid[inner], solid[inner - 1]
        begin, end = np.flatnonzero(first), np.flatnonzero(last) + 1
        odd = _ODD[data]
        high = data >= 0x80
        if high.any():
            after = np.zeros(len(data), bool)
            after[1:] = data[:-1] == 0xC3
            odd |= ((data & 0xC0) == 0x80) & (~after | (data == 0x97) | (data == 0xB7))
        if self._how == "spaced":
            # Parts take the blanks in front of them; blanks at a text's end are a part.
            border = np.zeros(len(data) + 1, bool)
            border[end] = True
            border[rows] = True
            border = np.flatnonzero(border)
            begin, end = border[:-1], border[1:]
        plain = np.ones(len(begin), bool)
        marks = np.flatnonzero((data[:-1] == ord("<")) & (data[1:] == ord("|")))
        if not len(marks) and not odd.any():
            return begin, end, plain
        return self._merged(data, rows, begin, end, solid, odd, marks)

    def _merged(self, data: np.ndarray, rows: np.ndarray, begin: np.ndarray, end: np.ndarray, solid: np.ndarray, odd: np.ndarray, marks: np.ndarray) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
        """As _units, where stretches with odd characters, and texts that may hold special tokens, are one unit each."""
        head, tail = solid.copy(), solid.copy()
        head[1:] &= ~solid[:-1]
        tail[:-1] &= ~solid[1:]
        inner = rows[(rows > 0) & (rows < len(data))]
        head[inner], tail[inner - 1] = solid[inner], solid[inner - 1]
        low, high = np.flatnonzero(head), np.flatnonzero(tail) + 1  # stretches between blanks
        row = np.searchsorted(rows, low, side="right") - 1
        total = np.concatenate([[0], np.cumsum(odd)])
        strange = total[high] > total[low]
        special = np.isin(row, np.searchsorted(rows, marks, side="right") - 1)
        # What follows a strange stretch that may end in white space of Unicode belongs to it.
        joined = np.zeros(len(low), bool)
        joined[:-1] = (row[1:] == row[:-1]) & (special[:-1] | (strange[:-1] & (data[high[:-1] - 1] >= 0x80)))
        strange |= special
        strange[1:] |= joined[:-1]
        at = np.flatnonzero(strange)
        opens = at[(at == 0) | ~joined[at - 1]]
        closes = at[~joined[at]]
        if self._how == "spaced":
            before = np.where((opens > 0) & (row[np.maximum(opens, 1) - 1] == row[opens]), high[np.maximum(opens, 1) - 1], rows[row[opens]])
            final = np.ones(len(low), bool)
            final[:-1] = row[1:] != row[:-1]
            loose = final[closes] & (special[closes] | (data[high[closes] - 1] >= 0x80))
            after = np.where(loose, rows[row[closes] + 1], high[closes])
        else:
            before, after = low[opens], high[closes]
            before = np.where(special[opens], rows[row[opens]], before)
            after = np.where(special[closes], rows[row[closes] + 1], after)
        place = np.searchsorted(before, begin, side="right") - 1
        outside = (place < 0) | (begin >= after[np.maximum(place, 0)]) if len(before) else np.ones(len(begin), bool)
        begins = np.concatenate([begin[outside], before])
        order = np.argsort(begins, kind="stable")
        plain = np.concatenate([np.ones(int(outside.sum()), bool), np.zeros(len(before), bool)])
        return begins[order], np.concatenate([end[outside], after])[order], plain[order]

    def _lookup(self, data: np.ndarray, cased: np.ndarray, begin: np.ndarray, end: np.ndarray, plain: np.ndarray) -> np.ndarray:
        """The entry of each unit; new parts are learned.  Stretches that are to be cut keep their case."""
        size = end - begin
        out = np.zeros(len(begin), np.int64)
        short = plain & (size <= KEY_BYTES)
        for k in np.flatnonzero(~short).tolist():
            out[k] = self._long((data if plain[k] else cased)[begin[k] : end[k]].tobytes(), bool(plain[k]))
        at = np.flatnonzero(short)
        start, size = begin[at], size[at]
        padded = np.concatenate([data, np.zeros(KEY_BYTES, np.uint8)])
        eight = np.lib.stride_tricks.as_strided(padded[:8].view(np.uint64), (len(padded) - 7,), (1,))
        keys = [eight[start] & _MASK[np.minimum(size, 8)]]
        for k in (8, 16):
            part = np.zeros(len(start), np.uint64)
            longer = np.flatnonzero(size > k)
            part[longer] = eight[start[longer] + k] & _MASK[np.minimum(size[longer] - k, 8)]
            keys.append(part)
        one, two = _places(keys, size.astype(np.uint64))
        open_ = np.arange(len(at))
        while True:
            for place in (one, two):
                entry = self._slots[place[open_]]
                same = self._sizes[entry] == size[open_]
                for k in range(3):
                    same &= self._keys[entry, k] == keys[k][open_]
                out[at[open_[same]]] = entry[same]
                open_ = open_[~same]
            if not len(open_):
                return out
            _, new = np.unique(one[open_], return_index=True)
            new = open_[new]
            entries = self._add([self._ids(data[a:b].tobytes().decode("utf-8", "replace")) for a, b in zip(start[new].tolist(), (start + size)[new].tolist(), strict=True)])
            self._sizes[entries] = size[new]
            for k in range(3):
                self._keys[entries, k] = keys[k][new]
            # The second place if the first is another's.
            self._slots[np.where(self._slots[one[new]] == 0, one[new], two[new])] = entries

    def column(self, texts: pa.Array, end_id: int | None = None) -> tuple[np.ndarray, np.ndarray]:
        """Ids of each whole text of a column, null counting as empty, and where each text's ids begin (and the end)."""
        raw, offsets = text_buffer(texts)
        found, sizes = [], [np.zeros(1, np.int64)]
        for a, b in blocks(texts):
            ids, counts = self._block(raw[offsets[a] : offsets[b]], offsets[a : b + 1] - offsets[a], end_id)
            found.append(ids)
            sizes.append(counts)
        return np.concatenate(found) if found else np.empty(0, np.uint32), np.cumsum(np.concatenate(sizes))

    def _block(self, data: np.ndarray, rows: np.ndarray, end_id: int | None) -> tuple[np.ndarray, np.ndarray]:
        if self._entries > CACHE_PARTS or self._stored > CACHE_IDS or self._bytes > CACHE_BYTES:
            self._shrink()
        if not len(data):
            begin = end = np.empty(0, np.int64)
            plain = np.empty(0, bool)
        elif self._how == "whole":
            filled = np.diff(rows) > 0
            begin, end = rows[:-1][filled], rows[1:][filled]
            plain = np.zeros(len(begin), bool)
        else:
            begin, end, plain = self._units(data, rows)
        entry = self._lookup(_lowered(data) if self._how == "words" else data, data, begin, end, plain) if len(begin) else np.empty(0, np.int64)
        used = np.bincount(entry)
        self._uses[: len(used)] += used
        counts = self._count[entry]
        ends = np.cumsum(counts)
        total = int(ends[-1]) if len(ends) else 0
        ids = self._store[np.repeat(self._at[entry] - (ends - counts), counts) + np.arange(total)]
        starts = np.concatenate([[0], ends])[np.searchsorted(begin, rows)]
        sizes = np.diff(starts)
        if end_id is None:
            return ids, sizes
        out = np.full(total + len(sizes), end_id, np.uint32)
        out[np.arange(total) + np.repeat(np.arange(len(sizes)), sizes)] = ids
        return out, sizes + 1

    def encode(self, texts: list[str | None]) -> list[bytes]:
        """The ids of each whole text, as little-endian 32-bit numbers."""
        ids, at = self.column(pa.array(texts, pa.string()))
        return [ids[a:b].astype("<u4").tobytes() for a, b in zip(at[:-1].tolist(), at[1:].tolist(), strict=True)]


def _places(keys: list[np.ndarray] | np.ndarray, sizes: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    """The two slots of each key."""
    mixed = mix64(mix64(keys[0] + sizes) ^ (keys[1] * np.uint64(0x9E3779B97F4A7C15) + keys[2]))
    low = mixed & np.uint64((1 << _SLOT_BITS) - 1)
    return (mixed >> np.uint64(64 - _SLOT_BITS)).astype(np.int64), low.astype(np.int64)


def _lowered(data: np.ndarray) -> np.ndarray:
    """Letters of ASCII and, after their lead byte, of Latin-1 in lower case."""
    out = _LOWER_TABLE[data]
    after = np.flatnonzero(data[:-1] == 0xC3) + 1
    capital = after[(data[after] >= 0x80) & (data[after] <= 0x9E) & (data[after] != 0x97)]
    out[capital] += 0x20
    return out


_encoders: dict[str, Encoder] = {}


def encoder(path: str) -> Encoder:
    """One encoder for each file and worker."""
    if path not in _encoders:
        _encoders[path] = Encoder(path)
    return _encoders[path]
