"""LZFSE streams, from the published format: every block kind is read, two are written.

A stream is a row of blocks, each with a four-byte magic: ``bvx-`` plain bytes,
``bvxn`` byte-wise LZ (LZVN), ``bvx1`` and ``bvx2`` LZ with finite-state entropy
codes, and ``bvx$`` at the end.  Writing uses an LZVN block, or a plain one where
that isn't smaller; any reader of the format takes both.
"""

from __future__ import annotations

import struct

#: Fixed values of the format: states and extra bits of literal runs, matches and distances.
STATES = {"l": 64, "m": 64, "d": 256, "literal": 1024}
L_EXTRA = [0] * 16 + [2, 3, 5, 8]
M_EXTRA = [0] * 16 + [3, 5, 8, 11]
D_EXTRA = [k // 4 for k in range(64)]
SYMBOLS = (20, 20, 64, 256)
#: Lengths and values of the prefix code of frequencies, by five bits; -1 marks codes with a value of their own.
FREQUENCY_BITS = [2, 3, 2, 5, 2, 3, 2, 8, 2, 3, 2, 5, 2, 3, 2, 14] * 2
FREQUENCY_VALUES = [0, 2, 1, 4, 0, 3, 1, -1, 0, 2, 1, 5, 0, 3, 1, -1, 0, 2, 1, 6, 0, 3, 1, -1, 0, 2, 1, 7, 0, 3, 1, -1]
_MAX_DISTANCE, _HASHED = 65535, 4


class LzfseError(ValueError):
    """Bytes that are no valid stream."""


def decompress(data: bytes) -> bytes:
    """The content of a stream; an empty one is empty."""
    out, at = bytearray(), 0
    while data:
        magic = data[at : at + 4]
        if magic == b"bvx$":
            break
        try:
            if magic == b"bvx-":
                size = struct.unpack_from("<I", data, at + 4)[0]
                part = data[at + 8 : at + 8 + size]
                if len(part) < size:
                    raise LzfseError("a plain block is cut")
                out += part
                at += 8 + size
            elif magic == b"bvxn":
                size, payload = struct.unpack_from("<II", data, at + 4)
                _lzvn(data[at + 12 : at + 12 + payload], size, out)
                at += 12 + payload
            elif magic in (b"bvx1", b"bvx2"):
                at = _entropy_block(data, at, out)
            else:
                raise LzfseError("no block begins here")
        except (struct.error, IndexError) as e:
            raise LzfseError("a block is cut") from e
    return bytes(out)


def _copy(out: bytearray, distance: int, size: int, first: int) -> None:
    """Repeats what stands ``distance`` bytes before the end, which may overlap what it writes."""
    if not 0 < distance <= len(out) - first:
        raise LzfseError("a match begins before the content")
    part = out[len(out) - distance : len(out) - distance + size]
    out += part if size <= distance else (part * (size // distance + 1))[:size]


# LZVN.


def _lzvn(code: bytes, size: int, out: bytearray) -> None:
    """Appends ``size`` bytes; matches may reach back into earlier blocks."""
    want, at, distance = len(out) + size, 0, 0
    while True:
        op = code[at]
        literals = matched = 0
        if op == 0x06:
            break
        if op in (0x0E, 0x16):
            at += 1
            continue
        if op >= 0xF0:  # a match at the last distance
            matched, at = (op & 15, at + 1) if op & 15 else (code[at + 1] + 16, at + 2)
        elif op >= 0xE0:  # literals only
            literals, at = (op & 15, at + 1) if op & 15 else (code[at + 1] + 16, at + 2)
        elif 0xA0 <= op < 0xC0:  # 14 bits of distance
            literals, low = op >> 3 & 3, code[at + 1] | code[at + 2] << 8
            matched, distance, at = ((op & 7) << 2 | low & 3) + 3, low >> 2, at + 3
        elif 0x70 <= op < 0x80 or 0xD0 <= op < 0xE0 or (op & 7 == 6 and op < 0x40):
            raise LzfseError("an undefined LZVN code")
        elif op & 7 == 7:  # 16 bits of distance
            literals, matched, distance, at = op >> 6, (op >> 3 & 7) + 3, code[at + 1] | code[at + 2] << 8, at + 3
        elif op & 7 == 6:  # the last distance
            literals, matched, at = op >> 6, (op >> 3 & 7) + 3, at + 1
        else:  # 11 bits of distance
            literals, matched, distance, at = op >> 6, (op >> 3 & 7) + 3, (op & 7) << 8 | code[at + 1], at + 2
        if at + literals > len(code):
            raise LzfseError("literals are cut")
        out += code[at : at + literals]
        at += literals
        if matched:
            _copy(out, distance, matched, 0)
    if len(out) != want:
        raise LzfseError("an LZVN block has another size than it says")


def _literals(code: bytearray, data: bytes) -> None:
    """Opcodes for literals alone, 271 at most each."""
    for at in range(0, len(data), 271):
        part = data[at : at + 271]
        code += bytes([0xE0 | len(part)]) if len(part) < 16 else bytes([0xE0, len(part) - 16])
        code += part


def _match(code: bytearray, literals: bytes, distance: int, size: int, last: int) -> None:
    """Opcodes for up to three literals and a match."""
    n = len(literals)
    first = min(size, 10 - 2 * n)  # the codes of longer ones mean something else
    if distance == last and n == 0:
        first = 0
    elif distance == last:
        code += bytes([n << 6 | (first - 3) << 3 | 6]) + literals
    elif distance < 0x600:
        code += bytes([n << 6 | (first - 3) << 3 | distance >> 8, distance & 255]) + literals
    elif distance < 1 << 14:
        first = min(size, 34)
        code += bytes([0xA0 | n << 3 | first - 3 >> 2]) + struct.pack("<H", distance << 2 | first - 3 & 3) + literals
    else:
        code += bytes([n << 6 | (first - 3) << 3 | 7]) + struct.pack("<H", distance) + literals
    size -= first
    while size:
        part = min(size, 271)
        code += bytes([0xF0 | part]) if part < 16 else bytes([0xF0, part - 16])
        size -= part


def compress(data: bytes) -> bytes:
    """A stream of one block, by greedy matching of the last place with the same four bytes."""
    if not data:
        return b"bvx$"
    code, seen = bytearray(), {}
    at = start = last = 0
    while at + _HASHED <= len(data):
        key = data[at : at + _HASHED]
        place = seen.get(key)
        seen[key] = at
        if place is None or at - place > _MAX_DISTANCE:
            at += 1
            continue
        size, most = _HASHED, len(data) - at
        while size < most:  # by stretches, so that long matches are cheap
            step = min(64, most - size)
            if data[place + size : place + size + step] == data[at + size : at + size + step]:
                size += step
            elif step == 1:
                break
            else:
                while data[place + size] == data[at + size]:
                    size += 1
                break
        literals = data[start:at]
        whole = len(literals) - min(3, len(literals))
        _literals(code, literals[:whole])
        _match(code, literals[whole:], at - place, size, last)
        last, at = at - place, at + size
        start = at
    _literals(code, data[start:])
    code += b"\x06" + bytes(7)
    if len(code) + 4 < len(data):
        return b"bvxn" + struct.pack("<II", len(data), len(code)) + bytes(code) + b"bvx$"
    return b"bvx-" + struct.pack("<I", len(data)) + data + b"bvx$"


# Entropy-coded blocks.


class _Bits:
    """Bits of a payload, read from its end."""

    def __init__(self, payload: bytes, spare: int):
        self.left = 8 * len(payload) + spare  # spare: 0 to -7
        self.payload = payload

    def pull(self, n: int) -> int:
        if n == 0:
            return 0
        self.left -= n
        if self.left < 0:
            raise LzfseError("a payload is cut")
        first, last = self.left >> 3, (self.left + n + 7) >> 3
        return int.from_bytes(self.payload[first:last], "little") >> (self.left & 7) & ((1 << n) - 1)


def decoder_table(frequencies: list[int], states: int) -> list[tuple[int, int, int]]:
    """(symbol, bits to read, next state without them) of each state."""
    out = []
    for symbol, f in enumerate(frequencies):
        if not f:
            continue
        bits = states.bit_length() - f.bit_length()
        wide = (2 * states >> bits) - f
        for k in range(f):
            out.append((symbol, bits, (f + k << bits) - states) if k < wide else (symbol, bits - 1, k - wide << bits - 1))
    if sum(frequencies) > states:
        raise LzfseError("frequencies add up to more than the states")
    return out


def _bases(extra: list[int], first: int = 0) -> list[int]:
    out = []
    for bits in extra:
        out.append(first)
        first += 1 << bits
    return out


L_BASE, M_BASE, D_BASE = _bases(L_EXTRA), _bases(M_EXTRA), _bases(D_EXTRA)


def _frequencies(raw: bytes) -> list[list[int]]:
    bits, at = int.from_bytes(raw, "little"), 0
    out = []
    for n in SYMBOLS:
        part = []
        for _ in range(n):
            low = bits >> at & 31
            size, value = FREQUENCY_BITS[low], FREQUENCY_VALUES[low]
            if value < 0:
                value = 8 + (bits >> at + 4 & 15) if size == 8 else 24 + (bits >> at + 4 & 1023)
            part.append(value if raw else 0)
            at += size if raw else 0
        out.append(part)
    if at > 8 * len(raw):
        raise LzfseError("frequencies are cut")
    return out


def _entropy_block(data: bytes, at: int, out: bytearray) -> int:
    size = struct.unpack_from("<I", data, at + 4)[0]
    if data[at : at + 4] == b"bvx2":
        a, b, c = struct.unpack_from("<3Q", data, at + 8)
        field = lambda v, first, n: v >> first & ((1 << n) - 1)
        n_literals, literal_bytes, n_matches, literal_bits = field(a, 0, 20), field(a, 20, 20), field(a, 40, 20), field(a, 60, 3) - 7
        literal_states, lmd_bytes, lmd_bits = [field(b, 10 * k, 10) for k in range(4)], field(b, 40, 20), field(b, 60, 3) - 7
        header, states = field(c, 0, 32), [field(c, 32 + 10 * k, 10) for k in range(3)]
        frequencies = _frequencies(data[at + 32 : at + header])
    else:
        _, n_literals, n_matches, literal_bytes, lmd_bytes = struct.unpack_from("<5I", data, at + 8)
        literal_bits, *literal_states = struct.unpack_from("<i4H", data, at + 28)
        lmd_bits, *states = struct.unpack_from("<i3H", data, at + 40)
        flat, frequencies, header = list(struct.unpack_from("<360H", data, at + 50)), [], 772
        for n in SYMBOLS:
            frequencies.append(flat[:n])
            flat = flat[n:]
    begin = at + header
    end = begin + literal_bytes + lmd_bytes
    if end > len(data):
        raise LzfseError("a payload is cut")
    tables = [decoder_table(f, STATES[k]) for f, k in zip(frequencies, ("l", "m", "d", "literal"), strict=True)]

    bits, literals = _Bits(data[begin : begin + literal_bytes], literal_bits), bytearray()
    for _ in range(n_literals // 4):
        for k in range(4):
            symbol, n, base = tables[3][literal_states[k]]
            literal_states[k] = base + bits.pull(n)
            literals.append(symbol)

    bits, used, distance, want = _Bits(data[begin + literal_bytes : end], lmd_bits), 0, -1, len(out) + size
    kinds = ((L_BASE, L_EXTRA), (M_BASE, M_EXTRA), (D_BASE, D_EXTRA))
    for _ in range(n_matches):
        values = []
        for k, (base_of, extra_of) in enumerate(kinds):
            symbol, n, base = tables[k][states[k]]
            both = bits.pull(n + extra_of[symbol])
            states[k] = base + (both >> extra_of[symbol])
            values.append(base_of[symbol] + (both & (1 << extra_of[symbol]) - 1))
        run, matched, fresh = values
        distance = fresh or distance
        out += literals[used : used + run]
        used += run
        if matched:
            _copy(out, distance, matched, 0)
    if len(out) != want or used > len(literals):
        raise LzfseError("a block has another size than it says")
    return end
