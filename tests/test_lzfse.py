"""LZFSE: round trips of what is written, hand-made blocks of every kind, and broken streams."""

from __future__ import annotations

import random
import struct

import pytest

from kilnwork.sources import lzfse


@pytest.mark.parametrize("seed", range(12))
def test_round_trips(seed):
    rng = random.Random(seed)
    for size in (0, 1, 2, 3, 4, 5, 300, 5000, 100_000):
        data = bytes(k % 7 for k in range(size)) if seed == 0 else bytes(rng.choice(b"ab") if rng.random() < seed / 12 else rng.randrange(256) for _ in range(size))
        stream = lzfse.compress(data)
        assert lzfse.decompress(stream) == data and stream.endswith(b"bvx$") and len(stream) <= len(data) + 12
    assert lzfse.compress(b"abcd" * 1000).startswith(b"bvxn")


def test_lzvn_codes():
    """Every kind of code, with distances as the format counts them."""
    code = b"\xe3abc" + b"\x00\x03" + b"\x46" + b"X" + b"\x0e" + b"\x16" + b"\xf2" + b"\xa8\x0c\x00" + b"Y" + b"\x07\x03\x00" + b"\xe0\x00" + b"0123456789abcdef" + b"\xf0\x01" + b"\x06" + bytes(7)
    out = bytearray(b"abc")

    def copy(distance, n):
        for _ in range(n):
            out.append(out[-distance])

    copy(3, 3)
    out += b"X"
    copy(3, 3)
    copy(3, 2)
    out += b"Y"
    copy(3, 3)
    copy(3, 3)
    out += b"0123456789abcdef"
    copy(3, 17)
    stream = b"bvxn" + struct.pack("<II", len(out), len(code)) + code + b"bvx-" + struct.pack("<I", 2) + b"zz" + b"bvx$"
    assert lzfse.decompress(stream) == bytes(out) + b"zz"


def entropy_block(literals: bytes, moves: list[tuple[int, int, int]], content: bytes) -> bytes:
    """A bvx2 block of literals and (literals, match, distance) moves, coded by running the decoder's tables backwards."""
    literals += bytes(-len(literals) % 4)

    def symbol(value, bases, extra):
        k = max(i for i, b in enumerate(bases) if b <= value)
        assert value - bases[k] < 1 << extra[k]
        return k, value - bases[k], extra[k]

    kinds = ((lzfse.L_BASE, lzfse.L_EXTRA), (lzfse.M_BASE, lzfse.M_EXTRA), (lzfse.D_BASE, lzfse.D_EXTRA))
    coded = [[symbol(v, *kinds[k]) for k, v in enumerate(m)] for m in moves]

    def frequencies(used, symbols, states):
        counts = [used.count(s) for s in range(symbols)]
        present = [s for s in range(symbols) if counts[s]]
        out = [0] * symbols
        for s in present:
            out[s] = max(1, counts[s] * (states - len(present)) // max(1, len(used)))
        if present:
            out[present[0]] += states - sum(out)
        return out

    tables, of = [], []
    for k, name in enumerate(("l", "m", "d")):
        of.append(frequencies([c[k][0] for c in coded], lzfse.SYMBOLS[k], lzfse.STATES[name]))
        tables.append(lzfse.decoder_table(of[-1], lzfse.STATES[name]))
    of.append(frequencies(list(literals), 256, 1024))
    tables.append(lzfse.decoder_table(of[3], 1024))

    def step(table, wanted, after):
        """The state that gives a symbol and can go on to a state, and the bits that do."""
        return next((s, n, after - base) for s, (sym, n, base) in enumerate(table) if sym == wanted and base <= after < base + (1 << n))

    class Out:
        bits, size = 0, 0

        def push(self, value, n):
            self.bits |= value << self.size
            self.size += n

        def payload(self):
            n = -(-self.size // 8)
            return self.bits.to_bytes(n, "little") + b"", self.size - 8 * n

    first, states = Out(), [0] * 4
    for k in range(len(literals) - 1, -1, -1):
        states[k % 4], n, bits = step(tables[3], literals[k], states[k % 4])
        first.push(bits, n)
    second, lmd = Out(), [0] * 3
    for move in reversed(coded):
        for k in (2, 1, 0):
            sym, low, extra = move[k]
            lmd[k], n, bits = step(tables[k], sym, lmd[k])
            second.push(bits << extra | low, n + extra)
    (a, spare_a), (b, spare_b) = first.payload(), second.payload()
    packed, size = 0, 0
    for f in (x for part in of for x in part):
        if f in lzfse.FREQUENCY_VALUES[:32]:
            low = lzfse.FREQUENCY_VALUES.index(f)
            code, n = low, lzfse.FREQUENCY_BITS[low]
            code &= (1 << n) - 1
        elif f < 24:
            code, n = 7 | (f - 8) << 4, 8
        else:
            code, n = 15 | (f - 24) << 4, 14
        packed |= code << size
        size += n
    freq = packed.to_bytes(-(-size // 8), "little")
    v0 = len(literals) | len(a) << 20 | len(moves) << 40 | (spare_a + 7) << 60
    v1 = sum(s << 10 * k for k, s in enumerate(states)) | len(b) << 40 | (spare_b + 7) << 60
    v2 = (32 + len(freq)) | lmd[0] << 32 | lmd[1] << 42 | lmd[2] << 52
    return b"bvx2" + struct.pack("<I3Q", len(content), v0, v1, v2) + freq + a + b


@pytest.mark.parametrize("seed", range(6))
def test_entropy_blocks(seed):
    rng = random.Random(seed)
    literals, moves, out = b"", [], bytearray()
    distance = 0
    for k in range(rng.choice([1, 40, 400])):
        run = rng.choice([0, 1, 3, 17, 61]) if k else 5
        part = bytes(rng.choice(b"aaabbcd\xff") for _ in range(run))
        literals, out = literals + part, out + part
        fresh = 0 if distance and rng.random() < 0.4 else rng.randrange(1, len(out) + 1)
        distance = fresh or distance
        size = rng.choice([3, 4, 20, 70, 400])
        for _ in range(size):
            out.append(out[-distance])
        moves.append((run, size, fresh))
    block = entropy_block(literals, moves, bytes(out))
    assert lzfse.decompress(block + b"bvx$") == bytes(out)
    assert lzfse.decompress(b"bvx-" + struct.pack("<I", 3) + b"abc" + block + b"bvx$") == b"abc" + bytes(out)


def test_broken_streams():
    good = lzfse.compress(b"hello hello hello hello hello hello hello")
    for bad in (b"x", b"bvx", b"bvx9" + good[4:], good[:-9], good[:20], b"bvxn" + struct.pack("<II", 5, 3) + b"\x00\x09\x06", b"bvx-" + struct.pack("<I", 9) + b"abc"):
        with pytest.raises(lzfse.LzfseError):
            lzfse.decompress(bad)
