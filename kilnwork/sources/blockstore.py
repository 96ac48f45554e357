"""The block store and its trees, as bytes: reading and writing.

A store is numbered blocks and named entry points.  A tree maps key bytes (or
inline 32-bit keys) to blocks through sorted leaves that are linked left to
right.  The outer layer is big-endian.
"""

from __future__ import annotations

import struct
from collections.abc import Iterable, Iterator

#: Fixed values of the format.
MAGIC, TREE_MAGIC = b"BOMStore", b"tree"
HEADER_BYTES, NODE_BYTES, NODE_HEAD, ENTRY_BYTES, TRAILER_BYTES, ALIGN = 512, 4096, 12, 8, 20, 4
UNUSED = 0xFFFFFFFF


class StoreError(ValueError):
    """Bytes that are no valid store."""


def _u32(data: bytes, at: int) -> int:
    if at + 4 > len(data):
        raise StoreError("truncated")
    return struct.unpack_from(">I", data, at)[0]


class Store:
    """A parsed store; block 0 and unused slots are empty."""

    def __init__(self, data: bytes):
        if data[:8] != MAGIC or len(data) < 32:
            raise StoreError("not a block store")
        _, _, index_at, index_size, vars_at, vars_size = struct.unpack_from(">6I", data, 8)
        if index_at + index_size > len(data) or vars_at + vars_size > len(data):
            raise StoreError("index or names lie outside the file")
        count = _u32(data, index_at)
        if 4 + 8 * count > index_size:
            raise StoreError("the block index is too short")
        self.blocks: list[bytes] = []
        for k in range(count):
            at, size = struct.unpack_from(">II", data, index_at + 4 + 8 * k)
            if (at, size) in ((0, 0), (UNUSED, UNUSED)):
                self.blocks.append(b"")
            elif at + size > len(data):
                raise StoreError(f"block {k} lies outside the file")
            else:
                self.blocks.append(data[at : at + size])
        self.names: dict[str, int] = {}
        at = vars_at + 4
        for _ in range(_u32(data, vars_at)):
            block, size = struct.unpack_from(">IB", data, at)
            self.names[data[at + 5 : at + 5 + size].decode("utf-8", "replace")] = block
            at += 5 + size

    def block(self, number: int) -> bytes:
        if number >= len(self.blocks):
            raise StoreError(f"no block {number}")
        return self.blocks[number]

    def named(self, name: str) -> bytes | None:
        return self.block(self.names[name]) if name in self.names else None

    def _leaves(self, root: int) -> Iterator[list[tuple[int, int]]]:
        """(value, key) numbers of each leaf; cycles are errors."""
        seen: set[int] = set()
        number = root
        while True:
            if number in seen:
                raise StoreError("a tree that runs in a circle")
            seen.add(number)
            node = self.block(number)
            leaf, count, after, _ = struct.unpack_from(">HHII", node)
            if NODE_HEAD + ENTRY_BYTES * count > len(node):
                raise StoreError("a node is too short")
            entries = [struct.unpack_from(">II", node, NODE_HEAD + ENTRY_BYTES * k) for k in range(count)]
            if not leaf:
                if not entries:
                    return
                number = entries[0][0]
                continue
            yield entries
            if not after:
                return
            number = after

    def _pairs(self, name: str) -> tuple[Iterator[tuple[int, int]], bool]:
        tree = self.named(name)
        if tree is None:
            return iter(()), False
        if tree[:4] != TREE_MAGIC or len(tree) < 21:
            raise StoreError(f"{name} is no tree")
        root, inline = _u32(tree, 8), bool(tree[20])
        return ((v, k) for leaf in self._leaves(root) for v, k in leaf), inline

    def tree(self, name: str) -> Iterator[tuple[bytes, bytes]]:
        """(key, value) in order; nothing if the name is missing."""
        for value, key in self._pairs(name)[0]:
            yield self.block(key), self.block(value)

    def inline_tree(self, name: str) -> Iterator[tuple[int, bytes]]:
        for value, key in self._pairs(name)[0]:
            yield key, self.block(value)


class Writer:
    def __init__(self):
        self._blocks: list[bytes] = [b""]
        self._names: dict[str, int] = {}

    def add(self, data: bytes) -> int:
        self._blocks.append(data)
        return len(self._blocks) - 1

    def name(self, name: str, block: int) -> None:
        self._names[name] = block

    def put(self, name: str, data: bytes) -> None:
        self.name(name, self.add(data))

    def tree(self, name: str, entries: Iterable[tuple[bytes | int, bytes]], *, inline: bool = False, node_bytes: int = NODE_BYTES) -> None:
        """Bulk-loads sorted entries, leaves first; separators are the last key of each child."""
        fan_out = (node_bytes - NODE_HEAD) // ENTRY_BYTES
        pairs = [(self.add(value), key if inline else self.add(key)) for key, value in entries]
        level = [pairs[k : k + fan_out] for k in range(0, len(pairs), fan_out)] or [[]]
        numbers = [self.add(b"") for _ in level]
        for k, part in enumerate(level):
            after = numbers[k + 1] if k + 1 < len(numbers) else 0
            before = numbers[k - 1] if k else 0
            self._blocks[numbers[k]] = self._node(True, part, after, before, node_bytes)
        lasts = [part[-1][1] if part else 0 for part in level]
        while len(numbers) > 1:
            upper = [list(zip(numbers[k : k + fan_out], lasts[k : k + fan_out], strict=True)) for k in range(0, len(numbers), fan_out)]
            numbers = [self.add(self._node(False, part, 0, 0, node_bytes)) for part in upper]
            lasts = [part[-1][1] for part in upper]
        self.put(name, TREE_MAGIC + struct.pack(">IIIIB", 1, numbers[0], node_bytes, len(pairs), inline))

    @staticmethod
    def _node(leaf: bool, entries: list[tuple[int, int]], after: int, before: int, size: int) -> bytes:
        head = struct.pack(">HHII", leaf, len(entries), after, before)
        return (head + b"".join(struct.pack(">II", *e) for e in entries)).ljust(size, b"\0")

    def finish(self) -> bytes:
        out = bytearray(HEADER_BYTES)
        index = [(0, 0)]
        for block in self._blocks[1:]:
            out += b"\0" * (-len(out) % ALIGN)
            index.append((len(out), len(block)) if block else (0, 0))
            out += block
        out += b"\0" * (-len(out) % ALIGN)
        index_at = len(out)
        out += struct.pack(">I", len(index)) + b"".join(struct.pack(">II", *x) for x in index) + b"\0" * TRAILER_BYTES
        vars_at = len(out)
        out += struct.pack(">I", len(self._names))
        for name, block in self._names.items():
            raw = name.encode()
            out += struct.pack(">IB", block, len(raw)) + raw
        used = sum(1 for x in index if x != (0, 0))
        struct.pack_into(">8s6I", out, 0, MAGIC, 1, used, index_at, vars_at - index_at, vars_at, len(out) - vars_at)
        return bytes(out)
