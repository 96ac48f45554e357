"""Bitmaps: envelopes, streams, run-length and planar codecs, pixel formats, PNG.

A bitmap in memory is a numpy array (height, width, 4) of straight RGBA bytes.
None means that a form is not supported, so that the bytes pass through.  Stream
compressions are a registry by name.
"""

from __future__ import annotations

import struct
import zlib
from collections.abc import Callable

import numpy as np

from kilnwork.sources import lzfse
from kilnwork.sources.records import BITMAP, CHUNK, RAW, compression_code, compression_name, stride_of

CHUNK_BYTES = 1 << 20
#: Name to (decompress, compress); a stream codec that is added here is used everywhere.
STREAMS: dict[str, tuple[Callable[[bytes], bytes], Callable[[bytes], bytes]]] = {
    "uncompressed": (bytes, bytes),
    "zlib": (zlib.decompress, lambda data: zlib.compress(data, 9)),
    "lzvn": (lzfse.decompress, lzfse.compress),
    "lzfse": (lzfse.decompress, lzfse.compress),
}


def inflate(data: bytes, compression: str) -> bytes | None:
    if compression not in STREAMS:
        return None
    try:
        return STREAMS[compression][0](data)
    except (zlib.error, lzfse.LzfseError):
        return None


def deflate(data: bytes, compression: str) -> bytes | None:
    return STREAMS[compression][1](data) if compression in STREAMS else None


# Pixel formats.


def premultiply(rgba: np.ndarray) -> np.ndarray:
    out = rgba.astype(np.int64)
    out[..., :3] = (out[..., :3] * out[..., 3:] + 127) // 255
    return out.astype(np.uint8)


def unpremultiply(rgba: np.ndarray) -> np.ndarray:
    out = rgba.astype(np.int64)
    alpha = out[..., 3:]
    straight = (out[..., :3] * 255 + alpha // 2) // np.maximum(alpha, 1)
    out[..., :3] = np.where(alpha == 0, 0, np.minimum(straight, 255))
    return out.astype(np.uint8)


def quantize(values: np.ndarray) -> np.ndarray:
    """[0, 1] to 8 bits, half up; NaN to 0."""
    clean = np.clip(np.nan_to_num(values.astype(np.float64), nan=0.0, posinf=1.0, neginf=0.0), 0, 1)
    return np.floor(clean * 255 + 0.5).astype(np.uint8)


def rows_to_rgba(data: bytes, width: int, height: int, stride: int, pixel_format: str) -> np.ndarray | None:
    """Straight RGBA of premultiplied rows; row padding is dropped."""
    size = {"ARGB": 4, "GA8": 2, "RGBW": 8, "GA16": 4}.get(pixel_format)
    if size is None or stride < width * size or len(data) < stride * height:
        return None
    rows = np.frombuffer(data, np.uint8, stride * height).reshape(height, stride)[:, : width * size].reshape(height, width, size)
    if pixel_format == "ARGB":
        return unpremultiply(rows[..., [2, 1, 0, 3]])
    if pixel_format == "GA8":
        return unpremultiply(rows[..., [0, 0, 0, 1]])
    if pixel_format == "GA16":
        return unpremultiply(rows[..., [1, 1, 1, 3]])  # high bytes
    return unpremultiply(quantize(np.ascontiguousarray(rows).view("<f2")))


def rgba_to_rows(rgba: np.ndarray, stride: int, pixel_format: str) -> bytes | None:
    """Premultiplied rows, zero-padded to the stride; gray takes the red channel."""
    height, width = rgba.shape[:2]
    pre = premultiply(rgba)
    if pixel_format == "ARGB":
        cells = pre[..., [2, 1, 0, 3]]
    elif pixel_format == "GA8":
        cells = pre[..., [0, 3]]
    elif pixel_format == "RGBW":
        cells = np.ascontiguousarray((pre.astype(np.float32) / 255).astype("<f2")).view(np.uint8).reshape(height, width, 8)
    else:
        return None
    out = np.zeros((height, stride), np.uint8)
    out[:, : width * cells.shape[-1]] = cells.reshape(height, -1)
    return out.tobytes()


# Run-length images.


def rle_decode(body: bytes, element: int) -> bytes | None:
    """Packed rows without padding, of a body with its own header."""
    if len(body) < 12:
        return None
    magic, width, height = struct.unpack_from("<3I", body)
    if magic != 3 or 12 + 4 * height > len(body):
        return None
    out = []
    for start in struct.unpack_from(f"<{height}I", body, 12):
        row, at, have = [], start, 0
        while have < width:
            if at + 4 > len(body):
                return None
            control = struct.unpack_from("<I", body, at)[0]
            count, at = control & 0xFFFFFF, at + 4
            take = element if control >> 24 == 0x80 else element * count
            if count == 0 or have + count > width or at + take > len(body):
                return None
            row.append(body[at : at + take] * (count if control >> 24 == 0x80 else 1))
            at, have = at + take, have + count
        out.append(b"".join(row))
    return b"".join(out)


def rle_row(row: np.ndarray) -> bytes:
    """A row's stream: runs of two or more are fills, what is between is literal.  row: (width, element)."""
    change = np.flatnonzero((row[1:] != row[:-1]).any(axis=1)) + 1
    begin = np.concatenate([[0], change])
    length = np.diff(np.append(begin, len(row)))
    out, literal = [], []

    def flush() -> None:
        if literal:
            out.append(struct.pack("<I", len(literal)) + b"".join(literal))
            literal.clear()

    for at, n in zip(begin.tolist(), length.tolist(), strict=True):
        if n == 1:
            literal.append(row[at].tobytes())
            continue
        flush()
        while n:
            part = min(n, 0xFFFFFF)
            out.append(struct.pack("<I", 0x80000000 | part) + row[at].tobytes())
            n -= part
    flush()
    return b"".join(out)


def rle_encode(cells: np.ndarray) -> bytes:
    """cells: (height, width, element).  Equal rows share one stream."""
    height, width = cells.shape[:2]
    at, streams, offsets, known = 12 + 4 * height, [], [], {}
    for row in cells:
        key = row.tobytes()
        if key not in known:
            stream = rle_row(row)
            known[key], at = at, at + len(stream)
            streams.append(stream)
        offsets.append(known[key])
    return struct.pack("<3I", 3, width, height) + struct.pack(f"<{height}I", *offsets) + b"".join(streams)


# Envelopes.


def bitmap_parts(payload: bytes) -> tuple[int, int, list[tuple[int, bytes]]] | None:
    """Flags, compression and the (rows, bytes) of each chunk; rows is 0 for a plain payload."""
    if payload[:4] != BITMAP or len(payload) < 16:
        return None
    flags, compression, size = struct.unpack_from("<3I", payload, 4)
    if not flags & 1:
        return (flags, compression, [(0, payload[16 : 16 + size])]) if 16 + size <= len(payload) else None
    parts, at = [], 16
    for _ in range(size):
        if payload[at : at + 4] != CHUNK or at + 20 > len(payload):
            return None
        rows, length = struct.unpack_from("<II", payload, at + 12)
        if at + 20 + length > len(payload):
            return None
        parts.append((rows, payload[at + 20 : at + 20 + length]))
        at += 20 + length
    return flags, compression, parts


def compression_of(payload: bytes) -> str | None:
    parts = bitmap_parts(payload)
    return compression_name(parts[1]) if parts else None


def bitmap_decode(payload: bytes, width: int, height: int, stride: int, pixel_format: str) -> np.ndarray | None:
    """Straight RGBA of a bitmap envelope, or None."""
    parts = bitmap_parts(payload)
    if parts is None:
        return None
    _, code, chunks = parts
    name = compression_name(code)
    if name == "deepmap2":
        return planar_decode(chunks, width, height, pixel_format)
    if name == "rle":
        size = {"ARGB": 4, "GA8": 2}.get(pixel_format)
        packed = rle_decode(chunks[0][1], size) if size and len(chunks) == 1 else None
        return rows_to_rgba(packed, width, height, width * size, pixel_format) if packed is not None and len(packed) == width * height * size else None
    raw = []
    for rows, data in chunks:
        part = inflate(data, name)
        if part is None or (rows and len(part) != rows * stride):
            return None
        raw.append(part)
    every = b"".join(raw)
    return rows_to_rgba(every, width, height, stride, pixel_format) if len(every) == stride * height else None


def bitmap_encode(rgba: np.ndarray, compression: str, stride: int, pixel_format: str, *, chunked: bool = False) -> bytes | None:
    """A bitmap envelope; chunked ones hold about 1 MiB of rows in each chunk, and an empty image one empty chunk."""
    height = rgba.shape[0]
    if compression == "rle":
        rows = rgba_to_rows(rgba, rgba.shape[1] * {"ARGB": 4, "GA8": 2}.get(pixel_format, 0), pixel_format) if pixel_format in ("ARGB", "GA8") else None
        if rows is None:
            return None
        body = rle_encode(np.frombuffer(rows, np.uint8).reshape(*rgba.shape[:2], -1))
        return BITMAP + struct.pack("<3I", 2, 1, len(body)) + body
    rows = rgba_to_rows(rgba, stride, pixel_format)
    if rows is None or compression not in STREAMS:
        return None
    code = compression_code(compression)
    if not chunked:
        body = deflate(rows, compression)
        return BITMAP + struct.pack("<3I", 2, code, len(body)) + body
    step = max(1, CHUNK_BYTES // max(1, stride))
    out = []
    for first in range(0, max(1, height), step):
        last = min(height, first + step)
        body = deflate(rows[first * stride : last * stride], compression)
        out.append(CHUNK + struct.pack("<4I", 0, 0, last - first, len(body)) + body)
    return BITMAP + struct.pack("<3I", 3, code, len(out)) + b"".join(out)


def raw_decode(payload: bytes) -> tuple[bytes, bool] | None:
    """Bytes of a raw-data envelope, and whether they are an LZFSE stream that can't be read (passed through)."""
    if payload[:4] != RAW or len(payload) < 12:
        return None
    size = int.from_bytes(payload[8:12], "little")
    body = payload[12 : 12 + size]
    if len(body) < size:
        return None
    if body[:3] == b"bvx":
        plain = inflate(body, "lzfse")
        return (body, True) if plain is None else (plain, False)
    return body, False


def raw_encode(data: bytes, compressed: bool = False) -> bytes:
    """compressed: the bytes are an LZFSE stream already; the flag is never set over anything else."""
    return RAW + struct.pack("<II", int(compressed and data[:3] == b"bvx"), len(data)) + data


# Planar predictor codec.

NONE, PAETH, LEFT, UP, MEAN = range(5)
PACKED, DEFAULT, LOSSLESS, PALETTE = 1, 2, 3, 4
#: Bytes per pixel by the blob's format code, and each format's channels in a default tile (fixed values).
BLOB_FORMATS = {"GA8": (2, 2, 1), "ARGB": (4, 4, 3), "GA16": (18, 4, 1), "RGBW": (20, 8, 3)}
INNER = 0x0A


def fold(delta: np.ndarray) -> np.ndarray:
    return np.where(delta < 0, -2 * delta + 1, 2 * delta)


def unfold(code: np.ndarray) -> np.ndarray:
    return np.where(code & 1, -(code >> 1), code >> 1)


def unpredict(residual: np.ndarray, selectors: np.ndarray) -> np.ndarray:
    """Values of (height, width, channels) residuals; each row has its own predictor."""
    height, width, channels = residual.shape
    out = np.zeros_like(residual)
    up = np.zeros((width, channels), residual.dtype)
    for y in range(height):
        row, kind = residual[y], int(selectors[y])
        if kind == NONE:
            out[y] = row
        elif kind == LEFT:
            out[y] = np.cumsum(row, axis=0)
        elif kind == UP:
            out[y] = row + up
        else:
            left = np.zeros(channels, residual.dtype)
            for x in range(width):
                if x == 0:
                    guess = up[0]
                elif kind == MEAN:
                    guess = (left + up[x] + 1) >> 1
                else:
                    guess = left if abs(up[x, 0] - up[x - 1, 0]) <= abs(left[0] - up[x - 1, 0]) else up[x]
                left = row[x] + guess
                out[y, x] = left
        up = out[y]
    return out


def predict(values: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    """Residuals and the cheapest predictor of each row, the first of equals; the first row doesn't look up.

    Mean is never chosen, as readers differ in how they round it.
    """
    height, _, _ = values.shape
    residual, selectors = np.zeros_like(values), np.zeros(height, np.uint8)
    for y, row in enumerate(values):
        left = np.zeros_like(row)
        left[1:] = row[:-1]
        choices = {NONE: row}
        if y:
            up = values[y - 1]
            corner = np.zeros_like(row)
            corner[1:] = up[:-1]
            near = np.abs(up[:, 0] - corner[:, 0]) <= np.abs(left[:, 0] - corner[:, 0])
            near[0] = False
            choices[PAETH] = row - np.where(near[:, None], left, up)
        choices[LEFT] = row - left
        if y:
            choices[UP] = row - up
        best = min(choices, key=lambda k: (int(fold(choices[k]).sum()), k))
        residual[y], selectors[y] = choices[best], best
    return residual, selectors


def to_lattice(rgb: np.ndarray) -> np.ndarray:
    """Luma and two chromas whose inverse is nearest to premultiplied rgb, in range; (n, 3) to (n, 3).

    Only every fourth colour is on the lattice, so the inverse may be 1 off.
    """
    out = np.empty((len(rgb), 3), np.int64)
    for at in range(0, len(rgb), 1024):
        out[at : at + 1024] = _nearest_on_lattice(rgb[at : at + 1024].astype(np.int64))
    return out


#: What is tried around a colour's luma and chromas, a row for each of the three, the first of equals before others.
_AROUND = np.array([(dy, d1, d2) for dy in range(-2, 3) for d1 in range(-2, 3) for d2 in range(-2, 3)]).T
_OUTSIDE = 1 << 40


def _nearest_on_lattice(rgb: np.ndarray) -> np.ndarray:
    dy, d1, d2 = _AROUND
    r, g, b = (rgb[:, k, None] for k in range(3))
    c1, c2 = (b - r) >> 1, (2 * g - r - b) >> 2
    # The inverse of (y, p, q) is (y - p - q, y + q, y + p - q), where y = g - q + dy, p = c1 + d1 and q = c2 + d2.
    twice = g - 2 * c2
    red, green, blue = twice - c1 + (dy - d1 - 2 * d2), g + dy, twice + c1 + (dy + d1 - 2 * d2)
    cost = ((red - r) ** 2 + dy**2 + (blue - b) ** 2) * 64 + np.abs(_AROUND).sum(axis=0)
    # A negative number has the highest bits.
    cost[((red | green | blue) & ~255) != 0] = _OUTSIDE
    best = cost.argmin(axis=1)
    q = c2[:, 0] + d2[best]
    out = np.stack([g[:, 0] - q + dy[best], c1[:, 0] + d1[best], q], axis=1)
    out[cost[np.arange(len(rgb)), best] == _OUTSIDE] = 0
    return out


def from_lattice(values: np.ndarray) -> np.ndarray:
    y, c1, c2 = (values[..., k] for k in range(3))
    return np.stack([y - c1 - c2, y + c2, y + c1 - c2], axis=-1)


def wrapped_cost(found: np.ndarray, rgb: np.ndarray) -> np.ndarray:
    """Squared distance of colours whose channels are read modulo 256, as other readers do."""
    return ((found % 256 - rgb) ** 2).sum(axis=1)


def default_tile(raw: bytes, width: int, height: int, pixel_format: str) -> np.ndarray | None:
    """Premultiplied RGBA of an inflated default tile."""
    _, _, channels = BLOB_FORMATS[pixel_format]
    cells = width * height
    if len(raw) < cells + height + 2 * channels * cells:
        return None
    data = np.frombuffer(raw, np.uint8)
    alpha, selectors = data[:cells].reshape(height, width), data[cells : cells + height]
    if (selectors > MEAN).any():
        return None
    at = cells + height
    high, low = (data[at + k * channels * cells : at + (k + 1) * channels * cells].astype(np.int64) for k in range(2))
    values = unpredict(unfold((high << 8) | low).reshape(height, width, channels), selectors)
    colour = from_lattice(values) if channels == 3 else np.repeat(values, 3, axis=2)
    if pixel_format in ("RGBW", "GA16"):
        colour = colour >> 1
    return np.concatenate([np.clip(colour, 0, 255), alpha[..., None]], axis=2).astype(np.uint8)


def _blob(data: bytes) -> tuple[int, int, int, int, int, bytes] | None:
    """Codec, format, tile size, first tile's length and what follows, of a wrapped blob."""
    if len(data) < 32 or data[16:20] != b"dmp2":
        return None
    codec, version, _, kind, tile_w, tile_h, first = struct.unpack_from("<4BHHI", data, 20)
    size = struct.unpack_from("<Q", data, 8)[0]
    return (codec, kind, tile_w, tile_h, first, data[32 : 16 + size]) if version < 2 and 16 + size <= len(data) else None


def planar_decode(chunks: list[tuple[int, bytes]], width: int, height: int, pixel_format: str, stream: str = "lzfse") -> np.ndarray | None:
    """Bands stacked from the top; they must add up to the height."""
    bands = []
    for rows, data in chunks:
        band = _band(data, width, rows or height, stream)
        if band is None:
            return None
        bands.append(band)
    out = np.concatenate(bands) if bands else None
    return out if out is not None and len(out) == height else None


def _band(data: bytes, width: int, height: int, stream: str) -> np.ndarray | None:
    parts = _blob(data)
    names = {code: (name, size) for name, (code, size, _) in BLOB_FORMATS.items()}
    if parts is None or parts[1] not in names:
        return None
    codec, kind, tile_w, tile_h, size, body = parts
    name, cell = names[kind]

    if codec == PALETTE:
        count = (size & 0xFFFF) + 1
        indices = inflate(body[4 * count :], stream)
        if len(body) < 4 * count or indices is None or len(indices) != width * height:
            return None
        entries = np.frombuffer(body, np.uint8, 4 * count).reshape(count, 4)[:, [2, 1, 0, 3]]
        at = np.frombuffer(indices, np.uint8)
        return entries[at].reshape(height, width, 4) if int(at.max(initial=0)) < count else None
    if not tile_w or not tile_h:
        return None
    out = np.zeros((height, width, 4), np.uint8)
    at = 0
    for y in range(0, height, tile_h):
        for x in range(0, width, tile_w):
            if y or x:
                if at + 4 > len(body):
                    return None
                size, at = int.from_bytes(body[at : at + 4], "little"), at + 4
            w, h = min(tile_w, width - x), min(tile_h, height - y)
            part = body[at : at + size]
            raw = part if codec == PACKED else inflate(part, stream)
            if len(part) < size or raw is None:
                return None
            at += size
            if codec == DEFAULT:
                tile = default_tile(raw, w, h, name)
                tile = None if tile is None else unpremultiply(tile)
            elif codec in (PACKED, LOSSLESS):
                tile = rows_to_rgba(raw, w, h, w * cell, name)
            else:
                return None
            if tile is None:
                return None
            out[y : y + h, x : x + w] = tile
    return out


def _envelope(codec: int, pixel_format: str, width: int, height: int, size: int, body: bytes) -> bytes:
    kind = BLOB_FORMATS[pixel_format][0]
    blob = b"dmp2" + struct.pack("<4BHHI", codec, 1, INNER, kind, width, height, size) + body
    wrapped = struct.pack("<IIQ", 1, kind, len(blob)) + blob
    return BITMAP + struct.pack("<3I", 0, 11, len(wrapped)) + wrapped  # flags must be 0


def palette_encode(rgba: np.ndarray, compression: str = "lzfse", quantized: bool = False) -> bytes | None:
    """Palette payload; more than 256 colours give None, or their median-cut palette if ``quantized``."""
    flat = rgba.reshape(-1, 4)
    colours, first, inverse, counts = np.unique(flat, axis=0, return_index=True, return_inverse=True, return_counts=True)
    inverse = inverse.reshape(-1)
    if len(colours) > 256:
        if not quantized:
            return None
        entries = median_cut(colours, counts)
        indices = nearest(colours, entries)[inverse]
    else:
        order = np.argsort(first)  # first appearance
        rank = np.empty(len(order), np.int64)
        rank[order] = np.arange(len(order))
        entries, indices = colours[order], rank[inverse]
    table = entries[:, [2, 1, 0, 3]].astype(np.uint8).tobytes() + b"\0\0\0\0"  # one spare entry
    body = deflate(indices.astype(np.uint8).tobytes(), compression)
    return None if body is None else _envelope(PALETTE, "ARGB", rgba.shape[1], rgba.shape[0], (4 << 16) | len(entries), table + body)


def default_encode(rgba: np.ndarray, pixel_format: str, compression: str = "lzfse") -> bytes | None:
    """Planar payload of one tile, for ARGB and GA8."""
    if pixel_format not in ("ARGB", "GA8"):
        return None
    height, width = rgba.shape[:2]
    pre = premultiply(rgba).astype(np.int64)
    values = pre[..., :1] if pixel_format == "GA8" else to_lattice(pre[..., :3].reshape(-1, 3)).reshape(height, width, 3)
    residual, selectors = predict(values)
    code = fold(residual).reshape(-1)
    raw = pre[..., 3].astype(np.uint8).tobytes() + selectors.tobytes() + (code >> 8).astype(np.uint8).tobytes() + (code & 255).astype(np.uint8).tobytes()
    body = deflate(raw + b"\0" * (-len(raw) % 16), compression)
    return None if body is None else _envelope(DEFAULT, pixel_format, width, height, len(body), body)


def nearest(colours: np.ndarray, entries: np.ndarray) -> np.ndarray:
    """Entry with the smallest squared distance; the first of equals."""
    out = np.empty(len(colours), np.int64)
    wide = entries.astype(np.float64)  # sums of so few bytes' products are exact
    norms = (wide**2).sum(axis=1)
    for at in range(0, len(colours), 4096):
        out[at : at + 4096] = (norms - 2 * (colours[at : at + 4096].astype(np.float64) @ wide.T)).argmin(axis=1)
    return out


def median_cut(colours: np.ndarray, counts: np.ndarray, limit: int = 256) -> np.ndarray:
    """Representatives: the box with the largest range times population is split at its weighted median."""
    wide = colours.astype(np.int64)

    def weight(box: np.ndarray) -> int:
        return int(np.ptp(wide[box], axis=0).max()) * int(counts[box].sum()) if len(box) > 1 else -1

    boxes = [np.arange(len(colours))]
    weights = [weight(boxes[0])]
    while len(boxes) < limit:
        k = weights.index(max(weights))
        box = boxes[k]
        if weights[k] <= 0:
            break
        channel = int(np.argmax(np.ptp(wide[box], axis=0)))
        box = box[np.argsort(wide[box, channel], kind="stable")]
        running = np.cumsum(counts[box])
        at = min(max(1, int(np.argmax(2 * running >= running[-1])) + 1), len(box) - 1)
        boxes[k : k + 1] = [box[:at], box[at:]]
        weights[k : k + 1] = [weight(box[:at]), weight(box[at:])]
    means = [(wide[b] * counts[b][:, None]).sum(axis=0) for b in boxes]
    totals = [int(counts[b].sum()) for b in boxes]
    return np.array([(m + t // 2) // t for m, t in zip(means, totals, strict=True)]).astype(np.uint8)


def reencode(rgba: np.ndarray, compression: str, stride: int, pixel_format: str) -> tuple[str, bytes] | None:
    """Compression and payload for an edited bitmap: palette (colour bitmaps only), default, wide, run-length or plain."""
    if compression == "deepmap2" and pixel_format == "ARGB" and (payload := palette_encode(rgba)) is not None:
        return "deepmap2", payload
    if compression == "deepmap2" and (payload := default_encode(rgba, pixel_format)) is not None:
        return "deepmap2", payload
    if compression == "rle" and pixel_format == "GA8":
        return "rle", bitmap_encode(rgba, "rle", stride, pixel_format)
    name = compression if compression in STREAMS else "lzfse"
    payload = bitmap_encode(rgba, name, stride, pixel_format)
    return None if payload is None else (name, payload)


# PNG.

_SIGNATURE = b"\x89PNG\r\n\x1a\n"


def png_write(rgba: np.ndarray) -> bytes:
    """8-bit RGBA, no filter, best compression."""
    height, width = rgba.shape[:2]
    raw = np.zeros((height, 1 + 4 * width), np.uint8)
    raw[:, 1:] = rgba.reshape(height, -1)

    def chunk(kind: bytes, data: bytes) -> bytes:
        return struct.pack(">I", len(data)) + kind + data + struct.pack(">I", zlib.crc32(kind + data))

    return _SIGNATURE + chunk(b"IHDR", struct.pack(">IIBBBBB", width, height, 8, 6, 0, 0, 0)) + chunk(b"IDAT", zlib.compress(raw.tobytes(), 9)) + chunk(b"IEND", b"")


def png_read(data: bytes) -> np.ndarray | None:
    """Straight RGBA of a PNG: gray, RGB, palette, with alpha, transparency, 1 to 16 bits, interlaced or not."""
    if data[:8] != _SIGNATURE:
        return None
    at, parts = 8, {}
    while at + 12 <= len(data):
        size, kind = struct.unpack_from(">I4s", data, at)
        parts[kind] = parts.get(kind, b"") + data[at + 8 : at + 8 + size]
        at += 12 + size
    width, height, bits, colour, _, _, interlaced = struct.unpack(">IIBBBBB", parts[b"IHDR"])
    channels = {0: 1, 2: 3, 3: 1, 4: 2, 6: 4}.get(colour)
    if channels is None or interlaced > 1:
        return None
    whole = np.zeros((height, width, channels), np.uint16)
    raw, at = zlib.decompress(parts[b"IDAT"]), 0
    for x0, y0, dx, dy in _PASSES if interlaced else ((0, 0, 1, 1),):
        w, h = -(-(width - x0) // dx), -(-(height - y0) // dy)
        if w > 0 and h > 0:
            whole[y0::dy, x0::dx], at = _png_pass(raw, at, w, h, channels, bits)
    samples = (whole >> 8 if bits == 16 else whole).astype(np.uint8)
    if bits < 8 and colour == 0:
        samples = (samples * (255 // ((1 << bits) - 1))).astype(np.uint8)
    out = np.full((height, width, 4), 255, np.uint8)
    clear = parts.get(b"tRNS")
    if colour == 3:
        table = np.frombuffer(parts[b"PLTE"], np.uint8).reshape(-1, 3)
        alpha = np.full(len(table), 255, np.uint8)
        if clear:
            alpha[: len(clear)] = np.frombuffer(clear, np.uint8)[: len(table)]
        out[..., :3], out[..., 3] = table[samples[..., 0]], alpha[samples[..., 0]]
        return out
    out[..., :3] = samples[..., :3] if channels >= 3 else samples[..., :1]
    if colour in (4, 6):
        out[..., 3] = samples[..., -1]
    elif clear and bits in (8, 16):
        wanted = struct.unpack(f">{len(clear) // 2}H", clear)
        out[(whole == np.array(wanted)).all(axis=2), 3] = 0
    return out


#: First column and row, and steps, of the passes of an interlaced PNG (fixed values).
_PASSES = ((0, 0, 8, 8), (4, 0, 8, 8), (0, 4, 4, 8), (2, 0, 4, 4), (0, 2, 2, 4), (1, 0, 2, 2), (0, 1, 1, 2))


def _png_pass(raw: bytes, at: int, width: int, height: int, channels: int, bits: int) -> tuple[np.ndarray, int]:
    """Samples of one pass that begins at a byte, and where the next one does."""
    line, step = -(-width * channels * bits // 8), max(1, channels * bits // 8)
    filtered = np.frombuffer(raw, np.uint8, height * (1 + line), at).reshape(height, 1 + line)
    rows = np.zeros((height, line), np.uint8)
    above = np.zeros(line, np.int64)
    for y in range(height):
        above = _unfilter(int(filtered[y, 0]), filtered[y, 1:].astype(np.int64), above, step)
        rows[y] = above
    if bits >= 8:
        samples = rows.view(">u2" if bits == 16 else np.uint8).reshape(height, width, channels)
    else:
        unpacked = np.unpackbits(rows, axis=1).reshape(height, -1, bits)
        samples = (unpacked @ (1 << np.arange(bits - 1, -1, -1)))[:, :width, None]
    return samples, at + height * (1 + line)


def _unfilter(kind: int, line: np.ndarray, above: np.ndarray, step: int) -> np.ndarray:
    if kind == 0:
        return line
    if kind == 2:
        return (line + above) & 255
    if kind == 1:
        out = line.copy()
        for lane in range(min(step, len(line))):
            out[lane::step] = np.cumsum(line[lane::step]) & 255
        return out
    out = np.zeros_like(line)
    for x in range(len(line)):
        a = int(out[x - step]) if x >= step else 0
        b, c = int(above[x]), int(above[x - step]) if x >= step else 0
        if kind == 3:
            guess = (a + b) // 2
        else:
            p = a + b - c
            guess = min(((abs(p - a), 0, a), (abs(p - b), 1, b), (abs(p - c), 2, c)))[2]
        out[x] = (int(line[x]) + guess) & 255
    return out


def infer_pixel_format(rgba: np.ndarray) -> str:
    """GA8 if every pixel is gray, else ARGB."""
    gray = (rgba[..., 0] == rgba[..., 1]) & (rgba[..., 1] == rgba[..., 2])
    return "GA8" if bool(gray.all()) else "ARGB"


def row_stride(width: int, pixel_format: str) -> int:
    return stride_of(width, {"ARGB": 4, "GA8": 2, "RGBW": 8, "GA16": 4}[pixel_format])
