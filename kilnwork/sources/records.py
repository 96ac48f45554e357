"""The records inside catalog blocks: headers, keys, names, renditions, links, colours, gradients.

Everything here is little-endian.  Decoders return plain Python values; encoders
are their inverses.  What is not understood stays as bytes.
"""

from __future__ import annotations

import struct
from dataclasses import dataclass, field

#: Fixed values of the format: attribute names by id.
ATTRIBUTES = (
    "look", "element", "part", "size", "direction", "placeholder", "value", "appearance", "dimension1", "dimension2", "state", "layer", "scale",
    "localization", "presentationState", "idiom", "subtype", "identifier", "previousValue", "previousState", "sizeClassHorizontal", "sizeClassVertical",
    "memoryClass", "graphicsClass", "displayGamut", "deploymentTarget",
)
#: Pixel formats by the bytes on disk, and compressions by number.
PIXEL_FORMATS = {0: "none", **{int.from_bytes(k, "little"): v for k, v in ((b"BGRA", "ARGB"), (b" 8AG", "GA8"), (b" GVS", "SVG"), (b"ATAD", "DATA"), (b"GEPJ", "JPEG"), (b"FIEH", "HEIF"), (b" FDP", "PDF"), (b"WBGR", "RGBW"), (b"61AG", "GA16"))}}
COMPRESSIONS = ("uncompressed", "rle", "zlib", "lzvn", "lzfse", "jpeg-lzfse", "blurred", "astc", "palette-img", "hevc", "deepmap-lossless", "deepmap2")
#: Names with which RGBW and GA16 are printed, as any format without a name.
UNNAMED = ("RGBW", "GA16")
HEADER, METADATA, KEY_FORMAT, RENDITION, BITMAP, CHUNK, RAW, MULTISIZE, LINK, COLOUR = b"RATC", b"META", b"tmfk", b"ISTC", b"MLEC", b"KCBC", b"DWAR", b"SISM", b"KLNI", b"RLOC"
GRADIENT = b"ARGG"
SLICES, METRICS, COMPOSITION, TYPE_ID, BITMAP_INFO, ROW_STRIDE, REFERENCE, LINK_TAG = 0x3E9, 0x3EB, 0x3EC, 0x3ED, 0x3EE, 0x3EF, 0x3F0, 0x3F2
VECTOR_LAYOUT, IMAGE_LAYOUT, LINK_LAYOUT, ATLAS_LAYOUT, MULTISIZE_LAYOUT = 9, 12, 1003, 1004, 1010
BYTES_PER_PIXEL = {"ARGB": 4, "GA8": 2, "RGBW": 8, "GA16": 4}


class RecordError(ValueError):
    """Bytes that are no valid record."""


def attribute_name(number: int) -> str:
    return ATTRIBUTES[number] if number < len(ATTRIBUTES) else f"attr{number}"


def attribute_id(name: str) -> int:
    if name.startswith("attr") and name[4:].isdigit():
        return int(name[4:])
    if name not in ATTRIBUTES:
        raise RecordError(f"unknown attribute {name}")
    return ATTRIBUTES.index(name)


def pixel_format_name(code: int) -> str:
    return PIXEL_FORMATS.get(code) or f"0x{code:08x}"


def pixel_format_code(name: str) -> int | None:
    for code, known in PIXEL_FORMATS.items():
        if name == known:
            return code
    try:
        return int(name[2:], 16) if name.startswith("0x") else None
    except ValueError:
        return None


def compression_name(code: int) -> str:
    return COMPRESSIONS[code] if code < len(COMPRESSIONS) else str(code)


def compression_code(name: str) -> int | None:
    if name in COMPRESSIONS:
        return COMPRESSIONS.index(name)
    return int(name) if name.isdigit() else None


def stride_of(width: int, bytes_per_pixel: int) -> int:
    """Bytes of a row, a multiple of 32."""
    return -(-width * bytes_per_pixel // 32) * 32


def text_of(raw: bytes) -> str:
    return raw.split(b"\0", 1)[0].decode("utf-8", "replace")


def fixed(text: str, size: int) -> bytes:
    """Zero-padded; longer texts are cut, with a zero kept at the end."""
    return text.encode()[: size - 1].ljust(size, b"\0")


@dataclass
class CatalogHeader:
    coreui_version: int = 0
    storage_version: int = 0
    storage_timestamp: int = 0
    rendition_count: int = 0
    main_version_string: str = ""
    version_string: str = ""
    uuid: str = "0" * 32
    associated_checksum: int = 0
    schema_version: int = 0
    color_space_id: int = 0
    key_semantics: int = 0

    @staticmethod
    def parse(data: bytes) -> CatalogHeader:
        if data[:4] != HEADER or len(data) < 436:
            raise RecordError("not a catalog header")
        return CatalogHeader(*struct.unpack_from("<4I", data, 4), text_of(data[20:148]), text_of(data[148:404]), data[404:420].hex(), *struct.unpack_from("<4I", data, 420))

    def pack(self) -> bytes:
        raw = bytes.fromhex(self.uuid)
        if len(raw) != 16:
            raise RecordError("a uuid has 32 hexadecimal digits")
        head = struct.pack("<4s4I", HEADER, self.coreui_version, self.storage_version, self.storage_timestamp, self.rendition_count)
        return head + fixed(self.main_version_string, 128) + fixed(self.version_string, 256) + raw + struct.pack("<4I", self.associated_checksum, self.schema_version, self.color_space_id, self.key_semantics)


def parse_metadata(data: bytes | None) -> list[str] | None:
    """Thinning arguments, platform version, platform and tool."""
    if not data:
        return None
    if data[:4] != METADATA or len(data) < 1028:
        raise RecordError("not extended metadata")
    return [text_of(data[4 + 256 * k : 260 + 256 * k]) for k in range(4)]


def pack_metadata(fields: list[str] | None) -> bytes:
    return METADATA + b"".join(fixed(x, 256) for x in fields or [""] * 4)


def parse_key_format(data: bytes) -> list[str]:
    if data[:4] != KEY_FORMAT or len(data) < 12:
        raise RecordError("not a key format")
    count = struct.unpack_from("<I", data, 8)[0]
    if 12 + 4 * count > len(data):
        raise RecordError("a key format is too short")
    return [attribute_name(x) for x in struct.unpack_from(f"<{count}I", data, 12)]


def pack_key_format(names: list[str]) -> bytes:
    return KEY_FORMAT + struct.pack(f"<II{len(names)}I", 0, len(names), *map(attribute_id, names))


def key_of(raw: bytes, key_format: list[str]) -> dict[str, int]:
    """Sparse key: the attributes that are not 0."""
    if len(raw) != 2 * len(key_format):
        raise RecordError("a key's length differs from the key format's")
    return {n: v for n, v in zip(key_format, struct.unpack(f"<{len(key_format)}H", raw), strict=True) if v}


def key_bytes(key: dict[str, int], key_format: list[str]) -> bytes:
    return struct.pack(f"<{len(key_format)}H", *(key.get(n, 0) for n in key_format))


def parse_facet(data: bytes) -> tuple[int, int, dict[str, int]]:
    """Hotspot x and y, and the attributes."""
    x, y, count = struct.unpack_from("<3H", data)
    if 6 + 4 * count > len(data):
        raise RecordError("a facet is too short")
    pairs = struct.unpack_from(f"<{2 * count}H", data, 6)
    return x, y, {attribute_name(a): v for a, v in zip(pairs[::2], pairs[1::2], strict=True)}


def pack_facet(x: int, y: int, attributes: dict[str, int]) -> bytes:
    pairs = sorted((attribute_id(n), v) for n, v in attributes.items())
    return struct.pack("<3H", x, y, len(pairs)) + b"".join(struct.pack("<HH", *p) for p in pairs)


def short_id(data: bytes) -> int:
    """A dictionary's id; too short a value reads as 0."""
    return int.from_bytes(data[:2], "little") if len(data) >= 2 else 0


@dataclass
class Rendition:
    """A rendition's fixed header, tagged records and payload."""

    version: int = 1
    flags: int = 0
    width: int = 0
    height: int = 0
    scale: int = 0
    pixel_format: int = 0
    color_space_id: int = 0
    modified: int = 0
    layout: int = 0
    name: bytes = b""
    unknown_a: int = 1
    unknown_b: int = 0
    tlvs: list[tuple[int, bytes]] = field(default_factory=list)
    payload: bytes = b""

    @staticmethod
    def parse(data: bytes) -> Rendition:
        out = Rendition.parse_header(data)
        size, payload = struct.unpack_from("<I8xI", data, 168)
        if 184 + size + payload != len(data):
            raise RecordError("a rendition's lengths don't add up")
        at = 184
        while at < 184 + size:
            if at + 8 > 184 + size:
                raise RecordError("a tagged record is cut")
            tag, length = struct.unpack_from("<II", data, at)
            if at + 8 + length > 184 + size:
                raise RecordError("a tagged record is too long")
            out.tlvs.append((tag, data[at + 8 : at + 8 + length]))
            at += 8 + length
        out.payload = data[184 + size :]
        return out

    @staticmethod
    def parse_header(data: bytes) -> Rendition:
        """Only the fixed part: names and sizes without records and payload."""
        if data[:4] != RENDITION or len(data) < 184:
            raise RecordError("not a rendition")
        version, flags, width, height, scale, pixel, space, modified, layout = struct.unpack_from("<8IH", data, 4)
        a, b = struct.unpack_from("<II", data, 172)
        return Rendition(version, flags, width, height, scale, pixel, space, modified, layout, data[40:168].split(b"\0", 1)[0], a, b)

    def pack(self) -> bytes:
        records = b"".join(struct.pack("<II", tag, len(raw)) + raw for tag, raw in self.tlvs)
        head = struct.pack("<4s8IHH", RENDITION, self.version, self.flags, self.width, self.height, self.scale, self.pixel_format, self.color_space_id, self.modified, self.layout, 0)
        tail = struct.pack("<IIII", len(records), self.unknown_a, self.unknown_b, len(self.payload))
        return head + self.name[:127].ljust(128, b"\0") + tail + records + self.payload

    def tlv(self, tag: int) -> bytes | None:
        return next((raw for t, raw in self.tlvs if t == tag), None)

    def stride(self) -> int:
        """Declared bytes of a row, else derived."""
        raw = self.tlv(ROW_STRIDE)
        if raw is not None and len(raw) == 4:
            return int.from_bytes(raw, "little")
        return stride_of(self.width, BYTES_PER_PIXEL.get(pixel_format_name(self.pixel_format), 4))

    def stride_consistent(self) -> bool:
        size = BYTES_PER_PIXEL.get(pixel_format_name(self.pixel_format))
        return size is not None and self.stride() == stride_of(self.width, size)


def slices_of(raw: bytes) -> list[tuple[int, int, int, int]] | None:
    if len(raw) < 4 or len(raw) != 4 + 16 * int.from_bytes(raw[:4], "little"):
        return None
    return [struct.unpack_from("<4I", raw, 4 + 16 * k) for k in range((len(raw) - 4) // 16)]


def pack_slices(rects: list[tuple[int, int, int, int]]) -> bytes:
    return struct.pack("<I", len(rects)) + b"".join(struct.pack("<4I", *r) for r in rects)


def metrics_of(raw: bytes) -> list[int] | None:
    """Insets top, left, bottom, right, then width and height; only the one-entry shape."""
    return list(struct.unpack_from("<6I", raw, 4)) if len(raw) == 28 and raw[:4] == b"\x01\0\0\0" else None


def pack_metrics(values: list[int]) -> bytes:
    return struct.pack("<7I", 1, *values)


def composition_of(raw: bytes) -> tuple[int, float] | None:
    return struct.unpack("<If", raw) if len(raw) == 8 else None


def pack_composition(mode: int, opacity: float) -> bytes:
    return struct.pack("<If", mode, opacity)


@dataclass
class Link:
    x: int
    y: int
    width: int
    height: int
    layout: int
    key: dict[str, int]
    flags: int = 0

    @staticmethod
    def parse(raw: bytes) -> Link | None:
        if raw[:4] != LINK or len(raw) < 30:
            return None
        flags, x, y, w, h, layout, size = struct.unpack_from("<5IHI", raw, 4)
        if 30 + size > len(raw):
            return None
        pairs = struct.unpack_from(f"<{size // 4 * 2}H", raw, 30)
        key: dict[str, int] = {}
        for a, v in zip(pairs[::2], pairs[1::2], strict=True):
            if a == 0:
                break
            key[attribute_name(a)] = v
        return Link(x, y, w, h, layout, key, flags)

    def pack(self) -> bytes:
        pairs = [*sorted((attribute_id(n), v) for n, v in self.key.items()), (0, 0)]
        return LINK + struct.pack("<5IHI", self.flags, self.x, self.y, self.width, self.height, self.layout, 4 * len(pairs)) + b"".join(struct.pack("<HH", *p) for p in pairs)


def multisize_of(payload: bytes) -> list[tuple[int, int, int]] | None:
    if payload[:4] != MULTISIZE or len(payload) < 12:
        return None
    count = int.from_bytes(payload[8:12], "little")
    if 12 + 12 * count > len(payload):
        return None
    return [struct.unpack_from("<3I", payload, 12 + 12 * k) for k in range(count)]


def pack_multisize(sizes: list[tuple[int, int, int]]) -> bytes:
    return MULTISIZE + struct.pack("<II", 1, len(sizes)) + b"".join(struct.pack("<3I", *s) for s in sizes)


@dataclass
class Colour:
    space: int
    components: list[float]
    system: str | None = None
    extra: bytes = b""

    @staticmethod
    def parse(payload: bytes) -> Colour | None:
        if payload[:4] != COLOUR or len(payload) < 16:
            return None
        _, space, count = struct.unpack_from("<3I", payload, 4)
        if 16 + 8 * count > len(payload):
            return None
        out = Colour(space, list(struct.unpack_from(f"<{count}d", payload, 16)))
        rest = payload[16 + 8 * count :]
        if rest[:4] == COLOUR and len(rest) >= 12 and 12 + (size := int.from_bytes(rest[8:12], "little")) <= len(rest):
            try:
                out.system, rest = rest[12 : 12 + size].decode(), rest[12 + size :]
            except UnicodeDecodeError:
                pass
        out.extra = rest
        return out

    def pack(self) -> bytes:
        raw = COLOUR + struct.pack(f"<3I{len(self.components)}d", 1, self.space, len(self.components), *self.components)
        if self.system is not None:
            name = self.system.encode()
            raw += COLOUR + struct.pack("<II", 1, len(name)) + name
        return raw + self.extra


@dataclass
class Gradient:
    kind: int
    reserved: int
    axis: tuple[float, float, float, float]
    stops: list[tuple[float, str]]
    trailing: bytes = b""

    @staticmethod
    def parse(payload: bytes) -> Gradient | None:
        if payload[:4] != GRADIENT or len(payload) < 32:
            return None
        count, kind, reserved = struct.unpack_from("<3I", payload, 4)
        axis, stops, at = struct.unpack_from("<4f", payload, 16), [], 32
        for _ in range(count):
            if at + 8 > len(payload):
                return None
            location, size = struct.unpack_from("<fI", payload, at)
            if at + 8 + size > len(payload):
                return None
            stops.append((location, text_of(payload[at + 8 : at + 8 + size])))
            at += 8 + size
        return Gradient(kind, reserved, axis, stops, payload[at:])

    def pack(self) -> bytes:
        out = GRADIENT + struct.pack("<3I4f", len(self.stops), self.kind, self.reserved, *self.axis)
        for location, name in self.stops:
            raw = name.encode() + b"\0"
            out += struct.pack("<fI", location, len(raw)) + raw
        return out + self.trailing


def content_kind(r: Rendition) -> str:
    """Which of the kinds of content a rendition holds, by ordered rules on layout, records and payload magic."""
    magic = r.payload[:4]
    if magic == MULTISIZE and multisize_of(r.payload) is not None:
        return "multisize"
    link = r.tlv(LINK_TAG)
    if link is not None and Link.parse(link) is not None:
        return "link"
    if magic == BITMAP:
        return "image" if r.stride_consistent() else "raw_payload"
    if magic == RAW:
        return "data"
    if magic == COLOUR and Colour.parse(r.payload) is not None:
        return "color"
    if magic == GRADIENT and Gradient.parse(r.payload) is not None:
        return "gradient"
    return "raw_payload"


def sniff(data: bytes) -> str | None:
    """Embedded container of a payload, by its first bytes."""
    head = data[:16].lstrip()
    if head.startswith((b"<svg", b"<?xml")):
        return "svg"
    if data[:3] == b"\xff\xd8\xff":
        return "jpg"
    if data[:8] == b"\x89PNG\r\n\x1a\n":
        return "png"
    if data[4:8] == b"ftyp" and data[8:12] in (b"heic", b"heix", b"hevc", b"mif1", b"msf1"):
        return "heic"
    return "pdf" if data[:4] == b"%PDF" else None
