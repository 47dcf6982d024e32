"""Media columns: AVI files of motion JPEG, their intra frames and their shots.

A payload of bytes is kept without loss as grey frames: every byte is one 8x8 block whose samples
all have that value, which a DC coefficient with a step of 8 says exactly. The frames are
baseline JPEG with Huffman tables of their own: a code and its extra bits are nine bits for every
difference, and one bit ends a block, so that a frame's scan is read as fields of ten bits. Other
baseline frames, grey or YCbCr with any sampling, with their own or the standard's Huffman tables,
go through the general decoder. A file that cannot be read has an error instead. Shots are cut where the histogram of a frame
differs from the one before by more than what the frames before it did.
"""

from __future__ import annotations

import hashlib
import struct
import zlib
from collections.abc import Iterable, Iterator
from dataclasses import dataclass

import numpy as np
import pyarrow as pa
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F
from pyspark.sql import types as T

COLUMNS, ROWS = 16, 12  # blocks of a frame
FRAME = COLUMNS * ROWS  # payload bytes of a frame
FPS = 10
LEVELS = 16  # of a histogram
LOOK_BACK = 8  # differences that a threshold adapts to
#: The order in which a block's coefficients are stored, from the standard's rule.
ZIGZAG = sorted(range(64), key=lambda i: (i // 8 + i % 8, (i // 8 if (i // 8 + i % 8) % 2 else i % 8)))


def _marker(code: int, body: bytes) -> bytes:
    return struct.pack(">BBH", 0xFF, code, len(body) + 2) + body


def _huffman(kind: int, symbols: list[tuple[int, int]]) -> bytes:
    """A table's body from (code length, symbol) in order."""
    counts = bytes(sum(1 for n, _ in symbols if n == k) for k in range(1, 17))
    return bytes([kind]) + counts + bytes(s for _, s in symbols)


#: A category of s extra bits has a code of 9 - s bits.
_DC = [(9 - s, s) for s in range(8, -1, -1)]
HEADER = b"".join([
    b"\xff\xd8",
    _marker(0xDB, b"\x00" + bytes([8] * 64)),
    _marker(0xC0, struct.pack(">BHHB3B", 8, 8 * ROWS, 8 * COLUMNS, 1, 1, 0x11, 0)),
    _marker(0xC4, _huffman(0x00, _DC) + _huffman(0x10, [(1, 0)])),
    _marker(0xDA, bytes([1, 1, 0x00, 0, 63, 0])),
])
END = b"\xff\xd9"


def _fields() -> np.ndarray:
    """Ten bits for each difference from -255 to 255: code, extra bits, end of block."""
    out = []
    for d in range(-255, 256):
        s = abs(d).bit_length()
        code = ((1 << (8 - s)) - 1) << 1
        out.append((code << s | (d if d >= 0 else d + (1 << s) - 1)) << 1)
    return np.array(out, np.uint64)


FIELDS = _fields()


def scans(samples: np.ndarray) -> list[bytes]:
    """The stuffed scan of each row of ``FRAME`` samples."""
    v = samples.astype(np.int64)
    d = np.diff(v, axis=1, prepend=128)
    own = FIELDS[d + 255].reshape(len(v), -1, 4)
    words = own[:, :, 0] << np.uint64(30) | own[:, :, 1] << np.uint64(20) | own[:, :, 2] << np.uint64(10) | own[:, :, 3]
    data = words.astype(">u8").view(np.uint8).reshape(len(v), -1, 8)[:, :, 3:].reshape(len(v), -1)
    return [row.tobytes().replace(b"\xff", b"\xff\x00") for row in data]


def _list(kind: bytes, body: bytes) -> bytes:
    return b"LIST" + struct.pack("<I", len(body) + 4) + kind + body


def _chunk(kind: bytes, body: bytes) -> bytes:
    return kind + struct.pack("<I", len(body)) + body + b"\0" * (len(body) & 1)


def write_avi(frames: list[bytes], width: int = 8 * COLUMNS, height: int = 8 * ROWS, fps: int = FPS) -> bytes:
    """An AVI file of JPEG frames with an index."""
    n, largest = len(frames), max(map(len, frames), default=0)
    main = struct.pack("<14I", 1_000_000 // fps, largest * fps, 0, 0x10, n, 0, 1, largest, width, height, 0, 0, 0, 0)
    stream = b"vidsMJPG" + struct.pack("<10I4H", 0, 0, 0, 1, fps, 0, n, largest, 0xFFFFFFFF, 0, 0, 0, width, height)
    image = struct.pack("<IiiHH4sIiiII", 40, width, height, 1, 8, b"MJPG", width * height, 0, 0, 0, 0)
    head = _list(b"hdrl", _chunk(b"avih", main) + _list(b"strl", _chunk(b"strh", stream) + _chunk(b"strf", image)))
    body, index, at = [], [], 4
    for f in frames:
        c = _chunk(b"00dc", f)
        index.append(struct.pack("<4sIII", b"00dc", 0x10, at, len(f)))
        body.append(c)
        at += len(c)
    movie = _list(b"movi", b"".join(body)) + _chunk(b"idx1", b"".join(index))
    return b"RIFF" + struct.pack("<I", len(head) + len(movie) + 4) + b"AVI " + head + movie


def payload_of(text: str | None) -> bytes:
    """A text's UTF-8 bytes, with spaces up to a positive multiple of ``FRAME``."""
    data = (text or "").encode("utf-8", "surrogatepass")
    return data + b" " * (FRAME * max(1, -(-len(data) // FRAME)) - len(data))


def store(payload: bytes) -> bytes:
    """A payload as an AVI file."""
    samples = np.frombuffer(payload, np.uint8).reshape(-1, FRAME)
    return write_avi([HEADER + s + END for s in scans(samples)])


@dataclass(frozen=True)
class Movie:
    fps: float
    frames: list[bytes]


def _parts(data: bytes, at: int, end: int) -> Iterator[tuple[bytes, int, int]]:
    """(kind, begin, end) of the chunks of a stretch; of lists the kind is that of the list, and they
    begin behind it. What reaches beyond the stretch ends with it."""
    while at + 8 <= end:
        kind, size = data[at : at + 4], struct.unpack_from("<I", data, at + 4)[0]
        if kind in (b"LIST", b"RIFF"):
            yield data[at + 8 : at + 12], at + 12, min(end, at + 8 + size)
        else:
            yield kind, at + 8, min(end, at + 8 + size)
        at += 8 + size + (size & 1)


def _walked(data: bytes, at: int, end: int, kinds: tuple[bytes, ...]) -> Iterator[tuple[int, int]]:
    """Begin and end of a stream's chunks in a movie list, by walking it and the lists in it."""
    for kind, a, b in _parts(data, at, end):
        if kind == b"rec ":
            yield from _walked(data, a, b, kinds)
        elif kind in kinds:
            yield a, b


def _standard_index(data: bytes, at: int, end: int) -> Iterator[tuple[int, int]]:
    """Begin and end of the chunks that an index chunk of one stream lists."""
    per, _, kind, n, _, base = struct.unpack_from("<HBBI4sQ", data, at)
    if kind != 1 or per < 2 or at + 24 + 4 * per * n > end:
        raise ValueError("broken index in the AVI file")
    for k in range(n):
        offset, size = struct.unpack_from("<II", data, at + 24 + 4 * per * k)
        yield base + offset, base + offset + (size & 0x7FFFFFFF)


def read_avi(data: bytes) -> Movie:
    """The frames of an AVI file's first video stream, by its indexes.

    Large files are several RIFF parts: an index of indexes in the stream's header names an index
    chunk of each part. Without it the first part has its own index, or none; parts and lists
    without an index are walked. Frames that lie outside the file, or that an index has and the
    walked parts do not, are an error, never left out.
    """
    riffs = list(_parts(data, 0, len(data)))
    if data[:4] != b"RIFF" or not riffs or riffs[0][0] != b"AVI ":
        raise ValueError("not an AVI file")
    fps, stream, found, above = float(FPS), None, 0, []
    movies, index = [], None
    for form, begin, end in riffs:
        if form not in (b"AVI ", b"AVIX"):
            continue
        own = None
        for kind, a, b in _parts(data, begin, end):
            if kind == b"movi":
                own = (a, b)
            elif kind == b"idx1" and form == b"AVI ":
                index = np.frombuffer(data, "<u4", (b - a) // 16 * 4, a).reshape(-1, 4)
            elif kind == b"hdrl":
                for _, c, d in (x for x in _parts(data, a, b) if x[0] == b"strl"):
                    parts = {k: (e, f) for k, e, f in _parts(data, c, d)}
                    if b"strh" in parts and data[parts[b"strh"][0] : parts[b"strh"][0] + 4] == b"vids" and stream is None:
                        stream = found
                        scale, rate = struct.unpack_from("<II", data, parts[b"strh"][0] + 20)
                        fps = rate / scale if scale and rate else fps
                        if b"indx" in parts:
                            above = list(_index_of_indexes(data, *parts[b"indx"]))
                    found += 1
        if own is not None:
            movies.append(own)
    if not movies:
        raise ValueError("no movie in the AVI file")
    kinds = tuple(b"%02d" % (stream or 0) + x for x in (b"dc", b"db"))
    if above:
        places = [x for at in above for x in _standard_index(data, *at)]
    else:
        places = []
        for k, (a, b) in enumerate(movies):
            listed = [(c, d) for kind, c, d in _parts(data, a, b) if kind == b"ix%02d" % (stream or 0)]
            if listed:
                places += [x for at in listed for x in _standard_index(data, *at)]
            elif k == 0 and index is not None:
                rows = index[np.isin(index[:, 0], [int.from_bytes(x, "little") for x in kinds])][:, 2:].astype(np.int64)
                # offsets count from the list's kind, in some files from the start of the file
                base = a - 4 if not len(rows) or data[a - 4 + rows[0, 0] : a + rows[0, 0]] in kinds else 0
                places += [(base + 8 + o, base + 8 + o + n) for o, n in rows.tolist()]
            else:
                places += _walked(data, a, b, kinds)
    if any(a < 0 or b > len(data) for a, b in places):
        raise ValueError("a frame lies outside the AVI file")
    return Movie(fps, [data[a:b] for a, b in places])


def _index_of_indexes(data: bytes, at: int, end: int) -> Iterator[tuple[int, int]]:
    """Begin and end of the index chunks that a stream's header names; if it is an index of chunks
    itself, its own."""
    per, _, kind, n = struct.unpack_from("<HBBI", data, at)
    if kind == 1:
        yield at, end
        return
    if per < 4 or at + 24 + 16 * n > end:
        raise ValueError("broken index in the AVI file")
    for k in range(n):
        offset = struct.unpack_from("<Q", data, at + 24 + 4 * per * k)[0]
        if offset + 8 > len(data):
            raise ValueError("an index lies outside the AVI file")
        yield offset + 8, min(len(data), offset + 8 + struct.unpack_from("<I", data, offset + 4)[0])


def _standard_tables() -> dict[tuple[int, int], dict[tuple[int, int], int]]:
    """The Huffman tables of frames that bring none, as motion JPEG allows.

    The lists are fixed values of the standard; the longest codes are the other (run, size) pairs.
    """
    pairs = [0x00, 0xF0, *(run << 4 | size for run in range(16) for size in range(1, 11))]
    light = [
        0x01, 0x02, 0x03, 0x00, 0x04, 0x11, 0x05, 0x12, 0x21, 0x31, 0x41, 0x06, 0x13, 0x51, 0x61, 0x07, 0x22, 0x71, 0x14, 0x32, 0x81, 0x91, 0xA1, 0x08,
        0x23, 0x42, 0xB1, 0xC1, 0x15, 0x52, 0xD1, 0xF0, 0x24, 0x33, 0x62, 0x72, 0x82,
    ]
    tint = [
        0x00, 0x01, 0x02, 0x03, 0x11, 0x04, 0x05, 0x21, 0x31, 0x06, 0x12, 0x41, 0x51, 0x07, 0x61, 0x71, 0x13, 0x22, 0x32, 0x81, 0x08, 0x14, 0x42, 0x91,
        0xA1, 0xB1, 0xC1, 0x09, 0x23, 0x33, 0x52, 0xF0, 0x15, 0x62, 0x72, 0xD1, 0x0A, 0x16, 0x24, 0x34, 0xE1, 0x25, 0xF1,
    ]
    whole = lambda head: [*head, *sorted(set(pairs) - set(head))]
    counts = {
        (0, 0): [0, 1, 5, 1, 1, 1, 1, 1, 1], (0, 1): [0, 3, 1, 1, 1, 1, 1, 1, 1, 1, 1],
        (1, 0): [0, 2, 1, 3, 3, 2, 4, 3, 5, 5, 4, 4, 0, 0, 1, 125], (1, 1): [0, 2, 1, 2, 4, 4, 3, 4, 7, 5, 4, 4, 0, 1, 2, 119],
    }
    symbols = {(0, 0): range(12), (0, 1): range(12), (1, 0): whole(light), (1, 1): whole(tint)}
    return {k: _codes(counts[k], symbols[k]) for k in counts}


def _codes(counts: Iterable[int], symbols: Iterable[int]) -> dict[tuple[int, int], int]:
    """(length, code) -> symbol of a canonical table."""
    table, value, own = {}, 0, list(symbols)
    for n, k in enumerate(counts, 1):
        for _ in range(k):
            table[n, value] = own[len(table)]
            value += 1
        value <<= 1
    return table


STANDARD = _standard_tables()


@dataclass(frozen=True)
class Component:
    across: int  # blocks of a unit
    down: int
    steps: np.ndarray
    dc: dict[tuple[int, int], int]
    ac: dict[tuple[int, int], int]


@dataclass(frozen=True)
class Tables:
    """A baseline frame's header."""

    width: int
    height: int
    components: tuple[Component, ...]
    restart: int
    scan: int  # where the scan starts

    @property
    def blocks(self) -> int:
        """Blocks of the first component."""
        return -(-self.width // 8) * -(-self.height // 8)

    @property
    def field(self) -> int:
        """Bits of every block, if all blocks have the same number and end at once; else 0."""
        own = self.components[0]
        widths = {n + s for (n, _), s in own.dc.items()}
        return widths.pop() + min(own.ac)[0] if len(self.components) == 1 and len(widths) == 1 and set(own.ac.values()) == {0} and not self.restart else 0


def read_header(frame: bytes) -> Tables:
    """The header of a baseline frame up to its scan; ValueError for other frames."""
    if frame[:2] != b"\xff\xd8":
        raise ValueError("not a JPEG frame")
    at, steps, size, codes, restart = 2, {}, None, dict(STANDARD), 0
    while at + 4 <= len(frame):
        if frame[at] != 0xFF:
            raise ValueError("broken header")
        code, length = frame[at + 1], struct.unpack_from(">H", frame, at + 2)[0]
        body = frame[at + 4 : at + 2 + length]
        if length < 2 or len(body) < length - 2:
            raise ValueError("cut header")
        if code == 0xDB:
            while body:
                wide = body[0] >> 4
                table = np.frombuffer(body, ">u2" if wide else np.uint8, 64, 1).astype(np.int64)
                steps[body[0] & 15], body = table, body[1 + 64 * (1 + wide) :]
        elif code == 0xC0:
            depth, height, width, n = struct.unpack_from(">BHHB", body)
            if depth != 8 or n not in (1, 3) or not width or not height:
                raise ValueError("only grey and YCbCr frames of 8-bit samples are read")
            size = (width, height, [tuple(body[6 + 3 * i : 9 + 3 * i]) for i in range(n)])
        elif 0xC1 <= code <= 0xCF and code not in (0xC4, 0xC8, 0xCC):
            raise ValueError("only baseline frames are read")
        elif code == 0xC4:
            while body:
                counts = body[1:17]
                codes[body[0] >> 4, body[0] & 15] = _codes(counts, body[17 : 17 + sum(counts)])
                body = body[17 + sum(counts) :]
        elif code == 0xDD:
            restart = struct.unpack_from(">H", body)[0]
        elif code == 0xDA:
            if size is None or body[0] != len(size[2]):
                raise ValueError("only scans of all components are read")
            chosen = {body[1 + 2 * i]: body[2 + 2 * i] for i in range(body[0])}
            parts = []
            for name, sampling, table in size[2]:
                own = chosen[name]
                across, down = (sampling >> 4, sampling & 15) if len(size[2]) > 1 else (1, 1)
                if not 1 <= across <= 4 or not 1 <= down <= 4:
                    raise ValueError("broken header")
                parts.append(Component(across, down, steps[table], codes[0, own >> 4], codes[1, own & 15]))
            if any(c.across > parts[0].across or c.down > parts[0].down for c in parts):
                raise ValueError("only frames whose first component has all samples are read")
            return Tables(size[0], size[1], tuple(parts), restart, at + 2 + length)
        at += 2 + length
    raise ValueError("no scan in the frame")


def _table(codes: dict[tuple[int, int], int]) -> list[tuple[int, int]]:
    """(length, symbol) by the next 16 bits; length 0 where no code starts so."""
    out = [(0, 0)] * (1 << 16)
    for (n, code), s in codes.items():
        out[code << (16 - n) : (code + 1) << (16 - n)] = [(n, s)] * (1 << (16 - n))
    return out


def _windows(part: bytes) -> list[int]:
    """For each bit of a stuffed part of a scan the 16 bits from it on."""
    data = np.unpackbits(np.frombuffer(part.replace(b"\xff\x00", b"\xff") + b"\xff\xff", np.uint8)).astype(np.int64)
    n = len(data) - 15
    return sum(data[k : k + n] << (15 - k) for k in range(16)).tolist()


def _decode_scan(data: bytes, t: Tables) -> list[np.ndarray]:
    """The samples of each component's blocks (rows, columns, 8, 8), whatever the tables."""
    first = t.components[0]
    wide, high = -(-t.width // (8 * first.across)), -(-t.height // (8 * first.down))  # units
    if wide * high > 4 * len(data):  # a block has two bits at least
        raise ValueError("cut scan")
    out = [np.zeros((high * c.down, wide * c.across, 64)) for c in t.components]
    tables = [(_table(c.dc), _table(c.ac)) for c in t.components]
    order = ZIGZAG
    unit = 0
    for part in _split_restarts(data) if t.restart else [data]:
        bits, at, before = _windows(part), 0, [0] * len(t.components)
        for unit in range(unit, min(unit + t.restart, wide * high) if t.restart else wide * high):
            row, column = divmod(unit, wide)
            for i, c in enumerate(t.components):
                dc, ac = tables[i]
                for k in range(c.down * c.across):
                    block = out[i][row * c.down + k // c.across, column * c.across + k % c.across]
                    n, s = dc[bits[at]]
                    if not n or s > 15:
                        raise ValueError("broken scan")
                    at += n
                    if s:
                        v = bits[at] >> (16 - s)
                        before[i] += v if v >> (s - 1) else v - (1 << s) + 1
                        at += s
                    block[0], j = before[i], 1
                    while j < 64:
                        n, s = ac[bits[at]]
                        if not n:
                            raise ValueError("broken scan")
                        at += n
                        if not s:
                            break
                        j += s >> 4
                        if s := s & 15:
                            v = bits[at] >> (16 - s)
                            block[order[j]] = v if v >> (s - 1) else v - (1 << s) + 1
                            at += s
                        j += 1
        unit += 1
    if unit < wide * high:
        raise ValueError("cut scan")
    u = np.arange(8)
    basis = np.cos((2 * u[None, :] + 1) * u[:, None] * np.pi / 16) * np.where(u == 0, np.sqrt(0.125), 0.5)[:, None]
    planes = []
    for c, own in zip(t.components, out, strict=True):
        steps = np.zeros(64)
        steps[ZIGZAG] = c.steps
        pixels = np.einsum("ux,rcuv,vy->rcxy", basis, (own * steps).reshape(*own.shape[:2], 8, 8), basis)
        planes.append(np.clip(np.rint(pixels + 128), 0, 255).astype(np.uint8))
    return planes


def frame_pixels(frame: bytes) -> np.ndarray:
    """A frame's picture: (height, width) of a grey one, (height, width, 3) in RGB of a YCbCr one."""
    t = read_header(frame)
    planes = []
    for c, own in zip(t.components, _decode_scan(frame[t.scan : frame.rindex(END)], t), strict=True):
        plane = own.transpose(0, 2, 1, 3).reshape(own.shape[0] * 8, -1)
        plane = plane.repeat(t.components[0].down // c.down, axis=0).repeat(t.components[0].across // c.across, axis=1)
        planes.append(plane[: t.height, : t.width].astype(np.float64))
    if len(planes) == 1:
        return planes[0].astype(np.uint8)
    y, cb, cr = planes[0], planes[1] - 128, planes[2] - 128
    rgb = np.stack([y + 1.402 * cr, y - 0.344136 * cb - 0.714136 * cr, y + 1.772 * cb], axis=2)
    return np.clip(np.rint(rgb), 0, 255).astype(np.uint8)


def _split_restarts(data: bytes) -> list[bytes]:
    out, start = [], 0
    for i in np.flatnonzero(np.frombuffer(data, np.uint8) == 0xFF).tolist():
        if i + 1 < len(data) and 0xD0 <= data[i + 1] <= 0xD7:
            out.append(data[start:i])
            start = i + 2
    return [*out, data[start:]]


def decode_frames(frames: list[bytes]) -> list[np.ndarray] | np.ndarray:
    """Each frame's block values, of the first component: the sample of blocks that have one, else
    the blocks' means.

    Frames with the same header whose blocks all have the same number of bits are read together.
    """
    if not frames:
        return np.zeros((0, FRAME), np.uint8)
    t = read_header(frames[0])
    head = frames[0][: t.scan]
    if t.field == 10 and int(t.components[0].steps[0]) == 8 and len(END) + t.scan < len(frames[0]) and all(f.startswith(head) for f in frames):
        data = b"".join([f[t.scan : -2].replace(b"\xff\x00", b"\xff") for f in frames])
        if len(data) * 8 != len(frames) * (size := -(-t.blocks * 10 // 40) * 40):
            raise ValueError("cut scan")
        rows = np.frombuffer(data, np.uint8).reshape(len(frames), size // 40, 5)
        words = np.zeros((*rows.shape[:2], 8), np.uint8)
        words[:, :, 3:] = rows
        words = words.view(">u8")[:, :, 0].astype(np.uint64)
        own = np.stack([words >> np.uint64(s) & np.uint64(1023) for s in (30, 20, 10, 0)], axis=2).reshape(len(frames), -1)
        table = np.full(1024, 1 << 14, np.int64)
        for (n, code), s in t.components[0].dc.items():
            for x in range(1 << s):
                table[(code << s | x) << 1 if n + s == 9 else 0] = x if not s or x >> (s - 1) else x - (1 << s) + 1
        values = np.cumsum(table[own[:, : t.blocks]], axis=1) + 128
        if (values >> 8).any():
            raise ValueError("broken scan")
        return values.astype(np.uint8)
    out = []
    for f in frames:
        t = read_header(f)
        own = _decode_scan(f[t.scan : f.rindex(END)], t)[0][: -(-t.height // 8), : -(-t.width // 8)]
        out.append(np.rint(own.reshape(t.blocks, 64).mean(axis=1)).astype(np.uint8))
    return np.array(out) if len({len(o) for o in out}) == 1 else out


def histograms(values: np.ndarray | list[np.ndarray]) -> np.ndarray:
    """Counts of levels of each frame; of frames of other sizes, as if they had the first one's."""
    n = len(values)
    if not n:
        return np.zeros((0, LEVELS), np.int64)
    sizes = np.array([len(v) for v in values])
    flat = np.concatenate([np.asarray(v, dtype=np.int64) for v in values]) if isinstance(values, list) else np.asarray(values, dtype=np.int64).ravel()
    own = np.bincount(np.repeat(np.arange(n) * LEVELS, sizes) + (flat * LEVELS >> 8), minlength=n * LEVELS).reshape(n, LEVELS)
    return own if (sizes == sizes[0]).all() else own * (sizes[0] / np.maximum(sizes, 1))[:, None]


def cuts(values: np.ndarray | list[np.ndarray]) -> list[int]:
    """Frames that begin a new shot, by adaptive differences of histograms.

    The difference to the frame before has to pass an eighth of a frame's blocks, and 1.5 times the
    mean of the (up to eight) differences before it; the first one, of those after it. The only
    difference of two frames has to pass the eighth alone.
    """
    n = len(values)
    if n < 2:
        return []
    d = np.abs(np.diff(histograms(values), axis=0)).sum(axis=1)
    total = np.concatenate([[0], np.cumsum(d)])
    at = np.arange(n - 1)
    first = np.maximum(0, at - LOOK_BACK)
    seen, k = total[at] - total[first], at - first
    k[0] = len(after := d[1 : 1 + LOOK_BACK])
    seen[0] = after.sum()
    return (np.flatnonzero((8 * d > len(values[0])) & ((2 * d * k > 3 * seen) | (k == 0))) + 1).tolist()


_READ = T.StructType([
    T.StructField("payload_bytes", T.LongType()), T.StructField("payload_sha256", T.StringType()), T.StructField("tail_crc32", T.LongType()),
    T.StructField("media_bytes", T.LongType()), T.StructField("media_sha256", T.StringType()), T.StructField("n_frames", T.IntegerType()),
    T.StructField("fps", T.DoubleType()), T.StructField("cuts", T.ArrayType(T.IntegerType())),
    T.StructField("error", T.StringType()),
])


@F.arrow_udf(T.BinaryType())
def _store(texts: pa.Array) -> pa.Array:
    return pa.array([store(payload_of(t.as_py())) for t in texts], pa.binary())


@F.arrow_udf(_READ)
def _read(files: pa.Array) -> pa.Array:
    rows = []
    for f in files:
        data = f.as_py()
        if data is None:
            rows.append(None)
            continue
        try:
            movie = read_avi(data)
            values = decode_frames(movie.frames)
        except (ValueError, LookupError, struct.error) as e:  # what broken files lead to
            rows.append({"media_bytes": len(data), "media_sha256": hashlib.sha256(data).hexdigest(), "error": str(e) or type(e).__name__})
            continue
        payload = b"".join(np.asarray(v).tobytes() for v in values)
        rows.append({
            "payload_bytes": len(payload), "payload_sha256": hashlib.sha256(payload).hexdigest(), "tail_crc32": zlib.crc32(payload[-16:]),
            "media_bytes": len(data), "media_sha256": hashlib.sha256(data).hexdigest(), "n_frames": len(movie.frames), "fps": movie.fps, "cuts": cuts(values),
        })
    kinds = [("payload_bytes", pa.int64()), ("payload_sha256", pa.string()), ("tail_crc32", pa.int64()), ("media_bytes", pa.int64()), ("media_sha256", pa.string()), ("n_frames", pa.int32()), ("fps", pa.float64()), ("cuts", pa.list_(pa.int32())), ("error", pa.string())]
    return pa.array(rows, pa.struct(kinds))


def text_to_avi(text: Column) -> Column:
    """The AVI file of whole texts; null and empty texts are one frame of spaces."""
    return _store(text)


def read_media(media: Column) -> Column:
    """Struct of an AVI column: payload and file digests, frames, rate, cuts and ``error``.

    Null for null. A file that cannot be read (no AVI file, cut, not baseline) has its own size and
    digest, the error, and nulls. The payload is the frames' block values.
    """
    return _read(media)


def clips(r: Column) -> Column:
    """Timed clips of a read file: array of (clip, first_frame, n_frames, start_s, end_s).

    Every file with a frame has a clip; null and broken files have none.
    """
    starts, ends = F.concat(F.array(F.lit(0)), r["cuts"]), F.concat(r["cuts"], F.array(r["n_frames"]))

    def clip(z: Column, i: Column) -> Column:
        return F.struct(i.alias("clip"), z["a"].alias("first_frame"), (z["b"] - z["a"]).alias("n_frames"), (z["a"] / r["fps"]).alias("start_s"), (z["b"] / r["fps"]).alias("end_s"))

    own = F.transform(F.arrays_zip(starts.alias("a"), ends.alias("b")), clip)
    return F.when(r["n_frames"] > 0, own).otherwise(F.slice(own, 1, 0))


def clip_rows(media: DataFrame, key: str, column: str) -> DataFrame:
    """Timed clip rows ``(key, clip, first_frame, n_frames, start_s, end_s)`` of an AVI column.

    Every file with a frame has a clip; null and broken files have none.
    """
    rows = media.select(F.col(key), read_media(F.col(column)).alias("r"))
    return rows.select(key, F.explode(clips(F.col("r"))).alias("c")).select(key, "c.*")


def media_digests(docs: DataFrame) -> DataFrame:
    """Digests and shots of every document's text, stored as an AVI file and read back.

    Null texts count as empty; an empty text is one frame of spaces. Equal texts have equal
    values. One row per row, repeated rows too; an empty table gives an empty result; further
    columns are left out. No shuffle; files exist for one Arrow batch.
    """
    rows = docs.select("doc_id", F.coalesce(F.octet_length("text"), F.lit(0)).cast("long").alias("n_bytes"), read_media(text_to_avi(F.col("text"))).alias("r"))
    feature = F.concat_ws(";", F.concat(F.lit("frames="), F.col("r.n_frames")), F.concat(F.lit("cuts="), F.array_join(F.col("r.cuts").cast("array<string>"), ",")))
    return rows.select("doc_id", "n_bytes", "r.payload_bytes", "r.payload_sha256", "r.tail_crc32", "r.media_bytes", "r.media_sha256", feature.alias("feature"), clips(F.col("r")).alias("clips"))
