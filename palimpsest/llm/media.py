"""Media columns: motion-JPEG in AVI.

``encode_avi`` stores bytes losslessly as a motion-JPEG video: each MCU of a frame holds 3 blocks of 64 quantised DCT
coefficients, one byte each, shifted past zero so that no coefficient is 0. The frames' Huffman tables give every
coefficient a code of fixed length (code and magnitude bits together), so that whole frames are coded and decoded as
bit matrices. Any baseline decoder reads the files; ``decode_frames`` reads them back by way of the RIFF index.

``decode_frame`` is a general decoder of baseline frames (any Huffman tables, sampling factors, restart intervals) down
to the coefficients and, by the inverse transform, to samples; tables of fixed length take the matrix way. Both ways
give the same samples. ``read_avi`` reads files of either kind; frames that store no payload have null payload columns.

Shots: a frame's difference from the one before is the L1 distance of the histograms of their decoded samples (of all
components); a cut is where it exceeds the mean plus CUT_SIGMAS standard deviations of the last WINDOW differences that
were no cuts, and CUT_LEAST at least. Runs between cuts are clips with times from the frame rate.

Defined results: null and empty texts are one group of blanks; ties and repeated rows give equal values; media that are
null, no AVI, or hold a frame that is no whole baseline JPEG give null features; an empty table gives an empty result.
Other columns are not read.
"""

from __future__ import annotations

import hashlib
import struct
import zlib
from collections.abc import Iterator
from functools import lru_cache

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from palimpsest.session import table, written

GROUP = 192
#: MCUs of a frame, 8 x 8 pixels each, in a square.
SIDE = 4
MCUS = SIDE * SIDE
FRAME_BYTES = MCUS * GROUP
#: Bits of an MCU: 3 blocks of a DC code of 10 and 63 AC codes of 9 bits.
AC_BITS, DC_BITS = 9, 10
BLOCK_BITS = DC_BITS + 63 * AC_BITS
SCAN_BYTES = MCUS * 3 * BLOCK_BITS // 8
FPS = 25
BINS = 32
WINDOW, CUT_SIGMAS, CUT_LEAST = 8, 3.0, 0.25
#: Frames coded at a time.
FRAMES = 256


def _codes() -> tuple[np.ndarray, np.ndarray]:
    """AC code words by byte, DC code words by difference + 256. Size s has the code 1..10 of total - s bits."""
    ac = np.zeros(256, np.int64)
    for b in range(256):
        v = b - 127 if b >= 128 else b - 128
        s = abs(v).bit_length()
        n = AC_BITS - s
        ac[b] = (((1 << n) - 2) << s) | (v if v > 0 else v + (1 << s) - 1)
    dc = np.zeros(513, np.int64)
    for d in range(-256, 257):
        s = abs(d).bit_length()
        n = DC_BITS - s
        code = (1 << n) - 2
        dc[d + 256] = (code << s) | (d if d > 0 else d + (1 << s) - 1 if s else 0)
    return ac, dc


AC_CODE, DC_CODE = _codes()
AC_ROWS = ((AC_CODE[:, None] >> np.arange(AC_BITS - 1, -1, -1)) & 1).astype(np.uint8)
DC_ROWS = ((DC_CODE[:, None] >> np.arange(DC_BITS - 1, -1, -1)) & 1).astype(np.uint8)
AC_BYTE = np.zeros(1 << AC_BITS, np.uint8)
AC_BYTE[AC_CODE] = np.arange(256)
DC_DIFF = np.zeros(1 << DC_BITS, np.int64)
DC_DIFF[DC_CODE] = np.arange(-256, 257)


def _segment(marker: int, body: bytes) -> bytes:
    return struct.pack(">BBH", 0xFF, marker, len(body) + 2) + body


def _table(kind: int, sizes: list[int], total: int) -> bytes:
    """DHT body: the symbol of size s has a code of total - s bits."""
    lengths = [0] * 16
    for s in sizes:
        lengths[total - s - 1] += 1
    return bytes([kind, *lengths, *sorted(sizes, reverse=True)])


def _header() -> bytes:
    side = SIDE * 8
    zigzag_ones = bytes([0] + [1] * 64)
    frame = struct.pack(">BHHB", 8, side, side, 3) + b"".join(bytes([c, 0x11, 0]) for c in (1, 2, 3))
    scan = bytes([3, 1, 0, 2, 0, 3, 0, 0, 63, 0])
    return (
        b"\xff\xd8"
        + _segment(0xDB, zigzag_ones)
        + _segment(0xC0, frame)
        + _segment(0xC4, _table(0x00, list(range(10)), DC_BITS))
        + _segment(0xC4, _table(0x10, list(range(1, 9)), AC_BITS))
        + _segment(0xDA, scan)
    )


HEADER = _header()


def code_frames(samples: np.ndarray) -> list[bytes]:
    """(frames, MCUS * 192) bytes to JPEG files."""
    out = []
    for i in range(0, len(samples), FRAMES):
        x = samples[i : i + FRAMES].reshape(-1, MCUS, 3, 64)
        value = x[..., 0].astype(np.int64) - np.where(x[..., 0] >= 128, 127, 128)
        diff = np.diff(value, axis=1, prepend=0)
        bits = np.empty((*x.shape[:3], BLOCK_BITS), np.uint8)
        bits[..., :DC_BITS] = DC_ROWS[diff + 256]
        bits[..., DC_BITS:] = AC_ROWS[x[..., 1:]].reshape(*x.shape[:3], -1)
        packed = np.packbits(bits.reshape(len(x), -1), axis=1)
        out += [HEADER + row.tobytes().replace(b"\xff", b"\xff\x00") + b"\xff\xd9" for row in packed]
    return out


def code_payload(payload: bytes) -> list[bytes]:
    data = np.frombuffer(payload, np.uint8)
    whole = np.full(-(-len(data) // FRAME_BYTES) * FRAME_BYTES, 32, np.uint8)
    whole[: len(data)] = data
    return code_frames(whole.reshape(-1, FRAME_BYTES))


def _chunk(name: bytes, body: bytes) -> bytes:
    return name + struct.pack("<I", len(body)) + body + b"\0" * (len(body) & 1)


def _list(name: bytes, body: bytes) -> bytes:
    return _chunk(b"LIST", name + body)


def write_avi(frames: list[bytes], payload_bytes: int, fps: int = FPS) -> bytes:
    """An AVI file with an index (idx1); the payload's length is in an INFO comment."""
    side, n = SIDE * 8, len(frames)
    most = max(map(len, frames), default=0)
    avih = struct.pack("<14I", 1_000_000 // fps, most * fps, 0, 0x10, n, 0, 1, most, side, side, 0, 0, 0, 0)
    strh = struct.pack("<4s4sIHHIIIIIIIIhhhh", b"vids", b"MJPG", 0, 0, 0, 0, 1, fps, 0, n, most, 0xFFFFFFFF, 0, 0, 0, side, side)
    strf = struct.pack("<IiiHH4sIiiII", 40, side, side, 1, 24, b"MJPG", side * side * 3, 0, 0, 0, 0)
    head = _list(b"hdrl", _chunk(b"avih", avih) + _list(b"strl", _chunk(b"strh", strh) + _chunk(b"strf", strf)))
    info = _list(b"INFO", _chunk(b"ICMT", f"payload={payload_bytes}".encode() + b"\0"))
    movi, index, at = [], [], 4
    for f in frames:
        c = _chunk(b"00dc", f)
        movi.append(c)
        index.append(struct.pack("<4sIII", b"00dc", 0x10, at, len(f)))
        at += len(c)
    return _chunk(b"RIFF", b"AVI " + head + info + _list(b"movi", b"".join(movi)) + _chunk(b"idx1", b"".join(index)))


class Avi:
    """What a file's RIFF structure says: frame places from idx1 (or, without one, from the movi list), rate, payload."""

    def __init__(self, raw: bytes):
        if raw[:4] != b"RIFF" or raw[8:12] != b"AVI ":
            raise ValueError("no AVI file")
        self.raw, self.fps, self.payload_bytes = raw, float(FPS), None
        self.frames: list[tuple[int, int]] = []
        self.movi: tuple[int, int] | None = None
        index = None
        for name, a, n in self._chunks(12, min(len(raw), 8 + struct.unpack_from("<I", raw, 4)[0])):
            kind = raw[a : a + 4] if name == b"LIST" else name
            if kind == b"hdrl":
                for sub, sa, _ in self._chunks(a + 4, a + n):
                    if sub == b"avih":
                        self.fps = 1e6 / max(1, struct.unpack_from("<I", raw, sa)[0])
            elif kind == b"INFO":
                for sub, sa, sn in self._chunks(a + 4, a + n):
                    text = raw[sa : sa + sn].rstrip(b"\0")
                    if sub == b"ICMT" and text.startswith(b"payload="):
                        self.payload_bytes = int(text[8:])
            elif kind == b"movi":
                self.movi = (a, n)
            elif kind == b"idx1":
                index = (a, n)
        if self.movi is None:
            return
        if index:
            entries = [struct.unpack_from("<4sIII", raw, index[0] + i) for i in range(0, index[1] - 15, 16)]
            # offsets count from the list's name or from the file's start, as the first entry shows
            base = self.movi[0] if entries and raw[self.movi[0] + entries[0][2] : self.movi[0] + entries[0][2] + 4] == entries[0][0] else 0
            self.frames = [(base + at + 8, size) for name, _, at, size in entries if name[2:] in (b"dc", b"db")]
        else:
            self.frames = [(a, n) for name, a, n in self._chunks(self.movi[0] + 4, sum(self.movi)) if name[2:] in (b"dc", b"db")]

    def _chunks(self, at: int, end: int) -> Iterator[tuple[bytes, int, int]]:
        while at + 8 <= end:
            name, n = struct.unpack_from("<4sI", self.raw, at)
            yield name, at + 8, n
            at += 8 + n + (n & 1)

    def frame(self, i: int) -> bytes:
        a, n = self.frames[i]
        return self.raw[a : a + n]


def read_scans(scans: list[bytes]) -> np.ndarray:
    """Entropy-coded bytes of frames with this module's tables, to (frames, MCUS * 192) bytes."""
    out = np.empty((len(scans), FRAME_BYTES), np.uint8)
    for i in range(0, len(scans), FRAMES):
        some = np.frombuffer(b"".join(scans[i : i + FRAMES]), np.uint8).reshape(-1, SCAN_BYTES)
        bits = np.unpackbits(some, axis=1).reshape(-1, MCUS, 3, BLOCK_BITS)
        ac = bits[..., DC_BITS:].reshape(*bits.shape[:3], 63, AC_BITS)
        code = np.zeros(ac.shape[:-1], np.uint16)
        for k in range(AC_BITS):
            code = (code << 1) | ac[..., k]
        dc = np.zeros(bits.shape[:3], np.uint16)
        for k in range(DC_BITS):
            dc = (dc << 1) | bits[..., k]
        value = np.cumsum(DC_DIFF[dc], axis=1)
        x = np.empty((*bits.shape[:3], 64), np.uint8)
        x[..., 0] = value + np.where(value > 0, 127, 128)
        x[..., 1:] = AC_BYTE[code]
        out[i : i + FRAMES] = x.reshape(len(some), -1)
    return out


def scan_of(frame: bytes) -> bytes:
    if not frame.startswith(HEADER) or not frame.endswith(b"\xff\xd9"):
        raise ValueError("no frame of the fixed-length tables")
    scan = frame[len(HEADER) : -2].replace(b"\xff\x00", b"\xff")
    if len(scan) != SCAN_BYTES:
        raise ValueError("a frame is cut off")
    return scan


ZIGZAG = sorted(range(64), key=lambda i: (i // 8 + i % 8, (i // 8 if (i // 8 + i % 8) % 2 else i % 8)))
#: Bits after the point in INVERSE.
POINT = 16


def _inverse() -> np.ndarray:
    """(64, 64) inverse transform from zigzag order to pixels, of whole numbers: products are exact in any order."""
    basis = np.array([[(np.sqrt(0.125) if u == 0 else 0.5) * np.cos((2 * x + 1) * u * np.pi / 16) for x in range(8)] for u in range(8)])
    return np.round(np.einsum("ux,vy->uvxy", basis, basis).reshape(64, 64)[ZIGZAG] * (1 << POINT))


INVERSE = _inverse()


def samples_of(coefficients: np.ndarray) -> np.ndarray:
    """(blocks, 64) dequantised coefficients in zigzag order to (blocks, 64) samples."""
    return np.clip(np.floor((coefficients.astype(np.float64) @ INVERSE) / (1 << POINT) + 0.5) + 128, 0, 255).astype(np.uint8)


def samples_of_bytes(frames: np.ndarray) -> np.ndarray:
    """(frames, MCUS * 192) stored bytes to as many samples of this module's frames, block by block."""
    out = np.empty_like(frames)
    for i in range(0, len(frames), FRAMES):
        x = frames[i : i + FRAMES].astype(np.int16)
        out[i : i + FRAMES] = samples_of((x - np.where(x >= 128, 127, 128)).reshape(-1, 64)).reshape(x.shape)
    return out


@lru_cache(64)
def lookup(lengths: bytes, symbols: bytes) -> list[tuple[int, int]]:
    """(bits of the code, symbol) by the next 16 bits; 0 bits where no code begins so."""
    if len(symbols) < sum(lengths):
        raise ValueError("a table is cut off")
    out, place, symbol = [(0, 0)] * (1 << 16), 0, iter(symbols)
    for n in range(1, 17):
        for _ in range(lengths[n - 1]):
            width = 1 << (16 - n)
            out[place : place + width] = [(n, next(symbol))] * width
            place += width
    if len(out) != 1 << 16:
        raise ValueError("no such code")
    return out


def _usual() -> dict[int, tuple[bytes, bytes]]:
    """The tables of the standard's annex K, which motion-JPEG frames may leave out."""
    dc = bytes(range(12))
    luma = bytes.fromhex(
        "01020300041105122131410613516107227114328191a1082342b1c11552d1f02433627282090a161718191a25262728292a3435363738393a434445464748494a535455565758595a"
        "636465666768696a737475767778797a838485868788898a92939495969798999aa2a3a4a5a6a7a8a9aab2b3b4b5b6b7b8b9bac2c3c4c5c6c7c8c9cad2d3d4d5d6d7d8d9dae1e2e3e4"
        "e5e6e7e8e9eaf1f2f3f4f5f6f7f8f9fa"
    )
    chroma = bytes.fromhex(
        "000102031104052131061241510761711322328108144291a1b1c109233352f0156272d10a162434e125f11718191a262728292a35363738393a434445464748494a53545556575859"
        "5a636465666768696a737475767778797a82838485868788898a92939495969798999aa2a3a4a5a6a7a8a9aab2b3b4b5b6b7b8b9bac2c3c4c5c6c7c8c9cad2d3d4d5d6d7d8d9dae2e3"
        "e4e5e6e7e8e9eaf2f3f4f5f6f7f8f9fa"
    )
    return {
        0x00: (bytes([0, 1, 5, 1, 1, 1, 1, 1, 1, 0, 0, 0, 0, 0, 0, 0]), dc),
        0x01: (bytes([0, 3, 1, 1, 1, 1, 1, 1, 1, 1, 1, 0, 0, 0, 0, 0]), dc),
        0x10: (bytes([0, 2, 1, 3, 3, 2, 4, 3, 5, 5, 4, 4, 0, 0, 1, 125]), luma),
        0x11: (bytes([0, 2, 1, 2, 4, 4, 3, 4, 7, 5, 4, 4, 0, 1, 2, 119]), chroma),
    }


USUAL = _usual()


def _scan(data: list[bytes], comps: list[dict], across: int, down: int, restart: int) -> None:
    """Decodes a scan's parts (between restart markers) into its components' grids of coefficients."""
    if len(comps) == 1:  # a scan of one component has its own blocks only, a block an MCU
        across, down = comps[0]["across"], comps[0]["down"]
        places = [[(comps[0], 0, 0)]]
        step = [(1, 1)]
    else:
        places = [[(c, y, x) for y in range(c["v"]) for x in range(c["h"])] for c in comps]
        step = [(c["v"], c["h"]) for c in comps]
    part, p, end, peek, last = -1, 0, 0, [], []
    for mcu in range(across * down):
        if part < 0 or restart and mcu % restart == 0:
            part += 1
            if part >= len(data):
                raise ValueError("a frame is cut off")
            raw = np.frombuffer(data[part].replace(b"\xff\x00", b"\xff") + b"\xff" * 16, np.uint8).astype(np.int64)
            word = raw[:-2] << 16 | raw[1:-1] << 8 | raw[2:]
            peek = ((word[:, None] >> np.arange(8, 0, -1)) & 0xFFFF).ravel().tolist()
            p, end, last = 0, 8 * (len(raw) - 16), [0] * len(comps)
        row, col = divmod(mcu, across)
        for j, blocks in enumerate(places):
            for c, y, x in blocks:
                dc, ac, block = c["dc"], c["ac"], c["grid"][row * step[j][0] + y][col * step[j][1] + x]
                n, size = dc[peek[p]]
                p += n
                if not n or size > 15:
                    raise ValueError("no such code")
                if size:
                    v = peek[p] >> (16 - size)
                    p += size
                    last[j] += v if v >> (size - 1) else v - (1 << size) + 1
                block[0], k = last[j], 1
                while k < 64:
                    n, rs = ac[peek[p]]
                    p += n
                    if not n:
                        raise ValueError("no such code")
                    run, size = rs >> 4, rs & 15
                    if not size and run != 15:
                        break
                    k += run
                    if size:
                        if k > 63:
                            raise ValueError("a block is too long")
                        v = peek[p] >> (16 - size)
                        p += size
                        block[k] = v if v >> (size - 1) else v - (1 << size) + 1
                    k += 1
                if p > end:
                    raise ValueError("a frame is cut off")


def decode_frame(frame: bytes) -> tuple[list[np.ndarray], list[np.ndarray]]:
    """A baseline JPEG to each component's (blocks, 64) coefficients (zigzag order, row by row) and its sample plane.

    Any quantisation and Huffman tables, sampling factors, scans and restart intervals. Of two fields in a frame the
    first is read. What is no such frame, or is cut off, raises ValueError or LookupError.
    """
    if frame[:2] != b"\xff\xd8":
        raise ValueError("no JPEG")
    quant, huff, comps, restart, at, seen = {}, {k: lookup(*v) for k, v in USUAL.items()}, [], 0, 2, set()
    across = down = width = height = 0
    while True:
        at = frame.find(b"\xff", at)
        if at < 0 or at + 4 > len(frame):
            break
        marker = frame[at + 1]
        if marker in (0x00, 0x01, 0xFF) or 0xD0 <= marker <= 0xD7:
            at += 1 if marker == 0xFF else 2
            continue
        if marker in (0xD8, 0xD9):
            break
        n = struct.unpack_from(">H", frame, at + 2)[0]
        body = frame[at + 4 : at + 2 + n]
        at += 2 + n
        if marker == 0xDB:
            while body:
                wide, one = body[0] >> 4, body[0] & 15
                size = 64 * (wide + 1)
                quant[one] = np.frombuffer(body[1 : 1 + size], ">u2" if wide else "u1").astype(np.int64)
                body = body[1 + size :]
        elif marker in (0xC0, 0xC1):
            height, width = struct.unpack_from(">HH", body, 1)
            comps = [{"id": body[6 + 3 * i], "h": body[7 + 3 * i] >> 4, "v": body[7 + 3 * i] & 15, "q": body[8 + 3 * i]} for i in range(body[5])]
            if body[0] != 8 or not height or not width or not comps or not all(c["h"] and c["v"] for c in comps):
                raise ValueError("not a baseline frame of 8 bits")
            hmax, vmax = max(c["h"] for c in comps), max(c["v"] for c in comps)
            across, down = -(-width // (8 * hmax)), -(-height // (8 * vmax))
            for c in comps:
                c["width"], c["height"] = -(-width * c["h"] // hmax), -(-height * c["v"] // vmax)
                c["across"], c["down"] = -(-c["width"] // 8), -(-c["height"] // 8)
                c["grid"] = [[[0] * 64 for _ in range(across * c["h"])] for _ in range(down * c["v"])]
        elif marker == 0xC4:
            while body:
                total = sum(body[1:17])
                huff[body[0]] = lookup(body[1:17], body[17 : 17 + total])
                body = body[17 + total :]
        elif marker == 0xDD:
            restart = struct.unpack(">H", body)[0]
        elif marker == 0xDA:
            some = []
            for i in range(body[0]):
                c = next((c for c in comps if c["id"] == body[1 + 2 * i]), None)
                if c is None:
                    raise ValueError("a scan of no component")
                c |= {"dc": huff[body[2 + 2 * i] >> 4], "ac": huff[16 | body[2 + 2 * i] & 15]}
                some.append(c)
            parts, begin = [], at
            while (at := frame.find(b"\xff", at)) != -1 and at + 1 < len(frame):
                if 0xD0 <= frame[at + 1] <= 0xD7:
                    parts.append(frame[begin:at])
                    begin = at + 2
                elif frame[at + 1] not in (0x00, 0xFF):
                    break
                at += 1 if frame[at + 1] == 0xFF else 2
            at = len(frame) if at < 0 or at + 1 >= len(frame) else at
            _scan([*parts, frame[begin:at]], some, across, down, restart)
            seen |= {c["id"] for c in some}
        elif 0xC2 <= marker <= 0xCF and marker not in (0xC8, 0xCC):
            raise ValueError("not a baseline frame")
    if not comps or len(seen) < len({c["id"] for c in comps}):
        raise ValueError("a frame is cut off")
    blocks, planes = [], []
    for c in comps:
        grid = np.array(c["grid"], np.int64)
        blocks.append(grid.reshape(-1, 64))
        pixels = samples_of(blocks[-1] * quant[c["q"]]).reshape(*grid.shape[:2], 8, 8)
        planes.append(pixels.transpose(0, 2, 1, 3).reshape(8 * grid.shape[0], -1)[: c["height"], : c["width"]])
    return blocks, planes


def bytes_of(blocks: list[np.ndarray]) -> bytes | None:
    """The bytes that a frame with other tables stores in this module's way, if it does."""
    if [len(x) for x in blocks] != [MCUS] * 3:
        return None
    value = np.stack(blocks, 1)
    if (value == 0).any() or value.min() < -128 or value.max() > 128:
        return None
    return (value + np.where(value > 0, 127, 128)).astype(np.uint8).tobytes()


def read_frame(frame: bytes) -> bytes | tuple[bytes | None, np.ndarray]:
    """The entropy-coded bytes of a frame with this module's tables; of any other what it stores, and its histogram."""
    try:
        return scan_of(frame)
    except ValueError:
        blocks, planes = decode_frame(frame)
        return bytes_of(blocks), histograms(np.concatenate([x.ravel() for x in planes])[None])[0]


def read_frames(avi: Avi) -> list[bytes | tuple[bytes | None, np.ndarray]]:
    """``read_frame`` of each; an empty chunk shows the frame before it once more."""
    out: list = []
    for k in range(len(avi.frames)):
        raw = avi.frame(k)
        if raw or not out:
            out.append(read_frame(raw))
        else:
            out.append(out[-1])
    return out


def histograms(frames: np.ndarray) -> np.ndarray:
    """(frames, BINS) shares of samples."""
    cell = frames // (256 // BINS) + (np.arange(len(frames)) * BINS)[:, None]
    return np.bincount(cell.ravel(), minlength=len(frames) * BINS).reshape(-1, BINS) / frames.shape[1]


def clips_of(hist: np.ndarray, fps: float) -> list[tuple[int, int, float, float]]:
    """(first frame, frame after the last, start and end in seconds) of each shot."""
    diff = np.abs(np.diff(hist, axis=0)).sum(1)
    cuts, calm = [0], []
    for i, d in enumerate(diff.tolist()):
        before = np.array(calm[-WINDOW:])
        if d > max(CUT_LEAST, float(before.mean() + CUT_SIGMAS * before.std()) if len(before) > 1 else CUT_LEAST):
            cuts.append(i + 1)
        else:
            calm.append(d)
    ends = [*cuts[1:], len(hist)]
    return [(a, b, a / fps, b / fps) for a, b in zip(cuts, ends, strict=True)]


def encode_avi(docs: DataFrame, id_col: str = "doc_id", text_col: str = "text") -> DataFrame:
    """doc_id, n_bytes, media."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for whole in batches:
            for i in range(0, whole.num_rows, 256):
                b = whole.slice(i, 256)
                raws = [(t or "").encode("utf-8", "surrogatepass") for t in b.column(1).to_pylist()]
                padded = [r + b" " * (max(GROUP, -(-len(r) // GROUP) * GROUP) - len(r)) for r in raws]
                counts = [-(-len(p) // FRAME_BYTES) for p in padded]
                frames = code_payload(b"".join(p + b" " * (n * FRAME_BYTES - len(p)) for p, n in zip(padded, counts, strict=True)))
                media, at = [], 0
                for p, n in zip(padded, counts, strict=True):
                    media.append(write_avi(frames[at : at + n], len(p)))
                    at += n
                yield pa.record_batch([b.column(0), pa.array([len(r) for r in raws], pa.int64()), pa.array(media, pa.binary())], names=["doc_id", "n_bytes", "media"])

    return docs.select(F.col(id_col).cast("long").alias("doc_id"), F.col(text_col).alias("text")).mapInArrow(run, "doc_id long, n_bytes long, media binary")


READ_SCHEMA = (
    "doc_id long, n_bytes long, payload_bytes long, payload_sha256 string, tail_crc32 long, media_bytes long, media_sha256 string, feature string, "
    "clips array<struct<first_frame:int,end_frame:int,start_s:double,end_s:double>>"
)


def read_avi(media: DataFrame) -> DataFrame:
    """READ_SCHEMA from doc_id, n_bytes, media."""
    clip = pa.struct([("first_frame", pa.int32()), ("end_frame", pa.int32()), ("start_s", pa.float64()), ("end_s", pa.float64())])

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        names = [f.split(" ")[0] for f in READ_SCHEMA.split(", ")]
        for whole in batches:
            for i in range(0, whole.num_rows, 128):
                b = whole.slice(i, 128)
                files = b.column(2).to_pylist()
                avis, scans = [], []
                for raw in files:
                    try:
                        avi = Avi(raw or b"")
                        read = read_frames(avi)
                    except (ValueError, LookupError, struct.error):
                        avi, read = None, []
                    # an own frame is its place among the scans of all files
                    at = len(scans)
                    scans += [f for f in read if isinstance(f, bytes)]
                    own = iter(range(at, len(scans)))
                    avis.append((avi, [next(own) if isinstance(f, bytes) else f for f in read]))
                frames = read_scans(scans)
                hists = histograms(samples_of_bytes(frames)) if len(frames) else np.zeros((0, BINS))
                rows = []
                for raw, (avi, read) in zip(files, avis, strict=True):
                    if avi is None:
                        rows.append((None,) * 6 + (None,))
                        continue
                    n = len(read)
                    hist = np.array([hists[f] if isinstance(f, int) else f[1] for f in read]).reshape(-1, BINS)
                    stored = [frames[f].tobytes() if isinstance(f, int) else f[0] for f in read]
                    payload = None if None in stored else b"".join(stored)[: avi.payload_bytes]
                    shots = clips_of(hist, avi.fps) if n else []
                    mean = hist.mean(0) if n else np.zeros(BINS)
                    feature = f"frames={n};shots={len(shots)};cuts={','.join(str(s[0]) for s in shots[1:])};hist={','.join(str(round(x * 1000)) for x in mean.tolist())}"
                    held = (None,) * 3 if payload is None else (len(payload), hashlib.sha256(payload).hexdigest(), zlib.crc32(payload[-16:]))
                    rows.append((*held, len(raw), hashlib.sha256(raw).hexdigest(), feature, [dict(zip(("first_frame", "end_frame", "start_s", "end_s"), s, strict=True)) for s in shots]))
                kinds = [pa.int64(), pa.string(), pa.int64(), pa.int64(), pa.string(), pa.string(), pa.list_(clip)]
                yield pa.record_batch([b.column(0), b.column(1), *(pa.array([r[k] for r in rows], kind) for k, kind in enumerate(kinds))], names=names)

    return media.select("doc_id", "n_bytes", "media").mapInArrow(run, READ_SCHEMA)


def op8_avi_motion_jpeg(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Contract columns, then the clips."""
    # the codes are 9 bits long, which only an entropy coder makes smaller
    stored = written(encode_avi(table(spark, sf_dir, "documents")), "media", codec="zstd")
    return read_avi(stored)


QUERIES = {"op8_avi_motion_jpeg": op8_avi_motion_jpeg}
SQL: dict[str, str] = {}
