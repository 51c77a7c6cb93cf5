"""Baseline JPEG: the luminance of sequential frames with Huffman codes, as motion-JPEG files hold them."""

from __future__ import annotations

import struct
from functools import lru_cache

import numpy as np

# The usual Huffman tables of the published standard, which frames of motion-JPEG leave out.  Codes of each
# length from 1 to 16 bits, and symbols in the order of their codes, for luminance and for chrominance.
_DC_COUNTS = ((0, 1, 5, 1, 1, 1, 1, 1, 1, 0, 0, 0, 0, 0, 0, 0), (0, 3, 1, 1, 1, 1, 1, 1, 1, 1, 1, 0, 0, 0, 0, 0))
_AC_COUNTS = ((0, 2, 1, 3, 3, 2, 4, 3, 5, 5, 4, 4, 0, 0, 1, 125), (0, 2, 1, 2, 4, 4, 3, 4, 7, 5, 4, 4, 0, 1, 2, 119))
_DC_SYMBOLS = (0, 1, 2, 3, 4, 5, 6, 7, 8, 9, 10, 11)
_AC_LUMINANCE = (
    0x01, 0x02, 0x03, 0x00, 0x04, 0x11, 0x05, 0x12, 0x21, 0x31, 0x41, 0x06, 0x13, 0x51, 0x61, 0x07, 0x22, 0x71,
    0x14, 0x32, 0x81, 0x91, 0xA1, 0x08, 0x23, 0x42, 0xB1, 0xC1, 0x15, 0x52, 0xD1, 0xF0, 0x24, 0x33, 0x62, 0x72,
    0x82, 0x09, 0x0A, 0x16, 0x17, 0x18, 0x19, 0x1A, 0x25, 0x26, 0x27, 0x28, 0x29, 0x2A, 0x34, 0x35, 0x36, 0x37,
    0x38, 0x39, 0x3A, 0x43, 0x44, 0x45, 0x46, 0x47, 0x48, 0x49, 0x4A, 0x53, 0x54, 0x55, 0x56, 0x57, 0x58, 0x59,
    0x5A, 0x63, 0x64, 0x65, 0x66, 0x67, 0x68, 0x69, 0x6A, 0x73, 0x74, 0x75, 0x76, 0x77, 0x78, 0x79, 0x7A, 0x83,
    0x84, 0x85, 0x86, 0x87, 0x88, 0x89, 0x8A, 0x92, 0x93, 0x94, 0x95, 0x96, 0x97, 0x98, 0x99, 0x9A, 0xA2, 0xA3,
    0xA4, 0xA5, 0xA6, 0xA7, 0xA8, 0xA9, 0xAA, 0xB2, 0xB3, 0xB4, 0xB5, 0xB6, 0xB7, 0xB8, 0xB9, 0xBA, 0xC2, 0xC3,
    0xC4, 0xC5, 0xC6, 0xC7, 0xC8, 0xC9, 0xCA, 0xD2, 0xD3, 0xD4, 0xD5, 0xD6, 0xD7, 0xD8, 0xD9, 0xDA, 0xE1, 0xE2,
    0xE3, 0xE4, 0xE5, 0xE6, 0xE7, 0xE8, 0xE9, 0xEA, 0xF1, 0xF2, 0xF3, 0xF4, 0xF5, 0xF6, 0xF7, 0xF8, 0xF9, 0xFA,
)
_AC_CHROMINANCE = (
    0x00, 0x01, 0x02, 0x03, 0x11, 0x04, 0x05, 0x21, 0x31, 0x06, 0x12, 0x41, 0x51, 0x07, 0x61, 0x71, 0x13, 0x22,
    0x32, 0x81, 0x08, 0x14, 0x42, 0x91, 0xA1, 0xB1, 0xC1, 0x09, 0x23, 0x33, 0x52, 0xF0, 0x15, 0x62, 0x72, 0xD1,
    0x0A, 0x16, 0x24, 0x34, 0xE1, 0x25, 0xF1, 0x17, 0x18, 0x19, 0x1A, 0x26, 0x27, 0x28, 0x29, 0x2A, 0x35, 0x36,
    0x37, 0x38, 0x39, 0x3A, 0x43, 0x44, 0x45, 0x46, 0x47, 0x48, 0x49, 0x4A, 0x53, 0x54, 0x55, 0x56, 0x57, 0x58,
    0x59, 0x5A, 0x63, 0x64, 0x65, 0x66, 0x67, 0x68, 0x69, 0x6A, 0x73, 0x74, 0x75, 0x76, 0x77, 0x78, 0x79, 0x7A,
    0x82, 0x83, 0x84, 0x85, 0x86, 0x87, 0x88, 0x89, 0x8A, 0x92, 0x93, 0x94, 0x95, 0x96, 0x97, 0x98, 0x99, 0x9A,
    0xA2, 0xA3, 0xA4, 0xA5, 0xA6, 0xA7, 0xA8, 0xA9, 0xAA, 0xB2, 0xB3, 0xB4, 0xB5, 0xB6, 0xB7, 0xB8, 0xB9, 0xBA,
    0xC2, 0xC3, 0xC4, 0xC5, 0xC6, 0xC7, 0xC8, 0xC9, 0xCA, 0xD2, 0xD3, 0xD4, 0xD5, 0xD6, 0xD7, 0xD8, 0xD9, 0xDA,
    0xE2, 0xE3, 0xE4, 0xE5, 0xE6, 0xE7, 0xE8, 0xE9, 0xEA, 0xF2, 0xF3, 0xF4, 0xF5, 0xF6, 0xF7, 0xF8, 0xF9, 0xFA,
)


def _lookup(counts, symbols) -> list[tuple[int, int]]:
    """For every 16 bits that come next: the length of the code they begin with, and its symbol; length 0 if there is none."""
    if sum(counts) > len(symbols):
        raise ValueError("a Huffman table without all its symbols")
    table, code = [(0, 0)] * 65536, 0
    symbols = iter(symbols)
    for length, n in enumerate(counts, 1):
        for _ in range(n):
            at = code << (16 - length)
            table[at : at + (1 << (16 - length))] = [(length, next(symbols))] * (1 << (16 - length))
            code += 1
        code <<= 1
    if len(table) != 65536:
        raise ValueError("a Huffman table with too many codes")
    return table


@lru_cache(1)
def _usual() -> dict[int, list[tuple[int, int]]]:
    """The lookups of the usual tables, by class and number (0x00, 0x01 for DC, 0x10, 0x11 for AC)."""
    out = {}
    for i, symbols in enumerate((_AC_LUMINANCE, _AC_CHROMINANCE)):
        out[i] = _lookup(_DC_COUNTS[i], _DC_SYMBOLS)
        out[0x10 | i] = _lookup(_AC_COUNTS[i], symbols)
    return out


@lru_cache(8)
def _own(body: bytes) -> list[tuple[int, int]]:
    return _lookup(body[:16], body[16:])


def _zigzag() -> np.ndarray:
    """The place in a block of 8 x 8 of each coefficient in the order in which they are coded."""
    cells = sorted(((i, j) for i in range(8) for j in range(8)), key=lambda c: (c[0] + c[1], c[0] if (c[0] + c[1]) % 2 else c[1]))
    return np.array([8 * i + j for i, j in cells])


_ZIGZAG = _zigzag()
_COSINES = np.array([[(np.sqrt(0.125) if k == 0 else 0.5) * np.cos((2 * x + 1) * k * np.pi / 16) for x in range(8)] for k in range(8)])


class _Bits:
    """Bits of entropy-coded bytes, without stuffing; zeros follow the last."""

    def __init__(self, data: bytes):
        self.data, self.at, self.held, self.n, self.over = data, 0, 0, 0, 0

    def need(self, n: int) -> None:
        while self.n < n:
            some = self.data[self.at : self.at + 8]
            if not some:
                self.over += 1
                if self.over > 2:
                    raise ValueError("entropy-coded data end early")
                some = b"\0" * 8
            self.at += len(some)
            self.held = (self.held & ((1 << self.n) - 1)) << (8 * len(some)) | int.from_bytes(some, "big")
            self.n += 8 * len(some)

    def symbol(self, table: list[tuple[int, int]]) -> int:
        self.need(16)
        length, value = table[self.held >> (self.n - 16) & 0xFFFF]
        if not length:
            raise ValueError("no such Huffman code")
        self.n -= length
        return value

    def number(self, size: int) -> int:
        """A number of size bits; those that begin with 0 are negative."""
        if not size:
            return 0
        self.need(size)
        self.n -= size
        v = self.held >> self.n & ((1 << size) - 1)
        return v if v >> (size - 1) else v - (1 << size) + 1


def _block(bits: _Bits, dc: list, ac: list, before: int, out: list[int]) -> int:
    """Read the coefficients of one block into out (64 zeros); its first one is returned."""
    before += bits.number(bits.symbol(dc))
    out[0], k = before, 1
    while k < 64:
        v = bits.symbol(ac)
        run, size = v >> 4, v & 15
        if not size:
            if run != 15:
                break
            k += 16
            continue
        k += run
        if k > 63:
            raise ValueError("a block with too many coefficients")
        out[k] = bits.number(size)
        k += 1
    return before


def decode(frame: bytes) -> np.ndarray:
    """The luminance (first component) of a baseline frame, uint8 of shape (height, width); ValueError for other frames."""
    if frame[:2] != b"\xff\xd8":
        raise ValueError("not a JPEG frame")
    at, quantizers, tables, parts, restart = 2, {}, dict(_usual()), None, 0
    while True:
        while frame[at : at + 2] == b"\xff\xff":
            at += 1
        if at + 4 > len(frame) or frame[at] != 0xFF:
            raise ValueError("a frame without a scan")
        marker, n = frame[at + 1], struct.unpack(">H", frame[at + 2 : at + 4])[0]
        body = frame[at + 4 : at + 2 + n]
        at += 2 + n
        if marker == 0xDB:
            while body:
                wide = body[0] >> 4
                size = 128 if wide else 64
                quantizers[body[0] & 15] = np.frombuffer(body[1 : 1 + size], ">u2" if wide else "u1").astype(float)
                body = body[1 + size :]
        elif marker == 0xC4:
            while body:
                size = 17 + sum(body[1:17])
                tables[body[0]] = _own(body[1:size])
                body = body[size:]
        elif marker in (0xC0, 0xC1):
            precision, height, width, count = struct.unpack(">BHHB", body[:6])
            if precision != 8 or not height or not width:
                raise ValueError("only frames of 8 bits and known size are decoded")
            parts = [(body[6 + 3 * i], body[7 + 3 * i] >> 4, body[7 + 3 * i] & 15, body[8 + 3 * i]) for i in range(count)]
        elif 0xC2 <= marker <= 0xCF and marker != 0xC8:
            raise ValueError("only baseline frames are decoded")
        elif marker == 0xDD:
            restart = struct.unpack(">H", body[:2])[0]
        elif marker == 0xDA:
            break
    if not parts or body[0] != len(parts):
        raise ValueError("only frames of one scan are decoded")
    use = {body[1 + 2 * i]: (body[2 + 2 * i] >> 4, 0x10 | body[2 + 2 * i] & 15) for i in range(len(parts))}
    if len(parts) == 1:  # blocks of a single component come one by one
        parts = [(parts[0][0], 1, 1, parts[0][3])]
    across, down = max(p[1] for p in parts), max(p[2] for p in parts)
    wide, high = -(-width // (8 * across)), -(-height // (8 * down))
    if parts[0][1] != across or parts[0][2] != down:
        raise ValueError("only frames with whole luminance are decoded")
    end = frame.rfind(b"\xff\xd9")
    pieces = _restarts(frame[at : end if end > at else len(frame)])
    blocks = [[0] * 64 for _ in range(wide * high * across * down)]
    scan = [(tables[use[p[0]][0]], tables[use[p[0]][1]], p[1], p[2]) for p in parts]
    bits, before, spare = _Bits(next(pieces)), [0] * len(parts), [0] * 64
    for unit in range(wide * high):
        if restart and unit and unit % restart == 0:
            bits, before = _Bits(next(pieces)), [0] * len(parts)
        y, x = divmod(unit, wide)
        for c, (dc, ac, h, v) in enumerate(scan):
            for b in range(h * v):
                if c:
                    before[c] = _block(bits, dc, ac, before[c], spare)
                else:
                    place = (y * v + b // h) * wide * h + x * h + b % h
                    before[0] = _block(bits, dc, ac, before[0], blocks[place])
    coded = np.array(blocks, float) * quantizers[parts[0][3]]
    square = np.zeros_like(coded)
    square[:, _ZIGZAG] = coded
    samples = _COSINES.T @ square.reshape(-1, 8, 8) @ _COSINES + 128
    image = np.clip(np.rint(samples), 0, 255).astype(np.uint8).reshape(high * down, wide * across, 8, 8)
    return image.transpose(0, 2, 1, 3).reshape(high * down * 8, wide * across * 8)[:height, :width]


def _restarts(data: bytes):
    """Entropy-coded bytes between restart markers, without stuffing."""
    begin = i = 0
    while True:
        i = data.find(b"\xff", i)
        if i < 0 or i + 1 >= len(data):
            break
        if 0xD0 <= data[i + 1] <= 0xD7:
            yield data[begin:i].replace(b"\xff\x00", b"\xff")
            begin = i + 2
        i += 2 if data[i + 1] != 0xFF else 1
    yield data[begin:].replace(b"\xff\x00", b"\xff")
    while True:
        yield b""
