"""Media columns: motion-JPEG in AVI.

Frames are grey, 64 samples wide, and coded by JPEG's lossless process (SOF3, predictor 1), so that any payload comes
back bit for bit.  The Huffman table gives a difference of s bits a code of 9 - s bits: every sample takes nine bits,
and whole frames are coded and decoded by array operations.  Lossless frames with other tables are decoded bit by bit,
and baseline frames, as cameras write them, by their luminance.

Shots are cut where the histogram difference of two frames stands out from the differences around it.
"""

from __future__ import annotations

import hashlib
import struct
import zlib

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from kinloom.llm import jpeg
from kinloom.llm.base import map_arrow

WIDTH, HEIGHT, FPS, BINS = 64, 16, 25, 16
SAMPLES = WIDTH * HEIGHT

#: Huffman table: nine symbols, one of each length from 1 to 9 bits; the symbol of length n is 9 - n.
_TABLE = bytes([0x00, *[1] * 9, *[0] * 7, *range(8, -1, -1)])


def _segment(marker: int, body: bytes) -> bytes:
    return struct.pack(">BBH", 0xFF, marker, len(body) + 2) + body


_HEAD = b"\xff\xd8" + _segment(0xC4, _TABLE) + _segment(0xC3, struct.pack(">BHHBBBB", 8, HEIGHT, WIDTH, 1, 1, 0x11, 0)) + _segment(0xDA, bytes([1, 1, 0, 1, 0, 0]))


def _code_table() -> np.ndarray:
    """The nine bits of each difference from -255 to 255."""
    d = np.arange(-255, 256)
    s = np.array([int(abs(x)).bit_length() for x in d.tolist()])
    return (((1 << (8 - s)) - 1) << (s + 1) | np.where(d >= 0, d, d + (1 << s) - 1)).astype(np.uint16)


_CODES = _code_table()
_DIFFS = np.zeros(512, np.int16)
_DIFFS[_CODES] = np.arange(-255, 256)


def encode_frames(frames: np.ndarray) -> list[bytes]:
    """frames: uint8 of shape (n, HEIGHT, WIDTH)."""
    x = frames.astype(np.int16)
    diff = np.empty_like(x)
    diff[:, :, 1:] = x[:, :, 1:] - x[:, :, :-1]
    diff[:, 1:, 0] = x[:, 1:, 0] - x[:, :-1, 0]
    diff[:, 0, 0] = x[:, 0, 0] - 128
    c = _CODES[diff.reshape(len(x), -1, 8) + 255]
    packed = np.empty((*c.shape[:2], 9), np.uint8)
    packed[:, :, 0] = c[:, :, 0] >> 1
    for k in range(1, 8):
        packed[:, :, k] = (c[:, :, k - 1] << (8 - k) | c[:, :, k] >> (k + 1)) & 255
    packed[:, :, 8] = c[:, :, 7] & 255
    return [_HEAD + row.tobytes().replace(b"\xff", b"\xff\x00") + b"\xff\xd9" for row in packed.reshape(len(x), -1)]


def _segments(frame: bytes) -> tuple[dict, bytes]:
    """The header fields of a lossless JPEG, and its entropy-coded bytes without stuffing."""
    if frame[:2] != b"\xff\xd8":
        raise ValueError("not a JPEG frame")
    at, info = 2, {}
    while True:
        _, marker, n = struct.unpack(">BBH", frame[at : at + 4])
        body = frame[at + 4 : at + 2 + n]
        at += 2 + n
        if marker == 0xC4:
            info["table"] = body
        elif marker == 0xC3:
            precision, info["height"], info["width"], parts = struct.unpack(">BHHB", body[:6])
            if precision != 8 or parts != 1:
                raise ValueError("only grey frames of 8 bits are decoded")
        elif 0xC0 <= marker <= 0xCF and marker != 0xC8:
            raise ValueError("only lossless frames (SOF3) are decoded")
        elif marker == 0xDA:
            if body[3] != 1:
                raise ValueError("only predictor 1 is decoded")
            end = frame.rindex(b"\xff\xd9")
            return info, frame[at:end].replace(b"\xff\x00", b"\xff")


def _slow_differences(info: dict, data: bytes) -> np.ndarray:
    """Differences of a frame with any Huffman table, bit by bit."""
    counts, symbols = info["table"][1:17], info["table"][17:]
    codes, code, k = {}, 0, 0
    for length, n in enumerate(counts, 1):
        for _ in range(n):
            codes[length, code] = symbols[k]
            code, k = code + 1, k + 1
        code <<= 1
    bits = np.unpackbits(np.frombuffer(data, np.uint8)).tolist()
    out, at = np.empty(info["height"] * info["width"], np.int64), 0
    for i in range(len(out)):
        length = code = 0
        while (length, code) not in codes:
            code, length, at = code << 1 | bits[at], length + 1, at + 1
            if length > 16:
                raise ValueError("broken entropy-coded data")
        s = codes[length, code]
        v = int("".join(map(str, bits[at : at + s])) or "0", 2)
        at += s
        out[i] = v if not s or v >> (s - 1) else v - (1 << s) + 1
    return out


def _is_lossless(frame: bytes) -> bool:
    """The frame's first header of a frame (SOFn) is that of the lossless process."""
    at = 2
    while at + 4 <= len(frame) and frame[at] == 0xFF:
        if 0xC0 <= frame[at + 1] <= 0xCF and frame[at + 1] not in (0xC4, 0xC8, 0xCC):
            return frame[at + 1] == 0xC3
        at += 2 + struct.unpack(">H", frame[at + 2 : at + 4])[0]
    return False


def decode_frames(frames: list[bytes]) -> np.ndarray:
    """uint8 of shape (n, height, width); all frames are of one size.  Baseline frames give their luminance."""
    if not frames:
        return np.zeros((0, HEIGHT, WIDTH), np.uint8)
    if not _is_lossless(frames[0]):
        each = [jpeg.decode(f) for f in frames]
        if len({x.shape for x in each}) > 1:
            raise ValueError("frames differ in size")
        return np.stack(each)
    parsed = [_segments(f) for f in frames]
    h, w = parsed[0][0]["height"], parsed[0][0]["width"]
    if any((i["height"], i["width"]) != (h, w) for i, _ in parsed):
        raise ValueError("frames differ in size")
    if all(i["table"] == _TABLE for i, _ in parsed) and h * w % 8 == 0:
        b = np.frombuffer(b"".join(d for _, d in parsed), np.uint8).reshape(len(frames), -1, 9).astype(np.uint16)
        c = np.empty((*b.shape[:2], 8), np.uint16)
        for j in range(8):
            c[:, :, j] = (b[:, :, j] << 8 | b[:, :, j + 1]) >> (7 - j) & 511
        diff = _DIFFS[c].astype(np.int64).reshape(len(frames), h, w)
    else:
        diff = np.stack([_slow_differences(i, d) for i, d in parsed]).reshape(len(frames), h, w)
    diff[:, 0, 0] += 128
    diff[:, :, 0] = np.cumsum(diff[:, :, 0], axis=1)
    return (np.cumsum(diff, axis=2) & 255).astype(np.uint8)


def _chunk(name: bytes, body: bytes) -> bytes:
    return name + struct.pack("<I", len(body)) + body + b"\0" * (len(body) % 2)


def write_avi(payload: bytes) -> bytes:
    """An AVI file whose frames hold payload, the last one filled up with zeros; the INFO list has payload's length."""
    n = max(1, -(-len(payload) // SAMPLES))
    grid = np.zeros(n * SAMPLES, np.uint8)
    grid[: len(payload)] = np.frombuffer(payload, np.uint8)
    frames = encode_frames(grid.reshape(n, HEIGHT, WIDTH))
    largest = max(map(len, frames))
    main = struct.pack("<10I4I", 1_000_000 // FPS, largest * FPS, 0, 0x10, n, 0, 1, largest, WIDTH, HEIGHT, 0, 0, 0, 0)
    stream = struct.pack("<4s4sIHHIIIIIIII4H", b"vids", b"MJPG", 0, 0, 0, 0, 1, FPS, 0, n, largest, 0xFFFFFFFF, 0, 0, 0, WIDTH, HEIGHT)
    picture = struct.pack("<IiiHH4sIiiII", 40, WIDTH, HEIGHT, 1, 8, b"MJPG", SAMPLES, 0, 0, 0, 0)
    header = _chunk(b"LIST", b"hdrl" + _chunk(b"avih", main) + _chunk(b"LIST", b"strl" + _chunk(b"strh", stream) + _chunk(b"strf", picture)))
    info = _chunk(b"LIST", b"INFO" + _chunk(b"ICMT", b"payload=%d\0" % len(payload)))
    movie, index, at = [], [], 4
    for f in frames:
        index.append(struct.pack("<4sIII", b"00dc", 0x10, at, len(f)))
        movie.append(_chunk(b"00dc", f))
        at += len(movie[-1])
    body = b"AVI " + header + info + _chunk(b"LIST", b"movi" + b"".join(movie)) + _chunk(b"idx1", b"".join(index))
    return _chunk(b"RIFF", body)


def _children(data: bytes, at: int, stop: int):
    """Name, begin and length of the body of each chunk from at to stop; a list's name has its kind behind a slash."""
    while at + 8 <= stop:
        name, n = data[at : at + 4], struct.unpack("<I", data[at + 4 : at + 8])[0]
        if name in (b"LIST", b"RIFF"):
            yield name + b"/" + data[at + 8 : at + 12], at + 12, min(n - 4, stop - at - 12)
        else:
            yield name, at + 8, min(n, stop - at - 8)
        at += 8 + n + n % 2


def _movie_frames(data: bytes, at: int, n: int, stream: bytes) -> list[bytes]:
    """Frames of one stream in a movi list, in rec lists as well."""
    out = []
    for name, begin, size in _children(data, at, at + n):
        if name == b"LIST/rec ":
            out += _movie_frames(data, begin, size, stream)
        elif name in (stream + b"dc", stream + b"db") and size:
            out.append(data[begin : begin + size])
    return out


def read_avi(data: bytes) -> tuple[list[bytes], float, int | None]:
    """Frames of the first video stream, seconds a frame, and the payload's length if the file says it.

    Frames come by the file's index, or by its movi list if it has none; what further RIFF parts (AVIX) hold follows.
    """
    parts = list(_children(data, 0, len(data)))
    if not parts or parts[0][0] != b"RIFF/AVI ":
        raise ValueError("not an AVI file")
    step, length, movie, index, streams, video = 1 / FPS, None, None, None, 0, None
    for name, at, n in _children(data, parts[0][1], parts[0][1] + parts[0][2]):
        if name == b"LIST/hdrl":
            for inner, begin, size in _children(data, at, at + n):
                if inner == b"avih":
                    step = struct.unpack("<I", data[begin : begin + 4])[0] / 1e6
                elif inner == b"LIST/strl":
                    head = next((data[b : b + s] for c, b, s in _children(data, begin, begin + size) if c == b"strh"), b"")
                    if video is None and head[:4] == b"vids":
                        video = b"%02d" % streams
                        scale, rate = struct.unpack("<II", head[20:28])
                        step = scale / rate if scale and rate else step
                    streams += 1
        elif name == b"LIST/INFO":
            for inner, begin, size in _children(data, at, at + n):
                if inner == b"ICMT" and data[begin : begin + 8] == b"payload=":
                    length = int(data[begin + 8 : begin + size].rstrip(b"\0"))
        elif name == b"LIST/movi":
            movie = (at - 4, n + 4)
        elif name == b"idx1":
            index = (at, n)
    if movie is None:
        raise ValueError("no movi list")
    video = video or b"00"
    if index:
        frames = []
        entries = np.frombuffer(data, "<u4", index[1] // 16 * 4, index[0]).reshape(-1, 4)
        base = movie[0] if len(entries) and entries[0, 2] < movie[0] else 0  # offsets count from the list or from the file
        names = {struct.unpack("<I", video + kind)[0] for kind in (b"dc", b"db")}
        for name, _, offset, n in entries.tolist():
            if name in names and n:
                frames.append(data[base + offset + 8 : base + offset + 8 + n])
    else:
        frames = _movie_frames(data, movie[0] + 4, movie[1] - 4, video)
    for name, at, n in parts[1:]:
        if name == b"RIFF/AVIX":
            for inner, begin, size in _children(data, at, at + n):
                if inner == b"LIST/movi":
                    frames += _movie_frames(data, begin, size, video)
    return frames, step, length


def cuts(frames: np.ndarray, *, around: int = 8, spread: float = 2.0, least: float = 0.1) -> np.ndarray:
    """Numbers of the frames that begin a shot, 0 first.

    A frame does so if half the L1 distance of its histogram from the one before is at least ``least`` and above the
    mean of the up to 2 x around differences around it by ``spread`` standard deviations.
    """
    n = len(frames)
    if n < 2:
        return np.zeros(min(n, 1), np.int64)
    flat = (frames.reshape(n, -1) >> 4).astype(np.int64) + (np.arange(n) * BINS)[:, None]
    hist = np.bincount(flat.ravel(), minlength=n * BINS).reshape(n, BINS) / (flat.shape[1])
    d = np.abs(np.diff(hist, axis=0)).sum(axis=1) / 2
    lo, hi = np.maximum(np.arange(n - 1) - around, 0), np.minimum(np.arange(n - 1) + around + 1, n - 1)
    s1, s2 = np.r_[0, np.cumsum(d)], np.r_[0, np.cumsum(d * d)]
    k = np.maximum(hi - lo - 1, 1)
    mean = (s1[hi] - s1[lo] - d) / k
    dev = np.sqrt(np.maximum((s2[hi] - s2[lo] - d * d) / k - mean * mean, 0))
    return np.r_[0, np.flatnonzero((d >= least) & (d > mean + spread * dev)) + 1]


def payload_of(text: str | None) -> tuple[int, bytes]:
    """The length of text in UTF-8, and those bytes with zeros up to a positive multiple of 64."""
    raw = (text or "").encode("utf-8", "surrogatepass")
    return len(raw), raw + b"\0" * (-len(raw) % 64 or (0 if raw else 64))


def clip_times(frames: np.ndarray, step: float) -> list[tuple[int, int]]:
    """Begin and end of each shot in milliseconds."""
    at = np.r_[cuts(frames), len(frames)]
    return [(round(a * step * 1000), round(b * step * 1000)) for a, b in zip(at[:-1].tolist(), at[1:].tolist(), strict=True)]


def clips(media: DataFrame, *, id_col: str = "id", media_col: str = "media") -> DataFrame:
    """id, clip (from 0), start_ms, end_ms, frames: a row for each shot of each AVI file.

    Frames are lossless grey or baseline ones; a null file, one that isn't an AVI file of such frames, and one without
    frames give no row.  Rows with null and repeated ids give rows of their own.
    """

    def rows(batch: pa.RecordBatch) -> dict:
        out = {"id": [], "clip": [], "start_ms": [], "end_ms": [], "frames": []}
        for i, data in zip(batch.column("id").to_pylist(), batch.column("media").to_pylist(), strict=True):
            try:
                got, step, _ = read_avi(data or b"")
                frames = decode_frames(got)
            except (ValueError, struct.error, KeyError, IndexError):
                continue
            at = np.r_[cuts(frames), len(frames)].tolist()
            for k, (a, b) in enumerate(clip_times(frames, step) if len(frames) else []):
                for c, v in zip(out.values(), (i, k, a, b, at[k + 1] - at[k]), strict=True):
                    c.append(v)
        return out

    return map_arrow(media.select(F.col(id_col).cast("long").alias("id"), F.col(media_col).alias("media")), rows, "id long,clip int,start_ms long,end_ms long,frames long")


def store_texts(docs: DataFrame, *, id_col: str = "doc_id", text_col: str = "text") -> DataFrame:
    """id and media: each text's padded bytes as an AVI file.  A null text counts as empty."""

    def rows(batch: pa.RecordBatch) -> dict:
        return {"id": batch.column("id"), "media": [write_avi(payload_of(t)[1]) for t in batch.column("text").to_pylist()]}

    return map_arrow(docs.select(F.col(id_col).cast("long").alias("id"), F.col(text_col).alias("text")), rows, "id long,media binary")


def media_columns(docs: DataFrame, *, id_col: str = "doc_id", text_col: str = "text") -> DataFrame:
    """Store each text as an AVI file, read the file back, and describe both.

    One row per input row; null and empty texts are 64 zeros.  Null and repeated ids stay; equal texts get equal
    values.  feature: the number of frames and shots, the mean sample, and the shots' times in milliseconds.
    """
    names = "doc_id long,n_bytes long,payload_bytes long,payload_sha256 string,tail_crc32 long,media_bytes long,media_sha256 string,feature string"

    def one(text: str | None) -> tuple:
        n, payload = payload_of(text)
        media = write_avi(payload)
        found, step, length = read_avi(media)
        frames = decode_frames(found)
        back = frames.tobytes()[:length]
        times = clip_times(frames, step)
        feature = f"frames={len(frames)};shots={len(times)};mean={frames.mean():.4f};clips=" + ",".join(f"{a}-{b}" for a, b in times)
        return n, len(back), hashlib.sha256(back).hexdigest(), zlib.crc32(back[-64:]), len(media), hashlib.sha256(media).hexdigest(), feature

    def rows(batch: pa.RecordBatch) -> dict:
        made = list(zip(*map(one, batch.column("text").to_pylist()), strict=True))
        return dict(zip((x.split()[0] for x in names.split(",")), (batch.column("doc_id"), *made), strict=True))

    return map_arrow(docs.select(F.col(id_col).cast("long").alias("doc_id"), F.col(text_col).alias("text")), rows, names)
