"""Media columns: AVI files of motion-JPEG frames, written and read, and their shots.

A payload is cut into frames of 192 samples. A frame is a grey baseline JPEG of 16 x 12 blocks;
each sample is one flat 8 x 8 block, that is a DC coefficient (quantised by 8) with no AC
coefficients, so the decoded picture holds the samples exactly and any reader gives them back.
Entropy coding runs over many frames at once: encoding packs the bits of all samples of a
chunk, decoding advances one symbol at a time in all frames side by side.

Reading goes through the RIFF structure: header list, stream format, and the idx1 index, whose
entries locate the frames. Shots are cut where the difference of the grey histograms of two
frames stands out from the mean of its neighbourhood by a multiple of the deviation there.

Files of other origin are read, too: frames may be any baseline pictures (see jpeg).

Null and empty texts make one frame of 192 spaces. Equal payloads make equal files.
"""

from __future__ import annotations

import hashlib
import struct
import zlib
from collections.abc import Iterator

import numpy as np
import pandas as pd
from pyspark.sql import DataFrame

from . import jpeg
from .common import as_bytes, mapped

UNIT = 192
ACROSS, DOWN = 16, 12
FPS = 25
CHUNK = 4096
#: DC Huffman table: numbers of codes with 1 to 16 bits, then the categories in code order.
DC_COUNTS = (0, 0, 5, 2, 2, *[0] * 11)
DC_SYMBOLS = (5, 4, 6, 3, 7, 2, 0, 1, 8)
#: AC Huffman table: the end of block alone, as one 0 bit.
AC_COUNTS = (1, *[0] * 15)
AC_SYMBOLS = (0,)
NEIGHBOURS, DEVIATIONS, LEAST_DIFFERENCE = 5, 2.0, 96


def codes(counts, symbols) -> dict[int, tuple[int, int]]:
    """Symbol -> (code, bits), as a JPEG table defines them."""
    out, code, k = {}, 0, 0
    for bits, n in enumerate(counts, 1):
        for _ in range(n):
            out[symbols[k]] = (code, bits)
            code, k = code + 1, k + 1
        code <<= 1
    return out


def segment(marker: int, body: bytes) -> bytes:
    return struct.pack(">BBH", 0xFF, marker, len(body) + 2) + body


FRAME_HEAD = b"".join([
    b"\xff\xd8", segment(0xDB, bytes([0, 8, *[1] * 63])), segment(0xC0, struct.pack(">BHHBBBB", 8, DOWN * 8, ACROSS * 8, 1, 1, 0x11, 0)),
    segment(0xC4, bytes([0x00, *DC_COUNTS, *DC_SYMBOLS])), segment(0xC4, bytes([0x10, *AC_COUNTS, *AC_SYMBOLS])), segment(0xDA, bytes([1, 1, 0x00, 0, 63, 0])),
])
CATEGORY = np.array([int(x).bit_length() for x in range(512)], dtype=np.uint16)
_DC = codes(DC_COUNTS, DC_SYMBOLS)
CODE = np.array([_DC[c][0] for c in range(9)], dtype=np.uint16)
BITS = np.array([_DC[c][1] for c in range(9)], dtype=np.uint16)
LEADING = np.arange(16) < np.arange(17)[:, None]


def encode_frames(samples: np.ndarray) -> list[bytes]:
    """JPEG files of the rows of a (frames, 192) array."""
    out: list[bytes] = []
    for start in range(0, len(samples), CHUNK):
        x = samples[start : start + CHUNK].astype(np.int16) - 128
        d = np.diff(x, axis=1, prepend=np.int16(0))
        cat = CATEGORY[np.abs(d)]
        extra = np.where(d > 0, d, d + (1 << cat.astype(np.int16)) - 1).astype(np.uint16)
        size = np.empty((len(x), UNIT + 1), dtype=np.uint16)
        size[:, :-1] = BITS[cat] + cat + 1  # code, extra bits, end of block
        size[:, -1] = -size[:, :-1].sum(axis=1, dtype=np.int64) % 8
        value = np.full((len(x), UNIT + 1), 0xFFFF, dtype=np.uint16)  # the last one fills up with ones
        value[:, :-1] = (((CODE[cat] << cat) | extra) << 1) << (16 - size[:, :-1])
        bits = np.unpackbits(value.astype(">u2").view(np.uint8)).reshape(-1, 16)
        packed = np.packbits(bits[LEADING[size.ravel()]])
        ends = size.sum(axis=1, dtype=np.int64).cumsum() // 8
        full = np.flatnonzero(packed == 255)
        stuffed = np.insert(packed, full + 1, 0).tobytes()
        ends += np.searchsorted(full, ends)
        at = 0
        for end in ends.tolist():
            out.append(FRAME_HEAD + stuffed[at:end] + b"\xff\xd9")
            at = end
    return out


def chunk(name: bytes, body: bytes) -> bytes:
    return name + struct.pack("<I", len(body)) + body + b"\0" * (len(body) & 1)


def write_avi(frames: list[bytes]) -> bytes:
    most = max(map(len, frames))
    main = struct.pack("<14I", 1_000_000 // FPS, most * FPS, 0, 0x10, len(frames), 0, 1, most, ACROSS * 8, DOWN * 8, 0, 0, 0, 0)
    stream = struct.pack("<4s4sIHHIIIIIIIIHHHH", b"vids", b"MJPG", 0, 0, 0, 0, 1, FPS, 0, len(frames), most, 0xFFFFFFFF, 0, 0, 0, ACROSS * 8, DOWN * 8)
    form = struct.pack("<IiiHH4sIiiII", 40, ACROSS * 8, DOWN * 8, 1, 24, b"MJPG", ACROSS * DOWN * 192, 0, 0, 0, 0)
    header = chunk(b"LIST", b"hdrl" + chunk(b"avih", main) + chunk(b"LIST", b"strl" + chunk(b"strh", stream) + chunk(b"strf", form)))
    body, index, at = [], [], 4
    for f in frames:
        pad = len(f) & 1
        body += [b"00dc", struct.pack("<I", len(f)), f, b"\0" * pad]
        index.append(struct.pack("<4sIII", b"00dc", 0x10, at, len(f)))
        at += 8 + len(f) + pad
    movi = b"".join([b"LIST", struct.pack("<I", at), b"movi", *body])
    return chunk(b"RIFF", b"AVI " + header + movi + chunk(b"idx1", b"".join(index)))


def read_avi(data: bytes) -> tuple[float, list[bytes]]:
    """(frames a second, the JPEG files), by the index of the file."""
    if data[:4] != b"RIFF" or data[8:12] != b"AVI ":
        raise ValueError("not an AVI file")
    fps, movi, index, at = 0.0, None, b"", 12
    while at + 8 <= len(data):
        name, size = data[at : at + 4], struct.unpack_from("<I", data, at + 4)[0]
        if name == b"LIST" and data[at + 8 : at + 12] == b"hdrl":
            fps = 1e6 / struct.unpack_from("<I", data, at + 20)[0]
        elif name == b"LIST" and data[at + 8 : at + 12] == b"movi":
            movi = at + 8
        elif name == b"idx1":
            index = data[at + 8 : at + 8 + size]
        at += 8 + size + (size & 1)
    if movi is None:
        raise ValueError("no movi list")
    frames = []
    for name, _, offset, size in struct.iter_unpack("<4sIII", index[: len(index) // 16 * 16]):
        if name[2:] in (b"dc", b"db"):
            start = movi + offset if data[movi + offset : movi + offset + 4] == name else offset  # from the list on, or from the beginning of the file
            if data[start : start + 4] != name:
                raise ValueError("the index points beside the frames")
            frames.append(data[start + 8 : start + 8 + size])
    if not index:
        frames = list(walked(data, movi + 4, movi + struct.unpack_from("<I", data, movi - 4)[0]))
    if not frames:
        raise ValueError("no frames")
    return fps, frames


def walked(data: bytes, at: int, end: int) -> Iterator[bytes]:
    """The frames of a list without an index, record lists included."""
    if end > len(data):
        raise ValueError("a file that is cut")
    while at + 8 <= end:
        name, size = data[at : at + 4], struct.unpack_from("<I", data, at + 4)[0]
        if name == b"LIST":
            yield from walked(data, at + 12, at + 8 + size)
        elif name[2:] in (b"dc", b"db"):
            yield data[at + 8 : at + 8 + size]
        at += 8 + size + (size & 1)


class Tables:
    """What the head of a baseline grey frame says: blocks, DC quantiser, look-up tables of 16-bit windows."""

    def __init__(self, frame: bytes):
        at, self.tables = 2, {}
        while frame[at + 1] != 0xDA:
            marker, size = frame[at + 1], struct.unpack_from(">H", frame, at + 2)[0]
            body = frame[at + 4 : at + 2 + size]
            if marker == 0xDB:
                self.quantiser = body[1]
            elif marker == 0xC0:
                if body[5] != 1:
                    raise ValueError("not a grey picture")
                self.blocks = (struct.unpack_from(">H", body, 1)[0] + 7) // 8 * ((struct.unpack_from(">H", body, 3)[0] + 7) // 8)
            elif marker == 0xC4:
                self.tables[body[0] >> 4] = self.look_up(body[1:17], body[17:])
            at += 2 + size
        self.start = at + 2 + struct.unpack_from(">H", frame, at + 2)[0]
        self.head = frame[: self.start]

    @staticmethod
    def look_up(counts: bytes, symbols: bytes) -> tuple[np.ndarray, np.ndarray]:
        bits, symbol = np.zeros(1 << 16, dtype=np.int64), np.zeros(1 << 16, dtype=np.int64)
        for s, (code, n) in codes(counts, symbols).items():
            bits[code << (16 - n) : (code + 1) << (16 - n)] = n
            symbol[code << (16 - n) : (code + 1) << (16 - n)] = s
        return bits, symbol


def decode_frames(frames: list[bytes], known: dict[bytes, Tables]) -> np.ndarray:
    """(frames, blocks) samples of frames that share one head: the flat blocks of a grey picture."""
    tables = next((t for t in known.values() if frames[0].startswith(t.head)), None)
    if tables is None:
        tables = Tables(frames[0])
        known[tables.head] = tables
    if not all(f.startswith(tables.head) for f in frames):
        return np.concatenate([decode_frames([f], known) for f in frames])
    raw = np.frombuffer(b"".join([f[tables.start : -2] for f in frames]), dtype=np.uint8)
    lengths = np.array([len(f) for f in frames]) - tables.start - 2
    ends = lengths.cumsum()
    stuffing = np.flatnonzero((raw[:-1] == 255) & (raw[1:] == 0)) + 1
    raw = np.concatenate([np.delete(raw, stuffing), np.zeros(8, dtype=np.uint8)]).astype(np.uint32)
    starts = ends - lengths
    starts -= np.searchsorted(stuffing, starts)
    windows = (raw[:-2] << np.uint32(16)) | (raw[1:-1] << np.uint32(8)) | raw[2:]
    at = starts * 8
    dc_bits, dc_symbol = tables.tables[0]
    ac_bits, ac_symbol = tables.tables[1]
    out = np.empty((tables.blocks, len(frames)), dtype=np.int16)

    def window(at: np.ndarray) -> np.ndarray:
        return (windows[at >> 3] >> (8 - (at & 7)).astype(np.uint32)) & 0xFFFF

    for block in range(tables.blocks):
        w = window(at).astype(np.int64)
        n, cat = dc_bits[w], dc_symbol[w]
        extra = (w >> (16 - n - cat)) & ((1 << cat) - 1)
        out[block] = np.where(extra >> np.maximum(cat - 1, 0), extra, extra - (1 << cat) + 1)
        at = at + n + cat
        k = np.ones(len(at), dtype=np.int64)
        while True:
            w = window(at)
            s = ac_symbol[w]
            if (s[k < 64] != 0).any():
                raise ValueError("blocks that aren't flat")
            at = at + np.where(k < 64, ac_bits[w] + (s & 15), 0)
            k = np.where((s == 0) | (k >= 64), 64, k + (s >> 4) + 1)
            if (k >= 64).all():
                break
    return (out.cumsum(axis=0, dtype=np.int64).T * tables.quantiser // 8 + 128).astype(np.uint8)


def histograms(samples: np.ndarray) -> np.ndarray:
    """Of each row of samples how many lie in each of 16 bins of grey."""
    n = len(samples)
    return np.bincount(np.repeat(np.arange(n), samples.shape[1]) * 16 + (samples >> 4).ravel(), minlength=n * 16).reshape(n, 16)


def shot_starts(histogram: np.ndarray, counts: np.ndarray) -> np.ndarray:
    """Whether each frame begins a shot, by histograms of UNIT samples each; counts: frames of each file, in order."""
    n = len(histogram)
    change = np.zeros(n, dtype=histogram.dtype)
    change[1:] = np.abs(np.diff(histogram, axis=0)).sum(axis=1)
    ends = counts.cumsum()
    first = np.repeat(ends - counts, counts)
    last = np.repeat(ends, counts)
    here = np.arange(n)
    change[here == first] = 0
    low, high = np.maximum(here - NEIGHBOURS, first + 1), np.minimum(here + NEIGHBOURS + 1, last)
    high = np.maximum(high, low)
    one, two = (np.concatenate([[0], (change**p).cumsum()]) for p in (1, 2))
    near = np.maximum(high - low, 1)
    low = np.minimum(low, n)
    high = np.minimum(high, n)
    mean = (one[high] - one[low]) / near
    deviation = np.sqrt(np.maximum((two[high] - two[low]) / near - mean**2, 0))
    return (here == first) | ((change > mean + DEVIATIONS * deviation) & (change >= LEAST_DIFFERENCE))


def payload_of(data: bytes) -> bytes:
    return data + b" " * (-len(data) % UNIT if data else UNIT)


def files_of(payloads: list[bytes]) -> list[bytes]:
    frames = encode_frames(np.frombuffer(b"".join(payloads), dtype=np.uint8).reshape(-1, UNIT))
    out, at = [], 0
    for p in payloads:
        n = len(p) // UNIT
        out.append(write_avi(frames[at : at + n]))
        at += n
    return out


def contents_of(files: list[bytes], known: dict[bytes, Tables]) -> Iterator[tuple[bytes, list[int], float]]:
    """(payload, first frames of its shots, frames a second) of each file."""
    read = [read_avi(f) for f in files]
    counts = np.array([len(frames) for _, frames in read])
    samples = decode_frames([f for _, frames in read for f in frames], known)
    starts, at = shot_starts(histograms(samples), counts), 0
    for (fps, frames) in read:
        own = samples[at : at + len(frames)]
        yield own.tobytes(), np.flatnonzero(starts[at : at + len(frames)]).tolist(), fps
        at += len(frames)


#: What reading a file that store_media hasn't written may raise.
FOREIGN = (ValueError, IndexError, KeyError, AttributeError, TypeError, struct.error, ZeroDivisionError)


def camera_shots(file: bytes) -> tuple[int, list[int], float]:
    """(frames, first frames of the shots, frames a second) of a motion-JPEG file of any origin; empty frames repeat the one before."""
    fps, frames = read_avi(file)
    pictures = iter(jpeg.decode([f for f in frames if f]))
    seen: list[np.ndarray] = []
    for f in frames:
        if f:
            picture = next(pictures)
            seen.append(np.bincount(picture.ravel() >> 4, minlength=16) * (UNIT / picture.size))
        else:
            seen.append(seen[-1])
    starts = shot_starts(np.array(seen), np.array([len(frames)]))
    return len(frames), np.flatnonzero(starts).tolist(), fps


def shots_of(files: list[bytes], known: dict[bytes, Tables]) -> list[tuple[int, list[int], float] | None]:
    """(frames, first frames of the shots, frames a second) of files of any origin; None where one isn't baseline motion JPEG in an AVI file with frames.

    Files of store_media are decoded side by side; others one by one, with all that baseline pictures may hold."""
    try:
        return [(len(payload) // UNIT, shots, fps) for payload, shots, fps in contents_of(files, known)]
    except FOREIGN:
        if len(files) > 1:
            return [x for f in files for x in shots_of([f], known)]
    try:
        return [camera_shots(files[0])]
    except FOREIGN:
        return [None]


def groups(items: list[bytes], most: int = 1 << 21) -> Iterator[tuple[int, int]]:
    """Slices of some MB each."""
    at = total = 0
    for k, x in enumerate(items):
        total += len(x)
        if total >= most:
            yield at, k + 1
            at, total = k + 1, 0
    if at < len(items):
        yield at, len(items)


def media_digests(df: DataFrame, id_col: str = "doc_id", text_col: str = "text") -> DataFrame:
    """Store every text as an AVI file, read it back, and describe both; the files stay inside the task.

    feature: number of frames, then the shots as first-last frame numbers. Repeated rows give repeated results, an empty table an empty one; other columns are not read.
    """

    def run(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        known: dict[bytes, Tables] = {}
        for batch in batches:
            raw, rows = [as_bytes(t) for t in batch["text"]], []
            for lo, hi in groups(raw):
                files = files_of([payload_of(d) for d in raw[lo:hi]])
                for data, file, (payload, shots, _) in zip(raw[lo:hi], files, contents_of(files, known), strict=True):
                    n = len(payload) // UNIT
                    feature = f"{n}:" + ",".join(f"{a}-{b - 1}" for a, b in zip(shots, [*shots[1:], n], strict=True))
                    rows.append((len(data), len(payload), hashlib.sha256(payload).hexdigest(), zlib.crc32(payload[-16:]), len(file), hashlib.sha256(file).hexdigest(), feature))
            out = pd.DataFrame(rows, columns=["n_bytes", "payload_bytes", "payload_sha256", "tail_crc32", "media_bytes", "media_sha256", "feature"])
            out.insert(0, id_col, batch[id_col].to_numpy())
            yield out

    kind = dict(df.dtypes)[id_col]
    return mapped(df.selectExpr(f"`{id_col}`", f"`{text_col}` AS text"), run, f"`{id_col}` {kind}, n_bytes long, payload_bytes long, payload_sha256 string, tail_crc32 long, media_bytes long, media_sha256 string, feature string")


def store_media(df: DataFrame, id_col: str = "doc_id", text_col: str = "text") -> DataFrame:
    """(id, media binary): every text as an AVI file."""

    def run(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        for batch in batches:
            raw = [as_bytes(t) for t in batch["text"]]
            files = [f for lo, hi in groups(raw) for f in files_of([payload_of(d) for d in raw[lo:hi]])]
            yield pd.DataFrame({id_col: batch[id_col].to_numpy(), "media": files})

    return mapped(df.selectExpr(f"`{id_col}`", f"`{text_col}` AS text"), run, f"`{id_col}` {dict(df.dtypes)[id_col]}, media binary")


def clip_rows(df: DataFrame, id_col: str = "doc_id", media_col: str = "media") -> DataFrame:
    """One row for each shot of each file: (id, clip_no, start_s, end_s, n_frames); rows without a file are left out.

    Frames are baseline JPEG pictures, grey or in colour, of any size. A file that isn't such motion JPEG, or has no frames, gives one row with 0 frames and
    nulls. Repeated rows give repeated clips; an empty table gives an empty result; other columns are not read.
    """

    def run(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        known: dict[bytes, Tables] = {}
        for batch in batches:
            keys, files, rows = batch[id_col].tolist(), [bytes(f) for f in batch["media"]], []
            for lo, hi in groups(files, 1 << 22):
                for key, found in zip(keys[lo:hi], shots_of(files[lo:hi], known), strict=True):
                    if found is None:
                        rows.append((key, None, None, None, 0))
                        continue
                    n, shots, fps = found
                    rows += [(key, k, a / fps, b / fps, b - a) for k, (a, b) in enumerate(zip(shots, [*shots[1:], n], strict=True))]
            yield pd.DataFrame(rows, columns=[id_col, "clip_no", "start_s", "end_s", "n_frames"]).astype({"clip_no": "Int32"})

    return mapped(df.filter(f"`{media_col}` IS NOT NULL").selectExpr(f"`{id_col}`", f"`{media_col}` AS media"), run, f"`{id_col}` {dict(df.dtypes)[id_col]}, clip_no int, start_s double, end_s double, n_frames int")
