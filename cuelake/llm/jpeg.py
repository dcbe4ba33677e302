"""Baseline JPEG pictures, many at a time: Huffman codes, coefficients, inverse DCT, and the luma of the picture.

The entropy-coded stretches of all pictures (one for each restart interval) are lanes that advance side by side, one symbol a
step, so that the steps are array operations. Pictures may be grey or in three components with any sampling; of
colour pictures only the luma is transformed. Pictures without Huffman tables, as motion JPEG has them, use
those of the standard. Progressive, arithmetic and 12-bit pictures are errors.
"""

from __future__ import annotations

import re
import struct

import numpy as np

#: Fixed Huffman tables of the JPEG standard: numbers of codes with 1 to 16 bits, then the symbols in code order.
STANDARD = {
    (0, 0): (bytes([0, 1, 5, 1, 1, 1, 1, 1, 1, 0, 0, 0, 0, 0, 0, 0]), bytes(range(12))),
    (0, 1): (bytes([0, 3, 1, 1, 1, 1, 1, 1, 1, 1, 1, 0, 0, 0, 0, 0]), bytes(range(12))),
    (1, 0): (
        bytes([0, 2, 1, 3, 3, 2, 4, 3, 5, 5, 4, 4, 0, 0, 1, 125]),
        bytes.fromhex("01020300041105122131410613516107227114328191a1082342b1c11552d1f02433627282090a161718191a25262728292a3435363738393a434445464748494a535455565758595a636465666768696a737475767778797a838485868788898a92939495969798999aa2a3a4a5a6a7a8a9aab2b3b4b5b6b7b8b9bac2c3c4c5c6c7c8c9cad2d3d4d5d6d7d8d9dae1e2e3e4e5e6e7e8e9eaf1f2f3f4f5f6f7f8f9fa"),
    ),
    (1, 1): (
        bytes([0, 2, 1, 2, 4, 4, 3, 4, 7, 5, 4, 4, 0, 1, 2, 119]),
        bytes.fromhex("000102031104052131061241510761711322328108144291a1b1c109233352f0156272d10a162434e125f11718191a262728292a35363738393a434445464748494a535455565758595a636465666768696a737475767778797a82838485868788898a92939495969798999aa2a3a4a5a6a7a8a9aab2b3b4b5b6b7b8b9bac2c3c4c5c6c7c8c9cad2d3d4d5d6d7d8d9dae2e3e4e5e6e7e8e9eaf2f3f4f5f6f7f8f9fa"),
    ),
}
#: Bytes of coefficients that are held at once.
HELD = 1 << 26
RESTART = re.compile(rb"\xff[\xd0-\xd7]")


def zigzag() -> np.ndarray:
    """Row-major place of each coefficient in coding order: along the diagonals, every other one upwards."""
    order = sorted(((r, c) for r in range(8) for c in range(8)), key=lambda p: (p[0] + p[1], p[0] if (p[0] + p[1]) % 2 else p[1]))
    return np.array([8 * r + c for r, c in order])


ZIGZAG = zigzag()
DCT = np.array([[np.sqrt((1 if k == 0 else 2) / 8) * np.cos((2 * n + 1) * k * np.pi / 16) for n in range(8)] for k in range(8)])


def look_up(counts: bytes, symbols: bytes) -> tuple[np.ndarray, np.ndarray]:
    """(bits, symbol) of the code that each window of 16 bits begins with; 0 bits where none does."""
    bits, symbol = np.zeros(1 << 16, dtype=np.uint8), np.zeros(1 << 16, dtype=np.uint8)
    code = k = 0
    for n, many in enumerate(counts, 1):
        for _ in range(many):
            span = slice(code << (16 - n), (code + 1) << (16 - n))
            bits[span], symbol[span] = n, symbols[k]
            code, k = code + 1, k + 1
        code <<= 1
    return bits, symbol


class Layout:
    """What the head of a picture says: size, components with their sampling and tables, restart interval."""

    def __init__(self, picture: bytes):
        if picture[:2] != b"\xff\xd8":
            raise ValueError("not a JPEG picture")
        at, self.interval, quantisers, huffman, frame = 2, 0, {}, dict(STANDARD), None
        while True:
            while picture[at] == 0xFF and picture[at + 1] == 0xFF:  # fill bytes
                at += 1
            if picture[at] != 0xFF:
                raise ValueError("no marker where one has to be")
            marker, size = picture[at + 1], struct.unpack_from(">H", picture, at + 2)[0]
            body = picture[at + 4 : at + 2 + size]
            at += 2 + size
            if marker == 0xDB:
                k = 0
                while k < len(body):
                    wide = body[k] >> 4
                    values = np.frombuffer(body, ">u2" if wide else ">u1", 64, k + 1)
                    quantisers[body[k] & 15] = values.astype(np.int64)
                    k += 1 + 64 * (1 + wide)
            elif marker == 0xC4:
                k = 0
                while k < len(body):
                    n = sum(body[k + 1 : k + 17])
                    huffman[body[k] >> 4, body[k] & 15] = (body[k + 1 : k + 17], body[k + 17 : k + 17 + n])
                    k += 17 + n
            elif marker in (0xC0, 0xC1):
                if body[0] != 8:
                    raise ValueError("not of 8 bits")
                self.height, self.width = struct.unpack_from(">HH", body, 1)
                frame = [(body[k], body[k + 1] >> 4, body[k + 1] & 15, body[k + 2]) for k in range(6, 6 + 3 * body[5], 3)]
            elif 0xC2 <= marker <= 0xCF and marker not in (0xC8, 0xCC):
                raise ValueError("not a baseline picture")
            elif marker == 0xDD:
                self.interval = struct.unpack(">H", body[:2])[0]
            elif marker == 0xDA:
                break
        if frame is None or not self.height or not self.width or body[0] != len(frame):
            raise ValueError("no frame, or a scan of a part of its components")
        tables = {body[k]: (body[k + 1] >> 4, body[k + 1] & 15) for k in range(1, 1 + 2 * body[0], 2)}
        self.start, self.head = at, picture[:at]
        if len(frame) == 1:
            frame = [(frame[0][0], 1, 1, frame[0][3])]
        self.across, self.down = frame[0][1], frame[0][2]
        widest, tallest = max(f[1] for f in frame), max(f[2] for f in frame)
        if (self.across, self.down) != (widest, tallest):
            raise ValueError("a luma of less than the full size")
        self.units = (-(-self.width // (8 * widest)), -(-self.height // (8 * tallest)))
        #: For each block of a unit: its component, and the look-up tables of its DC and AC codes.
        self.component = np.array([k for k, f in enumerate(frame) for _ in range(f[1] * f[2])])
        names = sorted({(kind, tables[f[0]][kind]) for f in frame for kind in (0, 1)})
        looked = [look_up(*huffman[n]) for n in names]
        self.bits, self.symbol = np.stack([b for b, _ in looked]), np.stack([s for _, s in looked])
        self.dc, self.ac = (np.array([names.index((kind, tables[frame[k][0]][kind])) for k in self.component]) for kind in (0, 1))
        self.quantiser = quantisers[frame[0][3]]

    def lanes(self, picture: bytes) -> list[bytes]:
        """The entropy-coded bytes of each restart interval, without stuffing."""
        end = picture.rfind(b"\xff\xd9")
        coded = picture[self.start : end if end >= self.start else len(picture)]
        return [p.replace(b"\xff\x00", b"\xff") for p in (RESTART.split(coded) if self.interval else [coded])]


def luma(pictures: list[bytes], layout: Layout) -> np.ndarray:
    """(pictures, height, width) of pictures that share one layout."""
    n_units, per_unit = layout.units[0] * layout.units[1], len(layout.component)
    every = layout.interval or n_units
    pieces = [layout.lanes(p) for p in pictures]
    need = -(-n_units // every)
    if any(len(p) != need for p in pieces):
        raise ValueError("restart markers are missing")
    lanes = [x for p in pieces for x in p]
    blocks = np.array([min(every, n_units - k * every) * per_unit for _ in pictures for k in range(need)])
    raw = np.frombuffer(b"".join(x + b"\0" * 16 for x in lanes), dtype=np.uint8).astype(np.uint64)
    ends = np.cumsum([len(x) + 16 for x in lanes])
    bit = (ends - np.array([len(x) + 16 for x in lanes])) * 8
    last = ends * 8 - 64
    windows = np.zeros(len(raw), dtype=np.uint64)
    for k in range(5):  # 40 bits from each byte on
        windows[: len(raw) - 4] |= raw[k : len(raw) - 4 + k] << np.uint64(8 * (4 - k))
    luma_blocks = layout.across * layout.down
    out = np.zeros((len(lanes), every * luma_blocks, 64), dtype=np.int16)
    before = np.zeros((len(lanes), layout.component.max() + 1), dtype=np.int64)
    lane, block, k = np.arange(len(lanes)), np.zeros(len(lanes), dtype=np.int64), np.zeros(len(lanes), dtype=np.int64)
    while len(lane):
        inner = block % per_unit
        first = k == 0
        here = bit[lane]
        if (here > last[lane]).any():
            raise ValueError("a picture that ends too soon")
        w = (windows[here >> 3] >> (np.uint64(8) - (here & 7).astype(np.uint64))) & np.uint64(0xFFFFFFFF)
        table, top = np.where(first, layout.dc[inner], layout.ac[inner]), (w >> np.uint64(16)).astype(np.int64)
        n, symbol = layout.bits[table, top].astype(np.int64), layout.symbol[table, top].astype(np.int64)
        if not n.all():
            raise ValueError("no code of the table")
        size = np.where(first, symbol, symbol & 15)
        if (size > 15).any():
            raise ValueError("no size of a coefficient")
        extra = (w.astype(np.int64) >> (32 - n - size)) & ((1 << size) - 1)
        value = np.where(size == 0, 0, np.where(extra >> np.maximum(size - 1, 0) != 0, extra, extra - (1 << size) + 1))
        bit[lane] = here + n + size
        at = np.where(first, 0, k + (symbol >> 4))
        if (at[size > 0] > 63).any():
            raise ValueError("a coefficient beyond the last")
        component = layout.component[inner]
        before[lane[first], component[first]] += value[first]
        value = np.where(first, before[lane, component], value)
        held = (component == 0) & (first | (size > 0))
        out[lane[held], (block // per_unit * luma_blocks + inner)[held], ZIGZAG[at[held]]] = value[held]
        k = np.where(first, 1, np.where(size > 0, at + 1, np.where(symbol == 0xF0, k + 16, 64)))  # a size of 0: sixteen zeros, or the end
        done = k >= 64
        block, k = block + done, np.where(done, 0, k)
        going = block < blocks[lane]
        if not going.all():
            lane, block, k = lane[going], block[going], k[going]
    quantiser = np.zeros(64)
    quantiser[ZIGZAG] = layout.quantiser
    wide, tall = layout.units
    coefficients = out.reshape(len(pictures), need * every * luma_blocks, 64)[:, : n_units * luma_blocks] * quantiser
    samples = np.clip(np.rint(DCT.T @ coefficients.reshape(-1, 8, 8) @ DCT) + 128, 0, 255).astype(np.uint8)
    grid = samples.reshape(len(pictures), tall, wide, layout.down, layout.across, 8, 8).transpose(0, 1, 3, 5, 2, 4, 6)
    return grid.reshape(len(pictures), tall * layout.down * 8, wide * layout.across * 8)[:, : layout.height, : layout.width]


def decode(pictures: list[bytes]) -> list[np.ndarray]:
    """The luma of each picture."""
    out: list[np.ndarray] = []
    layout = None
    at = 0
    while at < len(pictures):
        if layout is None or not pictures[at].startswith(layout.head):
            layout = Layout(pictures[at])
        size = layout.units[0] * layout.units[1] * layout.across * layout.down * 128
        end = at + 1
        while end < len(pictures) and (end - at + 1) * size <= HELD and pictures[end].startswith(layout.head):
            end += 1
        out += list(luma(pictures[at:end], layout))
        at = end
    return out
