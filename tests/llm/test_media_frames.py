"""Motion JPEG of other origin: pictures that the JVM's own codec has written, and what it reads from them."""

from __future__ import annotations

import base64
import struct

import numpy as np
import pytest

from cuelake.llm import jpeg, media

WIDE, TALL = 70, 45


def picture(seed: int, wide: int = WIDE, tall: int = TALL, colour: bool = False) -> np.ndarray:
    """Smooth ground, an edge and some noise."""
    rng = np.random.default_rng(seed)
    x, y = np.meshgrid(np.arange(wide), np.arange(tall))
    planes = [np.clip(128 + 90 * np.sin((x * rng.uniform(0.02, 0.2) + y * rng.uniform(0.02, 0.2))) + 60 * (x > rng.integers(wide)) + rng.normal(0, 8, (tall, wide)), 0, 255) for _ in range(3 if colour else 1)]
    return np.stack(planes, axis=2).astype(np.uint8)


def java_bytes(jvm, values: bytes):
    return jvm.java.util.Base64.getDecoder().decode(base64.b64encode(values).decode())


def encode(spark, pixels: np.ndarray, quality: float = 0.9) -> bytes:
    """A JPEG file by the JVM's codec: grey, or colour with chroma of half the size."""
    jvm = spark._jvm
    tall, wide, planes = pixels.shape
    image = jvm.java.awt.image.BufferedImage(wide, tall, 10 if planes == 1 else 5)  # TYPE_BYTE_GRAY, TYPE_3BYTE_BGR
    data = java_bytes(jvm, np.ascontiguousarray(pixels[:, :, ::-1]).tobytes())
    image.setData(jvm.java.awt.image.Raster.createRaster(image.getSampleModel(), jvm.java.awt.image.DataBufferByte(data, wide * tall * planes), None))
    writer = jvm.javax.imageio.ImageIO.getImageWritersByFormatName("jpg").next()
    params = writer.getDefaultWriteParam()
    params.setCompressionMode(2)
    params.setCompressionQuality(float(quality))
    out = jvm.java.io.ByteArrayOutputStream()
    stream = jvm.javax.imageio.ImageIO.createImageOutputStream(out)
    writer.setOutput(stream)
    writer.write(None, jvm.javax.imageio.IIOImage(image, None, None), params)
    stream.close()
    writer.dispose()
    return bytes(out.toByteArray())


def decode(spark, file: bytes) -> np.ndarray:
    jvm = spark._jvm
    image = jvm.javax.imageio.ImageIO.read(jvm.java.io.ByteArrayInputStream(java_bytes(jvm, file)))
    data = np.frombuffer(bytes(image.getRaster().getDataBuffer().getData()), dtype=np.uint8)
    return data.reshape(image.getHeight(), image.getWidth(), -1)


@pytest.mark.parametrize("quality", [0.3, 0.75, 0.95, 1.0])
@pytest.mark.parametrize("size", [(WIDE, TALL), (8, 8), (1, 1), (64, 16)])
def test_grey_pictures(spark, quality, size):
    files = [encode(spark, picture(k, *size), quality) for k in range(5)]
    for file, own in zip(files, jpeg.decode(files), strict=True):
        assert np.abs(own.astype(int) - decode(spark, file)[:, :, 0]).max() <= 1


@pytest.mark.parametrize("quality", [0.5, 0.9])
def test_the_luma_of_colour_pictures(spark, quality):
    """Chroma of half the size: the luma is that of the colours that the JVM's codec gives, but for rounding."""
    files = [encode(spark, picture(k, colour=True), quality) for k in range(4)]
    for file, own in zip(files, jpeg.decode(files), strict=True):
        assert (jpeg.Layout(file).across, jpeg.Layout(file).down) == (2, 2)
        blue, green, red = (decode(spark, file)[:, :, k].astype(float) for k in range(3))
        expected = 0.299 * red + 0.587 * green + 0.114 * blue
        inside = (blue > 2) & (blue < 253) & (green > 2) & (green < 253) & (red > 2) & (red < 253)  # where no colour was cut off
        assert np.abs(own - expected)[inside].max() <= 2


def without_tables(file: bytes) -> bytes:
    """A picture as motion JPEG has it: no Huffman tables of its own."""
    at, out = 2, [file[:2]]
    while True:
        marker, size = file[at + 1], struct.unpack_from(">H", file, at + 2)[0]
        if marker != 0xC4:
            out.append(file[at : at + 2 + size])
        at += 2 + size
        if marker == 0xDA:
            return b"".join([*out, file[at:]])


@pytest.mark.parametrize("colour", [False, True])
def test_pictures_without_tables(spark, colour):
    file = encode(spark, picture(3, colour=colour), 0.8)
    bare = without_tables(file)
    assert len(bare) < len(file)
    assert (jpeg.decode([bare])[0] == jpeg.decode([file])[0]).all()


def with_restarts(samples: np.ndarray) -> bytes:
    """A flat grey picture with a restart marker after every block."""
    frames = media.encode_frames(samples.reshape(-1, 1).repeat(media.UNIT, axis=1))
    head = media.FRAME_HEAD
    size = head.find(b"\xff\xc0") + 5
    head = head[:size] + struct.pack(">HH", 8, 8 * len(samples)) + head[size + 4 :]
    scan = head.find(b"\xff\xda")
    head = head[:scan] + media.segment(0xDD, struct.pack(">H", 1)) + head[scan:]
    pieces = []
    for f, s in zip(frames, samples, strict=True):
        d = int(s) - 128
        category = abs(d).bit_length()
        code, bits = media.codes(media.DC_COUNTS, media.DC_SYMBOLS)[category]
        text = f"{code:0{bits}b}" + (f"{d if d > 0 else d + (1 << category) - 1:0{category}b}" if category else "") + "0"
        text += "1" * (-len(text) % 8)
        pieces.append(bytes(int(text[k : k + 8], 2) for k in range(0, len(text), 8)).replace(b"\xff", b"\xff\x00"))
        assert f.startswith(media.FRAME_HEAD)
    return head + b"".join(p + bytes([0xFF, 0xD0 + k % 8]) * (k + 1 < len(pieces)) for k, p in enumerate(pieces)) + b"\xff\xd9"


def test_restart_markers():
    samples = np.array([0, 255, 128, 127, 129, 1, 77, 255, 254, 3, 200, 200], dtype=np.uint8)
    own = jpeg.decode([with_restarts(samples)])[0]
    assert own.shape == (8, 8 * len(samples)) and (own == samples.repeat(8)).all()


def test_the_frames_of_store_media_are_ordinary_pictures(spark):
    samples = np.random.default_rng(0).integers(0, 256, (3, media.UNIT)).astype(np.uint8)
    for row, own, file in zip(samples, jpeg.decode(media.encode_frames(samples)), media.encode_frames(samples), strict=True):
        assert (own[::8, ::8].ravel() == row).all() and (own == decode(spark, file)[:, :, 0]).all()


def avi(frames: list[bytes], absolute: bool = False, index: bool = True) -> bytes:
    file = media.write_avi(frames)
    at = file.find(b"movi")
    ix = file.rfind(b"idx1")
    if not index:
        return file[:ix]
    if not absolute:
        return file
    rows = [(n, f, o + at, s) for n, f, o, s in struct.iter_unpack("<4sIII", file[ix + 8 :])]
    return file[: ix + 8] + b"".join(struct.pack("<4sIII", *r) for r in rows)


@pytest.mark.parametrize("colour", [False, True])
def test_shots_of_camera_files(spark, colour):
    """Three scenes of colour pictures: cut where the scene changes, with indexes of either kind and without one."""
    scenes = [picture(k, colour=colour) // 4 + 60 * k for k in range(3)]
    rng = np.random.default_rng(1)
    frames = [encode(spark, np.clip(scenes[k // 8].astype(int) + rng.integers(-2, 3, scenes[0].shape), 0, 255).astype(np.uint8), 0.85) for k in range(24)]
    frames[5] = b""  # a dropped frame shows the one before
    rows = [(1, avi(frames)), (2, avi(frames, absolute=True)), (3, avi(frames, index=False)), (4, avi([without_tables(f) if f else f for f in frames]))]
    got = media.clip_rows(spark.createDataFrame(rows, "doc_id long, media binary")).collect()
    for k in range(1, 5):
        assert [(r.clip_no, r.start_s, r.end_s, r.n_frames) for r in got if r.doc_id == k] == [(j, j * 8 / 25, (j + 1) * 8 / 25, 8) for j in range(3)]


def test_files_that_are_no_such_thing(spark):
    """Cut short, progressive, with a broken index or coefficients: one row without frames."""
    good = encode(spark, picture(1), 0.9)
    rng = np.random.default_rng(2)
    bad = [b"", b"RIFF", avi([good])[:200], avi([good[: len(good) // 2]]), avi([good.replace(b"\xff\xc0", b"\xff\xc2")]), avi([b"\xff\xd8" + rng.bytes(300)]), avi([good]).replace(b"00dc", b"xxxx"), avi([b""]), good]
    rows = [(k, b) for k, b in enumerate(bad)] + [(99, avi([good]))]
    got = {r.doc_id: r.n_frames for r in media.clip_rows(spark.createDataFrame(rows, "doc_id long, media binary")).collect()}
    assert got.pop(99) == 1
    assert got == {k: 0 for k in range(len(bad))}


def test_damaged_pictures_never_hang(spark):
    """Flipped bytes give some picture or an error that counts as foreign."""
    good, rng = encode(spark, picture(1), 0.9), np.random.default_rng(4)
    for _ in range(60):
        data = bytearray(good)
        for k in rng.integers(2, len(data), 3):
            data[k] = rng.integers(256)
        try:
            jpeg.decode([bytes(data)])
        except media.FOREIGN:
            continue
