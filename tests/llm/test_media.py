import hashlib
import random
import zlib

import numpy as np

from millrace.llm import media as M


def test_zigzag_starts_and_ends_as_the_standard_says():
    assert M.ZIGZAG[:10].tolist() == [0, 1, 8, 16, 9, 2, 3, 10, 17, 24] and M.ZIGZAG[-3:].tolist() == [55, 62, 63]


def slow_planes(jpeg, monkeypatch):
    monkeypatch.setattr(M, "read_whole", lambda *a: False)
    return M.decode_coefficients(jpeg)["planes"]


def test_round_trip_and_both_ways_of_reading(monkeypatch):
    rnd = random.Random(3)
    payloads = [M.padded(t)[1] for t in (None, "", "a", "é" * 500, "x" * 192)] + [bytes(rnd.randrange(256) for _ in range(192 * n)) for n in (1, 2, 3, 7, 20)]
    whole = {p: M.decode_coefficients(M.encode(p)) for p in payloads}
    for p, frame in whole.items():
        assert M.payload_of(frame) == p
        rgb = M.to_rgb(frame)
        assert rgb.shape == (frame["height"], frame["width"], 3) and rgb.dtype == np.uint8
    for p in payloads:
        for a, b in zip(slow_planes(M.encode(p), monkeypatch), whole[p]["planes"], strict=True):
            assert (a == b).all()


def test_long_runs_of_blocks():
    p = bytes(range(256)) * 6 * 3500
    assert M.payload_of(M.decode_coefficients(M.encode(p))) == p


def test_transform_against_the_formula():
    frame = M.decode_coefficients(M.encode(bytes(range(192)) * 2))
    frame["planes"] = [np.zeros_like(p) for p in frame["planes"]]
    frame["planes"][0][:, 0], frame["planes"][0][0, 1] = 80, 40
    y = 128 + 80 / 8 + 40 * 0.25 / np.sqrt(2) * np.cos((2 * np.arange(8) + 1) * np.pi / 16)
    assert (np.abs(M.to_rgb(frame)[0, :8, 1] - y) <= 0.51).all()


def slow_rgb(frame):
    """The tensor of a whole image, block by block and cosine by cosine, in 64 bits."""
    k = np.arange(8)
    cosine = np.cos((2 * k[:, None] + 1) * k[None, :] * np.pi / 16) * np.where(k == 0, np.sqrt(1 / 8), 0.5)  # pixel, frequency
    full = []
    for (_, h, v, _), planes, q in zip(frame["parts"], frame["planes"], frame["quant"], strict=True):
        across, down = frame["mw"] * h, frame["mh"] * v
        image = np.zeros((down * 8, across * 8))
        for b, coefficients in enumerate(planes * q):
            block = np.zeros(64)
            block[M.ZIGZAG] = coefficients
            y, x = divmod(b, across)
            image[y * 8 : y * 8 + 8, x * 8 : x * 8 + 8] = cosine @ block.reshape(8, 8) @ cosine.T + 128
        full.append(np.clip(np.rint(image), 0, 255).repeat(frame["vmax"] // v, 0).repeat(frame["hmax"] // h, 1))
    y, cb, cr = full
    rgb = np.stack([y + 1.402 * (cr - 128), y - 0.344136 * (cb - 128) - 0.714136 * (cr - 128), y + 1.772 * (cb - 128)], -1)
    return np.clip(np.rint(rgb), 0, 255)[: frame["height"], : frame["width"]]


def test_tensors_against_a_slow_transform_of_whole_images(spark):
    df = spark.createDataFrame([(1, "Some words, and more. " * 60), (2, "é" * 700), (3, None)], "doc_id long, text string")
    for r in M.tensors(M.store(df)).collect():
        rgb = np.frombuffer(r.rgb, np.uint8).reshape(r.height, r.width, 3)
        off = np.abs(rgb - slow_rgb(M.decode_coefficients(bytes(r.media))))
        assert off.max() <= 2 and (off > 0).mean() < 0.02  # rounding of 32-bit floats
        assert len(r.payload) % 192 == 0


def test_rows(spark):
    df = spark.createDataFrame([(1, None, 1), (2, "", 2), (3, "ab" * 200, 3), (3, "ab" * 200, 3)], "doc_id long, text string, media int")
    rows = sorted(M.features(M.tensors(M.store(df))).collect())
    assert rows[0].payload_bytes == 192 and rows[0].n_bytes == 0 and rows[0].payload_sha256 == hashlib.sha256(b" " * 192).hexdigest()
    assert rows[2] == rows[3] and rows[2].payload_bytes == 576 and rows[2].tail_crc32 == zlib.crc32(b" " * 16)
    assert M.features(M.tensors(M.store(df.limit(0)))).count() == 0
