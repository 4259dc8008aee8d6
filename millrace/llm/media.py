"""Media columns: bytes kept as the coefficients of progressive JPEG images, and RGB tensors read back.

`encode` writes a payload as the quantised coefficients of a colour image with halved chroma: byte b is
the coefficient b (128 to 255) or b - 255 (below 128), so that each has eight magnitude bits and none is
zero. The image is sent in progressive scans: DC without its lowest bit, bands of AC without theirs, then
one refinement scan each. `decode_coefficients` accumulates spectral-selection and successive-approximation
scans of any progressive Huffman-coded JPEG into coefficient arrays; scans in which every code is one
symbol of one length (those of `encode`) are read as whole bit arrays. `to_rgb` dequantises, inverts the
cosine transform with numpy, upsamples chroma and returns the full-resolution tensor.

Defined cases: null and empty texts are 192 spaces; equal texts give equal values; the payload's length
is in a comment segment, as whole macroblocks of 384 bytes are stored; rows without an id keep the null; repeated rows are
returned each; very long texts are whole, and worked on alone; an empty table gives no rows; other columns are not read,
whatever their names.
"""

import hashlib
import re
import struct
import zlib
from collections.abc import Iterator
from functools import lru_cache

import numpy as np
import pyarrow as pa
import pyarrow.compute as pc
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

UNIT, MCU = 192, 384
#: The zigzag order of the JPEG standard, made by walking the anti-diagonals.
ZIGZAG = np.array([v * 8 + u for u, v in sorted(((u, v) for u in range(8) for v in range(8)), key=lambda x: (sum(x), x[1] if sum(x) % 2 else x[0]))])
_k = np.arange(8)
COSINE = (np.where(_k == 0, np.sqrt(0.125), 0.5)[:, None] * np.cos((2 * _k[None, :] + 1) * _k[:, None] * np.pi / 16)).astype(np.float32)
#: Rows: coefficients in zigzag order; columns: pixels of the block.
INVERSE = np.einsum("vy,ux->vuyx", COSINE, COSINE).reshape(64, 64)[ZIGZAG].astype(np.float32)
#: Bands of AC coefficients, of luma and of each chroma component.
BANDS = (((1, 5), (6, 63)), ((1, 63),), ((1, 63),))


#: From Y, Cb, Cr to red, green, blue, as in JFIF.
COLOUR = np.array([[1, 1, 1], [0, -0.344136, 1.772], [1.402, -0.714136, 0]], np.float32)
OFFSET = -128 * COLOUR[1:].sum(0)


def segment(marker: int, body: bytes) -> bytes:
    return struct.pack(">BBH", 0xFF, marker, len(body) + 2) + body


def huffman_table(kind: int, ident: int, symbols: list[int], length: int) -> bytes:
    """A table in which every symbol has a code of the same length."""
    counts = [0] * 16
    counts[length - 1] = len(symbols)
    return segment(0xC4, bytes([kind << 4 | ident, *counts, *symbols]))


def packed(bits: np.ndarray) -> bytes:
    """The bits as entropy-coded bytes: the last one filled with ones, a zero put after each 255."""
    out = np.packbits(bits)
    if pad := -len(bits) % 8:
        out[-1] |= (1 << pad) - 1
    return out.tobytes().replace(b"\xff", b"\xff\x00")


def categories(values: np.ndarray) -> np.ndarray:
    """Bits that the magnitude of each value needs."""
    return np.frexp(np.abs(values).astype(np.float64))[1].astype(np.int64)


def dc_bits(blocks: np.ndarray) -> np.ndarray:
    """Codes of the differences of DC values: four bits for the category, then its magnitude bits."""
    diff = np.diff(blocks, prepend=0)
    cat = categories(diff)
    raw = np.where(diff < 0, diff + (1 << cat) - 1, diff)
    both = ((cat << 12) | (raw << (12 - cat))).astype(">u2")
    return np.unpackbits(both.view(np.uint8)).reshape(-1, 16)[np.arange(16)[None, :] < (4 + cat)[:, None]]


def grid(n_mcu: int) -> tuple[int, int]:
    """Macroblocks across and down of the most nearly square image that holds so many."""
    wide = max(1, int(np.ceil(np.sqrt(n_mcu))))
    return wide, -(-n_mcu // wide)


@lru_cache(4096)
def head(wide: int, high: int) -> bytes:
    """Everything before the scans but the comment."""
    out = [segment(0xDB, bytes([0, *[1] * 64]))]
    out.append(segment(0xC2, struct.pack(">BHHB", 8, high * 16, wide * 16, 3) + bytes([1, 0x22, 0, 2, 0x11, 0, 3, 0x11, 0])))
    out += [huffman_table(0, 0, list(range(12)), 4), huffman_table(1, 0, [0x07], 1), huffman_table(1, 1, [0xE0, 0x00], 2)]
    return b"".join(out)


def scan_head(component: int, lo: int, hi: int, ah: int, al: int, table: int = 0) -> bytes:
    return segment(0xDA, bytes([1, component, table, lo, hi, ah << 4 | al]))


def corrections(low: np.ndarray) -> np.ndarray:
    """Runs of blocks without new coefficients: the run's code, its low bits, then a bit for each coefficient."""
    runs, at, n = [], 0, 1 << 14
    while len(low) - at >= n:
        runs += [np.zeros(16, np.uint8), low[at : at + n].reshape(-1)]
        at += n
    one = np.empty((len(low) - at, low.shape[1] + 2), np.uint8)
    one[:, 0], one[:, 1], one[:, 2:] = 0, 1, low[at:]
    return np.concatenate([*runs, one.reshape(-1)]) if runs else one.reshape(-1)


def encode_batch(payloads: list[bytes]) -> list[bytes]:
    """Payloads (each a positive multiple of 192 bytes) as progressive JPEG files."""
    grids = [grid(-(-len(p) // MCU)) for p in payloads]
    data = np.frombuffer(b"".join(p.ljust(w * h * MCU, b" ") for p, (w, h) in zip(payloads, grids, strict=True)), np.uint8).reshape(-1, 6, 64)
    luma, at = np.empty((len(data), 4, 64), np.uint8), 0
    for w, h in grids:
        luma[at : at + w * h] = data[at : at + w * h, :4].reshape(h, w, 2, 2, 64).transpose(0, 2, 1, 3, 4).reshape(-1, 4, 64)
        at += w * h
    planes = []  # per component: blocks per macroblock, DC, bits of AC without the lowest, lowest bits of AC
    for plane, bands in zip((luma.reshape(-1, 64), np.ascontiguousarray(data[:, 4]), np.ascontiguousarray(data[:, 5])), BANDS, strict=True):
        dc = plane[:, 0].astype(np.int32)
        dc -= (dc < 128) * 255
        ac = plane[:, 1:]
        # magnitudes are b or 255 - b; a negative half is written as 127 less it, which is b >> 1 too
        planes.append((len(plane) // len(data), dc, [(lo, hi, np.ascontiguousarray(ac[:, lo - 1 : hi] >> 1)) for lo, hi in bands], (ac ^ (ac < 128)) & 1))
    out, at = [], 0
    for payload, (w, h) in zip(payloads, grids, strict=True):
        file, late = [b"\xff\xd8", segment(0xFE, b"payload=%d" % len(payload)), head(w, h)], []
        for c, (per, dc, bands, low) in enumerate(planes, 1):
            own = slice(at * per, (at + w * h) * per)
            file += [scan_head(c, 0, 0, 0, 1), packed(dc_bits(dc[own] >> 1))]
            for lo, hi, half in bands:
                file += [scan_head(c, lo, hi, 0, 1), half[own].tobytes()]  # code 0 and seven bits: a byte below 128
            late += [scan_head(c, 0, 0, 1, 0), packed((dc[own] & 1).astype(np.uint8)), scan_head(c, 1, 63, 1, 0, 1), packed(corrections(low[own]))]
        out.append(b"".join([*file, *late, b"\xff\xd9"]))
        at += w * h
    return out


def encode(payload: bytes) -> bytes:
    """One payload as a progressive JPEG file."""
    return encode_batch([payload])[0]


class Bits:
    """Bits of one entropy-coded segment, read in order; beyond the end there are zeros."""

    def __init__(self, raw: bytes):
        self.data, self.at, self.n, self.acc = raw, 0, 0, 0

    def take(self, k: int) -> int:
        while self.n < k:
            step = self.data[self.at : self.at + 8]
            self.acc = self.acc << 64 | int.from_bytes(step.ljust(8, b"\0"), "big")
            self.at, self.n = self.at + 8, self.n + 64
        self.n -= k
        out = self.acc >> self.n
        self.acc &= (1 << self.n) - 1
        return out

    def symbol(self, codes: dict[tuple[int, int], int]) -> int:
        code = 0
        for length in range(1, 17):
            code = code << 1 | self.take(1)
            if (found := codes.get((length, code))) is not None:
                return found
        raise ValueError("no such Huffman code")

    def signed(self, size: int) -> int:
        if not size:
            return 0
        v = self.take(size)
        return v if v >> (size - 1) else v - (1 << size) + 1


class Table(dict):
    """Huffman codes, (length, code) to symbol, and what they have in common."""

    def __init__(self, codes: dict[tuple[int, int], int]):
        super().__init__(codes)
        lengths = {n for n, _ in codes}
        #: The symbol of a table that has only one, with the code 0.
        self.single = codes[1, 0] if len(codes) == 1 and (1, 0) in codes else None
        #: The length of all codes if it is the same and code n stands for symbol n, else 0.
        self.width = lengths.pop() if len(lengths) == 1 and all(c == x for (_, c), x in codes.items()) else 0
        #: Whether there are only the two codes with which `encode` refines.
        self.refines = sorted(codes.items()) == [((2, 0), 0xE0), ((2, 1), 0x00)]


@lru_cache(256)
def parsed_tables(body: bytes) -> tuple:
    """The tables of a DHT segment, with their class and number."""
    found = []
    while body:
        code, codes, k = 0, {}, 17
        for length, n in enumerate(body[1:17], 1):
            for _ in range(n):
                codes[length, code] = body[k]
                code, k = code + 1, k + 1
            code <<= 1
        found.append(((body[0] >> 4, body[0] & 15), Table(codes)))
        body = body[k:]
    return tuple(found)


def dc_first(order: list[tuple[int, int]], planes: list[np.ndarray], bits: Bits, tables: list[dict], al: int) -> None:
    width = [t.width for t in tables]
    last = [0] * len(planes)
    got: list[tuple[list, list]] = [([], []) for _ in planes]
    take = bits.take
    for c, b in order:
        size = take(width[c]) if width[c] else bits.symbol(tables[c])
        if size:
            v = take(size)
            last[c] += v if v >> (size - 1) else v - (1 << size) + 1
        got[c][0].append(b)
        got[c][1].append(last[c])
    for plane, (at, values) in zip(planes, got, strict=True):
        plane[at, 0] = np.array(values, np.int16) << al


def ac_first(plane: np.ndarray, blocks: np.ndarray, bits: Bits, table: dict, lo: int, hi: int, al: int) -> None:
    run = 0
    for b in blocks:
        if run:
            run -= 1
            continue
        k, row = lo, plane[b]
        while k <= hi:
            rs = bits.symbol(table)
            r, s = rs >> 4, rs & 15
            if not s:
                if r < 15:
                    run = (1 << r) - 1 + (bits.take(r) if r else 0)
                    break
                k += 16
                continue
            k += r
            row[k] = bits.signed(s) * (1 << al)
            k += 1


def ac_refine(plane: np.ndarray, blocks: np.ndarray, bits: Bits, table: dict, lo: int, hi: int, al: int) -> None:
    run, one = 0, 1 << al

    def correct(row: np.ndarray, k: int) -> None:
        if bits.take(1) and not abs(int(row[k])) & one:
            row[k] += one if row[k] > 0 else -one

    for b in blocks:
        k, row = lo, plane[b]
        if not run:
            while k <= hi:
                rs = bits.symbol(table)
                r, s = rs >> 4, rs & 15
                value = 0
                if s:
                    value = one if bits.take(1) else -one
                elif r < 15:
                    run = (1 << r) + (bits.take(r) if r else 0)
                    break
                while k <= hi:
                    if row[k]:
                        correct(row, k)
                    elif r:
                        r -= 1
                    else:
                        if value:
                            row[k] = value
                        k += 1
                        break
                    k += 1
        if run:
            while k <= hi:
                if row[k]:
                    correct(row, k)
                k += 1
            run -= 1


@lru_cache(64)
def extended(size: int, al: int) -> np.ndarray:
    """The coefficient for each pattern of magnitude bits."""
    v = np.arange(1 << size)
    return ((v - (v < 1 << (size - 1)) * ((1 << size) - 1)) << al).astype(np.int16)


def read_whole(plane: np.ndarray, blocks: np.ndarray, raw: bytes, table: dict, lo: int, hi: int, ah: int, al: int) -> bool:
    """Read a scan whose layout is fixed by its tables as one array of bits; False if it isn't such a scan."""
    n, width = len(blocks), hi - lo + 1
    whole = n == len(plane)
    if lo == 0:
        low = np.unpackbits(np.frombuffer(raw, np.uint8), count=n)
        plane[slice(None) if whole else blocks, 0] |= low.astype(np.int16) << al
        return True
    if lo and not ah and whole and (s := table.single) and s < 16:
        if s == 7:  # code and bits fill a byte
            v = np.frombuffer(raw, np.uint8, n * width) & 127
        else:
            field = np.unpackbits(np.frombuffer(raw, np.uint8), count=n * width * (s + 1)).reshape(-1, s + 1)[:, 1:]
            v = np.packbits(field, axis=1).astype(np.int32)
            v = (v[:, 0] if s <= 8 else v[:, 0] << 8 | v[:, 1]) >> (-s % 8)
        plane[:, lo : hi + 1] = extended(s, al)[v].reshape(n, width)
        return True
    if lo and ah and whole and table.refines and plane[:, lo : hi + 1].all():
        got = np.unpackbits(np.frombuffer(raw, np.uint8))
        low, at, b = np.empty((n, width), np.int16), 0, 0
        while b < n:
            if not got[at] and not got[at + 1]:
                k = (1 << 14) + int(got[at + 2 : at + 16] @ (1 << np.arange(13, -1, -1)))
                low[b : b + k] = got[at + 16 : at + 16 + k * width].reshape(k, width)
                at, b = at + 16 + k * width, b + k
            else:  # from here on one block at a time, if all the rest is so
                rest = got[at : at + (n - b) * (width + 2)].reshape(n - b, width + 2)
                if rest[:, 0].any() or not rest[:, 1].all():
                    return False
                low[b:], b = rest[:, 2:], n
        ac = plane[:, lo : hi + 1]
        ac += np.where(ac > 0, low, -low) << al
        return True
    return False


def decode_coefficients(jpeg: bytes) -> dict:
    """Coefficient planes (blocks x 64, zigzag order) and what else the frame says, from all scans of a progressive JPEG."""
    at, out, tables, quant, restart = 2, {"comment": b""}, {}, {}, 0
    if jpeg[:2] != b"\xff\xd8":
        raise ValueError("not a JPEG file")
    while at < len(jpeg):
        marker = jpeg[at + 1]
        if marker == 0xD9:
            break
        size = struct.unpack_from(">H", jpeg, at + 2)[0]
        body, at = jpeg[at + 4 : at + 2 + size], at + 2 + size
        if marker == 0xFE:
            out["comment"] = body
        elif marker == 0xDB:
            while body:
                wide = body[0] >> 4
                quant[body[0] & 15] = np.frombuffer(body[1 : 65 + 64 * wide], ">u2" if wide else np.uint8).astype(np.float32)
                body = body[65 + 64 * wide :]
        elif marker == 0xDD:
            restart = struct.unpack(">H", body)[0]
        elif marker == 0xC4:
            tables.update(parsed_tables(body))
        elif marker == 0xC2:
            _, height, width, n = struct.unpack_from(">BHHB", body)
            parts = [(body[6 + 3 * i], body[7 + 3 * i] >> 4, body[7 + 3 * i] & 15, body[8 + 3 * i]) for i in range(n)]
            hmax, vmax = max(p[1] for p in parts), max(p[2] for p in parts)
            mw, mh = -(-width // (8 * hmax)), -(-height // (8 * vmax))
            out |= {"height": height, "width": width, "parts": parts, "hmax": hmax, "vmax": vmax, "mw": mw, "mh": mh}
            out["planes"] = [np.zeros((mw * h * mh * v, 64), np.int16) for _, h, v, _ in parts]
        elif 0xC0 <= marker <= 0xCF and marker not in (0xC8, 0xCC):
            raise ValueError("not a progressive Huffman-coded JPEG")
        elif marker == 0xDA:
            end = at
            while True:
                end = jpeg.index(b"\xff", end)
                if jpeg[end + 1] == 0 or 0xD0 <= jpeg[end + 1] <= 0xD7:
                    end += 2
                else:
                    break
            one_scan(out, body, jpeg[at:end], tables, restart)
            at = end
    out["quant"] = [quant[q] for *_, q in out["parts"]]
    return out


def one_scan(frame: dict, head: bytes, raw: bytes, tables: dict, restart: int) -> None:
    """Add one scan to the coefficient planes."""
    n = head[0]
    names = [p[0] for p in frame["parts"]]
    chosen = [(names.index(head[1 + 2 * i]), head[2 + 2 * i] >> 4, head[2 + 2 * i] & 15) for i in range(n)]
    lo, hi, ah, al = head[1 + 2 * n], head[2 + 2 * n], head[3 + 2 * n] >> 4, head[3 + 2 * n] & 15
    pieces = re.split(rb"\xff[\xd0-\xd7]", raw) if restart else [raw]
    pieces = [p.replace(b"\xff\x00", b"\xff") for p in pieces]
    mw, mh = frame["mw"], frame["mh"]
    if n == 1:
        c, _, h, v, = (chosen[0][0], *frame["parts"][chosen[0][0]][:3])
        across = -(-(-(-frame["width"] * h // frame["hmax"])) // 8)
        down = -(-(-(-frame["height"] * v // frame["vmax"])) // 8)
        blocks = np.arange(down * across) if across == mw * h else (np.arange(down)[:, None] * (mw * h) + np.arange(across)[None, :]).reshape(-1)
        units, step = blocks, restart or len(blocks)
        groups = [units[i : i + step] for i in range(0, len(units), step)]
        plane = frame["planes"][c]
        for part, group in zip(pieces, groups, strict=False):
            table = tables.get((1, chosen[0][2])) if lo else tables.get((0, chosen[0][1]))
            if not (lo == 0 and not ah) and len(pieces) == 1 and read_whole(plane, group, part, table, lo, hi, ah, al):
                continue
            bits = Bits(part)
            if lo == 0 and ah:
                for b in group:
                    plane[b, 0] |= bits.take(1) << al
            elif lo == 0:
                dc_first([(0, b) for b in group.tolist()], [plane], bits, [table], al)
            elif not ah:
                ac_first(plane, group, bits, table, lo, hi, al)
            else:
                ac_refine(plane, group, bits, table, lo, hi, al)
        return
    order = []
    for m in range(mw * mh):
        y, x = divmod(m, mw)
        for i, (c, _, _) in enumerate(chosen):
            _, h, v, _ = frame["parts"][c]
            order += [[(i, (y * v + j) * mw * h + x * h + k) for j in range(v) for k in range(h)]]
    per = len(chosen)
    step = (restart or mw * mh) * per
    planes = [frame["planes"][c] for c, *_ in chosen]
    for part, i in zip(pieces, range(0, len(order), step), strict=False):
        units = [u for unit in order[i : i + step] for u in unit]
        bits = Bits(part)
        if not ah:
            dc_first(units, planes, bits, [tables[0, d] for _, d, _ in chosen], al)
        else:
            for c, b in units:
                planes[c][b, 0] |= bits.take(1) << al


def to_rgb(frame: dict) -> np.ndarray:
    """The full-resolution tensor (height, width, 3), uint8: transform inverted, chroma upsampled."""
    full = []
    for (_, h, v, _), coef, q in zip(frame["parts"], frame["planes"], frame["quant"], strict=True):
        pixels = (coef * q).astype(np.float32) @ INVERSE + 128
        across, down = frame["mw"] * h, frame["mh"] * v
        image = pixels.reshape(down, across, 8, 8).transpose(0, 2, 1, 3).reshape(down * 8, across * 8)
        np.clip(np.rint(image, out=image), 0, 255, out=image)
        up_y, up_x = frame["vmax"] // v, frame["hmax"] // h
        full.append(image if up_y == up_x == 1 else np.repeat(np.repeat(image, up_y, 0), up_x, 1))
    if len(full) == 1:
        rgb = np.repeat(full[0][..., None], 3, 2)
    else:
        rgb = np.stack(full, -1).reshape(-1, 3) @ COLOUR + OFFSET
        np.clip(rgb, 0, 255, out=rgb)
        rgb = np.rint(rgb, out=rgb).reshape(*full[0].shape, 3)
    return rgb.astype(np.uint8)[: frame["height"], : frame["width"]]


def payload_of(frame: dict) -> bytes:
    """The bytes that `encode` was given, from the coefficients of its image."""
    high, wide = frame["mh"], frame["mw"]
    luma, cb, cr = frame["planes"]
    value = np.empty((high, wide, 6, 64), np.int16)
    value[:, :, :4] = luma.reshape(high, 2, wide, 2, 64).transpose(0, 2, 1, 3, 4).reshape(high, wide, 4, 64)
    value[:, :, 4], value[:, :, 5] = cb.reshape(high, wide, 64), cr.reshape(high, wide, 64)
    value = (value + (value < 0) * np.int16(255)).astype(np.uint8).reshape(-1)
    return value[: int(frame["comment"].split(b"=")[1])].tobytes()


def padded(text: str | None) -> tuple[int, bytes]:
    raw = (text or "").encode()
    return len(raw), raw.ljust(max(UNIT, -(-len(raw) // UNIT) * UNIT), b" ")


def groups(sizes: list[int], most: int, rows: int) -> Iterator[tuple[int, int]]:
    """Start and length of runs of at most so many rows and bytes, one row at least."""
    start, held = 0, 0
    for i, n in enumerate(sizes):
        if i > start and (held + n > most or i - start == rows):
            yield start, i - start
            start, held = i, 0
        held += n
    if sizes:
        yield start, len(sizes) - start


def store(docs: DataFrame, ident: str = "doc_id", text: str = "text") -> DataFrame:
    """Per document: id, n_bytes and its media column, the JPEG file."""

    def work(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            for at, n in groups(pc.fill_null(pc.binary_length(batch.column(1)), 0).to_pylist(), 1 << 20, 200):
                part = batch.slice(at, n)
                rows = [padded(t) for t in part.column(1).to_pylist()]
                yield pa.record_batch([part.column(0), pa.array([n for n, _ in rows], pa.int64()), pa.array(encode_batch([p for _, p in rows]), pa.binary())], names=[ident, "n_bytes", "media"])

    return docs.select(F.col(ident), F.col(text)).mapInArrow(work, f"{ident} {docs.schema[ident].dataType.simpleString()}, n_bytes long, media binary")


def tensors(stored: DataFrame, ident: str = "doc_id") -> DataFrame:
    """Per document: id, n_bytes, media; height, width and rgb, the full-resolution tensor (rows, columns, 3) as bytes;
    and the payload read back from the coefficients."""

    def work(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            for at, n in groups(pc.binary_length(batch.column(2)).to_pylist(), 1 << 20, 100):
                part, out = batch.slice(at, n), []
                for jpeg in part.column(2):
                    frame = decode_coefficients(jpeg.as_py())
                    out.append((frame["height"], frame["width"], to_rgb(frame).tobytes(), payload_of(frame)))
                cols = list(zip(*out, strict=True))
                yield pa.record_batch([*part.columns, *(pa.array(c, k) for c, k in zip(cols, (pa.int32(), pa.int32(), pa.binary(), pa.binary()), strict=True))], names=[*part.schema.names, "height", "width", "rgb", "payload"])

    return stored.mapInArrow(work, f"{ident} {stored.schema[ident].dataType.simpleString()}, n_bytes long, media binary, height int, width int, rgb binary, payload binary")


def features(decoded: DataFrame, ident: str = "doc_id") -> DataFrame:
    """Per document: digests of the media and of the payload read back from it, and features of its RGB tensor."""

    def row(jpeg: bytes, height: int, width: int, rgb: bytes, payload: bytes) -> tuple:
        flat = np.frombuffer(rgb, np.uint8).reshape(-1, 3)
        mean = flat.mean(0, dtype=np.float64)
        text = f"{width}x{height};mean={mean[0]:.3f},{mean[1]:.3f},{mean[2]:.3f};max={int(flat.max())}"
        return len(payload), hashlib.sha256(payload).hexdigest(), zlib.crc32(payload[-16:]), len(jpeg), hashlib.sha256(jpeg).hexdigest(), text

    def work(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        kinds = [pa.int64(), pa.string(), pa.int64(), pa.int64(), pa.string(), pa.string()]
        for batch in batches:
            cols = list(zip(*(row(*(v.as_py() for v in values)) for values in zip(*batch.columns[2:], strict=True)), strict=True)) or [[]] * 6
            yield pa.record_batch([batch.column(0), batch.column(1), *(pa.array(c, k) for c, k in zip(cols, kinds, strict=True))], names=names)

    names = [ident, "n_bytes", "payload_bytes", "payload_sha256", "tail_crc32", "media_bytes", "media_sha256", "feature"]
    return decoded.mapInArrow(work, f"{ident} {decoded.schema[ident].dataType.simpleString()}, n_bytes long, payload_bytes long, payload_sha256 string, tail_crc32 long, media_bytes long, media_sha256 string, feature string")
