"""Media columns: GIF files written from payloads, and read back into timed frames with colour histograms.

The reader decodes any GIF87a or GIF89a: LZW streams of every code size, with late or early clear codes, global and local
palettes, interlaced rows, frames smaller than the canvas, the four disposal methods and transparent indices.
"""

from __future__ import annotations

import hashlib
import zlib
from collections.abc import Iterator
from dataclasses import dataclass, field

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame

from .common import tidied


UNIT = 192
#: A stored frame is UNIT samples wide and has this many rows at most; it is shown so many hundredths of a second.
ROWS, DELAY = 64, 4
GREY = bytes(v for v in range(256) for _ in range(3))
_FULL = 4096
#: Bins of a channel in a frame's colour histogram.
BINS = 4


@dataclass
class Frame:
    """One frame as stored, and the canvas as shown: pixels (height, width, 3) and covered (height, width)."""

    indices: np.ndarray
    left: int
    top: int
    delay: int
    disposal: int
    transparent: int | None
    palette: np.ndarray
    pixels: np.ndarray | None = None
    covered: np.ndarray | None = None

    def histogram(self) -> np.ndarray:
        """Shares of shown pixels by colour, BINS bins a channel."""
        if self.pixels is None or not (n := int(self.covered.sum())):
            return np.zeros(BINS**3)
        q = (self.pixels[self.covered] // (256 // BINS)).astype(np.int32)
        return np.bincount((q[:, 0] * BINS + q[:, 1]) * BINS + q[:, 2], minlength=BINS**3) / n


@dataclass
class Gif:
    width: int
    height: int
    frames: list[Frame] = field(default_factory=list)


# ---- LZW


def _widths(bits: int, n: int) -> np.ndarray:
    """Bits of the codes 0 to n - 1 after a clear code: the table has grown by one for each code before."""
    last = np.minimum((1 << bits) + 1 + np.arange(n), _FULL - 1)
    return np.maximum(np.floor(np.log2(last)).astype(np.int64) + 1, bits + 1)


def lzw_encode(data: bytes, bits: int = 8) -> bytes:
    """An LZW code stream of samples of ``bits`` bits; the table is cleared when it is full."""
    clear, segments, codes = 1 << bits, [], []
    table: dict[int, int] = {}
    get, emit = table.get, codes.append
    fresh, p = clear + 2, -1
    for b in data:
        if p < 0:
            p = b
        elif (c := get(k := p << 8 | b)) is not None:
            p = c
        else:
            emit(p)
            if fresh < _FULL - 1:
                table[k] = fresh
                fresh += 1
            else:
                segments.append(codes)
                codes = []
                emit = codes.append
                table.clear()
                fresh = clear + 2
            p = b
    if p >= 0:
        codes.append(p)
    segments.append(codes)
    flat, wide = [np.array([clear])], [np.array([bits + 1])]
    for i, s in enumerate(segments):
        flat.append(np.array([*s, clear + (i + 1 == len(segments))]))
        wide.append(_widths(bits, len(s) + 1))
    code, width = np.concatenate(flat).astype("<u2"), np.concatenate(wide)
    each = np.unpackbits(code.view(np.uint8).reshape(-1, 2), axis=1, bitorder="little")
    return np.packbits(each[np.arange(16) < width[:, None]], bitorder="little").tobytes()


def lzw_decode(stream: bytes, bits: int, pixels: int) -> bytes:
    """The first ``pixels`` samples of a code stream; a stream that ends early is filled up with zeros."""
    clear = 1 << bits
    raw = np.frombuffer(stream + b"\0\0\0", np.uint8).astype(np.int64)
    start, end, out, had = 0, 8 * len(stream), [], 0
    first = [bytes([i]) for i in range(clear)] + [b"", b""]
    most = max(16, min(end // (bits + 1) + 1, 2 * _FULL))
    ends = np.cumsum(_widths(bits, most))
    while had < pixels and start + bits < end:
        width = np.diff(ends, prepend=0)
        at = start + ends - width
        ok = at + width <= end
        at, width = at[ok], width[ok]
        b = at >> 3
        codes = ((raw[b] | raw[b + 1] << 8 | raw[b + 2] << 16) >> (at & 7)) & ((1 << width) - 1)
        stops = np.nonzero((codes == clear) | (codes == clear + 1))[0]
        if not len(stops) and len(codes) == most and start + int(ends[-1]) < end:
            most *= 2  # a late clear code
            ends = np.cumsum(_widths(bits, most))
            continue
        n = int(stops[0]) if len(stops) else len(codes)
        table, parts, last = first.copy(), [], b""
        grow, keep = table.append, parts.append
        for c in codes[:n].tolist():
            if c < len(table):
                e = table[c]
                if last and len(table) < _FULL:
                    grow(last + e[:1])
            elif last and c == len(table):
                e = last + last[:1]
                grow(e)
            else:
                n, stops = 0, []  # not a code: the rest is lost
                break
            keep(e)
            last = e
        out += parts
        had += sum(map(len, parts))
        if not len(stops) or codes[n] == clear + 1:
            break
        start += int(ends[n])
    return b"".join(out)[:pixels].ljust(pixels, b"\0")


# ---- files


def write_gif(frames: list[np.ndarray], palette: bytes = GREY, delay: int = DELAY, disposal: int = 1, transparent: int | None = None, size: tuple[int, int] | None = None) -> bytes:
    """A GIF89a of uint8 index arrays (rows, columns), all at the canvas's corner."""
    height, width = size or (max(f.shape[0] for f in frames), max(f.shape[1] for f in frames))
    u2 = lambda v: int(v).to_bytes(2, "little")
    out = [b"GIF89a", u2(width), u2(height), b"\xf7\0\0", palette]
    for f in frames:
        flags = disposal << 2 | (transparent is not None)
        out += [b"\x21\xf9\x04", bytes([flags]), u2(delay), bytes([transparent or 0, 0])]
        out += [b"\x2c\0\0\0\0", u2(f.shape[1]), u2(f.shape[0]), b"\0\x08"]
        s = lzw_encode(f.tobytes())
        out += [x for i in range(0, len(s), 255) for x in (bytes([len(s[i : i + 255])]), s[i : i + 255])]
        out.append(b"\0")
    return b"".join([*out, b"\x3b"])


def _blocks(data: bytes, at: int) -> tuple[bytes, int]:
    out = []
    while at < len(data) and (n := data[at]):
        out.append(data[at + 1 : at + 1 + n])
        at += n + 1
    return b"".join(out), at + 1


def _palette(data: bytes, at: int, flags: int) -> tuple[np.ndarray, int]:
    n = 3 * (2 << (flags & 7))
    return np.frombuffer(data[at : at + n].ljust(n, b"\0"), np.uint8).reshape(-1, 3), at + n


def read_gif(data: bytes) -> Gif:
    """All whole frames of a GIF, shown on the canvas one after the other; a file that ends early gives those before."""
    if data[:6] not in (b"GIF87a", b"GIF89a") or len(data) < 13:
        raise ValueError("not a GIF")
    u2 = lambda i: int.from_bytes(data[i : i + 2], "little")
    gif, at, flags = Gif(u2(6), u2(8)), 13, data[10]
    general = np.zeros((1, 3), np.uint8)
    if flags & 0x80:
        general, at = _palette(data, at, flags)
    delay, disposal, transparent = 0, 0, None
    while at < len(data) and data[at] != 0x3B:
        if data[at] == 0x21:
            body, end = _blocks(data, at + 2)
            if data[at + 1] == 0xF9 and len(body) >= 4:
                delay, disposal, transparent = int.from_bytes(body[1:3], "little"), body[0] >> 2 & 7, body[3] if body[0] & 1 else None
            at = end
        elif data[at] == 0x2C and at + 10 < len(data):
            left, top, w, h, flags = u2(at + 1), u2(at + 3), u2(at + 5), u2(at + 7), data[at + 9]
            at, palette = at + 10, general
            if flags & 0x80:
                palette, at = _palette(data, at, flags)
            bits = data[at] if at < len(data) else 0
            stream, at = _blocks(data, at + 1)
            if not 1 <= bits <= 11:
                break
            rows = np.frombuffer(lzw_decode(stream, bits, w * h), np.uint8).reshape(h, w)
            if flags & 0x40:
                order = [y for first, step in ((0, 8), (4, 8), (2, 4), (1, 2)) for y in range(first, h, step)]
                whole = np.empty_like(rows)
                whole[order] = rows
                rows = whole
            gif.frames.append(Frame(rows, left, top, delay, disposal, transparent, palette))
            delay, disposal, transparent = 0, 0, None
        else:
            break
    _show(gif)
    return gif


def _show(gif: Gif) -> None:
    """Draw each frame over what the one before left, by its disposal method: 2 clears its place, 3 restores it."""
    canvas, covered = np.zeros((gif.height, gif.width, 3), np.uint8), np.zeros((gif.height, gif.width), bool)
    for f in gif.frames:
        saved = (canvas.copy(), covered.copy()) if f.disposal == 3 else None
        place = np.s_[f.top : f.top + f.indices.shape[0], f.left : f.left + f.indices.shape[1]]
        h, w = covered[place].shape
        own = f.indices[:h, :w]
        colours = f.palette[np.minimum(own, len(f.palette) - 1)]
        if f.transparent is None:
            canvas[place], covered[place] = colours, True
        else:
            drawn = own != f.transparent
            canvas[place][drawn], covered[place] = colours[drawn], covered[place] | drawn
        f.pixels, f.covered = canvas.copy(), covered.copy()
        if f.disposal == 2:
            canvas[place], covered[place] = 0, False
        elif saved:
            canvas, covered = saved


# ---- columns


def payload_of(text: str | None) -> tuple[int, bytes]:
    raw = (text or "").encode("utf-8", "replace")
    return len(raw), raw + b" " * (max(1, -(-len(raw) // UNIT)) * UNIT - len(raw))


def store(payload: bytes) -> bytes:
    """The payload as frames of grey samples, UNIT to a row."""
    rows = np.frombuffer(payload, np.uint8).reshape(-1, UNIT)
    return write_gif([rows[i : i + ROWS] for i in range(0, len(rows), ROWS)])


def read_back(media: bytes) -> tuple[bytes, Gif]:
    """The payload, from what the stored frames show: a grey's level is its sample."""
    gif = read_gif(media)
    return b"".join(f.pixels[: f.indices.shape[0], :, 0].tobytes() for f in gif.frames), gif


def feature(gif: Gif) -> str:
    """Canvas, frames and time, then the mean colour histogram of the frames' grey levels, in thousandths."""
    hist = np.mean([np.bincount(f.pixels[: f.indices.shape[0], :, 0].ravel() >> 4, minlength=16) / f.indices.size for f in gif.frames], axis=0)
    told = ".".join(str(round(1000 * x)) for x in hist.tolist())
    return f"{gif.width}x{gif.height}:{len(gif.frames)}:{10 * sum(f.delay for f in gif.frames)}ms:{told}"


MEDIA = "doc_id long, n_bytes long, payload_bytes long, payload_sha256 string, tail_crc32 long, media_bytes long, media_sha256 string, feature string"
FRAMES = "id long, frame int, at_ms long, delay_ms long, width int, height int, histogram array<double>"


def _columns(schema: str, rows: list[tuple]) -> pa.RecordBatch:
    kinds = {"long": pa.int64(), "int": pa.int32(), "string": pa.string(), "array<double>": pa.list_(pa.float64())}
    fields = [x.split(" ") for x in schema.split(", ")]
    cols = list(zip(*rows, strict=True)) if rows else [()] * len(fields)
    return pa.RecordBatch.from_arrays([pa.array(list(c), kinds[k]) for c, (_, k) in zip(cols, fields, strict=True)], [n for n, _ in fields])


def text_media(docs: DataFrame) -> DataFrame:
    """MEDIA of each row of ``docs(doc_id, text)``: its text stored as a GIF, read back and described.

    Null texts are empty, a payload of one unit of blanks. Rows with a null doc_id keep it; repeated rows each get a row
    with equal values; other columns are not read; an empty table gives no rows. Every text is stored whole.
    """

    @tidied
    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            seen: dict = {}
            rows = []
            for doc, text in zip(batch.column(0).to_pylist(), batch.column(1).to_pylist(), strict=True):
                if (got := seen.get(text or "")) is None:
                    n, payload = payload_of(text)
                    media = store(payload)
                    back, gif = read_back(media)
                    got = (n, len(back), hashlib.sha256(back).hexdigest(), zlib.crc32(back[-16:]), len(media), hashlib.sha256(media).hexdigest(), feature(gif))
                    seen[text or ""] = got
                rows.append((doc, *got))
            yield _columns(MEDIA, rows)

    return docs.selectExpr("cast(doc_id as long)", "text").mapInArrow(run, MEDIA)


def gif_frames(media: DataFrame, id_column: str, column: str) -> DataFrame:
    """FRAMES of each GIF in a binary column: when each is shown and for how long, its canvas and colour histogram.

    Nulls and values that aren't GIFs give no rows.
    """

    @tidied
    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            rows = []
            for i, data in zip(batch.column(0).to_pylist(), batch.column(1).to_pylist(), strict=True):
                try:
                    gif = read_gif(data or b"")
                except ValueError:
                    continue
                at = 0
                for k, f in enumerate(gif.frames):
                    rows.append((i, k, at, 10 * f.delay, gif.width, gif.height, f.histogram().tolist()))
                    at += 10 * f.delay
            yield _columns(FRAMES, rows)

    return media.select(media[id_column].cast("long"), media[column].cast("binary")).mapInArrow(run, FRAMES)
