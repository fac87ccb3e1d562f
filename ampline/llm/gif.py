"""GIF media columns: frames, palettes, LZW code streams, disposal and transparency, colour histograms.

Code streams have a dictionary that grows to 4,096 entries and starts anew when it is full. How many bits a code has
follows from its place behind the last clear code, so that codes are packed and unpacked by array arithmetic; only the
dictionary itself is kept code by code.
"""

from __future__ import annotations

import struct
from dataclasses import dataclass, field
from functools import lru_cache

import numpy as np
import pandas as pd
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

WIDTH = 192
#: Rows of a payload frame; the format allows 65,535.
FRAME_ROWS = 65_535
BINS = 8
#: Codes that are unpacked at a time.
BLOCK = 8192


@dataclass
class Frame:
    indices: np.ndarray  # (height, width) uint8
    palette: np.ndarray  # (n, 3) uint8
    left: int = 0
    top: int = 0
    delay_cs: int = 0
    disposal: int = 0
    transparent: int | None = None
    image: np.ndarray | None = field(default=None, repr=False)  # composited canvas (h, w, 4)


def payload_palette() -> np.ndarray:
    """256 distinct colours: 3 bits of red and green, 2 of blue."""
    i = np.arange(256)
    return np.stack([(i >> 5) * 255 // 7, (i >> 2 & 7) * 255 // 7, (i & 3) * 255 // 3], 1).astype(np.uint8)


@lru_cache(maxsize=16)
def code_widths(bits: int) -> np.ndarray:
    """Bits of the codes behind a clear code; all further ones have 12."""
    known = np.arange(4096 + BLOCK) + (1 << bits) + 2
    return np.minimum(12, np.maximum(bits + 1, np.ceil(np.log2(known)).astype(np.int64)))


def pack(codes: np.ndarray, widths: np.ndarray, block: int = 1 << 17) -> bytes:
    """Codes one behind the other, lowest bit first."""
    out, rest = [], np.empty(0, np.uint8)
    at = np.arange(12, dtype=np.int16)
    codes, widths = codes.astype(np.int16), widths.astype(np.int16)
    for i in range(0, len(codes), block):
        c, w = codes[i : i + block, None], widths[i : i + block, None]
        flat = np.concatenate([rest, (c >> at & 1)[at < w].astype(np.uint8)])
        whole = len(flat) if i + block >= len(codes) else len(flat) & ~7
        out.append(np.packbits(flat[:whole], bitorder="little").tobytes())
        rest = flat[whole:]
    return b"".join(out)


def lzw_encode(pixels: np.ndarray, bits: int = 8) -> bytes:
    """LZW code stream with a growing dictionary."""
    clear = 1 << bits
    room = 4095 - clear - 2  # entries after which the dictionary is cleared
    parts: list[np.ndarray] = [np.array([clear], np.int64)]
    widths: list[np.ndarray] = [np.array([bits + 1], np.int64)]
    data, schedule = pixels.tobytes(), code_widths(bits)
    table: dict[int, int] = {}
    codes: list[int] = []
    place, put = table.setdefault, codes.append
    nxt = clear + 2
    prefix = data[0] if data else -1
    for p in data[1:]:
        code = place(prefix << 8 | p, nxt)
        if code != nxt:
            prefix = code
            continue
        put(prefix)
        nxt += 1
        prefix = p
        if nxt == 4095:
            parts += [np.array(codes, np.int64), np.array([clear], np.int64)]
            widths += [schedule[:room], np.array([12], np.int64)]
            table.clear()
            codes.clear()
            nxt = clear + 2
    if prefix >= 0:
        put(prefix)
    put(clear + 1)
    parts.append(np.array(codes, np.int64))
    widths.append(schedule[: len(codes)])
    return pack(np.concatenate(parts), np.concatenate(widths))


def lzw_decode(data: np.ndarray, bits: int, n: int) -> np.ndarray:
    """At most n pixels of a code stream; a stream that ends early leaves fewer."""
    clear, stop = 1 << bits, (1 << bits) + 1
    padded = np.concatenate([data, np.zeros(3, np.uint8)]).astype(np.int32)
    schedule = code_widths(bits)
    base = [bytes([i]) for i in range(clear)] + [b"", b""]
    table: list[bytes] = base[:]
    out: list[bytes] = []
    pieces: list[bytes] = []
    put, size = out.append, 0
    at, since, prev = 0, 0, None  # bits read, codes since the last clear code, last entry
    total = len(data) * 8
    while size < n:
        first = min(since, 4096)
        width = schedule[first : first + min(BLOCK, (total - at) // (bits + 1) + 1)]
        starts = at + np.concatenate([[0], np.cumsum(width)])
        whole = int(np.searchsorted(starts[1:], total, "right"))
        if not whole:
            break
        starts, width = starts[:whole], width[:whole]
        byte = starts >> 3
        codes = (padded[byte] | padded[byte + 1] << 8 | padded[byte + 2] << 16) >> (starts & 7) & (1 << width) - 1
        marks = np.flatnonzero((codes == clear) | (codes == stop))
        end = int(marks[0]) if len(marks) else whole
        todo = codes[:end].tolist()
        if todo and prev is None:
            if todo[0] >= clear:
                raise ValueError("the code stream starts with an undefined code")
            prev = table[todo[0]]
            put(prev)
            del todo[0]
        room, grow = 4096 - len(table), table.append
        for code in todo[:room]:
            try:
                entry = table[code]
            except IndexError:
                if code != len(table):
                    raise ValueError("the code stream uses an undefined code") from None
                entry = prev + prev[:1]
            grow(prev + entry[:1])
            put(entry)
            prev = entry
        for code in todo[room:]:
            prev = table[code]
            put(prev)
        pieces.append(b"".join(out))
        size += len(pieces[-1])
        out.clear()
        since += end
        at = int(starts[end - 1] + width[end - 1]) if end else at
        if len(marks):
            at += int(width[end])
            if codes[end] == stop:
                break
            table, since, prev = base[:], 0, None
    return np.frombuffer(b"".join(pieces)[:n], np.uint8)


def to_blocks(data: bytes) -> bytes:
    """Sub-blocks of at most 255 bytes, ended by an empty one."""
    full, rest = divmod(len(data), 255)
    a = np.empty((full, 256), np.uint8)
    a[:, 0] = 255
    a[:, 1:] = np.frombuffer(data, np.uint8, full * 255).reshape(full, 255)
    return a.tobytes() + (bytes([rest]) + data[full * 255 :] if rest else b"") + b"\0"


def from_blocks(data: bytes, at: int) -> tuple[np.ndarray, int]:
    """Data of the sub-blocks from at on, and where they end."""
    a = np.frombuffer(data, np.uint8, offset=at)
    heads = a[::256]
    full = int(np.argmax(heads != 255)) if (heads != 255).any() else len(heads)
    full = min(full, len(a) // 256)
    parts = [a[: full * 256].reshape(full, 256)[:, 1:].ravel()]
    p = full * 256
    while p < len(a) and a[p]:
        parts.append(a[p + 1 : p + 1 + int(a[p])])
        p += 1 + int(a[p])
    return np.concatenate(parts), at + p + 1


def encode(frames: list[Frame], width: int, height: int) -> bytes:
    """A GIF89a file; each frame has its own palette, delay, disposal and transparency."""
    out = [b"GIF89a", struct.pack("<HHBBB", width, height, 0x70, 0, 0)]
    for f in frames:
        h, w = f.indices.shape
        bits = max(1, (len(f.palette) - 1).bit_length())
        table = np.zeros((1 << bits, 3), np.uint8)
        table[: len(f.palette)] = f.palette
        out.append(b"\x21\xf9\x04" + struct.pack("<BHBB", f.disposal << 2 | (f.transparent is not None), f.delay_cs, f.transparent or 0, 0))
        out.append(b"\x2c" + struct.pack("<HHHHB", f.left, f.top, w, h, 0x80 | bits - 1) + table.tobytes())
        flat = np.ascontiguousarray(f.indices).ravel()
        out.append(bytes([max(2, bits)]) + to_blocks(lzw_encode(flat, max(2, bits))))
    return b"".join([*out, b"\x3b"])


def decode(data: bytes, composite: bool = True) -> tuple[int, int, list[Frame]]:
    """Width, height and frames of a GIF. With composite, each frame's image is the canvas it shows (RGBA)."""
    if data[:6] not in (b"GIF87a", b"GIF89a"):
        raise ValueError("not a GIF")
    width, height, flags = struct.unpack_from("<HHB", data, 6)
    at, shared = 13, None
    if flags & 0x80:
        n = 2 << (flags & 7)
        shared, at = np.frombuffer(data, np.uint8, n * 3, at).reshape(n, 3), at + n * 3
    frames: list[Frame] = []
    control: tuple[int, int, int | None] = (0, 0, None)
    canvas = np.zeros((height, width, 4), np.uint8) if composite else None
    while at < len(data) and data[at] != 0x3B:
        kind = data[at]
        if kind == 0x21:
            if data[at + 1] == 0xF9:
                packed, delay, index = struct.unpack_from("<BHB", data, at + 3)
                control = (delay, packed >> 2 & 7, index if packed & 1 else None)
            _, at = from_blocks(data, at + 2)
            continue
        if kind != 0x2C:
            raise ValueError(f"unknown block {kind:#x}")
        left, top, w, h, packed = struct.unpack_from("<HHHHB", data, at + 1)
        at += 10
        palette = shared
        if packed & 0x80:
            n = 2 << (packed & 7)
            palette, at = np.frombuffer(data, np.uint8, n * 3, at).reshape(n, 3), at + n * 3
        if palette is None:
            raise ValueError("a frame has no palette")
        bits = data[at]
        stream, at = from_blocks(data, at + 1)
        pixels = lzw_decode(stream, bits, w * h)
        if len(pixels) < w * h:
            raise ValueError("a frame lacks pixels")
        pixels = pixels.reshape(h, w)
        if packed & 0x40:
            rows = np.concatenate([np.arange(s, h, d) for s, d in ((0, 8), (4, 8), (2, 4), (1, 2))])
            plain = np.empty_like(pixels)
            plain[rows] = pixels
            pixels = plain
        f = Frame(pixels, palette, left, top, *control)
        if composite:
            before = canvas
            full = np.concatenate([palette, np.full((len(palette), 1), 255, np.uint8)], 1)
            if f.transparent is None and (left, top, h, w) == (0, 0, height, width):
                canvas = full[np.minimum(pixels, len(palette) - 1)]
            else:
                canvas = canvas.copy()
                area = canvas[top : top + h, left : left + w]
                shown = pixels[: area.shape[0], : area.shape[1]]
                solid = np.ones(shown.shape, bool) if f.transparent is None else shown != f.transparent
                area[solid] = full[np.minimum(shown, len(palette) - 1)][solid]
            f.image = canvas  # later frames change copies of it
            if f.disposal == 2:
                canvas = canvas.copy()
                canvas[top : top + h, left : left + w] = 0
            elif f.disposal == 3:
                canvas = before
        frames.append(f)
        control = (0, 0, None)
    return width, height, frames


def histogram(frame: Frame, bins: int = BINS) -> np.ndarray:
    """Counts of each channel's levels in bins, (3, bins): of the composited image where there is one, else of the frame."""
    if frame.image is not None and (frame.transparent is not None or frame.left or frame.top or frame.image.shape[:2] != frame.indices.shape):
        seen = frame.image[frame.image[..., 3] > 0]
        return np.stack([np.bincount(seen[:, c].astype(np.intp) * bins >> 8, minlength=bins) for c in range(3)])
    counts = np.bincount(frame.indices.ravel(), minlength=256)[: len(frame.palette)].copy()
    if frame.transparent is not None and frame.transparent < len(counts):
        counts[frame.transparent] = 0
    return np.stack([np.bincount(frame.palette[:, c].astype(np.intp) * bins >> 8, counts, bins).astype(np.int64) for c in range(3)])


def store_payload(payload: bytes, delay_cs: int = 10) -> bytes:
    """A payload of whole rows of WIDTH bytes as one GIF, a frame for every FRAME_ROWS rows."""
    a = np.frombuffer(payload, np.uint8).reshape(-1, WIDTH)
    parts = [a[i : i + FRAME_ROWS] for i in range(0, len(a), FRAME_ROWS)]
    palette = payload_palette()
    return encode([Frame(p, palette, 0, 0, delay_cs, 1) for p in parts], WIDTH, len(parts[0]))


def padded(text: str | None, unit: int = WIDTH) -> tuple[int, bytes]:
    raw = (text or "").encode()
    return len(raw), raw + b" " * (-len(raw) % unit if raw else unit)


def store_texts(df: DataFrame, text_col: str = "text", out: str = "media") -> DataFrame:
    """Add a binary column with each whole text stored as a GIF of 8-bit indices (null: the empty text).

    A text of no bytes becomes one row of spaces. Equal texts give equal bytes. Replaces a column named out.
    """

    @F.pandas_udf("binary")
    def stored(texts: pd.Series) -> pd.Series:
        return pd.Series([store_payload(padded(t)[1]) for t in texts], dtype=object)

    return df.withColumn(out, stored(F.col(text_col)))


#: A frame as it is shown: place, delay and start in hundredths of a second, and the colour counts of the canvas then.
FRAMES = "array<struct<left:int,top:int,width:int,height:int,delay_cs:int,start_cs:int,disposal:int,transparent:int,histogram:array<bigint>>>"
READ_TYPE = f"struct<width:int,height:int,duration_cs:int,payload:binary,frames:{FRAMES},error:string>"
READ = ["width", "height", "duration_cs", "payload", "frames", "error"]


def media_row(blob: bytes | None) -> dict:
    """What READ_TYPE has, of GIF bytes; null bytes give nulls, bytes that can't be read the reason in error."""
    none = dict.fromkeys(READ)
    if blob is None:
        return none
    try:
        width, height, frames = decode(bytes(blob))
    except (ValueError, IndexError, struct.error) as e:
        return none | {"error": str(e) or "broken"}
    told, start = [], 0
    for f in frames:
        h, w = f.indices.shape
        told.append({"left": f.left, "top": f.top, "width": w, "height": h, "delay_cs": f.delay_cs, "start_cs": start, "disposal": f.disposal, "transparent": f.transparent, "histogram": histogram(f).ravel().tolist()})
        start += f.delay_cs
    return {"width": width, "height": height, "duration_cs": start, "payload": b"".join(f.indices.tobytes() for f in frames), "frames": told, "error": None}


def read_media(df: DataFrame, media_col: str = "media", out: str = "read") -> DataFrame:
    """Add a struct read from GIF bytes: size, total delay, the samples of all frames, and the frames with their times and
    the histograms of what they show after disposal and transparency (3 channels of BINS counts each).

    Null bytes give null. Bytes that are no GIF, or a broken one, give a struct with null fields and the reason in error.
    Repeated rows get equal results; a column named out is replaced.
    """

    @F.pandas_udf(READ_TYPE)
    def read(blobs: pd.Series) -> pd.DataFrame:
        return pd.DataFrame([media_row(b) for b in blobs], columns=READ, dtype=object)

    return df.withColumn(out, F.when(F.col(media_col).isNotNull(), read(F.col(media_col))))


MEDIA_TYPE = READ_TYPE.replace("struct<", "struct<media:binary,", 1)


def media_columns(df: DataFrame, text_col: str = "text") -> DataFrame:
    """Store each whole text as a GIF and read the stored bytes back: adds media (the file), payload (the samples read),
    frames (timed, with colour histograms) and duration_cs.

    The texts make one trip through a worker. Null counts as the empty text, which is one row of spaces; a text of more
    than FRAME_ROWS rows has several frames. Equal texts, repeated rows among them, give equal columns; columns so named
    are replaced, others stay.
    """

    @F.pandas_udf(MEDIA_TYPE)
    def both(texts: pd.Series) -> pd.DataFrame:
        rows = []
        for t in texts:
            media = store_payload(padded(t)[1])
            rows.append({"media": media} | media_row(media))
        return pd.DataFrame(rows, columns=["media", *READ], dtype=object)

    names = ["media", "payload", "frames", "duration_cs"]
    return df.withColumn("__media", both(F.col(text_col))).withColumns({n: F.col("__media")[n] for n in names}).drop("__media")
