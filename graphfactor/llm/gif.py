"""GIF media columns: reading, and storing bytes as pictures.

Reading follows GIF89a: LZW code streams, local and global palettes, interlace, disposal, transparency, delays. The
code stream is decoded on arrays. The width of a code depends only on how many codes came since the last clear code,
so all codes up to the next clear code are cut out at once; a table entry is the text of an earlier code and one more
byte, which stand side by side in the output, so every output byte is a copy of an earlier one, and following these
links by doubling resolves them all.

Storing uses what reading follows: bytes are grey pixels of frames that each replace the one before, in code streams
with table codes. A zero byte is a transparent pixel over the cleared canvas, and every other frame has a palette of
its own, from white to black.
"""

from __future__ import annotations

import struct
from collections.abc import Iterator
from functools import lru_cache
from typing import NamedTuple

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import types as T

from .scratch import in_batches
from .text import slices

#: Columns of stored pictures, and rows of a frame at most.
WIDTH, FRAME_ROWS = 64, 1024
#: Pixels of a canvas beyond which a picture is not decoded, but an error: a few bytes can claim any size.
MAX_PIXELS = 1 << 26
_FULL = 1 << 12


@lru_cache(maxsize=32)
def _layout(least: int, n: int) -> tuple[np.ndarray, np.ndarray]:
    """Bit widths of the first n codes after a clear code, and the bits before each."""
    free = np.minimum((1 << least) + 2 + np.maximum(np.arange(n) - 1, 0), _FULL - 1)
    widths = np.frexp(free.astype(float))[1].astype(np.int64)
    return widths, np.cumsum(widths) - widths


def _segment(codes: np.ndarray, least: int, wanted: int) -> np.ndarray:
    """The bytes of codes that follow a clear code, as far as they are wanted (some more may come)."""
    first_entry = (1 << least) + 2
    table = codes >= first_entry
    if not table.any():
        return codes.astype(np.uint8)
    at = np.arange(len(codes))
    parent = np.where(table, codes - first_entry, at)
    if (parent[table] >= at[table]).any():
        raise ValueError("a code stands before its table entry")
    # an entry is one byte longer than the code that it began with
    longer, link = table.astype(np.int64), parent
    while table[link].any():
        longer = longer + longer[link]
        link = link[link]
    size = longer + 1
    taken = int(np.searchsorted(np.cumsum(size), wanted)) + 1
    codes, table, parent, at, size = codes[:taken], table[:taken], parent[:taken], at[:taken], size[:taken]
    start = np.cumsum(size) - size
    code = np.repeat(at, size)
    place = np.arange(len(code))
    source = np.where(table[code], start[parent[code]] + place - start[code], place)
    while not np.array_equal(further := source[source], source):
        source = further
    return codes[code[source]].astype(np.uint8)


def unpack(data: bytes, least: int, wanted: int) -> np.ndarray:
    """Decode an LZW code stream to ``wanted`` bytes, or fewer where it ends early."""
    if not 2 <= least <= 8:
        raise ValueError(f"code size {least}")
    bits = np.frombuffer(data + b"\0\0\0", np.uint8)
    total, clear, out, have, at = 8 * len(data), 1 << least, [], 0, 0
    while have < wanted and at < total:
        n = _FULL + 64
        while True:
            n = min(n, (total - at) // (least + 1))
            widths, before = _layout(least, 1 << max(12, int(n).bit_length()))
            n = min(n, int(np.searchsorted(before + widths, total - at, "right")))
            offset = before[:n] + at
            byte = offset >> 3
            codes = bits[byte].astype(np.int32)
            codes |= bits[byte + 1].astype(np.int32) << 8
            codes |= bits[byte + 2].astype(np.int32) << 16
            codes = (codes >> (offset & 7).astype(np.int32)) & ((1 << widths[:n].astype(np.int32)) - 1)
            special = (codes == clear) | (codes == clear + 1)
            stop = int(np.argmax(special)) if special.any() else -1
            if stop >= 0 or n < _FULL or int(before[n - 1] + widths[n - 1]) + at + 12 > total:
                break
            n *= 8
        got = _segment(codes[: stop if stop >= 0 else n], least, wanted - have)
        out.append(got)
        have += len(got)
        if stop < 0 or codes[stop] == clear + 1:
            break
        at += int(before[stop] + widths[stop])
    return np.concatenate([*out, np.empty(0, np.uint8)])[:wanted]


def _coded(data: bytes) -> list[int]:
    """Greedy LZW of 8-bit samples: a clear code first and whenever the table is full, the end code last."""
    out, after, free = [256], [None] * _FULL, 258  # after[code]: the code of its text and one more sample, by sample
    emit, rest = out.append, iter(data)
    code = next(rest, None)
    if code is None:
        return [256, 257]
    longer = after[code]
    for sample in rest:
        if longer is not None and sample in longer:
            code = longer[sample]
            longer = after[code]
            continue
        emit(code)
        if free == _FULL:
            emit(256)
            after, free = [None] * _FULL, 258
        else:
            if longer is None:
                after[code] = {sample: free}
            else:
                longer[sample] = free
            free += 1
        code = sample
        longer = after[code]
    emit(code)
    emit(257)
    return out


def pack(data: bytes) -> bytes:
    """A code stream of 8-bit samples."""
    codes = np.array(_coded(data), np.int64)
    clear = np.flatnonzero(codes == 256)
    # how many codes came since the last clear code; a clear code itself is as wide as the next code would be
    nth = np.arange(len(codes)) - np.repeat(clear, np.diff(clear, append=len(codes))) - 1
    nth[clear[1:]] = nth[clear[1:] - 1] + 1
    nth[0] = 0
    widths = _layout(8, 1 << 13)[0][nth]
    offset = np.cumsum(widths) - widths
    byte, bits = offset >> 3, codes << (offset & 7)
    n = int(offset[-1] + widths[-1] + 7) >> 3
    out = sum(np.bincount(byte + i, bits >> (8 * i) & 255, n + 3) for i in range(3))
    return out[:n].astype(np.uint8).tobytes()


def _blocks(data: bytes) -> bytes:
    whole = len(data) // 255 * 255
    framed = np.empty((whole // 255, 256), np.uint8)
    framed[:, 0] = 255
    framed[:, 1:] = np.frombuffer(data[:whole], np.uint8).reshape(-1, 255)
    rest = data[whole:]
    return framed.tobytes() + (bytes([len(rest)]) + rest if rest else b"") + b"\0"


_GREYS = np.repeat(np.arange(256, dtype=np.uint8), 3).tobytes()
_TURNED = _GREYS[::-1], bytes(range(255, -1, -1))


def encode(payload: bytes, delay_cs: int = 10) -> bytes:
    """Bytes (a positive multiple of WIDTH) as grey frames of WIDTH columns and FRAME_ROWS rows, the last one of fewer."""
    size, rows = WIDTH * FRAME_ROWS, len(payload) // WIDTH
    out = [b"GIF89a", struct.pack("<HHBBB", WIDTH, min(rows, FRAME_ROWS), 0xF7, 0, 0), _GREYS]
    for nth, at in enumerate(range(0, len(payload), size)):
        part, turned = payload[at : at + size], nth % 2
        # disposal 2 clears the canvas after the frame; zero, in this palette, is clear
        out.append(struct.pack("<BBBBHBB", 0x21, 0xF9, 4, 2 << 2 | 1, delay_cs, 255 if turned else 0, 0))
        out.append(struct.pack("<BHHHHB", 0x2C, 0, 0, WIDTH, len(part) // WIDTH, 0x87 if turned else 0))
        out += [_TURNED[0] if turned else b"", b"\x08", _blocks(pack(part.translate(_TURNED[1]) if turned else part))]
    return b"".join([*out, b"\x3b"])


class Frame(NamedTuple):
    nth: int
    delay_ms: int
    left: int
    top: int
    width: int
    height: int
    channels: int  # 1 if every pixel is grey
    pixels: bytes  # of the frame's rectangle, after transparency and what lies below
    histogram: list[int]  # pixels by the two upper bits of red, green and blue


def _joined(data: bytes, at: int) -> tuple[bytes, int]:
    """The bytes of a chain of sub-blocks, and the place after it."""
    # long runs of full blocks are cut out at once
    parts = []
    while True:
        n = data[at]
        if n == 0:
            return b"".join(parts), at + 1
        if n == 255:
            heads = np.frombuffer(data, np.uint8)[at::256]
            full = int(np.argmax(heads != 255)) if (heads != 255).any() else len(heads)
            if at + 256 * full > len(data):
                raise ValueError("a block is cut off")
            parts.append(np.frombuffer(data, np.uint8)[at : at + 256 * full].reshape(full, 256)[:, 1:].tobytes())
            at += 256 * full
            continue
        if at + 1 + n > len(data):
            raise ValueError("a block is cut off")
        parts.append(data[at + 1 : at + 1 + n])
        at += 1 + n


def decode(data: bytes) -> list[Frame]:
    """All frames of a GIF; ValueError if it is not one or is broken."""
    try:
        return _decode(data)
    except (IndexError, struct.error) as e:
        raise ValueError(f"the file is cut off ({e})") from e
    except MemoryError as e:
        raise ValueError("the pictures don't fit into memory") from e


def _coarse(colours: np.ndarray) -> np.ndarray:
    """The two upper bits of red, green and blue."""
    return (colours[:, 0] >> 6 << 4) | (colours[:, 1] >> 6 << 2) | colours[:, 2] >> 6


def _decode(data: bytes) -> list[Frame]:
    if data[:6] not in (b"GIF87a", b"GIF89a"):
        raise ValueError("not a GIF")
    width, height, flags, _, _ = struct.unpack_from("<HHBBB", data, 6)
    if width * height > MAX_PIXELS:
        raise ValueError(f"a canvas of {width} times {height} pixels")
    at, everywhere = 13, None
    palette = lambda at, flags: np.frombuffer(data, np.uint8, 3 << ((flags & 7) + 1), at).reshape(-1, 3)
    if flags & 0x80:
        everywhere = palette(at, flags)
        at += everywhere.size
    canvas = np.zeros((height, width, 3), np.uint8)
    frames: list[Frame] = []
    disposal, delay, clear = 0, 0, None
    while True:
        mark = data[at]
        at += 1
        if mark == 0x3B:
            return frames
        if mark == 0x21:
            label = data[at]
            body, at = _joined(data, at + 1)
            if label == 0xF9:
                packed, delay, index = struct.unpack_from("<BHB", body)
                disposal, clear = packed >> 2 & 7, index if packed & 1 else None
            continue
        if mark != 0x2C:
            raise ValueError(f"unknown block {mark:#x}")
        left, top, w, h, flags = struct.unpack_from("<HHHHB", data, at)
        at += 9
        colours = everywhere
        if flags & 0x80:
            colours = palette(at, flags)
            at += colours.size
        if colours is None:
            raise ValueError("no palette")
        if left + w > width or top + h > height:
            raise ValueError("a frame reaches over the canvas")
        least = data[at]
        stream, at = _joined(data, at + 1)
        index = unpack(stream, least, w * h)
        if len(index) < w * h:
            raise ValueError("too few pixels")
        index = index.reshape(h, w)
        if flags & 0x40:
            order = np.concatenate([np.arange(a, h, b) for a, b in ((0, 8), (4, 8), (2, 4), (1, 2))])
            lines = np.empty_like(index)
            lines[order] = index
            index = lines
        if index.size and index.max() >= len(colours):
            raise ValueError("a colour outside the palette")
        before = canvas.copy() if disposal == 3 else None
        area = canvas[top : top + h, left : left + w]
        painted, used, under = colours[index], np.bincount(index.ravel(), minlength=len(colours)), area[:0, 0]
        if clear is not None and clear < len(colours) and used[clear]:
            unseen = index == clear
            under, used[clear] = area[unseen], 0
            painted[unseen] = under
        area[...] = painted
        shown = np.concatenate([colours[used > 0], under])
        grey = bool((shown == shown[:, :1]).all())
        histogram = np.bincount(_coarse(colours), used, 64).astype(np.int64) + np.bincount(_coarse(under), minlength=64)
        frames.append(Frame(len(frames), delay * 10, left, top, w, h, 1 if grey else 3, np.ascontiguousarray(painted[..., 0] if grey else painted).tobytes(), histogram.tolist()))
        if disposal == 2:
            area[...] = 0
        elif before is not None:
            canvas = before
        disposal, delay, clear = 0, 0, None


_FRAME = pa.struct([("nth", pa.int32()), ("delay_ms", pa.int32()), ("left", pa.int32()), ("top", pa.int32()), ("width", pa.int32()), ("height", pa.int32()), ("channels", pa.int32()), ("pixels", pa.binary()), ("histogram", pa.list_(pa.int64()))])


def _stored(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    for whole in batches:
        for batch, texts in slices(whole, "payload"):
            padded = [t + bytes(-len(t) % WIDTH if t else WIDTH) for t in texts]
            yield pa.RecordBatch.from_arrays([batch.column("doc_id"), pa.array([len(t) for t in texts], pa.int64()), pa.array([encode(p) for p in padded], pa.binary())], ["doc_id", "n_bytes", "media"])


def _read(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    for whole in batches:
        for batch, media in slices(whole, "media"):
            rows, errors = [], []
            for empty, data in zip(batch.column("media").is_null().to_pylist(), media, strict=True):
                try:
                    rows.append(None if empty else [f._asdict() for f in decode(data)])
                    errors.append(None)
                except ValueError as e:
                    rows.append([])
                    errors.append(str(e))
            yield pa.RecordBatch.from_arrays([*batch.columns, pa.array(rows, pa.list_(_FRAME)), pa.array(errors, pa.string())], [*batch.schema.names, "frames", "error"])


def store(docs: DataFrame) -> DataFrame:
    """doc_id, n_bytes and media: the bytes of column payload (text or binary), padded with zeros to a positive multiple
    of WIDTH, as a GIF without loss. Null payloads are empty ones; every row of docs gives a row."""
    return docs.select("doc_id", docs["payload"].cast("binary").alias("payload")).transform(in_batches, _stored, T.StructType([docs.schema["doc_id"], *T._parse_datatype_string("n_bytes long, media binary")]))


def frames(media: DataFrame) -> DataFrame:
    """Decode column media (binary) of each row; all columns stay, with frames and error after them.

    frames: array of nth, delay_ms, left, top, width, height, channels, pixels, histogram. A null picture has null
    frames; a broken one, and one whose canvas has more than MAX_PIXELS, has none and says why in error. Columns of media named frames or error give way.
    """
    media = media.drop("frames", "error")
    kinds = "array<struct<nth:int,delay_ms:int,left:int,top:int,width:int,height:int,channels:int,pixels:binary,histogram:array<long>>>"
    return media.transform(in_batches, _read, T.StructType([*media.schema, *T._parse_datatype_string(f"frames {kinds}, error string")]))
