"""GIF media columns: writing, decoding and describing GIF streams.

``decode`` reads any GIF87a or GIF89a stream: LZW code streams, global and local
palettes, interlaced frames, transparency and the disposal rules, and gives the
timed frames as full RGB canvases. ``encode`` writes 8-bit samples losslessly
as frames of WIDTH x HEIGHT with a grey palette, so that a sample's value is its
palette index. Rows are independent: nothing is shuffled, and a worker holds one
stream at a time.

Defined cases: null and empty texts give a payload of 64 zero bytes; very long
texts are frames of one stream; equal payloads (ties, repeated rows) give equal
streams; a damaged or cut stream raises ValueError from ``decode``, gives null
columns in ``describe`` and one row without a frame in ``frames``; an empty table
gives an empty result; other columns, whatever their names, are ignored.
"""

from __future__ import annotations

import hashlib
import zlib
from functools import lru_cache

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from factloom.llm.common import Scratch, arrow_map, table

NAME = "op7_gif_media"
WIDTH, HEIGHT, UNIT = 64, 256, 64
#: Hundredths of a second for which an encoded frame is shown.
DELAY = 4
BINS = 16
GREY = np.repeat(np.arange(256, dtype=np.uint8), 3).tobytes()


def lzw_encode(data: bytes) -> bytes:
    """Variable-width LZW codes of 8-bit samples, least significant bit first."""
    clear, stop = 256, 257
    codes, restarts = [clear], [0]
    known: dict[int, int] = {}
    after, prefix = 258, data[0]
    get, put = known.get, codes.append
    for sample in memoryview(data)[1:]:
        key = prefix << 8 | sample
        code = get(key)
        if code is not None:
            prefix = code
            continue
        put(prefix)
        prefix = sample
        if after < 4096:
            known[key] = after
            after += 1
        else:
            restarts.append(len(codes))
            put(clear)
            known.clear()
            after = 258
    codes += [prefix, stop]
    # A decoder knows 258 entries after a clear code and the next one; each later code adds one, up to 4096.
    since = np.arange(len(codes)) - np.repeat(restarts, np.diff([*restarts, len(codes)]))
    since[restarts[1:]] = np.diff(restarts)
    size = np.minimum(258 + np.maximum(since - 2, 0), 4095)
    width = np.searchsorted([512, 1024, 2048], size, side="right") + 9
    at = np.cumsum(width) - width
    value = np.array(codes, np.int64) << (at & 7)
    total = int(at[-1] + width[-1] + 7) // 8
    return sum(np.bincount((at >> 3) + k, value >> (8 * k) & 255, total + 3) for k in range(3)).astype(np.uint8)[:total].tobytes()


@lru_cache
def code_places(low: int, count: int) -> tuple[np.ndarray, np.ndarray]:
    """First bits and masks of count codes after a clear code."""
    size = (1 << low) + 2 + np.maximum(np.arange(count) - 1, 0)
    width = np.clip(np.searchsorted(1 << np.arange(13), size, side="right"), low + 1, 12)
    return np.cumsum(width) - width, ((1 << width) - 1).astype(np.uint32)


def lzw_decode(data: bytes, low: int, most: int) -> bytes:
    """Samples of an LZW code stream with codes of low + 1 bits at first; reads no more than most samples.

    Where a code stands depends only on the codes since the last clear code, so
    a run's codes are cut out together and then looked up one by one.
    """
    clear, stop = 1 << low, (1 << low) + 1
    base = [bytes([k]) for k in range(clear)] + [b"", b""]
    four = np.ndarray((len(data) + 1,), "<u4", data + b"\0\0\0\0", strides=(1,))
    out: list[bytes] = []
    total, start, bits = 0, 0, 8 * len(data)
    while total < most:
        places, masks = code_places(low, 1 << max(8, ((bits - start) // (low + 1)).bit_length()))
        n = int(np.searchsorted(places + (low + 1), bits - start, side="right"))
        if not n:
            break
        at = places[:n] + start
        codes = (four[at >> 3] >> (at & 7).astype(np.uint32)) & masks[:n]
        ends = np.flatnonzero((codes & ~np.uint32(1)) == clear)
        n = int(ends[0]) if len(ends) else n
        if n:
            if codes[0] >= clear or (codes[1:n] > np.minimum(np.arange(n - 1) + stop + 1, 4095)).any():
                raise ValueError("a code beyond the table")
            run, entries = codes[:n].tolist(), base.copy()
            last, first, full = entries[run[0]], len(out), 4096 - len(base)
            put, add = out.append, entries.append
            put(last)
            for code in run[1 : full + 1]:
                now = entries[code] if code < len(entries) else last + last[:1]
                add(last + now[:1])
                put(now)
                last = now
            out += [entries[code] for code in run[full + 1 :]]
            total += sum(map(len, out[first:]))
        if not len(ends) or codes[n] == stop:
            break
        start = int(at[n]) + int(masks[n]).bit_length()
    return b"".join(out)


def blocks(data: bytes) -> bytes:
    """Data as sub-blocks of at most 255 bytes."""
    return b"".join(bytes([len(x := data[k : k + 255])]) + x for k in range(0, len(data), 255)) + b"\0"


def encode(samples: bytes) -> bytes:
    """A GIF of frames of WIDTH x HEIGHT samples, the last one as high as needed; a positive multiple of WIDTH samples."""
    out = [b"GIF89a", WIDTH.to_bytes(2, "little"), min(HEIGHT, len(samples) // WIDTH).to_bytes(2, "little"), b"\xf7\0\0", GREY]
    for k in range(0, len(samples), WIDTH * HEIGHT):
        frame = samples[k : k + WIDTH * HEIGHT]
        out.append(b"\x21\xf9\x04\x04" + DELAY.to_bytes(2, "little") + b"\0\0")
        out.append(b"\x2c\0\0\0\0" + WIDTH.to_bytes(2, "little") + (len(frame) // WIDTH).to_bytes(2, "little") + b"\0\x08")
        out.append(blocks(lzw_encode(frame)))
    return b"".join([*out, b"\x3b"])


def decode(stream: bytes) -> dict:
    """width, height and frames: (delay in hundredths, rectangle x, y, w, h, canvas h x w x 3 of bytes) each."""
    if stream[:6] not in (b"GIF87a", b"GIF89a") or len(stream) < 13:
        raise ValueError("not a GIF")
    two = lambda k: int.from_bytes(stream[k : k + 2], "little")
    wide, high, flags, back = two(6), two(8), stream[10], stream[11]
    at, palette = 13, None

    def colours(at: int, flags: int) -> np.ndarray:
        size = 3 << ((flags & 7) + 1)
        if len(stream) < at + size:
            raise ValueError("cut short in a palette")
        return np.frombuffer(stream, np.uint8, size, at).reshape(-1, 3)

    def sub_blocks(at: int) -> tuple[bytes, int]:
        pieces = []
        while True:
            if at >= len(stream):
                raise ValueError("cut short in a block")
            n = stream[at]
            if not n:
                return b"".join(pieces), at + 1
            if at + n >= len(stream):
                raise ValueError("cut short in a block")
            pieces.append(stream[at + 1 : at + 1 + n])
            at += n + 1

    if flags & 0x80:
        palette = colours(at, flags)
        at += palette.size
    paper = palette[back] if palette is not None and back < len(palette) else np.zeros(3, np.uint8)
    canvas = np.empty((high, wide, 3), np.uint8)
    canvas[:] = paper
    frames: list[tuple] = []
    delay, clear_to, see_through = 0, 0, None
    while True:
        if at >= len(stream):
            raise ValueError("no end")
        if stream[at] == 0x3B:
            break
        if stream[at] == 0x21:
            if at + 2 > len(stream):
                raise ValueError("cut short in an extension")
            data, after = sub_blocks(at + 2)
            if stream[at + 1] == 0xF9 and len(data) >= 4:
                clear_to, delay = data[0] >> 2 & 7, int.from_bytes(data[1:3], "little")
                see_through = data[3] if data[0] & 1 else None
            at = after
        elif stream[at] == 0x2C:
            if len(stream) < at + 10:
                raise ValueError("cut short in an image descriptor")
            x, y, w, h, own = two(at + 1), two(at + 3), two(at + 5), two(at + 7), stream[at + 9]
            at += 10
            table_ = palette
            if own & 0x80:
                table_ = colours(at, own)
                at += table_.size
            if table_ is None:
                raise ValueError("no palette")
            if at >= len(stream) or not 2 <= stream[at] <= 8:
                raise ValueError("no size of codes")
            low = stream[at]
            data, at = sub_blocks(at + 1)
            found = lzw_decode(data, low, w * h)
            if len(found) < w * h:
                raise ValueError("too few samples")
            rows = np.frombuffer(found, np.uint8, w * h).reshape(h, w)
            if own & 0x40:
                order = np.concatenate([np.arange(a, h, b) for a, b in ((0, 8), (4, 8), (2, 4), (1, 2))])
                straight = np.empty_like(rows)
                straight[order] = rows
                rows = straight
            before = canvas.copy() if clear_to == 3 else None
            fit = rows[: max(0, high - y), : max(0, wide - x)]
            full = np.zeros((256, 3), np.uint8)
            full[: len(table_)] = table_
            target = canvas[y : y + fit.shape[0], x : x + fit.shape[1]]
            if see_through is None:
                target[:] = full[fit]
            else:
                target[fit != see_through] = full[fit[fit != see_through]]
            frames.append((delay, (x, y, fit.shape[1], fit.shape[0]), canvas.copy()))
            if clear_to == 2:
                target[:] = paper
            elif before is not None:
                canvas = before
            delay, clear_to, see_through = 0, 0, None
        else:
            raise ValueError(f"unknown block {stream[at]}")
    return {"width": wide, "height": high, "frames": frames}


def samples(picture: dict) -> bytes:
    """The red channel of every frame's own rectangle, in order: what ``encode`` stored."""
    return b"".join(canvas[y : y + h, x : x + w, 0].tobytes() for _, (x, y, w, h), canvas in picture["frames"])


def timed(picture: dict) -> list[dict]:
    """Frames with their time, rectangle and colour histogram: pixels by channel and by BINS ranges of its values, 3 x BINS."""
    out, starts = [], 0
    for delay, (x, y, w, h), canvas in picture["frames"]:
        part = canvas[y : y + h, x : x + w]
        counts = [np.bincount(part[:, :, c].ravel() // (256 // BINS), minlength=BINS) for c in range(3)]
        out.append({"starts_cs": starts, "delay_cs": delay, "x": x, "y": y, "w": w, "h": h, "histogram": np.concatenate(counts).tolist()})
        starts += delay
    return out


def payload(text: bytes) -> bytes:
    return text + b"\0" * (-len(text) % UNIT or (0 if text else UNIT))


def store(docs: DataFrame, id_col: str = "doc_id", text_col: str = "text") -> DataFrame:
    """doc_id, n_bytes and media, the GIF of each text's padded bytes."""

    def run(batch):
        texts = [x or b"" for x in batch.column(1).cast(pa.large_binary()).to_pylist()]
        media = [encode(payload(x)) for x in texts]
        yield pa.record_batch([batch.column(0), pa.array([len(x) for x in texts], pa.int64()), pa.array(media, pa.binary())], ["doc_id", "n_bytes", "media"])

    rows = docs.select(F.col(id_col).cast("long").alias("doc_id"), F.col(text_col).cast("string").alias("text"))
    return arrow_map(rows, run, "doc_id long, n_bytes long, media binary")


FRAME = pa.struct([*((name, pa.int64()) for name in ("starts_cs", "delay_cs", "x", "y", "w", "h")), ("histogram", pa.list_(pa.int64()))])
FRAME_SQL = "struct<starts_cs:bigint,delay_cs:bigint,x:bigint,y:bigint,w:bigint,h:bigint,histogram:array<bigint>>"


def describe(media: DataFrame) -> DataFrame:
    """Columns read back from stored GIFs: samples' digest and tail, frames with time, rectangle and histogram, their sum as text."""
    names = ["doc_id", "n_bytes", "payload_bytes", "payload_sha256", "tail_crc32", "media_bytes", "media_sha256", "feature", "frames"]
    kinds = [pa.int64(), pa.string(), pa.int64(), pa.int64(), pa.string(), pa.string(), pa.list_(FRAME)]

    def one(stream: bytes | None) -> tuple:
        if stream is None:
            return (None,) * 7
        known = (len(stream), hashlib.sha256(stream).hexdigest())
        try:
            picture = decode(stream)
        except ValueError:
            return (None, None, None, *known, None, None)
        data, found = samples(picture), timed(picture)
        grey = np.sum([x["histogram"][:BINS] for x in found], axis=0).tolist() if found else [0] * BINS
        feature = f"{len(found)} frames, {sum(x['delay_cs'] for x in found)} cs, grey " + " ".join(map(str, grey))
        return len(data), hashlib.sha256(data).hexdigest(), zlib.crc32(data[-UNIT:]), *known, feature, found

    def run(batch):
        cols = list(zip(*map(one, batch.column(2).to_pylist()), strict=True))
        yield pa.record_batch([batch.column(0), batch.column(1), *map(pa.array, cols, kinds)], names)

    schema = f"doc_id long, n_bytes long, payload_bytes long, payload_sha256 string, tail_crc32 long, media_bytes long, media_sha256 string, feature string, frames array<{FRAME_SQL}>"
    return arrow_map(media.select("doc_id", "n_bytes", "media"), run, schema)


def frames(media: DataFrame) -> DataFrame:
    """One row per frame of each stored GIF: doc_id, frame, its time, rectangle, RGB bytes and histogram.

    A null or damaged stream gives one row whose frame is null.
    """
    names = ["doc_id", "frame", *(x.name for x in FRAME), "rgb"]

    def run(batch):
        for key, stream in zip(batch.column(0).to_pylist(), batch.column(1).to_pylist(), strict=True):
            try:
                picture = decode(stream or b"")
                rows = [(key, k, *x.values(), canvas[y : y + h, x_ : x_ + w].tobytes()) for k, (x, (_, (x_, y, w, h), canvas)) in enumerate(zip(timed(picture), picture["frames"], strict=True))]
            except ValueError:
                rows = [(key, *[None] * (len(names) - 1))]
            if rows:
                yield pa.record_batch(list(map(pa.array, zip(*rows, strict=True), [pa.int64()] * 8 + [pa.list_(pa.int64()), pa.binary()])), names)

    return arrow_map(media.select("doc_id", "media"), run, "doc_id long, frame long, starts_cs long, delay_cs long, x long, y long, w long, h long, histogram array<long>, rgb binary")


def query(spark: SparkSession, sf_dir: str) -> DataFrame:
    return describe(Scratch(spark).save(store(table(spark, sf_dir, "documents")), "media"))
