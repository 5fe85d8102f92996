"""Media columns: payloads in ISO media containers, read by their sample tables.

A container is a tree of boxes (size, four-character type, body). The reader walks
the nested boxes, decodes the sample tables (stsz or stz2, stsc, stco/co64, stts,
stss) and the runs of movie fragments (tfhd, trun, with the defaults of trex) into
byte ranges and gives codec, duration and keyframe ranges without decoding any
payload: ``describe_media`` for a column of files, ``read_tracks`` for one. The writer
stores a payload as the 8-bit samples of one PCM sound track.
"""

from __future__ import annotations

import hashlib
import struct
import zlib
from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame

from .common import slices

#: Payload bytes are padded with 255 to a positive multiple of this.
FRAME_BYTES = 576
#: Samples (frames) in a chunk of the media data, and between two sync samples.
FRAMES_A_CHUNK, FRAMES_A_KEY = 16, 8
SAMPLE_RATE = 8000
#: Boxes that hold boxes.
CONTAINERS = frozenset({b"moov", b"trak", b"mdia", b"minf", b"stbl", b"dinf", b"edts", b"udta", b"mvex", b"moof", b"traf"})


def padded(data: bytes) -> bytes:
    """``data`` and bytes 255 up to a positive multiple of FRAME_BYTES."""
    return data + b"\xff" * (-len(data) % FRAME_BYTES if data else FRAME_BYTES)


def box(kind: bytes, *parts: bytes) -> bytes:
    body = b"".join(parts)
    if len(body) + 8 < 1 << 32:
        return struct.pack(">I4s", len(body) + 8, kind) + body
    return struct.pack(">I4sQ", 1, kind, len(body) + 16) + body


def full_box(kind: bytes, *parts: bytes, flags: int = 0) -> bytes:
    return box(kind, struct.pack(">I", flags), *parts)


def write_container(payload: bytes) -> bytes:
    """A file with ``payload`` (a positive multiple of FRAME_BYTES) as one PCM track."""
    frames = len(payload) // FRAME_BYTES
    duration = frames * FRAME_BYTES
    chunks = -(-frames // FRAMES_A_CHUNK)
    last = frames - (chunks - 1) * FRAMES_A_CHUNK
    runs = [(1, FRAMES_A_CHUNK, 1)] if last == FRAMES_A_CHUNK else [(1, FRAMES_A_CHUNK, 1), (chunks, last, 1)]
    runs = runs[-1:] if chunks == 1 else runs
    keys = np.arange(1, frames + 1, FRAMES_A_KEY, dtype=">u4")
    matrix = struct.pack(">9I", 0x10000, 0, 0, 0, 0x10000, 0, 0, 0, 0x40000000)
    wide = len(payload) >= 1 << 31
    ftyp = box(b"ftyp", b"isom", struct.pack(">I", 512), b"isomiso2")

    def moov(first: int) -> bytes:
        offsets = first + np.arange(chunks, dtype=np.int64) * (FRAME_BYTES * FRAMES_A_CHUNK)
        entry = box(b"raw ", bytes(6), struct.pack(">HIIHHHHI", 1, 0, 0, 1, 8, 0, 0, SAMPLE_RATE << 16))
        stbl = box(
            b"stbl",
            full_box(b"stsd", struct.pack(">I", 1), entry),
            full_box(b"stts", struct.pack(">III", 1, frames, FRAME_BYTES)),
            full_box(b"stss", struct.pack(">I", len(keys)), keys.tobytes()),
            full_box(b"stsc", struct.pack(">I", len(runs)), *(struct.pack(">III", *r) for r in runs)),
            full_box(b"stsz", struct.pack(">II", FRAME_BYTES, frames)),
            full_box(b"co64" if wide else b"stco", struct.pack(">I", chunks), offsets.astype(">u8" if wide else ">u4").tobytes()),
        )
        dinf = box(b"dinf", full_box(b"dref", struct.pack(">I", 1), full_box(b"url ", flags=1)))
        minf = box(b"minf", full_box(b"smhd", bytes(4)), dinf, stbl)
        mdhd = full_box(b"mdhd", struct.pack(">IIIIHH", 0, 0, SAMPLE_RATE, duration & 0xFFFFFFFF, 0x55C4, 0))
        hdlr = full_box(b"hdlr", bytes(4), b"soun", bytes(12), b"bytes\0")
        tkhd = full_box(b"tkhd", struct.pack(">5I", 0, 0, 1, 0, duration & 0xFFFFFFFF), bytes(8), struct.pack(">4H", 0, 0, 256, 0), matrix, bytes(8), flags=7)
        mvhd = full_box(b"mvhd", struct.pack(">4I", 0, 0, SAMPLE_RATE, duration & 0xFFFFFFFF), struct.pack(">IH", 0x10000, 256), bytes(10), matrix, bytes(24), struct.pack(">I", 2))
        return box(b"moov", mvhd, box(b"trak", tkhd, box(b"mdia", mdhd, hdlr, minf)))

    head = 16 if len(payload) + 8 >= 1 << 32 else 8
    first = len(ftyp) + len(moov(0)) + head
    return b"".join((ftyp, moov(first), box(b"mdat", payload)))


def boxes(data: bytes | memoryview, start: int = 0, end: int | None = None, path: tuple = ()) -> Iterator[tuple[tuple, int, int]]:
    """(path of types, body start, body end) of every box, nested ones included.

    A box that ends beyond what holds it raises ValueError.
    """
    todo = [(start, len(data) if end is None else end, path)]
    while todo:
        at, end, path = todo.pop()
        if at + 8 > end:
            continue
        size, kind = struct.unpack_from(">I4s", data, at)
        body = at + 8
        if size == 1:
            if at + 16 > end:
                raise ValueError(f"box {kind!r} at {at} is cut off")
            (size,) = struct.unpack_from(">Q", data, at + 8)
            body = at + 16
        stop = end if size == 0 else at + size
        if stop < body or stop > end:
            raise ValueError(f"box {kind!r} at {at} is cut off")
        yield (*path, kind), body, stop
        todo.append((stop, end, path))
        if kind in CONTAINERS:
            todo.append((body, stop, (*path, kind)))


def _table(data, body: int, count_at: int, kind: str, width: int = 1) -> np.ndarray:
    (n,) = struct.unpack_from(">I", data, body + count_at)
    flat = np.frombuffer(data, dtype=kind, count=n * width, offset=body + count_at + 4).astype(np.int64)
    return flat.reshape(n, width) if width > 1 else flat


def _small_sizes(data, body: int) -> np.ndarray:
    """Sizes of 4, 8 or 16 bits (stz2)."""
    bits, n = data[body + 7], struct.unpack_from(">I", data, body + 8)[0]
    if bits == 4:
        pairs = np.frombuffer(data, dtype=np.uint8, count=-(-n // 2), offset=body + 12)
        return np.stack([pairs >> 4, pairs & 15], axis=1).ravel()[:n].astype(np.int64)
    return np.frombuffer(data, dtype={8: ">u1", 16: ">u2"}[bits], count=n, offset=body + 12).astype(np.int64)


#: Bits of tfhd and trun that say which fields follow, and the sample flag of no sync sample.
TFHD_FIELDS = ((0x1, "base", ">Q"), (0x2, "entry", ">I"), (0x8, "duration", ">I"), (0x10, "size", ">I"), (0x20, "flags", ">I"))
TRUN_FIELDS = ((0x100, "duration"), (0x200, "size"), (0x400, "flags"), (0x800, "shift"))
NOT_SYNC = 0x10000


def _run(data, body: int, moof: int, after: int | None, defaults: dict) -> dict:
    """Sizes, starts, ticks and sync samples of one run of a movie fragment."""
    flags, n = struct.unpack_from(">II", data, body)
    flags &= 0xFFFFFF
    at, start = body + 8, defaults.get("base", moof) if after is None else after
    if flags & 0x1:
        start = defaults.get("base", moof) + struct.unpack_from(">i", data, at)[0]
        at += 4
    first = None
    if flags & 0x4:
        (first,) = struct.unpack_from(">I", data, at)
        at += 4
    fields = [name for bit, name in TRUN_FIELDS if flags & bit]
    rows = np.frombuffer(data, dtype=">u4", count=n * len(fields), offset=at).reshape(n, len(fields)).astype(np.int64)
    column = lambda name: rows[:, fields.index(name)] if name in fields else np.full(n, defaults.get(name, 0), dtype=np.int64)
    sizes, marks = column("size"), column("flags").copy()
    if first is not None and n:
        marks[0] = first
    return {"sizes": sizes, "starts": start + np.cumsum(sizes) - sizes, "ticks": int(column("duration").sum()), "sync": (marks & NOT_SYNC) == 0}


def read_tracks(data: bytes) -> list[dict]:
    """Codec, timescale, duration and sample byte ranges of every track.

    Sample n lies at ``starts[n]`` with ``sizes[n]`` bytes; ``keys`` are the
    numbers (from 0) of the sync samples, all of them without a stss box. Samples of
    movie fragments follow those of the sample tables. ``duration`` is what mdhd says
    or, where that is nothing, the sum of the sample durations. A track without
    sample tables has no samples; tables that don't fit raise ValueError.
    """
    tracks: list[dict] = []
    extends, moof, now, ends = {}, 0, None, {}
    for path, body, _ in boxes(data):
        kind = path[-1]
        if kind == b"trak":
            tracks.append({})
        elif kind == b"trex":
            number, _, duration, size, flags = struct.unpack_from(">5I", data, body + 4)
            extends[number] = {"duration": duration, "size": size, "flags": flags}
        elif kind == b"moof":
            moof, ends = body - 8, {}
        elif kind == b"tfhd":
            flags, number = struct.unpack_from(">II", data, body)
            now, at = {"number": number, **extends.get(number, {})}, body + 8
            for bit, name, form in TFHD_FIELDS:
                if flags & bit:
                    (now[name],) = struct.unpack_from(form, data, at)
                    at += struct.calcsize(form)
        elif kind == b"trun" and now:
            found = _run(data, body, moof, ends.get(now["number"]), now)
            ends[now["number"]] = int(found["starts"][-1] + found["sizes"][-1]) if len(found["sizes"]) else ends.get(now["number"])
            for t in tracks:
                if t.get("number") == now["number"]:
                    t.setdefault("runs", []).append(found)
        elif not tracks:
            continue
        elif kind == b"tkhd":
            (tracks[-1]["number"],) = struct.unpack_from(">I", data, body + (20 if data[body] == 1 else 12))
        elif kind == b"mdhd":
            long = data[body] == 1
            scale, length = struct.unpack_from(">IQ" if long else ">II", data, body + (20 if long else 12))
            tracks[-1] |= {"timescale": scale, "duration": length}
        elif kind == b"hdlr":
            tracks[-1].setdefault("handler", bytes(data[body + 8 : body + 12]).decode("latin-1"))
        elif kind == b"stsd":
            tracks[-1]["codec"] = bytes(data[body + 12 : body + 16]).decode("latin-1")
        elif kind == b"stts":
            tracks[-1]["stts"] = _table(data, body, 4, ">u4", 2)
        elif kind == b"stss":
            tracks[-1]["stss"] = _table(data, body, 4, ">u4")
        elif kind == b"stsc":
            tracks[-1]["stsc"] = _table(data, body, 4, ">u4", 3)
        elif kind == b"stsz":
            size, n = struct.unpack_from(">II", data, body + 4)
            tracks[-1]["sizes"] = np.full(n, size, dtype=np.int64) if size else _table(data, body, 8, ">u4")
        elif kind == b"stz2":
            tracks[-1]["sizes"] = _small_sizes(data, body)
        elif kind in (b"stco", b"co64"):
            tracks[-1]["chunks"] = _table(data, body, 4, ">u4" if kind == b"stco" else ">u8")
    for t in tracks:
        _place(t)
    return tracks


def _place(t: dict) -> None:
    """Starts, sync samples, ticks and duration of a track, from its tables and runs."""
    none = np.zeros(0, dtype=np.int64)
    sizes, chunks, runs = t.get("sizes", none), t.get("chunks", none), t.get("stsc", none.reshape(0, 3))
    first = np.append(runs[:, 0] - 1, len(chunks))
    each = np.repeat(runs[:, 1], np.maximum(0, np.diff(first)))
    if each.sum() < len(sizes):
        raise ValueError("the chunks hold fewer samples than there are")
    chunk = np.repeat(np.arange(len(each)), each)[: len(sizes)]
    before = np.cumsum(sizes) - sizes
    opening = (np.cumsum(each) - each)[chunk]
    t["starts"] = chunks[chunk] + before - before[opening]
    t["sizes"] = sizes
    t["ticks"] = int((t["stts"][:, 0] * t["stts"][:, 1]).sum()) if "stts" in t else 0
    t["keys"] = t["stss"] - 1 if "stss" in t else np.arange(len(sizes))
    for run in t.get("runs", ()):
        t["keys"] = np.concatenate([t["keys"], len(t["sizes"]) + np.flatnonzero(run["sync"])])
        t["starts"], t["sizes"] = np.concatenate([t["starts"], run["starts"]]), np.concatenate([t["sizes"], run["sizes"]])
        t["ticks"] += run["ticks"]
    if len(t["keys"]) and t["keys"].max() >= len(t["sizes"]):
        raise ValueError("a sync sample is beyond the last sample")
    t["timescale"] = t.get("timescale", 0)
    t["duration"] = t.get("duration", 0) or t["ticks"]


def sample_bytes(data: bytes, track: dict) -> bytes:
    """All samples of a track in order; adjoining ranges are read as one."""
    starts, sizes = track["starts"], track["sizes"]
    if not len(starts):
        return b""
    cut = np.flatnonzero(starts[1:] != starts[:-1] + sizes[:-1]) + 1
    lows = np.concatenate([[0], cut])
    highs = np.concatenate([cut, [len(starts)]]) - 1
    view = memoryview(data)
    return b"".join(view[starts[a] : starts[b] + sizes[b]] for a, b in zip(lows, highs))


def keyframe_ranges(track: dict) -> list[dict]:
    """First byte and bytes of every sync sample in the file."""
    keys = track["keys"]
    return [{"start": a, "bytes": n} for a, n in zip(track["starts"][keys].tolist(), track["sizes"][keys].tolist())]


def seconds_of(track: dict) -> float | None:
    return track["duration"] / track["timescale"] if track["timescale"] else None


def describe(track: dict) -> str:
    """Codec, duration and keyframe ranges as one line."""
    keys = keyframe_ranges(track)
    digest = hashlib.sha256(repr([(k["start"], k["bytes"]) for k in keys]).encode()).hexdigest()[:16]
    return f"{track['handler']}/{track['codec']};{seconds_of(track):.6f}s;{len(track['sizes'])} samples;{len(keys)} keyframes;{digest}"


RANGES = pa.list_(pa.struct([("start", pa.int64()), ("bytes", pa.int64())]))
TRACK_SCHEMA = "track int, handler string, codec string, seconds double, samples long, keyframes array<struct<start:long,bytes:long>>, problem string"


def describe_media(files: DataFrame, key: str = "doc_id", media: str = "media") -> DataFrame:
    """The tracks of a binary column of files, one row each: their number from 1, handler, codec, seconds, samples and keyframe byte ranges.

    ``key`` is carried along; other columns are not. What can't be read gives one row
    without a track and says so in ``problem``: a null, a file without a track, one that
    is cut off or no ISO media file. Repeated rows give repeated results. Narrow: one
    pass; a payload is never decoded.
    """

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in slices(batches, 1):
            owners, rows = [], []
            for k, data in enumerate(batch.column(1)):
                found = list(_rows(data.as_buffer() if data.is_valid else None))
                owners += [k] * len(found)
                rows += found
            columns = [pa.array(c, type=t) for c, t in zip(zip(*rows) if rows else [[]] * 7, types)]
            yield pa.RecordBatch.from_arrays([batch.column(0).take(pa.array(owners, pa.int64())), *columns], [key, *names])

    names = ["track", "handler", "codec", "seconds", "samples", "keyframes", "problem"]
    types = [pa.int32(), pa.string(), pa.string(), pa.float64(), pa.int64(), RANGES, pa.string()]
    kind = files.schema[key].dataType.simpleString()
    return files.select(key, media).mapInArrow(run, f"`{key}` {kind}, {TRACK_SCHEMA}")


def _rows(data) -> Iterator[tuple]:
    if data is None:
        yield None, None, None, None, None, None, "null"
        return
    try:
        tracks = read_tracks(memoryview(data))
    except (ValueError, KeyError, IndexError, struct.error) as problem:
        yield None, None, None, None, None, None, f"unreadable: {problem}"
        return
    if not tracks:
        yield None, None, None, None, None, None, "no track"
    for k, t in enumerate(tracks, 1):
        yield k, t.get("handler"), t.get("codec"), seconds_of(t), len(t["sizes"]), keyframe_ranges(t), None


SCHEMA = "doc_id long, n_bytes long, payload_bytes long, payload_sha256 string, tail_crc32 long, media_bytes long, media_sha256 string, feature string"


def store_media(docs: DataFrame, with_file: bool = False, with_keyframes: bool = False) -> DataFrame:
    """Store every text as an ISO media file, read it back and give its features.

    Null and empty texts give a payload of one frame of padding. Repeated rows
    give repeated results; other columns of ``docs`` are not carried. Columns that
    may follow: ``codec``, ``seconds`` and ``keyframes`` (byte ranges), and the container
    itself as ``media``. Narrow: one pass, one text in memory at a time.
    """

    def store(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in slices(batches, 1):
            out = {name: [] for name in names}
            for doc_id, text in zip(batch.column(0).to_pylist(), batch.column(1)):
                raw = bytes(text.as_buffer()) if text.is_valid else b""
                media = write_container(padded(raw))
                (track,) = read_tracks(media)
                back = sample_bytes(media, track)
                row = (doc_id, len(raw), len(back), hashlib.sha256(back).hexdigest(), zlib.crc32(back[-32:]), len(media), hashlib.sha256(media).hexdigest(), describe(track))
                row += (track["codec"], seconds_of(track), keyframe_ranges(track)) if with_keyframes else ()
                for name, value in zip(names, (*row, media) if with_file else row):
                    out[name].append(value)
            yield pa.RecordBatch.from_arrays([pa.array(out[n], type=t) for n, t in zip(names, types)], names)

    names = ["doc_id", "n_bytes", "payload_bytes", "payload_sha256", "tail_crc32", "media_bytes", "media_sha256", "feature"]
    types = [pa.int64(), pa.int64(), pa.int64(), pa.string(), pa.int64(), pa.int64(), pa.string(), pa.string()]
    schema = SCHEMA
    if with_keyframes:
        names, types = [*names, "codec", "seconds", "keyframes"], [*types, pa.string(), pa.float64(), RANGES]
        schema += ", codec string, seconds double, keyframes array<struct<start:long,bytes:long>>"
    if with_file:
        names, types, schema = [*names, "media"], [*types, pa.binary()], schema + ", media binary"
    return docs.select(docs["doc_id"].cast("long"), docs["text"]).mapInArrow(store, schema)
