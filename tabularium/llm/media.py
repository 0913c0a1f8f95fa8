"""Media columns: ISO media containers as binary values, described from their boxes alone.

``describe`` walks the nested boxes, decodes the sample tables, those of movie
fragments too, and gives codec, durations and the times and byte ranges of the
keyframes; payloads are neither copied nor decoded. ``wrap`` stores bytes losslessly as 8-bit mono PCM in such a container,
and ``read_samples`` reads a track's bytes back through its tables.
"""

from __future__ import annotations

import hashlib
import struct
import zlib
from collections.abc import Iterator
from dataclasses import dataclass, field

import numpy as np
import pandas as pd
from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

from tabularium.llm.common import table

#: Bytes of a stored sample, samples of a chunk, samples from one keyframe to the next, PCM rate.
UNIT, CHUNK, GROUP, RATE = 64, 16, 32, 8000
# Fixed values of the format: boxes that hold boxes, and the bytes before those boxes where there are any.
NESTED = {b"moov": 0, b"trak": 0, b"mdia": 0, b"minf": 0, b"stbl": 0, b"edts": 0, b"dinf": 0, b"udta": 0, b"mvex": 0, b"moof": 0, b"traf": 0}
DEEPEST = 32


class Malformed(ValueError):
    """The bytes are no readable ISO media container."""


#: Fixed values of the format: flags of tfhd, trun and of a sample that is no keyframe.
BASE, INDEX, DURATION, SIZE, FLAGS, FROM_MOOF = 0x1, 0x2, 0x8, 0x10, 0x20, 0x20000
RUN_OFFSET, RUN_FIRST, RUN_DURATION, RUN_SIZE, RUN_FLAGS, RUN_SHIFT = 0x1, 0x4, 0x100, 0x200, 0x400, 0x800
NOT_SYNC = 0x10000


@dataclass
class Track:
    handler: str = ""
    codec: str = ""
    timescale: int = 0
    duration: int = 0
    number: int = 0
    tables: dict[bytes, tuple[int, int]] = field(default_factory=dict)
    #: (offset, size, start, duration, whether a keyframe) of the samples of fragments, an array a run
    runs: list[np.ndarray] = field(default_factory=list)
    ends: int = 0  # time at which the next fragment starts unless it says so


@dataclass
class Fragment:
    """What a moof or traf has said so far."""

    moof: int
    track: Track | None = None
    base: int = 0
    next: int = 0
    duration: int = 0
    size: int = 0
    flags: int = 0


# ---- reading


def boxes(data: memoryview, start: int, end: int) -> Iterator[tuple[bytes, int, int]]:
    """(type, start of the body, end) of each box between start and end."""
    while start < end:
        if end - start < 8:
            raise Malformed("a box header is cut off")
        size, kind = struct.unpack_from(">I4s", data, start)
        head = 8
        if size == 1:
            if end - start < 16:
                raise Malformed("a large box header is cut off")
            size, head = struct.unpack_from(">Q", data, start + 8)[0], 16
        elif size == 0:
            size = end - start
        if size < head or size > end - start:
            raise Malformed(f"box {kind!r} does not fit its parent")
        yield kind, start + head, start + size
        start += size


def _number(data: memoryview, form: str, at: int, end: int) -> int:
    if at + struct.calcsize(form) > end:
        raise Malformed("a field is cut off")
    return struct.unpack_from(form, data, at)[0]


def _array(data: memoryview, kind: str, at: int, count: int, end: int) -> np.ndarray:
    if count * np.dtype(kind).itemsize > end - at:
        raise Malformed("a table is cut off")
    return np.frombuffer(data, kind, count, at).astype(np.int64)


def _times(data: memoryview, a: int, b: int) -> tuple[int, int]:
    """(timescale, duration) of mvhd or mdhd."""
    if _number(data, ">B", a, b) == 1:
        return _number(data, ">I", a + 20, b), _number(data, ">Q", a + 24, b)
    return _number(data, ">I", a + 12, b), _number(data, ">I", a + 16, b)


def _track_number(data: memoryview, a: int, b: int) -> int:
    return _number(data, ">I", a + (20 if _number(data, ">B", a, b) == 1 else 12), b)


def _fragment_header(data: memoryview, a: int, b: int, found: dict, part: Fragment) -> None:
    """tfhd: whose samples follow, from where, and with which defaults."""
    flags, number = _number(data, ">I", a, b) & 0xFFFFFF, _number(data, ">I", a + 4, b)
    part.track = next((t for t in found["tracks"] if t.number == number), None)
    if part.track is None:
        raise Malformed("a fragment is of no track")
    at = a + 8
    part.duration, part.size, part.flags = found["defaults"].get(number, (0, 0, 0))
    if flags & BASE:
        part.base, at = _number(data, ">Q", at, b), at + 8
    elif flags & FROM_MOOF or not part.next:
        part.base = part.moof
    else:
        part.base = part.next
    at += 4 if flags & INDEX else 0
    for flag, name in ((DURATION, "duration"), (SIZE, "size"), (FLAGS, "flags")):
        if flags & flag:
            setattr(part, name, _number(data, ">I", at, b))
            at += 4
    part.next = part.base


def _run(data: memoryview, a: int, b: int, part: Fragment) -> None:
    """trun: the samples of one run."""
    if part.track is None:
        raise Malformed("a run without a track")
    flags, count = _number(data, ">I", a, b) & 0xFFFFFF, _number(data, ">I", a + 4, b)
    at, start, first = a + 8, part.next, None
    if flags & RUN_OFFSET:
        start, at = part.base + _number(data, ">i", at, b), at + 4
    if flags & RUN_FIRST:
        first, at = _number(data, ">I", at, b), at + 4
    fields = [f for f in (RUN_DURATION, RUN_SIZE, RUN_FLAGS, RUN_SHIFT) if flags & f]
    if not fields and count > len(data) or count * part.size > len(data) and RUN_SIZE not in fields:
        raise Malformed("samples exceed the file")
    given = dict(zip(fields, _array(data, ">u4", at, count * len(fields), b).reshape(count, -1).T if fields else []))
    durations = given.get(RUN_DURATION, np.full(count, part.duration, np.int64))
    sizes = given.get(RUN_SIZE, np.full(count, part.size, np.int64))
    marks = given.get(RUN_FLAGS, np.full(count, part.flags, np.int64)).copy()
    if first is not None and count:
        marks[0] = first
    offsets = start + np.cumsum(sizes) - sizes
    times = part.track.ends + np.cumsum(durations) - durations
    part.track.ends += int(durations.sum())
    part.next = start + int(sizes.sum())
    if count and (start < 0 or part.next > len(data)):
        raise Malformed("samples exceed the file")
    part.track.runs.append(np.stack([offsets, sizes, times, durations, (marks & NOT_SYNC) == 0]))


def _walk(data: memoryview, start: int, end: int, found: dict, depth: int = 0, part: Fragment | None = None) -> None:
    if depth > DEEPEST:
        raise Malformed("boxes are nested too deeply")
    for kind, a, b in boxes(data, start, end):
        if kind in NESTED:
            if kind == b"trak":
                found["tracks"].append(Track())
            inner = Fragment(a - (16 if _number(data, ">I", a - 8, b) != b - a + 8 else 8)) if kind == b"moof" else part
            _walk(data, a + NESTED[kind], b, found, depth + 1, inner)
        elif kind == b"ftyp":
            _number(data, ">I", a, b)
            found["brand"] = bytes(data[a : a + 4]).decode("latin-1")
        elif kind == b"mvhd":
            scale, duration = _times(data, a, b)
            found["seconds"] = duration / scale if scale else None
        elif kind == b"trex":
            found["defaults"][_number(data, ">I", a + 4, b)] = tuple(_number(data, ">I", a + at, b) for at in (12, 16, 20))
        elif part is not None:
            if kind == b"tfhd":
                _fragment_header(data, a, b, found, part)
            elif kind == b"tfdt" and part.track is not None:
                part.track.ends = _number(data, ">Q" if _number(data, ">B", a, b) == 1 else ">I", a + 4, b)
            elif kind == b"trun":
                _run(data, a, b, part)
        elif found["tracks"]:
            track = found["tracks"][-1]
            if kind == b"tkhd":
                track.number = _track_number(data, a, b)
            elif kind == b"mdhd":
                track.timescale, track.duration = _times(data, a, b)
            elif kind == b"hdlr":
                _number(data, ">I", a + 8, b)
                track.handler = bytes(data[a + 8 : a + 12]).decode("latin-1")
            elif kind in (b"stsd", b"stts", b"stsc", b"stsz", b"stz2", b"stco", b"co64", b"stss"):
                track.tables[kind] = (a, b)
                if kind == b"stsd" and _number(data, ">I", a + 4, b):
                    _number(data, ">Q", a + 8, b)
                    track.codec = bytes(data[a + 12 : a + 16]).decode("latin-1")


def parse(media: bytes) -> dict:
    """brand, seconds and tracks of a container."""
    found: dict = {"brand": None, "seconds": None, "tracks": [], "defaults": {}}
    _walk(memoryview(media), 0, len(media), found)
    if found["brand"] is None:
        raise Malformed("no ftyp box")
    return found


def _sizes(data: memoryview, track: Track) -> np.ndarray:
    """Bytes of each sample, from stsz or the compact stz2."""
    if b"stsz" in track.tables:
        a, b = track.tables[b"stsz"]
        fixed, count = _number(data, ">I", a + 4, b), _number(data, ">I", a + 8, b)
        if fixed and fixed * count > len(data):
            raise Malformed("samples exceed the file")
        return np.full(count, fixed, np.int64) if fixed else _array(data, ">u4", a + 12, count, b)
    if b"stz2" not in track.tables:
        return np.zeros(0, np.int64)
    a, b = track.tables[b"stz2"]
    bits, count = _number(data, ">B", a + 7, b), _number(data, ">I", a + 8, b)
    if bits == 4:
        pairs = _array(data, ">u1", a + 12, -(-count // 2), b)
        return np.stack([pairs >> 4, pairs & 15], axis=1).reshape(-1)[:count]
    if bits not in (8, 16):
        raise Malformed("a sample size has an unknown width")
    return _array(data, f">u{bits // 8}", a + 12, count, b)


def _durations(data: memoryview, track: Track, count: int) -> np.ndarray:
    """Duration of each sample, from stts."""
    if b"stts" not in track.tables:
        raise Malformed("a sample table is missing")
    a, b = track.tables[b"stts"]
    runs = _array(data, ">u4", a + 8, 2 * _number(data, ">I", a + 4, b), b).reshape(-1, 2)
    if int(runs[:, 0].sum()) != count:
        raise Malformed("samples and times do not agree")
    return np.repeat(runs[:, 1], runs[:, 0])


def samples(media: bytes, track: Track) -> tuple[np.ndarray, np.ndarray, np.ndarray, np.ndarray, np.ndarray]:
    """(offset, size, start, duration, whether a keyframe) of each sample, times in the track's scale.

    Those of the movie's tables come first, then those of its fragments, in the file's order. Times are media times:
    edit lists are not applied. Counts are checked against the bytes before anything is expanded.
    """
    data = memoryview(media)
    parts = [_table_samples(data, track), *track.runs]
    offsets, sizes, starts, durations, keys = np.concatenate(parts, axis=1)
    return offsets, sizes, starts, durations, keys.astype(bool)


def _table_samples(data: memoryview, track: Track) -> np.ndarray:
    sizes = _sizes(data, track)
    count = len(sizes)
    if not count:
        return np.zeros((5, 0), np.int64)
    wide = b"co64" in track.tables
    if not wide and b"stco" not in track.tables or b"stsc" not in track.tables:
        raise Malformed("a sample table is missing")
    a, b = track.tables[b"co64" if wide else b"stco"]
    chunks = _array(data, ">u8" if wide else ">u4", a + 8, _number(data, ">I", a + 4, b), b)
    a, b = track.tables[b"stsc"]
    runs = _array(data, ">u4", a + 8, 3 * _number(data, ">I", a + 4, b), b).reshape(-1, 3)
    first, each = runs[:, 0] - 1, runs[:, 1]
    lengths = np.diff(np.append(first, len(chunks)))
    if not len(runs) or first[0] != 0 or (lengths < 0).any() or int((lengths * each).sum()) != count:
        raise Malformed("samples and chunks do not agree")
    per_chunk = np.repeat(each, lengths)
    chunk = np.repeat(np.arange(len(chunks)), per_chunk)
    before = np.cumsum(sizes) - sizes
    chunk_start = np.cumsum(per_chunk) - per_chunk
    offsets = chunks[chunk] + before - before[np.minimum(chunk_start, count - 1)][chunk]
    if (offsets < 0).any() or int((offsets + sizes).max()) > len(data):
        raise Malformed("samples exceed the file")
    keys = np.ones(count, bool)
    if b"stss" in track.tables:
        a, b = track.tables[b"stss"]
        sync = _array(data, ">u4", a + 8, _number(data, ">I", a + 4, b), b) - 1
        if len(sync) and (sync.min() < 0 or sync.max() >= count):
            raise Malformed("a keyframe is no sample")
        keys[:] = False
        keys[sync] = True
    durations = _durations(data, track, count)
    return np.stack([offsets, sizes, np.cumsum(durations) - durations, durations, keys])


def read_samples(media: bytes, track: Track) -> bytes:
    """The track's samples, in order, as one string of bytes."""
    offsets, sizes, *_ = samples(media, track)
    if not len(offsets):
        return b""
    ends = offsets + sizes
    edge = np.flatnonzero(np.r_[True, offsets[1:] != ends[:-1]])
    return b"".join(media[s:e] for s, e in zip(offsets[edge].tolist(), ends[np.r_[edge[1:] - 1, len(ends) - 1]].tolist()))


# ---- writing


def _box(kind: bytes, *parts: bytes) -> bytes:
    body = b"".join(parts)
    return struct.pack(">I4s", 8 + len(body), kind) + body


def _full(kind: bytes, form: str, *values: object) -> bytes:
    """A box that starts with version and flags."""
    return _box(kind, struct.pack(">I" + form, 0, *values))


def wrap(payload: bytes) -> bytes:
    """A container with payload, whose length is a multiple of UNIT, as 8-bit mono PCM; each sample is UNIT bytes."""
    if not payload or len(payload) % UNIT:
        raise ValueError(f"the payload is a positive multiple of {UNIT} bytes")
    count = len(payload) // UNIT
    start = _box(b"ftyp", b"isom", struct.pack(">I", 512), b"isom", b"mp41")
    large = len(payload) + 16 > 0xFFFFFFFF
    head = struct.pack(">I4sQ", 1, b"mdat", 16 + len(payload)) if large else struct.pack(">I4s", 8 + len(payload), b"mdat")
    chunks = np.arange(-(-count // CHUNK), dtype=np.int64) * (CHUNK * UNIT) + len(start) + len(head)
    runs = [(1, CHUNK)] if count >= CHUNK else []
    runs += [(len(chunks), count % CHUNK)] if count % CHUNK else []
    matrix = struct.pack(">9I", 0x10000, 0, 0, 0, 0x10000, 0, 0, 0, 0x40000000)
    sync = np.arange(1, count + 1, GROUP, dtype=">u4")
    entry = _box(b"raw ", bytes(6), struct.pack(">HIIHHHHI", 1, 0, 0, 1, 8, 0, 0, RATE << 16))
    offsets = _box(b"co64", struct.pack(">II", 0, len(chunks)), chunks.astype(">u8").tobytes()) if large else _box(b"stco", struct.pack(">II", 0, len(chunks)), chunks.astype(">u4").tobytes())
    tables = _box(
        b"stbl",
        _box(b"stsd", struct.pack(">II", 0, 1), entry),
        _full(b"stts", "III", 1, count, UNIT),
        _box(b"stsc", struct.pack(">II", 0, len(runs)), b"".join(struct.pack(">III", at, n, 1) for at, n in runs)),
        _full(b"stsz", "II", UNIT, count),
        offsets,
        _box(b"stss", struct.pack(">II", 0, len(sync)), sync.tobytes()),
    )
    long = lambda *before: struct.pack(">I", 1 << 24) + struct.pack(">QQ", 0, 0) + b"".join(before) + struct.pack(">Q", len(payload))
    movie = _box(b"mvhd", long(struct.pack(">I", RATE)), struct.pack(">IH10x", 0x10000, 0x100), matrix, bytes(24), struct.pack(">I", 2))
    track = _box(b"tkhd", long(struct.pack(">II", 1, 0)), bytes(8), struct.pack(">HHHH", 0, 0, 0x100, 0), matrix, bytes(8))
    media = _box(
        b"mdia",
        _box(b"mdhd", long(struct.pack(">I", RATE)), struct.pack(">HH", 0x55C4, 0)),
        _box(b"hdlr", bytes(8), b"soun", bytes(12), b"\0"),
        _box(b"minf", _full(b"smhd", "HH", 0, 0), _box(b"dinf", _box(b"dref", struct.pack(">II", 0, 1), _box(b"url ", struct.pack(">I", 1)))), tables),
    )
    return b"".join((start, head, payload, _box(b"moov", movie, _box(b"trak", track, media))))


def padded(text: str | None) -> tuple[int, bytes]:
    """(bytes of the text, the text with zeros up to a positive multiple of UNIT)."""
    data = (text or "").encode("utf-8", "surrogatepass")
    return len(data), data + bytes((-len(data) % UNIT) or (0 if data else UNIT))


# ---- columns

DESCRIPTION = (
    "brand string, seconds double, tracks array<struct<handler: string, codec: string, timescale: long, duration: long, "
    "samples: long, bytes: long, keyframes: array<struct<offset: long, length: long, start: long, duration: long>>>>, error string"
)


def description(media: bytes | None) -> dict:
    if media is None:
        return {"brand": None, "seconds": None, "tracks": None, "error": "null"}
    try:
        found, tracks = parse(media), []
        for t in found["tracks"]:
            offsets, sizes, starts, durations, keys = samples(media, t)
            found_at = (x[keys].tolist() for x in (offsets, sizes, starts, durations))
            ranges = [{"offset": a, "length": n, "start": at, "duration": d} for a, n, at, d in zip(*found_at)]
            tracks.append({"handler": t.handler, "codec": t.codec, "timescale": t.timescale, "duration": t.duration or int((starts + durations).max(initial=0)), "samples": len(sizes), "bytes": int(sizes.sum()), "keyframes": ranges})
        return {"brand": found["brand"], "seconds": found["seconds"], "tracks": tracks, "error": None}
    except Malformed as e:
        return {"brand": None, "seconds": None, "tracks": None, "error": str(e)}


def describe(media: Column) -> Column:
    """A struct of brand, seconds, tracks and error; null values and bytes that are no container say so in error.

    A keyframe has offset and length in bytes, start and duration in the track's timescale. One row a row, repeated
    ones alike; a value of any length is read in place. A column like any other: names of the table cannot clash.
    """

    @F.pandas_udf(DESCRIPTION)
    def run(batches: Iterator[pd.Series]) -> Iterator[pd.DataFrame]:
        for batch in batches:
            yield pd.DataFrame([description(x) for x in batch], columns=["brand", "seconds", "tracks", "error"])

    return run(media)


def as_media(text: Column) -> Column:
    """The container of each text's padded UTF-8 bytes; null and empty texts are one sample of zeros.

    Equal texts give equal bytes. A text of over 4 GiB takes wide offsets.
    """

    @F.pandas_udf("binary")
    def run(batches: Iterator[pd.Series]) -> Iterator[pd.Series]:
        for batch in batches:
            yield pd.Series([wrap(padded(x)[1]) for x in batch], dtype=object)

    return run(text)


DIGEST = "n_bytes long, payload_bytes long, payload_sha256 string, tail_crc32 long, media_bytes long, media_sha256 string, feature string"


def digest(text: Column, media: Column) -> Column:
    """What the stored bytes hold, read back through the container's tables; n_bytes alone is of the text (null: 0)."""

    @F.pandas_udf(DIGEST)
    def run(batches: Iterator[tuple[pd.Series, pd.Series]]) -> Iterator[pd.DataFrame]:
        for texts, stored in batches:
            out = []
            for n_bytes, data in zip(texts, stored):
                found = parse(data)
                track = found["tracks"][0]
                payload = read_samples(data, track)
                offsets, sizes, starts, _, keys = samples(data, track)
                at = np.flatnonzero(keys)
                ranges = zlib.crc32(np.stack([offsets[at], sizes[at]]).astype("<i8").tobytes())
                feature = f"{found['brand']} {track.handler} {track.codec} {track.duration}/{track.timescale} samples={len(sizes)} keyframes={len(at)} last={offsets[at[-1]]}+{sizes[at[-1]]} ranges={ranges:08x}"
                out.append((n_bytes, len(payload), hashlib.sha256(payload).hexdigest(), zlib.crc32(payload[-UNIT:]), len(data), hashlib.sha256(data).hexdigest(), feature))
            yield pd.DataFrame(out, columns=[part.split()[0] for part in DIGEST.split(", ")])

    return run(F.coalesce(F.octet_length(text), F.lit(0)).cast("long"), media)


def op4_media_columns(spark: SparkSession, sf_dir: str) -> DataFrame:
    """One row per document: its text stored as a container, and what the container gives back."""
    docs = table(spark, sf_dir, "documents").select("doc_id", "text")
    stored = docs.withColumn("media", as_media(F.col("text")))
    return stored.select("doc_id", digest(F.col("text"), F.col("media")).alias("x")).select("doc_id", "x.*")


QUERIES = {"op4_media_columns": op4_media_columns}
ORACLES: dict[str, str] = {}
