import hashlib
import struct
import zlib

import pytest
from hypothesis import given, settings
from hypothesis import strategies as st
from pyspark.sql import functions as F

from tabularium.llm import media


@settings(max_examples=60, deadline=None)
@given(st.integers(1, 300), st.integers(0, 2**32))
def test_round_trip(units, seed):
    payload = (hashlib.sha256(str(seed).encode()).digest() * 2 * units)[: 64 * units]
    stored = media.wrap(payload)
    track = media.parse(stored)["tracks"][0]
    assert media.read_samples(stored, track) == payload
    said = media.description(stored)["tracks"][0]
    assert (said["samples"], said["bytes"], said["codec"], said["duration"]) == (units, 64 * units, "raw ", 64 * units)
    assert [stored[k["offset"] : k["offset"] + k["length"]] for k in said["keyframes"]] == [payload[i : i + 64] for i in range(0, 64 * units, 64 * media.GROUP)]


def box(kind, *parts):
    body = b"".join(parts)
    return struct.pack(">I4s", 8 + len(body), kind) + body


def full(kind, flags, *values, version=0):
    return box(kind, struct.pack(f">I{len(values)}I", version << 24 | flags, *values))


def movie(*stbl, mvex=b"", number=3):
    tables = box(b"stbl", box(b"stsd", struct.pack(">II", 0, 1), box(b"avc1", bytes(8))), *stbl)
    mdia = box(b"mdia", full(b"mdhd", 0, 0, 0, 1000, 0, 0), box(b"hdlr", bytes(8), b"vide", bytes(12)), box(b"minf", tables))
    return box(b"moov", full(b"mvhd", 0, 0, 0, 1000, 5000), box(b"trak", full(b"tkhd", 0, 0, 0, number, 0, 0), mdia), mvex)


def test_compact_sizes_and_times():
    start = box(b"ftyp", b"isom", bytes(4))
    for bits, packed, sizes in ((4, bytes([0x53, 0x70]), [5, 3, 7]), (8, bytes([5, 3, 7]), [5, 3, 7]), (16, struct.pack(">3H", 5, 300, 7), [5, 300, 7])):
        payload = bytes(range(256)) * 2
        stored = start + box(b"mdat", payload)
        at = len(start) + 8
        stored += movie(
            full(b"stts", 0, 2, 2, 40, 1, 25), full(b"stsc", 0, 1, 1, 3, 1), box(b"stz2", struct.pack(">III", 0, bits, 3), packed), full(b"stco", 0, 1, at), full(b"stss", 0, 2, 1, 3)
        )
        said = media.description(stored)
        assert said["error"] is None
        (track,) = said["tracks"]
        assert (track["samples"], track["bytes"], track["codec"], track["duration"]) == (3, sum(sizes), "avc1", 105)
        assert track["keyframes"] == [{"offset": at, "length": sizes[0], "start": 0, "duration": 40}, {"offset": at + sizes[0] + sizes[1], "length": sizes[2], "start": 80, "duration": 25}]
    wrong = start + movie(full(b"stts", 0, 1, 2, 40), full(b"stsc", 0, 1, 1, 3, 1), full(b"stsz", 0, 1, 3), full(b"stco", 0, 1, 0))
    assert "times" in media.description(wrong)["error"]


def test_fragments():
    start = box(b"ftyp", b"isom", bytes(4)) + movie(full(b"stts", 0, 0), full(b"stsc", 0, 0), full(b"stsz", 0, 0, 0), full(b"stco", 0, 0), mvex=box(b"mvex", full(b"trex", 0, 3, 1, 40, 6, 0x10000)))
    head = lambda offset: box(b"moof", full(b"mfhd", 0, 1), box(b"traf", full(b"tfhd", 0x20000, 3), full(b"tfdt", 0, 1000), full(b"trun", 0x205, 3, offset, 0, 10, 20, 30)))
    one = head(len(head(0)) + 8) + box(b"mdat", bytes(60))
    later = lambda offset: box(b"moof", box(b"traf", full(b"tfhd", 0x20020, 3, 0), full(b"trun", 0x1, 2, offset)))
    two = later(len(later(0)) + 8) + box(b"mdat", bytes(12))
    said = media.description(start + one + two)
    assert said["error"] is None
    (track,) = said["tracks"]
    at, then = len(start) + len(one) - 60, len(start) + len(one) + len(two) - 12
    assert (track["samples"], track["bytes"]) == (5, 72)
    assert track["keyframes"] == [
        {"offset": at, "length": 10, "start": 1000, "duration": 40}, {"offset": then, "length": 6, "start": 1120, "duration": 40}, {"offset": then + 6, "length": 6, "start": 1160, "duration": 40}
    ]
    assert "exceed" in media.description(start + head(1 << 20))["error"]
    assert "no track" in media.description(start + box(b"moof", box(b"traf", full(b"tfhd", 0, 9))))["error"]


@settings(max_examples=300, deadline=None)
@given(st.lists(st.tuples(st.integers(0, 1200), st.integers(0, 255)), max_size=6), st.integers(0, 1300))
def test_broken_containers_say_so(changes, cut):
    stored = bytearray(media.wrap(bytes(640)))
    for at, value in changes:
        stored[at % len(stored)] = value
    media.description(bytes(stored[:cut]))


def test_columns(odd, empty):
    out = odd.select("doc_id", "text", media.as_media(F.col("text")).alias("m")).select("doc_id", media.digest(F.col("text"), F.col("m")).alias("x"), media.describe(F.col("m")).alias("d"), "text").collect()
    assert len(out) == odd.count()
    for r in out:
        data = (r["text"] or "").encode()
        padded = data + bytes(-len(data) % 64 or (0 if data else 64))
        assert (r["x"]["n_bytes"], r["x"]["payload_bytes"], r["x"]["payload_sha256"], r["x"]["tail_crc32"]) == (len(data), len(padded), hashlib.sha256(padded).hexdigest(), zlib.crc32(padded[-64:]))
        assert r["d"]["error"] is None and r["d"]["tracks"][0]["bytes"] == len(padded)
    assert empty.select(media.as_media(F.col("text"))).count() == 0


def test_null_and_foreign_media(spark):
    df = spark.createDataFrame([(None,), (b"",), (b"not media at all",)], "m binary")
    assert all(r["d"]["error"] for r in df.select(media.describe(F.col("m")).alias("d")).collect())


def test_query_digests(spark, sf, documents):
    """Every column of the query, from containers written here box by box."""
    texts = {r["doc_id"]: r["text"] for r in documents.collect()}
    out = media.QUERIES["op4_media_columns"](spark, sf).collect()
    assert len(out) == len(texts)
    for r in out:
        data = (texts[r["doc_id"]] or "").encode()
        payload = data + bytes(-len(data) % 64 or (0 if data else 64))
        stored = media.wrap(payload)
        assert (r["media_bytes"], r["media_sha256"]) == (len(stored), hashlib.sha256(stored).hexdigest())
        assert (r["n_bytes"], r["payload_bytes"], r["payload_sha256"], r["tail_crc32"]) == (len(data), len(payload), hashlib.sha256(payload).hexdigest(), zlib.crc32(payload[-64:]))
        count, first = len(payload) // 64, stored.index(b"mdat") + 4
        keys = list(range(0, count, media.GROUP))
        ranges = zlib.crc32(struct.pack(f"<{2 * len(keys)}q", *[first + 64 * k for k in keys], *[64] * len(keys)))
        assert r["feature"] == f"isom soun raw  {len(payload)}/8000 samples={count} keyframes={len(keys)} last={first + 64 * keys[-1]}+64 ranges={ranges:08x}"


def test_clashing_names_and_repeated_rows(spark):
    stored = media.wrap(b"x" * 64)
    df = spark.createDataFrame([(stored, "a", 1), (stored, "a", 1)], "media binary, brand string, tracks long")
    out = df.withColumn("d", media.describe(F.col("media"))).collect()
    assert len(out) == 2 and out[0] == out[1] and out[0]["brand"] == "a" and out[0]["d"]["brand"] == "isom"


def test_wrong_payload():
    with pytest.raises(ValueError):
        media.wrap(b"abc")
