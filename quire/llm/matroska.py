"""Matroska media columns: packet tables read from the bytes of files, and a writer for 8-bit PCM tracks.

The reader walks variable-length EBML elements without decoding samples: clusters of known or unknown size, blocks and
simple blocks, the four kinds of lacing, and cues. A packet is a track, a time, and a byte range of the file.
(Format: published EBML and Matroska specifications, RFC 8794 and RFC 9559.)
"""

from __future__ import annotations

import struct
import zlib
from collections.abc import Iterator
from dataclasses import dataclass, field

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame

from .common import raw, sha256, slices, texts

# Fixed values of the format: element ids.
EBML, EBML_VERSION, EBML_READ_VERSION, EBML_MAX_ID, EBML_MAX_SIZE = 0x1A45DFA3, 0x4286, 0x42F7, 0x42F2, 0x42F3
DOC_TYPE, DOC_TYPE_VERSION, DOC_TYPE_READ_VERSION = 0x4282, 0x4287, 0x4285
SEGMENT, SEEK_HEAD, INFO, TRACKS, CLUSTER, CUES = 0x18538067, 0x114D9B74, 0x1549A966, 0x1654AE6B, 0x1F43B675, 0x1C53BB6B
CHAPTERS, TAGS, ATTACHMENTS = 0x1043A770, 0x1254C367, 0x1941A469
TIMESTAMP_SCALE, DURATION, MUXING_APP, WRITING_APP = 0x2AD7B1, 0x4489, 0x4D80, 0x5741
TRACK_ENTRY, TRACK_NUMBER, TRACK_UID, TRACK_TYPE, CODEC_ID, FLAG_LACING, DEFAULT_DURATION = 0xAE, 0xD7, 0x73C5, 0x83, 0x86, 0x9C, 0x23E383
AUDIO, SAMPLING, CHANNELS, BIT_DEPTH = 0xE1, 0xB5, 0x9F, 0x6264
CLUSTER_TIMESTAMP, SIMPLE_BLOCK, BLOCK_GROUP, BLOCK, BLOCK_DURATION = 0xE7, 0xA3, 0xA0, 0xA1, 0x9B
CUE_POINT, CUE_TIME, CUE_TRACK_POSITIONS, CUE_TRACK, CUE_CLUSTER_POSITION = 0xBB, 0xB3, 0xB7, 0xF7, 0xF1
#: What can stand directly in a segment: such an element ends a cluster of unknown size.
TOP = {SEEK_HEAD, INFO, TRACKS, CLUSTER, CUES, CHAPTERS, TAGS, ATTACHMENTS}
NO_LACING, XIPH, FIXED, EBML_LACING = 0, 1, 2, 3
LACINGS = ("none", "xiph", "fixed", "ebml")


@dataclass
class Track:
    number: int = 0
    kind: int = 0
    codec: str = ""
    default_duration_ns: int = 0
    sampling_hz: float = 0.0
    channels: int = 1
    bits: int = 0


@dataclass
class Media:
    """complete: whether every element ended inside the data. Packets: (track, cluster, timestamp_ns, offset, size,
    lacing, keyframe), where offset and size are the packet's byte range in the file. Cues: (time_ns, track, offset of
    the cluster in the file)."""

    doc_type: str = ""
    scale_ns: int = 1_000_000
    duration: float = 0.0
    complete: bool = True
    clusters: int = 0
    tracks: dict[int, Track] = field(default_factory=dict)
    packets: list[tuple] = field(default_factory=list)
    cues: list[tuple] = field(default_factory=list)


def vint(data: bytes, at: int, end: int, keep_marker: bool = False) -> tuple[int, int]:
    """(value, bytes). A size of all ones is -1: unknown."""
    if at >= end or not data[at]:
        raise ValueError("no variable-length integer here")
    n = 9 - data[at].bit_length()
    if at + n > end:
        raise ValueError("a variable-length integer is cut off")
    value = int.from_bytes(data[at : at + n], "big")
    if keep_marker:
        return value, n
    value -= 1 << 7 * n
    return (-1 if value == (1 << 7 * n) - 1 else value), n


def elements(data: bytes, at: int, end: int, media: Media) -> Iterator[tuple[int, int, int, bool]]:
    """(id, start of content, end of content, whether the size is known) of the elements between at and end."""
    while at < end:
        try:
            name, n = vint(data, at, min(end, at + 4), keep_marker=True)
            size, m = vint(data, at + n, end)
        except ValueError:
            media.complete = False
            return
        start = at + n + m
        stop = end if size < 0 else start + size
        if stop > end:
            media.complete, stop = False, end
        yield name, start, stop, size >= 0
        at = stop


def number(data: bytes, start: int, stop: int) -> int:
    return int.from_bytes(data[start:stop], "big")


def real(data: bytes, start: int, stop: int) -> float:
    return struct.unpack(">d" if stop - start == 8 else ">f", data[start:stop])[0] if stop - start in (4, 8) else 0.0


def frames(data: bytes, at: int, end: int, lacing: int) -> list[tuple[int, int]]:
    """Byte ranges (offset, size) of a block's frames, whose lacing header begins at at."""
    if lacing == NO_LACING:
        return [(at, end - at)]
    if at >= end:
        raise ValueError("a laced block is cut off")
    count = data[at] + 1
    at += 1
    if lacing == FIXED:
        size, odd = divmod(end - at, count)
        if odd:
            raise ValueError("frames of fixed lacing don't fill their block")
        return [(at + i * size, size) for i in range(count)]
    sizes = []
    for i in range(count - 1):
        if lacing == XIPH:
            size = 0
            while True:
                if at >= end:
                    raise ValueError("a frame size is cut off")
                size += data[at]
                at += 1
                if data[at - 1] != 255:
                    break
        else:
            value, n = vint(data, at, end, keep_marker=True)
            value -= 1 << 7 * n
            size = value if i == 0 else sizes[-1] + value - ((1 << 7 * n - 1) - 1)
            at += n
        sizes.append(size)
    sizes.append(end - at - sum(sizes))
    if min(sizes) < 0:
        raise ValueError("frame sizes don't fit their block")
    out = []
    for size in sizes:
        out.append((at, size))
        at += size
    return out


def _block(data: bytes, start: int, stop: int, clock: int, simple: bool, media: Media) -> None:
    try:
        track, n = vint(data, start, stop)
        at = start + n + 3
        if at > stop:
            raise ValueError("a block's head is cut off")
        relative, flags = struct.unpack_from(">hB", data, start + n)
        lacing = (flags >> 1) & 3
        step = media.tracks[track].default_duration_ns if track in media.tracks else 0
        time = (clock + relative) * media.scale_ns
        for i, (offset, size) in enumerate(frames(data, at, stop, lacing)):
            media.packets.append((track, media.clusters - 1, time + i * step, offset, size, lacing, bool(flags & 0x80) if simple else True))
    except ValueError:
        media.complete = False


def _cluster(data: bytes, start: int, stop: int, known: bool, media: Media) -> int:
    """Where the cluster ends."""
    media.clusters += 1
    clock, at = 0, start
    for name, a, b, _ in elements(data, start, stop, media):
        if name in TOP and not known:
            return at
        if name == CLUSTER_TIMESTAMP:
            clock = number(data, a, b)
        elif name == SIMPLE_BLOCK:
            _block(data, a, b, clock, True, media)
        elif name == BLOCK_GROUP:
            for inner, c, d, _ in elements(data, a, b, media):
                if inner == BLOCK:
                    _block(data, c, d, clock, False, media)
        at = b
    return stop


def _track(data: bytes, start: int, stop: int, media: Media) -> Track:
    t = Track()
    for name, a, b, _ in elements(data, start, stop, media):
        if name == TRACK_NUMBER:
            t.number = number(data, a, b)
        elif name == TRACK_TYPE:
            t.kind = number(data, a, b)
        elif name == CODEC_ID:
            t.codec = data[a:b].rstrip(b"\0").decode("ascii", "replace")
        elif name == DEFAULT_DURATION:
            t.default_duration_ns = number(data, a, b)
        elif name == AUDIO:
            for inner, c, d, _ in elements(data, a, b, media):
                if inner == SAMPLING:
                    t.sampling_hz = real(data, c, d)
                elif inner == CHANNELS:
                    t.channels = number(data, c, d)
                elif inner == BIT_DEPTH:
                    t.bits = number(data, c, d)
    return t


def _cue(data: bytes, start: int, stop: int, origin: int, media: Media) -> None:
    time, places = 0, []
    for name, a, b, _ in elements(data, start, stop, media):
        if name == CUE_TIME:
            time = number(data, a, b)
        elif name == CUE_TRACK_POSITIONS:
            at = {n: number(data, c, d) for n, c, d, _ in elements(data, a, b, media)}
            places.append((at.get(CUE_TRACK, 0), at.get(CUE_CLUSTER_POSITION, 0)))
    media.cues += [(time * media.scale_ns, track, origin + place) for track, place in places]


def parse(data: bytes | None) -> Media:
    """What a file holds. Data that is no Matroska file, null or empty gives an empty, incomplete result; a file that
    is cut off gives what stands before the cut, and is incomplete."""
    media = Media()
    data = data or b""
    if not data:
        media.complete = False
    at, end = 0, len(data)
    while at < end:
        head = next(elements(data, at, end, media), None)
        if head is None:
            break
        name, start, stop, known = head
        at = stop
        if name == EBML:
            for inner, a, b, _ in elements(data, start, stop, media):
                if inner == DOC_TYPE:
                    media.doc_type = data[a:b].rstrip(b"\0").decode("ascii", "replace")
        elif name == SEGMENT:
            inside = start
            while inside < stop:
                found = next(elements(data, inside, stop, media), None)
                if found is None:
                    break
                inner, a, b, sized = found
                inside = b
                if inner == INFO:
                    for x, c, d, _ in elements(data, a, b, media):
                        if x == TIMESTAMP_SCALE:
                            media.scale_ns = number(data, c, d)
                        elif x == DURATION:
                            media.duration = real(data, c, d)
                elif inner == TRACKS:
                    for x, c, d, _ in elements(data, a, b, media):
                        if x == TRACK_ENTRY:
                            t = _track(data, c, d, media)
                            media.tracks[t.number] = t
                elif inner == CLUSTER:
                    inside = _cluster(data, a, b, sized, media)
                elif inner == CUES:
                    for x, c, d, _ in elements(data, a, b, media):
                        if x == CUE_POINT:
                            _cue(data, c, d, start, media)
    if media.doc_type not in ("matroska", "webm"):
        media.complete = False
    return media


def payload(data: bytes, media: Media, track: int) -> bytes:
    """A track's packets joined."""
    return b"".join([data[p[3] : p[3] + p[4]] for p in media.packets if p[0] == track])


# Writing


def size_bytes(n: int, width: int = 0) -> bytes:
    """n as a variable-length integer, of as few bytes as can be, or so many."""
    width = width or max(1, (n.bit_length() + 6) // 7)
    if n == (1 << 7 * width) - 1:
        width += 1  # all ones means unknown
    return ((1 << 7 * width) + n).to_bytes(width, "big")


def element(name: int, content: bytes) -> bytes:
    return name.to_bytes((name.bit_length() + 7) // 8, "big") + size_bytes(len(content)) + content


def uint(name: int, n: int) -> bytes:
    return element(name, n.to_bytes(max(1, (n.bit_length() + 7) // 8), "big"))


def lace(parts: list[bytes], lacing: int) -> bytes:
    """A block's content behind its head."""
    if lacing == NO_LACING:
        return parts[0]
    head = bytearray([len(parts) - 1])
    if lacing == XIPH:
        for p in parts[:-1]:
            head += b"\xff" * (len(p) // 255) + bytes([len(p) % 255])
    elif lacing == EBML_LACING:
        for i, p in enumerate(parts[:-1]):
            if i == 0:
                head += size_bytes(len(p))
                continue
            change = len(p) - len(parts[i - 1])
            width = 1
            while not -(1 << 7 * width - 1) + 1 <= change <= (1 << 7 * width - 1) - 1:
                width += 1
            head += ((1 << 7 * width) + change + (1 << 7 * width - 1) - 1).to_bytes(width, "big")
    return bytes(head) + b"".join(parts)


#: Samples of 8 bits a second; a timestamp unit is one sample.
RATE = 8000
#: Bytes of samples in a cluster: timestamps inside one are signed 16-bit numbers.
CLUSTER_BYTES = 16_384
#: Frame sizes of the blocks, in turn: one frame alone, then frames of equal, rising and mixed sizes.
PATTERN = ((NO_LACING, (512,)), (FIXED, (256, 256, 256, 256)), (EBML_LACING, (128, 192, 320, 192, 512)), (XIPH, (64, 320, 256, 704)))


def write_pcm(samples: bytes) -> bytes:
    """A Matroska file whose only track holds the bytes as unsigned 8-bit samples, in laced blocks, clusters and cues."""
    head = element(EBML, uint(EBML_VERSION, 1) + uint(EBML_READ_VERSION, 1) + uint(EBML_MAX_ID, 4) + uint(EBML_MAX_SIZE, 8) + element(DOC_TYPE, b"matroska") + uint(DOC_TYPE_VERSION, 4) + uint(DOC_TYPE_READ_VERSION, 2))
    info = element(INFO, uint(TIMESTAMP_SCALE, 1_000_000_000 // RATE) + element(DURATION, struct.pack(">d", float(len(samples)))) + element(MUXING_APP, b"quire") + element(WRITING_APP, b"quire"))
    audio = element(AUDIO, element(SAMPLING, struct.pack(">d", float(RATE))) + uint(CHANNELS, 1) + uint(BIT_DEPTH, 8))
    tracks = element(TRACKS, element(TRACK_ENTRY, uint(TRACK_NUMBER, 1) + uint(TRACK_UID, 1) + uint(TRACK_TYPE, 2) + uint(FLAG_LACING, 1) + element(CODEC_ID, b"A_PCM/INT/LIT") + audio))
    content, cues = [info, tracks], []
    place = len(info) + len(tracks)
    for start in range(0, len(samples), CLUSTER_BYTES):
        stop = min(start + CLUSTER_BYTES, len(samples))
        blocks, at, turn = [uint(CLUSTER_TIMESTAMP, start)], start, 0
        while at < stop:
            lacing, sizes = PATTERN[turn % len(PATTERN)]
            if at + sum(sizes) > stop:
                lacing, sizes = NO_LACING, (min(512, stop - at),)
            parts, first = [], at
            for n in sizes:
                parts.append(samples[at : at + n])
                at += n
            body = b"\x81" + struct.pack(">h", first - start)
            if turn % 5 == 4:
                blocks.append(element(BLOCK_GROUP, element(BLOCK, body + bytes([lacing << 1]) + lace(parts, lacing)) + uint(BLOCK_DURATION, at - first)))
            else:
                blocks.append(element(SIMPLE_BLOCK, body + bytes([0x80 | lacing << 1]) + lace(parts, lacing)))
            turn += 1
        cluster = element(CLUSTER, b"".join(blocks))
        cues.append(element(CUE_POINT, uint(CUE_TIME, start) + element(CUE_TRACK_POSITIONS, uint(CUE_TRACK, 1) + uint(CUE_CLUSTER_POSITION, place))))
        content.append(cluster)
        place += len(cluster)
    content.append(element(CUES, b"".join(cues)))
    return head + element(SEGMENT, b"".join(content))


def padded(data: bytes, unit: int = 64) -> bytes:
    """data with zero bytes behind it, up to a positive multiple of unit."""
    return data + b"\0" * (max(unit, -(-len(data) // unit) * unit) - len(data))


def feature(media: Media, samples: bytes) -> str:
    """What the packet table and the samples tell."""
    t = next(iter(media.tracks.values()), Track())
    laced = [sum(p[5] == k for p in media.packets) for k in range(4)]
    s = np.frombuffer(samples, np.uint8)
    crossings = int(np.count_nonzero(np.diff(s >= 128)))
    return f"{t.codec} {t.sampling_hz:.0f} Hz {t.bits} bit; clusters {media.clusters}; packets {len(media.packets)}; cues {len(media.cues)}; by lacing {','.join(map(str, laced))}; sum {int(s.sum(dtype=np.int64))}; crossings {crossings}"


# Spark

PACKETS = "track long, cluster long, timestamp_ns long, offset long, size long, lacing string, keyframe boolean"


def packet_table(files: DataFrame, id_col: str = "doc_id", content_col: str = "content") -> DataFrame:
    """A row for each packet of each file: id and PACKETS. Null, empty and foreign contents have none; a file that is
    cut off has those before the cut; null ids and repeated rows are kept as they come; other columns are ignored."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in slices(batches, 16):
            for i, data in enumerate(batch.column(1)):
                rows = parse(data.as_py()).packets
                if rows:
                    columns = list(zip(*rows, strict=True))
                    ids = pa.array([batch.column(0)[i].as_py()] * len(rows), pa.int64())
                    yield pa.RecordBatch.from_arrays([ids, *(pa.array(c, pa.int64()) for c in columns[:5]), pa.array([LACINGS[x] for x in columns[5]]), pa.array(columns[6])], ["id", "track", "cluster", "timestamp_ns", "offset", "size", "lacing", "keyframe"])

    rows = files.select(files[id_col].cast("long").alias("id"), files[content_col].alias("content"))
    return rows.mapInArrow(run, f"id long, {PACKETS}").withColumnRenamed("id", id_col)


def cue_table(files: DataFrame, id_col: str = "doc_id", content_col: str = "content") -> DataFrame:
    """A row for each cue: id, time_ns, track, offset. Cases as in packet_table."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in slices(batches, 16):
            for i, data in enumerate(batch.column(1)):
                rows = parse(data.as_py()).cues
                if rows:
                    ids = pa.array([batch.column(0)[i].as_py()] * len(rows), pa.int64())
                    yield pa.RecordBatch.from_arrays([ids, *(pa.array(c, pa.int64()) for c in zip(*rows, strict=True))], ["id", "time_ns", "track", "offset"])

    rows = files.select(files[id_col].cast("long").alias("id"), files[content_col].alias("content"))
    return rows.mapInArrow(run, "id long, time_ns long, track long, offset long").withColumnRenamed("id", id_col)


def stored(docs: DataFrame, id_col: str = "doc_id", text_col: str = "text") -> DataFrame:
    """(id, content): each text's padded bytes as the samples of a Matroska file. Null texts are empty."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in slices(batches):
            for i, t in enumerate(texts(batch.column(1))):
                yield pa.RecordBatch.from_arrays([batch.column(0).slice(i, 1), pa.array([write_pcm(padded(raw(t)))], pa.binary())], ["id", "content"])

    rows = docs.select(docs[id_col].cast("long").alias("id"), docs[text_col].alias("text"))
    return rows.mapInArrow(run, "id long, content binary").withColumnRenamed("id", id_col)


ROUND_TRIP = "n_bytes long, payload_bytes long, payload_sha256 string, tail_crc32 long, media_bytes long, media_sha256 string, feature string"


def media_round_trip(docs: DataFrame, id_col: str = "doc_id", text_col: str = "text") -> DataFrame:
    """id and ROUND_TRIP: stores each text's padded bytes as a file, parses the file, reads the samples back through its
    packet table, and keeps digests. Null texts are empty; null ids and repeated rows are kept as they come; other
    columns are ignored whatever their names; an empty table gives no rows."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in slices(batches):
            rows = []
            for t in texts(batch.column(1)):
                data = raw(t)
                file = write_pcm(padded(data))
                media = parse(file)
                back = payload(file, media, 1)
                rows.append((len(data), len(back), sha256(back), zlib.crc32(back[-64:]), len(file), sha256(file), feature(media, back)))
            if rows:
                c = list(zip(*rows, strict=True))
                yield pa.RecordBatch.from_arrays([batch.column(0), pa.array(c[0], pa.int64()), pa.array(c[1], pa.int64()), pa.array(c[2]), pa.array(c[3], pa.int64()), pa.array(c[4], pa.int64()), pa.array(c[5]), pa.array(c[6])], ["id", "n_bytes", "payload_bytes", "payload_sha256", "tail_crc32", "media_bytes", "media_sha256", "feature"])

    rows = docs.select(docs[id_col].cast("long").alias("id"), docs[text_col].alias("text"))
    return rows.mapInArrow(run, f"id long, {ROUND_TRIP}").withColumnRenamed("id", id_col)


def op9_matroska(spark, sf_dir: str) -> DataFrame:
    from .common import table

    return media_round_trip(table(spark, sf_dir, "documents"))
