import hashlib
import random
import zlib

import pytest

from quire.llm import matroska as m


@pytest.mark.parametrize("n", [64, 512, 1024, 16_384, 16_448, 100_032])
def test_samples_come_back(n):
    data = random.Random(n).randbytes(n)
    file = m.write_pcm(data)
    media = m.parse(file)
    assert media.complete and media.doc_type == "matroska" and m.payload(file, media, 1) == data
    assert len(media.cues) == media.clusters == -(-n // m.CLUSTER_BYTES)
    assert all(file[o : o + 4] == m.CLUSTER.to_bytes(4, "big") for _, _, o in media.cues)
    if n > 8192:
        assert {p[5] for p in media.packets} == {0, 1, 2, 3}


@pytest.mark.parametrize("lacing", [m.XIPH, m.EBML_LACING, m.FIXED])
def test_laces(lacing):
    rnd = random.Random(lacing)
    for _ in range(200):
        parts = [bytes(rnd.choice([0, 3, 254, 255, 256, 700, 20_000]) if lacing != m.FIXED else 40) for _ in range(rnd.randint(1, 9))]
        data = m.lace(parts, lacing)
        assert [n for _, n in m.frames(data, 0, len(data), lacing)] == [len(p) for p in parts]


def test_integers():
    for n in (0, 1, 126, 127, 128, 16_382, 16_383, 16_384, 1 << 40):
        data = m.size_bytes(n)
        assert m.vint(data, 0, len(data)) == (n, len(data))
    assert m.vint(b"\x01" + b"\xff" * 7, 0, 8) == (-1, 8)


def test_unknown_sizes_void_and_second_track():
    head = m.element(m.EBML, m.element(m.DOC_TYPE, b"webm"))
    unknown = b"\x01" + b"\xff" * 7
    block = lambda track, rel, data: m.element(m.SIMPLE_BLOCK, bytes([0x80 | track]) + rel.to_bytes(2, "big", signed=True) + b"\x80" + data)
    cluster = lambda t, *b: m.CLUSTER.to_bytes(4, "big") + unknown + m.uint(m.CLUSTER_TIMESTAMP, t) + b"".join(b)
    file = head + m.SEGMENT.to_bytes(4, "big") + unknown + m.element(0xEC, bytes(9)) + cluster(10, block(1, -2, b"ab"), block(2, 0, b"")) + cluster(20, block(1, 1, b"c"))
    media = m.parse(file)
    assert media.complete and media.clusters == 2
    assert [(p[0], p[1], p[2], p[4]) for p in media.packets] == [(1, 0, 8_000_000, 2), (2, 0, 10_000_000, 0), (1, 1, 21_000_000, 1)]
    assert m.payload(file, media, 1) == b"abc"


def test_broken_files():
    file = m.write_pcm(random.Random(1).randbytes(40_000))
    whole = m.parse(file).packets
    for cut in (0, 1, 5, 60, 300, 20_000, len(file) - 1):
        part = m.parse(file[:cut])
        assert not part.complete and len(part.packets) <= len(whole)
    rnd = random.Random(2)
    for _ in range(300):
        bad = bytearray(file[:3000])
        for _ in range(5):
            bad[rnd.randrange(len(bad))] = rnd.randrange(256)
        m.parse(bytes(bad))
    assert not m.parse(None).complete and not m.parse(b"RIFF1234").complete


def test_on_spark(spark):
    rows = [(1, "héllo", "f"), (2, "", None), (None, None, ""), (3, "x" * 50_000, "f"), (3, "x" * 50_000, "f"), (4, "a" * 64, "f")]
    df = spark.createDataFrame(rows, "doc_id long, text string, feature string")
    got = sorted(m.media_round_trip(df).collect(), key=str)
    for r in got:
        pay = m.padded(next((t or "") for i, t, _ in rows if i == r.doc_id).encode())
        assert (r.payload_bytes, r.payload_sha256, r.tail_crc32) == (len(pay), hashlib.sha256(pay).hexdigest(), zlib.crc32(pay[-64:]))
    assert len({(r.media_sha256, r.feature) for r in got if r.doc_id in (2, None)}) == 1 and len(got) == len(rows)
    files = m.stored(df)
    table = m.packet_table(files)
    assert table.where("doc_id = 3").agg({"size": "sum"}).first()[0] == 2 * 50_048
    assert m.cue_table(files).count() == 4 + 4 * 2 and m.packet_table(files.limit(0)).count() == 0
