import hashlib
import zlib
from collections import Counter

import pytest
from hypothesis import given, settings
from hypothesis import strategies as st

from pagemill.llm import media as M


@given(st.integers(0, (1 << 56) - 2))
def test_sizes_round_trip(n):
    raw = M.size_vint(n)
    assert M.read_vint(raw, 0) == (n, len(raw), False)


@given(st.lists(st.binary(min_size=1, max_size=700), min_size=1, max_size=9), st.sampled_from([M.XIPH_LACING, M.EBML_LACING]), st.booleans())
@settings(max_examples=200, deadline=None)
def test_laced_frames_round_trip(frames, lacing, simple):
    cluster = M.element(M.CLUSTER, M.unsigned(M.CLUSTER_TIMESTAMP, 40) + M.laced_block(1, -8, frames, lacing if len(frames) > 1 else None, simple))
    data = M._HEAD + M.element(M.SEGMENT, M._TRACKS + cluster)
    m = M.parse(data)
    assert [data[a : a + n] for a, n in zip(m.start, m.size, strict=True)] == frames
    assert m.timestamp_ns == [32_000_000 + k * 64_000_000 for k in range(len(frames))]


def test_fixed_lacing_and_unknown_sizes():
    frames = [b"abc", b"def", b"ghi"]
    body = M.unsigned(M.CLUSTER_TIMESTAMP, 0) + M.laced_block(1, 0, frames)
    unknown = b"\x01" + b"\xff" * 7
    cluster = M.CLUSTER.to_bytes(4, "big") + unknown + body
    data = M._HEAD + M.SEGMENT.to_bytes(4, "big") + unknown + M._TRACKS + cluster + M.element(M.CLUSTER, body)
    m = M.parse(data)
    assert len(m.clusters) == 2 and m.cluster == [0, 0, 0, 1, 1, 1] and set(m.lacing) == {M.FIXED_LACING}
    assert M.samples(data, m) == b"abcdefghi" * 2


#: A file written by hand, byte by byte, from the format's description; not by this package's writer.
FOREIGN = bytes.fromhex(
    "1A45DFA3 9F  42868101 42F78101 42F28104 42F38108 4282 84 7765626D 42878104 42858102"  # header, document type webm
    "18538067 01FFFFFFFFFFFFFF"  # segment of unknown size
    "1549A966 87  2AD7B1 83 0F4240"  # a millisecond a tick
    "1654AE6B 9B  AE 99  D78107 73C58109 838102 86 8D 415F50434D2F494E542F4C4954"  # track 7, A_PCM/INT/LIT
    "1F43B675 B0  E78164"  # cluster at 100 ms
    "A3 89  87 0005 80 68656C6C6F"  # +5 ms, key frame, no lacing: hello
    "A0 95  A1 90 87 FFFE 06 02 83 C0 616263 64656667 6869  FB81FE"  # -2 ms, EBML lacing of 3, 3 + 1 and what is left; refers to another
    "A3 89  87 000A 02 01 02 7879 7A"  # +10 ms, Xiph lacing of 2 and what is left
    "1C53BB6B 8D  BB 8B  B38164 B7 86 F78107 F1812C"  # a cue to the cluster, 44 bytes into the segment
)


def test_a_foreign_file():
    m = M.parse(FOREIGN)
    assert m.doc_type == "webm" and m.scale == 1_000_000 and list(m.tracks) == [7]
    assert [FOREIGN[a : a + n] for a, n in zip(m.start, m.size, strict=True)] == [b"hello", b"abc", b"defg", b"hi", b"xy", b"z"]
    assert m.timestamp_ns == [105_000_000, 98_000_000, 98_000_000, 98_000_000, 110_000_000, 110_000_000]
    assert m.keyframe == [True, False, False, False, False, False] and m.lacing == [0, 3, 3, 3, 1, 1] and set(m.track) == {7}
    cluster = FOREIGN.index(bytes.fromhex("1F43B675"))
    assert m.clusters == [(cluster + 5, cluster + 53)] and m.cues == [(100_000_000, 7, cluster)]


def test_a_foreign_file_as_packets(spark):
    rows = M.packet_table(spark.createDataFrame([(1, bytearray(FOREIGN))], "doc_id long, media binary")).orderBy("start").collect()
    assert [(r.track, r.timestamp_ns, r.size) for r in rows] == [(7, 105_000_000, 5), (7, 98_000_000, 3), (7, 98_000_000, 4), (7, 98_000_000, 2), (7, 110_000_000, 2), (7, 110_000_000, 1)]


@given(st.binary(max_size=120_000))
@settings(max_examples=30, deadline=None)
def test_payload_round_trip(raw):
    data = M.write(M.pad(raw))
    m = M.parse(data)
    assert M.samples(data, m) == M.pad(raw) and len(M.pad(raw)) % 64 == 0
    for time, track, at in m.cues:
        ident, body, _ = M.read_vint(data, at, keep_marker=True)
        assert ident == M.CLUSTER and track == 1
        size, body, _ = M.read_vint(data, body)
        assert (body, body + size) in m.clusters and time % 64_000_000 == 0


@pytest.mark.parametrize("data", [b"", b"RIFF....", M._HEAD, M.write(b"\0" * 64)[:-20], b"\x00" * 10])
def test_broken_files_raise(data):
    with pytest.raises(M.MediaError):
        M.parse(data)


def test_columns(docs, rows, spark):
    stored = M.store_text(docs)
    got = Counter(tuple(r)[:7] for r in stored.collect())
    want = Counter()
    for i, t in rows:
        raw = (t or "").encode()
        payload = M.pad(raw)
        data = M.write(payload)
        want[i, len(raw), len(payload), hashlib.sha256(payload).hexdigest(), zlib.crc32(payload[-64:]), len(data), hashlib.sha256(data).hexdigest()] += 1
    assert got == want
    packets = M.packet_table(stored.selectExpr("doc_id", "media", "1 AS track"))
    assert packets.where("error IS NOT NULL").count() == 0
    sizes = {r.id: r.n for r in packets.groupBy("id").agg({"size": "sum"}).withColumnRenamed("sum(size)", "n").collect()}
    assert sizes[9001] == 64
    odd = spark.createDataFrame([(1, None), (2, b"junk")], "doc_id long, media binary")
    assert [(r.id, r.error is not None) for r in M.packet_table(odd).collect()] == [(2, True)]


def test_empty_table(empty):
    assert M.store_text(empty).count() == 0
