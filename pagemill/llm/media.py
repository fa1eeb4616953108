"""Matroska columns: EBML elements, clusters, laced blocks and cues as packet tables.

``write`` stores 8-bit PCM in a Matroska file; ``parse`` reads any such file into a packet table
(track, timestamp, byte range, keyframe); ``packet_table`` applies ``parse`` to a binary column and
``store_text`` turns a text column into stored media with features read back from it.
"""

from __future__ import annotations

import hashlib
import zlib
from collections.abc import Iterator
from dataclasses import dataclass, field

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F
from pyspark.sql import types as T

from pagemill.llm.common import id_text, task

# Element ids of the Matroska and EBML specifications (RFC 8794, RFC 9559).
EBML, EBML_VERSION, EBML_READ_VERSION, EBML_MAX_ID, EBML_MAX_SIZE = 0x1A45DFA3, 0x4286, 0x42F7, 0x42F2, 0x42F3
DOC_TYPE, DOC_TYPE_VERSION, DOC_TYPE_READ_VERSION = 0x4282, 0x4287, 0x4285
SEGMENT, INFO, TIMESTAMP_SCALE, MUXING_APP, WRITING_APP, DURATION = 0x18538067, 0x1549A966, 0x2AD7B1, 0x4D80, 0x5741, 0x4489
TRACKS, TRACK_ENTRY, TRACK_NUMBER, TRACK_UID, TRACK_TYPE, FLAG_LACING, CODEC_ID = 0x1654AE6B, 0xAE, 0xD7, 0x73C5, 0x83, 0x9C, 0x86
DEFAULT_DURATION, AUDIO, SAMPLING_FREQUENCY, CHANNELS, BIT_DEPTH = 0x23E383, 0xE1, 0xB5, 0x9F, 0x6264
CLUSTER, CLUSTER_TIMESTAMP, SIMPLE_BLOCK, BLOCK_GROUP, BLOCK, BLOCK_DURATION, REFERENCE_BLOCK = 0x1F43B675, 0xE7, 0xA3, 0xA0, 0xA1, 0x9B, 0xFB
CUES, CUE_POINT, CUE_TIME, CUE_TRACK_POSITIONS, CUE_TRACK, CUE_CLUSTER_POSITION = 0x1C53BB6B, 0xBB, 0xB3, 0xB7, 0xF7, 0xF1

UNIT, RATE, FRAME, LACED, BLOCKS = 64, 8000, 512, 8, 12
NO_LACING, XIPH_LACING, FIXED_LACING, EBML_LACING = 0, 1, 2, 3
MASTERS = frozenset((SEGMENT, INFO, TRACKS, TRACK_ENTRY, AUDIO, CLUSTER, BLOCK_GROUP, CUES, CUE_POINT, CUE_TRACK_POSITIONS))


class MediaError(ValueError):
    """The bytes are not a Matroska file that this parser reads."""


# ---------------------------------------------------------------- writing


def size_vint(n: int, width: int = 0) -> bytes:
    """An EBML data size: the fewest bytes (or ``width``) whose value isn't the reserved all-ones."""
    width = width or next(w for w in range(1, 9) if n < (1 << 7 * w) - 1)
    return (n | 1 << 7 * width).to_bytes(width, "big")


def signed_vint(n: int) -> bytes:
    """The difference of two laced frame sizes: range-shifted so that zero is in the middle."""
    width = next(w for w in range(1, 9) if abs(n) < (1 << 7 * w - 1) - 1)
    return size_vint(n + (1 << 7 * width - 1) - 1, width)


def element(ident: int, body: bytes) -> bytes:
    return ident.to_bytes((ident.bit_length() + 7) // 8, "big") + size_vint(len(body)) + body


def unsigned(ident: int, n: int) -> bytes:
    return element(ident, n.to_bytes(max(1, (n.bit_length() + 7) // 8), "big"))


def double(ident: int, x: float) -> bytes:
    return element(ident, np.array(x, ">f8").tobytes())


def laced_block(track: int, relative: int, frames: list[bytes], lacing: int | None = None, simple: bool = True) -> bytes:
    """A SimpleBlock (or Block) with one frame or several laced; equal sizes take fixed lacing, others EBML lacing."""
    sizes = [len(x) for x in frames]
    if lacing is None:
        lacing = NO_LACING if len(frames) == 1 else FIXED_LACING if len(set(sizes)) == 1 else EBML_LACING
    head = b"" if lacing == NO_LACING else bytes((len(frames) - 1,))
    if lacing == XIPH_LACING:
        head += b"".join(b"\xff" * (n // 255) + bytes((n % 255,)) for n in sizes[:-1])
    elif lacing == EBML_LACING:
        head += size_vint(sizes[0]) + b"".join(signed_vint(b - a) for a, b in zip(sizes[:-2], sizes[1:-1], strict=True))
    flags = (0x80 if simple else 0) | lacing << 1
    body = size_vint(track) + relative.to_bytes(2, "big", signed=True) + bytes((flags,)) + head + b"".join(frames)
    return element(SIMPLE_BLOCK, body) if simple else element(BLOCK_GROUP, element(BLOCK, body))


_HEAD = element(EBML, unsigned(EBML_VERSION, 1) + unsigned(EBML_READ_VERSION, 1) + unsigned(EBML_MAX_ID, 4) + unsigned(EBML_MAX_SIZE, 8) + element(DOC_TYPE, b"matroska") + unsigned(DOC_TYPE_VERSION, 4) + unsigned(DOC_TYPE_READ_VERSION, 2))
_TRACKS = element(TRACKS, element(TRACK_ENTRY, unsigned(TRACK_NUMBER, 1) + unsigned(TRACK_UID, 1) + unsigned(TRACK_TYPE, 2) + unsigned(FLAG_LACING, 1) + element(CODEC_ID, b"A_PCM/INT/LIT") + unsigned(DEFAULT_DURATION, FRAME * 1_000_000_000 // RATE) + element(AUDIO, double(SAMPLING_FREQUENCY, RATE) + unsigned(CHANNELS, 1) + unsigned(BIT_DEPTH, 8))))


def write(payload: bytes) -> bytes:
    """``payload`` as one 8-bit PCM track at 8 kHz: frames of 512 samples, up to 8 laced a block, 12 blocks a cluster, one cue a cluster."""
    info = element(INFO, unsigned(TIMESTAMP_SCALE, 1_000_000) + double(DURATION, len(payload) * 1000 / RATE) + element(MUXING_APP, b"pagemill") + element(WRITING_APP, b"pagemill"))
    parts, cues = [info, _TRACKS], []
    at = len(info) + len(_TRACKS)
    ms = FRAME * 1000 // RATE
    per_block = FRAME * LACED
    for start in range(0, max(1, len(payload)), per_block * BLOCKS):
        time = start // FRAME * ms
        body = [unsigned(CLUSTER_TIMESTAMP, time)]
        for b in range(start, min(len(payload), start + per_block * BLOCKS), per_block):
            end = min(len(payload), b + per_block)
            body.append(laced_block(1, b // FRAME * ms - time, [payload[i : min(i + FRAME, end)] for i in range(b, end, FRAME)]))
        parts.append(c := element(CLUSTER, b"".join(body)))
        cues.append(element(CUE_POINT, unsigned(CUE_TIME, time) + element(CUE_TRACK_POSITIONS, unsigned(CUE_TRACK, 1) + unsigned(CUE_CLUSTER_POSITION, at))))
        at += len(c)
    parts.append(element(CUES, b"".join(cues)))
    return _HEAD + element(SEGMENT, b"".join(parts))


# ---------------------------------------------------------------- reading


def read_vint(data: bytes, at: int, keep_marker: bool = False) -> tuple[int, int, bool]:
    """The variable-length integer at ``at``: its value, the position behind it, and whether all its bits are ones (unknown size)."""
    if at >= len(data) or not data[at]:
        raise MediaError(f"no variable-length integer at byte {at}")
    width = 9 - data[at].bit_length()
    if at + width > len(data):
        raise MediaError(f"variable-length integer at byte {at} is cut off")
    raw = int.from_bytes(data[at : at + width], "big")
    value = raw & (1 << 7 * width) - 1
    return (raw if keep_marker else value), at + width, value == (1 << 7 * width) - 1


def children(data: bytes, at: int, end: int) -> Iterator[tuple[int, int, int]]:
    """(id, first byte, end) of each element in a byte range. An unknown size reaches to the end of the parent,
    or for a cluster to the next element that can't be inside one."""
    while at < end:
        ident, at, _ = read_vint(data, at, keep_marker=True)
        size, at, unknown = read_vint(data, at)
        if unknown:
            stop = end if ident != CLUSTER else _cluster_end(data, at, end)
        else:
            stop = at + size
        if stop > end:
            raise MediaError(f"element {ident:#x} passes its parent's end")
        yield ident, at, stop
        at = stop


def _cluster_end(data: bytes, at: int, end: int) -> int:
    while at < end:
        ident, body, _ = read_vint(data, at, keep_marker=True)
        if ident in (CLUSTER, CUES, INFO, TRACKS, SEGMENT):
            return at
        size, body, _ = read_vint(data, body)
        at = body + size
    return end


def frame_sizes(data: bytes, at: int, end: int, lacing: int) -> tuple[list[int], int]:
    """Sizes of the frames of a block whose lace header (if any) is at ``at``, and where the first begins."""
    if lacing == NO_LACING:
        return [end - at], at
    if at >= end:
        raise MediaError("a laced block has no frame count")
    n, at = data[at] + 1, at + 1
    if lacing == FIXED_LACING:
        if (end - at) % n:
            raise MediaError("fixed lacing doesn't divide the block")
        return [(end - at) // n] * n, at
    sizes: list[int] = []
    for k in range(n - 1):
        if lacing == XIPH_LACING:
            size = 0
            while True:
                if at >= end:
                    raise MediaError("a Xiph lace is cut off")
                size, at = size + data[at], at + 1
                if data[at - 1] < 255:
                    break
        else:
            start = at
            size, at, _ = read_vint(data, at)
            if k:
                size += sizes[-1] - ((1 << 7 * (at - start) - 1) - 1)
        sizes.append(size)
    last = end - at - sum(sizes)
    if last < 0 or min(sizes, default=0) < 0:
        raise MediaError("laced frames pass the block's end")
    return [*sizes, last], at


@dataclass
class Media:
    """What ``parse`` finds: a list for each packet column, tracks by number, clusters' byte ranges, cues."""

    track: list[int] = field(default_factory=list)
    timestamp_ns: list[int] = field(default_factory=list)
    start: list[int] = field(default_factory=list)
    size: list[int] = field(default_factory=list)
    keyframe: list[bool] = field(default_factory=list)
    lacing: list[int] = field(default_factory=list)
    cluster: list[int] = field(default_factory=list)
    tracks: dict[int, dict] = field(default_factory=dict)
    clusters: list[tuple[int, int]] = field(default_factory=list)
    cues: list[tuple[int, int, int]] = field(default_factory=list)
    doc_type: str = ""
    scale: int = 1_000_000


def _uint(data: bytes, at: int, end: int) -> int:
    return int.from_bytes(data[at:end], "big")


def _block(out: Media, data: bytes, at: int, end: int, base: int, key: bool | None) -> None:
    track, at, _ = read_vint(data, at)
    if at + 3 > end:
        raise MediaError("a block's header is cut off")
    relative, flags = int.from_bytes(data[at : at + 2], "big", signed=True), data[at + 2]
    lacing = flags >> 1 & 3
    sizes, at = frame_sizes(data, at + 3, end, lacing)
    step = out.tracks.get(track, {}).get("default_duration_ns", 0)
    time = (base + relative) * out.scale
    for k, n in enumerate(sizes):
        out.track.append(track)
        out.timestamp_ns.append(time + k * step)
        out.start.append(at)
        out.size.append(n)
        out.keyframe.append(bool(flags & 0x80) if key is None else key)
        out.lacing.append(lacing)
        out.cluster.append(len(out.clusters) - 1)
        at += n


def parse(data: bytes) -> Media:
    """The packet table of a Matroska file; raises MediaError where the bytes break the format."""
    out, segment = Media(), None
    for ident, at, end in children(data, 0, len(data)):
        if ident == EBML:
            out.doc_type = next((data[a:e].rstrip(b"\0").decode() for i, a, e in children(data, at, end) if i == DOC_TYPE), "matroska")
        elif ident == SEGMENT:
            segment = (at, end)
            break
    if segment is None or not out.doc_type:
        raise MediaError("no EBML header with a segment behind it")
    for ident, at, end in children(data, *segment):
        if ident == INFO:
            out.scale = next((_uint(data, a, e) for i, a, e in children(data, at, end) if i == TIMESTAMP_SCALE), out.scale)
        elif ident == TRACKS:
            for i, a, e in children(data, at, end):
                if i == TRACK_ENTRY:
                    _track(out, data, a, e)
        elif ident == CLUSTER:
            out.clusters.append((at, end))
            base = 0
            for i, a, e in children(data, at, end):
                if i == CLUSTER_TIMESTAMP:
                    base = _uint(data, a, e)
                elif i == SIMPLE_BLOCK:
                    _block(out, data, a, e, base, None)
                elif i == BLOCK_GROUP:
                    inner = list(children(data, a, e))
                    key = not any(x[0] == REFERENCE_BLOCK for x in inner)
                    for j, b, f in inner:
                        if j == BLOCK:
                            _block(out, data, b, f, base, key)
        elif ident == CUES:
            for i, a, e in children(data, at, end):
                if i != CUE_POINT:
                    continue
                time, places = 0, []
                for j, b, f in children(data, a, e):
                    if j == CUE_TIME:
                        time = _uint(data, b, f)
                    elif j == CUE_TRACK_POSITIONS:
                        places.append({k: _uint(data, c, g) for k, c, g in children(data, b, f)})
                out.cues += [(time * out.scale, p.get(CUE_TRACK, 0), segment[0] + p.get(CUE_CLUSTER_POSITION, 0)) for p in places]
    return out


def _track(out: Media, data: bytes, at: int, end: int) -> None:
    entry: dict = {}
    for i, a, e in children(data, at, end):
        if i == CODEC_ID:
            entry["codec"] = data[a:e].decode()
        elif i == AUDIO:
            for j, b, f in children(data, a, e):
                if j == SAMPLING_FREQUENCY:
                    entry["rate"] = float(np.frombuffer(data[b:f], ">f8" if f - b == 8 else ">f4")[0])
                else:
                    entry[{CHANNELS: "channels", BIT_DEPTH: "bits"}.get(j, f"{j:x}")] = _uint(data, b, f)
        else:
            entry[{TRACK_NUMBER: "number", TRACK_TYPE: "type", DEFAULT_DURATION: "default_duration_ns"}.get(i, f"{i:x}")] = _uint(data, a, e)
    out.tracks[entry.get("number", 0)] = entry


def samples(data: bytes, media: Media, track: int = 1) -> bytes:
    """The frames of one track, joined in file order."""
    return b"".join(data[s : s + n] for t, s, n in zip(media.track, media.start, media.size, strict=True) if t == track)


# ---------------------------------------------------------------- columns


def features(data: bytes, media: Media, payload: bytes) -> str:
    """Whole numbers only, so equal media give equal strings on any machine."""
    x = np.frombuffer(payload, np.uint8).astype(np.int64)
    centred = x >= 128
    crossings = int(np.count_nonzero(centred[1:] != centred[:-1]))
    return f"packets={len(media.size)};clusters={len(media.clusters)};cues={len(media.cues)};duration_ms={len(payload) * 1000 // RATE};sum={int(x.sum())};energy={int((x * x).sum())};min={int(x.min())};max={int(x.max())};crossings={crossings}"


def pad(raw: bytes, unit: int = UNIT) -> bytes:
    """``raw`` and zero bytes up to a positive multiple of ``unit``."""
    return raw + b"\0" * (max(unit, -(-len(raw) // unit) * unit) - len(raw))


STORED = T.StructType([T.StructField("doc_id", T.LongType()), T.StructField("n_bytes", T.LongType()), T.StructField("payload_bytes", T.LongType()), T.StructField("payload_sha256", T.StringType()), T.StructField("tail_crc32", T.LongType()), T.StructField("media_bytes", T.LongType()), T.StructField("media_sha256", T.StringType()), T.StructField("feature", T.StringType()), T.StructField("media", T.BinaryType())])


@task("media")
def _store(batches: Iterator[pa.RecordBatch], keep: bool) -> Iterator[pa.RecordBatch]:
    names = [f.name for f in STORED if keep or f.name != "media"]
    kinds = {"doc_id": pa.int64(), "n_bytes": pa.int64(), "payload_bytes": pa.int64(), "tail_crc32": pa.int64(), "media_bytes": pa.int64(), "media": pa.binary()}
    for batch in batches:
        out: dict[str, list] = {n: [] for n in names}
        for k in range(batch.num_rows):
            text = batch.column(1)[k].as_py()
            raw = b"" if text is None else text.encode("utf-8")
            media = write(pad(raw))
            table = parse(media)
            payload = samples(media, table)
            row = (batch.column(0)[k].as_py(), len(raw), len(payload), hashlib.sha256(payload).hexdigest(), zlib.crc32(payload[-UNIT:]), len(media), hashlib.sha256(media).hexdigest(), features(media, table, payload), media)
            for n, v in zip(names, row, strict=False):
                out[n].append(v)
        yield pa.record_batch([pa.array(out[n], kinds.get(n, pa.string())) for n in names], names=names)


def store_text(df: DataFrame, id_col: str = "doc_id", text_col: str = "text", keep_media: bool = True) -> DataFrame:
    """Each text's UTF-8 bytes, zero-padded to 64, as a Matroska file, with what its parsed packets give back.

    A null or empty text is 64 zero bytes with n_bytes 0; repeated rows and ids give repeated rows; a null
    id stays null; an empty table gives no rows; other columns are ignored. Narrow: no shuffle, one row at a
    time, so memory follows the longest text.
    """
    schema = STORED if keep_media else T.StructType([f for f in STORED if f.name != "media"])
    return id_text(df, id_col, text_col).mapInArrow(lambda it: _store(it, keep_media), schema)


PACKETS = "id long, ordinal int, track int, timestamp_ns long, start long, size long, keyframe boolean, lacing int, cluster int, is_cue boolean, error string"


@task("media")
def _packets(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    names = ("id", "ordinal", "track", "timestamp_ns", "start", "size", "keyframe", "lacing", "cluster", "is_cue", "error")
    kinds = (pa.int64(), pa.int32(), pa.int32(), pa.int64(), pa.int64(), pa.int64(), pa.bool_(), pa.int32(), pa.int32(), pa.bool_(), pa.string())
    for batch in batches:
        for k in range(batch.num_rows):
            ident, data = batch.column(0)[k].as_py(), batch.column(1)[k].as_py()
            if data is None:
                continue
            try:
                m = parse(data)
                cued = {p for _, _, p in m.cues}
                heads = {c for c, (a, _) in enumerate(m.clusters) if any(p < a <= p + 12 for p in cued)}
                first = {c: m.cluster.index(c) for c in heads if c in m.cluster}
                n = len(m.size)
                cols = [[ident] * n, list(range(n)), m.track, m.timestamp_ns, m.start, m.size, m.keyframe, m.lacing, m.cluster, [first.get(c) == i for i, c in enumerate(m.cluster)], [None] * n]
            except (MediaError, UnicodeDecodeError, IndexError) as e:
                cols = [[ident], *[[None]] * 9, [str(e)]]
            yield pa.record_batch([pa.array(c, t) for c, t in zip(cols, kinds, strict=True)], names=list(names))


def packet_table(df: DataFrame, id_col: str = "doc_id", media_col: str = "media") -> DataFrame:
    """One row per packet of each Matroska file in a binary column; a file that breaks the format gives one row with ``error``.

    Null media give no rows; ``is_cue`` marks the first packet of a cluster that a cue points at.
    """
    return df.select(F.col(id_col).alias("id"), F.col(media_col).alias("text")).mapInArrow(_packets, PACKETS)
