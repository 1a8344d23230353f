"""Matroska files in a column: written from samples, parsed into packet tables.

Elements have an ID and a size, both of variable length (EBML).  A segment holds
Info, Tracks, Clusters of SimpleBlocks and Cues.  A block carries one frame or,
by Xiph, EBML or fixed-size lacing, several.  parse() gives a packet for each
frame: track, timestamp, byte range in the file, cluster, lacing.
"""

from __future__ import annotations

import hashlib
import struct
import zlib
from collections.abc import Iterator
from dataclasses import dataclass, field

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from .runtime import prepare
from .wordbuf import pieces

# Element IDs of the Matroska specification (fixed values)
EBML, DOC_TYPE, DOC_TYPE_VERSION, DOC_TYPE_READ_VERSION = 0x1A45DFA3, 0x4282, 0x4287, 0x4285
EBML_VERSION, EBML_READ_VERSION, EBML_MAX_ID, EBML_MAX_SIZE = 0x4286, 0x42F7, 0x42F2, 0x42F3
SEGMENT, INFO, TIMESTAMP_SCALE, MUXING_APP, WRITING_APP = 0x18538067, 0x1549A966, 0x2AD7B1, 0x4D80, 0x5741
TRACKS, TRACK_ENTRY, TRACK_NUMBER, TRACK_UID, TRACK_TYPE, CODEC_ID, DEFAULT_DURATION = 0x1654AE6B, 0xAE, 0xD7, 0x73C5, 0x83, 0x86, 0x23E383
AUDIO, SAMPLING_FREQUENCY, CHANNELS, BIT_DEPTH = 0xE1, 0xB5, 0x9F, 0x6264
CLUSTER, TIMESTAMP, SIMPLE_BLOCK, BLOCK_GROUP, BLOCK = 0x1F43B675, 0xE7, 0xA3, 0xA0, 0xA1
CUES, CUE_POINT, CUE_TIME, CUE_TRACK_POSITIONS, CUE_TRACK, CUE_CLUSTER_POSITION, CUE_RELATIVE_POSITION = 0x1C53BB6B, 0xBB, 0xB3, 0xB7, 0xF7, 0xF1, 0xF0
MASTERS = frozenset({EBML, SEGMENT, INFO, TRACKS, TRACK_ENTRY, AUDIO, CLUSTER, BLOCK_GROUP, CUES, CUE_POINT, CUE_TRACK_POSITIONS})
NO_LACING, XIPH, FIXED, EBML_LACING = 0, 1, 2, 3

RATE, FRAME, LACED, BLOCKS = 8000, 512, 8, 32
SCALE = 1_000_000
FRAME_MS = FRAME * 1000 // RATE


def size_bytes(n: int) -> bytes:
    """A size as a variable-length integer; all ones is kept for unknown sizes."""
    length = 1
    while n >= (1 << 7 * length) - 1:
        length += 1
    return (n | 1 << 7 * length).to_bytes(length, "big")


def element(ident: int, body: bytes) -> bytes:
    return ident.to_bytes((ident.bit_length() + 7) // 8, "big") + size_bytes(len(body)) + body


def unsigned(ident: int, n: int) -> bytes:
    return element(ident, n.to_bytes(max(1, (n.bit_length() + 7) // 8), "big"))


def vint(data: bytes, at: int, marker: bool = False) -> tuple[int, int]:
    """A variable-length integer and the place after it; -1 for an unknown size.  marker: keep the length bit (IDs)."""
    first = data[at]
    length = 9 - first.bit_length()
    if length > 8 or at + length > len(data):
        raise ValueError(f"bad variable-length integer at {at}")
    value = int.from_bytes(data[at : at + length], "big")
    if not marker:
        value &= (1 << 7 * length) - 1
        if value == (1 << 7 * length) - 1:
            value = -1
    return value, at + length


def lace(frames: list[bytes], kind: int) -> bytes:
    """A block's body after its header flags: number of frames, sizes, frames."""
    if kind == NO_LACING:
        return frames[0]
    head = bytes([len(frames) - 1])
    sizes = [len(f) for f in frames]
    if kind == XIPH:
        head += b"".join(b"\xff" * (n // 255) + bytes([n % 255]) for n in sizes[:-1])
    elif kind == EBML_LACING:
        head += size_bytes(sizes[0])
        for a, b in zip(sizes, sizes[1:-1], strict=False):
            length = 1
            while not -(1 << 7 * length - 1) < b - a < 1 << 7 * length - 1:
                length += 1
            head += (b - a + (1 << 7 * length - 1) - 1 | 1 << 7 * length).to_bytes(length, "big")
    return head + b"".join(frames)


def unlace(data: bytes, at: int, end: int, kind: int) -> list[tuple[int, int]]:
    """(place, size) of the frames of a block's body."""
    if kind == NO_LACING:
        return [(at, end - at)]
    count, at = data[at] + 1, at + 1
    sizes: list[int] = []
    if kind == XIPH:
        for _ in range(count - 1):
            n = 0
            while data[at] == 255:
                n, at = n + 255, at + 1
            sizes.append(n + data[at])
            at += 1
    elif kind == EBML_LACING:
        for k in range(count - 1):
            before = at
            value, at = vint(data, at)
            sizes.append(value if not k else sizes[-1] + value - ((1 << 7 * (at - before) - 1) - 1))
    else:
        sizes = [(end - at) // count] * (count - 1)
    sizes.append(end - at - sum(sizes))
    if min(sizes) < 0:
        raise ValueError(f"bad lacing before {at}")
    places, frames = at, []
    for n in sizes:
        frames.append((places, n))
        places += n
    return frames


_HEAD = element(EBML, unsigned(EBML_VERSION, 1) + unsigned(EBML_READ_VERSION, 1) + unsigned(EBML_MAX_ID, 4) + unsigned(EBML_MAX_SIZE, 8) + element(DOC_TYPE, b"matroska") + unsigned(DOC_TYPE_VERSION, 4) + unsigned(DOC_TYPE_READ_VERSION, 2))
_LEAD = element(INFO, unsigned(TIMESTAMP_SCALE, SCALE) + element(MUXING_APP, b"scopeframe") + element(WRITING_APP, b"scopeframe")) + element(
    TRACKS,
    element(TRACK_ENTRY, unsigned(TRACK_NUMBER, 1) + unsigned(TRACK_UID, 1) + unsigned(TRACK_TYPE, 2) + element(CODEC_ID, b"A_PCM/INT/LIT") + unsigned(DEFAULT_DURATION, FRAME_MS * SCALE) + element(AUDIO, element(SAMPLING_FREQUENCY, struct.pack(">d", RATE)) + unsigned(CHANNELS, 1) + unsigned(BIT_DEPTH, 8))),
)


def write(payload: bytes) -> bytes:
    """A file with one track of 8-bit samples.  Full blocks use fixed-size lacing, the last one Xiph or EBML lacing by turns."""
    frames = [payload[i : i + FRAME] for i in range(0, len(payload), FRAME)]
    body, at, cues = [_LEAD], len(_LEAD), []
    per = LACED * BLOCKS
    for c in range(0, len(frames), per):
        head = unsigned(TIMESTAMP, c * FRAME_MS)
        blocks = []
        for k in range(c, min(c + per, len(frames)), LACED):
            some = frames[k : min(k + LACED, c + per)]
            kind = NO_LACING if len(some) == 1 else FIXED if len(some[-1]) == FRAME else XIPH if len(frames) % 2 else EBML_LACING
            blocks.append(element(SIMPLE_BLOCK, b"\x81" + struct.pack(">hB", (k - c) * FRAME_MS, 0x80 | kind << 1) + lace(some, kind)))
        made = element(CLUSTER, head + b"".join(blocks))
        cues.append(element(CUE_POINT, unsigned(CUE_TIME, c * FRAME_MS) + element(CUE_TRACK_POSITIONS, unsigned(CUE_TRACK, 1) + unsigned(CUE_CLUSTER_POSITION, at) + unsigned(CUE_RELATIVE_POSITION, len(head)))))
        body.append(made)
        at += len(made)
    body.append(element(CUES, b"".join(cues)))
    return _HEAD + element(SEGMENT, b"".join(body))


@dataclass
class Media:
    doc_type: str = ""
    scale: int = SCALE
    tracks: list[dict] = field(default_factory=list)
    #: (track, timestamp in ns, place, size, cluster, lacing)
    packets: list[tuple[int, int, int, int, int, int]] = field(default_factory=list)
    #: (time in ns, track, cluster's place in the file)
    cues: list[tuple[int, int, int]] = field(default_factory=list)
    clusters: list[int] = field(default_factory=list)


_TRACK_FIELDS = {TRACK_NUMBER: "number", TRACK_TYPE: "type", DEFAULT_DURATION: "duration", CHANNELS: "channels", BIT_DEPTH: "bits"}


#: Masters inside one another; files of this format need six.
MOST_DEPTH = 32


def parse(data: bytes | None) -> Media:
    """Raises ValueError for data that is no whole file of this kind, whatever it holds; unknown elements are passed over."""
    out = Media()
    try:
        _parse(bytes(data or b""), out)
    except (IndexError, struct.error, UnicodeDecodeError, OverflowError) as e:
        raise ValueError(f"bad element: {e}") from e
    return out


def _parse(data: bytes, out: Media) -> None:
    if not data or vint(data, 0, marker=True)[0] != EBML:
        raise ValueError("no EBML header")
    segment = time = at = 0
    #: open masters: (end, element)
    open_ = [(len(data), 0)]
    while open_:
        end, parent = open_[-1]
        if at >= end:
            open_.pop()
            continue
        begin = at
        ident, at = vint(data, at, marker=True)
        size, at = vint(data, at)
        if size < 0 and ident not in (SEGMENT, CLUSTER):
            raise ValueError(f"unknown size at {begin}")
        stop = end if size < 0 else at + size
        if stop > end:
            raise ValueError(f"element at {begin} is cut off")
        if parent == CLUSTER and ident in (CLUSTER, CUES, INFO, TRACKS):
            open_.pop()  # ends a cluster of unknown size
            at = begin
            continue
        if ident in MASTERS:
            if len(open_) > MOST_DEPTH:
                raise ValueError(f"elements nested too deep at {begin}")
            if ident == SEGMENT:
                segment = at
            elif ident == CLUSTER:
                out.clusters.append(begin)
                time = 0
            elif ident == TRACK_ENTRY:
                out.tracks.append({})
            elif ident == CUE_POINT:
                out.cues.append((0, 0, 0))
            open_.append((stop, ident))
            continue
        if ident in (SIMPLE_BLOCK, BLOCK):
            track, body = vint(data, at)
            shift, flags = struct.unpack_from(">hB", data, body)
            kind = flags >> 1 & 3
            duration = next((t.get("duration", 0) for t in out.tracks if t.get("number") == track), 0)
            for k, (place, n) in enumerate(unlace(data, body + 3, stop, kind)):
                out.packets.append((track, (time + shift) * out.scale + k * duration, place, n, len(out.clusters) - 1, kind))
        elif ident == TIMESTAMP:
            time = int.from_bytes(data[at:stop], "big")
        elif ident == TIMESTAMP_SCALE:
            out.scale = int.from_bytes(data[at:stop], "big")
        elif ident == DOC_TYPE:
            out.doc_type = data[at:stop].decode()
        elif ident == CODEC_ID:
            out.tracks[-1]["codec"] = data[at:stop].decode()
        elif ident == SAMPLING_FREQUENCY:
            out.tracks[-1]["rate"] = struct.unpack(">d" if size == 8 else ">f", data[at:stop])[0]
        elif ident in _TRACK_FIELDS:
            out.tracks[-1][_TRACK_FIELDS[ident]] = int.from_bytes(data[at:stop], "big")
        elif parent in (CUE_POINT, CUE_TRACK_POSITIONS):
            value, (t, track, place) = int.from_bytes(data[at:stop], "big"), out.cues[-1]
            out.cues[-1] = (value * out.scale if ident == CUE_TIME else t, value if ident == CUE_TRACK else track, value + segment if ident == CUE_CLUSTER_POSITION else place)
        at = stop
    if not segment:
        raise ValueError("no segment")


def padded(text: bytes | None) -> bytes:
    """The text and zero bytes up to a positive multiple of 64."""
    text = text or b""
    return text + bytes(max(64, -(-len(text) // 64) * 64) - len(text))


def samples(data: bytes, media: Media, track: int = 1) -> bytes:
    return b"".join([data[place : place + n] for t, _, place, n, *_ in media.packets if t == track])


def feature(payload: bytes, media: Media) -> str:
    """packets:clusters:duration in ms:mean:root mean square:share of sign changes, of the samples as offset binary."""
    x = np.frombuffer(payload, np.uint8).astype(np.int32) - 128
    if not len(x):
        return f"{len(media.packets)}:{len(media.clusters)}:0:::"
    ms = len(x) * 1000 // RATE
    n = len(x)
    changes = int(np.count_nonzero((x[1:] < 0) != (x[:-1] < 0)))
    return f"{len(media.packets)}:{len(media.clusters)}:{ms}:{int(x.sum()) / n:.4f}:{(int((x * x).sum()) / n) ** 0.5:.4f}:{changes / n:.4f}"


def encode(docs: DataFrame, id_col: str = "doc_id", text_col: str = "text") -> DataFrame:
    """(id, n_bytes, media): each row's text, padded, as a Matroska file.  Null texts are empty."""
    prepare(docs.sparkSession)
    kind = docs.schema[id_col].dataType.simpleString()

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch, texts in pieces(batches, "_text"):
            yield pa.RecordBatch.from_arrays([batch.column(0), pa.array([len(t or b"") for t in texts], pa.int64()), pa.array([write(padded(t)) for t in texts], pa.binary())], names=[id_col, "n_bytes", "media"])

    return docs.select(F.col(id_col), F.col(text_col).alias("_text")).mapInArrow(run, f"{id_col} {kind}, n_bytes long, media binary")


PACKETS = "array<struct<track:int,timestamp_ns:long,place:long,size:int,cluster:int,lacing:int>>"


def packets(media: DataFrame, media_col: str = "media") -> DataFrame:
    """A row a packet beside the other columns; a file that can't be parsed gives one row with an error and no packet."""
    prepare(media.sparkSession)

    @F.udf(f"struct<packets:{PACKETS},error:string>", useArrow=True)
    def table(data):
        try:
            return [tuple(p) for p in parse(data).packets], None
        except ValueError as e:
            return [], str(e)

    others = [c for c in media.columns if c != media_col]
    return media.withColumn("_p", table(media_col)).select(*others, F.explode_outer("_p.packets").alias("_q"), F.col("_p.error").alias("error")).select(*others, "_q.*", "error")


#: Cue tables: where each cluster lies.
CUES_TYPE = "array<struct<time_ns:long,track:int,place:long>>"


def cues(media: DataFrame, media_col: str = "media") -> DataFrame:
    """A row a cue (time_ns, track, place of its cluster) beside the other columns; as packets for files without or with errors."""
    prepare(media.sparkSession)

    @F.udf(f"struct<cues:{CUES_TYPE},error:string>", useArrow=True)
    def table(data):
        try:
            return [tuple(c) for c in parse(data).cues], None
        except ValueError as e:
            return [], str(e)

    others = [c for c in media.columns if c != media_col]
    return media.withColumn("_c", table(media_col)).select(*others, F.explode_outer("_c.cues").alias("_q"), F.col("_c.error").alias("error")).select(*others, "_q.*", "error")


def read_back(media: DataFrame, id_col: str = "doc_id") -> DataFrame:
    """The stored bytes parsed and digested: payload_bytes, payload_sha256, tail_crc32, media_bytes, media_sha256, feature, error.

    A file that is null or can't be parsed gives an error and nulls instead, but for what its bytes alone tell.  The clusters are found
    by the cues, which must name each in order."""
    kind = media.schema[id_col].dataType.simpleString()

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            rows = []
            for data in batch.column(2).to_pylist():
                stored = (None, None) if data is None else (len(data), hashlib.sha256(data).hexdigest())
                try:
                    found = parse(data)
                    payload = samples(data, found)
                    if found.cues and [place for *_, place in found.cues] != found.clusters:
                        raise ValueError("cues and clusters differ")
                    rows.append((len(payload), hashlib.sha256(payload).hexdigest(), zlib.crc32(payload[-64:]), *stored, feature(payload, found), None))
                except ValueError as e:
                    rows.append((None, None, None, *stored, None, str(e)))
            columns = list(zip(*rows, strict=True)) or [()] * 7
            yield pa.RecordBatch.from_arrays([batch.column(0), batch.column(1), *(pa.array(c, t) for c, t in zip(columns, (pa.int64(), pa.string(), pa.int64(), pa.int64(), pa.string(), pa.string(), pa.string()), strict=True))], names=[id_col, "n_bytes", "payload_bytes", "payload_sha256", "tail_crc32", "media_bytes", "media_sha256", "feature", "error"])

    return media.select(id_col, "n_bytes", "media").mapInArrow(run, f"{id_col} {kind}, n_bytes long, payload_bytes long, payload_sha256 string, tail_crc32 long, media_bytes long, media_sha256 string, feature string, error string")


def op5(docs: DataFrame) -> DataFrame:
    """doc_id, n_bytes, payload_bytes, payload_sha256, tail_crc32, media_bytes, media_sha256, feature of the text as stored and read back."""
    return read_back(encode(docs)).drop("error")
