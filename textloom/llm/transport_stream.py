"""MPEG transport streams as a media column: multiplex a payload, store it, read it back, compute features.

`multiplex` lays a payload out as PES packets (ISO/IEC 13818-1) on one elementary PID behind a PAT and a PMT;
the first transport packet of every PES packet carries the payload-unit-start flag, a random-access indicator
and a PCR, and the PES header carries a PTS. `demultiplex` trusts nothing: it checks the sync bytes, the CRCs of the tables, finds
the program's PID through PAT and PMT, checks the continuity counters (where a packet doesn't announce a discontinuity), reassembles the PES packets by their
lengths, or up to the next one where the length is 0, and returns the payload with all timestamps and random-access points.

`digests` writes the streams as a binary column into the shared folder, reads that table and computes everything from what it read; a
damaged stream, or one whose counters don't follow, fails the job.

A null text is the empty text. Every payload is a positive multiple of 64 bytes, so an empty text has one PES
packet of 64 zero bytes. A payload of any length is cut into PES packets of at most PES_BYTES, whose memory is
all that grows besides the payload itself; a stream has to fit in an Arrow batch (2 GB). Repeated rows give repeated results, an
empty table an empty one; other columns are kept, but for the text in `digests`, and of clashing names the operator's column wins.
"""

from __future__ import annotations

import hashlib
import struct
import zlib
from dataclasses import dataclass

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F
from pyspark.sql.types import StructType, _parse_datatype_string

from .common import settle, text_slices

PACKET = 188
PMT_PID, MEDIA_PID = 0x0100, 0x0101
STREAM_TYPE, STREAM_ID = 0x06, 0xBD  # private data in PES packets
PES_BYTES = 32_768
#: Ticks of the 90 kHz clock between PES packets.
PTS_STEP = 3_600
PTS_WRAP = 1 << 33
#: Payloads are padded to a multiple of this.
UNIT = 64


def _crc_table() -> list[int]:
    out = []
    for i in range(256):
        c = i << 24
        for _ in range(8):
            c = ((c << 1) ^ 0x04C11DB7 if c & 0x80000000 else c << 1) & 0xFFFFFFFF
        out.append(c)
    return out


_CRC = _crc_table()


def crc32_mpeg(data: bytes) -> int:
    c = 0xFFFFFFFF
    for b in data:
        c = ((c << 8) & 0xFFFFFFFF) ^ _CRC[(c >> 24) ^ b]
    return c


def _section(table_id: int, number: int, body: bytes) -> bytes:
    head = struct.pack(">BHHBBB", table_id, 0xB000 | (len(body) + 9), number, 0xC1, 0, 0) + body
    return head + struct.pack(">I", crc32_mpeg(head))


def _table_packet(pid: int, section: bytes) -> bytes:
    return (struct.pack(">BHBB", 0x47, 0x4000 | pid, 0x10, 0) + section).ljust(PACKET, b"\xff")


_PAT = _table_packet(0, _section(0x00, 1, struct.pack(">HH", 1, 0xE000 | PMT_PID)))
_PMT = _table_packet(PMT_PID, _section(0x02, 1, struct.pack(">HH", 0xE000 | MEDIA_PID, 0xF000) + struct.pack(">BHH", STREAM_TYPE, 0xE000 | MEDIA_PID, 0xF000)))


def _stamp(mark: int, pts: int) -> bytes:
    return struct.pack(">BHH", mark << 4 | (pts >> 30 & 7) << 1 | 1, (pts >> 15 & 0x7FFF) << 1 | 1, (pts & 0x7FFF) << 1 | 1)


def pad(raw: bytes) -> bytes:
    return raw.ljust(max(UNIT, -(-len(raw) // UNIT) * UNIT), b"\0")


def _unit(payload: bytes, pts: int, counter: int) -> tuple[bytes, int]:
    """The transport packets of one PES packet, and the next continuity counter."""
    pes = struct.pack(">IHBBB", 0x100 | STREAM_ID, len(payload) + 8, 0x84, 0x80, 5) + _stamp(2, pts) + payload
    adapt = struct.pack(">BBIH", 7, 0x50, pts >> 1, (pts & 1) << 15 | 0x7E00)  # random access, PCR
    first = PACKET - 4 - len(adapt)
    rest = max(0, len(pes) - first)
    n = 1 + -(-rest // (PACKET - 4))
    out = np.full((n, PACKET), 0xFF, np.uint8)
    out[:, 0] = 0x47
    out[:, 1], out[:, 2] = MEDIA_PID >> 8, MEDIA_PID & 0xFF
    out[0, 1] |= 0x40
    out[:, 3] = 0x10 | (counter + np.arange(n)) & 15
    out[0, 3] |= 0x20
    data = np.frombuffer(pes, np.uint8)
    if len(pes) < first:  # stuffing in the adaptation field
        adapt = bytes([7 + first - len(pes)]) + adapt[1:] + b"\xff" * (first - len(pes))
    out[0, 4 : 4 + len(adapt)] = np.frombuffer(adapt, np.uint8)
    out[0, 4 + len(adapt) :] = data[: PACKET - 4 - len(adapt)]
    data = data[PACKET - 4 - len(adapt) :]
    full = len(data) // (PACKET - 4)
    out[1 : 1 + full, 4:] = data[: full * (PACKET - 4)].reshape(full, PACKET - 4)
    if tail := data[full * (PACKET - 4) :].size:
        out[-1, 3] |= 0x20
        out[-1, 4] = PACKET - 5 - tail
        if PACKET - 5 - tail:
            out[-1, 5] = 0
        out[-1, PACKET - tail :] = data[full * (PACKET - 4) :]
    return out.tobytes(), (counter + n) & 15


def multiplex(payload: bytes) -> bytes:
    out, counter = [_PAT, _PMT], 0
    for k, at in enumerate(range(0, len(payload), PES_BYTES)):
        packets, counter = _unit(payload[at : at + PES_BYTES], k * PTS_STEP % PTS_WRAP, counter)
        out.append(packets)
    return b"".join(out)


class BrokenStream(ValueError):
    pass


@dataclass
class Stream:
    payload: bytes
    pts: list[int]
    #: Numbers of the transport packets that carry a random-access point.
    random_access: list[int]
    packets: int
    stream_type: int
    #: Packets whose continuity counter doesn't follow.
    discontinuities: int


def _parse_section(packet: np.ndarray, table_id: int) -> bytes:
    raw = packet.tobytes()
    at = 4 + (1 + raw[4] if raw[3] & 0x20 else 0)
    at += 1 + raw[at]
    size = 3 + (struct.unpack_from(">H", raw, at + 1)[0] & 0xFFF)
    section = raw[at : at + size]
    if section[0] != table_id or len(section) != size or crc32_mpeg(section):
        raise BrokenStream(f"table {table_id} is damaged")
    return section[8:-4]


def demultiplex(media: bytes) -> Stream:
    if not media or len(media) % PACKET:
        raise BrokenStream(f"{len(media)} bytes are no whole transport packets")
    p = np.frombuffer(media, np.uint8).reshape(-1, PACKET)
    if (p[:, 0] != 0x47).any():
        raise BrokenStream("a sync byte is missing")
    pid = (p[:, 1].astype(np.int32) & 0x1F) << 8 | p[:, 2]
    starts = (p[:, 1] & 0x40) != 0

    def the_first(want: int) -> np.ndarray:
        found = np.flatnonzero((pid == want) & starts)
        if not len(found):
            raise BrokenStream(f"no table on PID {want}")
        return p[found[0]]

    programs = _parse_section(the_first(0), 0x00)
    pmt_pid = next((b & 0x1FFF for a, b in struct.iter_unpack(">HH", programs) if a), None)
    if pmt_pid is None:
        raise BrokenStream("no program")
    body = _parse_section(the_first(pmt_pid), 0x02)
    at = 4 + (struct.unpack_from(">H", body, 2)[0] & 0xFFF)
    stream_type, media_pid = struct.unpack_from(">BH", body, at)
    media_pid &= 0x1FFF
    where = np.flatnonzero(pid == media_pid)
    own, starts = p[where], starts[where]
    control = own[:, 3] >> 4 & 3
    if not len(own) or not starts[0]:
        raise BrokenStream("the stream doesn't begin with a PES packet")
    has = (control & 1) == 1
    counter = own[has, 3] & 15
    announced = ((control & 2 != 0) & (own[:, 4] > 0) & (own[:, 5] & 0x80 != 0))[has]
    discontinuities = int(((np.diff(counter.astype(np.int16)) % 16 != 1) & ~announced[1:]).sum())
    skip = np.where(control & 2, own[:, 4].astype(np.int32) + 1, 0)
    flagged = (control & 2 != 0) & (own[:, 4] > 0) & (own[:, 5] & 0x40 != 0)
    live = np.arange(PACKET) >= (4 + skip)[:, None]
    live[~has] = False
    lens = live.sum(axis=1)
    data = own[live].tobytes()
    ends = np.cumsum(lens)
    begins = (ends - lens)[starts]
    bounds = [*begins.tolist(), len(data)]
    payload, stamps = [], []
    for a, b in zip(bounds[:-1], bounds[1:]):
        prefix, size, _, flags, extra = struct.unpack_from(">IHBBB", data, a)
        if prefix >> 8 != 1 or size and b - a != size + 6:
            raise BrokenStream("a PES packet has a wrong start or length")
        if flags & 0x80:
            x, y, z = struct.unpack_from(">BHH", data, a + 9)
            stamps.append((x >> 1 & 7) << 30 | y >> 1 << 15 | z >> 1)
        payload.append(data[a + 9 + extra : b])
    return Stream(b"".join(payload), stamps, where[flagged].tolist(), len(p), stream_type, discontinuities)


def feature(stream: Stream) -> str:
    """Type, packets, PES packets, first and last PTS, random-access points, discontinuities, mean and entropy of the samples."""
    counts = np.bincount(np.frombuffer(stream.payload, np.uint8), minlength=256)
    share = counts[counts > 0] / len(stream.payload)
    mean = float((counts * np.arange(256)).sum() / len(stream.payload))
    entropy = float(-(share * np.log2(share)).sum())
    return (
        f"type={stream.stream_type};packets={stream.packets};pes={len(stream.pts)};pts={stream.pts[0]}-{stream.pts[-1]};"
        f"random_access={len(stream.random_access)}@{stream.random_access[0]}-{stream.random_access[-1]};"
        f"discontinuities={stream.discontinuities};mean={mean:.4f};entropy={abs(entropy):.4f}"
    )


def _map(df: DataFrame, source: str, added: str, rows, keep: bool = True) -> DataFrame:
    new = _parse_datatype_string(added)
    names = {f.name.lower() for f in new}
    kept = [f.name for f in df.schema if f.name.lower() not in names and (keep or f.name != source)]
    schema = StructType([df.schema[c] for c in kept] + list(new))

    def run(batches):
        for batch in batches:
            for part, data, offsets in text_slices(batch, source, 4 << 20):
                raw = data.tobytes()
                out = [rows(raw[a:b]) for a, b in zip(offsets[:-1].tolist(), offsets[1:].tolist())]
                cols = [pa.array(list(c), t) for c, t in zip(zip(*out), types)]
                yield pa.RecordBatch.from_arrays([part.column(c) for c in kept] + cols, names=kept + [f.name for f in new])

    from pyspark.sql.pandas.types import to_arrow_type

    types = [to_arrow_type(f.dataType) for f in new]
    return df.mapInArrow(run, schema)


def add_media(docs: DataFrame, text_col: str = "text", media_col: str = "media") -> DataFrame:
    """Adds the transport stream of each padded text as a binary column, and its unpadded length."""
    return _map(docs, text_col, f"{media_col} binary, n_bytes long", lambda raw: (multiplex(pad(raw)), len(raw)))


def read_media(df: DataFrame, media_col: str = "media") -> DataFrame:
    """Adds payload, timestamps, random-access points and discontinuities of each stream; a null or damaged one has an error and nulls."""

    def rows(raw):
        try:
            s = demultiplex(raw)
        except (BrokenStream, struct.error, IndexError) as e:
            return None, None, None, None, str(e)
        return s.payload, s.pts, s.random_access, s.discontinuities, None

    return _map(df, media_col, "payload binary, pts array<long>, random_access array<long>, discontinuities long, error string", rows)


def digests(docs: DataFrame, text_col: str = "text") -> DataFrame:
    """Stores the stream of each text, reads it back and adds digests and features of what was read. A damaged stream is an error."""
    stored = settle(add_media(docs, text_col, "__media").drop(text_col), "media")

    def rows(media):
        s = demultiplex(media)
        if s.discontinuities:
            raise BrokenStream(f"{s.discontinuities} packets are missing or out of order")
        got = s.payload
        return (
            len(got),
            hashlib.sha256(got).hexdigest(),
            zlib.crc32(got[-UNIT:]),
            len(media),
            hashlib.sha256(media).hexdigest(),
            feature(s),
        )

    added = "payload_bytes long, payload_sha256 string, tail_crc32 long, media_bytes long, media_sha256 string, feature string"
    read = _map(stored, "__media", added, rows, keep=False)
    back = [F.col(f"`{c}`") for c in read.columns if c not in ("n_bytes", *[x.split()[0] for x in added.split(", ")])]
    first, *rest = (x.split()[0] for x in added.split(", "))
    return read.select(*back, "n_bytes", first, *rest[:-1], F.concat("feature", F.lit(";unpadded="), F.col("n_bytes").cast("string")).alias("feature"))
