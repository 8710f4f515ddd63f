"""Media columns: MPEG transport streams (ISO/IEC 13818-1) in binary columns.

``mux_column`` stores bytes as an elementary stream inside transport packets; ``demux_column`` parses program tables,
checks continuity counters, reassembles the PES packets of each elementary stream and lists their time stamps and
random-access points.

Edge cases: a null media value has no programs, no streams and zero counts; packets without the sync byte or with the
error flag are counted and skipped; a repeated packet (same counter and bytes) is dropped once, any other jump of a
counter is one continuity error; streams that no program table names are listed with type -1. A null payload is muxed as
an empty one.
"""

from __future__ import annotations

from functools import lru_cache

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import types as T

from ._common import append_column, arrow_type

PACKET, SYNC, NULL_PID, PMT_PID, DATA_PID = 188, 0x47, 0x1FFF, 0x1000, 0x100
#: Ticks of the 90 kHz clock between access units (25 a second), and access units from one random-access point to the next.
TICKS, RAP_EVERY, UNIT_BYTES = 3600, 8, 3072
PRIVATE_STREAM_TYPE, PRIVATE_STREAM_ID = 0x06, 0xBD


@lru_cache(1)
def _crc_table() -> list[int]:
    table = []
    for i in range(256):
        c = i << 24
        for _ in range(8):
            c = (c << 1) ^ 0x04C11DB7 if c & 0x80000000 else c << 1
        table.append(c & 0xFFFFFFFF)
    return table


def crc32_mpeg(data: bytes) -> int:
    """The CRC of program tables: polynomial 04C11DB7, not reflected, start FFFFFFFF."""
    c, table = 0xFFFFFFFF, _crc_table()
    for x in data:
        c = ((c << 8) & 0xFFFFFFFF) ^ table[(c >> 24) ^ x]
    return c


def _section_packet(pid: int, table_id: int, extension: int, body: bytes) -> bytes:
    head = bytes([table_id]) + (0xB000 | (len(body) + 9)).to_bytes(2, "big") + extension.to_bytes(2, "big") + b"\xc1\x00\x00"
    section = head + body
    section += crc32_mpeg(section).to_bytes(4, "big")
    packet = bytes([SYNC, 0x40 | pid >> 8, pid & 0xFF, 0x10, 0]) + section
    return packet + b"\xff" * (PACKET - len(packet))


@lru_cache(1)
def _tables() -> bytes:
    pat = _section_packet(0, 0, 1, (1).to_bytes(2, "big") + (0xE000 | PMT_PID).to_bytes(2, "big"))
    stream = bytes([PRIVATE_STREAM_TYPE]) + (0xE000 | DATA_PID).to_bytes(2, "big") + b"\xf0\x00"
    return pat + _section_packet(PMT_PID, 2, 1, (0xE000 | DATA_PID).to_bytes(2, "big") + b"\xf0\x00" + stream)


def _pts_bytes(pts: int) -> bytes:
    return bytes([0x21 | (pts >> 29) & 0x0E, (pts >> 22) & 0xFF, 0x01 | (pts >> 14) & 0xFE, (pts >> 7) & 0xFF, 0x01 | (pts << 1) & 0xFE])


def _read_pts(b: bytes) -> int:
    return (b[0] >> 1 & 7) << 30 | b[1] << 22 | (b[2] >> 1) << 15 | b[3] << 7 | b[4] >> 1


def mux(payload: bytes) -> bytes:
    """The transport stream of one program with one private stream that holds ``payload``."""
    out, counter = [_tables()], 0
    for n, start in enumerate(range(0, max(1, len(payload)), UNIT_BYTES)):
        data, pts, rap = payload[start : start + UNIT_BYTES], n * TICKS % (1 << 33), n % RAP_EVERY == 0
        pes = b"\x00\x00\x01" + bytes([PRIVATE_STREAM_ID]) + (len(data) + 8).to_bytes(2, "big") + b"\x84\x80\x05" + _pts_bytes(pts) + data
        at = 0
        while at < len(pes):
            fields = b""
            if rap and at == 0:
                fields = b"\x50" + (pts << 15 | 0x7E00).to_bytes(6, "big")
            room = PACKET - 4 - (len(fields) + 1 if fields else 0)
            part = pes[at : at + room]
            if len(part) < room:
                short = room - len(part)
                if fields:
                    fields += b"\xff" * short
                else:
                    fields = b"" if short == 1 else b"\x00" + b"\xff" * (short - 2)
                adaptation = bytes([len(fields)]) + fields
            else:
                adaptation = bytes([len(fields)]) + fields if fields else b""
            out.append(bytes([SYNC, (0x40 if at == 0 else 0) | DATA_PID >> 8, DATA_PID & 0xFF, (0x30 if adaptation else 0x10) | counter]) + adaptation + part)
            counter, at = counter + 1 & 15, at + len(part)
    return b"".join(out)


def _section(data: bytes) -> bytes | None:
    """The first section of a packet's payload, if it is whole and its CRC is right."""
    data = data[1 + data[0] :] if data else b""
    if len(data) < 12:
        return None
    end = 3 + (int.from_bytes(data[1:3], "big") & 0xFFF)
    return data[:end] if end <= len(data) and crc32_mpeg(data[:end]) == 0 else None


def _pes(data: bytes, rap: bool) -> tuple[int | None, int | None, bool, bytes] | None:
    """(pts, dts, random access, payload) of one PES packet; None if it has no start code or a wrong length."""
    if len(data) < 9 or data[:3] != b"\x00\x00\x01":
        return None
    said, flags, head = int.from_bytes(data[4:6], "big"), data[7] >> 6, data[8]
    if said and said + 6 > len(data) or 9 + head > len(data):
        return None
    pts = _read_pts(data[9:14]) if flags & 2 and head >= 5 else None
    dts = _read_pts(data[14:19]) if flags == 3 and head >= 10 else pts
    return pts, dts, rap, data[9 + head : said + 6 if said else len(data)]


def demux(media: bytes | None) -> dict:
    """Everything that ``DEMUX_TYPE`` lists, of one transport stream."""
    media = media or b""
    a = np.frombuffer(media, np.uint8, len(media) // PACKET * PACKET).reshape(-1, PACKET)
    good = (a[:, 0] == SYNC) & (a[:, 1] & 0x80 == 0)
    pids = ((a[:, 1] & 0x1F).astype(np.int32) << 8 | a[:, 2])
    control, counters = a[:, 3] >> 4 & 3, a[:, 3] & 15
    has_field, has_payload = (control & 2) > 0, (control & 1) > 0
    starts = np.where(has_field, 5 + a[:, 4].astype(np.int32), 4)
    flags = np.where(has_field & (a[:, 4] > 0), a[:, 5], 0)
    keep = good & (pids != NULL_PID) & has_payload & (starts <= PACKET)
    unit, pcrs = (a[:, 1] & 0x40) > 0, int((flags & 0x10 > 0)[good].sum())
    programs: list[dict] = []
    types: dict[int, int] = {}
    pmts: dict[int, int] = {}
    gaps, streams = 0, {}
    for i in np.flatnonzero(keep & (pids == 0) & unit).tolist():
        if (s := _section(media[i * PACKET + int(starts[i]) : (i + 1) * PACKET])) and s[0] == 0:
            pmts |= {int.from_bytes(s[k + 2 : k + 4], "big") & 0x1FFF: int.from_bytes(s[k : k + 2], "big") for k in range(8, len(s) - 4, 4)}
    for pid, number in pmts.items():
        for i in np.flatnonzero(keep & (pids == pid) & unit)[:1].tolist():
            s = _section(media[i * PACKET + int(starts[i]) : (i + 1) * PACKET])
            if s and s[0] == 2:
                found, k = [], 12 + (int.from_bytes(s[10:12], "big") & 0xFFF)
                while k + 5 <= len(s) - 4:
                    found.append({"pid": int.from_bytes(s[k + 1 : k + 3], "big") & 0x1FFF, "stream_type": s[k]})
                    k += 5 + (int.from_bytes(s[k + 3 : k + 5], "big") & 0xFFF)
                types |= {x["pid"]: x["stream_type"] for x in found}
                programs.append({"program": number, "pmt_pid": pid, "streams": found})
    for pid in np.unique(pids[keep]).tolist():
        at = np.flatnonzero(keep & (pids == pid))
        c = counters[at].astype(np.int16)
        step = np.diff(c) & 15
        same = np.zeros(len(at), bool)
        if (step == 0).any():
            same[1:] = (step == 0) & np.fromiter((bytes(a[i]) == bytes(a[j]) for i, j in zip(at[:-1], at[1:], strict=True)), bool, len(at) - 1)
        gaps += int(((step != 1) & ~same[1:]).sum())
        if pid == 0 or pid in pmts:
            continue
        at = at[~same]
        units, broken, buffer, rap, begun = [], 0, [], False, False

        def close() -> None:
            nonlocal broken
            if begun:
                one = _pes(b"".join(buffer), rap)
                broken += one is None
                if one:
                    units.append(one)

        for i, new, flag, s in zip(at.tolist(), unit[at].tolist(), flags[at].tolist(), starts[at].tolist(), strict=True):
            if new:
                close()
                buffer, rap, begun = [], bool(flag & 0x40), True
            buffer.append(media[i * PACKET + s : (i + 1) * PACKET])
        close()
        sizes = [len(u[3]) for u in units]
        offsets = np.cumsum([0, *sizes]).tolist()
        streams[pid] = {
            "pid": pid, "stream_type": types.get(pid, -1), "broken_units": broken, "payload": b"".join(u[3] for u in units),
            "units": [{"pts": u[0], "dts": u[1], "random_access": u[2], "offset": o, "size": n} for u, o, n in zip(units, offsets, sizes, strict=False)],
        }
    return {"packets": len(a), "bad_packets": int((~good).sum()), "continuity_errors": gaps, "clock_references": pcrs, "programs": programs, "streams": list(streams.values())}


DEMUX_TYPE = (
    "packets LONG, bad_packets LONG, continuity_errors LONG, clock_references LONG, "
    "programs ARRAY<STRUCT<program: INT, pmt_pid: INT, streams: ARRAY<STRUCT<pid: INT, stream_type: INT>>>>, "
    "streams ARRAY<STRUCT<pid: INT, stream_type: INT, broken_units: LONG, payload: BINARY, "
    "units: ARRAY<STRUCT<pts: LONG, dts: LONG, random_access: BOOLEAN, offset: LONG, size: LONG>>>>"
)


def mux_column(df: DataFrame, payload: str, out: str = "media") -> DataFrame:
    """Append ``out``: the transport stream that holds the bytes of column ``payload``."""

    def make():
        return lambda c: pa.array([mux(x or b"") for x in c.to_pylist()], pa.binary())

    return append_column(df, [payload], out, T.BinaryType(), make)


def demux_column(df: DataFrame, media: str = "media", out: str = "demuxed") -> DataFrame:
    """Append ``out`` (``DEMUX_TYPE``): tables, error counts, elementary payloads and time stamps of column ``media``."""
    arrow = arrow_type(DEMUX_TYPE)

    def make():
        return lambda c: pa.array([demux(x) for x in c.to_pylist()], arrow)

    return append_column(df, [media], out, DEMUX_TYPE, make)
