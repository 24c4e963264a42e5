"""Media columns: MPEG transport streams.

``mux`` stores a payload losslessly as 8-bit samples (8000 a second) in a transport stream:
a program association table, a program map table, and elementary packets of up to
``UNITS`` units of 576 samples, each with a presentation time, a clock reference and every
``RANDOM_ACCESS``-th marked as a random-access point.  ``demux`` reads any transport stream:
it finds the 188-byte grid, parses the program tables (their checksums too), follows
continuity counters (repeated packets are dropped, gaps counted), reassembles elementary
packets and returns their times and random-access points.

Defined results: a null or empty payload is one unit of 255; bytes that are no transport
stream give a stream without programs; a gap drops the elementary packet that it falls in
only as far as bytes are missing, and is counted in ``gaps``.
"""

from __future__ import annotations

import hashlib
import struct
import zlib
from collections.abc import Iterator
from dataclasses import dataclass, field

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from quarrymill.llm.common import bounded_batches

PACKET = 188
UNIT = 576
UNITS = 4
RANDOM_ACCESS = 4
RATE = 8000
CLOCK = 90_000
MAP_PID, DATA_PID = 0x1000, 0x0100
#: Elementary packets between two copies of the tables.
TABLES_EVERY = 64


def _crc_table() -> list[int]:
    out = []
    for i in range(256):
        c = i << 24
        for _ in range(8):
            c = (c << 1 ^ 0x04C11DB7 if c >> 31 else c << 1) & 0xFFFFFFFF
        out.append(c)
    return out


_CRC = _crc_table()


def crc_mpeg(data: bytes) -> int:
    """CRC-32 as program tables have it: not reflected, not inverted; 0 over a table with its own."""
    c = 0xFFFFFFFF
    for b in data:
        c = (c << 8 & 0xFFFFFFFF) ^ _CRC[c >> 24 ^ b]
    return c


def _section(table: int, number: int, body: bytes) -> bytes:
    head = struct.pack(">BHHBBB", table, 0xB000 | len(body) + 9, number, 0xC1, 0, 0) + body
    return head + struct.pack(">I", crc_mpeg(head))


ASSOCIATION = _section(0, 1, struct.pack(">HH", 1, 0xE000 | MAP_PID))
MAP = _section(2, 1, struct.pack(">HHBHH", 0xE000 | DATA_PID, 0xF000, 0x06, 0xE000 | DATA_PID, 0xF000))


def _table_packet(pid: int, section: bytes, cc: int) -> bytes:
    return (struct.pack(">BHB", 0x47, 0x4000 | pid, 0x10 | cc & 15) + b"\0" + section).ljust(PACKET, b"\xff")


def _time(pts: int) -> bytes:
    return bytes([0x21 | pts >> 29 & 0x0E, pts >> 22 & 0xFF, 1 | pts >> 14 & 0xFE, pts >> 7 & 0xFF, 1 | pts << 1 & 0xFE])


def mux(payload: bytes) -> bytes:
    """A transport stream with the payload."""
    out, cc = [], 0
    step = UNIT * UNITS
    for k, at in enumerate(range(0, len(payload), step)):
        if k % TABLES_EVERY == 0:
            out += [_table_packet(0, ASSOCIATION, k // TABLES_EVERY), _table_packet(MAP_PID, MAP, k // TABLES_EVERY)]
        data = payload[at : at + step]
        pts = (at * CLOCK // RATE) & (1 << 33) - 1
        pes = b"\0\0\1\xbd" + struct.pack(">HBBB", len(data) + 8, 0x84, 0x80, 5) + _time(pts) + data
        clock = struct.pack(">IH", pts >> 1, (pts & 1) << 15 | 0x7E00)
        flags = 0x50 if k % RANDOM_ACCESS == 0 else 0x10
        if len(pes) >= 176:
            out.append(struct.pack(">BHBBB", 0x47, 0x4000 | DATA_PID, 0x30 | cc, 7, flags) + clock + pes[:176])
            rest = pes[176:]
        else:
            out.append(struct.pack(">BHBBB", 0x47, 0x4000 | DATA_PID, 0x30 | cc, 183 - len(pes), flags) + clock + b"\xff" * (176 - len(pes)) + pes)
            rest = b""
        cc = cc + 1 & 15
        whole = len(rest) // 184
        if whole:
            block = np.empty((whole, PACKET), np.uint8)
            block[:, 0], block[:, 1], block[:, 2] = 0x47, DATA_PID >> 8, DATA_PID & 255
            block[:, 3] = 0x10 | (cc + np.arange(whole)) & 15
            block[:, 4:] = np.frombuffer(rest, np.uint8, whole * 184).reshape(whole, 184)
            out.append(block.tobytes())
            cc = cc + whole & 15
        if tail := rest[whole * 184 :]:
            room = 183 - len(tail)
            out.append(struct.pack(">BHBB", 0x47, DATA_PID, 0x30 | cc, room) + (b"\0".ljust(room, b"\xff") if room else b"") + tail)
            cc = cc + 1 & 15
    return b"".join(out)


@dataclass
class Elementary:
    """One elementary packet: its time in 1/90000 s (None if it has none), whether it is a
    random-access point, and its data."""

    pts: int | None
    random_access: bool
    data: bytes


@dataclass
class Stream:
    packets: int = 0
    programs: dict[int, int] = field(default_factory=dict)
    kinds: dict[int, int] = field(default_factory=dict)
    elementary: dict[int, list[Elementary]] = field(default_factory=dict)
    gaps: int = 0
    repeats: int = 0
    bad_tables: int = 0


def _grid(data: bytes) -> int:
    """Where the 188-byte grid starts: the first offset with sync bytes at each step (up to 8)."""
    for at in range(min(PACKET, len(data))):
        n = min(8, (len(data) - at) // PACKET)
        if n and all(data[at + i * PACKET] == 0x47 for i in range(n)):
            return at
    return len(data)


def _sections(parts: list[tuple[bool, bytes]]) -> Iterator[bytes]:
    """Whole sections from the payloads of a table's packets."""
    held = b""
    for start, part in parts:
        if start and part:
            held = held + part[1 : 1 + part[0]] if held else b""
            if len(held) >= 3 and len(held) >= 3 + ((held[1] & 15) << 8 | held[2]):
                yield held[: 3 + ((held[1] & 15) << 8 | held[2])]
            held = part[1 + part[0] :]
        else:
            held += part
        while len(held) >= 3 and held[0] != 0xFF and len(held) >= (n := 3 + ((held[1] & 15) << 8 | held[2])):
            yield held[:n]
            held = held[n:]
        if held[:1] == b"\xff":
            held = b""


def _elementary(start_access: bool, parts: list[bytes]) -> Elementary | None:
    raw = b"".join(parts)
    if len(raw) < 9 or raw[:3] != b"\0\0\1":
        return None
    size, extended = struct.unpack(">H", raw[4:6])[0], raw[6] >> 6 == 2
    if not extended:
        return Elementary(None, start_access, raw[6 : 6 + size] if size else raw[6:])
    pts = None
    if raw[7] & 0x80 and len(raw) >= 14:
        t = raw[9:14]
        pts = (t[0] >> 1 & 7) << 30 | t[1] << 22 | (t[2] >> 1) << 15 | t[3] << 7 | t[4] >> 1
    return Elementary(pts, start_access, raw[9 + raw[8] : 6 + size] if size else raw[9 + raw[8] :])


def demux(data: bytes) -> Stream:
    """Parses a transport stream."""
    out = Stream()
    at = _grid(data)
    n = (len(data) - at) // PACKET
    if not n:
        return out
    grid = np.frombuffer(data, np.uint8, n * PACKET, at).reshape(n, PACKET)
    good = (grid[:, 0] == 0x47) & (grid[:, 1] & 0x80 == 0)  # the error indicator drops a packet
    pid = (grid[:, 1].astype(np.int32) & 0x1F) << 8 | grid[:, 2]
    start, control, cc = grid[:, 1] & 0x40 != 0, grid[:, 3] >> 4 & 3, grid[:, 3] & 15
    size = np.where(control & 2, grid[:, 4].astype(np.int32) + 1, 0)
    access = (control & 2 != 0) & (size > 1) & (grid[:, 5] & 0x40 != 0)
    begin = 4 + size
    good &= (control & 1 != 0) & (begin < PACKET) & (grid[:, 3] & 0xC0 == 0)
    out.packets = int(n)

    def payloads(one: int) -> list[tuple[int, bool]]:
        """Rows of a PID in order, without repeats; and whether a gap lies before each."""
        rows = np.flatnonzero(good & (pid == one))
        if len(rows) < 2:
            return [(int(r), False) for r in rows]
        moved = (cc[rows[1:]].astype(np.int32) - cc[rows[:-1]]) & 15
        same = np.concatenate(([False], moved == 0))
        for k in np.flatnonzero(same):
            same[k] = bool((grid[rows[k]] == grid[rows[k - 1]]).all())
        out.repeats += int(same.sum())
        gap = np.concatenate(([False], moved != 1)) & ~same
        out.gaps += int(gap.sum())
        return [(int(r), bool(g)) for r, g, s in zip(rows, gap, same, strict=True) if not s]

    view, begins = memoryview(data)[at:], begin.tolist()

    def body(row: int) -> memoryview:
        return view[row * PACKET + begins[row] : (row + 1) * PACKET]

    for section in _sections([(bool(start[r]), bytes(body(r))) for r, _ in payloads(0)]):
        if section[0] != 0 or crc_mpeg(section):
            out.bad_tables += section[0] == 0
            continue
        for i in range(8, len(section) - 4, 4):
            number, target = struct.unpack(">HH", section[i : i + 4])
            if number:
                out.programs[number] = target & 0x1FFF
    for target in sorted(set(out.programs.values())):
        for section in _sections([(bool(start[r]), bytes(body(r))) for r, _ in payloads(target)]):
            if section[0] != 2 or crc_mpeg(section):
                out.bad_tables += section[0] == 2
                continue
            i = 12 + (struct.unpack(">H", section[10:12])[0] & 0x0FFF)
            while i + 5 <= len(section) - 4:
                kind, one, info = struct.unpack(">BHH", section[i : i + 5])
                out.kinds[one & 0x1FFF] = kind
                i += 5 + (info & 0x0FFF)
    for one in sorted(out.kinds):
        found, parts, point = [], [], False
        for row, _ in payloads(one):
            if start[row]:
                if parts and (e := _elementary(point, parts)):
                    found.append(e)
                parts, point = [body(row)], bool(access[row])
            elif parts:
                parts.append(body(row))
        if parts and (e := _elementary(point, parts)):
            found.append(e)
        out.elementary[one] = found
    return out


def padded(text: str | None) -> tuple[int, bytes]:
    """The text's UTF-8 length and its bytes with 255 appended up to a positive multiple of 576."""
    raw = (text or "").encode("utf-8", "replace")
    return len(raw), raw + b"\xff" * (-len(raw) % UNIT or (0 if raw else UNIT))


FIELDS = {
    "n_bytes": "long", "payload_bytes": "long", "payload_sha256": "string", "tail_crc32": "long", "media_bytes": "long", "media_sha256": "string",
    "feature": "string", "media": "binary", "pts": "array<long>", "random_access": "array<long>",
}


def record(text: str | None) -> tuple:
    """Stores a text, reads it back, and describes what was read."""
    n, payload = padded(text)
    media = mux(payload)
    read = demux(media)
    packets = read.elementary.get(DATA_PID, [])
    back = b"".join(e.data for e in packets)
    samples = np.frombuffer(back, np.uint8)
    times = [e.pts for e in packets]
    points = [e.pts for e in packets if e.random_access]
    middle = int(np.count_nonzero(np.diff(samples >= 128)))
    feature = (
        f"programs={len(read.programs)};pid={DATA_PID};packets={read.packets};elementary={len(packets)};random_access={len(points)};gaps={read.gaps};"
        f"ms={len(back) * 1000 // RATE};sum={int(samples.sum(dtype=np.int64))};least={int(samples.min(initial=255))};most={int(samples.max(initial=0))};crossings={middle}"
    )
    return n, len(back), hashlib.sha256(back).hexdigest(), zlib.crc32(back[-32:]), len(media), hashlib.sha256(media).hexdigest(), feature, media, times, points


def media_columns(spark: SparkSession, docs: DataFrame, fields: tuple[str, ...] = tuple(FIELDS)) -> DataFrame:
    """doc_id and the chosen FIELDS for every row of docs; media is the stored stream, pts and
    random_access the times of its elementary packets and random-access points."""
    bounded_batches(spark)
    kinds = {"long": pa.int64(), "string": pa.string(), "binary": pa.binary(), "array<long>": pa.list_(pa.int64())}
    at = [list(FIELDS).index(f) for f in fields]

    @F.arrow_udf(f"struct<{','.join(f'{f}:{FIELDS[f]}' for f in fields)}>")
    def run(texts: Iterator[pa.Array]) -> Iterator[pa.Array]:
        for batch in texts:
            rows = []
            for t in batch.to_pylist():
                r = record(t)
                rows.append([r[i] for i in at])
            columns = list(zip(*rows, strict=True)) if rows else [()] * len(fields)
            yield pa.StructArray.from_arrays([pa.array(c, kinds[FIELDS[f]]) for c, f in zip(columns, fields, strict=True)], names=list(fields))

    docs = docs.select("doc_id", "text")
    return docs.select("doc_id", run.asNondeterministic()(docs["text"]).alias("m")).select("doc_id", *(f"m.{f}" for f in fields))
