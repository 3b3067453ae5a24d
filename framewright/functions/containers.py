"""Containers and elementary streams: bytes to frames and back. Each reader is a generator over one file's bytes that never reads past its end."""

from __future__ import annotations

import struct
import zlib
from collections.abc import Iterator

import numpy as np

#: What readers give: track, codec or kind, time in nanoseconds (None: unknown), key frame, payload.
Packet = tuple[int, str, int | None, bool, bytes]


# --- RIFF/WAVE ------------------------------------------------------------------------------------------------------------------


def write_wav(samples: bytes, channels: int, rate: int, bits: int = 16) -> bytes:
    block = channels * bits // 8
    head = struct.pack("<4sIHHIIHH", b"fmt ", 16, 1, channels, rate, rate * block, block, bits)
    data = struct.pack("<4sI", b"data", len(samples)) + samples + b"\0" * (len(samples) % 2)
    return struct.pack("<4sI4s", b"RIFF", 4 + len(head) + len(data), b"WAVE") + head + data


def read_wav(data: bytes) -> tuple[int, int, int, bytes]:
    """channels, rate, bits and samples."""
    if data[:4] != b"RIFF" or data[8:12] != b"WAVE":
        raise ValueError("not a RIFF/WAVE file")
    at, fmt = 12, None
    while at + 8 <= len(data):
        kind, size = data[at : at + 4], int.from_bytes(data[at + 4 : at + 8], "little")
        body = data[at + 8 : at + 8 + size]
        if kind == b"fmt ":
            fmt = struct.unpack("<HHIIHH", body[:16])
        elif kind == b"data" and fmt:
            return fmt[1], fmt[2], fmt[5], body
        at += 8 + size + size % 2
    raise ValueError("no samples")


# --- IVF -------------------------------------------------------------------------------------------------------------------------


def write_ivf(frames: list[tuple[int, bytes]], fourcc: bytes, width: int, height: int, rate: int, scale: int = 1) -> bytes:
    """frames: (time in units of scale / rate seconds, payload)."""
    head = struct.pack("<4sHH4sHHIIII", b"DKIF", 0, 32, fourcc, width, height, rate, scale, len(frames), 0)
    return head + b"".join(struct.pack("<IQ", len(p), t) + p for t, p in frames)


def read_ivf(data: bytes) -> Iterator[Packet]:
    if data[:4] != b"DKIF":
        raise ValueError("not an IVF file")
    size, fourcc, rate, scale = int.from_bytes(data[6:8], "little"), data[8:12].decode("latin-1"), *struct.unpack_from("<II", data, 16)
    at = size
    while at + 12 <= len(data):
        n, t = struct.unpack_from("<IQ", data, at)
        payload = data[at + 12 : at + 12 + n]
        if len(payload) < n:
            return
        key = bool(payload) and not payload[0] & 1 if fourcc == "VP80" else True
        yield 0, fourcc, t * scale * 1_000_000_000 // max(1, rate), key, payload
        at += 12 + n


# --- FLV -------------------------------------------------------------------------------------------------------------------------


def write_flv(tags: list[tuple[int, int, bytes]]) -> bytes:
    """tags: (8 audio or 9 video, milliseconds, body) in order."""
    has = (4 if any(k == 8 for k, _, _ in tags) else 0) | (1 if any(k == 9 for k, _, _ in tags) else 0)
    out = [b"FLV\x01" + bytes([has]) + (9).to_bytes(4, "big") + b"\0\0\0\0"]
    for kind, ms, body in tags:
        tag = bytes([kind]) + len(body).to_bytes(3, "big") + (ms & 0xFFFFFF).to_bytes(3, "big") + bytes([ms >> 24 & 255]) + b"\0\0\0" + body
        out.append(tag + len(tag).to_bytes(4, "big"))
    return b"".join(out)


def read_flv(data: bytes) -> Iterator[Packet]:
    if data[:3] != b"FLV":
        raise ValueError("not an FLV file")
    at = int.from_bytes(data[5:9], "big") + 4
    while at + 11 <= len(data):
        kind, n = data[at] & 31, int.from_bytes(data[at + 1 : at + 4], "big")
        ms = int.from_bytes(data[at + 4 : at + 7], "big") | data[at + 7] << 24
        body = data[at + 11 : at + 11 + n]
        if len(body) < n:
            return
        if kind in (8, 9):
            yield kind, {8: "audio", 9: "video"}[kind], ms * 1_000_000, kind == 8 or bool(body) and body[0] >> 4 == 1, body
        at += 11 + n + 4


# --- Ogg -------------------------------------------------------------------------------------------------------------------------


#: Each byte with its bits turned about.
TURNED = bytes(int(f"{b:08b}"[::-1], 2) for b in range(256))


def ogg_crc(data: bytes) -> int:
    """CRC-32 with polynomial 0x04C11DB7, not reflected: zlib's, with all bits turned about."""
    reflected = zlib.crc32(data.translate(TURNED), 0xFFFFFFFF) ^ 0xFFFFFFFF
    return int.from_bytes(reflected.to_bytes(4, "little").translate(TURNED), "big")


def write_ogg(packets: list[tuple[int, int, bytes]]) -> bytes:
    """packets: (serial, granule, payload), one page each, long ones over several."""
    out, number, first = [], {}, set()
    last = {serial: i for i, (serial, _, _) in enumerate(packets)}
    for i, (serial, granule, payload) in enumerate(packets):
        lacing = [255] * (len(payload) // 255) + [len(payload) % 255]
        at, begun = 0, True
        while lacing:
            part, lacing = lacing[:255], lacing[255:]
            body = payload[at : at + sum(part)]
            at += len(body)
            flags = (0 if begun else 1) | (0 if serial in first else 2) | (4 if last[serial] == i and not lacing else 0)
            head = b"OggS\0" + bytes([flags]) + (granule if not lacing else -1).to_bytes(8, "little", signed=True) + serial.to_bytes(4, "little") + number.get(serial, 0).to_bytes(4, "little")
            page = head + b"\0\0\0\0" + bytes([len(part)]) + bytes(part) + body
            out.append(page[:22] + ogg_crc(page).to_bytes(4, "little") + page[26:])
            number[serial] = number.get(serial, 0) + 1
            first.add(serial)
            begun = False
    return b"".join(out)


def read_ogg(data: bytes) -> Iterator[Packet]:
    """Times are granules; pages with a wrong checksum are passed over."""
    at, held = 0, {}
    while (at := data.find(b"OggS", at)) >= 0 and at + 27 <= len(data):
        n = data[at + 26]
        lacing = data[at + 27 : at + 27 + n]
        size = 27 + n + sum(lacing)
        page = data[at : at + size]
        if len(page) < size or ogg_crc(page[:22] + b"\0\0\0\0" + page[26:]) != int.from_bytes(page[22:26], "little"):
            at += 4
            continue
        granule, serial = int.from_bytes(page[6:14], "little", signed=True), int.from_bytes(page[14:18], "little")
        begin, run = 27 + n, 0
        for x in lacing:
            run += x
            if x < 255:
                yield serial, "ogg", granule, True, held.pop(serial, b"") + page[begin : begin + run]
                begin, run = begin + run, 0
        if run:
            held[serial] = held.get(serial, b"") + page[begin : begin + run]
        at += size


# --- MPEG transport stream ----------------------------------------------------------------------------------------------------------


def mpeg_crc(data: bytes) -> int:
    crc = 0xFFFFFFFF
    for b in data:
        crc ^= b << 24
        for _ in range(8):
            crc = (crc << 1 ^ 0x04C11DB7 if crc & 0x80000000 else crc << 1) & 0xFFFFFFFF
    return crc


# Stream types of the program map.
STREAM_TYPES = {0x01: "mpeg1video", 0x02: "mpeg2video", 0x03: "mp1", 0x04: "mp2", 0x06: "private", 0x0F: "aac", 0x1B: "h264", 0x24: "h265", 0x81: "ac3"}


def write_ts(streams: dict[int, int], packets: list[tuple[int, int, bool, bytes]]) -> bytes:
    """streams: PID to stream type; packets: (PID, time in ns, key frame, payload) in order."""
    counter: dict[int, int] = {}

    def cut(pid: int, data: bytes, key: bool = False) -> bytes:
        out, first = [], True
        while data or first:
            n = counter.get(pid, 0)
            counter[pid] = (n + 1) & 15
            room = 184
            adapt = b""
            if first and key:
                adapt = b"\x01\x40"
            if len(data) < room - len(adapt):
                fill = room - len(data) - len(adapt)
                if adapt:
                    adapt = bytes([1 + fill]) + b"\x40" + b"\xff" * fill
                else:
                    adapt = b"\0" if fill == 1 else bytes([fill - 1]) + b"\0" + b"\xff" * (fill - 2)
            part, data = data[: room - len(adapt)], data[room - len(adapt) :]
            out.append(bytes([0x47, (0x40 if first else 0) | pid >> 8, pid & 255, (0x30 if adapt else 0x10) | n]) + adapt + part)
            first = False
        return b"".join(out)

    def section(table: int, body: bytes) -> bytes:
        s = bytes([table]) + (0xB000 | len(body) + 9).to_bytes(2, "big") + b"\0\x01\xc1\0\0" + body
        return b"\0" + s + mpeg_crc(s).to_bytes(4, "big")

    pmt = (0xE000 | next(iter(streams), 0x100)).to_bytes(2, "big") + b"\xf0\0" + b"".join(bytes([t]) + (0xE000 | p).to_bytes(2, "big") + b"\xf0\0" for p, t in streams.items())
    out = [cut(0, section(0, b"\0\x01\xf0\0")), cut(0x1000, section(2, pmt))]
    for pid, ns, key, payload in packets:
        t = ns * 90_000 // 1_000_000_000 & (1 << 33) - 1
        stamp = bytes([0x21 | t >> 29 & 14]) + (t >> 14 & 0xFFFE | 1).to_bytes(2, "big") + (t << 1 & 0xFFFE | 1).to_bytes(2, "big")
        video = STREAM_TYPES.get(streams[pid], "") in ("h264", "h265", "mpeg1video", "mpeg2video")
        size = len(payload) + 8
        head = b"\0\0\x01" + (b"\xe0" if video else b"\xc0") + (0 if video or size > 65535 else size).to_bytes(2, "big") + b"\x80\x80\x05" + stamp
        out.append(cut(pid, head + payload, key))
    return b"".join(out)


def read_ts(data: bytes) -> Iterator[Packet]:
    """Packets of the streams that the program map names; times in ns."""
    at = data.find(b"\x47")
    kinds: dict[int, str] = {}
    maps: set[int] = set()
    held: dict[int, tuple[bytearray, bool]] = {}

    def flush(pid: int) -> Iterator[Packet]:
        if pid not in held:
            return
        pes, key = held.pop(pid)
        if pes[:3] != b"\0\0\x01" or len(pes) < 9:
            return
        ns = None
        if pes[7] & 0x80 and len(pes) >= 14:
            b = pes[9:14]
            t = (b[0] >> 1 & 7) << 30 | b[1] << 22 | (b[2] >> 1) << 15 | b[3] << 7 | b[4] >> 1
            ns = t * 1_000_000_000 // 90_000
        size = int.from_bytes(pes[4:6], "big")
        yield pid, kinds[pid], ns, key, bytes(pes[9 + pes[8] : 6 + size if size else len(pes)])

    while 0 <= at and at + 188 <= len(data):
        if data[at] != 0x47:
            at = data.find(b"\x47", at + 1)
            continue
        p = data[at : at + 188]
        at += 188
        pid, begins, control = (p[1] & 31) << 8 | p[2], bool(p[1] & 0x40), p[3] >> 4 & 3
        body, key = 4, False
        if control & 2:
            key = p[4] > 0 and bool(p[5] & 0x40)
            body += 1 + p[4]
        if not control & 1 or body >= 188:
            continue
        part = p[body:]
        if begins and (pid == 0 or pid in maps):
            s = part[1 + part[0] :]
            if len(s) < 12:
                continue
            end = 3 + ((s[1] & 15) << 8 | s[2]) - 4
            if pid == 0:
                maps |= {(s[i + 2] & 31) << 8 | s[i + 3] for i in range(8, min(end, len(s) - 3), 4) if s[i] | s[i + 1]}
            else:
                i = 12 + ((s[10] & 15) << 8 | s[11])
                while i + 5 <= min(end, len(s)):
                    kinds[(s[i + 1] & 31) << 8 | s[i + 2]] = STREAM_TYPES.get(s[i], f"type{s[i]}")
                    i += 5 + ((s[i + 3] & 15) << 8 | s[i + 4])
        elif pid in kinds:
            if begins:
                yield from flush(pid)
                held[pid] = (bytearray(part), key)
            elif pid in held:
                held[pid][0].extend(part)
    for pid in list(held):
        yield from flush(pid)


# --- Matroska --------------------------------------------------------------------------------------------------------------------------


def ebml(ident: int, body: bytes) -> bytes:
    return ident.to_bytes((ident.bit_length() + 7) // 8, "big") + (1 << 56 | len(body)).to_bytes(8, "big") + body


def _number(x: int) -> bytes:
    return x.to_bytes(max(1, (x.bit_length() + 7) // 8), "big")


# Element ids of Matroska.
EBML, SEGMENT, TRACKS, TRACK, TRACK_NO, TRACK_TYPE, CODEC, CLUSTER, CLUSTER_TIME, SIMPLE_BLOCK, BLOCK_GROUP, BLOCK, INFO, SCALE = 0x1A45DFA3, 0x18538067, 0x1654AE6B, 0xAE, 0xD7, 0x83, 0x86, 0x1F43B675, 0xE7, 0xA3, 0xA0, 0xA1, 0x1549A966, 0x2AD7B1


def write_mkv(tracks: dict[int, str], packets: list[tuple[int, int, bool, bytes]]) -> bytes:
    """tracks: number (1..126) to codec id; packets: (track, ns, key frame, payload) in order. A cluster spans up to 30 seconds."""
    body = ebml(INFO, ebml(SCALE, _number(1_000_000))) + ebml(TRACKS, b"".join(ebml(TRACK, ebml(TRACK_NO, _number(n)) + ebml(TRACK_TYPE, _number(1 if c[:1] == "V" else 2)) + ebml(CODEC, c.encode())) for n, c in tracks.items()))
    begin, blocks = None, []
    for n, ns, key, payload in [*packets, (0, 1 << 62, False, b"")]:
        ms = ns // 1_000_000
        if begin is not None and not 0 <= ms - begin < 30_000:
            body += ebml(CLUSTER, ebml(CLUSTER_TIME, _number(begin)) + b"".join(blocks))
            begin, blocks = None, []
        if n:
            begin = ms if begin is None else begin
            blocks.append(ebml(SIMPLE_BLOCK, bytes([0x80 | n]) + (ms - begin).to_bytes(2, "big", signed=True) + bytes([0x80 if key else 0]) + payload))
    return ebml(EBML, ebml(0x4282, b"matroska")) + ebml(SEGMENT, body)


def read_mkv(data: bytes) -> Iterator[Packet]:
    """Blocks without lacing of all tracks; times in ns."""

    def elements(at: int, end: int) -> Iterator[tuple[int, int, int]]:
        while at < end:
            n = 9 - data[at].bit_length()
            if n > 4 or at + n >= end:
                return
            ident, at = int.from_bytes(data[at : at + n], "big"), at + n
            n = 9 - data[at].bit_length()
            if n > 8 or at + n > end:
                return
            size = int.from_bytes(data[at : at + n], "big") & (1 << 7 * n) - 1
            at += n
            stop = end if size == (1 << 7 * n) - 1 else min(end, at + size)
            yield ident, at, stop
            at = stop

    if data[:4] != EBML.to_bytes(4, "big"):
        raise ValueError("not a Matroska file")
    whole = lambda a, b: int.from_bytes(data[a:b], "big")
    codecs, scale = {}, 1_000_000

    def block(a: int, b: int, begin: int, simple: bool) -> Packet:
        n = 9 - data[a].bit_length()
        number = whole(a, a + n) & (1 << 7 * n) - 1
        t, flags = int.from_bytes(data[a + n : a + n + 2], "big", signed=True), data[a + n + 2]
        return number, codecs.get(number, ""), (begin + t) * scale, bool(flags & 0x80) or not simple, data[a + n + 3 : b]

    for top, a, b in elements(0, len(data)):
        if top != SEGMENT:
            continue
        for ident, a1, b1 in elements(a, b):
            if ident == INFO:
                scale = next((whole(x, y) for i, x, y in elements(a1, b1) if i == SCALE), scale)
            elif ident == TRACKS:
                for i, x, y in elements(a1, b1):
                    if i == TRACK:
                        f = {j: (p, q) for j, p, q in elements(x, y)}
                        codecs[whole(*f[TRACK_NO])] = data[slice(*f[CODEC])].decode("latin-1")
            elif ident == CLUSTER:
                begin = 0
                for i, x, y in elements(a1, b1):
                    if i == CLUSTER_TIME:
                        begin = whole(x, y)
                    elif i == SIMPLE_BLOCK and y - x > 4:
                        yield block(x, y, begin, True)
                    elif i == BLOCK_GROUP:
                        yield from (block(p, q, begin, False) for j, p, q in elements(x, y) if j == BLOCK)


# --- fragmented MP4 ---------------------------------------------------------------------------------------------------------------------


def box(kind: str, body: bytes) -> bytes:
    return (len(body) + 8).to_bytes(4, "big") + kind.encode("latin-1") + body


def boxes(data: bytes, at: int = 0, end: int | None = None) -> Iterator[tuple[str, int, int]]:
    """kind, and where the body begins and ends."""
    end = len(data) if end is None else end
    while at + 8 <= end:
        size, head = int.from_bytes(data[at : at + 4], "big"), 8
        if size == 1:
            size, head = int.from_bytes(data[at + 8 : at + 16], "big"), 16
        stop = end if size == 0 else at + size
        if size and size < head or stop > end:
            return
        yield data[at + 4 : at + 8].decode("latin-1"), at + head, stop
        at = stop


def write_fmp4(timescale: dict[int, int], samples: list[tuple[int, int, bool, bytes]]) -> bytes:
    """timescale: track to units a second; samples: (track, ns, key frame, payload), a fragment each."""
    full = lambda kind, body, version=0, flags=0: box(kind, bytes([version]) + flags.to_bytes(3, "big") + body)
    traks = b""
    for n, scale in timescale.items():
        tkhd = full("tkhd", b"\0" * 8 + n.to_bytes(4, "big") + b"\0" * 68)
        mdhd = full("mdhd", b"\0" * 8 + scale.to_bytes(4, "big") + b"\0" * 8)
        traks += box("trak", tkhd + box("mdia", mdhd + full("hdlr", b"\0" * 4 + b"vide" + b"\0" * 13)))
    out = [box("ftyp", b"iso5\0\0\0\0iso5"), box("moov", full("mvhd", b"\0" * 96) + traks)]
    for i, (n, ns, key, payload) in enumerate(samples):
        t = ns * timescale[n] // 1_000_000_000
        trun = lambda offset: full("trun", (1).to_bytes(4, "big") + offset.to_bytes(4, "big") + len(payload).to_bytes(4, "big") + (0 if key else 0x10000).to_bytes(4, "big"), flags=0x601)  # noqa: E731, B023
        moof = lambda offset: box("moof", full("mfhd", (i + 1).to_bytes(4, "big")) + box("traf", full("tfhd", n.to_bytes(4, "big"), flags=0x20000) + full("tfdt", t.to_bytes(8, "big"), 1) + trun(offset)))  # noqa: E731, B023
        out += [moof(len(moof(0)) + 8), box("mdat", payload)]
    return b"".join(out)


def read_fmp4(data: bytes) -> Iterator[Packet]:
    """Samples of all fragments; times in ns."""
    whole = lambda a, n: int.from_bytes(data[a : a + n], "big")
    scale: dict[int, int] = {}
    for kind, a, b in boxes(data):
        if kind == "moov":
            for k, x, y in boxes(data, a, b):
                if k == "trak":
                    inside = {i: (p, q) for i, p, q in boxes(data, x, y)}
                    number = whole(inside["tkhd"][0] + (20 if data[inside["tkhd"][0]] else 12), 4)
                    mdhd = next(p for i, p, _ in boxes(data, *inside["mdia"]) if i == "mdhd")
                    scale[number] = whole(mdhd + (20 if data[mdhd] else 12), 4)
        elif kind == "moof":
            origin = a - 8
            for k, x, y in boxes(data, a, b):
                if k != "traf":
                    continue
                inside = {i: p for i, p, _ in boxes(data, x, y)}
                number = whole(inside["tfhd"] + 4, 4)
                t = whole(inside["tfdt"] + 4, 8 if data[inside["tfdt"]] else 4)
                flags, count, at = whole(inside["trun"] + 1, 3), whole(inside["trun"] + 4, 4), inside["trun"] + 8
                offset = origin
                if flags & 1:
                    offset, at = origin + int.from_bytes(data[at : at + 4], "big", signed=True), at + 4
                first_flags = None
                if flags & 4:
                    first_flags, at = whole(at, 4), at + 4
                for j in range(count):
                    field = {}
                    for bit, name in ((0x100, "duration"), (0x200, "size"), (0x400, "flags"), (0x800, "shift")):
                        if flags & bit:
                            field[name], at = whole(at, 4), at + 4
                    sample_flags = first_flags if j == 0 and first_flags is not None else field.get("flags", 0)
                    size = field.get("size", 0)
                    yield number, "sample", t * 1_000_000_000 // scale.get(number, 1), not sample_flags & 0x10000, data[offset : offset + size]
                    offset, t = offset + size, t + field.get("duration", 0)


# --- elementary streams --------------------------------------------------------------------------------------------------------------


def split_annexb(data: bytes) -> list[bytes]:
    """NAL units between start codes."""
    out, at = [], data.find(b"\0\0\x01")
    while at >= 0:
        end = data.find(b"\0\0\x01", at + 3)
        out.append(data[at + 3 : end if end >= 0 else len(data)].rstrip(b"\0") if end >= 0 else data[at + 3 :])
        at = end
    return out


def h264_access_units(data: bytes) -> Iterator[Packet]:
    """Access units of H.264: a delimiter, parameter set or SEI behind a slice begins one, as does a slice whose first macroblock is 0."""
    unit, slices, key, n = [], False, False, 0
    for nal in split_annexb(data):
        kind = nal[0] & 31 if nal else 0
        new = slices and (kind in (6, 7, 8, 9) or kind in (1, 5) and len(nal) > 1 and nal[1] & 0x80)
        if new:
            yield 0, "h264", None, key, b"".join(b"\0\0\0\x01" + u for u in unit)
            unit, slices, key, n = [], False, False, n + 1
        unit.append(nal)
        slices |= kind in (1, 5)
        key |= kind == 5
    if unit:
        yield 0, "h264", None, key, b"".join(b"\0\0\0\x01" + u for u in unit)


def adts_frames(data: bytes) -> Iterator[Packet]:
    """AAC frames behind ADTS heads; 1024 samples each."""
    rates = [96000, 88200, 64000, 48000, 44100, 32000, 24000, 22050, 16000, 12000, 11025, 8000, 7350]  # fixed values
    at, samples = 0, 0
    while at + 7 <= len(data):
        if data[at] != 0xFF or data[at + 1] & 0xF6 != 0xF0:
            at += 1
            continue
        size, rate = (data[at + 3] & 3) << 11 | data[at + 4] << 3 | data[at + 5] >> 5, data[at + 2] >> 2 & 15
        if size < 7 or at + size > len(data) or rate >= len(rates):
            at += 1
            continue
        head = 7 if data[at + 1] & 1 else 9
        yield 0, "aac", samples * 1_000_000_000 // rates[rate], True, data[at + head : at + size]
        samples += 1024
        at += size


def opus_channels(packet: bytes) -> int:
    return 2 if packet and packet[0] & 4 else 1


def vp8_geometry(frame: bytes) -> tuple[bool, int, int]:
    """Whether a VP8 frame is a key frame, and its width and height then (else 0)."""
    if len(frame) < 10 or frame[0] & 1 or frame[3:6] != b"\x9d\x01\x2a":
        return False, 0, 0
    w, h = struct.unpack_from("<HH", frame, 6)
    return True, w & 0x3FFF, h & 0x3FFF


# --- records, KLV, checksums ------------------------------------------------------------------------------------------------------------


def write_records(payloads: list[bytes]) -> bytes:
    return b"".join(len(p).to_bytes(4, "little") + p for p in payloads)


def read_records(data: bytes) -> Iterator[bytes]:
    at = 0
    while at + 4 <= len(data):
        n = int.from_bytes(data[at : at + 4], "little")
        if at + 4 + n > len(data):
            return
        yield data[at + 4 : at + 4 + n]
        at += 4 + n


def ber_length(n: int) -> bytes:
    if n < 128:
        return bytes([n])
    body = _number(n)
    return bytes([128 | len(body)]) + body


def write_klv(items: list[tuple[int, bytes]]) -> bytes:
    """A local set: tags as BER-OID, lengths as BER."""
    out = b""
    for tag, value in items:
        oid = [tag & 127]
        while tag := tag >> 7:
            oid.insert(0, tag & 127 | 128)
        out += bytes(oid) + ber_length(len(value)) + value
    return out


def read_klv(data: bytes) -> Iterator[tuple[int, bytes]]:
    at = 0
    while at < len(data):
        tag = 0
        while at < len(data):
            tag, more, at = tag << 7 | data[at] & 127, data[at] & 128, at + 1
            if not more:
                break
        if at >= len(data):
            return
        n, at = data[at], at + 1
        if n & 128:
            k = n & 127
            n, at = int.from_bytes(data[at : at + k], "big"), at + k
        if at + n > len(data):
            return
        yield tag, data[at : at + n]
        at += n


def klv_checksum(data: bytes) -> int:
    """The 16-bit sum of big-endian words."""
    b = np.frombuffer(data + b"\0" * (len(data) % 2), ">u2")
    return int(b.sum(dtype=np.uint64)) & 0xFFFF


def fnv1a_64(data: bytes) -> int:
    h = 0xCBF29CE484222325
    for b in data:
        h = (h ^ b) * 0x100000001B3 & 0xFFFFFFFFFFFFFFFF
    return h


# --- PNG ------------------------------------------------------------------------------------------------------------------------------


def write_png(pixels: np.ndarray) -> bytes:
    """pixels: [height, width, 3 or 4] of uint8."""
    h, w, c = pixels.shape
    chunk = lambda kind, body: len(body).to_bytes(4, "big") + kind + body + zlib.crc32(kind + body).to_bytes(4, "big")
    rows = np.concatenate([np.zeros((h, 1), np.uint8), pixels.reshape(h, w * c)], axis=1)
    return b"\x89PNG\r\n\x1a\n" + chunk(b"IHDR", struct.pack(">IIBBBBB", w, h, 8, {3: 2, 4: 6}[c], 0, 0, 0)) + chunk(b"IDAT", zlib.compress(rows.tobytes())) + chunk(b"IEND", b"")


def read_png(data: bytes) -> np.ndarray:
    """8-bit grey, RGB or RGBA without interlacing, as RGBA."""
    if data[:8] != b"\x89PNG\r\n\x1a\n":
        raise ValueError("not a PNG file")
    at, packed, head = 8, b"", None
    while at + 8 <= len(data):
        n, kind = int.from_bytes(data[at : at + 4], "big"), data[at + 4 : at + 8]
        body = data[at + 8 : at + 8 + n]
        if kind == b"IHDR":
            head = struct.unpack(">IIBBBBB", body)
        elif kind == b"IDAT":
            packed += body
        at += 12 + n
    if head is None or head[2] != 8 or head[3] not in (0, 2, 6) or head[6]:
        raise ValueError("only 8-bit grey, RGB and RGBA PNG without interlacing")
    w, h, c = head[0], head[1], {0: 1, 2: 3, 6: 4}[head[3]]
    raw = np.frombuffer(zlib.decompress(packed), np.uint8).reshape(h, 1 + w * c)
    out = np.zeros((h + 1, w + 1, c), np.int64)  # with a border of zeros above and to the left
    for y in range(h):
        kind, row = raw[y, 0], raw[y, 1:].reshape(w, c).astype(np.int64)
        up = out[y, 1:]
        if kind in (0, 2):
            out[y + 1, 1:] = (row + (up if kind == 2 else 0)) & 255
            continue
        for x in range(w):
            a, b, d = out[y + 1, x], out[y, x + 1], out[y, x]
            if kind == 1:
                guess = a
            elif kind == 3:
                guess = (a + b) // 2
            else:
                p = a + b - d
                pa, pb, pd = np.abs(p - a), np.abs(p - b), np.abs(p - d)
                guess = np.where((pa <= pb) & (pa <= pd), a, np.where(pb <= pd, b, d))
            out[y + 1, x + 1] = (row[x] + guess) & 255
    px = out[1:, 1:].astype(np.uint8)
    if c == 1:
        px = np.repeat(px, 3, axis=2)
    return px if c == 4 else np.concatenate([px, np.full((h, w, 1), 255, np.uint8)], axis=2)
