"""Progressive MP4, AV1 units, VP9 heads, FLAC frames, program streams, A-law and HLS playlists, in bytes and text."""

from __future__ import annotations

from collections.abc import Iterator

import numpy as np

from framewright.functions.containers import Packet, box, boxes


def write_mp4(samples: list[tuple[int, bool, bytes]], timescale: int = 90_000) -> bytes:
    """One track, whole: (ns, key frame, payload) in order. Samples come first, so offsets are known."""
    full = lambda kind, body: box(kind, b"\0\0\0\0" + body)
    u32 = lambda *x: b"".join(int(v).to_bytes(4, "big") for v in x)
    head = box("ftyp", b"isom\0\0\0\0isom")
    mdat = box("mdat", b"".join(p for _, _, p in samples))
    offsets, at = [], len(head) + 8
    for _, _, p in samples:
        offsets.append(at)
        at += len(p)
    ticks = [ns * timescale // 1_000_000_000 for ns, _, _ in samples]
    deltas = [b - a for a, b in zip(ticks, ticks[1:], strict=False)] + [0] * bool(ticks)
    keys = [i + 1 for i, (_, k, _) in enumerate(samples) if k]
    stbl = box(
        "stbl",
        full("stts", u32(len(deltas)) + b"".join(u32(1, d) for d in deltas))
        + full("stsc", u32(1, 1, 1, 1))
        + full("stsz", u32(0, len(samples), *(len(p) for _, _, p in samples)))
        + full("stco", u32(len(offsets), *offsets))
        + full("stss", u32(len(keys), *keys)),
    )
    mdia = box("mdia", full("mdhd", b"\0" * 8 + u32(timescale) + b"\0" * 8) + box("minf", stbl))
    trak = box("trak", full("tkhd", b"\0" * 8 + u32(1) + b"\0" * 68) + mdia)
    return head + mdat + box("moov", trak)


def read_mp4(data: bytes) -> Iterator[Packet]:
    """Samples of all tracks of a whole-file MP4; times in ns. Composition offsets are not applied."""
    u32 = lambda at, n=4: int.from_bytes(data[at : at + n], "big")

    def down(a: int, b: int, *path: str) -> tuple[int, int] | None:
        for kind in path:
            found = next(((x, y) for k, x, y in boxes(data, a, b) if k == kind), None)
            if found is None:
                return None
            a, b = found
        return a, b

    moov = down(0, len(data), "moov")
    for kind, a, b in boxes(data, *moov) if moov else ():
        stbl, mdhd, tkhd = down(a, b, "mdia", "minf", "stbl"), down(a, b, "mdia", "mdhd"), down(a, b, "tkhd")
        if kind != "trak" or not (stbl and mdhd and tkhd):
            continue
        t = {k: x + 4 for k, x, _ in boxes(data, *stbl)}
        scale = u32(mdhd[0] + (20 if data[mdhd[0]] else 12))
        number = u32(tkhd[0] + (20 if data[tkhd[0]] else 12))
        count = u32(t["stsz"] + 4)
        sizes = [u32(t["stsz"]) or u32(t["stsz"] + 8 + 4 * i) for i in range(count)]
        ticks, now = [], 0
        for i in range(u32(t["stts"])):
            n, d = u32(t["stts"] + 4 + 8 * i), u32(t["stts"] + 8 + 8 * i)
            for _ in range(min(n, count - len(ticks))):
                ticks.append(now)
                now += d
        keys = {u32(t["stss"] + 4 + 4 * i) for i in range(u32(t["stss"]))} if "stss" in t else None
        wide = "co64" in t
        table, width = (t["co64"], 8) if wide else (t["stco"], 4)
        chunks = [u32(table + 4 + width * i, width) for i in range(u32(table))]
        runs = [(u32(t["stsc"] + 4 + 12 * i), u32(t["stsc"] + 8 + 12 * i)) for i in range(u32(t["stsc"]))]
        n, run = 0, 0
        for c, offset in enumerate(chunks, 1):
            while run + 1 < len(runs) and runs[run + 1][0] <= c:
                run += 1
            for _ in range(runs[run][1] if runs else 0):
                if n >= min(count, len(ticks)) or offset + sizes[n] > len(data):
                    break
                yield number, "sample", ticks[n] * 1_000_000_000 // max(1, scale), keys is None or n + 1 in keys, data[offset : offset + sizes[n]]
                offset += sizes[n]
                n += 1


def leb128(data: bytes, at: int) -> tuple[int, int]:
    value = shift = 0
    while at < len(data):
        value, at, more = value | (data[at] & 127) << shift, at + 1, data[at] & 128
        if not more:
            break
        shift += 7
    return value, at


def av1_units(data: bytes) -> Iterator[tuple[int, bytes]]:
    """Type and body of each OBU; one without a size reaches to the end."""
    at = 0
    while at < len(data):
        head = data[at]
        at += 2 if head & 4 else 1
        size, at = leb128(data, at) if head & 2 else (len(data) - at, at)
        if at + size > len(data):
            return
        yield head >> 3 & 15, data[at : at + size]
        at += size


def av1_temporal_units(data: bytes) -> Iterator[list[tuple[int, bytes]]]:
    """OBUs between temporal delimiters (type 2)."""
    unit: list[tuple[int, bytes]] = []
    for kind, body in av1_units(data):
        if kind == 2 and unit:
            yield unit
            unit = []
        unit.append((kind, body))
    if unit:
        yield unit


def vp9_key_frame(frame: bytes) -> tuple[bool, int, int]:
    """Whether a profile 0 VP9 frame is a key frame, and its width and height then (else 0)."""
    if len(frame) < 10 or frame[0] & 0xF8 != 0x80 or frame[0] & 4 or frame[1:4] != b"\x49\x83\x42":
        return False, 0, 0
    bits = int.from_bytes(frame[4:10], "big")  # colour space (3), range (1), then the size, each less 1
    return True, (bits >> 28 & 0xFFFF) + 1, (bits >> 12 & 0xFFFF) + 1


def crc_table(bits: int, poly: int) -> list[int]:
    """What each byte does to a checksum of that many bits, highest bit first."""
    out, top, mask = [], 1 << bits - 1, (1 << bits) - 1
    for byte in range(256):
        crc = byte << bits - 8
        for _ in range(8):
            crc = (crc << 1 ^ (poly if crc & top else 0)) & mask
        out.append(crc)
    return out


CRC8, CRC16 = crc_table(8, 0x07), crc_table(16, 0x8005)


def crc8(data: bytes) -> int:
    crc = 0
    for b in data:
        crc = CRC8[crc ^ b]
    return crc


def crc16(data: bytes) -> int:
    crc = 0
    for b in data:
        crc = (crc << 8 & 0xFF00) ^ CRC16[crc >> 8 ^ b]
    return crc


def coded_number(n: int) -> bytes:
    """FLAC's extension of UTF-8 to 36 bits."""
    if n < 0x80:
        return bytes([n])
    more = next(m for m in range(1, 7) if n < 1 << 6 * m + max(0, 6 - m))
    lead = 0xFF << 7 - more & 0xFF | n >> 6 * more
    return bytes([lead, *(0x80 | n >> 6 * i & 0x3F for i in range(more - 1, -1, -1))])


def flac_head(data: bytes, at: int) -> tuple[int, bool, int, int | None] | None:
    """length, whether blocks vary in size, number and block size (rate code apart) of a frame head whose checksum holds; else None."""
    if len(data) < at + 6 or data[at] != 0xFF or data[at + 1] & 0xFE != 0xF8 or data[at + 3] & 1:
        return None
    size_code, rate_code, lead = data[at + 2] >> 4, data[at + 2] & 15, data[at + 4]
    more = 0 if lead < 0x80 else 7 - (lead ^ 0xFF).bit_length()
    if size_code == 0 or rate_code == 15 or lead >= 0x80 and not 1 <= more <= 6:
        return None
    number = lead if lead < 0x80 else lead & (1 << 6 - more) - 1
    for b in data[at + 5 : at + 5 + more]:
        if b >> 6 != 2:
            return None
        number = number << 6 | b & 0x3F
    end = at + 5 + more
    wide = {6: 1, 7: 2}.get(size_code, 0)
    size = int.from_bytes(data[end : end + wide], "big") + 1 if wide else 192 if size_code == 1 else 576 << size_code - 2 if size_code < 6 else 256 << size_code - 8
    end += wide + {12: 1, 13: 2, 14: 2}.get(rate_code, 0)
    if end >= len(data) or crc8(data[at:end]) != data[end]:
        return None
    return end + 1 - at, bool(data[at + 1] & 1), number, size


def read_flac(data: bytes) -> Iterator[Packet]:
    """Frames of a native FLAC stream, whole, at the times of their first samples. A frame ends where a head follows with the number that is
    next and its checksum holds, or at the end of the stream; bytes that form no frame are passed over."""
    if data[:4] != b"fLaC":
        raise ValueError("no FLAC stream")
    at, rate, block = 4, 0, 0
    while at + 4 <= len(data):
        kind, size = data[at], int.from_bytes(data[at + 1 : at + 4], "big")
        if kind & 0x7F == 0 and size >= 18:
            info = data[at + 4 : at + 4 + size]
            block, rate = int.from_bytes(info[2:4], "big"), int.from_bytes(info[10:13], "big") >> 4
        at += 4 + size
        if kind & 0x80:
            break
    if not rate:
        raise ValueError("a FLAC stream without its rate")
    while at < len(data):
        head = flac_head(data, at)
        if head is None:
            at = data.find(b"\xff", at + 1)
            if at < 0:
                return
            continue
        length, varies, number, size = head
        follows = number + (size if varies else 1)
        end = data.find(b"\xff", at + length)
        while end >= 0:
            after = flac_head(data, end)
            if after and after[2] == follows and crc16(data[at:end]) == 0:
                break
            end = data.find(b"\xff", end + 1)
        if end < 0:
            end = len(data)
            if crc16(data[at:end]):
                at += 1
                continue
        yield 0, "flac", (number if varies else number * block) * 1_000_000_000 // rate, True, data[at:end]
        at = end


def write_flac(rate: int, bodies: list[bytes]) -> bytes:
    """A stream of stereo 16-bit frames of 4096 samples around subframes that are coded already."""
    info = (4096).to_bytes(2, "big") * 2 + b"\0" * 6 + (rate << 44 | 1 << 41 | 15 << 36 | 4096 * len(bodies)).to_bytes(8, "big") + b"\0" * 16
    out = [b"fLaC\x80" + len(info).to_bytes(3, "big") + info]
    for n, body in enumerate(bodies):
        head = b"\xff\xf8\xc0\x18" + coded_number(n)
        frame = head + bytes([crc8(head)]) + body
        out.append(frame + crc16(frame).to_bytes(2, "big"))
    return b"".join(out)


def read_ps(data: bytes) -> Iterator[Packet]:
    """PES packets of an MPEG program stream: stream id as the track, times in ns."""
    at = data.find(b"\0\0\x01")
    while 0 <= at and at + 6 <= len(data):
        sid = data[at + 3]
        if sid == 0xBA:
            at += 14 + (data[at + 13] & 7) if len(data) > at + 13 and data[at + 4] >> 6 == 1 else 12
        elif sid == 0xB9:
            return
        else:
            end = at + 6 + int.from_bytes(data[at + 4 : at + 6], "big")
            if end > len(data):
                return
            if sid == 0xBD or 0xC0 <= sid <= 0xEF:
                ns = None
                if data[at + 7] & 0x80:
                    b = data[at + 9 : at + 14]
                    ticks = (b[0] >> 1 & 7) << 30 | b[1] << 22 | b[2] >> 1 << 15 | b[3] << 7 | b[4] >> 1
                    ns = ticks * 1_000_000_000 // 90_000
                kind = "private" if sid == 0xBD else "audio" if sid < 0xE0 else "video"
                yield sid, kind, ns, False, data[at + 9 + data[at + 8] : end]
            at = end
        at = data.find(b"\0\0\x01", at)


def subpicture_unit(data: bytes, track: int) -> bytes | None:
    """The first subtitle unit of a track (private substream 0x20 + track) in program stream packets; its first two bytes are its length."""
    unit = b""
    for sid, _, _, _, body in read_ps(data):
        if sid == 0xBD and body[:1] == bytes([0x20 + track]):
            unit += body[1:]
            if len(unit) >= 2 and len(unit) >= (size := int.from_bytes(unit[:2], "big")):
                return unit[:size]
    return None


def alaw_encode(s: np.ndarray) -> np.ndarray:
    """G.711 A-law of 16-bit samples."""
    s = s.astype(np.int64)
    size = np.where(s >= 0, s >> 3, -(s >> 3) - 1)  # 12 bits, the sign apart
    segment = np.maximum(0, np.floor(np.log2(np.maximum(size, 1))).astype(np.int64) - 4)
    mantissa = size >> np.maximum(1, segment) & 15
    return ((np.where(s >= 0, 0x80, 0) | segment << 4 | mantissa) ^ 0x55).astype(np.uint8)


def alaw_decode(codes: np.ndarray) -> np.ndarray:
    x = codes.astype(np.int64) ^ 0x55
    segment, mantissa = x >> 4 & 7, x & 15
    size = np.where(segment == 0, mantissa * 16 + 8, (mantissa * 16 + 264) << np.maximum(0, segment - 1))
    return np.where(x & 0x80, size, -size)


def hls_playlist(segments: list[tuple[int, str]], first: int, ended: bool) -> str:
    """A media playlist: (duration in ns, address) of each segment; first is the number of the first."""
    longest = max((-(-ns // 1_000_000_000) for ns, _ in segments), default=0)
    lines = ["#EXTM3U", "#EXT-X-VERSION:7", f"#EXT-X-TARGETDURATION:{longest}", f"#EXT-X-MEDIA-SEQUENCE:{first}"]
    for ns, uri in segments:
        lines += [f"#EXTINF:{ns / 1e9:.6f},", uri]
    return "\n".join([*lines, *["#EXT-X-ENDLIST"] * ended]) + "\n"
