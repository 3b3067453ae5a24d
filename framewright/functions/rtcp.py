"""RTCP compound packets: sender and receiver reports, descriptions, goodbyes."""

from __future__ import annotations

import struct
from collections.abc import Iterator

# Packet types.
KINDS = {200: "SR", 201: "RR", 202: "SDES", 203: "BYE", 204: "APP", 205: "RTPFB", 206: "PSFB"}


def parse_compound(data: bytes) -> Iterator[dict]:
    """A record for each packet; what is cut short ends the walk."""
    at = 0
    while at + 8 <= len(data):
        head, kind, words = data[at], data[at + 1], int.from_bytes(data[at + 2 : at + 4], "big")
        end = at + 4 * (words + 1)
        if head >> 6 != 2 or end > len(data):
            return
        out = {"kind": KINDS.get(kind, str(kind)), "ssrc": int.from_bytes(data[at + 4 : at + 8], "big"), "count": head & 31}
        body = at + 8
        if kind == 200 and body + 20 <= end:
            out |= dict(zip(("ntp", "rtp_ts", "packets", "octets"), struct.unpack_from(">QIII", data, body), strict=True))
            body += 20
        if kind in (200, 201):
            out["blocks"] = []
            while len(out["blocks"]) < head & 31 and body + 24 <= end:
                ssrc, loss, highest, jitter, last_sr, delay = struct.unpack_from(">IIIIII", data, body)
                lost = loss & 0xFFFFFF
                out["blocks"].append({"ssrc": ssrc, "fraction": loss >> 24, "lost": lost - (1 << 24) if lost >> 23 else lost, "highest": highest, "jitter": jitter, "last_sr": last_sr, "delay": delay})
                body += 24
        yield out
        at = end


def sender_report(ssrc: int, ntp: int, rtp_ts: int, packets: int, octets: int, blocks: list[dict]) -> bytes:
    body = struct.pack(">IQIII", ssrc, ntp, rtp_ts & 0xFFFFFFFF, packets, octets)
    for b in blocks:
        body += struct.pack(">IIIIII", b["ssrc"], b["fraction"] << 24 | b["lost"] & 0xFFFFFF, b["highest"], b["jitter"], b["last_sr"], b["delay"])
    return bytes([0x80 | len(blocks), 200]) + (len(body) // 4).to_bytes(2, "big") + body


#: Seconds from 1900, where NTP counts from, to 1970.
NTP_EPOCH = 2_208_988_800


def ntp_of(unix_ns: int) -> int:
    seconds, rest = divmod(unix_ns, 1_000_000_000)
    return seconds + NTP_EPOCH << 32 | (rest << 32) // 1_000_000_000


def unix_of(ntp: int) -> int:
    return ((ntp >> 32) - NTP_EPOCH) * 1_000_000_000 + ((ntp & 0xFFFFFFFF) * 1_000_000_000 + (1 << 31) >> 32)
