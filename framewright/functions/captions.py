"""Captions and bitmap subtitles in bytes: CEA-608 pairs, SEI messages, teletext rows, and run lengths of DVD and Blu-ray subpictures."""

from __future__ import annotations

from collections.abc import Iterator

import numpy as np

# --- CEA-608, first channel --------------------------------------------------------------------------------------------------------

# Control codes of channel 1 (second byte behind 0x14), and characters that differ from ASCII.
RESUME_LOADING, ERASE_DISPLAYED, CARRIAGE_RETURN, ERASE_LOADED, END_OF_CAPTION = 0x20, 0x2C, 0x2D, 0x2E, 0x2F
ROLL_UP = {0x25: 2, 0x26: 3, 0x27: 4}
SPECIAL = {0x2A: "á", 0x5C: "é", 0x5E: "í", 0x5F: "ó", 0x60: "ú", 0x7B: "ç", 0x7C: "÷", 0x7D: "Ñ", 0x7E: "ñ", 0x7F: "█"}
TO_CODE = {c: b for b, c in SPECIAL.items()}


def odd_parity(b: int) -> int:
    return b & 127 | (0 if bin(b & 127).count("1") % 2 else 128)


def encode_608(text: str) -> list[tuple[int, int]]:
    """Pairs of a pop-on caption: load, rows, show. Characters that 608 lacks become spaces."""
    pairs = [(0x14, RESUME_LOADING), (0x14, ERASE_LOADED)]
    for i, line in enumerate(text.split("\n")[:2]):
        pairs.append((0x14, 0x40 if i == 0 else 0x60))
        codes = [TO_CODE.get(c, ord(c) if " " <= c <= "z" and ord(c) not in SPECIAL else 0x20) for c in line[:32]]
        codes += [0] * (len(codes) % 2)
        pairs += zip(codes[::2], codes[1::2], strict=True)
    pairs.append((0x14, END_OF_CAPTION))
    return [(odd_parity(a), odd_parity(b)) for a, b in pairs]


def decode_608(pairs: list[tuple[int, int, int]]) -> Iterator[tuple[int, int | None, str]]:
    """(ns, byte, byte) to cues (start, end or None, text). Pop-on shows what was loaded; roll-up shows rows as they come. Repeated control pairs count once."""
    loaded: dict[int, str] = {}
    shown: dict[int, str] = {}
    row, rolling, begin, last = 15, 0, 0, None

    def text(rows: dict[int, str]) -> str:
        return "\n".join(rows[r].strip() for r in sorted(rows) if rows[r].strip())

    for ns, a, b in pairs:
        if odd_parity(a) != a or odd_parity(b) != b:
            continue
        a, b = a & 127, b & 127
        if 0x10 <= a <= 0x1F:
            if (a, b) == last:
                last = None
                continue
            last = (a, b)
            if a == 0x14 and b == RESUME_LOADING:
                rolling = 0
            elif a == 0x14 and b in ROLL_UP:
                rolling, begin = ROLL_UP[b], ns
            elif a == 0x14 and b == ERASE_LOADED:
                loaded = {}
            elif a == 0x14 and b in (ERASE_DISPLAYED, END_OF_CAPTION, CARRIAGE_RETURN):
                if text(shown):
                    yield begin, ns, text(shown)
                if b == END_OF_CAPTION:
                    shown, loaded = loaded, {}
                elif b == ERASE_DISPLAYED:
                    shown = {}
                else:
                    shown = {r - 1: t for r, t in shown.items() if r - 1 > 15 - rolling} if rolling else {}
                begin = ns
            elif b >= 0x40:
                row = {0x11: 1, 0x12: 3, 0x15: 5, 0x16: 7, 0x17: 9, 0x10: 11, 0x13: 12, 0x14: 14}.get(a, 14) + (b >> 5 & 1)
            continue
        last = None
        into = shown if rolling else loaded
        at = 15 if rolling else row
        into[at] = into.get(at, "") + "".join(SPECIAL.get(c, chr(c)) for c in (a, b) if c >= 0x20)
    if text(shown):
        yield begin, None, text(shown)


# --- SEI messages of H.264 -----------------------------------------------------------------------------------------------------------

#: The identifier of MISP microsecond time.
MISP = b"MISPmicrosectime"


def escaped(body: bytes) -> bytes:
    """With an emulation prevention byte where a start code would show."""
    out, zeros = bytearray(), 0
    for b in body:
        if zeros >= 2 and b <= 3:
            out.append(3)
            zeros = 0
        out.append(b)
        zeros = zeros + 1 if b == 0 else 0
    return bytes(out)


def unescaped(body: bytes) -> bytes:
    return body.replace(b"\0\0\x03", b"\0\0")


def sei(kind: int, payload: bytes) -> bytes:
    """An SEI unit with its start code."""
    number = lambda n: b"\xff" * (n // 255) + bytes([n % 255])
    return b"\0\0\0\x01\x06" + escaped(number(kind) + number(len(payload)) + payload + b"\x80")


def sei_messages(access_unit: bytes) -> Iterator[tuple[int, bytes]]:
    from framewright.functions.containers import split_annexb

    for nal in split_annexb(access_unit):
        if not nal or nal[0] & 31 != 6:
            continue
        body, at = unescaped(nal[1:]), 0
        while at + 2 <= len(body) and body[at] != 0x80:
            number = [0, 0]
            for i in range(2):
                while at < len(body) and body[at] == 255:
                    number[i], at = number[i] + 255, at + 1
                if at >= len(body):
                    return
                number[i], at = number[i] + body[at], at + 1
            yield number[0], body[at : at + number[1]]
            at += number[1]


def misp_sei(us: int, status: int = 0x1F) -> bytes:
    """Microseconds as eight bytes, with 0xFF behind every second one but the last."""
    b = us.to_bytes(8, "big")
    return sei(5, MISP + bytes([status]) + b[:2] + b"\xff" + b[2:4] + b"\xff" + b[4:6] + b"\xff" + b[6:])


def misp_time(access_unit: bytes) -> int | None:
    for kind, p in sei_messages(access_unit):
        if kind == 5 and p[:16] == MISP and len(p) >= 28:
            t = p[17:28]
            return int.from_bytes(t[:2] + t[3:5] + t[6:8] + t[9:11], "big")
    return None


def caption_sei(pairs: list[tuple[int, int]]) -> bytes:
    """cc_data of the first field as user data."""
    body = b"\xb5\0\x31GA94\x03" + bytes([0x40 | len(pairs), 0xFF]) + b"".join(bytes([0xFC, a, b]) for a, b in pairs) + b"\xff"
    return sei(4, body)


def caption_pairs(access_unit: bytes) -> list[tuple[int, int]]:
    out = []
    for kind, p in sei_messages(access_unit):
        if kind == 4 and p[:8] == b"\xb5\0\x31GA94\x03" and len(p) > 10:
            for i in range(p[8] & 31):
                t = p[10 + 3 * i : 13 + 3 * i]
                if len(t) == 3 and t[0] & 7 == 4:
                    out.append((t[1], t[2]))
    return out


# --- teletext ------------------------------------------------------------------------------------------------------------------------


def hamming84(nibble: int) -> int:
    """Four data bits with their four check bits, as Hamming 8/4 of EBU teletext."""
    d = [nibble >> i & 1 for i in range(4)]
    p1, p2, p3 = 1 ^ d[0] ^ d[2] ^ d[3], 1 ^ d[0] ^ d[1] ^ d[3], 1 ^ d[0] ^ d[1] ^ d[2]
    p4 = 1 ^ p1 ^ d[0] ^ p2 ^ d[1] ^ p3 ^ d[2] ^ d[3]
    return sum(b << i for i, b in enumerate((p1, d[0], p2, d[1], p3, d[2], p4, d[3])))


UNHAM = {hamming84(n) ^ (1 << bit if bit < 8 else 0): n for n in range(16) for bit in range(9)}


def teletext_row(magazine: int, row: int, text: str) -> bytes:
    """A display row of 42 bytes: address and forty characters of odd parity."""
    address = magazine % 8 | row << 3
    return bytes([hamming84(address & 15), hamming84(address >> 4)]) + bytes(odd_parity(ord(c)) for c in text[:40].ljust(40))


def read_teletext_row(packet: bytes) -> tuple[int, int, str] | None:
    """Magazine, row and text; one wrong bit in the address is put right, two make it None, and wrong characters become spaces."""
    a, b = UNHAM.get(packet[0]), UNHAM.get(packet[1])
    if a is None or b is None:
        return None
    text = "".join(chr(c & 127) if odd_parity(c) == c and c & 127 >= 32 else " " for c in packet[2:42])
    return a & 7 or 8, a >> 3 | b << 1, text.strip()


# --- bitmap subtitles --------------------------------------------------------------------------------------------------------------------


def dvd_runs(data: bytes, width: int, height: int) -> np.ndarray:
    """One field's lines of DVD run lengths as colours 0..3: nibbles nnCC, 00nn nnCC, 0000 nnnn nnCC, 0000 00nn nnnn nnCC; 0 runs to the line's end."""
    nibbles = np.frombuffer(data, np.uint8).repeat(2).reshape(-1, 2)
    flat = np.column_stack([nibbles[:, 0] >> 4, nibbles[:, 1] & 15]).ravel().tolist()
    out, at = np.zeros((height, width), np.uint8), 0
    for y in range(height):
        x = 0
        while x < width and at < len(flat):
            code, n = flat[at], 1
            while code < 1 << 2 * n and n < 4 and at + n < len(flat):
                code, n = code << 4 | flat[at + n], n + 1
            at += n
            run, colour = code >> 2, code & 3
            run = run or width - x
            out[y, x : x + run] = colour
            x += run
        at += at % 2
    return out


def dvd_pack(lines: np.ndarray) -> bytes:
    out: list[int] = []
    for line in lines:
        x = 0
        while x < len(line):
            run = 1
            while x + run < len(line) and line[x + run] == line[x] and run < 255:
                run += 1
            code = run << 2 | int(line[x])
            n = 1 if run < 4 else 2 if run < 16 else 3 if run < 64 else 4
            out += [code >> 4 * (n - 1 - i) & 15 for i in range(n)]
            x += run
        out += [0] * (len(out) % 2)
    return bytes(a << 4 | b for a, b in zip(out[::2], out[1::2], strict=True))


def pgs_runs(data: bytes, width: int, height: int) -> np.ndarray:
    """Blu-ray run lengths as palette entries."""
    out, at, x, y = np.zeros((height, width), np.uint8), 0, 0, 0
    while at < len(data) and y < height:
        c, at = data[at], at + 1
        run = 1
        if c == 0:
            if at >= len(data):
                break
            head, at = data[at], at + 1
            if head == 0:
                x, y = 0, y + 1
                continue
            run = head & 63
            if head & 64:
                run, at = run << 8 | data[at], at + 1
            if head & 128:
                c, at = data[at], at + 1
        out[y, x : x + run] = c
        x += run
    return out


def pgs_pack(lines: np.ndarray) -> bytes:
    out = bytearray()
    for line in lines:
        x = 0
        while x < len(line):
            run = 1
            while x + run < len(line) and line[x + run] == line[x] and run < 16383:
                run += 1
            c = int(line[x])
            if c and run < 3:
                out += bytes([c] * run)
            else:
                head = bytes([(128 if c else 0) | run]) if run < 64 else bytes([(192 if c else 64) | run >> 8, run & 255])
                out += b"\0" + head + (bytes([c]) if c else b"")
            x += run
        out += b"\0\0"
    return bytes(out)


def canvas(entries: np.ndarray, palette: dict[int, tuple[int, int, int, int]]) -> np.ndarray:
    """RGBA of palette entries; unknown ones are clear."""
    table = np.zeros((256, 4), np.uint8)
    for i, c in palette.items():
        table[i] = c
    return table[entries]
