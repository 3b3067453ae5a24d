"""Caps: what may flow over a link. Fields have a value, an inclusive range, a list, or are left open. Negotiation happens on the driver."""

from __future__ import annotations

import re
from dataclasses import dataclass, field

TOP = 2**32 - 1


@dataclass(frozen=True)
class Range:
    """Whole numbers from lo to hi; rates are counted in 65536ths."""

    lo: int = 0
    hi: int = TOP

    def meet(self, other: Range) -> Range | None:
        lo, hi = max(self.lo, other.lo), min(self.hi, other.hi)
        return Range(lo, hi) if lo <= hi else None

    @property
    def fixed(self) -> bool:
        return self.lo == self.hi

    @property
    def open(self) -> bool:
        return (self.lo, self.hi) == (0, TOP)


class CapsConflict(ValueError):
    """No caps suit both ends of a link."""


# Which fields count as ranges; media types whose channel count and rate of 0 stand for any.
RANGED = ("width", "height", "framerate")
PCM = "audio/x-raw"


@dataclass(frozen=True)
class Caps:
    media: str
    fields: tuple[tuple[str, object], ...] = field(default=())

    @classmethod
    def of(cls, media: str, **fields) -> Caps:
        return cls(media, tuple(sorted(fields.items())))

    def get(self, name: str):
        return dict(self.fields).get(name)

    def meet(self, other: Caps) -> Caps | None:
        """What both allow; None if nothing."""
        if self.media != other.media:
            return None
        a, b, out = dict(self.fields), dict(other.fields), {}
        for name in a.keys() | b.keys():
            if name not in a or name not in b:
                out[name] = a.get(name, b.get(name))
                continue
            x, y = a[name], b[name]
            if self.media == PCM and name in ("channels", "rate") and 0 in (x, y):
                out[name] = y if x == 0 else x
            elif isinstance(x, Range) or isinstance(y, Range):
                as_range = lambda v: v if isinstance(v, Range) else Range(v, v)
                if (m := as_range(x).meet(as_range(y))) is None:
                    return None
                out[name] = m
            elif isinstance(x, tuple) or isinstance(y, tuple):
                as_list = lambda v: v if isinstance(v, tuple) else (v,)
                both = tuple(v for v in as_list(x) if v in as_list(y))
                if not both:
                    return None
                out[name] = both if len(both) > 1 else both[0]
            elif x != y:
                return None
            else:
                out[name] = x
        return Caps.of(self.media, **out)

    def fixate(self) -> Caps:
        """The least of each range and the first of each list; an open range can't be fixed."""
        out = {}
        for name, v in self.fields:
            if isinstance(v, Range):
                if v.open:
                    raise CapsConflict(f"{name} of {self} is open")
                v = v.lo
            out[name] = v[0] if isinstance(v, tuple) else v
        return Caps.of(self.media, **out)

    @property
    def fixed(self) -> bool:
        return not any(isinstance(v, Range) and not v.fixed or isinstance(v, tuple) for _, v in self.fields)

    def __str__(self) -> str:
        rate = lambda q: f"{q // 65536}/1" if q % 65536 == 0 else f"{q}/65536"

        def show(name: str, v) -> str:
            each = rate if name == "framerate" else str
            if isinstance(v, Range):
                return each(v.lo) if v.fixed else f"[{each(v.lo)},{each(v.hi)}]"
            return "{" + ",".join(map(each, v)) + "}" if isinstance(v, tuple) else each(v)

        order = ["format", "width", "height", "framerate"]
        names = sorted(self.fields, key=lambda f: (order.index(f[0]) if f[0] in order else 9, f[0]))
        return ",".join([self.media, *(f"{n}={show(n, v)}" for n, v in names)])


def _value(name: str, text: str):
    text = re.sub(r"^\(\w+\)", "", text.strip()).strip('"')

    def one(t: str):
        t = t.strip()
        if name == "framerate" and (m := re.fullmatch(r"(\d+)/(\d+)", t)):
            return (int(m[1]) << 16) // int(m[2])
        return int(t) if re.fullmatch(r"-?\d+", t) else t

    if m := re.fullmatch(r"\[\s*(.+?)\s*,\s*(.+?)\s*\]", text):
        return Range(one(m[1]), one(m[2]))
    if m := re.fullmatch(r"\{(.*)\}", text):
        return tuple(map(one, m[1].split(",")))
    v = one(text)
    return Range(v, v) if name in RANGED and isinstance(v, int) else v


def parse(text: str) -> Caps:
    """media,name=value,... with [lo,hi] ranges and {a,b} lists."""
    parts = re.findall(r"(?:\[[^\]]*\]|\{[^}]*\}|\"[^\"]*\"|[^,\[{\"])+", text)
    media, rest = parts[0].strip(), parts[1:]
    fields = {}
    for p in rest:
        name, sep, value = p.partition("=")
        if not sep:
            raise ValueError(f"{p!r} isn't name=value")
        fields[name.strip()] = _value(name.strip(), value)
    return Caps.of(media, **fields)


def meet_all(sets: list[list[Caps]]) -> list[Caps]:
    """The caps that every set of alternatives allows, in the first one's order of preference."""
    out = sets[0]
    for s in sets[1:]:
        out = list(dict.fromkeys(m for a in out for b in s if (m := a.meet(b)) is not None))
        if not out:
            raise CapsConflict("no alternative suits all")
    return out
