"""Pipelines as text, as documents or built in Python, checked on the driver and lowered to one DataFrame for each link.

    launch(spark, "videotestsrc num-buffers=30 ! video/x-raw,width=320 ! videorate-free ! fakesink")

Nodes are elements of ELEMENTS; a link carries a DataFrame. The lowering only composes lazy DataFrames, so Catalyst sees one plan.
"""

from __future__ import annotations

import shlex
from collections.abc import Callable
from dataclasses import dataclass, field

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from framewright.operators import flow
from framewright.plans import caps as caps_of
from framewright.plans.inventory import BOUNDARY
from framewright.catalog import query
from framewright.sources import synthetic


@dataclass
class Node:
    name: str
    element: str
    props: dict[str, str] = field(default_factory=dict)


@dataclass
class Graph:
    nodes: dict[str, Node] = field(default_factory=dict)
    links: list[tuple[str, str]] = field(default_factory=list)

    def add(self, element: str, name: str | None = None, **props) -> str:
        name = name or f"{element}{sum(n.element == element for n in self.nodes.values())}"
        if name in self.nodes:
            raise ValueError(f"two nodes are called {name}")
        self.nodes[name] = Node(name, element, {k.replace("_", "-"): str(v) for k, v in props.items()})
        return name

    def link(self, *names: str) -> Graph:
        self.links += zip(names, names[1:], strict=False)
        return self

    def order(self) -> list[str]:
        """Sources first; an error for unknown nodes and cycles."""
        for a, b in self.links:
            for x in (a, b):
                if x not in self.nodes:
                    raise ValueError(f"no node is called {x}")
        todo, out = {n: {a for a, b in self.links if b == n} for n in self.nodes}, []
        while todo:
            ready = [n for n, before in todo.items() if not before]
            if not ready:
                raise ValueError(f"the links run in a circle: {sorted(todo)}")
            out += ready
            todo = {n: before - set(ready) for n, before in todo.items() if n not in ready}
        return out


def parse_launch(text: str) -> Graph:
    """element prop=value ... ! element ...; name=x names a node, x. links from or to it; caps stand for a capsfilter."""
    g, last, linked = Graph(), None, False
    for token in shlex.split(text):
        if token == "!":
            if last is None or linked:
                raise ValueError("a link needs a node on its left")
            linked = True
        elif token.endswith(".") and token[:-1]:
            if linked:
                g.link(last, token[:-1])
                last, linked = None, False
            else:
                last = token[:-1]
        elif "/" in token.split(",")[0].split("=")[0]:
            node = g.add("capsfilter", caps=token)
            if linked:
                g.link(last, node)
            last, linked = node, False
        elif "=" in token:
            if last is None or linked:
                raise ValueError(f"{token} belongs to no element")
            key, _, value = token.partition("=")
            if key == "name":
                g.nodes[value] = Node(value, g.nodes[last].element, g.nodes.pop(last).props)
                g.links = [(value if a == last else a, value if b == last else b) for a, b in g.links]
                last = value
            else:
                g.nodes[last].props[key] = value
        else:
            node = g.add(token)
            if linked:
                g.link(last, node)
            last, linked = node, False
    if linked:
        raise ValueError("the last link leads nowhere")
    return g


def from_document(doc: dict) -> Graph:
    """{nodes: [{name, element, properties}], edges: [[from, to]]} or {pipeline: text}."""
    if "pipeline" in doc:
        return parse_launch(doc["pipeline"])
    g = Graph()
    for n in doc.get("nodes", []):
        g.add(n["element"], n.get("name"), **n.get("properties", {}))
    for a, b in doc.get("edges", []):
        g.link(a, b)
    return g


Element = Callable[[SparkSession, list[DataFrame], dict[str, str]], DataFrame]
ELEMENTS: dict[str, Element] = {}
#: Names by which elements are known besides their own.
ALIASES = {"queue2": "queue", "multiqueue": "queue", "autovideosink": "fakesink", "autoaudiosink": "fakesink", "interleave": "funnel", "videoconvertscale": "videoscale"}
#: The property by which lower() tells an element the caps of the filter behind it.
WANTED = "-caps-downstream"
#: Elements between a converter and the filter whose caps it follows.
THROUGH = ("videoconvert", "videoscale", "videorate", "audioconvert", "audioresample", "queue", "identity")


def wanted_caps(g: Graph, n: str) -> str | None:
    """The caps of the filter that node n's stream meets next, if only elements of THROUGH lie between."""
    while len(after := [b for a, b in g.links if a == n]) == 1:
        n = after[0]
        if g.nodes[n].element == "capsfilter":
            return g.nodes[n].props["caps"]
        if ALIASES.get(g.nodes[n].element, g.nodes[n].element) not in THROUGH:
            return None
    return None


def element(name: str):
    def put(f: Element) -> Element:
        ELEMENTS[name] = f
        return f

    return put


def _one(inputs: list[DataFrame]) -> DataFrame:
    if len(inputs) != 1:
        raise ValueError(f"one input expected, {len(inputs)} linked")
    return inputs[0]


@element("videotestsrc")
def _videotestsrc(spark, inputs, p):
    n, d = map(int, p.get("framerate", "30/1").split("/"))
    df = synthetic.videotestsrc(spark, int(p.get("num-buffers", 100)), int(p.get("width", 320)), int(p.get("height", 240)), (n, d), p.get("pattern", "smpte"))
    return df.withColumn("format", F.lit("RGBA")).withColumn("framerate", F.lit((n << 16) // d))


@element("audiotestsrc")
def _audiotestsrc(spark, inputs, p):
    """Samples; a buffer holds samplesperbuffer of them."""
    rate, size = int(p.get("samplerate", 48_000)), int(p.get("samplesperbuffer", 1024))
    df = synthetic.audiotestsrc(spark, int(p.get("num-buffers", 10)) * size, float(p.get("freq", 440)), rate, p.get("wave", "sine"))
    return df.withColumn("buffer", F.expr(f"n div {size}")).withColumn("format", F.lit("S16LE")).withColumn("rate", F.lit(rate)).withColumn("channels", F.lit(1))


#: Elements that change no row of their stream: a tee's branches and a queue that does not leak hold what comes in; sinks and probes end it or look on.
for _name in ("identity", "tee", "fakesink", "appsink", "progressreport"):
    ELEMENTS[_name] = lambda spark, inputs, p: _one(inputs)


@element("queue")
def _queue(spark, inputs, p):
    """leaky: of what comes within max-size-time (ns), the last (downstream) or first (upstream) max-size-buffers frames stay."""
    df, leaky = _one(inputs), p.get("leaky", "no")
    if leaky in ("no", "0"):
        return df
    policy = {"downstream": "oldest", "2": "oldest", "upstream": "newest", "1": "newest"}[leaky]
    batched = df.withColumn("_batch", F.expr(f"pts_ns div {int(p.get('max-size-time', 1_000_000_000))}"))
    return flow.leaky_queue(batched, ["_batch"], int(p.get("max-size-buffers", 200)), policy).drop("_batch")


@element("clocksync")
def _clocksync(spark, inputs, p):
    df = _one(inputs)
    return flow.clocksync(df if "arrival_ns" in df.columns else df.withColumn("arrival_ns", F.lit(0).cast("long")))


def _limits(v) -> tuple:
    """The values that a caps field admits: a range's ends, or the list."""
    return (v.lo, v.hi) if isinstance(v, caps_of.Range) else v if isinstance(v, tuple) else (v, v)


def _fixed(p: dict[str, str], name: str):
    """The one value (a list's first) that the caps downstream give a field, or None."""
    if WANTED not in p or (v := caps_of.parse(p[WANTED]).get(name)) is None:
        return None
    return v.lo if isinstance(v, caps_of.Range) else v[0] if isinstance(v, tuple) else v


@element("videoconvert")
def _videoconvert(spark, inputs, p):
    """Frames in the format that the caps downstream ask for."""
    wanted = _fixed(p, "format")
    return _one(inputs) if wanted is None else _one(inputs).withColumn("format", F.lit(wanted))


@element("videoscale")
def _videoscale(spark, inputs, p):
    """Frames of the size that the caps downstream ask for."""
    df = _one(inputs)
    for name in ("width", "height"):
        if (wanted := _fixed(p, name)) is not None:
            df = df.withColumn(name, F.lit(wanted))
    return df


@element("videorate")
def _videorate(spark, inputs, p):
    """Frames at the rate that the caps downstream ask for."""
    from framewright.operators.timing import videorate

    df, wanted = _one(inputs), _fixed(p, "framerate")
    if wanted is None:
        return df
    dt = round((1_000_000_000 << 16) / wanted)
    out = videorate(df.withColumn("rel_ns", F.col("pts_ns")).withColumn("_stream", F.lit(0)), ["_stream"], dt)
    out = out.withColumn("sequence", F.col("slot")).withColumn("pts_ns", F.col("out_ns")).withColumn("duration_ns", F.lit(dt).cast("long"))
    return out.withColumn("framerate", F.lit(wanted)).drop("rel_ns", "_stream", "slot", "out_ns")


@element("audioconvert")
def _audioconvert(spark, inputs, p):
    df, wanted = _one(inputs), _fixed(p, "format")
    if wanted in (None, "S16LE"):
        return df
    if wanted != "F32LE":
        raise ValueError(f"audioconvert: from S16LE to F32LE only, not to {wanted}")
    return df.withColumn("s", F.col("s") / 32768.0).withColumn("format", F.lit(wanted))


@element("audioresample")
def _audioresample(spark, inputs, p):
    """Each buffer at the rate that the caps downstream ask for."""
    from framewright.operators.audio import resampled

    df, wanted = _one(inputs), _fixed(p, "rate")
    if wanted is None:
        return df
    first = df.select("rate", "channels", "format").first()
    if first is None or first["rate"] == wanted:
        return df
    size = df.where("buffer = 0").count()  # one buffer
    out = resampled(df.withColumn("n", F.col("n") - F.col("buffer") * size + 1), first["rate"], wanted)
    start = F.expr(f"(buffer * {size} * 1000000000) div {first['rate']} + (k * 1000000000) div {wanted}")
    return out.select(F.col("k").alias("n"), start.alias("pts_ns"), "s", "buffer", F.lit(first["format"]).alias("format"), F.lit(wanted).alias("rate"), F.lit(first["channels"]).alias("channels"))


@element("videocrop")
def _videocrop(spark, inputs, p):
    left, right, top, bottom = (int(p.get(k, 0)) for k in ("left", "right", "top", "bottom"))
    return _one(inputs).withColumn("width", F.greatest(F.lit(0), F.col("width") - left - right)).withColumn("height", F.greatest(F.lit(0), F.col("height") - top - bottom))


@element("videobox")
def _videobox(spark, inputs, p):
    left, right, top, bottom = (int(p.get(k, 0)) for k in ("left", "right", "top", "bottom"))
    return _one(inputs).withColumn("width", F.col("width") + left + right).withColumn("height", F.col("height") + top + bottom)


@element("audioamplify")
def _audioamplify(spark, inputs, p):
    from framewright.operators.audio import amplified

    return _one(inputs).withColumn("s", amplified(F.col("s"), float(p.get("amplification", 1)), p.get("clipping-method", "clip")).cast("int"))


@element("level")
def _level(spark, inputs, p):
    """The peak and RMS of each buffer in place of its samples."""
    from framewright.operators.audio import level

    return level(_one(inputs).withColumn("channel", F.lit(0)))


@element("output-selector")
def _output_selector(spark, inputs, p):
    return _one(inputs)


@element("multifilesink")
def _multifilesink(spark, inputs, p):
    return flow.key_frame_files(_one(inputs).withColumn("stream", F.lit(0)), ["stream"]).drop("stream")


@element("gopreverse")
def _gopreverse(spark, inputs, p):
    return flow.gopreverse(_one(inputs).withColumn("stream", F.lit(0)), ["stream"]).drop("stream")


@element("downloadbuffer")
def _downloadbuffer(spark, inputs, p):
    """Held on executors' disks, so what reads it twice computes it once."""
    from pyspark import StorageLevel

    return _one(inputs).persist(StorageLevel.DISK_ONLY)


@element("capsfilter")
def _capsfilter(spark, inputs, p):
    """Frames that the caps admit; a field that the frames don't have is an error."""
    df, wanted = _one(inputs), caps_of.parse(p["caps"])
    if lacking := [name for name, _ in wanted.fields if name not in df.columns]:
        raise ValueError(f"{p['caps']}: frames have no field {', '.join(lacking)}; they have {', '.join(df.columns)}")
    for name, v in wanted.fields:
        df = df.where(F.col(name).isin(*v)) if isinstance(v, tuple) else df.where(F.col(name).between(*_limits(v)))
    return df


@element("avoffset")
def _avoffset(spark, inputs, p):
    return flow.avoffset(_one(inputs), int(p.get("offset", 0)))


@element("volume")
def _volume(spark, inputs, p):
    from framewright.operators.audio import gained

    return _one(inputs).withColumn("s", gained(F.col("s"), float(p.get("volume", 1)), p.get("mute") == "true").cast("int"))


@element("funnel")
def _funnel(spark, inputs, p):
    out = None
    for i, df in enumerate(inputs):
        df = df.withColumn("input", F.lit(i))
        out = df if out is None else out.unionByName(df)
    return out.orderBy("pts_ns", "input")


@element("concat")
def _concat(spark, inputs, p):
    from framewright.operators.merge import concat

    out = None
    for i, df in enumerate(inputs):
        df = df.withColumn("input", F.lit(i))
        out = df if out is None else out.unionByName(df)
    return concat(out, "pts_ns", F.coalesce("duration_ns", F.lit(0)))


@element("input-selector")
def _input_selector(spark, inputs, p):
    return inputs[int(p.get("active", 0))]


def resolve(name: str) -> Element:
    name = ALIASES.get(name, name)
    if name in ELEMENTS:
        return ELEMENTS[name]
    if name in BOUNDARY:
        raise NotImplementedError(f"{name} is a {BOUNDARY[name]}; Spark has no counterpart to it. Bring its data in or out through a table, Kafka or a Python data source")
    raise ValueError(f"no element is called {name}; known: {', '.join(sorted(ELEMENTS))}")


def lower(spark: SparkSession, g: Graph) -> dict[str, DataFrame]:
    """The DataFrame that leaves each node. Unknown elements fail here, before any data is read."""
    made = {n: resolve(g.nodes[n].element) for n in g.order()}
    out: dict[str, DataFrame] = {}
    for n, f in made.items():
        caps = wanted_caps(g, n)
        out[n] = f(spark, [out[a] for a, b in g.links if b == n], g.nodes[n].props | ({WANTED: caps} if caps else {}))
    return out


def launch(spark: SparkSession, text: str) -> dict[str, DataFrame]:
    """The DataFrames that arrive at the ends of a pipeline, by node."""
    g = parse_launch(text)
    out = lower(spark, g)
    return {n: df for n, df in out.items() if all(a != n for a, _ in g.links)}


def autoplug(have: caps_of.Caps, want: caps_of.Caps, transforms: dict[str, list[tuple[caps_of.Caps, caps_of.Caps]]]) -> list[str]:
    """The shortest chain of transforms from one kind of caps to another, breadth first; ties by name."""
    todo, seen = [(have, [])], {have.media}
    if have.meet(want) is not None:
        return []
    while todo:
        at, path = todo.pop(0)
        for name in sorted(transforms):
            for accepts, gives in transforms[name]:
                if at.meet(accepts) is None:
                    continue
                if gives.meet(want) is not None:
                    return [*path, name]
                if gives.media not in seen:
                    seen.add(gives.media)
                    todo.append((gives, [*path, name]))
    raise caps_of.CapsConflict(f"nothing leads from {have} to {want}")


def plan_costs(df: DataFrame) -> dict[str, int]:
    """Shuffles and Python steps of a plan; what a copy budget is to frames."""
    text = df._jdf.queryExecution().executedPlan().toString()
    return {"exchanges": text.count("Exchange "), "python": sum(text.count(k) for k in ("InPandas", "InArrow", "EvalPython"))}


#: Lines whose frames at the sinks are counted, and their number.
LINES = (
    ("videotestsrc num-buffers=3 ! videoconvert ! fakesink", 3),
    ("videotestsrc num-buffers=3 ! tee name=t ! queue ! fakesink t. ! queue ! fakesink", 6),
    ("audiotestsrc num-buffers=3 ! audioconvert ! audioresample ! fakesink", 3),
    ("videotestsrc num-buffers=30 ! videorate ! video/x-raw,framerate=15/1 ! fakesink", 16),
    ("videotestsrc num-buffers=9 ! videoscale ! video/x-raw,width=640,height=480 ! videoconvert ! video/x-raw,format=NV12 ! fakesink", 9),
    ("audiotestsrc num-buffers=4 ! volume volume=0.5 ! audioresample ! audio/x-raw,rate=24000 ! level ! fakesink", 4),
    ("videotestsrc num-buffers=90 ! queue leaky=downstream max-size-buffers=5 ! fakesink", 15),
)


@query("g_launch_lines", "SELECT * FROM (VALUES " + ", ".join(f"({i}, CAST({n} AS BIGINT))" for i, (_, n) in enumerate(LINES)) + ") AS t(line, frames)")
def g_launch_lines(spark, sf_dir):
    """Frames (buffers of samples) that arrive at the sinks of each line."""
    out = None
    for i, (line, _) in enumerate(LINES):
        for df in launch(spark, line).values():
            one = df.select(F.col("buffer" if "buffer" in df.columns else "sequence").alias("frame")).distinct().select(F.lit(i).alias("line"))
            out = one if out is None else out.unionByName(one)
    return out.groupBy("line").agg(F.count(F.lit(1)).alias("frames"))
