"""Container and stream operators over BINARY columns: table functions that turn files into frames, aggregates that write them, packet buffers."""

from __future__ import annotations

import heapq
import struct
from collections.abc import Callable, Iterator

import numpy as np
import pandas as pd
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F
from pyspark.sql.pandas.types import to_arrow_schema
from pyspark.sql.types import BinaryType, BooleanType, LongType, StringType, StructType

from framewright.catalog import query, table
from framewright.functions import containers, parsers
from framewright.schema import DAY_NS, frames

READERS: dict[str, Callable[[bytes], Iterator[containers.Packet]]] = {
    "ivf": containers.read_ivf,
    "flv": containers.read_flv,
    "ogg": containers.read_ogg,
    "mpegts": containers.read_ts,
    "matroska": containers.read_mkv,
    "fmp4": containers.read_fmp4,
    "h264": containers.h264_access_units,
    "aac": containers.adts_frames,
    "mp4": parsers.read_mp4,
    "mpegps": parsers.read_ps,
    "flac": parsers.read_flac,
}


#: Bytes of a row that goes to Python: an Arrow batch has 10,000 rows, whatever their length. Rows and bytes of a batch that Python gives back.
PIECE, PACKETS, BYTES = 512, 10_000, 4 << 20


def in_pieces(df: DataFrame, key: str, payload: str) -> DataFrame:
    """k, p and last: each file as consecutive rows of a bounded length."""
    last = F.expr(f"CAST((greatest(coalesce(octet_length(`{payload}`), 0), 1) - 1) div {PIECE} AS INT)")
    rows = df.select(F.col(key).alias("k"), F.col(payload).alias("p"), last.alias("n")).select("k", "p", "n", F.explode(F.sequence(F.lit(0), F.col("n"))).alias("i"))
    return rows.select("k", F.substring("p", F.col("i") * PIECE + 1, F.lit(PIECE)).alias("p"), (F.col("i") == F.col("n")).alias("last"))


def whole_files(batches: Iterator[pa.RecordBatch]) -> Iterator[tuple[object, bytes]]:
    """Key and bytes of each file of in_pieces(); a null file has none."""
    held: list[bytes] = []
    for b in batches:
        for k, p, last in zip(*(c.to_pylist() for c in b.columns), strict=True):
            held.append(p or b"")
            if last:
                data, held = held[0] if len(held) == 1 else b"".join(held), []
                yield k, data


def in_batches(rows: Iterator[tuple], schema: StructType) -> Iterator[pa.RecordBatch]:
    """Rows whose last value is bytes, as Arrow batches of a bounded size; a longer row is a batch of its own."""
    kinds = to_arrow_schema(schema)
    batch = lambda got: pa.RecordBatch.from_arrays([pa.array(c, f.type) for c, f in zip(zip(*got, strict=True), kinds, strict=True)], schema=kinds)
    got, size = [], 0
    for row in rows:
        got.append(row)
        size += len(row[-1])
        if len(got) >= PACKETS or size >= BYTES:
            yield batch(got)
            got, size = [], 0
    if got:
        yield batch(got)


def demux(df: DataFrame, key: str, payload: str, container: str) -> DataFrame:
    """key, track, kind, sequence (in the file), pts_ns, keyframe, payload for each packet of each file. A file is one row's bytes; where it
    breaks off, the packets before that stay, and a last row of kind `error` has the reason as its payload. A task holds a file at a time."""
    reader = READERS[container]
    schema = StructType().add(key, df.schema[key].dataType).add("track", LongType()).add("kind", StringType()).add("sequence", LongType()).add("pts_ns", LongType()).add("keyframe", BooleanType()).add("payload", BinaryType())

    def packets(data: bytes) -> Iterator[tuple]:
        n = 0
        try:
            for track, kind, ns, keyframe, body in reader(data):
                yield track, kind, n, ns, keyframe, body
                n += 1
        except (ValueError, IndexError, struct.error) as e:
            yield None, "error", n, None, False, str(e).encode()

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        return in_batches(((k, *packet) for k, data in whole_files(batches) for packet in packets(data)), schema)

    return in_pieces(df, key, payload).mapInArrow(run, schema)


def mux(df: DataFrame, key: str, writer: Callable[[pd.DataFrame], bytes]) -> DataFrame:
    """key, payload: each key's frames (track, pts_ns, keyframe, payload), in the order of time and track, through a writer. Frames come to
    Python in that order, so a task holds a batch and a file at a time; a file is one task's work."""
    schema = StructType().add(key, df.schema[key].dataType).add("payload", BinaryType())
    at = df.columns.index(key)

    def files(batches: Iterator[pa.RecordBatch]) -> Iterator[tuple[object, bytes]]:
        held: list[pd.DataFrame] = []
        name = None
        write = lambda: writer(held[0] if len(held) == 1 else pd.concat(held, ignore_index=True))
        for b in batches:
            keys = b.column(at).to_pylist()
            g = b.to_pandas(integer_object_nulls=True)
            begin = 0
            for i, k in enumerate(keys):
                if held or i > begin:
                    if k == name or (k != k and name != name):
                        continue
                    if i > begin:
                        held.append(g.iloc[begin:i])
                    yield name, write()
                    held, begin = [], i
                name = k
            if begin < len(keys):
                held.append(g.iloc[begin:])
        if held:
            yield name, write()

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        return in_batches(files(batches), schema)

    order = [F.asc(key), *(F.asc_nulls_last(c) for c in ("pts_ns", "track", "sequence"))]
    return df.repartition(F.col(key)).sortWithinPartitions(*order).mapInArrow(run, schema)


def ts_writer(g: pd.DataFrame) -> bytes:
    tracks = sorted(set(g["track"]))
    return containers.write_ts({0x100 + t: 0x1B for t in tracks}, [(0x100 + t, int(ns), bool(k), bytes(p)) for t, ns, k, p in zip(g["track"], g["pts_ns"], g["keyframe"], g["payload"], strict=True)])


def mkv_writer(g: pd.DataFrame) -> bytes:
    return containers.write_mkv({t + 1: "V_VP9" for t in sorted(set(g["track"]))}, [(t + 1, int(ns), bool(k), bytes(p)) for t, ns, k, p in zip(g["track"], g["pts_ns"], g["keyframe"], g["payload"], strict=True)])


def fmp4_writer(g: pd.DataFrame) -> bytes:
    return containers.write_fmp4({t + 1: 1_000_000 for t in sorted(set(g["track"]))}, [(t + 1, int(ns), bool(k), bytes(p)) for t, ns, k, p in zip(g["track"], g["pts_ns"], g["keyframe"], g["payload"], strict=True)])


def flv_writer(g: pd.DataFrame) -> bytes:
    return containers.write_flv([(9, int(ns) // 1_000_000, (b"\x12" if k else b"\x22") + bytes(p)) for ns, k, p in zip(g["pts_ns"], g["keyframe"], g["payload"], strict=True)])


def ogg_writer(g: pd.DataFrame) -> bytes:
    return containers.write_ogg([(int(t) + 1, int(ns) // 1_000_000, bytes(p)) for t, ns, p in zip(g["track"], g["pts_ns"], g["payload"], strict=True)])


def ivf_writer(g: pd.DataFrame) -> bytes:
    return containers.write_ivf([(int(ns) // 1_000_000, (b"\0" if k else b"\x01") + bytes(p)) for ns, k, p in zip(g["pts_ns"], g["keyframe"], g["payload"], strict=True)], b"VP80", 64, 48, 1000)


WRITERS = {"mpegts": ts_writer, "matroska": mkv_writer, "fmp4": fmp4_writer, "flv": flv_writer, "ogg": ogg_writer, "ivf": ivf_writer}


def media(spark, sf_dir) -> DataFrame:
    """Events as the packets of one file for each user: a stream is a track, the properties are the payload, whole milliseconds the time."""
    f = frames(spark, sf_dir)
    return f.select("user_id", F.col("input").cast("long").alias("track"), "sequence", F.expr("(rel_ns div 1000000) * 1000000").alias("pts_ns"), "keyframe", F.encode("props", "UTF-8").alias("payload"))


def _round_trip(container: str, strip: int = 0):
    """Files are written and read again; what comes out is what went in. A transport stream's clock wraps after 26 hours, so its times are those of the day."""

    def run(spark, sf_dir):
        m = media(spark, sf_dir)
        if container == "mpegts":
            m = m.withColumn("pts_ns", F.col("pts_ns") % DAY_NS)
        out = demux(mux(m, "user_id", WRITERS[container]), "user_id", "payload", container)
        return out.select("user_id", "pts_ns", "keyframe", F.decode(F.substring("payload", 1 + strip, 1 << 30), "UTF-8").alias("props"))

    return run


_TRIP = "SELECT user_id, (epoch_us(ts) * 1000 - 1704067200000000000) // 1000000 * 1000000 AS pts_ns, event_id % 10 = 0 AS keyframe, props FROM events"
for _name, _strip in (("mpegts", 0), ("matroska", 0), ("fmp4", 0), ("flv", 1), ("ivf", 1)):
    query(f"m_{_name}", _TRIP.replace("000000 AS pts_ns", f"000000 % {DAY_NS} AS pts_ns") if _name == "mpegts" else _TRIP)(_round_trip(_name, _strip))


@query("m_ogg", "SELECT user_id, (epoch_us(ts) * 1000 - 1704067200000000000) // 1000000 AS pts_ns, props FROM events")
def m_ogg(spark, sf_dir):
    return _round_trip("ogg")(spark, sf_dir).drop("keyframe")


def wav_files(df: DataFrame, key: str, rate: int) -> DataFrame:
    """key, payload: 16-bit mono samples (n, s) of each key as a WAVE file."""
    from framewright.operators.audio import in_order

    def run(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        for b in batches:
            yield pd.DataFrame({key: b[key], "payload": [containers.write_wav(np.asarray(s).astype("<i2").tobytes(), 1, rate) for s in b["s"]]})

    return in_order(df, [key]).mapInPandas(run, f"`{key}` {df.schema[key].dataType.simpleString()}, payload binary")


def wav_samples(df: DataFrame, key: str) -> DataFrame:
    def run(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        for b in batches:
            yield pd.DataFrame({key: b[key], "s": [np.frombuffer(containers.read_wav(bytes(p))[3], "<i2").astype(np.int64) for p in b["payload"]]})

    out = df.mapInPandas(run, f"`{key}` {df.schema[key].dataType.simpleString()}, s array<long>")
    return out.select(key, F.posexplode("s").alias("n", "s")).select(key, (F.col("n") + 1).cast("long").alias("n"), "s")


@query("m_wav", "SELECT l_orderkey AS buffer, row_number() OVER (PARTITION BY l_orderkey ORDER BY l_linenumber, l_partkey, l_suppkey, l_extendedprice) AS n, (l_partkey * 7919 + l_suppkey * 104729) % 65536 - 32768 AS s FROM lineitem")
def m_wav(spark, sf_dir):
    from framewright.operators.audio import ordered_samples

    return wav_samples(wav_files(ordered_samples(spark, sf_dir), "buffer", 48_000), "buffer")


@query("q_klvdecode", "SELECT event_id, 2 AS tag, epoch_us(ts) AS v FROM events UNION ALL SELECT event_id, 13, user_id FROM events UNION ALL SELECT event_id, 300, event_id % 1000 FROM events")
def q_klvdecode(spark, sf_dir):
    """Local sets, written and walked again: tag and big-endian value."""
    e = table(spark, sf_dir, "events").select("event_id", F.unix_micros(F.col("ts").cast("timestamp")).alias("us"), "user_id")

    def run(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        for b in batches:
            rows = []
            for i, us, user in zip(b["event_id"], b["us"], b["user_id"], strict=True):
                data = containers.write_klv([(2, int(us).to_bytes(8, "big")), (13, int(user).to_bytes(4, "big")), (300, (int(i) % 1000).to_bytes(200, "big"))])
                rows += [(i, tag, int.from_bytes(v, "big")) for tag, v in containers.read_klv(data)]
            yield pd.DataFrame(rows, columns=["event_id", "tag", "v"])

    return e.mapInPandas(run, "event_id long, tag int, v long")


# --- packets ------------------------------------------------------------------------------------------------------------------------------


def unwrapped(seq: np.ndarray) -> np.ndarray:
    """16-bit sequence numbers (RFC 3550) without their wraps: each is the nearest to the one before it."""
    steps = np.diff(seq.astype(np.int64), prepend=int(seq[0]) if len(seq) else 0)
    return (int(seq[0]) if len(seq) else 0) + np.cumsum((steps + 0x8000) % 0x10000 - 0x8000)


def playout(arrival: np.ndarray, number: np.ndarray, hold: int, depth: int) -> tuple[np.ndarray, np.ndarray]:
    """Places of the packets that are played, in order, and when. Packets in the order of arrival, with unwrapped numbers.

    A packet is played when all before it were, or are given up: a gap is given up at an arrival if the packet behind it came hold ago
    or depth packets wait, and at the end, hold after the last arrival.
    """
    heap: list[tuple[int, int]] = []
    place, at, due = [], [], int(number[0]) if len(number) else 0
    _, first = np.unique(number, return_index=True)
    fresh = np.zeros(len(number), bool)
    fresh[first] = True
    for i, (now, n) in enumerate(zip(arrival.tolist(), number.tolist(), strict=True)):
        if fresh[i] and n >= due:
            heapq.heappush(heap, (n, i))
        while heap and (heap[0][0] == due or len(heap) >= depth or now - arrival[heap[0][1]] >= hold):
            n, k = heapq.heappop(heap)
            due = n + 1
            place.append(k)
            at.append(now)
    rest = [k for _, k in sorted(heap)]
    end = [int(arrival[-1]) + hold] * len(rest) if len(arrival) else []
    return np.asarray(place + rest, np.int64), np.asarray(at + end, np.int64)


def _played(df: DataFrame, key: str, max_hold_ns: int, max_depth: int, result, schema: str) -> DataFrame:
    def run(g: pd.DataFrame) -> pd.DataFrame:
        g = g.sort_values(["arrival_ns", "seq"], kind="stable")
        number = unwrapped(g["seq"].to_numpy())
        return result(g, number, *playout(g["arrival_ns"].to_numpy().astype(np.int64), number, max_hold_ns, max(1, max_depth)))

    return df.groupBy(key).applyInPandas(run, f"`{key}` {df.schema[key].dataType.simpleString()}, {schema}")


def jitter_buffer(df: DataFrame, key: str, max_hold_ns: int, max_depth: int) -> DataFrame:
    """Rows (key, arrival_ns, seq) in the order of release: key, position, seq, released_ns. A fold over one stream's packets."""

    def rows(g, number, place, at):
        return pd.DataFrame({key: g[key].iloc[0], "position": np.arange(len(place), dtype=np.int64), "seq": number[place] & 0xFFFF, "released_ns": at})

    return _played(df, key, max_hold_ns, max_depth, rows, "position long, seq int, released_ns long")


def jitter_counts(df: DataFrame, key: str, max_hold_ns: int, max_depth: int) -> DataFrame:
    """What became of each stream's packets (key, arrival_ns, seq): received, played, duplicates, late (its place was given up), lost (numbers that were not played) and reordered (below the highest so far)."""

    def counts(g, number, place, at):
        different, played = len(np.unique(number)), number[place]
        highest = np.maximum.accumulate(number)
        lost = int(played.max() - played.min()) + 1 - len(played)
        return pd.DataFrame({key: [g[key].iloc[0]], "received": [len(g)], "played": [len(place)], "duplicates": [len(g) - different], "late": [different - len(place)], "lost": [lost], "reordered": [int((number[1:] < highest[:-1]).sum())]})

    return _played(df, key, max_hold_ns, max_depth, counts, "received long, played long, duplicates long, late long, lost long, reordered long")


@query("t_jitter_buffer", "WITH a AS (SELECT user_id, row_number() OVER (PARTITION BY user_id ORDER BY event_id) - 1 AS n FROM events) SELECT user_id, n AS position, CAST((n + 65500) % 65536 AS INTEGER) AS seq FROM a")
def t_jitter_buffer(spark, sf_dir):
    """Packets that arrive in pairs the wrong way round come out in order, over the wrap of sequence numbers."""
    from pyspark.sql import Window

    n = F.row_number().over(Window.partitionBy("user_id").orderBy("sequence")).cast("long") - 1
    f = frames(spark, sf_dir).withColumn("n", n)
    late = F.when(F.col("n") == 0, 0).otherwise(F.when(F.col("n") % 2 == 1, 3).otherwise(0))
    p = f.select("user_id", ((F.col("n") + late) * 1_000_000).alias("arrival_ns"), ((F.col("n") + 65500) % 65536).cast("int").alias("seq"))
    return jitter_buffer(p, "user_id", 50_000_000, 64).select("user_id", "position", "seq")


@query("t_jitter_counts", "SELECT user_id, count(*) + count(*) // 10 AS received, count(*) AS played, count(*) // 10 AS duplicates, CAST(0 AS BIGINT) AS late, CAST(0 AS BIGINT) AS lost FROM events GROUP BY user_id")
def t_jitter_counts(spark, sf_dir):
    """Every tenth packet comes twice: the second is a duplicate."""
    from pyspark.sql import Window

    n = F.row_number().over(Window.partitionBy("user_id").orderBy("sequence")).cast("long")
    p = frames(spark, sf_dir).withColumn("n", n).withColumn("times", F.when(F.col("n") % 10 == 0, 2).otherwise(1))
    p = p.withColumn("k", F.explode(F.sequence(F.lit(1), F.col("times")))).select("user_id", (F.col("n") * 1_000_000 + F.col("k") * 100_000).alias("arrival_ns"), ((F.col("n") + 65500) % 65536).cast("int").alias("seq"))
    return jitter_counts(p, "user_id", 50_000_000, 64).drop("reordered")


def reception_jitter(df: DataFrame, key: str, clock: int) -> DataFrame:
    """RFC 3550 interarrival jitter in clock units at each stream's end: J += (|D| - J) / 16, in sixteenths."""

    def run(g: pd.DataFrame) -> pd.DataFrame:
        g = g.sort_values(["arrival_ns", "rtp_ts"], kind="stable")
        first, j, before = int(g["arrival_ns"].iloc[0]), 0, None
        for now, ts in zip(g["arrival_ns"].astype("int64"), g["rtp_ts"].astype("int64"), strict=True):
            transit = (int(now) - first) * clock // 1_000_000_000 - int(ts)
            if before is not None:
                j = max(0, j + abs(transit - before) - (j + 8 >> 4))
            before = transit
        return pd.DataFrame({key: [g[key].iloc[0]], "packets": [len(g)], "jitter": [j >> 4]})

    return df.groupBy(key).applyInPandas(run, f"`{key}` {df.schema[key].dataType.simpleString()}, packets long, jitter long")


@query("u_rtcp_jitter")
def u_rtcp_jitter(spark, sf_dir):
    f = frames(spark, sf_dir)
    arrival = F.col("rel_ns") + (F.col("sequence") * 7919 % 50) * 1_000_000
    return reception_jitter(f.select("user_id", arrival.alias("arrival_ns"), F.expr("(rel_ns div 1000000) * 90").alias("rtp_ts")), "user_id", 90_000)


WORD = 7  # bytes that fit a positive long


def xor_words(df: DataFrame, keys: list[str], payload: str = "payload") -> DataFrame:
    """keys, _i, _w: the exclusive or of the keys' payloads, word by word; shorter ones count as filled up with zeros."""
    last = F.greatest(F.lit(0), F.ceil(F.octet_length(payload) / WORD).cast("int") - 1)
    word = lambda i: F.conv(F.rpad(F.hex(F.substr(F.col(payload), i * WORD + 1, F.lit(WORD))), 2 * WORD, "0"), 16, 10).cast("long")
    words = df.select(*keys, F.posexplode(F.transform(F.sequence(F.lit(0), last), word)).alias("_i", "_w"))
    return words.groupBy(*keys, "_i").agg(F.bit_xor("_w").alias("_w"))


def joined_words(df: DataFrame, keys: list[str]) -> DataFrame:
    """keys, payload: words put together in their order; as many as one packet has."""
    words = F.array_sort(F.collect_list(F.struct("_i", "_w")))
    return df.groupBy(*keys).agg(F.unhex(F.array_join(F.transform(words, lambda x: F.lpad(F.hex(x["_w"]), 2 * WORD, "0")), "")).alias("payload"))


def fec_protect(packets: DataFrame, keys: list[str]) -> DataFrame:
    """A parity packet for each set (keys): count, the sum of numbers n, and the exclusive or of lengths and of payloads."""
    heads = packets.groupBy(*keys).agg(F.count(F.lit(1)).alias("count"), F.sum("n").alias("numbers"), F.bit_xor(F.octet_length("payload")).alias("length"))
    return heads.join(joined_words(xor_words(packets, keys), keys), keys)


def fec_recover(packets: DataFrame, parity: DataFrame, keys: list[str]) -> DataFrame:
    """keys, n, payload of the packets that parity brings back: those of sets that lack exactly one. Keys must not be null."""
    came = packets.groupBy(*keys).agg(F.count(F.lit(1)).alias("_count"), F.sum("n").alias("_numbers"), F.bit_xor(F.octet_length("payload")).alias("_length"))
    zero = lambda c: F.coalesce(F.col(c), F.lit(0))
    lack = parity.join(came, keys, "left").where(F.col("count") - zero("_count") == 1)
    lack = lack.select(*keys, (F.col("numbers") - zero("_numbers")).alias("n"), F.col("length").bitwiseXOR(zero("_length")).alias("_size"), "payload")
    rest = packets.join(lack.select(*keys), keys, "left_semi").select(*keys, "payload")
    whole = joined_words(xor_words(rest.unionByName(lack.select(*keys, "payload")), keys), keys)
    return lack.drop("payload").join(whole, keys).select(*keys, "n", F.substr("payload", F.lit(1), F.col("_size")).alias("payload"))


@query("u_fec_recover", "SELECT event_id, props FROM events")
def u_fec_recover(spark, sf_dir):
    """Parity over sets of four packets: one of each set is lost, and comes back from the rest."""
    p = frames(spark, sf_dir).select(F.expr("sequence div 4").alias("set"), F.col("sequence").alias("n"), F.encode("props", "UTF-8").alias("payload"))
    kept = p.where(F.col("n") % 4 != F.col("set") % 4)
    out = kept.unionByName(fec_recover(kept, fec_protect(p, ["set"]), ["set"]))
    return out.select(F.col("n").alias("event_id"), F.decode("payload", "UTF-8").alias("props"))


# --- captions in access units ---------------------------------------------------------------------------------------------------------------


@query("q_ccextract", "SELECT user_id, event_id, 'U' || user_id || ' e' || (event_id % 1000) AS text FROM events")
def q_ccextract(spark, sf_dir):
    """Captions written into access units' SEI, taken out again and decoded: a fold over each stream's pairs in the order of time."""
    from framewright.functions import captions

    def insert(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        for b in batches:
            text = [f"U{u} e{s % 1000}" for u, s in zip(b["user_id"], b["sequence"], strict=True)]
            yield b.assign(payload=[captions.caption_sei(captions.encode_608(t)) + b"\0\0\0\x01\x65\x88" for t in text])

    def extract(g: pd.DataFrame) -> pd.DataFrame:
        pairs, at = [], {}
        for i, (s, p) in enumerate(g.sort_values("sequence")[["sequence", "payload"]].itertuples(index=False)):
            at[i] = s
            pairs += [(i, x, y) for x, y in captions.caption_pairs(bytes(p))]
        cues = list(captions.decode_608(pairs))
        return pd.DataFrame({"user_id": g["user_id"].iloc[0], "event_id": [at[c[0]] for c in cues], "text": [c[2] for c in cues]})

    f = frames(spark, sf_dir).select("user_id", "sequence")
    units = f.mapInPandas(insert, "user_id long, sequence long, payload binary")
    return units.groupBy("user_id").applyInPandas(extract, "user_id long, event_id long, text string")


@query("q_misp_sei", "SELECT event_id, epoch_us(ts) AS us FROM events")
def q_misp_sei(spark, sf_dir):
    """Microsecond times written into access units and read back."""
    from framewright.functions import captions

    def trip(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        for b in batches:
            yield pd.DataFrame({"event_id": b["event_id"], "us": [captions.misp_time(captions.misp_sei(int(u)) + b"\0\0\0\x01\x65\x88") for u in b["us"]]})

    e = table(spark, sf_dir, "events").select("event_id", F.unix_micros(F.col("ts").cast("timestamp")).alias("us"))
    return e.mapInPandas(trip, "event_id long, us long")
