"""Rules held against plain loops and hand-computed values."""

import math
import random
import time

import numpy as np
import pytest
from pyspark.sql import functions as F

from framewright.functions import containers, parsers
from framewright.operators import audio, flow, media, merge, packets, tensor, text, timing
from framewright.plans import caps, launch
from framewright.sources import files, live, synthetic


def resample_loop(times, dt):
    """The frame each slot takes, slot by slot."""
    out, slot, held = [], times[0], times[0]
    for t in times[1:]:
        while slot <= t and abs(held - slot) <= abs(t - slot):
            out.append((slot, held))
            slot += dt
        held = t
    return [*out, (slot, held)]


def test_videorate_against_a_loop(spark):
    rnd = random.Random(3)
    series = {k: sorted(rnd.sample(range(0, 4000), 25)) for k in range(12)}
    series[99] = [i * 33_333_333 for i in range(9)]
    rows = [(k, t, i) for k, ts in series.items() for i, t in enumerate(ts)]
    frames = spark.createDataFrame(rows, "user_id long, rel_ns long, sequence long")
    for dt, keys in ((70, range(12)), (100_000_000, [99])):
        got = timing.videorate(frames.where(F.col("user_id").isin(list(keys))), ["user_id"], dt).collect()
        for k in keys:
            assert sorted((r.out_ns, r.rel_ns) for r in got if r.user_id == k) == resample_loop(series[k], dt)
    assert len(resample_loop(series[99], 100_000_000)) == 4  # 30 to 10 frames a second


def test_latency_percentiles_are_bucket_edges(spark):
    ns = [1_000_000] * 100 + [50_000_000] * 5
    row = timing.latency_histogram(spark.createDataFrame([(1, n) for n in ns], "k int, ns long"), ["k"], F.col("ns")).first()
    assert (row["count"], row.max_ns, row.p50_ns, row.p99_ns) == (105, 50_000_000, 1 << 20, 50_000_000)


def test_greedy_cuts(spark):
    times = [0, 4, 9, 11, 19, 23, 24, 40]
    df = spark.createDataFrame([(1, t, True) for t in times], "k int, pts_ns long, keyframe boolean")
    got = {r.pts_ns: r.segment for r in flow.greedy_segments(df, ["k"], 10).collect()}
    assert got == {0: 0, 4: 0, 9: 0, 11: 1, 19: 1, 23: 2, 24: 2, 40: 3}


def test_typefind(spark):
    heads = {b"RIFF\0\0\0\0WAVE": "audio/x-wav", b"OggS": "application/ogg", b"\x1a\x45\xdf\xa3": "video/x-matroska", b"....ftyp": "video/quicktime", b"": "application/octet-stream", b"G": "application/octet-stream", b"Good morning": "application/octet-stream", b"G" + b"x" * 187: "video/mpegts", (b"G" + b"x" * 187) * 2: "video/mpegts", (b"G" + b"x" * 187) * 2 + b"x": "application/octet-stream", (b"G" + b"x" * 187) * 3: "video/mpegts"}
    df = spark.createDataFrame([(bytearray(h), k) for h, k in heads.items()], "p binary, k string")
    assert all(r.k == r.found for r in df.withColumn("found", flow.typefind(F.col("p"))).collect())


def test_softmax(spark):
    df = spark.createDataFrame([([1.0, 3.0, 3.0],)], "v array<double>")
    row = df.select(tensor.softmax(F.col("v")).alias("p"), tensor.argmax(F.col("v")).alias("i")).first()
    assert math.isclose(sum(row.p), 1) and row.i == 1
    with pytest.raises(Exception, match="finite"):
        spark.createDataFrame([([1.0, float("nan")],)], "v array<double>").select(tensor.softmax(F.col("v"))).collect()


def test_layouts_are_inverse(spark):
    df = spark.createDataFrame([([float(i) for i in range(24)],)], "v array<double>")
    back = tensor.nhwc_to_nchw(tensor.nchw_to_nhwc(F.col("v"), 2, 3, 4), 2, 3, 4)
    assert df.select(back.alias("v")).first().v == [float(i) for i in range(24)]
    want = np.arange(24).reshape(2, 3, 4).transpose(1, 2, 0).ravel().tolist()
    assert df.select(tensor.nchw_to_nhwc(F.col("v"), 2, 3, 4).alias("v")).first().v == want


def test_nms_against_a_loop(spark):
    rnd = np.random.default_rng(1)
    rows = [(0, i, int(rnd.integers(2)), float(rnd.random()), *map(float, rnd.random(2)), *map(float, 0.2 + 0.3 * rnd.random(2))) for i in range(60)]

    def iou(a, b):
        w = max(0, min(a[4] + a[6], b[4] + b[6]) - max(a[4], b[4]))
        h = max(0, min(a[5] + a[7], b[5] + b[7]) - max(a[5], b[5]))
        return w * h / (a[6] * a[7] + b[6] * b[7] - w * h)

    kept = []
    for r in sorted(rows, key=lambda r: -r[3]):
        if all(k[2] != r[2] or iou(k, r) <= 0.3 for k in kept):
            kept.append(r)
    df = spark.createDataFrame(rows, "frame int, id int, label int, conf double, x double, y double, w double, h double")
    assert {r.id for r in tensor.nms(df, 0.3).collect()} == {k[1] for k in kept}


def test_overlaps_against_a_loop(spark):
    """Groups of one tile and of many, with equal ids, nulls and boxes that touch only; the pairs are made in many tasks, however small the table."""
    rnd = np.random.default_rng(2)
    rows = [(0 if i < 90 else i % 7, i // 2 if 40 < i < 50 else i, *(float(v) / 8 for v in rnd.integers(0, 9, 2)), *(float(v) / 8 for v in rnd.integers(0, 4, 2))) for i in range(120)]
    want = {}
    for a in rows:
        for b in rows:
            w, h = (max(0.0, min(a[k] + a[k + 2], b[k] + b[k + 2]) - max(a[k], b[k])) for k in (2, 3))
            if a[0] == b[0] and a[1] < b[1] and w * h > 0:
                want.setdefault((a[0], a[1], b[1]), []).append(w * h / (a[4] * a[5] + b[4] * b[5] - w * h))
    df = spark.createDataFrame([*rows, (None, 1, 0.0, 0.0, 1.0, 1.0), (None, 2, 0.0, 0.0, 1.0, 1.0), (0, None, 0.0, 0.0, 1.0, 1.0)], "frame int, id int, x double, y double, w double, h double")
    for tile in (8, 1024):
        out, got = tensor.overlaps(df, ["frame"], tile), {}
        for r in out.collect():
            got.setdefault((r.frame, r.a, r.b), []).append(r.iou)
        assert {k: sorted(v) for k, v in got.items()} == {k: pytest.approx(sorted(v)) for k, v in want.items()}
        assert out.rdd.getNumPartitions() >= 4


def test_pairs_of_the_query_are_dealt_to_many_tasks(spark, small):
    assert tensor.u_iou(spark, small).rdd.getNumPartitions() >= 4


def test_feedback_echo_against_a_loop():
    x = np.random.default_rng(0).integers(-9000, 9000, 50).astype(float)
    line, want = [0.0] * 50, []
    for i, v in enumerate(x):
        back = line[i - 4] if i >= 4 else 0.0
        line[i] = v + 0.4 * back
        y = v + 0.6 * back
        want.append(math.floor(y + 0.5) if y >= 0 else math.ceil(y - 0.5))
    assert audio.feedback_echo(x, 4, 0.6, 0.4).tolist() == want


def test_flat_equaliser_changes_nothing():
    x = np.random.default_rng(0).integers(-9000, 9000, 50).astype(float)
    assert np.allclose(audio.biquad(x, audio.peaking(1000, 48_000, 0.7, 0.0)), x)


def test_downmix_rows_do_not_clip():
    stereo = audio.downmix(6, 2)
    assert math.isclose(max(sum(r) for r in stereo), 1) and stereo[0][3] == 0
    assert audio.downmix(2, 2) == [[1.0, 0.0], [0.0, 1.0]]


# --- containers -----------------------------------------------------------------------------------------------------------------

PACKETS = [(1, i * 40_000_000, i % 5 == 0, bytes([i % 256]) * (1 + 97 * i % 2500)) for i in range(60)]


def test_transport_stream_round_trip():
    data = containers.write_ts({0x101: 0x1B, 0x102: 0x0F}, [(0x101 if i % 3 else 0x102, ns, k, p) for i, (_, ns, k, p) in enumerate(PACKETS)])
    assert len(data) % 188 == 0
    got = sorted(containers.read_ts(data), key=lambda p: p[2])
    assert [(ns, k, p) for _, _, ns, k, p in got] == [(ns, k, p) for _, ns, k, p in PACKETS]
    assert {kind for _, kind, *_ in got} == {"h264", "aac"}
    assert len(list(containers.read_ts(b"junk" + data[: 188 * 7 + 50]))) <= 8


@pytest.mark.parametrize("write,read", [(lambda p: containers.write_mkv({1: "V_VP9"}, p), containers.read_mkv), (lambda p: containers.write_fmp4({1: 1_000_000}, p), containers.read_fmp4)])
def test_container_round_trip(write, read):
    data = write(PACKETS)
    assert [(n, ns, k, p) for n, _, ns, k, p in read(data)] == PACKETS
    for cut in range(0, len(data), 997):  # a file cut short gives what it holds
        assert len(list(read(data[:cut]))) <= len(PACKETS) if cut > 8 else True


def test_ogg_long_packets_and_bad_pages():
    packets = [(7, i, bytes([i]) * (255 * i)) for i in range(6)] + [(8, 3, b"x" * 70_000)]
    data = containers.write_ogg(packets)
    assert [(s, g if len(p) < 65_000 else 3, p) for s, _, g, _, p in containers.read_ogg(data)] == packets
    broken = bytearray(data)
    broken[30] ^= 1
    assert len(list(containers.read_ogg(bytes(broken)))) < len(packets)


def test_mux_and_demux_hold_a_file_at_a_time(spark, monkeypatch):
    """Files of 1 byte to 300 KB, with a null and an empty one: rows that go to Python are short, and so are the batches of both ways."""
    files = [(i, bytes([i]) * n) for i, n in enumerate((1, 2047, 2048, 2049, 300_000, 0))] + [(None, b"x" * 5000), (9, None)]
    df = spark.createDataFrame(files, "k int, p binary")
    rows = media.in_pieces(df, "k", "p")
    assert max(len(r.p) for r in rows.where("p IS NOT NULL").collect()) <= media.PIECE
    batch = rows.coalesce(1).toArrow().to_batches(max_chunksize=3)
    assert sorted(media.whole_files(iter(batch)), key=str) == sorted(((k, bytes(p or b"")) for k, p in files), key=str)

    monkeypatch.setitem(media.READERS, "bytes", lambda data: ((0, "byte", None, True, data[i : i + 1000]) for i in range(0, len(data), 1000)))
    assert sorted((str(r.k), r.sequence, bytes(r.payload)) for r in media.demux(df, "k", "p", "bytes").collect()) == sorted((str(k), i, bytes(p[i * 1000 : i * 1000 + 1000])) for k, p in files if p for i in range(-(-len(p) // 1000)))
    assert [b.num_rows for b in media.in_batches(iter([(i, bytes(3 << 20)) for i in range(5)]), media.StructType().add("k", media.LongType()).add("p", media.BinaryType()))] == [2, 2, 1]


def test_mux_writes_each_file_once_and_in_order(spark):
    """Keys that begin and end inside Arrow batches, one over several, one null; times come as whole numbers whatever the other files hold."""
    far = 1_700_000_000_000_000_001
    rows = [(k, i % 3, i, far + (i * 7919) % 1000, b"%d" % i) for k, n in (("a", 3), ("b", 25_000), (None, 4), ("c", 1)) for i in range(n)]
    df = spark.createDataFrame(rows, "key string, track long, sequence long, pts_ns long, payload binary").union(spark.createDataFrame([("n", 0, 0, None, b"x")], "key string, track long, sequence long, pts_ns long, payload binary"))
    text = lambda g: repr([(None if ns is None else int(ns), int(t), int(n), bytes(p)) for ns, t, n, p in zip(g["pts_ns"], g["track"], g["sequence"], g["payload"], strict=True)]).encode()
    got = {r.key: bytes(r.payload) for r in media.mux(df.repartition(1), "key", text).collect()}
    want = {}
    for k, t, n, ns, p in sorted(rows, key=lambda r: (r[3], r[1], r[2])):
        want.setdefault(k, []).append((ns, t, n, p))
    assert got == {k: repr(v).encode() for k, v in want.items()} | {"n": repr([(None, 0, 0, b"x")]).encode()}


def test_ogg_checksum_by_bits_and_its_speed():
    """Against the polynomial bit by bit; a page's bytes are turned by a table, so 8 MB take a second at most."""
    data = bytes(random.Random(3).randrange(256) for _ in range(999))
    for n in (0, 1, 4, 999):
        crc = 0
        for b in data[:n]:
            crc ^= b << 24
            for _ in range(8):
                crc = (crc << 1 ^ 0x04C11DB7 if crc & 0x80000000 else crc << 1) & 0xFFFFFFFF
        assert containers.ogg_crc(data[:n]) == crc
    began = time.perf_counter()
    containers.ogg_crc(bytes(8 << 20))
    assert time.perf_counter() - began < 1


def test_wav_klv_records_png():
    pcm = np.arange(-50, 51, dtype="<i2").tobytes()
    assert containers.read_wav(containers.write_wav(pcm, 1, 8000)) == (1, 8000, 16, pcm)
    items = [(1, b""), (127, b"a" * 127), (128, b"b" * 128), (70_000, b"c" * 70_000)]
    assert list(containers.read_klv(containers.write_klv(items))) == items
    assert list(containers.read_records(containers.write_records([b"", b"ab"]) + b"\x09\0\0\0x")) == [b"", b"ab"]
    px = np.random.default_rng(0).integers(0, 256, (5, 7, 4), np.uint8)
    assert (containers.read_png(containers.write_png(px)) == px).all()
    assert containers.fnv1a_64(b"a") == 0xAF63DC4C8601EC8C
    assert containers.klv_checksum(b"\x01\x02\x03") == 0x0102 + 0x0300


def test_elementary_streams():
    nal = lambda kind, first=0x80: b"\0\0\0\x01" + bytes([kind, first, 1])
    units = list(containers.h264_access_units(nal(7) + nal(8) + nal(5) + nal(1) + nal(1, 0x40) + nal(9) + nal(1)))
    assert [k for _, _, _, k, _ in units] == [True, False, False]
    frame = bytes([0xFF, 0xF1, 0x50, 0x80, 0x01, 0x3F, 0xFC]) + b"ab"
    assert [p for *_, p in containers.adts_frames(b"?" + frame + frame)] == [b"ab", b"ab"]
    assert containers.vp8_geometry(b"\0\0\0\x9d\x01\x2a\x40\x01\xf0\0") == (True, 320, 240)


def test_jitter_buffer(spark):
    def played(packets, hold=50, depth=64):
        arrival, number = np.asarray([t for t, _ in packets]), media.unwrapped(np.asarray([s for _, s in packets]))
        place, at = media.playout(arrival, number, hold, depth)
        return [packets[k][1] for k in place], at.tolist()

    assert media.unwrapped(np.asarray([65534, 0, 65535, 1])).tolist() == [65534, 65536, 65535, 65537]
    assert played([(0, 0), (1, 2), (2, 1), (3, 1), (4, 3)]) == ([0, 1, 2, 3], [0, 2, 2, 4])
    assert played([(0, 65535), (0, 1), (60, 2)]) == ([65535, 1, 2], [0, 60, 60])  # 0 is given up
    assert played([(0, 65535), (0, 1), (1, 2)], depth=2) == ([65535, 1, 2], [0, 1, 1])
    assert played([(0, 5), (0, 7)]) == ([5, 7], [0, 50])
    rows = [(1, t, s) for t, s in [(0, 65535), (1, 1), (62, 2), (63, 0), (64, 2)]]
    r = media.jitter_counts(spark.createDataFrame(rows, "k long, arrival_ns long, seq int"), "k", 50, 64).first()
    assert (r.received, r.played, r.duplicates, r.late, r.lost, r.reordered) == (5, 3, 1, 1, 1, 1)


# --- text, plans, sources ----------------------------------------------------------------------------------------------------------


def test_subtitle_formats(spark):
    docs = {
        "srt": "1\r\n00:00:01,5 --> 00:00:02,250\r\n<b>Hi</b> &amp;\r\nyou\r\n\r\nbroken\r\n\r\n2\r\n00:75:00,000 --> 00:76:00,000\r\nno\r\n",
        "ssa": "[Events]\nDialogue: 0,0:00:01.50,0:00:02.25,Default,,0,0,0,,{\\\\b1}Hi,\\Nyou\n".replace("\\\\b1", "\\b1"),
        "ttml": '<tt><p begin="00:00:01.500" end="00:00:02.250">Hi<br/>you</p></tt>',
    }
    for kind, want in (("srt", "Hi &\nyou"), ("ssa", "Hi,\nyou"), ("ttml", "Hi\nyou")):
        df = spark.createDataFrame([(1, docs[kind])], "k int, doc string")
        rows = files.CUES[kind](df, "k", F.col("doc")).collect()
        assert [(r.start_ns, r.end_ns, r.text) for r in rows] == [(1_500_000_000, 2_250_000_000, want)]
    assert text.STAMP


def test_caps():
    a = caps.parse("video/x-raw,format={NV12,I420},width=[1,640],framerate=30/1")
    b = caps.parse("video/x-raw,format=NV12,width=320,height=[2,480]")
    assert str(a.meet(b)) == "video/x-raw,format=NV12,width=320,height=[2,480],framerate=30/1"
    assert str(a.meet(b).fixate()) == "video/x-raw,format=NV12,width=320,height=2,framerate=30/1"
    assert a.meet(caps.parse("video/x-raw,width=800")) is None and a.meet(caps.parse("audio/x-raw")) is None
    assert caps.parse(str(a)) == a
    assert caps.parse("audio/x-raw,channels=0").meet(caps.parse("audio/x-raw,channels=2")).get("channels") == 2
    with pytest.raises(caps.CapsConflict):
        caps.meet_all([[a], [caps.parse("text/x-raw")]])


def test_launch(spark):
    out = launch.launch(spark, "videotestsrc num-buffers=9 ! video/x-raw,width=320 ! tee name=t ! fakesink name=a t. ! avoffset offset=5 ! fakesink name=b")
    assert {k: v.count() for k, v in out.items()} == {"a": 9, "b": 9}
    assert out["b"].agg(F.min("pts_ns")).first()[0] == 5
    both = launch.launch(spark, "funnel name=f ! fakesink videotestsrc num-buffers=3 ! f. videotestsrc num-buffers=2 ! f.")
    assert [r.input for r in both["fakesink0"].collect()] == [0, 1, 0, 1, 0]
    with pytest.raises(NotImplementedError, match="network source"):
        launch.launch(spark, "rtspsrc location=x ! fakesink")
    for name in ("wswiresink", "poolstage", "mfdecode", "gstwrap", "v2element", "webcodecsencode"):
        with pytest.raises(NotImplementedError):
            launch.resolve(name)
    with pytest.raises(ValueError, match="no field depth"):
        launch.launch(spark, "videotestsrc ! video/x-raw,depth=3 ! fakesink")
    scaled = launch.launch(spark, "videotestsrc num-buffers=2 ! videoscale ! queue ! video/x-raw,width=64 ! fakesink")["fakesink0"]
    assert {(r.width, r.height) for r in scaled.collect()} == {(64, 240)}
    tone = launch.launch(spark, "audiotestsrc num-buffers=2 ! audioconvert ! audio/x-raw,format=F32LE ! fakesink")["fakesink0"]
    assert tone.count() == 2048 and 0.7 < tone.agg(F.max("s")).first()[0] < 0.9
    for bad in ("! fakesink", "videotestsrc !", "nosuch ! fakesink", "a=b"):
        with pytest.raises(ValueError):
            launch.launch(spark, bad)
    g = launch.Graph()
    g.link(g.add("identity", "x"), g.add("identity", "y"), "x")
    with pytest.raises(ValueError, match="circle"):
        g.order()
    assert launch.from_document({"pipeline": "videotestsrc ! fakesink"}).links == [("videotestsrc0", "fakesink0")]


def test_autoplug():
    c = caps.parse
    steps = {"demux": [(c("video/mpegts"), c("video/x-h264"))], "parse": [(c("video/x-h264"), c("video/x-h264,parsed=yes"))], "dec": [(c("video/x-h264"), c("video/x-raw"))]}
    assert launch.autoplug(c("video/mpegts"), c("video/x-raw"), steps) == ["demux", "dec"]
    with pytest.raises(caps.CapsConflict):
        launch.autoplug(c("audio/x-raw"), c("video/x-raw"), steps)


def test_files(spark, tmp_path):
    df = synthetic.videotestsrc(spark, 40).withColumn("payload", F.col("sequence").cast("string").cast("binary"))
    files.record(df, str(tmp_path / "rec"))
    assert files.replay(spark, str(tmp_path / "rec"), 300_000_000, 600_000_000).count() == 9
    (tmp_path / "in").mkdir()
    for i in range(3):
        (tmp_path / "in" / f"f{i}.bin").write_bytes(containers.write_records([b"x" * i, b"y"]))
    assert files.multifilesrc(spark, str(tmp_path / "in"), r"f(\d+)\.bin", start=1).count() == 2
    assert files.recordsrc(spark, str(tmp_path / "in")).count() == 6
    assert files.filesrc(spark, str(tmp_path / "in"), 4).where("path LIKE '%f2.bin'").count() == 3
    (tmp_path / "c.srt").write_text("1\n00:00:01,000 --> 00:00:02,000\nHello\n")
    assert [r.text for r in files.subtitlesrc(spark, str(tmp_path / "c.srt")).collect()] == ["Hello"]
    seen = []
    assert files.appsink(df, lambda r: seen.append(r.sequence)) == 40 and seen == sorted(seen)
    files.fakesink(df)


def test_python_data_source(spark):
    spark.dataSource.register(live.TickSource)
    assert spark.read.format("framewright-tick").option("rows", 25).load().count() == 25


def test_nothing_imports_the_optional_part():
    import re
    from pathlib import Path

    root = Path(__file__).resolve().parents[1] / "framewright"
    for p in root.rglob("*.py"):
        if "llm" not in p.parts:
            assert not re.search(r"framewright\.llm|from framewright import llm", p.read_text()), p


def test_pictures():
    from framewright.functions import images

    px = np.random.default_rng(0).integers(0, 256, (8, 12, 4), np.uint8)
    px[..., 3] = 255
    for fmt in ("RGBA", "BGRA", "RGB"):
        assert (images.unpack(images.pack(px, fmt), fmt, 12, 8) == px).all()
    grey = np.dstack([np.full((8, 12), 90, np.uint8)] * 3 + [np.full((8, 12), 255, np.uint8)])
    for fmt, size in (("NV12", 144), ("I420", 144), ("YUYV", 192)):
        data = images.pack(grey, fmt)
        assert len(data) == size and np.abs(images.unpack(data, fmt, 12, 8).astype(int) - grey).max() <= 2
    assert (images.scale(px, 12, 8) == px).all() and images.scale(px, 5, 3).shape == (3, 5, 4)
    assert (images.over(px, px, 0, 0) == px).all() and (images.over(px, px, 50, 0) == px).all()
    assert images.clock_text(3_723_004_000_000) == "01:02:03.004"
    mask = images.mask_of(np.array([1.0]), np.full((1, 4, 5), -9.0), 0.5)
    assert images.mask_bounds(mask) is None
    mask[1:3, 2] = True
    assert images.mask_bounds(mask) == (2, 1, 1, 2)


def test_adpcm_and_fir():
    from framewright.operators import host

    x = np.round(8000 * np.sin(np.arange(400) / 20))
    back = host.adpcm_decode(host.adpcm_encode(x))
    assert np.sqrt(np.mean((back[50:] - x[50:]) ** 2)) < 200
    y = host.fir_resampled(x, 3, 2)
    assert len(y) == 600 and np.abs(y[100:500] - 8000 * np.sin(np.arange(100, 500) * 2 / 3 / 20)).max() < 60


def test_captions():
    from framewright.functions import captions

    pairs = [(i, a, b) for i, t in enumerate(["Hello\nñ 2", "Bye"]) for a, b in captions.encode_608(t)]
    assert list(captions.decode_608(pairs)) == [(0, 1, "Hello\nñ 2"), (1, None, "Bye")]
    noisy = [(n, a ^ 128, b) if i == 3 else (n, a, b) for i, (n, a, b) in enumerate(pairs)]
    assert list(captions.decode_608(noisy))[0][2] != "Hello\nñ 2"
    unit = captions.misp_sei(0x0000000100000203) + captions.caption_sei(captions.encode_608("x")) + b"\0\0\0\x01\x65\x88"
    assert captions.misp_time(unit) == 0x0000000100000203 and captions.caption_pairs(unit) == captions.encode_608("x")
    row = bytearray(captions.teletext_row(8, 20, "Subtitle"))
    row[0] ^= 4
    assert captions.read_teletext_row(bytes(row)) == (8, 20, "Subtitle")
    row[0] ^= 8
    assert captions.read_teletext_row(bytes(row)) is None


def test_subpictures():
    from framewright.functions import captions

    rng = np.random.default_rng(0)
    lines = np.repeat(rng.integers(0, 4, (6, 30)), rng.integers(1, 30, 30), axis=1).astype(np.uint8)
    assert (captions.dvd_runs(captions.dvd_pack(lines), lines.shape[1], 6) == lines).all()
    assert (captions.pgs_runs(captions.pgs_pack(lines), lines.shape[1], 6) == lines).all()
    assert captions.canvas(lines, {1: (9, 8, 7, 255)})[lines == 1].tolist()[0] == [9, 8, 7, 255]


def test_rtcp():
    from framewright.functions import rtcp

    block = {"ssrc": 7, "fraction": 12, "lost": -3, "highest": 70_000, "jitter": 5, "last_sr": 9, "delay": 65536}
    data = rtcp.sender_report(1, rtcp.ntp_of(1_700_000_000_123_456_789), 1 << 32 | 5, 2, 3, [block]) + bytes([0x81, 203, 0, 1, 0, 0, 0, 9])
    first, second = rtcp.parse_compound(data + b"\x80\xc8")
    assert first["blocks"] == [block] and (first["kind"], first["rtp_ts"], first["packets"]) == ("SR", 5, 2)
    assert (second["kind"], second["ssrc"]) == ("BYE", 9)
    assert abs(rtcp.unix_of(first["ntp"]) - 1_700_000_000_123_456_789) <= 1


def test_parsers():
    from framewright.functions import parsers

    samples = [(i * 100_000_000, i % 3 == 0, bytes([i]) * (i + 1)) for i in range(9)]
    data = parsers.write_mp4(samples)
    assert [(ns, k, p) for _, _, ns, k, p in parsers.read_mp4(data)] == samples
    assert list(parsers.read_mp4(data[:60])) == []
    obu = lambda kind, body: bytes([kind << 3 | 2, len(body)]) + body
    units = list(parsers.av1_temporal_units(obu(2, b"") + obu(1, b"seq") + obu(6, b"f") + obu(2, b"") + obu(6, b"g")))
    assert [[k for k, _ in u] for u in units] == [[2, 1, 6], [2, 6]]
    size = (0 << 44) | (639 << 28) | (359 << 12)
    assert parsers.vp9_key_frame(b"\x80\x49\x83\x42" + size.to_bytes(6, "big")) == (True, 640, 360)
    pes = b"\0\0\x01\xe0" + (3 + 5 + 4).to_bytes(2, "big") + b"\x80\x80\x05\x21\x00\x01\x00\x01abcd"
    pack = b"\0\0\x01\xba\x44" + b"\0" * 8 + b"\xf8"
    assert list(parsers.read_ps(pack + pes + b"\0\0\x01\xb9")) == [(0xE0, "video", 0, False, b"abcd")]
    s = np.arange(-32768, 32768, 7)
    back = parsers.alaw_decode(parsers.alaw_encode(s))
    assert np.abs(back - s).max() <= 1024 and (np.abs(back - s) <= np.maximum(16, np.abs(s) / 16)).all()
    assert (parsers.alaw_encode(back) == parsers.alaw_encode(s)).all()
    assert parsers.hls_playlist([(2_500_000_000, "a.m4s")], 4, True).splitlines()[2:] == ["#EXT-X-TARGETDURATION:3", "#EXT-X-MEDIA-SEQUENCE:4", "#EXTINF:2.500000,", "a.m4s", "#EXT-X-ENDLIST"]


#: The first example stream of RFC 9639, appendix D: one frame of one stereo sample.
RFC_FLAC = bytes.fromhex("664c6143800000221000100000000f00000f0ac442f0000000013e84b41807dc690307586a3dad1a2e0ffff869180000bf0358fd03128baa9a")


def test_flac_frames():
    (track, kind, ns, key, frame), *rest = parsers.read_flac(RFC_FLAC)
    assert (track, kind, ns, key, frame, rest) == (0, "flac", 0, True, RFC_FLAC[42:], [])
    bodies = [bytes([255, 248, n % 256]) * (n % 7) for n in range(2100)]  # sync words inside the frames, numbers of three bytes
    data = parsers.write_flac(48_000, bodies)
    got = list(parsers.read_flac(data))
    assert [p[2] for p in got] == [n * 4096 * 1_000_000_000 // 48_000 for n in range(2100)]
    assert b"".join(p[4] for p in got) == data[42:]
    assert len(list(parsers.read_flac(data[:-1]))) == 2099
    assert [parsers.coded_number(n) for n in (0x7F, 0x7FF, 0xFFFF, 0x10FFFF)] == [chr(n).encode() for n in (0x7F, 0x7FF, 0xFFFF, 0x10FFFF)]
    with pytest.raises(ValueError):
        list(parsers.read_flac(b"RIFF"))


def test_a_broken_file_keeps_its_packets(spark):
    whole = parsers.write_mp4([(0, True, b"a"), (1_000_000_000, False, b"b")])
    df = spark.createDataFrame([(1, RFC_FLAC), (2, b"RIFF"), (3, None)], "id long, p binary")
    got = sorted((r.id, r.kind) for r in media.demux(df, "id", "p", "flac").collect())
    assert got == [(1, "flac"), (2, "error"), (3, "error")]
    assert media.demux(spark.createDataFrame([(1, whole)], "id long, p binary"), "id", "p", "mp4").count() == 2


def test_reception_jitter_against_a_loop(spark):
    r = random.Random(5)
    rows = [(k, n * 20_000_000 + r.randrange(9_000_000), n * 1800) for k in range(4) for n in range(60)]
    want = {}
    for k in range(4):
        mine = sorted((a, t) for i, a, t in rows if i == k)
        transits = [(a - mine[0][0]) * 90_000 // 1_000_000_000 - t for a, t in mine]
        j = 0.0
        for a, b in zip(transits, transits[1:]):
            j += (abs(b - a) - j) / 16
        want[k] = j
    df = spark.createDataFrame(rows, "k long, arrival_ns long, rtp_ts long")
    for row in media.reception_jitter(df, "k", 90_000).collect():
        assert row.packets == 60 and abs(row.jitter - want[row.k]) <= 2


def test_biquad_against_the_difference_equation():
    x = np.random.default_rng(1).normal(size=300) * 1000
    b0, b1, b2, a1, a2 = c = audio.peaking(1100, 48_000, 0.7, -6.0)
    y = []
    for n in range(len(x)):
        old = lambda v, d: v[n - d] if n >= d else 0.0  # noqa: E731, B023
        y.append(b0 * x[n] + b1 * old(x, 1) + b2 * old(x, 2) - a1 * old(y, 1) - a2 * old(y, 2))
    assert np.allclose(audio.biquad(x, c), y)
    at = np.exp(-2j * math.pi * 1100 / 48_000)
    assert abs(20 * math.log10(abs((b0 + b1 * at + b2 * at**2) / (1 + a1 * at + a2 * at**2))) + 6) < 1e-6


def test_vobsub_index(spark):
    doc = "# VobSub\r\nsize: 720x576\r\nid: en, index: 0\r\n# id: xx\r\ntimestamp: 00:00:01:500, filepos: 000000000\r\ntimestamp: 01:00:00:000, filepos: 00000A800\r\nid: de, index: 3\r\nbad\r\ntimestamp: 00:00:02:000, filepos: 000001000\r\n"
    df = spark.createDataFrame([(1, doc), (2, None), (3, ""), (4, "id: fr")], "id long, doc string")
    got = {tuple(r) for r in packets.vobsub_index(df, "id", F.col("doc")).collect()}
    assert got == {(1, "en", 0, 1_500_000_000, 0, 0xA800), (1, "en", 0, 3_600_000_000_000, 0xA800, None), (1, "de", 3, 2_000_000_000, 0x1000, None)}


def test_vobsub_files(spark, tmp_path):
    def pes(sub: int, body: bytes) -> bytes:
        rest = b"\x81\x80\x05" + b"\x21\0\x01\0\x01" + bytes([sub]) + body
        return b"\0\0\x01\xba" + b"\x44" + b"\0" * 9 + b"\0\0\x01\xbd" + len(rest).to_bytes(2, "big") + rest

    unit = lambda fill, n: (n + 2).to_bytes(2, "big") + bytes([fill]) * n
    a, b, c = unit(1, 500), unit(2, 90), unit(3, 40)
    first = pes(0x20, a[:200]) + pes(0x21, b) + pes(0x20, a[200:])  # another language's packet within
    second = pes(0x20, c) + pes(0x20, unit(4, 100)[:50])
    at_b = len(pes(0x20, a[:200]))
    idx = f"id: en, index: 0\ntimestamp: 00:00:01:000, filepos: 000000000\ntimestamp: 00:00:02:000, filepos: {len(first):09x}\ntimestamp: 00:00:03:000, filepos: {len(first + pes(0x20, c)):09x}\nid: de, index: 1\ntimestamp: 00:00:01:000, filepos: {at_b:09x}\n"
    (tmp_path / "film.idx").write_text(idx)
    (tmp_path / "film.sub").write_bytes(first + second)
    (tmp_path / "lone.idx").write_text("id: fr, index: 0\ntimestamp: 00:00:01:000, filepos: 000000000\n")
    got = {(r.path.rsplit("/", 1)[1], r.language, r.start_ns // 10**9): r.payload and bytes(r.payload) for r in files.vobsubsrc(spark, str(tmp_path)).collect()}
    assert got == {("film", "en", 1): a, ("film", "en", 2): c, ("film", "en", 3): None, ("film", "de", 1): b, ("lone", "fr", 1): None}
    assert [r.language for r in files.vobsubsrc(spark, str(tmp_path), "de").collect()] == ["de"]


def test_identity_observes(spark):
    df, seen = flow.identity(spark.range(7).select((F.col("id") * 10).alias("pts_ns")), "seven")
    assert df.count() == 7
    assert seen.get == {"rows": 7, "first_ns": 0, "last_ns": 60}


def test_fec_brings_back_one_of_a_set(spark):
    r = random.Random(3)
    rows = [(s, n, bytearray(r.randbytes(r.choice([0, 1, 6, 7, 8, 1400])))) for s in range(30) for n in range(s * 10, s * 10 + 1 + s % 6)]
    p = spark.createDataFrame(rows, "s long, n long, payload binary")
    gone = {(s, n): bytes(b) for s, n, b in rows if n == s * 10 or s % 7 == 0 and n == s * 10 + 1}
    kept = p.where("NOT (n = s * 10 OR s % 7 = 0 AND n = s * 10 + 1)")
    got = {(x.s, x.n): bytes(x.payload) for x in media.fec_recover(kept, media.fec_protect(p, ["s"]), ["s"]).collect()}
    lost = {s: sum(k[0] == s for k in gone) for s in range(30)}
    assert got == {k: v for k, v in gone.items() if lost[k[0]] == 1}


def test_cuts_of_many_times_ties_and_nulls(spark):
    r = random.Random(9)
    rows = [(r.choice([None, 1, 2]), r.choice([None, *range(0, 5000, 7)]), r.random() < 0.5, i) for i in range(3000)]
    df = spark.createDataFrame(rows, "k long, pts_ns long, keyframe boolean, sequence long")
    cuts = {}
    for k in (None, 1, 2):
        cuts[k] = []
        for t in sorted({t for kk, t, key, _ in rows if kk == k and key and t is not None}):
            if not cuts[k] or t >= cuts[k][-1] + 300:
                cuts[k].append(t)
    got = {x.sequence: x.segment for x in flow.greedy_segments(df, ["k"], 300).collect()}
    assert got == {i: max(0, sum(c <= t for c in cuts[k]) - 1) if t is not None else 0 for k, t, _, i in rows}


def test_playlists_longer_than_a_long(spark):
    """Items of 30 days: from the 3559th on they begin beyond 2^63 ns. All rows come out, the sums before are exact, those beyond stay at the end."""
    day30, n = 30 * 86_400_000_000_000, 9000
    items = spark.range(n).select((F.col("id") * 3).alias("item"), F.explode(F.array(F.lit(5), F.lit(5 + day30))).alias("rel_ns"))
    got = {(r.item // 3, r.rel_ns): (r.pts_ns, int(r._o)) for r in merge.gapless(items.union(spark.sql("SELECT CAST(NULL AS BIGINT), 77L")), "item", 1000).collect()}
    begin = lambda i: i * (day30 + 1000)
    assert got == {(i, 5 + d): (min(begin(i) + d, 2**63 - 1), begin(i)) for i in range(n) for d in (0, day30)}
    far = spark.createDataFrame([(i, 2**62) for i in range(4)] + [(None, 9)], "input int, t long")
    assert sorted((r.input, r.t) for r in merge.concat(far, "t", F.lit(0)).collect()) == [(0, 2**62), (1, 2**63 - 1), (2, 2**63 - 1), (3, 2**63 - 1)]
    words = spark.createDataFrame([("b", 0), ("b", 7), ("a", 1)], "item string, rel_ns long")
    assert sorted((r.item, r.pts_ns) for r in merge.gapless(words, "item", 10).collect()) == [("a", 0), ("b", 10), ("b", 17)]
