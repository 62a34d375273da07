"""Box trees, byte ranges and messages: against naive reading, and through Spark."""

import struct

import numpy as np
import pytest
from hypothesis import given, settings
from hypothesis import strategies as st
from pyspark.sql import functions as F

from kinesieve.sources import container, wire
from kinesieve.sources.container import box, numbers


def reader(data):
    return lambda offset, size: data[offset : offset + size]


@pytest.mark.parametrize("gap", [0, 64, 16 * 1024, 10**9])
def test_ranges_equal_slices(gap):
    rng = np.random.default_rng(2)
    data = rng.bytes(200_000)
    offset, size = rng.integers(0, len(data), 400), rng.integers(0, 2500, 400)
    offset[:4], size[:4] = [0, 30, 30, len(data) - 7], [90, 10, 10, 500]
    reads = []
    assert container.read_ranges(lambda o, n: reads.append(n) or data[o : o + n], offset, size, gap) == [data[o : o + n] for o, n in zip(offset, size)]
    assert gap < 10**9 or len(reads) == 1
    assert container.read_ranges(reader(data), [], [], gap) == []


def movie(tables, edits=b"", handler=b"vide", wide=False):
    clock = numbers(0x01000000, 0, 0, 0, 0, 600) if wide else numbers(0, 0, 0, 600)
    track = numbers(0x01000000, 0, 0, 0, 0, 7) if wide else numbers(0, 0, 0, 7)
    media = box("mdia", box("mdhd", numbers(0, 0, 0, 90_000)), box("hdlr", numbers(0, 0), handler), box("minf", box("vmhd"), box("stbl", *tables)))
    return box("moov", box("mvhd", clock), box("udta", b"junk"), box("trak", box("tkhd", track), *([box("edts", edits)] if edits else []), media))


TABLES = [
    box("stsd", numbers(0, 1), box("avc1", bytes(24), (640).to_bytes(2, "big"), (480).to_bytes(2, "big"))),
    box("stts", numbers(0, 2), numbers(3, 1000), numbers(2, 500)), box("ctts", numbers(0x01000000, 2), numbers(1, 200), numbers(4, -100)),
    box("stss", numbers(0, 2), numbers(1, 4)), box("stsz", numbers(0, 0, 5), numbers(10, 20, 30, 40, 50)),
    box("stsc", numbers(0, 2), numbers(1, 2, 1), numbers(3, 1, 1)), box("stco", numbers(0, 3), numbers(1000, 5000, 300)),
]


def test_sample_tables():
    edits = box("elst", numbers(0, 2), numbers(60, -1), numbers(0x10000), numbers(500, 1000), numbers(0x10000))
    data = box("ftyp", b"isom") + numbers(1) + b"mdat" + numbers(24, width=8) + bytes(8) + movie(TABLES, edits, wide=True)
    (t,) = container.tracks(reader(data), len(data))
    assert (t.number, t.handler, t.fourcc, t.timescale, t.width, t.height) == (7, "vide", "avc1", 90_000, 640, 480)
    assert t.dts.tolist() == [0, 1000, 2000, 3000, 3500] and t.sync.tolist() == [True, False, False, True, False]
    assert t.pts.tolist() == [x + c + 9000 - 1000 for x, c in zip(t.dts.tolist(), (200, -100, -100, -100, -100))]
    assert t.offset.tolist() == [1000, 1010, 5000, 5030, 300] and t.size.tolist() == [10, 20, 30, 40, 50]


def test_other_tables():
    """One size for all, 64-bit places, no edit list, a chunk table shorter than the samples, and nothing at all."""
    tables = [*TABLES[:2], box("stsz", numbers(0, 8, 5)), box("stsc", numbers(0, 1), numbers(1, 3, 1)), box("co64", numbers(0, 1), numbers(1 << 40, width=8))]
    data = movie(tables)
    (t,) = container.tracks(reader(data), len(data))
    assert t.offset.tolist() == [1 << 40, (1 << 40) + 8, (1 << 40) + 16] and len(t.size) == 5 and t.sync.all()
    data = movie([])
    assert len(container.tracks(reader(data), len(data))[0].size) == 0
    with pytest.raises(ValueError):
        container.tracks(reader(b"\0\0\0\x08free"), 8)


@settings(max_examples=60, deadline=None)
@given(st.lists(st.binary(max_size=40), max_size=200), st.integers(1, 70))
def test_round_trip(samples, per_chunk):
    data = container.boxed(samples, [3] * len(samples), 1000, per_chunk=per_chunk)
    (t,) = container.tracks(reader(data), len(data))
    assert container.read_ranges(reader(data), t.offset, t.size) == samples and t.dts.tolist() == [3 * i for i in range(len(samples))]


def test_source_cuts_files_into_runs(spark, tmp_path):
    samples = {f"{i}.mp4": [bytes([i, j % 256]) * (j % 50) for j in range(700)] for i in range(3)}
    for name, own in samples.items():
        (tmp_path / name).write_bytes(container.boxed(own, [2] * 700, 100))
    (tmp_path / ".hidden").write_bytes(b"x")
    spark.dataSource.register(container.SampleSource)
    df = spark.read.format("boxed_samples").option("samples_per_task", 250).load(f"file://{tmp_path}")
    assert df.rdd.getNumPartitions() == 9
    got = {(r.file.rpartition("/")[2], r.sample): (bytes(r.data), r.time) for r in df.collect()}
    assert got == {(name, j): (x, j * 2 / 100) for name, own in samples.items() for j, x in enumerate(own)}
    bare = spark.read.format("boxed_samples").option("data", "false").option("track", "tser").load(f"{tmp_path}/1.mp4")
    assert bare.filter("data is null").agg(F.sum("size")).first()[0] == sum(map(len, samples["1.mp4"]))
    assert spark.read.format("boxed_samples").option("track", "vide").load(str(tmp_path)).count() == 0


def test_messages(spark):
    quat = b"".join(wire.varint(i << 3 | 5) + struct.pack("<f", x) for i, x in enumerate((1.0, 0.5, -0.25), 1))
    inner = wire.field(1, -5) + wire.field(2, quat) + wire.field(2, quat) + wire.varint(4 << 3 | 2) + wire.varint(3) + b"\x01\x96\x01"
    whole = wire.field(3, inner) + wire.field(7, "ünï") + wire.field(9, 2.5) + wire.field(8, 3)
    spec = {"n": ("3.1", "int"), "q": ("3.2", "floats"), "packed": ("3.4", "ints"), "name": ("7", "text"), "x": ("9", "double"), "z": ("8", "zigzag"), "none": ("5.1", "int"), "raw": ("3.2", "list"), "many": ("6", "ints")}
    df = spark.createDataFrame([(1, whole), (2, whole[:-3]), (3, None), (4, b""), (5, b"\x0b")], "i int, data binary")
    got = {r.i: r.m for r in df.select("i", wire.decoded("data", spec).alias("m")).collect()}
    m = got[1]
    assert (m.n, m.q, m.packed, m.name, m.x, m.z, m.none, m.many, m.broken) == (-5, [[1.0, 0.5, -0.25]] * 2, [1, 150], "ünï", 2.5, -2, None, [], False)
    assert m.raw == [quat, quat] and got[2].broken and got[2].n is None and got[5].broken
    assert got[3].broken is None and not got[4].broken and got[4].q == []


@settings(max_examples=200, deadline=None)
@given(st.integers(-(1 << 63), (1 << 63) - 1), st.binary(max_size=300), st.floats(allow_nan=False))
def test_field_round_trip(n, data, x):
    found = list(wire.fields(wire.field(1, n) + wire.field(200, data) + wire.field(3, x)))
    assert wire.signed(found[0][2]) == n and found[1] == (200, 2, data) and struct.unpack("<d", found[2][2])[0] == x


def test_readings_are_spread_over_frames(spark):
    df = spark.createDataFrame([(1, 0.0, [1, 2]), (1, 1.0, [3, 4, 5, 6]), (1, 3.0, [7, 8]), (2, 5.0, [9])], "clip int, t double, x array<int>")
    got = {r.reading: r.t for r in wire.spread(df, ["clip"], "t", "x").collect()}
    assert got == {1: 0.0, 2: 0.5, 3: 1.0, 4: 1.5, 5: 2.0, 6: 2.5, 7: 3.0, 8: 4.0, 9: 5.0}


def test_small_files_share_tasks_and_hold_tracks(spark, tmp_path):
    """Many small files are few tasks, which planning does not open; a file's tracks come apart again."""
    own = {(i, n): [bytes([i % 256, n, j]) * (j % 5) for j in range(20 + n)] for i in range(300) for n in (1, 2, 3)}
    for i in range(300):
        (tmp_path / f"{i}.mp4").write_bytes(container.boxed_tracks([(own[i, n], [n] * (20 + n)) for n in (1, 2, 3)], 100))
    files = container.files_in(f"file://{tmp_path}")
    small, large = container.bundles([*files, ("big", 1 << 30)], 64 << 20, 100_000)
    assert len(small) == 1 and large == ["big"] and len(small[0].files) == 300
    assert len(container.bundles(files * 10, 64 << 20, 100_000)[0]) == 6
    spark.dataSource.register(container.SampleSource)
    df = spark.read.format("boxed_samples").load(f"file://{tmp_path}")
    assert df.rdd.getNumPartitions() == 1
    got = {(int(r.file.rpartition("/")[2][:-4]), r.track, r.sample): (bytes(r.data), r.dts) for r in df.collect()}
    assert got == {(i, n, j): (x, j * n) for (i, n), part in own.items() for j, x in enumerate(part)}


def test_events_take_few_files(spark, tmp_path):
    from kinesieve.plans import containers

    rows = spark.range(9000).selectExpr("id % 1500 as clip_id", "id as event_id", "id * 1000 as t", "'x' as event_type", "cast(id as double) as value", "cast(id % 7 as int) as k")
    files = containers.write_containers(rows, f"file://{tmp_path}").collect()
    assert len(files) == 2 and sum(f.samples for f in files) == 9000 and len(list(tmp_path.glob("*.mp4"))) == 2
