"""Box-structured containers (ISO base media files) as a table of samples, read by byte ranges.

    spark.dataSource.register(SampleSource)
    spark.read.format("boxed_samples").option("track", "meta").load("hdfs://.../clips")

Planning reads the sample tables of each large file, not its samples, and cuts them into runs of bounded
size and count; a task reads its run's ranges, those that lie close together in one go, and hands
rows over in batches. So a file of any size is many rows and many tasks. Small files are not opened by
planning: many of them go to one task, which reads their tables too. Paths are whatever
pyarrow.fs.FileSystem.from_uri opens; a folder stands for the files in it.
"""

from __future__ import annotations

from collections.abc import Callable, Iterator
from dataclasses import dataclass, field

import numpy as np
import pyarrow as pa
from pyspark.sql.datasource import DataSource, DataSourceReader, InputPartition

Read = Callable[[int, int], bytes]
#: Boxes that hold boxes, as far as sample tables need (fixed values).
NESTED = ("moov", "trak", "edts", "mdia", "minf", "stbl")
#: Ranges closer than this are read in one go.
GAP = 16 * 1024
SCHEMA = "file string, track int, handler string, fourcc string, sample long, dts long, pts long, time double, sync boolean, offset long, size long, data binary"


def opened(path: str):
    """A file for random reads, and its size."""
    from pyarrow import fs

    system, name = fs.FileSystem.from_uri(path) if "://" in path else (fs.LocalFileSystem(), path)
    return system.open_input_file(name), system.get_file_info(name).size


def files_in(path: str) -> list[tuple[str, int]]:
    """The file itself, or the files of a folder, by name, each with its size; hidden ones are left out."""
    from pyarrow import fs

    scheme = path.split("://")[0] + "://" if "://" in path else ""
    system, name = fs.FileSystem.from_uri(path) if scheme else (fs.LocalFileSystem(), path)
    own = system.get_file_info(name)
    if own.type == fs.FileType.File:
        return [(path, own.size)]
    found = [x for x in system.get_file_info(fs.FileSelector(name)) if x.type == fs.FileType.File and x.base_name[0] not in "._"]
    return [(scheme + x.path, x.size) for x in sorted(found, key=lambda x: x.path)]


def reader_of(handle) -> Read:
    def read(offset: int, size: int) -> bytes:
        handle.seek(offset)
        return handle.read(size)

    return read


@dataclass
class Box:
    kind: str
    start: int
    stop: int
    inside: list["Box"] = field(default_factory=list)

    def all(self, *path: str) -> list["Box"]:
        """The boxes under a path of kinds."""
        found = [x for x in self.inside if x.kind == path[0]]
        return found if len(path) == 1 else [y for x in found for y in x.all(*path[1:])]


def boxes(read: Read, start: int, stop: int, top: bool = False) -> list[Box]:
    """The boxes in a range. Only headers are read; at the top, nothing after the movie box."""
    out = []
    while stop - start >= 8:
        head = read(start, 16)
        if len(head) < 8:
            break
        length, skip = int.from_bytes(head[:4], "big"), 8
        if length == 1:
            length, skip = int.from_bytes(head[8:16], "big"), 16
        elif length == 0:
            length = stop - start
        if length < skip:
            break
        box = Box(head[4:8].decode("latin-1"), start + skip, min(start + length, stop))
        if box.kind in NESTED:
            box.inside = boxes(read, box.start, box.stop)
        out.append(box)
        if top and box.kind == "moov":
            break
        start += length
    return out


@dataclass
class Track:
    """A track's samples in decoding order; times in ticks of `timescale`."""

    number: int
    handler: str = ""
    fourcc: str = ""
    timescale: int = 1
    width: int = 0
    height: int = 0
    dts: np.ndarray = field(default_factory=lambda: np.zeros(0, np.int64))
    pts: np.ndarray = field(default_factory=lambda: np.zeros(0, np.int64))
    sync: np.ndarray = field(default_factory=lambda: np.zeros(0, bool))
    offset: np.ndarray = field(default_factory=lambda: np.zeros(0, np.int64))
    size: np.ndarray = field(default_factory=lambda: np.zeros(0, np.int64))


class Movie:
    """Reads the tables under one movie box."""

    def __init__(self, read: Read, box: Box):
        self.read, self.box = read, box
        clock = self.payload(box.all("mvhd"))
        self.timescale = self.clock(clock) if clock else 1

    def payload(self, found: list[Box]) -> bytes:
        return self.read(found[0].start, found[0].stop - found[0].start) if found else b""

    @staticmethod
    def clock(data: bytes) -> int:
        at = 20 if data[0] == 1 else 12
        return max(int.from_bytes(data[at : at + 4], "big"), 1)

    @staticmethod
    def entries(data: bytes, width: int, kind: str = ">u4", at: int = 4) -> np.ndarray:
        """A counted table of `width` numbers an entry."""
        if len(data) < at + 4:
            return np.zeros((0, width), np.int64)
        count = int.from_bytes(data[at : at + 4], "big")
        step = width * np.dtype(kind).itemsize
        count = min(count, (len(data) - at - 4) // step)
        return np.frombuffer(data, kind, count * width, at + 4).reshape(count, width).astype(np.int64)

    def shift(self, trak: Box, timescale: int) -> int:
        """What the edit list adds to presentation times: empty edits delay, the first real one moves
        its start to zero."""
        data = self.payload(trak.all("edts", "elst"))
        if not data:
            return 0
        wide = data[0] == 1
        each, number = (20, 8) if wide else (12, 4)
        out = 0
        for i in range(int.from_bytes(data[4:8], "big")):
            row = data[8 + i * each : 8 + (i + 1) * each]
            length, begin = int.from_bytes(row[:number], "big"), int.from_bytes(row[number : 2 * number], "big", signed=True)
            if begin != -1:
                return out - begin
            out += round(length * timescale / self.timescale)
        return out

    def track(self, trak: Box) -> Track:
        head = self.payload(trak.all("tkhd"))
        out = Track(int.from_bytes(head[20:24] if head[:1] == b"\x01" else head[12:16], "big"))
        media = self.payload(trak.all("mdia", "mdhd"))
        out.timescale = self.clock(media) if media else 1
        out.handler = self.payload(trak.all("mdia", "hdlr"))[8:12].decode("latin-1")
        tables = {b.kind: b for b in trak.all("mdia", "minf", "stbl")[0].inside} if trak.all("mdia", "minf", "stbl") else {}
        data = {k: self.payload([b]) for k, b in tables.items() if k in ("stsd", "stts", "ctts", "stsz", "stsc", "stco", "co64", "stss")}
        about = data.get("stsd", b"")
        out.fourcc = about[12:16].decode("latin-1")
        if out.handler == "vide" and len(about) >= 44:
            out.width, out.height = int.from_bytes(about[40:42], "big"), int.from_bytes(about[42:44], "big")
        sizes = data.get("stsz", b"")
        if len(sizes) < 12 or "stts" not in data:
            return out
        fixed, n = int.from_bytes(sizes[4:8], "big"), int.from_bytes(sizes[8:12], "big")
        out.size = np.full(n, fixed, np.int64) if fixed else self.entries(sizes, 1, at=8)[:, 0]
        n = len(out.size)
        lasts = self.entries(data["stts"], 2)
        length = np.repeat(lasts[:, 1], lasts[:, 0])
        out.dts = np.concatenate(([0], np.cumsum(np.resize(length, n) if len(length) >= n else np.pad(length, (0, n - len(length))))[: max(n - 1, 0)]))[:n].astype(np.int64)
        late = np.zeros(n, np.int64)
        if "ctts" in data:
            runs = self.entries(data["ctts"], 2, ">i4" if data["ctts"][0] == 1 else ">u4")
            given = np.repeat(runs[:, 1], runs[:, 0])[:n]
            late[: len(given)] = given
        out.pts = out.dts + late + self.shift(trak, out.timescale)
        out.sync = np.ones(n, bool)
        if "stss" in data:
            marks = self.entries(data["stss"], 1)[:, 0]
            out.sync = np.isin(np.arange(1, n + 1), marks)
        out.offset = self.places(data, out.size)
        return out

    def places(self, data: dict[str, bytes], size: np.ndarray) -> np.ndarray:
        """Where each sample lies: chunks hold runs of samples without gaps. None if the tables say nothing."""
        starts = self.entries(data["co64"], 1, ">u8")[:, 0] if "co64" in data else self.entries(data.get("stco", b""), 1)[:, 0]
        rule = self.entries(data.get("stsc", b""), 3)
        if not len(starts) or not len(rule):
            return np.zeros(0, np.int64)
        which = np.searchsorted(rule[:, 0], np.arange(1, len(starts) + 1), side="right") - 1
        last = np.cumsum(np.where(which >= 0, rule[which, 1], 0))  # samples up to the end of each chunk
        n = min(len(size), int(last[-1]))
        chunk = np.searchsorted(last, np.arange(n), side="right")
        ends = np.concatenate(([0], np.cumsum(size)))
        first = np.concatenate(([0], last))[chunk]
        return starts[chunk] + ends[:n] - ends[first]


def tracks(read: Read, size: int) -> list[Track]:
    """The tracks of a file with their samples; a file without a movie box is an error."""
    found = [b for b in boxes(read, 0, size, top=True) if b.kind == "moov"]
    if not found:
        raise ValueError("no movie box")
    movie = Movie(read, found[0])
    return [movie.track(x) for x in found[0].all("trak")]


def chosen(every: list[Track], wanted: str) -> list[Track]:
    """Tracks by number, fourcc or handler; "video" is the largest picture; all if empty."""
    if wanted == "video":
        seen = [t for t in every if t.handler == "vide"]
        return [max(seen, key=lambda t: (t.width * t.height, len(t.size)))] if seen else []
    return [t for t in every if wanted in ("", str(t.number), t.fourcc, t.handler)]


def joined_ranges(offset: np.ndarray, size: np.ndarray, gap: int = GAP) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
    """Ranges that lie within `gap` of each other as one: (start, stop) of each, and which one holds
    each of the ranges given."""
    if not len(offset):
        return np.zeros(0, np.int64), np.zeros(0, np.int64), np.zeros(0, np.int64)
    order = np.argsort(offset, kind="stable")
    begin, stop = offset[order], np.maximum.accumulate(offset[order] + size[order])
    opens = np.concatenate(([True], begin[1:] > stop[:-1] + gap))
    group = np.empty(len(order), np.int64)
    group[order] = np.cumsum(opens) - 1
    closes = np.concatenate((opens[1:], [True]))
    return begin[opens], stop[closes], group


def read_ranges(read: Read, offset, size, gap: int = GAP) -> list[bytes]:
    """The bytes of each range, in the order given; what lies past the end of the file is missing."""
    offset, size = np.asarray(offset, np.int64), np.asarray(size, np.int64)
    start, stop, group = joined_ranges(offset, size, gap)
    held = [read(int(a), int(b - a)) for a, b in zip(start, stop)]
    return [held[g][o - start[g] : o - start[g] + n] for g, o, n in zip(group.tolist(), offset.tolist(), size.tolist())]


@dataclass
class Run(InputPartition):
    """Consecutive samples of a track, by their tables."""

    file: str
    track: Track
    first: int


@dataclass
class Bundle(InputPartition):
    """Small files, whole."""

    files: list[str]


#: A sample takes as many bytes of a file at least, in the table of sizes.
LEAST = 4


def bundles(files: list[tuple[str, int]], most_bytes: int, most_samples: int) -> tuple[list[Bundle], list[str]]:
    """Files that can hold no more than a task's share by their size, as many together as make up one; and
    the larger files. A file counts for FILE bytes at least."""
    small, large, held = [], [], 0
    for file, size in files:
        if size > min(most_bytes, LEAST * most_samples):
            large.append(file)
            continue
        size = max(size, FILE)
        if not small or held + size > min(most_bytes, BUNDLE):
            small.append(Bundle([]))
            held = 0
        small[-1].files.append(file)
        held += size
    return small, large


#: Bytes of a task's small files, and what opening one of them counts for.
BUNDLE, FILE = 8 << 20, 16 << 10


def runs(file: str, track: Track, most_bytes: int, most_samples: int) -> Iterator[Run]:
    n = len(track.offset)
    total, first = np.concatenate(([0], np.cumsum(track.size[:n]))), 0
    while first < n:
        stop = int(np.searchsorted(total, total[first] + most_bytes, side="right")) - 1
        stop = min(max(stop, first + 1), first + most_samples, n)
        cut = slice(first, stop)
        part = Track(track.number, track.handler, track.fourcc, track.timescale, track.width, track.height, track.dts[cut], track.pts[cut], track.sync[cut], track.offset[cut], track.size[cut])
        yield Run(file, part, first)
        first = stop


class SampleReader(DataSourceReader):
    def __init__(self, options: dict):
        self.path = options.get("path", "")
        self.wanted = options.get("track", "")
        self.with_data = options.get("data", "true").lower() == "true"
        self.most_bytes = int(options.get("bytes_per_task", 64 << 20))
        self.most_samples = int(options.get("samples_per_task", 100_000))
        self.gap = int(options.get("gap", GAP))

    def partitions(self) -> list[InputPartition]:
        small, large = bundles(files_in(self.path), self.most_bytes, self.most_samples)
        out: list[InputPartition] = list(small)
        for file in large:
            handle, size = opened(file)
            with handle:
                for track in chosen(tracks(reader_of(handle), size), self.wanted):
                    out += runs(file, track, self.most_bytes, self.most_samples)
        return out

    def read(self, part: Run | Bundle | None) -> Iterator[pa.RecordBatch]:
        if part is None:  # no file has such a track
            return
        if isinstance(part, Run):
            handle, _ = opened(part.file)
            with handle:
                yield from joined(self.rows(reader_of(handle), part))
            return
        yield from joined(x for file in part.files for x in self.whole(file))

    def whole(self, file: str) -> Iterator[pa.RecordBatch]:
        """The rows of a small file, which is read in one go."""
        handle, _ = opened(file)
        with handle:
            data = handle.read()
        read: Read = lambda offset, size: data[offset : offset + size]
        for track in chosen(tracks(read, len(data)), self.wanted):
            for run in runs(file, track, self.most_bytes, self.most_samples):
                yield from self.rows(read, run)

    def rows(self, read: Read, run: Run) -> Iterator[pa.RecordBatch]:
        t, kinds = run.track, ("string", "int32", "string", "string", "int64", "int64", "int64", "float64", "bool", "int64", "int64", "binary")
        first = 0
        while first < len(t.size):
            full = np.searchsorted(np.cumsum(t.size[first:]), 4 << 20, side="right")
            cut = slice(first, first + min(max(int(full), 1), BATCH))
            n = len(t.size[cut])
            data = read_ranges(read, t.offset[cut], t.size[cut], self.gap) if self.with_data else [None] * n
            values = [
                [run.file] * n, [t.number] * n, [t.handler] * n, [t.fourcc] * n, np.arange(first, first + n) + run.first, t.dts[cut],
                t.pts[cut], t.pts[cut] / t.timescale, t.sync[cut], t.offset[cut], t.size[cut], data,
            ]
            yield pa.RecordBatch.from_arrays([pa.array(v, pa.type_for_alias(k)) for v, k in zip(values, kinds)], [c.split()[0] for c in SCHEMA.split(", ")])
            first += n


#: Rows of a batch.
BATCH = 10_000


def joined(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    """Small batches put together, up to BATCH rows or about 4 MB."""
    held, rows, size = [], 0, 0
    for batch in batches:
        if held and (rows + batch.num_rows > BATCH or size + batch.nbytes > 4 << 20):
            yield pa.concat_batches(held)
            held, rows, size = [], 0, 0
        held.append(batch)
        rows, size = rows + batch.num_rows, size + batch.nbytes
    if held:
        yield pa.concat_batches(held)


class SampleSource(DataSource):
    """Options: path; track (number, fourcc, handler or "video"); data ("false": tables only);
    bytes_per_task, samples_per_task, gap."""

    @classmethod
    def name(cls) -> str:
        return "boxed_samples"

    def schema(self) -> str:
        return SCHEMA

    def reader(self, schema) -> SampleReader:
        return SampleReader(dict(self.options))


def box(kind: str, *parts: bytes) -> bytes:
    body = b"".join(parts)
    return (len(body) + 8).to_bytes(4, "big") + kind.encode("latin-1") + body


def numbers(*values: int, width: int = 4) -> bytes:
    return b"".join(int(v).to_bytes(width, "big", signed=v < 0) for v in values)


def boxed(samples: list[bytes], lasts: list[int], timescale: int, handler: str = "meta", fourcc: str = "tser", per_chunk: int = 64) -> bytes:
    """A file of one track: samples, how long each lasts in ticks, and the tables that lead to them."""
    return boxed_tracks([(samples, lasts)], timescale, handler, fourcc, per_chunk)


def boxed_tracks(every: list[tuple[list[bytes], list[int]]], timescale: int, handler: str = "meta", fourcc: str = "tser", per_chunk: int = 64) -> bytes:
    """A file of tracks, numbered from 1, each of samples and how long they last."""
    total = sum(len(x) for samples, _ in every for x in samples)
    data = box("ftyp", b"isom", numbers(0)) + (total + 8).to_bytes(4, "big") + b"mdat"
    traks, place = [], len(data)
    for number, (samples, lasts) in enumerate(every, 1):
        sizes = [len(x) for x in samples]
        chunk = []
        for i, n in enumerate(sizes):
            if i % per_chunk == 0:
                chunk.append(place)
            place += n
        left = len(samples) % per_chunk
        rule = [(1, per_chunk, 1)] if len(samples) >= per_chunk else []
        if left:
            rule.append((len(chunk), left, 1))
        tables = [
            box("stsd", numbers(0, 1), box(fourcc, bytes(8))), box("stts", numbers(0, len(lasts)), *[numbers(1, x) for x in lasts]),
            box("stsz", numbers(0, 0, len(sizes)), numbers(*sizes)), box("stsc", numbers(0, len(rule)), *[numbers(*x) for x in rule]), box("co64", numbers(0, len(chunk)), numbers(*chunk, width=8)),
        ]
        media = box("mdia", box("mdhd", clocked(lasts, timescale), bytes(4)), box("hdlr", numbers(0, 0), handler.encode(), bytes(13)), box("minf", box("stbl", *tables)))
        traks.append(box("trak", box("tkhd", numbers(0, 0, 0, number, 0), bytes(64)), media))
    longest = max((lasts for _, lasts in every), key=sum, default=[])
    movie = box("moov", box("mvhd", clocked(longest, timescale), bytes(80)), *traks)
    return b"".join([data, *(x for samples, _ in every for x in samples), movie])


def clocked(lasts: list[int], timescale: int) -> bytes:
    return numbers(0, 0, 0, timescale, min(sum(lasts), 0xFFFFFFFF))
