"""Queries that take events through containers and messages and back."""

from __future__ import annotations

import uuid
from itertools import groupby

import pandas as pd
from pyspark.sql import functions as F

from kinesieve.operators.windows import placed
from kinesieve.plans.sequences import KEYS, ORDER, S, events
from kinesieve.sources import container, wire
from kinesieve.sources.rounds import shared_folder

#: Samples of one track, and about how many of a file.
PART, FILE = 1024, 4096
MESSAGE = {"clip_id": ("1.1", "int"), "event_id": ("1.2", "int"), "event_type": ("1.3", "text"), "value": ("2.1", "double"), "digits": ("2.2", "ints")}


def message(r) -> bytes:
    digits = b"".join(wire.varint(int(x)) for x in str(r.k)) if r.k is not None else b""
    own = wire.field(1, int(r.clip_id)) + wire.field(2, int(r.event_id)) + wire.field(3, r.event_type)
    return wire.field(1, own) + wire.field(2, (b"" if r.value is None else wire.field(1, float(r.value))) + wire.field(2, digits))


def write_containers(df, folder: str):
    """A track for every PART rows of a clip, many of them in a file: (path, samples). Times are milliseconds."""
    n_files = max(1, round(df.count() / FILE))
    parts = placed(df, KEYS, ORDER).withColumn("part", F.floor(F.col("place") / PART)).withColumn("value", F.col("value").cast("double"))
    parts = parts.withColumn("file", F.pmod(F.xxhash64("clip_id", "part"), F.lit(n_files)))

    def write(pdf: pd.DataFrame) -> pd.DataFrame:
        from pyarrow import fs

        pdf = pdf.sort_values(["clip_id", "place"])
        pdf = pdf.astype(object).where(pdf.notna(), None)
        tracks = []
        for _, rows in groupby(pdf.itertuples(), lambda r: (r.clip_id, r.part)):
            rows = list(rows)
            ms = [int(r.t) // 1000 for r in rows]
            tracks.append(([message(r) for r in rows], [b - a for a, b in zip(ms, ms[1:])] + [0]))
        data = container.boxed_tracks(tracks, 1000)
        system, base = fs.FileSystem.from_uri(folder)
        system.create_dir(base, recursive=True)
        name = f"{base}/{pdf['file'].iloc[0]}.mp4"
        with system.open_output_stream(name) as out:
            out.write(data)
        return pd.DataFrame({"path": [name], "samples": [len(pdf)]})

    return parts.select("file", "clip_id", "part", "place", "event_id", "t", "event_type", "value", "k").groupBy("file").applyInPandas(write, "path string, samples long")


def container_samples(spark, sf_dir):
    """Events as messages in containers, written to the shared folder and read back by byte ranges."""
    folder = f"{shared_folder(spark)}/kinesieve/containers-{uuid.uuid4().hex}"
    write_containers(events(spark, sf_dir), folder).agg(F.sum("samples")).collect()
    spark.dataSource.register(container.SampleSource)
    rows = spark.read.format("boxed_samples").option("track", "meta").load(folder)
    out = rows.select("sample", "dts", wire.decoded("data", MESSAGE).alias("m")).select("m.*", "sample", "dts")
    k = F.array_join(F.transform("digits", lambda x: x.cast("string")), "").cast("int")
    return out.filter("not broken").select("clip_id", "event_id", "event_type", F.round("value", 6).alias("value"), k.alias("k"), "sample", "dts")


SQL = {
    "container_samples": f"""WITH {S}, p AS (SELECT s.clip_id, s.event_id, s.event_type, s.value, CAST(json_extract(e.props, '$.k') AS INTEGER) AS k, s.t // 1000 AS ms, row_number() OVER (PARTITION BY clip_id ORDER BY s.t, s.event_id) - 1 AS place
 FROM s JOIN events e ON e.event_id = s.event_id)
SELECT clip_id, event_id, event_type, round(value, 6) AS value, k, place % 1024 AS sample, CAST(ms - first_value(ms) OVER (PARTITION BY clip_id, place // 1024 ORDER BY place) AS BIGINT) AS dts FROM p""",
}
QUERIES = {name: globals()[name] for name in SQL}
