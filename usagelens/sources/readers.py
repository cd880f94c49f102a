"""File sources and sinks."""

from __future__ import annotations

import struct

import pandas as pd
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

SAMPLES = "ts timestamp, instance string, pid int, generation int, rss_kb long, heap_used_kb long"
DELTAS = "class_id int, probe_index int, kind int, first_seen_at long, hits_total long"


def memory_samples(spark: SparkSession, path: str) -> DataFrame:
    """CSV with a header; rows that don't parse are left out."""
    return spark.read.schema(SAMPLES).option("mode", "DROPMALFORMED").csv(path, header=True)


def json_or_default(spark: SparkSession, path: str, schema: str, default: list[tuple]) -> DataFrame:
    """The default where the file is missing or no object of it parses."""
    try:
        rows = spark.read.schema(schema).option("mode", "DROPMALFORMED").option("multiLine", True).json(path)
        return rows if not rows.isEmpty() else spark.createDataFrame(default, schema)
    except Exception as e:
        if "PATH_NOT_FOUND" in str(e):
            return spark.createDataFrame(default, schema)
        raise


def log_lines(spark: SparkSession, path: str) -> DataFrame:
    """Lines with the role that the file's name gives: agent, collector, load or other."""
    role = F.regexp_extract(F.input_file_name(), r"/([a-z]+)[^/]*$", 1)
    return spark.read.text(path).select(F.when(role.isin("agent", "collector", "load"), role).otherwise("other").alias("role"), F.col("value").alias("text"))


def prometheus(lines: DataFrame) -> DataFrame:
    """(name, labels map, value) of exposition lines; comments and lines that don't parse are left out. The expressions are fixed by the
    exposition format."""
    form = r"^([A-Za-z_:][A-Za-z0-9_:]*)(?:\{(.*)\})?\s+([^\s]+)(?:\s+\d+)?$"
    x = lines.where(~F.startswith("value", F.lit("#"))).select(F.regexp_extract("value", form, 1).alias("name"), F.regexp_extract("value", form, 2).alias("l"), F.regexp_extract("value", form, 3).try_cast("double").alias("v"))
    names = F.regexp_extract_all("l", F.lit(r'([A-Za-z_][A-Za-z0-9_]*)="((?:[^"\\]|\\.)*)"'), 1)
    values = F.regexp_extract_all("l", F.lit(r'([A-Za-z_][A-Za-z0-9_]*)="((?:[^"\\]|\\.)*)"'), 2)
    # of a label given twice the last counts
    last = lambda m, e: F.map_concat(F.map_filter(m, lambda k, _: k != e["n"]), F.map_from_entries(F.array(F.struct(e["n"], e["v"]))))
    labels = F.aggregate(F.zip_with(names, values, lambda n, v: F.struct(n.alias("n"), v.alias("v"))), F.create_map().cast("map<string,string>"), last)
    return x.where("name <> '' and v is not null").select("name", labels.alias("labels"), F.col("v").alias("value"))


def counts(lines: DataFrame) -> DataFrame:
    """``<path> n n``; other lines are left out."""
    p = F.split(F.trim("value"), r"\s+")
    return lines.where(F.size(p) == 3).select(p[0].alias("path"), p[1].try_cast("long").alias("first"), p[2].try_cast("long").alias("second")).where("first is not null and second is not null")


def steal_ticks(lines: DataFrame) -> DataFrame:
    """The steal ticks of /proc/stat's cpu line."""
    return lines.where(F.startswith("value", F.lit("cpu "))).select(F.try_element_at(F.split(F.trim("value"), r"\s+"), F.lit(9)).try_cast("long").alias("steal"))


def cpu_set(col):
    """The members of a cpuset such as ``0-2,5``."""
    part = lambda p: F.split(p, "-")
    return F.flatten(F.transform(F.split(col, ","), lambda p: F.sequence(part(p)[0].cast("int"), F.element_at(part(p), -1).cast("int"))))


def write_runs(runs: DataFrame, metrics: list[str], path: str) -> None:
    """One CSV row per run, a column per metric, empty where a run lacks it."""
    runs.select("config", "variant", "repeat", *[F.col("metrics")[m].alias(m) for m in metrics]).write.mode("overwrite").csv(path, header=True, emptyValue="", nullValue="")


def _fields(raw: bytes):
    """(number, value) of the fields of a protobuf message: integers, or bytes of length-delimited ones."""
    at = 0

    def varint(i):
        out = shift = 0
        while True:
            out |= (raw[i] & 0x7F) << shift
            shift += 7
            i += 1
            if raw[i - 1] < 0x80:
                return out, i

    while at < len(raw):
        tag, at = varint(at)
        kind = tag & 7
        if kind == 0:
            v, at = varint(at)
        elif kind == 2:
            n, at = varint(at)
            v, at = raw[at : at + n], at + n
        elif kind == 1:
            v, at = struct.unpack_from("<q", raw, at)[0], at + 8
        else:
            v, at = struct.unpack_from("<i", raw, at)[0], at + 4
        yield tag >> 3, v


def decode_deltas(payloads: DataFrame, deltas: int, columns: dict[str, int]) -> DataFrame:
    """Rows of a repeated message inside protobuf payloads (instance_id, run_id, arrival_seq, payload).

    deltas: number of the repeated field; columns: DELTAS' columns to field numbers. Unset fields are 0. The numbers are
    parameters, so that no generated code is needed.
    """
    wanted = {n: c for c, n in columns.items()}

    def run(batches):
        for pdf in batches:
            out = []
            for i, r, s, raw in zip(pdf.instance_id, pdf.run_id, pdf.arrival_seq, pdf.payload, strict=True):
                for number, value in _fields(raw):
                    if number == deltas:
                        row = dict.fromkeys(columns, 0) | {wanted[k]: v - (1 << 64) if v >= 1 << 63 else v for k, v in _fields(value) if k in wanted}
                        out.append((i, r, s, *(row.get(c, 0) for c in ("class_id", "probe_index", "kind", "first_seen_at", "hits_total"))))
            yield pd.DataFrame(out, columns=["instance_id", "run_id", "arrival_seq", "class_id", "probe_index", "kind", "first_seen_at", "hits_total"])

    return payloads.mapInPandas(run, f"instance_id string, run_id string, arrival_seq long, {DELTAS}")
