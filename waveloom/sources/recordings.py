"""Recordings as DataFrames: what names and files tell about them, catalogues, and metadata by precedence.

Samples are read by the `captures` source of `byteranges`.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

from waveloom.sources import byteranges


def _scaled(value: Column, unit: Column) -> Column:
    by = F.lower(unit)
    return F.when(value != "", value.cast("double") * F.when(by == "k", 1e3).when(by == "m", 1e6).when(by == "g", 1e9).otherwise(1.0))


def name_hints(name: Column) -> Column:
    """sample_rate, center_freq, start_time and notes as a file name tells them; NULL where it doesn't.

    Three receivers' forms tell centre and start, tokens such as 2Msps and fc100MHz rate and centre;
    of any other name a date with time is the start.
    """
    get = lambda pattern, k: F.regexp_extract(name, pattern, k)
    stamp = r"(\d{4})(\d{2})(\d{2})[_T](\d{2})(\d{2})(\d{2})Z?"
    sharp, hdsdr, uno = rf"(?i)SDRSharp_{stamp}_(\d+)Hz_IQ", rf"(?i)HDSDR_{stamp}_(\d+(?:\.\d+)?)kHz_RF", rf"(?i)SDRuno_{stamp}_(\d+(?:\.\d+)?)([kMG]?)Hz"
    rate, centre = r"(?i)(?<![0-9.])(\d+(?:\.\d+)?)([kMG]?)sps", r"(?i)fc[_-]?(\d+(?:\.\d+)?)([kMG]?)(?:hz)?"
    khz, hz = r"(?i)(?:^|_)(\d+)kHz(?:_|\.|$)", r"(?i)(?:^|_)(\d+)Hz(?:_|\.|$)"
    start = F.when(get(stamp, 1) != "", F.concat(get(stamp, 1), F.lit("-"), get(stamp, 2), F.lit("-"), get(stamp, 3), F.lit("T"), get(stamp, 4), F.lit(":"), get(stamp, 5), F.lit(":"), get(stamp, 6), F.lit("Z")))
    found = F.coalesce(_scaled(get(sharp, 7), F.lit("")), _scaled(get(hdsdr, 7), F.lit("k")), _scaled(get(uno, 7), get(uno, 8)), _scaled(get(hz, 1), F.lit("")), _scaled(get(khz, 1), F.lit("k")), _scaled(get(centre, 1), get(centre, 2)))
    form = F.when(get(sharp, 7) != "", "SDRSharp").when(get(hdsdr, 7) != "", "HDSDR").when(get(uno, 7) != "", "SDRuno").when(found.isNotNull(), "name")
    speed = _scaled(get(rate, 1), get(rate, 2))
    notes = F.array_compact(F.array(F.when(form.isNotNull(), F.concat(form, F.lit(": centre "), F.format_string("%.0f", found), F.lit(" Hz"))), F.when(speed.isNotNull(), F.concat(F.lit("name: sample rate "), F.format_string("%.0f", speed), F.lit(" Hz")))))
    return F.struct(speed.alias("sample_rate"), found.alias("center_freq"), start.alias("start_time"), notes.alias("notes"))


def metadata_confidence(rate_source: Column, centre_source: Column) -> Column:
    """Half from where the rate comes from, half from where the centre does."""
    r = F.when(rate_source.isin("user", "sigmf", "wav"), 1.0).when(rate_source == "filename", 0.6).otherwise(0.15)
    c = F.when(centre_source.isin("user", "sigmf"), 1.0).when(centre_source == "auxi", 0.9).when(centre_source == "filename", 0.6).otherwise(0.3)
    return F.round(0.5 * r + 0.5 * c, 2)


def files(spark: SparkSession, path: str, pattern: str = "*") -> DataFrame:
    """Files of a folder: (path, length, modificationTime, content)."""
    return spark.read.format("binaryFile").option("pathGlobFilter", pattern).option("recursiveFileLookup", "true").load(path)


def folder(spark: SparkSession, path: str) -> DataFrame:
    """(path, length) of the files at or below a path, empty ones included, which `files` leaves out; listed where the read is planned, as Spark lists folders."""
    return spark.createDataFrame(list(byteranges.listed(path).items()), "path string, length long")


def catalogue(listing: DataFrame) -> DataFrame:
    """Captures of a listing (path): without hidden files and reports, and without sidecars whose data file is there."""
    own = listing.withColumn("name", F.element_at(F.split("path", "/"), -1)).where("name not like '.%'")
    own = own.where(~F.lower("name").rlike(r"\.(json|csv|html|png|md|txt|py|npz|npy|parquet)$"))
    data = own.where("name like '%.sigmf-data'").select(F.regexp_replace("path", "-data$", "-meta").alias("_meta"))
    return own.join(data, own["path"] == data["_meta"], "left_anti")


def identity(listing: DataFrame) -> DataFrame:
    """(path, sha256, bytes) of files (path, content)."""
    return listing.select("path", F.sha2("content", 256).alias("sha256"), F.length("content").cast("long").alias("bytes"))


def sidecars(meta: DataFrame) -> DataFrame:
    """Rate, centre, start and type of metadata files (path, content) in the paired JSON form."""
    schema = "global struct<`core:datatype`:string,`core:sample_rate`:double>, captures array<struct<`core:frequency`:double,`core:datetime`:string>>"
    own = meta.select(F.regexp_replace("path", r"\.sigmf-meta$", "").alias("stem"), F.from_json(F.col("content").cast("string"), schema).alias("m"))
    first = F.try_element_at("m.captures", F.lit(1))
    return own.select("stem", F.col("m.global.`core:datatype`").alias("datatype"), F.col("m.global.`core:sample_rate`").alias("sample_rate"), first["core:frequency"].alias("center_freq"), first["core:datetime"].alias("start_time"))


LAYOUT = "path string, data_path string, source_format string, kind string, kind_confidence double, kind_scores map<string,double>, file_rate double, file_center double, file_start string, n_samples long, data_offset long, file_notes array<string>, error string"


def paired(listing: DataFrame) -> DataFrame:
    """(path, length, meta) of the captures of a listing (path, length, ...): meta is the sidecar, or of a sidecar without data itself."""
    name = F.element_at(F.split("path", "/"), -1)
    own = listing.select("path", "length").where(~name.rlike(r"^[._]") & ~F.lower("path").rlike(r"\.(json|csv|html|png|md|txt|py|npz|npy|parquet|crc)$"))
    metas = own.where("path like '%.sigmf-meta'").select(F.col("path").alias("meta"))
    data = own.where("path not like '%.sigmf-meta'")
    names = F.array(F.regexp_replace("path", r"\.[^./]*$", ".sigmf-meta"), F.concat("path", F.lit(".sigmf-meta")))
    near = data.select("path", F.posexplode(names).alias("rank", "meta")).join(metas, "meta").groupBy("path").agg(F.min_by("meta", "rank").alias("meta"))
    alone = metas.join(near.select("meta"), "meta", "left_anti").select(F.col("meta").alias("path"), F.lit(0).cast("long").alias("length"), "meta")
    return data.join(near, "path", "left").select("path", "length", "meta").union(alone)


def layouts(listing: DataFrame, kind: str | None = None) -> DataFrame:
    """LAYOUT of each capture of a listing (path, length, ...), with an error where a file can't be read.

    Sidecars are joined by name; then tasks open the files for some ranges of bytes, never for their samples.
    """
    import pandas as pd

    def read(frames):
        columns = [c.split(" ")[0] for c in LAYOUT.split(", ")]
        for pdf in frames:
            out = []
            for path, length, meta in zip(pdf["path"], pdf["length"], pdf["meta"], strict=True):
                try:
                    sizes = {path: int(length)} | ({meta: 1} if isinstance(meta, str) else {})
                    at = byteranges.layout(path, sizes, kind)
                    out.append((path, at.path, at.source_format, at.kind, at.confidence, {k: round(v, 3) for k, v in at.scores.items()}, at.sample_rate, at.center_freq, at.start_time, at.count, at.offset, list(at.notes), None))
                except (byteranges.CaptureError, OSError) as e:
                    out.append((path, *[None] * 11, str(e)))
            yield pd.DataFrame(out, columns=columns).astype({c: "Int64" for c in ("n_samples", "data_offset")})

    return paired(listing).mapInPandas(read, LAYOUT)


def described(listing: DataFrame, sample_rate: float | None = None, center_freq: float | None = None, kind: str | None = None) -> DataFrame:
    """Metadata of each capture of a listing (path, length, ...): what the caller gives, else the file or its sidecar, else its name.

    Without any rate it is 1 and frequencies are shares of it (`normalised`). metadata_confidence is
    that of where rate and centre come from. A file that can't be read has a row with its error.
    """
    own = layouts(listing, kind).withColumn("name", F.element_at(F.split("path", "/"), -1)).withColumn("h", name_hints(F.col("name")))
    rate = [("user", F.lit(sample_rate).cast("double")), (None, F.when(F.col("file_rate") > 0, F.col("file_rate"))), ("filename", F.col("h.sample_rate"))]
    centre = [("user", F.lit(center_freq).cast("double")), (None, F.col("file_center")), ("filename", F.col("h.center_freq"))]
    told = {"rate": F.when(F.col("source_format") == "sigmf", "sigmf").otherwise("wav"), "centre": F.when(F.col("source_format") == "sigmf", "sigmf").otherwise("auxi")}
    first = lambda ranked: F.coalesce(*[v for _, v in ranked])
    source = lambda ranked, of: F.coalesce(*[F.when(v.isNotNull(), told[of] if s is None else F.lit(s)) for s, v in ranked])
    own = own.withColumn("rate", first(rate)).withColumn("rate_source", F.coalesce(source(rate, "rate"), F.lit("unknown"))).withColumn("center_freq", first(centre)).withColumn("center_source", source(centre, "centre"))
    missing = F.array_compact(F.array(F.when(F.col("rate").isNull(), F.lit("sample rate unknown; frequencies are shares of it")), F.when(F.col("center_freq").isNull(), F.lit("centre frequency unknown; frequencies are offsets from it"))))
    fine = F.col("error").isNull()
    return own.select(
        "path", "name", "data_path", "source_format", "kind", "kind_confidence", "kind_scores", "n_samples", "data_offset",
        F.when(fine, F.coalesce("rate", F.lit(1.0))).alias("sample_rate"), F.when(fine, F.col("rate_source")).alias("rate_source"), F.when(fine, F.col("center_freq")).alias("center_freq"), F.when(fine, F.col("center_source")).alias("center_source"),
        F.when(fine, F.coalesce("file_start", "h.start_time")).alias("start_time"), F.when(fine, metadata_confidence(F.col("rate_source"), F.coalesce("center_source", F.lit("none")))).alias("metadata_confidence"),
        F.when(fine, F.col("rate").isNull()).alias("normalised"), F.when(fine, F.array_distinct(F.concat("file_notes", missing, "h.notes"))).alias("notes"), "error",
    )
