"""Files by format: one router for reading, writing, describing and rewriting."""

from __future__ import annotations

import csv
import io
import re
import uuid
from collections.abc import Callable, Mapping
from dataclasses import dataclass, field, replace
from typing import Any

from pyarrow import fs as pafs
from pyspark.sql import DataFrame, Observation, SparkSession
from pyspark.sql import functions as F

from veil.errors import MissingFileError, PolicyError, UnsupportedFormatError
from veil.plans.nested import apply_nested
from veil.plans.policy import Policy, validate
from veil.sources import avro_files, sheets
from veil.sources.avro_files import AvroSource

EXTENSIONS = {
    "csv": "csv", "tsv": "tsv", "json": "json", "jsonl": "jsonl", "ndjson": "jsonl", "parquet": "parquet", "parq": "parquet", "pq": "parquet",
    "avro": "avro", "xlsx": "excel", "xls": "excel", "orc": "orc", "xml": "xml", "txt": "text",
}
PARQUET_CODECS = ("none", "uncompressed", "snappy", "gzip", "zstd", "lz4")


@dataclass(frozen=True)
class FormatOptions:
    compression: str | None = None
    compression_level: int | None = None
    encoding: str = "utf-8"
    batch_rows: int = 10_000
    #: One file instead of a folder of files: written in parts, then joined.
    single_file: bool = False
    options: Mapping[str, Any] = field(default_factory=dict)


def file_type(path: str) -> str | None:
    """The format that a path's extension names."""
    name = path.rstrip("/").lower().rpartition("/")[2]
    return EXTENSIONS.get(name.rpartition(".")[2]) if "." in name else None


def exists(path: str) -> bool:
    """Whether a local path or a URI that Arrow knows is there; other stores are left to Spark."""
    try:
        fs, at = pafs.FileSystem.from_uri(path) if "://" in path else (pafs.LocalFileSystem(), path)
    except Exception:
        return True
    return bool(re.search(r"[*?{\[]", at)) or fs.get_file_info(at).type != pafs.FileType.NotFound


Reader = Callable[[SparkSession, str, FormatOptions], DataFrame]
Writer = Callable[[DataFrame, str, FormatOptions, str], None]


def _read_csv(sep: str) -> Reader:
    def read(spark: SparkSession, path: str, o: FormatOptions) -> DataFrame:
        """Large files are split; the option multiLine reads values that hold line breaks, a file in one task then."""
        base = {"header": True, "sep": sep, "encoding": o.encoding, "inferSchema": False, "mode": "PERMISSIVE", "escape": '"', "nullValue": "\u0000", "emptyValue": ""}
        return spark.read.options(**{**base, **o.options}).csv(path).fillna("")

    return read


def _write_csv(sep: str) -> Writer:
    def write(df: DataFrame, path: str, o: FormatOptions, mode: str) -> None:
        base = {"header": True, "sep": sep, "encoding": o.encoding, "escape": '"', "emptyValue": "", "nullValue": ""}
        df.write.mode(mode).options(**{**base, **o.options}).csv(path)

    return write


def _avro(spark: SparkSession) -> None:
    spark.dataSource.register(AvroSource)


def _read_avro(spark: SparkSession, path: str, o: FormatOptions) -> DataFrame:
    _avro(spark)
    return spark.read.format("veil_avro").options(**o.options).load(path)


def _write_avro(df: DataFrame, path: str, o: FormatOptions, mode: str) -> None:
    _avro(df.sparkSession)
    if mode not in ("overwrite", "append") and avro_files.files_of(path):
        raise FileExistsError(path)
    extra = {"compression": o.compression} if o.compression else {}
    extra |= {} if o.compression_level is None else {"compressionLevel": o.compression_level}
    df.write.format("veil_avro").mode("append" if mode == "append" else "overwrite").options(**extra, **o.options).save(path)


def _read_excel(spark: SparkSession, path: str, o: FormatOptions) -> DataFrame:
    """One sheet; options: sheet (name or number), header, skip_rows, columns, rows."""
    return sheets.read_sheet(spark, path, **o.options)


def _write_excel(df: DataFrame, path: str, o: FormatOptions, mode: str) -> None:
    """One sheet; options: sheet_name, max_rows.  Several: ``sheets.write_sheets``."""
    sheets.write_sheets({o.options.get("sheet_name", "Sheet1"): df}, path, int(o.options.get("max_rows", sheets.MOST_ROWS)))


def _write_parquet(df: DataFrame, path: str, o: FormatOptions, mode: str) -> None:
    codec = (o.compression or "snappy").lower()
    if codec not in PARQUET_CODECS:
        raise UnsupportedFormatError(f"parquet compression {codec!r} isn't bundled", f"Codecs: {', '.join(PARQUET_CODECS)}.")
    level = {} if o.compression_level is None else {"gzip": {"zlib.compress.level": o.compression_level}, "zstd": {"parquet.compression.codec.zstd.level": o.compression_level}}.get(codec, {})
    df.write.mode(mode).options(**{"compression": codec, **level, **o.options}).parquet(path)


def _builtin(name: str, **base: Any) -> tuple[Reader, Writer]:
    def read(spark: SparkSession, path: str, o: FormatOptions) -> DataFrame:
        return spark.read.format(name).options(**{**base, **o.options}).load(path)

    def write(df: DataFrame, path: str, o: FormatOptions, mode: str) -> None:
        extra = {"compression": o.compression} if o.compression else {}
        df.write.mode(mode).format(name).options(**{**extra, **{k: v for k, v in base.items() if k == "rowTag"}, **o.options}).save(path)

    return read, write


def _read_json(spark: SparkSession, path: str, o: FormatOptions) -> DataFrame:
    """A JSON document is one value over many lines; a folder holds lines, as Spark writes them."""
    try:
        folder = _store(path)[0].get_file_info(_store(path)[1]).type == pafs.FileType.Directory
    except Exception:  # a store that only Spark knows
        folder = False
    return spark.read.options(**{"multiLine": not folder, **o.options}).json(path)


_formats: dict[str, tuple[Reader, Writer]] = {
    "csv": (_read_csv(","), _write_csv(",")),
    "tsv": (_read_csv("\t"), _write_csv("\t")),
    "json": (_read_json, _builtin("json")[1]),
    "jsonl": _builtin("json"),
    "parquet": (_builtin("parquet")[0], _write_parquet),
    "orc": _builtin("orc"),
    "xml": _builtin("xml", rowTag="row"),
    "text": _builtin("text"),
    "avro": (_read_avro, _write_avro),
    "excel": (_read_excel, _write_excel),
}


def formats() -> list[str]:
    return sorted(_formats)


def register_format(name: str, read: Reader, write: Writer, *, extensions: tuple[str, ...] = (), override: bool = False) -> None:
    if name in _formats and not override:
        raise ValueError(f"format {name!r} is registered already")
    _formats[name] = (read, write)
    EXTENSIONS.update(dict.fromkeys(extensions, name))


def _format(path: str, name: str | None) -> tuple[Reader, Writer]:
    name = {"pq": "parquet", "xlsx": "excel", "xls": "excel"}.get(name or "", name) or file_type(path)
    if name not in _formats:
        raise UnsupportedFormatError(f"no format for {path!r}")
    return _formats[name]


def read(spark: SparkSession, path: str, format: str | None = None, options: FormatOptions | None = None, columns: list[str] | None = None) -> DataFrame:
    if not exists(path):
        raise MissingFileError(f"no such file: {path}")
    df = _format(path, format)[0](spark, path, options or FormatOptions())
    return df.select(*(F.col(f"`{c}`") for c in columns)) if columns else df


def write(df: DataFrame, path: str, format: str | None = None, options: FormatOptions | None = None, mode: str = "overwrite") -> None:
    o = options or FormatOptions()
    if o.single_file:
        _write_single(df, path, {"pq": "parquet", "xlsx": "excel", "xls": "excel"}.get(format or "", format) or file_type(path), o, mode)
    else:
        _format(path, format)[1](df, path, o, mode)


def _store(path: str) -> tuple[pafs.FileSystem, str]:
    return pafs.FileSystem.from_uri(path) if "://" in path else (pafs.LocalFileSystem(), path)


def _remove(fs: pafs.FileSystem, at: str) -> None:
    kind = fs.get_file_info(at).type
    if kind == pafs.FileType.Directory:
        fs.delete_dir(at)
    elif kind == pafs.FileType.File:
        fs.delete_file(at)


#: Formats whose files can be joined end to end.
JOINED = {"csv": ",", "tsv": "\t", "json": None, "jsonl": None, "text": None}


def _write_single(df: DataFrame, path: str, kind: str | None, o: FormatOptions, mode: str) -> None:
    """One file at path, put there when it is whole; formats of lines are written by all tasks and joined in order."""
    fs, at = _store(path)
    if mode not in ("overwrite", "errorifexists", "error"):
        raise UnsupportedFormatError(f"one file can't be written in mode {mode!r}")
    if mode != "overwrite" and fs.get_file_info(at).type != pafs.FileType.NotFound:
        raise FileExistsError(path)
    if kind == "excel":
        return _format(path, kind)[1](df, path, o, mode)
    parts = f"{path}.parts-{uuid.uuid4().hex}"
    inside, whole = _store(parts)[1], f"{at}.whole-{uuid.uuid4().hex}"
    try:
        if kind in ("csv", "tsv"):
            _format(path, kind)[1](df, parts, replace(o, options={**o.options, "header": False}), "overwrite")
        else:
            _format(path, kind)[1](df if kind in JOINED else df.coalesce(1), parts, o, "overwrite")
        files = sorted(f.path for f in fs.get_file_info(pafs.FileSelector(inside)) if f.path.rpartition("/")[2].startswith("part-"))
        if kind not in JOINED and len(files) == 1:
            fs.move(files[0], whole)
        else:
            with fs.open_output_stream(whole) as out:
                if kind in ("csv", "tsv") and str(o.options.get("header", True)).lower() != "false":
                    line = io.StringIO()
                    csv.writer(line, delimiter=o.options.get("sep", JOINED[kind]), lineterminator="\n").writerow(df.columns)
                    out.write(line.getvalue().encode(o.encoding))
                lines, first = kind == "json", True  # which are written as one list
                out.write(b"[" if lines else b"")
                for f in files:
                    with fs.open_input_stream(f) as part:
                        held = b""
                        while some := part.read(1 << 22):
                            held += some
                            whole_lines, end, held = held.rpartition(b"\n") if lines else (held, b"", b"")
                            if whole_lines:
                                out.write((b"" if first or not lines else b",\n") + (whole_lines.replace(b"\n", b",\n") if lines else whole_lines))
                                first = False
                out.write(b"]\n" if lines else b"")
        _remove(fs, at)
        fs.move(whole, at)
    finally:
        _remove(fs, inside)
        _remove(fs, whole)


def changed_counts(before: DataFrame, policy: Policy) -> tuple[DataFrame, Observation]:
    """The rewritten rows, and an observation of rows, of values that changed, and of configured fields times rows."""
    made = policy.columns(before.schema)
    seen = Observation("veil")
    mark = f"veil_{uuid.uuid4().hex}"  # each value is made once, beside the old one
    both = before.withColumns({f"{mark}_{i}": c for i, c in enumerate(made.values())})
    old = {n: F.col(f"`{n}`").cast("string") for n in made}
    changed = sum((F.when(old[n].eqNullSafe(F.col(f"{mark}_{i}").cast("string")), 0).otherwise(1) for i, n in enumerate(made)), F.lit(0))
    counted = both.observe(seen, F.count(F.lit(1)).alias("records_processed"), F.coalesce(F.sum(changed), F.lit(0)).alias("values_changed"))
    new = {n: F.col(f"{mark}_{i}").alias(n) for i, n in enumerate(made)}
    return counted.select(*(new.get(n, F.col(f"`{n}`")) for n in before.columns), *(c for n, c in new.items() if n not in before.columns)), seen


def anonymize_file(spark: SparkSession, source: str, target: str, policy: Policy | Mapping[str, Any], *, format: str | None = None, options: FormatOptions | None = None, mapping: Mapping[str, str] | None = None, nested: bool | None = None, overwrite: bool = True, single_file: bool | None = None) -> dict[str, int]:
    """Reads, rewrites and writes; returns rows processed, fields rewritten and values changed.

    mapping: column of the file to field of the policy.  nested: policy fields are paths (the default for json).
    single_file: a file comes out, not a folder (the default where a file goes in and the target's name has an extension).
    """
    if single_file is None:
        single_file = file_type(target) is not None and _is_file(source)
    options = replace(options or FormatOptions(), single_file=single_file)
    if not isinstance(policy, Policy):
        if faults := validate(policy):
            raise PolicyError("; ".join(faults))
        policy = Policy.of(policy)
    if mapping:
        policy = replace(policy, rules={c: policy.rules[f] for c, f in mapping.items() if f in policy.rules} | {f: r for f, r in policy.rules.items() if f not in mapping.values()})
    df = read(spark, source, format, options)
    kind = format or file_type(source)
    if nested if nested is not None else kind in ("json", "jsonl"):
        seen = Observation("veil")
        out = apply_nested(df, replace(policy, domain="value")).observe(seen, F.count(F.lit(1)).alias("records_processed"))
        write(out, target, format, options, "overwrite" if overwrite else "errorifexists")
        return {"records_processed": seen.get["records_processed"], "fields_anonymized": len(policy.rules), "errors": 0}
    out, seen = changed_counts(df, policy)
    write(out, target, format, options, "overwrite" if overwrite else "errorifexists")
    got = seen.get
    fields = sum(1 for f in policy.rules if f in df.columns)
    return {"records_processed": got["records_processed"], "fields_anonymized": fields * got["records_processed"], "values_changed": got["values_changed"], "errors": 0}


def _is_file(path: str) -> bool:
    try:
        fs, at = _store(path)
        return fs.get_file_info(at).type == pafs.FileType.File
    except Exception:  # a store that only Spark knows
        return False


def anonymize_in_place(spark: SparkSession, path: str, policy: Policy | Mapping[str, Any], *, backup: bool = True, **options: Any) -> dict[str, int]:
    """Rewrites a path (a file stays a file) through one beside it; the old data stay as .bak, .bak.1, ... if backup."""
    fs, at = _store(path)
    new, old = f"{at}.veil-new", next(n for n in (f"{at}.bak{f'.{i}' if i else ''}" for i in range(1 << 20)) if fs.get_file_info(n).type == pafs.FileType.NotFound)
    try:
        stats = anonymize_file(spark, path, f"{path}.veil-new", policy, format=options.pop("format", None) or file_type(path), single_file=_is_file(path), **options)
        fs.move(at, old)
        try:
            fs.move(new, at)
        except Exception:
            fs.move(old, at)
            raise
    finally:
        _remove(fs, new)
    if not backup:
        _remove(fs, old)
    return stats


def preview(df: DataFrame, policy: Policy, rows: int = 5) -> list[dict[str, Any]]:
    """Original and rewritten first rows; exactly what a full run makes of them."""
    head = df.limit(rows)
    return [{"original": a.asDict(True), "anonymized": b.asDict(True)} for a, b in zip(head.collect(), policy.apply(head).collect(), strict=True)]


def parquet_metadata(path: str) -> dict[str, Any]:
    """Schema, rows, row groups and writer of the first file of a Parquet path, and of how many files it consists."""
    import pyarrow.parquet as pq

    fs, at = pafs.FileSystem.from_uri(path) if "://" in path else (pafs.LocalFileSystem(), path)
    info = fs.get_file_info(at)
    files = [at] if info.type == pafs.FileType.File else sorted(f.path for f in fs.get_file_info(pafs.FileSelector(at, recursive=True)) if f.path.endswith(".parquet"))
    if not files:
        raise MissingFileError(f"no parquet files in {path}")
    meta = [pq.ParquetFile(fs.open_input_file(f)).metadata for f in files]
    return {"files": len(files), "num_rows": sum(m.num_rows for m in meta), "num_row_groups": sum(m.num_row_groups for m in meta), "num_columns": meta[0].num_columns, "created_by": meta[0].created_by, "columns": list(meta[0].schema.names)}


def optimize_parquet(spark: SparkSession, source: str, target: str, *, sort_by: list[str] | None = None, files: int | None = None) -> None:
    """Rewrites for reading: rows ranged and sorted by the given columns, so that row groups can be skipped."""
    df = spark.read.parquet(source)
    if sort_by:
        df = (df.repartitionByRange(files, *sort_by) if files else df.repartitionByRange(*sort_by)).sortWithinPartitions(*sort_by)
    elif files:
        df = df.repartition(files)
    _write_parquet(df, target, FormatOptions(options={"parquet.block.size": 134_217_728}), "overwrite")


def sanitize_columns(df: DataFrame) -> DataFrame:
    """Column names of letters, digits and underscores, lower case."""
    clean = lambda n: (lambda s: f"col_{s}" if s[:1].isdigit() else s)(re.sub(r"[^a-zA-Z0-9_]", "_", n)).lower()
    return df.toDF(*map(clean, df.columns))


def split_extension(path: str, insert: str) -> str:
    """x.csv to x.<insert>.csv."""
    head, dot, tail = path.rpartition(".")
    return f"{head}.{insert}.{tail}" if dot else f"{path}.{insert}"
