"""Databases: JDBC through Spark, SQLite through a Python data source, and one policy for many tables.

Reads are split by a column's range where one is named, so that executors fetch
in parallel; writes go in batches.  Rewritten tables are written whole; only
changed rows are written where a key is given to ``changed_rows``.
"""

from __future__ import annotations

import json
import math
import re
import sqlite3
import time
import uuid
from collections.abc import Callable, Iterator, Mapping, Sequence
from contextlib import suppress
from dataclasses import dataclass
from typing import Any
from urllib.parse import parse_qsl, unquote, urlsplit

import pyarrow as pa
from pyarrow import fs as pafs
from pyspark.sql import DataFrame, Observation, SparkSession
from pyspark.sql import functions as F
from pyspark.sql.datasource import DataSource, DataSourceArrowWriter, DataSourceReader, InputPartition, WriterCommitMessage
from pyspark.sql.types import StructType

from veil.errors import MissingFeatureError, UnsupportedFormatError
from veil.plans.policy import Policy

DRIVERS = {"postgresql": "org.postgresql.Driver", "mysql": "com.mysql.cj.jdbc.Driver", "mariadb": "org.mariadb.jdbc.Driver", "derby": "org.apache.derby.iapi.jdbc.AutoloadedDriver"}
SCHEMES = {"postgresql": "postgresql", "postgres": "postgresql", "mysql": "mysql", "mariadb": "mariadb", "mongodb": "mongodb", "mongodb+srv": "mongodb", "sqlite": "sqlite"}


def masked_url(url: str) -> str:
    """The URL with its password hidden."""
    return re.sub(r"(://[^:/@]*):[^@]*@", r"\1:***@", url)


def quoted(name: str, mark: str = '"') -> str:
    """An identifier in quotes, each part of a dotted name on its own."""
    return ".".join(mark + part.replace(mark, mark * 2) + mark for part in name.split("."))


def connection(url: str) -> tuple[str, dict[str, str]]:
    """(Spark format, options) for a database URL."""
    if url.startswith("jdbc:"):
        kind = url.split(":")[1]
        return "jdbc", {"url": url} | ({"driver": DRIVERS[kind]} if kind in DRIVERS else {})
    parts = urlsplit(url)
    kind = SCHEMES.get(parts.scheme)
    if kind is None:
        raise UnsupportedFormatError(f"unknown database scheme {parts.scheme!r}", f"Schemes: {', '.join(sorted(SCHEMES))}.")
    if kind == "sqlite":
        # sqlite:///relative.db and sqlite:////absolute.db
        return "veil_sqlite", {"path": url.split("://", 1)[1].removeprefix("/")}
    if kind == "mongodb":
        return "mongodb", {"connection.uri": url, "database": parts.path.strip("/").partition("?")[0]}
    port = f":{parts.port}" if parts.port else ""
    query = f"?{parts.query}" if parse_qsl(parts.query) else ""
    options = {"url": f"jdbc:{kind}://{parts.hostname or 'localhost'}{port}{parts.path}{query}", "driver": DRIVERS[kind]}
    if parts.username:
        options["user"] = unquote(parts.username)
    if parts.password:
        options["password"] = unquote(parts.password)
    if kind == "postgresql":
        options["reWriteBatchedInserts"] = "true"
    return "jdbc", options


def read_table(spark: SparkSession, url: str, table: str | None = None, *, query: str | None = None, columns: Sequence[str] | None = None, where: str | None = None, split_by: str | None = None, splits: int = 8, fetch_rows: int = 10_000, **options: Any) -> DataFrame:
    """A table or query.  split_by: a numeric column; its range, asked for first, is read in that many parts."""
    form, base = connection(url)
    if form == "mongodb":
        _need(spark, form)
    reader = spark.read.format(form).options(**base, **options)
    if form == "veil_sqlite":
        spark.dataSource.register(SqliteSource)
    if form == "jdbc":
        reader = reader.option("fetchsize", fetch_rows)
        if table and split_by:
            low, high = spark.read.format(form).options(**base, **options).option("query", f"SELECT min({split_by}) AS low, max({split_by}) AS high FROM {table}").load().first()
            if low is not None:
                reader = reader.options(partitionColumn=split_by, lowerBound=low, upperBound=int(high) + 1, numPartitions=splits)
    reader = reader.option("query", query) if query else reader.option("collection" if form == "mongodb" else "dbtable", table)
    df = reader.load()
    df = df.where(where) if where else df
    return df.select(*columns) if columns else df


def write_table(df: DataFrame, url: str, table: str, *, mode: str = "append", batch_rows: int = 1_000, **options: Any) -> None:
    form, base = connection(url)
    if form == "mongodb":
        _need(df.sparkSession, form)
    if form == "veil_sqlite":
        df.sparkSession.dataSource.register(SqliteSource)
        df = df.coalesce(1)  # SQLite has one writer
    else:
        base["batchsize"] = str(batch_rows)
    df.write.format(form).mode(mode).options(**base, **options).option("collection" if form == "mongodb" else "dbtable", table).save()


def _need(spark: SparkSession, form: str) -> None:
    try:
        spark._jvm.java.lang.Class.forName("com.mongodb.spark.sql.connector.MongoTableProvider")
    except Exception as e:
        raise MissingFeatureError("mongodb needs the mongo-spark connector's jar") from e


def changed_rows(before: DataFrame, policy: Policy, key: Sequence[str]) -> DataFrame:
    """Key and rewritten fields of the rows that a policy changes: what an update by the whole key has to write."""
    made = {n: c for n, c in policy.columns(before.schema).items() if n not in key}
    differs = [~F.col(f"`{n}`").cast("string").eqNullSafe(c.cast("string")) for n, c in made.items()]
    changed = differs[0] if differs else F.lit(False)
    for d in differs[1:]:
        changed = changed | d
    return before.where(changed).select(*key, *(c.alias(n) for n, c in made.items()))


def _jdbc(spark: SparkSession, url: str):
    form, o = connection(url)
    if form != "jdbc":
        raise UnsupportedFormatError(f"{masked_url(url)} isn't a JDBC database")
    if "driver" in o:
        spark._jvm.org.apache.spark.sql.execution.datasources.jdbc.DriverRegistry.register(o["driver"])
    manager = spark._jvm.java.sql.DriverManager
    return manager.getConnection(o["url"], o["user"], o.get("password", "")) if "user" in o else manager.getConnection(o["url"])


def execute(spark: SparkSession, url: str, *statements: str) -> list[int]:
    """Runs statements in one transaction on the driver (maintenance, updates from a staged table); rows changed by each."""
    db = _jdbc(spark, url)
    try:
        db.setAutoCommit(False)
        made = db.createStatement()
        out = [made.executeUpdate(s) for s in statements]
        db.commit()
        return out
    except Exception:
        db.rollback()
        raise
    finally:
        db.close()


def tables_of(spark: SparkSession, url: str, schema: str | None = None) -> list[str]:
    if connection(url)[0] == "veil_sqlite":
        return sqlite_tables(connection(url)[1]["path"])
    db = _jdbc(spark, url)
    try:
        kinds = spark._sc._gateway.new_array(spark._jvm.java.lang.String, 1)
        kinds[0] = "TABLE"
        rows, out = db.getMetaData().getTables(None, schema, "%", kinds), []
        while rows.next():
            out.append(rows.getString("TABLE_NAME"))
        return sorted(out)
    finally:
        db.close()


def dialect(url: str) -> str:
    """The database kind of a JDBC or other URL."""
    return url.split(":")[1] if url.startswith("jdbc:") else SCHEMES.get(urlsplit(url).scheme, "")


def update_statements(kind: str, table: str, staged: str, columns: Sequence[str], key: Sequence[str]) -> list[str]:
    """Statements that take columns over from a staged table by the whole key, the update last.

    table and staged stand as they are, as in any SQL text; columns are quoted as the database does.
    """
    q = lambda name: quoted(name.replace(".", "\0"), "`" if kind in ("mysql", "mariadb") else '"').replace("\0", ".")
    index = f"CREATE INDEX {staged.rpartition('.')[2].strip('`').strip(chr(34))}_key ON {staged} ({', '.join(map(q, key))})"
    if kind in ("mysql", "mariadb"):
        return [f"UPDATE {table} t JOIN {staged} s ON {' AND '.join(f't.{q(k)} = s.{q(k)}' for k in key)} SET {', '.join(f't.{q(c)} = s.{q(c)}' for c in columns)}"]
    if kind == "postgresql":
        return [index, f"UPDATE {table} AS t SET {', '.join(f'{q(c)} = s.{q(c)}' for c in columns)} FROM {staged} s WHERE {' AND '.join(f't.{q(k)} = s.{q(k)}' for k in key)}"]
    same = " AND ".join(f"s.{q(k)} = {table}.{q(k)}" for k in key)
    sets = ", ".join(f"{q(c)} = (SELECT s.{q(c)} FROM {staged} s WHERE {same})" for c in columns)
    return [index, f"UPDATE {table} SET {sets} WHERE EXISTS (SELECT 1 FROM {staged} s WHERE {same})"]


def update_by_key(spark: SparkSession, url: str, table: str, changed: DataFrame, key: Sequence[str]) -> int:
    """Writes changed rows (see ``changed_rows``) beside the table, and takes them over by the whole key in one statement.

    The table's name is SQL text, as in ``read_table``: a name that needs quotes comes with them.
    """
    kind = dialect(url)
    schema, dot, _ = table.rpartition(".")
    staged = f"{schema}{dot}{quoted(f'veil_new_{uuid.uuid4().hex[:12]}', '`' if kind in ('mysql', 'mariadb') else chr(34))}"
    try:
        write_table(changed, url, staged, mode="append")
        return execute(spark, url, *update_statements(kind, table, staged, [c for c in changed.columns if c not in key], key))[-1]
    finally:
        with suppress(Exception):  # it may not be there yet
            execute(spark, url, f"DROP TABLE {staged}")


@dataclass(frozen=True)
class Progress:
    """How far a run over a table's key ranges has come; seconds_left is by the pace so far."""

    done: int
    of: int
    rows: int
    seconds: float

    @property
    def rows_per_second(self) -> float:
        return self.rows / self.seconds if self.seconds else 0.0

    @property
    def seconds_left(self) -> float:
        return self.seconds / self.done * (self.of - self.done) if self.done else float("inf")


def process_database(spark: SparkSession, source: str, table: str, target: str, policy: Policy | Mapping[str, Any], checkpoint: str, *, key: str, target_table: str | None = None, batches: int = 32, tries: int = 3, on_batch: Callable[[Progress], None] | None = None) -> Progress:
    """A table through a policy in ranges of a numeric key, with a checkpoint file from which a run that was ended goes on.

    The ranges are kept in the checkpoint, so they are the same in each run.  A range is deleted from the target before it is written, so one that was half done is not there twice.
    Rows with a null key are a range of their own.
    """
    own = policy if isinstance(policy, Policy) else Policy.of(policy)
    to, name = target_table or table, f"`{key}`"
    fs, at = pafs.FileSystem.from_uri(checkpoint) if "://" in checkpoint else (pafs.LocalFileSystem(), checkpoint)
    df = read_table(spark, source, table)
    if fs.get_file_info(at).type == pafs.FileType.NotFound:
        low, high = df.agg(F.min(name), F.max(name)).first()
        low, high = (0, -1) if low is None else (math.floor(low), math.floor(high))
        step = max(1, -(-(high - low + 1) // batches))
        state = {"ranges": [None, *([a, a + step] for a in range(low, high + 1, step))], "done": 0, "rows": 0, "seconds": 0.0}
    else:
        with fs.open_input_stream(at) as f:
            state = json.loads(f.read())
    there = to in (sqlite_tables(connection(target)[1]["path"]) if dialect(target) == "sqlite" else tables_of(spark, target))
    for i in range(state["done"], len(state["ranges"])):
        span = state["ranges"][i]
        rows = df.where(F.col(name).isNull()) if span is None else df.where((F.col(name) >= span[0]) & (F.col(name) < span[1]))
        began = time.monotonic()
        for attempt in range(tries):
            try:
                if there:
                    _delete_range(spark, target, to, key, span)
                seen = Observation()
                write_table(own.apply(rows).observe(seen, F.count(F.lit(1)).alias("n")), target, to)
                break
            except Exception:
                if attempt + 1 == tries:
                    raise
        there = True
        state |= {"done": i + 1, "rows": state["rows"] + seen.get["n"], "seconds": state["seconds"] + time.monotonic() - began}
        with fs.open_output_stream(f"{at}.new") as f:
            f.write(json.dumps(state).encode())
        fs.move(f"{at}.new", at)
        if on_batch:
            on_batch(Progress(state["done"], len(state["ranges"]), state["rows"], state["seconds"]))
    return Progress(state["done"], len(state["ranges"]), state["rows"], state["seconds"])


def _delete_range(spark: SparkSession, url: str, table: str, key: str, span: Sequence[int] | None) -> None:
    if dialect(url) == "sqlite":
        where = f"{quoted(key)} IS NULL" if span is None else f"{quoted(key)} >= {span[0]} AND {quoted(key)} < {span[1]}"
        with sqlite3.connect(connection(url)[1]["path"], timeout=60) as db:
            db.execute(f"DELETE FROM {quoted(table)} WHERE {where}")
        return
    q = quoted(key, "`" if dialect(url) in ("mysql", "mariadb") else '"')
    execute(spark, url, f"DELETE FROM {table} WHERE " + (f"{q} IS NULL" if span is None else f"{q} >= {span[0]} AND {q} < {span[1]}"))


def anonymize_tables(spark: SparkSession, source: str, target: str, policies: Mapping[str, Policy | Mapping[str, Any]], *, mode: str = "overwrite", **options: Any) -> dict[str, list[str]]:
    """Each table read, rewritten and written to the target; returns the rewritten columns by table."""
    out = {}
    for table, policy in policies.items():
        own = policy if isinstance(policy, Policy) else Policy.of(policy, strict=True)
        df = read_table(spark, source, table, **options)
        write_table(own.apply(df), target, table, mode=mode)
        out[table] = [f for f in own.rules if f in df.columns]
    return out


def columns_of(spark: SparkSession, url: str, table: str) -> list[tuple[str, str, bool]]:
    """(name, type, nullable) of a table's columns."""
    return [(f.name, f.dataType.simpleString(), f.nullable) for f in read_table(spark, url, table).schema.fields]


# --- SQLite ---------------------------------------------------------------

_TYPES = {"INT": "long", "CHAR": "string", "CLOB": "string", "TEXT": "string", "BLOB": "binary", "REAL": "double", "FLOA": "double", "DOUB": "double", "NUMERIC": "double", "DEC": "double", "BOOL": "boolean"}


def sqlite_tables(path: str) -> list[str]:
    with sqlite3.connect(path) as db:
        return [r[0] for r in db.execute("SELECT name FROM sqlite_master WHERE type = 'table' AND name NOT LIKE 'sqlite_%' ORDER BY name")]


def sqlite_columns(path: str, table: str) -> list[tuple[str, str, bool, bool]]:
    """(name, declared type, nullable, in the primary key)."""
    with sqlite3.connect(path) as db:
        return [(r[1], r[2], not r[3], bool(r[5])) for r in db.execute(f"PRAGMA table_info({quoted(table)})")]


def _spark_type(declared: str) -> str:
    return next((t for part, t in _TYPES.items() if part in declared.upper()), "string")


class _Rows(InputPartition):
    def __init__(self, low: int, high: int) -> None:
        self.low, self.high = low, high


class _SqliteReader(DataSourceReader):
    def __init__(self, schema: StructType, options: Mapping[str, str]) -> None:
        self.schema, self.options = schema, dict(options)

    def _from(self) -> str:
        return f"({self.options['query']})" if "query" in self.options else quoted(self.options["dbtable"])

    def partitions(self) -> Sequence[InputPartition]:
        if "query" in self.options:
            return [_Rows(-1, -1)]
        with sqlite3.connect(self.options["path"]) as db:
            try:
                low, high = db.execute(f"SELECT min(rowid), max(rowid) FROM {self._from()}").fetchone()
            except sqlite3.OperationalError:  # a table without row numbers, or a view: one part
                return [_Rows(-1, -2)]
            if not (isinstance(low, int) and isinstance(high, int)):
                return [_Rows(-1, -2)]
        step = max(1, -(-(high - low + 1) // int(self.options.get("splits", 8))))
        return [_Rows(a, min(high, a + step - 1)) for a in range(low, high + 1, step)]

    def read(self, partition: InputPartition) -> Iterator[pa.RecordBatch]:
        from pyspark.sql.pandas.types import to_arrow_schema

        names, arrow = [f.name for f in self.schema.fields], to_arrow_schema(self.schema)
        sql = f"SELECT {', '.join(map(quoted, names))} FROM {self._from()}"
        whole = "query" in self.options or (partition.low, partition.high) == (-1, -2)
        span = () if whole else (partition.low, partition.high)
        with sqlite3.connect(self.options["path"]) as db:
            cursor = db.execute(sql + (" WHERE rowid BETWEEN ? AND ?" if span else ""), span)
            while rows := cursor.fetchmany(int(self.options.get("fetchsize", 10_000))):
                columns = [pa.array([None if r[i] is None else bool(r[i]) if pa.types.is_boolean(f.type) else str(r[i]) if pa.types.is_string(f.type) else r[i] for r in rows], f.type) for i, f in enumerate(arrow)]
                yield pa.RecordBatch.from_arrays(columns, schema=arrow)


class _Done(WriterCommitMessage):
    pass


class _SqliteWriter(DataSourceArrowWriter):
    """Rows go to a table beside the target within one transaction; commit puts it in place."""

    def __init__(self, schema: StructType, options: Mapping[str, str], overwrite: bool) -> None:
        self.schema, self.options, self.overwrite = schema, dict(options), overwrite
        self.table, self.path = options["dbtable"], options["path"]
        kinds = {"long": "INTEGER", "bigint": "INTEGER", "int": "INTEGER", "smallint": "INTEGER", "boolean": "BOOLEAN", "double": "REAL", "float": "REAL", "binary": "BLOB"}
        self.fields = ", ".join(f"{quoted(f.name)} {kinds.get(f.dataType.simpleString(), 'TEXT')}" for f in schema.fields)
        self.staged = f"{self.table}_veil_new"
        with sqlite3.connect(self.path, timeout=60) as db:
            db.execute(f"DROP TABLE IF EXISTS {quoted(self.staged)}")
            db.execute(f"CREATE TABLE {quoted(self.staged)} ({self.fields})")

    def write(self, iterator: Iterator[pa.RecordBatch]) -> WriterCommitMessage:
        plain = (int, float, str, bytes, type(None))
        with sqlite3.connect(self.path, timeout=60) as db:
            db.execute(f"DELETE FROM {quoted(self.staged)}")  # a task that is run again starts anew
            for batch in iterator:
                rows = zip(*(c.to_pylist() for c in batch.columns), strict=True)
                marks = ", ".join("?" * batch.num_columns)
                db.executemany(f"INSERT INTO {quoted(self.staged)} VALUES ({marks})", ([v if isinstance(v, plain) else str(v) for v in row] for row in rows))
        return _Done()

    def commit(self, messages: Any) -> None:
        with sqlite3.connect(self.path, timeout=60) as db:
            if self.overwrite:
                db.execute(f"DROP TABLE IF EXISTS {quoted(self.table)}")
            db.execute(f"CREATE TABLE IF NOT EXISTS {quoted(self.table)} ({self.fields})")
            db.execute(f"INSERT INTO {quoted(self.table)} SELECT * FROM {quoted(self.staged)}")
            db.execute(f"DROP TABLE {quoted(self.staged)}")

    def abort(self, messages: Any) -> None:
        with sqlite3.connect(self.path, timeout=60) as db:
            db.execute(f"DROP TABLE IF EXISTS {quoted(self.staged)}")


class SqliteSource(DataSource):
    """Options: path, and dbtable or query; splits (parts by rowid), fetchsize."""

    @classmethod
    def name(cls) -> str:
        return "veil_sqlite"

    def schema(self) -> str:
        if "query" in self.options:
            with sqlite3.connect(self.options["path"]) as db:
                cursor = db.execute(f"SELECT * FROM ({self.options['query']}) LIMIT 1")
                row = cursor.fetchone() or [""] * len(cursor.description)
                kinds = {int: "long", float: "double", bytes: "binary"}
                return ", ".join(f"`{d[0]}` {kinds.get(type(v), 'string')}" for d, v in zip(cursor.description, row, strict=True))
        return ", ".join(f"`{n}` {_spark_type(t)}" for n, t, *_ in sqlite_columns(self.options["path"], self.options["dbtable"]))

    def reader(self, schema: StructType) -> DataSourceReader:
        return _SqliteReader(schema, self.options)

    def writer(self, schema: StructType, overwrite: bool) -> DataSourceArrowWriter:
        return _SqliteWriter(schema, self.options, overwrite)
