import json
import os
import sqlite3

import pytest

from veil import api, cli
from veil.errors import MissingFileError, UnsupportedFormatError, format_error
from veil.operators.audit import audited
from veil.plans.policy import Policy
from veil.sources import avro_schema, databases, files, sheets
from veil.streaming import runs


@pytest.fixture
def people(tmp_path):
    path = tmp_path / "people.csv"
    path.write_text('id,name,email\n1,"Ann, B",ann@x.org\n2,,bob@x.org\n3,Cy\n')
    return str(path)


def test_csv_keeps_blanks_and_strings(spark, people, tmp_path):
    stats = files.anonymize_file(spark, people, str(tmp_path / "out"), {"name": {"strategy": "mask", "preserve_last": 1}, "absent": {"strategy": "hash"}}, format="csv")
    got = sorted(files.read(spark, str(tmp_path / "out"), "csv").collect())
    assert [tuple(r) for r in got] == [("1", "*****B", "ann@x.org"), ("2", "", "bob@x.org"), ("3", "*y", "")]
    assert stats["records_processed"] == 3 and stats["values_changed"] == 2


def test_column_mapping(spark, people, tmp_path):
    files.anonymize_file(spark, people, str(tmp_path / "out"), {"customer": {"strategy": "hash"}}, mapping={"name": "customer"}, format="csv")
    assert {len(r["name"]) for r in files.read(spark, str(tmp_path / "out"), "csv").collect()} == {64, 0}


def test_json_paths_and_in_place(spark, tmp_path):
    path = str(tmp_path / "in.json")
    with open(path, "w") as f:
        json.dump([{"users": [{"name": "Ann", "age": 3, "ok": True}], "note": None}], f)
    files.anonymize_in_place(spark, path, {"users.*.name": {"strategy": "mask"}})
    row = files.read(spark, path, "json").first()
    assert row["users"][0].asDict() == {"name": "***", "age": 3, "ok": True} and os.path.exists(f"{path}.bak")


def test_in_place_twice(spark, people, tmp_path):
    first = open(people).read()
    for _ in range(2):
        files.anonymize_in_place(spark, people, {"name": {"strategy": "mask", "preserve_last": 1}})
    assert os.path.isfile(people) and open(f"{people}.bak").read() == first and os.path.isfile(f"{people}.bak.1")
    assert sorted(tuple(r) for r in files.read(spark, people).collect()) == [("1", "*****B", "ann@x.org"), ("2", "", "bob@x.org"), ("3", "*y", "")]
    with pytest.raises(Exception):
        files.anonymize_in_place(spark, people, {"name": {"strategy": "no such strategy"}})
    assert sorted(os.listdir(tmp_path)) == ["people.csv", "people.csv.bak", "people.csv.bak.1"]


@pytest.mark.parametrize("name", ["o.csv", "o.tsv", "o.jsonl", "o.parquet", "o.json"])
def test_one_file_out(spark, tmp_path, name):
    df = spark.range(40).selectExpr("cast(id as string) as `a, b`", "concat('x\"', id) as c").repartition(4)
    files.write(df, str(tmp_path / name), options=files.FormatOptions(single_file=True))
    assert os.path.isfile(tmp_path / name) and os.listdir(tmp_path) == [name]
    got = files.read(spark, str(tmp_path / name))
    assert got.columns == df.columns and sorted(map(tuple, got.collect())) == sorted(map(tuple, df.collect()))
    with pytest.raises(FileExistsError):
        files.write(df, str(tmp_path / name), options=files.FormatOptions(single_file=True), mode="errorifexists")


def test_csv_line_breaks(spark, tmp_path):
    (tmp_path / "x.csv").write_text('a,b\n1,"two\nlines"\n')
    assert files.read(spark, str(tmp_path / "x.csv"), options=files.FormatOptions(options={"multiLine": True})).first()["b"] == "two\nlines"


def test_formats(spark, tmp_path):
    assert files.file_type("a/b.PARQ") == "parquet" and files.file_type("x") is None and files.file_type("a.jsonl") == "jsonl"
    df = spark.range(3)
    with pytest.raises(UnsupportedFormatError):
        files.write(df, str(tmp_path / "x.parquet"), options=files.FormatOptions(compression="brotli"))
    with pytest.raises(MissingFileError):
        files.read(spark, str(tmp_path / "none.csv"))
    with pytest.raises(UnsupportedFormatError):
        files.read(spark, str(tmp_path))
    files.write(df, str(tmp_path / "x.parquet"), options=files.FormatOptions(compression="zstd"))
    assert files.parquet_metadata(str(tmp_path / "x.parquet"))["num_rows"] == 3
    assert files.sanitize_columns(df.withColumnRenamed("id", "1 A-b")).columns == ["col_1_a_b"]
    files.register_format("mine", lambda s, p, o: s.range(1), lambda d, p, o, m: None, extensions=("mine",))
    assert files.read(spark, str(tmp_path), "mine").count() == 1


def test_avro_files(spark, tmp_path):
    df = spark.range(5000).selectExpr(
        "id", "if(id % 3 = 0, null, concat('n', id)) as name", "cast(id as int) as i", "id / 7 as d", "cast(id as float) as f", "id % 2 = 0 as ok", "cast(concat('b', id) as binary) as raw",
        "array('x', null, cast(id as string)) as list", "map('k', id) as m", "struct(id as a, struct(cast(null as string) as c) as b) as s", "date_add(date'1969-12-30', cast(id as int)) as day", "timestamp_micros(id * 1000003 - 5) as ts", "cast(id - 2500 as decimal(12, 2)) as money",
    )
    for codec in ("deflate", "null"):
        path = str(tmp_path / f"{codec}.avro")
        files.write(df.repartition(3), path, options=files.FormatOptions(compression=codec, compression_level=1))
        got = files.read(spark, path, options=files.FormatOptions(options={"splitBytes": 9000}))
        assert got.rdd.getNumPartitions() > 6 and got.schema.simpleString() == df.schema.simpleString()
        assert sorted(map(str, got.collect())) == sorted(map(str, df.collect()))
    files.write(df.limit(1), path, mode="append")
    assert files.read(spark, path).count() == 5001
    files.write(df.limit(2), path)
    assert files.read(spark, path).count() == 2
    files.write(df.limit(0), str(tmp_path / "none.avro"))
    assert files.read(spark, str(tmp_path / "none.avro")).count() == 0
    files.anonymize_file(spark, path, str(tmp_path / "o.avro"), {"name": {"strategy": "hash"}})
    assert files.read(spark, str(tmp_path / "o.avro")).count() == 2
    with pytest.raises(Exception):
        files.write(df, path, options=files.FormatOptions(compression="snappy"))


def test_sheets(spark, tmp_path):
    path = str(tmp_path / "b.xlsx")
    df = spark.createDataFrame([(1, "a <&> 'é'", 1.5, True), (2, None, None, None), (3, " x\ny ", float("nan"), False)], "id int, `a name` string, d double, ok boolean")
    sheets.write_sheets({"one": df, "two & three": df.select("id")}, path)
    assert sheets.sheet_names(path) == ["one", "two & three"]
    got = files.read(spark, path)
    assert got.columns == df.columns and [tuple(r) for r in got.collect()] == [("1", "a <&> 'é'", "1.5", "true"), ("2", None, None, None), ("3", " x\ny ", "nan", "false")]
    assert [r[0] for r in sheets.read_sheet(spark, path, "two & three").collect()] == ["1", "2", "3"] and set(sheets.read_sheets(spark, path)) == {"one", "two & three"}
    assert sheets.read_sheet(spark, path, columns="A,C:D").columns == ["id", "d", "ok"] and sheets.read_sheet(spark, path, columns=["ok"], rows=1).count() == 1
    assert sheets.read_sheet(spark, path, header=False, skip_rows=1).columns == ["_1", "_2", "_3", "_4"]
    files.anonymize_file(spark, path, str(tmp_path / "o.xlsx"), {"a name": {"strategy": "mask"}})
    assert files.read(spark, str(tmp_path / "o.xlsx")).first()["a name"].startswith("*")
    for bad in (lambda: sheets.write_sheets({"one": df}, path, 2), lambda: sheets.write_sheets({"a/b": df}, path), lambda: sheets.read_sheet(spark, path, "four")):
        with pytest.raises(UnsupportedFormatError):
            bad()
    (tmp_path / "old.xls").write_bytes(b"not a zip file")
    with pytest.raises(UnsupportedFormatError):
        files.read(spark, str(tmp_path / "old.xls"))


def test_avro_schemas():
    record = {"a": 1, "b": {"c": [1.5]}, "d": None, "e": True}
    schema = avro_schema.infer(record)
    kind = avro_schema.to_spark(schema)
    assert kind.simpleString() == "struct<a:bigint,b:struct<c:array<double>>,d:string,e:boolean>"
    assert avro_schema.to_spark(avro_schema.to_avro(kind)) == kind and not avro_schema.faults(schema)
    assert len(avro_schema.faults({"type": "record", "fields": [{"name": "x"}, {"name": "y", "type": "odd"}]})) == 3
    assert avro_schema.coerce({"a": "7", "e": None}, {"type": "record", "name": "r", "fields": [{"name": "a", "type": ["null", "long"]}, {"name": "e", "type": ["null", "long"]}]}) == {"a": 7, "e": None}


def test_connections():
    assert databases.connection("sqlite:///x.db") == ("veil_sqlite", {"path": "x.db"}) and databases.connection("sqlite:////a/x.db")[1]["path"] == "/a/x.db"
    form, o = databases.connection("postgres://u:p%40w@h:5/db")
    assert form == "jdbc" and o["url"] == "jdbc:postgresql://h:5/db" and o["password"] == "p@w"
    assert databases.connection("mariadb://h/db")[1]["driver"].startswith("org.mariadb")
    assert databases.masked_url("mysql://u:secret@h/db") == "mysql://u:***@h/db"
    with pytest.raises(UnsupportedFormatError):
        databases.connection("ftp://x")


def test_sqlite(spark, tmp_path):
    path = str(tmp_path / "x.db")
    with sqlite3.connect(path) as db:
        db.execute('CREATE TABLE "users" (id INTEGER PRIMARY KEY, name TEXT, score REAL)')
        db.executemany("INSERT INTO users VALUES (?, ?, ?)", [(i, f"n{i}", None if i % 3 == 0 else i / 2) for i in range(50)])
    url = f"sqlite:///{path}"
    out = databases.anonymize_tables(spark, url, url, {"users": {"name": {"strategy": "hash"}}})
    assert out == {"users": ["name"]} and databases.sqlite_tables(path) == ["users"]
    rows = databases.read_table(spark, url, "users").orderBy("id").collect()
    assert len(rows) == 50 and len(rows[7]["name"]) == 64 and rows[3]["score"] is None and rows[7]["score"] == 3.5
    assert databases.read_table(spark, url, query="SELECT count(*) AS n FROM users").first()["n"] == 50
    databases.write_table(spark.createDataFrame([(99, "z", 1.0)], "id long, name string, score double"), url, "users")
    assert databases.read_table(spark, url, "users", columns=["id"], where="id > 90").count() == 1


def test_jdbc(spark, tmp_path):
    url = f"jdbc:derby:{tmp_path}/derby;create=true"
    df = spark.createDataFrame([(i, f"n{i}") for i in range(20)], "ID int, NAME string")
    databases.write_table(df, url, "PEOPLE", mode="overwrite")
    got = databases.read_table(spark, url, "PEOPLE", split_by="ID", splits=3)
    assert got.rdd.getNumPartitions() == 3 and got.count() == 20
    assert databases.columns_of(spark, url, "PEOPLE")[0][:2] == ("ID", "int")
    changed = databases.changed_rows(got, Policy.of({"NAME": {"strategy": "mask", "preserve_last": 9}}), ["ID"])
    assert databases.update_by_key(spark, url, "PEOPLE", changed.where("ID < 10"), ["ID"]) == 10
    rows = {r["ID"]: r["NAME"] for r in databases.read_table(spark, url, "PEOPLE").collect()}
    assert rows[3] == "**" and rows[13] == "n13" and databases.tables_of(spark, url) == ["PEOPLE"]
    assert databases.execute(spark, url, "DELETE FROM PEOPLE WHERE ID > 15") == [4]


def test_update_statements():
    for kind, want in (
        ("postgresql", ['CREATE INDEX new_key ON s."new" ("id")', 'UPDATE s.people AS t SET "Name" = s."Name" FROM s."new" s WHERE t."id" = s."id"']),
        ("mysql", ["UPDATE s.people t JOIN s.`new` s ON t.`id` = s.`id` SET t.`Name` = s.`Name`"]),
    ):
        staged = "s.`new`" if kind == "mysql" else 's."new"'
        assert databases.update_statements(kind, "s.people", staged, ["Name"], ["id"]) == want


@pytest.mark.parametrize(("table", "key", "name"), [("people", "ID", "NAME"), ('"Mixed"', "Id", "a name")])
def test_update_with_any_names(spark, tmp_path, table, key, name):
    url = f"jdbc:derby:{tmp_path}/derby;create=true"
    df = spark.createDataFrame([(i, f"n{i}") for i in range(20)], f"`{key}` int, `{name}` string")
    databases.write_table(df, url, table, mode="overwrite")
    changed = databases.changed_rows(databases.read_table(spark, url, table), Policy.of({name: {"strategy": "mask"}}), [key])
    assert databases.update_by_key(spark, url, table, changed, [key]) == 20
    assert {r[name] for r in databases.read_table(spark, url, table).collect()} == {"**", "***"}
    with pytest.raises(Exception):
        databases.update_by_key(spark, url, table, changed.withColumnRenamed(name, "absent"), [key])
    assert len(databases.tables_of(spark, url)) == 1


def test_process_database(spark, tmp_path):
    source, target, mark = f"sqlite:///{tmp_path}/a.db", f"sqlite:///{tmp_path}/b.db", str(tmp_path / "mark.json")
    with sqlite3.connect(tmp_path / "a.db") as db:
        db.execute("CREATE TABLE users (id INTEGER, name TEXT)")
        db.executemany("INSERT INTO users VALUES (?, ?)", [*((i, f"n{i}") for i in range(30)), (None, "null")])
    policy, seen = Policy.of({"name": {"strategy": "hash"}}), []

    def end(p):
        seen.append(p)
        if len(seen) == 3:
            raise KeyboardInterrupt

    with pytest.raises(KeyboardInterrupt):
        databases.process_database(spark, source, "users", target, policy, mark, key="id", batches=5, on_batch=end)
    with sqlite3.connect(tmp_path / "b.db") as db:  # half of the next range, as if the run had ended there
        db.execute("INSERT INTO users VALUES (13, 'left over')")
    done = databases.process_database(spark, source, "users", target, policy, mark, key="id", batches=5)
    assert (done.done, done.of, done.rows) == (6, 6, 31) and seen[1].seconds_left > 0
    rows = databases.read_table(spark, target, "users").collect()
    assert len(rows) == 31 and {len(r["name"]) for r in rows} == {64}


def test_sqlite_without_row_numbers(spark, tmp_path):
    with sqlite3.connect(tmp_path / "x.db") as db:
        db.execute("CREATE TABLE t (k TEXT PRIMARY KEY, v TEXT) WITHOUT ROWID")
        db.execute("INSERT INTO t VALUES ('a', 'b')")
        db.execute("CREATE VIEW w AS SELECT * FROM t")
    for name in ("t", "w"):
        assert [tuple(r) for r in databases.read_table(spark, f"sqlite:///{tmp_path}/x.db", name).collect()] == [("a", "b")]


def test_stream_resumes(spark, tmp_path):
    source, target, mark = (str(tmp_path / n) for n in ("in", "out", "mark"))
    policy = Policy.of({"name": {"strategy": "hash"}})
    spark.createDataFrame([("a",), ("b",)], "name string").write.parquet(source)
    assert runs.process_large_file(spark, source, target, policy, mark)["rows_processed"] == 2
    spark.createDataFrame([("c",)], "name string").write.mode("append").parquet(source)
    runs.process_large_file(spark, source, target, policy, mark)
    assert spark.read.parquet(target).distinct().count() == 3 and spark.read.parquet(target).count() == 3


def test_stream_batches(spark, tmp_path):
    spark.createDataFrame([("a",)], "name string").write.parquet(str(tmp_path / "in"))
    seen = []
    made = runs.stream(spark, str(tmp_path / "in"), "name string")
    runs.finish(runs.anonymize_stream(made, Policy.of({"name": {"strategy": "mask"}}), str(tmp_path / "out"), str(tmp_path / "mark"), on_batch=lambda n, rows: seen.append((n, rows))))
    assert seen == [(0, 1)] and spark.read.parquet(str(tmp_path / "out")).first()["name"] == "*"


def test_stream_quarantine_and_totals(spark, tmp_path):
    for i in range(3):
        spark.createDataFrame([(f"a{i}", i)], "name string, i int").write.mode("append").parquet(str(tmp_path / "in"))
    policy = Policy.of({"name": {"strategy": "hash"}})
    bad = Policy.of({"name": {"strategy": "hash"}})
    object.__setattr__(bad, "apply", lambda df: df.select("no_such_column"))
    options = runs.StreamOptions(files_per_batch=1, tries=2, continue_on_error=True)
    source = lambda: runs.stream(spark, str(tmp_path / "in"), "name string, i int", options=options)
    got = runs.finish(runs.anonymize_stream(source(), bad, str(tmp_path / "o"), str(tmp_path / "m"), options=options, quarantine=str(tmp_path / "q")))
    kept = spark.read.json(str(tmp_path / "q"))
    assert got["rows_processed"] == 3 and got["batches_processed"] == 3 and sorted(r["name"] for r in kept.collect()) == ["a0", "a1", "a2"]
    query = runs.anonymize_stream(source(), policy, str(tmp_path / "o2"), str(tmp_path / "m2"), options=options)
    runs.finish(query)
    assert runs.progress(query, spark).rows == 3 and runs.progress(query, spark).seconds_left(6) > 0


def test_facade(spark, people, tmp_path):
    assert api.detect_pii(people, spark) == {"name": "name", "email": "email"}
    dry = api.anonymize(people, dry_run=True, spark=spark, columns=["email"])
    assert dry["fields"]["email"] == "email" and list(dry["policy"]) == ["email"] and len(dry["preview"]) == 3
    done = api.anonymize(people, strategy="hash", spark=spark, pii_types=["email"])
    assert done["output"].endswith("people.anonymized.csv") and done["fields"] == ["email"]
    df = spark.createDataFrame([("a@x.org",)], "mail string")
    assert api.anonymize(df, strategy="mask").first()["mail"] == "***.org"
    first = api.preview(df, 1)[0]
    assert first["original"] == {"mail": "a@x.org"} and first["anonymized"] == api.anonymize(df).first().asDict()


def test_command_line(spark, people, tmp_path, capsys):
    assert cli.main(["detect", people], spark) == 0 and json.loads(capsys.readouterr().out)["email"] == "email"
    assert cli.main([people, "-s", "mask", "-o", str(tmp_path / "o.csv")], spark) == 0
    assert cli.main(["preview", people, "-n", "1"], spark) == 0
    assert cli.main(["config", people, "-o", str(tmp_path / "c.json")], spark) == 0
    assert cli.main(["anonymize", people, "--config", str(tmp_path / "c.json"), "-o", str(tmp_path / "p.csv")], spark) == 0
    assert cli.main(["detect", str(tmp_path / "none.csv")], spark) == 1 and "Hint" in capsys.readouterr().err
    answers = iter(["email", "mask", str(tmp_path / "w.csv"), "y"])
    assert cli.wizard(spark, people, ask=lambda _: next(answers), say=lambda _: None) == 0


def test_errors():
    assert "Hint" in format_error(FileNotFoundError("x")) and format_error(KeyError("x")).startswith("Error: KeyError")


def test_audit(spark, tmp_path):
    df = spark.createDataFrame([("a", ""), ("b", "x")], "n string, m string")
    entry = audited(df, Policy.of({"m": {"strategy": "hash"}}), lambda d: d.write.parquet(str(tmp_path / "o")), "t", str(tmp_path / "log"))
    assert (entry["records_processed"], entry["values_changed"]) == (2, 1) and spark.read.parquet(str(tmp_path / "log")).count() == 1
