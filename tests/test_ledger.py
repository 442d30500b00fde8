"""Versions, key files, appends and restarts."""

import datetime as dt
import random

import pytest
from pyspark.sql import functions as F
from test_operators import LAYERS, SPEC

from stratalake import runs
from stratalake.operators import checks, elt
from stratalake.sources import ledger as books
from stratalake.sources import sinks
from stratalake.sources.ddl import parse_ddl

SHOP = parse_ddl("create table p (id bigint primary key, code text unique, w int); create table c (id bigint primary key, p_id bigint references p)")
P, C = SHOP.table("p"), SHOP.table("c")


@pytest.fixture
def files(spark):
    """Several data files a table, however small."""
    spark.conf.set("spark.sql.adaptive.coalescePartitions.enabled", "false")
    yield
    spark.conf.unset("spark.sql.adaptive.coalescePartitions.enabled")


def parents(spark, *ids):
    return spark.createDataFrame([(i, f"c{i}", 1) for i in ids], "id long, code string, w int")


def children(spark, *pairs):
    return spark.createDataFrame(list(pairs), "id long, p_id long")


def opened(spark, tmp_path):
    return books.Ledger(spark, f"file://{tmp_path}/w")


def state(book):
    return {t: sorted(r[0] for r in book.read(t).collect()) for t in book.current().tables}


class Killed(BaseException):
    pass


def test_a_writer_that_dies_leaves_the_old_version_or_the_new_one(spark, tmp_path, monkeypatch):
    steps, limit = [0], [None]

    def guarded(make):
        def run(*args, **more):
            steps[0] += 1
            if limit[0] is not None and steps[0] > limit[0]:
                raise Killed
            return make(*args, **more)

        return run

    monkeypatch.setattr(books.Folder, "put", guarded(books.Folder.put))
    monkeypatch.setattr(books.Folder, "delete", guarded(books.Folder.delete))
    monkeypatch.setattr(books, "write_key_files", guarded(books.write_key_files))
    root = f"file://{tmp_path}/w"
    sinks.save(spark, {"p": parents(spark, 1, 2), "c": children(spark, (1, 1))}, SHOP, root)
    old = state(opened(spark, tmp_path))
    new = {"p": [3, 4], "c": [2]}
    seen, last = [], False
    for at in range(100):
        steps[0], limit[0] = 0, at
        try:
            sinks.save(spark, {"p": parents(spark, 3, 4), "c": children(spark, (2, 3))}, SHOP, root, sinks.RECREATE)
            last = True
        except Killed:
            pass
        limit[0] = None
        now = state(opened(spark, tmp_path))
        assert now in (old, new)
        seen.append(now == new)
        if last or now == new:
            break
    assert len(seen) > 8 and seen == sorted(seen) and seen[-1]
    assert opened(spark, tmp_path).clean() and state(opened(spark, tmp_path)) == new


def test_of_two_writers_one_is_refused_and_readers_keep_their_version(spark, tmp_path):
    root = f"file://{tmp_path}/w"
    sinks.save(spark, {"p": parents(spark, 1)}, SHOP, root)
    reader = sinks.load(spark, parse_ddl("create table p (id bigint primary key, code text unique, w int)"), root)["p"]
    stages = [sinks.Stage(spark, {"p": parents(spark, n)}, SHOP, root, sinks.APPEND) for n in (2, 3)]
    stages[1].swap()
    with pytest.raises(books.Conflict):
        stages[0].swap()
    book = opened(spark, tmp_path)
    assert state(book) == {"p": [1, 3]} and [r["id"] for r in reader.collect()] == [1]
    assert [r["id"] for r in book.read("p", book.version(1)).collect()] == [1]
    assert len(list((tmp_path / "w" / "_data").iterdir())) == 2  # what was refused is gone


@pytest.mark.parametrize("kind", ["long", "string", "date", "timestamp", "pair"])
def test_key_files_miss_no_file_and_skip_most(spark, tmp_path, files, kind):
    r = random.Random(kind)
    numbers = r.sample(range(100_000), 3000)
    day = dt.date(2000, 1, 1)
    make = {
        "long": lambda i: (i,), "string": lambda i: (f"k{i:06d}",), "date": lambda i: (day + dt.timedelta(days=i),), "pair": lambda i: (f"g{i % 40:02d}", i),
        "timestamp": lambda i: (dt.datetime(2000, 1, 1) + dt.timedelta(seconds=7 * i),),
    }[kind]
    types = {"long": ["bigint"], "string": ["text"], "date": ["date"], "timestamp": ["timestamp"], "pair": ["text", "bigint"]}[kind]
    names = tuple("ab"[: len(types)])
    table = parse_ddl(f"create table t ({', '.join(f'{n} {x}' for n, x in zip(names, types, strict=True))}, v int, primary key ({', '.join(names)}))").tables[0]
    rows = lambda ids: spark.createDataFrame([(*make(i), 1) for i in ids], table.struct)
    book = opened(spark, tmp_path)
    for part in (numbers[:1500], numbers[1500:]):
        change = book.begin()
        change.write(rows(part).repartition(4), table)
        change.commit()
    for asked in (numbers[:3], [numbers[2000], 200_001], numbers[::50], [200_000 + i for i in range(20)]):
        keys = books.Keys(book, book.current().tables["t"], names)
        found = keys.lookup(rows(asked).select(*names), "v")
        assert rows(asked).join(found, list(names)).count() == len(set(asked) & set(numbers))
        assert keys.files == 8 and keys.opened <= min(8, len(set(asked) & set(numbers)) + 1)


def test_keys_with_nulls_are_found(spark, tmp_path):
    root = f"file://{tmp_path}/w"
    rows = lambda *codes: spark.createDataFrame([(100 * len(codes) + k, c, 1) for k, c in enumerate(codes)], "id long, code string, w int")
    sinks.save(spark, {"p": rows("a", None, "b")}, SHOP, root)
    stage = sinks.Stage(spark, {"p": rows("c", None)}, SHOP, root, sinks.APPEND)
    got = {r["check_id"]: (r["violations"], r["sample"]) for r in checks.validate(SHOP, stage.tables(), saved=stage.saved).filter("table_name = 'p'").collect()}
    assert got["unique"] == (1, "null") and got["primary_key"][0] == 0


def test_appended_rows_are_checked_against_saved_ones(spark, tmp_path):
    root = f"file://{tmp_path}/w"
    sinks.save(spark, {"p": parents(spark, *range(100)), "c": children(spark, (1, 5))}, SHOP, root)
    fresh = {"p": parents(spark, 99, 100, 101, 101), "c": children(spark, (2, 3), (3, 101), (4, 500), (5, 500), (1, None))}
    stage = sinks.Stage(spark, fresh, SHOP, root, sinks.APPEND)
    got = {(r["check_id"], r["table_name"]): (r["violations"], r["sample"]) for r in checks.validate(SHOP, stage.tables(), saved=stage.saved).filter("violations > 0").collect()}
    assert got == {("primary_key", "p"): (2, "101"), ("unique", "p"): (2, "c101"), ("primary_key", "c"): (1, "1"), ("foreign_key", "c"): (2, "500")}
    assert all(a <= b for *_, a, b in stage.saved.looked) and {x[0] for x in stage.saved.looked} == {"p", "c"}
    stage.drop()


def test_numbers_go_on_and_known_keys_keep_theirs(spark, tmp_path, files):
    dim = parse_ddl("create table d (d_key bigint primary key, code text unique, v text)")
    root, book = f"file://{tmp_path}/w", opened(spark, tmp_path)
    codes = lambda *ids: spark.createDataFrame([(f"c{i:03d}", str(i)) for i in ids], "code string, v string")
    sinks.save(spark, {"d": elt.fit_to_table(codes(*range(0, 60)), dim.tables[0])}, dim, root)
    for part in (range(40, 90), range(80, 100), range(0, 100)):
        saved = books.Saved(book, book.current())
        sinks.save(spark, {"d": elt.fit_to_table(codes(*part), dim.tables[0], saved=saved)}, dim, root, sinks.APPEND)
    got = {r["code"]: r["d_key"] for r in book.read("d").collect()}
    assert book.read("d").count() == 100 and got == {f"c{i:03d}": i + 1 for i in range(100)} and book.current().tables["d"].marks == {"d_key": 100}
    sinks.save(spark, {"d": spark.createDataFrame([(7, "z", "z")], "d_key long, code string, v string")}, dim, root, sinks.RECREATE)
    assert book.current().tables["d"].marks == {"d_key": 7}


def test_an_appended_run_has_unique_keys_and_whole_look_ups(spark, tmp_path):
    root = f"file://{tmp_path}/w"
    first = runs.run_elt(spark, LAYERS, SPEC, root=root)
    raw = {
        "load_customer_raw": [{"load_id": 10 + k, "source_payload": f'{{"customer_id": "C{k}", "customer_name": "n{k}"}}'} for k in (1, 5)],
        "load_order_raw": [{"load_id": 10 + k, "source_payload": f'{{"order_id": "P{k}", "customer_id": "C{k % 2 + 1}", "amount": "{k}.25"}}'} for k in range(3)],
    }
    keys = {r["customer_id"]: r["customer_key"] for r in first.data["dim_customer"].collect()}
    again = runs.run_elt(spark, LAYERS, SPEC | {"load_table_rows": raw}, root=root, mode=sinks.APPEND)
    found = {(r["check_id"], r["table_name"], r["columns"]): r["violations"] for r in again.checks.filter("violations > 0 and severity = 'error'").collect()}
    # Customers of the new orders are looked up among the saved ones; C1's staging row repeats a key and that is said.
    assert set(found) == {("primary_key", "stg_customer", "customer_id")}
    assert first.status != "failed" and len(keys) == 2
    clean = {**raw, "load_customer_raw": [raw["load_customer_raw"][1]]}
    done = runs.run_elt(spark, LAYERS, SPEC | {"load_table_rows": clean}, root=root, mode=sinks.APPEND)
    assert done.status != "failed", done.checks.filter("violations > 0").collect()
    customers, orders = (sinks.load(spark, done.model, root)[t].collect() for t in ("dim_customer", "fact_order"))
    assert sorted(r["customer_key"] for r in customers) == [1, 2, 3] and sorted(r["order_key"] for r in orders) == list(range(1, 8))
    new = {r["customer_id"]: r["customer_key"] for r in customers}
    assert {i: new[i] for i in keys} == keys
    assert {r["order_id"]: r["customer_key"] for r in orders if r["order_id"].startswith("P")} == {f"P{k}": keys[f"C{k % 2 + 1}"] for k in range(3)}


def test_a_run_goes_on_after_the_tables_that_were_whole(spark, tmp_path, monkeypatch):
    root, made, deaths = f"file://{tmp_path}/w", [], [1]
    write = books.Change.write

    def dying(self, rows, spec, *args, **more):
        if spec.name.startswith("fact") and deaths:
            deaths.pop()
            raise Killed
        made.append(spec.name)
        return write(self, rows, spec, *args, **more)

    monkeypatch.setattr(books.Change, "write", dying)
    with pytest.raises(Killed):
        runs.run_elt(spark, LAYERS, SPEC, root=root)
    before = set((tmp_path / "w").rglob("*.parquet"))
    assert len(made) == 5 and before and opened(spark, tmp_path).current().number == 0
    made.clear()
    done = runs.run_elt(spark, LAYERS, SPEC, root=root)
    assert done.status != "failed" and made == ["fact_order"]
    assert before <= set((tmp_path / "w").rglob("*.parquet")) and sinks.load(spark, done.model, root)["fact_order"].count() == 4
    assert not list((tmp_path / "w" / "_changes").glob("*.json"))


def test_layers_read_what_was_written(spark):
    """Values that change at each look are the same in a table and in what is made from it."""
    text = "create table load_x_raw (load_id bigint primary key, source_payload jsonb); create table stg_x (x_id bigint primary key, v double precision); create table fact_x (x_key bigint primary key, x_id bigint, v double precision)"
    spec = {
        "load_table_rows": {"load_x_raw": [{"load_id": k, "source_payload": "{}"} for k in range(20)]}, "staging_sql": ["INSERT INTO stg_x SELECT load_id, rand() FROM load_x_raw"], "dimension_sql": [],
        "fact_sql": ["INSERT INTO fact_x (x_id, v) SELECT x_id, v FROM stg_x"], "assumptions": [],
    }
    got = runs.run_elt(spark, text, spec).data
    assert sorted(map(tuple, got["stg_x"].select("x_id", "v").collect())) == sorted(map(tuple, got["fact_x"].select("x_id", "v").collect()))


def test_row_numbers_of_many_files_follow_the_number_of_the_file(spark, files):
    spark.conf.set("spark.sql.shuffle.partitions", "12")
    try:
        got = elt.number_rows(spark.range(500).select(F.col("id").alias("k")), "n", "k", after=1000).orderBy("k").collect()
    finally:
        spark.conf.set("spark.sql.shuffle.partitions", "4")
    assert [r["n"] for r in got] == list(range(1001, 1501))


def test_scans_of_an_index_open_few_files(spark, tmp_path):
    m = parse_ddl("create table t (id bigint primary key, at timestamp, kind text); create index on t (at); create index on t (kind)")
    table, book = m.table("t"), books.Ledger(spark, f"file://{tmp_path}/w", file_rows=50)
    rows = spark.createDataFrame([(k, dt.datetime(2024, 1, 1) + dt.timedelta(minutes=(k * 7919) % 1000), None if k % 9 == 0 else f"k{k % 5}") for k in range(1000)], table.struct)
    for part in (rows.filter("id % 2 = 0"), rows.filter("id % 2 = 1")):
        change = book.begin()
        change.write(part, table)
        change.commit()
    low, high = dt.datetime(2024, 1, 1, 3), dt.datetime(2024, 1, 1, 4)
    got, opened, files = book.scan("t", "at", low, high)
    assert sorted(got.collect()) == sorted(rows.filter(F.col("at").between(low, high)).collect()) and files >= 20 and opened <= 6
    assert book.scan("t", "kind", "k1", "k2")[0].count() == rows.filter("kind in ('k1', 'k2')").count()
    none, opened, _ = book.scan("t", "at", dt.datetime(2025, 1, 1), dt.datetime(2025, 1, 2))
    assert none.count() == 0 and opened == 0 and book.scan("t", "id", 5, 6)[1:] == (-1, -1)


def test_repeated_runs_write_what_changed(spark, tmp_path):
    root = f"file://{tmp_path}/w"
    seen = lambda: {t: x.folders for t, x in opened(spark, tmp_path).current().tables.items()}
    runs.run_elt(spark, LAYERS, SPEC, root=root)
    first, number = seen(), opened(spark, tmp_path).current().number
    runs.run_elt(spark, LAYERS, SPEC, root=root, mode=sinks.RECREATE)
    assert seen() == first and opened(spark, tmp_path).current().number == number
    other = SPEC | {"dimension_sql": [SPEC["dimension_sql"][0].replace("SELECT customer_id, customer_name", "SELECT customer_id, upper(customer_name)")]}
    runs.run_elt(spark, LAYERS, other, root=root, mode=sinks.RECREATE)
    assert {t for t, f in seen().items() if f != first[t]} == {"dim_customer", "fact_order"}
