"""Whole runs, specifications and the catalog."""

import pytest
from test_operators import LAYERS, SPEC

from stratalake import runs
from stratalake.sources import catalog, sinks, spec
from stratalake.sources.ddl import parse_ddl
from stratalake.sources.intake import InputError

STAR = """# Physical DDL
```sql
create table dim_date (date_key int primary key, full_date date not null);
create table dim_customer (customer_key int primary key, customer_id text, segment text check (segment in ('A', 'B')));
create table fact_sales (order_date_key int references dim_date, customer_key int references dim_customer, quantity int check (quantity > 0), unit_price numeric(8,2) check (unit_price between 1 and 9), line_total numeric(12,2), unique (order_date_key, customer_key));
```"""


def test_generation_run_saves_reports_and_reads_back(spark, tmp_path):
    got = runs.run_generation(spark, STAR, 5, root=f"file://{tmp_path}/w", reports=str(tmp_path / "r"))
    assert got.status != "failed" and set(got.paths) == {"dim_date", "dim_customer", "fact_sales"} and (tmp_path / "r" / "tables.xlsx").exists()
    made, loaded = ((tmp_path / "r" / f"{x}_report.md").read_text() for x in ("generation", "load"))
    assert "| dimension | dim_date | 5 |" in made and "| fact_sales | order_date_key | dim_date(date_key) |" in made and "Status: saved" in loaded and "| fact_sales | 5 |" in loaded
    back = runs.run_export(spark, STAR, f"file://{tmp_path}/w", str(tmp_path / "e"))
    assert back.data["fact_sales"].count() == 5 and "Status: passed" in (tmp_path / "e" / "validation_report.md").read_text()


def test_elt_run(spark, tmp_path):
    got = runs.run_elt(spark, LAYERS, SPEC, root=f"file://{tmp_path}/w")
    assert got.status in ("passed", "passed_with_warnings") and sinks.load(spark, got.model, f"file://{tmp_path}/w")["fact_order"].count() == 4
    with pytest.raises(runs.Refused, match="reads elsewhere"):
        runs.run_elt(spark, LAYERS, SPEC | {"fact_sql": ["INSERT INTO fact_order SELECT * FROM elsewhere"]})
    bad = {**SPEC, "load_table_rows": {**SPEC["load_table_rows"], "load_order_raw": SPEC["load_table_rows"]["load_order_raw"] * 2}}
    failed = runs.run_elt(spark, LAYERS, bad, root=f"file://{tmp_path}/no")
    assert failed.status == "failed" and not list((tmp_path / "no").rglob("*.parquet")) and not list((tmp_path / "no").glob("_versions/*")) and not failed.paths


def test_what_is_saved_is_what_was_checked(spark, tmp_path):
    """Values that change with each look at a frame (here random ones) are the same in checks, files and the run's frames."""
    from pyspark.sql import functions as F

    model = parse_ddl("create table x (id int primary key, v double precision)")
    stage = sinks.Stage(spark, {"x": spark.range(20).select(F.col("id").cast("int"), F.rand().alias("v"))}, model, f"file://{tmp_path}/w")
    before = sorted(stage.tables()["x"].collect())
    stage.swap()
    assert sorted(stage.tables(moved=True)["x"].collect()) == before == sorted(sinks.load(spark, model, f"file://{tmp_path}/w")["x"].collect())


def test_runs_leave_no_scratch_tables(spark, tmp_path):
    from pathlib import Path

    from stratalake.scratch import shared_dir

    base = Path(shared_dir(spark, "probe").removeprefix("file://")).parent
    there = lambda: {p.name for p in base.iterdir()}
    before = there()
    runs.run_elt(spark, LAYERS, SPEC, root=f"file://{tmp_path}/w")
    assert there() == before
    kept = runs.run_elt(spark, LAYERS, SPEC)
    assert len(there() - before) == len(kept.data) and kept.data["fact_order"].count() == 4


def test_payloads_are_checked_in_runs(spark):
    spec_ = {**SPEC, "load_table_rows": {**SPEC["load_table_rows"], "load_order_raw": [{"source_payload": '{"order_id": "O1", "customer_id": "C9", "amount": "1"}'}] * 2}}
    got = runs.run_elt(spark, LAYERS, {**spec_, "load_table_rows": {k: (v * 9)[: {"load_customer_raw": 1, "load_order_raw": 2}[k]] for k, v in spec_["load_table_rows"].items()}}, rows=2)
    said = {(r["check_id"], r["table_name"]): r["violations"] for r in got.checks.collect()}
    assert said["payload_object", "load_order_raw"] == 0 and got.status == "failed"


INPUT = """
business_name: Ada's
business_type: shop
business_description: sells watches
model_purpose: a dashboard of sales
main_business_processes: [sales]
key_business_entities: [Customer, Order]
business_relationships: [a customer places orders]
entity_attributes: {Order: [order_date, quantity]}
reporting_requirements: [sales by day]
expected_output: DDL
target_database: warehouse
db_password: secret
"""


def test_intake_run(tmp_path):
    import json

    from stratalake.sources import intake

    path, out = tmp_path / "in.yaml", tmp_path / "out"
    path.write_text(INPUT)
    assert runs.run_intake(str(path), out=str(out)).status == "needs_review" and "secret" not in (out / "input.json").read_text()
    review = dict.fromkeys(intake.REVIEW_FIELDS, []) | {"ai_review_score": 90}
    text = "".join(f"CREATE TABLE {p}x (id int);\n" for p in ("dim_", "fact_", "load_", "stg_")) + "# AI Additions / Assumptions\nreporting fact_sales"
    answer = {"status": "ok", "final_output_markdown": text, "ai_additions_and_assumptions": []}
    done = runs.run_intake(str(path), json.dumps(review), json.dumps(answer), str(out))
    assert done.status == "accepted" and (out / "final_output.md").read_text() == text and done.artefacts["model_intent.json"]["model_type"] == "analytical_data_warehouse"
    assert json.loads((out / "final_readiness_score.json").read_text())["score"] == 97.0
    assert runs.run_intake(str(path), json.dumps(review | {"ai_review_score": 10}), out=str(out)).status == "needs_improvement" and not (out / "final_output.md").exists()
    assert runs.run_intake(str(path), json.dumps(review), json.dumps(answer | {"final_output_markdown": "no tables"})).status == "quality_failed"
    path.write_text(INPUT.replace("business_name: Ada's\n", ""))
    assert runs.run_intake(str(path), out=str(out)).artefacts == {"validation_errors.json": {"missing_fields": ["business_name"]}} and not (out / "input.json").exists()
    assert runs.main(["intake", str(path)]) == 1


def test_views_of_a_text(spark):
    text = STAR[:-3] + """
CREATE VIEW vw_segment AS SELECT c.segment, SUM(s.quantity)::numeric / NULLIF(COUNT(*), 0) AS q FROM fact_sales s JOIN dim_customer c ON c.customer_key = s.customer_key GROUP BY c.segment;
CREATE OR REPLACE VIEW vw_best AS SELECT segment FROM vw_segment ORDER BY q DESC LIMIT 1;
```"""
    got = runs.run_generation(spark, text, 5)
    made = runs.read_views(spark, text, got.model, got.data)
    rows = {r["segment"]: float(r["q"]) for r in made["vw_segment"].collect()}
    assert list(made) == ["vw_segment", "vw_best"] and rows and made["vw_best"].first()["segment"] == max(rows, key=rows.get)
    facts = got.data["fact_sales"].join(got.data["dim_customer"], "customer_key").groupBy("segment").avg("quantity").collect()
    assert {r[0]: round(r[1], 6) for r in facts} == {k: round(v, 6) for k, v in rows.items()}
    for bad in ("SELECT * FROM elsewhere", "SELECT reflect('java.lang.System', 'nanoTime')", "SELECT * FROM range(3)", "INSERT INTO fact_sales SELECT * FROM fact_sales", "DROP TABLE fact_sales"):
        with pytest.raises(ValueError, match="view v"):
            runs.read_views(spark, f"CREATE VIEW v AS {bad};", got.model, got.data)


def test_specifications_are_kept_by_fingerprint(tmp_path):
    key, asked = spec.fingerprint({"a": 1, "b": 2}), []
    assert key == spec.fingerprint({"b": 2, "a": 1})
    make = lambda: asked.append(1) or SPEC
    assert [spec.cached(tmp_path, key, make)[1] for _ in range(2)] == [False, True] and len(asked) == 1
    spec.forget(tmp_path, key)
    assert spec.cached(tmp_path, key, make)[1] is False
    (tmp_path / "x.json").write_text('{"staging_sql": []}')
    with pytest.raises(InputError, match="lacks"):
        spec.read_spec(tmp_path / "x.json")


def test_buckets_follow_foreign_keys():
    m = parse_ddl("""create table a (a bigint primary key); create table b (b bigint primary key, a bigint references a); create table c (b bigint references b, a bigint references a, n int, primary key (b, n));
    create table d (a int references a)""")
    assert catalog.bucket_columns(m) == {"c": ("b",), "b": ("b",)}  # d's key is of another type, a has no child left


def test_catalog(spark):
    m = parse_ddl("create table p (id int primary key, said text not null check (said <> 'it''s')); create table c (id int primary key, p_id int references p)")
    data = {"p": spark.createDataFrame([(1, "a")], "id int, said string"), "c": spark.createDataFrame([(1, 1)], "id int, p_id int")}
    name = "stratalake_test"
    try:
        catalog.publish(spark, data, m, name, sinks.RECREATE)
        with pytest.raises(FileExistsError):
            catalog.publish(spark, data, m, name)
        catalog.publish(spark, data, m, name, sinks.APPEND)
        assert catalog.read_back(spark, m, name)["c"].count() == 2
        catalog.publish(spark, data, m, name, sinks.REUSE)
        assert catalog.read_back(spark, m, name)["c"].count() == 1
        with pytest.raises(ValueError):
            catalog.drop(spark, "public")
    finally:
        catalog.drop(spark, name)
    with pytest.raises(FileNotFoundError):
        catalog.read_back(spark, m, name)
