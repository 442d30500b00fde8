"""Whole runs: business input to an accepted design, schema text to a loaded, checked and reported warehouse.

Run as ``python -m stratalake.runs``; see ``main``.
"""

from __future__ import annotations

import argparse
import json
from dataclasses import dataclass, field
from pathlib import Path

from pyspark.sql import DataFrame, SparkSession

from stratalake.model import WarehouseModel
from stratalake.operators import checks
from stratalake.operators.derive import repair_metrics
from stratalake.operators.elt import from_rows
from stratalake.operators.generate import generate
from stratalake.plans import gate
from stratalake.plans.layers import RAW, STAGING, Plan, plan_layers
from stratalake.plans.profile import Profile, build_profile
from stratalake.plans.semantics import meanings
from stratalake.scratch import scope, written
from stratalake.sources import intake, sinks
from stratalake.sources.ddl import extract_ddl, extract_views, parse_ddl
from stratalake.sources.spec import fingerprint


class Refused(ValueError):
    """The gate has reasons against a specification; nothing was run."""


@dataclass
class Run:
    model: WarehouseModel
    plan: Plan
    profile: Profile | None
    data: dict[str, DataFrame]
    checks: DataFrame
    status: str
    paths: dict[str, str]


def read_views(spark: SparkSession, text: str, model: WarehouseModel, data: dict[str, DataFrame]) -> dict[str, DataFrame]:
    """The views that a markdown or schema text declares, over the tables of a run."""
    return gate.make_views(spark, extract_views(text), model, data)


def read_model(text: str) -> tuple[WarehouseModel, Plan]:
    """Model and plan of a markdown or schema text."""
    model = parse_ddl(extract_ddl(text, indexes=True))
    return model, plan_layers(model)


def _finish(spark: SparkSession, model: WarehouseModel, plan: Plan, profile: Profile | None, data: dict[str, DataFrame], expected: dict[str, int] | None, stage: sinks.Stage | None, mode: str, reports: str | None, assumptions: list | None = None, business: dict | None = None) -> Run:
    """``data`` is written, beside its target or as scratch; that is what is checked, exported and, if it passes, moved."""
    saved = stage.saved if stage else None
    whole = {t: saved.rows(t).unionByName(df) if saved.table(t) else df for t, df in data.items()} if saved else None
    lineage = checks.validate_lineage(model, data, plan, parents=whole, saved=saved)
    parts = [checks.validate(model, data, expected, meanings(model), saved=saved), lineage, checks.validate_realism(model, data, profile, whole)]
    if profile:
        parts += [checks.payload_checks(t, data[t], r.required) for t, r in profile.raw.items() if r.has_payload and t in data]
        parts.append(checks.payload_references(profile, data))
    found = spark.createDataFrame(checks.union(parts, spark).collect(), checks.RESULT)  # one row a check: bounded by the model
    status, paths = checks.status(found).first()["status"], {}
    if reports:
        Path(reports).mkdir(parents=True, exist_ok=True)
        sinks.report("Validation", found, f"{reports}/validation_report.md")
        sinks.generation_report(f"{reports}/generation_report.md", model, plan, profile, data, assumptions, business)
        if status != "failed":
            sinks.write_xlsx(data, model, f"{reports}/tables.xlsx")
    if stage and status != "failed":
        paths = stage.swap()
        data = stage.tables(moved=True)
    elif stage:
        stage.drop()
    if reports:
        counts = {r["table_name"]: r["row_count"] for r in checks.row_counts(data).collect()} if paths or not stage else {}
        sinks.load_report(f"{reports}/load_report.md", mode, counts, paths, None if paths else "no target was named" if not stage else "validation failed")
    return Run(model, plan, profile, data, found, status, paths)


def _written(stage: sinks.Stage | None, keep) -> gate.Settle:
    """Writes tables, with repaired measures, into the stage or as scratch; what an earlier try of the run wrote, or an earlier run from the same, is taken over."""

    def settle(name: str, make, of: str) -> DataFrame:
        if stage is None:
            return keep(written(repair_metrics(make()), name))
        done = stage.done(name, of)
        return stage.write(name, repair_metrics(make()), of) if done is None else done

    return settle


def _source(given: DataFrame | list) -> str:
    """What a raw table is read from: its files with their sizes and times, or its rows; empty where that can't be said."""
    if isinstance(given, list):
        return fingerprint(given)
    spark, found = given.sparkSession, []
    for name in sorted(given.inputFiles()):  # one name a file
        path = spark.sparkContext._jvm.org.apache.hadoop.fs.Path(name)
        status = path.getFileSystem(spark._jsparkSession.sessionState().newHadoopConf()).getFileStatus(path)
        found.append((name, status.getLen(), status.getModificationTime()))
    return fingerprint(found, given.semanticHash()) if found else ""


def run_elt(spark: SparkSession, text: str, spec: dict, rows: int | None = None, root: str | None = None, mode: str = sinks.FAIL, reports: str | None = None, raw: dict[str, DataFrame] | None = None) -> Run:
    """A stored specification through gate, raw rows, statements, repair, checks and save.

    With ``rows`` raw counts must be the profile's, and the other tables are
    compared with the profile too.  ``raw`` gives raw tables as frames, in place of rows
    in the specification.  Each layer is written before the next, which reads it from
    there.  Into a target that is replaced only tables are written whose statements or
    inputs have changed since they were saved.  A run that died and is begun again with the same text, specification, raw
    frames, target and mode goes on after the tables that were whole.  A failed validation saves nothing.
    """
    model, plan = read_model(text)
    profile = build_profile(model, plan, rows) if rows else None
    given = raw or {}
    judged = {**spec, "load_table_rows": {**dict.fromkeys(given, []), **spec["load_table_rows"]}} if given and "load_table_rows" in spec else spec
    if reasons := gate.judge_spec(spark, judged, model, plan, None if given else profile):
        raise Refused("; ".join(reasons))
    with scope() as keep:
        return _run_elt(spark, text, spec, model, plan, profile, given, root, mode, reports, keep)


def _run_elt(spark, text, spec, model, plan, profile, given, root, mode, reports, keep) -> Run:
    stage = sinks.Stage(spark, {}, model, root, mode, name=fingerprint(text, spec, mode, {t: df.semanticHash() for t, df in given.items()})) if root else None
    frames = {model.table(t).name: from_rows(spark, model.table(t), got) for t, got in spec["load_table_rows"].items() if t not in given} | given
    sources = {t: _source(given[t] if t in given else spec["load_table_rows"][next(n for n in spec["load_table_rows"] if model.table(n).name == t)]) for t in frames}
    data = gate.execute(spark, spec, model, plan, frames, _written(stage, keep), stage.saved if stage else None, sources)
    return _finish(spark, model, plan, profile, data, profile.rows if profile else None, stage, mode, reports, spec["assumptions"])


def _staged(spark: SparkSession, data: dict[str, DataFrame], model: WarehouseModel, root: str | None, mode: str, keep) -> tuple[sinks.Stage | None, dict[str, DataFrame]]:
    data = {t: repair_metrics(df) for t, df in data.items()}
    stage = sinks.Stage(spark, data, model, root, mode) if root else None
    return stage, stage.tables() if stage else {t: keep(written(df, t)) for t, df in data.items()}


def run_generation(spark: SparkSession, text: str, rows: int = 100, seed: int = 12345, business: dict | None = None, root: str | None = None, mode: str = sinks.FAIL, reports: str | None = None, reuse: float = 0.0) -> Run:
    """Generated rows for all tables, checked, then saved; ``reuse`` as in ``operators.generate.table_rows``."""
    model, plan = read_model(text)
    profile = build_profile(model, plan, rows) if plan.of(RAW) and plan.of(STAGING) else None
    with scope() as keep:
        stage, data = _staged(spark, generate(spark, model, rows, seed, business, plan, reuse=reuse), model, root, mode, keep)
        return _finish(spark, model, plan, profile, data, profile.rows if profile else dict.fromkeys(data, rows), stage, mode, reports, business=business)


def run_export(spark: SparkSession, text: str, root: str, reports: str) -> Run:
    """Read a saved warehouse back, repair, check and export it; nothing is written to it."""
    model, plan = read_model(text)
    with scope() as keep:
        _, data = _staged(spark, sinks.load(spark, model, root), model, None, sinks.FAIL, keep)
        return _finish(spark, model, plan, None, data, None, None, sinks.FAIL, reports)


@dataclass
class Intake:
    """How far a business input came: rejected, needs_improvement, quality_failed or accepted."""

    status: str
    artefacts: dict[str, object] = field(default_factory=dict)


def run_intake(path: str, review: str | None = None, generation: str | None = None, out: str | None = None) -> Intake:
    """A business input through required fields, scores, intent, blueprint and the quality gate.

    ``review`` and ``generation`` are stored responses as JSON texts; without one
    the run ends before the step that needs it.  What each step found is kept as
    artefacts and, with ``out``, as files; files of an earlier run are removed.
    """
    made: dict[str, object] = {}

    def end(status: str) -> Intake:
        if out:
            _write_artefacts(Path(out), made)
        return Intake(status, made)

    data = intake.read_yaml(path)
    if missing := intake.missing_fields(data):
        made["validation_errors.json"] = {"missing_fields": missing}
        return end("rejected")
    made["input.json"] = intake.redact(data)
    points, unscored = intake.rule_score(data)
    made["rule_based_score.json"] = {"score": points, "without_points": unscored}
    if review is None:
        return end("needs_review")
    said = made["semantic_review.json"] = intake.check_review(intake.read_json(review))
    score, decision = intake.final_score(points, said["ai_review_score"])
    made["final_readiness_score.json"] = {"score": score, "decision": decision}
    if decision != "ready_for_generation":
        made["improvement_suggestions.json"] = {"missing": [*unscored, *said["missing_items"]], "suggestions": said["suggestions"], "assumptions_needed": said["assumptions_needed"]}
        return end(decision)
    wanted = made["model_intent.json"] = intake.intent(data)
    plan = made["model_blueprint.json"] = intake.blueprint(data, wanted)
    if generation is None:
        return end(decision)
    answer = intake.check_generation(intake.read_json(generation))
    quality, errors, warnings = intake.output_quality(answer["final_output_markdown"], wanted, plan)
    made["generation_quality.json"] = {"status": quality, "errors": errors, "warnings": warnings}
    if quality == "failed":
        return end("quality_failed")
    made["final_output.md"] = answer["final_output_markdown"]
    return end("accepted")


#: Files that a run of the intake may leave.
ARTEFACTS = [
    "validation_errors.json", "input.json", "rule_based_score.json", "semantic_review.json", "final_readiness_score.json", "improvement_suggestions.json", "model_intent.json",
    "model_blueprint.json", "generation_quality.json", "final_output.md",
]


def _write_artefacts(out: Path, made: dict[str, object]) -> None:
    out.mkdir(parents=True, exist_ok=True)
    for name in ARTEFACTS:
        (out / name).unlink(missing_ok=True)
    for name, content in made.items():
        (out / name).write_text(content if isinstance(content, str) else json.dumps(content, ensure_ascii=False, indent=2), encoding="utf-8")


def main(args: list[str] | None = None) -> int:
    """``intake``, ``generate``, ``elt`` and ``export`` from a shell; 0 if all went well."""
    p = argparse.ArgumentParser(prog="stratalake.runs")
    kinds = p.add_subparsers(dest="kind", required=True)
    one = kinds.add_parser("intake")
    for name in ("input", "--review", "--generation", "--out"):
        one.add_argument(name)
    for kind in ("generate", "elt", "export"):
        one = kinds.add_parser(kind)
        one.add_argument("schema")
        one.add_argument("--rows", type=int)
        one.add_argument("--seed", type=int, default=12345)
        one.add_argument("--reuse", type=float, default=0.0)
        one.add_argument("--spec")
        one.add_argument("--business")
        one.add_argument("--root")
        one.add_argument("--reports")
        one.add_argument("--mode", default=sinks.FAIL, choices=[sinks.RECREATE, sinks.REUSE, sinks.APPEND, sinks.FAIL])
    a = p.parse_args(args)
    text = lambda x: Path(x).read_text(encoding="utf-8") if x else None
    if a.kind == "intake":
        got = run_intake(a.input, text(a.review), text(a.generation), a.out)
        print(got.status)
        return int(got.status in ("rejected", "quality_failed"))
    spark = SparkSession.builder.getOrCreate()
    if a.kind == "generate":
        done = run_generation(spark, text(a.schema), a.rows or 100, a.seed, intake.read_yaml(a.business) if a.business else None, a.root, a.mode, a.reports, a.reuse)
    elif a.kind == "elt":
        done = run_elt(spark, text(a.schema), intake.read_json(text(a.spec)), a.rows, a.root, a.mode, a.reports)
    else:
        done = run_export(spark, text(a.schema), a.root, a.reports)
    print(done.status)
    return int(done.status == "failed")


if __name__ == "__main__":
    raise SystemExit(main())
