"""The pipeline against a brute-force composition of its stages, and the guard around this subpackage."""

import random
import subprocess
import sys
from pathlib import Path

import pytest

P = pytest.importorskip("public_tokenizers")
ROOT = Path(__file__).resolve().parents[2]
VOCABULARY = [f"word{k}" for k in range(300)]


def test_pipeline_keeps_what_brute_force_keeps(spark, tmp_path):
    import corpus_pipeline

    r = random.Random(11)
    text = lambda n: " ".join(r.choice(VOCABULARY) for _ in range(n)).capitalize() + "."
    items = [text(30) for _ in range(3)]
    docs = {k: text(80) for k in range(150)}
    junk = {1000 + k: " ".join(r.choice(VOCABULARY).upper() + "!!" for _ in range(80)) for k in range(60)}
    copies = {2000 + k: docs[k].replace(" ", "  ") for k in range(10)}
    near = {3000 + k: " ".join([*docs[20 + k].split()[:-1], "tail"]) for k in range(10)}
    leaks = {4000 + k: f"{text(20)} {items[k]} {text(20)}" for k in range(3)}
    rows = {**docs, **junk, **copies, **near, **leaks}
    spark.createDataFrame([(i, t, "en", "s", len(t)) for i, t in rows.items()], "doc_id long, text string, lang string, source string, n_chars long").write.parquet(f"{tmp_path}/documents.parquet")
    spark.createDataFrame([(i, int(i < 1000), 0) for i in (*docs, *junk)], "doc_id long, quality int, toxic int").write.parquet(f"{tmp_path}/labels.parquet")
    spark.createDataFrame(list(enumerate(items)), "item_id long, text string").write.parquet(f"{tmp_path}/benchmark.parquet")
    got = corpus_pipeline.run(spark, str(tmp_path)).collect()
    assert sorted(x["doc_id"] for x in got) == sorted(docs)
    import base64

    import tiktoken

    ranks = {base64.b64decode(a): int(b) for a, b in map(bytes.split, open(P.path("byte_bpe_multi_50k.tiktoken"), "rb"))}
    other = tiktoken.Encoding("own", pat_str=P.PATTERN, mergeable_ranks=ranks, special_tokens={})
    assert all(x["ids"] == other.encode_ordinary(docs[x["doc_id"]]) for x in got)
    columns = spark.read.parquet(f"{tmp_path}/documents.parquet").columns
    for _, stage in corpus_pipeline.STAGES[:-1]:
        assert stage(spark, spark.read.parquet(f"{tmp_path}/documents.parquet"), str(tmp_path)).columns == columns


ODD = "doc_id long, text string, _id string, label_of_row string, matches string, gone string, component_id string, score string, digest string"


def test_stages_with_odd_rows(spark, tmp_path):
    """Nulls, empty and very long texts, ties, repeated rows, clashing names and empty tables through every stage."""
    import corpus_pipeline

    r = random.Random(12)
    text = lambda n: " ".join(r.choice(VOCABULARY) for _ in range(n))
    item, plain, long = text(30), text(80), text(30_000)
    rows = [(1, None), (2, ""), (3, " "), (4, plain), (4, plain), (5, plain), (None, plain), (None, None), (6, long), (7, item), (8, f"{long} {item}"), (9, plain + " tail")]
    d = spark.createDataFrame([(*x, *"abcdefg") for x in rows], ODD)
    d.write.parquet(f"{tmp_path}/documents.parquet")
    spark.createDataFrame([(4, None, 0), (None, 1, 0), (5, 1, 0), (5, 1, 0)], "doc_id long, quality int, toxic int").write.parquet(f"{tmp_path}/labels.parquet")
    spark.createDataFrame([(1, item), (2, None), (None, "")], "item_id long, text string").write.parquet(f"{tmp_path}/benchmark.parquet")
    d = spark.read.parquet(f"{tmp_path}/documents.parquet")
    key = lambda x: (x is None, x)
    left = lambda name: sorted((x["doc_id"] for x in dict(corpus_pipeline.STAGES)[name](spark, d, str(tmp_path)).collect()), key=key)
    every = sorted((i for i, _ in rows), key=key)
    assert left("quality_classifier") == every  # one label: nothing speaks against any row
    assert left("exact_duplicates") == [1, 3, 4, 6, 7, 8, 9]
    assert left("near_duplicates") == [1, 2, 3, 4, 4, 6, 7, None, None]
    assert left("benchmark_decontamination") == [1, 2, 3, 4, 4, 5, 6, 9, None, None]
    assert left("byte_level_bpe") == every
    for name, stage in corpus_pipeline.STAGES[:-1]:
        assert stage(spark, d, str(tmp_path)).columns == d.columns, name
        nothing = stage(spark, spark.read.schema(ODD).parquet(f"{tmp_path}/documents.parquet").limit(0), str(tmp_path))
        assert nothing.columns == d.columns and nothing.count() == 0, name


def test_entry_lives_without_this_subpackage(tmp_path):
    import shutil

    for name in ("stratalake", "__spark_entry__.py"):
        src = ROOT / name
        if src.is_dir():
            shutil.copytree(src, tmp_path / name, ignore=shutil.ignore_patterns("llm", "__pycache__"))
        else:
            shutil.copy(src, tmp_path / name)
    said = subprocess.run([sys.executable, "-c", "import __spark_entry__ as e; print(len(e.queries()) > 60, set(e.queries()) == set(e.oracle_sql()))"], cwd=tmp_path, capture_output=True, text=True, env={"PATH": "/usr/bin:/bin", "HOME": "/tmp"})
    assert said.stdout.split() == ["True", "True"], said.stderr
