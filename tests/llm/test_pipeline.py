import os
import re
import subprocess
import sys
from pathlib import Path

import public_tokenizers
import pytest

import corpus_pipeline
from tradewind.llm import bpe, mixing

from .test_classifiers import toxic_rows

TOP = Path(__file__).resolve().parents[2]


@pytest.fixture(scope="module")
def sf(spark, tmp_path_factory):
    """Toxic and clean texts, near copies of some, and personal data in others."""
    folder = str(tmp_path_factory.mktemp("sf"))
    rows = toxic_rows(400, 8)
    docs = [(i, t, ["en", "de"][i % 2], f"s{i % 3}" if i % 5 else "hot", len(t)) for i, t, _ in rows]
    long = " ".join(f"w{k}" for k in range(200))
    docs += [(1000 + k, long + f" tail{k}", "en", "s1", 0) for k in range(4)] + [(2000, "reach a.b@c.de or 10.0.0.1 today", "en", "s1", 0), (2001, None, None, None, None), (2002, "", "en", "s1", 0)]
    spark.createDataFrame(docs, "doc_id long, text string, lang string, source string, n_chars long").write.parquet(f"{folder}/documents.parquet")
    spark.createDataFrame([(i, 1, y) for i, _, y in rows], "doc_id long, quality int, toxic int").write.parquet(f"{folder}/labels.parquet")
    return folder, rows


def test_stages_against_brute_force(spark, sf):
    folder, rows = sf
    toxic = {i for i, _, y in rows if y}
    docs = spark.read.parquet(f"{folder}/documents.parquet")
    columns = docs.columns
    stages = dict(corpus_pipeline.STAGES)
    assert [k for k, _ in corpus_pipeline.STAGES] == ["toxicity", "near_duplicates", "personal_data", "mixing", "token_ids"]

    clean = stages["toxicity"](spark, docs, folder)
    ids = {r.doc_id for r in clean.collect()}
    assert clean.columns == columns and {1000, 2000, 2001, 2002} <= ids
    assert len(ids & toxic) <= 0.03 * len(toxic) and len({i for i, _, y in rows if not y} - ids) <= 3

    apart = stages["near_duplicates"](spark, clean, folder)
    kept = {r.doc_id for r in apart.collect()}
    assert apart.columns == columns and 1000 in kept and not {1001, 1002, 1003} & kept and {2001, 2002} <= kept
    sets = {r.doc_id: {tuple(w[i : i + 5]) for w in [(r.text or "").lower().split()] for i in range(max(0, len(w) - 4))} for r in clean.collect()}
    for i in ids - kept:
        assert any(j < i and 5 * len(sets[i] & sets[j]) >= 4 * len(sets[i] | sets[j]) for j in ids)

    private = stages["personal_data"](spark, apart, folder)
    texts = {r.doc_id: r.text for r in private.collect()}
    assert private.columns == columns and texts[2000] == "reach [EMAIL] or [IP] today" and texts[2001] is None
    assert not any(re.search(r"@", t or "") for t in texts.values())

    mixed = stages["mixing"](spark, private, folder)
    drawn = {r.doc_id for r in mixed.collect()}
    assert mixed.columns == columns and drawn <= kept
    assert drawn == {r.doc_id for r in mixing.mix(private, budget=corpus_pipeline.BUDGET).collect()}

    out = stages["token_ids"](spark, mixed, folder).collect()
    rank, pattern = public_tokenizers.path("byte_bpe_50k.tiktoken"), public_tokenizers.PATTERN
    assert {r.doc_id: bpe.decode_ids(r.ids, rank, pattern).decode() for r in out} == {r.doc_id: r.text or "" for r in mixed.collect()}

    whole = corpus_pipeline.run(spark, folder).collect()
    assert sorted((r.doc_id, r.n_tokens) for r in whole) == sorted((r.doc_id, r.n_tokens) for r in out)


def test_empty_documents(spark, sf, tmp_path):
    folder, _ = sf
    docs = spark.read.parquet(f"{folder}/documents.parquet").limit(0)
    for _, stage in corpus_pipeline.STAGES:
        docs = stage(spark, docs, folder)
    assert docs.count() == 0


def test_the_rest_works_without_this_subpackage(tmp_path):
    for p in TOP.rglob("*.py"):
        rel = p.relative_to(TOP)
        if "llm" in rel.parts or rel.name == "corpus_pipeline.py" or ".git" in rel.parts:
            continue
        (tmp_path / rel).parent.mkdir(parents=True, exist_ok=True)
        (tmp_path / rel).write_bytes(p.read_bytes())
    code = "import __spark_entry__ as e; q = e.queries(); assert len(q) > 40 and not any(k.startswith('op') or k == 'pipeline' for k in q); e.oracle_sql()"
    subprocess.run([sys.executable, "-c", code], cwd=tmp_path, check=True, env={k: v for k, v in os.environ.items() if k != "PYTHONPATH"})
