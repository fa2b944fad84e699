"""The pipeline's stages, one after the other, and its absence."""

import subprocess
import sys
from pathlib import Path

import corpus_pipeline
from landsight.llm import registry

from .conftest import SF, prose

ROOT = Path(corpus_pipeline.__file__).parent


def test_stages(spark):
    docs = spark.read.parquet(f"{SF}/documents.parquet")
    counts = [docs.count()]
    for name, stage in corpus_pipeline.STAGES[:-1]:
        out = stage(spark, docs, SF)
        assert out.columns == docs.columns and out.schema == docs.schema, name
        docs = corpus_pipeline.written(out, "test-stage")
        counts.append(docs.count())
    assert counts[0] >= counts[1] > counts[2] >= counts[3] == counts[4] > 0
    packed = corpus_pipeline.STAGES[-1][1](spark, docs, SF)
    assert packed.select("doc_id").distinct().count() == counts[4]


def test_stages_take_odd_documents(spark, odd_docs):
    docs = odd_docs
    for name, stage in corpus_pipeline.STAGES[:-1]:
        docs = stage(spark, docs, SF)
        assert docs.columns == odd_docs.columns, name
        docs = corpus_pipeline.written(docs, "test-stage")
    empty = odd_docs.where("false")
    for name, stage in corpus_pipeline.STAGES:
        assert stage(spark, empty, SF).count() == 0, name


def test_language_stage_without_labels(spark):
    rows = [(1, prose(1, 40), None), (2, " 12 -- ", None), (3, None, "en"), (4, "word", None), (None, prose(2, 40), None)]
    docs = spark.createDataFrame(rows, "doc_id long, text string, lang string")
    kept = corpus_pipeline.language_stage(spark, docs, SF)
    assert sorted(r.text for r in kept.collect()) == sorted([rows[0][1], "word", rows[4][1]])


def test_language_stage_rejects_long_texts_of_no_known_language(spark):
    """Probability alone is near 1 for any long text."""
    other = " ".join(chr(0x4E00 + (k * k * 7919 + k * 31) % 20000) * (1 + k % 3) for k in range(600))
    rows = [(i, prose(i, 200), "en") for i in range(20)]
    rows += [(20 + i, " ".join(w[::-1] for w in prose(i, 200).split()), "xx") for i in range(20)]
    docs = spark.createDataFrame([*rows, (99, other, None)], "doc_id long, text string, lang string")
    kept = corpus_pipeline.language_stage(spark, docs, SF)
    assert sorted(r.doc_id for r in kept.collect()) == list(range(40))


def test_rows_without_an_id_or_with_a_repeated_one(spark):
    """Every stage's rows against plain Python: a row is an id and its text."""
    a, b, c, d, e, f = (prose(60 + k, 60) for k in range(6))
    near = d.split()
    near[3] = "another"
    near = " ".join(near)
    rows = [
        (1, a), (1, b), (2, c), (2, c), (3, d), (None, near), (None, e), (None, e), (4, e + " "), (None, a), (None, f),
        (1 << 60 | 1, "one short text"), (7, c[:150] + " " + prose(90, 40)), (8, None), (8, ""),
    ]
    docs = spark.createDataFrame([(*r, "en") for r in rows], "doc_id long, text string, lang string")

    def of(df):
        return sorted(((r.doc_id, r.text) for r in df.collect()), key=str)

    def through(stage):
        out = corpus_pipeline.written(stage(spark, docs, SF), "test-stage")
        assert out.schema == docs.schema
        return out

    docs = through(corpus_pipeline.language_stage)
    want = [r for r in rows if r[1]]
    assert of(docs) == sorted(want, key=str)
    docs = through(corpus_pipeline.exact_stage)
    want = list(dict.fromkeys(r for r in want if r != (None, a)))
    assert of(docs) == sorted(want, key=str)
    docs = through(corpus_pipeline.near_stage)
    want = [r for r in want if r not in ((None, near), (None, e))]
    assert of(docs) == sorted(want, key=str)
    docs = through(corpus_pipeline.passage_stage)
    want = [(i, t[150:] if i == 7 else t) for i, t in want]
    assert of(docs) == sorted(want, key=str)
    packed = corpus_pipeline.packing_stage(spark, docs, SF).collect()
    assert sorted((r.doc_id for r in packed), key=str) == sorted((i for i, _ in want), key=str)


def test_entry_without_the_subpackage():
    code = """
import sys
class Gone:
    def find_spec(self, name, path=None, target=None):
        if name in ("corpus_pipeline", "landsight.llm"):
            raise ModuleNotFoundError(f"No module named {name!r}", name=name)
sys.meta_path.insert(0, Gone())
import __spark_entry__ as e
assert not [q for q in e.queries() if q.startswith("op") or q == "pipeline"] and e.oracle_sql()
"""
    subprocess.run([sys.executable, "-c", code], cwd=ROOT, check=True, capture_output=True)


def test_every_operator_is_registered():
    numbers = sorted(int(q[2:].split("_")[0]) for q in registry.QUERIES)
    assert numbers == list(range(1, 14)) and set(registry.ORACLE) <= set(registry.QUERIES)


def test_workers_need_no_package(tmp_path):
    """The operators that broadcast a tokenizer, in a process whose workers cannot
    import the package: it comes from a folder only the driver's path holds."""
    import subprocess
    import sys
    from pathlib import Path

    repo = Path(__file__).resolve().parents[2]
    script = tmp_path / "run.py"
    script.write_text(
        "import sys\n"
        f"sys.path.append({str(repo)!r})\n"
        "from landsight.session import get_session\n"
        "from landsight.llm.registry import QUERIES\n"
        "spark = get_session('local[2]', shuffle_partitions=2)\n"
        "def there(_):\n"
        "    import importlib.util\n"
        "    return [importlib.util.find_spec('landsight') is not None]\n"
        "assert not any(spark.sparkContext.parallelize([0], 1).mapPartitions(there).collect())\n"
        f"for name in sorted(QUERIES):\n    print(name, QUERIES[name](spark, {SF!r}).count())\n"
    )
    env = {k: v for k, v in __import__("os").environ.items() if k not in ("PYTHONPATH",)}
    path = [p for p in __import__("os").environ.get("PYTHONPATH", "").split(":") if p and Path(p).resolve() != repo]
    run = subprocess.run([sys.executable, str(script)], cwd=tmp_path, env=env | {"PYTHONPATH": ":".join(path)}, capture_output=True, text=True, timeout=600)
    assert run.returncode == 0, run.stderr[-3000:]
    assert len(run.stdout.split("\n")) == 14
