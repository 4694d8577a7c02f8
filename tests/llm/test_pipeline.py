"""The whole pipeline: on a small table against a plain version of its stages, and on hand-made rows."""

import hashlib
import os

import pytest

import corpus_pipeline
from panelforge.llm import common, decontaminate, jaccard_join, line_templates, toxicity

DDL = "doc_id long, text string, lang string, source string, n_chars long, label int, _doc int, _lines int, kept boolean, `a.b` int, `c``d` int"


def plain(spark, sf):
    """The same decisions with loops over collected rows; the classifier, tested by itself, is taken as trained."""
    docs = spark.read.parquet(f"{sf}/documents.parquet")
    model = toxicity.learn(spark, docs, sf)
    score = model.scorer()
    rows = {r.doc_id: r.text for r in docs.collect()}
    rows = {i: t for i, t in rows.items() if score([t])[0] < 0.5}
    lines = line_templates.drop_lines(spark.createDataFrame(list(rows.items()), "doc_id long, text string"))
    rows = {r.doc_id: r.text for r in lines.collect()}
    sets = {i: set(s.tolist()) for i, s in zip(rows, jaccard_join.shingle_sets(list(rows.values())))}
    top = {i: i for i in rows}

    def root(i):
        while top[i] != i:
            i = top[i]
        return i

    ids = sorted(i for i in rows if sets[i])
    for n, i in enumerate(ids):
        for j in ids[n + 1 :]:
            both = len(sets[i] & sets[j])
            if both and both >= 0.8 * (len(sets[i]) + len(sets[j]) - both) - 1e-9:
                a, b = sorted((root(i), root(j)))
                top[b] = a
    rows = {i: t for i, t in rows.items() if root(i) == i}
    items = [(r.item_id, r.text) for r in spark.read.parquet(f"{sf}/benchmark.parquet").collect()]
    hits = decontaminate.Seeds(items).overlaps(list(rows.values()))
    return {i: t for (i, t), found in zip(rows.items(), hits) if not found}


def test_whole_run_against_a_plain_version(spark, sf):
    want = plain(spark, sf)
    got = {r.doc_id: r.decoded_sha256 for r in corpus_pipeline.run(spark, sf).collect()}
    assert got == {i: hashlib.sha256((t or "").encode()).hexdigest() for i, t in want.items()}
    assert 0 < len(got) < spark.read.parquet(f"{sf}/documents.parquet").count()


@pytest.fixture
def made(spark, sf, tmp_path):
    def write(rows):
        spark.createDataFrame(rows, DDL).write.parquet(str(tmp_path / "documents.parquet"))
        for name in ("labels", "benchmark"):
            os.symlink(f"{sf}/{name}.parquet", tmp_path / f"{name}.parquet")
        return str(tmp_path)

    return write


def test_nulls_repeats_long_texts_and_clashing_columns(spark, made):
    long = " ".join(f"w{i} x{i * 7 % 1009}" for i in range(30_000))
    rows = [
        (1, "One two three four five six seven eight nine ten", None, None, None, 1, 2, 3, True),
        (2, None, "xx", "s", 4, None, None, None, None),
        (3, "", "xx", "s", 4, None, None, None, False),
        (None, "A text without a number of its own, kept as it is", "xx", "s", 4, 0, 0, 0, None),
        (4, "ONE two three four five six seven eight nine ten", None, None, None, 1, 2, 3, True),
        (5, long, "xx", "s", len(long), 1, 1, 1, True),
        (5, long, "xx", "s", len(long), 1, 1, 1, True),
    ]
    sf_dir = made([(*r, 1, 2) for r in rows])
    docs = common.table(spark, sf_dir, "documents")
    for _, stage in corpus_pipeline.STAGES[:-1]:
        docs = stage(spark, docs, sf_dir)
        assert docs.columns == [*DDL.replace(",", "").split()[:-4:2], "a.b", "c`d"]
    got = corpus_pipeline.run(spark, sf_dir).collect()
    assert sorted((r.doc_id for r in got if r.doc_id), key=int) == [1, 2, 3, 5, 5]
    assert sum(r.doc_id is None for r in got) == 1
    assert {r.doc_id: r.n_tokens for r in got}[2] == 0


def test_empty_table(spark, made):
    assert corpus_pipeline.run(spark, made([])).count() == 0


def test_only_the_last_table_is_left(spark, sf):
    before = set(common._WRITTEN)
    corpus_pipeline.run(spark, sf)
    left = [p.rsplit("/", 1)[1].rsplit("-", 1)[0] for p in common._WRITTEN if p not in before]
    assert left == [corpus_pipeline.STAGES[-2][0]]
