"""Each stage of the pipeline against what brute force makes of its own input."""

import random

import corpus_pipeline as cp
from canopyforge.llm import decontaminate, linededup, pieces, simhash, toxicity
import importlib.util
import os

_spec = importlib.util.spec_from_file_location("llm_brute_force", os.path.join(os.path.dirname(__file__), "test_corpus_operators.py"))
_other = importlib.util.module_from_spec(_spec)
_spec.loader.exec_module(_other)
contamination, groups, kept_lines = _other.contamination, _other.groups, _other.kept_lines


def _docs(spark, rows):
    return spark.createDataFrame([(i, t, "en", "s", len(t or "")) for i, t in rows], "doc_id long, text string, lang string, source string, n_chars long")


def test_names_and_columns():
    assert [n for n, _ in cp.STAGES] == ["toxicity", "line_dedup", "simhash_near_dedup", "decontamination", "sentencepiece"]
    assert cp.ORACLE_SQL is None


def test_stages_in_turn(spark, data):
    docs = cp.read(spark, data, "documents")
    before = [(r.doc_id, r.text) for r in docs.select("doc_id", "text").collect()]
    labels = cp.read(spark, data, "labels").where(~toxicity.held_out(cp.F.col("doc_id")))
    model = toxicity.fit_sample(docs, labels)
    docs = cp.cut(cp.not_toxic(spark, docs, data), "t1")
    assert docs.columns == list(cp.COLUMNS)
    scores = model.tag([t for _, t in before], {})[0]
    rows = [r for r, s in zip(before, scores) if s < toxicity.THRESHOLD]
    assert sorted((r.doc_id, r.text) for r in docs.collect()) == sorted(rows)

    docs = cp.cut(cp.without_repeated_lines(spark, docs, data), "t2")
    rows = [(i, t) for i, t, _, _ in kept_lines(rows)]
    assert sorted((r.doc_id, r.text, r.n_chars) for r in docs.collect()) == sorted((i, t, len(t)) for i, t in rows)

    docs = cp.cut(cp.one_of_near_copies(spark, docs, data), "t3")
    root = groups(sorted((i, simhash.fingerprint(t)) for i, t in rows))
    rows = [(i, t) for i, t in rows if root[i] == i]
    assert sorted((r.doc_id, r.text) for r in docs.collect()) == sorted(rows)

    docs = cp.cut(cp.not_contaminated(spark, docs, data), "t4")
    items = [(r.item_id, r.text) for r in cp.read(spark, data, "benchmark").collect()]
    bad = {r[0] for r in contamination(rows, items) if r[4]}
    rows = [(i, t) for i, t in rows if i not in bad]
    assert sorted((r.doc_id, r.text) for r in docs.collect()) == sorted(rows)
    assert bad

    import hashlib

    out = cp.as_pieces(spark, docs, data).collect()
    assert sorted((r.doc_id, r.text_sha256) for r in out) == sorted((i, hashlib.sha256(t.encode()).hexdigest()) for i, t in rows)
    assert sorted(r.doc_id for r in cp.run(spark, data).select("doc_id").collect()) == sorted(i for i, _ in rows)


def test_odd_rows_pass_every_stage(spark, data):
    rows = [(1, None), (2, ""), (None, "a null id with words"), (4, "clean text of a few words"), (5, "w " * 20_000)]
    docs = _docs(spark, rows)
    for _, stage in cp.STAGES[:-1]:
        docs = cp.cut(stage(spark, docs, data), "odd")
    left = [r.doc_id for r in docs.collect()]
    assert None in left and 4 in left and 5 in left and 1 in left and 2 not in left  # empty ones are one group
    assert cp.as_pieces(spark, docs, data).count() == len(left)


def test_one_id_with_several_texts_loses_only_copies(spark, data):
    rnd = random.Random(2)
    text = lambda: " ".join(f"q{rnd.randrange(3000)}" for _ in range(200))
    a, b = text(), text()
    docs = _docs(spark, [(1, a), (2, a), (2, b), (2, b), (None, a), (None, None)])
    kept = sorted(((r.doc_id, r.text) for r in cp.one_of_near_copies(spark, docs, data).collect()), key=repr)
    assert kept == sorted([(1, a), (2, b), (2, b), (None, a), (None, None)], key=repr)


def test_empty_documents(spark, data):
    docs = _docs(spark, []).limit(0)
    for _, stage in cp.STAGES:
        docs = stage(spark, docs, data)
        assert docs.count() == 0


def test_planted_cases(spark, data):
    rnd = random.Random(1)
    words = [f"q{i}" for i in range(3000)]
    text = lambda n: " ".join(rnd.choice(words) for _ in range(n))
    copy = text(300)
    near = copy.split(" ")
    near[150] = "changed"
    docs = _docs(spark, [(10**6, copy), (10**6 + 1, copy), (10**6 + 2, " ".join(near)), (10**6 + 3, text(300))])
    kept = {r.doc_id for r in cp.one_of_near_copies(spark, docs, data).collect()}
    assert kept == {10**6, 10**6 + 3}
    assert decontaminate.WINDOW == 13 and linededup.LEAST_CHARS == 10 and pieces.SPACE
