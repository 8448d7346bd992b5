import itertools
import random
import zlib

import numpy as np
import pytest
from pyspark.sql import functions as F

pipeline = pytest.importorskip("corpus_pipeline")

from ferngraph.llm import toxicity  # noqa: E402
from tests.llm.test_text_operators import brute_groups, brute_lines, brute_spans, library  # noqa: E402

COLUMNS = "doc_id long, text string, lang string, source string, n_chars long"


def corpus():
    """Documents of every kind that a stage acts on, and labels of some."""
    r = random.Random(17)
    words = [f"w{k}" for k in range(400)]
    line = lambda n=9: " ".join(r.choice(words) for _ in range(n))
    shared, base = [line() for _ in range(4)], [line() for _ in range(8)]
    rows, labels = [], []
    for k in range(160):
        lines = [line() for _ in range(r.randint(1, 9))]
        toxic = k % 4 == 0
        if k % 5 == 1:
            lines += shared
        if k % 5 == 2:
            lines[-1] += f" write to joe{k}@example.org or 10.0.{k}.1 now"
        if k % 5 == 3:
            lines = [x if r.random() < 0.9 else f"{x} more" for x in base]
        if toxic:
            lines[0] += " thou loathsome knave"
        rows.append((k, "\n".join(lines)))
        labels.append((k, int(toxic)))
    rows += [(200, rows[7][1]), (201, rows[7][1]), (202, None), (203, ""), (204, "one"), (205, "one"), (206, "x " * 3000), (7, rows[7][1])]
    return [(i, t, "en", "s", len(t or "")) for i, t in rows], labels


@pytest.fixture(scope="module")
def stages(spark, tmp_path_factory):
    """What each stage read and made."""
    top = tmp_path_factory.mktemp("pipeline")
    rows, labels = corpus()
    spark.createDataFrame(rows, COLUMNS).write.parquet(f"{top}/documents.parquet")
    spark.createDataFrame(labels, "doc_id long, toxic int").write.parquet(f"{top}/labels.parquet")
    docs, out = spark.read.parquet(f"{top}/documents.parquet"), []
    for k, (_, stage) in enumerate(pipeline.STAGES):
        stage(spark, docs, str(top)).write.parquet(f"{top}/out-{k}")
        made = spark.read.parquet(f"{top}/out-{k}")
        out.append((docs, made))
        docs = made
    assert all(made.columns == [c.split()[0] for c in COLUMNS.split(", ")] for _, made in out[:-1])
    assert all(r.n_chars == len(r.text) for _, made in out[1:-1] for r in made.where("text is not null").collect())
    return out, spark.createDataFrame(labels, "doc_id long, toxic int")


def pairs(df):
    return sorted(((r.doc_id, r.text) for r in df.collect()), key=lambda x: (x[0], x[1] or ""))


def test_toxic_documents_go(stages):
    (docs, made), labels = stages[0][0], stages[1]
    fm = toxicity.train(docs, labels)
    kept = []
    for i, t in pairs(docs):
        raw = np.frombuffer((t or "").encode(), np.uint8)
        place = toxicity._terms(raw, np.array([0, len(raw)]), None)[1]
        z = fm.bias + sum(float(fm.weight[p]) for p in place) + sum(float(fm.factors[a] @ fm.factors[b]) for a, b in itertools.combinations([p for p in place if fm.factors[p].any()], 2))
        if 1 / (1 + np.exp(-z)) < 0.3:
            kept.append((i, t))
    assert pairs(made) == kept
    left = {i for i, _ in kept}
    assert not left & set(range(0, 160, 4)) and len(left & set(range(160))) > 110


def test_repeated_lines_go(stages):
    docs, made = stages[0][1]
    want = brute_lines([(i, t) for i, t in dict(pairs(docs)).items() if t is not None])
    assert all(t == want[i][0] for i, t in pairs(made) if t is not None) and [i for i, _ in pairs(made)] == [i for i, _ in pairs(docs)]
    assert sum(n for _, _, n in want.values()) > 50


def test_near_duplicates_go(stages):
    docs, made = stages[0][2]
    groups = brute_groups([(i, t) for i, t in dict(pairs(docs)).items()], 5, 80)
    assert pairs(made) == [(i, t) for i, t in pairs(docs) if groups[i][1] == i]
    assert len(pairs(made)) < len(pairs(docs))


def test_personal_data_are_masked(stages):
    docs, made = stages[0][3]
    want = []
    for i, t in pairs(docs):
        at, out = 0, ""
        for kind, s, e in sorted(brute_spans(t), key=lambda x: (x[1], -x[2])):
            if s >= at:
                out += t[at:s] + f"[{('EMAIL', 'IP', 'CARD', 'PHONE')[kind]}]"
            at = max(at, e)
        want.append((i, None if t is None else out + t[at:]))
    assert pairs(made) == sorted(want, key=lambda x: (x[0], x[1] or "")) and any("[EMAIL]" in (t or "") and "[IP]" in t for _, t in want)


def test_documents_are_packed(stages):
    docs, made = stages[0][4]
    rows, whole, got = made.collect(), library("word_bpe_49k.json"), {}
    for r in sorted(rows, key=lambda r: (r.sequence_id, r.offset)):
        if r.start == 0:
            got.setdefault(r.doc_id, []).append([])
        got[r.doc_id][-1] += np.frombuffer(r.tokens, "<u4").tolist()
        assert zlib.crc32(r.tokens) == r.ids_crc32 and r.offset + r.length <= 2048
    want = {}
    for i, t in pairs(docs):
        want.setdefault(i, []).append([*whole(t), 1])
    assert {k: sorted(v) for k, v in got.items()} == {k: sorted(v) for k, v in want.items()}
    full = [sum(r.length for r in rows if r.sequence_id == s) for s in {r.sequence_id for r in rows}]
    assert sorted(full)[1:] == [2048] * (len(full) - 1)


def test_stages_of_empty_tables_and_clashing_names(spark, tmp_path):
    spark.createDataFrame([(1, 1), (2, 0)], "doc_id long, toxic int").write.parquet(f"{tmp_path}/labels.parquet")
    names = ("score", "k", "k2", "starts", "spans", "masked", "c0", "label", "component_id")
    for n in (0, 3):
        docs = spark.createDataFrame([(1, "a b c", "en", "s", 5), (None, None, None, None, None), (2, "d@e.fr", "en", "s", 6)][:n], COLUMNS)
        for name in names:
            docs = docs.withColumn(name, F.lit(1))
        for _, stage in pipeline.STAGES[:-1]:
            made = stage(spark, docs, str(tmp_path))
            assert made.columns == docs.columns and made.count() <= n and all(r.score == 1 for r in made.collect())
        assert pipeline.STAGES[-1][1](spark, docs, str(tmp_path)).count() == n
