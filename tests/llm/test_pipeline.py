"""The pipeline's stages on a small folder of tables."""

import collections
import random

import pytest

from .test_operators import DOCS, WORDS, jaccard_components, labelled, repeats, sentence

pipeline = pytest.importorskip("corpus_pipeline")


@pytest.fixture(scope="module")
def folder(spark, tmp_path_factory):
    rows, labels = labelled(240)
    rows = [(i, t, g, f"s{i % 4}", n) for i, t, g, s, n in rows]
    passage = rows[0][1] * 3
    rows += [(500 + k, rows[k][1], "aa", "s1", None) for k in range(20)] + [(600 + k, rows[30 + k][1] + " " + passage, "aa", "s2", None) for k in range(8)] + [(700, None, None, None, None), (701, "", None, "s1", 0)]
    root = str(tmp_path_factory.mktemp("tables"))
    spark.createDataFrame(rows, DOCS).write.parquet(f"{root}/documents.parquet")
    spark.createDataFrame(labels, "doc_id long, quality int, toxic int").write.parquet(f"{root}/labels.parquet")
    return root


def test_stages(spark, folder):
    docs = spark.read.parquet(f"{folder}/documents.parquet")
    names = docs.columns
    before = [tuple(r) for r in docs.collect()]
    good = pipeline.good_quality(spark, docs, folder)
    assert good.columns == names and 0 < good.count() < len(before)
    one = pipeline.one_of_each(spark, good, folder)
    parts = jaccard_components([tuple(r) for r in good.collect()])
    assert one.columns == names and sorted(r.doc_id for r in one.collect()) == sorted(i for i, c in parts.items() if i == c)
    cut = pipeline.without_repeats(spark, one, folder)
    held = [tuple(r) for r in one.collect()]
    left = collections.Counter()
    for (i, n, gone, *_), k in repeats(held).items():
        left[i, n - gone] += k
    assert cut.columns == names and collections.Counter((r.doc_id, len((r.text or "").encode())) for r in cut.collect()) == left
    mixed = pipeline.mixed(spark, cut, folder)
    count = collections.Counter(r.doc_id for r in mixed.collect())
    assert mixed.columns == names and set(count.values()) <= {1, 2}
    assert all(WORDS.search(r.text) for r in mixed.collect())
    tokens = pipeline.tokens(spark, mixed, folder)
    assert collections.Counter(r.doc_id for r in tokens.collect()) == count


def test_texts_of_a_repeated_id_are_judged_one_by_one(spark, folder):
    rng = random.Random(4)
    a, b, c, d, e = (sentence(rng, 80) for _ in range(5))
    rows = [(1, a), (2, a + " tail"), (2, b), (3, b + " tail"), (4, c), (4, d), (4, d), (5, d), (5, e), (6, c), (None, a)]
    docs = spark.createDataFrame([(i, t, f"l{k}", None, None) for k, (i, t) in enumerate(rows)], DOCS)
    found = [sorted(pipeline.one_of_each(spark, part, folder).collect(), key=str) for part in (docs, docs.repartition(5))]
    assert found[0] == found[1]
    named = [r.text for r in found[0] if r.doc_id is not None]
    assert collections.Counter(t.removesuffix(" tail") for t in named) == collections.Counter([a, b, c, d, e])
    assert len(found[0]) == 6


def test_run(spark, folder):
    a, b = (sorted(tuple(r) for r in pipeline.run(spark, folder).collect()) for _ in range(2))
    assert a == b and a
    assert [n for n, _ in pipeline.STAGES] == ["quality", "near_duplicates", "repeated_passages", "mix", "tokens"]
