"""Operators against brute force, exact round trips and held-out accuracy, on small tables."""

import collections
import hashlib
import pathlib
import random
import re
import time
import zlib

import numpy as np
import pyarrow as pa
import pytest
from pyspark.sql import functions as F

from lumenmill.llm import ann, bpe, langid, mixing, neardup, ngram_join, quality, sharding, suffix_dedup, toxicity
from lumenmill.llm.common import Scratch, frugal
from lumenmill.llm.components import components

DOCS = "doc_id long, text string, lang string, source string, n_chars long"
WORDS = re.compile(r"[^\x20\x09-\x0D]+")
LOW = str.maketrans("ABCDEFGHIJKLMNOPQRSTUVWXYZ", "abcdefghijklmnopqrstuvwxyz")


def sentence(rng, n, letters="abcdefgh"):
    return " ".join("".join(rng.choice(letters) for _ in range(rng.randrange(1, 7))) for _ in range(n))


def corpus():
    """Copies, near copies, a shared passage, odd cases; ids repeat nowhere but in the last rows."""
    rng = random.Random(5)
    base, passage = sentence(rng, 150), sentence(rng, 60)
    texts = [base] * 12
    for k in range(60):
        words = base.split()
        words[rng.randrange(150)] = f"edit{k}"
        texts.append(" ".join(words))
    texts += [sentence(rng, rng.randrange(5, 40)) + " " + passage + " " + sentence(rng, 30) for _ in range(70)]
    texts += [sentence(rng, rng.randrange(1, 200)) for _ in range(60)]
    texts += [None, "", "   ", "one", "One", "one two three four", "a b c d e", "A b c d e", "ß é 中文 \x00 x", "ab" * 600, "xyz " * 300, sentence(rng, 6000)]
    rows = [(k, t, None if k % 17 == 0 else "ab", None if k % 11 == 0 else f"s{min(k % 5, 2)}", None) for k, t in enumerate(texts)]
    return rows + [rows[3], (None, base, None, "s1", None), (None, "alone", None, None, None)]


@pytest.fixture(scope="module")
def docs(spark):
    return spark.createDataFrame(corpus(), DOCS).withColumn("_id", F.lit("clash")).withColumn("rep", F.lit(1)).withColumn("h", F.lit(2)).repartition(3)


@pytest.fixture(scope="module")
def empty(spark):
    return spark.createDataFrame([], DOCS)


# --- scratch tables ---------------------------------------------------------------


def test_scratch_writes_no_files_but_checked_parts(spark):
    scratch = Scratch(spark, "plain")
    rows = spark.range(3000, numPartitions=3).select("id", F.sha2(F.col("id").cast("string"), 512).alias("s"))
    kept = scratch.keep(rows, "t")
    assert sorted(kept.collect()) == sorted(rows.collect())
    parts = [p for p in (pathlib.Path(scratch.root.removeprefix("file:")) / "t").iterdir()]
    assert len(parts) == 3 and all(p.name.startswith("part-") for p in parts)
    data = bytearray(parts[0].read_bytes())
    data[len(data) // 3] ^= 1
    parts[0].write_bytes(bytes(data))
    with pytest.raises(Exception, match="(?i)checksum|CRC|corrupt|could not verify"):
        kept.collect()


def test_scratch_lets_the_driver_give_freed_memory_back(spark):
    memory, pid = spark.sparkContext._jvm.org.apache.spark.unsafe.Platform, spark.sparkContext._jvm.java.lang.ProcessHandle.current().pid()
    held = lambda: int(re.search(r"\nRssAnon:\s+(\d+)", pathlib.Path(f"/proc/{pid}/status").read_text())[1]) // 1024
    rows, scratch, blocks, size = spark.range(9), Scratch(spark, "freed"), [], 64 << 10
    scratch.keep(rows, "before")
    for _ in range(3200):
        blocks.append(memory.allocateMemory(size))
        memory.setMemory(blocks[-1], 1, size)
    for k, block in enumerate(blocks):
        if k % 16:  # what stays keeps the arenas open
            memory.freeMemory(block)
    freed = held()
    scratch.keep(rows, "after")
    given = freed - held()
    for block in blocks[::16]:
        memory.freeMemory(block)
    assert given > 80


# --- components ------------------------------------------------------------------


def test_components(spark):
    rng = random.Random(1)
    edges = [(rng.randrange(300), rng.randrange(300)) for _ in range(220)] + [(k, k + 1) for k in range(1000, 1100)] + [(5000, k) for k in range(4000, 4050)]
    root = {x: x for e in edges for x in e}

    def find(x):
        while root[x] != x:
            x = root[x]
        return x

    for a, b in edges:
        p, q = sorted((find(a), find(b)))
        root[q] = p
    got = {r.node: r.component for r in components(spark.createDataFrame(edges, "a long, b long"), Scratch(spark, "t")).collect()}
    assert all(got[x] == find(x) for e in edges if e[0] != e[1] for x in e)


def test_components_take_the_rounds_they_need(spark, monkeypatch):
    monkeypatch.setattr("lumenmill.llm.components.MOST_ROUNDS", 1, raising=False)
    edges = spark.createDataFrame([(k, k + 1) for k in range(40)], "a long, b long")
    assert {r.component for r in components(edges, Scratch(spark, "t")).collect()} == {0}


# --- 1 ----------------------------------------------------------------------------


def shingles(text):
    w = WORDS.findall((text or "").translate(LOW))
    return frozenset(tuple(w[k : k + 5]) for k in range(len(w) - 4)) if len(w) >= 5 else frozenset([tuple(w)] if w else [])


def jaccard_components(rows):
    sets = {}
    for i, t, *_ in rows:
        if i is not None:
            sets.setdefault(i, set()).add(shingles(t))
    ids = sorted(sets)
    root = {i: i for i in ids}

    def find(x):
        while root[x] != x:
            x = root[x]
        return x

    for i in ids:
        for j in ids:
            if i < j and any(x and y and 100 * len(x & y) >= 80 * len(x | y) for x in sets[i] for y in sets[j]):
                p, q = sorted((find(i), find(j)))
                root[q] = p
    return {i: find(i) for i in ids}


@pytest.mark.parametrize("group, frequent", [(40, 64), (4, 8), (2, 1000)])
def test_jaccard_join(docs, monkeypatch, group, frequent):
    monkeypatch.setattr(ngram_join, "GROUP", group)
    monkeypatch.setattr(ngram_join, "FREQUENT", frequent)
    want = jaccard_components(corpus())
    got = ngram_join.jaccard_components(docs).collect()
    assert len(got) == len(corpus())
    for r in got:
        if r.doc_id is not None:
            assert r.component_id == want[r.doc_id]
        else:
            assert r.component_id is None
    sizes = {i: len(shingles(t)) for i, t, *_ in corpus()}
    assert all(r.n_shingles == sizes[r.doc_id] for r in got if r.doc_id is not None)


def test_prefix_length_is_enough():
    for n in range(1, 200):
        for least in range(1, 4):
            need = -(-n * 80 // 100)
            assert ngram_join.prefix_length(n, least) == n - need + least


def test_jaccard_join_empty(empty):
    assert ngram_join.jaccard_components(empty).collect() == []


def test_jaccard_join_null_id_copy_ahead_of_its_group(spark):
    rng = random.Random(8)
    base = sentence(rng, 120)
    rows = [(None, base, None, None, None), (7, base, None, None, None), (3, base + " edit", None, None, None), (9, base, None, None, None)]
    got = [r.component_id for r in ngram_join.jaccard_components(spark.createDataFrame(rows, DOCS).coalesce(1)).collect() if r.doc_id is not None]
    assert got == [3, 3, 3]


def link_counts(rows):
    sets = collections.defaultdict(set)
    for i, t, *_ in rows:
        if i is not None:
            sets[i].add(shingles(t))
    near = lambda x, y: x and y and 100 * len(x & y) >= 80 * len(x | y)
    return {i: sum(j != i and any(near(x, y) for x in sets[i] for y in sets[j]) for j in sets) for i in sets}


@pytest.mark.parametrize("group, block", [(40, 2048), (4, 16)])
def test_jaccard_join_counts_every_link(spark, docs, monkeypatch, group, block):
    monkeypatch.setattr(ngram_join, "GROUP", group)
    monkeypatch.setattr(ngram_join, "BLOCK", block)
    monkeypatch.setattr(ngram_join, "COLUMNS", 100)
    rows = corpus()
    # ids on several texts: copies, near copies and texts of others
    more = [(7, rows[100][1], None, None, None), (30, rows[31][1], None, None, None), (31, rows[0][1] + " tail", None, None, None), (900, rows[40][1], None, None, None), (900, "", None, None, None), (901, rows[150][1], None, None, None), (901, rows[151][1], None, None, None), (901, rows[151][1] + " t", None, None, None)]
    want = link_counts(rows + more)
    assert sum(want.values()) > 3000
    got = ngram_join.jaccard_components(docs.select("doc_id", "text", "lang", "source", "n_chars").unionByName(spark.createDataFrame(more, DOCS))).collect()
    assert len(got) == len(rows + more)
    assert all(r.n_links == want.get(r.doc_id) for r in got)
    parts = jaccard_components(rows + more)
    assert all(r.component_id == parts.get(r.doc_id) for r in got)


# --- 2, 9, 7 --------------------------------------------------------------------------


def labelled(n=360):
    rng = random.Random(3)
    rows, labels = [], []
    tongues = {"aa": "abcdeab", "bb": "mnopqmn", "cc": "uvwxyzé"}
    for k in range(n):
        lang = list(tongues)[k % 3]
        text = sentence(rng, rng.randrange(20, 80), tongues[lang])
        good, toxic = rng.random() > 0.3, rng.random() < 0.3
        if toxic:
            words = text.split()
            for _ in range(3):
                words.insert(rng.randrange(len(words)), rng.choice(["grubby", "vilefool"]))
            text = " ".join(words)
        if not good:
            text = " ".join(w + "###" for w in text.split()) if rng.random() < 0.5 else (text.split()[0] + " ") * 50
        rows.append((k, text, lang if k % 7 else None, "s", len(text)))
        if k % 2:
            labels.append((k, int(good), int(toxic)))
    return rows, labels


ODD = [(1001, None, None, None, None), (1002, "", None, None, None), (1003, "123 !!", None, None, None), (None, "abc abd", "aa", None, None)]


def fold(i, m, r):
    return i is not None and zlib.crc32(str(i).encode()) % m == r


def test_language(spark, empty):
    rows, _ = labelled()
    got = {r.doc_id: r for r in langid.identify(spark.createDataFrame(rows + ODD, DOCS)).collect()}
    assert len(got) == len(rows) + len(ODD)
    truth = {r[0]: list(("aa", "bb", "cc"))[r[0] % 3] for r in rows}
    held = [i for i in truth if got[i].held_out]
    assert held == [i for i in truth if fold(i, 3, 1)]
    assert np.mean([got[i].lang_pred == truth[i] for i in held]) > 0.95
    assert all(got[i].lang_pred == "und" and got[i].score == 0 for i in (1001, 1002, 1003))
    assert langid.identify(empty).collect() == []
    untaught = langid.identify(spark.createDataFrame([(1, "abc", None, None, None)], DOCS)).collect()
    assert untaught[0].lang_pred == "und"


def test_language_never_sees_the_held_out_labels(spark):
    rows, _ = labelled(120)
    twisted = [(i, t, "zz" if fold(i, 3, 1) else g, s, n) for i, t, g, s, n in rows]
    a, b = ({r.doc_id: (r.lang_pred, round(r.score, 9)) for r in langid.identify(spark.createDataFrame(x, DOCS)).collect()} for x in (rows, twisted))
    assert a == b


def test_quality(spark, empty):
    rows, labels = labelled()
    lab = spark.createDataFrame(labels, "doc_id long, quality int, toxic int")
    got = {r.doc_id: r for r in quality.classify(spark.createDataFrame(rows + ODD, DOCS), lab).collect()}
    held = [(got[i].predicted, g) for i, g, _ in labels if fold(i, 3, 1)]
    assert np.mean([p == g for p, g in held]) > 0.9 and all(0 <= r.score <= 1 for r in got.values())
    again = {r.doc_id: r.score for r in quality.classify(spark.createDataFrame((rows + ODD)[::-1], DOCS).repartition(5), lab).collect()}
    assert all(abs(again[i] - got[i].score) < 1e-9 for i in again)
    assert quality.classify(empty, lab).collect() == []
    assert len(quality.classify(spark.createDataFrame(ODD, DOCS), lab.limit(0)).collect()) == len(ODD)


def test_quality_carries_columns(spark):
    rows, labels = labelled(60)
    df = spark.createDataFrame(rows, DOCS)
    lab = spark.createDataFrame(labels, "doc_id long, quality int, toxic int")
    out = quality.classify(df, lab, keep=tuple(df.columns)).select("kept.*")
    assert out.columns == df.columns and sorted(map(tuple, out.collect())) == sorted(rows)


def test_toxicity(spark, empty):
    rows, labels = labelled()
    lab = spark.createDataFrame(labels, "doc_id long, quality int, toxic int")
    hidden = [(2001, "abcde gru66y abcde", None, None, None), (2002, "abcde v1lef00l", None, None, None), (2003, "abcde bcd", None, None, None)]
    got = {r.doc_id: r for r in toxicity.classify(spark.createDataFrame(rows + ODD + hidden, DOCS), lab).collect()}
    held = [(got[i].predicted, t) for i, _, t in labels if fold(i, 5, 0)]
    assert np.mean([p == t for p, t in held]) > 0.9
    assert got[2002].predicted == 1 and got[2003].predicted == 0 and got[2001].score > got[2003].score
    assert got[1001].score == got[1002].score
    assert toxicity.classify(empty, lab).collect() == []


def test_restoring():
    counts = np.zeros(toxicity.TABLE)
    for w in ["idiot", "stupid", "loser", "scum", "worthless", "the", "cat", "sat", "letter", "book"] * 50:
        c = [0, 0, 0, *(ord(x) - 96 for x in w), 0]
        for k in range(3, len(c)):
            counts[((c[k - 3] * 27 + c[k - 2]) * 27 + c[k - 1]) * 27 + c[k]] += 1
    model = toxicity.LetterModel(counts)
    for given, want in (("1d10t", "idiot"), ("$tup1d", "stupid"), ("stuuupid", "stupid"), ("s c u m", "scum"), ("l.o.s.e.r", "loser"), ("letter", "letter"), ("w0rthle55", "worthless")):
        assert toxicity.restore(given, model) == want
    table = np.exp(model.log.reshape(-1, 27)).sum(axis=1)
    assert np.allclose(table, 1, atol=1e-4)


def letter_model():
    """A model of a few words, and a function that tells whether a text has all features of a word."""
    counts = np.zeros(toxicity.TABLE)
    for w in ["idiot", "you", "are", "total", "the", "cat", "sat", "letter", "book", "and", "not"] * 50:
        c = [0, 0, 0, *(ord(x) - 96 for x in w), 0]
        for k in range(3, len(c)):
            counts[((c[k - 3] * 27 + c[k - 2]) * 27 + c[k - 1]) * 27 + c[k]] += 1
    model = toxicity.LetterModel(counts)
    return model, lambda text, word="idiot": toxicity.Restorer(model).features(word) <= toxicity.Restorer(model).features(text)


def test_a_late_word_of_a_spaced_run_counts():
    _, holds = letter_model()
    for n in (1, 5, 40):
        spaced = " ".join("thecatsatandthecatisnotabook" * n + "idiot")
        assert holds(spaced) and holds(spaced.replace(" ", "."))
    assert not holds(" ".join("thecatsatandthecatisnotabook"))


def test_hidden_words_anywhere_in_a_chunk_count():
    _, holds = letter_model()
    assert holds("total.1d10t") and holds("total_1diiiot") and not holds("total.b00k")
    for n in (8, 300):
        assert holds("the-cat." * n + "1d10t") and holds("thecat" * n + "1d10t")


# --- 3, 5 --------------------------------------------------------------------------------


def test_mix(docs, empty):
    rows = [r for r in mixing.mix(docs).collect()]
    size = lambda t: len(WORDS.findall(t or ""))
    assert len(rows) == len(corpus())
    sizes = collections.Counter()
    for _, t, _, s, _ in corpus():
        sizes[s] += size(t)
    order = sorted(k for k in sizes if k is not None) + [None]
    weight = {s: (3, 1, 2)[k % 3] for k, s in enumerate(order)}
    target, left, open_ = {}, 1.5 * sum(sizes.values()), set(order)
    while True:
        level = left / sum(weight[s] for s in open_)
        full = {s for s in open_ if level * weight[s] > 2 * sizes[s]}
        if not full:
            break
        for s in full:
            target[s], left = 2 * sizes[s], left - 2 * sizes[s]
        open_ -= full
    target |= {s: level * weight[s] for s in open_}
    source = {(i, size(t)): s for i, t, _, s, _ in corpus()}
    taken, largest = collections.Counter(), collections.Counter()
    for r in rows:
        s = source[r.doc_id, r.size]
        assert r.source_size == sizes[s] and abs(r.target - target[s]) < 1e-6 and r.taken in (0, r.size, 2 * r.size)
        taken[s] += r.taken
        largest[s] = max(largest[s], r.size)
    assert all(abs(taken[s] - target[s]) <= largest[s] for s in order)
    places = [r.position for r in rows if r.position is not None]
    assert places == sorted(places) and all(0 <= p <= 1 for p in places)
    assert [tuple(r) for r in rows] == [tuple(r) for r in mixing.mix(docs.repartition(7)).collect()]
    assert mixing.mix(empty).collect() == []


def test_shards(docs, empty):
    rows = sharding.shard(docs, 8, buckets=16).collect()
    n = collections.Counter(r.shard for r in rows)
    assert len(rows) == len(corpus()) and max(n.values()) - min(n.values()) <= 1 and set(n) == set(range(8))
    for k in n:
        assert sorted(r.slot for r in rows if r.shard == k) == list(range(n[k]))
    texts = {i: t for i, t, *_ in corpus()}
    for r in rows:
        t = texts[r.doc_id] if r.doc_id is not None else None
        if r.doc_id is not None:
            assert r.text_crc32 == (None if t is None else zlib.crc32(t.encode())) and r.size == len((t or "").encode()) + 1
    mixture = collections.Counter(s for *_, s, _ in corpus())
    by = collections.defaultdict(collections.Counter)
    source = {(i, zlib.crc32(t.encode()) if t is not None else None): s for i, t, _, s, _ in corpus()}
    for r in rows:
        by[r.shard][source[r.doc_id, r.text_crc32]] += 1
    assert all(abs(by[k][s] - mixture[s] / 8) <= 2 for k in by for s in mixture)
    assert sorted(map(tuple, rows), key=str) == sorted(map(tuple, sharding.shard(docs.repartition(6), 8, buckets=16).collect()), key=str)
    assert sharding.shard(empty).collect() == []
    few = sharding.shard(docs.filter("doc_id in (100, 101, 102)"), 8).collect()
    assert sorted(r.shard for r in few) == [0, 1, 2] and {r.slot for r in few} == {0}


# --- 4, 6 ----------------------------------------------------------------------------------


def vectors():
    rng = np.random.default_rng(2)
    x = rng.normal(size=(400, 16))
    dense = x[0] + rng.normal(size=(120, 16)) * 0.02
    rows = [(k, v.tolist()) for k, v in enumerate([*x, *dense, *[x[1]] * 30, *(x[2:40] * 3 + rng.normal(size=(38, 16)) * 0.3)])]
    n = len(rows)
    return rows + [(n, None), (n + 1, []), (n + 2, [0.0] * 16), (n + 3, [1.0] * 15 + [float("nan")]), (n + 4, [1.0] * 15 + [None]), (n + 5, [float("inf")] + [0.0] * 15), (n + 6, [1.0, 2.0]), (5, rows[5][1])]


def usable(v):
    return bool(v) and None not in v and np.isfinite(v).all() and any(v)


@pytest.mark.parametrize("block", [8192, 32])
def test_near_vectors(spark, monkeypatch, block):
    monkeypatch.setattr(neardup, "BLOCK", block)
    rows = vectors()
    got = collections.defaultdict(list)
    for r in neardup.near_duplicates(spark.createDataFrame(rows, "vec_id long, embedding array<double>")).collect():
        got[r.vec_id].append(r)
    ok = [(i, np.array(v)) for i, v in rows if usable(v) and len(v) == 16]
    x = np.stack([v / np.linalg.norm(v) for _, v in ok])
    near = x @ x.T >= 0.9
    np.fill_diagonal(near, False)
    links = {}
    for (i, _), row in zip(ok, near, strict=True):
        links.setdefault(i, []).append(int(row.sum()))
    found, true = sum(r.n_links for rs in got.values() for r in rs), int(near.sum())
    assert 0.98 * true <= found <= true
    assert np.mean([sorted(r.n_links for r in got[i]) == sorted(n) for i, n in links.items()]) > 0.95
    for i, v in rows:
        if not usable(v) or len(v) == 2:
            assert (got[i][0].n_links, got[i][0].component_id, got[i][0].kept) == (0, i, True)
    assert all(r.kept == (r.vec_id == r.component_id) and r.component_id <= r.vec_id for rs in got.values() for r in rs)
    assert {r.component_id for k in range(400, 520) for r in got[k]} == {0}


def test_near_vectors_small(spark):
    schema = "vec_id long, embedding array<float>"
    assert neardup.near_duplicates(spark.createDataFrame([], schema)).collect() == []
    assert neardup.near_duplicates(spark.createDataFrame([(1, [1.0, 0.0])], schema)).first().kept
    pair = neardup.near_duplicates(spark.createDataFrame([(2, [1.0, 0.1]), (1, [1.0, 0.0]), (None, None)], schema)).collect()
    assert sorted((r.vec_id or 0, r.n_links, r.component_id or 0) for r in pair) == [(0, 0, 0), (1, 1, 1), (2, 1, 1)]


def test_pigeonhole_finds_every_code():
    rng = np.random.default_rng(0)
    codes = rng.integers(0, 256, (300, 8), dtype=np.uint8)
    index = ann.Index(codes)
    for radius in (0, 3, 9, 20, 27, 64):
        for q in range(5):
            true = np.flatnonzero(np.bitwise_count(codes ^ codes[q]).sum(axis=1) <= radius)
            assert (index.within(codes[q], radius) == true).all()


def test_search(spark, monkeypatch):
    rows = vectors()
    for blocks in ((16_384, 4096), (100, 5)):
        monkeypatch.setattr(ann, "ROWS", blocks[0])
        monkeypatch.setattr(ann, "QUERIES", blocks[1])
        got = collections.defaultdict(list)
        for r in ann.search(spark.createDataFrame(rows, "vec_id long, embedding array<double>"), F.col("vec_id") % 50 == 0).collect():
            got[r.query_id].append((r["rank"], r.vec_id, r.score))
        ok = {i: np.array(v) / np.linalg.norm(v) for i, v in rows if usable(v) and len(v) == 16}
        asked = [i for i in ok if i % 50 == 0]
        assert sorted(got) == sorted(asked)
        hit = 0
        for q in asked:
            best = sorted(((-float(v @ ok[q]), i) for i, v in ok.items() if i != q))[:5]
            mine = sorted(got[q])
            assert [k for k, _, _ in mine] == [1, 2, 3, 4, 5]
            assert all(abs(s - ok[q] @ ok[i]) < 1e-9 for _, i, s in mine)
            hit += len({i for _, i in best} & {i for _, i, _ in mine})
        assert hit / (5 * len(asked)) >= 0.9


def test_search_small(spark):
    schema = "vec_id long, embedding array<float>"
    every = F.col("vec_id") % 50 == 0
    assert ann.search(spark.createDataFrame([], schema), every).collect() == []
    assert ann.search(spark.createDataFrame([(0, [1.0, 2.0])], schema), every).collect() == []
    few = ann.search(spark.createDataFrame([(0, [1.0, 0.0]), (1, [0.0, 1.0]), (2, [0.0, 1.0])], schema), every).collect()
    assert [(r["rank"], r.vec_id) for r in sorted(few, key=lambda r: r["rank"])] == [(1, 1), (2, 2)]


# --- 8 ----------------------------------------------------------------------------------------


def repeats(rows, length=200):
    """Per row: bytes removed, spans and digest, by looking at every string."""
    data, seen = [(t or "").encode() for _, t, *_ in rows], collections.Counter()
    for d in data:
        seen.update(d[k : k + length] for k in range(len(d) - length + 1))
    out = collections.Counter()
    for (i, *_), d in zip(rows, data, strict=True):
        gone = np.zeros(len(d) + 1, bool)
        for k in range(len(d) - length + 1):
            if seen[d[k : k + length]] > 1:
                gone[k : k + length] = True
        kept = bytes(np.frombuffer(d, np.uint8)[~gone[:-1]]) if d else b""
        out[i, len(d), int(gone.sum()), int((np.diff(np.concatenate([[0], gone.astype(int)])) == 1).sum()), hashlib.sha256(kept).hexdigest()] += 1
    return out


@pytest.mark.parametrize("dense, index", [(1 << 21, 1 << 20), (2000, 1 << 20), (1 << 21, 3000)])
def test_repeated_passages(docs, monkeypatch, dense, index):
    monkeypatch.setattr(suffix_dedup, "DENSE", dense)
    monkeypatch.setattr(suffix_dedup, "INDEX", index)
    got = collections.Counter(map(tuple, suffix_dedup.deduplicate(docs).collect()))
    assert got == repeats(corpus())


def test_rewriting(docs):
    out = suffix_dedup.rewrite(docs)
    assert out.columns == docs.columns and out.count() == len(corpus())
    kept = collections.Counter(hashlib.sha256((r.text or "").encode()).hexdigest() for r in out.collect())
    assert kept == collections.Counter({k: sum(n for (*_, h), n in repeats(corpus()).items() if h == k) for k in {h for *_, h in repeats(corpus())}})


def test_long_texts_are_cut_without_loss(spark, monkeypatch):
    monkeypatch.setattr(suffix_dedup, "SLICE", 1000)
    rng = random.Random(9)
    long, part = sentence(rng, 2000), sentence(rng, 100)
    rows = [(1, long + part + long[:3000], None, None, None), (2, sentence(rng, 300) + part, None, None, None), (3, "q" * 2500, None, None, None)]
    assert collections.Counter(map(tuple, suffix_dedup.deduplicate(spark.createDataFrame(rows, DOCS)).collect())) == repeats(rows)


def test_index_marks_equal_brute_force():
    rng = random.Random(3)
    for _ in range(150):
        base = bytes(rng.choice(b"ab\0\xff") for _ in range(60))
        parts = []
        for _ in range(rng.randrange(1, 9)):
            a = rng.randrange(60)
            s = bytes(rng.choice(b"ab") for _ in range(rng.randrange(8))) + base[a : a + rng.randrange(50)]
            parts.append(s * rng.choice([1, 1, 3]) + b"tail!")
        parts, length = list(dict.fromkeys(parts)), rng.choice([4, 8, 15])
        seen = collections.Counter(p[k : k + length] for p in parts for k in range(len(p) - length + 1))
        for p, marks in zip(parts, suffix_dedup.index_marks(parts, length), strict=True):
            want = np.zeros(len(p), bool)
            for k in range(len(p) - length + 1):
                if seen[p[k : k + length]] > 1:
                    want[k : k + length] = True
            got = np.zeros(len(p), bool)
            for a, b in marks:
                got[a:b] = True
            assert (want == got).all()


def test_repeated_passages_empty(empty):
    assert suffix_dedup.deduplicate(empty).collect() == []


# --- 10 ----------------------------------------------------------------------------------------


@pytest.fixture(scope="module")
def vocabulary():
    tokenizers = pytest.importorskip("public_tokenizers")
    return tokenizers.path("word_bpe_49k.json")


def test_tokens_equal_the_library(docs, vocabulary):
    library = pytest.importorskip("tokenizers").Tokenizer.from_file(vocabulary)
    rng = random.Random(1)
    alphabet = "aAbB zZ09'sTéÉüß İΣσςǅﬁ²½٣中文🙂́​\xa0\x85\x1c\t\n<|>/-_.,!#<|endoftext|>"
    texts = ["".join(rng.choice(alphabet) for _ in range(rng.randrange(60))) for _ in range(3000)]
    texts += ["a" * 3000, "ha" * 2000, "", "<|endoftext|>x<|startoftext|>", "'S it's I'LL", "lololololol nananana"]
    mine = bpe.encoder(vocabulary)
    for t in texts:
        want = library.encode(t, add_special_tokens=False).ids
        ids = mine.encode(t)
        decoded = mine.decode(ids)
        assert ids == " ".join(map(str, want)) and decoded == library.decode(want, skip_special_tokens=False)
    rows = bpe.tokenize(docs, vocabulary, with_ids=True).collect()
    assert len(rows) == len(corpus())
    for r in rows:
        ids = " ".join(map(str, r.ids))
        assert r.n_tokens == len(r.ids) and r.ids_sha256 == hashlib.sha256(ids.encode()).hexdigest() and r.decoded_sha256 == hashlib.sha256(r.decoded.encode()).hexdigest()
    texts = collections.Counter(tuple(library.encode(t or "", add_special_tokens=False).ids) for _, t, *_ in corpus())
    assert collections.Counter(tuple(r.ids) for r in rows) == texts


def test_tokens_empty(empty, vocabulary):
    assert bpe.tokenize(empty, vocabulary).collect() == []


def test_other_work_in_a_worker_forgets_the_encoder(spark, docs, vocabulary):
    rows = docs.coalesce(1)
    bpe.tokenize(rows, vocabulary).collect()

    def kept(batches):
        for b in batches:
            yield pa.RecordBatch.from_arrays([pa.array([bpe.encoder.cache_info().currsize])], ["n"])

    def count(run):
        return {r.n for r in rows.select("doc_id").mapInArrow(run, "n long").collect()}

    bpe.encoder.cache_clear()
    bpe.encoder(vocabulary)
    for kind, left in (("encoder", 1), (None, 0)):
        assert list(frugal(lambda batches: iter([bpe.encoder.cache_info().currsize]), kind)([])) == [left]
    assert count(frugal(kept)) == {0}
    assert bpe.tokenize(rows, vocabulary).count() == rows.count()


def test_an_idle_worker_forgets_the_encoder(vocabulary, monkeypatch):
    monkeypatch.setattr("lumenmill.llm.common.IDLE_S", 0.5)
    task = frugal(lambda batches: iter([bpe.encoder(vocabulary) is not None]), "encoder")
    assert list(task([])) == [True] and bpe.encoder.cache_info().currsize == 1
    time.sleep(2)
    assert bpe.encoder.cache_info().currsize == 0


# --- cases met before ---------------------------------------------------------------------------


def test_words_that_cancel_in_polynomials_differ(spark):
    a = "a"
    while len(a) < 2048:
        a += a.translate(str.maketrans("ab", "ba"))
    rows = [(1, a, None, None, None), (2, a.translate(str.maketrans("ab", "ba")), None, None, None)]
    assert sorted(tuple(r)[:4] for r in ngram_join.jaccard_components(spark.createDataFrame(rows, DOCS)).collect()) == [(1, 1, 1, 1), (2, 1, 2, 2)]


def test_bitmaps_never_hide_a_link():
    rng = np.random.default_rng(2)
    for _ in range(300):
        m = int(rng.integers(1, 400))
        x = np.unique(rng.integers(0, 1 << 62, m).astype(np.uint64))
        y = np.unique(np.concatenate([x[rng.random(len(x)) > rng.random() * 0.3], rng.integers(0, 1 << 62, int(rng.integers(0, m // 5 + 1))).astype(np.uint64)]))
        if len(y):
            shared = len(np.intersect1d(x, y))
            links = 100 * shared >= 80 * (len(x) + len(y) - shared)
            assert ngram_join.possible(len(x), len(y), ngram_join._bitmap(x), ngram_join._bitmap(y)) or not links


def test_a_shared_passage_in_other_documents_links_nothing(spark):
    rng = random.Random(12)
    passage = sentence(rng, 40)
    rows = [(k, f"{sentence(rng, 30)} {passage} {sentence(rng, 30)}", None, None, None) for k in range(300)] + [(1000 + k, passage, None, None, None) for k in range(3)]
    got = ngram_join.jaccard_components(spark.createDataFrame(rows, DOCS)).collect()
    assert {r.doc_id: r.component_id for r in got} == {i: 1000 if i >= 1000 else i for i, *_ in rows}


def test_a_query_on_two_rows_is_one(spark):
    rows = [(0, [1.0, 0.0, 0.0]), (0, [0.0, 1.0, 0.0])] + [(k, [1.0, k / 10, k / 7]) for k in range(1, 6)]
    df = spark.createDataFrame(rows, "vec_id long, embedding array<double>").withColumn("score", F.lit("clash")).withColumn("rank", F.lit(7))
    got = ann.search(df, F.col("vec_id") == 0, k=5).orderBy("rank").collect()
    unit = lambda v: np.array(v) / np.linalg.norm(v)
    best = {k: max(float(unit(q) @ unit(v)) for i, q in rows if i == 0) for k, v in rows[2:]}
    assert [r.vec_id for r in got] == sorted(best, key=lambda k: (-best[k], k)) and [r["rank"] for r in got] == [1, 2, 3, 4, 5]
    assert all(abs(r.score - best[r.vec_id]) < 1e-12 for r in got)


def test_every_code_point_splits_as_in_the_library(vocabulary):
    from tokenizers import Tokenizer

    library, own = Tokenizer.from_file(vocabulary), bpe.Encoder(vocabulary)
    points = [c for c in range(0x110000) if not 0xD800 <= c < 0xE000]
    for make in ("!{}!", "a{}b"):
        for k in range(0, len(points), 60_000):
            texts = [make.format(chr(c)) for c in points[k : k + 60_000] if c < 0x32400 or c % 16 == 0]
            for t, x in zip(texts, library.encode_batch(texts, add_special_tokens=False), strict=True):
                assert own.encode(t) == " ".join(map(str, x.ids)), hex(ord(t[1]))


@pytest.mark.parametrize("label, score", [(1, 1.0), (0, 0.0), (None, 0.0)])
def test_one_sided_toxicity_labels(spark, label, score):
    docs = spark.createDataFrame([(k, f"text {k}", None, None, None) for k in range(20)], DOCS)
    labels = spark.createDataFrame([(k, 1, label) for k in range(20)], "doc_id long, quality int, toxic int")
    assert {r.score for r in toxicity.classify(docs, labels).collect()} == {score}


def test_many_null_ids_spread_over_buckets(spark):
    rows = [(None if k % 3 else k, f"text number {k}", None, "s", None) for k in range(600)] + [(None, None, None, None, None)] * 5
    docs = spark.createDataFrame(rows, DOCS)
    slots = collections.defaultdict(list)
    for r in sharding.shard(docs).collect():
        slots[r.shard].append(r.slot)
    assert all(sorted(s) == list(range(len(s))) for s in slots.values()) and max(map(len, slots.values())) - min(map(len, slots.values())) <= 1
    taken = mixing.mix(docs).collect()
    assert len(taken) == len(rows) and abs(sum(r.taken for r in taken) - 1.5 * 1800) <= 6


def test_the_index_counts_runs_not_bytes():
    part = bytes(range(1, 201)) * 2
    index = suffix_dedup.RunIndex([part + bytes([x]) * 3 for x in range(100)])
    assert index.size > 40_000 and index.runs < index.size / 4


def test_class_prior_from_positives_and_unlabelled():
    rng = np.random.default_rng(4)
    good, bad = rng.normal(0, 1, (6000, 20)), rng.normal(1.2, 1, (3000, 20))
    for share in (0.3, 0.7):
        n = int(4000 * share)
        mixed = np.vstack([good[:n], bad[: 4000 - n] if share > 0.25 else bad])
        assert abs(quality.class_prior(good[-2000:], mixed[: n + 3000]) - n / len(mixed[: n + 3000])) < 0.08
