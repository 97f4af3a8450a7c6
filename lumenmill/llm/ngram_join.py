"""N-gram Jaccard self-join with adaptive multi-match prefixes.

Two documents link if their shingle sets x, y have 100 |x n y| >= 80 |x u y|.
In any common order of all shingles, linked sets share at least l shingles
within the first |x| - ceil(0.8 |x|) + l of each (l = 1, 2, ...). The order
puts shingles of rare words first, those of common words (which meet by chance)
later. A document's candidate cost is estimated from the frequencies in its
prefix; the higher it is, the longer the prefix and the more shared prefix
shingles a pair needs before its sets are compared (the smaller requirement of
the two documents counts).

Documents with equal sets are one class from the start; what follows works on
classes.

1. The prefix shingles are sorted, and those that two classes hold stay. In
   each group of holders one leads; holders that share enough shingles with a
   leader are candidates with it. This joins groups of near copies at the price
   of a pair or a few for each class, however large they are.
2. Only classes that still lie in different groups of candidates can have a link
   that is not covered. Among the holders of a shingle that span several groups,
   pairs across groups are counted; those with enough shared prefix shingles are
   candidates. A large set of holders is not written out as pairs: they are
   dealt into blocks, and every pair of blocks is compared in place (the same
   holders once, whatever number of shingles they share).
3. Verification. A bitmap of each set bounds from above what two sets can share,
   so most pairs that met by chance leave without their texts being moved. Then
   each group's sets are dealt into salted blocks, each pair of blocks meets once
   and compares all its sets exactly; sums of links and a spanning forest leave
   it. As both ends of a link lie in one group, no link is missed.

No group is gathered in a task: groups are streamed in sorted order, and
shingles that very many documents hold are known beforehand and led by minima
with map-side combining. A document's ``n_links`` is the number of other
documents with a set that links with one of its own, equal sets included.

The list of frequent shingles is bounded: only those in ``1 / SHARE`` of the
documents (and ``FREQUENT`` at least) are listed, at most SHARE times the mean
set size. It steers costs and skew, not results.

Cases: null, empty and wordless texts have an empty set, link with nothing and
are their own component; a text of fewer than five words is one shingle; rows
with a null id are returned unlinked with a null component; rows that repeat an
id are one document with the links of all; other columns are ignored.
"""

from __future__ import annotations

import hashlib

import numpy as np
import pyarrow as pa
import zstandard
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from .common import Scratch, frugal, sliced, trim
from .components import components, spanning
from .shingles import Rarity, shingle_sets, text_words

#: Similarity as a fraction.
PART, WHOLE = 80, 100
#: A shingle is frequent from so many documents, or from this share of them.
FREQUENT, SHARE = 64, 4000
#: Most common words whose counts rank the shingles.
WORDS = 1 << 16
#: Most holders of a shingle whose pairs across groups are written out; most shared prefix shingles asked for.
GROUP, MOST_MATCHES = 16, 6
#: Digests that a task remembers.
MEMO = 200_000
#: Orders by which groups choose their leaders: groups that share members then share leaders.
LEADERS = 16
#: Expected probes of a document above which it asks for a second shared shingle; each doubling asks for one more.
PROBES = 8
#: Sets and shingles of a block in which links are counted, about; columns of a product.
BLOCK, BLOCK_SHINGLES, COLUMNS = 1024, 1 << 18, 1024


def prefix_length(n, matches):
    """Shingles among which linked sets share ``matches``."""
    return n - (n * PART + WHOLE - 1) // WHOLE + matches


def _signed(x: np.ndarray) -> pa.Array:
    return pa.array(x.view(np.int64))


def _merged(found: list[tuple[np.ndarray, np.ndarray]]) -> tuple[np.ndarray, np.ndarray]:
    """Values with their counts from parts of both."""
    values = np.concatenate([*(v for v, _ in found), np.zeros(0, np.uint64)])
    counts = np.concatenate([*(c for _, c in found), np.zeros(0, np.int64)])
    order = np.argsort(values, kind="stable")
    values, counts = values[order], counts[order]
    first = np.flatnonzero(np.diff(values, prepend=values[:1] ^ np.uint64(1)))
    return values[first], np.add.reduceat(counts, first) if len(first) else counts


def _words(batches):
    """Counts of a batch's more common words."""
    for b in batches:
        found, total = [], 0
        for part in sliced([b]):
            for h in text_words([t or "" for t in part.column(0).to_pylist()]):
                found.append(np.unique(h, return_counts=True))
                total += len(h)
            if len(found) > 16:
                found = [_merged(found)]
        values, counts = _merged(found)
        some = counts >= max(2, total / (4 * WORDS))
        yield pa.RecordBatch.from_arrays([_signed(values[some]), pa.array(counts[some])], ["token", "n"])


def _frequencies(share: float, rarity):
    """Shingles that are more common in a part of a batch than a quarter of what the bound allows."""

    def run(batches):
        for part in sliced(batches, 4096, 8 << 20):
            every = np.concatenate([*shingle_sets([t or "" for t in part.column(0).to_pylist()], rarity.value), np.zeros(0, np.uint64)])
            every.sort()
            values, counts = _merged([(every, np.ones(len(every), np.int32))])
            some = counts >= max(2, part.num_rows * share / 4)
            yield pa.RecordBatch.from_arrays([_signed(values[some]), pa.array(counts[some].astype(np.int64))], ["token", "n"])

    return run


def _described(held, rarity):
    """(doc_id, n, node, matches, rare, common, bits): the prefix's shingles, frequent ones apart; a bitmap of the set.

    node: 64 bits of the set's digest; a task lists a set once.
    """

    def run(batches):
        frequent, holders = held.value
        met: set[int] = set()
        for b in sliced(batches):
            texts = [t or "" for t in b.column(1).to_pylist()]
            named = b.column(0).is_valid().to_pylist()
            size, nodes, need, rares, commons, bits = [], [], [], [], [], []
            for x, own in zip(shingle_sets(texts, rarity.value), named, strict=True):
                n = len(x)
                size.append(n)
                node = _node(x)
                nodes.append(node)
                if not n or not own or node in met:  # rows without an id link with nothing: their listing is not used
                    for column in (need, rares, commons, bits):
                        column.append(None)
                    continue
                if len(met) >= MEMO:
                    met.clear()
                met.add(node)
                at = np.minimum(np.searchsorted(frequent, x), max(0, len(frequent) - 1))
                common = frequent[at] == x if len(frequent) else np.zeros(n, bool)
                rare = n - int(common.sum())
                short = prefix_length(n, 1)
                # a rare shingle has few holders, a frequent one as many as were counted
                cost = min(short, rare) + int(holders[at[common]][: max(0, short - rare)].sum())
                matches = min(1 + min(MOST_MATCHES - 1, (cost // PROBES).bit_length()), n - short + 1)
                length = prefix_length(n, matches)
                need.append(matches)
                rares.append(x[~common][:length].view(np.int64))
                commons.append(x[common][: max(0, length - rare)].view(np.int64))
                bits.append(_bitmap(x))
            yield pa.RecordBatch.from_arrays([b.column(0), pa.array(size, pa.int32()), pa.array(nodes, pa.int64()), pa.array(need, pa.int32()), *(pa.array(h, pa.list_(pa.int64())) for h in (rares, commons)), pa.array(bits, pa.binary())], ["doc_id", "n", "node", "matches", "rare", "common", "bits"])

    return run


def _node(x: np.ndarray) -> int | None:
    """64 bits of digest that name a set."""
    return int.from_bytes(hashlib.blake2b(x.tobytes(), digest_size=8).digest(), "little", signed=True) if len(x) else None


def _bitmap(x: np.ndarray) -> bytes:
    """A bit for each shingle's hash, in as many bits as the next power of two from the set's size (64 at least)."""
    width = max(64, 1 << (len(x) - 1).bit_length())
    held = np.zeros(width, np.uint8)
    held[(x & np.uint64(width - 1)).astype(np.int64)] = 1
    return np.packbits(held).tobytes()


def _folded(bits: np.ndarray, width: int) -> np.ndarray:
    return np.bitwise_or.reduce(bits.reshape(-1, width), axis=0)


def possible(m: int, n: int, x: bytes, y: bytes) -> bool:
    """Whether sets of m and n shingles with these bitmaps may link: shingles whose bit the other lacks aren't shared."""
    width = min(len(x), len(y)) // 8
    u, v = (_folded(np.frombuffer(z, np.uint64), width) for z in (x, y))
    shared = min(m - int(np.bitwise_count(u & ~v).sum()), n - int(np.bitwise_count(v & ~u).sum()))
    return WHOLE * shared >= PART * (m + n - shared)


def _grouped(batches):
    """Sorted rows (token, h, node) of a partition: (token, node, leader) where a token has two nodes; the first leads.

    Streams: of the token that a batch ends in only its leader is held.
    """
    last, told = np.zeros((2, 0), np.int64), False
    for b in batches:
        if not b.num_rows:
            continue
        had = last.shape[1] > 0
        rows = np.concatenate([last, np.stack([b.column(0).to_numpy(), b.column(2).to_numpy()])], axis=1)
        rows = rows[:, np.concatenate([[True], (rows[:, 1:] != rows[:, :-1]).any(axis=0)])]
        token, node = rows
        start = np.flatnonzero(np.diff(token, prepend=token[:1] ^ 1))
        size = np.diff(np.append(start, len(token)))
        keep = np.repeat(size > 1, size)
        if had and told:  # its leader was sent before; what comes again of its group counts though it be one row
            keep[: size[0]] = True
            keep[0] = False
        told = bool(size[-1] > 1 or (had and told and len(start) == 1))
        last = rows[:, start[-1] :][:, :1]
        yield pa.RecordBatch.from_arrays([pa.array(c) for c in (token[keep], node[keep], node[np.repeat(start, size)[keep]])], ["token", "node", "leader"])


def _possible(batches):
    """Pairs (a, b, m, n, x, y) that their bitmaps allow."""
    for part in sliced(batches, 4096):
        a, b, m, n, x, y = (c.to_pylist() for c in part.columns)
        some = pa.array([possible(*r) for r in zip(m, n, x, y, strict=True)], pa.bool_())
        yield pa.RecordBatch.from_arrays([part.column(0).filter(some), part.column(1).filter(some)], ["a", "b"])


def _packed(batches):
    squeeze = zstandard.ZstdCompressor(level=3)
    for b in sliced(batches):
        yield pa.RecordBatch.from_arrays([b.column(0), pa.array([squeeze.compress((t or "").encode("utf-8", "surrogatepass")) for t in b.column(1).to_pylist()], pa.binary())], ["_id", "z"])


def _held(rarity):
    """Compressed texts with their sets' nodes."""

    def run(batches):
        for b in sliced(batches, 256, 1 << 20):
            yield pa.RecordBatch.from_arrays([pa.array([_node(x) for x in _expanded(b.column(0), rarity)], pa.int64()), b.column(0)], ["node", "z"])

    return run


def _expanded(column, rarity) -> list[np.ndarray]:
    """Sets of compressed texts."""
    expand = zstandard.ZstdDecompressor()
    return list(shingle_sets([expand.decompress(z.as_py()).decode("utf-8", "surrogatepass") for z in column], rarity.value))


def _shared(sets: list[np.ndarray], left: np.ndarray, right: np.ndarray) -> np.ndarray:
    """Numbers of common shingles of the sets at ``left`` and those at ``right``."""
    row = np.repeat(np.arange(len(sets)), [len(x) for x in sets])
    _, col, holders = np.unique(np.concatenate(sets), return_inverse=True, return_counts=True)
    some = holders > 1
    row, col = row[some[col]], (np.cumsum(some) - 1)[col[some[col]]]
    order = np.argsort(col, kind="stable")
    row, col = row[order], col[order]
    out = np.zeros((len(left), len(right)), np.float32)
    for first in range(0, int(some.sum()), COLUMNS):
        a, b = np.searchsorted(col, [first, first + COLUMNS])
        held = np.zeros((len(sets), min(COLUMNS, int(some.sum()) - first)), np.float32)
        held[row[a:b], col[a:b] - first] = 1
        out += held[left] @ held[right].T
    return out


def _linking(sets: list[np.ndarray], left: np.ndarray, right: np.ndarray) -> np.ndarray:
    """Whether the sets at ``left`` link with those at ``right``; nothing links with itself."""
    size = np.array([len(x) for x in sets], np.int64)
    shared, out = _shared(sets, left, right), np.empty((len(left), len(right)), bool)
    for k in range(0, len(left), 128):
        common = shared[k : k + 128].astype(np.int64)
        out[k : k + 128] = WHOLE * common >= PART * (size[left[k : k + 128]][:, None] + size[right] - common)
    out[left[:, None] == right] = False
    return out


def _across(key: tuple[pa.Scalar, ...], table: pa.Table) -> pa.Table:
    """Within a pair of blocks of one shingle's holders: candidates across groups, one for each pair of them."""
    lo, hi = key[1].as_py(), key[2].as_py()
    node, part, block, n = (table[c].to_numpy() for c in ("node", "part", "block", "n"))
    left, right = np.flatnonzero(block == lo), np.flatnonzero(block == hi)
    bits, met, ones, others = table["bits"].to_pylist(), set(), [], []
    for i in left.tolist():
        able = right[(part[right] != part[i]) & (WHOLE * np.minimum(n[right], n[i]) >= PART * np.maximum(n[right], n[i]))]
        for j in able.tolist():
            pair = (min(part[i], part[j]), max(part[i], part[j]))
            if pair not in met and possible(int(n[i]), int(n[j]), bits[i], bits[j]):
                met.add(pair)
                ones.append(int(node[i]))
                others.append(int(node[j]))
    return pa.table({"a": pa.array(ones, pa.int64()), "b": pa.array(others, pa.int64())})


def _counted(node, docs, several, sets, left, right):
    """Rows (kind, node, other, n) for the links between two lists of sets, or within one (see ``_linked``)."""
    twice = left is not right
    link = _linking(sets, left, right)
    names, sums = [node[left]], [link @ docs[right]]
    if twice:
        names.append(node[right])
        sums.append(docs[left] @ link)
    i, j = np.nonzero(link & (several[left][:, None] | several[right]))
    p, q = node[left][i], node[right][j]
    if twice:
        p, q = np.concatenate([p, q]), np.concatenate([q, p])
    names, sums = np.concatenate(names), np.concatenate(sums)
    forest = spanning(link, left, right, len(sets))
    return [(0, names, names, sums), (1, p, q, np.ones(len(p), np.int64)), (2, node[forest[:, 0]], node[forest[:, 1]], np.zeros(len(forest), np.int64))]


def _linked(rarity):
    """Links within a pair of blocks, or within each of several small groups (lo < 0): (kind, node, other, n).

    kind 0: n documents lie behind the node's links (it is named if there are
    none, too); 1: a link with a node that has ids with several sets; 2: a link
    of a spanning forest.
    """

    def run(key: tuple[pa.Scalar, ...], table: pa.Table) -> pa.Table:
        lo, hi = key[1].as_py(), key[2].as_py()
        part, node, block, docs, several = (table[c].to_numpy(zero_copy_only=False) for c in ("part", "node", "block", "docs", "several"))
        found = [(0, node[:0], node[:0], docs[:0])]
        if lo >= 0:
            left, right = np.flatnonzero(block == lo), np.flatnonzero(block == hi)
            if len(left) and len(right):
                found += _counted(node, docs, several, _expanded(table["z"], rarity), left, left if lo == hi else right)
        else:
            order = np.argsort(part, kind="stable")
            node, docs, several, part = node[order], docs[order], several[order], part[order]
            sets = _expanded(table["z"].take(pa.array(order)), rarity)
            edge = np.flatnonzero(np.concatenate([[True], part[1:] != part[:-1], [True]])).tolist()
            for u, v in zip(edge[:-1], edge[1:], strict=True):
                own = np.arange(v - u)
                found += _counted(node[u:v], docs[u:v], several[u:v], sets[u:v], own, own)
        kind = np.repeat(np.array([f[0] for f in found], np.int32), [len(f[1]) for f in found])
        trim()
        return pa.table({"kind": kind} | {name: np.concatenate([f[k] for f in found]) for k, name in ((1, "node"), (2, "other"), (3, "n"))})

    return run


def _meetings(block) -> Column:
    """Blocks of k to the pairs of blocks that they are in."""
    return F.explode(F.transform(F.sequence(F.lit(0), F.col("k") - 1), lambda j: F.struct(F.least(block, j).alias("lo"), F.greatest(block, j).alias("hi")))).alias("at")


def _documents(rows: DataFrame, scratch: Scratch) -> tuple[DataFrame, DataFrame]:
    """(node, docs): documents with that set alone; (doc_id, node) of ids that stand on rows with different sets."""
    at = F.coalesce("node", F.lit(0))
    kinds = scratch.keep(rows.filter("doc_id is not null").groupBy("doc_id").agg(F.min(at).alias("node"), F.max(at).alias("to")), "kinds")
    several = scratch.keep(rows.filter("node is not null").join(kinds.filter("node <> to").select("doc_id"), "doc_id").select("doc_id", "node").distinct(), "several")
    return kinds.filter("node = to and node <> 0").groupBy("node").agg(F.count("*").alias("docs")), several


def _links(classes: DataFrame, parts: DataFrame, docs: DataFrame, several: DataFrame, texts: DataFrame, scratch: Scratch, rarity) -> DataFrame:
    """All links within groups of candidates, as ``_linked`` tells them."""
    nodes = classes.select("node", "rep", "n").join(parts.withColumnRenamed("component", "part"), "node").join(docs, "node", "left").join(several.select("node", F.lit(True).alias("several")).distinct(), "node", "left")
    nodes = scratch.keep(nodes.select("node", "rep", "part", "n", F.coalesce("docs", F.lit(0).cast("long")).alias("docs"), F.coalesce("several", F.lit(False)).alias("several")), "nodes")
    # only texts of candidates move, compressed, and of each set one
    moved = texts.mapInArrow(frugal(_packed), "_id long, z binary").join(nodes.select(F.col("rep").alias("_id")).distinct(), "_id").select("z").mapInArrow(frugal(_held(rarity)), "node long, z binary")
    held = scratch.keep(moved.join(nodes.select("node"), "node").dropDuplicates(["node"]), "held")
    blocks = nodes.groupBy("part").agg(F.count("*").alias("m"), F.sum(F.col("n").cast("long")).alias("all"))
    blocks = scratch.keep(blocks.select("part", F.ceil(F.greatest(F.col("m") / BLOCK, F.col("all") / BLOCK_SHINGLES)).cast("int").alias("k"), "all"), "blocks")
    # groups of one block share tasks
    bins = max(1, (blocks.filter("k = 1").agg(F.sum("all")).first()[0] or 0) * 2 // BLOCK_SHINGLES)
    dealt = nodes.join(blocks.drop("all"), "part").join(held, "node")
    names = ["part", "node", "docs", "several", "block", "z"]
    small = dealt.filter("k = 1").withColumn("block", F.lit(0)).select(F.pmod(F.xxhash64("part"), F.lit(bins)).alias("group"), F.lit(-1).alias("lo"), F.lit(-1).alias("hi"), *names)
    large = dealt.filter("k > 1").withColumn("block", F.pmod(F.xxhash64("node"), F.col("k")).cast("int")).select(*names, _meetings(F.col("block"))).select(F.col("part").alias("group"), "at.lo", "at.hi", *names)
    return scratch.keep(small.unionByName(large).groupBy("group", "lo", "hi").applyInArrow(_linked(rarity), "kind int, node long, other long, n long"), "linked")


def _link_counts(found: DataFrame, docs: DataFrame, several: DataFrame, scratch: Scratch) -> tuple[DataFrame, DataFrame]:
    """(node, near): other documents linked, of documents with one set; (doc_id, more) of the others."""
    near = docs.select("node", F.col("docs").alias("n")).unionByName(found.filter("kind = 0").select("node", "n")).groupBy("node").agg(F.sum("n").alias("near"))
    # ids on several sets are counted apart, each once however many of its sets are linked
    around = found.filter("kind = 1").select("node", "other").unionByName(several.select("node", F.col("node").alias("other"))).distinct()
    around = scratch.keep(around, "around")
    behind = several.select(F.col("doc_id").alias("them"), F.col("node").alias("other"))
    extra = around.join(behind, "other").groupBy("node").agg(F.count_distinct("them").alias("extra"))
    near = near.join(extra, "node", "left").select("node", (F.col("near") + F.coalesce("extra", F.lit(0)) - 1).alias("near"))
    reached = scratch.keep(several.join(around, "node").select("doc_id", "other").distinct(), "reached")
    single = reached.join(docs.select(F.col("node").alias("other"), "docs"), "other", "left").groupBy("doc_id").agg(F.sum(F.coalesce("docs", F.lit(0))).alias("docs"))
    multiple = reached.join(behind, "other").groupBy("doc_id").agg(F.count_distinct("them").alias("ids"))
    return near, single.join(multiple, "doc_id").select("doc_id", (F.col("docs") + F.col("ids") - 1).alias("more"))


def _allowed(pairs: DataFrame, classes: DataFrame) -> DataFrame:
    """The pairs (a, b) that sizes and bitmaps allow."""
    side = lambda node, n, bits: classes.select(F.col("node").alias(node), F.col("n").alias(n), F.col("bits").alias(bits))
    sized = pairs.join(side("a", "m", "x"), "a").join(side("b", "n", "y"), "b")
    return sized.select("a", "b", "m", "n", "x", "y").mapInArrow(frugal(_possible), "a long, b long")


def _completed(shared: DataFrame, parts: DataFrame, classes: DataFrame, scratch: Scratch) -> DataFrame:
    """Candidates in different groups: (a, b)."""
    placed = shared.select("token", "node").join(parts, "node", "left").select("token", "node", F.coalesce("component", "node").alias("part"))
    placed = scratch.keep(placed, "placed")
    holders = (F.count("*").alias("size"), F.struct(F.min("node"), F.max("node"), F.sum(F.shiftright(F.xxhash64("node"), 32))).alias("who"))
    split = placed.groupBy("token").agg(F.min("part").alias("p"), F.max("part").alias("q"), *holders).filter("p <> q")
    split = scratch.keep(split.select("token", "size", "who"), "split")
    # shingles with the same holders are one, with their number
    once = split.groupBy("size", "who").agg(F.min("token").alias("token"), F.count("*").alias("times")).drop("who")
    once = scratch.keep(once, "once")
    still = placed.join(once.filter(F.col("size") <= GROUP).select("token", "times"), "token").join(classes.select("node", "n", "matches"), "node")
    left = still.select("token", "times", F.col("node").alias("a"), F.col("n").alias("m"), F.col("part").alias("o"), F.col("matches").alias("asked"))
    right = still.select(F.col("token").alias("_token"), F.col("node").alias("b"), "n", "part", "matches")
    alike = F.least("m", "n") * WHOLE >= F.greatest("m", "n") * PART
    met = left.join(right, (F.col("token") == F.col("_token")) & (F.col("a") < F.col("b")) & (F.col("o") != F.col("part")) & alike)
    # a pair that shares no shingle of many holders has all its shared ones counted here; any other is compared there
    pairs = met.groupBy("a", "b").agg(F.sum("times").alias("c"), F.min(F.least("asked", "matches")).alias("need")).filter("c >= need").select("a", "b")
    found = _allowed(pairs, classes)
    large = once.filter(F.col("size") > GROUP)
    if large.first() is None:
        return found
    large = large.select("token", F.ceil(F.col("size") / BLOCK).cast("int").alias("k"))
    rows = placed.join(large, "token").withColumn("block", F.pmod(F.xxhash64("node"), F.col("k")).cast("int"))
    rows = rows.select("token", "node", "part", "block", _meetings(F.col("block"))).join(classes.select("node", "n", "bits"), "node").select("token", "at.lo", "at.hi", "node", "part", "block", "n", "bits")
    return found.unionByName(rows.groupBy("token", "lo", "hi").applyInArrow(_across, "a long, b long"))


def jaccard_components(docs: DataFrame, id_col: str = "doc_id", text_col: str = "text") -> DataFrame:
    """One row per document: size of its set, class (smallest id with the same set), component, number of linked documents."""
    spark = docs.sparkSession
    scratch = Scratch(spark, "ngram")
    texts = docs.select(F.col(id_col).cast("long").alias("_id"), F.col(text_col).alias("_text"))
    total = max(1, docs.count())
    least = max(FREQUENT, total / SHARE)
    common = texts.select("_text").mapInArrow(frugal(_words), "token long, n long").groupBy("token").agg(F.sum("n").alias("n")).orderBy(F.col("n").desc(), "token").limit(WORDS).toPandas()
    rarity = spark.sparkContext.broadcast(Rarity(common["token"].to_numpy(np.int64).view(np.uint64), common["n"].to_numpy(float)))
    listed = texts.select("_text").mapInArrow(frugal(_frequencies(least / total, rarity)), "token long, n long").groupBy("token").agg(F.sum("n").alias("n")).filter(F.col("n") >= 0.75 * least).toPandas()
    values = listed["token"].to_numpy(np.int64).view(np.uint64)
    order = np.argsort(values)
    frequent = spark.sparkContext.broadcast((values[order], listed["n"].to_numpy(np.int64)[order]))
    rows = scratch.keep(texts.mapInArrow(frugal(_described(frequent, rarity)), "doc_id long, n int, node long, matches int, rare array<long>, common array<long>, bits binary"), "prefixes")

    # equal sets are one class; a task lists a class once, so few rows of a class are listed
    usable = rows.filter("node is not null and doc_id is not null")
    ids = usable.groupBy("node").agg(F.min("doc_id").alias("rep"))
    classes = scratch.keep(usable.filter("bits is not null").select("node", "n", "matches", "bits").dropDuplicates(["node"]).join(ids, "node"), "classes")
    lead = F.xxhash64("node", F.pmod("token", F.lit(LEADERS)))
    rare = usable.select(F.explode("rare").alias("token"), "node").repartition("token").select("token", lead.alias("h"), "node")
    rare = rare.sortWithinPartitions("token", "h", "node").mapInArrow(frugal(_grouped), "token long, node long, leader long")
    often = scratch.keep(usable.select(F.explode("common").alias("token"), "node").distinct(), "often")
    leaders = often.groupBy("token").agg(F.min(F.struct(lead.alias("h"), "node")).alias("l")).select("token", F.col("l.node").alias("leader"))
    shared = scratch.keep(rare.unionByName(often.join(leaders, "token").select("token", "node", "leader")), "shared")

    # holders with the leaders of their groups
    stars = shared.filter("node <> leader").groupBy(F.col("leader").alias("a"), F.col("node").alias("b")).agg(F.count("*").alias("c"))
    few = classes.filter("n < 10").select(F.col("node").alias("b"), F.lit(True).alias("few"))
    stars = stars.join(few, "b", "left").filter("c > 1 or few").select("a", "b")
    near = scratch.keep(_allowed(stars, classes), "stars")
    parts = scratch.keep(components(near, scratch), "stars-parts")
    # what these leave open: candidates in different groups
    more = scratch.keep(_completed(shared, parts, classes, scratch), "across")
    if more.first() is not None:
        parts = scratch.keep(components(near.unionByName(more), scratch), "parts")
    scratch.drop("shared", "often", "placed", "split", "once", "across", "stars")
    only, several = _documents(rows, scratch)
    found = _links(classes, parts, only, several, texts, scratch, rarity)
    near, extra = _link_counts(found, only, several, scratch)
    linked = components(found.filter("kind = 2").select(F.col("node").alias("a"), F.col("other").alias("b")), scratch)
    # components are named by nodes so far: their name is the smallest id
    named = classes.select("node", "rep").join(linked, "node", "left").select("node", "rep", F.coalesce("component", "node").alias("component"))
    least_id = named.groupBy("component").agg(F.min("rep").alias("component_id"))
    named = scratch.keep(named.join(least_id, "component").join(near, "node", "left").select("node", "rep", "component_id", "near"), "counts")
    member = rows.select("doc_id", "n", "node").join(named, "node", "left").select("doc_id", "n", "near", F.coalesce("rep", "doc_id").alias("class_id"), F.coalesce("component_id", "doc_id").alias("component_id"))
    # an id on several rows has several classes; they are one document
    same = several.join(named, "node").select(F.col("doc_id").alias("a"), F.col("component_id").alias("b")).filter("a <> b")
    if same.first() is not None:
        joined = components(same, Scratch(spark, "ngram-ids")).withColumnRenamed("component", "whole")
        member = member.join(joined, member["component_id"] == joined["node"], "left").drop("node").withColumn("component_id", F.coalesce("whole", "component_id"))
    member = member.join(scratch.keep(extra, "extra"), "doc_id", "left")
    known = lambda c: F.when(F.col("doc_id").isNotNull(), c)
    return member.select("doc_id", F.col("n").cast("long").alias("n_shingles"), known(F.col("component_id")).alias("component_id"), known(F.col("class_id")).alias("class_id"), known(F.coalesce("more", "near", F.lit(0))).cast("long").alias("n_links"))
