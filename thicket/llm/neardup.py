"""Near-duplicate detection by BagMinHash.

A document is the multiset of its five-word shingles (words of non-space characters, A-Z lower-cased;
a document of one to four words is one shingle). Two documents are linked when the weighted Jaccard
similarity of their multisets is `threshold` (0.8) or more; groups are the connected components.

1. One pass over the texts gives each row a 128-bit key of its words and a BagMinHash signature cut into bands. Rows with
   equal words are one class; only one row of it goes on. The pass and the class table are written to the shared folder.
2. Classes that share a band are compared with the band's smallest one: as many pairs as members.
   Every candidate pair is verified on the exact multisets of the whole texts; verified links become components.
3. Bands that still hold different components go to one task each, as rows sorted by band: each member outside the band's
   largest component is compared exactly with all members. A band that is larger than a block is dealt into blocks, and
   each pair of blocks is a group, but for pairs within one component. So a band of any size is fully examined, a
   task holds two blocks, no cap is set, and copies that are linked already cost nothing.

BagMinHash: an element with weight w throws points of a Poisson process over the weight axis (0, w],
each with an arrival time and a signature slot; a slot keeps its earliest arrival, so two signatures agree in a
slot with the probability of the weighted Jaccard similarity. The weight axis is discretised in units
and split hierarchically: (0,1], (1,2], (2,4], (4,8], ... each have a process of their own, and a process
that reaches above w is thinned by halving. Arrivals come in order, so an element is dropped as
soon as its next arrival is later than all slots of its document.

The joins are merge joins at every size: their plans don't change where a side outgrows the broadcast threshold.

Defined cases: classes are told by the words alone, so a null doc_id is a document like others (class_id and group_id are null where all
are), and rows that share a doc_id but not the text are different documents; rows without words are alone; repeated rows are in
one class, and each of them is marked as kept or not like the other; the smallest doc_id represents a class and a group, the
smaller key of the words where two have it; extra columns are dropped by `clusters`; empty tables give empty ones. With the
defaults a pair at 0.8 shares a band with probability 0.99994, at 0.9 above 0.999999999.
"""

from __future__ import annotations

from dataclasses import dataclass

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

from thicket.llm import _words as W
from thicket.llm._store import discard, written
from thicket.llm.graph import components
from thicket.session import ship

U64 = np.uint64


@dataclass(frozen=True)
class NearDupParams:
    shingle: int = 5
    threshold: float = 0.8
    bands: int = 32
    rows: int = 6
    #: Bytes of text (and 512 a member) in a block of an undecided band; a task holds two blocks at a time.
    block_bytes: int = 4 << 20

    @property
    def slots(self) -> int:
        return self.bands * self.rows


def row_keys(first: np.ndarray, h: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    """Two independent hashes of each row's words in order."""
    power, inverse = W._powers(len(h) + 1)
    n = np.diff(first).astype(U64)
    keys = []
    for salt in (0x5851F42D4C957F2D, 0x14057B7EF767814F):
        sums = np.zeros(len(h) + 1, U64)
        np.cumsum(W.mix(h ^ U64(salt)) * power[: len(h)], out=sums[1:])
        keys.append(W.mix((sums[first[1:]] - sums[first[:-1]]) * inverse[first[:-1]] ^ W.mix(n + U64(salt))))
    return keys[0], keys[1]


def shingle_bags(texts: pa.Array, k: int):
    """Multisets of shingles: (row, 52-bit shingle, weight) sorted by both; shingles of each row; the rows' keys."""
    raw, offs = W.text_bytes(texts)
    first, h = W.split_words(raw, offs, W.IS_TOKEN, W.LOWER)
    words = np.diff(first)
    keys = row_keys(first, h)
    at = W.window_rows(first, k)
    rows = np.searchsorted(first, at, "right") - 1
    short = np.flatnonzero((words > 0) & (words < k))
    row = np.concatenate([rows, short]).astype(U64)
    shingle = np.concatenate([W.windows(h, k)[at], keys[0][short]]) >> U64(12)
    assert len(words) <= 4096
    both = np.sort((row << U64(52)) | shingle)
    new = np.flatnonzero(np.concatenate([[True], both[1:] != both[:-1]])) if len(both) else np.zeros(0, np.int64)
    weight = np.diff(np.append(new, len(both)))
    both = both[new]
    return both, weight, np.bincount(row.astype(np.int64), minlength=len(words)), keys


def signatures(both: np.ndarray, weight: np.ndarray, n_rows: int, m: int) -> np.ndarray:
    """BagMinHash signatures (rows, m): the earliest arrival in each slot; infinity for rows without elements."""
    row, ident = (both >> U64(52)).astype(np.int64), both & U64((1 << 52) - 1)
    rows, seeds, low, length, limit = [row], [W.mix(ident)], [np.zeros(len(row))], [np.ones(len(row))], [weight]
    level = 1
    while len(weight) and (1 << (level - 1)) < weight.max():
        has = weight > (1 << (level - 1))
        rows.append(row[has])
        seeds.append(W.mix(ident[has] ^ U64(level << 56)))
        low.append(np.full(int(has.sum()), float(1 << (level - 1))))
        length.append(low[-1])
        limit.append(weight[has])
        level += 1
    r, seed, lo, ln, lim = (np.concatenate(v) for v in (rows, seeds, low, length, limit))
    partial = lo + ln > lim
    sig = np.full(n_rows * m, np.inf)
    latest = np.full(n_rows, np.inf)
    x = np.zeros(len(r))
    step, t = 1 / (m * ln), 0
    while len(r):
        t += 1
        u = W.mix(seed + U64(t * 0x9E3779B97F4A7C15 % (1 << 64)))
        x = x - np.log(((u >> U64(11)).astype(np.float64) + 0.5) * 2.0**-53) * step
        live = x < latest[r]
        if not live.all():
            r, seed, lo, ln, lim, partial, x, step, u = (v[live] for v in (r, seed, lo, ln, lim, partial, x, step, u))
        v = W.mix(u ^ U64(0xA0761D6478BD642F))
        slot = ((v >> U64(32)) * U64(m)) >> U64(32)
        at = r * m + slot.astype(np.int64)
        if partial.any():  # halving the interval until the point's side is settled = the bits of its place in it
            place = lo + (v & U64(0xFFFFFFFF)).astype(np.float64) * 2.0**-32 * ln
            inside = place < lim
            np.minimum.at(sig, at[inside], x[inside])
        else:
            np.minimum.at(sig, at, x)
        touched = np.zeros(n_rows, bool)
        touched[r] = True
        touched = np.flatnonzero(touched)
        latest[touched] = sig.reshape(n_rows, m)[touched].max(axis=1)
    return sig.reshape(n_rows, m)


def _sketch(p: NearDupParams):
    def run(batches):
        for batch in batches:
            for part in W.slices(batch, 2 << 20):
                for at in range(0, part.num_rows, 2048):
                    rows = part.slice(at, 2048)
                    both, weight, count, (k1, k2) = shingle_bags(rows.column("text"), p.shingle)
                    bits = signatures(both, weight, rows.num_rows, p.slots).view(U64) >> U64(12)  # not the last bits of a logarithm
                    bands = np.zeros((rows.num_rows, p.bands), U64)
                    for j in range(p.rows):
                        bands = W.mix(bands ^ bits[:, j :: p.rows])
                    bands = W.mix(bands + np.arange(p.bands, dtype=U64)[None, :])
                    empty = count == 0
                    offsets = np.concatenate([[0], np.cumsum(np.where(empty, 0, p.bands))]).astype(np.int32)
                    yield pa.RecordBatch.from_arrays(
                        [rows.column("doc_id"), rows.column("h"), pa.array(k1.view(np.int64)), pa.array(k2.view(np.int64)), pa.array(count, pa.int64()), pa.ListArray.from_arrays(pa.array(offsets), pa.array(bands[~empty].ravel().view(np.int64)))],
                        names=["doc_id", "h", "k1", "k2", "n", "bands"],
                    )

    return run


def similar(a: pa.Array, b: pa.Array, k: int, threshold: float) -> np.ndarray:
    """Whether the multisets of shingles of a[i] and b[i] reach the threshold, exactly."""
    x, wx, nx, _ = shingle_bags(a, k)
    y, wy, ny, _ = shingle_bags(b, k)
    at = np.searchsorted(y, x)
    at[at == len(y)] = 0
    same = (y[at] == x) if len(y) else np.zeros(len(x), bool)
    shared = np.bincount((x[same] >> U64(52)).astype(np.int64), np.minimum(wx[same], wy[at[same]]), len(nx)) if same.any() else np.zeros(len(nx))
    return (shared > 0) & (shared >= threshold * (nx + ny - shared) - 1e-9)


def _verify(p: NearDupParams):
    def run(batches):
        for batch in batches:
            for half in W.slices(batch, 1 << 20, "ta"):
                for part in W.slices(half, 1 << 20, "tb"):
                    ok = similar(part.column("ta"), part.column("tb"), p.shingle, p.threshold)
                    yield pa.RecordBatch.from_arrays([part.column("a").filter(pa.array(ok)), part.column("b").filter(pa.array(ok))], names=["a", "b"])

    return run


def _verified(pairs: DataFrame, texts: DataFrame, p: NearDupParams) -> DataFrame:
    """The pairs (a, b) whose texts are similar."""
    left, right = texts.select(F.col("node").alias("a"), F.col("text").alias("ta")), texts.select(F.col("node").alias("b"), F.col("text").alias("tb"))
    return written(pairs.hint("merge").join(right, "b").join(left.hint("merge"), "a").select("a", "b", "ta", "tb").mapInArrow(_verify(p), "a bigint, b bigint"), "verified")


def cross_links(comp: np.ndarray, row: np.ndarray, shingle: np.ndarray, weight: np.ndarray, n: np.ndarray, threshold: float) -> list[tuple[int, int]]:
    """Links that join different components among the rows of one group, exactly.

    (row, shingle, weight): the rows' multisets, by row; n: their sizes. Every row outside the largest component is compared
    with all rows at once; a row that has come to the largest component is done, as the others are compared with it.
    So pairs that stay in different components were all compared.
    """
    comp = comp.copy()
    names, size = np.unique(comp, return_counts=True)
    largest = names[np.argmax(size)]
    first = np.searchsorted(row, np.arange(len(comp) + 1))
    shared_by, word = np.unique(shingle, return_inverse=True)
    dense = np.zeros(len(shared_by), np.int64)
    out = []
    for k in np.flatnonzero(comp != largest).tolist():
        if comp[k] == largest:
            continue
        mine = slice(first[k], first[k + 1])
        dense[word[mine]] = weight[mine]
        common = np.bincount(row, np.minimum(weight, dense[word]), len(comp))
        dense[word[mine]] = 0
        ok = np.flatnonzero((comp != comp[k]) & (common > 0) & (common >= threshold * (n + n[k] - common) - 1e-9))
        for j in ok.tolist():
            if comp[j] != comp[k]:
                out.append((k, j))
                keep, gone = (comp[k], comp[j]) if comp[k] == largest else (comp[j], comp[k])
                comp[comp == gone] = keep
    return out


def _compare(p: NearDupParams):
    """Rows (grp, node, comp, text), sorted by group: links between the different components of each group. A batch's texts are
    cut into shingles at once; what is held is one group, whose size is bounded."""

    def run(batches):
        held: list[tuple] = []  # the group that is not complete: (nodes, comps, row, shingle, weight, n)
        current = None

        def done():
            nodes, comps, rows, shingles, weights, ns = zip(*held, strict=True)
            at = np.concatenate([[0], np.cumsum([len(x) for x in nodes])])
            row = np.concatenate([r + a for r, a in zip(rows, at[:-1], strict=True)])
            node = np.concatenate(nodes)
            found = cross_links(np.concatenate(comps), row, np.concatenate(shingles), np.concatenate(weights), np.concatenate(ns), p.threshold)
            return [(node[i], node[j]) for i, j in found]

        for batch in batches:
            links = []
            for part in W.slices(batch, 1 << 20):
                group, node, comp = (part.column(c).to_numpy() for c in ("grp", "node", "comp"))
                both, weight, n, _ = shingle_bags(part.column("text"), p.shingle)
                row, shingle = (both >> U64(52)).astype(np.int64), both & U64((1 << 52) - 1)
                cut = np.flatnonzero(np.concatenate([[True], group[1:] != group[:-1]]))
                for lo, hi in zip(cut.tolist(), [*cut[1:].tolist(), len(group)], strict=True):
                    if held and group[lo] != current:
                        links += done()
                        held = []
                    current = group[lo]
                    a, b = np.searchsorted(row, (lo, hi))
                    held.append((node[lo:hi], comp[lo:hi], row[a:b] - lo, shingle[a:b], weight[a:b], n[lo:hi]))
            yield _pairs(links)
        if held:
            yield _pairs(done())

    return run


def _pairs(links: list[tuple[int, int]]) -> pa.RecordBatch:
    a, b = (np.array([x[k] for x in links], np.int64) for k in (0, 1))
    return pa.RecordBatch.from_arrays([pa.array(a), pa.array(b)], names=["a", "b"])


def _undecided(bands: DataFrame, labels: DataFrame, texts: DataFrame, p: NearDupParams) -> DataFrame:
    """(node, comp, grp) of the bands of more than two members that hold different components: a group for each band, or for
    each pair of its blocks where a band is larger than a block."""
    size = texts.select("node", (F.octet_length("text") + 512).cast("bigint").alias("size"))
    placed = bands.join(size.hint("merge"), "node").join(labels.hint("merge"), "node", "left").select("node", "bh", F.coalesce("label", "node").alias("comp"), "size")
    placed = written(placed, "placed")
    mixed = placed.groupBy("bh").agg(F.count("*").alias("c"), F.min("comp").alias("lo"), F.max("comp").alias("hi"), F.sum("size").alias("total"))
    mixed = written(mixed.where("lo <> hi and c > 2").select("bh", "total"), "mixed")
    open_ = placed.join(mixed.hint("merge"), "bh")
    out = open_.where(F.col("total") <= p.block_bytes).select("node", "comp", F.xxhash64("bh").alias("grp"))
    large = mixed.where(F.col("total") > p.block_bytes)
    return out if large.isEmpty() else out.unionByName(_blocks(placed.join(large.hint("merge"), "bh"), p))


def _blocks(open_: DataFrame, p: NearDupParams) -> DataFrame:
    """(node, comp, grp): members of large bands in blocks of about block_bytes, a group for each pair of blocks. A component
    that fills a block owns blocks, which aren't compared with each other; the others' members are pooled (owner -1)."""
    open_ = written(open_.drop("total"), "large")
    owner = F.when(F.sum("size") >= p.block_bytes, F.col("comp")).otherwise(F.lit(None))
    sizes = written(open_.groupBy("bh", "comp").agg(F.sum("size").alias("w"), owner.alias("owner")), "sizes")
    owners = sizes.groupBy("bh", "owner").agg(F.ceil(F.sum("w") / p.block_bytes).cast("int").alias("nblk"))
    one = Window.partitionBy("bh")
    before = F.coalesce(F.sum("nblk").over(one.orderBy("owner").rowsBetween(Window.unboundedPreceding, -1)), F.lit(0))
    owners = owners.select("bh", "owner", "nblk", before.alias("before"), F.sum("nblk").over(one).alias("every"))
    same = F.col("x.bh").eqNullSafe(F.col("y.bh")) & F.col("x.owner").eqNullSafe(F.col("y.owner"))
    places = written(sizes.alias("x").join(owners.alias("y").hint("merge"), same).select("x.bh", "comp", "x.owner", "nblk", "before", "every"), "places")
    blk = F.col("before") + F.pmod(F.xxhash64("node", "bh"), F.col("nblk"))
    dealt = open_.join(places.hint("merge"), ["bh", "comp"]).withColumn("blk", blk).withColumn("other", F.explode(F.sequence(F.lit(0).cast("bigint"), F.col("every") - 1)))
    own = F.col("owner").isNotNull() & (F.col("other") >= F.col("before")) & (F.col("other") < F.col("before") + F.col("nblk"))
    return dealt.where(~own).select("node", "comp", F.xxhash64("bh", F.least("blk", "other"), F.greatest("blk", "other")).alias("grp"))


def _classes(sketch: DataFrame) -> DataFrame:
    """A row for each distinct sequence of words: k1, k2, its first row (smallest doc_id, nulls last) and its bands."""
    first = F.min(F.struct(F.col("doc_id").isNull().alias("none"), "doc_id", "h"))
    # a table of its own, so that joins with it are between two plain shuffles, and a key with very many copies can be split
    return written(sketch.where("n > 0").groupBy("k1", "k2").agg(first.alias("f"), F.any_value("bands").alias("bands")).select("k1", "k2", F.struct("f.doc_id", "f.h").alias("row"), "bands"), "classes")


def _links(named: DataFrame, classes: DataFrame, p: NearDupParams) -> DataFrame:
    """(node, label): the components of similar classes; node: k1 of a class."""
    spread = classes.select(F.col("k1").alias("node"), F.explode("bands").alias("bh"))
    shared = written(spread.groupBy("bh").agg(F.count("*").alias("c"), F.min("node").alias("hub")).where("c > 1").select("bh", "hub"), "shared")
    bands = written(spread.join(shared.hint("merge"), "bh").select("node", "bh", "hub"), "bands")
    wanted = classes.select(F.col("k1").alias("node"), "row").join(bands.select("node").hint("merge"), "node", "left_semi")
    # the one time that texts are shuffled by row
    texts = written(named.select(F.struct("doc_id", "h").alias("row"), "text").join(wanted.hint("merge"), "row").dropDuplicates(["row"]).select("node", "text"), "texts")
    stars = bands.where("node <> hub").select(F.col("hub").alias("a"), F.col("node").alias("b")).distinct()
    labels = components(_verified(stars, texts, p))
    groups = _undecided(bands, labels, texts, p).join(texts.hint("merge"), "node").repartition("grp").sortWithinPartitions("grp")
    more = written(groups.select("grp", "node", "comp", "text").mapInArrow(_compare(p), "a bigint, b bigint"), "more")
    labels = components(labels.where("node <> label").select(F.col("node").alias("a"), F.col("label").alias("b")).unionByName(more))
    discard(shared, bands, texts)
    return labels


def _grouped(docs: DataFrame, p: NearDupParams) -> DataFrame:
    """doc_id, h (of the text), class_id, group_id, kept."""
    ship(docs.sparkSession)
    named = docs.select(F.col("doc_id").cast("bigint").alias("doc_id"), F.col("text").cast("string").alias("text")).withColumn("h", F.xxhash64("text"))
    sketch = written(named.mapInArrow(_sketch(p), "doc_id bigint, h bigint, k1 bigint, k2 bigint, n bigint, bands array<bigint>"), "sketch")
    classes = _classes(sketch)
    labels = _links(named, classes, p)
    linked = classes.select(F.col("k1").alias("node"), "row").join(labels.hint("merge"), "node")
    first = F.min(F.struct(F.col("row.doc_id").isNull().alias("none"), F.col("row.doc_id").alias("doc_id"), "node"))
    heads = linked.groupBy("label").agg(first.alias("f")).select("label", F.col("f.doc_id").alias("head_id"), F.col("f.node").alias("head"))
    heads = labels.join(heads.hint("merge"), "label").select(F.col("node").alias("k1"), "head_id", "head")
    own = classes.select("k1", "k2", F.col("row.doc_id").alias("class_id")).join(heads.hint("merge"), "k1", "left")
    own = written(own.select("k1", "k2", "class_id", F.when(F.col("head").isNull(), F.col("class_id")).otherwise(F.col("head_id")).alias("group_id"), F.coalesce("head", "k1").alias("head")), "groups")
    kept = F.col("doc_id").eqNullSafe(F.col("group_id")) & (F.col("k1") == F.col("head"))
    out = sketch.where("n > 0").select("doc_id", "h", "k1", "k2").join(own, ["k1", "k2"]).select("doc_id", "h", "class_id", "group_id", kept.alias("kept"))
    alone = sketch.where("n = 0").select("doc_id", "h", F.col("doc_id").alias("class_id"), F.col("doc_id").alias("group_id"), F.lit(True).alias("kept"))
    discard(classes)
    return out.unionByName(alone)


def clusters(docs: DataFrame, p: NearDupParams = NearDupParams()) -> DataFrame:
    """A row for each row of docs: doc_id, class_id (smallest doc_id with the same words), group_id (smallest of the group), and
    whether the row is the one that represents its group."""
    return _grouped(docs, p).drop("h")


def without_near_duplicates(docs: DataFrame, p: NearDupParams = NearDupParams()) -> DataFrame:
    """The rows of docs with one document of each group; of rows with equal doc_id and text one stays."""
    row = "_row"
    while row in docs.columns:
        row += "_"
    kept = _grouped(docs, p).where("kept").select(F.struct("doc_id", "h").alias(row))
    rows = docs.withColumn(row, F.struct(F.col("doc_id").cast("bigint").alias("doc_id"), F.xxhash64(F.col("text").cast("string")).alias("h")))
    return rows.join(kept, row, "left_semi").dropDuplicates([row]).drop(row)


def op3_near_duplicates(spark, sf_dir: str) -> DataFrame:
    return clusters(spark.read.parquet(f"{sf_dir}/documents.parquet"))
