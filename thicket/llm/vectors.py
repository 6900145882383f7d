"""Vectors as codes: a codebook for each part position, searched through a vantage-point tree.

Components become integers (floor of `scale` times each), a vector is cut into equal consecutive parts, and a part's code is the index of
the nearest entry of its position's codebook. Codebooks start as the parts of the first vectors by vec_id and are
refined in rounds: every part goes to its nearest entry, each entry becomes the floor of its parts' mean.

The nearest entry is found in a tree over the entries of a position: a node holds a vantage entry and divides the others
by their distance from it into a near and a far half, each with the smallest and the largest of these distances. For all
vectors of a batch at once, branch and bound goes down the tree: a half is visited unless the triangle inequality shows that
all of it is further than the best entry so far. Distances of that test are square roots, so they are rounded to the safe side (`_ROOM`),
and equality is visited too; what decides is always the integer squared distance, ties going to the lower index. So the tree gives
what comparing with every entry gives.

Rounds are passes over a table of packed integers; a task sends on at most one row of sums for each position and entry,
and codebooks (parts x entries, whatever the number of vectors) are all that the driver holds.

Defined cases: rows are left out whose vector is null or holds null, infinite or NaN components. The dimension is that of the kept vector with the smallest
vec_id (null ones last; equal ones by their components); vectors of another dimension are left out too. A dimension that the
parts don't divide is filled up with zeros, which change no distance. With fewer kept vectors than entries the codebooks are
shorter. Rows that repeat a vec_id stay. Null labels are one label. Components so large that a distance could pass 64 bits raise an error instead
of giving a wrong code. Extra columns are dropped; an empty table gives an empty one.
"""

from __future__ import annotations

import hashlib
from dataclasses import dataclass

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from thicket.llm._store import discard, written
from thicket.session import ship

#: Relative room for the rounding of square roots and of their sums: some thousand times the error of a double.
_ROOM = 1e-12


@dataclass(frozen=True)
class CodeParams:
    parts: int = 8
    entries: int = 16
    rounds: int = 6
    scale: int = 4096


@dataclass
class Node:
    """A vantage entry, and the halves by distance from it as (node, smallest, largest distance)."""

    entry: int
    halves: list[tuple[Node, float, float]]


def squared(a: np.ndarray, b: np.ndarray) -> np.ndarray:
    d = a - b
    return np.einsum("...i,...i->...", d, d)


def vantage_tree(entries: np.ndarray, members: list[int] | None = None) -> Node | None:
    """The tree over a codebook's entries. A vantage point is the entry furthest from the first one of its members: far from the middle, so
    that distances from it differ."""
    members = list(range(len(entries))) if members is None else members
    if not members:
        return None
    far = squared(entries[members], entries[members[0]])
    vantage = members[int(np.argmax(far))]
    rest = [m for m in members if m != vantage]
    if not rest:
        return Node(vantage, [])
    d = squared(entries[rest], entries[vantage])
    order = np.argsort(d, kind="stable")
    cut = (len(rest) + 1) // 2
    halves = []
    for some in (order[:cut], order[cut:]):
        if len(some):
            low, high = float(np.sqrt(d[some[0]].astype(float))), float(np.sqrt(d[some[-1]].astype(float)))
            halves.append((vantage_tree(entries, [rest[k] for k in some]), low * (1 - _ROOM), high * (1 + _ROOM)))
    return Node(vantage, halves)


def nearest(points: np.ndarray, entries: np.ndarray, tree: Node | None) -> tuple[np.ndarray, np.ndarray, int]:
    """(index, squared distance) of the nearest entry of each point, and how many distances were computed."""
    best = np.full(len(points), np.iinfo(np.int64).max)
    index = np.full(len(points), len(entries), np.int64)
    computed = 0

    def visit(node: Node, rows: np.ndarray) -> None:
        nonlocal computed
        if not len(rows):
            return
        d = squared(points[rows], entries[node.entry])
        computed += len(rows)
        better = (d < best[rows]) | ((d == best[rows]) & (node.entry < index[rows]))
        best[rows[better]], index[rows[better]] = d[better], node.entry
        if not node.halves:
            return
        away = np.sqrt(d.astype(float))

        def below(which: int, some: np.ndarray) -> None:
            """Visits a half for the rows (positions in `rows`) that it may hold something as near for."""
            child, low, high = node.halves[which]
            least = np.maximum(away[some] * (1 - _ROOM) - high, low - away[some] * (1 + _ROOM))
            visit(child, rows[some[least <= np.sqrt(best[rows[some]].astype(float)) * (1 + _ROOM)]])

        everywhere = np.arange(len(rows))
        if len(node.halves) == 1:
            below(0, everywhere)
            return
        middle = (node.halves[0][2] + node.halves[1][1]) / 2
        near, far = everywhere[away <= middle], everywhere[away > middle]
        below(0, near)
        below(1, far)
        below(1, near)
        below(0, far)

    if tree is not None:
        visit(tree, np.arange(len(points)))
    return index, best, computed


@dataclass
class Codebooks:
    """Integer entries: (parts, entries, components of a part)."""

    entries: np.ndarray

    def trees(self) -> list[Node | None]:
        return [vantage_tree(e) for e in self.entries]

    def digest(self) -> str:
        return hashlib.sha256(",".join(map(str, self.entries.ravel().tolist())).encode()).hexdigest()


def _kept(vectors: DataFrame, p: CodeParams) -> DataFrame:
    """vec_id, label and v (components as integers) of the rows that can be coded, whatever their dimension."""
    x = F.col("embedding").cast("array<double>")
    finite = ~F.exists(x, lambda c: c.isNull() | F.isnan(c) | (F.abs(c) == float("inf")))
    scaled = F.transform(x, lambda c: F.floor(c * p.scale).cast("decimal(38,0)"))
    rows = vectors.select(F.col("vec_id").cast("bigint").alias("vec_id"), F.col("label").cast("bigint").alias("label"), F.when(finite, scaled).alias("v"))
    return rows.where("v is not null")


def packed(vectors: DataFrame, p: CodeParams = CodeParams()) -> tuple[DataFrame, np.ndarray]:
    """A written table (vec_id, label, v: packed 64-bit integers) of the vectors to code, and the first codebooks."""
    kept = _kept(vectors, p)
    first = kept.orderBy(F.col("vec_id").asc_nulls_last(), "v").limit(1).collect()
    size = len(first[0].v) if first else 0
    kept = kept.where(F.size("v") == size)
    wide = -(-size // p.parts) * p.parts
    limit = int((2**63 - 1) // max(1, wide)) ** 0.5 // 2
    too_large = F.exists("v", lambda c: F.abs(c) >= int(limit))
    v = F.when(too_large, F.raise_error(F.lit("components are too large for 64-bit distances")).cast("array<bigint>")).otherwise(F.col("v").cast("array<bigint>"))
    kept = kept.withColumn("v", F.concat(v, F.array_repeat(F.lit(0).cast("bigint"), wide - size)))
    seeds = kept.orderBy(F.col("vec_id").asc_nulls_last(), "v").limit(p.entries).collect()
    start = np.array([r.v for r in seeds], np.int64).reshape(len(seeds), p.parts, wide // p.parts).transpose(1, 0, 2)

    def pack(batches):
        for b in batches:
            flat = b.column("v").flatten().to_numpy(zero_copy_only=False).astype("<i8")
            rows = [x.tobytes() for x in flat.reshape(b.num_rows, wide)]
            yield pa.RecordBatch.from_arrays([b.column("vec_id"), b.column("label"), pa.array(rows, pa.binary())], names=["vec_id", "label", "v"])

    return written(kept.mapInArrow(pack, "vec_id bigint, label bigint, v binary"), "vectors"), start


def _matrix(batch: pa.RecordBatch, parts: int) -> np.ndarray:
    """(rows, parts, components) of a batch of packed vectors."""
    data = b"".join(batch.column("v").to_pylist())
    return np.frombuffer(data, "<i8").reshape(batch.num_rows, parts, -1)


def _round(table: DataFrame, books: Codebooks) -> Codebooks:
    """Each entry as the floor of the mean of the parts nearest to it."""
    parts, n, width = books.entries.shape
    entries, trees = books.entries, books.trees()

    def sums(batches):
        total, count = np.zeros((parts, n, width), np.int64), np.zeros((parts, n), np.int64)
        bound = 0
        for b in batches:
            x = _matrix(b, parts)
            bound += b.num_rows * (int(np.abs(x).max(initial=0)) + 1)
            if bound >= 2**62:  # a task's sums stay exact: what is there goes out first
                yield out(total, count)
                total[:], count[:], bound = 0, 0, b.num_rows * (int(np.abs(x).max(initial=0)) + 1)
            for k in range(parts):
                index, _, _ = nearest(x[:, k], entries[k], trees[k])
                np.add.at(total[k], index, x[:, k])
                count[k] += np.bincount(index, minlength=n)
        yield out(total, count)

    def out(total, count):
        at = np.argwhere(count > 0)
        return pa.RecordBatch.from_arrays(
            [pa.array(at[:, 0], pa.int32()), pa.array(at[:, 1], pa.int32()), pa.array(count[count > 0], pa.int64()), pa.array(total[count > 0].tolist(), pa.list_(pa.int64()))],
            names=["part", "entry", "n", "total"],
        )

    partial = table.mapInArrow(sums, "part int, entry int, n bigint, total array<bigint>")
    wide = [F.sum(F.element_at("total", k + 1).cast("decimal(38,0)")).alias(f"t{k}") for k in range(width)]
    new = entries.copy()
    for r in partial.groupBy("part", "entry").agg(F.sum("n").alias("n"), *wide).collect():  # at most parts x entries rows
        new[r.part, r.entry] = [int(r[f"t{k}"]) // r.n for k in range(width)]
    return Codebooks(new)


def trained(vectors: DataFrame, p: CodeParams = CodeParams()) -> tuple[DataFrame, Codebooks]:
    """The packed table and the codebooks after all rounds."""
    ship(vectors.sparkSession)
    table, start = packed(vectors, p)
    books = Codebooks(start)
    if start.size:
        for _ in range(p.rounds):
            books = _round(table, books)
    return table, books


def encoded(table: DataFrame, books: Codebooks) -> DataFrame:
    """vec_id, label, code and error of every packed vector."""
    parts, entries, trees = len(books.entries), books.entries, books.trees()

    def run(batches):
        for b in batches:
            x = _matrix(b, parts)
            codes, errors = np.zeros((b.num_rows, parts), np.uint8), np.zeros(b.num_rows, np.int64)
            for k in range(parts):
                index, d, _ = nearest(x[:, k], entries[k], trees[k])
                codes[:, k] = index
                errors += d
            yield pa.RecordBatch.from_arrays([b.column("vec_id"), b.column("label"), pa.array([c.tobytes().hex() for c in codes]), pa.array(errors)], names=["vec_id", "label", "code", "error"])

    return table.mapInArrow(run, "vec_id bigint, label bigint, code string, error bigint")


def decoded(codes: DataFrame, books: Codebooks, scale: int = 4096) -> DataFrame:
    """vec_id and the vector that a code stands for, as array<double>."""
    entries = books.entries

    def run(batches):
        for b in batches:
            index = [np.frombuffer(bytes.fromhex(c), np.uint8) for c in b.column("code").to_pylist()]
            rows = [np.concatenate([entries[k, i] for k, i in enumerate(row)]) / scale for row in index]
            yield pa.RecordBatch.from_arrays([b.column("vec_id"), pa.array([r.tolist() for r in rows], pa.list_(pa.float64()))], names=["vec_id", "embedding"])

    return codes.select("vec_id", "code").mapInArrow(run, "vec_id bigint, embedding array<double>")


def op13_vector_codes(spark, sf_dir: str) -> DataFrame:
    table, books = trained(spark.read.parquet(f"{sf_dir}/embeddings.parquet"))
    rows = written(encoded(table, books), "codes")
    discard(table)
    sums = rows.groupBy(F.col("label").alias("of")).agg(F.sum("error").alias("label_error"))
    out = rows.join(sums, F.col("label").eqNullSafe(F.col("of")))
    return out.select("vec_id", "code", "error", "label_error", F.lit(books.digest()).alias("codebooks_sha256"))


def oracle_sql(p: CodeParams = CodeParams()) -> str:
    """The same in SQL: every part is compared with every entry, a common table a round."""
    steps = [
        f"""k as (select vec_id, label, list_transform(embedding, lambda c: floor({p.scale} * c::double)::bigint) as v from embeddings
        where embedding is not null and len(list_filter(embedding, lambda c: c is null or not isfinite(c))) = 0),
        r as (select row_number() over (order by vec_id) as row_no, vec_id, label, v, len(v) // {p.parts} as w from k),
        x as materialized (select row_no, part, list_slice(v, part * w + 1, (part + 1) * w) as v from r, (select unnest(range({p.parts})) as part)),
        b0 as materialized (select part, (row_no - 1)::int as entry, v from x where row_no <= {p.entries})"""
    ]
    for k in range(p.rounds + 1):
        steps.append(
            f"""d{k} as (select row_no, x.part, entry, x.v, list_sum(list_transform(list_zip(x.v, b.v), lambda z: (z[1] - z[2]) * (z[1] - z[2])))::bigint as d from x join b{k} b using (part)),
        a{k} as materialized (select row_no, part, arg_min(entry, d * {p.entries} + entry) as entry, min(d) as d, any_value(v) as v from d{k} group by row_no, part)"""
        )
        if k < p.rounds:
            steps.append(
                f"""m{k} as (select part, entry, pos, sum(c)::bigint as s, count(*) as n from (select part, entry, unnest(v) as c, unnest(range(len(v))) as pos from a{k}) group by all),
        f{k} as (select part, entry, list((s - ((s % n) + n) % n) // n order by pos) as v from m{k} group by part, entry),
        b{k + 1} as materialized (select part, entry, coalesce(f.v, b.v) as v from b{k} b left join f{k} f using (part, entry))"""
            )
    last = p.rounds
    steps.append(f"e as (select row_no, string_agg(printf('%02x', entry), '' order by part) as code, sum(d)::bigint as error from a{last} group by row_no)")
    steps.append(f"h as (select sha256(string_agg(array_to_string(v, ','), ',' order by part, entry)) as codebooks_sha256 from b{last})")
    return f"with {', '.join(steps)} select vec_id, code, error, (sum(error) over (partition by label))::bigint as label_error, codebooks_sha256 from e join r using (row_no), h"


ORACLE_SQL = oracle_sql()
