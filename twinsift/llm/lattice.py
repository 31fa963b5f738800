"""Embedding near-duplicates by lattice hashing.

Vectors are projected at random to pairs of eight dimensions and decoded to points of the E8
lattice; a table's cell is a pair of points. Every vector stands in its own cell of each table
and looks into the neighbouring cells nearest to it; meetings are verified by cosine in
double precision.
"""

from __future__ import annotations

from collections.abc import Iterator
from itertools import combinations, product

import numpy as np
import pyarrow as pa
import pyarrow.compute as pc
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from .common import written
from .graph import connected_components

COSINE = 0.95
TABLES = 8
#: Neighbouring points that are probed in each half of a cell.
PROBES = 4
#: Projected length of a unit vector's component, in units in which lattice points are sqrt(2) apart.
SCALE = 0.6
#: Vectors of one cell that a task compares at once.
BLOCK = 1024
SEED = 20240229


def minimal_vectors() -> np.ndarray:
    """The 240 shortest vectors of E8: two whole steps of one, or eight halves with an even number of minus signs."""
    out = []
    for i, j in combinations(range(8), 2):
        for a, b in product((1.0, -1.0), repeat=2):
            v = [0.0] * 8
            v[i], v[j] = a, b
            out.append(v)
    out += [[s / 2 for s in signs] for signs in product((1.0, -1.0), repeat=8) if signs.count(-1.0) % 2 == 0]
    return np.array(out)


def _even(x: np.ndarray) -> np.ndarray:
    """The nearest points whose whole coordinates add up to an even number."""
    near = np.rint(x)
    off = x - near
    odd = np.flatnonzero(near.sum(axis=1).astype(np.int64) & 1)
    worst = np.abs(off[odd]).argmax(axis=1)
    near[odd, worst] += np.where(off[odd, worst] >= 0, 1.0, -1.0)
    return near


def decode(x: np.ndarray) -> np.ndarray:
    """The nearest E8 points: the nearer of the nearest whole and the nearest half points."""
    whole, half = _even(x), _even(x - 0.5) + 0.5
    nearer = ((x - half) ** 2).sum(axis=1) < ((x - whole) ** 2).sum(axis=1)
    return np.where(nearer[:, None], half, whole)


class Cells:
    """The cells of unit vectors of one dimension: own (rows x tables) and probed (rows x tables x 2 probes)."""

    def __init__(self, dimension: int, tables: int = TABLES, probes: int = PROBES, scale: float = SCALE, seed: int = SEED):
        draw = np.random.Generator(np.random.PCG64(seed))
        self.tables, self.probes = tables, probes
        self.project = draw.normal(size=(dimension, tables * 16)) * scale
        self.shift = draw.uniform(size=tables * 16)
        self.odd = draw.integers(0, 1 << 63, size=(tables, 16), dtype=np.uint64) * 2 + 1
        self.steps = minimal_vectors()

    def __call__(self, units: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
        n = len(units)
        x = units @ self.project + self.shift
        own = np.empty((n, self.tables), np.uint64)
        probed = np.empty((n, self.tables, 2 * self.probes), np.uint64)
        twice = (2 * self.steps).astype(np.int64).view(np.uint64)
        for t in range(self.tables):
            own[:, t] = 0
            moves = []
            for half in range(2):
                part = x[:, t * 16 + half * 8 : t * 16 + half * 8 + 8]
                at = decode(part)
                odd = self.odd[t, half * 8 : half * 8 + 8]
                own[:, t] += ((2 * at).astype(np.int64).view(np.uint64) * odd).sum(axis=1, dtype=np.uint64)
                near = np.argsort(-((part - at) @ self.steps.T), axis=1, kind="stable")[:, : self.probes]
                moves.append((twice * odd).sum(axis=1, dtype=np.uint64)[near])
            probed[:, t, :] = own[:, t, None] + np.concatenate(moves, axis=1)
        return own, probed


def proper(vector: str) -> Column:
    """Whether a vector is there, not empty, and holds neither nulls nor infinite nor undefined components."""
    sound = F.forall(vector, lambda x: x.isNotNull() & ~F.isnan(x) & (F.abs(x) < F.lit(float("inf"))))
    return F.coalesce(sound, F.lit(False)) & (F.size(vector) > 0)


def _units(vectors: pa.Array) -> np.ndarray:
    """Rows of one dimension as unit vectors in double precision."""
    rows = np.array(vectors.to_pylist(), np.float64)
    rows /= np.abs(rows).max(axis=1, keepdims=True)
    return rows / np.linalg.norm(rows, axis=1, keepdims=True)


def _signed(vectors: DataFrame, tables: int, probes: int) -> DataFrame:
    """rep, copies and vector with its cells: own (one of each table) and probed (table by table). Vectors of unlike dimension never meet."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        made: dict[int, Cells] = {}
        for batch in batches:
            sizes = batch.column(2).value_lengths().to_numpy(zero_copy_only=False)
            for size in np.unique(sizes).tolist():
                part = batch.filter(pa.array(sizes == size))
                cells = made.setdefault(size, Cells(size, tables, probes))
                own, probed = (x.reshape(part.num_rows, -1).view(np.int64) for x in cells(_units(part.column(2))))
                lists = [pa.FixedSizeListArray.from_arrays(pa.array(x.ravel()), x.shape[1]).cast(pa.list_(pa.int64())) for x in (own, probed)]
                yield pa.RecordBatch.from_arrays([*part.columns, *lists], names=["rep", "copies", "vector", "own", "probed"])

    return vectors.select("rep", "copies", "vector").mapInArrow(run, "rep long, copies long, vector array<double>, own array<long>, probed array<long>")


def spanning(near: np.ndarray) -> tuple[list[int], list[int]]:
    """Links that join what the symmetric matrix ``near`` joins: each row is reached once."""
    left, right = [], []
    open_rows = near.any(axis=1)
    while open_rows.any():
        queue = [int(open_rows.argmax())]
        open_rows[queue[0]] = False
        while queue:
            at = queue.pop()
            hit = np.flatnonzero(near[at] & open_rows).tolist()
            open_rows[hit] = False
            left += [at] * len(hit)
            right += hit
            queue += hit
    return left, right


FOREST, PAIR, DEGREE = 0, 1, 2
#: Groups of up to so many vectors are compared many at once.
SHORT = 12


class _Rows:
    """Rows of whole groups, of vectors of one dimension, as arrays; pairs are told by two places."""

    def __init__(self, table: pa.Table):
        self.group, self.rep, self.copies, self.tab, self.block = (table[n].to_numpy() for n in ("group", "rep", "copies", "tab", "block"))
        self.mine, self.same = (table[n].to_numpy(zero_copy_only=False).astype(bool) for n in ("mine", "same"))
        self.own = table["own"].combine_chunks().flatten().to_numpy().reshape(len(self.group), -1)
        vectors = table["vector"].combine_chunks().flatten().to_numpy().reshape(len(self.group), -1)
        vectors = vectors / np.abs(vectors).max(axis=1, keepdims=True)
        self.units = vectors / np.linalg.norm(vectors, axis=1, keepdims=True)

    def linked(self, i: np.ndarray, j: np.ndarray) -> list[tuple[np.ndarray, ...]]:
        """Near pairs as rows (kind, a, b, for_a, for_b).

        A pair that stands together in several tables counts in the first of these; there each of
        the two gets the other's copies as a degree. One that never stands together is met by
        probing, maybe more than once, and stays a pair.
        """
        both, alike = self.mine[i] & self.mine[j], self.own[i] == self.own[j]
        before = np.arange(alike.shape[1])[None, :] < self.tab[i][:, None]
        first = both & ~(alike & before).any(axis=1)
        probed = ~both & ~alike.any(axis=1)
        a, b, zero = i[first], j[first], np.zeros(int(first.sum()), np.int64)
        out = [(FOREST, self.rep[a], self.rep[b], zero, zero)]
        out += [(DEGREE, self.rep[x], self.rep[x], self.copies[y], zero) for x, y in ((a, b), (b, a))]
        a, b = i[probed], j[probed]
        turn = self.rep[a] > self.rep[b]
        a, b = np.where(turn, b, a), np.where(turn, a, b)
        return [*out, (PAIR, self.rep[a], self.rep[b], self.copies[b], self.copies[a])]

    def short(self, few: np.ndarray, least: float) -> list[tuple[np.ndarray, ...]]:
        """The links of all groups in ``few`` (rows of groups of up to SHORT), by shifted comparison."""
        out = []
        for shift in range(1, min(SHORT, len(self.group))):
            i = np.flatnonzero(few[:-shift] & (self.group[shift:] == self.group[:-shift]))
            j = i + shift
            met = (self.mine[i] | self.mine[j]) & (self.rep[i] != self.rep[j]) & (self.same[i] | (self.block[i] != self.block[j]))
            for first in range(0, len(i := i[met]), 20_000):
                x, y = i[first : first + 20_000], i[first : first + 20_000] + shift
                near = np.einsum("ij,ij->i", self.units[x], self.units[y]) >= least
                if near.any():
                    out += self.linked(x[near], y[near])
        return out

    def long(self, start: int, stop: int, least: float) -> list[tuple[np.ndarray, ...]]:
        """The links of one group; of those that stand together, ones that join the same are enough."""
        at = np.arange(start, stop)
        stands = at[self.mine[start:stop]]
        near = self.units[stands] @ self.units[start:stop].T >= least
        near &= self.rep[stands][:, None] != self.rep[at][None, :]
        if not self.same[start]:  # pairs within a block meet in a group of their own
            near &= self.block[stands][:, None] != self.block[at][None, :]
        if not near.any():
            return []
        both = near[:, stands - start]
        for t in range(int(self.tab[start])):
            both &= self.own[stands, t][:, None] != self.own[stands, t][None, :]
        degree = both @ self.copies[stands]
        some, out = degree > 0, []
        if some.any():
            left, right = spanning(both)
            joined, zero = self.rep[stands], np.zeros(len(stands), np.int64)
            out = [(FOREST, joined[left], joined[right], zero[: len(left)], zero[: len(left)]), (DEGREE, joined[some], joined[some], degree[some], zero[some])]
        near[:, stands - start] = False
        i, j = np.nonzero(near)
        return out + self.linked(stands[i], at[j])[-1:] if len(i) else out


def _verified(table: pa.Table, least: float) -> list[tuple[np.ndarray, ...]]:
    """The links of whole groups as rows (kind, a, b, for_a, for_b); vectors of unlike dimension have none."""
    out, sizes = [], pc.list_value_length(table["vector"])
    for size in pc.unique(sizes).to_pylist():
        rows = _Rows(table.filter(pc.equal(sizes, size)))
        starts = np.flatnonzero(np.concatenate(([True], rows.group[1:] != rows.group[:-1])))
        counts = np.diff(np.append(starts, len(rows.group)))
        out += rows.short(np.repeat(counts <= SHORT, counts), least)
        for start, count in zip(starts[counts > SHORT].tolist(), counts[counts > SHORT].tolist()):
            out += rows.long(start, start + count, least)
    return out


def vector_links(vectors: DataFrame, least: float = COSINE, tables: int = TABLES, probes: int = PROBES, block: int = BLOCK) -> DataFrame:
    """What links distinct ``vectors`` (rep long, copies long, vector array<double>) with a cosine of ``least``: kind, a, b, for_a, for_b.

    Links that stand together in a cell of some table come as ``DEGREE`` rows, in parts to be
    added up (for_a: linked copies of a), and as ``FOREST`` links (a, b) that join the same;
    their number does not grow with the square of a group. Other links come as distinct
    ``PAIR`` rows with what they add to the degrees of both ends. Cells where nobody meets are
    left before vectors are sent. A cell beyond ``block`` is cut into blocks by a hash; every
    two of its blocks meet in a group of their own.
    """
    signed = written(_signed(vectors, tables, probes))
    stand = signed.select("rep", F.posexplode("own").alias("tab", "cell"), F.lit(True).alias("mine"))
    look = signed.select("rep", F.posexplode("probed").alias("at", "cell"))
    look = look.select("rep", F.expr(f"cast(at div {2 * probes} as int)").alias("tab"), "cell", F.lit(False).alias("mine"))
    places = stand.unionAll(look)
    met = places.groupBy("tab", "cell").agg(F.count("*").alias("all"), F.count_if("mine").alias("standing")).where("all > 1 and standing > 0")
    # written, so that the join can split the rows of a crowded cell
    met = written(met.select("tab", "cell", F.ceil(F.col("all") / block).alias("blocks")))
    found = places.join(met, ["tab", "cell"])
    own = F.expr("cast(pmod(xxhash64(rep, 11L), blocks) as long)")
    found = found.select("tab", "cell", "rep", "mine", own.alias("block"), F.explode(F.expr("sequence(0L, blocks - 1)")).alias("other"))
    group = F.xxhash64("tab", "cell", F.least("block", "other"), F.greatest("block", "other"))
    found = found.select(group.alias("group"), "tab", "rep", "mine", "block", (F.col("block") == F.col("other")).alias("same"))
    found = found.join(signed.drop("probed"), "rep").select("group", "tab", "rep", "mine", "block", "same", "copies", "own", "vector")

    def link(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        held: list[pa.RecordBatch] = []
        batches = iter(batches)
        ended = False
        while not ended:
            batch = next(batches, None)
            ended = batch is None
            if not ended:
                held.append(batch)
            rows = sum(b.num_rows for b in held)
            if not rows or not ended and rows < 4 * block:
                continue
            table = pa.Table.from_batches(held).combine_chunks()
            groups = table["group"].to_numpy()
            starts = np.flatnonzero(np.concatenate(([True], groups[1:] != groups[:-1]))).tolist() + [len(groups)]
            whole = len(starts) - (1 if ended else 2)
            made = _verified(table.slice(0, starts[whole]), least) if starts[whole] else []
            held = table.slice(starts[whole]).to_batches()
            if made:
                kinds = np.concatenate([np.full(len(columns[0]), kind, np.int8) for kind, *columns in made])
                parts = [kinds, *(np.concatenate(part) for part in list(zip(*made))[1:])]
                yield from pa.table([pa.array(part) for part in parts], names=["kind", "a", "b", "for_a", "for_b"]).to_batches(max_chunksize=50_000)

    made = written(found.repartition("group").sortWithinPartitions("group").mapInArrow(link, "kind byte, a long, b long, for_a long, for_b long"))
    return made.where(f"kind <> {PAIR}").unionAll(made.where(f"kind = {PAIR}").distinct())


def near_vectors(rows: DataFrame, least: float = COSINE, tables: int = TABLES, probes: int = PROBES, block: int = BLOCK) -> DataFrame:
    """vec_id, n_links, component_id and kept of every row of ``rows`` (vec_id, embedding; others are ignored).

    Equal vectors are compared once and count as links of each other. Null, empty and zero
    vectors and those with null, infinite or undefined components link with nothing; so do
    vectors of unlike dimension. Repeated rows count as links of each other, and a null vec_id
    names a component only where there is no other. No rows give none.
    """
    rows = rows.select(F.col("vec_id").cast("long").alias("vec_id"), F.transform("embedding", lambda x: x.cast("double")).alias("vector"))
    usable = proper("vector") & F.exists("vector", lambda x: x != 0)
    # -0.0 and 0.0 are one
    vectors = rows.where(usable).withColumn("vector", F.transform("vector", lambda x: x + F.lit(0.0)))
    named = written(vectors.groupBy("vector").agg(F.min("vec_id").alias("first"), F.count("*").alias("copies")).withColumn("rep", F.xxhash64("vector")))
    links = written(vector_links(named, least, tables, probes, block))
    roots = connected_components(links.where(f"kind <> {DEGREE}"))
    ends = links.select("a", "for_a").unionAll(links.where(f"kind = {PAIR}").select("b", "for_b"))
    linked = ends.groupBy(F.col("a").alias("rep")).agg(F.sum("for_a").alias("others"))
    known = named.join(linked, "rep", "left").join(roots.withColumnRenamed("node", "rep"), "rep", "left")
    known = written(known.select("vector", "first", (F.col("copies") - 1 + F.coalesce("others", F.lit(0))).alias("n_links"), F.coalesce("root", "rep").alias("root")))
    least_id = written(known.groupBy("root").agg(F.min("first").alias("component_id")))
    known = written(known.join(least_id, "root").select("vector", "n_links", "component_id"))
    keyed = rows.withColumn("vector", F.when(usable, F.transform("vector", lambda x: x + F.lit(0.0))))
    out = keyed.join(known, "vector", "left")
    return out.select("vec_id", F.coalesce("n_links", F.lit(0)).cast("long").alias("n_links"), F.coalesce("component_id", "vec_id").alias("component_id")).withColumn(
        "kept", F.col("vec_id").eqNullSafe(F.col("component_id"))
    )
