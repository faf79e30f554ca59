"""Near-duplicate vectors by counting collisions in windows of sorted one-dimensional projections.

A vector is projected onto many random lines.  In each of ``tables``, rows that fall into the same cell of some coarse
lines are sorted along one further line, and every vector looks at the window around its own place.  How often a pair
met is counted over all tables; pairs that met at least ``MEETINGS`` times are verified in double precision.  The number
of coarse lines follows from the number of vectors, and the number of tables is the least whose binomial tail gives a
pair at the threshold the wanted recall.

Copies collapse to one representative first.  No window is cut short.  Pairs up to ``SPARSE`` places apart are told one
by one.  A vector whose window goes on beyond that is in a crowd: all crowded vectors of a cell that are in different
components are compared exactly, in tiles of two blocks over many tasks, which is more than their windows ask for, so
the calculated recall holds in a crowd, too.  All links inside a component are then counted exactly, again in tiles, so
that no task holds a group, and a large group yields a row per vector and block, never its pairs.  A large component is
cut into strips by the distance from one of its members: vectors further apart than two neighbouring strips reach have
no link, so their tiles are left out.
"""

from __future__ import annotations

import hashlib
import math

import numpy as np
import pyarrow as pa
import pyarrow.compute as pc
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from .common import connected_components, cut

THRESHOLD, RECALL, MEETINGS, SPARSE = 0.98, 0.9999, 2, 24
#: Vectors of a block: at most so many on average, and at least so many if there are fewer blocks than ``SPREAD``.
BLOCK, LEAST_BLOCK, SPREAD = 4096, 256, 16
#: Cell width and window half-width, in units of a unit vector's spread along a line.
CELL, WINDOW, SEED = 2.0, 0.6, 20240917


def _chance(threshold: float, lines: int) -> float:
    """That a pair at the threshold meets in one table; its offsets along a line are normal with this spread."""
    spread = math.sqrt(max(2 - 2 * threshold, 1e-12))
    x = np.linspace(-8, 8, 4001) * spread
    density = np.exp(-0.5 * (x / spread) ** 2)
    density /= density.sum()
    cell = float((density * np.clip(1 - np.abs(x) / CELL, 0, 1)).sum())
    return cell**lines * math.erf(WINDOW / spread / math.sqrt(2))


def calibrate(n: int, threshold: float = THRESHOLD, recall: float = RECALL) -> tuple[int, int]:
    """(coarse lines, tables) for groups of up to ``n`` vectors."""
    lines = max(6, math.ceil(math.log(max(n, 2) / 8) / math.log(1 / 0.49)))
    p, tables = _chance(threshold, lines), MEETINGS
    while sum(math.comb(tables, k) * p**k * (1 - p) ** (tables - k) for k in range(MEETINGS)) > 1 - recall:
        tables += 1
    return lines, tables


def _valid(batches):
    """Rows with their unit vector, and a key: 16 bytes of a hash over label and components; both null for vectors that link with nothing."""
    for batch in batches:
        column, labels = batch.column("embedding"), batch.column("label")
        sizes = pc.fill_null(pc.list_value_length(column), 0).to_numpy().astype(np.int64)
        flat = pc.fill_null(column.flatten(), math.nan).to_numpy()  # a null list has no values here
        ends = np.cumsum(sizes)
        units: list[bytes | None] = [None] * len(sizes)
        keys: list[bytes | None] = [None] * len(sizes)
        names = labels.to_pylist()
        for dim in np.unique(sizes[sizes > 0]).tolist():
            rows = np.flatnonzero((sizes == dim) & labels.is_valid().to_numpy(zero_copy_only=False))
            x = flat[(ends[rows] - dim)[:, None] + np.arange(dim)] + 0.0
            ok = np.isfinite(x).all(axis=1) & (x != 0).any(axis=1)
            rows, x = rows[ok], np.ascontiguousarray(x[ok])
            u = x / np.abs(x).max(axis=1, keepdims=True)  # no overflow in the norm
            u /= np.linalg.norm(u, axis=1, keepdims=True)
            for i, own, unit in zip(rows.tolist(), x, u):
                keys[i] = hashlib.blake2b(b"%d|" % names[i] + own.tobytes(), digest_size=16).digest()
                units[i] = unit.tobytes()
        yield pa.RecordBatch.from_arrays([batch.column("vec_id"), labels, pa.array(units, pa.binary()), pa.array(keys, pa.binary())], ["vec_id", "label", "unit", "key"])


def _units(column: pa.Array, dim: int | None = None) -> np.ndarray:
    """The unit vectors of a column of one length, a row each."""
    raw = column.to_pylist()
    return np.frombuffer(b"".join(raw), "<f8").reshape(len(raw), dim or (len(raw[0]) // 8 if raw else 1))


def _places(lines: int, tables: int):
    def run(batches):
        made: dict[int, tuple] = {}
        for batch in batches:
            sizes = batch.column("dim").to_numpy()
            for dim in np.unique(sizes).tolist():
                if dim not in made:
                    rng = np.random.default_rng([SEED, dim])
                    made[dim] = rng.standard_normal((dim, tables * (lines + 1))), rng.uniform(0, CELL, tables * lines), rng.integers(1, 1 << 63, (tables, lines), dtype=np.uint64) * np.uint64(2) + np.uint64(1)
                a, shift, mix = made[dim]
                own = batch.filter(pa.array(sizes == dim))
                y = _units(own.column("unit"), dim) @ a
                n = len(y)
                cell = np.floor((y[:, : tables * lines] + shift) / CELL).astype(np.int64).astype(np.uint64).reshape(n, tables, lines)
                with np.errstate(over="ignore"):
                    h = (cell * mix).sum(axis=2, dtype=np.uint64)
                    h = (h ^ (h >> np.uint64(31))) * np.uint64(0x9E3779B97F4A7C15) + np.arange(tables, dtype=np.uint64)
                t = tables
                yield pa.RecordBatch.from_arrays(
                    [pa.array(np.repeat(own.column("label").to_numpy(zero_copy_only=False), t), pa.int64()), pa.array(np.full(n * t, dim), pa.int32()), pa.array(np.tile(np.arange(t), n), pa.int32()), pa.array(h.reshape(-1).view(np.int64)), pa.array(y[:, t * lines :].reshape(-1)), pa.array(np.repeat(own.column("id").to_numpy(), t))],
                    ["label", "dim", "t", "cell", "at", "id"],
                )

    return run


def _meetings(batches):
    """Rows come sorted by (label, dim, t, cell, at): pairs of each with the next ``SPARSE`` rows of its cell and window.

    A row whose window goes on beyond them, either way, is told as crowded in that table and cell, as a pair of itself.
    """
    held = None
    for batch in batches:
        new = 0
        if held is not None:
            new, batch = held.num_rows, pa.concat_batches([held, batch])
        cols = [batch.column(c).to_numpy() for c in ("label", "dim", "t", "cell")]
        at, ids = batch.column("at").to_numpy(), batch.column("id").to_numpy()
        a, b, t, cell = [], [], [], []
        for k in range(1, min(SPARSE + 1, len(at) - 1) + 1):
            near = at[k:] - at[:-k] <= WINDOW
            for c in cols:
                near &= c[k:] == c[:-k]
            left = np.flatnonzero(near)
            left = left[left + k >= new]  # the others were seen with the batch before
            if k <= SPARSE:
                a.append(ids[left]), b.append(ids[left + k])
                t.append(np.full(len(left), -1)), cell.append(np.zeros(len(left), np.int64))
            else:
                left = np.unique(np.concatenate([left, left + k]))
                a.append(ids[left]), b.append(ids[left])
                t.append(cols[2][left]), cell.append(cols[3][left])
        held = batch.slice(max(0, batch.num_rows - SPARSE - 1))
        if a:
            a, b, t, cell = map(np.concatenate, (a, b, t, cell))
            yield pa.RecordBatch.from_arrays([pa.array(np.minimum(a, b)), pa.array(np.maximum(a, b)), pa.array(t, pa.int32()), pa.array(cell)], ["a", "b", "t", "cell"])


def _verified(threshold: float):
    def run(batches):
        for batch in batches:
            sizes = batch.column("dim").to_numpy()
            for dim in np.unique(sizes).tolist():
                own = batch.filter(pa.array(sizes == dim))
                near = (_units(own.column("x"), dim) * _units(own.column("y"), dim)).sum(axis=1) >= threshold
                yield own.select(["a", "b"]).filter(pa.array(near))

    return run


def _joins(threshold: float):
    """Pairs of components with a link between the two blocks of a tile; rows come sorted by (label, dim, t, cell, i, j, role)."""

    def linked(x, a, y, b):
        """Links of unlike components; the larger side's most frequent component is not compared with itself."""
        out = set()
        names, n = np.unique(np.concatenate([a, b]), return_counts=True)
        top = names[n.argmax()]
        for u, p, v, q in ((x[a != top], a[a != top], y, b), (x[a == top], a[a == top], y[b != top], b[b != top])):
            if not len(v):
                continue
            for k in range(0, len(u), 256):
                i, j = np.nonzero((u[k : k + 256] @ v.T >= threshold) & (p[k : k + 256, None] != q[None, :]))
                if len(i):
                    out.update(map(tuple, np.unique(np.stack([p[k + i], q[j]], 1), axis=0).tolist()))
        return out

    def run(batches):
        key, held = None, {}

        def close():
            if key is None or 0 not in held:
                return None
            x, a = (np.concatenate(k) for k in zip(*held[0]))
            y, b = (x, a) if key[-1] == key[-2] else (np.concatenate(k) for k in zip(*held[1])) if 1 in held else (None, None)
            if y is None:
                return None
            out = sorted(linked(x, a, y, b))
            return pa.RecordBatch.from_arrays([pa.array([u for u, _ in out], pa.int64()), pa.array([v for _, v in out], pa.int64())], ["a", "b"])

        for batch in batches:
            marks = list(zip(*(batch.column(c).to_pylist() for c in ("label", "dim", "t", "cell", "i", "j", "role"))))
            start = 0
            for end in range(1, len(marks) + 1):
                if end < len(marks) and marks[end] == marks[start]:
                    continue
                if marks[start][:-1] != key:
                    if (done := close()) is not None:
                        yield done
                    key, held = marks[start][:-1], {}
                part = batch.slice(start, end - start)
                held.setdefault(marks[start][-1], []).append((_units(part.column("unit")), part.column("rep").to_numpy()))
                start = end
        if (done := close()) is not None:
            yield done

    return run


def _blocks(n) -> Column:
    """How many blocks ``n`` vectors make."""
    return F.greatest(F.ceil(n / BLOCK), F.least(F.lit(SPREAD), F.ceil(n / LEAST_BLOCK))).cast("int")


def _block_of(key: str, blocks: str) -> Column:
    return F.pmod(F.xxhash64(key), F.col(blocks).cast("long")).cast("int")


def _joined(groups: DataFrame, crowded: DataFrame, reps: DataFrame, threshold: float) -> DataFrame:
    """``groups`` after all links between crowded vectors of one cell have joined the components of their ends."""
    cells = ["label", "dim", "t", "cell"]
    named = crowded.join(groups.select(F.col("node").alias("id"), "rep"), "id", "left").join(reps.select("id", "label", "dim"), "id")
    named = cut(named.select(*cells, "id", F.coalesce("rep", "id").alias("rep")), "crowded")
    mixed = named.groupBy(*cells).agg(F.min("rep").alias("x"), F.max("rep").alias("y"), _blocks(F.count(F.lit(1))).alias("blocks")).where("x < y")
    mixed = cut(named.join(mixed.select(*cells, "blocks"), cells), "mixed")
    if mixed.isEmpty():
        return groups
    tiles = mixed.join(reps.select("id", "unit"), "id").withColumn("b", _block_of("id", "blocks")).withColumn("k", F.explode(F.sequence(F.lit(0), F.col("blocks") - 1)))
    tiles = tiles.select(*cells, F.least("b", "k").alias("i"), F.greatest("b", "k").alias("j"), (F.col("k") < F.col("b")).cast("int").alias("role"), "rep", "unit")
    tiles = tiles.repartition(*cells, "i", "j").sortWithinPartitions(*cells, "i", "j", "role")
    joins = cut(tiles.mapInArrow(_joins(threshold), "a long, b long").distinct(), "joins")
    if joins.isEmpty():
        return groups
    return cut(connected_components(groups.select(F.col("node").alias("a"), F.col("rep").alias("b")).where("a <> b").union(joins)), "joined")


def _chord(threshold: float) -> float:
    """The greatest distance of two unit vectors that link, and a little more."""
    return math.sqrt(max(2 - 2 * threshold, 0.0)) + 1e-6


def _strips(width: float):
    def run(batches):
        for batch in batches:
            sizes, strip = batch.column("dim").to_numpy(), np.zeros(batch.num_rows, np.int32)
            far = batch.column("anchor").is_valid().to_numpy(zero_copy_only=False)
            for dim in np.unique(sizes[far]).tolist():
                rows = np.flatnonzero(far & (sizes == dim))
                own = batch.take(pa.array(rows))
                strip[rows] = np.linalg.norm(_units(own.column("unit"), dim) - _units(own.column("anchor"), dim), axis=1) / width
            names = ["rep", "id", "unit", "copies"]
            yield pa.RecordBatch.from_arrays([*(batch.column(c) for c in names), pa.array(strip)], [*names, "strip"])

    return run


def _dealt(members: DataFrame, threshold: float) -> DataFrame:
    """``members(rep, id, dim, unit, copies)`` once for each tile of two blocks that may hold links.

    A component of more than ``BLOCK`` members has strips as wide as two linked vectors are apart at most, by the
    distance from its first member, which differs by no more than the vectors do: links are within a strip or between
    neighbours.  A tile is (rep, strip, side, i, j): block i of the strip and block j of it (side 0) or the next (1).
    """
    sizes = members.groupBy("rep").agg(F.count(F.lit(1)).alias("n"), F.min("id").alias("first"))
    anchors = sizes.where(F.col("n") > BLOCK).join(members.select(F.col("id").alias("first"), F.col("unit").alias("anchor")), "first").select("rep", "anchor")
    placed = members.join(anchors, "rep", "left").select("rep", "id", "dim", "unit", "copies", "anchor").mapInArrow(_strips(_chord(threshold)), "rep long, id long, unit binary, copies long, strip int")
    placed = cut(placed, "strips")
    held = cut(placed.groupBy("rep", "strip").agg(_blocks(F.count(F.lit(1))).alias("blocks")), "strip-sizes")
    other = lambda by, name: held.select("rep", (F.col("strip") + by).alias("strip"), F.col("blocks").alias(name))
    held = held.join(other(1, "before"), ["rep", "strip"], "left").join(other(-1, "after"), ["rep", "strip"], "left")
    rows = placed.join(held, ["rep", "strip"]).withColumn("b", _block_of("id", "blocks"))
    b, each = F.col("b"), lambda n, f: F.transform(F.sequence(F.lit(0), F.col(n) - 1), f)
    tile = lambda strip, side, i, j, role: F.struct(strip.cast("int").alias("strip"), F.lit(side).alias("side"), i.cast("int").alias("i"), j.cast("int").alias("j"), role.cast("int").alias("role"))
    none = F.array().cast("array<struct<strip:int,side:int,i:int,j:int,role:int>>")
    own = each("blocks", lambda k: tile(F.col("strip"), 0, F.least(b, k), F.greatest(b, k), k < b))
    up = F.coalesce(each("after", lambda k: tile(F.col("strip"), 1, b, k, F.lit(0))), none)
    down = F.coalesce(each("before", lambda k: tile(F.col("strip") - 1, 1, k, b, F.lit(1))), none)
    rows = rows.select("rep", F.explode(F.concat(own, up, down)).alias("tile"), "id", "unit", "copies").select("rep", "tile.*", "id", "unit", "copies")
    keys = ["rep", "strip", "side", "i", "j"]
    return rows.repartition(*keys).sortWithinPartitions(*keys, "role", "id")


def _tile_links(threshold: float):
    """Links between the two blocks of a tile, counted for the members of both; rows come sorted by (tile, role, id)."""

    def run(batches):
        key, held = None, {}

        def close():
            if key is None or 0 not in held:
                return None
            same = key[2] == 0 and key[3] == key[4]
            ids, x, copies = (np.concatenate(k) for k in zip(*held[0]))
            if not same and 1 not in held:
                return None
            other, y, more = (ids, x, copies) if same else (np.concatenate(k) for k in zip(*held[1]))
            n, m = np.zeros(len(ids), np.int64), np.zeros(len(other), np.int64)
            for k in range(0, len(x), 512):
                near = x[k : k + 512] @ y.T >= threshold
                if same:
                    near[np.arange(len(near)), k + np.arange(len(near))] = False
                n[k : k + 512] = near @ more
                if not same:
                    m += copies[k : k + 512] @ near
            if not same:
                ids, n = np.concatenate([ids, other]), np.concatenate([n, m])
            return pa.RecordBatch.from_arrays([pa.array(ids, pa.int64()), pa.array(n, pa.int64())], ["id", "n"])

        for batch in batches:
            marks = list(zip(*(batch.column(c).to_pylist() for c in ("rep", "strip", "side", "i", "j", "role"))))
            start = 0
            for end in range(1, len(marks) + 1):
                if end < len(marks) and marks[end] == marks[start]:
                    continue
                if marks[start][:5] != key:
                    if (done := close()) is not None:
                        yield done
                    key, held = marks[start][:5], {}
                part = batch.slice(start, end - start)
                held.setdefault(marks[start][5], []).append((part.column("id").to_numpy(), _units(part.column("unit")), part.column("copies").to_numpy()))
                start = end
        if (done := close()) is not None:
            yield done

    return run


def near_vectors(vectors: DataFrame, threshold: float = THRESHOLD, recall: float = RECALL) -> DataFrame:
    """One row per row of ``vectors(vec_id, embedding, label)``: vec_id, n_links, component_id, kept.

    Only vectors with equal labels and of equal length are compared.  Null labels and vectors that are null, empty,
    zero or hold null or non-finite components link with nothing.  Rows that repeat a vec_id are vectors of their own;
    a null vec_id counts in no minimum (component_id is null where no other is, kept false).  An empty table gives no
    rows; other columns, whatever their names, are ignored.
    """
    rows = vectors.select(F.col("vec_id").cast("long").alias("vec_id"), F.col("label").cast("long").alias("label"), F.col("embedding").cast("array<double>").alias("embedding"))
    rows = cut(rows.mapInArrow(_valid, "vec_id long, label long, unit binary, key binary"), "vectors")
    # a representative has a number of its own: the part and place where its group was written
    reps = rows.where("key is not null").groupBy("key").agg(F.first("label").alias("label"), F.first("unit").alias("unit"), F.count(F.lit(1)).alias("copies"), F.min("vec_id").alias("least"))
    reps = cut(reps.select(F.monotonically_increasing_id().alias("id"), "*", F.floor(F.octet_length("unit") / 8).cast("int").alias("dim")), "representatives")
    largest = reps.groupBy("label", "dim").agg(F.count(F.lit(1)).alias("n")).agg(F.max("n")).first()[0] or 0
    lines, tables = calibrate(largest, threshold, recall)

    places = reps.select("id", "label", "dim", "unit").mapInArrow(_places(lines, tables), "label long, dim int, t int, cell long, at double, id long")
    order = ["label", "dim", "t", "cell"]
    met = places.repartition(*order).sortWithinPartitions(*order, "at", "id").mapInArrow(_meetings, "a long, b long, t int, cell long")
    met = cut(met.groupBy("a", "b", "t", "cell").agg(F.count(F.lit(1)).alias("n")).where((F.col("n") >= MEETINGS) | (F.col("t") >= 0)).drop("n"), "pairs")
    pairs = met.where("t < 0").select("a", "b")
    x = reps.select(F.col("id").alias("a"), F.col("unit").alias("x"), "dim")
    y = reps.select(F.col("id").alias("b"), F.col("unit").alias("y"))
    links = pairs.join(x, "a").join(y, "b").select("a", "b", "dim", "x", "y").mapInArrow(_verified(threshold), "a long, b long")
    groups = cut(connected_components(links), "groups")
    groups = _joined(groups, met.where("t >= 0").select(F.col("a").alias("id"), "t", "cell"), reps, threshold)

    members = cut(groups.select(F.col("node").alias("id"), "rep").join(reps.select("id", "dim", "unit", "copies"), "id"), "members")
    counted = _dealt(members, threshold).mapInArrow(_tile_links(threshold), "id long, n long").groupBy("id").agg(F.sum("n").alias("n"))

    named = reps.select("id", "key", "copies", "least").join(groups.select(F.col("node").alias("id"), "rep"), "id", "left").join(counted, "id", "left")
    named = cut(named.select("key", "copies", "least", F.coalesce("rep", "id").alias("rep"), F.coalesce("n", F.lit(0)).alias("n")), "named")
    least = named.groupBy("rep").agg(F.min("least").alias("component_id"))
    named = named.join(least, "rep").select("key", (F.col("n") + F.col("copies") - 1).alias("n_links"), "component_id")
    out = rows.select("vec_id", "key").join(named, "key", "left")
    return out.select("vec_id", F.coalesce("n_links", F.lit(0).cast("long")).alias("n_links"), F.when(F.col("key").isNull(), F.col("vec_id")).otherwise(F.col("component_id")).alias("component_id")).withColumn("kept", F.coalesce(F.col("vec_id") == F.col("component_id"), F.lit(False)))
