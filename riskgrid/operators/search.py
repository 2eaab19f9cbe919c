"""Nearest neighbours: exact and filter-refine k-NN joins over quantised or float vectors.

Quantised references are dealt out into cells that are near in space, by the splits of a tree over a few references of each
packed block. A cell is one or more blocks, each sorted into leaves, with the box of each leaf and of all. A query is searched in
its own block first; its k-th distance there bounds it, and it is sent to the blocks whose box is no farther than that, ties
included. So the result is that of all pairs, whatever the splits are, and nothing runs while the plan is built. ``arrow``
evaluates leaves with matrix products (exact, as the numbers are whole and below 2**53), ``frame`` is a join of queries and
references by leaf with unrolled expressions. Float vectors meet in all pairs of blocks. All end in a window whose partial limit
prunes before the shuffle. Order is total: (distance, [partial distance,] ref_id).
"""

from __future__ import annotations

import pickle
from collections.abc import Callable, Sequence
from dataclasses import dataclass

import numpy as np
import pyarrow as pa
from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from riskgrid.config import BLOCK_A, DIMS, K, PRUNE
from riskgrid.functions.quantize import squared_distance

#: Rows of a block of queries, and of references: 240 KB and 1 MB of 14 features.
QUERY_BLOCK, REF_BLOCK = 4096, 16384
#: References packed before they are dealt out, and how many of these the splits are made from.
PACK, TAKEN = 1 << 16, 256
#: References of a cell, about; of a block, at most; and of a leaf, at most.
CELL, MOST, LEAF = 8192, 1 << 16, 256
#: Blocks of queries whose bounds a task remembers from one block of references to the next.
REMEMBERED = 256
#: Numbers of a distance matrix worked on at a time.
TILE = 1 << 22
#: Numbers of a distance matrix that stays in the processor's cache.
WORKED = 1 << 17
#: Numbers of a matrix of distances to boxes worked on at a time.
CACHED = 1 << 14


@dataclass(frozen=True)
class Every:
    """Queries that are the references whose id is divisible by ``step``: taken from the references' blocks, so that these are
    made once. ``numbers`` has the references' ref_id, where a table has them that needn't be computed."""

    step: int
    numbers: DataFrame | None = None

    def frame(self, refs: DataFrame) -> DataFrame:
        columns = [F.col(c) for c in refs.columns if c not in ("ref_id", "is_fraud")]
        return refs.where(F.col("ref_id") % self.step == 0).select(F.col("ref_id").alias("qid"), *columns)


@dataclass(frozen=True)
class Packed:
    """References that come in blocks: b, kind, content, shuffled by b. Contents are those of ``content`` for references (kind 0)
    and queries (kind 1), and for each block of references a note (kind 2): ``note``'s. ``columns`` names the values. What these
    still lack is filled in by ``whole``, from what ``state`` makes of all notes."""

    frame: DataFrame
    columns: tuple[str, ...]
    state: Callable[[list], object] = lambda notes: None
    whole: Callable[[np.ndarray, object, int], np.ndarray] = lambda values, state, kind: values


def asked_of(queries: DataFrame | Every, refs: DataFrame | Packed) -> DataFrame:
    """qid of all queries."""
    if isinstance(queries, Every):
        queries = queries.frame(refs if queries.numbers is None else queries.numbers.select("ref_id"))
    return queries.select("qid")


def names(dims: Sequence[int] | int, prefix: str = "q") -> list[str]:
    return [f"{prefix}{i}" for i in (range(dims) if isinstance(dims, int) else dims)]


def nearest(pairs: DataFrame, k: int, order: Sequence[str | Column]) -> DataFrame:
    """The first k of each query, with their rank."""
    window = Window.partitionBy("qid").orderBy(*order)
    return pairs.withColumn("rank", F.row_number().over(window)).where(F.col("rank") <= k)


def _best(d: np.ndarray, ids: np.ndarray, k: int, limit: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    """(row, column) of the k smallest of each row, ties by id: all up to a bound are taken, then cut in order.

    ``limit`` has for each row the k-th value of an earlier batch, infinity before; it bounds the search and is lowered.
    """
    n, m = d.shape
    bound = limit if np.isfinite(limit).all() or m <= k else np.minimum(limit, np.partition(d, k - 1, axis=1)[:, k - 1])
    inside = d <= bound[:, None]
    if np.count_nonzero(inside) > 8 * k * n and (ids[1:] > ids[:-1]).all():
        tied = d == bound[:, None]  # of those on the bound the first k are enough
        inside &= ~tied | (np.cumsum(tied, axis=1) <= k)
    row, column = np.nonzero(inside)
    order = np.lexsort((ids[column], d[row, column], row))
    row, column = row[order], column[order]
    place = np.arange(len(row)) - np.searchsorted(row, row)
    last = place == k - 1
    limit[row[last]] = np.minimum(limit[row[last]], d[row[last], column[last]])
    keep = (place < k) & np.isfinite(d[row, column])
    return row[keep], column[keep]


BLOCK_ROW = "b long, kind int, content binary"


def content(ids: np.ndarray, flags: np.ndarray, values: np.ndarray) -> bytes:
    """A block: values are int16, int32 or float64."""
    return b"".join([np.array([len(ids), values.itemsize], np.int64), np.ascontiguousarray(ids, np.int64), np.ascontiguousarray(values), np.ascontiguousarray(flags, np.uint8)])


def _unpacked(block) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
    n, width = (int(x) for x in np.frombuffer(block, np.int64, 2))
    ids, flags = np.frombuffer(block, np.int64, n, 16), np.frombuffer(block, np.uint8)[-n:] if n else np.zeros(0, np.uint8)
    kind = {2: np.int16, 4: np.int32, 8: np.float64}[width]
    return ids, flags, np.frombuffer(block[16 + 8 * n : len(block) - n], kind).reshape(n, -1)


def note(values: np.ndarray, told: object = None) -> bytes:
    """What is known of a block before all are: how many rows it has, some of its values, and what its maker tells."""
    some = values[np.linspace(0, len(values) - 1, min(TAKEN, len(values))).astype(np.int64)]
    return pickle.dumps((len(values), some, told), 5)


def block_rows(rows: Sequence[tuple[int, int, bytes]]) -> pa.RecordBatch:
    b, kind, contents = zip(*rows, strict=True)
    return pa.RecordBatch.from_arrays([pa.array(b, pa.int64()), pa.array(kind, pa.int32()), pa.array(contents, pa.binary())], names=["b", "kind", "content"])


def _of_kind(frame: DataFrame, kind: int) -> DataFrame:
    """The rows of a kind. A condition that hangs on the partition stays above the shuffle, so that this is used again."""
    return frame.where(F.when(F.spark_partition_id() >= 0, F.col("kind")) == kind)


def _packed(frame: DataFrame, id_column: str, columns: list[str], flag: str | None, size: int, noted: bool = False) -> DataFrame:
    """b (a number to deal blocks out by), kind, content: ids, flags and values of ``size`` rows or fewer, and notes if asked for.
    Rows with a null are left out.

    ``columns`` are whole numbers below 2**31, or one column of double vectors of one length.
    """
    vector = dict(frame.dtypes)[columns[0]].startswith("array")

    def block(part: pa.Table) -> pa.RecordBatch:
        ids = part.column(0).to_numpy().astype(np.int64)
        flags = part.column(1).to_numpy().astype(np.uint8)
        if vector:
            values = part.column(2).combine_chunks().flatten().to_numpy().astype(np.float64)
        else:
            values = np.stack([c.to_numpy() for c in part.columns[2:]], axis=1)
            if len(values) and np.abs(values).max() >= 1 << 31:
                raise ValueError("features of more than 31 bits")
            values = values.astype(np.int32)
        rows = [(int(ids[0]), 0, content(ids, flags, values))]
        return block_rows([*rows, (int(ids[0]), 2, note(values))] if noted else rows)

    def run(batches):
        held, n = [], 0
        for batch in batches:
            for c in range(batch.num_columns):
                if batch.column(c).null_count:
                    batch = batch.filter(batch.column(c).is_valid())
            while batch.num_rows:
                head = batch.slice(0, size - n)
                held.append(head)
                batch, n = batch.slice(head.num_rows), n + head.num_rows
                if n == size:
                    yield block(pa.Table.from_batches(held))
                    held, n = [], 0
        if n:
            yield block(pa.Table.from_batches(held))

    chosen = frame.select(F.col(id_column).cast("long").alias("id"), F.lit(False).alias("flag") if flag is None else F.coalesce(F.col(flag), F.lit(False)).alias("flag"), *columns)
    # The shuffle is a boundary: blocks that meet many others aren't made again for each.
    return chosen.mapInArrow(run, BLOCK_ROW).repartition("b")


def _own(blocks: DataFrame, step: int) -> DataFrame:
    """Of packed vectors those whose id is divisible by ``step``, in blocks of QUERY_BLOCK or fewer."""

    def run(batches):
        held: list[tuple[np.ndarray, ...]] = []

        def block(rows):
            ids, flags, values = (np.concatenate([r[c] for r in rows]) for c in range(3))
            for i in range(0, len(ids), QUERY_BLOCK):
                part = slice(i, i + QUERY_BLOCK)
                yield block_rows([(int(ids[i]), 0, content(ids[part], flags[part], values[part]))])

        for batch in batches:
            for packed in batch.column(2):
                ids, flags, values = _unpacked(packed.as_buffer())
                own = ids % step == 0
                held.append((ids[own], flags[own], values[own]))
                if sum(len(h[0]) for h in held) >= QUERY_BLOCK:
                    yield from block(held)
                    held = []
        if held:
            yield from block(held)

    return blocks.mapInArrow(run, BLOCK_ROW)


def _squares(q: np.ndarray, r: np.ndarray, vector: bool) -> np.ndarray:
    """Squared distances of all pairs: by products where they are exact, else term by term."""
    if not vector:
        return (q * q).sum(axis=1)[:, None] + (r * r).sum(axis=1)[None] - 2 * q @ r.T
    out = np.zeros((len(q), len(r)))
    for c in range(q.shape[1]):
        out += (q[:, c, None] - r[None, :, c]) ** 2
    return out


def _factors(q: np.ndarray, r: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    """Two matrices whose product is the squared distances of all pairs, in one pass; as exact as ``_squares`` by products."""
    q, r = q.astype(np.float64), r.astype(np.float64)
    return np.column_stack([q, np.ones(len(q)), (q * q).sum(axis=1)]), np.vstack([-2 * r.T, (r * r).sum(axis=1), np.ones(len(r))])


def _splits(points: np.ndarray, cells: int) -> tuple[np.ndarray, np.ndarray]:
    """A complete binary tree: column and value that each node splits at; what is no larger goes to the left."""
    nodes = (1 << max(0, (cells - 1).bit_length())) - 1
    column, value = np.zeros(nodes, np.int64), np.full(nodes, np.inf)
    held = {0: points}
    for node in range(nodes):
        own = held.pop(node)
        if len(own) > 1:
            c = int(own.var(axis=0).argmax())
            x = np.sort(own[:, c])
            at = x[(len(x) - 1) // 2]
            if at == x[-1]:  # the larger side would be empty
                at = x[np.searchsorted(x, at) - 1] if x[0] < at else np.inf
            column[node], value[node] = c, at
        left = own[:, column[node]] <= value[node]
        if 2 * node + 2 < nodes:
            held[2 * node + 1], held[2 * node + 2] = own[left], own[~left]
    return column, value


def _leaves(values: np.ndarray) -> list[np.ndarray]:
    """Rows in leaves of at most LEAF, by halves along the column that varies most."""
    todo, out = [np.arange(len(values))], []
    while todo:
        rows = todo.pop()
        if len(rows) <= LEAF:
            out.append(rows)
            continue
        own = values[rows]
        half = np.argpartition(own[:, int(own.var(axis=0).argmax())], len(rows) // 2)
        todo += [rows[half[: len(rows) // 2]], rows[half[len(rows) // 2 :]]]
    return out


def _apart(points: np.ndarray, low: np.ndarray, high: np.ndarray) -> np.ndarray:
    """Squared distances of points to boxes, some points at a time, so that what is worked on stays in the processor's cache."""
    out = np.zeros((len(points), len(low)))
    low, high = (np.ascontiguousarray(x.T, np.float64) for x in (low, high))
    step = max(1, CACHED // max(1, out.shape[1]))
    for i in range(0, len(points), step):
        own = out[i : i + step]
        gap, other = np.empty_like(own), np.empty_like(own)
        for c in range(points.shape[1]):
            x = points[i : i + step, c, None]
            np.subtract(low[c], x, out=gap)
            np.subtract(x, high[c], out=other)
            np.maximum(gap, other, out=gap)
            np.maximum(gap, 0, out=gap)
            np.multiply(gap, gap, out=gap)
            own += gap
    return out


@dataclass
class _Block:
    """References in leaves, sorted by id in each; values are whole numbers, ``split`` columns of which count for the search."""

    ids: np.ndarray
    flags: np.ndarray
    values: np.ndarray
    cuts: np.ndarray
    low: np.ndarray
    high: np.ndarray

    @classmethod
    def of(cls, ids: np.ndarray, flags: np.ndarray, values: np.ndarray, split: int) -> _Block:
        leaves = [rows[np.argsort(ids[rows], kind="stable")] for rows in _leaves(values[:, :split].astype(np.float64))]
        order, cuts = np.concatenate(leaves), np.cumsum([0, *map(len, leaves)])
        a = values[order, :split]
        return cls(ids[order], flags[order], values[order], cuts, np.minimum.reduceat(a, cuts[:-1]), np.maximum.reduceat(a, cuts[:-1]))

    def _itself(self, qids: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
        """query and place of the references that are queries."""
        by = np.argsort(self.ids)
        at = np.minimum(np.searchsorted(self.ids[by], qids), len(by) - 1)
        own = np.flatnonzero(self.ids[by[at]] == qids)
        return own, by[at[own]]

    def bound(self, qids: np.ndarray, q: np.ndarray, k: int, split: int) -> np.ndarray:
        """The k-th distance of each query in this block, infinity if there are fewer."""
        out, (own, place) = np.full(len(q), np.inf), self._itself(qids)
        if len(self.ids) >= k:
            a, r = _factors(q[:, :split], self.values[:, :split])
            step = max(1, WORKED // len(self.ids))
            for i in range(0, len(a), step):
                d = a[i : i + step] @ r
                here = (own >= i) & (own < i + step)
                d[own[here] - i, place[here]] = np.inf
                d.partition(k - 1, axis=1)
                out[i : i + step] = d[:, k - 1]
        return out

    def search(self, qids: np.ndarray, q: np.ndarray, limit: np.ndarray, k: int, split: int) -> tuple[np.ndarray, ...]:
        """query, reference, distance of the k nearest of each query within its limit, as places, in no order."""
        a, r = _factors(q[:, :split], self.values[:, :split])
        open_ = np.flatnonzero(np.isinf(limit))
        limit = limit.copy()
        limit[open_] = self.bound(qids[open_], q[open_], k, split)
        own, place = self._itself(qids)
        itself = np.full(len(a), -1)
        itself[own] = place
        apart, held, size = _apart(a[:, :split], self.low, self.high), [(np.zeros(0, np.int64), np.zeros(0, np.int64), np.zeros(0))], 0
        for leaf in range(len(self.low)):
            begin, end = self.cuts[leaf], self.cuts[leaf + 1]
            to = np.flatnonzero(apart[:, leaf] <= limit)
            step = max(1, WORKED // (end - begin))
            for i in range(0, len(to), step):
                some = to[i : i + step]
                d = a[some] @ r[:, begin:end]
                here = np.flatnonzero((itself[some] >= begin) & (itself[some] < end))
                d[here, itself[some[here]] - begin] = np.inf
                row, column = np.nonzero((d <= limit[some][:, None]) & np.isfinite(d))
                held.append((some[row], begin + column, d[row, column]))
                size += len(row)
                if size > TILE:
                    held = [self._cut(held, limit, k)]
                    size = len(held[0][0])
        return self._cut(held, limit, k)

    def _cut(self, held: list[tuple[np.ndarray, ...]], limit: np.ndarray, k: int) -> tuple[np.ndarray, ...]:
        """The first k of each query by distance and id. Only queries with more are sorted; their limits are lowered."""
        row, column, d = (np.concatenate(x) for x in zip(*held, strict=True))
        many = np.bincount(row, minlength=len(limit)) > k
        if not many.any():
            return row, column, d
        full = many[row]
        some = np.flatnonzero(full)
        order = some[np.lexsort((self.ids[column[some]], d[some], row[some]))]
        place = np.arange(len(order)) - np.searchsorted(row[order], row[order])
        last = order[place == k - 1]
        limit[row[last]] = d[last]
        kept = np.concatenate([np.flatnonzero(~full), order[place < k]])
        return row[kept], column[kept], d[kept]


def _narrow(values: np.ndarray) -> np.ndarray:
    return values.astype(np.int16) if not len(values) or (values.min() >= -(1 << 15) and values.max() < 1 << 15) else values


def _row(b: int, kind: int, content, box=None) -> pa.RecordBatch:
    dump = lambda x: pickle.dumps(x, 5)
    return pa.RecordBatch.from_arrays([pa.array([b], pa.int64()), pa.array([kind], pa.int32()), pa.array([dump(box)], pa.binary()), pa.array([dump(content)], pa.binary())], names=["b", "kind", "box", "content"])


_ROW = "b long, kind int, box binary, content binary"


def _grown(packed: Packed, order: list[int], split: int) -> DataFrame:
    """One row: the tree by which rows are dealt out to cells, and the state that makes values whole. Broadcast."""
    state, whole = packed.state, packed.whole

    def grow(batches):
        for batch in batches:
            for notes in batch.column(0):
                n, some, told = zip(*(pickle.loads(x.as_buffer()) for x in notes.values.field("content")), strict=True) if len(notes.values) else ((), (), ())
                if n:
                    made = state(list(told))
                    points = whole(np.concatenate(some), made, 0)[:, order[:split]].astype(np.float64)
                    tree = _splits(points[np.lexsort(points.T)], -(-sum(n) // CELL))
                    yield pa.RecordBatch.from_arrays([pa.array([pickle.dumps((*tree, made), 5)], pa.binary())], names=["grown"])

    notes = _of_kind(packed.frame, 2).agg(F.collect_list(F.struct("b", "kind", "content")).alias("notes"))
    return F.broadcast(notes.mapInArrow(grow, "grown binary"))


def _dealt(refs: DataFrame | Packed, first: list[str], rest: list[str], flag: str | None) -> tuple[DataFrame, Callable[[Packed], DataFrame]]:
    """Blocks of references that are near by the columns ``first``: b, kind 0, the box of all, the block; and what makes blocks of
    packed queries whole."""
    # Columns are packed in the order of the references', whatever is searched by: searches of several kinds share one shuffle.
    columns = refs.columns if isinstance(refs, Packed) else tuple(c for c in refs.columns if c in {*first, *rest})
    packed = refs if isinstance(refs, Packed) else Packed(_packed(refs, "ref_id", list(columns), flag, PACK, True), columns)
    order, split, whole, width = [columns.index(c) for c in first + rest], len(first), packed.whole, "<i2" if isinstance(refs, Packed) else "<i4"
    row = np.dtype([("id", "<i8"), ("flag", "u1"), ("v", width, (len(order),))])
    grown = _grown(packed, order, split)

    def deal(batches):
        column = value = made = cells = None
        for batch in batches:
            for block, tree in zip(batch.column(0), batch.column(1), strict=True):
                if column is None:  # the same for all
                    column, value, made = pickle.loads(tree.as_buffer())
                    cells = len(column) + 1
                ids, flags, values = _unpacked(block.as_buffer())
                values = whole(values, made, 0)[:, order]
                by, node, every = np.ascontiguousarray(values.T), np.zeros(len(ids), np.int64), np.arange(len(ids))
                for _ in range(cells.bit_length() - 1):
                    node = 2 * node + 1 + (by[column[node], every] > value[node])
                node -= cells - 1
                place = np.argsort(node.astype(np.uint16) if cells <= 1 << 16 else node, kind="stable")
                rows = np.empty(len(ids), row)
                rows["id"], rows["flag"], rows["v"] = ids, flags, values
                node = node[place]
                starts = np.flatnonzero(np.append(True, np.diff(node) > 0))
                yield pa.RecordBatch.from_arrays([pa.array(node[starts]), _pieces(rows[place], starts)], names=["cell", "piece"])

    def gather(batches):
        def block(cell, n, rows):
            rows = np.frombuffer(rows, row)
            made = _Block.of(np.ascontiguousarray(rows["id"]), np.ascontiguousarray(rows["flag"]), _narrow(np.ascontiguousarray(rows["v"])), split)
            return _row(cell * (1 << 20) + n, 0, made, (made.low.min(axis=0), made.high.max(axis=0)))

        cell, held, size, n, most = None, [], 0, 0, MOST * row.itemsize
        for batch in batches:
            cells, pieces = batch.column(0).to_numpy(), batch.column(1)
            at = np.frombuffer(pieces.buffers()[1], np.int32)[pieces.offset : pieces.offset + len(pieces) + 1]
            starts = np.flatnonzero(np.append(True, np.diff(cells) != 0)) if len(cells) else []
            for i, j in zip(starts, [*starts[1:], len(cells)], strict=True):
                if held and cells[i] != cell:
                    yield block(cell, n, b"".join(held))
                    held, size = [], 0
                cell, n = int(cells[i]), n if cells[i] == cell else 0
                held.append(pieces.buffers()[2][at[i] : at[j]].to_pybytes())
                size += len(held[-1])
                while size > most:
                    rows = b"".join(held)
                    yield block(cell, n, rows[:most])
                    held, size, n = [rows[most:]], size - most, n + 1
        if held:
            yield block(cell, n, b"".join(held))

    def filled(asked: Packed) -> DataFrame:
        own, names_ = asked.whole, asked.columns
        order_ = [names_.index(c) for c in first + rest]

        def fill(batches):
            for batch in batches:
                for block, tree in zip(batch.column(0), batch.column(1), strict=True):
                    ids, flags, values = _unpacked(block.as_buffer())
                    values = own(values, pickle.loads(tree.as_buffer())[2], 1)[:, order_]
                    yield block_rows([(0, 1, content(ids, flags, values))])

        return _of_kind(asked.frame, 1).select("content").crossJoin(grown).mapInArrow(fill, BLOCK_ROW)

    pieces = _of_kind(packed.frame, 0).select("content").crossJoin(grown).mapInArrow(deal, "cell long, piece binary")
    # Both shuffles are boundaries: what follows reads the blocks more than once.
    return pieces.repartition(_parts(pieces), "cell").sortWithinPartitions("cell").mapInArrow(gather, _ROW).repartition("b"), filled


def _pieces(rows: np.ndarray, starts: np.ndarray) -> pa.Array:
    """Bytes of the rows from each start to the next."""
    at = (np.append(starts, len(rows)) * rows.itemsize).astype(np.int32)
    return pa.Array.from_buffers(pa.binary(), len(starts), [None, pa.py_buffer(at), pa.py_buffer(rows.tobytes())])


def _boxes(column) -> tuple[np.ndarray, ...]:
    """Numbers and boxes of all blocks, in order."""
    flat = column.values
    boxes = [pickle.loads(x.as_buffer()) for x in flat.field("box")]
    return flat.field("b").to_numpy(), np.array([x[0] for x in boxes], np.float64), np.array([x[1] for x in boxes], np.float64)


def _parts(frame: DataFrame) -> int:
    """How many parts what takes long to work on is dealt out to. Joined by their bytes they are few and leave cores idle; all of
    the session's parts cost more to start in Python than they hold."""
    return max(1, int(frame.sparkSession.conf.get("spark.sql.shuffle.partitions")) // 4)


def _met(blocks: DataFrame, sent: DataFrame) -> DataFrame:
    """Blocks, each followed by the queries sent to it."""
    return blocks.union(sent).repartition(_parts(blocks), "b").sortWithinPartitions("b", "kind")


def _meetings(batches):
    """Each block with the queries that were sent to it, QUERY_BLOCK or a few more at a time."""
    b, block, held = None, None, []

    def all_of():
        return tuple(np.concatenate([h[c] for h in held]) for c in range(3))

    for batch in batches:
        for number, kind, content in zip(batch.column(0).to_pylist(), batch.column(1).to_pylist(), batch.column(3), strict=True):
            if held and (kind == 0 or sum(len(h[0]) for h in held) >= QUERY_BLOCK):
                yield b, block, *all_of()
                held = []
            if kind == 0:
                b, block = number, pickle.loads(content.as_buffer())
            else:
                held.append(pickle.loads(content.as_buffer()))
    if held:
        yield b, block, *all_of()


def _routed(refs: DataFrame | Packed, queries: DataFrame | Every | Packed, first: list[str], rest: list[str], k: int, flag: str | None) -> tuple[DataFrame, DataFrame]:
    """The blocks of the references, and each of them with the queries that may have one of their k nearest in it."""
    split, step = len(first), queries.step if isinstance(queries, Every) else 0
    blocks, filled = _dealt(refs, first, rest, flag)

    def boxed(batches):
        for batch in batches:
            yield batch.select(["b", "box"])

    # In Python, as it takes whole rows: an aggregate of two columns would have the blocks made once more without the others.
    boxes = F.broadcast(blocks.mapInArrow(boxed, "b long, box binary").agg(F.collect_list(F.struct("b", "box")).alias("boxes")))

    def gathered(parts):
        """(ids, values, limits) in rows of QUERY_BLOCK or a few more."""
        held = []
        for part in parts:
            if len(part[0]):
                held.append(part)
            if sum(len(h[0]) for h in held) >= QUERY_BLOCK:
                yield _row(0, 1, tuple(np.concatenate([h[c] for h in held]) for c in range(3)))
                held = []
        if held:
            yield _row(0, 1, tuple(np.concatenate([h[c] for h in held]) for c in range(3)))

    def bounded(block, qids, q, limit):
        return qids, q, np.minimum(limit, block.bound(qids, q, k, split))

    def own(batches):
        def parts():
            for batch in batches:
                for content in batch.column(3):
                    block = pickle.loads(content.as_buffer())
                    mine = np.flatnonzero(block.ids % step == 0)
                    yield bounded(block, block.ids[mine], block.values[mine], np.full(len(mine), np.inf))

        return gathered(parts())

    def bound(batches):
        return gathered(bounded(block, qids, q, limit) for _, block, qids, q, limit in _meetings(batches))

    def nearest_box(batches):
        for batch in batches:
            for content, column in zip(batch.column(0), batch.column(1), strict=True):
                b, low, high = _boxes(column)
                qids, _, q = _unpacked(content.as_buffer())
                if len(b):
                    yield from sent(qids, q, np.full(len(qids), np.inf), b, _apart(q[:, :split].astype(np.float64), low, high).argmin(axis=1)[:, None] == np.arange(len(b))[None])

    def within(batches):
        boxes_ = None
        for batch in batches:
            for content, column in zip(batch.column(0), batch.column(1), strict=True):
                b, low, high = boxes_ = boxes_ or _boxes(column)  # the same for all
                qids, q, limit = pickle.loads(content.as_buffer())
                yield from sent(qids, q, limit, b, _apart(q[:, :split].astype(np.float64), low, high) <= limit[:, None])

    def sent(qids, q, limit, b, to):
        # All in one batch, as each costs more than what it holds.
        block, query = np.nonzero(to.T)
        starts = np.flatnonzero(np.append(True, np.diff(block) > 0)) if len(block) else np.zeros(0, np.int64)
        qids, q, limit = qids[query], _narrow(q)[query], limit[query]
        rows = [pickle.dumps((qids[i:j], q[i:j], limit[i:j]), 5) for i, j in zip(starts, np.append(starts[1:], len(block)), strict=True)]
        if rows:
            none = pickle.dumps(None, 5)
            yield pa.RecordBatch.from_arrays([pa.array(b[block[starts]], pa.int64()), pa.array(np.ones(len(rows), np.int32)), pa.array([none] * len(rows), pa.binary()), pa.array(rows, pa.binary())], names=["b", "kind", "box", "content"])

    if isinstance(queries, Every):
        bounds = blocks.mapInArrow(own, _ROW)
    else:
        asked = filled(queries) if isinstance(queries, Packed) else _packed(queries, "qid", first + rest, None, QUERY_BLOCK)
        bounds = _met(blocks, asked.select("content").crossJoin(boxes).mapInArrow(nearest_box, _ROW)).mapInArrow(bound, _ROW)
    return blocks, _met(blocks, bounds.select("content").crossJoin(boxes).mapInArrow(within, _ROW))


def _scan(refs: DataFrame | Packed, queries: DataFrame | Every | Packed, first: list[str], rest: list[str], k: int, flag: str | None = "is_fraud") -> DataFrame:
    """qid, ref_id, is_fraud, da, d: of each block that may hold one of a query's k nearest by the columns ``first``, the k nearest.

    d is the distance by all columns. A reference isn't a neighbour of the query with its id.
    """
    if not isinstance(refs, Packed) and dict(refs.dtypes)[first[0]].startswith("array"):
        return _all_blocks(refs, queries, first, k, flag)
    split = len(first)

    def run(batches):
        for _, block, qids, q, limit in _meetings(batches):
            row, column, near = block.search(qids, q, limit, k, split)
            full = near + ((q[row, split:].astype(np.float64) - block.values[column, split:]) ** 2).sum(axis=1)
            yield pa.RecordBatch.from_arrays([pa.array(qids[row]), pa.array(block.ids[column]), pa.array(block.flags[column].astype(bool)), pa.array(near, pa.int64(), safe=False), pa.array(full, pa.int64(), safe=False)], names=["qid", "ref_id", "is_fraud", "da", "d"])

    _, met = _routed(refs, queries, first, rest, k, flag)
    return met.mapInArrow(run, "qid long, ref_id long, is_fraud boolean, da long, d long")


def _all_blocks(refs: DataFrame | Packed, queries: DataFrame | Every | Packed, first: list[str], k: int, flag: str | None) -> DataFrame:
    """The same for one column of double vectors: each block of queries meets each block of references; da and d are one."""

    def run(batches):
        limits: dict[tuple[int, int], np.ndarray] = {}
        for batch in batches:
            for key, query, ref in zip(batch.column(0).to_pylist(), batch.column(1), batch.column(2), strict=True):
                qids, _, q = _unpacked(query.as_buffer())
                rids, flags, r = _unpacked(ref.as_buffer())
                limit = limits.setdefault((key, len(qids)), np.full(len(qids), np.inf))
                if len(limits) > REMEMBERED:
                    limits.pop(next(iter(limits)))
                step = max(1, TILE // max(len(rids), 1))
                for s in range(0, len(qids), step):
                    d = _squares(q[s : s + step], r, True)
                    d[qids[s : s + step][:, None] == rids[None]] = np.inf
                    row, column = _best(d, rids, k, limit[s : s + step])
                    near = pa.array(d[row, column])
                    yield pa.RecordBatch.from_arrays([pa.array(qids[s + row]), pa.array(rids[column]), pa.array(flags[column].astype(bool)), near, near], names=["qid", "ref_id", "is_fraud", "da", "d"])

    blocks = _packed(refs, "ref_id", first, flag, REF_BLOCK)
    asked = _own(blocks, queries.step) if isinstance(queries, Every) else _packed(queries, "qid", first, None, QUERY_BLOCK)
    pairs = blocks.select(F.col("content").alias("ref")).crossJoin(asked.select(F.col("b").alias("qb"), F.col("content").alias("query")))
    return pairs.select("qb", "query", "ref").mapInArrow(run, "qid long, ref_id long, is_fraud boolean, da double, d double")


def exact(queries: DataFrame | Every | Packed, refs: DataFrame | Packed, k: int = K, strategy: str = "arrow", dims: int = DIMS) -> DataFrame:
    """qid, ref_id, is_fraud, d, rank of the k nearest quantised references."""
    look = _scan if strategy == "arrow" else _pairs
    return nearest(look(refs, queries, names(dims), [], k).select("qid", "ref_id", "is_fraud", "d"), k, ["d", "ref_id"])


def _pairs(refs: DataFrame | Packed, queries: DataFrame | Every | Packed, first: list[str], rest: list[str], k: int, flag: str | None = "is_fraud") -> DataFrame:
    """The same as ``_scan``, by a join of queries and references by leaf: both distances are unrolled expressions."""
    split, columns = len(first), first + rest
    number = lambda block, b: np.repeat(b * 1024 + np.arange(len(block.low)), np.diff(block.cuts))

    def rows(batches):
        for batch in batches:
            for b, content in zip(batch.column(0).to_pylist(), batch.column(3), strict=True):
                block = pickle.loads(content.as_buffer())
                yield pa.RecordBatch.from_arrays([pa.array(number(block, b)), pa.array(block.ids), pa.array(block.flags.astype(bool)), *(pa.array(block.values[:, c].astype(np.int32)) for c in range(len(columns)))], names=["leaf", "ref_id", "is_fraud", *columns])

    def asked(batches):
        for b, block, qids, q, limit in _meetings(batches):
            for leaf in range(len(block.low)):
                own = np.flatnonzero(_apart(q[:, :split].astype(np.float64), block.low[leaf : leaf + 1], block.high[leaf : leaf + 1])[:, 0] <= limit)
                if len(own):
                    yield pa.RecordBatch.from_arrays([pa.array(np.full(len(own), b * 1024 + leaf)), pa.array(qids[own]), pa.array(limit[own]), *(pa.array(q[own, c].astype(np.int32)) for c in range(len(columns)))], names=["leaf", "qid", "most", *("x" + c for c in columns)])

    kinds = lambda prefix: ", ".join(f"{prefix}{c} int" for c in columns)
    blocks, met = _routed(refs, queries, first, rest, k, flag)
    left = blocks.mapInArrow(rows, "leaf long, ref_id long, is_fraud boolean, " + kinds(""))
    right = met.mapInArrow(asked, "leaf long, qid long, most double, " + kinds("x"))
    da, db = (squared_distance([F.col("x" + c) for c in part], [F.col(c) for c in part]) for part in (first, rest))
    pairs = left.join(right, "leaf").where("qid <> ref_id").select("qid", "ref_id", "is_fraud", "most", da.alias("da"), (da + db).alias("d"))
    return pairs.where("da <= most").drop("most")


def prune(queries: DataFrame | Every | Packed, refs: DataFrame | Packed, prune_to: int = PRUNE, strategy: str = "arrow") -> DataFrame:
    """The candidates of the first pass: nearest by the features of block A."""
    rest = [i for i in range(DIMS) if i not in BLOCK_A]
    look = _scan if strategy == "arrow" else _pairs
    return nearest(look(refs, queries, names(BLOCK_A), names(rest), prune_to), prune_to, ["da", "ref_id"])


def two_stage(queries: DataFrame | Every | Packed, refs: DataFrame | Packed, k: int = K, prune_to: int = PRUNE, strategy: str = "arrow") -> DataFrame:
    """Filter and refine: of the candidates the k nearest by all features. Equal to ``exact`` only where certified."""
    return nearest(prune(queries, refs, prune_to, strategy).drop("rank"), k, ["d", "da", "ref_id"])


def certificate(queries: DataFrame | Every | Packed, refs: DataFrame | Packed, k: int = K, prune_to: int = PRUNE, strategy: str = "arrow") -> DataFrame:
    """qid, certified: whether the two-stage answer is provably exact, as partial distances never exceed full ones."""
    place = F.row_number().over(Window.partitionBy("qid").orderBy("d", "da", "ref_id"))
    placed = prune(queries, refs, prune_to, strategy).withColumn("place", place)
    # One pass: two aggregates of the candidates, joined, would search twice.
    kept = placed.groupBy("qid").agg(F.count(F.lit(1)).alias("n"), F.max("da").alias("last_da"), F.max(F.when(F.col("place") <= k, F.col("d"))).alias("kth_d"))
    return kept.select("qid", ((F.col("n") < prune_to) | (F.col("kth_d") < F.col("last_da"))).alias("certified"))


def exact_float(queries: DataFrame | Every | Packed, refs: DataFrame | Packed, k: int = K) -> DataFrame:
    """qid, ref_id, d, rank by squared distance of double vectors of any one length (columns qid, vector; ref_id, vector).

    Rows with a null vector are left out. A reference isn't a neighbour of the query with its id.
    """
    return nearest(_scan(refs, queries, ["vector"], [], k, None).select("qid", "ref_id", "d"), k, ["d", "ref_id"])


def topk(frame: DataFrame, key: str, value: str, item: str, k: int = K) -> DataFrame:
    """The k smallest values of each key; of equal ones those with the smallest id were first and stay."""
    window = Window.partitionBy(key).orderBy(value, item)
    return frame.withColumn("rank", F.row_number().over(window)).where(F.col("rank") <= k)


def worst_distance(kept: DataFrame, k: int = K) -> DataFrame:
    """The distance a new neighbour must beat: the k-th, or infinity while there are fewer."""
    return kept.groupBy("qid").agg(F.when(F.count(F.lit(1)) >= k, F.max("d").cast("double")).otherwise(F.lit(float("inf"))).alias("worst"))
