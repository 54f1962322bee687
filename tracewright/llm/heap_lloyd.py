"""Vector code compression: product quantisation whose Lloyd rounds rescan only what they must.

Vectors of whole numbers, floor(1024 x), are cut into PARTS parts; each part position has a codebook of at most
ENTRIES entries. Vectors lie in blocks of up to BLOCK, and each block keeps, for each part position and
entry, a heap of the parts assigned to it, keyed by lower minus upper bound: distance to the second nearest
entry less distance to the nearest. When entries move, the slack of all parts of an entry shrinks by at most
its own way and the longest way of the others. Such drifts are added up for each entry, not taken off each
key: a part is pushed with its slack plus the drift so far, and popped once the drift has reached its key. Only popped
parts are measured again, against all entries and exactly; the others keep their entry (Hamerly and Drake, 2015).

A round is one pass over a written table of blocks, so it survives lost executors; blocks report the change
of sums and counts of each entry, which Spark adds up. The driver holds codebooks and those sums: PARTS
times ENTRIES rows, however many vectors there are.

Defined results: rows whose vector is null, empty, holds null or non-finite components or is of another length
than the most common one (ties: the longer) are left out; null vec_ids come last in order, repeated ones by
vector; fewer than ENTRIES vectors make as many entries; a length that PARTS does not divide is cut at floor(i * length /
PARTS); ties go to the lower entry, so of equal entries only the first is used; sums beyond 64 bits are added up
in limbs, and an error beyond a long is null, as is its label's; an empty table gives an empty table; other columns are not read.
"""

from __future__ import annotations

import hashlib
import heapq
import json
import math

import numpy as np
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from tracewright.session import ship

from .common import discard, if_small, materialize, table

PARTS, ENTRIES, ROUNDS, FACTOR = 4, 256, 4, 1024
#: Vectors of a block; bits of a limb of a sum.
BLOCK, LIMB = 4096, 30
#: Whole floats add and multiply exactly below this.
EXACT = 1 << 53
STATE = "data binary, exact boolean, keys binary, members binary, sizes binary, changes string, rescanned long"


def cuts(length: int) -> list[int]:
    return [i * length // PARTS for i in range(PARTS + 1)]


def whole_numbers(x: np.ndarray) -> np.ndarray:
    """floor(FACTOR * x) of finite doubles: as floats where they stay exact, else as Python's integers."""
    if not x.size or np.abs(x).max() < EXACT // FACTOR:
        return np.floor(x * FACTOR)
    return np.array([[int(v) * FACTOR if abs(v) >= EXACT else math.floor(v * FACTOR) for v in row] for row in x.tolist()], dtype=object).reshape(x.shape)


def fits(x: np.ndarray, y: np.ndarray) -> bool:
    """Whether squared distances of rows of x and y are exact in floats."""
    most = max((int(abs(v).max()) for v in (x, y) if v.size), default=0)
    return x.dtype != object and y.dtype != object and 4 * max(1, x.shape[1]) * most * most < EXACT


def wide(x: np.ndarray) -> np.ndarray:
    return x if x.dtype == object else np.array([[int(v) for v in row] for row in x.tolist()], dtype=object).reshape(x.shape)


def root(d: int) -> float:
    return float(min(math.isqrt(d), 10**300)) if d >= EXACT else math.sqrt(d)


def scan(x: np.ndarray, entries: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    """For each part its nearest entry, by exact distances, and a lower bound of its slack."""
    best, slack = np.zeros(len(x), np.int64), np.full(len(x), np.inf)
    exact = fits(x, entries)
    if exact:
        norms = (entries * entries).sum(axis=1)
        d = (x * x).sum(axis=1)[:, None] - 2 * (x @ entries.T) + norms
    else:
        a, b = wide(x), wide(entries)
        d = np.array([[int(((p - e) ** 2).sum()) for e in b] for p in a], dtype=object).reshape(len(a), len(b))
    if len(x):
        best = np.array(d.argmin(axis=1), np.int64)
    if len(entries) > 1 and len(x):
        rows = np.arange(len(x))
        first = d[rows, best].copy()
        d[rows, best] = np.inf if exact else d.max() + 1
        second = d.min(axis=1)
        lower, upper = (np.sqrt(second), np.sqrt(first)) if exact else (np.array([root(v) for v in y]) for y in (second, first))
        slack = lower * (1 - 1e-12) - upper * (1 + 1e-12)
    return best, slack


def rounded_down(keys: np.ndarray) -> np.ndarray:
    out = np.clip(keys, -3e38, np.inf).astype(np.float32)
    return np.where(out > keys, np.nextafter(out, np.float32(-np.inf)), out)


class Block:
    """Vectors with a heap of (key, row) for each part position and entry."""

    def __init__(self, x: np.ndarray, books: list[np.ndarray]):
        self.x, self.at = x, cuts(x.shape[1])
        self.heaps = [[[] for _ in book] for book in books]
        self.rescanned = 0

    def part(self, p: int) -> np.ndarray:
        return self.x[:, self.at[p] : self.at[p + 1]]

    def settle(self, books: list[np.ndarray], drift: list[np.ndarray], fresh: bool = False) -> dict[str, list[int]]:
        """Pops the parts whose keys the drift has reached (all, if fresh), measures them again and pushes
        them; gives the change of each entry as [count, sums]."""
        changes = {}
        for p, book in enumerate(books):
            heaps, part = self.heaps[p], self.part(p)
            rows, was = list(range(len(part))) if fresh else [], []
            for entry, heap in enumerate(heaps):
                while heap and heap[0][0] <= drift[p][entry]:
                    rows.append(heapq.heappop(heap)[1])
                    was.append(entry)
            best, slack = scan(part[rows], book)
            self.rescanned += len(rows)
            keys = rounded_down(slack + drift[p][best])
            for key, row, entry in zip(keys.tolist(), rows, best.tolist(), strict=True):
                heapq.heappush(heaps[entry], (key, row))
            old = np.array(was, np.int64)
            moved = np.arange(len(rows)) if fresh else np.flatnonzero(best != old)
            if len(moved):
                exact = part.dtype != object and int(np.abs(part).max(initial=0)) * len(part) < EXACT
                x = part[rows][moved] if exact else wide(part[rows][moved])
                sums = np.zeros((len(book), x.shape[1]), x.dtype)
                counts = np.zeros(len(book), np.int64)
                for entries, sign in ((best[moved], 1),) if fresh else ((best[moved], 1), (old[moved], -1)):
                    np.add.at(sums, entries, sign * x)
                    np.add.at(counts, entries, sign)
                touched = np.unique(best[moved] if fresh else np.append(best[moved], old[moved]))
                for entry in touched.tolist():
                    changes[f"{p * ENTRIES + entry}"] = [int(counts[entry]), *(int(v) for v in sums[entry])]
        return changes

    def assigned(self, p: int) -> np.ndarray:
        out = np.zeros(len(self.x), np.int64)
        for entry, heap in enumerate(self.heaps[p]):
            out[[row for _, row in heap]] = entry
        return out

    def errors(self, books: list[np.ndarray]) -> list[int | None]:
        total = [0] * len(self.x)
        for p, book in enumerate(books):
            x, e = self.part(p), book[self.assigned(p)]
            if not fits(x, e):
                x, e = wide(x), wide(e)
            total = [t + int(d) for t, d in zip(total, ((x - e) ** 2).sum(axis=1), strict=True)]
        return [t if t < 1 << 63 else None for t in total]

    def flat(self) -> dict:
        """The heaps as flat arrays, in heap order."""
        flat = [pair for heaps in self.heaps for heap in heaps for pair in heap]
        return {
            "keys": np.array([k for k, _ in flat], np.float32).tobytes(), "members": np.array([m for _, m in flat], np.int16).tobytes(),
            "sizes": np.array([len(heap) for heaps in self.heaps for heap in heaps], np.int16).tobytes(), "rescanned": self.rescanned,
        }

    def load(self, keys: bytes, members: bytes, sizes: bytes) -> Block:
        pairs = list(zip(np.frombuffer(keys, np.float32).tolist(), np.frombuffer(members, np.int16).tolist(), strict=True))
        end, lengths = 0, iter(np.frombuffer(sizes, np.int16).tolist())
        for heaps in self.heaps:
            for entry in range(len(heaps)):
                start, end = end, end + next(lengths)
                heaps[entry] = pairs[start:end]
        return self


def packed(x: np.ndarray) -> tuple[bytes, bool]:
    """Doubles as the whole numbers they stand for, in two bytes each, where those are small; else as they are."""
    n = whole_numbers(x)
    small = n.dtype != object and (not n.size or np.abs(n).max() < 1 << 15)
    return (n.astype(np.int16) if small else x).tobytes(), bool(small)


def unpacked(data: bytes, small: bool, length: int) -> np.ndarray:
    if small:
        return np.frombuffer(data, np.int16).reshape(-1, length).astype(np.float64)
    return whole_numbers(np.frombuffer(data, np.float64).reshape(-1, length))


def blocks_of(rows: DataFrame, length: int, books: list, drift: list) -> DataFrame:
    """Blocks of vectors, measured for the first time: lists of vec_id and label, and STATE."""
    ship(rows.sparkSession)
    kinds = [rows.schema[c].dataType.simpleString() for c in ("vec_id", "label")]

    def work(batches):
        import pyarrow as pa

        def block(parts):
            t = pa.Table.from_batches(parts).combine_chunks()
            x = t.column("embedding").combine_chunks().flatten().to_numpy(zero_copy_only=False).reshape(-1, length)
            data, small = packed(x)
            made = Block(unpacked(data, small, length), books)
            changes = made.settle(books, drift, fresh=True)
            lists = [pa.ListArray.from_arrays(pa.array([0, len(t)], pa.int32()), t.column(c).combine_chunks()) for c in ("vec_id", "label")]
            state = {"data": data, "exact": small, **made.flat(), "changes": json.dumps(changes)}
            names = [x.split()[0] for x in STATE.split(", ")]
            kinds = {"exact": pa.bool_(), "changes": pa.string(), "rescanned": pa.int64()}
            return pa.RecordBatch.from_arrays(lists + [pa.array([state[n]], kinds.get(n, pa.binary())) for n in names], ["vec_ids", "labels", *names])

        held, n = [], 0
        for batch in batches:
            while batch.num_rows:
                part = batch.slice(0, BLOCK - n)
                batch = batch.slice(part.num_rows)
                held.append(part)
                n += part.num_rows
                if n == BLOCK:
                    yield block(held)
                    held, n = [], 0
        if held:
            yield block(held)

    return rows.select("vec_id", "label", "embedding").mapInArrow(work, f"vec_ids array<{kinds[0]}>, labels array<{kinds[1]}>, {STATE}")


def settled(blocks: DataFrame, length: int, books: list, drift: list) -> DataFrame:
    """Blocks after the entries have moved."""

    def work(batches):
        import pyarrow as pa

        for batch in batches:
            out = {name: [] for name in ("keys", "members", "sizes", "changes", "rescanned")}
            for row in batch.select(["data", "exact", "keys", "members", "sizes"]).to_pylist():
                block = Block(unpacked(row["data"], row["exact"], length), books).load(row["keys"], row["members"], row["sizes"])
                out["changes"].append(json.dumps(block.settle(books, drift)))
                for name, value in block.flat().items():
                    out[name].append(value)
            columns = [pa.array(out[n], pa.int64() if n == "rescanned" else batch.schema.field(n).type) if n in out else batch.column(n) for n in batch.schema.names]
            yield pa.RecordBatch.from_arrays(columns, batch.schema.names)

    return blocks.mapInArrow(work, blocks.schema)


def coded(blocks: DataFrame, length: int, books: list, drift: list) -> DataFrame:
    """vec_id, label, code, error of each vector, after the entries have moved for the last time."""
    kinds = [blocks.schema[c].dataType.elementType.simpleString() for c in ("vec_ids", "labels")]

    def work(batches):
        import pyarrow as pa

        for batch in batches:
            for i, row in enumerate(batch.select(["data", "exact", "keys", "members", "sizes"]).to_pylist()):
                block = Block(unpacked(row["data"], row["exact"], length), books).load(row["keys"], row["members"], row["sizes"])
                block.settle(books, drift)
                entries = np.stack([block.assigned(p) for p in range(PARTS)], axis=1).astype(np.uint8)
                lists = [batch.column(c).slice(i, 1).flatten() for c in ("vec_ids", "labels")]
                yield pa.RecordBatch.from_arrays([*lists, pa.array([bytes(e).hex() for e in entries]), pa.array(block.errors(books), pa.int64())], ["vec_id", "label", "code", "error"])

    return blocks.mapInArrow(work, f"vec_id {kinds[0]}, label {kinds[1]}, code string, error long")


def summed(blocks: DataFrame) -> dict[tuple[int, int], int]:
    """(entry over all parts, position) -> change; position 0 is the count. Sums cross Spark in limbs of LIMB bits."""

    def work(batches):
        import pyarrow as pa

        total: dict = {}
        for batch in batches:
            for changes in batch.column(0).to_pylist():
                for at, numbers in json.loads(changes).items():
                    held = total.setdefault(int(at), [0] * len(numbers))
                    total[int(at)] = [a + b for a, b in zip(held, numbers, strict=True)]
        rows = []
        for at, numbers in total.items():
            for position, value in enumerate(numbers):
                left, limb, sign = abs(value), 0, 1 if value > 0 else -1
                while left:
                    rows.append((at, position, limb, sign * (left & ((1 << LIMB) - 1))))
                    left, limb = left >> LIMB, limb + 1
        columns = list(zip(*rows, strict=True)) or [(), (), (), ()]
        yield pa.RecordBatch.from_arrays([pa.array(c, t) for c, t in zip(columns, (pa.int32(), pa.int32(), pa.int32(), pa.int64()), strict=True)], ["at", "position", "limb", "value"])

    parts = blocks.select("changes").mapInArrow(work, "at int, position int, limb int, value long")
    out: dict = {}
    for r in parts.groupBy("at", "position", "limb").agg(F.sum("value").alias("value")).collect():
        out[r["at"], r["position"]] = out.get((r["at"], r["position"]), 0) + (r["value"] << (LIMB * r["limb"]))
    return out


class Books:
    """Codebooks as whole numbers, with the sums and counts of their parts and the drift so far."""

    def __init__(self, first: np.ndarray):
        at = cuts(first.shape[1])
        self.entries = [[[int(v) for v in row] for row in first[:, at[p] : at[p + 1]]] for p in range(PARTS)]
        self.totals: dict[tuple[int, int], int] = {}
        self.drift = [np.zeros(len(first)) for _ in range(PARTS)]

    def arrays(self) -> list[np.ndarray]:
        out = []
        for book in self.entries:
            big = max((abs(v) for e in book for v in e), default=0) >= EXACT
            out.append(np.array(book, dtype=object if big else np.float64).reshape(len(book), -1))
        return out

    def move(self, changes: dict[tuple[int, int], int]) -> None:
        for at, value in changes.items():
            self.totals[at] = self.totals.get(at, 0) + value
        for p, book in enumerate(self.entries):
            ways = np.zeros(len(book))
            for entry, old in enumerate(book):
                number = p * ENTRIES + entry
                count = self.totals.get((number, 0), 0)
                if count:
                    new = [self.totals.get((number, i + 1), 0) // count for i in range(len(old))]
                    way = sum((a - b) ** 2 for a, b in zip(new, old, strict=True))
                    ways[entry] = (math.sqrt(way) if way < EXACT else root(way) + 1) * (1 + 1e-12)
                    book[entry] = new
            if len(ways) > 1:
                top = np.sort(ways)[-2:]
                others = np.where(np.arange(len(ways)) == int(ways.argmax()), top[0], top[1])
                self.drift[p] = (self.drift[p] + ways + others) * (1 + 1e-12)

    def digest(self) -> str:
        return hashlib.sha256(",".join(str(v) for book in self.entries for e in book for v in e).encode()).hexdigest()


def compressed(vectors: DataFrame, rounds: int = ROUNDS) -> tuple[DataFrame, Books | None]:
    """(vec_id, label, code, error of every vector that takes part; the codebooks)."""
    number = F.col("embedding").cast("array<double>")
    sound = F.forall("embedding", lambda v: v.isNotNull() & (F.abs(v) < F.lit(float("inf"))))
    rows = vectors.select("vec_id", "label", number.alias("embedding")).where("size(embedding) > 0").where(sound)
    size = F.size("embedding").alias("length")
    length = rows.groupBy(size).count().orderBy(F.desc("count"), F.desc("length")).first()
    if length is None:
        return rows.select("vec_id", "label", F.lit("").alias("code"), F.lit(0).cast("long").alias("error")), None
    length = length["length"]
    rows = rows.where(F.size("embedding") == length)
    first = rows.orderBy(F.asc_nulls_last("vec_id"), "embedding").select("embedding").limit(ENTRIES).collect()
    books = Books(whole_numbers(np.array([r[0] for r in first], np.float64)))
    blocks = materialize(blocks_of(rows, length, books.arrays(), books.drift), "blocks", compression="zstd")
    for i in range(rounds):
        books.move(summed(blocks))
        if i < rounds - 1:
            after = materialize(settled(blocks, length, books.arrays(), books.drift), "blocks", compression="zstd")
            discard(blocks)
            blocks = after
    out = materialize(coded(blocks, length, books.arrays(), books.drift), "codes")
    discard(blocks)
    return out, books


def query(spark, sf_dir):
    codes, books = compressed(table(spark, sf_dir, "embeddings").select("vec_id", "label", "embedding"))
    of_label = F.when(F.count("error") == F.count(F.lit(1)), F.try_sum("error"))
    sums = if_small(materialize(codes.groupBy(F.col("label").alias("__label")).agg(of_label.alias("label_error")), "label-errors"))
    out = codes.join(sums, codes["label"].eqNullSafe(sums["__label"]))
    return out.select("vec_id", "code", "error", "label_error", F.lit(books.digest() if books else "").alias("codebooks_sha256"))


def _sql() -> str:
    steps = []
    for i in range(ROUNDS + 1):
        steps.append(f"""a{i} as (select rid, part, min(d * 256 + entry) m from
            (select rid, part, entry, sum((l.x - c.x) * (l.x - c.x)) d from l join c{i} c using (part, i) group by all) group by all)""")
        if i < ROUNDS:
            steps.append(f"""u{i} as (select part, m % 256 entry, i, sum(x) s, count(*) n from a{i} join l using (rid, part) group by all)""")
            steps.append(f"""c{i + 1} as (select c.part, c.entry, c.i, coalesce((s - ((s % n) + n) % n) // n, c.x) x from c{i} c left join u{i} using (part, entry, i))""")
    return f"""
with k as (select vec_id, label, cast(embedding as double[]) e, row_number() over () rid from embeddings
           where len(embedding) > 0 and len([x for x in embedding if x is null or not isfinite(x)]) = 0),
v as (select * from k where len(e) = (select len(e) from k group by len(e) order by count(*) desc, len(e) desc limit 1)),
n as (select rid, len(e) size, unnest(range(0, len(e))) i, unnest(e) y from v),
l as (select rid, [p for p in range(0, {PARTS}) if i >= p * size // {PARTS} and i < (p + 1) * size // {PARTS}][1] part, i, cast(floor({FACTOR} * y) as hugeint) x from n),
f as (select rid, row_number() over (order by vec_id nulls last, e) - 1 entry from v),
c0 as (select part, entry, i, x from l join f using (rid) where entry < {ENTRIES}),
{", ".join(steps)},
o as (select rid, string_agg(printf('%02x', cast(m % 256 as integer)), '' order by part) code, sum(m // 256) error from a{ROUNDS} group by rid),
s as (select sha256(string_agg(cast(x as varchar), ',' order by part, entry, i)) h from c{ROUNDS})
select vec_id, code, cast(error as bigint) error, cast(sum(error) over (partition by label) as bigint) label_error, h codebooks_sha256 from o join v using (rid), s
"""


SQL = _sql()
