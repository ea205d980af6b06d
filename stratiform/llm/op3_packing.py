"""Best-fit packing of documents into fixed-length sequences by bin completion."""

from __future__ import annotations

import zlib
from bisect import bisect_left, bisect_right, insort
from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame, SparkSession, Window, functions as F

from stratiform.llm.common import documents, materialize, slices
from stratiform.llm.tokenize import ByteLevelIds

TOKENIZER = "byte_bpe_50k.json"
CAPACITY = 2048
BLOCKS = 64
#: Fillings that a node of the search branches into, and nodes it may enter.
BRANCHES, NODES = 8, 2000


def tokenized_pieces(docs: DataFrame, tokenizer: str = TOKENIZER, capacity: int = CAPACITY, end: int = 0) -> DataFrame:
    """Encode whole texts (null: empty), close each with ``end`` and cut those beyond ``capacity``.

    All pieces but the first are full, so that every document leaves one remainder at most.
    """

    def encode(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        encoder = ByteLevelIds(tokenizer, end)
        for batch in batches:
            for part in slices(batch, "text"):
                ids, n = encoder.encode(part.column("text").to_pylist())
                pieces = -(-n // capacity)
                doc = np.repeat(np.arange(len(n)), pieces)
                piece = np.arange(len(doc)) - np.repeat(np.cumsum(pieces) - pieces, pieces)
                head = n - (pieces - 1) * capacity
                start = np.where(piece == 0, 0, head[doc] + (piece - 1) * capacity)
                length = np.where(piece == 0, head[doc], capacity)
                at = start + (np.cumsum(n) - n)[doc]
                data = memoryview(ids.astype("<u4").tobytes())
                crc = [zlib.crc32(data[4 * a : 4 * (a + k)]) for a, k in zip(at.tolist(), length.tolist())]
                yield pa.RecordBatch.from_arrays(
                    [part.column("doc_id").take(pa.array(doc)), pa.array(piece, pa.int32()), pa.array(start, pa.int64()), pa.array(length, pa.int64()), pa.array(crc, pa.int64())],
                    ["doc_id", "piece", "start", "length", "ids_crc32"],
                )

    return docs.select(F.col("doc_id").cast("long").alias("doc_id"), F.coalesce("text", F.lit("")).alias("text")).mapInArrow(
        encode, "doc_id long, piece int, start long, length long, ids_crc32 long"
    )


Filling = list[tuple[int, int]]


def plan_bins(counts: dict[int, int], capacity: int, budget: int = NODES) -> list[tuple[int, Filling]]:
    """Fill bins from a histogram of sizes: [(how many bins, [(size, how many of it in each)])].

    Bin completion: the largest size left opens a bin, and its undominated fillings are the
    branches, that of least waste first, each repeated as often as the counts allow or else once.
    Best-fit decreasing, then the best plan so far is the incumbent. A branch is cut where what it
    has wasted leaves no plan of fewer bins than the incumbent. The search ends at a lower bound, when
    all branches are done, or after ``budget`` nodes; then the incumbent stands, so the budget
    bears upon the number of bins only. Work depends on the number of sizes (``capacity`` at most)
    and the budget, not on the number of documents.
    """
    counts = {s: c for s, c in counts.items() if c}
    bound = lower_bound(counts, capacity)
    best = _best_fit(counts, capacity)
    size = sum(n for n, _ in best)
    share = min(counts.values(), default=1)
    if share > 1 and size > bound:  # a plan of one part of the sizes, as often as it goes into them
        rest = plan_bins({s: c % share for s, c in counts.items()}, capacity, budget)
        parts = [(n * share, f) for n, f in plan_bins({s: c // share for s, c in counts.items()}, capacity, budget)] + rest
        if sum(n for n, _ in parts) < size:
            size, best = sum(n for n, _ in parts), parts
    total = sum(s * c for s, c in counts.items())
    # a branch: sizes left, wasted room, plan so far as a chain (how many, filling, the chain before), its bins, and what to do next
    stack: list[tuple] = [(counts, 0, None, 0, 0, [])]
    nodes = 0
    while stack and size > bound and (nodes < budget or not nodes):
        left, waste, chain, used, n, filling = stack.pop()
        left = dict(left)
        order = sorted(left)
        while True:
            if n:
                chain, used, waste = (n, filling, chain), used + n, waste + n * (capacity - sum(s * m for s, m in filling))
                for s, m in filling:
                    left[s] -= n * m
                    if not left[s]:
                        del left[s], order[bisect_left(order, s)]
            spare = (size - 1) * capacity - total - waste
            if not left or spare < 0:
                break
            nodes += 1
            branches = []
            for f in fillings(left, order, capacity, spare, BRANCHES if nodes < budget else 1):
                lost = capacity - sum(s * m for s, m in f)
                often = min(left[s] // m for s, m in f)
                branches += [(k, f) for k in ((often, 1) if often > 1 else (1,)) if k * lost <= spare]
            if not branches:
                break
            if nodes < budget and len(branches) > 1:  # the best one next, the others wait
                now = dict(left)
                stack += [(now, waste, chain, used, k, f) for k, f in branches[:0:-1]]
            n, filling = branches[0]
        if not left and spare >= 0 and used < size:
            size, best = used, []
            while chain:
                best.append(chain[:2])
                chain = chain[2]
    return best


def lower_bound(counts: dict[int, int], capacity: int) -> int:
    """Bins that any plan needs: by total size, and by the sizes beyond half a bin with those that cannot join them."""
    n = np.zeros(capacity + 2, np.int64)
    for s, c in counts.items():
        n[s] = c
    size = np.arange(capacity + 2)
    big = 2 * size > capacity
    # for each k: room beside big sizes that a size of k may join, and total of the sizes from k to half a bin
    room = np.cumsum(np.where(big, (capacity - size) * n, 0))[capacity - size[: capacity // 2 + 1]]
    small = np.cumsum(np.where(big, 0, size * n)[::-1])[::-1][: capacity // 2 + 1]
    more = np.maximum(0, -(-(small - room) // capacity))
    return int(max(-(-(size * n).sum() // capacity), n[big].sum() + more.max()))


def _full(left: dict[int, int], order: list[int], big: int, room: int, most: int) -> list[Filling]:
    """Fillings without waste, of the largest sizes and then two or three that are looked up."""
    found: list[Filling] = []
    taken, start, at = {big: 1}, [], len(order) - 1
    while at >= 0 and room > 2 * order[at]:
        s = order[at]
        m = min(left[s] - taken.get(s, 0), room // s - 1)
        if m > 0:
            start.append((s, m))
            taken[s] = taken.get(s, 0) + m
            room -= m * s
        at -= 1
    at = bisect_right(order, room) - 1
    for a in order[max(0, at - 2 * most + 1) : at + 1][::-1]:
        rest = room - a
        low = bisect_right(order, min(rest, a)) - 1
        for b in [0, *order[max(0, low - most + 1) : low + 1][::-1]]:
            sizes = [x for x in (a, b, rest - b) if x]
            if rest - b <= (b or a) and all(left.get(x, 0) >= sizes.count(x) + taken.get(x, 0) for x in sizes):
                use = dict(start)
                for x in sizes:
                    use[x] = use.get(x, 0) + 1
                filling = sorted(use.items(), reverse=True)
                if not any(_fits(filling, f) for f in found):
                    found.append(filling)
                break
        if len(found) >= most:
            break
    return found


def fillings(left: dict[int, int], order: list[int], capacity: int, spare: int, most: int) -> list[Filling]:
    """Up to ``most`` undominated fillings of a bin opened by the largest size left that waste ``spare`` at most.

    ``order`` holds the sizes from small to large. Fillings without waste are looked up first. If
    there are none, the sums that smaller sizes can still reach, as bits, lead to fillings of each
    total at once, from the fullest on. A filling is dominated if its sizes fit into the places of
    another one.
    """
    big = order[-1]
    room = capacity - big
    merge = lambda f: [(big, 1 + dict(f).get(big, 0))] + [x for x in f if x[0] != big]
    if quick := _full(left, order, big, room, most) if room else [[]]:
        return [merge(f) for f in quick]
    usable = sorted((s for s in left if s <= room and (s != big or left[s] > 1)), reverse=True)
    have = {s: left[s] - (s == big) for s in usable}
    full = (1 << (room + 1)) - 1
    reach = [1] * (len(usable) + 1)
    for i in range(len(usable) - 1, -1, -1):
        s, n = usable[i], min(have[usable[i]], room // usable[i])
        bits, step = reach[i + 1], 1
        while n > 0:
            take = min(step, n)
            bits |= bits << (s * take)
            n -= take
            step *= 2
        reach[i] = bits & full
    found: list[Filling] = []

    def enter(i: int, need: int, chosen: Filling) -> None:
        if not need:
            if not any(_fits(chosen, f) for f in found):
                found.append(chosen)
            return
        while not reach[i + 1] >> need & 1 and usable[i] > need:
            i += 1
        s = usable[i]
        for m in range(min(have[s], need // s), -1, -1):
            if len(found) >= most or trials[0] <= 0:
                return
            if reach[i + 1] >> (need - m * s) & 1:
                trials[0] -= 1
                enter(i + 1, need - m * s, [*chosen, (s, m)] if m else chosen)

    total = reach[0].bit_length() - 1
    trials = [0]
    while total >= 0 and len(found) < most and room - total <= spare and (trials[0] > 0 or not found):
        if reach[0] >> total & 1:
            if not found:  # once there is a filling, all totals share what trials are left
                trials = [64 * most]
            enter(0, total, [])
        total -= 1
    return [merge(f) for f in found]


def _fits(small: Filling, places: Filling) -> bool:
    """Whether the sizes of one filling fit into the places of another, several to a place."""
    items = [s for s, m in small for _ in range(m)]
    rooms = [s for s, m in places for _ in range(m)]
    if len(items) > 12 or len(rooms) > 12:
        return False  # undecided counts as not dominated

    def put(i: int) -> bool:
        if i == len(items):
            return True
        tried = set()
        for j, r in enumerate(rooms):
            if r >= items[i] and r not in tried:
                tried.add(r)
                rooms[j] -= items[i]
                if put(i + 1):
                    return True
                rooms[j] = r
        return False

    return put(0)


def _best_fit(counts: dict[int, int], capacity: int) -> list[tuple[int, Filling]]:
    """Best-fit decreasing over a histogram: each size goes to the fullest bins that hold it."""
    rooms: dict[int, list[tuple[int, Filling]]] = {}  # by room left: bins and what they hold
    order: list[int] = []

    def keep(room: int, n: int, filling: Filling) -> None:
        if room not in rooms:
            insort(order, room)
        rooms.setdefault(room, []).append((n, filling))

    for s in sorted(counts, reverse=True):
        left = counts[s]
        while left:
            at = bisect_left(order, s)
            if at < len(order):
                room = order[at]
                n, filling = rooms[room].pop()
                if not rooms[room]:
                    del rooms[room], order[at]
            else:
                room, n, filling = capacity, left, []
            q = room // s
            whole = min(n, left // q)
            part = left - whole * q if whole < n else 0
            if whole:
                keep(room - q * s, whole, [*filling, (s, q)])
            if part:
                keep(room - part * s, 1, [*filling, (s, part)])
            if filling and n > whole + (part > 0):
                keep(room, n - whole - (part > 0), filling)
            left -= whole * q + part
    return [x for group in rooms.values() for x in group]


def pack(pieces: DataFrame, capacity: int = CAPACITY) -> DataFrame:
    """Give each piece a sequence_id and an offset.

    The driver sees only counts by length and hash block (``capacity`` times ``BLOCKS`` rows at
    most) and the plan of fillings; each piece finds its place from its rank among pieces of its
    length, ranked in ``BLOCKS`` independent blocks so that a frequent length is no single task.
    """
    block = F.pmod(F.xxhash64("doc_id", "piece", "start"), F.lit(BLOCKS)).cast("int")
    pieces = pieces.withColumn("_block", block)
    hist = pieces.groupBy("length", "_block").agg(F.count(F.lit(1)).alias("n")).collect()
    counts: dict[int, int] = {}
    before: dict[tuple[int, int], int] = {}
    for r in sorted(hist, key=lambda r: (r["length"], r["_block"])):
        before[r["length"], r["_block"]] = counts.get(r["length"], 0)
        counts[r["length"]] = counts.get(r["length"], 0) + r["n"]
    offsets = np.zeros((capacity + 1) * BLOCKS, np.int64)
    for (size, b), n in before.items():
        offsets[size * BLOCKS + b] = n
    used: dict[int, int] = {}
    rows = []
    bins = 0
    for n, filling in plan_bins(counts, capacity):
        at = 0
        for size, m in filling:
            rows.append(((size << 44) + used.get(size, 0), m, bins, at))
            used[size] = used.get(size, 0) + n * m
            at += size * m
        bins += n
    rows.sort()
    key, each, first, base = (np.array(c, np.int64) for c in (zip(*rows) if rows else [[]] * 4))

    def place(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            length, b, rn = (batch.column(c).to_numpy() for c in ("length", "_block", "_rank"))
            rank = offsets[length * BLOCKS + b] + rn - 1
            at = np.searchsorted(key, (length << 44) + rank, side="right") - 1
            nth, slot = np.divmod(rank - (key[at] & ((1 << 44) - 1)), each[at])
            cols = [batch.column(c) for c in names] + [pa.array(first[at] + nth, pa.int64()), pa.array(base[at] + slot * length, pa.int64())]
            yield pa.RecordBatch.from_arrays(cols, [*names, "sequence_id", "offset"])

    names = [c for c in pieces.columns if c != "_block"]
    ranked = pieces.withColumn("_rank", F.row_number().over(Window.partitionBy("length", "_block").orderBy("doc_id", "piece")).cast("long"))
    schema = ", ".join(f"`{f.name}` {f.dataType.simpleString()}" for f in pieces.schema.fields if f.name != "_block")
    return ranked.mapInArrow(place, schema + ", sequence_id long, offset long")


def pack_documents(docs: DataFrame, tokenizer: str = TOKENIZER, capacity: int = CAPACITY) -> DataFrame:
    """Pack whole documents: one row per piece (doc_id, piece, start, length, ids_crc32, sequence_id, offset).

    A null text packs as an empty one (its closing id only); a null doc_id, repeated rows and
    extra columns are kept apart and packed; an empty table gives no rows.
    """
    return pack(materialize(tokenized_pieces(docs, tokenizer, capacity), "op3-pieces"), capacity)


def query(spark: SparkSession, sf_dir: str) -> DataFrame:
    return pack_documents(documents(spark, sf_dir))
