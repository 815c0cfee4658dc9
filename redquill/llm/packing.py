"""Packing by cutting-stock column generation.

Each task packs its own documents, block by block, so no document is shuffled and
no length table goes to the driver. Within a block:

1. A document's whole multiples of the sequence length are sequences of their own; the remainder is an item.
2. Items are counted in classes of ``GRID`` tokens (rounded up). The linear program "fewest sequences that hold every
   class's count" is solved by column generation: the duals of a basis of patterns price new patterns by an unbounded
   knapsack (dynamic program over the capacity), until none improves.
3. Pattern counts are rounded down; what is left is packed first-fit by decreasing class.
4. Items, ranked by length in their class, fill the patterns' places.
5. The room that rounding leaves is filled by cutting the documents of the emptiest sequences, so only the last sequence
   of a block is not full. What it holds goes into the task's next block, and what is left at the end of a task is packed
   once more with that of other tasks, ``FAN`` tasks at a time, until one sequence of the whole corpus is not full. It alone
   is padded.

``program_optimal`` says for each piece whether its block's linear program reached its optimum within ``ROUNDS`` pivots.

Nulls: a null text is empty and gives one piece, its end id; a null doc_id stays null. An empty table gives no rows.
Repeated rows, also of one id, are packed each. Very long texts become full sequences and a remainder. Other columns of
the input, whatever their names, are ignored.
"""

from __future__ import annotations

import zlib
from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from .common import small_batches, stored
from .tokens import chunks, encoder

LENGTH, GRID, ROUNDS, FAN = 4096, 64, 400, 256
#: Ids of one block at most (a longer document is a block of its own).
BLOCK_IDS = 4_000_000
SCHEMA = "doc_id long, start long, length long, ids_crc32 long, doc_tokens long, sequence_id long, offset long, program_optimal boolean"
_FIELDS = pa.schema([("doc_id", pa.int64()), ("start", pa.int64()), ("length", pa.int64()), ("ids_crc32", pa.int64()), ("doc_tokens", pa.int64()), ("sequence_id", pa.int64()), ("offset", pa.int64()), ("program_optimal", pa.bool_()), ("ids", pa.binary())])
#: An item: doc_id, ids of the document before it, ids of the document, its own ids.
Item = tuple[int | None, int, int, bytes]


def best_pattern(value: np.ndarray, sizes: np.ndarray, room: int) -> tuple[float, np.ndarray]:
    """Unbounded knapsack: the most valuable multiset of sizes within ``room``."""
    best, last = np.zeros(room + 1), np.full(room + 1, -1)
    for r in range(1, room + 1):
        fits = sizes <= r
        got = np.where(fits, best[r - np.minimum(sizes, r)] + value, -1.0)
        k = int(got.argmax())
        if got[k] > best[r - 1] + 1e-12:
            best[r], last[r] = got[k], k
        else:
            best[r] = best[r - 1]
    counts, r = np.zeros(len(sizes)), room
    while r > 0:
        if last[r] < 0:
            r -= 1
        else:
            counts[last[r]] += 1
            r -= int(sizes[last[r]])
    return float(best[room]), counts


def column_generation(sizes: np.ndarray, demand: np.ndarray, room: int, rounds: int = ROUNDS) -> tuple[np.ndarray, np.ndarray, bool]:
    """Patterns (one a column), how often the linear program uses each, and whether that is the optimum.

    A revised simplex over the basis of patterns; ``rounds`` bounds the pivots,
    after which the basis is feasible though perhaps not optimal.
    """
    optimal = False
    basis = np.diag((room // sizes).astype(float))
    inverse, amount = np.diag(1 / np.diag(basis)), demand / np.diag(basis)
    for turn in range(rounds):
        value, column = best_pattern(inverse.sum(axis=0), sizes, room)
        if value <= 1 + 1e-7:
            optimal = True
            break
        direction = inverse @ column
        steps = np.where(direction > 1e-9, amount / np.where(direction > 1e-9, direction, 1), np.inf)
        out = int(steps.argmin())
        basis[:, out] = column
        if turn % 50 == 49:
            inverse = np.linalg.inv(basis)
        else:
            row = inverse[out] / direction[out]
            inverse = inverse - np.outer(direction, row)
            inverse[out] = row
        amount = np.maximum(inverse @ demand, 0)
    return basis, amount, optimal


def fill_patterns(lengths: np.ndarray, length: int, grid: int, rounds: int = ROUNDS) -> tuple[list[list[int]], bool]:
    """Item numbers by sequence, so that no sequence holds more than ``length``; whether the program reached its optimum."""
    classes = -(-lengths // grid)
    room = length // grid
    ranked = {int(c): np.flatnonzero(classes == c)[np.argsort(-lengths[classes == c], kind="stable")].tolist()[::-1] for c in np.unique(classes)}
    sizes = np.array(sorted(ranked, reverse=True))
    demand = np.array([len(ranked[c]) for c in sizes], float)
    basis, amount, optimal = column_generation(sizes, demand, room, rounds)
    bins: list[list[int]] = []
    for p, times in enumerate(np.floor(amount + 1e-9).astype(int).tolist()):
        places = [(int(sizes[i]), int(basis[i, p])) for i in np.flatnonzero(basis[:, p])]
        for _ in range(times):
            got = [ranked[c].pop() for c, n in places for _ in range(min(n, len(ranked[c])))]
            if got:
                bins.append(got)
    free: list[list] = [[] for _ in range(room + 1)]  # sequences by the room left in them
    for c in sizes.tolist():
        for item in reversed(ranked[c]):
            left = next((r for r in range(c, room + 1) if free[r]), None)
            own = free[left].pop() if left is not None else []
            if left is None:
                bins.append(own)
                left = room
            own.append(item)
            free[left - c].append(own)
    return bins, optimal


def pack(lengths: np.ndarray, length: int = LENGTH, grid: int = GRID, rounds: int = ROUNDS) -> tuple[list[tuple[int, int, int, int, int]], bool]:
    """Pieces (item, start, length, sequence, offset) that cover every id once, and whether the program reached its optimum.

    ``lengths`` are the items' id counts. Every sequence holds ``length`` ids; what is
    left, fewer than that, has the sequence -1.
    """
    out: list[tuple[int, int, int, int, int]] = []
    sequence = 0
    whole, rest = lengths // length, lengths % length
    for d in np.flatnonzero(whole).tolist():
        for k in range(int(whole[d])):
            out.append((d, k * length, length, sequence, 0))
            sequence += 1
    items = np.flatnonzero(rest)
    if not len(items):
        return out, True
    bins, optimal = fill_patterns(rest[items], length, grid, rounds)
    parts = [[[int(items[i]), int(whole[items[i]]) * length, int(rest[items[i]])] for i in b] for b in bins]  # item, start, ids left
    parts.sort(key=lambda b: -sum(p[2] for p in b))
    low, high, pool = 0, len(parts) - 1, []  # pool: parts to cut from, the last one first
    while low <= high or pool:
        own = parts[low] if low <= high else pool
        pool = pool if low <= high else []
        low += 1
        room = length - sum(p[2] for p in own)
        while room and (pool or low <= high):
            if not pool:
                pool = parts[high]
                high -= 1
            donor = pool[-1]
            n = min(room, donor[2])
            own.append([donor[0], donor[1], n])
            donor[1] += n
            donor[2] -= n
            room -= n
            if not donor[2]:
                pool.pop()
        offset = 0
        for d, start, n in own:
            out.append((d, start, n, -1 if room else sequence, offset))
            offset += n
        sequence += 1
    return out, optimal


def _packed_items(items: list[Item], base: int, length: int, last: bool = False) -> tuple[pa.RecordBatch, list[Item], int]:
    """Pieces of the full sequences, numbered from ``base``; the items left; the next number.

    With ``last`` nothing is left: the sequence that isn't full has a number too.
    """
    pieces, optimal = pack(np.array([len(x[3]) // 4 for x in items], np.int64), length)
    cut = lambda p: items[p[0]][3][4 * p[1] : 4 * (p[1] + p[2])]
    tail = [] if last else [(items[p[0]][0], items[p[0]][1] + p[1], items[p[0]][2], cut(p)) for p in pieces if p[3] < 0]
    top = max((p[3] for p in pieces), default=-1) + 1
    done = [(p[0], p[1], p[2], top if p[3] < 0 else p[3], p[4]) for p in pieces if last or p[3] >= 0]
    d, start, n, sequence, offset = (np.array(x, np.int64) for x in zip(*done)) if done else [np.zeros(0, np.int64)] * 5
    own = [items[i] for i in d.tolist()]
    columns = [
        pa.array([x[0] for x in own], pa.int64()), start + np.array([x[1] for x in own], np.int64), n, pa.array([zlib.crc32(cut(p)) for p in done], pa.int64()),
        pa.array([x[2] for x in own], pa.int64()), sequence + base, offset, pa.array([optimal] * len(own), pa.bool_()), pa.array([None] * len(own), pa.binary()),
    ]
    return pa.RecordBatch.from_arrays([c if isinstance(c, pa.Array) else pa.array(c) for c in columns], schema=_FIELDS), tail, base + top + 1


def _left(items: list[Item], group: int) -> pa.RecordBatch:
    """Rows for items that wait for another round, with their ids."""
    rows = [(x[0], x[1], len(x[3]) // 4, 0, x[2], group, 0, True, x[3]) for x in items]
    return pa.RecordBatch.from_arrays([pa.array(c, f.type) for c, f in zip(zip(*rows), _FIELDS)], schema=_FIELDS)


def _by_task(path: str, end_id: int, length: int, block_ids: int):
    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        from pyspark import TaskContext

        encode, end = encoder(path), np.array([end_id], "<u4").tobytes()
        part = TaskContext.get().partitionId()
        base, held = part << 40, 0
        items: list[Item] = []
        for batch in batches:
            names, texts = batch.column(0).to_pylist(), batch.column(1).to_pylist()
            for a, b in chunks(texts):
                for name, raw in zip(names[a:b], encode.encode([t or "" for t in texts[a:b]])):
                    n = len(raw) // 4 + 1
                    items.append((name, 0, n, raw + end))
                    held += n
                if held >= block_ids:
                    done, items, base = _packed_items(items, base, length)
                    held = sum(len(x[3]) // 4 for x in items)
                    yield done
        if items:
            done, items, base = _packed_items(items, base, length)
            yield done
        if items:
            yield _left(items, part)

    return run


def _again(turn: int, last: bool, length: int):
    def run(key: tuple, rows: pa.Table) -> pa.Table:
        rows = rows.sort_by([("sequence_id", "ascending"), ("doc_id", "ascending"), ("start", "ascending"), ("doc_tokens", "ascending"), ("ids", "ascending")])
        group = key[0].as_py()
        items = list(zip(*(rows.column(c).to_pylist() for c in ("doc_id", "start", "doc_tokens", "ids"))))
        done, left, _ = _packed_items(items, (1 << 62) + (turn << 54) + (group << 30), length, last)
        return pa.Table.from_batches([done, _left(left, group)] if left else [done])

    return run


def pack_documents(docs: DataFrame, tokenizer_path: str, end_id: int = 2, length: int = LENGTH, block_ids: int = BLOCK_IDS, fan: int = FAN) -> DataFrame:
    """Pieces of all documents, packed into sequences of ``length`` ids; one sequence in all may hold fewer.

    The first round is written to the shared folder. Later rounds take what is left
    of each task, fewer than ``length`` ids, ``fan`` tasks to a group.
    """
    small_batches(docs.sparkSession)
    schema = f"{SCHEMA}, ids binary"
    rows = stored(docs.select("doc_id", "text").mapInArrow(_by_task(tokenizer_path, end_id, length, block_ids), schema), "packed")
    done, turn = rows.where("ids is null"), 0
    left = rows.where("ids is not null")
    groups = (left.agg(F.max("sequence_id")).first()[0] or 0) + 1
    while True:
        groups, turn = -(-groups // fan), turn + 1
        grouped = left.withColumn("_group", F.floor(F.col("sequence_id") / fan).cast("long")).groupBy("_group")
        rows = grouped.applyInArrow(_again(turn, groups == 1, length), schema)
        if groups == 1:
            return done.unionByName(rows).drop("ids")
        rows = stored(rows, "packed-again")
        done, left = done.unionByName(rows.where("ids is null")), rows.where("ids is not null")
