"""The order in which a batch's operations run, document by document.

An operation that refers to a capture runs after the one that makes it. Of those
that are ready, comments go first, then the lower index. A batch whose captures
don't fit together is refused as a whole, with one code on all its rows.
"""

from __future__ import annotations

import heapq
import itertools
from collections.abc import Iterator

import pyarrow as pa
from pyspark.sql import DataFrame

COMMENTS = {"comment", "comment_reply", "comment_resolve"}


def order_batch(operations: list[tuple[int, str, str | None, str | None, str | None]]) -> tuple[dict[int, int], str | None]:
    """Steps by index for (index, kind, key made, key used, selector), or the code of the refusal."""
    makers: dict[str, int] = {}
    for index, _, made, _, _ in operations:
        if made is not None:
            if not made.strip() or len(made.strip()) > 256:
                return {}, "INVALID_OPERATION"
            if makers.setdefault(made.strip(), index) != index:
                return {}, "DUPLICATE_CAPTURE_KEY"
    waits: dict[int, int] = {}
    after: dict[int, list[int]] = {}
    writers: dict[str, list[str | None]] = {}
    for index, kind, _, used, selector in operations:
        if used is None:
            continue
        maker = makers.get(used.strip())
        if maker is None:
            return {}, "CAPTURE_NOT_FOUND" if used.strip() else "INVALID_OPERATION"
        if maker == index:
            return {}, "CAPTURE_DEPENDENCY_CYCLE"
        waits[index] = maker
        after.setdefault(maker, []).append(index)
        if kind not in COMMENTS:
            writers.setdefault(used.strip(), []).append(selector)
    for selectors in writers.values():
        if len(selectors) > 1 and (not all(selectors) or len(set(selectors)) < len(selectors)):
            return {}, "CAPTURE_FANOUT_CONFLICT"
    kinds = {index: (kind not in COMMENTS, index) for index, kind, *_ in operations}
    ready = [kinds[index] for index in kinds if index not in waits]
    heapq.heapify(ready)
    steps: dict[int, int] = {}
    while ready:
        _, index = heapq.heappop(ready)
        steps[index] = len(steps) + 1
        for follower in after.get(index, ()):
            heapq.heappush(ready, kinds[follower])
    return (steps, None) if len(steps) == len(kinds) else ({}, "CAPTURE_DEPENDENCY_CYCLE")


def scheduled(operations: DataFrame) -> DataFrame:
    """(doc_id, op, step, code) for rows (doc_id, op, kind, made, used, selector).

    Rows are dealt out by document and sorted, so a batch is a run of rows in a
    stream; a task takes any number of batches without a group of its own for each.
    """

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        def rows() -> Iterator[tuple]:
            for batch in batches:
                yield from zip(*(column.to_pylist() for column in batch.columns))

        out: list[tuple] = []
        for doc_id, batch in itertools.groupby(rows(), key=lambda r: r[0]):
            own = [r[1:] for r in batch]
            steps, code = order_batch(own)
            out += [(doc_id, r[0], steps.get(r[0]), code) for r in own]
            if len(out) >= 10_000:
                yield made(out)
                out = []
        yield made(out)

    kinds = [pa.int64(), pa.int32(), pa.int32(), pa.string()]
    made = lambda out: pa.record_batch([pa.array([r[i] for r in out], kind) for i, kind in enumerate(kinds)], names=["doc_id", "op", "step", "code"])
    kept = operations.selectExpr("CAST(doc_id AS BIGINT) AS doc_id", "CAST(op AS INT) AS op", "kind", "made", "used", "selector")
    return kept.repartition("doc_id").sortWithinPartitions("doc_id", "op").mapInArrow(run, "doc_id long, op int, step int, code string")
