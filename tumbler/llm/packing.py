"""Packing of token ids into windows by Karmarkar-Karp multiway differencing.

A document longer than a window fills whole windows of its own; what is left of it, and every shorter document, is an
item that stays in one piece. Items are gathered into groups of about GROUP windows. In a group each item begins as a
partial partition of k windows, all but one empty. The two partial partitions with the largest imbalance are merged, the fullest
window of one with the emptiest of the other, until one is left: k windows of near-equal sums. k starts at the least
possible number and rises whenever a window exceeds its capacity.

Groups are packed in the tasks that encode the texts. What a task has left at its end, less than a group, is dealt out
once more and packed with that of other tasks.
"""

from __future__ import annotations

import heapq

import numpy as np
import pyarrow as pa
from pyspark import TaskContext
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from tumbler.llm.common import cut, pieces
from tumbler.llm.token_store import TEXTS, piece_ids

WINDOW, GROUP = 2048, 128


def difference(sizes: list[int], k: int) -> tuple[np.ndarray, int]:
    """The window of every item, and the largest sum, after differencing into k windows."""
    n = len(sizes)
    heap = []
    for i, size in enumerate(sizes):
        sums = np.zeros(k, "i8")
        sums[0] = size
        heap.append((-size if k > 1 else 0, i, sums))
    heapq.heapify(heap)
    merged = []  # node n + i: both parts and the order of their summed windows
    while len(heap) > 1:
        _, x, a = heapq.heappop(heap)
        _, y, b = heap[0]
        sums = a + b[::-1]
        order = np.argsort(-sums, kind="stable")
        sums = sums[order]
        heapq.heapreplace(heap, (int(sums[-1] - sums[0]), n + len(merged), sums))
        merged.append((x, y, order))
    window = np.zeros(n, "i8")
    places = {heap[0][1]: np.arange(k)} if heap else {}
    for node in range(n + len(merged) - 1, -1, -1):  # a part has a smaller number than what it is merged into
        at = places.pop(node)
        if node < n:
            window[node] = at[0]
        else:
            x, y, order = merged[node - n]
            mine = np.empty(k, "i8")
            mine[order] = at
            places[x], places[y] = mine, mine[::-1]
    return window, int(heap[0][2][0]) if heap else 0


def windows_of(sizes: list[int], capacity: int) -> tuple[np.ndarray, int]:
    """The window of every item and the number of windows; no item is larger than the capacity."""
    k = -(-sum(sizes) // capacity)
    while True:
        window, most = difference(sizes, k)
        if most <= capacity:
            return window, k
        k += 1


class Packer:
    """Gathers the items of a task and packs a group as soon as it is full."""

    def __init__(self, capacity: int, group: int, kind: pa.DataType):
        self.capacity, self.limit, self.kind = capacity, capacity * group, kind
        self.number = self.gathered = 0
        self.items: list[tuple] = []
        self.rows: list[tuple] = []  # doc_id, start, ids, doc_tokens, sequence, offset

    def add(self, doc_id, start: int, ids: bytes, doc_tokens: int) -> None:
        self.items.append((doc_id, start, ids, doc_tokens))
        self.gathered += len(ids) // 4
        if self.gathered >= self.limit:
            self.close()

    def add_document(self, doc_id, ids: bytes) -> None:
        n, whole = len(ids) // 4, len(ids) // 4 // self.capacity * self.capacity
        for start in range(0, whole, self.capacity):
            self.rows.append((doc_id, start, ids[4 * start : 4 * (start + self.capacity)], n, self.number, 0))
            self.number += 1
        if n > whole:
            self.add(doc_id, whole, ids[4 * whole :], n)

    def close(self) -> None:
        window, k = windows_of([len(x[2]) // 4 for x in self.items], self.capacity)
        filled = [0] * k
        for item, w in zip(self.items, window.tolist()):
            self.rows.append((*item, self.number + w, filled[w]))
            filled[w] += len(item[2]) // 4
        self.number += k
        self.items, self.gathered = [], 0

    def leave(self) -> None:
        """The items that are left, as rows without a sequence."""
        self.rows += [(*item, None, None) for item in self.items]
        self.items = []

    def batch(self, task: int) -> pa.RecordBatch:
        rows, self.rows = self.rows, []
        doc_id, start, ids, tokens, sequence, offset = zip(*rows) if rows else ((),) * 6
        cols = [pa.array(doc_id, self.kind), pa.array(start, pa.int64()), pa.array(ids, pa.binary()), pa.array(tokens, pa.int64())]
        cols += [pa.array([task] * len(rows), pa.int64()), pa.array(sequence, pa.int64()), pa.array(offset, pa.int64()), pa.array(range(len(rows)), pa.int64())]
        return pa.RecordBatch.from_arrays(cols, names=["doc_id", "start", "ids", "doc_tokens", "task", "sequence", "offset", "place"])


def pack(docs: DataFrame, tokenizer_json: str, capacity: int = WINDOW, end_id: int = 1, group: int = GROUP, id_col: str = "doc_id", text_col: str = "text") -> DataFrame:
    """Pieces: doc_id (of its own type), start (the document's ids before it), ids (little-endian u32), doc_tokens, sequence_id, offset.

    A document is its text's ids and end_id. A null text counts as empty and is one id. Null and repeated ids and repeated
    rows are documents of their own; texts are encoded whole, one value at a time; extra columns are not read, whatever
    their names; an empty table gives no pieces. Sequence ids are distinct but have gaps: task and number in the task. Which documents meet
    depends on how the rows are split into tasks; the written table fixes it.
    """
    spark = docs.sparkSession
    shared = spark.sparkContext.broadcast(tokenizer_json)
    kind = docs.schema[id_col].dataType.simpleString()
    schema = f"doc_id {kind}, start bigint, ids binary, doc_tokens bigint, task bigint, sequence bigint, offset bigint, place bigint"

    def encode(batches):
        known, end, packer, task = piece_ids(shared.value), np.array([end_id], "<u4").tobytes(), None, TaskContext.get().partitionId()
        for batch in batches:
            packer = packer or Packer(capacity, group, batch.schema.field(0).type)
            for i in range(0, len(batch), TEXTS):
                part = batch.slice(i, TEXTS)
                for doc_id, ids in zip(part.column(0).to_pylist(), known.encode(part.column(1).to_pylist())):
                    packer.add_document(doc_id, ids + end)
                yield packer.batch(task)
        if packer:
            packer.leave()
            yield packer.batch(task)

    def pack_left(batches):
        packer, task = None, TaskContext.get().partitionId()
        for batch in batches:
            packer = packer or Packer(capacity, 2 * group, batch.schema.field(0).type)
            for row in zip(*(c.to_pylist() for c in batch.columns)):
                packer.add(*row)
            yield packer.batch(task)
        if packer and packer.items:
            packer.close()
            yield packer.batch(task)

    cols = docs.select(F.col(f"`{id_col}`").alias("doc_id"), F.coalesce(F.col(f"`{text_col}`"), F.lit("")).alias("text"))
    first = cut(cols.mapInArrow(encode, schema), "pieces")
    left = first.where("sequence IS NULL")
    tokens, tasks = first.agg(F.coalesce(F.sum(F.when(F.col("sequence").isNull(), F.octet_length("ids").cast("long") / 4)), F.lit(0)), F.coalesce(F.max("task"), F.lit(-1)) + 1).first()
    dealt = left.repartition(pieces(int(tokens), capacity * group), F.xxhash64("task", "place")).select("doc_id", "start", "ids", "doc_tokens")
    second = dealt.mapInArrow(pack_left, schema).withColumn("task", F.col("task") + tasks)
    number = (F.shiftleft("task", 32) + F.col("sequence")).alias("sequence_id")
    return first.where("sequence IS NOT NULL").unionByName(second).select("doc_id", "start", "ids", "doc_tokens", number, "offset")


def sequences(packed: DataFrame, capacity: int = WINDOW, pad_id: int = 0) -> DataFrame:
    """sequence_id, ids (capacity little-endian u32, filled up with pad_id), n_tokens (without filling) and parts (offset,
    length, doc_id, start) of every sequence. A group is a sequence, so no more than `capacity` ids meet."""
    part = F.struct("offset", (F.octet_length("ids") / 4).cast("long").alias("length"), "doc_id", "start", "ids")
    rows = packed.groupBy("sequence_id").agg(F.sort_array(F.collect_list(part)).alias("p"))
    ids = F.aggregate("p", F.lit(b""), lambda a, x: F.concat(a, x["ids"]))
    fill = F.lit(np.array([pad_id], "<u4").tobytes())
    parts = F.transform("p", lambda x: F.struct(x["offset"].alias("offset"), x["length"].alias("length"), x["doc_id"].alias("doc_id"), x["start"].alias("start")))
    return rows.select("sequence_id", F.rpad(ids, F.lit(4 * capacity), fill).alias("ids"), F.aggregate("p", F.lit(0).cast("long"), lambda a, x: a + x["length"]).alias("n_tokens"), parts.alias("parts"))


def op13_differencing(spark, sf_dir: str, tokenizer: str | None = None) -> DataFrame:
    if tokenizer is None:
        import public_tokenizers

        tokenizer = public_tokenizers.path("word_bpe_49k.json")
    with open(tokenizer, encoding="utf-8") as f:
        raw = f.read()
    packed = pack(spark.read.parquet(f"{sf_dir}/documents.parquet"), raw)
    length = (F.octet_length("ids") / 4).cast("long").alias("length")
    return packed.select("doc_id", "start", length, F.crc32("ids").alias("ids_crc32"), "doc_tokens", "sequence_id", "offset")
