"""Token ids in sorted-string-table shards.

A shard file holds documents in key order: data blocks with prefix-compressed keys and restart
points, then a sparse index (first key of each block), a Bloom filter over keys, and a
footer. Every section ends with the four bytes MARK, which is also what Spark's text writer puts
after each row, so shards are written by Spark to any file system it knows.

    block    entries (varint shared, varint rest, varint length, key rest, value), restarts u32*, count u32
    value    a byte 2 or 4 and the ids in so many little-endian bytes each, zlib-compressed
    index    (key u64, offset u64, length u32, documents u32, ids u64)*, all big-endian
    bloom    bits
    footer   index offset, length, bloom offset, length, documents, ids (u64 each), magic
"""

from __future__ import annotations

import os
import re
import struct
import zlib
from array import array

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

from tumbler.llm.common import cut, fresh_path, pieces, remove, shuffles
from tumbler.llm.token_counts import byte_letters

MARK = b"\nSST"
MAGIC = b"TOKSST01"
FOOTER = struct.Struct(">QQQQQQ8s")
ENTRY = struct.Struct(">QQIIQ")
BLOCK_BYTES, RESTART = 1 << 16, 16
#: Pieces of a generation whose ids a Python worker remembers, and texts encoded at once.
REMEMBERED, TEXTS = 250_000, 500
#: Text bytes of a shard: it is read back as one row, and a row ends at 2 GB.
SHARD_BYTES = 64 << 20


def key_of(doc_id: int | None) -> bytes:
    """Eight bytes in the ids' order; null has the empty key, which comes first."""
    return b"" if doc_id is None else struct.pack(">Q", doc_id + (1 << 63))


def id_of(key: bytes) -> int | None:
    return struct.unpack(">Q", key)[0] - (1 << 63) if key else None


def varint(n: int) -> bytes:
    out = bytearray()
    while n > 127:
        out.append(n & 127 | 128)
        n >>= 7
    return bytes(out) + bytes([n])


def read_varint(raw, at: int) -> tuple[int, int]:
    n = shift = 0
    while True:
        b = raw[at]
        at += 1
        n |= (b & 127) << shift
        shift += 7
        if b < 128:
            return n, at


def pack(ids: np.ndarray) -> bytes:
    wide = 4 if len(ids) and ids.max() > 0xFFFF else 2
    return bytes([wide]) + zlib.compress(ids.astype(f"<u{wide}").tobytes(), 1)


def unpack(raw: bytes) -> np.ndarray:
    return np.frombuffer(zlib.decompress(raw[1:]), f"<u{raw[0]}").astype("<u4")


def bloom_places(key: bytes, bits: int) -> list[int]:
    a, b = zlib.crc32(key), zlib.crc32(key, 0x9E3779B9) | 1
    return [(a + i * b) % bits for i in range(7)]


class ShardWriter:
    """Turns (key, ids) in key order into the file's sections, each to be followed by MARK."""

    def __init__(self):
        self.at, self.index, self.keys = 0, [], []
        self.docs = self.ids = 0
        self._clear()

    def _clear(self):
        self.block, self.restarts, self.n, self.last, self.first, self.block_ids = bytearray(), [], 0, b"", b"", 0

    def add(self, key: bytes, ids: np.ndarray):
        value = pack(ids)
        if self.n % RESTART == 0:
            self.restarts.append(len(self.block))
            shared = 0
        else:
            shared = next((i for i, (x, y) in enumerate(zip(self.last, key)) if x != y), min(len(self.last), len(key)))
        if not self.n:
            self.first = key
        self.block += varint(shared) + varint(len(key) - shared) + varint(len(value)) + key[shared:] + value
        self.last, self.n, self.block_ids = key, self.n + 1, self.block_ids + len(ids)
        self.keys.append(key)
        if len(self.block) >= BLOCK_BYTES:
            yield from self.flush()

    def flush(self):
        if self.n:
            raw = bytes(self.block) + struct.pack(f">{len(self.restarts)}II", *self.restarts, len(self.restarts))
            self.index.append((self.first, self.at, len(raw), self.n, self.block_ids))
            self.docs, self.ids, self.at = self.docs + self.n, self.ids + self.block_ids, self.at + len(raw) + len(MARK)
            self._clear()
            yield raw

    def close(self):
        yield from self.flush()
        # A null key is written as 0 in the index; only a shard's first block can hold it.
        index = b"".join(ENTRY.pack(int.from_bytes(k, "big"), *rest) for k, *rest in self.index)
        bits = max(64, -(-10 * len(self.keys) // 8) * 8)
        bloom = bytearray(bits // 8)
        for key in self.keys:
            for x in bloom_places(key, bits):
                bloom[x >> 3] |= 1 << (x & 7)
        yield index
        yield bytes(bloom)
        bloom_at = self.at + len(index) + len(MARK)
        yield FOOTER.pack(self.at, len(index), bloom_at, len(bloom), self.docs, self.ids, MAGIC)


class Shard:
    """A shard file's contents."""

    def __init__(self, raw: bytes):
        self.raw = raw
        end = len(raw) - len(MARK)
        index_at, index_n, bloom_at, bloom_n, self.docs, self.ids, magic = FOOTER.unpack(raw[end - FOOTER.size : end])
        if magic != MAGIC or raw[end:] != MARK:
            raise ValueError("not a token shard")
        self.index = list(ENTRY.iter_unpack(raw[index_at : index_at + index_n]))
        self.bloom = raw[bloom_at : bloom_at + bloom_n]

    def block(self, entry):
        _, at, n, _, _ = entry
        raw = self.raw[at : at + n]
        end = n - 4 - 4 * struct.unpack(">I", raw[-4:])[0]
        at, key = 0, b""
        while at < end:
            shared, at = read_varint(raw, at)
            rest, at = read_varint(raw, at)
            size, at = read_varint(raw, at)
            key = key[:shared] + raw[at : at + rest]
            yield key, unpack(raw[at + rest : at + rest + size])
            at += rest + size

    def __iter__(self):
        for entry in self.index:
            yield from self.block(entry)

    def may_hold(self, key: bytes) -> bool:
        return all(self.bloom[x >> 3] >> (x & 7) & 1 for x in bloom_places(key, 8 * len(self.bloom)))

    def get(self, doc_id: int | None) -> np.ndarray | None:
        """The first document with this id: Bloom filter, binary search in the index, then one or two blocks."""
        key = key_of(doc_id)
        if not self.may_hold(key):
            return None
        low, high, want = 0, len(self.index), int.from_bytes(key, "big")
        while low < high:
            mid = (low + high) // 2
            low, high = (mid + 1, high) if self.index[mid][0] < want else (low, mid)
        for entry in self.index[max(0, low - 1) :]:
            for k, ids in self.block(entry):
                if k == key:
                    return ids
                if k > key:
                    return None
        return None


class Recent:
    """A table in two generations: a full young one becomes the old one, and entries still in use move back. Frequent
    entries stay, and at most twice `size` are held."""

    def __init__(self, size: int):
        self.size, self.young, self.old = size, {}, {}

    def missing(self, keys: set) -> list:
        """The keys that neither generation holds; the others are in the young one afterwards."""
        if len(self.young) > self.size:
            self.young, self.old = {}, self.young
        out = []
        for k in keys - self.young.keys():
            known = self.old.get(k)
            if known is None:
                out.append(k)
            else:
                self.young[k] = known
        return out


#: Texts that are plain to the tokenizer: printable ASCII, white space, and Latin-1 letters, which are composed already.
PLAIN = re.compile("[ -~\t\n\r\u00c0-\u00d6\u00d8-\u00f6\u00f8-\u00ff]*")
#: The tokenizer's own split of lower-case text, restricted to those characters.
PIECE = re.compile("'s|'t|'re|'ve|'m|'ll|'d|[a-z\u00df-\u00f6\u00f8-\u00ff]+|[0-9]|[^ \t\n\ra-z\u00df-\u00f6\u00f8-\u00ff0-9]+")
WHOLE = "\0"  # before a word that passes through the whole tokenizer


class PieceIds:
    """The ids of pieces (words, or runs of other characters), as little-endian u32 bytes.

    Plain texts are lower-cased and split here and their pieces go to the tokenizer's model. In other texts, blanks and
    line feeds are still white space, which the tokenizer drops, so words that aren't plain pass through the whole
    tokenizer one by one; texts that may hold special tokens are encoded whole.
    """

    def __init__(self, tokenizer):
        self.tokenizer, self.model, self.known = tokenizer, tokenizer.model, Recent(REMEMBERED)
        letters = {b: c for c, b in byte_letters().items()}
        self.letters = {i: "".join(letters[b] for b in chr(i).encode()) for i in range(33, 256)}
        # Splitting here is only for tokenizers that do the same, which a few texts tell.
        probe = "it's Zue\u00df, a1b22 ...x'RE-y\n\u00c9t\u00e9 ''s\tA\u00ff\r&"
        self.plain = self.whole(probe) == b"".join(map(self.ids, PIECE.findall(probe.lower())))

    def whole(self, text: str) -> bytes:
        return array("I", self.tokenizer.encode(text, add_special_tokens=False).ids).tobytes()

    def ids(self, piece: str) -> bytes:
        if piece[0] == WHOLE:
            return self.whole(piece[1:])
        return array("I", [t.id for t in self.model.tokenize(piece.translate(self.letters))]).tobytes()

    def split(self, text: str) -> list[str]:
        if self.plain and PLAIN.fullmatch(text):
            return PIECE.findall(text.lower())
        out = []
        for w in text.replace("\n", " ").split(" "):
            if w:
                out += PIECE.findall(w.lower()) if self.plain and PLAIN.fullmatch(w) else (WHOLE + w,)
        return out

    def encode(self, texts: list[str]) -> list[bytes]:
        parts = [None if "<|" in t else self.split(t) for t in texts]
        for p in self.known.missing(set().union(*(p for p in parts if p))):
            self.known.young[p] = self.ids(p)
        get = self.known.young.__getitem__
        return [self.whole(t) if p is None else b"".join(map(get, p)) for t, p in zip(texts, parts)]


_LOADED: dict[int, PieceIds] = {}


def piece_ids(tokenizer_json: str) -> PieceIds:
    """One tokenizer and table for each Python worker, whatever tasks it runs."""
    os.environ.setdefault("TOKENIZERS_PARALLELISM", "false")
    from tokenizers import Tokenizer

    key = zlib.crc32(tokenizer_json.encode())
    if key not in _LOADED:
        _LOADED.clear()
        _LOADED[key] = PieceIds(Tokenizer.from_str(tokenizer_json))
    return _LOADED[key]


def write_shards(docs: DataFrame, tokenizer_json: str, path: str, id_col: str = "doc_id", text_col: str = "text", end_id: int = 1, shards: int | None = None) -> None:
    """Encode every text, append end_id, and write shards in ascending id order (null first) to path.

    A null text counts as empty. Repeated ids are all kept, in order of their texts. Extra columns
    are not read. A very long text is encoded whole, as one value. Documents are range-partitioned by id before they are encoded, so each is encoded once;
    an empty table writes one shard without documents. Without `shards`, their number grows with the text.
    """
    spark = docs.sparkSession
    shared = spark.sparkContext.broadcast(tokenizer_json)

    def run(batches):
        pieces = piece_ids(shared.value)
        writer, end = ShardWriter(), np.array([end_id], "<u4").tobytes()
        for batch in batches:
            for i in range(0, len(batch), TEXTS):
                part, out = batch.slice(i, TEXTS), []
                for doc_id, ids in zip(part.column(0).to_pylist(), pieces.encode(part.column(1).to_pylist())):
                    out += writer.add(key_of(doc_id), np.frombuffer(ids + end, "<u4"))
                yield pa.RecordBatch.from_arrays([pa.array(out, pa.binary())], names=["value"])
        yield pa.RecordBatch.from_arrays([pa.array(list(writer.close()), pa.binary())], names=["value"])

    cols = docs.select(F.col(f"`{id_col}`").cast("long").alias("doc_id"), F.coalesce(F.col(f"`{text_col}`"), F.lit("")).alias("text"))
    if shards is None:
        n_bytes = cols.agg(F.coalesce(F.sum(F.octet_length("text").cast("long")), F.lit(0))).first()[0]
        shards = max(shuffles(spark), pieces(n_bytes, SHARD_BYTES))
    dealt = cols.repartitionByRange(shards, "doc_id").sortWithinPartitions("doc_id", "text")
    # A binary cast to a string keeps its bytes; the text writer puts lineSep after each.
    dealt.mapInArrow(run, "value binary").select(F.col("value").cast("string").alias("value")).write.option("lineSep", MARK.decode()).text(path)


def read_shards(spark, path: str) -> DataFrame:
    """shard (its first id), doc_id, at (ids before it in the shard), n_tokens and ids_crc32 of every document in the files.

    The empty key is read as a null id; a shard without documents gives no rows, a file that is not a shard raises."""

    def run(batches):
        for batch in batches:
            for raw in batch.column("content"):
                shard, rows, at = Shard(raw.as_py()), [], 0
                for i, (key, ids) in enumerate(shard):
                    rows.append((id_of(key), at, i, len(ids), zlib.crc32(ids.tobytes())))
                    at += len(ids)
                cols = list(zip(*rows)) or [()] * 5
                first = [rows[0][0]] * len(rows) if rows else []
                yield pa.RecordBatch.from_arrays([pa.array(x, pa.int64()) for x in (first, *cols)], names=["shard", "doc_id", "at", "place", "n_tokens", "ids_crc32"])

    files = spark.read.format("binaryFile").load(path).select("content")
    return files.mapInArrow(run, "shard long, doc_id long, at long, place long, n_tokens long, ids_crc32 long")


def located(read: DataFrame) -> DataFrame:
    """doc_id, start (ids of all documents before it), n_tokens, ids_crc32. Shards are few: one window row each. A null id
    comes first. No rows for no shards."""
    rows = cut(read, "tokens")
    shards = rows.groupBy("shard").agg(F.sum("n_tokens").alias("n"))
    before = Window.orderBy(F.asc_nulls_first("shard")).rowsBetween(Window.unboundedPreceding, -1)
    base = shards.select(F.col("shard").alias("s"), F.coalesce(F.sum("n").over(before), F.lit(0)).alias("base"))
    return rows.join(base, rows["shard"].eqNullSafe(base["s"])).select("doc_id", (F.col("base") + F.col("at")).cast("long").alias("start"), "n_tokens", "ids_crc32")


def op7_token_shards(spark, sf_dir: str, tokenizer: str | None = None) -> DataFrame:
    if tokenizer is None:
        import public_tokenizers

        tokenizer = public_tokenizers.path("word_bpe_49k.json")
    with open(tokenizer, encoding="utf-8") as f:
        raw = f.read()
    path = fresh_path(spark, "shards")
    write_shards(spark.read.parquet(f"{sf_dir}/documents.parquet"), raw, path)
    out = located(read_shards(spark, path))
    remove(spark, path)  # what was read from them is in a table of its own
    return out
