"""Greedy word-piece counts by a linear longest-match automaton.

The automaton is the vocabulary's trie. A failure link leads from a node, once no longer
match exists, to the node of what remains after the longest pieces are popped off its
string; the number of pieces popped is stored with the link. Each byte is read once and
pieces are counted, never built.
"""

from __future__ import annotations

import json

import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

END = 256  # the symbol after a word's last byte
#: Words whose counts a task remembers.
REMEMBERED = 200_000


class LongestMatch:
    """pieces: byte strings paired with True where the piece is bound to the word's end."""

    def __init__(self, pieces):
        self.go: list[dict[int, int]] = [{}]
        token = [False]
        for raw, ends in pieces:
            node = 0
            for c in [*raw, END] if ends else raw:
                if c not in self.go[node]:
                    self.go[node][c] = len(self.go)
                    self.go.append({})
                    token.append(False)
                node = self.go[node][c]
            token[node] = node > 0
        # Breadth first: failure link and pieces popped. -1: no link, the string has no segmentation from here.
        self.fail, self.pops = [-1] * len(self.go), [0] * len(self.go)
        queue = [0]
        for node in queue:
            for c, child in self.go[node].items():
                if token[child]:
                    self.fail[child], self.pops[child] = 0, 1
                else:
                    z, n = self.fail[node], self.pops[node]
                    while z >= 0 and c not in self.go[z]:
                        z, n = self.fail[z], n + self.pops[z]
                    if z >= 0:
                        self.fail[child], self.pops[child] = self.go[z][c], n
                queue.append(child)

    def count(self, word: bytes) -> int:
        """Pieces of a word by greedy longest match; 0 if it can't be segmented."""
        go, fail, pops = self.go, self.fail, self.pops
        node = n = 0
        for c in (*word, END):
            while c not in go[node]:
                n += pops[node]
                node = fail[node]
                if node < 0:
                    return 0
            node = go[node][c]
        while node:
            n += pops[node]
            node = fail[node]
            if node < 0:
                return 0
        return n


class Counts(dict):
    """word -> pieces, worked out when first asked for. An unknown word counts 1 (the unknown piece)."""

    def __init__(self, automaton: LongestMatch):
        super().__init__()
        self.automaton = automaton

    def __missing__(self, word: str) -> int:
        if len(self) >= REMEMBERED:
            self.clear()
        n = self.automaton.count(word.encode())
        self[word] = n or 1
        return n or 1


def byte_letters() -> dict[str, int]:
    """The printable letter that byte-level vocabularies write for each byte."""
    plain = [*range(33, 127), *range(161, 173), *range(174, 256)]
    rest = [b for b in range(256) if b not in plain]
    return {chr(b): b for b in plain} | {chr(256 + i): b for i, b in enumerate(rest)}


def read_pieces(path: str) -> list[tuple[bytes, bool]]:
    """Pieces of a tokenizers file with byte-level letters and the word-end mark </w>."""
    letters, out = byte_letters(), []
    with open(path, encoding="utf-8") as f:
        for piece in json.load(f)["model"]["vocab"]:
            ends = piece.endswith("</w>")
            out.append((bytes(letters[c] for c in (piece[:-4] if ends else piece)), ends))
    return out


SPLIT_AT = dict.fromkeys(range(9, 14), " ")
LOWER = str.maketrans({c: c.lower() for c in map(chr, range(65, 91))} | {chr(k): v for k, v in SPLIT_AT.items()})


def count_pieces(docs: DataFrame, pieces: list[tuple[bytes, bool]], id_col: str = "doc_id", text_col: str = "text") -> DataFrame:
    """doc_id, n_words, n_pieces and max_pieces (of one word) per document.

    Words are runs without ASCII white space, A-Z lower-cased. Null and blank texts have 0 of all.
    A word that the vocabulary can't segment counts as one piece. Repeated rows and null ids stay;
    extra columns are not read and an empty table gives no rows. Whole texts are counted, however long. The automaton
    (bounded by the vocabulary) is broadcast once.
    """
    shared = docs.sparkSession.sparkContext.broadcast(LongestMatch(pieces))

    def run(batches):
        counts = Counts(shared.value)
        for batch in batches:
            n_words, n_pieces, most = [], [], []
            for text in batch.column(1):
                words = [w for w in (text.as_py() or "").translate(LOWER).split(" ") if w]
                got = list(map(counts.__getitem__, words))
                n_words.append(len(words))
                n_pieces.append(sum(got))
                most.append(max(got, default=0))
            yield pa.RecordBatch.from_arrays([batch.column(0), *(pa.array(x, pa.int64()) for x in (n_words, n_pieces, most))], names=["doc_id", "n_words", "n_pieces", "max_pieces"])

    cols = docs.select(F.col(f"`{id_col}`").cast("long").alias("doc_id"), F.col(f"`{text_col}`").alias("text"))
    return cols.mapInArrow(run, "doc_id long, n_words long, n_pieces long, max_pieces long")


def op1_word_pieces(spark, sf_dir: str, vocabulary: str | None = None) -> DataFrame:
    if vocabulary is None:
        import public_tokenizers

        vocabulary = public_tokenizers.path("word_bpe_49k.json")
    return count_pieces(spark.read.parquet(f"{sf_dir}/documents.parquet"), read_pieces(vocabulary))
