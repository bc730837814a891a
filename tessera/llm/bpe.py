"""Byte-level BPE by monoid tree reduction.

The encodings of byte strings form a monoid: join(encode(a), encode(b)) = encode(a + b). A long piece is halved recursively
and neighbours are joined by encoding again a window of tokens around the seam. The window grows until the tokens next to it
fit: two adjacent tokens fit if their bytes together encode to just these two. A sequence whose adjacent tokens all fit is the
encoding of its bytes, as merges inside a token don't depend on what lies beyond a boundary that no merge crosses; so tokens
outside the window can't change any more. Decoding concatenates the two halves' bytes up the tree.

A text is cut into pieces by the tokenizer's pattern; each is encoded separately; a piece that is a token itself is that token.
Nulls and edges: null and empty texts have no tokens; very long pieces need memory in proportion to their length only. An empty table gives
no rows; a null id keeps its row and repeated rows are rows of their own; other columns aren't read, so their names can't clash.
"""

from __future__ import annotations

import base64
import hashlib
from collections.abc import Iterator

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

LEAF = 8  # bytes that are merged at once
IDS = 64  # ids whose bytes are put together at once
WINDOW = 256  # bytes of a window that are merged at once
CACHED = 500_000  # pieces, or pairs of neighbours, that a worker remembers
ROWS = 200  # texts whose ids are held at once
SCHEMA = "doc_id bigint, n_tokens bigint, ids_sha256 string, decoded_sha256 string"


class Tree:
    """Encoder and decoder of one vocabulary; ranks maps a token's bytes to its id, which is its merge rank too."""

    def __init__(self, ranks: dict[bytes, int]):
        self.ranks, self.bytes_of, self.fits_seen = ranks, {v: k for k, v in ranks.items()}, {}

    def merged(self, piece: bytes) -> list[int]:
        """Merges of a short piece: the pair of lowest rank first, the leftmost of equals."""
        parts, ranks = [piece[i : i + 1] for i in range(len(piece))], self.ranks
        while len(parts) > 1:
            best, at = None, -1
            for i in range(len(parts) - 1):
                r = ranks.get(parts[i] + parts[i + 1])
                if r is not None and (best is None or r < best):
                    best, at = r, i
            if best is None:
                break
            parts[at : at + 2] = [parts[at] + parts[at + 1]]
        return [ranks[p] for p in parts]

    def fits(self, a: int, b: int) -> bool:
        known = self.fits_seen.get((a, b))
        if known is None:
            if len(self.fits_seen) >= CACHED:
                self.fits_seen.clear()
            known = self.fits_seen[a, b] = self.merged(self.bytes_of[a] + self.bytes_of[b]) == [a, b]
        return known

    def join(self, left: list[int], right: list[int]) -> list[int]:
        if not left or not right:
            return left + right
        if self.fits(left[-1], right[0]):
            return left + right
        i = j = 1
        while True:
            i, j = min(i, len(left)), min(j, len(right))
            window = self.encode_tree(b"".join(map(self.bytes_of.__getitem__, left[-i:] + right[:j])), whole=False)
            left_ok = i == len(left) or self.fits(left[-i - 1], window[0])
            right_ok = j == len(right) or self.fits(window[-1], right[j])
            if left_ok and right_ok:
                return left[: len(left) - i] + window + right[j:]
            i, j = i if left_ok else 2 * i, j if right_ok else 2 * j

    def encode_tree(self, piece: bytes, whole: bool = True) -> list[int]:
        """whole=False stands for a window, which is merged at once while it is small and halved at another place if not."""
        if len(piece) <= (LEAF if whole else max(LEAF, WINDOW)):
            return self.merged(piece)
        half = len(piece) // 2
        return self.join(self.encode_tree(piece[:half]), self.encode_tree(piece[half:]))

    def encode(self, piece: bytes) -> list[int]:
        known = self.ranks.get(piece)
        return [known] if known is not None else self.encode_tree(piece)

    def decode(self, ids: list[int]) -> bytes:
        """Up the tree: the leaves are IDS ids each, and neighbours are put together level by level."""
        parts = [b"".join(map(self.bytes_of.__getitem__, ids[i : i + IDS])) for i in range(0, len(ids), IDS)]
        while len(parts) > 1:
            parts = [b"".join(parts[i : i + 2]) for i in range(0, len(parts), 2)]
        return parts[0] if parts else b""


def read_ranks(path: str) -> dict[bytes, int]:
    with open(path, "rb") as f:
        return {base64.b64decode(token): int(rank) for token, rank in map(bytes.split, f)}


class _Pieces(dict):
    """piece -> tuple of ids, encoded when first met; emptied when full."""

    def __init__(self, tree: Tree):
        super().__init__()
        self.tree = tree

    def __missing__(self, piece: str) -> tuple[int, ...]:
        ids = tuple(self.tree.encode(piece.encode("utf-8")))
        if len(piece) <= 64:
            if len(self) >= CACHED:
                self.clear()
            self[piece] = ids
        return ids


#: The vocabulary that this worker was last given, with the pieces encoded so far: its next task goes on with them.
_KEPT: list[tuple[dict[bytes, int], _Pieces]] = []


def _pieces(ranks: dict[bytes, int]) -> _Pieces:
    if not _KEPT or _KEPT[0][0] is not ranks:
        _KEPT[:] = [(ranks, _Pieces(Tree(ranks)))]
    return _KEPT[0][1]


def encode_texts(docs: DataFrame, ranks: dict[bytes, int], pattern: str, id_col: str = "doc_id", text_col: str = "text") -> DataFrame:
    """doc_id and ids (array of int) of every text; the vocabulary (a fixed size) travels in a broadcast."""
    shared = docs.sparkSession.sparkContext.broadcast(ranks)

    def run(batches: Iterator) -> Iterator:
        import pyarrow as pa
        import regex
        from itertools import chain

        pieces, cut = _pieces(shared.value), regex.compile(pattern)
        for batch in batches:
            for lo in range(0, batch.num_rows, ROWS):
                part = batch.slice(lo, ROWS)
                ids = [list(chain.from_iterable(map(pieces.__getitem__, cut.findall(t.as_py())))) for t in part.column(1)]
                yield pa.RecordBatch.from_arrays([part.column(0), pa.array(ids, pa.list_(pa.int32()))], ["doc_id", "ids"])

    return docs.select(F.col(id_col).alias("doc_id"), F.coalesce(F.col(text_col), F.lit("")).alias("text")).mapInArrow(run, "doc_id bigint, ids array<int>")


def digests(docs: DataFrame, ranks: dict[bytes, int], pattern: str, id_col: str = "doc_id", text_col: str = "text") -> DataFrame:
    """Encodes and decodes every text in one pass over it: number of tokens, SHA-256 of the ids and of the decoded bytes."""
    shared = docs.sparkSession.sparkContext.broadcast(ranks)

    def run(batches: Iterator) -> Iterator:
        import pyarrow as pa
        import regex
        from itertools import chain

        pieces, cut, sha = _pieces(shared.value), regex.compile(pattern), hashlib.sha256
        tree = pieces.tree
        names = {i: str(i) for i in tree.bytes_of}
        for batch in batches:
            n, a, b = [], [], []
            for text in batch.column(1):
                ids = list(chain.from_iterable(map(pieces.__getitem__, cut.findall(text.as_py()))))
                n.append(len(ids))
                a.append(sha(",".join(map(names.__getitem__, ids)).encode()).hexdigest())
                b.append(sha(tree.decode(ids)).hexdigest())
            yield pa.RecordBatch.from_arrays([batch.column(0), pa.array(n, pa.int64()), pa.array(a), pa.array(b)], ["doc_id", "n_tokens", "ids_sha256", "decoded_sha256"])

    return docs.select(F.col(id_col).alias("doc_id"), F.coalesce(F.col(text_col), F.lit("")).alias("text")).mapInArrow(run, SCHEMA)
