"""Token counts of a unigram tokenizer without its tokens.

An Aho-Corasick automaton lists every vocabulary piece that ends at each character; dynamic programming carries the best score
and its number of pieces. Tie rules are the tokenizer's own: ends are filled by starts in ascending order and only a greater
score replaces one, so of equal scores the longest last piece wins. A character that no single-character piece covers may
be an unknown piece, at the lowest score less 10; unknown pieces fall back to one piece per UTF-8 byte if the vocabulary has all
byte pieces, else neighbours are fused into one. Texts are cut before each space, spaces become U+2581 and a text without one in
front gets it, as the tokenizer's word splitter does.

Nulls and edges: null and empty texts have 0 pieces and score 0. A word of any length takes one pass over it.
"""

from __future__ import annotations

from collections.abc import Iterator

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

SPACE = "▁"
PENALTY = 10.0
CACHED = 200_000


class Counter(dict):
    """word -> (score, pieces); words are kept while there is room."""

    def __init__(self, pieces: list[tuple[str, float]]):
        import ahocorasick

        super().__init__()
        self.trie = ahocorasick.Automaton()
        for piece, score in pieces:
            if piece:
                self.trie.add_word(piece, (len(piece), score))
        self.trie.make_automaton()
        self.unknown = min(s for _, s in pieces) - PENALTY
        names = {p for p, _ in pieces}
        self.bytes_too = all(f"<0x{b:02X}>" in names for b in range(256))

    def __missing__(self, word: str) -> tuple[float, int]:
        found = self.count(word)
        if len(word) <= 64:
            if len(self) >= CACHED:
                self.clear()
            self[word] = found
        return found

    def count(self, word: str) -> tuple[float, int]:
        n = len(word)
        best, pieces, unknown = [0.0] * (n + 1), [0] * (n + 1), [False] * (n + 1)
        matches = self.trie.iter(word)
        end, found = next(matches, (n, None))
        for at in range(n):
            score, come, single = None, 0, False
            while end == at:
                length, own = found
                single |= length == 1
                here = best[at + 1 - length] + own
                start = at + 1 - length
                # Matches come longest first, that is by ascending start: an equal score doesn't replace.
                if score is None or here > score:
                    score, come = here, start
                end, found = next(matches, (n, None))
            is_unknown = False
            if not single:
                here = best[at] + self.unknown
                if score is None or here > score:
                    score, come, is_unknown = here, at, True
            best[at + 1] = score
            unknown[at + 1] = is_unknown
            if not is_unknown:
                pieces[at + 1] = pieces[come] + 1
            elif self.bytes_too:
                pieces[at + 1] = pieces[at] + len(word[at].encode("utf-8"))
            else:
                pieces[at + 1] = pieces[at] + (not unknown[at])
        return best[n], pieces[n]


def split(text: str) -> list[str]:
    """A text's words, each with its space in front."""
    text = text.replace(" ", SPACE)
    return [SPACE + w for w in text.removeprefix(SPACE).split(SPACE)] if text else []


def count_pieces(docs: DataFrame, pieces: list[tuple[str, float]], id_col: str = "doc_id", text_col: str = "text") -> DataFrame:
    """doc_id, n_pieces and score for every row of docs; the vocabulary (a fixed size) travels in a broadcast."""
    shared = docs.sparkSession.sparkContext.broadcast(pieces)

    def run(batches: Iterator) -> Iterator:
        import pyarrow as pa

        known = Counter(shared.value)
        for batch in batches:
            scores, counts = [], []
            for text in batch.column(1):
                found = [known[w] for w in split(text.as_py())]
                scores.append(sum(s for s, _ in found))
                counts.append(sum(c for _, c in found))
            yield pa.RecordBatch.from_arrays([batch.column(0), pa.array(counts, pa.int64()), pa.array(scores, pa.float64())], ["doc_id", "n_pieces", "score"])

    return docs.select(F.col(id_col).alias("doc_id"), F.coalesce(F.col(text_col), F.lit("")).alias("text")).mapInArrow(run, "doc_id bigint, n_pieces bigint, score double")


def read_pieces(path: str) -> list[tuple[str, float]]:
    """Pieces and scores of a SentencePiece model file; control and unknown pieces are left out."""
    import sentencepiece

    model = sentencepiece.SentencePieceProcessor(model_file=path)
    return [(model.id_to_piece(i), model.get_score(i)) for i in range(model.get_piece_size()) if not (model.is_control(i) or model.is_unknown(i))]
