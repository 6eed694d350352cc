"""Token counts of a unigram tokenizer without making its tokens.

An Aho-Corasick automaton over the vocabulary lists every piece that occurs in a word; dynamic
programming over the word's positions carries the score of the best segmentation and its number of
pieces, and nothing else. The rules are those of the tokenizers library's unigram model: spaces
become word marks, a word starts at its mark, pieces are tried from left to right and a later start
replaces a segmentation only by a strictly higher score (so of equal scores the longest last piece
stays), a character that is no piece costs ``min(score) - 10``. Unknown characters side by side are
one token; with byte pieces in the vocabulary every byte of them is one.

Defined cases: a null or empty text has 0 tokens; repeated rows are counted each; an empty table
gives no rows.
"""

from __future__ import annotations

from collections.abc import Iterator

import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from gapspark.llm.common import arrow_schema, batches_of, in_chunks, worker_state

MARK = "▁"
UNKNOWN_COST = 10.0
LONG_WORD = 48
CLOSED, ALONE, RUN = range(3)


def read_vocabulary(path: str) -> list[tuple[str, float]]:
    """Pieces and scores of a sentencepiece model file, read as unigram vocabulary as they stand."""
    import sentencepiece

    model = sentencepiece.SentencePieceProcessor(model_file=path)
    return [(model.id_to_piece(i), model.get_score(i)) for i in range(model.get_piece_size())]


class Counter(dict):
    """Pieces of a word, remembered up to ``room`` words."""

    def __init__(self, vocabulary: list[tuple[str, float]], unknown: int = 0, room: int = 700_000):
        import ahocorasick

        super().__init__()
        self.room = room
        self.automaton = ahocorasick.Automaton()
        for i, (piece, score) in enumerate(vocabulary):
            self.automaton.add_word(piece, (len(piece), score, i == unknown))
        self.automaton.make_automaton()
        self.unknown_score = min(score for _, score in vocabulary) - UNKNOWN_COST
        pieces = {piece for piece, _ in vocabulary}
        self.by_bytes = all(f"<0x{b:02X}>" in pieces for b in range(256))
        self.unknown_piece = vocabulary[unknown][0]

    def __missing__(self, word: str) -> int:
        n = self.viterbi(word)
        if len(self) < self.room and len(word) <= LONG_WORD:
            self[word] = n
        return n

    def viterbi(self, word: str) -> int:
        size = len(word)
        ends: list[list] = [[] for _ in range(size)]
        for last, match in self.automaton.iter(word):
            ends[last].append(match)
        # at each position: best score, pieces, and whether it ends a run of unknown pieces; ALONE is
        # a run that is just the spelled-out unknown piece, which the library finds again by name
        best, count, open_run = [0.0] * (size + 1), [0] * (size + 1), [CLOSED] * (size + 1)
        single = [False] * size
        for last, matches in enumerate(ends):
            at, found, score_at = last + 1, False, 0.0
            matches.sort(reverse=True, key=lambda m: m[0])  # earlier starts first
            for length, score, is_unknown in matches:
                start = at - length
                if length == 1:
                    single[last] = True
                score += best[start]
                if not found or score > score_at:
                    found, score_at = True, score
                    from_start, unknown = start, is_unknown
            if not single[last] and (not found or best[last] + self.unknown_score > score_at):
                score_at, from_start, unknown = best[last] + self.unknown_score, last, True
            best[at] = score_at
            before = open_run[from_start]
            if not unknown:
                count[at] = count[from_start] + 1
            elif not self.by_bytes:
                count[at], open_run[at] = count[from_start] + (before == CLOSED), RUN
            elif before == CLOSED and at - from_start > 1:
                count[at], open_run[at] = count[from_start] + 1, ALONE
            else:
                joined = len(self.unknown_piece.encode()) - 1 if before == ALONE else 0
                count[at], open_run[at] = count[from_start] + joined + len(word[from_start:at].encode()), RUN
        return count[size]

    def count(self, text: str) -> int:
        if not text:
            return 0
        marked = text.replace(" ", MARK)
        if marked[0] == MARK:
            marked = marked[1:]
        return sum(map(self.__getitem__, [MARK + w for w in marked.split(MARK)]))


def counter(path: str) -> Counter:
    key = ("counter", path)
    if key not in (state := worker_state()):
        state[key] = Counter(read_vocabulary(path))
    return state[key]


def token_counts(docs: DataFrame, vocabulary: str, doc_id: str = "doc_id", text: str = "text") -> DataFrame:
    """doc_id and n_tokens of every row's whole text, for the vocabulary file ``vocabulary``."""
    batches_of(docs.sparkSession)
    columns = "doc_id long, n_tokens long"
    schema = arrow_schema(columns)

    def count(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        counts = counter(vocabulary)

        def rows():
            for batch in batches:
                for name, value in zip(batch.column(0).to_pylist(), batch.column(1).to_pylist()):
                    yield name, counts.count(value or "")

        yield from in_chunks(rows(), schema)

    return docs.select(F.col(doc_id).cast("long"), F.col(text)).mapInArrow(count, columns)
