"""Token counts of a unigram vocabulary: Viterbi that carries score and count, but no path.

An Aho-Corasick automaton names every vocabulary piece ending at each character. ``best[end]`` is the
highest score over pieces ending there, with the number of tokens of that path; of equal scores the
piece that begins first wins, as in the tokenizer, which visits starts in order and replaces a path only
by a strictly better one. A character that no single-character piece covers may be taken alone at
``lowest score - 10``; it counts as its UTF-8 bytes where the vocabulary has byte pieces, else a run of
them as one unknown token. Scores are added in double precision.

White space is written as the word mark. When no piece has the mark after another character, the text
is scored between such borders, whose best paths never cross, and equal stretches are scored once.
"""

from __future__ import annotations

import functools
import re
from collections.abc import Iterator

import pyarrow as pa
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql.pandas.types import to_arrow_type

from veil.llm.store import table

MARK = "▁"


class Unigram:
    """Counts over (piece, score) pairs; ``byte_pieces``: unknown characters become bytes."""

    def __init__(self, pieces: list[tuple[str, float]], byte_pieces: bool, penalty: float = 10.0,
                 most: int = 1 << 18):
        import ahocorasick

        self.auto = ahocorasick.Automaton()
        for piece, score in pieces:
            self.auto.add_word(piece, (len(piece), float(score)))
        self.auto.make_automaton()
        self.unknown = min((s for _, s in pieces), default=0.0) - penalty
        self.single = {p for p, _ in pieces if len(p) == 1}
        self.byte_pieces, self.most = byte_pieces, most
        # Without byte pieces a run of unknown characters is one token, which may cross a border.
        self.splits = byte_pieces and not any(MARK in p.lstrip(MARK) for p, _ in pieces)
        self.find = re.compile(f"{MARK}*[^{MARK}]+|{MARK}+").findall
        self.known: dict[str, tuple[int, float]] = {}

    def viterbi(self, text: str) -> tuple[int, float]:
        """Tokens and score of the best path over one stretch."""
        n = len(text)
        score, count, begin, run = [0.0] * (n + 1), [0] * (n + 1), [-1] * (n + 1), [False] * (n + 1)
        ends: list[list[tuple[int, float]]] = [[] for _ in range(n)]
        for end, piece in self.auto.iter(text):
            ends[end].append(piece)
        for end in range(1, n + 1):
            for length, s in ends[end - 1]:
                start, total = end - length, score[end - length] + s
                if (begin[end] < 0 or total > score[end]
                        or (total == score[end] and start < begin[end])):
                    score[end], begin[end], count[end] = total, start, count[start] + 1
            if (c := text[end - 1]) not in self.single:
                total = score[end - 1] + self.unknown
                if begin[end] < 0 or total > score[end]:
                    more = len(c.encode()) if self.byte_pieces else int(not run[end - 1])
                    score[end], begin[end], run[end] = total, end - 1, True
                    count[end] = count[end - 1] + more
        return count[n], score[n]

    def count(self, text: str) -> tuple[int, float]:
        """Tokens and score of a text, after the word mark is put before it and for its spaces."""
        if not text:
            return 0, 0.0
        text = MARK + text.replace(" ", MARK)
        if not self.splits:
            return self.viterbi(text)
        known, tokens, total = self.known, 0, 0.0
        if len(known) > self.most:  # a bound on memory only
            known.clear()
        for part in self.find(text):
            if (got := known.get(part)) is None:
                got = known[part] = self.viterbi(part)
            tokens, total = tokens + got[0], total + got[1]
        return tokens, total


@functools.lru_cache(maxsize=2)
def unigram(path: str) -> Unigram:
    """The pieces and scores of a sentencepiece file, used as a unigram vocabulary."""
    import sentencepiece

    sp = sentencepiece.SentencePieceProcessor(model_file=path)
    plain = [(sp.id_to_piece(i), sp.get_score(i)) for i in range(sp.get_piece_size())
             if not (sp.is_control(i) or sp.is_unknown(i) or sp.is_byte(i) or sp.is_unused(i))]
    return Unigram(plain, any(sp.is_byte(i) for i in range(sp.get_piece_size())))


def _counted(path: str, id_type: pa.DataType):
    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        model = unigram(path)
        for b in batches:
            got = [model.count(t.as_py() or "") for t in b.column(1)]
            yield pa.RecordBatch.from_arrays(
                [b.column(0).cast(id_type), pa.array([g[0] for g in got], pa.int64()),
                 pa.array([g[1] for g in got], pa.float64())], names=["doc", "n_tokens", "score"])

    return run


def count_tokens(docs: DataFrame, path: str, id_col: str = "doc_id", text_col: str = "text") -> DataFrame:
    """id, n_tokens, score per row. Null and empty texts have no tokens; rows are kept one to one."""
    kind = docs.schema[id_col].dataType
    return (docs.select(id_col, text_col)
            .mapInArrow(_counted(path, to_arrow_type(kind)),
                        f"doc {kind.simpleString()}, n_tokens long, score double")
            .withColumnRenamed("doc", id_col))


def op2_token_counts(spark: SparkSession, sf_dir: str) -> DataFrame:
    import public_tokenizers

    return count_tokens(table(spark, sf_dir, "documents"), public_tokenizers.path("piece_bpe_32k.model"))
