"""Operator 1 - token counts by a count-only Viterbi over a unigram vocabulary.

An Aho-Corasick automaton of the vocabulary enumerates, at each position, every piece that
ends there, longest first. Dynamic programming carries the best score and the number of
tokens only; no segmentation is kept. The rules are those of the unigram model of the
``tokenizers`` library with byte fallback: a later (shorter) piece wins by a strictly
better score only; a character that is no piece costs the lowest score less 10 and counts
as its UTF-8 bytes. The text is cut before each space (U+0020, written U+2581, one put in
front), pieces never join across a cut, and no other normalization is made - the
``Metaspace`` pre-tokenizer. So a text's count is the sum over its words, and a worker
remembers the words it has met.

Vocabulary and scores are those of a sentencepiece model, taken as they are. Null or empty
text: no tokens, score 0. Rows are counted one by one, repeated ids too; extra columns are
ignored; an empty table gives an empty result.
"""

from __future__ import annotations

import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from . import blocks as B

SPACE = "▁"
UNK_PENALTY = 10.0
MEMO_WORDS = 150_000


def vocabulary(path: str | None = None) -> list[tuple[str, float]]:
    """(piece, score) of a sentencepiece model, by id."""
    import sentencepiece

    if path is None:
        import public_tokenizers

        path = public_tokenizers.path("piece_bpe_32k.model")
    sp = sentencepiece.SentencePieceProcessor(model_file=path)
    return [(sp.id_to_piece(i), sp.get_score(i)) for i in range(sp.get_piece_size())]


class Counter:
    """Best score and token count of a word under a unigram vocabulary."""

    def __init__(self, pieces: list[tuple[str, float]]):
        import ahocorasick

        self.automaton = ahocorasick.Automaton()
        for piece, score in pieces:
            if piece:
                self.automaton.add_word(piece, (len(piece), score))
        self.automaton.make_automaton()
        self.single = {p for p, _ in pieces if len(p) == 1}
        self.unknown = min(s for _, s in pieces) - UNK_PENALTY
        self.memo: dict = {}

    def solve(self, word: str) -> tuple[int, float]:
        n = len(word)
        score, count = [None] * (n + 1), [0] * (n + 1)
        score[0] = 0.0
        matches = self.automaton.iter(word)
        end, match = next(matches, (n, None))
        for e in range(n):
            best, number = None, 0
            while end == e:
                length, gain = match
                before = score[e + 1 - length]
                if before is not None and (best is None or before + gain > best):
                    best, number = before + gain, count[e + 1 - length] + 1
                end, match = next(matches, (n, None))
            if word[e] not in self.single:
                s = score[e] + self.unknown
                if best is None or s > best:
                    best, number = s, count[e] + len(word[e].encode("utf-8", "surrogatepass"))
            score[e + 1], count[e + 1] = best, number
        return count[n], score[n]

    def __call__(self, texts: list[str]) -> list[tuple[int, float]]:
        """(tokens, score) of each text."""
        words = []
        for text in texts:
            if SPACE in text:  # the sign itself cuts like a space
                text = text.replace(SPACE, " ")
            words.append(text[text.startswith(" "):].split(" ") if text else [])
        known = B.remembered(self.memo, set().union(*words), lambda new: [self.solve(SPACE + w) for w in new], MEMO_WORDS)
        tokens = {w: v[0] for w, v in known.items()}
        score = {w: v[1] for w, v in known.items()}
        return [(sum(map(tokens.__getitem__, ws)), float(sum(map(score.__getitem__, ws)))) for ws in words]


def token_counts(docs: DataFrame, path: str | None = None, id_col: str = "doc_id", text_col: str = "text") -> DataFrame:
    """(doc_id, n_chars, n_tokens, score): tokens of each text and the best segmentation's score."""

    def count(batches):
        cache = B.process_cache("token_count")
        if cache.get("path") != (path,):
            cache.update(path=(path,), counter=Counter(vocabulary(path)))
        counter = cache["counter"]
        for batch in batches:
            texts = [t.as_py() or "" for t in batch.column(1)]
            got = [g for at in range(0, len(texts), 256) for g in counter(texts[at:at + 256])]
            yield pa.RecordBatch.from_arrays(
                [batch.column(0), pa.array([len(t) for t in texts], pa.int64()), pa.array([g[0] for g in got], pa.int64()),
                 pa.array([g[1] for g in got], pa.float64())], names=["doc_id", "n_chars", "n_tokens", "score"])

    return docs.select(F.col(id_col).cast("long").alias("doc_id"), F.col(text_col)).mapInArrow(
        count, "doc_id long, n_chars long, n_tokens long, score double")


def query(spark, sf_dir: str) -> DataFrame:
    return token_counts(spark.read.parquet(f"{sf_dir}/documents.parquet"))
