"""Token counts of a unigram tokenizer by trie-shared dynamic programming.

Each task puts the distinct pre-tokens of a batch in a trie and walks it in order. A node's forward score is that of the best
segmentation of its prefix; it depends on the path alone, so it is computed once for all pre-tokens that share the prefix.
Only the current path is kept. At a pre-token's last node its token count is stored; documents sum the stored counts.

Scores are those of a unigram model's file. A file of merges has none; there they come from the vocabulary's own order (it lists
pieces by falling frequency): the logarithm of Zipf and Mandelbrot's law. A character without a piece costs its UTF-8 bytes as
tokens.
"""

from __future__ import annotations

import math
from collections.abc import Iterator

import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from tidemark.llm.common import as_bytes, batches_of, per_worker, pieces, words

#: The sign that stands for the space before a word in sentencepiece vocabularies.
MARK = "▁"
CACHE_WORDS = 500_000
#: What a byte of an unknown character costs, beyond the rarest piece.
BYTE_PENALTY = 10.0


def unigram_scores(path: str) -> dict[str, float]:
    """Log probability of each ordinary piece of a sentencepiece model: a unigram model's own, or by rank where the model has
    none (a BPE model's scores are whole numbers, the order of its merges)."""
    import sentencepiece

    p = sentencepiece.SentencePieceProcessor(model_file=path)
    ordinary = [i for i in range(p.get_piece_size()) if not (p.is_control(i) or p.is_unknown(i) or p.is_byte(i) or p.is_unused(i))]
    own = {p.id_to_piece(i): p.get_score(i) for i in ordinary}
    if any(s != int(s) for s in own.values()):
        return own
    total = sum(1 / (k + 2.7) for k in range(len(own)))
    return {piece: -math.log((k + 2.7) * total) for k, piece in enumerate(own)}


class PrefixTrie:
    """Forward scores along the current path of a trie whose words come in sorted order."""

    def __init__(self, scores: dict[str, float]) -> None:
        self.scores = scores
        self.longest = max(map(len, scores), default=1)
        self.byte = min(scores.values(), default=0.0) - BYTE_PENALTY
        self.path, self.best, self.tokens, self.nodes = "", [0.0], [0], 0

    def count(self, word: str) -> int:
        """Tokens of the word's best segmentation; prefixes shared with the word before are not computed again."""
        path, best, tokens, scores, longest = self.path, self.best, self.tokens, self.scores, self.longest
        shared, most = 0, min(len(path), len(word))
        while shared < most and path[shared] == word[shared]:
            shared += 1
        del best[shared + 1 :], tokens[shared + 1 :]
        for end in range(shared + 1, len(word) + 1):
            n = len(word[end - 1].encode("utf-8", "replace"))
            top, made = -math.inf, 0
            for start in range(max(0, end - longest), end):
                s = scores.get(word[start:end])
                if s is not None and best[start] + s > top:
                    top, made = best[start] + s, tokens[start] + 1
            if top == -math.inf:
                top, made = best[end - 1] + n * self.byte, tokens[end - 1] + n
            best.append(top)
            tokens.append(made)
        self.nodes += len(word) - shared
        self.path = word
        return tokens[-1]


def count_words(new: list[bytes], scores: dict[str, float]) -> dict[bytes, int]:
    """Token counts of distinct pre-tokens, by one walk through their trie."""
    trie = PrefixTrie(scores)
    decoded = sorted((MARK + w.decode("utf-8", "replace"), w) for w in new)
    return {w: trie.count(text) for text, w in decoded}


def count_tokens(docs: DataFrame, model: str) -> DataFrame:
    """doc_id, n_words, n_tokens of each row of ``docs`` (doc_id, text), whole texts.

    Pre-tokens are words ``[^\\x20\\x09-\\x0D]+``; a null, empty or blank text has none. Ties between segmentations go to the
    longer last piece. Very long texts and words are counted whole. Each row counts for itself, also if its doc_id repeats or is null; other columns are left."""
    schema = pa.schema([("doc_id", pa.int64()), ("n_words", pa.int64()), ("n_tokens", pa.int64())])

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        scores, known = per_worker(("unigram", model), lambda: (unigram_scores(model), {}))
        for piece in pieces(batches, 1024):
            texts = [words(t) for t in as_bytes(piece, "text")]
            if len(known) > CACHE_WORDS:
                known.clear()
            known.update(count_words([w for w in {w for t in texts for w in t} if w not in known], scores))
            yield from batches_of(schema, [piece.column("doc_id"), [len(t) for t in texts], [sum(map(known.__getitem__, t)) for t in texts]])

    return docs.select(F.col("doc_id").cast("long"), F.col("text").cast("binary")).mapInArrow(run, "doc_id long, n_words long, n_tokens long")
