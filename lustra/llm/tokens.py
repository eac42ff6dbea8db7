"""Token counts: unigram segmentation of distinct pre-tokens, scored once per shared prefix in a trie."""

from __future__ import annotations

import math
from collections import Counter
from collections.abc import Iterator

import pyarrow as pa
from pyspark.sql import DataFrame

from lustra.llm.words import schema_with, without

TOKENIZER = "/opt/tokenizers/piece_bpe_32k.model"
NODES = 1 << 19  # nodes a task keeps; a full trie is emptied
RESULT = "n_pretokens bigint, n_tokens bigint"
SPACE = "▁"


def load_pieces(path: str = TOKENIZER) -> dict[str, float]:
    """Pieces of a SentencePiece vocabulary with a log probability by rank: the n-th weighs 1 / (n + 1).

    The file must be readable on the driver only.  Control and byte pieces are left out.
    """
    from sentencepiece import SentencePieceProcessor

    model = SentencePieceProcessor(model_file=path)
    keep = [
        model.id_to_piece(i)
        for i in range(model.vocab_size())
        if not (model.is_control(i) or model.is_byte(i) or model.is_unknown(i) or model.is_unused(i))
    ]
    total = math.log(sum(1 / (n + 2) for n in range(len(keep))))
    return {p: -math.log(n + 2) - total for n, p in enumerate(keep)}


class Trie:
    """Prefixes of pre-tokens with their best forward score.

    A node stands for a prefix and holds the highest log probability of any segmentation of it and the
    number of tokens of that segmentation (fewer tokens win a tie).  A character without a piece of its
    own counts as its UTF-8 bytes, each a token less likely than any piece.
    """

    def __init__(self, pieces: dict[str, float], nodes: int = NODES):
        self.pieces, self.limit = pieces, nodes
        self.longest = max(map(len, pieces), default=1)
        self.unknown = min(pieces.values(), default=0.0) - 10.0
        self.clear()

    def clear(self) -> None:
        self.child: list[dict[str, int]] = [{}]
        self.score, self.count = [0.0], [0]
        self.terminal: dict[str, int] = {}

    def tokens(self, word: str) -> int:
        """Tokens of one pre-token, from its terminal if it was met before."""
        known = self.terminal.get(word)
        if known is not None:
            return known
        if len(word) > 512:
            return self._long(word)
        if len(self.child) + len(word) > self.limit:
            self.clear()
        path, node = [0], 0
        for end, ch in enumerate(word, 1):
            below = self.child[node].get(ch)
            if below is None:
                below = len(self.child)
                self.child[node][ch] = below
                self.child.append({})
                score, count = self._forward(word, end, [self.score[i] for i in path[-self.longest :]], [self.count[i] for i in path[-self.longest :]])
                self.score.append(score)
                self.count.append(count)
            node = below
            path.append(node)
        self.terminal[word] = self.count[node]
        return self.count[node]

    def _forward(self, word: str, end: int, scores: list[float], counts: list[int]) -> tuple[float, int]:
        """Best way to reach ``end``; the lists hold the last prefixes, the nearest last."""
        bytes_ = len(word[end - 1].encode("utf-8", "surrogatepass"))
        best, fewest = scores[-1] + bytes_ * self.unknown, counts[-1] + bytes_
        get = self.pieces.get
        for length in range(1, len(scores) + 1):
            weight = get(word[end - length : end])
            if weight is not None:
                score, count = scores[-length] + weight, counts[-length] + 1
                if score > best or score == best and count < fewest:
                    best, fewest = score, count
        return best, fewest

    def _long(self, word: str) -> int:
        """Very long pre-tokens share hardly any prefix: the same recurrence over a sliding window."""
        scores, counts = [0.0], [0]
        for end in range(1, len(word) + 1):
            score, count = self._forward(word, end, scores, counts)
            scores, counts = (scores + [score])[-self.longest :], (counts + [count])[-self.longest :]
        return counts[-1]


def count_tokens(docs: DataFrame, pieces: dict[str, float] | None = None, nodes: int = NODES) -> DataFrame:
    """``docs`` with n_pretokens and n_tokens of each whole text.

    Pre-tokens are the words between white space, each with the space mark in front.  Null and empty
    texts have none.  Rows are counted each on its own, without a shuffle; result columns replace input
    columns of the same name.  The vocabulary is the only thing sent to the tasks.
    """
    sent = docs.sparkSession.sparkContext.broadcast(load_pieces() if pieces is None else pieces)
    rest = without(docs, ["n_pretokens", "n_tokens"])
    fields = schema_with(rest, RESULT)

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        trie = Trie(sent.value, nodes)
        for batch in batches:
            held = [Counter((t.as_py() or "").split()) for t in batch.column("text")]
            # In sorted order neighbours share long prefixes, whose nodes are then still there.
            length = {w: trie.tokens(SPACE + w) for w in sorted(set().union(*held))}
            words = pa.array([sum(c.values()) for c in held], pa.int64())
            total = pa.array([sum(n * length[w] for w, n in c.items()) for c in held], pa.int64())
            yield pa.RecordBatch.from_arrays([*batch.columns, words, total], names=fields.names)

    return rest.mapInArrow(run, fields)
