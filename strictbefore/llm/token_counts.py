"""Token counts under a unigram model, by dynamic programming over a trie.

The distinct pre-tokens that a task meets are inserted in a trie. The forward score of a trie node, the best sum of piece
scores over all ways to split its prefix, is computed once when the node is made, however many pre-tokens share the prefix;
a node where a pre-token ends stores its count of tokens. A document's count is the sum over its pre-tokens.

Pieces come from a published vocabulary file; a piece's score is -ln(rank + 1) in millionths, Zipf's law for its rank,
as that file states ranks only: nothing is trained. Scores are integers, so sums are exact; of equal sums the fewer
tokens count. A character that no piece covers costs its UTF-8 bytes in tokens and UNKNOWN each.

Pre-tokens are the runs between white space ``[\\x20\\x09-\\x0D]``, with the vocabulary's word mark in front.

Defined cases: null, empty and blank texts count 0. Repeated rows give repeated rows; extra columns play no part; an
empty table gives an empty result.
"""

from __future__ import annotations

import math
import re
from collections.abc import Iterator
from functools import lru_cache

import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

MARK = "▁"
UNKNOWN = 20_000_000
#: Trie nodes of a worker, after which it starts a new trie; pre-tokens longer than LONG are scored without being kept.
NODES, LONG = 1_500_000, 64
RUN = re.compile(r"[^\x20\x09-\x0D]+")


def piece_scores(path: str) -> dict[str, int]:
    """Score of each ordinary piece of a sentencepiece file, by its rank in the file."""
    import sentencepiece

    model = sentencepiece.SentencePieceProcessor(model_file=path)
    ids = [i for i in range(model.get_piece_size()) if not (model.is_control(i) or model.is_unknown(i) or model.is_byte(i) or model.is_unused(i))]
    return {model.id_to_piece(i): -round(1e6 * math.log(rank + 1)) for rank, i in enumerate(ids, 1)}


class Trie(dict):
    """Pre-token to token count; the trie's nodes are (children, path), their forward scores and counts lie in lists."""

    def __init__(self, scores: dict[str, int]):
        super().__init__()
        self.scores = scores
        self.longest = max(map(len, scores))
        self.nodes()

    def nodes(self) -> None:
        self.children: list[dict[str, int]] = [{}]
        self.best: list[int] = [0]
        self.count: list[int] = [0]
        root = self.grow(0, "", MARK, [0])
        self.root = root

    def grow(self, parent: int, prefix: str, char: str, path: list[int]) -> int:
        """The child of ``parent`` at ``char``: path lists the nodes of the prefix, the root's first."""
        text = prefix + char
        n = len(text)
        cost = len(char.encode())
        best, count = self.best[parent] - UNKNOWN * cost, self.count[parent] + cost
        get = self.scores.get
        for begin in range(max(0, n - self.longest), n):
            score = get(text[begin:])
            if score is not None:
                at = path[begin]
                total, tokens = self.best[at] + score, self.count[at] + 1
                if total > best or (total == best and tokens < count):
                    best, count = total, tokens
        node = len(self.best)
        self.children.append({})
        self.best.append(best)
        self.count.append(count)
        self.children[parent][char] = node
        return node

    def __missing__(self, run: str) -> int:
        if len(run) > LONG:
            return self.long(run)
        if len(self.best) > NODES:
            self.clear()
            self.nodes()
        path, node = [0, self.root], self.root
        prefix = MARK
        for char in run:
            child = self.children[node].get(char)
            if child is None:
                child = self.grow(node, prefix, char, path)
            node = child
            path.append(node)
            prefix += char
        self[run] = self.count[node]
        return self.count[node]

    def long(self, run: str) -> int:
        """The same forward pass over one long run, holding scores of the last ``longest`` places only."""
        text = MARK + run
        get, width = self.scores.get, self.longest
        best, count = [0], [0]
        for n in range(1, len(text) + 1):
            first = max(0, n - width)
            base = n - len(best)  # the place that best[0] stands for
            cost = len(text[n - 1].encode())
            b, c = best[-1] - UNKNOWN * cost, count[-1] + cost
            for begin in range(first, n):
                score = get(text[begin:n])
                if score is not None:
                    total, tokens = best[begin - base] + score, count[begin - base] + 1
                    if total > b or (total == b and tokens < c):
                        b, c = total, tokens
            best.append(b)
            count.append(c)
            if len(best) > width:
                del best[0], count[0]
        return count[-1]


@lru_cache(maxsize=1)
def trie(path: str) -> Trie:
    """A worker's trie of a vocabulary file, which every node has at this path; it outlives tasks."""
    return Trie(piece_scores(path))


def count_tokens(docs: DataFrame, path: str, id_col: str = "doc_id", text_col: str = "text") -> DataFrame:
    """One row per document: id, n_tokens, n_words."""

    def mapped(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        own = trie(path)
        for batch in batches:
            tokens, words = [], []
            for text in batch.column(1):
                found = RUN.findall(text.as_py() or "")
                tokens.append(sum([own[run] for run in found]))
                words.append(len(found))
            yield pa.RecordBatch.from_arrays([batch.column(0), pa.array(tokens, pa.int64()), pa.array(words, pa.int64())], names=["id", "n_tokens", "n_words"])

    return docs.select(docs[id_col].cast("long").alias("id"), docs[text_col].cast("string").alias("text")).mapInArrow(mapped, "id long, n_tokens long, n_words long").select("id", F.col("n_tokens"), "n_words")
