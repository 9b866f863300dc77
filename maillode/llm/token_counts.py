"""Token counts under a unigram model, with the forward scores shared in a trie.

A text is the number of its words' tokens. The best segmentation of a word is found from left
to right: the score of a prefix is the best score of a shorter prefix plus that of the piece
in between. Words with a common beginning share these scores, so distinct words are put into a
trie, a node is scored once, when it is first made, and the node where a word ends keeps the
word's number of tokens. The trie of a worker process lasts from batch to batch.
"""

from __future__ import annotations

from collections.abc import Iterator

import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from .shared import lasting, no_collections

#: Stands before every word, as in the vocabulary's pieces.
MARK = "▁"
#: Nodes that a worker's trie keeps (some 500 bytes each); beyond that it starts anew, with
#: the same results.
MOST_NODES = 300_000
#: Words whose counts a worker keeps; those that come later are counted whenever they come.
MOST_WORDS = 400_000
#: A character that no piece covers falls back on its bytes; a byte's score lies this much
#: below the worst piece.
FALLBACK = 10.0
_END = ""  # in a node of the vocabulary: the score of the piece that ends here


class Node:
    """A prefix: its best score and number of tokens, and the pieces that may go on from it.

    A piece that has begun is its node in the vocabulary's trie, with the score and tokens of
    the prefix before it.
    """

    __slots__ = ("score", "tokens", "begun", "next")

    def __init__(self, score: float, tokens: int, begun: list[tuple[dict, float, int]]):
        self.score, self.tokens, self.begun = score, tokens, begun
        self.next: dict[str, Node] = {}


class Trie:
    def __init__(self, pieces: dict[str, float]):
        self.vocabulary: dict = {}
        for piece, score in pieces.items():
            node = self.vocabulary
            for letter in piece:
                node = node.setdefault(letter, {})
            node[_END] = score
        self.byte_score = min(pieces.values(), default=0.0) - FALLBACK
        self.counts: dict[str, int] = {}
        self._reset()

    def _reset(self) -> None:
        self.root = Node(0.0, 0, [(self.vocabulary, 0.0, 0)])
        self.nodes = 1

    def count(self, word: str) -> int:
        """Tokens of the best segmentation; of equal scores, of the one with fewest tokens."""
        if self.nodes > MOST_NODES:
            self._reset()
        node = self.root
        for letter in MARK + word:
            found = node.next.get(letter)
            if found is None:
                found = node.next[letter] = self._scored(node, letter)
                self.nodes += 1
            node = found
        return node.tokens

    def _scored(self, before: Node, letter: str) -> Node:
        width = 1 if letter < "\x80" else len(letter.encode("utf-8", "surrogatepass"))
        best, fewest = before.score + width * self.byte_score, before.tokens + width
        begun = []
        for piece, score, tokens in before.begun:
            longer = piece.get(letter)
            if longer is None:
                continue
            own = longer.get(_END)
            if own is not None:
                whole = score + own
                if whole > best or (whole == best and tokens + 1 < fewest):
                    best, fewest = whole, tokens + 1
                if len(longer) == 1:
                    continue
            begun.append((longer, score, tokens))
        begun.append((self.vocabulary, best, fewest))
        return Node(best, fewest, begun)

    def count_all(self, words: list[str]) -> int:
        new = set(words).difference(self.counts)
        for word in new:
            self.counts[word] = self.count(word)
        total = sum(map(self.counts.__getitem__, words))
        if len(self.counts) > MOST_WORDS:  # those that came last go again
            for word in new:
                del self.counts[word]
        return total


def read_pieces(path: str) -> dict[str, float]:
    """Pieces and scores of a sentencepiece model, without its control and byte pieces."""
    from sentencepiece import SentencePieceProcessor

    model = SentencePieceProcessor(model_file=path)
    return {
        model.id_to_piece(i): model.get_score(i)
        for i in range(model.get_piece_size())
        if not (model.is_control(i) or model.is_unknown(i) or model.is_byte(i) or model.is_unused(i))
    }


def trie(path: str) -> Trie:
    """The trie of this worker process."""
    return lasting(("trie", path), lambda: Trie(read_pieces(path)))


def count_tokens(docs: DataFrame, vocabulary: str) -> DataFrame:
    """``doc_id``, ``n_words``, ``n_tokens`` of each row's whole text; null: none.

    Words are what stands between white space (Unicode). Other columns are ignored.
    """

    def counted(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        shared = trie(vocabulary)
        for batch in batches:
            words, tokens = [], []
            for start in range(0, len(batch), 256):
                with no_collections():
                    for text in batch["text"].slice(start, 256).to_pylist():
                        seen = text.split() if text else []
                        words.append(len(seen))
                        tokens.append(shared.count_all(seen))
            yield pa.RecordBatch.from_arrays(
                [batch["doc_id"], pa.array(words, pa.int64()), pa.array(tokens, pa.int64())],
                ["doc_id", "n_words", "n_tokens"],
            )

    return docs.select(F.col("doc_id").cast("long"), "text").mapInArrow(
        counted, "doc_id long, n_words long, n_tokens long"
    )
