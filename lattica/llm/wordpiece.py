"""Token counts by linear longest match: greedy word-piece lengths without building the pieces.

The vocabulary is a trie with a root for word starts and one for continuations. A node's failure link leads to where
matching goes on once the longest piece that starts at the current place has been cut off; how many pieces were
cut off on the way is added up beforehand. Each character is then followed at most by amortised one link, so
a word takes time linear in its length.
"""

from __future__ import annotations

from collections import deque
from collections.abc import Iterable, Iterator

import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from lattica.llm.common import SPACES

#: Entries that a task keeps of its words' counts before it starts afresh; bounds memory, not results.
MEMO = 400_000


class Automaton:
    """starts: pieces that begin a word. rests: pieces that go on with one. Both without markers, none empty."""

    def __init__(self, starts: Iterable[str], rests: Iterable[str]):
        self.child: list[dict[str, int]] = [{}, {}]
        final = [False, False]
        for root, pieces in ((0, starts), (1, rests)):
            for piece in pieces:
                at = root
                for ch in piece:
                    nxt = self.child[at].get(ch)
                    if nxt is None:
                        nxt = self.child[at][ch] = len(self.child)
                        self.child.append({})
                        final.append(False)
                    at = nxt
                final[at] = True
        n = len(self.child)
        self.fail, self.popped = [-1] * n, [0] * n
        todo = deque([0, 1])
        while todo:
            u = todo.popleft()
            for ch, v in self.child[u].items():
                if final[v]:  # the whole path is a piece: cut it, go on at the continuation root
                    self.fail[v], self.popped[v] = 1, 1
                else:  # cut what the parent would cut, until the rest of the path can be matched
                    z, cut = self.fail[u], self.popped[u]
                    while z >= 0 and ch not in self.child[z]:
                        cut += self.popped[z]
                        z = self.fail[z]
                    if z >= 0:
                        self.fail[v], self.popped[v] = self.child[z][ch], cut
                todo.append(v)

    def count(self, word: str) -> int:
        """Pieces of the greedy segmentation; 0 if there is none."""
        child, fail, popped = self.child, self.fail, self.popped
        at, n = 0, 0
        for ch in word:
            nxt = child[at].get(ch)
            while nxt is None:
                n += popped[at]
                at = fail[at]
                if at < 0:
                    return 0
                nxt = child[at].get(ch)
            at = nxt
        while at != 1:  # what is left has to be cut up whole
            n += popped[at]
            at = fail[at]
            if at < 0:
                return 0
        return n


def pieces_of(model_file: str) -> tuple[list[str], list[str]]:
    """Word-start and continuation pieces of a sentencepiece vocabulary, without its special pieces."""
    import sentencepiece

    sp = sentencepiece.SentencePieceProcessor(model_file=model_file)
    plain = [sp.id_to_piece(i) for i in range(sp.get_piece_size()) if not (sp.is_control(i) or sp.is_unknown(i) or sp.is_byte(i) or sp.is_unused(i))]
    return [p[1:] for p in plain if len(p) > 1 and p[0] == "▁"], [p for p in plain if p[0] != "▁"]


def token_counts(docs: DataFrame, starts: list[str], rests: list[str], id_col: str = "doc_id", text_col: str = "text") -> DataFrame:
    """Per row: id, n_words, n_tokens, n_unknown (long). A word that cannot be cut up counts as one token and one unknown.

    Null and blank texts have zeros. Only the vocabulary is broadcast, whose size does not depend on the data. Words
    repeat, so a task counts each word once while it is remembered.
    """
    vocab = docs.sparkSession.sparkContext.broadcast((list(starts), list(rests)))
    kind = docs.schema[id_col].dataType.simpleString()

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        count = Automaton(*vocab.value).count
        to_space = {ord(c): " " for c in SPACES}
        memo: dict[str, int] = {}
        for batch in batches:
            n_words, n_tokens, n_unknown = [], [], []
            for text in batch.column(1).to_pylist():
                if text and not text.isascii():
                    split = [w for w in text.translate(to_space).split(" ") if w]
                else:
                    split = [w for w in _ascii_words(text or "")]
                total = unknown = 0
                for w in split:
                    k = memo.get(w)
                    if k is None:
                        if len(memo) >= MEMO:
                            memo.clear()
                        k = memo[w] = count(w)
                    total += k or 1
                    unknown += not k
                n_words.append(len(split))
                n_tokens.append(total)
                n_unknown.append(unknown)
            yield pa.RecordBatch.from_arrays([batch.column(0), *(pa.array(x, pa.int64()) for x in (n_words, n_tokens, n_unknown))], names=[id_col, "n_words", "n_tokens", "n_unknown"])

    return docs.select(id_col, F.col(text_col).cast("string")).mapInArrow(run, f"`{id_col}` {kind}, n_words long, n_tokens long, n_unknown long")


def _ascii_words(text: str) -> list[str]:
    """Split at ASCII white space; str.split() also takes the separators 0x1C-0x1F, which are no white space here."""
    if any(c in text for c in "\x1c\x1d\x1e\x1f"):
        for c in SPACES[1:]:
            text = text.replace(c, " ")
        return [w for w in text.split(" ") if w]
    return text.split()
