"""Token counts by a linear longest-match automaton.

The vocabulary is a trie; each node has a failure link and the number of tokens popped on the way along it, so one pass over
a word counts its greedy (longest piece first) word pieces without building them. Pieces that begin with the meta symbol
begin words, all others continue them. A word that the pieces cannot cover counts as one unknown token.

Words are runs of anything but ASCII white space. Null or empty texts and texts of white space have no words and no tokens.
Repeated rows are each counted and equal texts have equal counts, so there are no ties. Very long texts and words of any length
are taken whole. An empty table gives an empty result. Extra columns are not read.
"""

from __future__ import annotations

from collections import deque

from pyspark.sql import DataFrame

from . import common
from .common import rows_mapped, shipped, vocabulary_bytes

shipped(__name__)
META = "▁"


def vocabulary(model: bytes) -> tuple[set[str], set[str]]:
    """The pieces that begin words and those that continue them."""
    import sentencepiece

    sp = sentencepiece.SentencePieceProcessor(model_proto=model)
    names = [sp.id_to_piece(i) for i in range(sp.get_piece_size()) if not (sp.is_control(i) or sp.is_unknown(i) or sp.is_byte(i))]
    return {n[1:] for n in names if n[0] == META and len(n) > 1 and META not in n[1:]}, {n for n in names if META not in n}


class Automaton:
    """Nodes are numbers; 0 is the root of word beginnings, 1 the root of continuations."""

    def __init__(self, beginnings: set[str], continuations: set[str]):
        self.next: list[dict[str, int]] = [{}, {}]
        accepts = [False, False]
        for root, pieces in ((0, beginnings), (1, continuations)):
            for piece in pieces:
                node = root
                for c in piece:
                    if c not in self.next[node]:
                        self.next[node][c] = len(self.next)
                        self.next.append({})
                        accepts.append(False)
                    node = self.next[node][c]
                accepts[node] = True
        self.fail, self.popped = [-1] * len(self.next), [0] * len(self.next)
        queue = deque([0, 1])
        while queue:
            parent = queue.popleft()
            for c, node in self.next[parent].items():
                queue.append(node)
                if accepts[node]:
                    self.fail[node], self.popped[node] = 1, 1
                    continue
                at, popped = self.fail[parent], self.popped[parent]
                while at >= 0 and c not in self.next[at]:
                    popped += self.popped[at]
                    at = self.fail[at]
                if at >= 0:
                    self.fail[node], self.popped[node] = self.next[at][c], popped

    def count(self, word: str) -> int:
        """Greedy pieces of a word; 0 if they cannot cover it."""
        node, n = 0, 0
        following, fail, popped = self.next, self.fail, self.popped
        for c in word:
            while (to := following[node].get(c)) is None:
                n += popped[node]
                node = fail[node]
                if node < 0:
                    return 0
            node = to
        while node != 1:
            n += popped[node]
            node = fail[node]
            if node < 0:
                return 0
        return n


class Counts(dict):
    """Word -> its count, remembered up to a bound."""

    def __init__(self, automaton: Automaton, bound: int):
        super().__init__()
        self.count, self.bound = automaton.count, bound

    def __missing__(self, word: bytes) -> int:
        if len(self) >= self.bound:
            self.clear()
        self[word] = n = self.count(word.decode())
        return n


def counter(model: bytes, bound: int = 300_000):
    """A function for rows_mapped: (n_words, n_tokens, n_unknown) of each text."""

    def make():
        get = Counts(Automaton(*vocabulary(model)), bound).__getitem__

        def of(texts):
            out = []
            for x in texts:
                counts = list(map(get, (x or b"").split()))
                unknown = counts.count(0)
                out.append((len(counts), sum(counts) + unknown, unknown))
            return out

        return of

    return make


def token_counts(docs: DataFrame, model_path: str | None = None, text: str = "text", keys: tuple[str, ...] = ("doc_id",)) -> DataFrame:
    """keys, n_words, n_tokens (unknown words included) and n_unknown of each text."""
    return rows_mapped(docs, counter(vocabulary_bytes(model_path)), "n_words long, n_tokens long, n_unknown long", keys=keys, text=text)


def op2_token_counts(spark, sf_dir: str) -> DataFrame:
    return token_counts(common.table(spark, sf_dir, "documents"))
