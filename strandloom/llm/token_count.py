"""Token counts by a linear longest-match automaton.

The greedy word-piece tokenizer takes the longest entry that starts a word, then the longest continuation, and so on.
The automaton is a trie over both kinds of entries.  Every node has a failure link, which leads to where matching goes
on after the longest entries of what has been read are taken, and the number of entries that the link takes ("popped").
So a word is read once, byte by byte, and its length in pieces is a sum of popped counts; no piece is ever built.
"""

from __future__ import annotations

from collections.abc import Iterable, Iterator

import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

#: Words that a task remembers before it forgets them all, and bytes of one: longer ones are counted anew.
MEMO, MEMO_BYTES = 400_000, 64
CHUNK = 1 << 20


class Automaton:
    """Counts the greedy longest-match pieces of words.

    ``starts`` are the entries at the beginning of a word, ``rest`` those after it.  A word that cannot be cut into
    entries counts as one unknown piece.
    """

    ROOT, INSIDE = 0, 1

    def __init__(self, starts: Iterable[bytes], rest: Iterable[bytes]):
        self.step: dict[int, int] = {}
        children: list[list[tuple[int, int]]] = [[], []]
        final = [False, False]
        for root, entries in ((self.ROOT, starts), (self.INSIDE, rest)):
            for entry in entries:
                at = root
                for byte in entry:
                    to = self.step.get(at << 8 | byte)
                    if to is None:
                        to = self.step[at << 8 | byte] = len(final)
                        children[at].append((byte, to))
                        children.append([])
                        final.append(False)
                    at = to
                final[at] = at > self.INSIDE
        self.link, self.popped = [-1] * len(final), [0] * len(final)
        queue = [self.ROOT, self.INSIDE]
        for at in queue:  # breadth first, so a parent's link is known before its children's
            for byte, to in children[at]:
                queue.append(to)
                if final[to]:
                    self.link[to], self.popped[to] = self.INSIDE, 1
                    continue
                back, taken = self.link[at], self.popped[at]
                while back >= 0 and back << 8 | byte not in self.step:
                    taken += self.popped[back]
                    back = self.link[back]
                if back >= 0:
                    self.link[to], self.popped[to] = self.step[back << 8 | byte], taken

    def count(self, word: bytes) -> int:
        """Pieces of one word."""
        step, link, popped = self.step, self.link, self.popped
        at, taken = self.ROOT, 0
        for byte in word:
            to = step.get(at << 8 | byte)
            while to is None:
                if link[at] < 0:
                    return 1
                taken += popped[at]
                at = link[at]
                to = step.get(at << 8 | byte)
            at = to
        while at != self.INSIDE:  # take what is left
            if link[at] < 0:
                return 1
            taken += popped[at]
            at = link[at]
        return taken


class Memo(dict):
    def __init__(self, automaton: Automaton, mark: bytes):
        self.automaton, self.mark = automaton, mark

    def __reduce__(self):
        return Memo, (self.automaton, self.mark)

    def __missing__(self, word: bytes) -> int:
        n = self.automaton.count(self.mark + word)
        if len(word) <= MEMO_BYTES:
            if len(self) >= MEMO:
                self.clear()
            self[word] = n
        return n


def split_vocabulary(entries: Iterable[bytes], mark: bytes = b" ") -> tuple[list[bytes], list[bytes]]:
    """Entries that begin a word (those with the mark in front) and all others, as word pieces."""
    starts, rest = [], []
    for x in entries:
        (starts if x.startswith(mark) else rest).append(x)
    return starts, rest


def _words(text: str) -> Iterator[list[bytes]]:
    raw = text.encode()
    if len(raw) <= CHUNK:
        yield raw.split()
        return
    kept = b""
    for i in range(0, len(raw), CHUNK):
        part = kept + raw[i : i + CHUNK]
        words = part.split()
        kept = words.pop() if words and not part[-1:].isspace() else b""
        yield words
    yield kept.split()


def token_counts(docs: DataFrame, entries: list[bytes], mark: bytes = b" ", id_col: str = "doc_id", text: str = "text") -> DataFrame:
    """One row a document: ``id_col, n_words, n_tokens``; nothing is shuffled.

    Words end at ASCII white space and are matched with ``mark`` in front.  Null and empty texts have no words.  The
    finished automaton is broadcast; its size is bounded by the tokenizer's vocabulary, not by the data.  Repeated rows come out repeated;
    other columns are not read; an empty table gives an empty result.
    """
    held, kind = docs.sparkSession.sparkContext.broadcast(Memo(Automaton(*split_vocabulary(entries, mark)), mark)), docs.schema[id_col].dataType.simpleString()

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        memo = held.value  # one for all tasks of a worker process; it is bounded
        for batch in batches:
            words, tokens = [], []
            for x in batch.column(1):
                n = t = 0
                for part in _words(x.as_py() or ""):
                    n += len(part)
                    t += sum(map(memo.__getitem__, part))
                words.append(n)
                tokens.append(t)
            yield pa.RecordBatch.from_arrays([batch.column(0), pa.array(words, pa.int64()), pa.array(tokens, pa.int64())], ["_id", "n_words", "n_tokens"])

    return docs.select(F.col(id_col).alias("_id"), F.col(text).alias("_text")).mapInArrow(run, f"_id {kind}, n_words long, n_tokens long").withColumnRenamed("_id", id_col)


def greedy(word: bytes, starts: set[bytes], rest: set[bytes]) -> int:
    """What the automaton counts, by trying every length: for tests."""
    at, n = 0, 0
    while at < len(word):
        known = starts if at == 0 else rest
        end = next((e for e in range(len(word), at, -1) if word[at:e] in known), None)
        if end is None:
            return 1
        at, n = end, n + 1
    return n


def corpus_total(counts: DataFrame) -> DataFrame:
    """Words and tokens of all documents."""
    return counts.agg(F.sum("n_words").alias("n_words"), F.sum("n_tokens").alias("n_tokens"))


__all__ = ["Automaton", "corpus_total", "greedy", "split_vocabulary", "token_counts"]
