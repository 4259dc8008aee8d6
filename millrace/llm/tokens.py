"""Token counts by byte-pair merging over a heap and a linked list.

The vocabulary file gives each piece a rank. Starting from single characters, the adjacent pair
of the lowest rank is merged again and again (ties: the leftmost). No identifiers are made: the
count is the number of initial symbols minus the number of merges, where a character that the
vocabulary lacks stands for as many symbols as it has UTF-8 bytes.

A piece never holds a space mark after another character, so the text falls apart before each run of
spaces, and each part is counted on its own; parts recur, and a bounded cache keeps their counts.

Defined cases: null and empty texts have no tokens; very long texts are whole; rows without an id keep the null; repeated rows
are counted each; an empty table gives no rows; other columns are not read, whatever their names.
"""

import re
from collections.abc import Iterator
from heapq import heapify, heappop, heappush

import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

MARK = "▁"
#: Longer parts are counted each time, so the cache is bounded in bytes as well.
KEPT = 48
_UNITS = re.compile(r" +[^ ]*")


class MergeCounter(dict):
    """Counts of the parts of a text that follow a space, worked out when first asked for."""

    def __init__(self, ranks: dict[str, int], cache: int = 600_000):
        super().__init__()
        self.ranks, self.cache, self.bare, self.older = ranks, cache, {}, {}
        self.apart = "\n" if not any("\n" in p for p in ranks) else ""

    def symbols(self, unit: str) -> int:
        """Symbols left of a unit when no pair can be merged any more."""
        ranks, n = self.ranks, len(unit)
        count = n
        if not unit.isascii() or not unit.isalpha():
            count += sum(len(c.encode("utf-8", "surrogatepass")) - 1 for c in unit if c not in ranks)
        if n < 2:
            return count
        symbol = list(unit)
        heap = [(ranks[p], i, p) for i, p in enumerate(map(str.__add__, unit, unit[1:])) if p in ranks]
        heapify(heap)
        after, before = list(range(1, n + 1)), list(range(-1, n - 1))
        while heap:
            _, i, piece = heappop(heap)
            j = after[i]
            if j >= n or symbol[i] + symbol[j] != piece:  # a part of this pair has been merged meanwhile
                continue
            symbol[i], symbol[j] = piece, ""
            count -= 1
            k = after[i] = after[j]
            after[j] = n
            if k < n:
                before[k] = i
                if (p := piece + symbol[k]) in ranks:
                    heappush(heap, (ranks[p], i, p))
            h = before[i]
            if h >= 0 and (p := symbol[h] + piece) in ranks:
                heappush(heap, (ranks[p], h, p))
        return count

    def __missing__(self, word: str) -> int:
        head, *tail = word.split(self.apart) if self.apart else [word]
        if not tail:
            if len(self) >= self.cache:  # the younger generation becomes the older one
                self.older = dict(self)
                self.clear()
            n = self.older.get(word)
            n = self.symbols(MARK + word.replace(" ", MARK)) if n is None else n
            if len(word) <= KEPT:
                self[word] = n
            return n
        n = self[head] + len(tail)
        for part in tail:
            if (m := self.bare.get(part)) is None:
                m = self.symbols(part)
                if len(part) <= KEPT:
                    if len(self.bare) >= self.cache:
                        self.bare.clear()
                    self.bare[part] = m
            n += m
        return n

    def count(self, text: str) -> int:
        """Tokens of a whole text."""
        if not text:
            return 0
        if MARK in text:
            text = text.replace(MARK, " ")
        if "  " in text or text[0] == " " or text[-1] == " ":
            return sum(map(self.__getitem__, (u[1:] for u in _UNITS.findall(" " + text))))
        return sum(map(self.__getitem__, text.split(" ")))


_counters: dict[str, MergeCounter] = {}


def merge_counter(name: str) -> MergeCounter:
    """The counter for a vocabulary file of the installed tokenizers, made once in each process."""
    if name not in _counters:
        import public_tokenizers
        import sentencepiece

        model = sentencepiece.SentencePieceProcessor(model_file=public_tokenizers.path(name))
        special = lambda i: model.is_control(i) or model.is_unknown(i) or model.is_byte(i) or model.is_unused(i)
        _counters[name] = MergeCounter({model.id_to_piece(i): -int(model.get_score(i)) for i in range(model.get_piece_size()) if not special(i)})
    return _counters[name]


def count_tokens(docs: DataFrame, model: str = "piece_bpe_32k.model", limit: int = 4096, ident: str = "doc_id", text: str = "text") -> DataFrame:
    """Per document: its id, UTF-8 bytes, tokens, and whether these exceed the limit."""

    def work(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        counter = merge_counter(model)
        for batch in batches:
            texts = [t or "" for t in batch.column(1).to_pylist()]
            n = [counter.count(t) for t in texts]
            yield pa.record_batch([batch.column(0), pa.array([len(t.encode()) for t in texts], pa.int64()), pa.array(n, pa.int64()), pa.array([x > limit for x in n], pa.bool_())], names=[ident, "n_bytes", "n_tokens", "over_limit"])

    kind = docs.schema[ident].dataType.simpleString()
    return docs.select(F.col(ident), F.col(text)).mapInArrow(work, f"{ident} {kind}, n_bytes long, n_tokens long, over_limit boolean")
