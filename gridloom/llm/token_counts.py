"""Token counts by prefix dynamic programming.

The last token of a prefix is the one vocabulary string that ends there and is right next to
the last token of what is before it; the count is that prefix's count plus one.  So one pass
over a pre-token gives the exact token count at each of its prefixes.  Pre-tokens repeat, so
their totals are kept (a bounded cache), and a text's count is the sum over its pre-tokens.
A total needs the counts of as many prefixes as a token is long, so unsplit text of any length
takes no more memory than a word; long texts are cut into pre-tokens a slab at a time.
``PrefixCounts`` then answers how many tokens any prefix has, or where to cut for a budget,
without encoding again.

Defined results: a null text is empty; very long texts and pre-tokens are counted whole;
special strings inside a text are one token each, as in the library; repeated rows get equal
results; an empty table gives an empty result; extra columns pass through, replacing ones
named like the added columns.
"""

from __future__ import annotations

from array import array
from collections.abc import Iterator
from functools import lru_cache

import numpy as np
import pyarrow as pa
import regex
from pyspark.sql import DataFrame
from pyspark.sql import types as T

from gridloom.llm.batches import in_text_batches
from gridloom.llm.bpe import TreeEncoder, encoder, vocabulary

LIMIT = 1024
CACHED = 300_000  # pre-tokens, and pairs of tokens, that a worker keeps
SLAB = 1 << 20  # characters that are cut into pre-tokens at once

_WHITE = regex.compile(r"\s+")
#: No pre-token runs over such a place, and what is cut on either side doesn't look beyond it.
_APART = regex.compile(r"(?<=\S)[ \n]")


@lru_cache(maxsize=4)
def counter(path: str) -> TokenCounter:
    return TokenCounter(path)


class TokenCounter:
    def __init__(self, path: str):
        import ahocorasick

        self.coder: TreeEncoder = encoder(path)
        self.length = {i: len(s) for i, s in self.coder.piece.items()}
        self.kept = max(self.length.values()) + 1
        self.endings = ahocorasick.Automaton()
        for i, s in self.coder.piece.items():
            self.endings.add_word(s, i)
        self.endings.make_automaton()
        self.fits: dict[tuple[int, int], bool] = {}
        self.totals = _Totals(self)

    def right_together(self, a: int, b: int) -> bool:
        """True if the two tokens' joint string is encoded as these two."""
        known = self.fits.get((a, b))
        if known is None:
            if len(self.fits) >= 2 * CACHED:
                self.fits.clear()
            piece = self.coder.piece
            known = self.fits[a, b] = self.coder.bare.encode(piece[a] + piece[b], add_special_tokens=False).ids == [a, b]
        return known

    def byte_total(self, mapped: str) -> int:
        """Tokens of one pre-token; prefixes that are further back than a token is long are forgotten."""
        kept = self.kept
        count, last = [0] * kept, [-1] * kept
        length, fits, at, done = self.length, self.right_together, 0, False
        for end, token in self.endings.iter(mapped):  # of one end, longer strings come first
            if end + 1 == at and done:
                continue
            at = end + 1
            before = at - length[token]
            done = before == 0 or fits(last[before % kept], token)
            if done:
                count[at % kept], last[at % kept] = count[before % kept] + 1, token
        return count[at % kept]

    def byte_table(self, mapped: str) -> array:
        """Tokens of every byte prefix of one pre-token."""
        count, last = (array("i", [0]) * (len(mapped) + 1) for _ in range(2))
        length, fits, at, done = self.length, self.right_together, 0, False
        for end, token in self.endings.iter(mapped):  # of one end, longer strings come first
            if end + 1 == at and done:
                continue
            at = end + 1
            before = at - length[token]
            done = before == 0 or fits(last[before], token)
            if done:
                count[at], last[at] = count[before] + 1, token
        return count

    def table(self, pretoken: str) -> np.ndarray:
        """Tokens of every prefix, by characters, of one pre-token."""
        count = np.array(self.byte_table(self.coder.mapped(pretoken)))
        if len(count) == len(pretoken) + 1:
            return count
        ends = np.cumsum([0, *(len(c.encode()) for c in pretoken)])
        return count[ends]

    def count(self, text: str, slab: int = SLAB) -> int:
        total = self.totals.__getitem__
        return sum(1 if special else sum(sum(map(total, self.coder.pretokens(s))) for s in slabs(part, slab)) for _, part, special in self.coder.parts(text))


def slabs(text: str, slab: int = SLAB) -> Iterator[str]:
    """The text in pieces that are cut into pre-tokens as the whole is; each ends at the first place after ``slab`` characters where that holds."""
    at = 0
    while len(text) - at > slab and (m := _APART.search(text, at + slab)):
        yield text[at : m.start()]
        at = m.start()
    yield text[at:] if at else text


class _Totals(dict):
    """Pre-token → tokens; long ones aren't kept."""

    def __init__(self, counter: TokenCounter):
        super().__init__()
        self.counter = counter

    def __missing__(self, pretoken: str) -> int:
        n = self.counter.byte_total(self.counter.coder.mapped(pretoken))
        if len(pretoken) <= 64:
            if len(self) >= CACHED:
                self.clear()
            self[pretoken] = n
        return n


class PrefixCounts:
    """Exact token counts of every prefix ``text[:p]``."""

    def __init__(self, text: str | None, path: str | None = None):
        self.text = text or ""
        self.counts = _prefix_counts(self.text, counter(path or vocabulary()))

    def total(self) -> int:
        return int(self.counts[-1])

    def at(self, characters: int) -> int:
        return int(self.counts[min(characters, len(self.text))])

    def cut_for(self, budget: int) -> int:
        """The most characters whose prefix has at most ``budget`` tokens."""
        return int(np.flatnonzero(self.counts <= budget)[-1]) if budget >= 0 else 0

    def truncated(self, budget: int) -> str:
        return self.text[: self.cut_for(budget)]


def _prefix_counts(text: str, c: TokenCounter) -> np.ndarray:
    out = np.zeros(len(text) + 1, np.int64)
    base = 0
    sure = 0  # a place before which every prefix through it is cut alike
    sure_base = 0
    for start, part, special in c.coder.parts(text):
        if special:
            # inside the special string the prefix is ordinary text, and what is before it may be cut otherwise
            for k in range(1, len(part)):
                out[start + k] = sure_base + len(c.coder.encode(text[sure : start + k]))
            base += 1
            out[start + len(part)] = base
            sure, sure_base = start + len(part), base
            continue
        at = start
        bases: dict[int, int] = {}
        for pretoken in c.coder.pretokens(part):
            bases[at] = base
            counts = c.table(pretoken)
            out[at + 1 : at + len(pretoken) + 1] = base + counts[1:]
            if pretoken in ("'re", "'ve", "'ll"):
                out[at + 2] = base + 2  # a contraction's first two characters are cut apart
            base += int(counts[-1])
            at += len(pretoken)
        sure, sure_base = start, bases.get(start, base)
        # a prefix that ends in white space has that whole run as one pre-token
        for m in _WHITE.finditer(part):
            run = start + m.start()
            out[run + 1 : run + len(m[0]) + 1] = bases[run] + c.table(m[0])[1:]
            sure, sure_base = run, bases[run]
    return out


def token_counts(documents: DataFrame, path: str | None = None, limit: int = LIMIT, keep_text: bool = True) -> DataFrame:
    """``documents`` with ``n_bytes``, ``n_tokens`` and ``over_limit``."""
    path = path or vocabulary()
    added = [T.StructField("n_bytes", T.LongType()), T.StructField("n_tokens", T.LongType()), T.StructField("over_limit", T.BooleanType())]
    rows = documents.drop(*(f.name for f in added))
    kept = [c for c in rows.columns if keep_text or c != "text"]

    def counted(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        count = counter(path).count
        for batch in batches:
            texts = [t or "" for t in batch.column("text").to_pylist()]
            n = [count(t) for t in texts]
            columns = [*(batch.column(c) for c in kept), pa.array([len(t.encode()) for t in texts], pa.int64()), pa.array(n, pa.int64()), pa.array([x > limit for x in n])]
            yield pa.RecordBatch.from_arrays(columns, [*kept, *(f.name for f in added)])

    return in_text_batches(rows).mapInArrow(counted, T.StructType([*(rows.schema[c] for c in kept), *added]))


def op8_token_counts(spark, sf_dir: str) -> DataFrame:
    documents = spark.read.parquet(f"{sf_dir}/documents.parquet").select("doc_id", "text")
    return token_counts(documents, keep_text=False).select("doc_id", "n_bytes", "n_tokens", "over_limit")
