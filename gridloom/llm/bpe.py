"""Byte-level BPE: exact encoding of any text by tree concatenation; decoding.

A text between special strings is cut into halves, wherever that falls, down to leaves of at most
``LEAF`` characters.  Leaves are encoded in parallel: all new pre-tokens of a batch go through the
library at once.  Two neighbours are joined by cutting a window around the join into pre-tokens
and encoding them anew; it starts with ``WINDOW`` pre-tokens on either side and grows on each side
until both sides agree: its first pre-tokens are the left half's and its last ones the right half's.

A pre-token that runs over the join is a tree too: the tokens of its two halves are joined by a
window of tokens, which grows until its first token is the left half's and its last one the right
half's.  Adjacent tokens that are right together make a right whole, so unsplit text of any length
gets its tokens from such joins alone.

Defined results: a null text is empty and has no tokens; special strings inside a text are the
library's special tokens; repeated rows get equal results; an empty table gives an empty result;
extra columns pass through ``encode_documents``, replacing ones named like the added columns.
"""

from __future__ import annotations

import hashlib
import json
import os
import re
from collections.abc import Iterator, Sequence
from functools import lru_cache

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import types as T

from gridloom.llm.batches import in_text_batches

LEAF = 1024  # characters of a leaf
WINDOW = 3  # pre-tokens, or tokens of one, on either side of a join at first
SURE = 2  # pre-tokens at either end of a window that must agree: what follows one changes the two before at most
BATCH_CHARS = 1 << 20
CACHED = 300_000  # pre-tokens that a worker keeps, none longer than ``SHORT`` characters
SHORT = 64

#: Letters, and marks, up to U+024F.  Superscript digits and fractions, and the spaces of which only
#: some count as white space everywhere, are in neither: texts with those, or beyond, go the library's way.
_LETTERS = "A-Za-z\u00aa\u00b5\u00ba\u00c0-\u00d6\u00d8-\u00f6\u00f8-\u024f"
_MARKS = r"!-/:-@\[-`{-~" + "\u00a1-\u00a9\u00ab-\u00b1\u00b4\u00b6-\u00b8\u00bb\u00bf\u00d7\u00f7"
_OTHER = re.compile(f"[^\t-\r 0-9{_LETTERS}{_MARKS}]")
#: The public pattern of this vocabulary for texts of those.
_CUT = re.compile(rf" ?[{_LETTERS}]+|'(?:s|t|re|ve|m|ll|d)| ?[0-9]+| ?[{_MARKS}]+|\s+(?!\S)|\s+")


def vocabulary(name: str = "byte_bpe_50k.json") -> str:
    import public_tokenizers

    return public_tokenizers.path(name)


def byte_alphabet() -> list[str]:
    """The printable stand-in of each byte: itself, or the next code point from 256 on."""
    shown = {*range(0x21, 0x7F), *range(0xA1, 0xAD), *range(0xAE, 0x100)}
    spare = iter(range(256, 512))
    return [chr(b) if b in shown else chr(next(spare)) for b in range(256)]


class _Packed(dict):
    """Pre-token → its ids, packed as little-endian 32-bit numbers; long ones are kept for the texts at hand alone."""

    def __init__(self, coder: TreeEncoder):
        super().__init__()
        self.coder = coder
        self.long: dict[str, bytes] = {}

    def __missing__(self, pretoken: str) -> bytes:
        found = self.long.get(pretoken)
        if found is None:
            ids = self.coder.bare.encode(self.coder.mapped(pretoken), add_special_tokens=False).ids
            found = (self if len(pretoken) <= SHORT else self.long)[pretoken] = np.array(ids, "<u4").tobytes()
        return found


@lru_cache(maxsize=4)
def encoder(path: str) -> TreeEncoder:
    """One for each worker and file."""
    return TreeEncoder(path)


class TreeEncoder:
    def __init__(self, path: str):
        os.environ.setdefault("RAYON_NUM_THREADS", "2")
        from tokenizers import Tokenizer

        with open(path, encoding="utf-8") as f:
            spec = json.load(f)
        spec |= {"truncation": None, "padding": None}
        self.whole = Tokenizer.from_str(json.dumps(spec))
        bare = spec | {"pre_tokenizer": None, "added_tokens": [], "post_processor": None}
        self.bare = Tokenizer.from_str(json.dumps(bare))
        self.piece = {i: s for s, i in self.bare.get_vocab().items()}
        self.public = spec["pre_tokenizer"] == {"type": "ByteLevel", "add_prefix_space": False, "trim_offsets": True, "use_regex": True}
        self.alphabet = byte_alphabet()
        self.packed = _Packed(self)
        self.special = {t["content"]: t["id"] for t in spec["added_tokens"]}
        self.special_pattern = re.compile("|".join(map(re.escape, sorted(self.special, key=len, reverse=True)))) if self.special else None

    # -- texts ------------------------------------------------------------------------------

    def pretokens(self, text: str) -> list[str]:
        """As the library cuts a text without special strings."""
        if self.public and not _OTHER.search(text):
            return _CUT.findall(text)
        return [text[a:b] for _, (a, b) in self.whole.pre_tokenizer.pre_tokenize_str(text)]

    def parts(self, text: str) -> Iterator[tuple[int, str, bool]]:
        """(start, part, is special) of a text; parts between special strings are cut apart from each other."""
        at = 0
        for m in self.special_pattern.finditer(text) if self.special_pattern else ():
            if m.start() > at:
                yield at, text[at : m.start()], False
            yield m.start(), m[0], True
            at = m.end()
        if at < len(text):
            yield at, text[at:], False

    def encode(self, text: str) -> np.ndarray:
        """The library's ids of a text, without added special tokens, as little-endian 32-bit numbers."""
        return self.encode_all([text])[0]

    def encode_batch(self, texts: Sequence[str]) -> list[list[int]]:
        return [a.tolist() for a in self.encode_all(texts)]

    def encode_all(self, texts: Sequence[str]) -> list[np.ndarray]:
        """The ids of several texts, whose leaves are encoded in parallel."""
        forests = [[(part if special else None, None if special else self.leaves(part)) for _, part, special in self.parts(text)] for text in texts]
        self.learn({pretoken for forest in forests for _, leaves in forest for pretoken in set().union(*leaves or ())})
        out = []
        for forest in forests:
            found: list[bytes] = []
            for special, leaves in forest:
                if special is None:
                    found += map(self.packed.__getitem__, self.concatenated(leaves))
                else:
                    found.append(np.array([self.special[special]], "<u4").tobytes())
            out.append(np.frombuffer(b"".join(found), "<u4"))
        self.packed.long.clear()
        return out

    # -- trees ------------------------------------------------------------------------------

    def leaves(self, text: str) -> list[list[str]]:
        """The pre-tokens of each leaf: halves of halves, until none is longer than ``LEAF``."""
        n = 1
        while n * LEAF < len(text):
            n *= 2
        cuts = [i * len(text) // n for i in range(n + 1)]
        return [self.pretokens(text[a:b]) for a, b in zip(cuts, cuts[1:], strict=False)]

    def learn(self, pretokens: set[str]) -> None:
        """Encode what is not known yet, in parallel."""
        packed = self.packed
        new = [p for p in pretokens if p not in packed]
        if len(packed) + len(new) > CACHED:
            packed.clear()
        for i in range(0, len(new), CACHED):
            part = new[i : i + CACHED]
            for p, e in zip(part, self.bare.encode_batch_fast(list(map(self.mapped, part)), add_special_tokens=False), strict=True):
                (packed if len(p) <= SHORT else packed.long)[p] = np.array(e.ids, "<u4").tobytes()

    def concatenated(self, level: list[list[str]]) -> list[str]:
        """The pre-tokens of a text, all with known ids, from those of its leaves."""
        while len(level) > 1:
            level = [self.join(level[i], level[i + 1]) for i in range(0, len(level), 2)]
        return level[0]

    def join(self, left: list[str], right: list[str]) -> list[str]:
        """Both halves' pre-tokens as one run, exactly as if their text had not been cut; ``left`` grows in place."""
        if not left or not right:
            return left or right
        a = b = WINDOW
        while True:
            a, b = min(a, len(left)), min(b, len(right))
            window = self.pretokens("".join((*left[-a:], *right[:b])))
            agree_left = a == len(left) or window[:SURE] == left[-a:][:SURE]
            agree_right = b == len(right) or window[-SURE:] == right[:b][-SURE:]
            if agree_left and agree_right:
                break
            a, b = a if agree_left else 2 * a, b if agree_right else 2 * b
        over = left[-1] + right[0]
        if len(over) > SHORT and over in window and over not in self.packed.long:
            self.packed.long[over] = self.join_tokens(self.packed[left[-1]], self.packed[right[0]])
        left[-a:] = window
        left += right[b:]
        return left

    def join_tokens(self, left: bytes, right: bytes) -> bytes:
        """The tokens of one pre-token from those of its two halves."""
        first, second = np.frombuffer(left, "<u4"), np.frombuffer(right, "<u4")
        a = b = WINDOW
        while True:
            a, b = min(a, len(first)), min(b, len(second))
            window = "".join([self.piece[i] for i in (*first[-a:].tolist(), *second[:b].tolist())])
            ids = self.bare.encode(window, add_special_tokens=False).ids
            agree_left = a == len(first) or ids[0] == first[-a]
            agree_right = b == len(second) or ids[-1] == second[b - 1]
            if agree_left and agree_right:
                return b"".join((left[: 4 * (len(first) - a)], np.array(ids, "<u4").tobytes(), right[4 * b :]))
            a, b = a if agree_left else 2 * a, b if agree_right else 2 * b

    def mapped(self, pretoken: str) -> str:
        alphabet = self.alphabet
        return "".join([alphabet[b] for b in pretoken.encode()])

    def decode(self, ids: Sequence[int]) -> str:
        return self.whole.decode(ids, skip_special_tokens=False)


def in_chars(texts: Sequence[str], most: int = BATCH_CHARS) -> Iterator[list[str]]:
    """Runs of texts of about ``most`` characters, a longer text alone."""
    held: list[str] = []
    size = 0
    for text in texts:
        if held and size + len(text) > most:
            yield held
            held, size = [], 0
        held.append(text)
        size += len(text)
    if held:
        yield held


def encode_documents(documents: DataFrame, path: str | None = None, keep_text: bool = True, keep_ids: bool = True) -> DataFrame:
    """``documents`` with ``ids`` (array, if kept), ``n_tokens``, ``ids_sha256`` and ``decoded_sha256``."""
    path = path or vocabulary()
    added = [T.StructField("n_tokens", T.LongType()), T.StructField("ids_sha256", T.StringType()), T.StructField("decoded_sha256", T.StringType())]
    if keep_ids:
        added.insert(0, T.StructField("ids", T.ArrayType(T.IntegerType())))
    rows = documents.drop("ids", "n_tokens", "ids_sha256", "decoded_sha256")
    kept = [c for c in rows.columns if keep_text or c != "text"]

    def encoded(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        coder = encoder(path)
        for batch in batches:
            texts = [t or "" for t in batch.column("text").to_pylist()]
            at = 0
            for run in in_chars(texts):
                slice_ = batch.slice(at, len(run))
                at += len(run)
                arrays = coder.encode_all(run)
                columns = [slice_.column(c) for c in kept]
                if keep_ids:
                    columns.append(pa.array([a.astype(np.int32) for a in arrays], pa.list_(pa.int32())))
                columns += [
                    pa.array([len(a) for a in arrays], pa.int64()),
                    pa.array([hashlib.sha256(a.tobytes()).hexdigest() for a in arrays]),
                    pa.array([hashlib.sha256(coder.decode(a.tolist()).encode()).hexdigest() for a in arrays]),
                ]
                yield pa.RecordBatch.from_arrays(columns, [*kept, *(f.name for f in added)])

    return in_text_batches(rows).mapInArrow(encoded, T.StructType([*(rows.schema[c] for c in kept), *added]))


def op7_bpe(spark, sf_dir: str) -> DataFrame:
    documents = spark.read.parquet(f"{sf_dir}/documents.parquet").select("doc_id", "text")
    return encode_documents(documents, keep_text=False, keep_ids=False).select("doc_id", "n_tokens", "ids_sha256", "decoded_sha256")
