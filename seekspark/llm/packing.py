"""Best-fit packing of token pieces into sequences, by sums of squares.

Each piece goes where, afterwards, the squared counts of open bins by residual gap sum to the least: that keeps
every gap equally common, so that what comes next finds a bin that it fills.
"""

from __future__ import annotations

import os
import re
import struct
import zlib
from collections.abc import Iterator
from functools import lru_cache

import numpy as np
import pandas as pd
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F
from pyspark.sql import types as T

from seekspark.llm.common import free_names, pin, trimmed, without

#: Documents whose pieces are packed together (on average).
GROUP = 8192
#: Words of which a worker remembers the ids.
REMEMBERED = 200_000
#: How a byte-level BPE of this kind cuts a text into words (fixed value), for the characters of COMMON.
WORDS = r"'s|'t|'re|'ve|'m|'ll|'d| ?[^\W\d_]+| ?\d+| ?(?:[^\s\w]|_)+|\s+(?!\S)|\s+"
#: Texts of other characters go to the tokenizer whole, whose character classes may be of another Unicode version.
COMMON = r"[\t\n\r\x20-\x7E\xA0-\xB1\xB4-\xB8\xBA\xBB\xBF-\u024F\u2010-\u2027]*"
#: A character that COMMON has not.
APART = "\ue000"


class TokenIds:
    """Texts to ids, as the library gives them, remembering the ids of words.

    The words of a byte-level BPE are encoded independently of each other, so a text's ids are its words' ids in
    turn. Texts that hold the string of an added token, which the library cuts out first, go to it whole.
    """

    def __init__(self, path: str):
        # A task has one core; the library's own threads cost more than they give here.
        os.environ["TOKENIZERS_PARALLELISM"] = "false"
        from tokenizers import Tokenizer

        self.tokenizer = Tokenizer.from_file(path)
        self.words, self.common = re.compile(WORDS), re.compile(COMMON)
        added = [re.escape(t.content) for t in self.tokenizer.get_added_tokens_decoder().values()]
        self.added = re.compile("|".join(added) or r"(?!)")
        # What the tokenizer writes for each character that COMMON has, a letter a byte.
        common = filter(self.common.fullmatch, map(chr, range(0x2028)))
        self.bytes = {ord(c): self.tokenizer.pre_tokenizer.pre_tokenize_str(c)[0][0] for c in common}
        self.known: dict[str, bytes] = {}

    def _library(self, texts: list[str]) -> list[bytes]:
        return [np.array(e.ids, "<u4").tobytes() for e in self.tokenizer.encode_batch_fast(texts, add_special_tokens=False)]

    def _learn(self, new: list[str]) -> None:
        """Each word's ids from the tokenizer's model, which skips the library's cutting and alignment of texts."""
        tokens = self.tokenizer.model.tokenize
        for word, own in zip(new, APART.join(new).translate(self.bytes).split(APART)):
            ids = [x.id for x in tokens(own)]
            self.known[word] = struct.pack(f"<{len(ids)}I", *ids)

    def encode(self, texts: list[str]) -> list[bytes]:
        """Each text's ids as little-endian 32-bit numbers."""
        if len(self.known) > REMEMBERED:
            self.known.clear()
        plain = lambda t: self.common.fullmatch(t) and not self.added.search(t)
        cut = [self.words.findall(t) if plain(t) else None for t in texts]
        self._learn(list(set().union(*filter(None, cut)).difference(self.known)))
        other = iter(self._library([t for t, words in zip(texts, cut) if words is None]))
        get = self.known.__getitem__
        return [next(other) if words is None else b"".join(map(get, words)) for words in cut]


@lru_cache(maxsize=2)
def token_ids(path: str) -> TokenIds:
    """One a worker, not one a task."""
    return TokenIds(path)


PIECES = "piece int, start long, length long, ids_crc32 long"
PIECE_NAMES = [c.split()[0] for c in PIECES.split(", ")]


def pieces(docs: DataFrame, tokenizer: str, end_id: int, size: int, text: str = "text") -> DataFrame:
    """The pieces of each text's ids and ``end_id`` after them: a row a piece, beside all columns but the text.

    A text of at most ``size`` ids is one piece. A longer one is cut into pieces of ``size`` ids, of which the
    first may be shorter. Input columns named like those of a piece are replaced.
    """
    docs = without(docs, *PIECE_NAMES)
    other = [f for f in docs.schema.fields if f.name != text]
    schema = T.StructType([*other, *T.StructType.fromDDL(PIECES).fields])
    end = np.array([end_id], "<u4").tobytes()

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        ids = token_ids(tokenizer)
        for whole in batches:
            for at in range(0, whole.num_rows, 256):
                b = whole.slice(at, 256)
                of, piece, start, length, crc = [], [], [], [], []
                texts = [t or "" for t in b.column(b.schema.get_field_index(text)).to_pylist()]
                for i, own in enumerate(ids.encode(texts)):
                    own += end
                    n = len(own) // 4
                    first = (n - 1) % size + 1
                    for p, s in enumerate([0, *range(first, n, size)]):
                        e = first if p == 0 else s + size
                        of.append(i)
                        piece.append(p)
                        start.append(s)
                        length.append(e - s)
                        crc.append(zlib.crc32(own[4 * s : 4 * e]))
                rows = pa.RecordBatch.from_arrays([b.column(f.name) for f in other], [f.name for f in other]).take(pa.array(of))
                own = [pa.array(piece, pa.int32()), *(pa.array(x, pa.int64()) for x in (start, length, crc))]
                yield pa.RecordBatch.from_arrays([*rows.columns, *own], [f.name for f in schema.fields])

    return docs.mapInArrow(trimmed(run), schema)


def pack(lengths: np.ndarray, size: int) -> tuple[np.ndarray, np.ndarray, int]:
    """(bin, offset) of each length, and the number of bins: sum-of-squares packing, the longest first.

    With N(g) open bins of gap g, a piece of s tokens in a bin of gap g changes the sum of squares by
    2 (N(g-s) - N(g) + 1), or 1 - 2 N(g) if it fills it; of equal changes the smallest gap wins. A bin is opened
    only where no open one fits: on real lengths that needs 3 % fewer bins than to weigh a new bin like the rest,
    and as few as best fit decreasing.
    """
    bins, offsets = np.zeros(len(lengths), np.int64), np.zeros(len(lengths), np.int64)
    count = np.zeros(size + 1, np.int64)
    stacks: list[list[int]] = [[] for _ in range(size + 1)]
    made = 0
    for i in np.argsort(-lengths, kind="stable").tolist():
        s = int(lengths[i])
        gap = size
        if s < size:
            own = count[s:size]  # open bins of gaps s to size - 1
            change = 2 * (count[: size - s] - own + 1)
            change[0] = 1 - 2 * own[0]
            best = int(np.where(own > 0, change, 1 << 60).argmin())
            if own[best]:
                gap = best + s
        if gap == size:
            b, made = made, made + 1
        else:
            b = stacks[gap].pop()
            count[gap] -= 1
        bins[i], offsets[i] = b, size - gap
        if gap > s:
            stacks[gap - s].append(b)
            count[gap - s] += 1
    return bins, offsets, made


def pack_documents(
    docs: DataFrame, tokenizer: str, end_id: int = 2, size: int = 1024, group: int = GROUP
) -> DataFrame:
    """Pack all texts of ``docs`` into sequences of at most ``size`` ids: a row a piece.

    Returns the columns of ``docs`` but the text, and piece, start, length, ids_crc32 (see ``pieces``),
    sequence_id and offset, gapless from 0 in each sequence. Null and empty texts are the end id alone. Repeated
    rows are packed each for itself, ids may be null. An empty table gives no rows. Input columns named like an
    added one are replaced, all others pass through. Texts of any length are encoded whole, each by one task.

    Pieces are dealt at random into groups of about ``group`` documents, each packed for itself; a group loses a
    fixed number of sequences at most on average, so the loss is a fixed share. The deal goes by the piece's place
    in its partition and the partition's number, so that copies of one row are spread like all others.
    """
    docs = without(docs, *PIECE_NAMES, "sequence_id", "offset")
    rows = pin(pieces(docs, tokenizer, end_id, size))
    groups = max(1, -(-rows.filter("piece = 0").count() // group))
    name, = free_names(rows, "group")
    schema = T.StructType([*rows.schema.fields, T.StructField("sequence_id", T.LongType()), T.StructField("offset", T.LongType())])
    keys = [(f.name, "ascending") for f in rows.schema.fields if f.name in ("doc_id", *PIECE_NAMES)]

    def run(key: tuple, table: pa.Table) -> pa.Table:
        # In an order of their own, so that a task that runs again packs alike.
        table = table.drop_columns([name]).sort_by(keys)
        bins, offsets, _ = pack(table.column("length").to_numpy(), size)
        first = np.int64(key[0].as_py()) << np.int64(32)
        return table.append_column("sequence_id", pa.array(bins + first)).append_column("offset", pa.array(offsets))

    # The pieces are a table, whose scan gives a task that runs again the same rows in the same order.
    deal = F.pmod(F.xxhash64(F.monotonically_increasing_id()), F.lit(groups))
    return rows.withColumn(name, deal).groupBy(name).applyInArrow(run, schema)
