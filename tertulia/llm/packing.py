"""Packing documents into windows of a fixed number of tokens, by best-fit decreasing.

A document is cut into full windows first; what is left of it, shorter than a window, is placed into
the open window that it fills best. The open windows are found in a segment tree over remaining
capacity. Every task packs the documents of its own partition, so nothing is shuffled: of a task's
windows only the last few are not full, and those are filled up by cutting.

Tokens come from a byte-level BPE vocabulary; the path of its file is a parameter.
"""

from __future__ import annotations

import base64
import zlib
from collections.abc import Iterator
from dataclasses import dataclass, field

import numpy as np
import pyarrow as pa
from pyspark import TaskContext
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

#: Fixed value: how byte_bpe_50k cuts a text before merging.
PATTERN = r"'s|'t|'re|'ve|'m|'ll|'d| ?\p{L}+| ?\p{N}+| ?[^\s\p{L}\p{N}]+|\s+(?!\S)|\s+"
END = 0
#: The token that byte_bpe_50k adds to its vocabulary, and its id; it is found before a text is cut.
ADDED, ADDED_ID = "<|endoftext|>", 50256
PIECES = "doc_id long, start long, length long, ids_crc32 long, doc_tokens long, sequence_id long, offset long"


def load_encoder(ranks_path: str):
    """Encoder of a byte-level BPE given as ranks: base64 of a token and its id on each line.

    It gives the ids that the same vocabulary gives in the `tokenizers` library, several times
    faster, ADDED being text like any other; tests/llm holds the two against each other.
    """
    import tiktoken

    with open(ranks_path, "rb") as lines:
        ranks = {base64.b64decode(token): int(rank) for token, rank in map(bytes.split, lines)}
    return tiktoken.Encoding("bpe", pat_str=PATTERN, mergeable_ranks=ranks, special_tokens={}).encode_ordinary


def load_tokenizer(ranks_path: str):
    """Encoder that gives the ids of byte_bpe_50k as `tokenizers` loads it: texts are cut at ADDED."""
    encode = load_encoder(ranks_path)

    def ids_of(text: str) -> list[int]:
        first, *others = text.split(ADDED)
        ids = encode(first)
        for part in others:
            ids.append(ADDED_ID)
            ids += encode(part)
        return ids

    return ids_of


@dataclass
class Piece:
    """Consecutive ids of one document."""

    doc_id: int | None
    start: int
    ids: np.ndarray
    doc_tokens: int

    def cut(self, at: int) -> tuple[Piece, Piece]:
        return (
            Piece(self.doc_id, self.start, self.ids[:at], self.doc_tokens),
            Piece(self.doc_id, self.start + at, self.ids[at:], self.doc_tokens),
        )


class OpenWindows:
    """Open windows by remaining capacity; the tightest that has room is found in a segment tree.

    Node k covers the capacities below it and holds the number of open windows with one of them;
    leaf `size + c` is capacity c.
    """

    def __init__(self, capacity: int):
        self.size = 1 << capacity.bit_length()
        self.count = [0] * (2 * self.size)
        self.windows: list[list[list[Piece]]] = [[] for _ in range(self.size)]

    def _add(self, capacity: int, by: int) -> None:
        node = self.size + capacity
        while node:
            self.count[node] += by
            node >>= 1

    def put(self, window: list[Piece], remaining: int) -> None:
        self.windows[remaining].append(window)
        self._add(remaining, 1)

    def take(self, needed: int) -> tuple[list[Piece], int] | None:
        """Take out an open window of the least remaining capacity that is at least `needed`."""
        node = self.size + needed
        if not self.count[node]:
            while node > 1 and (node & 1 or not self.count[node + 1]):
                node >>= 1
            if node <= 1:
                return None
            node += 1
            while node < self.size:
                node = 2 * node if self.count[2 * node] else 2 * node + 1
        capacity = node - self.size
        self._add(capacity, -1)
        return self.windows[capacity].pop(), capacity


def best_fit_decreasing(pieces: list[Piece], capacity: int) -> list[list[Piece]]:
    """Windows holding all `pieces`, none of which is longer than `capacity`."""
    ordered = sorted(pieces, key=lambda p: -len(p.ids))
    open_windows, windows = OpenWindows(capacity), []
    for piece in ordered:
        found = open_windows.take(len(piece.ids))
        if found is None:
            found = [], capacity
            windows.append(found[0])
        window, remaining = found
        window.append(piece)
        if remaining > len(piece.ids):
            open_windows.put(window, remaining - len(piece.ids))
    return windows


def tokens_in(window: list[Piece]) -> int:
    return sum(len(p.ids) for p in window)


def fill_up(windows: list[list[Piece]], capacity: int, spare: int) -> list[list[Piece]]:
    """Cut the emptiest windows into the gaps of the fuller ones until at most `spare` is padding,
    or a single window is not full."""
    ordered = sorted(windows, key=tokens_in)
    padding = sum(capacity - tokens_in(w) for w in ordered)
    first, last = 0, len(ordered) - 1
    while padding > spare and first < last:
        room = capacity - tokens_in(ordered[last])
        if room == 0:
            last -= 1
            continue
        piece = ordered[first].pop()
        if len(piece.ids) > room:
            piece, rest = piece.cut(room)
            ordered[first].append(rest)
        ordered[last].append(piece)
        if not ordered[first]:  # one window fewer to pad
            first += 1
            padding -= capacity
    return [w for w in ordered if w]


@dataclass
class Packer:
    """Windows of one task; `pool` bounds the rests that are held at a time."""

    capacity: int
    spare: float
    pool: int
    first_id: int
    waiting: list[Piece] = field(default_factory=list)
    rows: list[tuple] = field(default_factory=list)
    tokens: int = 0

    def add(self, doc_id: int | None, ids: np.ndarray) -> None:
        whole = len(ids) - len(ids) % self.capacity
        for start in range(0, whole, self.capacity):
            self._close([Piece(doc_id, start, ids[start : start + self.capacity], len(ids))])
        if whole < len(ids):
            self.waiting.append(Piece(doc_id, whole, ids[whole:].copy(), len(ids)))
        self.tokens += len(ids)
        if len(self.waiting) >= self.pool:
            self.flush(last=False)

    def flush(self, last: bool) -> None:
        windows = best_fit_decreasing(self.waiting, self.capacity)
        self.waiting = []
        if last:
            windows = fill_up(windows, self.capacity, int(self.spare * self.tokens))
        for window in windows:
            if last or tokens_in(window) == self.capacity:
                self._close(window)
            else:
                self.waiting += window  # these may still find a better place
        if not last and len(self.waiting) > self.pool // 2:
            self._close_fullest()

    def _close_fullest(self) -> None:
        windows = sorted(best_fit_decreasing(self.waiting, self.capacity), key=tokens_in)
        self.waiting = [p for w in windows[: len(windows) // 4] for p in w]
        for window in windows[len(windows) // 4 :]:
            self._close(window)

    def _close(self, window: list[Piece]) -> None:
        offset = 0
        for p in window:
            crc = zlib.crc32(p.ids.tobytes())
            self.rows.append((p.doc_id, p.start, len(p.ids), crc, p.doc_tokens, self.first_id, offset))
            offset += len(p.ids)
        self.first_id += 1

    def batch(self, schema: pa.Schema) -> pa.RecordBatch:
        columns = list(zip(*self.rows, strict=True)) or [()] * len(schema)
        self.rows = []
        arrays = [pa.array(c, f.type) for c, f in zip(columns, schema, strict=True)]
        return pa.RecordBatch.from_arrays(arrays, schema=schema)


def pack(docs: DataFrame, ranks_path: str, capacity: int = 1024, spare: float = 0.005, pool: int = 16384) -> DataFrame:
    """A row for each piece of each document: where it begins in the document's ids, its length, the
    CRC-32 of its ids, the ids of the whole document, its sequence and its offset there.

    The ids of a document are those of its whole text, ADDED being one token, and one END. A missing or empty text is END
    alone. Rows are packed as they are: equal rows, and rows of one doc_id or none, are documents of
    their own. No rows give no pieces; columns other than doc_id and text are ignored.

    `spare` is the share of padding up to which the last windows of a task are left uncut, `pool`
    the number of rests held at a time. Sequence ids hold the task's partition above 33 bits, as
    those of monotonically_increasing_id do; a task that runs again gives the same rows.
    """

    def pack_partition(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        schema = pa.schema([(c.split()[0], pa.int64()) for c in PIECES.split(", ")])
        encode = load_tokenizer(ranks_path)
        packer = Packer(capacity, spare, pool, TaskContext.get().partitionId() << 33)
        for batch in batches:
            for doc_id, text in zip(batch.column(0).to_pylist(), batch.column(1), strict=True):
                ids = encode(text.as_py() or "")
                ids.append(END)
                packer.add(doc_id, np.array(ids, "<u4"))
            yield packer.batch(schema)
        packer.flush(last=True)
        yield packer.batch(schema)

    return docs.select(F.col("doc_id").cast("long"), "text").mapInArrow(pack_partition, PIECES)
