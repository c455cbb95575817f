"""Vector bin packing of training examples into sequences.

An example is a list of parts, each a text that bears loss or not (a conversation's turns, a prompt with its answer, a document as one part).
Its demand is a vector: tokens, one segment, tokens that bear loss. A sequence has a limit on each. Sequences are filled one at a time by
the dot-product heuristic: of the waiting examples that fit, the one goes in whose demand has the largest weighted dot product with what the
sequence has left; both are taken as shares of the limits, and a dimension weighs as much as the waiting examples ask of it. So examples that use up what is scarce meet those that don't.

Examples longer than a sequence are cut; what fills a sequence alone leaves at once. When nothing more fits and more than `slack` tokens are free,
the longest waiting example is cut to fill them. Where the limits on segments or loss leave a larger gap, or at the end of a task, the sequence ends at the largest power of two within it, and what lies behind goes back to the waiting examples. So at most `slack` tokens of a sequence are padding.

Each task packs what it reads, without a shuffle: up to `pool` examples wait, half of them leave before more come in.

Ids are those of the tokenizers library for each part by itself, and an end id after the last part.

Cases: a null or empty text, an empty or null list of parts give the end id alone; a very long text is cut as above; a null id stays null; repeated rows are
examples of their own; a part with a null loss bears none; an empty table gives no sequence; further columns are left out, whatever their names.
"""

from __future__ import annotations

from collections.abc import Iterator
from dataclasses import dataclass

import numpy as np
import pyarrow as pa
from pyspark import TaskContext
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F
from pyspark.sql import types as T

from foliant.llm._bpe import default_tokenizer, loaded
from foliant.llm._common import bound_batches


@dataclass
class Piece:
    """Ids start..start + len(ids) of an example; loss, a byte for each, is left out where all bear loss."""

    doc: object
    start: int
    ids: np.ndarray
    loss: np.ndarray | None
    doc_tokens: int

    @property
    def n_loss(self) -> int:
        return len(self.ids) if self.loss is None else int(np.count_nonzero(self.loss))

    def cut(self, at: int) -> tuple[Piece, Piece]:
        a, b = (None, None) if self.loss is None else (self.loss[:at], self.loss[at:])
        return Piece(self.doc, self.start, self.ids[:at], a, self.doc_tokens), Piece(self.doc, self.start + at, self.ids[at:], b, self.doc_tokens)

    def most(self, tokens: int, loss: int) -> int:
        """Tokens of the longest beginning within both limits."""
        tokens = min(tokens, len(self.ids))
        if self.loss is None:
            return min(tokens, loss)
        return int(np.searchsorted(np.cumsum(self.loss[:tokens] != 0), loss, "right"))


#: Demand of a place whose example has left: it fits nowhere.
GONE = 1 << 60


class Packer:
    """Fills sequences of up to so many tokens, segments and tokens that bear loss."""

    def __init__(self, tokens: int, segments: int, loss: int, slack: int, pool: int):
        if min(tokens, segments, loss) < 1 or tokens & (tokens - 1):
            raise ValueError("limits are positive, and that of tokens is a power of two")
        self.limits, self.slack, self.pool = (tokens, segments, loss), slack, pool
        self.waiting: list[Piece | None] = []
        self.tokens, self.loss = (np.zeros(2 * pool + 16, np.int64) for _ in range(2))  # of each place; GONE where its piece has left
        self.n_waiting = self.all_tokens = self.all_loss = 0
        self.ready: list[list[Piece]] = []

    def add(self, piece: Piece) -> None:
        """Take an example; sequences that are done stand in `ready`."""
        tokens, _, loss = self.limits
        while len(piece.ids) > tokens or piece.n_loss > loss:
            head, piece = piece.cut(piece.most(tokens, loss))
            self.take_in(head)
        self.take_in(piece)
        if self.n_waiting > self.pool:
            self.fill_until(self.pool // 2)

    def take_in(self, piece: Piece) -> None:
        if len(piece.ids) == self.limits[0]:
            self.ready.append([piece])
        else:
            self.wait(piece)

    def wait(self, piece: Piece) -> None:
        if len(self.waiting) == len(self.tokens):
            keep = [i for i, x in enumerate(self.waiting) if x is not None]
            self.waiting = [self.waiting[i] for i in keep]
            size = max(len(self.tokens), 2 * len(keep))
            for name in ("tokens", "loss"):
                setattr(self, name, np.concatenate([getattr(self, name)[keep], np.zeros(size - len(keep), np.int64)]))
        i, tokens, loss = len(self.waiting), len(piece.ids), piece.n_loss
        self.tokens[i], self.loss[i] = tokens, loss
        self.waiting.append(piece)
        self.n_waiting += 1
        self.all_tokens += tokens
        self.all_loss += loss

    def take(self, i: int) -> Piece:
        piece, self.waiting[i] = self.waiting[i], None
        self.n_waiting -= 1
        self.all_tokens -= int(self.tokens[i])
        self.all_loss -= int(self.loss[i])
        self.tokens[i] = GONE
        return piece

    def fill_until(self, most: int) -> None:
        while self.n_waiting > most:
            self.ready.append(self.fill())

    def fill(self) -> list[Piece]:
        out, (tokens, segments, loss) = [], self.limits
        free, may_bear = tokens, loss
        n = len(self.waiting)
        of_tokens, of_loss = self.tokens[:n], self.loss[:n]
        while self.n_waiting and len(out) < segments:
            fits = np.flatnonzero((of_tokens <= free) & (of_loss <= may_bear))
            if not len(fits):
                break
            # shares of the limits asked for by all that wait, times what is left; an example's one segment adds the same to all
            by_token, by_loss = self.all_tokens / tokens**2 * (free / tokens), self.all_loss / loss**2 * (may_bear / loss)
            i = int(fits[np.argmax(of_tokens[fits] * by_token + of_loss[fits] * by_loss)])
            free, may_bear = free - int(of_tokens[i]), may_bear - int(of_loss[i])
            out.append(self.take(i))
        if free > self.slack and len(out) < segments and self.n_waiting:
            i = int(np.argmax(np.where(of_tokens < GONE, of_tokens, -1)))
            at = self.waiting[i].most(free, may_bear)
            if 0 < at < len(self.waiting[i].ids):
                head, rest = self.take(i).cut(at)
                out.append(head)
                self.wait(rest)
                free -= at
        return self.at_power_of_two(out, tokens - free) if free > self.slack else out

    def at_power_of_two(self, pieces: list[Piece], length: int) -> list[Piece]:
        """The pieces up to the largest power of two; the rest waits again."""
        size, at = 1 << (length.bit_length() - 1), 0
        out = []
        for p in pieces:
            if at + len(p.ids) <= size:
                out.append(p)
            elif at < size:
                head, rest = p.cut(size - at)
                out.append(head)
                self.wait(rest)
            else:
                self.wait(p)
            at += len(p.ids)
        return out


def whole_text(text: str | Column) -> Column:
    """The parts of a document that bears loss everywhere."""
    return F.array(F.struct((F.col(text) if isinstance(text, str) else text).alias("text"), F.lit(True).alias("loss")))


def pack(
    rows: DataFrame, *, parts: Column, doc_id: str = "doc_id", tokenizer: str | None = None, end_id: int = 1, tokens: int = 2048, segments: int = 64, loss: int | None = None, slack: int = 8, pool: int = 2048
) -> DataFrame:
    """A row for each sequence: sequence_id, n_tokens, padded_to, segments (doc_id, start, length, n_loss, doc_tokens, offset), ids, loss.

    parts: array<struct<text string, loss boolean>>; loss: the limit on tokens that bear loss, `tokens` if not given. ids are little-endian
    unsigned 32-bit integers, without padding; the column loss has a byte for each of them and is null where all bear loss. padded_to is
    n_tokens where that is a power of two, else `tokens`.
    """
    tokenizer, limits = tokenizer or default_tokenizer(), (tokens, segments, loss or tokens)
    Packer(*limits, slack, pool)  # states what is wrong before a job runs
    bound_batches(rows.sparkSession)
    taken = rows.select(F.col(doc_id).alias("doc_id"), parts.cast("array<struct<text:string,loss:boolean>>").alias("parts"))
    longs = [T.StructField(n, T.LongType()) for n in ("start", "length", "n_loss", "doc_tokens", "offset")]
    segment = T.StructType([taken.schema["doc_id"], *longs])
    schema = T.StructType([T.StructField("sequence_id", T.LongType()), T.StructField("n_tokens", T.LongType()), T.StructField("padded_to", T.LongType()), T.StructField("segments", T.ArrayType(segment)), T.StructField("ids", T.BinaryType()), T.StructField("loss", T.BinaryType())])

    def examples(batch: pa.RecordBatch) -> Iterator[Piece]:
        encoder = loaded(tokenizer)
        lists = batch.column(1)
        flat = lists.flatten()
        every, starts = encoder.encode_column(flat.field("text"))
        starts = starts.tolist()
        bears = flat.field("loss").to_pylist()
        known = pa.compute.is_valid(flat).to_pylist()
        at = 0
        for doc, n in zip(batch.column(0).to_pylist(), lists.value_lengths().to_pylist()):
            mine = [(every[starts[i] : starts[i + 1]], bool(bears[i])) for i in range(at, at + (n or 0)) if known[i]]
            at += n or 0
            end = np.array([end_id], encoder.dtype)
            ids = np.concatenate([*(x for x, _ in mine), end])
            if all(b for _, b in mine):
                mask = None
            else:
                mask = np.concatenate([*(np.full(len(x), b, np.uint8) for x, b in mine), np.array([mine[-1][1]], np.uint8)])
            yield Piece(doc, 0, ids, mask, len(ids))

    def fill(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        packer, context = Packer(*limits, slack, pool), TaskContext.get()
        number = (context.partitionId() if context else 0) << 33
        kind = None
        for batch in batches:
            kind = batch.schema.field(0).type
            for piece in examples(batch):
                packer.add(piece)
                if len(packer.ready) >= 256:
                    yield written(packer.ready, number, kind)
                    number += len(packer.ready)
                    packer.ready = []
        packer.fill_until(0)
        if packer.ready:
            yield written(packer.ready, number, kind)

    def written(sequences: list[list[Piece]], number: int, kind: pa.DataType) -> pa.RecordBatch:
        sizes = [sum(len(p.ids) for p in s) for s in sequences]
        every = [p for s in sequences for p in s]
        offsets = [at for s in sequences for at in np.cumsum([0, *(len(p.ids) for p in s)])[:-1].tolist()]
        columns = [pa.array([p.doc for p in every], kind), *(pa.array(x, pa.int64()) for x in ([p.start for p in every], [len(p.ids) for p in every], [p.n_loss for p in every], [p.doc_tokens for p in every], offsets))]
        structs = pa.StructArray.from_arrays(columns, ["doc_id", "start", "length", "n_loss", "doc_tokens", "offset"])
        lists = pa.ListArray.from_arrays(pa.array(np.cumsum([0, *map(len, sequences)]), pa.int32()), structs)
        ids = pa.array([np.concatenate([p.ids for p in s]).astype("<u4").tobytes() for s in sequences], pa.binary())
        masks = [None if all(p.loss is None for p in s) else b"".join(b"\1" * len(p.ids) if p.loss is None else p.loss.tobytes() for p in s) for s in sequences]
        padded = [n if n & (n - 1) == 0 else tokens for n in sizes]
        own = [pa.array(range(number, number + len(sequences)), pa.int64()), pa.array(sizes, pa.int64()), pa.array(padded, pa.int64()), lists, ids, pa.array(masks, pa.binary())]
        return pa.RecordBatch.from_arrays(own, schema.names)

    return taken.mapInArrow(fill, schema)


def pieces(packed: DataFrame) -> DataFrame:
    """A row for each piece of the packed sequences, with its ids as their CRC-32."""
    out = packed.select("sequence_id", "ids", F.explode("segments").alias("s"))
    own = F.expr("substring(ids, int(s.offset * 4 + 1), int(s.length * 4))")
    return out.select("s.doc_id", "s.start", "s.length", F.crc32(own).alias("ids_crc32"), "s.doc_tokens", "sequence_id", "s.offset", "s.n_loss")
