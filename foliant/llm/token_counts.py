"""Edit-aware token counts.

Each document keeps a segment tree: leaves are pre-tokens or short runs of them (cut at lone spaces, and longer ones at
pre-token ends and where no merge can reach over) with their length and token count, in blocks of up to 64; the inner nodes hold sums over the blocks. An edit finds its blocks by descending the sums,
encodes again only the leaves that it touches and those whose boundary it may move, and renews the sums on the paths from
the changed blocks to the root. The count after any number of edits equals that of the edited text encoded whole.

Edits are (start, end, replacement) in code points of the text as it is when the edit's turn comes; start and end are
brought into the text, a null replacement deletes, a null start or end skips the edit.

Trees are built once and kept in a table beside the texts (`build_trees(..., carry=...)` and `stash`); later edits start from it.

Cases: null text counts as an empty one; a very long text has more blocks, and an edit of it costs no more; a run of one script
that merges can reach over everywhere is one leaf, whatever its length; repeated rows each get a row and take the same edits; edits
are applied in order of seq, of equal seq in order of place; an empty table gives no row; further columns are left out, whatever their names.
"""

from __future__ import annotations

from array import array
from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F
from pyspark.sql import types as T

from foliant.llm._bpe import Pieces, default_tokenizer, loaded
from foliant.llm._common import bound_batches, fresh

BLOCK = 64
#: Texts whose pieces are looked up and encoded together.
TOGETHER = 64


class SegmentTree:
    """lens and counts of leaves in blocks; chars and tokens are heaps of sums, node 1 the root, blocks at size + i."""

    def __init__(self, lens: list[int], counts: list[int]):
        self.blocks = [(lens[i : i + BLOCK], counts[i : i + BLOCK]) for i in range(0, len(lens), BLOCK)] or [([], [])]
        self.size = 1
        while self.size < len(self.blocks):
            self.size *= 2
        self.chars, self.tokens = [0] * (2 * self.size), [0] * (2 * self.size)
        for i, (a, b) in enumerate(self.blocks):
            self.chars[self.size + i], self.tokens[self.size + i] = sum(a), sum(b)
        for i in range(self.size - 1, 0, -1):
            self._sum(i)

    def _sum(self, i: int) -> None:
        self.chars[i] = self.chars[2 * i] + self.chars[2 * i + 1]
        self.tokens[i] = self.tokens[2 * i] + self.tokens[2 * i + 1]

    @property
    def n_tokens(self) -> int:
        return self.tokens[1]

    @property
    def n_chars(self) -> int:
        return self.chars[1]

    def find(self, at: int) -> tuple[int, int]:
        """The block that holds character at (the last with characters, beyond the end), and its start."""
        i, start = 1, 0
        at = min(at, self.chars[1] - 1)
        while i < self.size:
            i *= 2
            if at >= start + self.chars[i]:
                start += self.chars[i]
                i += 1
        return i - self.size, start

    def region(self, start: int, end: int) -> tuple[int, int, int, int]:
        """Blocks first..last, and the start of the first and the end of the last, that an edit of start..end reaches."""
        first, left = self.find(max(0, start - 2))
        last, right = self.find(end + 1)
        return first, last, left, right + self.chars[self.size + last]

    def narrow(self, first: int, last: int, left: int, right: int, start: int, end: int) -> tuple[int, int, int, int]:
        """How many leaves of the first and the last block stay, and the characters left..right between them.

        A leaf's start stays a boundary if the characters on both sides of its lone space stay: left + 1 < start, right > end.
        """
        head, lens = 0, self.blocks[first][0]
        while head < len(lens) and left + lens[head] + 1 < start:
            left += lens[head]
            head += 1
        tail, lens = 0, self.blocks[last][0]
        while tail < len(lens) - (head if first == last else 0) and right - lens[-1 - tail] > end:
            right -= lens[-1 - tail]
            tail += 1
        return head, tail, left, right

    def replace(self, first: int, last: int, head: int, tail: int, lens: list[int], counts: list[int]) -> None:
        """Put the new leaves between the kept ones; blocks that overflow make the tree anew, else only paths change."""
        a, b = self.blocks[first], self.blocks[last]
        keep = len(b[0]) - tail
        lens, counts = a[0][:head] + lens + b[0][keep:], a[1][:head] + counts + b[1][keep:]
        n = last - first + 1
        if len(lens) > 4 * BLOCK * n:
            every = self.blocks[:first] + [(lens, counts)] + self.blocks[last + 1 :]
            self.__init__([x for a, _ in every for x in a], [x for _, b in every for x in b])
            return
        step = -(-len(lens) // n) or 1
        for k in range(n):
            part = lens[k * step : (k + 1) * step], counts[k * step : (k + 1) * step]
            self.blocks[first + k] = part
            i = self.size + first + k
            self.chars[i], self.tokens[i] = sum(part[0]), sum(part[1])
        paths = {i // 2 for i in range(self.size + first, self.size + last + 1)}
        while paths - {0}:
            for i in paths:
                self._sum(i)
            paths = {i // 2 for i in paths} - {0}

    def leaves(self) -> tuple[list[int], list[int]]:
        return [x for a, _ in self.blocks for x in a], [x for _, b in self.blocks for x in b]


class Counted:
    """A text with its tree, by an encoder."""

    def __init__(self, text: str, encoder: Pieces, tree: SegmentTree | None = None):
        self.text, self.encoder, self.encoded = text, encoder, 0
        self.tree = tree or SegmentTree(*self.counted(text))

    def counted(self, text: str) -> tuple[list[int], list[int]]:
        """Lengths and token counts of the text's leaves."""
        parts = self.encoder.splitter.split(text)
        known, width = self.encoder.learn([parts]), self.encoder.dtype.itemsize
        return [len(p) for p in parts], [len(known[p]) // width for p in parts]

    def edit(self, start: int, end: int, new: str) -> None:
        size = len(self.text)
        start = min(max(start, 0), size)
        end = min(max(end, start), size)
        if not size:
            first = last = left = right = 0
            head = tail = 0
        else:
            first, last, left, right = self.tree.region(start, end)
            head, tail, left, right = self.tree.narrow(first, last, left, right, start, end)
        again = self.text[left:start] + new + self.text[end:right]
        self.encoded += len(again)
        self.tree.replace(first, last, head, tail, *self.counted(again))
        self.text = self.text[:start] + new + self.text[end:]


EDITED = "doc_id long, n_tokens long, n_tokens_edited long, n_chars_edited long, n_chars_encoded long, lens array<int>, counts array<int>"


def build_trees(docs: DataFrame, tokenizer: str | None = None, carry: list[str] | None = None) -> DataFrame:
    """doc_id, the carried columns (none, if not given), n_tokens, and lens and counts, the leaves of every document's tree."""
    tokenizer = tokenizer or default_tokenizer()
    bound_batches(docs.sparkSession)
    carry = [c for c in carry or [] if c not in ("doc_id", "n_tokens", "lens", "counts")]
    rows = docs.select(F.coalesce("text", F.lit("")).alias("_in"), F.col("doc_id").cast("long").alias("doc_id"), *(F.col(f"`{c}`") for c in carry))
    schema = T.StructType([*rows.schema.fields[1:], T.StructField("n_tokens", T.LongType()), T.StructField("lens", T.ArrayType(T.IntegerType())), T.StructField("counts", T.ArrayType(T.IntegerType()))])

    def build(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        encoder = loaded(tokenizer)
        width = encoder.dtype.itemsize
        for batch in batches:
            texts = batch.column(0).to_pylist()
            lens, sizes, ends = array("i"), array("i"), [0]
            for at in range(0, len(texts), TOGETHER):
                split = [encoder.splitter.split(t) for t in texts[at : at + TOGETHER]]
                known = encoder.learn(split)
                for parts in split:
                    lens.extend(map(len, parts))
                    sizes.extend(map(len, map(known.__getitem__, parts)))
                    ends.append(len(lens))
            if texts:
                counts = np.frombuffer(sizes, np.int32) // width
                total = np.concatenate([[0], np.cumsum(counts, dtype=np.int64)])[ends]
                lists = (pa.ListArray.from_arrays(pa.array(ends, pa.int32()), pa.array(x)) for x in (np.frombuffer(lens, np.int32), counts))
                yield pa.RecordBatch.from_arrays([*batch.columns[1:], pa.array(np.diff(total), pa.int64()), *lists], schema.names)

    return rows.mapInArrow(build, schema)


def int_lists(column: pa.ListArray) -> Iterator[list[int] | None]:
    """The lists of a column, made from its flat values: to_pylist makes an object of Arrow for each."""
    values, at = column.flatten().to_numpy(zero_copy_only=False), 0
    for n in column.value_lengths().to_pylist():
        yield None if n is None else values[at : at + n].tolist()
        at += n or 0


def to_batch(rows: list[tuple], schema: str) -> pa.RecordBatch:
    kinds = {"long": pa.int64(), "array<int>": pa.list_(pa.int32())}
    names, types = zip(*(x.split(" ") for x in schema.split(", ")))
    return pa.RecordBatch.from_arrays([pa.array(c, kinds[t]) for c, t in zip(zip(*rows), types)], list(names))


def apply_edits(rows: DataFrame, tokenizer: str | None = None, leaves: bool = True, trees: bool = False, edits: str = "edits") -> DataFrame:
    """Counts before and after the edits of each row's column `edits`, array<struct<start, end, replacement>>.

    rows holds doc_id, text and edits, and, where trees is set, lens and counts from build_trees; without them (or where they are
    null) the tree is built first. leaves=False leaves the trees out of the result.
    """
    tokenizer = tokenizer or default_tokenizer()
    bound_batches(rows.sparkSession)
    schema = EDITED if leaves else EDITED.partition(", lens")[0]

    def edit(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        encoder = loaded(tokenizer)
        for batch in batches:
            out = []
            for doc_id, text, changes, *tree in zip(*(c.to_pylist() for c in batch.columns[:3]), *map(int_lists, batch.columns[3:])):
                c = Counted(text or "", encoder, SegmentTree(*tree) if tree and None not in tree else None)
                before = c.tree.n_tokens
                for e in changes or ():
                    if e and None not in (e["start"], e["end"]):
                        c.edit(e["start"], e["end"], e["replacement"] or "")
                out.append((doc_id, before, c.tree.n_tokens, len(c.text), c.encoded, *(c.tree.leaves() if leaves else ())))
            if out:
                yield to_batch(out, schema)

    return rows.select(F.col("doc_id").cast("long").alias("doc_id"), "text", F.col(f"`{edits}`"), *(["lens", "counts"] if trees else [])).mapInArrow(edit, schema)


def with_edits(docs: DataFrame, edits: DataFrame, name: str = "edits") -> DataFrame:
    """docs with the rows (doc_id, seq, start, end, replacement) of edits as the column `name`, which takes the place of one of this
    name; the many edits of one document meet in its row, since each changes the text that the next one sees."""
    in_order = F.array_sort(F.collect_list(F.struct("seq", "start", "end", "replacement")))
    change = lambda e: F.struct(e["start"].cast("long").alias("start"), e["end"].cast("long").alias("end"), e["replacement"].alias("replacement"))
    key, packed = fresh(docs.columns, "_doc_id", "_packed")
    found = edits.groupBy(F.col("doc_id").alias(key)).agg(F.transform(in_order, change).alias(packed))
    joined = docs.join(found, F.col("doc_id") == F.col(key), "left")
    return joined.select(*(F.col(f"`{c}`") for c in docs.columns if c != name), F.col(packed).alias(name))
