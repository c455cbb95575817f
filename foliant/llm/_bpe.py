"""Byte-pair encoding by pieces: a text falls apart at lone spaces and line feeds, and each distinct piece is encoded once.

No pre-token reaches over a lone space between two characters that aren't white space: a space joins only what follows
it, and what stands before it ends there. A lone line feed between such characters is a pre-token of its own. So the ids of a text are those of
its pieces, one after the other, where each piece but the first starts with its space or line feed. A piece that ends in a letter and punctuation
falls apart between them, and so does one behind the line feed that it starts with: words are encoded without either.

A column of texts is cut in its Arrow buffers, so only its distinct pieces become Python strings. A piece of letters alone, with a space before
them or without, is one pre-token; the tokenizer's model takes it as it is, in the characters that stand for its bytes.
"""

from __future__ import annotations

import os
import re
import string
from array import array
from functools import cached_property

import numpy as np
import pyarrow as pa

TWO_SPACES = re.compile(r"\s\s")
LONE_SPACE = re.compile(r"(?<=\S)[ ](?=\S)|(?<=\S)(?=\n\S)")


def default_tokenizer() -> str:
    import public_tokenizers

    return public_tokenizers.path("byte_bpe_50k.json")


def pieces(text: str) -> list[str]:
    """The text's pieces; joined they are the text."""
    if not text:
        return []
    if TWO_SPACES.search(text) or text[0].isspace() or text[-1].isspace():
        parts = LONE_SPACE.split(text)
    else:  # every space and line feed is a lone one; other white space stays inside a piece unless a space touches it
        parts = (text.replace("\n", " \n") if "\n" in text else text).split(" ")
    return [parts[0], *[p if p[:1] == "\n" else " " + p for p in parts[1:]]]


#: White space as `\s` has it: the bytes of ASCII, and the UTF-8 bytes of the others as one number.
SPACES = np.array([b < 128 and chr(b).isspace() for b in range(256)])
WIDE_SPACES = np.array([int.from_bytes(chr(i).encode(), "big") for i in range(128, 0x10000) if chr(i).isspace()])


def space_bytes(data: np.ndarray) -> np.ndarray:
    """Whether each byte of a text belongs to white space; of three bytes the first and the last count."""
    out = SPACES[data]
    for lead, n in ((0xC2, 2), (0xE1, 3), (0xE2, 3), (0xE3, 3)):
        at = np.flatnonzero(data == lead)
        code = np.zeros(len(at), np.int64)
        for k in range(n):
            code = code << 8 | data[at + k]
        at = at[np.isin(code, WIDE_SPACES)]
        out[at] = out[at + n - 1] = True
    return out


#: Where a pre-token ends whatever stands further on: before white space, where letters or digits end, and where other signs
#: but an apostrophe (of 's, 'll and the like) end.
ENDS = r"(?<=\S)(?=\s)|(?<=\p{L})(?=[^\p{L}\s])|(?<=\p{N})(?=[^\p{N}\s])|(?<=[^\s\p{L}\p{N}'])(?=[\p{L}\p{N}])"
LEAST, MOST = 16, 48

#: The code point of the character that stands for each byte in a vocabulary.
PLAIN = [*range(33, 127), *range(161, 173), *range(174, 256)]
CODES = np.zeros(256, "<u2")
CODES[PLAIN] = PLAIN
CODES[[b for b in range(256) if b not in PLAIN]] = 256 + np.arange(256 - len(PLAIN))


def byte_characters(texts: list[str]) -> list[str]:
    """Texts without line feeds in the characters that stand for their bytes."""
    data = CODES[np.frombuffer("\n".join(texts).encode(), np.uint8)].tobytes().decode("utf-16-le")
    return data.split(chr(CODES[10]))


class Splitter:
    """Pieces of at most about `MOST` characters, where a text has places to cut at.

    Beside those of ENDS a text is cut between two characters beyond ASCII, the first no white space, when no token of the vocabulary
    holds the last byte of the one next to the first byte of the other: no merge reaches over such a place.
    """

    def __init__(self, tokenizer):
        import regex

        self.ends = regex.compile(ENDS)
        byte_of = {chr(c): b for b, c in enumerate(CODES.tolist())}
        self.meets = np.zeros((256, 256), bool)
        for token in tokenizer.get_vocab():
            at = [byte_of.get(c) for c in token]
            for a, b in zip(at, at[1:]):
                if a is not None and b is not None:
                    self.meets[a, b] = True

    def cuts(self, piece: str) -> list[int]:
        """Places in a long piece where its encoding falls apart, in order."""
        found = {m.start() for m in self.ends.finditer(piece)}
        if not piece.isascii():
            code = np.frombuffer(piece.encode("utf-32-le"), "<u4")
            data = np.frombuffer(piece.encode(), np.uint8)
            first = np.flatnonzero((data & 0xC0) != 0x80)[1:]  # the first bytes of all characters but the first
            apart = ~self.meets[data[first - 1], data[first]] & (code[:-1] > 127) & (code[1:] > 127)
            found.update(i + 1 for i in np.flatnonzero(apart).tolist() if not piece[i].isspace())
        return sorted(found)

    def split(self, text: str) -> list[str]:
        out = []
        for piece in pieces(text):
            if len(piece) <= MOST:
                out.append(piece)
                continue
            at = 0
            for cut in self.cuts(piece):
                if cut - at >= LEAST and len(piece) - cut >= LEAST:
                    out.append(piece[at:cut])
                    at = cut
            out.append(piece[at:])
        return out


#: What ends a word, and letters after which it does: no pre-token holds both.
PUNCTUATION = string.punctuation.replace("'", "")
LETTERS = frozenset(chr(i) for i in range(0x530) if chr(i).isalpha())
WORD = re.compile(rf" ?[{''.join(sorted(LETTERS))}]+")
SIGNS = np.isin(np.arange(256), list(PUNCTUATION.encode()))
#: By a byte and the one before it: whether a letter ends there.
LETTER_BYTES = np.zeros(65536, bool)
for _letter in LETTERS:
    if _letter.isascii():
        LETTER_BYTES[ord(_letter) :: 256] = True
    else:
        LETTER_BYTES[int.from_bytes(_letter.encode(), "big")] = True


def cut(texts: pa.Array, special: list[str]) -> tuple[pa.Array, np.ndarray]:
    """The pieces of all texts as one Arrow array, and the place of each text's first there; the last place is their number. A null has none.

    Beside those of `pieces` there are cuts after a lone line feed and between a letter and punctuation; none inside a special token.
    """
    texts = texts.cast(pa.large_string()).fill_null("")
    if not len(texts):
        return texts, np.zeros(1, np.int64)
    _, ends, data = texts.buffers()
    ends = np.frombuffer(ends, np.int64)[texts.offset : texts.offset + len(texts) + 1]
    data = np.frombuffer(data or b"", np.uint8)[ends[0] : ends[-1]]
    ends = ends - ends[0]
    outer = np.zeros(len(data) + 1, bool)  # where texts start and end
    outer[ends] = True
    at = np.flatnonzero((data == 32) | (data == 10))
    at = at[~outer[at] & ~outer[at + 1]]
    space = space_bytes(data)
    at = at[~space[at - 1] & ~space[at + 1]]
    first = np.zeros(len(data) + 1, bool)
    first[at] = True
    first[at[data[at] == 10] + 1] = True
    at = np.flatnonzero(SIGNS[data])
    at = at[~outer[at]]  # so the byte before is the text's, and a letter's second byte follows its first
    first[at[LETTER_BYTES[data[at - 1] | data[at - 2].astype(np.int64) << 8]]] = True
    for token in filter(None, map(str.encode, special)):
        if len(token) > 1:
            whole, i = data.tobytes(), -1
            while (i := whole.find(token, i + 1)) >= 0:
                first[i + 1 : i + len(token)] = False
    starts = np.flatnonzero(first | outer).astype(np.int64)
    return pa.LargeStringArray.from_buffers(len(starts) - 1, pa.py_buffer(starts), pa.py_buffer(data)), np.searchsorted(starts, ends)


class Pieces:
    """Ids of pieces as little-endian unsigned 16-bit bytes, by a tokenizer file of the tokenizers library.

    The memory holds `most` pieces of up to `longest` characters; when it is full, only the latest call's pieces stay. Longer pieces stay for one call.
    """

    def __init__(self, path: str, most: int = 700_000, longest: int = 64, wide: bool = False):
        os.environ["TOKENIZERS_PARALLELISM"] = "false"
        from tokenizers import Tokenizer, models, pre_tokenizers

        self.tokenizer, self.most, self.longest, self.known, self.once = Tokenizer.from_file(path), most, longest, {}, []
        self.dtype = np.dtype("<u4") if wide or self.tokenizer.get_vocab_size() > 65536 else np.dtype("<u2")
        self.specials = special = [t.content for t in self.tokenizer.get_added_tokens_decoder().values()]
        self.special = re.compile("|".join(map(re.escape, special)) or "(?!)").search
        first = "".join(sorted({re.escape(x[0]) for x in special}))
        self.simple = re.compile(rf" ?[^\s{first}]+")  # pieces that may stand in one text, divided by line feeds
        self.feed = self.tokenizer.encode("\n", add_special_tokens=False).ids
        model, pre = self.tokenizer.model, self.tokenizer.pre_tokenizer
        plain = self.tokenizer.normalizer is None and isinstance(model, models.BPE) and not model.dropout
        plain = plain and isinstance(pre, pre_tokenizers.ByteLevel) and pre.use_regex and not pre.add_prefix_space
        self.word = WORD.fullmatch if plain and not any(map(WORD.fullmatch, special)) else None  # pieces that are one pre-token

    @cached_property
    def splitter(self) -> Splitter:
        return Splitter(self.tokenizer)

    def learn(self, texts: list[list[str]]) -> dict[str, bytes]:
        self.values([*set().union(*texts)])
        return self.known

    def values(self, wanted: list[str]) -> list[bytes]:
        """The ids of distinct pieces."""
        known = self.known
        for p in self.once:
            known.pop(p, None)
        found = list(map(known.get, wanted))
        new = [p for p, x in zip(wanted, found) if x is None]
        if len(known) + len(new) > self.most:
            self.known = known = {p: x for p, x in zip(wanted, found) if x is not None}
        whole = {p: x for p in new if (p[-1] in PUNCTUATION or p[0] == "\n") and len(x := self.parts(p)) > 1}
        if whole:
            parts = {x for every in whole.values() for x in every if x not in known}
            self.encode_new([*parts.union(p for p in new if p not in whole)])
            for p, x in whole.items():
                known[p] = b"".join(map(known.__getitem__, x))
            new += parts
        else:
            self.encode_new(new)
        self.once = [p for p in new if len(p) > self.longest]
        return [known[p] if x is None else x for p, x in zip(wanted, found)] if new else found

    def parts(self, piece: str) -> list[str]:
        """The line feed before a piece, the piece, the punctuation after it."""
        if self.special(piece):
            return [piece]
        at = 1 if piece[0] == "\n" and not piece[1:2].isspace() else 0
        end = len(piece.rstrip(PUNCTUATION))
        if end <= at or piece[end - 1] not in LETTERS:
            end = len(piece)
        return [x for x in (piece[:at], piece[at:end], piece[end:]) if x]

    def encode_new(self, new: list[str]) -> None:
        if self.word:
            words, others = [], []
            for p in new:
                (words if self.word(p) else others).append(p)
            self.encode_words(words)
            new = others
        simple = list(filter(self.simple.fullmatch, new)) if len(self.feed) == 1 else []
        if len(simple) < len(new):
            self.encode_each([*set(new).difference(simple)])
        for at in range(0, len(simple), 20_000):
            part = simple[at : at + 20_000]
            ids = np.array(self.tokenizer.encode_batch_fast(["\n".join(part)], add_special_tokens=False)[0].ids, self.dtype)
            ends = np.append(np.flatnonzero(ids == self.feed[0]), len(ids))
            if len(ends) != len(part):
                self.encode_each(part)
                continue
            data, width, start = ids.tobytes(), self.dtype.itemsize, 0
            for p, end in zip(part, (ends * width).tolist()):
                self.known[p] = data[start:end]
                start = end + width

    def encode_words(self, words: list[str]) -> None:
        code, tokenize = "H" if self.dtype.itemsize == 2 else "I", self.tokenizer.model.tokenize
        for at in range(0, len(words), 20_000):
            part = words[at : at + 20_000]
            for p, w in zip(part, byte_characters(part)):
                self.known[p] = array(code, [t.id for t in tokenize(w)]).tobytes()

    def encode_each(self, new: list[str]) -> None:
        code = "H" if self.dtype.itemsize == 2 else "I"
        for at in range(0, len(new), 20_000):
            part = new[at : at + 20_000]
            for p, e in zip(part, self.tokenizer.encode_batch_fast(part, add_special_tokens=False)):
                self.known[p] = array(code, e.ids).tobytes()

    def encode_column(self, texts: pa.Array) -> tuple[np.ndarray, np.ndarray]:
        """The ids of all texts, one text's after the other's, and where each text's start; the last place is their number. A null has none."""
        found, first = cut(texts, self.specials)
        if not len(found):
            return np.zeros(0, self.dtype), np.zeros(len(first), np.int64)
        found = found.dictionary_encode()
        wanted = found.dictionary.to_numpy(zero_copy_only=False).tolist()
        ids = pa.array(self.values(wanted), pa.large_binary()).take(found.indices)
        _, ends, data = ids.buffers()
        ends = np.frombuffer(ends, np.int64)[: len(ids) + 1] // self.dtype.itemsize
        return np.frombuffer(data, self.dtype, int(ends[-1])), ends[first]

    def encode(self, texts: list[str] | pa.Array) -> list[bytes]:
        ids, starts = self.encode_column(texts if isinstance(texts, pa.Array) else pa.array(texts, pa.large_string()))
        data, at = ids.tobytes(), (starts * self.dtype.itemsize).tolist()
        return [data[a:b] for a, b in zip(at, at[1:])]


_LOADED: dict[str, Pieces] = {}


def loaded(path: str) -> Pieces:
    """One encoder for each Python worker and file."""
    if path not in _LOADED:
        _LOADED[path] = Pieces(path)
    return _LOADED[path]
