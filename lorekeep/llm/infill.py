"""Fill-in-middle transformation: texts cut at line ends and put together in another order.

Method. A batch's UTF-8 bytes are viewed as 64-bit words. Bytes that end a line are marked by
arithmetic on whole words, eight bytes at a time; the marks of a word are counted by
bitwise_count, and the running total of the counts is an index in which the word of the k-th line
end is found by binary search. Inside that word the lower marks are cleared one by one until the
k-th is the lowest, whose place is the number of bits below it. The same index counts code points,
by marks on the bytes that go on a character. All texts of a batch are cut at once.

Defined results: a null text is empty; an empty text, and one that holds a sentinel, stays plain;
a null doc_id takes part with the empty string as its number; equal rows give equal results, and
rows with one doc_id but different texts are cut by the same draw; bytes that aren't UTF-8 are
kept as they are; other columns are ignored; an empty table gives none.
"""

from __future__ import annotations

import hashlib
from collections.abc import Iterator

import numpy as np
import pyarrow as pa
import pyarrow.compute as pc
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from .base import texts

#: What stands before prefix, suffix and middle.
PREFIX, SUFFIX, MIDDLE = "<P>", "<S>", "<M>"
_U = np.uint64
_LOW7, _HIGH = _U(0x7F7F7F7F7F7F7F7F), _U(0x8080808080808080)
_NEWLINES = _U(0x0A0A0A0A0A0A0A0A)


class Marks:
    """Places of marked bytes: bit 7 of each byte of 64-bit words that hold the bytes in order."""

    def __init__(self, words: np.ndarray):
        self.words = np.append(words, _U(0))
        self.before = np.concatenate(([0], np.cumsum(np.bitwise_count(self.words), dtype=np.int64)))

    def rank(self, at: np.ndarray) -> np.ndarray:
        """How many marked bytes stand before each place."""
        word, byte = at >> 3, (at & 7).astype(np.uint64)
        below = (_U(1) << (byte * _U(8))) - _U(1)
        return self.before[word] + np.bitwise_count(self.words[word] & below)

    def select(self, k: np.ndarray) -> np.ndarray:
        """The place of the k-th marked byte, from 0; there must be so many."""
        word = np.searchsorted(self.before, k, "right") - 1
        left, m = k - self.before[word], self.words[word]
        for i in range(7):
            m = np.where(left > i, m & (m - _U(1)), m)
        lowest = m & (~m + _U(1))
        return word * 8 + (np.bitwise_count(lowest - _U(1)).astype(np.int64) >> 3)


def line_ends(words: np.ndarray) -> Marks:
    """Bytes equal to a line feed: those that become zero, which no carry of a lower byte can touch."""
    x = words ^ _NEWLINES
    return Marks(~(((x & _LOW7) + _LOW7) | x | _LOW7))


def continuations(words: np.ndarray) -> Marks:
    """Bytes that go on a character: the upper bit set, the next one clear."""
    return Marks(words & ~(words << _U(1)) & _HIGH)


def draws(ids: list[int | None], seed: int) -> np.ndarray:
    """Four unsigned 32-bit numbers for each id, of the digest of seed and id."""
    digests = b"".join(hashlib.sha256(f"{seed}:{'' if i is None else i}".encode()).digest()[:16] for i in ids)
    return np.frombuffer(digests, ">u4").reshape(-1, 4).astype(np.int64)


_OUT = pa.schema(
    [("doc_id", pa.int64()), ("n", pa.int64()), ("form", pa.string()), ("prefix_chars", pa.int64()), ("middle_chars", pa.int64()), ("output", pa.string())]
)


def transform(docs: DataFrame, seed: int = 7, infill_percent: int = 100, spm_percent: int = 50) -> DataFrame:
    """(doc_id, n, form, prefix_chars, middle_chars, output) of each document.

    n is the number of lines; form is plain, or the order of the pieces: psm or spm. seed,
    infill_percent and spm_percent fix the draw, which depends on the doc_id alone.
    """

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            ids, text = batch.column(0).to_pylist(), batch.column(1)
            raw = text.cast(pa.large_binary())
            start = np.frombuffer(raw.buffers()[1], np.int64)[raw.offset : raw.offset + len(raw) + 1]
            held = np.frombuffer(raw.buffers()[2], np.uint8) if raw.buffers()[2] else np.zeros(0, np.uint8)
            held = held[start[0] : start[-1]]
            start = start - start[0]
            words = np.zeros(len(held) // 8 + 2, np.uint64)
            words.view(np.uint8)[: len(held)] = held
            ends, inner = line_ends(words), continuations(words)

            first, last = start[:-1], start[1:]
            lines = ends.rank(last) - ends.rank(first)
            open_end = (last > first) & (words.view(np.uint8)[last - 1] != 10)
            n = lines + open_end
            h = draws(ids, seed)
            cuts = np.sort(h[:, :2] % (n + 1)[:, None], axis=1)
            at = np.broadcast_to(last[:, None], cuts.shape).copy()
            inside = (cuts > 0) & (cuts <= lines[:, None])
            at[inside] = ends.select((ends.rank(first)[:, None] + cuts - 1)[inside]) + 1
            at[cuts == 0] = np.broadcast_to(first[:, None], cuts.shape)[cuts == 0]

            told = np.zeros(len(raw), bool)
            for sentinel in (PREFIX, SUFFIX, MIDDLE):
                told |= np.asarray(pc.match_substring(text, sentinel))
            plain = (last == first) | told | (h[:, 2] % 100 >= infill_percent)
            spm = h[:, 3] % 100 < spm_percent
            middle, rest = at[:, 0], at[:, 1]
            chars = [b - a - (inner.rank(b) - inner.rank(a)) for a, b in ((first, middle), (middle, rest))]

            p, s, m = PREFIX.encode(), SUFFIX.encode(), MIDDLE.encode()
            data, out = held.tobytes(), []
            for i, (a, x, y, b) in enumerate(zip(first.tolist(), middle.tolist(), rest.tolist(), last.tolist(), strict=True)):
                if plain[i]:
                    out.append(data[a:b])
                elif spm[i]:
                    out.append(b"".join((s, data[y:b], p, data[a:x], m, data[x:y])))
                else:
                    out.append(b"".join((p, data[a:x], s, data[y:b], m, data[x:y])))
            form = pa.array(np.where(plain, "plain", np.where(spm, "spm", "psm")).astype(object), pa.string())
            output = pa.array(out, pa.binary()).view(pa.string())
            yield pa.RecordBatch.from_arrays([batch.column(0), pa.array(n), form, pa.array(chars[0], mask=plain), pa.array(chars[1], mask=plain), output], schema=_OUT)

    return texts(docs).mapInArrow(run, "doc_id long, n long, form string, prefix_chars long, middle_chars long, output string")


def restored(output: Column, form: Column) -> Column:
    """The text that an output of transform() was made of: no piece holds a sentinel, so each occurs once."""

    def upto(c: Column, sentinel: str) -> Column:
        return F.substring_index(c, sentinel, 1)

    def after(c: Column, sentinel: str) -> Column:
        return F.substring_index(c, sentinel, -1)

    body = after(output, PREFIX)
    psm = F.concat(upto(body, SUFFIX), after(body, MIDDLE), upto(after(body, SUFFIX), MIDDLE))
    spm = F.concat(upto(body, MIDDLE), after(body, MIDDLE), after(upto(output, PREFIX), SUFFIX))
    return F.when(form == "psm", psm).when(form == "spm", spm).otherwise(output)


def digests(transformed: DataFrame) -> DataFrame:
    """transform()'s columns with the digests of output and restored text in place of the output."""
    of = [F.sha2(c.cast("binary"), 256).alias(name) for c, name in ((F.col("output"), "output_sha256"), (restored(F.col("output"), F.col("form")), "restored_sha256"))]
    return transformed.select("doc_id", "n", "form", "prefix_chars", "middle_chars", *of)
