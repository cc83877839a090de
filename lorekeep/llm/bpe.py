"""Byte-level BPE encoding and decoding with a public vocabulary.

Method. Texts are split by the vocabulary's pattern; each distinct piece is encoded once. The
frequent pieces are folded by Spark higher-order functions: an aggregate over an array of
single bytes merges, step by step, the leftmost neighbour pair of lowest rank, looking ranks up
in a literal map (an array of buckets by hash, since Spark searches a plain map from its
start). A piece that is rare or long is merged by the same rule where it occurs, so that the
table sent to the tasks has a fixed bound (TABLE_PIECES pieces of FOLD_BYTES) whatever the corpus
holds. Decoding looks each id up in a literal array of the vocabulary's pieces and concatenates
them, by Spark's functions.

Defined results: null text is empty; an empty text has no ids; repeated rows give repeated
rows; columns other than doc_id and text are ignored.
"""

from __future__ import annotations

import base64
import heapq
import json
from collections.abc import Iterator

import numpy as np
import pyarrow as pa
import pyarrow.compute as pc
import regex
import xxhash
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from .base import BATCH_BYTES, checkpointed, discard, runs_of_bytes, texts

#: Pieces of at most so many bytes are folded by Spark; longer ones need more steps than a fold should take.
FOLD_BYTES = 48
#: At most so many frequent pieces are sent to the tasks.
TABLE_PIECES = 1 << 16
#: Bytes of words that a task counts at once, rows of texts split at once, and rare pieces whose ids a task remembers.
COUNTED, ROWS, REMEMBERED = 8 << 20, 256, 150_000
_BUCKETS = 16_384
#: Every character that some engine takes for white space.
_SPACE = r"[\s\x0B\x1C-\x1F\x{85}\x{A0}\x{1680}\x{180E}\x{2000}-\x{200B}\x{2028}\x{2029}\x{202F}\x{205F}\x{3000}\x{FEFF}]"
_NO_RANK = 2**31 - 1


def read_ranks(path: str) -> dict[bytes, int]:
    """Piece to rank, from a file with a base64 piece and a rank a line."""
    with open(path, "rb") as f:
        return {base64.b64decode(p): int(r) for p, r in map(bytes.split, f)}


def merge(piece: bytes, ranks: dict[bytes, int]) -> list[int]:
    """Ids of one piece: the leftmost pair of lowest rank merges until none has a rank."""
    if piece in ranks:
        return [ranks[piece]]
    n = len(piece)
    end = list(range(1, n + 1))  # end of the symbol that starts here; 0 if none does any more
    before = list(range(-1, n - 1))

    def offer(i: int) -> None:
        j = end[i]
        if j < n and (r := ranks.get(piece[i : end[j]])) is not None:
            heapq.heappush(heap, (r, i, end[j]))

    heap: list[tuple[int, int, int]] = []
    for i in range(n - 1):
        offer(i)
    while heap:
        _, i, stop = heapq.heappop(heap)
        j = end[i]
        if not j or j >= n or not end[j] or end[j] != stop:
            continue
        end[i], end[j] = stop, 0
        if stop < n:
            before[stop] = i
        offer(i)
        if before[i] >= 0:
            offer(before[i])
    out, i = [], 0
    while i < n:
        out.append(ranks[piece[i : end[i]]])
        i = end[i]
    return out


class Merger:
    """The same merges for many short pieces at once: those of one length are rows of a matrix, from which each step takes a column."""

    def __init__(self, ranks: dict[bytes, int]):
        pairs = ((ranks[p[:i]] << 32 | ranks[p[i:]], r) for p, r in ranks.items() for i in range(1, len(p)) if p[:i] in ranks and p[i:] in ranks)
        key, rank = np.fromiter(pairs, np.dtype((np.int64, 2))).reshape(-1, 2).T
        order = np.argsort(key)
        self.keys, self.ranks = key[order], rank[order]
        self.byte = np.array([ranks.get(bytes([i]), _NO_RANK) for i in range(256)], dtype=np.int64)

    def rank(self, left: np.ndarray, right: np.ndarray) -> np.ndarray:
        key = (left << 32) | right
        at = np.minimum(np.searchsorted(self.keys, key), max(0, len(self.keys) - 1))
        return np.where(self.keys[at] == key, self.ranks[at], _NO_RANK) if len(self.keys) else np.full(key.shape, _NO_RANK)

    def code(self, pieces: list[bytes]) -> list[bytes]:
        """Ids of each piece as little-endian bytes."""
        out = [b""] * len(pieces)
        sizes = np.array([len(p) for p in pieces])
        for size in np.unique(sizes):
            row = np.flatnonzero(sizes == size)
            part = self.byte[np.frombuffer(b"".join([pieces[i] for i in row.tolist()]), np.uint8)].reshape(len(row), size)
            pair = self.rank(part[:, :-1], part[:, 1:])
            while len(row):
                low = pair.min(axis=1, initial=_NO_RANK)
                done = low == _NO_RANK
                for i, ids in zip(row[done].tolist(), part[done].astype("<u4"), strict=True):
                    out[i] = ids.tobytes()
                row, part, pair, low = row[~done], part[~done], pair[~done], low[~done]
                if not len(row):
                    break
                n, at = np.arange(len(row)), pair.argmin(axis=1)
                part[n, at] = low
                keep = np.ones(part.shape, dtype=bool)
                keep[n, at + 1] = False
                part = part[keep].reshape(len(row), -1)
                keep = np.ones(pair.shape, dtype=bool)
                keep[n, at] = False
                pair = pair[keep].reshape(len(row), -1)
                before, after = np.flatnonzero(at > 0), np.flatnonzero(at < pair.shape[1])
                pair[before, at[before] - 1] = self.rank(part[before, at[before] - 1], part[before, at[before]])
                pair[after, at[after]] = self.rank(part[after, at[after]], part[after, at[after] + 1])
        return out


def rank_literal(ranks: dict[bytes, int]) -> Column:
    """The rank map as one literal: buckets by xxhash64 of arrays of (piece, rank)."""
    buckets: list[list[dict]] = [[] for _ in range(_BUCKETS)]
    for piece, rank in ranks.items():
        buckets[xxhash.xxh64_intdigest(piece, seed=42) % _BUCKETS].append({"p": base64.b64encode(piece).decode(), "r": rank})
    return F.from_json(F.lit(json.dumps(buckets, separators=(",", ":"))), "array<array<struct<p:binary,r:int>>>")


def fold(piece: Column, ranks: Column) -> Column:
    """Ids (array<int>) of a binary piece of one byte at least, by a fold of ranked merges."""

    def rank(x: Column) -> Column:
        bucket = F.get(ranks, F.pmod(F.xxhash64(x), F.lit(_BUCKETS)).cast("int"))
        return F.get(F.filter(bucket, lambda e: e["p"] == x), 0)["r"]

    def step(state: Column, _: Column) -> Column:
        parts = state["parts"]
        pair_ranks = F.transform(F.sequence(F.lit(0), F.size(parts) - 2), lambda i: F.coalesce(rank(F.concat(F.get(parts, i), F.get(parts, i + 1))), F.lit(_NO_RANK)))

        def join(found: Column) -> Column:
            at = F.array_position(found, F.array_min(found)).cast("int")
            joined = F.concat(F.slice(parts, 1, at - 1), F.array(F.concat(F.get(parts, at - 1), F.get(parts, at))), F.slice(parts, at + 2, F.size(parts)))
            some = F.array_min(found) < _NO_RANK
            return F.struct(F.when(some, joined).otherwise(parts).alias("parts"), some.alias("open"))

        return F.when(state["open"] & (F.size(parts) > 1), F.get(F.transform(F.array(pair_ranks), join), 0)).otherwise(state)

    size = F.octet_length(piece)
    single = F.transform(F.sequence(F.lit(1), size), lambda i: F.substring(piece, i, 1))
    start = F.struct(single.alias("parts"), F.lit(True).alias("open"))
    folded = F.aggregate(F.sequence(F.lit(1), size), start, step, lambda s: s["parts"])
    return F.transform(folded, rank)


def piece_counts(docs: DataFrame, pattern: str) -> DataFrame:
    """(piece binary, n): the pieces of all texts, counted per task before the shuffle.

    A task counts what stands between single spaces and cuts each such word once. Where white
    space runs together the cut may differ from the text's own; the counts only choose the table.
    """

    def count(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        find = regex.compile(pattern).findall
        held, size = [], 0
        for batch in batches:
            column = batch.column(0).cast(pa.large_string())
            for at in range(0, len(column), ROWS):
                held.append(pc.split_pattern(column[at : at + ROWS], " ").flatten())
                size += held[-1].nbytes
                if size > COUNTED:
                    yield out(held, find)
                    held, size = [], 0
        if held:
            yield out(held, find)

    def out(held: list[pa.Array], find) -> pa.RecordBatch:
        words = pc.value_counts(pa.chunked_array(held).combine_chunks())
        pieces = pa.array(find(" " + " ".join(words.field("values").to_pylist())), pa.string())
        starts = pc.starts_with(pieces, " ").to_numpy(zero_copy_only=False)
        counts = words.field("counts").to_numpy()
        coded = pieces.dictionary_encode()
        per_piece = counts[np.clip(np.cumsum(starts) - 1, 0, max(0, len(counts) - 1))] if len(pieces) else counts[:0]
        total = np.bincount(coded.indices.to_numpy(), weights=per_piece, minlength=len(coded.dictionary)).astype(np.int64)
        return pa.RecordBatch.from_arrays([coded.dictionary.cast(pa.binary()), pa.array(total)], names=["piece", "n"])

    return docs.select("text").mapInArrow(count, "piece binary, n long").groupBy("piece").agg(F.sum("n").alias("n"))


def frequent(counts: DataFrame, most: int) -> DataFrame:
    """The pieces that occur at least 2^k times, for the least k that leaves at most so many."""
    level = F.floor(F.log2("n")).cast("int")
    by_level = {r["level"]: r["n_pieces"] for r in counts.groupBy(level.alias("level")).agg(F.count("*").alias("n_pieces")).collect()}
    least, total = 64, 0
    while least > 0 and total + by_level.get(least - 1, 0) <= most:
        least -= 1
        total += by_level.get(least, 0)
    return counts.filter(level >= least)


def gathered(begin: np.ndarray, size: np.ndarray, values: np.ndarray) -> np.ndarray:
    """The runs of values that start at begin and have the sizes, one after the other."""
    return values[np.repeat(begin - (np.cumsum(size) - size), size) + np.arange(int(size.sum()))]


class Coder:
    """Ids of whole texts in a task.

    A piece may hold a space only as its first character or among other white space. So a single
    space between other characters always starts a piece, and what stands between two such spaces
    is cut and coded once for a batch of texts. A text with other white space next to a space is
    cut whole.
    """

    def __init__(self, pattern: str, ranks: dict[bytes, int], known: dict[str, bytes]):
        self.find, self.ranks, self.known, self.merger = regex.compile(pattern).findall, ranks, known, Merger(ranks)
        self.rare: dict[str, bytes] = {}

    def piece_codes(self, pieces: list[str]) -> list[bytes]:
        """Ids of distinct pieces as little-endian bytes: from the table, or merged here and remembered."""
        if len(self.rare) >= REMEMBERED:
            self.rare.clear()
        new = [p for p in pieces if p not in self.known and p not in self.rare]
        raws = [p.encode() for p in new]
        short = [i for i, r in enumerate(raws) if len(r) <= FOLD_BYTES and r not in self.ranks]
        for i, ids in zip(short, self.merger.code([raws[i] for i in short]), strict=True):
            self.rare[new[i]] = ids
        for p, raw in zip(new, raws, strict=True):
            if p not in self.rare:
                self.rare[p] = np.array(merge(raw, self.ranks), "<u4").tobytes()
        return [self.known.get(p) or self.rare[p] for p in pieces]

    def code(self, texts: pa.Array) -> tuple[np.ndarray, np.ndarray]:
        """(number of ids of each text, all ids)."""
        if not len(texts):
            return np.zeros(0, np.int64), np.zeros(0, "<u4")
        split = pc.split_pattern(texts.cast(pa.large_string()), " ")
        edge = split.offsets.to_numpy() - split.offsets[0].as_py()
        coded = split.flatten().dictionary_encode()
        at, words = coded.indices.to_numpy().astype(np.int64), coded.dictionary
        odd = pc.match_substring_regex(words, f"^$|^{_SPACE}|{_SPACE}$").to_numpy(zero_copy_only=False)
        first = edge[:-1]
        bad = odd[at]
        bad[first] = False
        head = words.take(pa.array(at[first])).to_pylist()
        loose = np.fromiter((not w or w[-1].isspace() for w in head), bool, len(head)) & (np.diff(edge) > 1)
        whole = loose | (np.add.reduceat(bad.astype(np.int64), first) > 0)
        # Entries: the words that stand alone, an empty one, and what each text begins with, or is if it is cut whole.
        alone = np.flatnonzero(~odd)
        pieces = self.find(" " + " ".join(words.take(pa.array(alone)).to_pylist())) if len(alone) else []
        n_alone, n_pieces = len(pieces), [0]
        for i, w in enumerate(whole.tolist()):
            cut = self.find(texts[i].as_py() if w else head[i])
            n_pieces.append(len(cut))
            pieces += cut
        entry = np.full(len(words), len(alone))
        entry[alone] = np.arange(len(alone))
        every = pa.array(pieces, pa.large_string())
        starts = np.flatnonzero(pc.starts_with(every[:n_alone], " ").to_numpy(zero_copy_only=False))
        n_pieces = np.append(np.diff(np.append(starts, n_alone)), n_pieces)
        distinct = every.dictionary_encode()
        codes = self.piece_codes(distinct.dictionary.to_pylist())
        size = np.fromiter(map(len, codes), np.int64, len(codes)) // 4
        of_piece = distinct.indices.to_numpy().astype(np.int64)
        ids = gathered((np.cumsum(size) - size)[of_piece], size[of_piece], np.frombuffer(b"".join(codes), "<u4"))
        total = np.concatenate(([0], np.cumsum(size[of_piece])))
        stop = total[np.cumsum(n_pieces)]
        begin = np.concatenate(([0], stop[:-1]))
        at = entry[at]
        at[np.repeat(whole, np.diff(edge))] = len(alone)
        at[first] = len(alone) + 1 + np.arange(len(first))
        n = (stop - begin)[at]
        return np.add.reduceat(n, first), gathered(begin[at], n, ids)


def encode(docs: DataFrame, vocabulary: str, pattern: str, table_pieces: int = TABLE_PIECES) -> DataFrame:
    """(doc_id, n_tokens, ids array<int>, ids_bytes: the same as little-endian unsigned 32-bit integers) of every whole text."""
    docs, ranks = texts(docs), read_ranks(vocabulary)
    spark = docs.sparkSession
    counts = checkpointed(piece_counts(docs, pattern).filter(F.octet_length("piece") <= FOLD_BYTES))
    chosen = frequent(counts, table_pieces)
    coded = chosen.repartition(spark.sparkContext.defaultParallelism, "piece").select("piece", fold(F.col("piece"), rank_literal(ranks)).alias("ids")).toArrow()
    discard(counts)
    known: dict[str, bytes] = {}
    for batch in coded.to_batches():
        ids, edge = batch.column(1).flatten().to_numpy().astype("<u4").tobytes(), batch.column(1).offsets.to_numpy()
        edge = 4 * (edge - edge[0]).astype(np.int64)
        known |= {p.decode(): ids[i:j] for p, i, j in zip(batch.column(0).to_pylist(), edge[:-1].tolist(), edge[1:].tolist(), strict=True)}
    del coded
    sent = spark.sparkContext.broadcast(known)
    schema = pa.schema([("doc_id", pa.int64()), ("n_tokens", pa.int64()), ("ids", pa.list_(pa.int32())), ("ids_bytes", pa.binary())])

    def assemble(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        coder = Coder(pattern, read_ranks(vocabulary), sent.value)
        for batch in batches:
            for at, n in runs_of_bytes(batch.column(1), BATCH_BYTES):
                sizes, ids = coder.code(batch.column(1)[at : at + n])
                edge = np.concatenate(([0], np.cumsum(sizes)))
                listed = pa.ListArray.from_arrays(pa.array(edge, pa.int32()), pa.array(ids.view("<i4")))
                raw = pa.Array.from_buffers(pa.large_binary(), n, [None, pa.py_buffer(4 * edge), pa.py_buffer(ids)]).cast(pa.binary())
                yield pa.RecordBatch.from_arrays([batch.column(0)[at : at + n], pa.array(sizes), listed, raw], schema=schema)

    return docs.mapInArrow(assemble, "doc_id long, n_tokens long, ids array<int>, ids_bytes binary")


def piece_literal(ranks: dict[bytes, int]) -> Column:
    """The vocabulary's pieces as hexadecimal digits, in the order of their ranks, as one literal array."""
    pieces = [""] * (max(ranks.values(), default=-1) + 1)
    for piece, rank in ranks.items():
        pieces[rank] = piece.hex()
    return F.from_json(F.lit(json.dumps(pieces, separators=(",", ":"))), "array<string>")


def decoded(ids: Column, ranks: dict[bytes, int]) -> Column:
    """The bytes that ids (array<int>) stand for: their pieces from a literal array, put together."""
    pieces = piece_literal(ranks)
    return F.unhex(F.array_join(F.transform(ids, lambda i: F.get(pieces, i)), ""))


def decode(encoded: DataFrame, vocabulary: str) -> DataFrame:
    """encoded (ids array<int>, any others) with the decoded bytes; Spark's functions alone."""
    return encoded.withColumn("decoded", decoded(F.col("ids"), read_ranks(vocabulary)))


def digests(encoded: DataFrame, vocabulary: str) -> DataFrame:
    """(doc_id, n_tokens, ids_sha256, decoded_sha256) of encode(...), decoded here."""
    return decode(encoded, vocabulary).select("doc_id", "n_tokens", F.sha2("ids_bytes", 256).alias("ids_sha256"), F.sha2("decoded", 256).alias("decoded_sha256"))
