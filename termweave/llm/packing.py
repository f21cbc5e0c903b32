"""Best-fit packing of tokenised documents into sequences, improved by swap-based local search.

Tokenising: documents become ids of a public tokenizer file (its path is a parameter) and an end id; a document with more
than `capacity` ids is cut into pieces of that length, the last may be shorter. The default tokenizer's pre-tokeniser never
joins text across ASCII white space, so ids are made once for each distinct chunk between white space and kept in a
bounded cache; a tokenizer for which that does not hold is asked for whole texts.

Packing works on lengths alone. Pieces are dealt into blocks of about `block_rows` rows by a hash; full pieces are
sequences by themselves, the rest of a block is packed best-fit decreasing. Then, over the block's underfull sequences,
local search exchanges one piece for one, two for one, or moves one or two, which raises the sum of squared fills: fuller
bins fill up, others drain until they are empty and disappear. It considers all pieces and all fuller partners, and goes
on until nothing changes or the sizes could not fit into fewer bins. A block leaves at most about one sequence that is not
full because of the cut, so blocks cost one sequence in some ten thousand.

Null and empty texts are documents of the end id alone. Repeated rows are packed as often as they occur; ties fall to the
lower row of a block, whose order is by length, id and piece. An empty table gives an empty one; extra columns pass.
"""

from __future__ import annotations

import os
import re
import unicodedata
from array import array
from bisect import bisect_left, insort
from collections.abc import Iterator

import numpy as np
import pandas as pd
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from .common import bounded_batches, table, tidy, written

CAPACITY = 4096
END_ID = 1
TOKENIZER = "word_bpe_49k.json"
#: Entries of a generation of each cache: chunks, words, tails.
CACHE_CHUNKS = 60_000
BLOCK_ROWS = 50_000
#: Bytes of ids that a task of pack() holds to pack them together.
BLOCK_BYTES = 8_000_000


def tokenizer_path(name: str = TOKENIZER) -> str:
    import public_tokenizers

    return public_tokenizers.path(name)


#: A chunk that the pre-tokeniser cuts once, between its letters and what follows: its ids are those of both parts.
#: Latin letters only, whose lower case is plain; no quote, which can start a suffix, and no "<|", which can be special.
_WORD_TAIL = re.compile("([A-Za-z\u00c0-\u024f]+)([!-&(-/:;=>?@\\[-`{}~]*)")


#: Text by which a tokenizer shows whether chunks can be encoded apart: letters, marks, digits, cases and kinds of blanks.
_PROBE = " The quick-brown  fox's 12,345.67 jump(s): \u00c9t\u00e9, na\u00efve!\tWHO? can't \"quote\" a_b x=y...\n\nstra\u00dfe \u4e2d\u6587 ok 3rd\r\n(End) "


class _Known(dict):
    """A bounded cache in two generations: a full one becomes the old one, from which what is used returns."""

    def __init__(self, size: int, make):
        self.size, self.make, self.old = size, make, {}

    def __missing__(self, key):
        if len(self) >= self.size:
            self.old = dict(self)
            self.clear()
        if (value := self.old.get(key)) is None:
            value = self.make(key)
        self[key] = value
        return value


class Encoder:
    """Ids of texts as little-endian unsigned 32-bit bytes, by chunks between ASCII white space.

    A chunk of Latin letters in canonical form, with punctuation after it or not, goes through the tokenizer's model as
    one word; any other chunk through the whole tokenizer.
    """

    def __init__(self, path: str | None = None, cache: int = CACHE_CHUNKS):
        os.environ["TOKENIZERS_PARALLELISM"] = "false"
        from tokenizers import Tokenizer, pre_tokenizers

        self.tokenizer = Tokenizer.from_file(path or tokenizer_path())
        self.model = self.tokenizer.model
        # the byte-level alphabet, read off the pre-tokeniser: what it makes of each byte that a Latin letter can hold
        level = pre_tokenizers.ByteLevel(add_prefix_space=False, use_regex=False)
        self.bytes = {}
        for c in (chr(i) for i in range(0x250)):
            self.bytes.update(zip(c.encode(), level.pre_tokenize_str(c)[0][0], strict=True))
        self.chunks, self.words, self.tails = _Known(cache, self._chunk), _Known(cache, self._word), _Known(cache, self._whole)
        self.by_chunks = self._joined(_PROBE.encode()) == self._whole(_PROBE)

    def forget(self) -> None:
        """Empties the caches: a worker outlives its tasks, and the next stage needs the memory."""
        for known in (self.chunks, self.words, self.tails):
            known.clear()
            known.old = {}

    def encode(self, text: bytes) -> bytes:
        return self._joined(text) if self.by_chunks else self._whole(text.decode("utf-8", "replace"))

    def _joined(self, text: bytes) -> bytes:
        return b"".join(map(self.chunks.__getitem__, text.split()))

    def _chunk(self, chunk: bytes) -> bytes:
        s = chunk.decode("utf-8", "replace")
        m = _WORD_TAIL.fullmatch(s)
        if m is None or not (ids := self.words[m[1].lower()]):
            return self._whole(s)
        return ids + self.tails[m[2]] if m[2] else ids

    def _word(self, w: str) -> bytes:
        """Nothing, if the word is not one that the model can be asked for directly."""
        if not w.isascii():
            if not (w.isalpha() and unicodedata.is_normalized("NFC", w)):
                return b""
            w = "".join([self.bytes[b] for b in w.encode()])
        return array("I", [t.id for t in self.model.tokenize(w)]).tobytes()

    def _whole(self, s: str) -> bytes:
        return array("I", self.tokenizer.encode(s, add_special_tokens=False).ids).tobytes()


_ENCODERS: dict[str | None, Encoder] = {}


def encoder(path: str | None) -> Encoder:
    """One for each worker process and path; the default's path is looked up where the worker runs."""
    if path not in _ENCODERS:
        _ENCODERS[path] = Encoder(path)
    return _ENCODERS[path]


def pieces(docs: DataFrame, id_col: str = "doc_id", text_col: str = "text", capacity: int = CAPACITY, end_id: int = END_ID, path: str | None = None) -> DataFrame:
    """(id_col, piece int, start long, length long, ids binary: little-endian unsigned 32 bits)."""
    kind = docs.schema[id_col].dataType.simpleString()
    out = _texts(docs, id_col, text_col).mapInArrow(tidy(lambda batches: _cut(batches, path, capacity, end_id)), f"id {kind}, piece int, start long, length long, ids binary")
    return out.withColumnRenamed("id", id_col)


def _texts(docs: DataFrame, id_col: str, text_col: str) -> DataFrame:
    bounded_batches(docs.sparkSession)
    return docs.select(F.col(id_col).alias("id"), F.col(text_col).cast("binary").alias("text"))


def _cut(batches: Iterator[pa.RecordBatch], path: str | None, capacity: int, end_id: int) -> Iterator[pa.RecordBatch]:
    """(id, piece, start, length, ids) of batches of (id, text)."""
    enc, end, width = encoder(path), np.array([end_id], "<u4").tobytes(), 4 * capacity
    names = ["id", "piece", "start", "length", "ids"]

    def made(ids: pa.Array, rows: list[tuple]) -> pa.RecordBatch:
        row, piece, start, length, data = zip(*rows, strict=True)
        return pa.RecordBatch.from_arrays([ids.take(pa.array(row)), pa.array(piece, pa.int32()), pa.array(start, pa.int64()), pa.array(length, pa.int64()), pa.array(data, pa.binary())], names=names)

    for batch in batches:
        rows, held = [], 0
        for k, text in enumerate(batch.column("text")):
            ids = enc.encode(text.as_buffer().to_pybytes()) + end if text.is_valid else end
            for p, at in enumerate(range(0, len(ids), width)):
                part = ids[at : at + width] if len(ids) > width else ids
                rows.append((k, p, at // 4, len(part) // 4, part))
                held += len(part)
            if held > 4_000_000:
                yield made(batch.column("id"), rows)
                rows, held = [], 0
        if rows:
            yield made(batch.column("id"), rows)
    enc.forget()


# ---- bins --------------------------------------------------------------------------------------------------------


def best_fit(sizes: np.ndarray, capacity: int) -> list[list[int]]:
    """Bins of indices, best-fit decreasing: each size goes where the least room is left after it."""
    room: list[list[int]] = [[] for _ in range(capacity + 1)]
    rooms: list[int] = []  # sorted, those with a bin
    bins: list[list[int]] = []
    for i in np.argsort(-sizes, kind="stable").tolist():
        n = int(sizes[i])
        k = bisect_left(rooms, n)
        if k < len(rooms):
            r = rooms[k]
            b = room[r].pop()
            if not room[r]:
                rooms.pop(k)
            bins[b].append(i)
            left = r - n
        else:
            b = len(bins)
            bins.append([i])
            left = capacity - n
        if left > 0:
            if not room[left]:
                insort(rooms, left)
            room[left].append(b)
    return bins


def local_search(bins: list[list[int]], sizes: np.ndarray, capacity: int) -> list[list[int]]:
    """Moves and swaps between underfull bins that raise the sum of squared fills, until a round changes nothing.

    A round takes each underfull bin from the emptiest up as the donor and makes, again and again, the change that moves
    the most from it into a bin that is at least as full. A partner only gains, so the sum of squares grows with each change; a bin
    that has given all is dropped. The search ends as soon as the sizes could not fit into fewer bins.
    """
    every = [int(sizes[b].sum()) for b in bins]
    least, alive = -(-sum(every) // capacity), len(bins)
    if alive <= least:
        return bins
    # full bins neither give nor take
    full = [b for b, n in zip(bins, every, strict=True) if n >= capacity]
    bins = [b for b, n in zip(bins, every, strict=True) if n < capacity]
    fill = np.array([n for n in every if n < capacity], np.int64)
    rows = np.array([i for b in bins for i in b], np.int64)
    owner = np.repeat(np.arange(len(bins)), [len(b) for b in bins])
    sizes = sizes[rows]
    held = [set(range(a, a + len(b))) for a, b in zip(np.cumsum([0, *map(len, bins)]).tolist(), bins, strict=False)]
    changed = True
    while changed and alive > least:
        changed = False
        for d in np.lexsort((np.arange(len(bins)), fill)).tolist():
            while held[d] and fill[d] < capacity and (found := _best_change(d, held[d], owner, fill, sizes, capacity)):
                give, take, partner = found
                for pieces_, a, b in ((give, d, partner), (take, partner, d)):
                    held[a].difference_update(pieces_)
                    held[b].update(pieces_)
                    owner[pieces_] = b
                by = int(sizes[give].sum() - sizes[take].sum())
                fill[d] -= by
                fill[partner] += by
                changed = True
                if not held[d]:
                    alive -= 1
            if alive <= least:
                break
    return full + [sorted(rows[list(h)].tolist()) for h in held if h]


def _best_change(donor: int, own: set[int], owner: np.ndarray, fill: np.ndarray, sizes: np.ndarray, capacity: int) -> tuple[list[int], list[int], int] | None:
    """(given, taken, partner): one or two pieces of the donor for one or none of a partner, which moves the most.

    A table by size holds the most room of any partner with a piece of that size, so that a change is looked for among
    all pieces at the cost of the capacity. Partners are as full as the donor at least, and have room.
    """
    room = capacity - fill
    fits = (room > 0) & (room <= room[donor])
    fits[donor] = False
    if not fits.any():
        return None
    by_bin = np.where(fits, room, 0)
    most = np.zeros(capacity + 1, np.int64)
    np.maximum.at(most, sizes, by_bin[owner])
    most[0] = by_bin.max()
    # sizes that differ are few in a bin, however many pieces it has
    mine = np.array(sorted(own), np.int64)
    mine = mine[np.argsort(sizes[mine], kind="stable")]
    d, first, times = np.unique(sizes[mine], return_index=True, return_counts=True)
    a, b = np.triu_indices(len(d))
    a, b = a[(a < b) | (times[a] > 1)], b[(a < b) | (times[a] > 1)]
    sums, at = np.unique(d[a] + d[b], return_index=True)
    ways = {int(n): [int(mine[first[a[k]]]), int(mine[first[b[k]] + (a[k] == b[k])])] for n, k in zip(sums, at, strict=True)}
    ways |= {int(n): [int(mine[i])] for n, i in zip(d, first, strict=True)}
    amounts = np.array(sorted(ways, reverse=True), np.int64)
    taken = np.arange(capacity + 1)
    best = (0, 0, 0)
    for lo in range(0, len(amounts), 256):
        some = amounts[lo : lo + 256]
        if some[0] <= best[0]:
            break
        by = some[:, None] - taken[None, :]
        by = np.where((by > 0) & (by <= most[None, :]), by, 0)
        i, y = np.unravel_index(int(by.argmax()), by.shape)
        if by[i, y] > best[0]:
            best = (int(by[i, y]), int(some[i]), int(y))
    by, amount, y = best
    if not by:
        return None
    if not y:
        partner = int(np.where(by_bin >= by, by_bin, capacity + 1).argmin())
        return ways[amount], [], partner
    at = np.flatnonzero((sizes == y) & (by_bin[owner] >= by))
    piece = int(at[by_bin[owner[at]].argmin()])
    return ways[amount], [piece], int(owner[piece])


def pack_lengths(sizes: np.ndarray, capacity: int = CAPACITY) -> tuple[np.ndarray, np.ndarray]:
    """Bin and offset of each size."""
    sizes = np.asarray(sizes, np.int64)
    bin_of, offset = np.zeros(len(sizes), np.int64), np.zeros(len(sizes), np.int64)
    for b, members in enumerate(local_search(best_fit(sizes, capacity), sizes, capacity)):
        at = 0
        for i in members:
            bin_of[i], offset[i] = b, at
            at += int(sizes[i])
    return bin_of, offset


def assign(rows: DataFrame, capacity: int = CAPACITY, block_rows: int = BLOCK_ROWS) -> DataFrame:
    """rows (with length, and the columns to deal and order by) with sequence_id long, offset long.

    rows should be skinny and written: it is counted first, so that a block has a bounded number of rows at any size.
    """
    blocks = max(1, -(-rows.count() // block_rows))
    cols = rows.columns
    full = rows.filter(F.col("length") >= capacity)
    part = rows.filter(F.col("length") < capacity).withColumn("__block", F.pmod(F.xxhash64(*cols, F.monotonically_increasing_id()), F.lit(blocks)).cast("int"))

    def run(pdf: pd.DataFrame) -> pd.DataFrame:
        pdf = pdf.sort_values([c for c in cols if c != "ids"], ignore_index=True)
        bin_of, offset = pack_lengths(pdf["length"].to_numpy(), capacity)
        return pdf.drop(columns="__block").assign(sequence_id=(bin_of * blocks + int(pdf["__block"].iloc[0])) * 2, offset=offset)

    schema = ", ".join(f"`{c}` {t}" for c, t in rows.dtypes) + ", sequence_id long, offset long"
    packed = part.groupBy("__block").applyInPandas(run, schema)
    return packed.unionByName(full.withColumn("sequence_id", F.monotonically_increasing_id() * 2 + 1).withColumn("offset", F.lit(0).cast("long")))


def pack(docs: DataFrame, id_col: str = "doc_id", text_col: str = "text", capacity: int = CAPACITY, end_id: int = END_ID, path: str | None = None, block_bytes: int = BLOCK_BYTES) -> DataFrame:
    """Sequences with their ids: sequence_id, offset, id_col, piece, start, length, ids; one row per piece.

    Tokenises and packs in one pass without a shuffle: each task packs what it has tokenised in blocks of some
    block_bytes of ids, so that at most one sequence a block stays short for want of pieces.
    """
    names = ["id", "piece", "start", "length", "ids", "sequence_id", "offset"]

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        from pyspark import TaskContext

        first = TaskContext.get().partitionId() << 33
        held, size = [], 0
        for batch in _cut(batches, path, capacity, end_id):
            held.append(batch)
            size += batch.column("ids").nbytes
            if size >= block_bytes:
                used = 0
                for out, used in settled(held, first):
                    yield out
                first, held, size = first + used, [], 0
        for out, _ in settled(held, first) if held else ():
            yield out

    def settled(held: list[pa.RecordBatch], first: int) -> Iterator[tuple[pa.RecordBatch, int]]:
        sizes = np.concatenate([b.column("length").to_numpy() for b in held])
        bin_of, offset = pack_lengths(sizes, capacity)
        used, at = int(bin_of.max()) + 1 if len(bin_of) else 0, 0
        for b in held:
            part = slice(at, at + b.num_rows)
            yield pa.RecordBatch.from_arrays([*b.columns, pa.array(bin_of[part] + first), pa.array(offset[part])], names=names), used
            at += b.num_rows

    kind = docs.schema[id_col].dataType.simpleString()
    out = _texts(docs, id_col, text_col).mapInArrow(tidy(run), f"id {kind}, piece int, start long, length long, ids binary, sequence_id long, offset long")
    return out.select("sequence_id", "offset", F.col("id").alias(id_col), "piece", "start", "length", "ids")


# ---- query -------------------------------------------------------------------------------------------------------


def op10_best_fit_packing(spark, sf_dir: str) -> DataFrame:
    docs = table(spark, sf_dir, "documents").select("doc_id", "text")
    cut = pieces(docs).select("doc_id", "piece", "start", "length", F.crc32("ids").alias("ids_crc32"))
    return assign(written(cut, "piece-lengths"))
