"""Best-fit packing of token pieces into sequences of one size, improved by swaps.

Texts are cut into pieces where they are read; only ids and lengths are shuffled. Pieces are dealt by a hash into
shards of a bounded number of pieces. Each shard is packed best-fit in falling order of length and then improved by
local search: pieces leave the emptiest underfull sequences by a move into a gap, by an exchange with a shorter piece
whose sequence gets fuller, or by an exchange with two shorter pieces. Each step raises the sum of squared fills, so
the search ends; it goes on until no such exchange raises the sum, and sequences that run empty go. Sequences that a
shard leaves underfull are dealt anew and packed with those of other shards, until few enough remain for one shard or a
level empties no sequence.
"""

from __future__ import annotations

import re
import zlib
from array import array
from collections import defaultdict

import numpy as np
import pandas as pd
from pyspark.sql import DataFrame
from pyspark.sql import functions as F
from pyspark.sql import types as T

from .common import stash, table, texts

PIECES = "doc_id {id}, piece int, start long, length long, ids_crc32 long"


def best_fit(lengths: np.ndarray, size: int) -> list[list[int]]:
    """Bins of places in ``lengths``, longest first, each into the fullest bin that holds it."""
    bins: list[list[int]] = []
    with_room: list[list[int]] = [[] for _ in range(size + 1)]
    rooms = 0  # bit r: a bin has r left
    for place in np.argsort(-lengths, kind="stable").tolist():
        length = int(lengths[place])
        fitting = rooms >> length
        if fitting:
            room = length + (fitting & -fitting).bit_length() - 1
            at = with_room[room].pop()
            if not with_room[room]:
                rooms &= ~(1 << room)
            bins[at].append(place)
        else:
            room, at = size, len(bins)
            bins.append([place])
        left = room - length
        if left:
            with_room[left].append(at)
            rooms |= 1 << left
    return bins


def _bits(mask: int):
    while mask:
        low = mask & -mask
        yield low.bit_length() - 1
        mask ^= low


class _Underfull:
    """Underfull bins by free space, and by free space with the sizes of their pieces and of pairs of their pieces, as bit sets."""

    def __init__(self, bins: list[list[int]], sizes: list[int], size: int):
        self.bins, self.sizes, self.size = bins, sizes, size
        self.fill = [sum(sizes[p] for p in b) for b in bins]
        self.rooms = 0  # bit r: a bin has r left
        self.by_room: dict[int, dict[int, None]] = defaultdict(dict)
        self.present = (defaultdict(int), defaultdict(int))  # for pieces and for pairs: room -> bit set of sizes
        self.holders: tuple[dict, dict] = (defaultdict(dict), defaultdict(dict))  # (room, size) -> bins
        for k in range(len(bins)):
            self.put(k)

    def _held(self, k: int) -> tuple[int, int]:
        one = two = 0
        for p in self.bins[k]:
            two |= one << self.sizes[p]
            one |= 1 << self.sizes[p]
        return one, two

    def put(self, k: int) -> None:
        left = self.size - self.fill[k]
        if self.bins[k] and left:
            self.rooms |= 1 << left
            self.by_room[left][k] = None
            for present, holders, held in zip(self.present, self.holders, self._held(k), strict=True):
                present[left] |= held
                for s in _bits(held):
                    holders[left, s][k] = None

    def take(self, k: int) -> None:
        left = self.size - self.fill[k]
        if k not in self.by_room[left]:
            return
        del self.by_room[left][k]
        if not self.by_room[left]:
            self.rooms &= ~(1 << left)
        for present, holders, held in zip(self.present, self.holders, self._held(k), strict=True):
            for s in _bits(held):
                del holders[left, s][k]
                if not holders[left, s]:
                    del holders[left, s]
                    present[left] &= ~(1 << s)

    def best(self, x: int, fill: int) -> tuple[int, list[int]] | None:
        """Where a piece of ``x`` from a bin filled to ``fill`` should go and the sizes that come back for it; None if nothing gains.

        An exchange that moves d on balance into a bin filled to f changes the sum of squares by 2 d (f + d - fill). In one
        room all bins are filled alike, so the smallest size that may come back gains most there; all rooms are looked at.
        """
        # without anything back, the fullest bin that holds it
        fits = (self.rooms >> x << x) & ((1 << max(0, self.size - fill + x)) - 1)
        if fits:
            return next(iter(self.by_room[(fits & -fits).bit_length() - 1])), []
        gain, found = 0, None
        for kind, present in enumerate(self.present):
            for left in _bits(self.rooms):
                least, most = max(1, x - left), min(x - 1, self.size - left + x - fill - 1)
                fits = present[left] >> least << least & ((1 << most + 1) - 1) if least <= most else 0
                if fits:
                    back = (fits & -fits).bit_length() - 1
                    g = (x - back) * (self.size - left + x - back - fill)
                    if g > gain:
                        gain, found = g, (kind, left, back)
        if found is None:
            return None
        kind, left, back = found
        to = next(iter(self.holders[kind][left, back]))
        if kind == 0:
            return to, [back]
        held = sorted(self.sizes[p] for p in self.bins[to])
        have = set(held)
        return to, next([s, back - s] for s in held if back - s in have and (2 * s != back or held.count(s) > 1))


def improve(bins: list[list[int]], lengths: np.ndarray, size: int) -> list[list[int]]:
    """Local search over the underfull bins until no move and no exchange of one piece for one or two raises the sum of squared fills.

    Each step raises that sum of whole numbers, so the search ends. Bins run from the emptiest, pieces from the longest.
    """
    sizes = lengths.tolist()
    state = _Underfull(bins, sizes, size)
    fill = state.fill

    def step(k: int) -> bool:
        state.take(k)
        for x in sorted({sizes[p] for p in bins[k]}, reverse=True):
            found = state.best(x, fill[k])
            if found is None:
                continue
            to, back = found
            state.take(to)
            moved = next(p for p in bins[k] if sizes[p] == x)
            bins[k].remove(moved)
            for s in back:
                q = next(p for p in bins[to] if sizes[p] == s)
                bins[to].remove(q)
                bins[k].append(q)
            bins[to].append(moved)
            fill[to] += x - sum(back)
            fill[k] -= x - sum(back)
            state.put(to)
            state.put(k)
            return True
        state.put(k)
        return False

    changed = True
    while changed:
        changed = False
        for k in sorted((k for k in range(len(bins)) if bins[k] and fill[k] < size), key=fill.__getitem__):
            while bins[k] and fill[k] < size and step(k):
                changed = True
    return [b for b in bins if b]


def pack(lengths: np.ndarray, size: int) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
    """Bin, offset and whether its bin is full, for each piece."""
    whole = np.flatnonzero(lengths == size)
    rest = np.flatnonzero(lengths < size)
    bins = [[int(p)] for p in whole]
    if len(rest):
        bins += [[int(rest[p]) for p in b] for b in improve(best_fit(lengths[rest], size), lengths[rest], size)]
    at, offset, full = np.zeros(len(lengths), np.int64), np.zeros(len(lengths), np.int64), np.zeros(len(lengths), bool)
    for k, b in enumerate(bins):
        used = 0
        for p in b:
            at[p], offset[p] = k, used
            used += int(lengths[p])
        full[b] = used >= size
    return at, offset, full


_LATER = re.compile("[\u0500-\U0010ffff]")


class _Encoder(dict):
    """Ids of a blank and a chunk without white space at its ends, as bytes; the memory is bounded."""

    def __init__(self, tokenizer_file: str, ranks_file: str | None = None, most: int = 250_000):
        super().__init__()
        import os

        os.environ["TOKENIZERS_PARALLELISM"] = "false"
        from tokenizers import Tokenizer

        self.tokenizer, self.most = Tokenizer.from_file(tokenizer_file), most
        self.special = [t.content for t in self.tokenizer.get_added_tokens_decoder().values()]
        self.by_rank = None
        if ranks_file:
            import base64

            import public_tokenizers
            import tiktoken

            with open(ranks_file, "rb") as lines:
                ranks = {base64.b64decode(a): int(b) for a, b in map(bytes.split, lines)}
            self.by_rank = tiktoken.Encoding("ranks", pat_str=public_tokenizers.PATTERN, mergeable_ranks=ranks, special_tokens={})

    def __missing__(self, chunk: str) -> bytes:
        if not chunk or chunk[0].isspace() or chunk[-1].isspace():
            raise _Run
        if len(self) >= self.most:
            self.clear()
        if chunk[-1] in ",." and chunk[:-1].isalpha():
            ids = self[chunk[:-1]] + self.encode(chunk[-1])  # letters and marks never share a token
        else:
            ids = self.encode(" " + chunk)
        self[chunk] = ids
        return ids

    def encode(self, text: str) -> bytes:
        if self.by_rank and self.plain(text):
            return array("I", self.by_rank.encode_ordinary(text)).tobytes()
        return self.whole(text)

    @staticmethod
    def plain(text: str) -> bool:
        """Whether letter and number classes of its characters don't differ between the two libraries' Unicode versions."""
        return text.isascii() or not _LATER.search(text)

    def whole(self, text: str) -> bytes:
        return np.array(self.tokenizer.encode(text, add_special_tokens=False).ids, "<u4").tobytes()

    def of_text(self, text: str) -> bytes:
        if any(s in text for s in self.special):
            return self.whole(text)
        if self.by_rank and self.plain(text):
            return self.encode(text)  # where most words are new, pieces and their memory cost more than they spare
        chunks = text.split(" ")
        try:
            if chunks[0][-1:].isspace():
                raise _Run
            return self.encode(chunks[0]) + b"".join(map(self.__getitem__, chunks[1:]))
        except _Run:
            return self.encode(text)


class _Run(Exception):
    """A blank stands next to other white space: they belong to one run, and the text is taken as a whole."""


_encoders: dict[str, _Encoder] = {}


def token_pieces(docs: DataFrame, tokenizer_file: str, end_id: int, size: int, text: str = "text", ranks_file: str | None = None) -> DataFrame:
    """One row for each piece of each document: its ids under a byte-level tokenizer, then ``end_id``.

    ``ranks_file`` is the same vocabulary as ranks, from which new words are encoded faster with the same ids.
    Documents of more than ``size`` ids are cut into pieces of ``size``, the first shorter if need be.
    """
    schema = PIECES.format(id=docs.schema["doc_id"].dataType.simpleString())

    def cut(batches):
        import pyarrow as pa

        if tokenizer_file not in _encoders:
            _encoders[tokenizer_file] = _Encoder(tokenizer_file, ranks_file)
        encoder, end = _encoders[tokenizer_file], np.array([end_id], "<u4").tobytes()
        for batch, rows in texts(batches):
            of, pieces, starts, sizes, sums = [], [], [], [], []
            for k, raw in enumerate(rows):
                ids = encoder.of_text(raw.decode("utf-8", "replace")) + end
                n = len(ids) // 4
                cuts = [0, *range(n % size or size, n, size), n]
                for j, (a, b) in enumerate(zip(cuts, cuts[1:], strict=False)):
                    of.append(k)
                    pieces.append(j)
                    starts.append(a)
                    sizes.append(b - a)
                    sums.append(zlib.crc32(ids[4 * a : 4 * b]))
            yield pa.RecordBatch.from_arrays(
                [batch.column(0).take(pa.array(of, pa.int64())), pa.array(pieces, pa.int32()), *(pa.array(x, pa.int64()) for x in (starts, sizes, sums))],
                ["doc_id", "piece", "start", "length", "ids_crc32"],
            )

    return docs.select("doc_id", F.col(text).cast("string").alias("text")).mapInArrow(cut, schema)


def pack_pieces(pieces: DataFrame, size: int, shard_pieces: int = 16_384) -> DataFrame:
    """``pieces`` with ``sequence_id`` and ``offset``. ``pieces`` should be stashed: they are counted and read twice."""
    out_schema = T.StructType([*pieces.schema.fields, T.StructField("sequence_id", T.LongType()), T.StructField("offset", T.LongType()), T.StructField("full", T.BooleanType())])

    def packed(rows: DataFrame, n: int, level: int, last: bool) -> DataFrame:
        shards = max(1, -(-n // shard_pieces))

        def one(pdf: pd.DataFrame) -> pd.DataFrame:
            pdf = pdf.sort_values(["length", "doc_id", "piece", "start", "ids_crc32"], ascending=[False, True, True, True, True], kind="stable", ignore_index=True)
            shard = int(pdf["_shard"].iloc[0])
            at, offset, full = pack(pdf["length"].to_numpy(), size)
            out = pdf.drop(columns="_shard")
            out["sequence_id"], out["offset"], out["full"] = (np.int64(level) << 56) + (np.int64(shard) << 24) + at, offset, full | last
            return out

        # by the row's place in the stashed files: repeated rows and null ids spread like any others
        shard = F.pmod(F.xxhash64(F.monotonically_increasing_id(), F.lit(level)), F.lit(shards)).cast("int")
        return rows.withColumn("_shard", shard).groupBy("_shard").applyInPandas(one, out_schema)

    n, before, done, level = pieces.count(), None, None, 0
    while True:
        last = n <= shard_pieces
        result = packed(pieces, n, level, last)
        if last:
            break
        result = stash(result)
        kept = result.where("full")
        done = kept if done is None else done.unionByName(kept)
        underfull = result.where("not full")
        pieces = underfull.drop("sequence_id", "offset", "full")
        left = underfull.agg(F.count("*").alias("pieces"), F.count_if(F.col("offset") == 0).alias("sequences")).first()
        if before is not None and left["sequences"] >= before:
            # a new deal and a whole search emptied no sequence: what is left stays as it is
            return done.unionByName(result.where("not full")).drop("full")
        n, before, level = left["pieces"], left["sequences"], level + 1
    return (result if done is None else done.unionByName(result)).drop("full")


def best_fit_packing(docs: DataFrame, tokenizer_file: str, end_id: int = 2, size: int = 1024, text: str = "text", ranks_file: str | None = None) -> DataFrame:
    """Per piece: doc_id, piece, start, length, ids_crc32, sequence_id and offset.

    A null text counts as empty and gives one piece, the end id. Repeated rows and null ids are packed like any others,
    each row on its own; an empty table gives an empty result; other columns are ignored. Any number of pieces may have
    one length: shards are dealt by the
    row's place in the stashed files, not by length, id or source.
    """
    return pack_pieces(stash(token_pieces(docs, tokenizer_file, end_id, size, text, ranks_file)), size)


def op9_best_fit_packing(spark, sf_dir: str) -> DataFrame:
    import public_tokenizers

    return best_fit_packing(table(spark, sf_dir, "documents"), public_tokenizers.path("byte_bpe_50k.json"), ranks_file=public_tokenizers.path("byte_bpe_50k.tiktoken"))


QUERIES = {"op9_best_fit_packing": op9_best_fit_packing}
ORACLES: dict[str, str] = {}
