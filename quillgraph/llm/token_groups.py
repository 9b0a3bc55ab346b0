"""Alignment of two tokenizers by pointer jumping, and how often two ids meet.

Both encodings of a text end where it ends, so tokens are ranges of its bytes. Every token points to the farthest-right
token that overlaps it, itself if none reaches further. Doubling the successors of all tokens of a batch at once, until
nothing changes, leads every token to the last token of its component, and components are the groups between bytes where
tokens of both end. No token of either spans a space after another character, so what stands between such spaces is
encoded and aligned once and remembered.

Links of a text come as distinct id pairs with their number. How many documents hold a pair is counted over all of them;
the pairs that most documents hold meet the documents as a broadcast of bounded size, the others in a shuffle, where
none of them has many rows.
"""

from __future__ import annotations

import hashlib
import re

import numpy as np
from pyspark.sql import DataFrame
from pyspark.sql import functions as F
from pyspark.sql import types as T

from .common import stash, table, texts

SPACE = "▁"  # stands for a space inside pieces
#: A space after what isn't white space in either model (and one character that some versions count among it).
CUT = re.compile("(?<=[^\\s\u2581\u180e]) ")
MASK = (1 << 64) - 1
MARKS = (b"", b",", b"|", b";")  # after a token: nothing at the end of a text, within one side, between sides, between groups


def byte_alphabet() -> dict[str, int]:
    """Characters that stand for bytes in a byte-level vocabulary: printable ones for themselves, others from 256 on in order."""
    shown = {*range(0x21, 0x7F), *range(0xA1, 0xAD), *range(0xAE, 0x100)}
    hidden = [b for b in range(256) if b not in shown]
    return {chr(b): b for b in shown} | {chr(256 + k): b for k, b in enumerate(hidden)}


def farthest(a_ends: np.ndarray, b_ends: np.ndarray) -> np.ndarray:
    """For tokens of A, then of B, both covering the same bytes: the place of the farthest-right token overlapping each."""
    n = len(a_ends)
    to_b = np.searchsorted(b_ends, a_ends, "left")
    to_a = np.searchsorted(a_ends, b_ends, "left")
    return np.concatenate([n + to_b, np.where(a_ends[to_a] > b_ends, to_a, n + np.arange(len(b_ends)))])


def jumped(successor: np.ndarray) -> np.ndarray:
    """The place where following the successors ends, for all places at once."""
    while True:
        twice = successor[successor]
        if np.array_equal(twice, successor):
            return successor
        successor = twice


class Aligner:
    """Groups, links and digests of texts under a byte-level and a sentencepiece model, with a memory of bounded size for what stands between spaces."""

    def __init__(self, byte_file: str, piece_file: str, most: int = 400_000):
        import os

        os.environ["TOKENIZERS_PARALLELISM"] = "false"
        import sentencepiece
        from tokenizers import Tokenizer

        self.a, self.b = Tokenizer.from_file(byte_file), sentencepiece.SentencePieceProcessor(model_file=piece_file)
        self.a.encode_special_tokens = True
        alphabet = byte_alphabet()
        added = {i: t.content for i, t in self.a.get_added_tokens_decoder().items()}
        entry = lambda i: added[i].encode() if i in added else bytes(alphabet[c] for c in self.a.id_to_token(i))
        self.a_bytes = [entry(i) for i in range(self.a.get_vocab_size())]
        pieces = [self.b.id_to_piece(i) for i in range(self.b.get_piece_size())]
        self.b_bytes = [bytes([int(p[3:5], 16)]) if self.b.is_byte(i) else p.replace(SPACE, " ").encode() for i, p in enumerate(pieces)]
        # whether a text may be cut before a space that follows another character
        self.cuts = not any(SPACE in p.lstrip(SPACE) for p in pieces)
        self.a_sizes, self.b_sizes = (np.array([len(x) for x in entries]) for entries in (self.a_bytes, self.b_bytes))
        self.n = max(len(self.a_bytes), len(self.b_bytes))
        self.spelled = [str(i).encode() + mark for mark in MARKS for i in range(self.n)]
        self.known, self.most = {}, most
        self.blank = self.b.encode("x ")[len(self.b.encode("x")) :]  # what a space at the end of a text becomes

    def parts(self, text: str) -> list[str]:
        """The text cut at spaces that no token of either model spans: what stands between them is encoded alike alone and in the text."""
        if not text:
            return []
        return CUT.split(text) if self.cuts else [text]

    def learn(self, parts: set[str]) -> dict:
        """What ``of_parts`` says of those that aren't remembered. Short ones are remembered from now on."""
        new = [p for p in parts if p not in self.known]
        found = dict(zip(new, self.of_parts(new), strict=True))
        if len(self.known) > self.most:
            self.known.clear()
            found |= self.learn(parts.difference(found))
        self.known.update((p, of) for p, of in found.items() if len(p) <= 64)
        return found

    def encoded(self, parts: list[str]) -> tuple[list[int], np.ndarray, np.ndarray]:
        """Places of the parts that both models spell, and the ids of those, one part behind the other.

        Parts are encoded by the hundred, as a text of their own; one that ends in white space comes last in its text.
        """
        groups, open_ = [], []
        for k, part in enumerate(parts):
            if CUT.search(part[-1:] + " ") and self.cuts:
                open_.append(k)
            else:
                groups.append([k])
            if len(open_) == 256:
                groups.append(open_)
                open_ = []
        groups = groups + [open_] if open_ else groups
        held: list[int] = []
        sides: tuple[list, list] = [], []
        while groups:
            joined = [" ".join(map(parts.__getitem__, ks)) for ks in groups]
            a_ids = [e.ids for e in self.a.encode_batch_fast([" " + t for t in joined], add_special_tokens=False)]
            b_ids = [ids if t else self.blank for t, ids in zip(joined, self.b.encode(joined, num_threads=1), strict=True)]
            again = []
            for ks, text, a, b in zip(groups, joined, a_ids, b_ids, strict=True):
                whole = b" " + text.encode()
                if b"".join(map(self.a_bytes.__getitem__, a)) == whole == b"".join(map(self.b_bytes.__getitem__, b)):
                    held += ks
                    sides[0].append(a)
                    sides[1].append(b)
                elif len(ks) > 1:
                    again += [[k] for k in ks]
            groups = again
        return held, *(np.concatenate([np.zeros(0, np.int64), *map(np.array, side)]).astype(np.int64) for side in sides)

    def of_parts(self, parts: list[str]) -> list[tuple[bytes, bytes, int] | None]:
        """Of each part with a space in front: its groups spelled out, the keys of its links, and its numbers of A tokens, B tokens
        and groups in 64 bits each. None where a model doesn't spell it."""
        out: list = [None] * len(parts)
        held, a, b = self.encoded(parts)
        if not held:
            return out
        # parts stand one behind the other: both sides end at the same byte after each
        a_ends, b_ends = np.cumsum(self.a_sizes[a]), np.cumsum(self.b_sizes[b])
        ends = np.cumsum([1 + len(parts[k].encode()) for k in held])
        n_a, n_b = (np.diff(np.searchsorted(side, ends, "right"), prepend=0) for side in (a_ends, b_ends))
        last = jumped(farthest(a_ends, b_ends))
        terminal = np.zeros(len(last), np.int64)
        terminal[last] = 1
        group = (np.cumsum(terminal) - 1)[last]  # terminals are B tokens, numbered from the left
        of_a, of_b = (np.repeat(np.arange(len(held)), n) for n in (n_a, n_b))
        side = np.concatenate([np.zeros(len(a), np.int64), np.ones(len(b), np.int64)])
        order = np.argsort(2 * group + side, kind="stable")
        ids, side, group, of = np.concatenate([a, b])[order], side[order], group[order], np.concatenate([of_a, of_b])[order]
        mark = np.where(group[1:] != group[:-1], 3, np.where(side[1:] != side[:-1], 2, 1))
        mark = np.append(np.where(of[1:] != of[:-1], 0, mark), 0)
        spelled = list(map(self.spelled.__getitem__, (mark * self.n + ids).tolist()))
        # B tokens that overlap each A token lie in a row
        first = np.searchsorted(b_ends, a_ends - self.a_sizes[a], "right")
        n_links = np.searchsorted(b_ends - self.b_sizes[b], a_ends, "left") - first
        from_ = np.repeat(np.arange(len(a)), n_links)
        to = np.arange(len(from_)) - np.repeat(np.cumsum(n_links) - n_links, n_links) + first[from_]
        keys = a[from_] * self.n + b[to]
        n_groups = np.bincount(of_b, terminal[len(a) :], len(held)).astype(np.int64)
        stops, ends, keys = np.cumsum(n_a + n_b).tolist(), (8 * np.cumsum(np.bincount(of_a[from_], minlength=len(held)))).tolist(), keys.tobytes()
        for k, start, stop, at, end, x, y, z in zip(held, [0, *stops], stops, [0, *ends], ends, n_a.tolist(), n_b.tolist(), n_groups.tolist(), strict=False):
            out[k] = b"".join(spelled[start:stop]), keys[at:end], x | y << 64 | z << 128
        return out

    def aligned(self, texts: list[str]):
        """Per text: numbers of A tokens, B tokens, groups and links, digest; then ends, A ids, B ids and numbers of its distinct linked pairs."""
        parts = list(map(self.parts, texts))
        found = self.learn(set().union(*parts))
        counts, digests, links = np.zeros((4, len(texts)), np.int64), [""] * len(texts), []
        for k, own in enumerate(parts):
            entries = [self.known[p] if p in self.known else found[p] for p in own]
            # a part that a model spells otherwise differs at a place, and so does the text
            if entries and None not in entries:
                spelled, keys, sums = zip(*entries, strict=True)
                digests[k] = hashlib.sha256(b";".join(spelled)).hexdigest()
                links.append((k, np.frombuffer(b"".join(keys), np.int64)))
                n = sum(sums)
                counts[:, k] = n & MASK, n >> 64 & MASK, n >> 128, len(links[-1][1])
        keys, times = np.unique(np.concatenate([k * self.n**2 + of for k, of in links] or [np.zeros(0, np.int64)]), return_counts=True)
        ends = np.concatenate([[0], np.cumsum(np.bincount(keys // self.n**2, minlength=len(texts)))])
        return counts, digests, ends, keys // self.n % self.n, keys % self.n, times


_aligners: dict[tuple[str, str], Aligner] = {}
PAIRS = "array<struct<a: int, b: int, times: bigint>>"


def aligned(docs: DataFrame, byte_file: str, piece_file: str, text: str = "text") -> DataFrame:
    """``doc_id``, ``n_a``, ``n_b``, ``n_groups``, ``n_links``, ``groups_sha256`` and ``pairs`` of each row: a pass over the rows, no shuffle."""
    names = ["n_a", "n_b", "n_groups", "n_links"]
    schema = T.StructType([T.StructField("doc_id", docs.schema["doc_id"].dataType), *[T.StructField(n, T.LongType()) for n in names], T.StructField("groups_sha256", T.StringType()), T.StructField("pairs", T._parse_datatype_string(PAIRS))])

    def run(batches):
        import pyarrow as pa

        key = byte_file, piece_file
        aligner = _aligners.get(key) or _aligners.setdefault(key, Aligner(*key))
        for batch, raws in texts(batches):
            counts, digests, ends, a, b, times = aligner.aligned([r.decode("utf-8", "replace") for r in raws])
            pairs = pa.StructArray.from_arrays([pa.array(a, pa.int32()), pa.array(b, pa.int32()), pa.array(times, pa.int64())], ["a", "b", "times"])
            yield pa.RecordBatch.from_arrays([batch.column(0), *(pa.array(c, pa.int64()) for c in counts), pa.array(digests, pa.string()), pa.ListArray.from_arrays(pa.array(ends, pa.int32()), pairs)], schema.names)

    return docs.select("doc_id", F.col(text).cast("string").alias("text")).mapInArrow(run, schema)


def most_held(known: DataFrame, most: int) -> tuple[DataFrame, DataFrame | None]:
    """Rows of ``known`` with the largest ``docs``, at most ``most`` of them, and the others (None: there are none).

    The border is a power of two, read from a histogram of at most 64 rows.
    """
    sizes = known.groupBy(F.floor(F.log2("docs")).alias("size")).agg(F.count("*").alias("n")).orderBy(F.desc("size")).collect()
    taken, border = 0, None
    for row in sizes:
        if taken + row["n"] > most:
            break
        taken, border = taken + row["n"], row["size"]
    if border is None:
        return known.limit(0), known
    rest = None if border == sizes[-1]["size"] else known.where(F.col("docs") < 2**border)
    return known.where(F.col("docs") >= 2**border), rest


def token_groups(docs: DataFrame, byte_file: str, piece_file: str, most: int = 400_000, text: str = "text") -> DataFrame:
    """Per row of ``docs``: doc_id, n_a, n_b, n_groups, n_links, n_best, count_sum and groups_sha256.

    ``most``: pairs that are broadcast. A null or empty text, or one that a model doesn't spell byte by byte, has no tokens:
    zeros and an empty digest. Each row counts as a document, so repeated rows count again and null ids come back; all
    pairs of the highest count of an A id are its best. Long texts are encoded between spaces and aligned whole. An empty table
    gives an empty result; other columns are ignored.
    """
    rows = stash(aligned(docs, byte_file, piece_file, text).withColumn("row", F.monotonically_increasing_id()))
    links = rows.select("row", F.inline("pairs"))
    counts = stash(links.groupBy("a", "b").agg(F.count("*").alias("docs")))
    # a row for each entry of a vocabulary at most
    best = F.broadcast(counts.groupBy("a").agg(F.max("docs").alias("best")))
    known = stash(counts.join(best, "a").select("a", "b", "docs", (F.col("docs") == F.col("best")).alias("is_best")))
    heavy, rest = most_held(known, most)
    summed = lambda joined: joined.groupBy("row").agg(F.sum(F.when(F.col("is_best"), F.col("times")).otherwise(0)).alias("n_best"), F.sum(F.col("docs") * F.col("times")).alias("count_sum"))
    sums = summed(links.join(F.broadcast(heavy), ["a", "b"]))
    if rest is not None:
        others = links.join(F.broadcast(heavy.select("a", "b")), ["a", "b"], "left_anti")
        both = sums.unionByName(summed(others.join(rest, ["a", "b"])))
        sums = both.groupBy("row").agg(F.sum("n_best").alias("n_best"), F.sum("count_sum").alias("count_sum"))
    zero = lambda c: F.coalesce(c, F.lit(0).cast("long")).alias(c)
    return rows.drop("pairs").join(sums, "row", "left").select("doc_id", "n_a", "n_b", "n_groups", "n_links", zero("n_best"), zero("count_sum"), "groups_sha256")


def op13_token_alignment(spark, sf_dir: str) -> DataFrame:
    import public_tokenizers

    return token_groups(table(spark, sf_dir, "documents"), public_tokenizers.path("byte_bpe_50k.json"), public_tokenizers.path("piece_bpe_32k.model"))


QUERIES = {"op13_token_alignment": op13_token_alignment}
ORACLES: dict[str, str] = {}
