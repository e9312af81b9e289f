"""Alignment of the tokens of two tokenizers by pointer jumping.

Both tokenizers cut the same bytes.  Every token points to the farthest-right token of the other tokenizer that it
overlaps, the one that holds its last byte; a token of the first tokenizer whose last byte ends a token of the other
points to itself.  Successors are doubled for all tokens of a block of texts at once until none moves; then each token
knows the terminal token of its component, and tokens with one terminal are a group.
"""

from __future__ import annotations

import hashlib
import itertools
import re
from collections.abc import Iterator

import numpy as np
import pyarrow as pa
import pyarrow.compute as pc
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from strandlab.llm.encoding import SOLID, TextEncoder
from strandlab.llm.shared import as_text, gather, slices
from strandlab.session import cut, fresh_path

#: Bytes of text aligned at once, units that a worker remembers, units encoded at once, bits of a token id, most frequent pairs that every task holds.
CHUNK, REMEMBERED, JOINED, BITS, HELD = 600_000, 200_000, 500, 20, 65_536
SPACE, CUT = "▁", "\0"
SCHEMA = "row long, doc_id long, n_a long, n_b long, n_groups long, n_links long, groups_sha256 string, pairs array<long>, times array<int>"

_READY: dict[tuple[str, str], tuple["ByteTokens", "PieceTokens"]] = {}


def tokenizers(path_a: str, path_b: str) -> tuple["ByteTokens", "PieceTokens"]:
    """The two encoders of a worker process, which keep the units they have met."""
    if (path_a, path_b) not in _READY:
        _READY[path_a, path_b] = ByteTokens(path_a), PieceTokens(path_b)
    return _READY[path_a, path_b]


class _Bytes:
    """Ragged table of the bytes of each token id."""

    def __init__(self, entries: list[bytes]):
        self.size = np.array([len(e) for e in entries], dtype=np.int64)
        self.offsets = np.concatenate([[0], np.cumsum(self.size)])
        self.data = np.frombuffer(b"".join(entries), dtype=np.uint8)

    def joined(self, ids: np.ndarray) -> np.ndarray:
        return gather(self.offsets, self.data, ids.astype(np.int64))[1]


def _spread(kept: np.ndarray, joined: tuple[np.ndarray, np.ndarray], single: list[list[int]]) -> tuple[np.ndarray, np.ndarray]:
    """Offsets and ids of units in their order: those of ``kept`` from (starts, ids) of joined ones, the others from ``single``."""
    starts, flat = joined
    size = np.zeros(len(kept), dtype=np.int64)
    size[kept], size[~kept] = np.diff(starts, append=len(flat)), [len(x) for x in single]
    begin = np.zeros(len(kept), dtype=np.int64)
    begin[kept], begin[~kept] = starts, len(flat) + np.cumsum(size[~kept]) - size[~kept]
    every = np.concatenate([flat, np.fromiter(itertools.chain.from_iterable(single), np.uint32, int(size[~kept].sum()))])
    offsets = np.concatenate([[0], np.cumsum(size)])
    return offsets, every[np.arange(offsets[-1]) + np.repeat(begin - offsets[:-1], size)]


class _JoinedEncoder(TextEncoder):
    """Strings of special tokens are plain text, and new units of a space and a word are encoded many at a time.

    A token with a space in front begins a unit, and no other token of such units has one, so their ids fall apart again.
    """

    def __init__(self, path: str):
        super().__init__(path)
        if self.kind != "byte":
            raise ValueError("the first tokenizer has to be byte-level, without a normalizer or added white space")
        self.tokenizer.encode_special_tokens = True
        self.special = []
        names = self.tokenizer.get_vocab()
        self.opens = np.zeros(max(names.values()) + 1, dtype=bool)
        self.opens[[i for n, i in names.items() if n.startswith("\u0120")]] = True  # the letter that stands for a space

    def _learn(self, units: pa.Array) -> tuple[np.ndarray, np.ndarray]:
        kept = np.asarray(pc.match_substring_regex(units, rf"^ {SOLID}+$"))
        words = pc.filter(units, pa.array(kept)).to_pylist()
        found = self.tokenizer.encode_batch_fast(["".join(words[i : i + JOINED]) for i in range(0, len(words), JOINED)], add_special_tokens=False) if words else []
        flat = np.concatenate([np.zeros(0, np.uint32), *(np.array(e.ids, dtype=np.uint32) for e in found)])
        starts = np.flatnonzero(self.opens[flat])
        if len(starts) != len(words):
            return self._whole(units.to_pylist())
        rest = pc.filter(units, pa.array(~kept)).to_pylist()
        single = [e.ids for e in self.tokenizer.encode_batch_fast(rest, add_special_tokens=False)] if rest else []
        return _spread(kept, (starts, flat), single)


class ByteTokens:
    """Byte-level tokens of a text with a space in front; strings of special tokens are plain text."""

    def __init__(self, path: str):
        self.encoder = _JoinedEncoder(path)
        bare = [*range(33, 127), *range(161, 173), *range(174, 256)]  # bytes that stand for themselves; the others follow from 256 on
        letter = {chr(b): b for b in bare} | {chr(256 + i): b for i, b in enumerate(b for b in range(256) if b not in set(bare))}
        names = sorted(self.encoder.tokenizer.get_vocab().items(), key=lambda x: x[1])
        entries = [b""] * (names[-1][1] + 1)
        for name, i in names:
            entries[i] = bytes(letter[c] for c in name) if all(c in letter for c in name) else name.encode()
        self.bytes = _Bytes(entries)

    def encode(self, spaced: pa.Array) -> tuple[np.ndarray, np.ndarray]:
        if len(self.encoder.known) > REMEMBERED:
            self.encoder.forget()
        return self.encoder.encode(spaced)


class PieceTokens:
    """Pieces of a text, as the library gives them; the library puts the space in front.

    Pieces have a space mark at their beginning only and never hold a line feed, so a text with single spaces may be cut before each
    space and line feed: its pieces are those of the parts.  Each distinct part is encoded once.  A text with two spaces
    in a row, a space mark or a NUL of its own is encoded whole, and every text is if the vocabulary is of another kind.
    """

    def __init__(self, path: str):
        import sentencepiece

        self.model = sentencepiece.SentencePieceProcessor(model_file=path)
        names = [self.model.id_to_piece(i) for i in range(self.model.get_piece_size())]
        self.bytes = _Bytes([bytes([int(n[3:5], 16)]) if self.model.is_byte(i) else n.replace(SPACE, " ").encode() for i, n in enumerate(names)])
        self.mark = self.model.piece_to_id(SPACE)
        self.opens = np.array([n.startswith(SPACE) for n in names])
        probe = "a  ﬁ Ⅳ é\n Ａ x\ttab "
        plain = b"".join(self.bytes.data[self.bytes.offsets[i] : self.bytes.offsets[i + 1]].tobytes() for i in self.model.encode(probe)) == f" {probe}".encode()
        self.cuts = plain and names[self.mark] == SPACE and not any(SPACE in n.lstrip(SPACE) or re.search(r"[ \n\0]", n) for n in names)
        self.forget()

    def forget(self) -> None:
        self.known = pa.array([], pa.large_string())
        self.offsets, self.ids = np.zeros(1, dtype=np.int64), np.zeros(0, dtype=np.uint32)

    def _library(self, texts: list[str]) -> list[list[int]]:
        return self.model.encode(texts, num_threads=1) if texts else []

    def _learn(self, parts: pa.Array) -> tuple[np.ndarray, np.ndarray]:
        """Offsets and ids of parts that begin with a space or a line feed.

        The library adds a text's first space.  Parts of a space and a word are encoded many at a time: each begins with the
        one piece that has a space mark.  The added space of a part that begins with a line feed is taken off.
        """
        kept = np.asarray(pc.match_substring_regex(parts, "^ [^ \n]"))
        words = pc.filter(parts, pa.array(kept)).to_pylist()
        found = self._library(["".join(words[i : i + JOINED])[1:] for i in range(0, len(words), JOINED)])
        flat = np.fromiter(itertools.chain.from_iterable(found), np.uint32, sum(map(len, found)))
        starts = np.flatnonzero(self.opens[flat])
        if len(starts) != len(words):
            raise AssertionError("a part has more than one piece with a space mark")
        rest = pc.filter(parts, pa.array(~kept)).to_pylist()
        single = [ids[1:] if n != " " else [self.mark] for n, ids in zip(rest, self._library(rest))]
        return _spread(kept, (starts, flat), single)

    def encode(self, spaced: pa.Array) -> tuple[np.ndarray, np.ndarray]:
        """Offsets and ids of texts, given with the space in front; a text of that space alone has no piece."""
        if len(self.known) > REMEMBERED:
            self.forget()
        whole = np.ones(len(spaced), dtype=bool)
        if self.cuts:
            whole = np.logical_or.reduce([np.asarray(pc.match_substring(spaced, s)) for s in ("  ", SPACE, CUT)])
        whole |= np.asarray(pc.binary_length(spaced)) <= 1
        parts = pc.if_else(pa.array(whole), "", spaced)
        for mark in (" ", "\n"):
            parts = pc.replace_substring(parts, mark, f"{CUT}{mark}")
        lists = pc.split_pattern(parts, CUT)
        begin = np.asarray(lists.offsets, dtype=np.int64)
        coded = pc.dictionary_encode(lists.flatten())
        names, codes = coded.dictionary, np.asarray(coded.indices, dtype=np.int64)
        place = pc.index_in(names, self.known)
        missing = pc.filter(names, pc.and_(pc.is_null(place), pc.not_equal(names, "")))
        if len(missing):
            own, ids = self._learn(missing)
            self.offsets = np.concatenate([self.offsets, self.offsets[-1] + own[1:]])
            self.ids = np.concatenate([self.ids, ids])
            self.known = pa.concat_arrays([self.known, missing])
            place = pc.index_in(names, self.known)
        empty = len(self.known)  # the part before a text's first cut
        at = np.asarray(place.fill_null(empty), dtype=np.int64)
        bounds = np.append(self.offsets, self.offsets[-1])
        cut_at, flat = gather(bounds, self.ids, at[codes])
        offsets = cut_at[begin - begin[0]]
        rows = np.flatnonzero(whole)
        if not len(rows):
            return offsets, flat
        own = self._library([t[1:] for t in spaced.take(pa.array(rows)).to_pylist()])
        size = np.diff(offsets)
        size[rows] = [len(x) for x in own]
        parts, last = [], 0
        for r, ids in zip(rows.tolist(), own):
            parts += [flat[offsets[last] : offsets[r]], np.array(ids, dtype=np.uint32)]
            last = r + 1
        return np.concatenate([[0], np.cumsum(size)]), np.concatenate([*parts, flat[offsets[last] :]])


def terminals(end_a: np.ndarray, end_b: np.ndarray) -> np.ndarray:
    """Terminal of every token (those of a first, then those of b) of two partitions of the same bytes, by their ends."""
    n = len(end_a)
    right = np.searchsorted(end_b, end_a)  # the token of b that holds the last byte
    step = np.concatenate([np.where(end_b[np.minimum(right, len(end_b) - 1)] == end_a, np.arange(n), n + right), np.searchsorted(end_a, end_b)]) if n else np.zeros(0, dtype=np.int64)
    moving = np.flatnonzero(step[step] != step)
    while len(moving):
        step[moving] = step[step[moving]]
        moving = moving[step[step[moving]] != step[moving]]
    return step


def same_bytes(data: np.ndarray, bounds: np.ndarray, table: _Bytes, offsets: np.ndarray, ids: np.ndarray) -> np.ndarray:
    """Which texts (their bytes between ``bounds``) are the joined bytes of their ids."""
    size = table.size[ids]
    total = np.concatenate([[0], np.cumsum(size)])
    same = np.diff(total[offsets]) == np.diff(bounds)
    rows = np.flatnonzero(same)
    _, tokens = gather(offsets, ids, rows)
    at, own = gather(bounds, data, rows)
    wrong = np.concatenate([[0], np.cumsum(table.joined(tokens) != own)])
    same[rows] = wrong[at[1:]] == wrong[at[:-1]]
    return same


def _joined(ids: np.ndarray, starts: np.ndarray) -> pa.Array:
    """Comma-joined decimal ids of each run that begins at ``starts``."""
    lists = pa.ListArray.from_arrays(pa.array(np.append(starts, len(ids)).astype(np.int32)), pa.array(ids).cast(pa.large_string()))
    return pc.binary_join(lists, pa.scalar(",", pa.large_string()))


def align(texts: pa.Array, one: ByteTokens, two: PieceTokens) -> dict[str, list | np.ndarray]:
    """Counts, digest and linked id pairs (with their times) of each text; see ``aligned`` for the columns."""
    texts = as_text(texts)
    blank, none, bar = (pa.scalar(x, pa.large_string()) for x in (" ", "", "|"))
    spaced = as_text(pc.binary_join_element_wise(blank, texts, none))
    bounds = np.concatenate([[0], np.cumsum(np.asarray(pc.binary_length(spaced), dtype=np.int64))])
    data = np.frombuffer(spaced.buffers()[2], dtype=np.uint8)[: bounds[-1]] if bounds[-1] else np.zeros(0, dtype=np.uint8)
    (off_a, ids_a), (off_b, ids_b) = one.encode(spaced), two.encode(spaced)
    kept = same_bytes(data, bounds, one.bytes, off_a, ids_a) & same_bytes(data, bounds, two.bytes, off_b, ids_b)
    rows = np.flatnonzero(kept)
    (off_a, ids_a), (off_b, ids_b) = gather(off_a, ids_a, rows), gather(off_b, ids_b, rows)
    end_a, end_b = np.cumsum(one.bytes.size[ids_a]), np.cumsum(two.bytes.size[ids_b])
    label = terminals(end_a, end_b)
    last = np.flatnonzero(label[: len(end_a)] == np.arange(len(end_a)))  # terminals, one a group
    first_a = np.concatenate([[0], last[:-1] + 1]) if len(last) else last
    first_b = np.flatnonzero(np.diff(label[len(end_a) :], prepend=-1) != 0)
    groups = np.searchsorted(last, off_a)
    named = pc.binary_join_element_wise(_joined(ids_a, first_a), _joined(ids_b, first_b), bar)
    lines = pc.binary_join(pa.ListArray.from_arrays(pa.array(groups.astype(np.int32)), named), pa.scalar(";", pa.large_string())).to_pylist()

    low = np.searchsorted(end_b, end_a - one.bytes.size[ids_a], side="right")  # tokens of b that meet each token of a
    count = np.searchsorted(end_b, end_a) - low + 1
    links = np.concatenate([[0], np.cumsum(count)])
    own_a = np.repeat(np.arange(len(ids_a)), count)
    own_b = np.arange(links[-1]) - np.repeat(links[:-1] - low, count)
    codes = (ids_a[own_a].astype(np.int64) << BITS) | ids_b[own_b].astype(np.int64)
    ends = links[off_a]
    out = {c: np.zeros(len(texts), dtype=np.int64) for c in ("n_a", "n_b", "n_groups", "n_links")}
    for c, bound in (("n_a", off_a), ("n_b", off_b), ("n_groups", groups), ("n_links", ends)):
        out[c][rows] = np.diff(bound)
    digests, pairs, times = [""] * len(texts), [np.zeros(0, dtype=np.int64)] * len(texts), [np.zeros(0, dtype=np.int32)] * len(texts)
    for i, r in enumerate(rows.tolist()):
        digests[r] = hashlib.sha256(lines[i].encode()).hexdigest()
        pairs[r], times[r] = np.unique(codes[ends[i] : ends[i + 1]], return_counts=True)
    return out | {"groups_sha256": digests, "pairs": pairs, "times": times}


def _lists(parts: list[np.ndarray], kind: pa.DataType) -> pa.Array:
    flat = np.concatenate(parts) if parts else np.zeros(0)
    return pa.ListArray.from_arrays(pa.array(np.concatenate([[0], np.cumsum([len(p) for p in parts])]).astype(np.int32)), pa.array(flat).cast(kind))


def aligned(docs: DataFrame, path_a: str, path_b: str) -> DataFrame:
    """(row, doc_id, n_a, n_b, n_groups, n_links, groups_sha256, pairs, times) of every row of ``docs`` (doc_id, text).

    ``row`` numbers the rows, ``pairs`` are the linked id pairs (first id << BITS | second id), ascending, each once, and
    ``times`` the links that hold each.  Null and empty texts, and texts whose tokens do not give back a space and the
    text, have no tokens: zeros, the empty string and empty lists.
    """

    def work(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        one, two = tokenizers(path_a, path_b)
        for batch in batches:
            column = as_text(batch.column("text"))
            for a, b in slices(column, CHUNK):
                got = align(column.slice(a, b - a), one, two)
                columns = [batch.column("row").slice(a, b - a), batch.column("doc_id").slice(a, b - a), *(pa.array(got[c]) for c in ("n_a", "n_b", "n_groups", "n_links"))]
                yield pa.RecordBatch.from_arrays([*columns, pa.array(got["groups_sha256"], pa.string()), _lists(got["pairs"], pa.int64()), _lists(got["times"], pa.int32())], names=[c.split()[0] for c in SCHEMA.split(", ")])

    return docs.select(F.monotonically_increasing_id().alias("row"), F.col("doc_id").cast("long").alias("doc_id"), "text").mapInArrow(work, SCHEMA)


def pair_counts(found: DataFrame) -> DataFrame:
    """(pair, count, best): links of the corpus that hold an id pair, and whether its second id has no pair with more.

    The rows are at most the pairs of the two vocabularies, whatever the corpus; an id meets at most a vocabulary.
    """
    from pyspark.sql.window import Window

    counts = found.select(F.explode(F.arrays_zip("pairs", "times")).alias("x")).groupBy(F.col("x.pairs").alias("pair")).agg(F.sum("x.times").alias("count"))
    most = F.max("count").over(Window.partitionBy(F.col("pair").bitwiseAND(F.lit((1 << BITS) - 1))))
    return counts.select("pair", "count", (F.col("count") == most).alias("best"))


def summed(found: DataFrame, counts: DataFrame, held: int) -> DataFrame:
    """``found`` with ``n_best`` and ``count_sum`` over the ``held`` most frequent pairs, and the other pairs as lists."""
    top = counts.orderBy(F.desc("count"), "pair").limit(held).select("pair", "count", "best").toArrow().sort_by("pair")  # at most ``held`` pairs of the vocabularies
    shared = found.sparkSession.sparkContext.broadcast(tuple(top.column(c).to_numpy() for c in ("pair", "count", "best")))
    plain = [c for c in found.columns if c not in ("pairs", "times")]

    def work(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        pair, count, best = shared.value
        for batch in batches:
            size = np.asarray(batch.column("pairs").value_lengths(), dtype=np.int64)
            row = np.repeat(np.arange(len(size)), size)
            own, times = (np.asarray(batch.column(c).flatten(), dtype=np.int64) for c in ("pairs", "times"))
            at = np.minimum(np.searchsorted(pair, own), max(0, len(pair) - 1))
            hit = pair[at] == own if len(pair) else np.zeros(len(own), dtype=bool)
            sums = [np.zeros(len(size), dtype=np.int64) for _ in range(2)]
            np.add.at(sums[0], row[hit], np.where(best[at[hit]], times[hit], 0))
            np.add.at(sums[1], row[hit], times[hit] * count[at[hit]])
            ends = np.concatenate([[0], np.cumsum(np.bincount(row[~hit], minlength=len(size)))]).astype(np.int32)
            lists = [pa.ListArray.from_arrays(pa.array(ends), pa.array(x)) for x in (own[~hit], times[~hit])]
            yield pa.RecordBatch.from_arrays([*(batch.column(c) for c in plain), *map(pa.array, sums), *lists], names=[*plain, "n_best", "count_sum", "pairs", "times"])

    kinds = ", ".join(f"{c} {kind}" for c, kind in found.dtypes if c in plain)
    return found.mapInArrow(work, f"{kinds}, n_best long, count_sum long, pairs array<long>, times array<long>")


def align_corpus(docs: DataFrame, path_a: str, path_b: str, held: int = HELD) -> DataFrame:
    """One row per row of ``docs`` (doc_id, text): the numbers of tokens, groups and links of its alignment, the links whose
    pair is the most frequent one of its second id (``n_best``, ties included), the sum of its links' corpus counts
    (``count_sum``), and the digest of its groups.

    A null ``doc_id`` is kept, repeated rows count each, other columns are not read, and an empty table gives no row.
    The ``held`` most frequent pairs, which are nearly all links of a text, are summed where the text is; a text's other pairs
    meet their counts by a join on the pair.
    """
    path = fresh_path(docs.sparkSession, "alignment")
    aligned(docs, path_a, path_b).write.option("compression", "zstd").parquet(path)
    found = docs.sparkSession.read.parquet(path)
    counts = cut(pair_counts(found))
    part = cut(summed(found, counts, held))
    rare = part.select("row", F.explode(F.arrays_zip("pairs", "times")).alias("x")).select("row", F.col("x.pairs").alias("pair"), F.col("x.times").alias("times")).join(counts, "pair")
    sums = rare.groupBy("row").agg(F.sum(F.when(F.col("best"), F.col("times")).otherwise(0)).alias("_best"), F.sum(F.col("times") * F.col("count")).alias("_sum"))
    zero = F.lit(0).cast("long")
    more = {"n_best": F.col("n_best") + F.coalesce("_best", zero), "count_sum": F.col("count_sum") + F.coalesce("_sum", zero)}
    return part.join(sums, "row", "left").withColumns(more).select("doc_id", "n_a", "n_b", "n_groups", "n_links", "n_best", "count_sum", "groups_sha256")
