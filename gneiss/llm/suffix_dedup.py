"""Operator 12, suffix-array dedup of bytes: a Burrows-Wheeler transform of many pieces, built column by column.

Every string of `window` bytes that starts in a document with a smaller id goes. The collection is dealt out so that equal
strings meet: each window holds the smallest of its `gram`-byte hashes, its anchor, and a maximal run of windows on one
anchor is a piece (at most `2 * window - gram` bytes; longer ones, in periodic texts, are cut). Equal texts are one, whose
other copies go whole. Only anchors that two texts hold matter. Equal pieces of a bucket are one, with the least and the
greatest document that hold it; one that is alone on its anchor has no other piece to be ordered among.

In each bucket (`Columns`) the collection's transform and its longest common prefixes are built from the pieces' ends: a
round puts one symbol of every piece that has one left. The last round's suffixes stand in the transform at known places;
counting the symbols before them gives the places of the suffixes that are longer by one, and the least common prefix
between two neighbours with one symbol gives that of the new neighbours, plus one. Transform and prefixes lie in files in
the order of their first symbol, read and written from front to back once a round, so memory holds one block of them. In the
end stretches with common prefixes of `window` or more are the strings that repeat; following the transform from each
piece's end says which windows stand there, and the least document of a stretch is the first that holds the string.

These files are scratch of one task, like what a sort spills: nobody else reads them, they go with the task, and a task that
is run again writes its own.

Skew. An anchor that documents of a batch share is known there and travels once; its pairs are dealt by document. An anchor
with very many different pieces (text around a passage that many documents hold) would fill a bucket: its pieces are cut
into single windows, summed by their bytes and dealt by those. Joins with pieces and documents are left to adaptive
splitting. Disk: pieces are a few times the text that repeats.

Defined results: doc_id is an integer. Null and empty texts, and those of under `window` bytes, lose nothing. Rows that share
a doc_id take nothing from each other; equal rows all appear. A null doc_id neither loses bytes nor takes them.
"""

from __future__ import annotations

import io
import os
import tempfile
from collections.abc import Iterator

import numpy as np
import pyarrow as pa
import pyarrow.compute as pc
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from . import textkit as tk
from .common import small_batches, stage, table

WINDOW, GRAM = 50, 25
#: Pieces of a bucket, about; an anchor with a thousandth of all pieces and at least HOT is cut into windows.
PIECES, HOT = 300_000, 10_000
CHUNK = 1 << 22
SPAN = "struct<at:int,n:int,first:bigint>"
#: Bytes kept of an anchor while shared ones are sought: two that agree in these and in their bucket count as one, which costs a comparison.
KEPT = 6


def _runs(c: tk.Chunk, window: int, gram: int) -> tuple[np.ndarray, np.ndarray, np.ndarray, np.ndarray]:
    """Runs of windows on one anchor: first window, number of windows, anchor, document (number in the chunk)."""
    low = tk.windows_hash(tk._bytes_table(1)[c.data], gram, tk.BASE_A)
    none = np.zeros(0, dtype=np.int64)
    if len(c.data) < window:
        return none, none, low[:0], none
    low = tk.sliding_min(low, window - gram + 1)
    ok = tk.inside(window, c.offs, len(c.data))
    new, end = ok.copy(), ok.copy()
    new[1:] &= (low[1:] != low[:-1]) | ~ok[:-1]
    end[:-1] &= (low[1:] != low[:-1]) | ~ok[1:]
    at = np.flatnonzero(new)
    return at, np.flatnonzero(end) + 1 - at, low[at], np.searchsorted(c.offs, at, side="right") - 1


def _ids(batch: pa.RecordBatch, c: tk.Chunk, name: str = "doc_id") -> np.ndarray:
    return batch[name].slice(c.lo, c.hi - c.lo).to_numpy(zero_copy_only=False).astype(np.int64)


def _posts(window: int, gram: int, buckets: int):
    """Anchors of a batch by bucket, packed: those of one text with its mark; those of more once; and, dealt by mark, the
    pairs of the latter."""

    def pack(kind: int, where: np.ndarray, ids: np.ndarray, anchors: np.ndarray, rows: list[tuple]) -> None:
        order = np.lexsort((ids, where))
        where, ids, anchors = where[order], ids[order], anchors[order]
        edge = np.flatnonzero(np.concatenate([[True], where[1:] != where[:-1], [True]])) if len(where) else []
        for a, b in zip(edge[:-1], edge[1:], strict=True):
            docs, times = np.unique(ids[a:b], return_counts=True)
            rows.append((kind, int(where[a]), anchors[a:b].view(np.uint8).reshape(-1, 8)[:, :KEPT].tobytes(), docs.tobytes(), times.astype(np.int32).tobytes()))

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            for c in tk.chunks(batch["text"], CHUNK):
                _, _, anchors, own = _runs(c, window, gram)
                ids = _ids(batch, c, "mark")[own]
                order = np.lexsort((ids, anchors))
                anchors, ids = anchors[order], ids[order]
                new = np.ones(len(ids), dtype=bool)
                new[1:] = (anchors[1:] != anchors[:-1]) | (ids[1:] != ids[:-1])
                anchors, ids = anchors[new], ids[new]
                head = np.flatnonzero(np.concatenate([[True], anchors[1:] != anchors[:-1]])) if len(ids) else np.zeros(0, dtype=np.int64)
                times = np.diff(np.concatenate([head, [len(ids)]]))
                many = np.repeat(times > 1, times)
                rows: list[tuple] = []
                by = lambda x: (tk.mix(x) % tk.U(buckets)).astype(np.int64)
                pack(0, by(anchors[~many]), ids[~many], anchors[~many], rows)
                pack(1, by(anchors[head[times > 1]]), ids[head[times > 1]], anchors[head[times > 1]], rows)
                pack(2, by(ids[many].view(tk.U)), ids[many], anchors[many], rows)
                yield pa.RecordBatch.from_arrays([pa.array([r[i] for r in rows], type=t) for i, t in enumerate((pa.int32(), pa.int64(), pa.binary(), pa.binary(), pa.binary()))], names=["kind", "bucket", "anchors", "ids", "times"])

    return run


def _shared(part: pa.Table) -> pa.Table:
    """A text's mark and the low bytes of its anchors that another text holds too, for one bucket."""
    kind, keys, ids = [], [], []
    for k, a, d, t in zip(*(part[x].to_pylist() for x in ("kind", "anchors", "ids", "times")), strict=True):
        own = np.frombuffer(a, dtype=np.uint8).reshape(-1, KEPT)
        whole = np.zeros((len(own), 8), dtype=np.uint8)
        whole[:, :KEPT] = own
        keys.append(whole.view(np.int64).ravel())
        ids.append(np.repeat(np.frombuffer(d, dtype=np.int64), np.frombuffer(t, dtype=np.int32)))
        kind.append(np.full(len(own), k, dtype=np.int8))
    kind, keys, ids = np.concatenate(kind), np.concatenate(keys), np.concatenate(ids)
    pairs, kind, keys, ids = (keys[kind == 2], ids[kind == 2]), kind[kind < 2], keys[kind < 2], ids[kind < 2]
    order = np.argsort(keys, kind="stable")
    kind, keys, ids = kind[order], keys[order], ids[order]
    if len(keys):
        head = np.flatnonzero(np.concatenate([[True], keys[1:] != keys[:-1]]))
        some = (np.minimum.reduceat(ids, head) < np.maximum.reduceat(ids, head)) | (np.maximum.reduceat(kind, head) == 1)
        keep = np.repeat(some, np.diff(np.concatenate([head, [len(keys)]]))) & (kind == 0)
        keys, ids = keys[keep], ids[keep]
    return pa.table({"mark": np.concatenate([pairs[1], ids]), "anchor": np.concatenate([pairs[0], keys])})


def _low(anchors: np.ndarray) -> np.ndarray:
    return anchors & tk.U((1 << 8 * KEPT) - 1)


def _pieces(window: int, gram: int):
    """A row for each piece on an anchor of `seeds`: doc_id, mark, pos, anchor, key; the first of equal ones in a batch has
    the bytes and the least and greatest document that hold them."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        most = window - gram + 1
        for batch in batches:
            seeds = batch["seeds"]
            for c in tk.chunks(batch["text"], CHUNK):
                at, n, anchors, own = _runs(c, window, gram)
                lists = seeds.slice(c.lo, c.hi - c.lo)
                sought = lists.flatten().to_numpy(zero_copy_only=False).view(tk.U)
                of = np.repeat(np.arange(c.hi - c.lo), lists.value_lengths().to_numpy(zero_copy_only=False))
                pair = lambda key, doc: tk.mix(key + tk.mix(doc.astype(tk.U) + tk.U(1)))
                hit = np.isin(pair(_low(anchors), own), pair(_low(sought), of))
                at, n, anchors, own = at[hit], n[hit], anchors[hit], own[hit]
                times = -(-n // most)
                turn = np.arange(int(times.sum())) - np.repeat(np.cumsum(times) - times, times)
                at, n, anchors, own = (np.repeat(x, times) for x in (at, n, anchors, own))
                at, n = at + most * turn, np.minimum(most, n - most * turn)
                end = at + n + window - 1
                ids = _ids(batch, c)[own]
                keys = tk.spans_hash(tk._bytes_table(2)[c.data], at, end, tk.BASE_B)
                order = np.lexsort((keys, anchors))
                head = np.flatnonzero(np.concatenate([[True], (keys[order][1:] != keys[order][:-1]) | (anchors[order][1:] != anchors[order][:-1])])) if len(at) else np.zeros(0, dtype=np.int64)
                least, greatest = np.zeros(len(at), dtype=np.int64), np.zeros(len(at), dtype=np.int64)
                first = order[head]
                if len(head):
                    least[first], greatest[first] = np.minimum.reduceat(ids[order], head), np.maximum.reduceat(ids[order], head)
                data, texts = c.data.tobytes(), [None] * len(at)
                for i, a, b in zip(first.tolist(), at[first].tolist(), end[first].tolist(), strict=True):
                    texts[i] = data[a:b]
                rest = np.ones(len(at), dtype=bool)
                rest[first] = False
                yield pa.RecordBatch.from_arrays(
                    [pa.array(ids), batch["mark"].take(pa.array(own + c.lo)), pa.array((at - c.offs[own]).astype(np.int64)), pa.array(anchors.view(np.int64)), pa.array(keys.view(np.int64)), pa.array(texts, type=pa.binary()), pa.array(least, mask=rest), pa.array(greatest, mask=rest)],
                    names=["doc_id", "mark", "pos", "anchor", "key", "piece", "least", "most"],
                )

    return run


class Columns:
    """The transform and common prefixes of a collection of pieces, in files of a folder, built column by column.

    Symbols are bytes plus one; 0 stands before a piece's first and for its end, and ends differ from each other. Block s of
    a file holds the suffixes that start with symbol s, block 0 the empty suffixes in the order of the pieces.
    """

    def __init__(self, data: np.ndarray, ends: np.ndarray, sizes: np.ndarray, folder: str):
        """data: the pieces' symbols one after another; ends and sizes: of each piece. No piece is empty or over 254 long."""
        self.data, self.ends, self.sizes, self.folder = data, ends, sizes, folder
        self.blocks = np.zeros(256, dtype=np.int64)
        self.blocks[0] = len(ends)
        self.turn = 0
        self.files = {(what, k): open(os.path.join(folder, f"{what}-{k}"), "w+b", buffering=0) for what in ("symbols", "prefixes") for k in (0, 1)}
        symbols, prefixes = self._from_start()
        symbols.write(data[ends - 1])
        prefixes.write(np.zeros(len(ends), dtype=np.uint8))
        # of the last round's suffixes, in their order: block, place in it, piece
        self.last = np.zeros(len(ends), dtype=np.uint8), np.arange(len(ends)), np.arange(len(ends))
        while len(self.last[0]):
            self._round()

    def _from_start(self, ahead: int = 0) -> list[io.FileIO]:
        """The files of this round, or of the next one, at their start."""
        files = [self.files[what, (self.turn + ahead) % 2] for what in ("symbols", "prefixes")]
        for f in files:
            f.seek(0)
        return files

    @staticmethod
    def _next(file: io.FileIO, n: int) -> np.ndarray:
        block = np.empty(n, dtype=np.uint8)
        view = memoryview(block)
        while len(view):
            view = view[file.readinto(view) :]
        return block

    def close(self) -> None:
        for f in self.files.values():
            f.close()

    def _round(self) -> None:
        block, place, piece = self.last
        edge = np.searchsorted(block, np.arange(257))
        before = np.zeros(256, dtype=np.int64)
        found = []
        symbols, prefixes = self._from_start()
        for s in np.flatnonzero(self.blocks).tolist():
            own, lcp = (self._next(f, int(self.blocks[s])) for f in (symbols, prefixes))
            counts = np.bincount(own, minlength=256)
            if edge[s + 1] > edge[s]:
                found.append(self._extended(own, lcp, counts, before, place[edge[s] : edge[s + 1]], piece[edge[s] : edge[s + 1]]))
            before += counts
        symbol, rank, piece, left, right = (np.concatenate(x) for x in zip(*found, strict=True))
        order = np.argsort(symbol, kind="stable")
        symbol, rank, piece, left, right = (x[order] for x in (symbol, rank, piece, left, right))
        length = self.turn + 1
        ahead = np.where(self.sizes[piece] > length, self.data[np.maximum(self.ends[piece] - length - 1, 0)], 0).astype(np.uint8)
        edge = np.searchsorted(symbol, np.arange(257))
        grown = self.blocks + np.diff(edge)
        (symbols, prefixes), (symbols_out, prefixes_out) = self._from_start(), self._from_start(1)
        for s in np.flatnonzero(grown).tolist():
            n, m = int(self.blocks[s]), int(grown[s])
            own, lcp = self._next(symbols, n), self._next(prefixes, n)
            if m > n:
                put = slice(edge[s], edge[s + 1])
                at, old = rank[put], np.ones(m, dtype=bool)
                old[at] = False
                wide, lows = np.empty(m, dtype=np.uint8), np.empty(m + 1, dtype=np.uint8)
                wide[old], wide[at] = own, ahead[put]
                lows[:m][old] = lcp
                lows[at + 1] = right[put]
                lows[at] = left[put]
                own, lcp = wide, lows[:m]
            symbols_out.write(own)
            prefixes_out.write(lcp)
        self.blocks, self.turn = grown, length
        more = ahead > 0
        self.last = symbol[more], rank[more], piece[more]

    def _extended(self, own: np.ndarray, lcp: np.ndarray, counts: np.ndarray, before: np.ndarray, place: np.ndarray, piece: np.ndarray) -> tuple[np.ndarray, ...]:
        """Of the suffixes at these places of a block, each with the symbol before it: that symbol, the place in its block,
        the piece, and the common prefixes with the neighbours there on the left and on the right."""
        order = np.argsort(own, kind="stable")
        mark = np.full(len(own), -1, dtype=np.int32)
        mark[place] = piece
        mark = mark[order]
        q = np.flatnonzero(mark >= 0)[::-1]  # backwards: the stretches between two queries are then empty
        at, first = order[q], np.cumsum(counts) - counts
        symbol = own[at]
        rank = before[symbol] + q - first[symbol]
        low = np.append(lcp, np.uint8(0))
        left, right = np.minimum(rank, 1).astype(np.uint8), np.ones(len(q), dtype=np.uint8)
        back, on = q > first[symbol], q + 1 < (first + counts)[symbol]
        left[back] = self._least(low, order[q[back] - 1] + 1, at[back] + 1) + 1
        right[on] = self._least(low, at[on] + 1, order[q[on] + 1] + 1) + 1
        return tuple(x[::-1] for x in (symbol, rank, mark[q].astype(np.int64), left, right))

    @staticmethod
    def _least(low: np.ndarray, lo: np.ndarray, hi: np.ndarray) -> np.ndarray:
        return np.minimum.reduceat(low, np.stack([lo, hi], axis=1).ravel())[::2] if len(lo) else low[:0]

    def whole(self) -> tuple[np.ndarray, np.ndarray]:
        """The transform and the common prefixes, all blocks."""
        return tuple(self._next(f, int(self.blocks.sum())) for f in self._from_start())

    def rows(self) -> Iterator[tuple[int, np.ndarray, np.ndarray]]:
        """By length from 1 on: the length, the pieces that have a suffix of it, and the rows of these."""
        order = np.argsort(self.whole()[0], kind="stable")
        to = np.empty(len(order), dtype=np.int32)
        to[order] = np.arange(len(order), dtype=np.int32)
        del order
        piece = row = np.arange(len(self.ends), dtype=np.int32)
        for length in range(1, self.turn + 1):
            more = self.sizes[piece] >= length
            piece, row = piece[more], to[row[more]]
            yield length, piece, row


def first_holders(pieces: list[bytes], least: np.ndarray, window: int) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
    """(piece, at, first) for every window of the pieces: the least document that holds it in any of them."""
    if not pieces:
        return np.zeros(0, dtype=np.int64), np.zeros(0, dtype=np.int32), np.zeros(0, dtype=np.int64)
    sizes = np.array([len(p) for p in pieces], dtype=np.int64)
    data = np.frombuffer(b"".join(pieces), dtype=np.uint8) + np.uint8(1)
    with tempfile.TemporaryDirectory(prefix="gneiss-columns-") as folder:
        columns = Columns(data, np.cumsum(sizes), sizes, folder)
        stretch = np.cumsum(columns.whole()[1] < window, dtype=np.int32)
        low = np.full(int(stretch[-1]) + 1, np.iinfo(np.int64).max)
        found = []
        for length, piece, row in columns.rows():
            if length >= window:
                np.minimum.at(low, stretch[row], least[piece])
                found.append((piece, (sizes[piece] - length).astype(np.int32), stretch[row]))
        columns.close()
    piece, at, stretch = (np.concatenate(x) for x in zip(*found, strict=True))
    order = np.lexsort((at, piece))
    return piece[order], at[order], low[stretch[order]]


def _held(window: int):
    """For each piece of a bucket with windows that a smaller document than its greatest holds: spans of these windows and
    that document."""

    def run(part: pa.Table) -> pa.Table:
        anchor, key, least, most = (part[x].to_numpy() for x in ("anchor", "key", "least", "most"))
        order = np.lexsort((key, anchor))
        anchor, key, least, most = anchor[order], key[order], least[order], most[order]
        head = np.flatnonzero(np.concatenate([[True], (key[1:] != key[:-1]) | (anchor[1:] != anchor[:-1])]))
        anchor, key, least, most = anchor[head], key[head], np.minimum.reduceat(least, head), np.maximum.reduceat(most, head)
        alone = np.ones(len(head), dtype=bool)
        alone[1:] &= anchor[1:] != anchor[:-1]
        alone[:-1] &= anchor[1:] != anchor[:-1]
        some = np.flatnonzero(~alone)
        piece, at, first = first_holders(part["piece"].take(pa.array(order[head[some]])).to_pylist(), least[some], window)
        # a piece alone on its anchor has no other to be ordered among: all its windows are its own
        own = np.flatnonzero(alone & (least < most))
        n = pc.binary_length(part["piece"].take(pa.array(order[head[own]]))).to_numpy() - window + 1
        piece, at, first = np.concatenate([some[piece], np.repeat(own, n)]), np.concatenate([at, np.zeros(int(n.sum()), dtype=np.int32)]), np.concatenate([first, np.repeat(least[own], n)])
        order = np.lexsort((at, piece))
        piece, at, first = piece[order], at[order], first[order]
        new = np.flatnonzero(np.concatenate([[True], (piece[1:] != piece[:-1]) | (first[1:] != first[:-1])]))
        n = np.diff(np.concatenate([new, [len(piece)]]))
        piece, at, first = piece[new], at[new], first[new]
        some = first < most[piece]
        piece, at, first, n = piece[some], at[some], first[some], n[some]
        own, start = np.unique(piece, return_index=True)
        spans = pa.StructArray.from_arrays([pa.array(at.astype(np.int32)), pa.array(n.astype(np.int32)), pa.array(first)], names=["at", "n", "first"])
        return pa.table({"anchor": anchor[own], "key": key[own], "spans": pa.ListArray.from_arrays(pa.array(np.append(start, len(piece)).astype(np.int32)), spans)})

    return run


def _cut(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    for batch in batches:
        ids, kept, removed = batch["doc_id"], [], []
        for text, gone in zip(batch["text"], batch["gone"], strict=True):
            data = (text.as_py() or "").encode()
            if gone.as_py() is None:
                kept.append(data)
                removed.append([])
                continue
            marks = np.zeros(len(data) + 1, dtype=np.int32)
            ends = gone.values.flatten()
            np.add.at(marks, ends[0].to_numpy(), 1)
            np.add.at(marks, ends[1].to_numpy(), -1)
            lost = np.cumsum(marks[:-1]) > 0
            kept.append(np.frombuffer(data, dtype=np.uint8)[~lost].tobytes())
            edge = np.flatnonzero(np.diff(np.concatenate([[0], lost.view(np.int8), [0]])))
            removed.append([{"start": int(a), "end": int(b)} for a, b in edge.reshape(-1, 2)])
        yield pa.RecordBatch.from_arrays([ids, pa.array(kept, type=pa.binary()), pa.array(removed, type=pa.list_(pa.struct([("start", pa.int64()), ("end", pa.int64())])))], names=["doc_id", "kept", "removed"])


def _windows(pieces: DataFrame, window: int) -> DataFrame:
    """The windows of pieces, each as a piece of its own, with the piece and the place it comes from."""
    at = F.explode(F.sequence(F.lit(0), F.octet_length("piece") - window)).alias("at")
    cut = pieces.select(F.col("anchor").alias("of"), F.col("key").alias("of_key"), "piece", "least", "most", at)
    cut = cut.withColumn("piece", F.substring("piece", F.col("at") + 1, F.lit(window)))
    return cut.select("of", "of_key", "at", F.xxhash64("piece").alias("anchor"), F.xxhash64("piece", F.lit(1)).alias("key"), "piece", "least", "most")


def dedup_bytes(docs: DataFrame, window: int = WINDOW, gram: int = GRAM, pieces: int = PIECES, hot: int = HOT) -> DataFrame:
    """One row a document: doc_id, kept (the remaining bytes) and removed (maximal spans of bytes). See the module for awkward
    rows. gram is under window, and 2 * window - gram is at most 254."""
    if not 0 < gram < window or 2 * window - gram > 254:
        raise ValueError("gram has to be under window, and pieces at most 254 bytes long")
    spark = docs.sparkSession
    small_batches(spark)
    docs = docs.select(F.col("doc_id").cast("long").alias("doc_id"), "text", F.xxhash64("text").alias("mark"), F.xxhash64("text", F.lit(1)).alias("mark2"))
    named = docs.where("doc_id is not null")
    # equal texts, by 128 bits, are one: the first stands for all, the others go whole
    keys = stage(named.select("doc_id", "mark", "mark2", F.octet_length("text").alias("size")), "op12-keys")
    first = keys.groupBy("mark", "mark2").agg(F.min("doc_id").alias("first"))
    buckets = int(spark.conf.get("spark.sql.shuffle.partitions"))
    posts = named.mapInArrow(_posts(window, gram, buckets), "kind int, bucket bigint, anchors binary, ids binary, times binary")
    shared = posts.groupBy("bucket").applyInArrow(_shared, "mark bigint, anchor bigint")
    seeds = shared.groupBy("mark").agg(F.collect_set("anchor").alias("seeds")).join(first, "mark").select(F.col("first").alias("doc_id"), "mark", "mark2", "seeds")
    schema = "doc_id bigint, mark bigint, pos bigint, anchor bigint, key bigint, piece binary, least bigint, most bigint"
    found = stage(named.join(seeds, ["doc_id", "mark", "mark2"]).mapInArrow(_pieces(window, gram), schema), "op12-pieces")
    own = found.where("piece is not null").select("anchor", "key", "piece", "least", "most")
    total = own.count()
    limit = max(hot, total // 1000)
    many = [r[0] for r in own.groupBy("anchor").count().where(F.col("count") > limit).select("anchor").collect()]  # a thousand at most
    holders = lambda some: some.withColumn("bucket", F.pmod("anchor", F.lit(max(1, -(-total // pieces))))).groupBy("bucket").applyInArrow(_held(window), f"anchor bigint, key bigint, spans array<{SPAN}>")
    if many:
        cut = stage(_windows(own.where(F.col("anchor").isin(many)), window), "op12-windows")
        single = cut.groupBy("anchor", "key", "piece").agg(F.min("least").alias("least"), F.max("most").alias("most"))
        spans = stage(holders(own.where(~F.col("anchor").isin(many)).unionByName(single)), "op12-spans")
        whole = cut.select("of", "of_key", "at", "anchor", "key").distinct().join(spans, ["anchor", "key"])
        whole = whole.select(F.col("of").alias("anchor"), F.col("of_key").alias("key"), F.array(F.struct(F.col("at").cast("int").alias("at"), F.lit(1).alias("n"), F.col("spans")[0]["first"].alias("first"))).alias("spans"))
        spans = spans.unionByName(whole)
    else:
        spans = stage(holders(own), "op12-spans")
    hits = found.select("doc_id", "mark", "pos", "anchor", "key").join(spans, ["anchor", "key"])
    hits = hits.select("doc_id", "mark", "pos", F.explode(F.filter("spans", lambda x: x["first"] < F.col("doc_id"))).alias("x"))
    start = F.col("pos") + F.col("x.at")
    gone = hits.groupBy("doc_id", "mark").agg(F.collect_list(F.struct(start.alias("start"), (start + F.col("x.n") + (window - 1)).alias("end"))).alias("gone"))
    whole = keys.join(first, ["mark", "mark2"]).where((F.col("first") < F.col("doc_id")) & (F.col("size") >= window))
    whole = whole.select("doc_id", "mark", F.array(F.struct(F.lit(0).cast("long").alias("start"), F.col("size").cast("long").alias("end"))).alias("gone")).distinct()
    return docs.join(gone.unionByName(whole), ["doc_id", "mark"], "left").select("doc_id", "text", "gone").mapInArrow(_cut, "doc_id bigint, kept binary, removed array<struct<start:bigint,end:bigint>>")


def op12_suffix_dedup(spark: SparkSession, sf_dir: str) -> DataFrame:
    """One row a document: doc_id, n_bytes, n_removed, n_spans, kept_sha256. Null and empty texts have no bytes."""
    out = dedup_bytes(table(spark, sf_dir, "documents"))
    lost = F.aggregate("removed", F.lit(0).cast("long"), lambda n, x: n + x["end"] - x["start"])
    return out.select("doc_id", (F.octet_length("kept") + lost).cast("long").alias("n_bytes"), lost.alias("n_removed"), F.size("removed").cast("long").alias("n_spans"), F.sha2("kept", 256).alias("kept_sha256"))


#: For small fixtures: it takes time with the square of the longest text, so it isn't registered.
ORACLE = r"""
WITH d AS (SELECT row_number() OVER () AS row, doc_id, hex(encode(coalesce(text, ''))) AS h FROM documents),
w AS (SELECT row, doc_id, h, unnest(range(0, length(h) // 2 - 49)) AS i FROM d WHERE doc_id IS NOT NULL),
r AS (SELECT row, doc_id, i, min(doc_id) OVER (PARTITION BY substring(h, 2 * i + 1, 100)) AS m FROM w),
s AS (SELECT row, i, coalesce(i > lag(i) OVER (PARTITION BY row ORDER BY i) + 50, true) AS fresh FROM r WHERE m < doc_id),
t AS (SELECT row, i, sum(fresh::INT) OVER (PARTITION BY row ORDER BY i) AS g FROM s),
u AS (SELECT row, g, min(i) AS a, max(i) + 50 AS b FROM t GROUP BY 1, 2),
v AS (SELECT row, count(*) AS n_spans, sum(b - a) AS n_removed, list(a ORDER BY a) AS a, list(b ORDER BY a) AS b FROM u GROUP BY 1)
SELECT d.doc_id, length(h) // 2 AS n_bytes, coalesce(n_removed, 0)::BIGINT AS n_removed, coalesce(n_spans, 0) AS n_spans,
  sha256(unhex(CASE WHEN v.row IS NULL THEN h ELSE array_to_string(list_transform(range(1, len(a) + 2),
    lambda k: substring(h, 1 + CASE WHEN k = 1 THEN 0 ELSE 2 * b[k - 1] END, CASE WHEN k > len(a) THEN length(h) ELSE 2 * a[k] END - CASE WHEN k = 1 THEN 0 ELSE 2 * b[k - 1] END)), '') END)) AS kept_sha256
FROM d LEFT JOIN v ON v.row = d.row
"""
