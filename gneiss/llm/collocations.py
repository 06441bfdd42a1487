"""Operator 13, phrase collocations: contiguous patterns grown to the right from frequent prefixes, PrefixSpan style.

Texts are cut into pieces, pieces into words; a phrase is a run of words inside a piece, and everything is per language.

1. Words are counted, with sums in each batch first. That gives the size of each one-word prefix's projection.
2. An occurrence pointer of a prefix is its first word's place; what a task needs of it is the words that follow, so a
   pointer travels as its own word and the next ones up to the longest phrase. Equal pointers of a batch travel once, with
   their number. All pointers of a prefix meet in one task, which holds many prefixes and grows each depth first: the
   pointers are sorted, so a prefix's projection is a slice; it is cut by the next word, and each slice that is frequent is
   a phrase and is grown in turn. A slice that isn't frequent has no frequent extension and is left.
3. A prefix with over `split` pointers would fill its task. It is dealt out by its extensions instead, and these again, up
   to the longest phrase, whose pointers are all equal and so few after the batch's sums. A long prefix can only be so
   large if all its words are, so these prefixes are counted over the words already known as large.
4. Phrases are joined with the counts of their parts, scored in decimals, thinned against longer ones and ranked.

Words are compared by 64-bit hashes, held beside their texts. Defined results: null languages are `und`; null and empty
texts have no words; repeated rows count each; ids aren't looked at. Ties of score and count go to the phrase that is less
in UTF-8 bytes.
"""

from __future__ import annotations

import zlib
from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame, SparkSession, Window
from pyspark.sql import functions as F

from . import textkit as tk
from .common import small_batches, stage, table

LONGEST, LEAST, TOP, WITHIN = 3, 10, 2000, 50
#: Bytes that end a piece, and those between words.
BREAKS = np.zeros(256, dtype=bool)
BREAKS[[*b".,;:!?", 10, 11, 12, 13]] = True
BETWEEN = BREAKS.copy()
BETWEEN[[9, 32]] = True
#: Bytes of text that a batch's sums are made over.
BATCH = 1 << 23
#: Whole millionths of a*a/(l*r), in decimals: exact while counts have 15 digits or less.
_PAIR = "cast(cast({0} as decimal(15,0)) * cast({1} as decimal(15,0)) as decimal(30,0))"
SCORE = f"cast(1000000 as decimal(7,0)) * {_PAIR.format('a', 'a')} div {_PAIR.format('l', 'r')}"
#: Pointers of one task, about.
POINTERS = 1 << 20


def _words(c: tk.Chunk, codes: np.ndarray) -> tuple[np.ndarray, np.ndarray, np.ndarray, np.ndarray, np.ndarray]:
    """Starts, ends, hashes and language codes of a chunk's words, and whether the next word is in the same piece."""
    starts, ends, firsts = tk.words(c, BETWEEN)
    hashes = np.maximum(tk.word_hashes(c, starts, ends, lower=True), 1)
    breaks = np.cumsum(BREAKS[c.data], dtype=np.int64)
    follows = np.zeros(len(starts), dtype=bool)
    if len(starts):
        follows[:-1] = breaks[starts[1:]] == breaks[ends[:-1] - 1]
        last = firsts[1:][np.diff(firsts) > 0] - 1
        follows[last] = False
    return starts, ends, hashes, np.repeat(codes[c.lo : c.hi], np.diff(firsts)), follows


def _spoken(batch: pa.RecordBatch) -> tuple[list[str], np.ndarray]:
    coded = batch["lang"].dictionary_encode()
    return coded.dictionary.to_pylist(), coded.indices.to_numpy(zero_copy_only=False)


def _counted(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    for batch in batches:
        langs, codes = _spoken(batch)
        for c in tk.chunks(batch["text"], BATCH):
            starts, ends, hashes, spoken, _ = _words(c, codes)
            low = tk.LOWER[c.data].tobytes()
            for code, lang in enumerate(langs):
                own = np.flatnonzero(spoken == code)
                ids, at, times = np.unique(hashes[own], return_index=True, return_counts=True)
                texts = [low[a:b] for a, b in zip(starts[own[at]].tolist(), ends[own[at]].tolist(), strict=True)]
                yield pa.RecordBatch.from_arrays([pa.array([lang] * len(ids), type=pa.string()), pa.array(ids.view(np.int64)), pa.array(texts, type=pa.binary()).cast(pa.string()), pa.array(times)], names=["lang", "id", "word", "times"])


def _key(ids: list[np.ndarray]) -> np.ndarray:
    """A hash of a phrase by those of its words."""
    out = np.zeros(len(ids[0]), dtype=tk.U)
    for x in ids:
        out = tk.mix((out + x) * tk.U(tk.BASE_A) + tk.U(1))
    return out


def _runs(hashes: np.ndarray, follows: np.ndarray, longest: int) -> list[np.ndarray]:
    """For each word, itself and the next ones of its piece, 0 behind the piece."""
    out, inside = [hashes], follows
    for k in range(1, longest):
        following = np.zeros(len(hashes), dtype=tk.U)
        following[: len(hashes) - k] = hashes[k:] * inside[: len(hashes) - k]
        out.append(following)
        inside = inside & np.concatenate([follows[k:], np.zeros(min(k, len(follows)), dtype=bool)])
    return out


#: By language and length: the large prefixes (signed ids of words) with their counts.
Large = dict[str, list[dict[tuple[int, ...], int]]]


def _keys(large: Large) -> dict[str, list[np.ndarray]]:
    """By language and length, the hashes of the large prefixes."""
    return {lang: [_key(list(np.array(list(some), dtype=np.int64).reshape(len(some), -1).T.view(tk.U))) for some in by] for lang, by in large.items()}


def _large(found: dict[str, list[np.ndarray]], lang: str, ids: list[np.ndarray]) -> np.ndarray:
    """Whether the phrases of these words are among the large prefixes of their length."""
    have = found.get(lang, [])
    return np.isin(_key(ids), have[len(ids) - 1]) if len(have) >= len(ids) else np.zeros(len(ids[0]), dtype=bool)


def _extensions(length: int, large: Large):
    """Counts of phrases of `length` words whose first and last length - 1 words are both large prefixes."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        found = _keys(large)
        for batch in batches:
            langs, codes = _spoken(batch)
            for c in tk.chunks(batch["text"], BATCH):
                _, _, hashes, spoken, follows = _words(c, codes)
                runs = _runs(hashes, follows, length)
                for code, lang in enumerate(langs):
                    own = [x[(spoken == code) & (runs[-1] != 0)] for x in runs]
                    both = _large(found, lang, own[:-1]) & _large(found, lang, own[1:])
                    _, at, times = np.unique(_key(own)[both], return_index=True, return_counts=True)
                    flat = np.stack([x[both][at] for x in own], axis=1).view(np.int64).ravel()
                    yield pa.RecordBatch.from_arrays([pa.array([lang] * len(at), type=pa.string()), tk.list_array(flat, np.arange(len(at) + 1) * length, pa.int64()), pa.array(times)], names=["lang", "ids", "times"])

    return run


def _projected(longest: int, buckets: int, large: Large):
    """A row for each batch, language and bucket: the pointers of the bucket's prefixes, packed in columns."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        large_keys = _keys(large)
        for batch in batches:
            langs, codes = _spoken(batch)
            for c in tk.chunks(batch["text"], BATCH):
                _, _, hashes, spoken, follows = _words(c, codes)
                runs = _runs(hashes, follows, longest)
                rows: list[tuple] = []
                for code, lang in enumerate(langs):
                    here = np.flatnonzero((spoken == code) & follows)
                    if not len(here):
                        continue
                    own = [x[here] for x in runs]
                    where = _key(own[:1])
                    split = np.ones(len(here), dtype=bool)
                    for k in range(1, longest):
                        split &= _large(large_keys, lang, own[:k])
                        where[split] = _key([x[split] for x in own[: k + 1]])
                    where = (tk.mix(where ^ tk.U(zlib.crc32(lang.encode()))) % tk.U(buckets)).astype(np.int64)
                    order = np.lexsort((*own[::-1], where))
                    own, where = [x[order] for x in own], where[order]
                    new = np.ones(len(order), dtype=bool)
                    new[1:] = (where[1:] != where[:-1]) | np.any([x[1:] != x[:-1] for x in own], axis=0)
                    at = np.flatnonzero(new)
                    own, where, times = [x[at] for x in own], where[at], np.diff(np.concatenate([at, [len(order)]])).astype(np.int64)
                    edge = np.flatnonzero(np.concatenate([[True], where[1:] != where[:-1], [True]]))
                    rows += [(lang, int(where[a]), np.concatenate([x[a:b] for x in own]).tobytes(), times[a:b].tobytes()) for a, b in zip(edge[:-1], edge[1:], strict=True)]
                yield pa.RecordBatch.from_arrays([pa.array([r[i] for r in rows], type=t) for i, t in enumerate((pa.string(), pa.int64(), pa.binary(), pa.binary()))], names=["lang", "bucket", "pointers", "times"])

    return run


def grow(ids: list[np.ndarray], times: np.ndarray, least: int) -> Iterator[tuple[tuple[int, ...], int]]:
    """All phrases of two words or more that occur at least `least` times, with that number, depth first. ids: the words of
    each pointer, first words first, sorted; times: how often each pointer occurs."""

    def extend(prefix: tuple[int, ...], lo: int, hi: int) -> Iterator[tuple[tuple[int, ...], int]]:
        following = ids[len(prefix)][lo:hi]
        cuts = np.concatenate([[0], np.flatnonzero(following[1:] != following[:-1]) + 1])
        sums = np.add.reduceat(times[lo:hi], cuts)
        stops = np.concatenate([cuts[1:], [hi - lo]])
        for k in np.flatnonzero((sums >= least) & (following[cuts] != 0)).tolist():
            longer = (*prefix, int(following[cuts[k]]))
            if prefix:
                yield longer, int(sums[k])
            if len(longer) < len(ids):
                yield from extend(longer, lo + int(cuts[k]), lo + int(stops[k]))

    if len(times):
        yield from extend((), 0, len(times))


def _grown(longest: int, least: int, large: Large):
    """Phrases of a bucket; not the large prefixes, of which other buckets hold parts and whose counts are known."""

    def run(key: tuple, part: pa.Table) -> pa.Table:
        blocks = [np.frombuffer(x, dtype=np.int64).reshape(longest, -1) for x in part["pointers"].to_pylist()]
        own = np.concatenate(blocks, axis=1)
        times = np.concatenate([np.frombuffer(x, dtype=np.int64) for x in part["times"].to_pylist()])
        order = np.lexsort(own[::-1])
        known = set().union(*large.get(key[0].as_py(), []))
        found = [(ids, a) for ids, a in grow([x[order] for x in own], times[order], least) if ids not in known]
        return pa.table([pa.array([key[0].as_py()] * len(found), type=pa.string()), pa.array([list(p) for p, _ in found], type=pa.list_(pa.int64())), pa.array([a for _, a in found], type=pa.int64())], names=["lang", "ids", "a"])

    return run


def frequent(docs: DataFrame, longest: int = LONGEST, least: int = LEAST, split: int | None = None) -> tuple[DataFrame, DataFrame]:
    """(phrases, words). phrases: lang, ids, a for each phrase of 2 to `longest` words with at least `least` occurrences;
    words: lang, id, word, times for every word. split: pointers above which a prefix is dealt out by its extensions; by
    default a thousandth of all words, 16,384 at least and a million at most, but a hundred-thousandth at least, so that no
    length has more than 100,000 such prefixes, whose ids are what the driver and the tasks hold of them."""
    small_batches(docs.sparkSession)
    docs = docs.select(F.coalesce("lang", F.lit("und")).alias("lang"), "text")
    words = stage(docs.mapInArrow(_counted, "lang string, id bigint, word string, times bigint").groupBy("lang", "id", "word").agg(F.sum("times").alias("times")), "op13-words")
    total = words.agg(F.sum("times")).first()[0] or 0
    split = split or max(1 << 14, min(1 << 20, total // 1000), total // 100_000)
    large: Large = {}

    def note(rows: DataFrame) -> bool:
        by: dict[str, dict[tuple[int, ...], int]] = {}
        for lang, ids, times in rows.groupBy("lang", "ids").agg(F.sum("times").alias("times")).where(F.col("times") > split).collect():
            by.setdefault(lang, {})[tuple(ids)] = times
        for lang, some in by.items():
            large.setdefault(lang, []).append(some)
        return bool(by)

    length = 1
    more = note(words.select("lang", F.array("id").alias("ids"), "times"))
    while more and length < longest - 1:
        length += 1
        more = note(docs.mapInArrow(_extensions(length, large), "lang string, ids array<bigint>, times bigint"))
    spark = docs.sparkSession
    buckets = max(1, int(spark.conf.get("spark.sql.shuffle.partitions")), -(-total // POINTERS))
    pointers = docs.mapInArrow(_projected(longest, buckets, large), "lang string, bucket bigint, pointers binary, times binary")
    schema = "lang string, ids array<bigint>, a bigint"
    phrases = pointers.groupBy("lang", "bucket").applyInArrow(_grown(longest, least, large), schema)
    known = [(lang, list(ids), times) for lang, by in large.items() for some in by[1:] for ids, times in some.items() if times >= least]
    phrases = phrases.unionByName(spark.createDataFrame(known, schema)) if known else phrases
    return stage(phrases, "op13-phrases"), words


def collocations(docs: DataFrame, longest: int = LONGEST, least: int = LEAST, top: int = TOP, within: int = WITHIN, split: int | None = None) -> DataFrame:
    """Each language's first `top` phrases: lang, rank, phrase, a, l, r, n, score (whole millionths of a*a/(l*r) at the cut
    where that is least). A phrase goes if a longer one that holds it has at least `within` hundredths of its occurrences."""
    phrases, words = frequent(docs, longest, least, split)
    singles = words.where(F.col("times") >= least).select("lang", F.array("id").alias("ids"), F.col("times").alias("f"))
    counts = phrases.withColumnRenamed("a", "f").unionByName(singles)
    part = lambda start, length: F.slice("ids", start, length)
    cuts = phrases.select("lang", "ids", "a", F.explode(F.sequence(F.lit(1), F.size("ids") - 1)).alias("k")).select("lang", "ids", "a", "k", part(F.lit(1), F.col("k")).alias("left"), part(F.col("k") + 1, F.size("ids") - F.col("k")).alias("right"))
    cuts = cuts.join(counts.select("lang", F.col("ids").alias("left"), F.col("f").alias("l")), ["lang", "left"])
    cuts = cuts.join(counts.select("lang", F.col("ids").alias("right"), F.col("f").alias("r")), ["lang", "right"])
    scored = cuts.withColumn("score", F.expr(SCORE)).groupBy("lang", "ids", "a").agg(F.min(F.struct("score", "k", "l", "r")).alias("cut")).select("lang", "ids", "a", "cut.score", "cut.l", "cut.r")
    inner = phrases.where(F.size("ids") > 2).select("lang", "a", "ids", F.explode(F.sequence(F.lit(2), F.size("ids") - 1)).alias("m"))
    inner = inner.select("lang", "a", "ids", "m", F.explode(F.sequence(F.lit(1), F.size("ids") - F.col("m") + 1)).alias("at")).select("lang", F.col("a").alias("longer"), part(F.col("at"), F.col("m")).alias("ids"))
    held = inner.groupBy("lang", "ids").agg(F.max("longer").alias("longer"))
    left = scored.join(held, ["lang", "ids"], "left").where(F.col("longer").isNull() | (100 * F.col("longer") < within * F.col("a"))).drop("longer")
    # the first ones and all that tie with the last of them; their texts decide
    best = Window.partitionBy("lang").orderBy(F.desc("score"), F.desc("a"))
    first = left.withColumn("place", F.rank().over(best)).where(F.col("place") <= top).drop("place")
    texts = first.select("lang", "ids", F.posexplode("ids").alias("at", "id")).join(words.select("lang", "id", "word"), ["lang", "id"])
    texts = texts.groupBy("lang", "ids").agg(F.array_join(F.transform(F.sort_array(F.collect_list(F.struct("at", "word"))), lambda x: x["word"]), " ").alias("phrase"))
    n = words.groupBy("lang").agg(F.sum("times").alias("n"))
    order = Window.partitionBy("lang").orderBy(F.desc("score"), F.desc("a"), "phrase")
    ranked = first.join(texts, ["lang", "ids"]).withColumn("rank", F.row_number().over(order).cast("long")).where(F.col("rank") <= top)
    return ranked.join(n, "lang").select("lang", "rank", "phrase", "a", "l", "r", "n", "score")


def op13_collocations(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Each language's first 2000 phrases of two or three words: lang (null: und), rank, phrase, a, l, r, n, score."""
    return collocations(table(spark, sf_dir, "documents"))


#: For small fixtures: it took over a minute on 1,000 documents, so it isn't registered.
ORACLE = r"""
WITH p AS (SELECT coalesce(lang, 'und') AS lang, unnest(string_split_regex(translate(coalesce(text, ''), 'ABCDEFGHIJKLMNOPQRSTUVWXYZ', 'abcdefghijklmnopqrstuvwxyz'), '[.,;:!?\x0A-\x0D]')) AS piece FROM documents),
w AS (SELECT lang, list_filter(string_split_regex(piece, '[\x20\x09]+'), lambda x: x <> '') AS w FROM p),
o AS (SELECT lang, w, unnest(range(1, len(w) + 1)) AS i FROM w),
g AS (SELECT lang, w[i:i + k - 1] AS g, count(*) AS f FROM o, (VALUES (1), (2), (3)) AS s(k) WHERE i + k - 1 <= len(w) GROUP BY 1, 2),
c AS (SELECT lang, g, f AS a FROM g WHERE f >= 10 AND len(g) >= 2),
u AS (SELECT c.lang, c.g, c.a, k, x.f AS l, y.f AS r, (1000000::HUGEINT * c.a * c.a) // (x.f::HUGEINT * y.f) AS score
  FROM c JOIN (VALUES (1), (2)) AS s(k) ON k < len(c.g) JOIN g x ON x.lang = c.lang AND x.g = c.g[1:k] JOIN g y ON y.lang = c.lang AND y.g = c.g[k + 1:len(c.g)]),
b AS (SELECT * FROM u QUALIFY row_number() OVER (PARTITION BY lang, g ORDER BY score, k) = 1),
h AS (SELECT lang, s AS g, max(a) AS longer FROM (SELECT lang, a, unnest([g[1:2], g[2:3]]) AS s FROM c WHERE len(g) = 3) GROUP BY 1, 2),
z AS (SELECT b.*, array_to_string(b.g, ' ') AS phrase FROM b LEFT JOIN h ON h.lang = b.lang AND h.g = b.g WHERE len(b.g) = 3 OR h.longer IS NULL OR 100 * h.longer < 50 * b.a),
n AS (SELECT lang, sum(f)::BIGINT AS n FROM g WHERE len(g) = 1 GROUP BY 1),
t AS (SELECT lang, row_number() OVER (PARTITION BY lang ORDER BY score DESC, a DESC, phrase) AS rank, phrase, a, l, r, score::BIGINT AS score FROM z)
SELECT t.lang, t.rank, t.phrase, t.a, t.l, t.r, n.n, t.score FROM t JOIN n ON n.lang = t.lang WHERE t.rank <= 2000
"""
