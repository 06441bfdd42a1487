"""Operator 7, MinHash near-dedup: an inverted join over signature coordinates.

Each distinct shingle set gets COORDINATES minima. A document is posted under its (coordinate, value) pairs, and two
documents collide once for each pair that they share; `matches` collisions make a candidate. A link of similarity 0.80
has fewer than 17 of 40, and one of 0.85 fewer than 20, with a chance below 1e-6; links of more, far less.

Prefix and skip merging keep the join small without losing candidates. Pairs held by one document only can't collide.
Ordered by how many documents hold them, rarest first, the last `matches` - 1 pairs of a document are skipped: they are
the long posting lists (a passage of many documents), and two documents with `matches` collisions also meet in a
shorter list. Collisions are then counted on the whole signatures, and every candidate is confirmed on full sets.

A posting list never yields all its pairs. What joins its documents comes in three steps, whatever its length:

1. Stars. The documents of a list meet its most common one (that whose pairs are held by most documents): links make
   components, and each document's home is the most common document that it is linked with, or itself.
2. Visits. A link that is still missing joins two components. Among the documents of some list, the shingles are ordered
   by how many hold them, rarest first. Two linked sets share one of the first (1 - t) * n + 1 shingles of the larger and
   (1 - t) / (1 + t) * 2n + 1 of the smaller, and at the first one that they share, at places i and j, what is left on
   either side still suffices: min(n - i, m - j) >= t / (1 + t) * (n + m). Where that holds, the larger one visits, not
   the smaller one, but its home: a thousand copies of one home are one visit.
3. Relatives. A visitor that is not linked with the home p may be linked with one of those that live there. Of a set x,
   D(x) is what it misses of p and what it has outside of it, and w(x) = 2 (missed + t * added) / (1 + t). If x and y
   are linked, |D(x) & D(y)| >= (w(x) + w(y)) / 2 - |p| (1 - t) / (1 + t), and w(y) / 2 > |p| (1 - t) / (1 + t) as y
   isn't linked with p; so more than w(x) / 2 elements of D(x) are in D(y), and x is posted under its rarest
   |D(x)| - floor(w(x) / 2) ones only. Those that meet and belong to different components are confirmed.

So a list of copies costs a few pairs for each copy, and no link between components is lost. Equal sets stand together
from the start. The number of joins doesn't depend on the data, apart from the rounds of `components`.

Defined results: null and empty texts have no shingles and link with nothing. Texts are the nodes: rows that share a
doc_id but not the text are told apart. A null doc_id gets a null component, links with nothing and is kept.
"""

from __future__ import annotations

import hashlib
from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from . import textkit as tk
from .common import components, documents, stage, table

COORDINATES = 40
WORDS, SIMILARITY, MATCHES = 5, 80, 17
#: The query's contract: three words and 0.85, for which more matches can be asked.
QUERY = {"words": 3, "similarity": 85, "matches": 20}
_SEEDS = tk.mix(np.arange(1, 257, dtype=tk.U)) | tk.U(1)


def shingles(c: tk.Chunk, words: int) -> tuple[np.ndarray, np.ndarray]:
    """Hashes of the chunk's shingles, with repeats, and the number of the first of each document (and the end)."""
    starts, ends, firsts = tk.words(c)
    hashes = tk.word_hashes(c, starts, ends, lower=True)
    ok = tk.inside(words, firsts, len(hashes))
    at, n = np.flatnonzero(ok), np.diff(firsts)
    short = np.flatnonzero((n > 0) & (n < words))
    if not len(short):
        return tk.windows_hash(hashes, words, tk.BASE_A)[at], np.searchsorted(at, firsts)
    s = np.concatenate([at, firsts[short]])
    e = np.concatenate([at + words, firsts[short + 1]])
    order = np.argsort(s, kind="stable")
    return tk.spans_hash(hashes, s[order], e[order], tk.BASE_A), np.searchsorted(s[order], firsts)


def _sets(c: tk.Chunk, words: int) -> tuple[list[np.ndarray], np.ndarray, np.ndarray]:
    values, firsts = shingles(c, words)
    return [np.unique(values[a:b]) for a, b in zip(firsts[:-1], firsts[1:], strict=True)], values, firsts


def _digests(sets: list[np.ndarray]) -> pa.Array:
    return pa.array([hashlib.blake2b(x.tobytes(), digest_size=16).digest() for x in sets], type=pa.binary())


def _signatures(words: int, coordinates: int):
    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            rest = [k for k in batch.schema.names if k != "text"]
            for c in tk.chunks(batch["text"]):
                sets, values, firsts = _sets(c, words)
                full = np.flatnonzero(np.diff(firsts) > 0)
                low = np.empty((len(full), coordinates), dtype=np.int64)
                if len(full):
                    for k in range(coordinates):
                        least = np.minimum.reduceat((values * _SEEDS[k]) >> tk.U(8), firsts[:-1][full])
                        low[:, k] = (least | tk.U(k << 56)).view(np.int64)
                sizes = np.zeros(c.hi - c.lo + 1, dtype=np.int64)
                sizes[full + 1] = coordinates
                yield pa.RecordBatch.from_arrays(
                    [
                        *(batch[k].slice(c.lo, c.hi - c.lo) for k in rest),
                        pa.array([len(x) for x in sets], type=pa.int64()),
                        _digests(sets),
                        tk.list_array(low.ravel(), np.cumsum(sizes), pa.int64()),
                    ],
                    names=[*rest, "n_shingles", "digest", "signature"],
                )

    return run


def _full_sets(words: int):
    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            for c in tk.chunks(batch["text"]):
                sets = _sets(c, words)[0]
                offsets = np.concatenate([[0], np.cumsum([len(x) for x in sets])])
                found = tk.list_array(np.concatenate(sets).view(np.int64), offsets, pa.int64())
                yield pa.RecordBatch.from_arrays([batch["doc_id"].slice(c.lo, c.hi - c.lo), _digests(sets), found], names=["doc_id", "digest", "shingles"])

    return run


def _confirm(similarity: int):
    """(a, b) of the pairs that are linked, by their sets sa and sb."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            good = []
            for x, y in zip(batch["sa"], batch["sb"], strict=True):
                x, y = (v.values.to_numpy(zero_copy_only=False) for v in (x, y))
                both = len(np.intersect1d(x, y, assume_unique=True))
                good.append(100 * both >= similarity * (len(x) + len(y) - both))
            linked = pa.array(good, type=pa.bool_())
            yield pa.RecordBatch.from_arrays([batch["a"].filter(linked), batch["b"].filter(linked)], names=["a", "b"])

    return run


def _differences(similarity: int):
    """For pairs (a, b) of a home and another set, by their sets sa and sb: whether they are linked, keys of what b
    misses and adds, and how many of these it must be posted under."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            linked, need, keys = [], [], []
            for home, x, y, wanted in zip(batch["a"], batch["sa"], batch["sb"], batch["wanted"], strict=True):
                x, y = (v.values.to_numpy(zero_copy_only=False).view(tk.U) for v in (x, y))
                own = tk.mix(np.array([home.as_py()], dtype=np.int64).view(tk.U))
                missed, added = np.setdiff1d(x, y, assume_unique=True), np.setdiff1d(y, x, assume_unique=True)
                both = len(x) - len(missed)
                linked.append(100 * both >= similarity * (len(x) + len(y) - both))
                need.append(len(missed) + len(added) - (100 * len(missed) + similarity * len(added)) // (100 + similarity))
                if wanted.as_py():
                    keys.append(np.concatenate([tk.mix(missed ^ own), tk.mix((added + tk.U(1)) ^ ~own)]).view(np.int64))
                else:
                    keys.append(np.zeros(0, dtype=np.int64))
            offsets = np.concatenate([[0], np.cumsum([len(k) for k in keys])])
            columns = [pa.array(linked, type=pa.bool_()), pa.array(need, type=pa.int64()), tk.list_array(np.concatenate(keys) if keys else np.zeros(0, dtype=np.int64), offsets, pa.int64())]
            yield pa.RecordBatch.from_arrays([batch["a"], batch["b"], *columns], names=["a", "b", "linked", "need", "keys"])

    return run


def _posts(sets: DataFrame, matches: int) -> DataFrame:
    """(post, id, common): each set under the pairs of its signature that others hold, without the most common ones."""
    posts = sets.select("id", F.explode("signature").alias("post"))
    held = posts.groupBy("post").agg(F.count("*").alias("held")).where("held > 1")
    ranked = posts.join(held, "post").groupBy("id").agg(F.array_sort(F.collect_list(F.struct("held", "post"))).alias("order")).where(F.size("order") >= matches)
    common = F.aggregate("order", F.lit(0).cast("long"), lambda total, x: total + x["held"])
    return ranked.select("id", common.alias("common"), F.explode(F.slice("order", F.lit(1), F.size("order") - F.lit(matches - 1))).alias("x")).select("x.post", "id", "common")


def _places(full: DataFrame, similarity: int) -> DataFrame:
    """(token, id, n, reach): the shingles of each set that others hold and that may be the first one which it shares with a
    linked set. Then that other set has at most `reach` shingles."""
    t, theta = similarity / 100, similarity / (100 + similarity)
    n = F.size("shingles").cast("long")
    tokens = full.select("id", n.alias("n"), F.explode("shingles").alias("token"))
    held = tokens.groupBy("token").agg(F.count("*").alias("held")).where("held > 1")
    order = tokens.join(held, "token").groupBy("id").agg(F.min("n").alias("n"), F.array_sort(F.collect_list(F.struct("held", "token"))).alias("order"))
    # the shingles that no other set has come first
    first = F.col("n") - F.size("order")
    prefix = F.greatest(F.floor(F.col("n") * (1 - t) + 1e-6) + 1 - first, F.lit(0)).cast("int")
    placed = order.select("id", "n", first.alias("first"), F.posexplode(F.slice("order", F.lit(1), prefix)).alias("place", "x"))
    reach = F.floor((F.col("n") - F.col("first") - F.col("place")) / theta - F.col("n") + 1e-6)
    return placed.select("x.token", "id", "n", reach.alias("reach")).where(F.col("reach") >= F.col("n") * t - 1e-6)


def near_duplicates(docs: DataFrame, *carry: str, words: int = WORDS, similarity: int = SIMILARITY, coordinates: int = COORDINATES, matches: int = MATCHES) -> tuple[DataFrame, DataFrame]:
    """(rows, links). rows: doc_id, the carried columns, n_shingles, group_id (a number for each component of texts, null
    without shingles) and component_id for every row; links: confirmed (a, b) between the numbers of distinct sets, enough of them to join each component."""
    docs = documents(docs, *carry)
    kinds = ", ".join(f"`{f.name}` {f.dataType.simpleString()}" for f in docs.schema if f.name != "text")
    rows = stage(docs.mapInArrow(_signatures(words, coordinates), f"{kinds}, n_shingles bigint, digest binary, signature array<bigint>"), "op7-signatures")
    linkable = rows.where("n_shingles > 0 and doc_id is not null")
    sets = stage(linkable.groupBy("digest").agg(F.min("doc_id").alias("least"), F.min("signature").alias("signature")).withColumn("id", F.monotonically_increasing_id()), "op7-sets")
    posts = stage(_posts(sets, matches), "op7-posts")
    met = posts.select("id").distinct()
    chosen = sets.join(met, "id").select("id", "digest", F.col("least").alias("doc_id"))
    texts = docs.select("doc_id", "text").join(chosen.select("doc_id").distinct(), "doc_id", "left_semi")
    sized = texts.mapInArrow(_full_sets(words), f"doc_id {docs.schema['doc_id'].dataType.simpleString()}, digest binary, shingles array<bigint>")
    full = stage(sized.join(chosen, ["doc_id", "digest"]).dropDuplicates(["id"]).select("id", "shingles"), "op7-full")
    signed = sets.join(met, "id", "left_semi").select("id", "signature")

    def both(pairs: DataFrame) -> DataFrame:
        """pairs(a, b, ...) with their sets sa and sb."""
        one, two = (full.select(F.col("id").alias(k), F.col("shingles").alias(f"s{k}")) for k in "ab")
        return pairs.join(one, "a").join(two, "b")

    def confirmed(pairs: DataFrame, name: str) -> DataFrame:
        """Links among distinct pairs(a, b): those whose signatures have enough matches and whose sets are alike."""
        one, two = (signed.select(F.col("id").alias(k), F.col("signature").alias(f"g{k}")) for k in "ab")
        close = pairs.join(one, "a").join(two, "b").where(F.size(F.array_intersect("ga", "gb")) >= matches).select("a", "b")
        return stage(both(close).select("a", "b", "sa", "sb").mapInArrow(_confirm(similarity), "a bigint, b bigint"), name)

    # stars
    first = posts.groupBy("post").agg(F.max(F.struct("common", "id")).alias("first"), F.count("*").alias("held")).where("held > 1").select("post", F.col("first.id").alias("a"))
    links = confirmed(posts.join(first, "post").where("a <> id").select("a", F.col("id").alias("b")).distinct(), "op7-stars")
    groups = components(links, "op7-stars")
    known = posts.groupBy("id").agg(F.min("common").alias("common"))
    rank = known.join(groups.withColumnRenamed("node", "id"), "id", "left").select("id", "common", F.coalesce("component", "id").alias("component"))
    near = links.union(links.select("b", "a")).toDF("id", "other").join(known.select(F.col("id").alias("other"), "common"), "other").select("id", "common", "other")
    homes = near.union(known.select("id", "common", F.col("id").alias("other"))).groupBy("id").agg(F.max(F.struct("common", "other")).alias("x")).select("id", F.col("x.other").alias("home"))
    living = stage(rank.join(homes, "id").select("id", "component", "home"), "op7-homes")

    # visits
    t = similarity / 100
    placed = stage(_places(full, similarity).join(living, "id"), "op7-places")
    at_home = placed.where(F.col("reach") >= F.col("n")).groupBy("token", "home", F.col("component").alias("home_component")).agg(F.min("n").alias("smallest"), F.max("n").alias("largest"), F.max("reach").alias("top"))
    visitors = placed.select("token", F.col("id").alias("b"), "n", "reach", "component")
    suits = (F.col("component") != F.col("home_component")) & (F.col("smallest") <= F.least("reach", "n")) & (F.col("largest") >= F.col("n") * t - 1e-6) & (F.col("n") <= F.col("top"))
    visits = visitors.join(at_home, "token").where(suits).select(F.col("home").alias("a"), "b").distinct()
    many = living.where("home <> id").select(F.col("home").alias("a")).distinct().withColumn("wanted", F.lit(True))
    visits = visits.join(many, "a", "left").select("a", "b", F.coalesce("wanted", F.lit(False)).alias("wanted"))
    kinds = "a bigint, b bigint, linked boolean, need bigint, keys array<bigint>"
    visited = stage(both(visits).select("a", "b", "sa", "sb", "wanted").mapInArrow(_differences(similarity), kinds), "op7-visits")
    links = stage(links.union(visited.where("linked").select("a", "b")), "op7-links")

    # relatives
    groups = components(links, "op7-visits")
    open_ = visited.where("not linked and size(keys) > 0").select("a", "b", F.explode("keys").alias("key"))
    relatives = living.where("home <> id").select(F.col("home").alias("a"), F.col("id").alias("b")).join(open_.select("a").distinct(), "a").withColumn("wanted", F.lit(True))
    kin = stage(both(relatives).select("a", "b", "sa", "sb", "wanted").mapInArrow(_differences(similarity), kinds), "op7-relatives")
    keys = kin.select("b", "need", F.explode("keys").alias("key"))
    held = keys.groupBy("key").agg(F.count("*").alias("held"))
    rare = keys.join(held, "key").groupBy("b").agg(F.min("need").alias("need"), F.array_sort(F.collect_list(F.struct("held", "key"))).alias("order")).select(F.col("b").alias("a"), F.explode(F.slice("order", F.lit(1), F.col("need").cast("int"))).alias("x")).select("a", "x.key")
    label = lambda k: groups.select(F.col("node").alias(k), F.col("component").alias(f"group_{k}"))
    pairs = open_.select("b", "key").join(rare, "key").select("a", "b").distinct().join(label("a"), "a", "left").join(label("b"), "b", "left")
    apart = F.coalesce("group_a", "a") != F.coalesce("group_b", "b")
    links = stage(links.union(confirmed(pairs.where(apart).select("a", "b"), "op7-kin")), "op7-all")

    groups = components(links, "op7-last")
    nodes = sets.select("digest", "least", "id").join(groups, sets.id == groups.node, "left").select("digest", "least", F.coalesce("component", "id").alias("component"))
    smallest = nodes.groupBy("component").agg(F.min("least").alias("component_id"))
    found = nodes.join(smallest, "component").select("digest", "component_id", F.col("component").alias("group_id"))
    names = ["doc_id", *carry, "n_shingles", "group_id"]
    out = rows.join(found, "digest", "left").select(*names, F.when(F.col("doc_id").isNotNull(), F.coalesce("component_id", "doc_id")).alias("component_id"))
    return out, links


def op7_minhash_dedup(spark: SparkSession, sf_dir: str) -> DataFrame:
    """One row a document: doc_id, n_shingles, component_id, kept. Null and empty texts have no shingles and are kept; of
    rows that share a doc_id each has its text's component; a null doc_id has none and is kept."""
    rows = near_duplicates(table(spark, sf_dir, "documents"), **QUERY)[0].drop("group_id")
    return rows.withColumn("kept", F.coalesce(F.col("doc_id") == F.col("component_id"), F.lit(True)))


ORACLE = r"""
WITH RECURSIVE d AS (SELECT doc_id, list_filter(string_split_regex(translate(coalesce(text, ''), 'ABCDEFGHIJKLMNOPQRSTUVWXYZ', 'abcdefghijklmnopqrstuvwxyz'), '[\x20\x09-\x0D]+'), lambda x: x <> '') AS w FROM documents),
s AS (SELECT DISTINCT doc_id, unnest(CASE WHEN len(w) = 0 THEN [] WHEN len(w) < 3 THEN [array_to_string(w, ' ')] ELSE list_transform(range(1, len(w) - 1), lambda i: array_to_string(w[i:i + 2], ' ')) END) AS g FROM d),
n AS (SELECT doc_id, count(*) AS n FROM s GROUP BY doc_id),
p AS (SELECT a.doc_id AS a, b.doc_id AS b, count(*) AS c FROM s a JOIN s b ON a.g = b.g AND a.doc_id < b.doc_id GROUP BY ALL),
l AS (SELECT a, b FROM p JOIN n x ON x.doc_id = a JOIN n y ON y.doc_id = b WHERE 100 * c >= 85 * (x.n + y.n - c)),
e AS (SELECT a, b FROM l UNION SELECT b, a FROM l),
r AS (SELECT doc_id AS v, doc_id AS c FROM documents UNION SELECT e.a, r.c FROM r JOIN e ON e.b = r.v)
SELECT d.doc_id, coalesce(max(n.n), 0)::BIGINT AS n_shingles, min(r.c) AS component_id, min(r.c) = d.doc_id AS kept
FROM d LEFT JOIN n ON n.doc_id = d.doc_id JOIN r ON r.v = d.doc_id GROUP BY d.doc_id
"""
