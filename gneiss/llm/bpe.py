"""Operator 8, BPE encoding and decoding by prefix-sharing trie traversal.

Distinct words go into a trie. A depth-first walk gives each node the last token of its prefix's encoding: the one
token that ends there and may follow the last token of the prefix before it. Two tokens may follow each other if the
merges, run on their characters, give back just these two. A sequence of tokens in which all neighbours may is the
encoding (merges run the same in each token whatever stands beside it, as long as none crosses a border, and a first
crossing would also occur between the two alone), so each node has one such token, and the encoding of a shared
prefix is computed once. Words end with a character of their own (`</w>`), an edge to a leaf.

The trie is held as the sorted words, in which its nodes stand depth first: a word's path leaves that of the word before
where the two differ. The walk keeps one stack with the last token of each node on the path, so its memory is linear in
the longest word, whatever its length.

Text is cut where the tokenizer's splits can't reach across: at ASCII white space. The distinct words of a chunk are
looked up in a cache of bounded size; ids of whole texts are then gathered by numpy, and decoding takes the token of each
id. The vocabulary file is read by path on each executor; it isn't part of this repository.

Defined results: null and empty texts, and those of white space alone, have no tokens and decode to an empty string.
"""

from __future__ import annotations

import gc
import hashlib
import json
import unicodedata
from array import array
from collections.abc import Iterable, Iterator
from contextlib import contextmanager

import numpy as np
import pyarrow as pa
import pyarrow.compute as pc
import regex
from pyspark.sql import DataFrame, SparkSession

from . import textkit as tk
from .common import documents, table

END = "</w>"
SPACES = "\\t-\\r\\x20\\x85\\xa0\\u1680\\u2000-\\u200a\\u2028\\u2029\\u202f\\u205f\\u3000"
#: The tokenizer's split pattern; its white space is Unicode's.
SPLIT = regex.compile(rf"'s|'t|'re|'ve|'m|'ll|'d|[\p{{L}}]+|[\p{{N}}]|[^{SPACES}\p{{L}}\p{{N}}]+")
#: Bytes of a worker's cache of words; pairs of tokens.
CACHED, PAIRS = 32 << 20, 150_000


def byte_letters() -> list[str]:
    """The letter that stands for each byte: printable Latin-1 stands for itself, the others from U+0100 on, in order."""
    own = {*range(33, 127), *range(161, 173), *range(174, 256)}
    others = iter(range(256, 512))
    return [chr(b if b in own else next(others)) for b in range(256)]


def lower(text: str) -> str:
    """Lower case letter by letter: a final sigma is like any other."""
    return text.lower() if "Σ" not in text else "".join(x.lower() for x in text)


class Merges:
    """Plain BPE over the merge list; the reference for which tokens may follow each other."""

    def __init__(self, vocab: dict[str, int], merges: Iterable[tuple[str, str]]):
        self.vocab = vocab
        self.ranks = {(a, b): i for i, (a, b) in enumerate(merges)}
        self.own: dict[str, bool] = {}
        self.pairs: dict[int, bool] = {}
        self.names = {i: t for t, i in vocab.items()}
        made: dict[str, list[tuple[str, str]]] = {}
        for pair in self.ranks:
            made.setdefault(pair[0] + pair[1], []).append(pair)
        #: The one merge that makes each token, if no token has two: then tokens are made in the order of merges.
        self.parts = {t: pairs[0] for t, pairs in made.items()} if all(len(x) == 1 for x in made.values()) else None

    @staticmethod
    def letters(token: str) -> list[str]:
        return [*token[: -len(END) - 1], token[-len(END) - 1 :]] if token.endswith(END) and len(token) > len(END) else [*token]

    def run(self, parts: list[str]) -> list[str]:
        parts = list(parts)
        while len(parts) > 1:
            rank, at = min((self.ranks.get((a, b), 1 << 30), i) for i, (a, b) in enumerate(zip(parts, parts[1:], strict=False)))
            if rank == 1 << 30:
                break
            parts[at : at + 2] = [parts[at] + parts[at + 1]]
        return parts

    def whole(self, token: str) -> bool:
        """Whether a token's own letters merge into it."""
        good = self.own.get(token)
        if good is None:
            pair = self.parts.get(token) if self.parts is not None else None
            if pair:
                good = self.whole(pair[0]) and self.whole(pair[1]) and self._apart(*pair, joined=True)
            else:
                good = self.run(self.letters(token)) == [token]
            self.own[token] = good
        return good

    def follows(self, a: int, b: int) -> bool:
        key = a << 32 | b
        good = self.pairs.get(key)
        if good is None:
            if len(self.pairs) > PAIRS:
                self.pairs.clear()
            x, y = self.names[a], self.names[b]
            good = self.pairs[key] = self._apart(x, y) if self.parts is not None else self.run(self.letters(x) + self.letters(y)) == [x, y]
        return good

    def _edge(self, token: str, side: int) -> list[tuple[str, int]]:
        """The pieces that stand at a token's end (side 1) or start (0) while it is made, each with the rank of the
        merge that takes it up; the token itself is never taken up."""
        out, until = [], 1 << 30
        while True:
            out.append((token, until))
            pair = self.parts.get(token)
            if pair is None:
                return out
            until, token = self.ranks[pair], pair[side]

    def _apart(self, a: str, b: str, joined: bool = False) -> bool:
        """Whether no merge joins a piece of a to a piece of b while both stand; of equal merges the left one is first.
        joined: the merge of a and b themselves is wanted."""
        right = self._edge(b, 0)
        for x, x_until in self._edge(a, 1):
            for y, y_until in right:
                rank = self.ranks.get((x, y))
                if rank is not None and rank < x_until and rank <= y_until and not (joined and x is a and y is b):
                    return False
        return True


class Ends:
    """Tokens by the letters that they end with: those inside of words, or those at their ends (without `</w>`)."""

    def __init__(self, tokens: dict[str, int]):
        self.ids = tokens
        #: Ends of longer tokens.
        self.more = {t[k:] for t in tokens for k in range(1, len(t))}


class Trie:
    """Encodes many distinct words in one depth-first walk."""

    def __init__(self, merges: Merges):
        self.merges = merges
        whole = {t: i for t, i in merges.vocab.items() if merges.whole(t)}
        self.inner = Ends({t: i for t, i in whole.items() if not t.endswith(END) or t == END})
        self.outer = Ends({t[: -len(END)]: i for t, i in whole.items() if t.endswith(END) and t != END})

    def _step(self, ends: Ends, word: str, n: int, last: list[int]) -> tuple[int, int]:
        """Start and id of the token that ends a prefix of n letters, given the last tokens of the shorter ones."""
        ids, more, k, found = ends.ids, ends.more, n - 1, []
        while k >= 0:
            end = word[k:n]
            if end in ids:
                found.append(k)
            if end not in more:
                break
            k -= 1
        for k in reversed(found):
            token = ids[word[k:n]]
            if not k or self.merges.follows(last[k - 1], token):
                return k, token
        raise ValueError(f"no token ends {word[:n]!r}")

    def encode(self, words: Iterable[str]) -> dict[str, bytes]:
        """Token ids, as 32-bit numbers, of each nonempty word of byte letters."""
        pairs, step, inner, outer = self.merges.pairs, self._step, self.inner, self.outer
        tokens, own = inner.ids, outer.ids
        last, starts = [], []  # of each prefix of the current path: its last token, and where that starts
        out, before = {}, ""
        for word in sorted(words):
            n, shared = len(word), 0
            for x, y in zip(before, word, strict=False):
                if x != y:
                    break
                shared += 1
            depth = min(shared, n - 1, len(last))
            del last[depth:], starts[depth:]
            start = starts[-1] if depth else 0
            for depth in range(depth + 1, n):
                # the token before with one more letter, if it may stand there: then it is the one
                token = tokens.get(word[start:depth])
                if token is None or (start and not pairs.get(last[start - 1] << 32 | token)):
                    start, token = step(inner, word, depth, last)
                last.append(token)
                starts.append(start)
            token = own.get(word[start:])
            if token is None or (start and not pairs.get(last[start - 1] << 32 | token)):
                start, token = step(outer, word, n, last)
            ids = [token]
            while start:
                ids.append(last[start - 1])
                start = starts[start - 1]
            ids.reverse()
            out[word] = array("i", ids).tobytes()
            before = word
        return out


class Bounded(dict):
    """A cache of byte strings that is emptied when it holds more than CACHED bytes."""

    held = 0

    def put(self, key: str, value: bytes) -> None:
        self.held += len(key) + len(value) + 200
        self[key] = value

    def tidy(self) -> None:
        if self.held > CACHED:
            self.clear()
            self.held = 0


class Tokenizer:
    """A word-level BPE tokenizer file: lower case, split words, byte letters, word ends."""

    def __init__(self, path: str):
        with open(path, encoding="utf-8") as f:
            data = json.load(f)
        self.vocab: dict[str, int] = dict(data["model"]["vocab"])
        self.added = {x["content"]: x["id"] for x in data["added_tokens"]}
        if any(x in t for t in self.added for x in " \t\n\v\f\r"):
            raise ValueError("added tokens with white space can't be found in pieces of a text")
        names = {i: t for t, i in (self.vocab | self.added).items()}
        self.names = pa.array([names.get(i, "") for i in range(max(names) + 1)], type=pa.string())
        self.decimals = pa.array([str(i) for i in range(len(self.names))], type=pa.string())
        self.merges = Merges(self.vocab, (tuple(m) if isinstance(m, list) else tuple(m.split(" ")) for m in data["model"]["merges"]))
        self.trie = Trie(self.merges)
        self.letters = byte_letters()
        self.specials = regex.compile("(" + "|".join(map(regex.escape, sorted(self.added, key=len, reverse=True))) + ")") if self.added else None
        self.spaces = regex.compile(f"[{SPACES}]+")
        self.known = Bounded()  # ids of a word
        #: Ids of what may follow the letters of a simple piece.
        self.tails = {t: self.vocab[t + END] for t in ".," if t + END in self.vocab and self.merges.whole(t + END)}
        self.simple = f"^[A-Za-zÀ-ÖØ-öø-ÿ]+[{''.join(self.tails)}]?$" if self.tails else "^[A-Za-zÀ-ÖØ-öø-ÿ]+$"

    def words(self, piece: str) -> list[str]:
        """The words of a piece as byte letters; added tokens stand for themselves, after a NUL letter that is none."""
        out = []
        for i, part in enumerate(self.specials.split(piece) if self.specials and self.specials.search(piece) else [piece]):
            if i % 2:
                out.append("\0" + part)
                continue
            part = lower(self.spaces.sub(" ", unicodedata.normalize("NFC", part)))
            for word in SPLIT.findall(part):
                out.append(word if word.isascii() and word.isalnum() else "".join([self.letters[b] for b in word.encode()]))
        return out

    def learn(self, words: Iterable[str]) -> None:
        """Puts words of byte letters into the cache."""
        self.known.tidy()
        for word, ids in self.trie.encode([w for w in words if w not in self.known]).items():
            self.known.put(word, ids)

    def spelt(self, word: str) -> str:
        return word if word.isascii() else "".join([self.letters[b] for b in word.encode()])

    def pieces(self, pieces: pa.Array) -> tuple[np.ndarray, np.ndarray]:
        """Token ids of some distinct pieces without ASCII white space, and the number of each one's first (and the end).

        Simple pieces, Latin letters with or without a stop or comma, are taken apart by column functions: such letters
        are composed already, and their lower case is theirs alone."""
        simple = pc.match_substring_regex(pieces, self.simple)
        easy = pieces.filter(simple)
        tail = np.zeros(len(easy), dtype=np.int32)
        for t, i in self.tails.items():
            tail[pc.ends_with(easy, t).to_numpy(zero_copy_only=False)] = i + 1
        stems = pc.utf8_lower(pc.utf8_rtrim(easy, "".join(self.tails)) if self.tails else easy).dictionary_encode()
        names = [self.spelt(w) for w in stems.dictionary.to_pylist()]
        hard = [self.words(p) for p in pieces.filter(pc.invert(simple)).to_pylist()]
        self.learn({*names, *(w for words in hard for w in words if w[0] != "\0")})
        known = self.known
        easy_ids = [known[w] for w in names]
        which = stems.indices.to_numpy(zero_copy_only=False)
        hard_ids = [b"".join([known[w] if w[0] != "\0" else np.int32(self.added[w[1:]]).tobytes() for w in words]) for words in hard]
        mask = simple.to_numpy(zero_copy_only=False)
        # every piece takes a run of the pool and at most one id more
        source = np.empty(len(pieces), dtype=np.int64)
        source[mask], source[~mask] = which, len(names) + np.arange(len(hard))
        more = np.zeros(len(pieces), dtype=np.int32)
        more[mask] = tail
        ids, until = gathered(easy_ids + hard_ids, source, (more > 0).astype(np.int64))
        ids[until[1:][more > 0] - 1] = more[more > 0] - 1
        return ids, until

    def encode(self, c: tk.Chunk) -> tuple[np.ndarray, np.ndarray]:
        """Token ids of a chunk, and the number of the first one of each document (and the end)."""
        starts, ends, firsts = tk.words(c)
        data = c.data[~tk.SPACE[c.data]]
        places = np.concatenate([[0], np.cumsum(ends - starts)]).astype(np.int32 if len(data) < 1 << 31 else np.int64)
        kind, column = (pa.binary(), pa.BinaryArray) if places.dtype == np.int32 else (pa.large_binary(), pa.LargeBinaryArray)
        column = column.from_buffers(kind, len(starts), [None, pa.py_buffer(places), pa.py_buffer(data)]).dictionary_encode()
        try:
            pieces = column.dictionary.cast(pa.string())
        except pa.ArrowInvalid:  # bytes that are no UTF-8
            pieces = pa.array([p.decode("utf-8", "replace") for p in column.dictionary.to_pylist()], type=pa.string())
        pool, begin = self.pieces(pieces)
        which, sizes = column.indices.to_numpy(zero_copy_only=False), np.diff(begin)
        own = sizes[which]
        until = np.concatenate([[0], np.cumsum(own)])
        return pool[np.arange(until[-1]) + np.repeat(begin[which] - until[:-1], own)], until[firsts]

    def joined(self, names: pa.Array, ids: np.ndarray, firsts: np.ndarray) -> pa.Array:
        """The names of each document's ids, joined by spaces."""
        return pc.binary_join(pa.ListArray.from_arrays(pa.array(firsts.astype(np.int32)), names.take(pa.array(ids))), " ")

    def decode(self, ids: np.ndarray, firsts: np.ndarray) -> pa.Array:
        """Texts of the ids of some documents. The file names no decoder, so tokens are joined by spaces."""
        return self.joined(self.names, ids, firsts)


def gathered(runs: list[bytes], which: np.ndarray, more: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    """The chosen runs of 32-bit numbers one after the other, each with room for `more` numbers after it, and ends."""
    sizes = np.array([len(x) >> 2 for x in runs], dtype=np.int64)
    pool, begin = np.frombuffer(b"".join(runs), dtype=np.int32), np.cumsum(sizes) - sizes
    own = sizes[which] if len(which) else np.zeros(0, dtype=np.int64)
    until = np.concatenate([[0], np.cumsum(own + more)])
    out = np.zeros(until[-1], dtype=np.int32)
    place = np.arange(own.sum()) - np.repeat(np.cumsum(own) - own, own)
    out[np.repeat(until[:-1], own) + place] = pool[np.repeat(begin[which] if len(which) else own, own) + place]
    return out, until


@contextmanager
def tokenizer(path: str) -> Iterator[Tokenizer]:
    """The tokenizer for a task: a worker that goes on to other work doesn't keep it."""
    yield Tokenizer(path)
    gc.collect()
    pa.default_memory_pool().release_unused()


def _digests(texts: pa.Array) -> pa.Array:
    _, places, data = texts.buffers()
    places, data = np.frombuffer(places, dtype=np.int32)[texts.offset :], memoryview(data or b"")
    return pa.array([hashlib.sha256(data[places[i] : places[i + 1]]).hexdigest() for i in range(len(texts))], type=pa.string())


def _encoded(path: str, digest: bool):
    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        with tokenizer(path) as own:
            for batch in batches:
                rest = [k for k in batch.schema.names if k != "text"]
                for c in tk.chunks(batch["text"], 4 << 20):
                    ids, firsts = own.encode(c)
                    if digest:
                        columns = {"ids_sha256": _digests(own.joined(own.decimals, ids, firsts)), "decoded_sha256": _digests(own.decode(ids, firsts))}
                    else:
                        columns = {"ids": tk.list_array(ids, firsts, pa.int32())}
                    yield pa.RecordBatch.from_arrays([*(batch[k].slice(c.lo, c.hi - c.lo) for k in rest), pa.array(np.diff(firsts)), *columns.values()], names=[*rest, "n_tokens", *columns])

    return run


def _schema(df: DataFrame, more: str) -> str:
    return ", ".join([*(f"`{f.name}` {f.dataType.simpleString()}" for f in df.schema if f.name != "text"), more])


def encode(docs: DataFrame, path: str, *carry: str) -> DataFrame:
    """doc_id, the carried columns, n_tokens and ids of whole texts. path: the tokenizer file, on every executor."""
    docs = documents(docs, *carry)
    return docs.mapInArrow(_encoded(path, False), _schema(docs, "n_tokens bigint, ids array<int>"))


def decode(df: DataFrame, path: str) -> DataFrame:
    """doc_id, text: what the ids decode to."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        with tokenizer(path) as own:
            for batch in batches:
                ids = batch["ids"]
                firsts = np.concatenate([[0], np.cumsum(pc.fill_null(pc.list_value_length(ids), 0).to_numpy(zero_copy_only=False))])
                texts = own.decode(ids.flatten().to_numpy(zero_copy_only=False), firsts)
                yield pa.RecordBatch.from_arrays([batch["doc_id"], texts], names=["doc_id", "text"])

    df = df.select("doc_id", "ids")
    return df.mapInArrow(run, f"doc_id {df.schema['doc_id'].dataType.simpleString()}, text string")


def vocabulary() -> str:
    import public_tokenizers

    return public_tokenizers.path("word_bpe_49k.json")


def op8_bpe(spark: SparkSession, sf_dir: str) -> DataFrame:
    """One row a document: doc_id, n_tokens, ids_sha256 and decoded_sha256, the digest of what its ids decode to. Null and
    empty texts have no tokens (digests of an empty text); repeated rows are rows of their own."""
    docs = documents(table(spark, sf_dir, "documents"))
    return docs.mapInArrow(_encoded(vocabulary(), True), _schema(docs, "n_tokens bigint, ids_sha256 string, decoded_sha256 string"))
