"""BPE encoding and decoding with a tokenization automaton.

``Automaton`` is compiled from the ordered merges of a tokenizer file by one gadget per merge. It
reads token labels: it accepts a label sequence only if that is the tokenization of the bytes the
labels spell. It starts as one state with a loop for each base symbol. The gadget of merge (u, v) -> w

* gives the arcs labelled u a target of their own, a copy of their old target without its arc v, and
* adds an arc w wherever there is an arc u, ending where the arc v ended.

So all arcs of one label share a target, a target is its origin plus the arcs it lost, and both are
held as tables: ``left``/``right`` (which arcs stand for w before its gadget), ``made`` (the gadget's
number) and the hash table of lost arcs, ``(u, v) -> gadget``. ``follows(u, t)`` reads from these whether
the state behind u has an arc t. A word is encoded left to right: for every prefix exactly one label
ends an accepted path; it is found by table look-ups for all words of a batch at once. Decoding emits
the labels' texts.

Words repeat, so each Python worker keeps the ids of up to ``KEPT_WORDS`` words, in two tables. Before a slice
of texts, a table with half as many takes the place of the one before it, from which words still asked for
are taken over. That bounds memory and changes no result.

Cases: null and empty texts have no tokens; long texts are encoded whole; repeated rows are encoded
once each; an empty table gives no rows; ``encode`` adds one named column and fails on a clash before
any task runs.
"""

from __future__ import annotations

import json
import re
import unicodedata
from collections.abc import Iterator
from itertools import chain

import numpy as np
import pyarrow as pa
import pyarrow.compute as pc
import regex
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql import types as T

from . import common

KEPT_WORDS = 250_000
#: Rows that are decoded at a time.
ROWS = 200
NEVER = np.int32(2**31 - 1)
MULTIPLIER = np.uint64(0x9E3779B97F4A7C15)
STEP, MASK = 0x9E3779B97F4A7BB5, 2**64 - 1
#: A text that only begins labels.
SHORT = 2**30
END = "</w>"
WORDS = "'s|'t|'re|'ve|'m|'ll|'d|{letters}+|{numbers}|[^{spaces}{letters_in}{numbers_in}]+"
#: White space as the tokenizer file's expressions have it.
WHITE = "\\t-\\r \\x85\\xa0\\u1680\\u2000-\\u200a\\u2028\\u2029\\u202f\\u205f\\u3000"


def byte_letters() -> list[str]:
    """The visible letter that stands for each byte in the vocabulary: printable ones for themselves, the rest from U+0100 on."""
    plain = [*range(33, 127), *range(161, 173), *range(174, 256)]
    others = iter(range(256, 512))
    return [chr(b) if b in plain else chr(next(others)) for b in range(256)]


class Table:
    """An open-addressed hash table from 64-bit keys to int32, looked up for arrays of keys."""

    def __init__(self, keys: np.ndarray, values: np.ndarray):
        bits = max(4, int(np.ceil(np.log2(max(1, len(keys)) * 3))))
        self.shift, self.mask = np.uint64(64 - bits), np.int64((1 << bits) - 1)
        self.keys = np.zeros(1 << bits, np.uint64)
        self.values = np.full(1 << bits, -1, np.int32)
        self.longest = 0
        todo = np.arange(len(keys))
        at = self._first(keys)
        while len(todo):  # all that remain try their slot; of those on one free slot the first gets it
            free = self.values[at] < 0
            taken, first = np.unique(at[free], return_index=True)
            won = np.flatnonzero(free)[first]
            self.keys[taken], self.values[taken] = keys[todo[won]], values[todo[won]]
            left = np.ones(len(todo), bool)
            left[won] = False
            todo, at = todo[left], (at[left] + 1) & self.mask
            self.longest += 1

    def _first(self, keys: np.ndarray) -> np.ndarray:
        return ((keys * MULTIPLIER) >> self.shift).astype(np.int64)

    def find(self, keys: np.ndarray) -> np.ndarray:
        """The value of each key, or -1."""
        at = self._first(keys)
        held = self.values[at]
        out = np.where(self.keys[at] == keys, held, -1)
        open_ = np.flatnonzero((out < 0) & (held >= 0))
        for _ in range(self.longest):
            if not len(open_):
                break
            at[open_] = (at[open_] + 1) & self.mask
            held = self.values[at[open_]]
            same = (self.keys[at[open_]] == keys[open_]) & (held >= 0)
            out[open_[same]] = held[same]
            open_ = open_[~same & (held >= 0)]
        return out


class Automaton:
    """The tokenization automaton of a vocabulary and its ordered merges.

    ``symbols``: the base labels; a word is a sequence of indexes into them.
    """

    def __init__(self, vocab: dict[str, int], merges: list[tuple[str, str]], symbols: list[str]):
        labels = max(vocab.values()) + 1
        self.left = np.arange(labels, dtype=np.int32)
        self.right = np.arange(labels, dtype=np.int32)
        self.made = np.full(labels, -1, np.int32)
        self.base = np.array([vocab.get(s, -1) for s in symbols], np.int32)
        spelled: dict[int, tuple[int, ...]] = {vocab[s]: (i,) for i, s in enumerate(symbols) if s in vocab}
        lost = np.empty(len(merges), np.uint64)
        for gadget, (a, b) in enumerate(merges):
            u, v, w = vocab[a], vocab[b], vocab[a + b]
            if u not in spelled or v not in spelled or w in spelled:
                raise ValueError(f"merge {gadget} doesn't join two labels made before it to a new one")
            spelled[w] = spelled[u] + spelled[v]
            self.left[w], self.right[w], self.made[w] = u, v, gadget
            lost[gadget] = pair(u, v)
        self.lost = Table(lost, np.arange(len(merges), dtype=np.int32))
        self.longest = max(map(len, spelled.values()))
        self.size = np.zeros(labels, np.int32)
        nodes: dict[tuple[int, ...], int] = {}  # every start of a label's text: its label, or SHORT
        for i, text in spelled.items():
            self.size[i] = len(text)
            for n in range(1, len(text)):
                nodes.setdefault(text[:n], SHORT)
            nodes[text] = i
        self.two = np.full(len(symbols) ** 2, -1, np.int32)
        long: dict[int, int] = {}
        for text, i in nodes.items():
            if len(text) == 2:
                self.two[text[0] * len(symbols) + text[1]] = i
            elif len(text) > 2:
                key = 0
                for x in text:
                    key = (key * STEP + x + 1) & MASK
                if long.setdefault(key, i) != i:
                    raise ValueError("two texts have one key")
        self.nodes = Table(np.fromiter(long, np.uint64, len(long)), np.fromiter(long.values(), np.int32, len(long)))
        self.known_pairs = np.full(1 << 20, np.uint64(MASK))  # pairs that follows() has met, with the answer as the low bit

    def follows(self, u: np.ndarray, t: np.ndarray) -> np.ndarray:
        """Whether the state behind each label u has an arc for each label t.

        Walks back through the gadgets, the latest first. What u's target lost before ``u_until`` and
        what stood for t up to ``t_until`` decides.
        """
        out = np.ones(len(u), bool)
        at = np.arange(len(u))
        u, t = u.copy(), t.copy()
        u_until, t_until = np.full(len(u), NEVER), np.full(len(u), NEVER)
        while len(at):
            gadget = self.lost.find(pair(u, t))
            hit = (gadget >= 0) & (gadget < u_until) & (gadget <= t_until)
            out[at[hit]] = False
            mu, mt = self.made[u], self.made[t]
            on = ~hit & ((mu >= 0) | (mt >= 0))
            at, u, t, u_until, t_until, mu, mt = (x[on] for x in (at, u, t, u_until, t_until, mu, mt))
            back_u = mu > mt
            u_until = np.where(back_u, mu, u_until)
            t_until = np.where(back_u, t_until, mt)
            u, t = np.where(back_u, self.right[u], u), np.where(back_u, t, self.left[t])
        return out

    def follows_kept(self, u: np.ndarray, t: np.ndarray) -> np.ndarray:
        """follows(), looked up among the pairs met lately."""
        keys = ((np.asarray(u).astype(np.uint64) << np.uint64(24)) | np.asarray(t).astype(np.uint64)) << np.uint64(1)
        at = ((keys * MULTIPLIER) >> np.uint64(44)).astype(np.int64)
        held = self.known_pairs[at]
        out = (held & np.uint64(1)).astype(bool)
        new = np.flatnonzero((held >> np.uint64(1)) != (keys >> np.uint64(1)))
        if len(new):
            out[new] = self.follows(u[new], t[new])
            self.known_pairs[at[new]] = keys[new] | out[new]
        return out

    def encode(self, symbols: np.ndarray, sizes: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
        """The labels of all words, one word after another, and how many each has.

        symbols: the symbol indexes of all words in a row; sizes: how many each word has, one at least.
        """
        if not len(sizes):
            return np.empty(0, np.int32), np.empty(0, np.int64)
        ends = np.cumsum(sizes)
        begins = ends - sizes
        stop = np.repeat(ends, sizes)
        symbols = symbols.astype(np.int64)
        # every label's text that starts at a place, walked as in a trie
        at = np.arange(len(symbols))
        starts, labels = [at], [self.base[symbols]]
        at = at[at + 1 < stop]
        node = self.two[symbols[at] * len(self.base) + symbols[at + 1]]
        step, keys, length = np.uint64(STEP), None, 2
        while len(at):
            alive = node >= 0
            at, node = at[alive], node[alive]
            found = node != SHORT
            starts.append(at[found])
            labels.append(node[found])
            if keys is None:
                with np.errstate(over="ignore"):
                    keys = (symbols[at].astype(np.uint64) + np.uint64(1)) * step + symbols[at + 1].astype(np.uint64) + np.uint64(1)
            else:
                keys = keys[alive]
            room = at + length < stop[at]
            at, keys = at[room], keys[room]
            keys = keys * step + symbols[at + length].astype(np.uint64) + np.uint64(1)
            node = self.nodes.find(keys)
            length += 1
        start, label = np.concatenate(starts), np.concatenate(labels)
        if (label < 0).any():
            raise ValueError("a word has a symbol that the vocabulary lacks")
        # for every prefix of a word, the one label that ends an accepted path
        word = np.repeat(np.arange(len(sizes)), sizes)[start]
        end = start + self.size[label]
        depth = end - begins[word]
        order = np.argsort(depth.astype(np.uint16) if int(sizes.max()) < 65536 else depth, kind="stable")
        bounds = np.searchsorted(depth[order], np.arange(1, int(sizes.max()) + 2))
        last = np.full(len(symbols) + 1, -1, np.int32)  # by the end of the prefix
        for a, b in zip(bounds[:-1].tolist(), bounds[1:].tolist(), strict=True):
            now = order[a:b]
            s, t = start[now], label[now]
            ok = s == begins[word[now]]
            inner = np.flatnonzero(~ok)
            before = last[s[inner]]
            inner, before = inner[before >= 0], before[before >= 0]
            ok[inner] = self.follows_kept(before, t[inner])
            last[end[now[ok]]] = t[ok]
        # back along the accepted paths
        out = np.empty(len(symbols), np.int32)
        used = np.zeros(len(symbols), bool)
        live, place = ends.copy(), begins
        while len(live):
            t = last[live]
            out[live - 1] = t
            used[live - 1] = True
            live = live - self.size[t]
            on = live > place
            live, place = live[on], place[on]
        return out[used], np.add.reduceat(used, begins, dtype=np.int64)


def pair(u, v) -> np.ndarray:
    return (np.asarray(u).astype(np.uint64) << np.uint64(32)) | np.asarray(v).astype(np.uint64)


class Kept(dict):
    """Words and their ids. A word asked for in vain gets an empty array, which gathers in ``new`` and is filled later."""

    def __init__(self):
        super().__init__()
        self.old: dict[str | int, bytes] = {}
        self.new: dict[str, bytearray] = {}

    def __missing__(self, word: str) -> bytes | bytearray:
        found = self.old.get(word)
        if found is None:
            found = self.new[word] = bytearray()
        self[word] = found
        return found

    def turn(self, most: int) -> None:
        """Makes room if this table has so many words."""
        if len(self) >= most:
            self.old = dict(self)
            self.clear()


class Codec:
    """Encodes and decodes texts as the tokenizer file says: special strings, NFC, lower case, words, bytes, merges."""

    def __init__(self, spec: str):
        doc = json.loads(spec)
        model = doc["model"]
        known = {"type": "BPE", "dropout": None, "unk_token": None, "continuing_subword_prefix": None, "end_of_word_suffix": END, "byte_fallback": False, "ignore_merges": False}
        kinds = [x["type"] for x in doc["normalizer"]["normalizers"]], [x["type"] for x in doc["pre_tokenizer"]["pretokenizers"]]
        if any(model.get(k) != v for k, v in known.items()) or kinds != (["NFC", "Replace", "Lowercase"], ["Split", "ByteLevel"]) or doc["decoder"] or doc["post_processor"]:
            raise ValueError("this kind of tokenizer file isn't supported")
        letters = byte_letters()
        merges = [tuple(m) if isinstance(m, list) else tuple(m.split(" ")) for m in model["merges"]]
        self.automaton = Automaton(model["vocab"], merges, letters + [c + END for c in letters])
        self.special = {x["content"]: x["id"] for x in doc["added_tokens"]}
        self.split_special = re.compile("(" + "|".join(map(re.escape, sorted(self.special, key=len, reverse=True))) + ")") if self.special else None
        latin = "".join(chr(c) for c in range(0x250) if unicodedata.category(chr(c))[0] == "L")
        digits = "".join(chr(c) for c in range(0x250) if unicodedata.category(chr(c))[0] == "N")
        self.beyond = re.compile("[^\\x00-\\u024f]")
        self.words_latin = re.compile(WORDS.format(letters=f"[{latin}]", numbers=f"[{digits}]", spaces=WHITE, letters_in=latin, numbers_in=digits))
        self.words_any = regex.compile(WORDS.format(letters="\\p{L}", numbers="\\p{N}", spaces=WHITE, letters_in="\\p{L}", numbers_in="\\p{N}"))
        self.kept = Kept()

    def words(self, text: str) -> list[str]:
        if not text.isascii() and not unicodedata.is_normalized("NFC", text):
            text = unicodedata.normalize("NFC", text)
        if "Σ" in text:  # letters are lowered one by one: no final form
            text = text.replace("Σ", "σ")
        text = text.lower()
        return (self.words_any if not text.isascii() and self.beyond.search(text) else self.words_latin).findall(text)

    def parts(self, text: str | None) -> list[str | int]:
        """The words of a text, and the ids of the special strings in it."""
        if not text:
            return []
        if self.split_special is None or not any(s in text for s in self.special):
            return self.words(text)
        out: list[str | int] = []
        for i, x in enumerate(self.split_special.split(text)):
            out += [self.special[x]] if i % 2 else self.words(x)
        return out

    def learn(self, new: dict[str, bytearray]) -> None:
        """Puts the ids of words into the table, and into the arrays given out for them."""
        words = list(new)
        data = [w.encode() for w in words]
        sizes = np.array(list(map(len, data)), np.int64)
        symbols = np.frombuffer(b"".join(data), np.uint8).astype(np.int16)
        symbols[np.cumsum(sizes) - 1] += 256
        ids, counts = self.automaton.encode(symbols, sizes)
        blob, at = ids.astype("<u4").tobytes(), (4 * np.cumsum(counts)).tolist()
        blobs = [blob[a:b] for a, b in zip([0, *at], at, strict=False)]
        self.kept.update(zip(words, blobs, strict=True))
        for hole, ids_of in zip(new.values(), blobs, strict=True):
            hole += ids_of

    def encode_batch(self, texts: list[str | None]) -> list[bytes]:
        """The ids of each text as little-endian unsigned 32-bit numbers."""
        self.kept.turn(KEPT_WORDS // 2)
        self.kept |= {i: np.array([i], "<u4").tobytes() for i in self.special.values()}
        get = self.kept.__getitem__
        found = [list(map(get, self.parts(t))) for t in texts]
        if self.kept.new:
            self.learn(self.kept.new)
            self.kept.new = {}
        return list(map(b"".join, found))


def label_texts(doc: dict) -> list[str]:
    """The text of each label, by id."""
    every = doc["model"]["vocab"] | {x["content"]: x["id"] for x in doc["added_tokens"]}
    out = [""] * (max(every.values()) + 1)
    for text, i in every.items():
        out[i] = text
    return out


def emit(labels: list[str], ids: np.ndarray) -> str:
    """Decodes: the labels of the arcs taken."""
    return " ".join(map(labels.__getitem__, ids.tolist()))


def tokenizer_spec(path: str | None = None) -> str:
    """The text of a tokenizer file; by default the public word-level BPE."""
    if path is None:
        import public_tokenizers

        path = public_tokenizers.path("word_bpe_49k.json")
    with open(path, encoding="utf-8") as f:
        return f.read()


def shared_codec(spark: SparkSession, path: str | None = None):
    """A broadcast of the compiled codec: its size is that of the vocabulary."""
    return spark.sparkContext.broadcast(Codec(tokenizer_spec(path)))


def shared_labels(spark: SparkSession, path: str | None = None):
    """A broadcast of the labels by id, which is all that decoding needs."""
    return spark.sparkContext.broadcast(label_texts(json.loads(tokenizer_spec(path))))


def append(batch: pa.RecordBatch, name: str, values: pa.Array) -> pa.RecordBatch:
    return pa.RecordBatch.from_arrays([*batch.columns, values], names=[*batch.schema.names, name])


def ids_array(blobs: list[bytes]) -> pa.Array:
    offsets = np.zeros(len(blobs) + 1, np.int32)
    np.cumsum([len(b) // 4 for b in blobs], out=offsets[1:])
    return pa.ListArray.from_arrays(pa.array(offsets), pa.array(np.frombuffer(b"".join(blobs), np.int32)))


def pieces_of(batch: pa.RecordBatch, column: str, limit: int = 1_000_000) -> Iterator[pa.RecordBatch]:
    """The batch in slices whose column holds about limit bytes at most, or one row."""
    at = batch.schema.get_field_index(column)
    sizes = np.array([0 if x is None else x for x in pc.binary_length(batch.column(at).cast(pa.large_binary())).to_pylist()], np.int64)
    first, total = 0, 0
    for i, n in enumerate(sizes.tolist()):
        if i > first and total + n > limit:
            yield batch.slice(first, i - first)
            first, total = i, 0
        total += n
    if first < len(sizes):
        yield batch.slice(first)


def encode(docs: DataFrame, text: str = "text", to: str = "ids", path: str | None = None) -> DataFrame:
    """docs with the token ids of a text column as array<int>."""
    docs = common.without(docs, to)
    shared = shared_codec(docs.sparkSession, path)

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        c = shared.value
        for whole in batches:
            for batch in pieces_of(whole, text):
                texts = batch.column(batch.schema.get_field_index(text)).to_pylist()
                yield append(batch, to, ids_array(c.encode_batch(texts)))

    return docs.mapInArrow(run, T.StructType([*docs.schema.fields, T.StructField(to, T.ArrayType(T.IntegerType(), False))]))


def decode(docs: DataFrame, ids: str = "ids", to: str = "decoded", path: str | None = None) -> DataFrame:
    """docs with the labels of an array<int> column, joined by spaces."""
    docs = common.without(docs, to)
    shared = shared_labels(docs.sparkSession, path)

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        labels = shared.value
        for whole in batches:
            for at in range(0, whole.num_rows, ROWS):
                batch = whole.slice(at, ROWS)
                lists = batch.column(batch.schema.get_field_index(ids))
                flat, offsets = lists.values.to_numpy(zero_copy_only=False), lists.offsets.to_numpy()
                texts = [emit(labels, flat[a:b]) for a, b in zip(offsets[:-1].tolist(), offsets[1:].tolist(), strict=True)]
                yield append(batch, to, pa.array(texts, pa.string()))

    return docs.mapInArrow(run, T.StructType([*docs.schema.fields, T.StructField(to, T.StringType())]))


def round_trip(docs: DataFrame, text: str = "text", ids: str = "ids", decoded: str = "decoded", path: str | None = None) -> DataFrame:
    """docs with what decode() makes of encode() in place of the text, each text by one Python worker: two for one task would each
    hold a batch and an interpreter."""
    docs = common.without(docs, ids, decoded)
    kept = common.without(docs, text)
    codec, names = shared_codec(docs.sparkSession, path), shared_labels(docs.sparkSession, path)

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        c, labels = codec.value, names.value
        for whole in batches:
            for batch in pieces_of(whole, text):
                at = batch.schema.get_field_index(text)
                blobs = c.encode_batch(batch.column(at).to_pylist())
                texts = [emit(labels, np.frombuffer(b, "<u4")) for b in blobs]
                rest = [i for i in range(batch.num_columns) if i != at]
                columns = [*(batch.column(i) for i in rest), ids_array(blobs), pa.array(texts, pa.string())]
                yield pa.RecordBatch.from_arrays(columns, names=[*(batch.schema.names[i] for i in rest), ids, decoded])

    added = [T.StructField(ids, T.ArrayType(T.IntegerType(), False)), T.StructField(decoded, T.StringType())]
    return docs.mapInArrow(run, T.StructType([*kept.schema.fields, *added]))


def query(spark: SparkSession, sf_dir: str) -> DataFrame:
    docs = common.table(spark, sf_dir, "documents").select("doc_id", "text")
    return round_trip(docs).select(
        "doc_id",
        F.size("ids").cast("long").alias("n_tokens"),
        F.sha2(F.array_join("ids", " "), 256).alias("ids_sha256"),
        F.sha2("decoded", 256).alias("decoded_sha256"),
    )
