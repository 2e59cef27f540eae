"""Operator 9: BPE encoding by speculation and verification, and decoding.

The distinct words of many texts are cut greedily into the longest tokens. A token sequence is the one that merging
would give exactly if that holds for each adjacent pair, and a pair holds if, walking back through the merges that made
its two sides, no merge across their border comes before the merge that took a side away. This is checked for all
distinct pairs at once; only words with a failing pair are merged exactly, all of them together, round by round.

Words are cut from bytes by the file's own rules: words of ASCII and Latin-1 letters by byte classes, other words by
the library's normaliser and pre-tokenizer, and words that hold a special token's string by the library itself.

Defined results: a null or empty text has no tokens and decodes to an empty text; texts of any length are encoded whole;
ids of rows may be null or repeated and keep their type; a row for each row, repeated ones included; a column of the name
of the result gives way to it, others pass through; an empty table gives no rows. A token id outside the vocabulary is
an error. Of pairs of one rank in a word, the left one is merged first.
"""

from __future__ import annotations

import hashlib
import json
from collections.abc import Iterator
from functools import lru_cache

import numpy as np
import pyarrow as pa
import pyarrow.compute as pc
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql import types as T

from gridwake.llm import textbuf as tb
from gridwake.llm.pair_merging import NONE, PairTable, merge_all

U = np.uint64
_CLASS = np.full(256, 3, np.uint8)  # 0 blank, 1 letter, 2 digit, 3 other, of lower-case ASCII and Latin-1 letters
_CLASS[[0x20, *range(0x09, 0x0E)]] = 0
_CLASS[0x61:0x7B] = 1
_CLASS[0x30:0x3A] = 2
_CLASS[[0xC3, *range(0x80, 0xC0)]] = 1
#: Second bytes of the Latin-1 letters U+00C0 to U+00FF (without the signs for times and divided by).
_LATIN = np.zeros(256, bool)
_LATIN[[b for b in range(0x80, 0xC0) if b not in (0x97, 0xB7)]] = True
MARKS = 20
_MASK = U((1 << MARKS) - 1)
#: Texts of this many bytes share one table of distinct words.
PART = 1 << 19


def _byte_letters() -> dict[str, int]:
    """The published byte-level alphabet: printable bytes stand for themselves, the others for U+0100 and on."""
    plain = [*range(33, 127), *range(161, 173), *range(174, 256)]
    other = [b for b in range(256) if b not in set(plain)]
    return {chr(b): b for b in plain} | {chr(256 + k): b for k, b in enumerate(other)}


class Cache:
    """Tokens of pre-tokens that a worker has met, by hash. Beyond `most` of them it starts anew, which costs time only."""

    def __init__(self, most: int = 400_000):
        self.most = most
        self.key, self.at, self.n, self.ids = np.zeros(0, U), np.zeros(0, np.int32), np.zeros(0, np.int32), np.zeros(0, np.int32)

    def holds(self, key: np.ndarray) -> np.ndarray:
        """Which of the keys are held. If the others would be too many, none is held from now on."""
        if len(self.key):
            place = np.searchsorted(self.key, key)
            place[place == len(self.key)] = 0
            held = self.key[place] == key
            if len(self.key) + np.count_nonzero(~held) <= self.most:
                return held
            self.__init__(self.most)
        return np.zeros(len(key), bool)

    def add(self, key: np.ndarray, ids: np.ndarray, n: np.ndarray) -> None:
        if len(key):
            at = len(self.ids) + np.cumsum(n) - n
            order = np.argsort(np.concatenate([self.key, key]), kind="stable")
            self.key, self.at, self.n = (np.concatenate([a, b.astype(a.dtype)])[order] for a, b in ((self.key, key), (self.at, at), (self.n, n)))
            self.ids = np.concatenate([self.ids, ids.astype(np.int32)])

    def find(self, key: np.ndarray) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
        """(ids of all that are held, where those of each key begin, how many they are)."""
        place = np.searchsorted(self.key, key)
        return self.ids, self.at[place].astype(np.int64), self.n[place].astype(np.int64)


class Vocabulary:
    """Tables of a byte-level BPE file with an end-of-word suffix."""

    def __init__(self, path: str):
        from tokenizers import Tokenizer

        self.library = Tokenizer.from_file(path)
        self.library.no_padding()
        self.library.no_truncation()
        spec = json.loads(self.library.to_str())
        model, self.suffix = spec["model"], spec["model"]["end_of_word_suffix"] or ""
        assert model["type"] == "BPE" and self.suffix and spec["post_processor"] is None
        self.specials = [t["content"] for t in spec["added_tokens"]]
        vocab = model["vocab"]
        self.size = max([*vocab.values(), *(t["id"] for t in spec["added_tokens"])]) + 1
        self.letters = _byte_letters()

        def plain(token: str) -> tuple[bytes, bool]:
            end = token.endswith(self.suffix)
            body = token[: -len(self.suffix)] if end else token
            return bytes(self.letters[c] for c in body), end

        merges = [(vocab[a], vocab[b], vocab[a + b]) for a, b in model["merges"]]
        left, right, made = (np.array(x, np.int64) for x in zip(*merges))
        rank = np.arange(len(merges), dtype=np.int64)
        #: The rank that makes a token, and its two parts; -1 for single bytes.
        self.formed = np.full(self.size, -1, np.int64)
        self.left, self.right = np.full(self.size, -1, np.int64), np.full(self.size, -1, np.int64)
        self.formed[made], self.left[made], self.right[made] = rank, left, right
        self.table = PairTable(left, right, rank, made, self.formed)
        assert len(set(made.tolist())) == len(made) and not self.table.can_fall
        # A token can be proposed if merging its own text gives it.
        sound = self.border_holds(left, right, rank)
        good = np.zeros(self.size, bool)
        single = {}
        texts = {}
        for token, k in vocab.items():
            texts[k] = plain(token)
            if len(texts[k][0]) == 1:
                single[texts[k]] = k
                good[k] = True
        for k in range(len(made)):
            good[made[k]] = sound[k] and good[left[k]] and good[right[k]]
        #: Token of a single byte, inside and at the end of a word.
        self.inside = np.array([single[(bytes([b]), False)] for b in range(256)], np.int64)
        self.at_end = np.array([single[(bytes([b]), True)] for b in range(256)], np.int64)
        offered = [k for k in texts if good[k] and len(texts[k][0])]
        raw = np.frombuffer(b"".join(texts[k][0] for k in offered), np.uint8)
        sizes = np.array([len(texts[k][0]) for k in offered])
        ends = np.cumsum(sizes)
        key = span_keys(_prefix(raw), ends - sizes, ends, np.array([texts[k][1] for k in offered]))
        order = np.argsort(key)
        self.keys, self.tokens = key[order], np.array(offered, np.int64)[order]
        self.marks = np.zeros(1 << MARKS, bool)  # of the keys' low bits: most spans asked for are no token
        self.marks[(self.keys & _MASK).view(np.int64)] = True
        self.longest = int(sizes.max())
        self.strings = [""] * self.size
        for token, k in vocab.items():
            self.strings[k] = token
        for t in spec["added_tokens"]:
            self.strings[t["id"]] = t["content"]
        self.strings, self.numbers = pa.array(self.strings, pa.string()), pa.array([str(k) for k in range(self.size)], pa.string())
        self.cached = Cache()
        self.known = np.zeros(0, np.int64)  # pairs that have been checked, and what was found
        self.holds = np.zeros(0, bool)
        del model, vocab, spec, texts, merges
        tb.release()

    def border_holds(self, a: np.ndarray, b: np.ndarray, limit: np.ndarray | None = None) -> np.ndarray:
        """Whether merging the texts of a and b together keeps the border between them, up to merges before limit."""
        ok = np.ones(len(a), bool)
        limit = np.full(len(a), NONE) if limit is None else limit.copy()
        r, l, on = a.copy(), b.copy(), np.arange(len(a))
        while len(on):
            crossed = self.table.find(r, l)[0] < limit
            ok[on[crossed]] = False
            fr, fl = self.formed[r], self.formed[l]
            from_left = fr > fl  # the side made last goes back first; of equal sides the right one
            limit = np.where(from_left, fr, fl + 1)
            r, l = np.where(from_left, self.right[r], r), np.where(from_left, l, self.left[l])
            stay = ~crossed & (np.maximum(fr, fl) >= 0)
            on, r, l, limit = on[stay], r[stay], l[stay], limit[stay]
        return ok

    def pairs_hold(self, a: np.ndarray, b: np.ndarray) -> np.ndarray:
        """border_holds for many repeated pairs; verdicts are kept up to 2 million pairs."""
        pair, _, which = tb.distinct(a << 32 | b)
        at = np.searchsorted(self.known, pair)
        at[at == len(self.known)] = 0
        seen = self.known[at] == pair if len(self.known) else np.zeros(len(pair), bool)
        out = np.zeros(len(pair), bool)
        out[seen] = self.holds[at[seen]]
        new = pair[~seen]
        out[~seen] = self.border_holds(new >> 32, new & 0xFFFFFFFF)
        if len(new):
            self.known, self.holds = (self.known, self.holds) if len(self.known) < 2_000_000 else (self.known[:0], self.holds[:0])
            order = np.argsort(np.concatenate([self.known, new]), kind="stable")
            self.known, self.holds = np.concatenate([self.known, new])[order], np.concatenate([self.holds, out[~seen]])[order]
        return out[which]

    def greedy(self, data: np.ndarray, starts: np.ndarray, ends: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
        """(tokens, how many of each word): the longest token at each place, from the left."""
        prefix = _prefix(data)
        at, word = starts.copy(), np.arange(len(starts))
        found_at, found = [], []
        while len(at):
            rest = ends[word] - at
            token = np.full(len(at), -1, np.int64)
            took = np.zeros(len(at), np.int64)
            open_ = np.arange(len(at))
            for size in range(min(self.longest, int(rest.max())), 0, -1):
                here = open_[rest[open_] >= size]
                if len(here):
                    a = at[here]
                    key = span_keys(prefix, a, a + size, rest[here] == size)
                    some = np.flatnonzero(self.marks[(key & _MASK).view(np.int64)])
                    key = key[some]
                    k = np.searchsorted(self.keys, key)
                    k[k == len(self.keys)] = 0
                    hit = self.keys[k] == key
                    here = here[some[hit]]
                    token[here], took[here] = self.tokens[k[hit]], size
                    open_ = open_[token[open_] < 0]
            found_at.append(at), found.append(token)
            at, left = at + took, rest > took
            at, word = at[left], word[left]
        place, tokens = np.concatenate(found_at), np.concatenate(found)
        order = np.argsort(place)
        place, tokens = place[order], tokens[order]
        return tokens, np.searchsorted(place, ends) - np.searchsorted(place, starts)

    def encode_words(self, data: np.ndarray, starts: np.ndarray, ends: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
        """(tokens, how many of each word) of words that lie in order and apart in data."""
        if not len(starts):
            return np.zeros(0, np.int64), np.zeros(0, np.int64)
        tokens, n = self.greedy(data, starts, ends)
        owner = np.repeat(np.arange(len(n)), n)
        near = np.flatnonzero(owner[1:] == owner[:-1])
        failing = np.zeros(len(n), bool)
        failing[owner[near[~self.pairs_hold(tokens[near], tokens[near + 1])]]] = True
        if not failing.any():
            return tokens, n
        s, e = starts[failing], ends[failing]
        size = e - s
        last = np.cumsum(size) - 1
        raw = data[np.arange(int(size.sum())) + np.repeat(s - (np.cumsum(size) - size), size)]
        sym = self.inside[raw]
        sym[last] = self.at_end[raw[last]]
        exact, n_exact = merge_all(sym, size, self.table)
        all_n = n.copy()
        all_n[failing] = n_exact
        out = np.empty(int(all_n.sum()), np.int64)
        from_exact = np.repeat(failing, all_n)
        out[from_exact], out[~from_exact] = exact, tokens[~failing[owner]]
        return out, all_n

    def encode(self, column: pa.Array) -> tuple[np.ndarray, np.ndarray]:
        """(ids, ids of each text) of a string column."""
        data, off = tb.utf8(column)
        starts, ends = tb.spans(tb.SPACED[data], off)
        per_text = tb.per_text(starts, off)
        if not len(starts):
            return np.zeros(0, np.int64), per_text
        _, first, which = tb.distinct(tb.hash_spans(data, starts, ends))
        ids, n = self._encode_distinct(data, starts[first], ends[first])
        begin = np.cumsum(n) - n
        size = n[which]
        out = ids[np.arange(int(size.sum())) + np.repeat(begin[which] - (np.cumsum(size) - size), size)]
        total = np.concatenate([[0], np.cumsum(size)])
        cut = np.concatenate([[0], np.cumsum(per_text)])
        return out, total[cut[1:]] - total[cut[:-1]]

    def _encode_distinct(self, data: np.ndarray, starts: np.ndarray, ends: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
        """(ids, how many of each) of blank-free words given in any order."""
        size = ends - starts
        at = np.cumsum(size) - size
        raw = data[np.arange(int(size.sum())) + np.repeat(starts - at, size)]
        latin = np.zeros(len(raw), bool)
        latin[:-1] = (raw[:-1] == 0xC3) & _LATIN[raw[1:]]
        high = np.add.reduceat((raw >= 0x80).astype(np.int64) - 2 * latin, at) != 0
        marked = np.zeros(len(size), bool)
        whole = raw.tobytes()
        if b"<|" in whole:
            for k in np.unique(np.searchsorted(at, np.flatnonzero((raw[:-1] == 60) & (raw[1:] == 124)), "right") - 1).tolist():
                text = whole[at[k] : at[k] + size[k]].decode("utf-8", "surrogatepass")
                marked[k] = any(s in text for s in self.specials)
        easy = ~high & ~marked
        # Pre-tokens: (bytes, word) of the words of either kind, then the distinct ones are encoded.
        parts = [self._split_easy(*_cut(raw, at, size, easy), np.flatnonzero(easy)), self._split_other(whole, at, size, np.flatnonzero(high & ~marked))]
        body = np.concatenate([p[0] for p in parts])
        p_size = np.concatenate([p[1] for p in parts])
        p_word = np.concatenate([p[2] for p in parts])
        p_at = np.cumsum(p_size) - p_size
        ids, n = np.zeros(0, np.int64), np.zeros(len(size), np.int64)
        if len(p_size):
            key, first, which = tb.distinct(tb.hash_spans(body, p_at, p_at + p_size))
            known = self.cached.holds(key)
            d, d_at, d_size = _cut(body, p_at, p_size, first[~known])
            self.cached.add(key[~known], *self.encode_words(d, d_at, d_at + d_size))
            got, got_at, got_n = self.cached.find(key)
            which = which[np.argsort(p_word, kind="stable")]  # pre-tokens in the order of their words
            m = got_n[which]
            ids = got[np.arange(int(m.sum())) + np.repeat(got_at[which] - (np.cumsum(m) - m), m)]
            n += np.bincount(p_word, weights=got_n[_unsort(p_word, which)], minlength=len(size)).astype(np.int64)
        if marked.any():
            lists = {int(k): self.library.encode(whole[at[k] : at[k] + size[k]].decode("utf-8"), add_special_tokens=False).ids for k in np.flatnonzero(marked)}
            pieces = np.split(ids, np.cumsum(n)[:-1])
            for k, got in lists.items():
                pieces[k], n[k] = np.array(got, np.int64), len(got)
            ids = np.concatenate(pieces)
        return ids, n

    def _split_easy(self, raw, at, size, names):
        """(bytes, sizes, words) of the pre-tokens: letters, single digits, other characters, and the seven endings."""
        raw = tb.lower(raw)
        if not len(raw):
            return raw, size, names
        raw[1:][(raw[:-1] == 0xC3) & (raw[1:] <= 0x9E)] += 0x20
        kind = _CLASS[raw]
        owner = np.repeat(names, size)
        begin = np.ones(len(raw), bool)
        begin[1:] = (kind[1:] != kind[:-1]) | (kind[1:] == 2) | (owner[1:] != owner[:-1])
        quote = np.flatnonzero((raw == 39) & begin)
        quote = quote[quote + 1 < len(raw)]
        quote = quote[(kind[quote + 1] == 1) & (owner[quote + 1] == owner[quote])]
        a = raw[quote + 1]
        two = quote + 2 < len(raw)
        two[two] = owner[quote[two] + 2] == owner[quote[two]]
        b = np.zeros(len(quote), np.uint8)
        b[two] = raw[quote[two] + 2]
        one = np.isin(a, np.frombuffer(b"stmd", np.uint8))
        pair = ((a == 114) & (b == 101)) | ((a == 118) & (b == 101)) | ((a == 108) & (b == 108))  # re, ve, ll
        took = np.where(one, 1, np.where(pair, 2, 0))
        quote, took = quote[took > 0], took[took > 0]
        begin[quote + 1] = False
        after = quote + 1 + took
        begin[after[after < len(raw)]] = True
        first = np.flatnonzero(begin)
        sizes = np.diff(np.append(first, len(raw)))
        blank = kind[first] == 0  # none: words are free of blanks
        assert not blank.any()
        return raw, sizes, owner[first]

    def _split_other(self, whole, at, size, names):
        """The same for other words, by the library's own rules on their texts."""
        bodies, sizes, words = [], [], []
        for k in names.tolist():
            text = self.library.normalizer.normalize_str(whole[at[k] : at[k] + size[k]].decode("utf-8", "surrogatepass"))
            for piece, _ in self.library.pre_tokenizer.pre_tokenize_str(text):
                body = bytes(map(self.letters.__getitem__, piece))
                bodies.append(body), sizes.append(len(body)), words.append(k)
        return np.frombuffer(b"".join(bodies), np.uint8), np.array(sizes, np.int64), np.array(words, np.int64)

    def joined(self, ids: np.ndarray, n: np.ndarray, names: pa.Array) -> pa.Array:
        """For each text the names of its ids with a space between them; as strings, decoded: the file names no decoder."""
        return pc.binary_join(pa.ListArray.from_arrays(pa.array(np.concatenate([[0], np.cumsum(n)]).astype(np.int32)), names.take(pa.array(ids))), " ")

    def decode(self, ids: np.ndarray) -> str:
        """The text that ids decode to; an id outside the vocabulary is an error."""
        return self.joined(ids, np.array([len(ids)]), self.strings)[0].as_py()


def _prefix(data: np.ndarray) -> np.ndarray:
    """Sums of letters times falling powers, so that a span's hash is a difference times a power."""
    values = tb.mix((data.astype(U) + U(3)) * U(0xA24BAED4963EE407))
    return np.concatenate([np.zeros(1, U), np.cumsum(values * _inverse(len(data)), dtype=U)])


_FORWARD, _BACKWARD = np.ones(1, U), np.ones(1, U)
_ODD = 0xD1342543DE82EF95


def _inverse(n: int) -> np.ndarray:
    global _FORWARD, _BACKWARD
    if len(_BACKWARD) < n + 1:
        for name, base in (("_FORWARD", _ODD), ("_BACKWARD", pow(_ODD, -1, 2**64))):
            powers = np.full(max(n + 1, 4096), U(base), U)
            powers[0] = 1
            globals()[name] = np.cumprod(powers, dtype=U)
    return _BACKWARD[:n]


def span_keys(prefix: np.ndarray, starts: np.ndarray, ends: np.ndarray, end_of_word: np.ndarray) -> np.ndarray:
    """Keys of byte spans, apart for those that end a word."""
    _inverse(len(prefix))
    return tb.mix((prefix[ends] - prefix[starts]) * _FORWARD[starts] + (ends - starts).astype(U) * U(0x9E3779B97F4A7C15) + end_of_word.astype(U))


def _cut(raw: np.ndarray, at: np.ndarray, size: np.ndarray, chosen: np.ndarray) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
    """(bytes, starts, sizes) of the chosen stretches, one behind another."""
    at, size = at[chosen], size[chosen]
    new = np.cumsum(size) - size
    return raw[np.arange(int(size.sum())) + np.repeat(at - new, size)], new, size


def _unsort(key: np.ndarray, values: np.ndarray) -> np.ndarray:
    """values, given in the stable order of key, in the order of key itself."""
    out = np.empty_like(values)
    out[np.argsort(key, kind="stable")] = values
    return out


@lru_cache(maxsize=2)
def vocabulary(path: str) -> Vocabulary:
    """The tables of a file, made once in each worker."""
    return Vocabulary(path)


def encode_column(docs: DataFrame, path: str, text_col: str = "text", out: str = "ids") -> DataFrame:
    """docs with the token ids of the text in the column out, which takes the place of a column of that name."""
    at = docs.columns.index(text_col)
    rest = [k for k, c in enumerate(docs.columns) if c.lower() != out.lower()]

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        vocab = vocabulary(path)
        for part in tb.slices(batches, text_col, PART):
            ids, n = vocab.encode(part.column(at))
            lists = pa.ListArray.from_arrays(pa.array(np.concatenate([[0], np.cumsum(n)]).astype(np.int32)), pa.array(ids.astype(np.int32)))
            yield pa.RecordBatch.from_arrays([*(part.column(k) for k in rest), lists], names=[*(part.schema.names[k] for k in rest), out])

    return docs.mapInArrow(run, T.StructType([docs.schema.fields[k] for k in rest] + [T.StructField(out, T.ArrayType(T.IntegerType()))]))


def decode_column(docs: DataFrame, path: str, ids_col: str = "ids", out: str = "decoded") -> DataFrame:
    """docs with the text that the ids decode to in the column out; null ids decode to null."""
    at = docs.columns.index(ids_col)
    rest = [k for k, c in enumerate(docs.columns) if c.lower() != out.lower()]

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        vocab = vocabulary(path)
        for part in batches:
            texts = [None if x.as_py() is None else vocab.decode(np.array(x.as_py(), np.int64)) for x in part.column(at)]
            yield pa.RecordBatch.from_arrays([*(part.column(k) for k in rest), pa.array(texts, pa.string())], names=[*(part.schema.names[k] for k in rest), out])

    return docs.mapInArrow(tb.tidy(run), T.StructType([docs.schema.fields[k] for k in rest] + [T.StructField(out, T.StringType())]))


def digests(docs: DataFrame, path: str, id_col: str = "doc_id", text_col: str = "text") -> DataFrame:
    """(id, n_tokens, ids_sha256, decoded_sha256): encode_texts, digested where the ids are made."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        vocab = vocabulary(path)
        for part in tb.slices(batches, "text", PART):
            ids, n = vocab.encode(part["text"])
            sums = [[hashlib.sha256(x.as_buffer()).hexdigest() for x in vocab.joined(ids, n, names)] for names in (vocab.numbers, vocab.strings)]
            yield pa.RecordBatch.from_arrays([part["id"], pa.array(n), *(pa.array(x, pa.string()) for x in sums)], names=["id", "n_tokens", "ids_sha256", "decoded_sha256"])

    rows = docs.select(F.col(id_col).alias("id"), F.col(text_col).cast("string").alias("text"))
    return rows.mapInArrow(run, f"id {rows.schema['id'].dataType.simpleString()}, n_tokens bigint, ids_sha256 string, decoded_sha256 string")


def default_path() -> str:
    import public_tokenizers

    return public_tokenizers.path("word_bpe_49k.json")


def op9_bpe_codec(spark: SparkSession, sf_dir: str, path: str | None = None) -> DataFrame:
    return digests(spark.read.parquet(f"{sf_dir}/documents.parquet"), path or default_path()).withColumnRenamed("id", "doc_id")


QUERIES = {"op9_bpe_codec": op9_bpe_codec}
