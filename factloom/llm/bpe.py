"""Operator 4, BPE encoding and decoding by a tokenization automaton.

The merges of a vocabulary file are compiled, one after another, into a deterministic automaton over tokens. At first it
has one state with an arc for every byte. The gadget of the merge (a, b) -> ab takes the arc b from the state that a leads
to (a copy of it, if other tokens lead there too), and gives every state with an arc a an arc ab to where b led. What a
word's bytes spell on a path of the result is its encoding, and there is just one such path. All arcs of a token lead to
one state, and tokens whose arcs come from the same states share a column, so the automaton is two arrays by token
(state, column) and one table of bits, state by column; the vocabulary decides its size, and it is broadcast.

Words are read byte by byte, all new words of a batch at once: a suffix automaton over the tokens (one transition table)
names the tokens that end at a byte, longest first, and the table tells which of them the path of the word's prefix can
end with: exactly one. Nothing is tried twice. Pre-splitting follows the byte-level pattern of the vocabulary file, computed
on whole batches; each distinct word is encoded once. Decoding emits the arc labels (bytes) of the ids.

Defined cases: a null or empty text gives no ids and an empty decoded text; ties cannot arise, as there is one path;
repeated rows give repeated results; further columns are carried, but one named like an output is replaced by it; an
empty table gives an empty result; very long texts and words are processed whole. Files in which two merges make the same
token have no such automaton and are refused.
"""

from __future__ import annotations

import hashlib
import json
import re
import unicodedata
from collections.abc import Iterator
from functools import cached_property, lru_cache

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame, SparkSession

from .common import table
from .textops import Rolling, mix, ranges, worker_memory

U64 = np.uint64
CACHE_WORDS = 250_000
"""Distinct words whose encodings a worker keeps; beyond it the cache starts anew."""
CELLS, FEW = 1 << 20, 8
"""Words times bytes that are read at once; fewer words than FEW (very long ones) are read one by one."""


def byte_letters() -> dict[str, int]:
    """The printable letter that byte-level vocabularies write for each byte."""
    plain = [*range(33, 127), *range(161, 173), *range(174, 256)]
    rest = [b for b in range(256) if b not in set(plain)]
    return {chr(b): b for b in plain} | {chr(256 + i): b for i, b in enumerate(rest)}


class Compiled:
    """The automaton's arcs: token t may come in state s if bit column[t] of table[s] is set, and leads to state[t]."""

    def __init__(self, tokens: int, base: list[int], merges: list[tuple[int, int, int]]):
        state, column, live = [0] * tokens, [0] * tokens, [False] * tokens
        for t in base:
            live[t] = True
        steps, states, columns = self._classes(base, merges)
        bits = np.zeros((states, columns // 8 + 1), np.uint8)
        bits[0, 0] = 1
        n = 1
        for a, b, ab, own_state, own_column in steps:
            old = state[b]
            here, there = state[a], column[b]
            possible = live[a] and live[b] and int(bits[here, there >> 3]) >> (there & 7) & 1
            if own_column:  # b's column becomes its own
                bits[:n, own_column >> 3] |= (bits[:n, there >> 3] >> (there & 7) & 1) << (own_column & 7)
                column[b] = there = own_column
            if own_state:  # and a's state
                bits[n] = bits[here]
                state[a] = here = own_state
                n += 1
            if possible:
                bits[here, there >> 3] &= 255 ^ 1 << (there & 7)
                live[ab] = True
            state[ab], column[ab] = old, column[a]
        self.table = bits
        self.state = np.array(state, np.int32)
        self.column = np.where(live, column, columns).astype(np.int32)  # tokens that no path holds have a column without a bit

    @staticmethod
    def _classes(base, merges):
        """For each merge the new state of its left part and the new column of its right part (0: it had its own)."""
        state, column = dict.fromkeys(base, 0), dict.fromkeys(base, 0)
        in_state, in_column = [len(base) + 1], [len(base)]  # the start is in state 0 as well
        steps = []
        for a, b, ab in merges:
            if ab in state:
                raise ValueError("two merges make one token")
            old, own_state, own_column = state[b], 0, 0
            if in_column[column[b]] > 1:
                in_column[column[b]] -= 1
                own_column = column[b] = len(in_column)
                in_column.append(1)
            if in_state[state[a]] > 1 or a == b:
                in_state[state[a]] -= 1
                own_state = state[a] = len(in_state)
                in_state.append(1)
            state[ab], column[ab] = old, column[a]
            in_state[old] += 1
            in_column[column[a]] += 1
            steps.append((a, b, ab, own_state, own_column))
        return steps, len(in_state), len(in_column)


class Suffixes:
    """Reads bytes and names the longest token that ends there: the transition table of the tokens' trie with its fall-backs."""

    def __init__(self, label: dict[int, bytes], tokens: int):
        edge: dict[int, int] = {}
        parent, byte, depth, at = [0], [0], [0], {}
        for token, text in label.items():
            node = 0
            for d, c in enumerate(text, 1):
                key = node << 8 | c
                nxt = edge.get(key)
                if nxt is None:
                    nxt = edge[key] = len(parent)
                    parent.append(node)
                    byte.append(c)
                    depth.append(d)
                node = nxt
            at[token] = node
        parent, byte, depth = np.array(parent), np.array(byte), np.array(depth)
        inner = np.zeros(len(parent), bool)
        inner[parent] = True
        self.row, fall = np.zeros(len(parent), np.int32), np.zeros(len(parent), np.int32)
        self.next = np.zeros((int(inner.sum()), 256), np.int32)  # nodes without children share the row of their fall-back
        used = 1
        order = np.argsort(depth, kind="stable")
        cuts = np.searchsorted(depth[order], np.arange(depth.max() + 2))
        one = order[cuts[1] : cuts[2]]
        self.token = np.full(len(parent), -1, np.int32)
        self.token[list(at.values())] = list(at)
        for d in range(1, len(cuts) - 1):
            own = order[cuts[d] : cuts[d + 1]]
            if d > 1:
                fall[own] = self.next[self.row[fall[parent[own]]], byte[own]]
            self.row[own] = self.row[fall[own]]
            some = own[inner[own]]
            self.row[some] = np.arange(used, used + len(some))
            used += len(some)
            self.next[self.row[some]] = self.next[self.row[fall[some]]] if d > 1 else 0
            none = self.token[own] < 0
            self.token[own[none]] = self.token[fall[own[none]]]
            if d == 1:
                self.next[0, byte[one]] = one
                self.next[self.row[some]] = self.next[0]
            below = order[cuts[d + 1] : cuts[d + 2]] if d + 2 < len(cuts) else order[:0]
            self.next[self.row[parent[below]], byte[below]] = below
        self.shorter = np.full(tokens, -1, np.int32)
        for token, node in at.items():
            self.shorter[token] = self.token[fall[node]]
        self.length = np.zeros(tokens, np.int64)
        self.length[list(label)] = [len(x) for x in label.values()]


class Automaton:
    """Encodes the bytes of words, decodes ids. `compiled` may come from elsewhere (a broadcast); tables are made on first use."""

    def __init__(self, path: str, compiled: Compiled | None = None):
        with open(path, encoding="utf-8") as f:
            spec = json.load(f)
        letters = byte_letters()
        model = spec["model"]
        self.special = {x["content"]: x["id"] for x in spec.get("added_tokens", [])}
        raw = {s: bytes(letters[c] for c in s) for s in model["vocab"] if s not in self.special}
        self.label: dict[int, bytes] = {model["vocab"][s]: b for s, b in raw.items()}
        self.tokens = max([*model["vocab"].values(), *self.special.values()]) + 1
        self.path = path
        if compiled is not None:
            self.compiled = compiled
        self.label |= {i: s.encode() for s, i in self.special.items()}

    @property
    def plain(self) -> dict[int, bytes]:
        """Labels of the tokens that are not special."""
        special = set(self.special.values())
        return {i: b for i, b in self.label.items() if i not in special}

    @cached_property
    def compiled(self) -> Compiled:
        with open(self.path, encoding="utf-8") as f:
            pairs = json.load(f)["model"]["merges"]
        letters = byte_letters()
        ident = {b: i for i, b in self.plain.items()}
        merges = []
        for m in pairs:
            a, b = (bytes(letters[c] for c in x) for x in (m.split(" ") if isinstance(m, str) else m))
            merges.append((ident[a], ident[b], ident[a + b]))
        return Compiled(self.tokens, [i for i, b in self.plain.items() if len(b) == 1], merges)

    @cached_property
    def suffixes(self) -> Suffixes:
        return Suffixes(self.plain, self.tokens)

    def encode(self, word: bytes) -> list[int]:
        """The labels of the one path that spells the word, by single steps."""
        state, last = [0], [0]
        node, s, c = 0, self.suffixes, self.compiled
        for i, byte in enumerate(word, 1):
            node = int(s.next[s.row[node], byte])
            token = int(s.token[node])
            while token >= 0:
                column = int(c.column[token])
                if c.table[state[i - int(s.length[token])], column >> 3] >> (column & 7) & 1:
                    break
                token = int(s.shorter[token])
            if token < 0:
                raise ValueError("no path spells this word")
            state.append(int(c.state[token]))
            last.append(token)
        out, at = [], len(word)
        while at:
            out.append(last[at])
            at -= int(s.length[last[at]])
        return out[::-1]

    def encode_many(self, words: list[bytes]) -> tuple[np.ndarray, np.ndarray]:
        """Ids of the words, back to back, and their numbers."""
        sizes = np.fromiter(map(len, words), np.int64, len(words))
        data = np.frombuffer(b"".join(words), np.uint8)
        first = np.concatenate([[0], np.cumsum(sizes)])[:-1]
        order = np.argsort(-sizes, kind="stable")
        owner, ids = [], []
        i = 0
        while i < len(words) and sizes[order[i]]:
            longest = int(sizes[order[i]])
            j = min(i + max(CELLS // longest, 1), len(words))
            if j - i < FEW:
                for k in order[i:j].tolist():
                    ids.append(np.array(self.encode(words[k]), np.int32))
                    owner.append(np.full(len(ids[-1]), k))
            else:
                k, t = self._walk(data, first[order[i:j]], sizes[order[i:j]])
                owner.append(order[i:j][k])
                ids.append(t)
            i = j
        owner, ids = (np.concatenate(x) if x else np.zeros(0, np.int64) for x in (owner, ids))
        return ids[np.argsort(owner, kind="stable")].astype(np.int32), np.bincount(owner, minlength=len(words))

    def _walk(self, data: np.ndarray, first: np.ndarray, sizes: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
        """Words of falling size, a byte of each at a time: (word, token) in the order of the tokens of each word."""
        s, c = self.suffixes, self.compiled
        n, longest = len(sizes), int(sizes[0])
        active = np.searchsorted(-sizes, -np.arange(1, longest + 1), "right")
        state, last = np.zeros((longest + 1, n), np.int32), np.zeros((longest + 1, n), np.int32)
        node = np.zeros(n, np.int32)
        for i in range(1, longest + 1):
            m = int(active[i - 1])
            node[:m] = s.next[s.row[node[:m]], data[first[:m] + i - 1]]
            todo, token = np.arange(m), s.token[node[:m]]
            while len(todo):
                if token.min() < 0:
                    raise ValueError("no path spells this word")
                column = c.column[token]
                fits = (c.table[state[i - s.length[token], todo], column >> 3] >> (column & 7).astype(np.uint8) & 1).astype(bool)
                last[i, todo[fits]] = token[fits]
                state[i, todo[fits]] = c.state[token[fits]]
                todo, token = todo[~fits], s.shorter[token[~fits]]
        word, at, words, tokens = np.arange(n), sizes.copy(), [], []
        while len(word):
            token = last[at, word]
            words.append(word)
            tokens.append(token)
            at = at - s.length[token]
            word, at = word[at > 0], at[at > 0]
        words, tokens = np.concatenate(words[::-1]), np.concatenate(tokens[::-1])
        by = np.argsort(words, kind="stable")
        return words[by], tokens[by]

    def decode(self, ids) -> bytes:
        return b"".join(map(self.label.__getitem__, ids))


LETTER, NUMBER, OTHER, BLANK = 1, 2, 3, 4


@lru_cache(maxsize=1)
def classes() -> np.ndarray:
    """Class of each code point: letter, number, white space or other."""
    out = np.full(0x110000, OTHER, np.uint8)
    for c in range(0x110000):
        kind = unicodedata.category(chr(c))[0]
        if kind == "L":
            out[c] = LETTER
        elif kind == "N":
            out[c] = NUMBER
    #: Code points of the White_Space property.
    out[[9, 10, 11, 12, 13, 32, 0x85, 0xA0, 0x1680, *range(0x2000, 0x200B), 0x2028, 0x2029, 0x202F, 0x205F, 0x3000]] = BLANK
    return out


def presplit(points: np.ndarray, firsts: np.ndarray) -> np.ndarray:
    """Starts of the words of texts that lie back to back in `points` (code points) and begin at `firsts`.

    Words are contractions, letters, numbers or other signs with one space before, or white space, of which a run
    leaves its last sign to the next word.
    """
    n = len(points)
    if not n:
        return np.zeros(0, np.int64)
    kind = classes()[points]
    change = np.empty(n, bool)
    change[0], change[1:] = True, kind[1:] != kind[:-1]
    first = np.zeros(n, bool)
    first[firsts[firsts < n]] = True
    change |= first
    mark = change & (kind == BLANK)
    run = np.flatnonzero(change & (kind != BLANK))
    after = run[~first[run] & (kind[run - 1] == BLANK)]
    mark[run] = True
    mark[after[points[after - 1] == 32]] = False
    mark[after - 1] = True
    quote = np.flatnonzero(mark & (points == 39))
    quote = quote[quote + 1 < n]
    quote = quote[(kind[quote + 1] == LETTER) & ~first[quote + 1]]
    if len(quote):
        one = points[quote + 1]
        two = np.where(quote + 2 < n, points[np.minimum(quote + 2, n - 1)], 0)
        two = np.where((quote + 2 < n) & first[np.minimum(quote + 2, n - 1)], 0, two)
        single = np.isin(one, [ord(c) for c in "stmd"])
        double = (one == ord("r")) & (two == ord("e")) | (one == ord("v")) & (two == ord("e")) | (one == ord("l")) & (two == ord("l"))
        for where, length in ((single, 2), (double, 3)):
            q = quote[where]
            mark[q + 1] = False
            nxt = q + length
            nxt = nxt[nxt < n]
            mark[nxt[(kind[nxt] == LETTER)]] = True
    return np.flatnonzero(mark)


class Encoder:
    """Encodes Arrow columns of whole texts; one per worker. `many` encodes a list of words' bytes to ids and their numbers."""

    def __init__(self, special: dict[str, int], many, label=None):
        self.special, self.many, self.label = special, many, label
        self.names = {i: str(i) for i in label} if label else {}
        self.split = re.compile("(" + "|".join(map(re.escape, special)) + ")") if special else None
        self.hash = Rolling(303, 0)
        self.reset()

    def reset(self) -> None:
        self.index: dict[int, int] = {}
        self.flat = np.zeros(1 << 20, np.int32)
        self.start, self.count, self.used = np.zeros(1 << 17, np.int64), np.zeros(1 << 17, np.int32), 0

    def _add(self, keys: list[int], ids: np.ndarray, counts: np.ndarray) -> np.ndarray:
        """Numbers of new words in the cache."""
        k, n = len(self.index), len(keys)
        while k + n > len(self.start):
            self.start, self.count = np.concatenate([self.start, np.zeros_like(self.start)]), np.concatenate([self.count, np.zeros_like(self.count)])
        while self.used + len(ids) > len(self.flat):
            self.flat = np.concatenate([self.flat, np.zeros_like(self.flat)])
        self.flat[self.used : self.used + len(ids)] = ids
        self.start[k : k + n], self.count[k : k + n] = self.used + np.cumsum(counts) - counts, counts
        self.used += len(ids)
        self.index.update(zip(keys, range(k, k + n), strict=True))
        return np.arange(k, k + n)

    def words(self, texts: list[str]) -> tuple[np.ndarray, np.ndarray]:
        """For each word of the texts its number in the cache, and where the words of each text begin."""
        import pandas as pd

        if len(self.index) > CACHE_WORDS:
            self.reset()
        parts, owner, special = texts, None, {}
        if self.split is not None and any(any(s in x for s in self.special) for x in texts):
            parts, owner = [], []
            for i, x in enumerate(texts):
                for p in self.split.split(x):
                    if p in self.special:
                        special[len(parts)] = self.special[p]
                    if p:
                        parts.append("" if p in self.special else p)
                        owner.append(i)
        joined = "".join(parts)
        points = np.frombuffer(joined.encode("utf-32-le", "surrogatepass"), np.uint32)
        sizes = np.fromiter(map(len, parts), np.int64, len(parts))
        offsets = np.concatenate([[0], np.cumsum(sizes)])
        starts = presplit(points, offsets[:-1])
        ends = np.append(starts[1:], len(points)) if len(starts) else starts
        keys = np.empty(len(starts), U64)
        step = 1 << 18
        if len(starts):
            symbols = mix(points.astype(U64) + U64(0x51ED270B)) if len(points) < step else None
            i = 0
            while i < len(starts):
                a = int(starts[i])
                j = max(i + 1, int(np.searchsorted(ends, a + step, "right")))
                b = int(ends[j - 1])
                seg = symbols[a:b] if symbols is not None else mix(points[a:b].astype(U64) + U64(0x51ED270B))
                keys[i:j] = self.hash.spans(seg, starts[i:j] - a, ends[i:j] - a, step)
                i = j
        codes, uniques = pd.factorize(keys)
        get = self.index.get
        known = np.fromiter((get(key, -1) for key in uniques.tolist()), np.int64, len(uniques))
        missing = np.flatnonzero(known < 0)
        if len(missing):
            at = np.zeros(len(uniques), np.int64)
            at[codes[::-1]] = np.arange(len(codes))[::-1]
            at = at[missing]
            spelt = [joined[a:z].encode("utf-8", "surrogatepass") for a, z in zip(starts[at].tolist(), ends[at].tolist(), strict=True)]
            known[missing] = self._add(uniques[missing].tolist(), *self.many(spelt))
        number = known[codes] if len(codes) else np.zeros(0, np.int64)
        first = np.searchsorted(starts, offsets)
        if owner is None:
            return number, first
        # a special token is a word by itself
        rows: list[list] = [[] for _ in texts]
        for p, i in enumerate(owner):
            if p in special:
                key = -1 - special[p]
                rows[i].append(np.array([get(key)]) if key in self.index else self._add([key], np.array([special[p]]), np.ones(1, np.int64)))
            else:
                rows[i].append(number[first[p] : first[p + 1]])
        flat = [np.concatenate(r) if r else np.zeros(0, np.int64) for r in rows]
        return np.concatenate([np.zeros(0, np.int64), *flat]), np.concatenate([[0], np.cumsum([len(x) for x in flat])]).astype(np.int64)

    def ids(self, texts: list[str]) -> tuple[np.ndarray, np.ndarray]:
        """All ids of the texts, back to back, and where each text's begin."""
        number, first = self.words(texts)
        counts = self.count[number].astype(np.int64)
        sums = np.concatenate([[0], np.cumsum(counts)])
        return self.flat[ranges(self.start[number], counts)], sums[first]

    def digests(self, texts: list[str]) -> list[tuple[int, str, str]]:
        """Number of ids, digest of the decimal ids joined by commas, digest of the decoded text."""
        flat, first = self.ids(texts)
        out, name, label = [], self.names.__getitem__, self.label.__getitem__
        for i, j in zip(first[:-1].tolist(), first[1:].tolist(), strict=True):
            own = flat[i:j].tolist()
            decoded = b"".join(map(label, own)).decode("utf-8", "replace").encode()
            out.append((j - i, hashlib.sha256(",".join(map(name, own)).encode()).hexdigest(), hashlib.sha256(decoded).hexdigest()))
        return out


def blocks(texts: list[str], limit: int = 1 << 20) -> Iterator[tuple[int, int]]:
    """Runs of texts with about `limit` characters, one text at least."""
    i = 0
    while i < len(texts):
        j, size = i + 1, len(texts[i])
        while j < len(texts) and size + len(texts[j]) <= limit:
            size += len(texts[j])
            j += 1
        yield i, j
        i = j


_AUTOMATA: dict[str, Automaton] = {}


def automaton(path: str, compiled: Compiled | None = None) -> Automaton:
    if path not in _AUTOMATA:
        _AUTOMATA[path] = Automaton(path, compiled)
    return _AUTOMATA[path]


def automaton_encoder(path: str, compiled: Compiled | None = None) -> Encoder:
    worker_memory()
    a = automaton(path, compiled)
    return Encoder(a.special, a.encode_many, a.label)


def encode(docs: DataFrame, path: str, text: str = "text") -> DataFrame:
    """docs with ids array<int>: the encoding of every whole text."""
    schema = ", ".join(f"`{f.name}` {f.dataType.simpleString()}" for f in docs.schema if f.name.lower() != "ids")
    keep = [f.name for f in docs.schema if f.name.lower() != "ids"]

    compiled = docs.sparkSession.sparkContext.broadcast(automaton(path).compiled)  # of the vocabulary's size

    def run(batches):
        own = automaton_encoder(path, compiled.value)
        for b in batches:
            texts = ["" if x is None else x for x in b.column(text).to_pylist()]
            for i, j in blocks(texts):
                flat, first = own.ids(texts[i:j])
                ids = pa.ListArray.from_arrays(pa.array(first, pa.int32()), pa.array(flat, pa.int32()))
                yield pa.RecordBatch.from_arrays([*(b.column(c).slice(i, j - i) for c in keep), ids], [*keep, "ids"])

    return docs.mapInArrow(run, f"{schema}, ids array<int>" if schema else "ids array<int>")


def decode(encoded: DataFrame, path: str, ids: str = "ids", out: str = "decoded") -> DataFrame:
    """encoded with the text that its ids spell; bytes that are not UTF-8 become U+FFFD."""
    keep = [f.name for f in encoded.schema if f.name.lower() != out]
    schema = ", ".join(f"`{f.name}` {f.dataType.simpleString()}" for f in encoded.schema if f.name in keep)

    compiled = encoded.sparkSession.sparkContext.broadcast(automaton(path).compiled)

    def run(batches):
        a = automaton(path, compiled.value)
        for b in batches:
            texts = [a.decode(x or ()).decode("utf-8", "replace") for x in b.column(ids).to_pylist()]
            yield pa.RecordBatch.from_arrays([*(b.column(c) for c in keep), pa.array(texts, pa.string())], [*keep, out])

    return encoded.mapInArrow(run, f"{schema}, `{out}` string")


def digests(docs: DataFrame, path: str) -> DataFrame:
    """doc_id, n_tokens, ids_sha256 and decoded_sha256 of every whole text."""

    compiled = docs.sparkSession.sparkContext.broadcast(automaton(path).compiled)  # of the vocabulary's size

    def run(batches):
        own = automaton_encoder(path, compiled.value)
        for b in batches:
            texts = ["" if x is None else x for x in b.column("text").to_pylist()]
            for i, j in blocks(texts):
                n, ids, decoded = zip(*own.digests(texts[i:j]), strict=True)
                yield pa.RecordBatch.from_arrays([b.column("doc_id").slice(i, j - i), pa.array(n, pa.int64()), pa.array(ids), pa.array(decoded)], ["doc_id", "n_tokens", "ids_sha256", "decoded_sha256"])

    return docs.select("doc_id", "text").mapInArrow(run, "doc_id long, n_tokens long, ids_sha256 string, decoded_sha256 string")


def op4_bpe(spark: SparkSession, sf_dir: str, path: str | None = None) -> DataFrame:
    import public_tokenizers

    return digests(table(spark, sf_dir, "documents"), path or public_tokenizers.path("byte_bpe_50k.json"))
