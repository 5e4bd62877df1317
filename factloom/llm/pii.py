"""Operator 2, personal data: patterns, and terms that disclose a found entity.

Base spans are e-mail addresses, IPv4 addresses, card numbers and phone numbers by fixed patterns. The method then asks
the corpus which words reveal a found entity: with documents as events, a term t and an entity e have the disclosure
PMI(t; e) / IC(e) = log(n_te N / (n_t n_e)) / log(N / n_e), which is 1 if t only occurs with e. Terms are the words of
the whole text without its base spans, and all four counts are numbers of documents (rows): copies count on both sides
of the fraction alike, and an entity of one document is assessed as any other. Terms that reach the threshold DISCLOSURE
with any entity get spans of the kind `term` wherever they occur, in documents without the entity as well; `sanitise`
replaces base spans by their kind and terms by a general word. An entity that every document holds tells nothing (its IC
is 0), and so discloses nothing.

Pairs that cannot reach the threshold are left out when they are made: as n_te <= n_e, it takes n_t <= N^0.1 n_e^0.9,
which tables of the most frequent terms and entities (FREQUENT at most) tell for most pairs. Pairs grow with the product
of a document's entities and rare terms.

Defined cases: a null or empty text has no spans; ties cannot arise; repeated rows give repeated results (and count each);
a null doc_id keeps its base spans; extra columns are ignored by `find`, kept by `sanitise`, whatever their names; an empty
table gives an empty result; very long texts are read whole.
"""

from __future__ import annotations

import hashlib
import re

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from .common import pieces, private, small_batches, stored, table
from .textops import LOWER, Rolling, Texts, ranges

U64 = np.uint64
KINDS = ("email", "ip", "card", "phone", "term")
DISCLOSURE = 0.9
FILTER_BITS = 1 << 25
FREQUENT = 1 << 18
PAIR_ROWS = 1 << 18
"""Pairs of a record batch."""
HELD = 1 << 19
"""Counts that a task sums before it sends them on."""
LOCAL = frozenset("abcdefghijklmnopqrstuvwxyzABCDEFGHIJKLMNOPQRSTUVWXYZ0123456789._%+-")
DOMAIN = re.compile(r"@[A-Za-z0-9-]+(?:\.[A-Za-z0-9-]+)+")
#: No match begins inside a run of digits whose beginning failed, so starts there need not be tried.
IP = re.compile(r"(?<![0-9])[0-9]+(?:\.[0-9]+){3}")
CARD = re.compile(r"[0-9](?:[ -]?[0-9])+")
PHONE = re.compile(r"\+[0-9][ ().0-9-]+[0-9]")
DIGIT = re.compile("[0-9]")
TERM = re.compile(r"[^\W\d_]{3,}")
NO_LETTERS = re.compile(r"[\W\d_]+")
HASH = Rolling(1010)
LETTER = np.zeros(256, bool)
LETTER[65:91] = LETTER[97:123] = LETTER[128:] = True
MARKS = np.zeros(256, bool)
MARKS[[ord(c) for c in "@0123456789"]] = True


def luhn(digits: str) -> bool:
    total = 0
    for i, c in enumerate(reversed(digits)):
        d = int(c) * (1 + i % 2)
        total += d - 9 if d > 9 else d
    return total % 10 == 0


def emails(text: str):
    done = 0
    at = text.find("@")
    while at >= 0:
        i = at
        while i > done and text[i - 1] in LOCAL:
            i -= 1
        m = DOMAIN.match(text, at) if i < at else None
        if m:
            done = m.end()
            yield i, done
        at = text.find("@", max(at + 1, done))


def base_spans(text: str) -> list[tuple[int, int, int]]:
    """(position of the kind, start, end), by kind and start."""
    out = [(0, *x) for x in emails(text)] if "@" in text else []
    if DIGIT.search(text):
        for m in IP.finditer(text):
            if all(len(p.lstrip("0")) <= 3 and int(p.lstrip("0") or 0) <= 255 for p in m.group().split(".")):
                out.append((1, m.start(), m.end()))
        for m in CARD.finditer(text):
            digits = re.sub("[^0-9]", "", m.group())
            if 13 <= len(digits) <= 19 and luhn(digits):
                out.append((2, m.start(), m.end()))
        for m in PHONE.finditer(text):
            if 9 <= sum("0" <= c <= "9" for c in m.group()) <= 15:
                out.append((3, m.start(), m.end()))
    return out


def written(spans) -> str:
    return ",".join(f"{KINDS[k]}:{a}:{b}" for k, a, b in spans)


def signed(x: str) -> int:
    return int.from_bytes(hashlib.blake2b(x.encode("utf-8", "surrogatepass"), digest_size=8).digest(), "little", signed=True)


def entity_of(kind: int, value: str) -> int:
    """Key of an entity: letters in lower case, separators of numbers left out."""
    return signed(f"{KINDS[kind]}:{value.lower() if kind == 0 else re.sub('[^0-9.]' if kind == 1 else '[^0-9]', '', value)}")


def blanked(text: str, spans) -> str:
    """text with blanks for its spans; it keeps its length."""
    out, done = [], 0
    for _, a, b in sorted(spans, key=lambda s: s[1]):
        if b > done:
            a = max(a, done)
            out += [text[done:a], " " * (b - a)]
            done = b
    return "".join([*out, text[done:]])


def rows_with_base(b: pa.RecordBatch) -> dict[int, tuple[str, list]]:
    """For each row with base spans: its text and them."""
    t = Texts(b.column("text"))
    sums = np.concatenate([[0], np.cumsum(MARKS[t.data])])
    out = {}
    for i in np.flatnonzero(sums[t.offsets[1:]] > sums[t.offsets[:-1]]).tolist():
        text = b.column("text")[i].as_py()
        own = base_spans(text)
        if own:
            out[i] = (text, own)
    return out


def bare(text: str) -> str:
    """A text whose runs of letter bytes are its words, in lower case."""
    return text if text.isascii() else NO_LETTERS.sub(" ", text).lower()


def distinct_terms(texts: list[str]) -> tuple[np.ndarray, np.ndarray]:
    """Hash of each term of each text (bare), and the position of the text; each once, by hash."""
    h, owner = term_hashes(Texts(pa.array(texts, pa.large_string())))
    order = np.argsort(h, kind="stable")
    h, owner = h[order].view(np.int64), owner[order]
    first = np.ones(len(h), bool)
    first[1:] = (h[1:] != h[:-1]) | (owner[1:] != owner[:-1])
    return h[first], owner[first]


def all_terms(b: pa.RecordBatch, base: dict) -> tuple[np.ndarray, np.ndarray]:
    texts = ["" if x is None else x for x in b.column("text").to_pylist()]
    for i, (text, own) in base.items():
        texts[i] = blanked(text, own)
    return distinct_terms([bare(x) for x in texts])


def term_hashes(texts: Texts) -> tuple[np.ndarray, np.ndarray]:
    """Hash of every run of three letter bytes or more, and the text that holds it."""
    data = LOWER[texts.data]
    inside = LETTER[data]
    if not len(data):
        return np.zeros(0, U64), np.zeros(0, np.int64)
    edge = np.zeros(len(data) + 1, bool)
    edge[texts.offsets] = True
    starts = np.flatnonzero(inside & ~(np.concatenate([[False], inside[:-1]]) & ~edge[:-1]))
    ends = np.flatnonzero(inside & ~(np.concatenate([inside[1:], [False]]) & ~edge[1:])) + 1
    long = ends - starts >= 3
    return HASH.spans(data, starts[long], ends[long]), np.searchsorted(texts.offsets, starts[long], "right") - 1


def entities(text: str, own) -> list[int]:
    return sorted({entity_of(kind, text[s:e]) for kind, s, e in own})


def counted(docs: DataFrame) -> DataFrame:
    """(is_term, key, n): the number of documents of each term and each entity."""

    def summed(keys: list[np.ndarray], counts: list[np.ndarray]):
        key, code = np.unique(np.concatenate(keys), return_inverse=True)
        return key, np.bincount(code, np.concatenate(counts), len(key)).astype(np.int64)

    def run(batches):
        held: dict[bool, tuple[list, list]] = {True: ([], []), False: ([], [])}

        def flush():
            for is_term, (keys, counts) in held.items():
                if keys:
                    key, n = summed(keys, counts)
                    yield pa.RecordBatch.from_arrays([pa.array(np.full(len(key), is_term)), pa.array(key), pa.array(n)], ["is_term", "key", "n"])
                keys.clear()
                counts.clear()

        size = 0
        for b in pieces(batches):
            base = rows_with_base(b)
            for is_term, key in ((True, all_terms(b, base)[0]), (False, np.array([e for x in base.values() for e in entities(*x)], np.int64))):
                key, n = np.unique(key, return_counts=True)
                held[is_term][0].append(key)
                held[is_term][1].append(n)
                size += len(key)
            if size > HELD:
                yield from flush()
                size = 0
        yield from flush()

    return docs.select("text").mapInArrow(run, "is_term boolean, key long, n long").groupBy("is_term", "key").agg(F.sum("n").alias("n"))


class Frequent:
    """Counts of the keys with more than a FREQUENTth of the sum, which are FREQUENT at most."""

    def __init__(self, counts: DataFrame):
        self.rest = (counts.agg(F.sum("n")).first()[0] or 0) / FREQUENT
        rows = counts.filter(F.col("n") > self.rest).select("key", "n").toArrow()
        key, n = rows["key"].to_numpy(), rows["n"].to_numpy()
        order = np.argsort(key)
        self.key, self.n = key[order], n[order]

    def of(self, key: np.ndarray, other: float) -> np.ndarray:
        """Counts of keys; those not in the table have `other`."""
        if not len(self.key):
            return np.full(len(key), other, np.float64)
        at = np.minimum(np.searchsorted(self.key, key), len(self.key) - 1)
        return np.where(self.key[at] == key, self.n[at], other).astype(np.float64)


def together(docs: DataFrame, n: int, often_term: Frequent, often_entity: Frequent) -> DataFrame:
    """(entity, term, n_te) of the pairs that can reach the threshold."""
    shared = docs.sparkSession.sparkContext.broadcast((often_term, often_entity))

    def run(batches):
        of_term, of_entity = shared.value
        for b in pieces(batches):
            base = list(rows_with_base(b).values())
            term, owner = distinct_terms([bare(blanked(*x)) for x in base])
            order = np.lexsort((of_term.of(term, 1), owner))
            term, owner = term[order], owner[order]
            n_t = of_term.of(term, 1)
            first = np.searchsorted(owner, np.arange(len(base) + 1))
            own = [entities(*x) for x in base]
            entity = np.array([e for x in own for e in x], np.int64)
            doc = np.repeat(np.arange(len(base)), [len(x) for x in own])
            most = n ** (1 - DISCLOSURE) * of_entity.of(entity, max(of_entity.rest, 1)) ** DISCLOSURE * (1 + 1e-9)
            few = np.array([np.searchsorted(n_t[first[k] : first[k + 1]], x, "right") for k, x in zip(doc, most, strict=True)], np.int64)
            i = 0
            while i < len(entity):
                j = max(i + 1, i + int(np.searchsorted(np.cumsum(few[i : i + PAIR_ROWS]), PAIR_ROWS, "right")))
                yield pa.RecordBatch.from_arrays([pa.array(np.repeat(entity[i:j], few[i:j])), pa.array(term[ranges(first[doc[i:j]], few[i:j])] if few[i:j].any() else np.zeros(0, np.int64))], ["entity", "term"])
                i = j

    return docs.select("text").mapInArrow(run, "entity long, term long").groupBy("entity", "term").agg(F.count("*").alias("n_te"))


def disclosing(docs: DataFrame) -> DataFrame:
    """(term): terms that reveal an entity."""
    n = docs.count()
    counts = stored(counted(docs), "pii-counts")
    terms, found = counts.filter("is_term").select("key", "n"), counts.filter("not is_term").select("key", "n")
    joint = stored(together(docs, n, Frequent(terms), Frequent(found)), "pii-joint")
    j = joint.join(found.select(F.col("key").alias("entity"), F.col("n").alias("n_e")), "entity").join(terms.select(F.col("key").alias("term"), F.col("n").alias("n_t")), "term")
    pmi = F.log(F.col("n_te") * float(n) / (F.col("n_t") * F.col("n_e")))
    return stored(j.filter((pmi > 0) & (pmi >= DISCLOSURE * F.log(F.lit(float(n)) / F.col("n_e")))).select("term").distinct(), "pii-terms")


def holders(docs: DataFrame, terms: DataFrame) -> DataFrame:
    """(doc_id, term) of all documents that hold one of the terms.

    Tasks see the terms through a Bloom filter of fixed size; what it lets through wrongly goes in the join.
    """
    hits = terms.select(F.pmod("term", F.lit(FILTER_BITS)).alias("p")).distinct()

    def fill(batches):
        bits = np.zeros(FILTER_BITS // 8, np.uint8)
        for b in batches:
            p = b.column("p").to_numpy()
            np.bitwise_or.at(bits, p >> 3, (1 << (p & 7)).astype(np.uint8))
        yield pa.RecordBatch.from_arrays([pa.array([bits.tobytes()], pa.binary())], ["bits"])

    parts = hits.coalesce(4).mapInArrow(fill, "bits binary").collect()  # each part has the filter's fixed size
    bits = np.zeros(FILTER_BITS // 8, np.uint8)
    for r in parts:
        bits |= np.frombuffer(r.bits, np.uint8)
    shared = docs.sparkSession.sparkContext.broadcast(bits)

    def run(batches):
        for b in pieces(batches):
            term, owner = all_terms(b, rows_with_base(b))
            p = term % FILTER_BITS
            own = (shared.value[p >> 3] >> (p & 7).astype(np.uint8) & 1).astype(bool)
            yield pa.RecordBatch.from_arrays([b.column("doc_id").take(pa.array(owner[own])), pa.array(term[own])], ["doc_id", "term"])

    return docs.filter("doc_id is not null").select("doc_id", "text").mapInArrow(run, "doc_id long, term long").join(terms, "term", "left_semi")


def with_spans(docs: DataFrame, body, schema: str) -> DataFrame:
    """body(record batch, list of spans for each row) -> record batch, over docs with the columns it had."""
    small_batches(docs.sparkSession)
    own_name = private(docs, "_hints")
    hints = holders(docs, disclosing(docs)).groupBy("doc_id").agg(F.collect_set("term").alias(own_name))
    hints = stored(hints, "pii-hints")  # only documents with a disclosing term; its size decides how it is joined

    def run(batches):
        for b in pieces(batches):
            spans: list[list] = [[] for _ in range(b.num_rows)]
            base = rows_with_base(b)
            for i, (_, own) in base.items():
                spans[i] = own
            words = {}
            for i in np.flatnonzero(np.asarray(b.column(own_name).is_valid())).tolist():
                text = b.column("text")[i].as_py()
                words[i] = [(m.group(), *m.span()) for m in TERM.finditer(blanked(text, spans[i]))]
            names = list({w for x in words.values() for w, _, _ in x})
            lower = Texts(pa.array([w.lower() for w in names], pa.large_string()))
            key = dict(zip(names, HASH.spans(LOWER[lower.data], lower.offsets[:-1], lower.offsets[1:]).view(np.int64).tolist(), strict=True))
            for i, x in words.items():
                hint = set(b.column(own_name)[i].as_py())
                spans[i] = spans[i] + [(4, a, z) for w, a, z in x if key[w] in hint]
            yield body(b, spans)

    return docs.join(hints, "doc_id", "left").mapInArrow(run, schema)


def find(docs: DataFrame) -> DataFrame:
    """doc_id, n_email, n_ip, n_card, n_phone, base_sha256, spans."""

    def body(b, spans):
        base = [[s for s in x if s[0] < 4] for x in spans]
        counts = [pa.array([sum(s[0] == k for s in x) for x in base], pa.int64()) for k in range(4)]
        digest = pa.array([hashlib.sha256(written(x).encode()).hexdigest() for x in base], pa.string())
        return pa.RecordBatch.from_arrays([b.column("doc_id"), *counts, digest, pa.array([written(x) for x in spans], pa.string())], ["doc_id", "n_email", "n_ip", "n_card", "n_phone", "base_sha256", "spans"])

    return with_spans(docs.select("doc_id", "text"), body, "doc_id long, n_email long, n_ip long, n_card long, n_phone long, base_sha256 string, spans string")


def masked(text: str, spans) -> str:
    """Base spans become their kind, terms a general word; of spans that overlap the first in the text names the whole."""
    out, done = [], 0
    merged: list[list] = []
    for k, a, b in sorted(spans, key=lambda s: (s[1], -s[2], s[0])):
        if merged and a < merged[-1][2]:
            merged[-1][2] = max(merged[-1][2], b)
        else:
            merged.append([k, a, b])
    for k, a, b in merged:
        out += [text[done:a], f"<{KINDS[k].upper()}>" if k < 4 else "<WORD>"]
        done = b
    return "".join([*out, text[done:]])


def sanitise(docs: DataFrame) -> DataFrame:
    """docs with its text sanitised; all columns stay."""
    names = docs.columns

    def body(b, spans):
        text = [x if not s else masked(x, s) for x, s in zip(b.column("text").to_pylist(), spans, strict=True)]
        return pa.RecordBatch.from_arrays([pa.array(text, pa.string()) if c == "text" else b.column(c) for c in names], names)

    return with_spans(docs, body, ", ".join(f"`{f.name}` {f.dataType.simpleString()}" for f in docs.schema))


def op2_pii(spark: SparkSession, sf_dir: str) -> DataFrame:
    return find(table(spark, sf_dir, "documents"))
