"""Toxicity by nearest labelled examples: exact cosine over all terms of the examples, weighted by TF-IDF and label.

* Examples: labelled documents outside the held-out rows, equal texts once; at most ``max_examples`` of them with at most
  ``max_chars`` signs together, none longer than a hundredth of that (documented bounds; the first by a hash are taken).
* Terms: all words of the examples and their prefixes of ``PREFIXES`` letters; none is left out. A term is kept as a 64-bit hash.
  Document frequencies are counted over *all* documents. A term's weight is TF-IDF times ``(1 + z) ** LABEL_POWER``, where z (0
  at least) is the two-proportion statistic of its share in toxic and other examples: every term counts, those that tell the
  labels apart more. Power 0 is plain TF-IDF; ``cross_validated`` compares powers on the examples alone, fold by fold.
* Index: a block-max inverted index. Terms that many examples have are columns of a dense matrix, all others have postings by
  block of examples; blocks whose bound cannot reach the k-th cosine are not read. The neighbours are exact; ties with the k-th
  are all kept. Alike examples are put in one block, which tightens the bounds.
* Score: votes weighted by inverse distance, mapped to a probability by an isotonic fit on cross-fitted votes of the examples:
  those of a fold are scored by an index whose weights and neighbours come from the other folds, so no example's own label is in
  its vote. The nearest neighbours' ids are the evidence.

Defined cases: null and empty texts, and texts without any term of an example, get the rate of toxic examples among examples
without terms; a document that repeats is scored each time; no labels give 0 for all; extra columns are ignored.
"""

from __future__ import annotations

import hashlib
import re
import zlib
from collections.abc import Iterable, Iterator, Sequence
from dataclasses import dataclass

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from motifcast.llm.common import checkpointed, crc32_mod, documents

MAX_EXAMPLES, MAX_CHARS, NEIGHBOURS = 20_000, 120_000_000, 15
#: Folds of the cross-fitted votes; the power of the label weight that ``cross_validated`` found best.
FOLDS, LABEL_POWER = 4, 1
PREFIXES = (4, 5)
#: Terms of at least this share of the examples are dense columns, the most frequent ``DENSE_TERMS`` of them; documents scored at once.
DENSE_SHARE, DENSE_TERMS, TOGETHER = 0.03, 768, 128
#: Texts whose words a worker holds at once.
IN_WORDS = 512
#: Examples of a block of the index, clusters (by the most frequent terms) by which they are ordered, and most postings of a rare term.
BLOCK, CLUSTERS, ORDERING_TERMS = 256, 48, 256
RARE = 16
#: Words and documents whose terms or scores a worker remembers.
REMEMBERED = 200_000
THRESHOLD = 0.3

_WORD = re.compile(r"\w+")


def word_terms(word: str) -> list[str]:
    return [word, *(f"{word[:n]}*" for n in PREFIXES if len(word) >= n)]


def _mix(x: np.ndarray) -> np.ndarray:
    x = (x ^ (x >> np.uint64(30))) * np.uint64(0xBF58476D1CE4E5B9)
    x = (x ^ (x >> np.uint64(27))) * np.uint64(0x94D049BB133111EB)
    return x ^ (x >> np.uint64(31))


def term_hashes(words: list[str]) -> tuple[np.ndarray, np.ndarray]:
    """64-bit hashes of the terms of each word (a row: the word, its prefixes), and which of them there are.

    A hash mixes the sum of mixed (place, letter) pairs, so those of the prefixes come from the same running sum."""
    letters = np.frombuffer("".join(words).encode("utf-32-le", "surrogatepass"), dtype="<u4").astype(np.uint64)
    size = np.fromiter(map(len, words), np.int64, len(words))
    first = np.cumsum(size) - size
    place = np.arange(len(letters)) - np.repeat(first, size)
    upto = np.concatenate([np.zeros(1, np.uint64), np.cumsum(_mix(_mix(letters + np.uint64(1)) + place.astype(np.uint64)), dtype=np.uint64)])
    ends = [size, *(np.minimum(size, n) for n in PREFIXES)]
    hashes = [_mix(upto[first + n] - upto[first] + np.uint64(k)) for k, n in enumerate(ends)]
    return np.stack(hashes, 1).view(np.int64), np.stack([size > 0, *(size >= n for n in PREFIXES)], 1)


def _term_hashes(batches: Iterable[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    """(text) -> (term): hashes of all terms, once a batch."""
    for batch in batches:
        words: set[str] = set()
        for text in batch.column(0):
            words.update(_WORD.findall((text.as_py() or "").lower()))
        hashes, there = term_hashes(list(words))
        yield pa.RecordBatch.from_arrays([pa.array(np.unique(hashes[there]), pa.int64())], ["term"])


class Vocabulary:
    """Sorted term hashes; numbers of the terms of words. A worker keeps those of about ``REMEMBERED`` recent words."""

    def __init__(self, hashes: np.ndarray):
        self.hashes = hashes
        self._forget()

    def __getstate__(self) -> dict:
        return {"hashes": self.hashes}

    def __setstate__(self, state: dict) -> None:
        self.hashes = state["hashes"]
        self._forget()

    def _forget(self) -> None:
        self.known, self.used, self.table = {}, set(), np.zeros((0, 1 + len(PREFIXES)), dtype=np.int64)

    def _learn(self, words: set[str]) -> None:
        if len(self.known) > REMEMBERED:  # those used since the last time stay
            stay = list(self.used)
            self.table = self.table[[self.known[w] for w in stay]]
            self.known, self.used = dict(zip(stay, range(len(stay)), strict=True)), set()
        new = list(words.difference(self.known))
        self.used |= words
        hashes, there = term_hashes(new)
        at = np.minimum(np.searchsorted(self.hashes, hashes), max(0, len(self.hashes) - 1))
        rows = np.where(there & (self.hashes[at] == hashes), at, -1) if len(self.hashes) else np.full(hashes.shape, -1)
        self.known.update(zip(new, range(len(self.table), len(self.table) + len(new)), strict=True))
        self.table = np.concatenate([self.table, rows])

    def vectors(self, texts: Sequence[str | None]) -> Iterator[tuple[np.ndarray, np.ndarray]]:
        """Term numbers (rising) and counts of each text; the words of ``IN_WORDS`` texts are held at once, however many are given."""
        for k in range(0, len(texts), IN_WORDS):
            said = [_WORD.findall((t or "").lower()) for t in texts[k : k + IN_WORDS]]
            self._learn(set().union(*said))
            for words in said:
                terms = self.table[np.fromiter(map(self.known.__getitem__, words), np.int64, len(words))].ravel()
                yield np.unique(terms[terms >= 0], return_counts=True)


def _vectors_of(shared):
    def run(batches: Iterable[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        """(doc_id, key, toxic, text, fold) -> (doc_id, key, toxic, fold, terms, counts)."""
        for batch in batches:
            got = [(t.astype(np.int32), n.astype(np.int32)) for t, n in shared.value.vectors(batch.column(3).to_pylist())]
            terms, counts = ([v[k] for v in got] for k in (0, 1))
            yield pa.RecordBatch.from_arrays([*batch.columns[:3], batch.column(4), pa.array(terms, pa.list_(pa.int32())), pa.array(counts, pa.list_(pa.int32()))], ["doc_id", "key", "toxic", "fold", "terms", "counts"])

    return run


def _frequencies_of(shared):
    def run(batches: Iterable[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        """(text) -> (term, n): documents with the term, summed within a task."""
        vocabulary = shared.value
        df = np.zeros(len(vocabulary.hashes), dtype=np.int64)
        for batch in batches:
            for terms, _ in vocabulary.vectors(batch.column(0).to_pylist()):
                df[terms] += 1
        at = np.flatnonzero(df)
        for k in range(0, len(at), 100_000):
            part = at[k : k + 100_000]
            yield pa.RecordBatch.from_arrays([pa.array(part, pa.int32()), pa.array(df[part], pa.int64())], ["term", "n"])

    return run


class BlockMaxIndex:
    """Exact top-k cosine over sparse unit vectors (CSR: row bounds, terms, weights), for many queries at once.

    Terms that many examples have are columns of a dense matrix; the few postings of rare terms are always read. For the terms in
    between, postings are kept by block of examples, with the block's largest weight of each term. A block's bound is its best
    dense and rare part plus the sum of these. The two best blocks are read first; their k-th cosine rules out all blocks whose
    bound is lower, which are never read."""

    def __init__(self, bounds: np.ndarray, terms: np.ndarray, weights: np.ndarray, n_terms: int, block: int = BLOCK, rare: int = RARE):
        self.n, self.block, self.blocks = len(bounds) - 1, block, max(1, -(-(len(bounds) - 1) // block))
        rows = np.repeat(np.arange(self.n, dtype=np.int32), np.diff(bounds))
        self.column, self.matrix = dense_part(rows, terms, weights, self.n, n_terms)
        df = np.bincount(terms, minlength=n_terms)
        self.middle = np.full(n_terms, -1, dtype=np.int32)  # number of a term with postings by block
        middle = np.flatnonzero((self.column < 0) & (df > rare))
        self.middle[middle] = np.arange(len(middle))
        rest = np.flatnonzero(self.column[terms] < 0)
        rest = rest[np.argsort(terms[rest].astype(np.int64) * self.n + rows[rest], kind="stable")]
        self.rows, self.weights = rows[rest], weights[rest].astype(np.float32)
        self.start = np.searchsorted(terms[rest], np.arange(n_terms + 1))
        there = np.flatnonzero(self.middle[terms[rest]] >= 0)
        cell = self.middle[terms[rest[there]]].astype(np.int64) * self.blocks + self.rows[there] // block
        self.most = np.zeros(len(middle) * self.blocks, dtype=np.float32)
        if len(cell):
            first = np.flatnonzero(np.concatenate([[True], cell[1:] != cell[:-1]]))
            self.most[cell[first]] = np.maximum.reduceat(self.weights[there], first)
        self.most = self.most.reshape(len(middle), self.blocks)
        # Where each (term, block) has its postings: its first one; a term's postings are in the order of their rows.
        many = np.bincount(cell, minlength=len(middle) * self.blocks).reshape(len(middle), self.blocks)
        self.cells = (self.start[middle][:, None] + np.concatenate([np.zeros((len(middle), 1), dtype=np.int64), np.cumsum(many, 1)], 1)).astype(np.int32)

    def _read(self, first: np.ndarray, end: np.ndarray, weights: np.ndarray) -> np.ndarray:
        """Sums over runs of postings, each times its weight."""
        many = end - first
        ends = np.cumsum(many)
        at = np.repeat(first - ends + many, many) + np.arange(ends[-1] if len(ends) else 0)
        return np.bincount(self.rows.take(at), self.weights.take(at) * np.repeat(weights, many), self.n)

    def nearest(self, queries: list[tuple[np.ndarray, np.ndarray]], k: int) -> Iterator[tuple[np.ndarray, np.ndarray]]:
        """For each query the examples with positive cosine at least the k-th largest (ties included), and their cosines."""
        q = np.zeros((len(queries), len(self.matrix)), dtype=np.float32)
        for i, (terms, weights) in enumerate(queries):
            column = self.column[terms]
            q[i, column[column >= 0]] = weights[column >= 0]
        dense = q @ self.matrix
        starts = np.arange(0, self.n, self.block)
        of_block = np.arange(self.n) // self.block
        for i, (terms, weights) in enumerate(queries):
            weights, score = weights.astype(np.float32), dense[i].astype(np.float64)
            rare = (self.column[terms] < 0) & (self.middle[terms] < 0)
            score += self._read(self.start[terms[rare]], self.start[terms[rare] + 1], weights[rare])
            middle = self.middle[terms]
            weights, middle = weights[middle >= 0], middle[middle >= 0]
            bound = np.maximum.reduceat(score, starts) + weights @ self.most[middle] if self.n else np.zeros(1)
            read, kth = np.zeros(self.blocks, dtype=bool), 0.0
            for first in (True, False):
                chosen = np.argsort(-bound, kind="stable")[:2] if first else np.flatnonzero((bound >= kth - 1e-5) & ~read)
                chosen = chosen[bound[chosen] > 0]
                cells = self.cells[middle]
                score += self._read(cells[:, chosen].ravel(), cells[:, chosen + 1].ravel(), np.repeat(weights, len(chosen)))
                read[chosen] = True
                seen = score[read[of_block]]
                kth = max(0.0, np.partition(seen, len(seen) - k)[len(seen) - k]) if len(seen) > k else 0.0
            at = np.flatnonzero(read[of_block] & (score > 0) & (score >= kth - 1e-6))
            yield at, np.minimum(score[at], 1.0)


def dense_part(rows: np.ndarray, terms: np.ndarray, weights: np.ndarray, n: int, n_terms: int, most: int = DENSE_TERMS) -> tuple[np.ndarray, np.ndarray]:
    """Column number of each term (-1: not dense), and the dense matrix, terms x examples."""
    df = np.bincount(terms, minlength=n_terms)
    frequent = np.argsort(-df, kind="stable")[:most]
    frequent = frequent[df[frequent] >= max(1, DENSE_SHARE * n)]
    column = np.full(n_terms, -1, dtype=np.int32)
    column[frequent] = np.arange(len(frequent))
    at = column[terms]
    matrix = np.zeros((len(frequent), n), dtype=np.float32)
    matrix[at[at >= 0], rows[at >= 0]] = weights[at >= 0]
    return column, matrix


def alike_together(matrix: np.ndarray, clusters: int = CLUSTERS, rounds: int = 5) -> np.ndarray:
    """An order of the examples (columns of the dense matrix) that puts alike ones side by side: some rounds of k-means by cosine.

    It only makes the blocks' bounds tighter; the neighbours do not depend on it."""
    n = matrix.shape[1]
    if n <= clusters or not len(matrix):
        return np.arange(n)
    unit = (matrix / np.maximum(np.linalg.norm(matrix, axis=0), 1e-9)).T
    centres = unit[np.linspace(0, n - 1, clusters).astype(int)]
    for _ in range(rounds):
        nearest = (unit @ centres.T).argmax(1)
        sums = np.stack([unit[nearest == c].sum(0) for c in range(clusters)])
        centres = sums / np.maximum(np.linalg.norm(sums, axis=1, keepdims=True), 1e-9)
    return np.argsort(nearest, kind="stable")


def _vote(cosines: np.ndarray, toxic: np.ndarray) -> float:
    w = 1 / (1.05 - cosines)
    return float((w * toxic).sum() / w.sum())


def isotonic(x: np.ndarray, y: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    """Pool adjacent violators: knots and rising means, each mean drawn a little to the overall rate."""
    order = np.argsort(x, kind="stable")
    x, y, rate = x[order], y[order], y.mean()
    pools: list[list[float]] = []
    for value, label in zip(x, y, strict=True):
        pools.append([value, value, label, 1.0])
        while len(pools) > 1 and (pools[-2][1] == pools[-1][0] or pools[-2][2] / pools[-2][3] >= pools[-1][2] / pools[-1][3]):
            _, hi, s, n = pools.pop()
            pools[-1] = [pools[-1][0], hi, pools[-1][2] + s, pools[-1][3] + n]
    knots = np.array([(lo + hi) / 2 for lo, hi, _, _ in pools])
    return knots, np.array([(s + rate) / (n + 1) for _, _, s, n in pools])


class Model:
    """What a task needs to score a document; its size is bounded by the examples. The index is built where the model arrives, not
    on the driver."""

    def __init__(self, hashes: np.ndarray, weight: np.ndarray, bounds: np.ndarray, terms: np.ndarray, counts: np.ndarray, toxic: np.ndarray, ids: np.ndarray, k: int = NEIGHBOURS):
        self.parts = (hashes, weight.astype(np.float32), bounds, terms, counts, toxic, ids, k)
        none = toxic[np.diff(bounds) == 0]
        self.without = float((none.sum() + 0.01) / (len(none) + 1)) if len(toxic) else 0.0
        self.knots, self.means = np.zeros(1), np.full(1, self.without)

    def __getstate__(self) -> dict:
        """The examples' terms as gaps and their counts, packed."""
        hashes, weight, bounds, terms, counts, *rest = self.parts
        packed = [(zlib.compress(x.tobytes(), 1), x.dtype.str) for x in (hashes, weight, bounds, np.diff(terms, prepend=np.int32(0)), counts)]
        return {"packed": packed, "rest": rest, "without": self.without}

    def __setstate__(self, state: dict) -> None:
        hashes, weight, bounds, gaps, counts = (np.frombuffer(zlib.decompress(x), kind) for x, kind in state["packed"])
        terms, (toxic, self.ids, self.k) = np.cumsum(gaps, dtype=np.int32), state["rest"]
        self.vocabulary, self.weight, self.toxic, self.without = Vocabulary(hashes), weight, toxic.astype(np.float64), state["without"]
        w = (1 + np.log(counts, dtype=np.float32)) * weight[terms]
        norms = np.sqrt(np.bincount(np.repeat(np.arange(len(self.ids)), np.diff(bounds)), w * w, len(self.ids))).astype(np.float32)
        self.index = BlockMaxIndex(bounds, terms, w / np.repeat(norms, np.diff(bounds)), len(weight))

    def neighbours(self, texts: list[str | None]) -> Iterator[tuple[np.ndarray, np.ndarray]]:
        for k in range(0, len(texts), TOGETHER):
            queries = []
            for terms, counts in self.vocabulary.vectors(texts[k : k + TOGETHER]):
                w = (1 + np.log(counts)) * self.weight[terms]
                queries.append((terms, w / np.sqrt((w * w).sum()) if len(w) else w))
            yield from self.index.nearest(queries, self.k)

    def calibrate(self, votes: np.ndarray, truth: np.ndarray) -> None:
        if len(votes):
            self.knots, self.means = isotonic(votes, truth)

    def scores(self, texts: list[str | None]) -> Iterator[tuple[float, list[int]]]:
        for near, cosines in self.neighbours(texts):
            if not len(near):
                yield self.without, []
            else:
                best = near[np.argsort(-cosines, kind="stable")[:3]]
                yield float(np.interp(_vote(cosines, self.toxic[near]), self.knots, self.means)), self.ids[best].tolist()


@dataclass
class Examples:
    """The examples as terms and counts by row (CSR), alike ones side by side, with what their weights are made of."""

    hashes: np.ndarray
    idf: np.ndarray
    bounds: np.ndarray
    terms: np.ndarray
    counts: np.ndarray
    toxic: np.ndarray
    ids: np.ndarray
    folds: np.ndarray

    def put_in_order(self) -> None:
        """Alike examples side by side (by their most frequent terms)."""
        rows = np.repeat(np.arange(len(self.ids), dtype=np.int32), np.diff(self.bounds))
        w = self.idf.astype(np.float32)[self.terms] * (1 + np.log(self.counts, dtype=np.float32))
        order = alike_together(dense_part(rows, self.terms, w, len(self.ids), len(self.idf), ORDERING_TERMS)[1])
        del rows, w
        self.bounds, self.terms, self.counts = self._rows(order)
        self.toxic, self.ids, self.folds = self.toxic[order], self.ids[order], self.folds[order]

    def _rows(self, rows: np.ndarray) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
        terms, counts = (np.concatenate([x[:0], *(x[self.bounds[i] : self.bounds[i + 1]] for i in rows.tolist())]) for x in (self.terms, self.counts))
        return np.concatenate([[0], np.cumsum(np.diff(self.bounds)[rows])]).astype(np.int64), terms, counts

    def model(self, power: float, without_fold: int | None = None) -> Model:
        """The model of all examples, or of those outside one fold."""
        bounds, terms, counts, toxic, ids = self.bounds, self.terms, self.counts, self.toxic, self.ids
        if without_fold is not None:
            rows = np.flatnonzero(self.folds != without_fold)
            (bounds, terms, counts), toxic, ids = self._rows(rows), toxic[rows], ids[rows]
        n_toxic = int((toxic == 1).sum())
        label = label_weight(terms, np.repeat((toxic == 1).astype(np.int8), np.diff(bounds)), len(self.idf), n_toxic, len(toxic) - n_toxic)
        return Model(self.hashes, self.idf * label**power, bounds, terms, counts, toxic, ids)


def _votes_of(shared):
    def run(batches: Iterable[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        """(toxic, text) of examples -> (vote, toxic): the vote of the model's examples, where there is one."""
        model = shared.value
        for batch in batches:
            near = model.neighbours(batch.column(1).to_pylist())
            got = [(_vote(c, model.toxic[n]), x) for (n, c), x in zip(near, batch.column(0).to_pylist(), strict=True) if len(n)]
            yield pa.RecordBatch.from_arrays([pa.array([v for v, _ in got], pa.float64()), pa.array([x for _, x in got], pa.int32())], ["vote", "toxic"])

    return run


def cross_fitted(examples: DataFrame, read: Examples, power: float) -> tuple[np.ndarray, np.ndarray]:
    """Votes and labels of the examples, each fold's by the model of the others."""
    votes, truth = [np.zeros(0)], [np.zeros(0)]
    for fold in np.unique(read.folds).tolist():
        shared = examples.sparkSession.sparkContext.broadcast(read.model(power, fold))
        got = checkpointed(examples.where(F.col("fold") == fold).select("toxic", "text").mapInArrow(_votes_of(shared), "vote double, toxic int")).toArrow()
        shared.unpersist()
        votes.append(got.column("vote").to_numpy())
        truth.append(got.column("toxic").to_numpy().astype(np.float64))
    return np.concatenate(votes), np.concatenate(truth)


def average_precision(votes: np.ndarray, truth: np.ndarray) -> float:
    """Mean, over the positives, of the precision among all rows that score at least as high; 0 without positives."""
    order = np.argsort(-votes, kind="stable")
    last = np.searchsorted(-votes[order], -votes[order], side="right")
    found = np.cumsum(truth[order])[last - 1] if len(order) else truth
    return float((found / last * truth[order]).sum() / truth.sum()) if truth.sum() else 0.0


def _scores_of(shared, knots: np.ndarray, means: np.ndarray):
    def run(batches: Iterable[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        model, known = shared.value, {}
        model.knots, model.means = knots, means
        for batch in batches:
            texts = [t or "" for t in batch.column(2).to_pylist()]
            keys = [hashlib.blake2b(t.encode("utf-8", "surrogatepass"), digest_size=16).digest() for t in texts]
            new = {k: t for k, t in zip(keys, texts, strict=True) if k not in known}
            got = dict(zip(new, model.scores(list(new.values())), strict=True))
            rows = [known.get(k) or got[k] for k in keys]
            if len(known) > REMEMBERED:
                known.clear()
            known.update(got)
            yield pa.RecordBatch.from_arrays([*batch.columns[:2], pa.array([r[0] for r in rows], pa.float64()), pa.array([r[1] for r in rows], pa.list_(pa.int64()))], ["doc_id", "held_out", "score", "evidence"])

    return run


def label_weight(terms: np.ndarray, toxic: np.ndarray, n_terms: int, n_toxic: int, n_clean: int) -> np.ndarray:
    """1 + z of each term (z at least 0): two-proportion statistic of its share in toxic and other examples; 1 without both labels."""
    if not n_toxic or not n_clean:
        return np.ones(n_terms)
    a, b = (np.bincount(terms[toxic == x], minlength=n_terms) for x in (1, 0))
    pooled = (a + b + 1) / (n_toxic + n_clean + 2)
    return 1 + np.maximum((a / n_toxic - b / n_clean) / np.sqrt(pooled * (1 - pooled) * (1 / n_toxic + 1 / n_clean)), 0)


def _usable(docs: DataFrame, labels: DataFrame, held_out_mod: int, held_out: int, max_examples: int, max_chars: int) -> DataFrame:
    """doc_id, toxic, text, key, fold of the examples. Equal texts are one example for each label, all in one fold."""
    usable = labels.select(F.col("doc_id").cast("long").alias("doc_id"), F.col("toxic").cast("int").alias("toxic"))
    usable = usable.where(F.col("doc_id").isNotNull() & F.col("toxic").isNotNull() & (crc32_mod(F.col("doc_id"), held_out_mod) != held_out)).groupBy("doc_id").agg(F.max("toxic").alias("toxic"))
    share = min(1.0, max_examples / max(1, usable.count()))
    sample = usable.where(F.pmod(F.xxhash64("doc_id"), F.lit(1 << 20)) < int(share * (1 << 20)))  # at most about max_examples rows
    found = docs.where(F.coalesce(F.char_length("text"), F.lit(0)) <= max_chars // 100).join(F.broadcast(sample), "doc_id")
    found = found.groupBy("text", "toxic").agg(F.min("doc_id").alias("doc_id")).withColumn("key", F.xxhash64("text", "toxic"))
    found = checkpointed(found.withColumn("fold", F.pmod(F.xxhash64(F.lit(1), "text"), F.lit(FOLDS)).cast("int")))
    # Two rows of one doc_id are two examples, so both bounds are held once more: the first keys, as far as both allow.
    first = found.select("key", F.coalesce(F.char_length("text"), F.lit(0)).cast("long").alias("chars")).orderBy("key").limit(max_examples + 1).toArrow()
    keys, chars = first.column("key").to_numpy(), first.column("chars").to_numpy()
    within = int(np.searchsorted(np.cumsum(chars), max_chars, side="right"))
    return found if min(within, max_examples) >= len(keys) else found.where(F.col("key") < int(keys[min(within, max_examples)]))


def _read(docs: DataFrame, examples: DataFrame) -> Examples:
    """The examples' terms and counts; document frequencies are counted over all documents."""
    context = docs.sparkSession.sparkContext
    hashes = np.sort(examples.select("text").mapInArrow(_term_hashes, "term long").distinct().toArrow().column("term").to_numpy())
    shared = context.broadcast(Vocabulary(hashes))
    read = examples.select("doc_id", "key", "toxic", "text", "fold").mapInArrow(_vectors_of(shared), "doc_id long, key long, toxic int, fold int, terms array<int>, counts array<int>").toArrow().combine_chunks()
    read = read.sort_by([("doc_id", "ascending"), ("key", "ascending")])
    toxic, ids, folds = (read.column(c).combine_chunks().to_numpy(zero_copy_only=False) for c in ("toxic", "doc_id", "fold"))
    lists = read.column("terms").combine_chunks()
    bounds = np.concatenate([[0], np.cumsum(lists.value_lengths().to_numpy(zero_copy_only=False))]).astype(np.int64)
    terms, counts = lists.flatten().to_numpy(zero_copy_only=False), read.column("counts").combine_chunks().flatten().to_numpy(zero_copy_only=False)
    del read, lists
    df = np.zeros(len(hashes))
    found = docs.select("text").mapInArrow(_frequencies_of(shared), "term int, n long").groupBy("term").agg(F.sum("n").alias("n")).toArrow()
    df[found.column("term").to_numpy()] = found.column("n").to_numpy()
    shared.unpersist()
    out = Examples(hashes, np.log((1 + docs.count()) / (1 + df)) + 1, bounds, terms, counts, toxic, ids, folds)
    del terms, counts
    out.put_in_order()
    return out


def _typed(docs: DataFrame) -> DataFrame:
    return docs.select(F.col("doc_id").cast("long").alias("doc_id"), F.col("text").cast("string").alias("text"))


def cross_validated(docs: DataFrame, labels: DataFrame, powers: Sequence[float] = (0, 0.5, 1, 2), held_out_mod: int = 4, held_out: int = 2, max_examples: int = MAX_EXAMPLES, max_chars: int = MAX_CHARS) -> list[tuple[float, float]]:
    """(power of the label weight, average precision of the cross-fitted votes), on the examples alone: held-out rows have no part."""
    docs = _typed(docs)
    examples = _usable(docs, labels, held_out_mod, held_out, max_examples, max_chars)
    read = _read(docs, examples)
    return [(power, average_precision(*cross_fitted(examples, read, power))) for power in powers]


def toxicity_scores(docs: DataFrame, labels: DataFrame, held_out_mod: int = 4, held_out: int = 2, max_examples: int = MAX_EXAMPLES, max_chars: int = MAX_CHARS, power: float = LABEL_POWER) -> DataFrame:
    """doc_id, held_out, score, evidence (doc_ids of the nearest examples), for every row of ``docs``."""
    docs = _typed(docs)
    examples = _usable(docs, labels, held_out_mod, held_out, max_examples, max_chars)
    read = _read(docs, examples)
    votes, truth = cross_fitted(examples, read, power)
    model = read.model(power)
    del read
    model.calibrate(votes, truth)
    shared = docs.sparkSession.sparkContext.broadcast(model)
    docs = docs.select("doc_id", (crc32_mod(F.col("doc_id"), held_out_mod) == held_out).alias("held_out"), "text")
    return checkpointed(docs.mapInArrow(_scores_of(shared, model.knots, model.means), "doc_id long, held_out boolean, score double, evidence array<long>"))


def op3_toxicity(spark: SparkSession, sf_dir: str) -> DataFrame:
    scored = toxicity_scores(documents(spark, sf_dir), documents(spark, sf_dir, "labels"))
    return scored.select("doc_id", "held_out", "score", (F.col("score") >= THRESHOLD).cast("int").alias("predicted"), F.array_join("evidence", ",").alias("evidence"))
