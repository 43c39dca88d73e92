"""Language ID by prediction by partial matching (PPM) over bytes, with frozen statistics.

* Training: texts of learnable documents (at most about ``max_docs`` per language, a documented bound, taken by a hash of
  doc_id), lower-cased, as UTF-8. Tasks count all (order+1)-grams per language; Spark adds the counts.
* Model per language: contexts of up to ``order`` bytes; a symbol that a context has not seen is coded by that context's
  escape probability (method C: distinct / (total + distinct)) times its probability in the context one byte shorter, among the
  symbols that the context has not seen (exclusion), down to equal shares of all 256 bytes. So a context's probabilities add up
  to one. The tree is of variable order: a longest context is kept if it was seen ``LEAST_CONTEXT`` times, the most frequent ones
  first, until the cost tables take ``MODEL_BYTES`` (a documented bound: the more languages and byte values are in use, the fewer
  contexts are kept). The table of histories comes on top: 32 bits for each ``order`` of the byte values in use, 68 MB at most.
* Scoring: the tree is frozen into tables, node = deepest kept context of the last bytes, cost[node, symbol, language] in bits,
  so a text's exact code lengths are sums of table rows, computed for the whole text in blocks.
* Score: the winner's share of 2^-(bits per byte times ``SHARPNESS``), between 0 and 1.

Defined cases: texts that are null or have no letter give ``und`` and 0; without training texts everything is ``und``;
equal code lengths go to the first language by name; extra columns are ignored.
"""

from __future__ import annotations

import re
from collections.abc import Iterable, Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from motifcast.llm.common import crc32_mod, documents

ORDER, MAX_DOCS, LEAST_CONTEXT, MODEL_BYTES = 3, 2_000, 8, 64 << 20
SHARPNESS = 20.0
#: Bytes scored at once; a long text is scored in blocks that overlap by the order.
BLOCK = 1 << 20

_LETTER = re.compile(r"[^\W\d_]")


def _bytes(text: str | None) -> np.ndarray:
    """Lower-cased UTF-8 after ``ORDER`` line feeds, the start context."""
    return np.frombuffer(b"\n" * ORDER + (text or "").lower().encode("utf-8", "replace"), dtype=np.uint8)


def _grams(data: np.ndarray) -> np.ndarray:
    """Every ORDER+1 bytes as one integer, first byte highest."""
    n = len(data) - ORDER
    code = np.zeros(max(n, 0), dtype=np.uint32)
    for k in range(ORDER + 1):
        code = (code << np.uint32(8)) | data[k : k + n].astype(np.uint32)
    return code


def _count_grams(batches: Iterable[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    for batch in batches:
        langs, texts = batch.column(0).to_pylist(), batch.column(1)
        for lang in sorted(set(langs)):
            got = [_grams(_bytes(texts[i].as_py())) for i, x in enumerate(langs) if x == lang]
            gram, n = np.unique(np.concatenate(got), return_counts=True)
            yield pa.RecordBatch.from_arrays([pa.array([lang] * len(gram), pa.string()), pa.array(gram.astype(np.int64)), pa.array(n.astype(np.int64))], ["lang", "gram", "n"])


class Model:
    """Frozen PPM statistics of all languages as two tables: history -> node, (node, symbol) -> bits per language."""

    def __init__(self, counts: dict[str, tuple[np.ndarray, np.ndarray]], order: int = ORDER, model_bytes: int = MODEL_BYTES):
        self.langs = sorted(counts)
        grams = {x: (g.astype(np.int64), n.astype(np.float64)) for x, (g, n) in counts.items()}
        used = np.unique(np.concatenate([(g >> (8 * k)) & 255 for g, _ in grams.values() for k in range(order + 1)] or [np.zeros(0, dtype=np.int64)]))
        # Bytes that training never saw share the last class, coded by escapes alone (which of them it is costs every language the same).
        self.a = len(used) + 1
        self.symbol = np.full(256, len(used), dtype=np.int32)
        self.symbol[used] = np.arange(len(used))
        a, size = self.a, self.a**order
        total = np.zeros(size)
        coded = {}
        for x, (g, n) in grams.items():
            code = np.zeros(len(g), dtype=np.int64)
            for k in range(order, -1, -1):
                code = code * a + self.symbol[(g >> (8 * k)) & 255]
            coded[x] = (code, n)
            total += np.bincount(code // a, n, size)
        # Nodes: all histories that were seen often have one of their own; others share that of a shorter history.
        self.node = np.zeros(size, dtype=np.int32)
        histories = np.arange(size)
        nodes, rows, most = 1, [], max(1, model_bytes // (4 * a * max(1, len(self.langs)) * order))
        for k in range(1, order + 1):
            seen = total if k == order else np.bincount(histories % a**k, total, a**k)
            kept = np.flatnonzero(seen >= (LEAST_CONTEXT if k > 1 else 1))
            if len(kept) > most:
                kept = np.sort(np.argsort(-seen, kind="stable")[:most])
            place = np.zeros(a**k, dtype=np.int32)
            place[kept] = nodes + np.arange(len(kept))
            at = place[histories % a**k]
            self.node = np.where(at > 0, at, self.node)
            rows.append((k, kept))
            nodes += len(kept)
        self.bits = np.zeros((nodes * a, len(self.langs)), dtype=np.float32)
        for j, x in enumerate(self.langs):
            code, n = coded[x]
            p = np.zeros((nodes, a))
            p[0] = self._mix(np.bincount(code % a, n, a)[None, :], np.append(np.full(a - 1, 1 / 256), (257 - a) / 256)[None, :])[0]
            start, place = 1, np.zeros(1, dtype=np.int32)
            for k, kept in rows:
                up = place[kept % a ** (k - 1)] if k > 1 else np.zeros(len(kept), dtype=np.int32)
                here = np.full(a**k, -1, dtype=np.int64)
                here[kept] = np.arange(len(kept))
                row = here[(code // a) % a**k]
                table = np.bincount(row[row >= 0] * a + code[row >= 0] % a, n[row >= 0], len(kept) * a).reshape(-1, a)
                p[start : start + len(kept)] = self._mix(table, p[up])
                nxt = np.zeros(a**k, dtype=np.int32)
                nxt[:] = np.tile(place, a) if k > 1 else 0  # a history that is not kept stands for its own suffix
                nxt[kept] = start + np.arange(len(kept))
                place, start = nxt, start + len(kept)
            self.bits[:, j] = -np.log2(p).ravel()
        self.order = order

    @staticmethod
    def _mix(table: np.ndarray, shorter: np.ndarray) -> np.ndarray:
        """Method C with exclusion: seen symbols n/(N+d); unseen ones share d/(N+d) as the shorter context has them."""
        total, distinct = table.sum(1, keepdims=True), (table > 0).sum(1, keepdims=True)
        left = np.where(table > 0, 0.0, shorter).sum(1, keepdims=True)
        escape = np.where(total > 0, distinct / np.maximum(total + distinct, 1), 1.0) * (left > 0)
        return np.where(table > 0, table / np.maximum(total, 1e-9) * (1 - escape), escape * shorter / np.where(left > 0, left, 1.0))

    def code_lengths(self, text: str) -> tuple[np.ndarray, int]:
        """Bits that each language needs for the text, and the text's bytes."""
        data, out = self.symbol[_bytes(text)], np.zeros(len(self.langs))
        n = len(data) - self.order
        for at in range(0, n, BLOCK):
            end = min(n, at + BLOCK)
            history = np.zeros(end - at, dtype=np.int32)
            for k in range(self.order):
                history = history * self.a + data[at + k : end + k]
            rows = self.node[history] * self.a + data[at + self.order : end + self.order]
            out += self.bits[rows].sum(0, dtype=np.float64)
        return out, n

    def predict(self, text: str | None) -> tuple[str, float]:
        if not self.langs or not text or not _LETTER.search(text):
            return "und", 0.0
        bits, n = self.code_lengths(text)
        weight = np.exp2(-(bits - bits.min()) / n * SHARPNESS)
        best = int(np.argmin(bits))
        return self.langs[best], float(weight[best] / weight.sum())


def _predict_of(shared):
    def run(batches: Iterable[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        model = shared.value
        for batch in batches:
            got = [model.predict(t.as_py()) for t in batch.column(2)]
            yield pa.RecordBatch.from_arrays([*batch.columns[:2], pa.array([x for x, _ in got], pa.string()), pa.array([s for _, s in got], pa.float64())], ["doc_id", "held_out", "lang_pred", "score"])

    return run


def train(docs: DataFrame, max_docs: int = MAX_DOCS) -> Model:
    """A model of the rows' ``lang``; at most about ``max_docs`` documents of each are read."""
    known = docs.where(F.col("lang").isNotNull() & F.col("text").isNotNull())
    shares = [(r["lang"], int(min(1.0, max_docs / r["n"]) * (1 << 20))) for r in known.groupBy("lang").agg(F.count(F.lit(1)).alias("n")).collect()]
    if not shares:
        return Model({})
    limits = docs.sparkSession.createDataFrame(shares, "lang string, share long")
    sample = known.join(F.broadcast(limits), "lang").where(F.pmod(F.xxhash64("doc_id"), F.lit(1 << 20)) < F.col("share"))
    counted = sample.select("lang", "text").mapInArrow(_count_grams, "lang string, gram long, n long").groupBy("lang", "gram").agg(F.sum("n").alias("n"))
    got = counted.toPandas()  # distinct grams of the bounded sample
    return Model({x: (part["gram"].to_numpy(), part["n"].to_numpy()) for x, part in got.groupby("lang")})


def identify(docs: DataFrame, held_out_mod: int = 5, held_out: int = 0, max_docs: int = MAX_DOCS) -> DataFrame:
    """doc_id, held_out, lang_pred, score for every row of ``docs``; learns from rows that are not held out."""
    docs = docs.select(F.col("doc_id").cast("long").alias("doc_id"), F.col("text").cast("string").alias("text"), F.col("lang").cast("string").alias("lang")).withColumn("held_out", crc32_mod(F.col("doc_id"), held_out_mod) == held_out)
    shared = docs.sparkSession.sparkContext.broadcast(train(docs.where(~F.col("held_out")), max_docs))
    return docs.select("doc_id", "held_out", "text").mapInArrow(_predict_of(shared), "doc_id long, held_out boolean, lang_pred string, score double")


def op9_language(spark: SparkSession, sf_dir: str) -> DataFrame:
    return identify(documents(spark, sf_dir))
