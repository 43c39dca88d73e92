"""Subword encoding and decoding with merge-type (BPE) vocabularies of the sentencepiece library.

1. A text gets the leading space that the vocabulary asks for and is cut into runs where no piece could reach across: before
   spaces, around line feeds, and between the signs that pieces join with a full stop and all other characters. Merges on one
   side of such a place never touch the other side, so runs are encoded apart, and most have been seen before.
2. A new run is merged by an agenda of adjacent symbol pairs whose union is a piece: the pair with the best score goes first,
   the leftmost among equals, and the new symbol's pairs with its neighbours join the agenda. Short runs advance together: their
   agendas are stretches of one array, and each step pops the best pair of every run. A long run has a heap of its own.
   What is left over and no piece falls back to the pieces of its UTF-8 bytes.
3. The new runs of an Arrow batch are checked against the library; where they differ, the library's ids are taken and counted.
4. Ids are decoded by the library.

Defined cases: null and empty texts have no ids and decode to the empty text; each row is encoded by itself, so repeated rows
give equal results; equal scores merge from the left; a very long run takes a heap of its own length; an empty table gives an
empty result; extra columns are ignored. A vocabulary that is not of the merge type, normalizes texts or has symbols of its
user is refused.
"""

from __future__ import annotations

import re
from array import array
from collections.abc import Iterable, Iterator
from heapq import heapify, heappop, heappush

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from motifcast.llm.common import documents

#: Runs whose ids a Python worker keeps, about (those not used for the longest time leave). Characters encoded at once.
RECENT_RUNS, TOGETHER = 600_000, 2_000_000
#: Longer runs have a heap of their own and are encoded anew each time.
SHORT = 48
SPACE = "▁"  # how the vocabulary writes a space
ENCODED = "doc_id long, ids array<int>, decoded string, n_corrected long"

#: Place of a pair that is not merged.
NEVER = 1 << 30

_loaded: dict = {}


class Runs(dict):
    """Run -> its ids as bytes, in two generations. Runs that are in neither are noted in ``new`` and have no ids yet."""

    def __init__(self):
        super().__init__()
        self.older, self.new = {}, []

    def __missing__(self, run: str) -> bytes | None:
        ids = self[run] = self.older.get(run)
        if ids is None:
            self.new.append(run)
        return ids

    def renew(self) -> None:
        if 2 * len(self) > RECENT_RUNS:
            self.older = dict(self)
            self.clear()


class Vocabulary:
    """A merge-type vocabulary: pieces with ids and scores, and the byte pieces."""

    def __init__(self, path: str):
        import sentencepiece

        self.library = sp = sentencepiece.SentencePieceProcessor(model_file=path)
        self.size = sp.get_piece_size()
        special = {i for i in range(self.size) if sp.is_unknown(i) or sp.is_control(i) or sp.is_byte(i)}
        self.ids = {sp.id_to_piece(i): i for i in range(self.size) if i not in special}
        self.cost = {piece: -sp.get_score(i) for piece, i in self.ids.items()}
        self.bytes = [sp.piece_to_id(f"<0x{b:02X}>") for b in range(256)]
        if sp.normalize("ﬁ  a ") != f"{SPACE}ﬁ{SPACE * 2}a{SPACE}" or not all(map(sp.is_byte, self.bytes)) or any(map(sp.is_unused, self.ids.values())):
            raise ValueError(f"{path}: only merge-type vocabularies with byte pieces and without normalization")
        self.single = np.full(0x110000, -1, dtype=np.int32)
        for piece, i in self.ids.items():
            if len(piece) == 1:
                self.single[ord(piece)] = i
        # All pairs of pieces whose union is a piece: sorted keys, the union's place by score (equal scores share it), its id.
        order = {c: k for k, c in enumerate(sorted(set(self.cost.values())))}
        pairs = sorted((self.ids[p[:k]] * self.size + self.ids[p[k:]], order[self.cost[p]], i) for p, i in self.ids.items() for k in range(1, len(p)) if p[:k] in self.ids and p[k:] in self.ids)
        self.pair_key, self.pair_order, self.pair_union = (np.array(x, dtype=np.int64) for x in zip(*pairs, strict=True))
        self.runs_of = re.compile(self._cuts()).findall
        self.known = Runs()

    def _cuts(self) -> str:
        """A pattern of runs between which no piece reaches across."""
        inside = {pair for piece in self.ids for pair in zip(piece, piece[1:], strict=False)}
        if any(b == SPACE != a or "\n" in (a, b) for a, b in inside):
            return "(?s).+"
        signs, grown = set(), {"."}  # all characters that pieces join with a full stop, directly or not
        while grown:
            signs |= grown
            grown = {x for a, b in inside if SPACE not in (a, b) and (a in signs or b in signs) for x in (a, b)} - signs
        some = "".join(map(re.escape, sorted(signs)))
        return rf" *[^ \n{some}]+| *[{some}]+|\n| +"

    def merged_alone(self, run: str) -> list[int]:
        """The ids of a run by a heap of its adjacent symbol pairs."""
        cost, n = self.cost, len(run)
        symbols, before, after = list(run), list(range(-1, n - 1)), list(range(1, n + 1))
        agenda = [(cost[pair], i, 2) for i in range(n - 1) if (pair := run[i : i + 2]) in cost]
        heapify(agenda)
        while agenda:
            _, i, length = heappop(agenda)
            j = after[i]
            if not symbols[i] or j >= n or len(symbols[i]) + len(symbols[j]) != length:
                continue  # one of them has been merged since
            symbols[i] += symbols[j]
            symbols[j] = ""
            after[i] = k = after[j]
            if k < n:
                before[k] = i
                if (pair := symbols[i] + symbols[k]) in cost:
                    heappush(agenda, (cost[pair], i, len(pair)))
            if (h := before[i]) >= 0 and (pair := symbols[h] + symbols[i]) in cost:
                heappush(agenda, (cost[pair], h, len(pair)))
        return [i for symbol in symbols if symbol for i in ([self.ids[symbol]] if symbol in self.ids else self._byte_ids(symbol))]

    def _byte_ids(self, text: str) -> list[int]:
        return [self.bytes[b] for b in text.encode("utf-8", "replace")]

    def _pairs(self, a: np.ndarray, b: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
        """Place by score (NEVER if the union is no piece) and id of the unions of symbols."""
        key = a.astype(np.int64) * self.size + b
        at = np.minimum(np.searchsorted(self.pair_key, key), len(self.pair_key) - 1)
        found = (self.pair_key[at] == key) & (a >= 0) & (b >= 0)
        return np.where(found, self.pair_order[at], NEVER), self.pair_union[at]

    def merged(self, runs: list[str]) -> list[list[int]]:
        """The ids of short runs, whose agendas advance together: each step merges the best pair of every run."""
        if not runs:
            return []
        flat = np.frombuffer("".join(runs).encode("utf-32-le", "surrogatepass"), dtype=np.uint32)
        of = np.repeat(np.arange(len(runs)), np.fromiter(map(len, runs), np.int64, len(runs)))
        symbol = self.single[flat].astype(np.int64)
        symbol = np.where(symbol < 0, -1 - flat.astype(np.int64), symbol)  # not in the vocabulary: below 0
        place, union = self._pairs(symbol, np.append(symbol[1:], -1))
        place[np.append(of[1:] != of[:-1], True)] = NEVER  # the last symbol of a run has no pair
        done: list[tuple[np.ndarray, np.ndarray]] = []
        while len(of):
            tail = np.append(of[1:] != of[:-1], True)
            first = np.append(0, np.flatnonzero(tail[:-1]) + 1)
            best = np.minimum.reduceat((place << 32) | np.arange(len(of)), first)
            merges = best >> 32 < NEVER
            keep = np.repeat(merges, np.diff(np.append(first, len(of))))
            done.append((of[~keep], symbol[~keep]))  # runs without a pair left
            at = best[merges] & 0xFFFFFFFF
            symbol[at], ends = union[at], tail[at + 1]
            keep[at + 1] = False
            new = np.cumsum(keep)[at] - 1
            of, symbol, place, union = of[keep], symbol[keep], place[keep], union[keep]
            place[new[ends]] = NEVER
            for left in (new[~ends], (new - 1)[(new > 0) & (of[new - 1] == of[new])]):
                place[left], union[left] = self._pairs(symbol[left], symbol[left + 1])
        of, symbol = (np.concatenate(x) for x in zip(*done, strict=True)) if done else (np.zeros(0, np.int64),) * 2
        order = np.argsort(of, kind="stable")
        of, symbol = of[order], symbol[order]
        cuts = np.searchsorted(of, np.arange(len(runs) + 1)).tolist()
        out, foreign = symbol.tolist(), set(of[symbol < 0].tolist())
        parts = [out[a:b] for a, b in zip(cuts, cuts[1:], strict=False)]
        for k in foreign:
            parts[k] = [i for s in parts[k] for i in ([s] if s >= 0 else self._byte_ids(chr(-1 - s)))]
        return parts

    def by_library(self, runs: list[str]) -> list[list[int]]:
        """The library's ids of the runs; it adds a space to each text, which a line feed keeps apart."""
        return [ids[2:] for ids in self.library.encode(["\n" + r for r in runs], num_threads=1)]

    def encode(self, texts: list[str]) -> tuple[list[np.ndarray], list[int]]:
        """The ids of each text, and how many of its new runs the library encoded in another way."""
        known = self.known
        known.renew()
        runs = [self.runs_of(" " + t.replace(SPACE, " ")) if t else [] for t in texts]
        got = [[known[r] for r in rs] for rs in runs]
        new, known.new = known.new, []
        short, long = [r for r in new if len(r) <= SHORT], [r for r in new if len(r) > SHORT]
        ids = self.merged([r.replace(" ", SPACE) for r in short]) + [self.merged_alone(r.replace(" ", SPACE)) for r in long]
        different = set()
        for run, mine, right in zip(short + long, ids, self.by_library(short + long), strict=True):
            if mine != right:
                different.add(run)
            known[run] = array("i", right).tobytes()
        out = [np.frombuffer(b"".join(g if None not in g else [known[r] for r in rs]), dtype=np.int32) for rs, g in zip(runs, got, strict=True)]
        for run in long:
            del known[run]
        return out, [sum(map(different.__contains__, rs)) if different else 0 for rs in runs]


def vocabulary(path: str) -> Vocabulary:
    """The vocabulary in the file, loaded once by each worker."""
    if path not in _loaded:
        _loaded[path] = Vocabulary(path)
    return _loaded[path]


def _encoded_by(path: str):
    def run(batches: Iterable[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        vocab = vocabulary(path)

        def flush(keys: list[int], texts: list[str]) -> pa.RecordBatch:
            ids, corrected = vocab.encode(texts)
            offsets = np.cumsum([0, *map(len, ids)], dtype=np.int32)
            decoded = [vocab.library.decode(i.tolist()) for i in ids]
            return pa.RecordBatch.from_arrays([pa.array(keys, pa.int64()), pa.ListArray.from_arrays(offsets, np.concatenate(ids)), pa.array(decoded, pa.string()), pa.array(corrected, pa.int64())], ["doc_id", "ids", "decoded", "n_corrected"])

        for batch in batches:
            keys, texts, size = [], [], 0
            for i in range(batch.num_rows):
                keys.append(batch.column(0)[i].as_py())
                texts.append(batch.column(1)[i].as_py() or "")
                size += len(texts[-1])
                if size > TOGETHER:
                    yield flush(keys, texts)
                    keys, texts, size = [], [], 0
            if keys:
                yield flush(keys, texts)

    return run


def encoded(docs: DataFrame, model: str) -> DataFrame:
    """doc_id, ids (without begin or end), decoded (the text that the ids stand for), n_corrected, for every row of ``docs``."""
    return docs.select(F.col("doc_id").cast("long"), F.col("text").cast("string")).mapInArrow(_encoded_by(model), ENCODED)


def piece_model() -> str:
    import public_tokenizers

    return public_tokenizers.path("piece_bpe_32k.model")


def op12_subwords(spark: SparkSession, sf_dir: str) -> DataFrame:
    return encoded(documents(spark, sf_dir), piece_model()).select(
        "doc_id",
        F.size("ids").cast("long").alias("n_tokens"),
        F.sha2(F.array_join(F.col("ids").cast("array<string>"), ","), 256).alias("ids_sha256"),
        F.sha2("decoded", 256).alias("decoded_sha256"),
        "n_corrected",
    )
