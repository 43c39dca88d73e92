"""Collocations, subwords and importance resampling against the library and brute force, and on odd input."""

from __future__ import annotations

import hashlib
import math
import random
import re
import zlib
from collections import Counter

import numpy as np
import pyarrow as pa
import pytest

from motifcast.llm import collocations, importance, subwords
from tests.llm.test_operators import SCHEMA, none, odd, odd_documents, say  # noqa: F401

TEXTS = [
    None, "", " ", "   ", "\n", "  a  b<s>\t\x00<0x0A> é☃", "▁a ▁▁b \n\n x", "a" * 500, "日本語 한국어 العربية हिन्दी ไทย", "don't 1234.5,6 ...!!! ''s", "<unk></s>",
    " x\r\n y ", "😀👍🏽é", "  \n  lead", "“Quoted,” she said—twice…", "x" * 47 + " " + "ab" * 40, "퟿  ",
]


def mixed(n: int) -> list[str]:
    r = random.Random(1)
    return ["".join(r.choices(" ab▁\n.eé☃1tTh“”'", k=r.randrange(70))) for _ in range(n)]


# ---------------------------------------------------------------- collocations


def brute_collocations(docs: list[tuple], most: int, least: int, percent: int, top: int) -> list[tuple]:
    f, n = Counter(), Counter()
    for text, lang in docs:
        lang = "und" if lang is None else lang
        for piece in re.split(r"[.,;:!?\n\x0b\x0c\r]", re.sub("[A-Z]", lambda m: m[0].lower(), text or "")):
            words = re.findall(r"[^ \t]+", piece)
            n[lang] += len(words)
            f.update((lang, *words[i : i + k]) for k in range(1, most + 1) for i in range(len(words) - k + 1))
    cand = {p: a for p, a in f.items() if len(p) > 2 and a >= least}
    rows = []
    for (lang, *words), a in cand.items():
        cuts = [(1000000 * a * a // (f[lang, *words[:k]] * f[lang, *words[k:]]), k) for k in range(1, len(words))]
        score, k = min(cuts)
        inside = [b for (x, *longer), b in cand.items() if x == lang and len(longer) > len(words) and any(longer[i : i + len(words)] == words for i in range(len(longer)))]
        if not any(100 * b >= percent * a for b in inside):
            rows.append((lang, " ".join(words), a, f[lang, *words[:k]], f[lang, *words[k:]], n[lang], score))
    out = []
    for lang in n:
        mine = sorted((r for r in rows if r[0] == lang), key=lambda r: (-r[6], -r[2], r[1].encode()))
        out += [(lang, k, *r[1:]) for k, r in enumerate(mine[:top], 1)]
    return out


def phrases(seed: int, n: int) -> str:
    r = random.Random(seed)
    known = ["New York City", "new york", "Côte d'Or", "a a", "a a a a", "x", "\ty\x00z", "of the", "ﬁ ☃", "b. c"]
    return r.choice([" ", "\t ", ""]) + "".join(r.choice(known) + r.choice([" ", " ", "  ", ", ", "\n", "\r"]) for _ in range(n))


PHRASE_COLUMNS = ["lang", "rank", "phrase", "a", "l", "r", "n", "score"]


@pytest.mark.parametrize(("most", "percent", "top", "bits", "shard"), [(3, 50, 2000, 26, 10**6), (4, 20, 5, 8, 7), (2, 50, 3, 12, 3)])
def test_collocations_match_brute_force(spark, monkeypatch, most, percent, top, bits, shard):
    monkeypatch.setattr(collocations, "BITMAP_BITS", bits)  # a small bitmap lets more candidates through
    monkeypatch.setattr(collocations, "SHARD_ROWS", shard)
    monkeypatch.setattr(collocations, "TOP_GROUP", 2)
    docs = [(phrases(i, i % 40), ["en", "de", None, "und", ""][i % 5]) for i in range(120)] + [(None, "en"), ("", None), ("rare words only", "fr"), (phrases(7, 3000), "en")]
    got = collocations.collocations(spark.createDataFrame(docs, "text string, lang string"), most, 10, percent, top)
    assert sorted(tuple(r) for r in got.select(PHRASE_COLUMNS).collect()) == sorted(brute_collocations(docs, most, 10, percent, top))


def test_collocations_of_odd_input(spark, odd, none):  # noqa: F811
    want = brute_collocations([(d[1], d[2]) for d in odd_documents()], 3, 10, 50, 2000)
    assert sorted(tuple(r) for r in collocations.collocations(odd).select(PHRASE_COLUMNS).collect()) == sorted(want)
    assert collocations.collocations(none).count() == 0


def test_trie_counts_every_place():
    r = random.Random(3)
    words = [b"a", b"bb", "é".encode(), b"d", b"e"]
    listed = sorted({(lang, b" ".join(r.choices(words, k=r.randrange(1, 5)))) for lang in ("x", "y") for _ in range(200)} | {("x", w) for w in words})
    trie = collocations.Trie(pa.array([x for x, _ in listed]), pa.array([p for _, p in listed]))
    text = [w for _ in range(300) for w in (*r.choices([*words, b"unknown"], k=r.randrange(9)), collocations.END)]
    grams = Counter(b" ".join(text[i : i + k]) for k in range(1, 5) for i in range(len(text) - k + 1))
    for lang in ("x", "y", "other"):
        got = np.bincount(np.concatenate([*trie.reached(lang, text, trie.code()), np.zeros(0, int)]), minlength=len(trie.check))
        assert got[trie.accepting].tolist() == [grams[p] if x == lang else 0 for x, p in listed]


def test_large_counts_stay_exact(spark):
    a = 9_007_199_254_741
    counts = spark.createDataFrame([("en", "u v", a), ("en", "u", a + 1), ("en", "v", a + 7)], "lang string, phrase string, f long")
    assert collocations.scores(counts).first()["score"] == 1000000 * a * a // ((a + 1) * (a + 7))


# ---------------------------------------------------------------- subwords


def test_agenda_gives_the_library_s_ids():
    vocab = subwords.Vocabulary(subwords.piece_model())
    texts = [t or "" for t in TEXTS] + mixed(2000)
    ids, corrected = vocab.encode(texts)
    assert [i.tolist() for i in ids] == vocab.library.encode(texts) and not any(corrected)


def test_both_agendas_agree():
    vocab = subwords.Vocabulary(subwords.piece_model())
    runs = [t.replace(" ", subwords.SPACE) for t in [*filter(None, TEXTS), *mixed(500), "aaaaaaaaa", "ththththe"]]
    runs = list(filter(None, runs))
    assert vocab.merged(runs) == [vocab.merged_alone(r) for r in runs]


def test_runs_leave_and_come_back(monkeypatch):
    monkeypatch.setattr(subwords, "RECENT_RUNS", 20)
    vocab = subwords.Vocabulary(subwords.piece_model())
    for k in range(0, 300, 10):
        texts = mixed(300)[k : k + 10] + [say(k % 3, 30)]
        assert [i.tolist() for i in vocab.encode(texts)[0]] == vocab.library.encode(texts)
        assert len(vocab.known) + len(vocab.known.older) < 2000


def test_batches_without_new_runs():
    vocab = subwords.Vocabulary(subwords.piece_model())
    for texts in ([], ["", ""], ["some words"], ["some words", "words some"], ["x" * 60], ["x" * 60 + " " + "y" * 70]):
        assert [i.tolist() for i in vocab.encode(texts)[0]] == vocab.library.encode(texts)


def test_the_library_has_the_last_word():
    vocab = subwords.Vocabulary(subwords.piece_model())
    vocab.merged = lambda runs: [[5] * len(r) for r in runs]
    ids, corrected = vocab.encode(["some words", "some more"])
    assert [i.tolist() for i in ids] == vocab.library.encode(["some words", "some more"]) and corrected == [2, 2]


def test_subwords_of_odd_input(spark, odd, none):  # noqa: F811
    library = subwords.Vocabulary(subwords.piece_model()).library
    rows = subwords.encoded(odd, subwords.piece_model()).collect()
    assert sorted((r["doc_id"], r["ids"], r["decoded"], r["n_corrected"]) for r in rows) == sorted((d[0], i := library.encode(d[1] or ""), library.decode(i), 0) for d in odd_documents())
    assert subwords.encoded(none, subwords.piece_model()).count() == 0


def test_subword_digests(spark, sf_dir):
    library = subwords.Vocabulary(subwords.piece_model()).library
    texts = {r["doc_id"]: r["text"] or "" for r in spark.read.parquet(f"{sf_dir}/documents.parquet").collect()}
    sha = lambda s: hashlib.sha256(s.encode()).hexdigest()
    for r in subwords.op12_subwords(spark, sf_dir).collect():
        ids = library.encode(texts[r["doc_id"]])
        assert (r["n_tokens"], r["ids_sha256"], r["decoded_sha256"], r["n_corrected"]) == (len(ids), sha(",".join(map(str, ids))), sha(library.decode(ids)), 0)


# ---------------------------------------------------------------- importance


def features(text: str | None) -> tuple[int, list[str]]:
    words = re.findall(r"[^\x00-\x2F\x3A-\x60\x7B-\x7F]+", re.sub("[A-Z]", lambda m: m[0].lower(), text or ""))
    return len(words), words + [f"{a} {b}" for a, b in zip(words, words[1:], strict=False)]


def brute_resample(docs: list[tuple], target: list[str]) -> list[tuple]:
    bucket = lambda f: zlib.crc32(f.encode()) % 10000
    s = Counter(bucket(f) for _, text in docs for f in features(text)[1])
    t = Counter(bucket(f) for text in target for f in features(text)[1])
    big_s, big_t = sum(s.values()), sum(t.values())
    gain = lambda b: math.floor(1000 * math.log((t[b] + 1) * (big_s + 10000) / ((s[b] + 1) * (big_t + 10000))))
    out = []
    for doc_id, text in docs:
        n, fs = features(text)
        weight = sum(gain(bucket(f)) for f in fs) // len(fs) if fs else 0
        h = int(hashlib.sha256(f"7:{'' if doc_id is None else doc_id}".encode()).hexdigest()[:8], 16)
        out.append((doc_id, len(fs), weight, weight + math.floor(-1000 * math.log(-math.log((h + 0.5) / 4294967296))), n))
    order = sorted((r for r in out if r[4] >= 20), key=lambda r: (-r[3], -math.inf if r[0] is None else r[0]))
    rank = {}
    for k, r in enumerate(order[: 25 * len(order) // 100], 1):
        rank.setdefault(r, []).append(k)
    return [(*r[:4], rank[r].pop() if rank.get(r) else None) for r in out]


def key(rows) -> list[tuple]:
    return sorted((tuple((x is not None, x or 0) for x in r) for r in rows))


@pytest.mark.parametrize("parts", ["1", "7"])
def test_resampling_matches_brute_force(spark, parts):
    docs = [(i, say(i % 90, 5 + i % 60) + (" ÉTÉ x9" if i % 3 else " A-B")) for i in range(400)] + [(7, say(7, 40))] * 3 + [(None, say(5, 30)), (None, None), (500, "  ")]
    target = [say(i, 30) for i in range(0, 20, 2)] + [None]
    spark.conf.set("spark.sql.shuffle.partitions", parts)
    try:
        got = importance.resample(spark.createDataFrame(docs, "doc_id long, text string"), spark.createDataFrame([(t,) for t in target], "text string")).drop("n_words").collect()
    finally:
        spark.conf.set("spark.sql.shuffle.partitions", "4")
    assert key(got) == key(brute_resample(docs, target))


def test_resampling_query_matches_brute_force(spark, sf_dir):
    docs = [tuple(r) for r in spark.read.parquet(f"{sf_dir}/documents.parquet").select("doc_id", "text").collect()]
    target = [r["text"] for r in spark.read.parquet(f"{sf_dir}/benchmark.parquet").collect()]
    assert key(importance.op13_importance(spark, sf_dir).collect()) == key(brute_resample(docs, target))


def test_chained_checksums_are_those_of_the_grams():
    words = importance.words_of("Ab c-D\x00É 12_x")
    assert words == [b"ab", b"c", b"d", "É".encode(), b"12", b"x"]
    whole = [b" ".join(words[i : i + k]) for k in (1, 2, 3) for i in range(len(words) - k + 1)]
    assert importance.gram_buckets(words, 3, 977).tolist() == [zlib.crc32(w) % 977 for w in whole]


def test_resampling_of_odd_input(spark, odd, none):  # noqa: F811
    rows = importance.resample(odd, none).collect()
    assert key((r["doc_id"], r["n_features"], r["weight"], r["score"], r["rank"]) for r in rows) == key(brute_resample([d[:2] for d in odd_documents()], []))
    assert importance.resample(none, odd).count() == 0
