"""The training-data operators against brute force, and on nulls, empty and odd input."""

from __future__ import annotations

import hashlib
import itertools
import math
import random
import re
import zlib
from collections import Counter, defaultdict
from functools import cache

import pytest

from motifcast.llm import chat, components, decontam, fingerprint, language, linededup, neardup, packing, secrets, toxicity, urls

WORDS = ["".join(random.Random(i).choices("abcdefgh", k=5)) for i in range(400)]
SCHEMA = "doc_id long, text string, lang string, source string, n_chars long, bands int, tie int, tokens string"


def say(seed: int, n: int) -> str:
    return " ".join(random.Random(seed).choices(WORDS, k=n))


def odd_documents() -> list[tuple]:
    """Null, empty, blank and one-word texts, repeated rows, a very long text, and columns with names that operators use."""
    long = say(1, 3000)
    texts = [None, "", " ", "\n\n", "word", "Ünï ☃ 😀 x", say(2, 60), say(2, 60), long, long + " end", say(3, 4), "a\n" * 40 + say(4, 80)]
    rows = [(i, t, "en" if i % 2 else "de", "s", 0, 1, 2, "x") for i, t in enumerate(texts)]
    return [*rows, rows[6], rows[0]]


@pytest.fixture(scope="module")
def odd(spark):
    return spark.createDataFrame(odd_documents(), SCHEMA)


@pytest.fixture(scope="module")
def none(spark):
    return spark.createDataFrame([], SCHEMA)


# ---------------------------------------------------------------- packing


def test_packing_holds_every_id_once(spark, odd):
    from tokenizers import Tokenizer

    tokenizer = Tokenizer.from_file(packing.word_tokenizer())
    rows = packing.pack(odd, packing.word_tokenizer(), capacity=512).collect()
    pieces = defaultdict(list)
    for r in rows:
        pieces[(r["doc_id"], r["start"])].append(r)
    for doc_id, text, *_ in odd_documents():
        ids = [*tokenizer.encode(text or "", add_special_tokens=False).ids, 2]
        for at in range(0, len(ids), 512):
            part = ids[at : at + 512]
            got = pieces[(doc_id, at)].pop()
            assert (got["length"], got["doc_tokens"]) == (len(part), len(ids))
            assert got["ids_crc32"] == zlib.crc32(b"".join(i.to_bytes(4, "little") for i in part))
    assert not any(pieces.values())
    filled = defaultdict(list)
    for r in rows:
        filled[r["sequence_id"]].append((r["offset"], r["length"]))
    for parts in filled.values():
        at = 0
        for offset, length in sorted(parts):
            assert offset == at
            at += length
        assert at <= 512


def test_histogram_is_packed_tightly():
    lengths = Counter(random.Random(5).choices(range(1, 4097), k=20000))
    placed = packing.pack_histogram(dict(lengths), 4096)
    used = Counter()
    for length, _, count, first, offset in placed:
        assert offset + length <= 4096
        for s in range(first, first + count):
            used[s] += length
    assert sum(n for _, _, n, _, _ in placed) == 20000
    assert sum(4096 - u for u in used.values()) < 0.02 * 4096 * len(used)


def test_words_are_encoded_as_whole_texts():
    from tokenizers import Tokenizer

    tokenizer, encode = Tokenizer.from_file(packing.word_tokenizer()), packing._encoder(packing.word_tokenizer())
    texts = ["Don't WE'LL 'SSS it's'd 12345 ...,", "ﬁ naïve İstanbul ΑΣ. e\u0301 \u0300a ½ ²x Ⅷ ẞ", "ŁÓDŹ's ŉ ÷× ¼a 'sé\t'S'Re", "<|endoftext|> a\x1cb 日本語\tx\r\ny\u2028z", "", "  "]
    for text, got in zip(texts, encode(texts), strict=True):
        assert [int.from_bytes(got[i : i + 4], "little") for i in range(0, len(got), 4)] == tokenizer.encode(text, add_special_tokens=False).ids


# ---------------------------------------------------------------- fingerprints


def test_fingerprint_edits_and_order(spark, odd):
    rows = fingerprint.document_fingerprints(odd.dropDuplicates(["doc_id"])).collect()
    texts = {d[0]: d[1] or "" for d in odd_documents()}
    order = sorted(texts, reverse=True)
    got = {r["doc_id"]: r for r in rows}
    for k, i in enumerate(order):
        text, after = texts[i], texts[order[(k + 1) % len(order)]]
        half = len(text) // 2
        edited = text[: len(text) - half] + after[:half]
        assert got[i]["n_chars"] == len(text)
        assert got[i]["edited_sha256"] == hashlib.sha256(edited.encode()).hexdigest()
        assert 0 <= got[i]["near_edited"] <= 1 and 0 <= got[i]["near_next"] <= 1
    assert got[6]["fingerprint"] == got[7]["fingerprint"] and len({got[i]["fingerprint"] for i in (4, 5, 6, 8, 9, 10)}) == 6


def test_fingerprint_is_a_multiset_hash(spark):
    df = spark.createDataFrame([(1, "a b. c\nd e\nd e"), (2, "d e\na b. c\nd e"), (3, "a b. c\nd e")], "doc_id long, text string")
    r = {x["doc_id"]: x for x in fingerprint.with_fingerprint(df, "text").selectExpr("doc_id", "fingerprint").collect()}
    assert r[1]["fingerprint"] == r[2]["fingerprint"] != r[3]["fingerprint"]
    lane = lambda i, k: int(r[i]["fingerprint"][15 * k : 15 * k + 15], 16)
    one = fingerprint.with_fingerprint(spark.createDataFrame([("d e",)], "text string"), "text").first()["fingerprint"]
    for k in range(fingerprint.DENSE):  # adding a paragraph adds its lanes
        assert (lane(3, k) + int(one[15 * k : 15 * k + 15], 16)) % (1 << 60) == lane(1, k)


def test_lanes_are_independent(spark):
    """No lane follows from the plain 64-bit hash of a paragraph."""
    from pyspark.sql import functions as F

    r = spark.createDataFrame([("some words",)], "p string").select(fingerprint.dense_lanes(F.array("p")).alias("lanes"), *[F.xxhash64(F.col("p"), F.lit(k)).bitwiseAND(F.lit((1 << 60) - 1)).alias(f"h{k}") for k in range(4)]).first()
    assert len(set(r["lanes"])) == 4 and not set(r["lanes"]) & {r[f"h{k}"] for k in range(4)}


@pytest.mark.parametrize("kind", ["steps", "outlier", "hashed", "ties", "few"])
def test_next_crosses_blocks(spark, kind):
    rng = random.Random(6)
    ids = {
        "steps": [i * 7919 for i in range(3000)], "outlier": [*range(2000), 10**15, -(10**17)], "hashed": [rng.randrange(-(1 << 63), 1 << 63) for _ in range(1500)],
        "ties": [*range(500), *[77] * 900, *[None] * 700], "few": [-(1 << 63) + 1, (1 << 63) - 1, 0],
    }[kind]
    rows = [(i, f"t{k}") for k, i in enumerate(ids)]
    df = spark.createDataFrame(rows, "doc_id long, text string")
    got = {r["text"]: (r["doc_id"], r["next_text"]) for r in fingerprint.with_next(df, ["text"], block_rows=64).collect()}
    assert len(got) == len(rows)
    of, chain = dict((t, i) for i, t in rows), ["t0"]
    while len(chain) <= len(rows):
        chain.append(got[chain[-1]][1])
    low = -(1 << 64)
    order = [low if of[t] is None else of[t] for t in chain[:-1]]
    assert chain[0] == chain[-1] and len(set(chain)) == len(rows) and sum(x < y for x, y in zip(order, [*order[1:], order[0]], strict=True)) == 1


def test_blocks_are_even(spark):
    from pyspark.sql import functions as F

    for ids in ([*range(5000), 10**15], [*range(1000), *[5] * 4000]):
        df = spark.createDataFrame([(i, f"t{k}") for k, i in enumerate(ids)], "key long, text string").withColumn("tie", F.xxhash64("text"))
        sizes = [r["count"] for r in df.withColumn("block", fingerprint.blocks_of(df.select("key"), 100)).groupBy("block").count().collect()]
        assert max(sizes) < 400 and sum(sizes) == len(ids)


def test_likeness_matches_brute_force(spark):
    texts = ["a b. c\nd e\nd e", "d e\nx y! c", "", "a b. c", "d e"] * 2
    docs = list(enumerate(texts))

    def lanes(text):
        return Counter(x for x in re.split(r"\n|(?<=[^\W_]) (?!.)|(?<=[^a-z0-9]) ", text) if x)

    got = {r["doc_id"]: r["near_next"] for r in fingerprint.document_fingerprints(spark.createDataFrame(docs, "doc_id long, text string")).collect()}
    for i, text in docs:
        after = texts[i - 1]
        x, y = lanes(text), lanes(after)
        want = 1.0 if sorted(text.split("\n")) == sorted(after.split("\n")) else (sum((x & y).values()) / sum((x | y).values()) if x | y else 0.0)
        assert abs(got[i] - want) < 1e-9


def test_fingerprints_follow_insertion_and_deletion(spark):
    from pyspark.sql import functions as F

    rng = random.Random(31)
    paragraphs = ["", "a b. c", "d e", "d e", "x. x. x. x", "\u00fc \u2603.", say(3, 40), *(say(k, 5) + ". " + say(k % 3, 4) for k in range(12))]
    rows = [("", "a"), ("a", ""), ("d e", "d e"), ("s. " * 40_000 + "s", "s. " * 25_535)]
    rows += [("\n".join(rng.choices(paragraphs, k=rng.randint(1, 30))), "\n".join(rng.choices(paragraphs, k=rng.randint(1, 9)))) for _ in range(60)]
    # The other text's paragraphs go in among the first one's, in any order.
    mixed = []
    for x, y in rows:
        both = [*x.split("\n"), *y.split("\n")]
        rng.shuffle(both)
        mixed.append((x, y, "\n".join(both)))
    df = spark.createDataFrame(mixed, "x string, y string, both string")
    for c in df.columns:
        df = fingerprint.with_fingerprint(df, c, f"{c}_")
    got = df.select("x_fingerprint", "both_fingerprint", fingerprint.inserted(F.col("x_fingerprint"), F.col("y_fingerprint")).alias("more"), fingerprint.deleted(F.col("both_fingerprint"), F.col("y_fingerprint")).alias("less"), fingerprint.inserted(F.col("x_fingerprint"), F.lit(None).cast("string")).alias("none")).collect()
    assert len(got) == len(rows)
    for r in got:
        assert r["more"] == r["both_fingerprint"] and r["less"] == r["x_fingerprint"] and r["none"] is None


def test_fingerprints_of_odd_input(odd, none):
    assert fingerprint.document_fingerprints(odd).count() == len(odd_documents()) and fingerprint.document_fingerprints(none).count() == 0


def test_settled_deletes_what_led_to_it(spark):
    import os

    from motifcast.llm.common import checkpointed, released, settled, shared_folder

    def files():
        root = shared_folder(spark).removeprefix("file:")
        return {d for d in os.listdir(root) if d.startswith("rdd-")}

    before, kept = files(), []

    def make():
        return checkpointed(checkpointed(spark.range(100).where("id % 3 = 0")).where("id % 2 = 0"))

    kept.append(settled(spark, make))
    assert len(files() - before) == 1 and sorted(r[0] for r in kept[0].collect()) == list(range(0, 100, 6))
    released(spark, lambda: kept.append(settled(spark, make).collect()))
    assert len(files() - before) == 1 and len(kept[1]) == 17 and kept[0].count() == 17


def test_packing_of_an_empty_table(spark, none):
    got = packing.pack(none, packing.word_tokenizer())
    assert got.count() == 0 and {"doc_id", "start", "length", "ids_crc32", "doc_tokens", "sequence_id", "offset"} <= set(got.columns)


# ---------------------------------------------------------------- toxicity


@pytest.mark.parametrize(("block", "rare", "dense"), [(32, 3, 0.2), (700, 0, 2.0), (64, 1000, 0.01)])
def test_block_max_is_exact(monkeypatch, block, rare, dense):
    import numpy as np

    monkeypatch.setattr(toxicity, "DENSE_SHARE", dense)
    rng = random.Random(4)
    vectors = []
    for _ in range(500):
        terms = np.array(sorted(set(rng.sample(range(20), 3) + rng.sample(range(400), 6))))
        w = np.array([rng.random() + 0.1 for _ in terms])
        vectors.append((terms, w / np.sqrt((w * w).sum())))
    full = np.zeros((500, 400))
    for i, (t, w) in enumerate(vectors):
        full[i, t] = w
    full = full @ full.T
    index = toxicity.BlockMaxIndex(np.cumsum([0, *(len(t) for t, _ in vectors)]), np.concatenate([t for t, _ in vectors]), np.concatenate([w for _, w in vectors]), 400, block, rare)
    for row, (ids, cosines) in zip(full, index.nearest(vectors, 15), strict=True):
        kth = np.sort(row)[-15]
        assert set(np.flatnonzero((row > 0) & (row >= kth + 1e-5))) <= set(ids) <= set(np.flatnonzero(row >= kth - 1e-5)) and np.allclose(np.minimum(row[ids], 1), cosines, atol=1e-5)


def test_term_hashes_do_not_depend_on_the_batch():
    import numpy as np

    words = ["a", "über", "toxicity", "toxic", "日本語の文", "x" * 50, "", "toxicities"]
    hashes, there = toxicity.term_hashes(words)
    for w, h, t in zip(words, hashes, there, strict=True):
        assert (toxicity.term_hashes([w])[0][0][t] == h[t]).all() and t.sum() == (len(toxicity.word_terms(w)) if w else 0)
    assert len(np.unique(hashes[there])) == len({t for w in words if w for t in toxicity.word_terms(w)})


def brute_scores(docs, labels, folds):
    """The score of every document in plain Python: TF-IDF times 1 + z over words and prefixes, full sort, votes, and an isotonic
    fit on votes for each fold from weights and neighbours of the other folds."""
    import numpy as np

    terms = {i: Counter(t for w in re.findall(r"\w+", (x or "").lower()) for t in toxicity.word_terms(w)) for i, x in docs}
    df = Counter(t for c in terms.values() for t in c)
    all_examples = [(i, labels[i]) for i, _ in docs if i in labels and zlib.crc32(str(i).encode()) % 4 != 2]
    known = {t for i, _ in all_examples for t in terms[i]}

    def votes(examples, asked):
        n1, n0 = sum(y for _, y in examples), sum(1 - y for _, y in examples)
        a, b = (Counter(t for i, y in examples if y == x for t in terms[i]) for x in (1, 0))

        def weight(t):
            p = (a[t] + b[t] + 1) / (n1 + n0 + 2)
            return (math.log((1 + len(docs)) / (1 + df[t])) + 1) * (1 + max((a[t] / n1 - b[t] / n0) / math.sqrt(p * (1 - p) * (1 / n1 + 1 / n0)), 0))

        def vector(i):
            v = {t: (1 + math.log(n)) * weight(t) for t, n in terms[i].items() if t in known}
            norm = math.sqrt(sum(x * x for x in v.values()))
            return {t: x / norm for t, x in v.items()}

        vectors = {i: vector(i) for i in {*asked, *(i for i, _ in examples)}}

        def vote(i):
            near = sorted(((sum(x * vectors[j].get(t, 0) for t, x in vectors[i].items()), y) for j, y in examples), reverse=True)
            near = [(c, y) for c, y in near if c > 1e-9 and c >= near[min(toxicity.NEIGHBOURS, len(near)) - 1][0] - 1e-6]
            w = [1 / (1.05 - min(c, 1)) for c, _ in near]
            return sum(x * y for x, (_, y) in zip(w, near, strict=True)) / sum(w) if near else None

        return {i: vote(i) for i in asked}

    fit = []
    for fold in set(folds.values()):
        got = votes([(i, y) for i, y in all_examples if folds[i] != fold], [i for i, _ in all_examples if folds[i] == fold])
        fit += [(v, labels[i]) for i, v in got.items() if v is not None]
    knots, means = toxicity.isotonic(np.array([v for v, _ in fit]), np.array([float(y) for _, y in fit]))
    none = [y for i, y in all_examples if not terms[i]]
    without = (sum(none) + 0.01) / (len(none) + 1)
    return {i: without if v is None else float(np.interp(v, knots, means)) for i, v in votes(all_examples, [i for i, _ in docs]).items()}


def test_toxicity_matches_brute_force(spark):
    rng = random.Random(12)
    docs = [(i, " ".join([*rng.choices(WORDS[:60], k=rng.randint(3, 20)), *(rng.choices(["vile", "scum", "filthy"], k=2) if i % 5 == 0 else [])])) for i in range(150)] + [(500, None), (501, "zzzz")]
    labels = {i: int(i % 5 == 0) for i in range(100)}
    frame = spark.createDataFrame(docs, "doc_id long, text string")
    table = spark.createDataFrame(list(labels.items()), "doc_id long, toxic int")
    folds = {r["doc_id"]: r["fold"] for r in toxicity._usable(frame, table, 4, 2, toxicity.MAX_EXAMPLES, toxicity.MAX_CHARS).collect()}
    assert set(folds) == {i for i in labels if zlib.crc32(str(i).encode()) % 4 != 2} and len(set(folds.values())) == toxicity.FOLDS
    got = {r["doc_id"]: r["score"] for r in toxicity.toxicity_scores(frame, table).collect()}
    want = brute_scores(docs, labels, folds)
    assert all(abs(got[i] - want[i]) < 1e-3 for i in want)


def test_toxicity_learns_nothing_from_held_out_labels(spark):
    docs = [(i, say(i, 12) + (" vile scum" if i % 5 == 0 else "")) for i in range(120)]
    frame = spark.createDataFrame(docs, "doc_id long, text string")
    held = {i for i, _ in docs if zlib.crc32(str(i).encode()) % 4 == 2}
    assert held
    runs = []
    for flip in (0, 1):
        labels = spark.createDataFrame([(i, int(i % 5 == 0) ^ (flip if i in held else 0)) for i, _ in docs], "doc_id long, toxic int")
        runs.append((toxicity.cross_validated(frame, labels, powers=(0, 1)), sorted(map(tuple, toxicity.toxicity_scores(frame, labels).collect()))))
    assert runs[0] == runs[1]


def test_average_precision():
    import numpy as np

    votes, truth = np.array([0.9, 0.8, 0.8, 0.1]), np.array([1.0, 0.0, 1.0, 0.0])
    assert toxicity.average_precision(votes, truth) == pytest.approx((1 + 2 / 3) / 2)
    assert toxicity.average_precision(votes, np.zeros(4)) == 0.0 == toxicity.average_precision(votes[:0], truth[:0])


def test_toxicity_bounds_examples(spark):
    # One labelled doc_id with many texts, and one very long text: both bounds hold, and equal texts are in one fold.
    rows = [(1, say(i, 5)) for i in range(150)] + [(i, "same words") for i in range(100, 110)] + [(3, "long " * 3000)]
    frame = spark.createDataFrame(rows, "doc_id long, text string")
    labels = spark.createDataFrame([(1, 1), (3, 1), *((i, i % 2) for i in range(100, 110))], "doc_id long, toxic int")
    found = toxicity._usable(frame, labels, 4, 2, 20, 1_000_000).collect()
    assert len(found) == 20 and all(len(r["text"]) <= 10_000 for r in found)
    found = toxicity._usable(frame, labels, 4, 2, 1000, 1_000).collect()  # none of more than 10 signs
    assert {r["text"] for r in found} == {"same words"} and len(found) == 2 and len({r["fold"] for r in found}) == 1
    found = toxicity._usable(frame, labels, 4, 2, 1000, 3_000).collect()
    assert 2_900 < sum(len(r["text"]) for r in found) <= 3_000


def test_toxicity_finds_held_out(spark):
    rng = random.Random(8)
    rows, labels = [], []
    for i in range(900):
        toxic = i % 6 == 0
        extra = [w + rng.choice(["", "er", "est", "ish"]) for w in rng.choices(["vilest", "scummy", "nastier", "foulest"], k=3)] if toxic else []
        words = rng.choices(WORDS, k=60) + extra
        rng.shuffle(words)
        rows.append((i, " ".join(words)))
        labels.append((i, int(toxic)))
    docs = spark.createDataFrame([*rows, (9001, None), (9002, "")], "doc_id long, text string")
    got = toxicity.toxicity_scores(docs, spark.createDataFrame(labels, "doc_id long, toxic int")).collect()
    truth = dict(labels)
    held = [r for r in got if r["held_out"] and r["doc_id"] in truth]
    assert len(got) == 902 and held and all(r["held_out"] == (zlib.crc32(str(r["doc_id"]).encode()) % 4 == 2) for r in got)
    assert sum((r["score"] >= 0.3) == truth[r["doc_id"]] for r in held) >= 0.97 * len(held)
    assert all(0 <= r["score"] <= 1 for r in got) and all(r["score"] < 0.3 for r in got if r["doc_id"] > 9000)


def test_toxicity_of_few_labels_uses_all_terms(spark):
    # 40 labels, 5 toxic: no term is common enough for a test of significance, yet the held-out toxic texts share terms with them.
    rng = random.Random(18)
    rows = [(i, " ".join([*rng.choices(WORDS, k=12), *(["vile", "scum", "filth"] if i % 8 == 0 else [])])) for i in range(60)]
    labels = [(i, int(i % 8 == 0)) for i, _ in rows]
    got = {r["doc_id"]: r for r in toxicity.toxicity_scores(spark.createDataFrame(rows, "doc_id long, text string"), spark.createDataFrame(labels, "doc_id long, toxic int")).collect()}
    held = [i for i, _ in rows if got[i]["held_out"]]
    assert all(got[i]["evidence"] for i in held)
    assert any(i % 8 == 0 for i in held) and min(got[i]["score"] for i in held if i % 8 == 0) > max(got[i]["score"] for i in held if i % 8)


def test_toxicity_without_labels(spark, odd, none):
    labels = spark.createDataFrame([], "doc_id long, toxic int")
    assert {r["score"] for r in toxicity.toxicity_scores(odd, labels).collect()} == {0.0}
    assert toxicity.toxicity_scores(none, labels).count() == 0


# ---------------------------------------------------------------- decontamination


def brute_overlaps(docs, items):
    tokens = lambda t: re.findall(r"[^\W_]+", (t or "").lower())
    out = set()
    for d, text in docs:
        w = tokens(text)
        for i, said in items:
            x = tokens(said)
            size = min(len(x), decontam.WINDOW)
            if len(x) >= decontam.LEAST_TOKENS and any(sum(0 <= s + k < len(w) and w[s + k] == x[a + k] for k in range(size)) >= 0.7 * size for a in range(len(x) - size + 1) for s in range(-size, len(w))):
                out.add((d, i))
    return out


@pytest.mark.parametrize("limit", [decontam.BROADCAST_SEEDS, 0])
def test_decontamination_tolerates_substitutions(spark, limit):
    rng = random.Random(11)
    items = [(i, say(1000 + i, n)) for i, n in enumerate([6, 9, 20, 30, 45])] + [(7, "one two"), (8, None)]
    docs = [(0, None), (1, ""), (2, say(50, 90))]
    for k, (_, said) in enumerate(items[:5]):
        words = said.split()
        for at in range(3, len(words), 9):
            words[at] = "changed"
        docs.append((10 + k, f"{say(60 + k, 40)} {said} {say(70 + k, 30)}"))
        docs.append((20 + k, f"{say(80 + k, 40)}, {' '.join(words).upper()}! {say(90 + k, 30)}"))
    rng.shuffle(docs)
    got = decontam.overlaps(spark.createDataFrame(docs, "doc_id long, text string"), spark.createDataFrame(items, "item_id long, text string"), limit)
    found = {(r["doc_id"], r["item_id"]) for r in got.collect()}
    want = brute_overlaps(docs, items)
    assert found == want and {d for d, _ in want} == {10, 11, 12, 13, 14, 20, 21, 22, 23, 24}


def test_equal_items_are_looked_for_once(spark):
    """Forty names of two items, one name for both: the seeds of two are broadcast, and all names are reported."""
    said = [say(1, 20), say(2, 20)]
    items = [(k, said[k % 2]) for k in range(40)] + [(0, said[1]), (None, said[0])]
    docs = [(1, f"{say(3, 30)} {said[0]}"), (2, f"{said[1]} {say(4, 30)}"), (3, say(5, 30))]
    got = decontam.overlaps(spark.createDataFrame(docs, "doc_id long, text string"), spark.createDataFrame(items, "item_id long, text string"), 500)
    assert sorted((r["doc_id"], r["item_id"], r["matched"]) for r in got.collect()) == sorted({(1 + k % 2, k, 16) for k in range(40)} | {(2, 0, 16)})
    assert "Generate" in got._jdf.queryExecution().toString()  # of the documents' seeds, at the broadcast


def test_masks_hit_every_placement():
    for n in range(decontam.LEAST_TOKENS, decontam.WINDOW + 1):
        ((_, _, masks),) = decontam.families([n])
        places = [sum(1 << (o + i) for i, x in enumerate(m) if x == "1") for m in masks for o in range(n - len(m) + 1)]
        for changed in itertools.combinations(range(n), n - math.ceil(n * decontam.LEAST_SHARE)):
            assert any(not p & sum(1 << c for c in changed) for p in places), (n, changed)


def test_decontamination_with_regular_substitutions(spark):
    items = [(i, " ".join(f"w{i}x{k}" for k in range(n))) for i, n in enumerate([1, 3, 4, 10, 14, 15, 16, 18, 45])]
    docs = []
    for i, said in items:
        for phase in range(4):
            words = said.split()
            n = min(len(words), decontam.WINDOW)
            changed = [k for k in range(phase, len(words), 4) if n >= 5][: None if len(words) >= 16 else n - math.ceil(n * 0.7)]
            docs.append((10 * i + phase, " ".join(["before", *("other" if k in changed else w for k, w in enumerate(words)), "after"])))
    got = decontam.overlaps(spark.createDataFrame(docs, "doc_id long, text string"), spark.createDataFrame(items, "item_id long, text string"))
    assert {(r["doc_id"], r["item_id"]) for r in got.collect()} == {(d, d // 10) for d, _ in docs}


def test_best_window_is_that_of_the_whole_item(spark):
    from pyspark.sql import functions as F

    rng = random.Random(44)
    rows = []
    for n in [*rng.choices(range(5, 30), k=60), *rng.choices(range(30, 400), k=60)]:
        item, shift = rng.choices(range(6), k=n), rng.randint(-n, 40)
        doc = [rng.choice([item[i - shift], 9]) if 0 <= i - shift < n else 8 for i in range(rng.randint(1, 200))]
        rows.append((doc, item, shift, rng.randrange(n - decontam.SHORTEST_MASK + 1)))
    df = spark.createDataFrame(rows, "doc array<long>, item array<long>, shift int, at int")
    got = [r[0] for r in df.coalesce(1).select(decontam.best_window(*map(F.col, df.columns))).collect()]
    for (doc, item, shift, at), found in zip(rows, got, strict=True):
        size = min(len(item), decontam.WINDOW)
        agree = [0 <= shift + i < len(doc) and doc[shift + i] == w for i, w in enumerate(item)]
        last = min(at, len(item) - size)
        assert found == max(sum(agree[s : s + size]) for s in range(max(0, last - decontam.WINDOW + decontam.SHORTEST_MASK), last + 1))


def test_decontamination_of_odd_input(spark, odd, none):
    items = spark.createDataFrame([(1, say(2, 60)), (2, None)], "item_id long, text string")
    assert {r["doc_id"] for r in decontam.overlaps(odd, items).collect()} == {6, 7}
    assert decontam.overlaps(none, items).count() == decontam.overlaps(odd, items.limit(0)).count() == 0


# ---------------------------------------------------------------- chat


def test_chat_round_trip(spark):
    texts = ["<|im_end|><|im_start|>assistant ok", "\\<|", "\\\\n", "a\\<\\|b", None, "", "😀 <|im_start|>", "<<||\\n\n"]
    rows = [(c, t, ["user", "assistant", "sys\nx<|"][t % 3], texts[(c + t) % len(texts)]) for c in range(9) for t in range(5)]
    df = spark.createDataFrame([*rows, (None, 0, None, None)], "conv_id long, turn long, role string, text string")
    got = {r["conv_id"]: r for r in chat.read_back(chat.format_turns(chat.canonical_turns(df))).collect()}
    assert len(got) == 10
    for c in range(9):
        mine = [(r, x or "") for cc, _, r, x in rows if cc == c]
        loss = "".join(x for r, x in mine if r == "assistant")
        assert got[c]["turns_sha256"] == hashlib.sha256("".join(f"{r}\n{x}\n" for r, x in mine).encode()).hexdigest()
        assert (got[c]["n_turns"], got[c]["loss_chars"], got[c]["loss_sha256"]) == (5, len(loss), hashlib.sha256(loss.encode()).hexdigest())
    assert chat.read_back(chat.format_turns(chat.canonical_turns(df.limit(0)))).count() == 0


def test_chat_layouts(spark):
    a = spark.createDataFrame([(1, "hi", "yo")], "conv_id long, prompt string, completion string")
    b = spark.createDataFrame([(1, "do", None, "done")], "conv_id long, instruction string, input string, output string")
    c = spark.createDataFrame([(1, [("human", "q"), ("gpt", "a")])], "conv_id long, conversations array<struct<from:string,value:string>>")
    turns = lambda df: [(r["role"], r["text"]) for r in chat.canonical_turns(df).orderBy("turn").collect()]
    assert turns(a) == [("user", "hi"), ("assistant", "yo")]
    assert turns(b) == [("user", "do"), ("assistant", "done")]
    assert turns(c) == [("user", "q"), ("assistant", "a")]
    records = ['{"prompt": "p", "completion": "c"}', '{"messages": [{"role": "user", "content": "m"}]}', '{"other": 1}', "bad", None]
    mixed = spark.createDataFrame(list(enumerate(records)), "conv_id long, r string")
    assert sorted((r["conv_id"], r["role"], r["text"]) for r in chat.canonical_turns_json(mixed, "r").collect()) == [(0, "assistant", "c"), (0, "user", "p"), (1, "user", "m")]
    with pytest.raises(ValueError):
        chat.canonical_turns(spark.createDataFrame([(1, 2)], "conv_id long, x int"))


def test_chat_fingerprints_select_nested_layouts(spark):
    records = [
        '{"messages": [{"from": "human", "value": "v"}]}', '{"id": 7, "conversations": [{"from": "human", "value": "v", "weight": 1}], "source": {"a": 1}}',
        '{"system": "", "question": "q", "answer": "a"}', '{"question": "q", "answer": "a"}', '{"instruction": "i", "output": "o"}', '{"prompt": "p", "completion": "c", "response": "r"}', "[1]",
    ]
    mixed = spark.createDataFrame(list(enumerate(records)), "conv_id long, r string")
    assert {r["conv_id"]: r["layout"] for r in chat.json_layouts(mixed, "r").collect()} == {0: None, 1: "conversations", 2: "system_question", 3: "system_question", 4: "instruction", 5: None, 6: None}
    assert sorted((r["conv_id"], r["turn"], r["role"], r["text"]) for r in chat.canonical_turns_json(mixed, "r").collect()) == [(1, 0, "user", "v"), (2, 0, "user", "q"), (2, 1, "assistant", "a"), (3, 0, "user", "q"), (3, 1, "assistant", "a"), (4, 0, "user", "i"), (4, 1, "assistant", "o")]
    kind = lambda ddl: chat.layout_of(chat.T.StructType.fromDDL(ddl)).name
    assert kind("conv_id long, messages array<struct<role:string,content:string>>, meta string") == "messages"
    assert kind("conv_id long, turn long, role string, text string, prompt string, x int") == "turn_rows"
    with pytest.raises(ValueError):
        kind("conv_id long, messages array<struct<from:string,value:string>>")


# ---------------------------------------------------------------- near duplicates


def shingles(text):
    w = re.findall(rb"[^\x20\x09-\x0D]+", (text or "").encode().lower())
    return {tuple(w[k : k + 5]) for k in range(len(w) - 4)} if len(w) >= 5 else ({tuple(w)} if w else set())


def brute_groups(docs):
    parent = {d: d for d, _ in docs}

    def find(x):
        while parent[x] != x:
            x = parent[x]
        return x

    sets = {d: shingles(t) for d, t in docs}
    for a in sets:
        for b in sets:
            both = len(sets[a] & sets[b])
            if a < b and both and 100 * both >= 75 * len(sets[a] | sets[b]):
                x, y = find(a), find(b)
                parent[max(x, y)] = min(x, y)
    return {d: (len(sets[d]), find(d)) for d in sets}


def test_near_duplicates_match_brute_force(spark):
    rng, docs = random.Random(21), [(0, None), (1, ""), (2, "A b"), (3, "a B"), (4, "x y z"), (5, say(77, 5)), (6, say(77, 5).upper())]
    passage = say(500, 40)
    for g in range(6):
        base = say(600 + g, 200).split()
        docs.append((100 + 40 * g, " ".join(base)))
        for k in range(1, 14):
            words = base[:]
            for _ in range(rng.randint(0, 9)):
                words[rng.randrange(len(words))] = f"new{rng.random()}"
            docs.append((100 + 40 * g + k, " ".join(words)))
    docs += [(1000 + k, f"{passage} {say(700 + k, 60)}") for k in range(30)]  # a shared passage, not alike
    rng.shuffle(docs)
    got = {r["doc_id"]: (r["n_shingles"], r["component_id"]) for r in neardup.near_duplicates(spark.createDataFrame(docs, "doc_id long, text string")).collect()}
    assert got == brute_groups(docs)


def test_near_duplicates_keep_shingle_sets_once(spark, monkeypatch):
    kept, keep = [], neardup.checkpointed
    monkeypatch.setattr(neardup, "checkpointed", lambda df: kept.append(df.columns) or keep(df))
    base = [f"w{i}" for i in range(60)]
    texts = [" ".join(f"x{i}{k}" if (k * 7 + i) % 60 < i else w for k, w in enumerate(base)) for i in range(20)]
    assert neardup.near_duplicates(spark.createDataFrame(list(enumerate(texts)), "doc_id long, text string")).count() == 20
    assert sum("shingles" in columns for columns in kept) == 1


def test_near_duplicates_of_odd_input(odd, none):
    got = neardup.near_duplicates(odd).collect()
    want = brute_groups([(d[0], d[1]) for d in odd_documents()])
    assert len(got) == len(odd_documents()) and all((r["n_shingles"], r["component_id"]) == want[r["doc_id"]] and r["kept"] == (r["doc_id"] == r["component_id"]) for r in got)
    assert neardup.near_duplicates(none).count() == 0


def near_group(n: int, seed: int) -> list[str]:
    """Texts around one base, from close copies to a fringe that is not alike, with edits that many of them share."""
    rng, base = random.Random(seed), say(800 + seed, 90).split()
    out = []
    for k in range(n):
        words = base[:]
        for at in rng.sample(range(90), k % 7):
            words[at] = rng.choice([f"edit{at}", f"own{rng.random()}"])
        out.append(" ".join(words))
    return out


@pytest.mark.parametrize("block", [neardup.BLOCK, 8])
def test_fringe_of_a_group_matches_brute_force(spark, monkeypatch, block):
    monkeypatch.setattr(neardup, "BLOCK", block)
    docs = list(enumerate(near_group(120, 3)))
    got = {r["doc_id"]: (r["n_shingles"], r["component_id"]) for r in neardup.near_duplicates(spark.createDataFrame(docs, "doc_id long, text string")).collect()}
    want = brute_groups(docs)
    assert got == want and len({c for _, c in want.values()}) > 10


def test_likely_pairs_reach_the_recall(spark):
    """All links between texts of different components are among the pairs, each once."""
    rows = [(k, len(s), neardup.odd_sketch(m).tolist(), neardup._band_keys(m, neardup.BANDS2, neardup.ROWS2).tolist(), k, s) for k, t in enumerate(near_group(80, 5)) for s in (neardup.shingle_set(t, neardup._WordHashes()),) for m in (neardup._minhash(s, slice(neardup.BANDS * neardup.ROWS, None)),)]
    sets = [set(r[5].tolist()) for r in rows]
    frame = spark.createDataFrame([(*r[:5], r[1]) for r in rows], "rep long, n long, sketch array<long>, bands array<long>, component long, shared long")
    pairs = [tuple(r) for r in neardup._likely(frame).collect()]
    want = {(a, b) for a in range(80) for b in range(a + 1, 80) if rows[a][2] != rows[b][2] and 100 * len(sets[a] & sets[b]) >= 75 * len(sets[a] | sets[b])}
    assert len(pairs) == len(set(pairs)) and len(want) > 100 and len(want & set(pairs)) >= 0.99 * len(want)


def test_null_ids_are_kept_unless_they_are_copies(spark):
    rows = [(None, say(3, 30)), (None, say(3, 30)), (None, say(4, 30)), (5, say(4, 30)), (6, say(5, 30)), (6, say(6, 30))]
    got = [(r["doc_id"], r["component_id"], r["kept"]) for r in neardup.near_duplicates(spark.createDataFrame(rows, "doc_id long, text string")).collect()]
    assert sorted(got, key=str) == sorted([(None, None, True), (None, None, True), (None, 5, False), (5, 5, True), (6, 6, True), (6, 6, True)], key=str)


def test_odd_sketch_estimates_similarity(spark):
    a = say(31, 500)
    b = " ".join(a.split()[:480] + say(32, 20).split())
    x, y = (neardup.odd_sketch(neardup._minhash(neardup.shingle_set(t, neardup._WordHashes()), slice(neardup.BANDS * neardup.ROWS, None))).tolist() for t in (a, b))
    from pyspark.sql import functions as F

    est = spark.createDataFrame([(x, y)], "x array<long>, y array<long>").select(neardup.odd_similarity(F.col("x"), F.col("y")).alias("e")).first()["e"]
    s, t = shingles(a), shingles(b)
    assert abs(est - len(s & t) / len(s | t)) < 0.08


@pytest.mark.parametrize("seed", [1, 2])
def test_components(spark, seed):
    rng = random.Random(seed)
    links = [(rng.randrange(300), rng.randrange(300)) for _ in range(160)] + [(1000, 1000 + k) for k in range(1, 60)] + [(5000 - k, 5001 - k) for k in range(40)] + [(7, 7), (None, 3)]
    got = {r["node"]: r["component"] for r in components.components(spark.createDataFrame(links, "a long, b long")).collect()}
    near = defaultdict(set)
    for a, b in links:
        if a is not None and a != b:
            near[a].add(b)
            near[b].add(a)
    want = {}
    for start in sorted(near):
        todo = [start]
        while todo:
            n = todo.pop()
            if n not in want:
                want[n] = start
                todo += near[n]
    assert got == want


# ---------------------------------------------------------------- line dedup


def brute_lines(docs, least):
    lines = {d: (t or "").split("\n") for d, t in docs}
    first, windows = {}, []
    for d in sorted(lines):
        for p in range(len(lines[d])):
            n = 0
            for q in range(p, len(lines[d])):
                n += len([w for w in lines[d][q].split(" ") if w])
                if n >= least:
                    run = tuple(lines[d][p : q + 1])
                    windows.append((d, p, q, run))
                    first.setdefault(run, (d, p))
    gone = defaultdict(set)
    for d, p, q, run in windows:
        if first[run] != (d, p):
            gone[d] |= set(range(p, q + 1))
    return {d: "\n".join(x for k, x in enumerate(lines[d]) if k not in gone[d]) for d in lines}


def test_line_dedup_matches_brute_force(spark):
    rng = random.Random(4)
    pool = [say(900 + k, rng.randint(0, 6)) for k in range(12)]
    docs = [(i, "\n".join(rng.choices(pool, k=rng.randint(1, 25)))) for i in range(60)]
    docs += [(100, docs[3][1]), (101, docs[3][1]), (102, None), (103, ""), (104, "one")]
    got = {r["doc_id"]: (r["text"] or "") for r in linededup.dedup_lines(spark.createDataFrame(docs, "doc_id long, text string"), least_words=9).collect()}
    assert got == brute_lines(docs, 9)


def test_line_dedup_of_odd_input(odd, none):
    out = linededup.dedup_lines(odd)
    assert set(odd.columns) | {"n_lines", "n_deleted"} == set(out.columns)
    got = {r["doc_id"]: (r["text"] or "") for r in out.collect()}
    assert out.count() == len(odd_documents()) and got == brute_lines([(d[0], d[1]) for d in odd_documents()], 50)
    assert linededup.dedup_lines(none).count() == 0


def test_line_dedup_with_null_ids(spark):
    """Rows without an id are places like others, before all ids; copies of a whole text among them are one place."""
    block = "\n".join(say(90 + i, 12) for i in range(6))
    texts = [(None, f"one\n{block}"), (None, f"two\n{block}\nend"), (7, f"seven\n{block}"), (8, block), (None, say(99, 60)), (None, say(99, 60)), (9, say(99, 60))]
    got = linededup.dedup_lines(spark.createDataFrame(texts, "doc_id long, text string")).collect()
    n = {(r["doc_id"], r["n_lines"], r["n_deleted"]) for r in got}
    assert (7, 7, 6) in n and (8, 6, 6) in n and (9, 1, 1) in n and len(got) == 7
    nulls = sorted((r["n_lines"], r["n_deleted"]) for r in got if r["doc_id"] is None)
    assert nulls[:2] == [(1, 0), (1, 0)] and sorted(d for _, d in nulls[2:]) == [0, 6]


def test_line_dedup_with_clashing_columns(spark):
    names = ["_id", "_tie", "_gone", "_text", "tie", "hash", "id", "row", "gone", "lines", "line", "words", "n_lines", "n_deleted"]
    text = "\n".join(say(k, 9) for k in range(8))
    df = spark.createDataFrame([(i, t, *[7] * len(names)) for i, t in enumerate([f"{text}\nfirst", f"other\n{text}"])], f"doc_id long, text string, {', '.join(f'{x} int' for x in names)}")
    got = linededup.dedup_lines(df)
    assert got.columns == df.columns
    assert {r["doc_id"]: (r["text"], r["n_lines"], r["n_deleted"], r["row"]) for r in got.collect()} == {0: (f"{text}\nfirst", 9, 0, 7), 1: ("other", 9, 8, 7)}


# ---------------------------------------------------------------- secrets


def brute_spans(text):
    kinds = [
        (re.compile(r"""((?i:password|passwd|secret|token|api_?key))["']?\x20*[:=]\x20*["']?([A-Za-z0-9+/_.=-]+)""", re.ASCII), lambda m: len(m[2]) >= 6),
        (re.compile("AKIA[A-Z0-9]+"), lambda m: len(m[0]) >= 20),
        (re.compile("[0-9a-f]+"), lambda m: len(m[0]) >= 24),
    ]
    return sorted((m.start(), k, m.end()) for k, (p, ok) in enumerate(kinds) for m in p.finditer(text or "") if ok(m))


def test_base_spans(spark):
    hexes = "0123456789abcdef" * 2
    texts = [None, "", "secret: token = abcdefghij", f"😀 Password='{hexes}' x", f"token=token=abc123 AKIA{'A1' * 9} AKIAAKIA{'B' * 20}", f"{hexes}g{hexes}", "api_key: short", "API-KEY=abcdefgh apikey =\"q.w_e-r=t\"", "x\n" * 300 + "secret=abcdef\n" * 300]
    rows = secrets.scan_secrets(spark.createDataFrame(list(enumerate(texts)), "doc_id long, text string")).collect()
    got = {r["doc_id"]: [(s["start"], s["kind"], s["end"]) for s in r["base"]] for r in rows}
    assert got == {i: brute_spans(t) for i, t in enumerate(texts)}


def test_battery_adds_random_tokens(spark):
    rng = random.Random(2)
    alphabet = "ABCDEFGHIJKLMNOPQRSTUVWXYZabcdefghijklmnopqrstuvwxyz0123456789+/"
    keys = ["".join(rng.choices(alphabet, k=60)) + "1a" for _ in range(40)]
    plain = ["".join(rng.choices(["the", "ing", "tion", "ent", "er"], k=14)) for _ in range(400)]
    docs = [(i, f"see {k} now") for i, k in enumerate(keys)] + [(1000 + i, f"see {p} now") for i, p in enumerate(plain)]
    rows = {r["doc_id"]: r for r in secrets.scan_secrets(spark.createDataFrame(docs, "doc_id long, text string")).collect()}
    assert sum(len(rows[i]["spans"]) for i in range(40)) >= 30 and not any(rows[1000 + i]["spans"] for i in range(400))


def brute_battery(token):
    """The statistic of the three tests, and the p-value, in plain Python."""
    bare = token.rstrip("=")
    size = next(m for m, p in [(16, "[0-9a-f]+|[0-9A-F]+"), (32, "[A-Z2-7]+"), (36, "[a-z0-9]+|[A-Z0-9]+"), (64, ".*")] if re.fullmatch(p, bare))
    order = {16: "0123456789abcdef", 32: "ABCDEFGHIJKLMNOPQRSTUVWXYZ234567", 36: "0123456789abcdefghijklmnopqrstuvwxyz", 64: secrets._ORDER}[size]
    code = [order.index(x.lower() if size in (16, 36) else {"-": "+", "_": "/"}.get(x, x)) for x in bare]
    n, many = len(code), Counter(bare).values()
    uniform = max(0.0, (sum(c * c for c in many) * size / n - n - (size - 1)) / math.sqrt(2 * (size - 1) * (n - 1) / n))
    up = [c >= size / 2 for c in code]
    high, runs = sum(up), 1 + sum(x != y for x, y in itertools.pairwise(up))
    expected = 2 * high * (n - high) / n + 1
    ran = (runs - expected) / math.sqrt(max((expected - 1) * (expected - 2) / (n - 1), 1e-9)) if 0 < high < n else math.sqrt(n)
    mean = sum(code) / n
    variance = sum((c - mean) ** 2 for c in code)
    serial = sum((x - mean) * (y - mean) for x, y in itertools.pairwise(code)) / variance * math.sqrt(n) if variance else math.sqrt(n)
    pairs, same = n * (n - 1) / 2, sum(c * (c - 1) / 2 for c in many)
    z = (pairs * 0.06 - same) / math.sqrt(pairs * 0.06 * 0.94 + n * (n - 1) * (n - 2) * (0.0045 - 0.0036))
    p = 0.35**n if size == 16 else (math.exp(-z * z / 2) * min(0.5, 0.3989423 / max(z, 1e-6)) if z > 0 else 1.0)
    return uniform**2 + ran**2 + serial**2, p


def test_battery_matches_plain_python(spark):
    from pyspark.sql import functions as F

    rng = random.Random(7)
    alphabets = ["0123456789ABCDEF", "ABCDEFGHIJKLMNOPQRSTUVWXYZ234567", "abcdefghijklmnopqrstuvwxyz0123456789", secrets._ORDER, secrets._ORDER[:62] + "-_", "ab", "a"]
    tokens = ["".join(rng.choices(a, k=rng.randint(20, 90))) for a in alphabets for _ in range(12)] + ["abcdefghijklmnopqrstuvwxyz", "A" * 30 + "=="]
    got = spark.createDataFrame([(t,) for t in tokens], "t string").select("t", secrets.battery(F.col("t")).alias("b"), secrets.natural_p(F.col("t")).alias("p")).collect()
    for r in got:
        b, p = brute_battery(r["t"])
        assert abs(r["b"] - b) < 1e-6 * max(1, b) and abs(r["p"] - p) < 1e-9


def test_battery_needs_no_natural_words(spark):
    rng = random.Random(9)
    letters = "ABCDEFGHIJKLMNOPQRSTUVWXYZabcdefghijklmnopqrstuvwxyz"
    keys = ["".join(rng.choices(a, k=n)) for a, n in [(letters + "0123456789+/", 40), (letters, 48), (letters + "0123456789-_", 64), ("0123456789ABCDEF", 32)]]
    docs = [(i, f"see {k} now") for i, k in enumerate(keys)] + [(9, "abcdefghijklmnopqrstuvwxyz and internationalizationalism donaudampfschifffahrtsgesellschaft")]
    got = {r["doc_id"]: [(s["start"], s["end"], s["kind"]) for s in r["spans"]] for r in secrets.scan_secrets(spark.createDataFrame(docs, "doc_id long, text string")).collect()}
    assert got == {**{i: [(4, 4 + len(k), 3)] for i, k in enumerate(keys)}, 9: []}


def test_long_tokens_take_time_in_proportion(spark):
    """A sign of a long token, or one of many tokens, must not cost as much as all of them."""
    import time

    rng = random.Random(8)
    token = lambda n: "".join(rng.choices(secrets._ORDER, k=n))
    docs = spark.createDataFrame([(1, token(700)), (2, " ".join(token(30) for _ in range(60)))], "doc_id long, text string")
    assert secrets.scan_secrets(docs.where("doc_id = 0")).count() == 0
    began = time.time()
    found = {r["doc_id"]: r["spans"] for r in secrets.scan_secrets(docs).collect()}
    assert time.time() - began < 20
    assert [tuple(x) for x in found[1]] == [(0, 3, 700)] and len(found[2]) > 50


def test_secrets_of_odd_input(odd, none):
    assert secrets.scan_secrets(odd).count() == len(odd_documents()) and secrets.scan_secrets(none).count() == 0


# ---------------------------------------------------------------- languages


def test_ppm_probabilities_add_up():
    import numpy as np

    texts = ["the cat and the hat", "der hund und die katze"]
    counts = {x: np.unique(language._grams(language._bytes(t)), return_counts=True) for x, t in zip("ab", texts, strict=True)}
    for size in (1 << 20, 4000):
        model = language.Model(counts, model_bytes=size)
        p = np.exp2(-model.bits.astype(float)).reshape(-1, model.a, 2).sum(1)
        assert np.allclose(p, 1, atol=1e-5) and model.bits.nbytes <= 3 * size


def brute_bits(training, text, order=language.ORDER):
    """Code length by PPM, method C with exclusion, in plain Python over all contexts seen in training."""
    data = b"\n" * order + training.lower().encode()
    seen = defaultdict(Counter)
    for i in range(order, len(data)):
        for k in range(order + 1):
            seen[data[i - k : i]][data[i]] += 1

    @cache
    def shares(context):
        c, shorter = seen[context], shares(context[1:]) if context else [1 / 256] * 256
        n, d, left = sum(c.values()), len(c), sum(s for y, s in enumerate(shorter) if not c[y])
        return [c[y] / (n + d) if c[y] else d / (n + d) * s / left for y, s in enumerate(shorter)] if n else shorter

    said = b"\n" * order + text.lower().encode()
    return -sum(math.log2(shares(said[i - order : i])[said[i]]) for i in range(order, len(said)))


def test_code_lengths_match_brute_force(monkeypatch):
    import numpy as np

    monkeypatch.setattr(language, "LEAST_CONTEXT", 1)
    texts = ["abracadabra", "banana bandana"]
    model = language.Model({x: np.unique(language._grams(language._bytes(t)), return_counts=True) for x, t in zip("ab", texts, strict=True)})
    for text in ("abra", "bandana ab", "nab", "cab dna"):
        bits, _ = model.code_lengths(text)
        assert np.allclose(bits, [brute_bits(t, text) for t in texts], rtol=1e-4)


def test_equal_code_lengths_go_to_the_first_language():
    import numpy as np

    counts = np.unique(language._grams(language._bytes("same words")), return_counts=True)
    assert language.Model({"b": counts, "a": counts}).predict("same") == ("a", 0.5)


def test_language_held_out_accuracy(spark, sf_dir):
    docs = spark.read.parquet(f"{sf_dir}/documents.parquet")
    rows = language.identify(docs).join(docs.select("doc_id", "lang"), "doc_id").where("held_out").collect()
    assert sum(r["lang"] == r["lang_pred"] for r in rows) >= 0.9 * len(rows) and all(0 <= r["score"] <= 1 for r in rows)


def test_language_of_odd_input(odd, none):
    got = {r["doc_id"]: r["lang_pred"] for r in language.identify(odd).collect()}
    assert all(got[i] == "und" for i in (0, 1, 2, 3)) and got[4] in ("en", "de")
    assert language.identify(none).count() == 0


# ---------------------------------------------------------------- URLs


def test_urls_rules_and_aliases(spark):
    link = '<link rel="canonical" href="{}">'
    pages = [
        (1, "HTTP://WWW.Example.ORG/es/x#f", ""), (2, "http://a.net/p?q=1#z", link.format("http://www.example.org/es/x")), (3, "http://b.net/", '<meta http-equiv="refresh" content="0; url=http://a.net/p?q=1">'),
        (4, "http://c.com/fr/z", link.format("http://a.net/p?q=1")), (5, None, "x"), (6, "no scheme", link.format("http://a.net/p?q=1")), (7, "http://org", None), (8, "http://example.org/en/12", ""), (9, "http://d.net/dir/page", '<LINK href=other rel=canonical>'),
        (10, "http://d.net/dir/other", ""), (11, "http://notcom/de/", ""), (12, "x://com/de/?", ""),
    ]
    got = {r["page_id"]: r for r in urls.judge_urls(spark.createDataFrame(pages, "page_id long, url string, html string")).collect()}
    assert {i: (r["rule"], r["verdict"]) for i, r in got.items()} == {
        1: ("example.org/es/", "block"), 2: (None, "block"), 3: (None, "block"), 4: ("com/fr/", "allow"), 5: (None, "allow"), 6: (None, "allow"), 7: (None, "allow"),
        8: ("example.org/en/1", "block"), 9: (None, "allow"), 10: (None, "allow"), 11: (None, "allow"), 12: ("com/de/", "block"),
    }
    assert (got[1]["host"], got[1]["path"], got[7]["host"], got[7]["path"], got[5]["host"]) == ("www.example.org", "/es/x", "org", "", "")
    assert got[9]["component"] == got[10]["component"] is not None
    assert urls.judge_urls(spark.createDataFrame([], "page_id long, url string, html string")).count() == 0


def test_urls_of_odd_input(spark):
    """Repeated rows, very long HTML, clashing columns, and an allowed alias between two blocked ones."""
    link = lambda to: f'<html><head><link rel="canonical" href="{to}"></head></html>'
    blocked, between, far = "http://example.org/es/a", "http://example.org/x", "http://mirror.net/a"
    pages = [
        (1, blocked, link(between)), (2, between, link(far)), (3, far, None), (3, far, None), (4, "http://mirror.net/b", "<p>" + "long text " * 200_000), (5, "http://other.net/", link("http://example.org/es/z")), (None, None, ""),
    ]
    df = spark.createDataFrame([(*p, "v", "n", "h", "c") for p in pages], "page_id long, url string, html string, verdict string, node string, host string, component string")
    got = urls.judge_urls(df).select("page_id", "rule", "verdict").collect()
    assert sorted(map(tuple, got), key=repr) == sorted([(1, "example.org/es/", "block"), (2, "org/", "allow"), (3, None, "block"), (3, None, "block"), (4, None, "allow"), (5, None, "block"), (None, None, "allow")], key=repr)


def test_toxicity_holds_the_words_of_few_texts_at_once(monkeypatch):
    """op3_toxicity, pipeline: a batch of many texts is not in a worker as words all at once."""
    import numpy as np

    texts = [" ".join(f"w{i}x{j}" for j in range(5)) for i in range(2_000)] + [None, ""]
    vocabulary, held = toxicity.Vocabulary(np.unique(toxicity.term_hashes(["w7x1", "w1999x4"])[0])), []
    learn = toxicity.Vocabulary._learn
    monkeypatch.setattr(toxicity.Vocabulary, "_learn", lambda self, words: (held.append(len(words)), learn(self, words)))
    got = [terms.tolist() for terms, _ in vocabulary.vectors(texts)]
    assert len(got) == len(texts) and got[7] and got[1999] and not got[2000] and not got[2001]
    assert max(held) < 5 * 1_000
