"""Problems 7, 8 and 9: token ids, mixes of sources and subjects of texts."""

import math
import random

import numpy as np
import pytest
from pyspark.sql import functions as F

from pixelloom.llm import bpe, mixing, queries, subjects

VOCABULARY = f"{bpe.TOKENIZERS}/byte_bpe_50k"
DOCS = "doc_id bigint, text string, source string, ids string, n_tokens int, repeats int"


@pytest.fixture(scope="module")
def public():
    tokenizers = pytest.importorskip("tokenizers")
    t = tokenizers.Tokenizer.from_file(f"{VOCABULARY}.json")
    t.encode_special_tokens = True
    return lambda texts: [e.ids for e in t.encode_batch(texts, add_special_tokens=False)]


def documents(spark, rows):
    return spark.createDataFrame([(i, t, s, "x", 1, 1) for i, (t, s) in enumerate(rows)], DOCS)


# ------------------------------------------------------------------ token ids
ODD = ["", " ", "\n\n  \t x", "<|endoftext|> a", "naïve café ÀÉ", "日本語 テキスト", "👩‍👩‍👧 emoji", "I'll we've don't 'S", "a" * 3000, "ab" * 900 + "!" * 700, "é" * 400, "1234567 89", "­​﻿x\0y", "aaa" * 41 + "b" * 130, "x́" * 90]


def test_whole_texts_as_the_public_tokenizer_has_them(spark, sf, public):
    df = spark.read.parquet(f"{sf}/documents.parquet")
    odd = spark.createDataFrame([(10**9 + i, t) for i, t in enumerate(ODD)], "doc_id bigint, text string")
    every = df.select("doc_id", "text").unionByName(odd)
    got = {r["doc_id"]: r["ids"] for r in bpe.encode_texts(every).collect()}
    rows = every.collect()
    want = dict(zip([r["doc_id"] for r in rows if r["text"]], public([r["text"] for r in rows if r["text"]])))
    assert got == {r["doc_id"]: want.get(r["doc_id"], []) for r in rows}


def test_nulls_repeats_and_empty_table(spark):
    df = documents(spark, [(None, "s"), ("", "s"), ("hello", "s")])
    assert {r["doc_id"]: r["ids"] for r in bpe.encode_texts(df).collect()} == {0: [], 1: [], 2: [31373]}
    assert bpe.encode_texts(df.unionByName(df)).count() == 6 and bpe.encode_texts(df.limit(0)).count() == 0
    assert bpe.encode_texts(spark.createDataFrame([(None, "hello")], "doc_id bigint, text string")).first()["ids"] == [31373]
    assert {r["doc_id"]: r["n_tokens"] for r in bpe.token_counts(df.drop("n_tokens"), ["doc_id"]).collect()} == {0: 0, 1: 0, 2: 1}


def test_array_and_heap_merge_alike(public):
    with open(f"{VOCABULARY}.tiktoken", "rb") as f:
        e = bpe.BytePairEncoder.from_bytes(f.read())
    rnd = random.Random(0)
    for _ in range(300):
        word = "".join(rnd.choice("aetn oéß語") for _ in range(rnd.randrange(2, 60))).encode()
        assert e._merge_short(word) == e._merge_long(word)
    assert b"".join(next(k for k, v in e.ranks.items() if v == i) for i in e.encode("a round trip")) == b"a round trip"


def test_cache_is_bounded(monkeypatch):
    monkeypatch.setattr(bpe, "CACHED_WORDS", 5)
    e = bpe.BytePairEncoder({bytes([i]): i for i in range(256)})
    assert e.encode(" ".join(map(str, range(50)))) == list(" ".join(map(str, range(50))).encode()) and len(e.known) <= 5


# ------------------------------------------------------------------ mixing
TARGETS = "source string, weight double, max_repeats int, n_tokens int"


def test_shares_and_repeats(spark):
    rnd = random.Random(2)
    rows = [("word " * rnd.randrange(1, 40), s) for s, n in (("A", 900), (" a\t", 300), ("b", 60), ("c", 500)) for _ in range(n)] + [("x " * 50, None), (None, "a"), ("", "b")]
    targets = spark.createDataFrame([("a", 0.5, 1, 0), ("B", 0.2, 4, 0), ("gone", 0.3, 2, 0)], TARGETS)
    df = documents(spark, rows)
    m = mixing.mix(df, targets).collect()
    used = {s: sum(r["n_tokens"] * r["repeats"] for r in m if r["source"] == s) for s in ("a", "b")}
    assert {r["source"] for r in m} == {"a", "b"} and len({r["doc_id"] for r in m}) == len(m)
    assert max(r["repeats"] for r in m if r["source"] == "a") == 1 and max(r["repeats"] for r in m if r["source"] == "b") <= 4
    assert abs(used["a"] / sum(used.values()) - 5 / 7) < 0.002
    got = {r["source"]: r for r in mixing.shares(df, targets).collect()}
    assert got["gone"]["actual_share"] == 0 and abs(sum(r["actual_share"] for r in got.values()) - 1) < 1e-9 and got["b"]["most_repeats"] <= 4


def test_blocks_fill_the_budget(spark, monkeypatch):
    monkeypatch.setattr(mixing, "BLOCK_DOCS", 10)
    counted = spark.range(1000).select(F.col("id").alias("doc_id"), F.lit("a").alias("source"), (F.col("id") % 7 + 1).alias("n_tokens"))
    total = counted.agg(F.sum("n_tokens")).first()[0]
    for budget in (0, 1, 100, total - 1, total, total + 55, 3 * total):
        plan = mixing.SourcePlan("a", 1.0, 1000, total, 3, budget)
        r = mixing.realise(counted, [plan]).agg(F.sum(F.col("n_tokens") * F.col("repeats")).alias("u"), F.max("repeats").alias("m")).first()
        assert (r["u"] or 0) <= budget and budget - (r["u"] or 0) <= 1 and (r["m"] or 0) <= -(-budget // total)


def test_empty_tables_and_bad_targets(spark):
    docs, none = documents(spark, [("a b c", "a")]), spark.createDataFrame([], TARGETS)
    assert mixing.mix(docs, none).count() == 0 == mixing.mix(docs.limit(0), spark.createDataFrame([("a", 1.0, 1, 1)], TARGETS)).count()
    bad = spark.createDataFrame([("a", math.nan, 1, 1), (None, 1.0, 1, 1), ("A", -3.0, None, 1)], TARGETS)
    assert mixing.mix(docs, bad).count() == 0 and mixing.shares(docs, bad).count() == 1


def test_temperature():
    shares = {"a": 0.8, "b": 0.15, "c": 0.05}
    assert mixing.temperature(shares) == 0.0  # nothing asked: even shares
    x = mixing.temperature(shares, target_entropy=0.9)
    assert abs(mixing.entropy(list(mixing.tempered(shares, x).values())) - 0.9) < 1e-6
    y = mixing.temperature(shares, limits={"a": 1.0, "b": 0.3, "c": 0.1})
    w = mixing.tempered(shares, y)
    assert w["c"] <= 0.1 + 1e-6 and w["b"] <= 0.3 + 1e-6 and max(w["c"] / 0.1, w["b"] / 0.3) > 0.999
    assert mixing.tempered({"a": 0.0}, 0.5) == {"a": 0.0}


def test_a_total_beyond_the_limits_bends_the_weights():
    plans = [mixing.SourcePlan("a", 0.9, 10, 100, 1), mixing.SourcePlan("b", 0.1, 10, 1000, 1)]
    mixing.budgets(plans, 500)
    assert plans[0].budget <= 100 and sum(p.budget for p in plans) >= 495
    # The exponent is the nearest to the targets that the repeats allow: a source is just used up.
    assert 0 < plans[0].exponent < 1 and plans[0].budget >= 99 and plans[0].limiting and not plans[1].limiting
    same = mixing.budgets([mixing.SourcePlan("a", 0.5, 1, 100, 2), mixing.SourcePlan("b", 0.5, 1, 1000, 1)])
    assert [p.budget for p in same] == [200, 200] and same[0].limiting and same[0].exponent == 1
    all_ = mixing.budgets([mixing.SourcePlan("a", 0.5, 1, 100, 2), mixing.SourcePlan("b", 0.5, 1, 1000, 1)], 10**9)
    assert [p.budget for p in all_] == [200, 1000] and all_[0].exponent < 1e-9


def test_weights_come_from_the_bisected_exponent(monkeypatch):
    monkeypatch.setattr(mixing, "bisect", lambda falls, low, high: 0.5)
    plans = mixing.budgets([mixing.SourcePlan("a", 0.9, 1, 100, 1), mixing.SourcePlan("b", 0.1, 1, 100, 1)], 100)
    assert [p.exponent for p in plans] == [0.5, 0.5] and [p.budget for p in plans] == [75, 25]


# ------------------------------------------------------------------ subjects
def corpus(n=240, seed=0):
    """Texts of a few topics with filler, their true subjects, some labels wrong."""
    rnd = random.Random(seed)
    terms = {"sea": ["anchor chain", "tidal pool", "lighthouse", "trawler net", "harbour wall"], "mill": ["grain hopper", "millstone", "flour sack", "water wheel", "sluice gate"], "chess": ["queen gambit", "endgame rook", "zugzwang", "castled king", "pawn storm"]}
    frames = ["There are {n} views of the {a} and one of the {b}.", "We talked about the {a}, then about the {b}.", "In frame {n} the {a} hides the {b}.", "My notes say {a} and {b} for number {n}."]
    filler = ["Thanks to everybody who wrote back.", "Some dates are wrong here.", "The album was put together in winter.", "Nobody remembers who took these."]
    texts, true = [], []
    for _ in range(n):
        own = rnd.sample(sorted(terms), rnd.choice([0, 1, 1, 1, 2]))
        parts = [rnd.choice(filler) for _ in range(rnd.randrange(1, 5))]
        for t in own:
            parts += [rnd.choice(frames).format(n=rnd.randrange(400), a=rnd.choice(terms[t]), b=rnd.choice(terms[t])) for _ in range(rnd.randrange(3, 7))]
        if rnd.random() < 0.2:
            t = rnd.choice(sorted(terms))
            if t not in own:
                parts.append(f"Someone joked about the {rnd.choice(terms[t])}.")
        rnd.shuffle(parts)
        texts.append(" ".join(parts))
        true.append(set(own))
    return texts, true, sorted(terms)


def labelled(spark, texts, true, names, wrong=0.03):
    rnd = random.Random(7)
    docs = spark.createDataFrame([(i, t, "x", 1) for i, t in enumerate(texts)], "doc_id bigint, text string, subject string, n_sentences int")
    rows = [(i, rnd.choice(names) if rnd.random() < wrong else s) for i, own in enumerate(true) for s in own]
    labels = spark.createDataFrame([*rows, *rows[:20], (None, "sea"), (3, None), (4, "unheard of"), (10**9, "sea")], "doc_id bigint, subject string")
    return docs, labels, spark.createDataFrame([(n, "g") for n in names] + [(None, "g")], "subject string, gloss string")


def test_held_out_accuracy(spark):
    texts, true, names = corpus(460, 3)
    docs, labels, subs = labelled(spark, texts[:160], true[:160], names)
    cfg = subjects.Settings()
    model = subjects.fit(*subjects.training_sample(docs, labels, subs, cfg), cfg)
    garbled = [t.replace(" ", "") if i % 9 == 0 else "­".join(t) if i % 9 == 1 else t.upper() if i % 9 == 2 else t for i, t in enumerate(texts[160:])]
    hit = said = have = 0
    for t, own in zip(garbled, true[160:]):
        got = {n for n, x in zip(names, subjects._document_counts(model, [t], model.threshold)[0]) if x >= 3}
        hit, said, have = hit + len(got & own), said + len(got), have + len(own)
    assert hit / said > 0.95 and hit / have > 0.9


def test_query_on_nulls_empty_and_long_texts(spark):
    texts, true, names = corpus(160, 3)
    docs, labels, subs = labelled(spark, texts, true, names, 0.0)
    long = " ".join(texts[i] for i in range(160)) * 12
    more = spark.createDataFrame([(1000, None, "", 0), (1001, "", "", 0), (1002, " \n12 !!", "", 0), (1003, long, "", 0), (None, texts[0], "", 0)], docs.schema)
    got = subjects.subject_areas(docs.unionByName(more), labels, subs)
    rows = got.collect()
    assert {r["subject"] for r in rows if r["doc_id"] == 1003} == set(names) and not {r["doc_id"] for r in rows} & {1000, 1001, 1002}
    found = {(r["doc_id"], r["subject"]) for r in rows if r["doc_id"] is not None and r["doc_id"] < 1000}
    want = {(i, s) for i, own in enumerate(true) for s in own}
    assert len(found & want) > 0.93 * len(want) and len(found & want) > 0.95 * len(found)


def test_without_labels_or_documents(spark):
    docs, labels, subs = labelled(spark, *corpus(10))
    assert subjects.subject_areas(docs, labels.limit(0), subs).count() == 0
    assert subjects.subject_areas(docs.limit(0), labels, subs).count() == 0
    assert subjects.subject_areas(docs, labels, subs.limit(0)).count() == 0


def test_sentences():
    assert subjects.sentences("One. Two!Three 3.5 x\nFour? 5.") == ["one", "two", "threex", "four"]
    assert subjects.sentences('He said "no." Then À­B.') == ["hesaidno", "thenab"]
    assert subjects.sentences("") == [] == subjects.sentences("123 ...")


def test_documents_repeat_their_result(spark):
    texts, true, names = corpus(80, 5)
    docs, labels, subs = labelled(spark, texts, true, names, 0.0)
    once = subjects.subject_areas(docs, labels, subs).count()
    assert once > 20 and subjects.subject_areas(docs.unionByName(docs), labels.distinct(), subs).count() in range(2 * once - 20, 2 * once + 21)


def test_all_queries_run(spark, sf):
    for name in ("p2_consensus_path", "p8_mix", "p8_shares", "p8_temperature", "p9_found", "p9_composition"):
        assert queries.QUERIES[name](spark, sf).count() > 0
