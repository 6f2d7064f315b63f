"""Nulls, empty and long texts, ties, repeats, empty tables and clashing columns, for every operator."""

import hashlib
import os
import random
import subprocess
import sys
import zlib

import numpy as np
import pytest
from hypothesis import given, settings
from hypothesis import strategies as st
from pyspark.sql import functions as F

from gridloom.llm import bpe, chat, labelled, mixing, near_dedup, quality_model, quality_rules, simhash, token_counts, toxicity, urls, vectors

DOCS = "doc_id long, text string, lang string, source string, n_chars long"
PROSE = "the quick brown fox jumps over a lazy dog while seven other animals look on from their place in some far shade "
LONG = " ".join(f"word{i}" for i in range(60_000))


def documents(spark, rows):
    return spark.createDataFrame([(i, t, lang, source, len(t or "")) for i, t, lang, source in rows], DOCS)


@pytest.fixture(scope="module")
def odd(spark):
    """Every kind of odd row."""
    return documents(
        spark,
        [
            (1, None, "en", "a"), (2, "", "en", "a"), (3, " \n\t ", None, "a"), (4, "one", "en", None), (5, "one two", None, None),
            (6, LONG, "en", "a"), (7, PROSE * 4, "en", "a"), (7, PROSE * 4, "en", "a"), (None, PROSE * 4, "en", "a"), (8, "x" * 50_000, "en", "a"),
            (None, None, None, None), (9, "漢字 " * 300 + "<|endoftext|>", "zh", "b"),
        ],
    )


@pytest.fixture(scope="module")
def none(spark):
    return documents(spark, [])


LABELS = "doc_id long, quality int, toxic int"


# -- op1


def test_urls(spark):
    rows = [(1, None, 5), (2, "", 5), (3, "no scheme", 5), (4, "HTTP://WWW.Example.COM/en/x?a#b", 5), (5, "x://net/es/", 5), (5, "x://net/es/", 5), (None, "x://a.net/fr/" + "y" * 20_000, 5), (6, "x://h?://com/", 5), (7, "x://İ.com", 5), (8, "x://a\nb/", 5)]
    df = spark.createDataFrame(rows, "page_id long, url string, host int")
    got = {r["page_id"]: r for r in urls.with_verdict(df).collect()}
    assert urls.with_verdict(df).count() == len(rows)
    assert [got[i]["host"] for i in (1, 2, 3)] == ["", "", ""]
    assert (got[4]["host"], got[4]["path"], got[4]["rule"], got[4]["verdict"]) == ("www.example.com", "/en/x", "www.example.com/en/", "allow")
    assert got[5]["rule"] == "net/es/" and got[None]["rule"] == "net/fr/" and got[6]["host"] == "h" and got[7]["rule"] is None and got[8]["host"] == "a\nb"
    empty = urls.with_verdict(df.limit(0))
    assert empty.count() == 0
    one_class = urls.with_verdict(df.where("page_id = 5"))
    assert {r["verdict"] for r in one_class.collect()} == {"block"}


def test_url_trees_learn(spark):
    random.seed(2)
    bad = [f"http://x{random.randint(1000, 9999)}.example.org/{random.randint(10**6, 10**7)}?a=1&b=2" for _ in range(300)]
    good = [f"http://site.example.org/{w}/{v}" for w in ("news", "blog", "docs") for v in map(chr, range(97, 123)) for _ in range(4)]
    df = spark.createDataFrame([(u, 1) for u in bad] + [(u, 0) for u in good], "url string, y int")
    model = urls.fit(df)
    scored = urls._with_features(df.withColumn("__url", F.col("url")), model.suffixes, model.prior).select("y", model.probability().alias("p"))
    assert scored.where("(p >= 0.5) = (y = 1)").count() > 0.95 * scored.count()


def test_url_scores_by_brute_force(spark):
    """The CASE expression scores as a walk over the trees does, with statistics counted by hand."""
    random.seed(4)
    hosts = [f"{a}.{b}.{c}" for a in ("www", "m", "shop") for b in ("one", "two", "three") for c in ("org", "net")]
    rows = [(f"http://{random.choice(hosts)}/{'x' * random.randint(0, 30)}{random.randint(0, 10**6)}", 0) for _ in range(400)]
    rows = [(u, int("two" in u or (".net" in u and random.random() < 0.6))) for u, _ in rows]
    model = urls.fit(spark.createDataFrame(rows, "url string, y int"))
    share = sum(y for _, y in rows) / len(rows)
    host = lambda u: u.split("/")[2]
    new = [f"https://{random.choice(hosts)}/{i}?a={i % 7}" for i in range(60)] + ["http://unseen.example/", None, "x"]
    shown = urls._with_features(spark.createDataFrame([(u,) for u in new], "url string").withColumn("__url", F.col("url")), model.suffixes, model.prior)
    for r in shown.withColumn("p", model.probability()).collect():
        for k in urls.LABELS:
            end = ".".join(host(r["url"]).split(".")[-k:]) if r["url"] and "//" in r["url"] else ""
            same = [y for u, y in rows if ".".join(host(u).split(".")[-k:]) == end]
            assert r[f"__f_suffix{k}_rate"] == pytest.approx((sum(same) + 10 * share) / (len(same) + 10))
        margin = model.base
        for tree in model.trees:
            while tree.low is not None:
                tree = tree.low if r[tree.feature] < tree.threshold else tree.high
            margin += tree.value
        assert r["p"] == pytest.approx(1 / (1 + np.exp(-margin)))


# -- op2


def test_mixing(spark, odd, none):
    clash = odd.withColumn("copy", F.lit("mine")).withColumn("shuffle_key", F.lit(1))
    mixed = mixing.mix(clash)
    assert mixed.columns == [*DOCS_NAMES, "copy", "shuffle_key"]
    assert mixing.mix(none).count() == 0
    first = odd.where("doc_id = 7").limit(1)
    sevens = [mixing.mix(first.unionByName(first)).where("doc_id = 7").count(), mixing.mix(odd, size=5.0).where("doc_id = 7").count()]
    assert all(n % 2 == 0 for n in sevens) and sevens[1] > 0  # both rows draw the same count, and each has its copies
    assert mixing.mix(odd, weights={"a": 0.0, "b": 0.0, "": 0.0}, other=0.0).count() == 0


DOCS_NAMES = ["doc_id", "text", "lang", "source", "n_chars"]


def test_mixing_deals_out_repeated_rows(spark):
    spark.conf.set("spark.sql.adaptive.coalescePartitions.enabled", "false")
    try:
        rows = spark.range(4_000, numPartitions=4).select(F.lit(1).cast("long").alias("doc_id"), F.lit("same").alias("text"), F.lit("a").alias("source"))
        held = mixing.mix(rows, {}, size=3.0).groupBy(F.spark_partition_id()).count().collect()
        total = sum(r["count"] for r in held)
        assert total and total % 4_000 == 0 and max(r["count"] for r in held) < 0.4 * total
    finally:
        spark.conf.unset("spark.sql.adaptive.coalescePartitions.enabled")


def test_mixing_meets_targets(spark):
    df = spark.range(20_000).select(F.col("id").alias("doc_id"), F.col("id").cast("string").alias("text"), F.when(F.col("id") % 10 < 8, "big").otherwise("small").alias("source"))
    got = {r["source"]: r["count"] for r in mixing.mix(df, {"big": 1.0, "small": 3.0}).groupBy("source").count().collect()}
    assert abs(got["small"] - 15_000) < 500 and abs(got["big"] - 5_000) < 300
    heavy = mixing.mix(df.where("doc_id < 10"), {}, size=900.0)
    assert abs(heavy.count() - 9_000) < 500
    order = [r["doc_id"] for r in mixing.mix(df).limit(50).collect()]
    assert order != sorted(order)


# -- op3


def test_quality_rules(spark, odd, none):
    clash = odd.withColumn("kept", F.lit("mine")).withColumn("n_words", F.lit(-1))
    got = quality_rules.judge(quality_rules.measure(clash)).collect()
    assert len(got) == odd.count()
    by = {r["doc_id"]: r for r in got}
    assert [by[i]["n_words"] for i in (1, 2, 3, 4, 5, 6)] == [0, 0, 0, 1, 2, 60_000]
    assert by[6]["n_repeat_words"] == 0 and by[7]["n_repeat_words"] == by[7]["n_words"] and by[7]["base_failed"] and not by[1]["kept"]
    assert quality_rules.judge(quality_rules.measure(none)).count() == 0


def test_repeats_overlap(spark):
    texts = ["a b c a b c", "a a a a", "a a a", "a b c d a b", "x a b c y a b c z"]
    df = documents(spark, [(i, t, "en", "a") for i, t in enumerate(texts)])
    assert [r["n_repeat_words"] for r in quality_rules.measure(df).orderBy("doc_id").collect()] == [6, 4, 0, 0, 6]


def test_outliers_go_and_clean_stay(spark):
    clean = [(i, " ".join(f"w{(i * 7 + j * j) % 997}" for j in range(80)), "en", "a") for i in range(60)]
    noisy = [(100, " ".join(f"w{j}###" for j in range(80)), "en", "a")]
    got = quality_rules.judge(quality_rules.measure(documents(spark, clean + noisy)))
    assert {r["doc_id"] for r in got.where("NOT kept").collect()} == {100}


def test_blank_lines_are_no_duplicates(spark):
    paragraphs = [" ".join(f"w{i}x{j}" for j in range(5)) for i in range(20)]
    texts = ["\n\n".join(paragraphs), "\n \t\x0b\x0c\r\n".join(paragraphs), "\n".join(paragraphs), "a\n\nb\n \nc\n\n", "a\n\n b\na\n\na"]
    got = quality_rules.judge(quality_rules.measure(documents(spark, [(i, t, "en", "a") for i, t in enumerate(texts)]))).collect()
    by = {r["doc_id"]: r for r in got}
    assert [by[i]["n_dup_lines"] for i in range(5)] == [0, 0, 0, 0, 2]
    assert by[0]["kept"] and by[1]["kept"] and by[2]["kept"]


def test_junk_does_not_set_its_own_standard(spark):
    clean = [(i, " ".join(f"w{(i * 7 + j * j) % 997}" for j in range(80)), "en", f"s{i % 4}") for i in range(240)]
    junk = [(1000 + i, " ".join(f"w{j}{'#' * (1 + i % 3)}" for j in range(80)), "en", "s1") for i in range(20)]
    code = [(2000 + i, " ".join(f"w{(i * j) % 91}&" for j in range(80)), "en", "code") for i in range(12)]
    got = quality_rules.judge(quality_rules.measure(documents(spark, clean + junk)))
    assert {r["doc_id"] for r in got.where("NOT kept").collect()} == {r[0] for r in junk}
    apart = quality_rules.thresholds(quality_rules.measure(documents(spark, clean + code))).where("source = 'code'").first()
    assert apart["high_symbols_per_word"] > 0.1  # a source that is all of another kind keeps a part of its own fence


# -- op4


def test_simhash(spark, odd, none):
    got = simhash.near_duplicates(odd).collect()
    assert len(got) == odd.count()
    by = {r["doc_id"]: r for r in got if r["doc_id"]}
    assert by[1]["fp"] == by[2]["fp"] == by[3]["fp"] == 0 and by[3]["component_id"] == 1
    assert all(r["component_id"] == 7 for r in got if r["fp"] == by[7]["fp"])
    kept = near_dedup.near_dedup(odd.withColumn("fp", F.lit("mine"))).collect()
    assert sorted(r["doc_id"] for r in kept) == [1, 4, 5, 6, 7, 8, 9]
    assert simhash.near_duplicates(none).count() == 0 and near_dedup.near_dedup(none).count() == 0
    nameless = near_dedup.near_dedup(odd.where("doc_id IS NULL"))
    assert nameless.count() == 2


def test_groups_that_share_an_id_both_stay(spark):
    a, b = ("".join(f"{c}{i} " for i in range(200)) for c in "ab")
    rows = [(7, a, "en", "a"), (7, b, "en", "a"), (12, b.upper(), "en", "a"), (15, a.upper(), "en", "a"), (None, LONG, None, None), (None, LONG + " ", None, "b")]
    kept = near_dedup.near_dedup(documents(spark, rows)).collect()
    assert sorted((r["doc_id"] or 0, r["text"].strip()[:2]) for r in kept) == [(0, "wo"), (7, "a0"), (7, "b0")]


def test_hot_buckets_lose_nothing(spark):
    base = 0x0F0F_3C3C_A5A5_9999
    near = [base ^ (1 << a) ^ (1 << b) for a in range(64) for b in range(a)]
    signed = [p - (1 << 64) if p >> 63 else p for p in near]
    edges = simhash.link_forest(spark.createDataFrame([(p,) for p in signed], "fp long"), bucket_rows=64)
    from gridloom.operators.components import components

    found = components(edges)
    assert found.count() == len(near) and found.select("component").distinct().count() == 1


# -- the pipeline's near-duplicates by five words


def brute_similar(texts):
    """Groups (as id → smallest id) of texts whose five-word similarity is 0.8 or more."""
    words = {i: (t or "").lower().split() for i, t in texts.items()}
    sets = {i: {tuple(w[k : k + 5]) for k in range(max(1, len(w) - 4))} for i, w in words.items()}
    ids, of = sorted(sets), {i: i for i in sets}
    for n, i in enumerate(ids):
        for j in ids[n + 1 :]:
            a, b = sets[i], sets[j]
            if 5 * min(len(a), len(b)) >= 4 * max(len(a), len(b)) and 5 * len(a & b) >= 4 * len(a | b):
                old, new = max(of[i], of[j]), min(of[i], of[j])
                of = {k: new if v == old else v for k, v in of.items()}
    return of


@pytest.mark.parametrize("table", ["sf0.001", "sf0.01"])
def test_the_stage_leaves_no_similar_pair(spark, table):
    import corpus_pipeline as p

    docs = spark.read.parquet(f"/root/testdata/{table}/documents.parquet")
    texts = {r["doc_id"]: r["text"] for r in docs.collect()}
    want = brute_similar(texts)
    assert sorted(r["doc_id"] for r in near_dedup.near_dedup(docs).collect()) == sorted(set(want.values()))
    left = {r["doc_id"]: r["text"] for r in dict(p.STAGES)["SimHash near-dedup"](spark, docs, f"/root/testdata/{table}").collect()}
    assert sorted(left) == sorted(set(want.values()))
    assert all(i == j for i, j in brute_similar(left).items())


def test_the_radius_keeps_similar_pairs():
    """Fingerprints of sets at the bound, large and small, differ in fewer bits than the radius."""
    rng = np.random.default_rng(3)
    most = 0
    for n in (4, 5, 8, 20, 100, 1000):
        for _ in range(400):
            shared = rng.integers(0, 2**64, n, np.uint64)
            more = rng.integers(0, 2**64, n // 4, np.uint64)
            cut = int(rng.integers(0, len(more) + 1))
            a, b = np.concatenate((shared, more[:cut])), np.concatenate((shared, more[cut:]))
            most = max(most, (near_dedup.fingerprint(a) ^ near_dedup.fingerprint(b)).bit_count())
    assert 10 < most <= near_dedup.RADIUS


def test_five_words_in_any_buckets(spark, odd, none):
    base = [f"w{i}" for i in range(300)]
    near = [" ".join(base[:k] + [f"x{k}"] + base[k + 1 :]) for k in range(120)]
    docs = documents(spark, [(i, t, "en", "a") for i, t in enumerate([*near, *near[:60]])])
    for rows in (5, 256):
        assert [r["doc_id"] for r in near_dedup.near_dedup(docs, rows).collect()] == [0]
    kept = near_dedup.near_dedup(odd.withColumn("fp", F.lit("mine"))).collect()
    assert sorted(r["doc_id"] for r in kept) == [1, 4, 5, 6, 7, 8, 9]
    assert near_dedup.near_dedup(none).count() == 0


# -- the pipeline's stages on odd rows


def test_stages_on_odd_rows(spark, odd):
    import corpus_pipeline as p

    sf_dir = "/root/testdata/sf0.001"
    rows = odd.withColumn("note", F.lit("mine"))
    key = lambda r: (r["doc_id"] is None, r["doc_id"])
    step = dict(p.STAGES)
    clean = step["toxicity"](spark, rows, sf_dir)
    assert clean.columns == rows.columns and clean.count() == rows.count()  # none of their ids has a label
    good = step["quality rules"](spark, rows, sf_dir).collect()
    assert {r["doc_id"] for r in good} <= {6, 9} and 6 in {r["doc_id"] for r in good} and all(r["note"] == "mine" for r in good)
    single = step["SimHash near-dedup"](spark, rows, sf_dir)
    assert sorted(r["doc_id"] for r in single.collect()) == [1, 4, 5, 6, 7, 8, 9]
    mixed = step["mixing sources to target weights"](spark, rows, sf_dir).collect()
    sevens = sum(r["doc_id"] == 7 for r in mixed)
    assert sevens % 2 == 0 and {key(r) for r in mixed} <= {key(r) for r in rows.collect()}
    last = step["BPE encoding and decoding"](spark, rows, sf_dir)
    assert last.columns == [*(c for c in rows.columns if c != "text"), "ids", "n_tokens", "ids_sha256", "decoded_sha256"]
    assert {r["n_tokens"] for r in last.where("doc_id <= 2").collect()} == {0} and last.count() == rows.count()


# -- op5 and op10


@pytest.mark.parametrize("module", [toxicity, quality_model])
def test_classifiers(spark, odd, none, module):
    label = "toxic" if module is toxicity else "quality"
    rows = [(i, PROSE + (" awful idiot " if i % 2 else " kind friend "), "en", "a") for i in range(100, 400)]
    docs = documents(spark, rows).unionByName(odd)
    labels = spark.createDataFrame([(i, i % 2, i % 2) for i in range(100, 400)] + [(None, 1, 1), (1, None, None), (100, 0, 0)], LABELS)
    model = module.fit(docs, labels)
    clash = docs.withColumn("score", F.lit("mine")).withColumn("doc_label", F.lit(1))
    got = module.score_documents(clash, model).collect()
    assert len(got) == docs.count() and all(0 <= r["score"] <= 1 for r in got)
    assert len({r["score"] for r in got if r["doc_id"] == 7}) == 1
    right = [r["predicted"] == r["doc_id"] % 2 for r in got if r["doc_id"] and r["doc_id"] >= 100]
    assert np.mean(right) > 0.95
    for few in (labels.limit(0), labels.where(f"{label} = 1")):
        plain = module.score_documents(odd, module.fit(odd, few)).collect()
        assert len({r["score"] for r in plain}) == 1
    assert module.score_documents(none, model).count() == 0
    assert module.score_documents(none, module.fit(none, labels)).count() == 0


def test_labels_of_other_documents_take_no_place(spark):
    docs = documents(spark, [(i, f"text {i}", "en", "a") for i in range(0, 60_000, 500)])
    labels = spark.range(60_000).select(F.col("id").alias("doc_id"), (F.col("id") % 1000 == 0).cast("int").alias("toxic"))
    sample, all0, all1 = labelled.labelled_sample(docs, labels, "toxic", 30, "test")
    sizes = {r["y"]: r["count"] for r in sample.groupBy("y").count().collect()}
    own = [i for i in range(0, 60_000, 500) if zlib.crc32(str(i).encode()) % 3 != 1]
    assert sizes == {y: min(30, sum(i % 1000 == 500 * (1 - y) for i in own)) for y in (0, 1)}
    assert all0 > 30_000 and all1 < 60


def test_a_labelled_id_with_many_rows_is_in_the_sample_once(spark):
    docs = documents(spark, [(1, f"text {i % 7}", "en", "a") for i in range(1000)] + [(2, "two", "en", "a"), (2, None, "en", "a"), (3, "three", "en", "a"), (3, "three", "en", "a")])
    labels = spark.createDataFrame([(1, 1), (2, 0), (3, 0)], "doc_id long, toxic int")
    sample = labelled.labelled_sample(docs, labels, "toxic", 10, "test")[0].collect()
    assert sorted(r["doc_id"] for r in sample) == [i for i in (1, 2, 3) if zlib.crc32(str(i).encode()) % 3 != 1]


def test_toxicity_weights_do_not_depend_on_the_hash_seed():
    """Python salts its own hash of bytes by process; two processes still fit the same weights."""
    code = """
import hashlib
from pyspark.sql import SparkSession
from gridloom.llm import toxicity
spark = SparkSession.builder.master("local[2]").config("spark.ui.enabled", "false").config("spark.sql.shuffle.partitions", "2").getOrCreate()
read = lambda t: spark.read.parquet(f"/root/testdata/sf0.001/{t}.parquet")
m = toxicity.fit(read("documents"), read("labels"))
print("digest", hashlib.sha256(m.weights.tobytes()).hexdigest(), repr(m.intercept))
"""
    said = set()
    for seed in ("1", "2"):
        run = subprocess.run([sys.executable, "-c", code], env=os.environ | {"PYTHONHASHSEED": seed}, capture_output=True, text=True, timeout=600)
        said.add(next(x for x in run.stdout.splitlines() if x.startswith("digest")))
    assert len(said) == 1


def test_temperature():
    rng = np.random.default_rng(1)
    z = rng.normal(0, 2, 4000)
    y = (rng.random(4000) < 1 / (1 + np.exp(-z))).astype(float)
    assert 2.5 < quality_model.best_temperature(3 * z, y, np.ones(4000)) < 3.6


# -- op6


def test_vectors(spark):
    nan, inf = float("nan"), float("inf")
    rows = [(0, [1.0, 0.5], "q"), (1, [1.0, 0.5], "q"), (2, None, "q"), (3, [1.0, None], "q"), (4, [nan, 1.0], "q"), (5, [inf, 1.0], "q"), (6, [1.0], "q"), (7, [], "q"), (None, [9.0, 9.0], "q"), (8, [-1.0, -0.5], "q"), (8, [-1.0, -0.5], "q"), (50, [0.5, 0.25], "q")]
    df = spark.createDataFrame(rows, "vec_id long, embedding array<float>, score string")
    got = {(r["query_id"], r["rank"]): (r["vec_id"], r["score"]) for r in vectors.top_k(df, F.col("vec_id") % 50 == 0).collect()}
    assert [got[0, i] for i in range(1, 6)] == [(1, 256 * 256 + 128 * 128), (6, 256 * 256), (50, 256 * 128 + 128 * 64), (7, 0), (8, -(256 * 256 + 128 * 128))]
    assert vectors.top_k(df.limit(0), F.col("vec_id") % 50 == 0).count() == 0
    assert vectors.top_k(df.where("vec_id = 1"), F.col("vec_id") % 50 == 0).count() == 0
    huge = spark.createDataFrame([(0, [1e30, 1.0]), (1, [1e30, -1.0]), (2, [-1e30, 0.0])], "vec_id long, embedding array<float>")
    top = [(r["vec_id"], r["score"]) for r in vectors.top_k(huge, F.col("vec_id") == 0).orderBy("rank").collect()]
    assert top == [(1, 2**63 - 1), (2, -(2**63))]


def test_repeated_queries_each_have_their_own_results(spark):
    rows = [(50, [1.0, 0.0]), (50, [1.0, 0.0]), (50, [0.0, 1.0]), *((i, [0.5, i / 16]) for i in range(1, 9)), (3, [0.5, 3 / 16])]
    df = spark.createDataFrame(rows, "vec_id long, embedding array<float>")
    got = sorted(tuple(r) for r in vectors.top_k(df, F.col("vec_id") == 50).collect())
    first = [(50, n + 1, i, 256 * 128) for n, i in enumerate((1, 2, 3, 3, 4))]
    other = [(50, n + 1, i, 256 * 16 * i) for n, i in enumerate((8, 7, 6, 5, 4))]
    assert got == sorted([*first, *first, *other])


def test_many_equal_vectors(spark):
    rows = [(i, [0.5, 0.25]) for i in range(700) for _ in range(1 + (i == 0) * 20)] + [(i, [0.1, i / 1024]) for i in range(700, 800)]
    df = spark.createDataFrame(rows, "vec_id long, embedding array<float>")
    got = vectors.top_k(df, F.col("vec_id") % 50 == 0, candidate_rows=64).collect()
    score = 128 * 128 + 64 * 64
    assert sum(r["query_id"] == 0 for r in got) == 21 * 5
    assert {(r["rank"], r["vec_id"], r["score"]) for r in got if r["query_id"] == 0} == {(i, i, score) for i in range(1, 6)}
    assert {(r["rank"], r["vec_id"], r["score"]) for r in got if r["query_id"] == 50} == {(i, 0, score) for i in range(1, 6)}


def test_vectors_are_exact_in_any_blocks(spark):
    rng = np.random.default_rng(7)
    m = np.round(rng.normal(0, 0.2, (300, 8)), 1).astype(np.float32)
    m[50:120] = m[49]
    df = spark.createDataFrame([(i, v.tolist()) for i, v in enumerate(m)], "vec_id long, embedding array<float>")
    whole = np.floor(256 * m.astype(float)).astype(int)
    want = set()
    for q in range(0, 300, 50):
        order = sorted((i for i in range(300) if i != q), key=lambda i, q=q: (-int(whole[q] @ whole[i]), i))[:5]
        want |= {(q, n + 1, i, int(whole[q] @ whole[i])) for n, i in enumerate(order)}
    for candidates, asked in ((4096, 512), (37, 2)):
        assert {tuple(r) for r in vectors.top_k(df, F.col("vec_id") % 50 == 0, candidate_rows=candidates, query_rows=asked).collect()} == want


# -- op7 and op8


@pytest.fixture(scope="module")
def library():
    import public_tokenizers
    from tokenizers import Tokenizer

    return Tokenizer.from_file(public_tokenizers.path("byte_bpe_50k.json"))


def test_bpe(spark, odd, none, library):
    got = bpe.encode_documents(odd.withColumn("ids", F.lit("mine"))).collect()
    for r in got:
        assert r["ids"] == library.encode(r["text"] or "", add_special_tokens=False).ids
    assert bpe.encode_documents(none).count() == 0


PIECES = ["a", "the", " ", "  ", "\n", "'", "'re", "'ll", "'s", "1", "23", "<|endoftext|>", "<|end", "é", "漢字", "!", "\u00a0", "\x1c", "\x85", "🙂", "ing", "thethethethe", "aaaaaaa", "\u0301", "²"]
TEXTS = st.lists(st.sampled_from(PIECES), max_size=60).map("".join)


@settings(max_examples=400, deadline=None)
@given(TEXTS, st.integers(1, 9))
def test_trees_are_exact(library, text, leaf):
    coder = bpe.encoder(bpe.vocabulary())
    before, bpe.LEAF, short, bpe.SHORT = bpe.LEAF, leaf, bpe.SHORT, 3
    coder.packed.clear()
    try:
        texts = [text, text.replace(" ", ""), text.replace("a", "'")]
        assert coder.encode_batch(texts) == [library.encode(t, add_special_tokens=False).ids for t in texts]
    finally:
        bpe.LEAF, bpe.SHORT = before, short


def test_ordinary_texts_are_trees(spark, library, monkeypatch):
    """Joins make the ids of documents, also where a leaf ends inside a word or a run of spaces."""
    coder = bpe.encoder(bpe.vocabulary())
    joins = []
    join = coder.join
    monkeypatch.setattr(coder, "join", lambda a, b: joins.append(1) or join(a, b))
    texts = [r["text"] or "" for r in spark.read.parquet("/root/testdata/sf0.001/documents.parquet").collect()]
    assert coder.encode_batch(texts) == [library.encode(t, add_special_tokens=False).ids for t in texts]
    assert len(joins) > len(texts)


def test_the_pattern_cuts_as_the_public_one():
    import public_tokenizers
    import regex

    public = regex.compile(public_tokenizers.PATTERN)
    for c in map(chr, range(0x250)):
        for text in (c, f"a{c}b", f" {c} 1", f"'{c}", f"{c}{c}!", f"s'{c}re", f"\n{c}  "):
            assert bpe._OTHER.search(text) or bpe._CUT.findall(text) == public.findall(text)


@settings(max_examples=150, deadline=None)
@given(TEXTS)
def test_every_prefix_is_exact(library, text):
    counts = token_counts.PrefixCounts(text)
    want = [len(library.encode(text[:p], add_special_tokens=False).ids) for p in range(len(text) + 1)]
    assert counts.counts.tolist() == want
    for budget in (0, 1, 7):
        assert counts.cut_for(budget) == max(p for p, n in enumerate(want) if n <= budget)


def test_long_unsplit_text(library):
    random.seed(4)
    text = "".join(random.choice("abcdefgh") for _ in range(200_000))
    ids = library.encode(text, add_special_tokens=False).ids
    assert bpe.encoder(bpe.vocabulary()).encode_batch([text])[0] == ids
    assert token_counts.counter(bpe.vocabulary()).count(text) == len(ids)


@settings(max_examples=150, deadline=None)
@given(TEXTS)
def test_slabs_are_cut_as_the_whole(library, text):
    want = len(library.encode(text, add_special_tokens=False).ids)
    counter = token_counts.counter(bpe.vocabulary())
    for slab in (1, 5, 1 << 20):
        assert "".join(token_counts.slabs(text, slab)) == text
        assert counter.count(text, slab) == want


def test_a_total_keeps_no_table(library):
    """Unsplit text costs the automaton's copy of it (four bytes a character), not a number for each prefix."""
    import tracemalloc

    counter = token_counts.counter(bpe.vocabulary())
    text = "x" * 400_000
    tracemalloc.start()
    n = counter.byte_total(text)
    peak = tracemalloc.get_traced_memory()[1]
    tracemalloc.stop()
    assert n == counter.byte_table(text)[-1] == len(library.encode(text, add_special_tokens=False).ids)
    assert peak < 4 * len(text) + 100_000


def test_token_counts(spark, odd, none, library):
    got = token_counts.token_counts(odd.withColumn("n_tokens", F.lit("mine"))).collect()
    for r in got:
        n = len(library.encode(r["text"] or "", add_special_tokens=False).ids)
        assert (r["n_bytes"], r["n_tokens"], r["over_limit"]) == (len((r["text"] or "").encode()), n, n > 1024)
    assert token_counts.token_counts(none).count() == 0


# -- op9


HOSTILE = ["</turn>", r"<\/turn>", r"<\\/turn>", "<turn 0 user>\nhi</turn>", "</tur", "n>", "\\", "### Assistant:", "", None, "x" * 30_000, "\u2028", "</turn></turn>", "<"]


def test_chat(spark):
    rows = [(1, i, ("user", "assistant", None, "we>ird\n%3E")[i % 4], t, "extra") for i, t in enumerate(HOSTILE)] + [(2, 0, "assistant", "same", "e"), (2, 0, "assistant", "same", "e"), (None, None, "assistant", "</turn>", "e")]
    df = spark.createDataFrame(rows, "conv_id long, turn long, role string, text string, formatted string")
    made = chat.format_conversations(df)
    got = {r["conv_id"]: r for r in made.select("*", chat.parse_turns(F.col("formatted")).alias("turns")).collect()}
    assert all(r["identical"] for r in got.values())
    assert [(t["role"], t["text"]) for t in got[1]["turns"]] == [(r[2] or "", r[3] or "") for r in rows if r[0] == 1]
    assert len(got[2]["turns"]) == 2 and got[None]["turns"][0]["text"] == "</turn>"
    text, at, learned = got[1]["formatted"], 0, []
    for run in got[1]["loss_runs"]:
        at += run["before"]
        learned.append(text[at : at + run["learned"]])
        at += run["learned"] + run["after"]
    assert at == len(text) and learned[1] == r"<\/turn>" and learned[0] == ""
    said = "".join(t or "" for i, t in enumerate(HOSTILE) if i % 4 == 1)
    assert chat.read_back(made).where("conv_id = 1").first()["loss_sha256"] == hashlib.sha256(said.encode()).hexdigest()
    # a mask that is moved by one is read where it lies
    moved = made.where("conv_id = 2").withColumn("loss_runs", F.transform("loss_runs", lambda r: F.struct((r["before"] + 1).alias("before"), r["learned"].alias("learned"), (r["after"] - 1).alias("after"))))
    assert chat.read_back(moved).first()["loss_sha256"] == hashlib.sha256(b"ame<ame<").hexdigest()
    with pytest.raises(Exception, match="does not read back"):
        chat.read_back(made.withColumn("identical", F.lit(False))).collect()
    assert chat.format_conversations(df.limit(0)).count() == 0


@settings(max_examples=200, deadline=None)
@given(st.lists(st.sampled_from(["<", "\\", "/turn>", "</turn>", "x", "\n"]), max_size=12).map("".join))
def test_escape_is_reversible(text):
    import re

    quoted = re.sub(r"<(\\*)/turn>", r"<\1\\/turn>", text)
    assert "</turn>" not in quoted and re.sub(r"<(\\*)\\/turn>", r"<\1/turn>", quoted) == text
