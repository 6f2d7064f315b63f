"""The operators' queries against SQL and brute force, on the small tables."""

import hashlib
import math
import re
from collections import Counter

import duckdb
import numpy as np
import pytest
import xxhash
from pyspark.sql import functions as F

from gridloom.llm import bpe, queries, quality_rules, simhash, toxicity, urls
from gridloom.llm.labelled import held_out

TABLES = "documents embeddings pages benchmark labels conversations".split()
SPACE = "\x20\x09-\x0d"


def table(spark, sf_dir, name):
    return spark.read.parquet(f"{sf_dir}/{name}.parquet")


@pytest.fixture(scope="module")
def duck(sf_dir):
    c = duckdb.connect()
    for t in TABLES:
        c.sql(f"CREATE VIEW {t} AS SELECT * FROM '{sf_dir}/{t}.parquet'")
    return c


@pytest.mark.parametrize("name", sorted(queries.ORACLES))
def test_oracle(spark, duck, sf_dir, name):
    found = duck.sql(queries.ORACLES[name])
    order = [list(found.columns).index(c) for c in sorted(found.columns)]
    df = queries.QUERIES[name](spark, sf_dir)
    assert sorted(df.columns) == sorted(found.columns)
    mine = sorted(str(tuple(r[c] for c in sorted(df.columns))) for r in df.collect())
    assert mine == sorted(str(tuple(r[i] for i in order)) for r in found.fetchall())


def brute_counts(text):
    text = text or ""
    words = re.findall(f"[^{SPACE}]+", text)
    seen = Counter(zip(words, words[1:], words[2:], strict=False))
    covered = {j for i in range(len(words) - 2) if seen[tuple(words[i : i + 3])] > 1 for j in (i, i + 1, i + 2)}
    lines = [x for x in text.split("\n") if re.search(f"[^{SPACE}]", x)]
    return len(words), sum(map(len, words)), sum(text.count(c) for c in "#*$%&|<>"), len(lines) - len(set(lines)), len(covered)


def quantile(values, q):
    values = sorted(values)
    return values[max(0, math.ceil(q * len(values)) - 1)]


def brute_fences(rows):
    """(high, low) of each ratio of one group's ``rows`` of (symbols, dup lines, repeats, chars a word, words, lines)."""
    low, mid, high = ([quantile([r[i] for r in rows], q) for i in range(6)] for q in (0.1, 0.5, 0.9))
    one = (1 / mid[4], 1 / mid[5], 6 / mid[4], mid[3] / mid[4])
    return [(high[i] + max(4 * (high[i] - mid[i]), 5 * one[i]), low[i] - max(4 * (mid[i] - low[i]), 5 * one[i]), mid[i]) for i in range(4)]


@pytest.mark.parametrize("table_dir", ["sf0.001", "sf0.01"])
def test_quality_rules(spark, table_dir):
    sf_dir = f"/root/testdata/{table_dir}"
    docs = {r["doc_id"]: r for r in table(spark, sf_dir, "documents").collect()}
    got = queries.QUERIES["op3_quality_rules"](spark, sf_dir).collect()
    assert len(got) == len(docs)
    ratios, groups, langs = {}, {}, {}
    for r in got:
        d = docs[r["doc_id"]]
        n, chars, symbols, dup, repeat = counts = brute_counts(d["text"])
        assert counts == (r["n_words"], r["word_chars"], r["n_symbols"], r["n_dup_lines"], r["n_repeat_words"])
        assert r["base_failed"] == (n < 50 or 100 * repeat > 50 * n)
        w, lines = max(n, 1), (d["text"] or "").count("\n") + 1
        if not r["base_failed"]:
            ratios[r["doc_id"]] = row = (symbols / w, dup / lines, repeat / w, chars / w, n, lines)
            groups.setdefault((d["lang"], d["source"]), []).append(row)
            langs.setdefault(d["lang"], []).append(row)
    whole = {k: brute_fences(v) for k, v in langs.items()}
    fences = {}
    for (lang, source), rows in groups.items():
        share, fences[lang, source] = len(rows) / (len(rows) + 50), []
        for (high, low, mid), (lang_high, lang_low, _) in zip(brute_fences(rows), whole[lang], strict=True):
            high = high if mid > lang_high else min(high, lang_high)
            low = low if mid < lang_low else max(low, lang_low)
            fences[lang, source].append((lang_high + share * (high - lang_high), lang_low + share * (low - lang_low)))
    for r in got:
        d, row = docs[r["doc_id"]], ratios.get(r["doc_id"])
        over = row and [(x - high, i == 3 and low - x) for i, (x, (high, low)) in enumerate(zip(row, fences[d["lang"], d["source"]], strict=False))]
        if row is None or max(map(max, over)) > 1e-9:
            assert not r["kept"]
        elif max(map(max, over)) < -1e-9 or not any(a > 0 or b > 0 for a, b in over):
            assert r["kept"]
    assert 0 < sum(r["kept"] for r in got) < len(got)


def test_fences_and_groups_decide(spark):
    """Another width or prior, or one group for all, changes verdicts."""
    docs = table(spark, "/root/testdata/sf0.1", "documents")
    measured = quality_rules.measure(docs).drop("text").cache()
    usual = {r["doc_id"] for r in quality_rules.judge(measured).where("kept").collect()}
    for other in (quality_rules.judge(measured, fence=0.0, occurrences=0.0), quality_rules.judge(measured.withColumns({"lang": F.lit(""), "source": F.lit("")}))):
        assert usual != {r["doc_id"] for r in other.where("kept").collect()}


def brute_print(text):
    words = re.findall(f"[^{SPACE}]+", re.sub("[A-Z]", lambda m: m[0].lower(), text or ""))
    if not words:
        return 0
    hashes = [xxhash.xxh64_intdigest(" ".join(words[i : i + 3]), 42) for i in range(max(1, len(words) - 2))]
    return sum(1 << b for b in range(64) if 2 * sum(h >> b & 1 for h in hashes) > len(hashes))


def brute_components(prints):
    ids, root = sorted(prints), {i: i for i in prints}

    def find(x):
        while root[x] != x:
            x = root[x]
        return x

    for n, i in enumerate(ids):
        for j in ids[n + 1 :]:
            if (prints[i] ^ prints[j]).bit_count() <= 3 and find(i) != find(j):
                root[max(find(i), find(j))] = min(find(i), find(j))
    return {i: find(i) for i in ids}


def brute_similar(texts):
    """Groups (as id → smallest id) of texts whose five-word similarity is 0.8 or more."""
    words = {i: (t or "").lower().split() for i, t in texts.items()}
    sets = {i: {tuple(w[k : k + 5]) for k in range(max(1, len(w) - 4))} for i, w in words.items()}
    ids, of = sorted(sets), {i: i for i in sets}
    for n, i in enumerate(ids):
        for j in ids[n + 1 :]:
            if 5 * len(sets[i] & sets[j]) >= 4 * len(sets[i] | sets[j]):
                old, new = max(of[i], of[j]), min(of[i], of[j])
                of = {k: new if v == old else v for k, v in of.items()}
    return of


def test_simhash(spark, sf_dir):
    prints = {r["doc_id"]: brute_print(r["text"]) for r in table(spark, sf_dir, "documents").collect()}
    want = brute_components(prints)
    got = queries.QUERIES["op4_simhash_near_dedup"](spark, sf_dir).collect()
    assert {r["doc_id"]: (r["fingerprint"], r["component_id"]) for r in got} == {i: (f"{p:016x}", want[i]) for i, p in prints.items()}


@pytest.mark.parametrize("name", ["op5_quality_classifier", "op10_toxicity"])
def test_classifiers_hold_out(spark, name):
    sf_dir, label = "/root/testdata/sf0.01", "quality" if "quality" in name else "toxic"
    got = queries.QUERIES[name](spark, sf_dir)
    rows = got.join(table(spark, sf_dir, "labels"), "doc_id").where("held_out").collect()
    assert got.count() == table(spark, sf_dir, "documents").count()
    y, score = np.array([r[label] for r in rows]), np.array([r["score"] for r in rows])
    better = (score[y == 1][:, None] > score[y == 0]).mean()
    assert better > 0.9 and ((0 <= score) & (score <= 1)).all()
    assert all(r["predicted"] == (r["score"] >= (0.5 if label == "quality" else 0.7)) for r in rows)


def test_bpe_and_counts(spark, sf_dir):
    import public_tokenizers
    from tokenizers import Tokenizer

    library = Tokenizer.from_file(public_tokenizers.path("byte_bpe_50k.json"))
    texts = {r["doc_id"]: r["text"] or "" for r in table(spark, sf_dir, "documents").collect()}
    got = {r["doc_id"]: r for r in queries.QUERIES["op7_bpe"](spark, sf_dir).collect()}
    counts = {r["doc_id"]: r for r in queries.QUERIES["op8_token_counts"](spark, sf_dir).collect()}
    for i, text in texts.items():
        ids = library.encode(text, add_special_tokens=False).ids
        decoded = library.decode(ids, skip_special_tokens=False)
        sha = hashlib.sha256(b"".join(x.to_bytes(4, "little") for x in ids)).hexdigest()
        assert tuple(got[i])[1:] == (len(ids), sha, hashlib.sha256(decoded.encode()).hexdigest())
        assert tuple(counts[i])[1:] == (len(text.encode()), len(ids), len(ids) > 1024)


def test_url_rules(spark, sf_dir):
    def rule_of(host, path):
        fits = [r for _, r in urls.RULES if (host == r.split("/")[0] or host.endswith("." + r.split("/")[0])) and path.startswith(r[r.index("/") :])]
        return max(fits, key=len, default=None)

    pages = {r["page_id"]: r["url"] for r in table(spark, sf_dir, "pages").collect()}
    actions = {r: a for a, r in urls.RULES}
    for r in queries.QUERIES["op1_url_filters"](spark, sf_dir).collect():
        m = re.search(r"://([^/?#]*)([^?#]*)", pages[r["page_id"]] or "", re.S)
        host, path = (m[1].lower(), m[2]) if m else ("", "")
        want = rule_of(host, path)
        assert (r["host"], r["path"], r["rule"]) == (host, path, want)
        assert r["verdict"] == (actions[want] if want else "block" if r["block_score"] >= 0.5 else "allow")


def test_pipeline(spark):
    import corpus_pipeline as p

    sf_dir = "/root/testdata/sf0.001"
    docs = table(spark, sf_dir, "documents")
    texts = {r["doc_id"]: r for r in docs.collect()}
    step = dict(p.STAGES)
    columns = docs.columns

    clean = step["toxicity"](spark, docs, sf_dir)
    assert clean.columns == columns
    scored = toxicity.score_documents(docs, toxicity.fit(docs, table(spark, sf_dir, "labels")))
    assert {r[0] for r in clean.select("doc_id").collect()} == {r[0] for r in scored.where("predicted = 0").select("doc_id").collect()}

    good = step["quality rules"](spark, docs, sf_dir)
    assert good.columns == columns
    judged = queries.QUERIES["op3_quality_rules"](spark, sf_dir)
    assert {r[0] for r in good.select("doc_id").collect()} == {r[0] for r in judged.where("kept").select("doc_id").collect()}

    single = step["SimHash near-dedup"](spark, docs, sf_dir)
    groups = brute_similar({i: r["text"] for i, r in texts.items()})
    assert single.columns == columns and sorted(r["doc_id"] for r in single.collect()) == sorted(set(groups.values()))

    mixed = step["mixing sources to target weights"](spark, docs, sf_dir)
    assert mixed.columns == columns
    want = Counter(r["doc_id"] for r in queries.QUERIES["op2_mixing"](spark, sf_dir).collect())
    assert Counter(r["doc_id"] for r in mixed.collect()) == want

    last = step["BPE encoding and decoding"](spark, docs, sf_dir)
    coder = bpe.encoder(bpe.vocabulary())
    assert all(r["ids"] == coder.encode_batch([texts[r["doc_id"]]["text"] or ""])[0] for r in last.limit(20).collect())

    whole = p.run(spark, sf_dir)
    chain = docs
    for _, f in p.STAGES:
        chain = f(spark, chain, sf_dir)
    assert sorted((r["doc_id"], r["ids_sha256"]) for r in whole.collect()) == sorted((r["doc_id"], r["ids_sha256"]) for r in chain.collect())


def test_fold(spark):
    import zlib

    got = spark.range(50).select("id", held_out(F.col("id")).alias("h")).collect()
    assert all(r["h"] == (zlib.crc32(str(r["id"]).encode()) % 3 == 1) for r in got)


def test_bit_slices_are_distances():
    rng = np.random.default_rng(5)
    base = rng.integers(0, 2**63, 40, np.uint64)
    noise = np.uint64(1) << rng.integers(0, 64, (4, 400)).astype(np.uint64)
    prints = base[rng.integers(0, 40, 400)] ^ (noise[0] | noise[1] | noise[2] * (rng.random(400) < 0.5))
    bucket = np.sort(rng.integers(0, 3, 400))
    labels = simhash.link_classes(prints, bucket, slab=50)
    want = np.arange(400)
    for _ in range(400):
        before = want.copy()
        for i in range(400):
            near = (np.bitwise_count(prints ^ prints[i]) <= 3) & (bucket == bucket[i])
            want[i] = want[near].min()
        if np.array_equal(before, want):
            break
    assert np.array_equal(labels, want)


def test_stages_keep_clashing_columns(spark, sf_dir):
    import corpus_pipeline as p

    own = {c: f"own {c}" for c in ("score", "predicted", "kept", "n_words", "copy", "shuffle_key", "fp", "component_id", "ids")}
    docs = table(spark, sf_dir, "documents").withColumns({k: F.lit(v) for k, v in own.items()})
    for _, stage in p.STAGES[:-1]:
        out = stage(spark, docs, sf_dir)
        assert out.columns == docs.columns and 0 < out.count()
        assert out.where(" OR ".join(f"{k} <> '{v}'" for k, v in own.items())).count() == 0
    empty = docs.limit(0)
    for _, stage in p.STAGES:
        assert stage(spark, empty, sf_dir).count() == 0
