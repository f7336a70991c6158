"""The training-data operators against brute force on small fixtures."""

import hashlib
import math
import random
import re
import zlib
from collections import Counter

import numpy as np
import pytest
from pyspark.sql import functions as F

from wardline.llm import ann_forest, byte_bpe, exact_dedup, licenses, lm_scoring, mixing, near_dedup, quality, queries, sentencepiece_codec, token_shards, toxicity
from wardline.llm.common import word_hashes



def tokenizers_path(name):
    """Tests of the two tokenizers alone need their files."""
    return pytest.importorskip("public_tokenizers").path(name)


SCHEMA = "doc_id long, text string, lang string, source string, n_chars long, __id string, `odd name` int, score double, reps int, pattern int, size int"
WORDS = "the of and in a that house tree river stone light winter long short green idea water north song".split()


def rows_of(texts, sources=None):
    return [(i, t, "en", sources[i] if sources else f"s{i % 3}", len(t or ""), "x", 1, 0.5, 7, 7, 7) for i, t in enumerate(texts)]


def random_text(rng, n):
    return " ".join(rng.choice(WORDS) + rng.choice(["", "", ".", ","]) for _ in range(n))


@pytest.fixture(scope="module")
def docs(spark):
    rng = random.Random(5)
    texts = [random_text(rng, rng.randint(5, 120)) for _ in range(60)]
    texts += [texts[0], texts[1].replace(" ", " \n\t"), None, "", " ", "one", "one two three", "x " * 30000, "é日本 ▁ <s>  x  y\n\nz ", texts[3]]
    rows = rows_of(texts) + [(3, texts[3], "en", "s0", 1, "x", 1, 0.5, 7, 7, 7), (None, "lost id", *[None] * 9)]
    return spark.createDataFrame(rows, SCHEMA).repartition(3).persist()


@pytest.fixture(scope="module")
def plain(docs):
    return [(r.doc_id, r.text or "") for r in docs.select("doc_id", "text").collect()]


@pytest.fixture(scope="module")
def empty(spark):
    return spark.createDataFrame([], SCHEMA)


def by(rows, key="doc_id"):
    out = {}
    for r in rows:
        out.setdefault(r[key], []).append(r)
    return out


def test_word_hashes_depend_on_words_alone():
    texts = [b"one two  three", b"", b" two\tone ", b"three"]
    h, at = word_hashes(texts)
    words = [w for t in texts for w in t.split()]
    assert at.tolist() == [0, 3, 3, 5, 6]
    assert len({(w, int(x)) for w, x in zip(words, h)}) == len(set(words)) == len(set(h.tolist()))


def test_exact_dedup(docs, plain):
    got = exact_dedup.exact_dedup(docs).collect()
    norm = {}
    for i, t in plain:
        norm.setdefault(re.sub(r"[\x20\x09-\x0D]+", " ", t), []).append(i)
    assert len(got) == len(plain)
    sha = {hashlib.sha256(k.encode()).hexdigest(): v for k, v in norm.items()}
    for r in got:
        ids = sha[r.text_sha256]
        known = [i for i in ids if i is not None]
        assert r.keep_id == (min(known) if known else None) and r.group_size == len(ids)
    kept = Counter(r.text_sha256 for r in got if r.kept)
    assert kept == Counter(dict.fromkeys(sha, 1))


def test_exact_dedup_index_persists(spark, tmp_path):
    index = exact_dedup.DigestIndex(spark, f"file://{tmp_path}/index", 4)
    one = spark.createDataFrame(rows_of(["a b", "a  b", "c"]), SCHEMA)
    two = spark.createDataFrame([(10, "c", *[None] * 9), (11, "d", *[None] * 9)], SCHEMA)
    assert sorted((r.doc_id, r.kept) for r in exact_dedup.exact_dedup(one, index).collect()) == [(0, True), (1, False), (2, True)]
    again = exact_dedup.DigestIndex(spark, f"file://{tmp_path}/index", 4)
    assert sorted((r.doc_id, r.keep_id, r.kept) for r in exact_dedup.exact_dedup(two, again).collect()) == [(10, 2, False), (11, 11, True)]
    assert again.table().count() == 3
    plan = two.select("doc_id", exact_dedup.digest(F.col("text")).alias("digest")).join(again.table().hint("merge"), "digest", "left_anti")
    assert "Bucketed: true" in plan._jdf.queryExecution().explainString(plan._sc._jvm.org.apache.spark.sql.execution.ExplainMode.fromString("formatted"))


def test_keep_unique_keeps_columns(docs, plain):
    out = exact_dedup.keep_unique(docs)
    assert out.columns == docs.columns
    norm = {re.sub(r"[\x20\x09-\x0D]+", " ", t) for _, t in plain}
    assert out.count() == len(norm)


def jaccard(a, b):
    def bag(t):
        w = t.split()
        return Counter(tuple(w[i : i + 5]) for i in range(max(1, len(w) - 4))) if w else Counter()

    x, y = bag(a), bag(b)
    return sum((x & y).values()) / max(1, sum((x | y).values()))


def test_near_dedup_against_all_pairs(spark):
    rng = random.Random(9)
    base = [random_text(rng, 150) for _ in range(8)]
    texts = []
    for b in base:
        for _ in range(10):
            w = b.split()
            for _ in range(rng.randint(0, 5)):
                w[rng.randrange(len(w))] = rng.choice(["zig", "zag"])
            texts.append(" ".join(w))
    texts += [random_text(rng, 40) for _ in range(20)] + ["", None, "a b", "a b", "a b " * 50, "a b " * 49]
    df = spark.createDataFrame(rows_of(texts), SCHEMA).repartition(3)
    label = list(range(len(texts)))
    links = Counter()

    def find(x):
        while label[x] != x:
            x = label[x]
        return x

    ws = [(t or "").split() for t in texts]
    for i in range(len(texts)):
        for j in range(i):
            if ws[i] == ws[j] or (ws[i] and ws[j] and jaccard(texts[i], texts[j]) >= 0.8):
                if ws[i] != ws[j]:
                    links[i, tuple(ws[j])] = links[j, tuple(ws[i])] = 1
                a, b = sorted((find(i), find(j)))
                label[b] = a
    rows = near_dedup.near_dedup(df).collect()
    got = {r.doc_id: r.class_id for r in rows}
    assert got == {i: find(i) for i in range(len(texts))}
    # verified links to other texts: no more than there are, and one at least where there is any
    most = Counter(i for i, _ in links)
    assert links and all(r.n_links <= most[r.doc_id] and (r.n_links > 0) == (most[r.doc_id] > 0) for r in rows)
    out = near_dedup.keep_representatives(df)
    assert out.columns == df.columns and {r.doc_id for r in out.collect()} == set(got.values())


def test_near_dedup_tells_rows_of_one_id_apart_by_their_texts(spark):
    rng = random.Random(12)
    a, b, c = (random_text(rng, 80) for _ in range(3))
    near = lambda t: " ".join(t.split()[:-1] + ["zig"])
    rows = [(None, ""), (None, a), (None, near(a)), (None, b), (7, ""), (7, c), (7, near(b)), (8, near(c)), (9, " ")]
    df = spark.createDataFrame([(i, t, *[None] * 9) for i, t in rows], SCHEMA).repartition(3)
    got = near_dedup.near_dedup(df).collect()
    want = [(None, None, 0), (None, None, 1), (None, None, 1), (None, None, 1), (7, None, 0), (7, 7, 1), (7, None, 1), (8, 7, 1), (9, None, 0)]
    assert Counter((r.doc_id, r.class_id, r.n_links) for r in got) == Counter(want)
    # one row of each of the four classes
    assert Counter(r.doc_id for r in got if r.kept) == Counter({None: 3, 7: 1})
    kept = [(r.doc_id, r.text) for r in near_dedup.keep_representatives(df).collect()]
    assert len(kept) == 4 and {(None, ""), (None, b), (7, c)} <= set(kept) and len(set(kept) & {(None, a), (None, near(a))}) == 1


def test_bag_signatures_estimate_weighted_jaccard():
    rng = np.random.default_rng(1)
    items = rng.integers(0, 2**63, 300).astype(np.uint64)
    a, b = rng.integers(1, 40, 300), rng.integers(1, 40, 300)
    size = 4096
    sig = near_dedup.bag_signatures(np.repeat([0, 1], 300), np.concatenate([items, items]), np.concatenate([a, b]), 2, size)
    true = np.minimum(a, b).sum() / np.maximum(a, b).sum()
    assert abs((sig[0] == sig[1]).mean() - true) < 4 * math.sqrt(true * (1 - true) / size)


def test_components_of_paths_and_rings(spark):
    edges = [(i, i + 1) for i in range(40)] + [(100, 101), (101, 102), (102, 100), (7, 7)]
    got = {r.id: r.label for r in near_dedup.components(spark.createDataFrame(edges, "a long, b long")).collect()}
    assert got == {i: 0 for i in range(41)} | {100: 100, 101: 100, 102: 100}


def test_mixing_meets_targets(docs, spark):
    got = mixing.mix_by_source(docs)
    rows = got.collect()
    assert sorted(map(tuple, rows), key=str) == sorted(map(tuple, mixing.mix_by_source(docs.repartition(7)).collect()), key=str)
    size, taken, target, top = Counter(), Counter(), {}, Counter()
    src = {r.doc_id: r.source for r in docs.collect()}
    for r in rows:
        s = src[r.doc_id]
        size[s] += r.size
        taken[s] += r.taken
        target[s] = r.target
        top[s] = max(top[s], r.size)
        assert 0 <= r.taken <= 2 * r.size
    for s in size:
        assert target[s] <= 2 * size[s] + 1e-9 and abs(taken[s] - target[s]) <= top[s]
    assert abs(sum(target.values()) - 1.5 * sum(size.values())) < 1e-6


def targets(sizes: list, weights: list, share: float, most: float) -> list:
    """Water filling: ``share`` times all sizes by weight, no target above ``most`` times its size.

    What a stopped source leaves is shared again by weight until none is above. Sources of size 0 get 0.
    """
    left, weight = share * sum(sizes), float(sum(weights))
    out = [0.0] * len(sizes)
    most = float(most)
    order = sorted(range(len(sizes)), key=lambda i: (most * sizes[i] / weights[i], i))
    for k, i in enumerate(order):
        cap = most * sizes[i]
        if cap / weights[i] >= left / weight:
            for j in order[k:]:
                out[j] = min(most * sizes[j], left / weight * weights[j])
            break
        out[i] = cap
        left, weight = left - cap, weight - weights[i]
    return out


def test_water_filling(spark):
    assert targets([100, 100, 1], [1, 1, 1], 1.5, 2) == [149.75, 149.75, 2.0]
    rng = random.Random(8)
    for n in (1, 4, 60):
        sizes = [rng.choice([0, 1, 7, 500, 20_000]) + rng.randint(0, 3) for _ in range(n)]
        names = sorted({f"{rng.randint(0, 999)}é"[: rng.randint(1, 4)] + str(i) for i in range(n)}, key=str.encode)
        names[-1] = None
        df = spark.createDataFrame(rng.sample(list(zip(names, sizes)), n), "source string, source_size long")
        got = {r.source: r.target for r in mixing.source_targets(df, (5, 2, 1), 1.5, 2).collect()}
        want = dict(zip(names, targets(sizes, [(5, 2, 1)[i % 3] for i in range(n)], 1.5, 2)))
        assert got == pytest.approx(want)
    assert mixing.source_targets(df.where("false"), (5, 2, 1), 1.5, 2).count() == 0


def test_more_sources_than_patterns_may_be_gathered(spark, monkeypatch):
    monkeypatch.setattr(mixing, "MAX_PATTERNS", 5)
    df = spark.range(3_000).select(F.col("id").alias("doc_id"), F.concat(F.lit("s"), (F.col("id") % 700).cast("string")).alias("source"), F.repeat(F.lit("w "), (F.col("id") % 9).cast("int")).alias("text"))
    few = mixing.mix_by_source(df)
    monkeypatch.setattr(mixing, "MAX_PATTERNS", 200_000)
    assert sorted(few.collect()) == sorted(mixing.mix_by_source(df).collect())
    monkeypatch.setattr(mixing, "MAX_PATTERNS", 5)
    both = df.withColumn("sources", F.when(F.col("doc_id") % 700 < 4, F.array(F.lit("a"), F.lit("b"))).when(F.col("doc_id") % 700 < 6, F.array(F.lit("b"))).otherwise(F.array("source")))
    chosen, per = mixing.mix(both, F.col("sources"))
    got = {r.source: r for r in per.collect()}
    assert len(got) == 696 and got["b"].flow <= round(got["b"].target) and sum(r["rows"] for r in chosen.collect()) == 3_000
    with pytest.raises(ValueError, match="overlap"):
        mixing.mix(df.withColumn("sources", F.array("source", F.lit("all"))), F.col("sources"))


def test_water_filling_and_flow():
    # pattern {0, 1} serves both sources; repeats cost more than first copies
    flow = mixing.min_cost_flow([10, 10, 10], [[0], [0, 1], [1]], [12, 12], 2)
    assert [sum(f.get(s, 0) for f in flow) for s in (0, 1)] == [12, 12]
    assert sum(max(0, sum(f.values()) - 10) for f in flow) == 0
    flow = mixing.min_cost_flow([5], [[0]], [20], 2)
    assert flow == [{0: 10}]


def test_overlapping_sources(spark):
    rows = [(i, "w " * 10, ["a"] if i % 3 == 0 else ["a", "b"] if i % 3 == 1 else [None, "b"]) for i in range(90)]
    df = spark.createDataFrame(rows, "doc_id long, text string, sources array<string>")
    chosen, per = mixing.mix(df, F.col("sources"))
    per = {r.source: r for r in per.collect()}
    assert set(per) == {"a", "b", None}
    chosen = chosen.collect()
    assert sum(r.rows for r in chosen) == 90 and all(r.base * r.rows + r.extra <= 2 * r.rows and r.extra <= r.rows for r in chosen)
    # what is taken of each pattern is what its flow says, and sources are met
    assert sum((r.base * r.rows + r.extra) * r.size for r in chosen) == pytest.approx(sum(r.flow for r in per.values()), abs=30)
    assert all(r.flow <= round(r.target) for r in per.values())


def test_sentencepiece_is_the_library(docs, plain):
    path = tokenizers_path("piece_bpe_32k.model")
    sp = sentencepiece_codec.codec(path).library
    rng = random.Random(2)
    signs = [" ", "  ", "\n", "a", "The", "é", "日", "\0", "▁", "\t", "</s>", "<0x0A>", ".", "　", "😀", " \n", "\n "]
    texts = ["".join(rng.choice(signs) for _ in range(rng.randint(0, 12))) for _ in range(3000)]
    for t, (ids, back) in zip(texts, sentencepiece_codec.Codec(path).encode(texts)):
        want = sp.encode(t)
        assert ids == ",".join(map(str, want)) and back == sp.decode(want), repr(t)
    want = Counter((i, len(x := sp.encode(t)), hashlib.sha256(",".join(map(str, x)).encode()).hexdigest(), hashlib.sha256(sp.decode(x).encode()).hexdigest()) for i, t in plain)
    assert Counter(map(tuple, sentencepiece_codec.digests(docs, path).collect())) == want
    full = sentencepiece_codec.encode_decode(docs, path).collect()
    assert Counter((r.doc_id, tuple(r.ids), r.decoded) for r in full) == Counter((i, tuple(x := sp.encode(t)), sp.decode(x)) for i, t in plain)


def test_byte_bpe_is_the_library(spark):
    from tokenizers import Tokenizer

    path = tokenizers_path("byte_bpe_50k.json")
    lib, enc = Tokenizer.from_file(path), byte_bpe.Encoder(path)
    assert np.frombuffer(enc.encode(["<|endoftext|> hi"])[0], enc.kind).tolist() == [50256, 23105]
    real = [r.text for r in spark.read.parquet("/root/testdata/sf0.001/documents.parquet").collect()]
    long = ["ab" * 40, "x" * 500 + " y", "aaaaaaaaaaaaaaaaaaaaaaaaaaaaaaaa", "don't we'll 1a!!b", "é×÷ÿ"]
    for t, ids in zip(real + long, enc.encode(real + long)):
        assert np.frombuffer(ids, enc.kind).tolist() == lib.encode(t, add_special_tokens=False).ids, t[:50]
    enc.words.most = 2000  # a table that forgets all the time
    for a in range(0, 60, 10):
        for t, ids in zip(real[a : a + 10], enc.encode(real[a : a + 10])):
            assert np.frombuffer(ids, enc.kind).tolist() == lib.encode(t, add_special_tokens=False).ids
    rng = random.Random(3)
    signs = [" ", "  ", "\n", "\n\n", "a", "The", "é", "日", "\0", "\x1c", "\x85", "\xa0", "\t", "'s", "'", "<|endoftext|>", "12", ".", "x.", "y,", "###", "　", "😀", " \n", "\n "]
    texts = ["".join(rng.choice(signs) for _ in range(rng.randint(0, 12))) for _ in range(3000)]
    for t, ids in zip(texts, enc.encode(texts)):
        assert np.frombuffer(ids, enc.kind).tolist() == lib.encode(t, add_special_tokens=False).ids, repr(t)


def test_token_shards_round_trip(spark, docs, plain, tmp_path):
    path = tokenizers_path("byte_bpe_50k.json")
    lib = byte_bpe.encoder(path).library
    folder = f"file://{tmp_path}/shards"
    index = token_shards.write_shards(docs, path, folder, length=64)
    got = sorted(token_shards.read_back(spark, index, folder).collect(), key=lambda r: r.start)
    want, at = [], 0
    for i, t in sorted(plain, key=lambda x: (x[0] is not None, x[0] or 0, x[1])):
        ids = lib.encode(t, add_special_tokens=False).ids + [2]
        want.append((i, at, len(ids), zlib.crc32(np.array(ids, "<u4").tobytes())))
        at += len(ids)
    assert [(r.doc_id, r.start, r.n_tokens, r.ids_crc32) for r in got] == want
    with token_shards.ShardReader(folder, got[0].shard) as reader:
        ids, mask = reader.sequence(0)
        assert len(ids) == len(mask) == 64 and mask.dtype == bool and not ids.flags.owndata and not mask.flags.owndata
        last = sum(reader.batch(i).num_rows for i in range(reader.file.num_record_batches)) - 1
        ids, mask = reader.sequence(last)
        total = sum(r.n_tokens for r in got if r.shard == got[0].shard)
        assert mask.sum() == (total - 1) % 64 + 1 and not ids[~mask].any()


def test_shards_in_other_stores():
    uri = token_shards.arrow_uri
    assert [uri(x) for x in ("s3a://b/k", "file:/a/b", "file:///a", "/a", "gs://b/k", "abfss://c@a/x")] == ["s3://b/k", "file:///a/b", "file:///a", "file:///a", "gs://b/k", "abfss://c@a/x"]


def test_lm_scores_against_counting(docs, plain, spark, tmp_path):
    docs.write.parquet(f"{tmp_path}/d")
    files = spark.read.parquet(f"{tmp_path}/d")
    shuffled = lm_scoring.lm_scores(docs).collect()
    got = by(lm_scoring.lm_scores(files).collect())
    assert sorted(map(str, shuffled)) == sorted(str(r) for rows in got.values() for r in rows)
    # many ranges, few per level: the same sums
    deep = lm_scoring.lm_scores(files, range_bytes=2000, fan=3).collect()
    assert sorted(map(str, shuffled)) == sorted(map(str, deep))
    lower = str.maketrans("ABCDEFGHIJKLMNOPQRSTUVWXYZ", "abcdefghijklmnopqrstuvwxyz")
    toks = [(i, re.findall(r"[^\x20\x09-\x0D]+", t.translate(lower)) + [None]) for i, t in plain]
    held = lambda i: zlib.crc32(("" if i is None else str(i)).encode()) % 7 == 2
    uni, bi, tri = Counter(), Counter(), Counter()
    for i, w in toks:
        if not held(i):
            uni.update(w)
            bi.update(zip(w, w[1:]))
            tri.update(zip(w, w[1:], w[2:]))
    n, v = sum(uni.values()), len(uni)
    for i, w in toks:
        p = [(uni[x] + 1) / (n + v + 1) for x in w]
        m = lm_scoring.MU
        two = [p[0]] + [(bi[a, b] + m * pb) / (uni[a] + m) for a, b, pb in zip(w, w[1:], p[1:])]
        q = two[:2] + [(tri[a, b, c] + m * pc) / (bi[a, b] + m) for a, b, c, pc in zip(w, w[1:], w[2:], two[2:])]
        r = min(got[i], key=lambda r: abs(r.score - sum(map(math.log10, q))))
        assert r.held_out == held(i) and r.n_tokens == len(w) and r.n_known == sum(uni[x] > 0 for x in w) and r.train_tokens == n
        assert r.base_score == pytest.approx(sum(map(math.log10, p)), rel=1e-11) and r.score == pytest.approx(sum(map(math.log10, q)), rel=1e-11)


def test_lm_order_three_is_normalised_and_carries_state():
    texts = [b"a b c a b d", b"a b c", b"c c c"]
    block = lm_scoring.Block(texts, 3)
    totals = block.counts(np.ones(3, bool)).astype(float)
    auto = lm_scoring.Automaton(block, totals, int(block.n_tokens.sum()), 5, 2.0)
    assert block.n_tokens.tolist() == [7, 4, 4]
    words = [t.decode().split() + [None] for t in texts]
    grams = [Counter(tuple(w[i : i + k]) for w in words for i in range(len(w) - k + 1)) for k in (1, 2, 3)]
    n, v = sum(grams[0].values()), len(grams[0])

    def p(ctx, w):
        if not ctx:
            return (grams[0][(w,)] + 1) / (n + v + 1)
        c = grams[len(ctx) - 1][ctx]
        return (grams[len(ctx)][ctx + (w,)] + 2.0 * p(ctx[1:], w)) / (c + 2.0) if c else p(ctx[1:], w)

    want = [sum(math.log10(p(tuple(w[max(0, i - 2) : i]), w[i])) for i in range(len(w))) for w in words]
    assert np.allclose(auto.traverse(block), want, rtol=1e-12)
    kinds = [x for (x,) in grams[0]]
    assert sum(p(("a", "b"), x) for x in kinds) + p(("a", "b"), "unseen") == pytest.approx(1)


def brute_scan(text):
    low = "".join(chr(ord(c) + 32) if "A" <= c <= "Z" else c for c in text)
    words = re.findall(r"[^\x00-\x2F\x3A-\x60\x7B-\x7F]+", low)
    places = [(i, label) for p, label in licenses.PHRASES.items() for i in range(len(words)) if words[i : i + len(p.split())] == p.split()]
    return words, sorted(places)


def test_license_places_against_brute_force(spark):
    rng = random.Random(4)
    bits = ["CC", "by", "BY-NC", "4.0", "General", "Public", "License", "all", "rights", "reserved.", "licensed", "under", "the", "GNU", "x", "É"]
    texts = [" ".join(rng.choice(bits) for _ in range(rng.randint(0, 30))) for _ in range(300)] + [None, "", "cc by cc by", "This work is licensed under the GNU General Public License, version 3."]
    got = by(licenses.scan(spark.createDataFrame(rows_of(texts), SCHEMA)).collect())
    for i, t in enumerate(texts):
        words, places = brute_scan(t or "")
        (r,) = got[i]
        assert r.n_words == len(words) and sorted((p.start, p.label) for p in r.places) == places
    assert [(s.start, s.end, s.label) for s in got[len(texts) - 1][0].spans] == [(0, 12, "gpl-notice")]


def test_template_markup():
    t = '<<beginOptional>>please <<beginOptional>>do <<endOptional>><<endOptional>>keep <<var;name="what";original="this";match="(this|that one)">> notice'
    for text, fine in {"keep this notice": True, "Please, do keep THAT one notice!": True, "please keep this notice": True, "do keep this notice": False, "keep other notice": False, "keep this": False, "keep this notice now": False}.items():
        assert licenses.matches_template(text, t) is fine, text
    with pytest.raises(ValueError):
        licenses.compile_template("<<beginOptional>>a")


def naive_ends(tree, words, at):
    """Every place where a list of parts can end: words, optional lists, regions as predicates over joined words."""
    ends = {at}
    for part in tree:
        if isinstance(part, str):
            ends = {e + 1 for e in ends if e < len(words) and words[e] == part}
        elif isinstance(part, list):
            ends |= {x for e in ends for x in naive_ends(part, words, e)}
        else:
            ends = {x for e in ends for x in range(e, len(words) + 1) if part(" ".join(words[e:x]))}
    return ends


def test_templates_against_a_naive_matcher():
    rng = random.Random(11)
    regions = {".+": lambda t: len(t) > 0, ".{0,7}": lambda t: len(t) <= 7, "(A|B C)": lambda t: t in ("a", "b c"), "[a-c]( [a-c])*": lambda t: re.fullmatch("[a-c]( [a-c])*", t) is not None, ".*": lambda t: True, "a-b": lambda t: t in ("ab", "a b")}

    def make(depth):
        text, tree = [], []
        for _ in range(rng.randint(1, 3)):
            kind = rng.random()
            if kind < 0.5 or depth > 1:
                w = rng.choice("abcd")
                text.append(w)
                tree.append(w)
            elif kind < 0.75:
                inner, sub = make(depth + 1)
                text.append(f'<<beginOptional;name="x">>{inner}<<endOptional>>')
                tree.append(sub)
            else:
                r = rng.choice(list(regions))
                text.append(f'<<var;name="r";original="a";match="{r}">>')
                tree.append(regions[r])
        return " ".join(text), tree

    seen = Counter()
    for _ in range(1500):
        template, tree = make(0)
        words = [rng.choice("abcd") for _ in range(rng.randint(0, 6))]
        want = len(words) in naive_ends(tree, words, 0)
        assert licenses.matches_template(" ".join(words), template) is want, (template, words)
        seen[want] += 1
        spans, at = [], 0
        while at < len(words):
            end = max(naive_ends(tree, words, at), default=at)
            spans += [(at, end, "x")] if end > at else []
            at = max(end, at + 1)
        assert licenses.Scanner({}, {"x": template}).scan(" ".join(words))["spans"] == spans, (template, words)
    assert min(seen.values()) > 100


def test_templates_that_once_failed():
    optional = "<<beginOptional>>licensed under<<endOptional>>"
    assert licenses.Scanner({}, {"o": optional}).scan("licensed material, licensed under")["spans"] == [(2, 4, "o")]
    holder = 'copyright <<var;name="h";original="x";match=".+">> reserved'
    assert licenses.matches_template("copyright " + "word " * 40 + "reserved", holder) and not licenses.matches_template("copyright reserved", holder)
    signs = 'under <<var;name="v";original="x";match="Apache-2\\.0">> terms'
    assert licenses.matches_template("Under Apache-2.0 terms", signs)
    with pytest.raises(ValueError):
        licenses.compile_template("  ")
    whole = licenses._MARKUP.sub(" somebody ", licenses.TEMPLATES["isc"].replace("<<beginOptional>>/or<<endOptional>>", "/or")).replace("ISC License somebody", "").replace("somebody  somebody", "")
    assert any(x == "isc" for _, _, x in licenses.Scanner().scan("It says: " + re.sub(r"^.*?Permission", "Permission", whole, flags=re.S))["spans"])


def test_index_reopened_under_other_settings(spark, tmp_path):
    path = f"file://{tmp_path}/index"
    rows = spark.range(200).select(F.col("id").alias("doc_id"), F.sha2(F.col("id").cast("string"), 256).alias("digest"))
    exact_dedup.DigestIndex(spark, path, 7).add(rows)
    again = exact_dedup.DigestIndex(spark, path)
    assert again.buckets == 7 and again.add(rows.withColumn("doc_id", F.col("doc_id") + 1000)).where("keep_id < 1000").count() == 200
    assert again.table().count() == 200
    with pytest.raises(ValueError):
        exact_dedup.DigestIndex(spark, path, 4)
    small = again.compact(f"file://{tmp_path}/compact", 3)
    assert small.table().count() == 200 and small.add(rows).where("keep_id <> 0").count() == 199


def test_mixed_documents_with_repeated_rows(spark):
    rows = [(1, "w " * 10, "a")] * 2 + [(1, "v " * 10, "b")] + [(None, "x y", "a")] * 3 + [(i, "z " * (i % 7), "abc"[i % 3]) for i in range(2, 60)]
    df = spark.createDataFrame(rows, "doc_id long, text string, source string").withColumn("size", F.lit(1)).repartition(4)
    out = mixing.mixed_documents(df)
    assert out.columns == df.columns
    got, most = Counter(map(tuple, out.select("doc_id", "text", "source").collect())), Counter(rows)
    assert all(got[r] <= 2 * most[r] for r in got)
    taken, want = Counter(), Counter()
    for (i, t, s), n in got.items():
        taken[s] += n * len(t.split())
    for r in mixing.mix_by_source(df).collect():
        want[r.source_size, r.target] += r.taken
    assert sorted(taken.values()) == sorted(want.values())
    assert got == Counter(map(tuple, mixing.mixed_documents(df.repartition(3)).select("doc_id", "text", "source").collect()))


def test_flow_by_parts_is_that_of_the_whole():
    rng = random.Random(9)
    for _ in range(60):
        n_p, n_s = rng.randint(0, 12), rng.randint(1, 9)
        cap, quota = [rng.randint(0, 9) for _ in range(n_p)], [rng.randint(0, 25) for _ in range(n_s)]
        member = [sorted(rng.sample(range(n_s), rng.randint(0, min(2, n_s)))) for _ in range(n_p)]
        of = [[sum(f.values()) for f in way(cap, member, quota, 2)] for way in (mixing.route, mixing.min_cost_flow)]
        assert sum(of[0]) == sum(of[1])
        assert sum(max(0, t - c) for t, c in zip(of[0], cap)) == sum(max(0, t - c) for t, c in zip(of[1], cap))
        flow = mixing.route(cap, member, quota, 2)
        assert all(set(f) <= set(own) for f, own in zip(flow, member)) and all(sum(f.get(s, 0) for f in flow) <= q for s, q in enumerate(quota))
    many = 50_000
    assert mixing.route([3] * many, [[s] for s in range(many)], [4] * many, 2) == [{s: 4} for s in range(many)]


def test_flow_over_overlapping_sources_is_optimal():
    rng = random.Random(3)
    for _ in range(40):
        n_p, n_s = rng.randint(1, 4), rng.randint(1, 3)
        cap = [rng.randint(0, 3) for _ in range(n_p)]
        member = [sorted(rng.sample(range(n_s), rng.randint(1, n_s))) for _ in range(n_p)]
        quota = [rng.randint(0, 5) for _ in range(n_s)]
        flow = mixing.min_cost_flow(cap, member, quota, 2)
        used = [sum(f.values()) for f in flow]
        assert all(u <= 2 * c for u, c in zip(used, cap)) and all(sum(f.get(s, 0) for f in flow) <= q for s, q in enumerate(quota))
        # brute force over all flows, token by token: most tokens first, then fewest repetitions
        states = {(tuple(quota), tuple([0] * n_p))}
        todo = list(states)
        while todo:
            q, u = todo.pop()
            for p in range(n_p):
                for s in member[p]:
                    if q[s] and u[p] < 2 * cap[p]:
                        new = (tuple(x - (i == s) for i, x in enumerate(q)), tuple(x + (i == p) for i, x in enumerate(u)))
                        if new not in states:
                            states.add(new)
                            todo.append(new)
        rank = lambda u: (-sum(u), sum(max(0, x - c) for x, c in zip(u, cap)))
        assert rank(used) == min(rank(u) for _, u in states)


def test_recall_where_rows_outnumber_the_sample(spark):
    rng = np.random.default_rng(0)
    middle = rng.normal(size=(40, 24))
    x = (middle[rng.integers(0, 40, 12000)] + rng.normal(size=(12000, 5)) @ rng.normal(size=(5, 24)) * 0.3).astype(np.float32)
    df = spark.createDataFrame([(i, v.tolist()) for i, v in enumerate(x)], "vec_id long, embedding array<float>")
    assert recall(x, np.arange(len(x)), ann_forest.nearest(df, df.where("vec_id % 300 = 0"), sample=2000)) >= 0.9


def recall(x, ids, found):
    got, x = by(found.collect(), "query_id"), x.astype(float)
    hits = 0
    for q, rows in got.items():
        d = ((x - x[ids == q][0]) ** 2).sum(1)
        d[ids == q] = np.inf
        hits += len(set(ids[np.lexsort((ids, d))[:10]].tolist()) & {r.vec_id for r in rows})
    return hits / (10 * len(got))


def test_recall_of_the_query(spark):
    d = "/root/testdata/sf0.1"
    e = spark.read.parquet(f"{d}/embeddings.parquet").toArrow()
    assert recall(np.array(e.column("embedding").to_pylist()), e.column("vec_id").to_numpy(), queries.op5_nearest(spark, d)) >= 0.9


def test_stretches_of_long_texts_hash_alike(monkeypatch):
    from wardline.llm import common

    texts = [b" one two  three four " * 50, b"", b"x" * 300, b"\n a bb ccc\n", b"one"]
    want = word_hashes(texts)
    monkeypatch.setattr(common, "_STRETCH", 16)
    got = word_hashes(texts)
    assert got[0].tolist() == want[0].tolist() and got[1].tolist() == want[1].tolist()


def test_toxicity_score_by_hand():
    rng = random.Random(1)
    from wardline.llm.subwords import Subwords, _mix32, words_only

    table = np.random.default_rng(2).normal(size=1 << 10)
    texts = [random_text(rng, rng.randint(0, 40)) for _ in range(30)] + ["", "a", "É über x", "same same same"]
    s = Subwords([words_only(t) for t in texts], len(table))
    got = s.text_means(table)

    def bucket(gram):
        h = gram[0] + 1
        for c in gram[1:]:
            h = (h * 0x01000193 + c + 1) & 0xFFFFFFFF
        return int(_mix32(np.array([h], np.uint32))[0]) % len(table)

    for t, g in zip(texts, got):
        low = bytes(c + 32 if 65 <= c <= 90 else c if c >= 128 or 97 <= c <= 122 or 48 <= c <= 57 else 32 for c in t.encode())
        words = list(dict.fromkeys(low.split()))
        mean = 0.0
        for w in words:
            w = b" " + w + b" "
            grams = [w[i : i + n] for n in range(s.low, s.high + 1) for i in range(len(w) - n + 1)]
            mean += np.mean([table[bucket(x)] for x in grams])
        assert g == pytest.approx(mean / (len(words) + 200), abs=1e-12)


def test_votes_and_em_by_hand():
    assert quality.votes("") == [-1] * 7 + [0]
    good = "the tree of the north is in a green light. and the river was not long by the stone house. " * 4
    assert quality.votes(good)[2:] == [1 if len(set(good.split())) / len(good.split()) > 0.35 else 0 if len(set(good.split())) / len(good.split()) < 0.25 else -1, 1, 1, 1, 1, 1]
    # variety does not depend on length: a text and itself many times over with other words between
    words = [f"w{i}" for i in range(20_000)]
    assert quality.votes(" ".join(words))[2] == quality.votes(" ".join(words[:300]))[2] == 1
    assert quality.votes("spam " * 300)[2] == quality.votes("spam " * 30_000)[2] == 0
    patterns, counts = np.array([[1, 1, 0], [0, 0, -1], [1, -1, 1], [0, 1, 0]]), np.array([5.0, 3, 2, 1])
    model = quality.expectation_maximisation(patterns, counts, rounds=1)
    agree = [((p == 1).sum() + 0.5) / ((p >= 0).sum() + 1) for p in patterns]
    g = [0.9 if a > 0.7 else 0.1 if a < 0.5 else 0.5 for a in agree]
    for j in range(3):
        for c in (0, 1):
            seen = {v: (4 if v == c else 1) + sum(n * (x if c else 1 - x) for p, n, x in zip(patterns, counts, g) if p[j] == v) for v in (-1, 0, 1)}
            assert np.allclose(model.table[j, c], [seen[v] / sum(seen.values()) for v in (-1, 0, 1)])
    for p, post in zip(patterns, model.posterior(patterns)):
        like = [model.prior[c] * math.prod(model.table[j, c, p[j] + 1] for j in range(3)) for c in (0, 1)]
        assert post == pytest.approx(like[1] / sum(like))
    idx, val = quality.features("aab")
    raw = b"aab"
    for n, count in ((1, 2), (2, 2), (3, 1)):
        assert len({raw[i : i + n] for i in range(4 - n)}) == count
    assert len(idx) == 1 + 2 + 2 + 1 and val[0] == pytest.approx(3 / 400) and (val[1:3] ** 2).sum() == pytest.approx(1)


def test_hot_ids_leave_one_text_for_fitting(spark, monkeypatch):
    rows = [(1, f"text {i} of one id") for i in range(500)] + [(i, "the river and the stone") for i in range(2, 20)]
    df = spark.createDataFrame(rows, "doc_id long, text string")
    lab = spark.createDataFrame([(i, i % 2) for i in range(1, 20)], "doc_id long, toxic int")
    seen = []
    fit, scorer = toxicity.fit, quality.fit_scorer
    monkeypatch.setattr(toxicity, "fit", lambda texts, *a: seen.append(len(texts)) or fit(texts, *a))
    monkeypatch.setattr(quality, "fit_scorer", lambda texts, *a: seen.append(len(texts)) or scorer(texts, *a))
    assert toxicity.toxicity(df, lab).count() == quality.quality(df).count() == len(rows)
    assert max(seen) <= 19


def test_nearest_against_brute_force(spark):
    rng = np.random.default_rng(6)
    x = rng.normal(size=(3000, 16)).astype(np.float32)
    x[100:130] = x[5]
    rows = [(i, [float(v) for v in r]) for i, r in enumerate(x)]
    rows += [(5000, None), (5001, [0.0] * 16), (5002, [float("nan")] * 16), (5003, [1.0, None] * 8), (5004, [1.0]), (None, [1.0] * 16), (5100, [float("inf")] * 16)]
    df = spark.createDataFrame(rows, "vec_id long, embedding array<float>")
    got = by(ann_forest.nearest(df, df.where("vec_id % 100 = 0")).collect(), "query_id")
    assert set(got) == set(range(0, 3000, 100))
    hits = 0
    for q, rs in got.items():
        d = np.sqrt(((x.astype(float) - x[q].astype(float)) ** 2).sum(1))
        order = [i for i in np.lexsort((np.arange(3000), d)) if i != q][:10]
        rs.sort(key=lambda r: r.rank)
        assert [r.rank for r in rs] == list(range(1, 11)) and all(r.score == pytest.approx(d[r.vec_id], rel=1e-12) for r in rs)
        hits += len({r.vec_id for r in rs} & set(order))
    assert hits / (10 * len(got)) >= 0.9
    few = df.where("vec_id < 5 or vec_id = 5001")
    assert sorted((r.rank, r.vec_id) for r in ann_forest.nearest(few, few.where("vec_id = 0")).collect())[0][0] == 1
    assert ann_forest.nearest(few, few.where("vec_id = 0")).count() == 4
    assert ann_forest.nearest(df.where("vec_id >= 5000"), df.where("vec_id = 5001")).count() in (0,)


def test_nearest_with_repeated_ids(spark):
    rng = np.random.default_rng(7)
    x = rng.normal(size=(200, 8)).astype(np.float32)
    rows = [(i, v) for i, v in enumerate(x)] * 2  # each row twice
    rows += [(1, x[0] + np.float32(0.001 * j)) for j in range(1, 40)] + [(2, x[3])] * 40  # hot ids: other vectors, the same vector
    df = spark.createDataFrame([(i, [float(c) for c in v]) for i, v in rows], "vec_id long, embedding array<float>")
    got = by(ann_forest.nearest(df, df.where("vec_id in (0, 3, 50)").distinct()).collect(), "query_id")
    for q in (0, 3, 50):
        d = {}
        for i, v in rows:
            if i != q:
                d[i] = min(d.get(i, np.inf), float(np.sqrt(((v.astype(float) - x[q].astype(float)) ** 2).sum())))
        want = sorted(d, key=lambda i: (d[i], i))[:10]
        assert [r.vec_id for r in sorted(got[q], key=lambda r: r.rank)] == want, q
        assert all(r.score == pytest.approx(d[r.vec_id], abs=1e-12) for r in got[q])


def test_toxicity_learns_and_ignores_held_out(spark):
    rng = random.Random(8)
    rows, labels = [], []
    for i in range(900):
        words = [rng.choice(WORDS) for _ in range(60)]
        bad = rng.random() < 0.3
        if bad:
            for _ in range(4):
                words[rng.randrange(60)] = rng.choice(["grubnoxious", "grubnoxity", "grubnoxen", "grubnoxal"])
        rows.append((i, " ".join(words), *[None] * 9))
        labels.append((i, 1, int(bad)))
    rows += [(2000, "the tree grubnoxical of grubnoxly river and grubnoxless stone water", *[None] * 9), (2001, None, *[None] * 9), (2002, "", *[None] * 9)]
    df, lab = spark.createDataFrame(rows, SCHEMA), spark.createDataFrame(labels, "doc_id long, quality int, toxic int")
    got = {r.doc_id: r for r in toxicity.toxicity(df, lab).collect()}
    assert len(got) == len(rows)
    truth = {i: t for i, _, t in labels}
    held = [i for i in truth if zlib.crc32(str(i).encode()) % 4 == 2]
    assert all(got[i].held_out == (zlib.crc32(str(i).encode()) % 4 == 2) for i in truth)
    assert sum(got[i].predicted == truth[i] for i in held) / len(held) > 0.95
    assert got[2000].predicted == 1  # forms never seen share n-grams with those seen
    assert got[2001].score == got[2002].score and 0 <= got[2001].score <= 1
    flipped = spark.createDataFrame([(i, q, 1 - t if i in set(held) else t) for i, q, t in labels], "doc_id long, quality int, toxic int")
    assert {r.doc_id: r.score for r in toxicity.toxicity(df, flipped).collect()} == {i: r.score for i, r in got.items()}
    kept = toxicity.keep_clean(df, lab)
    assert kept.columns == df.columns and {r.doc_id for r in kept.collect()} == {i for i, r in got.items() if not r.predicted}


def test_quality_em_finds_good_labellers(docs):
    rng = np.random.default_rng(0)
    truth = rng.random(4000) < 0.7
    right = [0.95, 0.9, 0.8, 0.6]
    votes = np.stack([np.where(rng.random(4000) < 0.2, -1, np.where(rng.random(4000) < r, truth, ~truth)) for r in right], 1).astype(int)
    u, c = np.unique(votes, axis=0, return_counts=True)
    model = quality.expectation_maximisation(u, c.astype(float))
    assert np.abs(model.accuracy() - right).max() < 0.05
    assert ((model.posterior(votes) > 0.5) == truth).mean() > 0.93
    got = quality.quality(docs).collect()
    assert len(got) == docs.count() and all(0 <= r.score <= 1 and len(r.votes) == len(quality.LABELLERS) for r in got)


def test_quality_held_out_accuracy(spark):
    d = "/root/testdata/sf0.01"
    got = queries.op1_quality(spark, d).join(spark.read.parquet(f"{d}/labels.parquet"), "doc_id").collect()
    good, poor = [r.score for r in got if r.quality], [r.score for r in got if not r.quality]
    assert np.mean([g > p for g in good for p in poor]) > 0.85


@pytest.mark.parametrize("run", [
    lambda e: exact_dedup.exact_dedup(e), lambda e: exact_dedup.keep_unique(e), lambda e: near_dedup.near_dedup(e), lambda e: mixing.mix_by_source(e), lambda e: mixing.mixed_documents(e),
    lambda e: lm_scoring.lm_scores(e), lambda e: licenses.scan(e), lambda e: quality.quality(e), lambda e: sentencepiece_codec.digests(e, tokenizers_path("piece_bpe_32k.model")),
    lambda e: token_shards.tokenize(e, tokenizers_path("byte_bpe_50k.json")), lambda e: toxicity.toxicity(e, e.selectExpr("doc_id", "1 toxic")),
    lambda e: ann_forest.nearest(e.selectExpr("doc_id vec_id", "array(0f) embedding"), e.selectExpr("doc_id vec_id", "array(0f) embedding")),
    lambda e: ann_forest.nearest(e.sparkSession.range(5).selectExpr("id vec_id", "array(1f, float(id)) embedding"), e.selectExpr("doc_id vec_id", "array(0f, 1f) embedding")),
    lambda e: near_dedup.keep_representatives(e), lambda e: toxicity.keep_clean(e, e.selectExpr("doc_id", "1 toxic")), lambda e: sentencepiece_codec.encode_decode(e, tokenizers_path("piece_bpe_32k.model")),
])
def test_empty_tables(empty, run):
    assert run(empty).count() == 0


def test_no_labels_at_all(docs, empty):
    got = toxicity.toxicity(docs, empty.selectExpr("doc_id", "1 toxic")).collect()
    assert len(got) == docs.count() and len({r.score for r in got}) >= 1 and all(0 <= r.score <= 1 for r in got)


def test_license_query_columns(spark):
    r = queries.op7_licenses(spark, "/root/testdata/sf0.001").where("n_base > 0").first()
    assert r.first_word <= r.last_word and 0 < r.score <= 1 and set(r.base_labels.split(",")) <= set(r.labels.split(","))


def test_pipeline_against_a_plain_version(spark):
    import corpus_pipeline as cp

    tokenizers_path("piece_bpe_32k.model")
    d = "/root/testdata/sf0.001"
    docs = spark.read.parquet(f"{d}/documents.parquet")
    assert [n for n, _ in cp.STAGES] == ["toxicity", "exact_dedup", "near_dedup", "mixing", "sentencepiece"]
    stage = dict(cp.STAGES)
    held = lambda df: {r.doc_id: r.text or "" for r in df.collect()}
    text = held(docs)
    # toxicity: the rows that the model's scores reject go
    out = stage["toxicity"](spark, docs, d)
    model = toxicity.fit_on(docs, spark.read.parquet(f"{d}/labels.parquet"))
    table, off = model.table(), model.offset()
    from wardline.llm.subwords import Subwords, words_only

    score = {i: 1 / (1 + math.exp(-(float(Subwords([words_only(t)], len(table)).text_means(table)[0]) + off))) for i, t in text.items()}
    assert held(out) == {i: t for i, t in text.items() if score[i] < 0.3} and out.columns == docs.columns
    # exact: the smallest id of each normalised text
    one, first = stage["exact_dedup"](spark, out, d), {}
    for i in sorted(held(out)):
        first.setdefault(re.sub(r"[\x20\x09-\x0D]+", " ", text[i]), i)
    assert sorted(held(one)) == sorted(first.values()) and one.columns == docs.columns
    # near copies: the smallest id of each component of all pairs
    two, ids = stage["near_dedup"](spark, one, d), sorted(held(one))
    words = {i: re.findall(r"[^\x20\x09-\x0D]+", text[i]) for i in ids}
    bags = {i: Counter(tuple(w[k : k + 5]) for k in range(max(1, len(w) - 4))) if w else Counter() for i, w in words.items()}
    label = {i: i for i in ids}

    def find(x):
        while label[x] != x:
            x = label[x]
        return x

    for n, i in enumerate(ids):
        for j in ids[:n]:
            both = sum((bags[i] & bags[j]).values())
            if words[i] == words[j] or both and both / (sum(bags[i].values()) + sum(bags[j].values()) - both) >= 0.8:
                a, b = sorted((find(i), find(j)))
                label[b] = a
    assert sorted(held(two)) == sorted({find(i) for i in ids}) and two.columns == docs.columns
    # mixing: as many copies as the mix takes words
    mixed = stage["mixing"](spark, two, d)
    copies = Counter(r.doc_id for r in mixed.select("doc_id").collect())
    assert all(copies[r.doc_id] * r.size == r.taken for r in mixing.mix_by_source(two).collect() if r.size) and mixed.columns == docs.columns
    # encoding: the library's ids and what they decode to
    sp = sentencepiece_codec.codec(queries.piece_model()).library
    sha = lambda x: hashlib.sha256(x.encode()).hexdigest()
    want = Counter()
    for i, n in copies.items():
        enc = sp.encode(text[i])
        want[i, len(enc), sha(",".join(map(str, enc))), sha(sp.decode(enc))] = n
    assert Counter(map(tuple, cp.run(spark, d).collect())) == want


def test_pipeline_of_nothing(spark, empty, tmp_path):
    import corpus_pipeline as cp

    tokenizers_path("piece_bpe_32k.model")
    empty.write.parquet(f"{tmp_path}/documents.parquet")
    spark.createDataFrame([], "doc_id long, quality int, toxic int").write.parquet(f"{tmp_path}/labels.parquet")
    assert cp.run(spark, str(tmp_path)).count() == 0
