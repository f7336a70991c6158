"""Resampling, conversation repair and trie BPE against SQL, brute force and the library."""

import hashlib
import itertools
import math
import random
import re
import zlib
from collections import Counter

import numpy as np
import pandas as pd
import pytest

from wardline.llm import bpe_trie, conversations, importance, quality, queries, toxicity

D = "/root/testdata/sf0.001"
WORDS = "the of and in a that house tree river stone light winter naïve 日本 x1 long short green idea water".split()


def text_of(rng, n):
    return " ".join(rng.choice(WORDS) + rng.choice(["", "", ".", ",", "'s"]) for _ in range(n))


def run_sql(name, **tables):
    duckdb = pytest.importorskip("duckdb")
    c = duckdb.connect()
    for t, df in tables.items():
        if isinstance(df, pd.DataFrame):
            c.register(t, df)
        else:
            c.execute(f"CREATE VIEW {t} AS SELECT * FROM read_parquet('{df}')")
    cursor = c.execute(queries.oracle_sql()[name])
    return [x[0] for x in cursor.description], cursor.fetchall()


def same(df, sql):
    columns, want = sql
    got = [tuple(r) for r in df.select(*columns).collect()]
    key = lambda r: tuple((v is None, str(v)) for v in r)
    assert sorted(got, key=key) == sorted(want, key=key)


# ---- resampling


def test_crcs_combine():
    rng = random.Random(1)
    for _ in range(200):
        a, b = (rng.randbytes(rng.choice([0, 1, 5, 63, 64, 65, 200, 5000])) for _ in range(2))
        got = importance.shifted(np.array([zlib.crc32(a)], np.uint32), np.array([len(b)])) ^ np.uint32(zlib.crc32(b))
        assert int(got[0]) == zlib.crc32(a + b)


def plain_features(text, n):
    low = "".join(c.lower() if c.isascii() else c for c in text or "")
    words = re.findall(r"[^\x00-\x2F\x3A-\x60\x7B-\x7F]+", low)
    return words, [" ".join(words[i : i + k]) for k in range(1, n + 1) for i in range(len(words) - k + 1)]


@pytest.mark.parametrize("stretch", [40, 1 << 20])
@pytest.mark.parametrize("n", [1, 2, 3])
def test_features_are_those_of_plain_strings(monkeypatch, stretch, n):
    monkeypatch.setattr(importance, "_STRETCH", stretch)
    rng = random.Random(2)
    texts = ["", "one", "  ", text_of(rng, 50), "w" * 300 + " " + "Ab-Cd", "é\0Ü..a b", text_of(rng, 7), "..."] * 2
    got = {i: Counter() for i in range(len(texts))}
    words = Counter()
    for text, crc, own in importance.features([t.encode() for t in texts], n):
        for i, c in zip(text.tolist(), crc.tolist()):
            got[i][c] += 1
        words.update(own.tolist())
    for i, t in enumerate(texts):
        w, f = plain_features(t, n)
        assert got[i] == Counter(zlib.crc32(x.encode()) for x in f) and words[i] == len(w)


def resampling_tables():
    rng = random.Random(3)
    rows = [(i, text_of(rng, rng.randint(0, 60))) for i in range(80)]
    rows += [(200, None), (201, ""), (None, rows[5][1]), (None, rows[5][1]), (None, text_of(rng, 30)), (7, rows[7][1]), (7, text_of(rng, 40))] + [(9, rows[9][1])] * 5
    return rows, [(i, text_of(rng, 12)) for i in range(5)] + [(9, None)]


def test_resample_is_its_sql(spark):
    rows, goal = resampling_tables()
    docs = spark.createDataFrame([(i, t, 1, "x", 0.5) for i, t in rows], "doc_id long, text string, copies int, score string, `odd name` double").repartition(3)
    bench = spark.createDataFrame(goal, "item_id long, text string")
    frame = lambda data, k: pd.DataFrame(data, columns=[k, "text"]).astype({k: "Int64", "text": object})
    same(importance.resample(docs, bench), run_sql("op11_importance", documents=frame(rows, "doc_id"), benchmark=frame(goal, "item_id")))


def test_resample_by_hand(spark):
    rows, goal = resampling_tables()
    own, aim = ([plain_features(t, 2)[1] for _, t in x] for x in (rows, goal))
    bucket = lambda f: zlib.crc32(f.encode()) % 10_000
    s, t = (Counter(bucket(f) for fs in x for f in fs) for x in (own, aim))
    total = lambda c: sum(c.values())
    gain = lambda b: math.floor(1000 * math.log((t[b] + 1) * (total(s) + 10_000) / ((s[b] + 1) * (total(t) + 10_000))))
    want = []
    for (i, text), fs in zip(rows, own):
        weight = sum(gain(bucket(f)) for f in fs) // len(fs) if fs else 0
        h = int(hashlib.sha256(f"7:{'' if i is None else i}".encode()).hexdigest()[:8], 16)
        want.append([i, len(fs), weight, weight + math.floor(-1000 * math.log(-math.log((h + 0.5) / 2**32))), len(plain_features(text, 1)[0]) >= 20])
    fit = sorted((w for w in want if w[4]), key=lambda w: (-w[3], w[0] is None, w[0] or 0, w[1], w[2]))
    place = {id(w): k + 1 for k, w in enumerate(fit) if k < len(fit) * 25 // 100}
    docs = spark.createDataFrame(rows, "doc_id long, text string")
    got = importance.resample(docs, spark.createDataFrame(goal, "item_id long, text string")).collect()
    assert Counter(tuple(r) for r in got) == Counter((*w[:4], place.get(id(w))) for w in want)
    kept = importance.drawn_documents(docs.withColumn("rank", docs.text), spark.createDataFrame(goal, "item_id long, text string"))
    assert kept.columns == ["doc_id", "text", "rank"]
    assert Counter(r.doc_id for r in kept.collect()) == Counter(w[0] for w in want if id(w) in place)


def test_resample_of_nothing(spark):
    none, bench = spark.createDataFrame([], "doc_id long, text string"), spark.createDataFrame([(1, "a b")], "item_id long, text string")
    assert importance.resample(none, bench).count() == 0 and importance.drawn_documents(none, bench).count() == 0
    rows = importance.resample(spark.createDataFrame([(1, "a " * 30)], "doc_id long, text string"), bench.limit(0), percent=100).collect()
    assert [r.rank for r in rows] == [1]


# ---- conversations


def cheapest(shape):
    """Every way to edit a few turns, by trying all."""
    gaps = [("", ()), *[("I", (x,)) for x in "ua"], *[("II", x) for x in itertools.product("ua", repeat=2)]]
    ways = []
    for initial, gone, short in shape:
        one = [("D", (), 3)]
        if not gone:
            one += [("K", (initial,), short), *[("R", (x,), 2 + short) for x in "ua"]]
        ways.append(one)
    best = None
    for turns in itertools.product(*ways):
        for filled in itertools.product(gaps, repeat=len(shape) + 1):
            roles, audit, cost = list(filled[0][1]), filled[0][0], 2 * len(filled[0][0])
            for (letter, role, price), (more, extra) in zip(turns, filled[1:]):
                roles += [*role, *extra]
                audit += letter + more
                cost += price + 2 * len(more)
            if re.fullmatch("(s?(ua)+)?", "".join(roles)) and (best is None or (cost, audit) < best):
                best = (cost, audit)
    return best


def signs(shape):
    return "".join(f"{i}{g}{s}" for i, g, s in shape)


def test_chart_against_all_edits():
    rng = random.Random(4)
    turn = lambda: (rng.choice("suatx"), int(rng.random() < 0.2), int(rng.random() < 0.2))
    shapes = [[]] + [[t] for t in itertools.product("suax", (0, 1), (0, 1))] + [[turn() for _ in range(2)] for _ in range(60)] + [[turn() for _ in range(3)] for _ in range(12)]
    for shape in shapes:
        assert conversations.parse(signs(shape)) == cheapest(shape), shape


def test_tidied_charts_decide_alike(monkeypatch):
    rng = random.Random(5)
    for k in range(300):
        letters = rng.choice(["suatx", "ua", "aau", "t", "sst"])
        shape = signs([(rng.choice(letters), int(rng.random() < rng.choice([0.1, 0.9])), int(rng.random() < 0.3)) for _ in range(rng.randint(1, 60))])
        found = []
        for tidy in (1, 3, 10_000):
            monkeypatch.setattr(conversations, "_TIDY", tidy)
            found.append(conversations.parse(shape))
        assert found[0] == found[1] == found[2]
    monkeypatch.setattr(conversations, "_TIDY", 64)
    chart = conversations.Chart()
    for _ in range(5_000):
        chart.scan("u", True, False)
        assert sum(len(a) for _, a in chart.items.values()) < 1_000  # what is settled does not stay


def talk(spark):
    rng = random.Random(6)
    lines = ["Hello there.", "no end", "", " \t", None, "Why?", "So be it!  ", "same.", "same."]
    rows = []
    for conv in [*range(25), None, 900]:
        for t in range(rng.randint(1, 12)):
            role = rng.choice(["user", "assistant", "user", "assistant", "system", "tool", "", None, "User"])
            rows.append((conv, rng.choice([t, t, t, None, 3]), role, rng.choice(lines), "x", 1, True))
    rows += rows[:10] + [rows[-1]] * 7
    rows.append((77, 0, "user", "alone.", "x", 1, True))
    schema = "conv_id long, turn long, role string, text string, `odd name` string, n int, fit boolean"
    frame = pd.DataFrame([r[:4] for r in rows], columns=["conv_id", "turn", "role", "text"]).astype({"conv_id": "Int64", "turn": "Int64", "role": object, "text": object})
    return spark.createDataFrame(rows, schema).repartition(3), frame


def test_repair_is_its_sql(spark, monkeypatch):
    rows, frame = talk(spark)
    same(conversations.repaired(conversations.damaged(rows)), run_sql("op12_conversations", conversations=frame))


def test_long_conversations_wait_in_files(monkeypatch):
    def repair():
        c = conversations._Conversation(1)
        for i in range(50):
            c.add(i, ["user", "assistant"][i % 2], f"é{i}." * 20, 0, 1, True)
        return c.row()

    want = repair()
    monkeypatch.setattr(conversations, "_SPOOL", 500)
    assert repair() == want and want["audit"] == "K" * 50


def test_repaired_turns(spark):
    rows = [(1, 0, "user", "Hi."), (1, 1, "user", "And?"), (1, 2, "assistant", "Yes."), (2, 0, "assistant", "Hm."), (3, None, None, None)]
    out = conversations.repaired_turns(spark.createDataFrame(rows, "conv_id long, turn long, role string, text string")).orderBy("conv_id", "position").collect()
    assert [tuple(r) for r in out] == [(1, 0, "user", "Hi."), (1, 1, "assistant", ""), (1, 2, "user", "And?"), (1, 3, "assistant", "Yes."), (2, 0, "user", ""), (2, 1, "assistant", "Hm.")]


def test_conversations_where_all_is_dropped_and_none(spark):
    hit = next(i for i in range(1000) if zlib.crc32(f"{i}:0".encode()) % 20 == 0)
    rows = spark.createDataFrame([(hit, 0, "user", "Gone.")], "conv_id long, turn long, role string, text string")
    out = conversations.repaired(conversations.damaged(rows)).collect()
    assert [tuple(r) for r in out] == [(hit, 0, 0, 0, 0, 0, 0, "", hashlib.sha256(b"").hexdigest())]
    assert conversations.repaired(conversations.damaged(rows.limit(0))).count() == 0 and conversations.repaired_turns(rows.limit(0)).count() == 0


# ---- trie


@pytest.fixture(scope="module")
def bpe():
    path = pytest.importorskip("public_tokenizers").path("byte_bpe_50k.json")
    from tokenizers import Tokenizer

    return path, Tokenizer.from_file(path)


def odd_texts():
    rng = random.Random(7)
    pool = [*" \n\t\r'.,!aaabbeéèçstIng019☃日本　 \x1c\0՘😀_-", "the", "ing", "  ", "'s", "'ll", "<|endoftext|>", "-----------", "\n\n", " "]
    return ["".join(rng.choice(pool) for _ in range(rng.randint(0, 40))) for _ in range(3_000)] + ["", "x" * 5_000, "ab" * 3_000, "a b " * 2_000]


@pytest.mark.parametrize("table", [2_000, bpe_trie.TABLE_BYTES])
def test_trie_is_the_library(bpe, monkeypatch, table):
    monkeypatch.setattr(bpe_trie, "TABLE_BYTES", table)
    path, library = bpe
    codec = bpe_trie.TrieCodec(path)
    if table < 10_000:
        monkeypatch.setattr(bpe_trie, "_LEARN_WORDS", 50)
        monkeypatch.setattr(bpe_trie, "_PAIRS", 100)
    texts = odd_texts()
    for t, (ids, back) in zip(texts, codec.encode(texts)):
        want = library.encode(t, add_special_tokens=False).ids
        assert np.frombuffer(ids, "<u4").tolist() == want, t
        assert back == library.decode(want, skip_special_tokens=False)


def test_every_token_is_its_own_encoding(bpe):
    path, _ = bpe
    states = bpe_trie.TrieCodec(path).states
    ids = dict(states.walk(list(states.bytes)))
    assert all(ids[b] == [t] for t, b in enumerate(states.bytes))


def test_prefixes_are_walked_once(bpe, monkeypatch):
    path, _ = bpe
    states = bpe_trie.TrieCodec(path).states
    seen = []
    real = states._apart
    monkeypatch.setattr(states, "_apart", lambda x, y, until=float("inf"): seen.append(1) or real(x, y, until))
    words = [b"q" * i for i in range(1, 40)]
    alone = dict(w for x in words for w in states.walk([x]))
    states.known.clear()
    seen.clear()
    assert dict(states.walk(words)) == alone and len(seen) < 100


def test_bpe_query_against_the_library(spark, bpe):
    _, library = bpe
    docs = spark.read.parquet(f"{D}/documents.parquet")
    odd = spark.createDataFrame([(10_000 + i, t, 1) for i, t in enumerate([*odd_texts()[:40], None])] + [(None, "lost id", 1), (3, "again", 1), (3, "again", 1)], "doc_id long, text string, ids int")
    rows = docs.select("doc_id", "text").union(odd.select("doc_id", "text"))
    want = Counter()
    for r in rows.collect():
        ids = library.encode(r.text or "", add_special_tokens=False).ids
        want[r.doc_id, len(ids), hashlib.sha256(np.array(ids, "<u4").tobytes()).hexdigest(), hashlib.sha256(library.decode(ids, skip_special_tokens=False).encode()).hexdigest()] += 1
    got = bpe_trie.digests(docs.select("doc_id", "text"), bpe[0]).union(bpe_trie.digests(odd, bpe[0]))
    assert Counter(tuple(r) for r in got.collect()) == want
    spans = bpe_trie.encode_decode(odd, bpe[0]).collect()
    assert all(list(r.ids) == library.encode(r.decoded, add_special_tokens=False).ids for r in spans if "�" not in r.decoded)
    assert bpe_trie.digests(docs.limit(0), bpe[0]).count() == 0


# ---- quality scorer


def plain_gram_shares(text):
    """Bucket -> weight as features() defines them, gram by gram."""
    raw, out = text.encode(), Counter()
    out[0] = min(1.0, len(raw) / 400)
    for n in (1, 2, 3):
        counts = Counter()
        for i in range(len(raw) - n + 1):
            h = 0
            for b in raw[i : i + n]:
                h = (h * 257 + b + 1) % 2**32
            h = h * 0x9E3779B1 % 2**32
            counts[((h ^ (h >> 15)) % (quality._BUCKETS - 1)) + 1] += 1
        norm = math.sqrt(sum(c * c for c in counts.values()))
        for k, c in counts.items():
            out[k] += c / norm
    return out


def plain_regression(texts, good, epochs=12, seed=3):
    """Logistic regression by Adagrad over dictionaries."""
    rng, rows = np.random.default_rng(seed), [plain_gram_shares(t) for t in texts]
    w, g, bias, gb = Counter(), {}, 0.0, 1e-6
    for _ in range(epochs):
        order = rng.permutation(len(rows))
        for at in range(0, len(order), 32):
            own = order[at : at + 32]
            err = [1 / (1 + math.exp(-(sum(v * w[k] for k, v in rows[i].items()) + bias))) - good[i] for i in own]
            d = Counter()
            for i, e in zip(own, err):
                for k, v in rows[i].items():
                    d[k] += e * v / len(own)
            for k, x in d.items():
                g[k] = g.get(k, 1e-6) + x * x
                w[k] -= 0.3 * x / math.sqrt(g[k])
            total = sum(err) / len(own)
            gb += total**2
            bias -= 0.3 * total / math.sqrt(gb)
    return lambda t: 1 / (1 + math.exp(-(sum(v * w[k] for k, v in plain_gram_shares(t).items()) + bias)))


def test_quality_scores_against_a_plain_regression(spark):
    rng = random.Random(12)
    rows = [(i, (text_of(rng, rng.randint(0, 40)) if i % 3 else "".join(rng.choice("#$%&12 A") for _ in range(60)))) for i in range(50)] + [(60, None), (61, "")]
    df = spark.createDataFrame(rows, "doc_id long, text string")
    got = {r.doc_id: r for r in quality.quality(df).collect()}
    texts = [t or "" for _, t in sorted(rows)]
    score = plain_regression(texts, [got[i].posterior for i, _ in sorted(rows)])
    for (i, _), t in zip(sorted(rows), texts):
        assert got[i].score == pytest.approx(score(t), abs=1e-6) and got[i].predicted == int(got[i].score >= 0.5)
    small = quality.quality(df, sample=4).collect()
    assert any(abs(r.score - got[r.doc_id].score) > 1e-6 for r in small)
    nameless = quality.quality(df.selectExpr("cast(null as bigint) as doc_id", "text")).collect()
    assert len(nameless) == len(rows) and all(r.score == r.posterior for r in nameless)
    few = quality.quality(df, sample_bytes=1).collect()  # at most texts without a byte, or of one
    assert len(few) == len(rows) and any(r.score != got[r.doc_id].score for r in few)
    assert quality.quality(df.limit(0)).count() == 0


def test_toxicity_sample_is_bounded_in_bytes(spark):
    rows = [(i, f"word{i} " * 20 + ("foul " * 5 if i % 2 else "fair " * 5)) for i in range(60)]
    docs, labels = spark.createDataFrame(rows, "doc_id long, text string"), spark.createDataFrame([(i, i % 2) for i, _ in rows], "doc_id long, toxic int")
    whole, part, none = (toxicity.fit_on(docs, labels, sample_bytes=n) for n in (1 << 20, 1_000, 0))
    assert toxicity.fit_on(docs, labels).offset() == whole.offset()
    assert len({m.table().tobytes() for m in (whole, part, none)}) == 3


def test_folders_of_threads_are_their_own(spark):
    import threading

    from wardline.llm import common

    inside, seen = threading.Event(), {}

    def run():
        seen["other"] = common.shared_dir(spark, "x")
        inside.set()

    with common.passing(spark):
        seen["own"] = common.shared_dir(spark, "x")
        t = threading.Thread(target=run)
        t.start()
        t.join()
    seen["after"] = common.shared_dir(spark, "x")
    assert inside.is_set() and "passing-" in seen["own"] and "passing-" not in seen["other"] + seen["after"]


@pytest.mark.parametrize("name", ["op11_importance", "op12_conversations"])
def test_query_equals_sql(spark, name):
    same(queries.queries()[name](spark, D), run_sql(name, **{t: f"{D}/{t}.parquet" for t in ("documents", "benchmark", "conversations")}))
