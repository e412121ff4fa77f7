import hashlib
import random
import unicodedata
import zlib
from collections import Counter, defaultdict
from functools import partial

import numpy as np
import pytest
from pyspark.sql import functions as F

from tidemark.llm import anchors, op1_langid, op2_kdtree, op3_chain, op4_cube, op5_rabitq, op6_packing, op7_suffix, op8_chosen_path, op9_debruijn, op10_digest, queries
from tidemark.llm.common import Work, semi_reduce
from tidemark.llm.components import components
from tidemark.llm.queries import tokenizer_path

from .conftest import WORD, edge_rows, prose

ROWS = edge_rows()


class Sets(dict):
    def find(self, x):
        while self.setdefault(x, x) != x:
            x = self[x]
        return x

    def join(self, a, b):
        a, b = self.find(a), self.find(b)
        self[max(a, b)] = min(a, b)


def test_components_of_hub_chain_and_nothing(spark):
    edges = [(0, i) for i in range(1, 40)] + [(i, i + 1) for i in range(100, 150)] + [(7, 7), (None, 3), (200, 201), (201, 200)]
    df = spark.createDataFrame(edges, "src long, dst long")
    got = {r["id"]: r["component"] for r in components(df, Work(spark, "t")).collect()}
    assert got == {**{i: 0 for i in range(40)}, **{i: 100 for i in range(100, 151)}, 200: 200, 201: 200}
    assert components(df.where("false"), Work(spark, "t")).count() == 0


def test_semi_reduce_keeps_every_wanted_row(spark):
    df = spark.range(5000)
    kept = {r[0] for r in semi_reduce(df, "id", spark.range(0, 5000, 50)).collect()}
    assert kept >= set(range(0, 5000, 50)) and len(kept) < 500


# --- 1 ---


def test_language_kernel_is_exact(spark):
    rng = random.Random(1)
    texts = [prose(rng, 20, "abcdxyz") for _ in range(12)]
    g = [set(x.tolist()) for x in op1_langid.grams(texts)]
    for t, s in zip(texts, g):
        padded = " " + t + " "
        assert len(s) == sum(len({padded[i : i + n] for i in range(len(padded) - n + 1)}) for n in (1, 2, 3))


def test_language_held_out_accuracy_and_edges(spark, edge, empty):
    rng = random.Random(2)
    alphabets = {"aa": "abcde", "bb": "defgh", "cc": "ghija"}
    rows = [(k, prose(rng, rng.randrange(2, 60), a)) for k, a in alphabets.items() for _ in range(80)]
    model = op1_langid.train(spark.createDataFrame(rows + [(None, "abc"), ("aa", None), ("bb", "42")], "lang string, text string"), Work(spark, "t"))
    test = [(i, prose(rng, 15, alphabets[k]), k) for i, k in enumerate(list(alphabets) * 30)]
    got = {r["doc_id"]: r for r in op1_langid.predict(spark.createDataFrame(test, "doc_id long, text string, lang string"), model).collect()}
    assert np.mean([got[i]["lang_pred"] == k for i, _, k in test]) > 0.95
    out = op1_langid.predict(edge, model).collect()
    assert len(out) == len(ROWS) and all(0 <= r["score"] <= 1 for r in out)
    no_letter = Counter(r[0] for r in ROWS if not any(c.isalpha() for c in r[1] or ""))
    assert Counter(r["doc_id"] for r in out if r["lang_pred"] == "und") == no_letter
    assert op1_langid.train(empty.select("lang", "text"), Work(spark, "t")) is None
    assert {r["lang_pred"] for r in op1_langid.predict(edge, None).collect()} == {"und"} and op1_langid.predict(empty, model).count() == 0


def test_language_sample_counts_distinct_texts(spark):
    rng = random.Random(3)
    texts = {"aa": [prose(rng, 6) for _ in range(30)], "bb": [prose(rng, 6, "stuvw") for _ in range(60)], "cc": [prose(rng, 6, "klmno") for _ in range(3)]}
    rows = [(k, t) for k, ts in texts.items() for t in ts] + [("aa", "copied line")] * 20_000
    df, work = spark.createDataFrame(rows, "lang string, text string"), Work(spark, "t")
    model = op1_langid.train(df, work, per_label=20)
    assert model.labels == ["aa", "bb", "cc"]
    hashed = df.distinct().select("lang", "text", F.xxhash64(F.lit(1), "text").alias("h")).collect()
    want = {k: [r["text"] for r in sorted((r for r in hashed if r["lang"] == k), key=lambda r: r["h"])][:20] for k in texts}
    got = {k: [] for k in texts}
    for r in sorted(spark.read.parquet(f"{work.root}/train").collect(), key=lambda r: r["k"]):
        got[r["lang"]].append(r["text"])
    assert got == want


def test_language_scores_match_brute_force(spark):
    rng = random.Random(6)
    rows = [(k, prose(rng, rng.randrange(3, 30), a)) for k, a in (("aa", "abcdef"), ("bb", "efghij")) for _ in range(30)]
    work = Work(spark, "t")
    model = op1_langid.train(spark.createDataFrame(rows, "lang string, text string"), work, per_label=25, landmarks_per_label=6)
    grams = lambda t: {f" {t} "[i : i + n] for n in (1, 2, 3) for i in range(len(t) + 3 - n)}
    kernel = lambda a, b: len(grams(a) & grams(b)) / (len(grams(a)) * len(grams(b))) ** 0.5
    used = sorted((r["lang"], r["k"], r["text"]) for r in spark.read.parquet(f"{work.root}/train").collect())
    marks, texts = [t for _, k, t in used if k <= 6], [t for _, _, t in used]
    assert len(marks) == 12 and len(texts) == 50
    value, vector = np.linalg.eigh(np.array([[kernel(a, b) for b in marks] for a in marks]))
    root = vector / np.sqrt(value)
    feature = lambda ts: np.hstack([np.array([[kernel(t, m) for m in marks] for t in ts]) @ root, np.ones((len(ts), 1))])
    x, y = feature(texts), np.array([[lang == k for k in ("aa", "bb")] for lang, _, _ in used], float)
    weights = np.linalg.solve(x.T @ x + 1e-3 * len(x) * np.eye(x.shape[1]), x.T @ y)
    test = [prose(rng, 12, a) for a in ("abcdef", "efghij", "cdefgh") for _ in range(10)]
    want = feature(test) @ weights
    label, score = op1_langid.classify(model, test)
    assert label == [("aa", "bb")[i] for i in want.argmax(1)]
    assert np.abs(np.clip(want.max(1), 0, 1) - score).max() < 2e-3


# --- 2 ---


@pytest.mark.parametrize("hot", [0, 5, 400])
def test_sharding_law_groups_and_slots(spark, hot):
    rng = random.Random(3)
    rows = [(i, prose(rng, rng.randrange(1, 40)), rng.choice(["a", None]), rng.choice("st")) for i in range(300)] + [(1000 + i, "copy " * 9, "a", "s") for i in range(hot)] + [(2, None, None, None)]
    work = Work(spark, "t")
    out = op2_kdtree.slots(op2_kdtree.shards(spark.createDataFrame(rows, "doc_id long, text string, lang string, source string"), 8, work=work), work).collect()
    assert len(out) == len(rows)
    size, slots, where = Counter(), defaultdict(list), defaultdict(set)
    text = {r[0]: r[1] for r in rows if r[1] is not None}
    for r in out:
        size[r["shard"]] += r["size"]
        slots[r["shard"]].append(r["slot"])
        if r["doc_id"] != 2:
            assert r["size"] == len(text[r["doc_id"]]) + 1 and r["text_crc32"] == zlib.crc32(text[r["doc_id"]].encode())
            where[text[r["doc_id"]]].add(r["shard"])
    assert len(size) == 8 and max(size.values()) - min(size.values()) <= 0.1 * sum(size.values()) / 8
    assert all(sorted(s) == list(range(len(s))) for s in slots.values())
    assert all(len(s) == 1 for t, s in where.items() if t != "copy " * 9) and (len(where.get("copy " * 9, "x")) == 1 or hot == 400)


@pytest.mark.parametrize("copy", [(7, "copied line"), (None, "copied line"), (None, None)])
def test_sharding_rows_of_one_id(spark, copy):
    rng = random.Random(5)
    rows = [copy] * 3000 + [(100 + i, prose(rng, rng.randrange(1, 4))) for i in range(100)]
    work = Work(spark, "t")
    docs = spark.createDataFrame([(*r, "a", "s") for r in rows], "doc_id long, text string, lang string, source string")
    out = op2_kdtree.slots(op2_kdtree.shards(docs, 8, work=work), work).collect()
    size, slots = Counter(), defaultdict(list)
    for r in out:
        size[r["shard"]] += r["size"]
        slots[r["shard"]].append(r["slot"])
    assert len(out) == 3100 and len(size) == 8 and max(size.values()) - min(size.values()) <= 0.02 * sum(size.values())
    assert all(sorted(s) == list(range(len(s))) for s in slots.values())


def test_sharding_edges(spark, edge, empty):
    work = Work(spark, "t")
    assert op2_kdtree.slots(op2_kdtree.shards(edge, 8, work=work), work).count() == len(ROWS)
    work = Work(spark, "t")
    assert op2_kdtree.slots(op2_kdtree.shards(empty, 8, work=work), work).count() == 0
    assert op2_kdtree.shards(edge, target_bytes=100_000).agg(F.countDistinct("shard")).first()[0] >= 2


# --- 3 ---


def test_chain_on_held_out_rows(spark, edge, empty):
    rng = random.Random(4)
    bad, poor = ["vilewort", "grimtok", "snarlbit"], ["zzgarble", "qqnoise"]
    rows, labels = [], []
    for i in range(900):
        low, toxic = rng.random() < 0.3, rng.random() < 0.2
        words = prose(rng, 40).split() + (rng.sample(bad, 2) if toxic else []) + (rng.sample(poor, 1) if low else [])
        rng.shuffle(words)
        rows.append((i, " ".join(words)))
        labels.append((i, int(low), int(toxic)))
    docs = spark.createDataFrame(rows, "doc_id long, text string")
    known = spark.createDataFrame([x for x in labels if x[0] < 600] + [(None, 1, 1), (5, None, 1), (99_999, 0, 1)], "doc_id long, low int, toxic int")
    chain = op3_chain.train(docs, known, ["low", "toxic"], "toxic")
    got = {r["doc_id"]: r for r in op3_chain.score(docs, chain, "toxic").collect()}
    held = [x for x in labels if x[0] >= 600]
    assert np.mean([got[i]["toxic"] == bool(t) for i, _, t in held]) > 0.98
    assert np.mean([(got[i]["p_low"] > 0.5) == bool(q) for i, q, _ in held]) > 0.95
    assert [m.extra.size for m in chain.models] == [0, 1]
    out = op3_chain.score(edge, chain, "toxic").collect()
    assert len(out) == len(ROWS) and not any(r["toxic"] for r in out)
    none = op3_chain.train(docs, known.where("false"), ["low", "toxic"], "toxic")
    assert none is None and op3_chain.score(edge, none, "toxic").where("toxic").count() == 0 and op3_chain.score(empty, chain, "toxic").count() == 0


def test_chain_features_and_scores_match_brute_force():
    rng = random.Random(9)
    texts = [prose(rng, 30, "abcdefghijé") + " Straße ABC" for _ in range(40)] + ["", "42"]
    doc, feature = op3_chain.features(texts)
    for i, t in enumerate(texts):
        words = set("".join(c if c.isalpha() else " " for c in t.lower()).split())
        parts = {(n, w if n is None else w[:n]) for w in words for n in (None, *op3_chain.PREFIXES)}
        assert len({f for d, f in zip(doc, feature) if d == i}) == (doc == i).sum() and abs((doc == i).sum() - len(parts)) <= 1  # two may share a column
    y = np.array([i % 3 == 0 for i in range(len(texts))], float)
    earlier = rng.random() * np.ones((len(texts), 1))
    m = op3_chain.fit(doc, feature, len(texts), earlier, y, np.ones(len(texts), bool))
    got = m.score(doc, feature, len(texts), earlier)
    for i in range(len(texts)):
        z = sum(float(m.weights[f]) for d, f in zip(doc, feature) if d == i) + float(earlier[i] @ m.extra) + m.bias
        assert abs(got[i] - 1 / (1 + np.exp(-z))) < 1e-6


def test_cut_needs_half_of_it_right():
    one = np.ones(8)
    assert op3_chain.best_cut(np.full(8, 0.1), np.array([1, 0, 0, 0, 0, 0, 0, 0]), one) == 2.0
    assert op3_chain.best_cut(np.array([0.9, 0.8, 0.8, 0.2, 0.1, 0.1, 0.1, 0.1]), np.array([1, 1, 0, 0, 0, 0, 0, 0]), one) == 0.5
    assert op3_chain.best_cut(np.array([0.9, 0.2, 0.1, 0.1, 0.1, 0.1, 0.1, 0.1]), np.array([1, 0, 0, 0, 0, 0, 0, 0]), one) == 0.55


def test_chain_folds_hold_copies_together(spark, monkeypatch):
    seen = []
    real = op3_chain.fit

    def fit(doc, feature, n, earlier, y, rows, **k):
        seen.append(rows.copy())
        return real(doc, feature, n, earlier, y, rows, **k)

    monkeypatch.setattr(op3_chain, "fit", fit)
    rng = random.Random(2)
    texts = [prose(rng, 20) + (" vileword" if i % 2 else "") for i in range(60)]
    docs = spark.createDataFrame([(i, texts[i % 60]) for i in range(180)], "doc_id long, text string")
    labels = spark.createDataFrame([(i, i % 60 % 2) for i in range(180)], "doc_id long, toxic int")
    op3_chain.train(docs, labels, ["toxic"], "toxic")
    folds = [~rows for rows in seen if not rows.all()]
    assert len(folds) == op3_chain.FOLDS and sum(f.astype(int) for f in folds).tolist() == [1] * 180
    assert all(f[i] == f[i + 60] == f[i + 120] for f in folds for i in range(60))  # rows come in order of ids


# --- 4 ---


def test_targets_reshare_excess():
    got = op4_cube.targets({"b": 100, "a": 10, None: 1000})
    assert got == {"a": 20.0, "b": 200.0, None: 1110 * 1.5 - 220}
    assert sum(op4_cube.targets({"x": 7, "y": 0}).values()) == 10.5 and op4_cube.targets({}) == {}


def test_flight_keeps_sums_and_probabilities():
    rng = random.Random(6)
    size = [rng.randrange(1, 900) for _ in range(300)] + [50_000]
    taken = np.zeros(len(size))
    for seed in range(60):
        pi = op4_cube.flight(size, op4_cube.large_first(size, [0.3] * len(size), seed), seed)
        assert sum(0 < p < 1 for p in pi) <= 2
        assert abs(np.dot(size, pi) - 0.3 * sum(size)) < 1e-4 * sum(size) and abs(sum(pi) - 0.3 * len(size)) < 2
        taken += op4_cube.landing(size, pi)
    assert abs(taken.mean() / 60 - 0.3) < 0.02


def test_mixing(spark, edge, empty):
    got = op4_cube.mix(edge).collect()
    assert sorted((r["doc_id"], r["copies"]) for r in got) == sorted((r["doc_id"], r["copies"]) for r in op4_cube.mix(edge.repartition(5)).collect())
    assert len(got) == len(ROWS)
    sizes = Counter()
    for r in ROWS:
        sizes[r[3]] += len(WORD.findall(r[1] or ""))
    goal, taken = op4_cube.targets(sizes), Counter()
    for r in got:
        assert r["source_size"] == sizes[r["source"]] and r["target"] == goal[r["source"]] and 0 <= r["copies"] <= 2
        taken[r["source"]] += r["copies"] * r["size"]
    small = {s: max(len(WORD.findall(r[1] or "")) for r in ROWS if r[3] == s) for s in sizes}
    assert all(abs(taken[s] - goal[s]) <= max(0.05 * goal[s], small[s] / 2) for s in sizes)
    assert op4_cube.mix(empty).count() == 0


def test_mixing_in_blocks(spark, monkeypatch):
    monkeypatch.setattr(op4_cube, "BLOCK", 50)
    rng = random.Random(8)
    rows = [(i, "w " * rng.randrange(1, 90), "big" if i % 3 else "small") for i in range(1500)]
    got = op4_cube.mix(spark.createDataFrame(rows, "doc_id long, text string, source string")).collect()
    taken, goal = Counter(), {}
    for r in got:
        taken[r["source"]] += r["copies"] * r["size"]
        goal[r["source"]] = r["target"]
    assert len(got) == 1500 and all(abs(taken[s] - goal[s]) < 0.01 * goal[s] for s in goal)


# --- 5 ---


def test_embedding_links_match_brute_force(spark):
    rng = np.random.default_rng(9)
    base = rng.standard_normal((150, 16))
    v = np.vstack([base, base[:40] + 0.05 * rng.standard_normal((40, 16)), base[:10] * 3, base[:5], np.repeat(base[:1] + 0.02, 30, 0) + 0.05 * rng.standard_normal((30, 16))]).astype(np.float32)
    rows = [(i, x.tolist()) for i, x in enumerate(v)] + [(900, None), (901, []), (902, [0.0] * 16), (903, [float("nan")] * 16), (904, [None] + [1.0] * 15), (905, [float("inf")] * 16), (906, [1.0, 2.0]), (907, [2.0, 4.0]), (3, v[3].tolist()), (906, [-1.0, 2.0])]
    df = spark.createDataFrame([(*r, "x") for r in rows], "vec_id long, embedding array<float>, rep string")
    got = op5_rabitq.near_links(df, recall=0.99999).collect()
    x = np.vstack([v, v[3:4]]).astype(np.float64)
    ids = [*range(len(v)), 3]
    x /= np.linalg.norm(x, axis=1, keepdims=True)
    link = x @ x.T >= 0.95
    sets, n = Sets(), Counter()
    for i in range(len(ids)):
        n[i] = int(link[i].sum()) - 1
        for j in np.flatnonzero(link[i]):
            sets.join(ids[i], ids[j])
    want = Counter((ids[i], n[i], sets.find(ids[i])) for i in range(len(ids)))
    want.update((k, 0, k) for k in range(900, 906))
    want.update([(906, 1, 906), (907, 1, 906), (906, 0, 906)])
    assert Counter((r["vec_id"], r["n_links"], r["component_id"]) for r in got) == want
    assert all(r["kept"] == (r["vec_id"] == r["component_id"]) for r in got)
    assert op5_rabitq.near_links(df.where("false")).count() == 0


def test_large_buckets_go_in_blocks(spark, monkeypatch):
    monkeypatch.setattr(op5_rabitq, "BLOCK", 16)
    rng = np.random.default_rng(2)
    v = rng.standard_normal(8) + 0.01 * rng.standard_normal((90, 8))
    df = spark.createDataFrame([(i, x.tolist()) for i, x in enumerate(v)], "vec_id long, embedding array<double>")
    assert {(r["n_links"], r["component_id"]) for r in op5_rabitq.near_links(df).collect()} == {(89, 0)}


def test_estimates_are_unbiased_and_bounded():
    rng = np.random.default_rng(4)
    for dim in (64, 33):
        x = rng.standard_normal((400, dim))
        x /= np.linalg.norm(x, axis=1, keepdims=True)
        turn = op5_rabitq.rotations(dim, 2)
        _, code, factor, step, level = op5_rabitq.encode(x, turn, 4, 4)
        assert code.nbytes + level.nbytes <= 400 * (dim + 9) * 5 / 8
        c, q = op5_rabitq.decode(code, step, level, dim)
        assert (np.abs(q - x @ turn[:, :dim]) <= step[:, None] * 1.001).all()
        error = (c @ q.T) / factor[:, None] - x @ x.T
        np.fill_diagonal(error, 0)
        own, other = op5_rabitq.bounds(factor, step, dim)
        assert abs(error.mean()) < 4e-3 and (np.abs(error) <= own[:, None] + other[None, :] / factor[:, None]).mean() > 0.9999


# --- 6 ---


def test_fill_and_plan_use_every_length():
    rng = random.Random(7)
    for _ in range(60):
        counts = {rng.randrange(1, 64): rng.randrange(1, 5) for _ in range(rng.randrange(1, 9))}
        got = op6_packing.fill(counts, 64)
        sums = {0}
        for n, c in counts.items():
            sums = {s + n * k for s in sums for k in range(c + 1) if s + n * k <= 64}
        assert sum(n * c for n, c in got.items()) == max(sums) and all(c <= counts[n] for n, c in got.items())
        p = op6_packing.Packer(64, 5)
        texts = [bytes(4 * n) for n, c in counts.items() for _ in range(c)] + [bytes(4 * rng.randrange(1, 200)) for _ in range(3)]
        rows = []
        for i, x in enumerate(texts):
            p.take(i, x)
            if i % 4 == 3:  # chunks
                rows += [r for b in p.pieces(False) for r in b.to_pylist()]
                assert sum(n * len(x) for n, x in p.rest.items()) < 64
        rows += [r for b in p.pieces(True) for r in b.to_pylist()]
        parts, used = defaultdict(list), defaultdict(list)
        for r in rows:
            assert r["doc_tokens"] == len(texts[r["doc_id"]]) // 4 and len(r["ids"]) == 4 * r["length"]
            parts[r["doc_id"]].append((r["start"], r["length"]))
            used[r["sequence_id"]].append((r["offset"], r["length"]))
        assert sorted(used) == list(range(5, 5 + len(used)))
        for i, x in enumerate(texts):
            spans = sorted(parts[i])
            assert [s for s, _ in spans] == np.cumsum([0, *[n for _, n in spans]])[:-1].tolist() and sum(n for _, n in spans) == len(x) // 4
        for spans in used.values():
            spans.sort()
            total = sum(n for _, n in spans)
            assert [s for s, _ in spans] == np.cumsum([0, *[n for _, n in spans]])[:-1].tolist() and (total == 64 or total < 64 and total & (total - 1) == 0)


def test_ids_are_the_tokenizers():
    from tokenizers import Tokenizer

    t, e, rng = Tokenizer.from_file(tokenizer_path()), op6_packing.Encoder(tokenizer_path()), random.Random(12)
    letters = "abtsrelvm'’ \t\n\x0b.,;12 AΉ\u0345ΣσςİıßéE\u0301ﬁ日本\u1c89\x1e\x85\xa0\u2028<|>" + "don't we're I'LL "
    texts = ["Ή\u0345'", "\u0345'Ή", "don't'S", "<|endoftext|>'"] + ["".join(rng.choice(letters) for _ in range(rng.randrange(1, 12))) for _ in range(30_000)]
    for i in range(0, len(texts), 500):
        some = texts[i : i + 500]
        assert [np.frombuffer(x, "<u4").tolist() for x in e(some)] == [x.ids for x in t.encode_batch(some, add_special_tokens=False)]


def test_packing_round_trip(spark, edge, empty):
    from tokenizers import Tokenizer

    t = Tokenizer.from_file(tokenizer_path())
    want = Counter(tuple([r[0], *t.encode(r[1] or "", add_special_tokens=False).ids, 1]) for r in ROWS)
    pieces = op6_packing.pack(edge, tokenizer_path(), 256).collect()
    by, fill = defaultdict(list), defaultdict(list)
    for p in pieces:
        assert len(p["ids"]) == 4 * p["length"]
        fill[p["sequence_id"]].append((p["offset"], p["length"]))
        by[(p["doc_id"], p["doc_tokens"])].append((p["start"], np.frombuffer(p["ids"], "<u4")))
    for k, xs in fill.items():
        xs.sort()
        total = sum(n for _, n in xs)
        assert all(o == sum(n for _, n in xs[:i]) for i, (o, _) in enumerate(xs)) and (total == 256 or total & (total - 1) == 0)
    assert sum(len(x) for xs in by.values() for _, x in xs) == sum(len(k) - 1 for k, c in want.items() for _ in range(c))
    single = {k for k, c in Counter((r[0]) for r in ROWS).items() if c == 1}
    for (doc, n), xs in by.items():
        if doc in single:
            xs.sort(key=lambda s: s[0])
            assert (doc, *np.concatenate([x for _, x in xs]).tolist()) in want
    assert op6_packing.pack(empty, tokenizer_path()).count() == 0


# --- 7 and 9 ---


def gathered(hot, batches, dtype, key):
    """``gather`` with a low limit, set in the worker."""
    anchors.HOT, anchors.GATHER = hot, hot * 100
    return anchors.gather(batches, dtype, key)


def brute(rows, cut, span):
    first = {}
    for i, t in rows:
        s = cut(t)
        for k in range(len(s) - span + 1):
            w = tuple(s[k : k + span])
            first[w] = min(first.get(w, 1 << 63), i)
    out = []
    for i, t in rows:
        s = cut(t)
        dead = [False] * len(s)
        for k in range(len(s) - span + 1):
            if first[tuple(s[k : k + span])] < i:
                dead[k : k + span] = [True] * span
        out.append((i, len(s), [x for x, d in zip(s, dead) if not d], sum(d and not (k and dead[k - 1]) for k, d in enumerate(dead))))
    return out


@pytest.mark.parametrize("size,hot", [(12 << 20, 1 << 20), (2000, 1 << 20), (2000, 1)])
def test_suffix_dedup_matches_brute_force(spark, edge, empty, monkeypatch, size, hot):
    monkeypatch.setattr("tidemark.llm.anchors.CELL", size)
    monkeypatch.setattr(op7_suffix, "gather", partial(gathered, hot))
    rows = [(r[0], r[1]) for r in ROWS]
    want = Counter((i, n, bytes(kept), spans) for i, n, kept, spans in brute(rows, lambda t: (t or "").encode(), 50))
    got = op7_suffix.repeats(edge).collect()
    assert Counter((r["doc_id"], r["n_bytes"], bytes(r["kept"]), len(r["spans"])) for r in got) == want
    whole = op7_suffix.repeats(edge, whole_characters=True, columns=("lang",)).select(F.decode("kept", "UTF-8").alias("t"), "lang").collect()
    assert len(whole) == len(ROWS)
    assert op7_suffix.repeats(empty).count() == 0


@pytest.mark.parametrize("bits", [64, 6])
def test_substring_dedup_matches_brute_force(spark, edge, empty, monkeypatch, bits):
    monkeypatch.setattr(op9_debruijn, "BUCKET", 1 << 14)
    rows = [(r[0], r[1]) for r in ROWS]
    want = Counter((i, n, " ".join(kept), spans) for i, n, kept, spans in brute(rows, lambda t: WORD.findall(t or ""), 50))
    got = op9_debruijn.repeats(edge, bits=bits).collect()
    assert Counter((r["doc_id"], r["n_words"], r["kept"], len(r["spans"])) for r in got) == want
    assert op9_debruijn.repeats(empty).count() == 0


def test_paths_are_whole_and_have_one_source(spark):
    rng = random.Random(4)
    shared, other = prose(rng, 200), prose(rng, 90)
    rows = [(10, shared), (11, prose(rng, 30) + " " + shared), (12, shared + " " + other), (13, prose(rng, 9) + " " + other), (14, " ".join(shared.split()[20:120]))]
    g = op9_debruijn.Graph(spark.createDataFrame(rows, "doc_id long, text string"), "doc_id", "text", 50, 64, Work(spark, "t"))
    got = defaultdict(set)
    for r in g.paths().collect():
        got[r["path"]].add((r["id"], r["n"], r["source"]))
    long = sorted({(n, s) for x in got.values() for _, n, s in x if n > 1})
    assert long == [(19, 10), (39, 12), (49, 10), (79, 10)]  # 151 windows, cut at 20 and 70; ends are paths of one edge
    assert all(len({(n, s) for _, n, s in x}) == 1 for x in got.values())
    assert sorted(i for i, n, _ in set().union(*got.values()) if n == 49) == [10, 11, 12, 14]
    plan = g.with_notes(g.copies.repartition(g.n, "uid"), "left_anti")._jdf.queryExecution().toString()
    assert "Bucketed: true" in plan


def test_null_ids_come_last(spark):
    rng = random.Random(1)
    t = prose(rng, 90)
    df = spark.createDataFrame([(None, t), (5, "new " + t), (None, t)], "doc_id long, text string")
    got = sorted((r["doc_id"] is None, len(r["kept"])) for r in op7_suffix.repeats(df).collect())
    assert got == [(False, len(t) + 4), (True, 0), (True, 0)]


def test_transform_and_prefixes_match_a_sorted_suffix_array():
    rng = np.random.default_rng(8)
    for _ in range(15):
        m, width, span = int(rng.integers(1, 40)), 24, 9
        group, ctx = np.sort(rng.integers(0, 3, m)), rng.integers(97, 99, (m, width)).astype(np.uint8)
        ctx[rng.integers(0, m, m // 2)] = ctx[rng.integers(0, m, m // 2)]
        seen = []
        for j, order, transform, lcp in op7_suffix.columns_inserted(group, ctx, span):
            suffix = [(int(g), bytes(c[j:])) for g, c in zip(group, ctx)]
            assert [suffix[i] for i in order] == sorted(suffix) and sorted(order) == list(range(m))
            assert transform.tolist() == [int(ctx[i, j - 1]) if j else 0 for i in order]
            for k in range(1, m):
                (g, a), (h, b) = suffix[order[k - 1]], suffix[order[k]]
                same = next((n for n, (p, q) in enumerate(zip(a, b)) if p != q), len(a)) if g == h else 0
                assert lcp[k] == min(same, span)
            seen.append(j)
        assert seen == list(range(width - 1, -1, -1))


def test_column_index_matches_sorting():
    rng = np.random.default_rng(3)
    for _ in range(20):
        m, span = int(rng.integers(1, 60)), 50
        group = np.sort(rng.integers(0, 4, m))
        ctx = rng.integers(97, 99, (m, 80)).astype(np.uint8)
        ctx[rng.integers(0, m, m // 2)] = ctx[rng.integers(0, m, m // 2)]
        ctx[:, int(rng.integers(0, 80))] = 97
        doc, lo = rng.integers(0, 9, m), rng.integers(0, 3, m).astype(np.uint8)
        hi = np.full(m, 30, np.uint8)
        got = op7_suffix.column_index(group, ctx, doc, lo, hi, span)
        for r in range(m):
            want = 0
            for o in range(lo[r], 31):
                if any(group[x] == group[r] and lo[x] <= o and doc[x] < doc[r] and (ctx[x, o : o + span] == ctx[r, o : o + span]).all() for x in range(m)):
                    want |= 1 << o
            assert int(got[r]) == want


# --- 8 ---


@pytest.mark.parametrize("block", [1024, 8])
def test_jaccard_join_matches_brute_force(spark, edge, empty, monkeypatch, block):
    monkeypatch.setattr(op8_chosen_path, "BLOCK", block)
    monkeypatch.setattr(op8_chosen_path, "SMALL", 64 if block > 8 else 4)
    rng = random.Random(11)
    base = prose(rng, 90).split()
    more = []
    for i in range(40):  # one large group of near copies
        w = list(base)
        w[rng.randrange(90)] = f"odd{i}"
        more.append((5000 + i, " ".join(w)))
    rows = [(r[0], r[1]) for r in ROWS] + more
    df = edge.select("doc_id", "text", "rep", "path").unionByName(spark.createDataFrame(more, "doc_id long, text string"), allowMissingColumns=True)
    sets = []
    for _, t in rows:
        w = WORD.findall(t or "")
        sets.append(frozenset(tuple(w[i : i + 5]) for i in range(max(1, len(w) - 4))) if w else frozenset())
    links, n = Sets(), Counter()
    for i in range(len(rows)):
        links.find(i)
        for j in range(i):
            both = len(sets[i] & sets[j])
            if sets[i] and sets[j] and both >= 0.8 * (len(sets[i]) + len(sets[j]) - both):
                links.join(i, j)
                n[i] += 1
                n[j] += 1
    low = {}
    for i, (k, _) in enumerate(rows):
        low[links.find(i)] = min(low.get(links.find(i), k), k)
    want = Counter((k, n[i], low[links.find(i)]) for i, (k, _) in enumerate(rows))
    got = op8_chosen_path.similar(df, recall=0.99999).collect()
    assert Counter((r["doc_id"], r["n_links"], r["class_id"]) for r in got) == want
    assert op8_chosen_path.similar(empty).count() == 0


def test_min_hashes_estimate_similarity():
    rng = np.random.default_rng(5)
    a = rng.integers(0, 1 << 63, 1000, dtype=np.uint64)
    b = np.concatenate([a[:900], rng.integers(0, 1 << 63, 100, dtype=np.uint64)])
    s = op8_chosen_path.sketch(np.repeat([0, 1], 1000), np.concatenate([a, b]), 2)
    assert abs((s[0] == s[1]).mean() - 900 / 1100) < 0.2


def test_recall_holds_where_buckets_stay_large(spark):
    rng, n = np.random.default_rng(17), 8000
    one = rng.integers(0, 4, (n, op8_chosen_path.SLOTS)).astype(np.uint32)  # few tokens: buckets of all levels exceed SMALL
    other = np.where(rng.random(one.shape) < (0.8 - 0.25) / 0.75, one, rng.integers(0, 4, one.shape)).astype(np.uint32)  # 0.8 of the slots agree
    rows = [(2 * i + k, x[i].tobytes()) for i in range(n) for k, x in enumerate((one, other))]
    for level_size in (2 * n / 4, 2 * n / 16):
        assert level_size > op8_chosen_path.SMALL
    sets = spark.createDataFrame(rows, "rep long, data binary").repartition(8)
    edges, _ = op8_chosen_path.candidate_edges(sets, 0.8, 0.999, Work(spark, "t"))
    found = sum(r["src"] // 2 == r["dst"] // 2 for r in edges.collect())
    assert found >= n * 0.998  # a perfect 0.999 leaves 8 of them


def test_rows_of_a_split_do_not_grow_with_the_square_of_a_group(spark):
    """A group of sets that agree in a fifth of their slots; the square of 8 times the sets is 64, the rows of one slot after another grew 26-fold."""
    made = []
    for n in (1500, 12000):
        tokens = np.random.default_rng(3).integers(0, 5, (n, op8_chosen_path.SLOTS)).astype(np.uint32)
        work = Work(spark, "t")
        op8_chosen_path.candidate_edges(spark.createDataFrame([(i, t.tobytes()) for i, t in enumerate(tokens)], "rep long, data binary"), 0.8, 0.999, work)
        made.append(spark.read.parquet(f"{work.root}/split-*").count())
    assert 0 < made[1] < 20 * made[0], made


# --- 10 ---


def test_fingerprints_group_canonical_texts(spark, edge, empty):
    fold = lambda t: unicodedata.normalize("NFKC", unicodedata.normalize("NFKC", t).upper().lower())
    canon = lambda t: " ".join(fold(t or "").split())
    got = op10_digest.fingerprints(edge, "doc_id", "text").collect()
    assert len(got) == len(ROWS)
    by, single = defaultdict(set), Counter(r[0] for r in ROWS)
    for r in got:
        by[r["doc_id"]].add(r["fingerprint"])
    seen = {}
    for r in ROWS:
        if single[r[0]] == 1 and not set(r[1] or "") & set("\x00\x1e"):
            (fp,) = by[r[0]]
            assert seen.setdefault(canon(r[1]), fp) == fp
    assert len(set(seen.values())) == len(seen)
    assert op10_digest.fingerprints(empty, "doc_id", "text").count() == 0


def test_colliding_hashes_are_told_apart(spark, monkeypatch):
    monkeypatch.setattr(op10_digest, "hashes", lambda text: [(F.length(text) % 2).cast("long").alias("h1"), F.lit(0).cast("long").alias("h2")])
    df = spark.createDataFrame([(1, "aa"), (2, "AA "), (3, "bb"), (4, "c"), (5, "dd")], "doc_id long, text string")
    got = {r["doc_id"]: r["fingerprint"] for r in op10_digest.fingerprints(df, "doc_id", "text").collect()}
    assert got[1] == got[2] and len({got[i] for i in (1, 3, 4, 5)}) == 4


def test_next_document_and_edit(spark):
    ids = [5, -3, 900_000, 17, 18, 2**62 + 5, -(2**62) - 9, 2**63 - 1]
    texts = {i: f"text number {i} " * (k + 1) for k, i in enumerate(ids)}
    docs = spark.createDataFrame(list(texts.items()), "doc_id long, text string")
    links = op10_digest.next_ids(docs, Work(spark, "t"))
    order = sorted(ids)
    after = dict(zip(order, order[1:] + order[:1]))
    assert op10_digest.next_ids(docs.where("false"), Work(spark, "t")).count() == 0
    assert {r["doc_id"]: r["next_id"] for r in links.collect()} == after
    for r in op10_digest.edited(docs, links).collect():
        t, k = texts[r["doc_id"]], len(texts[r["doc_id"]]) // 4
        assert r["edited"] == t[: len(t) - k] + texts[after[r["doc_id"]]][:k]
    assert hashlib.sha256(b"").hexdigest() == op7_suffix.sha256(b"")


def test_fingerprint_query_tells_rows_of_one_id_apart(spark, monkeypatch):
    rows = [(1, "alpha beta gamma delta"), (1, "alpha beta gamma delta"), (1, "x" * 90), (2, "short one"), (2, "a far longer text of the second id"), (2, "short one"), (7, "ALPHA beta gamma delta"), (None, "x" * 90), (None, None), (None, "")]
    docs = spark.createDataFrame(rows, "doc_id long, text string")
    key = {(r["doc_id"], r["t"]): r["k"] for r in docs.select("doc_id", F.coalesce("text", F.lit("")).alias("t")).select("doc_id", "t", op10_digest.row_key("doc_id", "t").alias("k")).collect()}
    first = {i: min((t for d, t in key if d == i), key=lambda t: key[(i, t)]) for i in (1, 2, 7)}
    after = {1: 2, 2: 7, 7: 1}
    canon = lambda t: " ".join((t or "").lower().split())
    edit = lambda i, t: t[: len(t) - len(t) // 4] + first[after[i]][: len(t) // 4]
    real = op10_digest.hashes
    for hashes in (real, lambda text: [(F.length(text) % 2).cast("long").alias("h1"), F.lit(0).cast("long").alias("h2")]):
        monkeypatch.setattr(op10_digest, "hashes", hashes)
        got = queries._op10(docs, Work(spark, "t")).collect()
        shown = lambda i, t: (i, len(t), None if i is None else hashlib.sha256(edit(i, t).encode()).hexdigest())
        assert Counter((r["doc_id"], r["n_chars"], r["edited_sha256"]) for r in got) == Counter(shown(i, t or "") for i, t in rows)
        name = {}
        for i, t in rows:
            for r in got:
                if (r["doc_id"], r["n_chars"], r["edited_sha256"]) == shown(i, t or ""):
                    assert name.setdefault(canon(t), r["fingerprint"]) == r["fingerprint"]
                    if i is None:
                        assert r["edited_fingerprint"] is None and r["near_edited"] is None and r["near_next"] is None
                    else:
                        assert name.setdefault(canon(edit(i, t)), r["edited_fingerprint"]) == r["edited_fingerprint"]
                        assert r["near_next"] == float(canon(t) == canon(first[after[i]]))
        assert len(set(name.values())) == len(name)
        pairs = op10_digest.fingerprints(docs, "doc_id", "text").collect()
        assert Counter((r["doc_id"], r["fingerprint"]) for r in pairs) == Counter((i, name[canon(t)]) for i, t in rows) or hashes is not real
        assert len(pairs) == len(rows) and len({r["fingerprint"] for r in pairs}) == len({canon(t) for _, t in rows})
