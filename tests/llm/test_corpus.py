"""The corpus operators against brute force on small tables, and on odd inputs."""

import collections
import dataclasses
import functools
import hashlib
import math
import random
import re
import zlib

import numpy as np
import pyarrow as pa
import pytest
from pyspark.sql import functions as F

from tessella.llm import decontaminate, language, licenses, lines, mixing, near, pages, perplexity, scoring, substrings

SCHEMA = "doc_id long, text string, lang string, source string, n_chars long"
EN = "the of and to in that is was for on are with as this from have".split()
FR = "le la les une des et en du que qui dans est pour sur pas avec".split()
ODD = [
    (1, None, "en", "a", 0), (2, "", "en", None, 0), (3, "   \n \t ", None, "a", 6), (4, "éç 漢字 \U0001f600", "fr", "b", 6), (5, "word " * 3000, "en", "a", 15000),
    (None, "the of and", "en", "a", 10), (6, "x", "en", "b", 1), (6, "x", "en", "b", 1), (7, "###### $$$ %%%", "en", None, 14),
]


def texts(n, seed=1, words=120):
    rng = random.Random(seed)
    stem = lambda base: rng.choice(base) if rng.random() < 0.5 else "".join(rng.choices(base, k=2))
    return [" ".join(stem(FR if i % 3 == 0 else EN) for _ in range(words)) for i in range(n)]


def frame(spark, rows):
    return spark.createDataFrame(rows, SCHEMA).repartition(3)


@pytest.fixture(scope="module")
def corpus(spark):
    base = texts(40)
    w = base[0].split()
    rows = [(i, t, "fr" if i % 3 == 0 else "en", f"s{i % 4}", len(t)) for i, t in enumerate(base)]
    rows += [(100, base[1], "en", "s0", 1), (101, base[2].replace(base[2].split()[60], "changed", 1), "en", "s1", 1), (102, " ".join(["new"] * 3 + w[10:90] + texts(1, 9)[0].split()), "en", "s2", 1)]
    rows += [(103, "\n".join(["one two", "three four", "five six", "seven eight"]), "en", "s3", 1), (104, "\n".join(["zero", "one two", "three four", "five six", "other"]), "en", "s3", 1)]
    return frame(spark, rows).cache()


def words(t):
    return re.findall(r"[^\x20\x09-\x0D]+", t or "")


def test_base_features_and_perplexity(spark, corpus):
    got = {r.doc_id: r for r in perplexity.quality_rules(corpus).collect()}
    for r in corpus.collect():
        w = words(r.text)
        tri = collections.Counter(zip(w, w[1:], w[2:], strict=False))
        covered = {i + k for i in range(len(w) - 2) if tri[tuple(w[i : i + 3])] > 1 for k in range(3)}
        x = got[r.doc_id]
        filled = [y for y in r.text.split("\n") if words(y)]
        assert (x.n_words, x.word_chars, x.n_repeat_words) == (len(w), sum(map(len, w)), len(covered))
        assert (x.n_symbols, x.n_dup_lines) == (sum(r.text.count(c) for c in "#*$%&|<>"), len(filled) - len(set(filled)))
        assert x.base_failed == (len(w) < 50 or 100 * len(covered) > 50 * len(w)) and not (x.kept and x.base_failed)
    assert got[5].kept


def kneser_ney_by_brute_force(docs, order=4):
    """p(gram's last character | those in front), unpruned and interpolated, straight from the definition."""
    pad = lambda t: [0] * (order - 1) + [int(x) for x in perplexity.codes(t)]
    level = collections.Counter(tuple(c[i : i + order]) for c in map(pad, docs) for i in range(len(c) - order + 1))
    levels = [level]
    for _ in range(order - 1):
        level = collections.Counter(g[1:] for g in level)
        levels.insert(0, level)

    def p(gram):
        if not gram:
            return 1 / perplexity.ALPHABET
        level = levels[len(gram) - 1]
        d = perplexity._discounts(collections.Counter(n for n in level.values() if n <= 4))
        after = {g: n for g, n in level.items() if g[:-1] == gram[:-1]}
        total = sum(after.values())
        if not total:
            return p(gram[1:])
        n = level[gram]
        return (n - d[min(n, 3)]) / total + sum(d[min(x, 3)] for x in after.values()) / total * p(gram[1:])

    return p


def test_kneser_ney_against_brute_force(spark):
    docs = [*texts(4, words=12), "ALL IN CAPITALS", "| a | table |\n|---|---|", "漢字#漢字 😀", "7 and 8"]
    rows = [(i, t, "en", "s", 1) for i, t in enumerate(docs)]
    model = perplexity.fit(frame(spark, rows))["en"]
    p = kneser_ney_by_brute_force(docs)
    for t in [docs[0][:30], docs[4], docs[6], "never seen Ж"]:
        want = [math.log10(p(tuple(([0] * 3 + [int(x) for x in perplexity.codes(t)])[i : i + 4]))) for i in range(len(t))]
        assert np.allclose(model.score(perplexity.grams(t)), want, atol=1e-4)
        assert math.isclose(perplexity.mean_scores(model, ["x y", t])[1], np.mean(want), abs_tol=1e-4)


def test_rare_ngrams_count_in_every_perplexity(spark):
    docs = [*texts(4, words=60), "a b " * 200_000, "漢字#漢字 😀", "ü" * 60, "once Ж"]  # so long that an n-gram seen once has less than 1/HOT of all
    rows = frame(spark, [(i, t, "en", "s", 1) for i, t in enumerate(docs)])
    p = functools.cache(kneser_ney_by_brute_force(docs))
    got = [{r.doc_id: r.perplexity for r in perplexity.quality_rules(rows, **x).collect()} for x in ({}, {"hot": 60}, {"hot": 1})]
    assert got[0] == got[1] == got[2]  # broadcast or joined
    for i, t in enumerate(docs):
        c = [0] * 3 + [int(x) for x in perplexity.codes(t)]
        assert math.isclose(math.log10(got[0][i]), -np.mean([math.log10(p(tuple(c[k : k + 4]))) for k in range(len(t))]), abs_tol=1e-6)


def test_pruned_model_still_sums_to_one(spark):
    docs = frame(spark, [(i, t, "en", "s", 1) for i, t in enumerate(texts(6))])
    whole, pruned = perplexity.fit(docs)["en"], perplexity.fit(docs, hot=60)["en"]
    assert len(pruned.levels[-1][0]) <= 60 < len(whole.levels[-1][0])
    for head in np.unique(perplexity.grams(texts(1)[0]) >> np.uint64(16))[:12]:
        after = (head << np.uint64(16)) | np.arange(1 << 16, dtype=np.uint64)
        assert abs((10 ** pruned.score(after).astype(float)).sum() - 1) < 1e-3
        assert abs((10 ** whole.score(after).astype(float)).sum() - 1) < 1e-3


def test_bands_by_brute_force(spark, corpus):
    rows = perplexity.quality_rules(corpus).collect()
    for lang in {r.lang for r in rows}:
        own = sorted(math.log10(r.perplexity) for r in rows if r.lang == lang and not r.base_failed)
        q1, q3 = own[math.ceil(len(own) / 4) - 1], own[math.ceil(3 * len(own) / 4) - 1]
        width = 4 * max(q3 - q1, 5 * perplexity.BIN)
        for r in rows:
            if r.lang == lang:
                assert abs(math.log10(r.lowest) - (q1 - width)) < 0.03 and abs(math.log10(r.highest) - (q3 + width)) < 0.03
                assert r.kept == (not r.base_failed and r.lowest <= r.perplexity <= r.highest)


def test_lm_score(spark, corpus):
    got = {r.doc_id: r for r in scoring.lm_score(corpus).collect()}
    tokens = {r.doc_id: [*words(r.text.translate({c: c + 32 for c in range(65, 91)})), None] for r in corpus.collect()}
    count = collections.Counter(t for i, ts in tokens.items() if zlib.crc32(str(i).encode()) % 5 != 1 for t in ts)
    n, v = sum(count.values()), len(count)
    for i, ts in tokens.items():
        x = got[i]
        assert math.isclose(x.base_score, sum(math.log10((count[t] + 0.5) / (n + 0.5 * (v + 1))) for t in ts), rel_tol=1e-9)
        assert (x.n_tokens, x.n_known, x.train_tokens) == (len(ts), sum(count[t] > 0 for t in ts), n) and x.score < 0


def test_lm_trains_on_whole_texts_and_the_same_on_every_run(spark):
    docs = frame(spark, [(i, t, "en", "s", 1) for i, t in enumerate([*texts(5), "long " * 9000])])
    assert scoring.sample(docs, 6) == sorted(r.text for r in docs.collect())
    many = spark.range(20_000).select(F.col("id").alias("doc_id"), F.lit("a copy").alias("text"))
    got = scoring.sample(many, 20_000)
    assert 1300 < len(got) < 1700 and got == scoring.sample(many.repartition(7), 20_000)


def test_lm_counts_every_document(spark, corpus, monkeypatch):
    whole = [r.text for r in corpus.select("text").collect()]
    brute = scoring.Counts((kind, *t.total()) for kind, t in list(scoring.counted([pa.record_batch({"text": pa.array(whole)})], scoring.VOCABULARY))[-5:])
    for held in (scoring.HELD, 64):  # sent on at once, or piece by piece
        monkeypatch.setattr(scoring, "HELD", held)
        stored = scoring.StoredCounts(scoring.count(corpus))
        for kind in range(5):
            assert stored.total(kind) == brute.total(kind)
            for to in (None, lambda keys, n: (keys % 7, n)):
                assert all(np.array_equal(a, b) for a, b in zip(stored.of(kind, to, 2), brute.of(kind, to, 2), strict=True))
    words_ = collections.Counter(w for t in whole for w in words(t.lower()))
    assert sorted(brute.of(scoring.WORDS)[1]) == sorted(words_.values())
    sub = scoring.Subwords(scoring.VOCABULARY)
    ids = [[i for w in t.lower().split() for i in sub.encoding.encode_ordinary(" " + w)] for t in whole]
    pairs = collections.Counter(p for x in ids for p in zip([sub.end, *x], [*x, sub.end], strict=True))
    keys, n = brute.of(scoring.NEXT)
    assert {(k // (sub.end + 1), k % (sub.end + 1)): c for k, c in zip(keys.tolist(), n.tolist(), strict=True)} == pairs


def test_new_words_are_encoded_as_one_text_and_counted_once(monkeypatch):
    real, calls = scoring.Subwords, []

    class Counting:
        def encode_ordinary(self, text):
            calls.append(text)
            return real(scoring.VOCABULARY).encoding._core_bpe.encode_ordinary(text)

    def counting(path, within=None, limit=400_000):
        sub = real(path, within, limit)
        sub.encoding = type("Encoding", (), {"_core_bpe": Counting()})
        return sub

    alone = ["b\x1c", "d\x85", "e\xa0", "\u3000", "f\u2009", "\u2028", "“x”"]  # may end in white space that PATTERN knows
    docs = [*texts(20), "it's 12 1234567 ### a,b é 漢字 \U0001f600 \x00 x\xa0y " + "long" * 900, " x ".join([*alone, "x"]), "", " \n", None]
    one = real(scoring.VOCABULARY).encoding._core_bpe.encode_ordinary
    tokens = [[one(" " + x) for x in words(t)] for t in [(t or "").lower() for t in docs]]
    ids = [[i for word in text for i in word] for text in tokens]
    sub = counting(scoring.VOCABULARY)
    w = scoring.Words(docs, lower=True)
    got, n, of_word, _ = sub.stream(w, w.hashes())
    assert got.tolist() == [i for text in ids for i in [*text, sub.end]] and n.tolist() == [len(text) + 1 for text in ids]
    assert of_word.tolist() == [k for text in tokens for k in [*map(len, text), 1]]
    assert len(calls) == 1 + len([*alone, "\x00"])
    w = scoring.Words(["x \ud800 y"], lower=True)  # not UTF-8
    got = counting(scoring.VOCABULARY).stream(w, w.hashes())[0]
    assert got.tolist() == [*one(" x"), *one(" " + "\ufffd" * 3), *one(" y"), sub.end]
    for limit in (5, 400_000):  # words are dropped after each batch, or never
        monkeypatch.setattr(scoring, "Subwords", lambda path, within=None: counting(path, within, limit))
        calls.clear()
        batches = pa.table({"text": docs * 3}).to_batches(max_chunksize=10)
        counts = scoring.Counts((kind, *t.total()) for kind, t in list(scoring.counted(batches, scoring.VOCABULARY))[-5:])
        keys, c = counts.of(scoring.RUN2)
        runs = collections.Counter(p for text in tokens for word in text for p in zip(word, word[1:], strict=False))
        wide = sub.end + 1
        assert {(k // wide - 1, k % wide): i for k, i in zip(keys.tolist(), c.tolist(), strict=True)} == {k: 3 * i for k, i in runs.items()}
        assert counts.of(scoring.IDS)[1].sum() == 3 * sum(len(text) + 1 for text in ids)


def test_within_adds_up_to_one_with_runs_left_out(monkeypatch):
    _, whole = scoring.train(texts(30), steps=1)
    seen = whole.levels[0][0] // len(whole.group) - 1  # ids that others follow
    for kept in (scoring.KEPT, 400):
        monkeypatch.setattr(scoring, "KEPT", kept)
        _, within = scoring.train(texts(30), steps=1)
        for before in ([seen[0]], [seen[-1], seen[0]], []):
            for c in (0, 5):
                own = np.flatnonzero(within.group == c)
                ids = np.hstack([np.tile(before, (len(own), 1)), own[:, None]]).astype(np.int32)
                p = np.exp(within.logp(ids.ravel(), np.full(len(own), ids.shape[1])).reshape(ids.shape)[:, -1].astype(float))
                assert math.isclose(p.sum(), 1, rel_tol=1e-3)


def test_every_partition_trains_the_layer(spark, monkeypatch):
    monkeypatch.setattr(scoring, "TRAIN_SHARE", 1)
    monkeypatch.setattr(scoring, "TRAIN_RATE", 0.01)
    start, _ = scoring.train(texts(5), steps=5)
    rows = [(i, t, "en", "s", 1) for i, t in enumerate(texts(30))]
    parts = [rows[:3], rows[3:10], rows[10:]]
    spread = lambda parts: spark.createDataFrame(spark.sparkContext.parallelize(parts, len(parts)).flatMap(list), SCHEMA)
    docs = spread(parts)
    got = scoring.trained_on(docs, start)
    alone = [scoring.trained_on(spread([part]), start) for part in parts]
    encode = scoring.Subwords(scoring.VOCABULARY).encoding.encode_ordinary
    weigh = [sum(-(-(len(encode(" " + r[1])) + 1) // scoring.BLOCK) for r in part) for part in parts]
    for name in scoring.Descent.names:
        assert np.allclose(getattr(got, name), np.average([getattr(m, name) for m in alone], axis=0, weights=weigh), atol=1e-4), name
    w = scoring.Words(texts(10, 8), lower=True)
    ids, sizes, _, logp = scoring.Subwords(scoring.VOCABULARY).stream(w, w.hashes())
    zero = np.zeros(len(ids), np.float32)
    assert got.score(ids, sizes, zero).sum() > start.score(ids, sizes, zero).sum()
    assert scoring.trained_on(docs.limit(0), start) is start


def test_every_training_document_trains_the_layer(spark):
    start, _ = scoring.train(texts(5), steps=5)
    docs = texts(40, 3)
    got = scoring.trained_on(spark.createDataFrame([(i, t, "en", "s", 1) for i, t in enumerate([*docs, None])], SCHEMA).coalesce(1), start)
    want = dataclasses.replace(start, **{name: getattr(start, name).copy() for name in scoring.Descent.names})
    w = scoring.Words(docs, lower=True)
    x, t, fresh = scoring._blocks(want, *scoring.Subwords(scoring.VOCABULARY).stream(w, w.hashes())[:2])
    descent = scoring.Descent(want)
    for i in range(0, len(x), scoring.TRAIN_STEP):
        at = slice(i, i + scoring.TRAIN_STEP)
        descent.on(x[at], t[at], fresh[at], scoring.TRAIN_RATE)
    assert len(x) > scoring.TRAIN_STEP
    for name in scoring.Descent.names:
        assert np.allclose(getattr(got, name), getattr(want, name), atol=1e-5), name


def test_gradient_by_differences():
    m, _ = scoring.train(texts(5), steps=5)
    w = scoring.Words(texts(3, 5), lower=True)
    x, t, fresh = scoring._blocks(m, *scoring.Subwords(scoring.VOCABULARY).stream(w, w.hashes())[:2])

    def loss():
        _, _, _, _, o = m.attend(x, fresh)
        z = m.last[x].astype(float) + o @ m.out
        return np.mean((np.log(np.exp(z).sum(-1)) - np.take_along_axis(z, np.maximum(t, 0)[..., None], -1)[..., 0])[t >= 0])

    descent = scoring.Descent(m)
    for value, g in zip(descent.values, descent.gradient(x, t, fresh), strict=True):
        top = np.unravel_index(np.argsort(-abs(g), axis=None)[:40:5], g.shape)
        for at in zip(*top, strict=True):
            old, sides = value[at], []
            for side in (0.02, -0.02):
                value[at] = old + side
                sides.append(loss())
            value[at] = old
            assert math.isclose((sides[0] - sides[1]) / 0.04, g[at], rel_tol=0.02, abs_tol=2e-5)


def test_a_remembered_word_is_looked_up_once_among_the_frequent(monkeypatch):
    docs = [*texts(20), "x " * 30, "", None]
    w = scoring.Words(docs, lower=True)
    h = scoring.signed(w.hashes())
    for hot in (np.unique(h)[::3], np.unique(h), h[:0]):
        for limit in (5, 400_000):  # words are dropped before each call, or never
            sub, looked = scoring.Subwords(scoring.VOCABULARY, limit=limit, hot=hot), []
            places = scoring._places
            monkeypatch.setattr(scoring, "_places", lambda keys, values: looked.append(len(values)) or places(keys, values))
            for _ in range(2):
                at = sub.of(w, w.hashes())
                place = sub.place[at]
                assert (place >= 0).tolist() == np.isin(h, hot).tolist() and (hot[place[place >= 0]] == h[place >= 0]).all()
            monkeypatch.undo()
            assert sum(looked) == len(np.unique(h)) * (2 if limit == 5 else 1)
    at = sub.of(w, w.hashes())
    assert all((x == y).all() for x, y in zip(sub.stream(w, w.hashes()), sub.stream(w, w.hashes(), at), strict=True))


def test_sums_by_symbol_in_groups_of_any_size():
    rng = np.random.default_rng(3)
    sizes = {0: 1, 5: scoring.GROUP - 1, 6: scoring.GROUP, 7: scoring.GROUP + 1, 900: 5 * scoring.GROUP, scoring.SYMBOLS - 1: 40}
    for own in (sizes, {3: 1}, {3: 2 * scoring.GROUP}):
        flat = rng.permutation(np.repeat(list(own), list(own.values())))
        parts = [rng.normal(size=(len(flat), width)).astype(np.float32) for width in (48, 12)]
        for x, got in zip(parts, scoring.Descent._sums(flat, *parts), strict=True):
            want = np.zeros((scoring.SYMBOLS, x.shape[1]))
            np.add.at(want, flat, x)
            assert np.allclose(got, want, atol=1e-5)


def test_attention_scores_each_token_once_as_by_hand():
    model, within = scoring.train(texts(20), steps=20)
    sub = scoring.Subwords(scoring.VOCABULARY, within)
    w = scoring.Words(texts(3, 5, 30), lower=True)
    ids, sizes, _, logp = sub.stream(w, w.hashes())
    got = model.score(ids, sizes, logp)
    (q, kv), _ = model.ready()
    x = [scoring.SYMBOLS - 1, *model.symbol[ids[: sizes[0] - 1]]]
    total = 0.0
    for t in range(sizes[0]):
        js = range(max(0, (t // scoring.BLOCK - 1) * scoring.BLOCK), t + 1)
        e = np.array([np.exp(q[x[t]] @ kv[x[j], : scoring.WIDTH] + model.near[t - j]) for j in js])
        o = sum(a * kv[x[j], scoring.WIDTH : 2 * scoring.WIDTH] for a, j in zip(e / e.sum(), js, strict=True))
        z = model.last[x[t]] + o @ model.out
        total += z[model.group[ids[t]]] - np.log(np.exp(z).sum()) + logp[t]
    assert math.isclose(got[0], total / math.log(10), rel_tol=1e-4)


def test_mixing_agrees_with_sql(spark, corpus, tmp_path):
    import duckdb

    corpus.coalesce(1).write.parquet(str(tmp_path / "d"))
    con = duckdb.connect()
    con.execute(f"CREATE VIEW documents AS SELECT * FROM '{next((tmp_path / 'd').glob('*.parquet'))}'")
    want = sorted(con.execute(mixing.SQL).fetchall(), key=str)
    assert sorted((tuple(r) for r in mixing.mix(corpus).collect()), key=str) == want
    assert sorted((tuple(r) for r in mixing.mix(corpus.repartition(7)).collect()), key=str) == want


def test_language_on_held_out(spark, corpus):
    got = {r.doc_id: r for r in language.identify(corpus.filter("doc_id < 40")).collect()}
    assert all(got[i].lang_pred == ("fr" if i % 3 == 0 else "en") for i in range(40))
    mixed = frame(spark, [(i, t, "fr" if i % 3 == 0 else "en", "s", 1) for i, t in enumerate(texts(40))] + [(2000, texts(1, 3, 200)[0] + " " + texts(2, 4, 200)[1], None, "s", 1)])
    assert sorted(next(r for r in language.identify(mixed).collect() if r.doc_id == 2000).langs) == ["en", "fr"]


def test_mixture_against_brute_force():
    rng = np.random.default_rng(5)
    names = [f"l{i}" for i in range(7)]
    p = rng.dirichlet(np.full(language.BUCKETS, 0.002), 7).T.astype(np.float32) + np.float32(1e-8)
    model = language.Mixture(names, p)
    docs = [[1.0], [0.5, 0.5], [0.4, 0.12, 0.12, 0.12, 0.12, 0.12], [0.7, 0.3]]
    rows = []
    for d, weights in enumerate(docs):
        mixed = (p[:, : len(weights)] * weights).sum(1)
        got = np.unique(rng.choice(language.BUCKETS, 4000, p=mixed / mixed.sum()), return_counts=True)
        rows += [(d, b, c) for b, c in zip(*got, strict=True)]
    doc, bucket, count = map(np.array, zip(*rows, strict=True))
    _, share = model.predict(language.Features(doc, bucket, count, np.ones(4, bool)), 4)

    def em(like, n, s, steps=400):
        for _ in range(steps):
            r = like * s
            s = (n[:, None] * r / r.sum(1, keepdims=True)).sum(0) / n.sum()
        return s

    for d, weights in enumerate(docs):
        own = doc == d
        like, n = p[bucket[own]].astype(float), count[own]
        order = np.argsort(-em(like, n, np.full(7, 1 / 7)))
        values = []
        for k in range(1, 8):
            s = np.zeros(7)
            s[order[:k]] = 1 / k
            s = em(like, n, s)
            values.append(((n * np.log((like * s).sum(1))).sum() - 6 * (k - 1) * np.log(n.sum() + 1), s))
        want = max(values, key=lambda x: x[0])[1]
        assert (share[d] > 0.01).sum() == len(weights) and np.abs(share[d] - want).max() < 0.06
    alone = doc == 2
    assert np.array_equal(model.predict(language.Features(doc[alone] * 0, bucket[alone], count[alone], np.ones(1, bool)), 1)[1][0], share[2])


def test_near_duplicates(spark, corpus):
    got = {r.doc_id: r.class_id for r in near.classes(corpus).collect()}
    assert got[100] == 1 and got[101] == 2 and got[102] == 102
    assert all(got[i] == i for i in range(40))


def test_near_duplicates_that_share_a_template(spark):
    rng = random.Random(8)
    new = lambda n: [f"w{rng.randrange(10**9)}" for _ in range(n)]
    template = new(304)
    own = [new(35) for _ in range(120)]
    docs = [template + x for x in own] + [template + x[:9] + new(26) for x in own[60:]]  # 0.78 with a foreign one, 0.83 with the own
    rows = [(i, " ".join(t), "en", "s", 1) for i, t in enumerate(docs)]
    weights = near.learn(frame(spark, rows))
    sets = [near.shingles([r[1]], weights)[1:] for r in rows]
    keys = [set(near.band_keys(np.zeros(len(h), np.int64), h, w, 1)[0]) for h, w in sets]
    want = {(a, b) for b in range(len(rows)) for a in range(b) if keys[a] & keys[b] and near.similarity(sets[a], sets[b]) >= 0.8}
    assert len(want) >= 55 and all(b == a + 60 for a, b in want)
    got = {r.doc_id: r.class_id for r in near.classes(frame(spark, rows)).collect()}
    missed = [(a, b) for a, b in want if got[b] != a]
    assert not missed and all(got[i] == i for i in range(120))


def test_components_against_brute_force(spark):
    rng = random.Random(6)
    edges = [(rng.randrange(60), rng.randrange(60, 160)) for _ in range(90)] + [(i, i + 1) for i in range(200, 240)]
    of = {x: x for e in edges for x in e}
    for _ in of:
        for a, b in edges:
            of[a] = of[b] = min(of[a], of[b])
    got = {r.node: r.label for r in near.components(spark.createDataFrame(edges, "a long, b long")).collect()}
    assert set(got) == set(of) and len({(got[x], of[x]) for x in of}) == len(set(got.values())) == len(set(of.values()))


def test_classes_lose_no_link_of_a_large_group(spark):
    rng = random.Random(12)
    base = [f"w{rng.randrange(10**9)}" for _ in range(150)]
    rows = []
    for i in range(160):
        t = list(base)
        for _ in range(rng.randrange(1, 7)):
            t[rng.randrange(150)] = f"x{rng.randrange(40) if i % 4 else rng.randrange(10**9)}"
        rows.append((i, " ".join(t), "en", "s", 1))
    weights = near.learn(frame(spark, rows))
    sets = [near.shingles([r[1]], weights)[1:] for r in rows]
    keys = [set(near.band_keys(np.zeros(len(h), np.int64), h, w, 1)[0]) for h, w in sets]
    near_pairs = [(a, b) for b in range(len(rows)) for a in range(b) if near.similarity(sets[a], sets[b]) >= 0.8]
    met = [(a, b) for a, b in near_pairs if keys[a] & keys[b]]
    assert len(near_pairs) > 500 and len(met) >= 0.98 * len(near_pairs)
    of = list(range(len(rows)))
    for _ in range(20):
        for a, b in met:
            of[a] = of[b] = min(of[a], of[b])
    assert {r.doc_id: r.class_id for r in near.classes(frame(spark, rows)).collect()} == dict(enumerate(of)) and len(set(of)) > 5


@pytest.mark.parametrize(("shared", "tf", "own", "both"), [(5, 400, 250, 0), (10, 400, 250, 0), (20, 300, 250, 0), (0, 1, 20, 180), (1, 1, 0, 0), (1, 3000, 300, 0)])
def test_samples_agree_with_probability_of_the_similarity(shared, tf, own, both):
    rng = np.random.default_rng(shared + tf)
    agree, banded, n = [], [], 60
    for _ in range(n):
        common = np.r_[np.full(shared, tf * 1.1), rng.uniform(1, 1.2, both)]
        head = rng.integers(1, 1 << 63, len(common), np.uint64)
        sets = [(np.r_[head, rng.integers(1, 1 << 63, own, np.uint64)], np.r_[common, rng.uniform(1, 1.2, own)]) for _ in range(2)]
        total = sum(s[1].sum() for s in sets) - common.sum()
        doc, h, w = np.repeat([0, 1], len(sets[0][0])), np.r_[sets[0][0], sets[1][0]], np.r_[sets[0][1], sets[1][1]]
        keys = near.band_keys(doc, h, w, 2)
        assert len(keys[0]) == len(keys[1]) == near.BANDS
        banded.append(bool(set(keys[0]) & set(keys[1])))
        a, b = near.samples(doc, h, w, 2)
        agree.append((a == b).mean() - common.sum() / total)
    assert np.mean(banded) > 0.95 and abs(np.mean(agree)) < 0.04


def test_decontamination(spark, corpus):
    t = corpus.filter("doc_id = 5").first().text.split()
    bench = spark.createDataFrame([(1, " ".join(t[40:60] + t[10:30])), (2, " ".join(texts(1, 77, 20))), (3, None), (4, "short")], "item_id long, text string")
    got = decontaminate.report(corpus, bench).collect()
    assert [(r.doc_id, r.item_id, r.n_tiles, r.coverage) for r in got] == [(5, 1, 2, 1.0)]
    kept = decontaminate.clean(corpus, bench)
    assert kept.columns == corpus.columns and kept.count() == corpus.count() - 1


def tiles_by_brute_force(a, b, k):
    """Covered tokens of b: the longest match of unmarked tokens is marked again and again."""
    free_a, free_b, sizes = [True] * len(a), [True] * len(b), []
    while True:
        best = (0, 0, 0)
        for y in range(len(b)):
            for x in range(len(a)):
                n = 0
                while x + n < len(a) and y + n < len(b) and a[x + n] == b[y + n] and free_a[x + n] and free_b[y + n]:
                    n += 1
                best = max(best, (n, -y, -x))
        n, y, x = best[0], -best[1], -best[2]
        if n < k:
            return sizes
        sizes.append((x, y, n))
        for i in range(n):
            free_a[x + i] = free_b[y + i] = False


@pytest.mark.parametrize("kinds", [2, 3, 6])
def test_tiling_against_brute_force(kinds):
    rng = np.random.default_rng(kinds)
    for _ in range(40):
        a, b = (rng.integers(1, kinds + 1, rng.integers(0, 40)).astype(np.uint64) for _ in range(2))
        assert decontaminate.tile(a, b, 3) == tiles_by_brute_force(a.tolist(), b.tolist(), 3)


def test_decontamination_of_repetitive_text(spark):
    docs = frame(spark, [(1, "the " * 400_000, "en", "s", 1), (2, None, "en", "s", 1), (3, "a b c d e f", "en", "s", 1), (3, "", "en", "s", 1)])
    bench = spark.createDataFrame([(1, "the " * 400), (2, "d e f a b c"), (3, "")], "item_id long, text string")
    assert [(r.doc_id, r.item_id, r.coverage, r.n_tiles) for r in decontaminate.report(docs, bench).collect()] == [(1, 1, 1.0, 1)]
    odd = docs.withColumnRenamed("n_chars", "item_id")
    assert sorted(r.doc_id for r in decontaminate.clean(odd, bench).collect()) == [2, 3, 3]
    assert decontaminate.report(docs.limit(0), bench).count() == decontaminate.report(docs, bench.limit(0)).count() == 0


def test_decontamination_in_blocks(spark, corpus, monkeypatch):
    t = corpus.filter("doc_id = 5").first().text.split()
    bench = spark.createDataFrame([(i, " ".join(t[i : i + 20])) for i in range(0, 60, 10)], "item_id long, text string")
    want = sorted(map(tuple, decontaminate.report(corpus, bench).select("doc_id", "item_id", "coverage").collect()))
    monkeypatch.setattr(decontaminate, "BLOCK_BYTES", 300)
    assert sorted(map(tuple, decontaminate.report(corpus, bench).select("doc_id", "item_id", "coverage").collect())) == want and len(want) == 6
    assert decontaminate.clean(corpus, bench).count() == corpus.count() - 1


def test_substrings_against_brute_force(spark, corpus):
    docs = {r.doc_id: r.text.encode().split() for r in corpus.collect()}
    first: dict = {}
    for i in sorted(docs):
        for s in range(len(docs[i]) - 49):
            first.setdefault(tuple(docs[i][s : s + 50]), i)
    want = {}
    for i, w in docs.items():
        gone = {s + k for s in range(len(w) - 49) if first[tuple(w[s : s + 50])] < i for k in range(50)}
        want[i] = (len(w), len(gone), hashlib.sha256(b" ".join(x for k, x in enumerate(w) if k not in gone)).hexdigest())
    for options in ({}, {"most": 1}, {"shard_words": 500}):
        assert {r.doc_id: (r.n_words, r.n_removed, r.kept_sha256) for r in substrings.dedup(corpus, **options).collect()} == want
    assert want[102][1] == 80


def test_substrings_of_shared_heads(spark):
    rng = random.Random(5)
    fresh = lambda n: " ".join(f"w{rng.randrange(10**9)}" for _ in range(n))
    rows, want = [], {}
    for k, n in enumerate(range(48, 90)):
        head, rest = fresh(n), [fresh(100), fresh(100)]
        rows += [(2 * k + j, f"{head} {x}") for j, x in enumerate(rest)]
        gone = n if n >= 50 else 0
        want[2 * k] = (n + 100, 0, hashlib.sha256(rows[-2][1].encode()).hexdigest())
        want[2 * k + 1] = (n + 100, gone, hashlib.sha256((rest[1] if gone else rows[-1][1]).encode()).hexdigest())
    docs = spark.createDataFrame(rows, "doc_id long, text string")
    for options in ({}, {"most": 1}):
        assert {r.doc_id: (r.n_words, r.n_removed, r.kept_sha256) for r in substrings.dedup(docs, **options).collect()} == want


def test_lines(spark, corpus):
    got = {r.doc_id: r for r in lines.dedup_lines(corpus).collect()}
    assert got[104].text == "zero\nother" and got[104].n_removed == 3 and got[103].n_removed == 0
    assert lines.delete_runs("a\n\na\nb", {1}) == "a\n\nb"
    loop = frame(spark, [(1, "\n".join(["again"] * 6), "en", "s", 1)])
    assert lines.dedup_lines(loop).first().text == "again"


def test_lines_whose_pairs_were_seen_apart(spark):
    rng = random.Random(3)
    rows, n = [], 0
    for _ in range(30):
        a, b, c, d, *odd = [f"line {rng.randrange(10**9)}" for _ in range(10)]
        for own in ([a, b, odd[0]], [odd[1], b, c, odd[2]], [odd[3], c, d, odd[4]], [a, b, c, d], [a, b, c, d]):
            rows.append((n, "\n".join(own), "en", "s", 1))
            n += 1
    got = {r.doc_id: r.n_removed for r in lines.dedup_lines(frame(spark, rows)).collect()}
    assert all(got[i] == (4 if i % 5 == 4 else 0) for i in got)


def lines_by_brute_force(rows, m=3):
    """Numbers of the filled lines that go, by document."""
    first, out = {}, {}
    for i, text in sorted(rows):
        filled = [x for x in text.split("\n") if x.split()]
        gone = set()
        for k in range(len(filled) - m + 1):
            if first.setdefault(tuple(filled[k : k + m]), (i, k)) != (i, k):
                gone |= set(range(k, k + m))
        out[i] = gone
    return out


@pytest.mark.parametrize(("kinds", "m"), [(4, 3), (12, 3), (6, 1), (8, 2), (7, 5)])
def test_lines_against_brute_force(spark, kinds, m):
    rng = random.Random(kinds)
    rows = [(i, "\n".join(rng.choice([f"line {rng.randrange(kinds)}", ""]) for _ in range(rng.randrange(40)))) for i in range(80)]
    want = lines_by_brute_force(rows, m)
    got = {r.doc_id: r for r in lines.dedup_lines(frame(spark, [(i, t, "en", "s", 1) for i, t in rows]), min_lines=m).collect()}
    for i, t in rows:
        assert got[i].n_removed == len(want[i]) and got[i].text == lines.delete_runs(t, want[i])


def test_lines_keep_clashing_columns(spark):
    docs = spark.createDataFrame([(1, "a\nb\nc\na\nb\nc", 7, 8, "x")], "doc_id long, text string, _doc_id long, _at long, _TEXT_HASH string")
    assert [tuple(r) for r in lines.dedup_lines(docs).collect()] == [(1, "a\nb\nc", 7, 8, "x", 3)]
    assert lines.dedup_lines(docs.withColumnRenamed("_at", "n_removed"), removed="gone").first()["n_removed"] == 8


def test_licenses_are_inherited(spark):
    files = spark.createDataFrame([(1, "r/LICENSE", "Released under the MIT License."), (2, "r/src/a.c", "int main() { return 0; }"), (3, "r/src/lib/b.c", "Licensed under the Apache License, Version 2.0\n" + "code " * 50), (4, "q/c.c", None)], "doc_id long, path string, text string")
    got = {r.doc_id: (r.license, r.via, r.licensed_by) for r in licenses.scan(files).collect()}
    assert got == {1: ("MIT", "own", None), 2: ("MIT", "inherited", "r"), 3: ("Apache-2.0", "own", None), 4: (None, None, None)}


def test_whole_license_files_are_inherited(spark):
    rows, want = [], {}
    for i, (name, text) in enumerate(licenses.WHOLE):
        rows += [(10 * i, f"p{i}/LICENSE", f"Copyright (c) 2020 Somebody of Somewhere\n\n{text}\n"), (10 * i + 1, f"p{i}/src/deep/a.py", "def a():\n    return 1")]
        want |= {10 * i: (name, "own"), 10 * i + 1: (name, "inherited")}
    rows += [(900, "q/a.c", "// SPDX-License-Identifier: ISC\n" + "x = y + z;\n" * 30), (901, "q/b.c", "nothing"), (902, None, None)]
    want |= {900: ("ISC", "own"), 901: (None, None), 902: (None, None)}
    got = {r.doc_id: (r.license, r.via) for r in licenses.scan(spark.createDataFrame(rows, "doc_id long, path string, text string")).collect()}
    assert got == want


PAGE = "<html><head><title>t</title></head><body><nav><a href=x>Home {i}</a></nav><div class='sidebar'>ad</div><article><h1>Title {i}</h1><p>One &amp; <b>two</b>\n {i}<br>three<p>Next {i}</article><div id=comments>nice</div><footer>f</footer></body></html>"


def test_pages(spark):
    rows = [(i, f"https://h.example/{i}", PAGE.replace("{i}", str(i))) for i in range(5)] + [(9, None, None), (10, "x", "<p>alone <p")]
    got = {r.page_id: r.text for r in pages.extract(spark.createDataFrame(rows, "page_id long, url string, html string")).collect()}
    assert got[3] == "Title 3\nOne & two 3 three\nNext 3" and got[9] == "" and got[10] == "alone"


def test_simple_tree_matching_is_order_keeping():
    a, b = pages.parse("<ul><li>1<li>2<li>3</ul>"), pages.parse("<ul><li>1<li>3</ul>")
    assert len(pages.match(a, b)) == 4


def matching_by_brute_force(x, y):
    """Weight of the largest order-keeping alignment."""
    if x.tag != y.tag or x.names != y.names:
        return 0
    table = [[0] * (len(y.children) + 1) for _ in range(len(x.children) + 1)]
    for i, u in enumerate(x.children):
        for j, v in enumerate(y.children):
            table[i + 1][j + 1] = max(table[i][j + 1], table[i + 1][j], table[i][j] + matching_by_brute_force(u, v))
    return 1 + table[-1][-1]


def test_matching_against_brute_force():
    rng = random.Random(4)

    def tree(depth):
        return "".join(f"<{t}>{tree(depth - 1)}</{t}>" for t in rng.choices(["div", "section", "span"], k=rng.randrange(4))) if depth else "x"

    for _ in range(150):
        a, b = pages.parse(tree(4)), pages.parse(tree(4))
        pairs = pages.match(a, b)
        assert len(pairs) == matching_by_brute_force(a, b) == len({x.at for x, _ in pairs}) == len({y.at for _, y in pairs})
        assert all(x.tag == y.tag for x, y in pairs)


def site(spark, bodies, host="h.example"):
    rows = [(i, f"https://{host}/{i}", f"<html><head><title>t</title></head>{body}</html>") for i, body in enumerate(bodies)]
    return {r.page_id: r.text for r in pages.extract(spark.createDataFrame(rows, "page_id long, url string, html string")).collect()}


def test_pages_with_sidebar_in_their_own_classes(spark):
    own = [f"Text {t}" for t in texts(6)]
    got = site(spark, [f'<body class="single has-sidebar"><nav>menu</nav><div class="container no-sidebar"><p>{t}</p><p>More {i}</p></div><div class="site-footer">end</div></body>' for i, t in enumerate(own)])
    assert got == {i: f"{t}\nMore {i}" for i, t in enumerate(own)}


def test_pages_keep_what_belongs_to_the_article_and_drop_its_template(spark):
    own = texts(6, 2, 40)
    body = '<body><article><div class="entry-header"><h1>Title {i}</h1></div><div class="box">Read our terms before you go on.</div><p>{t}</p><figure><img src=x><figcaption>Figure {i}</figcaption></figure><h2 id="related-work">Related {i}</h2><p class="legal">Law {i}</p><div class="ad">buy</div></article></body>'
    got = site(spark, [body.format(i=i, t=t) for i, t in enumerate(own)])
    assert got == {i: f"Title {i}\n{t}\nFigure {i}\nRelated {i}\nLaw {i}" for i, t in enumerate(own)}


def test_copies_of_one_article_are_no_template(spark):
    t = texts(1, 3)[0]
    got = site(spark, [f"<body><nav>menu {i}</nav><article><h1>Same</h1><p>{t}</p></article><footer>{i}</footer></body>" for i in range(6)])
    assert set(got.values()) == {f"Same\n{t}"}


def test_pages_of_any_depth_and_width(spark):
    deep = ["<body>" + "<div>" * 10_000 + f"deep {i}" for i in range(4)]
    wide = ["<body><main>" + "".join(f"<p>line {i} {k} {'<b>x</b>' * (k % 3 == i)}</p>" for k in range(3000)) + "</main></body>" for i in range(4)]
    got = site(spark, deep)
    assert got == {i: f"deep {i}" for i in range(4)}
    got = site(spark, wide)
    assert all(len(got[i].split("\n")) == 3000 for i in range(4))
    odd = spark.createDataFrame([(None, None, "<p>a</p>", 1), (1, "http://x/", None, 2), (1, "http://x/", None, 2), (2, "", "", 3)], "page_id long, url string, html string, host long")
    assert sorted(r.text for r in pages.extract(odd).collect()) == ["", "", "", "a"] and pages.extract(odd.limit(0)).count() == 0


ALL = [perplexity.quality_rules, scoring.lm_score, mixing.mix, language.identify, licenses.report, near.classes, substrings.report, lines.report]


@pytest.mark.parametrize("operator", ALL, ids=lambda f: f.__module__.split(".")[-1])
def test_odd_and_empty_tables(spark, operator):
    odd = frame(spark, ODD)
    assert operator(odd).count() == len(ODD)
    assert operator(odd.withColumnRenamed("n_chars", "keys")).count() == len(ODD)
    assert operator(odd.limit(0)).count() == 0


def test_stages_keep_columns(spark, corpus, tmp_path):
    import corpus_pipeline

    spark.createDataFrame([(1, "a b c")], "item_id long, text string").write.parquet(str(tmp_path / "benchmark.parquet"))
    corpus.write.parquet(str(tmp_path / "documents.parquet"))
    docs = corpus
    for name, stage in corpus_pipeline.STAGES[:-1]:
        docs = stage(spark, docs, str(tmp_path))
        assert docs.columns == corpus.columns, name
    ids = {r.doc_id for r in docs.collect()}
    assert 100 not in ids and 101 not in ids and set(range(40)) <= ids
    assert corpus_pipeline.run(spark, str(tmp_path)).count() > 0
