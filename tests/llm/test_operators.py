"""Each operator against plain Python on small tables with nulls, empties, ties and clashing names."""

import hashlib
import math
import random
import re
import zlib
from collections import Counter

import numpy as np
import pyarrow as pa
import pytest
from pyspark.sql import functions as F

from lumenmill.llm import ann, exact_dedup, html_extract, hpyp, language_id, mixing, near_dedup, quality, substring_dedup
from lumenmill.llm.common import prepare

CLASHES = ["id", "key", "n", "h", "norm", "root", "class_id", "bucket", "kept", "score", "held_out", "at", "_rate", "_dropped", "part"]
WS = re.compile(r"[\x20\x09-\x0D]+")


@pytest.fixture(autouse=True)
def _prepared(spark):
    prepare(spark)


def table(spark, rows):
    """doc_id, text, lang, source and columns whose names the operators use inside."""
    extra = tuple(f"x{i}" for i in range(len(CLASHES)))
    schema = "doc_id long, text string, lang string, source string, " + ", ".join(f"`{c}` string" for c in CLASHES)
    return spark.createDataFrame([(*r, *extra) for r in rows], schema)


def words(rng, n, vocabulary=300):
    return " ".join(f"w{rng.randrange(vocabulary)}" for _ in range(n))


def corpus(seed=1):
    rng = random.Random(seed)
    passage, hot = words(rng, 50), words(rng, 90)
    rows = [(i, words(rng, rng.randrange(1, 120)), "en", f"s{i % 3}") for i in range(30)]
    for i in range(30, 45):
        w = hot.split()
        for _ in range(2):
            w[rng.randrange(len(w))] = f"e{rng.randrange(10**6)}"
        rows.append((i, " ".join(w), "en", "hot"))
    rows += [(i, hot if i % 2 else hot.upper().replace(" ", "\t\n"), "en", "hot") for i in range(45, 60)]
    rows += [(i, words(rng, 20) + " " + passage + " " + words(rng, 20), "fr", None) for i in range(60, 66)]
    rows += [(70, "a " * 200, "en", "s0"), (71, "", "en", "s0"), (72, None, None, None), (73, " \n\t", "en", "s1"), (74, "one two", "en", "s1"), (75, "One  TWO", "en", "s1"), (76, "", "en", "s2")]
    rows += [(77, "x y " + words(rng, 6000, 10**6), "en", "s0")]
    return rows


def test_exact_dedup(spark):
    rows = [*corpus(), (None, "one two", None, None), corpus()[0]]
    groups: dict = {}
    for i, t, *_ in rows:
        groups.setdefault(WS.sub(" ", t or ""), []).append(i)
    want = []
    for i, t, *_ in rows:
        norm = WS.sub(" ", t or "")
        keep = min(x for x in groups[norm] if x is not None)
        want.append((i, keep, len(groups[norm]), i == keep, hashlib.sha256(norm.encode()).hexdigest()))
    for hot in (3, 64):  # the 15 copies by their owner, and combined beforehand
        got = exact_dedup.exact_dedup(table(spark, rows), capacity=8, hot=hot).collect()
        assert sorted(map(repr, want)) == sorted(repr(tuple(r)[:5]) for r in got)
    # hashes that collide: the chain tells texts apart, and the directory doubles down to single keys
    index = exact_dedup.build_index(table(spark, rows), capacity=2, hot=9, key=lambda c: F.length(c).cast("long")).collect()
    assert sorted((repr(r.id), r.keep_id, r.group_size, r.text_sha256) for r in index) == sorted((repr(w[0]), w[1], w[2], w[4]) for w in want)
    chains: dict = {}
    for r in index:
        chains.setdefault(r.h, set()).add((r.chain, r.text_sha256))
    assert max(map(len, chains.values())) > 1 and all(sorted(c for c, _ in v) == list(range(1, len(v) + 1)) for v in chains.values())
    buckets: dict = {}
    for r in index:
        buckets.setdefault(r.bucket, set()).add((r.local_depth, r.h))
    assert all(len(v) <= 2 and len({d for d, _ in v}) == 1 for v in buckets.values())
    assert exact_dedup.exact_dedup(table(spark, [])).count() == 0


def shingles(text):
    w = re.sub("[A-Z]", lambda m: m[0].lower(), text or "")
    w = [x for x in WS.split(w) if x]
    return {tuple(w[i : i + 5]) for i in range(len(w) - 4)} if len(w) >= 5 else ({tuple(w)} if w else set())


def groups_of(rows):
    sets = {i: shingles(t) for i, t, *_ in rows}
    root = {i: i for i in sets}

    def find(x):
        while root[x] != x:
            x = root[x]
        return x

    ids = sorted(sets)
    for a in ids:
        for b in ids:
            if a < b and sets[a] and sets[b] and 100 * len(sets[a] & sets[b]) >= 75 * len(sets[a] | sets[b]):
                x, y = find(a), find(b)
                root[max(x, y)] = min(x, y)
    return {i: (len(sets[i]), find(i)) for i in ids}


@pytest.mark.parametrize("seed", [1, 2])
def test_near_dedup(spark, seed):
    rows = corpus(seed)
    got = {r.doc_id: (r.n_shingles, r.component_id) for r in near_dedup.near_dedup(table(spark, rows)).collect()}
    assert got == groups_of(rows)
    if seed == 1:
        assert near_dedup.near_dedup(table(spark, [])).count() == 0
        odd = near_dedup.near_dedup(table(spark, [(None, "a b c d e f", "", ""), (1, "a b c d e f", "", ""), (1, "a b c d e f", "", "")])).collect()
        assert sorted((str(r.doc_id), r.component_id) for r in odd) == [("1", 1), ("1", 1), ("None", 1)]


def test_near_dedup_without_keys(spark):
    """Ids that repeat over different texts, and null ones, against brute force over row numbers."""
    rows = [t for t in corpus(3) if t[0] != 77]
    ids = [None if k % 7 == 3 else k // 2 for k in range(len(rows))]
    want = groups_of([(k, r[1], "", "") for k, r in enumerate(rows)])
    least: dict = {}
    for k, (_, c) in want.items():
        least.setdefault(c, []).append(ids[k])
    least = {c: min((i for i in v if i is not None), default=None) for c, v in least.items()}
    got = near_dedup.near_dedup(table(spark, [(ids[k], *r[1:]) for k, r in enumerate(rows)])).collect()
    assert sorted(repr((r.doc_id, r.n_shingles, r.component_id, r.kept)) for r in got) == sorted(repr((ids[k], n, least[c], ids[k] == least[c])) for k, (n, c) in want.items())


def test_blocks_lose_nothing(spark, monkeypatch):
    """A family most of whose members are just not similar enough, in one bucket of many blocks."""
    rng = random.Random(5)
    base = words(rng, 60).split()
    rows = []
    for i in range(40):
        w = list(base)
        for _ in range(rng.randrange(1, 5)):
            w[rng.randrange(60)] = f"z{rng.randrange(10**6)}"
        rows.append((i, " ".join(w)))
    sets = {i: shingles(t) for i, t in rows}
    need = groups_of(rows)
    monkeypatch.setattr(near_dedup, "BLOCK", 7)
    opened = spark.createDataFrame([(1, i, i, 40) for i, _ in rows], "bucket long, class_id long, root long, c long")
    texts = spark.createDataFrame(rows, "id long, text string")
    got = near_dedup._in_blocks(opened, texts).mapInArrow(near_dedup._block_links, "a long, b long").collect()
    root = {i: i for i in sets}
    for r in got:
        assert 100 * len(sets[r.a] & sets[r.b]) >= 75 * len(sets[r.a] | sets[r.b])
        low, high = sorted((root[r.a], root[r.b]))
        root = {i: low if x == high else x for i, x in root.items()}
    assert root == {i: c for i, (_, c) in need.items()} and len(set(root.values())) > 1


def test_intersections():
    rng = np.random.default_rng(2)
    sets = [np.unique(rng.integers(0, 60, 40)).astype(np.uint64) for _ in range(15)] + [np.zeros(0, np.uint64)]
    got = near_dedup.intersections(np.concatenate(sets), np.cumsum([0, *map(len, sets)]))
    assert all(got[i, j] == len(np.intersect1d(sets[i], sets[j])) for i in range(16) for j in range(i + 1, 16))


def test_super_minhash_estimates_similarity():
    rng = np.random.default_rng(3)
    x = rng.integers(0, 1 << 63, 4000).astype(np.uint64)
    flat = np.concatenate([x[:900], x[100:1000], x[:1]])
    sig = near_dedup.super_minhash(flat, np.array([0, 900, 1800, 1801, 1801]), 512)
    assert abs((sig[0] == sig[1]).mean() - 0.8) < 0.06
    assert len(np.unique(sig[2] >> np.uint64(32))) == 512 and (sig[3] == np.iinfo(np.uint64).max).all()


def test_substring_dedup(spark):
    rows = corpus()
    got = {r.doc_id: (r.n_words, r.n_removed, r.kept_sha256) for r in substring_dedup.substring_dedup(table(spark, rows)).collect()}
    docs = {i: [x for x in WS.split(t or "") if x] for i, t, *_ in rows}
    seen = Counter(tuple(w[i : i + 35]) for w in docs.values() for i in range(len(w) - 34))
    for i, w in docs.items():
        gone = set()
        for k in range(len(w) - 34):
            if seen[tuple(w[k : k + 35])] > 1:
                gone |= set(range(k, k + 35))
        kept = " ".join(x for k, x in enumerate(w) if k not in gone)
        assert got[i] == (len(w), len(gone), hashlib.sha256(kept.encode()).hexdigest()), i
    assert substring_dedup.substring_dedup(table(spark, [])).count() == 0
    t = words(random.Random(9), 40)
    twice = substring_dedup.substring_dedup(table(spark, [(None, t, "", ""), (4, t, "", ""), (4, t, "", "")])).collect()
    assert [r.n_removed for r in twice] == [40, 40, 40]
    # rows that share an id, or have none, are rows like others
    rng = random.Random(11)
    p, q = words(rng, 60, 10**6), words(rng, 60, 10**6)
    rows = [(1, f"a {p}", "", ""), (1, f"{q} b c", "", ""), (2, f"x {p} y", "", ""), (None, f"{q} z", "", ""), (None, "one " + words(rng, 50, 10**6), "", "")]
    got = substring_dedup.substring_dedup(table(spark, rows)).collect()
    assert sorted((repr(r.doc_id), r.n_words, r.n_removed) for r in got) == [("1", 61, 60), ("1", 62, 60), ("2", 62, 60), ("None", 51, 0), ("None", 61, 60)]


@pytest.mark.parametrize("window", [5, 13, 50])
def test_substring_dedup_of_other_lengths(spark, window):
    """Every level against brute force; a text in a hot passage of a third of the rows."""
    rng = random.Random(window)
    rows = [(i, words(rng, rng.randrange(0, 90), 4 if window < 12 else 40) + (" hot" * 60 if i % 3 == 0 else ""), "", "") for i in range(40)]
    docs = [t.split() for _, t, *_ in rows]
    seen = Counter(tuple(w[i : i + window]) for w in docs for i in range(len(w) - window + 1))
    got = {r.doc_id: r for r in substring_dedup.substring_dedup(table(spark, rows), window=window, start=3).collect()}
    for i, w in enumerate(docs):
        gone = {j for k in range(len(w) - window + 1) if seen[tuple(w[k : k + window])] > 1 for j in range(k, k + window)}
        kept = " ".join(x for k, x in enumerate(w) if k not in gone)
        assert (got[i].n_removed, got[i].kept_sha256) == (len(gone), hashlib.sha256(kept.encode()).hexdigest())


def test_mixing(spark):
    rows = [(i, "t", "en", "big" if i < 3000 else "small" if i < 3300 else None) for i in range(3400)]
    docs = table(spark, rows)
    out = mixing.mix(docs, weights={"big": 0.5, "small": 0.5})
    assert out.columns[: len(docs.columns)] == docs.columns
    counts = {r.source: r["count"] for r in out.groupBy("source").count().collect()}
    assert None not in counts and abs(counts["big"] / 1700 - 1) < 0.1 and abs(counts["small"] / 1700 - 1) < 0.12
    per = Counter(r.c for r in out.filter("source = 'small'").groupBy("doc_id").agg(F.max("_copy").alias("c")).collect())
    rate = 3400 / 2 / 300
    assert abs(per[5] / 300 - math.exp(-rate) * rate**5 / math.factorial(5)) < 0.07
    once = sorted((r.doc_id, r._copy) for r in out.collect())
    assert once == sorted((r.doc_id, r._copy) for r in mixing.mix(docs, weights={"big": 0.5, "small": 0.5}).collect())
    large = mixing.mix(table(spark, [(i, "t", "en", "one" if i == 7 else "many") for i in range(5000)]), weights={"one": 0.5, "many": 0.5})
    assert abs(large.filter("source = 'one'").count() - 2500) < 300  # a rate at which e**-rate vanishes
    assert mixing.mix(table(spark, [])).count() == 0
    assert mixing.mix(table(spark, [(None, None, None, None)] * 5)).columns[0] == "doc_id"


def test_language_id(spark):
    rng = random.Random(4)
    sounds = {"aa": ["ba", "na", "ka"], "oo": ["zo", "lo", "mo"], "ee": ["te", "she", "re"]}
    rows = []
    for i in range(240):
        lang = list(sounds)[i % 3]
        rows.append((i, " ".join("".join(rng.choice(sounds[lang]) for _ in range(3)) for _ in range(rng.randrange(2, 60))), lang, "s"))
    rows += [(900, None, "aa", "s"), (901, "123 !!", "aa", "s"), (902, "", None, "s"), (None, "banaka naba", "aa", "s"), (903, "漢字漢字", None, "s"), (904, "bana " * 50_000, None, "s")]
    docs = table(spark, rows)
    held = F.crc32(F.col("doc_id").cast("string").cast("binary")) % 4 == 2
    model = language_id.fit(docs.filter(~held))
    got = {r.doc_id: r for r in language_id.identify(docs, model, held).collect()}
    assert len(got) == len(rows)
    assert sum(got[i].lang_pred == lang for i, _, lang, _ in rows[:240]) >= 238
    assert all(got[i].lang_pred == "und" and got[i].score == 0 and got[i].rejected for i in (900, 901, 902))
    assert got[903].rejected and got[903].lang_pred != "und" and got[904].lang_pred == "aa" and all(0 <= r.score <= 1 for r in got.values())
    kept = language_id.keep_identified(docs, model)
    assert kept.schema == docs.schema and kept.count() == len(rows) - 4
    nobody = language_id.fit(docs.filter("lang = 'none'"))
    assert {r.lang_pred for r in language_id.identify(docs, nobody, held).collect()} == {"und"}
    assert language_id.identify(table(spark, []), model, held).count() == 0


def test_quality(spark):
    rng = random.Random(6)
    rows, labels = [], []
    for i in range(400):
        good = i % 3 != 0
        w = [f"{rng.choice('abcdefgh')}{'aeiou'[rng.randrange(5)]}nd" for _ in range(rng.randrange(5, 80))]
        rows.append((i, " ".join(w) + "." if good else " | ".join(w).upper() + "!!", "en", "s"))
        labels.append((i, int(good)))
    rows += [(1000, None, "en", "s"), (1001, "", "en", "s"), (None, "hello", "en", "s"), (1002, "x" * 300_000, "en", "s")]
    labels += [(7, None), (None, 1), (5000, 1)]
    docs, marks = table(spark, rows), spark.createDataFrame(labels, "doc_id long, quality int")
    fold = F.crc32(F.coalesce(F.col("doc_id").cast("string"), F.lit("")).cast("binary")) % 5
    got = {r.doc_id: r for r in quality.quality(docs, marks, fold, 0, 4).collect()}
    assert len(got) == len(rows) and all(0 <= r.score <= 1 for r in got.values())
    held = [i for i in range(400) if zlib.crc32(str(i).encode()) % 5 == 0]
    assert sum(got[i].predicted == (i % 3 != 0) for i in held) >= 0.97 * len(held) and all(got[i].held_out for i in held)
    assert got[1000].score == got[1001].score
    assert {r.score for r in quality.quality(docs, marks.limit(0), fold, 0, 4).collect()} == {0.5}
    assert quality.quality(table(spark, []), marks, fold, 0, 4).count() == 0


def test_isotonic_pool():
    assert quality.pool(np.array([1.0, 3.0, 2.0, 4.0]), np.ones(4)).tolist() == [1.0, 2.5, 2.5, 4.0]


def test_language_model(spark):
    rows = corpus()
    held = F.crc32(F.col("doc_id").cast("string").cast("binary")) % 7 == 2
    repeated = [*rows, (None, "w1 w2", "", ""), (None, "w1 w2 w3 w4", "", ""), (0, "w5 zzz", "", "")]
    found = hpyp.language_model_scores(table(spark, repeated), ~held).collect()
    assert len(found) == len(repeated) and sorted(r.n_tokens for r in found if r.doc_id is None) == [3, 5]
    assert sorted(r.n_tokens for r in found if r.doc_id == 0) == sorted([3, len(rows[0][1].split()) + 1])
    got = {(r.doc_id, r.n_tokens): r for r in found}
    tokens = [(i, [*re.sub("[A-Z]", lambda m: m[0].lower(), t or "").split(), None]) for i, t, *_ in repeated]
    train = Counter(w for i, ws in tokens if i is not None and zlib.crc32(str(i).encode()) % 7 != 2 for w in ws)  # a null id has no remainder
    n, v, gain = sum(train.values()), len(train), 0.0
    for i, ws in tokens:
        r = got[i, len(ws)]
        assert (r.n_tokens, r.n_known, r.train_tokens) == (len(ws), sum(train[w] > 0 for w in ws), n)
        assert r.base_score == pytest.approx(sum(math.log10((train[w] + 1) / (n + v + 1)) for w in ws))
        assert r.perplexity == pytest.approx(10 ** (-r.score / len(ws)))
        gain += r.score - r.base_score
    assert gain > 0
    empty = hpyp.language_model_scores(table(spark, [(1, "a b", "", ""), (2, None, "", "")]), F.lit(False)).collect()
    assert sorted((r.doc_id, r.n_tokens, r.score, r.base_score) for r in empty) == [(1, 3, 0.0, 0.0), (2, 1, 0.0, 0.0)]
    assert hpyp.language_model_scores(table(spark, []), F.lit(True)).count() == 0


def test_language_model_pairs():
    """Pairs equal a plain count, whatever the blocks; each word is sent its number of dishes."""
    rng = random.Random(4)
    texts = [words(rng, rng.randrange(0, 30), 12) for _ in range(60)] + ["b a b a b a " * 400]
    deal = hpyp.Deal(3, np.zeros(0, np.uint64), np.zeros(0, np.int64))
    batches = [pa.RecordBatch.from_arrays([pa.array(texts[i : i + 20]), pa.array([j % 5 > 0 for j in range(len(texts[i : i + 20]))])], ["text", "train"]) for i in range(0, len(texts), 20)]
    rows = sorted((r for x in batches for b in hpyp._pairs(deal)([x]) for r in b.to_pylist()), key=lambda r: r["part"])
    out = [r for b in hpyp._merge_pairs(2)([pa.RecordBatch.from_pylist(rows, hpyp._SCHEMA)]) for r in b.to_pylist()]
    want: Counter = Counter()
    for x in batches:
        hashes, at = hpyp.tokens(x)
        for r, taught in enumerate(x.column("train").to_pylist()):
            ws = [int(hpyp._START)] + [int(h) for h in hashes[at == r]]
            want.update(zip(ws, ws[1:]) if taught else [])
    got, sent = {}, Counter()
    for r in out:
        if r["kind"] == 1:
            known = hpyp._unpack(r["data"])[0]
        elif r["kind"] == 2:
            near, sizes, word, counts = hpyp._unpack(r["data"])
            got |= {(int(known[n]), int(known[w])): int(c) for n, w, c in zip(np.repeat(near, sizes), word, counts, strict=True)}
        elif r["kind"] == 4:
            sent.update(dict(zip(*map(np.ndarray.tolist, hpyp._unpack(r["data"])), strict=True)))
    assert got == want
    assert +sent == Counter(w for _, w in want)


def test_language_model_probabilities():
    """Predictive probabilities are those of a plain model with the same seats; they sum to one over
    all words and the unknown one, in contexts that were seen and others."""
    rng = random.Random(4)
    n_words = 12  # word 12 stands for the unknown one, 13 for the start
    triples: Counter = Counter()
    for _ in range(60):
        ws = [13, 13] + [rng.randrange(n_words) for _ in range(rng.randrange(1, 30))]
        triples.update(zip(ws[1:], ws[2:], ws))
    triples[3, 4, 5] += 700
    near, word, far = (np.array(x, np.uint32) for x in zip(*sorted(triples), strict=True))
    counts = np.array([triples[t] for t in sorted(triples)], np.int64)
    settings = hpyp.Settings(1000, n_words, 0.7, (50.0, 20.0))
    customers, tables = np.append(np.full(n_words, 4), [0, 0]), np.append(np.full(n_words, 1), [0, 0])
    customers[0] += 50 - customers.sum()
    tables[0] += 20 - tables.sum()
    unigram = settings.unigram(customers, tables)
    assert unigram[: n_words + 1].sum() == pytest.approx(1)
    chunk = hpyp.Chunk(near, word, far, counts)
    discounts = 0.6, 0.7
    model = hpyp.Predictive(chunk, unigram, discounts)
    every = np.arange(n_words + 1, dtype=np.uint32)
    for a, b in [(13, 13), (3, 5), (4, 3), (3, 12), (12, 3), (12, 12), (0, 1)]:
        one = np.ones(len(every), np.uint32)
        assert model.chances(one * np.uint32(a), every, one * np.uint32(b)).sum() == pytest.approx(1)

    samples = list(chunk.sweeps(unigram, discounts, hpyp.SWEEPS + 1, hpyp.SAMPLES + 1))[1:]
    d2, d1 = discounts
    for e in range(0, len(counts), 7):
        total = 0.0
        dish = [(n, w) for n, w in zip(near.tolist(), word.tolist(), strict=True)]
        for t2, c1, t1 in samples:
            keys = sorted(set(dish))
            c, t = dict(zip(keys, c1.tolist(), strict=True)), dict(zip(keys, t1.tolist(), strict=True))
            assert (1 <= t2).all() and (t2 <= counts).all() and all(c[k] == sum(x for d, x in zip(dish, t2.tolist(), strict=True) if d == k) >= t[k] >= 1 for k in keys[:20])
            n, w, f = int(near[e]), int(word[e]), int(far[e])
            p1 = (c[n, w] - d1 * t[n, w] + (1 + d1 * sum(t[k] for k in keys if k[0] == n)) * unigram[w]) / (1 + sum(c[k] for k in keys if k[0] == n))
            own = (near == n) & (far == f)
            total += (counts[e] - d2 * t2[e] + (1 + d2 * t2[own].sum()) * p1) / (1 + counts[own].sum())
        assert model.chances(near[e : e + 1], word[e : e + 1], far[e : e + 1])[0] == pytest.approx(total / len(samples))


def test_seats_have_the_equilibrium_of_the_chinese_restaurant():
    """The share of seatings with t tables against the sum over all set partitions."""
    c, w, d, n = 5, 0.7, 0.4, 40_000
    weights = Counter()

    def walk(sizes, left, p):
        if not left:
            weights[len(sizes)] += p
            return
        walk([*sizes, 1], left - 1, p * w)
        for i, s in enumerate(sizes):
            walk([*sizes[:i], s + 1, *sizes[i + 1 :]], left - 1, p * (s - d))

    walk([], c, 1.0)
    rng = np.random.default_rng(1)
    one = hpyp._small_dishes(np.full(n, c), np.full(n, w), d, rng)
    share = np.bincount(one, minlength=c + 1)[1:] / n
    want = np.array([weights[t] for t in range(1, c + 1)]) / sum(weights.values())
    forward = np.abs(share - want).max()
    assert forward < 0.06
    big = [hpyp._large_dish(2000, 3.0, 0.5, np.random.default_rng(i)) for i in range(20)]
    small = hpyp._small_dishes(np.full(200, 2000), np.full(200, 3.0), 0.5, rng)
    assert 0.75 < np.mean(big) / small.mean() < 1.33


def test_hot_words_are_dealt_over_parts():
    near = np.full(10_000, 77, np.uint64)
    far = np.arange(10_000, dtype=np.uint64)
    cold = hpyp.Deal(64, np.zeros(0, np.uint64), np.zeros(0, np.int64))
    hot = hpyp.Deal(64, np.array([77], np.uint64), np.array([40 * hpyp.HOT]))
    assert len(np.unique(cold.parts(near, far))) == 1
    got = np.bincount(hot.parts(near, far), minlength=64)
    assert (got > 0).sum() > 20 and got.max() < 1500


def test_nearest(spark):
    rng = np.random.default_rng(8)
    x = rng.normal(size=(900, 8)).astype(np.float32)
    x[300:600] = x[7]
    rows = [(int(i), v.tolist()) for i, v in enumerate(x)]
    rows += [(2000, None), (2001, [0.0] * 8), (2002, [float("nan")] + [1.0] * 7), (2003, [None] + [1.0] * 7), (2004, [1.0] * 3), (2050, [float("inf")] * 8), (None, [1.0] * 8)]
    df = spark.createDataFrame(rows, "vec_id long, embedding array<float>")
    queries = ann.usable(df, "vec_id", "embedding").filter("id % 50 = 0")
    got: dict = {}
    for r in ann.nearest(df, queries).orderBy("query_id", "rank").collect():
        got.setdefault(r.query_id, []).append((r.id, r.score))
    u = x.astype(np.float64)
    u /= np.linalg.norm(u, axis=1, keepdims=True)
    assert sorted(got) == list(range(0, 900, 50))
    hit = 0
    for q, found in got.items():
        s = u @ u[q]
        s[q] = -9
        best = s[np.lexsort((np.arange(900), -s))[:5]]
        assert len(found) == 5 and all(score == pytest.approx(s[i]) for i, score in found)
        hit += sum(score >= best[-1] - 1e-9 for _, score in found)
    assert hit >= 0.9 * 5 * len(got)
    assert [i for i, _ in got[300]] == [7, 301, 302, 303, 304]
    few = spark.createDataFrame(rows[:3], "vec_id long, embedding array<float>")
    assert ann.nearest(few, ann.usable(few, "vec_id", "embedding").filter("id = 0")).count() == 2
    none = df.filter("vec_id = 2000")
    assert ann.nearest(none, ann.usable(none, "vec_id", "embedding")).count() == 0


PAGE = """<!DOCTYPE html><html><head><title>T</title><style>p{{}}</style><script>var t="</p>";</script></head><body class="home">
<div id="menu"><a href="/">Home</a> <a href="/x">News</a></div><!-- <p>no</p> --><div class="{box}">{body}</div>
<div class="sidebar"><p>See also</p></div><section id="comments"><p>nice post</p></section><form><p>mail</p></form><footer>&copy; all</footer></body></html>"""


def test_html(spark):
    rows = []
    for i in range(12):
        body = f"<h2>Head &amp; {i}</h2><p>One <i>t</i>wo{i}\n\n three<br>four<p>Five &lt;{i}&gt;" + ("<ul><li>a<li>b</ul>" if i % 2 else "") + "<table><tr><td>c<td>d</table>"
        rows.append((i, f"http://h.example/{i}", PAGE.format(box="wrap", body="<p>Welcome to the site</p>" + body)))
    rows.append((20, "http://a.example/", PAGE.format(box="x", body="<article><header><h1>Title</h1></header><p>Text &eacute;</p><div class=share-box>Share</div><span class='ad'>buy</span></article>")))
    rows += [(21, None, None), (22, "odd", ""), (23, "http://h.example/z", "<p>unclosed <b>bold"), (None, "http://big.example/", "<article>" + "<p>x</p>" * 20_000 + "</article>")]
    df = spark.createDataFrame(rows, "page_id long, url string, html string").withColumn("host", F.lit("clash")).withColumn("text", F.lit("clash"))
    got = {r.page_id: r for r in html_extract.extract(df).collect()}
    for i in range(12):
        assert got[i].text == "\n".join([f"Head & {i}", f"One two{i} three four", f"Five <{i}>", *(["a", "b"] if i % 2 else []), "c", "d"]), got[i].text
        assert got[i].n_chars == len(got[i].text)
    assert got[20].text == "Title\nText é" and got[21].text == "" and got[22].text == "" and got[23].text == "unclosed bold"
    assert got[None].n_chars == 39_999
    assert html_extract.extract(df.limit(0)).count() == 0
