"""Corpus operators against brute-force versions, on texts with nulls, empties, copies, ties and long rows."""

import hashlib
import math
import random
import re
import zlib
from collections import Counter

import numpy as np
import pytest
from pyspark.sql import functions as F
from pyspark.sql.types import ArrayType, FloatType, LongType, StringType, StructType

from paysift.llm import attention_lm, ball_search, fingerprints, language, mixing, ngram_join, packing, suffix_dedup, token_counts, toxicity
from paysift.llm.queries import vocabulary

WORDS = [a + b for a in "th on er re an st in ou".split() for b in ("", "ing", "ed", "ly", "ness", "é", "tion")]
SCHEMA = "doc_id bigint, text string, lang string, source string, n_tokens string, is_toxic string, row_key string, score string"


def texts(seed=3, n=40):
    r = random.Random(seed)
    out = [" ".join(r.choice(WORDS) for _ in range(r.randrange(3, 300))) for _ in range(n)]
    out += [out[0], out[0], out[1] + " more", None, "", " \n\t", "a", "12 !?", "special <|endoftext|> inside", "naïve — “quotes” 日本語 🙂 \u0085x", "x" * 5000, " ".join(r.choice(WORDS) for _ in range(9000)), "ab " * 3000]
    passage = " ".join(r.choice(WORDS) for _ in range(150))
    return out + [f"{out[i][:80 + i]} {passage} {out[i + 1][:50 + i]}" for i in range(6)]


@pytest.fixture(scope="module")
def rows():
    t = texts()
    made = [(i, x, "en", f"s{i % 3 if i % 2 else 0}", "own", "own", "own", "own") for i, x in enumerate(t)]
    return made + [(None, "a null id with some words in it", None, None, "own", "own", "own", "own"), made[2], made[2]]


@pytest.fixture(scope="module")
def docs(spark, rows):
    return spark.createDataFrame(rows, SCHEMA).cache()


@pytest.fixture(scope="module")
def nothing(spark):
    return spark.createDataFrame([], SCHEMA)


def test_token_counts(docs, rows, nothing):
    from tokenizers import Tokenizer

    whole = Tokenizer.from_file(vocabulary("byte_bpe_50k.json"))
    got = token_counts.count_tokens(docs, vocabulary("byte_bpe_50k.json"), frequent=20, room=50)
    assert set(got.columns) == set(docs.columns) | {"n_bytes", "over_limit"}
    want = sorted((r[0] or -1, len((r[1] or "").encode()), n := len(whole.encode(r[1] or "", add_special_tokens=False).ids), n > 512) for r in rows)
    assert sorted((r.doc_id or -1, r.n_bytes, r.n_tokens, r.over_limit) for r in got.collect()) == want
    assert token_counts.count_tokens(nothing, vocabulary("byte_bpe_50k.json")).count() == 0


def test_packing(docs, rows, nothing):
    from tokenizers import Tokenizer

    whole = Tokenizer.from_file(vocabulary("word_bpe_49k.json"))
    want = Counter()
    for r in rows:
        ids = np.array([*whole.encode(r[1] or "", add_special_tokens=False).ids, 0], "<u4")
        for i, lo in enumerate(range(0, len(ids), 256)):
            part = ids[lo:lo + 256]
            want[(r[0], i, lo, len(part), zlib.crc32(part.tobytes()))] += 1
    got = packing.pack_documents(docs, vocabulary("word_bpe_49k.json"), capacity=256, open_bins=4).collect()
    assert Counter((r.doc_id, r.piece, r.start, r.length, r.ids_crc32) for r in got) == want
    used = {}
    for r in got:
        used.setdefault(r.sequence_id, []).append((r.offset, r.length))
    for places in used.values():
        at = 0
        for offset, length in sorted(places):
            assert offset == at
            at += length
        assert at <= 256
    assert packing.pack_documents(nothing, vocabulary("word_bpe_49k.json")).count() == 0


def test_open_bins_close_the_fullest():
    bins = packing.OpenBins(10, 2)
    assert [bins.place(n) for n in (6, 7, 3, 4, 8)] == [(0, 0), (1, 0), (1, 7), (0, 6), (2, 0)]
    bins = packing.OpenBins(10, 2)
    # 8 and 5 are open; 6 fits neither, so the bin with 8 closes and 2 later goes beside 6
    assert [bins.place(n) for n in (8, 5, 6, 2)] == [(0, 0), (1, 0), (2, 0), (2, 6)]


def test_mixing(docs, rows, spark, nothing):
    weights = {"s0": 1.0, "s1": 3.0, None: 0.5}
    got = mixing.mix(docs, weights, size=6.0)
    n = Counter(r[3] for r in rows)
    share = sum(weights.get(s, 0) for s in n)
    rate = {s: 6.0 * len(rows) * weights.get(s, 0) / share / n[s] for s in n}

    def draw(doc, source):
        total, parts = 0, max(1, math.ceil(rate[source] / 8))
        for part in range(1, parts + 1):
            u = int(hashlib.md5(f"{'null' if doc is None else doc}|17|{part}".encode()).hexdigest()[:13], 16) / 2**52
            p = below = math.exp(-rate[source] / parts)
            k = 0
            while u >= below and k < 64:
                k += 1
                p *= rate[source] / parts / k
                below += p
            total += k
        return total

    want = Counter()
    for r in rows:
        want.update((r[0], r[1], c) for c in range(draw(r[0], r[3])))
    found = got.collect()
    assert Counter((r.doc_id, r.text, r.mix_copy) for r in found) == want
    assert not any(r.source == "s2" for r in found)
    plan = got._jdf.queryExecution().toString()
    assert "Python" not in plan and "Arrow" not in plan
    assert mixing.mix(nothing).count() == 0


def test_mixing_reaches_its_weights(spark):
    many = spark.range(20000).select(F.col("id").alias("doc_id"), F.when(F.col("id") % 10 == 0, "rare").otherwise("common").alias("source"), F.lit("x").alias("text"))
    got = {r.source: r["count"] for r in mixing.mix(many).groupBy("source").count().collect()}
    assert abs(got["rare"] - 10000) < 500 and abs(got["common"] - 10000) < 500


def vectors(spark, rows):
    return spark.createDataFrame(rows, StructType().add("vec_id", LongType()).add("embedding", ArrayType(FloatType())).add("label", StringType()))


def test_ball_search(spark):
    r = np.random.default_rng(4)
    data = [(i, [float(np.float32(x)) for x in r.normal(0, 0.3, 12)], "x") for i in range(700)]
    data += [(700 + i, data[0][1], "x") for i in range(60)]  # ties
    bad = [(1000, None, None), (1050, [1.0, None], None), (1100, [float("nan")] * 12, None), (1150, [float("inf")] * 12, None), (1200, [0.5] * 3, None), data[3], data[3]]
    ints = {i: [math.floor(256 * x) for x in v] for i, v, _ in data} | {1200: [128] * 3}
    want = set()
    for q in ints:
        if q % 50 == 0:
            scored = sorted((-sum(a * b for a, b in zip(ints[q], v, strict=True)), i) for i, v in ints.items() if i != q and len(v) == len(ints[q]))[:5]
            want |= {(q, n + 1, i, -s) for n, (s, i) in enumerate(scored)}
    got = ball_search.top_k(vectors(spark, data + bad), F.col("vec_id") % 50 == 0, shard_rows=100, block_rows=5, leaf=8)
    assert {(x.query_id, x["rank"], x.vec_id, x.score) for x in got.collect()} == want
    assert ball_search.top_k(vectors(spark, []), F.col("vec_id") % 50 == 0).count() == 0


def test_ball_search_with_wide_numbers():
    rows = np.array([[2**40, 1], [2**40, 2], [-(2**40), 5]], "int64")
    assert ball_search.products(rows[:1], rows).tolist() == [[2**63 - 1, 2**63 - 1, -(2**63) + 1]]


def test_order_minhash(docs, rows, nothing):
    ordered = sorted(((r[0] if r[0] is not None else -1, r[1] or "") for r in rows))
    want = Counter()
    for i, (doc, text) in enumerate(ordered):
        after = ordered[(i + 1) % len(ordered)][1]
        half = len(text) // 2
        edited = text[:len(text) - half] + after[:half]
        own, changed, other = (fingerprints.sketch(x) for x in (text, edited, after))
        want[(doc, len(text), hashlib.sha256(edited.encode()).hexdigest(), fingerprints.packed(own).hex(), fingerprints.packed(changed).hex(), float((own == changed).mean()), float((own == other).mean()))] += 1
    got = fingerprints.fingerprint_neighbours(docs, part_bytes=9000)
    assert Counter((-1 if r.doc_id is None else r.doc_id, *r[1:]) for r in got.collect()) == want
    assert fingerprints.fingerprint_neighbours(nothing).count() == 0


def test_order_minhash_follows_order_and_edits():
    r = random.Random(1)
    words = [r.choice(WORDS) + str(r.randrange(50)) for _ in range(400)]
    text = " ".join(words)
    one = fingerprints.sketch(text)
    near = fingerprints.sketch(text.replace(words[50], "zz", 1))
    turned = fingerprints.sketch(" ".join(words[200:] + words[:200]))
    far = fingerprints.sketch(" ".join(r.choice(WORDS) + str(r.randrange(50)) for _ in range(400)))
    same = [fingerprints.likeness(one, x) for x in (near, turned, far)]
    assert same[0] > 0.8 > same[1] > same[2]


def test_order_minhash_chooses_among_all_kmers():
    r = random.Random(2)
    prose = ["".join(r.choice("abcdefghijklmnopqrstuvwxyz ") for _ in range(3000)) for _ in range(2)]
    for text in (prose[0], "-" * 3000 + prose[0], "short", "abcdefg"):
        base, seen, element = fingerprints.kmers(text), Counter(), []
        for x in base.tolist():
            element.append(int(fingerprints._mix(np.array([x], "uint64") + np.array([seen[x]], "uint64") * fingerprints._BASE)[0]) >> 32)
            seen[x] += 1
        want = []
        for odd in fingerprints._ODD.tolist():
            total = np.zeros(1, "uint64")
            for i in sorted(sorted(range(len(base)), key=lambda i: element[i] * odd % 2**32)[:2]):
                total = total * fingerprints._BASE + base[i] + np.uint64(1)
            want.append(int(fingerprints._mix(total)[0]) >> 32)
        assert fingerprints.sketch(text).tolist() == want
    # half of either text is one repeated k-mer: about a tenth alike, and about that for every padding letter
    same = [fingerprints.likeness(*(fingerprints.sketch(pad * 3005 + t) for t in prose)) for pad in "0123456789#+*%=~"]
    assert max(same) < 0.35 and 0.05 < np.mean(same) < 0.25


def jaccard_classes(rows, width=5):
    def grams(t):
        w = [x.lower() for x in re.findall(r"[^\x20\x09-\x0D]+", t or "")]
        return frozenset(tuple(w[i:i + width]) for i in range(max(1, len(w) - width + 1))) if w else None

    sets = {}
    for r in rows:
        if (g := grams(r[1])) is not None:
            sets.setdefault(g, []).append(r[0])
    names = list(sets)
    links = {a: [b for b in names if b is not a and len(a & b) / len(a | b) >= 0.8] for a in names}
    out = Counter()
    for r in rows:
        g = grams(r[1])
        if g is None:
            out[(r[0], r[0], r[0], 0)] += 1
            continue
        seen, todo = {g}, [g]
        while todo:
            for b in links[todo.pop()]:
                if b not in seen:
                    seen.add(b)
                    todo.append(b)
        least = lambda ids: min((i for i in ids if i is not None), default=None)
        out[(r[0], least(i for s in seen for i in sets[s]), least(sets[g]), len(links[g]))] += 1
    return out


@pytest.mark.parametrize("limit,block", [(256, 512), (4, 3)])
def test_ngram_join(docs, rows, spark, limit, block):
    r = random.Random(8)
    base = [r.choice(WORDS) + str(r.randrange(90)) for _ in range(120)]
    near = []
    for i in range(40):
        w = list(base)
        for _ in range(r.randrange(4)):
            w[r.randrange(len(w))] = f"w{r.randrange(9)}"
        near.append((1000 + i, " ".join(w), "en", "s0", "own", "own", "own", "own"))
    more = spark.createDataFrame(near, SCHEMA)
    got = ngram_join.similar_documents(docs.union(more), limit=limit, block=block).select("doc_id", "class_id", "set_id", "n_links")
    assert Counter(tuple(x) for x in got.collect()) == jaccard_classes(rows + near)


@pytest.mark.parametrize("depth", [6, 12])
def test_ngram_join_recall_in_deep_buckets(depth):
    r, pairs, lost = np.random.default_rng(4), 2500, 0
    runs = ngram_join.runs_needed(depth, 0.8, 0.9999)
    for _ in range(pairs):
        items = r.integers(0, 1 << 63, 402, dtype="uint64")
        both = {}
        for run in range(runs):
            group = run // ngram_join.GROUP
            if group not in both:  # 322 of 402 are common: just above 0.8
                both[group] = [ngram_join.tokens(x, group) for x in (items[:362], items[40:])]
            a, b = both[group]
            front = [ngram_join.root(run)]
            for _ in range(depth):
                front = [int(ngram_join._child(np.array([n]), c, a[c:c + 1])[0]) for n in front for c in ngram_join._coordinates(n) if a[c] == b[c]]
            if front:
                break
        else:
            lost += 1
    assert lost <= 3
    assert ngram_join.missed(runs, depth, 0.8) <= 1e-4
    with pytest.raises(ValueError):
        ngram_join.runs_needed(12, 0.5, 0.9999)


def test_keep_one(docs, rows, nothing):
    kept = ngram_join.keep_one(docs)
    assert kept.columns == docs.columns
    classes = jaccard_classes(rows)
    want = sorted({(d if d is not None else -1) for d, c, _, _ in classes if d == c})
    assert sorted(-1 if r.doc_id is None else r.doc_id for r in kept.collect()) == want
    assert ngram_join.keep_one(nothing).count() == 0


def brute_repeats(rows, length):
    data = [(r[1] or "").encode() for r in rows]
    seen = Counter(d[i:i + length] for d in data for i in range(len(d) - length + 1))
    out = []
    for d in data:
        gone = np.zeros(len(d) + 1, int)
        for i in range(len(d) - length + 1):
            if seen[d[i:i + length]] > 1:
                gone[i] += 1
                gone[min(len(d), i + length)] -= 1
        mask = np.cumsum(gone)[:-1] > 0
        edges = np.flatnonzero(np.diff(np.concatenate([[0], mask.astype(int)])) == 1)
        out.append((len(d), int(mask.sum()), len(edges), bytes(np.frombuffer(d, "uint8")[~mask])))
    return out


@pytest.mark.parametrize("hot", [20_000, 2])
def test_repeated_bytes(docs, rows, hot):
    want = Counter((r[0], n, gone, spans, hashlib.sha256(kept).hexdigest()) for r, (n, gone, spans, kept) in zip(rows, brute_repeats(rows, 400), strict=True))
    got = suffix_dedup.repeat_digest(docs, hot=hot, each=4000)
    assert Counter(tuple(r) for r in got.collect()) == want


def test_remove_repeats(docs, rows, nothing):
    got = suffix_dedup.remove_repeats(docs)
    assert got.columns == docs.columns
    want = Counter((r[0], None if r[1] is None else kept.decode(errors="ignore")) for r, (_, _, _, kept) in zip(rows, brute_repeats(rows, 400), strict=True))
    assert Counter((r.doc_id, r.text) for r in got.collect()) == want
    assert suffix_dedup.remove_repeats(nothing).count() == 0 and suffix_dedup.repeat_digest(nothing).count() == 0


def test_remove_passages(docs, rows, nothing):
    made = [(r[0], None if r[1] is None else suffix_dedup.padded(r[1].encode())) for r in rows]
    assert all(b is None or b.replace(b"\xff", b"") == r[1].encode() for r, (_, b) in zip(rows, made, strict=True))
    seen = Counter(b[i:i + 394] for _, b in made if b for i in range(len(b) - 393))
    want = Counter()
    for doc, b in made:
        gone = np.zeros(len(b or b""), bool)
        for i in range(len(gone) - 393):
            if seen[b[i:i + 394]] > 1:
                gone[i:i + 394] = True
        want[(doc, None if b is None else np.frombuffer(b, "uint8")[~gone].tobytes().replace(b"\xff", b"").decode(errors="ignore"))] += 1
    for hot in (20_000, 2):
        assert Counter((r.doc_id, r.text) for r in suffix_dedup.remove_passages(docs, hot=hot, each=4000).collect()) == want
    assert suffix_dedup.remove_passages(nothing).count() == 0


def test_suffix_order():
    r = random.Random(2)
    for _ in range(300):
        s = [r.randrange(1, r.choice([2, 3, 9]) + 1) for _ in range(r.randrange(50))] + [0]
        assert suffix_dedup.suffix_order(s) == sorted(range(len(s)), key=lambda i: s[i:])


def test_repeated_windows_with_odd_texts():
    r = random.Random(5)
    same = bytes(r.choice(b"ab") for _ in range(700))
    contexts = [b"a" * 900, b"ab" * 500, same[:600], b"q" + same[50:650], bytes(r.randrange(256) for _ in range(450))]
    seen = Counter(c[i:i + 400] for c in contexts for i in range(len(c) - 399))
    want = [[seen[c[i:i + 400]] > 1 for i in range(len(c) - 399)] for c in contexts]
    assert [m.tolist() for m in suffix_dedup.repeated_windows(contexts, 400)] == want


def test_attention_gradient_and_distribution():
    r = np.random.default_rng(0)
    counts = r.integers(0, 50, 300).astype(float)
    sequences = [r.integers(1, 300, n) for n in (5, 40, 70)]
    model = attention_lm.AttentionModel(attention_lm.group_ids(sequences, counts), counts)
    x, y = model.windows(sequences)
    assert sorted(y[y >= 0].tolist()) == sorted(np.concatenate(sequences).tolist())
    model.p = {k: v.astype("float64") for k, v in model.p.items()}
    model.p["direct"] += r.normal(0, 0.1, model.p["direct"].shape)
    _, g = model.gradient(x, y)
    for name, v in model.p.items():
        i = np.unravel_index(np.abs(g[name]).argmax(), v.shape)
        old, around = v[i], []
        for d in (1e-4, -1e-4):
            v[i] = old + d
            around.append(model.gradient(x, y)[0])
        v[i] = old
        assert abs((around[0] - around[1]) / 2e-4 - g[name][i]) < 1e-6
    model.condition(r.integers(0, 9, (attention_lm.CLASSES + 1, 300)).astype(float))
    # the probabilities of all next ids sum to one
    total = sum(np.exp(model.log_probabilities(x[1:2], np.full((1, 32), i)))[0, 3] for i in range(300))
    assert abs(total - 1) < 1e-4


def plain_words(text):
    return ["".join(c.lower() if c.isascii() else c for c in w) for w in re.findall(r"[^\x20\x09-\x0D]+", text)]


def test_attention_scores(docs, rows, nothing):
    learn = F.crc32(F.col("doc_id").cast("string")) % 7 != 2
    held = lambda d: d is None or zlib.crc32(str(d).encode()) % 7 == 2
    got = attention_lm.score_texts(docs, learn, vocabulary("word_bpe_49k.json"), block_bytes=6000, part_bytes=9000, steps=5).collect()
    counts = Counter()
    for r in rows:
        if not held(r[0]):
            counts.update([*plain_words(r[1] or ""), None])
    n, v, want = sum(counts.values()), len(counts), Counter()
    for r in rows:
        w = [*plain_words(r[1] or ""), None]
        want[(r[0], held(r[0]), len(w), sum(counts[x] > 0 for x in w), n, round(sum(math.log10((counts[x] + 1) / (n + v + 1)) for x in w), 4))] += 1
    assert Counter((r.doc_id, r.held_out, r.n_tokens, r.n_known, r.train_tokens, round(r.base_score, 4)) for r in got) == want
    assert all(r.score < 0 for r in got)
    same = [r.score for r in got if r.doc_id in (0, 40, 41)]
    assert max(same) - min(same) < 1e-3
    assert attention_lm.score_texts(nothing, learn, vocabulary("word_bpe_49k.json"), steps=1).count() == 0


def test_attention_learns_from_every_training_row(spark, monkeypatch):
    """Ids of all training documents reach classes, direct path and weights; of others none."""
    seen = []
    start, real = attention_lm.AttentionModel.begin, attention_lm.learn_from_all
    monkeypatch.setattr(attention_lm.AttentionModel, "begin", lambda self, n, *a: (seen.append(n.sum()), start(self, n, *a))[1])

    def learn_from_all(rows, model, **settings):
        before = {k: v.copy() for k, v in model.p.items()}
        real(rows, model, **settings)
        seen.append(any((before[k] != model.p[k]).any() for k in before))

    monkeypatch.setattr(attention_lm, "learn_from_all", learn_from_all)
    monkeypatch.setattr(attention_lm, "PASSES", 1)
    # more documents than the sample there was, the rare word only in the last
    rows = [(i, "one two three") for i in range(1800)] + [(1800, "zebra " * 50)] + [(-1, "zebra " * 9)] * 3
    df = spark.createDataFrame(rows, "doc_id bigint, text string").repartition(3)
    got = attention_lm.score_texts(df, F.col("doc_id") >= 0, vocabulary("word_bpe_49k.json"), block_bytes=4000).collect()
    from tokenizers import Tokenizer

    whole = Tokenizer.from_file(vocabulary("word_bpe_49k.json"))
    assert seen == [sum(len(whole.encode(t, add_special_tokens=False).ids) + 1 for i, t in rows if i >= 0), True]
    assert len(got) == len(rows) and all(r.score < 0 for r in got)


def test_attention_goes_once_through_all_windows():
    counts = np.arange(1.0, 301)
    r = np.random.default_rng(1)
    blocks = [[r.integers(1, 300, n) for n in (700, 3, 90)], [], [r.integers(1, 300, 45)]]
    model = attention_lm.AttentionModel(attention_lm.group_ids(blocks[0], counts), counts)
    first = model.p["q"].copy()
    assert model.learn(blocks, rows=8) == 838 and (model.p["q"] != first).any()
    assert model.learn(blocks, rows=8, steps=2) < 838 and model.learn([]) == 0


def test_language_gradient():
    net = language.ByteNetwork(["a", "b", "c"])
    net.p = {k: v.astype("float64") for k, v in net.p.items()}
    r = np.random.default_rng(0)
    x, y, mask = r.integers(0, 255, (6, 3)).astype("uint8"), np.array([0, 1, 2]), np.ones((6, 3))
    _, g = net.gradient(x, y, mask)
    for name, v in net.p.items():
        i = np.unravel_index(np.abs(g[name]).argmax(), v.shape)
        old, around = v[i], []
        for d in (1e-4, -1e-4):
            v[i] = old + d
            around.append(net.gradient(x, y, mask)[0])
        v[i] = old
        assert abs((around[0] - around[1]) / 2e-4 - g[name][i]) < 1e-6


def test_windows_cover_every_byte_once():
    for n in (0, 1, 223, 224, 225, 1000):
        data = bytes(i % 251 for i in range(n))
        x, lo, hi = language.windows(data)
        assert b"".join(bytes(r[a:b]) for r, a, b in zip(x, lo, hi, strict=True)) == data


def test_language_held_out(spark, sf):
    from paysift.llm.queries import op1_language_id

    got = op1_language_id(spark, sf).join(spark.read.parquet(f"{sf}/documents.parquet").select("doc_id", "lang"), "doc_id").where("held_out").collect()
    assert sum(r.lang == r.lang_pred for r in got) >= 0.95 * len(got) and all(0 <= r.score <= 1 for r in got)


def test_language_edges(docs, nothing):
    got = language.identify(docs, F.lit(True)).collect()
    assert all((r.lang_pred, r.score) == ("und", 0.0) for r in got if not r.text or not any(c.isalpha() for c in r.text))
    assert {r.lang_pred for r in got} == {"und", "en"}
    assert language.identify(nothing, F.lit(True)).count() == 0
    unlearned = language.identify(docs, F.lit(False)).collect()
    assert {r.lang_pred for r in unlearned} == {"und"}


def toxic_rows(n=300):
    r, out, labels = random.Random(6), [], []
    for i in range(n):
        w = [r.choice(WORDS) + r.choice(WORDS) for _ in range(60)]
        bad = i % 4 == 0
        if bad:
            for _ in range(5):
                w[r.randrange(60)] = r.choice(["vile", "hateful", "nastyest", "nastyer"])
        if i % 9 == 1:
            w = [x + "$$$" for x in w]
        out.append((i, " ".join(w)))
        labels.append((i, int(i % 9 == 1), int(bad)))
    return out, labels


def test_toxicity_chain_on_held_out_rows(spark):
    rows, labels = toxic_rows()
    docs = spark.createDataFrame([*rows, (900, None), (901, ""), (902, "nasty" * 3000), rows[4]], "doc_id bigint, text string").withColumn("p_toxic", F.lit("own"))
    seen = spark.createDataFrame([x for x in labels if x[0] % 3] + [(1, None, 1), (None, 1, 1)], "doc_id bigint, low_quality int, toxic int")
    got = toxicity.score_toxicity(docs, seen).collect()
    assert {"p_low_quality", "p_toxic", "p_strongly_toxic", "is_toxic"} <= set(got[0].asDict())
    held = [r for r in got if r.doc_id < 300 and r.doc_id % 3 == 0]
    assert sum(r.is_toxic == (r.doc_id % 4 == 0) for r in held) >= 0.97 * len(held)
    assert not any(r.is_toxic for r in got if r.doc_id in (900, 901))
    none = toxicity.score_toxicity(docs, seen.limit(0)).collect()
    assert len(none) == len(got) and not any(r.is_toxic for r in none)


def test_toxicity_sample_keeps_the_class_balance(spark):
    r, rows, labels = random.Random(7), [], []
    for i in range(1800):
        bad = i % 9 == 0
        w = [r.choice(WORDS) + r.choice(WORDS) for _ in range(30)] + (["vile"] if r.random() < (0.7 if bad else 0.15) else [])
        rows.append((i, " ".join(w)))
        labels.append((i, 0, int(bad)))
    docs = spark.createDataFrame(rows, "doc_id bigint, text string")
    seen = spark.createDataFrame(labels, "doc_id bigint, low_quality int, toxic int")
    every, sampled = (toxicity.score_toxicity(docs, seen, most=most).agg(F.avg("p_toxic"), F.avg(F.col("is_toxic").cast("int"))).first() for most in (5000, 200))
    # one in nine is toxic, also where the sample holds as many toxic as clean documents
    assert abs(every[0] - 1 / 9) < 0.04 and abs(sampled[0] - 1 / 9) < 0.06
    found = toxicity.labelled_sample(docs, seen, ("low_quality", "toxic"), "toxic", most=200)
    assert abs(found.weight[found.label_toxic == 0].sum() - 1600) < 300 and found.weight[found.label_toxic == 1].sum() == 200


def test_toxicity_with_null_labels_of_other_categories(spark):
    rows, labels = toxic_rows()
    docs = spark.createDataFrame(rows, "doc_id bigint, text string")
    for nulls in (range(300), range(0, 300, 4)):
        seen = spark.createDataFrame([(i, None if i in nulls else low, toxic) for i, low, toxic in labels if i % 3], "doc_id bigint, low_quality int, toxic int")
        held = [r for r in toxicity.score_toxicity(docs, seen).collect() if r.doc_id % 3 == 0]
        assert sum(r.is_toxic == (r.doc_id % 4 == 0) for r in held) >= 0.97 * len(held)
