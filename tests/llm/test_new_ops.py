"""Phrase collocations, conversation repair and the BPE codec against brute-force versions."""

import hashlib
import heapq
import random
import re
import zlib
from collections import Counter, defaultdict

import numpy as np
import pytest
from pyspark.sql import functions as F

from paysift.llm import bpe_codec, collocations, conversation_repair, queries
from paysift.llm.queries import vocabulary
from tests.llm.test_corpus_ops import SCHEMA, texts

TURNS = "conv_id bigint, turn bigint, role string, text string, conv string, audit string, position string, n string"


def slow_audit(symbols):
    """(cost, audit) by a search over all edit strings in order of cost, then text."""
    keeps = {("", "s"): "s", ("", "u"): "u", ("s", "u"): "u", ("a", "u"): "u", ("u", "a"): "a"}
    after = {"": "u", "s": "u", "a": "u", "u": "a"}
    heap, done = [(0, "", 0, "")], set()
    while True:
        cost, audit, i, last = heapq.heappop(heap)
        if (i, last) in done:
            continue
        done.add((i, last))
        if i == len(symbols) and last in ("", "a"):
            return cost, audit
        heapq.heappush(heap, (cost + 5, audit + "I", i, after[last]))
        if i < len(symbols):
            letter, fault = symbols[i]
            heapq.heappush(heap, (cost + 2, audit + "D", i + 1, last))
            if fault not in ("blank", "duplicate"):
                more = 5 if fault == "truncated" else 0
                if (last, letter) in keeps:
                    heapq.heappush(heap, (cost + more, audit + "K", i + 1, keeps[last, letter]))
                heapq.heappush(heap, (cost + 1 + more, audit + "R", i + 1, after[last]))


def slow_repair(rows):
    """The contract of op12, one conversation at a time."""
    out = []
    for conv in {r[0] for r in rows}:
        said = []
        for _, turn, role, text, *_ in (r for r in rows if r[0] == conv):
            kind = zlib.crc32(f"{' ' if conv is None else conv}:{' ' if turn is None else turn}".encode()) % 20
            role, text = " " if role is None else role, " " if text is None else text
            if kind:
                text = "" if kind == 1 else re.sub("[.!?]", "", text) if kind == 2 else text
                said += [(turn, "user" if kind == 4 else role, text)] * (2 if kind == 3 else 1)
        said.sort(key=lambda r: (r[0] is not None, r[0] or 0, r[1], hashlib.md5(r[2].encode()).hexdigest()))
        faults, seen = [], set()
        for _, role, text in said:
            bare = text.rstrip(" \t\n\x0b\x0c\r")
            faults.append("blank" if not bare else "duplicate" if (role, text) in seen else "truncated" if bare[-1] not in ".!?" else "")
            seen.add((role, text))
        cost, audit = slow_audit([(r[:1], f) for (_, r, _), f in zip(said, faults, strict=True)])
        turns = [t for t, _, _ in said if t is not None]
        made, i, last = [], 0, ""
        for edit in audit:
            role, text = (said[i][1], said[i][2]) if edit != "I" else ("", "")
            i += edit != "I"
            if edit in "IR":
                role = "assistant" if last == "u" else "user"
            if edit != "D":
                made.append(f"{role}:{text}")
                last = role[:1]
        letters = [r[:1] for _, r, _ in said]
        out.append((
            conv, max(turns) - min(turns) + 1 - len(set(turns)) if turns else 0, *(faults.count(f) for f in ("blank", "duplicate", "truncated")),
            sum(a + b not in ("su", "ua", "au") for a, b in zip(letters, letters[1:], strict=False)), cost, audit,
            hashlib.sha256("\n".join(made).encode()).hexdigest(),
        ))
    return out


def turns(seed=5):
    r = random.Random(seed)
    rows = []
    for conv in [*range(60), None]:
        for i in range(r.randrange(0, 25) if conv is not None else 12):
            role = r.choice(["user", "assistant", "user", "assistant", "system", "tool", "", None, "umpire"])
            text = r.choice(["Yes.", "Yes.", "no", "", None, " \n", "What? ", f"Line {i}.", f"part {i}", "日本。", "Ends!\x0c", "nbsp\xa0"])
            rows.append((conv, r.choice([i, i, i, i + 1, None, 7]), role, text, "own", "own", "own", "own"))
    # one conversation with most rows, in long runs of equal symbols
    rows += [(1000, i, "user" if i % 350 < 250 else "assistant", f"t{i}." if i % 5 else "same.", "own", "own", "own", "own") for i in range(700)]
    return rows + [(2000, 1, None, None, *["own"] * 4)]


def test_conversation_repair(spark, tmp_path):
    rows = turns()
    spark.createDataFrame(rows, TURNS).repartition(5).write.parquet(f"{tmp_path}/conversations.parquet")
    got = queries.op12_conversation_repair(spark, str(tmp_path))
    assert got.columns == ["conv_id", "gaps", "blank", "duplicate", "truncated", "illegal", "cost", "audit", "repaired_sha256"]
    order = lambda r: (r[0] is not None, r[0] or 0)
    assert sorted(map(tuple, got.collect()), key=order) == sorted(slow_repair(rows), key=order)


def test_conversation_repair_without_rows(spark, tmp_path):
    spark.createDataFrame([], TURNS).write.parquet(f"{tmp_path}/conversations.parquet")
    assert queries.op12_conversation_repair(spark, str(tmp_path)).count() == 0
    assert conversation_repair.apply_repairs(spark.createDataFrame([], TURNS), conversation_repair.plan_repairs(spark.createDataFrame([], TURNS))).count() == 0


def test_cheapest_edits_of_long_runs():
    r = random.Random(2)
    for _ in range(300):
        runs = [(r.choice("suaxdSUAX"), r.choice([1, 1, 2, 3, 9])) for _ in range(r.randrange(0, 8))]
        flat = [(s.lower(), "blank" if s == "d" else "truncated" if s.isupper() else "") for s, n in runs for _ in range(n)]
        assert conversation_repair.cheapest_edits(runs) == slow_audit(flat)
    cost, audit = conversation_repair.cheapest_edits([("u", 1_000_001), ("a", 1)])
    assert cost == 500_000 and len(audit) == 1_000_002


def strange_texts(seed=1):
    r = random.Random(seed)
    out = ["a" * n for n in range(1, 80)] + ["".join(r.choice("aab") for _ in range(r.randrange(1, 400))) for _ in range(100)]
    out += ["".join(r.choice("abcdefghijklmnopqrstuvwxyzeeettaaoin") for _ in range(r.randrange(30, 3000))) for _ in range(30)]
    kinds = [(32, 127), (0xA0, 0x600), (0x2000, 0x2100), (0x4E00, 0x5000), (0x1F300, 0x1F6FF)]
    rare = [0x301, 0x3A3, 0x130, 0x1AE, 0x212A, 0x1C, 0x85, 10, 32, 32]
    pick = lambda: r.choice([r.randrange(*r.choice(kinds)), r.choice(rare)])
    out += ["".join(chr(pick()) for _ in range(r.randrange(1, 200))) for _ in range(1500)]
    return [*out, "x<|endoftext|>y <|startoftext|><|endoftext|> 's don't I'LL <|End", "h\u0301e\u0301llo e \u0301"]


def test_bpe_codec_equals_the_library():
    from tokenizers import Tokenizer

    path = vocabulary("word_bpe_49k.json")
    whole, codec = Tokenizer.from_file(path), bpe_codec.Codec(path, room=3000)
    made = strange_texts() + [t or "" for t in texts()]
    for lo in range(0, len(made), 200):
        part = made[lo:lo + 200]
        ids = [np.frombuffer(x, "<u4").tolist() for x in codec.encode(part)]
        assert ids == [whole.encode(t, add_special_tokens=False).ids for t in part]
        decoded = codec.table.decode(np.array([i for x in ids for i in x], "int64"), np.array([len(x) for x in ids]))
        assert [d.decode() for d in decoded] == [whole.decode(x, skip_special_tokens=False) for x in ids]


def test_bpe_round_trip(spark):
    from tokenizers import Tokenizer

    path, rows = vocabulary("word_bpe_49k.json"), [(i, t, *["own"] * 6) for i, t in enumerate(texts())]
    whole = Tokenizer.from_file(path)
    docs = spark.createDataFrame([*rows, (None, None, *["own"] * 6), rows[0]], SCHEMA).withColumn("ids", F.lit(1)).withColumn("bpe_text", F.lit("x"))
    got = bpe_codec.round_trip(docs, path)
    assert set(got.columns) == set(docs.columns) - {"bpe_text"} | {"decoded"}
    for r in got.collect():
        want = whole.encode(r.text or "", add_special_tokens=False).ids
        assert np.frombuffer(r.ids, "<u4").tolist() == want and r.decoded == whole.decode(want, skip_special_tokens=False)
    assert got.count() == docs.count() and bpe_codec.round_trip(docs.limit(0), path).count() == 0


def test_bpe_file_with_merges_out_of_order_is_refused():
    with pytest.raises(ValueError):
        bpe_codec.MergeTable._check_order(np.array([3, 0]), np.array([2, 1]), np.array([4, 3]))


def slow_collocations(rows, least, top):
    """The contract of op11 over counts of everything."""
    counts, totals = defaultdict(Counter), Counter()
    for lang, text in rows:
        lang = "und" if lang is None else lang
        for piece in re.split("[.,;:!?\n\x0b\x0c\r]", "".join(c.lower() if "A" <= c <= "Z" else c for c in text or "")):
            words = re.findall("[^ \t]+", piece)
            totals[lang] += len(words)
            for m in range(1, 5):
                counts[lang].update(tuple(words[i:i + m]) for i in range(len(words) - m + 1))
    out = []
    for lang, f in counts.items():
        often = {p: n for p, n in f.items() if n >= least and len(p) > 1}
        gone = {p[i:i + m] for p, n in often.items() for m in range(2, len(p)) for i in range(len(p) - m + 1) if 100 * n >= 80 * f[p[i:i + m]]}
        best = []
        for p, a in often.items():
            score, k = min((2_000_000 * a // (f[p[:k]] + f[p[k:]]), k) for k in range(1, len(p)))
            if p not in gone:
                best.append((-score, -a, " ".join(p).encode(), f[p[:k]], f[p[k:]]))
        for i, (score, a, phrase, left, right) in enumerate(sorted(best)[:top]):
            out.append((lang, i + 1, phrase.decode(), -a, left, right, totals[lang], -score))
    return sorted(out)


def phrases(seed, n_words, n):
    r = random.Random(seed)
    words = [a + b for a in "the of é in A be To 日本 x-y nbsp\xa0z".split(" ") for b in ("", "s", "ing", "ed")][:n_words]
    weights = [1 / (i + 1) for i in range(len(words))]
    fixed = [" ".join(r.choices(words, weights, k=r.randrange(2, 7))) for _ in range(12)]
    out = []
    for _ in range(n):
        part = [r.choice(fixed) if r.random() < 0.4 else r.choices(words, weights)[0] for _ in range(r.randrange(1, 60))]
        out.append("".join(p + r.choice([" "] * 12 + ["\t", ". ", ", ", "\n", "; "]) for p in part))
    return out


def collocation_docs(n=60):
    made = [(lang, t) for i, lang in enumerate(("en", "fr", None, "und")) for t in phrases(i, 24, n)]
    return made + [("en", None), ("en", ""), ("xx", "only one line"), ("en", " . ,\n"), (None, made[0][1]), made[0], made[0]]


@pytest.mark.parametrize(("least", "top"), [(3, 25), (2, 400), (5, 1), (30, 2000)])
def test_collocations(spark, least, top):
    rows = collocation_docs()
    docs = spark.createDataFrame([(*r, "own", "own", 1) for r in rows], "lang string, text string, phrase string, rank string, n int").repartition(3)
    got = collocations.mine(docs, least=least, top=top, bits=1 << 15)
    assert sorted(map(tuple, got.collect())) == slow_collocations(rows, least, top)


def test_collocations_of_nothing(spark):
    assert collocations.mine(spark.createDataFrame([], "lang string, text string")).count() == 0
    assert collocations.mine(spark.createDataFrame([(None, None), ("en", "a b")], "lang string, text string")).count() == 0


def test_collocations_grow_only_what_can_be_reported(spark, monkeypatch):
    """Phrases whose prefix scores too low are never counted."""
    rows = [("en", t) for t in phrases(9, 40, 400)]
    seen = []
    plain = collocations._counted
    monkeypatch.setattr(collocations, "_counted", lambda texts, step, *sets: seen.append(out := plain(texts, step, *sets)) or out)
    docs = spark.createDataFrame(rows, "lang string, text string")
    assert sorted(map(tuple, collocations.mine(docs, least=5, top=5).collect())) == slow_collocations(rows, 5, 5)
    counted = {r.phrase for df in seen[2:] for r in df.where("n >= 5").collect()}
    all_longer = Counter(tuple(w[i:i + m]) for _, t in rows for p in re.split("[.,;:!?\n\r]", t.replace("A", "a").replace("T", "t")) for w in [re.findall("[^ \t]+", p)] for m in (3, 4) for i in range(len(w) - m + 1))
    assert len(counted) < sum(n >= 5 for n in all_longer.values())
