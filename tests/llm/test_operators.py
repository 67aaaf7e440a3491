"""Each operator against a brute-force version, and on nulls, empty and long texts, ties, repeated rows, empty tables and clashing columns."""

import base64
import hashlib
import math
import random
import re
import time
import tracemalloc
import zlib
from collections import Counter

import numpy as np
import public_tokenizers
import pyarrow as pa
import pytest
import tiktoken
import xxhash
from pyspark.sql import functions as F

from metaloom.llm import ann, bpe, common, components, decontaminate, html, lm, pii, quality, simhash, toxicity, warc

PATH, PATTERN = public_tokenizers.path("byte_bpe_50k.tiktoken"), public_tokenizers.PATTERN
#: Columns whose names clash with those that operators use inside or return.
CLASH = ", 'x' AS fp, 'y' AS score, 1 AS held, 2 AS row, 'z' AS spans, 3 AS k, 4 AS y, 'q' AS chunk"


@pytest.fixture(scope="module")
def docs(spark):
    rng = random.Random(3)
    word = lambda: "".join(rng.choice(["ba", "ke", "lo", "mi", "ru"]) for _ in range(rng.randint(1, 3)))
    rows = [(i, " ".join(word() for _ in range(rng.randint(1, 60)))) for i in range(60)]
    rows += [(60, None), (61, ""), (62, " \n\t "), (63, rows[0][1]), (63, rows[0][1]), (None, rows[1][1]), (64, "x" * 200_000), (65, " ".join(["w" + str(i) for i in range(30_000)])), (66, "don't 12 ?? é\U0001f600 [x](y)")]
    return spark.createDataFrame(rows, "doc_id long, text string").repartition(5).selectExpr("*", *(x.strip() for x in CLASH.strip(", ").split(",")))


def empty(spark):
    return spark.createDataFrame([], "doc_id long, text string")


def texts_of(docs):
    return [(r[0], r[1] or "") for r in docs.select("doc_id", "text").collect()]


# ---------------------------------------------------------------- BPE


def library():
    ranks = {base64.b64decode(a): int(b) for a, b in map(bytes.split, open(PATH, "rb"))}
    return tiktoken.Encoding("own", pat_str=PATTERN, mergeable_ranks=ranks, special_tokens={})


def test_bpe_equals_the_library_and_round_trips(spark, docs):
    lib = library()
    enc = bpe.encode(docs, PATH, PATTERN, digests=True).cache()
    want = Counter((i, tuple(lib.encode_ordinary(t))) for i, t in texts_of(docs))
    got = Counter((r.doc_id, tuple(r.ids)) for r in enc.collect())
    assert got == want
    for r in enc.collect():
        assert r.n_tokens == len(r.ids)
        assert r.ids_sha256 == hashlib.sha256(np.array(r.ids, "<u4").tobytes()).hexdigest()
    back = Counter((r.doc_id, bytes(r.decoded)) for r in bpe.decode(enc, PATH, PATTERN).collect())
    assert back == Counter((i, t.encode()) for i, t in texts_of(docs))


def test_bpe_folds_agree(spark):
    ranks, rng = bpe.load_ranks(PATH), random.Random(1)
    words = ["", "a", " the", "ééé", "\U0001f600", *("".join(rng.choice("abcdehiost ") for _ in range(n)) for n in (3, 9, 30, 199, 260))]
    for w in words[1:]:
        parts = [w.encode()[i : i + 1] for i in range(len(w.encode()))]
        assert bpe._fold_long(list(parts), ranks) == (bpe.fold_merges(w.encode(), ranks) if len(parts) <= 200 else library()._encode_single_piece(w))
    native = {r.word: r.ids for r in bpe.encode_words_native(spark.createDataFrame([(w,) for w in words[:7]], "word string"), PATH).collect()}
    assert native == {w: (bpe.fold_merges(w.encode(), ranks) if w else []) for w in words[:7]}


def test_bpe_of_an_empty_table(spark):
    assert bpe.encode(empty(spark), PATH, PATTERN).collect() == []


# ---------------------------------------------------------------- SimHash


def brute_fingerprint(text):
    w = re.findall(r"[^\x20\x09-\x0D]+", re.sub("[A-Z]", lambda m: m[0].lower(), text))
    shingles = [" ".join(w[i : i + 3]) for i in range(len(w) - 2)] if len(w) >= 3 else [" ".join(w)] * bool(w)
    counts = [0] * 64
    for s in shingles:
        h = xxhash.xxh64_intdigest(s.encode(), 42)
        for k in range(64):
            counts[k] += h >> k & 1
    return sum(1 << k for k in range(64) if 2 * counts[k] > len(shingles))


def brute_components(ids, values, bits):
    root = list(range(len(ids)))
    find = lambda x: x if root[x] == x else find(root[x])
    for i in range(len(ids)):
        for j in range(i):
            if (values[i] ^ values[j]).bit_count() <= bits:
                a, b = sorted((find(i), find(j)))
                root[b] = a
    groups = {}
    for i in range(len(ids)):
        if ids[i] is not None:
            groups[find(i)] = min(groups.get(find(i), ids[i]), ids[i])
    return [groups.get(find(i)) for i in range(len(ids))]


def test_simhash_equals_brute_force(spark, docs):
    rows = texts_of(docs)
    fps = [brute_fingerprint(t) for _, t in rows]
    want = Counter((i, f, c) for (i, _), f, c in zip(rows, fps, brute_components([i for i, _ in rows], fps, 2)))
    got = Counter((r.doc_id, r.fp % 2**64, r.component_id) for r in simhash.near_duplicates(docs).collect())
    assert got == want


def test_links_of_planted_fingerprints(spark):
    rng = np.random.default_rng(0)
    base = rng.integers(0, 2**63, 300, dtype=np.uint64)
    rows, n = [], 0
    for f in base:
        for _ in range(3):
            flip = sum(1 << int(b) for b in rng.choice(64, rng.integers(0, 4), replace=False))
            rows.append((int(f) ^ flip, n))
            n += 1
    unique = dict(rows)
    df = spark.createDataFrame([(f - 2**64 if f >= 2**63 else f, r, 0) for f, r in unique.items()], "fp long, doc_id long, hash long")
    comp = {r.fp % 2**64: r.best.id for r in simhash.classes(df, "doc_id", 2, common.Scratch(spark)).collect()}
    items = sorted((r, f) for f, r in unique.items())
    want = brute_components([r for r, _ in items], [f for _, f in items], 2)
    assert [comp[f] for _, f in items] == want


def test_rows_without_an_id_link_others(spark, monkeypatch):
    values = {"a": 0, "b": 3, "c": 15, "d": 255 << 8, "e": 255 << 20}
    monkeypatch.setattr(simhash, "fingerprint", lambda t, words=3: values[t])
    rows = [(5, "a"), (None, "b"), (8, "c"), (None, "d"), (None, "d"), (9, "e")]
    own = spark.createDataFrame([(i, hash(t) % 99, values[t]) for i, t in rows], "doc_id long, hash long, fp long")
    got = {r.fp: r.best.id for r in simhash.classes(own, "doc_id", 2, common.Scratch(spark)).collect()}
    assert got == {0: 5, 3: 5, 15: 5, 255 << 8: None, 255 << 20: 9}


def test_partitions_of_every_size_go_by_the_pivot_table(monkeypatch):
    mask = simhash.masks(2)[0]
    free = [i for i in range(64) if not mask >> i & 1]
    rng = np.random.default_rng(1)
    fp = np.unique(np.array([sum(1 << free[int(b)] for b in rng.choice(16, rng.integers(0, 9), replace=False)) for _ in range(3000)], np.uint64))
    assert len(fp) ** 2 > 50 * simhash.PAIRS
    want = {(i, int(j)) for i in range(len(fp)) for j in np.flatnonzero(np.bitwise_count(fp[i + 1 :] ^ fp[i]) <= 2) + i + 1}
    for n in (1, 2, 200, 900, len(fp)):
        got = [tuple(sorted(p)) for a, b in simhash.close_pairs(fp[:n], 2, simhash.pivots()) for p in zip(a.tolist(), b.tolist())]
        assert len(got) == len(set(got)) and set(got) == {(i, j) for i, j in want if j < n}
    ball = np.array([0] + [1 << i for i in range(64)], np.uint64)
    far = np.concatenate([ball, ~ball])
    assert sum(len(a) for a, _ in simhash.close_pairs(far, 2, simhash.pivots())) == 2 * 65 * 64 // 2
    assert simhash.roots(far, 2, simhash.pivots()).tolist() == [0] * 65 + [65] * 65
    monkeypatch.setattr(simhash, "MERGE", 100)
    assert simhash.roots(fp, 2, simhash.pivots()).tolist() == brute_components(list(range(len(fp))), fp.tolist(), 2)


def test_long_chains_are_one_component(spark):
    pairs = spark.createDataFrame([(i, i + 1) for i in range(200)] + [(500, 501)], "a long, b long")
    out = {r.v: r.p for r in components.components(pairs, common.Scratch(spark)).collect()}
    assert out == {i: 0 for i in range(201)} | {500: 500, 501: 500}


def test_simhash_of_an_empty_table_and_deduplication(spark, docs):
    assert simhash.near_duplicates(empty(spark)).collect() == []
    kept = simhash.deduplicate(docs)
    assert kept.columns == docs.columns
    rows = texts_of(docs)
    groups = {}
    for (i, t), c in zip(rows, brute_components(list(range(len(rows))), [brute_fingerprint(t) for _, t in rows], 2)):
        groups.setdefault(c, []).append((i is None, i if i is not None else 0))
    assert Counter(r.doc_id for r in kept.collect()) == Counter(min(g)[1] if not min(g)[0] else None for g in groups.values())


def test_deduplication_keeps_one_row_of_each_group(spark):
    a, b, c = "one two three four", "completely other words here", "a third text of its own"
    rows = [(3, a), (7, a), (7, b), (None, a), (None, c), (None, c), (9, b), (11, None), (12, ""), (3, a), (3, a)]
    kept = simhash.deduplicate(spark.createDataFrame(rows, "doc_id long, text string").selectExpr("*", "1 AS hash", "2 AS kept_id", "3 AS fp"))
    assert Counter((r.doc_id, r.text) for r in kept.collect()) == Counter([(3, a), (7, b), (None, c), (11, None)])


# ---------------------------------------------------------------- decontamination


@pytest.fixture(scope="module")
def planted(spark):
    rng = random.Random(5)
    vocab = ["".join(rng.choice("aeioubcdfglmnprst") for _ in range(rng.randint(2, 7))) for _ in range(4000)]
    items = [(i, [rng.choice(vocab) for _ in range(rng.choice([6, 15, 25, 40, 59]))]) for i in range(40)]
    docs, truth = [], set()
    for d in range(240):
        words = [rng.choice(vocab) for _ in range(rng.randint(0, 200))]
        if d % 2:
            i, own = items[rng.randrange(40)]
            own, edits = list(own), rng.randint(0, decontaminate.edits_allowed(len(own), 0.8) // 2)
            for _ in range(edits):
                at = rng.randrange(len(own))
                own[at : at + 1] = rng.choice([[], [own[at], "zzz"], ["qqq"]])
            at = rng.randint(0, len(words))
            words[at:at] = own
            truth.add((d, i))
        docs.append((d, " ".join(w.capitalize() + rng.choice(["", ",", "&&&"]) for w in words)))
    docs += [(900, None), (901, ""), (902, " ".join(vocab * 3))]
    bench = [(i, " ".join(w)) for i, w in items] + [(98, None), (99, "")]
    return spark.createDataFrame(docs, "doc_id long, text string").withColumn("item_id", F.lit(1)), spark.createDataFrame(bench, "item_id long, text string").withColumn("doc_id", F.lit(2)), truth


def words_distance(item, text):
    row = [0] * (len(text) + 1)
    for i, w in enumerate(item, 1):
        new = [i]
        for j, v in enumerate(text, 1):
            new.append(min(row[j - 1] + (w != v), row[j] + 1, new[j - 1] + 1))
        row = new
    return min(row)


def test_decontamination_against_all_windows(spark, planted):
    docs, bench, truth = planted
    got = {(r.doc_id, r.item_id): r for r in decontaminate.contaminated(docs, bench).collect()}
    items = {r.item_id: decontaminate.words_of(r.text or "") for r in bench.collect()}
    texts = {r.doc_id: decontaminate.words_of(r.text or "") for r in docs.collect()}
    want = {(d, i) for d, t in texts.items() if d < 120 for i, w in items.items() if w and words_distance(w, t) <= decontaminate.edits_allowed(len(w), 0.8)}
    assert {p for p in got if p[0] < 120} <= want
    assert len(want & set(got)) >= 0.97 * len(want)
    assert len(truth & set(got)) >= 0.97 * len(truth)
    for (d, i), r in got.items():
        assert r.edits == words_distance(items[i], texts[d]) == words_distance(items[i], texts[d][r.start_word : r.end_word])
    clean = decontaminate.decontaminate(docs, bench)
    assert clean.columns == docs.columns
    assert {r.doc_id for r in clean.collect()} == set(texts) - {d for d, _ in got}


def test_decontamination_finds_every_item_at_the_full_bound(spark):
    rng = random.Random(8)
    vocab = ["".join(rng.choice("aeioubcdfglmnprst") for _ in range(7)) for _ in range(4000)]
    items, docs = [], []
    for size in (*range(5, 25), 35, 59, 120):
        for _ in range(12):
            item = [rng.choice(vocab) for _ in range(size)]
            own, most = list(item), decontaminate.edits_allowed(size, 0.8)
            spots = range(size // 2 - most // 2, size // 2 - most // 2 + most) if len(items) % 3 == 0 else rng.sample(range(size), most)
            for at in sorted(spots, reverse=True):
                own[at : at + 1] = rng.choice([["qqq"], [rng.choice(vocab)], [], [own[at], "zzz"]])
            if len(items) % 5 == 0:
                own = item[most:]
            docs.append((len(items), " ".join(own if len(items) % 5 == 0 else [*rng.choices(vocab, k=30), *own, *rng.choices(vocab, k=30)])))
            items.append((len(items), " ".join(item)))
    df = lambda rows, name: spark.createDataFrame(rows, f"{name} long, text string").coalesce(1)
    got = {(r.doc_id, r.item_id) for r in decontaminate.contaminated(df(docs, "doc_id"), df(items, "item_id")).collect()}
    assert {(i, i) for i, _ in items} <= got


@pytest.mark.parametrize("size", [8, 12, 15, 16, 17, 19, 25, 40])
def test_walks_and_sampled_keys_alone_reach_their_target_recall(size):
    rng = np.random.default_rng(size)
    vocab = [f"w{i}" for i in range(3000)]
    draw = lambda n: [vocab[i] for i in rng.integers(0, len(vocab), n)]
    items, edits, hits, tries = [draw(size) for _ in range(40)], decontaminate.edits_allowed(size, decontaminate.SIMILARITY), 0, 0
    index = decontaminate.Index([(i, " ".join(w)) for i, w in enumerate(items)])
    for i, item in enumerate(items):
        for kind in ("substitute", "insert", "delete", "any"):
            own = list(item)
            for at in sorted(rng.choice(size, edits, replace=False).tolist(), reverse=True):
                what = ("substitute", "insert", "delete")[rng.integers(3)] if kind == "any" else kind
                own[at : at + (what != "insert")] = [] if what == "delete" else draw(1)
            text = draw(30) + own + draw(30)
            found = index.places(np.array([index.vocab.get(w, 0) for w in text] + [0] * decontaminate.BLOCK, np.int32))
            hits += any(abs(s - 30) <= edits for s in found.get(i, ()))
            tries += 1
    assert hits / tries >= decontaminate.TARGET


def test_decontamination_in_pieces_and_with_ids_of_any_type(spark, planted, monkeypatch):
    docs, bench, _ = planted
    want = Counter(tuple(r) for r in decontaminate.contaminated(docs, bench).collect())
    monkeypatch.setattr(decontaminate, "ITEMS_AT_ONCE", 12)
    assert Counter(tuple(r) for r in decontaminate.contaminated(docs, bench).collect()) == want
    monkeypatch.undo()
    same = decontaminate.contaminated(docs.select(F.col("doc_id").cast("smallint").alias("id"), "text"), bench.select(F.col("item_id").cast("string").alias("id"), "text"), id_col="id", item_col="id")
    assert same.columns[:2] == ["id", "item_id"]
    assert Counter((r.id, int(r.item_id), *r[2:]) for r in same.collect()) == want


def test_pieces_are_bounded_in_rows_and_bytes():
    b = pa.RecordBatch.from_pydict({"t": ["x" * n for n in (5, 3000, 10, 4000, 1, 1, 1)]})
    got = list(common.pieces([b], 4, 3500))
    assert all(x.num_rows <= 4 and (x.num_rows == 1 or x.nbytes <= 3500) for x in got) and [t for x in got for t in x.to_pydict()["t"]] == b.to_pydict()["t"]


def test_decontamination_of_empty_tables(spark, planted):
    docs, bench, _ = planted
    assert decontaminate.contaminated(empty(spark), bench).collect() == []
    none = bench.where("item_id < 0")
    assert decontaminate.contaminated(docs, none).collect() == []
    assert decontaminate.decontaminate(docs, none).count() == docs.count()


# ---------------------------------------------------------------- personal data


BASE = [
    ("email", r"[A-Za-z0-9._%+-]+@[A-Za-z0-9-]+(\.[A-Za-z0-9-]+)+", lambda s: True),
    ("ip", r"[0-9]+(\.[0-9]+)(\.[0-9]+)(\.[0-9]+)", lambda s: all(int(p) <= 255 for p in s.split("."))),
    ("card", r"[0-9]([\x20-]?[0-9])+", lambda s: 16 <= len(d := re.sub(r"\D", "", s)) <= 19 and sum(int(c) if i % 2 == 0 else sum(divmod(2 * int(c), 10)) for i, c in enumerate(d[::-1])) % 10 == 0),
    ("phone", r"\+[0-9][\x20().0-9-]+[0-9]", lambda s: 8 <= len(re.sub(r"\D", "", s)) <= 15),
]


def brute_spans(t):
    return ",".join(f"{k}:{m.start()}:{m.end()}" for k, p, ok in BASE for m in re.finditer(p, t) if ok(m[0]))


def test_base_spans_equal_the_patterns():
    rng = random.Random(9)
    for _ in range(3000):
        t = "".join(rng.choice(["a", "@", ".", "b.c", "1", "22", "256", "+", " ", "-", "4111111111111111", "é", "(", ")", "%", "\n", "x@y.zz", "10.0.0.1"]) for _ in range(rng.randint(0, 25)))
        assert pii.span_text(pii.base_spans(t)) == brute_spans(t), t
    long = "a" * 200_000 + "@" + "1" * 200_000 + " " + "+1" + " " * 100_000
    assert pii.span_text(pii.base_spans(long)) == ""


def test_contextual_extraction_finds_what_patterns_point_at(spark):
    rows = [(i, f"word{i} filler text, call me +1 202 555 0{i:03d} or not") for i in range(30)] + [(i, f"word{i} again please call me 0202-555-{i:04d} thanks") for i in range(30, 36)]
    rows += [(100, "an order of 0202-555-9999 pieces"), (101, None), (102, ""), (103, "é mail ann@example.org, ann@example.org")]
    docs = spark.createDataFrame(rows, "doc_id long, text string").selectExpr("*", "'x' AS base", "1 AS row", "2 AS kind")
    out = {r.doc_id: r for r in pii.find(docs).collect()}
    assert len(out) == len(rows)
    for i, t in rows:
        base = brute_spans(t or "")
        assert out[i].base == base and set(filter(None, base.split(","))) <= set(out[i].spans.split(","))
    found = {i for i, r in out.items() if r.n_found}
    assert found == set(range(30, 36))
    start = rows[30][1].index("0202")
    assert out[30].spans == f"phone:{start}:{start + 13}"
    clean = {r.doc_id: r.text for r in pii.redact(docs).select("doc_id", "text").collect()}
    assert clean[30] == "word30 again please call me <phone> thanks" and clean[103] == "é mail <email>, <email>" and clean[101] is None and clean[100] == rows[36][1]
    assert pii.find(empty(spark)).collect() == [] and pii.redact(empty(spark)).collect() == []


def filler(rng):
    return " ".join("".join(rng.choice("abcdefgh") for _ in range(5)) for _ in range(4))


def test_found_instances_induce_new_patterns(spark):
    """Phones after "call me" are seeds; loose ones there are found; those also stand after "my line", which finds others; decoys stay."""
    rng, rows = random.Random(6), []
    rows += [f"{filler(rng)} call me +1 202 555 {i:04d} {filler(rng)}" for i in range(90)]
    rows += [f"{filler(rng)} call me 0303-777-{i:04d} {filler(rng)}" for i in range(15)]
    rows += [f"{filler(rng)} my line (0303) 777-{i:04d} {filler(rng)}" for i in range(15)]
    rows += [f"{filler(rng)} my line 0404-888-0001 {filler(rng)}", f"{filler(rng)} the order 0505-999-0001 {filler(rng)}"]
    rows += [f'{filler(rng)} token = "04dbebab91ab85687d33eeaaf9ac{i:04d}" {filler(rng)}' for i in range(3)]
    rows += [f"{filler(rng)} mail ann{i}@example.org {filler(rng)}" for i in range(20)] + [f"{filler(rng)} mail bob [at] example [dot] org {filler(rng)}"]
    rows += [f"{filler(rng)} form 4111 1111 1111 1111 {filler(rng)}", f"{filler(rng)} 4111.1111.1111.1111 {filler(rng)}"]
    docs = spark.createDataFrame(list(enumerate(rows)), "doc_id long, text string")
    found = {r.doc_id: [(x.split(":")[0], rows[r.doc_id][int(x.split(":")[1]) : int(x.split(":")[2])]) for x in r.found.split(",")] for r in pii.find(docs).where("n_found > 0").collect()}
    want = {90 + i: [("phone", f"0303-777-{i:04d}")] for i in range(15)} | {105 + i: [("phone", f"(0303) 777-{i:04d}")] for i in range(15)} | {120: [("phone", "0404-888-0001")]}
    want |= {122 + i: [("secret", f"04dbebab91ab85687d33eeaaf9ac{i:04d}")] for i in range(3)} | {145: [("email", "bob [at] example [dot] org")], 147: [("card", "4111.1111.1111.1111")]}
    assert found == want
    clean = pii.redact(docs.selectExpr("*", "1 AS _id", "2 AS _hash", "3 AS spans", "4 AS i", "5 AS `h`", "6 AS `a.b`"))
    assert clean.columns == ["doc_id", "text", "_id", "_hash", "spans", "i", "h", "a.b"]
    text = {r.doc_id: r.text for r in clean.collect()}
    assert "my line <phone> " in text[120] and text[121] == rows[121] and 'token = "<secret>"' in text[122]


def brute_trust(cands):
    """Confidences by plain loops over (kind, loose kinds, pattern, instance)."""
    nodes, seeds = {}, {}
    for k, loose, p, i in cands:
        a, b = nodes.get((p, i), (-1, 0))
        nodes[p, i] = (max(a, k), max(b, loose))
    for (p, i), (k, _) in nodes.items():
        if k >= 0:
            seeds.setdefault((i, k), 1.0)
    size, known = Counter(p for p, _ in nodes), dict(seeds)
    given = {(p, 4): 1.0 for name in pii.SECRET_NAMES for p in (f"1< {name}", f"2< {name} =", f"2< {name} is")}
    for _ in range(pii.ROUNDS):
        support = {}
        for p, i in nodes:
            for (j, k), belief in known.items():
                if i == j:
                    support.setdefault((p, k), []).append(belief)
        trust = {key: sum(v) / (size[key[0]] + 1) for key, v in support.items() if len(v) >= pii.MIN_SEEDS and sum(v) / (size[key[0]] + 1) >= pii.MIN_CONFIDENCE}
        trust = {key: max(trust.get(key, 0), given.get(key, 0)) for key in trust.keys() | given.keys()}
        side = {}
        for (p, i), (k, loose) in nodes.items():
            for kind in range(5):
                if k < 0 and loose >> kind & 1 and (p, kind) in trust:
                    at = (i, kind, p[1])
                    side[at] = max(side.get(at, 0), trust[p, kind])
        belief = {}
        for (i, kind, _), c in side.items():
            belief[i, kind] = 1 - (1 - belief.get((i, kind), 0)) * (1 - min(c, 1 - 1e-9))
        grown = dict(seeds)
        for i in {i for i, _ in belief} - {i for i, _ in seeds}:
            b, kind = max((b, -kind) for (j, kind), b in belief.items() if j == i)
            grown[i, -kind] = b
        known = grown
    return trust


def test_pattern_scores_equal_plain_loops(spark):
    rng, rows = random.Random(11), []
    for i in range(400):
        kind = rng.choice([-1, -1, 0, 1, 3])
        place = rng.randrange(6)
        for p in (f"1< w{place if rng.random() < 0.9 else rng.randrange(6)}", f"1> v{place}"):
            rows.append((kind if rng.random() < 0.8 else -1, 0 if kind >= 0 else rng.choice([1, 2, 8, 9, 16]), p, rng.randrange(150)))
    rows += [(3, 0, "1< call", 1000 + i) for i in range(80)] + [(-1, 8, "1< call", 2000 + i) for i in range(12)] + [(-1, 8, "1> soon", 2000 + i) for i in range(12)] + [(-1, 8, "1> soon", 3000)]
    got = {(r.pattern, r.kind): r.confidence for r in pii.score_patterns(spark.createDataFrame(rows, "k int, loose int, pattern string, inst long"), common.Scratch(spark))[0].collect()}
    want = brute_trust(rows)
    assert got.keys() == want.keys() and ("1> soon", 3) in got
    assert all(abs(got[k] - want[k]) < 1e-9 for k in got)


# ---------------------------------------------------------------- neighbours


def in_order(a, b):
    total = 0.0
    for x, y in zip(a, b):
        total += x * y
    return total


def test_neighbours_equal_brute_force(spark, monkeypatch):
    rng = np.random.default_rng(2)
    v = rng.normal(size=(700, 16)).astype(np.float32)
    v[3] = v[40]
    v[100:140] = v[7]
    v[200:210] *= np.float32(1e15)
    v[300:310] *= np.float32(1e-15)
    rows = [(i, [float(x) for x in v[i]]) for i in range(700)]
    rows += [(20, [float(x) for x in v[9]]), (41, [float(x) for x in -v[41]])]  # ids again, with other vectors
    bad = [(2000, None), (2020, []), (2040, [0.0] * 16), (2060, [float("nan")] * 16), (2080, [1.0] * 15 + [None]), (2100, [float("inf")] * 16), (None, [1.0] * 16), (2120, [1.0, 2.0])]
    df = spark.createDataFrame(rows + bad + rows[:50], "vec_id long, embedding array<float>").selectExpr("*", "1 AS score", "2 AS d", "3 AS row")
    want, every = Counter(), rows + rows[:50]
    wide = np.array([x for _, x in every])
    for n, (q, x) in enumerate(every):
        if q % 20 == 0:
            s = np.zeros(len(every))
            for k in range(16):
                s += x[k] * wide[:, k]
            best = sorted((-float(s[i]), every[i][0]) for i in range(len(every)) if i != n)[:20]
            want.update((q, k, i, -t) for k, (t, i) in enumerate(best, 1))
    for size in (ann.CELL_BYTES, 3000):
        monkeypatch.setattr(ann, "CELL_BYTES", size)
        monkeypatch.setattr(ann, "TILE", 64)
        assert Counter(tuple(r) for r in ann.nearest(df, F.col("vec_id") % 20 == 0, 20).collect()) == want


def test_a_cell_holds_tiles_not_products(monkeypatch):
    rng = np.random.default_rng(5)
    v = rng.normal(size=(5000, 32)) * 10.0 ** rng.integers(-2, 3, (5000, 1))
    v[100:160] = v[7]
    v[300:2300] = v[8] * 3
    had = (np.arange(5000), *ann.quantise(v))
    asked = tuple(x[::2] for x in had)
    for tile in (ann.TILE, 64):
        monkeypatch.setattr(ann, "TILE", tile)
        tracemalloc.start()
        q, c, low, high = ann.best_of_cell(tuple(x[:40] for x in asked), had, 20)
        best = np.sort(np.where(had[0] == asked[0][:40, None], -np.inf, v[::2][:40] @ v.T), axis=1)[:, -20]
        exact = (v[::2][q] * v[c]).sum(axis=1)
        assert (low <= exact).all() and (exact <= high).all() and not (asked[0][q] == c).any()
        for i in range(40):
            want = set(np.flatnonzero((v[2 * i] @ v.T > best[i] * (1 + 1e-12 * np.sign(best[i]))) & (had[0] != 2 * i)).tolist())
            assert want <= set(c[q == i].tolist()) and (q == i).sum() >= 20
        side = lambda x, n: (*x[1:4], *ann.finer(v[x[0][:n]], *x[1:3]))
        fq, fc, flow, fhigh = ann.refined(q, c, side(tuple(x[:40] for x in asked), 40), side(had, 5000), 20)
        exact = (v[::2][fq] * v[fc]).sum(axis=1)
        assert (flow <= exact).all() and (exact <= fhigh).all() and len(fq) <= len(q) and np.median(fhigh - flow) * 50 < np.median(high - low)
        for i in range(40):
            assert set(c[q == i][(v[c[q == i]] @ v[2 * i]) > best[i] * (1 + 1e-12 * np.sign(best[i]))].tolist()) <= set(fc[fq == i].tolist()) and (fq == i).sum() >= 20
        tracemalloc.reset_peak()
        few = tuple(x[2300:] for x in had)
        assert len(ann.best_of_cell(asked, few, 20)[0]) >= 20 * 2500
        assert tracemalloc.get_traced_memory()[1] < 100 << 20  # 2,500 x 2,048 products in double precision alone are 41 MB, and there were several
        tracemalloc.stop()


def test_bounds_hold_with_rounding_at_many_dimensions():
    rng = np.random.default_rng(3)
    for d in (3, 64, 3000):
        v = rng.normal(size=(60, d)) * 10.0 ** rng.integers(-3, 4, (60, 1))
        q, *rest = ann.quantise(v)
        low, high = ann.bounds(q.astype(np.float32), *rest, q.astype(np.float32), *rest)
        exact = np.array([[math.fsum(a * b) for b in v] for a in v])
        assert (low <= exact).all() and (exact <= high).all() and (high - low < 0.1 * np.outer(rest[1], rest[1]) + 1e-9).all()


def test_neighbours_of_few_and_no_vectors(spark):
    df = spark.createDataFrame([(0, [1.0, 0.0]), (1, [0.5, 0.5]), (2, [0.5, 0.5])], "vec_id long, embedding array<float>")
    assert [(r.query_id, r.rank, r.vec_id) for r in ann.nearest(df, F.col("vec_id") % 20 == 0, 20).orderBy("rank").collect()] == [(0, 1, 1), (0, 2, 2)]
    assert ann.nearest(df.where("vec_id < 0"), F.col("vec_id") % 20 == 0, 20).collect() == []


# ---------------------------------------------------------------- classifiers


@pytest.fixture(scope="module")
def sf(spark):
    return "/root/testdata/sf0.01"


def auc(pairs):
    pos, neg = [s for s, y in pairs if y], [s for s, y in pairs if not y]
    return sum((p > n) + 0.5 * (p == n) for p in pos for n in neg) / (len(pos) * len(neg))


def test_quality_on_held_out_labels(spark, sf):
    docs, labels = common.table(spark, sf, "documents"), common.table(spark, sf, "labels")
    model = quality.train(docs, labels)
    out = quality.score(docs, model).join(labels, "doc_id").where(common.crc_mod(F.col("doc_id"), 5) == 0).collect()
    assert auc([(r.score, r.quality) for r in out]) > 0.95


def test_rules_compile_to_what_they_hold(spark):
    rng = np.random.default_rng(4)
    x = rng.random((500, len(quality.STATISTICS)))
    y = ((x[:, 0] > 0.5) & (x[:, 3] <= 0.6)).astype(float)
    model = quality.fit(x, y)
    df = spark.createDataFrame([(i, *map(float, v)) for i, v in enumerate(x)], ["i", *quality.STATISTICS])
    got = {r.i: r.s for r in df.select("i", model.column().alias("s")).collect()}
    z = np.full(500, model.intercept) + sum(w * rule.holds(x) for rule, w in model.rules)
    assert np.allclose([got[i] for i in range(500)], 1 / (1 + np.exp(-z)))
    assert ((z > 0) == (y > 0)).mean() > 0.97
    assert 0 < len(model.rules) < len(quality.extract_rules(x, y))


def test_classifiers_on_odd_tables(spark, docs):
    none = spark.createDataFrame([], "doc_id long, quality int, toxic int")
    one = spark.createDataFrame([(i, 1, 1) for i in range(9)] + [(None, 0, 0), (3, None, None)], "doc_id long, quality int, toxic int")
    for labels in (none, one):
        for out in (quality.score(docs, quality.train(docs, labels)), toxicity.score(docs, toxicity.train(docs, labels))):
            rows = out.collect()
            assert len(rows) == docs.count() and all(0 <= r.score <= 1 and r.predicted in (0, 1) for r in rows)
    assert quality.score(empty(spark), quality.train(empty(spark), one)).collect() == []
    assert toxicity.score(empty(spark), toxicity.train(empty(spark), one)).collect() == []


@pytest.fixture(scope="module")
def toxic(spark, sf):
    return toxicity.train(common.table(spark, sf, "documents"), common.table(spark, sf, "labels"))


def test_deobfuscation(toxic):
    read = toxicity.Reader(toxic.characters)
    for raw in ("idiot", "1diot", "id1ot", "idi0t", "!d!ot", "IDIOT!!", "i.d.i.o.t", "iiidiooot", "i d i o t", "I-D-I-O-T", "idiot$$$", "idiot&&&", "idiot,"):
        assert "idiot" in read.text(f"the {raw} and").split(), raw
    for plain in ("the", "and.", "mañana", "été", "über%%%"):
        assert read.text(plain) == re.sub(r"\W", "", plain)


def test_decoding_equals_the_best_of_all_readings(toxic):
    """Viterbi against every path through the lattice, with the same model and costs."""
    model, rng = toxic.characters, random.Random(4)

    def value(text, cost):
        a = b = 0
        total = -cost
        for c in text + " ":
            k = toxicity._CODE.get(c, 1)
            total += toxicity.LM_WEIGHT * float(model[a, b, k])
            a, b = b, k
        return total

    for _ in range(150):
        word = "".join(rng.choice("aeinrst10!$.@-") for _ in range(rng.randint(1, 7)))
        every = [("", 0.0)]
        for ways in toxicity.lattice(word):
            every = [(t + x, c + y) for t, c in every for x, y in ways]
        best = max(value(t, c) for t, c in every)
        got = toxicity.restore(word, model)
        assert any(t.strip() == got and abs(value(t, c) - best) < 1e-4 for t, c in every), (word, got)


def test_quality_statistics_equal_plain_counts(spark, docs):
    rows = docs.select("text", *[c.alias(k) for k, c in quality.statistics(F.col("text")).items()]).collect()
    for r in rows:
        t = r.text or ""
        n, words, lines = max(1, len(t)), re.split(r"[ \t\n\x0b\f\r]+", t), t.split("\n")
        want = {"chars": math.log1p(len(t)), "words": math.log1p(len(words)), "word_length": len(t) / len(words), "distinct_words": len(set(words)) / len(words), "distinct_lines": len(set(lines)) / len(lines), "line_length": math.log1p(len(t) / len(lines))}
        want |= {k: sum(c in v for c in t) / n for k, v in quality._SETS.items()}
        assert all(abs(r[k] - want[k]) < 1e-9 for k in want), (t[:40], r, want)


def test_rare_words_that_separate_enter_the_lexicon(toxic):
    assert {"moron", "loser", "pathetic"} <= set(toxic.lexicon)
    a, b = np.array([8.0, 8.0, 40.0, 350.0]), np.array([0.0, 60.0, 310.0, 2803.0])
    assert toxicity.discoveries(a, b, 352 / 3155).tolist() == [True, False, False, False]
    assert toxicity.discoveries(np.zeros(0), np.zeros(0), 0.1).tolist() == []


def test_toxicity_of_planted_texts(spark, sf, toxic):
    clean = "Thering of the estion and hater inthe onder with wher and of the sting or therat."
    rows = [(0, clean), (1, clean + " You stupid idiot and worthless scum moron clown"), (2, clean + " You stup1d 1diot and w0rthless sc.u.m m0ron cl0wn"), (3, None), (4, "")]
    out = {r.doc_id: r for r in toxicity.score(spark.createDataFrame(rows, "doc_id long, text string"), toxic, restored=True).collect()}
    assert [out[i].predicted for i in range(5)] == [0, 1, 1, 0, 0]
    held = common.table(spark, sf, "documents").join(common.table(spark, sf, "labels"), "doc_id").where((common.crc_mod(F.col("doc_id"), 5) == 0) & (F.col("lang") == "en"))
    scored = toxicity.score(held, toxic).join(held.select("doc_id", "toxic"), "doc_id").collect()
    assert auc([(r.score, r.toxic) for r in scored]) > 0.85
    kept = toxicity.reject(spark.createDataFrame(rows, "doc_id long, text string"), toxic)
    assert sorted(r.doc_id for r in kept.collect()) == [0, 3, 4]


# ---------------------------------------------------------------- pages


PAGE = """<!DOCTYPE html><html><head><title>no</title><style>p{}</style><script>var t="</p>";</script></head><body>
<header><a href="/">Site</a></header><nav><ul><li><a href="/a">A</a></li></ul></nav><div class="cookie-notice">We use cookies <b>x</b><div>in</div></div>
<article><header><h1>Head &amp; line</h1></header><p>First   <b>bo</b>ld&nbsp;text.<br>next<p class="advert">Buy<p>Second &lt;x&gt; a < b</p><form><input name="q">Send</form><div class="comments"><p>Me first</p></div><p>S.</p></article>
<aside>More</aside><footer>&copy; me</footer></body></html>"""


def test_main_text():
    assert html.main_text(PAGE) == "Head & line First bold text. next Second <x> a < b S."
    assert html.main_text("") == "" and html.main_text("<nav>a</nav>") == "" and html.main_text("<!-- x") == "" and html.main_text("<script>1") == ""
    assert html.main_text("plain") == "plain"
    assert html.main_text('<div class="page has-sidebar"><nav>n</nav><article><p>Kept text</article><div class="sidebar">s</div></div>') == "Kept text"
    body = "<div>" + "word " * 60 + "</div>"
    assert html.main_text(f"<body><ul><li><a href=x>one</a></li><li><a href=y>two</a></li></ul>{body}<div class='footer'>f</div><div>tiny</div></body>") == ("word " * 60).strip()
    assert html.main_text("<article>a<p>b<p>c &am").split() == ["a", "b", "c", "&am"]
    assert len(html.main_text("<article><p>" + "wort " * 200_000 + "</p></article>")) == 999_999


def test_main_text_keeps_short_and_linked_parts_of_the_text():
    long = "word " * 60
    links = "<p><a href=x>first link</a></p>"
    assert html.main_text(f"<article>{links}<p>{long}</p>{links}</article>") == f"first link {long}first link"
    page = "<body><ul><li><a href=x>one</a></li></ul><div class='page'>{}</div><div class='footer'>f</div><div>tiny</div></body>"
    assert html.main_text(page.format(f"{links}<p>{long}</p><div class='advert'>Buy</div><p>The end.</p>{links}")) == f"first link {long}The end. first link"
    assert html.main_text(page.format(f"<p>{long}</p><div class='ad'>Buy</div><div><p>Short.</p></div><div class='ad'>Buy</div><p>{long}</p>")) == f"{long}Short. {long}".strip()


LONG = ("word " * 60).strip()


@pytest.mark.parametrize(
    "page, want",
    [
        (f"<article><h1><a>Headline</a></h1><p>Body {LONG}</p></article>", f"Headline Body {LONG}"),
        (f"<article><p>{LONG}</p><ul><li><a>a</a><li><a>b</a><li><a>c</a><li><a>d</a></ul><p>{LONG}</p></article>", f"{LONG} a b c d {LONG}"),
        (f"<body><div class=post><p>A first paragraph.</p><nav>x</nav><p>{LONG}</p></div></body>", f"A first paragraph. {LONG}"),
        (f'<article><p>{LONG}</p><section id="related-work"><p>{LONG} again</p></section><p>end</p></article>', f"{LONG} {LONG} again end"),
        (f'<article><p>{LONG}</p><div class="related"><ul><li><a>some other text</a><li><a>more</a></ul></div><p>end</p></article>', f"{LONG} end"),
        (f'<body><div class="post"><h1>T</h1><p>{LONG}</p><p>{LONG}</p></div><article><h2><a href=x>teaser head line</a></h2><p>short.</p></article></body>', f"T {LONG} {LONG}"),
        (f"<body><article><p>{LONG}</p></article><article><h2>b</h2><p>short text.</p></article></body>", f"{LONG} b short text."),
        ("<article><p><a href=x>all links</a></p></article>", "all links"),
        (f'<body><div class="header-wrap"><article><p>{LONG}</p></article></div><div class="share"><a>x</a></div></body>', LONG),
    ],
)
def test_density_decides_and_names_are_hints(page, want):
    assert html.main_text(page) == want


def test_pages_without_names_or_article_tags(spark, sf, monkeypatch):
    """The same text by density where class names say nothing, and where no tag marks the article."""
    import html as H

    for (page,) in common.table(spark, sf, "pages").select("html").collect():
        own = page.split("<article>")[1].split("</article>")[0]
        want = " ".join(H.unescape(re.sub(r"</?(p|h1|br)>", " ", re.sub(r"</?b>", "", own))).split())
        assert html.main_text(page.replace("article>", "div>")) == want
        with monkeypatch.context() as m:
            m.setattr(html, "_NOISE", re.compile("(?!)"))
            assert len(want) < 300 or html.main_text(page) == want  # an advert may be denser than a short article


def test_pages_of_the_table(spark, sf):
    import html as H

    rows = html.extract(common.table(spark, sf, "pages").withColumn("text", F.lit("x"))).collect()
    pages = {r.page_id: r.html for r in common.table(spark, sf, "pages").collect()}
    for r in rows:
        own = pages[r.page_id].split("<article>")[1].split("</article>")[0]
        want = " ".join(H.unescape(re.sub(r"</?(p|h1|br)>", " ", re.sub(r"</?b>", "", own))).split())
        assert r.text == want and r.n_chars == len(want)
    odd = spark.createDataFrame([(1, None, None), (1, "u", ""), (None, "u", "<p>x")], "page_id long, url string, html string")
    assert sorted((r.page_id or 0, r.url or "", r.text, r.n_chars) for r in html.extract(odd).collect()) == [(0, "u", "x", 1), (1, "", "", 0), (1, "u", "", 0)]
    assert html.extract(odd.where("false")).collect() == []


def test_warc_round_trip(spark, tmp_path):
    big = "".join(random.Random(0).choice("abc<>\r\né") for _ in range(300_000))
    rows = [(5, "http://a", "same"), (3, "http://b\r\nx: y", "same"), (9, None, "same"), (9, None, "same"), (1, "http://c", None), (2, "http://d", ""), (None, "http://e", "same"), (None, "http://h", "alone"), (None, None, "alone"), (7, "http://f", big), (8, "http://g", "a\r\n\r\nb")]
    pages = spark.createDataFrame(rows, "page_id long, url string, html string").repartition(3).withColumn("d", F.lit(1)).withColumn("r", F.lit(2))
    arch = warc.write_archives(pages)
    got = warc.read_archives(arch, payload=True).collect()
    assert len(got) == len(rows)
    first = {}
    for i, _, h in rows:
        first[h or ""] = min((x for x in (first.get(h or ""), i) if x is not None), default=None)
    seen = Counter((r.page_id, r.url, r.payload_bytes, r.payload_digest, r.record_type, r.refers_to) for r in got)
    want = Counter()
    for i, u, h in rows:
        b = (h or "").encode()
        lead = first[h or ""] == i
        want[(i, u, len(b), base64.b32encode(hashlib.sha1(b).digest()).decode(), "response" if lead else "revisit", None if lead else first[h or ""])] += 1
    assert seen == want
    assert {bytes(r.payload).decode() for r in got if r.payload is not None} == {h or "" for _, _, h in rows}
    files = warc.export_files(arch, str(tmp_path)).collect()
    assert Counter(r.page_id for r in warc.read_files(spark, f"{tmp_path}/*.warc.gz").collect()) == Counter(i for i, _, _ in rows) and files
    small = Counter(r.record_type for r in warc.read_archives(warc.write_archives(pages, min_payload=5)).collect())
    assert small == {"response": len(rows)}  # only "alone" is that long, and has no id to refer to
    text = pages.withColumn("page_id", F.col("page_id").cast("string"))
    assert Counter(r.page_id for r in warc.read_archives(warc.write_archives(text), id_kind="string").collect()) == Counter(None if i is None else str(i) for i, _, _ in rows)
    assert warc.read_archives(warc.write_archives(pages.where("false"))).collect() == []


def test_warc_reader_takes_linear_time():
    one = warc.record_bytes(1, "u", b"payload " * 20)
    start = time.perf_counter()
    n = sum(1 for _ in warc.members(warc.chunked(one * 20_000)))
    assert n == 20_000 and time.perf_counter() - start < 10


def test_warc_reader_in_pieces_and_on_damage():
    data = warc.record_bytes(1, "u", b"x" * 5000) + warc.record_bytes(2, "v", b"", 1)
    for step in (1, 7, 10_000):
        assert len(list(warc.members(data[i : i + step] for i in range(0, len(data), step)))) == 2
    with pytest.raises(ValueError):
        list(warc.members([data[:-3]]))
    raw = next(warc.members([data]))
    with pytest.raises(ValueError):
        warc.parse_record(raw.replace(b"xxx", b"xyx", 1))
    with pytest.raises(ValueError):
        warc.parse_record(raw[:-4] + b"z\r\n\r\n")


# ---------------------------------------------------------------- language model


def tokens(t):
    return re.findall(r"[^\x20\x09-\x0D]+", re.sub("[A-Z]", lambda m: m[0].lower(), t)) + [""]


def test_language_model(spark, docs, monkeypatch):
    rows = texts_of(docs)
    held = lambda i: i is not None and zlib.crc32(str(i).encode()) % 7 == 2
    c = Counter(w for i, t in rows if not held(i) for w in tokens(t))
    n, v = sum(c.values()), len(c)
    got = lm.score(docs).collect()
    assert len(got) == len(rows)
    want = Counter((i, held(i), len(tokens(t)), sum(c[w] > 0 for w in tokens(t)), round(sum(math.log10((c[w] + 1) / (n + v + 1)) for w in tokens(t)), 4)) for i, t in rows)
    assert Counter((r.doc_id, r.held_out, r.n_tokens, r.n_known, round(r.base_score, 4)) for r in got) == want
    assert all(r.train_tokens == n and r.score < 0 for r in got)
    assert lm.score(empty(spark)).collect() == []
    monkeypatch.setattr(lm, "PART_CHUNKS", 2)
    split = lm.score(docs).collect()
    assert Counter((r.doc_id, round(r.base_score, 4), round(r.score, 4)) for r in split) == Counter((r.doc_id, round(r.base_score, 4), round(r.score, 4)) for r in got)
    only = lm.score(spark.createDataFrame([(i, "a b") for i in range(50)], "doc_id long, text string").where(common.crc_mod(F.col("doc_id"), 7) == 2)).collect()
    assert all(r.n_known == 0 and r.train_tokens == 0 and math.isfinite(r.score) for r in only)


def test_language_model_is_a_distribution(spark, docs):
    texts = lm.chunks(docs, id_col="doc_id", text_col="text")
    tree = lm.plant(lm.corpus_counts(lm.slices(texts)))
    held = lambda i: i is not None and zlib.crc32(str(i).encode()) % 7 == 2
    c = Counter(w.encode() for i, t in texts_of(docs) if not held(i) for w in tokens(t)) | {b"never met": 0}
    assert tree.tokens == sum(c.values()) and tree.vocab.sum() + 1 == len(c) - 1
    words = sorted(c, key=lm.tag_of)
    rng, rows = np.random.default_rng(0), lm.MIN_ROWS
    weights = [rng.normal(size=(lm.TEMPLATES, rows // lm.CLASS_SHARE, tree.classes)).astype(np.float32), rng.normal(size=(lm.TEMPLATES, rows)).astype(np.float32)]
    for a, b in ((0, 1), (len(words) // 2, 5)):
        flat = np.array([x for k in range(len(words)) for x in (a, b, k)])
        row = {"tags": lm.pack(np.array([lm.tag_of(w) for w in words], np.uint64), True), "n": lm.pack(np.array([c[w] for w in words])), "ids": lm._squeeze(flat), "size": lm.pack(np.full(len(words), 3)), "held": bytes(len(words)), "round": bytes(len(words))}
        x = lm.Chunk(row, tree, rows)
        got = lm.logs(x, weights, *x.part(0, len(words)))
        assert abs(np.exp(got[2::3]).sum() - 1) < 1e-4
        assert np.allclose(got[:3], lm.logs(x, weights, *x.part(0, 1)))


def test_language_model_sums_and_score_equal_a_plain_loop(spark, docs):
    """A round's sums and the score, token by token."""
    texts = lm.chunks(docs.where("length(text) < 500"), id_col="doc_id", text_col="text")
    counts = lm.corpus_counts(lm.slices(texts))
    tree = lm.plant(counts)
    n = {r.chunk: np.concatenate([lm.unpack(bytes(s.n)) for s in counts.where(F.col("chunk") == r.chunk).orderBy("slice").collect()]) for r in texts.select("chunk").collect()}
    ready = spark.createDataFrame([(*r[:-1], lm.pack(n[r.chunk])) for r in texts.collect()], "chunk long, id array<long>, held binary, round binary, size binary, ids binary, tags binary, n binary")
    rng, rows = np.random.default_rng(1), lm.MIN_ROWS
    weights = [rng.normal(size=(lm.TEMPLATES, rows // lm.CLASS_SHARE, tree.classes)).astype(np.float32), rng.normal(size=(lm.TEMPLATES, rows)).astype(np.float32)]
    got, want = lm.feature_sums(ready, tree, weights, 3), [np.zeros((2, *w.shape)) for w in weights]
    for r in ready.collect():
        x = lm.Chunk(r.asDict(), tree, rows)
        for d in range(len(x.size)):
            f, contexts = x.part(d, d + 1)
            own, total = lm.class_rows(contexts, rows), x.tree.log_share(x.tags, x.n, x.cls)[f]
            count = not x.held[d] and x.round[d] == 3
            for i in range(len(f)):
                z = tree.class_share() + sum(weights[0][t, own[t][i]].astype(float) for t in range(lm.TEMPLATES))
                p = np.exp(z - np.log(np.exp(z).sum()))
                total[i] += np.log(p[x.cls[f[i]]])
                for t in range(lm.TEMPLATES):
                    want[0][0, t, own[t][i], x.cls[f[i]]] += count
                    want[0][1, t, own[t][i]] += p * count
            for at, features, up, odds in x.halves(f, contexts):
                for i, j in enumerate(at):
                    p = 1 / (1 + math.exp(-(odds[i] + sum(float(weights[1][t, features[t][i]]) for t in range(lm.TEMPLATES)))))
                    total[j] += math.log(p if up[i] else 1 - p)
                    for t in range(lm.TEMPLATES):
                        want[1][0, t, features[t][i]] += count
                        want[1][1, t, features[t][i]] += (up[i] - p) * count
            assert np.allclose(lm.logs(x, weights, f, contexts), total, atol=1e-4)
    for g, w in zip(got, want):
        assert (g[0] == w[0]).all() and np.allclose(g[1], w[1], rtol=1e-4, atol=1e-3) and w[0].any()


def test_language_model_beats_the_base_on_held_out_texts(spark, sf):
    out = lm.score(common.table(spark, sf, "documents")).where("held_out").agg(F.sum("base_score"), F.sum("score"), F.sum("n_tokens")).first()
    assert (out[1] - out[0]) / out[2] > 0.25


def test_language_model_words_follow_their_history_within_a_class(spark):
    train = [(i, "aa p1xy" if i % 2 else "bb p2xy") for i in range(400)]
    held = [i for i in range(1000, 1100) if zlib.crc32(str(i).encode()) % 7 == 2][:4]
    rows = train + list(zip(held, ("aa p1xy", "aa p2xy", "bb p2xy", "bb p1xy")))
    out = {r.doc_id: r.score for r in lm.score(spark.createDataFrame(rows, "doc_id long, text string")).collect()}
    assert out[held[0]] > out[held[1]] + 0.5 and out[held[2]] > out[held[3]] + 0.5
    assert lm.rows_for(4_000_000_000) > lm.rows_for(64_000_000) >= lm.rows_for(1000) == lm.MIN_ROWS


def test_language_model_does_not_depend_on_file_layout(spark, sf):
    docs = common.table(spark, sf, "documents")
    one, many = ({r.doc_id: r.score for r in lm.score(d).collect()} for d in (docs.coalesce(1), docs.repartition(30)))
    assert one.keys() == many.keys() and all(abs(one[i] - many[i]) <= 1e-4 * abs(one[i]) for i in one)


def test_language_model_takes_ids_of_any_type(spark):
    for kind in ("string", "smallint", "decimal(9,0)"):
        df = spark.createDataFrame([("1", "a b"), (None, None)], "doc_id string, text string").withColumn("doc_id", F.col("doc_id").cast(kind))
        assert [str(r.doc_id) for r in lm.score(df).orderBy(F.col("doc_id").desc_nulls_last()).collect()] == ["1", "None"]
