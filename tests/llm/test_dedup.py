import random
from collections import defaultdict

import numpy as np
import pyarrow as pa
import pytest
import xxhash

from loomgraph.llm import decontam, linededup, simhash, topk
from loomgraph.llm.common import records

RNG = random.Random(5)
WORDS = [f"w{k}" for k in range(400)]


def prose(n):
    return " ".join(RNG.choices(WORDS, k=n))


def slow_fingerprint(text):
    words = (text or "").encode().lower().split()
    if not words:
        return 0
    grams = [b" ".join(words[i : i + 3]) for i in range(len(words) - 2)] or [b" ".join(words)]
    hashes = [xxhash.xxh64_intdigest(g, 42) for g in grams]
    return sum(1 << b for b in range(64) if 2 * sum(h >> b & 1 for h in hashes) > len(hashes))


def classes(fps):
    parent = {d: d for d in fps}

    def root(x):
        while parent[x] != x:
            x = parent[x]
        return x

    ids = sorted(fps)
    for i, a in enumerate(ids):
        for b in ids[i + 1 :]:
            if bin(fps[a] ^ fps[b]).count("1") <= 2:
                ra, rb = sorted((root(a), root(b)))
                parent[rb] = ra
    return {d: root(d) for d in ids}


def test_fingerprint_matches_spark_hash(spark):
    from pyspark.sql import functions as F

    assert spark.range(1).select(F.xxhash64(F.lit("a é b"))).first()[0] % 2**64 == xxhash.xxh64_intdigest("a é b".encode(), 42)
    for text in (None, "", " \t\n", "One", "one TWO", "a b c", prose(700), "Ä b\x0bc\x1cd e", "é " * 5000):
        assert simhash.fingerprint(text) == slow_fingerprint(text)


def test_golay_decodes_within_three():
    rng = np.random.default_rng(0)
    words = rng.integers(0, 1 << 23, 500)
    index = simhash.decode(words)
    high, _ = simhash.golay()
    code = index << 11 | high[index]
    assert max(bin(int(a ^ b)).count("1") for a, b in zip(words, code, strict=True)) <= 3


def test_keys_meet_at_two_bits():
    rng = np.random.default_rng(1)
    a = rng.integers(0, 1 << 63, 3000).astype(np.uint64)
    b = a.copy()
    for _ in range(2):
        b ^= np.uint64(1) << rng.integers(0, 64, 3000).astype(np.uint64)
    found = [set() for _ in range(3000)]
    rows, key = simhash.keys(a)
    for r, k in zip(rows.tolist(), key.tolist(), strict=True):
        found[r].add(k)
    hit = np.zeros(3000, bool)
    for r, k in zip(*(x.tolist() for x in simhash.keys(b)), strict=True):
        hit[r] |= k in found[r]
    assert hit.all()


def near_docs():
    docs = [(k, prose(RNG.randrange(1, 60))) for k in range(60)]
    docs += [(100 + k, docs[k % 7][1]) for k in range(40)]
    base = prose(2500)
    for k in range(60):
        words = base.split()
        for _ in range(k % 4):
            words[RNG.randrange(len(words))] = "changed"
        docs.append((200 + k, " ".join(words)))
    return docs + [(300, None), (301, ""), (302, " \n"), (5, docs[5][1]), (None, docs[3][1]), (None, "alone here")]


def test_near_duplicates_against_brute_force(spark):
    docs = near_docs()
    df = spark.createDataFrame([(d, t, d) for d, t in docs], "doc_id long, text string, fp long")
    fps = {d: slow_fingerprint(t) for d, t in docs if d is not None}
    want = classes(fps)
    for bucket_rows in (100_000, 1):  # the second: all buckets by the table path
        rows = simhash.near_duplicates(df, bucket_rows=bucket_rows).collect()
        assert len(rows) == len(docs)
        assert {r.doc_id: r.component_id for r in rows if r.doc_id is not None} == want
        assert all(r.fp % 2**64 == fps[r.doc_id] for r in rows if r.doc_id is not None)
    assert len(set(want.values())) < len(fps) - 60
    assert simhash.near_duplicates(df.limit(0)).count() == 0


def test_components_of_a_path(spark):
    links = spark.createDataFrame([(k, k + 1) for k in range(200)] + [(900, 901)], "a long, b long")
    got = {r.node: r.component for r in simhash.components(links).collect()}
    assert got == {k: 0 for k in range(201)} | {900: 900, 901: 900}


def slow_line_dedup(docs, min_words):
    """By definition: every run of min_words words or more that occurs at an earlier position goes."""
    order = sorted({(d, t or "") for d, t in docs}, key=lambda x: (x[0] is not None, x[0] or 0))
    lines = [t.split("\n") for _, t in order]
    gone = defaultdict(set)
    seen = set()
    for k, own in enumerate(lines):
        for i in range(len(own)):
            for j in range(i + 1, len(own) + 1):
                run = tuple(own[i:j])
                if sum(len(x.split()) for x in run) >= min_words:
                    if run in seen:
                        gone[k].update(range(i, j))
                    seen.add(run)
    return {x: "\n".join(line for i, line in enumerate(own) if i not in gone[k]) for k, (x, own) in enumerate(zip(order, lines, strict=True))}


def test_line_dedup_against_brute_force(spark):
    for seed in range(3):
        rng = random.Random(seed)
        pool = [" ".join(rng.choices(WORDS, k=rng.randrange(0, 9))) for _ in range(14)]
        docs = [(k, "\n".join(rng.choices(pool, k=rng.randrange(1, 12)))) for k in range(40)]
        docs += [(100, docs[0][1]), (101, None), (102, ""), (None, docs[1][1]), (3, docs[3][1]), (104, "x\n" * 300 + "same line of words " * 9), (105, "same line of words " * 9)]
        df = spark.createDataFrame([(d, t, "v") for d, t in docs], "doc_id long, text string, version string")
        out = linededup.dedup_lines(df, min_words=12)
        assert out.columns == ["doc_id", "version", "text", "n_lines", "n_removed"]
        want = slow_line_dedup(docs, 12)
        got = defaultdict(list)
        for r in out.collect():
            got[r.doc_id].append(r.text)
        assert dict(got) == {d: [want[d, t or ""]] * sum(x == d for x, _ in docs) for d, t in docs}
    assert linededup.dedup_lines(df.limit(0)).count() == 0


def test_line_dedup_of_very_many_lines(spark):
    """Wordless lines before and after the words: every run is long, and two copies of all of it meet."""
    words = prose(50)
    before, after = "\n" * 100_000, "\n" * 30_000
    docs = [(1, before + words + after), (2, "x\n" + before + words + after + "y"), (3, before + words), (4, "\n" * 50_000)]
    got = {r.doc_id: (r.text, r.n_lines, r.n_removed) for r in linededup.dedup_lines(spark.createDataFrame(docs, "doc_id long, text string")).collect()}
    assert got == {1: (docs[0][1], 130_001, 0), 2: ("x\ny", 130_002, 130_000), 3: ("", 100_001, 100_001), 4: (docs[3][1], 50_001, 0)}
    assert sum(map(len, linededup.shortest_runs([0] * 1000 + [50] + [0] * 1000, 50))) == 2001


def test_planted_passage_goes_and_clean_lines_stay(spark):
    passage = "\n".join(prose(20) for _ in range(4))
    docs = [(k, f"{prose(30)}\n{passage}\n{prose(9)}") for k in range(5)]
    got = {r.doc_id: r for r in linededup.dedup_lines(spark.createDataFrame(docs, "doc_id long, text string")).collect()}
    assert got[0].text == docs[0][1] and got[0].n_removed == 0
    assert all(passage not in got[k].text and got[k].n_removed == 4 and got[k].text == "\n".join([docs[k][1].split("\n")[0], docs[k][1].split("\n")[-1]]) for k in range(1, 5))


def test_decontamination(spark):
    item = prose(30).split()
    short, near = prose(5), [*item]
    near[4] = near[13] = near[22] = "changed"
    docs = [
        (1, f"{prose(50)} {' '.join(item).upper()} {prose(50)}"),
        (2, f"{prose(20)}, {'! '.join(near)}"),
        (3, prose(500)),
        (4, " ".join(item[8:24])),
        (5, " ".join(item[:6])),
        (6, None),
        (7, ""),
        (8, f"{prose(9)} {short}"),
        (None, " ".join(item)),
        (1, prose(3)),
        (9, f"{' '.join(item)} {prose(20_000)} {' '.join(item)}"),
    ]
    df = spark.createDataFrame([(d, t, 1) for d, t in docs], "doc_id long, text string, item_id int")
    bench = spark.createDataFrame([(7, " ".join(item), "x"), (8, short, "x"), (9, None, "x"), (7, " ".join(item), "x"), (None, "a", "x")], "item_id long, text string, h string")
    for keys in (500_000, 0):
        got = {(r.doc_id, r.item_id): r for r in decontam.contaminated(df, bench, broadcast_keys=keys).collect()}
        assert got.keys() == {(1, 7), (2, 7), (4, 7), (9, 7)}
        assert got[1, 7].start == 50 and got[1, 7].matched == 30 and got[2, 7].matched == 27
        assert got[4, 7].start == -8 and got[4, 7].window == 13
    assert decontam.contaminated(df.limit(0), bench).count() == 0 == decontam.contaminated(df, bench.limit(0)).count()


def test_decontamination_finds_scattered_substitutions(spark):
    """Items of 6 to 60 tokens, whole and with scattered substitutions, every fifth one for some; brute force decides."""
    rng = random.Random(33)
    items = [rng.choices(WORDS, k=n) for n in (6, 7, 8, 9, 10, 11, 12, 15, 15, 20, 20, 25, 30, 38, 38, 50, 60)]
    docs = []
    for item in items:
        copies = [list(item), ["other" if k % 5 == 2 else w for k, w in enumerate(item)], ["other" if k % 5 in (1, 3) else w for k, w in enumerate(item)]]
        for _ in range(6):
            gone = set(rng.sample(range(len(item)), rng.randrange(1, len(item) // 2)))
            copies.append(["other" if k in gone else w for k, w in enumerate(item)])
        docs += [" ".join([*rng.choices(WORDS, k=rng.randrange(40)), *c, *rng.choices(WORDS, k=rng.randrange(40))]) for c in copies]
    want = set()
    for d, text in enumerate(docs):
        words = text.split()
        for i, item in enumerate(items):
            for at in range(1 - len(item), len(words)):
                agree = [0 <= at + k < len(words) and words[at + k] == w for k, w in enumerate(item)]
                if sum(agree) / len(item) >= 0.6 or any(all(agree[k : k + 13]) for k in range(len(item) - 12)):
                    want.add((d, i))
    df = spark.createDataFrame(list(enumerate(docs)), "doc_id long, text string")
    bench = spark.createDataFrame([(i, " ".join(x)) for i, x in enumerate(items)], "item_id long, text string")
    for keys in (500_000, 0):
        got = [(r.doc_id, r.item_id) for r in decontam.contaminated(df, bench, broadcast_keys=keys).collect()]
        assert set(got) == want and len(got) == len(want) > 100


def test_decontamination_with_long_items_and_items_of_two_texts(spark):
    """The same rows whether seeds are broadcast or not; an item longer than any piece, laid over repeated rows of a document."""
    rng = random.Random(34)
    long = [f"t{rng.randrange(3000)}" for _ in range(20_000)]
    changed = [w if k % 3 else f"o{k}" for k, w in enumerate(long)]
    a, b = rng.choices(WORDS, k=20), rng.choices(WORDS, k=20)
    docs = [(1, " ".join(["before"] * 700 + changed)), (1, " ".join(["before"] * 700 + changed)), (2, " ".join(a)), (3, " ".join(["x", *b, "y"])), (4, " ".join(long[9000:9012])), (5, " ".join(long[9000:9013]))]
    items = [(10, " ".join(long)), (11, " ".join(a)), (11, " ".join(b)), (12, " ".join(b)), (13, "five words are not enough"), (13, "five words are not enough")]
    df = spark.createDataFrame(docs, "doc_id long, text string")
    bench = spark.createDataFrame(items, "item_id long, text string")
    for keys in (500_000, 0):
        got = {(r.doc_id, r.item_id): (r.start, r.matched, r.item_tokens, r.window) for r in decontam.contaminated(df, bench, broadcast_keys=keys).collect()}
        assert got.keys() == {(1, 10), (2, 11), (3, 11), (3, 12), (5, 10)}
        assert got[1, 10][:3] == (700, sum(k % 3 > 0 for k in range(20_000)), 20_000) and got[1, 10][3] < 13
        assert got[5, 10] == (-9000, 13, 20_000, 13) and got[3, 11] == got[3, 12] == (1, 20, 20, 13)


def test_top_k_against_brute_force(spark):
    rng = np.random.default_rng(2)
    rows = [(k, [float(x) for x in rng.normal(size=6)]) for k in range(700)]
    rows += [(700 + k, rows[k % 3][1]) for k in range(240)] + [(1800, None), (1801, []), (1802, [1.0, None]), (1803, [float("nan")] * 6), (1804, [float("inf")] * 6), (1900, [1.0, 2.0]), (1901, [2.0, 2.0]), (None, rows[0][1]), (500, rows[0][1]), (600, rows[600][1])]
    df = spark.createDataFrame([(i, v, 0) for i, v in rows], "vec_id long, embedding array<float>, cell int")
    usable = [(i, np.floor(1024 * np.array(v, np.float32).astype(float)).astype(int)) for i, v in rows if i is not None and v and all(x is not None and np.isfinite(x) for x in v)]
    want = []
    for q, qv in {(i, tuple(v)) for i, v in usable if i % 100 == 0}:  # 500 asks with two vectors, 600 once
        found = sorted((-int(np.array(qv) @ v), i) for i, v in usable if i != q and len(v) == len(qv))[:10]
        want += [(q, r, i, -s) for r, (s, i) in enumerate(found, 1)]
    for sample in (20_000, 200):
        got = topk.top_k(topk.scaled(df), topk.F.col("vec_id") % 100 == 0, shard_rows=40, sample_rows=sample).collect()
        assert sorted((r.query_id, r.rank, r.vec_id, r.score) for r in got) == sorted(want)
    assert topk.top_k(topk.scaled(df.limit(0)), topk.F.col("vec_id") % 100 == 0).count() == 0


def test_boxes_keep_queries_from_far_shards(spark):
    """Forty clusters in as many shards or more: a query visits few of them, whether boxes come at once or in blocks."""
    rng = np.random.default_rng(4)
    centres = rng.normal(size=(40, 8)) * 3
    rows = [(k, (centres[k % 40] + rng.normal(size=8) * 0.05).tolist()) for k in range(4000)]
    table = topk.shards_of(topk.scaled(spark.createDataFrame(rows, "vec_id long, embedding array<float>")), 100, 20_000)
    boxes = table.select(*topk.SHARD, "v").mapInArrow(topk._boxes, "dim int, cell int, sub int, low array<long>, high array<long>").cache()
    asked = table.filter("vec_id % 100 = 0").select(topk.F.col("vec_id").alias("query_id"), "version", topk.F.col("v").alias("qv"), *topk.SHARD)
    home = asked.withColumn("least", (topk.F.aggregate("qv", topk.F.lit(0).cast("long"), lambda a, x: a + x * x) * 0.95).cast("long"))
    shards = table.select(*topk.SHARD).distinct().count()
    seen = {b: topk.reach(home, boxes, b).count() for b in (32_768, 7)}
    assert shards >= 40 and seen[32_768] == seen[7] < 0.25 * 40 * shards


def test_meetings_do_not_depend_on_batches():
    """Buckets of all sizes, cut into batches of any size, repeated keys included."""
    rng = random.Random(4)
    rows = []
    for bucket, size in enumerate([1, 2, 3, simhash.FEW, simhash.FEW + 1, 3 * simhash.FEW, 1, 2 * simhash.FEW, 7]):
        keys = sorted(rng.sample(range(1000), size))
        rows += [(bucket, k, 10 + k % 3) for k in keys for _ in range(1 + (k % 5 == 0))]
    schema = pa.schema([("bucket", pa.int64()), ("k", pa.int64()), ("n", pa.int32())])
    whole = records(schema, [list(c) for c in zip(*rows, strict=True)])

    def met(step):
        out = [r for b in simhash._meetings(0.8)(whole.slice(at, step) for at in range(0, len(rows), step)) for r in zip(*(c.to_pylist() for c in b.columns), strict=True)]
        assert len(out) == len(set(out))
        return set(out)

    want = set()
    for bucket in {r[0] for r in rows}:
        own = sorted({r[1:] for r in rows if r[0] == bucket})
        if len(own) <= simhash.FEW:
            want |= {(None, a, b) for i, (a, x) in enumerate(own) for b, y in own[i + 1 :] if min(x, y) >= 0.8 * max(x, y)}
        else:
            want |= {(bucket, own[0][0], b) for b, _ in own}
    assert all(met(step) == want for step in (1, 7, 60, 10_000))


def test_marks_fold_and_bound():
    rng = np.random.default_rng(6)
    for n in (1, 500, 513, 5000, 40_000):
        a = np.unique(rng.integers(-(1 << 62), 1 << 62, n))
        b = np.concatenate([a[n // 9 :], rng.integers(-(1 << 62), 1 << 62, n // 9)])
        x, y = simhash.mark(a), simhash.mark(b)
        assert len(x) * 64 >= len(a) and len(x) & (len(x) - 1) == 0
        short = min(len(x), len(y))
        apart = len(np.setxor1d(a, b))
        assert np.bitwise_count(simhash.folded(x, short).view(np.uint64) ^ simhash.folded(y, short).view(np.uint64)).sum() <= apart
        assert (simhash.folded(x, 8) == np.packbits(np.bincount(a.view(np.uint64) % np.uint64(512), minlength=512).astype(np.uint8) & 1).view(np.int64)).all()


def test_similar_documents_against_brute_force(spark):
    rng = random.Random(8)
    docs = []
    for k in range(40):
        words = rng.choices(WORDS, k=rng.randrange(40, 200))
        docs.append((10 * k, " ".join(words)))
        for j in range(k % 4):
            copy = list(words)
            for _ in range(1 + j):
                copy[rng.randrange(len(copy))] = f"new{rng.random()}"
            docs.append((10 * k + 1 + j, "  ".join(copy).upper() if j == 0 else "\n".join(copy)))
    docs += [(900, docs[0][1]), (901, None), (902, ""), (903, "two words"), (904, "Two  words"), (None, docs[0][1])]
    df = spark.createDataFrame([(d, t, 0) for d, t in docs], "doc_id long, text string, component long")
    grams = {d: {tuple(w[k : k + 5]) for k in range(max(1, len(w) - 4))} for d, t in docs if d is not None for w in [(t or "").lower().split()]}
    parent = {d: d for d in grams}

    def root(x):
        while parent[x] != x:
            x = parent[x]
        return x

    for a in sorted(grams):
        for b in sorted(grams):
            if a < b and len(grams[a] & grams[b]) >= 0.8 * len(grams[a] | grams[b]):
                ra, rb = sorted((root(a), root(b)))
                parent[rb] = ra
    got = {r.doc_id: r.component_id for r in simhash.similar_documents(df).collect()}
    want = {d: root(d) for d in grams}
    assert got == want
    assert simhash.similar_documents(df.limit(0)).count() == 0


def linked_by_brute_force(texts):
    """The smallest number of each text's component at a similarity of 0.8 of five-word shingles."""
    grams = [{tuple(w[k : k + 5]) for k in range(max(1, len(w) - 4))} for t in texts for w in [t.lower().split()]]
    parent = list(range(len(texts)))

    def root(x):
        while parent[x] != x:
            x = parent[x]
        return x

    for b in range(len(grams)):
        for a in range(b):
            if len(grams[a] & grams[b]) >= 0.8 * len(grams[a] | grams[b]):
                ra, rb = sorted((root(a), root(b)))
                parent[rb] = ra
    return [root(x) for x in range(len(texts))]


def test_components_that_do_not_converge_are_an_error(spark):
    links = spark.createDataFrame([(k, k + 1) for k in range(200)], "a long, b long")
    with pytest.raises(RuntimeError):
        simhash.components(links, max_rounds=2)


def test_similar_documents_compares_all_candidates(spark, monkeypatch):
    """Copies of one text that are not alike among themselves, more than meet at once, and unrelated texts of few different
    words, whose word fingerprints are close."""
    rng = random.Random(31)
    texts = []
    hub = rng.choices(WORDS, k=300)
    for _ in range(simhash.FEW + 30):
        copy = list(hub)
        for at in range(5, 295, 58):
            copy[at + rng.randrange(9)] = f"new{rng.random()}"
        texts.append(" ".join(copy))
    texts.append(" ".join(hub))
    few = WORDS[:12]
    for _ in range(40):
        words = rng.choices(few, k=200)
        texts += [" ".join(words), " ".join(words[:-15])]
    rng.shuffle(texts)
    # four texts of shingles that are common in the sample: their buckets are aggregated, and compared in small blocks
    licence, other = rng.choices(WORDS, k=120), rng.choices(WORDS, k=60)
    texts += [" ".join([*rng.choices(WORDS, k=2), *licence, f"end{k}"]) for k in range(300)]
    texts += [" ".join([*licence[30:], *other, f"x{k % 2}"]) for k in range(90)]
    want = linked_by_brute_force(texts)
    monkeypatch.setattr(simhash, "BLOCK", 16)
    monkeypatch.setattr(simhash, "SAMPLE", 2)
    df = spark.createDataFrame(list(enumerate(texts)), "doc_id long, text string").repartition(3)
    got = {r.doc_id: r.component_id for r in simhash.similar_documents(df).collect()}
    assert [got[k] for k in range(len(texts))] == want and len(set(want)) < len(texts) - 400


def test_similar_documents_finds_appended_and_cut(spark):
    """Short texts with passages appended, and longer ones that are cut: their word fingerprints differ in many bits."""
    rng = random.Random(32)
    texts = []
    for k in range(80):
        words = rng.choices(WORDS, k=rng.randrange(25, 160))
        more = rng.choices(WORDS, k=(len(words) - 4) // 4)
        texts += [" ".join(words), " ".join([*words, *more]) if k % 2 else " ".join(words[: 4 + -(-4 * (len(words) - 4) // 5)])]
    rng.shuffle(texts)
    want = linked_by_brute_force(texts)
    df = spark.createDataFrame(list(enumerate(texts)), "doc_id long, text string").repartition(3)
    got = {r.doc_id: r.component_id for r in simhash.similar_documents(df).collect()}
    assert [got[k] for k in range(len(texts))] == want and len(set(want)) < len(texts) - 70
