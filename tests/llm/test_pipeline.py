"""The pipeline over a small corpus with planted cases; each stage is held against what was planted."""

import random
from collections import defaultdict

import corpus_pipeline
from loomgraph.llm import simhash
from loomgraph.llm.queries import tokenizer

RNG = random.Random(21)
STOP = "the of and to that with from for this in is".split()
WORDS = ["".join(RNG.choices(["ba", "lo", "ter", "min", "sha", "ren", "ti", "cor"], k=RNG.randrange(2, 5))) for _ in range(900)]
DDL = "doc_id long, text string, lang string, source string, n_chars long"


def line(n):
    words = [RNG.choice(STOP) if k % 3 == 0 else RNG.choice(WORDS) for k in range(n)]
    return " ".join(words).capitalize() + "."


def good(lines=4):
    return "\n".join(line(30) for _ in range(lines))


def corpus():
    docs = {k: good() for k in range(120)}
    for k in range(200, 230):  # rejected
        docs[k] = [" | ".join(RNG.choices(WORDS, k=80)), "!! ".join(RNG.choices(WORDS, k=80)).upper() + "!!", " ".join([RNG.choice(WORDS)] * 90)][k % 3]
    docs |= {230: None, 231: "", 232: " \n "}
    docs |= {300 + k: docs[k] for k in range(5)}  # copies: nothing of them is left
    passage = good(2)
    docs |= {400 + k: f"{good(1)}\n{passage}\n{good(1)}" for k in range(3)}
    for k in range(5):  # near copies, a word changed in one line
        words = line(70).split()
        docs[500 + 2 * k] = " ".join(words)
        words[33] = "changed"
        docs[501 + 2 * k] = " ".join(words)
    items = {k: line(40) for k in range(4)}
    docs |= {600 + k: f"{good(1)} {items[k]} {good(1)}" for k in items}
    return docs, items, passage


def test_stages(spark, tmp_path):
    docs, items, passage = corpus()
    rows = [(d, t, "en", "s", 7) for d, t in docs.items()]
    spark.createDataFrame(rows, DDL).repartition(3).write.parquet(str(tmp_path / "documents.parquet"))
    spark.createDataFrame(list(items.items()), "item_id long, text string").write.parquet(str(tmp_path / "benchmark.parquet"))
    left, frames = set(docs), {}
    frame = spark.read.parquet(str(tmp_path / "documents.parquet"))
    for name, stage in corpus_pipeline.STAGES:
        frame = corpus_pipeline.stage(stage(spark, frame, str(tmp_path)), name)
        frames[name] = frame
        if name != "packing":
            assert frame.columns == [c.split()[0] for c in DDL.split(", ")]
    kept = {name: {r.doc_id: r for r in f.collect()} for name, f in frames.items() if name != "packing"}
    left -= set(range(200, 233))
    assert set(kept["quality_classifier"]) == left and all(r.text == docs[d] and r.n_chars == 7 for d, r in kept["quality_classifier"].items())
    left -= set(range(300, 305))
    assert set(kept["line_dedup"]) == left
    for d, r in kept["line_dedup"].items():
        want = docs[d].replace(f"\n{passage}\n", "\n") if d in (401, 402) else docs[d]
        assert r.text == want and r.n_chars == (7 if want == docs[d] else len(want))
    left -= {501, 503, 505, 507, 509}
    assert set(kept["simhash_near_dedup"]) == left
    left -= set(range(600, 604))
    assert set(kept["benchmark_decontamination"]) == left
    from tokenizers import Tokenizer

    tok, total = Tokenizer.from_file(tokenizer("word_bpe_49k.json")), defaultdict(int)
    for p in frames["packing"].collect():
        total[p.doc_id] += p.length
    assert total == {d: len(tok.encode(kept["benchmark_decontamination"][d].text, add_special_tokens=False).ids) + 1 for d in left}
    assert corpus_pipeline.run(spark, str(tmp_path)).count() == frames["packing"].count()


def test_empty_corpus(spark, tmp_path):
    spark.createDataFrame([], DDL).write.parquet(str(tmp_path / "documents.parquet"))
    spark.createDataFrame([], "item_id long, text string").write.parquet(str(tmp_path / "benchmark.parquet"))
    assert corpus_pipeline.run(spark, str(tmp_path)).count() == 0


def test_near_stage_keeps_texts_that_share_a_doc_id(spark):
    a, b, c = good(), good(), good()
    rows = [(1, a), (2, b), (2, c), (3, a), (3, good()), (4, c), (5, b), (5, b), (6, c.upper()), (None, a)]
    extra = (7, good())
    df = spark.createDataFrame([(d, t, "en", "s", 7) for d, t in [*rows, extra, extra]], DDL)
    kept = sorted((r.doc_id or 0, r.text) for r in corpus_pipeline.near_stage(spark, df, "").collect())
    assert kept == sorted([(1, a), (2, b), (2, c), rows[4], (0, a), extra])


def test_near_stage_links_by_fingerprints(spark):
    """Two texts within two bits that share less than 0.8 of their five-word shingles, and one that only these link to the second."""
    rng = random.Random(7)
    words = lambda n: " ".join("".join(rng.choices(["ba", "lo", "ter", "min", "sha", "ren", "ti", "cor"], k=rng.randrange(2, 5))) for _ in range(n))
    passage, one, other = words(60), words(12), words(12)
    texts = [" ".join([passage] * 9 + [one]), " ".join([passage] * 9 + [other]), " ".join([passage] * 2 + [other])]
    apart = lambda a, b: (simhash.fingerprint(a) ^ simhash.fingerprint(b)).bit_count()
    a, b, c = (set(simhash.shingles(simhash._words(t), 5).tolist()) for t in texts)
    assert apart(texts[0], texts[1]) <= 2 < min(apart(texts[0], texts[2]), apart(texts[1], texts[2])) and len(a & b) < 0.8 * len(a | b) and b == c
    far = [(k, good()) for k in range(10, 13)]
    df = spark.createDataFrame([(d, t, "en", "s", 7) for d, t in [*enumerate(texts, 1), *far, (20, texts[1].upper()), (None, texts[0])]], DDL)
    kept = sorted((r.doc_id or 0, r.text) for r in corpus_pipeline.near_stage(spark, df, "").collect())
    assert kept == sorted([(1, texts[0]), *far, (0, texts[0])])
    fewer = df.filter("doc_id is null or doc_id <> 2 and doc_id <> 20")
    assert {r.doc_id for r in corpus_pipeline.near_stage(spark, fewer, "").collect()} == {1, 3, 10, 11, 12, None}
