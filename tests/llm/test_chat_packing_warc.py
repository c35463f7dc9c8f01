import hashlib
import random
from collections import Counter, defaultdict

import numpy as np
import pytest
from hypothesis import given, settings
from hypothesis import strategies as st

from loomgraph.llm import chat, packing, warc
from loomgraph.llm.queries import tokenizer

PARTS = ["<|im_start|>", "<|im_end|>\n", "</s>", "<s>", "[INST]", "[/INST]", "<<SYS>>", "\\", "<", "[", "|", "a", "\n", "é", " "]


@settings(max_examples=300, deadline=None)
@given(st.lists(st.sampled_from(PARTS), max_size=12).map("".join))
def test_escape_is_reversible_and_leaves_no_control(text):
    escaped = chat.escape(text)
    assert chat.unescape(escaped) == text
    assert "<|im_start|>" not in escaped and "<|im_end|>" not in escaped and "</s>" not in escaped and "[/INST]" not in escaped
    role = chat.escape_role(text)
    assert "\n" not in role and chat.unescape_role(role) == text


EVENTS = "conv_id long, seq long, message_id string, op string, role string, text string, source string"


def test_fold(spark):
    log = [
        (1, 1, "a", "message", "user", "hi"),
        (1, 2, "b", "message", "assistant", ""),
        (1, 3, "b", "delta", None, "wrong"),
        (1, 4, "b", "regenerate", None, "ri"),
        (1, 5, "b", "delta", None, "ght"),
        (1, 6, "a", "edit", None, "hello"),
        (1, 7, "c", "message", "user", "gone"),
        (1, 8, "c", "delete", None, None),
        (1, 9, "d", "noise", "user", "ignored"),
        (None, 1, "a", None, None, None),
    ]
    events = spark.createDataFrame([(*x, "extra") for x in log], EVENTS)
    got = {(r.conv_id, r.message_id): (r.position, r.role, r.text) for r in chat.fold_events(events).collect()}
    assert got == {(1, "a"): (1, "user", "hello"), (1, "b"): (2, "assistant", "right"), (None, "a"): (1, "", "")}


def test_round_trip_against_brute_force(spark):
    rng = random.Random(3)
    rows = [(c, t, rng.choice(["user", "assistant", "system", None, "x\ny"]), "".join(rng.choices(PARTS, k=rng.randrange(9))) or None) for c in range(20) for t in range(rng.randrange(1, 9))]
    rows += [rows[0], (99, 0, "assistant", "x" * 300_000), (99, 0, "user", "tie")]
    df = spark.createDataFrame([(*r, 1) for r in rows], "conv_id long, turn long, role string, text string, start int")
    got = {r.conv_id: r for r in chat.read_back(chat.render(chat.fold_events(chat.as_events(df)))).collect()}
    by_conv = defaultdict(list)
    for c, t, role, text in rows:
        by_conv[c].append((t, role or "", text or ""))
    assert got.keys() == by_conv.keys()
    for c, turns in by_conv.items():
        turns.sort()
        loss = "".join(x for _, role, x in turns if role == "assistant")
        assert got[c].n_turns == len(turns)
        assert got[c].turns_sha256 == hashlib.sha256("".join(f"{role}\n{x}\n" for _, role, x in turns).encode()).hexdigest()
        assert (got[c].loss_chars, got[c].loss_sha256) == (len(loss), hashlib.sha256(loss.encode()).hexdigest())
        assert got[c].formatted_chars == sum(len(f"<|im_start|>{chat.escape_role(r)}\n{chat.escape(x)}<|im_end|>\n") for _, r, x in turns)


def test_loss_mask_positions(spark):
    df = spark.createDataFrame([(1, 0, "user", "q"), (1, 1, "assistant", "a </s> b")], "conv_id long, turn long, role string, text string")
    rows = sorted(chat.render(chat.fold_events(chat.as_events(df))).collect(), key=lambda r: r.turn_no)
    text = "".join(r.formatted for r in rows)
    assert rows[1].start == len(rows[0].formatted) and rows[0].loss_start is None
    assert chat.unescape(text[rows[1].loss_start : rows[1].loss_end]) == "a </s> b"


def test_no_conversations(spark):
    df = spark.createDataFrame([], "conv_id long, turn long, role string, text string")
    assert chat.read_back(chat.render(chat.fold_events(chat.as_events(df)))).count() == 0


DOCS = [(1, "a cat's İ test, 12 x² été 日本語"), (2, None), (3, ""), (3, ""), (4, "word " * 30_000), (None, "no id"), (6, "<|endoftext|> don't I'm foo_bar::baz"), (7, "a<|endoftext|>b <|ENDOFTEXT|> x\t<|startoftext|><|endoftext|>'s <|endoftext |>")] + [(k, f"document {k} " * (k % 97)) for k in range(10, 400)]


def test_packing_is_whole_and_full(spark):
    from tokenizers import Tokenizer

    path = tokenizer("word_bpe_49k.json")
    pieces = packing.pack(spark.createDataFrame([(d, t, 1) for d, t in DOCS], "doc_id long, text string, offset int").coalesce(2), path, max_tokens=1024, min_tier=128).collect()
    tok = Tokenizer.from_file(path)
    want = sorted((d or 0, np.array([*e.ids, 2], "<u4").tobytes()) for (d, _), e in zip(DOCS, tok.encode_batch([t or "" for _, t in DOCS], add_special_tokens=False), strict=True))
    sequences, docs = defaultdict(list), defaultdict(list)
    for p in pieces:
        assert len(p.ids) == 4 * p.length > 0
        sequences[p.sequence_id].append(p)
        docs[p.doc_id or 0, p.doc_tokens].append(p)
    for own in sequences.values():
        own.sort(key=lambda p: p.offset)
        total = sum(p.length for p in own)
        assert total & (total - 1) == 0 and total <= 1024 and all(p.tier == total for p in own)
        assert [p.offset for p in own] == list(np.cumsum([0, *[p.length for p in own[:-1]]]))
    got = []
    for (doc, n), own in docs.items():
        starts = defaultdict(list)
        for p in own:
            starts[p.start].append(p)
        copies = len(starts[0])
        assert sum(p.length for p in own) == copies * n
        if copies == 1:
            got.append((doc, b"".join(bytes(p.ids) for p in sorted(own, key=lambda p: p.start))))
        else:
            got += [(doc, bytes(p.ids)) for p in own]
    assert sorted(got) == want


class CountingModel:
    def __init__(self, model):
        self.model, self.asked = model, Counter()

    def tokenize(self, part):
        self.asked[part] += 1
        return self.model.tokenize(part)


def test_words_in_use_stay_remembered(monkeypatch):
    """op2_packing's CPU seconds are those of words that are made again."""
    monkeypatch.setattr(packing, "REMEMBERED", 500)
    ids = packing.Ids(tokenizer("word_bpe_49k.json"))
    ids.model = model = CountingModel(ids.model)
    common = [f"{a}{b}" for a in "bcdfghjklm" for b in "aeiou"]
    rare = ["".join(chr(97 + k // 26**i % 26) for i in range(4)) for k in range(5000)]
    text = [" ".join([*common, *rare[k : k + 50], *(w.title() + "!" for w in common)]) for k in range(0, len(rare), 50)]
    got = [ids.of(x, b"") for x in text]
    assert [np.frombuffer(b, "<u4").tolist() for b in got] == [e.ids for e in ids.tokenizer.encode_batch(text, add_special_tokens=False)]
    assert max(model.asked.values()) == 1
    assert len(ids) <= 500 and len(ids.older) <= 500


def test_ids_of_each_character():
    """Every Latin character and what lies around it, alone, inside words and beside marks, as the tokenizer has it."""
    ids = packing.Ids(tokenizer("word_bpe_49k.json"))
    for c in map(chr, [*range(0x300), 0x1E9E, 0x2C65, 0x3042, 0x1F600]):
        for text in (c, f"a{c}b", f"A{c}{c}B", f"1{c}2", f"<|{c}|>", f"{c}.{c}!", f"x {c} y", f"é{c}É", f"<|endoftext|>{c}<|endoftext|"):
            assert np.frombuffer(ids.of(text, b""), "<u4").tolist() == ids.tokenizer.encode(text, add_special_tokens=False).ids, text


def test_step_groups_are_balanced():
    sequences = [(1024, [packing.Piece(1, bytes(4 * 512), 0, 9), packing.Piece(2, bytes(4 * 512), 0, 9)]) for _ in range(32)] + [(1024, [packing.Piece(1, bytes(4 * 1024), 0, 9)]) for _ in range(32)]
    groups = packing.step_groups(sequences, 16 * 1024)
    cost = defaultdict(int)
    for g, (_, pieces) in zip(groups, sequences, strict=True):
        cost[g] += sum(len(p) ** 2 for p in pieces)
    assert len(cost) == 4 and max(cost.values()) == min(cost.values())


def test_packing_empty_table(spark):
    assert packing.pack(spark.createDataFrame([], "doc_id long, text string"), tokenizer("word_bpe_49k.json")).count() == 0


PAGES = [(3, "http://a/1", "<p>x</p>"), (1, "http://a/2\r\nX: y", "<p>x</p>"), (2, None, None), (4, "u", ""), (4, "u", ""), (5, "http://é/", "a\r\n\r\nWARC/1.1\r\nb"), (6, "v", "é" * 70_000)]


@pytest.mark.parametrize("least", [0, 5])
def test_archive(spark, tmp_path, least):
    import base64

    df = spark.createDataFrame([(*p, 7) for p in PAGES], "page_id long, url string, html string, sha256 int")
    path = str(tmp_path / "a")
    warc.write_archive(df, path, least)
    rows = warc.read_archive(spark, path).collect()
    assert len(rows) == len(PAGES) and spark.read.parquet(f"{path}/payloads").count() == 4
    first = {}
    for page, _, html in sorted(PAGES, key=lambda p: p[0]):
        first.setdefault(html or "", page)
    html = {p: h or "" for p, _, h in PAGES}
    responses = defaultdict(int)
    for r in rows:
        data = html[r.page_id].encode()
        assert bytes(r.payload) == data and r.declared_digest == base64.b32encode(hashlib.sha1(data).digest()).decode()
        if len(data) < least:
            assert r.record_type == "response" and r.refers_to is None
        else:
            assert r.refers_to == (None if r.record_type == "response" else first[html[r.page_id]])
            responses[html[r.page_id]] += r.record_type == "response"
    assert set(responses.values()) <= {1}

    warc.export_warc(spark, path, str(tmp_path / "w"), records_per_file=3)
    back = warc.read_warc(spark, str(tmp_path / "w")).collect()
    want = sorted((bytes(r.header), bytes(r.payload) if r.record_type == "response" else b"") for r in rows)
    assert sorted((bytes(r.header), bytes(r.payload)) for r in back) == want
    assert {(r.page_id, r.payload_bytes, r.payload_digest) for r in warc.read_digests(spark, path).collect()} == {(r.page_id, len(r.payload), r.declared_digest) for r in rows}


def test_damaged_payload_is_noticed(spark, tmp_path):
    path = str(tmp_path / "a")
    warc.write_archive(spark.createDataFrame(PAGES, "page_id long, url string, html string"), path)
    from pyspark.sql import functions as F

    spark.read.parquet(f"{path}/payloads").withColumn("payload", F.concat("payload", F.lit(b"x"))).write.parquet(str(tmp_path / "b/payloads"))
    spark.read.parquet(f"{path}/headers").write.parquet(str(tmp_path / "b/headers"))
    with pytest.raises(Exception, match="damaged payload"):
        warc.read_digests(spark, str(tmp_path / "b")).collect()


def test_empty_archive(spark, tmp_path):
    warc.write_archive(spark.createDataFrame([], "page_id long, url string, html string"), str(tmp_path / "a"))
    assert warc.read_archive(spark, str(tmp_path / "a")).count() == 0


@settings(max_examples=200, deadline=None)
@given(st.lists(st.integers(1, 700), max_size=40))
def test_any_block_packs_whole(lengths):
    pieces = [packing.Piece(k, bytes(4 * n), 0, n) for k, n in enumerate(lengths)]
    got = defaultdict(list)
    for size, own in packing.pack_block(pieces, [32, 64, 128, 256]):
        assert size & (size - 1) == 0 and sum(map(len, own)) == size <= 256
        for p in own:
            got[p.doc].append((p.start, len(p)))
    for k, n in enumerate(lengths):
        at = 0
        for start, length in sorted(got[k]):
            assert start == at
            at += length
        assert at == n
