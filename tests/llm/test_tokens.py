import json
import random
import zlib

import numpy as np
import public_tokenizers
import pytest
from tokenizers import Tokenizer

from cellweave.llm import token_files
from cellweave.llm.packing import OpenSequences, best_fit_decreasing, pack
from cellweave.llm.tokens import Encoder, cut_rule

BYTE, WORD = (str(public_tokenizers.path(f)) for f in ("byte_bpe_50k.json", "word_bpe_49k.json"))


def odd_texts(n=400):
    rng = random.Random(3)
    bits = ["a", "word", " ", "  ", "\n", "\t", "\r\n", "\x0b", "\x0c", "\x1c", "\x85", "\xa0", " ", "　", "é", "É", "é", "́", "İ", "ß", "中文", "😀", "'s", "'", "don't", "12", "3.4", "<|endoftext|>", "<|startoftext|>", "##", "...", "Σ", "ﬁ", "​", "\x00"]
    return [None, "", " ", "\n", "  x", "x  ", " lead", "trail "] + ["".join(rng.choice(bits) for _ in range(rng.randint(1, 25))) for _ in range(n)]


def whole(path, text):
    return Tokenizer.from_file(path).encode(text or "", add_special_tokens=False).ids


@pytest.mark.parametrize("path, rule", [(BYTE, "space"), (WORD, "word")])
def test_pieces_give_the_ids_of_whole_texts(path, rule):
    assert cut_rule(path) == rule
    rows = odd_texts(3000)
    ids, bounds = Encoder(path).encode([None if t is None else t.encode() for t in rows], 1)
    tool = Tokenizer.from_file(path)
    for i, t in enumerate(rows):
        assert ids[bounds[i] : bounds[i + 1]].tolist() == tool.encode(t or "", add_special_tokens=False).ids + [1], repr(t)


def test_no_cuts_where_tokens_run_on_over_a_space(tmp_path):
    with open(BYTE, encoding="utf-8") as f:
        spec = json.load(f)
    token = "\u0120\u0120"
    spec["model"]["vocab"][token] = 60_000
    spec["model"]["merges"].insert(0, ["\u0120", "\u0120"] if isinstance(spec["model"]["merges"][0], list) else "\u0120 \u0120")
    path = str(tmp_path / "spaces.json")
    with open(path, "w", encoding="utf-8") as f:
        json.dump(spec, f)
    assert cut_rule(path) == "whole"
    rows = ["foo ", "baz ", "a  b", "  ", "x   y "]
    ids, bounds = Encoder(path).encode([t.encode() for t in rows], 1)
    assert [ids[a:b].tolist() for a, b in zip(bounds, bounds[1:])] == [whole(path, t) + [1] for t in rows]


def test_segment_tree_and_best_fit():
    state = OpenSequences(16)
    assert state.tightest(3) is None
    for room, number in ((5, 0), (9, 1), (5, 2), (16, 3)):
        state.push(room, number)
    assert [state.tightest(k) for k in (1, 5, 6, 9, 10, 16)] == [5, 5, 9, 9, 16, 16]
    assert state.take(4) == (5, 2) and state.take(5) == (5, 0) and state.take(4) == (9, 1)
    rng = np.random.default_rng(1)
    lengths = rng.integers(1, 60, 500)
    room, want = [], []
    for i in np.argsort(-lengths, kind="stable"):
        fits = [k for k in range(len(room)) if room[k] >= lengths[i]]
        if fits:
            room[min(fits, key=lambda k: room[k])] -= lengths[i]
        else:
            room.append(64 - lengths[i])
    got = best_fit_decreasing(lengths, 64)
    want = sorted(room)
    assert sorted(64 - sum(lengths[s]) for s in got) == want
    assert sorted(i for s in got for i in s) == list(range(500))


def table(spark):
    rows = [(i * 2, t, "x") for i, t in enumerate(odd_texts(60))] + [(7, "long text " * 9000, "y"), (None, "null id", None), (9, "dup"), (9, "dup")]
    return [r if len(r) == 3 else (*r, "z") for r in rows], "doc_id long, text string, ids string"


def test_pack(spark):
    rows, schema = table(spark)
    frame = spark.createDataFrame(rows, schema).repartition(3)
    got = pack(frame, BYTE, window=256).collect()
    by_sequence = {}
    for r in got:
        by_sequence.setdefault(r.sequence_id, []).append(r)
    for pieces in by_sequence.values():
        at = 0
        for p in sorted(pieces, key=lambda p: p.offset):
            assert p.offset == at and len(p.ids) == 4 * p.length
            at += p.length
        assert at <= 256
    docs = {}
    for r in got:
        docs.setdefault((r.id is None, r.id or 0), []).append(r)
    for key, want in {(d is None, d or 0): whole(BYTE, t) + [1] for d, t, _ in rows}.items():
        pieces = sorted(docs[key], key=lambda p: p.start)
        copies = sum((d is None, d or 0) == key for d, _, _ in rows)
        ids = np.zeros(len(want), int)
        for p in pieces:
            assert p.doc_tokens == len(want) and np.frombuffer(p.ids, "<u4").tolist() == want[p.start : p.start + p.length]
            ids[p.start : p.start + p.length] += 1
        assert (ids == copies).all()
    total = sum(r.length for r in got)
    assert total / (256 * len(by_sequence)) > 0.9
    assert pack(frame.limit(0), BYTE).count() == 0


def test_files_round_trip(spark, tmp_path):
    rows, schema = table(spark)
    frame = spark.createDataFrame(rows, schema).repartition(4)
    manifest = token_files.write(frame, WORD, f"file://{tmp_path}/t")
    assert manifest == token_files.manifest_of(str(tmp_path / "t"))
    got = sorted(token_files.read(spark, f"{tmp_path}/t").collect(), key=lambda r: r.start)
    want = sorted(rows, key=lambda r: (r[0] is not None, r[0] or 0, r[1] or ""))
    at = 0
    for r, (doc_id, text, _) in zip(got, want, strict=True):
        ids = np.array(whole(WORD, text) + [1], "<u4")
        assert (r.id, r.start, r.n_tokens) == (doc_id, at, len(ids)) and zlib.crc32(r.ids) == token_files.crc32_of(ids)
        at += len(ids)
    assert not [p for p in (tmp_path / "t").iterdir() if p.name.startswith(".")]
    token_files.write(frame.limit(0), WORD, f"{tmp_path}/e")
    assert token_files.read(spark, f"{tmp_path}/e").count() == 0
