"""Token counts, byte-level BPE, chat formats, licences."""

import random
import textwrap

import numpy as np
import public_tokenizers
import pytest
import tiktoken
from hypothesis import given, settings
from hypothesis import strategies as st
from pyspark.sql import functions as F

from strandloom.llm import byte_bpe, chat_format, license_scan, token_count

PATH, PATTERN = public_tokenizers.path("byte_bpe_multi_50k.tiktoken"), public_tokenizers.PATTERN


@pytest.fixture(scope="module")
def codec():
    return byte_bpe.Codec(byte_bpe.load_ranks(PATH), PATTERN)


@pytest.fixture(scope="module")
def reference(codec):
    return tiktoken.Encoding("own", pat_str=PATTERN, mergeable_ranks={b: i for i, b in enumerate(codec.entries)}, special_tokens={})


def test_perfect_hash_is_minimal(codec):
    assert sorted(codec.hashed.slots) == list(range(len(codec.entries)))
    assert all(codec.whole(x) == i for i, x in enumerate(codec.entries))
    assert codec.whole(b"\x00no such entry") == -1


TEXTS = ["", "hello world", "<|endoftext|>", "a\r\n\t b  \n", "日本語 テスト 😀", "'s 're I'LL", "aaaa" * 900, "\x1c\x85\u2028x", "Ünïcödé   123456", " " * 500]


@pytest.mark.parametrize("text", TEXTS)
def test_encoding_equals_the_library(codec, reference, text):
    raw = codec.encoder()(text)
    ids = np.frombuffer(raw, "<u4").tolist()
    assert ids == reference.encode_ordinary(text) and codec.decode(ids) == text.encode()


@settings(max_examples=150, deadline=None)
@given(st.text(max_size=60))
def test_round_trip_of_any_text(text):
    code = _codec()
    ids = np.frombuffer(code.encoder()(text), "<u4").tolist()
    assert code.decode(ids) == text.encode()


_held = []


def _codec():
    if not _held:
        _held.append(byte_bpe.Codec(byte_bpe.load_ranks(PATH), PATTERN))
    return _held[0]


def test_memo_may_overflow(codec, monkeypatch):
    monkeypatch.setattr(byte_bpe, "MEMO", 3)
    code, text = codec.encoder(), "one two three four five one two"
    assert code(text) == codec.encoder()(text) and len(code.memo) <= 3


def test_long_texts_are_coded_whole(codec, reference):
    rng = random.Random(4)
    text = "".join(rng.choice(["word", " ", "Ünï", "日本", "\n", "x1", "--", " the"]) for _ in range(120_000)) + "q" * 20_000
    ids = np.frombuffer(codec.shared_encoder()(text), "<u4").tolist()
    assert ids == reference.encode_ordinary(text) and codec.decode(ids) == text.encode()
    assert codec.shared_encoder() is codec.shared_encoder() is not codec.encoder()


def test_bpe_frames(spark, codec, reference):
    rows = [(1, "hello world"), (2, None), (3, ""), (3, ""), (None, "é" * 1000)]
    docs = spark.createDataFrame(rows, "doc_id long, text string").withColumn("ids", F.lit(1))
    coded = byte_bpe.encode(docs, PATH, PATTERN)
    assert sorted(((r.doc_id or 0), list(r.ids)) for r in coded.collect()) == sorted(((i or 0), reference.encode_ordinary(t or "")) for i, t in rows)
    back = {(r.doc_id or 0): bytes(r.bytes) for r in byte_bpe.decode(coded, PATH, PATTERN).collect()}
    assert back == {(i or 0): (t or "").encode() for i, t in rows}
    assert byte_bpe.digest(docs, PATH, PATTERN).count() == 5 and byte_bpe.digest(docs.limit(0), PATH, PATTERN).count() == 0


def test_automaton_against_greedy_search():
    rng = random.Random(3)
    for _ in range(300):
        word = lambda n, al=b"abc": bytes(rng.choice(al) for _ in range(n))
        starts, rest = {word(rng.randint(1, 5)) for _ in range(rng.randint(1, 12))}, {word(rng.randint(1, 4)) for _ in range(rng.randint(1, 8))}
        automaton = token_count.Automaton(starts, rest)
        for _ in range(10):
            w = word(rng.randint(1, 12), b"abcd")
            assert automaton.count(w) == token_count.greedy(w, starts, rest)


def test_token_counts(spark, monkeypatch):
    entries = byte_bpe.load_ranks(public_tokenizers.path("byte_bpe_50k.tiktoken"))
    starts, rest = map(set, token_count.split_vocabulary(entries))
    rows = [(1, "The quick  brownish fox\n"), (2, None), (3, ""), (4, "naïve\x0bwörds " * 30), (4, "naïve\x0bwörds " * 30), (5, "z" * 5000)]
    docs = spark.createDataFrame(rows, "doc_id long, text string").withColumn("n_words", F.lit("x"))
    want = sorted((i, len((t or "").encode().split()), sum(token_count.greedy(b" " + w, starts, rest) for w in (t or "").encode().split())) for i, t in rows)
    assert sorted((r.doc_id, r.n_words, r.n_tokens) for r in token_count.token_counts(docs, entries).collect()) == want
    assert token_count.token_counts(docs.limit(0), entries).count() == 0
    monkeypatch.setattr(token_count, "CHUNK", 7)
    assert [w for part in token_count._words("ab cdefghijk  lm\nnop ") for w in part] == b"ab cdefghijk lm nop".split()


@settings(max_examples=300, deadline=None)
@given(st.sampled_from(["user", "assistant", "system", "tool", "", "a\nb", "<s>"]), st.lists(st.sampled_from([*chat_format.CONTROLS, "\\", "\n", "x", " ", "<", "]", "é"]), max_size=8).map("".join))
def test_turns_come_back(role, text):
    out, begin, end = chat_format.render_turn(role, text)
    assert chat_format.parse(out) == [(role, text)] and chat_format.unescape(out[begin:end]) == text


def test_plain_text_is_not_escaped():
    out, begin, end = chat_format.render_turn("assistant", "ok </b> [x]")
    assert out[begin:end] == "ok </b> [x]"
    with pytest.raises(chat_format.GrammarError):
        chat_format.parse("<s>user\nhi</s>\n")


def test_chat_frames(spark):
    rows = [(1, 1, "assistant", "</s>[INST] ok [/INST]"), (1, 0, "user", "hi"), (2, 0, None, None), (2, 0, None, None), (None, 3, "assistant", "x" * 100_000), (3, 0, "assistant", "a"), (3, 1, "assistant", "b\\")]
    talk = spark.createDataFrame(rows, "conv_id long, turn long, role string, text string").withColumn("rendered", F.lit(1))
    out = chat_format.format_turns(talk)
    got = {r.conv_id: r for r in chat_format.digest(out).collect()}
    import hashlib

    sha = lambda s: hashlib.sha256(s.encode()).hexdigest()
    assert got[1].turns_sha256 == sha("user\nhi\nassistant\n</s>[INST] ok [/INST]\n") and got[1].loss_sha256 == sha("</s>[INST] ok [/INST]") and got[1].n_turns == 2
    assert (got[2].n_turns, got[2].loss_chars, got[2].loss_sha256) == (2, 0, sha("")) and got[None].loss_chars == 100_000 and got[3].loss_sha256 == sha("ab\\")
    rendered = {}
    for r in sorted(out.collect(), key=lambda r: (r.conv_id or 0, r.turn)):
        rendered.setdefault(r.conv_id, []).append(r.rendered)
    assert all(len("".join(v)) == got[k].formatted_chars for k, v in rendered.items())
    assert chat_format.parse("".join(rendered[1])) == [("user", "hi"), ("assistant", "</s>[INST] ok [/INST]")]
    assert chat_format.digest(chat_format.format_turns(talk.limit(0))).count() == 0
    masked = out.withColumn("loss_end", F.col("loss_start"))  # the digest reads the mask, not the role
    assert {(r.loss_chars, r.loss_sha256) for r in chat_format.digest(masked).collect()} == {(0, sha(""))}
    some = out.filter("conv_id = 1").withColumns({"loss_start": F.when(F.col("role") == "user", F.instr("rendered", "hi") - 1).otherwise(0), "loss_end": F.when(F.col("role") == "user", F.instr("rendered", "hi") + 1).otherwise(0)})
    assert [(r.loss_chars, r.loss_sha256) for r in chat_format.digest(some).collect()] == [(2, sha("hi"))]


@pytest.fixture(scope="module")
def licences():
    return license_scan.train()


CASES = [
    ("Licensed under CC BY-NC 4.0.", ["cc-by-nc"]), ("Released under the MIT License.", ["mit"]), ("This work is licensed under the GNU General Public License, version 3.", ["gpl-3.0"]), ("text before\nLicensed under the Apache License, Version 2.0.\nmore", ["apache-2.0"]),
    ("All rights reserved.", ["reserved"]), ("She lost her driving license in version 3 of the story.", []), ("The license of the fishing boat expired.", []), ("plain words only", []), (None, []), ("", []), ("word " * 30_000, []),
    ("Released under the MIT License.\nLicensed under CC BY 4.0", ["cc-by", "mit"]), ("ünïcode LICENSED UNDER THE APACHE LICENSE, VERSION 2.0", ["apache-2.0"]),
]


def test_licences(spark, licences):
    docs = spark.createDataFrame([(i, t) for i, (t, _) in enumerate(CASES)] + [(0, CASES[0][0])], "doc_id long, text string").withColumn("found", F.lit(1))
    out = license_scan.scan(docs, model=licences).collect()
    assert len(out) == len(CASES) + 1
    for r in out:
        assert list(r.families) == CASES[r.doc_id][1], CASES[r.doc_id][0]
    assert {r.doc_id: r.family for r in out}[5] == "unknown" and {r.doc_id: r.family for r in out}[7] == "none"
    assert license_scan.scan(docs.limit(0), model=licences).count() == 0


GRANT = "Permission is hereby granted, free of charge, to any person obtaining a copy\nof this software and associated documentation files (the \"Software\"), to deal\nin the Software without restriction"
CLAUSE = "Redistribution and use in source and binary forms, with or without\nmodification, are permitted provided that the following conditions are met:"
NOTICE = "This program is free software: you can redistribute it and/or modify\nit under the terms of the GNU {}General Public License as published by\nthe Free Software Foundation, either version 3 of the License, or\n(at your option) any later version."
WRAPPED = [
    (GRANT, ["mit"], [0]), (f"some words\n\n{CLAUSE}\n\nmore", ["bsd"], [1]), ("# " + CLAUSE.replace("\n", "\r\n# "), ["bsd"], [0]), (NOTICE.format(""), ["gpl-3.0"], [0]), (NOTICE.format("Lesser "), ["lgpl"], [0]), (NOTICE.format("Affero "), ["agpl-3.0"], [0]),
    ("Copyright of one.\nAll rights\nreserved.", ["reserved"], [0]), ("Released under the MIT License or licensed under the Apache License, Version 2.0", ["apache-2.0", "mit"], [0]), (f"{GRANT}\n \n{CLAUSE}", ["bsd", "mit"], [0, 1]), ("the license of the boat\nexpired", [], []),
]


def test_wrapped_and_double_notices(spark, licences):
    docs = spark.createDataFrame([(i, t) for i, (t, _, _) in enumerate(WRAPPED)], "doc_id long, text string")
    got = {r.doc_id: (list(r.families), list(r.where)) for r in license_scan.scan(docs, model=licences).collect()}
    assert [got[i] for i in range(len(WRAPPED))] == [(f, w) for _, f, w in WRAPPED]


def wrapped(text, width, mark=""):
    return "\n".join(mark + x for x in textwrap.wrap(text, width))


def notices():
    """Every statement alone and wrapped, and whole notices at their usual columns."""
    out = [(wrapped(t, w, mark), f) for f, ts in license_scan.TEMPLATES.items() for t in ts for w, mark in ((60, ""), (76, " * "), (10_000, "// "))]
    for family in ("mit", "bsd", "isc", "apache-2.0", "gpl-3.0", "lgpl", "agpl-3.0"):
        parts = [t for t in license_scan.TEMPLATES[family] if len(t) > 80]
        out.append(("Copyright (c) 2021 Somebody\n\n" + "\n\n".join(wrapped(t, 72) for t in parts) + "\n\nand then the file goes on", family))
    return out


def test_whole_notices_are_confirmed(spark, licences):
    rows = notices()
    got = {r.doc_id: r for r in license_scan.scan(spark.createDataFrame([(i, t) for i, (t, _) in enumerate(rows)], "doc_id long, text string"), model=licences).collect()}
    missed = [(t, f, list(got[i].families)) for i, (t, f) in enumerate(rows) if f not in got[i].families]
    assert not missed
    others = [(t, f, list(got[i].families)) for i, (t, f) in enumerate(rows) if len(t) > 200 and list(got[i].families) != [f]]
    assert not others


def plain_scan(text, model):
    """Families and places of a text, paragraph by paragraph and line by line."""
    plain = set("a all an and any are as at be by for from had has he in is it its may no not of on or see she that the this to was were with you".split())
    at = {g: i for i, g in enumerate(model.vocabulary)}

    def bigrams(t):
        ws = "".join(c if c in "abcdefghijklmnopqrstuvwxyz0123456789" else " " for c in t.lower()).split()
        return {f"{a} {b}" for a, b in zip(ws, ws[1:]) if not {a, b} <= plain}  # noqa: B905

    paragraphs, lines = [[]], (text or "").split("\n")
    for i, line in enumerate(lines):
        if line.strip(" \t\x0b\x0c\r") or i in (0, len(lines) - 1):
            paragraphs[-1].append(line)
        elif paragraphs[-1] or len(paragraphs) == 1:
            paragraphs.append([])
    families, where = set(), set()
    for n, part in enumerate(paragraphs):
        near = bigrams("\n".join(part))
        for unit in ["\n".join(part), *(part if len(part) > 1 else [])]:
            known = [g for g in bigrams(unit) if g in at]
            if not known:
                continue
            z = np.exp((model.bias + sum(model.weights[at[g]] for g in known)) / model.temperature)
            odds = dict(zip(model.classes, z, strict=True))
            best = max(sorted(odds), key=odds.get)
            for family, statements in license_scan.TEMPLATES.items():
                for t in statements:
                    mine = bigrams(t)
                    share = len(mine & set(known)) / len(mine)
                    leads = family == best and odds[best] / sum(odds.values()) >= model.least and share >= license_scan.CONFIRM
                    beside = odds[family] / (odds[family] + odds[license_scan.UNKNOWN]) >= model.least and share == 1
                    if (leads or beside) and not near & set(license_scan.SHARED.get(t, ())):
                        families.add(family)
                        where.add(n)
    return sorted(families), sorted(where)


def test_the_level_reaches_its_precision_or_there_is_none():
    p, right = np.array([0.35, 0.45, 0.55, 0.65, 0.75, 0.85]), np.array([False, True, False, True, True, True])
    assert license_scan.calibrated(p, right) == 0.6
    with pytest.raises(ValueError, match="no level"):
        license_scan.calibrated(p, np.zeros(6, dtype=bool))


def test_what_is_not_predicted_is_not_confirmed(spark, licences):
    import dataclasses

    deaf = dataclasses.replace(licences, bias=np.where(np.array(licences.classes) == license_scan.UNKNOWN, 500.0, 0.0))
    docs = spark.createDataFrame([(i, t) for i, (t, _) in enumerate(notices())], "doc_id long, text string")
    assert {r.family for r in license_scan.scan(docs, model=deaf).collect()} == {license_scan.UNKNOWN}


def test_scan_equals_the_plain_one(spark, licences):
    rng = random.Random(8)
    statements = [t for ts in license_scan.TEMPLATES.values() for t in ts]
    texts = [t for t, *_ in CASES] + [t for t, *_ in WRAPPED] + [t for t, _ in notices()[::5]]
    for _ in range(60):
        ws = [w for t in rng.sample([*statements, *license_scan.OTHERWISE], 3) for w in t.split()]
        for _ in range(rng.randint(0, 12)):
            ws[rng.randrange(len(ws))] = rng.choice(["blah", "\n", "\n\n", "License", "ü", "(c)"])
        texts.append(" ".join(ws))
    got = {r.doc_id: (list(r.families), list(r.where)) for r in license_scan.scan(spark.createDataFrame(list(enumerate(texts)), "doc_id long, text string"), model=licences).collect()}
    assert got == {i: plain_scan(t, licences) for i, t in enumerate(texts)}
    assert sum(bool(f) for f, _ in got.values()) > 30 and sum(not f for f, _ in got.values()) > 10


def test_model_is_sparse_and_trained_once(licences):
    assert license_scan.train() is licences and (licences.weights == 0).mean() > 0.5
    empty = licences.probabilities("nothing known")
    assert licences.classes[empty.argmax()] == license_scan.UNKNOWN


def test_licence_scores_equal_numpy(spark, licences):
    docs = spark.createDataFrame([(i, t) for i, (t, _) in enumerate(CASES) if t and "\n" not in t], "doc_id long, text string")
    for r in license_scan.paragraphs(docs, model=licences).collect():
        for x in r.found:
            p = licences.probabilities(CASES[r._id][0])
            assert x.probability == pytest.approx(p.max(), abs=1e-9)


def test_licence_held_out_variations(licences):
    rng = np.random.default_rng(77)
    examples = license_scan._examples(rng, 3)
    named = lambda text: (lambda p: licences.classes[p.argmax()] if p.max() >= licences.least else license_scan.UNKNOWN)(licences.probabilities(text))
    right = [named(t) == f for t, f in examples]
    assert np.mean(right) > 0.9


def test_memos_hold_short_words_only(codec, reference):
    code = codec.encoder()
    long = "x" * (byte_bpe.MEMO_CHARS + 1)
    assert np.frombuffer(code(f"a {long}"), dtype="<u4").tolist() == reference.encode_ordinary(f"a {long}")
    assert set(code.memo) == {"a"}
    memo = token_count.Memo(token_count.Automaton([b" a"], [b"a"]), b" ")
    assert memo[b"aa"] == 2 and memo[b"a" * 100] == 100 and set(memo) == {b"aa"}
