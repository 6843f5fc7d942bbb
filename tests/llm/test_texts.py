"""Quality rules, licence scan, toxicity, quality by compression, tokens, chats."""

import hashlib
import json
import pathlib
import random
import re
import zlib
from collections import Counter

import numpy as np
import pyarrow as pa
import pytest
from pyspark.sql import functions as F

from tabulens.llm import chat_format, license_scan, quality_classifier, quality_rules, sentencepiece_codec, toxicity

# ---- quality rules -------------------------------------------------------------------------------


def test_repeated_words_by_brute_force():
    turn = random.Random(3)
    for _ in range(300):
        words = [turn.choice("ab") for _ in range(turn.randint(0, 25))]
        windows = [tuple(words[i : i + 5]) for i in range(len(words) - 4)]
        inside = {i + k for i, w in enumerate(windows) if windows.count(w) > 1 for k in range(5)}
        assert quality_rules.Facts(" ".join(words)).n_repeat_words == len(inside)


def test_cascade_order_changes_no_verdict(awkward):
    rules = quality_rules.RULES
    verdicts = [awkward.select("doc_id", quality_rules.verdict(F.col("text"), order).isNull().alias("k")).collect() for order in (rules, rules[::-1])]
    assert verdicts[0] == verdicts[1]


def test_cascade_puts_cheap_rejection_first(frame):
    docs = frame([(i, "too short") for i in range(50)])
    slow = quality_rules.Rule("slow", lambda f: sum(range(20_000)) < 0)
    short = quality_rules.Rule("short", lambda f: f.n_words < 10)
    assert [r.name for r in quality_rules.plan_cascade(docs, [slow, short])] == ["short", "slow"]


def test_rules_keep_columns_and_rows(awkward, empty):
    kept = quality_rules.keep_good(awkward)
    assert kept.columns == awkward.columns
    assert sorted((r.doc_id is None, r.doc_id or 0) for r in kept.collect()) == [(False, 1), (False, 2), (False, 2), (True, 0)]
    assert quality_rules.keep_good(empty).count() == 0 and quality_rules.quality_report(empty).count() == 0
    assert quality_rules.quality_report(awkward).count() == awkward.count()


# ---- licence scan --------------------------------------------------------------------------------


def brute_dice(unit):
    grams = set(license_scan.bigrams_of(unit))
    out = {}
    for name, notice in license_scan.NOTICES.items():
        other = set(license_scan.bigrams_of(notice))
        if grams and 200 * len(grams & other) >= license_scan.DICE * (len(grams) + len(other)):
            out[name] = 2 * len(grams & other) / (len(grams) + len(other))
    return out


def test_licences_by_brute_force(frame):
    turn, rows = random.Random(5), []
    for i in range(300):
        words = turn.choice(list(license_scan.NOTICES.values())).split()
        for _ in range(turn.randint(0, 4)):
            words[turn.randrange(len(words))] = turn.choice(["x", "the", "license", "of"])
        rows.append((i, " ".join(words[: turn.randint(1, len(words))] if turn.random() < 0.2 else words).upper()))
    got = {r.doc_id: {m.licence: m.dice for m in r.m} for r in frame(rows).select("doc_id", license_scan.matches(F.col("text")).alias("m")).collect()}
    for i, text in rows:
        assert got[i] == pytest.approx(brute_dice(text)), text


def brute_units(text):
    """(kind, licence) of lines, of paragraphs of several lines, and of a text of several paragraphs."""
    paragraphs = re.split("\n[ \t]*\n", text)
    units = [("line", x) for x in text.split("\n")] + [("paragraph", x) for x in paragraphs if "\n" in x] + [("text", text)] * (len(paragraphs) > 1)
    return [(kind, name) for kind, unit in units for name in brute_dice(unit)]


def test_licence_units(frame, awkward, empty):
    notice = license_scan.NOTICES["isc"].replace(", and/or", ",\nand/or")
    docs = frame([(1, f"prose before\n\n{notice}\n\nReleased under the MIT license!"), (2, "Released under the MIT License.\nprose")])
    got = {r.doc_id: [(m.kind, m.licence) for m in r.m] for r in docs.select("doc_id", license_scan.matches(F.col("text")).alias("m")).collect()}
    assert {i: sorted(m) for i, m in got.items()} == {r.doc_id: sorted(brute_units(r.text)) for r in docs.collect()}
    assert {("line", "mit"), ("paragraph", "isc")} <= set(got[1]) and ("line", "mit") in got[2]
    assert {r.n_matches for r in license_scan.license_report(awkward).collect()} == {0}
    assert license_scan.license_report(empty).count() == 0


MIT_FILE = """The MIT License (MIT)

Copyright (c) 2015 Some Body

Permission is hereby granted, free of charge, to any person obtaining a copy
of this software and associated documentation files (the "Software"), to deal
in the Software without restriction, including without limitation the rights
to use, copy, modify, merge, publish, distribute, sublicense, and/or sell
copies of the Software, and to permit persons to whom the Software is
furnished to do so, subject to the following conditions:

The above copyright notice and this permission notice shall be included in
all copies or substantial portions of the Software.
"""

BSD_FILE = """Copyright (c) The Regents of the University of California.
All rights reserved.

Redistribution and use in source and binary forms, with or without
modification, are permitted provided that the following conditions
are met:
1. Redistributions of source code must retain the above copyright
   notice, this list of conditions and the following disclaimer.
2. Redistributions in binary form must reproduce the above copyright
   notice, this list of conditions and the following disclaimer in the
   documentation and/or other materials provided with the distribution.
3. Neither the name of the University nor the names of its contributors
   may be used to endorse or promote products derived from this software
   without specific prior written permission.
"""


def test_licence_files(frame):
    short = {10: ("Licensed under the MIT License.", "mit-licensed"), 11: ("The MIT License (MIT)", "mit-title-long"), 12: ("Licensed under the Apache License 2.0", "apache-2.0-licensed"),
             13: ("                    GNU GENERAL PUBLIC LICENSE\n                       Version 3, 29 June 2007\n", "gpl-3.0-title")}
    docs = frame([(1, MIT_FILE), (2, BSD_FILE), *((i, t) for i, (t, _) in short.items())])
    got = {r.doc_id: set(r.licences.split(",")) for r in license_scan.license_report(docs).collect()}
    assert {"mit-title-long", "mit-permission-full", "mit-notice"} <= got[1]
    assert "bsd-3-clause-terms" in got[2]
    assert all(name in got[i] for i, (_, name) in short.items())


@pytest.mark.parametrize("path, name, least", [("Apache-2.0", "apache-2.0", 0.9), ("GPL-2", "gpl-2.0", 0.9), ("GPL-3", "gpl-3.0", 0.9), ("LGPL-2.1", "lgpl-2.1", 0.8), ("MPL-2.0", "mpl-2.0", 0.9)])
def test_licence_texts_by_paragraph(frame, path, name, least):
    file = pathlib.Path("/usr/share/common-licenses", path)
    if not file.exists():
        pytest.skip("no licence texts on this machine")
    text = file.read_text()
    want = [p for p in re.split("\n[ \t]*\n", text) if len(license_scan.bigrams_of(p)) >= 25]
    m = frame([(1, text)]).select(license_scan.matches(F.col("text")).alias("m")).first().m
    own = {x.unit for x in m if x.licence.startswith(name) and x.kind != "text"}
    assert len(own) >= least * len(want)


def test_notices_within_longer_text(frame):
    prose = " ".join(f"word{i} and more of it" for i in range(300))
    header = license_scan.NOTICES["apache-2.0-header"].split()
    comment = "".join(f" * {' '.join(header[i : i + 7])}\n *\n" for i in range(0, len(header), 7))
    docs = frame([
        (1, "Some prose about things here. Licensed under the Apache License, Version 2.0."), (2, f"{prose} {license_scan.NOTICES['mit-permission-full']} {prose}"),
        (3, f"/*\n{comment} */\n{prose}"), (4, prose), (5, "Licensed under the MIT License.\nsee: Licensed under the MIT License. as well as the other files of it here"),
        (6, f"{prose} it names the MIT License only"),
    ])
    got = {r.doc_id: r for r in license_scan.license_report(docs).collect()}
    assert "apache-2.0" in got[1].licences.split(",") and got[1].best_dice == 1.0
    assert "mit-permission-full" in got[2].licences.split(",") and got[2].best_dice == 1.0
    assert "apache-2.0-header" in got[3].licences.split(",")
    assert got[4].n_matches == got[6].n_matches == 0
    runs = {r.doc_id: Counter(x.licence for x in r.m) for r in docs.select("doc_id", license_scan.windows(F.col("text")).alias("m")).collect()}
    assert runs[5]["mit-licensed"] == 2 and runs[1]["apache-2.0"] == 1


# ---- classifiers ---------------------------------------------------------------------------------


def labelled(spark, frame, n=400):
    turn = random.Random(9)
    plain = lambda k: " ".join(turn.choice("alpha beta gamma delta epsilon zeta eta theta".split()) for _ in range(k))
    rows, labels = [], []
    for i in range(n):
        bad = i % 3 == 0
        parts = [plain(8) for _ in range(6)]
        if bad:
            parts[turn.randrange(6)] = plain(3) + " vile " + plain(2) + " rotten"
        rows.append((i, ". ".join(parts) + "."))
        labels.append((i, int(not bad), int(bad)))
    return frame(rows), spark.createDataFrame(labels, "doc_id long, quality int, toxic int"), rows


def test_toxicity_learns_and_locates(spark, frame):
    docs, labels, rows = labelled(spark, frame)
    got = toxicity.toxicity_report(docs, labels).collect()
    assert {r.held_out for r in got} == {True, False} and all(r.predicted == int(r.doc_id % 3 == 0) for r in got)
    assert all(r.held_out == (zlib.crc32(str(r.doc_id).encode()) % 5 == 0) for r in got)
    model = toxicity.train(docs, labels)
    for r in toxicity.score(docs, model).select("doc_id", "text", "toxicity").limit(60).collect():
        found = [r.text[o.start : o.end] for o in r.toxicity.offending]
        assert len(found) == int(r.doc_id % 3 == 0) and all("vile" in s for s in found)


def test_held_out_labels_do_not_matter(spark, frame):
    docs, labels, _ = labelled(spark, frame, 150)
    out = F.crc32(F.col("doc_id").cast("string")) % F.lit(5) == 0
    flipped = labels.withColumn("toxic", F.when(out, 1 - F.col("toxic")).otherwise(F.col("toxic")))
    score = lambda d: sorted((r.doc_id, r.score) for r in toxicity.toxicity_report(docs, d).collect())
    assert score(labels) == score(flipped)


def test_noisy_or():
    assert toxicity.noisy_or([]) == 0 and toxicity.noisy_or([0.5, 0.5]) == pytest.approx(0.75)


def test_classifiers_on_awkward_rows(spark, awkward, empty):
    none = spark.createDataFrame([(3, None, None), (None, 1, 1)], "doc_id long, quality int, toxic int")
    some = spark.createDataFrame([(1, 1, 0), (2, 1, 0), (2, 0, 1), (6, 0, 1), (8, 1, 0), (9, 0, 1), (10, 0, 1)], "doc_id long, quality int, toxic int")
    for labels in (none, some):
        for report in (toxicity.toxicity_report, quality_classifier.quality_scores):
            got = report(awkward, labels).collect()
            assert len(got) == awkward.count() and all(0 <= r.score <= 1 and r.predicted == int(r.score >= 0.5) for r in got)
            assert report(empty, labels).count() == 0


def test_held_out_quality(spark):
    from tabulens.llm.queries import QUERIES

    sf = "/root/testdata/sf0.1"
    got = QUERIES["op4_quality_classifier"](spark, sf).join(spark.read.parquet(f"{sf}/labels.parquet"), "doc_id").where("held_out")
    assert got.agg(F.avg((F.col("predicted") == F.col("quality")).cast("int"))).first()[0] > 0.9


def test_held_out_toxicity(spark):
    """Area under the curve, recall in every language, and clean documents left alone."""
    from tabulens.llm.queries import QUERIES

    sf = "/root/testdata/sf0.1"
    got = QUERIES["op1_toxicity"](spark, sf).join(spark.read.parquet(f"{sf}/labels.parquet"), "doc_id").join(spark.read.parquet(f"{sf}/documents.parquet").select("doc_id", "lang"), "doc_id")
    rows = got.where("held_out AND toxic IS NOT NULL").collect()
    toxic, clean = [r for r in rows if r.toxic == 1], [r for r in rows if r.toxic == 0]
    clean_scores = np.sort([r.score for r in clean])
    assert np.mean([np.searchsorted(clean_scores, r.score) / len(clean) for r in toxic]) > 0.93
    assert np.mean([r.predicted for r in clean]) < 0.02
    for lang in {r.lang for r in toxic}:
        assert np.mean([r.predicted for r in toxic if r.lang == lang]) >= 0.65, lang
    assert np.mean([r.predicted for r in toxic]) > 0.8


def test_penalty_by_inner_fold():
    """A feature that tells in half of the rows only is found out by the fold, and rare telling ones are kept."""
    turn = np.random.default_rng(1)
    y = (turn.random(400) < 0.3).astype(int)
    bags = [[[0] if k and i % 2 else [], [1 + i % 40] if k else [], [50 + int(turn.integers(200))]] for i, k in enumerate(y)]
    bias, w = toxicity.fit_best(bags, y, np.ones(400), 250, 0.3, np.arange(400) % 4 == 0)
    score = [toxicity.noisy_or([1 / (1 + np.exp(-(bias + w[s].sum()))) for s in bag]) for bag in bags]
    assert np.mean((np.array(score) >= 0.5) == y) > 0.95 and (w[1:41:2] > 0).all()
    same = toxicity.fit_best(bags, np.zeros(400, int), np.ones(400), 250, 0.3, np.arange(400) % 4 == 0)
    assert np.isfinite(same[0])


# ---- tokens --------------------------------------------------------------------------------------


def brute_viterbi(codec, pieces, word):
    table = {p: (s, i) for p, s, i in pieces.ordinary}
    best = [(0.0, [])] + [(float("-inf"), [])] * len(word)
    for end in range(1, len(word) + 1):
        for start in range(end):
            if word[start:end] in table:
                s, ids = table[word[start:end]][0], [table[word[start:end]][1]]
            elif end - start == 1:
                s, ids = codec.unknown, [codec.bytes[b] for b in word[start:end].encode()]
            else:
                continue
            if best[start][0] + s > best[end][0]:
                best[end] = (best[start][0] + s, best[start][1] + ids)
    return best[-1]


def test_viterbi_by_brute_force():
    pieces = sentencepiece_codec.Pieces.load()
    codec, score = sentencepiece_codec.Codec(pieces), {i: s for _, s, i in pieces.ordinary}
    turn = random.Random(2)
    for _ in range(400):
        word = "▁" + "".join(turn.choice("thenationscrépl.😀\nx") for _ in range(turn.randint(0, 12)))
        ids = codec.best(word)
        value, expected = brute_viterbi(codec, pieces, word)
        chars = sum(c not in codec.single for c in word)
        assert sum(score.get(i, 0.0) for i in ids) + chars * codec.unknown == pytest.approx(value)
        assert codec.decode(ids) == word.replace("▁", " ")[1:] == codec.decode(expected)


def test_tokens_round_trip(spark, awkward, empty):
    got = sentencepiece_codec.codec_report(awkward)
    assert got.where("NOT round_trip").count() == 0 and got.count() == awkward.count()
    counts = {r.doc_id: r.n_tokens for r in got.collect()}
    assert counts[3] == counts[4] == 0 and counts[8] > 0
    assert sentencepiece_codec.codec_report(empty).count() == 0
    odd = spark.createDataFrame([([1, 2, -5, 99999999],), ([131],), (None,)], "tokens array<int>")
    assert [r.text for r in sentencepiece_codec.decode_docs(odd).collect()][1:] == ["�", None]


def test_rows_of_ids_are_decoded_together():
    """Decoding needs no search: missing rows and ids, ids of no piece, slices, bytes that are no UTF-8."""
    pieces = sentencepiece_codec.Pieces.load()
    raw, codec = sentencepiece_codec.Raw(pieces), sentencepiece_codec.Codec(pieces)
    texts = ["", "one two", None, " 漢😀", "x" * 50, ""]
    ids = [None if t is None else codec.encode(t) for t in texts]
    rows = pa.array([[7], *ids, [None, -1, 10**8, pieces.byte_ids[200]], []], pa.list_(pa.int32()))
    assert raw.texts(rows[1:]) == [*texts, "\ufffd", ""]
    assert raw.texts(pa.array([None, []], pa.list_(pa.int32()))) == [None, ""] and raw.texts(rows[:0]) == []
    shared = sentencepiece_codec._plain(pieces)
    assert sentencepiece_codec._kept(shared, "raw", sentencepiece_codec.Raw) is sentencepiece_codec._kept(shared, "raw", sentencepiece_codec.Raw)


def test_tokens_round_trip_of_any_text():
    codec, turn = sentencepiece_codec.Codec(sentencepiece_codec.Pieces.load()), random.Random(4)
    for _ in range(500):
        text = "".join(turn.choice(" ▁aé\n\t漢😀the") for _ in range(turn.randint(0, 30)))
        assert codec.decode(codec.encode(text)) == text


# ---- chats ---------------------------------------------------------------------------------------


def test_layouts_give_the_same_turns(spark):
    turns = [("user", "Hi </s> \\ [INST]"), ("assistant", "Hello\n<|im_end|>\n")]
    records = [
        {"messages": [{"role": r, "content": t} for r, t in turns]}, {"conversations": [{"from": {"user": "human", "assistant": "gpt"}[r], "value": t} for r, t in turns], "id": "7"},
        {"instruction": turns[0][1], "output": turns[1][1]}, {"prompt": turns[0][1], "response": turns[1][1]},
        {"prompt": turns[0][1], "completion": turns[1][1]}, {"question": turns[0][1], "answer": turns[1][1]}, {"turns": [{"text": t, "role": r} for r, t in turns]},
    ]
    rows = spark.createDataFrame([(json.dumps(r),) for r in records], "record string")
    got = chat_format.format_records(rows).collect()
    assert len({r.chat.layout for r in got}) == len(records)
    for r in got:
        assert chat_format.read(r.chat.formatted) == turns
        assert [chat_format.unescape(r.chat.formatted[s.start : s.end]) for s in r.chat.loss] == [turns[1][1]]


def test_optional_fields_and_unknown_layouts(spark):
    rows = spark.createDataFrame([(x,) for x in (
        '{"instruction": "a", "input": "b", "output": "c", "system": "s"}', '{"x": 1}', "[1]", "no json", None, '{"messages": []}',
    )], "record string")
    got = [r.chat for r in chat_format.format_records(rows).collect()]
    assert chat_format.read(got[0].formatted) == [("system", "s"), ("user", "a\n\nb"), ("assistant", "c")]
    assert all(g.formatted is None for g in got[1:]) and got[1].fingerprint != got[5].fingerprint


def test_no_text_can_pose_as_markup():
    turn = random.Random(1)
    parts = [*chat_format.CONTROL, "\\", ";", "\n", "<", "|", "im_end|>", "[", "a"]
    for _ in range(3000):
        turns = [("".join(turn.choices(parts, k=turn.randint(0, 4))), "".join(turn.choices(parts, k=turn.randint(0, 8)))) for _ in range(3)]
        written, _ = chat_format.write(turns)
        assert chat_format.read(written) == turns


def test_conversations_with_gaps(spark):
    rows = spark.createDataFrame([
        (1, 1, "assistant", None), (1, 0, None, "x"), (1, 2, "assistant", "y"), (None, 0, "user", "n"), (2, 0, "user", "same"), (2, 0, "user", "same"), (3, None, "assistant", "late"), (3, 5, "user", "u"),
    ], "conv_id long, turn long, role string, text string")
    got = {r.conv_id: r for r in chat_format.read_back(chat_format.format_records(chat_format.conversation_records(rows))).collect()}
    digest = lambda s: hashlib.sha256(s.encode()).hexdigest()
    assert got[1].turns_sha256 == digest("\nx\nassistant\n\nassistant\ny\n") and got[1].loss_sha256 == digest("y") and got[1].loss_chars == 1
    assert got[2].n_turns == 2 and got[None].n_turns == 1 and got[3].turns_sha256 == digest("assistant\nlate\nuser\nu\n")
    assert chat_format.read_back(chat_format.format_records(chat_format.conversation_records(rows.limit(0)))).count() == 0
