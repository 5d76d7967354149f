import hashlib
import re
from collections import Counter

import duckdb
import numpy as np
import public_tokenizers
import pytest
import xxhash
from conftest import rows
from pyspark.sql import functions as F
from tokenizers import Tokenizer

import corpus_pipeline
from rankfold.llm import chat, decontaminate, language, licenses, mixing, quality, queries, rolling, simhash, substrings, tokencount, urlrules
from rankfold.llm.common import Scratch, table

DATA = "/root/testdata/sf0.001"
SPACE, LETTER = re.compile(r"[^\x20\x09-\x0D]+"), re.compile(r"[^\x00-\x2F\x3A-\x60\x7B-\x7F]+")
LONG = "lorem ipsum dolor sit amet " * 400
#: Nulls, empty and very long texts, repeated rows, ties, and columns with clashing names.
ODD = [
    (1, None, "a", "x"), (1, None, "a", "x"), (2, "", None, "x"), (None, "one two three", "b", "x"), (3, LONG, "a", "x"), (4, LONG, "a", "x"),
    (4, LONG, "a", "x"), (5, "\x1c\u2003 é MIT License mit license", "b", "x"), (6, " \t\n", None, "x"), (6, "same id, other text", None, "x"),
]


@pytest.fixture(scope="module")
def odd(spark):
    df = spark.createDataFrame(ODD, "doc_id long, text string, source string, lang string")
    for c in ("fp", "rk", "doc", "key", "words", "size", "rank", "norm", "stats"):
        df = df.withColumn(c, F.lit("clash"))
    return df


@pytest.fixture(scope="module")
def texts():
    return dict(duckdb.sql(f"select doc_id, text from '{DATA}/documents.parquet'").fetchall())


@pytest.mark.parametrize("name", [n for n in queries.SQL])
def test_query_equals_its_sql(spark, name):
    con = duckdb.connect()
    for t in ("documents", "pages", "benchmark", "conversations"):
        con.execute(f"create view {t} as select * from '{DATA}/{t}.parquet'")
    got, want = queries.QUERIES[name](spark, DATA).toPandas(), con.sql(queries.SQL[name]).df()
    assert sorted(got.columns) == sorted(want.columns) and rows(got) == rows(want)


def brute_targets(total):
    """Targets of sources by resharing the excess until none is above."""
    names = sorted(total, key=lambda s: (s is None, s))
    weight = {s: (5, 2, 1)[i % 3] for i, s in enumerate(names)}
    target, left, open_ = {}, 1.5 * sum(total.values()), set(names)
    while open_:
        level = left / sum(weight[s] for s in open_)
        full = {s for s in open_ if weight[s] * level > 2 * total[s]}
        if not full:
            target |= {s: weight[s] * level for s in open_}
            break
        target |= {s: 2.0 * total[s] for s in full}
        left -= sum(target[s] for s in full)
        open_ -= full
    return target


def brute_mix(placed, slots, block=128):
    """Words taken of each row: every slot in turn takes the words of its block from the source's stream, which repeats."""
    streams, taken = {}, Counter()
    for r in sorted(placed, key=lambda r: r["first"]):
        streams.setdefault(r["sid"], []).extend([(r["sid"], r["bucket"], r["rn"])] * r["size"])
    quota = {r["sid"]: r["quota"] for r in placed}
    for r in slots:
        stream = streams[r["sid"]]
        for at in range(r["block"] * block, min((r["block"] + 1) * block, quota[r["sid"]])):
            taken[stream[at % len(stream)]] += 1
    return taken


def test_op1(spark, texts, odd):
    a = mixing.op1_mix_sources(spark, DATA).toPandas().sort_values("doc_id")
    assert rows(a) == rows(mixing.op1_mix_sources(spark, DATA).toPandas())
    src = dict(duckdb.sql(f"select doc_id, source from '{DATA}/documents.parquet'").fetchall())
    size = {d: len(SPACE.findall(t or "")) for d, t in texts.items()}
    assert dict(zip(a["doc_id"], a["size"])) == size and (a["taken"] <= 2 * a["size"]).all()
    total = Counter()
    for d, n in size.items():
        total[src[d]] += n
    target = brute_targets(total)
    a["source"] = a["doc_id"].map(src)
    for s, g in a.groupby("source", dropna=False):
        s = None if s != s else s
        assert abs(g["target"].iloc[0] - target[s]) < 1e-6 and abs(g["taken"].sum() - target[s]) < 1
    b = mixing.taken_words(mixing.mix_sources(odd)).toPandas()
    assert len(b) == len(ODD) and (b["taken"] <= 2 * b["size"]).all()


def test_op1_takes_what_its_slots_say(spark):
    made = [(i, "w " * n, s) for i, (n, s) in enumerate([(500, "a")] * 30 + [(20, "b")] * 10 + [(3, "c")] * 10 + [(1, "d"), (0, "e"), (1, None)])]
    docs = spark.createDataFrame(made, "doc_id long, text string, source string")
    m = mixing.mix_sources(docs)
    placed, slots = ([r.asDict() for r in x.collect()] for x in (m.documents, m.slots))
    got = {(r.sid, r.bucket, r.rn): r.n for r in m.pieces.groupBy("sid", "bucket", "rn").agg(F.sum("n_words").alias("n")).collect()}
    assert got == dict(brute_mix(placed, slots))
    total = Counter()
    for _, t, s in made:
        total[s] += t.count("w")
    by_source = Counter()
    for r in placed:
        by_source[r["source"]] += got.get((r["sid"], r["bucket"], r["rn"]), 0)
    # Small sources too get their target: 60 words of 30, 2 of 1.
    assert all(abs(by_source[s] - t) < 1 for s, t in brute_targets(total).items()) and by_source["c"] == 60 and by_source[None] == 2
    # Every block but a source's last has all its words, and sources come evenly: no prefix of the slots is off by many.
    blocks = m.pieces.groupBy("sid", "slot").agg(F.sum("n_words").alias("n")).toPandas()
    assert (blocks["n"] <= 128).all() and (blocks.groupby("sid")["n"].apply(lambda n: (n < 128).sum()) <= 1).all()
    order = [r["sid"] for r in sorted(slots, key=lambda r: r["slot"])]
    share = order.count(0) / len(order)
    assert all(abs(order[:k].count(0) - share * k) <= 8 for k in range(1, len(order)))


def test_op2_edges(spark):
    urls = [None, "", "nourl", "HTTP://A.Example.COM/en/71?x", "x://com/en/", "x://xcom/en/", "x://a.net", "x://example.net/de/8", "x://b.org/es/#a", "x://q?://com/en/", "x://spam-farm.io"]
    df = spark.createDataFrame([(i, u, "c") for i, u in enumerate(urls)], "page_id long, url string, host string")
    got = {r.page_id: (r.host, r.path, r.rule, r.verdict) for r in urlrules.judge_urls(df).collect()}
    assert got[0] == got[2] == ("", "", None, "allow")
    assert got[3] == ("a.example.com", "/en/71", "example.com/en/7", "allow") and got[4][2:] == ("com/en/", "block")
    assert got[5][2] is None and got[7][2:] == ("example.net/de/8", "block") and got[8][1:] == ("/es/", "org/es/", "block")
    assert got[9][:3] == ("q", "", None) and got[10][3] == "block"


def test_op3_short_items_and_edges(spark, odd):
    items = spark.createDataFrame([(1, "Sit Amet lorem"), (2, None), (3, "absent words here"), (1, "sit amet lorem"), (None, "dolor")], "item_id long, text string")
    got = decontaminate.judge_contamination(odd, items).toPandas()
    hit = got[got["contaminated"]]
    assert len(got) == len(ODD) and sorted(hit["doc_id"]) == [3, 4, 4] and (hit["n_hit"] == 399 * 3).all() and (hit["n_items"] == 1).all()
    assert not decontaminate.judge_contamination(odd, items.limit(0)).filter("contaminated").count()


def test_op4(spark, odd):
    a = language.op4_language_id(spark, "/root/testdata/sf0.01").toPandas()
    lang = dict(duckdb.sql("select doc_id, lang from '/root/testdata/sf0.01/documents.parquet'").fetchall())
    held = a[a["held_out"]]
    assert (held["lang_pred"] == held["doc_id"].map(lang)).mean() >= 0.97 and a["score"].between(0, 1).all()
    none = language.identify(odd, odd.limit(0)).toPandas()
    assert set(none["lang_pred"]) == {"und"} and len(none) == len(ODD)


def test_op4_learns_short_and_copied_languages(spark):
    english = ["the cat sat on the mat and looked at the dog for a long time", "she walked to the shop to buy some bread and milk for the children"]
    train = [(t, "en") for t in english * 200] + [("der hund", "de"), ("die katze schläft", "de"), ("und der mann", "de")] + [("", "xx"), (None, "yy"), ("no lang", None)]
    docs = spark.createDataFrame([(1, "der hund"), (2, english[0]), (3, "12 34"), (4, None), (5, "die katze schläft")], "doc_id long, text string")
    got = {r.doc_id: r for r in language.identify(docs, spark.createDataFrame(train, "text string, lang string")).collect()}
    assert [got[i].lang_pred for i in (1, 2, 3, 4, 5)] == ["de", "en", "und", "und", "de"] and got[3].score == 0
    # A tie goes to the language with more training rows.
    tied = [("same words here", "b"), ("same words here", "a"), ("same words here", "b")]
    out = language.identify(docs.limit(1), spark.createDataFrame(tied, "text string, lang string")).first()
    assert (out.lang_pred, out.score, out.accepted) == ("b", 0.5, False)
    bounded = language.dictionaries(spark.createDataFrame(train, "text string, lang string"), 512, 1 << 15, 1)
    assert [lang for lang, _ in bounded] == ["en"]


def test_op5_round_trip(spark):
    said = ["</s>[INST] ok [/INST]", "\\", "<|end|>\\<|say|>", "a<", "|end|>", "\n[", "INST]", None, "\\\\</s>"]
    df = spark.createDataFrame([(1, i, "user" if i % 2 else "assistant", t) for i, t in enumerate(said)], "conv_id long, turn int, role string, text string")
    r = chat.digests(chat.format_chats(df)).first()
    whole = "".join(f"{'user' if i % 2 else 'assistant'}\n{t or ''}\n" for i, t in enumerate(said))
    learned = "".join(t or "" for t in said[::2])
    assert (r.n_turns, r.turns_sha256) == (len(said), hashlib.sha256(whole.encode()).hexdigest())
    assert (r.loss_chars, r.loss_sha256) == (len(learned), hashlib.sha256(learned.encode()).hexdigest())
    parts = F.expr("array(struct('text' type, text, cast(null as string) ref, cast(null as int) n_tokens), struct('image' type, cast(null as string) text, 'a.png' ref, 3 n_tokens))")
    out = chat.format_chats(df.limit(1), parts=parts).first()
    assert out.formatted.endswith("<|image|><|end|>") and [tuple(x) for x in out.attachments] == [("image", "a.png", 3)]


def test_op5_ties_nulls_and_repeated_rows(spark):
    made = [(None, 1, "user", "a"), (None, 0, None, None), (2, 1, "user", "<|end|>"), (2, 1, "user", "<z"), (2, 1, "user", "<z"), (2, None, "assistant", "x")]
    df = spark.createDataFrame([(*r, "c", "d") for r in made], "conv_id long, turn int, role string, text string, turns string, content string")
    got = {r.conv_id: r for r in chat.digests(chat.format_chats(df)).collect()}
    said = lambda rows_: hashlib.sha256("".join(f"{r or ''}\n{t or ''}\n" for r, t in rows_).encode()).hexdigest()
    assert got[None].turns_sha256 == said([(None, None), ("user", "a")])
    assert got[2].turns_sha256 == said([("assistant", "x"), ("user", "<z"), ("user", "<z"), ("user", "<|end|>")])
    assert chat.digests(chat.format_chats(df.limit(0))).count() == 0
    long = spark.createDataFrame([(1, 0, "assistant", LONG * 200)], "conv_id long, turn int, role string, text string")
    assert chat.digests(chat.format_chats(long)).first().loss_chars == len(LONG) * 200


def brute_repeats(docs, width=20):
    seen, gone = set(), {}
    for d, t in sorted(docs):
        w = (t or "").encode().split()
        gone[d] = set()
        for i in range(len(w) - width + 1):
            k = tuple(w[i : i + width])
            if k in seen:
                gone[d] |= set(range(i, i + width))
            seen.add(k)
    return {d: len(g) for d, g in gone.items()}


@pytest.mark.parametrize("batches", [1, 7])
def test_op6_batches_and_compaction(spark, texts, batches):
    got = substrings.remove_repeats(table(spark, DATA, "documents"), batches=batches).toPandas()
    assert dict(zip(got["doc_id"], got["n_removed"])) == brute_repeats(texts.items())


def test_op6_edges(spark, odd):
    got = substrings.remove_repeats(odd).toPandas()
    assert len(got) == len(ODD)
    n = dict(zip(got["doc_id"], got["n_removed"]))
    assert n[3] == 2000 - 5 and n[4] == 2000  # the first five starts of the period are new
    assert substrings.remove_repeats(odd.limit(0)).count() == 0
    same = rolling.find_words(np.frombuffer(b"a b\x1cc", np.uint8), np.array([0, 1, 1, 5]))
    assert same.counts.tolist() == [1, 0, 1]


def test_op6_tells_complements_apart(spark):
    """Thue-Morse words of two letters and their complements: equal under any polynomial hash modulo 2^64."""
    a = "a"
    for _ in range(10):
        a += a.translate(str.maketrans("ab", "ba"))
    head = " ".join(f"w{i}" for i in range(19))
    docs = [(1, f"{head} {a}"), (2, f"{head} {a.translate(str.maketrans('ab', 'ba'))}"), (3, f"{head} {a}")]
    got = substrings.remove_repeats(spark.createDataFrame(docs, "doc_id long, text string"), batches=1)
    assert {r.doc_id: r.n_removed for r in got.collect()} == {1: 0, 2: 0, 3: 20}
    letters = [c for c in a]
    other = [{"a": "b", "b": "a"}[c] for c in a]
    ids = rolling.find_words(np.frombuffer(" ".join(letters + other).encode(), np.uint8), np.array([0, 4095])).hashes()[0]
    assert len(np.unique(rolling.chain(ids, 1024)[[0, 1024]])) == 2


@pytest.mark.parametrize("most", [64, 300])
def test_pieces_of_long_texts_hold_every_window_once(most):
    random = np.random.default_rng(2)
    texts = ["x" * 500 + " y " + "z" * 700, "", None, " ".join(f"v{i}" for i in random.integers(0, 50, 2000)), " a  b\n", "q " * 90]
    import pyarrow as pa

    column = pa.array(texts, pa.string())
    for width in (1, 5, 20):
        whole = rolling.find_words(*rolling.column_bytes(column))
        inside = whole.inside(width)
        want = Counter((int(d), int(i - whole.first[d]), int(h)) for i, (d, h) in enumerate(zip(whole.doc, rolling.chain(whole.hashes()[0], width))) if inside[i])
        got = Counter()
        for row, words, skipped in rolling.word_slices(column, width, most):
            ok = words.inside(width)
            for i, h in enumerate(rolling.chain(words.hashes()[0], width)):
                if ok[i]:
                    d = int(words.doc[i])
                    got[(row + d, int(i - words.first[d]) + skipped, int(h))] += 1
        assert got == want
    for a, b in zip(rolling.shingle_sets(column, 5, most), rolling.shingle_sets(column, 5), strict=True):
        assert a.tolist() == b.tolist()


def test_op6_hot_windows_meet_in_two_rounds(spark, monkeypatch):
    """With a low limit every fingerprint is hot, and a window of all rows is dealt to salted shards."""
    monkeypatch.setattr(substrings, "HOT", 2)
    common = " ".join(f"c{i}" for i in range(30))
    docs = [(i, f"x{i} y{i} {common} z{i} {' '.join(f'o{i % 7}_{k}' for k in range(25))}") for i in range(400)]
    got = substrings.remove_repeats(spark.createDataFrame(docs, "doc_id long, text string").repartition(8), batches=2)
    assert {r.doc_id: r.n_removed for r in got.collect()} == brute_repeats(docs)


def test_op7(spark, texts, odd):
    def check(got, docs):
        for d, t in docs:
            w, places, labels = LETTER.findall((t or "").translate(urlrules.ASCII_LOWER)), [], set()
            for label, p in licenses.BASE_PHRASES.items():
                q = p.split()
                found = [i for i in range(len(w) - len(q) + 1) if w[i : i + len(q)] == q]
                places += found
                labels |= {label} if found else set()
            assert got[d][:3] == (len(w), len(places), ",".join(sorted(labels)))
            if places:
                assert got[d][3:] == (min(places), max(places))

    of = lambda df: {r.doc_id: (r.n_words, r.n_base, r.base_labels, *([r.first_word, r.last_word] if r.n_base else [])) for r in df.collect()}
    check(of(licenses.op7_license_scan(spark, DATA)), texts.items())
    extra = [(1, "GNU General Public License, mit license mit license cc by cc-by apache licenses"), (2, "cc by cc"), (3, None)]
    df = spark.createDataFrame(extra, "doc_id long, text string")
    check(of(licenses.scan_licenses(df)), extra)
    found = licenses.detections(spark.createDataFrame([(1, "x licensed under the apache license version 2 0 y")], "doc_id long, text string")).collect()
    assert [(r.label, r.start, r.stop) for r in found] == [("apache", 1, 9)]
    assert licenses.scan_licenses(odd).count() == len(ODD) and licenses.scan_licenses(odd.limit(0)).count() == 0
    long = spark.createDataFrame([(1, "MIT License. " * 20_000)], "doc_id long, text string")
    assert licenses.scan_licenses(long).first().n_base == 20_000


def brute_detections(text):
    """What survives of every rule's matches, each against all others."""
    words = LETTER.findall((text or "").translate(urlrules.ASCII_LOWER))
    norm = f" {' '.join(words)} " if words else " "
    found = []
    for rule, label, _, pattern, priority, sure in licenses.rules():
        for m in re.finditer(pattern, norm):
            start = norm[: m.start()].count(" ") - 1
            found.append((start, start + m.group().count(" ") + 1, priority, rule, label, sure))
    stay = []
    for x in found:
        hidden = False
        for y in found:
            if x is y or y[0] > x[0] or y[1] < x[1]:
                continue
            longer = y[:2] != x[:2]
            # A longer one hides it unless its own priority is higher; of equal spans the higher priority, then the lower rule.
            hidden |= y[2] >= x[2] if longer else (-y[2], y[3]) < (-x[2], x[3])
        if not hidden:
            stay.append(x)
    return stay


def test_op7_detections_equal_brute_force(spark, texts):
    said = [
        "licensed under gplv3", "released under the LGPLv3 license", "redistribute it and/or modify it under the terms of the GNU GPL", "MIT license, mit license; Apache License 2.0", None, "",
        "Licensed under the Apache License, Version 2.0 (the \"License\"); you may not use this file except in compliance with the License.", "GNU General Public License version 2 or GPL-2.0 license",
        "Permission is hereby granted, free of charge, to any person obtaining a copy of this software", "CC BY-SA 4.0 license / cc by license", "all rights reserved. All Rights Reserved", "This work is licensed under a Creative Commons Attribution 4.0 International License",
    ]
    docs = [(-1 - i, t) for i, t in enumerate(said)] + [(d, t) for d, t in texts.items()]
    df = spark.createDataFrame(docs, "doc_id long, text string")
    got = Counter((r.doc_id, r.start, r.stop, r.priority, r.rule_id) for r in licenses.detections(df).collect())
    want = Counter((d, *x[:4]) for d, t in docs for x in brute_detections(t))
    assert got == want
    score = {r.doc_id: (r.labels, r.score) for r in licenses.scan_licenses(df).collect()}
    for d, t in docs:
        held = brute_detections(t)
        w = LETTER.findall((t or "").translate(urlrules.ASCII_LOWER))
        base = {label for label, p in licenses.BASE_PHRASES.items() if f" {p} " in f" {' '.join(w)} "}
        assert score[d] == (",".join(sorted(base | {x[4] for x in held})), max([0.9 * bool(base), *(x[5] for x in held)])), t


def spelled(parts):
    """Every string of a parsed expression of literals, sets, groups, choices and optional parts."""
    out = [""]
    for op, arg in parts:
        kind = str(op)
        if kind in ("ASSERT", "ASSERT_NOT"):
            continue
        if kind == "LITERAL":
            more = [chr(arg)]
        elif kind == "IN":
            more = [chr(c) for o, v in arg for c in (range(v[0], v[1] + 1) if str(o) == "RANGE" else [v])]
        elif kind == "SUBPATTERN":
            more = spelled(arg[3])
        elif kind == "BRANCH":
            more = [x for branch in arg[1] for x in spelled(branch)]
        elif kind == "MIN_REPEAT":  # any characters: one word stands for them
            more = ["x"]
        else:
            assert kind == "MAX_REPEAT" and arg[:2] == (0, 1)
            more = ["", *spelled(arg[2])]
        out = [a + b for a in out for b in more]
    return out


def test_op7_every_match_holds_its_keyword():
    for _, _, keyword, regex, _, _ in licenses.rules():
        forms = {keyword, *(f for f, k in licenses.FORMS.items() if k == keyword)}
        for match in spelled(re._parser.parse(regex)):
            words = set(match.split())
            assert words & forms and words & set(licenses.TRIGGERS) and any(x in match for x in licenses.LETTERS), match


def test_op7_forms_of_keywords(spark):
    said = {1: ("licensed under GPLv3", "gpl"), 2: ("released under the LGPLv2.1", "lgpl"), 3: ("AGPLv3 license", "agpl"), 4: ("GPL license, GPLv2 license and gplv3 license", "gpl")}
    df = spark.createDataFrame([(i, t) for i, (t, _) in said.items()], "doc_id long, text string")
    assert {r.doc_id: r.labels for r in licenses.scan_licenses(df).collect()} == {i: x for i, (_, x) in said.items()}
    found = [tuple(r) for r in licenses.detections(df.filter("doc_id = 4")).select("rule_id", "start", "stop").collect()]
    assert found and len(found) == len(set(found))


def brute_components(fp, radius=4):
    ids = sorted(fp)
    x = np.array([fp[i] for i in ids], np.int64).view(np.uint64)
    root = list(range(len(ids)))

    def find(i):
        while root[i] != i:
            i = root[i]
        return i

    for i in range(len(ids)):
        for j in np.flatnonzero(np.bitwise_count(x ^ x[i]) <= radius):
            a, b = find(i), find(int(j))
            root[max(a, b)] = min(a, b)
    return {ids[i]: ids[find(i)] for i in range(len(ids))}


def test_op8(spark, texts, odd):
    got = {r.doc_id: (r.fingerprint, r.component_id) for r in simhash.op8_simhash(spark, DATA).collect()}
    fp = {}
    for d, t in texts.items():
        w = (t or "").encode().translate(simhash.BYTES_LOWER).split()
        h = [xxhash.xxh64_intdigest(b" ".join(w[i : i + 4]), 42) for i in range(max(1, len(w) - 3))] if w else []
        fp[d] = int(np.uint64(sum(1 << i for i in range(64) if 2 * sum(x >> i & 1 for x in h) > len(h))).astype(np.int64))
    want = brute_components(fp)
    assert got == {d: (f"{fp[d] & (1 << 64) - 1:016x}", want[d]) for d in fp}
    scratch = Scratch(spark, "test")
    prints = simhash.fingerprints(odd.filter("doc_id is not null"))
    assert {r.component_id for r in prints.join(simhash.near_duplicates(prints, scratch=scratch), "fp").filter("doc_id in (1, 2)").collect()} == {1}


@pytest.mark.parametrize("how", [{}, {"most": 40}, {"sample": 200, "shard": 30, "shards": 40}])
def test_op8_dense_groups_and_split_shards(spark, how):
    random = np.random.default_rng(3)
    base = random.integers(0, 1 << 63, 30)
    x = [int(b) ^ sum(1 << int(i) for i in random.integers(0, 62, 2)) for b in base for _ in range(40)]
    fp = {i: v for i, v in enumerate(x)}
    scratch = Scratch(spark, "test")
    nodes = spark.createDataFrame([(v, v) for v in set(x)], "id long, p0 long")
    found = simhash.links(nodes, parts=simhash.parts_of(1, 3), within=4, scratch=scratch, **how)
    roots = {r.node: r.root for r in simhash.components(found, scratch).collect()}
    want = brute_components(fp)
    group = {}
    for i, v in fp.items():
        group.setdefault(want[i], set()).add(roots.get(v, v))
    assert all(len(g) == 1 for g in group.values()) and len({min(g) for g in group.values()}) == len(group)


def test_op8_random_pairs_at_every_distance(spark):
    """Pairs of random fingerprints at 0 to 8 bits: the trees find all up to four and none beyond."""
    random = np.random.default_rng(8)
    made = []
    for k in range(900):
        a = int(random.integers(0, 1 << 63, dtype=np.int64))
        b = a
        for i in random.choice(63, k % 9, replace=False):
            b ^= 1 << int(i)
        made.append((a, b, k % 9))
    nodes = spark.createDataFrame([(v, v) for v in {x for a, b, _ in made for x in (a, b)}], "id long, p0 long")
    found = {(r.a, r.b) for r in simhash.links(nodes, parts=simhash.parts_of(1, 3), within=4, shard=50, shards=60, scratch=Scratch(spark, "test")).collect()}
    for a, b, k in made:
        assert a == b or ((max(a, b), min(a, b)) in found) == (k <= 4)


@pytest.mark.parametrize("n", [500, 2000])
def test_op8_dense_balls_give_few_links(spark, n):
    random = np.random.default_rng(4)
    x = {0}
    while len(x) < n:
        x.add(sum(1 << int(i) for i in random.choice(63, 4, replace=False)))
    nodes = spark.createDataFrame([(v, v) for v in x], "id long, p0 long")
    scratch = Scratch(spark, "test")
    found = scratch.save(simhash.links(nodes, parts=simhash.parts_of(1, 3), within=4, scratch=scratch), "found")
    assert found.count() <= 8 * n
    assert simhash.components(found, scratch).select("root").distinct().count() == 1


def test_trees_keep_near_points_together():
    random = np.random.default_rng(5)
    x = random.integers(0, 1 << 21, 4000).astype(np.uint64)
    tree = simhash.grow_tree(x[:1000], 60)
    leaves = {}
    for leaf, at in simhash.walk_tree(tree, x):
        for i in at.tolist():
            leaves.setdefault(i, set()).add(leaf)
    assert len({k for v in leaves.values() for k in v}) > 20 and sum(map(len, leaves.values())) < 8 * len(x)
    for i in range(0, 4000, 7):
        for j in np.flatnonzero(np.bitwise_count(x ^ x[i]) <= 1).tolist():
            assert leaves[i] & leaves[j]


def brute_overlap(texts):
    sets = []
    for t in texts:
        w = (t or "").encode().translate(simhash.BYTES_LOWER).split()
        sets.append({tuple(w[i : i + 5]) for i in range(max(1, len(w) - 4))} if w else set())
    root = list(range(len(sets)))

    def find(i):
        while root[i] != i:
            i = root[i]
        return i

    for i, x in enumerate(sets):
        for j in range(i):
            if len(x & sets[j]) >= 0.8 * len(x | sets[j]):
                a, b = find(i), find(j)
                root[max(a, b)] = min(a, b)
    return [find(i) for i in range(len(sets))]


def test_overlap_groups_equal_brute_force(texts):
    some = [*list(texts.values())[:120], None, "", " ", "one two", "One TWO", LONG, LONG]
    assert simhash.overlap_groups(some).tolist() == brute_overlap(some)


def test_near_dedup_keeps_one_of_each_group(spark, odd):
    docs = table(spark, DATA, "documents")
    x = docs.select("doc_id", "text").orderBy("doc_id").toPandas()
    x["group"] = brute_overlap(x["text"])
    kept = {r.doc_id for r in corpus_pipeline.near_dedup(spark, docs, DATA).select("doc_id").collect()}
    n = x.groupby("group")["doc_id"].agg(lambda ids: len(kept & set(ids)))
    assert (n == 1).all() and kept == set(x.groupby("group")["doc_id"].min())
    assert corpus_pipeline.near_dedup(spark, docs.limit(0), DATA).count() == 0
    ids = [r.doc_id for r in corpus_pipeline.near_dedup(spark, odd, DATA).select("doc_id").collect()]
    assert sorted(ids, key=str) == [1, 3, 5, 6, None]


def edited_pairs(kind, level, n=60, length=300, seed=11):
    """n pairs of Zipf-like texts, with a Jaccard of at least `level` and at most 0.03 more, by one kind of edit."""
    random, share = np.random.default_rng([seed, *kind.encode()]), 1 / np.arange(1, 20001)
    some, made = lambda k: [f"z{v}" for v in random.choice(20000, k, p=share / share.sum())], []
    while len(made) < n:
        w = some(length)
        for k in range(1, length):
            at, x = int(random.integers(0, length - min(k, length - 1))), list(w)
            if kind == "appended":
                x += some(k)
            elif kind == "replaced":
                x[at : at + k] = some(k)
            else:
                for i in random.choice(length, k, replace=False):
                    x[i] = f"y{random.integers(0, 10**6)}"
            a, b = ({tuple(v[i : i + 5]) for i in range(len(v) - 4)} for v in (w, x))
            j = len(a & b) / len(a | b)
            if j < level + 0.03:
                if j >= level:
                    made.append((" ".join(w), " ".join(x)))
                break
    return made


def test_near_dedup_finds_block_edits(spark):
    made = [t for kind in ("appended", "replaced", "scattered") for pair in edited_pairs(kind, 0.8) for t in pair]
    docs = spark.createDataFrame(list(enumerate(made)), "doc_id long, text string")
    kept = {r.doc_id for r in corpus_pipeline.near_dedup(spark, docs, DATA).collect()}
    # All first texts stay; of their copies, all just above the level, a few in a hundred may be missed.
    assert kept >= set(range(0, len(made), 2)) and len(kept) - len(made) // 2 <= 0.04 * len(made) / 2


def near_pairs(n, pairs, seed=5):
    """n unalike texts of 100 words and, for the first ones, a copy with a contiguous block replaced: 0.81 to 0.86 alike."""
    random = np.random.default_rng(seed)
    made = [" ".join(f"u{v}" for v in random.integers(0, 5000, 100)) for _ in range(n)]
    for k in range(pairs):
        w, at, size = made[k].split(), int(random.integers(10, 80)), 4 if k % 2 else 6
        w[at : at + size] = [f"e{v}" for v in random.integers(0, 10**6, size)]
        made.append(" ".join(w))
    return made


def test_near_dedup_of_many_pairs(spark):
    made = near_pairs(3000, 3000)
    docs = spark.createDataFrame(list(enumerate(made)), "doc_id long, text string")
    kept = {r.doc_id for r in simhash.near_dedup(docs).collect()}
    assert kept >= set(range(3000)) and len(kept) - 3000 <= 0.01 * 3000


@pytest.mark.parametrize(("most", "most_bytes"), [(1000, 8 << 20), (25, 8 << 20), (1000, 4000)])
def test_alike_links_equal_brute_force(spark, texts, most, most_bytes):
    """One component of all texts, small and cut into cells: the groups are those of comparing all pairs."""
    star = " ".join(f"s{i}" for i in range(150)).split()
    copies = [" ".join([*star[:i], f"x{i}", *star[i + 1 :]]) for i in range(0, 150, 2)]
    worse = [" ".join([*star[: i * 5], *(f"q{i}_{k}" for k in range(22)), *star[i * 5 + 22 :]]) for i in range(25)]
    made = [*list(texts.values())[:60], None, "", "one two", "One TWO", LONG, *near_pairs(30, 15), *copies, *worse, *worse[:3]]
    prints = [int(simhash.majority(h[:, None]).view(np.int64)[0]) for h in rolling.shingle_sets(__import__("pyarrow").array(made), 5)]
    df = spark.createDataFrame([(i, 7, len((t or "").encode()), p, t) for i, (t, p) in enumerate(zip(made, prints))], "id long, root long, bytes long, p0 long, text string")
    scratch = Scratch(spark, "test")
    found = simhash.components(simhash.alike_links(df, most=most, most_bytes=most_bytes, scratch=scratch), scratch)
    got = {r.node: r.root for r in found.collect()}
    assert [got.get(i, i) for i in range(len(made))] == brute_overlap(made)


def test_op9(spark, texts, odd):
    t = Tokenizer.from_file(public_tokenizers.path("byte_bpe_50k.json"))
    n = lambda x: len(t.encode(x or "", add_special_tokens=False).ids)
    got = {r.doc_id: (r.n_bytes, r.n_tokens, r.over_limit) for r in tokencount.op9_token_counts(spark, DATA).collect()}
    assert got == {d: (len((x or "").encode()), n(x), n(x) > 512) for d, x in texts.items()}
    count = tokencount.Counting(public_tokenizers.path("byte_bpe_50k.json"), {}).count
    random = np.random.default_rng(1)
    parts = [*" \n\t\x1c\x85\u00a0aZ9é½'s<|>", "<|endoftext|>", "'ll", "漢", "😀", "  "]
    for _ in range(3000):
        x = "".join(random.choice(parts, random.integers(0, 12)))
        assert count(x) == n(x), repr(x)
    assert tokencount.count_tokens(odd).count() == len(ODD) and tokencount.count_tokens(odd.limit(0)).count() == 0


def test_op9_unusual_texts_use_both_tiers():
    path = public_tokenizers.path("byte_bpe_50k.json")
    t = Tokenizer.from_file(path)
    count = tokencount.Counting(path, {})
    text = "the quick brown fox 😀 jumps over \u180e the  lazy dog <|endoftext|> and\u0085 runs away" * 20
    assert count.count(text) == len(t.encode(text, add_special_tokens=False).ids)
    assert {" quick", " brown", " lazy"} <= set(count) and not any(tokencount.Counting.count and len(p) > tokencount.LONGEST for p in count)
    random = np.random.default_rng(6)
    parts = ["a", " b", "  ", "😀", " 漢", "\u180e", "\u0085", "\n", " Z", "9", " !", "é", "\u1e9e", "\U0001f600 x", "<|endoftext|>", "'s"]
    for _ in range(4000):
        x = "".join(random.choice(parts, random.integers(0, 14)))
        assert count.count(x) == len(t.encode(x, add_special_tokens=False).ids), repr(x)
    assert count.count("x" * 100_000 + " y") == len(t.encode("x" * 100_000 + " y", add_special_tokens=False).ids)


def test_op10_on_held_out_labels(spark):
    """Fitted on the labels of even ids, judged on those of odd ids."""
    d = "/root/testdata/sf0.1"
    docs, labels = table(spark, d, "documents"), table(spark, d, "labels")
    found = quality.fit(docs, labels.filter("doc_id % 2 = 0"))
    out = quality.judge_quality(docs.select("doc_id", "text"), found).join(labels.filter("doc_id % 2 = 1"), "doc_id").filter("not base_failed").select("quality", "kept").toPandas()
    good, bad = out[out["quality"] == 1]["kept"], out[out["quality"] == 0]["kept"]
    assert len(good) > 100 and len(bad) > 20 and good.mean() > 0.97 and bad.mean() < 0.1
    none = quality.fit(docs, labels.limit(0))
    assert none.rules == () and quality.judge_quality(docs.select("doc_id", "text"), none).filter("kept = base_failed").count() == 0


def test_op10(spark, texts, odd):
    got = {r.doc_id: r for r in quality.op10_quality_rules(spark, DATA).collect()}
    for d, t in texts.items():
        w = SPACE.findall(t or "")
        c, hit = Counter(zip(w, w[1:], w[2:])), set()
        for i in range(len(w) - 2):
            if c[tuple(w[i : i + 3])] > 1:
                hit |= {i, i + 1, i + 2}
        lines = [x for x in (t or "").split("\n") if SPACE.search(x)]
        want = (len(w), sum(map(len, w)), len(re.findall(r"[#*$%&|<>]", t or "")), len(lines) - len(set(lines)), len(hit))
        r = got[d]
        assert (r.n_words, r.word_chars, r.n_symbols, r.n_dup_lines, r.n_repeat_words) == want
        assert r.base_failed == (len(w) < 50 or 100 * len(hit) > 50 * len(w)) and not (r.base_failed and r.kept)
    d = "/root/testdata/sf0.01"
    labels = duckdb.sql(f"select doc_id, quality from '{d}/labels.parquet'").fetchall()
    kept = {r.doc_id: (r.base_failed, r.kept) for r in quality.op10_quality_rules(spark, d).collect()}
    good = [kept[i] for i, q in labels if q == 1 and not kept[i][0]]
    bad = [kept[i] for i, q in labels if q == 0 and not kept[i][0]]
    assert np.mean([k for _, k in good]) > 0.98 and np.mean([k for _, k in bad]) < 0.1
    assert quality.judge_quality(odd, quality.DecisionList(()), name="_s").count() == len(ODD)


def brute_contaminated(texts, items, width=10):
    """Ids of texts that hold a window of an item's words."""
    words = lambda t: LETTER.findall((t or "").translate(urlrules.ASCII_LOWER))
    wins = set()
    for t in items:
        w = words(t)
        n = min(width, len(w))
        wins |= {tuple(w[i : i + n]) for i in range(len(w) - n + 1)} if w else set()
    sizes = {len(x) for x in wins}
    hit = set()
    for d, t in texts:
        w = words(t)
        if any(tuple(w[i : i + n]) in wins for n in sizes for i in range(len(w) - n + 1)):
            hit.add(d)
    return hit


def brute_kept_words(docs, width=20):
    """The words of each text that no repeated window covers."""
    seen, out = set(), {}
    for d, t in sorted(docs):
        w = (t or "").encode().split()
        gone = set()
        for i in range(len(w) - width + 1):
            k = tuple(w[i : i + width])
            if k in seen:
                gone |= set(range(i, i + width))
            seen.add(k)
        out[d] = (len(w), [x for i, x in enumerate(w) if i not in gone])
    return out


def test_pipeline(spark):
    """Every stage on what its predecessor kept, against brute force (the learned list against its rules in pandas)."""
    docs, scratch = table(spark, DATA, "documents"), Scratch(spark, "test-pipeline")
    benchmark = [r.text for r in table(spark, DATA, "benchmark").collect()]
    for name, stage in corpus_pipeline.STAGES:
        before = {r.doc_id: r.text for r in docs.collect()}
        out = scratch.save(stage(spark, docs, DATA), name)
        rows_ = out.collect()
        after = {r.doc_id: r.text for r in rows_}
        assert len(after) == len(rows_) and set(after) <= set(before), name
        if name != "mix":
            assert out.columns == docs.columns
        if name == "quality_rules":
            rules = quality.fit(docs, table(spark, DATA, "labels"))
            x = quality.pd.DataFrame([quality.text_counts(t) for t in before.values()], columns=quality.COUNTS, index=list(before))
            failed = (x["n_words"] < 50) | (100 * x["n_repeat_words"] > 50 * x["n_words"])
            ratios = quality.pd.DataFrame({r: x.eval(re.sub(r"cast\((\w+) as double\)", r"\1", re.sub(r"greatest\((\w+), 1\)", r"(\1 + (\1 < 1))", sql))) for r, sql in quality.RATIOS.items()}).astype(float)
            rejected = failed.copy()
            for rule in rules.rules:
                rejected |= quality._cover(rule, ratios)
            assert set(after) == set(x.index[~rejected])
        elif name == "near_dedup":
            ids = sorted(before)
            assert set(after) == {ids[i] for i in set(brute_overlap([before[d] for d in ids]))}
        elif name == "substring_dedup":
            for d, (n, kept) in brute_kept_words(before.items()).items():
                assert (d in after) == (bool(kept) or not n)
                if d in after:
                    assert after[d] == before[d] if len(kept) == n else after[d] == b" ".join(kept).decode()
        elif name == "decontamination":
            assert set(after) == set(before) - brute_contaminated(before.items(), benchmark)
        docs = out
    total = Counter()
    source = dict(duckdb.sql(f"select doc_id, source from '{DATA}/documents.parquet'").fetchall())
    for d, t in before.items():
        total[source[d]] += len(SPACE.findall(t))
    taken = Counter()
    for r in rows_:
        taken[r.source] += r.taken
        assert 1 <= r.taken <= 2 * r["size"] and sum(p.n_words for p in r.places) == r.taken
    assert all(abs(taken[s] - t) < 1 for s, t in brute_targets(total).items())
