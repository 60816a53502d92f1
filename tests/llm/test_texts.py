"""Encodings, look-alikes, languages, packing and leaks."""

import random
from collections import Counter, defaultdict

import numpy as np
import pyarrow as pa
import pytest
from pyspark.sql import functions as F

from stanzaflow.llm import encoding, languages, leaks, lookalikes, packing, tables


@pytest.fixture(scope="module")
def lines(spark, small):
    return [(r.lang, r.text) for r in spark.read.parquet(f"{small}/lang_samples.parquet").orderBy("sample_id").collect()]


@pytest.fixture(scope="module")
def model(lines):
    return encoding.fit([t for i, (_, t) in enumerate(lines) if i % 2])


def test_misread_text_is_found_and_restored(model, lines):
    held = [t for i, (_, t) in enumerate(lines) if i % 2 == 0]
    found, back, all_pairs = Counter(), Counter(), Counter()
    for pair in encoding.PAIRS:
        if pair[1] == "utf-8" or pair[2] == "lower":
            continue
        for t in held:
            bad = encoding.misread(t, pair)
            if bad is None or sum(a != b for a, b in zip(bad, t, strict=False)) < 4 or pair[1].startswith("utf-16") and len(t.encode(pair[0])) % 2:
                continue
            all_pairs[pair] += 1
            paths = encoding.clean_mask(model, [bad])
            if 0 in paths:
                text, ok, used = encoding.repair(model, bad, paths[0])
                found[pair] += bool(used)
                back[pair] += text == t
    assert sum(all_pairs.values()) > 500
    assert sum(found.values()) / sum(all_pairs.values()) > 0.98
    assert sum(back.values()) / sum(all_pairs.values()) > 0.94


def test_clean_text_is_left_alone(model, lines):
    held = [v for i, (_, t) in enumerate(lines) if i % 2 == 0 for v in (t, t.upper(), t.replace("'", "’"), t.title().replace(" ", "\t"), t.replace(" ", "\u3000"))]
    wrong = [i for i, p in encoding.clean_mask(model, held).items() if encoding.repair(model, held[i], p)[2]]
    assert len(wrong) / len(held) < 0.01


def test_screen_never_hides_a_better_path(model, lines):
    texts = [encoding.misread(t, p) or t for k, (_, t) in enumerate(lines[:60]) for p in [encoding.PAIRS[k % len(encoding.PAIRS)]]]
    some = set(encoding.suspects(model, texts))
    for i, path in enumerate(encoding.label(model, texts)):
        assert not path.any() or i in some


def test_encoding_operator_edges(spark, lines, small):
    samples = spark.read.parquet(f"{small}/lang_samples.parquet")
    rows = [(1, "cafÃ© mÃ¼de", None), (2, None, ""), (3, "plain", "ok â€œyesâ€\x9d " + "word " * 20_000), (1, "cafÃ© mÃ¼de", None), (None, "cafÃ©", "x"), (4, "�", "a")]
    df = spark.createDataFrame(rows, "song_index bigint, title string, plain_lyrics string").withColumn("field_name", F.lit("clash"))
    assert set(map(tuple, encoding.garbled_fields(df, samples).collect())) == {(1, "title"), (3, "plain_lyrics"), (4, "title")}
    fixed = {(r.song_index, r.field_name): r for r in encoding.repaired_fields(df, samples).collect()}
    assert fixed[1, "title"].restored_text == "café müde" and fixed[3, "plain_lyrics"].restored_text.startswith("ok “yes” word")
    assert not fixed[4, "title"].restored
    assert encoding.garbled_fields(df.limit(0), samples).count() == 0


def test_canonical_form():
    c = lookalikes.Canonical()
    cases = {
        "Ｗｉｄｅ　text": "Wide text", "𝐁old": "Bold", "café": "café", "a​b­c﻿": "abc", "no br eak": "no br eak", "ﬁre": "fire", "Lа сlосhе": "La cloche", "Μy Οrchard": "My Orchard",
        "Don’t “quote”": "Don’t “quote”", "Моя душа": "Моя душа", "oткpытoм море": "открытом море", "Моя душа / The River": "Моя душа / The River", "마": "마", "ⅣX": "IVX", "": "", "а": "а", "x о y": "x o y", "שלום": "שלום",
        "①²﹐№㎏ª ﭏ ﻻ ½": "①²,№kgª אל لا ½", "ᎡᎪᏚ ᎢᎻᎬ": "ᎡᎪᏚ ᎢᎻᎬ", "my ꓢꓳꓠꓖ": "my SONG", "Ꭲhe ꓢong": "The Song", "น้ำ … ´ ¨": "น้ำ … ´ ¨", "ŉ ǆ ﷺ": "ʼn dž صلى الله عليه وسلم",
    }
    got = c(pa.array(list(cases), pa.string())).to_pylist()
    assert dict(zip(cases, got, strict=True)) == cases
    assert c(pa.array([None], pa.string())).to_pylist() == [None]
    whole = lookalikes.Canonical(lookalikes.FORMS)
    assert whole(pa.array(["①²﹐№㎏ª ﭏ ﻻ ½™ …"], pa.string())).to_pylist() == ["12,Nokga אל لا 1⁄2TM …"]
    again = c(pa.array(got, pa.string())).to_pylist()
    assert again == got


def test_disguised_fields(spark, small):
    samples = spark.read.parquet(f"{small}/lang_samples.parquet")
    rows = [(1, "Ｗｉｄｅ", "fine"), (2, "plain", "zero​width " + "w " * 50_000), (3, "â€œMy Songâ€\x9d Ã\xa0", None), (4, "Don’t", ""), (1, "Ｗｉｄｅ", "fine"), (None, "Ｗ", "x"), (5, None, "Моя душа")]
    df = spark.createDataFrame(rows, "song_index bigint, title string, plain_lyrics string")
    assert set(map(tuple, lookalikes.disguised_fields(df, samples).collect())) == {(1, "title"), (2, "plain_lyrics")}
    assert lookalikes.disguised_fields(df.limit(0), samples).count() == 0
    signs = spark.createDataFrame([(1, "№ 5, 1º, m² ½ …", "น้ำ"), (2, "㎏", "sing﹐ my song")], "song_index bigint, title string, plain_lyrics string")
    assert set(map(tuple, lookalikes.disguised_fields(signs, samples).collect())) == {(2, "title"), (2, "plain_lyrics")}
    assert lookalikes.canonical_fields(df).where("song_index = 5").first().title is None


def test_forward_sum_equals_enumeration(lines):
    m = languages.fit(lines[:40], languages.vocabulary())

    def brute(w, k):
        n, total = len(w), 0.0
        stack = [(0, 1.0)]
        while stack:
            i, p = stack.pop()
            if i == n:
                total += p
            for j in range(i + 1, min(n, i + m.longest) + 1):
                q = m.probs[m.ids[w[i:j]], k] if w[i:j] in m.ids else 0.0
                if q:
                    stack.append((j, p * q))
        return np.log(total) - n * np.log(languages.SCALE)

    words = ["the", "moon", "año", "zq"]
    assert m.longest > 16
    got = m.score(words)
    for i, w in enumerate(languages.byte_words(words)):
        assert got[i] == pytest.approx([brute(w, k) for k in range(len(m.langs))], rel=1e-6)


def test_long_words_are_scored_whole(lines):
    m = languages.fit([*lines[:40], ("en", "a" * 3000)], languages.vocabulary())
    words = ["bromeliad" * 9, "x" * 80, "ящик" * 15, "y" * 60 + "tail", "y" * 60 + "liat"]
    side = languages.SIDE_BY_SIDE
    got = m.score(words)
    try:
        languages.SIDE_BY_SIDE = 1_000
        want = m.score(words)
    finally:
        languages.SIDE_BY_SIDE = side
    assert got == pytest.approx(want, rel=1e-9)
    assert not np.allclose(got[3], got[4])
    assert np.isfinite(m.score(["long" * 5_000])).all()


def test_held_out_lines_get_their_language(lines):
    m = languages.fit([x for i, x in enumerate(lines) if i % 2], languages.vocabulary())
    held = [x for i, x in enumerate(lines) if i % 2 == 0]
    right = sum(m.langs[int(m.score(languages.words_of(t)).sum(axis=0).argmax())] == lang for lang, t in held)
    assert right / len(held) > 0.97


def test_language_edges(spark, small, lines):
    samples = spark.read.parquet(f"{small}/lang_samples.parquet")
    by = defaultdict(list)
    for lang, t in lines:
        by[lang].append(t)
    en, es, ru = (" \n".join(by[x][:6]) for x in ("en", "es", "ru"))
    rows = [
        (1, en, "en-GB", "T"), (2, en, None, "T"), (3, f"T\n\n{en}\n\n{es}", "en", "T"), (4, "", "en", None), (5, None, None, None), (6, "[G] [C]\nAm  F", "xx", None), (7, ru, "RUS ", None), (8, es, "pt", "Una canción"), (9, " ".join(en.split()[:9]) + f"\n\n{es}", "es", None),
        (10, "{title: X}\n" + (en + "\n\n") * 60, "und", "X"),
    ]
    df = spark.createDataFrame(rows, "doc_id bigint, text string, lang string, title string").withColumn("label", F.lit("clash"))
    assert set(map(tuple, languages.label_cases(df, samples).collect())) == {(2, "en"), (3, "en"), (3, "es"), (8, "es"), (10, "en")}
    all_docs = {r.doc_id: r.lang for r in languages.document_languages(df, samples).collect()}
    assert len(all_docs) == 10 and all_docs[4] is all_docs[5] is all_docs[6] is None and all_docs[7] == "ru"
    segments = languages.document_segments(df, samples).orderBy("doc_id", "segment").collect()
    assert [(r.lang, r.first_section, r.heading) for r in segments if r.doc_id == 3][1:] == [("en", 1, False), ("es", 2, False)]
    assert [(r.lang, r.heading) for r in segments if r.doc_id == 9] == [("en", True), ("es", False)]  # nothing is left out
    assert languages.label_cases(df.limit(0), samples).count() == 0


def loads(sizes, boxes):
    load, count = Counter(), Counter()
    for n, b in zip(sizes, boxes.tolist(), strict=True):
        load[b] += n
        count[b] += 1
    return load, count


@pytest.mark.parametrize("capacity", [1, 2, 7, 64, 256, 2048, 8192])
def test_packing(capacity):
    rng = np.random.default_rng(3)
    for sizes in (rng.integers(1, capacity + 1, 5000), np.minimum(capacity, np.maximum(1, rng.lognormal(5.5, 0.5, 5000).astype(int))), np.full(70, 1), np.full(70, capacity), np.array([], int)):
        for refined in (True, False):
            boxes = packing.harmonic(sizes, capacity, refined)
            load, count = loads(sizes.tolist(), boxes)
            assert not load or max(load.values()) <= capacity and set(load) == set(range(len(load)))
    sizes = np.full(1000, max(1, capacity // 3))
    _, count = loads(sizes.tolist(), packing.harmonic(sizes, capacity, False))
    if capacity in (64, 256):  # a fixed count in all containers of a class but the last
        assert Counter(count.values())[capacity // (capacity // 3)] >= len(count) - 1


def test_packing_leaves_little_unused():
    rng = np.random.default_rng(5)
    sizes = np.clip(rng.lognormal(5.6, 0.5, 50_000).astype(int), 1, None)
    for capacity in (512, 2048, 8192):
        items = sizes[sizes < capacity]
        used = items.sum() / capacity
        assert used / (packing.harmonic(items, capacity).max() + 1) > 0.95
        assert used / (packing.harmonic(items, capacity, False).max() + 1) < used / (packing.harmonic(items, capacity).max() + 1)


def test_packing_operator(spark):
    text = "the moon rises over the hill and the river sings. "
    docs = spark.createDataFrame([(i, text * (i % 9)) for i in range(60)] + [(100, text * 400), (101, None), (102, ""), (3, text * 3), (None, text)], "doc_id bigint, text string").withColumn("tokens", F.lit("clash"))
    targets = spark.createDataFrame([(1, 64), (2, 512), (3, None), (4, 0)], "target_id bigint, capacity_tokens bigint")
    rows = packing.packed(docs, targets, shard_rows=20).collect()
    lengths = {r.doc_id: r.tokens for r in packing.token_lengths(docs).collect()}
    fill = {(r.method, r.target_id): r for r in packing.fill(docs, targets).collect()}
    assert set(fill) == {("refined", 1), ("refined", 2), ("plain", 1), ("plain", 2)} and all(r.tokens == sum(lengths.values()) and r.unused >= 0 for r in fill.values())
    caps = {1: 64, 2: 512}
    load, parts = Counter(), defaultdict(list)
    for r in rows:
        load[r.target_id, r.container] += r.tokens
        parts[r.target_id, r.doc_id].append((r.start, r.tokens))
    assert {t for t, _ in load} == {1, 2} and all(n <= caps[t] for (t, _), n in load.items())
    for (t, d), p in parts.items():
        p.sort()
        assert [s for s, _ in p] == [sum(n for _, n in p[:i]) for i in range(len(p))] and sum(n for _, n in p) == lengths[d]
        assert len(p) == 1 or lengths[d] > caps[t]
    assert {d for _, d in parts} == {d for d, n in lengths.items() if n}
    assert packing.packed(docs.limit(0), targets).count() == 0 and packing.packed(docs, targets.limit(0)).count() == 0


def brute_leaks(docs, items):
    def has(text, item):
        for shift in range(-len(item) + 20, len(text) - 19):
            lo, hi = max(0, -shift), min(len(item), len(text) - shift)
            eq = [text[k + shift] == item[k] for k in range(lo, hi)]
            for i in range(len(eq)):
                miss = 0
                for j in range(i, len(eq)):
                    miss += not eq[j]
                    if j - i + 1 >= 20 and miss * 10 <= j - i + 1:
                        return True
        return False

    return {(d, i) for d, t in docs for i, q in items if len(q) >= 20 and has(t, q)}


def test_leaks_equal_brute_force(spark, monkeypatch):
    rng = random.Random(11)
    vocab = [f"w{i}" for i in range(60)]
    items = [(i, [rng.choice(vocab) for _ in range(rng.randint(15, 60))]) for i in range(12)]
    docs = []
    for d in range(120):
        words = [rng.choice(vocab) for _ in range(rng.randint(0, 60))]
        item = list(rng.choice(items)[1])
        n = rng.randint(14, len(item))
        at = rng.randint(0, len(item) - n)
        part = item[at : at + n]
        for _ in range(rng.randint(0, 4)):
            part[rng.randrange(n)] = "changed"
        k = rng.randint(0, len(words))
        docs.append((d, words[:k] + part + words[k:]))
    ddf = spark.createDataFrame([(d, " ".join(t)) for d, t in docs], "doc_id bigint, text string")
    idf = spark.createDataFrame([(i, " ".join(t)) for i, t in items], "item_id bigint, text string")
    want = brute_leaks(docs, items)
    assert 30 < len(want)
    assert set(map(tuple, leaks.leaked_items(ddf, idf).collect())) == want
    assert set(map(tuple, leaks.leaked_items(ddf, idf, block_words=100).collect())) == want
    monkeypatch.setattr(leaks, "AT_ONCE", 50)
    assert set(map(tuple, leaks.leaked_items(ddf, idf).collect())) == want


def test_runs_of_aligned_words_equal_brute_force():
    rng = np.random.default_rng(4)
    sizes = rng.integers(1, 70, 400)
    rows = [rng.random(n) < rng.choice([0.8, 0.9, 0.95]) for n in sizes]

    def brute(row):
        return any(10 * (~row[i:j]).sum() <= j - i for i in range(len(row)) for j in range(i + 20, len(row) + 1))

    want = [brute(r) for r in rows]
    assert 50 < sum(want) < 350
    assert leaks.holding(np.concatenate(rows), sizes).tolist() == want


def test_leak_edges(spark):
    item = " ".join(f"word{i}" for i in range(30))
    sheet = "{title: X}\n" + "\n".join(f"[G]word{i} wo[Am]rd{i + 1}," for i in range(0, 30, 2)).replace("wo[Am]rd9", "WO[Am]RD9") + " (x2)"
    over = "\n".join(f"G   C\n{' '.join(f'word{j}' for j in range(i, i + 5))}" for i in range(0, 30, 5))
    rows = [(1, sheet), (2, over), (3, None), (4, ""), (5, "word0 word1"), (1, sheet), (None, sheet), (6, ("filler " * 20_000) + item)]
    docs = spark.createDataFrame(rows, "doc_id bigint, text string").withColumn("item_id", F.lit(9))
    items = spark.createDataFrame([(7, item), (7, item), (8, "short one"), (9, None), (None, item)], "item_id bigint, text string")
    assert set(map(tuple, leaks.leaked_items(docs, items).collect())) == {(1, 7), (2, 7), (6, 7)}
    assert leaks.leaked_items(docs.limit(0), items).count() == 0 and leaks.leaked_items(docs, items.limit(0)).count() == 0


def test_prefix_keeps_a_shared_shingle():
    rng = random.Random(2)
    assert leaks.least_shared() == 6
    for _ in range(200):
        n = rng.randint(16, 60)
        rank = np.array(rng.sample(range(1000), n))
        keep = set(leaks.prefix_positions(np.arange(n, dtype=np.uint64), rank).tolist())
        start = rng.randint(0, n - 16)
        assert keep & set(rng.sample(range(start, start + 16), 6))


def test_sung_text(spark):
    sheet = "{title: A}\r\n\r\n[Verse 1]\r\n  G   Am7/C\r\nHel[G]lo world\r\nBridge:\r\n| G / / / | C / / / |\r\nA new day (x2)\r\n\r\nV2\r\nEnd"
    df = spark.createDataFrame([(sheet,), (None,), ("",)], "t string")
    got = [r.x for r in df.select(tables.plain_words(F.col("t")).alias("x")).collect()]
    assert got == [["hello", "world", "a", "new", "day", "end"], [], []]


def test_labels(spark):
    df = spark.createDataFrame([("en-GB",), (" EN",), ("eng",), ("Español",), ("pt_BR",), ("xx",), ("mul",), (None,), ("",), ("ger",)], "x string")
    assert [r.y for r in df.select(languages.normal_label(F.col("x")).alias("y")).collect()] == ["en", "en", "en", "es", "pt", None, None, None, None, "de"]


def test_section_names_of_other_languages(spark):
    texts = ["Estribillo:\nsing", "[Strophe 2]\nsing", "ПРИПЕВ\nsing", "Refrão 1:\nsing", "2절\nsing", "[פזמון]\nsing", "Zwrotka 1\nsing"]
    df = spark.createDataFrame([(t,) for t in texts] + [("Vers la mer\nsing",)], "t string")
    got = [r.x for r in df.select(tables.plain_words(F.col("t")).alias("x")).collect()]
    assert got == [["sing"]] * len(texts) + [["vers", "la", "mer", "sing"]]


def test_repeat_marks_anywhere(spark):
    texts = ["sing x2 again", "sing x2, again", "sing [x2] again", "x2 sing again", "sing again 2x", "sing (2 x) again", "sing 3× again.", "sing [bis] again", "sing ×12\nagain"]
    kept = ["max2 sing", "2xl again", "2 x-ray", "fox 2"]
    df = spark.createDataFrame([(i, t) for i, t in enumerate(texts + kept)], "i int, t string")
    got = [r.x for r in df.orderBy("i").select(tables.plain_words(F.col("t")).alias("x")).collect()]
    assert got == [["sing", "again"]] * len(texts) + [["max2", "sing"], ["2xl", "again"], ["2", "x", "ray"], ["fox", "2"]]
