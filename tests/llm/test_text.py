"""Leakage, mixing and subjects on small texts."""

import random

import pytest

from cuelattice.llm import leakage as lk
from cuelattice.llm import mixing as mx
from cuelattice.llm import subjects as sj
from cuelattice.llm.words import words


def test_words():
    assert words("Ab​c d-E_f 1.5 中文x ﬁ ｒｉ") == ["abc", "d", "e", "f", "1", "5", "中", "文", "x", "fi", "ri"]
    assert words(None) == [] and words("") == [] and words("!!") == []


def brute(docs, items):
    out = set()
    for i, q in items:
        w = words(q)
        n = min(10, len(w))
        grams = {tuple(w[k : k + n]) for k in range(len(w) - n + 1)} if n else set()
        for d, t in docs:
            x = words(t)
            if any(tuple(x[k : k + n]) in grams for k in range(len(x) - n + 1)):
                out.add((d, i))
    return out


def found(spark, docs, items, **kw):
    d = spark.createDataFrame([(*r, 0) for r in docs], "doc_id long, text string, windows int")
    q = spark.createDataFrame([(*r, 0) for r in items], "item_id long, question string, doc_id int")
    return lk.leaks(d, q, **kw)


def test_leaks_random(spark, monkeypatch):
    monkeypatch.setattr(lk, "ITEM_BYTES", 400)  # several blocks of items
    rng = random.Random(1)
    vocab = [f"w{i}" for i in range(12)] + ["中文字", "Über"]
    items = [(i, " ".join(rng.choice(vocab) for _ in range(rng.choice([1, 4, 9, 10, 11, 25])))) for i in range(15)] + [(90, None), (91, ""), (92, "...")]
    docs = []
    for d in range(80):
        t = [rng.choice(vocab) for _ in range(rng.randrange(0, 60))]
        if rng.random() < 0.5:
            w = rng.choice(items[:15])[1].split()
            lo = rng.randrange(len(w))
            t[3:3] = w[lo : lo + rng.randrange(1, 14)]
        docs.append((d, ", ".join(t)))
    docs += [(100, None), (101, ""), (102, docs[0][1]), (103, " ".join(docs[3][1] for _ in range(400)))]
    got = [tuple(r)[:2] for r in found(spark, docs, items).collect()]
    assert len(got) == len(set(got)) and set(got) == brute(docs, items)


def test_shingle_similarity():
    same = lk.shingles(["a", "b", "c"])
    assert lk.similarity(same, same) == 1.0 and lk.similarity(lk.shingles([]), same) == 0.0 and lk.similarity(lk.shingles([]), lk.shingles([])) == 0.0
    assert lk.similarity(lk.shingles(list("aaaaaaa")), lk.shingles(list("aaaaaa"))) == 2 / 3
    assert [lk.grid_size(n) for n in (1, 5, 7, 8, 12, 30, 100)] == [1, 5, 5, 8, 12, 27, 93]


def edited(ws, rng):
    """A copy with an insertion, a removal or a swapped word near an end, or one in the middle of a long item."""
    ws = list(ws)
    for _ in range(1 + len(ws) // 60):
        at = rng.choice([0, len(ws) - 1, rng.randrange(len(ws))])
        ws[at : at + rng.randrange(2)] = rng.choice([[], [f"new{rng.randrange(999)}"]])
    return ws


def best_window(x, item, size):
    want = lk.shingles(item)
    # windows at a document's ends are cut short there
    return max((lk.similarity(lk.shingles(x[max(0, i) : i + size]), want) for i in range(-size // 3, len(x))), default=0.0)


@pytest.mark.parametrize("size", [10, 30, 100])
def test_edited_items_are_found(size):
    rng = random.Random(size)
    vocab = [f"v{i}" for i in range(3000)]
    items = [(i, " ".join(rng.choice(vocab) for _ in range(size))) for i in range(40)]
    docs, want = [], set()
    for k in range(300):
        i = rng.randrange(40)
        x = [rng.choice(vocab) for _ in range(rng.randrange(80))] + edited(items[i][1].split(), rng) + [rng.choice(vocab) for _ in range(rng.randrange(80))]
        docs.append(x)
        if best_window(x, items[i][1].split(), size) >= 0.8:
            want.add((k, i))
    got = lk.NearIndex(items).near_many(docs, 0.8)
    assert len(want) >= (20 if size == 10 else 60)
    assert {(k, i) for k, i, _ in got} <= want and len(got) >= 0.9 * len(want)
    assert all(s >= 0.8 for _, _, s in got)


def test_near_leaks_in_tables(spark):
    q = " ".join(f"word{i}" for i in range(40))
    swapped = q.replace("word9 ", "other ").replace("word19 ", "more ").replace("word29 ", "next ").replace("word38 ", "last ")
    rows = {r["doc_id"]: r for r in found(spark, [(1, "before " + q.replace("word20", "other") + " after"), (2, "x " + q), (3, swapped), (4, None), (5, "")], [(5, q), (6, None)], least=0.8).collect()}
    assert set(rows) == {1, 2} and rows[2]["similarity"] == 1.0 and rows[2]["windows"] == 31 and rows[1]["similarity"] is None and rows[1]["windows"] == 21
    ends = "first " + " ".join(f"word{i}" for i in range(1, 40))
    assert found(spark, [(1, ends)], [(5, q)], least=0.8).first()["similarity"] == 35 / 36  # but for the first word


def test_all_fingerprints_within_radius_are_candidates():
    import numpy as np

    rng = random.Random(2)
    index = lk.ItemIndex([(i, " ".join(f"t{rng.randrange(40)}" for _ in range(30))) for i in range(20)])
    own = index.sizes[10][0]
    marks = own.copy()
    for i in range(len(marks)):
        for b in rng.sample(range(64), rng.randrange(0, 5)):
            marks[i] ^= np.uint64(1) << np.uint64(b)
    d, i = index.candidates(marks, 10)
    got = list(zip(d.tolist(), i.tolist()))
    want = {(a, b) for a in range(len(marks)) for b in range(len(own)) if int(np.bitwise_count(marks[a] ^ own[b])) <= lk.RADIUS}
    assert len(got) == len(set(got)) and set(got) == want


def test_empty_tables(spark):
    assert found(spark, [], [(1, "a b")]).count() == 0 and found(spark, [(1, "a b")], []).count() == 0


def test_water_filling():
    rows = [("a", 0.5, 1, 100), ("b", 0.3, 2, 1000), ("c", 0.2, 3, 1000), ("d", 0.1, 2, 0)]
    r, clamped = mx.water_fill(rows, 1000)
    assert r["a"] == 1.0 and r["d"] == 0.0 and abs(r["b"] * 1000 - 540) < 1e-6 and abs(r["c"] * 1000 - 360) < 1e-6
    assert clamped == [["a", "d"]]
    assert mx.water_fill([]) == ({}, []) and mx.water_fill([("a", 0.0, 1, 5)]).repeats == {"a": 0.0}
    full = mx.water_fill([("a", 0.9, 1, 10), ("b", 0.1, 1, 500)], 1000)
    assert full == ({"a": 1.0, "b": 1.0}, [["a"], ["b"]])


@pytest.fixture(scope="module")
def mix(spark):
    rows = [(i, s, "word " * (i % 7)) for i in range(300) for s in [["Edit Notes", "edit-notes", " EDIT_NOTES "][i % 3] if i % 4 else "logs"]]
    rows += [(900, None, "x y"), (901, "other", "x"), (902, "logs", None), (903, "logs", "")]
    docs = spark.createDataFrame([(*r, 5) for r in rows], "doc_id long, source string, text string, n_tokens int")
    targets = spark.createDataFrame([("edit_notes", 0.3, 1), ("logs", 0.6, 2), ("gone", 0.1, 3)], "source string, target_share double, max_repeats int")
    counted = mx.token_counts(docs)
    return counted, mx.source_sizes(counted, targets)


def test_mix_sizes_and_short(spark, mix):
    counted, sizes = mix
    got = {r["source"]: r for r in sizes.collect()}
    assert got["edit_notes"]["docs"] == 225 and got["logs"]["docs"] == 77 and got["gone"]["tokens"] == 0
    tokens = got["edit_notes"]["tokens"] + got["logs"]["tokens"]
    want = {s for s, r in got.items() if r["tokens"] * r["max_repeats"] < r["target_share"] * tokens}
    assert {r["source"] for r in mx.short_sources(spark, mx.water_fill(mx.plan_rows(sizes))).collect()} == want and "gone" in want


def test_mix_is_seeded_and_capped(spark, mix):
    counted, sizes = mix
    fill = mx.water_fill(mx.plan_rows(sizes))
    plan = fill.repeats
    a = {r["doc_id"]: r["times"] for r in mx.sample(counted, plan).collect()}
    b = {r["doc_id"]: r["times"] for r in mx.sample(counted.repartition(3), plan).collect()}
    assert a == b and max(a.values()) <= 2 and not {900, 901} & set(a)
    rep = {r["source"]: r for r in mx.report(mx.sample(counted, plan), sizes, fill).collect()}
    assert abs(sum(r["actual_share"] for r in rep.values()) - 1) < 1e-9 and rep["gone"]["falls_short"]
    # the fraction is cut at the tokens wanted, to half a document of at most six words
    for name in ("edit_notes", "logs"):
        assert abs(rep[name]["used_tokens"] - plan[name] * rep[name]["tokens"]) <= 6


def test_token_counts_of_long_text(spark):
    text = "The quick brown fox jumps. " * 20_000
    df = spark.createDataFrame([(1, text), (2, None), (3, "")], "doc_id long, text string")
    got = {r["doc_id"]: r["n_tokens"] for r in mx.token_counts(df).collect()}
    assert got[2] == got[3] == 0 and abs(got[1] - 120_000) < 200


def test_sentences():
    index = lk.ItemIndex([(1, "how many windows of item nine survive when margin four is removed twice")])
    text = "# Pass 3\n[10:11:12] WARN The cut is late. <p>Keep the **soup** warm!</p>\n> So how many windows of item nine survive when margin four is removed twice and more"
    assert [" ".join(s) for s in sj.sentence_words(text, index)] == ["the cut is late", "keep the soup warm", "so", "and more"]
    assert sj.sentence_words("") == []
    memo = {}
    assert len(sj.terms(["the", "soup", "x2", "bowl"], memo)) == 5 and set(memo) == {"the", "soup", "the soup", "bowl", "soup bowl"}


def corpus(spark, n=240):
    rng = random.Random(9)
    nouns = {"food": ["soup", "bread oven", "noodles", "pickles", "herbs", "batter"], "law": ["court clerk", "witness", "injunction", "statute", "contract", "ombudsman"], "music": ["chorus", "violin", "drum fill", "trumpet", "choir", "melody"]}
    frames = ["We open on the {} today.", "The {} needs more screen time.", "Half of the footage is the {}.", "Everything turns around the {}."]
    plain = ["The cut sits {} ms late.", "Trim slot {} now.", "Version {} still has the old ending.", "The grade is too warm."]
    docs, truth = [], {}
    for i in range(n):
        area = rng.choice([*nouns, None])
        ss = [rng.choice(frames).format(rng.choice(nouns[area])) if area and rng.random() < 0.7 else rng.choice(plain).format(rng.randrange(99)) for _ in range(8)]
        docs.append((i, " ".join(ss)))
        truth[i] = area
    docs += [(n, None), (n + 1, ""), (n + 2, "42 17."), (n + 3, docs[0][1])]
    labels = [(i, truth[i].upper() + " " if truth[i] else "none") for i in range(0, n, 4)] + [(0, truth[0] or "none"), (None, "law"), (8, None), (12, "nonsense")]
    d = spark.createDataFrame([(*r, "x") for r in docs], "doc_id long, text string, subject string")
    la = spark.createDataFrame(labels, "doc_id long, subject string")
    ar = spark.createDataFrame([("food", "Soup and bread"), ("law", "Courts"), ("music", "Songs"), ("sport", None)], "subject string, description string")
    return d, la, ar, truth


def test_subjects(spark):
    d, la, ar, truth = corpus(spark)
    feat, model = sj.fit(d, la, ar, [])
    got = {}
    for r in sj.assigned(feat, model).collect():
        got.setdefault(r["doc_id"], set()).add(r["subject"])
        assert r["share"] >= sj.LEAST_SHARE
    held = [i for i in truth if i % 4]
    right = sum(got.get(i, set()) == ({truth[i]} if truth[i] else set()) for i in held)
    assert right / len(held) >= 0.9
    assert not {240, 241, 242} & set(got)


def test_languages_come_from_the_documents(spark):
    lines = {"en": "the soup is on the table", "de": "die Suppe steht auf dem Tisch", "zh": "汤在桌子上面"}
    rng = random.Random(3)
    rows = []
    for i in range(300):
        true = rng.choice(list(lines))
        rows.append((i, true, rng.choice([true, true, true, f" {true.upper()} ", None, "und", "", rng.choice(list(lines))]), lines[true]))
    d = spark.createDataFrame([*((i, la, t) for i, _, la, t in rows), (900, "xx", "one of a kind")], "doc_id long, lang string, text string")
    feat = sj.write_out(sj.features(d, []), "t")
    rates = sj.language_rates(feat)
    assert rates.shape == (sj.DIM, 3)
    got = {r["doc_id"]: int(sj._Batch([r["doc_id"]], [r["lang"]], [r["lens"]], [r["flat"]]).groups(rates)[0]) for r in feat.where("doc_id < 900").collect()}
    assert all(got[i] == sorted(lines).index({"de": "de", "en": "en", "zh": "zh"}[true]) for i, true, _, _ in rows)
    assert sj.language_rates(feat.where("lang is null")).shape == (sj.DIM, 1)


def test_subjects_empty(spark):
    d, la, ar, _ = corpus(spark, 8)
    for docs, labels in ((d.limit(0), la), (d, la.limit(0)), (d.limit(0), la.limit(0))):
        feat, model = sj.fit(docs, labels, ar, [])
        assert sj.assigned(feat, model).count() >= 0
