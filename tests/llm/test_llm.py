import random
import re
from collections import defaultdict

import numpy as np
import pandas as pd
import pytest
from hypothesis import given, settings
from hypothesis import strategies as st
from pyspark.sql import functions as F

from granth.llm import encoding, language, linked_splits, mixing, near_duplicates, oversize, packing, queries, scan_noise, sentences, sizes
from granth.llm.boosting import Boosted

CHUNK = "id long, doc_id long, chunk_index int, page int, language string, text string"


# -- 2 ------------------------------------------------------------------------------------------------------------------
@settings(max_examples=80, deadline=None)
@given(st.lists(st.sampled_from(["aa", "bb.", "cc\n", "dd\n\n", "ee\f", "ff?"]), max_size=300), st.integers(2, 60), st.integers(0, 20))
def test_pieces_cover_and_keep_the_limit(words, limit, overlap):
    text = " ".join(words)
    cuts = oversize.cut_points(text, limit, overlap)
    n = len(text.split())
    assert sorted({i for a, b, _ in cuts for i in range(a, b)}) == list(range(n))
    assert all(b - a <= limit for a, b, _ in cuts)
    for (_, b, _), (a2, _, _) in zip(cuts, cuts[1:]):
        assert 0 <= b - a2 <= overlap


def test_early_boundary_before_a_hard_cut():
    text = "aa " * 19 + "end. " + "bb " * 130 + "end. " + "cc " * 30
    cuts = oversize.cut_points(text, 100, 10)
    assert cuts[0] == (0, 20, "sentence") and (10, 110, "limit") in cuts
    kinds = oversize._gaps(text, [m.span() for m in re.finditer(r"\S+", text)])
    for (a, b, kind), (a2, _, _) in zip(cuts, cuts[1:]):
        assert a2 > a and b > a
        if kind == "limit":
            before = max([0, *(e for _, e, _ in cuts if e < b)])
            assert not [g for g in kinds if max(before, a + 10) < g <= b]


def test_depths_climb_plateaus_in_linear_time():
    import time

    def climb(s, k, step):
        while 0 <= k + step < len(s) and s[k + step] >= s[k]:
            k += step
        return s[k]

    rng = random.Random(3)
    words = [rng.choice(["aa", "bb", "cc"]) for _ in range(300)]
    gaps = sorted(rng.sample(range(1, 300), 90))
    s = [oversize._similarity(words, g, 5) for g in gaps]
    assert oversize._depths(words, gaps, 5) == pytest.approx([climb(s, k, -1) + climb(s, k, 1) - 2 * v for k, v in enumerate(s)])
    text, began = "a b c. " * 30_000, time.time()
    cuts = oversize.cut_points(text, 300, 50)
    assert cuts[-1][1] == 90_000 and time.time() - began < 30


def test_oversized_pages_and_nulls(spark):
    rows = [(1, 1, 0, 4, None, "w " * 6 + "\f" + "v " * 8), (2, 1, 1, None, None, "x " * 11), (3, 1, 2, 1, None, None), (4, None, 0, 1, None, ""), (5, 1, 3, 1, None, "y " * 10), (None, 1, 4, 1, None, "short")]
    df = spark.createDataFrame(rows, CHUNK).withColumn("piece_no", F.lit(7))
    got = oversize.split_oversized(df, 10, 2).orderBy("chunk_id", "piece_no").collect()
    assert {r.chunk_id for r in got} == {1, 2}
    assert [r.page for r in got if r.chunk_id == 1][0] == 4 and [r.page for r in got if r.chunk_id == 1][-1] in (4, 5)
    assert all(r.page is None for r in got if r.chunk_id == 2)
    assert oversize.split_oversized(df.limit(0), 10, 2).count() == 0


# -- 3 ------------------------------------------------------------------------------------------------------------------
def test_golay_neighbours_share_a_key():
    g, rng = near_duplicates.Golay(), np.random.default_rng(0)
    w = rng.integers(0, 1 << 23, 400).astype(np.int32)
    k = g.keys(w)
    assert set((k >= 0).sum(1)) <= {1, 6}
    for bits in (1, 2):
        e = np.array([sum(1 << int(b) for b in rng.choice(23, bits, replace=False)) for _ in w], np.int32)
        assert all(set(a[a >= 0]) & set(b[b >= 0]) for a, b in zip(k, g.keys(w ^ e)))


def test_near_duplicates_against_brute_force(spark):
    rng = random.Random(4)
    vocab = [f"w{i}" for i in range(3000)]
    texts = {}
    for i in range(60):
        base = [rng.choice(vocab) for _ in range(rng.randint(40, 120))]
        texts[len(texts)] = " ".join(base)
        for _ in range(3):
            w = list(base)
            for _ in range(rng.randint(0, 6)):
                w[rng.randrange(len(w))] = rng.choice(vocab)
            texts[len(texts)] = " ".join(w)
    texts[900], texts[901], texts[902], texts[903] = texts[0], texts[0].upper(), None, "short text"
    items = spark.createDataFrame(list(texts.items()), "id long, text string").withColumn("key", F.lit(1))
    runs = lambda t: {tuple(x) for w in [t.lower().split()] for x in zip(w, w[1:], w[2:])}
    ok = {i: runs(t) for i, t in texts.items() if t and len(t.split()) >= 30}
    want = {(a, b) for a in ok for b in ok if a < b and len(ok[a] & ok[b]) >= 0.6 * len(ok[a] | ok[b])}
    pairs, members = near_duplicates.similar(items)
    got = {(r.chunk_a, r.chunk_b) for r in near_duplicates.expand(pairs, members).collect()}
    assert got <= want and len(got) >= 0.98 * len(want)
    by = {r.chunk_id: r for r in near_duplicates.groups(pairs, members).collect()}
    assert set(by) == set(ok) and by[900].class_id == by[901].class_id == by[0].class_id
    near_duplicates.GROUP_SHARE, whole = 1, near_duplicates.GROUP_SHARE  # a group dealt to several tasks gives the same pairs
    try:
        assert {(r.chunk_a, r.chunk_b) for r in near_duplicates.expand(pairs, members).collect()} == got
    finally:
        near_duplicates.GROUP_SHARE = whole
    p, m = near_duplicates.similar(items.limit(0))
    assert near_duplicates.expand(p, m).count() == 0


# -- 4 ------------------------------------------------------------------------------------------------------------------
def test_groups_against_union_find(spark):
    rng = random.Random(1)
    chunks = [(100 + i, rng.randrange(40), 0, 1, None, "t") for i in range(80)]
    qa = [(i, rng.choice([None, *range(40)]), rng.choice([None, *range(100, 190)])) for i in range(120)]
    docs = [(i, rng.choice(["Aa", "aA ", f"s{i}", None, ""])) for i in range(45)]
    of, parent = {c[0]: c[1] for c in chunks}, {}

    def find(x):
        while parent.setdefault(x, x) != x:
            x = parent[x]
        return x

    named = defaultdict(set)
    for q, d, c in qa:
        named[q] |= {x for x in (d, of.get(c)) if x is not None}
    keys = defaultdict(list)
    for d, s in docs:
        if s and s.strip():
            keys[s.strip().lower()].append(d)
    for g in [*named.values(), *keys.values()]:
        g = sorted(g)
        for x in g[1:]:
            a, b = sorted((find(g[0]), find(x)))
            parent[b] = a
    want = {q: find(min(g)) for q, g in named.items() if g}
    frames = (spark.createDataFrame(qa + qa[:9], "qa_id long, doc_id long, chunk_id long"), spark.createDataFrame(chunks, CHUNK), spark.createDataFrame(docs, "doc_id long, sha256 string"))
    assert {r.qa_id: r.group_doc_id for r in linked_splits.question_groups(*frames).collect()} == want
    s = {r.qa_id: r.split for r in linked_splits.split_questions(spark, *frames).collect()}
    assert set(s) == set(named) and all(len({s[q] for q in want if want[q] == g}) == 1 for g in set(want.values()))
    assert linked_splits.question_groups(*[f.limit(0) for f in frames]).count() == 0


def test_incremental_keeps_and_quarantines(spark, tmp_path):
    named = lambda rows: spark.createDataFrame(rows, "qa_id long, doc long")
    links = lambda rows: spark.createDataFrame(rows, "a long, b long")
    kept = linked_splits.ComponentTable(spark, str(tmp_path / "components"))
    assert kept.read().count() == 0
    kept.update(named([(i, i) for i in range(200)]), links([]))
    old = {r.doc: r for r in kept.read().collect()}
    assert {r.status for r in old.values()} == {"new"} and abs(sum(r.split == "train" for r in old.values()) - 160) <= 2
    a = next(d for d in old if old[d].split == "train")
    b = next(d for d in old if old[d].split == "test")
    c = next(d for d in old if old[d].split == "train" and d != a)
    before = kept.manifest()["at"]
    kept.update(named([(900, a), (901, 500)]), links([(a, b), (c, 500), (600, 601)]))
    got = {r.doc: r for r in kept.read().collect()}
    assert got[a].status == got[b].status == "quarantined" and got[a].split is None and got[a].component == min(a, b)
    assert got[500].status == "kept" and got[500].split == "train" and got[500].component == c and got[601].component == 600
    assert all(got[d].split == old[d].split for d in old if d not in (a, b)) and got[a].n == 2 and len(got) == 203
    after = kept.manifest()["at"]
    assert sum(before[k] == after[k] for k in before) >= len(before) - 6  # other buckets are where they were
    kept.update(named([]), links([(b, 600), (c, 500)]))
    got = {r.doc: r for r in kept.read().collect()}
    assert got[600].status == got[601].status == "quarantined" and got[601].component == min(a, b) and got[c].split == "train"
    version = kept.manifest()["version"]
    kept.update(named([]), links([]))
    assert kept.manifest()["version"] == version


def test_rounds_that_run_out_raise(spark):
    path = spark.createDataFrame([(i, i + 1) for i in range(9)], "a long, b long")
    assert {r.root for r in linked_splits.components(path).collect()} == {0}
    with pytest.raises(RuntimeError):
        linked_splits.components(path, max_rounds=0)


# -- 5 ------------------------------------------------------------------------------------------------------------------
def test_network_learns_and_handles_empty(spark):
    rng = random.Random(0)
    en = "the fee is paid at office before march and list of farmers was closed by council".split()
    hi = "शुल्क कार्यालय में जमा होगा और किसान की सूची ग्राम सभा ने बंद की".split()
    make = lambda words: " ".join(rng.choice(words) for _ in range(9)) + "."
    samples = [(make(en), "en") for _ in range(24)] + [(make(hi), "hi") for _ in range(24)]
    net = language.train(samples, [])
    rows = [("a", 1, "hi", make(en)), ("a", 2, None, make(hi)), ("a", 3, "English", make(en)), ("a", 4, "hi", None), ("a", 5, None, "12 34"), ("a", 6, "en", make(en) + " " + make(hi)), ("a", 7, "hi", make(hi).encode().decode("latin-1"))]
    df = spark.createDataFrame(rows, "tbl string, rec_id long, stored string, text string")
    got = {r.rec_id: r for r in language.identify(df, net, True).collect()}
    assert [got[k].lang for k in (1, 2, 3, 4, 5, 6, 7)] == ["en", "hi", "en", None, None, "mixed", "hi"]
    assert [s.lang for s in got[6].segments] == ["en", "hi"] and got[4].segments == []
    # a wrapped line is no boundary, and a few words in another script are names or loan words, not a language
    wrapped, _, segs = language.judge([make(hi).replace(" ", "\n"), "OTP " + make(hi) + " PDF SMS", make(en) + " " + make(en) + " " + make(hi)], net, True)
    assert wrapped == ["hi", "hi", "mixed"] and [len(s) for s in segs] == [1, 1, 2]
    none, sure, _ = language.judge(["", "12 .", None], net)
    assert none == [None] * 3 and not sure.any()
    wrong = {(r.rec_id, r.lang) for r in language.wrong_labels(language.identify(df, net)).collect()}
    assert wrong == {(1, "en"), (2, "hi"), (6, "mixed")}


def test_gradients_match_differences():
    net = language.BiGRU(hidden=3, classes=2, seed=5)
    data, inside = language._pad([b"abca", b"cab"])
    want = np.array([[0, 1, 0, 1], [1, 0, 0, 0]])
    for k in net.p:
        net.p[k] = net.p[k].astype(np.float64)
    _, g = net.step(data, want, inside)
    for name in ("xz", "xr", "xc", "uz", "ur", "uc", "w", "b"):
        i = np.unravel_index(np.abs(g[name]).argmax(), g[name].shape)
        keep = net.p[name][i]
        net.p[name][i] = keep + 1e-3
        up = net.step(data, want, inside)[0]
        net.p[name][i] = keep - 1e-3
        down = net.step(data, want, inside)[0]
        net.p[name][i] = keep
        assert abs((up - down) / 2e-3 - g[name][i]) < 0.05 * abs(g[name][i]) + 1e-3


def test_languages_of_one_script_need_a_statement():
    k = len(language.LANGS)
    at = {g: i for i, g in enumerate(language.LANGS)}
    def piece(lang, p):
        v = np.full(k, (1 - p) / (k - 1))
        v[at[lang]] = p
        return v
    e = {"seg_rec": np.array([0, 0, 0, 1, 1]), "seg_script": np.full(5, 4), "seg_letters": np.array([60, 12, 40, 60, 40]), "seg_words": np.array([9, 3, 8, 9, 8])}
    p = np.stack([piece("hi", 0.99), piece("mr", 0.99), piece("mr", 0.6), piece("hi", 0.99), piece("mr", 0.97)])
    lang, _, mass = language.settle(p, e, 2)
    assert [language.LANGS[g] for g in lang] == ["hi", "hi", "hi", "hi", "mr"]  # scraps and unsure pieces follow their record
    assert mass[0, at["hi"]] == 112 and mass[1, at["mr"]] == 40


def test_network_on_held_out_sentences():
    """Trusted sentences of the data: five of six train, the others and joins of two of them are judged."""
    pd = pytest.importorskip("pandas")
    try:
        rows = pd.read_parquet("/root/testdata/sf0.001/lang_samples.parquet").sort_values(["lang", "text"])
    except OSError:
        pytest.skip("no data")
    rows = list(zip(rows.text, rows.lang))
    net = language.train([r for i, r in enumerate(rows) if i % 6], [])
    held = [r for i, r in enumerate(rows) if not i % 6]
    got, _, _ = language.judge([t for t, _ in held], net)
    assert np.mean([g == y for g, (_, y) in zip(got, held)]) >= 0.85
    script = {"hi": 1, "mr": 1, "en": 2, "hinglish": 2, "ja": 3, "zh": 3}
    pairs = [(a, b) for a in held for b in held if script.get(a[1], a[1]) != script.get(b[1], b[1]) and min(len(a[0]), len(b[0])) * 3 > max(len(a[0]), len(b[0]))]
    both, _, _ = language.judge([f"{a[0]} {b[0]}" for a, b in pairs[::7]], net)
    assert np.mean([g == "mixed" for g in both]) >= 0.9


# -- 6 ------------------------------------------------------------------------------------------------------------------
@pytest.mark.parametrize("word", ["शुल्क", "café", "₹", "’", "টাকা", "روپے"])
def test_garble_round_trip(word):
    for encoding_name in ("cp1252", "latin-1", "mac_roman", "cp437"):
        form = word
        for _ in range(encoding.DEPTH):
            raw = form.encode()
            form = "".join(encoding._reader(encoding_name, "control")[b] for b in raw)
            assert encoding.restore_text(form) == word
    assert encoding.restore_text(word) == word


def test_chains_of_different_misreadings_are_restored(spark):
    first, second = {n: encoding._reader(n, "control") for n in ("cp1252", "mac_roman", "cp1251")}, encoding._reader("cp437", "control")
    read = lambda w, r: "".join(r[b] for b in w.encode("utf-8"))
    rows = [("chunks", 1, "नमस्ते सरकार"), ("chunks", 2, read(read("नमस्ते", first["cp1252"]), second)), ("chunks", 3, read(read("सरकार", first["mac_roman"]), first["cp1251"]))]
    got = {r.rec_id: r.text for r in encoding.repair(spark.createDataFrame(rows, "tbl string, rec_id long, text string")).collect()}
    assert got == {2: "नमस्ते", 3: "सरकार"}


def test_restored_text_keeps_devanagari():
    word = "नमपर"  # each letter's two bytes could be ASCII
    assert encoding.turn_utf16(word) is not None and encoding.restore_text(f"{word} â€™ {word}").split()[::2] == [word, word]
    lost = "hello good world".encode().decode("utf-16-le")
    assert encoding.restore_text(lost) == "hello good world"
    hindi = "यह घर है ".encode() + b" "
    turned = (hindi + b" " * (len(hindi) % 2)).decode("utf-16-le", "surrogatepass")
    assert "घर" in encoding.restore_text(turned + " â€™")


def test_forms_of_long_runs_come_in_small_frames():
    runs = [chr(0x905 + i) + "शुल्कमार्च" * 30 for i in range(20)]
    frames = list(encoding.forms(iter([pd.DataFrame({"run": runs, "n": range(20)})])))
    one = max(sum(len(f) for f, _ in encoding.garble(w)) for w in runs)
    assert len(frames) > 1 and all(f["form"].str.len().sum() <= encoding.FORM_CHARS + one for f in frames)
    assert list(pd.concat(frames).itertuples(index=False, name=None)) == [(f, w, d, n) for n, w in enumerate(runs) for f, d in encoding.garble(w)]


def test_records_are_found_and_restored(spark):
    hi, both = "शुल्क मार्च में देना है", "café – नियम"
    texts = [hi, hi.encode().decode("cp1252", "replace"), both, both.encode().decode("latin-1"), "50 °C, ½ spoon, § 4, “ok” – naïve", None, "", "plain", "The fee is due in March. ".encode().decode("utf-16-le", "ignore"), "lost �5 here", "über"]
    df = spark.createDataFrame([("chunks", i, t) for i, t in enumerate(texts)], "tbl string, rec_id long, text string")
    assert {r.rec_id for r in encoding.found(df).collect()} == {1, 3, 8, 9}
    fixed = {r.rec_id: r for r in encoding.repair(df).collect()}
    assert fixed[3].text == both and fixed[8].text.startswith("The fee is due") and fixed[9].lost == 1
    assert encoding.found(df.limit(0)).count() == 0


# -- 7, 8 -----------------------------------------------------------------------------------------------------------------
@settings(max_examples=60, deadline=None)
@given(st.lists(st.integers(0, 30), max_size=60))
def test_tree_is_first_fit_decreasing(items):
    bins, free = packing.first_fit_decreasing(items, 30)
    rooms, want = [], {}
    for i in sorted(range(len(items)), key=lambda i: -items[i]):
        k = next((k for k, r in enumerate(rooms) if r >= items[i]), None)
        if k is None:
            k = len(rooms)
            rooms.append(30)
        rooms[k] -= items[i]
        want[i] = k
    assert bins == [want[i] for i in range(len(items))] and free == rooms


def test_packing_is_whole(spark):
    docs = spark.createDataFrame([(i, n) for i, n in enumerate([0, 5, 10, 11, 25, 30, 7])], "doc_id long, n_tokens long").withColumn("size", F.lit("x"))
    caps = spark.createDataFrame([(1, 10), (2, 100), (2, 100)], "pack_id int, capacity_tokens int")
    rows = packing.pack(docs, caps).collect()
    used, per = defaultdict(int), defaultdict(int)
    for r in rows:
        used[r.pack_id, r.group_no, r.container_no] += r.size
        per[r.pack_id, r.doc_id] += r.size
        assert r.size <= r.capacity_tokens and (r.piece_no == 0 or r.capacity_tokens == 10)
    assert all(v <= (10 if k[0] == 1 else 100) for k, v in used.items())
    assert per == {(p, i): n for p in (1, 2) for i, n in enumerate([0, 5, 10, 11, 25, 30, 7])}
    odd = docs.unionByName(spark.createDataFrame([(None, 4), (3, None)], "doc_id long, n_tokens long").withColumn("size", F.lit("y")))
    assert packing.pack(odd, caps.where("pack_id = 2")).count() == 9
    assert packing.pack(docs.limit(0), caps).count() == 0 and packing.pack(docs, caps.limit(0)).count() == 0


def test_budgets_prefer_siblings():
    leaves = [("a-x", "hi", 100), ("a-y", "hi", 1000), ("b-x", "hi", 1000)]
    got = mixing.budgets(leaves, {"a-x": (0.4, 1), "a-y": (0.2, 1), "b-x": (0.3, 1), "c-none": (0.1, 5)}, 1000)
    assert got["a-x", "hi"] == 100 and got["a-y", "hi"] > got["b-x", "hi"] and abs(sum(got.values()) - 1000) < 1e-6
    assert got["c-none", "und"] == 0


def test_mixture_shares(spark):
    docs = spark.createDataFrame([(i, "a-x" if i % 3 else "b-x", 10 + i % 7, "hi") for i in range(900)] + [(9000, None, 5, None), (9001, "c", 5, "hi")], "doc_id long, source string, n_tokens long, language string")
    t = spark.createDataFrame([("a-x", 0.3, 1), ("b-x", 0.6, 3), ("gone", 0.1, 2)], "source string, target_share double, max_repeats int")
    exact = {r.source: r.reached_share for r in mixing.share_report(mixing.mix(docs, t, F.col("language")), t).collect()}
    # b-x is used up at its target; the share of the source without texts goes to the one with room
    assert abs(exact["b-x"] - 0.6) < 0.01 and abs(exact["a-x"] - 0.4) < 0.01
    m = mixing.mix(docs, t, F.col("language"), "pool")
    share = {r.source: r for r in mixing.share_report(m, t).collect()}
    assert abs(share["a-x"].reached_share - 1 / 3) < 0.01 and share["b-x"].most_copies <= 3 and share["gone"].reached_share == 0
    assert mixing.mix(docs.limit(0), t, F.col("language")).count() == 0


def test_whole_mixture_uses_the_pool():
    want = {"a-x": (0.5, 1), "b-x": (0.3, 2), "c-tiny": (0.1, 3), "d-no": (0.1, 0)}
    leaves = [("a-x", "hi", 5000), ("b-x", "hi", 3000), ("c-tiny", "en", 2), ("d-no", "hi", 900)]
    exact, whole = (mixing.budgets(leaves, want, mixing.size(leaves, want, t)) for t in (None, "whole"))
    # one short text, or a source that may never be used, does not set the size of the whole
    assert abs(sum(exact.values()) - 60) < 1e-6 and abs(sum(whole.values()) - 8002) < 1e-6
    assert whole["c-tiny", "en"] == 6 and whole["d-no", "hi"] == exact["d-no", "hi"] == 0
    assert all(whole[k] >= exact[k] for k in exact)
    # repeats may make the exact size the larger one: nothing of it is given up
    many = {"a-x": (0.5, 4), "b-x": (0.5, 4)}
    assert mixing.size(leaves[:2], many, "whole") == mixing.size(leaves[:2], many, None) == 24000


def test_sources_in_many_languages_reach_their_budget(spark):
    rng = random.Random(5)
    langs = ["hi", "en", "mr", "ta", "ur", None]
    docs = [(i, rng.choice(["a-x", "a-y", "b-x"]), rng.randint(20, 400), rng.choice(langs)) for i in range(500)] + [(None, "b-x", 50, "hi"), (3, "a-x", 77, "hi")]
    frame = spark.createDataFrame(docs, "doc_id long, source string, n_tokens long, language string").withColumn("delta", F.lit("x"))
    t = spark.createDataFrame([("a-x", 0.5, 2), ("a-y", 0.2, 1), ("b-x", 0.3, 3)], "source string, target_share double, max_repeats int")
    total = 40_000
    got = {r.source: r for r in mixing.share_report(mixing.mix(frame, t, F.col("language"), total), t).collect()}
    # five or six leaves a source, each cut at whole texts: the error of the source stays below half of its short texts
    assert all(abs(got[s].tokens - share * total) <= 60 for s, share in (("a-x", 0.5), ("a-y", 0.2), ("b-x", 0.3)))
    assert all(got[s].most_copies <= n for s, n in (("a-x", 2), ("a-y", 1), ("b-x", 3)))


def test_registered_mixture_is_whole(spark, tmp_path):
    docs = [(i, "a-x", "hi", "paani bachao " * 5) for i in range(200)] + [(500, "b-x", "hi", "short"), (501, "c-x", "hi", "never used")]
    spark.createDataFrame(docs, "doc_id long, source string, language string, text string").write.parquet(f"{tmp_path}/documents.parquet")
    spark.createDataFrame([("a-x", 0.5, 1), ("b-x", 0.3, 3), ("c-x", 0.2, 0)], "source string, target_share double, max_repeats int").write.parquet(f"{tmp_path}/mix_targets.parquet")
    got = {r.source: r for r in queries.p8_shares(spark, str(tmp_path)).collect()}
    assert got["a-x"].texts == 200 and got["b-x"].most_copies == 3 and got["c-x"].texts == 0
    assert 0 < queries.p8_exact_mixture(spark, str(tmp_path)).count() < 10


def test_token_counts(spark):
    df = spark.createDataFrame([(1, "hello world"), (2, None), (3, ""), (4, "a b " * 40000)], "doc_id long, text string")
    n = {r.doc_id: r.n_tokens for r in sizes.with_tokens(df).collect()}
    assert n[1] == len(sizes.encoder(sizes.TOKENIZER).encode_ordinary("hello world")) and n[2] == n[3] == 0 and n[4] == len(sizes.encoder(sizes.TOKENIZER).encode_ordinary("a b " * 40000))


# -- 9 ------------------------------------------------------------------------------------------------------------------
CASES = [
    ("Dr. Rao paid Rs. 5.50 on 3.4.2025. See para. 4.2 of file 2-A. Done!", ["Dr. Rao paid Rs. 5.50 on 3.4.2025.", "See para. 4.2 of file 2-A.", "Done!"]),
    ('He said, "Go. Now." and left. Next', ['He said, "Go. Now." and left.', "Next"]),
    ("प्रो. आर. के. राव आए। सूची लगेगी| क्या है?", ["प्रो. आर. के. राव आए।", "सूची लगेगी|", "क्या है?"]),
    ("# Head\nPoints:\n1. One. Still one.\n2. Two", ["# Head", "Points:", "1. One. Still one.", "2. Two"]),
    ("「二部必要です。写し。」と書く。次です！", ["「二部必要です。写し。」と書く。", "次です！"]),
    ("first line goes on and\non until here. Then more\nfollows it.", ["first line goes on and\non until here.", "Then more\nfollows it."]),
    ("वह गया। ... !? फिर आया।", ["वह गया। ... !?", "फिर आया।"]),
    ("days.Students lose it. The auditor asked... and left.", ["days.", "Students lose it.", "The auditor asked... and left."]),
]


@pytest.mark.parametrize("text,want", CASES)
def test_sentence_cases(text, want):
    assert [text[a:b] for a, b in sentences.sentence_units(text)] == want


#: Sentences that fit the model, and others with words that are not among them.
KNOWN = {
    "th": ["เด็กๆเล่นอยู่ในสวน", "แม่ทำอาหารเย็นแล้วครับ", "พ่อไปทำงานที่โรงงาน", "วันนี้ฝนตกหนักมาก", "ร้านเปิดเวลา8.30น.", "เขาซื้อหนังสือ3เล่ม"],
    "ja": ["今日は雨です。", "明日は晴れます。", "本を三冊読みました。", "駅まで歩いて行きます。", "会議は五時に始まります。", "切符はまだありません。"],
    "zh": ["他去北京了。", "我在家吃饭了。", "你明天来吗？", "请把门关上吧。", "这本书很有意思。", "她买了三张票。"],
}
SPACELESS_CASES = [
    "นกบินข้ามทะเล3ตัวครับ|วันนี้ลมแรงจริงๆ",
    "猫は庭で寝ています|犬は川で泳ぎました|魚はいません",
    "弟弟去上海了|我妹妹在学校唱歌吧|今天下雪",
]


@pytest.mark.parametrize("case", SPACELESS_CASES)
def test_spaceless_sentences_with_new_words(case):
    model = sentences.Spaceless().fit([x for g in KNOWN.values() for x in g], [])
    want = case.split("|")
    text = (" " if case[0] < "\u3040" else "").join(want)
    assert [text[a:b] for a, b in sentences.sentence_units(text, model)] == want
    assert sentences.sentence_units("2025年度 学生案内", model) == [(0, 11)]


def test_spaceless_model_counts_all_documents(spark):
    from granth.llm.spaceless import Spaceless

    rng = random.Random(3)
    parts = ["提交申请", "费用", "办公室", "日期", "证明", "的", "在", "请", "村庄", "学校", "付款", "三月"]
    texts = sorted({"。".join("".join(rng.choices(parts, k=rng.randint(2, 6))) for _ in range(3)) + "。" for _ in range(700)})
    known = ["请在三月付款。", "学校的费用。", "Plain."]
    want = Spaceless().fit(sorted(known), texts)
    got = sentences.fit_spaceless(spark.createDataFrame([(t,) for t in [*texts, texts[0], None, "plain"]], "text string"), spark.createDataFrame([(k,) for k in known], "text string"))
    assert got.cost == want.cost and got.inner == want.inner and got.closing == want.closing and len(got.cost) > len(Spaceless().cost)


def test_word_lattice_finds_words():
    model = sentences.Spaceless()
    model.learn_words(["图书馆在东门", "图书馆很大", "我去图书馆", "他在图书馆看书", "图书馆开门了", "新图书馆好"])
    assert "图书馆" in model.cost and "图书馆" in model.words("你的图书馆呢") and "".join(model.words("你的图书馆呢")) == "你的图书馆呢"
    assert sentences.Spaceless().fit([], []).gaps("", 0, 0) == []


@settings(max_examples=200, deadline=None)
@given(st.text(st.sampled_from("a. "), min_size=1, max_size=24), st.data())
def test_best_path_is_best(text, data):
    places = data.draw(st.lists(st.tuples(st.integers(1, len(text)), st.sampled_from([2.0, 3.0, 5.0])), max_size=7, unique_by=lambda x: x[0]))
    nodes = sorted((a, s) for a, s in places if a < len(text))
    short = lambda a, b: b - a <= sentences.SHORT and not any(c.isalnum() for c in text[a:b])
    def worth(path):
        ends = [0, *path, len(text)]
        return sum(s for a, s in nodes if a in path) - sentences.EMPTY * sum(short(a, b) for a, b in zip(ends, ends[1:]))
    every = max(worth([a for k, (a, _) in enumerate(nodes) if m >> k & 1]) for m in range(1 << len(nodes)))
    assert abs(worth(sentences.best_path(text, 0, nodes, len(text))) - every) < 1e-9


@settings(max_examples=150, deadline=None)
@given(st.text(st.sampled_from(list("aB1. \n\n।|\"“”()。ก ?!:-#\t")), max_size=120))
def test_units_cover_everything(text):
    units = sentences.sentence_units(text)
    assert all(a < b and text[a:b] == text[a:b].strip() for a, b in units)
    assert all(x[1] <= y[0] for x, y in zip(units, units[1:]))
    inside = set().union(*[range(a, b) for a, b in units]) if units else set()
    assert all(c.isspace() or i in inside for i, c in enumerate(text))


def test_sentences_nulls(spark):
    df = spark.createDataFrame([(1, None), (2, " \n "), (3, "A b."), (None, None)], "doc_id long, text string")
    assert [tuple(r) for r in sentences.sentences(df).collect()] == [(3, 0, 0, 4)]


# -- 1 ------------------------------------------------------------------------------------------------------------------
def test_page_numbers_and_alignment():
    assert [scan_noise.page_number(x) for x in ("- 4 -", "[12]", "पृष्ठ ३", "P. 2/9", "iii", "17", "no 4", "Page 5 of 9")] == [(4, "styled"), (12, "styled"), (3, "styled"), (2, "styled"), (3, "roman"), (17, "bare"), None, (5, "styled")]
    look = lambda a, b: scan_noise.align(a, b)
    assert look("vi5it0rs", "visitors")[0] == 2 and not any(look("vi5it0rs", "visitors")[4:])
    assert look("turrneric", "turmeric")[0] == 1 and look("शुल्फ", "शुल्क")[0] == 1 and look("लगेगाा", "लगेगा")[2] == 1 and look("प्रित", "प्रति")[3] >= 1
    assert look("acounts", "accounts")[5] == 1  # a lost letter is no misread


def test_edge_signs_may_be_letters():
    assert scan_noise.EDGE_SIGNS == "!(+|"
    forms = lambda x: [f for _, f in scan_noise.edge_forms(x)]
    assert forms("baak!,") == ["baak!"] and forms('"+otal') == ["+otal"] and forms("k!.") == ["k!"]
    assert forms("(a)") == forms("word.") == forms("word") == forms("|") == [] and set(forms("+es+")) == {"+es", "es+", "+es+"}
    assert scan_noise.edge_words("jaldi! mand! (ertificate) word") == {"jaldi!", "mand!", "(ertificate"}
    fixes = {"baak!": "baaki", "+otal": "total", "w0rk": "work"}
    assert scan_noise.rebuild("BAAK!, +otal w0rk! (jaldi!)", set(), set(), fixes) == "BAAKI, total work! (jaldi!)"


def test_words_misread_at_an_edge_are_found(spark):
    vocab = "baaki total certificate pahunchi zaroori mandi council farmers receipt committee approved claims transfer register storage".split()
    docs = spark.createDataFrame([(i, " ".join(vocab)) for i in range(30)], "doc_id long, text string")
    rows = [(1, 1, 0, 1, None, "council baak! hai\nfarmers +otal receipt"), (2, 1, 1, 2, None, "council farmers! (receipt) claims+\n(approved transfer!"), (3, 1, 2, 3, None, "the (ertificate and zar-\noor! council")]
    noise = scan_noise.Noise(spark.createDataFrame(rows, CHUNK), docs)
    fixes = {(r.chunk_id, r.word): r.replacement for r in noise.misreads.collect()}
    assert fixes == {(1, "baak!"): "baaki", (1, "+otal"): "total", (3, "(ertificate"): "certificate", (3, "zaroor!"): "zaroori"}
    text = {r.chunk_id: r.text for r in scan_noise.repair(noise).collect()}
    assert text[1] == "council baaki hai farmers total receipt" and text[3] == "the certificate and zaroori council"


def test_line_pairs_that_cut_words(spark):
    vocab = "baaki total certificate pahunchi zaroori mandi council farmers receipt committee approved claims transfer register storage residence quintal december".split()
    compounds = "self-help well-known part-time long-term follow-up".split()
    docs = spark.createDataFrame([(i, " ".join(vocab + compounds) + " self help selfhelpers") for i in range(30)], "doc_id long, text string")
    rows = [(1, 1, 0, 1, None, "of the self-\nhelp groups"), (2, 1, 1, 2, None, "all far-\nmers came"), (3, 1, 2, 3, None, "the com-\nm!ttee met"), (4, 1, 3, 4, None, "a long-\nterm\nview")]
    noise = scan_noise.Noise(spark.createDataFrame(rows, CHUNK), docs)
    assert {(r.chunk_id, r.left, r.right) for r in noise.cuts().collect()} == {(2, "far", "mers"), (3, "com", "m!ttee")}
    assert {(r.chunk_id, r.word, r.replacement) for r in noise.misreads.collect()} == {(3, "comm!ttee", "committee")}
    text = {r.chunk_id: r.text for r in scan_noise.repair(noise).collect()}
    assert text == {2: "all farmers came", 3: "the committee met"}


def test_common_words_change_no_result(spark, monkeypatch):
    vocab = "baaki total certificate pahunchi zaroori mandi council farmers receipt committee approved claims".split()
    docs = spark.createDataFrame([(i, " ".join(vocab) + " self-help self help") for i in range(9)], "doc_id long, text string")
    rows = [(1, 1, 0, 1, None, "total council! baak! self-\nhelp c0uncil"), (2, 1, 1, 2, None, "(receipt far-\nmers cla!ms\nself-\nhe1p")]
    chunks = spark.createDataFrame(rows, CHUNK)
    got = []
    for n in (0, 5, 8192):
        monkeypatch.setattr(scan_noise, "COMMON_WORDS", n)
        noise = scan_noise.Noise(chunks, docs)
        got.append(({tuple(r) for r in noise.found().collect()}, {tuple(r) for r in noise.misreads.collect()}))
    assert got[0] == got[1] == got[2] and (2, "claims") in {(i, r) for i, _, r in got[0][1]}


@settings(max_examples=200, deadline=None)
@given(st.text(st.sampled_from("abcrn1"), min_size=2, max_size=14), st.text(st.sampled_from("abcrn1"), min_size=2, max_size=14))
def test_gram_prefixes_meet(x, y):
    a, b = scan_noise.grams(x), scan_noise.grams(y)
    if len(a & b) >= scan_noise.MIN_GRAMS * max(len(a), len(b)):
        assert set(scan_noise.gram_prefix(x)) & set(scan_noise.gram_prefix(y))


def test_repaired_lines_keep_headings():
    text = "Sale of seed\nThe committee met on the second day and\nheard the farmers of the village, who\nasked for seed.\nNext the council met and heard the rest"
    assert scan_noise.rebuild(text, set(), set(), {}) == "Sale of seed\nThe committee met on the second day and heard the farmers of the village, who asked for seed.\nNext the council met and heard the rest"


def test_boosting_separates():
    rng = np.random.default_rng(0)
    x = rng.normal(size=(600, 3))
    y = (x[:, 0] * x[:, 1] > 0).astype(float)
    assert ((Boosted(trees=80).fit(x[:400], y[:400]).predict(x[400:]) > 0.5) == y[400:]).mean() > 0.85


def test_noise_end_to_end(spark):
    rng = random.Random(2)
    vocab = "village council office farmers receipt committee approved claims transfer register storage residence certificate quintal december seed mustard weavers station healthy".split()
    line = lambda n: " ".join(rng.choice(vocab) for _ in range(n)).capitalize() + "."
    docs = spark.createDataFrame([(i, " ".join(line(8) for _ in range(12)) + " The well-known fair.") for i in range(40)], "doc_id long, text string")
    rows, k = [], 0
    for d in range(30):
        for c in range(4):
            body = " ".join(line(9) for _ in range(7)).split()
            lines, cur = [], ""
            for w in body:
                if len(cur) + 1 + len(w) > 60:
                    lines.append(cur)
                    cur = w
                else:
                    cur = f"{cur} {w}".strip()
            lines.append(cur)
            lines.insert(2, f"RECORD OF PLACE {d}")
            lines.append(f"- {c + 6} -")
            rows.append((k, d, c, c + 1, None, "\n".join(lines)))
            k += 1
    noisy = list(rows)
    noisy[0] = (*rows[0][:5], rows[0][5].replace("- 6 -", "the comm-\nittee met and the well-\nknown cer-\ntificate, off!ce w0rk offce\n- 6 -"))
    noisy += [(900, None, None, None, None, None), (901, 3, 9, None, None, ""), (902, 3, 9, 1, None, "one\n777\ntwo")]
    chunks = spark.createDataFrame(noisy, CHUNK)
    noise = scan_noise.Noise(chunks, docs)
    got = {(r.chunk_id, r.kind) for r in noise.found().collect()}
    assert {(0, "hyphen"), (0, "misread"), (0, "header"), (0, "pageno")} <= got
    assert sum(k == "header" for _, k in got) >= 110 and (902, "pageno") not in got and sum(k == "misread" for _, k in got) <= 3
    assert {r.word for r in noise.misreads.collect()} == {"off!ce"}
    text = {r.chunk_id: r.text for r in scan_noise.repair(noise).collect()}[0]
    assert "committee met" in text and "well-known certificate, office" in text and "RECORD OF" not in text and "\n" not in text
    empty = scan_noise.Noise(chunks.limit(0), docs.limit(0))
    assert empty.found().count() == 0
