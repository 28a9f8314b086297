import random
import re

import numpy as np
import pytest

from accordant.llm import similar_texts as st
from accordant.llm.simhash import shingle_hashes


def word(rng):
    return "".join(rng.choice("abcdefghijklmnop") for _ in range(rng.randrange(2, 8)))


def edited(rng, words, share):
    return [word(rng) if rng.random() < share else w for w in words]


def jaccard(a, b):
    x, y = ({tuple(w[i : i + 5]) for i in range(len(w) - 4)} for w in (a, b))
    return len(x & y) / len(x | y)


def plain_shingles(text):
    found = re.findall(rb"[^\x20\x09-\x0D]+", re.sub(rb"[A-Z]", lambda m: m[0].lower(), (text or "").encode()))
    return [b" ".join(found[i : i + 5]) for i in range(max(1, len(found) - 4))] if found else []


@pytest.mark.parametrize("piece", [1, 5, 1 << 20])
def test_shingles_are_those_of_words(piece, monkeypatch):
    """Equal runs of words have equal hashes and others have others, wherever the text is cut."""
    monkeypatch.setattr(st, "PIECE", piece)
    texts = [None, "", " \t\n", "A", "a b c d e", "a b c d e f a b c d e", "One two\x0bthree", "\x00 \x00\x00 a", "é É 三 x\x1cy z", "ab c", "a bc", "word " * 9]
    seen = {}
    for t in texts:
        want, got = plain_shingles(t), st.shingles(t)
        assert len(want) == len(got)
        for w, g in zip(want, got.tolist(), strict=True):
            assert seen.setdefault(w, g) == g
    assert len(set(seen.values())) == len(seen)


def test_bands_of_alike_texts_meet():
    rng = random.Random(4)
    met = 0
    for _ in range(60):
        a = [word(rng) for _ in range(600)]
        found = [st.distinct_shingles(" ".join(x)) for x in (a, edited(rng, a, 0.02))]
        one, two = st.bands(np.array([st.sketch(x) for x in found]))
        met += bool(set(one.tolist()) & set(two.tolist()))
        assert len(one) == st.BINS // st.BAND_BINS
    assert met >= 55
    assert [x.tolist() for x in st.bands(np.array([st.sketch(st.distinct_shingles(t)) for t in ("", None)]))] == [[0], [0]]


def test_bitmaps_and_places_turn_no_similar_pair_away():
    rng = random.Random(9)
    for _ in range(300):
        base = [rng.getrandbits(64) for _ in range(rng.choice((5, 40, 400, 3000)))]
        one, two = (np.unique(np.array([x if rng.random() > 0.08 else rng.getrandbits(64) for x in base], np.uint64)) for _ in range(2))
        one, two = sorted((one, two), key=len)
        maps = [np.frombuffer(st.bitmap(x), np.uint64) for x in (one, two)]
        both = np.intersect1d(one, two)
        assert np.bitwise_count(maps[0] ^ maps[1]).sum() <= len(one) + len(two) - 2 * len(both)
        if st.jaccard_reaches(one.tobytes(), two.tobytes()):
            places = [int(np.searchsorted(x, both[0])) for x in (one, two)]
            rest = [np.array([len(two)]), np.array(places[1:]), maps[1][None]]
            assert st.may_reach([len(one), places[0], maps[0]], rest).tolist() == [True]


def test_counters_cover_all_texts(spark):
    docs = spark.createDataFrame([("a b c d e f",), ("a b c d e f g",), (None,), ("a b c d e f",)], "text string")
    counts = st.shingle_counts(docs, "text")
    assert len(counts) == st.COUNTERS and counts.sum() == 7
    assert counts[st.counter_of(st.distinct_shingles("a b c d e"))].tolist() == [3]


@pytest.mark.parametrize("shard_rows", [4, 256])
def test_near_copies_are_one_class_and_others_are_not(spark, shard_rows, monkeypatch):
    monkeypatch.setattr(st.missing_pairs, "__defaults__", (shard_rows,))
    rng = random.Random(7)
    rows, truth = [], {}
    for g in range(30):
        base = [word(rng) for _ in range(rng.choice((60, 200, 500)))]
        for k in range(rng.choice((1, 3, 12))):
            doc = len(rows) + 100
            rows.append((doc, " ".join(edited(rng, base, 0.008 if k else 0)), "s"))
            truth[doc] = g
    rows += [(1, None, "s"), (2, "", "s"), (3, " ", "s"), (None, rows[0][1], "s"), (100, rows[0][1], "s"), (9, "short text", "s")]
    docs = spark.createDataFrame(rows, "doc_id long, text string, sketch string")
    got = st.similar_classes(docs).collect()
    assert len(got) == len(rows)
    classes = {r.doc_id: r.component for r in got}
    assert classes[1] == classes[2] == classes[3] == 1 and classes[9] == 9
    texts = {d: re.findall(r"\S+", t) for d, t, _ in rows if d and d >= 100}
    assert all(truth[d] == truth[classes[d]] for d in truth)
    close = [d for d in truth if any(e < d and truth[e] == truth[d] and jaccard(texts[d], texts[e]) >= 0.8 for e in truth)]
    assert len(close) > 40 and all(classes[d] != d for d in close)
    assert st.similar_classes(docs.limit(0)).count() == 0


def test_one_of_each_stays(spark):
    text = " ".join(f"w{i}" for i in range(50))
    docs = spark.createDataFrame([(2, text, "a"), (1, text, "b"), (1, text, "b"), (3, "quite another text", "c"), (None, text, "d")], "doc_id long, text string, source string")
    assert sorted(str(r.doc_id) for r in st.keep_one_of_each(spark, docs).collect()) == ["1", "3", "None"]
    assert st.keep_one_of_each(spark, docs).columns == docs.columns


def test_repeated_ids_and_clashing_names(spark):
    """Two unlike texts of one id: the copy goes, the other text stays, and the caller's columns keep their values."""
    one, other = (" ".join(f"{c}{i}" for i in range(50)) for c in "ab")
    rows = [(3, one, 7, 8), (5, one, 7, 8), (5, other, 7, 8), (5, other, 7, 8)]
    docs = spark.createDataFrame(rows, "doc_id long, text string, _mark long, _number long")
    kept = sorted(st.keep_one_of_each(spark, docs).collect())
    assert [tuple(r) for r in kept] == [(3, one, 7, 8), (5, other, 7, 8)]
    with pytest.raises(ValueError):
        st.similar_classes(docs.withColumnRenamed("doc_id", "component"), "component")


def test_no_pair_of_the_data_is_lost(spark):
    """All pairs of sf0.01 documents by whole sets, at the operator's own similarity."""
    docs = spark.read.parquet("/root/testdata/sf0.01/documents.parquet")
    texts = {r.doc_id: r.text for r in docs.collect()}
    got = {r.doc_id: r.component for r in st.similar_classes(docs).collect()}
    assert got == exact_classes(texts)


def test_texts_below_the_similarity_are_not_linked(spark):
    """Pairs of sf0.001 whose sketches pass the lowered bar but whose sets don't reach 0.8: 0.715 and 0.797."""
    docs = spark.read.parquet("/root/testdata/sf0.001/documents.parquet").filter("doc_id in (37, 56, 106, 185)")
    assert {r.doc_id: r.component for r in st.similar_classes(docs).collect()} == {d: d for d in (37, 56, 106, 185)}
    a, b = (np.arange(n, dtype=np.uint64).tobytes() for n in (8, 10))
    assert st.jaccard_reaches(a, b) and not st.jaccard_reaches(a[:-8], b)


def exact_classes(texts):
    sets = {d: frozenset(shingle_hashes(t, 5).tolist()) for d, t in texts.items()}
    roots = {d: d for d in sets}
    for d in sorted(sets):
        near = [o for o in sets if o < d and 4 * len(sets[o]) <= 5 * len(sets[d]) and 4 * len(sets[d]) <= 5 * len(sets[o])]
        linked = {roots[o] for o in near if 5 * len(sets[o] & sets[d]) >= 4 * len(sets[o] | sets[d])} | {d}
        roots = {o: min(linked) if r in linked else r for o, r in roots.items()}
    return roots


@pytest.mark.parametrize("shard_rows", [2, 256])
def test_classes_are_those_of_all_pairs_by_whole_sets(spark, shard_rows, monkeypatch):
    """Many pairs just above and just below 0.8: none is lost and none is linked, whatever their fingerprints are."""
    monkeypatch.setattr(st.missing_pairs, "__defaults__", (shard_rows,))
    rng = random.Random(11)
    texts = {}
    line = [word(rng) for _ in range(12)]
    for _ in range(60):
        base = [word(rng) for _ in range(rng.choice((7, 30, 120, 300)))] + rng.choice(([], line))
        for k in range(4):
            texts[len(texts)] = " ".join(edited(rng, base, rng.choice((0.01, 0.02, 0.025, 0.03)) if k else 0))
    want = exact_classes(texts)
    docs = spark.createDataFrame(list(texts.items()), "doc_id long, text string")
    assert {r.doc_id: r.component for r in st.similar_classes(docs).collect()} == want
    assert 20 < sum(d != c for d, c in want.items()) < 170
