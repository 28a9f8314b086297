import random
import re

import pytest

from accordant.llm import decontaminate as dc

Q = "A train leaves the station with 12 coaches and travels 340 km before Alice meets it, then 12 coaches are taken off and it goes on for 5 hours"


def holds(item, text, coverage=dc.COVERAGE):
    block = dc.Block.build([(1, item)])
    return block.matches(text, dc.Canonical(block.words), coverage)


def test_copies_and_reparameterised_copies():
    assert holds(Q, f"Some text. {Q}. More text.") == [(1, 25, 25, False)]
    other = Q.replace("12", "9").replace("340", "1,250.5").replace("km", "miles").replace("Alice", "Zoë").replace("5 hours", "3 days")
    assert holds(Q, f"Some text. {other}. More text.") == [(1, 25, 25, True)]
    assert holds(Q, Q.upper().lower().replace("alice", "she")) != []


def test_windows_with_inconsistent_slots_do_not_count():
    """One value that stands for two spoils the windows that touch it and no other."""
    (found,) = holds(Q, Q)
    once = Q.replace("12", "9", 1)
    assert once.count("12") == Q.count("12") - 1 >= 1
    (told,) = holds(Q, once)
    assert told[0] == 1 and found[1] / 2 <= told[1] < found[1] and told[2] == found[2] and told[3] is False
    other = once.replace("340", "77")
    assert [t[3] for t in holds(Q, other)] == [True]
    # With a conflict in every window nothing is left.
    item = "alpha 12 beta gamma 12 delta epsilon 12 zeta eta 12 theta iota 12 kappa"
    assert holds(item, item.replace("12", "9", 3)) == [] and holds(item, item.replace("12", "9")) != []


def reparameterised(words, rng, slip):
    """A question made of words with numbers, a name and units, and the same with other values; with ``slip`` one place has yet another."""
    numbers, names, units = ["12", "340", "7.5"], ["Alice", "Boris"], ["km", "hours"]
    slots, out = [], []
    for i, w in enumerate(words):
        out.append(w.lower())
        if i % 6 == 3:
            kind = rng.choice(["number", "name", "unit"])
            slots.append(len(out))
            if kind == "name":
                out.append(rng.choice(names))
            else:
                out.append(rng.choice(numbers))
                if kind == "unit":
                    out.append(rng.choice(units))
    change = {"12": "95", "340": "1,208", "7.5": "3", "Alice": "Zoë", "Boris": "Karim", "km": "miles", "hours": "days"}
    new = [change.get(w, w) for w in out]
    if slip:
        at = rng.choice([s for s in slots])
        new[at] = "Someone" if out[at] in names else "4711"
    return " ".join(out), " ".join(new)


@pytest.mark.parametrize("slip", [False, True])
def test_recall_of_reparameterised_questions(spark, slip):
    """Of questions with other numbers, names and units at least 0.9 are found, with one inconsistent value too; each item alone."""
    rng = random.Random(11)
    texts = [r.text for r in spark.read.parquet("/root/testdata/sf0.01/benchmark.parquet").collect() if len((r.text or "").split()) >= 12]
    pairs = [reparameterised(re.findall(r"[^\W\d_]+", t), rng, slip) for t in texts]
    bench = spark.createDataFrame([(i, a) for i, (a, _) in enumerate(pairs)], "item_id long, text string")
    docs = spark.createDataFrame([(i, f"Some words before. {b}. And words after it.") for i, (_, b) in enumerate(pairs)], "doc_id long, text string")
    got = dc.contaminated(spark, docs, bench).collect()
    found = {(r.doc_id, r.item_id) for r in got}
    assert len(pairs) >= 20 and sum((i, i) in found for i in range(len(pairs))) >= 0.9 * len(pairs)
    assert all(a == b or pairs[a] == pairs[b] for a, b in found)
    assert all(r.reparameterised for r in got) or slip


def test_what_is_clean_stays():
    assert holds(Q, "") == holds(Q, None) == holds("", Q) == holds(None, Q) == []
    assert holds(Q, "A train leaves the station with 12 coaches and nothing else happens on this quiet day at all") == []
    assert holds("12 34 56 78 90 12 34", "99 12 34 55 66 77 88 99 10 11 12") == []
    assert holds("two words", "Two words!") == [(1, 1, 1, False)] and holds("two words", "two words more") == []


def plain(item, text):
    """Matches of texts without placeholders, by sets of windows."""
    w = lambda s: re.findall(r"[^\W\d_]+", (s or "").lower())
    a, b = w(item), w(text)
    windows = lambda x: [tuple(x[i : i + 5]) for i in range(len(x) - 4)]
    there = set(windows(b))
    return sum(x in there for x in windows(a)) >= 0.5 * (len(a) - 4) > 0


def test_query_equals_brute_force(spark):
    sf = "/root/testdata/sf0.01"
    docs, bench = (spark.read.parquet(f"{sf}/{t}.parquet").collect() for t in ("documents", "benchmark"))
    got = {(r.doc_id, r.item_id) for r in dc.op1_query(spark, sf).collect()}
    assert got == {(d.doc_id, b.item_id) for d in docs for b in bench if plain(b.text, d.text)} and got


@pytest.mark.parametrize("block_bytes", [150, dc.BLOCK_BYTES])
def test_blocks_and_hard_rows(spark, monkeypatch, block_bytes):
    monkeypatch.setattr(dc.blocks, "__defaults__", ("item_id", "text", block_bytes))
    docs = spark.createDataFrame([(1, Q, 0), (1, Q, 0), (None, f"x {Q}", 0), (2, None, 0), (3, "", 0), (4, "clean words only", 0), (5, ("filler words here " * 40_000) + Q, 0)], "doc_id long, text string, item_id int")
    bench = spark.createDataFrame([(7, Q), (7, Q), (None, Q), (8, None), (9, ""), (10, "quite another question which no document has in it")], "item_id long, text string")
    got = [(r.doc_id, r.item_id) for r in dc.contaminated(spark, docs, bench).collect()]
    assert sorted(got, key=str) == sorted([(d, i) for d in (1, 1, None, 5) for i in (7, 7, None)], key=str)
    assert dc.contaminated(spark, docs, bench.limit(0)).count() == 0
    assert dc.contaminated(spark, docs.limit(0), bench).count() == 0


def test_copies_in_other_cases_are_found(spark):
    """Upper case, title case and lower case, where capitals tell no names; by brute force over a fixture too."""
    for copy in (Q.upper(), Q.title(), Q.lower(), Q):
        assert holds(Q, f"Some text. {copy}. More text.") == [(1, 25, 25, False)]
        assert holds(copy, f"Some text. {Q}. More text.") == [(1, 25, 25, False)]
    sf = "/root/testdata/sf0.01"
    bench = spark.read.parquet(f"{sf}/benchmark.parquet").limit(12)
    items = [r for r in bench.collect() if len(r.text.split()) > 6]
    texts = [f"Before it. {change(r.text)} And after it." for r in items for change in (str.upper, str.title, str.lower, str.swapcase)]
    docs = spark.createDataFrame(list(enumerate(texts)), "doc_id long, text string")
    got = {(r.doc_id, r.item_id) for r in dc.contaminated(spark, docs, bench).collect()}
    assert got == {(d, b.item_id) for d, t in enumerate(texts) for b in bench.collect() if plain(b.text, t)} and len(got) >= len(texts) > 20


@pytest.mark.parametrize("item", ["What is gravity?", "12 + 34 = 46, 56 + 78 = 134, 9 + 9 = 18", "什么是万有引力定律", "これは何ですか。答えてください。", "5 km 6 km 7 km 8 km"])
def test_items_without_a_telling_window_are_found_inside_texts(item):
    assert holds(item, f"Some text goes before. {item} Then more text follows it.") == [(1, 1, 1, False)]
    assert holds(item, "Some text goes before. Then more 12 + 34 text follows it.") == []
