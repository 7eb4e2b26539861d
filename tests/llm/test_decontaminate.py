import random

from flowseq.llm import decontaminate as d
from tests.llm.data import ODD, frame

rng = random.Random(5)
WORDS = ["".join(rng.choice("abcdefghijklmnoprstuvw") for _ in range(rng.randint(2, 8))) for _ in range(400)]


def prose(n):
    return " ".join(rng.choice(WORDS) for _ in range(n))


def bench(spark, texts):
    return spark.createDataFrame([(i, t, "x") for i, t in enumerate(texts)], "item_id long, text string, doc_id string")


def edit(text, share):
    out = list(text)
    for _ in range(int(len(text) * share)):
        i = rng.randrange(len(out))
        kind = rng.randrange(3)
        if kind == 0:
            out[i] = "z"
        elif kind == 1:
            del out[i]
        else:
            out.insert(i, "y")
    return "".join(out)


def plain_distance(pattern, text):
    row = [0] * (len(text) + 1)
    for i, c in enumerate(pattern, 1):
        new = [i]
        for j, t in enumerate(text, 1):
            new.append(min(row[j - 1] + (c != t), row[j] + 1, new[-1] + 1))
        row = new
    return min(row)


def test_alignment_equals_the_plain_programme():
    for _ in range(300):
        p = bytes(rng.choice(b"abc") for _ in range(rng.randint(1, 12)))
        t = bytes(rng.choice(b"abc") for _ in range(rng.randint(0, 20)))
        got, want = d.align(p, t, 4), plain_distance(p, t)
        assert (got[0] if got else None) == (want if want <= 4 else None)
        if got:
            assert plain_distance(p, t[got[1] : got[2]]) == want


def test_exact_and_edited_leaks_are_found_and_clean_texts_are_not(spark):
    items = [prose(rng.randint(14, 60)) for _ in range(20)] + [None, "", "short one"]
    texts, expected = [], set()
    for i, item in enumerate(items[:20]):
        for share in (0, 0, 0.02, 0.03):
            text = f"{prose(50)} {edit(item.upper() if share else item, share)} {prose(30)}"
            expected.add((len(texts), i))
            texts.append(text)
    n = len(texts)
    texts += [prose(200) for _ in range(60)] + ODD + ["it was a shorter one here"]
    rows = d.leaks(frame(spark, texts), bench(spark, items)).collect()
    assert {(r["doc_id"], r["item_id"]) for r in rows} == expected
    for r in rows:
        if r["edits"] == 0 and r["doc_id"] % 4 < 2:
            assert texts[r["doc_id"]][r["start"] : r["end"]].lower() == items[r["item_id"]]
    kept = d.drop_leaks(frame(spark, texts), bench(spark, items))
    assert sorted(r["doc_id"] for r in kept.collect()) == list(range(n, len(texts)))
    assert kept.columns == frame(spark, ["x"]).columns


def test_every_region_within_the_budget_is_found():
    """The filter loses nothing: compared with a scan of all regions."""
    import numpy as np

    for _ in range(60):
        item = prose(25)
        patterns = d.Patterns([(0, item)])
        text = prose(6) + " " + edit(item, rng.choice([0.01, 0.03, 0.05, 0.08])) + " " + prose(6)
        data = np.frombuffer(d.fold(text), np.uint8)
        got = {p for _, p, *_ in d.regions(data, np.array([len(data)]), patterns)}
        for p, pattern in enumerate(patterns.text):
            assert (p in got) == (plain_distance(pattern, data.tobytes()) <= d.budget(len(pattern)))


def test_blocks_give_the_same(spark):
    items = [prose(30) for _ in range(8)]
    docs = frame(spark, [f"{prose(5)} {t} {prose(5)}" for t in items])
    one = {tuple(r) for r in d.leaks(docs, bench(spark, items)).collect()}
    many = {tuple(r) for r in d.leaks(docs, bench(spark, items), block_bytes=300).collect()}
    assert one == many and len(one) == 8


def test_ranges_and_neighbours_change_nothing():
    """Long texts in ranges, and hot q-grams in halves, give what each text gives alone."""
    import numpy as np

    shared = prose(12)
    items = [f"{shared} {prose(20)}" for _ in range(30)]
    patterns = d.Patterns(list(enumerate(items)))
    texts = [" ".join(x for i in rng.sample(range(30), 12) for x in (edit(items[i], rng.choice([0, 0.02, 0.03])), prose(rng.randint(0, 60)))) for _ in range(8)]
    raw = [t.encode() for t in [*texts, "", "é" * 40, shared * 30]]
    alone = []
    for t, r in enumerate(raw):
        data = np.frombuffer(d.fold(r.decode()), np.uint8)
        alone += [(t, *x[1:]) for x in d.regions(data, np.array([len(data)]), patterns)]
    assert len(alone) > 100
    for sizes in ({}, {"batch_bytes": 1000}, {"batch_matches": 50}, {"batch_bytes": 1500, "batch_matches": 10}):
        assert sorted(d.matches(raw, patterns, **sizes)) == sorted(alone)


def test_empty_tables(spark):
    assert d.leaks(frame(spark, ["x"]).limit(0), bench(spark, ["a" * 50])).count() == 0
    assert d.leaks(frame(spark, ["x"]), bench(spark, ["a"]).limit(0)).count() == 0
    assert d.drop_leaks(frame(spark, ["x"]), bench(spark, ["a"]).limit(0)).count() == 1


def test_case_is_folded_in_every_letter(spark):
    items = [" ".join(rng.choice(["été", "çà", "niño", "über", "größe", "στίχος", "слово", "garçon"]) for _ in range(24)) for _ in range(4)]
    texts = [f"Straße İ {prose(9)} {t.upper()} {prose(9)}" for t in items]
    rows = d.leaks(frame(spark, texts), bench(spark, items)).collect()
    assert sorted((r["doc_id"], r["item_id"], r["edits"]) for r in rows) == [(i, i, 0) for i in range(4)]
    for r in rows:
        assert texts[r["doc_id"]][r["start"] : r["end"]].casefold() == items[r["item_id"]].casefold()
    assert d.drop_leaks(frame(spark, texts), bench(spark, items)).count() == 0


def test_verbatim_parts_of_items_are_found(spark):
    items = [prose(n) for n in (14, 25, 40, 60)]
    texts, cut = [], []
    for i, item in enumerate(items):
        for _ in range(12):
            a = rng.randrange(len(item) - d.EXCERPT + 1)
            cut.append((i, item[a : a + d.EXCERPT]))
            texts.append(f"{prose(40)} x{cut[-1][1].upper()}x {prose(40)}")
    rows = {r["doc_id"]: r for r in d.leaks(frame(spark, texts), bench(spark, items)).collect()}
    assert sorted(rows) == list(range(len(texts)))
    for k, (i, part) in enumerate(cut):
        assert rows[k]["item_id"] == i and part.strip() in texts[k][rows[k]["start"] : rows[k]["end"]].lower()
    assert d.drop_leaks(frame(spark, texts), bench(spark, items)).count() == 0
    assert d.leaks(frame(spark, [f"{prose(9)} {p[:50]} {prose(9)}" for _, p in cut]), bench(spark, items)).count() == 0


def test_ranges_change_no_excerpt():
    items = [prose(60) for _ in range(10)]
    patterns = d.Patterns(list(enumerate(items)))
    raw = [" ".join(f"{prose(rng.randint(0, 30))} {items[rng.randrange(10)][40:180]}" for _ in range(30)).encode() for _ in range(3)]
    alone, parts = [], []
    assert not list(d.matches(raw, patterns, quoted=alone)) and len(alone) > 90
    list(d.matches(raw, patterns, batch_bytes=1000, quoted=parts))
    assert set(alone) <= set(parts)


def test_items_with_replaced_words_are_found(spark):
    """A word in a short item, two in each piece of a long one."""
    items = [prose(100)[:n] for n in (81, 81, 115, 150, 192, 192, 233, 380)]
    texts = []
    for item in items:
        out = list(item)
        for a in range(30, len(item) - 5, 76 if len(item) > 150 else 200):
            out[a : a + 5] = "#####".replace("#", "q")
        texts.append(f"{prose(30)} {''.join(out)} {prose(30)}")
    rows = d.leaks(frame(spark, texts), bench(spark, items)).collect()
    assert {(r["doc_id"], r["item_id"]) for r in rows} == {(i, i) for i in range(len(items))}
    assert all(10 * d.budget(m) >= m - 9 for m in range(81, d.PATTERN + 1))


def test_short_items_match_word_for_word(spark):
    texts = ["It was a SHORT,  one here", "it was a short ones", "ashort one", "short one", "a short? - one!", None, ""]
    rows = d.leaks(frame(spark, texts), bench(spark, ["Short one.", "!?", "", None])).collect()
    assert sorted((r["doc_id"], texts[r["doc_id"]][r["start"] : r["end"]]) for r in rows) == [(0, "SHORT,  one"), (3, "short one"), (4, "short? - one")]
    assert {(r["item_id"], r["edits"], r["shared_qgrams"]) for r in rows} == {(0, 0, 0)}


def test_null_and_repeated_item_ids_whatever_the_blocks(spark):
    items = [prose(20) for _ in range(4)]
    texts = [f"{prose(5)} {items[0]} {prose(9)} {items[1]} {items[2]} {prose(3)}", f"{items[3]} {prose(9)}"]
    table = spark.createDataFrame([(7, items[0], "x"), (7, items[1], "x"), (None, items[2], "x"), (None, items[3], "x"), (7, items[0], "x"), (2, items[3], "x")], "item_id long, text string, doc_id string")
    want = [(0, "7"), (0, "None"), (1, "2"), (1, "None")]
    for size in (1, 1 << 20):
        rows = d.leaks(frame(spark, texts), table, block_bytes=size).collect()
        assert sorted((r["doc_id"], str(r["item_id"])) for r in rows) == want
        whole = next(r for r in rows if r["item_id"] == 7)
        assert texts[0][whole["start"] : whole["end"]].startswith(items[0]) and texts[0][: whole["end"]].endswith(items[1])


def test_a_phrase_that_very_many_items_share_stays_in_bounds():
    phrase = prose(8)
    patterns = d.Patterns([(i, f"{prose(4)} {phrase} {prose(4)}") for i in range(60)])
    raw = [f"{patterns.text[17].decode()} {phrase} {phrase}".encode()] * 3
    whole = sorted(d.matches(raw, patterns))
    assert {(t, patterns.item[p]) for t, p, *_ in whole} >= {(t, 17) for t in range(3)}
    assert sorted(d.matches(raw, patterns, batch_matches=500)) == whole
