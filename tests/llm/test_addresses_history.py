"""Problems 5 and 6: spellings of one address; batches against history, against brute force."""

import random

import pytest
from pyspark.sql import functions as F

from kiteloom.llm import addresses, history, skew
from kiteloom.llm.encodings import fit_on

SAME = [
    "https://x.example/a-b/c?d=1&e=2", " HTTPS://X.EXAMPLE/A_B/c/?e=2&d=1#frag", "https://x.example/a%2Db/c?d=1&amp;e=2&utm_source=q", "https://x.example/a-b/c?&ref=z&d=1&e=2&fbclid=1&gclid=2&source=3", "​https://x.example/a-b/c?d=1&e=2﻿\xa0",
    "https://x.example/a-b/c/.?d=1;e=2", "https://x.example//a-b/c?d=%31&e=2#:~:text=more",
]
OTHER = ["http://x.example/a-b/c?d=1&e=2", "https://x.example/a-b/c?d=1&e=3", "https://x.example/a-b/c?d=1", "https://x.example/a-b/c?d=1&e=2&f=", "https://y.example/a-b/c?d=1&e=2", "https://x.example/a-b/c?de=12", "https://x.example/한글?d=1"]
NONE = [None, "", "  ​", "#x", "...", "?&"]


def frame(spark, urls):
    return spark.createDataFrame([(i + 1, u, 0, "h") for i, u in enumerate(urls)], "item_id long, link string, h1 int, canon string")


def test_spellings_collapse_and_differences_count(spark):
    rows = frame(spark, SAME + OTHER + NONE)
    got = sorted((r.first_id, r.copy_id) for r in addresses.address_copies(rows, "item_id", "link").collect())
    assert got == [(1, i) for i in range(2, len(SAME) + 1)]
    counts = sorted((r.first_id, r.n_copies, r.collided) for r in addresses.copy_counts(rows, "item_id", "link").collect())
    assert counts == [(1, len(SAME), False)] + [(len(SAME) + 1 + i, 1, False) for i in range(len(OTHER))]
    assert addresses.address_copies(rows.limit(0), "item_id", "link").count() == 0


def test_repeated_rows_null_keys_and_long_addresses(spark):
    long = "https://x.example/" + "a" * 50_000
    df = spark.createDataFrame([(5, long), (5, long), (7, long + "/"), (None, long)], "item_id long, link string")
    assert [(r.first_id, r.copy_id) for r in addresses.address_copies(df, "item_id", "link").collect()] == [(5, 7)]


def test_hot_groups_are_salted_and_stay_whole(spark, monkeypatch):
    monkeypatch.setattr(skew, "HOT_GROUP_ROWS", 100)
    df = spark.range(3000).select((F.col("id") + 1).alias("item_id"), F.when(F.col("id") % 3 == 0, F.concat(F.lit("https://x/"), F.col("id"))).otherwise("https://x/hot").alias("link"))
    got = addresses.address_copies(df, "item_id", "link").agg(F.count("*"), F.min("first_id"), F.max("first_id")).first()
    assert tuple(got) == (1999, 2, 2)


WORDS = "queue cache server topic module parser bucket token proxy worker gateway scheduler".split()


def distance(a, b):
    row = list(range(len(b) + 1))
    for i, x in enumerate(a, 1):
        row, last = [i], row
        for j, y in enumerate(b, 1):
            row.append(min(last[j] + 1, row[-1] + 1, last[j - 1] + (x != y)))
    return row[-1]


@pytest.fixture(scope="module")
def model():
    return fit_on(["Größere Änderung für die Übersicht", "처음에는 파서 문제라고 판단했지만"])


def test_segment_index_finds_every_pair_within_the_bound(spark):
    rng = random.Random(6)
    texts = {" ".join(rng.choice(WORDS) for _ in range(rng.randint(1, 6))) for _ in range(60)} | {"ab", "abc", "a", "release notes 1 2", "release notes 1 3"}
    for t in list(texts):
        for _ in range(2):
            s = list(t)
            for _ in range(rng.randint(1, 3)):
                at = rng.randrange(len(s)) if s else 0
                s[at:at + 1] = rng.choice([[], [rng.choice("xyz")], ["q", *s[at:at + 1]]])
            if "".join(s).strip():
                texts.add("".join(s))
    texts = sorted(texts)
    titles = spark.createDataFrame([(i, i, "s", t) for i, t in enumerate(texts)], "t1 long, t2 long, site string, canon string")
    found = {(r.t1, r.u1) for r in history.probe_segments(titles).join(history.stored_segments(titles).withColumnRenamed("t1", "u1"), "key").select("t1", "u1").distinct().collect()}
    for i, a in enumerate(texts):
        for j, b in enumerate(texts):
            if i != j and distance(a, b) <= history.TAU and min(len(a), len(b)) >= history.SEGMENTS and len(a) >= len(b):
                assert (i, j) in found, (a, b)


ARTICLES = [
    # seq, batch, site, title, url
    (1, 10, "s", "Lessons from a staged container we profiled for Lopata Lakipa", "https://x/1"), (2, 10, "s", "Inside Rarofa Bopako: notes on the alert", "https://x/2"),
    (3, 12, "s", "Lessons from the staged container we really profiled for Lopata Lakipa!", "https://x/3"), (4, 12, "s", "Lessons from a staged contaienr we profiled for Lopata Lakipa", "https://x/4"),
    (5, 12, "t", "Lessons from a staged container we profiled for Lopata Lakipa", "https://y/1"), (6, 12, "s", "Lessons from a staged container we profiled for Lopata Lakipa, Part 2", "https://x/6"),
    (7, 12, "s", "Lessons from a staged cursor we profiled for Lopata Lakipa", "https://x/7"), (8, 15, "s", "Other", "HTTPS://x/2/#top"), (9, 10, "s", "Other", "https://x/9"), (10, 15, None, "Inside Rarofa Bopako: notes on the alert", None),
    (11, 15, "s", None, None), (12, None, "s", "Other", "https://x/2"), (13, 15, "s", "[Update] inside rarofa bopako - notes on the alert | S", "https://x/13"), (14, 12, "s", "Inside Rarofa Bopaka: notes on the alert", "https://x/14"),
]


EDITS = history.TitleEdits(frozenset({"a", "the", "really", "update"}), {"learnings": "lessons"})


def repeat_rows(spark, rows):
    filler = [(100 + i, 9, "s", f"Lessons from a staged container we profiled for {a} {b}", f"https://f/{i}") for i, (a, b) in enumerate([(x, y) for x in ("Gamo", "Rolo", "Tika", "Bena", "Bopako", "Bopaka") for y in ("Mira", "Sole", "Lakipa", "cursor", "Rarofa")])]
    return spark.createDataFrame([(*r, "c", 1) for r in rows + filler], "seq long, batch_id long, site string, title string, url string, canon string, t1 int")


def test_repeats_by_address_and_title(spark, model):
    got = {r.new_seq: r.old_seq for r in history.repeated_articles(repeat_rows(spark, ARTICLES), model, EDITS).collect() if r.new_seq < 100}
    assert got == {3: 1, 4: 1, 8: 2, 13: 2}  # 9 is in no smaller batch than 10; Part 2, another thing, name or site are other articles


def test_copies_in_one_batch_are_no_history_and_rows_may_repeat(spark, model):
    rows = [(1, 1, "s", "Same title here now", "u1"), (2, 1, "s", "Same title here now", "u1"), (3, 2, "s", "Same title here now", "u2"), (3, 2, "s", "Same title here now", "u2"), (4, 3, "s", "x", "u2")]
    got = sorted((r.old_seq, r.new_seq) for r in history.repeated_articles(repeat_rows(spark, rows).filter("seq < 100"), model, EDITS).collect())
    assert got == [(1, 3), (3, 4)]
    assert history.repeated_articles(repeat_rows(spark, rows).limit(0), model).count() == 0


def test_differing_words():
    assert history.differing_words("a cache b", "a cahce b") == [("cache", "cahce")]
    assert history.differing_words("part 1", "part 2") is None and history.differing_words("a b c", "a b") is None
    canonical = lambda t: EDITS.canonical(history.title_words(t, "My Blog"))
    assert canonical("Lessons from the Cache - My Blog") == canonical("UPDATE: Learnings from a cache") == "lessons from cache"
    assert history.title_words("My Blog", "My Blog") == ["my", "blog"] and EDITS.canonical(["the", "a"]) == "the a"


def test_edits_of_words_are_learned_from_titles(spark, model):
    rng, rows = random.Random(7), []
    names = [f"{a}{b}{c}" for a in ("Lo", "Ka", "Mi", "Te", "Ru", "Sa") for b in ("pata", "nefi", "dora", "vilo", "kema") for c in ("", "na", "ro", "li", "tu", "so")]
    for i in range(900):
        title = f"Lessons from a {rng.choice(['small', 'busy', 'quiet'])} {rng.choice(WORDS)} we tuned for {rng.choice(names)} {rng.choice(names)}"
        rows.append(title)
        if i % 9 == 0:
            rows.append(rng.choice([title + " [repost]", title.replace("Lessons", "Learnings"), title.replace(" a ", " the "), title.replace(" a ", " ")]))
    told = spark.createDataFrame([("s", " ".join(history.title_words(t, "s")), history.name_words(t)) for t in rows], "site string, words string, names array<string>")
    edits = history.fit_title_edits(told)
    assert {"repost", "a"} <= edits.light and edits.same["learnings"] == "lessons" and edits.same.get("the", "a") == "a"
    # things and names that titles speak of are neither dropped nor replaced
    assert not edits.light & {*WORDS, "small", "busy", "lessons"} and not set(edits.same) & {*WORDS, "small", "busy", *map(str.lower, names)}
    assert history.fit_title_edits(told.limit(0)).same == {}


def edited_titles(spark, n):
    rng, rows = random.Random(8), []
    for i in range(n):
        title = f"Lessons from a small cache {i} we tuned for {rng.choice(WORDS)}"
        rows += [title, title.replace("Lessons", "Learnings")] if i % 9 == 0 else [title]
    return spark.createDataFrame([("s", " ".join(history.title_words(t, "s")), []) for t in rows], "site string, words string, names array<string>")


def test_titles_are_counted_in_the_executors(spark, monkeypatch):
    told, got = edited_titles(spark, 300), []
    collect = type(told).collect
    monkeypatch.setattr(type(told), "collect", lambda df: got.extend(rows := collect(df)) or rows)
    assert history.fit_title_edits(told).same == {"learnings": "lessons"}
    assert len(got) < 20  # words that were learned, no titles


def test_edits_are_learned_from_all_titles(spark, monkeypatch):
    monkeypatch.setattr(history, "FIT_KEYS", 100, raising=False)  # once a bound of what was read
    assert history.fit_title_edits(edited_titles(spark, 300)).same == {"learnings": "lessons"}


def test_batches_folded_into_a_store_equal_the_pass_over_all(spark, model, tmp_path):
    # "caches" is in one title only until batch 17: 15 repeats 12, and no later batch changes that; 20 repeats 15 only
    late = [(20, 12, "s", "Moving the cached topic to Lopata Lakipa", "https://x/20"), (21, 15, "s", "Moving the caches topic to Lopata Lakipa", "https://x/21"),
            (22, 17, "s", "Which caches do fill", "https://x/22"), (23, 17, "s", "Why cached things stay", "https://x/23"), (24, 20, "s", "Moving the caches topic to Lopata Lakipa", "https://x/24")]
    rows = repeat_rows(spark, ARTICLES + late).filter("batch_id IS NOT NULL")
    want = sorted(map(tuple, history.repeated_articles(rows, model, EDITS).collect()))
    assert want == [(1, 3), (1, 4), (2, 8), (2, 13), (20, 21), (21, 24)]
    for name, calls in (("mixed", [[9, 10], [12], [15, 17], [20]]),):
        store, got = str(tmp_path / name), []
        for call in calls:
            got += map(tuple, history.match_batches(rows.filter(F.col("batch_id").isin(call)), model, EDITS, store).collect())
        assert sorted(got) == want, name
    assert list(map(tuple, history.match_batches(rows.filter("batch_id = 20"), model, EDITS, store).collect())) == [(21, 24)]
    with pytest.raises(ValueError):
        history.match_batches(rows.filter("batch_id = 12"), model, EDITS, store)
    with pytest.raises(ValueError):
        history.match_batches(rows.filter("batch_id = 30"), model, store=store)
    assert history.match_batches(rows.limit(0), model, EDITS, store).count() == 0


def test_hot_segments_are_salted_and_lose_no_pair(spark, model, monkeypatch):
    rows = repeat_rows(spark, ARTICLES)
    want = sorted(map(tuple, history.repeated_articles(rows, model, EDITS).collect()))
    titles = spark.createDataFrame([(i, i, "s", f"standing phrase of all titles {i:03d}") for i in range(60)], "t1 long, t2 long, site string, canon string")
    pairs = lambda: sorted(map(tuple, history.met_titles(history.probe_segments(titles), history.stored_segments(titles)).collect()))
    plain = pairs()
    monkeypatch.setattr(history, "HOT_KEY_ROWS", 2)
    assert sorted(map(tuple, history.repeated_articles(rows, model, EDITS).collect())) == want
    assert pairs() == plain and len(plain) > 60


def test_rare_words_and_two_typos_of_one_word_are_misspellings(spark, model):
    rows = [(1, 1, "s", "Mameri Gabaki: a primary server for every bukcet", "u1"), (2, 2, "s", "Mameri Gabaki: a primary server for every bucekt", "u2"),
            (3, 1, "s", "Testing the zymurgy of Ganede Gotada", "u3"), (4, 2, "s", "Testing the zymrugy of Ganede Gotada", "u4"), (5, 2, "s", "Testing the zymurgy of Ganeda Gotada", "u5")]
    # both forms in two titles each beside a common word
    rows += [(6, 1, "t", "Moving the sokcet to Lomeva Roteta", "u6"), (7, 2, "t", "Moving the socekt to Lomeva Roteta", "u7"), (8, 1, "u", "sokcet", "u8"), (9, 1, "v", "socekt", "u9")]
    rows += [(100 + i, 0, f"w{i}", "socket", f"w{i}") for i in range(20)]
    got = sorted(map(tuple, history.repeated_articles(repeat_rows(spark, rows).filter("not url like 'https:%'"), model, EDITS).collect()))
    assert got == [(1, 2), (3, 4), (6, 7)]
