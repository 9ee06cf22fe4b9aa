import random
import unicodedata
from collections import defaultdict

import numpy as np
import pytest
from hypothesis import given, settings
from hypothesis import strategies as st

from lapwing.llm import broken_pairs, common, form_duplicates, fusion, leakage, linkage, lookalikes, names, packing, subjects

LONG = "word " * 40_000


def rows(df):
    return sorted(tuple(r) for r in df.collect())


# 1 names
def test_names(spark):
    own = ["Katherine Gonalhornor", "Kathy Gonalhornor", "GONALHORNOR, Katherine", "Prof. K. Gonalhornor", "Katherine Gonalhorner", "Thomas Gonalhornor", "Lalsovika Centre for Language Study", "Lalsovika CLS", "The Lalsovika Cent. Lang. Study", "Lalsovika Observatory Network", "", " ", "?", "X", LONG.strip()]
    df = spark.createDataFrame([(n, 1) for n in own], "name string, uses bigint")
    got = {tuple(r) for r in names.variants(df).collect()}
    people = sorted(own[:5])
    orgs = sorted([own[6], own[7], own[8]])
    assert got == {(a, b) for g in (people, orgs) for i, a in enumerate(g) for b in g[i + 1 :]}
    assert names.variants(df.limit(0)).count() == 0


def test_short_names_and_classes(spark):
    df = spark.createDataFrame([(n, 1) for n in ["John Smith", "John Smiht", "John Lee", "John Leo", "Anna Smithson", "Anna Smihtson", "Anna Smitson"]], "name string, uses bigint")
    got = {tuple(r) for r in names.variants(df).collect()}
    assert ("John Smith", "John Smiht")[::-1] in got and ("John Lee", "John Leo") not in got
    assert {(r.name, r.entity) for r in names.classes(df).collect()} == {(n, "Anna Smihtson") for n in ("Anna Smithson", "Anna Smihtson", "Anna Smitson")} | {(n, "John Smiht") for n in ("John Smith", "John Smiht")}
    assert names.classes(df.limit(0)).count() == 0


def test_author_names_of_odd_tables(spark):
    t = spark.createDataFrame([(["A B", None, " "], 1), (None, 2), ([], 3)], "authors array<string>, name int")
    assert rows(names.author_names(t, t.limit(0))) == [("A B", 1)]


@settings(max_examples=200, deadline=None)
@given(st.text("ab", max_size=7), st.text("ab", max_size=7), st.integers(1, 3))
def test_banded_distance(a, b, most):
    d = np.zeros((len(a) + 1, len(b) + 1), int)
    d[:, 0], d[0, :] = range(len(a) + 1), range(len(b) + 1)
    for i in range(1, len(a) + 1):
        for j in range(1, len(b) + 1):
            d[i, j] = min(d[i - 1, j] + 1, d[i, j - 1] + 1, d[i - 1, j - 1] + (a[i - 1] != b[j - 1]))
            if i > 1 and j > 1 and a[i - 1] == b[j - 2] and a[i - 2] == b[j - 1]:
                d[i, j] = min(d[i, j], d[i - 2, j - 2] + 1)
    assert min(names.osa(a, b, most), most + 1) == min(d[-1, -1], most + 1)


def test_segment_join_loses_no_single_edit(spark):
    rng = random.Random(3)
    base = ["".join(rng.choice("abcdefgh") for _ in range(rng.randint(7, 14))) for _ in range(60)]
    edits = []
    for w in base:
        i = rng.randrange(len(w) - 1)
        edits += [w[:i] + w[i + 1 :], w[:i] + "z" + w[i:], w[:i] + "z" + w[i + 1 :], w[:i] + w[i + 1] + w[i] + w[i + 2 :]]
    every = sorted(set(base + edits))
    got = {(r.a, r.b) for r in names.segment_join(spark.createDataFrame([("surname", w) for w in every], "field string, part string")).collect()}
    want = {(a, b) for a in every for b in every if a != b and min(len(a), len(b)) >= 6 and names.osa(a, b, 2) <= 1}
    assert want <= got


# 2 and 4 linkage and fusion
REG = "record_id bigint, source string, title string, authors array<string>, year int, venue string, doi string, arxiv_id string, url string, abstract string, manifestation string, score double, retrieved_at timestamp, work string"


def registry(spark):
    t = "Revisiting emperors after Hihostton: unstable colonies reconsidered"
    a = ["Viggo Talmimmudro", "Odile Fidrobriten"]
    stamp = lambda d: __import__("datetime").datetime(2024, 1, d)
    return spark.createDataFrame([
        (1, "crossref", t, a, 2010, "J. A", "10.1/a", None, "u", "x", "journal", 1.0, stamp(3), "w"),
        (1, "crossref", t, a, 2010, "J. A", "10.1/a", None, "u", "x", "journal", 1.0, stamp(3), "w"),
        (2, "arxiv", t.upper(), a, 2010, None, "10.1/A", None, None, None, "arxiv", 1.0, stamp(1), "w"),
        (3, "pubmed", t.replace("emperors", "empreors"), a[::-1], 2011, None, None, None, None, None, "unknown", 1.0, stamp(2), "w"),
        (4, "crossref", t + " II", a, 2012, "J. A", "10.1/b", None, None, None, "journal", 1.0, stamp(1), "w"),
        (5, None, None, None, None, None, None, None, None, None, None, None, None, None),
        (6, "arxiv", "", [], None, "", "", "", "", "", "", None, stamp(1), "w"),
    ], REG)


def test_works_and_representative(spark):
    r = registry(spark)
    groups = defaultdict(set)
    for x in linkage.works(r).collect():
        groups[x.work].add(x.record_id)
    assert sorted(map(sorted, groups.values())) == [[1, 2, 3], [4]]
    best = fusion.representatives(r).collect()
    assert [(b.group_id, b.best_id, b.sole_best, b.doi, b.manifestation) for b in best] == [(1, 1, True, "10.1/a", "journal")]
    assert fusion.representatives(r.limit(0)).count() == 0


def test_matches(spark):
    t = "Revisiting emperors after Hihostton: unstable colonies reconsidered"
    c = spark.createDataFrame([(1, t, ["Viggo Talmimmudro"], 2010, None, None), (2, t.replace("unstable", "unstabel"), [], None, " ", ""), (3, t + ": part two", ["V. Talmimmudro"], 2012, None, None), (4, t, None, None, "10.1/a", None), (5, None, None, None, None, None), (6, "Other words entirely about nothing here", [], None, None, None)], "citation_id bigint, title string, authors array<string>, year int, doi string, arxiv_id string")
    got = {tuple(r)[:2] for r in linkage.matches(c, registry(spark)).collect()}
    assert got == {(1, 1), (1, 2), (1, 3), (2, 1), (2, 2), (2, 3), (3, 4)}
    assert linkage.matches(c, registry(spark).limit(0)).count() == 0 and linkage.matches(c.limit(0), registry(spark)).count() == 0


def test_matches_of_much_cited_work(spark):
    # Many variants of one form, and many forms, lie between entry and record in every sort.
    t = "Revisiting emperors after Hihostton: unstable colonies reconsidered"
    entries = [(i, t.replace("unstable", "unstabel"), [f"Author{chr(97 + i % 26)}{chr(97 + i // 26)}"], 1900 + i, None, None) for i in range(60)]
    entries += [(100 + i, t.replace("Revisiting", "Revisiting"[: i % 8 + 1] + "x" + "Revisiting"[i % 8 + 1 :]).replace("reconsidered", "reconsidered"[: i // 8 + 1] + "y" + "reconsidered"[i // 8 + 1 :]), [], None, None, None) for i in range(64)]
    c = spark.createDataFrame([*entries, (900, t.replace("unstable", "unstabel"), ["Viggo Talmimmudro"], 2010, None, None)], "citation_id bigint, title string, authors array<string>, year int, doi string, arxiv_id string")
    got = {tuple(r)[:2] for r in linkage.matches(c, registry(spark)).collect()}
    assert got >= {(i, r) for i in [*range(100, 164), 900] for r in (1, 2, 3)}


def test_copying_is_found():
    rng = random.Random(0)
    patterns = defaultdict(int)
    for _ in range(3000):
        say = {"good": 0 if rng.random() < 0.9 else rng.randint(1, 9), "weak": 0 if rng.random() < 0.6 else rng.randint(1, 9), "fair": 0 if rng.random() < 0.8 else rng.randint(1, 9)}
        say["copy"] = say["weak"]
        by = defaultdict(list)
        for s, v in say.items():
            by[v].append(s)
        patterns[tuple(sorted(tuple(sorted(x)) for x in by.values()))] += 1
    accuracy, copying = fusion.learn([(list(p), n) for p, n in patterns.items()], fusion.Rules())
    assert copying["copy", "weak"] > 0.9 and copying["fair", "good"] < 0.5 and accuracy["good"] > accuracy["weak"]


# 3 broken pairs
@pytest.mark.parametrize(("prompt", "text", "want"), [
    ("Say hi", None, ["empty"]), ("Say hi", "​ \n", ["empty"]), ("Say hi", "N/A", ["empty"]), (None, "It is fine.", []), ("What is it?", "Yes.", []),
    ("Write on tin", "I'm sorry, but I can't help with that.", ["refusal"]), ("Nenne Quellen", "Es tut mir leid, dabei kann ich nicht helfen.", ["refusal"]),
    ("Write on tin", "Sorry for the delay; here is what I found. Tin is a soft metal that has been used since the bronze age in alloys.", []),
    ("Draft an overview of tin mines", "> Draft an overview of tin mines", ["copy", "truncated"]), ("Draft an overview of tin mines", "Draft an overview of tin mines\n\nTin mines are old and they are deep.", []),
    ("Was ist über Zinn bekannt und was nicht?", "The use of tin was common in the bronze age and it is still with us.", ["language"]), ("Please answer in French: what is tin?", "Le métal est connu depuis des siècles dans les mines.", []),
    ("Tell me of tin", "Tin is a metal that was found in the", ["truncated"]), ("List metals of the age", "They are these.\n- tin\n- iron", []), ("Tell me of tin", "Tin is old (see Smith", ["truncated"]),
    ("Tell me of tin", "Tin is a metal.\n\nReferences\n[1] A. Smith, Tin, 1999", []), ("Tell me of tin", LONG + ".", []),
])
def test_defects(prompt, text, want):
    assert broken_pairs.defects(prompt, text) == want


@pytest.mark.parametrize("times", [1, 2, 5, 20, 60])
def test_copies_of_any_length(times):
    assert "copy" in broken_pairs.defects("Draft an overview of tin mines", "Draft an **overview** of tin mines\n\n" * times)


@pytest.mark.parametrize("far", [10, 1900, 2600, 90_000])
def test_open_brackets_at_any_distance(far):
    assert broken_pairs.defects("Tell me of tin", "Tin is old (see Smith " + "and more " * (far // 9) + "end.") == ["truncated"]
    assert broken_pairs.defects("Tell me of tin", "Tin is old (see Smith) " + "and more " * (far // 9) + "end.") == []


def test_bibliography_cut_within_brackets():
    assert broken_pairs.defects("Tell me of tin", "Tin is old.\n\nReferences\n[1] A. Smith (1999). Tin.\n[2] B. Jones (19") == ["truncated"]


def test_broken_pairs_table(spark):
    df = spark.createDataFrame([(1, "p", None, "x"), (1, "p", None, "y"), (2, "a b c", "Fine.", "z")], "doc_id bigint, user_prompt string, generated_text string, defects string")
    assert rows(broken_pairs.first_defect(broken_pairs.broken_pairs(df))) == [(1, "empty")]
    assert broken_pairs.broken_pairs(df.limit(0)).count() == 0


# 5 form duplicates
def test_form_duplicates_against_brute_force(spark):
    rng = random.Random(5)
    base = [("Smith, A. A Title. 10.1/x", "A Title", "10.1/X"), ("Größe, B. Other", "Other", None), ("Hot one", "Hot", None), ("", "Lone", ""), (None, "Null raw", None)]
    data = []
    for i in range(400):
        raw, title, doi = base[2] if i % 3 == 0 else rng.choice(base)
        if raw and rng.random() < 0.5:
            w = raw.split()
            rng.shuffle(w)
            raw = "  ".join(w).upper()
        if doi and rng.random() < 0.5:
            doi = f"https://doi.example/{doi.lower()} "
        data.append((i, raw, title.upper() if rng.random() < 0.5 else f" {title}!", doi, "clash"))
    data += [(900, "x", None, None, ""), (901, "x", " ", None, "")]
    df = spark.createDataFrame(data, "citation_id bigint, raw string, title string, doi string, key string")
    got = {r.id: r.keep_id for r in form_duplicates.form_duplicates(df.repartition(7)).collect()}
    want, least = {}, {}
    for i, raw, title, doi, _ in data[:400]:
        fold = lambda s: sorted("".join(c if c.isalnum() else " " for c in (s or "").casefold()).split())
        k = (tuple(fold(raw)), tuple(fold(title)), (doi or "").lower().strip().replace("https://doi.example/", ""))
        want[i] = least.setdefault(k, i)
    assert got == want
    assert sum(r.copies for r in form_duplicates.representatives(form_duplicates.form_duplicates(df)).collect()) == 400
    assert form_duplicates.form_duplicates(df.limit(0)).count() == 0


# 6 look-alikes
def test_lookalikes(spark):
    titles = ["A plain title on tin", "A plаin title on tin", "Ｆｕｌｌ width", "zero​width", "no break", "Café talk", "Café talk", "ψ-class tin", "Обзор старых звёзд", "Tin 1990–1995", None, "", "Тin of old", LONG]
    df = spark.createDataFrame([(i, t, "x") for i, t in enumerate(titles)], "id int, title string, form string")
    score = lookalikes.bigram_counts(df, "title")
    got = {r.id: r.form for r in lookalikes.look_alikes(df, ["id"], "title", score).collect()}
    assert got == {1: titles[0], 2: "Full width", 3: "zerowidth", 4: "no break", 5: "Café talk", 12: "Tin of old"}
    assert lookalikes.look_alikes(df.limit(0), ["id"], "title", lookalikes.bigram_counts(df.limit(0), "title")).count() == 0
    assert unicodedata.is_normalized("NFC", got[5])


# 7 packing
@settings(max_examples=40, deadline=None)
@given(st.dictionaries(st.integers(1, 60), st.integers(0, 50), max_size=20), st.integers(60, 90))
def test_plan_uses_every_item_once(histogram, capacity):
    used = defaultdict(int)
    for pattern, times in packing.plan(histogram, capacity):
        assert sum(s * m for s, m in pattern.items()) <= capacity and times > 0
        for s, m in pattern.items():
            used[s] += m * times
    assert dict(used) == {s: n for s, n in histogram.items() if n}


def test_containers(spark):
    rng = random.Random(2)
    docs = [(i, " ".join(rng.choice(["tin", "iron", "lead"]) for _ in range(rng.randint(1, 90))), 0) for i in range(300)] + [(900, None, 0), (901, "", 0), (902, "tin " * 1000, 0)]
    df = spark.createDataFrame(docs, "doc_id bigint, text string, tokens int")
    limits = spark.createDataFrame([("small", 128), (None, 5), ("bad", 0)], "limit_name string, capacity_tokens int")
    got = packing.containers(df.repartition(5), limits).collect()
    by, whole = defaultdict(int), defaultdict(int)
    for r in got:
        by[r.container] += r.tokens
        whole[r.doc_id] += 1
    assert set(whole) == {d[0] for d in docs} and by.pop(0) == 0 and max(by.values()) <= 128
    assert {d for d, n in whole.items() if n > 1} == {902} and sum(by.values()) / (128 * len(by)) > 0.93
    assert packing.containers(df.limit(0), limits).count() == 0


# 8 leakage
ITEM = "In the Brenmostia ledger chronicles precede peace treaties, burial mounds come 51 lines later and Topalckstead is marked remote. A warden at Vudralton counted 197 charters before noon."


def test_leaked(spark):
    w = ITEM.split()
    swapped = [x if i % 7 else "thing" for i, x in enumerate(w[:22])]
    docs = [(1, "Intro words here.\n" + ITEM.upper().replace(" ", "\n") + " end"), (2, "They quote " + " ".join(w[:7]) + " only."), (3, "Some text " + " ".join(swapped).replace("Brenmostia", "Brenmotsia") + " tail"), (4, None), (5, ""), (6, LONG), (1, "Intro words here.\n" + ITEM.upper().replace(" ", "\n") + " end"), (7, "x " * 20_000 + ITEM)]
    d = spark.createDataFrame(docs, "doc_id bigint, text string")
    items = spark.createDataFrame([(10, ITEM), (11, "too short"), (12, None), (13, "Of 17 qualifying rounds once listed by Pennalssey the Dimheton edition still shows tackles, all of them late, and no more.")], "item_id bigint, text string")
    assert rows(leakage.leaked(d, items)) == [(1, 10), (3, 10), (7, 10)]
    assert leakage.leaked(d.limit(0), items).count() == 0 and leakage.leaked(d, items.limit(0)).count() == 0
    with pytest.raises(ValueError):
        leakage.leaked(d, items, leakage.Rules(max_items=2))


def test_few_replaced_words_hide_no_run():
    # Any four of sixteen words may be replaced, and an item may be held several times, as long as a telling word is left.
    rng = random.Random(8)
    other = "Of 17 qualifying rounds once listed by Pennalssey the Dimheton edition still shows tackles, all of them late, and no more."
    index = leakage.Index(leakage.Rules(), {i: leakage.tokens(ITEM if i < 5 else other) for i in range(6)})
    own, lost = index.items[0], []
    for s in range(len(own) - 15):
        for k in (2, 3, 4):
            for _ in range(20):
                gone = rng.sample(range(1, 15), k)
                run = ["zzzz" if x in gone else w for x, w in enumerate(own[s : s + 16])]
                if not any(len(w) > 4 and index.df[w] <= 2 for w in run):
                    continue
                words = ["before"] * rng.randrange(40) + run + ["after"] * 40
                found = index.candidates([words])[0]
                if not any(index.holds(words[max(at - 16, 0) : at + 48], 0) for at in found.get(0, ())):
                    lost.append(run)
    assert not lost


@pytest.mark.parametrize("copies", [1, 2, 3, 5])
def test_near_copies_of_items_hide_nothing(copies):
    # Items held several times with small changes of their own, passages with two words replaced.
    rng = random.Random(9)
    name = lambda: "".join(rng.choice(["bal", "dor", "kim", "lus", "nem", "pir", "sov", "tak"]) for _ in range(4))
    base = [f"In the {name()} ledger {name()} precede {name()} treaties and {name()} mounds come {rng.randrange(300)} lines later while {name()} is marked remote by a warden at {name()}" for _ in range(60)]
    items = {100 * i + c: leakage.tokens(f"{t} edition {name()}") for i, t in enumerate(base) for c in range(copies)}
    index = leakage.Index(leakage.Rules(stock_share=0.9), items)
    found = 0
    for i, t in enumerate(base):
        w = leakage.tokens(t)
        for x in rng.sample(range(1, len(w) - 1), 2):
            w[x] = "zzzz"
        words = ["before"] * rng.randrange(40) + w + ["after"] * 40
        hits = {index.ids[k] for k, at in index.candidates([words])[0].items() if any(index.holds(words[max(s - 16, 0) : s + 48], k) for s in at)}
        found += {100 * i + c for c in range(copies)} <= hits
    assert found == 60


def test_candidates_against_brute_force():
    # Every item at or above its threshold in a passage, and no other.
    rng = random.Random(10)
    pool = [f"w{chr(97 + i)}" for i in range(14)]
    items = {i: [rng.choice(pool) for _ in range(rng.randint(16, 30))] for i in range(50)}
    index = leakage.Index(leakage.Rules(block=4, known=0.3), items)
    assert sum(index.threshold > 0) == 50
    docs = [[rng.choice([*pool, "other"]) for _ in range(rng.randint(0, 120))] for _ in range(30)]
    got = {(d, k, at) for d, by in index.candidates(docs).items() for k, starts in by.items() for at in starts}
    terms = {}
    for k, t in zip(index.pair_key.tolist()[:-1], index.pair_term.tolist()[:-1], strict=True):
        terms[divmod(k, len(index.words))] = t
    part = defaultdict(float)
    for t in terms.values():
        for b in range(index.term_start[t], index.term_start[t + 1]):
            for x in range(index.block_start[b], index.block_start[b + 1]):
                part[t, int(index.posting[x])] = float(index.impact[x])
    want = set()
    for d, w in enumerate(docs):
        for at in range(0, len(w) if len(w) >= 16 else 0, 16):
            own = [terms.get((index.words.get(a, -1), index.words.get(b, -1))) for a, b in zip(w[at : at + 32], w[at + 1 : at + 33], strict=False)]
            for k in range(50):
                if sum(part.get((t, k), 0) for t in own) >= index.threshold[k]:
                    want.add((d, k, at))
    assert got == want and got


# 9 subjects
def test_subjects(spark):
    rng = random.Random(4)
    words = {"metal": [f"metal{c}" for c in "abcdefgh"], "plants": [f"plant{c}" for c in "abcdefgh"], "office": [f"desk{c}" for c in "abcdefgh"]}
    line = lambda s: " ".join([rng.choice(words[s]), "with", rng.choice(words[s]), "and", rng.choice(words[s])]).capitalize() + "."
    docs, truth = [], {}
    for i in range(300):
        kinds = [("metal",), ("plants",), ("metal", "plants"), ("office",)][i % 4]
        docs.append((i, " ".join(line(k) for k in kinds for _ in range(4)), "EN" if i % 9 else None))
        truth[i] = {k for k in kinds if k != "office"}
    docs += [(900, None, None), (901, "", "en")]
    labels = [(i, " Metal" if i % 8 else "METAL", None) for i in range(0, 160, 4)] + [(i, "plants", "x") for i in range(1, 160, 4)] + [(5, "unknown", None), (None, "metal", None), (12345, "metal", None)]
    strip = lambda s: s.replace("a.", ".")  # noqa: E731,F841
    table = [spark.createDataFrame(docs, "doc_id bigint, text string, lang string"), spark.createDataFrame(labels, "doc_id bigint, subject string, annotator string"), spark.createDataFrame([("metal", ""), ("plants", "")], "subject string, description string")]
    got = defaultdict(set)
    rules = subjects.Rules(rank=16, max_share=0.6)
    for r in subjects.subject_areas(*table, rules).collect():
        got[r.doc_id].add(r.subject)
    wrong = sum(got[i] != truth[i] for i in truth)
    assert wrong <= 0.05 * len(truth) and not got[900] and not got[901]
    for k in range(3):
        assert subjects.subject_areas(*[t.limit(0) if i == k else t for i, t in enumerate(table)], rules).count() == 0


def test_subjects_of_frequent_wording(spark):
    # A third of the documents are copies of one text, and every subject's own terms are in more than max_share of the texts.
    rng = random.Random(6)
    words = {s: [f"{s}{c}" for c in "abcdef"] for s in ("metal", "plants", "stars")}
    line = lambda s: f"They say that {rng.choice(words[s])} with {rng.choice(words[s])} came late."
    docs = [(i, " ".join(line(s) for _ in range(4)), s) for i in range(200) for s in [list(words)[i % 3]]]
    docs += [(1000 + i, "They say that metala with coppery met metalb. They say that coppery metalc came late.", "metal") for i in range(100)]
    table = [spark.createDataFrame([(i, t, "en") for i, t, _ in docs], "doc_id bigint, text string, lang string"), spark.createDataFrame([(i, s) for i, _, s in docs if i % 4 == 0], "doc_id bigint, subject string"), spark.createDataFrame([(s,) for s in words], "subject string")]
    got = {(r.doc_id, r.subject) for r in subjects.subject_areas(*table, subjects.Rules(rank=16)).collect()}
    assert got == {(i, s) for i, _, s in docs}


@pytest.mark.parametrize("cross", [False, True])
def test_results_do_not_depend_on_partitions(spark, cross):
    # Range partitions of many or few rows, and of none, find the same neighbours.
    rng = random.Random(12)
    base = [" ".join(rng.choice(["tin", "iron", "lead", "zinc", "gold", "copper", "nickel", "cobalt"]) + rng.choice("abcdef") for _ in range(7)) for _ in range(150)]
    forms = [(k // 150, b if k < 150 else b.replace(b.split()[3], b.split()[3] + "x"), f"author{k % 150:03}", 2000, 2000) for k, b in enumerate(base + base)]
    df = spark.createDataFrame(sorted(set(forms)), "side int, form string, authors string, low int, high int")
    was, got = spark.conf.get("spark.sql.shuffle.partitions"), []
    real = linkage.partitions
    try:
        for n in (1, 7, 60):
            spark.conf.set("spark.sql.shuffle.partitions", str(n))
            got.append(rows(linkage.sorted_neighbourhood(df, cross)))
        spark.conf.set("spark.sql.shuffle.partitions", "4")
        linkage.partitions = lambda s: 60
        forced = rows(linkage.sorted_neighbourhood(df, cross, rows_apart=1))
    finally:
        linkage.partitions = real
        spark.conf.set("spark.sql.shuffle.partitions", was)
    assert got[0] and got[0] == got[1] == got[2] == forced


def test_components(spark):
    rng = random.Random(13)
    edges = [(i, i + 1) for i in range(60)] + [(1000, 1000 + i) for i in range(1, 50)] + [(rng.randrange(2000, 2100), rng.randrange(2000, 2100)) for _ in range(70)]
    root = {v: v for e in edges for v in e}
    for _ in range(200):
        for a, b in edges:
            root[a] = root[b] = min(root[a], root[b])
    got = {r.v: r.root for r in common.components(spark.createDataFrame(edges, "a int, b int")).collect()}
    assert got == {v: r for v, r in root.items() if any(v in e and e[0] != e[1] for e in edges)}
    assert common.components(spark.createDataFrame([], "a int, b int")).count() == 0
