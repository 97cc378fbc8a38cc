"""Decontamination and license search against plain loops."""

from __future__ import annotations

import random
import re

from pyspark.sql import functions as F

from meterlens.llm import decontamination, licenses
from meterlens.llm.decontamination import Suffixes, remove_contaminated, with_matches
from meterlens.llm.queries import license_notices

WORD = re.compile(r"[^\x00-\x2F\x3A-\x60\x7B-\x7F]+")


def words(text):
    return WORD.findall("".join(c.lower() if "A" <= c <= "Z" else c for c in text or ""))


def windows_in(docs, items, window):
    """(words, words hit, items) of each text."""
    known = {}
    for name, text in items:
        w = words(text)
        size = min(window, len(w))
        for n in range(len(w) - size + 1) if w else ():
            known.setdefault(tuple(w[n : n + size]), set()).add(name)
    out = []
    for text in docs:
        w, hit, names = words(text), set(), set()
        for size in {len(k) for k in known}:
            for n in range(len(w) - size + 1):
                if found := known.get(tuple(w[n : n + size])):
                    names |= found
                    hit.update(range(n, n + size))
        out.append((len(w), len(hit), sorted(names)))
    return out


def longest_match(text, items, window):
    w, best = words(text), 0
    for _, item in items:
        i = words(item)
        least = min(window, len(i)) if i else len(w) + 1
        for a in range(len(w)):
            for b in range(len(i)):
                n = 0
                while a + n < len(w) and b + n < len(i) and w[a + n] == i[b + n]:
                    n += 1
                if n >= least:
                    best = max(best, n)
    return best


def test_suffix_arrays_find_all_windows():
    rng = random.Random(3)
    letters = ["a", "b", "c", "É", "d2"]
    for _ in range(150):
        few = letters[: rng.randint(1, 5)]
        items = [
            (str(n), " ".join(rng.choices(few, k=rng.choice([0, 1, 2, 3, 5, 9]))))
            for n in range(rng.randint(0, 6))
        ]
        docs = [
            rng.choice([None, "", " ".join(rng.choices(letters, k=rng.randint(0, 40)))])
            for _ in range(5)
        ]
        got = Suffixes(items, 4).judge(docs)
        assert [
            (g["n_words"], sum(s["end"] - s["start"] for s in g["spans"]), g["items"]) for g in got
        ] == windows_in(docs, items, 4)
        assert [g["longest"] for g in got] == [longest_match(d, items, 4) for d in docs]


def test_blocks_of_items_give_the_same(spark, sf_dir):
    docs = spark.read.parquet(f"{sf_dir}/documents.parquet")
    tests = spark.read.parquet(f"{sf_dir}/benchmark.parquet")
    one = with_matches(docs, tests).select("doc_id", "matches").collect()
    many = with_matches(docs, tests, block_bytes=15_000).select("doc_id", "matches").collect()
    assert any(r.matches.spans for r in one)
    plain = [{r.doc_id: r.matches.asDict(True) for r in rows} for rows in (one, many)]
    assert plain[0].keys() == plain[1].keys()
    for key, want in plain[0].items():
        got = plain[1][key]
        assert {k: got[k] for k in ("n_words", "items")} == {k: want[k] for k in ("n_words", "items")}
        hit = [
            {n for s in m["spans"] for n in range(s["start"], s["end"])} for m in (got, want)
        ]
        assert hit[0] == hit[1]


def test_contaminated_documents_go_and_columns_stay(spark):
    passage = " ".join(f"w{n}" for n in range(13))
    docs = spark.createDataFrame(
        [
            (1, f"before, {passage.upper()}! after", "x"),
            (2, passage + " filler" * 300, "x"),
            (3, "something else", "x"),
            (4, None, "x"),
            (4, "", None),
        ],
        "doc_id long, text string, matches string",
    )
    tests = spark.createDataFrame([(7, passage), (8, None), (9, "")], "item_id long, text string")
    left = remove_contaminated(docs, tests)
    assert left.columns == docs.columns
    assert sorted(r.doc_id for r in left.collect()) == [2, 3, 4, 4]
    none = spark.createDataFrame([], "item_id long, text string")
    assert remove_contaminated(docs, none).count() == 5
    assert remove_contaminated(docs.limit(0), tests).count() == 0
    hits = with_matches(docs, tests, into="found").where("doc_id = 2").first()
    assert (hits.found.n_words, hits.found.longest, hits.found["items"]) == (313, 13, ["7"])
    assert docs.count() == with_matches(docs, tests, into="found").count()
    assert decontamination.WINDOW == 13


def base_places(text):
    w = words(text)
    out = []
    for notice in licenses.PHRASES:
        p = notice.wording.split()
        out += [(n, notice.label) for n in range(len(w) - len(p) + 1) if w[n : n + len(p)] == p]
    return out


def test_base_places_equal_a_plain_loop(spark):
    rng = random.Random(5)
    pieces = "gnu general public license apache cc by mit x CC-BY MIT\tLicense ccby É".split(" ")
    texts = [" ".join(rng.choices(pieces, k=rng.randint(0, 25))) for _ in range(300)]
    finder = licenses.finder(licenses.PHRASES + licenses.NOTICES)
    for text in [*texts, None, "", "cc by by cc by", "ccc by", "cc bye"]:
        got = sorted((p["word"], p["label"]) for p in finder.judge(text)["places"] if p["base"])
        assert got == sorted(base_places(text)), text


def test_many_places_in_one_text():
    found = licenses.finder(licenses.PHRASES + licenses.NOTICES).judge("cc by " * 50_000)
    assert sum(p["base"] for p in found["places"]) == 50_000
    assert found["places"][-1]["word"] == 99_998


def test_notices_with_edits():
    found = licenses.finder(licenses.NOTICES).judge(
        "Some text. Licensed under teh Apache Licence, Version 2.0. Then released undr the MIT "
        "Licens! Last, all rights resrved here."
    )["places"]
    assert [(p["label"], p["word"], p["end_word"], p["edits"]) for p in found] == [
        ("apache", 2, 10, 3),
        ("mit", 11, 16, 2),
        ("proprietary", 17, 20, 1),
    ]
    assert all(0 < p["score"] < 1 for p in found)


def test_pieces_cover_each_notice():
    for notice in licenses.NOTICES:
        pieces = licenses.NoticeFinder.split(notice)
        assert len(pieces) == notice.edits + 1
        assert "".join(p for _, p in pieces) == notice.wording


def distance(a, b):
    """Levenshtein distance."""
    row = list(range(len(b) + 1))
    for i, x in enumerate(a, 1):
        last, row[0] = row[0], i
        for j, y in enumerate(b, 1):
            last, row[j] = row[j], min(row[j] + 1, row[j - 1] + 1, last + (x != y))
    return row[-1]


def test_notices_inside_longer_words():
    finder = licenses.finder(licenses.NOTICES)

    def found(text):
        return [(p["label"], p["word"], p["end_word"], p["edits"]) for p in finder.judge(text)["places"]]

    assert found("x sublicensed under a creative commons attribution y") == [("cc-by", 1, 7, 3)]
    assert found("Mozilla public licenses") == [("mpl", 0, 3, 1)]
    assert found("all rights reserved2024") == []  # four letters more than two edits
    assert found("all rights reservedxy, all rights reserved") == [
        ("proprietary", 0, 3, 2), ("proprietary", 3, 6, 0),
    ]


def test_labels_equal_a_levenshtein_loop():
    """A notice is found if and only if some words of the text are within its bound."""
    rng = random.Random(17)
    notices = [n for n in licenses.NOTICES if len(n.wording) < 40]
    finder = licenses.finder(tuple(notices))
    for _ in range(250):
        notice, text = rng.choice(notices), []
        for _ in range(rng.randint(1, 2)):
            letters = list(notice.wording)
            for _ in range(rng.randint(0, notice.edits + 1)):
                at = rng.randrange(len(letters))
                letters[at] = rng.choice(["", letters[at] + rng.choice("abc1 "), rng.choice("abc1 ")])
            text += [rng.choice(["", "x ", "the "]), "".join(letters), rng.choice(["", " of it", "s", "2024"]), " "]
        text = "".join(text)
        own = words(text)
        want = set()
        for n in notices:
            size = n.wording.count(" ") + 1
            spans = (
                " ".join(own[i:j])
                for i in range(len(own))
                for j in range(i + 1, min(len(own), i + size + n.edits) + 1)
            )
            if any(distance(s, n.wording) <= n.edits for s in spans):
                want.add(n.label)
        places = finder.judge(text)["places"]
        assert {p["label"] for p in places} == want, text
        for p in places:
            span = " ".join(own[p["word"] : p["end_word"]])
            assert p["edits"] == min(distance(span, n.wording) for n in notices if n.label == p["label"])


def test_license_query(spark, sf_dir):
    docs = {
        r.doc_id: r.text for r in spark.read.parquet(f"{sf_dir}/documents.parquet").collect()
    }
    rows = license_notices(spark, sf_dir).collect()
    assert len(rows) == len(docs)
    for r in rows:
        base = base_places(docs[r.doc_id])
        assert (r.n_words, r.n_base) == (len(words(docs[r.doc_id])), len(base))
        starts = [n for n, _ in base]
        assert (r.first_word, r.last_word) == ((min(starts), max(starts)) if base else (None, None))
        assert r.base_labels == ",".join(sorted({label for _, label in base}))
        assert {label for _, label in base} <= set(r.labels.split(","))
        assert 0 <= r.score <= 1


def test_license_columns_stay(spark):
    docs = spark.createDataFrame([(None, None, "n"), (1, "cc by", "n")], "doc_id long, text string, places string")
    got = licenses.with_notices(docs).select("places", F.size("notices.places").alias("n")).collect()
    assert sorted(r.n for r in got) == [0, 1] and {r.places for r in got} == {"n"}
    assert licenses.with_notices(docs.limit(0)).count() == 0


def longest_by_loops(text, items):
    """Words of the longest run that a text and an item share, of at least a window."""
    own, best = words(text), 0
    for item in items:
        theirs = words(item)
        if theirs and len(theirs) < decontamination.WINDOW:
            n = len(theirs)
            if any(own[k : k + n] == theirs for k in range(len(own) - n + 1)):
                best = max(best, n)
        for i in range(len(own)):
            for j in range(len(theirs)):
                n = 0
                while i + n < len(own) and j + n < len(theirs) and own[i + n] == theirs[j + n]:
                    n += 1
                if n >= decontamination.WINDOW:
                    best = max(best, n)
    return best


def test_longest_match_of_items_with_shared_parts():
    rng = random.Random(31)
    vocabulary = [f"w{n}" for n in range(30)]
    opening = rng.choices(vocabulary, k=20)
    for _ in range(25):
        items = [" ".join(opening + rng.choices(vocabulary, k=rng.randint(0, 8))) for _ in range(6)]
        items += [" ".join(rng.choices(vocabulary, k=4))]
        text = rng.choices(vocabulary, k=10)
        for _ in range(3):
            part = rng.choice(items).split()
            begin = rng.randrange(len(part))
            text += part[begin : begin + rng.randint(5, 30)] + rng.choices(vocabulary, k=rng.randint(0, 3))
        text = " ".join(text)
        found = Suffixes([(str(n), t) for n, t in enumerate(items)]).judge([text])[0]
        assert found["longest"] == longest_by_loops(text, items)


def test_a_common_opening_is_looked_up_once():
    """A thousand items with one opening, and texts that have it: memory by distinct windows."""
    import tracemalloc

    rng = random.Random(5)
    opening = " ".join(f"o{n}" for n in range(30))
    items = [(f"i{n:04}", f"{opening} {' '.join(f'x{rng.randrange(10**6)}' for _ in range(20))}") for n in range(1000)]
    suffixes = Suffixes(items)
    texts = [f"some text {n} {opening} and more of it" for n in range(300)]
    tracemalloc.start()
    found = suffixes.judge(texts)
    peak = tracemalloc.get_traced_memory()[1]
    tracemalloc.stop()
    assert all(f["longest"] == 30 and len(f["items"]) == 1000 for f in found)
    assert peak < 100e6


def test_blocks_of_items_one_pass_each(spark):
    rng = random.Random(6)
    vocabulary = [f"w{n}" for n in range(60)]
    items = [(n, " ".join(rng.choices(vocabulary, k=rng.choice([3, 14, 40])))) for n in range(40)]
    rows = [(n, " ".join(rng.choices(vocabulary, k=20)) + " " + rng.choice(items)[1], n) for n in range(60)]
    docs = spark.createDataFrame([*rows, (None, None, 0), (1, "", 1)], "doc_id long, text string, row int")
    tests = spark.createDataFrame(items, "item_id long, text string")
    one = with_matches(docs, tests)
    many = with_matches(docs, tests, block_bytes=900)
    assert many.columns == one.columns
    assert sorted(map(str, many.collect())) == sorted(map(str, one.collect()))
