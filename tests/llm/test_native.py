"""Line dedup, mixing, quality rules and decontamination on small tables and against plain Python."""

from __future__ import annotations

import hashlib
import re
from collections import Counter

import numpy as np
import pytest
from pyspark.sql import functions as F

from tablecraft.llm import decontaminate, line_dedup, mixing, quality_rules

LONG = "this line is long enough to count as a repeated one"


def test_line_dedup_keeps_the_largest_id_and_order(frame):
    rows = [(i, f"own {i}\n  {LONG.upper() if i % 2 else LONG}\t\nend") for i in range(5)] + [(9, None), (10, ""), (11, f"{LONG} \n{LONG}"), (None, LONG)]
    got = {r.doc_id: r for r in line_dedup.dedup_lines(frame(rows)).collect()}
    assert [got[i].kept_text for i in range(5)] == [f"own {i}\nend" for i in range(5)]
    assert (got[11].kept_text, got[11].n_dropped, got[11].n_lines) == (f"{LONG} \n{LONG}", 0, 2)
    assert (got[9].kept_text, got[9].n_lines) == ("", 1) and got[10].n_lines == 1
    assert got[None].kept_text == LONG and got[0].n_chars is not None


def test_line_dedup_counts_documents_not_rows(frame):
    same = [(1, LONG)] * 6
    assert {r.n_dropped for r in line_dedup.dedup_lines(frame(same)).collect()} == {0}
    four = [(i, LONG) for i in range(4)]
    assert {r.n_dropped for r in line_dedup.dedup_lines(frame(four)).collect()} == {0}
    all_gone = {r.doc_id: r.kept_text for r in line_dedup.dedup_lines(frame([(i, LONG) for i in range(5)])).collect()}
    assert all_gone == {0: "", 1: "", 2: "", 3: "", 4: LONG}


def test_line_dedup_of_nothing(frame):
    assert line_dedup.dedup_lines(frame([])).count() == 0


def test_mix_meets_targets_and_limits(frame):
    rng = np.random.default_rng(1)
    rows = [(i, "w " * int(rng.integers(1, 60)), None if i % 7 == 0 else f"s{i % 4}") for i in range(600)] + [(700, None, "s1"), (701, "", "empty"), (None, "a b c", "s2")]
    rows += [(702, "x y z", "s3")] * 3
    got = mixing.mix(frame(rows)).collect()
    assert len(got) == len(rows)
    by = Counter()
    for r in got:
        assert 0 <= r.taken <= 2 * r.size
        by[r.source] += r.taken
    target = {r.source: (r.target, r.source_size) for r in got}
    for s, (t, size) in target.items():
        assert abs(by[s] - t) < 1 and t <= 2 * size
    assert sum(t for t, _ in target.values()) == pytest.approx(1.5 * sum(n for _, n in target.values()))
    again = mixing.mix(frame(rows[::-1])).collect()
    assert Counter((r.doc_id, r.size, r.taken) for r in got) == Counter((r.doc_id, r.size, r.taken) for r in again)


def test_mixed_texts_give_the_words_taken(frame):
    rows = [(i, " ".join(f"w{i}_{k}" for k in range(i % 9 + 1)), f"s{i % 3}") for i in range(60)] + [(5, "w5_0 w5_1 w5_2 w5_3 w5_4 w5_5", "s2"), (80, None, None)]
    docs = frame(rows)
    taken = Counter()
    for r in mixing.mix(docs).collect():
        taken[r.doc_id] += r.taken
    mixed = mixing.mixed_texts(docs).orderBy("position").collect()
    words = Counter()
    position = 0
    for r in mixed:
        assert r.position == position and len(r.text.split()) == r.words
        position += r.words
        words[r.doc_id] += r.words
    assert words == Counter({k: v for k, v in taken.items() if v})
    assert mixing.mixed_texts(frame([])).count() == 0


def stats(t):
    t = t or ""
    w = re.findall(r"[^\x20\x09-\x0D]+", t)
    seen = Counter(tuple(w[i : i + 5]) for i in range(len(w) - 4))
    repeated = {p for i in range(len(w) - 4) if seen[tuple(w[i : i + 5])] > 1 for p in range(i, i + 5)}
    lines = [x for x in t.split("\n") if re.search(r"[^\x20\x09-\x0D]", x)]
    return len(w), sum(map(len, w)), len(re.findall(r"[#*$%&|<>]", t)), len(lines) - len(set(lines)), len(repeated)


def test_statistics_match_plain_python(docs, labels, texts):
    got = quality_rules.op7_quality_rules(docs, labels).collect()
    assert len(got) == len(texts)
    for r in got:
        n, chars, symbols, dup, repeat = stats(texts[r.doc_id])
        assert (r.n_words, r.word_chars, r.n_symbols, r.n_dup_lines, r.n_repeat_words) == (n, chars, symbols, dup, repeat)
        assert r.base_failed == (n < 10 or 100 * repeat > 20 * n) and not (r.base_failed and r.kept)


def test_rules_reject_junk_and_keep_clean_texts(docs, labels):
    joined = quality_rules.op7_quality_rules(docs, labels).join(labels, "doc_id").where("n_words >= 10").collect()
    assert np.mean([r.kept for r in joined if r.quality == 1]) > 0.95
    assert np.mean([not r.kept for r in joined if r.quality == 0]) > 0.9


def test_rules_on_odd_texts(frame, spark):
    rows = [(1, None), (2, ""), (3, " \n\t"), (4, "a b c d e f g h i j"), (5, "x " * 40_000), (5, "x " * 40_000), (None, "ä b\nä b\n\nä b " + "q w e r t z u i")]
    none = spark.createDataFrame([], "doc_id long, quality int")
    got = quality_rules.judge(frame(rows), quality_rules.learn_rules(frame(rows), none)).collect()
    assert len(got) == 7
    by = {r.doc_id: r for r in got}
    assert [by[i].kept for i in (1, 2, 3, 4, 5)] == [False, False, False, True, False]
    assert by[5].n_repeat_words == 40_000
    assert (by[None].n_words, by[None].n_dup_lines) == stats(rows[-1][1])[:1] + stats(rows[-1][1])[3:4]


def test_covering_learns_a_conjunction():
    rng = np.random.default_rng(0)
    x = {"a": rng.random(900), "b": rng.random(900)}
    bad = (x["a"] > 0.7) & (x["b"] <= 0.4)
    rules = quality_rules.learn(x, bad)
    picked = np.logical_or.reduce([np.logical_and.reduce([c.holds(x) for c in r]) for r in rules])
    assert picked[bad].mean() > 0.8 and picked[~bad].mean() < 0.03
    assert quality_rules.learn(x, np.zeros(900, bool)) == []


def plain(t):
    return re.findall(r"[^\x00-\x2F\x3A-\x60\x7B-\x7F]+", re.sub("[A-Z]", lambda m: m[0].lower(), t or ""))


def hits(docs, items):
    out = []
    for d, t in docs:
        w, hit, names = plain(t), set(), set()
        for item, s in items:
            v = plain(s)
            k = min(13, len(v))
            grams = {tuple(v[i : i + k]) for i in range(len(v) - k + 1)} if v else set()
            at = [i for i in range(len(w) - k + 1) if k and tuple(w[i : i + k]) in grams]
            hit |= {p for i in at for p in range(i, i + k)}
            if at and item is not None:
                names.add(str(item))
        out.append((d, len(w), len(hit), len(names), hashlib.sha256(",".join(sorted(names)).encode()).hexdigest(), bool(hit) and 20 * len(hit) >= len(w)))
    return sorted(out, key=str)


def test_decontamination_matches_plain_python(frame, spark):
    rng = np.random.default_rng(3)
    word = lambda: f"w{int(rng.integers(400))}"
    items = [(i, " ".join(word() for _ in range(int(rng.integers(13, 40))))) for i in range(20)] + [(20, "Tiny Item"), (21, None), (22, "..."), (23, "one two three four five six"), (23, "one two three four five six"), (None, "nameless thing here")]
    docs = [(i, " ".join(word() for _ in range(80)) + " " + " ".join(items[i % 20][1].split()[: 9 + i % 9]) + (" TINY, item" if i % 5 == 0 else "")) for i in range(60)]
    docs += [(90, None), (91, ""), (92, "tiny item"), (93, items[3][1]), (93, items[3][1]), (94, "nameless-thing here and more"), (None, items[4][1]), (95, "x one two three four five six y " * 300)]
    bench = spark.createDataFrame(items, "item_id long, text string")
    got = sorted((tuple(r) for r in decontaminate.op9_decontamination(frame(docs), bench).collect()), key=str)
    assert got == hits(docs, items)
    assert decontaminate.op9_decontamination(frame(docs), bench.where("false")).agg(F.sum("n_hit")).first()[0] == 0
    assert decontaminate.op9_decontamination(frame([]), bench).count() == 0


def test_mixed_texts_repeat_as_often_as_asked(frame):
    docs = frame([(i, " ".join(f"w{k}" for k in range(1 + i % 5)), "ab"[i % 2]) for i in range(40)])
    options = {"weights": (9, 1), "budget": 2.0, "repeats": 4}
    taken = {r.doc_id: r.taken for r in mixing.mix(docs, **options).collect()}
    got = {}
    for r in mixing.mixed_texts(docs, **options).collect():
        assert len(r.text.split()) == r.words
        got[r.doc_id] = got.get(r.doc_id, 0) + r.words
    assert max(taken[i] / (1 + i % 5) for i in taken) > 2 and got == {k: v for k, v in taken.items() if v}
