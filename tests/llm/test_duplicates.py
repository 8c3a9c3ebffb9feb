import random
import re
import sys
from collections import Counter, defaultdict
from pathlib import Path

import pytest

sys.path.insert(0, str(Path(__file__).parent))

from llm_helpers import ODD_TEXTS, frame, prose, with_rows  # noqa: E402
from logloom.llm import line_templates, near_dedup, substrings  # noqa: E402
from logloom.llm.text import importable, lower_words_of, words_of  # noqa: E402


def _sets(texts):
    out = []
    for t in texts:
        w = lower_words_of(t)
        out.append({tuple(w[i : i + 5]) for i in range(max(1, len(w) - 4))} if w else set())
    return out


def _brute(texts):
    sets, parent = _sets(texts), list(range(len(texts)))

    def root(x):
        while parent[x] != x:
            x = parent[x]
        return x

    for j in range(len(sets)):
        for i in range(j):
            both = len(sets[i] & sets[j])
            if both and 100 * both >= 75 * (len(sets[i]) + len(sets[j]) - both):
                a, b = sorted((root(i), root(j)))
                parent[b] = a
    return {i: (len(s), root(i)) for i, s in enumerate(sets)}


def _copies(r, base, n, least, most):
    out = []
    for _ in range(n):
        words = base.split(" ")
        for _ in range(r.randint(least, most)):
            words[r.randrange(len(words))] = f"edit{r.randrange(10**6)}"
        out.append(" ".join(words))
    return out


def test_components_against_all_pairs(spark, monkeypatch):
    importable(spark)
    r = random.Random(5)
    passage = prose(99, 40)
    texts = [*ODD_TEXTS, "one", "ONE", "a b c", "a b c"]
    base = prose(1, 120)
    # Copies near the limit: most are linked to the base alone, which isn't their centre.
    texts += _copies(r, base, 60, 1, 9) + [base] + [base.upper()] * 3
    texts += [f"{prose(i, 60)} {passage}" for i in range(200, 240)]
    chain = prose(2, 100).split(" ")
    for i in range(12):
        chain = [*chain[4:], *(f"c{i}.{j}" for j in range(4))]
        texts.append(" ".join(chain))
    texts += [prose(i, r.randint(1, 80)) for i in range(300, 340)]
    monkeypatch.setattr(near_dedup, "BLOCK", 16)
    got = {x.doc_id: (x.n_shingles, x.component_id) for x in near_dedup.near_duplicates(frame(spark, texts)).collect()}
    assert got == _brute(texts)


def test_blocks_link_by_the_true_intersection():
    def member(i, text):
        return {"id": i, "class": i, "text": text, "signature": [0] * near_dedup.SLOTS}

    for seed in range(40):
        words = prose(seed, 304, 5000).split(" ")
        tail = prose(seed + 500, 304, 5000).split(" ")
        for kept in (256, 258, 260, 262, 264):
            a, b = " ".join(words), " ".join(words[:kept] + tail[kept:])
            x, y = (set(near_dedup.shingle_set(lower_words_of(t), near_dedup.SHINGLE).tolist()) for t in (a, b))
            want = [(2, 1)] if 100 * len(x & y) >= near_dedup.PERCENT * len(x | y) else []
            assert near_dedup._forest(0, [member(1, a)], [member(2, b)]) == want


def test_repeated_ids_null_ids_and_empty_tables(spark):
    importable(spark)
    df = with_rows(frame(spark, [prose(1, 30), prose(1, 30)]), (0, prose(1, 30)), (None, prose(1, 30)), (None, "x"))
    rows = near_dedup.near_duplicates(df).collect()
    assert sorted((str(r.doc_id), r.component_id, r.kept) for r in rows) == [
        ("0", 0, True), ("1", 0, False), ("None", None, True), ("None", None, True)]
    left = near_dedup.drop_near_duplicates(df)
    assert left.columns == df.columns and sorted(str(r.doc_id) for r in left.collect()) == ["0", "None", "None"]
    assert near_dedup.near_duplicates(df.where("doc_id < 0")).collect() == []


def _kept(texts, window):
    seen = Counter(tuple(w[i : i + window]) for t in texts for w in [words_of(t)] for i in range(len(w) - window + 1))
    out = []
    for t in texts:
        w = words_of(t)
        gone = [False] * len(w)
        for i in range(len(w) - window + 1):
            if seen[tuple(w[i : i + window])] > 1:
                gone[i : i + window] = [True] * window
        out.append((len(w), sum(gone), b" ".join(x for x, g in zip(w, gone) if not g).decode()))
    return out


def test_repeats_against_counting_all_windows(spark):
    importable(spark)
    r = random.Random(3)
    passages = [prose(i, n) for i, n in enumerate((34, 35, 36, 52, 90))]
    texts = [*ODD_TEXTS]
    for i in range(60):
        p = r.choice(passages).split(" ")
        cut = p[r.randrange(3) :]
        texts.append(" ".join([prose(i + 50, r.randrange(40)), *cut, prose(i + 500, r.randrange(40))]))
    texts += ["same " * 80, "same " * 36, "same " * 35, passages[4], f"{passages[3]} {passages[3]}"]
    got = {x.doc_id: (x.n_words, x.n_removed, x.kept_text) for x in substrings.remove_repeats(frame(spark, texts)).collect()}
    assert got == dict(enumerate(_kept(texts, 35)))
    short = {x.doc_id: x.n_removed for x in substrings.remove_repeats(frame(spark, texts), window=6).collect()}
    assert short == {i: k[1] for i, k in enumerate(_kept(texts, 6))}


def test_repeats_in_rows_of_one_id(spark):
    importable(spark)
    df = with_rows(frame(spark, [prose(1, 40), "b"]), (0, prose(1, 40)), (1, prose(2, 40)), (None, "c d"))
    rows = substrings.remove_repeats(df).collect()
    assert sorted((str(r.doc_id), r.n_words, r.n_removed) for r in rows) == [
        ("0", 40, 40), ("0", 40, 40), ("1", 1, 0), ("1", 40, 0), ("None", 2, 0)]
    assert substrings.remove_repeats(df.where("doc_id < 0")).collect() == []


def test_line_templates(spark):
    importable(spark)
    texts = [f"Posted by user{i} on day {i} of May\nbody {prose(i, 9)}\n\nSame closing line" for i in range(25)]
    df = with_rows(frame(spark, [*texts, None, "", "Posted by hand"]), (None, "Same closing line"))
    rows = defaultdict(list)
    for r in line_templates.drop_templates(df, least_documents=20).collect():
        rows[r.doc_id].append((r.n_lines, r.n_dropped, r.kept_text))
    assert rows[3] == [(4, 2, f"body {prose(3, 9)}\n")]
    assert rows[25] == rows[26] == [(1, 0, "")] and rows[27] == [(1, 0, "Posted by hand")] and rows[None] == [(1, 1, "")]
    found = {r.template: r.n_documents for r in line_templates.templates(df, 20).collect()}
    assert found == {"Posted by <*> on day <*> of May": 25, "Same closing line": 26}
    assert line_templates.drop_templates(df.where("doc_id < 0")).collect() == []


def _drop_lines(rows, least, copies, share):
    """Sorted (doc_id, n_lines, n_dropped, kept_text), by the rules and no tree."""
    docs = list(dict.fromkeys((i, t or "") for i, t in rows))
    mask = lambda line: " ".join("<*>" if re.search("[0-9]", x) else x for x in re.findall(r"[^\x20\x09-\x0D]+", line))
    lines = [(d, m) for d, (_, t) in enumerate(docs) for m in dict.fromkeys(map(mask, t.split("\n"))) if m]
    tokens = {m: m.split(" ") for _, m in lines}
    leaf = {m: (len(x), None, tuple(x[:3])) for m, x in tokens.items()}
    filled = Counter(leaf[m] for _, m in lines)
    wild = {m: [(len(x), i, (*x[:3][:i], *x[:3][i + 1 :])) for i in range(min(3, len(x))) if len(x) > 1] for m, x in tokens.items()}
    rare = [m for _, m in lines if filled[leaf[m]] < least]
    wilds = Counter(w for m in rare for w in wild[m])
    place = {}
    for m in tokens:
        if filled[leaf[m]] >= least:
            place[m] = leaf[m]
        elif best := [w for w in wild[m] if wilds[w] >= least]:
            place[m] = min(best, key=lambda w: (-wilds[w], w[1]))
    support = Counter((place[m], i, x) for _, m in lines if m in place for i, x in enumerate(tokens[m]))
    shape = {}
    for m, own in place.items():
        t = [x if support[own, i, x] >= least and x != "<*>" else "<*>" for i, x in enumerate(tokens[m])]
        if sum(x != "<*>" for x in t) >= share * len(t):
            shape[m] = " ".join(t)
    of = defaultdict(set)
    for d, m in lines:
        if m in shape:
            of[shape[m]].add(d)
    seen = Counter(m for _, m in lines)
    gone = {m for m in shape if len(of[shape[m]]) >= least} | {m for m, n in seen.items() if n >= copies and "<*>" not in tokens[m]}
    out = []
    for i, t in rows:
        own = (t or "").split("\n")
        kept = [x for x in own if mask(x) not in gone]
        out.append((i, len(own), len(own) - len(kept), "\n".join(kept)))
    return sorted(out, key=repr)


@pytest.mark.parametrize("seed", range(3))
def test_line_templates_against_the_rules(spark, seed):
    importable(spark)
    r = random.Random(seed)
    heads = ["alpha", "beta", "gamma", "x1"]
    lines = lambda: [" ".join([r.choice(heads), r.choice("abc"), r.choice(["of", f"n{r.randrange(30)}"]), *r.sample(["p", "q", "r", "s"], r.randrange(4))]) for _ in range(r.randrange(1, 8))]
    texts = ["\n".join(lines()) for _ in range(120)] + ["a\n\n a \n\tb\x0bc", *ODD_TEXTS, prose(seed, 20000, 50), "<*> a b", "<*> a b"]
    rows = [*enumerate(texts), (None, texts[0]), (3, texts[3]), (3, texts[3]), (4, texts[5])]
    df = with_rows(frame(spark, texts), *rows[len(texts) :])
    got = line_templates.drop_templates(df, least_documents=6, least_copies=2)
    assert sorted((tuple(x) for x in got.collect()), key=repr) == _drop_lines(rows, 6, 2, 0.5)


def test_lines_of_few_documents_and_of_names(spark):
    importable(spark)
    names = [f"{a}{b}{c}" for a in "klmn" for b in "aeiou" for c in "rst"]
    texts = [f"Posted by {n.capitalize()} on the news page today\n{prose(i, 9)}" for i, n in enumerate(names)]
    texts += [f"{prose(100 + i, 8)}\nThe same line, word for word, in each" for i in range(19)]
    texts += [f"{n} said it all again here\n{prose(300 + i, 7)}" for i, n in enumerate(names)]
    rows = {x.doc_id: (x.n_dropped, x.kept_text) for x in line_templates.drop_templates(frame(spark, texts)).collect()}
    assert all(n == 1 for n, _ in rows.values())
    assert rows[0][1] == prose(0, 9) and rows[len(names)][1] == prose(100, 8)
    found = {x.template: x.n_documents for x in line_templates.templates(frame(spark, texts)).collect()}
    assert found == {"Posted by <*> on the news page today": 60, "The same line, word for word, in each": 19, "<*> said it all again here": 60}


def test_rows_are_filtered_by_bitmap_and_joined_exactly(spark):
    rows = spark.range(5000).selectExpr("id", "xxhash64(id % 1000) AS a", "id % 7 AS b", "concat('line ', id) AS mask")
    names = rows.where("id < 40").select("a", "b").distinct()
    known = line_templates.bitmap(names.selectExpr("array(a, b) AS words"))
    assert 40 <= line_templates._by_bitmap(rows, known, ["a", "b"], True).count() < 1000
    for got, how in ((line_templates._with, "left_semi"), (line_templates._without, "left_anti")):
        want = rows.join(names, ["a", "b"], how).select(*rows.columns)
        assert sorted(got(rows, names, ["a", "b"]).collect()) == sorted(want.collect())
        none = names.where("false")
        assert got(rows, none, ["a", "b"]).count() == rows.join(none, ["a", "b"], how).count()


def test_line_templates_of_no_documents(spark):
    importable(spark)
    df = frame(spark, ["a b c"])
    assert line_templates.drop_templates(df.limit(0)).collect() == [] and line_templates.templates(df.limit(0)).collect() == []
