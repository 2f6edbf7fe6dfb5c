import random

import numpy as np
import pytest

from tilewright.llm.leaks import Items, Pairs, align, alignments, item_blocks, leaks, least_score, passages, words, words_of
from tilewright.llm.lookalike import Rewriter, representatives


def plain_alignment(doc, item):
    best, h = 0, [[0] * (len(doc) + 1) for _ in range(len(item) + 1)]
    run, longest = [[0] * (len(doc) + 1) for _ in range(len(item) + 1)], 0
    for i, w in enumerate(item, 1):
        for j, v in enumerate(doc, 1):
            h[i][j] = max(0, h[i - 1][j - 1] + (2 if w == v else -1), h[i - 1][j] - 1, h[i][j - 1] - 1)
            run[i][j] = run[i - 1][j - 1] + 1 if w == v else 0
            best, longest = max(best, h[i][j]), max(longest, run[i][j])
    return best, longest


def test_alignment_equals_the_plain_table():
    rnd = random.Random(3)
    for _ in range(200):
        doc, item = ([rnd.randint(1, 4) for _ in range(rnd.randint(1, 25))] for _ in range(2))
        assert align(np.array(doc, np.int32), np.array(item, np.int32)) == plain_alignment(doc, item)


def contains(doc, item, k):
    return any(doc[j : j + k] == item[i : i + k] for i in range(len(item) - k + 1) for j in range(len(doc) - k + 1))


def test_against_brute_force(spark):
    rnd = random.Random(4)
    vocab = [f"w{i}" for i in range(12)]
    items = [(i, " ".join(rnd.choice(vocab) for _ in range(n))) for i, n in enumerate((1, 2, 4, 5, 6, 11, 12, 13, 20, 30))]
    items += [(90, None), (91, ""), (92, "!!"), (93, items[8][1])]
    docs = []
    for i in range(120):
        w = [rnd.choice(vocab) for _ in range(rnd.randint(0, 60))]
        if i % 3 == 0:
            src = rnd.choice(items[5:10])[1].split()
            at = rnd.randint(0, max(0, len(src) - 12))
            w[len(w) // 2 : len(w) // 2] = src[at : at + rnd.choice((11, 12, 14))]
        docs.append((i, "-- ".join(w).upper() if i % 2 else " ".join(w)))
    docs += [(500, None), (501, ""), (502, "ｗ１​" if False else items[9][1].replace("w", "ｗ")), (503, " ".join(vocab) * 300)]
    form = Rewriter(representatives()).form
    spelled = {i: words(form(t or "")) for i, t in items}
    want = sorted((d, i) for d, t in docs for i, w in spelled.items() if w and contains(words(form(t or "")), w, min(12, len(w))))
    got = leaks(spark.createDataFrame(docs, "doc_id long, text string"), spark.createDataFrame(items, "item_id long, text string"))
    found = sorted((r["doc_id"], r["item_id"]) for r in got.where("run >= least(12, item_words)").collect())
    assert found == want and len(want) > 40


def test_edited_copies_and_empty_tables(spark):
    item = " ".join(f"t{i}" for i in range(40))
    edited = item.replace("t20 ", "other ").replace("t30 ", "")
    docs = spark.createDataFrame([(1, "before " + edited + " after"), (2, "t1 t2 t3 unrelated")], "doc_id long, text string")
    bench = spark.createDataFrame([(7, item)], "item_id long, text string")
    (row,) = leaks(docs, bench).collect()
    assert row["doc_id"] == 1 and row["similarity"] > 0.9 and row["run"] == 20
    assert leaks(docs.where("false"), bench).collect() == [] and leaks(docs, bench.where("false")).collect() == []


def plain_passage(doc, item, low):
    """Every passage by the plain table, which is grown a word at a time from each start."""
    found = []
    for a in range(len(item) - low + 1):
        best, row = 0, [0] * (len(doc) + 1)
        for n, w in enumerate(item[a : a + 2 * low - 1], 1):
            new = [0]
            for j, v in enumerate(doc, 1):
                new.append(max(0, row[j - 1] + (2 if w == v else -1), row[j] - 1, new[j - 1] - 1))
            row, best = new, max(best, max(new))
            if n >= low:
                found.append((best / n, n, best))
    return max(found)


def test_passages_equal_the_plain_table():
    rnd = random.Random(6)
    for _ in range(60):
        doc, item = ([rnd.randint(1, 5) for _ in range(rnd.randint(4, 22))] for _ in range(2))
        low = min(rnd.randint(1, 6), len(item))
        score, n = passages(np.array(doc, np.int32), np.array(item, np.int32), low)
        assert (score / n, n, score) == plain_passage(doc, item, low)


def test_edited_copies_against_brute_force(spark):
    rnd = random.Random(5)
    vocab = [f"w{i}" for i in range(60)]
    items = [(i, " ".join(rnd.choice(vocab) for _ in range(n))) for i, n in enumerate((1, 2, 3, 4, 5, 6, 7, 8, 10, 13, 15, 20, 20, 35, 60))]
    items += [(90, None), (91, ""), (92, "w1 w1 w1 w1 w1 w1")]
    docs = []
    for i in range(250):
        copy = []
        for w in rnd.choice(items[:15])[1].split():
            kind = rnd.random() * 1.8 if i % 2 else rnd.random() + 0.07
            copy += [] if kind < 0.04 else ["other"] if kind < 0.1 else [w, "other"] if 1 < kind < 1.35 else [w]
        around = [[rnd.choice(vocab) for _ in range(rnd.randint(0, 30))] for _ in range(2)]
        docs.append((i, " ".join(around[0] + copy + around[1])))
    spread = items[11][1].split()  # the longest copy that may be missed: an insertion after every second word
    docs += [(500, None), (501, ""), (502, " ".join(w + " other" * (k % 2 and k < 16) for k, w in enumerate(spread)))]
    spaced = items[12][1].split()
    spaced[6] = spaced[13] = "other"  # the example of the review
    docs.append((503, " ".join(spaced)))
    half = items[14][1].split()[20:40]  # a partial copy with an edit in ten words
    half[5] = half[15] = "other"
    docs.append((504, " ".join(half)))
    want = []
    for d, t in docs:
        for i, u in items:
            if t and u:
                doc, item = words(t), words(u)
                held = set(doc)
                if sum(w in held for w in item) < 0.8 * min(12, len(item)):
                    continue  # too few equal words for any passage
                share, n, score = plain_passage(doc, item, min(12, len(item)))
                if share / 2 >= 0.8:
                    want.append((d, i, score, n, plain_alignment(doc, item)[1]))
    got = alignments(spark.createDataFrame(docs, "doc_id long, text string"), spark.createDataFrame(items, "item_id long, text string"))
    assert sorted((r["doc_id"], r["item_id"], r["score"], r["passage_words"], r["run"]) for r in got.collect()) == sorted(want)
    assert {(502, 11), (503, 12), (504, 14)} <= {w[:2] for w in want} and sum(w[1] > 6 and w[1] < 90 for w in want) > 60


def test_recall_of_edited_copies():
    """Whole and half copies of items of several lengths with one edit, or one in 20 or 10 words: nothing above the share is lost, and from 20 words on most are above."""
    rnd = random.Random(7)
    vocab = [f"w{i}" for i in range(400)]
    texts = [" ".join(rnd.choice(vocab) for _ in range(n)) for n in (5, 8, 10, 12, 13, 14, 20, 30, 45, 60) for _ in range(4)]
    items = Items.of([{"i": i, "t": t} for i, t in enumerate(texts)], 1)
    pairs = Pairs.of(items, 0.8, 12)
    share = {}
    for k, t in enumerate(texts):
        for edits in ("one", 0.05, 0.1):
            for half in (False, True)[: 1 + (len(t.split()) >= 30)]:
                src = t.split()
                src = src[: len(src) // 2] if half else src
                if edits == "one":
                    src[rnd.randrange(len(src))] = "other"
                else:
                    src = [x for w in src for x in ((w,) if rnd.random() > edits else rnd.choice(((), ("other",), (w, "other"))))]
                doc = items.code([rnd.choice(vocab) for _ in range(40)] + src + [rnd.choice(vocab) for _ in range(40)])
                score, n = passages(doc, items.coded[k], int(pairs.low[k]))
                found = k in dict(pairs.candidates(doc))
                assert found or score < least_score(n, 0.8)
                if len(t.split()) >= 20:
                    share.setdefault((edits, half), []).append(found and score >= least_score(n, 0.8))
    assert all(sum(v) / len(v) >= 0.9 for v in share.values()), {k: sum(v) / len(v) for k, v in share.items()}


def test_case_of_other_scripts():
    for a, b in (("В НАЧАЛЕ было Слово", "в начале БЫЛО слово"), ("Карта", "КАРТА"), ("ΝΑΙ, ΕΛΛΗΝΙΚΑ! Μέγας ΉΧΟΣ", "ναι, ελληνικα! ΜΈΓΑΣ ήχος"), ("ЃОРЃИ Йод", "ѓорѓи йОД"), ("TВIT", "tbit")):
        assert words_of(a) == words_of(b), (a, b)
    for a, b in (("é", "e"), ("nav", "van"), ("l", "i"), ("ß", "b"), ("д", "л")):
        assert words_of(a) != words_of(b), (a, b)


def test_any_number_of_items_and_any_ids(spark):
    items = [(f"i{k}", f"alpha{k} beta{k} gamma{k}") for k in range(40)] + [("again", "alpha3 beta3 gamma3"), ("again", "alpha3 beta3 gamma3"), (None, "x"), ("long", "y " * 500)]
    bench = spark.createDataFrame(items, "item_id string, text string")
    docs = spark.createDataFrame([(f"d{k}", f"so ALPHA{k} beta{k}, gamma{k}.") for k in range(0, 40, 3)] + [(None, "alpha1 beta1 gamma1")], "doc_id string, text string")
    blocks = list(item_blocks(bench, "item_id", "text", 7, 400))
    assert len(blocks) > 6 and all(len(b) <= 7 and sum(len(r["t"]) for r in b) <= 400 or len({r["t"] for r in b}) == 1 for b in blocks)
    assert sorted(r["i"] for b in blocks for r in b) == sorted(i for i, _ in items if i)
    want = sorted([(f"d{k}", f"i{k}") for k in range(0, 40, 3)] + [("d3", "again")] * 2)
    for found in (leaks(docs, bench, max_items=7), leaks(docs, bench), alignments(docs, bench, max_chars=400)):
        assert sorted((r["doc_id"], r["item_id"]) for r in found.where("run = 3").collect()) == want


def test_alignments_of_empty_tables_and_low_shares(spark):
    docs, bench = spark.createDataFrame([(1, "a b")], "doc_id long, text string"), spark.createDataFrame([(7, "a b")], "item_id long, text string")
    assert alignments(docs.where("false"), bench).collect() == [] and alignments(docs, bench.where("false")).collect() == []
    with pytest.raises(ValueError):
        alignments(docs, bench, share=0.7)
