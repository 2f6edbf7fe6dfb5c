import unicodedata

from tilewright.llm.lookalike import Rewriter, UnionFind, alike_classes_of, alike_pairs, representatives, visible, with_forms

FORM = Rewriter(representatives()).form


def test_same_looks_same_form():
    for a, b in (("ｆｉｎｅ １２", "fine 12"), ("ﬁne", "fine"), ("ﬃ", "ｆfi"), ("café", "café"), ("саfе́", "café"), ("a​b­c", "abc"), ("a b　c", "a b c"),
                 ("ΑΒ Ο", "AB O"), ("e‍́", "é"), ("ё", "ë"), ("ｶﾞ", "ガ"), ("ộ", "ộ")):
        assert FORM(a) == FORM(b), (a, b)


def test_visible_differences_stay():
    for a, b in (("A", "a"), ("e", "é"), ("1", "l"), ("a b", "a  b"), ("a\r\nb", "a\nb"), ("a\tb", "a b"), ("0", "O"), ("2", "²")):
        assert FORM(a) != FORM(b), (a, b)


def test_form_is_a_fixed_point_and_total():
    texts = ["", " ", "​", "x" * 100_000 + "ﬁ", "".join(chr(c) for c in range(0x20, 0x3100)), "́", "👨‍🔬"]
    for t in texts:
        assert FORM(FORM(t)) == FORM(t)
        assert unicodedata.is_normalized("NFC", FORM(t))


def test_union_find_is_transitive():
    uf = UnionFind()
    for a, b in (("a", "b"), ("c", "d"), ("b", "c"), ("x", "y")):
        uf.union(a, b)
    assert sorted(uf.classes()) == [["a", "b", "c", "d"], ["x", "y"]]


def test_representative_by_frequency():
    most = representatives({"а": 10, "a": 3})
    assert most["a"] == "а" and Rewriter(most).form("banana") == Rewriter(most).form("bаnаnа")
    assert representatives()["а"] == "a"


def test_pairs_against_brute_force(spark):
    texts = ["abc", "аbc", "abc", "ａbc", "", None, "​", " ", " ", "fi", "ﬁ", "FI", "abc\n", "x" * 5000 + "é", "x" * 5000 + "é"]
    df = spark.createDataFrame([(i, t, 0) for i, t in enumerate(texts)] + [(None, "аbc", 0)], "doc_id long, text string, form int")
    got = sorted(map(tuple, alike_pairs(df, salts=3).collect()))
    brute = [(i, j) for i, a in enumerate(texts) for j, b in enumerate(texts) if i < j and a and b and a != b and FORM(a) == FORM(b) and visible(FORM(a))]
    assert got == brute and len(got) == len(set(got)) == 7
    classes = {r["doc_id"]: (r["class_id"], r["texts"]) for r in alike_classes_of(df).collect()}
    assert classes[2] == (0, 3) and classes[10] == (9, 2) and classes[11] == (11, 1) and 4 not in classes
    assert alike_pairs(df.where("false")).collect() == []
    forms = {r["doc_id"]: r["form"] for r in with_forms(df).collect()}
    assert forms[5] is None and forms[4] == "" and forms[10] == "fi"


def test_form_with_many_spellings(spark):
    """One form holds nearly all texts, so its key is spread."""
    from itertools import product

    texts = ["".join(p) for p in product("aа", "eе", "oо", "pр", "cс")]
    df = spark.createDataFrame(list(enumerate(texts)) + [(100, "other")], "doc_id long, text string")
    got = sorted(map(tuple, alike_pairs(df, salts=4).collect()))
    assert got == [(i, j) for i in range(32) for j in range(i + 1, 32)]
    assert {(r["class_id"], r["texts"]) for r in alike_classes_of(df).collect()} == {(0, 32), (100, 1)}
