"""One consistent form for texts that look the same.

Strings and code points that look alike are joined to transitive classes by union-find. The representative of a class is
its most frequent member in the corpus, except that a class with a longer string (``fi`` and its ligature) or with the
empty string (characters without width) is always written as that string, because only then is greedy rewriting
independent of order. A multi-pattern automaton rewrites texts; accents are separated before and composed after.
"""

from __future__ import annotations

import unicodedata
from collections import defaultdict
from collections.abc import Iterable, Iterator

import ahocorasick
import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from tilewright.operators.skew import salted_join
from tilewright.runtime import Cut

# Letters of Latin, Greek and Cyrillic with the same shape, one class a word.
SAME_SHAPE = """
AАΑ BВΒꞴ CСϹ EЕΕ FϜ GԌ HНΗ IІΙӀƖ JЈͿ KКΚ MМΜϺ NΝ OОΟ PРΡ QԚ SЅ TТΤ VѴ WԜ XХΧꞳ YΥҮУ ZΖ
aа cсϲᴄ dԁ eе gɡ hһ iі jјϳ lӏ oоοᴏ pрρ qԛ sѕꜱ vνѵᴠ wԝᴡ xх yу zᴢ
ГΓ ПΠ ФΦ кκᴋ µμ ÆӔ æӕ ƏӘ əәǝ ƟӨ ɵө ƷӠ ʒӡ ƐԐ ɛԑ ƆϽ ɔͻ ιɩ χꭓ βꞵ вʙ нʜ мᴍ тᴛ гᴦ пᴨ
"""

# Code points without width (first and last of each range).
NO_WIDTH = (
    (0x00AD, 0x00AD), (0x034F, 0x034F), (0x061C, 0x061C), (0x17B4, 0x17B5), (0x180B, 0x180F), (0x200B, 0x200F), (0x202A, 0x202E),
    (0x2060, 0x206F), (0xFE00, 0xFE0F), (0xFEFF, 0xFEFF), (0xFFF0, 0xFFF8), (0x1BCA0, 0x1BCA3), (0x1D173, 0x1D17A), (0xE0001, 0xE0001), (0xE0020, 0xE007F), (0xE0100, 0xE01EF),
)


class UnionFind:
    def __init__(self) -> None:
        self.parent: dict[str, str] = {}

    def find(self, x: str) -> str:
        self.parent.setdefault(x, x)
        while self.parent[x] != x:
            self.parent[x] = self.parent[self.parent[x]]
            x = self.parent[x]
        return x

    def union(self, a: str, b: str) -> None:
        a, b = self.find(a), self.find(b)
        if a != b:
            self.parent[max(a, b)] = min(a, b)

    def classes(self) -> list[list[str]]:
        groups: dict[str, list[str]] = defaultdict(list)
        for x in self.parent:
            groups[self.find(x)].append(x)
        return [sorted(g) for g in groups.values()]


def apart(text: str) -> str:
    """With accents separated and in canonical order."""
    return unicodedata.normalize("NFD", text)


def relations() -> Iterator[tuple[str, str]]:
    """Pairs of strings that look the same, all with separated accents: widths, ligatures, blanks, no width, same shape."""
    for lo, hi in NO_WIDTH:
        for c in range(lo, hi + 1):
            yield chr(c), ""
    for c in range(0x80, 0x20000):
        ch = chr(c)
        kind, _, codes = unicodedata.decomposition(ch).partition(" ")
        if unicodedata.category(ch) == "Zs":
            yield ch, " "
        elif kind in ("<wide>", "<narrow>") or kind == "<compat>" and "LIGATURE" in unicodedata.name(ch, ""):
            yield ch, apart("".join(chr(int(x, 16)) for x in codes.split()))
    for word in SAME_SHAPE.split():
        for other in word[1:]:
            yield word[0], other


def alike_classes() -> list[list[str]]:
    """The classes, each sorted; members are strings, mostly of one code point. Their number is fixed by Unicode."""
    uf = UnionFind()
    for a, b in relations():
        a, b = apart(a), apart(b)
        if a != b:
            uf.union(a, b)
    return uf.classes()


def representatives(counts: dict[str, int] | None = None) -> dict[str, str]:
    """What each class member is written as, members that stay themselves left out.

    ``counts``: occurrences in the corpus; without them, and among equals, the smallest code point wins, which is the Latin letter.
    """
    counts = counts or {}
    out: dict[str, str] = {}
    strings: list[tuple[list[str], str]] = []
    for members in alike_classes():
        if "" in members:
            best = ""
        elif any(len(m) > 1 for m in members):
            strings.append((members, min((m for m in members if len(m) > 1))))
            continue
        else:
            best = min(members, key=lambda m: (-counts.get(m, 0), m))
        out |= {m: best for m in members if m != best}
    for members, spelled in strings:
        spelled = "".join(out.get(c, c) for c in spelled)
        out |= {m: spelled for m in members if len(m) == 1}
    return out


class Rewriter:
    """Brings texts to the form in which look-alike texts are equal.

    The automaton reads UTF-8 bytes, so that none of its states has more than a few dozen ways on.
    """

    def __init__(self, mapping: dict[str, str]):
        self.automaton = ahocorasick.Automaton()
        for member, best in mapping.items():
            key = member.encode().decode("latin-1")
            self.automaton.add_word(key, (len(key), best.encode()))
        self.automaton.make_automaton()
        self.plain_ascii = not any(m.isascii() for m in mapping)

    def form(self, text: str) -> str:
        """Any string, also an empty or a very long one; the result is a fixed point."""
        if self.plain_ascii and text.isascii():
            return text
        text = apart(text)
        raw = text.encode()
        out, at = [], 0
        for end, (size, best) in self.automaton.iter_long(raw.decode("latin-1")):
            out += (raw[at : end + 1 - size], best)
            at = end + 1
        if at:
            out.append(raw[at:])
            text = b"".join(out).decode()
        return unicodedata.normalize("NFC", text)


def member_counts(df: DataFrame, text: str) -> dict[str, int]:
    """Occurrences of every class member over all texts, counted per task and summed; one row per member at most."""
    members = sorted({ord(m) for c in alike_classes() for m in c if len(m) == 1})

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        total = np.zeros(len(members), np.int64)
        for batch in batches:
            # a line break between texts keeps an accent at the start of one from joining the one before
            points = np.frombuffer(apart("\n".join(t for t in batch.column(0).to_pylist() if t)).encode("utf-32-le"), np.uint32)
            total += np.bincount(points, minlength=members[-1] + 1)[members]
        seen = np.flatnonzero(total)
        yield pa.RecordBatch.from_pydict({"member": pa.array([chr(members[i]) for i in seen], pa.string()), "n": pa.array(total[seen], pa.int64())})

    rows = df.select(F.col(text).alias("text")).mapInArrow(run, "member string, n bigint").groupBy("member").agg(F.sum("n").alias("n"))
    return {r["member"]: r["n"] for r in rows.collect()}


def visible(form: str) -> bool:
    """Whether a text (in its form) has anything to see."""
    return any(not c.isspace() and unicodedata.category(c) not in ("Cc", "Cf") for c in form)


def with_forms(df: DataFrame, doc_id: str = "doc_id", text: str = "text", mapping: dict[str, str] | None = None) -> DataFrame:
    """(doc_id, form): the consistent form of each text; null stays null, empty stays empty. ``mapping`` by default
    from the frequencies of this corpus (one more pass over it)."""
    mapping = representatives(member_counts(df, text)) if mapping is None else mapping

    def run(batches: Iterable[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        rewrite = Rewriter(mapping).form
        for batch in batches:
            forms = [None if t is None else rewrite(t) for t in batch.column(1).to_pylist()]
            yield pa.RecordBatch.from_arrays([batch.column(0), pa.array(forms, pa.string())], names=["doc_id", "form"])

    return df.select(F.col(doc_id).alias("doc_id"), F.col(text).alias("text")).mapInArrow(run, f"doc_id {dict(df.dtypes)[doc_id]}, form string")


def _digests(df: DataFrame, doc_id: str, text: str) -> DataFrame:
    """(doc_id, _form, _text): 256-bit digests of the form and of the text itself, texts without anything visible left out."""
    mapping = representatives(member_counts(df, text))

    def run(batches: Iterable[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        from hashlib import sha256

        rewrite = Rewriter(mapping).form
        for batch in batches:
            ids, forms, texts = [], [], []
            for i, t in zip(batch.column(0).to_pylist(), batch.column(1).to_pylist()):
                if i is None or not t:
                    continue
                form = rewrite(t)
                if visible(form):
                    ids.append(i)
                    forms.append(sha256(form.encode()).digest())
                    texts.append(sha256(t.encode()).digest())
            yield pa.RecordBatch.from_pydict({"doc_id": pa.array(ids, batch.schema.field(0).type), "_form": pa.array(forms, pa.binary()), "_text": pa.array(texts, pa.binary())})

    return df.select(F.col(doc_id).alias("doc_id"), F.col(text).alias("text")).mapInArrow(run, f"doc_id {dict(df.dtypes)[doc_id]}, _form binary, _text binary")


def alike_pairs(df: DataFrame, doc_id: str = "doc_id", text: str = "text", salts: int = 16) -> DataFrame:
    """(doc_a, doc_b), doc_a < doc_b: documents whose texts differ as strings and look the same.

    Null, empty and blank texts and null ids are no cases. Exact copies of a text are grouped first, and only different
    texts of one form are paired, so copies of each other never meet; each copy is then linked to each text
    it differs from, which is the result itself. The documents of a text are spread over ``salts`` tasks. An empty table
    gives no rows.
    """
    docs = Cut(_digests(df, doc_id, text), "forms").df
    variants = docs.groupBy("_form", "_text").agg(F.count(F.lit(1)).alias("_n"))
    several = variants.groupBy("_form").agg(F.count(F.lit(1)).alias("_texts")).where("_texts > 1").select("_form")
    # few texts have a look-alike, so what is left is written and its frequent forms, those of many spellings, are spread
    variants = Cut(variants.join(several, "_form"), "variants").df
    other = variants.select("_form", F.col("_text").alias("_other"), F.col("_n").alias("_m"))
    # the text with more copies comes first: its documents are spread over the salts, those of the other go to each salt
    pairs = salted_join(variants, other, ["_form"], salts=salts).where("_n > _m or _n = _m and _text < _other").select("_text", "_other")
    each = F.explode(F.sequence(F.lit(0), F.lit(salts - 1)))
    members = docs.select("_text", F.col("doc_id").alias("_a"), F.pmod(F.xxhash64("doc_id"), F.lit(salts)).cast("int").alias("_salt"))
    left = members.join(pairs.withColumn("_salt", each), ["_text", "_salt"]).select("_other", "_salt", "_a")
    few = docs.select(F.col("_text").alias("_other"), F.col("doc_id").alias("_b")).join(pairs.select("_other").distinct(), "_other")
    both = left.join(few.withColumn("_salt", each), ["_other", "_salt"])
    return both.select(F.least("_a", "_b").alias("doc_a"), F.greatest("_a", "_b").alias("doc_b")).distinct()


def alike_classes_of(df: DataFrame, doc_id: str = "doc_id", text: str = "text") -> DataFrame:
    """(doc_id, class_id, texts): one row per document with something visible; ``class_id`` is the smallest id of the documents
    that look like it, ``texts`` the number of different texts among them."""
    docs = Cut(_digests(df, doc_id, text), "forms").df
    texts = docs.groupBy("_form", "_text").agg(F.min("doc_id").alias("_least"))
    classes = texts.groupBy("_form").agg(F.min("_least").alias("class_id"), F.count(F.lit(1)).alias("texts"))
    return salted_join(docs, classes, ["_form"]).select("doc_id", "class_id", "texts")
