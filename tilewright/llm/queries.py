"""The queries of the training-data problems and their SQL."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from tilewright.llm import bpe, leaks, lookalike, top_n
from tilewright.runtime import table

#: path of the public vocabulary file
VOCABULARY = "/opt/tokenizers/byte_bpe_50k.json"


def p1_found(spark: SparkSession, d: str) -> DataFrame:
    best = top_n.top_n_per_group(table(spark, d, "intervals").where("zoomLevel is not null"), ["tileset", "zoomLevel"], "importance", "id", 10)
    return best.select("tileset", F.col("zoomLevel").alias("zoom_level"), "place", "id")


def p7_ids(spark: SparkSession, d: str) -> DataFrame:
    return bpe.encode_documents(table(spark, d, "documents"), VOCABULARY)


def _leaks(spark: SparkSession, d: str) -> DataFrame:
    return leaks.leaks(table(spark, d, "documents"), table(spark, d, "benchmark"))


def p8_found(spark: SparkSession, d: str) -> DataFrame:
    return _leaks(spark, d).where(F.col("run") >= F.least(F.lit(12), F.col("item_words"))).select("doc_id", "item_id")


def p8_alignments(spark: SparkSession, d: str) -> DataFrame:
    """Documents and items with a passage of which an alignment is 0.8 of a full match, edited and partial copies included."""
    found = leaks.alignments(table(spark, d, "documents"), table(spark, d, "benchmark"), 0.8)
    return found.select("doc_id", "item_id", "score", "passage_words", F.round("similarity", 6).alias("similarity"), "run")


def p9_found(spark: SparkSession, d: str) -> DataFrame:
    return lookalike.alike_pairs(table(spark, d, "documents"))


def p9_classes(spark: SparkSession, d: str) -> DataFrame:
    return lookalike.alike_classes_of(table(spark, d, "documents"))


QUERIES = {f.__name__: f for f in (p1_found, p7_ids, p8_found, p8_alignments, p9_found, p9_classes)}

# ---------------------------------------------------------------------------------------------- SQL


def _consistent(text: str) -> str:
    """SQL for the form of a text: single code points are translated, ligatures replaced, accents composed."""
    mapping = lookalike.representatives()
    single = {m: r for m, r in mapping.items() if len(r) == 1}
    for c in range(0xC0, 0x2000):  # letters with accents whose base letter is written differently
        ch, parts = chr(c), lookalike.apart(chr(c))
        spelled = "".join(single.get(p, p) for p in parts)
        if len(parts) > 1 and spelled != parts:
            composed = lookalike.unicodedata.normalize("NFC", spelled)
            if len(composed) == 1:
                single[ch] = composed
    gone = "".join(m for m, r in mapping.items() if not r)
    a, b = ("".join(x).replace("'", "''") for x in (single, single.values()))
    sql = f"translate(regexp_replace({text}, '[{gone}]', '', 'g'), '{a}', '{b}')"
    for m, r in mapping.items():
        if len(r) > 1 and "ﬀ" <= m <= "ﬆ":
            sql = f"replace({sql}, '{m}', '{r}')"
    return f"nfc_normalize({sql})"


def _uncased() -> str:
    """SQL for the words of a form without regard to case; letters with accents are mapped composed."""
    small = {chr(a): b for a, b in leaks.small_letters().items()}
    for c in range(0xC0, 0x2000):
        parts = lookalike.apart(chr(c))
        spelled = lookalike.unicodedata.normalize("NFC", "".join(small.get(p, p) for p in parts))
        if len(parts) > 1 and len(spelled) == 1 and spelled != chr(c):
            small[chr(c)] = spelled
    a, b = "".join(small), "".join(small.values())
    word = r"'[\p{L}\p{Nd}]+'"
    nu = r"CASE WHEN regexp_matches(lower(w), '\p{Greek}') THEN replace(lower(w), 'v', 'n') ELSE lower(w) END"
    return f"flatten(list_transform(regexp_extract_all(form, {word}), lambda w: regexp_extract_all(nfc_normalize(translate({nu}, '{a}', '{b}')), {word})))"


_WORDS = _uncased()

SQL = {
    "p1_found": """
SELECT tileset, zoomLevel AS zoom_level, place, id FROM (
  SELECT tileset, zoomLevel, id, CAST(row_number() OVER (PARTITION BY tileset, zoomLevel ORDER BY importance DESC, id) AS INTEGER) AS place
  FROM intervals WHERE zoomLevel IS NOT NULL AND importance IS NOT NULL AND NOT isnan(importance))
WHERE place <= 10""",
    "p8_found": f"""
WITH item AS (SELECT item_id, {_WORDS} AS w FROM (SELECT item_id, {_consistent('text')} AS form FROM benchmark)),
doc AS (SELECT doc_id, {_WORDS} AS w FROM (SELECT doc_id, {_consistent('text')} AS form FROM documents WHERE text IS NOT NULL)),
piece AS (
  SELECT DISTINCT item_id, k, array_to_string(w[i:i + k - 1], ' ') AS words
  FROM (SELECT item_id, w, k, unnest(range(1, len(w) - k + 2)) AS i FROM (SELECT item_id, w, least(12, len(w)) AS k FROM item WHERE len(w) > 0))),
passage AS (
  SELECT DISTINCT doc_id, k, array_to_string(w[i:i + k - 1], ' ') AS words
  FROM (SELECT doc_id, w, k, unnest(range(1, len(w) - k + 2)) AS i FROM doc, (SELECT DISTINCT k FROM piece) WHERE len(w) >= k))
SELECT DISTINCT doc_id, item_id FROM passage JOIN piece USING (k, words)""",
    "p9_found": f"""
WITH f AS (SELECT doc_id, text, {_consistent('text')} AS form FROM documents WHERE text IS NOT NULL)
SELECT a.doc_id AS doc_a, b.doc_id AS doc_b FROM f a JOIN f b ON a.form = b.form AND a.text <> b.text AND a.doc_id < b.doc_id
WHERE regexp_matches(a.form, '[^\\s\\p{{C}}]')""",
    "p9_classes": f"""
WITH f AS (SELECT doc_id, text, {_consistent('text')} AS form FROM documents WHERE text IS NOT NULL)
SELECT doc_id, min(doc_id) OVER (PARTITION BY form) AS class_id, n AS texts
FROM f JOIN (SELECT form, count(DISTINCT text) AS n FROM f GROUP BY form) USING (form) WHERE regexp_matches(form, '[^\\s\\p{{C}}]')""",
}
