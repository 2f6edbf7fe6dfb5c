"""CIGAR, MD and difference strings of aligned reads, and pairwise alignment."""

from __future__ import annotations

import re
from collections.abc import Iterator

import numpy as np
import pandas as pd
from pyspark.sql import Column
from pyspark.sql import functions as F
from pyspark.sql import types as T

#: types are spelled out, as workers that import this module have no session to parse them
VARIANTS = T.ArrayType(T.StructType([T.StructField(n, T.IntegerType()) for n in ("query_pos", "ref_pos")] + [T.StructField(n, T.StringType()) for n in ("base", "ref")]))

_OP = r"([0-9]+)([A-Z=])"


def cigar_ops(cigar: Column) -> Column:
    """array<struct<op, len>>; empty for null and empty strings."""
    text = F.coalesce(cigar, F.lit(""))
    lengths = F.regexp_extract_all(text, F.lit(_OP), F.lit(1))
    ops = F.regexp_extract_all(text, F.lit(_OP), F.lit(2))
    return F.transform(F.arrays_zip(ops.alias("op"), lengths.alias("len")), lambda s: F.struct(s["op"].alias("op"), s["len"].cast("int").alias("len")))


def cigar_substitutions(start: Column, span: Column, ops: Column) -> Column:
    """array<struct<pos, op, len>> of the differences of a read that begins at ``start`` and covers ``span`` bases.

    X, D and N stand where they begin, I where it is inserted. A clip at the front begins before the read; at the back a
    soft clip stands one base behind the read's end, a hard clip at the end.
    """
    kind = "array<struct<pos:bigint,op:string,len:int>>"
    state = F.struct(F.lit(0).cast("bigint").alias("at"), F.array().cast(kind).alias("out"))

    def step(acc, o):
        moves = o["op"].isin("X", "D", "N", "M", "=")
        shows = o["op"].isin("X", "I", "D", "N")
        new = F.array(F.struct((start + acc["at"]).cast("bigint").alias("pos"), o["op"].alias("op"), o["len"].alias("len")))
        return F.struct(
            (acc["at"] + F.when(moves, o["len"]).otherwise(F.lit(0))).alias("at"), F.when(shows, F.concat(acc["out"], new)).otherwise(acc["out"]).alias("out")
        )

    inner = F.aggregate(ops, state, step, lambda acc: acc["out"])
    first, last = F.get(ops, F.lit(0)), F.get(ops, F.size(ops) - 1)

    def clip(o, pos):
        one = F.array(F.struct(pos.cast("bigint").alias("pos"), o["op"].alias("op"), o["len"].alias("len")))
        return F.when(o["op"].isin("S", "H"), one).otherwise(F.array().cast(kind))

    end = start + span
    return F.concat(inner, clip(first, start - first["len"]), clip(last, F.when(last["op"] == "S", end + 1).otherwise(end)))


def covered_spans(start: Column, ops: Column) -> Column:
    """array<struct<op, lo, hi>> of what each operation covers of the reference; insertions and clips cover one base."""
    kind = "array<struct<op:string,lo:bigint,hi:bigint>>"

    def step(acc, o):
        width = F.when(o["op"].isin("M", "=", "X", "D", "N"), o["len"]).otherwise(F.lit(0))
        new = F.array(F.struct(o["op"].alias("op"), acc["at"].alias("lo"), (acc["at"] + F.greatest(width, F.lit(1))).alias("hi")))
        return F.struct((acc["at"] + width).alias("at"), F.concat(acc["out"], new).alias("out"))

    return F.aggregate(ops, F.struct(start.cast("bigint").alias("at"), F.array().cast(kind).alias("out")), step, lambda acc: acc["out"])


def rebuild_reference(seq: str, md: str, cigar: str) -> tuple[str, str]:
    """The aligned (reference, read) of a read: ``-`` in the reference is an insertion, in the read a deletion."""
    ref: list[str] = []
    read: list[str] = []
    at = 0
    for length, op in re.findall(_OP, cigar):
        n = int(length)
        taken = seq[at : at + n]
        if op in "M=X":
            ref += taken
            read += taken
        elif op == "I":
            ref += "-" * len(taken)
            read += taken
        elif op == "D":
            ref += "N" * n
            read += "-" * n
        if op in "M=XIS":
            at += n
    # MD walks over reference bases only, so insertions are stepped over
    places = [i for i, c in enumerate(ref) if c != "-"]
    k = 0
    for run, deleted, base in re.findall(r"([0-9]+)|\^([A-Za-z]+)|([A-Za-z])", md):
        if run:
            k += int(run)
        for c in deleted or base:
            if k < len(places):
                ref[places[k]] = c
            k += 1
    return "".join(ref), "".join(read)


def mismatches(ref: str, read: str) -> list[tuple[int, int, str, str]]:
    """(read position, reference position, read base, reference base) of every mismatch; gaps do not count."""
    if len(ref) != len(read):
        raise ValueError("aligned strings must be equally long")
    out, i, j = [], 0, 0
    for r, q in zip(ref, read):
        if r != "-" and q != "-" and r != q:
            out.append((i, j, q, r))
        i += q != "-"
        j += r != "-"
    return out


@F.pandas_udf(VARIANTS)
def md_variants(seq: pd.Series, md: pd.Series, cigar: pd.Series) -> pd.Series:
    """Mismatches of reads with an MD tag; none without one."""
    return pd.Series(
        [[dict(zip(("query_pos", "ref_pos", "base", "ref"), v)) for v in mismatches(*rebuild_reference(s, m, c))] if s and m and c else [] for s, m, c in zip(seq, md, cigar)]
    )


_SUBS = "array<struct<pos:int,length:int,type:string,base:string,variant:string>>"


def _sub(pos: Column, length: Column | int, kind: str, base: Column | None = None, variant: Column | None = None) -> Column:
    text = lambda c: F.lit(None).cast("string") if c is None else c
    length = F.lit(length) if isinstance(length, int) else length
    return F.struct(pos.cast("int").alias("pos"), length.cast("int").alias("length"), F.lit(kind).alias("type"), text(base).alias("base"), text(variant).alias("variant"))


def extended_cigar_substitutions(cigar: Column, ref: Column, query: Column) -> Column:
    """Array of substitutions of an alignment given with ``=``, X, I and D, positions from 0 on the reference.

    An X is one substitution a base, and only where both sequences have a base; other letters of the text are no operations.
    Null or empty texts give an empty array.
    """
    text = F.coalesce(cigar, F.lit(""))
    part = r"([0-9]+)([=XID])"
    ops = F.arrays_zip(F.regexp_extract_all(text, F.lit(part), F.lit(2)).alias("op"), F.regexp_extract_all(text, F.lit(part), F.lit(1)).alias("n"))
    start = F.struct(F.lit(0).alias("i"), F.lit(0).alias("j"), F.array().cast(_SUBS).alias("out"))

    def step(acc, o):
        n, op = o["n"].cast("int"), o["op"]
        known = F.least(n, F.length(ref) - acc["i"], F.length(query) - acc["j"])
        letter = lambda s, at: F.substr(s, at + 1, F.lit(1))
        each = F.transform(F.when(known > 0, F.sequence(F.lit(0), known - 1)).otherwise(F.array().cast("array<int>")), lambda k: _sub(acc["i"] + k, 1, "X", letter(ref, acc["i"] + k), letter(query, acc["j"] + k)))
        new = F.when(op == "X", each).when(op == "I", F.array(_sub(acc["i"], n, "I"))).when(op == "D", F.array(_sub(acc["i"], n, "D"))).otherwise(F.array().cast(_SUBS))
        return F.struct((acc["i"] + F.when(op != "I", n).otherwise(0)).alias("i"), (acc["j"] + F.when(op != "D", n).otherwise(0)).alias("j"), F.concat(acc["out"], new).alias("out"))

    return F.aggregate(ops, start, step, lambda acc: acc["out"])


def difference_string_substitutions(cs: Column, lead_clip: Column, tail_clip: Column, seq: Column) -> Column:
    """Array of substitutions of a ``:n*ab+ins-del`` difference string, positions from 0 on the reference.

    Soft clips of the read (0 or null for none) stand before its first and behind its last base. A null text has only the clips.
    """
    tokens = F.regexp_extract_all(F.coalesce(cs, F.lit("")), F.lit(r"(:[0-9]+|\*[a-z][a-z]|\+[a-z]+|-[a-z]+)"), F.lit(1))
    start = F.struct(F.lit(0).alias("at"), F.array().cast(_SUBS).alias("out"))

    def step(acc, t):
        kind, rest = F.substr(t, F.lit(1), F.lit(1)), F.upper(F.substr(t, F.lit(2)))
        n, none = F.length(rest), F.lit("")
        moved = F.when(kind == ":", rest.try_cast("int")).when(kind == "*", 1).when(kind == "-", n).otherwise(0)
        new = F.when(kind == "*", F.array(_sub(acc["at"], 1, "X", F.substr(rest, F.lit(1), F.lit(1)), F.substr(rest, F.lit(2), F.lit(1)))))
        new = new.when(kind == "+", F.array(_sub(acc["at"], n, "I", none, rest))).when(kind == "-", F.array(_sub(acc["at"], n, "D", rest, none)))
        return F.struct((acc["at"] + moved).alias("at"), F.concat(acc["out"], new.otherwise(F.array().cast(_SUBS))).alias("out"))

    walked = F.aggregate(tokens, start, step)
    clip = lambda n, pos, part: F.when(n > 0, F.array(_sub(pos, n, "S", None, part))).otherwise(F.array().cast(_SUBS))
    return F.concat(clip(lead_clip, -lead_clip, F.substr(seq, F.lit(1), lead_clip)), walked["out"], clip(tail_clip, walked["at"], F.right(seq, tail_clip)))


def global_alignment(a: str, b: str, match: float = 1, mismatch: float = -4, gap_open: float = -6, gap_extend: float = -1) -> tuple[float, str, str]:
    """(score, aligned a, aligned b) with affine gaps: a gap of n costs open + (n - 1) * extend."""
    return global_alignments([a], [b], match, mismatch, gap_open, gap_extend)[0]


def global_alignments(a: list[str], b: list[str], match: float = 1, mismatch: float = -4, gap_open: float = -6, gap_extend: float = -1, cells: int = 2_000_000) -> list[tuple[float, str, str]]:
    """``global_alignment`` of many pairs, whose tables are filled side by side along the anti-diagonals; ``cells`` bounds the tables held at once.

    Each cell keeps from which of the layers (both, gap in b, gap in a) its three scores came, the first of equals.
    """
    out: list = [None] * len(a)
    order = sorted(range(len(a)), key=lambda i: (len(a[i]) + 1) * (len(b[i]) + 1))
    while order:
        n, m = max(len(a[i]) for i in order), max(len(b[i]) for i in order)
        take = max(1, cells // ((n + 1) * (m + 1)))
        part, order = order[-take:], order[:-take]
        for i, found in zip(part, _aligned([a[i] for i in part], [b[i] for i in part], match, mismatch, gap_open, gap_extend)):
            out[i] = found
    return out


def _first_best(s0: np.ndarray, s1: np.ndarray, s2: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    """The greatest of three scores, and which it is, the first of equals."""
    k = (s1 > s0).view(np.int8)
    top = np.maximum(s0, s1)
    k[s2 > top] = 2
    return np.maximum(top, s2), k


def _aligned(a: list[str], b: list[str], match: float, mismatch: float, gap_open: float, gap_extend: float) -> list[tuple[float, str, str]]:
    x, y = _padded(a), _padded(b)
    (n, count), m = x.shape, y.shape[0]
    none = np.full((n + 1, count), -np.inf, np.float32)  # whole scores stay exact below 2^24
    back = np.zeros((n + m + 1, 3, n + 1, count), np.int8)
    ends = np.full((3, count), -np.inf)
    sizes = np.array([len(t) for t in a]), np.array([len(t) for t in b])
    before = last = [none] * 3
    for d in range(n + m + 1):  # cells (i, d - i), by their i
        now = [none.copy() for _ in range(3)]
        lo, hi = max(0, d - m), min(n, d)
        if d == 0:
            now[0][0] = 0
        inner = slice(max(1, lo), min(n, d - 1) + 1)
        if inner.start < inner.stop:
            prev = slice(inner.start - 1, inner.stop - 1)
            same = x[prev] == y[d - 2 - np.arange(prev.start, prev.stop)]
            top, back[d, 0, inner] = _first_best(*(layer[prev] for layer in before))
            now[0][inner] = top + np.where(same, np.float32(match), np.float32(mismatch))
        for layer, own, prev in ((1, slice(max(1, lo), hi + 1), slice(max(1, lo) - 1, hi)), (2, slice(lo, min(hi, d - 1) + 1), slice(lo, min(hi, d - 1) + 1))):
            if d and own.start < own.stop:
                now[layer][own], back[d, layer, own] = _first_best(*(last[j][prev] + np.float32(gap_extend if j == layer else gap_open) for j in range(3)))
        done = np.flatnonzero(sizes[0] + sizes[1] == d)
        for layer in range(3):
            ends[layer, done] = now[layer][sizes[0][done], done]
        before, last = last, now
    out = []
    for p, (s, t) in enumerate(zip(a, b)):
        layer = int(ends[:, p].argmax())
        score, i, j, left, right = float(ends[layer, p]), len(s), len(t), [], []
        while i or j:
            k = int(back[i + j, layer, i, p])
            left.append(s[i - 1] if layer != 2 else "-")
            right.append(t[j - 1] if layer != 1 else "-")
            i, j, layer = i - (layer != 2), j - (layer != 1), k
        out.append((score, "".join(reversed(left)), "".join(reversed(right))))
    return out


def aligned_substitutions(ref: str, query: str) -> list[dict]:
    """Substitutions of two aligned strings, positions 1-based on the reference, successive gaps joined."""
    out, at = [], 0
    for r, q in zip(ref, query):
        if r == "-":
            if out and out[-1]["type"] == "I" and out[-1]["pos"] == at + 1:
                out[-1]["length"] += 1
            else:
                out.append({"pos": at + 1, "type": "I", "length": 1})
            continue
        at += 1
        if q == "-":
            if out and out[-1]["type"] == "D" and out[-1]["pos"] + out[-1]["length"] == at:
                out[-1]["length"] += 1
            else:
                out.append({"pos": at, "type": "D", "length": 1})
        elif q != r:
            out.append({"pos": at, "type": "X", "length": 1, "base": r, "variant": q})
    return out


def alignment_scores(a: list[str], b: list[str], match: float = 1, mismatch: float = -4, gap_open: float = -6, gap_extend: float = -1, cells: int = 1_000_000) -> np.ndarray:
    """The scores of ``global_alignment`` of many pairs, whose tables are filled side by side, a row at a time; ``cells`` bounds a row of them."""
    out = np.zeros(len(a))
    order = sorted(range(len(a)), key=lambda i: (len(b[i]), len(a[i])))
    while order:
        take = max(1, cells // (len(b[order[-1]]) + 1))
        part, order = order[-take:], order[:-take]
        x, y = (_padded([t[i] for i in part]) for t in (a, b))
        n, m = (np.array([len(t[i]) for i in part]) for t in (a, b))
        none, at, step = -np.inf, np.arange(len(part)), gap_extend * np.arange(len(y) + 1)[:, None]
        both, down = (np.full((len(y) + 1, len(part)), none) for _ in range(2))
        both[0] = 0
        for i in range(len(x) + 1):
            if i:
                best = np.maximum(np.maximum(both, down), right)
                down = np.maximum(np.maximum(both, right) + gap_open, down + gap_extend)
                both = np.full_like(best, none)
                both[1:] = best[:-1] + np.where(x[i - 1] == y, match, mismatch)
            right = np.full_like(both, none)
            right[1:] = (np.maximum.accumulate(np.maximum(both, down)[:-1] - step[:-1], axis=0) + step[:-1]) + gap_open
            done = at[n == i]
            out[np.array(part)[done]] = np.maximum(np.maximum(both, down), right)[m[done], done]
    return out


def _padded(texts: list[str]) -> np.ndarray:
    """Code points, a column a text."""
    codes = np.zeros((max(map(len, texts)), len(texts)), np.uint32)
    for k, t in enumerate(texts):
        codes[: len(t), k] = np.frombuffer(t.encode("utf-32-le", "surrogatepass"), np.uint32)
    return codes


@F.pandas_udf(T.DoubleType())
def alignment_score(parts: Iterator[tuple[pd.Series, pd.Series]]) -> Iterator[pd.Series]:
    """Global alignment score of two sequences; null if one is null."""
    for a, b in parts:
        known = (a.notna() & b.notna()).to_numpy()
        out = np.full(len(a), None, object)
        out[known] = alignment_scores(a[known].tolist(), b[known].tolist())
        yield pd.Series(out)


def distance_matrix(seqs: list[str], longest: int = 150, most: int = 2_000) -> np.ndarray:
    """``longest`` less the number of equal letters of the best alignment of each two sequences (gaps and mismatches cost nothing).

    All pairs of the few sequences of one view; more than ``most`` are refused.
    """
    n = len(seqs)
    if n > most:
        raise ValueError(f"more than {most} sequences")
    i, j = np.triu_indices(n, 1)
    out = np.zeros((n, n))
    out[i, j] = longest - alignment_scores([seqs[k] for k in i], [seqs[k] for k in j], 1, 0, 0, 0)
    return out + out.T


def cluster_order(distances: np.ndarray) -> list[int]:
    """Leaves in the order of an average-linkage tree; of equal distances the first pair is joined. For the few sequences of one view."""
    d = np.array(distances, float)
    n = len(d)
    np.fill_diagonal(d, np.inf)
    groups = {i: [i] for i in range(n)}
    while len(groups) > 1:
        i, j = np.unravel_index(int(np.argmin(d)), d.shape)
        a, b = len(groups[i]), len(groups[j])
        merged = (d[i] * a + d[j] * b) / (a + b)
        d[i], d[:, i] = merged, merged
        d[i, i] = np.inf
        d[j], d[:, j] = np.inf, np.inf
        groups[i] += groups.pop(j)
    return next(iter(groups.values()), [])


def base_depths(reads, group: str = "chrom"):
    """(group, row, lo, hi, depth) of reads (pos 1-based, cigar, seq): depth of the bases A, T, G, C and of S, M, I and D, in stretches."""
    from tilewright.operators.signal import coverage

    spans = reads.withColumn("_o", F.explode(covered_spans(F.col("pos") - 1, cigar_ops(F.col("cigar")))))
    kinds = spans.where(F.col("_o.op").isin("S", "M", "I", "D")).select(group, F.col("_o.op").alias("row"), F.col("_o.lo").alias("lo"), F.col("_o.hi").alias("hi"))
    # aligned bases: each operation with its place in the read
    state = F.struct(F.lit(0).alias("q"), F.array().cast("array<struct<op:string,q:int,len:int>>").alias("out"))
    step = lambda acc, o: F.struct(
        (acc["q"] + F.when(o["op"].isin("M", "=", "X", "I", "S"), o["len"]).otherwise(F.lit(0))).alias("q"),
        F.concat(acc["out"], F.array(F.struct(o["op"].alias("op"), acc["q"].alias("q"), o["len"].alias("len")))).alias("out"),
    )
    placed = reads.select(group, "seq", F.arrays_zip(covered_spans(F.col("pos") - 1, cigar_ops(F.col("cigar"))).alias("ref"), F.aggregate(cigar_ops(F.col("cigar")), state, step, lambda acc: acc["out"]).alias("own")).alias("_z"))
    one = placed.select(group, "seq", F.explode("_z").alias("_z")).where(F.col("_z.own.op").isin("M", "=", "X"))
    letters = one.select(group, F.col("_z.ref.lo").alias("_lo"), F.posexplode(F.split(F.upper(F.substr("seq", F.col("_z.own.q") + 1, F.col("_z.own.len"))), "")).alias("_i", "row"))
    bases = letters.where(F.col("row").isin("A", "T", "G", "C")).select(group, "row", (F.col("_lo") + F.col("_i")).alias("lo"), (F.col("_lo") + F.col("_i") + 1).alias("hi"))
    return coverage(kinds.unionByName(bases), [group, "row"], "lo", "hi")
