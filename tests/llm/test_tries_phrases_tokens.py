"""Conversation tries, phrases and token counts against plain versions, with odd rows and tables."""

from __future__ import annotations

import hashlib
import random
import re
import zlib
from collections import Counter
from pathlib import Path

import pytest
from pyspark.sql import functions as F
from tokenizers import Tokenizer

from tapeloom.llm import collocations, queries, tokencount, trie
from tapeloom.llm.common import table

SF = "/root/testdata/sf0.001"
SERIALIZED = Path(queries.TOKENIZER).read_text(encoding="utf-8")
TURNS = "conv_id long, turn long, role string, text string"


# ---- 11


def plain_trie(rows):
    own = {}
    for c, turn, role, text in rows:
        if c is not None:
            own.setdefault(c, []).append((turn is not None, turn or 0, role or "", hashlib.md5(f"{len(role or '')}:{role or ''}{text or ''}".encode()).hexdigest(), text or ""))
    own = {c: [(t[2], t[4]) for t in sorted(v)] for c, v in own.items()}
    built = {}
    for c, v in own.items():
        h = zlib.crc32(str(c).encode()) % 4
        built[c] = tuple(own.get(c - c % 20, [])[:h] + v[h:])
    members = {}
    for c, v in built.items():
        for d in range(len(v) + 1):
            members.setdefault(v[:d], []).append(c)
    children = Counter(k[:-1] for k in members if k)
    saved, leaves = Counter(), Counter()
    for k, m in members.items():
        own_tokens = (len(m) - 1) * len(re.findall(r"[^\x20\x09-\x0D]+", k[-1][1])) if k else 0
        for d in range(len(k) + 1):
            saved[k[:d]] += own_tokens
            leaves[k[:d]] += not children[k]
    ends = {k: ",".join(map(str, sorted(c for c in m if built[c] == k))) for k, m in members.items()}
    return sorted((min(m), len(k), min(members[k[:-1]]) if k else None, len(m), children[k], leaves[k], saved[k], hashlib.sha256(ends[k].encode()).hexdigest()) for k, m in members.items())


def tried(rows, spark):
    out = trie.prefixes(spark.createDataFrame(rows, TURNS).repartition(3))
    columns = ["conv_id", "depth", "parent_conv_id", "n_convs", "n_children", "n_leaves", "saved_tokens", "ends_sha256"]
    assert out.columns == columns
    return sorted(map(tuple, out.collect()))


def test_trie_as_a_plain_one(spark):
    rnd = random.Random(5)
    say = ["", "a", "a b", None, "c\td  e", "x " * 50]
    rows = [(c, t, rnd.choice(["user", "assistant", None, ""]), rnd.choice(say)) for c in rnd.sample(range(200), 90) for t in rnd.sample(range(-3, 9), rnd.randint(1, 6))]
    rows += [(41, None, "user", "first"), (42, 1, "user", "tie"), (42, 1, "user", "tie"), (42, 1, "assistant", "tie"), (None, 1, "user", "nobody"), (10_000_000_007, 0, "user", "a")]
    rows += [(c, t, "user", "same") for c in range(300, 330) for t in range(4)]  # copies
    assert tried(rows, spark) == plain_trie(rows)


def test_trie_of_long_conversations_in_parts(spark, monkeypatch):
    """Running aggregates go on over parts of conversations; chains branch at every depth, so that many rounds follow."""
    monkeypatch.setattr(trie, "PART", 2)
    rows = [(c, t, "user", f"turn {t}") for c in range(20, 60) for t in range(c - 17)] + [(c, t, "user", f"turn {t if t < 7 else c}") for c in (60, 61, 62) for t in range(12)]
    assert tried(rows, spark) == plain_trie(rows)


def test_trie_of_odd_tables(spark):
    assert tried([(None, 1, "user", "x")], spark) == []
    assert tried([(5, 0, "user", "x")], spark) == plain_trie([(5, 0, "user", "x")])
    rows = [(21, 0, "user", "a b"), (22, 0, "user", "a b"), (40, None, None, None)]
    clash = spark.createDataFrame(rows, TURNS).select("*", *(F.lit("z").alias(c) for c in ("pos", "x", "y", "d", "part", "head", "told", "words", "a", "b", "depth", "a.b")))
    assert sorted(map(tuple, trie.prefixes(clash).collect())) == plain_trie(rows)
    assert trie.prefixes(spark.createDataFrame([], TURNS)).collect() == []


# ---- 12


def plain_phrases(rows, least, longest=5, most=2000):
    f, n = Counter(), Counter()
    for lang, text in rows:
        lang = "und" if lang is None else lang
        low = "".join(chr(ord(c) + 32) if "A" <= c <= "Z" else c for c in text or "")
        for piece in re.split(r"[.,;:!?\n-\r]", low):
            w = re.findall(r"[^ \t]+", piece)
            n[lang] += len(w)
            f.update((lang, *w[i : i + k]) for k in range(1, longest + 1) for i in range(len(w) - k + 1))
    f = {k: a for k, a in f.items() if a >= least}
    out = {}
    for (lang, *w), a in f.items():
        k = len(w)
        if k < 2 or any(g[0] == lang and len(g) - 1 > k and b >= a and any(list(g[1 + i : 1 + i + k]) == w for i in range(len(g) - k)) for g, b in f.items()):
            continue
        score, _, left, right = min((1000 * a * n[lang] // (f[lang, *w[:c]] * f[lang, *w[c:]]), c, f[lang, *w[:c]], f[lang, *w[c:]]) for c in range(1, k))
        out.setdefault(lang, []).append((-score, -a, " ".join(w).encode(), left, right, score, a))
    return sorted((lang, i, p.decode(), a, le, r, n[lang], s) for lang, found in out.items() for i, (_, _, p, le, r, s, a) in enumerate(sorted(found)[:most], 1))


def texts(spark, rows):
    return spark.createDataFrame(rows, "lang string, text string").repartition(3)


PHRASES = random.Random(11)
ODD = [None, "", " \t ", "...", "New York, new\tyork; NEW  YORK", "\x1c \x85 é É ß", "a a a a a a a", "tab\tand\x0bline"]
MIXED = [(PHRASES.choice(["en", "de", None, "", "und"]), " ".join(PHRASES.choice(["new", "york", "city", "of", "the", "a", "b.", "c,\n", "É"]) for _ in range(PHRASES.randint(0, 40)))) for _ in range(120)] + [("en", t) for t in ODD] * 2


@pytest.mark.parametrize(("held", "bits", "most"), [(4_000_000, 1 << 28, 2000), (10, 64, 2000), (50, 1 << 12, 7)])
def test_phrases_as_plain_ones(spark, monkeypatch, held, bits, most):
    """Also with a sieve that lets all through, and with tasks that send before their end."""
    for k, v in {"MOST_HELD": held, "MOST_BITS": bits, "MOST_WORDS": held, "AT_ONCE": held}.items():
        monkeypatch.setattr(collocations, k, v)
    out = collocations.scored(texts(spark, MIXED), least=4, most=most)
    assert sorted(map(tuple, out.collect())) == plain_phrases(MIXED, 4, most=most)


def test_phrases_of_odd_tables(spark):
    assert collocations.scored(texts(spark, [(None, None), ("en", "")])).collect() == []
    assert collocations.scored(texts(spark, MIXED).limit(0)).collect() == []
    rows = [("en", "very long " * 20_000), ("en", "one of a kind")]
    wide = texts(spark, rows).select("*", *(F.lit("z").alias(c) for c in ("phrase", "a", "n", "h", "w", "k", "l", "r", "score", "a.b")))
    assert sorted(map(tuple, collocations.scored(wide).collect())) == plain_phrases(rows, 100)
    with pytest.raises(ValueError, match="two words"):
        collocations.scored(texts(spark, rows), longest=1)


def test_scores_past_64_bits(spark):
    """a n 1000 over 2^63: the quotient is exact."""
    a, n, left, right = 3_000_000_017, 40_000_000_000_037, 5_000_000_029, 7_000_000_001
    wide = [F.lit(x).cast("long").cast("decimal(19,0)") for x in (a, n, left, right)]
    got = spark.range(1).select(collocations.score(*wide)).first()[0]
    assert got == 1000 * a * n // (left * right)


# ---- 13


def test_token_counts_as_the_library(spark):
    docs = table(spark, SF, "documents")
    lib = Tokenizer.from_str(SERIALIZED)
    want = {r["doc_id"]: (len((r["text"] or "").encode()), len(lib.encode(r["text"] or "", add_special_tokens=False).ids)) for r in docs.collect()}
    for common in (100_000, 10):
        got = tokencount.counted(docs, SERIALIZED, limit=300, most_common=common).collect()
        assert {r["doc_id"]: (r["n_bytes"], r["n_tokens"]) for r in got} == want and len(got) == len(want)
        assert all(r["over_limit"] == (r["n_tokens"] > 300) for r in got)


def test_token_counts_of_odd_texts(spark, monkeypatch):
    monkeypatch.setattr(tokencount, "AT_ONCE", 40)
    rnd = random.Random(2)
    marks = ["<|endoftext|>", "<|startoftext|>", "<|ENDOFTEXT|>", "é", "é", "́", " ", "\xa0", "\x1c", "\x85", " ", "\t", "\n", "\r\n", "\x00", "İ", "Σ", "ς", "'s", "'S", "don't", "١", "²", "日本", "😀", "‍", "B", "9", "_", "-", "...", "　", "ﷺ", "가", "ﬁ", "Ω", "</w>"]
    odd = ["".join(rnd.choice(marks) for _ in range(rnd.randint(0, 40))) for _ in range(400)] + ["x" * 20_000, "word " * 20_000, " " * 500]
    rows = [(i, t) for i, t in enumerate(odd)] + [(None, None), (None, "no id"), (7, odd[7]), (7, None), (8, "")]
    lib = Tokenizer.from_str(SERIALIZED)
    frame = spark.createDataFrame(rows, "doc_id long, text string").select("*", *(F.lit("z").alias(c) for c in ("row", "word", "words", "times", "n", "n_bytes", "pieces", "a.b"))).repartition(3)
    got = tokencount.counted(frame, SERIALIZED).collect()
    want = [(i, len((t or "").encode()), len(lib.encode(t or "", add_special_tokens=False).ids)) for i, t in rows]
    key = lambda r: (r[0] is not None, r[0] or 0, *r[1:])
    assert sorted((tuple(r)[:3] for r in got), key=key) == sorted(want, key=key)
    assert tokencount.counted(frame.limit(0), SERIALIZED).collect() == []
