"""Operators against plain versions on small inputs."""

from __future__ import annotations

import hashlib
import itertools
import random
import re
import struct
import unicodedata
import zlib

import numpy as np
import pytest
import sentencepiece
import xxhash
from pyspark.sql import functions as F

from tapeloom.llm import chat, digest, langid, media, mixing, pieces, pii, quality, queries, simhash, urlfilter
from tapeloom.llm.common import table

SF = "/root/testdata/sf0.001"
rnd = random.Random(7)


@pytest.fixture(scope="module")
def documents(spark):
    return table(spark, SF, "documents")


@pytest.fixture(scope="module")
def texts(documents):
    return {r["doc_id"]: r["text"] or "" for r in documents.select("doc_id", "text").collect()}


# ---- 1


def test_entries_in_force(spark):
    days = [f"2024-{m:02d}-{d:02d}" for m in (1, 2, 3, 12) for d in (1, 15, 28)] + ["2026-06-01", "2021-01-01"]
    names = ["com", "a.com", "b.a.com", "c.org", "d.c.org"]
    entries = [(rnd.choice(names), rnd.choice(["x", "y"]), rnd.choice(days), rnd.choice(["add", "remove"])) for _ in range(60)]
    seen = [(i, f"http://{rnd.choice(['', 'www.'])}{rnd.choice(names)}/p", rnd.choice(days)) for i in range(200)]
    out = urlfilter.filtered(spark.createDataFrame(seen, "page_id long, url string, fetched string"), spark.createDataFrame(entries, "domain string, category string, day string, action string"))

    def on(domain, category, day):
        past = [(d, a == "remove") for n, c, d, a in entries if n == domain and c == category and d <= day]
        if not past:
            return False
        last = max(d for d, _ in past)
        return not any(r for d, r in past if d == last)

    for r in out.collect():
        host = r["host"]
        labels = host.split(".")
        options = [".".join(labels[i:]) for i in range(max(1, len(labels) - 1))]
        best = next(((d, c) for d in options for c in ("x", "y") if on(d, c, str(r["fetched"]))), None)
        assert (r["domain"], r["category"]) == (best or (None, None)) and r["blocked"] == bool(best)


# ---- 2


def test_viterbi_is_the_best_path():
    rng = np.random.default_rng(3)
    lengths = np.array([6, 4, 4, 1])
    scores = rng.normal(0, 5, (15, 3)).astype(np.float32)
    label = langid.viterbi(scores, lengths)
    at = 0
    for n in lengths:
        part = scores[at : at + n].astype(float)
        value = lambda p: sum(part[i, s] for i, s in enumerate(p)) - langid.SWITCH * sum(a != b for a, b in itertools.pairwise(p))  # noqa: B023, E731
        best = max(itertools.product(range(3), repeat=int(n)), key=value)
        assert value(label[at : at + n]) == pytest.approx(value(best))
        at += n


def test_languages_of_held_out_documents(spark):
    rows = queries.op2_language_viterbi(spark, "/root/testdata/sf0.01").join(table(spark, "/root/testdata/sf0.01", "documents").select("doc_id", "lang"), "doc_id").where("held_out").collect()
    assert len(rows) > 100 and sum(r["lang"] == r["lang_pred"] for r in rows) >= 0.98 * len(rows)


def test_spans_of_mixed_text(spark, documents):
    model = langid.learn(documents.select("doc_id", "text", "lang"))
    by = {r["lang"]: r["text"] for r in documents.where("length(text) between 300 and 3000").collect()}
    a, b = langid.words_of(by["en"])[:60], langid.words_of(by["de"])[:50]
    spans = langid.identify(model, [" ".join(a + b)])[0][2]
    assert {k for _, _, k in spans} == {"en", "de"} and spans[0][2] == "en" and abs(spans[0][1] - 60) <= 5


def test_words_end_where_the_script_changes():
    assert langid.words_of("Weißbier日本カタ и 3 mots, ab" + "c" * 70) == ["weißbier", "日", "本", "カ", "タ", "и", "mots", "ab" + "c" * 62, "c" * 8]
    assert langid.words_of("ABC x2y") == ["abc", "x", "y"] and langid.words_of("²³ 42 _") == []
    docs = [("zz", "日本語 日本 本日"), ("yy", "abc abd abe"), ("xx", "абв абг")]
    words = {w: np.array([float(k == j) for j in range(3)]) * 5 for k, (_, t) in enumerate(docs) for w in langid.words_of(t)}
    grams = {g: n for w, n in words.items() for g in langid.trigrams(w)}
    model = langid.build([k for k, _ in docs], np.ones(3), words, grams)
    found = langid.identify(model, ["日本" * 40 + "abc abd" * 3, "abcabd" * 30 + "абв" * 40, "абв" * 100])
    assert [x[0] for x in found] == ["zz", "yy", "xx"] and [k for _, _, k in found[1][2]] == ["yy", "xx"]


def test_learned_counts_are_those_of_a_plain_count(spark, documents):
    some = documents.where("doc_id < 60").select("doc_id", "text", "lang")
    model, words, grams = langid.learn(some), {}, {}
    rows = [r for r in some.collect() if r["lang"] and r["text"]]
    for r in rows:
        for w in langid.words_of(r["text"]):
            words.setdefault(w, np.zeros(len(model.languages)))[model.languages.index(r["lang"])] += 1
            for g in langid.trigrams(w):
                grams.setdefault(g, np.zeros(len(model.languages)))[model.languages.index(r["lang"])] += 1
    plain = langid.build(model.languages, np.array([float(sum(r["lang"] == k for r in rows)) for k in model.languages]), words, grams)
    assert model.words.keys() == plain.words.keys() and model.grams.keys() == plain.grams.keys()
    some_words = sorted(words)[:500] + ["neverseenbefore"]
    assert np.allclose(model.scores(some_words), plain.scores(some_words), atol=1e-4) and np.allclose(model.prior, plain.prior)


def test_every_word_of_the_sample_counts(spark):
    """More words than any table would be cut to, each of them seen once; and very many languages."""
    letters = "abcdefghijklmnop"
    name = lambda i, first: first + "".join(letters[i >> s & 15] for s in (0, 4, 8, 12, 16))
    rows = [(k, " ".join(name(1_000 * k + i, "xy"[k % 2]) for i in range(1_000)), "xy"[k % 2]) for k in range(160)]
    model = langid.learn(spark.createDataFrame(rows, "doc_id long, text string, lang string").repartition(4))
    assert len(model.words.keys()) == 160_000
    got = langid.identify(model, [name(3, "x"), name(159_999, "y"), name(77_000, "y")])
    assert [g[0] for g in got[:2]] == ["x", "y"]
    many = langid.build([f"l{k}" for k in range(900)], np.ones(900), {f"{name(k, 'w')}": {k: 4.0} for k in range(900)}, {})
    assert langid.identify(many, [name(7, "w"), name(899, "w")])[1][0] == "l899"


# ---- 3

BASE = {"email": r"[A-Za-z0-9._%+-]+@[A-Za-z0-9-]+(\.[A-Za-z0-9-]+)+", "ip": r"[0-9]+(\.[0-9]+)(\.[0-9]+)(\.[0-9]+)", "card": r"[0-9]([\x20-]?[0-9])+", "phone": r"\+[0-9][\x20().0-9-]+[0-9]"}


def plain_spans(text):
    out = {}
    for kind, pattern in BASE.items():
        out[kind] = []
        for m in re.finditer(pattern, text):
            digits = re.sub("[^0-9]", "", m[0])
            doubled = [int(d) if i % 2 == 0 else sum(divmod(2 * int(d), 10)) for i, d in enumerate(reversed(digits))]
            ok = {"email": lambda: True, "ip": lambda: all(int(x) <= 255 for x in m[0].split(".")), "card": lambda: 13 <= len(digits) <= 19 and sum(doubled) % 10 == 0, "phone": lambda: 9 <= len(digits) <= 15}  # noqa: B023
            if ok[kind]():
                out[kind].append(m.span())
    return out


def test_base_spans(texts):
    some = ["".join(rnd.choice("0123456789..@@ab-+ ()é%") for _ in range(rnd.randint(0, 60))) for _ in range(4000)]
    some += ["4111 1111 1111 1111", "+1 (415) 555-0100x", "1.2.3.4.5.6.7.8", "a@b.c@d.e", "256.1.1.1 1.1.1.1", "000000001.2.3.4"]
    for t in [*texts.values(), *some]:
        found = pii.find(t)
        assert {k: found[k] for k in BASE} == plain_spans(t)


def test_added_spans():
    cases = {
        "IBAN DE89 3704 0044 0532 0130 00.": "account", 'token = "abcdef0123456789abcdef"': "secret", "see ftp://bob:pa55@host.org/x": "login", "mailto:someone@example.org": "contact", "Account number: 12345678": "account",
    }
    for text, kind in cases.items():
        assert pii.find(text)[kind], text
    assert pii.redact("write to a@b.co or +1 415 555 0100 now", pii.find("write to a@b.co or +1 415 555 0100 now")) == "write to [email] or [phone] now"
    clean = "An account of the token ring: the secret is out, see section 4."
    assert pii.redact(clean, pii.find(clean)) == clean


def test_accounts_in_prose():
    cases = {
        "IBAN: DE89370400440532013000 please pay this": "DE89370400440532013000", "Account number: 12345678 is closed": "12345678", "IBAN GB29 NWBK 6016 1331 9268 19 was used": "GB29 NWBK 6016 1331 9268 19",
        "iban de89 3704 0044 0532 0130 00 in lower case": "de89 3704 0044 0532 0130 00", "acct 123-456-789 and 5 more": "123-456-789", "Account number: " + "1234 " * 20 + "and more": ("1234 " * 20).strip(),
        "IBAN NO9386011117947 AND MORE": "NO9386011117947", "passport: 12 AB 345678, seen": "12 AB 345678",
    }
    for text, value in cases.items():
        assert [text[s:e] for s, e in pii.find(text)["account"]] == [value], text
        assert value not in pii.redact(text, pii.find(text))
    assert not pii.find("Account number: 12345 is short, account no 7 of 2019 too")["account"]


def test_cues_in_any_case():
    for text in ('ApI_KeY="abcdef0123456789abcdef"', "ToKeN=abcdef0123456789abcdef", "İİ API_key: abcdef0123456789abcdef"):
        assert [text[s:e] for s, e in pii.find(text)["secret"]] == ["abcdef0123456789abcdef"]
    assert pii.find("iBaN DE89370400440532013000")["account"] and pii.find("MailTo:" + "a" * 300 + "@example.org")["contact"] == [(7, 319)]


def test_long_secrets_and_logins():
    for n in (16, 512, 513, 5_000, 200_000):
        text = f"token={'a1' * (n // 2) + 'b' * (n % 2)} end"
        assert pii.find(text)["secret"] == [(6, 6 + n)]
    text = f"see https://{'u' * 65}:{'p' * 400}@host.org/x"
    assert "uu" not in pii.redact(text, pii.find(text))
    assert pii.find(text)["login"] == [(12, 12 + 65 + 1 + 400)]


# ---- 4


def test_payloads_round_trip(spark, documents, texts):
    for r in media.sampled(documents).collect():
        raw = texts[r["doc_id"]].encode()
        padded = raw + b"\0" * (-len(raw) % 64 if raw else 64)
        assert (r["n_bytes"], r["payload_bytes"], r["payload_sha256"], r["tail_crc32"]) == (len(raw), len(padded), hashlib.sha256(padded).hexdigest(), zlib.crc32(padded[-64:]))
        assert r["media_sha256"] == hashlib.sha256(media.encode(padded)).hexdigest()
        items = media.sequence(media.article(r["doc_id"], texts[r["doc_id"]], r["payload_sha256"], r["n_bytes"]))
        lines = [f"media {r['payload_sha256']} {x['caption']}" if x["kind"] == "media" else f"text {hashlib.sha256(x['text'].encode()).hexdigest()}" for x in items]
        assert r["n_items"] == len(items) and r["items_sha256"] == hashlib.sha256("\n".join(lines).encode()).hexdigest()


def test_sequences_stay_aligned(spark):
    html = '<p>One <b>two</b></p><figure><img src="sha256:d1" alt="x"><figcaption>First &amp; only</figcaption></figure>tail<img src="sha256:d2" alt="alt"/><script>no<img src="q"></script><p>end'
    pages = spark.createDataFrame([(1, html), (2, None), (3, "")], "page_id long, html string")
    store = spark.createDataFrame([("d1", b"one"), ("d1", b"one"), ("d3", b"three")], "digest string, media binary")
    items = media.sequences(pages, "page_id")
    out = {r["page_id"]: r["items"] for r in media.interleaved(media.resolve(items, store), "page_id", ["kind", "text", "digest", "caption", "media"]).collect()}
    assert [(x["pos"], x["kind"], x["text"] or x["digest"], x["caption"]) for x in out[1]] == [(0, "text", "One two", None), (1, "media", "d1", "First & only"), (2, "text", "tail", None), (3, "media", "d2", "alt"), (4, "text", "end", None)]
    assert [x["media"] for x in out[1] if x["kind"] == "media"] == [b"one", None] or [bytes(x["media"]) if x["media"] else None for x in out[1] if x["kind"] == "media"] == [b"one", None]
    assert [x["kind"] for x in out[2] + out[3]] == [None, None]


def test_real_pages_stay_aligned(spark):
    """The table of pages: texts and references in order, against the pages' own visible words; some media are in the store."""
    pages = table(spark, "/root/testdata/sf0.01", "pages").select("page_id", "html")
    figures = spark.range(20).selectExpr("id + 100000 as page_id", "concat('<p>before ', id, '<img data-size=\"', id, '\" src=\"sha256:d', id % 3, '\" alt=\"a', id, '\"> between <figure><img src=\"sha256:d9\"><img src=\"sha256:d1\"><figcaption>both ', id, '</figcaption></figure>after') as html")
    store = spark.createDataFrame([("d0", 10), ("d1", 11), ("d1", 11), (None, 1)], "digest string, bytes int")
    items = media.sequences(pages.union(figures), "page_id")
    out = {r["page_id"]: r["items"] for r in media.interleaved(media.resolve(items, store), "page_id", ["kind", "text", "digest", "caption", "size", "bytes"]).collect()}
    html = {r["page_id"]: r["html"] for r in pages.collect()}
    assert out.keys() == html.keys() | set(range(100_000, 100_020))
    for k, h in html.items():
        plain = media.sequence(h)
        assert [(x["kind"], x["text"], x["digest"], x["caption"]) for x in out[k] if x["kind"]] == [(x["kind"], x["text"], x["digest"], x["caption"]) for x in plain]
        at = 0
        for x in plain:  # words of the texts stand in the page in this order
            for w in (x["text"] or "").split():
                if w.isalnum():
                    at = h.index(w, at) + len(w)
    for i in range(20):
        told = [(x["kind"], x["text"] or x["digest"], x["caption"], x["size"], x["bytes"]) for x in out[100_000 + i]]
        known = {"d0": 10, "d1": 11}
        assert told == [("text", f"before {i}", None, None, None), ("media", f"d{i % 3}", f"a{i}", i, known.get(f"d{i % 3}")), ("text", "between", None, None, None),
                        ("media", "d9", f"both {i}", None, None), ("media", "d1", f"both {i}", None, 11), ("text", "after", None, None, None)]


# ---- 5


def test_digests(spark, documents, texts):
    ids = sorted(texts)
    canon = {i: " ".join(unicodedata.normalize("NFKC", unicodedata.normalize("NFKC", t).casefold()).split()) for i, t in texts.items()}
    out = {r["doc_id"]: r for r in digest.compared(documents.repartition(5)).collect()}
    for i, nxt in zip(ids, ids[1:] + ids[:1], strict=True):
        n = len(texts[i])
        new = texts[i][: n - n // 2] + texts[nxt][: n // 2]
        r = out[i]
        assert (r["n_chars"], r["edited_sha256"], r["fingerprint"]) == (n, hashlib.sha256(new.encode()).hexdigest(), xxhash.xxh3_128_hexdigest(canon[i].encode()))
        assert r["near_next"] == float(canon[i] == canon[nxt]) and r["near_edited"] == float(digest.canonical(new) == canon[i])
        assert r["group_id"] == min(k for k in ids if canon[k] == canon[i])


def test_equal_buckets_are_compared(spark):
    """Different texts under one fingerprint: b, c and d share a bucket, and so do texts of it that are copies."""
    short = lambda own: digest.wide_hash(own if own in ("a", "") else "same")
    rows = [(1, "a"), (2, "b"), (3, "A "), (4, "c"), (5, "B"), (6, "d"), (7, " c "), (8, None)]
    docs = spark.createDataFrame(rows, "doc_id long, text string")
    fps = spark.createDataFrame([(i, short(digest.canonical(t or ""))) for i, t in rows], "doc_id long, fp string")
    assert {r["doc_id"]: r["group_id"] for r in digest.equal_groups(docs, fps, short).collect()} == {1: 1, 2: 2, 3: 1, 4: 4, 5: 2, 6: 6, 7: 4, 8: 8}


def test_much_copied_texts_find_their_group(spark, monkeypatch):
    monkeypatch.setattr(digest, "HOT_COPIES", 5)
    rows = [(i, f"text {i % 7 if i < 70 else i}") for i in range(100)]
    docs = spark.createDataFrame(rows, "doc_id long, text string").repartition(3)
    assert {r["doc_id"]: r["group_id"] for r in digest.compared(docs).collect()} == {i: i % 7 if i < 70 else i for i in range(100)}


# ---- 6


def test_targets_stop_and_reshare():
    assert mixing.targets([10, 100, 1000], [1, 2, 3]) == [30.0, 300.0, 780.0]
    assert mixing.targets([0, 0], [1, 2]) == [0.0, 0.0]
    for _ in range(200):
        size = [rnd.randint(0, 1000) for _ in range(6)]
        out = mixing.targets(size, [1, 2, 3, 1, 2, 3])
        assert sum(out) == pytest.approx(sum(size)) and all(t <= 3 * s + 1e-9 for t, s in zip(out, size, strict=True))


@pytest.mark.parametrize("size", [1, 2, 3, 7, 64, 1000, 4097])
def test_permutations(size):
    out = mixing.permuted(np.arange(size), size, 11)
    assert sorted(out.tolist()) == list(range(size))


def test_sources_of_equal_rows_are_told_apart(spark):
    """The same doc_id and text from two sources: each is repeated by what the mix takes of its own source."""
    text = " ".join(["word"] * 300)
    rows = [(1, text, "a"), (1, text, "b"), *((10 + i, f"other {i} " * 150, "a") for i in range(40)), *((100 + i, f"more {i} " * 20, "b") for i in range(3)), (1, text, None)]
    frame = spark.createDataFrame(rows, "doc_id long, text string, source string")
    want = {r["source"]: r["taken"] / r["size"] for r in mixing._mixed_rows(frame, (1.0, 2.0, 3.0), mixing.BLOCK, mixing.SEED).where("doc_id = 1").collect()}
    got = {r["source"]: r["count"] for r in mixing.repeated(frame).where("doc_id = 1").groupBy("source").count().collect()}
    assert len(want) == 3 and all(int(x) <= got.get(s, 0) <= int(x) + 1 for s, x in want.items()) and len(set(want.values())) > 1


def test_mix(spark, documents):
    rows = documents.select("doc_id", "text", "source").union(spark.createDataFrame([(10_001, "w " * 700, None), (10_002, "few words", None)], "doc_id long, text string, source string"))
    out = mixing.mixed(rows)
    source = {r["doc_id"]: r["source"] for r in rows.collect()}
    got = out.collect()
    by = {}
    for r in got:
        assert 0 <= r["taken"] <= 3 * r["size"]
        s = by.setdefault(source[r["doc_id"]], [0, 0, r["target"], r["source_size"]])
        s[0] += r["size"]
        s[1] += r["taken"]
    assert all(s[0] == s[3] and abs(s[1] - s[2]) <= 2 * mixing.BLOCK for s in by.values())
    assert sorted(map(tuple, got)) == sorted(map(tuple, mixing.mixed(rows.repartition(7)).collect()))
    whole = mixing.repeated(rows).groupBy("doc_id").count().collect()
    assert max(r["count"] for r in whole) <= 3


def test_ten_thousand_sources(spark):
    rows = spark.range(30_000).selectExpr("id as doc_id", "repeat('w ', cast(20 + id % 400 as int)) as text", "concat('s', id % 10000) as source")
    out = mixing.mixed(rows).join(rows.select("doc_id", "source"), "doc_id")
    by = out.groupBy("source").agg(F.sum("taken").alias("taken"), F.first("target").alias("target"), F.sum("size").alias("size"), F.first("source_size").alias("source_size")).collect()
    assert len(by) == 10_000 and all(r["size"] == r["source_size"] for r in by)
    assert all(abs(r["taken"] - r["target"]) <= 4 * mixing.BLOCK for r in by)
    assert sum(r["taken"] for r in by) == pytest.approx(sum(r["target"] for r in by), rel=0.05)


# ---- 7


def test_pairwise_loss_is_that_of_a_plain_optimiser():
    """Weights, worth and cut from few pairs, against gradient descent on the same logistic loss."""
    rng = np.random.default_rng(6)
    label = np.r_[np.ones(25, int), np.zeros(25, int)]
    x = rng.normal(0, 1, (50, 3)) + label[:, None] * [0.9, -0.6, 0.0]
    pairs = 400
    ranker = quality.fit(x, label, pairs=pairs, seed=5)
    mean, scale = x.mean(0), x.std(0)
    z = np.clip((x - mean) / scale, -6, 6)
    z = np.hstack([z, z * z])
    draw = np.random.default_rng(5)
    i, j = draw.choice(np.flatnonzero(label == 1), pairs), draw.choice(np.flatnonzero(label == 0), pairs)
    w = np.zeros(6)
    for _ in range(20_000):
        better = 1 / (1 + np.exp((z[i] - z[j]) @ w))  # the chance that the ranking of a pair is wrong
        w += 0.5 * ((z[i] - z[j]) * better[:, None]).mean(0) - 0.5 * 1e-4 * w
    assert np.allclose(ranker.weights, w, atol=1e-3)
    worth = z @ w
    share = [(worth[label == 1] >= c).mean() + (worth[label == 0] < c).mean() for c in np.quantile(worth, np.linspace(0, 1, 501)[1:-1])]
    assert (worth[label == 1] >= ranker.cut - 1e-3).mean() + (worth[label == 0] < ranker.cut - 1e-3).mean() >= max(share) - 0.05
    score = ranker.score(x)
    assert ((score >= quality.CUT) == (ranker.worth(x) >= ranker.cut)).all() and (np.argsort(score, kind="stable") == np.argsort(ranker.worth(x), kind="stable")).mean() > 0.9




def test_ranking_of_held_out_documents(spark):
    sf = "/root/testdata/sf0.01"
    rows = queries.op7_quality_bradley_terry(spark, sf).where("held_out").join(table(spark, sf, "labels"), "doc_id").collect()
    good, bad = [r["score"] for r in rows if r["quality"] == 1], [r["score"] for r in rows if r["quality"] == 0]
    right = np.mean([(g > b) + 0.5 * (g == b) for g in good for b in bad])
    assert right >= 0.95 and np.mean([g >= quality.CUT for g in good]) >= 0.95


# ---- 8


@pytest.fixture(scope="module")
def library():
    return sentencepiece.SentencePieceProcessor(model_file=queries.MODEL)


def test_ids_are_the_library_s(spark, documents, library):
    more = ["hello" + " " * k + "world" + " " * k for k in range(0, 60, 7)] + ["a" * k for k in (1, 61, 62, 63, 300)] + ["the" * 40, "▁a ▁▁b", " x", "é ² ﬁ", "日本語 テスト", "\x00\t\n"]
    more += ["".join(rnd.choice(' aeinrstThé.,\n\t()123"_-▁日²½') for _ in range(rnd.randint(0, 80))) for _ in range(300)]
    rows = documents.select("doc_id", "text").union(spark.createDataFrame([(100_000 + i, t) for i, t in enumerate(more)], "doc_id long, text string"))
    text = {r["doc_id"]: r["text"] or "" for r in rows.collect()}
    vocabulary = pieces.Vocabulary.load(queries.MODEL)
    for r in pieces.encoded(rows, vocabulary, decode=True).collect():
        t = text[r["doc_id"]]
        assert list(r["ids"]) == library.encode(t)
        assert r["decoded"] == t.replace("▁", " ")


def test_unigram_viterbi_is_the_best_path(spark):
    score = {"a": -1.0, "b": -1.5, "c": -2.0, "ab": -2.2, "bc": -2.1, "abc": -3.9, "aa": -1.4, "ca": -2.5}
    words = sorted({"".join(rnd.choice("abcd") for _ in range(rnd.randint(1, 7))) for _ in range(120)})

    def best(w):
        top = [0.0] + [float("-inf")] * len(w)
        for e in range(1, len(w) + 1):
            for s in range(max(0, e - 3), e):
                v = score.get(w[s:e], -100.0 if e - s == 1 else None)
                if v is not None:
                    top[e] = max(top[e], top[s] + v)
        return top[-1]

    table_ = spark.createDataFrame([(p, s) for p, s in score.items()], "piece string, score double")
    out = pieces.lattice_viterbi(spark.createDataFrame([(w,) for w in words], "word string"), table_, 3).collect()
    assert len(out) == len(words)
    for r in out:
        assert "".join(r["pieces"]) == r["word"] and sum(score.get(p, -100.0) for p in r["pieces"]) == pytest.approx(best(r["word"]))


def _message(number, value):
    """A field of a message in the protocol buffers' wire format: bytes, a number from 0 to 127, or a float."""
    if isinstance(value, bytes):
        size = len(value)
        head = bytes([size]) if size < 128 else bytes([size & 127 | 128, size >> 7])
        return bytes([number << 3 | 2]) + head + value
    return bytes([number << 3 | 5]) + struct.pack("<f", value) if isinstance(value, float) else bytes([number << 3, value])


def unigram_model(pieces_, with_bytes):
    """A model file with hand-made pieces and scores: nothing is trained."""
    made = [("<unk>", 0.0, 2), ("<s>", 0.0, 3), ("</s>", 0.0, 3), *((f"<0x{b:02X}>", 0.0, 6) for b in range(256 * with_bytes)), *((p, v, 1) for p, v in pieces_.items())]
    body = b"".join(_message(1, _message(1, p.encode()) + _message(2, float(v)) + _message(3, t)) for p, v, t in made)
    trainer = _message(3, 1) + (b"\x98\x02\x01" if with_bytes else b"")  # type: unigram; field 35: byte fallback
    normalizer = _message(1, b"identity") + _message(3, 1) + _message(4, 0) + _message(5, 1)
    return body + _message(2, trainer) + _message(3, normalizer)


@pytest.mark.parametrize("with_bytes", [True, False])
def test_unigram_ids_are_the_library_s(spark, tmp_path, with_bytes):
    own = random.Random(11)
    made = {"▁": -2.0, "a": -3.0, "b": -3.25, "c": -4.0, "▁a": -2.5, "ab": -4.5, "bc": -4.125, "abc": -5.75, "▁ab": -5.0, "ca": -6.5, "aa": -5.25, ".": -2.75, "▁abcab": -9.5, "cabc": -9.0}
    path = tmp_path / "unigram.model"
    path.write_bytes(unigram_model(made, with_bytes))
    library = sentencepiece.SentencePieceProcessor(model_file=str(path))
    vocabulary = pieces.Vocabulary.load(str(path))
    assert vocabulary.unigram
    texts_ = ["".join(own.choice("aaabbbccc d.é ") for _ in range(own.randint(0, 60))) for _ in range(400)] + ["", "abc" * 40, "x", "abcabc ddd  d"]
    rows = spark.createDataFrame(list(enumerate(texts_)), "doc_id long, text string")
    for r in pieces.encoded(rows, vocabulary).collect():
        assert list(r["ids"]) == library.encode(texts_[r["doc_id"]]), texts_[r["doc_id"]]


def test_a_lost_word_is_an_error():
    with pytest.raises(LookupError):
        pieces._Units(pieces.Vocabulary.load(queries.MODEL), {})["hello"]


# ---- 9


def plain_components(nodes, near):
    label = {n: n for n in nodes}
    for a in nodes:
        for b in nodes:
            if a < b and near(a, b) and label[a] != label[b]:
                x, y = label[a], label[b]
                for n in nodes:
                    if label[n] in (x, y):
                        label[n] = min(x, y)
    return label


def plain_fingerprint(text):
    w = re.findall(rb"[^\x20\x09-\x0D]+", re.sub(rb"[A-Z]", lambda m: m[0].lower(), text.encode()))
    s = [b" ".join(w[i : i + 4]) for i in range(len(w) - 3)] or ([b" ".join(w)] if w else [])
    h = [xxhash.xxh64(x, seed=42).intdigest() for x in s]
    return sum(1 << b for b in range(64) if 2 * sum(x >> b & 1 for x in h) > len(h))


def test_fingerprints_and_components(spark, documents, texts):
    fp = {i: plain_fingerprint(t) for i, t in texts.items()}
    label = plain_components(sorted(fp), lambda a, b: (fp[a] ^ fp[b]).bit_count() <= 4)
    for r in simhash.near_duplicates(documents).collect():
        assert r["fp"] % (1 << 64) == fp[r["doc_id"]] and r["component_id"] == label[r["doc_id"]]


def test_blocks_lose_no_link(spark):
    rng = np.random.default_rng(5)
    base = rng.integers(0, 1 << 63, 40, dtype=np.uint64)
    near = [int(b) ^ sum(1 << int(k) for k in rng.choice(64, rng.integers(0, 7), replace=False)) for b in base for _ in range(6)]
    dense = [int(base[0]) ^ (1 << a) ^ (1 << b) for a in range(12) for b in range(a)]
    fp = dict(enumerate(dict.fromkeys(near + dense)))
    rows = spark.createDataFrame([(x - (1 << 64) if x >> 63 else x, i) for i, x in fp.items()], "fp long, rep long")
    links = simhash.block_links(rows, 4, simhash.block_masks(simhash.block_count(len(fp), 4), 4))
    got = {r["id"]: r["label"] for r in simhash.components(links).collect()}
    label = plain_components(sorted(fp), lambda a, b: (fp[a] ^ fp[b]).bit_count() <= 4)
    assert {i: got.get(i, i) for i in fp} == label


def test_long_paths_are_one_component(spark):
    links = spark.createDataFrame([(i, i + 1) for i in range(0, 300)] + [(500, 400), (7, 7)], "a long, b long")
    got = {r["id"]: r["label"] for r in simhash.components(links).collect()}
    assert all(got[i] == 0 for i in range(1, 301)) and got[500] == 400


def test_large_buckets_keep_links():
    rng = np.random.default_rng(9)
    x = np.unique(np.concatenate([rng.integers(0, 1 << 20, 3000).astype(np.uint64), np.uint64(12345) ^ (np.uint64(1) << rng.integers(20, 60, 3000).astype(np.uint64))]))
    a, b = simhash.bucket_links(np.zeros(len(x), np.int64), x, np.arange(len(x)), 4)
    label = np.arange(len(x))

    def root(i):
        while label[i] != i:
            i = label[i]
        return i

    for i, j in zip(a, b, strict=True):
        label[root(i)] = root(j)
    for i in range(0, len(x), 97):
        for j in np.flatnonzero(np.bitwise_count(x ^ x[i]) <= 4):
            assert root(i) == root(j)


def test_near_copies_go(spark):
    words = [f"w{rnd.randint(0, 3000)}" for _ in range(40 * 120)]
    docs, group = [], {}
    for g in range(40):
        base = words[g * 120 : (g + 1) * 120]
        for _ in range(3):
            copy = list(base)
            copy[rnd.randint(0, 119)] = "changed"
            group[len(docs)] = g
            docs.append((len(docs), " ".join(copy)))
        half = base[:60] + [f"n{rnd.randint(0, 3000)}" for _ in range(60)]
        group[len(docs)] = 1000 + g
        docs.append((len(docs), " ".join(half)))
    kept = [r["doc_id"] for r in simhash.deduplicated(spark.createDataFrame(docs, "doc_id long, text string")).collect()]
    assert sorted(group[i] for i in kept) == sorted({*group.values()})


def test_recall_of_near_copies(spark):
    """Cut, extended and edited copies at a likeness of 0.8 to 1, most more than ALIKE_BITS bits apart: none is lost."""
    own = random.Random(21)
    docs, pairs, far = [], [], 0
    for g in range(1_500):
        base = [f"w{own.randint(0, 50_000)}" for _ in range(own.randint(40, 400))]
        most = max(1, len(base) // own.randint(5, 12))
        new = [f"n{own.randint(0, 50_000)}" for _ in range(own.randint(1, most))]
        at = own.randint(0, len(base) - 1)
        copy = (base[: len(base) - len(new)], base + new, base[len(new) :], base[:at] + new[:1] + base[at + 1 :])[g % 4]
        docs += [(2 * g, " ".join(base)), (2 * g + 1, " ".join(copy))]
        likeness = simhash.likeness(*(simhash.shingle_set(t) for _, t in docs[-2:]))
        if simhash.ALIKE <= likeness < 1:
            pairs.append((2 * g, 2 * g + 1))
            words = [t.encode().split() for _, t in docs[-2:]]
            far += (simhash.word_set_fingerprint(words[0]) ^ simhash.word_set_fingerprint(words[1])).bit_count() > simhash.ALIKE_BITS
    assert len(pairs) >= 1_000 and far >= 300
    rows = spark.createDataFrame(docs, "doc_id long, text string")
    kept = {r["doc_id"] for r in simhash.deduplicated(rows).collect()}
    missed = sum(a in kept and b in kept for a, b in pairs)
    print(f"near copies: {len(pairs)} pairs, {far} over {simhash.ALIKE_BITS} bits apart, recall {1 - missed / len(pairs):.4f}")
    assert missed == 0 and len(kept) == len(docs) - len(pairs)
    assert kept == {r["doc_id"] for r in simhash.deduplicated(rows.repartition(13)).collect()}


def test_groups_are_connected_by_alike_pairs(spark):
    """Chains: neighbours are alike, ends aren't; one of each chain stays."""
    own = random.Random(3)
    docs = []
    for g in range(30):
        words = [f"c{g}w{own.randint(0, 9_999)}" for _ in range(200)]
        docs += [(8 * g + k, " ".join(words[6 * k : 6 * k + 100])) for k in range(8)]
    own.shuffle(docs)
    sets = {i: simhash.shingle_set(t) for i, t in docs}
    label = plain_components(sorted(sets), lambda a, b: a // 8 == b // 8 and simhash.likeness(sets[a], sets[b]) >= simhash.ALIKE)
    kept = [r["doc_id"] for r in simhash.deduplicated(spark.createDataFrame(docs, "doc_id long, text string")).collect()]
    assert sorted(kept) == sorted({*label.values()}) and len(kept) < 100


def test_dense_blocks_leave_no_copy(spark):
    """Families of the same words in other orders: their fingerprints are close, their shingles aren't."""
    own = random.Random(4)
    words = [f"v{k}" for k in range(60)]
    docs = []
    for g in range(200):
        base = own.sample(words, len(words))
        docs += [(5 * g + k, " ".join([*base, f"e{g}x{k}"])) for k in range(5)]
    kept = [r["doc_id"] for r in simhash.deduplicated(spark.createDataFrame(docs, "doc_id long, text string")).collect()]
    assert sorted(kept) == [5 * g for g in range(200)]


def test_shingles_of_too_many_documents_are_dealt_in_parts(spark, monkeypatch):
    """One passage in all texts, which are alike within families only; a task holds 150 rows of a shingle at most."""
    own = random.Random(12)
    passage = [f"p{k}" for k in range(40)]
    docs = []
    for g in range(150):
        tail = [f"f{g}t{k}" for k in range(5)]
        docs += [(3 * g + k, " ".join([*passage, *tail[:4], f"e{g}x{k}"])) for k in range(3)]
    own.shuffle(docs)
    rows = spark.createDataFrame(docs, "doc_id long, text string")
    calls, in_parts = [], simhash._met_in_parts
    monkeypatch.setattr(simhash, "AT_ONCE", 150)
    monkeypatch.setattr(simhash, "_met_in_parts", lambda *a: calls.append(a) or in_parts(*a))
    spark.conf.set("spark.sql.execution.arrow.maxRecordsPerBatch", "100")
    try:
        kept = [r["doc_id"] for r in simhash.deduplicated(rows).collect()]
    finally:
        spark.conf.unset("spark.sql.execution.arrow.maxRecordsPerBatch")
    assert sorted(kept) == [3 * g for g in range(150)]
    assert calls


def test_prefix_join_finds_all_pairs():
    """Also in buckets that take several rounds."""
    rng = np.random.default_rng(8)
    sets = []
    for _ in range(60):
        base = rng.choice(1 << 20, int(rng.integers(1, 60)), replace=False)
        sets += [np.unique(np.r_[base[int(rng.integers(0, 3)) :], rng.choice(1 << 20, int(rng.integers(0, 4)))]).astype(np.uint64) for _ in range(6)]
    usual = np.unique(np.concatenate(sets))[::5]
    rank = rng.permutation(len(usual))
    rows = [(k, i, len(s), p) for i, s in enumerate(sets) for p, k in enumerate(simhash.ordered_prefix(s, usual, rank))]
    for most in (1, 2, 64):
        found, part = set(), sorted(rows)
        while part:
            a, b, again = simhash.prefix_links(*np.array(part, np.int64).T, most)
            found |= {(min(x, y), max(x, y)) for x, y in zip(a.tolist(), b.tolist(), strict=True)}
            part = [part[i] for i in again]
        true = {(i, j) for i, j in itertools.combinations(range(len(sets)), 2) if simhash.likeness(sets[i], sets[j]) >= simhash.ALIKE}
        assert true and true <= found
    for i, j in true:
        differ = np.bitwise_count(np.frombuffer(simhash.sketch(sets[i]), np.uint8) ^ np.frombuffer(simhash.sketch(sets[j]), np.uint8)).sum()
        assert differ <= simhash.most_unlike(np.array(len(sets[i]) + len(sets[j])))


# ---- 10


def test_formatting_is_reversible(spark):
    bits = ["[INST]", "[/INST]", "</s>", "<s>", "[SEP]", "\\", "[", "<", "a", " ", "INST]", "/s>", "[\\INST]", "<\\/s>", "é"]
    rows = [(c, t, rnd.choice(["user", "assistant", "system", "[INST]", ""]), "".join(rnd.choice(bits) for _ in range(rnd.randint(0, 12)))) for c in range(60) for t in range(rnd.randint(1, 7))]
    rows += [(900, t, "user" if t % 300 < 260 else "assistant", f"turn {t} [SEP]") for t in range(700)]  # longer than a fold's part
    frame = spark.createDataFrame(rows, "conv_id long, turn long, role string, text string")
    out = chat.formatted(frame)
    back = {r["conv_id"]: r for r in chat.read_back(out).collect()}
    made = {r["conv_id"]: r for r in out.collect()}
    for c, r in back.items():
        turns = [(x[2], x[3]) for x in sorted(x for x in rows if x[0] == c)]
        assert [(t["role"], t["text"]) for t in r["turns"]] == turns
        assert r["loss_text"] == "".join(t for role, t in turns if role == "assistant")
        merged = [k for k, _ in itertools.groupby(t[0] for t in turns)]
        assert made[c]["formatted"].count("[/INST]") == len(merged)
        for s in made[c]["loss"]:
            assert made[c]["formatted"][s["start"] + s["length"] :].startswith(("[SEP]", "</s>"))
