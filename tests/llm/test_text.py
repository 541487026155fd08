"""Tokens, classifiers, language models, decontamination and personal data, against brute force."""

import base64
import hashlib
import random
import re
import zlib

import numpy as np
import public_tokenizers as P
import pytest
import xxhash
from pyspark.sql import functions as F

from maskwright.llm import bpe, decontam, langid, lm, pii, quality, token_store, toxicity
from maskwright.llm.common import HELD_OUT, fold

SF = "/root/testdata/sf0.01"
RANKS, LIBRARY = P.path("byte_bpe_50k.tiktoken"), P.path("byte_bpe_50k.json")
ODD = ["", None, " ", "a", "Hello  world\n\n  it's 42!", "naïve façade – “quotes”", "日本語テキスト", "😀 emoji 👩‍👩‍👧", "\x00\x01\x1c\x85", "<|endoftext|>", "hello <|endoftext|> world", "plain <|endoftext|", "ab" * 30000, " \t " * 2000, "x² ½ ª º ×÷", "don't we'll I'm"]


@pytest.fixture(scope="module")
def documents(spark):
    return [r["text"] for r in spark.read.parquet(f"{SF}/documents.parquet").limit(300).collect()]


def frame(spark, texts):
    return spark.createDataFrame([(i, t, "x") for i, t in enumerate(texts)], "doc_id long, text string, ids string").repartition(4)


def test_byte_bpe_equals_tiktoken(spark, documents):
    import tiktoken

    ranks = {base64.b64decode(a): int(b) for a, b in map(bytes.split, open(RANKS, "rb"))}
    enc = tiktoken.Encoding("own", pat_str=P.PATTERN, mergeable_ranks=ranks, special_tokens={})
    rng = random.Random(4)
    noise = ["".join(rng.choice("ab Z9é'ß\n\t.,-_²😀日 ") for _ in range(rng.randrange(0, 40))) for _ in range(500)]
    texts = ODD + noise + documents
    for r in bpe.round_trip(frame(spark, texts), RANKS, P.PATTERN).collect():
        text = texts[r["id"]] or ""
        assert r["ids"] == enc.encode_ordinary(text), text[:80]
        assert bytes(r["decoded"]) == text.encode()
    encoded = bpe.encode(frame(spark, texts[:20]), RANKS, P.PATTERN)
    assert {bytes(r["decoded"]).decode() for r in bpe.decode(encoded, RANKS).collect()} == {t or "" for t in texts[:20]}
    assert bpe.round_trip(frame(spark, texts).limit(0), RANKS, P.PATTERN).count() == 0


def test_whole_tokens_and_forgetting():
    coder = bpe.ByteBpe(RANKS, P.PATTERN)
    words = [t.decode() for t in bpe.read_ranks(RANKS) if t.isalpha()][:4000]
    want = [coder.encode([w])[0].tolist() for w in words]
    coder.known.limit = 50  # starts afresh again and again
    assert [coder.encode([w])[0].tolist() for w in words] == want
    assert PATTERN_IS_USUAL and all(re.fullmatch(bpe.PLAIN, c) for c in "aZ é\n~")


PATTERN_IS_USUAL = bpe.PATTERN == P.PATTERN


def test_elias_fano():
    rng = np.random.default_rng(0)
    for top in (1, 10, 1000, 10**12):
        for n in (0, 1, 2, 300, 1000):
            values = np.sort(rng.integers(0, top, n))
            data = token_store.EliasFano.encode(values)
            read = token_store.EliasFano(data)
            assert read.all().tolist() == values.tolist()
            assert [read.select(i) for i in range(n)] == values.tolist()
            for a, b in ((0, n), (n // 3, n // 2), (n, n), (0, min(n, 257)), (min(n, 255), n)):
                assert read.select_range(a, b).tolist() == values[a:b].tolist()
    top = np.array([0, 1, (1 << 64) - 1], np.uint64)
    assert token_store.EliasFano(token_store.EliasFano.encode(top)).all().tolist() == top.tolist()
    dense = token_store.EliasFano.encode(np.arange(0, 10_000_000, 1000))
    assert len(dense) < 10_000 * 2  # near 2 + log2(1000) bits a value, samples included
    with pytest.raises(IndexError):
        token_store.EliasFano(dense).select(10_000)


def test_segments():
    ids = [np.array(x, np.int32) for x in ([5, 2], [2], [7, 8, 9, 2])]
    segment = token_store.Segment(token_store.Segment.pack([None, -4, 10], ids, 2))
    assert segment.doc_ids() == [None, -4, 10] and [segment.document(i).tolist() for i in range(3)] == [x.tolist() for x in ids]


def test_token_store(spark, documents, monkeypatch):
    from tokenizers import Tokenizer

    t = Tokenizer.from_file(LIBRARY)
    assert t.encode("<|endoftext|>", add_special_tokens=False).ids == [50256]
    texts = ODD + documents
    rows = [(i * 3 - 20, x) for i, x in enumerate(texts)] + [(4, f"again {i}") for i in range(40)] + [(None, f"nobody's {i % 7}") for i in range(30)] + [(None, None), (4, None)]
    df = spark.createDataFrame([(*r, 1, "x") for r in rows], "doc_id long, text string, tie int, id string").repartition(5)
    store = token_store.write(df, LIBRARY)
    shards = {(d, s["shard"]) for s in store.collect() for d in token_store.Segment(bytes(s["data"])).doc_ids()}
    assert len([1 for d, _ in shards if d == 4]) > 1 or len([1 for d, _ in shards if d is None]) > 1  # rows of one id are split
    got = sorted(token_store.read(store).collect(), key=lambda r: r["start"])

    def tie(text):
        h = xxhash.xxh64_intdigest((text or "").encode(), 42)
        return h - (1 << 64) if h >> 63 else h

    ordered = sorted(rows, key=lambda r: (r[0] is not None, r[0] or 0, tie(r[1])))
    at = 0
    for r, (doc_id, text) in zip(got, ordered, strict=True):
        ids = [*t.encode(text or "", add_special_tokens=False).ids, 2]
        assert (r["id"], r["start"], r["n_tokens"]) == (doc_id, at, len(ids))
        assert zlib.crc32(bytes(r["ids_le"])) == zlib.crc32(np.array(ids, "<u4").tobytes())
        at += len(ids)
    assert token_store.read(token_store.write(df.limit(0), LIBRARY)).count() == 0


def slow_lm(texts, order, min_count, alpha, others=True):
    from collections import Counter
    from math import log

    words = [(t or "").encode().lower().split() for t in texts]

    def counted(w):
        return Counter(tuple(w[i : i + k]) for k in range(1, order + 1) for i in range(len(w) - k + 1))

    all_counts = sum((counted(w) for w in words), Counter())
    total_words = sum(map(len, words))
    out = []
    for w in words:
        own = counted(w) if others else Counter()
        n = max(1, total_words - (len(w) if others else 0))
        total, back = 0.0, 0
        for i in range(len(w)):
            for k in range(min(order, i + 1), 0, -1):
                gram = tuple(w[i - k + 1 : i + 1])
                c = all_counts[gram] - own[gram]
                if k == 1 or c >= min_count:
                    total += log(c / (all_counts[gram[:-1]] - own[gram[:-1]])) if k > 1 else log(max(1, c) / n)
                    back += k < min(order, i + 1)
                    break
                total += log(alpha)
        out.append((len(w), back, total))
    return out


@pytest.mark.parametrize(("order", "min_count", "others", "block_bytes"), [(1, 1, True, 1 << 20), (2, 2, False, 20_000), (3, 1, True, 20_000), (3, 2, True, 1 << 20), (4, 1, False, 3_000)])
def test_language_model(spark, documents, order, min_count, others, block_bytes, monkeypatch):
    monkeypatch.setattr(lm, "PART_ENTRIES", 5000)
    texts = [*documents[:120], "", None, "one", "one two", "one two one two", " \t\n", *["the same thing again"] * 30, "long " * 30000]
    df = frame(spark, texts).withColumn("block", F.lit(1)).withColumn("text_", F.lit("x"))
    got = {r["id"]: r for r in lm.score(df, order=order, min_count=min_count, others=others, block_bytes=block_bytes).collect()}
    assert len(got) == len(texts)
    for i, (n, back, total) in enumerate(slow_lm(texts, order, min_count, lm.ALPHA, others)):
        assert (got[i]["n_tokens"], got[i]["n_backed_off"]) == (n, back)
        assert got[i]["log_score"] == pytest.approx(total, rel=1e-9, abs=1e-9)


def test_count_tables(spark, documents):
    texts = [*documents[:60], "", None, "a b a b"]
    counts = lm.ngram_counts(frame(spark, texts), order=3, block_bytes=20_000)
    from collections import Counter

    want = Counter((k + 1, int(x)) for t in texts for k, keys in enumerate(lm.ngram_keys((t or "").encode(), 3)) for x in keys.view(np.int64))
    assert {(r["k"], r["key"]): r["total"] for r in counts.collect()} == want
    empty = frame(spark, texts).limit(0)
    assert lm.score(empty).count() == 0 and lm.ngram_counts(empty).count() == 0
    odd = spark.createDataFrame([(None, "a b"), (None, "a b"), (7, None), (7, None)], "doc_id long, text string")
    assert sorted((r["n_tokens"], r["n_backed_off"]) for r in lm.score(odd).collect()) == [(0, 0), (0, 0), (2, 0), (2, 0)]


def test_registered_language_model_is_the_whole_model(spark, documents, tmp_path):
    from maskwright.llm import queries

    texts = [*documents[:60], "a b c a b d", "x b c x b d", "a b c", "", None]
    frame(spark, texts).write.parquet(str(tmp_path / "documents.parquet"))
    got = {r["doc_id"]: r for r in queries.queries()["op9_lm_score"](spark, str(tmp_path)).collect()}
    for i, (n, back, total) in enumerate(slow_lm(texts, 3, 1, lm.ALPHA)):
        assert (got[i]["n_tokens"], got[i]["n_backed_off"]) == (n, back)
        assert got[i]["log_score"] == pytest.approx(total, abs=1e-4)


def slow_containment(docs, items, size=5, threshold=0.8):
    def shingles(t):
        w = (t or "").encode().lower().split()
        n = min(size, len(w))
        return {b" ".join(w[i : i + n]) for i in range(len(w) - n + 1)} if w else set()

    of = [(k, shingles(t)) for k, t in items]
    return [(i, k, len(s), len(s & own)) for i, t in docs for own in [shingles(t)] for k, s in of if s and len(s & own) >= threshold * len(s)]


def test_decontamination(spark, documents):
    rng = random.Random(8)
    vocabulary = [f"w{i}" for i in range(40)]
    items = [(i, " ".join(rng.choice(vocabulary) for _ in range(rng.randrange(1, 60)))) for i in range(40)] + [(98, ""), (99, None), (7, "w1 w2"), (100, "short one")]
    items += [(101, items[3][1]), (101, items[3][1]), (None, items[4][1])]  # repeated rows, rows of one text, no id
    docs = [(i, t) for i, t in enumerate(documents[:40])]
    for k, text in items:
        words = (text or "").split()
        for cut in (0, 1, 3):  # changed words and surroundings
            changed = list(words)
            for _ in range(cut):
                if changed:
                    changed[rng.randrange(len(changed))] = "zzz"
            docs.append((len(docs), " ".join(["intro", *changed, "outro"]).upper()))
    docs += [(900, "W1  w2"), (901, None), (902, ""), (None, items[0][1]), (None, items[0][1]), (903, f"x {items[5][1]} " + "y " * 100_000 + items[6][1])]
    d = spark.createDataFrame([(*x, 1) for x in docs], "doc_id long, text string, item_id int").repartition(4)
    b = spark.createDataFrame(items, "item_id long, text string")
    want = slow_containment(docs, items)
    for block_bytes in (decontam.BLOCK_BYTES, 500):
        got = [tuple(r) for r in decontam.contained_items(d, b, block_bytes=block_bytes).collect()]
        assert sorted(got, key=str) == sorted(want, key=str)
        clean = decontam.without_items(d, b, block_bytes=block_bytes)
        assert clean.columns == d.columns
        bad = {i for i, *_ in want}
        assert sorted((r["doc_id"] is None, r["doc_id"]) for r in clean.collect()) == sorted((i is None, i) for i, _ in docs if i not in bad)
    assert len(list(decontam._blocks(b, "text", 5, 0.8, 500))) > 3
    assert decontam.contained_items(d.limit(0), b).count() == 0 and decontam.contained_items(d, b.limit(0)).count() == 0


def luhn(d):
    return sum(v - 9 if v > 9 else v for i, c in enumerate(reversed(d)) for v in [int(c) * (1 + i % 2)]) % 10 == 0


def base_spans(t):
    out = [("email", m.start(), m.end()) for m in re.finditer(r"[A-Za-z0-9._%+-]+@[A-Za-z0-9-]+(\.[A-Za-z0-9-]+)+", t)]
    out += [("ip", m.start(), m.end()) for m in re.finditer(r"[0-9]+(\.[0-9]+)(\.[0-9]+)(\.[0-9]+)", t) if all(int(x) <= 255 for x in m.group().split("."))]
    out += [("card", m.start(), m.end()) for m in re.finditer(r"[0-9]([\x20-]?[0-9])+", t) for d in [re.sub("[ -]", "", m.group())] if 16 <= len(d) <= 19 and luhn(d)]
    out += [("phone", m.start(), m.end()) for m in re.finditer(r"\+[0-9][\x20().0-9-]+[0-9]", t) if 8 <= len(re.sub("[^0-9]", "", m.group())) <= 15]
    return out


def test_personal_data(spark, documents):
    rng = random.Random(6)
    bits = ["0", "1", "4", "9", "25", "255", "256", ".", "..", "-", " ", "@", "a", "b_", "+", "+1", "(", ")", "é", "😀", "\n", "%", "4111111111111111", "4111-1111-1111-1111 ", "1.2.3.4", "x@y.z", "_q@r.s", ","]
    texts = ODD + documents + ["".join(rng.choice(bits) for _ in range(rng.randrange(1, 40))) for _ in range(3000)] + ["1" * 50000, "a" * 50000 + "@", "1." * 20000, "a@b.c " * 5000, "+1 " * 20000]
    df = spark.createDataFrame([(i, t, "x") for i, t in enumerate(texts)], "doc_id long, text string, _pii_text string").repartition(8)
    names = ("email", "ip", "card", "phone")
    for r in pii.with_spans(df).collect():
        got = [(s["kind"], s["start"], s["end"]) for s in r["pii_spans"] if s["kind"] in names]
        assert got == base_spans(texts[r["doc_id"]] or ""), texts[r["doc_id"]][:100]
    assert pii.with_spans(df.limit(0)).count() == 0


def test_added_kinds_and_redaction(spark):
    texts = ["my iban GB82 WEST 1234 5698 7654 32 ok", "my iban GB83 WEST 1234 5698 7654 32 no", "ssn 123-45-6789", "order 123-45-6789", 'token = "04dbebab91ab85687d33eeaaf9ac699e1188f962" x', "a.b@c.org and +1 (212) 555-0187", None, "clean"]
    df = spark.createDataFrame([(i, t) for i, t in enumerate(texts)], "doc_id long, text string")
    got = [r["text"] for r in pii.redact(df).orderBy("doc_id").collect()]
    assert pii.redact(df.withColumns({"_pii_spans": F.lit(1), "_pii_parts": F.lit(2)})).columns == ["doc_id", "text", "_pii_spans", "_pii_parts"]
    assert got == ["my iban [IBAN] ok", texts[1], "ssn [SSN]", texts[3], 'token = "[SECRET]" x', "[EMAIL] and [PHONE]", None, "clean"]


def test_redaction_covers_overlapping_spans(spark):
    rng = random.Random(11)
    bits = ["1", "25", "111 ", ".", "-", " ", "@", "a", "+", "+1 ", "é", "4111 1111 1111 1111", "10.0.0.4", "x@y.z", "DE89370400440532013000", "123-45-6789", "ssn ", "+49 30 1234567", "word "]
    texts = ["pay 10.0.0.4 111 1111 1111 1111 now"] + ["".join(rng.choice(bits) for _ in range(rng.randrange(1, 25))) for _ in range(1500)] + ["a@b.cd é " * 2000]
    df = spark.createDataFrame(list(enumerate(texts)), "doc_id long, text string").repartition(4)
    spans = {r["doc_id"]: [(s["start"], -s["end"], s["kind"]) for s in r["pii_spans"]] for r in pii.with_spans(df).collect()}
    overlapping = 0
    for r in pii.redact(df).collect():
        text, at, want = texts[r["doc_id"]], 0, ""
        for start, back, kind in sorted(spans[r["doc_id"]]):
            if start >= at:
                want += text[at:start] + f"[{kind.upper()}]"
            overlapping += start < at
            at = max(at, -back)
        assert r["text"] == want + text[at:]
    assert overlapping > 20


def test_quality(spark):
    docs, labels = spark.read.parquet(f"{SF}/documents.parquet"), spark.read.parquet(f"{SF}/labels.parquet")
    model = quality.fit(docs, labels)
    scored = quality.with_score(docs, model)
    rows = scored.join(labels, "doc_id").select("doc_id", "score", "quality", fold("doc_id").alias("fold")).toPandas()
    held = rows[rows.fold == HELD_OUT]
    assert ((held.score >= quality.THRESHOLD) == (held.quality == 1)).mean() > 0.95
    # the compiled columns are the model
    stats = quality.with_statistics(docs, "text", "s").select("doc_id", "s.*").toPandas().set_index("doc_id")
    x = {k: stats[k].to_numpy(float) for k in quality.STATS}
    margin = model.bias + sum(w * rule.holds(x) for rule, w in model.rules)
    got = scored.select("doc_id", "score").toPandas().set_index("doc_id").loc[stats.index].score
    assert np.allclose(got, 1 / (1 + np.exp(-margin)))


def test_quality_of_odd_rows(spark):
    df = spark.createDataFrame([(i, t, "x", 0.5) for i, t in enumerate([*ODD, *ODD])], "doc_id long, text string, _quality_stats string, score double")
    none = spark.createDataFrame([], "doc_id long, quality int")
    model = quality.fit(df, none)
    rows = quality.with_score(df, model, into="s").collect()
    assert len(rows) == 2 * len(ODD) and all(r["s"] == 0.5 for r in rows)
    odd = spark.createDataFrame([(0, 1), (0, 0), (None, 1), (1, None), (3, 0)], "doc_id long, quality int")
    assert quality.with_score(df.limit(0), quality.fit(df, odd)).count() == 0


def test_language(spark):
    docs = spark.read.parquet(f"{SF}/documents.parquet")
    found = langid.predict(docs, langid.fit(docs)).toPandas().set_index("id")
    rows = docs.select("doc_id", "lang", fold("doc_id").alias("fold")).toPandas()
    rows["pred"] = found.loc[rows.doc_id].lang_pred.to_numpy()
    assert (rows[rows.fold == HELD_OUT].lang == rows[rows.fold == HELD_OUT].pred).mean() > 0.97
    assert found.score.between(0, 1).all()


def slow_grams(text):
    blanked = "".join(c if c.isalpha() else " " for c in text.lower())
    return {blanked[i : i + k] for k in (1, 2, 3) for i in range(len(blanked) - k + 1)}


def test_language_model_equals_brute_force(documents):
    """Kernels by sets, and kernel ridge regression solved in the landmarks' space, against the model."""
    rng = random.Random(1)
    scripts = {"en": "the and of with", "de": "der die und mit", "el": "και το την για", "ru": "это что как для", "ja": "日本 語の 文章 です"}
    texts, langs = [], []
    for lang, words in scripts.items():
        for _ in range(12):
            texts.append(" ".join(rng.choice(words.split()) for _ in range(rng.randrange(3, 12))) + rng.choice(["!", " 42", ""]))
            langs.append(lang)
    model = langid.fit_texts(texts, langs, landmarks=15)
    assert len(set("".join(texts)) & set("αβγδжшщ日本語")) and model.languages == sorted(scripts)
    chosen = [t for k in model.languages for t in [t for t, x in zip(texts, langs, strict=True) if x == k][:3]]

    def kernel(a, b):
        a, b = slow_grams(a), slow_grams(b)
        return len(a & b) / np.sqrt(max(1, len(a)) * max(1, len(b)))

    got = model.kernels([langid.code_points(t) for t in texts])
    want = np.array([[kernel(t, c) for c in chosen] for t in texts])
    assert np.allclose(got, want, atol=1e-5)
    own = np.array([[kernel(a, b) for b in chosen] for a in chosen])
    target = np.where(np.array(langs)[:, None] == np.array(model.languages), 1.0, -1.0)
    # min |K a - y|^2 + lambda a' own a, all languages of one size
    lam = langid.RIDGE * len(texts) / len(chosen)
    a = np.linalg.solve(want.T @ want + lam * own + 1e-12 * np.eye(len(chosen)), want.T @ target)
    assert np.allclose(want @ a, got @ model.weights, atol=1e-2)
    test = ["the of", "и это для", "日本", "mit der", "για την", "123"]
    pred, score = model.predict(test)
    margins = np.array([[kernel(t, c) for c in chosen] for t in test]) @ a
    assert pred[:5] == [model.languages[i] for i in margins.argmax(axis=1)[:5]] and pred[5] == "und" and score[5] == 0
    # equal margins: the first language
    tie = langid.fit_texts(["ab", "ab"], ["y", "x"])
    assert tie.predict(["ab"])[0] == ["x"]
    long = langid.code_points("añ日 x" * 600_000)
    assert langid.grams_of(long).tolist() == langid.grams_of(langid.code_points("añ日 x" * 3)).tolist()


def test_language_of_odd_rows(spark):
    texts = ["der die das und nicht", "the and of that with", None, "", "123 !?", "日本語", "the " * 100000, "den der und die das"]
    df = spark.createDataFrame([(i, t, lang) for i, (t, lang) in enumerate(zip(texts, ["de", "en", "de", None, "en", None, "en", "de"], strict=True))], "doc_id long, text string, lang string")
    model = langid.fit(df)
    got = {r["id"]: (r["lang_pred"], r["score"]) for r in langid.predict(df, model).collect()}
    assert len(got) == len(texts) and got[2] == got[3] == got[4] == ("und", 0.0) and got[5][0] in ("de", "en")
    assert got[6][0] == "en" and got[0][0] == "de"
    assert {r["lang_pred"] for r in langid.predict(df, langid.fit(df.limit(0))).collect()} == {"und"}
    assert langid.predict(df.limit(0), model).count() == 0
    # clashing columns, and an id that most rows share
    wide = df.selectExpr("*", "1 as _id", "'x' as _lang", "2 as _sample_id").unionAll(df.where("doc_id = 0").selectExpr("*", "1", "'x'", "2").join(spark.range(500)).drop("id"))
    assert set(langid.fit(wide, sample_rows=4).languages) == {"de", "en"}


def test_toxicity():
    rng = random.Random(3)
    words = [f"word{i}" for i in range(300)]
    bad = ["vileword", "vilest", "nasty"]
    texts, toxic = [], []
    for i in range(900):
        body = [rng.choice(words) for _ in range(40)]
        if i % 5 == 0:
            for _ in range(rng.choice([1, 4, 12])):
                body.insert(rng.randrange(len(body)), rng.choice(bad))
        texts.append(" ".join(body))
        toxic.append(int(i % 5 == 0))
    model = toxicity.fit_texts(texts[:600], toxic[:600])
    assert (np.diff(model.thresholds) > 0).all()
    features = toxicity.Features(model.active, limit=100)
    above = model.above(np.array([model.weights[features.present(t)].sum() for t in texts[600:]]))
    assert ((above[:, 0] >= 0.5) == np.array(toxic[600:])).mean() > 0.99
    mild, strong = (features.present(" ".join(["word1", *w])) for w in (["vileword"], bad))
    assert model.weights[strong].sum() > model.weights[mild].sum() > 0


def slow_loss(w, t, features, grade):
    """Mean negative log likelihood of P(grade > k) = sigmoid(w.x - t_k), summed over k, and the ridge."""
    from math import exp, log

    total = 0.0
    for own, g in zip(features, grade, strict=True):
        m = sum(w[f] for f in own)
        total -= sum(log(1 / (1 + exp(-(m - t_k)))) if g > k else log(1 - 1 / (1 + exp(-(m - t_k)))) for k, t_k in enumerate(t))
    return total / len(grade) + toxicity.RIDGE / 2 * sum(x * x for x in w)


def test_ordinal_fit_equals_slow_descent():
    rng = random.Random(7)
    features, grade = [], []
    for _ in range(120):
        own = [f for f in range(4) if rng.random() < 0.4]
        grade.append(min(3, max(0, sum(f in own for f in (0, 1)) + (2 in own) * (rng.random() < 0.5) + (rng.random() < 0.2))))
        features.append(own)
    rows = np.repeat(np.arange(120), [len(x) for x in features])
    w, t = toxicity.fit_ordinal(rows, np.array([f for x in features for f in x]), 120, 4, np.array(grade), steps=3000)
    x = [*w, *t]
    best = slow_loss(x[:4], x[4:], features, grade)
    assert (np.diff(t) > 0).all()
    step = 0.5
    while step > 1e-3:  # coordinate descent finds nothing better
        moved = False
        for i in range(7):
            for d in (step, -step):
                y = list(x)
                y[i] += d
                if y[4] < y[5] < y[6] and (now := slow_loss(y[:4], y[4:], features, grade)) < best - 1e-7:
                    x, best, moved = y, now, True
        step = step if moved else step / 2
    assert slow_loss(w, t, features, grade) <= best + 2e-3


def test_grades_with_ties_and_empty_grades():
    clean = [np.array([1, 2])] * 40
    own, y = clean + [np.array([7, 8])] * 20, np.array([0] * 40 + [1] * 20)
    assert set(toxicity.grades(own, y)[:40]) == {0} and set(toxicity.grades(own, y)[40:]) == {1}  # all tie
    mixed = clean * 10 + [np.array([7])] * 100 + [np.array([7, 8])] * 100 + [np.array([7, 8, 9])] * 100
    y = np.array([0] * 400 + [1] * 300)
    assert toxicity.grades(mixed, y)[400:].tolist() == [1] * 100 + [2] * 100 + [3] * 100
    # a row's own marks don't grade it: those that no other row carries count for nothing
    alone = mixed + [np.array([50, 51, 52, 53, 54])]
    assert toxicity.grades(alone, np.append(y, 1))[-1] == 1
    w, t = toxicity.fit_ordinal(np.array([0, 1]), np.array([0, 0]), 60, 1, np.array([2, 2] + [0] * 58))
    assert np.isfinite(w).all() and (np.diff(t) > 0).all()


def test_fits_bound_their_sample(spark):
    from maskwright.llm import common

    docs = spark.createDataFrame([(i, "x" * (10 + i)) for i in range(200)] + [(3, "twin")] * 300 + [(None, "none"), (5, None)], "doc_id long, text string")
    labels = docs.selectExpr("doc_id", "1 as quality").unionAll(docs.selectExpr("doc_id", "0"))
    chosen = common.labelled_sample(labels, "doc_id", "quality", 20)
    got = common.sampled_texts(docs, chosen, "doc_id", "text")
    assert len(got) == 20 and all(label == 1 and i % 1 == 0 for i, label, _ in got) and len({i for i, *_ in got}) == 20
    assert got == common.sampled_texts(docs.repartition(7), chosen, "doc_id", "text")
    assert sum(len(t) for *_, t in common.sampled_texts(docs, chosen, "doc_id", "text", 500)) <= 500
    assert common.bounded_sample(docs.limit(0), "doc_id", 5).count() == 0
    assert {r[0] for r in common.bounded_sample(docs, "doc_id", 500).collect()} == set(range(200))


def test_toxicity_of_odd_rows(spark):
    df = spark.createDataFrame([(i, t, i % 2) for i, t in enumerate([*ODD, "x"])], "doc_id long, text string, toxic int")
    model = toxicity.fit(df, df.select("doc_id", "toxic"))
    assert toxicity.predict(df, model).count() == len(ODD) + 1
    clean = toxicity.predict(df, toxicity.fit(df, df.where("toxic = 0"))).collect()
    assert all(r["grade"] == 0 and 0 <= r["severity"] < 0.01 for r in clean)
    assert toxicity.predict(df.limit(0), model).count() == 0


def test_digests_of_the_queries(spark):
    from tokenizers import Tokenizer

    from maskwright.llm import queries

    from .test_dedup import slow_fingerprint

    small = "/root/testdata/sf0.001"
    texts = {r["doc_id"]: r["text"] or "" for r in spark.read.parquet(f"{small}/documents.parquet").collect()}
    library, at = Tokenizer.from_file(LIBRARY), 0
    for r in queries.op8_byte_bpe(spark, small).collect():
        assert r["decoded_sha256"] == hashlib.sha256(texts[r["doc_id"]].encode()).hexdigest()
    for r in queries.op2_pii(spark, small).collect():
        spans = base_spans(texts[r["doc_id"]])
        assert r["base_sha256"] == hashlib.sha256(",".join(f"{k}:{a}:{b}" for k, a, b in spans).encode()).hexdigest()
        assert [r["n_email"], r["n_ip"], r["n_card"], r["n_phone"]] == [sum(k == x for x, *_ in spans) for k in ("email", "ip", "card", "phone")]
    for r in sorted(queries.op6_token_store(spark, small).collect()):
        ids = [*library.encode(texts[r["doc_id"]], add_special_tokens=False).ids, 2]
        assert (r["start"], r["n_tokens"], r["ids_crc32"]) == (at, len(ids), zlib.crc32(np.array(ids, "<u4").tobytes()))
        at += len(ids)
    for r in queries.op7_simhash(spark, small).collect():
        assert r["fingerprint"] == f"{slow_fingerprint(texts[r['doc_id']]):016x}"
    assert set(queries.oracle_sql()) <= set(queries.queries()) and len(queries.queries()) == 10


def test_shared_storage_is_emptied(tmp_path):
    """Tables go when they are superseded, and all of them when the JVM ends, also after the session was stopped."""
    import subprocess
    import sys

    code = f"""
import sys
from pyspark.sql import SparkSession
from maskwright.llm import common
spark = SparkSession.builder.master("local[2]").config("spark.checkpoint.dir", "file://{tmp_path}").config("spark.ui.enabled", "false").getOrCreate()
a, b = common.stored(spark.range(5), "a"), common.stored(spark.range(6), "b")
common.discard(a, spark.range(3))
import os
assert b.count() == 6 and not os.path.exists(a._stored_at.removeprefix("file://")), a._stored_at
spark.stop()
"""
    subprocess.run([sys.executable, "-c", code], check=True, timeout=300)
    assert not [f for f in tmp_path.rglob("*") if f.is_file()]


def test_secrets_of_any_length_and_ibans_before_words(spark):
    texts = ["secret " + "aB3x" * 64 + "z", "secret " + "a1" * 50000, "iban ES91 2100 0418 4502 0005 1332 EUR", "iban AT611904300234573201 2024 paid", "konto NO93 8601 1117 947", "iban MT84MALT011000012345MTLCAST001S", "iban DE89370400440532013001 2024", "iban DE89 3704 0044 0532 0130 00 EUR"]
    df = spark.createDataFrame(list(enumerate(texts)), "doc_id long, text string").repartition(4)
    got = [r["text"] for r in pii.redact(df).orderBy("doc_id").collect()]
    assert got == ["secret [SECRET]", "secret [SECRET]", "iban [IBAN] EUR", "iban [IBAN] 2024 paid", "konto [IBAN]", "iban [IBAN]", texts[6], "iban [IBAN] EUR"]


@pytest.mark.parametrize("code", [c for codes in pii._IBAN_LENGTHS.values() for c in codes.split()])
def test_iban_pattern_stops_at_the_length_of_the_country(code):
    n = next(n for n, codes in pii._IBAN_LENGTHS.items() if code in codes.split())
    number = code + "12" + "345A" * 8
    assert re.search(pii._iban_pattern(), number[:n] + " 2024 EUR").group() == number[:n]
    assert not re.search(pii._iban_pattern(), number[: n - 1]) and not re.search(pii._iban_pattern(), number[: n + 1])
