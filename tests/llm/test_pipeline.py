"""The corpus pipeline, stage by stage, against plain Python over the same rows."""

import base64

import public_tokenizers as P

import corpus_pipeline
from maskwright.llm import quality
from maskwright.storage import shared_dir

from .test_dedup import groups, slow_fingerprint
from .test_text import base_spans, slow_containment

SF = "/root/testdata/sf0.001"


def test_stages_equal_brute_force(spark, tmp_path):
    import tiktoken

    docs = spark.read.parquet(f"{SF}/documents.parquet")
    items = [(r["item_id"], r["text"]) for r in spark.read.parquet(f"{SF}/benchmark.parquet").collect()]
    stages = dict(corpus_pipeline.STAGES)
    assert list(stages) == ["quality", "near_duplicates", "decontamination", "personal_data", "tokens"]

    def run(name, docs):
        path = str(tmp_path / name)
        stages[name](spark, docs, SF).write.parquet(path)
        return spark.read.parquet(path)

    def rows(df):
        return {r["doc_id"]: r for r in df.collect()}

    model = quality.fit(docs, spark.read.parquet(f"{SF}/labels.parquet"))
    good = run("quality", docs)
    scores = {r["doc_id"]: r["score"] for r in quality.with_score(docs, model).collect()}
    assert set(rows(good)) == {i for i, s in scores.items() if s >= 0.7} and good.columns == docs.columns

    prints = {i: slow_fingerprint(r["text"]) for i, r in rows(good).items()}
    links = [(a, b) for a in prints for b in prints if a < b and (prints[a] ^ prints[b]).bit_count() <= 3]
    unique = run("near_duplicates", good)
    assert set(rows(unique)) == {i for i, root in groups(prints, links).items() if i == root} and unique.columns == docs.columns

    clean = run("decontamination", unique)
    bad = {i for i, *_ in slow_containment([(i, r["text"]) for i, r in rows(unique).items()], items)}
    assert set(rows(clean)) == set(rows(unique)) - bad and clean.columns == docs.columns

    private = run("personal_data", clean)
    assert private.columns == docs.columns
    before, after = rows(clean), rows(private)
    for i, r in after.items():
        spans = base_spans(before[i]["text"])
        assert all(before[i]["text"][a:b] not in r["text"] for _, a, b in spans)
        assert spans or "[SECRET]" in r["text"] or "[IBAN]" in r["text"] or "[SSN]" in r["text"] or r["text"] == before[i]["text"]
        assert r["n_chars"] == len(r["text"])

    ranks = {base64.b64decode(a): int(b) for a, b in map(bytes.split, open(P.path("byte_bpe_50k.tiktoken"), "rb"))}
    enc = tiktoken.Encoding("own", pat_str=P.PATTERN, mergeable_ranks=ranks, special_tokens={})
    tokens = rows(run("tokens", private))
    assert set(tokens) == set(after)
    for i, r in tokens.items():
        assert r["ids"] == enc.encode_ordinary(after[i]["text"]) and r["text"] == after[i]["text"] and r["n_tokens"] == len(r["ids"])


def test_whole_run(spark):
    assert corpus_pipeline.run(spark, SF).count() > 0


def test_stages_on_odd_rows(spark):
    """Each stage's rows, for null ids and texts, empty and repeated rows, a very long text, clashing columns."""
    long = "a b " * 20000
    rows = [(1, None, None, None, None), (None, "x", "en", "s", 1), (2, "", "en", "s", 0), (2, "", "en", "s", 0), (3, long, "en", "s", 80000), (4, "mail a.b@c.org, 10.0.0.4 111 1111 1111 1111 z", "en", "s", 9)]
    odd = spark.createDataFrame([(*r, "i", 7) for r in rows], "doc_id long, text string, lang string, source string, n_chars long, ids string, fp int")
    stages = dict(corpus_pipeline.STAGES)

    def got(name):
        out = stages[name](spark, odd, SF)
        assert stages[name](spark, odd.limit(0), SF).count() == 0, name
        if name != "tokens":
            assert out.columns == odd.columns, name
        return sorted(((r["doc_id"], r["text"], r) for r in out.collect()), key=lambda x: (x[0] is None, x[0] or 0))

    model = quality.fit(odd, spark.read.parquet(f"{SF}/labels.parquet"))
    kept = sorted((r["doc_id"] is None, r["doc_id"] or 0) for r in quality.with_score(odd, model).collect() if r["score"] >= quality.THRESHOLD)
    assert [(i is None, i or 0) for i, *_ in got("quality")] == kept
    assert [(i, t) for i, t, _ in got("near_duplicates")] == [(1, None), (3, long), (4, rows[5][1]), (None, "x")]
    assert [i for i, *_ in got("decontamination")] == [1, 2, 2, 3, 4, None]
    private = got("personal_data")
    assert [(i, t) for i, t, _ in private] == [(1, None), (2, ""), (2, ""), (3, long), (4, "mail [EMAIL], [IP] z"), (None, "x")]
    assert [r["n_chars"] for *_, r in private] == [None, 0, 0, len(long), 20, 1]
    tokens = got("tokens")
    assert [(i, t) for i, t, _ in tokens] == [(i, t or "") for i, t in sorted(((r[0], r[1]) for r in rows), key=lambda x: (x[0] is None, x[0] or 0))]
    assert all(r["n_tokens"] == len(r["ids"]) for *_, r in tokens)


def test_nothing_but_the_result_is_left(spark):
    """Stage tables go as soon as the next stage is stored."""
    import glob

    before = set(glob.glob(f"{shared_dir(spark).removeprefix('file:')}/**/stage-*", recursive=True))
    assert corpus_pipeline.run(spark, SF).count() > 0
    left = set(glob.glob(f"{shared_dir(spark).removeprefix('file:')}/**/stage-*", recursive=True)) - before
    assert len(left) == 1 and "stage-tokens" in left.pop()
