"""The pipeline's stages on generated and on awkward documents, each against a plain version."""

import base64
import hashlib
import math
from collections import Counter

import public_tokenizers
import pytest
from brute import awkward_texts, exact_groups, frame, near_components, rows

from reqtrail.llm import toxicity

corpus_pipeline = pytest.importorskip("corpus_pipeline")


def ids_of(text):
    tiktoken = pytest.importorskip("tiktoken")
    if not hasattr(ids_of, "plain"):
        ranks = {base64.b64decode(a): int(b) for a, b in map(bytes.split, open(public_tokenizers.path("byte_bpe_50k.tiktoken"), "rb"))}
        ids_of.plain = tiktoken.Encoding("own", pat_str=public_tokenizers.PATTERN, mergeable_ranks=ranks, special_tokens={})
    return ids_of.plain.encode_ordinary(text or "")


def copies_of(docs):
    """Counts of the mixing stage for (doc_id, text, source) rows."""
    size = Counter()
    for _, text, source in docs:
        size[source] += len(text or "")
    weighed = [s for s in size if size[s]]
    out = {}
    for i, _, source in docs:
        rate = sum(size.values()) / (len(weighed) * size[source]) if size[source] else 0.0
        u = int(hashlib.md5(f"mix-1:{'' if i is None else i}".encode()).hexdigest()[:13], 16) / 2**52
        n, p = 0, math.exp(-rate)
        c = p
        while c <= u and n < 10_000:
            n += 1
            p *= rate / n
            c += p
        out[i] = n
    return out


def held(df):
    return [(r["doc_id"], r["text"], r["source"]) for r in df.collect()]


def against_plain(spark, docs, sf_dir):
    names = [n for n, _ in corpus_pipeline.STAGES]
    assert names == ["toxicity", "exact_dedup", "near_dedup", "mixing", "bpe"]
    stages, columns = dict(corpus_pipeline.STAGES), docs.columns
    before = docs.cache()
    labels = spark.read.parquet(f"{sf_dir}/labels.parquet")
    after = stages["toxicity"](spark, before, sf_dir).cache()
    scores = toxicity.toxicity_scores(before, toxicity.learn(before, labels))
    assert sorted(r[0] for r in held(after)) == sorted(r["doc_id"] for r in scores.filter("predicted = 0").collect()) and after.columns == columns
    for name, kept in (("exact_dedup", lambda d: {i for i, v in exact_groups(d).items() if v[2]}), ("near_dedup", lambda d: {i for i, v in near_components(d).items() if v[2]})):
        before = after
        after = stages[name](spark, before, sf_dir).cache()
        was = held(before)
        assert sorted(held(after), key=str) == sorted((r for r in was if r[0] in kept(was)), key=str) and after.columns == columns
    before, after = after, stages["mixing"](spark, after, sf_dir).cache()
    was = held(before)
    counts = copies_of(was)
    assert Counter(r[0] for r in held(after)) == Counter({i: n for i, n in counts.items() if n}) and after.columns == columns
    out = stages["bpe"](spark, after, sf_dir)
    want = sorted((i, len(ids_of(t)), hashlib.sha256(" ".join(map(str, ids_of(t))).encode()).hexdigest(), hashlib.sha256((t or "").encode()).hexdigest()) for i, t, _ in held(after))
    assert sorted((r["doc_id"], r["n_tokens"], r["ids_sha256"], r["decoded_sha256"]) for r in out.collect()) == want
    return want


def test_stages(spark, sf_dir):
    assert against_plain(spark, spark.read.parquet(f"{sf_dir}/documents.parquet"), sf_dir)


def test_awkward_documents(spark, sf_dir):
    assert against_plain(spark, frame(spark, rows(awkward_texts())).repartition(3), sf_dir)


def test_run(spark, sf_dir):
    """All stages at once give what they give one after the other."""
    docs = spark.read.parquet(f"{sf_dir}/documents.parquet")
    for _, stage in corpus_pipeline.STAGES:
        docs = stage(spark, docs, sf_dir).cache()
    got = sorted((r["doc_id"], r["ids_sha256"]) for r in corpus_pipeline.run(spark, sf_dir).collect())
    assert got == sorted((r["doc_id"], r["ids_sha256"]) for r in docs.collect())


def test_run_on_nothing(spark, tmp_path):
    spark.createDataFrame([], "doc_id bigint, text string, lang string, source string, n_chars bigint").write.parquet(f"{tmp_path}/documents.parquet")
    spark.createDataFrame([], "doc_id bigint, quality int, toxic int").write.parquet(f"{tmp_path}/labels.parquet")
    assert corpus_pipeline.run(spark, str(tmp_path)).count() == 0


def test_run_with_nulls(spark, tmp_path):
    """Nulls in any column, repeated rows and clashing columns pass every stage; each distinct text is seen once before mixing."""
    data = [(None, None, None, None, None), (None, "one text of its own here", None, "a", 5), (1, "one text of its own here", "en", None, 5), (1, "quite another text with that id", "en", "a", 5), (2, "third", "en", "a", 5), (2, "third", "en", "a", 5)]
    docs = frame(spark, data).drop("_order")
    docs.write.parquet(f"{tmp_path}/documents.parquet")
    spark.createDataFrame([(None, 1, 1), (1, None, None), (2, 1, 0)], "doc_id bigint, quality int, toxic int").write.parquet(f"{tmp_path}/labels.parquet")
    now = spark.read.parquet(f"{tmp_path}/documents.parquet")
    for name, stage in corpus_pipeline.STAGES[:3]:
        now = stage(spark, now, str(tmp_path)).cache()
        assert now.columns == docs.columns, name
    assert sorted(((r["doc_id"], r["text"]) for r in now.collect()), key=str) == sorted([(None, None), (1, "one text of its own here"), (1, "quite another text with that id"), (2, "third")], key=str)
    assert corpus_pipeline.run(spark, str(tmp_path)).count() >= 0
