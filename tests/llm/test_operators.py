"""Each operator against a plain version, on awkward documents and on generated ones."""

import base64
import hashlib
import math
import random
import re

import public_tokenizers
import pytest
from brute import awkward_texts, captures, exact_groups, frame, near_components, removed_bytes, removed_words, rows, token_starts
from pyspark.sql import functions as F

from reqtrail.llm import bpe, exact_dedup, fingerprints, fm_index, minhash, mixing, suffix_doubling, token_files, toxicity, warc
from reqtrail.llm.components import components

DATA = rows(awkward_texts())


@pytest.fixture(scope="module")
def docs(spark):
    return frame(spark, DATA).repartition(3).cache()


@pytest.fixture(scope="module")
def nothing(spark):
    return frame(spark, [])


def by_id(df, *columns):
    return {r["doc_id"]: tuple(r[c] for c in columns) for r in df.collect()}


def dense(seed=2, n=150):
    """Documents of a few words, edited copies of one another, so that groups, chains and shared passages abound."""
    rng = random.Random(seed)
    words = [f"w{k}" for k in range(60)]
    bases = [[rng.choice(words) for _ in range(rng.randint(5, 160))] for _ in range(12)]
    out = []
    for i in range(n):
        w = list(rng.choice(bases))
        for _ in range(rng.choice([0, 0, 1, 1, 2, 5, 12])):
            at = rng.randrange(len(w))
            w[at : at + rng.choice([0, 1, 1, 3])] = [rng.choice(words)] * rng.choice([0, 1, 1, 2])
            w = w or ["w"]
        out.append((i * 3 % 451, " ".join(w), "en", "s", 0))
    return out


def test_exact_dedup(docs):
    assert by_id(exact_dedup.duplicate_groups(docs), "keep_id", "group_size", "kept", "text_sha256") == exact_groups(DATA)


def test_exact_dedup_keeps_columns(docs):
    kept = exact_dedup.drop_copies(docs)
    assert kept.columns == docs.columns
    assert {r["doc_id"] for r in kept.select("doc_id").collect()} == {i for i, v in exact_groups(DATA).items() if v[2]}


def test_exact_dedup_by_row(spark):
    """One row of each text stays, whatever its id: null, repeated with other texts, or repeated with the same."""
    data = [
        (None, "a b", "en", "s", 0), (1, "a  b", "en", "s", 0), (None, "own", "en", "s", 0), (None, None, "en", "s", 0), (None, " ", "en", "s", 0),
        (2, "c", "en", "s", 0), (3, "c", "en", "s", 0), (3, "unique", "en", "s", 0), (4, "same", "en", "s", 0), (4, "same", "en", "s", 0), (4, "sa me", "en", "s", 0),
    ]
    kept = exact_dedup.drop_copies(frame(spark, data).repartition(3))
    got = sorted(((r["doc_id"], r["text"]) for r in kept.collect()), key=str)
    assert got == sorted([(1, "a  b"), (None, "own"), (None, " "), (2, "c"), (3, "unique"), (4, "sa me")], key=str)


@pytest.mark.parametrize("prefix", [b"", b"<", b"one common beginning of all texts"])
def test_patricia_spills(tmp_path, prefix):
    """Spills of spills, behind one first byte too, leave the same owners, hold about the limit and no file."""
    rng = random.Random(1)
    texts = [prefix + bytes(rng.choice(b"abc") for _ in range(rng.randint(0, 12))) for _ in range(3000)]
    made, most = [], 0
    make = exact_dedup.spills(f"file://{tmp_path}/spill")
    small, want = exact_dedup.Patricia(limit=40_000, files=lambda: made.append(make()) or made[-1]), {}
    for k, t in enumerate(texts):
        small.insert(t, (len(t), k))
        most = max(most, small.held)
        n, owner = want.get(t, (0, k))
        want[t] = (n + 1, min(owner, k))
    got = [(t, (n, o[1])) for t, o, n in small.items()]
    assert len(got) == len(want) and dict(got) == want
    assert len(made) > 2 and most < 50_000 and not list((tmp_path / "spill").iterdir())
    assert any(x.floor > len(prefix) for x in made)


CLASHES = ("_n", "_rate", "_cdf", "_source", "_gone", "_copy", "_order", "_least", "_first", "_row", "n", "d1", "sketch", "_points", "_length", "_rank", "_count", "_keep", "c0", "_whole", "doc id.x")


def test_rows_pass_through(spark):
    """Operators that keep rows keep every column, whatever its name; their columns come back as they were."""
    data = [(1, "a b c d e f", "en", "s", 1), (2, "a b c d e f", "en", "s", 1), (3, "other text", "fr", None, 2), (None, "a b c d e f", "en", "t", 1)]
    docs = frame(spark, data, extra=False).select("*", *[F.lit(k).alias(c) for k, c in enumerate(CLASHES)])
    labels = spark.createDataFrame([(1, 0)], "doc_id bigint, toxic int")
    for f, ids in ((exact_dedup.drop_copies, {1, 3}), (minhash.drop_near_copies, {1, 3}), (lambda d: toxicity.drop_toxic(d, labels), {1, 2, 3, None}), (mixing.mixed_rows, None)):
        out = f(docs)
        assert out.columns == docs.columns
        got = out.collect()
        assert all(tuple(r)[5:] == tuple(range(len(CLASHES))) for r in got)
        assert ids is None or {r["doc_id"] for r in got} == ids
        assert f(docs.limit(0)).count() == 0
    assert mixing.mixed_query(docs).columns == ["doc_id", "text", "lang", "source", "n_chars", "copy", "shuffle_key"]
    again = mixing.mixed_documents(docs)
    assert sorted(again.columns) == sorted(docs.columns)
    for f in (exact_dedup.duplicate_groups, minhash.near_duplicates, fm_index.repeated_words, suffix_doubling.repeated_bytes, bpe.token_digests, token_files.round_trip, fingerprints.edited_likeness):
        assert f(docs).count() == len(data)


def test_near_copies_by_row(spark):
    """One row of each group stays, whatever its id: null, repeated with other texts, or repeated with the same."""
    base = " ".join(f"w{k}" for k in range(80))
    data = [(None, base, "en", "s", 0), (None, base + " x", "en", "s", 0), (None, "own words of its own here", "en", "s", 0), (4, base + " y", "en", "s", 0), (4, "another text that repeats an id only", "en", "s", 0), (5, "twice the same row of text", "en", "s", 0), (5, "twice the same row of text", "en", "s", 0), (7, None, "en", "s", 0), (8, " ", "en", "s", 0)]
    kept = minhash.drop_near_copies(frame(spark, data).repartition(3))
    got = sorted(((r["doc_id"], r["text"]) for r in kept.collect()), key=str)
    assert got == sorted([(None, data[2][1]), (4, base + " y"), (4, data[4][1]), (5, data[5][1]), (7, None), (8, " ")], key=str)
    out = sorted(((r["doc_id"], r["component_id"], r["kept"]) for r in minhash.near_duplicates(frame(spark, data)).collect()), key=str)
    assert out == sorted([(None, 4, False), (None, 4, False), (None, None, True), (4, 4, True), (4, 4, True), (5, 5, True), (5, 5, True), (7, 7, True), (8, 8, True)], key=str)


def test_near_duplicates(docs):
    assert by_id(minhash.near_duplicates(docs), "n_shingles", "component_id", "kept") == near_components(DATA)


def test_near_duplicates_dense(spark):
    data = dense()
    assert by_id(minhash.near_duplicates(frame(spark, data)), "n_shingles", "component_id", "kept") == near_components(data)


def test_near_duplicates_blocks(spark, monkeypatch):
    """Lists that need several blocks give the same components."""
    monkeypatch.setattr(minhash, "BLOCK_BYTES", 12_000)
    data = dense(9, 120)
    assert by_id(minhash.near_duplicates(frame(spark, data)), "n_shingles", "component_id", "kept") == near_components(data)


def test_components(spark):
    links = [(5, 4), (4, 9), (9, 2), (7, 8), (8, 8), (100, 7), (2, 5), (2, 5)]
    got = dict(components(spark.createDataFrame(links, "a bigint, b bigint")).collect())
    assert got == {4: 2, 5: 2, 9: 2, 8: 7, 100: 7}
    chain = [(k, k + 1) for k in range(50)]
    assert {r[1] for r in components(spark.createDataFrame(chain, "a bigint, b bigint")).collect()} == {0}


def test_substring_dedup(docs):
    assert by_id(fm_index.repeated_words(docs), "n_words", "n_removed", "kept_sha256") == removed_words(DATA)


def test_substring_dedup_dense(spark):
    data = dense(4)
    assert by_id(fm_index.repeated_words(frame(spark, data)), "n_words", "n_removed", "kept_sha256") == removed_words(data)


def test_suffix_dedup(docs):
    assert by_id(suffix_doubling.repeated_bytes(docs), "n_bytes", "n_removed", "n_spans", "kept_sha256") == removed_bytes(DATA)


def test_suffix_dedup_dense(spark):
    data = dense(6)
    assert by_id(suffix_doubling.repeated_bytes(frame(spark, data)), "n_bytes", "n_removed", "n_spans", "kept_sha256") == removed_bytes(data)


@pytest.mark.parametrize("limit", [1, 3])
def test_hot_keys(spark, monkeypatch, limit):
    """Keys with more segments than a search takes are searched by pairs of blocks, with the same rows."""
    from reqtrail.llm import repeats

    monkeypatch.setattr(repeats, "MOST_SEGMENTS", limit)
    data = dense(8, 80)
    assert by_id(fm_index.repeated_words(frame(spark, data)), "n_words", "n_removed", "kept_sha256") == removed_words(data)
    assert by_id(suffix_doubling.repeated_bytes(frame(spark, data)), "n_bytes", "n_removed", "n_spans", "kept_sha256") == removed_bytes(data)


def test_long_texts(spark, monkeypatch):
    """Texts of many steps come in pieces, with the same rows; a word longer than a step stays whole."""
    import tiktoken

    from reqtrail.llm import common, pretokens, repeats

    for module, name in ((common, "STEP_BYTES"), (repeats, "STEP_BYTES"), (pretokens, "PART_BYTES")):
        monkeypatch.setattr(module, name, 1500)
    for f in (common.steps, common.white_cuts):
        monkeypatch.setattr(f, "__defaults__", (1500,))
    rng = random.Random(12)
    say = lambda n: " ".join(rng.choice(["alpha", "be", "gamma's", "d", "été", "42", "x-y", "  ", "\n\n", "中文"]) + str(rng.randrange(60)) for _ in range(n))
    long = say(3000)
    data = rows([long, say(900) + long[4000:9000] + say(900), long[:12000] + "y" * 5000 + long[12000:], "x" * 4000, say(20), None, "", say(2500) + "\u00a0 \u2003 " * 300 + "end", long.upper()])
    docs = frame(spark, data).repartition(2)
    assert by_id(minhash.near_duplicates(docs), "n_shingles", "component_id", "kept") == near_components(data)
    assert by_id(fm_index.repeated_words(docs), "n_words", "n_removed", "kept_sha256") == removed_words(data)
    assert by_id(suffix_doubling.repeated_bytes(docs), "n_bytes", "n_removed", "n_spans", "kept_sha256") == removed_bytes(data)
    # Workers have their own modules, so the pieces are tried here.
    import numpy as np
    import pyarrow as pa

    ranks = {base64.b64decode(a): int(b) for a, b in map(bytes.split, open(public_tokenizers.path("byte_bpe_50k.tiktoken"), "rb"))}
    plain = tiktoken.Encoding("own", pat_str=public_tokenizers.PATTERN, mergeable_ranks=ranks, special_tokens={})
    words = pretokens.Dictionary(bpe.merges(public_tokenizers.path("byte_bpe_50k.tiktoken")).replay)
    texts = [r[1] for r in data]
    for i, j, got, first in words.blocks(*common.string_buffers(pa.array(texts))):
        for k in range(i, j):
            assert words.gather(got[first[k - i] : first[k - i + 1]])[0].tolist() == plain.encode_ordinary(texts[k] or "")
    part = pa.array(texts)
    sets = list(minhash.shingle_sets(*common.string_buffers(part)))
    monkeypatch.undo()
    assert all(np.array_equal(a, b) for a, b in zip(sets, minhash.shingle_sets(*common.string_buffers(part)), strict=True))


def test_texts_of_several_steps(spark):
    """Texts of megabytes, which workers read in pieces: the same rows as plain versions give."""
    import tiktoken
    from tokenizers import Tokenizer

    from reqtrail.llm import common

    rng = random.Random(8)
    long = " ".join(f"{rng.choice('abcdefghij')}{rng.choice(['', 'é', '-x'])}{rng.randrange(3000)}" for _ in range(400_000))
    assert len(long.encode()) > 2.2 * common.STEP_BYTES
    data = rows([long, "intro " + long[200_000:1_300_000] + " outro", long[:30_000] + "z" * 1_500_000, "short", long + " end"])
    docs = frame(spark, data).repartition(2)
    assert by_id(minhash.near_duplicates(docs), "n_shingles", "component_id", "kept") == near_components(data)
    assert by_id(fm_index.repeated_words(docs), "n_words", "n_removed", "kept_sha256") == removed_words(data)
    texts = [r[1].encode() for r in data]
    count = {}
    for t in texts:
        for k in range(len(t) - 199):
            h = hash(t[k : k + 200])
            count[h] = count.get(h, 0) + 1
    want = {}
    for i, t in enumerate(texts):
        change = [0] * (len(t) + 1)
        for k in range(len(t) - 199):
            if count[hash(t[k : k + 200])] > 1:
                change[k] += 1
                change[k + 200] -= 1
        depth, spans, kept = 0, 0, bytearray()
        for k, c in enumerate(t):
            spans += not depth and change[k] > 0
            depth += change[k]
            if not depth:
                kept.append(c)
        want[i] = (len(t), len(t) - len(kept), spans, hashlib.sha256(kept).hexdigest())
    assert by_id(suffix_doubling.repeated_bytes(docs), "n_bytes", "n_removed", "n_spans", "kept_sha256") == want
    ranks = {base64.b64decode(a): int(b) for a, b in map(bytes.split, open(public_tokenizers.path("byte_bpe_50k.tiktoken"), "rb"))}
    plain = tiktoken.Encoding("own", pat_str=public_tokenizers.PATTERN, mergeable_ranks=ranks, special_tokens={})
    few = [data[k] for k in (1, 3, 4)]
    ids = {i: plain.encode_ordinary(t) for i, t, *_ in few}
    some = docs.filter("doc_id IN (1, 3, 4)")
    assert by_id(bpe.token_digests(some), "n_tokens", "ids_sha256") == {i: (len(x), hashlib.sha256(" ".join(map(str, x)).encode()).hexdigest()) for i, x in ids.items()}
    library = Tokenizer.from_file(public_tokenizers.path("byte_bpe_50k.json"))
    assert by_id(token_files.round_trip(some), "start", "n_tokens", "ids_crc32") == token_starts(few, lambda t: library.encode(t, add_special_tokens=False).ids)
    assert by_id(exact_dedup.duplicate_groups(docs), "keep_id", "group_size", "kept", "text_sha256") == exact_groups(data)
    assert by_id(fingerprints.fingerprints(docs), "fingerprint") == {i: (",".join(retained(t)),) for i, t, *_ in data}


def test_forests():
    """In a task: the same components as all links between similar sets give, with fewer links than sets."""
    import numpy as np

    rng = np.random.default_rng(4)
    for trial in range(6):
        bases = [np.unique(rng.integers(1, 2**63, rng.integers(5, 400), dtype=np.uint64)) for _ in range(4)]
        sets = []
        for _ in range(60):
            base = bases[rng.integers(len(bases))]
            kept = base[rng.random(len(base)) > rng.choice([0, 0.05, 0.12, 0.2])]
            sets.append(np.unique(np.concatenate([kept, rng.integers(1, 2**63, rng.integers(0, 1 + len(base) // 8), dtype=np.uint64)])))
        label = np.arange(len(sets)) if trial % 2 else rng.integers(0, 40, len(sets))
        side = rng.integers(0, 2, len(sets)) if trial > 2 else None
        left, right = (side == 0, side == 1) if side is not None else (np.ones(60, bool), np.ones(60, bool))
        a, b = minhash.similar(sets, label, left, right)

        def joined(links, label=label):
            up = label.copy()
            for x, y in links:
                up[up == up[x]] = up[y]
            return [tuple(np.flatnonzero(up == u)) for u in np.unique(up)]

        want = []
        for x in range(60):
            for y in range(60):
                both = len(np.intersect1d(sets[x], sets[y]))
                if x != y and (left[x] and right[y]) and 100 * both >= 75 * (len(sets[x]) + len(sets[y]) - both):
                    want.append((x, y))
        assert sorted(joined(zip(a, b, strict=True))) == sorted(joined(want)) and len(a) < 60
        assert set(zip(a.tolist(), b.tolist(), strict=True)) <= set(want)


def oracle(sql, data):
    duckdb = pytest.importorskip("duckdb")
    import pyarrow as pa

    names = ["doc_id", "text", "lang", "source", "n_chars"]
    con = duckdb.connect()
    con.register("documents", pa.table([pa.array(list(c)) for c in zip(*data, strict=True)], names))
    return con.execute(sql).fetchall(), [x[0] for x in con.description]


@pytest.mark.parametrize("module,query", [(fingerprints, fingerprints.edited_likeness), (minhash, minhash.near_duplicates), (exact_dedup, exact_dedup.duplicate_groups), (fm_index, fm_index.repeated_words), (suffix_doubling, suffix_doubling.repeated_bytes)])
def test_sql(docs, module, query):
    """The registered SQL gives the same rows."""
    want, names = oracle(module.ORACLE_SQL, DATA)
    out = query(docs)
    assert sorted(names) == sorted(out.columns)
    assert sorted(tuple(r) for r in out.select(*names).collect()) == sorted(want)


def test_token_files(spark, docs):
    from tokenizers import Tokenizer

    plain = Tokenizer.from_file(public_tokenizers.path("byte_bpe_50k.json"))
    assert by_id(token_files.round_trip(docs), "start", "n_tokens", "ids_crc32") == token_starts(DATA, lambda t: plain.encode(t, add_special_tokens=False).ids)


def test_token_files_added_tokens(spark):
    """Strings of added tokens in a text have the ids that the plain library gives them."""
    from tokenizers import Tokenizer

    end = "<|endoftext|>"
    texts = [f"one {end} two", end, end * 3, f" {end}  x{end}\n\n", f"it{end}'s  {end}'ll", "no <|endoftext| here", "split <|endof", "text|> in rows", f"<|endof{end}text|>", f"é{end}中 {end}", None, "plain"]
    data = rows(texts)
    plain = Tokenizer.from_file(public_tokenizers.path("byte_bpe_50k.json"))
    ids = lambda t: plain.encode(t, add_special_tokens=False).ids
    assert ids(texts[0]) == [505, 220, 50256, 734]
    assert by_id(token_files.round_trip(frame(spark, data)), "start", "n_tokens", "ids_crc32") == token_starts(data, ids)


def test_token_blocks(spark, docs, monkeypatch):
    """Many small blocks and checkpoints decode to the same ids."""
    import numpy as np

    rng = np.random.default_rng(1)
    counts = np.maximum(0, rng.zipf(1.3, 3000) % 100_000 - 1)
    lengths = token_files.code_lengths(counts)
    used = np.flatnonzero(counts)
    assert (lengths[used] > 0).all() and lengths.max() <= token_files.LIMIT and sum(2.0 ** -lengths[used].astype(float)) <= 1
    code = token_files.Code(lengths)
    for n in (0, 1, 511, 512, 513, 5000):
        ids = rng.choice(used, n)
        block = token_files.write_block(code, np.array([5, 6]), np.array([0, 1]), np.array([n, 0]), ids)
        doc_ids, nulls, sizes, back = token_files.read_block(code, block)
        assert back.tolist() == ids.tolist() and sizes.tolist() == [n, 0] and nulls.tolist() == [False, True]


def test_code_lengths_are_optimal():
    import heapq

    import numpy as np

    counts = np.array([5, 9, 12, 13, 16, 45, 0, 1])
    heap = [(int(c), k, 0) for k, c in enumerate(counts) if c]
    cost, heap2 = 0, [c for c, *_ in heap]
    heapq.heapify(heap2)
    while len(heap2) > 1:
        a = heapq.heappop(heap2) + heapq.heappop(heap2)
        cost += a
        heapq.heappush(heap2, a)
    assert int((token_files.code_lengths(counts) * counts).sum()) == cost
    assert token_files.code_lengths(np.array([0, 7])).tolist() == [0, 1]
    assert max(token_files.code_lengths(2 ** np.arange(10), limit=4)) == 4


def test_bpe(docs):
    import tiktoken

    ranks = {base64.b64decode(a): int(b) for a, b in map(bytes.split, open(public_tokenizers.path("byte_bpe_50k.tiktoken"), "rb"))}
    plain = tiktoken.Encoding("own", pat_str=public_tokenizers.PATTERN, mergeable_ranks=ranks, special_tokens={})
    want = {}
    for i, t, *_ in DATA:
        ids = plain.encode_ordinary(t or "")
        want[i] = (len(ids), hashlib.sha256(" ".join(map(str, ids)).encode()).hexdigest(), hashlib.sha256((t or "").encode()).hexdigest())
    assert by_id(bpe.token_digests(docs), "n_tokens", "ids_sha256", "decoded_sha256") == want
    back = {r["doc_id"]: bytes(r["decoded"]).decode() for r in bpe.decoded(bpe.encoded(docs)).collect()}
    assert back == {i: t or "" for i, t, *_ in DATA}


def test_fingerprints(docs):
    want = {}
    order = sorted(DATA, reverse=True)
    for k, (i, t, *_) in enumerate(order):
        t, following = t or "", order[(k + 1) % len(order)][1] or ""
        half = len(t) // 2
        want[i] = (len(t), hashlib.sha256((t[: len(t) - half] + following[:half]).encode()).hexdigest())
    out = fingerprints.edited_likeness(docs).collect()
    assert {r["doc_id"]: (r["n_chars"], r["edited_sha256"]) for r in out} == want
    texts = {i: t or "" for i, t, *_ in DATA}
    prints = {}
    for r in out:
        assert prints.setdefault(texts[r["doc_id"]], r["fingerprint"]) == r["fingerprint"]
        assert 0 <= r["near_edited"] <= 1 and 0 <= r["near_next"] <= 1


def test_fingerprint_ranges(spark, monkeypatch):
    """Ranges of ids, however small, give each row the same next row; one row is its own next."""
    from reqtrail.llm import common

    monkeypatch.setattr(common, "RANGE_BYTES", 2000)
    data = [(i * i, f"text {i} " * (i % 9 + 3), "en", "s", 0) for i in range(120)]
    order = sorted(data, reverse=True)
    want = {}
    for k, (i, t, *_) in enumerate(order):
        half = len(t) // 2
        want[i] = (hashlib.sha256((t[: len(t) - half] + order[(k + 1) % len(order)][1][:half]).encode()).hexdigest(),)
    assert by_id(fingerprints.edited_likeness(frame(spark, data)), "edited_sha256") == want
    assert by_id(fingerprints.edited_likeness(frame(spark, data[4:5])), "near_next") == {16: (1.0,)}
    some = [(None if i % 10 == 0 else i, t, *r) for i, t, *r in data]
    assert fingerprints.edited_likeness(frame(spark, some)).count() == len(some)


def retained(text):
    words = [w for w in re.split("[\x20\x09-\x0d]+", text or "") if w]
    runs = [" ".join(words)] if 0 < len(words) < 5 else [" ".join(words[k : k + 5]) for k in range(len(words) - 4)]
    return sorted({h[:16] for h in (hashlib.md5(r.encode()).hexdigest() for r in runs) if h[0] < "4"})


def test_fingerprint_values(spark, docs):
    """Fingerprints and likenesses against plain Python."""
    texts = {i: t or "" for i, t, *_ in DATA}
    order = sorted(texts, reverse=True)
    for r in fingerprints.edited_likeness(docs).collect():
        t, u = texts[r["doc_id"]], texts[order[(order.index(r["doc_id"]) + 1) % len(order)]]
        edited = t[: len(t) - len(t) // 2] + u[: len(t) // 2]
        assert (r["fingerprint"], r["edited_fingerprint"]) == (",".join(retained(t)), ",".join(retained(edited)))
        for got, other in ((r["near_edited"], edited), (r["near_next"], u)):
            a, b = set(retained(t)), set(retained(other))
            assert got == (1.0 if t == other else len(a & b) / min(len(a), len(b)) if a and b else 0.0)


def test_fingerprint_merge(spark):
    """The sketch of a union is the union of the sketches, by column and by group; containment of a part is 1."""
    rng = random.Random(3)
    words = [f"v{rng.randrange(10**6)}" for _ in range(6000)]
    a, b = " ".join(words[:1500]), " ".join(words[1496:])
    out = spark.createDataFrame([(a, b, " ".join(words))], "a string, b string, both string").select(*[fingerprints.sketch(F.col(c)).alias(c) for c in ("a", "b", "both")])
    got = out.select(fingerprints.merge(F.col("a"), F.col("b")).alias("m"), "both", fingerprints.containment(F.col("a"), F.col("both")).alias("c"), fingerprints.containment(F.col("both"), F.col("a")).alias("d")).first()
    assert got["m"] == got["both"] == retained(" ".join(words)) and got["c"] == 1.0 and abs(got["d"] - 0.25) < 0.05
    each = spark.createDataFrame([(1, a), (1, b), (2, a), (2, a), (3, "")], "g int, text string").select("g", fingerprints.sketch(F.col("text")).alias("sketch"))
    assert {r["g"]: r["sketch"] for r in fingerprints.merged(each, ["g"]).collect()} == {1: got["both"], 2: retained(a), 3: []}


def test_mixing(spark, docs):
    duckdb = pytest.importorskip("duckdb")
    con = duckdb.connect()
    table = docs.select("doc_id", "text", "lang", "source", "n_chars").toPandas()
    con.register("documents", table.where(table.notna(), None))
    want = con.execute(f"SELECT doc_id, copy, shuffle_key FROM ({mixing.ORACLE_SQL}) ORDER BY 1, 2").fetchall()
    got = [tuple(r) for r in mixing.mixed_query(docs).select("doc_id", "copy", "shuffle_key").orderBy("doc_id", "copy").collect()]
    assert got == want
    assert mixing.mixed_documents(docs.drop("_order", "_copy")).columns[-2:] == ["_copy", "_order"]


def test_mixing_weights(spark):
    data = [(i, "x" * 100, "en", "a" if i % 3 else "b", 100) for i in range(6000)]
    out = dict(mixing.mixed_documents(frame(spark, data, extra=False), {"a": 1.0, "b": 3.0}, epochs=2.0).groupBy("source").count().collect())
    assert abs(out["a"] / 3000 - 1) < 0.1 and abs(out["b"] / 9000 - 1) < 0.1
    few = mixing.mixed_documents(frame(spark, data, extra=False), {"a": 1.0})
    assert {r[0] for r in few.select("source").distinct().collect()} == {"a"}


def test_mixing_many_sources(spark, monkeypatch):
    data = [(i, "words", "en", f"s{i % 50}", 5) for i in range(500)]
    few = sorted(tuple(r) for r in mixing.mixed_documents(frame(spark, data, extra=False)).select("doc_id", "_copy").collect())
    monkeypatch.setattr(mixing, "BROADCAST_SOURCES", 3)
    assert few == sorted(tuple(r) for r in mixing.mixed_documents(frame(spark, data, extra=False)).select("doc_id", "_copy").collect())


def test_mixing_large_rates(spark, monkeypatch):
    """Counts at rates where exp(-rate) vanishes are those of the inverse distribution function; copies are numbered through."""
    monkeypatch.setattr(mixing, "COPIES", 300)
    data = [(1, "x" * 10, "en", "small", 10), (2, "y" * 10, "en", None, 10), (3, "z" * 40_000, "en", "large", 40_000), (4, "w", "en", "least", 1)]
    size = {"small": 10, "": 10, "large": 40_000, "least": 1}
    want = {}
    for i, _, _, source, _ in data:
        rate = 40_021 / (4 * size[source or ""])
        u = int(hashlib.md5(f"mix-1:{i}".encode()).hexdigest()[:13], 16) / 2**52
        k, c = -1, 0.0
        while c <= u:
            k += 1
            c += math.exp(k * math.log(rate) - rate - math.lgamma(k + 1))
        want[i] = k
    assert want[1] > 700 and want[4] > 9000
    got = {}
    for r in mixing.mixed_documents(frame(spark, data, extra=False)).select("doc_id", "_copy").collect():
        got.setdefault(r["doc_id"], []).append(r["_copy"])
    assert {i: sorted(v) for i, v in got.items()} == {i: list(range(n)) for i, n in want.items() if n}
    rows_, names = oracle(mixing.ORACLE_SQL, data)
    assert sorted((r[names.index("doc_id")], r[names.index("copy")]) for r in rows_) == sorted((i, k) for i, n in want.items() for k in range(n))


def test_mixing_null_source(spark):
    """A null source and one of the name '' are two sources."""
    data = [(i, "x" * 100, "en", None if i % 2 else "", 100) for i in range(400)]
    out = mixing.mixed_documents(frame(spark, data, extra=False), {None: 1.0})
    assert {r[0] for r in out.select("source").distinct().collect()} == {None}
    assert mixing.rates(frame(spark, data, extra=False)).count() == 2


def test_toxicity(spark):
    rng = random.Random(7)
    plain = ["bread", "house", "river", "walk", "green", "table", "music", "stone", "class", "great"]
    bad = ["blarg", "fnord", "grumpf"]
    spell = {"o": "0", "a": "4", "r": "r", "u": "u"}
    data, labels = [], []
    for i in range(1500):
        toxic = rng.random() < 0.2
        words = [rng.choice(plain) for _ in range(rng.randint(5, 60))]
        if toxic:
            for _ in range(2):
                w = rng.choice(bad)
                words.insert(rng.randrange(len(words)), "".join(spell.get(c, c) for c in w) if rng.random() < 0.3 else w.upper() if rng.random() < 0.5 else w)
        data.append((i, " ".join(words), "en", "s", 0))
        labels.append((i, int(toxic)))
    data += [(5000, None, "en", "s", 0), (5001, "", "en", "s", 0), (5002, "bl4rg fn0rd you grumpf", "en", "s", 0), (5003, "blаrg blаrg fnоrd", "en", "s", 0)]
    marks = spark.createDataFrame([*labels, (None, 1), (77, None)], "doc_id bigint, toxic int")
    docs = frame(spark, data)
    model = toxicity.learn(docs, marks)
    out = {r["doc_id"]: r for r in toxicity.toxicity_scores(docs, model).collect()}
    held = [(out[i]["predicted"], t) for i, t in labels if out[i]["held_out"]]
    assert len(held) > 200 and sum(a == b for a, b in held) / len(held) > 0.99
    assert [out[k]["predicted"] for k in (5000, 5001, 5002, 5003)] == [0, 0, 1, 1]
    kept = toxicity.drop_toxic(docs, marks)
    assert kept.columns == docs.columns and kept.count() == sum(not r["predicted"] for r in out.values())


def test_toxicity_learns_from_shared_passages(spark):
    """Rows that share a passage, whichever shingle is least, all count; near copies count once, by the smallest id."""
    rng = random.Random(11)
    passage = " ".join(f"licence{k}" for k in range(40))
    own = [(10 + i, passage + " " + " ".join(f"w{rng.randrange(10**6)}" for _ in range(30)), 0) for i in range(40)]
    copies = [(100 + i, "  ".join(own[0][1].split()) + " end" * (i % 2), 0) for i in range(6)]
    sample = spark.createDataFrame([(t, y, i) for i, t, y in own + copies], "_text string, _toxic int, doc_id bigint")
    assert sorted(r["_text"] for r in toxicity.one_of_copies(sample).collect()) == sorted(t for _, t, _ in own)


def test_toxicity_exceptions():
    model = toxicity.Lexicon({"blarg": 5.0}, frozenset({("no", "blarg")}), (-2.0, 3.0, 0.0))
    import pyarrow as pa

    from reqtrail.llm.common import string_buffers

    scores = model.scores(*string_buffers(pa.array(["say blarg now", "say no blarg now", "no", None])))
    assert scores[0] > 0.5 and (scores[1:] < 0.5).all()


def test_toxicity_inner_punctuation():
    """Words glued to the one before by punctuation match, and so do words with punctuation strewn in."""
    import pyarrow as pa

    from reqtrail.llm.common import string_buffers

    model = toxicity.Lexicon({"blarg": 5.0}, frozenset({("no", "blarg"), ("blarg", "day")}), (-2.0, 3.0, 0.0))
    bad = ["you,blarg", "end.Blarg", "he/she-bl4rg", "you—blarg", "b.l.a.r.g", "say blarg,day,blarg"]
    good = ["no,blarg", "no blarg/day", "say so,no blarg", "blarg day/night", "oblarg", "you,there"]
    scores = model.scores(*string_buffers(pa.array(bad + good)))
    assert (scores[: len(bad)] > 0.5).all() and (scores[len(bad) :] < 0.5).all()
    sums, _, found = model.measure(*string_buffers(pa.array(["you,blarg/fool,blarg"])))
    assert sums.tolist() == [10.0] and [x[2:] for x in found] == [("you", "fool"), ("fool", "")]


def test_toxicity_plain(spark):
    """Sums and matches against a plain matcher, phrases and exceptions included."""
    import pyarrow as pa

    from reqtrail.llm.common import string_buffers

    rng = random.Random(21)
    weights = {"blar": 2.0, "fnord": 3.0, "go away": 5.0, "blarg he": 7.0, "was": 1.5}
    exceptions = frozenset({("no", "blar"), ("fnord", "day"), ("do", "go away")})
    model = toxicity.Lexicon(weights, exceptions, (-2.0, 1.0, 0.5))
    words = ["blarg", "BLARg", "fnord", "fn0rd", "go", "away", "awayness", "here", "no", "do", "day", "was", "b.l.a.r", "x,fnord", "go-away", "--", "12", "wasp", "oblarg", "!blarg", "fnord!!", "go!", "(!away", "bl!arg", "ÀWAY", "ﬁnord", "blarg|", "|go", "!", "!!.", "w!as", "gо", "x\u00a0fnord", "f\u00adnord", "x\x1cgo"]
    texts = [" ".join(rng.choice(words) for _ in range(rng.randint(0, 30))) for _ in range(300)] + [" ".join(rng.choice(words) for _ in range(rng.randint(1, 3))) for _ in range(1500)] + [None, ""]
    sums, counts, found = model.measure(*string_buffers(pa.array(texts)))
    for k, t in enumerate(texts):
        row, spans = [], []
        for w in re.split("[\x20\x09-\x0d]+", (t or "").strip("\x20\x09\x0a\x0b\x0c\x0d")):
            if not w:
                continue
            f = toxicity.forms(w)
            spans.append((len(row), len(row) + len(f[1:] or f), f[0] if len(f) > 1 else None))
            row += f[1:] or f
        hits = {}
        for a in range(len(row)):
            fits = [(w, x) for x, w in weights.items() if (row[a].startswith(x) if " " not in x else a + 1 < len(row) and row[a] == x.split()[0] and row[a + 1].startswith(x.split()[1]))]
            if fits:
                hits[a] = (*max(fits), a + 1 + max(fits)[1].count(" "))
        for a, b, whole in spans:
            fits = [(w, x) for x, w in weights.items() if whole and whole.startswith(x)]
            if fits and not any(a <= h < b for h in hits):
                hits[a] = (*max(fits), b)
        want = [(x, row[a - 1] if a else "", row[b] if b < len(row) else "", w) for a, (w, x, b) in sorted(hits.items())]
        assert [f[1:] for f in found if f[0] == k] == [x[:3] for x in want]
        assert sums[k] == pytest.approx(sum(w for x, p, q, w in want if (p, x) not in exceptions and (x, q) not in exceptions)) and counts[k] == len([w for w in re.split("[\x20\x09-\x0d]+", t or "") if w])


def test_toxicity_learns_phrases(spark):
    """Two words that insult only together are learned as a phrase, and a phrase around an insult as an exception."""
    rng = random.Random(5)
    plain = [f"word{'abcdefghij'[k % 10]}{'klmnopqrst'[k // 10]}" for k in range(100)]
    data, labels = [], []
    for i in range(2000):
        w = [rng.choice(plain) for _ in range(30)]
        kind = i % 10
        at = rng.randrange(1, 29)
        if kind == 0:
            w[at:at] = ["drop", "dead"]
        elif kind == 1:
            w[at:at] = ["grumpf"]
        elif kind == 2:
            w[at:at] = ["drop", "it"]
        elif kind == 3:
            w[at:at] = ["half", "dead"]
        elif i % 50 == 4:
            w[at:at] = ["mister", "grumpf"]
        data.append((i, " ".join(w), "en", "s", 0))
        labels.append((i, int(kind < 2)))
    docs, marks = frame(spark, data), spark.createDataFrame(labels, "doc_id bigint, toxic int")
    model = toxicity.learn(docs, marks)
    assert "drop dead" in model.weights and ("mister", next(t for t in model.weights if t.startswith("gru"))) in model.exceptions
    out = {r["doc_id"]: r["predicted"] for r in toxicity.toxicity_scores(docs, model).collect()}
    assert sum(out[i] == y for i, y in labels) > 1980


def test_toxicity_without_labels(spark, docs):
    model = toxicity.learn(docs, spark.createDataFrame([], "doc_id bigint, toxic int"))
    assert {r["predicted"] for r in toxicity.toxicity_scores(docs, model).collect()} == {0}


PAGES = [(1, "http://www.example.com/a?b=C", "<p>same</p>"), (2, "https://other.example.org:8080/", "<p>same</p>"), (3, None, "<p>own</p>\r\n\r\nWARC/1.1"), (4, "bad url [", None), (5, "", ""), (6, "http://www.example.com/a?b=C", "é" * 5000), (9, "x\r\ny", "<p>same</p>")]


def test_warc(spark):
    pages = spark.createDataFrame(PAGES, "page_id bigint, url string, html string").withColumn("_digest", F.lit("x")).withColumn("value", F.lit(1))
    out = {r["page_id"]: (r["payload_bytes"], r["payload_digest"], r["record_type"], r["refers_to"]) for r in warc.captures(pages).collect()}
    assert out == captures(PAGES)


def test_warc_sql(spark):
    duckdb = pytest.importorskip("duckdb")
    import pyarrow as pa

    con = duckdb.connect()
    con.register("pages", pa.table([pa.array(list(c)) for c in zip(*PAGES, strict=True)], ["page_id", "url", "html"]))
    want = con.execute(warc.ORACLE_SQL).fetchall()
    out = warc.captures(spark.createDataFrame(PAGES, "page_id bigint, url string, html string"))
    assert sorted(tuple(r) for r in out.select("page_id", "payload_bytes", "payload_digest", "record_type", "refers_to").collect()) == sorted(want)


@pytest.mark.parametrize("local", [True, False])
def test_warc_lookup(spark, monkeypatch, local):
    """Many small archives and blocks; by range reads, and by whole files where Python cannot open the store."""
    from reqtrail.llm import common
    from reqtrail.llm.common import table_path

    monkeypatch.setattr(common, "BROADCAST_BYTES", 0)
    monkeypatch.setattr(warc, "BLOCK_LINES", 2)
    if not local:
        monkeypatch.setattr(warc, "reachable", lambda folder: False)
    pages = spark.createDataFrame(PAGES, "page_id bigint, url string, html string")
    path = table_path(spark, "warc-test")
    warc.write_archives(pages, path, least_bytes=5, archive_bytes=1500)
    warc.write_index(spark, path)
    all_rows = {r["page_id"]: (r["payload_bytes"], r["payload_digest"], r["record_type"], r["refers_to"]) for r in warc.read_records(spark, path).collect()}
    assert all_rows == captures(PAGES, 5)
    found = warc.lookup(spark, path, ["http://www.example.com/a?b=C"]).collect()
    assert sorted(r["page_id"] for r in found) == [1, 6]
    assert next(bytes(r["payload"]).decode() for r in found if r["page_id"] == 6) == "é" * 5000
    assert warc.lookup(spark, path, ["http://nowhere.example/"]).count() == 0
    assert warc.lookup(spark, path, []).count() == 0
    assert sorted(r["page_id"] for r in warc.lookup(spark, path, [None, "bad url ["]).collect()) == [3, 4, 5]


def test_warc_range_reads(spark):
    """A lookup asks for the bytes of its records alone; an archive may hold a page of many megabytes."""
    import pyarrow as pa

    from reqtrail.llm.common import table_path

    big = "<p>" + "0123456789" * 1_200_000
    pages = spark.createDataFrame([(1, "http://a.example/", big), (2, "http://b.example/", "small"), (3, "http://c.example/", "other")], "page_id bigint, url string, html string").coalesce(1)
    path = table_path(spark, "warc-test")
    warc.write_archives(pages, path)
    warc.write_index(spark, path)
    got = {r["page_id"]: r["payload_bytes"] for r in warc.read_records(spark, path).collect()}
    assert got == {1: len(big), 2: 5, 3: 5}
    lines = warc.at_places(spark, f"{path}/index", spark.read.parquet(f"{path}/directory").select("path", "offset", "length"), warc._lines, warc.LINE).toArrow()
    small = min(lines.to_pylist(), key=lambda r: r["length"])
    reader = warc.Reader()
    batch = pa.RecordBatch.from_pylist([small], schema=lines.schema)
    assert [r["payload_bytes"].as_py() for b in [next(warc._parsed(warc.ranges([batch], reader)))] for r in [dict(zip(b.schema.names, (c[0] for c in b.columns), strict=True))]] == [5]
    assert reader.bytes_read == small["length"] < 1000


def test_empty_tables(spark, nothing):
    """No rows in, no rows out."""
    for f in (exact_dedup.duplicate_groups, minhash.near_duplicates, fm_index.repeated_words, suffix_doubling.repeated_bytes, bpe.token_digests, token_files.round_trip, fingerprints.edited_likeness, mixing.mixed_query):
        assert f(nothing).count() == 0, f
    labels = spark.createDataFrame([], "doc_id bigint, toxic int")
    for f in (exact_dedup.drop_copies, minhash.drop_near_copies, mixing.mixed_rows, mixing.mixed_documents, fingerprints.fingerprints, lambda d: toxicity.drop_toxic(d, labels), lambda d: toxicity.toxicity_scores(d, toxicity.learn(d, labels)), lambda d: bpe.decoded(bpe.encoded(d))):
        assert f(nothing).count() == 0, f
    pages = spark.createDataFrame([], "page_id bigint, url string, html string")
    assert warc.captures(pages).count() == 0
    from reqtrail.llm.common import table_path

    path = table_path(spark, "warc-test")
    warc.write_archives(pages, path)
    warc.write_index(spark, path)
    assert warc.lookup(spark, path, ["http://a.example/"]).count() == 0


def test_clear(spark):
    """What the operators wrote can be deleted at once."""
    import os
    from urllib.parse import urlsplit

    from reqtrail.llm import common

    made = common.materialise(spark.range(5), "t")
    folder = urlsplit(common.scratch(spark)).path
    assert made.count() == 5 and os.listdir(folder)
    common.clear(spark)
    assert not os.path.exists(folder)


def test_null_and_repeated_ids(spark):
    """Rows without an id, and rows that repeat one, come through every operator, each as a row with its own values."""
    rng = random.Random(2)
    t = " ".join(f"{rng.choice('abcdefgh')}{k}" for k in range(60))
    data = [(None, t, "en", None, 0), (None, None, None, None, None), (1, t, "en", "s", 0), (1, t, "en", "s", 0), (1, "other text here", "en", "s", 0), (2, None, "en", "s", 0), (None, t + " x", "en", "s", 0)]
    docs = frame(spark, data).repartition(3)
    got = lambda df, *cols: sorted((tuple(r[c] for c in cols) for r in df.collect()), key=str)
    n = len(t.encode())
    sha = lambda x: hashlib.sha256(x.encode()).hexdigest()
    assert got(exact_dedup.duplicate_groups(docs), "doc_id", "keep_id", "group_size", "kept") == sorted(
        [(None, 1, 3, False), (1, 1, 3, True), (1, 1, 3, True), (1, 1, 1, True), (None, 2, 2, False), (2, 2, 2, True), (None, None, 1, True)], key=str)
    assert got(minhash.near_duplicates(docs), "doc_id", "n_shingles", "component_id", "kept") == sorted(
        [(None, 56, 1, False), (1, 56, 1, True), (1, 56, 1, True), (1, 1, 1, True), (None, 0, None, True), (2, 0, 2, True), (None, 57, 1, False)], key=str)
    assert got(fm_index.repeated_words(docs), "doc_id", "n_words", "n_removed", "kept_sha256") == sorted(
        [(None, 60, 60, sha("")), (1, 60, 0, sha(t)), (1, 60, 0, sha(t)), (1, 3, 0, sha("other text here")), (None, 0, 0, sha("")), (2, 0, 0, sha("")), (None, 61, 60, sha("x"))], key=str)
    assert got(suffix_doubling.repeated_bytes(docs), "doc_id", "n_bytes", "n_removed", "n_spans") == sorted(
        [(None, n, n, 1)] + 2 * [(1, n, n, 1)] + [(1, 15, 0, 0), (None, 0, 0, 0), (2, 0, 0, 0), (None, n + 2, n, 1)], key=str)
    decoded = got(bpe.token_digests(docs), "doc_id", "decoded_sha256")
    assert decoded == sorted([(i, sha(x or "")) for i, x, *_ in data], key=str)
    tokens = token_files.round_trip(docs).collect()
    sizes = {r["start"]: r["n_tokens"] for r in tokens}
    assert len(tokens) == len(data) and all(a + sizes[a] in sizes or a == max(sizes) for a in sizes)
    assert [r["doc_id"] for r in sorted(tokens, key=lambda r: r["start"])] == [None, None, None, 1, 1, 1, 2]
    prints = got(fingerprints.edited_likeness(docs), "doc_id", "fingerprint", "n_chars")
    assert prints == sorted([(i, ",".join(retained(x)), len(x or "")) for i, x, *_ in data], key=str)
    model = toxicity.Lexicon({"oth": 5.0}, frozenset(), (-2.0, 3.0, 0.0))
    assert got(toxicity.toxicity_scores(docs, model), "doc_id", "predicted") == sorted([(i, int(x == "other text here")) for i, x, *_ in data], key=str)
    copies = got(mixing.mixed_query(docs), "doc_id", "copy")
    assert all(copies.count(c) == sum(i == c[0] for i, *_ in data) for c in copies if c[0] is not None)
    pages = spark.createDataFrame([(None, "u", "same"), (3, "u", "same"), (3, "v", "same"), (2, None, "same"), (None, None, None), (1, "u", "")], "page_id bigint, url string, html string")
    assert got(warc.captures(pages), "page_id", "payload_bytes", "record_type", "refers_to") == sorted(
        [(None, 4, "response", None), (3, 4, "response", None), (3, 4, "response", None), (2, 4, "revisit", 3), (None, 0, "response", None), (1, 0, "response", None)], key=str)
