"""Joins, filters, groups, search and scorers."""

import asyncio

import pytest
from pyspark.sql import functions as F

from reqtrail.operators import dictionary, overlap, relations, scorers, search, sizes
from reqtrail.plans import workflow
from reqtrail.schemas import HTTP_COLUMNS, TLS_COLUMNS, dual_filter


@pytest.fixture
def functions(spark):
    rows = [(1, "int send_date(void){ if (server) send(Date); return header; }"), (2, "{ x = 1; }"), (3, None), (4, "server header must")]
    return spark.createDataFrame(rows, "function_id int, source_code string").withColumn("function_name", F.lit("f")).withColumn("file_path", F.lit("p"))


@pytest.fixture
def requirements(spark):
    return spark.createDataFrame([(0, "A server MUST send a Date header"), (1, "server header"), (2, "server header"), (3, None)], "sr_id int, sr string")


@pytest.mark.parametrize("limit", [0, 1000])
def test_overlap(functions, requirements, monkeypatch, limit):
    monkeypatch.setattr(sizes.broadcast_if_small, "__defaults__", (limit,))
    out = {r["function_id"]: r["sr_ids"] for r in workflow.heuristic_candidates(functions, requirements, 2).collect()}
    assert out == {1: [1, 2], 2: [], 3: [], 4: [1, 2]}
    scores = {(r["function_id"], r["sr_id"]): r["score"] for r in overlap.overlap_scores(functions, requirements).collect()}
    assert scores[1, 0] == pytest.approx(0.8) and scores[4, 1] == 1.0 and all(0 < s <= 1 for s in scores.values())


def cells(spark):
    columns = list(HTTP_COLUMNS)
    rows = [
        (1, '["40", "200"]', "[]", None, None, None, "[]"),
        (2, "", "", "", "", "", None),
        (3, None, '["Age", "Host"]', None, '["GET"]', None, '["cache"]'),
        (4, '["999"]', "[]", "[]", "[]", "[]", "[]"),
    ]
    functions = spark.createDataFrame(rows, "function_id int, " + ", ".join(f"{c} string" for c in columns))
    reqs = spark.createDataFrame([(0, "400,404", "Age", "GET,PUT"), (1, "200", None, "HEAD"), (2, None, "Hostile", None)], "sr_id int, status_code string, field_name string, method string")
    return functions, reqs


def test_dictionary_join(spark):
    functions, reqs = cells(spark)
    out = {r["function_id"]: r["matching_sr_ids"] for r in dictionary.dictionary_join(functions, reqs, HTTP_COLUMNS).collect()}
    assert out == {1: [0, 1], 3: [0, 2]}
    typed = {r["function_id"]: r["matching_sr_ids"] for r in dictionary.dictionary_join(functions, reqs, HTTP_COLUMNS, mode="typed").collect()}
    assert typed == {1: [1], 3: [0]}


def test_dictionary_statistics(spark):
    functions, reqs = cells(spark)
    got = dictionary.dictionary_statistics(functions, reqs, HTTP_COLUMNS).first().asDict()
    # 'cache' is checked, but there is no column class.
    assert got == {"total_rows": 4, "rows_with_match": 2, "rows_retained": 2, "keywords_checked": 7, "keywords_matched": 5, "matched_ids": 5, "distinct_matched_ids": 3}


def test_tls_columns(spark):
    functions = spark.createDataFrame([(1, '["alert"]')], "function_id int, SessionManagementAlerts string")
    reqs = spark.createDataFrame([(7, "close alert")], "sr_id int, SessionManagementAlerts string")
    assert dictionary.dictionary_join(functions, reqs, TLS_COLUMNS).first()["matching_sr_ids"] == [7]


def test_filters(spark):
    rows = spark.createDataFrame([("Origin Server",), ("Client",), ("SENDER",), (None,)], "Role string")
    assert [r[0] for r in relations.role_filter(rows, "9110").collect()] == ["Origin Server", "SENDER"]
    assert relations.role_filter(rows, "8446").count() == 4
    outcomes = spark.createDataFrame([("Fully Matches",), ("fully matches",), (None,)], "outcome string")
    assert relations.outcome_filter(outcomes).count() == 1
    sparse = spark.createDataFrame([(1, None, ""), (2, "[]", None), (3, "x", "y")], "k int, a string, b string")
    assert {r["k"] for r in relations.drop_all_empty(sparse, ["a", "b"]).collect()} == {2, 3}
    assert relations.drop_unmatched(sparse, "a").count() == 2
    assert [r[0] for r in sparse.select(relations.has_suffix(F.concat("k", F.lit(".cc")), [".c", ".cc"])).collect()] == [True] * 3


def test_caps(spark):
    df = spark.createDataFrame([(k, f"v{k}", None) for k in range(9)], "k int, a string, b string")
    assert relations.capped(df, 2).count() == 2 and relations.capped(df, None).count() == 9
    seen = relations.sample_values(df, ["a", "b"]).collect()
    assert len(seen) == 3 and {r["column"] for r in seen} == {"a"}


def test_groups(spark):
    nested = spark.sql("""SELECT from_json('{"g": {"a": ["1", "x", "2"], "b": ["2"]}, "h": {"c": ["3"]}}', 'map<string,map<string,array<string>>>') AS groups""")
    flat = relations.flatten_groups(nested)
    assert {r["sr_id"]: (r["group"], r["subgroup"]) for r in flat.collect()} == {1: ("g", "a"), 2: ("g", "b"), 3: ("h", "c")}
    rows = spark.createDataFrame([(1, "old", "o"), (9, "old", "o")], "sr_id int, group string, subgroup string")
    assert {r["sr_id"]: (r["group"], r["subgroup"]) for r in relations.assign_groups(rows, flat).collect()} == {1: ("g", "a"), 9: ("old", "o")}


def test_neighbours_and_ids(spark):
    rows = spark.createDataFrame([("d", 1, "a"), ("d", 2, "b"), ("e", 1, "c")], "doc string, at int, text string")
    got = {(r["doc"], r["at"]): (r["prev_paragraph"], r["next_paragraph"]) for r in relations.neighbours(rows, "doc", "at", "text").collect()}
    assert got == {("d", 1): (None, "b"), ("d", 2): ("a", None), ("e", 1): (None, None)}
    many = spark.range(1000).select((F.col("id") * 7 % 1000).alias("k"), (F.col("id") % 3).alias("j"))
    out = relations.sequential_ids(many, ["k", "j"], "n").orderBy("k").collect()
    assert [r["n"] for r in out] == list(range(1, 1001))
    held = relations.sequential_ids(spark.createDataFrame([(None,), (None,), (5,)], "k int"), ["k"], "n").orderBy("n").collect()
    assert [(r["k"], r["n"]) for r in held] == [(None, 1), (None, 2), (5, 3)]


def test_enrich_stack_negatives(spark):
    rows = spark.createDataFrame([(1, "n"), (5, "n")], "function_id int, function_name string")
    functions = spark.createDataFrame([(1, "f"), (1, "g")], "function_id int, function_name string")
    out = sorted((r["function_id"], r["function_name"] or "") for r in relations.left_enrich(rows, functions).collect())
    assert out == [(1, "f"), (1, "g"), (5, "")]
    done = spark.createDataFrame([("Fully Matches",), ("No",)], "outcome string")
    full, counts = workflow.full_matches({"x": done, "y": None})
    assert full.count() == 1 and counts.collect()[0].asDict() == {"project": "x", "matches": 1}
    base = spark.range(50).select("id", F.concat(F.lit("v"), "id").alias("v"))
    a, b = (sorted(map(tuple, relations.negatives(base, "id", "v", 50, 3).collect())) for _ in range(2))
    assert a == b and all(r[2] for r in a)


def test_fuzzy_distinct(spark):
    rows = [("a" * 90, 0.900, 1), ("a" * 85, 0.895, 2), ("b", 0.5, 3), ("a" * 80 + "z", 0.886, 4)]
    out = search.fuzzy_distinct(spark.createDataFrame(rows, "text string, score double, rank int"), "text")
    assert {r["rank"] for r in out.collect()} == {1, 3}


def test_search(spark):
    vecs = spark.createDataFrame([(k, [float(k), 1.0]) for k in range(6)], "id bigint, vec array<double>")
    queries = spark.createDataFrame([(9, [1.0, 0.0])], "query bigint, qvec array<double>")
    out = [(r["id"], r["rank"]) for r in search.search(vecs, queries, 2, chunk=3).orderBy("rank").collect()]
    assert out == [(5, 1), (4, 2), (2, 3), (1, 4)]
    texts = spark.createDataFrame([(k, f"t{k}") for k in range(6)], "id bigint, text string")
    best = search.best_results(vecs, texts, queries, 3).orderBy("rank").collect()
    assert [r["text"] for r in best] == ["t5", "t4", "t3"]
    many = spark.createDataFrame([(q, [1.0, 0.0]) for q in range(3)], "query bigint, qvec array<double>")
    blocks = search.search(vecs, many, 1, block=1)
    assert sorted((r["query"], r["id"]) for r in blocks.collect()) == [(0, 5), (1, 5), (2, 5)]


def test_scorers(spark, functions, requirements):
    class Failing:
        name, schema = "failing", "tags array<string>, note string"

        async def answer(self, row):
            if row["sr"] == "bad":
                raise ValueError("no")
            return {"tags": [row["sr"]], "note": "n"}

    rows = spark.createDataFrame([(1, "ok"), (2, "bad")], "k int, sr string")
    out = scorers.scored(rows, Failing(), ["sr"])
    got = {r["k"]: (r["tags"], r["note"], r["status"], r["error"]) for r in out.collect()}
    assert got == {1: (["ok"], "n", "success", None), 2: ([], None, "failed", "no")}
    kept = scorers.new_answers(out, Failing(), ["sr"])

    class Never(Failing):
        async def answer(self, row):
            raise RuntimeError("asked again")

    again = {r["k"]: (r["tags"], r["error"]) for r in scorers.scored(rows, Never(), ["sr"], cache=kept).collect()}
    assert again == {1: (["ok"], None), 2: ([], "asked again")}
    roles = workflow.judge_roles(requirements.withColumn("sr", F.concat(F.lit("Origin Server: "), F.coalesce("sr", F.lit("")))))
    assert roles.first()["Role"] == "Server,Origin Server"
    made = workflow.extract_constraints(roles, "9110").first()
    assert made["action_list"] and made["condition_list"] == [] and made["Actions"]
    dual = workflow.dual_filter(functions, scorers.DualRules({"method": ["SEND"]}, {"x": ["date"]}))
    first = {r["function_id"]: (r["method"], r["matched_subcategories"], r["status"]) for r in dual.collect()}
    assert first[1] == (["SEND"], ["x"], "success") and first[2] == ([], [], "success")
    assert workflow.as_cells(dual, {"method": "method"}).first()["method"] in ('["SEND"]', "[]")
    pairs = workflow.pairs(workflow.heuristic_candidates(functions, requirements, 1), functions, requirements)
    assert {r["outcome"] for r in workflow.verify(pairs).collect()} == {"Fully Matches"}


def test_verified_pairs_of_all_ranks(spark, sf_dir):
    """The query verifies the best ten requirements of each function, not fewer."""
    from reqtrail.plans import queries

    docs = queries.table(spark, sf_dir, "documents").select(F.col("doc_id").alias("function_id"), F.col("text").alias("source_code"))
    items = queries.table(spark, sf_dir, "benchmark").select(F.col("item_id").alias("sr_id"), F.col("text").alias("sr"))
    scores = overlap.overlap_scores(docs, items).groupBy("function_id").agg(F.least(F.count("*"), F.lit(10)).alias("n"))
    want = {r["function_id"]: r["n"] for r in scores.collect()}
    got = {r["function_id"]: r["count"] for r in queries.verified_pairs(spark, sf_dir).groupBy("function_id").count().collect()}
    assert got == want and max(want.values()) > 3


def test_retry():
    asked = []

    async def call(prompt, json_mode):
        asked.append(json_mode)
        return "no json" if json_mode else 'so ```json\n{"a": 1}\n```'

    assert asyncio.run(scorers.with_retry(call, "p")) == {"a": 1} and asked == [True, False]
    assert asyncio.run(scorers.bounded([lambda k=k: asyncio.sleep(0, k) for k in range(5)], 2)) == list(range(5))
    with pytest.raises(ValueError):
        scorers.parse_answer("nothing")


def test_embedding_and_chunks(spark):
    rows = spark.createDataFrame([(k, "x" * k) for k in range(1, 5)], "id bigint, t string")
    out = scorers.embedded(rows, lambda b: [[len(t), 0.0] for t in b["t"]], "id", ["t"])
    assert {tuple(r["vec"]) for r in out.collect()} == {(1.0, 0.0)}
    assert scorers.chunked(rows, 2, "id").rdd.getNumPartitions() == 2


def test_schemas(spark):
    assert spark.createDataFrame([], dual_filter(HTTP_COLUMNS)).columns == [*HTTP_COLUMNS, "status", "error"]


def test_best_overlaps(spark):
    """The same rows as by the join of all pairs, for ids of text and numbers, ties, empty and null texts, and tables without tokens."""
    import random

    from reqtrail.operators import overlap

    rng = random.Random(6)
    words = [f"token{k}" for k in range(25)] + ["A", "42", "_x"]
    say = lambda n: " ".join(rng.choice(words) for _ in range(n))
    functions = spark.createDataFrame([(k, say(rng.randint(0, 30))) for k in range(200)] + [(900, None), (901, "")], "function_id int, source_code string").repartition(3)
    requirements = spark.createDataFrame([(f"r{k % 40:02d}", say(rng.randint(0, 9))) for k in range(60)] + [("none", None), (None, "token1 token2")], "sr_id string, sr string")
    for reqs in (requirements, requirements.select(F.length("sr").alias("sr_id"), "sr").dropDuplicates(["sr_id"]), requirements.limit(0), requirements.select("sr_id", F.lit("1 2").alias("sr"))):
        for k in (1, 4, 1000):
            want = overlap.top_candidates(overlap.overlap_scores(functions, reqs), k=k)
            got = overlap.best_overlaps(functions, reqs, k)
            assert got.columns == want.columns
            # Entries of one id with different numbers of tokens are in no set order.
            key = lambda r: (r["function_id"], r["score"], r["rank"])
            assert sorted(map(key, got.collect())) == sorted(map(key, want.collect()))
    one = requirements.dropDuplicates(["sr_id"])
    assert sorted(map(tuple, overlap.best_overlaps(functions, one, 5).collect()), key=str) == sorted(map(tuple, overlap.top_candidates(overlap.overlap_scores(functions, one), k=5).collect()), key=str)
    assert sorted(map(tuple, overlap.best_overlaps(functions, one, 5, limit=0).collect()), key=str) == sorted(map(tuple, overlap.best_overlaps(functions, one, 5).collect()), key=str)


def test_numbers_in_any_order(spark):
    """Numbers in orders of text, with one first value for all rows, with nulls, and in the order of the source."""
    from reqtrail.operators.kept import numbered

    rows = [(None if k % 11 == 0 else f"dir/{k % 5}", (k * 7919) % 1000) for k in range(1000)]
    df = spark.createDataFrame(rows, "path string, at int").repartition(7)
    got = [(r["path"], r["at"]) for r in relations.sequential_ids(df, ["path", "at"]).orderBy("function_id").collect()]
    assert got == sorted(rows, key=lambda r: (r[0] is not None, r[0] or "", r[1]))
    same = relations.sequential_ids(df.withColumn("path", F.lit("one")), ["path", "at"])
    assert [r["at"] for r in same.orderBy("function_id").collect()] == sorted(r[1] for r in rows)
    ids = sorted(r[0] for r in same.select("function_id").collect())
    assert ids == list(range(1, 1001))
    source = spark.range(100, numPartitions=6).withColumnRenamed("id", "v")
    assert all(r["sr_id"] == r["v"] for r in numbered(source, "sr_id").collect())
    assert numbered(spark.range(0), "n").count() == 0


def test_clear(spark):
    import os
    from urllib.parse import urlsplit

    from reqtrail.operators import kept

    assert kept.kept(spark.range(3), "t").count() == 3
    folder = urlsplit(kept.own_folder(spark)).path
    assert os.listdir(folder)
    kept.clear(spark)
    assert not os.path.exists(folder)


def test_broadcast_by_bytes(spark, monkeypatch):
    from reqtrail.operators import sizes

    small = spark.createDataFrame([("a", [1, 2])], "k string, l array<int>")
    long = small.withColumn("l", F.sequence(F.lit(1), F.lit(10_000)))
    hinted = lambda df, limit: "broadcast" in df._jdf.queryExecution().logical().toString().lower()
    assert hinted(sizes.broadcast_if_small(small, 1000), 0) and not hinted(sizes.broadcast_if_small(long, 1000), 0)
    assert sizes.broadcast_if_small(small.limit(0), 0) is not None


def test_dual_scorer(spark):
    """Both answers must parse; keywords of the first stay when the second is bad; a call that fails leaves all empty."""
    class Said:
        async def __call__(self, kind, row):
            return {"keywords": row["source_code"], "classes": row["function_name"]}[kind]

    rows = spark.createDataFrame([(1, '{"matched_subcategories": ["x"]}', '```json\n{"method": ["GET"]}\n```'), (2, "no", '{"method": ["PUT"], "other": [1]}'), (3, "{}", "no"), (4, "{}", None)], "function_id int, function_name string, source_code string")
    out = {r["function_id"]: r for r in workflow.dual_filter(rows, scorers.DualScorer("t", ["method"], Said())).collect()}
    assert (out[1]["method"], out[1]["matched_subcategories"], out[1]["status"], out[1]["error"]) == (["GET"], ["x"], "success", None)
    assert (out[2]["method"], out[2]["matched_subcategories"], out[2]["status"]) == (["PUT"], [], "failed") and "JSON" in out[2]["error"]
    assert (out[3]["method"], out[3]["status"], out[4]["status"]) == ([], "failed", "failed")


def test_prompt_scorer(spark):
    class Call:
        async def __call__(self, prompt, json_mode):
            if json_mode and "b" in prompt:
                raise RuntimeError("no such mode")
            return f'It is {{"said": "{prompt}"}}' if "c" not in prompt else "[1]"

    class Prompt:
        def __call__(self, row):
            return f"say {row['sr']}"

    rows = spark.createDataFrame([("a",), ("b",), ("c",)], "sr string")
    out = {r["sr"]: (r["said"], r["status"]) for r in scorers.scored(rows, scorers.PromptScorer("p", "said string", Prompt(), Call()), ["sr"]).collect()}
    assert out == {"a": ("say a", "success"), "b": ("say b", "success"), "c": (None, "failed")}


def test_flattened(spark):
    rows = spark.createDataFrame([("text", "c1", "a1,a2", ["c1"], ["a1", "a2"], "9110")], "`SR Text` string, Conditions string, Actions string, condition_list array<string>, action_list array<string>, rfc string")
    out = relations.flattened(rows)
    assert out.columns == ["sr", "conditions", "actions", "rfc"] and tuple(out.first()) == ("text", ["c1"], ["a1", "a2"], "9110")


def test_sequence_set(spark):
    from reqtrail.sources import tables

    one = spark.createDataFrame([(0, [5, 6]), (1, list(range(9)))], "id bigint, ids array<int>")
    out = {r["id"]: r for r in tables.sequence_set(one, one, one, one).collect()}
    assert out[0]["name"] == [5, 6, 0, 0, 0, 0] and out[0]["name_len"] == 2 and out[1]["name"] == [0, 1, 2, 3, 4, 5] and out[1]["name_len"] == 6
    assert len(out[1]["desc"]) == 30 and all(out[i]["bad_desc"] in (out[0]["desc"], out[1]["desc"]) for i in out)
    with pytest.raises(ValueError):
        tables.sequence_set(one, one, one.limit(1))


def test_sequence_set_broadcasts_no_side(spark):
    """However small the tables seem to be: compressed ids become long sequences."""
    from reqtrail.sources import tables

    side = spark.range(40).select("id", F.sequence(F.lit(0), (F.col("id") % 70).cast("int")).alias("ids"))
    out = tables.sequence_set(side, side, side, side)
    plan = out._jdf.queryExecution().executedPlan().toString()
    assert "SortMergeJoin" in plan and "Broadcast" not in plan
    for r in out.collect():
        n = r["id"] % 70 + 1
        for c, most in tables.SEQUENCE_LENGTHS.items():
            assert r[c] == ([*range(n)] + [0] * most)[:most] and r[f"{c}_len"] == min(n, most)
        assert len(r["bad_desc"]) == 30 and 1 <= r["bad_desc_len"] <= 30


def test_read_sequences(spark, tmp_path):
    from reqtrail.sources import tables

    rows = [(k, [k], [k, k], [1] * k, [2]) for k in range(4)]
    kinds = "id bigint, name array<int>, api array<int>, tokens array<int>, desc array<int>"
    spark.createDataFrame(rows, kinds).write.parquet(f"{tmp_path}/all")
    out = {r["id"]: r for r in tables.read_sequences(spark, f"{tmp_path}/all").collect()}
    assert len(out) == 4 and out[3]["tokens_len"] == 3 and out[3]["api"][:3] == [3, 3, 0] and out[2]["bad_desc"][:2] == [2, 0]
    spark.createDataFrame(rows, kinds).drop("desc").write.parquet(f"{tmp_path}/plain")
    assert "bad_desc" not in tables.read_sequences(spark, f"{tmp_path}/plain").columns
    spark.createDataFrame([*rows, (4, None, [1], [1], [1])], kinds).write.parquet(f"{tmp_path}/short")
    with pytest.raises(ValueError):
        tables.read_sequences(spark, f"{tmp_path}/short")


def test_read_functions(spark, tmp_path):
    from reqtrail.sources import tables

    (tmp_path / "f.jsonl").write_text('{"function_id": 3, "function_name": "f", "dependencies": {"g": ["int g();"]}}\n')
    row = tables.read_functions(spark, str(tmp_path / "f.jsonl")).first()
    assert (row["function_id"], row["function_name"], row["dependencies"], row["source_code"]) == (3, "f", {"g": ["int g();"]}, None)


def test_encoders(spark):
    """Against a step-by-step version for single rows."""
    import math

    import numpy as np

    from reqtrail.operators import encoders

    class Encoding:
        def __init__(self, name, weights):
            self.name, self.weights = name, weights

        def __call__(self, rows):
            return getattr(encoders, self.name)(rows, self.weights)

    rng = np.random.default_rng(3)
    weights = {}
    for x in ("name", "api", "desc"):
        weights[f"{x}.embedding"] = rng.normal(size=(9, 3))
        for d in ("forward", "backward"):
            weights |= {f"{x}.{d}.input": rng.normal(size=(8, 3)), f"{x}.{d}.state": rng.normal(size=(8, 2)), f"{x}.{d}.bias": rng.normal(size=8)}
        weights |= {f"{x}.weight": rng.normal(size=(5, 4)), f"{x}.bias": rng.normal(size=5)}
    weights |= {"tokens.embedding": rng.normal(size=(9, 3)), "tokens.weight": rng.normal(size=(5, 3)), "tokens.bias": rng.normal(size=5), "fuse.weight": rng.normal(size=(5, 5)), "fuse.bias": rng.normal(size=5)}

    def walk(x, d, ids):
        s = lambda v: 1 / (1 + math.exp(-v))
        h, c = [0.0, 0.0], [0.0, 0.0]
        for i in ids if d == "forward" else ids[::-1]:
            z = weights[f"{x}.{d}.input"] @ weights[f"{x}.embedding"][i] + weights[f"{x}.{d}.state"] @ np.array(h) + weights[f"{x}.{d}.bias"]
            c = [s(z[2 + k]) * c[k] + s(z[k]) * math.tanh(z[4 + k]) for k in range(2)]
            h = [s(z[6 + k]) * math.tanh(c[k]) for k in range(2)]
        return h

    both = lambda x, ids: weights[f"{x}.weight"] @ np.array(walk(x, "forward", ids) + walk(x, "backward", ids)) + weights[f"{x}.bias"]
    data = [(1, [1, 2, 3, 0], 3, [4, 0], 1, [7, 8, 0], [5, 6, 1], 3), (2, [8, 0, 0, 0], 1, [1, 2], 2, [3, 3, 3], [2, 0, 0], 1), (3, [0, 0, 0, 0], 0, [0, 0], 0, [0, 0, 0], [0, 0, 0], 0)]
    rows = spark.createDataFrame(data, "id int, name array<int>, name_len int, api array<int>, api_len int, tokens array<int>, desc array<int>, desc_len int")
    code = {r["id"]: r["vec"] for r in scorers.embedded(rows, Encoding("encode_code", weights), "id", ["name", "name_len", "api", "api_len", "tokens"], normalise=False).collect()}
    desc = {r["id"]: r["vec"] for r in scorers.embedded(rows, Encoding("encode_description", weights), "id", ["desc", "desc_len"], normalise=False).collect()}
    for i, name, n, api, m, tokens, words, k in data:
        pooled = weights["tokens.weight"] @ weights["tokens.embedding"][tokens].max(0) + weights["tokens.bias"]
        want = weights["fuse.weight"] @ np.tanh(both("name", name[:n]) + both("api", api[:m]) + pooled) + weights["fuse.bias"]
        assert np.allclose(code[i], want, atol=1e-5) and np.allclose(desc[i], both("desc", words[:k]), atol=1e-5)


def test_best_overlaps_in_bounded_memory(spark, monkeypatch):
    """A batch of functions that share many tokens with many requirements is counted in steps."""
    import tracemalloc

    import pyarrow as pa

    words = [f"w{j}" for j in range(60)]
    reqs = spark.createDataFrame([(i, " ".join(words)) for i in range(60)], "sr_id int, sr string")
    functions = spark.createDataFrame([(0, "w0")], "function_id int, source_code string")
    made = []
    monkeypatch.setattr(type(functions), "mapInArrow", lambda self, run, kinds: made.append(run))
    overlap.best_overlaps(functions, reqs, 3)
    batch = pa.RecordBatch.from_arrays([pa.array(range(4000), pa.int32()), pa.array([[w.upper() for w in words]] * 4000)], names=["function_id", "_tokens"])
    tracemalloc.start()
    try:
        rows = sum(out.num_rows for out in made[0](iter([batch])))
        peak = tracemalloc.get_traced_memory()[1]
    finally:
        tracemalloc.stop()
    assert rows == 12_000 and peak < 150 << 20


def _pairwise(vectors, queries, k, chunk):
    """search() by a score for each pair in the JVM."""
    from pyspark.sql.window import Window

    from reqtrail.functions.vectors import similarity

    met = vectors.crossJoin(queries).select("query", "id", F.floor(F.col("id") / chunk).alias("c"), similarity(F.col("vec"), F.col("qvec")).alias("score"))
    kept = met.withColumn("n", F.row_number().over(Window.partitionBy("query", "c").orderBy(F.desc("score"), "id"))).filter(F.col("n") <= k)
    return kept.select("query", "id", "score", F.row_number().over(Window.partitionBy("query").orderBy(F.desc("score"), "id")).alias("rank"))


def test_search_as_pairwise(spark, monkeypatch):
    """Exactly the scores of the column functions, with copies, turned vectors, and vectors that have none; few pairs meet in the JVM."""
    import random

    dice = random.Random(5)
    vecs = [[dice.gauss(0, 1) for _ in range(7)] for _ in range(300)]
    vecs[50:120] = [vecs[50]] * 70
    vecs[120:150] = [[x * 3 for x in v] for v in vecs[90:120]]
    odd = [None, [], [0.0] * 7, [None, *vecs[0][1:]], vecs[0][:5], [*vecs[0], 1.0], [1e200] * 7, [float("inf"), *vecs[0][1:]]]
    rows = spark.createDataFrame([(dice.randrange(10**6) * 400 + i, v) for i, v in enumerate(vecs + odd)], "id bigint, vec array<double>")
    queries = spark.createDataFrame([(f"q{i}", vecs[i * 10]) for i in range(12)] + [("odd", [None] * 7), ("none", None), ("short", vecs[0][:5])], "query string, qvec array<double>")
    for cells, chunk in ((1 << 21, 10**12), (50, 10**8)):
        monkeypatch.setattr(search, "CELLS", cells)
        got = sorted(str(tuple(r)) for r in search.search(rows, queries, 10, chunk=chunk).collect())  # as text, where NaN is itself
        assert got == sorted(str(tuple(r)) for r in _pairwise(rows, queries, 10, chunk).collect()) and len(got) >= 150


def test_search_multiplies_matrices(spark, monkeypatch):
    """No row of the JVM for a pair of plain vectors."""
    met = []
    pairs = search._scores
    monkeypatch.setattr(search, "_scores", lambda rows, asked, measure: met.append(pairs(rows, asked, measure)) or met[-1])
    rows = spark.range(500).select("id", F.array(F.sin("id"), F.cos("id")).alias("vec"))
    out = search.search(rows, rows.filter("id % 100 = 0").select(F.col("id").alias("query"), F.col("vec").alias("qvec")), 3)
    assert out.count() == 15 and sum(df.count() for df in met) == 0


def test_pairs_are_read_once(spark, monkeypatch):
    """A function's text is cut into tokens once for all its pairs, and hashed only where there is a cache."""
    cut = []
    monkeypatch.setattr(scorers.re, "findall", lambda rule, said, f=scorers.re.findall: cut.append(said) or f(rule, said))
    rows = [{"sr": f"send header{i % 3}_", "source_code": "only_here send(header0_)"} for i in range(30)]
    out = [asyncio.run(scorers.OverlapVerifier().answer(r)) for r in rows]
    assert [r["reason"] for r in out[:3]] == ["1.000", "0.500", "0.500"] and len(cut) <= 5
    pairs = spark.createDataFrame([(1, "send", "send()")], "k int, sr string, source_code string")
    out = scorers.scored(pairs, scorers.OverlapVerifier(), ["sr", "source_code"])
    assert "sha2" not in out._jdf.queryExecution().optimizedPlan().toString() and out.first()["outcome"] == "Fully Matches"


def test_results_are_searched_once(spark):
    """De-duplication needs no second search, and drops what fuzzy_distinct() drops: with odd scores, copies, repeated ids and texts that are missing."""
    import random

    from pyspark.sql.window import Window

    dice = random.Random(3)
    rows = spark.createDataFrame([(i, [dice.random(), 1.0]) for i in range(400)] + [(400 + i, v) for i, v in enumerate([None, [0.0, 0.0], [float("nan"), 1.0], [1.0], [0.5, 1.0], [0.5, 1.0]])], "id bigint, vec array<double>")
    texts = rows.select("id", F.when(F.col("id") % 9 > 0, F.concat(F.lit("x" * 79), F.col("id") % 7, "id")).alias("text"))
    texts = texts.unionByName(texts.filter("id % 5 = 0"))
    queries = rows.filter("id % 40 = 0").select(F.when(F.col("id") > 0, F.col("id")).alias("query"), F.col("vec").alias("qvec"))
    found = search.search(rows, queries, 60, chunk=100)
    met = search.fuzzy_distinct(found.join(texts, "id"), "text", group="query")
    want = met.withColumn("rank", F.row_number().over(Window.partitionBy("query").orderBy("rank"))).filter("rank <= 50")
    got = search.distinct_results(found, texts, 50)
    assert got._jdf.queryExecution().optimizedPlan().toString().count("MapInArrow") == found._jdf.queryExecution().optimizedPlan().toString().count("MapInArrow") == 1
    kept = [sorted(str((r["query"], r["text"], r["score"], r["rank"])) for r in df.collect()) for df in (got, want)]  # as text, where NaN is itself
    assert kept[0] == kept[1] and 100 < len(kept[0]) < got.select("query").distinct().count() * 50


def test_dedup_of_ids_beyond_a_chunk(spark, tmp_path):
    """vector_topk_dedup takes the 20 best of all ids, as its SQL does, before it drops what is alike."""
    import duckdb

    from reqtrail.plans import queries

    rows = spark.range(60).select((F.col("id") * 100_000).alias("vec_id"), F.array(F.cos(F.col("id") / 40), F.sin(F.col("id") / 40)).cast("array<float>").alias("embedding"), F.when(F.col("id") % 6 > 0, F.col("id") % 6).cast("int").alias("label"))
    rows.coalesce(1).write.parquet(f"{tmp_path}/embeddings.parquet")
    con = duckdb.connect()
    con.sql(f"CREATE VIEW embeddings AS FROM '{tmp_path}/embeddings.parquet/*.parquet'")
    out = queries.QUERIES["vector_topk_dedup"](spark, str(tmp_path))
    assert sorted(map(tuple, out.collect())) == sorted(con.sql(queries.ORACLE_SQL["vector_topk_dedup"]).fetchall())


def test_candidates_in_bounded_memory(spark, monkeypatch):
    """Memory of the counts follows neither the rows of a batch nor the number of batches, and candidates() are those of the plain join."""
    import tracemalloc

    import pyarrow as pa

    words = [f"w{j}" for j in range(60)]
    reqs = spark.createDataFrame([(i, " ".join(words[i % 7 :])) for i in range(60)], "sr_id int, sr string")
    functions = spark.createDataFrame([(i, " ".join(words[i : i + 9])) for i in range(70)] + [(70, None)], "function_id int, source_code string")
    made, given = [], type(functions).mapInArrow
    monkeypatch.setattr(type(functions), "mapInArrow", lambda self, run, kinds: made.append(run) or given(self, run, kinds))
    got = {r["function_id"]: r["sr_ids"] for r in overlap.candidates(functions, reqs, 3).collect()}
    want = {}
    for r in overlap.top_candidates(overlap.overlap_scores(functions, reqs), k=3).orderBy("function_id", "rank").collect():
        want.setdefault(r["function_id"], []).append(r["sr_id"])
    assert got == {i: want.get(i, []) for i in range(71)} and got[70] == [] and len(got[0]) == 3
    batch = pa.RecordBatch.from_arrays([pa.array(range(2000), pa.int32()), pa.array([[w.upper() for w in words]] * 2000)], names=["function_id", "_tokens"])
    tracemalloc.start()
    try:
        rows = sum(out.num_rows for out in made[0](iter([batch] * 3)))
        peak = tracemalloc.get_traced_memory()[1]
    finally:
        tracemalloc.stop()
    assert rows == 18_000 and peak < 12 << 20
