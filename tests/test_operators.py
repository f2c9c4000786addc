"""Hand-made vectors and invariants of the operators."""

import math

import pytest
from pyspark.sql import functions as F

from corpusmill.functions import privacy, tags, text
from corpusmill.operators import balance, dedup, evaluation, packing, preference, retrieval
from corpusmill.operators.graph import connected_components
from corpusmill.sources import readers


def one(spark, column):
    return spark.range(1).select(column.alias("x")).first()[0]


def test_similarity_of_empty_texts(spark):
    empty, some = F.expr("CAST(array() AS array<string>)"), F.array(F.lit("a"))
    assert one(spark, text.jaccard(empty, empty)) == 1.0
    assert one(spark, text.jaccard(empty, some)) == 0.0
    assert one(spark, text.edit_ratio(F.lit(""), F.lit(""))) == 1.0
    assert one(spark, text.cosine(empty, some)) == 0.0


def test_vitals_of_the_example(spark):
    found = one(spark, text.vitals(F.lit("BP: 145/95mmHg, T: 37.6℃, 血糖: 6.5mmol/L")))
    assert [(v.kind, v.value, v.second) for v in found] == [("blood_pressure", 145.0, 95.0), ("temperature", 37.6, None), ("blood_glucose", 6.5, None)]


def test_gate_of_the_example(spark):
    g = one(spark, evaluation.score_gate(*[F.lit(float(x)) for x in (8, 9, 7, 6, 8)]))
    assert g.passed and math.isclose(g.overall, 7.2)
    none = one(spark, evaluation.score_gate(*[F.lit(None).cast("double")] * 5))
    assert not none.passed and none.reason == "no_scores"


@pytest.mark.parametrize("n, want", [(1, (1, 0, 0)), (2, (1, 0, 1)), (3, (2, 1, 0)), (5, (4, 1, 0)), (10, (8, 1, 1)), (20, (17, 2, 1)), (100, (85, 10, 5))])
def test_strata(spark, n, want):
    df = balance.stratified_split(spark.range(n).withColumn("k", F.lit("a")), "k", "id")
    got = {r["split"]: r["count"] for r in df.groupBy("split").count().collect()}
    assert tuple(got.get(s, 0) for s in ("train", "valid", "test")) == want


def test_balance_meets_targets_and_repeats_nothing_when_it_takes(spark):
    df = spark.range(100).withColumn("k", F.when(F.col("id") < 70, "a").otherwise("b"))
    up = balance.balance(df, "k", "id", "uniform", target_count=50)
    assert {r["k"]: r["count"] for r in up.groupBy("k").count().collect()} == {"a": 50, "b": 50}
    assert up.where("k = 'a'").select("id").distinct().count() == 50
    assert up.where("k = 'b'").select("id").distinct().count() == 30
    with pytest.raises(ValueError, match="strategy"):
        balance.resample(df, "k", "id", df.groupBy("k").agg(F.count("*").alias("target")), "other")


def test_places_do_not_depend_on_layout(spark):
    df = spark.range(500)
    a, b = (balance.place(df.repartition(n), None, balance.hash_order("id"), "id").orderBy("id").collect() for n in (1, 7))
    assert a == b and sorted(r.place for r in a) == list(range(1, 501))


def test_greedy_is_not_components(spark):
    chain = spark.createDataFrame([(1, 2), (2, 3)], "a long, b long")
    kept = dedup.greedy_kept(spark.range(1, 5).withColumnRenamed("id", "doc"), chain, "doc")
    assert sorted(r.doc for r in kept.collect()) == [1, 3, 4]
    assert {(r.id, r.component) for r in connected_components(chain).collect()} == {(1, 1), (2, 1), (3, 1)}


def test_components_of_a_long_path_and_of_nothing(spark):
    path = spark.range(200).select(F.col("id").alias("a"), (F.col("id") + 1).alias("b"))
    assert connected_components(path).select("component").distinct().collect() == [(0,)]
    assert connected_components(path.where("a < 0")).count() == 0


def test_near_pairs_equal_brute_force(spark, sf):
    d = spark.read.parquet(f"{sf}/documents.parquet").select("doc_id", text.tokens(F.col("text")).alias("w"))
    got = {tuple(r) for r in dedup.near_pairs(d, "doc_id", "w", 0.8).collect()}
    rows = [(r.doc_id, frozenset(r.w)) for r in d.collect() if r.w]
    want = {(min(i, j), max(i, j)) for n, (i, s) in enumerate(rows) for j, t in rows[n + 1 :] if len(s & t) >= 0.8 * len(s | t)}
    assert got == want


def _records(spark):
    """Rows that all stages so far have written to shuffles."""
    sc = spark.sparkContext
    stages = sc._jsc.sc().statusStore().stageList(None, False, False, sc._gateway.new_array(sc._jvm.double, 0), sc._jvm.java.util.ArrayList())
    return {(stages.apply(i).stageId(), stages.apply(i).attemptId()): stages.apply(i).shuffleWriteRecords() for i in range(stages.size())}


@pytest.mark.parametrize("group", [5, 512])
def test_near_pairs_send_no_row_for_each_word(spark, monkeypatch, group):
    """Clusters about the threshold: words are counted where they are, a set goes to its groups, and large groups are dealt."""
    import random

    monkeypatch.setattr(dedup, "GROUP", group)
    random.seed(2)
    data = []
    for cluster in range(4):
        for _ in range(30):
            own = {f"{cluster}x{random.randint(0, 99)}" for _ in range(random.choice([0, 20, 30, 40]))}
            data.append((f"k{len(data):03}", [*(f"{cluster}w{i}" for i in range(280)), *own]))
    data += [("k900", []), ("k901", ["a"]), ("k902", ["a", "a"]), ("k903", None)]
    df = spark.createDataFrame(data, "id string, w array<string>").repartition(4).localCheckpoint()
    sets = {i: set(w) for i, w in data if w}
    want = {(a, b) for a in sets for b in sets if a < b and len(sets[a] & sets[b]) >= 0.8 * len(sets[a] | sets[b]) - 1e-9}
    before = _records(spark)
    got = [tuple(r) for r in dedup.near_pairs(df, "id", "w", 0.8).collect()]
    assert len(got) == len(set(got)) and set(got) == want and 0 < len(want)
    sent = sum(n for stage, n in _records(spark).items() if stage not in before)
    assert sent < 20_000  # pairs and some rare words; with a row for each word there were 43,607


def test_packing_keeps_whole_chunks_only(spark):
    df = spark.createDataFrame([(i, [f"{i}.{j}" for j in range(i)]) for i in range(12)], "id long, t array<string>")
    flat = [w for i in range(12) for w in [*(f"{i}.{j}" for j in range(i)), "E"]]
    got = {r.chunk: r.tokens for r in packing.pack(df, "id", "t", 7, "E").collect()}
    assert got == {c: flat[7 * c : 7 * c + 7] for c in range(len(flat) // 7)}


def test_masking_is_sequential_and_complete(spark):
    df = spark.createDataFrame([(1, "id 11010519900101123X card 6222021234567890123 a@b.com 10.0.0.1 tel 13812345678"), (2, None), (3, "plain")], "k long, t string")
    got = {r.k: r for r in privacy.mask_all(df, "t").collect()}
    assert got[1].privacy_types == ["身份证号", "手机号", "邮箱", "银行卡号", "IP地址"]
    assert not any(c.isdigit() for c in got[1].masked) and got[3].masked == "plain" and got[2].masked == ""


def test_steps_with_a_missing_result(spark):
    t = "<think>a</think><tool_call>q</tool_call><think>b</think><search_result>r</search_result><think>c</think><answer>x</answer>"
    assert [(s.think, s.query, s.result, s.answer) for s in one(spark, tags.steps(F.lit(t)))] == [("a", "q", "r", None), ("c", None, None, "x")]
    assert one(spark, tags.valid_steps(tags.steps(F.lit(t))))
    assert not one(spark, tags.valid_steps(tags.steps(F.lit("<think>a</think>"))))


def test_fewer_than_two_candidates_make_no_pair(spark):
    c = spark.createDataFrame([(1, 1, 9.0, 0.0, 0.0, 8.0)], "q long, o long, quality double, hallucination double, overreach double, readability double")
    assert preference.select_pairs(c, "q", "o").count() == 0


def test_perfect_ranking(spark):
    hits = spark.createDataFrame([(1, i, i) for i in range(1, 11)], "qid long, doc_id long, rank int")
    m = evaluation.retrieval_metrics(hits, hits.where("rank <= 3").select("qid", "doc_id", F.lit(1).alias("rel"))).first()
    assert m.ndcg_3 == 1.0 and m.precision_3 == 1.0 and m.recall_1 == pytest.approx(1 / 3, abs=1e-6)


def test_probed_search_finds_most(spark, sf):
    v = spark.read.parquet(f"{sf}/embeddings.parquet").withColumnRenamed("vec_id", "doc_id")
    q = v.where("doc_id % 10 = 0").select(F.col("doc_id").alias("qid"), F.col("embedding").alias("vector"))
    flat = {(r.qid, r.doc_id) for r in retrieval.top(retrieval.dense(v, q), 5, "dense").collect()}
    near = {(r.qid, r.doc_id) for r in retrieval.ivf_top(v, q, 5, nlist=16, nprobe=10, flat_below=0).collect()}
    assert len(flat & near) >= 0.9 * len(flat)


def test_readers_tell_lines_apart(spark, tmp_path):
    (tmp_path / "a.jsonl").write_text('{"question": "q1"}\n{broken\n\n{"question": "q2"}\n')
    assert [r.question for r in readers.load(spark, str(tmp_path / "a.jsonl")).orderBy("question").collect()] == ["q1", "q2"]
    (tmp_path / "b.txt").write_text('{"question": "q"}\nplain text\n')
    assert {(r.question, r.text) for r in readers.load(spark, str(tmp_path / "b.txt")).collect()} == {("q", None), (None, "plain text")}
    (tmp_path / "c.json").write_text('[{"question": "x"}, {"question": "y"}]')
    assert readers.load(spark, str(tmp_path / "c.json")).count() == 2
    with pytest.raises(ValueError, match="unknown"):
        readers.load(spark, "x.pkl")


def test_lcs_metric(spark):
    df = spark.createDataFrame([("1", list("abcd"), list("axcy")), ("2", [], list("a"))], "id string, g array<string>, t array<string>")
    assert {r.id: r.rouge_l for r in evaluation.rouge_l(df, "id", "g", "t").collect()} == {"1": 0.5, "2": 0.0}


def test_draws_with_replacement(spark):
    from corpusmill.operators.balance import resample

    rows = [(i, "a" if i < 50 else "b" if i < 1050 else None if i < 1060 else "c") for i in range(1100)]
    targets = spark.createDataFrame([("a", 2050), ("b", 400), ("zz", 9)], "lang string, target long")
    made = [resample(spark.createDataFrame(rows, "id long, lang string").repartition(n), "lang", "id", targets, "draw") for n in (1, 7)]
    got, again = [sorted((r.id, r.lang, r.copy) for r in m.collect()) for m in made]
    assert got == again and sum(x[1] == "a" for x in got) == 2050 and [x[0] for x in got if x[1] == "b"] == list(range(50, 450)) and sum(x[1] == "c" for x in got) == 40
    times = [sum(x[0] == i for x in got) - 1 for i in range(50)]  # 2000 draws among 50: mean 40, variance near 39
    assert sum(times) == 2000 and 15 < sum((t - 40) ** 2 for t in times) / 50 < 90


def test_a_report_tests_texts_for_what_a_match_holds_first(spark):
    """Each detector counts as its pattern alone does; a text without a Chinese character meets no Chinese pattern."""
    from pyspark.sql import functions as F

    from corpusmill.functions import privacy as P

    texts = ["id 11010519900101123x end", "E12345678 AB123456", "tel 13800000000, 010-12345678", "微信：user_12x WX: abcdefg", "a@b.org 10.0.0.1 ١٢.١٢.١٢.١٢", "社保号:A123456789012345", "在建国路12号3单元",
             "张医生 王小明说", "病历号：ZY123456", "检验 x 2024年1月2日", "2024-01-02 在北京医院的内科", "1234567890123456 ١٢٣٤٥٦٧٨٩٠١٢٣٤٥٦", "plain", "", None]
    d = spark.createDataFrame([(i, x) for i, x in enumerate(texts)], "i int, t string").repartition(3)
    want = {(r.i, x.label): r.n for x in P.DETECTORS for r in d.select("i", F.size(F.regexp_extract_all("t", F.lit(P.pattern(x)), F.lit(0))).alias("n")).where("n > 0").collect()}
    got = {(r.i, r.label): r.n for r in d.select("i", F.explode(P.report(F.col("t"))).alias("label", "n")).collect()}
    assert got == want and {label for _, label in got} == {x.label for x in P.DETECTORS}
    plan = d.select(P.report(F.col("t")))._jdf.queryExecution().optimizedPlan().toString()
    assert plan.count("CASE WHEN") >= len(P.DETECTORS)


def test_all_products_by_batches(spark):
    """Of blocks and batches of a few vectors as of one; null without two vectors of one length; no product is made by a row's own expression."""
    import random

    from pyspark.sql import functions as F

    from corpusmill.operators import retrieval as R

    random.seed(4)
    made = [(i, [random.uniform(-1, 1) for _ in range(8)]) for i in range(90)] + [(90, None), (91, [1.0, None]), (92, [1.0, 2.0]), (93, []), (None, [0.5] * 8), (94, [float("nan")] * 8)]
    d = spark.createDataFrame(made, "doc_id long, embedding array<double>").repartition(4)
    q = d.where("doc_id % 10 < 5").select(F.col("doc_id").alias("qid"), F.col("embedding").alias("vector"))
    want = {(r.qid, r.doc_id): r.x for r in d.crossJoin(q).select("qid", "doc_id", R.dot(F.col("embedding"), F.col("vector")).alias("x")).collect()}
    for block in (16 << 20, 500):
        found = R.dense(d, q, block_bytes=block)
        got = found.collect()
        assert len(got) == len(want)
        for r in got:
            x = want[r.qid, r.doc_id]
            assert (r.dense is None) == (x is None) and (x is None or x != x and r.dense != r.dense or abs(r.dense - x) < 1e-12)
    plan = found._jdf.queryExecution().optimizedPlan().toString()
    assert "Join" not in plan and "zip_with" not in plan
    assert R.dense(d, q.where("false")).count() == 0 and R.dense(d.where("false"), q).count() == 0


def test_knowledge_tables_cut_each_text_once(spark, tmp_path):
    """The tables are those of the index over the documents, also with null, empty and repeated rows; a text is read twice, as itself and for its terms."""
    from corpusmill.operators.retrieval import lexical_index
    from corpusmill.sources import writers as Wr

    made = [(1, "a b a"), (2, "b"), (3, ""), (4, None), (1, "a b a"), (1, "c"), (None, "d d")]
    read = spark.sparkContext.accumulator(0)

    def seen(batches):
        for b in batches:
            read.add(b.num_rows)
            yield b

    for i, rows in enumerate((made, [(4, None)], [])):
        docs = spark.createDataFrame(rows, "doc_id long, contents string")
        Wr.knowledge(docs.mapInArrow(seen, docs.schema), f"{tmp_path}/{i}")
        if not i:
            assert read.value == 2 * len(made)
        for name, want in zip(("postings", "terms", "stats"), lexical_index(docs, "contents"), strict=True):
            got = spark.read.parquet(f"{tmp_path}/{i}/{name}")
            assert got.dtypes == want.dtypes
            assert sorted(map(str, got.collect())) == sorted(map(str, want.collect()))
        assert spark.read.parquet(f"{tmp_path}/{i}/docs").count() == len(rows)
