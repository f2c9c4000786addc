"""Queries that once took a part of their input, over all of it."""

import pytest

from corpusmill import catalog

QUERIES, ORACLES = catalog.queries(), catalog.oracle_sql()
DENSE = ["dense_top_k", "ivf_top_k", "score_normalised", "retrieval_metrics", "relevance_gate", "corpus_lookup", "dense_k_of_each_query", "rag_evaluation"]


def test_knowledge_queries_are_whole(spark, sf):
    from corpusmill.plans.retrieval import knowledge

    _, q = knowledge(spark, sf)
    texts = {r.doc_id: r.text for r in spark.read.parquet(f"{sf}/documents.parquet").where("doc_id % 100 = 0").collect()}
    assert {r.qid: r.query for r in q.collect()} == texts and all(r.hypothetical for r in q.collect())
    for name in ("hybrid_search", "hyde_search"):
        assert {r.qid for r in QUERIES[name](spark, sf).collect()} == set(texts)


@pytest.mark.parametrize("name", [*DENSE, "hybrid_candidates", "cosine_matrix"])
def test_sql_takes_every_hundredth_row(name):
    assert "_id % 100 = 0" in ORACLES[name] and "_id < " not in ORACLES[name]


@pytest.mark.parametrize("name, folder", [("ivf_probed", "sf0.001"), ("ivf_probed", "sf0.1"), ("ivf_top_k", "sf0.1")])
def test_probed_searches_as_registered_find_nine_in_ten(spark, name, folder):
    d = f"/root/testdata/{folder}"
    flat = {(r.qid, r.doc_id) for r in QUERIES["dense_top_k"](spark, d).collect()}
    near = {(r.qid, r.doc_id) for r in QUERIES[name](spark, d).collect()}
    assert len(flat & near) >= 0.9 * len(flat)


def test_similarity_is_of_whole_turns(spark, sf):
    from difflib import SequenceMatcher

    got = {(r.conv_id, r.turn): r for r in QUERIES["text_similarity"](spark, sf).collect()}
    turns = {(r.conv_id, r.turn): r.text for r in spark.read.parquet(f"{sf}/conversations.parquet").collect()}
    ratio = {(r.conv_id, r.turn): r.ratio for r in QUERIES["text_sequence_ratio"](spark, sf).collect()}
    assert set(got) == set(ratio)
    for conv, turn in got:
        a, b = turns[conv, turn], turns[conv, turn + 1]
        assert ratio[conv, turn] == pytest.approx(SequenceMatcher(None, a, b).ratio(), abs=2e-6)


def test_pairs_that_sql_cannot_follow_are_kept(spark, tmp_path):
    long = "x" * 120 + "\n" + "y" * 120
    turns = [("What is this, a question?\nA: or an answer?", "An answer that is long enough to be kept in the base."), (long, long), ("Which @ sign is it, 12 at 5?", "The @ sign of a plain sentence, no address."), ("A plain question, is it?", "The batch number is 1234567 and it is whole.")]
    rows = [(i, t, "user" if t % 2 == 0 else "assistant", x[t % 2]) for i, x in enumerate(turns) for t in (0, 1)]
    spark.createDataFrame(rows, "conv_id long, turn long, role string, text string").write.parquet(str(tmp_path / "conversations.parquet"))
    got = {name: {r.conv_id: r for r in QUERIES[name](spark, str(tmp_path)).collect()} for name in ("kb_documents", "qa_split", "qa_normalise")}
    assert set(got["kb_documents"]) == {0, 1, 2, 3} and got["kb_documents"][1].title == "x" * 120 + "\n"
    assert set(got["qa_split"]) == {0, 1, 2, 3} and got["qa_split"][0].question == "What is this, a question?"
    assert got["qa_split"][0].answer == "or an answer? A: " + turns[0][1]
    assert set(got["qa_normalise"]) == {0, 1, 2, 3} and "1234567" in got["qa_normalise"][3].answer
