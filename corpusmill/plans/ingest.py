"""Queries of sources, sinks, normalisation and near duplicates."""

from __future__ import annotations

from pyspark.sql import functions as F

from corpusmill.functions.privacy import DETECTORS
from corpusmill.functions.text import clean, tokens, truncate
from corpusmill.operators import dedup as D
from corpusmill.operators.evaluation import score_gate
from corpusmill.operators.knowledge import knowledge_rows
from corpusmill.plans.common import table
from corpusmill.plans.conversations import PAIRS, pairs
from corpusmill.sources import readers as R
from corpusmill.sources import writers as Wr
from corpusmill.storage import new_path

QUERIES, ORACLES = {}, {}


def query(name, sql=None):
    """Register a query and its twin."""
    def put(f):
        QUERIES[name] = f
        if sql:
            ORACLES[name] = sql
        return f

    return put


def written(df, name, **options):
    """A text file of the frame's only column, below the shared folder."""
    path = new_path(df.sparkSession, name)
    df.write.options(**options).text(path)
    return path


LINE = "to_json(named_struct('question', text, 'answer', lang, 'id', CAST(doc_id AS STRING)))"


@query("read_jsonl_tolerant", "SELECT doc_id::VARCHAR AS id, text AS question, lang AS answer FROM documents WHERE doc_id % 4 <> 0")
def jsonl(spark, sf_dir):
    d = table(spark, sf_dir, "documents").select(F.expr(f"CASE WHEN doc_id % 4 = 0 THEN substring({LINE}, 1, 20) ELSE {LINE} END").alias("value"))
    return R.jsonl(spark, written(d, "jsonl")).select("id", "question", "answer")


@query("read_jsonl_strict", "SELECT doc_id::VARCHAR AS id, text AS question, lang AS answer FROM documents")
def strict(spark, sf_dir):
    return R.jsonl(spark, written(table(spark, sf_dir, "documents").select(F.expr(LINE).alias("value")), "strict"), strict=True).select("id", "question", "answer")


@query("read_text_lines", "SELECT CASE WHEN doc_id % 2 = 0 THEN text END AS question, CASE WHEN doc_id % 2 = 1 THEN 'plain ' || doc_id END AS text FROM documents")
def lines(spark, sf_dir):
    d = table(spark, sf_dir, "documents").select(F.expr(f"CASE WHEN doc_id % 2 = 0 THEN {LINE} ELSE 'plain ' || doc_id END").alias("value"))
    return R.text_lines(spark, written(d, "lines")).select("question", "text")


@query("read_paragraphs", "SELECT p AS text, count(*)::BIGINT AS n FROM (SELECT regexp_replace(unnest(string_split(text, chr(10) || chr(10))), '^\\s+|\\s+$', '', 'g') AS p FROM documents) WHERE p <> '' GROUP BY p")
def paragraphs(spark, sf_dir):
    d = table(spark, sf_dir, "documents", F.col("text").alias("value"))
    return R.paragraphs(spark, written(d, "paragraphs", lineSep="\n\n")).groupBy("text").agg(F.count("*").alias("n"))


@query("read_json_sniffed", "SELECT item_id::VARCHAR AS id, text AS question FROM benchmark")
def sniffed(spark, sf_dir):
    d = table(spark, sf_dir, "benchmark").agg(F.to_json(F.collect_list(F.struct(F.col("item_id").cast("string").alias("id"), F.col("text").alias("question")))).alias("value"))
    return R.sniffed(spark, written(d, "sniff")).select("id", "question")


@query("read_json_wrapped", "SELECT item_id::VARCHAR AS id, text AS question FROM benchmark")
def wrapped(spark, sf_dir):
    d = table(spark, sf_dir, "benchmark").agg(F.to_json(F.struct(F.collect_list(F.struct(F.col("item_id").cast("string").alias("id"), F.col("text").alias("question"))).alias("data"))).alias("value"))
    return R.json_array(spark, written(d, "wrapped")).select("id", "question")


@query("read_csv", "SELECT doc_id, text, lang FROM documents")
def csv(spark, sf_dir):
    path = new_path(spark, "csv")
    table(spark, sf_dir, "documents", "doc_id", "text", "lang").write.option("header", True).option("escape", '"').csv(path)
    return R.csv(spark, path, "doc_id long, text string, lang string")


@query("load_truncated", "SELECT doc_id, text FROM documents ORDER BY doc_id LIMIT 50")
def truncated(spark, sf_dir):
    return table(spark, sf_dir, "documents", "doc_id", "text").orderBy("doc_id").limit(50)


def raw(spark, sf_dir):
    """Pairs under four kinds of keys, and a fifth that no rule knows."""
    p = pairs(spark, sf_dir).withColumn("k", (F.col("conv_id") + F.col("turn")) % 5)
    on = lambda k, c: F.when(F.col("k") == k, F.col(c))
    return p.select("conv_id", "turn", on(0, "q").alias("question"), on(0, "a").alias("answer"), on(1, "q").alias("instruction"), on(1, "a").alias("output"), on(2, "q").alias("prompt"), F.when(F.col("k").isin(2, 3), F.col("a")).alias("response"), on(3, "q").alias("query"))


@query("schema_adapt", f"SELECT conv_id, turn, q AS question, a AS answer FROM ({PAIRS}) WHERE (conv_id + turn) % 5 <> 4")
def adapt(spark, sf_dir):
    return R.adapt(raw(spark, sf_dir)).select("conv_id", "turn", "question", "answer")


@query("preference_rows", f"SELECT '[' || trim(q) || ']' AS prompt, trim(a) AS chosen, upper(trim(translate(a, 'ß', 's'))) AS rejected FROM ({PAIRS}) WHERE conv_id % 3 <> 2 AND trim(q) <> '' AND trim(a) <> ''")
def preference(spark, sf_dir):
    p, c = pairs(spark, sf_dir), F.col("conv_id") % 3
    x = p.select(F.when(c == 0, F.col("q")).otherwise("").alias("prompt"), F.when(c != 0, F.col("q")).alias("question"), F.when(c == 0, F.col("a")).alias("chosen"), F.when(c == 1, F.col("a")).alias("accepted"), F.upper(F.translate("a", "ß", "s")).alias("rejected"))
    return R.preference(x, "[{}]")


@query("batch_questions", "SELECT conv_id, coalesce(nullif(CASE WHEN conv_id % 2 = 0 THEN 'q' || conv_id ELSE '' END, ''), first) AS question FROM (SELECT conv_id, arg_min(text, turn) FILTER (WHERE role = 'user') AS first FROM conversations GROUP BY conv_id) WHERE coalesce(nullif(CASE WHEN conv_id % 2 = 0 THEN 'q' || conv_id ELSE '' END, ''), first) IS NOT NULL")
def batch(spark, sf_dir):
    from corpusmill.operators.conversation import first_question, gather

    c = gather(table(spark, sf_dir, "conversations")).withColumn("question", F.when(F.col("conv_id") % 2 == 0, F.concat(F.lit("q"), "conv_id")).otherwise(""))
    return c.select("conv_id", F.coalesce(R.first_of(c, "question", "query", "instruction"), first_question(F.col("messages"))).alias("question")).where("question IS NOT NULL")


def cut_sql(text: str, n: int) -> str:
    """A text cut to ``n`` characters, in its second half behind the last of the first of these marks that occurs there."""
    half = f"({text})[{n // 2 + 1}:{n}]"
    marks = "".join(f" WHEN contains({half}, {m}) THEN ({text})[:{n + 1} - instr(reverse({half}), {m})]" for m in ("'。'", "'？'", "'！'", "'；'", "chr(10)"))
    return f"CASE WHEN length({text}) <= {n} THEN {text}{marks} ELSE ({text})[:{n}] END"


QA = "concat('Q: ', q, ' A: ', a)"
PERSONAL = "|".join(d.pattern for d in DETECTORS if d.key in ("id_card", "passport", "mobile", "landline", "email", "bank_card"))
CLEAN = "trim(regexp_replace(trim(regexp_replace(regexp_replace(regexp_replace({}, '<[^>]+>', '', 'g'), 'https?://\\S+|www\\.\\S+', '', 'g'), '\\s+', ' ', 'g')), '[^\\p{{L}}\\p{{N}}\\p{{M}}_\\s.,?!;:()*]', '', 'g'))"


@query("qa_normalise", f"SELECT conv_id, md5(question || answer) AS id, question, answer, 'medical' AS domain FROM (SELECT conv_id, {CLEAN.format('q')} AS question, {CLEAN.format('a')} AS answer FROM ({PAIRS})) WHERE length(question) >= 5 AND length(answer) >= 10 AND NOT regexp_matches(question || ' ' || answer, '{PERSONAL}')")
def normalise(spark, sf_dir):
    p = pairs(spark, sf_dir)
    half = p.select("conv_id", F.when(F.col("turn") % 4 == 0, F.col("q")).alias("query"), F.when(F.col("turn") % 4 == 0, F.col("a")).alias("reply"), F.concat(F.lit("问: "), "q", F.lit(" 答: "), "a").alias("text"))
    return R.normalise_qa(half, "conv_id").select("conv_id", "id", "question", "answer", "domain")


@query("qa_split", f"SELECT conv_id, turn, regexp_replace(regexp_extract({QA}, '(?s)Q[:：]\\s*(.*?)\\s*A[:：]\\s*(.*)', 1), '^\\s+|\\s+$', '', 'g') AS question, regexp_replace(regexp_extract({QA}, '(?s)Q[:：]\\s*(.*?)\\s*A[:：]\\s*(.*)', 2), '^\\s+|\\s+$', '', 'g') AS answer FROM ({PAIRS})")
def split(spark, sf_dir):
    p = pairs(spark, sf_dir)
    t, pat = F.concat(F.lit("Q: "), "q", F.lit(" A: "), "a"), r"(?s)Q[:：]\s*(.*?)\s*A[:：]\s*(.*)"
    from corpusmill.functions.text import strip

    return p.select("conv_id", "turn", strip(F.regexp_extract(t, pat, 1)).alias("question"), strip(F.regexp_extract(t, pat, 2)).alias("answer"))


@query("kb_documents", f"SELECT conv_id, turn, q AS title, '问题：' || q || chr(10) || '答案：' || a AS contents, q || ' ' || a AS embed_text FROM (SELECT conv_id, turn, {cut_sql('trim(q)', 200)} AS q, {cut_sql('trim(a)', 200)} AS a, length(trim(a)) AS n FROM ({PAIRS})) WHERE q <> '' AND n >= 40")
def kb(spark, sf_dir):
    p = pairs(spark, sf_dir).select("conv_id", "turn", F.trim("q").alias("q"), F.trim("a").alias("a")).where((F.col("q") != "") & (F.length("a") >= 40))
    q, a = truncate(F.col("q"), 200), truncate(F.col("a"), 200)
    return p.select("conv_id", "turn", q.alias("title"), F.concat(F.lit("问题："), q, F.lit("\n答案："), a).alias("contents"), F.concat_ws(" ", q, a).alias("embed_text"))


TRIM = "regexp_replace(text, '^\\s+|\\s+$', '', 'g')"


def kb_twin(embed, tail=""):
    return f"""SELECT doc_id, q AS title, '问题：' || q || chr(10) || '答案：' || a AS contents, {embed} AS embed_text
FROM (SELECT doc_id, q, {cut_sql('t', 300)} AS a, length(t) AS n FROM (SELECT doc_id, source || ' ' || doc_id AS q, {TRIM} AS t FROM documents WHERE text IS NOT NULL)) WHERE n >= 40 {tail}"""


def kb_rows(spark, sf_dir, **how):
    d = table(spark, sf_dir, "documents").select("doc_id", F.concat("source", F.lit(" "), "doc_id").alias("instruction"), F.col("text").alias("output"))
    return knowledge_rows(d, "doc_id", longest=300, least_answer=40, **how)


@query("kb_embed_question", kb_twin("q"))
def kb_question(spark, sf_dir):
    return kb_rows(spark, sf_dir, embed="question")


@query("kb_embed_answer", kb_twin("a"))
def kb_answer(spark, sf_dir):
    return kb_rows(spark, sf_dir, embed="answer")


@query("kb_first_rows", kb_twin("q || ' ' || a", "ORDER BY doc_id LIMIT 100"))
def kb_first(spark, sf_dir):
    return kb_rows(spark, sf_dir, embed="question_answer", most=100)


@query("load_by_extension", """SELECT kind, n_name AS question, n_nationkey::VARCHAR AS id FROM nation, (SELECT unnest(['csv', 'json', 'jsonl', 'txt']) AS kind)""")
def load_kinds(spark, sf_dir):
    rows = table(spark, sf_dir, "nation").select(F.col("n_name").alias("question"), F.col("n_nationkey").cast("string").alias("id"))
    out = None
    for kind in ("csv", "json", "jsonl", "txt"):
        path = f"{new_path(spark, 'load')}/rows.{kind}"
        if kind == "csv":
            rows.write.option("header", True).csv(path)
        else:
            rows.write.json(path)
        part = R.load(spark, path).select(F.lit(kind).alias("kind"), "question", "id")
        out = part if out is None else out.unionByName(part)
    return out


@query("read_json_first", "SELECT least(50, count(*))::BIGINT AS n, least(50, count(*))::BIGINT AS known FROM documents")
def read_first(spark, sf_dir):
    """All documents as lines, of which the reader takes 50 and leaves the rest unread; each is held against the table."""
    d = table(spark, sf_dir, "documents").select(F.col("doc_id").cast("string").alias("id"), F.col("text").alias("question"))
    path = written(d.select(F.to_json(F.struct("id", "question")).alias("value")), "first")
    got = R.sniffed(spark, path, most=50).select("id", F.md5(F.col("question").cast("binary")).alias("sum"))
    known = d.select("id", F.md5(F.col("question").cast("binary")).alias("sum"), F.lit(1).alias("known"))
    return got.join(known, ["id", "sum"], "left").agg(F.count("*").alias("n"), F.count("known").alias("known"))


@query("write_splits", "SELECT CASE WHEN doc_id % 5 = 0 THEN 'test' ELSE 'train' END AS split, count(*)::BIGINT AS n FROM documents GROUP BY 1")
def splits(spark, sf_dir):
    path = new_path(spark, "splits")
    Wr.splits(table(spark, sf_dir, "documents", "doc_id", "text").withColumn("split", F.when(F.col("doc_id") % 5 == 0, "test").otherwise("train")), path)
    return spark.read.schema("doc_id long, text string, split string").json(path).groupBy("split").agg(F.count("*").alias("n"))


@query("write_conversations", "SELECT conv_id, count(*)::BIGINT AS n FROM conversations GROUP BY conv_id")
def write_conversations(spark, sf_dir):
    from corpusmill.operators.conversation import gather

    path = new_path(spark, "chats")
    Wr.conversations(gather(table(spark, sf_dir, "conversations")).withColumn("_meta", F.struct(F.col("conv_id").alias("index"))), path, meta=False, compression="gzip")
    return spark.read.schema("conv_id long, messages array<struct<role:string,content:string>>").json(path).select("conv_id", F.size("messages").cast("long").alias("n"))


@query("write_knowledge_tables", "SELECT count(*)::BIGINT AS n_docs, (SELECT count(*) FROM (SELECT DISTINCT unnest(regexp_extract_all(lower(text), '[\\p{L}\\p{M}\\p{Nd}\\p{Pc}]+')) FROM documents))::BIGINT AS n_terms FROM documents")
def knowledge(spark, sf_dir):
    path = new_path(spark, "kb")
    Wr.knowledge(table(spark, sf_dir, "documents", "doc_id", F.col("text").alias("contents")), path)
    return spark.read.parquet(f"{path}/stats").select(F.col("n").alias("n_docs")).join(F.broadcast(spark.read.parquet(f"{path}/terms").agg(F.count("*").alias("n_terms"))))


@query("stream_append", "SELECT event_type, count(*)::BIGINT AS n FROM events GROUP BY event_type")
def stream(spark, sf_dir):
    from corpusmill.streaming.append import copy_stream

    out = new_path(spark, "stream")
    schema = table(spark, sf_dir, "events").schema
    copy_stream(spark, sf_dir, "events.parquet", schema, out)
    return spark.read.schema(schema).parquet(out).groupBy("event_type").agg(F.count("*").alias("n"))


@query("near_dedup_greedy")
def greedy(spark, sf_dir):
    return D.near_dedup(table(spark, sf_dir, "documents", "doc_id", "text"), words=lambda c: F.regexp_extract_all(F.lower(c), F.lit(r"(?U)\w+"), F.lit(0))).select("doc_id")


@query("near_dedup_components")
def components(spark, sf_dir):
    return D.near_dedup(table(spark, sf_dir, "documents", "doc_id", "text"), mode="components", words=lambda c: F.regexp_extract_all(F.lower(c), F.lit(r"(?U)\w+"), F.lit(0))).select("doc_id")


@query("near_dedup_minhash")
def minhash(spark, sf_dir):
    return D.near_dedup(table(spark, sf_dir, "documents", "doc_id", "text"), pairs="minhash", words=lambda c: F.regexp_extract_all(F.lower(c), F.lit(r"(?U)\w+"), F.lit(0))).select("doc_id")


@query("near_pairs", """WITH s AS (SELECT doc_id, list_distinct(list_filter(string_split_regex(text, '\\s+'), lambda x: x <> '')) AS w FROM documents),
p AS (SELECT a.doc_id AS a, b.doc_id AS b, len(list_intersect(a.w, b.w)) AS i, len(a.w) AS x, len(b.w) AS y FROM s a JOIN s b ON a.doc_id < b.doc_id AND least(len(a.w), len(b.w)) >= 0.8 * greatest(len(a.w), len(b.w))),
l AS (SELECT a, b FROM p WHERE i >= 0.8 * (x + y - i)), n AS (SELECT a AS doc_id, count(*) AS n FROM (SELECT a, b FROM l UNION ALL SELECT b, a FROM l) GROUP BY 1)
SELECT s.doc_id, CASE WHEN len(w) = 0 THEN s.doc_id ELSE min(s.doc_id) OVER (PARTITION BY list_sort(w)) END AS same_as, coalesce(n, 0)::BIGINT AS n_links FROM s LEFT JOIN n USING (doc_id)""")
def near(spark, sf_dir):
    return D.near_classes(table(spark, sf_dir, "documents").select("doc_id", tokens(F.col("text")).alias("w")), "doc_id", "w", 0.8)


MASKED = "text"
for _p, _m in ((r"\b[A-Za-z0-9._%+-]+@[A-Za-z0-9.-]+\.[A-Z|a-z]{2,}\b", "[M]"), (r"\b\d{16,19}\b", "[M]"), (r"\b(?:\d{1,3}\.){3}\d{1,3}\b", "[M]")):
    MASKED = f"regexp_replace({MASKED}, '{_p}', '{_m}', 'g')"


@query("flagship_curation", f"""WITH d AS (SELECT min(doc_id) AS doc_id, any_value(lang) AS lang FROM (SELECT doc_id, lang, {CLEAN.format(MASKED)} AS t FROM documents) GROUP BY t, lang),
x AS (SELECT d.lang, d.doc_id, l.quality, l.toxic FROM d LEFT JOIN labels l ON l.doc_id = d.doc_id)
SELECT lang, count(*)::BIGINT AS n, count(quality)::BIGINT AS labelled, count(*) FILTER (WHERE quality * 10 >= 6 AND 10 - toxic * 10 >= 6)::BIGINT AS passed FROM x GROUP BY lang""")
def flagship(spark, sf_dir):
    """Clean, mask, drop copies, join labels, gate, and count by language."""
    from corpusmill.functions.privacy import DETECTORS, mask

    d = table(spark, sf_dir, "documents", "doc_id", "text", "lang")
    t = F.col("text")
    for x in DETECTORS:
        if x.key in ("email", "bank_card", "ip"):
            t = mask(t, x, "[M]")
    d = d.select("doc_id", "lang", F.md5(clean(t).cast("binary")).alias("h")).groupBy("h", "lang").agg(F.min("doc_id").alias("doc_id"))
    x = d.join(table(spark, sf_dir, "labels"), "doc_id", "left")
    ten = F.when(F.col("quality").isNotNull(), F.lit(10.0))
    gate = score_gate((10 - F.col("toxic") * 10).cast("double"), F.col("quality") * 10.0, ten, F.lit(0.0), ten)
    return x.groupBy("lang").agg(F.count("*").alias("n"), F.count("quality").alias("labelled"), F.count_if(F.col("quality").isNotNull() & gate["passed"]).alias("passed"))
