"""Queries of the text functions."""

from __future__ import annotations

from pyspark.sql import functions as F

from corpusmill.functions import text as T
from corpusmill.operators import segmentation as G
from corpusmill.plans.common import scalar, table

QUERIES, ORACLES = {}, {}


def add(name, source, key, value, columns, value_sql, columns_sql):
    """Register a query and, with ``columns_sql``, its twin."""
    QUERIES[name] = scalar(source, key, value, columns)
    if columns_sql:
        ORACLES[name] = f"SELECT {key}, " + ", ".join(f"{v} AS {k}" for k, v in columns_sql.items()) + f" FROM (SELECT {key}, {value_sql} AS t FROM {source})"


def lit(pattern):
    """A constant text with ``{}`` for a column, in Spark and in SQL."""
    def spark(column):
        head, tail = pattern.split("{}")
        return lambda: F.concat(F.lit(head), F.col(column).cast("string"), F.lit(tail))

    def sql(column):
        head, tail = (x.replace("'", "''").replace("\n", "' || chr(10) || '") for x in pattern.split("{}"))
        return f"('{head}' || {column}::VARCHAR || '{tail}')"

    return spark, sql


def made(name, pattern, source, column, key, columns, columns_sql):
    """As ``add``, for a constant text around a column."""
    spark, sql = lit(pattern)
    add(name, source, key, spark(column), columns, sql(column), columns_sql)


COLLAPSE = "trim(regexp_replace({}, '\\s+', ' ', 'g'))"
TAGS = "regexp_replace({}, '<[^>]+>', '', 'g')"
URLS = "regexp_replace({}, 'https?://\\S+|www\\.\\S+', '', 'g')"
TOKENS = "list_filter(string_split_regex(t, '\\s+'), lambda x: x <> '')"

add("text_collapse_spaces", "documents", "doc_id", "text", lambda c: {"out": T.collapse(c)}, "text", {"out": COLLAPSE.format("t")})
add("text_strip_tags", "pages", "page_id", "html", lambda c: {"out": F.md5(T.strip_tags(c).cast("binary"))}, "html", {"out": f"md5({TAGS.format('t')})"})
made("text_strip_urls", "see {} and www.example.org/x end", "pages", "url", "page_id", lambda c: {"out": T.strip_urls(c)}, {"out": URLS.format("t")})
made("text_strip_emoji", "ok 😀🚀✂ 中 {} 🪀", "customer", "c_name", "c_custkey", lambda c: {"out": T.strip_emoji(c)}, {"out": "regexp_replace(t, '[\\x{1F300}-\\x{1F64F}\\x{1F680}-\\x{1F8FF}\\x{1F900}-\\x{1FAFF}\\x{2702}-\\x{27B0}]+', '', 'g')"})
made("text_strip_emoji_wide", "ok 😀 中文 {} x", "customer", "c_name", "c_custkey", lambda c: {"out": T.strip_emoji(c, wide=True)}, {"out": "regexp_replace(t, '[\\x{1F300}-\\x{1F64F}\\x{24C2}-\\x{1F251}]+', '', 'g')"})
made("text_punctuation", "，。！？；：（{}）“x”‘y’【z】《w》—", "customer", "c_name", "c_custkey", lambda c: {"out": T.punctuation(c)}, {"out": "translate(t, '，。！？；：（）“”‘’【】《》—', ',.!?;:()\"\"''''[]<>-')"})
made("text_half_width", "ＡＢＣ　１２３！～{}", "customer", "c_name", "c_custkey", lambda c: {"out": T.half_width(c)}, {"out": "translate(t, 'ＡＢＣ　１２３！～', 'ABC 123!~')"})
add("text_normalise", "pages", "page_id", "html", lambda c: {"out": F.md5(T.normalise(c, unicode=False).cast("binary"))}, "html", {"out": f"md5(lower({COLLAPSE.format(URLS.format(TAGS.format('t')))}))"})
QUERIES["text_normalise_nfkc"] = scalar("documents", "doc_id", "text", lambda c: {"out": T.normalise(c)})
ORACLES["text_normalise_nfkc"] = f"SELECT doc_id, lower({COLLAPSE.format(URLS.format(TAGS.format('text')))}) AS out FROM documents"
add("text_clean", "documents", "doc_id", "text", lambda c: {"out": T.clean(c)}, "text", {"out": f"trim(regexp_replace({COLLAPSE.format(URLS.format(TAGS.format('t')))}, '[^\\p{{L}}\\p{{N}}\\p{{M}}_\\s.,?!;:()*]', '', 'g'))"})
add("text_sentences", "documents", "doc_id", "text", lambda c: {"n": F.size(T.sentences(c)).cast("long"), "first": F.get(T.sentences(c), 0)}, "replace(replace(text, '.', '!'), '.', '!')", None)
QUERIES["text_sentences"] = scalar("documents", "doc_id", lambda: F.replace("text", F.lit("."), F.lit("!")), lambda c: {"n": F.size(T.sentences(c)).cast("long"), "out": F.array_join(T.sentences(c), "|")})
ORACLES["text_sentences"] = "SELECT doc_id, len(s)::BIGINT AS n, coalesce(array_to_string(s, '|'), '') AS out FROM (SELECT doc_id, list_filter(list_transform(string_split_regex(replace(text, '.', '!'), '[!?]+'), lambda x: regexp_replace(x, '^\\s+|\\s+$', '', 'g')), lambda x: x <> '') AS s FROM documents)"
add("text_remove_stop_words", "documents", "doc_id", "text", lambda c: {"out": F.array_join(T.without(T.tokens(c), ["the", "of", "and", "de"]), " ")}, "text", {"out": f"coalesce(array_to_string(list_filter({TOKENS}, lambda x: x NOT IN ('the', 'of', 'and', 'de')), ' '), '')"})
add("text_hashes", "documents", "doc_id", "text", lambda c: {"md5_hex": F.md5(c.cast("binary")), "sha1_hex": F.sha1(c.cast("binary")), "sha256_hex": F.sha2(c.cast("binary"), 256)}, "text", {"md5_hex": "md5(t)", "sha1_hex": "sha1(t)", "sha256_hex": "sha256(t)"})
add("text_counts", "documents", "doc_id", "text", lambda c: {"n_words": F.size(T.tokens(c)).cast("long"), "n_chars": T.n_chars(c).cast("long"), "n_sentences": T.n_sentences(c).cast("long")}, "text", {"n_words": f"len({TOKENS})::BIGINT", "n_chars": "length(replace(t, ' ', ''))::BIGINT", "n_sentences": "len(list_filter(string_split_regex(t, '[.。!！?？]+(?:\\s|$)'), lambda x: regexp_matches(x, '\\S')))::BIGINT"})
add("text_numbers", "documents", "doc_id", "text", lambda c: {"n": F.size(T.numbers(c)).cast("long"), "total": F.round(F.aggregate(T.numbers(c), F.lit(0.0), lambda a, x: a + F.when(x < 1000, x).otherwise(0.0)), 4)}, "text", {"n": "len(regexp_extract_all(t, '\\d+\\.?\\d*'))::BIGINT", "total": "round(coalesce(list_sum(list_filter(list_transform(regexp_extract_all(t, '\\d+\\.?\\d*'), lambda x: x::DOUBLE), lambda x: x < 1000)), 0.0), 4)"})
add("text_emails", "documents", "doc_id", "text", lambda c: {"out": F.array_join(T.find_all(c, "(?U)" + T.EMAIL), ",")}, "text", {"out": "coalesce(array_to_string(regexp_extract_all(t, '\\b[A-Za-z0-9._%+-]+@[A-Za-z0-9.-]+\\.[A-Z|a-z]{2,}\\b'), ','), '')"})
made("text_find_urls", "see {} and www.example.org end", "pages", "url", "page_id", lambda c: {"out": F.array_join(T.find_all(c, "(?U)" + T.URL), " ")}, {"out": "array_to_string(regexp_extract_all(t, 'https?://\\S+|www\\.\\S+'), ' ')"})
made("text_chinese", "患者 {} 头痛 ok", "customer", "c_name", "c_custkey", lambda c: {"out": T.chinese(c), "is_chinese": T.is_chinese(c), "half": T.is_chinese(c, 0.15)}, {"out": "regexp_replace(t, '[^\\x{4e00}-\\x{9fff}]', '', 'g')", "is_chinese": "length(regexp_replace(t, '[^\\x{4e00}-\\x{9fff}]', '', 'g')) / length(t) >= 0.5", "half": "length(regexp_replace(t, '[^\\x{4e00}-\\x{9fff}]', '', 'g')) / length(t) >= 0.15"})
made("text_dates", "on 2023-01-{} or 3rd Mar 2021 then 12/31 2020", "nation", "n_nationkey", "n_nationkey", lambda c: {"out": F.array_join(T.dates(c), "|")}, {"out": "array_to_string(list_concat(list_concat(regexp_extract_all(t, '\\d{4}[-/年]\\d{1,2}[-/月]\\d{1,2}[日号]?'), regexp_extract_all(t, '\\d{1,2}[-/月]\\d{1,2}[-/日号]?\\s*,?\\s*\\d{4}')), regexp_extract_all(t, '\\d{1,2}(?:st|nd|rd|th)?\\s+(?:Jan|Feb|Mar|Apr|May|Jun|Jul|Aug|Sep|Oct|Nov|Dec)[a-z]*\\s+\\d{4}')), '|')"})
SYLL = "coalesce(list_sum(list_transform(list_filter(string_split_regex(regexp_replace(lower(t), '[^a-z]', ' ', 'g'), ' +'), lambda w: w <> ''), lambda w: greatest(1, len(regexp_extract_all(CASE WHEN w LIKE '%e' AND w NOT LIKE '%le' THEN w[:-2] ELSE w END, '[aeiouy]+'))))), 0)"
add("text_syllables", "documents", "doc_id", "text", lambda c: {"n": T.syllables(c).cast("long")}, "text", {"n": f"({SYLL})::BIGINT"})
QUERIES["text_reading_ease"] = scalar("documents", "doc_id", "text", lambda c: {"ease": F.round(T.reading_ease(c)[0], 6), "grade": F.round(T.reading_ease(c)[1], 6)})
ORACLES["text_reading_ease"] = f"""SELECT doc_id, round(CASE WHEN w > 0 AND s > 0 THEN greatest(0.0, least(100.0, 206.835 - 1.015 * (w / s) - 84.6 * (y / w))) ELSE 0 END, 6) AS ease,
 round(CASE WHEN w > 0 AND s > 0 THEN greatest(0.0, 0.39 * (w / s) + 11.8 * (y / w) - 15.59) ELSE 0 END, 6) AS grade
FROM (SELECT doc_id, len({TOKENS})::DOUBLE AS w, len(list_filter(string_split_regex(t, '[.。!！?？]+(?:\\s|$)'), lambda x: regexp_matches(x, '\\S')))::DOUBLE AS s, ({SYLL})::DOUBLE AS y FROM (SELECT doc_id, text AS t FROM documents))"""
QUERIES["text_reading_ease_zh"] = scalar("documents", "doc_id", "text", lambda c: {"ease": F.round(T.reading_ease_zh(c, T.tokens), 6)})
ORACLES["text_reading_ease_zh"] = f"SELECT doc_id, round(greatest(0.0, least(100.0, 100 - (CASE WHEN s > 0 THEN w / s ELSE 0 END * 0.6 + CASE WHEN w > 0 THEN c / w ELSE 0 END * 5))), 6) AS ease FROM (SELECT doc_id, len({TOKENS})::DOUBLE AS w, length(replace(t, ' ', ''))::DOUBLE AS c, len(list_filter(string_split_regex(t, '[.。!！?？]+(?:\\s|$)'), lambda x: regexp_matches(x, '\\S')))::DOUBLE AS s FROM (SELECT doc_id, text AS t FROM documents))"
made("text_units", "dose {}mg and 5  ml, 7.5kg 3mmHg", "customer", "c_custkey", "c_custkey", lambda c: {"out": T.space_units(c)}, {"out": "regexp_replace(t, '(\\d+(?:\\.\\d+)?)\\s*(mg|ml|kg)', '\\1 \\2', 'g')"})
made("text_expand_abbreviations", "BP {} HR 80, SpO2 97 T 37 WBCx", "nation", "n_nationkey", "n_nationkey", lambda c: {"out": T.expand(c)}, {"out": "replace(replace(replace(replace(t, 'BP', 'BP(血压)'), 'HR', 'HR(心率)'), 'SpO2', 'SpO2(血氧饱和度)'), 'T 37', 'T(体温) 37')"})
made("text_vitals", "BP: 145/{}mmHg T: 37.6℃ 血糖: 6.5mmol/L HR: 88", "nation", "n_nationkey", "n_nationkey", lambda c: {"out": F.array_join(F.transform(T.vitals(c), lambda v: F.concat_ws(":", v["kind"], v["value"].cast("int"), v["second"].cast("int"))), "|")}, {"out": "'blood_pressure:145:' || regexp_extract(t, '145/(\\d+)', 1) || '|temperature:37|blood_glucose:6|HR:88'"})
made("text_diagnoses", "初步诊断：感冒；no {}；感冒\n出院诊断: a,b", "nation", "n_name", "n_nationkey", lambda c: {"out": F.array_join(T.diagnoses(c), "|")}, {"out": "'感冒|' || regexp_extract(t, '(no [^；]+)；', 1) || '|a|b'"})
made("text_medications", "处方：阿司匹林 {}mg，布洛芬\n", "customer", "c_custkey", "c_custkey", lambda c: {"out": F.array_join(F.transform(T.medications(c), lambda m: F.concat_ws("/", m["name"], m["dose"])), "|")}, {"out": "'阿司匹林/' || regexp_extract(t, '(\\d+mg)', 1) || '|布洛芬/'"})
made("text_patient", "姓名：张三 性别：女 年龄：45岁 编号：A-{} 电话：010-1234567 日期：2024-01-02", "customer", "c_custkey", "c_custkey", T.patient, {"name": "'张三'", "gender": "'女'", "age": "'45'", "patient_id": "regexp_extract(t, '编号：([A-Za-z0-9-]+)', 1)", "phone": "'010-1234567'", "visit_date": "'2024-01-02'"})
made("text_terms", "感冒 {} 发烧", "part", "p_name", "p_partkey", lambda c: {"out": F.array_join(T.terms(c, ["发烧", "头疼", "感冒", "blue"]), ",")}, {"out": "array_to_string(list_filter(['发烧', '头疼', '感冒', 'blue'], lambda x: contains(t, x)), ',')"})
made("text_classify", "治疗 手术 检查 {}", "nation", "n_name", "n_nationkey", lambda c: {"treatment": F.round(F.element_at(T.classify(c), "治疗方案"), 6), "tests": F.round(F.element_at(T.classify(c), "检查检验"), 6)}, {"treatment": "round((2 / 7) / (2 / 7 + 1 / 8), 6)", "tests": "round((1 / 8) / (2 / 7 + 1 / 8), 6)"})
made("text_variants", "头痛是什么 {}", "nation", "n_name", "n_nationkey", lambda c: {"n": F.size(T.variants(c)).cast("long"), "out": F.array_join(T.variants(c), "|")}, {"n": "3::BIGINT", "out": "array_to_string(list_sort([t, replace(t, '是什么', '有哪些'), replace(t, '头痛', '头痛(头疼)')]), '|')"})
made("text_safe_filename", 'a<b>:{}"/\\|?*.txt', "nation", "n_name", "n_nationkey", lambda c: {"out": T.safe_filename(c)}, {"out": "regexp_replace(t, '[<>:\"/\\\\|?*]', '_', 'g')"})
made("text_report_template", "{}", "customer", "c_name", "c_custkey", lambda c: {"out": T.fill("姓名: {patient_name} 年龄: {patient_age}\n{x}", {"patient_name": c})}, {"out": "'姓名: ' || t || ' 年龄: 无' || chr(10) || '无'"})
MARK = "translate(text, '.!', '。！')"
TRUNC = "CASE WHEN length(t) <= 120 THEN t WHEN contains(t[61:120], '。') THEN t[:121 - instr(reverse(t[61:120]), '。')] WHEN contains(t[61:120], '？') THEN t[:121 - instr(reverse(t[61:120]), '？')] WHEN contains(t[61:120], '！') THEN t[:121 - instr(reverse(t[61:120]), '！')] WHEN contains(t[61:120], '；') THEN t[:121 - instr(reverse(t[61:120]), '；')] WHEN contains(t[61:120], chr(10)) THEN t[:121 - instr(reverse(t[61:120]), chr(10))] ELSE t[:120] END"
add("kb_truncate", "documents", "doc_id", lambda: F.translate("text", ".!", "。！"), lambda c: {"out": T.truncate(c, 120)}, MARK, {"out": TRUNC})
add("kb_text_title", "documents", "doc_id", "text", lambda c: {"title": T.title(c)}, "text", {"title": "regexp_replace(CASE WHEN instr(t, '？') BETWEEN 2 AND 60 THEN t[:instr(t, '？')] WHEN instr(t, '?') BETWEEN 2 AND 60 THEN t[:instr(t, '?')] WHEN instr(t, '。') BETWEEN 2 AND 60 THEN t[:instr(t, '。')] WHEN instr(t, '.') BETWEEN 2 AND 60 THEN t[:instr(t, '.')] WHEN instr(t, chr(10)) BETWEEN 2 AND 60 THEN t[:instr(t, chr(10))] ELSE t[:40] END, '^\\s+|\\s+$', '', 'g')"})


def similarity(spark, sf_dir):
    """Each conversation's turn against the next one."""
    c = table(spark, sf_dir, "conversations")
    pairs = c.alias("a").join(c.alias("b"), (F.col("a.conv_id") == F.col("b.conv_id")) & (F.col("a.turn") + 1 == F.col("b.turn")))
    a, b = T.tokens(F.col("a.text")), T.tokens(F.col("b.text"))
    return pairs.select("a.conv_id", "a.turn", F.round(T.jaccard(a, b), 6).alias("jaccard"), F.round(T.cosine(a, b), 6).alias("cosine"), F.round(T.edit_ratio(F.col("a.text"), F.col("b.text")), 6).alias("edit"), F.round(T.char_jaccard(F.col("a.text"), F.col("b.text")), 6).alias("chars"))


QUERIES["text_similarity"] = similarity
#: DuckDB's edit distance counts bytes, so the SQL writes the letters beyond ASCII as control characters, one for one.
LETTERS = "ÄÇÈÉÊÍÑÓÖÜßäçèéêíñóöü"
CONTROLS = "".join(map(chr, [*range(1, 9), *range(14, 27)]))
ORACLES["text_similarity"] = """
WITH p AS (SELECT a.conv_id, a.turn, list_filter(string_split_regex(a.text, '\\s+'), lambda x: x <> '') AS x, list_filter(string_split_regex(b.text, '\\s+'), lambda x: x <> '') AS y, translate(a.text, '{LETTERS}', '{CONTROLS}') AS s, translate(b.text, '{LETTERS}', '{CONTROLS}') AS u
  FROM conversations a JOIN conversations b ON a.conv_id = b.conv_id AND a.turn + 1 = b.turn),
n AS (SELECT conv_id, turn, sum(i * j) AS xy, sum(i * i) AS xx, sum(j * j) AS yy FROM (
  SELECT conv_id, turn, w, count(*) FILTER (WHERE side = 'x') AS i, count(*) FILTER (WHERE side = 'y') AS j FROM (
    SELECT conv_id, turn, unnest(x) AS w, 'x' AS side FROM p UNION ALL SELECT conv_id, turn, unnest(y), 'y' FROM p) GROUP BY ALL) GROUP BY ALL)
SELECT p.conv_id, p.turn, round(CASE WHEN len(x) + len(y) = 0 THEN 1.0 ELSE len(list_intersect(x, y)) / len(list_distinct(list_concat(x, y))) END, 6) AS jaccard,
  round(CASE WHEN xx * yy = 0 THEN 0 ELSE xy / (sqrt(xx) * sqrt(yy)) END, 6) AS cosine,
  round(CASE WHEN greatest(length(s), length(u)) = 0 THEN 1.0 ELSE 1 - levenshtein(s, u) / greatest(length(s), length(u)) END, 6) AS edit,
  round(CASE WHEN s = '' OR u = '' THEN 0.0 ELSE len(list_intersect(string_split(s, ''), string_split(u, ''))) / len(list_distinct(list_concat(string_split(s, ''), string_split(u, '')))) END, 6) AS chars
FROM p LEFT JOIN n USING (conv_id, turn)
""".replace("{LETTERS}", LETTERS).replace("{CONTROLS}", CONTROLS)


def sequence(spark, sf_dir):
    """Similarity by longest matching blocks of consecutive turns."""
    c = table(spark, sf_dir, "conversations")
    pairs = c.alias("a").join(c.alias("b"), (F.col("a.conv_id") == F.col("b.conv_id")) & (F.col("a.turn") + 1 == F.col("b.turn")))
    return pairs.select("a.conv_id", "a.turn", F.round(T.sequence_ratio(F.col("a.text"), F.col("b.text")), 6).alias("ratio"))


QUERIES["text_sequence_ratio"] = sequence


def segmented(spark, sf_dir):
    """Word frequencies under the default segmenter."""
    words = table(spark, sf_dir, "documents", "text").select(F.explode(T.words_and_cjk(F.col("text"))).alias("word"))
    return words.groupBy("word").agg(F.count("*").alias("n"))


QUERIES["text_segmented_frequency"] = segmented
ORACLES["text_segmented_frequency"] = "SELECT word, count(*)::BIGINT AS n FROM (SELECT unnest(regexp_extract_all(lower(text), '[\\p{L}\\p{M}\\p{Nd}\\p{Pc}]+')) AS word FROM documents) GROUP BY word"


def frequency(spark, sf_dir):
    """How often each word occurs."""
    return table(spark, sf_dir, "documents", "text").select(F.explode(T.tokens(F.col("text"))).alias("word")).groupBy("word").agg(F.count("*").alias("n"))


QUERIES["text_word_frequency"] = frequency
ORACLES["text_word_frequency"] = "SELECT word, count(*)::BIGINT AS n FROM (SELECT unnest(list_filter(string_split_regex(text, '\\s+'), lambda x: x <> '')) AS word FROM documents) GROUP BY word"


def _segmented(mode):
    def run(spark, sf_dir):
        """All documents with their spaces taken out, by the words of the corpus."""
        d = table(spark, sf_dir, "documents", "doc_id", "text")
        joined = d.withColumn("text", F.replace("text", F.lit(" "), F.lit("")))
        out = G.segment(joined, G.dictionary(d), mode=mode)
        return out.select("doc_id", F.size("words").cast("long").alias("n_words"), F.md5(F.array_join("words", " ").cast("binary")).alias("words"))

    return run


for _mode in G.MODES:
    QUERIES[f"segment_{_mode}"] = _segmented(_mode)
