"""Text functions as column expressions.

Patterns start with ``(?U)`` where white space, digits and word characters are
meant as Unicode has them.
"""

from __future__ import annotations

import unicodedata

import pandas as pd
from pyspark.sql import Column
from pyspark.sql import functions as F
from pyspark.sql.types import DoubleType, StringType

# Lookup tables and word lists that results depend on.
PUNCTUATION = {"，": ",", "。": ".", "！": "!", "？": "?", "；": ";", "：": ":", "（": "(", "）": ")", "“": '"', "”": '"', "‘": "'", "’": "'"}
MORE_PUNCTUATION = {"【": "[", "】": "]", "《": "<", "》": ">", "—": "-"}
UNITS = ["mg", "g", "kg", "ml", "l", "mmol", "mol", "mmHg", "kPa", "mm", "cm", "m", "IU", "U", "μg", "ng", "pg", "mmol/L", "g/L", "mEq/L"]
ABBREVIATIONS = {"BP": "血压", "HR": "心率", "RR": "呼吸频率", "BT": "体温", "SpO2": "血氧饱和度", "WBC": "白细胞计数", "RBC": "红细胞计数", "Hb": "血红蛋白", "T": "体温", "P": "脉搏", "R": "呼吸"}
CATEGORIES = {
    "症状描述": ["疼痛", "不适", "感觉", "出现", "症状", "感到"],
    "疾病信息": ["疾病", "病因", "病理", "机制", "影响", "发病率"],
    "治疗方案": ["治疗", "手术", "药物", "方案", "效果", "疗法", "用药"],
    "预防保健": ["预防", "保健", "护理", "饮食", "建议", "生活方式"],
    "检查检验": ["检查", "化验", "影像", "结果", "报告", "CT", "核磁", "B超"],
}
MEDICINES = ["阿司匹林", "布洛芬", "对乙酰氨基酚", "奥美拉唑", "二甲双胍", "利尿酸", "辛伐他汀", "氨氯地平", "氯沙坦", "甲状腺素", "胰岛素", "地塞米松", "西药", "中药", "抗生素", "消炎药", "止痛药", "退烧药", "血压药"]
EMOJI = r"[\x{1F600}-\x{1F64F}\x{1F300}-\x{1F5FF}\x{1F680}-\x{1F6FF}\x{1F700}-\x{1F77F}\x{1F780}-\x{1F7FF}\x{1F800}-\x{1F8FF}\x{1F900}-\x{1F9FF}\x{1FA00}-\x{1FA6F}\x{1FA70}-\x{1FAFF}\x{2702}-\x{27B0}]+"
#: With the wide last range, which also takes CJK, kana and hangul.
EMOJI_WIDE = r"[\x{1F600}-\x{1F64F}\x{1F300}-\x{1F5FF}\x{1F680}-\x{1F6FF}\x{1F700}-\x{1F77F}\x{1F780}-\x{1F7FF}\x{1F800}-\x{1F8FF}\x{1F900}-\x{1F9FF}\x{1FA00}-\x{1FA6F}\x{1FA70}-\x{1FAFF}\x{2702}-\x{27B0}\x{24C2}-\x{1F251}]+"
URL = r"https?://\S+|www\.\S+"
EMAIL = r"\b[A-Za-z0-9._%+-]+@[A-Za-z0-9.-]+\.[A-Z|a-z]{2,}\b"
DATES = (
    r"\d{4}[-/年]\d{1,2}[-/月]\d{1,2}[日号]?",
    r"\d{1,2}[-/月]\d{1,2}[-/日号]?\s*,?\s*\d{4}",
    r"\d{1,2}(?:st|nd|rd|th)?\s+(?:Jan|Feb|Mar|Apr|May|Jun|Jul|Aug|Sep|Oct|Nov|Dec)[a-z]*\s+\d{4}",
)
#: What the corpus cleaner removes.
NOT_ALLOWED = r"(?U)[^\w\s\x{4e00}-\x{9fff}.,?!;:()，。？！；：（）*]"
DIAGNOSIS_HEADINGS = ("诊断", "初步诊断", "临床诊断", "出院诊断")
DIAGNOSIS_LINE = r"[：:]\s*(.+?)(?=\n|$)"
PRESCRIPTION_LINE = r"(?:用药|处方|医嘱)[：:]\s*(.+?)(?=\n|$)"
MEDICINE_NAME = r"^([^\d]+)"
MEDICINE_DOSE = r"(\d+\.?\d*\s*(?:mg|g|ml|mcg|μg|IU|U|单位))"
PATIENT = {
    "name": r"(?:姓名|患者)[：:]\s*([^\s,，。.]+)",
    "gender": "性别[：:]\\s*(男|女)",
    "age": r"年龄[：:]\s*(\d+)(?:\s*岁)?",
    "patient_id": r"(?:ID|病号|编号|档案号)[：:]\s*([A-Za-z0-9-]+)",
    "phone": r"(?:电话|手机|联系方式)[：:]\s*(\d{3,}[-\s]?\d{4,}(?:[-\s]?\d{4})?)",
    "visit_date": r"(?:日期|就诊日期|门诊日期)[：:]\s*(\d{4}[-/年]\d{1,2}[-/月]\d{1,2}[日]?)",
}
PRESSURE = r"BP[：:]\s*(\d+)/(\d+)\s*(?:mmHg)?"
TEMPERATURE = r"(?:T|BT|体温)[：:]\s*(\d+\.?\d*)\s*(?:℃|度)"
GLUCOSE = r"血糖[：:]\s*(\d+\.?\d*)\s*(?:mmol/L)"
NAMED_READING = r"(?U)(\w+)\s*(?:[:：])\s*(\d+\.?\d*)\s*(?:[a-zA-Z]+(?:/[a-zA-Z]+)?)?"
READ_ELSEWHERE = ("BP", "T", "BT", "体温", "血糖")
REWORDINGS = (("是什么", "有哪些"), ("如何", "怎么样"), ("头痛", "头痛(头疼)"), ("感冒", "感冒(上呼吸道感染)"))
KEYWORD_FORM = ("关于", "和", "的信息")
# End of the fixed values.


def strip(c: Column) -> Column:
    """Without white space at either end."""
    return F.regexp_replace(c, r"(?U)^\s+|\s+$", "")


def collapse(c: Column) -> Column:
    """Each run of white space as one space, none at the ends."""
    return F.trim(F.regexp_replace(c, r"(?U)\s+", " "))


def strip_tags(c: Column) -> Column:
    """Without anything in angle brackets; what scripts hold stays."""
    return F.regexp_replace(c, "<[^>]+>", "")


def strip_urls(c: Column) -> Column:
    """Without web addresses."""
    return F.regexp_replace(c, "(?U)" + URL, "")


def strip_emoji(c: Column, wide: bool = False) -> Column:
    """Without emoji; ``wide`` takes the range that holds CJK as well."""
    return F.regexp_replace(c, EMOJI_WIDE if wide else EMOJI, "")


def punctuation(c: Column, more: bool = True) -> Column:
    """Full-width punctuation as ASCII."""
    table = PUNCTUATION | (MORE_PUNCTUATION if more else {})
    return F.translate(c, "".join(table), "".join(table.values()))


def half_width(c: Column) -> Column:
    """Full-width characters and the ideographic space as ASCII."""
    return F.translate(c, "　" + "".join(map(chr, range(0xFF01, 0xFF5F))), " " + "".join(map(chr, range(0x21, 0x7F))))


@F.pandas_udf(StringType())
def nfkc(texts: pd.Series) -> pd.Series:
    """Unicode NFKC, which has no built-in counterpart."""
    return texts.map(lambda t: t if t is None or t.isascii() else unicodedata.normalize("NFKC", t))


def normalise(c: Column, lowercase=True, tags=True, urls=True, emoji=False, unicode=True, spaces=True, punct=False, width=False) -> Column:
    """The steps that are asked for, always in this order: Unicode, tags, URLs, emoji, spaces, punctuation, width, case."""
    for wanted, step in ((unicode, nfkc), (tags, strip_tags), (urls, strip_urls), (emoji, strip_emoji), (spaces, collapse), (punct, punctuation), (width, half_width), (lowercase, F.lower)):
        c = step(c) if wanted else c
    return c


def clean(c: Column) -> Column:
    """The corpus cleaner without masking: tags, URLs, spaces, allowed characters, punctuation, ends."""
    c = collapse(strip_urls(strip_tags(F.coalesce(c, F.lit("")))))
    return strip(punctuation(F.regexp_replace(c, NOT_ALLOWED, ""), more=False))


def parts(c: Column, pattern: str) -> Column:
    """The stripped pieces between matches, blank ones left out."""
    return F.filter(F.transform(F.split(c, pattern), strip), lambda x: x != "")


def sentences(c: Column) -> Column:
    """Sentences between terminal marks."""
    return parts(c, "[。！？!?]+")


def n_sentences(c: Column) -> Column:
    """Number of sentences, a mark counting only before white space or the end."""
    return F.size(parts(c, r"(?U)[.。!！?？]+(?:\s|$)"))


def tokens(c: Column) -> Column:
    """The runs of other characters than white space."""
    return F.filter(F.split(c, r"(?U)\s+"), lambda x: x != "")


def words_and_cjk(c: Column) -> Column:
    """The default segmenter: lower-cased word tokens, CJK characters one by one and as pairs."""
    run = F.regexp_extract_all(F.lower(c), F.lit(r"[\x{4e00}-\x{9fff}]+|(?U)[\w&&[^\x{4e00}-\x{9fff}]]+"), F.lit(0))
    pair = lambda w: F.when(F.length(w) > 1, F.transform(F.sequence(F.lit(1), F.length(w) - 1), lambda i: F.substring(w, i, F.lit(2)))).otherwise(F.expr("CAST(array() AS array<string>)"))
    split = lambda w: F.when(w.rlike(r"^[\x{4e00}-\x{9fff}]"), F.concat(F.filter(F.split(w, ""), lambda x: x != ""), pair(w))).otherwise(F.array(w))
    return F.flatten(F.transform(run, split))


def without(words: Column, stop: list[str]) -> Column:
    """Words that aren't in ``stop``; repeats stay."""
    return F.filter(words, lambda w: ~w.isin(stop))


def n_chars(c: Column, spaces: bool = False) -> Column:
    """Number of code points, U+0020 only if ``spaces``."""
    return F.length(c if spaces else F.replace(c, F.lit(" "), F.lit("")))


def jaccard(a: Column, b: Column) -> Column:
    """Similarity of two word lists as sets; 1 for two empty ones."""
    both, either = F.size(F.array_intersect(a, b)), F.size(F.array_union(a, b))
    return F.when(either == 0, 1.0).otherwise(both.cast("double") / F.greatest(either, F.lit(1)))


def cosine(a: Column, b: Column) -> Column:
    """Similarity of two word lists by counts; 0 if one is empty."""
    count = lambda xs, w: (F.size(xs) - F.size(F.array_remove(xs, w))).cast("double")
    dot = lambda xs, ys: F.aggregate(F.array_intersect(xs, ys), F.lit(0.0), lambda s, w: s + count(xs, w) * count(ys, w))
    made = lambda p: F.struct(dot(p["a"], p["b"]).alias("ab"), (F.sqrt(dot(p["a"], p["a"])) * F.sqrt(dot(p["b"], p["b"]))).alias("norm"))
    # Bound once: inside a lambda an expression would be evaluated again for each word.
    return F.element_at(F.transform(F.transform(F.array(F.struct(a.alias("a"), b.alias("b"))), made), lambda r: F.when(r["norm"] == 0, 0.0).otherwise(r["ab"] / F.when(r["norm"] == 0, 1.0).otherwise(r["norm"]))), 1)


def edit_ratio(a: Column, b: Column) -> Column:
    """1 less the edit distance over the longer length; 1 for two empty texts."""
    longest = F.greatest(F.length(a), F.length(b))
    return F.when(longest == 0, 1.0).otherwise(1 - F.levenshtein(a, b) / F.greatest(longest, F.lit(1)))


def char_jaccard(a: Column, b: Column) -> Column:
    """Jaccard of the characters; 0 if either text is blank."""
    chars = lambda c: F.array_distinct(F.filter(F.split(c, ""), lambda x: x != ""))
    return F.when((F.coalesce(a, F.lit("")) == "") | (F.coalesce(b, F.lit("")) == ""), 0.0).otherwise(jaccard(chars(a), chars(b)))


def simhash(words: Column) -> Column:
    """64 votes of the words' hashes, repeats counted, as a decimal number; 0 without words.

    A word's hash is the second half of its MD5, so hashes agree with those of
    the usual library.
    """
    hashes = F.transform(words, lambda w: F.conv(F.substring(F.md5(w.cast("binary")), 17, 16), 16, -10).cast("long"))
    bit = lambda h, b: F.call_function("shiftrightunsigned", h, b).bitwiseAND(F.lit(1).cast("long"))

    def votes(h: Column) -> Column:
        ones = F.transform(F.sequence(F.lit(0), F.lit(63)), lambda b: F.aggregate(h, F.lit(0).cast("long"), lambda a, x: a + bit(x, b)) * 2 > F.size(h))
        low_first = F.array_join(F.transform(F.reverse(ones), lambda v: v.cast("int").cast("string")), "")
        return F.conv(low_first, 2, 10)

    return F.element_at(F.transform(F.array(hashes), votes), 1)


@F.pandas_udf(DoubleType())
def sequence_ratio(a: pd.Series, b: pd.Series) -> pd.Series:
    """Twice the matching characters over all, by the longest matching blocks."""
    from difflib import SequenceMatcher

    return pd.Series([SequenceMatcher(None, x, y).ratio() for x, y in zip(a, b, strict=True)])


def find_all(c: Column, pattern: str, group: int = 0) -> Column:
    """All matches of a pattern."""
    return F.regexp_extract_all(c, F.lit(pattern), F.lit(group))


def numbers(c: Column) -> Column:
    """The numbers in a text."""
    return F.transform(find_all(c, r"(?U)\d+\.?\d*"), lambda x: x.cast("double"))


def dates(c: Column) -> Column:
    """Dates, by family of pattern."""
    return F.concat(*[find_all(c, "(?U)" + p) for p in DATES])


def chinese(c: Column) -> Column:
    """The CJK ideographs of a text, put together."""
    return F.regexp_replace(c, r"[^\x{4e00}-\x{9fff}]", "")


def is_chinese(c: Column, share: float = 0.5) -> Column:
    """Whether at least ``share`` of the characters are ideographs."""
    return F.when(F.length(c) == 0, 0.0).otherwise(F.length(chinese(c)) / F.greatest(F.length(c), F.lit(1))) >= share


def syllables(c: Column) -> Column:
    """Estimated English syllables: vowel groups of each word, a silent final e aside, at least one."""
    words = F.filter(F.split(F.regexp_replace(F.lower(c), "[^a-z]", " "), " +"), lambda w: w != "")
    bare = lambda w: F.when(w.endswith("e") & ~w.endswith("le"), F.substring(w, F.lit(1), F.length(w) - 1)).otherwise(w)
    return F.aggregate(F.transform(words, lambda w: F.greatest(F.lit(1), F.size(find_all(bare(w), "[aeiouy]+")))), F.lit(0), lambda s, x: s + x)


def reading_ease(c: Column) -> tuple[Column, Column]:
    """English reading ease, 0 to 100, and grade, from 0."""
    w, s, y = F.size(tokens(c)), n_sentences(c), syllables(c)
    some = (w > 0) & (s > 0)
    per_s, per_w = w / F.greatest(s, F.lit(1)), y / F.greatest(w, F.lit(1))
    ease = F.when(some, 206.835 - 1.015 * per_s - 84.6 * per_w).otherwise(0.0)
    grade = F.when(some, 0.39 * per_s + 11.8 * per_w - 15.59).otherwise(0.0)
    return F.greatest(F.lit(0.0), F.least(F.lit(100.0), ease)), F.greatest(F.lit(0.0), grade)


def reading_ease_zh(c: Column, segment=words_and_cjk) -> Column:
    """Chinese reading ease from mean sentence and word lengths, 0 to 100."""
    w, s = F.size(segment(c)), n_sentences(c)
    per_s = F.when(s > 0, w / F.greatest(s, F.lit(1))).otherwise(0.0)
    per_w = F.when(w > 0, n_chars(c) / F.greatest(w, F.lit(1))).otherwise(0.0)
    return F.greatest(F.lit(0.0), F.least(F.lit(100.0), 100 - (per_s * 0.6 + per_w * 5)))


def space_units(c: Column, any_case: bool = False) -> Column:
    """A number and a known unit with one space between; mixed-case units only with ``any_case``."""
    known = [u for u in UNITS if any_case or u == u.lower()]
    known = "|".join(sorted(known, key=len, reverse=True))
    return F.regexp_replace(c, rf"(\d+(?:\.\d+)?)\s*((?i:{known}))(?![a-zA-Z/])", "$1 $2")


def expand(c: Column) -> Column:
    """Each known abbreviation with its meaning behind it, one after the other."""
    for short, full in ABBREVIATIONS.items():
        c = F.regexp_replace(c, rf"(?<![a-zA-Z]){short}(?![a-zA-Z])", f"{short}({full})")
    return c


def terms(c: Column, dictionary: list[str]) -> Column:
    """The dictionary's terms that occur, in its order."""
    return F.filter(F.array(*[F.lit(t) for t in dictionary]), lambda t: F.contains(c, t))


def classify(c: Column) -> Column:
    """Map from category to its share of the hits; all 0 where nothing hits."""
    hit = {k: sum((F.contains(c, F.lit(w)).cast("int") for w in words), F.lit(0)) / len(words) for k, words in CATEGORIES.items()}
    total = sum(hit.values(), F.lit(0.0))
    return F.create_map(*[x for k, v in hit.items() for x in (F.lit(k), F.when(total == 0, 0.0).otherwise(v / F.when(total == 0, 1.0).otherwise(total)))])


def diagnoses(c: Column) -> Column:
    """Diagnoses behind their headings, split at the first kind of mark present, each once."""
    found = F.concat(*[find_all(c, heading + DIAGNOSIS_LINE, 1) for heading in DIAGNOSIS_HEADINGS])
    cut = lambda x, m: F.filter(F.transform(F.split(x, m), strip), lambda y: y != "")
    each = lambda x: F.when(F.contains(x, F.lit("；")), cut(x, "；")).when(F.contains(x, F.lit(";")), cut(x, ";")).when(F.contains(x, F.lit("，")), cut(x, "，")).when(F.contains(x, F.lit(",")), cut(x, ",")).otherwise(F.array(strip(x)))
    return F.array_distinct(F.flatten(F.transform(found, each)))


def medications(c: Column) -> Column:
    """Array of (name, dose, raw) behind a prescription heading, else of the known names that occur."""
    items = F.filter(F.flatten(F.transform(find_all(c, PRESCRIPTION_LINE, 1), lambda x: F.transform(F.split(x, "[,，;；]"), strip))), lambda x: x != "")
    row = lambda x: F.struct(strip(F.regexp_extract(x, MEDICINE_NAME, 1)).alias("name"), F.regexp_extract(x, MEDICINE_DOSE, 1).alias("dose"), x.alias("raw"))
    known = F.transform(terms(c, MEDICINES), lambda t: F.struct(t.alias("name"), F.lit("").alias("dose"), t.alias("raw")))
    return F.when(F.size(items) > 0, F.transform(items, row)).otherwise(known)


def patient(c: Column) -> dict[str, Column]:
    """Six fields about a patient, null where absent."""
    return {k: F.nullif(F.regexp_extract(c, p, 1), F.lit("")) for k, p in PATIENT.items()}


def vitals(c: Column) -> Column:
    """Array of (kind, value, high part) readings: pressure pairs, temperature, glucose, other named numbers."""
    one = lambda kind, p: F.transform(find_all(c, p, 1), lambda x: F.struct(F.lit(kind).alias("kind"), x.cast("double").alias("value"), F.lit(None).cast("double").alias("second")))
    pair = F.zip_with(find_all(c, PRESSURE, 1), find_all(c, PRESSURE, 2), lambda x, y: F.struct(F.lit("blood_pressure").alias("kind"), x.cast("double").alias("value"), y.cast("double").alias("second")))
    other = F.filter(F.zip_with(find_all(c, NAMED_READING, 1), find_all(c, NAMED_READING, 2), lambda k, v: F.struct(k.alias("kind"), v.cast("double").alias("value"), F.lit(None).cast("double").alias("second"))), lambda x: ~x["kind"].isin(*READ_ELSEWHERE))
    return F.concat(pair, one("temperature", TEMPERATURE), one("blood_glucose", GLUCOSE), other)


def variants(c: Column, keywords: Column | None = None) -> Column:
    """The question, a form from its keywords, and four rewordings; each once, sorted."""
    forms = [c, *[F.replace(c, F.lit(x), F.lit(y)) for x, y in REWORDINGS]]
    if keywords is not None:
        about, between, behind = KEYWORD_FORM
        forms.append(F.when(F.size(keywords) > 0, F.concat(F.lit(about), F.array_join(F.slice(keywords, 1, 3), between), F.lit(behind))))
    return F.array_sort(F.array_distinct(F.array_compact(F.array(*forms))))


def safe_filename(c: Column, by: str = "_") -> Column:
    """Characters that file systems refuse, replaced."""
    return F.regexp_replace(c, r'[<>:"/\\|?*]', by)


def fill(template: str, values: dict[str, Column], rest: str = "无") -> Column:
    """``{name}`` in the template by its value; other braces by ``rest``."""
    out = F.lit(template)
    for k, v in values.items():
        out = F.replace(out, F.lit("{" + k + "}"), F.coalesce(v.cast("string"), F.lit(rest)))
    return F.regexp_replace(out, r"\{[^}]+\}", rest)


def truncate(c: Column, longest: int) -> Column:
    """At most ``longest`` characters, up to a sentence's end in the second half if there is one."""
    out = F.substring(c, 1, longest)
    half = F.substring(c, longest // 2 + 1, longest - longest // 2)
    for mark in ("\n", "；", "！", "？", "。"):  # the last one tried is the first in rank
        at = F.locate(mark, F.reverse(half))
        out = F.when(at > 0, F.substring(c, F.lit(1), longest - at + 1)).otherwise(out)
    return F.when(F.length(c) <= longest, c).otherwise(out)


def title(c: Column) -> Column:
    """Up to the first mark, in order of rank, that ends within 60 characters; else 40 characters."""
    out = F.lit("")
    for mark in ("\n", ".", "。", "?", "？"):
        at = F.locate(mark, c)
        out = F.when((at > 1) & (at <= 60), strip(F.substring(c, F.lit(1), at))).otherwise(out)
    return F.when(out == "", strip(F.substring(c, 1, 40))).otherwise(out)
