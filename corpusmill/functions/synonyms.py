"""Synonyms that widen a query before a lexical search."""

from __future__ import annotations

from pyspark.sql import Column
from pyspark.sql import functions as F

# A term and what it is also called, in the order in which terms are looked for.
SYNONYMS = {
    "高血压": ("高血压病", "血压高", "血压升高"),
    "糖尿病": ("血糖高", "血糖升高", "消渴症"),
    "冠心病": ("冠状动脉粥样硬化性心脏病", "冠状动脉硬化"),
    "心梗": ("心肌梗死", "心肌梗塞", "急性心肌梗死"),
    "脑梗": ("脑梗死", "脑梗塞", "缺血性脑卒中"),
    "中风": ("脑卒中", "脑血管意外"),
    "肝炎": ("病毒性肝炎", "肝脏炎症"),
    "胃炎": ("胃黏膜炎症", "慢性胃炎", "急性胃炎"),
    "肺炎": ("肺部感染", "肺部炎症"),
    "感冒": ("上呼吸道感染", "伤风", "普通感冒"),
    "发烧": ("发热", "体温升高", "高热"),
    "头疼": ("头痛", "偏头痛", "头部疼痛"),
    "拉肚子": ("腹泻", "泻肚", "水样便"),
    "便秘": ("排便困难", "大便干燥"),
    "失眠": ("睡眠障碍", "入睡困难", "不寐"),
    "抑郁": ("抑郁症", "忧郁症"),
    "过敏": ("变态反应", "超敏反应"),
    "哮喘": ("支气管哮喘",),
    "痛风": ("高尿酸血症",),
    "贫血": ("血红蛋白低",),
    "甲亢": ("甲状腺功能亢进", "甲状腺功能亢进症"),
    "甲减": ("甲状腺功能减退", "甲状腺功能减退症"),
    "肾结石": ("泌尿系结石", "尿路结石"),
    "胆结石": ("胆囊结石", "胆石症"),
    "痔疮": ("痔", "内痔", "外痔"),
    "湿疹": ("湿疹性皮炎",),
    "骨折": ("骨裂", "断骨"),
    "腰椎间盘突出": ("腰突", "椎间盘突出", "腰椎突出"),
    "颈椎病": ("颈椎退行性变", "颈椎综合征"),
}
# End of the fixed values.


def terms(dictionary: dict = SYNONYMS) -> list[tuple[str, list[str]]]:
    """Every term, heads before their synonyms, with the first two synonyms of its head other than itself."""
    return [(t, [s for s in also[:2] if s != t]) for head, also in dictionary.items() for t in (head, *also)]


def expand(query: Column, dictionary: dict = SYNONYMS) -> Column:
    """The query, behind it the synonyms of the first term found in it that it does not hold yet.  A null stays null."""
    row = lambda t, also: F.struct(F.lit(t).alias("t"), (F.array(*map(F.lit, also)) if also else F.array().cast("array<string>")).alias("s"))
    known = F.array(*[row(t, also) for t, also in terms(dictionary)])
    first = F.get(F.filter(known, lambda x: F.contains(query, x["t"])), 0)
    added = F.filter(F.coalesce(first["s"], F.array().cast("array<string>")), lambda s: ~F.contains(query, s))
    return F.when(query.isNull(), query).otherwise(F.array_join(F.concat(F.array(query), added), " "))
