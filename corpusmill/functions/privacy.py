"""Personal data: fifteen detectors, applied in order to text already masked."""

from __future__ import annotations

from dataclasses import dataclass
from functools import reduce
from operator import or_

from pyspark.sql import Column
from pyspark.sql import functions as F

# The surnames, patterns, labels and the mask that results depend on.
MASK = "[隐私信息已脱敏]"
SURNAMES = (
    "张王李刘陈杨黄赵吴周徐孙马朱胡郭何高林罗郑梁谢宋唐许韩冯邓曹彭曾萧田董"
    "袁潘于蒋蔡余杜叶程苏魏吕丁任沈姚卢姜崔钟谭陆汪范金石廖贾夏韦付方白邹孟"
    "熊秦邱江尹薛闫段雷侯龙史陶黎贺顾毛郝龚邵万钱严覃武戴莫孔向汤"
)
TITLES = "先生|女士|小姐|太太|医生|大夫|师傅|同学|老师|教授|主任|院长|副院长|护士|护士长|患者|病人|家属|父亲|母亲|爷爷|奶奶|外公|外婆|哥哥|姐姐|弟弟|妹妹|儿子|女儿|老公|老婆|丈夫|妻子"
ADDRESS = (
    r"(省|市|区|县|镇|乡|村|街道|路|街|巷|弄|里|苑|园|庄|小区|大厦|广场|中心|大楼)[\x{4e00}-\x{9fff}\w]*\d+号"
    r"(?:\d+[-一]?\d*栋?)?(?:\d+[-一]?\d*单元?)?(?:\d+[-一]?\d*[层楼]?)?(?:\d+[-一]?\d*室?)?"
)
DAY = r"(20\d{2}[年\-/\.]\d{1,2}[月\-/\.]\d{1,2}[日号]?)"


@dataclass(frozen=True)
class Detector:
    """``keep``: what a match leaves before the mask: nothing, its first group, or two characters behind its last colon."""

    key: str
    label: str
    pattern: str
    keep: str = ""
    level: str = "critical"
    any_case: bool = False

    @property
    def chinese(self) -> bool:
        """Whether every match holds a Chinese character."""
        return self.key in ("insurance", "address", "name_title", "full_name", "record", "lab_report", "visit")


DETECTORS = (
    Detector("id_card", "身份证号", r"\b[1-9]\d{5}(18|19|20)\d{2}(0[1-9]|1[0-2])(0[1-9]|[12]\d|3[01])\d{3}[\dxX]\b"),
    Detector("passport", "护照号", r"\b[EGP]\d{8}\b|\b[A-Z]{1,2}\d{6,9}\b"),
    Detector("mobile", "手机号", r"\b1[3-9]\d{9}\b"),
    Detector("landline", "座机号", r"\b0\d{2,3}[-\s]?\d{7,8}\b"),
    Detector("messenger", "微信号", r"(?:微信号?[:：]?\s*|微信[:：]?\s*|wx[:：]?\s*)([a-zA-Z0-9_-]{6,20})\b", "colon", any_case=True),
    Detector("email", "邮箱", r"\b[A-Za-z0-9._%+-]+@[A-Za-z0-9.-]+\.[A-Z|a-z]{2,}\b"),
    Detector("insurance", "社保/医保号", r"(?:社保号?|医保号?|社会保障号?|医疗保险号?)[:：]?\s*([A-Z0-9]{15,20})\b", "colon", any_case=True),
    Detector("address", "精确住址", ADDRESS),
    Detector("name_title", "姓名（含称谓）", rf"([{SURNAMES}])({TITLES})", "group", "strict"),
    Detector("full_name", "姓名", rf"([{SURNAMES}])[\x{{4e00}}-\x{{9fff}}]{{1,3}}(?=\s|，|。|、|的|说|讲|表示|认为|指出|提到|告诉|问|答)", "group", "strict"),
    Detector("record", "病历号/住院号", r"(?:病历号?|住院号?|门诊号?|就诊号?|检查号?|报告号?|单号?)[:：]?\s*([A-Z0-9]{6,20})\b", "colon", any_case=True),
    Detector("lab_report", "检验报告", rf"(检验|化验|检查|报告).*?{DAY}", level="report", any_case=True),
    Detector("visit", "可识别医疗信息", DAY + r".*?([\x{4e00}-\x{9fff}]{2,10}(?:医院|医学院|卫生院|诊所|中心)).*?([\x{4e00}-\x{9fff}]{2,6}(?:科|室|门诊|病房|中心))", any_case=True),
    Detector("bank_card", "银行卡号", r"\b\d{16,19}\b"),
    Detector("ip", "IP地址", r"\b(?:\d{1,3}\.){3}\d{1,3}\b", level="report"),
)
# End of the fixed values.


def pattern(d: Detector) -> str:
    """The pattern with Unicode classes, and any case where the detector asks for it."""
    return ("(?Ui)" if d.any_case else "(?U)") + d.pattern


def has_chinese(c: Column) -> Column:
    """A cheap test that spares texts without Chinese characters the costly patterns."""
    return c.rlike(r"[\x{4e00}-\x{9fff}]")


#: What every match of a detector holds: six digits in a row, or as given.
_DIGITS = r"(?U)\d{6}"
NEEDED = {"id_card": _DIGITS, "passport": _DIGITS, "mobile": _DIGITS, "landline": _DIGITS, "bank_card": _DIGITS, "messenger": "微信|[wW][xX]", "email": "@", "ip": r"(?U)\d\.\d"}


def may_match(c: Column, d: Detector) -> Column:
    """A cheap test that spares texts without what every match holds the detector's pattern."""
    return has_chinese(c) if d.chinese else c.rlike(NEEDED[d.key])


def mask(c: Column, d: Detector, by: str = MASK) -> Column:
    """All matches of one detector masked."""
    return F.when(has_chinese(c), _masked(c, d, by)).otherwise(c) if d.chinese else _masked(c, d, by)


def _masked(c: Column, d: Detector, by: str) -> Column:
    if d.keep == "colon":
        left = lambda m: F.concat(F.substring(F.element_at(F.split(m, "[:：]"), -1), 1, 2), F.lit(by))
        hits = F.transform(F.regexp_extract_all(c, F.lit(pattern(d)), F.lit(0)), left)
        joined = F.array_join(F.zip_with(F.split(c, pattern(d), -1), hits, lambda part, hit: F.concat(part, F.coalesce(hit, F.lit("")))), "")
        return F.when(c.rlike(pattern(d)), joined).otherwise(c)
    by = by.replace("\\", "\\\\").replace("$", "\\$")
    if d.keep == "group":
        return F.regexp_replace(c, pattern(d), "$1" + by)
    return F.regexp_replace(c, pattern(d), by)


def mask_all(df, text: str, out: str = "masked", types: str = "privacy_types", by: str = MASK):
    """``df`` with the masked text and the labels of the detectors that changed it.

    One column for each detector: ``hit`` is that the text changed, so each
    pattern is evaluated once.
    """
    keep = [F.col(f"`{x}`") for x in df.columns]
    df = df.select(*keep, F.coalesce(F.col(f"`{text}`"), F.lit("")).alias("_m0"))
    for i, d in enumerate(DETECTORS):
        df = df.withColumn(f"_m{i + 1}", mask(F.col(f"_m{i}"), d, by))
    labels = F.array_compact(F.array(*[F.when(F.col(f"_m{i}") != F.col(f"_m{i + 1}"), F.lit(d.label)) for i, d in enumerate(DETECTORS)]))
    return df.select(*keep, F.col(f"_m{len(DETECTORS)}").alias(out), labels.alias(types))


def report(c: Column) -> Column:
    """Map from label to the number of matches, for the detectors that match the unmasked text."""
    count = lambda d: F.when(may_match(c, d), F.size(F.regexp_extract_all(c, F.lit(pattern(d)), F.lit(0)))).otherwise(0)
    pairs = F.array(*[F.struct(F.lit(d.label), count(d)) for d in DETECTORS])
    return F.map_from_entries(F.filter(pairs, lambda p: p["col2"] > 0))


def has_privacy(c: Column, strict: bool = True) -> Column:
    """Whether a critical detector matches, or in strict mode one of names."""
    used = [d for d in DETECTORS if d.level == "critical" or strict and d.level == "strict"]
    either = lambda chinese: reduce(or_, [c.rlike(pattern(d)) for d in used if d.chinese == chinese])
    return F.coalesce(either(False) | has_chinese(c) & either(True), F.lit(False))
