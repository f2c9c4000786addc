"""Queries of the privacy detectors."""

from __future__ import annotations

from pyspark.sql import functions as F

from corpusmill.functions import privacy as P
from corpusmill.plans.common import table

QUERIES, ORACLES = {}, {}
BY = {d.key: d for d in P.DETECTORS}
M = P.MASK

#: Text around a column, in Spark SQL and DuckDB alike, and the masked text, for each detector.
CASES = {
    "id_card": ("'id 11010519900101' || lpad(c_custkey::VARCHAR, 4, '0') || ' end'", f"'id {M} end'"),
    "passport": ("'pass E' || lpad(c_custkey::VARCHAR, 8, '0') || ' or AB123456 end'", f"'pass {M} or {M} end'"),
    "mobile": ("'tel 138' || lpad(c_custkey::VARCHAR, 8, '0') || ' end'", f"'tel {M} end'"),
    "landline": ("'tel 010-' || lpad(c_custkey::VARCHAR, 8, '0') || ' end'", f"'tel {M} end'"),
    "messenger": ("'微信号：user_' || c_custkey::VARCHAR || 'x wx: abcdefg end'", f"'us{M}  a{M} end'"),
    "insurance": ("'社保号:A' || lpad(c_custkey::VARCHAR, 16, '0') || ' end'", f"'A0{M} end'"),
    "address": ("'在建国路' || c_custkey::VARCHAR || '号3单元 end'", f"'在建国{M}单元 end'"),
    "name_title": ("'张医生 and 李 ' || c_custkey::VARCHAR", f"'张{M} and 李 ' || c_custkey::VARCHAR"),
    "full_name": ("'王小明说 ' || c_custkey::VARCHAR", f"'王{M} ' || c_custkey::VARCHAR"),
    "record": ("'病历号：ZY' || lpad(c_custkey::VARCHAR, 6, '0') || ' end'", f"'ZY{M} end'"),
    "lab_report": ("'检验 x' || c_custkey::VARCHAR || ' 2024年1月2日 end'", f"'{M} end'"),
    "visit": ("'2024-01-02 在北京医院的内科 ' || c_custkey::VARCHAR", f"'{M} ' || c_custkey::VARCHAR"),
}


def detector(key: str, column: str):
    """One detector over a text made from customers."""

    def query(spark, sf_dir):
        c = table(spark, sf_dir, "customer", "c_custkey").select("c_custkey", F.expr(column.replace("::VARCHAR", "::STRING")).alias("t"))
        return c.select("c_custkey", P.mask(F.col("t"), BY[key]).alias("masked"), F.col("t").rlike(P.pattern(BY[key])).alias("hit"))

    return query


for _key, (_text, _masked) in CASES.items():
    QUERIES[f"privacy_{_key}"] = detector(_key, _text)
    ORACLES[f"privacy_{_key}"] = f"SELECT c_custkey, {_masked} AS masked, true AS hit FROM customer"


def in_documents(key: str):
    """One detector over the documents."""

    def query(spark, sf_dir):
        d = table(spark, sf_dir, "documents", "doc_id", "text")
        return d.select("doc_id", F.md5(P.mask(F.col("text"), BY[key]).cast("binary")).alias("masked"), F.size(F.regexp_extract_all("text", F.lit(P.pattern(BY[key])), F.lit(0))).cast("long").alias("n"))

    return query


for _key in ("email", "bank_card", "ip"):
    _p = BY[_key].pattern
    QUERIES[f"privacy_{_key}"] = in_documents(_key)
    ORACLES[f"privacy_{_key}"] = f"SELECT doc_id, md5(regexp_replace(text, '{_p}', '{M}', 'g')) AS masked, len(regexp_extract_all(text, '{_p}'))::BIGINT AS n FROM documents"


def mask_all(spark, sf_dir):
    """All detectors over the documents, one after the other."""
    d = P.mask_all(table(spark, sf_dir, "documents", "doc_id", "text"), "text")
    return d.select("doc_id", F.md5(F.col("masked").cast("binary")).alias("masked"), F.array_join("privacy_types", ",").alias("types"))


_steps = [(k, BY[k].pattern, BY[k].label) for k in ("id_card", "passport", "mobile", "landline", "email", "bank_card", "ip")]
_sql = "SELECT doc_id, text AS t0 FROM documents"
for _i, (_k, _p, _l) in enumerate(_steps):
    _sql = f"SELECT *, regexp_replace(t{_i}, '{_p}', '{M}', 'g') AS t{_i + 1} FROM ({_sql})"
_types = ", ".join(f"CASE WHEN t{i} <> t{i + 1} THEN '{label}' END" for i, (_, _, label) in enumerate(_steps))
QUERIES["privacy_mask_all"] = mask_all
ORACLES["privacy_mask_all"] = f"SELECT doc_id, md5(t{len(_steps)}) AS masked, coalesce(array_to_string(list_filter([{_types}], lambda x: x IS NOT NULL), ','), '') AS types FROM ({_sql})"


def report(spark, sf_dir):
    """The number of matches of each detector in the unmasked documents."""
    d = table(spark, sf_dir, "documents", "doc_id", "text")
    return d.select("doc_id", F.explode(P.report(F.col("text"))).alias("label", "n")).select("doc_id", "label", F.col("n").cast("long").alias("n"))


QUERIES["privacy_report"] = report
ORACLES["privacy_report"] = " UNION ALL ".join(f"SELECT * FROM (SELECT doc_id, '{label}' AS label, len(regexp_extract_all(text, '{p}'))::BIGINT AS n FROM documents) WHERE n > 0" for _, p, label in _steps)


def strict(spark, sf_dir):
    """The documents without critical personal data, and the others masked or not, by mode."""
    d = table(spark, sf_dir, "documents", "doc_id", "text")
    return d.select("doc_id", P.has_privacy(F.col("text")).alias("rejected"), P.has_privacy(F.col("text"), strict=False).alias("critical"))


_crit = " OR ".join(f"regexp_matches(text, '{p}')" for k, p, _ in _steps if k != "ip")
QUERIES["privacy_strict_filter"] = strict
ORACLES["privacy_strict_filter"] = f"SELECT doc_id, {_crit} AS rejected, {_crit} AS critical FROM documents"
