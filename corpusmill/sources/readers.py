"""Tolerant readers: each format its own rule for what a line may be."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

#: Every key that a raw question-and-answer record may use.
RAW = "question string, query string, q string, title string, problem string, prompt string, instruction string, answer string, response string, a string, content string, solution string, reply string, output string, text string, category string, source string, tags array<string>, domain string, difficulty string, id string"
BAD = "_bad"
# How a text is split into question and answer, tried in this order.
QUESTION_AND_ANSWER = (
    r"(?s)问[:：]\s*(.*?)\s*答[:：]\s*(.*)",
    r"(?s)Q[:：]\s*(.*?)\s*A[:：]\s*(.*)",
    r"(?s)问题[:：]\s*(.*?)\s*回答[:：]\s*(.*)",
    r"(?s)(.+?)[?？]\s*(.*)",
)
# End of the fixed values.


def jsonl(spark: SparkSession, path: str, schema: str = RAW, strict: bool = False) -> DataFrame:
    """JSON lines; broken ones are left out, or end the read if ``strict``."""
    if strict:
        return spark.read.schema(schema).option("mode", "FAILFAST").json(path)
    lines = spark.read.text(path).where(F.trim("value") != "")
    row = F.from_json("value", f"{schema}, {BAD} string", {"mode": "PERMISSIVE", "columnNameOfCorruptRecord": BAD})
    return lines.select(row.alias("r")).where(f"r.{BAD} IS NULL").select("r.*").drop(BAD)


def json_array(spark: SparkSession, path: str, schema: str = RAW) -> DataFrame:
    """A file that is one JSON array, or one object with the rows under ``data``."""
    whole = spark.read.text(path, wholetext=True)
    inner = F.coalesce(F.get_json_object("value", "$.data"), F.col("value"))
    return whole.select(F.explode(F.from_json(inner, f"array<struct<{_struct(schema)}>>")).alias("r")).select("r.*")


def _struct(schema: str) -> str:
    return ", ".join(f"{n}: {t}" for n, t in (x.strip().split(" ", 1) for x in schema.split(", ")))


def sniffed(spark: SparkSession, path: str, schema: str = RAW, most: int | None = None) -> DataFrame:
    """A JSON array if the first character that isn't blank opens one, else JSON lines; at most ``most`` rows, beyond which lines are not read."""
    first = spark.read.text(path).where(F.trim("value") != "").limit(1).collect()
    rows = json_array(spark, path, schema) if first and first[0][0].lstrip()[:1] == "[" else jsonl(spark, path, schema)
    return rows if most is None else rows.limit(most)


def text_lines(spark: SparkSession, path: str, schema: str = RAW) -> DataFrame:
    """Lines that are JSON objects as such, others as ``text``; blank ones are left out."""
    lines = spark.read.text(path).where(F.trim("value") != "")
    row = F.from_json("value", f"{schema}, {BAD} string", {"mode": "PERMISSIVE", "columnNameOfCorruptRecord": BAD})
    x = lines.select("value", row.alias("r"))
    ok = F.col("r").isNotNull() & F.col(f"r.{BAD}").isNull()
    names = [c.split(" ")[0] for c in schema.split(", ")]
    return x.select(*[(F.when(ok, F.col(f"r.{n}")).otherwise(F.trim("value")) if n == "text" else F.when(ok, F.col(f"r.{n}"))).alias(n) for n in names])


def paragraphs(spark: SparkSession, path: str) -> DataFrame:
    """Texts between blank lines, trimmed, none empty."""
    strip = F.regexp_replace("value", r"(?U)^\s+|\s+$", "")
    return spark.read.text(path, lineSep="\n\n").select(strip.alias("text")).where("text <> ''")


def csv(spark: SparkSession, path: str, schema: str | None = None, header: bool = True) -> DataFrame:
    """CSV with quotes and line breaks in fields."""
    reader = spark.read.option("header", header).option("multiLine", True).option("escape", '"')
    return (reader.schema(schema) if schema else reader).csv(path)


def excel(spark: SparkSession, path: str) -> DataFrame:
    """The first sheet of a workbook on the driver's disk; needs a reader that pandas knows."""
    import pandas as pd

    return spark.createDataFrame(pd.read_excel(path).astype(object).where(lambda d: d.notna(), None))


READERS = {"json": sniffed, "jsonl": jsonl, "txt": text_lines}


def load(spark: SparkSession, path: str, kind: str | None = None) -> DataFrame:
    """By extension: json, jsonl, csv, txt, xls, xlsx."""
    kind = kind or path.rstrip("/").rsplit(".", 1)[-1].lower()
    if kind in ("xls", "xlsx"):
        return excel(spark, path)
    if kind == "csv":
        return csv(spark, path)
    if kind not in READERS:
        raise ValueError(f"unknown kind of file: {kind}")
    return READERS[kind](spark, path)


def _tables(files, path: str, names: list[str]) -> DataFrame | None:
    """CSV files, which may differ in their columns: files of one header line are read together."""
    head = F.regexp_extract(F.decode(F.substring("content", 1, 65536), "UTF-8"), r"^[^\r\n]*", 0)
    heads = files.format("binaryFile").load(path).where("length > 0").groupBy(head.alias("head")).agg(F.collect_list("path").alias("paths")).collect()
    out = None
    for row in sorted(heads, key=lambda r: r["head"]):
        whole = files.csv(row["paths"])
        part = whole.select(*[F.col(f"`{c}`").cast("string") for c in whole.columns if c in names])
        out = part if out is None else out.unionByName(part, allowMissingColumns=True)
    return out


def _workbooks(files: DataFrame, schema: str) -> DataFrame:
    """The first sheet of each workbook; needs a reader that pandas knows where a file is found."""
    names = [c.split(" ")[0] for c in schema.split(", ")]

    def run(batches):
        import io

        import pandas as pd

        for batch in batches:
            for content in batch["content"]:
                sheet = pd.read_excel(io.BytesIO(content)).reindex(columns=names).astype(object)
                yield sheet.where(sheet.notna(), None)

    return files.select("content").mapInPandas(run, schema)


#: What ``scan`` reads.
KINDS = ("json", "jsonl", "csv", "txt", "xlsx", "xls")


def scan(spark: SparkSession, path: str, kinds=KINDS, schema: str = RAW) -> DataFrame:
    """All files of some kinds below a folder, with their columns united.

    A ``.json`` file is one array, or an object with the rows under ``data``, or
    a record a line, whatever its first character says; broken records are left
    out.  Columns that a CSV file or a workbook has besides those of ``schema``
    are not read.
    """
    names = [c.split(" ")[0] for c in schema.split(", ")]
    kind_of = _struct(schema)
    out = None
    for kind in kinds:
        files = spark.read.option("recursiveFileLookup", True).option("pathGlobFilter", f"*.{kind}")
        if kind == "csv":
            part = _tables(files.option("header", True).option("multiLine", True).option("escape", '"'), path, names)
        elif kind in ("xlsx", "xls"):
            part = _workbooks(files.format("binaryFile").load(path), schema)
        elif kind == "json":
            first = F.substring(F.ltrim("value"), 1, 1)
            array = lambda c: F.from_json(c, f"array<struct<{kind_of}>>")
            wrapped = F.get_json_object("value", "$.data")
            lines = F.transform(F.filter(F.split("value", "\n"), lambda x: F.trim(x) != ""), lambda x: F.from_json(x, f"{schema}, {BAD} string", {"columnNameOfCorruptRecord": BAD}))
            good = F.transform(F.filter(lines, lambda r: r[BAD].isNull()), lambda r: F.struct(*[r[n].alias(n) for n in names]))
            rows = F.when(first == "[", array(F.col("value"))).when(F.substring(F.ltrim(wrapped), 1, 1) == "[", array(wrapped)).otherwise(good)
            part = files.option("wholetext", True).text(path).select(F.explode(rows).alias("r")).select("r.*")
        else:
            lines = files.text(path).where(F.trim("value") != "")
            x = lines.select("value", F.from_json("value", f"{schema}, {BAD} string", {"mode": "PERMISSIVE", "columnNameOfCorruptRecord": BAD}).alias("r"))
            ok = F.col("r").isNotNull() & F.col(f"r.{BAD}").isNull()
            plain = lambda n: F.when(ok, F.col(f"r.{n}")).otherwise(F.trim("value")) if n == "text" else F.when(ok, F.col(f"r.{n}"))
            part = x.where(ok).select(*[F.col(f"r.{n}") for n in names]) if kind == "jsonl" else x.select(*[plain(n).alias(n) for n in names])
        if part is not None:
            out = part if out is None else out.unionByName(part, allowMissingColumns=True)
    return out


def first_of(df: DataFrame, *names: str, trim: bool = False) -> Column:
    """The first of the columns present whose value isn't empty."""
    cols = [F.trim(F.col(n)) if trim else F.col(n) for n in names if n in df.columns]
    return F.coalesce(*[F.nullif(c, F.lit("")) for c in cols], F.lit(None).cast("string"))


def adapt(df: DataFrame) -> DataFrame:
    """Question and answer from one of four pairs of keys, the first pair present; other rows are left out."""
    pairs = (("question", "answer"), ("instruction", "output"), ("prompt", "response"), ("query", "response"))
    q, a = F.lit(None).cast("string"), F.lit(None).cast("string")
    for x, y in reversed([p for p in pairs if set(p) <= set(df.columns)]):
        both = F.col(x).isNotNull() & F.col(y).isNotNull()
        q, a = F.when(both, F.col(x)).otherwise(q), F.when(both, F.col(y)).otherwise(a)
    rest = [c for c in df.columns if c not in ("question", "answer")]
    return df.select(q.alias("question"), a.alias("answer"), *rest).where("question IS NOT NULL AND answer IS NOT NULL")


def preference(df: DataFrame, template: str = "{}") -> DataFrame:
    """Prompt, chosen and rejected by three names each, the prompt in a template; incomplete rows are left out."""
    head, tail = template.split("{}")
    p, c, r = first_of(df, "prompt", "question", "instruction", trim=True), first_of(df, "chosen", "response_chosen", "accepted", trim=True), first_of(df, "rejected", "response_rejected", "declined", trim=True)
    x = df.select(p.alias("prompt"), c.alias("chosen"), r.alias("rejected")).na.drop()
    return x.withColumn("prompt", F.concat(F.lit(head), F.col("prompt"), F.lit(tail)))


def normalise_qa(df: DataFrame, key: str | None = None, least_question: int = 5, least_answer: int = 10, domain: str = "medical", strict: bool = True) -> DataFrame:
    """Cleaned question and answer with an id, from any of the known keys.

    A missing part is taken from ``text`` by the first of four patterns that
    matches, which then gives both.  Personal data rejects a row if ``strict``,
    and is masked otherwise.
    """
    from corpusmill.functions import privacy, text
    from corpusmill.functions.columns import settle

    q = first_of(df, "question", "query", "q", "title", "problem")
    a = first_of(df, "answer", "response", "a", "content", "solution", "reply")
    x = df.withColumns({"_q": q, "_a": a})
    if "text" in df.columns:
        need = (F.col("_q").isNull() | F.col("_a").isNull()) & F.col("text").isNotNull()
        nq, na = F.col("_q"), F.col("_a")
        for p in reversed(QUESTION_AND_ANSWER):
            hit = F.col("text").rlike(p)
            nq, na = F.when(hit, text.strip(F.regexp_extract("text", p, 1))).otherwise(nq), F.when(hit, text.strip(F.regexp_extract("text", p, 2))).otherwise(na)
        x = x.withColumns({"_nq": F.when(need, nq).otherwise(F.col("_q")), "_na": F.when(need, na).otherwise(F.col("_a"))}).drop("_q", "_a").withColumnsRenamed({"_nq": "_q", "_na": "_a"})
    x = settle(x, {"_q": F.col("_q"), "_a": F.col("_a")}).where("_q IS NOT NULL AND _a IS NOT NULL AND _q <> '' AND _a <> ''")
    if strict:
        x = x.where(~privacy.has_privacy(F.col("_q")) & ~privacy.has_privacy(F.col("_a")))
    for c in ("_q", "_a"):
        x = privacy.mask_all(x, c, c + "m", c + "t").drop(c + "t")
    x = settle(x.drop("question", "answer"), {"question": text.clean(F.col("_qm")), "answer": text.clean(F.col("_am"))}).where((F.length("question") >= least_question) & (F.length("answer") >= least_answer))
    known = [c for c in ("category", "source", "tags", "difficulty") if c in df.columns]
    dom = F.coalesce(F.nullif(F.col("domain"), F.lit("")), F.lit(domain)) if "domain" in df.columns else F.lit(domain)
    return x.select(*([key] if key else []), F.md5(F.concat("question", "answer").cast("binary")).alias("id"), "question", "answer", dom.alias("domain"), *known)
